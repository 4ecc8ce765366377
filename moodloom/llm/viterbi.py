"""SentencePiece encoding by a Viterbi search that shares prefixes, and decoding.

A text gets its dummy space, spaces become the mark U+2581, and it is cut into
marked words: a run of marks with the characters up to the next mark or line end.
No usable piece reaches across such a cut (checked when the model is loaded), so
the best path of a text is the best paths of its words one after another. The
distinct words of a step are sorted, which is a depth-first walk through their
trie: forward scores depend on the prefix only, so the search goes on from the
prefix that a word shares with the one before. Scores are the model's own; ties
go to the longer last piece. Characters that no piece covers become byte pieces,
and so does a literal U+2581, which makes decoding exact.

The vocabulary file is a parameter and is read on each executor from that path.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows are encoded alike; other columns pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodloom.llm.chunks import Encoder
from moodloom.llm.common import bound_batches, give_back, joined

MARK = "▁"
#: Texts whose cuts need the regular expression: runs of spaces, a leading space, literal marks.
ODD = f"  |^ |{MARK}|\x1f"
#: Distinct words a worker remembers, from one task to the next.
REMEMBERED = 300_000
_WORD = re.compile(f"\n|{MARK}| +[^ \n{MARK}]*|[^ \n{MARK}]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Usable pieces of a model file with their scores."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.bytes = {int(m.id_to_piece(i)[3:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)
        self.score = {m.id_to_piece(i): (m.get_score(i), i) for i in range(n) if not special(i)}
        across = [p for p in self.score if re.search(f"[^{MARK}]{MARK}|.\n|\n.", p, re.S)]
        if across:
            raise ValueError(f"pieces reach across words: {across[:3]}")
        self.longest = max(map(len, self.score), default=1)
        # Every end of a piece, with score and id where it is a piece itself.
        self.ends = {p[k:]: None for p in self.score for k in range(len(p))} | self.score
        self.unknown_score = min((s for s, _ in self.score.values()), default=0.0) - 10
        back = {i: bytes([b]) for b, i in self.bytes.items()}
        text = [back.get(i, b"" if special(i) else m.id_to_piece(i).replace(MARK, " ").encode()) for i in range(n)]
        self.text = pa.array(text, pa.large_binary())

    def spelled(self, text: str) -> list[int]:
        """Byte pieces of characters that have no piece."""
        return [self.bytes.get(b, self.unknown) for b in text.encode()]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words (marks as spaces, a literal mark as itself)."""
        out: list[list[int]] = [[]] * len(words)
        best, back = [0.0], [(0, -1)]
        previous = ""
        score, ends = self.score, self.ends
        for k in sorted(range(len(words)), key=words.__getitem__):
            if MARK in words[k]:
                out[k] = self.spelled(words[k])
                continue
            word = words[k].replace(" ", MARK)
            shared = 0
            for a, b in zip(word, previous):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, come = -np.inf, (end - 1, -1)
                for start in range(end - 1, -1, -1):
                    hit = ends.get(word[start:end], False)
                    if hit is False:
                        break
                    if hit is not None and best[start] + hit[0] >= top:
                        top, come = best[start] + hit[0], (start, hit[1])
                if word[end - 1] not in score and best[end - 1] + self.unknown_score > top:
                    top, come = best[end - 1] + self.unknown_score, (end - 1, -1)
                best.append(top)
                back.append(come)
            previous = word
            ids: list[int] = []
            end = len(word)
            while end:
                start, piece = back[end]
                ids += [piece] if piece >= 0 else self.spelled(word[start:end])[::-1]
                end = start
            out[k] = ids[::-1]
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of consecutive texts without their dummy space, and the bytes of each."""
        data, offsets = joined(self.text.take(pa.array(ids)))
        per_text = np.diff(offsets[np.r_[0, np.cumsum(counts)]])
        first = (np.cumsum(per_text) - per_text)[per_text > 0]
        return np.delete(data, first), per_text - (per_text > 0)


def cut_words(text: str) -> list[str]:
    return _WORD.findall(text)


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Pieces, Encoder]:
    pieces = Pieces(path)
    return pieces, Encoder(pieces.encode, ODD, cut_words, " ", remembered=REMEMBERED)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", remember: bool = True) -> DataFrame:
    """``docs`` with pieces: struct(n_tokens, ids, ids_crc32, decoded_equal).

    Workers ``remember`` words from task to task, which saves time and holds memory as long
    as they live, also in the steps of a job that come after.

    ``ids_crc32`` is over the ids as little-endian 32-bit integers; ``decoded_equal``
    says that the ids decode to the very text.
    """
    bound_batches(docs.sparkSession)
    path = path or default_model()

    def pieces_of(texts: pa.Array, pieces: Pieces, encoder: Encoder) -> pa.Array:
        # The dummy space belongs to texts that are not empty.
        full = pc.binary_length(texts).to_numpy() > 0
        filled = texts if full.all() else texts.filter(pa.array(full))
        # No piece is shorter than a byte: room for all ids, of which only the pages in use take memory.
        room = np.empty(pc.sum(pc.binary_length(filled)).as_py() + len(filled) if len(filled) else 0, np.int32)
        end, counts, sums, equal = 0, [np.empty(0, np.int64)], [], []
        for a, b, ids, n in encoder(filled):
            room[end : end + len(ids)] = ids
            end += len(ids)
            counts.append(n)
            ends = np.cumsum(n)
            raw = memoryview(ids.astype("<u4")).cast("B")
            sums += [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), n.tolist())]
            data, sizes = pieces.decode(ids, n)
            given, offsets = joined(filled[a:b])
            same = np.diff(offsets) == sizes
            if same.all():
                wrong = np.r_[0, np.cumsum(given != data)]
                same = wrong[offsets[1:]] == wrong[offsets[:-1]]
            equal += same.tolist()
        spread = lambda values, rest: np.r_[values, rest][np.where(full, np.cumsum(full) - 1, len(values))]
        n = spread(np.concatenate(counts), 0)
        return pa.StructArray.from_arrays(
            [
                pa.array(n),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(room[:end])),
                pa.array(spread(np.array(sums, np.int64), 0)),
                pa.array(spread(np.array(equal, bool), True)),
            ],
            ["n_tokens", "ids", "ids_crc32", "decoded_equal"],
        )

    @F.arrow_udf("struct<n_tokens:bigint,ids:array<int>,ids_crc32:bigint,decoded_equal:boolean>")
    def all_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, encoder = _loaded(path)
        for texts in batches:
            yield pieces_of(texts, pieces, encoder)
        if not remember:
            encoder.forget()
        give_back()

    return docs.withColumn("pieces", all_pieces(F.coalesce(F.col(text), F.lit(""))))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with decoded: the text of an id array; null ids are the empty text."""
    path = path or default_model()

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        pieces = _loaded(path)[0]
        counts = np.array([len(x) for x in lists.to_pylist()], np.int64)
        data, sizes = pieces.decode(lists.flatten().to_numpy(), counts)
        ends = np.cumsum(sizes).tolist()
        raw = data.tobytes()
        return pa.array([raw[e - s : e].decode("utf-8", "replace") for e, s in zip(ends, sizes.tolist())], pa.string())

    return rows.withColumn("decoded", text_of(F.coalesce(F.col(ids), F.array().cast("array<int>"))))
