"""Quality rules by repetition inside a text, from the suffix array of its words.

The words of a batch of texts get numbers, each text ends with a mark of its own,
and the suffixes are ordered by prefix doubling: only suffixes that still share
their rank with another one are sorted again, so ordinary prose is done after a
few words. Longest common prefixes of neighbours come from the kept ranks, and a
stack over them yields the LCP intervals. An interval whose occurrences differ in
the word before is a maximal repeat; the union of the spans of all repeats of
``min_words`` or more covers part of the text. A text passes if that part is at
most ``max_covered`` and the longest repeat has at most ``max_longest`` words.

Defined cases: null and empty texts have no words and fail the base rule; repeated
rows are judged one by one; other columns do not matter. A text is one row of one
task, of any length; memory grows with the batch, about 100 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodloom.llm.common import joined, steps, utf8, words_of

# Fixed values of the base rule.
WINDOW = 8
MIN_TOTAL = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 5
MAX_COVERED = 0.3
MAX_LONGEST = 100

KIND = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "n_covered:bigint,longest:bigint,n_repeats:bigint>"
)


def ranks(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, .. words, until all differ.

    ``words`` ends each text with a number that occurs once, so that no common
    prefix crosses a border.
    """
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, n, h = [rank], len(words), 1
    size = np.bincount(rank, minlength=n)
    first = np.cumsum(size) - size
    rank = first[rank]
    levels[0] = rank
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(active) and h < n:
        nxt = rank[np.minimum(active + h, n - 1)]
        order = np.lexsort((nxt, rank[active]))
        a, key, sub = active[order], rank[active][order], nxt[order]
        new_group = np.r_[True, key[1:] != key[:-1]]
        new = new_group | np.r_[True, sub[1:] != sub[:-1]]
        at = np.arange(len(a))
        group_start = np.maximum.accumulate(np.where(new_group, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[a] = key + (start - group_start)
        levels.append(rank)
        h *= 2
        single = np.r_[new[1:], True] & new
        active = a[~single]
    return levels


def neighbours(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and the common prefix of each entry with the one before it."""
    last = levels[-1]
    n = len(last)
    sa = np.argsort(last, kind="stable")
    lcp = np.zeros(n, np.int64)
    pair = 1 + np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    i, j, length = sa[pair - 1], sa[pair], np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = np.minimum(i + length, n - 1), np.minimum(j + length, n - 1)
        same = (levels[k][p] == levels[k][q]) & (i + length < n) & (j + length < n)
        length += np.where(same, 1 << k, 0)
    lcp[pair] = length
    return sa, lcp


def intervals(sa: np.ndarray, lcp: np.ndarray, words: np.ndarray, least: int):
    """(length, first, last) of the LCP intervals of ``least`` or more that are maximal repeats."""
    before = np.where(sa > 0, words[sa - 1], -1)
    differ = np.cumsum(np.r_[0, before[1:] != before[:-1]])
    at = np.flatnonzero(lcp >= least)
    if not len(at):
        return
    runs = np.split(at, 1 + np.flatnonzero(np.diff(at) > 1))
    for run in runs:
        lo, values = int(run[0]), lcp[run].tolist()
        stack: list[tuple[int, int]] = []
        for k, value in enumerate([*values, 0]):
            left = lo + k - 1
            while stack and stack[-1][0] > value:
                length, left = stack.pop()
                last = lo + k - 1
                if differ[last] > differ[left]:
                    yield length, left, last
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, left))


def painted(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(start + length, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def repeats(words: np.ndarray, counts: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """Repetition inside each of consecutive texts of ``counts`` words."""
    texts = len(counts)
    row = np.repeat(np.arange(texts), counts)
    ends = np.cumsum(counts) + np.arange(texts)
    n = len(words) + texts
    seq = np.empty(n, np.int64)
    own = np.ones(n, bool)
    own[ends] = False
    # A word of another text is another number, so repeats stay inside a text.
    top = int(words.max()) + 1 if len(words) else 1
    seq[own] = words + row * top
    seq[~own] = texts * top + np.arange(texts)
    of = np.repeat(np.arange(texts), counts + 1)
    sa, lcp = neighbours(ranks(seq))
    reach = np.maximum(lcp, np.r_[lcp[1:], 0])
    out = {}
    for name, k in (("n_repeat_words", WINDOW), ("n_covered", least)):
        some = reach >= k
        out[name] = np.bincount(of[painted(sa[some], reach[some], n)], minlength=texts)
    out["longest"] = np.zeros(texts, np.int64)
    np.maximum.at(out["longest"], of[sa], np.where(reach >= least, reach, 0))
    out["n_repeats"] = np.zeros(texts, np.int64)
    for _, first, _ in intervals(sa, lcp, seq, least):
        out["n_repeats"][of[sa[first]]] += 1
    return out


def dup_lines(text: bytes) -> int:
    lines = [l for l in text.split(b"\n") if l.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def measured(texts: pa.Array, least: int) -> pa.Array:
    """The struct ``KIND`` of each whole text (binary, no nulls)."""
    out: dict[str, list[np.ndarray]] = {}
    sizes = np.diff(joined(texts)[1])
    for a, b in steps(sizes):
        part = texts[a:b]
        flat, counts = words_of(part)
        data, offsets = joined(part)
        rows = np.repeat(np.arange(b - a), counts)
        ids = flat.dictionary_encode().indices.to_numpy() if len(flat) else np.empty(0, np.int64)
        got = {
            "n_words": counts,
            "word_chars": np.bincount(rows, pc.utf8_length(flat).to_numpy(), b - a),
            "n_symbols": np.diff(np.r_[0, np.cumsum(_SYMBOL[data])][offsets]),
            "n_dup_lines": np.array([dup_lines(t) for t in part.to_pylist()]),
            **repeats(ids.astype(np.int64), counts, least),
        }
        for k, v in got.items():
            out.setdefault(k, []).append(v)
    names = [f.split(":")[0] for f in KIND[7:-1].split(",")]
    empty = [np.empty(0)]
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(out.get(n, empty)).astype(np.int64)) for n in names], names
    )


def rules(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """Counts and verdict of every document."""

    @F.arrow_udf(KIND)
    def measure(texts: pa.Array) -> pa.Array:
        return measured(texts, min_words)

    failed = (F.col("n_words") < MIN_TOTAL) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    fine = (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest") <= max_longest)
    return (
        docs.select("doc_id", measure(utf8()).alias("m"))
        .select("doc_id", "m.*")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & fine)
    )
