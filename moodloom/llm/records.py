"""Token ids as length-delimited binary records with an offset index.

One data file per task holds records one after another:

    length      8 bytes, little-endian, of the payload
    check       4 bytes, masked CRC-32 of the length bytes
    payload     doc_id (8 bytes, signed), has_id (1 byte), width (1 byte: 2 or 4),
                ids in little-endian of that width
    check       4 bytes, masked CRC-32 of the payload

The mask rotates the CRC-32 right by 15 bits and adds 0xa282ead8, so that a check
over data that itself holds checks stays meaningful. The index is a file of its
own, (offset, length) of every record as 64-bit integers, so that a reader can
fetch records in any order. Files carry a fresh name per attempt; the manifest
names those of the attempts that counted, so a lost executor leaves at most files
that nobody reads.

Documents are ordered by a range partitioning of doc_id (null first; rows that
share it by a hash of their text), one shard per partition. Texts are cut into
chunks at places where the tokenizer's own pattern always cuts, and each distinct
chunk is encoded once by the library; texts with other white space are encoded
whole. The vocabulary file is a parameter and is read on each executor.

Defined cases: a null or empty text is the end id alone; rows may repeat; other
columns do not matter; an empty table gives empty shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodloom.llm.chunks import Encoder
from moodloom.llm.common import joined, settle
from moodloom.session import ensure_checkpoint_dir

END_ID = 0
HEAD = struct.Struct("<Q")
CHECK = struct.Struct("<I")
OWN = struct.Struct("<qBB")
#: White space that the tokenizer's pattern joins with its neighbours, and its special token.
ODD = (
    r"[ \n][ \n]|[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}]|^[ \n]|[ \n]$|<\|endoftext\|>"
)
READ_BYTES = 8 << 20
#: Bytes of text that are cut and looked up at once.
STEP_BYTES = 4 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    return Encoder(encode, ODD, lambda text: [text], points=True, remembered=1_000_000, step_bytes=STEP_BYTES)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    payload = OWN.pack(doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()
    head = HEAD.pack(len(payload))
    return b"".join((head, CHECK.pack(masked(head)), payload, CHECK.pack(masked(payload))))


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one record; ValueError if a check fails."""
    (size,) = HEAD.unpack_from(record)
    payload = record[12 : 12 + size]
    if CHECK.unpack_from(record, 8)[0] != masked(record[:8]) or len(record) != size + 16:
        raise ValueError("record length is damaged")
    if CHECK.unpack_from(record, 12 + size)[0] != masked(payload):
        raise ValueError("record payload is damaged")
    doc_id, has_id, width = OWN.unpack_from(payload)
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=OWN.size)


def _store(folder: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    if folder.startswith("/") or (folder.startswith("file:/") and not folder.startswith("file://")):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids below ``folder``; the manifest, one row per shard.

    ``folder`` is a URI that PyArrow reaches from every executor. The manifest
    (shard, data, index, n_docs, n_tokens, start) is settled, so files are written
    once; start counts the ids of all shards before.
    """
    spark = docs.sparkSession
    path = path or default_tokenizer()
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dump(batches):
        store, base = _store(folder)
        shard = TaskContext.get().partitionId()
        name = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}"
        encoder, index, at, tokens, out = _encoder(path), [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{name}.rec")
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, _, ids, counts in encoder(texts):
                ends = np.cumsum(counts)
                buffer = []
                for k, (e, c) in enumerate(zip(ends.tolist(), counts.tolist())):
                    record = frame(doc_ids[a + k], np.r_[ids[e - c : e], end_id])
                    index.append((at, len(record)))
                    at += len(record)
                    tokens += c + 1
                    buffer.append(record)
                out.write(b"".join(buffer))
        if out is not None:
            out.close()
            with store.open_output_stream(f"{name}.idx") as f:
                f.write(np.array(index, "<i8").tobytes())
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "name": name, "n_docs": len(index), "n_tokens": tokens, "n_bytes": at}],
                pa.schema(
                    [("shard", pa.int32()), ("name", pa.string())]
                    + [(c, pa.int64()) for c in ("n_docs", "n_tokens", "n_bytes")]
                ),
            )

    text = F.coalesce("text", F.lit(""))
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
    )
    written = settle(
        ordered.mapInArrow(dump, "shard int, name string, n_docs bigint, n_tokens bigint, n_bytes bigint")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files."""
    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    schema = pa.schema([(c.split()[0], pa.int64()) for c in kind.split(", ")])

    def load(batches):
        store, _ = _store(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            with store.open_input_file(f"{row['name']}.idx") as f:
                index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
            start, k = row["start"], 0
            with store.open_input_file(f"{row['name']}.rec") as f:
                while k < len(index):
                    base = index[k, 0]
                    end = max(k + 1, int(np.searchsorted(index[:, 0], base + READ_BYTES)))
                    f.seek(int(base))
                    data = f.read(int(index[end - 1].sum() - base))
                    rows = []
                    for at, size in (index[k:end] - [base, 0]).tolist():
                        doc_id, ids = unframe(data[at : at + size])
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema
                    )
                    k = end

    shards = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(shards, "shard").mapInArrow(load, kind)


def folder_for(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/records/{uuid.uuid4().hex}"
