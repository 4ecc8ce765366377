"""Substring dedup by sentence spans.

A text is cut into sentences that together are the text: everything up to a run of end
marks or clause marks (``MARKS``: of the ASCII, CJK, Arabic and Devanagari scripts, and
line ends) with the white space after it. Long sentences thus become several units, so a
passage that begins and ends in the middle of its hosts' sentences still holds whole
ones. Every run of ``SPAN`` consecutive units, trimmed and lower-cased, is hashed, and
the hashes are written once. Spans are joined over all documents; the first occurrence
(smallest doc_id, then place) stays, and units that a later occurrence covers are marked.
Neighbouring marked units form a run; a run of at least ``MIN_CHARS`` characters is a
passage and is removed. Spans have no least length of their own, so a passage of many
short lines is seen.

Hot spans: a span with a large share of all occurrences is dealt to many join tasks, its
first occurrence going to each of them.

Defined cases: null and empty texts have no sentences and stay as they are (null becomes
empty); texts with fewer sentences than a span keep all; rows equal in doc_id and text
are one document and get the same result; a very long text is cut like any other, its
units being one row of 20 bytes each. Other columns keep their values, whatever they are
called; only columns named like a result of ``dedup`` give way to it there. A passage
without any mark inside cannot be seen; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodloom.llm.common import bound_batches, drop, release, settle

# End marks and clause marks.
MARKS = ".!?\n" + "。！？｡؟۔।॥…" + ",;:" + "，；：、،؛"
SENTENCE = f"[^{MARKS}]*[{MARKS}]+[ \t\n\f\r]*|[^{MARKS}]+$"
SPAN = 2
MIN_CHARS = 60
#: Spans with more than this share of all occurrences are dealt to several tasks.
HOT_SHARE = 1 / 1000
_SENTENCE = re.compile(SENTENCE.replace("$", r"\Z"))


def sentences(text: str = "text") -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE.replace("$", r"\z")), F.lit(0))


def _keys(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """_id and _th, which name a document even when doc_id is null or repeated."""
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_th"),
    ]


def _units(docs: DataFrame) -> DataFrame:
    """(_id, _th, h, g, n): two hashes and the length of every unit of a document."""
    plain = F.transform(sentences(), lambda s: F.lower(F.trim(F.translate(s, "\t\n\f\r", "    "))))
    return docs.select(*_keys(), plain.alias("plain")).select(
        "_id",
        "_th",
        F.transform("plain", lambda s: F.xxhash64(s)).alias("h"),
        F.transform("plain", lambda s: F.xxhash64(F.lit(1), s)).alias("g"),
        F.transform("plain", lambda s: F.length(s)).alias("n"),
    )


def _spans(units: DataFrame, span: int) -> DataFrame:
    """A row per span: h, g (hashes), _id, _th, pos."""
    at = lambda c, i: [F.get(c, i + k) for k in range(span)]
    found = F.transform(
        F.sequence(F.lit(0), F.size("h") - span),
        lambda i: F.struct(F.xxhash64(*at("h", i)).alias("h"), F.xxhash64(*at("g", i)).alias("g"), i.alias("pos")),
    )
    return units.where(F.size("h") >= span).select("_id", "_th", F.explode(found).alias("s")).select("s.*", "_id", "_th")


def _later(spans: DataFrame) -> DataFrame:
    """(_id, _th, pos) of all spans but the first occurrence of each."""
    total = spans.count()
    key = ["h", "g"]
    often = settle(
        spans.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_th", "pos")).alias("first")).where("n > 1")
    )
    # At most 1 / HOT_SHARE spans are that frequent.
    hot = max(1000, int(total * HOT_SHARE))
    salts = F.ceil(F.col("n") / hot).cast("int")
    heavy = often.where(F.col("n") > hot).select(*key, salts.alias("salts"))
    dealt = spans.join(F.broadcast(heavy), key, "left").withColumn(
        "salt", F.pmod(F.xxhash64("_id", "_th", "pos"), F.coalesce("salts", F.lit(1))).cast("int")
    )
    firsts = often.select(*key, "first", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return dealt.join(firsts, [*key, "salt"]).where(F.struct("_id", "_th", "pos") != F.col("first")).select("_id", "_th", "pos")


def passages(docs: DataFrame, span: int = SPAN, least: int = MIN_CHARS) -> DataFrame:
    """(_id, _th, n_sentences, runs): the removed runs (first unit, last unit) of each document."""

    @F.arrow_udf("array<struct<a: int, b: int>>")
    def merged(places: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for pos, n in zip(places.to_pylist(), lengths.to_pylist()):
            gone = np.zeros(len(n) + 1, bool)
            for k in range(span):
                gone[np.array(pos, np.int64) + k] = True
            edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8)))
            upto = np.r_[0, np.cumsum(n)]
            runs = [(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)]
            # Characters of the units and of one space between two.
            out.append([{"a": a, "b": b} for a, b in runs if upto[b + 1] - upto[a] + (b - a) >= least])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))

    bound_batches(docs.sparkSession)
    units = settle(_units(docs))
    spans = settle(_spans(units, span))
    release(docs.sparkSession)
    marked = _later(spans).groupBy("_id", "_th").agg(F.collect_set("pos").alias("places"))
    # Rows that are the same document have the same units.
    one = units.groupBy("_id", "_th").agg(F.max("n").alias("n"))
    runs = F.when(F.col("places").isNotNull(), merged(F.coalesce("places", F.array().cast("array<int>")), F.col("n")))
    out = settle(one.join(marked, ["_id", "_th"], "left").select("_id", "_th", F.size("n").alias("n_sentences"), runs.alias("runs")))
    drop(units, spans)
    return out


def _dedup(docs: DataFrame, span: int, least: int) -> DataFrame:
    """(_row, clean, n_sentences, n_removed): the user's columns stay in one struct."""
    rows = docs.select(F.struct("*").alias("_row"), *_keys())
    done = rows.join(passages(docs, span, least), ["_id", "_th"])
    left = F.filter(sentences("_row.text"), lambda s, i: ~F.exists("runs", lambda r: (i >= r["a"]) & (i <= r["b"])))
    text = F.coalesce("_row.text", F.lit(""))
    gone = F.aggregate("runs", F.lit(0).cast("bigint"), lambda t, r: t + r["b"] - r["a"] + 1)
    return done.select(
        "_row",
        F.when(F.size("runs") > 0, F.array_join(left, "")).otherwise(text).alias("clean"),
        F.col("n_sentences").cast("bigint").alias("n_sentences"),
        F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_removed"),
    )


def dedup(docs: DataFrame, span: int = SPAN, least: int = MIN_CHARS) -> DataFrame:
    """``docs`` with clean (the remaining text), n_sentences and n_removed."""
    results = ["clean", "n_sentences", "n_removed"]
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in results]
    return _dedup(docs, span, least).select(*own, *results)


def cleaned(docs: DataFrame, span: int = SPAN, least: int = MIN_CHARS) -> DataFrame:
    """Documents with their remaining text, in their own columns; those left empty go."""
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    own = [new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns]
    return _dedup(docs, span, least).where(F.length(F.trim("clean")) > 0).select(*own)
