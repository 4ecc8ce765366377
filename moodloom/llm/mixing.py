"""Mixing sources to target weights as a min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources
are one node, a pattern, whose capacity is the sum of its sizes per repetition; the
first use of a word costs nothing and every further use one more than the one
before (convex), so words are repeated only when nothing fresh can serve a source.
Patterns feed their sources, sources drain their integer quotas. The flow is solved
on patterns and sources alone, whose number is checked (``MAX_PATTERNS``); it says
how many words of a pattern go to each source.

Documents of a pattern lie on a line in the order of a seeded hash. The flow cuts
that line, repetition after repetition, into stretches of one source each, and a
document belongs to the stretch that holds its middle. Only the hash at the end of
a stretch is needed to apply the cut, so documents are chosen in the scan and the
text never moves. The lines are summed in two steps, hash ranges first, so a
pattern that holds most rows is spread over tasks.

Defined cases: null sizes count 0; documents of size 0 take nothing; a null source
is a source of its own and comes last; documents equal in doc_id and text share a
place and are taken alike; a source without words has target 0; other columns
pass unchanged, whatever their names (the row travels as one struct), but a column named
like a result column is given with underscores at its end (``mix``, ``of_source``);
a text of any length counts whole and is one document of the line; an empty table
gives an empty mix.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodloom.llm.common import drop, settle

# Fixed values of the mix.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_USES = 2
WORD = r"[^\x20\x09-\x0D]+"

#: Patterns and sources that the driver solves; more raise an error.
MAX_PATTERNS = 20_000
SEED = "mix"
#: Leading hex digits of the hash that name a range of the line.
DIGITS = 3
#: Stands for the null source in maps.
NULL_KEY = "\0"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def by_code_point(sources) -> list[str | None]:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, uses: int = MAX_USES) -> dict:
    """Words wanted per source: by weight, at most ``uses`` times the size, the excess reshared."""
    order = by_code_point(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    free = sorted(order, key=lambda s: uses * sizes[s] / weight[s])
    full: dict = {}
    capped = 0
    while free:
        level = sum(weight[s] for s in free)
        s = free[0]
        if (total - capped) * weight[s] / level <= uses * sizes[s]:
            return {**full, **{s: (total - capped) * weight[s] / level for s in free}}
        full[s] = float(uses * sizes[s])
        capped += uses * sizes[s]
        free.pop(0)
    return full


def flow(patterns: dict[tuple, int], quotas: dict, uses: int = MAX_USES) -> dict[tuple, dict]:
    """Words per pattern and source: a maximal flow of least repetition cost.

    Successive shortest paths; ``patterns`` maps a tuple of sources to its size.
    """
    head: list[list[int]] = []
    to, room, cost = [], [], []

    def node() -> int:
        head.append([])
        return len(head) - 1

    def arc(u: int, v: int, capacity: int, price: int) -> int:
        for a, b, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            head[a].append(len(to))
            to.append(b)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    start, sink = node(), node()
    at = {s: node() for s in quotas}
    for s, q in quotas.items():
        arc(at[s], sink, q, 0)
    carried = {}
    for p, size in patterns.items():
        n = node()
        for use in range(uses):
            arc(start, n, size, use)
        for s in p:
            carried[p, s] = arc(n, at[s], uses * size, 0)
    while True:
        dist, via, queue, waits = {start: 0}, {}, deque([start]), {start}
        while queue:
            u = queue.popleft()
            waits.discard(u)
            for e in head[u]:
                v = to[e]
                if room[e] > 0 and dist[u] + cost[e] < dist.get(v, 1 << 60):
                    dist[v], via[v] = dist[u] + cost[e], e
                    if v not in waits:
                        waits.add(v)
                        queue.append(v)
        if sink not in dist:
            break
        path, v = [], sink
        while v != start:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for (p, s), e in carried.items():
        if room[e ^ 1]:
            out[p][s] = room[e ^ 1]
    return out


def stretches(size: int, routed: dict) -> list[tuple[int, int, str | None]]:
    """(use, end within the line, source) of the consecutive stretches of a pattern."""
    out, at = [], 0
    for s in by_code_point(routed):
        left = routed[s]
        while left:
            use, place = divmod(at, size)
            step = min(left, size - place)
            out.append((use, place + step, s))
            at += step
            left -= step
    return out


def routed(docs: DataFrame, sources: Column, size: Column, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc, the struct of all its columns, and pattern, size, uses, source_sizes, targets."""
    spark = docs.sparkSession
    place = F.md5(
        F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    )
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.array_sort(F.array_distinct(sources)).alias("pattern"),
        place.alias("place"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
    )
    keyed = settle(rows.groupBy("pattern", "place").agg(F.sum("size").alias("size")))
    ranges = keyed.groupBy("pattern", F.substring("place", 1, DIGITS).alias("range")).agg(F.sum("size").alias("size"))
    sums = keyed.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    patterns = {tuple(r["pattern"]): int(r["size"]) for r in sums}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    wanted = targets(sizes)
    quotas = {s: int(t + 0.5) for s, t in wanted.items()}
    routes = flow(patterns, quotas)
    kind = "pattern array<string>, use int, part int, to bigint, source string"
    cuts = spark.createDataFrame(
        [(list(p), u, k, t, s) for p, r in routes.items() for k, (u, t, s) in enumerate(stretches(patterns[p], r))], kind
    )

    # The hash of the last document before each cut: its range first, then inside that range.
    line = Window.partitionBy("pattern").orderBy("range")
    ends = ranges.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    # A document belongs before the cut if its middle lies there, so its range begins before it.
    hit = (
        ends.join(F.broadcast(cuts), "pattern")
        .where((F.col("begin") < F.col("to")) & (F.col("end") >= F.col("to")))
        .select("pattern", "use", "part", "to", "source", "range", "begin")
    )
    inside = keyed.withColumn("range", F.substring("place", 1, DIGITS)).join(
        hit.select("pattern", "range", "begin").distinct(), ["pattern", "range"]
    )
    order = Window.partitionBy("pattern", "range").orderBy("place")
    middles = inside.withColumn("twice", 2 * (F.col("begin") + F.sum("size").over(order)) - F.col("size")).select(
        "pattern", "range", "place", "twice"
    )
    cutoffs = (
        hit.join(middles, ["pattern", "range"], "left")
        .groupBy("pattern", "use", "part", "source", "range")
        # Without any document before the cut inside the range, the range itself is the border.
        .agg(F.max(F.when(F.col("twice") < 2 * F.col("to"), F.col("place"))).alias("last"))
        .withColumn("last", F.coalesce("last", "range"))
    )
    # Every stretch begins where the one before it in the same use ends.
    before = Window.partitionBy("pattern", "use").orderBy("part")
    plan = (
        cutoffs.withColumn("after", F.coalesce(F.lag("last").over(before), F.lit("")))
        .groupBy("pattern")
        .agg(F.sort_array(F.collect_list(F.struct("use", "part", "after", "last", "source"))).alias("cuts"))
    )
    as_map = lambda d, kind: F.from_json(F.lit(_json(d)), f"map<string,{kind}>")
    plan = settle(plan)
    taking = F.filter("cuts", lambda c: (F.col("place") > c["after"]) & (F.col("place") <= c["last"]))
    # At most MAX_PATTERNS rows.
    out = rows.join(F.broadcast(plan), "pattern", "left").withColumn(
        "uses", F.coalesce(F.transform(taking, lambda c: c["source"]), F.array().cast("array<string>"))
    )
    drop(keyed)
    return out.drop("place", "cuts").withColumns(
        {"source_sizes": as_map(sizes, "bigint"), "targets": as_map(wanted, "double")}
    )


def _json(by_source: dict) -> str:
    import json

    return json.dumps({NULL_KEY if s is None else s: v for s, v in by_source.items()})


def beside(docs: DataFrame, own: list[str]) -> list[Column]:
    """The columns of ``docs`` out of the struct doc; a name in ``own`` gets underscores at its end until it is free."""
    used = {c.lower() for c in [*own, *docs.columns]}
    out = []
    for c in docs.columns:
        name = c
        if c.lower() in {o.lower() for o in own}:
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
        out.append(F.col("doc")[c].alias(name))
    return out


def mix(docs: DataFrame, sources: str = "sources", size: str = "size", seed: str = SEED) -> DataFrame:
    """``docs`` with pattern, uses: array of the sources that take the document, one entry per use.

    ``docs`` needs doc_id, text, an array of sources and a size. Also given per row:
    source_sizes and targets, maps by source with null as ``NULL_KEY``.
    """
    own = ["pattern", "uses", "source_sizes", "targets"]
    return routed(docs, F.col(sources), F.col(size), seed).select(*beside(docs, own), *own)


def of_source(docs: DataFrame) -> DataFrame:
    """Documents of one source each, mixed: ``docs`` with size, source_size, target and taken."""
    key = F.coalesce("doc.source", F.lit(NULL_KEY))
    return routed(docs, F.array("source"), word_count()).select(
        *beside(docs, ["size", "source_size", "target", "taken"]),
        "size",
        F.element_at("source_sizes", key).alias("source_size"),
        F.element_at("targets", key).alias("target"),
        (F.col("size") * F.size("uses")).alias("taken"),
    )


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each document once per use, in the columns of ``docs``."""
    return routed(docs, F.array("source"), word_count()).select("doc", F.explode("uses")).select("doc.*")
