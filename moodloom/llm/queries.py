"""Registered queries of the pipeline operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodloom.llm import (
    bidiagonal,
    crosspolytope,
    hyperminhash,
    langid,
    mixing,
    prefixtrie,
    records,
    repetition,
    snapshots,
    spans,
    suffixes,
    viterbi,
    wumanber,
)
from moodloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Words as in the contracts: everything but the six ASCII white-space characters.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(
    "op1_suffix_dedup",
    """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, unnest(range(0, octet_length(b) - 199)) AS p FROM d WHERE octet_length(b) >= 200),
g AS (SELECT s.r, p, md5(b[p + 1:p + 200]) AS h FROM s JOIN d USING (r)),
hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
edge AS (SELECT *, CASE WHEN p <= lag(p) OVER w + 200 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW w AS (PARTITION BY r ORDER BY p)),
run AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS k FROM edge),
cut AS (SELECT r, k, min(p) AS lo, max(p) + 200 AS hi FROM run GROUP BY r, k),
part AS (
  SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS a, lo AS z FROM cut
  UNION ALL SELECT d.r, coalesce(max(hi), 0), max(octet_length(b)) FROM d LEFT JOIN cut USING (r) GROUP BY d.r),
kept AS (
  SELECT r, unhex(string_agg(substr(hex(b), 2 * a + 1, 2 * (z - a)), '' ORDER BY a)) AS k FROM part JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(hi - lo) AS gone, count(*) AS k FROM cut GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed,
  coalesce(n.k, 0)::BIGINT AS n_spans, sha256(kept.k) AS kept_sha256
FROM d LEFT JOIN n USING (r) JOIN kept USING (r)
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document without the 200-byte strings that start twice."""
    return suffixes.dedup(read(spark, sf_dir, "documents")).drop("kept")


_SENTENCES = "regexp_extract_all(coalesce(text, ''), '" + spans.SENTENCE.replace("$", r"\z") + "')"


@query(
    "op2_sentence_spans",
    f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, {_SENTENCES} AS s FROM d),
t AS (SELECT doc_id, text, s, list_transform(s, lambda x: lower(trim(translate(x, chr(9) || chr(10) || chr(12) || chr(13), '    ')))) AS q FROM p),
i AS (SELECT *, unnest(range(0, len(s) - {spans.SPAN - 1})) AS pos FROM t WHERE len(s) >= {spans.SPAN}),
h AS (SELECT doc_id, text, q, pos, md5(array_to_string(list_transform(q[pos + 1:pos + {spans.SPAN}], lambda x: md5(x)), '')) AS k FROM i),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM h),
m AS (SELECT DISTINCT doc_id, text, place, length(q[place + 1]) AS n FROM (
  SELECT doc_id, text, q, unnest(range(pos, pos + {spans.SPAN})) AS place FROM o WHERE nth > 1)),
g AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, text ORDER BY place) AS run FROM m),
l AS (SELECT doc_id, text, run FROM g GROUP BY doc_id, text, run HAVING sum(n) + count(*) - 1 >= {spans.MIN_CHARS}),
c AS (SELECT g.doc_id, g.text, list(place) AS gone FROM g JOIN l ON l.doc_id = g.doc_id AND l.text = g.text AND l.run = g.run GROUP BY g.doc_id, g.text)
SELECT documents.doc_id, len(s)::BIGINT AS n_sentences, coalesce(len(gone), 0)::BIGINT AS n_removed,
  array_to_string(list_transform(list_filter(range(0, len(s)), lambda k: NOT list_contains(coalesce(gone, []), k)), lambda k: s[k + 1]), '') AS text
FROM documents JOIN p ON p.doc_id = documents.doc_id AND p.text = coalesce(documents.text, '')
LEFT JOIN c ON c.doc_id = p.doc_id AND c.text = p.text
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without sentences that a later occurrence of a span covers."""
    return spans.dedup(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_sentences", "n_removed", F.col("clean").alias("text")
    )


@query(
    "op3_source_mix",
    r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT source, n, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, k FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, k) AS i FROM w),
c AS (SELECT *, 15e-1 * (SELECT sum(n) FROM w) AS total,
  coalesce(sum(2 * n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
  sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT *, (total - capped) * w / level <= 2 * n AS fits FROM c),
b AS (SELECT min(i) AS first FROM f WHERE fits),
z AS (SELECT total, capped, level, i FROM f),
t AS (SELECT o.source, o.n, CASE WHEN o.i >= b.first THEN (z.total - z.capped) * o.w / z.level ELSE (2 * o.n)::DOUBLE END AS target
  FROM o, b LEFT JOIN z ON z.i = b.first),
q AS (SELECT *, floor(target + 5e-1)::BIGINT AS quota FROM t),
l AS (SELECT source, place, size, sum(size) OVER (PARTITION BY source ORDER BY place) AS upto FROM
  (SELECT source, place, sum(size) AS size FROM d GROUP BY source, place)),
u AS (SELECT l.source, l.place,
  CASE WHEN q.n = 0 THEN 0 ELSE q.quota // q.n + (2 * l.upto - l.size < 2 * (q.quota % q.n))::INT END AS uses, q.n, q.target
  FROM l JOIN q ON q.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, n AS source_size, target, (size * uses)::BIGINT AS taken
FROM d JOIN u ON u.source IS NOT DISTINCT FROM d.source AND u.place = d.place
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.of_source(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(read(spark, sf_dir, "documents"))


def _windows(n: int) -> str:
    """SQL: how many words of each text lie in an n-word window that occurs twice."""
    return f"""
  SELECT r, count(DISTINCT spot) AS n FROM (
    SELECT r, unnest(range(p, p + {n})) AS spot FROM (
      SELECT r, p, count(*) OVER (PARTITION BY r, md5(array_to_string(w[p:p + {n - 1}], ' '))) AS k
      FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS p FROM d WHERE len(w) >= {n})) WHERE k > 1) GROUP BY r"""


@query(
    "op5_repetition_rules",
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
base AS ({_windows(repetition.WINDOW)}),
cover AS ({_windows(repetition.MIN_WORDS)}),
long AS ({_windows(repetition.MAX_LONGEST + 1)}),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM d),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines,
    coalesce(base.n, 0)::BIGINT AS n_repeat_words, coalesce(cover.n, 0)::BIGINT AS n_covered, long.n IS NOT NULL AS too_long
  FROM d JOIN lines USING (r) LEFT JOIN base USING (r) LEFT JOIN cover USING (r) LEFT JOIN long USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {repetition.MIN_TOTAL} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {repetition.MIN_TOTAL} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words)
    AND n_covered <= {repetition.MAX_COVERED}::DOUBLE * n_words AND NOT too_long AS kept,
  n_covered
FROM m
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and verdict of every document."""
    return repetition.rules(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_covered",
    )


_COMPONENTS = """
walk AS (SELECT DISTINCT a, a AS b FROM link UNION SELECT walk.a, link.b FROM walk JOIN link ON link.a = walk.b),
comp AS (SELECT a, min(b) AS c FROM walk GROUP BY a)"""


@query(
    "op6_hyperminhash",
    rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT r, md5(array_to_string(w[p:p + 4], ' ')) AS s FROM (
    SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
one AS (SELECT r, n, md5(k) AS node FROM (SELECT r, string_agg(s, '' ORDER BY s) AS k FROM sh GROUP BY r) JOIN n USING (r)),
rep AS (SELECT node, min(r) AS r, min(n) AS n FROM one GROUP BY node),
pair AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.r < y.r
  WHERE x.r IN (SELECT r FROM rep) AND y.r IN (SELECT r FROM rep) GROUP BY x.r, y.r),
half AS (SELECT p.a, p.b FROM pair p JOIN rep x ON x.r = p.a JOIN rep y ON y.r = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
same AS (SELECT one.r AS a, rep.r AS b FROM one JOIN rep USING (node) WHERE one.r <> rep.r),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half UNION ALL SELECT a, b FROM same UNION ALL SELECT b, a FROM same),
walk AS (SELECT DISTINCT a, a AS b FROM link UNION SELECT walk.a, link.b FROM walk JOIN link ON link.a = walk.b),
comp AS (SELECT walk.a, min(d.doc_id) AS c FROM walk JOIN d ON d.r = walk.b GROUP BY walk.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN comp ON comp.a = d.r
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return hyperminhash.near_duplicates(read(spark, sf_dir, "documents"))


@query(
    "op7_chat_snapshots",
    f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER w AS place,
  md5(string_agg(md5(role) || md5(text), '') OVER w) AS h
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
z AS (SELECT conv_id, max(place) AS n FROM p GROUP BY conv_id),
whole AS (SELECT min(p.conv_id) AS conv_id, place AS n, h FROM p JOIN z ON z.conv_id IS NOT DISTINCT FROM p.conv_id AND z.n = p.place GROUP BY place, h),
inner_ AS (SELECT DISTINCT place, h FROM p JOIN z ON z.conv_id IS NOT DISTINCT FROM p.conv_id AND p.place < z.n),
stay AS (SELECT conv_id, n FROM whole WHERE NOT EXISTS (SELECT 1 FROM inner_ WHERE inner_.place = whole.n AND inner_.h = whole.h))
SELECT p.conv_id, ((place - 1) // {snapshots.PART})::BIGINT AS part, n::BIGINT AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM p JOIN stay ON stay.conv_id IS NOT DISTINCT FROM p.conv_id GROUP BY p.conv_id, (place - 1) // {snapshots.PART}, n
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return snapshots.render(read(spark, sf_dir, "conversations"))


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to it."""
    return viterbi.encode(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pieces.*")


@query("op9_token_records")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token records of every document, written and read back."""
    folder = records.folder_for(spark)
    return records.read_back(records.write(read(spark, sf_dir, "documents"), folder), folder)


@query(
    "op10_cross_polytope",
    f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
half AS (SELECT x.r AS a, y.r AS b FROM v x JOIN v y ON x.r < y.r AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= {crosspolytope.COSINE}),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),{_COMPONENTS},
named AS (SELECT comp.a, v.vec_id AS c FROM comp JOIN v ON v.r = comp.c)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN named ON named.a = v.r
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return crosspolytope.near_duplicates(read(spark, sf_dir, "embeddings"))


# Unsigned CRC-32 of the ASCII text of a number, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query(
    "op11_prefix_trie",
    rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS k, id, words FROM (
  SELECT conv_id, turn, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
h AS (SELECT c, c - c % {prefixtrie.GROUP} AS base, {_CRC32} % {prefixtrie.HEADS} AS h FROM n),
g AS (SELECT h.*, least(h, coalesce(b.n, 0)) AS taken FROM h LEFT JOIN n b ON b.c = h.base),
r AS (
  SELECT g.c, k AS d, id, words FROM g JOIN t ON t.c = base WHERE k <= h
  UNION ALL SELECT g.c, taken + k - h, id, words FROM g JOIN t ON t.c = g.c WHERE k > h),
p AS (
  SELECT c, d, md5(string_agg(id, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS key, words FROM r
  UNION ALL SELECT c, 0, '', 0 FROM n),
z AS (SELECT c, max(d) AS d FROM p GROUP BY c),
q AS (SELECT p.*, lag(key) OVER (PARTITION BY c ORDER BY d) AS above FROM p),
node AS (SELECT key, d, min(above) AS above, min(c) AS c, count(*) AS n, max(words) AS words FROM q GROUP BY key, d),
kids AS (SELECT above AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY above),
ends AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM p JOIN z USING (c, d) GROUP BY key),
sub AS (SELECT DISTINCT a.key, b.key AS low FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT sub.key, sum((low.n - 1) * low.words)::BIGINT AS saved, count(*) FILTER (WHERE kids.key IS NULL) AS leaves
  FROM sub JOIN node low ON low.key = sub.low LEFT JOIN kids ON kids.key = sub.low GROUP BY sub.key)
SELECT node.c AS conv_id, node.d::BIGINT AS depth, up.c AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN sums ON sums.key = node.key LEFT JOIN node up ON up.key = node.above AND node.d > 0
LEFT JOIN kids ON kids.key = node.key LEFT JOIN ends ON ends.key = node.key
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefixtrie.trie(prefixtrie.rebuilt(read(spark, sf_dir, "conversations")))


@query("op12_lanczos_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return bidiagonal.whiten(read(spark, sf_dir, "embeddings"))


_ITEM_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op13_wu_manber",
    f"""
WITH b AS (SELECT DISTINCT item_id, {_ITEM_WORDS} AS w FROM benchmark),
p AS (SELECT item_id, w, least(len(w), {wumanber.WORDS}) AS n, unnest(range(1, greatest(len(w) - {wumanber.WORDS - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM p),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
g AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n),
h AS (SELECT r, i, s.n, item_id FROM g JOIN s ON s.n = g.n AND s.k = array_to_string(w[i:i + g.n - 1], ' ')),
hit AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in test strings of the benchmark."""
    return wumanber.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
