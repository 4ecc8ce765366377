"""Common table expressions of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

import re

from moodloom.operators.analysis import NO_AUDIO_CLUSTER, NO_DATA
from moodloom.schema import EXPLAINED, FEATURES

TOKEN = r"[\p{L}\p{N}_](?:[^\t-\r\x1c-\x20\x{85}\p{Z}]*[\p{L}\p{N}_])?"

CTE: dict[str, str] = {}

CTE["tracks"] = """
 SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist, p_type AS album_name,
   CAST(p_size * 1000 AS INT) AS duration_ms, p_size,
   p_partkey % 10 <> 3 AS has_af, p_partkey % 7 <> 2 AS has_tags,
   (p_partkey % 10 <> 3) OR (p_partkey % 7 <> 2) AS eligible,
   CASE WHEN p_size % 5 > 0 THEN 'rb' || p_partkey END AS reccobeats_id,
   CASE WHEN p_size % 7 > 0 THEN CAST(p_size AS INT) END AS popularity,
   CASE WHEN p_partkey % 10 <> 3 THEN 1e-2*((p_partkey*19)%101) END AS acousticness,
   CASE WHEN p_partkey % 10 <> 3 THEN 1e-2*((p_partkey*71)%101) END AS danceability,
   CASE WHEN p_partkey % 10 <> 3 THEN 25e-2*(p_partkey%4) + 24e-4*((p_partkey*37)%101) END AS energy,
   CASE WHEN p_partkey % 10 <> 3 THEN 1e-2*((p_partkey*11)%101) END AS instrumentalness,
   CASE WHEN p_partkey % 10 <> 3 THEN 1e-2*((p_partkey*7)%101) END AS liveness,
   CASE WHEN p_partkey % 10 <> 3 THEN -20e0 + 4e0*(p_partkey%4) + 4e-2*((p_partkey*17)%101) END AS loudness,
   CASE WHEN p_partkey % 10 <> 3 AND p_size % 13 <> 0 THEN 1e-2*((p_partkey*3)%101) END AS speechiness,
   CASE WHEN p_partkey % 10 <> 3 THEN 60e0 + 35e0*((p_partkey%4+2)%4) + 3e-1*((p_partkey*29)%101) END AS tempo,
   CASE WHEN p_partkey % 10 <> 3 THEN 25e-2*(((p_partkey%4)*3+1)%4) + 24e-4*((p_partkey*53)%101) END AS valence
 FROM part"""

CTE["tags"] = """
 SELECT p_partkey AS track_id, 1 AS ord, p_name AS name, CAST((p_partkey*13)%101 AS INT) AS cnt
 FROM part WHERE p_partkey % 7 <> 2
 UNION ALL
 SELECT p_partkey, 2, lower(p_type), CAST(10*((p_partkey*7)%11) AS INT) FROM part WHERE p_partkey % 7 <> 2"""

CTE["playlists"] = """
 SELECT s_suppkey AS playlist_id, s_name AS name, 'user' || s_nationkey AS owner,
   'snap' || CAST(floor(s_acctbal) AS BIGINT) AS snapshot_id FROM supplier"""

CTE["raw_items"] = """
 SELECT l_suppkey AS playlist_id, l_partkey AS track_id, l_orderkey * 16 + l_linenumber AS pos,
   l_shipdate AS added_at FROM lineitem"""

CTE["items"] = """
 SELECT playlist_id, track_id, pos, added_at FROM raw_items
 QUALIFY row_number() OVER (PARTITION BY playlist_id, track_id ORDER BY pos, added_at) = 1"""

CTE["lib"] = "SELECT * FROM items JOIN tracks USING (track_id)"

CTE["elig"] = "SELECT * FROM lib WHERE eligible"

CTE["npl"] = "SELECT playlist_id, count(*) AS n FROM elig GROUP BY 1"

CTE["tf"] = f"""
 SELECT track_id, term, CAST(sum(reps) AS BIGINT) AS tf FROM (
   SELECT track_id, unnest(regexp_extract_all(lower(name), '{TOKEN}')) AS term,
     greatest(least(round_even(cnt / 20e0, 0), 5), 1) AS reps FROM tags) GROUP BY ALL"""

CTE["lterms"] = "SELECT playlist_id, track_id, term, tf FROM elig JOIN tf USING (track_id)"

CTE["vocab"] = """
 SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY term) AS idx FROM (
   SELECT playlist_id, term, CAST(sum(tf) AS BIGINT) AS freq, count(*) AS df,
     row_number() OVER (PARTITION BY playlist_id ORDER BY sum(tf) DESC, term) AS rn
   FROM lterms GROUP BY playlist_id, term) WHERE rn <= 200"""

CTE["tfidf"] = """
 SELECT playlist_id, track_id, idx, term, w / sqrt(sum(w*w) OVER (PARTITION BY playlist_id, track_id)) AS w
 FROM (SELECT playlist_id, track_id, idx, term, tf * (ln((1e0+n)/(1e0+df)) + 1) AS w
       FROM lterms JOIN vocab USING (playlist_id, term) JOIN npl USING (playlist_id))"""

CTE["af_long"] = "\n UNION ALL\n".join(
    f" SELECT playlist_id, track_id, {j} AS j, '{f}' AS feature, {f} AS x FROM elig"
    for j, f in enumerate(FEATURES)
)

CTE["af_stats"] = """
 SELECT playlist_id, j, avg(x) AS m, stddev_pop(x) AS sd, count(x) AS c FROM af_long GROUP BY 1, 2"""

CTE["audio"] = """
 SELECT playlist_id, track_id, j, feature,
   CASE WHEN c < 2 OR sd = 0 OR x IS NULL THEN 0e0 ELSE (x - m) / sd END AS z
 FROM af_long JOIN af_stats USING (playlist_id, j)"""

CTE["dense"] = """
 SELECT playlist_id, track_id, j, CASE WHEN len > 0 THEN v / len ELSE 0e0 END AS v FROM (
   SELECT *, sqrt(sum(v*v) OVER (PARTITION BY playlist_id, track_id)) AS len FROM (
     SELECT playlist_id, track_id, j, z AS v FROM audio
     UNION ALL
     SELECT e.playlist_id, e.track_id, 8 + v.idx, coalesce(t.w, 0e0)
     FROM elig e JOIN vocab v ON e.playlist_id = v.playlist_id
     LEFT JOIN tfidf t ON t.playlist_id = e.playlist_id AND t.track_id = e.track_id AND t.idx = v.idx))"""

CTE["assign"] = """
 SELECT playlist_id, track_id, pos,
   CAST(CASE WHEN has_af THEN track_id % 4 + 4 * (p_size % 2) ELSE 8 END AS INT) AS cluster_id
 FROM elig"""

CTE["centers"] = """
 SELECT playlist_id, cluster_id, j, avg(v) AS c FROM dense JOIN assign USING (playlist_id, track_id)
 GROUP BY 1, 2, 3"""

CTE["dist"] = """
 SELECT playlist_id, track_id, pos, cluster_id, sqrt(sum((v-c)*(v-c))) AS distance
 FROM dense JOIN assign USING (playlist_id, track_id) JOIN centers USING (playlist_id, cluster_id, j)
 GROUP BY 1, 2, 3, 4"""

CTE["scored"] = """
 SELECT *, CASE WHEN mx > 0 THEN round(distance / mx, 12) ELSE 0e0 END AS anomaly_score FROM (
   SELECT *, max(distance) OVER (PARTITION BY playlist_id) AS mx,
     count(*) OVER (PARTITION BY playlist_id) AS n FROM dist)"""

CTE["flagged"] = """
 SELECT *, rn <= CASE WHEN n >= 5 THEN greatest(ceil(15e-2 * n), 1) ELSE least(ceil(15e-2 * n), 1) END AS flagged
 FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY anomaly_score DESC, pos, track_id) AS rn
       FROM scored)"""

_MEANS = ", ".join(f"avg({f}) AS {f}" for f in FEATURES)
_NULLS = " + ".join(f"CAST({f} IS NULL AS INT)" for f in FEATURES)

CTE["means"] = f"""
 SELECT *, {_NULLS} AS null_means FROM (
   SELECT playlist_id, cluster_id, count(*) AS size, min((pos, track_id)) AS first_row, {_MEANS}
   FROM assign JOIN (SELECT * EXCLUDE (pos) FROM elig) USING (playlist_id, track_id) GROUP BY 1, 2)"""

LABEL = """
   CASE WHEN energy >= 67e-2 THEN 'high_energy' WHEN energy <= 33e-2 THEN 'low_energy' ELSE 'medium_energy' END
   || '_' || CASE WHEN valence >= 6e-1 THEN 'happy' WHEN valence <= 4e-1 THEN 'sad' ELSE 'neutral' END
   || CASE WHEN tempo >= 130 THEN '_fast' WHEN tempo <= 90 THEN '_slow' ELSE '' END"""

CTE["clusters"] = f"""
 SELECT *, null_means <= 2 AS kept, CASE WHEN null_means <= 2 THEN {LABEL} END AS label FROM means"""

CTE["top_tags"] = """
 SELECT playlist_id, cluster_id, rank, term, weight FROM (
   SELECT *, row_number() OVER (PARTITION BY playlist_id, cluster_id ORDER BY round(weight, 9) DESC, term) AS rank
   FROM (SELECT playlist_id, cluster_id, term, sum(w) / any_value(size) AS weight
         FROM tfidf JOIN assign USING (playlist_id, track_id) JOIN means USING (playlist_id, cluster_id)
         GROUP BY 1, 2, 3) WHERE weight > 0) WHERE rank <= 8"""

CTE["dominant"] = """
 SELECT * FROM clusters
 QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY size DESC, first_row) = 1"""

_DELTA = "\n   UNION ALL ".join(
    f"SELECT f.playlist_id, f.track_id, {i} AS ord, '{f}' AS feature, round(e.{f} - d.{f}, 9) AS delta"
    " FROM flagged f JOIN clusters c USING (playlist_id, cluster_id)"
    " JOIN elig e ON e.playlist_id = f.playlist_id AND e.track_id = f.track_id"
    " JOIN dominant d ON d.playlist_id = f.playlist_id WHERE f.flagged AND c.kept AND e.has_af"
    for i, f in enumerate(EXPLAINED)
)

CTE["deltas"] = f"""
 SELECT * FROM (
   SELECT *, row_number() OVER (PARTITION BY playlist_id, track_id ORDER BY abs(delta) DESC, ord) AS rank
   FROM ({_DELTA}) WHERE delta IS NOT NULL) WHERE rank <= 3"""

CTE["sentences"] = """
 SELECT playlist_id, track_id, string_agg(
   CASE WHEN delta > 0 THEN 'higher ' ELSE 'lower ' END || feature || ' by ' ||
   CASE feature WHEN 'tempo' THEN format('{:.0f} BPM', abs(delta)) WHEN 'loudness' THEN format('{:.1f} dB', abs(delta))
     ELSE format('{:.2f}', abs(delta)) END, '; ' ORDER BY rank) AS facts FROM deltas GROUP BY 1, 2"""

CTE["rows"] = f"""
 SELECT l.playlist_id, l.track_id, l.pos, l.title, l.eligible, f.cluster_id AS assigned_cluster_id,
   CASE WHEN c.kept THEN f.cluster_id END AS cluster_id, CASE WHEN c.kept THEN c.label END AS label,
   CASE WHEN c.kept THEN f.anomaly_score END AS anomaly_score,
   coalesce(c.kept AND f.flagged, false) AS is_anomaly,
   CASE WHEN NOT l.eligible THEN '{NO_DATA}' WHEN NOT c.kept THEN '{NO_AUDIO_CLUSTER}'
     WHEN c.kept AND f.flagged THEN concat_ws('. ',
       CASE WHEN d.label IS NOT NULL THEN 'Anomalous vs dominant mood ''' || d.label || '''' ELSE 'Anomalous vs dominant mood' END,
       'distance_score=' || format('{{:.2f}}', f.anomaly_score),
       CASE WHEN s.facts IS NOT NULL THEN s.facts WHEN NOT l.has_af THEN
         'reason: limited audio features available (mostly tag-driven)' END)
     ELSE '' END AS reason
 FROM lib l LEFT JOIN flagged f ON f.playlist_id = l.playlist_id AND f.track_id = l.track_id
 LEFT JOIN clusters c ON c.playlist_id = f.playlist_id AND c.cluster_id = f.cluster_id
 LEFT JOIN dominant d ON d.playlist_id = l.playlist_id
 LEFT JOIN sentences s ON s.playlist_id = l.playlist_id AND s.track_id = l.track_id"""

CTE["moods"] = """
 SELECT *, size / CAST(sum(size) OVER (PARTITION BY playlist_id) AS DOUBLE) AS proportion,
   row_number() OVER (PARTITION BY playlist_id ORDER BY size DESC, first_cluster) AS rank
 FROM (SELECT playlist_id, label AS mood_label, CAST(sum(size) AS BIGINT) AS size, min(cluster_id) AS first_cluster
       FROM clusters WHERE kept GROUP BY 1, 2)"""

CTE["summary"] = """
 SELECT p.playlist_id, p.name, coalesce(r.num_tracks, 0) AS num_tracks, coalesce(num_eligible, 0) AS num_eligible,
   coalesce(num_excluded_missing_all, 0) AS num_excluded_missing_all,
   coalesce(num_excluded_insufficient_audio_cluster, 0) AS num_excluded_insufficient_audio_cluster,
   coalesce(num_clusters, 0) AS num_clusters, coalesce(num_anomalies, 0) AS num_anomalies, anomaly_score_cutoff
 FROM playlists p LEFT JOIN (
   SELECT playlist_id, count(*) AS num_tracks, count(*) FILTER (eligible) AS num_eligible,
     count(*) FILTER (NOT eligible) AS num_excluded_missing_all,
     count(*) FILTER (eligible AND cluster_id IS NULL) AS num_excluded_insufficient_audio_cluster,
     count(*) FILTER (is_anomaly) AS num_anomalies FROM rows GROUP BY 1) r USING (playlist_id)
 LEFT JOIN (SELECT playlist_id, count(*) AS num_clusters FROM clusters WHERE kept GROUP BY 1) USING (playlist_id)
 LEFT JOIN (SELECT playlist_id, min(anomaly_score) AS anomaly_score_cutoff FROM flagged WHERE flagged GROUP BY 1)
   USING (playlist_id)"""


def _needs(sql: str) -> list[str]:
    return [n for n in CTE if re.search(rf"\b{n}\b", sql)]


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` behind the expressions it uses, in dependency order."""
    extra = extra or {}
    order: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in [*_needs(text), *[n for n in extra if re.search(rf"\b{n}\b", text)]]:
            if name != own and name not in order:
                visit(extra.get(name) or CTE[name], name)
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    texts = {n: extra.get(n) or CTE[n] for n in order}
    body = ",\n".join(f"{n} AS MATERIALIZED ({t})" for n, t in texts.items())
    again = any(re.search(rf"\b{n}\b", t) for n, t in texts.items() if n in extra)
    return f"WITH {'RECURSIVE ' if again else ''}{body}\n{sql}"
