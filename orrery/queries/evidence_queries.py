"""Queries of evidence: runs of sources, scenes and tiles of candidates, look-alikes, discovery by reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import evidence, gazetteer, raster
from orrery.queries.base import query, table


@query("""WITH r AS (SELECT user_id AS source_id, event_id AS run, floor(epoch(ts))::BIGINT AS started_at, floor(epoch(ts))::BIGINT + 10 AS finished_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'failed' WHEN 'signup' THEN 'offline-snapshot' ELSE 'success' END AS status, CASE WHEN event_type = 'error' THEN 60 + event_id % 7 END AS retry, event_type AS error FROM events),
o AS (SELECT *, max(CASE WHEN status = 'success' THEN run END) OVER (PARTITION BY source_id) AS won, row_number() OVER (PARTITION BY source_id ORDER BY run DESC) AS back FROM r)
SELECT source_id, count(*) FILTER (status = 'failed' AND (won IS NULL OR run > won)) AS consecutive_failures, max(started_at) FILTER (status = 'success') AS last_success, max(started_at) FILTER (status = 'failed') AS last_failure,
  max(error) FILTER (back = 1 AND status = 'failed') AS last_error, max(CASE WHEN status = 'success' THEN 'ok' WHEN status <> 'failed' THEN status WHEN retry IS NOT NULL THEN 'rate-limited' ELSE 'failed' END) FILTER (back = 1) AS health,
  arg_max(finished_at + retry, run) FILTER (retry IS NOT NULL AND (won IS NULL OR run > won)) AS next_allowed_at FROM o GROUP BY source_id""")
def ledger_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures since the last success of each source, and when it may be asked again."""
    kind = F.col("event_type")
    status = F.when(kind.isin("error", "click"), "failed").when(kind == "signup", "offline-snapshot").otherwise("success")
    at = F.unix_timestamp(F.date_trunc("second", "ts"))
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("run"), at.alias("started_at"), (at + 10).alias("finished_at"), status.alias("status"), kind.alias("error"), F.when(kind == "error", 60 + F.col("event_id") % 7).alias("retry_after_s"))
    return evidence.run_ledger(runs)


@query("""WITH s AS (SELECT l_orderkey AS cand, l_orderkey || '-' || l_linenumber AS id, strftime(l_shipdate, '%Y-%m-%d') || 'T05:00:00Z' AS acquired_at FROM lineitem WHERE l_linenumber <> 3),
d AS (SELECT l_orderkey AS cand, strftime(min(l_shipdate), '%Y-%m-%d') AS before, strftime(max(l_shipdate), '%Y-%m-%d') AS after FROM lineitem GROUP BY ALL)
SELECT d.cand AS id, count(s.id) AS scenes, min(s.id ORDER BY s.acquired_at, s.id) FILTER (left(s.acquired_at, 10) = before) AS evidence_before, min(s.id) FILTER (left(s.acquired_at, 10) = after) AS evidence_after FROM d LEFT JOIN s USING (cand) GROUP BY d.cand""")
def scenes_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes behind each candidate, and the two that show the change; some ids are of unknown scenes."""
    lines = table(spark, sf_dir, "lineitem")
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    candidates = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(name).alias("supporting_scene_ids"), F.min(day).alias("last_clean_before"), F.max(day).alias("earliest_supported_after"))
    scenes = lines.where("l_linenumber <> 3").select(name.alias("id"), F.concat(day, F.lit("T05:00:00Z")).alias("acquired_at"))
    found = evidence.candidate_scenes(candidates, scenes)
    return found.select("id", F.when(F.col("scenes").isNull(), 0).otherwise(F.size("scenes")).cast("bigint").alias("scenes"), F.col("evidence_before.id").alias("evidence_before"), F.col("evidence_after.id").alias("evidence_after"))


@query("""SELECT DISTINCT l_partkey::VARCHAR AS tile_id, l_orderkey AS candidate_id FROM lineitem JOIN part ON p_partkey = l_partkey""")
def candidates_holding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that hold each tile."""
    candidates = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("tile_ids"))
    return evidence.candidates_of_tiles(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("tile_id")), candidates)


CHIPS_SQL = """c AS (SELECT vec_id AS id, 'a' || (vec_id % 2) AS aoi, 224 AS px, (vec_id * 7 % 20) * 56 AS r, (vec_id * 3 % 10) * 56 AS k, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT id, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM c WHERE id IN (1, 2, 11, 12)), m AS (SELECT i, avg(x) FILTER (id < 10) - 0.5 * avg(x) FILTER (id > 10) AS v FROM u GROUP BY i),
q AS (SELECT list(v ORDER BY i) AS v, sqrt(sum(v * v)) AS n FROM m),
w AS (SELECT c.*, (SELECT max(CASE WHEN x.aoi = c.aoi THEN greatest(0, least(c.r, x.r) + 224 - greatest(c.r, x.r)) * greatest(0, least(c.k, x.k) + 224 - greatest(c.k, x.k)) / (224.0 * 224) ELSE 0 END) FROM c AS x WHERE x.id IN (1, 2)) > 0.5 AS same_place FROM c),
s AS (SELECT w.*, list_inner_product(e, v) / n AS score FROM w, q WHERE id NOT IN (1, 2, 11, 12))"""


@query(f"""WITH {CHIPS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY aoi, r, k ORDER BY score DESC, id) AS best FROM s WHERE NOT same_place)
SELECT row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank, id, round(score, 4) AS score, same_place FROM p WHERE best = 1 ORDER BY p.score DESC, id LIMIT 20""")
def chips_like_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-alikes at other places, one date of each, by two examples and two that are not meant."""
    return evidence.similar_chips(_chips(spark, sf_dir), [1, 2], [11, 12]).select("rank", "id", F.round("score", 4).alias("score"), "same_place")


@query(f"""WITH {CHIPS_SQL} SELECT row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank, id, round(score, 4) AS score, same_place FROM s WHERE same_place ORDER BY s.score DESC, id LIMIT 20""")
def chips_at_the_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates of the examples' own places."""
    return evidence.similar_chips(_chips(spark, sf_dir), [1, 2], [11, 12], "same-place").select("rank", "id", F.round("score", 4).alias("score"), "same_place")


def _chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(k.alias("id"), F.concat(F.lit("a"), (k % 2).cast("string")).alias("aoi_id"), F.lit(224).alias("chip_px"), (k * 7 % 20 * 56).cast("int").alias("row_off"), (k * 3 % 10 * 56).cast("int").alias("col_off"), F.lit("2024-01-01").alias("acquired_at"), "embedding")


@query("""WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT label, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM e), m AS (SELECT label, i, avg(x) AS v FROM u GROUP BY ALL),
c AS (SELECT label AS cluster, list(v ORDER BY i) AS c FROM m GROUP BY label), n AS (SELECT id, arg_max(cluster, (round(list_inner_product(e, c), 12), -cluster)) AS nearest FROM e, c GROUP BY id)
SELECT id AS reference, CASE WHEN id % 3 = 0 THEN label ELSE nearest END::INTEGER AS cluster, CASE id % 3 WHEN 0 THEN 'member' WHEN 1 THEN 'nearest cluster (unassigned chip)' ELSE 'nearest cluster (chip newer than this version)' END AS membership FROM e JOIN n USING (id)""")
def clusters_of_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each chip taken as a reference: its own, or the nearest one."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(64).alias("family"), F.col("label").cast("int").alias("label"), "embedding")
    means = evidence.vector.element_means(e, ["family", "label"], "embedding").select("family", F.col("label").alias("cluster"), F.col("mean").alias("centroid"))
    members = e.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, F.col("label")).alias("cluster"))
    return evidence.discovered_by_reference(e.select("id", "family", "embedding"), members, means).select("reference", "cluster", "membership")


@query("""WITH p AS (SELECT p_partkey AS place_id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, p_name AS name, p_size AS population, p_partkey % 3 AS kind FROM part),
q AS (SELECT place_id AS question_id, substr(key, (1 + place_id % 5)::INTEGER, (1 + place_id % 6)::INTEGER) AS asked FROM p),
h AS (SELECT question_id, place_id, CASE WHEN key = asked THEN 0 WHEN starts_with(key, asked) THEN 1 ELSE 2 END AS fit, kind, population, name FROM q JOIN p ON contains(key, asked) WHERE asked <> '')
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY fit, kind, population DESC, name, place_id)::INTEGER AS rank, place_id, fit FROM h QUALIFY rank <= 10""")
def names_by_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every name: a part of it, looked up in an index of letter groups; the ten first."""
    k = F.col("p_partkey")
    places = table(spark, sf_dir, "part").select(k.alias("place_id"), text.fold_ascii(F.col("p_name")).alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("population"), F.element_at(F.array(*map(F.lit, gazetteer.KIND_ORDER)), (k % 3 + 1).cast("int")).alias("kind"))
    questions = places.select(F.col("place_id").alias("question_id"), F.substr("key", (1 + F.col("place_id") % 5).cast("int"), (1 + F.col("place_id") % 6).cast("int")).alias("key"))
    return gazetteer.found(questions, places, gazetteer.postings(places))


@query("""WITH RECURSIVE p AS (SELECT p_partkey % 5 AS run, p_partkey // 5 // 20 AS r, p_partkey // 5 % 20 AS c, (p_partkey * 7919 % 101) / 120.0::DOUBLE AS s FROM part),
f AS (SELECT run, r, c, s, r * 20 + c AS n FROM p WHERE s > 0.5),
e AS (SELECT a.run, a.n AS a, b.n AS b FROM f AS a JOIN f AS b ON a.run = b.run AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
reach(run, a, b) AS (SELECT run, a, b FROM e UNION SELECT x.run, x.a, e.b FROM reach AS x JOIN e ON e.run = x.run AND e.a = x.b),
root AS (SELECT run, a AS n, min(b) AS root FROM reach GROUP BY ALL),
g AS (SELECT f.*, dense_rank() OVER (PARTITION BY run ORDER BY root) AS region FROM f JOIN root USING (run, n))
SELECT run::VARCHAR AS run_id, region::INTEGER AS region, count(*)::INTEGER AS pixels, round(avg(s), 6) AS mean_score, min(r)::INTEGER AS row0, min(c)::INTEGER AS col0, max(r)::INTEGER AS row1, max(c)::INTEGER AS col1, count(*) < 25 AS small FROM g GROUP BY run, region HAVING count(*) >= 9""")
def regions_of_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of change over pixels, labelled block by block; five runs."""
    k = F.col("p_partkey")
    at = F.expr("p_partkey div 5")
    pixels = table(spark, sf_dir, "part").select((k % 5).cast("string").alias("run_id"), F.expr("cast(p_partkey div 5 div 20 as int)").alias("row"), (at % 20).cast("int").alias("col"), ((k * 7919 % 101) / 120.0).alias("score"))
    found = raster.regions_of(raster.region_pixels(pixels, 16))
    return found.select("run_id", "region", "pixels", F.round("mean_score", 6).alias("mean_score"), "row0", "col0", "row1", "col1", "small")
