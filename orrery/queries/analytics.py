"""Change detection, vectors, clusters, governance and metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import rules, vector
from orrery.operators import change, clusters, evaluation, governance, vectors
from orrery.queries.base import query, table


@query()
def seed_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of many areas grouped from seeds over their neighbours; the order of seeds decides, which SQL has no word for."""
    k = F.col("o_orderkey")
    aoi = F.concat(F.lit("a"), F.expr("cast(o_orderkey div 4000 as string)"))
    tiles = table(spark, sf_dir, "orders").select(aoi.alias("aoi"), (k * 31 % 61).cast("int").alias("row"), (k * 17 % 53).cast("int").alias("col"), F.lit("open").alias("from_class"), F.when(k % 5 < 4, "water").otherwise("vegetation").alias("to_class"), F.year("o_orderdate").alias("year"))
    tiles = tiles.groupBy("aoi", "row", "col").agg(F.first("from_class").alias("from_class"), F.max("to_class").alias("to_class"), F.max("year").alias("year"))
    return change.grouped(tiles.withColumn("tile_id", F.concat_ws(":", "aoi", "row", "col")))


@query("SELECT user_id, round(arg_min(value, (ts, event_id)), 6) AS first_value, round(arg_max(value, (ts, event_id)), 6) AS last_value, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS delta FROM events WHERE value IS NOT NULL GROUP BY user_id")
def first_last_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last value of each user and their difference."""
    e = table(spark, sf_dir, "events").where("value is not null").withColumn("at", F.struct("ts", "event_id"))
    return change.first_last(e, "user_id", "at", "value").select("user_id", *[F.round(c, 6).alias(c) for c in ("first_value", "last_value", "delta")])


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding]


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7)
SELECT vec_id AS id, label, round(list_inner_product(embedding::DOUBLE[], v), 4) AS score FROM embeddings, q WHERE vec_id <> 7 ORDER BY list_inner_product(embedding::DOUBLE[], v) DESC, vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 20 by cosine; vectors are of unit length."""
    e = table(spark, sf_dir, "embeddings").where("vec_id <> 7").withColumnRenamed("vec_id", "id")
    return vectors.top_k(e, _vector(spark, sf_dir, 7), 20).select("id", "label", F.round("score", 4).alias("score"))


@query("""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
m AS (SELECT i, avg(x) FILTER (WHERE vec_id IN (1, 2, 3)) - 0.5 * avg(x) FILTER (WHERE vec_id IN (10, 11)) AS v FROM u GROUP BY i), q AS (SELECT list(v ORDER BY i) AS v FROM m),
s AS (SELECT vec_id AS id, list_inner_product(embedding::DOUBLE[], v) / sqrt(list_inner_product(v, v)) AS s FROM embeddings, q WHERE vec_id NOT IN (1, 2, 3, 10, 11))
SELECT id, round(s, 4) AS score FROM s ORDER BY s DESC, id LIMIT 20""")
def vector_rocchio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like some examples, unlike others."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vector.doubles(F.col("embedding")).alias("embedding"))
    q = vectors.example_query(e, F.col("id").isin(1, 2, 3), F.col("id").isin(10, 11))
    return vectors.top_k(e.where(~F.col("id").isin(1, 2, 3, 10, 11)), q, 20).select("id", F.round("score", 4).alias("score"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id AS id, label, list_inner_product(embedding::DOUBLE[], v) AS s FROM embeddings, q)
SELECT id, label, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, id) AS r FROM s) WHERE r = 1""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", vector.dot(vector.doubles(F.col("embedding")), vector.literal(_vector(spark, sf_dir, 7))).alias("score"))
    return vectors.best_per_place(e, ["label"]).select("id", "label", F.round("score", 4).alias("score"))


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), vector.doubles(F.col("embedding")).alias("embedding"))
    return vector.element_means(e, ["cluster"], "embedding").select(F.lit(64).alias("family"), "cluster", vector.unit(F.col("mean")).alias("centroid"))


CENTROIDS_SQL = """u AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS v FROM u GROUP BY ALL),
c0 AS (SELECT label AS cluster, list(v ORDER BY i) AS v FROM m GROUP BY label), c AS (SELECT cluster, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM c0),
s AS (SELECT vec_id AS id, label, cluster, list_inner_product(embedding::DOUBLE[], v) AS sim FROM embeddings, c), own AS (SELECT * FROM s WHERE label = cluster),
rad AS (SELECT cluster, least(min(sim), avg(sim) - 3 * stddev_pop(sim)) AS radius FROM own GROUP BY cluster), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cluster) AS r FROM s)"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.lit(64).alias("family"), F.col("vec_id").alias("id"), "label", "embedding")
    c = _centroids(spark, sf_dir)
    own = e.join(c, ["family"]).where(F.col("label") == F.col("cluster")).withColumn("sim", vector.dot(vector.doubles(F.col("embedding")), F.col("centroid")))
    return vectors.assigned(e, c.join(vectors.radii(own, ["family"]), ["family", "cluster"]), ["family"])


@query(f"WITH {CENTROIDS_SQL} SELECT id, best.cluster AS nearest, round(sim, 4) AS sim, CASE WHEN sim >= radius THEN best.cluster END AS cluster FROM best JOIN rad ON rad.cluster = best.cluster WHERE r = 1")
def centroid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest centroid, and the cluster where it lies within its radius."""
    return _assigned(spark, sf_dir).select("id", "nearest", F.round("sim", 4).alias("sim"), "cluster")


@query(f"""WITH {CENTROIDS_SQL}, a AS (SELECT id, label, cluster FROM best WHERE r = 1), p AS (SELECT (x.label = y.label) = (x.cluster = y.cluster) AS agree FROM a x JOIN a y ON x.id < y.id)
SELECT round(avg(agree::INT), 6) AS rand_index FROM p""")
def rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two labelings, from their contingency table; the oracle lists all pairs."""
    return clusters.rand_index(_assigned(spark, sf_dir).select("label", "nearest"), "label", "nearest").select(F.round("rand_index", 6).alias("rand_index"))


@query()
def spherical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors in passes over all tasks, k chosen by silhouette; iterative, so without SQL."""
    e = table(spark, sf_dir, "embeddings").select(F.lit(64).alias("family"), F.col("vec_id").alias("id"), "embedding")
    return clusters.built(e, plain=0).select("family", "id", "cluster", F.round("sim", 4).alias("sim"), F.round("silhouette", 4).alias("silhouette"))


@query("""WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part),
z AS (SELECT p_partkey AS id, (p_size - m1) / s1 AS a, (p_retailprice - m2) / s2 AS b FROM part, s), q AS (SELECT a AS qa, b AS qb FROM z WHERE id = (SELECT min(p_partkey) FROM part))
SELECT id, round((a * qa + b * qb) / (sqrt(a * a + b * b) * sqrt(qa * qa + qb * qb)), 4) AS score FROM z, q ORDER BY round((a * qa + b * qb) / (sqrt(a * a + b * b) * sqrt(qa * qa + qb * qb)), 9) DESC, id LIMIT 20""")
def zscore_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine over standardised features to an example."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    z = vector.standardised(p, ["a", "b"])
    q = z.orderBy("id").first()
    cosine = (F.col("a") * q.a + F.col("b") * q.b) / (F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")) * F.lit((q.a**2 + q.b**2) ** 0.5))
    return z.withColumn("s", cosine).orderBy(F.desc(F.round("s", 9)), "id").limit(20).select("id", F.round("s", 4).alias("score"))


@query()
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best places of each nation, none within 150 km of a better one; greedy, so without SQL."""
    from orrery.queries.base import lat_of, lon_of

    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), lon_of(F.col("c_custkey")).alias("lon"), lat_of(F.col("c_custkey")).alias("lat"), F.col("c_acctbal").alias("score"))
    return vectors.spaced_per_group(s, "nation", 150_000.0)


@query("SELECT page_id, 'prov-' || substr(sha256('page|' || url || '||' || '1'), 1, 16) AS provenance FROM pages")
def sha_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed provenance ids; a null part counts as empty."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", governance.provenance_id(F.lit("page"), F.col("url"), F.lit(None).cast("string"), F.lit(1)).alias("provenance"))


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS k, lag(o_custkey) OVER (ORDER BY o_orderkey) AS before, CASE WHEN o_orderkey % 500 = 0 THEN -1 ELSE lag(o_custkey) OVER (ORDER BY o_orderkey) END AS claimed FROM orders)
SELECT id FROM o WHERE claimed IS DISTINCT FROM before""")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a chain whose claim of the row before is wrong: orders as an audit log, in which every 500th breaks off."""
    return governance.verified_chain(_order_log(table(spark, sf_dir, "orders"))).select("id")


def _order_log(orders: DataFrame) -> DataFrame:
    """orders as a log chained by hashes; rows whose key 500 divides claim a row before that is not there.

    A hash needs the one before, so the rows from one such break to the next are chained in one task.
    """
    import pandas as pd

    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    log = orders.select(key.alias("id"), day.alias("at"), F.col("o_custkey").cast("string").alias("actor"), F.lit("order").alias("action"), key.cast("string").alias("target"), F.lit(None).cast("string").alias("details"))
    # the break a row stands behind is the last one of its range, else of an earlier range
    ends = log.select(F.expr(f"id div {governance.BLOCK}").alias("block"), F.when(F.col("id") % 500 == 0, F.col("id")).alias("break")).groupBy("block").agg(F.max("break").alias("last"))
    earlier = ends.select("block", F.max("last").over(Window.partitionBy(F.lit(1)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    order = Window.partitionBy("block").orderBy("id")
    own = F.max(F.when(F.col("id") % 500 == 0, F.col("id"))).over(order)
    placed = log.withColumn("block", F.expr(f"id div {governance.BLOCK}")).withColumn("own", own).join(earlier, "block")

    def chained(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id").astype(object)
        f = f.where(f.notna(), None)
        before, links = governance.GENESIS, []
        for r in f.itertuples():
            before = "-1" if r.id % 500 == 0 else before
            links.append((before, before := governance.entry_hash(before, r.at_, r.actor, r.action, r.target, r.details)))
        return f.drop(columns="since").rename(columns={"at_": "at"}).assign(prev_hash=[p for p, _ in links], hash=[h for _, h in links])

    rows = placed.select("id", F.col("at").alias("at_"), "actor", "action", "target", "details", F.coalesce("own", "earlier").alias("since"))
    return rows.groupBy("since").applyInPandas(chained, "id bigint, at string, actor string, action string, target string, details string, prev_hash string, hash string")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 500 = 0 THEN 'broken link' ELSE 'altered row' END AS problem FROM orders WHERE o_orderkey % 500 = 0 OR o_orderkey % 777 = 0")
def audit_log_altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a log in which every 777th entry was changed after it was written: its hash is worked out again."""
    log = _order_log(table(spark, sf_dir, "orders"))
    return governance.verified_chain(log.withColumn("action", F.when(F.col("id") % 777 == 0, "refund").otherwise(F.col("action"))))


@query("""WITH r AS (SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY n_chars DESC, doc_id LIMIT 50) SELECT round(avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 6) AS precision, count(*) AS n FROM r""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of the 50 longest documents; the limit comes before the join with labels."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars").orderBy(F.desc("n_chars"), "id").limit(50)
    joined = d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    return evaluation.precision_at(joined, 50, F.col("n_chars"), F.col("quality") == 1).select(F.round("precision", 6).alias("precision"), "n")


@query("""WITH r AS (SELECT quality = 1 AS t, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM r)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS iou FROM c""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    m = evaluation.binary_metrics(r, F.col("quality") == 1, F.col("n_chars") > 1000)
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "iou")])


@query("""WITH m AS (SELECT DISTINCT o_custkey AS k, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders)
SELECT a.k, a.y AS y1, a.m AS m1, b.y AS y2, b.m AS m2 FROM m a JOIN m b ON a.k = b.k AND a.y < b.y WHERE least(abs(a.m - b.m), 12 - abs(a.m - b.m)) <= 1""")
def circular_month_gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one season in different years, by key."""
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    a, b = m.select("k", F.col("y").alias("y1"), F.col("m").alias("m1")), m.select("k", F.col("y").alias("y2"), F.col("m").alias("m2"))
    return a.join(b, "k").where((F.col("y1") < F.col("y2")) & (rules.month_gap(F.col("m1"), F.col("m2")) <= 1))


@query("""WITH e AS (SELECT event_id AS id, user_id, ts, event_type FROM events WHERE event_type IN ('view', 'purchase')),
t AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM e),
g AS (SELECT user_id, turn, min(ts) FILTER (WHERE event_type = 'view') AS o, max(ts) FILTER (WHERE event_type = 'purchase') AS d FROM t GROUP BY ALL)
SELECT user_id, turn::BIGINT AS turn, (epoch(date_trunc('second', d)) - epoch(date_trunc('second', o)))::BIGINT AS seconds FROM g WHERE o IS NOT NULL AND d >= o""")
def decision_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first view since the last purchase to each purchase."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase")).select(F.col("event_id").alias("id"), "user_id", "ts", "event_type")
    return evaluation.decision_seconds(e, "user_id", "ts", F.col("event_type") == "view", F.col("event_type") == "purchase")


@query("""WITH n AS (SELECT a.vec_id AS q, a.label AS ql, b.label AS l, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT ql AS label, round(avg((l = ql)::INT), 6) AS same FROM n WHERE r <= 10 GROUP BY ql""")
def knn_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the ten nearest that bear the query's label, for every twentieth vector against all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    labels = e.select("id", "label")
    found = vectors.nearest_rows(e, e.where("id % 20 = 0"), 10).join(labels.withColumnRenamed("label", "l"), "id")
    both = found.join(labels.select(F.col("id").alias("query"), F.col("label").alias("ql")), "query")
    return both.groupBy(F.col("ql").alias("label")).agg(F.round(F.avg((F.col("l") == F.col("ql")).cast("int")), 6).alias("same"))


@query("""SELECT l_suppkey AS aoi, count(*) AS scenes, count(*) FILTER (WHERE l_returnflag = 'N') AS usable, min(strftime(l_shipdate, '%Y-%m-%d')) AS first_seen, max(strftime(l_shipdate, '%Y-%m-%d')) AS last_seen FROM lineitem GROUP BY ALL""")
def scenes_per_aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by quality and first and last look of each area, in one pass."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("aoi")).agg(F.count(F.lit(1)).alias("scenes"), F.count_if(F.col("l_returnflag") == "N").alias("usable"), F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))


@query("""WITH s(o_orderstatus) AS (VALUES ('O'), ('F'), ('P'), ('X')) SELECT o_orderstatus, coalesce(n, 0) AS n FROM s LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) USING (o_orderstatus)""")
def registry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every enumerated state with its count, also those without rows."""
    return evaluation.states_counted(table(spark, sf_dir, "orders").select("o_orderstatus"), "o_orderstatus", ["O", "F", "P", "X"])


@query("""SELECT median(abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)))::DOUBLE AS median_days, max(abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)))::INTEGER AS max_days, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def earliest_date_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between found and reference dates."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return evaluation.date_error(pairs, "l_shipdate", "o_orderdate")


@query("""WITH r AS (SELECT source, n_chars, doc_id, coalesce(quality, 0) AS hit FROM documents LEFT JOIN labels USING (doc_id)), k AS (SELECT *, row_number() OVER w AS rank, sum(hit) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM r WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id))
SELECT source, round(avg(hits / rank) FILTER (WHERE hit = 1), 6) AS average_precision FROM k GROUP BY source""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of each source's ranking; unjudged counts as not relevant."""
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    return evaluation.average_precision(r, "source", F.col("n_chars"), F.col("quality") == 1).select("source", F.round("average_precision", 6).alias("average_precision"))


@query("""WITH r AS (SELECT p_partkey AS id, p_retailprice AS s, p_size AS v FROM part) SELECT 'top' AS band, round(avg(v), 6) AS mean FROM (SELECT * FROM r ORDER BY s DESC, id LIMIT 10)
UNION ALL SELECT 'bottom', round(avg(v), 6) FROM (SELECT * FROM r ORDER BY s, id LIMIT 10) UNION ALL SELECT 'all', round(avg(v), 6) FROM r""")
def proxy_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a proxy among the best, the worst and all of a ranking."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("s"), F.col("p_size").alias("v"))
    return evaluation.band_means(p, "s", "v").select("band", F.round("mean", 6).alias("mean"))
