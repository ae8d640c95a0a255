"""Benchmark decontamination: containment search for short items inside long documents.

The items are partitioned by size. Small ones are looked for by all their shingles; a larger one by
the shingles at its ``HASHES`` MinHash minima, which are in a document that holds the share c of the
item's shingles with chance c each, however long the document is (a Jaccard similarity would vanish
there). A document that holds enough of them, and is long enough, is a candidate: at the threshold, a
true pair falls short with a chance under 1e-7. Candidates' shingles are then compared as text with
all of the item's, and the share of the item's distinct shingles found decides.

Documents stay in place: the items' side is broadcast while it is small (``BROADCAST_ROWS``), else it
is joined by shuffle; only hits and candidates move. All of it is SQL expressions.

Words are what stands between white space (space, tab to carriage return) in the lower-cased text; a
shingle is ``width`` words, or all words of an item that has fewer.

Defined results: a null, empty or blank text, of item or document, matches nothing; of repeated
documents (one doc_id) and of repeated items each pair (doc_id, item_id) is given once, with its
greatest share; a null id is an id like others; other columns are not read (``decontaminated`` keeps
them); empty tables give no pairs; texts of any length are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import SPACE, staged, table

WIDTH, PERCENT = 5, 80
HASHES = 32
#: Items with so many shingles at most are looked for by all of them.
SMALL = 32
#: Rows of the items' or candidates' side that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def _key() -> Column:
    """Identity of a document, with its doc_id: of rows with one doc_id, equal texts share it."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def least_hits(percent: int = PERCENT) -> int:
    """Of a large item's HASHES minima, how many a document must hold: 5.5 deviations under the mean."""
    p = percent / 100
    return max(1, math.floor(HASHES * p - 5.5 * math.sqrt(HASHES * p * (1 - p))))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item (a key of its words), width, size and the item's distinct shingles as an array of texts."""
    w = F.col("w")
    own = F.least(F.lit(width), F.size(w))
    return (
        items.select(words(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select(
            F.md5(F.array_join(w, " ").cast("binary")).alias("item"),
            own.alias("width"),
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - own + 1), lambda i: F.array_join(F.slice(w, i, own), " "))).alias("shingles"),
        )
        .dropDuplicates(["item"])
        .withColumn("size", F.size("shingles"))
    )


def shingle_hash(parts: list[Column]) -> Column:
    """Of the hashes of a shingle's words."""
    return F.xxhash64(*parts)


def signatures(shingled: DataFrame, width: int = WIDTH) -> DataFrame:
    """hash, item, width, size and weight: what to look for; weight is the number of minima there.

    width: the most words of a shingle.
    """
    sets = shingled.withColumn(
        "picked",
        F.when(F.col("size") <= SMALL, F.col("shingles")).otherwise(
            F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda i: F.array_min(F.transform("shingles", lambda s: F.struct(F.xxhash64(i, s).alias("h"), s.alias("s"))))["s"])
        ),
    )
    each = sets.select("item", "width", "size", F.explode("picked").alias("s"))
    hashed = F.transform(F.split("s", " "), lambda x: F.xxhash64(x))
    widths = [F.when(F.col("width") == k, shingle_hash([hashed[i] for i in range(k)])) for k in range(1, width + 1)]
    return each.groupBy("item", "width", "size", F.coalesce(*widths).alias("hash")).agg(F.count(F.lit(1)).alias("weight"))


def _hashes(docs: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, key, n_words, width and hash: a row for every shingle of every width of every document, in one scan."""
    hashed = docs.select("doc_id", _key().alias("key"), F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    held = hashed.where(F.size("w") >= min(widths)).withColumn("n_words", F.size("w"))
    # row i holds the words from i on, null behind the text's end
    columns = [F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(max(widths))]
    rows = held.select("doc_id", "key", "n_words", F.inline(F.arrays_zip(*columns)))
    each = [F.when(F.col(f"w{k - 1}").isNotNull(), F.struct(F.lit(k).alias("width"), shingle_hash([F.col(f"w{i}") for i in range(k)]).alias("hash"))) for k in widths]
    return rows.select("doc_id", "key", "n_words", F.explode(F.array(*each)).alias("s")).where("s is not null").select("doc_id", "key", "n_words", "s.width", "s.hash")


def candidates(docs: DataFrame, shingled: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, key and item of the pairs worth comparing."""
    wanted = staged(signatures(shingled, width), "signatures")
    known = wanted.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each width
    if not known:
        return docs.select("doc_id", _key().alias("key"), F.lit(None).cast("string").alias("item")).limit(0)
    items = _small(wanted.select("hash", "width", "item", "size", "weight"), sum(row["n"] for row in known))
    long_enough = (F.col("n_words") - (F.col("width") - 1)) * 100 >= F.col("size") * percent
    met = _hashes(docs, sorted(row["width"] for row in known)).join(items, ["hash", "width"]).where(long_enough)
    hits = met.groupBy("doc_id", "key", "item", "size", "hash").agg(F.first("weight").alias("weight"))
    least = F.when(F.col("size") <= SMALL, F.ceil(F.col("size") * percent / 100)).otherwise(least_hits(percent))
    return hits.groupBy("doc_id", "key", "item", "size").agg(F.sum("weight").alias("held")).where(F.col("held") >= least).select("doc_id", "key", "item")


def contained(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, item, n_shingles and n_common of documents that hold percent of an item's shingles."""
    docs, items = docs.select("doc_id", "text"), items.select("text")
    shingled = staged(item_shingles(items, width), "items")
    pairs = staged(candidates(docs, shingled, percent, width), "candidates")
    keys = pairs.select("key").distinct()
    held = docs.withColumn("key", _key()).join(_small(keys, pairs.count()), "key").dropDuplicates(["doc_id", "key"])
    full = shingled.select("item", "width", "size", F.explode("shingles").alias("shingle"))
    w = F.col("w")
    texts = held.select("doc_id", "key", words(F.col("text")).alias("w")).join(
        pairs.join(shingled.select("item", "width"), "item").select("key", "width").distinct(), "key"
    )
    shingles = texts.where(F.size("w") >= F.col("width")).select(
        "doc_id", "key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - F.col("width") + 1), lambda i: F.array_join(F.slice(w, i, F.col("width")), " ")))).alias("shingle")
    )
    found = shingles.join(full, "shingle").groupBy("doc_id", "key", "item", "size").agg(F.count(F.lit(1)).alias("n_common"))
    return (
        found.where(F.col("n_common") * 100 >= F.col("size") * percent)
        .join(pairs.select("key", "item").distinct(), ["key", "item"], "left_semi")
        .select("doc_id", "key", "item", F.col("size").cast("bigint").alias("n_shingles"), "n_common")
    )


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_common and containment of every pair found."""
    named = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).select("item_id", F.md5(F.array_join("w", " ").cast("binary")).alias("item"))
    return (
        contained(docs, items, width, percent)
        .join(named.distinct(), "item")
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct((F.col("n_common") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_common")).alias("best"))
        .select("doc_id", "item_id", "best.n_shingles", "best.n_common", "best.containment")
    )


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    found = contained(docs, items, width, percent).select(F.col("key").alias("held_key__"), F.col("doc_id").alias("held_id__")).distinct()
    found = staged(found, "contaminated")
    return docs.join(_small(found, found.count()), (_key() == F.col("held_key__")) & F.col("doc_id").eqNullSafe(F.col("held_id__")), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside documents."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle_sql() -> str:
    def shingles(source: str, key: str) -> str:
        own = f"least({WIDTH}, len(w))" if key == "item_id" else f"{WIDTH}"
        return f"""SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {own} + 2), lambda i: array_to_string(w[i : i + {own} - 1], ' '))) AS s
    FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM {source}) WHERE len(w) > 0"""

    return f"""
WITH item AS ({shingles("benchmark", "item_id")}),
doc AS ({shingles("documents", "doc_id")}),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item GROUP BY item_id),
common AS (SELECT doc_id, item_id, count(*) AS n_common FROM doc JOIN item USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_common, n_common::DOUBLE / n_shingles AS containment
FROM common JOIN sizes USING (item_id) WHERE n_common * 100 >= n_shingles * {PERCENT}
"""
