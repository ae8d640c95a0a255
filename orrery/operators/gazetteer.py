"""Names looked up by parts of them: postings of letter groups in place of a scan for every question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What comes first among names that fit alike.
KIND_ORDER = {"city": 0, "state": 1, "district": 2}
#: Letters of a group.
LETTERS = 3


def groups(key: Column, letters: int) -> Column:
    """The distinct groups of so many letters of a text."""
    starts = F.when(F.length(key) >= letters, F.sequence(F.lit(1), F.length(key) - (letters - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(key, i, F.lit(letters))))


def postings(places: DataFrame) -> DataFrame:
    """group and key: each distinct key once for each group of one, two and three letters of it."""
    every = F.flatten(F.array(*[groups(F.col("key"), n) for n in range(1, LETTERS + 1)]))
    return places.select("key").distinct().select("key", F.explode(F.array_distinct(every)).alias("group"))


def found(questions: DataFrame, places: DataFrame, index: DataFrame, limit: int = 10) -> DataFrame:
    """question_id, rank, place_id and fit (0 the name itself, 1 a name that begins so, 2 one that holds it).

    questions: question_id and key; places: place_id, key, kind, population, name; index: postings(places). A text
    that many ask is looked up once. It asks for the rarest of its groups, of its own length if it has fewer letters
    than LETTERS, so it meets the keys of one posting list; those that do not hold it whole drop out. Places of one
    key fit alike, so the first limit of each key are all that can be among the first of a text. An empty question
    finds nothing.
    """
    asked = questions.where(F.length("key") > 0).select("question_id", F.col("key").alias("asked"))
    each = F.when(F.length("asked") >= LETTERS, groups(F.col("asked"), LETTERS)).otherwise(F.array("asked"))
    counts = index.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    texts = asked.select("asked").distinct()
    rarest = texts.withColumn("group", F.explode(each)).join(counts, "group", "left").groupBy("asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "group")).alias("r"))
    hits = rarest.where("r.n > 0").select("asked", F.col("r.group").alias("group")).join(index, "group").where(F.contains("key", "asked")).select("asked", "key")
    kinds = F.create_map(*[F.lit(x) for pair in KIND_ORDER.items() for x in pair])
    order = [F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit(len(KIND_ORDER))).alias("kind"), (-F.coalesce("population", F.lit(0))).alias("fewer"), F.col("name"), F.col("place_id")]
    ranked = places.select("key", *order)
    names = ["kind", "fewer", "name", "place_id"]
    first = _first(ranked, ["key"], names, limit)
    fit = F.when(F.col("key") == F.col("asked"), 0).when(F.startswith("key", "asked"), 1).otherwise(2)
    best = _first(hits.join(first, "key").select("asked", fit.alias("fit"), *names), ["asked"], ["fit", *names], limit)
    answers = best.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("fit", *names))).alias("answers"))
    told = asked.join(answers, "asked").groupBy("question_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("answers"))), 1, limit).alias("answers"))
    return told.select("question_id", F.posexplode("answers").alias("at", "a")).select("question_id", (F.col("at") + 1).alias("rank"), F.col("a.place_id").alias("place_id"), F.col("a.fit").alias("fit"))


def _first(rows: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """The first limit rows of each group; each task drops the rest before they travel."""
    return rows.withColumn("rank__", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank__") <= limit).drop("rank__")
