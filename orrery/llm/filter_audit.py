"""How filters of documents overlap: what each removes in every order, and its Shapley value, exactly.

A document's failures are a mask of as many bits as there are filters. All that is asked follows from
how many documents of a part each coalition of filters removes:

1. ``facts``: one narrow row for each document, its mask computed from the whole text in the JVM.
2. ``tabulated``: documents for each part and mask. The filter on repeated texts needs the least doc_id
   of each text: rows are counted by (digest, doc_id), those by digest and mask, so thousands of copies
   are a few rows before the rows of a text meet.
3. ``coalitions``: removals of all 2^n coalitions (32 for five filters) of each part.
4. ``audited``: the Shapley values solve a constrained least squares problem (Charnes et al. 1988): over
   the proper coalitions S, with the kernel's weights (n-1) / (C(n,s) s (n-s)), the squared errors of
   v(S) by the sum of the values in S are least, where all values sum up to v(all). The normal equations
   with the multiplier of that efficiency constraint are solved in rationals. The counts of each step
   are differences between two coalitions.

Defined results: a null text counts as empty, an empty one has no words and fails only a rule that no
words fail; a null source is the part ``''``, as is an empty one; of repeated texts, those fail whose
doc_id is above the least with that text, so a row without an id fails nothing by it, nor do repeated
rows of the least id; a row without labels, or without an id, is neither good nor toxic; of several
labels of one id any 1 counts; an empty table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import SPACE, table

#: The filter that fails repeated texts; the others are conditions on the text.
REPEATED = "E"
COUNTS = ["n", "good", "toxic"]
OUT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def facts(docs: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, part, mask (a bit for each of filters, conditions on the column text) and digest of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    given = conditions(F.col("text")) if filters is None else filters
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(given.values())]
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    return whole.select("doc_id", "part", sum(bits, F.lit(0)).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def tabulated(rows: DataFrame, labels: DataFrame, repeated: int) -> DataFrame:
    """part, mask, n, good and toxic of the documents in rows (see facts); mask has the bit repeated for repeated texts."""
    told = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # rows without an id match nothing; a second key spreads them (id % 1 is 0, but not to the optimiser)
    spread = F.coalesce(F.col("doc_id") % 1, F.xxhash64("digest"))
    known = rows.withColumn("spread", spread).join(told.withColumn("spread", F.col("doc_id") % 1), ["doc_id", "spread"], "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[1:]]
    by_id = known.select("doc_id", "spread", "digest", "part", "mask", *flags).groupBy("doc_id", "spread", "digest", "part", "mask", *COUNTS[1:]).agg(F.count(F.lit(1)).alias("n"))
    named = F.col("doc_id").isNotNull()
    alike = by_id.groupBy("digest", "part", "mask", *COUNTS[1:]).agg(
        F.sum("n").alias("n"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("least")
    )
    first = alike.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    own = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = alike.join(first, "digest").withColumn("again", F.col("named") - own)
    two = F.array(F.struct("mask", (F.col("n") - F.col("again")).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(repeated)).alias("mask"), F.col("again").alias("n")))
    each = split.select("part", *COUNTS[1:], F.explode(two).alias("x")).where("x.n > 0")
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), *[F.sum(F.col("x.n") * F.col(c)).alias(c) for c in COUNTS[1:]]
    )


def coalitions(counted: DataFrame, filters: int) -> DataFrame:
    """part, coalition (a mask, 0 to 2^filters - 1), total, and what the coalition removes: n, good and toxic."""
    every = counted.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    removed = [F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in COUNTS]
    return every.groupBy("part", "coalition").agg(F.sum("n").alias("total"), *removed)


def solved(rows: list[list[Fraction]]) -> list[Fraction]:
    """The solution of linear equations, given as rows of coefficients with the right side behind them."""
    n = len(rows)
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [a - rows[r][i] * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [r[-1] for r in rows]


def shapley(value: list[int]) -> list[Fraction]:
    """The Shapley value of each player, by least squares. value: of each coalition, by its mask; value[0] is 0."""
    n = (len(value) - 1).bit_length()
    sides = [[Fraction(0)] * (n + 2) for _ in range(n)]
    for mask in range(1, len(value) - 1):
        size = mask.bit_count()
        weight = Fraction(n - 1, math.comb(n, size) * size * (n - size))
        inside = [i for i in range(n) if mask >> i & 1]
        for i in inside:
            for j in inside:
                sides[i][j] += weight
            sides[i][-1] += weight * value[mask]
    for row in sides:
        row[n] = Fraction(1)
    return solved([*sides, [Fraction(1)] * n + [Fraction(0), Fraction(value[-1])]])[:n]


def audited(removals: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters and step. removals: as coalitions gives them; names: a letter for each bit."""
    n, full = len(names), (1 << len(names)) - 1
    orders = ["".join(p) for p in permutations(names)]

    def steps(rows: pa.Table) -> pa.Table:
        by = {r["coalition"]: r for r in rows.to_pylist()}
        gone = [by[c]["n"] for c in range(full + 1)]
        share = [int(x * math.factorial(n)) for x in shapley(gone)]
        out = []
        for order in orders:
            before = 0
            for k, name in enumerate(order, 1):
                i = names.index(name)
                now = before | 1 << i
                removed = gone[now] - gone[before]
                lost = [by[now][c] - by[before][c] for c in COUNTS[1:]]
                out.append((by[0]["part"], order, k, by[0]["total"] - gone[now], removed, gone[1 << i] - removed, gone[full] - gone[full ^ 1 << i], *lost, share[i]))
                before = now
        fields = [f.split() for f in OUT.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
        return pa.table({name: pa.array(column, kinds[kind]) for (name, kind), column in zip(fields, zip(*out, strict=True), strict=True)})

    return removals.groupBy("part").applyInArrow(steps, OUT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over whole documents, in all 120 orders, for each source."""
    rows = facts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    names = "".join(conditions(F.col("text"))) + REPEATED
    counted = tabulated(rows, table(spark, sf_dir, "labels"), 1 << names.index(REPEATED))
    return audited(coalitions(counted, len(names)), names)


def oracle_sql() -> str:
    """Follows every document through every order; no coalitions."""
    return """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS x(f) WHERE NOT contains(o, f)),
steps AS (SELECT o AS filter_order, k AS step, o[k] AS f FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5),
told AS (
  SELECT part, filter_order, step, f, good, toxic, contains(fails, f) AS failed, fails = f AS alone,
    (SELECT coalesce(min(i), 9) FROM range(1, 6) AS r(i) WHERE contains(fails, filter_order[i])) AS place
  FROM (SELECT part, good, toxic, fails FROM d), steps),
counted AS (
  SELECT part, filter_order, step, f, count(*) FILTER (place > step) AS kept, count(*) FILTER (place = step) AS removed,
    count(*) FILTER (failed AND place < step) AS redundant, count(*) FILTER (alone) AS unique_fails,
    count(*) FILTER (place = step AND good) AS good_lost, count(*) FILTER (place = step AND toxic) AS toxic_lost
  FROM told GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
