"""Near duplicates by b-bit MinHash (Li and Konig 2010), every link confirmed on full shingle sets.

1. Each text becomes its set of word shingles; of ``HASHES`` minima over it, ``BANDS`` groups of
   ``ROWS`` name the bands' buckets, and the low two bits of all of them are packed in four longs.
2. Texts with the same words in the same order (by 128 bits of BLAKE2b over the words as text) are one
   class from here on, so thousands of copies cost one comparison.
3. In each bucket, every class is paired with the bucket's least class: as many pairs as members,
   however large a group. Sizes too different, or an estimate too low, drop a pair: equal positions by
   bit counts, corrected for the quarter that agrees by chance, five deviations of leeway.
4. Pairs left are confirmed by the size of the intersection of their sets, and join components.
5. Where a bucket then still holds several components, its members are held against each other inside
   tasks of bounded size (``Links.across``), so that no link between components is lost and no list of
   pairs is written; within a component, no further link is needed.

Sets hold 64-bit numbers of shingles, made of keyed BLAKE2b hashes of the words: two different shingles
have one number with a chance of 5e-20, and a pair of sets of 20,000 shingles each a wrong one in common
with 2e-11.

A pair right at the threshold shares no band with probability (1 - 0.85^4)^32 < 1e-10 at 0.85 (4.7e-8
at 0.80), and the estimate drops it with probability 1.3e-6 (1.0e-6 at 0.80): about 1e-6 together.

Defined results: a null text, an empty one or one of white space has no shingles and is linked with
nothing; a null doc_id takes part but is never a component's id while it has another; repeated rows
are copies like others; columns besides doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import dropped, pieces, released, small_batches, staged, table, tidy
from orrery.llm.components import components
from orrery.llm.shingles import factors, minima, mixed, shingle_sets

HASHES, BANDS, ROWS, PLANES = 128, 32, 4, 2
SIGNATURE = [f"s{i}" for i in range(PLANES * HASHES // 64)]
#: Ids of 16 MB at most are broadcast to fetch the texts of candidates.
BROADCAST_IDS = 2_000_000
#: Members, and shingles of members, of a block of a bucket; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000


def packed(least: np.ndarray) -> np.ndarray:
    """The low PLANES bits of the minima: plane after plane, 64 to a long."""
    planes = [(least >> np.uint32(p)) & np.uint32(1) for p in range(PLANES)]
    return np.packbits(np.concatenate(planes).astype(np.uint8), bitorder="little").view(np.int64)


def equal_positions(a: str, b: str) -> Column:
    """How many of the HASHES positions agree in all their bits, for signatures in structs a and b."""
    longs = HASHES // 64
    differ = []
    for i in range(longs):
        xor = [F.col(f"{a}.{SIGNATURE[p * longs + i]}").bitwiseXOR(F.col(f"{b}.{SIGNATURE[p * longs + i]}")) for p in range(PLANES)]
        differ.append(F.bit_count(xor[0].bitwiseOR(xor[1])))
    return F.lit(HASHES) - sum(differ[1:], differ[0])


def least_equal(similarity: float) -> int:
    """Equal positions under which a pair as similar as this falls with a chance of about 1e-6 only."""
    chance = 0.5**PLANES
    p = chance + (1 - chance) * similarity
    return int(np.floor(HASHES * p - 5 * np.sqrt(HASHES * p * (1 - p))))


def _set_hash(text: str | None) -> bytes | None:
    """What names a class: 128 bits of the words, lower-cased, with one space between; null without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row_key (a hash of the text), n_shingles, set_hash, bands and signature of every row."""
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, row_key bigint, n_shingles bigint, set_hash binary, bands array<bigint>, " + ", ".join(f"{s} bigint" for s in SIGNATURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = factors(HASHES)
        for batch in pieces(batches, 1):
            texts = batch.column(1).to_pylist()
            sets = shingle_sets(texts, width)
            least = [minima(s, f) for s in sets]
            halves = np.array(least, np.uint32).reshape(len(sets), HASHES).view(np.uint64).reshape(len(sets), BANDS, ROWS // 2)
            keys = mixed(mixed(halves[:, :, 0]) + halves[:, :, 1]).view(np.int64)
            longs = np.array([packed(m) for m in least], np.int64).reshape(len(sets), len(SIGNATURE))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_hash(t) for t in texts], pa.binary()),
                    pa.array([k if len(x) else None for k, x in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                    *[pa.array(longs[:, i], pa.int64()) for i in range(len(SIGNATURE))],
                ],
                names=["doc_id", "row_key", "n_shingles", "set_hash", "bands", *SIGNATURE],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text", _row_key()).mapInArrow(tidy(run), schema)


def _row_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """set_hash and members of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            texts = batch.column(0).to_pylist()
            sets = shingle_sets(texts, width)
            hashes = [_set_hash(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set_hash", "members"])

    return docs.select("text").mapInArrow(tidy(run), "set_hash binary, members array<bigint>")


class Links:
    """Candidate pairs of classes, and those of them that are confirmed."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent

    def likely(self) -> Column:
        """Of structs x and y: sizes and signatures allow the similarity."""
        small, large = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
        return (small * 100 >= large * self.percent) & (equal_positions("x", "y") >= least_equal(self.percent / 100))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """set_hash and members of the wanted classes (distinct set_hash), from their texts."""
        ids = staged(wanted.join(self.classes.select("set_hash", "doc_id"), "set_hash"), "wanted")
        known = ids.where("doc_id is not null").select("doc_id").distinct()
        found = self.docs.join(_few(known), "doc_id").select("text")
        if ids.where("doc_id is null").limit(1).count():
            found = found.union(self.docs.where("doc_id is null").select("text"))
        sets = staged(_sets(found, self.width).where("set_hash is not null").dropDuplicates(["set_hash"]), "sets")
        dropped(ids)
        return sets

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs a < b, read from where they were written, whose sets are similar enough."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct())
        both = pairs.join(sets.select(F.col("set_hash").alias("b"), F.col("members").alias("y")), "b").join(
            sets.select(F.col("set_hash").alias("a"), F.col("members").alias("x")), "a"
        )
        common = F.size(F.array_intersect("x", "y"))
        links = staged(both.where(common * 100 >= (F.size("x") + F.size("y") - common) * self.percent).select("a", "b"), "links")
        dropped(sets)
        return links

    def across(self, open_: DataFrame) -> DataFrame:
        """Links between components inside buckets. open_: key, x and root of the buckets that hold several.

        A bucket is cut into blocks of BLOCK members, and each two blocks are one task, so no task holds
        more however large the bucket. First, by signatures alone, members without a likely partner in
        another component drop out. Then a member's set is held against all others at once, by lists of
        which sets have a shingle; most likely hubs first, as they join most, and members of the largest
        component never, as the others are held against them. No pairs are written out: a task gives one
        link for each two components it joins.
        """
        blocks = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("x.n_shingles") / BLOCK_SHINGLES)
        sizes = open_.groupBy("key").agg(F.ceil(blocks).cast("int").alias("blocks"))
        dealt = open_.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("x.set_hash"), "blocks").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        task = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.select(task.alias("task"), "root", "x.*")
        percent, least = self.percent, least_equal(self.percent / 100)
        given = [f.name for f in dealt.schema.fields]

        def partnered(t: pa.Table) -> pa.Table:
            return t.filter(pa.array(_likely_partners(t, percent, least) > 0))

        kept = staged(dealt.groupBy("task").applyInArrow(partnered, dealt.schema), "partnered")
        sets = self.sets(kept.select("set_hash").distinct())

        def joined(t: pa.Table) -> pa.Table:
            pairs = sorted(tuple(sorted(p)) for p in _joining(t, percent, least))
            released()
            return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})

        full = kept.join(sets, "set_hash").select(*given, "members")
        links = staged(full.groupBy("task").applyInArrow(joined, "a binary, b binary").distinct(), "across")
        dropped(kept, sets)
        return links


def _likely_partners(t: pa.Table, percent: int, least: int) -> np.ndarray:
    """How many likely partners in other components each member has."""
    n, roots = t["n_shingles"].to_numpy(), np.unique(t["root"].to_pylist(), return_inverse=True)[1]
    longs, out = HASHES // 64, np.zeros(t.num_rows, np.int64)
    planes = [np.stack([t[SIGNATURE[p * longs + i]].to_numpy() for i in range(longs)], 1) for p in range(PLANES)]
    for i in range(t.num_rows):
        differ = np.bitwise_count((planes[0] ^ planes[0][i]) | (planes[1] ^ planes[1][i])).sum(1)
        alike = (HASHES - differ.astype(np.int64) >= least) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent)
        out[i] = (alike & (roots != roots[i])).sum()
    return out


def _joining(t: pa.Table, percent: int, least: int) -> Iterator[tuple[bytes, bytes]]:
    """Confirmed links that join the components of a task's members, as far as any exist."""
    names, sets = t["set_hash"].to_pylist(), [np.asarray(m.values) for m in t["members"]]
    comp = np.unique(t["root"].to_pylist(), return_inverse=True)[1]
    n, degree = np.array([len(s) for s in sets]), _likely_partners(t, percent, least)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(sets)), n)[np.argsort(number, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(number))])
    of = np.split(number, np.cumsum(n)[:-1])
    todo = degree > 0
    while True:
        largest = np.bincount(comp).argmax()
        left = np.flatnonzero(todo & (comp != largest))
        if not len(left):
            return
        x = left[degree[left].argmax()]
        todo[x] = False
        common = np.bincount(np.concatenate([holders[begin[s] : begin[s + 1]] for s in of[x]]), minlength=len(sets))
        for y in np.flatnonzero((common * 100 >= (n + n[x] - common) * percent) & (comp != comp[x])):
            if comp[y] != comp[x]:
                comp[comp == comp[y]] = comp[x]
                yield names[x], names[y]


def _buckets(classes: DataFrame) -> DataFrame:
    """key and class (a struct) for each class and band."""
    about = F.struct("set_hash", "n_shingles", *SIGNATURE)
    return classes.select(about.alias("x"), F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "x")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.set_hash", "y.set_hash").alias("a"), F.greatest("x.set_hash", "y.set_hash").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links hold similarity * 100 >= percent."""
    found = clustered(docs, width, percent).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def clustered(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row_key, n_shingles, component (null without shingles) and component_id of every row."""
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    rows = staged(signed(docs, width), "signed")
    one = F.struct("n_shingles", "bands", *SIGNATURE)
    classes = staged(
        rows.where("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first(one).alias("one")).select("set_hash", "doc_id", "one.*"), "classes"
    )
    links = Links(docs, classes, width, percent)
    keys = classes.select(F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"))
    shared = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    buckets = staged(_buckets(classes).join(_few(shared), "key"), "buckets")
    pivots = buckets.groupBy("key").agg(F.min("x").alias("y"))
    stars = staged(_ordered(buckets.join(pivots, "key").where((F.col("x.set_hash") != F.col("y.set_hash")) & links.likely())), "stars")
    found = links.confirmed(stars)
    dropped(shared, stars)
    roots = components(found)

    # buckets that hold several components still
    named = buckets.join(roots, F.col("x.set_hash") == F.col("node"), "left").select("key", "x", F.coalesce("root", "x.set_hash").alias("root"))
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    open_ = staged(named.join(several, "key"), "open")
    more = links.across(open_)
    dropped(open_, buckets)
    if more.limit(1).count():
        roots = components(found.union(more))

    labels = classes.select("set_hash", "doc_id").join(roots.withColumnRenamed("node", "set_hash"), "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash"))
    ids = labels.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named_classes = labels.join(ids, "root").select("set_hash", F.col("root").alias("component"), "component_id")
    return rows.select("doc_id", "row_key", "n_shingles", "set_hash").join(named_classes, "set_hash", "left").drop("set_hash")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: of the least doc_id, then of one of its texts.

    Rows without an id stand behind all others. Rows without shingles stay. Texts stay in place: what
    moves are ids and hashes of texts.
    """
    found = staged(clustered(docs, width, percent).where("component is not null").select("component", "doc_id", "row_key"), "found")
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")
    several = found.groupBy("component").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    # members of a component, however many, stay where they are while the components, counted, are few enough
    best = staged(several.select("component", "best"), "best")
    other = found.join(_few(best), "component").where(first != F.col("best"))
    gone = staged(other.select(F.col("doc_id").alias("gone_id__"), F.col("row_key").alias("gone_key__")).distinct(), "gone")
    same_gone = (_row_key() == F.col("gone_key__")) & F.col("doc_id").eqNullSafe(F.col("gone_id__"))
    left = docs.join(_few(gone), same_gone, "left_anti")
    twice = found.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id__"), F.col("row_key").alias("again_key__"))
    again = staged(twice, "again")
    if not again.limit(1).count():
        return left
    same = (_row_key() == F.col("again_key__")) & F.col("doc_id").eqNullSafe(F.col("again_id__"))
    return left.join(_few(again), same, "left_anti").unionByName(left.join(_few(again), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


def oracle_sql(width: int = 3, percent: int = 85) -> str:
    """For tables whose groups are small: the closure of the links is written out."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {width - 1}], ' '))) AS s
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
roots AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN roots ON roots.a = d.doc_id
"""
