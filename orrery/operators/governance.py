"""Provenance, audit chain, freshness and review."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.text import human_age

STATES = ("LIVE", "DELAYED", "SNAPSHOT", "STALE", "UNAVAILABLE", "NOT STAGED", "KEY REQUIRED", "NOT IMPLEMENTED")
CONNECTED = "connected"
#: What the first entry of a log names as the hash before it.
GENESIS = "0" * 64
#: Ids of a range of a log that is sorted by itself.
BLOCK = 4096


def provenance_id(*parts: Column) -> Column:
    """Content address of a record's origin; a null part counts as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("prov-"), F.substring(F.sha2(text, 256), 1, 16))


def candidate_id(aoi: Column, from_class: Column, to_class: Column, first_tile: Column) -> Column:
    return F.concat(F.lit("chg-"), F.substring(F.sha2(F.concat_ws("|", aoi, from_class, to_class, first_tile), 256), 1, 12))


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces: one text for one value."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def freshness(sources: DataFrame, mode: str = CONNECTED) -> DataFrame:
    """sources with state and label. Columns: adapter, key_present, health, age_h, stale_after_hours, delayed_after_hours.

    age_h is the age of the last download that succeeded: reading a snapshot again makes nothing younger.
    Limits may be null. Only a connected engine calls a healthy source live or delayed.
    """
    age, health = F.col("age_h"), F.coalesce("health", F.lit("never-run"))
    live = F.lit(mode == CONNECTED) & (health == "ok")
    state = (
        F.when(~F.coalesce("adapter", F.lit(False)), "NOT IMPLEMENTED")
        .when(~F.col("key_present"), "KEY REQUIRED")
        .when(age.isNull() & health.isin("failed", "rate-limited"), "UNAVAILABLE")
        .when(age.isNull(), "NOT STAGED")
        .when(age > F.col("stale_after_hours"), "STALE")
        .when(live & (age > F.col("delayed_after_hours")), "DELAYED")
        .when(live, "LIVE")
        .otherwise("SNAPSHOT")
    )
    fallback = F.col("state").isin("SNAPSHOT", "STALE")
    label = F.concat(
        F.col("state"),
        F.when(F.col("state").isin("SNAPSHOT", "STALE", "LIVE", "DELAYED"), F.concat(F.lit(" · "), human_age(age), F.lit(" old"))).otherwise(""),
        F.when(fallback & (health == "failed"), " · LAST REFRESH FAILED").when(fallback & (health == "rate-limited"), " · RATE LIMITED").otherwise(""),
    )
    return sources.withColumn("state", state).withColumn("label", label)


def entry_hash(previous: str, at: str, actor: str, action: str, target: str | None, details: str | None) -> str:
    """Digest of one entry and of the one before, as compact JSON in this order."""
    return hashlib.sha256(json.dumps([previous, at, actor, action, target, details], separators=(",", ":")).encode()).hexdigest()


def appended(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The new rows that one batch of entries (at, actor, action, target, details) adds to a log, in order of at.

    Each needs the hash before it, so a batch, what one request or run has to say, is one Python group;
    of the log, only the last row is read.
    """
    last = log.orderBy(F.desc("id")).limit(1).select("id", "hash").collect()
    start, before = (last[0].id + 1, last[0].hash) if last else (1, GENESIS)

    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "actor", "action", "target", "details"], na_position="first").astype(object)
        frame = frame.where(frame.notna(), None)
        rows, previous = [], before
        for i, e in enumerate(zip(frame["at_"], frame["actor"], frame["action"], frame["target"], frame["details"], strict=True)):
            rows.append((start + i, *e, previous, previous := entry_hash(previous, *e)))
        return pd.DataFrame(rows, columns=["id", "at", "actor", "action", "target", "details", "prev_hash", "hash"])

    named = entries.select(F.col("at").alias("at_"), "at", "actor", "action", "target", "details")
    return named.groupBy().applyInPandas(chained, "id bigint, at string, actor string, action string, target string, details string, prev_hash string, hash string")


def beside(log: DataFrame, value: Column, name: str) -> DataFrame:
    """log with value of the row before, by id (a whole number, given once), as name.

    Rows are ranges of BLOCK ids, each sorted by itself; the last value of each range is carried over to
    the next one, so only a row for each range passes through one task.
    """
    block = F.expr(f"id div {BLOCK}")
    held = log.withColumns({"block__": block, "value__": value})
    ends = held.groupBy("block__").agg(F.max_by("value__", "id").alias("end__"))
    ends = ends.select("block__", F.lag("end__").over(Window.partitionBy(F.lit(1)).orderBy("block__")).alias("end__"))
    order = Window.partitionBy("block__").orderBy("id")
    first = F.row_number().over(order) == 1
    before = held.withColumns({"first__": first, "lag__": F.lag("value__").over(order)}).join(ends, "block__")
    return before.withColumn(name, F.when(F.col("first__"), F.col("end__")).otherwise(F.col("lag__"))).drop("block__", "value__", "first__", "lag__", "end__")


def verified_chain(log: DataFrame, days: int = 1) -> DataFrame:
    """id and problem of the broken rows of an audit log: id, at, actor, action, target, details, prev_hash, hash.

    An exact copy of the row before is tolerated. The chain is one sequence; its rows are held against the
    row before in ranges of ids, and hashes are recomputed in parallel.
    """

    @F.pandas_udf(T.StringType())
    def again(prev: pd.Series, at: pd.Series, actor: pd.Series, action: pd.Series, target: pd.Series, details: pd.Series) -> pd.Series:
        rows = zip(prev, at, actor, action, target.astype(object).where(target.notna(), None), details.astype(object).where(details.notna(), None), strict=True)
        return pd.Series([entry_hash(*r) for r in rows], dtype=object)

    same = F.struct("at", "actor", "action", "target", "details", "prev_hash", "hash")
    rows = beside(log, same, "before")
    rows = rows.where(~F.col("before").eqNullSafe(same)).withColumn("expected", F.coalesce("before.hash", F.lit(GENESIS)))
    wrong = F.when(F.col("prev_hash") != F.col("expected"), "broken link").when(F.col("hash") != again("prev_hash", "at", "actor", "action", "target", "details"), "altered row")
    return rows.withColumn("problem", wrong).where("problem is not null").select("id", "problem")


def reviewed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates with their latest decision as review_state; unreviewed without one."""
    last = decisions.groupBy("target_id").agg(F.max(F.struct("id", "decision")).alias("d")).select(F.col("target_id").alias("id"), F.col("d.decision").alias("latest"))
    return candidates.join(last, "id", "left").withColumn("review_state", F.coalesce("latest", F.lit("unreviewed"))).drop("latest")


def decided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates with the review state of their latest decision written in; others keep theirs."""
    last = decisions.groupBy("target_id").agg(F.max(F.struct("id", "decision")).alias("d")).select(F.col("target_id").alias("id"), F.col("d.decision").alias("latest__"))
    return candidates.join(last, "id", "left").withColumn("review_state", F.coalesce("latest__", "review_state")).select(*candidates.columns)


def decision_entries(decisions: DataFrame) -> DataFrame:
    """What decisions (target_id, decision, actor, at, note) have to say to the audit log."""
    return decisions.select("at", "actor", F.col("decision").alias("action"), F.col("target_id").alias("target"), F.when(F.col("note").isNotNull(), F.to_json(F.struct("note"))).alias("details"))


def contract_problems(checks: list[tuple[Column, str]]) -> Column:
    """The messages of the checks that fail."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in checks]), lambda m: m.isNotNull())
