"""Conversations and saved sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billspark.operators.slices import neighbours, since_reset

TIMEOUT_MINUTES = 30
MAX_RETRY_ATTEMPTS = 3
BACKUP_EVERY = 10
BACKUPS_TRIED = 3


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def is_expired(last_activity: Column, as_of: Column, minutes: int = TIMEOUT_MINUTES) -> Column:
    """Strictly more than the timeout since the last activity."""
    return micros(as_of) - micros(last_activity) > minutes * 60 * 1_000_000


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Newest row per key as one ``max_by``; combines before the shuffle."""
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")
    ).select(*keys, "_r.*")


def conversation_stats(conversations: DataFrame, as_of: Column) -> DataFrame:
    """Per state and in total (state null): how many, how many expired."""
    return conversations.rollup("state").agg(
        F.count(F.lit(1)).alias("n_conversations"),
        F.count_if(is_expired(F.col("last_activity"), as_of)).alias("n_expired"),
    )


def consecutive_runs(outcomes: DataFrame, key: str, order: list[str], **slicing) -> DataFrame:
    """Consecutive failures and successes up to and including each row."""
    runs = {"consecutive_failures": ~F.col("ok"), "consecutive_successes": F.col("ok")}
    return since_reset(outcomes, [key], order, runs, **slicing)


def transition_log(events: DataFrame, keys: list[str], order: list[str], **slicing) -> DataFrame:
    """Old and new state per event, and how long the new state lasted."""
    out = neighbours(
        events, keys, order, previous={"old_state": "state"}, following={"next_ts": "ts"}, **slicing
    )
    seconds = (micros(F.col("next_ts")) - micros(F.col("ts"))) / 1_000_000
    return out.withColumn("duration_s", seconds).withColumn(
        "changed", ~F.col("old_state").eqNullSafe(F.col("state"))
    )


def retry_to_error(
    events: DataFrame, keys: list[str], order: list[str], limit: int = MAX_RETRY_ATTEMPTS, **slicing
) -> DataFrame:
    """Errors since the last success; ERROR at the limit or when the error is not recoverable."""
    out = since_reset(events, keys, order, {"retry_count": ~F.col("ok")}, **slicing)
    fatal = ~F.col("ok") & ((F.col("retry_count") >= limit) | ~F.coalesce("recoverable", F.lit(True)))
    return out.withColumn("to_error", fatal)


def latest_version(versions: DataFrame, key: str = "session_id") -> DataFrame:
    """Newest version if readable, else the newest readable among the three newest backups.

    Every tenth version is a backup. The backup rank is limited to three before the shuffle.
    """
    current = versions.groupBy(key).agg(
        F.max_by(F.struct("version", "readable"), "version").alias("c")
    )
    w = Window.partitionBy(key).orderBy(F.col("version").desc())
    backups = (
        versions.filter(F.col("version") % BACKUP_EVERY == 0)
        .select(key, "version", "readable")
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= BACKUPS_TRIED)
        .filter("readable")
        .groupBy(key)
        .agg(F.max("version").alias("backup"))
    )
    picked = F.when(F.col("c.readable"), F.col("c.version")).otherwise(F.col("backup"))
    return current.join(backups, key, "left").select(
        key, picked.alias("version"), (~F.col("c.readable")).alias("from_backup")
    )


def load_state_layered(states: DataFrame, key: str, layers: list[str], columns: list[str]) -> DataFrame:
    """The first layer that holds a key wins."""
    rank = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))
    return states.filter(F.col("layer").isin(layers)).groupBy(key).agg(
        F.min_by(F.struct("layer", *columns), F.struct(rank, *columns)).alias("_r")
    ).select(key, "_r.*")


def evict_lru(states: DataFrame, key: str, last_access: str, capacity: int = 10_000) -> DataFrame:
    """Rows of the most recently used keys; the kept keys are bounded by the capacity."""
    used = states.groupBy(key).agg(F.max(last_access).alias("_a"))
    kept = used.orderBy(F.col("_a").desc(), key).limit(capacity).select(key)
    return states.join(F.broadcast(kept), key, "left_semi")


def active_sessions(versions: DataFrame, key: str = "session_id") -> DataFrame:
    return latest_version(versions, key).filter(F.col("version").isNotNull())
