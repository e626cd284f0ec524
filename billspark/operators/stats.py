"""Batch and operating statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.operators.slices import running_totals

ERROR_RATE_LIMIT = 0.01
SLOW_RESPONSE_S = 5.0


def batch_statistics(results: DataFrame) -> DataFrame:
    """Per file type and overall (file_type null); the overall row is there for an empty batch too.

    The overall row adds up the few per-type rows, so the results are read once.
    """
    with_data = F.col("success") & F.col("confidence").isNotNull()
    sums = {
        "total_files": F.count(F.lit(1)),
        "successful": F.count_if("success"),
        "failed": F.count_if(~F.col("success")),
        "_score": F.sum(F.when(with_data, F.col("confidence"))),
        "_scored": F.count_if(with_data),
        "total_ms": F.sum("total_ms"),
    }
    by_type = results.groupBy("file_type").agg(*[v.alias(k) for k, v in sums.items()])
    overall = by_type.agg(*[F.sum(k).alias(k) for k in sums]).withColumn(
        "file_type", F.lit(None).cast("string")
    )
    both = by_type.unionByName(overall)
    n = F.coalesce("total_files", F.lit(0))

    def share(part: str, whole):
        return F.when(whole > 0, F.coalesce(part, F.lit(0)) / whole).otherwise(0.0)

    return both.select(
        "file_type",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_files", "successful", "failed")],
        share("successful", n).alias("success_rate"),
        share("_score", F.coalesce("_scored", F.lit(0))).alias("avg_confidence"),
        F.coalesce("total_ms", F.lit(0)).alias("total_ms"),
        share("total_ms", n).alias("avg_ms"),
    )


def usage_metrics(
    events: DataFrame, kinds: dict[str, Column], user: str = "user_id", exact: bool = True,
) -> DataFrame:
    """Distinct users and one count per named predicate; approximate users where exact is too dear."""
    users = F.countDistinct(user) if exact else F.approx_count_distinct(user)
    return events.agg(
        users.cast("bigint").alias("total_users"), *[F.count_if(p).alias(n) for n, p in kinds.items()]
    )


def operating_kpis(events: DataFrame, by: list | None = None) -> DataFrame:
    """Per hour: messages, success rate, response times, error rate, completion rate.

    Columns: ts, is_message, is_document, ok, response_s, is_error, is_start, is_done.
    """
    n = F.count(F.lit(1))
    docs = F.count_if("is_document")
    starts = F.count_if("is_start")
    return events.groupBy(F.window("ts", "1 hour").alias("w"), *(by or [])).agg(
        n.alias("n_events"),
        F.count_if("is_message").alias("n_messages"),
        F.when(docs > 0, F.count_if(F.col("is_document") & F.col("ok")) / docs).alias("document_success_rate"),
        F.avg("response_s").alias("avg_response_s"),
        F.max("response_s").alias("max_response_s"),
        (F.count_if("is_error") / n).alias("error_rate"),
        F.when(starts > 0, F.count_if("is_done") / starts).alias("completion_rate"),
    ).withColumn("hour", F.col("w.start")).drop("w")


def response_quantiles(
    events: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99), value: str = "response_s", **slicing
) -> DataFrame:
    """``q``, an array of exact quantiles per group: the smallest value at or below which a share of the values lies.

    Values are counted, the counts added up in order over slices (so one group may hold most rows), and the
    first value that reaches each rank is taken. Missing values do not count; a group without any has no quantiles.
    """
    counted = events.groupBy(*by, value).agg(F.count(value).alias("_n"))
    ranked = running_totals(counted.filter(F.col(value).isNotNull()), by, [value], {"_upto": F.col("_n")}, **slicing)
    named = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]  # groups may be missing values too
    totals = ranked.groupBy(*named).agg(F.max("_upto").alias("_all"))
    placed = ranked.join(totals, same)
    ranks = [F.greatest(F.lit(1), F.ceil(F.col("_all") * F.lit(p))) for p in shares]
    firsts = placed.groupBy(*[f"_by{i}" for i in range(len(by))]).agg(
        F.array(*[F.min(F.when(F.col("_upto") >= r, F.col(value))) for r in ranks]).alias("q")
    )
    return events.select(*by).distinct().join(firsts, same, "left").select(*by, "q")


def alert_rules(kpis: DataFrame) -> DataFrame:
    """Warning rows: error rate over 1 %, a response over 5 s."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("error_rate") > ERROR_RATE_LIMIT, "error_rate"),
            F.when(F.col("max_response_s") > SLOW_RESPONSE_S, "slow_response"),
        )
    )
    return kpis.withColumn("alert", F.explode(rules)).select(
        "hour", "alert",
        F.when(F.col("alert") == "error_rate", F.col("error_rate"))
        .otherwise(F.col("max_response_s")).alias("value"),
    )


def ocr_word_filter(words: DataFrame, key: str = "doc_id", minimum: int = 30) -> DataFrame:
    """Words read with more than the minimum confidence, in order, with their mean and number.

    The text of a page of words is the result cell, so a group is no larger than a document.
    """
    kept = words.filter((F.trim("text") != "") & (F.col("conf") > minimum))
    return kept.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("_w"),
        F.avg("conf").alias("confidence"),
        F.count(F.lit(1)).alias("word_count"),
    ).select(
        key, F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"),
        "confidence", "word_count",
    )
