"""Retrieval metrics by case and suite, and the gate against thresholds and a baseline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import NAMESPACE, document_id

#: Metrics of which less is better, and those that no baseline is held against.
LOWER_IS_BETTER = ("error_rate", "abstention_rate", "degradation_rate", "latency_p50_ms", "latency_p95_ms", "total_cost_usd", "mean_cost_usd")
NOT_COMPARED = ("latency_p50_ms", "latency_p95_ms", "total_cost_usd", "mean_cost_usd")


def evaluation_ranking(items: DataFrame) -> DataFrame:
    """(query_id, score, ordinal, ...) with rank: by score, ties in the order of the prompt."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")) - 1)


def case_metrics(ranking: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Metrics of each case with expectations.

    ``ranking``: query_id, item_id, rank (from 0), included. ``expected``:
    query_id, item_id, distinct. An errored case has no ranking, and zeros.
    """
    rel = ranking.join(expected.select("query_id", "item_id", F.lit(1).alias("rel")), ["query_id", "item_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    top = F.col("rank") < k
    per = rel.groupBy("query_id").agg(
        F.max(F.when(top, F.col("rel")).otherwise(0)).cast("double").alias("hit_rate"),
        (F.sum(F.when(top, F.col("rel")).otherwise(0)) / k).alias("precision"),
        F.count_distinct(F.when(top & (F.col("rel") == 1), F.col("item_id"))).alias("found"),
        F.count_distinct(F.when(F.col("rel") == 1, F.col("item_id"))).alias("found_anywhere"),
        F.coalesce(1 / (F.min(F.when(F.col("rel") == 1, F.col("rank"))) + 1), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(top & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 2)).otherwise(0.0)).alias("dcg"),
        F.sum("rel").alias("relevant"),
        F.coalesce(F.avg(F.when(F.col("included"), F.col("rel"))), F.lit(0.0)).alias("context_precision"),
    )
    wanted = expected.groupBy("query_id").agg(F.count_distinct("item_id").alias("n_expected"))
    both = wanted.join(per, "query_id", "left")
    ideal_n = F.least(F.lit(k), F.col("relevant") + F.col("n_expected") - F.col("found_anywhere"))
    ideal = F.aggregate(F.sequence(F.lit(0), F.greatest(F.coalesce(ideal_n, F.lit(1)), F.lit(1)).cast("int") - 1), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 2))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "query_id",
        zero(F.col("hit_rate")).alias(f"hit_rate@{k}"),
        zero(F.col("precision")).alias(f"precision@{k}"),
        zero(F.col("found") / F.col("n_expected")).alias(f"recall@{k}"),
        zero(F.col("mrr")).alias("mrr"),
        zero(F.when(ideal_n > 0, F.col("dcg") / ideal)).alias(f"ndcg@{k}"),
        zero(F.col("context_precision")).alias("context_precision"),
    )


def suite_metrics(cases: DataFrame) -> DataFrame:
    """(metric, value): the mean of each metric over the labelled cases."""
    metrics = [c for c in cases.columns if c != "query_id"]
    means = cases.agg(*[F.avg(c).alias(c) for c in metrics])
    return means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in metrics])).alias("m")).select("m.*")


#: So many different values are looked at on the driver; a range of more is cut down first. The sketch's error in rank.
FEW_VALUES, RANK_ERROR = 10_000, 1e-3


def order_statistics(rows: DataFrame, column: str, ranks: list[int], few: int = FEW_VALUES, error: float = RANK_ERROR) -> dict[int, float]:
    """The values at some ranks (from 0) among the values of a column that are not null; exact, and no group holds them all.

    For each rank, sketches give a range of values that surely holds it, counts
    say how many values are below, and the range is cut down again until it has
    few different values. Of those, the driver gets counts.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    out: dict[int, float] = {}
    for k in sorted(set(ranks)):
        inside, below = values, 0
        while True:
            counts = inside.groupBy("v").count().orderBy("v").limit(few + 1).collect()
            if len(counts) <= few:
                break
            m = inside.count()
            at = (k - below) / m
            lo, hi = inside.approxQuantile("v", [max(0.0, at - 2 * error), min(1.0, at + 2 * error)], error)
            under, ends = inside.agg(F.count_if(F.col("v") < lo), F.struct(F.count_if(F.col("v") == lo).alias("lo"), F.count_if(F.col("v") <= hi).alias("upto"), F.count_if(F.col("v") == hi).alias("hi"))).first()
            for value, first, n in ((lo, under, ends.lo), (hi, ends.upto - ends.hi, ends.hi)):
                if below + first <= k < below + first + n:
                    out[k] = value
            if k in out:
                break
            # neither end is the value, so it is between them: each cut leaves fewer
            inside, below = inside.where((F.col("v") > lo) & (F.col("v") < hi)), below + under + ends.lo
        for r in counts if k not in out else []:
            if below <= k < below + r["count"]:
                out[k] = r.v
                break
            below += r["count"]
    return out


def percentile_latency(rows: DataFrame, column: str, **limits) -> DataFrame:
    """The median and the interpolated 95th percentile; 0 without rows."""
    n = rows.where(F.col(column).isNotNull()).count()
    places = {q: q * (n - 1) for q in (0.5, 0.95)}
    ranks = [r for at in places.values() for r in (math.floor(at), math.ceil(at))] if n else []
    found = order_statistics(rows, column, ranks, **limits)
    p = [found[math.floor(at)] + (at - math.floor(at)) * (found[math.ceil(at)] - found[math.floor(at)]) if n else 0.0 for at in places.values()]
    return rows.sparkSession.createDataFrame([tuple(p)], "p50 double, p95 double")


def poisoned_sum(cost: Column) -> Column:
    """The sum, or null where any row's cost is unknown."""
    return F.when(F.count(F.lit(1)) == F.count(cost), F.sum(cost))


def case_costs(cases: DataFrame) -> DataFrame:
    """(cost_usd, errored) -> total and mean: unknown if that of any case without an error is; the mean is over all cases."""
    known = F.count_if(~F.col("errored") & F.col("cost_usd").isNull()) == 0
    total = F.when(known, F.coalesce(F.sum(F.when(~F.col("errored"), F.col("cost_usd"))), F.lit(0.0)))
    return cases.agg(total.alias("total_cost_usd"), (total / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("mean_cost_usd"))


def rate(flag: Column) -> Column:
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def lower_is_better(metric: Column) -> Column:
    return metric.isin(*LOWER_IS_BETTER)


def threshold_failures(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, threshold, value) of the thresholds that aren't met; a metric that is missing isn't."""
    rows = thresholds.join(metrics, "metric", "left")
    met = F.when(lower_is_better(F.col("metric")), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return rows.where(~F.coalesce(met, F.lit(False))).select("metric", "threshold", "value")


def regressions(metrics: DataFrame, baseline: DataFrame, tolerance: float = 0.02, judge_metrics: tuple[str, ...] = (), same_judge: bool = True) -> DataFrame:
    """(metric, baseline, value, change) of metrics that are worse than the baseline by more than the tolerance."""
    skipped = [*NOT_COMPARED, *(() if same_judge else judge_metrics)]
    rows = metrics.join(baseline, "metric").where(~F.col("metric").isin(*skipped) & F.col("value").isNotNull() & F.col("baseline").isNotNull())
    change = F.col("value") - F.col("baseline")
    worse = F.when(lower_is_better(F.col("metric")), change).otherwise(-change)
    return rows.where(worse > tolerance).select("metric", "baseline", "value", change.alias("change"))


def resolved_documents(expected: Column, namespace: str = NAMESPACE) -> Column:
    """Expected documents as ids, each once: ``source:path`` is resolved, a ``doc_`` id or a plain name is as it is."""
    own = lambda v: v.startswith("doc_") | ~v.contains(":")
    return F.array_distinct(F.transform(expected, lambda v: F.when(own(v), v).otherwise(document_id(F.substring_index(v, ":", 1), F.regexp_replace(v, "^[^:]*:", ""), namespace))))


def judge_means(scores: DataFrame, judge_metrics: tuple[str, ...] = ("faithfulness", "answer_relevance")) -> DataFrame:
    """(metric, value) of the judged metrics that any case has a score for."""
    return scores.where(F.col("metric").isin(*judge_metrics)).groupBy("metric").agg(F.avg("score").alias("value"))


def case_regressions(cases: DataFrame, baseline: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(query_id, metric, baseline, value) of the single cases that are worse than their baseline by more than the tolerance."""
    rows = cases.join(baseline, ["query_id", "metric"])
    change = F.col("value") - F.col("baseline")
    return rows.where(F.when(lower_is_better(F.col("metric")), change).otherwise(-change) > tolerance).select("query_id", "metric", "baseline", "value")


def gate(metrics: DataFrame, thresholds: DataFrame, baseline: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One row: passed, and how many thresholds and aggregates failed. Regressions of single cases don't count."""
    failed, worse = threshold_failures(metrics, thresholds), regressions(metrics, baseline, tolerance)
    rows = failed.select(F.lit(1).alias("f"), F.lit(0).alias("r")).unionByName(worse.select(F.lit(0).alias("f"), F.lit(1).alias("r")))
    sums = rows.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("failures"), F.coalesce(F.sum("r"), F.lit(0)).alias("regressions"))
    return sums.select((F.col("failures") + F.col("regressions") == 0).alias("passed"), "failures", "regressions")


def with_tags(cases: DataFrame, tags: list[str]) -> DataFrame:
    return cases.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else cases


def estimated_cost(cases: DataFrame, budget: int, embed_price: float | None, in_price: float | None, out_price: float | None, judge: bool) -> DataFrame:
    """An upper bound of a suite's cost, null without prices."""
    tokens = F.ceil(F.length("query") / 4)
    calls = 3 if judge else 1
    money = (tokens * F.lit(embed_price).cast("double") + calls * ((budget + 200 + tokens) * F.lit(in_price).cast("double") + 400 * F.lit(out_price).cast("double"))) / 1e6
    return cases.agg(F.sum(money).alias("cost_usd"))
