"""Splits, weights, thresholds and ranking metrics on any score column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.config import Config
from hotgrid.functions.exprs import safe_ratio
from hotgrid.operators.medians import medians

GRID = [round(0.05 + 0.01 * i, 2) for i in range(60)]
KS = (0.05, 0.10, 0.15, 0.25, 0.30)


def splits(dates: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(date, split): counted back from the last supervised day, after the warm-up; disjoint by construction."""
    days = dates.select("date").distinct()
    one = Window.partitionBy(F.lit(0))  # at most one row a day of the lookback
    df = days.withColumns({"i": F.row_number().over(one.orderBy("date")), "back": F.row_number().over(one.orderBy(F.desc("date")))})
    upto, split = 0, F.when(F.col("i") <= cfg.warm_up_days, "warm_up")
    for name, n in reversed(cfg.split_days):
        upto += n
        split = split.when(F.col("back") <= upto, name)
    return df.select("date", split.otherwise("unused").alias("split"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    pos, neg = F.sum(F.col(label)), F.sum(1 - F.col(label))
    df = df.where(F.col(label).isNotNull()).agg(pos.alias("n_pos"), neg.alias("n_neg"))
    return df.withColumn("weight", F.least(F.lit(12.0), F.pow(safe_ratio(F.col("n_neg").cast("double"), F.col("n_pos").cast("double"), default=1.0), F.lit(0.7))) * 1.25)


def sample_weight(label: str) -> Column:
    """Weight of a training row: positives that emerge, of low priors or beside a spike count more, 1.75 at most."""
    rise = lambda cond, by: F.when(F.coalesce(cond, F.lit(False)), by).otherwise(1.0)
    w = rise(F.col("local_sudden_activation_3d") > 0, 1.25) * rise(F.coalesce("h3_train_percentile", F.lit(0.0)) < 0.75, 1.35) * rise(F.col("nbr_r1_spike_vs_roll7") > 1.0, 1.15)
    return F.when(F.col(label) == 1, F.greatest(F.lit(1.0), F.least(w, F.lit(1.75)))).otherwise(1.0)


def threshold_grid(df: DataFrame, score: str, label: str, guarded: bool = True, multiplier: float = 2.2) -> DataFrame:
    """F1 at each of 60 thresholds, less a penalty where too much is predicted: one pass over the rows.

    A row is counted once, in the step of its score; sums from above give every threshold.
    """
    step = F.least(F.lit(60), F.greatest(F.lit(0), F.floor((F.round(score, 9) - 0.05) / 0.01 + 1e-6).cast("int") + 1))
    counts = df.where(F.col(label).isNotNull()).groupBy(step.alias("step")).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(GRID)], "step int, threshold double")
    all_steps = grid.join(counts, "step", "full")
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)  # 61 rows
    whole = Window.partitionBy(F.lit(0))
    z = lambda c: F.coalesce(c, F.lit(0))
    df = all_steps.withColumns({"tp": F.sum(z("pos")).over(down), "predicted": F.sum(z("n")).over(down), "p": F.sum(z("pos")).over(whole), "rows": F.sum(z("n")).over(whole)}).where("threshold is not null")
    f1 = safe_ratio(2.0 * F.col("tp"), (F.col("predicted") + F.col("p")).cast("double"))
    rate, base = F.col("predicted") / F.col("rows"), F.col("p") / F.col("rows")
    penalty = 0.35 * F.greatest(F.lit(0.0), rate - F.least(F.lit(0.95), multiplier * base)) if guarded else F.lit(0.0)
    return df.select("threshold", "tp", "predicted", f1.alias("f1"), (f1 - penalty).alias("objective"))


def best_threshold(grid: DataFrame) -> DataFrame:
    """The best objective, ties to the lowest threshold."""
    return grid.agg(F.max(F.struct(F.round("objective", 9).alias("o"), (-F.col("threshold")).alias("t"), "f1")).alias("m")).select((-F.col("m.t")).alias("threshold"), "m.f1", F.col("m.o").alias("objective"))


def ranker_metrics(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """Precision, recall, F1, AUC and average precision, exact, from counts of distinct scores.

    Rows are first counted by score. Running sums go over the distinct scores of one of 1,000 ranges each,
    and what lies in the ranges below is added from a table of the ranges' totals, so that no
    task has all scores. Scores are probabilities; others fall into the first or last range.
    """
    counted = df.where(F.col(label).isNotNull()).groupBy(score).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    counted = counted.withColumn("range", F.greatest(F.lit(0), F.least(F.lit(999), F.floor(F.col(score) * 1000))))
    totals = counted.groupBy("range").agg(F.sum("pos").alias("rp"), F.sum("n").alias("rn"))  # 1,000 rows at most
    one = Window.partitionBy(F.lit(0))
    before, after = one.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), one.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = totals.select("range", over("rn", before).alias("n_before"), over("rp", after).alias("p_after"), over("rn", after).alias("n_after"), F.sum("rp").over(one).alias("p"), F.sum("rn").over(one).alias("rows"))
    up = Window.partitionBy("range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    c = counted.join(F.broadcast(totals), "range").withColumns({"below": F.col("n_before") + over("n", up), "tp": F.col("p_after") + F.sum("pos").over(down), "at": F.col("n_after") + F.sum("n").over(down)})
    ranks = F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2))
    hit = F.col(score) >= threshold
    m = c.agg(
        F.max("p").alias("p"), F.max("rows").alias("rows"), ranks.alias("ranks"), F.sum(F.col("tp") / F.col("at") * F.col("pos")).alias("ap_sum"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("predicted"),
    )
    d = lambda x: x.cast("double")
    p, rows = d(F.col("p")), d(F.col("rows"))
    return m.select(
        safe_ratio(d(F.col("tp")), d(F.col("predicted"))).alias("precision"), safe_ratio(d(F.col("tp")), p).alias("recall"), safe_ratio(2.0 * F.col("tp"), d(F.col("predicted")) + p).alias("f1"),
        safe_ratio(F.col("ranks") - p * (p + 1) / 2, p * (rows - p)).alias("auc"), safe_ratio(F.col("ap_sum"), p).alias("ap"),
        safe_ratio(d(F.col("predicted")), rows).alias("predicted_rate"), safe_ratio(p, rows).alias("base_rate"),
    )


def daily_topk(df: DataFrame, score: str, label: str, ks: tuple[float, ...] = KS) -> DataFrame:
    """Precision, recall and lift of each day's top share, averaged over days; ties by cell."""
    day = Window.partitionBy("date")
    r = df.where(F.col(label).isNotNull()).withColumns({"rank": F.row_number().over(day.orderBy(F.desc(score), "cell")), "n": F.count("*").over(day), "pos": F.sum(label).over(day)})
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    top = r.select("date", "rank", "n", "pos", label, k).where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.round(F.col("k") * F.col("n"), 9))))
    per = top.groupBy("k", "date").agg(F.sum(label).alias("tp"), F.count("*").alias("taken"), F.first("pos").alias("pos"), F.first("n").alias("n"))
    precision, base = F.col("tp") / F.col("taken"), F.col("pos") / F.col("n")
    return per.groupBy("k").agg(F.avg(precision).alias("precision"), F.avg(F.col("tp") / F.greatest(F.lit(1), "pos")).alias("recall"), F.avg(safe_ratio(precision, base)).alias("lift"), F.count("*").alias("days"))


def feature_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, lo, hi, median, constant) of training rows: one pass, those of the exact medians, then one row a feature."""
    middle = medians(df, columns)
    aggs = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi"), F.lit(middle[c]).cast("double").alias("median")).alias(c) for c in columns]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*columns)).alias("f")).select("f.*").withColumn("constant", F.coalesce(F.col("lo") == F.col("hi"), F.lit(True)))


def split_report(frame: DataFrame, needed: int) -> DataFrame:
    """One row: supervised days against those needed, overlap of the splits, mean prior of each split.

    ``frame`` has date, split and h3_train_percentile. A prior that was made of other rows than the training
    rows would differ between the splits, as cells are the same in all.
    """
    days = frame.select("date", "split").distinct()
    counts = days.agg(F.count_distinct("date").alias("days"), (F.count("*") - F.count_distinct("date")).alias("shared_days"))
    mean = lambda k: F.avg(F.when(F.col("split") == k, F.col("h3_train_percentile"))).alias(f"prior_{k}")
    drift = frame.agg(*map(mean, ("train", "val", "test")))
    return counts.crossJoin(drift).withColumns({"enough": F.col("days") >= needed, "disjoint": F.col("shared_days") == 0})


def model_floor(metrics: DataFrame, auc: float = 0.75, f1: float = 0.50) -> DataFrame:
    """The metrics with a verdict: whether the model is as good as one that may be used has to be."""
    return metrics.withColumn("passed", (F.col("auc") >= auc) & (F.col("f1") >= f1))


def error_rows(df: DataFrame, scores: list[str], label: str, threshold: float) -> DataFrame:
    """(scenario, cell, date, score, error): what each score misses (FN) or wrongly predicts (FP)."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(s).alias("score")) for s in scores])).alias("s")
    hit = F.col("s.score") >= threshold
    kind = F.when((F.col(label) == 1) & ~hit, "FN").when((F.col(label) == 0) & hit, "FP")
    return df.where(F.col(label).isNotNull()).select("cell", "date", label, each).select("s.scenario", "cell", "date", "s.score", kind.alias("error")).where("error is not null")


def type_rates(df: DataFrame) -> DataFrame:
    """(split, n, hotspots, violent_rate, property_rate): how often a type leads tomorrow where there is a hotspot."""
    hot = F.col("next_hotspot") == 1
    rate = lambda c: F.avg(F.when(hot, F.col(c))).alias(c.replace("next_", "") + "_rate")
    return df.where("next_total is not null").groupBy("split").agg(F.count("*").alias("n"), F.count_if(hot).alias("hotspots"), rate("next_violent"), rate("next_property"))


def overlap(df: DataFrame, scores: list[str], label: str, threshold: float, blend: str) -> DataFrame:
    """Cells that every single score misses, those only some miss, and those that the blend resolves."""
    missed = [(F.col(label) == 1) & (F.col(s) < threshold) for s in scores]
    per = df.groupBy("cell").agg(*[F.max(m.cast("int")).alias(f"m{i}") for i, m in enumerate(missed)], F.max(((F.col(label) == 1) & (F.col(blend) < threshold)).cast("int")).alias("mb"))
    n = sum(F.coalesce(F.col(f"m{i}"), F.lit(0)) for i in range(len(scores)))
    return per.agg(F.count_if(n == len(scores)).alias("missed_by_all"), F.count_if((n > 0) & (n < len(scores))).alias("missed_by_some"), F.count_if((n > 0) & (F.coalesce("mb", F.lit(0)) == 0)).alias("resolved_by_blend"))
