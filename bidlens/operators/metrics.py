"""Ranking and calibration of predicted click probabilities.

All measures start from one table, the *score table*: rows and positives per
different score (and group).  It is built with one hash aggregate over the
predictions, and everything after it works on different scores only, so copies
and ties cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.functions import probability as prob
from bidlens.operators.prefix import join_null_safe, pick_quantiles, running_totals
from bidlens.session import materialize

SCORE = "_p"


def score_table(predictions: DataFrame, score: str, label: str = "y_true",
                groups: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Rows (``n``) and positives (``pos``) per score; ``extra`` columns are summed."""
    return predictions.groupBy(*groups, F.col(score).alias(SCORE)).agg(
        F.count("*").alias("n"), F.sum(label).alias("pos"),
        *[F.sum(c).alias(c) for c in extra])


def ranked_scores(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The score table with running rows and running negatives in score order.

    Stored, because areas, edges, bins and losses are all read off it.
    """
    scores = scores.withColumn("neg", F.col("n") - F.col("pos"))
    return materialize(running_totals(
        scores, [SCORE], {"n_upto": "n", "neg_upto": "neg"}, groups, "scores"), "ranked-scores")


def auc_from_ranked(ranked: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; ties count half.

    Where one class is missing the area is undefined: NULL, with the reason.
    """
    neg_below = (F.col("neg_upto") - F.col("neg")).cast("double")
    credit = F.col("pos") * (neg_below + F.lit(0.5) * F.col("neg"))
    sums = ranked.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_positive"), F.sum("neg").alias("_neg"),
        F.sum(credit).alias("_credit"))
    pos, neg = F.col("n_positive"), F.col("_neg")
    reason = F.when(pos == 0, "zero positives").when(neg == 0, "zero negatives")
    area = F.when((pos > 0) & (neg > 0), F.col("_credit") / (pos.cast("double") * neg.cast("double")))
    return sums.select(*groups, "n", "n_positive", area.alias("auc"), reason.alias("undefined_reason"))


def auc(predictions: DataFrame, score: str, label: str = "y_true",
        groups: Sequence[str] = ()) -> DataFrame:
    return auc_from_ranked(ranked_scores(score_table(predictions, score, label, groups), groups), groups)


def auc_means(by_group: DataFrame) -> DataFrame:
    """Row-weighted and plain mean over the groups whose area is defined."""
    defined = by_group.where(F.col("auc").isNotNull())
    return defined.agg(F.count("*").alias("n_groups"),
                       (F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("row_weighted_auc"),
                       F.avg("auc").alias("simple_auc"))


def log_loss(predictions: DataFrame, score: str, label: str = "y_true") -> DataFrame:
    p = prob.clip(F.col(score))
    return predictions.agg(F.avg(prob.log_loss_term(F.col(label), p)).alias("log_loss"))


def bin_edges(ranked: DataFrame, n_bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """Edges of bins with equal counts, per group; repeated edges collapse."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    picked = pick_quantiles(ranked, SCORE, "n", "n_upto", probs, groups)
    return picked.select(*groups, F.array_distinct("quantiles").alias("edges"))


def binned(ranked: DataFrame, n_bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """Adds ``bin`` and the array ``edges``, those of the row's group.

    Bins are closed on the right and the first one includes its lower edge, so a
    score's bin is the number of edges below it.  The comparisons are written out,
    which keeps them inside generated code.
    """
    below = " + ".join(f"coalesce(int(get(edges, {i}) < {SCORE}), 0)" for i in range(n_bins + 1))
    if groups:  # a row per group; stored, so that its size decides how it is joined
        with_edges = join_null_safe(ranked, materialize(bin_edges(ranked, n_bins, groups), "bin-edges"), groups)
    else:
        with_edges = ranked.withColumn("edges", bin_edges(ranked, n_bins).scalar())
    return with_edges.withColumn("bin", F.expr(f"greatest(1, {below})"))


def reliability_bins(ranked: DataFrame, n_bins: int = 10, groups: Sequence[str] = ()) -> DataFrame:
    """Per group and bin: rows, mean predicted and observed rate, score range, gap and weight within the group.

    ``ratio`` is predicted over observed; a bin without positives has NULL there
    and the reason in ``ratio_note``.
    """
    n, p = F.col("n"), F.col(SCORE)
    bins = binned(ranked, n_bins, groups).groupBy(*groups, "bin").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_positive"),
        (F.sum(p * n) / F.sum(n)).alias("mean_predicted"),
        (F.sum("pos") / F.sum(n)).alias("mean_actual"),
        F.min(p).alias("prob_min"), F.max(p).alias("prob_max"))
    # A group has at most ``n_bins`` rows by now.
    total = F.sum("n").over(Window.partitionBy(*groups)) if groups else ranked.agg(F.sum("n")).scalar()
    return bins.withColumns({
        "abs_gap": F.abs(F.col("mean_predicted") - F.col("mean_actual")),
        "weight": F.col("n") / total,
        "ratio": prob.ratio_or_null(F.col("mean_predicted"), F.col("mean_actual")),
        "ratio_note": prob.ratio_note(F.col("n_positive"))})


def calibration_error(bins: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return bins.groupBy(*groups).agg(F.sum(F.col("abs_gap") * F.col("weight")).alias("ece"))


def reliability_curve(bins: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Points and axis bounds for a log-log reliability plot (zeros lifted to ``floor``)."""
    x = F.greatest(F.col("mean_predicted"), F.lit(floor))
    y = F.greatest(F.col("mean_actual"), F.lit(floor))
    points = bins.select("bin", x.alias("x"), y.alias("y"), "n")
    bounds = points.agg(F.least(F.min("x"), F.min("y")).alias("lo"),
                        F.greatest(F.max("x"), F.max("y")).alias("hi"))
    return points.withColumns({"lo": bounds.select("lo").scalar(), "hi": bounds.select("hi").scalar()})


def matched_edge_bins(predictions: DataFrame, before: str, after: str, label: str = "y_true",
                      n_bins: int = 10, groups: Sequence[str] = ()) -> DataFrame:
    """Before/after calibration over the very same rows per bin, per group.

    Bins come from ``before`` alone; both means are taken over them.
    """
    sums = predictions.select(*groups, F.col(before), F.col(label), F.col(after).alias("_after"))
    ranked = ranked_scores(score_table(sums, before, label, groups, extra=["_after"]), groups)
    n, p = F.col("n"), F.col(SCORE)
    bins = binned(ranked, n_bins, groups).groupBy(*groups, "bin", "edges").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_positive"),
        (F.sum("pos") / F.sum(n)).alias("observed_rate"),
        (F.sum(p * n) / F.sum(n)).alias("mean_before"),
        (F.sum("_after") / F.sum(n)).alias("mean_after"))
    return bins.withColumns({
        "ratio_before": prob.ratio_or_null(F.col("mean_before"), F.col("observed_rate")),
        "ratio_after": prob.ratio_or_null(F.col("mean_after"), F.col("observed_rate")),
        "ratio_note": prob.ratio_note(F.col("n_positive")),
        "edge_low": F.expr("get(edges, bin - 1)"),
        "edge_high": F.expr("coalesce(get(edges, bin), get(edges, bin - 1))")}).drop("edges")


def calibration_deviation(bins: DataFrame, ratios: Sequence[str] = ("ratio",)) -> DataFrame:
    """Mean distance of predicted/observed from 1, over bins where it is defined."""
    return bins.agg(*[F.avg(F.abs(F.col(r) - 1)).alias(f"mad_{r}") for r in ratios])


def evaluate(predictions: DataFrame, score_raw: str, *, model: str, split: str, sampling_rate: float = 1.0,
             n_bins: int = 10, label: str = "y_true", groups: Sequence[str] = ()) -> DataFrame:
    """The evaluation record of a model on a split: one row, or one per group with edges of its own.

    Raw scores are recalibrated and clipped first; every figure of every group then
    comes from one ranked score table.
    """
    p = prob.clip(prob.recalibrate(F.col(score_raw), sampling_rate))
    scored = predictions.select(*groups, F.col(label), p.alias("_score"))
    ranked = ranked_scores(score_table(scored, "_score", label, groups), groups)
    return evaluation_from_ranked(ranked, model, split, sampling_rate, n_bins, groups)


def evaluation_from_ranked(ranked: DataFrame, model: str, split: str, sampling_rate: float,
                           n_bins: int, groups: Sequence[str] = ()) -> DataFrame:
    area = auc_from_ranked(ranked, groups)
    loss = ranked.groupBy(*groups).agg((F.sum(-F.col("pos") * F.log(SCORE) - F.col("neg") * F.log(1 - F.col(SCORE)))
                                        / F.sum("n")).alias("log_loss"))
    ece = calibration_error(reliability_bins(ranked, n_bins, groups), groups)
    if groups:
        figures = join_null_safe(join_null_safe(area, loss, groups), ece, groups)
    else:
        figures = area.withColumns({"log_loss": loss.scalar(), "ece": ece.scalar()})
    return figures.select(
        *groups, F.lit(model).alias("model"), F.lit(split).alias("split"),
        F.col("n").alias("n_rows"), "n_positive",
        prob.safe_ratio(F.col("n_positive"), F.col("n")).alias("positive_rate"),
        F.lit(float(sampling_rate)).alias("sampling_rate"), "auc", "log_loss", "ece", F.lit(n_bins).alias("n_bins"))


def precision_at(predictions: DataFrame, score: str, thresholds: Sequence[float],
                 label: str = "y_true") -> DataFrame:
    """Rows, positives and precision strictly above each threshold, in one scan."""
    parts = []
    for i, t in enumerate(thresholds):
        above = F.col(score) > F.lit(float(t))
        parts += [F.count_if(above).alias(f"n{i}"),
                  F.coalesce(F.sum(F.when(above, F.col(label))), F.lit(0)).alias(f"pos{i}")]
    row = predictions.agg(*parts)
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n"),
                 F.col(f"pos{i}").alias("n_positive")) for i, t in enumerate(thresholds)])).alias("r"))
    return long.select("r.*").withColumn(
        "precision", prob.safe_ratio(F.col("n_positive"), F.col("n")))


def most_confident(predictions: DataFrame, score: str, k: int, keys: Sequence[str]) -> DataFrame:
    """The ``k`` highest scores (a top-k report), ties in key order."""
    return predictions.orderBy(F.desc(score), *keys).limit(k)


def auc_standard_error(areas: DataFrame) -> DataFrame:
    """Hanley-McNeil standard error and 95% interval for rows with ``auc, n, n_positive``."""
    a, pos = F.col("auc"), F.col("n_positive").cast("double")
    neg = (F.col("n") - F.col("n_positive")).cast("double")
    q1, q2 = a / (F.lit(2.0) - a), F.lit(2.0) * a * a / (F.lit(1.0) + a)
    variance = (a * (1 - a) + (pos - 1) * (q1 - a * a) + (neg - 1) * (q2 - a * a)) / (pos * neg)
    with_se = areas.withColumn("se", F.when(a.isNotNull(), F.sqrt(variance)))
    return with_se.withColumns({"ci_low": F.col("auc") - 1.96 * F.col("se"),
                                "ci_high": F.col("auc") + 1.96 * F.col("se")})


def auc_difference(with_se: DataFrame, bucket: str, first: str, second: str) -> DataFrame:
    """``first`` minus ``second`` as independent samples: difference, error, z and p."""
    def value(name: str, column: str) -> Column:
        return F.max(F.when(F.col(bucket) == name, F.col(column)))

    pair = with_se.agg((value(first, "auc") - value(second, "auc")).alias("difference"),
                       F.sqrt(F.pow(value(first, "se"), 2) + F.pow(value(second, "se"), 2)).alias("se"))
    z = F.col("difference") / F.col("se")
    return pair.select("difference", "se", (F.col("difference") - 1.96 * F.col("se")).alias("ci_low"),
                       (F.col("difference") + 1.96 * F.col("se")).alias("ci_high"),
                       z.alias("z"), prob.normal_tail(z).alias("p_value"))


def metric_deltas(before: DataFrame, after: DataFrame, keys: Sequence[str],
                  metrics: Sequence[str] = ("auc", "log_loss", "ece")) -> DataFrame:
    """Two sets of records side by side with their differences."""
    left = before.select(*keys, *[F.col(m).alias(f"{m}_before") for m in metrics])
    right = after.select(*keys, *[F.col(m).alias(f"{m}_after") for m in metrics])
    joined = join_null_safe(left, right, keys) if keys else left.withColumns(
        {f"{m}_after": right.select(f"{m}_after").scalar() for m in metrics})
    return joined.withColumns({f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in metrics})


def metrics_reproduce(found: DataFrame, recorded: DataFrame, metrics: Sequence[str] = ("auc", "log_loss", "ece"),
                      tolerance: float = 1e-9) -> DataFrame:
    """One row per metric: recorded, found, and whether they agree within ``tolerance``."""
    one = found.select(*metrics)
    wanted = {m: recorded.select(m).scalar() for m in metrics}
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("found"), wanted[m].alias("recorded"))
        for m in metrics])).alias("r")).select("r.*")
    return rows.withColumn("agrees", F.abs(F.col("found") - F.col("recorded")) <= tolerance)
