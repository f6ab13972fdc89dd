"""Predictions: sites, pockets and classification metrics.

Curves first count by distinct score, so running totals go over distinct scores, not rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.tables import local_table
from strandlake.operators.structure import distance, nearest


def top_sites(scores: DataFrame, threshold: float = 0.5, top_n: int = 0) -> DataFrame:
    """Scores (grp, id, y_proba) at or over the threshold, best first, with rank and the group's total."""
    own = Window.partitionBy("grp")
    rows = scores.withColumn("total", F.count("*").over(own)).where(F.col("y_proba") >= threshold)
    ranked = rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc("y_proba"), "id")))
    return (ranked.where(F.col("rank") <= top_n) if top_n else ranked).select("grp", "id", "y_proba", "rank", "total")


def pocket_clusters(sites: DataFrame, gap: int = 6) -> DataFrame:
    """(structure_id, pocket, chain, size, first, last): runs of resi without a step over gap, by chain."""
    order = Window.partitionBy("structure_id").orderBy("resi", "chain")
    new = F.coalesce((F.col("resi") - F.lag("resi").over(order) > gap).cast("int"), F.lit(1))
    numbered = sites.withColumn("new", new).withColumn("pocket", F.sum("new").over(order))
    return numbered.groupBy("structure_id", "pocket", "chain").agg(F.count("*").alias("size"), F.min("resi").alias("first"), F.max("resi").alias("last"))


def confidence_scale(scores: DataFrame) -> DataFrame:
    own = Window.partitionBy("grp")
    low, high = F.min("y_proba").over(own), F.max("y_proba").over(own)
    return scores.withColumn("scaled", (F.col("y_proba") - low) / F.when(high > low, high - low).otherwise(0.01)).select("grp", "id", "scaled")


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_metrics(scores: DataFrame, threshold: float | Column = 0.5, by: str | None = None) -> DataFrame:
    """Counts and rates of y_proba >= threshold against y_true, of all rows or of each group."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    p, y = F.col("y_proba") >= threshold, F.col("y_true") == 1
    counts = scores.groupBy(*([by] if by else [])).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall, specificity = _safe(tp, tp + fp), _safe(tp, tp + fn), _safe(tn, tn + fp)
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumns({
        "accuracy": _safe(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall, "f1": _safe(2 * precision * recall, precision + recall),
        "mcc": _safe(tp * tn - fp * fn, root), "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2,
    })


#: Ranges of scores that running totals are taken over side by side.
RANGES = 200


def by_score(scores: DataFrame) -> DataFrame:
    """(y_proba, pos, neg, tp, fp, P, N): counts at each distinct score and running totals from the top.

    Distinct scores are cut into ranges at quantiles; totals run within a range, and what the ranges above it
    hold (a few numbers) is added, so no task sees all scores."""
    own = scores.groupBy("y_proba").agg(F.sum("y_true").cast("double").alias("pos"), F.sum(1 - F.col("y_true")).cast("double").alias("neg"))
    bounds = own.agg(F.percentile_approx("y_proba", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).first()[0]
    ranged = own.withColumn("_range", F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds or []))]).cast("array<double>"), lambda b: b < F.col("y_proba"))), F.lit(0)))
    sums = {r["_range"]: (r.pos, r.neg) for r in ranged.groupBy("_range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}  # RANGES rows at most
    above, tp, fp = [], 0.0, 0.0
    for k in sorted(sums, reverse=True):
        above.append((k, tp, fp))
        tp, fp = tp + sums[k][0], fp + sums[k][1]
    before = F.broadcast(local_table(scores.sparkSession, above, "_range int, _tp double, _fp double"))
    down = Window.partitionBy("_range").orderBy(F.desc("y_proba")).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(before, "_range").withColumns({"tp": F.sum("pos").over(down) + F.col("_tp"), "fp": F.sum("neg").over(down) + F.col("_fp"), "P": F.lit(tp), "N": F.lit(fp)})
    return joined.drop("_range", "_tp", "_fp")


def roc_curve(scores: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, with the origin (threshold null)."""
    points = by_score(scores).select(F.col("y_proba").alias("threshold"), _safe(F.col("fp"), F.col("N")).alias("fpr"), _safe(F.col("tp"), F.col("P")).alias("tpr"))
    origin = scores.limit(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.union(origin)


def roc_auc(scores: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half. counts: by_score of the scores, if at hand."""
    c = (by_score(scores) if counts is None else counts).withColumn("won", F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2))
    return c.agg(_safe(F.sum("won"), F.max("P") * F.max("N")).alias("roc_auc"))


def pr_curve(scores: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(threshold, precision, recall) at each distinct score, and the closing point (null, 1, 0)."""
    c = by_score(scores) if counts is None else counts
    points = c.select(F.col("y_proba").alias("threshold"), _safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _safe(F.col("tp"), F.col("P")).alias("recall"))
    return points.union(scores.limit(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def average_precision(scores: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    c = by_score(scores) if counts is None else counts
    return c.agg(_safe(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("P")).alias("average_precision"))


def best_threshold(scores: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The threshold of the greatest 2PR / (P + R + 1e-8), the smallest on ties."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8)
    own = pr_curve(scores, counts).withColumn("f1", f1)
    return own.agg(F.coalesce(F.max_by("threshold", F.struct("f1", -F.coalesce("threshold", F.lit(0.5)))), F.lit(0.5)).alias("threshold"), F.max("f1").alias("f1"))


def topk_accuracy(scores: DataFrame, k: int = 10) -> DataFrame:
    """Positives among the k best of each group over the most there could be; 0 without positives."""
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("y_proba"), F.desc("id")))
    own = scores.withColumn("rank", rank).groupBy("grp").agg(F.sum("y_true").alias("P"), F.count_if((F.col("rank") <= k) & (F.col("y_true") == 1)).alias("hits"))
    return own.select("grp", F.when(F.col("P") > 0, F.col("hits") / F.least("P", F.lit(k))).otherwise(0.0).alias("topk"))


def distance_to_center(predicted: DataFrame, true: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Per structure the mean distance from a prediction to the nearest true place, and the share within the
    threshold; infinite and 0 if the structure lacks either. A place without a coordinate is at no distance, one with NaN
    is farther than any other, as in SQL; so is one at infinity, but from places that are not."""
    place = lambda rows, *name: rows.select("structure_id", *name, "x", "y", "z").where("x is not null and y is not null and z is not null")
    finite = reduce(and_, [F.abs(F.col(c)) < float("inf") for c in "xyz"])  # NaN is greater than infinity
    asked, known = place(predicted, F.col("id").alias("idx")), place(true, F.xxhash64("x", "y", "z").alias("idx"))
    near = nearest(asked.where(finite), known.where(finite), 1).select("structure_id", "idx", F.col("distance").alias("d"))
    # a distance that is not finite depends only on which coordinates are not, so few kinds of true places are met
    kinds = known.select("structure_id", *[F.when(F.abs(F.col(c)) < float("inf"), 0.0).otherwise(F.col(c)).alias(f"r_{c}") for c in "xyz"]).distinct()
    far = asked.join(kinds, "structure_id").withColumn("d", distance()).where(~finite | ~(F.col("d") < float("inf"))).select("structure_id", "idx", "d")
    each = near.union(far).groupBy("structure_id", "idx").agg(F.min("d").alias("d"))
    found = each.groupBy("structure_id").agg(F.avg("d").alias("mean"), F.avg((F.col("d") <= threshold).cast("double")).alias("within"))
    every = predicted.select("structure_id").union(true.select("structure_id")).distinct()
    return every.join(found, "structure_id", "left").select("structure_id", F.coalesce("mean", F.lit(float("inf"))).alias("mean"), F.coalesce("within", F.lit(0.0)).alias("within"))


def site_coverage(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """Per structure the share of true sites (structure_id, id) that are predicted."""
    hit = true.join(predicted.select("structure_id", "id", F.lit(1).alias("hit")), ["structure_id", "id"], "left")
    return hit.groupBy("structure_id").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("coverage"))


def cross_validation_summary(metrics: DataFrame) -> DataFrame:
    """(metric, mean, std, min, max) over folds of rows (fold, metric, value)."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def evaluate(scores: DataFrame) -> DataFrame:
    """One row: best threshold, all metrics at it, ROC AUC and average precision."""
    counts = by_score(scores)
    best = best_threshold(scores, counts).select("threshold")
    at = scores.crossJoin(F.broadcast(best))
    return classification_metrics(at, F.col("threshold"), "threshold").crossJoin(roc_auc(scores, counts)).crossJoin(average_precision(scores, counts))


def loss_report(logits: DataFrame, pos_weight: float = 5.0, alpha: float = 0.25, gamma: float = 2.0, smooth: float = 1.0, alpha_t: float = 0.3, beta_t: float = 0.7) -> DataFrame:
    """Weighted cross-entropy, focal, Dice, Tversky and combined (0.3 and 0.7) losses over rows (y_true, logit)."""
    x, y = F.col("logit"), F.col("y_true").cast("double")
    p = 1 / (1 + F.exp(-x))
    soft = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    plain = (1 - y) * x + soft
    weighted = (1 - y) * x + (1 + (pos_weight - 1) * y) * soft
    pt = F.when(y == 1, p).otherwise(1 - p)
    s = logits.agg(
        F.avg(weighted).alias("bce"), F.avg(alpha * F.pow(1 - pt, F.lit(gamma)) * plain).alias("focal"), F.sum(p * y).alias("i"), F.sum(p).alias("sp"), F.sum(y).alias("sy"))
    i, fp, fn = F.col("i"), F.col("sp") - F.col("i"), F.col("sy") - F.col("i")
    dice = 1 - (2 * i + smooth) / (F.col("sp") + F.col("sy") + smooth)
    return s.select("bce", "focal", dice.alias("dice"), (1 - (i + smooth) / (i + alpha_t * fp + beta_t * fn + smooth)).alias("tversky"), (0.3 * F.col("bce") + 0.7 * dice).alias("combined"))


def split_dataset(rows: DataFrame, key: str, train: int = 8, validation: int = 1) -> DataFrame:
    """rows plus part (train, validation or test) by the key modulo 10."""
    band = F.pmod(F.col(key), F.lit(10))
    return rows.withColumn("part", F.when(band < train, "train").when(band < train + validation, "validation").otherwise("test"))
