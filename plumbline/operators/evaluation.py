"""Calibration and evaluation from logits (an array of any length for each row) and labels; all roll-ups combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import binned, let, over, share, six, total_of
from plumbline.functions.labels import CALIBRATION_ERROR, is_clean, label
from plumbline.functions.quantiles import medians, with_median
from plumbline.operators.frames import Frames, relation

#: Temperatures of the fit: GRID between LOW and HIGH, evenly by ratio, then GRID between the neighbours of the best.
LOW, HIGH, GRID = 0.05, 10.0, 64
#: Ranges of scores for each unit of log-odds.
RANGES = 16


def softmax(z: Column, temperature: Column | None = None) -> Column:
    """Probabilities of logits, divided by a temperature (one, or one for each class); a temperature of 0 or less is an error."""
    if temperature is not None:
        wrong = F.raise_error(F.lit("a temperature must be above 0"))
        z = F.transform(z, lambda x: F.when(temperature > 0, x / temperature).otherwise(wrong.cast("double")))
    return _normal(z)


def softmax_by_class(z: Column, temperatures: Column) -> Column:
    wrong = F.raise_error(F.lit("a temperature must be above 0"))
    return _normal(F.zip_with(z, temperatures, lambda x, t: F.when(t > 0, x / t).otherwise(wrong.cast("double"))))


def _normal(z: Column) -> Column:
    e = let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    return let(e, lambda e: let(total_of(e), lambda total: F.transform(e, lambda x: x / total)))


def rescaled(p: Column, temperature: Column) -> Column:
    """Probabilities at another temperature, from probabilities."""
    return softmax(F.transform(p, lambda x: F.ln(F.least(F.lit(1.0), F.greatest(x, F.lit(1e-12))))), temperature)


@relation
def probabilities(r: Frames) -> DataFrame:
    return r.logits.select("sample_id", "model_name", "label", "logits", softmax(F.col("logits")).alias("p"))


@relation
def p2_probabilities(r: Frames) -> DataFrame:
    return r.probabilities.select("sample_id", "model_name", "label", F.posexplode("p").alias("k", "p")).select("sample_id", "model_name", "label", "k", six("p").alias("probability"))


def best_class(p: Column) -> Column:
    """The first of the most likely classes."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


@relation
def predictions(r: Frames) -> DataFrame:
    p = F.col("p")
    return r.probabilities.select("sample_id", "model_name", "label", "p", best_class(p).alias("predicted"), F.array_max(p).alias("confidence"))


@relation
def p4_predictions(r: Frames) -> DataFrame:
    """Class and confidence at the fitted temperature, the raw confidence of the same class, and the class's name."""
    tempered = r.tempered.select("sample_id", "model_name", "label", "predicted", six("confidence").alias("confidence"), six(F.element_at("raw", F.col("predicted") + 1)).alias("raw_confidence"))
    return tempered.withColumn("class_name", F.concat(F.lit("class"), F.col("predicted").cast("string")))


@relation
def tempered(r: Frames) -> DataFrame:
    joined = r.probabilities.join(F.broadcast(r.temperatures), "model_name")
    rows = joined.select("sample_id", "model_name", "label", F.col("p").alias("raw"), softmax(F.col("logits"), F.col("temperature")).alias("p"))
    return rows.select("sample_id", "model_name", "label", "raw", "p", best_class(F.col("p")).alias("predicted"), F.array_max("p").alias("confidence"))


@relation
def p3_rescaled(r: Frames) -> DataFrame:
    """Probabilities taken to the fitted temperature; equal to those of the tempered logits."""
    joined = r.probabilities.join(F.broadcast(r.temperatures), "model_name")
    rows = joined.select("sample_id", "model_name", F.posexplode(rescaled(F.col("p"), F.col("temperature"))).alias("k", "p"))
    return rows.select("sample_id", "model_name", "k", six("p").alias("probability"))


def fitted(logits: DataFrame) -> DataFrame:
    """(model_name, temperature, loss): the temperature of least mean negative log-likelihood.

    Two aggregates over the logits, each with GRID losses for each model; no logits are collected.
    """
    steps = F.sequence(F.lit(0), F.lit(GRID - 1))

    def best(rows: DataFrame, temperatures: Column) -> DataFrame:
        z = F.col("logits")
        at = F.element_at(z, F.col("label") + 1)
        loss = lambda top, t: F.ln(total_of(z, lambda x: F.exp((x - top) / t))) - (at - top) / t
        losses = let(F.array_max(z), lambda top: F.transform(temperatures, lambda t: F.struct(t.alias("t"), loss(top, t).alias("loss"))))
        long = rows.select("model_name", F.posexplode(losses).alias("i", "x"))
        by = long.groupBy("model_name", "i").agg(F.first("x.t").alias("t"), F.avg("x.loss").alias("loss"))
        return by.groupBy("model_name").agg(F.min(F.struct("loss", "t")).alias("b")).select("model_name", F.col("b.t").alias("temperature"), F.col("b.loss").alias("loss"))

    ratio = (HIGH / LOW) ** (1 / (GRID - 1))
    first = best(logits, F.transform(steps, lambda i: F.lit(LOW) * F.pow(F.lit(ratio), i)))
    near = first.select("model_name", F.greatest(F.col("temperature") / ratio, F.lit(LOW)).alias("low"), F.least(F.col("temperature") * ratio, F.lit(HIGH)).alias("high"))
    rows = logits.join(F.broadcast(near), "model_name")
    return best(rows, F.transform(steps, lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / float(GRID - 1)))


@relation
def temperatures(r: Frames) -> DataFrame:
    """One temperature for each model; give them as a relation of this name to use others."""
    return fitted(r.logits).select("model_name", "temperature")


@relation
def c12_temperature(r: Frames) -> DataFrame:
    fit = fitted(r.logits)
    return fit.select("model_name", F.round("temperature", 4).alias("temperature"), six("loss").alias("loss"))


def bins_of(rows: DataFrame, n: int, closed: str, *more: Column) -> DataFrame:
    right = F.col("predicted") == F.col("label")
    return rows.groupBy("model_name", binned(F.col("confidence"), n, closed).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), share(right).alias("accuracy"), *more)


def errors_of(bins: DataFrame) -> DataFrame:
    """(model_name, ece, mce): mean and greatest distance of confidence and accuracy; rows outside all bins count in the total only."""
    off = F.when(F.col("bin").isNull(), 0.0).otherwise(F.abs(F.col("accuracy") - F.col("mean_confidence")))
    return bins.groupBy("model_name").agg((F.sum(F.col("n") * off) / F.sum("n")).alias("ece"), F.max(off).alias("mce"))


@relation
def c7_bins(r: Frames) -> DataFrame:
    return bins_of(r.predictions, 15, "right").filter("bin IS NOT NULL").select("model_name", "bin", "n", six("mean_confidence").alias("mean_confidence"), six("accuracy").alias("accuracy"))


@relation
def c7_ece(r: Frames) -> DataFrame:
    return errors_of(bins_of(r.predictions, 15, "right")).select("model_name", six("ece").alias("ece"), six("mce").alias("mce"), label(F.col("ece"), CALIBRATION_ERROR).alias("interpretation"))


@relation
def c8_overconfidence(r: Frames) -> DataFrame:
    c, right = F.col("confidence"), F.col("predicted") == F.col("label")
    return r.predictions.groupBy("model_name").agg(
        F.count("*").alias("n"), six(F.avg(c)).alias("mean_confidence"), six(F.avg(F.when(right, c))).alias("mean_correct"), six(F.avg(F.when(~right, c))).alias("mean_wrong"),
        six(share(c >= 0.9)).alias("share_confident"), six(share((c >= 0.9) & ~right)).alias("share_confident_wrong"), F.count_if(c >= 0.9).alias("confident"), F.count_if((c >= 0.9) & ~right).alias("confident_wrong"))


@relation
def c9_curve(r: Frames) -> DataFrame:
    return bins_of(r.predictions, 10, "left").filter("n >= 5").select("model_name", "bin", "n", six("mean_confidence").alias("mean_confidence"), six("accuracy").alias("accuracy"))


@relation
def c9_reliability_rows(r: Frames) -> DataFrame:
    """Ten bins closed on the right, all of them, with the gap between confidence and accuracy."""
    bins = bins_of(r.predictions, 10, "right").filter("bin IS NOT NULL")
    grid = r.predictions.select("model_name").distinct().crossJoin(r.predictions.sparkSession.range(10).select(F.col("id").cast("int").alias("bin")))
    full = grid.join(bins, ["model_name", "bin"], "left").na.fill(0, ["n"]).na.fill(0.0, ["mean_confidence", "accuracy"])
    return full.select("model_name", "bin", "n", six("mean_confidence").alias("mean_confidence"), six("accuracy").alias("accuracy"), six(F.col("mean_confidence") - F.col("accuracy")).alias("gap"))


@relation
def c10_calibration_summary(r: Frames) -> DataFrame:
    """Accuracy, confidence, error before and after the fitted temperature, and what is wrong."""
    by = r.predictions.groupBy("model_name").agg(share(F.col("predicted") == F.col("label")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    after = errors_of(bins_of(r.tempered, 15, "right")).select("model_name", F.col("ece").alias("after"))
    joined = by.join(errors_of(bins_of(r.predictions, 15, "right")), "model_name").join(after, "model_name")
    accuracy, mean, ece = F.col("accuracy"), F.col("mean_confidence"), F.col("ece")
    flags = F.array(F.when(mean - accuracy > 0.1, "overconfident"), F.when(ece > 0.05, "miscalibrated"), F.when((mean > 0.97) & (accuracy < 0.95), "saturated"))
    return joined.select("model_name", six(accuracy).alias("accuracy"), six(mean).alias("mean_confidence"), six(ece).alias("ece"), six("after").alias("ece_after"), six(ece - F.col("after")).alias("improvement"), F.array_join(F.array_compact(flags), "|").alias("flags"))


def with_correctness(df: DataFrame, original: DataFrame | None = None, prediction: str = "predicted_class") -> DataFrame:
    """Adds correct (boolean) by the first rule that the columns allow: correct itself; not prediction_changed; true_label equal to the
    prediction; the prediction equal to the model's last original one. Raises where none applies."""
    if "correct" in df.columns:
        return df.withColumn("correct", F.col("correct").cast("boolean"))
    if "prediction_changed" in df.columns:
        return df.withColumn("correct", ~F.col("prediction_changed").cast("boolean"))
    if "true_label" in df.columns:
        return df.withColumn("correct", F.coalesce(F.col("true_label") == F.col(prediction), F.lit(False)))
    if original is None and {"severity_level", "seq"} <= set(df.columns):
        original = df.filter(is_clean()).groupBy("model_name").agg(F.max_by(prediction, "seq").alias("own"))
    if original is None:
        raise ValueError("nothing tells which predictions are correct")
    joined = df.join(original.select(F.col("model_name").alias("_model"), "own"), F.col("model_name") == F.col("_model"), "left")
    return joined.withColumn("correct", F.coalesce(F.col(prediction) == F.col("own"), F.lit(False))).drop("_model", "own")


@relation
def p12_correctness(r: Frames) -> DataFrame:
    """How many rows each rule calls correct."""
    parts = {"true_label": r.log, "prediction_changed": r.j2_against_clean, "original": r.log.drop("true_label")}
    made = [with_correctness(df).groupBy("model_name").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct")).withColumn("rule", F.lit(rule)) for rule, df in parts.items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


def judged(r: Frames, proxy: bool) -> DataFrame:
    """(model_name, confidence, correct, mode): against true labels where a model has any, else against its first original prediction."""
    first = r.log.filter(is_clean()).groupBy("model_name").agg(F.min_by("predicted_class", "seq").alias("own"))
    held = r.log.groupBy("model_name").agg(F.min_by("predicted_class", "seq").alias("any"), (F.lit(not proxy) & (F.count("true_label") > 0)).alias("labelled")) if "true_label" in r.log.columns else r.log.groupBy("model_name").agg(F.min_by("predicted_class", "seq").alias("any"), F.lit(False).alias("labelled"))
    about = held.join(first, "model_name", "left").select("model_name", "labelled", F.coalesce("own", "any").alias("own"))
    truth = F.col("true_label") if "true_label" in r.log.columns else F.lit(None).cast("string")
    right = F.coalesce(F.when(F.col("labelled"), truth == F.col("predicted_class")).otherwise(F.col("own") == F.col("predicted_class")), F.lit(False))
    return r.log.join(F.broadcast(about), "model_name").select("model_name", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), right.alias("correct"), F.when(F.col("labelled"), "true_label").otherwise("proxy").alias("mode"))


def calibration_bins(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model_name", binned(F.col("confidence"), 10, "right").alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), share(F.col("correct")).alias("accuracy"))


def calibration_frame(rows: DataFrame) -> DataFrame:
    by = rows.groupBy("model_name").agg(F.count("*").alias("n"), six(share(F.col("correct"))).alias("accuracy"), six(F.avg("confidence")).alias("mean_confidence"), six(F.stddev_pop("confidence")).alias("std_confidence"), F.first("mode").alias("calibration_mode"))
    return by.join(errors_of(calibration_bins(rows)).select("model_name", six("ece").alias("ece")), "model_name")


@relation
def c11_frame(r: Frames) -> DataFrame:
    """By model: rows, accuracy and confidence of the log, and the error of ten bins closed on the right; a row outside the bins counts in the total."""
    return calibration_frame(judged(r, False))


@relation
def c11_proxy(r: Frames) -> DataFrame:
    """The same without true labels."""
    return calibration_frame(judged(r, True))


@relation
def c11_bins(r: Frames) -> DataFrame:
    """The bins of each model, from 1."""
    bins = calibration_bins(judged(r, False)).filter("bin IS NOT NULL")
    return bins.select("model_name", (F.col("bin") + 1).alias("bin"), six("mean_confidence").alias("bin_confidence"), six("accuracy").alias("bin_accuracy"), F.col("n").alias("bin_count"))


@relation
def c11_summary(r: Frames) -> DataFrame:
    mode = F.col("calibration_mode")
    return r.c11_frame.agg(
        F.count("*").alias("models"), six(F.avg("ece")).alias("mean_ece"), F.max("ece").alias("max_ece"), six(F.avg("accuracy")).alias("mean_consistency"), F.count_if(mode == "true_label").alias("by_true_label"), F.count_if(mode == "proxy").alias("by_proxy"),
        F.min_by("model_name", "ece").alias("best_calibrated"), F.max_by("model_name", "ece").alias("worst_calibrated"), six(F.avg("mean_confidence")).alias("mean_confidence"))


@relation
def classes(r: Frames) -> DataFrame:
    """The class numbers, from the longest logits."""
    return r.logits.agg(F.max(F.size("logits")).alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))


@relation
def cells(r: Frames) -> DataFrame:
    return r.predictions.groupBy("model_name", "label", "predicted").agg(F.count("*").alias("n"))


@relation
def c13_confusion(r: Frames) -> DataFrame:
    grid = r.cells.select("model_name").distinct().crossJoin(r.classes.withColumnRenamed("k", "true_class")).crossJoin(r.classes.withColumnRenamed("k", "predicted_class"))
    held = r.cells.withColumnsRenamed({"label": "true_class", "predicted": "predicted_class"})
    full = grid.join(held, ["model_name", "true_class", "predicted_class"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(W.partitionBy("model_name", "true_class"))
    return full.select("model_name", "true_class", "predicted_class", "n", six(F.coalesce(over(F.col("n").cast("double"), total.cast("double")), F.lit(0.0))).alias("row_share"))


@relation
def c13_errors(r: Frames) -> DataFrame:
    return r.c13_confusion.filter("true_class <> predicted_class AND n > 0")


@relation
def class_scores(r: Frames) -> DataFrame:
    """Each cell counts for its true class and for its predicted one; classes that a model never meets have 0."""
    n, none = F.col("n").cast("double"), F.lit(0.0)
    side = lambda k, support, hits, called: F.struct(F.col(k).cast("int").alias("k"), support.alias("support"), hits.alias("hits"), called.alias("called"))
    both = F.array(side("label", n, F.when(F.col("label") == F.col("predicted"), n).otherwise(none), none), side("predicted", none, none, n))
    met = r.cells.select("model_name", F.inline(both)).groupBy("model_name", "k").agg(*(F.sum(c).alias(c) for c in ("support", "hits", "called")))
    every = r.cells.select("model_name").distinct().crossJoin(F.broadcast(r.classes))
    sums = every.join(met, ["model_name", "k"], "left").na.fill(0.0, ["support", "hits", "called"])
    ratio = lambda a, b: F.coalesce(over(a, b), F.lit(0.0))
    return sums.select("model_name", "k", "support", "hits", ratio(F.col("hits"), F.col("called")).alias("class_precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2.0 * F.col("hits"), F.col("called") + F.col("support")).alias("f1"))


@relation
def c14_report(r: Frames) -> DataFrame:
    names, s = ("class_precision", "recall", "f1"), r.class_scores
    lines = s.select("model_name", F.concat(F.lit("class"), F.col("k").cast("string")).alias("row_name"), *(six(c).alias(c) for c in names), "support")
    none = F.lit(None).cast("double")
    total = F.sum("support").alias("support")
    by = s.groupBy("model_name")
    accuracy = by.agg(six(F.sum("hits") / F.sum("support")).alias("f1"), total).select("model_name", F.lit("accuracy").alias("row_name"), none.alias("class_precision"), none.alias("recall"), "f1", "support")
    macro = by.agg(*(six(F.avg(c)).alias(c) for c in names), total).select("model_name", F.lit("macro").alias("row_name"), *names, "support")
    weighted = by.agg(*(six(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names), total).select("model_name", F.lit("weighted").alias("row_name"), *names, "support")
    return lines.unionByName(accuracy).unionByName(macro).unionByName(weighted)


@relation
def cumulated(r: Frames) -> DataFrame:
    """For each distinct score of a class (of one model against the rest): rows at or above it.

    Scores count as they are, not rounded. They are cut into ranges of equal width in their log-odds, of which there are some RANGES for each
    unit, for softmax crowds scores at 0 and 1; sums of the ranges above come from a small table, and only within a range are
    rows cumulated, so that a model with a third of all rows is spread over many tasks.
    """
    long = r.predictions.select("model_name", "label", F.posexplode("p").alias("k", "score"))
    odds = F.ln(F.greatest("score", F.lit(1e-300))) - F.ln(F.greatest(1.0 - F.col("score"), F.lit(1e-17)))
    hit = F.col("label") == F.col("k")
    counts = long.groupBy("model_name", "k", "score").agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")).withColumn("part", F.floor(odds * RANGES))
    sums = counts.groupBy("model_name", "k", "part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    w = W.partitionBy("model_name", "k")
    above = w.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("model_name", "k", "part", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("neg_above"), F.sum("p").over(w).alias("all_pos"), F.sum("n").over(w).alias("all_neg"))
    inside = W.partitionBy("model_name", "k", "part").orderBy(F.desc("score"))
    rows = counts.join(base, ["model_name", "k", "part"])
    return rows.withColumns({"tp": F.col("pos_above") + F.sum("pos").over(inside), "fp": F.col("neg_above") + F.sum("neg").over(inside)})


@relation
def c15_roc_points(r: Frames) -> DataFrame:
    part = lambda a, b: six(over(F.col(a).cast("double"), F.col(b).cast("double")))
    return r.cumulated.select("model_name", "k", six("score").alias("score"), part("fp", "all_neg").alias("fpr"), part("tp", "all_pos").alias("tpr"))


@relation
def c15_auc(r: Frames) -> DataFrame:
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return r.cumulated.groupBy("model_name", "k").agg(six(over(area, (F.max("all_pos") * F.max("all_neg")).cast("double"))).alias("auc"))


@relation
def c16_pr_points(r: Frames) -> DataFrame:
    return r.cumulated.select("model_name", "k", six("score").alias("score"), six(F.col("tp") / (F.col("tp") + F.col("fp"))).alias("class_precision"), six(over(F.col("tp").cast("double"), F.col("all_pos").cast("double"))).alias("recall"))


@relation
def c16_average_precision(r: Frames) -> DataFrame:
    gained = over(F.col("pos").cast("double"), F.col("all_pos").cast("double"))
    return r.cumulated.groupBy("model_name", "k").agg(six(F.sum(gained * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision"))


@relation
def c17_by_class(r: Frames) -> DataFrame:
    c = F.col("confidence")
    by = r.predictions.groupBy("label").agg(six(F.min(c)).alias("min_confidence"), six(F.max(c)).alias("max_confidence"), F.count("*").alias("n"))
    return with_median(by, medians(r.predictions, ["label"], c), ["label"], "median_confidence")


@relation
def c17_density(r: Frames) -> DataFrame:
    """Twenty bins over the range of each true class's own confidences: counts, and density so that the area is 1."""
    limits = r.predictions.groupBy("label").agg(F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.count("*").alias("total"))
    rows = r.predictions.join(F.broadcast(limits), "label").filter("high > low")
    wide = (F.col("high") - F.col("low")) / 20
    at = F.least(F.floor((F.col("confidence") - F.col("low")) / wide), F.lit(19)).cast("int")
    by = rows.groupBy("label", at.alias("bin")).agg(F.count("*").alias("n"), F.first(wide).alias("wide"), F.first("total").alias("total"))
    return by.select("label", "bin", "n", six(F.col("n") / (F.col("total") * F.col("wide"))).alias("density"))


@relation
def c17_histogram(r: Frames) -> DataFrame:
    return r.predictions.groupBy("model_name", binned(F.col("confidence"), 20, "left").alias("bin")).agg(F.count("*").alias("n"))


@relation
def c19_inference_summary(r: Frames) -> DataFrame:
    """By model and predicted class at the fitted temperature: rows, confidence, and the raw confidence of the same class."""
    raw = F.element_at("raw", F.col("predicted") + 1)
    return r.tempered.groupBy("model_name", "predicted").agg(F.count("*").alias("n"), six(F.avg("confidence")).alias("mean_confidence"), six(F.avg(raw)).alias("mean_raw_confidence"))
