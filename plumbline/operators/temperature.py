"""A temperature for each class of each model, by Newton's method over the whole table of logits.

In the reciprocals b of the temperatures the mean negative log-likelihood is convex: it is the mean of log sum exp(b z) - b z of the true
class. Each step is one aggregate: tasks add up the loss, its gradient and its curvature in numpy and send a row of sums for each
model; Spark adds these; the driver gets classes x classes numbers for each model and solves for the next step, for all models at once. A step
that doesn't lower a model's loss is halved. It starts from the one temperature of the model, so its loss is never above that one's.

Rows without logits or label, with a label beyond the logits, or with logits that are no finite numbers do not count. Logits may differ in
length: missing classes have no probability. Temperatures stay between LOW and HIGH; a class without any logits but 0 keeps
the model's temperature, for none tells it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import six
from plumbline.operators.evaluation import HIGH, LOW, best_class, fitted, softmax_by_class
from plumbline.operators.frames import Frames, relation

#: Steps at most, and the gradient at which a fit ends.
STEPS, FLAT = 60, 1e-9


def moments(z: np.ndarray, sizes: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows, loss, gradient and curvature of the rows z (padded with 0 behind sizes), summed, in one vector."""
    k = len(b)
    s = np.where(np.arange(k) < sizes[:, None], z * b, -np.inf)
    top = s.max(1, keepdims=True)
    e = np.exp(s - top)
    total = e.sum(1, keepdims=True)
    p, at = e / total, np.arange(len(y))
    loss = (np.log(total[:, 0]) + top[:, 0] - s[at, y]).sum()
    off = p.copy()
    off[at, y] -= 1
    weighed = z * p
    return np.concatenate([[len(y), loss], (z * off).sum(0), (np.diag((z * weighed).sum(0)) - weighed.T @ weighed).ravel()])


def sums(logits: DataFrame, scales: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The moments of each model at its scales: one pass over the logits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            models = np.array(b.column(0).to_pylist(), object)
            labels = b.column(1).to_numpy(zero_copy_only=False)
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            z = np.zeros((b.num_rows, int(sizes.max(initial=0))))
            z[np.arange(z.shape[1]) < sizes[:, None]] = b.column(2).flatten().to_numpy(zero_copy_only=False)
            for m in set(models):
                mine = np.flatnonzero(models == m)
                k = len(scales[m])
                wide = np.zeros((len(mine), k))
                wide[:, : min(k, z.shape[1])] = z[mine, :k]
                held[m] = held.get(m, 0) + moments(wide, sizes[mine], labels[mine].astype(np.int64), scales[m])
        for m, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(x)), pa.array(np.arange(len(x)), pa.int32()), pa.array(x)], ["model_name", "at", "x"])

    added = usable(logits).mapInArrow(run, "model_name string, at int, x double").groupBy("model_name", "at").agg(F.sum("x").alias("x"))
    out = {m: np.zeros(2 + len(b) + len(b) ** 2) for m, b in scales.items()}
    for r in added.collect():  # classes x classes numbers for each model
        out[r["model_name"]][r["at"]] = r["x"]
    return out


def usable(logits: DataFrame) -> DataFrame:
    fine = F.forall("logits", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return logits.filter(F.col("logits").isNotNull() & (F.col("label") >= 0) & (F.col("label") < F.size("logits"))).filter(fine).select("model_name", F.col("label").cast("int").alias("label"), F.col("logits").cast("array<double>").alias("logits"))


class Descent:
    """Newton steps of one model within the bounds."""

    def __init__(self, b: np.ndarray):
        self.b, self.at, self.step, self.loss, self.done, self.informed = b, b, np.zeros_like(b), np.inf, False, None

    def take(self, x: np.ndarray) -> None:
        """Judge the scales at which x was summed (self.at), and choose the next."""
        n, k = x[0], len(self.b)
        if n == 0:
            self.done = True
            return
        loss, gradient, curvature = x[1] / n, x[2 : 2 + k] / n, x[2 + k :].reshape(k, k) / n
        if loss > self.loss:  # too far
            self.step = self.step / 2
            self.done = np.abs(self.step).max() < 1e-12
            self.at = self.b + self.step
            return
        self.b, self.loss = self.at, loss
        least, most = 1 / HIGH, 1 / LOW
        stuck = ((self.b <= least) & (gradient > 0)) | ((self.b >= most) & (gradient < 0)) | (np.diag(curvature) + np.abs(gradient) == 0)
        free = np.flatnonzero(~stuck)
        if not len(free) or np.abs(gradient[free]).max() < FLAT:
            self.done = True
            return
        h = curvature[np.ix_(free, free)]
        step = np.zeros(k)
        step[free] = -np.linalg.solve(h + np.eye(len(free)) * (1e-12 + 1e-10 * np.trace(h)), gradient[free])
        self.step = np.clip(self.b + step, least, most) - self.b
        self.at = self.b + self.step


def fitted_by_class(logits: DataFrame) -> DataFrame:
    """(model_name, temperatures, loss, loss_of_one): a temperature for each class, the mean loss with them and with one for all."""
    spark = logits.sparkSession
    rows = usable(logits).persist()
    try:
        sizes = {r["model_name"]: r["k"] for r in rows.groupBy("model_name").agg(F.max(F.size("logits")).alias("k")).collect()}
        one = {r["model_name"]: (r["temperature"], r["loss"]) for r in fitted(rows).collect()}
        fits = {m: Descent(np.full(k, 1 / one[m][0])) for m, k in sizes.items()}
        for _ in range(STEPS):
            left = {m: f.at for m, f in fits.items() if not f.done}
            if not left:
                break
            for m, x in sums(rows.filter(F.col("model_name").isin(*left)), left).items():
                fits[m].take(x)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(m, (1 / f.b).tolist(), float(f.loss), float(one[m][1])) for m, f in fits.items()], "model_name string, temperatures array<double>, loss double, loss_of_one double")


@relation
def class_temperatures(r: Frames) -> DataFrame:
    """A temperature for each class of each model; give them as a relation of this name to use others."""
    return fitted_by_class(r.logits)


@relation
def c12_class_temperatures(r: Frames) -> DataFrame:
    rows = r.class_temperatures.select("model_name", F.posexplode("temperatures").alias("k", "t"), "loss")
    return rows.select("model_name", "k", F.round("t", 3).alias("temperature"), six("loss").alias("loss"))


@relation
def p2_by_class(r: Frames) -> DataFrame:
    """Class and confidence of each row with a temperature for each class."""
    joined = r.logits.join(r.class_temperatures.select("model_name", "temperatures"), "model_name")
    p = F.col("p")
    rows = joined.select("sample_id", "model_name", "label", softmax_by_class(F.col("logits"), F.slice("temperatures", F.lit(1), F.size("logits"))).alias("p"))
    return rows.select("sample_id", "model_name", "label", best_class(p).alias("predicted"), F.round(F.array_max(p), 4).alias("confidence"))
