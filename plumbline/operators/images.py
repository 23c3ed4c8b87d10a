"""Images: the fan-out into corrupted variants, and a scoring stage for a user's model, whose rows are a prediction log.

Both are narrow: an image and its variants stay in their task, a bounded number of levels at a time. A table of images has sample_id, height, width,
pixels (height x width x 3 bytes, RGB by rows) and true_label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import pixels
from plumbline.functions.columns import six
from plumbline.operators.frames import Frames, relation

#: Levels of the images that are corrupted or scored at once (filters hold some ten arrays of eight bytes a level), and most images.
LEVELS, IMAGES = 500_000, 512
VARIANT = "sample_id string, true_label string, perturbation string, perturbation_type string, parameter double, variant_id string, height int, width int, pixels binary, mean_level double, error string"


def stacks(b: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray | None]]:
    """Rows of one shape with their levels, a bounded number at once; rows that are no images come with None."""
    height, width = (b.column(c).to_pylist() for c in ("height", "width"))
    data = b.column("pixels")  # stays in the batch's own memory
    length = pc.binary_length(data).to_pylist()
    by: dict[tuple[int, int] | None, list[int]] = {}
    for i, (h, w, n) in enumerate(zip(height, width, length)):
        whole = h is not None and w is not None and n is not None and h > 0 and w > 0 and n == 3 * h * w
        by.setdefault((h, w) if whole else None, []).append(i)
    for shape, rows in by.items():
        if shape is None:
            yield rows, None
            continue
        step = max(1, min(IMAGES, LEVELS // (3 * shape[0] * shape[1])))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            yield some, np.frombuffer(b"".join(data[i].as_py() for i in some), np.uint8).reshape(len(some), *shape, 3)


def fan_out(images: DataFrame, enabled: tuple[str, ...] | None = None, seed: int = pixels.SEED) -> DataFrame:
    """Each image as it is and under every enabled corruption (all by default); what is no image gives one row with an error."""
    return _plain(images).mapInArrow(_variants_of(enabled, seed), VARIANT)


def _plain(images: DataFrame) -> DataFrame:
    images.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(IMAGES))  # a batch holds whole images
    return images.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("true_label").cast("string").alias("true_label"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels")


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _variants_of(enabled: tuple[str, ...] | None = None, seed: int = pixels.SEED) -> Batches:
    chosen = [v for v in pixels.VARIANTS if enabled is None or v[0] in ("original", *enabled)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in VARIANT.split(", ")])
        for b in batches:
            for rows, x in stacks(b):
                same = [b.column(c).take(pa.array(rows, pa.int64())) for c in ("sample_id", "true_label")]
                n = len(rows)
                shape = [b.column(c).take(pa.array(rows, pa.int64())) for c in ("height", "width")]
                if x is None:
                    nulls = [pa.nulls(n, t) for t in (pa.string(), pa.string(), pa.float64(), pa.string())]
                    yield pa.RecordBatch.from_arrays([*same, *nulls, *shape, pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64()), pa.array(["no image of this height and width"] * n)], schema=schema)
                    continue
                for name, kind, parameter, head in chosen:
                    made = pixels.noise(x, parameter, seed) if name == "gaussian_noise" else pixels.MAKE[name](x, parameter)
                    told = [pa.array([v] * n, t) for v, t in ((name, pa.string()), (kind, pa.string()), (parameter, pa.float64()), (pixels.variant_id(name, parameter, head), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*same, *told, *shape, pa.array([v.tobytes() for v in made], pa.binary()), pa.array(made.mean((1, 2, 3))), pa.nulls(n, pa.string())], schema=schema)

    return run


@dataclass
class Scorer:
    """A model as the scoring stage runs it.

    load is called once in each task and gives a function from images (n x height x width x 3, bytes) to logits (n x classes).
    temperature is one number or one for each class. weights (any bytes) are handed to load: up to `LIMIT` they go with the job by a broadcast; larger
    ones have to stand in a store that the executors see, and load reads them there.
    """

    name: str
    load: Callable
    classes: tuple[str, ...] = ()
    temperature: float | list[float] = 1.0
    weights: bytes | None = field(default=None, repr=False)


#: Bytes of weights that a job may broadcast.
LIMIT = 256 << 20
SCORED = "sample_id string, model_name string, perturbation string, perturbation_type string, severity_level string, predicted_class string, confidence double, raw_confidence double, probabilities array<double>, predicted_idx int, true_label string, error string"


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def judged(logits: np.ndarray, temperature: float | list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities at the temperature, the first of the most likely classes, and the untempered probability of that class."""
    t = np.asarray(temperature, np.float64)
    if not (t > 0).all():
        raise ValueError("a temperature must be above 0")
    p = _softmax(logits / t)
    at = p.argmax(1)
    return p, at, _softmax(logits)[np.arange(len(at)), at]


def score(variants: DataFrame, scorers: list[Scorer]) -> DataFrame:
    """Every variant by every scorer. An image that a scorer fails on (alone, after its stack failed) is a row with the error and without
    a class, and so is one that came with an error; the others go on. A scorer that doesn't load fails all its rows in this way."""
    return variants.mapInArrow(_scores_of(variants.sparkSession, scorers), SCORED)


def score_images(images: DataFrame, scorers: list[Scorer], enabled: tuple[str, ...] | None = None) -> DataFrame:
    """The variants of images by scorers, both in one Python process of a task: a stack's variants are scored as they are made and never go back to the JVM."""
    made, judge = _variants_of(enabled), _scores_of(images.sparkSession, scorers)
    return _plain(images).mapInArrow(lambda batches: judge(made(batches)), SCORED)


def _scores_of(spark: SparkSession, scorers: list[Scorer]) -> Batches:
    for s in scorers:
        if s.weights is not None and len(s.weights) > LIMIT:
            raise ValueError(f"the weights of {s.name} have {len(s.weights)} bytes; let its load() read them from a store")
    sent = {s.name: spark.sparkContext.broadcast(s.weights) for s in scorers if s.weights is not None}
    plain = [(s.name, s.load, s.classes, s.temperature) for s in scorers]

    def attempt(predict: Callable, x: np.ndarray, temperature: float | list[float]) -> list:
        """A result for each image: (probabilities, class, raw probability), or the text of an error."""
        try:
            z = np.asarray(predict(x), np.float64)
            if z.ndim != 2 or len(z) != len(x) or not np.isfinite(z).all():
                raise ValueError(f"logits of the shape {z.shape} for {len(x)} images, or not finite")
            return list(zip(*judged(z, temperature)))
        except Exception as e:  # noqa: BLE001  a model may fail in any way; its images become error rows
            return [f"{type(e).__name__}: {e}"] if len(x) == 1 else [y for k in range(len(x)) for y in attempt(predict, x[k : k + 1], temperature)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {}
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}[c.split()[1]]) for c in SCORED.split(", ")])
        for name, load, *_ in plain:
            try:
                loaded[name] = load(sent[name].value) if name in sent else load(None)
            except Exception as e:  # noqa: BLE001
                loaded[name] = f"{type(e).__name__}: {e}"
        for b in batches:
            told = b.select(["sample_id", "true_label", "perturbation", "perturbation_type", "error"]).to_pylist()
            for rows, x in stacks(b):
                for name, _, classes, temperature in plain:
                    if x is None or isinstance(loaded[name], str):
                        found = [told[i]["error"] or "no image of this height and width" if x is None else loaded[name] for i in rows]
                    else:
                        found = attempt(loaded[name], x, temperature)
                    out = []
                    for i, f in zip(rows, found):
                        r = dict(sample_id=told[i]["sample_id"], model_name=name, perturbation=told[i]["perturbation"], perturbation_type=told[i]["perturbation_type"], severity_level=told[i]["perturbation"], true_label=told[i]["true_label"])
                        if isinstance(f, str):
                            out.append({**r, "error": f})
                        else:
                            p, k, raw = f
                            out.append({**r, "predicted_class": classes[k] if k < len(classes) else f"class_{k}", "confidence": float(p[k]), "raw_confidence": float(raw), "probabilities": p.tolist(), "predicted_idx": int(k)})
                    yield pa.RecordBatch.from_pylist(out, schema)

    return run


def log_of(scored: DataFrame) -> DataFrame:
    """The prediction log of scored rows, without the failed ones; rows of a sample keep the order of the corruptions."""
    order = F.array_position(F.array(*(F.lit(v[0]) for v in pixels.VARIANTS)), F.col("perturbation"))
    return scored.filter("error IS NULL").withColumn("seq", F.struct(order.alias("at"), "perturbation", "sample_id"))


@relation
def variants(r: Frames) -> DataFrame:
    return fan_out(r.images)


@relation
def p14_corruptions(r: Frames) -> DataFrame:
    """The variants of each image: what was done, the mean level, and a hash of all levels."""
    return r.variants.select("sample_id", "perturbation", "perturbation_type", "parameter", "variant_id", "height", "width", six("mean_level").alias("mean_level"), F.sha2("pixels", 256).alias("levels_sha256"), "error")


@relation
def scored(r: Frames) -> DataFrame:
    """The variants by the scorers; give them as a relation of this name to score others."""
    scorers = [linear("linear0", 0, 0.8336), linear("linear1", 1, [0.9, 0.8, 0.85, 1.1])]
    return score(r.variants, scorers) if r.gives("variants") else score_images(r.images, scorers)


def linear(name: str, seed: int, temperature: float | list[float], classes: int = 4) -> Scorer:
    """A small model of fixed weights: logits are the means of the channels in each quarter of the image, against the middle
    level, weighted by a generator's numbers."""

    def load(_: bytes | None) -> Callable:
        weights = np.random.default_rng(seed).normal(0, 1, (12, classes))

        def predict(x: np.ndarray) -> np.ndarray:
            n, h, w, _ = x.shape
            halves = [x[:, i * h // 2 : max(1, (i + 1) * h // 2), j * w // 2 : max(1, (j + 1) * w // 2)].reshape(n, -1, 3).mean(1) for i in range(2) for j in range(2)]
            return (np.concatenate(halves, 1) - 128) / 32 @ weights

        return predict

    return Scorer(name, load, tuple(f"c{k}" for k in range(classes)), temperature)


@relation
def f1_scored(r: Frames) -> DataFrame:
    """Each variant's class and confidences by each scorer."""
    return r.scored.select("sample_id", "model_name", "perturbation", "perturbation_type", "severity_level", "predicted_class", six("confidence").alias("confidence"), six("raw_confidence").alias("raw_confidence"), "predicted_idx", "true_label", "error")


@relation
def f1_robustness(r: Frames) -> DataFrame:
    """From images to robustness: fan-out, scores, log, and the robustness of each model."""
    return Frames(log=log_of(r.scored)).c4_robustness


@relation
def f1_against_clean(r: Frames) -> DataFrame:
    """By model and corruption: how many images change their class against the original, and the mean loss of confidence."""
    rows = Frames(log=log_of(r.scored)).j2_against_clean
    by = rows.groupBy("model_name", F.col("severity_level").alias("perturbation"))
    return by.agg(F.count("*").alias("images"), F.count_if("prediction_changed").alias("changed"), six(F.avg("confidence_drop")).alias("mean_drop"))
