"""Sources: prediction logs under any of their usual column names, and nested inference results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The names under which the canonical columns are found, in the order in which they are tried.
ALIASES = {
    "sample_id": ("sample_id", "id", "image_id", "filename", "sample"),
    "model_name": ("model_name", "model", "classifier"),
    "predicted_class": ("predicted_class", "prediction", "pred", "label", "class"),
    "confidence": ("confidence", "conf", "score", "probability", "prob"),
}
PERTURBATION_ALIASES = {
    "perturbation_type": ("perturbation_type", "perturbation", "pert_type", "type", "augmentation", "transform"),
    "severity_level": ("severity_level", "severity", "level", "pert_severity", "perturbation_severity", "intensity"),
}
REQUIRED = ("sample_id", "model_name", "predicted_class")


def renamed(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """The first of a canonical column's names that the frame has becomes it; case and outer spaces don't count. Chosen at plan time.

    Of several columns that differ in case or spaces only, the last counts. Other columns stay, but one that bears the canonical
    name in another spelling gives way to it.
    """
    held = {c.strip().lower(): c for c in df.columns}
    found = {new: next((held[a] for a in names if a in held), None) for new, names in aliases.items()}
    back = {old: new for new, old in found.items() if old}
    return df.select(*(F.col(f"`{c}`").alias(back.get(c, c)) for c in df.columns if c in back or c not in aliases))


def canonical(df: DataFrame) -> DataFrame:
    """The log with canonical names; raises on a missing required column."""
    out = renamed(df, ALIASES)
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out


def read_log(spark: SparkSession, path: str, perturbed: bool = False) -> DataFrame:
    """A prediction log (or one with perturbations) from CSV with a header, JSON lines or Parquet, by the path's ending.

    CSV cells stay text, so that ids such as 007 keep their zeros; confidences are cast where they are numbers.
    """
    read = spark.read.option("header", True)
    ending = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    raw = read.csv(path) if ending in ("csv", "gz") else read.json(path) if ending in ("json", "jsonl") else read.parquet(path)
    return perturbation_log(raw) if perturbed else prediction_log(raw)


def prediction_log(df: DataFrame) -> DataFrame:
    """Canonical log: string ids, confidence as double with NaN as NULL, a missing class as its own class."""
    out = canonical(df)
    confidence = F.col("confidence").try_cast("double") if "confidence" in out.columns else F.lit(None).cast("double")
    out = out.withColumns({c: F.col(c).cast("string") for c in ("sample_id", "model_name")})
    return out.withColumns({"predicted_class": F.coalesce(F.col("predicted_class").cast("string"), F.lit("nan")), "confidence": F.when(~F.isnan(confidence), confidence)})


def perturbation_log(df: DataFrame) -> DataFrame:
    """A prediction log with perturbation and severity, trimmed and lowered, unknown where missing."""
    out = renamed(prediction_log(df), PERTURBATION_ALIASES)
    clean = {c: F.coalesce(F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")), F.lit("unknown")) if c in out.columns else F.lit("unknown") for c in ("perturbation_type", "severity_level")}
    return out.withColumns(clean)


def flatten(nested: DataFrame, column: str = "results") -> DataFrame:
    """Rows of map<model, map<perturbation, array<record>>>; nodes with an error are left out, samples number by position."""
    models = nested.select(F.explode(column).alias("model_name", "by"))
    rows = models.select("model_name", F.explode("by").alias("perturbation_type", "records"))
    rows = rows.select("model_name", "perturbation_type", F.posexplode("records").alias("position", "r"))
    fields = rows.schema["r"].dataType.names
    if "error" in fields:
        rows = rows.filter("r.error IS NULL")
    sample = F.format_string("sample_%04d", F.col("position"))
    sample = F.coalesce(F.col("r.sample_id"), sample) if "sample_id" in fields else sample
    return rows.select(sample.alias("sample_id"), "model_name", "perturbation_type", F.col("r.prediction").alias("predicted_class"), F.col("r.confidence").alias("confidence"), *(F.col(f"r.{c}").alias(c) for c in fields if c not in ("error", "sample_id", "prediction", "confidence")))
