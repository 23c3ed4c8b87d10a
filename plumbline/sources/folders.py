"""Discovery of images in class and plate folders: a listing of paths only, no file is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The class of each top folder, and the endings of images.
CLASSES = {"e.coli on BH": "e_coli", "Klebsiella on BH": "k_pneumoniae", "Pseudomonas aeruginosa": "p_aeruginosa", "Staph On BH": "s_aureus"}
ENDINGS = (".jpg", ".jpeg", ".png", ".heic")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The paths of all files below a folder. Spark lists large folders in tasks; contents are left out of the plan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")


def discover(paths: DataFrame, root: str, classes: dict[str, str] = CLASSES) -> DataFrame:
    """(class_name, plate_name, plate_path, image_id, path) of each image that lies in a plate folder of a known class.

    A plate is any folder whose name starts with plate, at any depth below the class's folder; plates of MacConkey medium (named
    ...conkey...) are left out. An image of nested plates belongs to the innermost, by whose folder images are counted.
    """
    below = F.substring_index(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), root.rstrip("/") + "/", -1)
    parts = paths.select("path", F.split(below, "/").alias("p"))
    folders = F.slice("p", 2, F.greatest(F.size("p") - 2, F.lit(0)))
    rows = parts.select("path", F.element_at("p", 1).alias("top"), F.element_at("p", -1).alias("file"), folders.alias("folders"))
    plate = F.array_max(F.transform("folders", lambda d, i: F.when(F.startswith(F.lower(d), F.lit("plate")), i + 1)))
    rows = rows.withColumn("depth", plate).filter("depth IS NOT NULL")
    known = F.element_at(F.create_map(*(F.lit(x) for pair in classes.items() for x in pair)), F.col("top"))
    ending = F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1))
    name = F.element_at("folders", F.col("depth"))
    held = rows.filter(F.col("top").isin(*classes)).filter(ending.isin(*ENDINGS)).filter(~F.contains(F.lower(name), F.lit("conkey")))
    return held.select(known.alias("class_name"), name.alias("plate_name"), F.array_join(F.concat(F.array("top"), F.slice("folders", F.lit(1), F.col("depth"))), "/").alias("plate_path"), F.col("file").alias("image_id"), "path")
