"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 8-word windows of a text. Transformed, they make
a vector for each document. For each language and source, location and scatter of the vectors come from the
minimum covariance determinant: concentration steps keep the SUBSET share of the documents nearest by Mahalanobis
distance and estimate anew from them. They begin from STARTS estimates side by side (medians and median deviations;
mean and covariance of all; those of two eighths of the vectors, drawn by a hash), and the estimate of the least
determinant is taken. A document whose distance exceeds CUT is rejected.

Every step is two aggregates over a narrow table of vectors, written once: a histogram of distances for each
group and start (integers, so its order of addition does not matter), whose cumulated counts give the subset's limit,
and the moments of the subset. Both combine before the shuffle, so a group with a third of all rows sends one row
for each task and bin. The estimates, one row for each group, return by a join that Spark broadcasts where
their measured size allows.

Null and empty texts have no words and fail the base rules. A null language or source is a group of its own.
Documents that fail the base rules do not take part in the estimates. A group with fewer than LEAST others is judged by the
estimate of its language, a language with fewer than LEAST by that of all documents, whatever their number; the three
levels are estimated in the same passes. A ridge (the
square of VECTOR's numbers) is added to each variance, so ties and constant columns are no error. Repeated
rows count as often as they occur. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, cut

#: Words of a window; the subset's share, concentration steps, least documents of a group, bins for each e-fold of squared distance.
WINDOW, SUBSET, STEPS, LEAST, BINS = 8, 0.75, 3, 20, 16
#: Starts of the concentration steps.
STARTS = 4
#: Vector: names, and the standard deviations whose squares are added to the variances.
VECTOR = {"v0": 0.5, "v1": 0.15, "v2": 0.35, "v3": 0.6}
#: Median of the chi-square distribution with 4 degrees of freedom. The limit is tuned: the quantile at 1 - 1e-8, raised from
#: that at 1 - 1e-6 (33.4), with which 3 of 3,409 documents labelled as good were rejected at sf0.1.
MEDIAN, CUT = 3.3567, 43.1
KEYS = ("lang", "source")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "[#*$%&|<>]"
FEWEST, MOST_REPEATED = 20, 30


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each document."""
    keys = [F.col(c) for c in ("doc_id", "lang", "source")]
    rows = docs.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    words, lines = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, F.lit(SPACE)) != "")
    rows = rows.select(*keys, words.alias("words"), lines.alias("lines"), F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"))
    rows = rows.select("*", F.length(F.array_join("words", "")).alias("word_chars"))
    counts = [F.size("words").cast("long").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")]
    # A hash of each word, then of each 2, 4 and 8 words: a window's hash is made of those of its halves.
    windows = F.transform("words", lambda w: F.xxhash64(w))
    for half in (1, 2, 4):
        rows = rows.select(*keys, *counts, windows.alias("of")) if half == 1 else rows.select(*keys, *(F.col(c) for c in COUNTS), windows.alias("of"))
        n = F.greatest(F.size("of") - half, F.lit(0))
        windows = F.zip_with(F.slice("of", 1, n), F.slice("of", half + 1, n), lambda a, b: F.xxhash64(a, b))
    counts = [F.col(c) for c in COUNTS]
    rows = rows.select(*keys, *counts, windows.alias("windows"))
    # Only texts with an equal pair of windows sort them, with their places.
    doubled = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select(*keys, *counts, F.when(doubled, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    n = F.size("sorted") - 1
    pairs = F.zip_with(F.slice("sorted", 1, n), F.slice("sorted", 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    rows = rows.select(*keys, *counts, F.when(F.col("sorted").isNotNull(), F.sort_array(F.array_distinct(F.flatten(pairs)))).alias("places"))
    # A repeated window covers its words up to the next repeated one.
    covered = F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.when(F.col("places").isNotNull(), F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))
    return rows.select(*keys, *counts, repeated.alias("n_repeat_words"))


def vector() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "v0": F.log1p("n_words"),
        "v1": F.log(F.col("word_chars") / words + 1e-9),
        "v2": F.log1p(F.col("n_symbols") * 100.0 / chars),
        "v3": F.log1p((F.col("n_repeat_words") + F.col("n_dup_lines")) * 100.0 / words),
    }


def factor(moments: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_ij of the scatter s_ij, with the ridge added to the diagonal."""
    names, l = list(VECTOR), {}
    out = moments
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            rest = F.col(f"s_{b}_{a}") + (VECTOR[a] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return out


def distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the group's estimate; null without one."""
    names = list(VECTOR)
    for i, a in enumerate(names):
        rest = F.col(a) - F.col(f"m_{a}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(names))), F.col("y0") * F.col("y0"))).drop(*(f"y{i}" for i in range(len(names))))


def _same(keys: tuple[str, ...]) -> Column:
    """Equal keys of rows and of what joins them, nulls too; the latter have a low line before their names."""
    same = F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}"))
    for k in keys[1:]:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return same


def _with(rows: DataFrame, estimate: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return rows.join(estimate.withColumnsRenamed({k: f"_{k}" for k in keys}), _same(keys), "left").drop(*(f"_{k}" for k in keys))


def _bin() -> Column:
    return F.floor(F.log(F.col("d2") + 1e-6) * BINS).cast("int")


def limits(rows: DataFrame, keys: tuple[str, ...], share: float) -> DataFrame:
    """(keys, most: the least bin up to which the share of the rows of a key lies)."""
    w = W.partitionBy(*keys)
    bins = rows.filter("d2 IS NOT NULL").groupBy(*keys, _bin().alias("bin")).agg(F.count("*").alias("c"))
    bins = bins.withColumns({"upto": F.sum("c").over(w.orderBy("bin")), "n": F.sum("c").over(w)})
    return bins.groupBy(*keys).agg(F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * share), F.col("bin"))).alias("most"))


def moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Means m_* and covariances s_*_* of the vectors of each key."""
    names = list(VECTOR)
    return rows.groupBy(*keys).agg(*(F.avg(a).alias(f"m_{a}") for a in names), *(F.covar_pop(a, b).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]))


def starts(vectors: DataFrame, keys: tuple[str, ...], fewest: Column) -> DataFrame:
    """(keys, start, m_*, s_*_*): the first estimates of each group with at least fewest vectors."""
    names = list(VECTOR)
    first = vectors.groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile_approx(a, 0.5, 1000).alias(f"m_{a}") for a in names)).filter(F.col("n") >= fewest).drop("n")
    known = _with(vectors, first, keys).filter("m_v0 IS NOT NULL")
    spread = known.groupBy(*keys).agg(*(F.first(f"m_{a}").alias(f"m_{a}") for a in names), *(F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5, 1000).alias(f"d_{a}") for a in names))
    zero = {f"s_{a}_{b}": F.lit(0.0) for i, a in enumerate(names) for b in names[i + 1 :]}
    robust = spread.withColumns({f"s_{a}_{a}": F.pow(F.col(f"d_{a}") * 1.4826, 2) for a in names} | zero).withColumn("start", F.lit(0))
    eighth = F.pmod(F.xxhash64(*names), F.lit(8)).cast("int")
    # Start 1 is all vectors, 2 and 3 are the first two eighths.
    part = F.when(eighth < STARTS - 2, F.array(F.lit(1), eighth + 2)).otherwise(F.array(F.lit(1)))
    others = moments(known.select(*keys, *names, F.explode(part).alias("start")), *keys, "start")
    return robust.select(*others.columns).unionByName(others)


def estimates(vectors: DataFrame, keys: tuple[str, ...] = KEYS, fewest: Column | None = None) -> DataFrame:
    """(keys, m_*, l_*_*, scale) of each group with at least fewest (LEAST) vectors (keys, v*)."""
    spark, names = vectors.sparkSession, list(VECTOR)
    keep = [*(f"m_{a}" for a in names), *(f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1))]
    each = (*keys, "start")
    now = cut(spark, factor(starts(vectors, keys, F.lit(LEAST) if fewest is None else fewest)).select(*each, *keep))
    for _ in range(STEPS):
        at = distance(_with(vectors, now, keys))
        limit = limits(at, each, SUBSET).withColumnsRenamed({k: f"_{k}" for k in each})
        near = at.join(limit, _same(each)).filter(_bin() <= F.col("most")).drop(*(f"_{k}" for k in each))
        now = cut(spark, factor(moments(near, *each)).select(*each, *keep))
    # The least determinant of each group; the root of a determinant is the product of the factor's diagonal.
    root = F.ln(F.col("l_0_0"))
    for i in range(1, len(names)):
        root = root + F.ln(F.col(f"l_{i}_{i}"))
    best = now.groupBy(*keys).agg(F.min(F.struct(F.round(root, 9).alias("root"), "start", *keep)).alias("e")).select(*keys, *(f"e.{c}" for c in keep))
    now = cut(spark, best)
    # The subset's scatter is too small; the median distance of all sets its scale.
    middle = limits(distance(_with(vectors, now, keys)), keys, 0.5)
    scaled = middle.select(*keys, F.greatest(F.exp((F.col("most") + 1) / F.lit(float(BINS))) / MEDIAN, F.lit(1.0)).alias("scale"))
    return cut(spark, _with(now, scaled, keys))


def levels(vectors: DataFrame) -> DataFrame:
    """Each vector three times: in its group (level 0), its language (1) and all documents (2)."""
    none = F.lit(None).cast("string")
    keys = [F.struct(F.lit(i).alias("level"), lang.alias("lang"), source.alias("source")) for i, (lang, source) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)])]
    return vectors.select(F.explode(F.array(*keys)).alias("k"), *VECTOR).select("k.*", *VECTOR)


def judge(docs: DataFrame) -> DataFrame:
    """The statistics of each document with base_failed, distance (in chi-square units) and kept."""
    spark = docs.sparkSession
    rows = cut(spark, statistics(docs))
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumns(vector())
    # All three levels in the same passes; the estimate of all documents has no least number.
    found = estimates(levels(rows.filter("NOT base_failed")), ("level", *KEYS), F.when(F.col("level") == 2, 1).otherwise(LEAST))
    names = [c for c in found.columns if c not in ("level", *KEYS)]
    at = lambda level, *keys: found.filter(F.col("level") == level).select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*names).alias(f"e{level}"))
    groups = rows.select(*KEYS).distinct().join(at(0, *KEYS), _same(KEYS), "left").drop("_lang", "_source")
    groups = groups.join(at(1, "lang"), _same(("lang",)), "left").join(at(2), F.lit(True), "left")
    # All numbers of one estimate, the finest there is.
    whole = cut(spark, groups.select(*KEYS, F.coalesce("e0", "e1", "e2").alias("e")).select(*KEYS, "e.*"))
    out = distance(_with(rows, whole)).withColumn("distance", F.col("d2") / F.col("scale"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True)))
