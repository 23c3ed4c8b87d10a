"""How the sources of each language differ in their terms, in exact integers.

A language keeps the terms of at least LEAST of its documents. A group (language and source) gives each kept term a
smoothed share p of its occurrences, and two shares differ by f(p, q) = floor((p - q)^2 / (p + q)). For two sources that
is summed over all kept terms, though most terms do not occur in most sources:

    sum of f = V f(a0, b0)                        as if no term occurred in either (a0, b0: shares of a count of zero)
             + sum of f(a, b0) - f(a0, b0)        for each distinct count of one source alone, and of the other alone
             + sum of f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)     for terms that both have

The last sum comes from a frequent-pattern tree. A term's row lists its sources in order, each with its share; equal
rows are merged with a multiplicity, and rows that begin alike share their first nodes. A node holds the multiplicity of
the rows below it, so each combination of a node and one of its ancestors is computed once, however many terms share it.

Work by scale: tokens are counted by (language, term, source) before the shuffle, so a hot source or word sends one row for
each task. A term's row is bounded by the number of sources. Distinct rows are dealt by ranges of (language, row), so
that neighbours share nodes, and each task builds the trees of bounded chunks of its range; cutting a tree costs shared
nodes, never results. All other relations have a row for each source or pair of sources of a language.

Null text, language and source are empty. Every row is a document, repeated ones too. Texts of any length are read whole. A
language without kept terms has the value 0 for each pair and no terms. Ties of a rank go by item. Extra columns are ignored.
An empty table gives an empty result. Sums are longs: exact while V stays under four thousand million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut

#: Runs of letters: anything but the ASCII characters that are none. Only A-Z are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least documents of a kept term, the unit of shares, what each count is raised by, ranks of terms.
LEAST, UNIT, PRIOR, TOP = 10, 1_000_000_000, 2, 10
#: Cells (rows times the longest row) of a chunk of the tree.
CELLS = 2_000_000


def counted(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, d): occurrences, and documents that have the term."""
    terms = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), terms.alias("terms"))
    # Behind a document's occurrences stand its distinct terms: plain strings told apart by position, for a struct each would cost more than its count.
    both = F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term")
    occurs = F.col("at") < F.col("size")
    return rows.select("lang", "source", F.size("terms").alias("size"), both).groupBy("lang", "term", "source").agg(F.count_if(occurs).alias("n"), F.count_if(~occurs).alias("d"))


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, items): the kept terms with their counts by source."""
    by = counted(docs).groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("items"))
    return by.filter(F.col("d") >= least).drop("d")


def share(n: Column, of: Column, kept: Column) -> Column:
    """1 + floor(UNIT (n + PRIOR) / (of + PRIOR kept)), in decimals, for the product may exceed a long; null if nothing is kept."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.when(kept > 0, 1 + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n + PRIOR), wide(of + PRIOR * kept)))


def differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, nth, n, v, all, zero) of each group: its number within the language, its occurrences of kept terms, the
    language's kept terms and their occurrences, and its share of a term that it does not have."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    sums = terms.select("lang", F.inline("items")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    out = docs.select(*empty).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "all"])
    out = out.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    return out.withColumn("zero", share(F.lit(0), F.col("n"), F.col("v")))


def cells_of(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, term, source, nth, p, zero, q) of each term and source that has it: the group's share, and the language's."""
    rows = terms.select("lang", "term", "total", F.inline("items")).withColumnRenamed("n", "has")
    rows = rows.join(groups, ["lang", "source"])
    return rows.select("lang", "term", "source", "nth", share(F.col("has"), F.col("n"), F.col("v")).alias("p"), "zero", share(F.col("total"), F.col("all"), F.col("v")).alias("q"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tree(source: np.ndarray, p: np.ndarray, zero: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sum): corrections of the pairs of sources in the rows of one language, through their tree.

    Rows are sorted; source (rows x depth) is -1 behind a row's end. A row opens the nodes deeper than what it has in common
    with the row before; a node lasts to the next row that opens one at its depth.
    """
    same = (source[1:] == source[:-1]) & (p[1:] == p[:-1]) & (source[1:] >= 0)
    common = np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(1)])
    found = []
    for depth in range(1, source.shape[1]):
        live = np.flatnonzero(source[:, depth] >= 0)
        if not len(live):
            break
        opens = np.flatnonzero(common[live] <= depth)
        m, at = np.add.reduceat(times[live], opens), live[opens]
        a, a0, b, b0 = p[at, :depth], zero[at, :depth], p[at, depth, None], zero[at, depth, None]
        gain = (_f(a, b) - _f(a, b0) - _f(a0, b) + _f(a0, b0)) * m[:, None]
        i, j = source[at, :depth].ravel(), np.repeat(source[at, depth], depth)
        found.append(_summed(i, j, gain.ravel()))
    return _summed(*(np.concatenate(x) for x in zip(*found))) if found else (np.empty(0, np.int64),) * 3


def _summed(i: np.ndarray, j: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((j, i))
    i, j, value = i[order], j[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    return i[first], j[first], np.add.reduceat(value, first)


def _padded(flat: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    out = np.full((len(sizes), int(sizes.max())), fill, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows of one language, at most CELLS cells at a time (or one row)."""
    for b in batches:
        sizes = b.column("path").value_lengths().to_numpy(zero_copy_only=False)
        lang = b.column("lang").to_pylist()
        first = 0
        widest = 0
        for i in range(b.num_rows):
            widest = max(widest, int(sizes[i]))
            if i > first and (lang[i] != lang[first] or widest * (i + 1 - first) > CELLS):
                yield b.slice(first, i - first)
                first, widest = i, int(sizes[i])
        if b.num_rows:
            yield b.slice(first)


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, i, j, value) of the trees of sorted (lang, path, times)."""
    for b in _chunks(batches):
        path = b.column("path")
        flat, sizes = path.flatten(), path.value_lengths().to_numpy(zero_copy_only=False)
        source, p, zero = (_padded(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64), sizes, fill) for k, fill in ((0, -1), (1, 1), (2, 1)))
        i, j, value = tree(source, p, zero, b.column("times").to_numpy(zero_copy_only=False).astype(np.int64))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array([b.column("lang")[0].as_py()] * len(i), pa.string()), *(pa.array(x, pa.int64()) for x in (i, j, value))], ["lang", "i", "j", "value"])


def pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, value): the sum of f over all kept terms for each two sources, i before j."""
    a, b = (groups.select("lang", F.col("nth").cast("long").alias(n), F.col("zero").alias(f"{n}0"), "v") for n in "ij")
    both = a.join(b.drop("v"), "lang").filter("i <> j")
    nothing = both.filter("i < j").select("lang", "i", "j", F.when(F.col("v") > 0, F.col("v") * differ(F.col("i0"), F.col("j0"))).otherwise(F.lit(0)).alias("value"))
    counts = cells.groupBy("lang", F.col("nth").cast("long").alias("i"), "p").agg(F.count("*").alias("times"))
    alone = counts.join(both, ["lang", "i"]).select("lang", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("times") * (differ(F.col("p"), F.col("j0")) - differ(F.col("i0"), F.col("j0")))).alias("value"))
    rows = cells.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("nth", "p", "zero"))).alias("path"))
    rows = rows.filter(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("times"))
    rows = rows.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    together = rows.mapInArrow(corrections, "lang string, i long, j long, value long")
    return nothing.unionByName(alone).unionByName(together).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` ranks the other sources of the language, `term` the terms that a source
    has more of than its language, at most `top` of them."""
    spark = docs.sparkSession
    terms = cut(spark, kept_terms(docs, least))
    groups = cut(spark, groups_of(docs, terms))
    cells = cells_of(terms, groups)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = pairs(cells, groups)
    found = found.unionByName(found.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    names = groups.select("lang", F.col("nth").cast("long").alias("nth"), "source")
    named = found.join(names.withColumnRenamed("nth", "i"), ["lang", "i"]).join(names.select("lang", F.col("nth").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    others = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    more = cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value"))
    own = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return others.unionByName(own.withColumn("part", F.lit("term")).select(*others.columns))
