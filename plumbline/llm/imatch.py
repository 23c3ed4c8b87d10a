"""I-Match fingerprints over several randomised lexicons, with DataFrame functions only.

A term (a run of letters and digits, lowered) belongs to the lexicon if its document frequency lies between
LEAST and MOST of all documents; in tables of so few documents that LEAST or MOST of them is less than LEAST_COUNT,
LEAST_COUNT documents are the edge instead, for a term of one document marks nothing but that document. Each of the
randomised sub-lexicons, of several sizes, holds the lexicon's terms whose hash falls to it; each size draws by a hash
of its own, and the largest ones together hold every term. A text's fingerprint has, for each sub-lexicon, a hash over its distinct terms there in sorted
order, or an empty mark; the likeness of two fingerprints is the share of equal hashes among the
sub-lexicons that are not empty in both. Small sub-lexicons keep a local edit from touching most hashes.

The lexicon's size has a bound that does not grow with the corpus: each document adds at most its distinct
terms to the sum of all frequencies, so at most (mean distinct terms) / LEAST terms reach LEAST of the
documents. It is handed to the tasks as a bitmap of SLOTS bits, of fixed size, as a scalar; a rare term outside the band
that shares a slot with one inside is taken too, alike in every text. Terms are compared by 64-bit hashes.
A text with no lexicon term uses all its terms, and one without a term in any sub-lexicon its own hash.

The edited text of a document takes characters from the next one in descending order of id. That order is
cut into ranges of ids with about equal numbers of documents; texts go to their range once, are fingerprinted there
once, and a window gives the next text and fingerprint. The first document of each range follows the range before: it
is the greatest row of the range, combined before its shuffle.

Null texts are empty. Documents of equal id are ordered by text; null ids come last, and all documents of one id (or
of none) stand in one range. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut

#: Band of document frequency, as shares of all documents; bits of the bitmap; documents of a range; quantiles that place the ranges.
LEAST, MOST, SLOTS, RANGE, QUANTILES = 0.0005, 0.2, 1 << 22, 4096, 256
#: Sub-lexicons: EACH of every size; those of a size have one of so many parts of the lexicon each. A long text keeps terms in small ones, a short text needs large ones.
EACH, PARTS, SHIFTS = 8, (8, 64, 256, 1024, 4096), (27, 30, 36, 44, 52)
#: Bytes of text that a task of the shuffle gets.
SHUFFLED = 32 << 20
#: Least document frequency, for small tables.
LEAST_COUNT = 2
TERM_SPLIT = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.split(F.lower(text), TERM_SPLIT)
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def slot(h: Column) -> Column:
    return F.pmod(F.shiftright(h, 5), F.lit(SLOTS))


def bitmap(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """One row: the lexicon's bits as an array of SLOTS / 64 numbers."""
    n = docs.count()
    frequency = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    band = frequency.filter((F.col("df") >= max(LEAST_COUNT, least * n)) & (F.col("df") <= max(LEAST_COUNT, most * n)))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(shiftright(h, 5), {SLOTS}) % 64 AS INT))")
    words = band.groupBy(F.floor(slot(F.col("h")) / 64).alias("at")).agg(F.bit_or(bit).alias("bits"))
    every = docs.sparkSession.range(SLOTS // 64).withColumnRenamed("id", "at")
    rows = every.join(words, "at", "left").select("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("bits"))


def with_fingerprint(rows: DataFrame, lexicon: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of a text column: for each sub-lexicon a hash, or null where it has no term."""
    lexicon.createOrReplaceTempView(view := f"imatch_{uuid.uuid4().hex}")
    names = [F.col(c) for c in rows.columns]
    # The bitmap is a scalar subquery: its one value is shared by all rows of a task.
    rows = rows.select(*names, terms(F.col(text)).alias("_every"), F.expr(f"(SELECT first(bits) FROM {view})").alias("_bits"))
    inside = F.filter("_every", lambda h: F.getbit(F.element_at("_bits", (F.floor(slot(h) / 64) + 1).cast("int")), (slot(h) % 64).cast("int")) == 1)
    rows = rows.select(*names, "_every", inside.alias("_inside"))
    rows = rows.select(*names, F.sort_array(F.when(F.size("_inside") > 0, F.col("_inside")).otherwise(F.col("_every"))).alias("_terms"))
    return with_sets(rows, names, "_terms", text, out)


def with_sets(rows: DataFrame, names: list[Column], sorted_terms: str, text: str, out: str) -> DataFrame:
    """The columns of names, and the array of hashes, each over the sorted terms of one sub-lexicon; a text without any has its own hash in front."""

    def drawn(level: int, among) -> Callable[[Column], Column]:
        """Whether the part of a term, by bits of its hash that differ from size to size, is among the given ones."""
        return lambda h: among(F.pmod(F.shiftright(h, SHIFTS[level]), F.lit(PARTS[level])))

    levels, sets = [], []
    for level in range(len(PARTS)):
        levels.append(F.filter(sorted_terms, drawn(level, lambda p: p < EACH)).alias(f"_level{level}"))
        sets += [F.filter(f"_level{level}", drawn(level, partial(operator.eq, k))) for k in range(EACH)]
    rows = rows.select(*names, *levels)
    hashed = F.array(*(F.when(F.size(s) > 0, F.xxhash64(s)) for s in sets))
    rows = rows.select(*names, hashed.alias("_sets"))
    own = F.transform(F.sequence(F.lit(0), F.lit(EACH * len(PARTS) - 1)), lambda k: F.when(k == 0, F.xxhash64(F.lit("text"), F.col(text))))
    return rows.select(*names, F.when(F.exists("_sets", lambda h: h.isNotNull()), F.col("_sets")).otherwise(own).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the sub-lexicons that are not empty in both."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    any_ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda e: e))
    return same / any_


def text_of(fp: Column) -> Column:
    """A fingerprint as text: 16 hexadecimal digits for each sub-lexicon, - for an empty one."""
    return F.array_join(F.transform(fp, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit("-"))), ".")


def ranged(rows: DataFrame, size: int = RANGE, quantiles: int = QUANTILES) -> DataFrame:
    """Adds range: numbers that ascend with doc_id, about size rows of each, cut at quantiles of the ids."""
    n, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    parts = max(1, -(-n // size))
    steps = min(parts, quantiles)
    limits = rows.agg(F.percentile_approx("doc_id", [i / steps for i in range(1, steps)], 10_000)).first()[0] if steps > 1 and low is not None else []
    edges = sorted({low or 0, *limits}) + [(high or 0) + 1]
    within = -(-parts // steps)
    # Quantiles of the ids (at most QUANTILES numbers), each cut into equal intervals: a null id is last, so lowest.
    step = F.size(F.filter(F.array(*map(F.lit, edges[1:-1])), lambda x: x <= F.col("doc_id"))) if len(edges) > 2 else F.lit(0)
    rows = rows.withColumn("q", F.when(F.col("doc_id").isNull(), -1).otherwise(step).cast("int"))
    least, wide = (F.element_at(F.array(*map(F.lit, x)), F.greatest(F.col("q"), F.lit(0)) + 1).cast("double") for x in (edges[:-1], [b - a for a, b in zip(edges, edges[1:])]))
    part = F.least(F.floor((F.col("doc_id") - least) / wide * within), F.lit(within - 1))
    return rows.withColumn("range", (F.col("q") * within + F.coalesce(part, F.lit(0))).cast("long")).drop("q")


def with_next(rows: DataFrame, lexicon: DataFrame, size: int = RANGE) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp) of rows (doc_id, text): next_* are those of the next row in descending order of doc_id, after the last the first."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    placed = ranged(rows, size)
    dealt = with_fingerprint(placed.repartition(max(8, total // SHUFFLED), "range"), lexicon, "text", "fp")
    order = W.partitionBy("range").orderBy(F.desc("doc_id"), F.desc("text"))
    dealt = dealt.select("doc_id", "text", "fp", "range", F.lead(F.struct("text", "fp")).over(order).alias("next"))
    # The last row of a range is followed by the first of the range below, that of the lowest range by the very first.
    first = with_fingerprint(placed.groupBy("range").agg(F.max(F.struct("doc_id", "text"))["text"].alias("text")), lexicon, "text", "fp")
    above = F.coalesce(F.lag("range").over(W.orderBy(F.desc("range"))), F.min("range").over(W.partitionBy()))
    first = first.select(above.alias("range"), F.struct("text", "fp").alias("follows"))
    out = dealt.join(first, "range").withColumn("next", F.coalesce("next", "follows"))
    return out.select("doc_id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))


def report(docs: DataFrame, least: float = LEAST, most: float = MOST, size: int = RANGE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document."""
    lexicon = cut(docs.sparkSession, bitmap(docs, least, most))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, lexicon, size)
    edited = F.concat(F.expr("left(text, length(text) - CAST(floor(length(text) / 3) AS INT))"), F.expr("left(next_text, CAST(floor(length(text) / 3) AS INT))"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = with_fingerprint(rows, lexicon, "edited", "edited_fp")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
