"""I-Match fingerprints: hashes of a text's mid-frequency terms under several randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band (`BAND`, as shares of all documents), so it has at
most the mean number of distinct terms over the lower share, whatever the size of the corpus. Of it, `SUBSETS` random
sub-lexicons are drawn once for all texts: number k keeps each term with a probability of 1 in 2 ** (1 + k % `SIZES`), so
that short texts have terms in the large ones and long texts few terms in the small ones. A text's lexicon terms are
distinct and sorted, and what a sub-lexicon keeps of them is hashed. Two texts are as alike as the share of sub-lexicons
under which both keep the same, non-empty terms, among those under which either keeps any. DataFrame functions only.

Defined results: a null text counts as empty; a text without lexicon terms uses all its terms, one without terms has
the fingerprint of no terms and likeness 0 to any other; rows with equal ids are ordered by text; rows without an id
come last; a table of one row is its own neighbour; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import WORD, materialize

BAND = (0.01, 0.25)
SUBSETS, SIZES = 32, 8
#: Ranges of ids for each shuffle partition, when documents are put in order.
RANGES = 8


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words of a text."""
    return F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(term): hashes of terms in at least band[0] and at most band[1] of all documents, in two at least."""
    counted = docs.select(F.explode(terms(F.coalesce(text_col, F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    return counted.where(F.col("df").between(max(2.0, n * band[0]), max(2.0, n * band[1]))).select("term")


def with_kept(df: DataFrame, text: str, name: str, lexicon_terms: Column) -> DataFrame:
    """Adds name: a text's lexicon terms (all its terms, if it has none), distinct and sorted."""
    df = df.withColumn(f"{name}_own", terms(F.col(text)))
    df = df.withColumn(name, F.array_intersect(f"{name}_own", lexicon_terms))
    return df.withColumn(name, F.sort_array(F.when(F.size(name) > 0, F.col(name)).otherwise(F.col(f"{name}_own")))).drop(f"{name}_own")


def fingerprint(kept: Column) -> Column:
    """One hash for each sub-lexicon of sorted terms; null where it keeps nothing."""
    parts = F.lit([2 ** (1 + k % SIZES) for k in range(SUBSETS)])

    def one(k: Column) -> Column:
        inside = F.filter(kept, lambda t: F.pmod(F.xxhash64(t, k), F.element_at(parts, k)) == 0)
        return F.transform(F.array(inside), lambda x: F.when(F.size(x) > 0, F.xxhash64(x)))[0]

    return F.transform(F.sequence(F.lit(1), F.lit(SUBSETS)), one)


def as_text(fp: Column) -> Column:
    """The hashes in order, an empty sub-lexicon as `-`."""
    return F.array_join(F.transform(fp, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of sub-lexicons under which both texts keep the same terms, of those under which either keeps any."""
    same = F.size(F.filter(F.zip_with(a, b, lambda p, q: F.coalesce(p == q, F.lit(False))), lambda x: x))
    held = F.size(F.filter(F.zip_with(a, b, lambda p, q: p.isNotNull() | q.isNotNull()), lambda x: x))
    return F.when(held > 0, same / held).otherwise(F.lit(0.0))


def range_of(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are below key, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = F.lit(bounds[::step]), F.lit(bounds)
    block = F.size(F.filter(coarse, lambda x: x < key))
    within = F.transform(F.array(F.greatest(block - 1, F.lit(0)) * step), lambda at: at + F.size(F.filter(F.slice(fine, at + 1, F.lit(step)), lambda x: x < key)))
    return within[0]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """Rows (_range, _ghost, id, text) and a window over them in which each row's successor by descending id follows it.

    Ids are cut into ranges at approximate quantiles; the first rows of each range also stand, as ghosts, at the end of
    the one before it (of the last range, for the first), so no window spans more than a range.
    """
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx(id_col, grid, 20 * ranges)).first()[0] or []))
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"), F.when(F.col(id_col).isNull(), ranges + 1).otherwise(len(bounds) - range_of(F.col(id_col), bounds)).alias("_range"))
    firsts = rows.groupBy("_range").agg(F.max(id_col).alias("_first"))  # as many rows as ranges
    firsts = firsts.select("_first", F.col("_range").alias("_own"), F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.max("_range").over(Window.partitionBy())).alias("_before"))
    joined = rows.join(F.broadcast(firsts), (F.col("_own") == F.col("_range")) & F.col("_first").eqNullSafe(F.col(id_col)), "left")
    real = F.struct(F.col("_range").alias("_range"), F.lit(0).alias("_ghost"))
    ghost = F.struct(F.col("_before").alias("_range"), F.lit(1).alias("_ghost"))
    dealt = joined.select(id_col, "_text", F.inline(F.when(F.col("_before").isNull(), F.array(real)).otherwise(F.array(real, ghost))))
    return dealt, Window.partitionBy("_range").orderBy("_ghost", F.col(id_col).desc_nulls_last(), "_text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of each text and of the text whose last third is the beginning of the next one's."""
    words = materialize(lexicon(docs, text_col, band), "lexicon")
    known = words.agg(F.coalesce(F.collect_list("term"), F.expr("cast(array() as array<bigint>)"))).scalar()
    dealt, order = in_order(docs, id_col, text_col)
    step = dealt.withColumn("_next", F.coalesce(F.lead("_text").over(order), F.lit("")))
    step = step.withColumn("n_chars", F.length("_text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    step = step.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - F.col("_cut")), F.substring("_next", F.lit(1), F.col("_cut")))).drop("_next", "_cut")
    step = step.withColumn("edited_sha256", F.sha2("_edited", 256))
    step = with_kept(with_kept(step, "_text", "_terms", known), "_edited", "_eterms", known)
    step = step.withColumn("_fp", fingerprint(F.col("_terms"))).withColumn("_efp", fingerprint(F.col("_eterms")))
    step = step.select("_range", "_ghost", id_col, "_text", "n_chars", "edited_sha256", "_fp", "_efp").withColumn("_nfp", F.lead("_fp").over(order))
    return step.where(F.col("_ghost") == 0).select(
        id_col, "n_chars", "edited_sha256", as_text(F.col("_fp")).alias("fingerprint"), as_text(F.col("_efp")).alias("edited_fingerprint"), likeness(F.col("_fp"), F.col("_efp")).alias("near_edited"), likeness(F.col("_fp"), F.col("_nfp")).alias("near_next")
    )
