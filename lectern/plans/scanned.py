"""Scanned text: corrections and confidence, as column expressions over a table of readings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import adapters
from lectern.registry import register

# Corrections of scanned text (pattern, replacement), in order; letter case does not matter.
CORRECTIONS = [
    (r"\brn\b", "m"),
    (r"\bvv\b", "w"),
    (r"\bIl\b", "H"),
    (r"(?<=[A-Z])0(?=[A-Z])", "O"),
    (r"(?<=[a-z])0(?=[a-z])", "o"),
    (r"(?<=[A-Z])1(?=[A-Z])", "I"),
    (r"(?<=[a-z])1(?=[a-z])", "l"),
    (r"[“”]", '"'),
    (r"[‘’]", "'"),
    (r"V01\.?\s*(\d+)", "Vol. $1"),
    (r"V0LUME\s*(\d+)", "Volume $1"),
    (r"(\d+)[stndrdth]+\s*[Ee]d\.?", "$1st Ed."),
    (r"\bPENGU1N\b", "PENGUIN"),
    (r"\bRAND0M\b", "RANDOM"),
    (r"\bH0USE\b", "HOUSE"),
]
# Characters that stay, and words that stay small inside a title.
NOISE = r"""[^a-zA-Z0-9 .,;:!?'\-"()\[\]&]"""
SMALL_WORDS = ["a", "an", "the", "and", "but", "or", "nor", "for", "yet", "so", "at", "by", "in", "of", "on", "to", "up", "as", "is"]
# Shares of the four scores; letter frequencies of English; signs of bad readings and of books; publishers.
WEIGHTS = {"engine": 0.35, "pattern": 0.25, "language": 0.25, "book": 0.15}
LETTERS = {
    "e": 0.127, "t": 0.091, "a": 0.082, "o": 0.075, "i": 0.070, "n": 0.067, "s": 0.063, "h": 0.061, "r": 0.060, "d": 0.043, "l": 0.040, "c": 0.028, "u": 0.028,
    "m": 0.024, "w": 0.024, "f": 0.022, "g": 0.020, "y": 0.020, "p": 0.019, "b": 0.015, "v": 0.010, "k": 0.008, "j": 0.002, "x": 0.002, "q": 0.001, "z": 0.001,
}
SUSPICIOUS = [r"[^\x00-\x7F]{3,}", r"(.)\1{4,}", r"[^aeiouAEIOU\s]{8,}", r"\d{10,}", r"[!@#$%^&*]{3,}"]
BOOK_SIGNS = [
    r"\bnovel\b", r"\bstory\b", r"\btale\b", r"\bbook\b", r"\bchapter\b", r"\bvolume\b", r"\bpart\b", r"\bseries\b", r"\bedition\b", r"\bpublish", r"\bauthor\b", r"\bwriter\b",
    r"\bfiction\b", r"\bnonfiction\b", r"\bmystery\b", r"\bromance\b", r"\bthriller\b", r"\bscifi\b", r"\bfantasy\b", r"\bhistory\b",
]
PUBLISHERS = ["penguin", "random house", "harper", "simon", "macmillan", "hachette", "scholastic", "wiley", "pearson", "mcgraw"]


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Compatibility composition without non-spacing marks (Spark has no such function)."""
    return text.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Mn"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def title_case(text: Column) -> Column:
    """Words capitalised, but small words between the first and the last."""

    def one(w: Column, i: Column, n: Column) -> Column:
        inner = (i > 0) & (i < n - 1)
        return F.when(inner & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))

    # the words are bound once: neither they nor their number are worked out anew for each of them
    bound = F.transform(F.array(words_of(text)), lambda words: F.transform(words, lambda w, i: one(w, i, F.size(words))))
    return F.array_join(F.get(bound, F.lit(0)), " ")


# What is mended in names of authors, in order.
NAME_FIXES = [(r"\bJr\b", "Jr."), (r"\bSr\b", "Sr."), (r"\bDr\b", "Dr."), (r"\bMc ([A-Z])", "Mc$1"), (r"\bO ([A-Z])", "O'$1")]


def author_name(text: Column) -> Column:
    """A normalized text as a person's name: what stands behind the first comma comes first, each run of letters is capitalised."""
    back = F.trim(F.substring(text, F.instr(text, ",") + 1, F.length(text)))
    name = F.when(F.contains(text, F.lit(",")), F.concat(back, F.lit(" "), F.trim(F.substring_index(text, ",", 1)))).otherwise(text)
    runs = F.regexp_extract_all(name, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    name = F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")
    for pattern, new in NAME_FIXES:
        name = F.regexp_replace(name, pattern, new)
    return F.trim(name)


def normalized(df: DataFrame, text: str, title: bool = False, least: int = 1) -> DataFrame:
    """Adds normalized, corrections (how many of the rules changed the text) and adjustment (of its confidence).

    A null text counts as empty. title asks for title case; words of fewer than least characters go.
    """
    df = df.withColumn("normalized", F.regexp_replace(composed(F.coalesce(F.col(text), F.lit(""))), NOISE, " ")).withColumn("corrections", F.lit(0))
    for k in range(0, len(CORRECTIONS), 3):  # a few rules a step, so that no text is worked out twice
        before, changed = F.col("normalized"), F.col("corrections")
        for pattern, new in CORRECTIONS[k : k + 3]:
            after = F.regexp_replace(before, f"(?i){pattern}", new)
            changed, before = changed + (after != before).cast("int"), after
        df = df.withColumns({"normalized": before, "corrections": changed})
    out = F.trim(F.regexp_replace(F.regexp_replace("normalized", r"\s+", " "), r"\s*-\s*", "-"))
    if title:
        out = title_case(out)
    if least > 1:
        out = F.array_join(F.filter(words_of(out), lambda w: F.length(w) >= least), " ")
    return df.withColumns({"normalized": F.trim(out), "adjustment": F.greatest(F.lit(-0.3), F.col("corrections") * -0.02)})


def scored(df: DataFrame, text: str, engine: str, source: Column | None = None) -> DataFrame:
    """Adds pattern_score, language_score, book_score, final_confidence and flags; a text without words has them all at 0."""
    kept = df.columns
    # what is counted is worked out once, in steps, not anew in each score and flag
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    t, low, words = F.col("_t"), F.col("_low"), F.col("_words")
    df = df.withColumns({"_low": F.lower(t), "_words": words_of(t)})
    df = df.withColumns({
        "_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")), "_digits": F.length(F.regexp_replace(t, r"\P{N}+", "")), "_blanks": F.length(F.regexp_replace(t, r"\S+", "")),
        "_vowels": F.length(low) - F.length(F.translate(low, "aeiou", "")), **{f"_n_{c}": F.length(t) - F.length(F.replace(low, F.lit(c), F.lit(""))) for c in LETTERS},
        "_total": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)), "_usual": F.size(F.filter(words, lambda w: F.length(w).between(2, 20) & w.rlike("[aeiouAEIOU]"))), "_capital": F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))),
        "_isbn": t.rlike(r"\b97[89]\d{10}\b|\b\d{9}[\dX]\b"), "_publisher": low.rlike("|".join(PUBLISHERS)), "_signs": low.rlike("|".join(BOOK_SIGNS)),
        "_bare": F.regexp_replace(t, r"^\s+|\s+$", ""), **{f"_suspicious_{k}": t.rlike(p) for k, p in enumerate(SUSPICIOUS)},
    })
    n, size = F.size(words), F.greatest(F.length(t), F.lit(1))
    letters, digits, blanks, usual, capital, isbn, publisher, bare = (F.col(f"_{c}") for c in ("letters", "digits", "blanks", "usual", "capital", "isbn", "publisher", "bare"))
    each = F.greatest(letters, F.lit(1))
    fit = sum((F.greatest(F.lit(0.0), 1 - 5 * F.abs(F.col(f"_n_{c}") / each - share)) for c, share in LETTERS.items()), F.lit(0.0)) / len(LETTERS)
    df = df.withColumns({"_fit": fit, "_mean": F.col("_total") / F.greatest(n, F.lit(1))})
    fit, mean = F.col("_fit"), F.col("_mean")
    penalties = [*[(F.col(f"_suspicious_{k}"), 0.15, "suspicious_pattern") for k in range(len(SUSPICIOUS))], (mean < 2, 0.1, "short_words"), (mean > 15, 0.1, "long_words"), (usual < 0.5 * n, 0.15, "unusual_words"), (letters < 0.5 * size, 0.1, "low_letter_ratio"), (F.length(t) - letters - digits - blanks > 0.2 * size, 0.1, "high_special_ratio")]
    pattern = F.greatest(F.lit(0.0), 1.0 - sum((F.when(test, loss).otherwise(0.0) for test, loss, _ in penalties), F.lit(0.0)))

    vowels = F.col("_vowels") / each
    odd_vowels = (vowels < 0.2) | (vowels > 0.6)
    language = F.when(letters == 0, 0.3).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fit - F.when(odd_vowels, 0.1).otherwise(0.0))))

    gains = [(F.col("_signs"), 0.1), (capital > 0.5 * n, 0.1), (n.between(2, 8), 0.1), (isbn, 0.15), (publisher, 0.1)]
    book = F.least(F.lit(1.0), 0.5 + sum((F.when(test, gain).otherwise(0.0) for test, gain in gains), F.lit(0.0)))

    short, numeric = F.length(bare) < 3, bare.rlike(r"^\p{N}+$")
    loss = F.when(short, 0.2).otherwise(0.0) + F.when(numeric, 0.1).otherwise(0.0)
    if source is not None:
        loss = loss + F.when((source == "spine") & (F.col(engine) < 0.6), 0.05).otherwise(0.0)
    flags = [*[(test, name) for test, _, name in penalties], (letters == 0, "no_letters"), ((letters > 0) & (fit < 0.4), "unusual_letter_dist"), ((letters > 0) & odd_vowels, "unusual_vowel_ratio"), (capital > 0.5 * n, "capitalized_words"), (isbn, "isbn_present"), (publisher, "publisher_name"), (short, "very_short"), (numeric, "numeric_only")]
    some = n > 0
    df = df.withColumns({
        "pattern_score": F.when(some, pattern).otherwise(0.0), "language_score": F.when(some, language).otherwise(0.0), "book_score": F.when(some, book).otherwise(0.0), "_loss": loss,
        "flags": F.when(some, F.array_compact(F.array(*[F.when(test, name) for test, name in flags]))).otherwise(F.array(F.lit("empty_text"))),
    })
    total = WEIGHTS["engine"] * F.col(engine) + WEIGHTS["pattern"] * F.col("pattern_score") + WEIGHTS["language"] * F.col("language_score") + WEIGHTS["book"] * F.col("book_score") - F.col("_loss")
    final = F.when(F.array_contains("flags", "empty_text"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return df.withColumn("final_confidence", final).select(*kept, "pattern_score", "language_score", "book_score", "flags", "final_confidence")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return adapters.view(s, d, "ocr_pairs")


def _normalize(s: SparkSession, d: str) -> DataFrame:
    return normalized(_pairs(s, d).select("sample_id", "prediction"), "prediction").select("sample_id", F.col("normalized").alias("text"), "corrections", "adjustment")


def _modes(s: SparkSession, d: str) -> DataFrame:
    rows = normalized(_pairs(s, d).select("sample_id", "truth"), "truth").select("sample_id", F.col("normalized").alias("plain"))
    return rows.select("sample_id", "plain", F.trim(title_case(F.col("plain"))).alias("title"), author_name(F.col("plain")).alias("author"))


def _confidence(s: SparkSession, d: str) -> DataFrame:
    rows = scored(_pairs(s, d), "prediction", "confidence", F.when(F.col("sample_id") % 2 == 0, "spine").otherwise("cover"))
    return rows.select("sample_id", *[F.round(c, 6).alias(c) for c in ("pattern_score", "language_score", "book_score", "final_confidence")], F.array_join("flags", ",").alias("flags"))


register("normalize_ocr_text", _normalize)
register("batch_normalize", _modes)
register("ocr_confidence", _confidence)
