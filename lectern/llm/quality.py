"""Quality rules: text statistics as Spark expressions, and decision lists learned from labelled statistics.

Learning is sequential covering. A bounded sample of labelled documents (`SAMPLE_ROWS`, by hash of the id) is reduced by
Spark to a table of counts per combination of feature bins; rules are conjunctions of at most `MAX_CONDITIONS`
thresholds, grown by information gain on two thirds of the sample and pruned on the rest. The outcome is an ordered
list of Spark conditional expressions. All of it is DataFrame functions; the driver sees the counts only.

Defined results: a null text has no words and counts as empty; documents below the base limits are rejected whatever
the rules say; null labels are left out of the sample; without labels (or without low-quality ones) there are no rules
and only the base limits decide; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import WORD, hash_sample, materialize

WINDOW = 5
SAMPLE_ROWS = 12_000
MAX_RULES, MAX_CONDITIONS, BINS = 10, 3, 24
MIN_COVER, MIN_PRECISION = 4, 0.8


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from the array of window hashes in text order."""

    def heavy(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: F.coalesce(x["h"] == F.get(ordered, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, i + 1)["h"], F.lit(False)))
        return _let(
            F.sort_array(F.transform(twice, lambda x: x["p"])),
            lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b),
        )

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(ordered, heavy))


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: word, symbol, line and repetition counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col), text.alias("_text"))
    step = step.select(
        id_col,
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_text", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("_text", F.lit(r"\p{N}")).cast("long").alias("n_digits"),
    )
    step = step.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    hashes = F.col("_hashes")
    step = step.withColumn(
        "_windows",
        F.when(F.size("_hashes") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")),
    )
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated_words(F.col("_windows")),
        "n_lines": F.size("_lines"),
        "n_upper": F.col("n_upper"),
        "n_marks": F.col("n_marks"),
        "n_digits": F.col("n_digits"),
    }
    # a generator of one row: filters on the counts stay above it, so that no count is worked out twice
    return step.select(id_col, F.inline(F.array(F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]))))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios that the rules test, from the columns of text_stats(); 0 where the divisor is."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "upper_case": share("n_upper", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"),
        "digits": share("n_digits", "word_chars"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def expression(self) -> Column:
        test = F.lit(True)
        for c in self.conditions:
            test = test & c.expression()
        return test

    def name(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.4g}" for c in self.conditions)


@dataclass(frozen=True)
class Cell:
    """Sample rows that share all feature bins: bins by feature, and good and bad rows in the growing and pruning parts."""

    bins: tuple[int, ...]
    grow: tuple[int, int]
    prune: tuple[int, int]


def labelled_cells(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> tuple[list[Cell], list[list[float]]]:
    """The sample as counts per combination of bins, and each feature's thresholds."""
    names = list(features())
    chosen = hash_sample(labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")), F.col("_id"), sample_rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # sample_rows bounds what is sent
    stats = text_stats(sample.withColumn("_key", F.struct("_id", "_label")), "_key", "_text")
    stats = materialize(stats.where(~base_failed()).select(F.col("_key._label").alias("_label"), F.pmod(F.xxhash64("_key._id"), F.lit(3)).alias("_fold"), *[v.alias(k) for k, v in features().items()]), "labelled")
    grid = [k / BINS for k in range(1, BINS)]
    row = stats.agg(*[F.percentile_approx(n, grid, 10_000).alias(n) for n in names], *[F.percentile_approx(F.when(F.col("_label") == 0, F.col(n)), grid, 10_000).alias(f"{n}_bad") for n in names]).first()
    cuts = [sorted({*(row[n] or []), *(row[f"{n}_bad"] or [])}) for n in names]
    binned = [sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cut), F.lit(0)).alias(n) for n, cut in zip(names, cuts, strict=True)]
    good, bad, grow = F.col("_label") != 0, F.col("_label") == 0, F.col("_fold") < 2
    rows = stats.select("_label", "_fold", *binned).groupBy(*names).agg(*[F.count_if(x & y) for y in (grow, ~grow) for x in (good, bad)]).collect()  # sample_rows at most
    return [Cell(tuple(r[: len(names)]), (r[-4], r[-3]), (r[-2], r[-1])) for r in sorted(rows)], cuts


def _totals(cells: list[Cell], part: str) -> tuple[int, int]:
    return sum(getattr(c, part)[0] for c in cells), sum(getattr(c, part)[1] for c in cells)


def _covers(test: tuple[int, bool, int], cell: Cell) -> bool:
    feature, above, k = test
    return cell.bins[feature] > k if above else cell.bins[feature] <= k


def _best_condition(cells: list[Cell], counts: list[int]) -> tuple[float, tuple[int, bool, int]] | None:
    """The threshold with the largest information gain for bad rows; sums over bins give every threshold in one pass."""
    good, bad = _totals(cells, "grow")
    before = math.log2(bad / (good + bad)) if bad else 0.0
    best = None
    for f, n in enumerate(counts):
        sums = [[0, 0] for _ in range(n + 1)]
        for c in cells:
            sums[c.bins[f]][0] += c.grow[0]
            sums[c.bins[f]][1] += c.grow[1]
        low = [0, 0]
        for k in range(n):
            low = [low[0] + sums[k][0], low[1] + sums[k][1]]
            for above, (g, b) in ((False, low), (True, (good - low[0], bad - low[1]))):
                if b >= MIN_COVER and g + b < good + bad and (gain := b * (math.log2(b / (g + b)) - before)) > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, (f, above, k))
    return best


def learn_rules(cells: list[Cell], cuts: list[list[float]]) -> list[Rule]:
    """Sequential covering: grow a conjunction, prune it, keep it if it is precise, take away what it covers."""
    names, rules, left = list(features()), [], list(cells)
    while len(rules) < MAX_RULES:
        tests, inside = [], left
        while len(tests) < MAX_CONDITIONS and _totals(inside, "grow")[0]:
            found = _best_condition(inside, [len(c) for c in cuts])
            if not found:
                break
            tests.append(found[1])
            inside = [c for c in inside if _covers(found[1], c)]

        def worth(tests: list) -> float:
            g, b = _totals([c for c in left if all(_covers(t, c) for t in tests)], "prune")
            return (b - g) / (g + b) if g + b else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        covered = [c for c in left if all(_covers(t, c) for t in tests)]
        good, bad = (a + b for a, b in zip(_totals(covered, "grow"), _totals(covered, "prune"), strict=True))
        if not tests or bad < MIN_COVER or bad < MIN_PRECISION * (good + bad):
            break
        rules.append(Rule(tuple(Condition(names[f], above, cuts[f][k]) for f, above, k in tests), bad / (good + bad), good + bad))
        left = [c for c in left if not all(_covers(t, c) for t in tests)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    return learn_rules(*labelled_cells(docs, labels, id_col, text_col, label_col, sample_rows))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (number of the first rule that rejects, else null) and kept."""
    rule = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        rule = F.when(rules[k].expression(), F.lit(k + 1)).otherwise(rule)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
