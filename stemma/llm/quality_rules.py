"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean expression that is true for a text to reject. On a bounded sample the
operator times every rule and counts what it rejects, then orders the rules by rejection per cost
and chains them in one CASE, so that for each row the rules after the first rejection aren't evaluated.
The order changes the speed alone: the verdict is the disjunction of the rules.

Nulls: a null text has no words and is rejected by the first base rule. Empty and blank texts: the
same. Very long texts: whole, in one row. Repeated rows: each is judged for itself. Empty tables:
empty result. Other columns, whatever their names, pass through untouched; names given here replace
columns of the same name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import let, stored, words_of

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 256


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the text, the first included."""

    def covered(hashes: Column) -> Column:
        def flagged(rows: Column) -> Column:
            same = F.filter(rows, lambda e, k: F.coalesce(F.get(rows, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(rows, k + 1)["h"] == e["h"], F.lit(False)))
            return F.aggregate(
                F.sort_array(F.transform(same, lambda e: e["i"])),
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
                lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
            )["n"]

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, flagged))

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: let(windows(w), covered))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


@dataclass(frozen=True)
class Measures:
    """What rules are made of: columns, or expressions that are evaluated only where a rule needs them."""

    text: Column
    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column

    @classmethod
    def of(cls, text: Column, words: Column | None = None) -> Measures:
        words = words_of(text) if words is None else words
        full = F.coalesce(text, F.lit(""))
        return cls(
            text=full,
            words=words,
            n_words=F.size(words).cast("long"),
            word_chars=F.length(F.regexp_replace(full, r"[\x20\x09-\x0D]+", "")).cast("long"),
            n_symbols=F.regexp_count(full, F.lit("[#*$%&|<>]")).cast("long"),
            n_dup_lines=duplicate_lines(text),
            n_repeat_words=repeated_words(words),
        )


#: The measures that the query returns.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], Column]


def _capitals(m: Measures) -> Column:
    return F.length(m.text) - F.length(F.regexp_replace(m.text, "[A-Z]+", ""))


BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
RULES = (
    Rule("symbols", lambda m: 100 * m.n_symbols > 20 * m.n_words),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words)),
    Rule("capitals", lambda m: 100 * _capitals(m) > 50 * m.word_chars),
    Rule("duplicate_lines", lambda m: 100 * m.n_dup_lines > 50 * F.size(F.split(m.text, "\n"))),
    Rule("long_word", lambda m: F.exists(m.words, lambda w: F.length(w) > 1000)),
)


def estimate(df: DataFrame, rules: Sequence[Rule], text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Of each rule: its seconds over a sample of about ``rows`` rows, and the share that it rejects.

    Each rule runs as one aggregate over the same sample; the driver gets one row of figures. Only
    the order of evaluation depends on them.
    """
    # drawn over the whole table and kept in Spark: the driver gets no text
    total = df.count()
    sample = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).sample(min(1.0, rows / total) if total else 1.0, 1)
    sample = stored(sample, "sample").withColumn("words", words_of(F.col("text")))
    m = Measures.of(F.col("text"), F.col("words"))

    def run(condition: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(condition.cast("double")).alias("share")).first()["share"]
        return time.perf_counter() - began, share or 0.0

    run(F.lit(True))  # the first job also starts workers
    floor, _ = run(F.lit(True))
    found = []
    for rule in rules:
        seconds, share = run(rule.rejects(m))
        found.append((rule, max(seconds - floor, 1e-4), share))
    return found


def ordered(found: Sequence[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejection per cost, greatest first; ties by name."""
    return [rule for rule, cost, share in sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))]


def rejected(rules: Sequence[Rule], m: Measures) -> Column:
    """True for texts that a rule rejects; later rules aren't evaluated for them."""
    chain = None
    for rule in rules:
        chain = F.when(rule.rejects(m), F.lit(True)) if chain is None else chain.when(rule.rejects(m), F.lit(True))
    return F.lit(False) if chain is None else chain.otherwise(F.lit(False))


def filter_quality(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BASE_RULES + RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``df``."""
    order = ordered(estimate(df, rules, text_col))
    return df.where(~let(words_of(F.col(text_col)), lambda w: rejected(order, Measures.of(F.col(text_col), w))))


def measured(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with the base measures, ``base_failed`` and ``kept``."""
    order = ordered(estimate(df, rules, text_col))
    # the whole row in one column, so that no name of the input's can clash
    words = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).alias("text"), words_of(F.col(text_col)).alias("words"))
    m = Measures.of(F.col("text"), F.col("words"))
    out = words.withColumns({name: getattr(m, name) for name in BASE})
    m = Measures(F.coalesce(F.col("text"), F.lit("")), F.col("words"), *(F.col(name) for name in BASE))
    out = out.withColumn("base_failed", rejected(BASE_RULES, m))
    out = out.withColumn("kept", ~F.col("base_failed") & ~rejected(order, m))
    new = (*BASE, "base_failed", "kept")
    return out.select(*(F.col("row")[c].alias(c) for c in df.columns if c not in new), *new)
