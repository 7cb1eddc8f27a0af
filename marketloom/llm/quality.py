"""Quality rules: one table of thresholds, compiled into one Spark projection.

No user functions run. Arrays that a higher-order function reads more than once are bound as its
lambda's argument (`let`), so that they are made once for a text and not once for an element.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS

#: The most common short function words of the corpus languages.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "for", "this", "by", "was", "on", "as",
    "le", "la", "les", "de", "des", "et", "est", "un", "une", "dans", "que", "qui", "pour", "du",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "von", "den", "mit", "auf", "im",
    "el", "los", "las", "en", "una", "con", "por", "del", "para", "se", "no", "es",
)
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose measure, a Spark expression over the counts, is below low or above high."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Lenient on what clean prose in the corpus languages may look like, strict on what is clearly not prose. Of prose, a
#: sixth or more are stop words; one is granted to each text, as a short one may miss them by chance.
RULES = (
    Rule("words", "n_words", 20, None),
    Rule("words in repeated windows", "100 * n_repeat_words / n_words", None, 30),
    Rule("mean word length", "word_chars / n_words", 1.5, 40),
    Rule("symbols a word", "n_symbols / n_words", None, 0.5),
    Rule("lines that repeat", "n_dup_lines / n_lines", None, 0.5),
    Rule("stop words", "(n_stop + 1) / n_words", 0.05, None),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, n: Column) -> Column:
    """Words in 8-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes, made of those of their halves, down to single words. Those met twice come from the
    sorted (hash, place) pairs; a window adds what it covers beyond the one before it.
    """

    def spread(pairs: Column) -> Column:
        twin = lambda p, i: (p.h == F.get(pairs, i + 1).h) | ((i > 0) & (p.h == F.get(pairs, i - 1).h))
        at = F.array_sort(F.transform(F.filter(pairs, lambda p, i: F.coalesce(twin(p, i), F.lit(False))), lambda p: p.at))
        return let(at, lambda a: F.aggregate(F.transform(a, lambda x, i: F.least(F.coalesce(F.get(a, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x))

    def doubled(runs: Column, reach: int) -> Column:
        return let(runs, lambda r: F.zip_with(F.slice(r, 1, F.size(r) - reach), F.slice(r, 1 + reach, F.size(r) - reach), lambda x, y: F.xxhash64(x, y)))

    windows = doubled(doubled(doubled(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), spread)))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(found)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns beside the counts of its text (null: no words), named as in the rules."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = df.select("*", words.alias("__words"), lines.alias("__lines"), whole.alias("__text"))
    n = F.size("__words")
    return first.select(
        *(F.col(c) for c in df.columns),
        n.cast("long").alias("n_words"),
        F.aggregate("__words", F.lit(0), lambda s, w: s + F.length(w)).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words"), n).cast("long").alias("n_repeat_words"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule rejects. A measure that divides by zero, as for a text without words, rejects nothing."""
    out = F.lit(True)
    for rule in rules:
        value = F.expr(rule.measure.replace("/ n_words", "/ NULLIF(n_words, 0)").replace("/ n_lines", "/ NULLIF(n_lines, 0)"))
        for bad in ([value < rule.low] if rule.low is not None else []) + ([value > rule.high] if rule.high is not None else []):
            out = out & ~F.coalesce(bad, F.lit(False))
    return out


def quality(df: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, counts, base_failed, kept) a row of df.

    Null and empty texts have no words and fail. Repeated rows and null ids are judged like any
    other; other columns are not read, so their names cannot clash.
    """
    counts = measure(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    base = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return counts.withColumn("base_failed", base).withColumn("kept", ~base & verdict(rules))


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that are kept, with their columns as they are, in one projection and a filter."""
    names = docs.columns
    counts = measure(docs.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(names)), F.col(text).alias("text")))
    kept = counts.where(~F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words") & verdict(rules))
    return kept.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(names)))
