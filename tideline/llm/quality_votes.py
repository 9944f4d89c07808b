"""Document quality by weak supervision.

Each rule votes good or bad on a document or abstains. The rules' accuracies are
not given: expectation-maximisation over the counts of vote patterns estimates,
for each rule and each vote, how often good documents and each kind of bad ones
get it. A document is then judged by its posterior probability of being good, so
that a failed rule that is often wrong does not reject what the others support.

Main path: DataFrame functions only. The vote patterns are at most 3 to the
power of the number of rules, whatever the input; nothing else is gathered.

Defined results: a null text counts as empty (no words, all rules abstain but
for the base test, which it fails). Repeated rows are judged alike. An empty
table gives an empty result. Input columns named like an output column are
replaced; all others are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import keeping_columns
from tideline.session import materialize

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
BAD, ABSTAIN, GOOD = 0, 1, 2
ROUNDS = 30
SMOOTHING = 0.5

#: Rule: (measure, good up to, bad from). Between the two it abstains.
CEILINGS = {
    "symbols": ("symbols_per_word", 0.02, 0.1),
    "shouting": ("upper_share", 0.15, 0.3),
    "repetition": ("repeat_share", 0.25, 0.6),
    "lines": ("dup_line_share", 0.4, 0.7),
    "exclaim": ("exclaims_per_word", 0.1, 0.3),
    "marks": ("mark_share", 0.25, 0.5),
    "sameness": ("same_word_share", 0.75, 0.9),
    "endings": ("open_line_share", 0.4, 0.9),
    "long_words": ("mean_word", 9.0, 12.0),
}
RULES = list(CEILINGS)


def let(value: Column, body) -> Column:
    """Bind a value once, as Spark would otherwise evaluate it at each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def repeated_words(words: Column, n_words: Column) -> Column:
    """Words inside a three-word window that occurs at least twice in the text.

    Windows are compared by a 64-bit hash of their words. Sorting (hash, place)
    puts equal windows side by side; the places of repeated windows, in order,
    then cover up to three words each, less what the next one covers again.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(n_words - 3, F.lit(0))),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
        ),
    )
    ordered = F.sort_array(windows)

    def places(a: Column) -> Column:
        twice = F.filter(
            F.transform(a, lambda x, k: F.when(
                (x["h"] == F.get(a, k - 1)["h"]) | (x["h"] == F.get(a, k + 1)["h"]), x["i"]
            )),
            lambda i: i.isNotNull(),
        )
        return F.sort_array(twice)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    distinct = F.size(F.array_distinct(F.transform(windows, lambda x: x["h"])))
    return F.when((n_words < 4) | (distinct == n_words - 2), F.lit(0)).otherwise(
        let(ordered, lambda a: let(places(a), covered))
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of each document and ``measures``, what the rules look at.

    Counts (long): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    blank = f"[{SPACE}]+"
    split = docs.withColumns({
        "_words": F.array_remove(F.split(raw, blank), ""),
        "_lines": F.filter(F.split(raw, "\n"), lambda x: F.translate(x, SPACE, "") != ""),
    })
    counted = split.withColumn("_n", F.size("_words")).withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(F.translate(raw, SPACE, "")).cast("long"),
        "n_symbols": _count_of(raw, SYMBOLS).cast("long"),
        "_n_lines": F.size("_lines"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words"), F.col("_n")).cast("long"),
        "_upper": _count_of(raw, UPPER),
        "_exclaims": _count_of(raw, "!"),
        "_marks": _count_of(raw, ASCII_MARKS),
        "_n_distinct": F.size(F.array_distinct("_words")),
        "_open": F.size(F.filter(
            "_lines", lambda x: ~F.substring(F.rtrim(x), -1, 1).isin(".", "!", "?", "\"", ":", ";", "…", "。")
        )),
    })
    values = {
        "symbols_per_word": _ratio(F.col("n_symbols"), F.col("n_words")),
        "upper_share": _ratio(F.col("_upper"), F.col("word_chars")),
        "repeat_share": _ratio(F.col("n_repeat_words"), F.col("n_words")),
        "dup_line_share": _ratio(F.col("n_dup_lines"), F.col("_n_lines")),
        "exclaims_per_word": _ratio(F.col("_exclaims"), F.col("n_words")),
        "mark_share": _ratio(F.col("_marks"), F.col("word_chars")),
        "same_word_share": _ratio(F.col("_n") - F.col("_n_distinct"), F.col("n_words")),
        "open_line_share": _ratio(F.col("_open"), F.col("_n_lines")),
        "mean_word": _ratio(F.col("word_chars"), F.col("n_words")),
    }
    out = counted.withColumn("measures", F.struct(*[v.alias(k) for k, v in values.items()]))
    return out.drop("_words", "_lines", "_n", "_n_lines", "_upper", "_exclaims", "_marks", "_n_distinct", "_open")


def votes() -> Column:
    """One vote per rule, in the order of RULES."""
    def vote(name: str) -> Column:
        column, good, bad = CEILINGS[name]
        value = F.col("measures")[column]
        return (
            F.when(F.col("n_words") == 0, ABSTAIN)
            .when(value <= good, GOOD).when(value >= bad, BAD).otherwise(ABSTAIN)
        )
    return F.array(*[vote(r) for r in RULES])


def _log_odds(vote: Column, weights: Column) -> Column:
    """Log probability of the votes under each class, up to a common term."""
    return F.transform(weights, lambda w: F.aggregate(
        F.transform(vote, lambda v, r: F.get(w, 1 + 3 * r + v)), F.get(w, F.lit(0)), lambda s, x: s + x
    ))


def _posterior(vote: Column, weights: Column) -> Column:
    """Probability of each class: the first is good, the others are the kinds of bad."""
    def scaled(odds: Column) -> Column:
        return let(F.array_max(odds), lambda top: F.transform(odds, lambda x: F.exp(x - top)))

    def shares(parts: Column) -> Column:
        return let(
            F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), lambda whole: F.transform(parts, lambda x: x / whole)
        )

    return let(let(_log_odds(vote, weights), scaled), shares)


def fit(measured: DataFrame, rounds: int = ROUNDS) -> list[list[float]]:
    """Estimate, per class, the log prior and the log rate of each rule's three votes.

    Class 0 is good; class k + 1 is the kind of bad that rule k looks for, as a
    document that is bad in one way is mostly faultless in the others. The counts
    of patterns meet in one row, where the rounds run as one expression. They
    start from: good with 0.9 without a bad vote, else with 0.1, the rest shared
    by the kinds whose rules voted bad.
    """
    n_rules = len(RULES)
    # written, so that no measure is worked out again inside the vote expressions
    measured = materialize(measured.select("n_words", "measures"), "measures")
    patterns = measured.groupBy(votes().alias("v")).agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("p"))

    def total(p: Column, weight) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda s, x: s + weight(x))

    def estimate(p: Column) -> Column:
        """Weights from patterns with the mass m of each class."""
        def of_class(c: Column) -> Column:
            def rates(whole: Column) -> Column:
                each = F.transform(F.sequence(F.lit(0), F.lit(3 * n_rules - 1)), lambda k: F.log(
                    (total(p, lambda x: F.when(
                        F.get(x["v"], F.floor(k / 3).cast("int")) == F.pmod(k, F.lit(3)), F.get(x["m"], c)
                    ).otherwise(0.0)) + SMOOTHING) / (whole + 3 * SMOOTHING)
                ))
                return F.concat(F.array(F.log(whole + SMOOTHING)), each)
            return let(total(p, lambda x: F.get(x["m"], c)), rates)
        return F.transform(F.sequence(F.lit(0), F.lit(n_rules)), of_class)

    def shared_out(p: Column, shares) -> Column:
        return F.transform(p, lambda x: F.struct(
            x["v"].alias("v"), x["n"].alias("n"),
            F.transform(shares(x["v"]), lambda q: q * x["n"]).alias("m"),
        ))

    def first_guess(v: Column) -> Column:
        n_bad = F.size(F.filter(v, lambda x: x == BAD))
        kinds = F.transform(v, lambda x: F.when(n_bad == 0, 0.1 / n_rules).when(x == BAD, 0.9 / n_bad).otherwise(0.0))
        return F.concat(F.array(F.when(n_bad == 0, 0.9).otherwise(0.1)), kinds)

    start = one.select("p", let(shared_out(F.col("p"), first_guess), estimate).alias("w"))
    final = start.select(F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), F.col("w"),
        lambda w, _: let(shared_out(F.col("p"), lambda v: _posterior(v, w)), estimate),
    ).alias("w"))
    return [list(w) for w in final.first()["w"]]


def score(measured: DataFrame, weights: Sequence[Sequence[float]]) -> DataFrame:
    """Add base_failed, quality (posterior of good) and kept; drops ``measures``.

    base_failed: under 50 words, or over half of the words in repeated windows.
    """
    model = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumns({
        "base_failed": base,
        "quality": F.get(_posterior(votes(), model), F.lit(0)),
    }).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("measures")


@keeping_columns(
    "_words", "_lines", "_n", "_n_lines", "_upper", "_exclaims", "_marks", "_n_distinct", "_open", "measures"
)
def judge_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """All input rows and columns with counts, base_failed, quality and kept."""
    measured = measure(docs, text)
    return score(measured, fit(measured))
