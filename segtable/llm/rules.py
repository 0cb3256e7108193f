"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0) on a document.  The documents are counted
by their votes (at most 3 to the number of rules, whatever their number), and
expectation-maximisation on these counts estimates each rule's accuracy on good and on bad
documents and the share of good ones.  A document's posterior probability of being good then
decides, so one rule that misfires doesn't drop a document.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import few, written

BLANK = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
#: Bounds of an accuracy on good documents, and the accuracies on good and bad ones to start from.
LOW, HIGH, START = 0.55, 0.995, (0.95, 0.5)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; ``hashes`` by window start."""

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), of_starts)

    def of_starts(at: Column) -> Column:
        gaps = F.transform(at, lambda v, k: F.coalesce(F.least(F.lit(WINDOW), v - F.get(at, k - 1)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)).otherwise(0)


def features(docs: DataFrame) -> DataFrame:
    """The counts that the rules look at, of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = " \t\n\x0b\f\r"

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.when(F.size(w) > WINDOW, let(hashes, _covered)).otherwise(0).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.filter(F.split(text, BLANK), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, blank, "")) > 0)
    got = docs.select(
        F.col("doc_id").cast("long"),
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(F.translate(text, blank, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "|", ""))).cast("long").alias("n_bars"),
        F.length(F.regexp_replace(text, "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
    )
    return got.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_bars", "n_letters")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def votes() -> dict[str, Column]:
    """The rules.  Shares are of words or of lines with a word."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "v_length": _vote((F.col("n_words") >= 40) & (F.col("n_words") <= 100_000), F.col("n_words") < 20),
        "v_word_size": _vote(F.col("word_chars").between(3 * n, 9 * n), (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)),
        "v_symbols": _vote(F.col("n_symbols") <= 0.05 * n, F.col("n_symbols") > 0.15 * n),
        "v_bars": _vote(F.col("n_bars") <= 0.02 * n, F.col("n_bars") > 0.15 * n),
        "v_lines": _vote((F.col("n_dup_lines") <= 0.1 * lines) & (lines > 1), F.col("n_dup_lines") > 0.3 * lines),
        "v_repeats": _vote((F.col("n_repeat_words") <= 0.1 * n) & (n >= 16), F.col("n_repeat_words") > 0.3 * n),
        "v_letters": _vote(F.col("n_letters") >= 0.85 * chars, F.col("n_letters") < 0.7 * chars),
    }


@dataclass(frozen=True)
class Model:
    """Share of good documents; per rule the accuracy of its votes on good and on bad ones."""

    good: float
    accuracy: dict[str, tuple[float, float]]

    def score(self) -> Column:
        """Posterior probability of being good, from the vote columns."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for rule, (p, q) in self.accuracy.items():
            odds = odds + F.when(F.col(rule) == 1, math.log(p / (1 - q))).when(F.col(rule) == -1, math.log((1 - p) / q)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimate(counts: list[tuple[tuple[int, ...], int]], rules: list[str], rounds: int = 300) -> Model:
    """Expectation-maximisation over counted vote patterns.

    A vote of good is right on good documents, of bad on bad ones.  Documents are bad for
    different reasons, so most rules vote good on many bad documents: accuracy on bad ones may
    be low, but a vote never counts against its own side (the two accuracies sum to more than
    1).  One weak pseudo-count for each keeps a rule that never votes at its start.
    """
    good, acc = 0.8, [START] * len(rules)
    for _ in range(rounds):
        total = mass = 0.0
        sums = [[0.0] * 4 for _ in rules]
        for pattern, n in counts:
            odds = math.log(good / (1 - good))
            for v, (p, q) in zip(pattern, acc, strict=True):
                odds += math.log(p / (1 - q)) if v == 1 else math.log((1 - p) / q) if v == -1 else 0.0
            w = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            total += n
            mass += n * w
            for s, v in zip(sums, pattern, strict=True):
                if v:
                    s[0] += n * w * (v == 1)
                    s[1] += n * w
                    s[2] += n * (1 - w) * (v == -1)
                    s[3] += n * (1 - w)
        new = []
        for a, b, c, d in sums:
            p = min(HIGH, max(LOW, (a + START[0]) / (b + 1)))
            new.append((p, min(HIGH, max(1.02 - p, 0.05, (c + START[1]) / (d + 1)))))
        share = min(0.95, max(0.05, (mass + 0.8) / (total + 1)))
        moved = abs(share - good) + sum(abs(a - c) + abs(b - d) for (a, b), (c, d) in zip(acc, new, strict=True))
        good, acc = share, new
        if moved < 1e-9:
            break
    return Model(good, dict(zip(rules, acc, strict=True)))


def judge_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Features, votes and verdict of each document.

    ``base_failed``: fewer than 20 words, or over 30 per cent of the words in eight-word
    windows that occur twice or more in the text.  ``kept``: not base_failed and a posterior
    ``quality`` of ``threshold`` or more.  Repeated windows are told by a 64-bit hash within
    one text.

    A null or empty text has no words and fails.  Rows are judged one by one, repeated rows
    alike; a null doc_id stays null; other columns, whatever their names, are not looked at.
    The votes of all documents enter the estimate; for an empty table the result is empty.
    """
    rules = votes()
    seen = written(features(few(docs, docs))).select("*", *(v.alias(k) for k, v in rules.items()))
    counted = seen.groupBy(*rules).count().collect()  # at most 3**len(rules) rows
    counts = sorted((tuple(r[k] for k in rules), r["count"]) for r in counted)
    model = estimate(counts, list(rules))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return seen.withColumn("base_failed", failed).withColumn("quality", model.score()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
