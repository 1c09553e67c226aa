"""Quality rules: text statistics, and a decision list learned from them by sequential covering.

All statistics are built-in expressions on one row at a time, so the corpus is neither shuffled nor handed to Python.
The list is grown from labelled statistics on the driver (a bounded sample) and comes back as an ordered conditional
expression: the first rule that covers a document rejects it.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchglass.llm.common import sample_of, table

SPACE = r"\x20\x09-\x0D"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Labelled documents of each class that the list is learned from, at most.
PER_CLASS = 4000
#: Least precision of a rule, documents it must cover, conditions in it (the shape of a rule, not a cut of the data).
PRECISION, COVERED, CONDITIONS = 0.95, 10, 3

Condition = tuple[str, str, float]
OPERATORS = {">=": operator.ge, "<": operator.lt}


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text, the first occurrence included."""

    def covered(at: Column) -> Column:
        # Sorted starts: each window adds the words up to the next start, five at most; the last adds five.
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def starts(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]))
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def count(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(bound(bound(pairs, starts), covered))

    def windows(hashes: Column) -> Column:
        first = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(first, lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(bound(bound(hashes, windows), count))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals of each whole text.

    Words are what lies between ASCII white space; a null text has none and all its counts are 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    counted = docs.select(
        F.col("doc_id"),
        bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))).alias("w"),
        without(f"[{SPACE}]+").cast("long").alias("word_chars"),
        (F.length(text) - without("[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        (F.length(text) - without("[A-Z]+")).cast("long").alias("n_capitals"),
    )
    return counted.select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.repeated").alias("n_repeat_words"),
        F.col("l.n").alias("n_lines"),
        "n_capitals",
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def features() -> dict[str, Column]:
    """What conditions compare: shares that don't depend on a text's length, 0 where there is nothing to share."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "line_words": share("n_words", "n_lines"),
    }


Row = tuple[dict[str, float], bool]


def _covers(rule: Sequence[Condition], values: dict[str, float]) -> bool:
    return all(OPERATORS[op](values[name], threshold) for name, op, threshold in rule)


def _counts(rule: Sequence[Condition], rows: Sequence[Row]) -> tuple[int, int]:
    hit = [target for values, target in rows if _covers(rule, values)]
    return sum(hit), len(hit) - sum(hit)


def _grown(rows: Sequence[Row]) -> list[Condition]:
    """Adds the condition with the largest information gain while it covers any of the other class."""
    from math import log2

    rule: list[Condition] = []
    while rows and len(rule) < CONDITIONS:
        p, n = sum(t for _, t in rows), sum(not t for _, t in rows)
        if not p or not n:
            break
        best: tuple[float, Condition] | None = None
        for name in sorted(rows[0][0]):
            ordered = sorted((values[name], target) for values, target in rows)
            below = [0, 0]
            for k in range(1, len(ordered)):
                below[ordered[k - 1][1]] += 1
                # ties belong to one side
                if ordered[k - 1][0] == ordered[k][0]:
                    continue
                cut = (ordered[k - 1][0] + ordered[k][0]) / 2
                for op, p1, n1 in (("<", below[1], below[0]), (">=", p - below[1], n - below[0])):
                    if p1:
                        gain = p1 * (log2(p1 / (p1 + n1)) - log2(p / (p + n)))
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, (name, op, cut)
        if best is None or best[0] <= 0:
            break
        rule.append(best[1])
        rows = [r for r in rows if _covers([best[1]], r[0])]
    return rule


def learn(rows: Sequence[Row]) -> list[list[Condition]]:
    """An ordered list of conjunctions that cover the target class (True), each grown, then pruned on other rows.

    Two thirds of the rows grow a rule, the rest decide how many of its conditions stay. Rules are added until one
    is not precise on all rows left or covers too few; the rows it covers are then set aside.
    """
    left, rules = list(rows), []
    while True:
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        rule = _grown(grow)
        if not rule:
            break
        worth = []
        for keep in range(1, len(rule) + 1):
            p, n = _counts(rule[:keep], prune)
            worth.append(((p - n) / max(1, p + n), keep))
        rule = rule[: max(worth, key=lambda x: (x[0], -x[1]))[1]]
        p, n = _counts(rule, left)
        if p < COVERED or p / (p + n) < PRECISION:
            break
        rules.append(rule)
        left = [r for r in left if not _covers(rule, r[0])]
    return rules


def verdict(rules: Sequence[Sequence[Condition]]) -> Column:
    """The decision list as an ordered conditional expression: False at the first rule that holds, True at the end."""
    known, out = features(), None
    for rule in rules:
        holds = F.lit(True)
        for name, op, threshold in rule:
            holds = holds & OPERATORS[op](known[name], F.lit(threshold))
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[list[Condition]]:
    """Learns the list that tells quality 0, from at most ``per_class`` labelled documents of each class.

    Labels of the held-out fold, and rows with a null id, text or label, take no part. Without both classes there are
    no rules and every document passes.
    """
    # The sample is a table before anything is measured, so that only its texts are.
    picked = sample_of(docs, labels, "quality", per_class)
    measured = statistics(picked.select(F.struct("_id", "_label").alias("doc_id"), F.col("_text").alias("text"))).filter(~base_failed())
    names = features()
    rows = measured.select("doc_id", *[c.alias(n) for n, c in names.items()]).collect()  # as many rows
    rows.sort(key=lambda r: tuple(r[0]) + tuple(r[1:]))
    return learn([({n: r[n] for n in names}, r["doc_id"]["_label"] == 0) for r in rows])


def apply_rules(docs: DataFrame, rules: Sequence[Sequence[Condition]]) -> DataFrame:
    """Statistics of each document, base_failed, and kept: false if base_failed, else what the list says.

    A null, empty or blank text has no words and fails the base rules. A null doc_id stays null; repeated rows each
    give a row; an empty table gives none. Other columns of ``docs`` are not read.
    """
    judged = statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
