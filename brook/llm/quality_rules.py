"""Quality rules: text statistics as SQL expressions and a learned decision list over them.

``features`` computes the statistics of a text with built-in functions only.  ``learn`` reads the statistics
of a bounded sample of labelled documents and builds a decision list by sequential covering: a rule is a
conjunction of thresholds, grown on two thirds of the rows by FOIL gain and pruned on the other third by
precision; rows it covers are set aside and the next rule is grown.  A rule that is not precise enough is not kept; the
rows it was grown for are set aside too, so that others still find theirs.  ``verdict`` turns the list into one ordered conditional expression.  Only the small sample (``max_labelled``
rows of numbers) reaches the driver; all documents are judged inside Spark.

Rules name what goes among the documents that pass the base rule; one that no rule covers is kept.  Defined cases: a
null or empty text has no words and fails the base rule; ids in the labels that have no document, repeated labels and
null labels are ignored; of rows that share an id one is in the sample; with no labels the list is empty and the base
rule alone decides; other columns pass through, whatever their names (the added ones named here are replaced).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, fresh, let, text_of, words

#: Rows of the labelled sample; with six numbers a row this is about one MB on the driver.
MAX_LABELLED = 8_000
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test; each is a ratio, so that a threshold means the same for short and long texts.
RATIOS = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "n_words")


def _window_hashes(w: Column) -> Column:
    return let(
        w, lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - WINDOW + 1), lambda i: F.xxhash64(*[F.element_at(v, i + k) for k in range(WINDOW)]))
    )


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur at least twice: sort the windows by hash, take equal neighbours, add up the gaps."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(p: Column) -> Column:
        same = lambda k: F.get(p, k)["h"]
        return F.transform(p, lambda x, k: F.when((same(k - 1) == x["h"]) | (same(k + 1) == x["h"]), x["i"]))

    starts = F.sort_array(F.filter(let(placed, again), lambda i: i.isNotNull()))
    gaps = let(starts, lambda s: F.transform(s, lambda p, k: F.least(F.coalesce(F.get(s, k + 1), p + WINDOW) - p, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _repeat_words(w: Column) -> Column:
    def count(h: Column) -> Column:
        return F.when(F.size(h) > F.size(F.array_distinct(h)), _covered(h)).otherwise(F.lit(0))

    return F.when(F.size(w) > WINDOW, let(_window_hashes(w), count)).otherwise(F.lit(0))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics added as columns that start with two underscores."""
    t = text_of(text_col)
    w, lines, distinct = fresh(docs, "__w", "__lines", "__distinct")
    out = docs.withColumns({w: words(t), lines: F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(WS))) > 0)})
    out = out.withColumns({"__n_words": F.size(w).cast("long"), "__n_repeat_words": _repeat_words(F.col(w)).cast("long"), distinct: F.size(F.array_distinct(w))})
    out = out.withColumns(
        {
            "__word_chars": F.length(F.array_join(w, "")).cast("long"),
            "__n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "__n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    )
    words_, chars = F.greatest(F.col("__n_words"), F.lit(1)), F.greatest(F.col("__word_chars"), F.lit(1))
    return out.withColumns(
        {
            "__mean_word": F.col("__word_chars") / words_,
            "__symbol_rate": F.col("__n_symbols") / chars,
            "__dup_line_rate": F.col("__n_dup_lines") / F.greatest(F.size(lines), F.lit(1)),
            "__repeat_rate": F.col("__n_repeat_words") / words_,
            "__distinct_rate": F.col(distinct) / words_,
        }
    ).drop(w, lines, distinct)


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` (name, '>' or '<=', threshold) hold: the document goes."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def covers(self, row: dict) -> bool:
        return all(row[n] > v if op == ">" else row[n] <= v for n, op, v in self.tests)

    def column(self, prefix: str = "__") -> Column:
        out = F.lit(True)
        for n, op, v in self.tests:
            c = F.col(prefix + n)
            out = out & ((c > F.lit(v)) if op == ">" else (c <= F.lit(v)))
        return out


def _thresholds(rows: list[dict], name: str, steps: int = 48) -> list[float]:
    """Half way between neighbouring values: all of them if there are few, else at equal ranks and near both ends."""
    values = sorted({float(r[name]) for r in rows})
    last = len(values) - 2
    at = range(last + 1) if last < steps else {last * k // steps for k in range(steps + 1)} | {len(values) // 200, last - len(values) // 200}
    return sorted((values[k] + values[k + 1]) / 2 for k in at)


def _grow(bad: list[dict], good: list[dict], names: Sequence[str], most: int) -> tuple:
    tests: tuple = ()
    while len(tests) < most and good:
        best, p0, n0 = None, len(bad), len(good)
        for name in names:
            low_p, low_n = sorted(r[name] for r in bad), sorted(r[name] for r in good)
            for v in _thresholds(bad + good, name):
                for op in (">", "<="):
                    p, n = bisect_right(low_p, v), bisect_right(low_n, v)
                    if op == ">":
                        p, n = p0 - p, n0 - n
                    if not p:
                        continue
                    gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                    if best is None or gain > best[0]:
                        best = (gain, name, op, v)
        if best is None or best[0] <= 0:
            break
        _, name, op, v = best
        tests += ((name, op, v),)
        bad = [r for r in bad if (r[name] > v) == (op == ">")]
        good = [r for r in good if (r[name] > v) == (op == ">")]
    return tests


def decision_list(
    rows: list[dict], names: Sequence[str] = RATIOS, target: str = "bad", precision: float = 0.98, least: int = 3, most_tests: int = 3, most_rules: int = 12
) -> list[Rule]:
    """Sequential covering over plain rows of numbers."""
    rules: list[Rule] = []
    rest = list(rows)
    tried = 0
    while len(rules) < most_rules and tried < 4 * most_rules:
        tried += 1
        open_ = [r for r in rest if not r.get("aside")]
        grow, prune = [r for i, r in enumerate(open_) if i % 3], [r for i, r in enumerate(open_) if i % 3 == 0]
        bad, good = [r for r in grow if r[target]], [r for r in grow if not r[target]]
        if len(bad) < least:
            break
        tests = _grow(bad, good, names, most_tests)

        def worth(ts: tuple) -> tuple[float, int]:
            hit = [r for r in prune if Rule(ts, 0, 0).covers(r)]
            return (sum(bool(r[target]) for r in hit) + 1) / (len(hit) + 2), len(hit)

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        if not tests:
            break

        def precise(hit: list[dict]) -> bool:
            right = sum(bool(r[target]) for r in hit)
            return right >= least and right >= precision * len(hit)

        hit = [r for r in rest if Rule(tests, 0, 0).covers(r)]
        if not precise(hit):  # once more, with the rows that growing did not see
            tests += _grow([r for r in hit if r[target]], [r for r in hit if not r[target]], names, most_tests - len(tests))
            hit = [r for r in rest if Rule(tests, 0, 0).covers(r)]
        if precise(hit):
            right = sum(bool(r[target]) for r in hit)
            rules.append(Rule(tests, right / len(hit), len(hit)))
            rest = [r for r in rest if not rules[-1].covers(r)]
        else:
            # not precise enough: what it was grown for no longer steers the next ones
            seeds = {id(r) for r in hit if r[target] and not r.get("aside")}
            if not seeds:
                break
            rest = [{**r, "aside": True} if id(r) in seeds else r for r in rest]
    return rules


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
    precision: float = 0.98,
) -> list[Rule]:
    """Rules from at most ``max_labelled`` labelled documents, chosen by a hash of their id."""
    picked = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("__id"))
        .agg(F.max(F.col(label_col)).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_labelled)
    )
    picked = labels.sparkSession.createDataFrame(picked.collect(), picked.schema)  # max_labelled rows of two numbers
    known = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")
    seen = features(known, "__id", "__text").select(
        "__id", base_failed().alias("failed"), (F.col("__label") == 0).alias("bad"), *[F.col("__" + n).cast("double").alias(n) for n in RATIOS], F.hash("__text").alias("h")
    )
    # one row for each id, so that max_labelled rows are collected at most
    one = seen.groupBy("__id").agg(F.min(F.struct("h", "failed", "bad", *RATIOS)).alias("r")).select("__id", "r.*")
    # what fails the base rule goes here: as a filter it would be moved below the join, where all texts are
    found = sorted((r.asDict() for r in one.collect() if not r["failed"]), key=lambda r: (r["__id"] * 2654435761 % 4294967296, r["h"]))
    return decision_list(found, precision=precision)


def base_failed(prefix: str = "__") -> Column:
    return (F.col(prefix + "n_words") < 10) | (100 * F.col(prefix + "n_repeat_words") > 20 * F.col(prefix + "n_words"))


def verdict(rules: Sequence[Rule], prefix: str = "__") -> Column:
    """Ordered conditional expression: the number of the first rule that covers a document, or null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        out = F.when(rules[k].column(prefix), F.lit(k)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with __n_words ... __base_failed, __rule (int or null) and __kept added."""
    rules = learn(docs, labels, id_col, text_col, **options)
    out = features(docs, id_col, text_col)
    out = out.withColumns({"__base_failed": base_failed(), "__rule": verdict(rules)})
    return out.withColumn("__kept", ~F.col("__base_failed") & F.col("__rule").isNull())
