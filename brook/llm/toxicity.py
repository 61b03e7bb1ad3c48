"""Toxicity scores from a weighted finite-state grammar over clauses.

A text is cut into clauses and the words of a clause become symbols: INSULT (a known word, or a learned stem with any
ending), THREAT (a verb of harm), TARGET (whom it is about), NEGATION, REPORT (somebody else's words) and BREAK (a
preposition, which ends the reach of a target).  Five letter-to-letter transducers read them from left to right, each
what the one before has written, and are composed into one table of states and symbols:

* ``negation``: an insult within reach of a negation is DENIED, a threat is nothing;
* ``report``: an insult after a verb of speech is QUOTED, a threat is nothing;
* ``target``: an insult within reach of an open target is AIMED;
* ``insult``: any other insult is a SLUR, and a target within reach after it AIMS it;
* ``threat``: a target within reach after a threat makes it a MENACE.

The outputs have weights.  A slur says nothing alone: it counts from the second one of a text on, so one word on its
own, whatever stands around it, is never enough; aimed insults and menaces count from the first.

The weights are learned by logistic regression from a bounded sample of labelled rows, with prior weights they are drawn
to; the offset stays.  Insults and stems are learned from the words that toxic rows of the sample have and others
hardly ever, and join the given list.

Defined cases: null and empty texts get the score of a text without matches; ids in the labels that have no
document, null labels and repeated labels do no harm; of rows that share an id one is in the sample; without labels the
priors and the given list are used; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Labelled documents read for training at most.
MAX_LABELLED = 8_000
#: Fixed word lists of the transducers, in four languages.
INSULTS = tuple("idiot idiots moron loser scum stupid worthless pathetic disgusting trash clown imbecile trottel dummkopf abschaum crétin abruti ordure imbécil basura".split())
THREATS = tuple("kill hurt destroy hang shoot burn töten umbringen tuer frapper matar".split())
TARGETS = frozenset("you your yours he she they them him her u ihr du dich euch sie er tu toi vous il elle ils usted tú ellos él ella".split())
NEGATIONS = frozenset("not no never nobody isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca jamás tampoco".split())
REPORTS = frozenset("said says called calls quoted wrote writes according allegedly claimed sagte schrieb laut dit écrit selon dijo escribió según".split())
BREAKS = frozenset("in into at of from with on under behind for im auf aus mit von dans sur avec en sobre con desde".split())
#: Symbols that words become, and those that transducers write.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK, DENIED, QUOTED, AIMED, SLUR, AIMS, MENACE = range(13)
WORDS, SYMBOLS = 7, 13
KINDS = ("slur", "aimed", "denied", "quoted", "threat", "menace")
#: Which outputs each kind counts.
COUNTED = ((SLUR, AIMED), (AIMED, AIMS), (DENIED,), (QUOTED,), (THREAT,), (MENACE,))
#: What a match of each kind is worth before anything is learned, and the offset.
PRIOR = np.array([5.0, 4.0, 0.0, 0.0, 0.3, 4.0])
OFFSET = -3.0
#: Words that a negation, a target, and an insult or threat before its target, reach over.
DENIES, POINTS, WAITS = 3, 5, 2
CLAUSE = re.compile(r"[.!?;:,|\n\"]+")
STRIP = ".,!?;:|\"'()[]#$%&*"


@dataclass(frozen=True)
class Transducer:
    """``after[state, symbol]`` and ``writes[state, symbol]``; state 0 begins each clause."""

    after: np.ndarray
    writes: np.ndarray

    def run(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for x in symbols:
            out.append(int(self.writes[state, x]))
            state = int(self.after[state, x])
        return out


def transducer(states: int, rule: Callable[[int, int], tuple[int, int]]) -> Transducer:
    """From a rule (state, symbol) -> (next state, symbol written)."""
    made = np.array([[rule(q, x) for x in range(SYMBOLS)] for q in range(states)])
    return Transducer(made[:, :, 0], made[:, :, 1])


def composed(first: Transducer, then: Transducer) -> Transducer:
    """Reads like ``first`` and writes what ``then`` writes on its output: states are pairs, those of ``first`` the high part."""
    n = len(then.after)
    q, r, x = np.meshgrid(np.arange(len(first.after)), np.arange(n), np.arange(SYMBOLS), indexing="ij")
    between = first.writes[q, x]
    after, writes = first.after[q, x] * n + then.after[r, between], then.writes[r, between]
    return reached(Transducer(after.reshape(-1, SYMBOLS), writes.reshape(-1, SYMBOLS)))


def reached(t: Transducer) -> Transducer:
    """Without the states that no clause gets to."""
    seen, todo = {0: 0}, [0]
    while todo:
        for q in t.after[todo.pop()].tolist():
            if q not in seen:
                seen[q] = len(seen)
                todo.append(q)
    old = np.array(sorted(seen, key=seen.__getitem__))
    number = np.zeros(len(t.after), dtype=np.int64)
    number[old] = np.arange(len(old))
    return Transducer(number[t.after[old]], t.writes[old])


def negation(reach: int = DENIES) -> Transducer:
    def rule(left: int, x: int) -> tuple[int, int]:
        if x == NEGATION:
            return reach, x
        return max(0, left - 1), {INSULT: DENIED, THREAT: OTHER}.get(x, x) if left else x

    return transducer(reach + 1, rule)


def report() -> Transducer:
    return transducer(2, lambda q, x: (int(q or x == REPORT), {INSULT: QUOTED, THREAT: OTHER}.get(x, x) if q else x))


def target(reach: int = POINTS) -> Transducer:
    def rule(left: int, x: int) -> tuple[int, int]:
        if x == TARGET:
            return reach, x
        if x == BREAK:
            return 0, x
        return max(0, left - 1), AIMED if left and x == INSULT else x

    return transducer(reach + 1, rule)


def insult(reach: int = WAITS) -> Transducer:
    def rule(left: int, x: int) -> tuple[int, int]:
        if x == INSULT:
            return reach, SLUR
        if x == TARGET and left:
            return 0, AIMS
        return (0 if x == BREAK else max(0, left - 1)), x

    return transducer(reach + 1, rule)


def threat(reach: int = WAITS) -> Transducer:
    def rule(left: int, x: int) -> tuple[int, int]:
        if x == THREAT:
            return reach, x
        if x == TARGET and left:
            return 0, MENACE
        return (0 if x == BREAK else max(0, left - 1)), x

    return transducer(reach + 1, rule)


def cascade() -> tuple[Transducer, ...]:
    return negation(), report(), target(), insult(), threat()


def machine() -> Transducer:
    """The five transducers as one."""
    first, *rest = cascade()
    for t in rest:
        first = composed(first, t)
    return first


#: So many words without a meaning bring every state to rest; longer runs of them change nothing.
REST = max(DENIES, POINTS, WAITS) + 1


@dataclass(frozen=True)
class Grammar:
    insults: tuple[str, ...] = INSULTS
    stems: tuple[str, ...] = ()
    threats: tuple[str, ...] = THREATS
    weights: tuple[float, ...] = tuple(PRIOR)


class Reader:
    """Counts the kinds of match in texts."""

    def __init__(self, grammar: Grammar):
        import ahocorasick

        self.table, self.stems = machine(), grammar.stems
        self.codes = {
            **dict.fromkeys(BREAKS, BREAK), **dict.fromkeys(REPORTS, REPORT), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(TARGETS, TARGET),
            **dict.fromkeys(grammar.threats, THREAT), **dict.fromkeys(grammar.insults, INSULT),
        }
        self.automaton = ahocorasick.Automaton()
        for w in (*grammar.insults, *grammar.threats):
            self.automaton.add_word(w, (len(w), False))
        for w in grammar.stems:
            self.automaton.add_word(w, (len(w), True))
        self.automaton.make_automaton()

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses that hold an insult, a stem or a threat."""
        low = text.lower()
        spots = []
        for end, (n, stem) in self.automaton.iter(low):
            start = end - n + 1
            if (start == 0 or not low[start - 1].isalnum()) and (stem or end + 1 == len(low) or not low[end + 1].isalnum()):
                spots.append(start)
        if not spots:
            return
        spots.sort()
        edges = [m.span() for m in CLAUSE.finditer(low)]
        begins, ends = [0, *(b for _, b in edges)], [*(a for a, _ in edges), len(low)]
        k, at = 0, -1
        for s in spots:
            while k < len(ends) - 1 and ends[k] <= s:
                k += 1
            if k != at:
                at = k
                yield low[begins[k] : ends[k]]

    def symbols(self, clause: str) -> list[int]:
        out, quiet = [], 0
        for w in clause.split():
            w = w.strip(STRIP)
            if not w:
                continue
            x = self.codes.get(w, OTHER)
            if x == OTHER and self.stems and w.startswith(self.stems):
                x = INSULT
            quiet = quiet + 1 if x == OTHER else 0
            if quiet <= REST:
                out.append(x)
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many matches of each kind each text has: the composed table goes through all clauses at once."""
        found, of = [], []
        for k, text in enumerate(texts):
            for clause in self.clauses(text):
                found.append(self.symbols(clause))
                of.append(k)
        written = np.zeros((len(texts), SYMBOLS), dtype=np.int64)
        if found:
            order = sorted(range(len(found)), key=lambda k: -len(found[k]))
            length = np.array([len(found[k]) for k in order])
            flat = np.array([x for k in order for x in found[k]], dtype=np.int64)
            start, doc, state = np.concatenate([[0], np.cumsum(length)])[:-1], np.array(of)[order], np.zeros(len(order), dtype=np.int64)
            for step in range(int(length[0])):
                live = int(np.searchsorted(-length, -step))  # the longest come first
                x = flat[start[:live] + step]
                np.add.at(written, (doc[:live], self.table.writes[state[:live], x]), 1)
                state[:live] = self.table.after[state[:live], x]
        return np.stack([written[:, list(own)].sum(axis=1) for own in COUNTED], axis=1)


def evidence(counts: np.ndarray) -> np.ndarray:
    """What the weights act on: slurs from the second on, all else from the first, both in logarithms."""
    out = np.log1p(counts.astype(np.float64))
    out[:, 0] = np.log(np.maximum(counts[:, 0], 1))
    return out


def probability(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(evidence(counts) @ weights + OFFSET, -30, 30)))


def held_out(id_col: str = "doc_id", of: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of == part


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            for w in {w.strip(STRIP) for w in text.lower().split()}:
                seen.setdefault(w, [0, 0])[toxic] += 1
    words = list(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array([seen[w][0] for w in words], pa.int64()), pa.array([seen[w][1] for w in words], pa.int64())],
        names=["word", "clean", "toxic"],
    )


def _unexplained(grammar: Grammar):
    """The rows that are not toxic, and the toxic ones in which the grammar finds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(grammar)
        for batch in batches:
            texts, toxic = (c.to_pylist() for c in batch.columns)
            some = reader.counts(texts).any(axis=1)
            yield batch.filter(pa.array(~(some & np.array(toxic, dtype=bool)), pa.bool_()))

    return run


def marked_words(rows: list[tuple[str, int, int]], stems: tuple[str, ...], least: int = 3, purity: float = 0.02) -> tuple[str, ...]:
    """Words that the toxic rows of the sample have and the others hardly ever; ``rows``: word, clean and toxic documents."""
    return tuple(sorted(w for w, c, t in rows if len(w) >= 3 and t >= least and c <= purity * t and not w.startswith(stems)))


#: Letters of a stem.
STEM = range(4, 9)


def possible_stems(rows: list[tuple[str, int, int]], least: int = 3, purity: float = 0.25) -> tuple[str, ...]:
    """Beginnings of several words that are mostly in toxic rows."""
    words, toxic, clean = Counter(), Counter(), Counter()
    for w, c, t in rows:
        for n in STEM:
            if n < len(w):
                words[w[:n]] += 1
                toxic[w[:n]] += t
                clean[w[:n]] += c
    return tuple(sorted(s for s in words if words[s] >= 6 and toxic[s] >= 6 * least and clean[s] <= purity * toxic[s]))


def _repeated(stems: tuple[str, ...]):
    """For each stem, the clean and toxic rows that have two words with it or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {s: [0, 0] for s in stems}
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                own = Counter(s for w in text.lower().split() for w in [w.strip(STRIP)] for s in {w[:n] for n in STEM if n < len(w)} if s in seen)
                for s, n in own.items():
                    seen[s][toxic] += n >= 2
        columns = [pa.array(list(seen), pa.string()), *[pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1)]]
        yield pa.RecordBatch.from_arrays(columns, names=["stem", "clean", "toxic"])

    return run


def good_stems(rows: list[tuple[str, int, int]], least: int = 3, purity: float = 0.15) -> tuple[str, ...]:
    """Stems that hardly any but toxic rows repeat (a slur counts from the second on); the shortest of a family."""
    out: list[str] = []
    for s, c, t in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        if t >= least and c <= purity * t and not s.startswith(tuple(out)):
            out.append(s)
    return tuple(out)


def fit(counts: np.ndarray, labels: np.ndarray, pull: float = 2.0, rounds: int = 60) -> np.ndarray:
    """Logistic regression with a fixed offset, drawn to the prior weights, by Newton's method."""
    x, w = evidence(counts), PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + OFFSET, -30, 30)))
        gradient = x.T @ (labels - p) - pull * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _counts(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weights = Reader(grammar), np.array(grammar.weights)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                found = reader.counts(some.column(some.num_columns - 1).to_pylist())
                kinds = [pa.array(found[:, j], pa.int64()) for j in range(len(KINDS))]
                score = pa.array(probability(found, weights), pa.float64())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *kinds, score], names=[*some.schema.names[:-1], *KINDS, "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Grammar:
    """A grammar from at most ``max_labelled`` labelled documents, chosen by a hash of their id."""
    spark = docs.sparkSession
    picked = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
        .collect()
    )
    if not picked:
        return Grammar()
    known = F.broadcast(spark.createDataFrame(picked, "id long, toxic int"))  # max_labelled rows of two numbers
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(known, "id")
    # one row for each id, so that the sample has max_labelled rows at most
    sample = stored(spark, rows.groupBy("id", "toxic").agg(F.min("text").alias("text"))).select("text", "toxic")

    def tally(some: DataFrame, f: Callable, name: str) -> list[tuple]:
        seen = some.mapInArrow(f, f"{name} string, clean long, toxic long")
        return [tuple(r) for r in seen.groupBy(name).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("toxic >= 2").collect()]

    tried = possible_stems(tally(sample, _vocabulary, "word"))
    stems = good_stems(tally(sample, _repeated(tried), "stem"))
    # single words only from what the list and the stems leave open: others just stand beside an insult in some copies
    open_rows = sample.mapInArrow(_unexplained(Grammar(INSULTS, stems)), "text string, toxic int")
    words = marked_words(tally(open_rows, _vocabulary, "word"), stems)
    grammar = Grammar(tuple(dict.fromkeys(INSULTS + words)), stems)
    schema = "toxic int, " + ", ".join(f"{k} long" for k in KINDS) + ", score double"
    rows = sample.select("toxic", "text").mapInArrow(_counts(grammar), schema).toArrow()
    counts = np.stack([rows[k].to_numpy() for k in KINDS], axis=1)
    return Grammar(grammar.insults, grammar.stems, weights=tuple(fit(counts, rows["toxic"].to_numpy().astype(float)).tolist()))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, and the number of matches of each kind."""
    grammar = learn(docs, labels, id_col, text_col, **options)
    schema = "id long, held boolean, " + ", ".join(f"{k} long" for k in KINDS) + ", score double"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_counts(grammar), schema).select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *KINDS
    )
