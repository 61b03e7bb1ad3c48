"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

* Word counts.  Every word met ``least`` times in the training documents is a class of its own with vectors of its
  own, however many such words there are; all others fall into classes by form (ending, non-ASCII letters, length).
  Unless it is given, ``least`` grows with the square root of the number of tokens, and so does the number of classes:
  each has more and more to learn from, and the model stays small beside the corpus.
  Up to ``known_words`` counts travel to every worker beside those; rarer words are looked up by a join with the
  whole count table, so no word's count is given up.
* Training.  The model predicts the class of a token from the classes of the two before it: q = sum_j c_j * r(w_j)
  (the log-bilinear form), score = q . r(w) + b(w).  Every training token is told from noise drawn by class frequency
  once in each round.  A task goes through its own documents from the common model; the tasks' vectors are then
  averaged, each weighted by how often the task has used it.

The classes stand on two levels: those of largest bias alone, the others in groups of about the square root of their number,
halved from each other by where their vectors spread most.  A group has a vector (the mean of its classes') and a bias (the log of
the sum of exp(b)) as a class has, and P(class | context) is the softmax over all that stands on the upper level, times that over
the whole group for a class in one.  Both are summed in full, so the chances of all classes add up to 1, at a cost that grows with
the root of the classes.  A model of a few classes (``ALONE``) has the upper level only.
P(token) = P(class | context) * P(token | class),
where a form class gives a word (c + 1) / (N_class + V_class + 1), c being its count, and an unseen word 1 over that.
The vectors depend on how the documents are dealt to tasks, the counts and base scores do not.

Defined cases: a null or empty text is the end token alone; a null id is in the training part; with no training
tokens all classes are equally likely; rows that share an id are scored each for itself; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import log10, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Counts of words without vectors sent to all workers at most (about 60 bytes each there).
KNOWN_WORDS = 1 << 18
FORMS = 32
#: Classes of the closed table that ``train`` and ``log_table`` work on.
OWN = 62
END, START = OWN + FORMS, OWN + FORMS + 1
CLASSES = OWN + FORMS + 2
DIMENSIONS = 16
#: Training tokens that give a word vectors of its own: three for each number it has to learn, and so many of the square
#: root of all tokens.
LEAST, LEAST_OF_ROOT = 3 * (2 * DIMENSIONS + 1) + 1, 1 / 40
#: Tokens of one step and noise words they share (products this small stay in one thread).
STEP, NOISE = 512, 20
#: Classes that stand alone on the upper level, and how many others stay together at least where they are more.
ALONE, GROUP = 128, 128
#: Contexts and classes that are summed at once, and texts that are scored at once (grouped tokens make larger products).
CONTEXTS, SUMMED, SCORED_TEXTS = 1024, 256, 512
#: Words whose vectors travel in one row.
BLOCK = 16
WIDTH = 2 * DIMENSIONS + 1
MOVES = "block int, moves binary, weights binary"
COUNTS = "word binary, form int, c long"
SCORED = "rid long, id long, held boolean, n_tokens long, n_known long, base double, model double, rare array<binary>, times array<int>"


def held_out(id_col: str = "doc_id", of: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of == part


def form(word: bytes) -> int:
    """Form of a word, from 0: ending (comma, stop, other sign, letter) x non-ASCII x length."""
    last = word[-1]
    ending = 1 if last == 44 else 2 if last in b".!?" else 3 if last < 48 else 0
    return ending * 8 + (0 if word.isascii() else 4) + min(3, len(word) // 4)


#: The kind of ending of a word, by its last byte.
ENDING = np.array([form(bytes([b])) // 8 for b in range(256)])


def forms(words: list[bytes]) -> np.ndarray:
    """``form`` of many words (none of them empty) at once."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    size, data = np.fromiter(map(len, words), dtype=np.int64, count=len(words)), np.frombuffer(b"".join(words), dtype=np.uint8)
    end = np.cumsum(size)
    return ENDING[data[end - 1]] * 8 + 4 * (np.maximum.reduceat(data, end - size) > 127) + np.minimum(3, size // 4)


def _texts(batches: Iterator[pa.RecordBatch], step: int = 128, size: int = 1 << 20) -> Iterator[tuple[list, ...]]:
    """The other columns and the words of some rows: ``step`` of them at most, or about ``size`` characters."""
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            *cols, texts = [c.to_pylist() for c in batch.slice(k, step).columns]
            ends = np.cumsum([len(t) for t in texts]) // size
            cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                yield [c[a:b] for c in cols], [t.encode().lower().split() for t in texts[a:b]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = list(counts)
        out = pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([form(w) if w else -1 for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "form", "c"],
        )
        counts.clear()
        return out

    for _, split in _texts(batches):
        for words in split:
            counts.update(words)
        counts[b""] += len(split)  # the end token: no word is empty
        if len(counts) > 400_000:
            yield flush()
    if counts:
        yield flush()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, form, c over all documents, stored; the end token is the empty word."""
    return stored(docs.sparkSession, docs.select(text_of(text_col).alias("text")).mapInArrow(_count, COUNTS).groupBy("word", "form").agg(F.sum("c").alias("c")))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words above the lowest threshold that leaves ``most`` of them at most."""
    step = F.floor(F.log2("c") * 16)
    tally = counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).collect()
    total, least = 0, None
    for r in tally:
        if total + r["n"] > most:
            break
        total, least = total + r["n"], r["k"]
    if least is None:
        return {}
    found = counts.filter(step >= least).select("word", "c").toArrow().to_pydict()
    return dict(zip(found["word"], found["c"]))


class Classes:
    """Class numbers of the tokens of some documents: words with vectors, forms, end, start."""

    def __init__(self, words: dict[bytes, int], least: int):
        ranked = sorted((w for w in words if w), key=lambda w: (-words[w], w))
        self.words = dict(zip(ranked, range(len(ranked))))
        self.count = np.array([words[w] for w in ranked], dtype=np.float64)
        self.own = int((self.count >= least).sum())
        self.end, self.start, self.size = self.own + FORMS, self.own + FORMS + 1, self.own + FORMS + 2
        self.cls = np.array([i if i < self.own else self.own + form(w) for i, w in enumerate(ranked)], dtype=np.int32)

    def index(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """For all words: place (-1: not known), class, document; and the words that are not known."""
        flat = [w for words in split for w in words]
        index = np.fromiter(map(self.words.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        doc = np.repeat(np.arange(len(split)), [len(w) for w in split])
        cls = self.cls[np.maximum(index, 0)] if len(self.cls) else np.zeros(len(flat), dtype=np.int32)
        unknown = np.flatnonzero(index < 0)
        other = [flat[k] for k in unknown.tolist()]
        cls[unknown] = self.own + forms(other)
        return index, cls, doc, other

    def trigrams(self, cls: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The two classes before, the class and the document of every token, the ends included."""
        lengths = np.bincount(doc, minlength=n_docs)
        first = np.concatenate([[0], np.cumsum(lengths + 3)])
        row = np.full(first[-1], self.start, dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(lengths)])
        row[np.arange(len(cls)) - start[doc] + first[doc] + 2] = cls
        row[first[1:] - 1] = self.end
        real = row[2:] != self.start
        return row[:-2][real], row[1:-1][real], row[2:][real], np.repeat(np.arange(n_docs), lengths + 1)


def classes_of(value: dict) -> Classes:
    """The classes of a broadcast, made once in each worker and kept with it (the table of words goes)."""
    if "classes" not in value:
        value["classes"] = Classes(value.pop("words"), value["least"])
    return value["classes"]


def new_model(share: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    vectors = lambda: rng.normal(0, 0.1, (len(share), DIMENSIONS)).astype(np.float32)
    return {
        "context": vectors(), "position": np.ones((2, DIMENSIONS), np.float32), "word": vectors(), "bias": np.log(share).astype(np.float32),
        "context_squares": np.ones(len(share), np.float32), "word_squares": np.ones(len(share), np.float32),
    }


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different places and the sum of the rows of each."""
    order = np.argsort(at.astype(np.uint16) if at.max(initial=0) < 1 << 16 else at, kind="stable")  # 16 bits are sorted by radix
    at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[starts], np.add.reduceat(rows[order], starts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def nce_step(model: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, target: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, rate: float) -> None:
    """Tell ``target`` after (one, two) from ``noise`` and move the model (adaptive rates by row)."""
    position, n, d = model["position"], len(target), DIMENSIONS
    a, b = model["context"][one], model["context"][two]
    q = position[0] * a + position[1] * b
    near, far = model["word"][target], model["word"][noise]
    hit = 1 - _sigmoid(_dots(q, near) + model["bias"][target] - log_noise[target])
    miss = -_sigmoid(q @ far.T + (model["bias"][noise] - log_noise[noise]))
    back = hit[:, None] * near + miss @ far
    moves = np.empty((n + len(noise), d + 1), dtype=np.float32)
    np.multiply(q, hit[:, None], out=moves[:n, :d])
    moves[n:, :d] = miss.T @ q
    moves[:n, d], moves[n:, d] = hit, miss.sum(axis=0)
    at, g = _summed(np.concatenate([target, noise]), moves)
    model["word_squares"][at] += _dots(g, g) / (d + 1)
    g *= (rate / np.sqrt(model["word_squares"][at]))[:, None]
    model["word"][at] += g[:, :d]
    model["bias"][at] += g[:, d]
    at, g = _summed(np.concatenate([one, two]), np.concatenate([back * position[0], back * position[1]]))
    model["context_squares"][at] += _dots(g, g) / d
    model["context"][at] += g * (rate / np.sqrt(model["context_squares"][at]))[:, None]
    model["position"] += rate * 0.01 / n * np.stack([np.einsum("ij,ij->j", back, a), np.einsum("ij,ij->j", back, b)])


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y)


def _train_part(shared, turn: int, rate: float, seed: int = 11):
    """Go through the documents of a task once; send how far each vector moved, in half precision, and how often it was used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        classes, share = classes_of(value), value["share"]
        model = {k: v.copy() for k, v in value["model"].items()}
        rng = np.random.default_rng([seed, turn, TaskContext.get().partitionId()])
        cumulative, log_noise = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
        as_context, as_word, tokens = np.zeros(classes.size), np.zeros(classes.size), 0
        for _, split in _texts(batches):
            _, cls, doc, _ = classes.index(split)
            one, two, target, _ = classes.trigrams(cls, doc, len(split))
            mixed = rng.permutation(len(target))
            for k in range(0, len(target), STEP):
                x = mixed[k : k + STEP]
                noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), classes.end)
                nce_step(model, one[x], two[x], target[x], noise, log_noise, rate)
                as_word[noise] += 1
            as_word += np.bincount(target, minlength=classes.size)
            as_context += np.bincount(one, minlength=classes.size) + np.bincount(two, minlength=classes.size)
            tokens += len(target)
        if not tokens:
            return
        moved, weights = _in_blocks(classes.size, WIDTH, np.float16), _in_blocks(classes.size, 4, np.float32)
        before, columns = value["model"], (slice(0, DIMENSIONS), slice(DIMENSIONS, 2 * DIMENSIONS), 2 * DIMENSIONS)
        for name, at in zip(("context", "word", "bias"), columns):
            moved.reshape(-1, WIDTH)[: classes.size, at] = model[name] - before[name]
        for k, x in enumerate((as_context, as_word, model["context_squares"], model["word_squares"])):
            weights.reshape(-1, 4)[: classes.size, k] = x
        used = np.flatnonzero(weights.reshape(len(weights), BLOCK, 4)[:, :, :2].any(axis=(1, 2)))
        place = (model["position"] - before["position"]).astype(np.float16)
        for k in range(0, len(used), 4096):
            some = used[k : k + 4096]
            yield _block_rows(some.tolist(), moved[some], weights[some])
        yield _block_rows([-1], [place], [np.array([tokens], np.float32)])

    return run


def _in_blocks(size: int, width: int, kind: type) -> np.ndarray:
    return np.zeros((-(-size // BLOCK), BLOCK * width), kind)


def _block_rows(blocks: list[int], *rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *[pa.array([x.tobytes() for x in r], pa.binary()) for r in rows]], names=["block", "moves", "weights"])


def _weighted(weights: np.ndarray) -> np.ndarray:
    """The weight of each moved number of a block: uses as context, uses as word."""
    return np.repeat(weights[:, :2], [DIMENSIONS, DIMENSIONS + 1], axis=1)


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean moves (32 bits) and mean squares of each block over the tasks, weighted by use."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, moves, weights in zip(*[c.to_pylist() for c in batch.columns]):
            moves, weights = np.frombuffer(moves, np.float16).astype(np.float64), np.frombuffer(weights, np.float32).astype(np.float64)
            if k < 0:
                add = [moves * weights[0], weights]
            else:
                weights = weights.reshape(BLOCK, 4).copy()
                weights[:, 2:] *= weights[:, :2]
                add = [moves.reshape(BLOCK, WIDTH) * _weighted(weights), weights]
            total[k] = [x + y for x, y in zip(total[k], add)] if k in total else add
    for k, (moves, weights) in total.items():
        if k < 0:
            moves = moves / weights[0]
        else:
            moves = moves / np.maximum(_weighted(weights), 1)
            weights[:, 2:] /= np.maximum(weights[:, :2], 1)
        yield _block_rows([k], [moves.astype(np.float32)], [weights.astype(np.float32)])


def averaged(model: dict[str, np.ndarray], blocks: list[int], moves: list[bytes], weights: list[bytes]) -> dict[str, np.ndarray]:
    """The model after the mean moves."""
    size, d = len(model["bias"]), DIMENSIONS
    for k, row, uses in zip(blocks, moves, weights):
        row = np.frombuffer(row, np.float32)
        if k < 0:
            model["position"] += row.reshape(2, d)
            continue
        at = slice(k * BLOCK, min(size, (k + 1) * BLOCK))
        row, uses = row.reshape(BLOCK, WIDTH)[: at.stop - at.start], np.frombuffer(uses, np.float32).reshape(BLOCK, 4)[: at.stop - at.start]
        model["context"][at] += row[:, :d]
        model["word"][at] += row[:, d : 2 * d]
        model["bias"][at] += row[:, 2 * d]
        for column, name in enumerate(("context_squares", "word_squares")):
            model[name][at] = np.where(uses[:, column] > 0, uses[:, 2 + column], model[name][at])
    return model


def train_all(training: DataFrame, words: dict[bytes, int], least: int, share: np.ndarray, rounds: int = 1, rate: float = 0.1) -> dict[str, np.ndarray]:
    """The model after ``rounds`` passes over all training documents."""
    model = new_model(share)
    words = {w: c for w, c in words.items() if c >= least}  # all others count by their form here
    for turn in range(rounds):
        shared = training.sparkSession.sparkContext.broadcast({"words": words, "least": least, "share": share, "model": model})
        parts = training.mapInArrow(_train_part(shared, turn, rate / (turn + 1)), MOVES)
        found = parts.repartition("block").mapInArrow(_add_blocks, MOVES).toArrow()
        model = averaged(model, *[found[c].to_pylist() for c in ("block", "moves", "weights")])
        shared.unpersist()
    return model


def train(codes: np.ndarray, counts: np.ndarray, steps: int = 3000, rate: float = 0.1, seed: int = 11) -> dict[str, np.ndarray]:
    """The same training over the closed table of classes, from trigrams drawn by their counts."""
    rng = np.random.default_rng(seed)
    seen = np.bincount(codes % CLASSES, weights=counts, minlength=CLASSES) + 0.1
    seen[START] = 1e-9
    share = seen / seen.sum()
    model = new_model(share)
    if not len(codes):
        return model
    cumulative, noise_cumulative = np.cumsum(counts / counts.sum()), np.cumsum(share)
    log_noise = np.log(NOISE * share).astype(np.float32)
    for _ in range(steps):
        code = codes[np.minimum(np.searchsorted(cumulative, rng.random(STEP)), len(codes) - 1)]
        noise = np.minimum(np.searchsorted(noise_cumulative, rng.random(NOISE)), END)
        nce_step(model, code // CLASSES**2, code // CLASSES % CLASSES, code % CLASSES, noise, log_noise, rate)
    return model


def log_sums(a: np.ndarray, b: np.ndarray, word: np.ndarray, bias: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log of the sum over all words of exp((a[one] + b[two]) . r(w) + b(w)), for each pair of one and two."""
    weight, out = np.exp(bias), np.empty(len(one))
    for k in range(0, len(one), CONTEXTS):
        x = slice(k, k + CONTEXTS)
        q, total = a[one[x]] + b[two[x]], 0
        with np.errstate(over="ignore", invalid="ignore"):
            for m in range(0, len(word), SUMMED):
                terms = q @ word[m : m + SUMMED].T
                total += np.exp(terms, out=terms) @ weight[m : m + SUMMED]
        far = np.flatnonzero(~((total > 1e-27) & (total < 1e27)))  # 32 bits don't hold the terms of such a sum: it is taken again by its logs
        total[far] = 1
        out[x] = np.log(total)
        for m in range(0, len(far), 64):
            terms = q[far[m : m + 64]].astype(np.float64) @ word.T + bias
            most = terms.max(axis=1)
            out[k + far[m : m + 64]] = most + np.log(np.exp(terms - most[:, None]).sum(axis=1))
    return out


def two_levels(model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The two levels of classes (the last class, a start, is context only): who stands where, and the vectors of both."""
    word, bias = model["word"][:-1].astype(np.float64), model["bias"][:-1].astype(np.float64)
    rank = np.argsort(-bias, kind="stable")
    together, todo, groups = max(GROUP, 2 * sqrt(len(bias))), [rank[ALONE:]], []
    while todo:
        some = todo.pop()
        if len(some) > together:
            x = word[some] - word[some].mean(axis=0)
            some = some[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
            todo += [some[: len(some) // 2], some[len(some) // 2 :]]
        elif len(some):
            groups.append(some)
    alone = rank[:ALONE]
    order = np.concatenate([alone, *groups])
    sizes = np.concatenate([np.ones(len(alone), np.int64), np.array([len(g) for g in groups], np.int64)])
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    word, weight = word[order], np.exp(bias[order] - bias.max())
    whole = np.add.reduceat(weight, cuts[:-1])
    return {
        "alone": len(alone), "cuts": cuts, "place": place, "group": np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[place],
        "word": word.astype(np.float32), "bias": bias[order].astype(np.float32),
        "upper": (np.add.reduceat(word * weight[:, None], cuts[:-1]) / whole[:, None]).astype(np.float32), "upper_bias": (np.log(whole) + bias.max()).astype(np.float32),
    }


def log_chances(levels: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(target | context) of tokens, the contexts being a[one] + b[two]."""
    group, place, alone, cuts = levels["group"][target], levels["place"][target], levels["alone"], levels["cuts"]
    upper, upper_bias, word, bias = (levels[k] for k in ("upper", "upper_bias", "word", "bias"))
    codes, met = np.unique(one * len(b) + two, return_inverse=True)  # each different context is summed once
    out = upper_bias[group] - log_sums(a, b, upper, upper_bias, *np.divmod(codes, len(b)))[met]
    for k in range(0, len(target), 8 * STEP):
        x = slice(k, k + 8 * STEP)
        out[x] += _dots(a[one[x]] + b[two[x]], upper[group[x]])
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(alone, len(cuts)))
    for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        x, own = order[cut[k] : cut[k + 1]], slice(*cuts[alone + k : alone + k + 2])
        i, j, at = one[x], two[x], place[x]
        out[x] += _dots(a[i] + b[j], word[at]) + bias[at] - log_sums(a, b, word[own], bias[own], i, j)
    return out


def log_table(model: dict[str, np.ndarray]) -> np.ndarray:
    """log10 P(class | two classes before), normalised, for every trigram code."""
    a, b = model["position"][0] * model["context"], model["position"][1] * model["context"]
    out = np.empty((CLASSES, CLASSES, CLASSES), dtype=np.float32)
    for one in range(CLASSES):
        s = (a[one] + b) @ model["word"].T + model["bias"]
        s[:, START] = -np.inf  # a start is context only
        s -= s.max(axis=1, keepdims=True)
        out[one] = ((s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)).astype(np.float32)
    return out.reshape(-1)


def _score(shared):
    names = [x.split(" ")[0] for x in SCORED.split(", ")]
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        classes, size, ends = classes_of(value), value["size"], value["ends"]
        first, second = (value["model"]["position"][k] * value["model"]["context"] for k in (0, 1))
        gain = np.log10(classes.count + 1)
        part, made = TaskContext.get().partitionId(), 0
        for (ids, held), split in _texts(batches, SCORED_TEXTS):
            n = len(split)
            index, cls, doc, rare = classes.index(split)
            one, two, target, of = classes.trigrams(cls, doc, n)
            known = index >= 0
            own = np.where(known, gain[np.maximum(index, 0)] if len(gain) else 0.0, 0.0)
            base = np.bincount(doc, weights=own, minlength=n) + log10(ends + 1)
            scores = log_chances(value["levels"], first, second, one, two, target)
            model = np.bincount(of, weights=scores / np.log(10), minlength=n)
            by_form = cls >= classes.own
            model += np.bincount(doc, weights=np.where(by_form, own - size[np.where(by_form, cls - classes.own, 0)], 0.0), minlength=n)
            some = np.bincount(doc, weights=known, minlength=n).astype(np.int64) + int(ends > 0)
            cut = np.concatenate([[0], np.cumsum(np.bincount(doc[~known], minlength=n))]).tolist()
            tallies = [Counter(rare[a:b]) for a, b in zip(cut, cut[1:])]
            cols = (
                np.arange(made, made + n) + (part << 36), ids, held, np.bincount(of, minlength=n), some, base, model,
                [list(t) for t in tallies], [list(t.values()) for t in tallies],
            )
            made += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, known_words: int = KNOWN_WORDS, least: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held = held_out(id_col) if held is None else held
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), text_of(text_col).alias("text"))
    training = rows.filter(~F.col("held")).select("text")
    counts = word_counts(training)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = least or max(LEAST, int(sqrt(total[0]) * LEAST_OF_ROOT))
    words = frequent(counts, known_words)
    ends = words.get(b"", 0) or (counts.filter("word = X''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    found = counts.filter(F.col("c") >= least).select("word", "c").toArrow().to_pydict()
    words.update(zip(found["word"], found["c"]))
    words.pop(b"", None)

    # tokens and words of each form class, without the words that are classes of their own
    own = sorted((c for c in words.values() if c >= least), reverse=True)
    rare = counts.filter((F.col("word") != F.lit(b"")) & (F.col("c") < least)).groupBy("form").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = np.zeros(FORMS), np.zeros(FORMS)
    for r in rare:
        n[r["form"]], v[r["form"]] = r["n"], r["v"]
    size = np.log10(n + v + 1)
    seen = np.array([*own, *n, ends, 0.0]) + 0.1
    seen[-1] = 1e-9  # a start is context only
    model = train_all(training, words, least, seen / seen.sum())

    contexts = {k: model[k] for k in ("context", "position")}
    shared = spark.sparkContext.broadcast({"words": words, "least": least, "model": contexts, "levels": two_levels(model), "size": size, "ends": ends})
    scored = stored(spark, rows.mapInArrow(_score(shared), SCORED))
    looked_up = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("rid", F.col("w.rare").alias("word"), F.col("w.times").alias("tf"))
    found = (
        looked_up.join(counts.select("word", "c"), "word")
        .groupBy("rid")
        .agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("gain"))
    )
    n_train, n_words = total
    return scored.drop("rare", "times").join(found, "rid", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * log10(n_train + n_words + 1)).alias("base_score"),
        (F.col("model") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
