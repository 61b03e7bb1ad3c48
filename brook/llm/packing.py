"""Best-fit packing of tokenised documents into sequences of fixed length.

Tokenising writes one small row per piece.  The plan needs nothing but how many pieces there are of each
length (``capacity`` numbers): ``plan`` places large pieces first (over a third of the capacity: at most two
of them share a sequence, matched greedily with the longest partner that fits) and lets the smaller ones,
longest first, fill the tightest remaining gaps.  The plan is a list of patterns with repeat counts; pieces
find their place in it by their rank among those of equal length, so no task holds more than its own pieces.

Ranks come from counts per input task and length, so a length that a third of all pieces share is no hot spot.

Defined cases: a null or empty text is the end token alone; only documents over the capacity are cut; rows
that share an id are packed each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

CAPACITY = 2048
#: Distinct chunks a worker remembers beside as many earlier ones; beyond, the earlier ones go.
REMEMBERED = 200_000
PIECES = "id long, part int, rank long, piece int, start long, length int, crc long"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [rest.get(b, chr(b)) for b in range(256)]


class Chunks:
    """Token ids of white-space separated chunks, as little-endian unsigned 32-bit bytes.

    The tokenizer splits at white space before anything else, and between letters and other signs, so the ids of
    a chunk do not depend on its neighbours.  Most chunks are Latin letters and perhaps a stop or comma: their
    letters go to the merging step directly.  All others go through the whole tokenizer.
    """

    TAIL = b".,!?;:"

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {b"": b""}

    def whole(self, chunks: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([c.decode() for c in chunks], add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def core(self, low: bytes) -> bytes | None:
        """Ids of a run of lower-case Latin letters, or None."""
        if low.isalpha():
            word = low.decode()
        else:
            word = low.decode()
            if not word.isalpha() or max(word) > "\u024f" or unicodedata.normalize("NFC", word) != word:
                return None
            folded = word.lower()
            if not folded.isalpha():
                return None
            word = "".join(map(self.letters.__getitem__, folded.encode()))
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(word)])

    def learn(self, fresh: list[bytes]) -> None:
        known, cores, rest = self.known, self.cores, []
        for c in fresh:
            low = c.lower()
            core = low.rstrip(self.TAIL)
            ids = cores.get(core)
            if ids is None:
                ids = self.core(core)
                if ids is None:
                    rest.append(c)
                    continue
                cores[core] = ids
            tail = low[len(core) :]
            if tail:
                if tail not in cores:
                    cores[tail] = self.whole([tail])[0]
                ids += cores[tail]
            known[c] = ids
        for k in range(0, len(rest), 1024):
            known.update(zip(rest[k : k + 1024], self.whole(rest[k : k + 1024])))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        if len(self.known) > REMEMBERED:  # what is used again comes back from the chunks before
            self.before, self.known, self.cores = self.known, {}, {b"": b""}
        known, before = self.known, self.before
        fresh = []
        for c in {c for s in split for c in s if c not in known}:
            if c in before:
                known[c] = before[c]
            else:
                fresh.append(c)
        self.learn(fresh)
        return [b"".join(map(self.known.__getitem__, s)) for s in split]


def tokenise(tokenizer_path: str, capacity: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part = Chunks(tokenizer_path), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows: list[tuple] = []
                some = batch.slice(at, 128)
                ids = some.column(0).to_pylist()
                for i, raw in zip(ids, chunks.ids([t.encode() for t in some.column(1).to_pylist()])):
                    raw += end
                    for piece, k in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[k : k + 4 * capacity]
                        n = len(own) // 4
                        rows.append((i, part, int(ranks[n]), piece, k // 4, n, zlib.crc32(own)))
                        ranks[n] += 1
                cols = list(zip(*rows))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                names = ("id", "part", "rank", "piece", "start", "length", "crc")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths in a sequence), for so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    bins: dict[int, dict[tuple[int, ...], int]] = {}

    def put(lengths: tuple[int, ...], times: int) -> None:
        own = bins.setdefault(capacity - sum(lengths), {})
        own[lengths] = own.get(lengths, 0) + times

    rising = large[::-1]
    for n in large:
        while left.get(n):
            # the longest other large piece that fits beside it
            k = bisect_left(rising, capacity - n + 1) - 1
            while k >= 0 and not left.get(rising[k]):
                k -= 1
            if k < 0:
                put((n,), left.pop(n))
            elif rising[k] == n:
                pairs, odd = divmod(left.pop(n), 2)
                if pairs:
                    put((n, n), pairs)
                if odd:
                    left[n] = 0
                    m = k - 1
                    while m >= 0 and not left.get(rising[m]):
                        m -= 1
                    if m >= 0:
                        put((n, rising[m]), 1)
                        left[rising[m]] -= 1
                    else:
                        put((n,), 1)
                    left.pop(n)
            else:
                times = min(left[n], left[rising[k]])
                put((n, rising[k]), times)
                left[n] -= times
                left[rising[k]] -= times
        left.pop(n, None)
    gaps = sorted(bins)
    for n in sorted((n for n in left if left[n]), reverse=True):
        rest = left[n]
        while rest:
            k = bisect_left(gaps, n)
            if k == len(gaps):  # open full new sequences of this length, then one with the remainder
                per = capacity // n
                full, odd = divmod(rest, per)
                new = [((n,) * per, full), ((n,) * odd, int(odd > 0))]
                rest = 0
                for lengths, times in new:
                    if times:
                        put(lengths, times)
            else:
                gap = gaps[k]
                lengths, times = next(iter(bins[gap].items()))
                fit = min(gap // n, rest)
                used = min(times, rest // fit)
                bins[gap][lengths] -= used
                if not bins[gap][lengths]:
                    del bins[gap][lengths]
                put(lengths + (n,) * fit, used)
                rest -= used * fit
            gaps = sorted(g for g in bins if bins[g])
    return sorted((times, lengths) for own in bins.values() for lengths, times in own.items() if times)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, next rank, first sequence, copies of the length in the pattern, offset of the first, gap between copies)."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for n in dict.fromkeys(lengths):
            copies = lengths.count(n)
            first = taken.get(n, 0)
            taken[n] = first + times * copies
            out.append((n, first, taken[n], sequence, copies, offset, n))
            offset += n * copies
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stored(spark, docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(tokenise(tokenizer_path, capacity, end_id), PIECES))
    of_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = of_part.select("part", "length", before.alias("before"))
    counts = {r["length"]: r["n"] for r in of_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity numbers at most
    table = slots(plan(counts, capacity))
    by_length: dict[int, list] = {}
    for n, *rest in table:
        by_length.setdefault(n, []).append(tuple(rest))
    # the plan is bounded by the capacity (lengths and gaps), not by the corpus
    schema = "length int, runs array<struct<first:long,next:long,sequence:long,copies:long,place:long,step:long>>"
    lookup = F.broadcast(spark.createDataFrame([(n, sorted(v)) for n, v in by_length.items()], schema))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("r", F.col("rank") + F.col("before")).join(lookup, "length")
    run = F.element_at(F.filter("runs", lambda x: (x["first"] <= F.col("r")) & (F.col("r") < x["next"])), 1)
    inside = F.col("r") - F.col("run.first")
    return ranked.withColumn("run", run).select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        (F.col("run.sequence") + F.floor(inside / F.col("run.copies"))).cast("long").alias("sequence_id"),
        (F.col("run.place") + (inside % F.col("run.copies")) * F.col("run.step")).cast("long").alias("offset"),
    )
