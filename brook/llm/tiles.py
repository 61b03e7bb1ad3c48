"""Tiles: a corpus packed into rows of some megabytes, and the search for hashes that several documents share.

A tile is one row with the compressed texts of consecutive documents.  The table is written once to the
shared folder, bucketed by tile, so that passes over it meet what other tasks found for the tile without moving
the texts again.

``shared_keys`` finds the hashes held by more than one document.  A tile sends each of its hashes once (with
the number of its documents that hold it), shortened to the bits that matter and dealt out by hash; what comes
back to a tile are its own hashes with a count of two or more.  A shortened hash may join two different ones:
callers treat the answer as "perhaps shared" and verify.  A hash that a third of all documents hold costs one
entry a tile.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, shared_dir, stored, text_of
from .text_bytes import from_planes, to_planes

#: Bytes of text in a tile.  Larger executors may take larger ones; a single longer document is a tile of its own.
TILE_BYTES = 4 << 20
#: Bytes of text for each bucket of hashes.
BUCKET_BYTES = 8 << 20
TILE = "tile long, size long, ids binary, ends binary, texts binary"


def _pack(tile_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, size
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            row = [(part << 24) + made, size, np.array(ids, dtype=np.int64).tobytes(), ends.tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))]
            made, size = made + 1, 0
            ids.clear()
            texts.clear()
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["tile", "size", "ids", "ends", "texts"])

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    raw = t.encode()
                    if texts and size + len(raw) > tile_bytes:
                        yield flush()
                    ids.append(i)
                    texts.append(raw)
                    size += len(raw)
        if texts:
            yield flush()

    return run


def tile_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_bytes: int = TILE_BYTES) -> DataFrame:
    spark = docs.sparkSession
    packed = docs.select(doc_key(id_col).alias("did"), text_of(text_col).alias("text")).mapInArrow(_pack(tile_bytes), TILE)
    name = f"brook_tiles_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.write.bucketBy(buckets, "tile").option("path", shared_dir(spark)).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: files and buckets are known to the plan by now
    return table


class Tile:
    """The documents of a tile: ids, and the bytes of any range of them."""

    def __init__(self, row: dict):
        import zstandard

        self.number = row["tile"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        ends = np.frombuffer(row["ends"], dtype=np.int64)
        self.offsets = np.concatenate([[0], ends])
        raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(row["size"])))
        self.data = np.frombuffer(raw, dtype=np.uint8)
        self.lengths = np.diff(self.offsets)

    def part(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return self.data[a:b], self.offsets[first : last + 1] - a


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def bucket_bits(tiles: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """log2 of the number of buckets: as many as the corpus needs, from the sizes the tiles carry."""
    size = tiles.agg(F.sum("size")).first()[0] or 0
    return max(2, int(size // bucket_bytes).bit_length())


def shorten(h: np.ndarray, bits: int) -> np.ndarray:
    """The leading 32 + bits bits: bucket and key in one number."""
    return h >> np.uint64(32 - bits)


KEYS = "bucket int, tile long, keys binary, counts binary, digests binary, firsts binary"


def _send(keys_of: Callable[[Tile], np.ndarray], bits: int, digests_of: Callable[[Tile], np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            tile = Tile(row)
            short, counts = np.unique(shorten(keys_of(tile), bits), return_counts=True)
            bucket = (short >> np.uint64(32)).astype(np.int64)
            digests = digests_of(tile) if digests_of else np.zeros((0, 2), dtype=np.uint64)
            # the smallest id of each digest in the tile
            order = np.lexsort((tile.ids[: len(digests)], digests[:, 1], digests[:, 0]))
            d, i = digests[order], tile.ids[: len(digests)][order]
            new = np.ones(len(d), dtype=bool)
            new[1:] = (d[1:] != d[:-1]).any(axis=1)
            d, i = d[new], i[new]
            d_bucket = (d[:, 0] >> np.uint64(64 - bits)).astype(np.int64)
            there = np.union1d(bucket, d_bucket)  # a small part of all buckets of a large corpus
            cuts = [np.searchsorted(x, there, side=side).tolist() for x in (bucket, d_bucket) for side in ("left", "right")]
            out = []
            for b, k0, k1, d0, d1 in zip(there.tolist(), *cuts):
                own, at = slice(k0, k1), slice(d0, d1)
                keys = (short[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                out.append((b, tile.number, to_planes(np.diff(keys, prepend=np.uint32(0)).astype(np.uint32)), to_planes(counts[own].astype(np.uint32)), d[at].tobytes(), i[at].tobytes()))
            if out:
                cols = list(zip(*out))
                types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["bucket", "tile", "keys", "counts", "digests", "firsts"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys = [np.cumsum(from_planes(r["keys"], "<u4"), dtype=np.uint32) for r in rows]
    counts = [from_planes(r["counts"], "<u4") for r in rows]
    sizes = [len(k) for k in keys]
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(back, weights=np.concatenate(counts))[back] if len(back) else np.zeros(0)
    digests = [np.frombuffer(r["digests"], dtype=np.uint64).reshape(-1, 2) for r in rows]
    firsts = [np.frombuffer(r["firsts"], dtype=np.int64) for r in rows]
    all_d, all_i = np.concatenate(digests), np.concatenate(firsts)
    order = np.lexsort((all_i, all_d[:, 1], all_d[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (all_d[order][1:] != all_d[order][:-1]).any(axis=1)
    later = np.zeros(len(order), dtype=bool)
    if len(order):
        least = all_i[order][new][np.cumsum(new) - 1]
        later[order] = all_i[order] > least
    out, at, d_at = [], 0, 0
    for r, k, n, d in zip(rows, keys, sizes, digests):
        own = df[at : at + n]
        many = own >= 2
        gone = later[d_at : d_at + len(d)]
        at, d_at = at + n, d_at + len(d)
        if many.any() or gone.any():
            found = (np.uint64(r["bucket"]) << np.uint64(32)) | k[many].astype(np.uint64)
            out.append((r["tile"], r["bucket"], found.tobytes(), np.minimum(own[many], 4294967295).astype(np.uint32).tobytes(), d[gone].tobytes()))
    cols = list(zip(*out)) or [()] * 5
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["tile", "bucket", "keys", "df", "digests"])


FOUND = "tile long, bucket int, keys binary, df binary, digests binary"


def shared_keys(tiles: DataFrame, keys_of: Callable[[Tile], np.ndarray], bits: int, digests_of: Callable[[Tile], np.ndarray] | None = None) -> DataFrame:
    """tile, found (array of what came back for the tile), stored in the shared folder.

    ``keys_of`` gives a tile's hashes, each once for every document that holds it; ``digests_of`` gives a
    128-bit digest of each document, and digests that an earlier document has come back too.
    """
    sent = tiles.mapInArrow(_send(keys_of, bits, digests_of), KEYS)
    met = sent.groupBy("bucket").applyInArrow(_meet, FOUND)
    gathered = met.groupBy("tile").agg(F.collect_list(F.struct("bucket", "keys", "df", "digests")).alias("found"))
    return stored(tiles.sparkSession, gathered)


class Found:
    """What came back for a tile: sorted shortened hashes with document counts, and digests of copies."""

    def __init__(self, found: list[dict] | None, bits: int):
        rows = sorted(found or [], key=lambda r: r["bucket"])
        self.bits = bits
        self.keys = np.frombuffer(b"".join(r["keys"] for r in rows), dtype=np.uint64)
        self.df = np.frombuffer(b"".join(r["df"] for r in rows), dtype=np.uint32)
        self.digests = {raw[k : k + 16] for r in rows for raw in [bytes(r["digests"])] for k in range(0, len(raw), 16)}

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Documents that hold each hash: 1, or at least 2."""
        short = shorten(h, self.bits)
        if not len(self.keys):
            return np.ones(len(h), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.keys, short), len(self.keys) - 1)
        return np.where(self.keys[at] == short, self.df[at], np.uint32(1))
