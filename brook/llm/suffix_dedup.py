"""Suffix-array deduplication: remove bytes of repeated 50-byte strings, across documents.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

* Anchors: in each window of ``length`` bytes the ``seed``-byte substrings with the smallest hash are anchors.
  Equal windows have the same anchors, so only anchors that several documents share can lie in a repeat.
* Of these, each anchor's context (up to ``length - seed`` bytes on either side, no further than the document)
  is sent once per tile, with the smallest id that has it, to the bucket of the anchor's hash.
* There the suffixes that start at the anchors are sorted by merging runs.  Two suffixes are compared through
  the hashes of their prefixes: a binary search over the length finds how far they agree, so a comparison takes
  a logarithmic number of steps.  Neighbours give common extensions to the right; windows that start before the
  anchor need the same bytes to its left as well.  The smallest id over each set of equal windows decides.
* Agreement found by hash is verified on the bytes; a collision makes the bucket start afresh with another base.
* An anchor of more than ``hot`` documents (one near the edge of a very common passage has a context of its own in
  each) is dealt to several groups of tiles.  Each sorts its own suffixes; the windows that have no smaller id there go
  on by their bytes, so a window comes once from a group and the least id of all groups decides.
* The verdicts return to the tiles, where the windows are laid over the texts.

Whole texts that an earlier document has (by a 128-bit digest) go as a whole without taking part.  Long documents are
worked on in pieces that overlap by ``length`` bytes, so the arrays beside a text stay small.

Defined cases: a null or empty text has no bytes and keeps none; rows that share an id are not smaller than each
other; a null id is larger than every other; repeats inside one document stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, stored
from .text_bytes import BASE, mix, pieces, powers, prefix_hash, span_hash
from .tiles import Found, Tile, bucket_bits, rows_of, shared_keys, shorten, tile_table

LENGTH = 50
SEED = 20
#: Anchors of more documents than this are dealt to groups of about so many tiles.
HOT_DOCS, GROUP_TILES = 20_000, 64
CONTEXTS = "bucket int, salt long, tile long, n int, keys binary, firsts binary, left binary, right binary, context binary"
#: A place is the number of a context in its row times this, and where its window starts.
PLACES = 64
DECIDED = "tile long, bucket int, salt long, masks binary, windows binary, firsts binary, places binary"
WINDOWS = "window binary, first long, tile long, bucket int, place long"
RESULT = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) over x[i : i + width], for every i that has so many."""
    f, done = (np.minimum if least else np.maximum), 1
    while done < width:
        step = min(done, width - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position and hash of each anchor, and the prefix hashes of the data."""
    prefix = prefix_hash(data)
    width = length - seed + 1
    if len(data) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), prefix
    at = np.arange(len(data) - seed + 1)
    h = mix(span_hash(prefix, at, at + seed)) | np.uint64(1)
    least = _slide(h, width, True)
    # windows that cross the end of a document do not count
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    least[np.arange(len(least)) + length > room] = 0
    pad = np.zeros(width - 1, dtype=np.uint64)
    chosen = _slide(np.concatenate([pad, least, pad]), width, False)
    where = np.flatnonzero(h == chosen)
    return where, mix(h[where]), prefix  # mixed again: chosen hashes are small ones, and buckets go by the leading bits


def anchor_keys(length: int, seed: int):
    def run(tile: Tile) -> np.ndarray:
        out, long = [np.zeros(0, dtype=np.uint64)], []
        for _, data, offsets, _, start, end, more in pieces(tile.data, tile.offsets, length):
            where, h, _ = anchors(data, offsets, length, seed)
            own = (where >= start) & (where < end)
            where, h = where[own], h[own]
            if more or long:  # parts of one document: what they share is held once
                long.append(h)
                if not more:
                    out.append(np.unique(np.concatenate(long)))
                    long = []
                continue
            doc = np.searchsorted(offsets, where, side="right") - 1
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            out.append(h[new])
        return np.concatenate(out)

    return run


def digests(tile: Tile) -> np.ndarray:
    raw = tile.data.tobytes()
    own = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(tile.offsets[:-1].tolist(), tile.offsets[1:].tolist())]
    return np.frombuffer(b"".join(own), dtype=np.uint64).reshape(-1, 2)


class Contexts:
    """The shared anchors of a tile and their distinct contexts, in an order that is the same on every run."""

    def __init__(self, tile: Tile, found: Found, length: int, seed: int, hot: int):
        side = length - seed
        firsts: dict[bytes, int] = {}
        own = digests(tile)
        names = [own[k].tobytes() for k in range(len(tile.ids))]
        for name, i in zip(names, tile.ids.tolist()):
            firsts[name] = min(i, firsts.get(name, i))
        self.copy = np.array([name in found.digests or firsts[name] < i for name, i in zip(names, tile.ids.tolist())], dtype=bool)
        doc, at, key, code, left, right, many = ([np.zeros(0, dtype=t)] for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64, bool))
        for a, data, offsets, base, start, end, _ in pieces(tile.data, tile.offsets, length):
            where, h, prefix = anchors(data, offsets, length, seed)
            d = np.searchsorted(offsets, where, side="right") - 1
            n = found.counts(h)
            use = (n > 1) & ~self.copy[a + d] & (where >= start) & (where < end)
            where, h, d = where[use], h[use], d[use]
            lo, hi = np.maximum(where - side, offsets[d]), np.minimum(where + length, offsets[d + 1])
            l, r = where - lo, hi - where
            code.append(mix(span_hash(prefix, lo, hi) + l.astype(np.uint64) * np.uint64(BASE) + mix(r.astype(np.uint64))))
            doc.append(a + d)
            at.append(base + where)
            key.append(shorten(h, found.bits))
            left.append(l)
            right.append(r)
            many.append(n[use] > hot)
        self.doc, self.at, key, code, left, right, many = map(np.concatenate, (doc, at, key, code, left, right, many))
        order = np.lexsort((tile.ids[self.doc], code, key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (code[order][1:] != code[order][:-1])
        head = order[new]
        self.context = np.empty(len(order), dtype=np.int64)  # of each anchor
        self.context[order] = np.cumsum(new) - 1
        self.key, self.left, self.right = key[head], left[head], right[head]
        self.first, self.place, self.hot = tile.ids[self.doc[head]], self.at[head], many[head]

    def table(self, tile: Tile, length: int, seed: int, groups: int) -> Iterator[tuple]:
        """A row for each bucket, and one for each bucket of hot anchors, salted by the tile."""
        salt = 1 + int(mix(np.array([tile.number], dtype=np.uint64))[0] % np.uint64(groups))
        for salt, chosen in ((0, np.flatnonzero(~self.hot)), (salt, np.flatnonzero(self.hot))):
            yield from self._rows(tile, length, length - seed, salt, chosen)

    def _rows(self, tile: Tile, length: int, side: int, salt: int, chosen: np.ndarray) -> Iterator[tuple]:
        span = np.arange(-side, length)
        bucket = (self.key[chosen] >> np.uint64(32)).astype(np.int64)
        there, first = np.unique(bucket, return_index=True)
        for b, k0, k1 in zip(there.tolist(), first.tolist(), [*first.tolist()[1:], len(bucket)]):
            own = chosen[k0:k1]
            place, left, right = self.place[own, None], self.left[own, None], self.right[own, None]
            inside = (span >= -left) & (span < right)
            text = np.where(inside, tile.data[np.clip(place + span, 0, len(tile.data) - 1)], 0).astype(np.uint8)
            keys = (self.key[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield b, salt, tile.number, len(keys), keys.tobytes(), self.first[own].tobytes(), self.left[own].astype(np.uint8).tobytes(), self.right[own].astype(np.uint8).tobytes(), text.tobytes()


def _send(bits: int, length: int, seed: int, hot: int, groups: int):
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
    names = ["bucket", "salt", "tile", "n", "keys", "firsts", "left", "right", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            tile, found = Tile(row), Found(row["found"], bits)
            out = list(Contexts(tile, found, length, seed, hot).table(tile, length, seed, groups))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def agreement(prefix: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes suffixes a and b share: binary search over the prefix hashes."""
    low, high = np.zeros(len(a), dtype=np.int64), np.minimum(size[a], size[b])
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = prefix[a, middle] == prefix[b, middle]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_sort(text: np.ndarray, prefix: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes inside each group, by merging runs; comparisons go through the prefix hashes."""
    order = np.argsort(group, kind="stable")
    _, start, count = np.unique(group[order], return_index=True, return_counts=True)
    begin, members = np.repeat(start, count), np.repeat(count, count)
    width = 1
    while width < count.max(initial=0):
        slot = np.flatnonzero(members > width)
        place = slot - begin[slot]
        run = place // width
        odd = (run & 1).astype(bool)
        low = (run ^ 1) * width
        high = np.minimum(low + width, members[slot])
        pair = low < high
        slot, place, run, odd, low, high = (v[pair] for v in (slot, place, run, odd, low, high))
        base, me, other = begin[slot], order[slot], low.copy()
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            middle = (low[live] + high[live]) >> 1
            a, b = order[base[live] + middle], me[live]
            n = agreement(prefix, size, a, b)
            last = text.shape[1] - 1
            byte_a = np.where(n < size[a], text[a, np.minimum(n, last)].astype(np.int16), -1)
            byte_b = np.where(n < size[b], text[b, np.minimum(n, last)].astype(np.int16), -1)
            before = (byte_a < byte_b) | ((byte_a == byte_b) & odd[live])
            low[live] = np.where(before, middle + 1, low[live])
            high[live] = np.where(before, high[live], middle)
        moved = order.copy()
        moved[base + (run & ~1) * width + (place - run * width) + (low - other)] = me
        order = moved
        width *= 2
    return order


class Collision(Exception):
    pass


def repeats(context: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, first: np.ndarray, length: int, seed: int, base: int) -> np.ndarray:
    """For each distinct context, bit o: the window that starts o bytes before the anchor is in a smaller id."""
    side, m = length - seed, len(context)
    text = np.ascontiguousarray(context[:, side:])
    up, _ = powers(length + 1, base)
    prefix = np.zeros((m, length + 1), dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:length], axis=1, out=prefix[:, 1:])
    order = suffix_sort(text, prefix, right, group)
    near = np.zeros(m, dtype=np.int64)
    if m > 1:
        near[1:] = agreement(prefix, right, order[1:], order[:-1])
        near[1:][group[order][1:] != group[order][:-1]] = 0
        # the agreement that the hashes claim, on the bytes
        same = (text[order][1:] == text[order][:-1]) | (np.arange(length) >= near[1:, None])
        if not same.all():
            raise Collision
    mask = np.zeros(m, dtype=np.uint32)
    l, r, f = left[order], right[order], first[order]
    back = np.zeros(m, dtype=np.uint64)
    for o in range(side + 1):
        if o:
            back = back * np.uint64(base) + context[order, side - o].astype(np.uint64) + np.uint64(1)
        use = np.flatnonzero((l >= o) & (r >= length - o))
        if not len(use):
            continue
        run = np.cumsum(near < length - o)[use].astype(np.uint64)
        code = mix(back[use] ^ mix(run * np.uint64(BASE)))
        by = np.lexsort((f[use], code))
        new = np.ones(len(by), dtype=bool)
        new[1:] = code[by][1:] != code[by][:-1]
        head = by[new][np.cumsum(new) - 1]
        later = f[use][by] > f[use][head]
        mine, its = order[use[by[later]]], order[use[head[later]]]
        if o and len(mine) and not (context[mine, side - o : side] == context[its, side - o : side]).all():
            raise Collision
        if len(mine) and not (run[by[later]] == run[head[later]]).all():
            raise Collision
        mask[mine] |= np.uint32(1 << o)
    return mask


def _decide(length: int, seed: int):
    side = length - seed
    every = np.arange(side + 1)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["tile"])
        keys, firsts, left, right, context = (
            np.concatenate([np.frombuffer(r[c], dtype=t) for r in rows])
            for c, t in (("keys", np.uint32), ("firsts", np.int64), ("left", np.uint8), ("right", np.uint8), ("context", np.uint8))
        )
        sizes = [r["n"] for r in rows]
        salt = rows[0]["salt"]
        rows = [(r["bucket"], r["tile"]) for r in rows]
        context, left, right = context.reshape(-1, side + length), left.astype(np.int64), right.astype(np.int64)
        # equal contexts of several tiles are one, with the smallest id
        whole = np.ascontiguousarray(np.concatenate([keys.view(np.uint8).reshape(-1, 4), left.astype(np.uint8)[:, None], right.astype(np.uint8)[:, None], context], axis=1))
        names = whole.view(np.dtype((np.void, whole.shape[1]))).reshape(-1)
        _, head, back = np.unique(names, return_index=True, return_inverse=True)
        first = np.full(len(head), LAST_ID, dtype=np.int64)
        np.minimum.at(first, back, firsts)
        base = BASE
        while True:
            try:
                mask = repeats(context[head], left[head], right[head], keys[head], first, length, seed, base)
                break
            except Collision:
                base = (base * 0x5851F42D4C957F2D + 2) % (1 << 64) | 1
        valid = ((left[:, None] >= every) & (right[:, None] >= length - every)).astype(np.uint32) @ (np.uint32(1) << every.astype(np.uint32))
        masks = np.where(firsts > first[back], valid, mask[back]).astype(np.uint32)
        out, at = [], 0
        for (bucket, tile), n in zip(rows, sizes):
            own = slice(at, at + n)
            # windows of hot anchors without a smaller id in this group
            who, start = np.nonzero((((valid & ~masks)[own, None] >> every.astype(np.uint32)) & np.uint32(1)) if salt else np.zeros((0, side + 1)))
            windows = context[own][who[:, None], (side - start)[:, None] + np.arange(length)]
            out.append((tile, bucket, salt, masks[own].tobytes(), windows.tobytes(), firsts[own][who].tobytes(), (who * PLACES + start).tobytes()))
            at += n
        types = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["tile", "bucket", "salt", "masks", "windows", "firsts", "places"])

    return run


def _windows(length: int):
    """One row for each window that groups of tiles left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            first, place = np.frombuffer(r["firsts"], np.int64), np.frombuffer(r["places"], np.int64)
            for k in range(0, len(first), 10_000):
                n = len(first[k : k + 10_000])
                text = [r["windows"][j * length : (j + 1) * length] for j in range(k, k + n)]
                cols = (pa.array(text, pa.binary()), pa.array(first[k : k + n]), pa.array([r["tile"]] * n, pa.int64()), pa.array([r["bucket"]] * n, pa.int32()), pa.array(place[k : k + n]))
                yield pa.RecordBatch.from_arrays(list(cols), names=["window", "first", "tile", "bucket", "place"])

    return run


def _verdicts(own: Contexts, rows: list[dict]) -> np.ndarray:
    """The masks of a tile's contexts; a row with a salt under 0 sets one more bit of a hot one."""
    masks = np.zeros(len(own.key), dtype=np.uint32)
    rows = sorted(rows, key=lambda r: r["bucket"])
    masks[~own.hot] = np.frombuffer(b"".join(r["masks"] for r in rows if r["salt"] == 0), dtype=np.uint32)
    hot = np.frombuffer(b"".join(r["masks"] for r in rows if r["salt"] > 0), dtype=np.uint32).copy()
    begin, at = {}, 0
    for r in rows:
        if r["salt"] > 0:
            begin[r["bucket"]] = at
            at += len(r["masks"]) // 4
    for r in rows:
        if r["salt"] < 0:
            who, start = divmod(-1 - r["salt"], PLACES)
            hot[begin[r["bucket"]] + who] |= np.uint32(1 << start)
    masks[own.hot] = hot
    return masks


def _apply(bits: int, length: int, seed: int, hot: int):
    side = length - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            tile, found = Tile(row), Found(row["found"], bits)
            own = Contexts(tile, found, length, seed, hot)
            masks = _verdicts(own, row["masks"] or [])
            step = np.zeros(len(tile.data) + 1, dtype=np.int32)
            if len(own.at):
                mine = masks[own.context]
                # a document after the first one of its tile with this context: every window of it
                after = tile.ids[own.doc] > own.first[own.context]
                l, r = own.left[own.context], own.right[own.context]
                for o in range(side + 1):
                    hit = ((mine >> np.uint32(o)) & np.uint32(1)).astype(bool) | (after & (l >= o) & (r >= length - o))
                    start = np.unique(own.at[hit] - o)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + length, -1)
            gone = np.cumsum(step[:-1], dtype=np.int32) > 0
            out = []
            for k, (a, b) in enumerate(zip(tile.offsets[:-1].tolist(), tile.offsets[1:].tolist())):
                own_gone, data = gone[a:b], tile.data[a:b]
                if own.copy[k]:
                    own_gone = np.full(b - a, b - a >= length)
                removed = int(own_gone.sum())
                spans = int(own_gone[:1].sum() + (own_gone[1:] & ~own_gone[:-1]).sum())
                kept = data[~own_gone].tobytes() if removed else data.tobytes()
                out.append((int(tile.ids[k]), b - a, removed, spans, hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["did", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT_DOCS, group_tiles: int = GROUP_TILES
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256."""
    tiles = tile_table(docs, id_col, text_col)
    bits, groups = bucket_bits(tiles), 1 + tiles.count() // group_tiles
    found = shared_keys(tiles, anchor_keys(length, seed), bits, digests)
    met = tiles.join(found, "tile", "left")
    sent = met.mapInArrow(_send(bits, length, seed, hot, groups), CONTEXTS)
    decided = stored(docs.sparkSession, sent.groupBy("bucket", "salt").applyInArrow(_decide(length, seed), DECIDED))
    masks = decided.select("tile", "bucket", "salt", "masks")
    opened = decided.filter("salt > 0 and length(windows) > 0").drop("masks").mapInArrow(_windows(length), WINDOWS)
    least = opened.groupBy("window").agg(F.min("first").alias("least"))
    later = opened.join(least, "window").filter("first > least").select("tile", "bucket", (-1 - F.col("place")).alias("salt"), F.lit(b"").alias("masks"))
    per_tile = masks.unionByName(later).groupBy("tile").agg(F.collect_list(F.struct("bucket", "salt", "masks")).alias("masks"))
    out = met.join(per_tile, "tile", "left").mapInArrow(_apply(bits, length, seed, hot), RESULT)
    return out.select(
        F.when(F.col("did") == LAST_ID, F.lit(None).cast("long")).otherwise(F.col("did")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )
