"""Removal of repeated byte strings across documents, by suffix order of anchored fragments.

Every `size`-byte string (window) of a document belongs to the smallest hash of its 16-byte pieces, its anchor. Runs
of neighbouring windows with one anchor are a fragment, at most 40 windows; equal windows have equal anchors, so only
fragments of one anchor need to be compared, and only where two documents have the anchor:

1. anchors meet in buckets by hash; those of one document only are discarded, and so are fragments that agree with none of
   another document on the piece half of the rest of a window before the anchor or behind it: a common window has one of the two;
2. the bytes of the other fragments meet in buckets by anchor. Equal fragments are one text, of the smallest document;
   the suffixes of the texts of an anchor are sorted by column-wise construction of their collection transform
   (quarry.llm.suffixes); windows are suffixes of at least `size` bytes, equal ones are neighbours whose common prefix
   is at least `size`; the smallest document of a run of neighbours owns the window, all others lose it;
3. the windows lost meet with their documents, whose bytes outside of them remain.

Pieces of many documents (at least a 25th of a fixed sample of 500) are chosen as anchors only where a window has no
other, so that the surroundings of a passage that many documents share do not all have the same anchor; the sample decides on the choice of
anchors only, never on results. In each task only the first of equal texts is read; the later are lost as a whole.

Defined results: null texts and texts below `size` bytes lose nothing; strings are judged on the input; rows with
null doc_id are not compared and lose nothing; rows that repeat a doc_id are one document, which loses nothing to itself;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import partitions_for, small_batches, table, written
from quarry.llm.suffixes import sorted_suffixes, symbols

PIECE = 16
MOST = 40  # windows of a fragment
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
_HALF = np.uint64(1 << 63)
# one context for all blobs of a process
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """63-bit hashes of all 16-byte pieces; data: at least 16 bytes."""
    raw = data.tobytes()
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    x = eight[:-8] * _M1
    x += eight[8:] * _M2
    x ^= x >> np.uint64(29)
    x *= _M3
    x ^= x >> np.uint64(32)
    x >>= np.uint64(1)
    return x


class Hot:
    """Hashes of common pieces, with a bitmap that spares most look-ups."""

    def __init__(self, hashes: list[int]):
        self.hashes = np.sort(np.array(hashes, np.uint64))
        self.map = np.zeros(1 << 16, bool)
        self.map[(self.hashes >> np.uint64(47)).astype(np.int64)] = True

    def demote(self, x: np.ndarray) -> None:
        if len(self.hashes):
            at = np.flatnonzero(self.map[(x >> np.uint64(47)).astype(np.uint16)])
            near = np.minimum(np.searchsorted(self.hashes, x[at]), len(self.hashes) - 1)
            x[at[self.hashes[near] == x[at]]] |= _HALF


def fragments(data: np.ndarray, ends: np.ndarray, size: int, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, document number, start in data, windows, left and right side (see _sides); ends: where each document of data ends."""
    none = np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint16)] * 2
    if len(data) < size:
        return none
    x = piece_hashes(data)
    hot.demote(x)
    span, have = size - PIECE + 1, 1  # pieces in a window
    least = x
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[:len(least) - (span - have)], least[span - have:])
    n = len(data) - size + 1
    sizes = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), sizes)[:n]
    valid = np.arange(n) + size <= ends[owner]
    first = valid.copy()
    first[1:] &= (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    # a run ends where the next begins or the document has no further window
    stop = np.minimum(np.append(starts[1:], n), ends[owner[starts]] - size + 1)
    runs = stop - starts
    cut = -(-runs // MOST)
    step = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
    starts = np.repeat(starts, cut) + step * MOST
    runs = np.minimum(MOST, np.repeat(runs, cut) - step * MOST)
    return least[starts], owner[starts], starts, runs, *_sides(x, starts, runs, span)


def _sides(x: np.ndarray, starts: np.ndarray, runs: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of the pieces `span // 2` before and behind the anchor of each fragment; 0 where no window of it holds that piece,
    both 0 where the windows' first pieces with the anchor's hash are not one place.

    Equal windows have that place at the same distance. With the anchor `half` or more behind its start, a window holds the
    left piece, else the right one.
    """
    half = (span - 1) // 2
    at = np.lib.stride_tricks.sliding_window_view(x, span)[starts].argmin(axis=1)
    place, one = starts + at, runs <= at + 1
    bits = lambda i, has: np.where(has & one, x[np.clip(i, 0, len(x) - 1)] % np.uint64(65535) + np.uint64(1), np.uint64(0)).astype(np.uint16)
    return bits(place - half, at >= half), bits(place + half, at - runs + 1 < half)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed blob; numbers of 32 bits, most of them rising places, by their differences."""
    parts = [np.diff(a, prepend=a.dtype.type(0)) if a.dtype == np.uint32 else a for a in arrays]
    return _ZIP.compress(struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(p.tobytes() for p in parts))


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = _UNZIP.decompress(blob)
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}I", raw), 4 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        a = np.frombuffer(raw, kind, n, at)
        out.append(np.cumsum(a, dtype=np.uint32) if kind is np.uint32 else a)
        at += n * np.dtype(kind).itemsize
    return out


# Anchors travel as 32 bits beside the bucket they belong to; those that fall together there are told apart by their bytes.
# doc_id and text key of the documents of a blob; anchor, document, start, windows and sides of its fragments.
ANCHORS = (np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint16, np.uint16)
# anchor, start, windows
PLACES = (np.uint32, np.uint32, np.uint8)
# start, end
LOST = (np.uint32, np.uint32)
# as ANCHORS without sides, and the bytes of all fragments
TEXTS = (*ANCHORS[:6], np.uint8)


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) with compressed texts, for the way through a shuffle."""
    for batch in batches:
        texts = [None if t is None else _ZIP.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "key", "text"])


def _unzipped(text: bytes | None) -> bytes:
    return _UNZIP.decompress(text) if text else b""


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor.astype(np.uint64) * _M2 >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _anchors(size: int, buckets: int, shared):
    """(doc_id, key, text) to (bucket, blob); bucket -1: documents equal to one of this task with a smaller doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen = Hot(shared.value), {}
        for batch in batches:
            ids, keys, texts, copies = [], [], [], []
            for d, k, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                if len(data) < size:
                    continue
                if (h := hashlib.md5(data).digest()) in seen and seen[h] < d:
                    copies.append((d, k, len(data)))
                    continue
                if len(seen) < 200_000:
                    seen[h] = d
                ids.append(d)
                keys.append(k)
                texts.append(data)
            out = []
            if copies:
                out += [(-1, _pack([np.array(x, np.int64) for x in zip(*copies, strict=True)]))]
            if texts:
                anchor, owner, start, runs, left, right = fragments(*(joined := _joined(texts)), size, hot)
                begin = np.append(0, joined[1][:-1])
                start = start - begin[owner]
                ids, keys = np.array(ids, np.int64), np.array(keys, np.int64)
                for b, part in _by_bucket(_bucket(anchor, buckets)):
                    some, local = np.unique(owner[part], return_inverse=True)
                    out.append((b, _pack([ids[some], keys[some], anchor[part].astype(np.uint32), local.astype(np.uint32), start[part].astype(np.uint32), runs[part].astype(np.uint8), left[part], right[part]])))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], kinds: tuple) -> list[np.ndarray] | None:
    """Blobs of ANCHORS or TEXTS as columns: document ids and keys of each fragment, then the fragment's columns."""
    parts = [_unpack(b, kinds) for batch in batches for b in batch.column("blob").to_pylist()]
    if not parts:
        return None
    docs = [[p[0][p[3]] for p in parts], [p[1][p[3]] for p in parts]]
    rest = [[p[i] for p in parts] for i in (2, *range(4, len(kinds)))]
    return [np.concatenate(x) for x in (*docs, *rest)]


def _by_document(ids: np.ndarray, keys: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, key, blob of columns) for each document."""
    order = np.lexsort((keys, ids))
    ids, keys, columns = ids[order], keys[order], [c[order] for c in columns]
    cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(keys) != 0)) + 1
    starts, ends = np.append(0, cuts)[:len(ids)], np.append(cuts, len(ids))[:len(cuts) + bool(len(ids))]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        yield int(ids[a]), int(keys[a]), _pack([c[a:b] for c in columns])


def _homes(ids: np.ndarray, keys: np.ndarray, columns: list[np.ndarray], homes: int) -> pa.RecordBatch:
    """(home, blob): rows for many documents packed by where their documents will be gathered."""
    out = []
    for home, part in _by_bucket(_bucket(ids.view(np.uint64), homes)):
        out.append((home, _pack([ids[part], keys[part], *(c[part] for c in columns)])))
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["home", "blob"])


def _gather(kinds: tuple):
    """Blobs of _homes to (doc_id, key, blob of columns), a row for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(b, (np.int64, np.int64, *kinds)) for batch in batches for b in batch.column("blob").to_pylist()]
        if parts:
            ids, keys, *columns = (np.concatenate([p[i] for p in parts]) for i in range(2 + len(kinds)))
            rows: list = []
            for row in _by_document(ids, keys, columns):
                rows.append(row)
                if len(rows) == 4096:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return run


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    d, k, blobs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(blobs, pa.binary())], ["d", "k", "blob"])


def _of_two(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which rows have a key that two documents have."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key)
        cuts = np.append(0, np.flatnonzero(np.diff(key[order])) + 1)
        low, high = np.minimum.reduceat(ids[order], cuts), np.maximum.reduceat(ids[order], cuts)
        out[order] = np.repeat(low < high, np.diff(np.append(cuts, len(order))))
    return out


def alike(ids: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of the fragments that may share a window with another document's: anchor and a side agree. Where one of an
    anchor's fragments has no sides, all of the anchor may."""
    some = np.flatnonzero(_of_two(anchor, ids))
    ids, anchor, left, right = ids[some], anchor[some], left[some], right[some]
    keep = np.isin(anchor, np.unique(anchor[(left == 0) & (right == 0)]))
    for side in (left, right):
        has = np.flatnonzero(side != 0)
        keep[has] |= _of_two(anchor[has].astype(np.uint64) << np.uint64(16) | side[has].astype(np.uint64), ids[has])
    return some[keep]


def _shared(homes: int):
    """Blobs of ANCHORS to blobs by home: fragments that are alike (kind 0); copies go on (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            whole = np.array(batch.column("bucket")) < 0
            for blob in batch.filter(pa.array(whole)).column("blob").to_pylist():
                d, k, _ = _unpack(blob, (np.int64,) * 3)
                yield _kind(_homes(d, k, [np.zeros(len(d), np.uint8)], homes), 1)
            parts.append(batch.filter(pa.array(~whole)))
        if (all_of := _gathered(iter(parts), ANCHORS)) is None:
            return
        ids, keys, anchor, start, runs, left, right = all_of
        some = alike(ids, anchor, left, right)
        yield _kind(_homes(ids[some], keys[some], [anchor[some], start[some], runs[some]], homes), 0)

    return run


def _kind(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([kind] * batch.num_rows, pa.int32())], ["home", "blob", "kind"])


def _texts(size: int, buckets: int):
    """(doc_id, key, text, blob of PLACES) to (bucket, blob of TEXTS)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts, places = (batch.column(i).to_pylist() for i in range(4))
            data, ends = _joined([_unzipped(t) for t in texts])
            begin = np.append(0, ends[:-1])
            found = [(_unpack(b, PLACES), i) for i, b in enumerate(places)]
            anchor, start, runs = (np.concatenate([f[k] for f, _ in found]) for k in range(3))
            owner = np.repeat(np.array([i for _, i in found]), [len(f[0]) for f, _ in found])
            ids, keys, out = np.array(ids, np.int64), np.array(keys, np.int64), []
            for b, part in _by_bucket(_bucket(anchor, buckets)):
                some, local = np.unique(owner[part], return_inverse=True)
                sizes = runs[part].astype(np.int64) + size - 1
                at = np.repeat(begin[owner[part]] + start[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                out.append((b, _pack([ids[some], keys[some], anchor[part], local.astype(np.uint32), start[part], runs[part], data[at]])))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])

    return run


def owners(ids: np.ndarray, anchor: np.ndarray, runs: np.ndarray, data: np.ndarray, size: int, block: int = 1 << 18) -> np.ndarray:
    """For each window of each fragment, in order, the smallest document that has it."""
    sizes = runs.astype(np.int64) + size - 1
    starts = np.cumsum(sizes) - sizes
    raw = data.tobytes()
    bodies = [raw[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]
    # equal fragments become one text, of the smallest document
    number: dict[tuple, int] = {}
    text = np.array([number.setdefault(k, len(number)) for k in zip(anchor.tolist(), bodies, strict=True)], np.int64)
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, text, ids)
    first = np.zeros(len(number), np.int64)
    first[text[::-1]] = np.arange(len(text))[::-1]
    wins = runs[first].astype(np.int64)
    base = np.cumsum(wins) - wins
    own = np.repeat(least, wins)
    order = np.argsort(anchor[first], kind="stable")
    a = anchor[first][order]
    groups = np.split(order, np.flatnonzero(np.diff(a)) + 1)
    held: list[np.ndarray] = []
    used = symbols(data)
    room = 0
    for k, g in enumerate(groups):
        if len(g) > 1:  # a text alone with its anchor shares windows with itself only
            held.append(g)
            room += int(sizes[first[g]].sum())
        if held and (room >= block or k == len(groups) - 1):
            texts = np.concatenate(held)
            _resolve(texts, data, starts[first], sizes[first], base, own, least, size, used)
            held, room = [], 0
    if held:
        _resolve(np.concatenate(held), data, starts[first], sizes[first], base, own, least, size, used)
    del number, bodies, raw
    total = runs.astype(np.int64)
    return own[np.repeat((base[text] - (np.cumsum(total) - total)).astype(np.int32), total) + np.arange(total.sum(), dtype=np.int32)]


def _resolve(texts: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, base: np.ndarray, own: np.ndarray, least: np.ndarray, size: int, used: np.ndarray) -> None:
    number, length, prefix = sorted_suffixes(data, starts[texts], sizes[texts], used, size)
    runs = np.cumsum(prefix < size)
    windows = length >= size
    t, length, runs = texts[number[windows]], length[windows], runs[windows]
    if not len(t):
        return
    cuts = np.append(0, np.flatnonzero(np.diff(runs)) + 1)
    best = np.repeat(np.minimum.reduceat(least[t], cuts), np.diff(np.append(cuts, len(runs))))
    own[base[t] + sizes[t] - length] = best


def _lost(size: int, homes: int):
    """Blobs of TEXTS to blobs by home of LOST: runs of windows owned by a smaller document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (all_of := _gathered(batches, TEXTS)) is None:
            return
        ids, keys, anchor, start, runs, data = all_of
        if not len(ids):
            return
        own = owners(ids, anchor, runs, data, size)
        total = runs.astype(np.int64)
        fragment = np.repeat(np.arange(len(ids), dtype=np.int32), total)
        inside = np.arange(total.sum(), dtype=np.int32) - np.repeat((np.cumsum(total) - total).astype(np.int32), total)
        gone = own < ids[fragment]
        begin = gone.copy()
        begin[1:] &= ~gone[:-1] | (fragment[1:] != fragment[:-1])
        end = gone.copy()
        end[:-1] &= ~gone[1:] | (fragment[1:] != fragment[:-1])
        a, b = np.flatnonzero(begin), np.flatnonzero(end)
        f = fragment[a]
        if len(f):
            yield _homes(ids[f], keys[f], [(start[f] + inside[a]).astype(np.uint32), (start[f] + inside[b] + size).astype(np.uint32)], homes)

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, blob of LOST, whole) to the result's columns and the remaining bytes."""
    for batch in batches:
        rows = []
        for d, t, blob, whole in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data = _unzipped(t)
            spans = [(0, len(data))] if whole else []
            if blob and not whole:
                for a, b in sorted(zip(*(x.tolist() for x in _unpack(blob, LOST)), strict=True)):
                    if spans and a <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], b))
                    else:
                        spans.append((a, b))
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((d, len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in spans], kept))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), kind, pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in batch.column(0).to_pylist():
            data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            if len(data) >= PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(piece_hashes(data)).view(np.int64))], ["piece"])


def common_pieces(docs: DataFrame, n_docs: int, sample: int = 500) -> list[int]:
    """Pieces of at least a 25th of about `sample` documents: at most 25 times the pieces of one text, however many documents."""
    some = docs.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, n_docs // sample))) == 0).select("text")
    least = max(4, min(n_docs, sample) // 25)
    return [r.piece for r in some.mapInArrow(_pieces, "piece long").groupBy("piece").count().filter(F.col("count") >= least).select("piece").collect()]


def remove_repeats(docs: DataFrame, *, size: int = 50, bucket_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed bytes, maximal runs), kept (remaining bytes); docs: doc_id, text."""
    if not PIECE <= size <= 200:
        raise ValueError("size has to be 16 to 200 bytes")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    known = docs.filter("doc_id is not null and text is not null")
    n_docs, total = known.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = partitions_for((total or 0), bucket_bytes)
    hot = spark.sparkContext.broadcast(common_pieces(known, n_docs))
    first = known.select("doc_id", "key", "text").mapInArrow(_anchors(size, buckets, hot), "bucket long, blob binary")
    # copies found at once go on beside the buckets
    places = written(first.repartition(buckets, "bucket").mapInArrow(_shared(buckets), "home long, blob binary, kind int"), "places")
    row = "d long, k long, blob binary"
    spots = places.filter("kind = 0").select("home", "blob").repartition(buckets, "home").mapInArrow(_gather(PLACES), row)
    same = (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k"))
    # fragments overlap: their bytes are several times those of the text
    narrow = 8 * buckets
    zipped = "doc_id long, key long, text binary"
    packed = known.select("doc_id", "key", "text").mapInArrow(_zipped, zipped)
    bodies = packed.join(spots.hint("shuffle_hash"), same).select("doc_id", "key", "text", "blob").mapInArrow(_texts(size, narrow), "bucket long, blob binary")
    lost = written(bodies.repartition(narrow, "bucket").mapInArrow(_lost(size, buckets), "home long, blob binary"), "lost")
    marks = lost.repartition(buckets, "home").mapInArrow(_gather(LOST), row).withColumn("whole", F.lit(False))
    copies = places.filter("kind = 1").select("home", "blob").repartition(buckets, "home").mapInArrow(_gather((np.uint8,)), row).withColumn("whole", F.lit(True))
    marks = marks.join(copies.select("d", "k"), ["d", "k"], "left_anti").unionByName(copies)
    end = docs.select("doc_id", "key", "text").mapInArrow(_zipped, zipped).join(marks.hint("shuffle_hash"), same, "left").select("doc_id", "text", "blob", F.coalesce("whole", F.lit(False)).alias("whole"))
    return end.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_repeated_strings": op5}
SQL: dict[str, str] = {}
