"""Passages that an earlier document holds, found by suffix sorting.

A byte goes if it is covered by a string of ``length`` bytes that also starts
in a document with a smaller doc_id.

1. Equal strings must meet in one shard.  Of the ``ANCHOR``-byte strings within
   each ``length``-byte window the one with the least hash is the window's
   anchor (the first of equals).  Windows that follow each other with the same
   anchor form a segment, which goes, with its text, to the shard that the
   anchor's hash says.  Segments are packed and compressed for each shard, and
   this is the only time that they are shuffled.
2. A task takes a shard at a time.  Segments whose anchor no other document
   holds are left out.  The suffixes of the others, one text with separators,
   are sorted by external induced sorting (``induce``), which gives their common
   prefixes too: neighbours that agree in ``length`` bytes are one passage, and
   the least doc_id among its segments decides for all of them.  A shard, or an
   anchor held by very many documents, may be larger than memory: the sort and
   what follows it keep ``rows`` rows and leave the rest to files in the shared
   folder.
3. Runs of windows found in an earlier document go back to their documents,
   where they are joined, and cut from the text.

Defined results.  A null doc_id counts as greater than all others.  Rows that
share a doc_id do not take bytes from each other, repeated rows neither.  Null
or empty texts, and those of fewer than ``length`` bytes, lose nothing.  Of
ties there are none: a smaller doc_id decides.  Very long texts are read in
pieces that overlap, each window in one of them.  Empty table: no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightmart.llm import induce
from flightmart.llm.common import python_batches, scratch

LENGTH = 50
ANCHOR = 16
SHARD_BYTES = 16_000_000  # bytes of text for each shard
ROWS = 8_000_000  # rows of an array or queue that a task keeps in memory
PART = 12_000_000  # bytes of segments that are sorted together, of one anchor at least
HELD = 100_000_000  # bytes of segments of a shard that stay unpacked
PIECE = 500_000  # bytes whose windows are looked at together
PACK = 16_000_000  # bytes of text whose segments are packed together, a payload for each shard
GATHER = 8192  # segments whose bytes are picked together
_LAST = np.iinfo(np.int64).max
_PLACE = np.uint64(27)  # bits for the place of an anchor; a piece is shorter
_FACTOR = 0x9E3779B97F4A7C15
_SEPARATOR, _FIRST = 1, 2  # symbols: the end of a segment, byte 0 (no text in UTF-8 holds a byte above 0xF4)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, by joining those of half the length."""
    whole, whole_size, power, power_size = None, 0, data.astype(np.uint64) + np.uint64(1), 1
    while True:
        if size & power_size:
            n = len(data) - (whole_size + power_size) + 1
            factor = np.uint64(pow(_FACTOR, power_size, 1 << 64))
            whole = power.copy() if whole is None else whole[:n] * factor + power[whole_size:whole_size + n]
            whole_size += power_size
        if whole_size == size:
            return _mixed(whole)
        n = len(data) - 2 * power_size + 1
        power = power[:n] * np.uint64(pow(_FACTOR, power_size, 1 << 64)) + power[power_size:power_size + n]
        power_size *= 2


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` hashes the place of the least, by its upper bits; of equals the first."""
    best = hashes >> _PLACE << _PLACE | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= window:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < window:
        best = np.minimum(best[:size - window], best[window - size:])
    return (best & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=5)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of [start, start + size), range after range."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes [start, start + size), range after range; some ranges at a time, as the places of bytes take many times their room."""
    out, at = np.empty(int(sizes.sum()), data.dtype), 0
    for lo in range(0, len(starts), GATHER):
        block = data[_ranges(starts[lo:lo + GATHER], sizes[lo:lo + GATHER])]
        out[at:at + len(block)] = block
        at += len(block)
    return out


class _Segments:
    """Segments of some documents, as arrays that a payload holds one after another."""

    FIELDS = (("doc", np.int32), ("start", np.int64), ("windows", np.uint8), ("anchor", np.uint8), ("text", np.uint8), ("order", np.int64), ("key", np.int64))

    def __init__(self, **arrays: np.ndarray):
        for name, dtype in self.FIELDS:
            setattr(self, name, arrays[name].astype(dtype, copy=False))

    def packed(self) -> bytes:
        arrays = [getattr(self, name) for name, _ in self.FIELDS]
        head = np.array([len(a) for a in arrays], np.int64)
        raw = b"".join(a.tobytes() for a in [head, *arrays])
        return len(raw).to_bytes(8, "little") + _zstd().compress(raw, asbytes=True)

    @classmethod
    def unpacked(cls, payload: pa.Buffer) -> _Segments:
        raw = pa.decompress(payload[8:], decompressed_size=int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)
        sizes = np.frombuffer(raw, np.int64, len(cls.FIELDS))
        at, arrays = 8 * len(cls.FIELDS), {}
        for (name, dtype), size in zip(cls.FIELDS, sizes.tolist(), strict=True):
            arrays[name] = np.frombuffer(raw, dtype, size, at)
            at += size * np.dtype(dtype).itemsize
        return cls(**arrays)


def _segments(shards: int, length: int):
    """(shard, payload, raw) of the documents (order, key, text) of a task, piece by piece."""
    window = length - ANCHOR + 1

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
        waiting, size = [], 0
        for batch in batches:
            for order, key, text in zip(batch.column("ord").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
                data = text.as_buffer().to_pybytes()
                for at in range(0, len(data) - length + 1, PIECE):
                    waiting.append((order, key, at, data[at:at + PIECE + length - 1]))
                    size += len(waiting[-1][3])
                    if size >= PIECE:
                        yield waiting
                        waiting, size = [], 0
        if waiting:
            yield waiting

    def cut(piece: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
        """(text, place in the piece, place in the text, windows, place of the anchor, shard) of the segments."""
        data = np.frombuffer(b"".join(p[3] for p in piece), np.uint8)
        sizes = np.array([len(p[3]) for p in piece])
        begin = np.cumsum(sizes) - sizes
        hashes = gram_hashes(data, ANCHOR)
        inside = _ranges(begin, sizes - length + 1)  # windows that do not cross the end of a text
        place = anchors(hashes, window)[inside]
        first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1))))
        start, place = inside[first], place[first]
        doc = np.searchsorted(begin, start, side="right") - 1
        base = np.array([p[2] for p in piece], np.int64)
        return doc, start, start - begin[doc] + base[doc], np.diff(np.append(first, len(inside))), place - start, (hashes[place] >> np.uint64(11)) % np.uint64(shards)

    def packs(pieces: list[list[tuple[int, int, int, bytes]]], found: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, bytes, int]]:
        docs = np.cumsum([0, *map(len, pieces)])
        bytes_ = np.cumsum([0, *(sum(len(p[3]) for p in piece) for piece in pieces)])
        doc, at, start, windows, anchor, shard = (np.concatenate(c) for c in zip(
            *((f[0] + d, f[1] + b, *f[2:]) for f, d, b in zip(found, docs.tolist(), bytes_.tolist(), strict=False)), strict=True))
        data = np.frombuffer(b"".join(p[3] for piece in pieces for p in piece), np.uint8)
        orders, keys = (np.array([p[k] for piece in pieces for p in piece], np.int64) for k in range(2))
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1]))
        for mine in np.split(order, cuts[1:]):
            held, local = np.unique(doc[mine], return_inverse=True)
            payload = _Segments(doc=local, start=start[mine], windows=windows[mine], anchor=anchor[mine],
                                text=_gathered(data, at[mine], windows[mine] + length - 1), order=orders[held], key=keys[held])
            yield int(shard[mine[0]]), payload.packed(), len(payload.text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, found, size = [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            for row in packs(waiting, found):
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["shard", "payload", "raw"])

        for piece in pieces(batches):
            waiting.append(piece), found.append(cut(piece))
            size += sum(len(p[3]) for p in piece)
            if size >= PACK:
                yield from emit()
                waiting, found, size = [], [], 0
        if waiting:
            yield from emit()

    return run


_RUNS = "ord long, key long, lo long, hi long"


def _runs_of_shards(folder: str, length: int, memory: int, part_bytes: int):
    """Runs [lo, hi) of bytes that an earlier document holds; rows of a shard come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, payloads, raw = None, [], 0
        for batch in batches:
            for shard, payload, size in zip(batch.column("shard").to_pylist(), batch.column("payload"), batch.column("raw").to_pylist(), strict=True):
                if shard != now and payloads:
                    yield from runs(payloads, raw)
                    payloads, raw = [], 0
                now, raw = shard, raw + size
                payloads.append(payload.as_buffer())
        if payloads:
            yield from runs(payloads, raw)

    def runs(payloads: list[pa.Buffer], raw: int) -> Iterator[pa.RecordBatch]:
        parts = -(-raw // part_bytes)  # a shard is dealt by anchors, so that what is in memory stays small
        shard = _Shard(payloads, raw <= HELD, length)
        for part in range(parts):
            for found in _runs(shard, part, parts, folder, length, memory):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["ord", "key", "lo", "hi"])

    return run


class _Shard:
    """A shard's payloads; unless it is small, they are unpacked anew for each part."""

    def __init__(self, payloads: list[pa.Buffer], hold: bool, length: int):
        self.payloads, self.length = payloads, length
        self.held = [self._opened(p) for p in payloads] if hold else None

    def _opened(self, payload: pa.Buffer) -> tuple[_Segments, np.ndarray, np.ndarray]:
        """A payload's segments, their anchors' hashes, and where their texts begin."""
        s = _Segments.unpacked(payload)
        sizes = s.windows.astype(np.int64) + self.length - 1
        begin = np.cumsum(sizes) - sizes
        words = np.ascontiguousarray(s.text[(begin + s.anchor)[:, None] + np.arange(ANCHOR)]).view(np.uint64)
        return s, _mixed(_mixed(words[:, 0] * np.uint64(_FACTOR)) + words[:, 1]), begin

    def chosen(self, part: int, parts: int) -> Iterator[tuple[_Segments, np.ndarray, np.ndarray, np.ndarray]]:
        """(segments, those of the part, their anchors' hashes, where texts begin) of each payload."""
        for s, h, begin in self.held if self.held is not None else map(self._opened, self.payloads):
            mine = np.flatnonzero(h % np.uint64(parts) == part)
            yield s, mine, h[mine], begin


def _runs(shard: _Shard, part: int, parts: int, folder: str, length: int, memory: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of those segments of a shard whose anchor belongs to ``part``."""
    hashes, orders = [], []
    for s, mine, h, _ in shard.chosen(part, parts):
        hashes.append(h), orders.append(s.order[s.doc[mine]])
    h, order = np.concatenate(hashes), np.concatenate(orders)
    if not len(h):
        return
    by = np.argsort(h, kind="stable")
    group = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
    shared = np.minimum.reduceat(order[by], group) < np.maximum.reduceat(order[by], group)
    keep = np.empty(len(h), bool)
    keep[by] = np.repeat(shared, np.diff(np.append(group, len(h))))
    if not keep.any():
        return
    del h, order, by, hashes, orders
    with induce.Store(folder, memory) as store:
        yield from _shared_runs(shard.chosen(part, parts), keep, length, store)


def _shared_runs(chosen: Iterator[tuple[_Segments, np.ndarray, np.ndarray, np.ndarray]], keep: np.ndarray, length: int, store: induce.Store) -> Iterator[tuple[np.ndarray, ...]]:
    known: dict[bytes, int] = {}  # segments of equal text are sorted once
    text, owner, starts, total = induce.Spool(store, np.uint8), induce.Spool(store, np.int32), [], 0
    held: list[list[np.ndarray]] = [[], [], [], []]  # of each segment: its text's number, the document's order and key, its start
    at = 0
    for s, mine, _, begin in chosen:
        at, mine = at + len(mine), mine[keep[at:at + len(mine)]]
        raw = s.text.tobytes()
        ids, new = np.empty(len(mine), np.int64), []
        for k, (lo, n) in enumerate(zip(begin[mine].tolist(), s.windows[mine].tolist(), strict=True)):
            piece = raw[lo:lo + n + length - 1]
            number = known.setdefault(piece, len(known))
            ids[k] = number
            if number == len(starts):
                starts.append(total)
                total += len(piece) + 1
                new.append(piece)
        if new:
            block = np.frombuffer(b"\xff".join(new) + b"\xff", np.uint8)
            text.append(np.where(block == 0xFF, _SEPARATOR, block + np.uint8(_FIRST)))
            owner.append(np.repeat(np.arange(len(starts) - len(new), len(starts)), [len(x) + 1 for x in new]))
        for column, values in zip(held, (ids, s.order[s.doc[mine]], s.key[s.doc[mine]], s.start[mine]), strict=True):
            column.append(values)
    known.clear()
    number, order, key, start = (np.concatenate(c) for c in held)
    by = np.argsort(number, kind="stable")
    number, order, key, start = number[by], order[by], key[by], start[by]
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    least, most = np.minimum.reduceat(order, first), np.maximum.reduceat(order, first)
    begin = np.array(starts)
    ends = np.append(begin[1:], total) - 1
    owner.close()
    positions, common = induce.sort(text.close(), 254, length, store)
    # the least document of each passage: of neighbours that agree in all of its bytes
    leasts, group, last = induce.Spool(store, np.int64), -1, _LAST
    for pos, lcp in zip(positions.blocks(), common.blocks(), strict=True):
        value = least[owner.gather(pos)]
        cuts = np.flatnonzero(lcp < length)
        if not len(cuts) or cuts[0] > 0:  # the last block's group goes on
            last = min(last, int(value[:cuts[0] if len(cuts) else None].min()))
        if len(cuts):
            mins = np.minimum.reduceat(value, cuts)
            if group >= 0:
                leasts.append(np.array([last]))
            leasts.append(mins[:-1])
            group, last = group + len(cuts), int(mins[-1])
    leasts.append(np.array([last]))
    leasts.close()
    back = induce.BucketQueue(store, 0, total, (np.int64,), stable=False)
    group = -1
    for pos, lcp in zip(positions.blocks(), common.blocks(), strict=True):
        ids = group + np.cumsum(lcp < length)
        value = leasts.read(max(0, int(ids[0])), int(ids[-1]) + 1)[ids - max(0, int(ids[0]))]
        group = int(ids[-1])
        segment = owner.gather(pos)
        end = ends[segment]
        wanted = (pos + length <= end) & (value < most[segment])
        back.push(pos[wanted], value[wanted])
    for s in (positions, common, leasts):
        s.drop()
    copies = np.diff(np.append(first, len(number)))
    for pos, value in back.drain():
        segment = owner.gather(pos)
        head = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        size = np.diff(np.append(head, len(segment)))
        here = segment[head]
        weight = np.cumsum(size * copies[here])
        cuts = np.searchsorted(weight, np.arange(store.rows, int(weight[-1]) + store.rows, store.rows), side="left") + 1
        lo = 0
        for hi in [*np.unique(np.minimum(cuts, len(here))).tolist()]:
            # each segment's windows, once for each document that holds the segment
            holder = _ranges(first[here[lo:hi]], copies[here[lo:hi]])
            turn = np.repeat(np.arange(lo, hi), copies[here[lo:hi]])
            row = _ranges(head[turn], size[turn])
            holder = np.repeat(holder, size[turn])
            flagged = np.flatnonzero(value[row] < order[holder])
            lo = hi
            if not len(flagged):
                continue
            row, holder = row[flagged], holder[flagged]
            new = np.flatnonzero(np.append(True, (holder[1:] != holder[:-1]) | (pos[row][1:] != pos[row][:-1] + 1)))
            stop = np.append(new[1:], len(row)) - 1
            from_ = start[holder[new]] + pos[row[new]] - begin[segment[row[new]]]
            yield order[holder[new]], key[holder[new]], from_, from_ + (stop - new) + length


def _joined(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [lo, hi) of each row that touch or overlap become one."""
    order = np.lexsort((lo, rows))
    rows, lo, hi = rows[order], lo[order], hi[order]
    wide = int(hi.max()) + 1 if len(hi) else 1
    reach = np.maximum.accumulate(rows * wide + hi)  # of an earlier row: below this row's first byte
    new = np.flatnonzero(np.append(True, rows[1:] * wide + lo[1:] > reach[:-1])) if len(rows) else rows
    last = np.append(new[1:], len(rows))[:len(new)] - 1
    return rows[new], lo[new], reach[last] - rows[new] * wide


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the runs of each document and cuts them from its text."""
    for batch in python_batches(batches, 2048):
        runs = batch.column("runs")
        fields = runs.flatten()
        size = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows, lo, hi = _joined(np.repeat(np.arange(batch.num_rows), size), *(fields.field(k).to_numpy(zero_copy_only=False) for k in range(2)))
        first = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["start", "end"]))
        kept = []
        for i, text in enumerate(batch.column("text")):
            text = text.as_buffer()
            data = pa.decompress(text[8:], decompressed_size=int.from_bytes(text[:8], "little"), codec="zstd", asbytes=True)
            a, b = first[i], first[i + 1]
            kept.append(b"".join(data[x:y] for x, y in zip([0, *hi[a:b].tolist()], [*lo[a:b].tolist(), len(data)], strict=True)) if a < b else data)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_buffer() for t in batch.column("text")]
        packed = [t.size.to_bytes(8, "little") + _zstd().compress(t, asbytes=True) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ord"), batch.column("key"), pa.array([t.size for t in texts], pa.int64()), pa.array(packed, pa.binary())],
                                         names=["doc_id", "ord", "key", "n_bytes", "text"])


def without_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, memory: int = ROWS, part_bytes: int = PART) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of all rows: the removed runs [start, end) of bytes, and the bytes that stay.

    ``length`` is from 17 to 200 bytes.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # (ord, key) tells rows apart; of rows with an id few share it, and half the bits do
    key = F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.crc32(text.cast("binary")))
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_LAST)).alias("ord"), key.alias("key"), text.cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    segments = rows.where(F.octet_length("text") >= length).select("ord", "key", "text").mapInArrow(_segments(shards, length), "shard long, payload binary, raw long")
    dealt = segments.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")  # a task for each, hashes would put many into one
    runs = dealt.mapInArrow(_runs_of_shards(scratch(docs.sparkSession, "repeats"), length, memory, part_bytes), _RUNS)
    by_doc = runs.groupBy("ord", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    packed = rows.mapInArrow(_compressed, "doc_id long, ord long, key long, n_bytes long, text binary")
    return packed.join(by_doc, ["ord", "key"], "left").select("doc_id", "n_bytes", "text", "runs").mapInArrow(
        _cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
