"""External induced sorting of the suffixes of one shard's text, with their common prefixes.

Names as in induced sorting: a suffix is S if it is smaller than the next one,
L if greater; S* is an S whose predecessor is L.

1. The text is cut at its S* positions; the pieces are sorted, word by word,
   and named by rank.  The names form a text of at most half the length, whose
   suffixes are sorted in the same way (recursion) until it fits in memory,
   where prefix doubling sorts it.
2. A priority queue starts with the sorted S* suffixes.  Rows (position, common
   prefix with the row before) leave it in order of their first symbol; each
   induces the suffix one symbol longer, if that is L.  A second queue, from the
   greatest symbol down, starts with the L suffixes and induces the S ones: all
   suffixes leave it in order.
3. Common prefixes are carried along: that of two induced neighbours is one more
   than the least among the rows from the one that induced the first to the one
   that induced the second.  They are capped, so for each value it is enough to
   know the last row that had it or less.

Rows of a queue lie in buckets by their leading bits.  What exceeds the memory
of a ``Store`` goes to files, bucket by bucket, and a bucket that is too large
is dealt anew by its next bits when its turn comes.  Rows are taken and induced
in blocks: as many at a time as cannot be preceded by what they induce.

In memory stay a bounded number of rows, and eight bytes for each distinct
symbol of a level.  The order is that of the first ``cap`` symbols at least;
suffixes that agree in more may stand in any order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyarrow import fs

_BUCKETS = 512
_PAGE = 1 << 16  # rows read at a time where single rows of a file are wanted


class Store:
    """Where arrays and queues lie: up to ``rows`` rows each in memory, the rest in files below ``folder``."""

    def __init__(self, folder: str, rows: int):
        self.rows, self._folder, self._made = rows, folder, None
        self.spilled = 0

    def file(self) -> tuple[fs.FileSystem, str]:
        if self._made is None:
            system, path = fs.FileSystem.from_uri(self._folder)
            self._made = system, f"{path}/{uuid.uuid4().hex}"  # an attempt's own folder
            system.create_dir(self._made[1], recursive=True)
        self.spilled += 1
        return self._made[0], f"{self._made[1]}/{self.spilled}"

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        if self._made is not None:
            self._made[0].delete_dir(self._made[1])
            self._made = None


class Spool:
    """An array that is written from front to back and then read by ranges or rows."""

    def __init__(self, store: Store, dtype):
        self.store, self.dtype = store, np.dtype(dtype)
        self.length, self._parts, self._held = 0, [], 0
        self._file, self._out, self._source = None, None, None

    def append(self, block: np.ndarray) -> None:
        if len(block):
            self._parts.append(np.ascontiguousarray(block, self.dtype))
            self._held += len(block)
            self.length += len(block)
            if self._held > self.store.rows:
                self.flush()

    def flush(self) -> None:
        if self._out is None:
            self._file = self.store.file()
            self._out = self._file[0].open_output_stream(self._file[1])
        for part in self._parts:
            self._out.write(part.tobytes())
        self._parts, self._held = [], 0

    def close(self) -> Spool:
        if self._out is not None:
            self.flush()
            self._out.close()
            self._source = self._file[0].open_input_file(self._file[1])
        else:
            self._parts = [np.concatenate(self._parts) if self._parts else np.zeros(0, self.dtype)]
        return self

    def drop(self) -> None:
        if self._source is not None:
            self._source.close()
            self._file[0].delete_file(self._file[1])
        self._parts, self._source = [], None

    def __len__(self) -> int:
        return self.length

    def read(self, lo: int, hi: int) -> np.ndarray:
        if self._source is None:
            return self._parts[0][lo:hi]
        self._source.seek(lo * self.dtype.itemsize)
        return np.frombuffer(self._source.read((hi - lo) * self.dtype.itemsize), self.dtype)

    def gather(self, at: np.ndarray) -> np.ndarray:
        if self._source is None:
            return self._parts[0][at]
        out = np.empty(len(at), self.dtype)
        order = np.argsort(at, kind="stable")
        page = at[order] // _PAGE
        for rows in np.split(order, np.flatnonzero(page[1:] != page[:-1]) + 1):
            if len(rows):
                first = int(at[rows[0]]) // _PAGE * _PAGE
                out[rows] = self.read(first, min(first + _PAGE, self.length))[at[rows] - first]
        return out

    def blocks(self) -> Iterator[np.ndarray]:
        for lo in range(0, self.length, self.store.rows):
            yield self.read(lo, min(lo + self.store.rows, self.length))

    def blocks_backward(self) -> Iterator[np.ndarray]:
        for hi in range(self.length, 0, -self.store.rows):
            yield self.read(max(0, hi - self.store.rows), hi)[::-1]


class _Run:
    """Rows of many buckets in files, dropped when the last bucket has been read."""

    def __init__(self, spools: tuple[Spool, ...]):
        self.spools, self.parts = spools, 0

    def done(self) -> None:
        self.parts -= 1
        if not self.parts:
            for s in self.spools:
                s.drop()


class _Part(NamedTuple):
    """Rows [lo, hi) in memory, or of a run."""

    rows: tuple[np.ndarray, ...] | None
    run: _Run | None
    lo: int
    hi: int


class BucketQueue:
    """Rows (key, columns) that leave by ascending key, those of one key in the order they came."""

    def __init__(self, store: Store, low: int, high: int, dtypes: tuple, stable: bool = True):
        """Keys lie in [low, high).  Not ``stable``: rows of one key may leave in any order."""
        self.store, self.low, self.dtypes, self.stable = store, low, (np.int64, *dtypes), stable
        self.shift = max(0, int(high - low - 1).bit_length() - 9)
        self.fresh: list[tuple[np.ndarray, ...]] | None = []  # not yet dealt to buckets
        self.parts: list[list[_Part]] = [[] for _ in range(_BUCKETS)]
        self.sizes = [0] * _BUCKETS
        self.held = 0
        self.inner: BucketQueue | None = None  # the bucket in turn, dealt anew
        self.inner_at = -1

    def push(self, key: np.ndarray, *columns: np.ndarray) -> None:
        if not len(key):
            return
        if self.fresh is None:
            self._deal(key, *columns)
        else:
            self.fresh.append((key, *columns))
            self.held += len(key)
        if self.held > self.store.rows:
            self._deal_fresh()
            self._spill()

    def _deal_fresh(self) -> None:
        fresh, self.fresh = self.fresh, None
        for rows in fresh or ():
            self.held -= len(rows[0])
            self._deal(*rows)

    def _deal(self, key: np.ndarray, *columns: np.ndarray) -> None:
        rows = (key, *columns)
        above = key.astype(np.int64).view(np.uint64) - np.uint64(self.low % (1 << 64))  # unsigned, as keys may span all 64 bits
        bucket = (above >> np.uint64(self.shift)).astype(np.uint16)
        if len(key) > 1:
            order = np.argsort(bucket, kind="stable")
            bucket, rows = bucket[order], tuple(c[order] for c in rows)
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            b = int(bucket[lo])
            part = tuple(c[lo:hi] for c in rows)
            if b == self.inner_at:
                self.inner.push(*part)
                continue
            self.parts[b].append(_Part(part, None, 0, hi - lo))
            self.sizes[b] += hi - lo
            self.held += hi - lo

    def _spill(self) -> None:
        """What lies in memory goes to a file for each column, bucket after bucket."""
        spools = tuple(Spool(self.store, t) for t in self.dtypes)
        run = _Run(spools)
        for parts in self.parts:
            new = [i for i, p in enumerate(parts) if p.run is None]
            if new:
                lo = len(spools[0])
                for i in new:
                    for spool, column in zip(spools, parts[i].rows, strict=True):
                        spool.append(column[parts[i].lo:parts[i].hi])
                parts[new[0]:] = [_Part(None, run, lo, len(spools[0]))]
                run.parts += 1
        for spool in spools:
            spool.flush()
            spool.close()
        self.held = 0

    def take(self, b: int, most: int | None = None) -> tuple[np.ndarray, ...] | None:
        """The rows of a bucket, sorted; of a bucket of one key, or if ``most`` is given, some rows, in turn."""
        room = most or (self.sizes[b] if self.shift else self.store.rows)
        taken, rest = [], self.parts[b]
        while rest and room > 0:
            part = rest[0]
            size = min(room, part.hi - part.lo)
            taken.append(tuple(c[part.lo:part.lo + size] for c in part.rows) if part.run is None else tuple(s.read(part.lo, part.lo + size) for s in part.run.spools))
            if part.run is None:
                self.held -= size
            room -= size
            if size < part.hi - part.lo:
                rest[0] = part._replace(lo=part.lo + size)
            else:
                rest.pop(0)
                if part.run is not None:
                    part.run.done()
        if not taken:
            return None
        rows = tuple(np.concatenate(c) for c in zip(*taken, strict=True))
        self.sizes[b] -= len(rows[0])
        if self.shift and most is None:
            order = np.argsort(rows[0], kind="stable" if self.stable else None)
            rows = tuple(c[order] for c in rows)
        return rows

    def turns(self) -> Iterator[tuple[BucketQueue, int]]:
        """(queue, bucket) in order; what is pushed meanwhile must not precede the bucket in turn.

        Each bucket is to be taken until it is empty.
        """
        self._deal_fresh()
        for b in range(_BUCKETS):
            if self.shift and self.sizes[b] > self.store.rows:
                low = self.low + (b << self.shift)
                inner = BucketQueue(self.store, low, low + (1 << self.shift), self.dtypes[1:], self.stable)
                while (rows := self.take(b, self.store.rows)) is not None:
                    inner.push(*rows)
                self.inner, self.inner_at = inner, b
                yield from inner.turns()
                self.inner, self.inner_at = None, -1
            else:
                yield self, b

    def drain(self) -> Iterator[tuple[np.ndarray, ...]]:
        """All rows in order, for a queue that is not pushed to any more."""
        if self.fresh:  # all lie in memory
            rows = tuple(np.concatenate(c) for c in zip(*self.fresh, strict=True))
            order = np.argsort(rows[0], kind="stable" if self.stable else None)
            yield tuple(c[order] for c in rows)
            return
        for queue, b in self.turns():
            while (rows := queue.take(b)) is not None:
                yield rows


def _common(text: Spool, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, up to ``most``."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    step = 0
    while len(open_):
        open_ = open_[(step < most[open_]) & (a[open_] + step < len(text)) & (b[open_] + step < len(text))]
        open_ = open_[text.gather(a[open_] + step) == text.gather(b[open_] + step)]
        step += 1
        out[open_] = step
    return out


def _stars(text: Spool, store: Store) -> Spool:
    """The S* positions, from the last to the first."""
    out = Spool(store, np.int64)
    n, next_symbol, next_is_s = len(text), 0, True  # the end is smaller than every symbol and S
    right_first_s, right_position = True, n  # the position to the right of the block, and whether it is S
    for hi in range(n, 0, -store.rows):
        lo = max(0, hi - store.rows)
        block = text.read(lo, hi).astype(np.int64)
        following = np.append(block[1:], next_symbol)
        differs = block != following
        at = np.where(differs, np.arange(len(block)), len(block))
        at = np.minimum.accumulate(at[::-1])[::-1]  # the first position from here whose next symbol differs
        less = np.append(block < following, next_is_s)
        is_s = less[at]
        # a position is S* if it is S and the one before is L
        if right_position < n and right_first_s and not is_s[-1]:
            out.append(np.array([right_position]))
        stars = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
        out.append(stars[::-1] + lo)
        next_symbol, next_is_s = int(block[0]), bool(is_s[0])
        right_first_s, right_position = next_is_s, lo
    return out.close()


class _Pieces:
    """The S* positions in text order; the last one is followed by the end of the text."""

    def __init__(self, backward: Spool, n: int):
        self.backward, self.n, self.length = backward, n, len(backward)

    def at(self, j: np.ndarray) -> np.ndarray:
        out = np.full(len(j), self.n, np.int64)
        inside = j < self.length
        out[inside] = self.backward.gather(self.length - 1 - j[inside])
        return out


def _names(text: Spool, pieces: _Pieces, wide: bool, store: Store) -> tuple[Spool, int]:
    """The text of the pieces' names, and how many distinct ones there are.

    Pieces reach from one S* position to the next inclusive.  They are sorted
    by a word of symbols at a time; a piece that ends sorts behind one that goes
    on, as its last symbol is S and the other's L.  Only ties go on.
    """
    m = pieces.length
    per, bits = (2, 32) if wide else (8, 8)
    mark = (1 << bits) - 1
    done = BucketQueue(store, 0, m, (np.int64,), stable=False)  # (rank, piece)
    ties = Spool(store, np.int64)  # (rank, piece) of what is open, in order of rank
    ties_rank = Spool(store, np.int64)
    for lo in range(0, m, store.rows):
        ties.append(np.arange(lo, min(m, lo + store.rows)))
        ties_rank.append(np.zeros(min(m, lo + store.rows) - lo, np.int64))
    offset = 0
    while len(ties):
        by_word = BucketQueue(store, -(1 << 63), 1 << 63, (np.int64, np.int64, np.bool_), stable=False)
        for piece, rank in zip(ties.close().blocks(), ties_rank.close().blocks(), strict=True):
            start, stop = pieces.at(piece), pieces.at(piece + 1)
            last = piece == m - 1
            size = stop - start + ~last - offset
            word = np.zeros(len(piece), np.uint64)
            for k in range(per):
                at = start + offset + k
                inside = k < size
                symbol = np.where(inside, text.gather(np.where(inside, at, 0)), 0).astype(np.uint64)
                symbol[(k == size) & ~last] = mark
                word = word << np.uint64(bits) | symbol
            key = (word ^ np.uint64(1 << 63)).view(np.int64)  # unsigned order
            by_word.push(key, rank, piece, size < per)  # the word holds the mark, or a zero after the last piece
        ties.drop(), ties_rank.drop()
        by_rank = BucketQueue(store, 0, m, (np.int64, np.int64, np.bool_))
        if offset:
            for word, rank, piece, ended in by_word.drain():
                by_rank.push(rank, word, piece, ended)
        ties, ties_rank = Spool(store, np.int64), Spool(store, np.int64)
        waiting: tuple | None = None  # the last group, which may go on in the next block
        seen_rank, seen_count = -1, 0  # pieces already ranked within the rank of the last block's last group

        def settle(rank: np.ndarray, word: np.ndarray, piece: np.ndarray, ended: np.ndarray, ties: Spool, ties_rank: Spool, begin: int) -> int:
            """Rank whole groups of (rank, word); ``begin``: pieces of the first rank that precede them."""
            new = np.append(True, (rank[1:] != rank[:-1]) | (word[1:] != word[:-1]))
            first = np.append(True, rank[1:] != rank[:-1])
            place = np.arange(len(rank))
            base = np.maximum.accumulate(np.where(first, place, 0))
            group = np.maximum.accumulate(np.where(new, place, 0))
            to = rank + group - base + np.where(base == 0, begin, 0)
            size = np.bincount(np.cumsum(new) - 1)
            single = np.repeat(size == 1, size)
            settled = ended | single
            done.push(to[settled], piece[settled])
            ties.append(piece[~settled]), ties_rank.append(to[~settled])
            tail = int((rank == rank[-1]).sum())
            return tail + (begin if rank[0] == rank[-1] else 0)

        # at first all have one rank, and the order of words is theirs
        for block in by_rank.drain() if offset else ((rank, word, piece, ended) for word, rank, piece, ended in by_word.drain()):
            rows = block if waiting is None else tuple(np.concatenate(c) for c in zip(waiting, block, strict=True))
            # the last group stays back; within it all words are sorted, as they came in order
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = len(same) - int(same.sum())
            if cut:
                head = tuple(c[:cut] for c in rows)
                begin = seen_count if head[0][0] == seen_rank else 0
                seen_count = settle(*head, ties, ties_rank, begin)
                seen_rank = int(head[0][-1])
            waiting = tuple(c[cut:] for c in rows)
        if waiting is not None:
            settle(*waiting, ties, ties_rank, seen_count if waiting[0][0] == seen_rank else 0)
        offset += per
    ties.drop(), ties_rank.drop()
    in_order = BucketQueue(store, 0, m, (np.int64,), stable=False)
    name, last_rank = 0, -1
    for rank, piece in done.drain():
        new = np.append(rank[0] != last_rank, rank[1:] != rank[:-1])
        names = name + np.cumsum(new)
        name, last_rank = int(names[-1]), int(rank[-1])
        in_order.push(piece, names)
    out = Spool(store, np.int64)
    for _, names in in_order.drain():
        out.append(names)
    return out.close(), name


def _doubling(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and common prefixes (both capped) of a text in memory."""
    m = len(names)
    ranks, size = [names], 1
    while size < cap and ranks[-1].max() < m:
        r = ranks[-1]
        key = r * np.int64(m + 1)
        key[:-size] += r[size:] if size < m else 0
        order = np.argsort(key)
        key = key[order]
        new = np.empty(m, np.int64)
        new[order] = np.cumsum(np.append(True, key[1:] != key[:-1]))
        ranks.append(new)
        size *= 2
    order = np.argsort(ranks[-1])
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, m - 1), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((a < m) & (b < m))
        same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
        common[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, np.minimum(np.append(0, common), cap)


class _Pass:
    """One inducing pass: common prefixes of what is pushed, and of what leaves the queue."""

    def __init__(self, text: Spool, symbols: int, cap: int):
        self.text, self.cap = text, cap
        self.rows = 1  # rows that have left; the end of the text was the first
        self.last_push = np.full(symbols + 1, -1, np.int64)  # of each symbol, the row that last induced it
        self.last_row = np.zeros(cap + 1, np.int64)  # of each value, the last row with that common prefix or less
        self.before: tuple[int, int] | None = None  # key and position of the last row

    def leaving(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """The rows' common prefixes with the row before each; one symbol may begin suffixes of both types."""
        previous = np.append(self.before[0] if self.before else -2, key[:-1])
        previous_pos = np.append(self.before[1] if self.before else 0, pos[:-1])
        self.before = int(key[-1]), int(pos[-1])
        lcp = np.where(key == previous, lcp, 0)
        turn = np.flatnonzero((key != previous) & (key >> 1 == previous >> 1))
        if len(turn):
            lcp[turn] = _common(self.text, previous_pos[turn], pos[turn], np.full(len(turn), self.cap))
        return lcp

    def induced(self, lcp: np.ndarray, source: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Common prefixes of the induced rows with the ones pushed before them under the same symbol.

        ``lcp``: of all rows of the block; ``source``: those that induce, ascending.
        """
        lcp = lcp.astype(np.uint8)
        # for each value the last row of the block with that much or less
        suffix = np.minimum.accumulate(lcp[::-1])[::-1]
        last_row = self.last_row.copy()
        values = np.arange(int(suffix[0]), self.cap + 1)
        last_row[values] = self.rows + np.searchsorted(suffix, values.astype(np.uint8), side="right") - 1
        if not len(source):
            self.last_row, self.rows = last_row, self.rows + len(lcp)
            return np.zeros(0, np.int64)
        order = np.argsort(symbol, kind="stable")
        src, sym = source[order], symbol[order]
        first = np.append(True, sym[1:] != sym[:-1])
        out = np.zeros(len(src), np.int64)
        inner = np.flatnonzero(~first)
        if len(inner):
            lo, hi = src[inner - 1] + 1, src[inner] + 1
            out[inner] = _range_minima(lcp, lo, hi)
        heads = np.flatnonzero(first)
        known = self.last_push[sym[heads]]
        since = np.searchsorted(self.last_row, known, side="right")  # least value in a row after that one
        prefix = np.minimum.accumulate(lcp)[src[heads]]
        out[heads] = np.minimum(np.minimum(since, self.cap), prefix)
        self.last_push[sym[np.append(heads[1:] - 1, len(src) - 1)]] = self.rows + src[np.append(heads[1:] - 1, len(src) - 1)]
        self.last_row, self.rows = last_row, self.rows + len(lcp)
        result = np.empty(len(src), np.int64)
        result[order] = np.minimum(out + 1, self.cap)
        return result


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi], ranges that are not empty."""
    level = np.frexp(hi - lo)[1] - 1
    out = np.empty(len(lo), values.dtype)
    table, size = values, 1
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - size])
        table = np.minimum(table[:-size], table[size:])
        size *= 2
    return out


def _run(queue: BucketQueue, state: _Pass, text: Spool, induce, keep) -> None:
    """Empty the queue: rows leave in order, ``keep`` gets them, ``induce`` says which rows induce under which key."""
    for part, b in queue.turns():
        pending: tuple | None = None
        while True:
            more = part.take(b)
            if more is not None:
                if pending is None:
                    pending = more
                else:  # what waits was pushed earlier
                    pending = tuple(np.concatenate(c) for c in zip(pending, more, strict=True))
                    order = np.argsort(pending[0], kind="stable")
                    pending = tuple(c[order] for c in pending)
            if pending is None:
                break
            key, pos, lcp = pending
            source, to, symbol = induce(key, pos)
            # rows may leave up to the first that follows something still to be induced
            least = np.full(len(key), np.iinfo(np.int64).max)
            least[source] = to
            least = np.minimum.accumulate(least)
            late = np.flatnonzero(key[1:] > least[:-1])
            cut = int(late[0]) + 1 if len(late) else len(key)
            inside = int(np.searchsorted(source, cut))
            source, to, symbol = source[:inside], to[:inside], symbol[:inside]
            common = state.leaving(key[:cut], pos[:cut], lcp[:cut])
            keep(key[:cut], pos[:cut], common)
            queue.push(to, pos[source] - 1, state.induced(common, source, symbol))
            pending = tuple(c[cut:] for c in pending) if cut < len(key) else None


def sort(text: Spool, symbols: int, cap: int, store: Store) -> tuple[Spool, Spool]:
    """Positions of all suffixes from the greatest to the least, and the common prefix of each with the one before.

    Symbols of the text are 1 to ``symbols``, for bytes at most 254.
    """
    n = len(text)
    if not n:
        return Spool(store, np.int64).close(), Spool(store, np.uint8).close()
    pieces = _Pieces(_stars(text, store), n)
    m = pieces.length
    up = BucketQueue(store, 0, 2 * symbols + 2, (np.int64, np.int64))
    state = _Pass(text, symbols, cap)
    end = text.read(n - 1, n).astype(np.int64)
    up.push(2 * end, np.array([n - 1]), np.array([0]))
    state.last_push[end] = 0
    if m:
        for j, common in _sorted_stars(text, pieces, symbols, cap, store):
            pos = pieces.at(j)
            up.push(2 * text.gather(pos).astype(np.int64) + 1, pos, common)
    pieces.backward.drop()
    ls, ls_common = Spool(store, np.int64), Spool(store, np.uint8)

    def larger(key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        source = np.flatnonzero(pos > 0)
        symbol = text.gather(pos[source] - 1).astype(np.int64)
        fits = symbol >= key[source] >> 1  # of an S* row the one before is greater
        return source[fits], 2 * symbol[fits], symbol[fits]

    def keep_l(key: np.ndarray, pos: np.ndarray, common: np.ndarray) -> None:
        is_l = key & 1 == 0
        ls.append(pos[is_l]), ls_common.append(common[is_l])

    _run(up, state, text, larger, keep_l)
    ls.close(), ls_common.close()
    down = BucketQueue(store, 0, 2 * symbols + 2, (np.int64, np.int64))
    state = _Pass(text, symbols, cap)
    after = 0  # the common prefix with the row above belongs to that row
    for pos, common in zip(ls.blocks_backward(), ls_common.blocks_backward(), strict=True):
        symbol = text.gather(pos).astype(np.int64)
        down.push(2 * (symbols - symbol) + 1, pos, np.append(after, common[:-1]).astype(np.int64))
        after = int(common[-1])
    ls.drop(), ls_common.drop()
    out, out_common = Spool(store, np.int64), Spool(store, np.uint8)

    def smaller(key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        source = np.flatnonzero(pos > 0)
        symbol = text.gather(pos[source] - 1).astype(np.int64)
        own = symbols - (key[source] >> 1)
        fits = (symbol < own) | (symbol == own) & (key[source] & 1 == 0)
        return source[fits], 2 * (symbols - symbol[fits]), symbol[fits]

    def keep_all(key: np.ndarray, pos: np.ndarray, common: np.ndarray) -> None:
        out.append(pos), out_common.append(common)

    _run(down, state, text, smaller, keep_all)
    return out.close(), out_common.close()


def _sorted_stars(text: Spool, pieces: _Pieces, symbols: int, cap: int, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (number of the S* position, common prefix with the one before), ascending."""
    m = pieces.length
    names, distinct = _names(text, pieces, symbols > 254, store)
    fewer = cap // 2 + 1  # S* positions are at least two apart

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if m <= store.rows:
            yield _doubling(names.read(0, m), fewer)
            return
        order, common = sort(names, distinct, fewer, store)
        after = 0
        for j, c in zip(order.blocks_backward(), common.blocks_backward(), strict=True):
            yield j, np.append(after, c[:-1]).astype(np.int64)
            after = int(c[-1])
        order.drop(), common.drop()

    before = np.zeros(0, np.int64)
    for j, same in blocks():
        previous = np.append(before, j[:-1]) if len(before) else np.append(j[:1], j[:-1])
        from_, to = pieces.at(previous), pieces.at(j)
        length = np.where(same >= fewer, cap, pieces.at(np.minimum(j + same, m)) - to)
        short = np.flatnonzero(length < cap)
        a, b = from_[short] + length[short], to[short] + length[short]
        length[short] += _common(text, a, b, cap - length[short])
        if not len(before):
            length[0] = 0
        before = j[-1:]
        yield j, np.minimum(length, cap)
    names.drop()
