"""External induced suffix sorting of one shard: which K-byte strings start at more than one place.

The suffixes between two local minima of the text are induced from those minima: first ascending, for suffixes
that are larger than their successor (L), then descending, for the others (S). Queues stand for the buckets of first
bytes; since suffixes reach each queue in order, a queue is a run on disk that is appended to and read in blocks. A
queue's tuples carry a suffix's position, the bytes before it (refilled eight at a time, so that the text is
rarely read at random), and the length of the prefix it shares with the tuple before it. That length is 1 more than
the least one between the two suffixes that induced the neighbours. The minima themselves are sorted by the same
two passes over the strings between them, and then by doubling of their names up to K bytes: the names' alphabet is as
large as the text, too large for queues of single bytes, and K bounds the rounds.

What is held in memory is a few blocks and at most PART tuples of each queue. Queues beyond `memory` bytes, and arrays
(text, minima, names, ranks, flags) beyond a quarter of it, lie in unnamed scratch files of the task, which go away with
it; all passes over arrays go block by block.
"""

from __future__ import annotations

import tempfile

import numpy as np

SEPARATOR = 0xFF  # no byte of UTF-8
BLOCK, PART = 1 << 18, 1 << 12


class Store:
    """Arrays in memory up to a budget, and in a scratch file beyond. The place of a dropped array is used again."""

    def __init__(self, memory: int):
        self.memory, self.used, self.file, self.end, self.free = memory, 0, None, 0, {}

    def put(self, a: np.ndarray):
        if self.used + a.nbytes <= self.memory:
            self.used += a.nbytes
            return a
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        room = max(4096, 1 << (a.nbytes - 1).bit_length())
        if self.free.get(room):
            at = self.free[room].pop()
        else:
            at, self.end = self.end, self.end + room
        self.file.seek(at)
        a.tofile(self.file)
        return at, len(a), a.dtype, room

    def get(self, held) -> np.ndarray:
        if isinstance(held, np.ndarray):
            return held
        self.file.seek(held[0])
        return np.fromfile(self.file, held[2], held[1])

    def drop(self, held) -> None:
        if isinstance(held, np.ndarray):
            self.used -= held.nbytes
        else:
            self.free.setdefault(held[3], []).append(held[0])

    def array(self, n: int, dtype) -> np.ndarray:
        """A zeroed array to write at random; mapped from a file if it is too large."""
        size = n * np.dtype(dtype).itemsize
        if size <= self.memory // 4 or n == 0:
            return np.zeros(n, dtype)
        f = tempfile.TemporaryFile()
        f.truncate(size)
        return np.memmap(f, dtype, "r+", shape=(n,))


class Queue:
    """Tuples in order. Small appends are gathered before they are put into the store."""

    def __init__(self, store: Store):
        self.store, self.blocks, self.pending, self.waiting, self.n = store, [], [], 0, 0

    def append(self, **columns: np.ndarray) -> None:
        size = len(columns["pos"])
        if size:
            self.pending.append({k: v.copy() for k, v in columns.items()})
            self.waiting += size
            self.n += size
            if self.waiting >= PART:
                self.flush()

    def flush(self) -> None:
        if self.pending:
            whole = {k: np.concatenate([x[k] for x in self.pending]) for k in self.pending[0]}
            for at in range(0, self.waiting, BLOCK):
                self.blocks.append((min(BLOCK, self.waiting - at), {k: self.store.put(v[at : at + BLOCK]) for k, v in whole.items()}))
            self.pending, self.waiting = [], 0

    def read(self, backwards: bool = False, keep: bool = False):
        """Blocks in order (or the last one first); what was appended in small parts comes together."""
        self.flush()
        some, n = [], 0
        for size, block in [*(reversed(self.blocks) if backwards else self.blocks), (0, None)]:
            if some and (block is None or n + size > BLOCK):
                some = some[::-1] if backwards else some
                yield {k: np.concatenate([self.store.get(x[k]) for x in some]) for k in some[0]}
                some, n = [], 0
            if block is not None:
                some.append(block)
                n += size
        if not keep:
            for _, block in self.blocks:
                for v in block.values():
                    self.store.drop(v)
            self.blocks = []


def _range_min(table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value in [low, high] of the array under a sparse table."""
    level = np.frexp(high - low + 1)[1].astype(np.int64) - 1
    row, flat = level * table.shape[1], table.reshape(-1)
    return np.minimum(flat[row + low], flat[row + high - (np.int64(1) << level) + 1])


def _table(values: np.ndarray) -> np.ndarray:
    """Row k: the least of 2**k values from each place that has so many."""
    n = len(values)
    out = np.empty((n.bit_length(), n), np.uint8)
    out[0] = values
    for k in range(1, len(out)):
        size, step = n - (1 << k) + 1, 1 << (k - 1)
        np.minimum(out[k - 1, :size], out[k - 1, step : step + size], out=out[k, :size])
    return out


class Induction:
    def __init__(self, text: np.ndarray, k: int, store: Store):
        """text: bytes with 8 zero bytes in front, which aren't part of it."""
        self.text, self.n, self.k, self.store = text[8:], len(text) - 8, k, store
        self.kind = np.int32 if self.n < 1 << 31 else np.int64
        self.before = np.ndarray((self.n + 1,), "<u8", text, strides=(1,))  # at p: the 8 bytes before p

    def tuples(self, pos: np.ndarray, lcp: np.ndarray) -> dict:
        return {"pos": pos.astype(self.kind), "lcp": lcp, "tail": self.before[pos].copy(), "left": np.minimum(pos, 8).astype(np.uint8)}

    def _push(self, block: dict, least: np.ndarray, queues: list[Queue], byte: int, up: bool, same: bool) -> None:
        """Induce what stands before each tuple of a block in scan order. least: for each queue, the least common
        prefix since it last got a tuple."""
        pos, tail, left = block["pos"], block["tail"], block["left"]
        target = (tail >> np.uint64(56)).astype(np.uint8)
        ok = (pos > 0) & ((target > byte) if up else (target < byte))
        if same:
            ok |= (pos > 0) & (target == byte)
        at = np.flatnonzero(ok)
        table = _table(block["lcp"])
        whole = int(block["lcp"].min())
        order = at[np.argsort(target[at], kind="stable")]
        to = target[order]
        first = np.append(True, to[1:] != to[:-1]) if len(to) else np.zeros(0, bool)
        low = np.where(first, 0, np.append(0, order[:-1] + 1)) if len(to) else order
        shared = _range_min(table, low, order) if len(to) else np.zeros(0, np.uint8)
        shared[first] = np.minimum(shared[first], least[to[first]])
        shared = np.minimum(shared + 1, self.k).astype(np.uint8)
        np.minimum(least, whole, out=least)
        bounds = np.append(np.flatnonzero(first), len(to))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own, t, last = order[a:b], int(to[a]), int(order[b - 1])
            p, rest, word = pos[own] - 1, left[own] - 1, tail[own] << np.uint64(8)
            empty = np.flatnonzero((rest == 0) & (p > 0))
            word[empty], rest[empty] = self.before[p[empty]], np.minimum(p[empty], 8)
            queues[t].append(pos=p, lcp=shared[a:b], tail=word, left=rest.astype(np.uint8))
            least[t] = block["lcp"][last + 1 :].min() if last + 1 < len(pos) else 255

    def larger(self, seeds: list[Queue], runs: np.ndarray) -> tuple[list[Queue], np.ndarray]:
        """L suffixes by first byte, in order, and the longest run of the byte in front of one. seeds: minima by first
        byte, in order; runs: how often the first byte repeats at the least of them."""
        queues, out = [Queue(self.store) for _ in range(256)], [Queue(self.store) for _ in range(256)]
        least, longest = np.full(256, 255, np.uint8), np.zeros(256, np.int64)
        end = np.array([self.n - 1])
        queues[self.text[self.n - 1]].append(**self.tuples(end, np.zeros(1, np.uint8)))
        for c in range(256):
            while queues[c].n:
                now, queues[c], start = queues[c], Queue(self.store), True
                for block in now.read():
                    if start:
                        block["lcp"][0] = min(longest[c], self.k)
                    start = False
                    out[c].append(**{x: block[x] for x in ("pos", "lcp", "tail", "left")})
                    self._push(block, least, queues, c, True, True)
                longest[c] += 1
            start = True
            for block in seeds[c].read(keep=True):
                if start:
                    block["lcp"] = block["lcp"].copy()
                    block["lcp"][0] = min(longest[c], runs[c], self.k)
                start = False
                self._push(block, least, queues, c, True, False)
            np.minimum(least, 0, out=least)
        return out, longest

    def smaller(self, large: list[Queue], longest: np.ndarray, found) -> None:
        """Give found(first byte, S blocks in descending order, L blocks in descending order, seam)."""
        queues = [Queue(self.store) for _ in range(256)]
        least = np.full(256, 255, np.uint8)
        for c in range(255, -1, -1):
            done, run = Queue(self.store), 0
            while queues[c].n:
                now, queues[c], start = queues[c], Queue(self.store), True
                for block in now.read():
                    if start:
                        block["lcp"][0] = min(run, self.k)
                    start = False
                    done.append(pos=block["pos"], lcp=block["lcp"])
                    self._push(block, least, queues, c, False, True)
                run += 1
            seam = min(run, int(longest[c]), self.k)
            carry, back = seam, Queue(self.store)
            for block in large[c].read(backwards=True):
                block = {x: v[::-1].copy() for x, v in block.items()}
                shifted = np.append(np.uint8(carry), block["lcp"][:-1])
                carry, block["lcp"] = block["lcp"][-1], shifted
                back.append(pos=block["pos"], lcp=shifted)
                self._push(block, least, queues, c, False, False)
            np.minimum(least, 0, out=least)
            found(c, done, back)


def _types(text: np.ndarray, store: Store, kind) -> np.ndarray:
    """Positions whose suffix is smaller than the next one and comes after a larger one: the local minima."""
    parts, n, count = [], len(text), 0
    smaller_next, step = False, BLOCK  # the last suffix is larger than the empty one
    for low in range((max(n - 1, 0) // step) * step, -1, -step):
        high = min(n, low + step)
        part = text[low : min(n, high + 1)].astype(np.int16)
        d = np.diff(part) if high < n else np.append(np.diff(part), -1)
        change = np.flatnonzero(d)
        nxt = np.cumsum(d != 0) - (d != 0)
        small = np.where(nxt < len(change), d[change[np.minimum(nxt, len(change) - 1)]] > 0 if len(change) else False, smaller_next)
        first_small = bool(small[0])
        prev = text[low - 1 : high - 1] if low else np.concatenate([text[:1], text[: high - 1]])
        own = (np.flatnonzero(small & (prev > text[low:high])) + low).astype(kind)
        parts.append(store.put(own))
        count += len(own)
        smaller_next = first_small
    return _gathered(parts[::-1], count, store, kind)


def _gathered(parts: list, count: int, store: Store, kind, backwards: bool = False) -> np.ndarray:
    """One array of what the store holds in parts (each of them read backwards, if so)."""
    out, at = store.array(count, kind), 0
    for held in parts:
        own = store.get(held)
        out[at : at + len(own)] = own[::-1] if backwards else own
        at += len(own)
        store.drop(held)
    return out


def _common(words: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Length of the common prefix at a and at b, k at most. words: at p, the 8 bytes from p."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        diff = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        bits = np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)).astype(np.int64)  # zeros below the lowest set bit
        out[live] = np.minimum(np.minimum(out[live] + bits // 8, k), n - np.maximum(a[live], b[live]))
        live = live[(diff == 0) & (out[live] < np.minimum(k, n - np.maximum(a[live], b[live])))]
    return out


def _argsort(key: np.ndarray) -> np.ndarray:
    """Stable order of integers: where key and place fit into 63 bits, as a plain sort of the two in one number."""
    if not len(key):
        return np.zeros(0, np.int64)
    low, bits = int(key.min()), (len(key) - 1).bit_length()
    if (int(key.max()) - low).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    both = key.astype(np.int64) - low
    both <<= bits
    both |= np.arange(len(key))
    both.sort()
    both &= (1 << bits) - 1
    return both


def order_by(key: np.ndarray, store: Store, limit: int | None = None) -> np.ndarray:
    """Stable order of non-negative keys; beyond `limit`, by dealing them to ranges that are sorted one at a time."""
    limit = limit or 16 * BLOCK
    if len(key) <= limit:
        return _argsort(key)
    sample = np.sort(key[np.random.default_rng(0).integers(0, len(key), 1 << 16)])
    cuts = np.unique(sample[:: max(1, len(sample) * limit // (4 * len(key)))])
    parts: list[list] = [[] for _ in range(len(cuts) + 1)]
    for at in range(0, len(key), limit):
        part = np.searchsorted(cuts, key[at : at + limit], "right")
        for p in np.unique(part):
            parts[p].append(store.put(np.flatnonzero(part == p) + at))
    out, done = store.array(len(key), np.int64), 0
    for held in parts:
        own = np.concatenate([store.get(h) for h in held]) if held else np.zeros(0, np.int64)
        for h in held:
            store.drop(h)
        out[done : done + len(own)] = own[_argsort(key[own])]
        done += len(own)
    return out


def _blocks(n: int):
    return ((at, min(n, at + BLOCK)) for at in range(0, n, BLOCK))


class Members:
    """Which of n positions belong to an ascending array, and how many of it are smaller: a bit for each position, and a
    count for every 64."""

    def __init__(self, array: np.ndarray, n: int, store: Store, kind):
        self.bits, self.below = store.array(n // 64 + 1, np.uint64), store.array(n // 64 + 1, kind)
        step, at = 64 * max(1, BLOCK // 64), 0
        for low in range(0, n, step):
            end = int(np.searchsorted(array, low + step))
            own = np.zeros(step, np.uint8)
            own[np.asarray(array[at:end]) - low] = 1
            words = np.packbits(own, bitorder="little").view("<u8")[: len(self.bits) - low // 64]
            count = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.bits[low // 64 : low // 64 + len(words)] = words
            self.below[low // 64 : low // 64 + len(words)] = at + np.append(0, count[:-1])
            at = end

    def has(self, pos: np.ndarray) -> np.ndarray:
        return (self.bits[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1) == 1

    def number(self, pos: np.ndarray) -> np.ndarray:
        less = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
        return self.below[pos >> 6].astype(np.int64) + np.bitwise_count(self.bits[pos >> 6] & less)


class Shard:
    """The bytes of one shard, its local minima, and their order."""

    def __init__(self, pieces: np.ndarray, k: int, memory: int):
        self.n, self.k, self.store = len(pieces), k, Store(memory)
        padded = self.store.array(self.n + 16, np.uint8)
        for a, b in _blocks(self.n):
            padded[8 + a : 8 + b] = pieces[a:b]
        self.text = padded[8 : 8 + self.n]
        self.work = Induction(padded[: self.n + 8], k, self.store)
        self.words = np.ndarray((self.n + 1,), "<u8", padded, offset=8, strides=(1,))
        self.minima = _types(self.text, self.store, self.work.kind)

    def seeds(self, pos: np.ndarray, sorted_: bool) -> tuple[list[Queue], np.ndarray]:
        """pos by first byte, each with the prefix it shares with the one before it (if they are sorted), and how often
        the first byte repeats at the first of each."""
        by, runs = [Queue(self.store) for _ in range(256)], np.zeros(256, np.int64)
        for a, b in _blocks(len(pos)):
            own, lcp = np.array(pos[a:b]), np.zeros(b - a, np.uint8)
            if sorted_:
                first = max(a, 1)
                lcp[first - a :] = _common(self.words, self.n, np.array(pos[first - 1 : b - 1]), own[first - a :], self.k)
            byte = self.text[own]
            order = np.argsort(byte, kind="stable")
            cut = np.searchsorted(byte[order], np.arange(257))
            for c in np.flatnonzero(np.diff(cut)).tolist():
                some = order[cut[c] : cut[c + 1]]
                if not by[c].n:
                    run = self.text[own[some[0]] : own[some[0]] + self.k]
                    runs[c] = self.k if (run == c).all() else int((run != c).argmax())
                by[c].append(**self.work.tuples(own[some], lcp[some]))
        return by, runs

    def names(self) -> np.ndarray:
        """For each minimum a number that orders the strings between minima; equal strings have equal numbers."""
        n, minima, store = self.n, self.minima, self.store
        members, parts, count = Members(minima, n, store, self.work.kind), [], 0

        def pick(c: int, small: Queue, _: Queue) -> None:
            for block in small.read():
                parts.append(store.put(block["pos"][members.has(block["pos"])]))

        self.work.smaller(*self.work.larger(*self.seeds(minima, False)), pick)
        by = _gathered(parts[::-1], len(minima), store, self.work.kind, backwards=True)
        name, last = store.array(len(minima), np.int64), None
        for a, b in _blocks(len(by)):
            own = by[max(a - 1, 0) : b].astype(np.int64)
            number = members.number(own)
            behind = np.where(number + 1 < len(minima), minima[np.minimum(number + 1, len(minima) - 1)], n)
            cap = behind - own + 1
            same = _common(self.words, n, own[:-1], own[1:], max(self.k, int(cap.max())))
            equal = (cap[:-1] == cap[1:]) & (same >= np.minimum(cap[:-1], n - np.maximum(own[:-1], own[1:])))
            # The last string has no minimum behind it and equals no other.
            equal &= (number[:-1] != len(minima) - 1) & (number[1:] != len(minima) - 1)
            steps = np.cumsum(~equal)
            if a == 0:
                name[number] = np.append(0, steps) + 1
                last = 1 + (int(steps[-1]) if len(steps) else 0)
            else:
                name[number[1:]] = last + steps
                last += int(steps[-1])
            count = last
        return self.doubled(name, count)

    def doubled(self, name: np.ndarray, count: int) -> np.ndarray:
        """Names of more and more strings in a row, until they differ or cover k bytes."""
        store, m, step = self.store, len(name), 1
        while step <= self.k // 2 + 1 and count < m:
            key = store.array(m, np.int64)
            for a, b in _blocks(m):
                behind = np.array(name[a + step : b + step])
                key[a:b] = name[a:b] * (m + 1) + np.append(behind, np.zeros(b - a - len(behind), np.int64))
            order, count, was = order_by(key, store), 0, -1
            for a, b in _blocks(m):
                own = order[a:b]
                ranked = key[own]
                steps = np.cumsum(np.append(ranked[0] != was, ranked[1:] != ranked[:-1]))
                name[own] = count + steps
                count, was = count + int(steps[-1]), ranked[-1]
            step *= 2
        return name

    def sort(self) -> None:
        if len(self.minima) > 1:
            order = order_by(self.names(), self.store)
            out = self.store.array(len(order), self.work.kind)
            for a, b in _blocks(len(order)):
                out[a:b] = self.minima[order[a:b]]
            self.minima = out


def repeated(pieces: np.ndarray, k: int, memory: int = 256 << 20) -> np.ndarray:
    """A flag for each byte of pieces (bytes; SEPARATOR ends each piece): a k-byte string that lies within a piece
    starts here, and also at a smaller index."""
    n = len(pieces)
    if n < k:
        return np.zeros(n, bool)
    shard = Shard(pieces, k, memory)
    shard.sort()
    flags = shard.store.array(n, np.bool_)
    state = {"least": -1, "size": 0}

    def close() -> None:
        if state["size"] > 0:
            flags[state["least"]] = False
        state["size"] = 0

    def group(c: int, small: Queue, back: Queue) -> None:
        for queue in (small, back):
            for block in queue.read():
                pos = block["pos"]
                new = block["lcp"] < k
                if new[0]:
                    close()
                starts = np.flatnonzero(new)
                starts = starts if new[0] else np.append(0, starts)
                least = np.minimum.reduceat(pos, starts)
                flags[pos] = True
                if not new[0] and state["size"]:
                    least[0] = min(least[0], state["least"])
                flags[least[:-1]] = False
                state["least"], state["size"] = int(least[-1]), 1
        close()

    shard.work.smaller(*shard.work.larger(*shard.seeds(shard.minima, True)), group)
    # A string of k bytes doesn't reach over the end of its piece.
    for a, b in _blocks(n):
        at = np.flatnonzero(flags[a:b])
        ends = np.append(np.flatnonzero(np.asarray(pieces[a : b + k]) == SEPARATOR), b - a + k)
        nearest = ends[np.searchsorted(ends, at)]
        flags[a + at[(nearest - at < k) | (a + at + k > n)]] = False
    return flags
