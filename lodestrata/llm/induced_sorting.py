"""External induced sorting of the suffixes of a shard of byte strings, with their common prefixes.

A suffix travels as a tuple (position, bytes shared with the tuple before it) through priority queues keyed by symbol.
Keys leave a queue in rising (L phase) or falling order (S phase) and what was put in at one key leaves in that order,
so each key has its own region of the queue, which lies in a file where the whole is larger than a bound. All keys that
do not feed one another are induced at once with array operations. The string of names of the seeds (the leftmost S
suffixes) is sorted by the same function, recursively, until all names differ; the shared prefix of an induced tuple is
one more than the least that was carried past since the last tuple of its key.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of tuples that one queue holds in memory.
QUEUE_BYTES = 64 << 20
#: Larger than any common prefix.
_ALL = np.int32(2**31 - 1)


def heads(keys: np.ndarray) -> np.ndarray:
    """True where a key differs from the one before."""
    out = np.empty(len(keys), bool)
    out[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=out[1:])
    return out


class TupleQueue:
    """A priority queue of (position, common prefix) with a region per key, on disk when it is larger than a bound."""

    def __init__(self, sizes: np.ndarray, limit: int | None = None):
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.end = self.first[:-1].copy()
        n = int(self.first[-1])
        if 8 * n > (QUEUE_BYTES if limit is None else limit):
            self.file = tempfile.TemporaryFile()
            self.tuples = np.memmap(self.file, np.int32, "w+", shape=(2, n))
        else:
            self.tuples = np.empty((2, n), np.int32)

    def push(self, positions: np.ndarray, shared: np.ndarray, keys: np.ndarray) -> None:
        """Appends tuples, which are in order of their keys, to the regions of these."""
        place = np.arange(len(keys))
        head = heads(keys).nonzero()[0]
        count = np.empty(len(head), np.int64)
        count[:-1] = head[1:] - head[:-1]
        count[-1] = len(keys) - head[-1]
        own = keys[head]
        end = self.end[own]
        place += (end - head).repeat(count)
        self.tuples[0, place] = positions
        self.tuples[1, place] = shared
        self.end[own] = end + count

    def take(self, low: int, high: int):
        """Tuples of keys low to high - 1, whose regions are full, and their keys."""
        a, b = self.first[low], self.first[high]
        keys = np.arange(low, high, dtype=np.int32).repeat(self.first[low + 1 : high + 1] - self.first[low:high])
        return np.array(self.tuples[0, a:b]), np.array(self.tuples[1, a:b]), keys

    def since(self, key: int, done: int):
        """Tuples of a key from the done-th on, as far as they have come."""
        a, b = self.first[key] + done, self.end[key]
        return np.array(self.tuples[0, a:b]), np.array(self.tuples[1, a:b])


class Least:
    """Least values of ranges [low, high) of an array, by tables of powers of two."""

    def __init__(self, values: np.ndarray, longest: int):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= longest:
            last, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.empty(len(low), np.int32)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in range(len(self.rows)):
            at = (level == k).nonzero()[0]
            out[at] = np.minimum(self.rows[k][low[at]], self.rows[k][high[at] - (1 << k)])
        return out


class Inducer:
    """Puts the tuples before those that pass by into a queue, with the prefixes they share."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: TupleQueue, size: int, ends: int):
        self.text, self.wanted, self.queue, self.ends = text, wanted, queue, ends
        self.past = np.zeros(size, np.int32)
        self.touched = np.zeros(0, np.int64)

    def enter(self) -> None:
        """What comes next has another first symbol than what came before."""
        self.past[self.touched] = 0
        self.touched = self.touched[:0]

    def before(self, run: np.ndarray):
        """Where in a run the suffix one longer is wanted, that suffix, and its key."""
        longer = run - 1
        # what comes before the first suffix is not wanted
        at = (self.wanted[longer] & (run > 0)).nonzero()[0]
        longer = longer[at]
        return at, longer, self.text[longer]

    def feed(self, run: np.ndarray, shared: np.ndarray, more: bool = False, known=None) -> None:
        """Lets a run pass by; more says that others of the same first symbol follow."""
        at, longer, keys = self.before(run) if known is None else known
        if len(at):
            # numpy sorts 16-bit numbers by counting
            order = (keys.astype(np.int16) if len(self.past) < 1 << 15 else keys).argsort(kind="stable")
            at, longer, keys = at[order], longer[order], keys[order]
            new = heads(keys)
            first = new.nonzero()[0]
            value = np.zeros(len(at), np.int32)
            if shared[0]:
                value[first] = np.minimum(np.minimum.accumulate(shared)[at[first]], self.past[keys[first]])
            again = (~new).nonzero()[0]
            if len(again):
                low, high = at[again - 1] + 1, at[again] + 1
                value[again] = Least(shared, int((high - low).max()))(low, high)
            value += 1
            own = keys[first]
            value[first[self.queue.end[own] == self.queue.first[own]]] = 0
            if keys[0] == 0:
                value[: keys.searchsorted(0, "right")] = self.ends
            self.queue.push(longer, value, keys)
        if more and len(run):
            self.past[self.touched] = np.minimum(self.past[self.touched], shared.min())
            if len(at):
                last = np.append(first[1:], len(at)) - 1
                rest = np.append(np.minimum.accumulate(shared[::-1])[::-1], _ALL)
                self.past[own] = rest[at[last] + 1]
                self.touched = np.union1d(self.touched, own)


def small_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S); the last one is, and one that begins with 0, whatever
    follows, so that no comparison goes on behind a 0."""
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    up = np.append(text[:-1] < text[1:], True)
    at = np.where(differs, np.arange(n), n)
    small = up[np.minimum.accumulate(at[::-1])[::-1]]
    small[text == 0] = True
    return small


def run_lengths(text: np.ndarray) -> np.ndarray:
    """How many equal symbols begin at each place; a 0 stands alone."""
    n = len(text)
    last = np.where(np.append(text[1:] != text[:-1], True), np.arange(n), n)
    length = np.minimum.accumulate(last[::-1])[::-1] - np.arange(n) + 1
    length[text == 0] = 1
    return length


def induce(text: np.ndarray, same: np.ndarray, small: np.ndarray, seeds: np.ndarray, shared: np.ndarray, naming: bool):
    """All suffixes in order and the symbols that each shares with the one before.

    Seeds (the leftmost S suffixes) come with what they share. If they are in order, so are the suffixes, up to their
    0, which shares nothing. For naming, seeds are in order of their first run of equal symbols only (a longer one is
    smaller) and count as this run; suffixes are then in order of their strings up to and with the next seed's run.
    """
    n, size = len(text), int(text.max()) + 1
    keys = text[seeds]
    seed_first = np.searchsorted(keys, np.arange(size + 1))
    tops = TupleQueue(np.bincount(text[~small], minlength=size))
    lows = TupleQueue(np.bincount(text[small], minlength=size))
    rising = Inducer(text, ~small, tops, size, 0)
    falling = Inducer(text, small, lows, size, int(naming))

    def seeded(low: int, high: int):
        a, b = seed_first[low], seed_first[high]
        return seeds[a:b], shared[a:b].copy(), keys[a:b]

    def joined(low: int, high: int):
        """L suffixes of each key and then its seeds."""
        pos, lcp, key = tops.take(low, high)
        seed, more, its = seeded(low, high)
        if not len(seed) or not len(pos):
            return (seed, more, its) if len(seed) else (pos, lcp, key)
        both = np.concatenate([key * 2, its * 2 + 1])
        order = np.argsort(both, kind="stable")
        both = both[order]
        pos, lcp = np.concatenate([pos, seed])[order], np.concatenate([lcp, more])[order]
        meet = np.flatnonzero((both[1:] & 1 == 1) & (both[:-1] + 1 == both[1:])) + 1
        lcp[meet] = np.minimum(same[pos[meet - 1]], same[pos[meet]])
        return pos, lcp, both >> 1

    c, width = 0, 64
    while c < size:
        d = min(size, c + width)
        full = np.flatnonzero(tops.end[c:d] < tops.first[c + 1 : d + 1])
        stop = c + int(full[0]) if len(full) else d
        known = None
        if stop > c:
            pos, lcp, key = joined(c, stop)
            known = rising.before(pos)
            nearest = int(known[2].min(initial=size))
            if nearest < stop:
                stop, n_kept = nearest, int(key.searchsorted(nearest))
                pos, lcp = pos[:n_kept], lcp[:n_kept]
                k = int(known[0].searchsorted(n_kept))
                known = known[0][:k], known[1][:k], known[2][:k]
        if stop > c:
            rising.feed(pos, lcp, known=known)
            width = min(1 << 16, width * 2) if stop == d else max(8, width // 2)
            c = stop
            continue
        done, last = 0, -1
        while True:
            pos, lcp = tops.since(c, done)
            if not len(pos):
                break
            rising.feed(pos, lcp, more=True)
            done, last = done + len(pos), pos[-1]
        pos, lcp, _ = seeded(c, c + 1)
        if len(pos) and last >= 0:
            lcp[0] = min(same[last], same[pos[0]])
        rising.feed(pos, lcp)
        rising.enter()
        c += 1

    # falling: what a tuple of a queue shares is with the one after it in order
    lows.push(np.array([n - 1], np.int32), np.array([0], np.int32), text[n - 1 :])

    def turned(pos, lcp, key):
        """L suffixes of rising keys, as they pass by in falling order."""
        follow = np.zeros_like(lcp)
        follow[:-1] = lcp[1:]
        follow[:-1][key[1:] != key[:-1]] = 0
        return pos[::-1], follow[::-1]

    def fallen(low: int, high: int):
        """S suffixes of each key and then its L suffixes, keys falling."""
        s_pos, s_lcp, s_key = lows.take(low, high)
        l_pos, l_lcp, l_key = tops.take(low, high)
        if len(l_pos):
            l_pos, l_lcp = turned(l_pos, l_lcp, l_key)
            l_key = l_key[::-1]
        both = np.concatenate([-2 * s_key, -2 * l_key + 1])
        order = np.argsort(both, kind="stable")
        both = both[order]
        pos, lcp = np.concatenate([s_pos, l_pos])[order], np.concatenate([s_lcp, l_lcp])[order]
        meet = np.flatnonzero((both[1:] & 1 == 1) & (both[:-1] + 1 == both[1:])) + 1
        lcp[meet] = np.minimum(same[pos[meet - 1]], same[pos[meet]])
        return pos, lcp, (1 - both) >> 1

    d, width = size, 64
    while d > 0:
        c = max(0, d - width)
        full = np.flatnonzero(lows.end[c:d] < lows.first[c + 1 : d + 1])
        stop = c + int(full[-1]) + 1 if len(full) else c
        known = None
        if stop < d:
            pos, lcp, key = fallen(stop, d)
            known = falling.before(pos)
            nearest = int(known[2].max(initial=-1))
            if nearest >= stop:
                stop, n_kept = nearest + 1, int((-key).searchsorted(-nearest))
                pos, lcp = pos[:n_kept], lcp[:n_kept]
                k = int(known[0].searchsorted(n_kept))
                known = known[0][:k], known[1][:k], known[2][:k]
        if stop < d:
            falling.feed(pos, lcp, known=known)
            width = min(1 << 16, width * 2) if stop == c else max(8, width // 2)
            d = stop
            continue
        d -= 1
        done, last = 0, -1
        while True:
            pos, lcp = lows.since(d, done)
            if not len(pos):
                break
            falling.feed(pos, lcp, more=True)
            done, last = done + len(pos), pos[-1]
        pos, lcp, key = tops.take(d, d + 1)
        if len(pos):
            pos, lcp = turned(pos, lcp, key)
            lcp = lcp.copy()
            if last >= 0:
                lcp[0] = min(same[last], same[pos[0]])
        falling.feed(pos, lcp)
        falling.enter()

    pos, lcp, key = fallen(0, size)
    pos = pos[::-1]
    lcp = np.append(np.int32(0), lcp[::-1][:-1])
    key = key[::-1]
    lcp[np.append(True, key[1:] != key[:-1])] = 0
    return pos, lcp


def suffix_order(text: np.ndarray):
    """Positions in order of their suffixes up to the next 0, and the symbols each shares with the one before; text
    holds numbers from 0 on and ends with 0.

    Suffixes that are equal up to their 0 follow one another in no particular order; a 0 shares nothing.
    """
    text = text.astype(np.int32, copy=False)
    n = len(text)
    small = small_types(text)
    left = small.copy()
    left[1:] &= ~small[:-1]
    left[0] = False
    left[text == 0] = True
    seeds = np.flatnonzero(left).astype(np.int32)
    same = run_lengths(text)
    by = seeds[((text[seeds].astype(np.int64) << 32) - same[seeds]).argsort(kind="stable")]
    shared = np.append(0, np.where(text[by[1:]] == text[by[:-1]], same[by[1:]], 0)).astype(np.int32)
    order, lcp = induce(text, same, small, by, shared, True)
    at = np.flatnonzero(left[order])
    by = order[at]
    shared = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))
    number = np.empty(n, np.int32)
    number[seeds] = np.arange(len(seeds))
    to = np.append(seeds[1:], n - 1)[number[by]]
    whole = to - by + same[to]
    new = np.append(False, (shared[1:] != whole[1:]) | (shared[1:] != whole[:-1]))
    ends = text[by] == 0
    new[ends] = False
    shared[ends] = 0
    name = np.cumsum(new)
    if name[-1] < len(by) - ends.sum():
        names = np.empty(len(seeds), np.int32)
        names[number[by]] = name
        inner, span = suffix_order(names)
        one, other = np.append(0, inner[:-1]) + span, inner + span
        one[0] = other[0]
        less, more = names[one], names[other]
        apart = less < more
        least = np.zeros(len(inner), np.int32)
        gaps = np.append(np.int32(0), shared[new])
        least[apart] = Least(gaps, int((more - less).max(initial=1)))(less[apart] + 1, more[apart] + 1)
        by = seeds[inner]
        shared = seeds[other] - by + least
    return induce(text, same, small, by, shared.astype(np.int32), False)


def repeated_strings(strings: list[bytes], owners: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(string, from, to): the bytes of each string that are covered by a piece of `length` bytes which also occurs in
    one of these strings with a smaller owner. Maximal runs of starts, each as one entry."""
    if not strings:
        return []
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int(sizes.sum()) + len(strings), np.int32)
    raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    text[:] = raw
    text += 1
    text[starts + sizes] = 0
    order, shared = suffix_order(text)
    owner = np.repeat(owners, sizes + 1)[order]
    # suffixes too short share too little with either neighbour, so that each is a group by itself
    head = np.flatnonzero(np.append(True, shared[1:] < length))
    least = np.minimum.reduceat(owner, head)
    gone = owner > np.repeat(least, np.diff(np.append(head, len(order))))
    at = np.sort(order[gone])
    if not len(at):
        return []
    of = np.searchsorted(starts, at, "right") - 1
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(of) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.append(cut, len(at)) - 1
    return list(zip(of[first].tolist(), (at[first] - starts[of[first]]).tolist(), (at[last] - starts[of[last]] + length).tolist(), strict=True))
