"""External induced sorting of a string's suffixes with common-prefix values, for one shard inside a task.

A suffix is of type L if it is larger than the next one, else of type S; an S suffix after an L suffix is a seed. Seeds are sorted by
recursion on the string of their substrings' names, until that string fits in memory. Then all L suffixes follow from seeds in one ascending sweep, and all S suffixes from L
suffixes in a descending one: whoever leaves the queue puts its left neighbour in, if that is of the swept type.

The queue holds tuples (character, position, prefix shared with the tuple before) in sorted runs, first in first out among equal characters. It is
served in blocks: the longest series of tuples into which none of their own neighbours falls. The prefix shared with the tuple before is one
more than the least prefix between the two sources, which block tables and a stack of suffix minima give; the stack holds rising values, so
`cap` bounds it. Strings, types, runs of the queue and results beyond `memory` bytes are in anonymous files in Spark's scratch folder, which vanish
with the task: what is in memory depends on block and cap, not on the shard."""

from __future__ import annotations

import os
import tempfile

import numpy as np

BLOCK = 1 << 16
#: Seeds that are sorted in memory; the recursion goes on beyond.
BASE = 1 << 20


class Scratch:
    """Arrays in memory, or beyond `memory` bytes in anonymous files."""

    def __init__(self, memory: int = 4 << 20) -> None:
        self.memory = memory
        self.folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        if self.folder and not os.path.isdir(self.folder):
            self.folder = None

    def array(self, n: int, kind: type | str, fill: int | None = None) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.memory:
            return np.zeros(n, kind) if fill is None else np.full(n, fill, kind)
        with tempfile.TemporaryFile(dir=self.folder) as f:
            f.truncate(n * np.dtype(kind).itemsize)
            out = np.memmap(f, kind, "r+", shape=(n,))
        if fill is not None:
            for i in range(0, n, 1 << 20):
                out[i : i + (1 << 20)] = fill
        return out

    def kept(self, x: np.ndarray) -> np.ndarray:
        out = self.array(len(x), x.dtype)
        out[:] = x
        return out


class Growing:
    """An array that is appended to; full pieces go to scratch."""

    def __init__(self, scratch: Scratch, kind: type | str) -> None:
        self.scratch, self.kind, self.full, self.parts, self.n, self.waiting = scratch, kind, [], [], 0, 0

    def add(self, x: np.ndarray) -> None:
        self.parts.append(x.astype(self.kind, copy=False))
        self.n += len(x)
        self.waiting += len(x)
        if self.waiting > 1 << 18:
            self.full.append(self.scratch.kept(np.concatenate(self.parts)))
            self.parts, self.waiting = [], 0

    def done(self) -> np.ndarray:
        out, at = self.scratch.array(self.n, self.kind), 0
        for p in [*self.full, *self.parts]:
            out[at : at + len(p)] = p
            at += len(p)
        self.full, self.parts = [], []
        return out


class Queue:
    """Tuples (key, position, shared) in sorted runs, the oldest run first; run 0 holds the seeds, whose keys are odd."""

    def __init__(self, scratch: Scratch, seeds: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.scratch, self.runs, self.size = scratch, [[*seeds, 0]], BLOCK

    def push(self, key: np.ndarray, pos: np.ndarray, shared: np.ndarray) -> None:
        """Tuples sorted by key, newer than all in the queue."""
        run = [key, pos, shared, 0]
        while len(self.runs) > 1 and (n := len(self.runs[-1][0]) - self.runs[-1][3]) <= 2 * len(run[0]):
            k, p, s, at = self.runs.pop()
            if n:
                both = np.concatenate([k[at:], run[0]])
                order = np.argsort(both, kind="stable")
                run = [both[order], np.concatenate([p[at:], run[1]])[order], np.concatenate([s[at:], run[2]])[order], 0]
        if run[0].nbytes * 3 > self.scratch.memory:
            run[:3] = map(self.scratch.kept, run[:3])
        self.runs.append(run)

    def front(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """The first tuples in order, at most `size` from each run: key, position, shared, run."""
        size = self.size
        self.runs = [self.runs[0], *[r for r in self.runs[1:] if r[3] < len(r[0])]]
        live = [(i, r) for i, r in enumerate(self.runs) if r[3] < len(r[0])]
        if not live:
            return None
        least = min(int(r[0][r[3]]) for _, r in live)
        # up to the key at which some run may have more than its part
        limit = min((int(r[0][r[3] + size]) for _, r in live if r[3] + size < len(r[0])), default=None)
        parts = []
        for i, r in live:
            k = np.asarray(r[0][r[3] : r[3] + size])
            n = len(k) if limit is None else int(np.searchsorted(k, limit))
            if limit is not None and limit == least:  # a key with more than that: its oldest run alone
                n = int(np.searchsorted(k, least, "right"))
                if not n:
                    continue
                parts = [(i, r, n)]
                break
            if n:
                parts.append((i, r, n))
        key = np.concatenate([r[0][r[3] : r[3] + n] for _, r, n in parts])
        order = np.argsort(key, kind="stable")
        pos, shared = (np.concatenate([r[c][r[3] : r[3] + n] for _, r, n in parts])[order] for c in (1, 2))
        return key[order], pos, shared, np.repeat([i for i, _, _ in parts], [n for _, _, n in parts])[order]

    def drop(self, run: np.ndarray) -> None:
        for i, n in enumerate(np.bincount(run, minlength=len(self.runs)).tolist()):
            self.runs[i][3] += n
        # about as many as can be served at once: the rest would be read again
        self.size = min(BLOCK, max(64, 2 * len(run)))


class Minima:
    """Least values of ranges that end in the block served now."""

    def __init__(self) -> None:
        self.at, self.value, self.start = np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def block(self, shared: np.ndarray) -> None:
        self.table = [shared]
        while len(self.table[-1]) > (1 << len(self.table) - 1):
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))
        self.prefix = np.minimum.accumulate(shared)

    def between(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        """The least value after a up to b; b is in the block."""
        out = np.empty(len(a), np.int32)
        old = a < self.start
        if old.any():
            i = np.searchsorted(self.at, a[old], "right")
            before = np.append(self.value, none).astype(np.int32)[i]
            out[old] = np.minimum(before, self.prefix[b[old] - self.start])
        if not old.all():
            lo, hi = a[~old] - self.start + 1, b[~old] - self.start
            level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
            got = np.empty(len(lo), np.int32)
            for k in np.unique(level):
                at = level == k
                got[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << int(k)) + 1])
            out[~old] = got
        return out

    def close(self, shared: np.ndarray) -> None:
        rest = np.minimum.accumulate(shared[::-1])[::-1]
        own = np.flatnonzero(shared < np.append(rest[1:], np.iinfo(np.int32).max))
        keep = self.value < rest[0]
        self.at, self.value = np.concatenate([self.at[keep], own + self.start]), np.concatenate([self.value[keep], shared[own]])
        self.start += len(shared)


def _kinds(t: np.ndarray, scratch: Scratch, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type L, and how often its first character repeats (up to cap). Read backwards in pieces."""
    n = len(t)
    larger, run = scratch.array(n, np.bool_), scratch.array(n, np.int32)
    larger[n - 1], run[n - 1] = False, 1
    end = n - 1
    while end > 0:
        begin = max(0, end - (1 << 20))
        x = np.asarray(t[begin : end + 1]).astype(np.int64)
        cut = np.append(np.flatnonzero(x[:-1] != x[1:]), len(x) - 1)  # last places of runs; the last place's suffix is known
        of = np.searchsorted(cut, np.arange(len(x) - 1))
        last = cut[of]
        known = last == len(x) - 1
        far = np.minimum(last + 1, len(x) - 1)
        larger[begin:end] = np.where(known, larger[end], x[:-1] > x[far])
        run[begin:end] = np.minimum(np.where(known, run[end] - 1, 0) + last - np.arange(len(x) - 1) + 1, cap)
        end = begin
    return larger, run


def _sweep(t: np.ndarray, key_of, target: np.ndarray, want: bool, run: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], top: int, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Positions of the swept type in order, and the prefix that each shares with the one before in its bucket (-1: it is the first).

    seeds: positions in the order of the sweep, and what each shares with the one before; key_of: characters that rise in that order, below top."""
    pos, shared = seeds
    key = scratch.array(len(pos), np.int64)
    for i in range(0, len(pos), 1 << 20):
        key[i : i + (1 << 20)] = 2 * key_of(t[np.asarray(pos[i : i + (1 << 20)])]) + 1
    queue, minima, last = Queue(scratch, (key, pos, shared)), Minima(), scratch.array(top, np.int64, -1)
    out, out_shared = Growing(scratch, np.int64), Growing(scratch, np.int32)
    before_key, before_pos, none = -1, 0, cap + 1
    while (got := queue.front()) is not None:
        key, pos, shared, source = got
        left = pos - 1
        ok = left >= 0
        ok[ok] = target[left[ok]] == want
        to = np.where(ok, 2 * key_of(t[np.maximum(left, 0)]), np.iinfo(np.int64).max)
        least = np.minimum.accumulate(to)
        late = np.flatnonzero(key[1:] > least[:-1])
        n = int(late[0]) + 1 if len(late) else len(key)
        key, pos, shared, ok, to, left = key[:n], pos[:n], shared[:n], ok[:n], to[:n], left[:n]
        queue.drop(source[:n])
        swept = key % 2 == 0
        out.add(pos[swept])
        # what each shares with the one before: known in a bucket, equal characters at the seam of the types, else nothing
        prev_key, prev_pos = np.concatenate([[before_key], key[:-1]]), np.concatenate([[before_pos], pos[:-1]])
        seam = ~swept & (prev_key == key - 1)
        share = np.where(prev_key == key, np.maximum(shared, 0), 0).astype(np.int32)
        if seam.any():
            share[seam] = np.minimum(run[prev_pos[seam]], run[pos[seam]])
        share = np.minimum(share, cap)
        out_shared.add(np.where(prev_key == key, share, -1)[swept])
        before_key, before_pos = int(key[-1]), int(pos[-1])
        minima.block(share)
        if ok.any():
            at = np.flatnonzero(ok)
            at = at[np.argsort(to[at], kind="stable")]
            k, c = to[at], to[at] // 2
            here = at + minima.start
            ends = np.append(c[1:] != c[:-1], True)
            earlier = last[c]
            earlier[1:][~ends[:-1]] = here[:-1][~ends[:-1]]
            common = np.full(len(at), -1, np.int32)
            known = earlier >= 0
            common[known] = np.minimum(minima.between(earlier[known], here[known], none) + 1, cap)
            last[c[ends]] = here[ends]
            queue.push(k, left[at], common)
        minima.close(share)
    return out.done(), out_shared.done()


def _both(t: np.ndarray, larger: np.ndarray, run: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], top: int, cap: int, scratch: Scratch):  # noqa: ANN202
    """L suffixes ascending and S suffixes descending, each with shared prefixes."""
    up = _sweep(t, lambda c: c.astype(np.int64), larger, True, run, seeds, top, cap, scratch)
    pos, shared = up
    back = scratch.array(len(pos), np.int64), scratch.array(len(pos), np.int32)
    back[0][:], back[1][:1] = pos[::-1], -1
    back[1][1:] = shared[:0:-1]
    down = _sweep(t, lambda c: top - 1 - c.astype(np.int64), larger, False, run, back, top, cap, scratch)
    return up, down


def _agree(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many characters from a and from b agree, up to most."""
    same = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        step = np.minimum(most[live] - same[live], 16)
        i = np.arange(16)
        far = len(t) - 1
        eq = (t[np.minimum(a[live, None] + same[live, None] + i, far)] == t[np.minimum(b[live, None] + same[live, None] + i, far)]) & (i < step[:, None])
        n = np.where(eq.all(axis=1), 16, eq.argmin(axis=1))
        same[live] += n
        live = live[(n == 16) & (same[live] < most[live])]
    return same


def _named(t: np.ndarray, larger: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds in the order of their substrings, and names that rise where substrings differ: in memory, by some characters at a time.

    A character counts with its type, so no substring is the beginning of another one."""
    size = np.append(np.diff(seeds) + 1, 1)
    bits = int(2 * int(t.max()) + 2).bit_length()
    at_once = max(1, 62 // bits)
    name, live, done = np.zeros(len(seeds), np.int64), np.arange(len(seeds)), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for i in range(done, done + at_once):
            p = np.minimum(seeds[live] + i, len(t) - 1)
            key = (key << bits) | np.where(i < size[live], 2 * t[p].astype(np.int64) + ~larger[p] + 1, 0)
        order = np.lexsort((key, name[live]))
        group, key = name[live][order], key[order]
        new = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        # a name is the place of the first seed that has it
        begins = np.append(True, group[1:] != group[:-1])
        place = np.arange(len(live)) - np.maximum.accumulate(np.where(begins, np.arange(len(live)), 0)) + group
        name[live[order]] = np.maximum.accumulate(np.where(new, place, 0))
        done += at_once
        alone = new & np.append(new[1:], True)
        live = live[order][~alone]
        # groups are dropped whole once they end: equal characters and types mean equal lengths
        live = live[size[live] > done]
    order = np.argsort(name, kind="stable")
    name = name[order]
    return seeds[order], np.cumsum(np.append(0, name[1:] != name[:-1]))


def _induced_names(t: np.ndarray, larger: np.ndarray, run: np.ndarray, seeds: np.ndarray, top: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The same for more seeds than fit in memory: seeds by character alone give seeds by their substrings."""
    first = scratch.kept(seeds[np.argsort(t[seeds], kind="stable")])
    _, (s, _) = _both(t, larger, run, (first, scratch.array(len(first), np.int32)), top, 0, scratch)
    by = Growing(scratch, np.int64)
    by.add(seeds[-1:])
    for end in range(len(s), 0, -(1 << 20)):
        p = np.asarray(s[max(0, end - (1 << 20)) : end])[::-1]
        p = p[p > 0]
        by.add(p[larger[p - 1]])
    by = by.done()
    rank = np.searchsorted(seeds, by)
    size = np.append(np.diff(seeds) + 1, 1)
    name = scratch.array(len(by), np.int64)
    for i in range(1, len(by), BLOCK):
        a, b = rank[i - 1 : min(i - 1 + BLOCK, len(by) - 1)], rank[i : i + BLOCK]
        same = size[a] == size[b]
        same[same] = _agree(t, seeds[a[same]], seeds[b[same]], size[a[same]]) == size[a[same]]
        name[i : i + BLOCK] = ~same
    np.cumsum(name, out=name)
    return by, name


def _in_memory(t: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the recursion ends: suffixes of a string that fits in memory by their first cap characters, by doubling, and what neighbours share."""
    n, rank, size = len(t), np.asarray(t), 1
    steps = [rank]
    while size < cap and (top := int(rank.max()) + 1) < n:
        key = rank * (top + 1) + np.append(rank[size:] + 1, np.zeros(min(size, n), np.int64))
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        steps.append(rank)
        size *= 2
    order = np.argsort(rank, kind="stable")
    a, b, same = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(steps) - 1, -1, -1):
        x, y = a + same, b + same
        ok = np.maximum(x, y) < n
        ok[ok] = steps[k][x[ok]] == steps[k][y[ok]]
        same += ok * (1 << k)
    return order, np.append(0, np.minimum(same, cap))


def sorted_suffixes(t: np.ndarray, top: int, cap: int, scratch: Scratch):  # noqa: ANN201
    """L suffixes ascending and S suffixes descending, as (positions, shared) each; shared is -1 at the first of a character, and up to cap.

    t: characters below top whose last one is 0 and nowhere else. The last suffix is in neither list."""
    larger, run = _kinds(t, scratch, cap)
    found = Growing(scratch, np.int64)
    for i in range(1, len(t), 1 << 20):
        found.add(np.flatnonzero(~larger[i : i + (1 << 20)] & larger[i - 1 : min(i - 1 + (1 << 20), len(t) - 1)]) + i)
    seeds = found.done()
    if not len(seeds):
        seeds = np.array([len(t) - 1], np.int64)
    if len(seeds) <= BASE:
        by, name = _named(t, larger, seeds)
    else:
        by, name = _induced_names(t, larger, run, seeds, top, scratch)
    rank = np.searchsorted(seeds, by)
    names = int(name[-1]) + 1
    shorter = scratch.array(len(by), np.int64)
    shorter[rank] = name
    if names == len(by):
        place, alike = rank, np.zeros(len(by), np.int64)
    elif len(by) <= BASE:
        place, alike = _in_memory(shorter, cap)
    else:
        (lp, ls), (sp, ss) = sorted_suffixes(shorter, names, cap, scratch)
        place, alike = _interleaved(shorter, lp, ls, sp, ss, cap)
    # shared characters of neighbours: equal names, then what the first different substrings have in common
    sorted_seeds, shared = scratch.kept(seeds[place]), scratch.array(len(place), np.int32)
    for i in range(1, len(place), BLOCK):
        a, b = place[i - 1 : min(i - 1 + BLOCK, len(place) - 1)], place[i : i + BLOCK]
        k = alike[i : i + BLOCK]
        far = np.minimum(seeds[np.minimum(a + k, len(seeds) - 1)] - seeds[a], cap)
        shared[i : i + BLOCK] = far + _agree(t, seeds[a] + far, seeds[b] + far, cap - far)
    return _both(t, larger, run, (sorted_seeds, shared), top, cap, scratch)


def _interleaved(t: np.ndarray, lp: np.ndarray, ls: np.ndarray, sp: np.ndarray, ss: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes ascending with shared prefixes: the last one, then by character L before S."""
    # descending, an element shares with the next larger one; ascending, with the next smaller one
    s, share = np.asarray(sp)[::-1], np.append(np.full(min(1, len(ss)), -1), np.asarray(ss)[:0:-1])
    pos = np.concatenate([[len(t) - 1], lp, s]).astype(np.int64)
    got = np.concatenate([[0], ls, share])
    key = 2 * t[pos].astype(np.int64) + np.concatenate([[0], np.zeros(len(lp), np.int64), np.ones(len(s), np.int64)])
    order = np.argsort(key, kind="stable")
    pos, got, key = pos[order], got[order].astype(np.int64), key[order]
    out = np.where(np.r_[False, key[1:] == key[:-1]], got, 0)
    seam = np.flatnonzero((key[1:] % 2 == 1) & (key[:-1] == key[1:] - 1)) + 1
    if len(seam):
        out[seam] = _agree(t, pos[seam - 1], pos[seam], np.full(len(seam), cap))
    return pos, np.minimum(out, cap)


def repeated(parts: list[np.ndarray] | np.ndarray, length: int, scratch: Scratch | None = None) -> np.ndarray:
    """Whether the string of `length` characters at each place occurs at another place too. parts: bytes plus 2; 1 ends a part, a last 0 ends all."""
    scratch, t = scratch or Scratch(), parts
    twice = scratch.array(len(t), np.bool_)
    lists = sorted_suffixes(t, 258, length, scratch)
    heads = []
    for pos, shared in lists:
        for i in range(0, len(pos), 1 << 20):
            some = np.flatnonzero(shared[i : i + (1 << 20)] >= length) + i
            twice[pos[some]] = True
            twice[pos[some - 1]] = True
        heads.append(pos)
    # the seam of a character: its largest L suffix and its smallest S suffix
    ups, downs = heads
    ends = {int(t[p]): int(p) for i in range(0, len(ups), 1 << 20) for p in np.asarray(ups[i : i + (1 << 20)])[np.flatnonzero(np.diff(t[ups[i : i + (1 << 20)]], append=-1))]}
    for i in range(0, len(downs), 1 << 20):
        some = np.asarray(downs[i : i + (1 << 20)])
        for p in some[np.flatnonzero(np.diff(t[some], append=-1))].tolist():
            ends_here = int(t[p])
            if ends_here in ends:
                a, b = np.array([ends[ends_here]]), np.array([p])
                if _agree(t, a, b, np.array([length]))[0] >= length:
                    twice[[ends[ends_here], p]] = True
    return twice
