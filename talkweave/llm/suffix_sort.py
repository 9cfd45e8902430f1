"""Suffix order and common prefixes by external induced sorting.

Tuples of a suffix and its common prefix with the one before wait in queues by their first
character. Queues are emptied in order of the character; what a suffix induces, the
suffix one place to its left, goes to the end of its own character's queue, which keeps
every queue sorted. What doesn't fit the memory allowed is on disk: queues lie in a file for
each range of characters, which is read back in parts; sorted tuples follow each other
in a log; arrays over the text are mapped files that are passed in blocks. Names of
substrings are sorted in the same way, however many they are, once they don't fit. A shard of the
query holds many times the tuples that are allowed in memory, so its queues and logs are files.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Tuples in memory for each set of queues, log or block of an array, and names that are sorted in memory.
MOST, NAMES = 1 << 17, 1 << 22

_TUPLE = np.dtype([("at", "<i8"), ("lcp", "<i4")])
_KEYED = np.dtype([("c", "<i8"), ("at", "<i8"), ("lcp", "<i4")])


class Queues:
    """First-in, first-out queues of (suffix, common prefix) by character, taken in order of the character.

    counts: how many tuples each character can get. Characters are put in ranges of at most ``most``
    tuples, or of one character. The range that is being emptied is in memory, or is read in parts if it is one
    character; all others together hold at most ``most`` tuples in memory, and files beyond.
    """

    def __init__(self, folder: str, name: str, counts: np.ndarray, most: int):
        self.folder, self.name, self.most = folder, name, most
        total, of, k, held = counts.tolist(), np.zeros(len(counts), "i8"), 0, 0
        for c, n in enumerate(total):
            if c and held + n > most:
                k, held = k + 1, 0
            held += n
            of[c] = k
        self.of, self.size = of, np.bincount(of, counts)
        self.waiting: dict[int, list[np.ndarray]] = {}
        self.held, self.current, self.open = 0, -1, {}
        self.read: dict[int, int] = {}

    def _file(self, k: int) -> str:
        return os.path.join(self.folder, f"{self.name}-{k}")

    def push(self, c: int, at: np.ndarray, lcp) -> None:
        k = int(self.of[c])
        if k == self.current and self.size[k] <= self.most:
            x = np.empty(len(at), _TUPLE)
            x["at"], x["lcp"] = at, lcp
            self.open.setdefault(c, []).append(x)
            return
        x = np.empty(len(at), _KEYED)
        x["c"], x["at"], x["lcp"] = c, at, lcp
        self.waiting.setdefault(k, []).append(x)
        self.held += len(x)
        if self.held > self.most:
            for k, parts in self.waiting.items():
                with open(self._file(k), "ab") as f:
                    for p in parts:
                        p.tofile(f)
            self.waiting, self.held = {}, 0

    def _part(self, k: int, n: int) -> np.ndarray:
        """The next ``n`` tuples of a range's file, and when these are all taken, those that wait in memory."""
        x = np.empty(0, _KEYED)
        if os.path.exists(self._file(k)):
            x = np.fromfile(self._file(k), _KEYED, n, offset=self.read.get(k, 0))
            self.read[k] = self.read.get(k, 0) + len(x) * _KEYED.itemsize
        if len(x) < n:
            parts = self.waiting.pop(k, [])
            self.held -= sum(map(len, parts))
            x = np.concatenate([x, *parts])
        return x

    def pop(self, c: int) -> np.ndarray:
        """The next tuples of a character; none at the end."""
        k = int(self.of[c])
        if self.size[k] > self.most:
            return self._part(k, self.most)
        if k != self.current:
            self.current, self.open = k, {}
            x = self._part(k, int(self.size[k]) + 1)
            order = np.argsort(x["c"], kind="stable")
            x = x[order]
            edges = np.flatnonzero(np.concatenate([[True], x["c"][1:] != x["c"][:-1]])) if len(x) else []
            for a, z in zip(edges, [*edges[1:], len(x)]):
                self.open[int(x["c"][a])] = [x[a:z]]
        parts = self.open.pop(c, [])
        return parts[0] if len(parts) == 1 else np.concatenate([p[["at", "lcp"]] for p in parts]) if parts else np.empty(0, _TUPLE)


class Log:
    """Tuples in the order in which they come, of one character after another, to be read forward or backward by character."""

    def __init__(self, folder: str, name: str, sigma: int, most: int):
        self.path, self.most = os.path.join(folder, name), most
        self.start, self.count = np.zeros(sigma, "i8"), np.zeros(sigma, "i8")
        self.memory: list[np.ndarray] = []
        self.flushed = self.total = 0
        self.whole: np.ndarray | None = None

    def append(self, c: int, at: np.ndarray, lcp: np.ndarray) -> None:
        x = np.empty(len(at), _TUPLE)
        x["at"], x["lcp"] = at, lcp
        if not self.count[c]:
            self.start[c] = self.total
        self.count[c] += len(x)
        self.total += len(x)
        self.memory.append(x)
        if self.total - self.flushed > self.most:
            self._flush()

    def _flush(self) -> None:
        with open(self.path, "ab") as f:
            for p in self.memory:
                p.tofile(f)
        self.memory, self.flushed = [], self.total

    def _read(self, a: int, z: int) -> np.ndarray:
        if self.flushed:
            if self.memory:
                self._flush()
            return np.fromfile(self.path, _TUPLE, z - a, offset=a * _TUPLE.itemsize)
        if self.memory:
            self.whole = np.concatenate([*([self.whole] if self.whole is not None else []), *self.memory])
            self.memory = []
        return self.whole[a:z]

    def forward(self, c: int):
        a, z = int(self.start[c]), int(self.start[c] + self.count[c])
        for k in range(a, z, self.most):
            yield self._read(k, min(z, k + self.most))

    def backward(self, c: int):
        """(suffixes, common prefixes with the one before in this order); of the first one, 0."""
        a, z, after = int(self.start[c]), int(self.start[c] + self.count[c]), 0
        for k in range(z, a, -self.most):
            x = self._read(max(a, k - self.most), k)
            yield x["at"][::-1], np.append(np.int32(after), x["lcp"][:0:-1])
            after = x["lcp"][0]


def _array(folder: str, name: str, n: int, kind: str, most: int) -> np.ndarray:
    """An array in a mapped file if it has more than ``most`` items."""
    return np.memmap(os.path.join(folder, name), kind, "w+", shape=(n,)) if n > most else np.zeros(n, kind)


def _blocks(n: int, most: int):
    return ((a, min(n, a + most)) for a in range(0, n, most))


class _Ranges:
    """Minima over ranges of an array."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= len(x):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def over(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Of x[a:z] for each pair; none is empty."""
        out = np.empty(len(a), self.levels[0].dtype)
        level = np.frexp((z - a).astype("f8"))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][z[at] - (1 << int(k))])
        return out


class _Scan:
    """One scan: takes sorted batches of suffixes, and queues those they induce."""

    def __init__(self, t, wanted, queues: Queues, cap: int, sigma: int):
        self.t, self.wanted, self.queues, self.cap = t, wanted, queues, cap
        self.least = np.zeros(sigma, "i4")  # the smallest common prefix since a queue's last entry
        self.used = np.zeros(sigma, bool)

    def batch(self, at: np.ndarray, lcp: np.ndarray) -> None:
        from_ = np.flatnonzero(at > 0)
        from_ = from_[self.wanted(at[from_] - 1)]
        if len(from_):
            c = self.t[at[from_] - 1]
            order = np.argsort(c, kind="stable")
            from_, c = from_[order], c[order]
            new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            ends = np.append(new[1:], len(c))
            if not self.cap:  # an order without common prefixes
                for x, a, z in zip(c[new].tolist(), new.tolist(), ends.tolist()):
                    self.queues.push(x, at[from_[a:z]] - 1, 0)
                return
            low = np.empty(len(c), "i4")
            again = np.ones(len(c), bool)
            again[new] = False
            k = np.flatnonzero(again)
            if len(k):
                low[k] = _Ranges(lcp).over(from_[k - 1] + 1, from_[k] + 1)
            first = c[new].astype("i8")
            low[new] = np.minimum(np.minimum.accumulate(lcp)[from_[new]], self.least[first])
            got = np.minimum(low + 1, self.cap)
            got[new[~self.used[first]]] = 0
            self.used[first] = True
            for x, a, z in zip(first.tolist(), new.tolist(), ends.tolist()):
                self.queues.push(x, at[from_[a:z]] - 1, got[a:z])
            np.minimum(self.least, lcp.min(), out=self.least)
            tail = np.minimum.accumulate(lcp[::-1])[::-1]
            last = from_[ends - 1]
            self.least[first] = np.where(last + 1 < len(lcp), tail[np.minimum(last + 1, len(lcp) - 1)], self.cap)
        elif len(lcp):
            np.minimum(self.least, lcp.min(), out=self.least)


class Seeds:
    """Left-most S suffixes by first character; ``at`` is in the order of these, ``starts`` says where each one's begin."""

    def __init__(self, at: np.ndarray, lcp: np.ndarray | None, starts: np.ndarray):
        self.at, self.lcp, self.starts = at, lcp, starts

    def of(self, c: int, most: int):
        for a in range(int(self.starts[c]), int(self.starts[c + 1]), most):
            z = min(a + most, int(self.starts[c + 1]))
            yield np.array(self.at[a:z]), np.zeros(z - a, "i4") if self.lcp is None else np.array(self.lcp[a:z])


def _seam(t, run, a: int, b: int, cap: int) -> int:
    """Common prefix of suffixes a and b of different types: as far as the shorter run of their first character, if that is the same."""
    return min(int(run[a]), int(run[b]), cap) if t[a] == t[b] else 0


def induce(t, is_s, run, seeds: Seeds, sizes: tuple[np.ndarray, np.ndarray], cap: int, folder: str, most: int):
    """Yields (suffixes, common prefixes) in order, from sorted left-most S suffixes; sizes: how many L and S suffixes each character begins."""
    sigma = len(sizes[0])
    os.makedirs(folder)
    queue, done = Queues(folder, "l", sizes[0], most), Log(folder, "l-done", sigma, most)
    scan, last = _Scan(t, lambda p: ~is_s[p], queue, cap, sigma), None
    for c in range(sigma):
        while len(x := queue.pop(c)):
            done.append(c, x["at"], x["lcp"])
            scan.batch(x["at"], x["lcp"])
            last = int(x["at"][-1])
        for k, (at, lcp) in enumerate(seeds.of(c, most)):
            if not k:
                lcp[0] = _seam(t, run, last, int(at[0]), cap) if last is not None else 0
            scan.batch(at, lcp)
            last = int(at[-1])
    queue, out = Queues(folder, "s", sizes[1], most), Log(folder, "s-done", sigma, most)
    scan, last = _Scan(t, lambda p: is_s[p], queue, cap, sigma), None
    for c in range(sigma - 1, -1, -1):
        # downward: each common prefix is with the next larger suffix
        while len(x := queue.pop(c)):
            out.append(c, x["at"], x["lcp"])
            scan.batch(x["at"], x["lcp"])
            last = int(x["at"][-1])
        for k, (at, lcp) in enumerate(done.backward(c)):
            if not k:
                lcp[0] = _seam(t, run, last, int(at[0]), cap) if last is not None else 0
            scan.batch(at, lcp)
            last = int(at[-1])
    last = None
    for c in range(sigma):
        low = [(np.array([len(t) - 1]), np.zeros(1, "i4"))] if c == 0 else ((x["at"], x["lcp"].copy()) for x in done.forward(c))
        for parts in (low, out.backward(c)):
            for k, (at, lcp) in enumerate(parts):
                if not k:
                    lcp[0] = _seam(t, run, last, int(at[0]), cap) if last is not None else 0
                yield at, lcp
                last = int(at[-1])
    shutil.rmtree(folder)


def _prefixes(words, a: np.ndarray, b: np.ndarray, cap: int, step: int) -> np.ndarray:
    """Common prefixes, up to ``cap``, of the suffixes at a and at b, ``step`` characters at a time."""
    out, open_ = np.zeros(len(a), "i4"), np.arange(len(a))
    for k in range(0, cap, step):
        i, j = np.minimum(a[open_] + k, len(words) - 1), np.minimum(b[open_] + k, len(words) - 1)
        x = words[i] ^ words[j]
        same = x == 0
        part = open_[~same]
        if step > 1:
            y = x[~same]
            out[part] = k + (np.frexp((y & (~y + np.uint64(1))).astype("f8"))[1] - 1) // 8
        else:
            out[part] = k
        open_ = open_[same]
        if not len(open_):
            break
    out[open_] = cap
    return np.minimum(out, cap)


def _words(t: np.ndarray) -> tuple[np.ndarray, int]:
    """Eight characters from each place as one number, where a character is one byte."""
    if t.itemsize > 1:
        return t, 1
    padded = np.concatenate([t, np.zeros(8, "u1")])
    return np.ndarray((len(t),), "<u8", padded, strides=(1,)), 8


def _double(names: np.ndarray, cap: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``cap`` items, by doubling ranks."""
    rank, k = names.astype("i8"), 1
    top = int(rank.max()) + 1
    while k < cap and top < len(rank):
        after = np.zeros(len(rank), "i8")
        after[:-k] = rank[k:] + 1
        _, rank = np.unique(rank * (top + 1) + after, return_inverse=True)
        top, k = int(rank.max()) + 1, 2 * k
    return np.argsort(rank, kind="stable")


def _types(t, folder: str, most: int):
    """(is_s, run): whether a suffix is smaller than the next one, and how many characters equal to its first follow each other from there."""
    n = len(t)
    is_s, run = _array(folder, "is_s", n, "?", most), _array(folder, "run", n, "<i4", most)
    for a, z in reversed(list(_blocks(n, most))):
        x = np.asarray(t[a:z])
        begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        size = np.diff(np.append(begins, z - a))
        char = x[begins]
        same = z < n and t[z] == char[-1]
        last = True if z == n else is_s[z] if same else char[-1] < t[z]
        is_s[a:z] = np.repeat(np.append(char[:-1] < char[1:], last), size)
        end = np.repeat(begins + size, size)
        if same:
            end[begins[-1] :] += min(int(run[z]), (1 << 31) - 1 - len(x))
        run[a:z] = end - np.arange(z - a)
    return is_s, run


def _leftmost(t, is_s, folder: str, most: int):
    """(places, by character): the left-most S suffixes in the text's order, and in that of their first characters; with the counts of L and S suffixes of each."""
    n, sigma = len(t), int(max(int(t[a:z].max()) for a, z in _blocks(len(t), most))) + 1
    sizes, firsts = (np.zeros(sigma, "i8"), np.zeros(sigma, "i8")), np.zeros(sigma, "i8")
    found = []
    for a, z in _blocks(n, most):
        s, x = is_s[a:z], t[a:z]
        before = np.append(is_s[a - 1] if a else True, s[:-1])
        for k, own in enumerate((~s, s)):
            sizes[k][:] += np.bincount(x[own], minlength=sigma)
        at = np.flatnonzero(s & ~before) + a
        firsts += np.bincount(t[at], minlength=sigma)
        found.append(len(at))
    lms = _array(folder, "lms", max(1, sum(found)), "<i8", most)
    by_char = _array(folder, "by-char", len(lms), "<i8", most)
    if not sum(found):
        lms[0] = by_char[0] = n - 1
        firsts[t[n - 1]] += 1
    starts = np.concatenate([[0], np.cumsum(firsts)])
    free, k = starts[:-1].copy(), 0
    for (a, z), m in zip(_blocks(n, most), found):
        if m:
            at = np.flatnonzero(is_s[a:z] & ~np.append(is_s[a - 1] if a else True, is_s[a : z - 1])) + a
            lms[k : k + m] = at
            k += m
            c = t[at]
            order = np.argsort(c, kind="stable")
            at, c = at[order], c[order].astype("i8")
            new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            nth = np.arange(m) - np.repeat(new, np.diff(np.append(new, m)))
            by_char[free[c] + nth] = at
            free += np.bincount(c, minlength=sigma)
    return lms, Seeds(by_char, None, starts), sizes


def suffix_order(t: np.ndarray, cap: int, folder: str, most: int = MOST, names_at_once: int = NAMES):
    """Yields (suffixes, common prefixes with the one before) of ``t`` in order of their first ``cap`` characters.

    The last item of ``t`` must be 0 and no other. Left-most S substrings are sorted by
    inducing from unsorted ones, and named. If names repeat, the string of names is sorted
    the same way, or, where it has at most ``names_at_once`` items, by doubling in memory. ``most`` is
    the number of tuples or items in memory for each set of queues, log or block of an array; the rest is on disk.
    """
    os.makedirs(folder, exist_ok=True)
    is_s, run = _types(t, folder, most)
    lms, unsorted, sizes = _leftmost(t, is_s, folder, most)
    m = len(lms)
    if m == 1:
        yield from induce(t, is_s, run, Seeds(lms, np.zeros(1, "i4"), unsorted.starts), sizes, cap, os.path.join(folder, "all"), most)
        return
    words, step = _words(t)
    order, names = _array(folder, "order", m, "<i8", most), _array(folder, "names", m, "<i8", most)
    k, name, before = 0, -1, None
    ends = lambda q: np.where(q + 1 < m, lms[np.minimum(q + 1, m - 1)], len(t) - 1)
    for at, _ in induce(t, is_s, run, unsorted, sizes, 0, os.path.join(folder, "substrings"), most):
        at = at[is_s[at] & ~np.where(at > 0, is_s[np.maximum(at, 1) - 1], True)] if m > 1 else at
        if not len(at):
            continue
        q = np.searchsorted(lms, at)
        length = ends(q) - at + 1
        a, b = (at[:-1], at[1:]) if before is None else (np.append(before[0], at[:-1]), at)
        la, lb = (length[:-1], length[1:]) if before is None else (np.append(before[1], length[:-1]), length)
        new = la != lb
        j = np.flatnonzero(~new)
        if len(j):
            new[j] = _prefixes(words, a[j], b[j], int(lb[j].max()), step) < lb[j]
        names[q] = name + np.cumsum(np.append(True, new) if before is None else new)
        name, before = int(names[q[-1]]), (at[-1], length[-1])
        order[k : k + len(at)] = at
        k += len(at)
    if name + 1 < m and m <= names_at_once:
        order = lms[_double(np.asarray(names), cap)]
    elif name + 1 < m:
        inner = suffix_order(np.asarray(names, "u4") if m <= most else names, cap, os.path.join(folder, "inner"), most, names_at_once)
        k = 0
        for x, _ in inner:
            order[k : k + len(x)] = lms[x]
            k += len(x)
    lcp = _array(folder, "lcp", m, "<i4", most)
    for a, z in _blocks(m, most):
        x = order[a:z]
        lcp[a:z] = _prefixes(words, np.append(order[a - 1] if a else x[0], x[:-1]), x, cap, step)
    yield from induce(t, is_s, run, Seeds(order, lcp, unsorted.starts), sizes, cap, os.path.join(folder, "all"), most)


def repeated(parts: list[bytes], starts: list[int], length: int, most: int = MOST, names_at_once: int = NAMES) -> list[np.ndarray]:
    """For each part, which of its first ``starts`` places begin a string of ``length`` bytes that begins elsewhere among those of all parts."""
    sizes = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"\x00".join([*parts, b""]), "u1")
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    # a character for the end of a part, one for the end of all; only a few byte values don't occur
    t = np.concatenate([raw.astype("u2") + 2, [0]]).astype("u2")
    t[base + sizes] = 1
    used = np.unique(t)
    code = np.zeros(258, "u2")
    code[used] = np.arange(len(used))
    t = code[t].astype("u1" if len(used) <= 256 else "u2")
    own = np.zeros(len(t), bool)
    for b, n in zip(base.tolist(), starts):
        own[b : b + n] = True
    hit = np.zeros(len(t), bool)
    folder = tempfile.mkdtemp(prefix="induced-")
    try:
        before, low = -1, 0
        for at, lcp in suffix_order(t, length, folder, most, names_at_once):
            k = np.flatnonzero(own[at])
            if not len(k):
                low = min(low, int(lcp.min()))
                continue
            least = np.minimum.reduceat(lcp[: k[-1] + 1], np.append(0, k[:-1] + 1))
            least[0] = min(int(least[0]), low) if before >= 0 else 0
            far = np.flatnonzero(least >= length)
            hit[at[k[far]]] = True
            hit[np.where(far > 0, at[k[far - 1]], before)] = True
            before = int(at[k[-1]])
            low = int(lcp[k[-1] + 1 :].min()) if k[-1] + 1 < len(lcp) else length
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return [hit[b : b + n] for b, n in zip(base.tolist(), starts)]
