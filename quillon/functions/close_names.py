"""Pairs of names whose Jaro-Winkler reaches a level, found among all pairs of two lists by arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from quillon.functions.python_udfs import Spellings

Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]
#: Names that are compared at once with another, and those that are too few for it.
TILE, FEW = 4096, 200


@lru_cache(maxsize=128)
def _levels(n: int, edges: tuple[float, float]) -> np.ndarray:
    """Level (0, 1, 2) of a name of ``n`` bytes with one of ``m`` that has its first four, by ``m``, matched bytes and those of them in order."""
    m, c, e = np.ogrid[0:65, 0:65, 0:65]
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (c / n + c / m + (c - (c - e) // 2) / c) / 3
        sim = np.where(sim > 0.7, sim + 0.1 * 4 * (1 - sim), sim)
    return ((sim >= edges[1]).astype(np.int8) + (sim >= edges[0])).ravel()


class CloseNames(Spellings):
    """Unequal names, sorted; pairs of them are found once, as ``(one, other, level)``, since the distance is the same both ways."""

    def __init__(self, names: list[str], edges: tuple[float, float]):
        super().__init__(names)
        self.edges, self.least = edges, edges[1]
        self.letters = [list(dict.fromkeys(c[c > 0].tolist())) for c in self.code]
        self.rows = [c[:s].tolist() for c, s in zip(self.code, self.size)]
        self.places = np.ascontiguousarray(self.at[0].T.view(np.int64))
        self.start = np.frombuffer(b"".join(n.encode()[:4].ljust(4, b"\0") for n in names), ">u4").astype(np.int64)

    def _leveled(self, held: list[tuple[np.ndarray, np.ndarray]]) -> Found:
        a, b = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        jw = self.jaro_winkler(a, b, self.least)
        on = np.flatnonzero(jw)
        yield a[on], b[on], 1 + (jw[on] >= self.edges[0]).astype(np.int8)

    def alike(self, a: np.ndarray, b: np.ndarray | None) -> Found:
        """Of ``a`` with ``b`` (with itself where that is none), where all have the same first four bytes: few such pairs are ruled out sooner."""
        own = b is None
        b = a if own else b
        short, held, many = (self.size <= 64) & (len(b) >= FEW), [], 0  # few names are met one by one, as long ones are
        for x, y in ((a[short[a]], b[~short[b]]), (a[~short[a]], b)):
            for i in x:
                other = y[(y > i) & ~short[y]] if own and not short[i] else y
                held.append((np.full(len(other), i), other))
                many += len(other)
                if many > 1 << 15:
                    yield from self._leveled(held)
                    held, many = [], 0
        if held:
            yield from self._leveled(held)
        a, b = a[short[a]], b[short[b]]
        for lo in range(0, len(b), TILE):
            yield from self._tile(a, b[lo : lo + TILE], own)

    def _tile(self, a: np.ndarray, b: np.ndarray, own: bool) -> Found:
        if own:
            a = a[a < b[-1]]
        at, m = np.ascontiguousarray(self.places[:, b]), self.size[b]
        below = np.array([(1 << k) - 1 for k in range(65)], np.uint64).view(np.int64)
        base, steps = m * 65 * 65, int(self.size[a].max(initial=0))
        begin = np.searchsorted(b, a, "right") if own else np.zeros(len(a), np.int64)
        full = [np.empty((steps, len(b)), np.int64), np.empty((steps + 1, len(b)), np.int64), np.empty(len(b), np.int64), np.empty(len(b), np.int64), np.empty(len(b), np.int8)]
        for n in np.unique(self.size[a]).tolist():
            reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
            window = np.stack([below[np.minimum(i + reach + 1, 64)] & ~below[np.maximum(i - reach, 0)] for i in range(n)])
            level = _levels(n, self.edges)
            of, last = self.size[a] == n, []
            full[1][: min(4, n) + 1] = ~15  # the four equal bytes take one another
            for i, s in zip(a[of].tolist(), begin[of].tolist()):
                here, open_, free, low, even = full[0][:, s:], full[1][:, s:], *(f[s:] for f in full[2:])
                row = self.rows[i]
                # names are sorted: what the name before has alike at the beginning is done (its columns include these)
                since = 4
                while since < len(last) and last[since] == row[since]:
                    since += 1
                if row[:4] != last[:4]:
                    since = 4
                for k in range(since, n):
                    np.bitwise_and(at[row[k], s:], window[k, s:], out=free)
                    np.bitwise_and(free, open_[k], out=free)
                    np.negative(free, out=low)
                    np.bitwise_or(free, low, out=here[k])
                    np.bitwise_and(free, low, out=low)
                    np.bitwise_xor(open_[k], low, out=open_[k + 1])
                np.right_shift(here[since:n], 63, out=here[since:n])  # all bits where a byte was taken
                last = row
                rest = np.invert(open_[n], out=free)
                found = base[s:] + np.bitwise_count(rest.view(np.uint64)).astype(np.int64) * 65
                np.bitwise_and(rest, ~15, out=rest)
                even.fill(4)
                for k in range(4, n):
                    np.negative(rest, out=low)
                    np.bitwise_and(low, rest, out=low)
                    np.bitwise_and(low, here[k], out=low)
                    np.bitwise_xor(rest, low, out=rest)
                    np.bitwise_and(low, at[row[k], s:], out=low)
                    even += low != 0
                found += even
                got = level[found]
                on = np.flatnonzero(got)
                yield np.full(len(on), i), b[s:][on], got[on]

    def unlike(self, a: np.ndarray, b: np.ndarray | None, key: np.ndarray) -> Found:
        """Of ``a`` with ``b`` (with itself where that is none), but for names with one ``key``, which rises with the names.

        A pair is left out by the bytes in common and then by the longest common subsequence, which bounds
        the matched bytes in order; what remains is compared.
        """
        own = b is None
        b = a if own else b
        at, start, keys = np.ascontiguousarray(self.places[:, b]), self.start[b], key[b]
        need, turn, short = self.need(self.least), 1 / np.maximum(self.size, 1), self.size[b] <= 64
        bound: dict[int, np.ndarray] = {}
        held, many = [], 0
        for lo in range(0, len(a), 128):
            some, off = a[lo : lo + 128], lo if own else 0
            common = self.common(some, b[off:])
            cuts = [np.stack([np.searchsorted(start, p, "left"), np.searchsorted(start, p | (1 << 8 * (4 - k)) - 1, "right")], 1) for k in range(1, 5) for p in [self.start[some] >> 8 * (4 - k) << 8 * (4 - k)]]
            one = np.stack([np.searchsorted(keys, key[some], "left"), np.searchsorted(keys, key[some], "right")], 1)
            for x, i in enumerate(some.tolist()):
                n = int(self.size[i])
                if n not in bound:
                    bound[n] = ((need[:, None] - 1) / (turn[i] + turn[b])).astype(np.float32)
                row, least, z = common[x], bound[n][:, off:], (lo + x + 1 - off) if own else 0
                ok = row >= least[0]
                ends = [np.maximum(c[x] - off, 0) for c in cuts]
                for k, (p, q) in enumerate(ends, 1):
                    ok[p:q] = row[p:q] >= least[k, p:q]
                p, q = np.maximum(one[x] - off, 0)
                ok[p:q] = False
                ok[:z] = False
                ix = np.flatnonzero(ok)
                if not len(ix):
                    continue
                asked = np.full(len(ix), need[0])
                for k, e in enumerate(ends, 1):
                    p, q = np.searchsorted(ix, e)
                    asked[p:q] = need[k]
                if n <= 64:
                    to = ix + off
                    ix = ix[(self._subsequence(i, to, at, b, turn, row[ix]) >= asked) | ~short[to]]
                held.append((np.full(len(ix), i), b[ix + off]))
                many += len(ix)
                if many > 1 << 15:
                    yield from self._leveled(held)
                    held, many = [], 0
        if held:
            yield from self._leveled(held)

    def _subsequence(self, i: int, to: np.ndarray, at: np.ndarray, b: np.ndarray, turn: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Three times the Jaro that ``i`` can have at most with ``b[to]``, which have ``c`` bytes in common with it."""
        place = {k: at[k].take(to) for k in self.letters[i]}
        v, u, w = np.full(len(to), -1, np.int64), np.empty(len(to), np.int64), np.empty(len(to), np.int64)
        for k in self.rows[i]:
            np.bitwise_and(v, place[k], out=u)
            np.add(v, u, out=w)
            np.subtract(v, u, out=v)
            np.bitwise_or(v, w, out=v)
        size = self.size[b[to]]
        inside = np.where(size > 63, -1, (1 << np.minimum(size, 63)) - 1)
        even = np.bitwise_count((~v & inside).view(np.uint64)) + 1.0
        each = turn[i] + turn[b[to]]
        return np.maximum(even * each + 1, c * each + 0.5 + even / (2 * c))
