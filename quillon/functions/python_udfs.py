"""The few functions that Catalyst cannot express, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
import uuid
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters for transliteration of names.
_CYRILLIC = dict(zip("абвгдезийклмнопрстуфхыэ", "abvgdezijklmnoprstufhye")) | {
    "ё": "e", "ж": "zh", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "і": "i", "ї": "i", "є": "e", "ґ": "g",
}
_GREEK = dict(zip("αβγδεζηικλμνοπρσςτυφχω", "abgdeziiklmnoprsstyfho")) | {"θ": "th", "ξ": "x", "ψ": "ps"}
_ARABIC = dict(zip("ابتجحدرزسصضطعفقكلمنهويئءآأإةى", "abtjhdrzssdtafqklmnhwyyaaaahy")) | {"ث": "th", "خ": "kh", "ذ": "dh", "ش": "sh", "ظ": "z", "غ": "gh", "ؤ": "w"}
_LETTERS = {**_CYRILLIC, **_GREEK, **_ARABIC, "ß": "ss", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "œ": "oe"}
# Marks of Arabic script that are deleted.
_MARKS = re.compile("[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭـ]")
# Words of legal forms.
_FORMS = frozenset(
    "llc ltd limited inc incorporated corp corporation co company plc llp lp gmbh ag kg sa sas sarl srl spa bv nv oy ab as ooo oao zao pao ao sl spzoo liability public joint stock".split()
)
# Words too general to stand alone for a name.
_GENERAL = frozenset("trading group holdings general global company international services industries enterprise enterprises import export".split())


def jaro_winkler_bytes(a: str, b: str) -> float:
    """Jaro-Winkler over UTF-8 bytes; the prefix counts above 0.7 only; two empty strings give 0."""
    x, y = a.encode("utf-8"), b.encode("utf-8")
    n, m = len(x), len(y)
    if not n or not m:
        return 0.0
    if x == y:
        return 1.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken = bytearray(m)
    left = bytearray()
    for i in range(n):
        lo, hi = max(0, i - reach), min(m, i + reach + 1)
        j = y.find(x[i], lo, hi)
        while j >= 0 and taken[j]:
            j = y.find(x[i], j + 1, hi)
        if j >= 0:
            taken[j] = 1
            left.append(x[i])
    c = len(left)
    if not c:
        return 0.0
    right = bytes(y[j] for j in range(m) if taken[j])
    half = sum(p != q for p, q in zip(left, right)) // 2
    sim = (c / n + c / m + (c - half) / c) / 3
    if sim > 0.7:
        k = 0
        while k < min(4, n, m) and x[k] == y[k]:
            k += 1
        sim += 0.1 * k * (1 - sim)
    return sim


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_bytes(x, y) for x, y in zip(a, b)], dtype="float64")


class Spellings:
    """Names as arrays of their bytes, so that many pairs of them are compared at once."""

    WIDTH, LEVELS = 128, 8

    def __init__(self, names: list[str]):
        raw = [n.encode("utf-8") for n in names]
        self.names, self.size = names, np.array([len(r) for r in raw], np.int64)
        used = np.unique(np.frombuffer(b"".join(raw), np.uint8))
        code = np.zeros(256, np.int64)
        code[used] = np.arange(1, len(used) + 1)  # 0 is the end of a name
        w = 64 if self.size.max(initial=0) <= 64 else self.WIDTH
        self.code = code[np.frombuffer(b"".join(r[:w].ljust(w, b"\0") for r in raw), np.uint8)].reshape(-1, w)
        self.code[np.arange(w) >= self.size[:, None]] = 0
        self.at = np.zeros((w // 64, len(raw), len(used) + 1), np.uint64)  # places of each byte, 64 a word
        for i in range(w):
            self.at[i // 64, np.arange(len(raw)), self.code[:, i]] |= np.uint64(1 << i % 64)
        self.at[:, :, 0] = 0
        n = np.array([np.bincount(code[np.frombuffer(r, np.uint8)], minlength=len(used) + 1)[1:] for r in raw], np.int64).reshape(len(raw), -1)
        levels = [(n[:, k] >= v)[:, None] for k in range(n.shape[1]) for v in range(1, min(self.LEVELS, int(n[:, k].max(initial=0))) + 1)]
        self.has = np.concatenate(levels, 1).astype(np.float32) if levels else np.zeros((len(raw), 1), np.float32)
        self.more = np.maximum(n - self.LEVELS, 0).sum(1).astype(np.float32)

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that are equal at the beginning, at most four."""
        k = np.zeros(np.broadcast(a, b).shape, np.int8)
        same = np.ones(k.shape, bool)
        for i in range(4):
            same &= (self.code[a, i] == self.code[b, i]) & (self.code[a, i] > 0)
            k += same
        return k

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Matrix of the bytes that ``a`` and ``b`` have in common, whatever the order, or somewhat more."""
        common = self.has[a] @ self.has[b].T
        if self.more[a].any() and self.more[b].any():
            common += np.minimum(self.more[a][:, None], self.more[b][None, :])
        return common

    @staticmethod
    def need(least: float) -> np.ndarray:
        """Three times the Jaro that a pair with 0 to 4 equal first bytes must have for ``least`` (above 0.7)."""
        k = np.arange(5) / 10
        return 3 * np.maximum((least - k) / (1 - k), 0.7) - 1e-4

    def may_reach(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Matrix of the pairs of ``a`` and ``b`` whose Jaro-Winkler could be ``least`` (above 0.7) by :meth:`common`."""
        turn = (1 / np.maximum(self.size, 1)).astype(np.float32)
        common = self.common(a, b) * (turn[a][:, None] + turn[b][None, :])
        return common >= (self.need(least) - 1).astype(np.float32)[self.prefix(a[:, None], b[None, :])]

    def jaro_winkler(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """:func:`jaro_winkler_bytes` of the pairs ``a[i], b[i]``; 0 where it is below ``least`` (above 0.7)."""
        out = np.zeros(len(a))
        longer = np.maximum(self.size[a], self.size[b])
        for i in np.flatnonzero(longer > self.WIDTH):
            out[i] = jaro_winkler_bytes(self.names[a[i]], self.names[b[i]])
        some = (self.size[a] > 0) & (self.size[b] > 0)
        for words in (1, 2):
            pick = np.flatnonzero(some & (longer <= 64 * words) & (longer > 64 * words - 64))
            for lo in range(0, len(pick), 1 << 14):
                ix = pick[lo : lo + (1 << 14)]
                out[ix] = self._short(a[ix], b[ix], least, words)
        out[out < least] = 0.0
        return out

    def _short(self, a: np.ndarray, b: np.ndarray, least: float, words: int) -> np.ndarray:
        one = np.uint64(1)
        below = np.array([(1 << k) - 1 for k in range(65)], np.uint64)  # masks of the first k bytes
        first = lambda k, w: below[np.minimum(np.maximum(k - 64 * w, 0), 64)]
        n, m = self.size[a], self.size[b]
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        taken, left = np.zeros((words, len(a)), np.uint64), np.zeros((words, len(a)), np.uint64)
        for i in range(int(n.max(initial=0))):
            found = np.zeros(len(a), bool)
            for w in range(words):
                free = self.at[w, b, self.code[a, i]] & first(i + reach + 1, w) & ~first(i - reach, w) & ~taken[w]
                free[found] = 0
                low = free & (~free + one)
                taken[w] |= low
                found |= low != 0
            left[i // 64] |= found.astype(np.uint64) << np.uint64(i % 64)
        c = np.bitwise_count(taken).sum(0).astype(np.float64)
        k = self.prefix(a, b)
        best = (c / n + c / m + 1) / 3
        out = np.zeros(len(a))
        on = np.flatnonzero((c > 0) & (best + 0.1 * k * (1 - best) >= least - 1e-9))
        a, b, c, k, n, m, taken, left = a[on], b[on], c[on], k[on], n[on], m[on], taken[:, on], left[:, on]
        half = np.zeros(len(on), np.int64)
        for i in range(int(n.max(initial=0))):
            here = (left[i // 64] >> np.uint64(i % 64)) & one != 0
            met, open_ = np.zeros(len(on), bool), here.copy()
            for w in range(words):
                low = np.where(open_, taken[w] & (~taken[w] + one), np.uint64(0))
                taken[w] ^= low
                met |= self.at[w, b, self.code[a, i]] & low != 0
                open_ &= low == 0
            half += here & ~met
        sim = (c / n + c / m + (c - half // 2) / c) / 3
        out[on] = np.where(sim > 0.7, sim + 0.1 * k * (1 - sim), sim)
        return out


def strip_marks(text: str) -> str:
    return _MARKS.sub("", text)


def name_key(text: str | None) -> str | None:
    """Script-stable key of a name: Latin letters, legal forms gone, words sorted."""
    if not text:
        return None
    t = strip_marks(text).lower()
    t = "".join(c for c in unicodedata.normalize("NFKD", "".join(_LETTERS.get(c, c) for c in t)) if not unicodedata.combining(c))
    words = sorted(re.sub(r"[^a-z0-9]+", " ", "".join(_LETTERS.get(c, c) for c in t)).split())
    if not words:
        return None
    full = " ".join(words)
    kept = [w for w in words if w not in _FORMS]
    return full if not kept or len(kept) == 1 and kept[0] in _GENERAL else " ".join(kept)


@F.pandas_udf(T.StringType())
def name_fingerprint(names: pd.Series) -> pd.Series:
    return names.map(name_key, na_action="ignore").astype(object)


class _Paragraphs(HTMLParser):
    # Elements without main text.
    SKIP = frozenset("script style nav header footer aside form noscript svg button iframe".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.inside, self.now = 0, False, []
        self.paragraphs, self.all = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.depth += 1
        elif tag == "p":
            self._close()
            self.inside = True

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.depth = max(0, self.depth - 1)
        elif tag == "p":
            self._close()

    def handle_data(self, data):
        if not self.depth:
            self.all.append(data)
            if self.inside:
                self.now.append(data)

    def _close(self):
        text = " ".join("".join(self.now).split())
        if self.inside and text:
            self.paragraphs.append(text)
        self.inside, self.now = False, []


def text_of_html(page: str | None, shortest: int = 40, most: int = 20_000) -> str:
    """Paragraphs of some length, or all text if there is none; empty for nothing."""
    if not page:
        return ""
    p = _Paragraphs()
    p.feed(page)
    p.close()
    p._close()
    body = "\n\n".join(x for x in p.paragraphs if len(x) >= shortest) or " ".join(" ".join(p.all).split())
    return body[:most]


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(text_of_html)


@F.pandas_udf(T.StringType())
def uuid5(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: str(uuid.uuid5(uuid.NAMESPACE_URL, k)), na_action="ignore")


def blocked_address(text: str | None) -> bool:
    """Whether an address must not be fetched; what cannot be read is blocked."""
    try:
        ip = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return True
    ip = getattr(ip, "ipv4_mapped", None) or ip
    shared = ip.version == 4 and ip in ipaddress.ip_network("100.64.0.0/10")
    return shared or ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified


@F.pandas_udf(T.BooleanType())
def is_blocked_ip(addresses: pd.Series) -> pd.Series:
    return addresses.map(blocked_address)
