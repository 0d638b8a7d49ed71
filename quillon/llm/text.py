"""Folding of noisy Latin, Cyrillic and Greek text, and string comparison."""

from __future__ import annotations

import re
import unicodedata

# Letter tables for transliteration.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "i", "є": "e", "ґ": "g", "ј": "y", "љ": "l", "њ": "n",
}
GREEK_PAIRS = {"ντ": "d", "μπ": "b", "γκ": "g", "τζ": "j", "τσ": "ts", "ου": "u", "γγ": "ng"}
GREEK = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "ks",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "h", "ψ": "ps", "ω": "o",
}
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
# Latin letters that have no decomposition.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "’": "'", "‘": "'", "`": "'", "´": "'"}

_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0x100) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {chr(b): b for b in range(0x80, 0x100)}
_LEAD = {"Â": 0xC2, "Ã": 0xC3, "Ä": 0xC4, "Å": 0xC5, "â": 0xC2, "ã": 0xC3, "ä": 0xC4, "å": 0xC5}
_MOJI = re.compile("([ÂÃÄÅâãäå])([" + "".join(re.escape(c) for c, b in _CP1252.items() if 0x80 <= b <= 0xBF) + "])")
_CYR, _GRE, _LAT = re.compile("[Ѐ-ӿ]"), re.compile("[Ͱ-Ͽ]"), re.compile("[A-Za-z]")
_WORD = re.compile(r"\S+")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


_RUN = re.compile("[" + "".join(re.escape(c) for c in sorted(_CP1252)) + "]{2,}")


def mend(s: str) -> str:
    """Undo UTF-8 that was read as a one-byte code, where a run of characters is valid UTF-8."""
    def run(m: re.Match) -> str:
        try:
            return bytes(_CP1252[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return s if s.isascii() else _RUN.sub(run, s)


def _moji(m: re.Match) -> str:
    try:
        return bytes([_LEAD[m[1]], _CP1252[m[2]]]).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def _script(m: re.Match) -> str:
    w = m[0]
    cyr, gre = _CYR.search(w), _GRE.search(w)
    if (cyr or gre) and (latin := len(_LAT.findall(w))) > 1:  # a few look-alikes among Latin letters
        foreign = [c for c in w if _CYR.match(c) or _GRE.match(c)]
        if len(foreign) < latin and all(c in LOOKALIKES for c in foreign):
            return "".join(LOOKALIKES.get(c, c) for c in w)
    if cyr:
        w = "".join(CYRILLIC.get(c, c) for c in w)
    if gre:
        for a, b in GREEK_PAIRS.items():
            w = w.replace(a, b)
        w = "".join(GREEK.get(c, c) for c in w)
    return w


def fold(s: str | None) -> str:
    """Lower-case Latin letters without accents; broken encodings and other scripts are brought to it."""
    if not s:
        return ""
    if not s.isascii():
        s = _MOJI.sub(_moji, mend(s))
        s = unicodedata.normalize("NFKC", _HIDDEN.sub("", s)).lower()
        s = "".join(LETTERS.get(c, c) for c in s)
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
        if not s.isascii():
            s = _WORD.sub(_script, s)
    return " ".join(s.lower().split())


_OCR = re.compile(r"(?<=[a-z])[01](?=[a-z])|(?<=[a-z])[01]\b|\b[01](?=[a-z]{2})")


def unscan(s: str) -> str:
    """Digits that stand for letters within words of folded text."""
    return _OCR.sub(lambda m: "o" if m[0] == "0" else "l", s) if "0" in s or "1" in s else s


# Spellings that sound alike, applied in this order.
_SOUND = (
    ("rn", "m"), ("ph", "f"), ("th", "t"), ("kh", "k"), ("ch", "k"), ("sh", "s"), ("zh", "z"), ("x", "ks"), ("ks", "k"), ("q", "k"), ("c", "k"), ("w", "v"),
    ("j", "i"), ("y", "i"), ("h", ""),
)
_TWICE = re.compile(r"(.)\1+")


def sound(word: str) -> str:
    """A spelling key of folded text: letters that transliteration and scanning confuse are one, doubled ones single."""
    word = _TWICE.sub(r"\1", word)
    for a, b in _SOUND:
        if a in word:
            word = word.replace(a, b)
    return _TWICE.sub(r"\1", word)


_SPELL = tuple(p for p in _SOUND if p[0] not in ("rn", "h"))


def spelling(word: str) -> str:
    """A key like :func:`sound` that keeps every slip of one letter a slip of one letter."""
    for a, b in _SPELL:
        if a in word:
            word = word.replace(a, b)
    return word


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity with the prefix weight 0.1 over at most four letters."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    used, hits = [False] * lb, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(hits, (b[j] for j in range(lb) if used[j]))) / 2
    sim = (m / la + m / lb + (m - t) / m) / 3
    if sim <= 0.7:
        return sim
    p = 0
    while p < min(4, la, lb) and a[p] == b[p]:
        p += 1
    return sim + 0.1 * p * (1 - sim)


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two strings; ``most + 1`` if more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    if len(a) == len(b) == 1:
        return 1
    if len(a) == len(b) == 2 and a[0] == b[1] and a[1] == b[0]:
        return 1
    two, one = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            x = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                x = min(x, two[j - 2] + 1)
            row.append(x)
        two, one = one, row
        if min(one) > most:
            return most + 1
    return min(most + 1, one[-1])
