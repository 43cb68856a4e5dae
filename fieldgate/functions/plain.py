"""The scalars of :mod:`fieldgate.functions.scalars` as plain Python, for packets that are read in Arrow batches. Same results, value by value."""

from __future__ import annotations

import math
import re
from datetime import date

from ..config import FUZZY_THRESHOLD
from .scalars import DIRECTIONS, SUFFIXES, UNITS

SPACE = " \t\n\x0b\f\r"
WIDE_SPACE = SPACE + "\xa0"
#: What a dot stands for in the SQL functions' patterns: they know more line ends than Python.
DOT = "[^\n\r\u0085\u2028\u2029]"
MOST_KEPT = 50_000
LONGEST = 2**63 - 1

_STRICT = re.compile(r"\$[0-9]{1,3}(,[0-9]{3})*", re.A)
_LOOSE = re.compile(r"\$?\s*([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)\s*([KMB])?", re.A | re.I)
_ISO = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", re.A)
_PUNCTUATION = str.maketrans({c: " " for c in ".,;:'\"()-/\\"} | {"#": " UNIT "})
_SPACES = re.compile(r"\s+", re.A)
_UNITS = [(u, re.compile(rf"\b{u}\b[{SPACE}]*[A-Z0-9-]*")) for u in UNITS]
_LONG = SUFFIXES | DIRECTIONS
_COMMON = {*SUFFIXES, *SUFFIXES.values(), *DIRECTIONS, *DIRECTIONS.values()}
_SCALES = {"K": 1e3, "M": 1e6, "B": 1e9}


class Memo(dict):
    """Results by argument. It is emptied when full, so that its size is bounded whatever is read."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MOST_KEPT:
            self.clear()
        self[key] = out = self.make(key)
        return out


def trim(s: str) -> str:
    return s.strip(WIDE_SPACE)


def strict_currency(s: str) -> int | None:
    s = trim(s)
    if not _STRICT.fullmatch(s):
        return None
    n = int(s[1:].replace(",", ""))
    return n if n <= LONGEST else None


def loose_currency(s: str) -> int | None:
    s = trim(s)
    m = _LOOSE.fullmatch(s)
    if not m:
        return None
    x = float(m[1].replace(",", "")) * _SCALES.get(s[-1].upper(), 1.0) + 0.5
    return LONGEST if x >= LONGEST else math.floor(x)


def currency(mode: str):
    return strict_currency if mode == "strict" else loose_currency


def format_usd(x: float | None) -> str:
    if x is None or math.isnan(x := float(x)) or math.isinf(x):
        return "--"
    return f"{'-' if x < 0 else ''}${min(math.floor(abs(x) + 0.5), LONGEST):,}"


def iso_form(s: str | None) -> bool:
    return s is not None and _ISO.fullmatch(s) is not None


def _day(s: str) -> date | None:
    if not _ISO.fullmatch(s := trim(s)):
        return None
    try:
        return date(int(s[:4]), int(s[5:7]), int(s[8:]))
    except ValueError:
        return None


_days = Memo(_day)


def iso_date(s: str | None) -> date | None:
    """A real date written yyyy-MM-dd; anything else is None."""
    return None if s is None else _days[s]


def months_between(a: date, b: date) -> float:
    return (b.year - a.year) * 12 + (b.month - a.month) + (b.day - a.day) / 30.44


def _normal(s: str | None) -> str:
    s = (s or "").upper().translate(_PUNCTUATION)
    s = _SPACES.sub(" ", s).strip(" ")
    for unit, pattern in _UNITS:
        if unit in s:
            s = pattern.sub(" ", s)
    return " ".join(_LONG.get(w, w) for w in s.split(" ") if w)


normalize_address = Memo(_normal).__getitem__


def street_token(address: str | None) -> str | None:
    best = None
    for w in normalize_address(address).split(" "):
        if len(w) >= 4 and not "0" <= w[0] <= "9" and w not in _COMMON and (best is None or len(w) > len(best)):
            best = w
    return best


def levenshtein(a: str, b: str, most: int) -> int:
    """The distance of two texts; anything above ``most`` may come as any number above it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def match(a: tuple[str, str, str], b: tuple[str, str, str], fuzzy: bool, threshold: float = FUZZY_THRESHOLD) -> tuple[str, float] | None:
    """(basis, score) of two (raw, norm, zip), None without a match; see ``match_prepared``."""
    if a[2] != b[2]:
        return None
    if a[0] != "" and a[0] == b[0]:
        return "exact-raw", 1.0
    if not fuzzy or a[1] == "" or b[1] == "":
        return None
    if a[1] == b[1]:
        return "exact-normalized", 1.0
    if a[2] == "":
        return None
    longest = max(len(a[1]), len(b[1]))
    score = 1 - levenshtein(a[1], b[1], math.ceil((1 - threshold) * longest) + 1) / longest
    return ("fuzzy", score) if score >= threshold else None


def java_text(x: float) -> str:
    """A number as the SQL cast to string writes it."""
    if isinstance(x, int):
        return str(x)
    if x == 0 or 1e-3 <= abs(x) < 1e7 or math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "Infinity" if x == math.inf else "-Infinity" if x == -math.inf else repr(x)
    sign, digits, exponent = re.fullmatch(r"(-?)([0-9.]+)e([+-][0-9]+)", f"{x:.17e}").groups()
    short = repr(x).lstrip("-").split("e")[0].replace(".", "").strip("0") or "0"
    return f"{sign}{short[0]}.{short[1:] or '0'}E{int(exponent)}"
