"""Noise for robustness runs: seeded character confusions as an Arrow UDF, page furniture in SQL functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DOCUMENTS

#: Fixed values: (confusion, drop, merge) rates, the confused characters, and what may be dropped.
RATES = {"ocr-light": (0.009, 0.02, 0.0), "ocr-heavy": (0.02, 0.05, 0.04)}
PROFILES = [*RATES, "pdf-layout"]
CONFUSED = {"0": "O", "O": "0", "1": "l", "l": "1", "I": "1", "5": "S", "S": "5", "8": "B", "B": "8", "6": "G", ",": "", ".": ""}
DROPPED = ".,;:"
PAGE_LINES = 40


class UnknownNoise(KeyError):
    """No noise profile has this name."""


def uniforms(seed: str, n: int) -> np.ndarray:
    """``n`` numbers in [0, 1) of the 32-bit generator that a string seeds (a multiplicative hash of its code units, then a counter that is mixed)."""
    h = 0
    for unit in seed.encode("utf-16-le")[::2] if seed.isascii() else memoryview(seed.encode("utf-16-le")).cast("H"):
        h = ((h ^ unit) * 0x01000193 & 0xFFFFFFFF) or 1
    a = np.uint32(h) + np.arange(1, n + 1, dtype=np.uint32) * np.uint32(0x6D2B79F5)
    t = (a ^ a >> np.uint32(15)) * (a | np.uint32(1))
    t = (t + (t ^ t >> np.uint32(7)) * (t | np.uint32(61))) ^ t
    return (t ^ t >> np.uint32(14)) / 4294967296.0


def ocr(text: str, seed: str, confuse: float, drop: float, merge: float) -> str:
    """One draw per character, then one per character that is left, then one per line break."""
    need = 2 * len(text) + text.count("\n") + 1
    draws = uniforms(seed, need)
    first = [CONFUSED.get(c, c) if u < confuse else c for c, u in zip(text, draws[: len(text)].tolist(), strict=True)]
    kept = "".join(first)
    at = len(text)
    second = [("" if c in DROPPED else c) if u < drop else c for c, u in zip(kept, draws[at : at + len(kept)].tolist(), strict=True)]
    out = "".join(second)
    if not merge:
        return out
    at += len(kept)
    rows = out.split("\n")
    breaks = [" " if u < merge else "\n" for u in draws[at : at + len(rows) - 1].tolist()]
    joined = "".join(r + b for r, b in zip(rows, breaks, strict=False)) + rows[-1]
    return joined


@lru_cache(maxsize=8)
def ocr_udf(profile: str):
    rates = RATES[profile]

    @F.pandas_udf("string")
    def noisy(text: pd.Series, scope: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else ocr(t, f"{profile}|{s}", *rates) for t, s in zip(text, scope, strict=True)])

    return noisy


def pdf_layout(text: Column, doc_id: Column) -> Column:
    """A header before every 40th line, blank lines doubled, a continuation mark after every 40th."""
    page = F.lit(PAGE_LINES)

    def one(line: Column, i: Column) -> Column:
        header = F.concat(F.lit("Form "), F.upper(doc_id), F.lit(" · Page "), (F.floor(i / page) + 1).cast("string"))
        nothing = F.array().cast("array<string>")
        return F.concat(
            F.when(i % page == 0, F.array(header)).otherwise(nothing),
            F.array(line),
            F.when(~line.rlike("\\S"), F.array(F.lit(""))).otherwise(nothing),
            F.when((i + 1) % page == 0, F.array(F.lit("— continued —"))).otherwise(nothing),
        )

    return F.array_join(F.flatten(F.transform(F.split(text, "\n"), one)), "\n")


def perturb_text(text: Column, profile: str, packet_id: Column, doc_id: Column) -> Column:
    if profile not in PROFILES:
        raise UnknownNoise(f"unknown noise {profile!r}; known: {', '.join(PROFILES)}")
    if profile == "pdf-layout":
        return F.when(text.isNotNull(), pdf_layout(text, doc_id))
    return ocr_udf(profile)(text, F.concat(packet_id, F.lit("/"), doc_id))


def perturb(packets: DataFrame, profile: str, only: list[str] | None = None) -> DataFrame:
    """``packets`` with noise in the texts of the kinds ``only`` (default: all)."""
    return packets.withColumns({d: perturb_text(F.col(d), profile, F.col("packet_id"), F.lit(d)) for d in (only or DOCUMENTS)})
