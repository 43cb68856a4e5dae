"""Byte n-grams as numbers: taken from texts, counted, and their logs summed by text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, holding, materialize, releasing, slices
from .words import hot_from, lists, per_text, sums, text_bytes

END = b"\n"
#: Grams whose logs are broadcast (12 bytes each), the most frequent ones; all others are joined.
HOT_GRAMS = 2_000_000


def padded(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of every text and an END, after ``depth`` further ENDs; and where texts start (with the end)."""
    flat, at = text_bytes(column)
    n = len(at) - 1
    out = np.full(len(flat) + (depth + 1) * n, END[0], dtype=np.uint8)
    out[np.arange(len(flat)) + np.repeat(np.arange(n) * (depth + 1) + depth, np.diff(at))] = flat
    return out, at + (depth + 1) * np.arange(n + 1)


def byte_grams(flat: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text but the first ``depth``, the byte below its ``depth`` predecessors as one number; and the texts' borders among these."""
    n = max(len(flat) - depth, 0)
    out = np.zeros(n, dtype=np.int64)
    for k in range(depth + 1):
        out |= flat[k : n + k].astype(np.int64) << (8 * (depth - k))
    keep = np.ones(len(flat), dtype=bool)
    for k in range(1, depth + 1):
        keep[starts[1:] - k] = False
    return out[keep[:n]], starts - depth * np.arange(len(starts))


def mask(depth: int) -> int:
    return (1 << (8 * depth)) - 1


class GramCounts:
    """Counts of grams, merged now and then so that memory follows the distinct ones."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, grams: np.ndarray) -> None:
        self.held.append(np.unique(grams, return_counts=True))
        if len(self.held) >= 8:
            self.held = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.held])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], np.concatenate([n for _, n in self.held])[order]
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        return keys[at], np.add.reduceat(n, at) if len(at) else n

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.held)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.held = []
        return out


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal buckets together, and where each starts in it (with the end)."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return order, np.append(at, len(own))


def in_parts(columns: dict[str, pa.Array], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_pydict(columns)
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Values at sorted ``keys``, and which were found."""
    if not len(keys):
        return np.full(len(wanted), missing), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], missing), hit


class Logs:
    """Logs of frequent grams through a direct-mapped cache, NaN for others."""

    BITS = 20

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys, self.logs = keys, logs
        self.gram = np.full(1 << self.BITS, -1, dtype=np.int64)
        self.value = np.zeros(1 << self.BITS, dtype=np.float32)

    def of(self, grams: np.ndarray) -> np.ndarray:
        slot = ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.value[slot].astype(np.float64)
        if len(miss := np.flatnonzero(self.gram[slot] != grams)):
            new, back = np.unique(grams[miss], return_inverse=True)
            out[miss] = look_up(self.keys, self.logs, new, np.nan)[0][back]
            self.gram[slot[miss]] = grams[miss]
            self.value[slot[miss]] = out[miss]
        return out

    def sums(self, grams: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The sum of the known logs of each text, and a list of its other grams with how often each occurs."""
        logs = self.of(grams)
        cold = np.isnan(logs)
        logs[cold] = 0
        distinct, codes = np.unique(grams[cold], return_inverse=True)
        text, code, n = per_text(codes, np.searchsorted(np.flatnonzero(cold), borders), len(distinct))
        return sums(logs, borders), lists(text, len(borders) - 1, {"gram": pa.array(distinct[code], pa.int64()), "n": pa.array(n, pa.int64())})


def broadcast_hot(known: DataFrame, least: int):
    """Sorted grams and logs of ``known`` (gram, n, log) with n of ``least`` or more, for :class:`Logs`."""
    got = known.where(F.col("n") >= least).select("gram", F.col("log").cast("float").alias("log")).sort("gram").toArrow()
    out = known.sparkSession.sparkContext.broadcast((got.column("gram").to_numpy(), got.column("log").to_numpy()))
    del got
    give_back()
    return out


def log_sums(rows: DataFrame, known: DataFrame, grams_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], hot_grams: int, slice_bytes: int = 1 << 20) -> DataFrame:
    """The columns of ``rows`` without text, then log_p, the sum of the logs of the text's grams, and n_grams.

    ``known`` (gram, n, log) has all grams of the texts. The most frequent ones, ``hot_grams`` at most, are broadcast; a text's other grams are
    joined by the gram, which is never frequent then.
    """
    least = hot_from(known, hot_grams)
    hot = broadcast_hot(known, least)
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = Logs(*hot.value)
        rid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text", slice_bytes):
                grams, borders = grams_of(batch)
                total, cold = logs.sums(grams, borders)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.arange(rid, rid + batch.num_rows)), pa.array(total), pa.array(np.diff(borders)), cold], [*names, "__rid", "__hot", "n_grams", "__cold"])
                rid += batch.num_rows

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    summed = materialize(rows.mapInArrow(lambda b: releasing(run(b)), f"{kinds}__rid long, __hot double, n_grams long, __cold array<struct<gram:long,n:long>>"), "summed")
    more = cold_sums(summed, "__rid", "__cold", known, least)
    out = summed.join(more, "__rid", "left").select(*names, (F.col("__hot") + F.coalesce("more", F.lit(0.0))).alias("log_p"), "n_grams")
    return holding(out, summed)


def cold_sums(texts: DataFrame, rid: str, cold: str, known: DataFrame, least: int) -> DataFrame:
    """``rid`` and more: the sum over a text's list ``cold`` (gram, n) of n times the log of the gram in ``known`` (gram, n, log), where it is rarer than ``least``."""
    pairs = texts.select(rid, F.explode(cold).alias("c")).select(rid, F.col("c.gram").alias("gram"), F.col("c.n").alias("m"))
    return pairs.join(known.where(F.col("n") < least).select("gram", "log"), "gram").groupBy(rid).agg(F.sum(F.col("m") * F.col("log")).alias("more"))

