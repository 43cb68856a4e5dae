"""Words and bytes of whole batches of texts as arrays, and sums over a text's items that are worked out once per distinct item."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, slices

SPACE = 32
#: A-Z lower-cased, white space (0x09-0x0D and 0x20) as a space.
LOWER = np.array([SPACE if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column, one after another, and where each starts (with the end); null as empty."""
    whole = pc.fill_null(column.cast(pa.large_binary()), b"")
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    at = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return flat, at - at[0]


class Words:
    """The words of a batch of texts: runs outside of white space, A-Z lower-cased."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        flat, at = text_bytes(column)
        self.lower = LOWER[flat]
        self.texts = at
        inside = self.lower != SPACE
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begin = at[:-1][at[:-1] < at[1:]]
        first[begin] = inside[begin]
        starts = np.flatnonzero(first)
        #: The words' bytes without anything between them, where each word starts (with the end), and where each text's words start (with the end).
        self.letters = self.lower[inside]
        self.offsets = np.append(np.cumsum(inside)[starts] - 1, len(self.letters)).astype(np.int64)
        self.borders = np.searchsorted(starts, at)

    def array(self) -> pa.Array:
        n = len(self.offsets) - 1
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(self.offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.letters))])

    def events(self, depth: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Every text as its words with single spaces between them and an ``end``, after ``depth`` further ends; and where texts start (with the end)."""
        n = np.diff(self.borders)
        text = np.repeat(np.arange(len(n)), n)
        lengths = np.diff(self.offsets)
        bare = np.concatenate([[0], np.cumsum(n == 0)])  # texts without a word before each
        shift = np.arange(len(lengths)) + depth * (text + 1) + bare[text]
        last = self.offsets[self.borders]
        starts = last + self.borders + depth * np.arange(len(n) + 1) + bare
        out = np.full(int(starts[-1]), end, dtype=np.uint8)
        out[np.arange(len(self.letters)) + np.repeat(shift, lengths)] = self.letters
        gap = np.ones(len(lengths), dtype=bool)
        gap[self.borders[1:][n > 0] - 1] = False
        out[(self.offsets[1:] + shift)[gap]] = SPACE
        return out, starts


class ItemCounts:
    """Counts of binary items, merged now and then so that memory follows the distinct ones."""

    def __init__(self):
        self.held: list[pa.Table] = []
        self.rows = 0

    def add(self, items: pa.Array) -> None:
        found = pc.value_counts(items)
        self._hold(pa.table({"word": found.field(0), "n": found.field(1)}))

    def _hold(self, part: pa.Table) -> None:
        self.held.append(part)
        self.rows += part.num_rows
        if len(self.held) >= 16:
            self.held = [self.merged()]
            self.rows = self.held[0].num_rows

    def merged(self) -> pa.Table:
        if not self.held:
            return pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        return pa.concat_tables(self.held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    def take(self) -> pa.Table:
        out = self.merged()
        self.held, self.rows = [], 0
        return out


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """word (binary), n: how often the words of all texts of ``docs`` (text) occur. A task sums what it meets, ``most`` distinct words or so at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = ItemCounts()
        for whole in batches:
            for batch in slices(whole, "text"):
                counts.add(Words(batch.column("text")).array())
                if counts.rows > most:
                    yield from counts.take().to_batches(50_000)
        yield from counts.take().to_batches(50_000)

    return docs.select("text").mapInArrow(lambda b: releasing(run(b)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hot_from(items: DataFrame, most: int) -> int:
    """The least power of two such that no more than ``most`` of ``items`` (n) occur so often; 0 if all of them may count as frequent."""
    many = dict(items.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect())  # 64 rows at most
    kept = 0
    for k in sorted(many, reverse=True):
        if kept + many[k] > most:
            return 2 ** (k + 1)
        kept += many[k]
    return 0


def coded(hot: pa.Array, items: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of ``items``, and the distinct ``hot`` and other items that they stand for: codes below len(hot) are places in ``hot``."""
    both = pa.concat_arrays([hot, items]).dictionary_encode()
    return both.indices.to_numpy()[len(hot) :], both.dictionary


def per_text(codes: np.ndarray, borders: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of flat item ``codes`` below ``distinct``, whose texts end at ``borders``: (text, code, how often) of every item of every text."""
    text = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    pair, n = np.unique(text * max(distinct, 1) + codes, return_counts=True)
    return pair // max(distinct, 1), pair % max(distinct, 1), n


def sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The sum of ``values`` between ``borders``, zero where nothing is between them."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)]) if values.dtype != np.float64 else None
    if total is not None:
        return total[borders[1:]] - total[borders[:-1]]
    out = np.zeros(len(borders) - 1)
    some = borders[:-1] < borders[1:]
    if some.any():
        out[some] = np.add.reduceat(values, borders[:-1][some])
    return out


def lists(text: np.ndarray, texts: int, columns: dict[str, pa.Array]) -> pa.Array:
    """A list column of structs: row i of the ``columns`` belongs to the text ``text[i]`` (sorted)."""
    offsets = np.searchsorted(text, np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), list(columns)))
