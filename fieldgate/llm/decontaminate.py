"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, releasing, slices, text_hash, utf8
from .simhash import ball, segments_of

SHINGLE = 5
THRESHOLD = 0.8
#: At similarity 0.8 about 10 of 64 bits differ (standard deviation 3); 20 is more than three deviations beyond.
RADIUS = 20
PARTS = 8
#: Benchmark items, and bytes of them, that are broadcast at once; more go block by block, a pass each.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20
#: Words of a text whose windows are fingerprinted at once, besides a window's own.
SPAN = 1 << 14
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def word_hashes(words: list[bytes], memo: _Hashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= _FACTOR
        h ^= h >> np.uint64(29)
        h += words[k : n + k]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def window_prints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of ``size`` consecutive shingle hashes; a repeated shingle weighs as often as it occurs."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    got = sums[starts + size] - sums[starts]
    return np.packbits(2 * got > size, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    if not len(a) or not len(b):
        return 0.0
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = int(np.minimum(na[ia], nb[ib]).sum())
    return shared / (len(a) + len(b) - shared)


class Benchmark:
    """Items with their shingles, and a multi-index table of their fingerprints."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int, radius: int, parts: int):
        memo = _Hashes()
        self.radius, self.shingle = radius, shingle
        self.items: list[tuple[int, int, int, np.ndarray]] = []  # item, words, shingle size, hashes
        for item, text in items:
            words = word_hashes(text.lower().split(), memo)
            if len(words):
                size = min(shingle, len(words))
                self.items.append((item, len(words), size, shingle_hashes(words, size)))
        self.prints = np.array([int(window_prints(h, np.array([0]), len(h))[0]) for _, _, _, h in self.items], dtype=np.uint64)
        self.sizes = sorted({s for _, _, s, _ in self.items})
        #: By shingle size: sorted shingles, each with the items that have it.
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in self.sizes:
            pairs = sorted({(int(x), k) for k, (_, _, s, h) in enumerate(self.items) if s == size for x in h})
            self.known[size] = np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs], dtype=np.int64)
        self.filter = {s: np.zeros(1 << 20, dtype=bool) for s in self.sizes}
        for s, (h, _) in self.known.items():
            self.filter[s][(h & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.tables = []
        for shift, width in segments_of(parts):
            own = self.prints >> np.uint64(shift) & np.uint64((1 << width) - 1)
            masks = np.array([0, *ball(width, min(width, radius // parts))], dtype=np.uint64)
            self.tables.append((shift, width, own[:, None] ^ masks[None, :]))

    def anchors(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Positions whose shingle some item has."""
        at = np.flatnonzero(self.filter[size][(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        return at[np.isin(hashes[at], self.known[size][0])] if len(at) else at

    def near(self, prints: np.ndarray, among: np.ndarray) -> list[tuple[int, int]]:
        """(print's number, item's number) of all pairs within the radius, by one block at least; items ``among`` those that a text shares a shingle with."""
        found: set[tuple[int, int]] = set()
        for shift, width, values in self.tables:
            mine = values[among]
            order = np.argsort(mine, axis=None, kind="stable")
            table, items = mine.ravel()[order], np.repeat(among, mine.shape[1])[order]
            own = prints >> np.uint64(shift) & np.uint64((1 << width) - 1)
            lo, hi = np.searchsorted(table, own, "left"), np.searchsorted(table, own, "right")
            n = hi - lo
            who = np.repeat(np.arange(len(prints)), n)
            which = items[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            close = np.bitwise_count(prints[who] ^ self.prints[which]) <= self.radius
            found.update(zip(who[close].tolist(), which[close].tolist(), strict=True))
        return sorted(found)

    def search(self, threshold: float, hashes: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[float, int, int, int]]:
        """Item's number to (similarity, first word, words, distance) of its best window in a text; ``hashes``: by shingle size, the text's
        shingle hashes and anchors.

        Only windows with a shingle of some item are fingerprinted, and held against the items that have one of the text's shingles: all others have similarity zero.
        """
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, (own, anchors) in hashes.items():
            keys, of = self.known[size]
            for part in np.split(anchors, np.flatnonzero(np.diff(anchors // SPAN)) + 1):  # a span of the text at a time
                lo, hi = np.searchsorted(keys, own[part], "left"), np.searchsorted(keys, own[part], "right")
                shared = np.unique(np.concatenate([of[a:b] for a, b in zip(lo, hi, strict=True)])) if len(part) else np.zeros(0, np.int64)
                widths = np.array([min(len(self.items[k][3]), len(own)) for k in shared], dtype=np.int64)
                for width in np.unique(widths).tolist():
                    self._windows(own, part, size, width, shared[widths == width], threshold, best)
        return best

    def _windows(self, own: np.ndarray, anchors: np.ndarray, size: int, width: int, items: np.ndarray, threshold: float, best: dict) -> None:
        """The windows of ``width`` shingles over ``anchors`` against ``items`` of that width."""
        covers = np.zeros(int(anchors[-1] - anchors[0]) + width + 1, dtype=np.int32)
        np.add.at(covers, anchors - anchors[0], 1)
        np.add.at(covers, anchors - anchors[0] + width, -1)
        starts = np.flatnonzero(np.cumsum(covers) > 0) + int(anchors[0]) - width + 1
        starts = starts[(starts >= 0) & (starts + width <= len(own))]
        if not len(starts):
            return
        base, end = int(starts[0]), int(starts[-1]) + width
        prints, back = np.unique(window_prints(own[base:end], starts - base, width), return_inverse=True)
        order = np.argsort(back, kind="stable")
        cuts = np.searchsorted(back[order], np.arange(len(prints) + 1))
        for p, k in self.near(prints, items):
            item = self.items[k][3]
            distance = int(np.bitwise_count(prints[p] ^ self.prints[k]))
            for at in starts[order[cuts[p] : cuts[p + 1]]].tolist():
                got = similarity(own[at : at + width], item)
                if got >= threshold and (k not in best or (-got, at) < (-best[k][0], best[k][1])):
                    best[k] = got, at, width + size - 1, distance


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, radius: int = RADIUS, parts: int = PARTS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words, distance and t (a hash of the text): the best window of each text of ``docs`` (doc_id, text) for each item of
    ``benchmark`` (item_id, text) that it holds.

    Words are runs outside of white space, A-Z lower-cased. A window is as long as the item (or the whole text, if that is shorter), at every
    word of the text. Its SimHash over ``shingle``-word shingles (an item of fewer words: the whole item) is looked up
    in the multi-index table of the items' fingerprints, which finds all within ``radius`` bits; a pair counts if the weighted
    Jaccard similarity of the shingle multisets is ``threshold`` or more. Ties: the first window.

    The items are broadcast in blocks of about ``block_items`` or ``BLOCK_BYTES``, a pass over the texts each. Null and empty texts hold nothing, null and empty
    items are in nothing. Repeated rows give repeated results, null ids stay null, other columns are ignored, an empty table gives an empty table.
    """
    rows = few_rows(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), text_hash(docs).alias("t"))
    out = None
    for block in item_blocks(benchmark, block_items):
        one = _search(rows, block, threshold, shingle, radius, parts)
        out = one if out is None else out.unionAll(one)
    return out


def item_blocks(benchmark: DataFrame, block_items: int) -> list:
    """Broadcasts of (item_id, text), in blocks by a hash; one at least."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("binary").alias("text")).where("text is not null").distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["b"] // BLOCK_BYTES))
    out = []
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == block)
        out.append(context.broadcast(sorted(((r["item_id"], bytes(r["text"])) for r in part.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))))
    return out


class _Finder:
    """Finds items in batches of texts."""

    def __init__(self, items: list, threshold: float, shingle: int, radius: int, parts: int):
        self.bench, self.threshold, self.memo = Benchmark(items, shingle, radius, parts), threshold, _Hashes()

    def find(self, column: pa.Array) -> list[tuple]:
        """(row, item_id, similarity, first_word, n_words, distance) of every item found."""
        if len(self.memo) > 200_000:
            self.memo.clear()
        texts = [t.lower().split() for t in utf8(column)]
        ends = np.cumsum([len(t) for t in texts])
        flat = word_hashes([w for t in texts for w in t], self.memo)
        met: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        for size in self.bench.sizes:
            hashes = shingle_hashes(flat, size)
            at = self.bench.anchors(hashes, size)
            doc = np.searchsorted(ends, at, side="right")
            inside = at + size <= ends[doc] if len(at) else at > 0
            at, doc = at[inside], doc[inside]
            cuts = np.flatnonzero(np.diff(doc)) + 1
            for own in np.split(at, cuts) if len(at) else []:
                k = int(np.searchsorted(ends, own[0], side="right"))
                start = int(ends[k]) - len(texts[k])
                met.setdefault(k, {})[size] = hashes[start : int(ends[k]) - size + 1], own - start
        return [(k, self.bench.items[i][0], *v) for k in sorted(met) for i, v in sorted(self.bench.search(self.threshold, met[k]).items())]


def _search(rows: DataFrame, items, threshold: float, shingle: int, radius: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(items.value, threshold, shingle, radius, parts)
        kinds = [("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64())]
        for whole in batches:
            for batch in slices(whole, "text"):
                found = finder.find(batch.column("text"))
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *(pa.array([f[i + 1] for f in found], t) for i, (_, t) in enumerate(kinds)), batch.column("t").take(at)], ["doc_id", *(n for n, _ in kinds), "t"])

    return rows.mapInArrow(lambda b: releasing(run(b)), "doc_id long, item_id long, similarity double, first_word long, n_words long, distance long, t long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, radius: int = RADIUS, parts: int = PARTS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which :func:`find_contamination` finds no item. Narrow: no text is shuffled.

    Null and empty texts stay, repeated rows stay or go together, null ids play no part, an empty table gives an empty table.
    """
    for items in item_blocks(benchmark, block_items):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            finder = _Finder(items.value, threshold, shingle, radius, parts)
            for whole in batches:
                for batch in slices(whole, "text"):
                    keep = np.ones(batch.num_rows, dtype=bool)
                    keep[[f[0] for f in finder.find(batch.column("text"))]] = False
                    yield batch.filter(pa.array(keep))

        docs = few_rows(docs).mapInArrow(lambda b, run=run: releasing(run(b)), docs.schema)
    return docs
