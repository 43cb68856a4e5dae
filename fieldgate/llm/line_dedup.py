"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard verification, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_links, spanning
from .common import ROW, components, discard, few_rows, holding, materialize, releasing, slices, small, text_hash, utf8, with_row

SHINGLE = 5
THRESHOLD = 0.8
#: Bands and rows: a pair at Jaccard 0.8 shares a band with probability 0.996, one at 0.85 with 0.9998, one at 0.1 with 0.00002.
BANDS, ROWS = 18, 6
#: Documents for each bucket of bands: about 15 MB of packed pairs.
DOCS_A_BUCKET = 5_000
#: Slots of the bitmap that picks candidate lines when texts are read again: at most this many numbers reach the driver.
BITMAP = 1 << 22
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


_LOWER = bytes(32 if b in b"\t\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal(line: bytes) -> bytes:
    """A-Z lower-cased, runs of white space as one space, none at the ends."""
    return b" ".join(line.translate(_LOWER).split())


def lines_of(text: bytes) -> tuple[list[int], list[bytes]]:
    """Numbers and normal forms of the \\n-split lines that have a word: whole texts are translated at once, lines seldom need more than a strip."""
    numbers, lines = [], []
    for i, x in enumerate(text.translate(_LOWER).split(b"\n")):
        x = x.strip(b" ")
        if b"  " in x:
            x = b" ".join(x.split())
        if x:
            numbers.append(i)
            lines.append(x)
    return numbers, lines


def line_hashes(lines: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, 11) for x in lines], dtype=np.uint64).view(np.int64)


def shingle_hashes(lines: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lines' shingles of ``size`` characters (a shorter line is one shingle), flat, and where lines start."""
    texts = [x.decode("utf-8", "replace").ljust(size, "\0") for x in lines]
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - size + 1
    h = codes[:n].copy()
    for k in range(1, size):
        h *= np.uint64(0x100000001B3)
        h += codes[k : n + k]
    h *= _FACTOR
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    ends = np.cumsum(counts)
    keep = np.ones(len(codes), dtype=bool)
    for k in range(1, size):
        keep[ends - k] = False
    own = counts - size + 1
    return h[keep[:n]], np.cumsum(own) - own


def signatures(hashes: np.ndarray, starts: np.ndarray, permutations: int, block: int = 1 << 16) -> np.ndarray:
    """MinHash signatures, a row per line, from ``permutations`` multiplicative permutations of 32-bit hashes."""
    rng = np.random.default_rng(20_240_601)
    a = rng.integers(0, 1 << 31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, permutations, dtype=np.uint64).astype(np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((permutations, len(starts)), dtype=np.uint32)
    borders = np.append(starts, len(x))
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(borders, borders[at] + block, "right")) - 1)
        part = x[borders[at] : borders[end]]
        local, buffer = borders[at:end] - borders[at], np.empty_like(part)
        for k in range(permutations):
            np.multiply(part, a[k], out=buffer)
            np.bitwise_xor(buffer, b[k], out=buffer)
            out[k, at:end] = np.minimum.reduceat(buffer, local)
        at = end
    return out.T


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each line and band."""
    s = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _FACTOR, s.shape[:2]).copy()
    for k in range(rows):
        h ^= s[:, :, k]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def band_pairs(docs: DataFrame, bands: int, rows: int, shingle: int, buckets: int) -> DataFrame:
    """bucket, pairs: (key, h) of every band of every line, as packed 16-byte pairs by a bucket of the key.

    A task sends each bucket one binary value now and then, so that a pair costs 16 bytes of shuffle and no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            pairs = np.concatenate(held)
            held.clear()
            bucket = (pairs[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            pairs, bucket = pairs[order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            offsets = np.append(at, len(pairs)).astype(np.int64) * 16
            blob = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(pairs))])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), blob.cast(pa.binary())], ["bucket", "pairs"])

        for whole in batches:
            for batch in slices(whole, "text"):
                if len(seen) > 1_000_000:
                    seen.clear()
                lines = list({x for text in utf8(batch.column("text")) for x in lines_of(text)[1]})
                new = {h: x for h, x in zip(line_hashes(lines).tolist(), lines, strict=True) if h not in seen}
                seen.update(new)
                if new:
                    keys = band_keys(signatures(*shingle_hashes(list(new.values()), shingle), bands * rows), bands, rows)
                    held.append(np.stack([keys.ravel(), np.repeat(np.fromiter(new, dtype=np.int64), bands)], axis=1))
                if sum(map(len, held)) > 2_000_000:
                    yield from flush()
        yield from flush()

    return few_rows(docs).select("text").mapInArrow(lambda b: releasing(run(b)), "bucket long, pairs binary")


def shared_bands(packed: DataFrame) -> DataFrame:
    """key, h of the bands that two lines or more share. A task takes a bucket at a time; buckets are many enough to be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def met() -> pa.RecordBatch:
            pairs = np.concatenate(held)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            same = (pairs[1:] == pairs[:-1]).all(axis=1)
            pairs = pairs[np.concatenate([[True], ~same])]
            like = pairs[1:, 0] == pairs[:-1, 0]
            pairs = pairs[np.concatenate([[False], like]) | np.concatenate([like, [False]])]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "h"])

        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                if bucket != at and held:
                    yield met()
                    held = []
                at = bucket
                held.append(np.frombuffer(blob, dtype=np.int64).reshape(-1, 2))
        if held:
            yield met()

    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: releasing(run(b)), "key long, h long")


def line_table(docs: DataFrame, wanted: np.ndarray, bitmap: int) -> DataFrame:
    """rid, doc_id, t (a hash of the text), line_no, h of every line with a word, and its normal form, where its hash is in the slots ``wanted`` and
    the task hasn't given it before: all wanted lines, and some others."""
    table = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(bitmap, dtype=bool)
        slots[table.value] = True
        rid = TaskContext.get().partitionId() << 33
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                if len(seen) > 1_000_000:
                    seen.clear()
                number, lines, counts = [], [], []
                for text in utf8(batch.column("text")):
                    n, x = lines_of(text)
                    number += n
                    lines += x
                    counts.append(len(n))
                h = line_hashes(lines)
                given = [None] * len(lines)
                maybe = np.flatnonzero(slots[h & (bitmap - 1)])
                for i, own in zip(maybe.tolist(), h[maybe].tolist(), strict=True):
                    if own not in seen:
                        seen.add(own)
                        given[i] = lines[i]
                doc = np.repeat(np.arange(len(counts)), counts)
                at = pa.array(doc)
                columns = [pa.array(doc + rid), batch.column("doc_id").take(at), batch.column("t").take(at), pa.array(number, pa.int32()), pa.array(h), pa.array(given, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "t", "line_no", "h", "line"])
                rid += batch.num_rows

    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), text_hash(docs).alias("t"))
    return read.mapInArrow(lambda b: releasing(run(b)), "rid long, doc_id long, t long, line_no int, h long, line binary")


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    h = np.sort(hashes)
    keep = np.empty(len(h), dtype=bool)
    keep[:1] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def jaccard_links(table: pa.Table, borders: np.ndarray, threshold: float, shingle: int) -> np.ndarray:
    """Pairs of row numbers that span the links of each group, by the exact Jaccard similarity of their lines' shingle sets."""
    lines = table.column("line").to_pylist()
    hashes, starts = shingle_hashes(lines, shingle)
    bounds = np.append(starts, len(hashes)).tolist()
    sets = [distinct(hashes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    sizes = np.array([len(s) for s in sets])

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]):
                both = np.sort(np.concatenate([sets[i], sets[j]]))
                shared = int((both[1:] == both[:-1]).sum())
                out[k] = shared >= threshold * (len(both) - shared)
        return out

    def square(start: int, end: int) -> np.ndarray:
        own = sets[start:end]
        flat = np.concatenate(own)
        words, at = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(own)), sizes[start:end])
        shared = np.zeros((len(own), len(own)), dtype=np.float32)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        for lo in range(0, len(words), 8192):  # a slice of the shingles at a time
            a, b = np.searchsorted(at, [lo, lo + 8192])
            part = np.zeros((len(own), min(8192, len(words) - lo)), dtype=np.float32)
            part[row[a:b], at[a:b] - lo] = 1
            shared += part @ part.T
        total = sizes[start:end, None] + sizes[None, start:end] - shared
        return shared >= threshold * total - 1e-6

    return spanning(borders, pair, square)


def line_components(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bitmap: int = BITMAP) -> DataFrame:
    """doc_id, line_no, line_id, component_id, kept of every line with a word of ``docs`` (doc_id, text): a row per line, line_no from 0.

    Lines are the \\n-split parts of whole texts, compared in normal form (A-Z lower-cased, white space collapsed) by the Jaccard similarity of
    their sets of ``shingle`` characters: ``threshold`` or more links two lines. line_id is a 64-bit hash of the normal form; equal
    lines are one node. component_id is the smallest line_id that links reach. kept is true for one line of each component: the
    first by doc_id (null last), then by line_no; of rows that repeat a doc_id any one may come first.

    MinHash signatures of ``bands`` x ``rows`` give bands; lines that share a band are candidates. Bands with the same members count
    once. Candidates' texts are read again and verified exactly, in blocks inside large bands, and distributed
    union-find makes the components.

    Null, empty and blank texts have no lines. Lines shorter than a shingle are one shingle. Repeated rows have their lines twice, one of
    them kept. Other columns are ignored; an empty table gives an empty table.
    """
    buckets = max(512, docs.count() // DOCS_A_BUCKET)
    shared = materialize(shared_bands(band_pairs(docs, bands, rows, shingle, buckets)), "shared")
    sets = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.bit_xor("h").alias("x"))
    once = sets.groupBy("n", "lo", "hi", "x").agg(F.min("key").alias("key")).select("key")
    candidates = materialize(shared.join(once, "key", "left_semi"), "candidates")
    discard(shared)
    wanted = candidates.select(F.col("h").bitwiseAND(F.lit(bitmap - 1)).cast("int").alias("b")).distinct().toArrow().column("b").to_numpy()
    lines = materialize(line_table(docs, wanted, bitmap), "lines")
    texts = lines.where("line is not null").select("h", "line").join(candidates.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    bucket = candidates.join(texts, "h").select("key", F.col("h").alias("node"), "line")
    links = bucket_links(bucket, ["key"], lambda t, b: jaccard_links(t, b, threshold, shingle), block=256)
    roots = components(links)
    discard(candidates)
    known = lines.drop("line").join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "rid", "line_no")
    first = known.groupBy("root").agg(F.min(place).alias("first")).select("first.rid", "first.line_no", F.lit(True).alias("kept"))
    # joined by the line's place, not by its component, which may hold a third of all lines
    out = known.join(first, ["rid", "line_no"], "left").select("doc_id", "line_no", F.col("h").alias("line_id"), F.col("root").alias("component_id"), F.coalesce("kept", F.lit(False)).alias("kept"), "t")
    return holding(out, lines, roots)


#: Line numbers that the join which removes lines broadcasts at most; more are shuffled, and texts with them.
BROADCAST_LINES = 4_000_000


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all its columns, and of each component of lines only the one that :func:`line_components` keeps.

    Blank lines stay. A row all of whose lines are kept elsewhere goes; rows without a line (null, empty and blank texts) stay as they are. Rows that repeat both
    doc_id and text become one, whose lines are those that any of them keeps; where they differ in other columns any one may stay. n_chars, where there is one, is counted
    again. An empty table gives an empty table.
    """
    components = line_components(docs, **options)
    found = materialize(components, "line_components")
    discard(components)
    by = ROW
    lines = with_row(found, F.col("t")).groupBy(*by, "line_no").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = lines.groupBy(*by).agg(F.max("n").alias("__row_n"), F.collect_list(F.when(~F.col("kept"), F.col("line_no"))).alias("__row_gone"))
    gone = materialize(gone.where((F.size("__row_gone") > 0) | (F.col("__row_n") > 1)), "gone")
    discard(found)
    rows = with_row(docs, text_hash(docs))
    if gone.where("__row_n > 1").limit(1).count():
        rows = rows.dropDuplicates(by)
    numbers = gone.agg(F.coalesce(F.sum(F.size("__row_gone")), F.lit(0))).first()[0]
    rows = rows.join(small(gone.drop("__row_n")) if numbers <= BROADCAST_LINES else gone.drop("__row_n"), by, "left")
    rows = rows.withColumn("__row_lines", F.when(F.size("__row_gone") > 0, F.split("text", "\n")))
    # array_except and an element's place take time in proportion to the lines
    rows = rows.withColumn("__row_numbers", F.array_except(F.sequence(F.lit(0), F.size("__row_lines") - 1), "__row_gone"))
    rows = rows.withColumn("__row_stay", F.transform("__row_numbers", lambda i: F.col("__row_lines")[i]))
    rows = rows.where(F.col("__row_stay").isNull() | F.exists("__row_stay", lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    rows = rows.withColumn("text", F.coalesce(F.array_join("__row_stay", "\n"), "text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__row_stay").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return holding(rows.select(*docs.columns), gone)
