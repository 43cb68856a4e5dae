"""SimHash fingerprints, multi-index Hamming search and near-duplicate components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_links, spanning
from .common import ROW, components, discard, few_rows, holding, materialize, only_rows, releasing, slices, text_hash, utf8, with_row

SEED = 42
#: For each byte a word of eight byte counters that holds its bits: 255 of them add up without overflow.
_SPREAD = np.array([sum(1 << (8 * j) for j in range(8) if b >> j & 1) for b in range(256)], dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of ``hashes`` (uint64); none gives zero."""
    n = len(hashes)
    if not n:
        return 0
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words; fewer words: the whole sequence; none: none."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, t (a hash of the text), fp (long) per row of ``docs`` (doc_id, text): the SimHash of ``size``-word shingles of the lower-cased (A-Z) text.

    Null and empty texts have fingerprint zero. Memory is that of some megabytes of text, or of the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for whole in batches:
            for batch in slices(whole, "text"):
                prints = [fingerprint_of(np.array([digest(s, SEED) for s in shingles(t.lower().split(), size)], dtype=np.uint64)) for t in utf8(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], ["doc_id", "t", "fp"])

    return few_rows(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], text_hash(docs).alias("t")).mapInArrow(lambda b: releasing(run(b)), "doc_id long, t long, fp long")


def segments_of(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of ``parts`` segments that make up 64 bits."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def ball(width: int, radius: int) -> list[int]:
    """The masks of 1 to ``radius`` bits in ``width``: a segment's neighbours are its exclusive ors with them."""
    return [sum(1 << i for i in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]


def hamming_links(prints: DataFrame, radius: int = 3, parts: int = 2) -> DataFrame:
    """(a, b): links that connect what fingerprints (``fp``, distinct) within ``radius`` bits connect.

    Multi-index hashing: two fingerprints within ``radius`` agree within ``radius // parts`` bits in one of ``parts`` segments.
    The table has each fingerprint under its segments; the probes are the small ball around each segment. A probe
    that hits no table entry goes; the rest meet the entries in their bucket, where whole distances are verified. ``discard`` of the
    result deletes what is written on the way.
    """
    tables, probes = [], []
    for k, (shift, width) in enumerate(segments_of(parts)):
        segment = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col("fp")
        own = prints.select(F.lit(k).alias("k"), segment.alias("v"), F.col("fp").alias("node"))
        tables.append(own)
        if masks := ball(width, radius // parts):
            probes.append(own.select("k", F.explode(F.array([F.lit(m).cast("long") for m in masks])).alias("m"), "v", "node").select("k", F.col("v").bitwiseXOR(F.col("m")).alias("v"), "node"))
    table = tables[0]
    for t in tables[1:]:
        table = table.unionAll(t)
    rows = table.withColumn("own", F.lit(True))
    if probes:
        probe = probes[0]
        for p in probes[1:]:
            probe = probe.unionAll(p)
        hits = materialize(probe.join(table.select("k", "v").distinct(), ["k", "v"], "left_semi"), "hits")
        rows = rows.unionAll(hits.withColumn("own", F.lit(False)))

    def verify(got: pa.Table, borders: np.ndarray) -> np.ndarray:
        fp = got.column("node").combine_chunks().to_numpy().view(np.uint64)
        own = got.column("own").combine_chunks().to_numpy(zero_copy_only=False)

        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (np.bitwise_count(fp[a] ^ fp[b]) <= radius) & (own[a] | own[b])

        def square(start: int, end: int) -> np.ndarray:
            f, o = fp[start:end], own[start:end]
            return (np.bitwise_count(f[:, None] ^ f[None, :]) <= radius) & (o[:, None] | o[None, :])

        return spanning(borders, pair, square)

    links = bucket_links(rows, ["k", "v"], verify)
    if probes:
        links._fieldgate_path = hits._fieldgate_path
    return links


def fingerprint_roots(docs: DataFrame, radius: int, size: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of the rows, fp and root of each fingerprint): equal fingerprints are one node, so groups of copies cost one row."""
    prints = materialize(fingerprints(docs, size), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = hamming_links(distinct.select("fp"), radius, parts)
    roots = components(links)
    discard(links)
    linked = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "linked")
    discard(roots)
    return prints, linked


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, parts: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row of ``docs`` (doc_id, text).

    Fingerprints within ``radius`` bits link; component_id is the smallest doc_id that links reach, found by
    :func:`hamming_links` and distributed union-find.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id give a row each. A null
    doc_id is kept, and is never a component_id unless the component has no other. Other columns are ignored; an empty
    table gives an empty table.
    """
    prints, linked = fingerprint_roots(docs, radius, size, parts)
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    known = linked.join(smallest, "root").select("fp", "component_id")
    return holding(prints.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"), prints, linked)


def keep_one(docs: DataFrame, radius: int = 3, size: int = 3, parts: int = 2) -> DataFrame:
    """``docs``, with all their columns, but of each component of :func:`near_duplicates` only one row: the one with the smallest doc_id (null last),
    among rows that repeat it the one whose text has the smallest hash. Of rows that agree in doc_id and text but not in other columns any one may stay.

    Null and empty texts are near duplicates of each other; an empty table gives an empty table.
    """
    prints, linked = fingerprint_roots(docs, radius, size, parts)
    rows = prints.join(linked.select("fp", "root"), "fp")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("t").alias("t")))
    chosen = materialize(rows.groupBy("root").agg(best.alias("b")).select(F.col("b.d").alias("doc_id"), F.col("b.t").alias("t")), "chosen")
    every = with_row(prints, F.col("t")).groupBy(*ROW, "doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    gone = materialize(every.join(with_row(chosen, F.col("t")).select(*ROW, F.lit(True).alias("stays")), ROW, "left").where("stays is null or n > 1"), "gone")
    kept = only_rows(docs, gone.where("stays is null"), "left_anti", prints, chosen)
    twice = gone.where("stays and n > 1").limit(1).count()
    discard(gone)
    return holding(with_row(kept, text_hash(kept)).dropDuplicates(ROW).select(*docs.columns), kept) if twice else kept
