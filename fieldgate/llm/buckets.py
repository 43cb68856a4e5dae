"""Links inside candidate buckets of any size: large buckets are dealt out in blocks, and a block pair yields a forest only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest, grouped, releasing

#: Rows of a block: a task holds two blocks of a bucket at most.
BLOCK = 512


def bucket_links(rows: DataFrame, keys: list[str], verify: Callable[[pa.Table, np.ndarray], np.ndarray], block: int = BLOCK) -> DataFrame:
    """(a, b) links between nodes that share a bucket.

    ``rows`` has the bucket's ``keys``, ``node`` (long) and what ``verify`` needs. ``verify(rows, borders)`` gets rows of whole
    (part) buckets and returns pairs of row numbers, shape (n, 2), that span the verified links of each part. A bucket
    of more than ``block`` rows is dealt by a hash of the node into blocks, and every pair of blocks meets in a
    group of its own: no link is lost, no task gets a whole large bucket, and no group emits more links than rows.
    """
    spark = rows.sparkSession
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = rows.join(several, keys)
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    met = met.withColumn("_of", blocks).withColumn("_own", F.expr("cast(pmod(xxhash64(node, 7), _of) as int)"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    met = met.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    by = [*keys, "_lo", "_hi"]
    met = met.drop("_n", "_of", "_own", "_other").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in grouped(batches, by, 1 << 14):
            pairs = verify(table, borders)
            node = table.column("node").combine_chunks().to_numpy()
            a, b = node[pairs[:, 0]], node[pairs[:, 1]]
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return met.mapInArrow(lambda b: releasing(run(b)), "a long, b long").distinct()


#: Groups of up to this many rows are searched from row to row, which seldom needs more pairs than rows; larger ones by their matrix.
FEW = 24


def reached(start: int, size: int, pair: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of a small group: each row found is held against the rows not found yet."""
    left, out = list(range(start, start + size)), []
    while left:
        front = [left.pop(0)]
        while front and left:
            at = front.pop()
            hit = pair(np.full(len(left), at), np.array(left))
            found = [x for x, h in zip(left, hit.tolist(), strict=True) if h]
            left = [x for x, h in zip(left, hit.tolist(), strict=True) if not h]
            out += [(at, x) for x in found]
            front += found
    return out


def spanning(borders: np.ndarray, pair: Callable[[np.ndarray, np.ndarray], np.ndarray], square: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """Pairs of row numbers that span the links of each group: groups of two all at once by ``pair``, small ones by :func:`reached`, others by their
    ``square`` matrix."""
    sizes = np.diff(borders)
    two = borders[:-1][sizes == 2]
    out = [np.stack([two, two + 1], axis=1)[pair(two, two + 1)]] if len(two) else []
    small: list[tuple[int, int]] = []
    for k in np.flatnonzero(sizes > 2).tolist():
        start = int(borders[k])
        if sizes[k] <= FEW:
            small += reached(start, int(sizes[k]), pair)
        else:
            a, b = forest(square(start, int(borders[k + 1])))
            out.append(np.stack([a, b], axis=1) + start)
    if small:
        out.append(np.array(small, dtype=np.int64))
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
