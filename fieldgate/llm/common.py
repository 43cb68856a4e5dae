"""What the corpus operators share: the shared folder, cut lineage, Arrow mapping and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of this machine only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='fieldgate-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there, no executor's loss costs it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldgate/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])).parquet(path)
    out._fieldgate_path = path
    return out


def holding(df: DataFrame, *tables: DataFrame | None) -> DataFrame:
    """``df``, knowing the written ``tables`` that it still reads: :func:`discard` of it deletes them."""
    df._fieldgate_tables = [t for t in tables if t is not None]
    return df


def discard(*frames: DataFrame | None) -> None:
    """Delete tables written by :func:`materialize`, and those that a result holds, once nothing reads them any more."""
    for df in frames:
        discard(*getattr(df, "_fieldgate_tables", ()))
        path = getattr(df, "_fieldgate_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of an Arrow batch: what a task holds of texts at once, on the JVM's side and on Python's.
BATCH_ROWS = 1_000


def few_rows(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have ``BATCH_ROWS`` rows at most, or fewer if it is set so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system: worker processes are used again, and the driver goes on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, then :func:`give_back`."""
    yield from batches
    give_back()


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, so that a worker's memory does not follow the batch."""
    lengths = pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0)
    start, size = 0, 0
    for i, n in enumerate(lengths.to_pylist()):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by ``keys``: tables that end where a key ends, with the group borders (first rows and the end).

    Groups must be of bounded size; callers split larger ones by an additional key first.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def borders(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            v = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        change[0] = True
        return np.append(np.flatnonzero(change), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held)
        at = borders(table)
        cut = int(at[-2])
        if cut:
            yield table.slice(0, cut), at[:-1]
            rest = table.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
        else:
            held = table.combine_chunks().to_batches()
    if rows:
        table = pa.Table.from_batches(held)
        yield table, borders(table)


def forest(adjacent: np.ndarray, firsts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a boolean adjacency matrix, as two arrays of indices: at most n - 1 edges."""
    n = len(adjacent)
    seen = np.zeros(n, dtype=bool)
    left: list[int] = []
    right: list[int] = []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(adjacent[at] & ~seen)
            if len(new):
                seen[new] = True
                left += [at] * len(new)
                right += new.tolist()
                front += new.tolist()
    return np.asarray(left, dtype=np.int64), np.asarray(right, dtype=np.int64)


#: What identifies a row of documents where two tables meet: doc_id (and whether it is null) and a hash of the text.
ROW = ["__row_doc_id", "__row_null", "__row_text"]


def text_hash(docs: DataFrame):
    return F.xxhash64(docs["text"])


def with_row(df: DataFrame, t) -> DataFrame:
    return df.withColumns(dict(zip(ROW, (F.coalesce(df["doc_id"].cast("long"), F.lit(0)), df["doc_id"].isNull(), t), strict=True)))


#: Rows of a join's small side, of some numbers each, that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has ``most`` rows at most; a join shuffles it otherwise. For written tables: it is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def only_rows(docs: DataFrame, found: DataFrame, how: str = "left_semi", *tables: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found`` (doc_id, t) names, or with left_anti those that it doesn't. Texts stay where they are unless ``found``
    is too large to broadcast. The result holds ``tables``, which ``found`` reads, no more than until they are not needed."""
    named = materialize(with_row(found, F.col("t")).select(*ROW).distinct(), "named")
    discard(*tables)
    return holding(with_row(docs, text_hash(docs)).join(small(named), ROW, how).select(*docs.columns), named)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (a, b): root is the smallest node of its connected component.

    Distributed union-find by alternating large-star and small-star steps; each round is written to the
    shared folder, and the one before it deleted. Minima are aggregated before the shuffle and go to the joins by a shuffle of their own (rebalanced),
    so that both sides of a join are plain shuffles, whose partitions adaptive execution splits where a hub has many neighbours.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    kind = dict(now.dtypes)["a"]
    before = None
    for _ in range(rounds):
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).hint("rebalance")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node's smaller neighbours and the node itself go to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.hint("rebalance"), "a").select(F.col("b").alias("x"), "m").where("x <> m").unionAll(down.select(F.col("a").alias("x"), "m"))
        new = materialize(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        sign = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s"))
        mark = new.agg(sign.alias("x")).first()["x"]
        discard(now)
        now = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return holding(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots).select(F.col("node").cast(kind), F.col("root").cast(kind)), now)
