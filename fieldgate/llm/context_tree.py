"""Language-model scoring: context-tree weighting over binary-decomposed bytes, and a unigram base score."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few_rows, give_back, holding, materialize, releasing, slices
from .grams import END, HOT_GRAMS, GramCounts, Logs, broadcast_hot, by_bucket, byte_grams, cold_sums, in_parts, mask
from .words import Words, coded, hot_from, lists, per_text, sums, word_counts

#: Context bytes.
DEPTH = 5
#: Context bytes that name a bucket of grams. What a bucket's nodes have beyond is three bytes, so that 2^24 grams are its bound.
BUCKET_BYTES = 3
#: Documents for each bucket.
DOCS_A_BUCKET = 2_000
#: Words whose counts are broadcast, the most frequent ones; all others are joined.
HOT_WORDS = 200_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    back = np.log(x)
    for k in range(1, 8):
        back += np.log(x + k)
    return series - back


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with ``a`` zeros and ``b`` ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - log(np.pi)


class Nodes:
    """The nodes of one depth at which as many bits of the next byte are known: sorted ids (context, then these bits), zeros and ones met.

    A node's weighted probability is half its own KT probability and half the product of its longer contexts' (``longer``, their logs' sum; none at
    the full depth). ``weight`` is the own part's share of it.
    """

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, longer: np.ndarray | None = None):
        self.ids, self.a, self.b = ids, a.astype(float), b.astype(float)
        own = log_kt(self.a, self.b)
        self.weighted = own if longer is None else np.logaddexp(own, longer) - log(2)
        self.weight = np.ones(len(ids)) if longer is None else np.minimum(np.exp(own - log(2) - self.weighted), 1)

    def below(self, bits: int) -> tuple[np.ndarray, ...]:
        """ids, a, b, longer of the nodes that these are the longer contexts of: those with the last ``bits`` bits of their ids."""
        ids, at = np.unique(self.ids & ((1 << bits) - 1), return_inverse=True)
        return ids, *(np.bincount(at, x, len(ids)) for x in (self.a, self.b, self.weighted))

    def mix(self, shorter: Nodes | None, bits: int) -> None:
        """Logs of a one (``l1``) and a zero (``l0``) where this node is the deepest known of its path, and what the path has mixed so far: both
        bits' sums and the weight that is left. Both bits are summed, so that neither is lost where the other is nearly certain."""
        if shorter is None:
            s1, s0, rest = np.zeros(len(self.ids)), np.zeros(len(self.ids)), np.ones(len(self.ids))
        else:
            at = np.searchsorted(shorter.ids, self.ids & ((1 << bits) - 1))
            s1, s0, rest = shorter.s1[at], shorter.s0[at], shorter.rest[at]
        n = self.a + self.b + 1
        one, zero = (self.b + 0.5) / n, (self.a + 0.5) / n
        self.l1, self.l0 = np.log(s1 + rest * one), np.log(s0 + rest * zero)
        part = rest * self.weight
        self.s1, self.s0, self.rest = s1 + part * one, s0 + part * zero, rest - part


class Tree:
    """The levels of a context tree from ``depth`` down to ``lowest``, for the grams whose contexts end alike, or all."""

    def __init__(self, depth: int, lowest: int, deepest: list[Nodes]):
        self.depth, self.lowest = depth, lowest
        self.levels = {(depth, j): nodes for j, nodes in enumerate(deepest)}
        for d in range(depth - 1, lowest - 1, -1):
            for j in range(8):
                self.levels[d, j] = Nodes(*self.levels[d + 1, j].below(8 * d + j))

    @classmethod
    def of_grams(cls, grams: np.ndarray, n: np.ndarray, depth: int, lowest: int) -> Tree:
        """From sorted grams (``depth`` context bytes, then a byte) and how often they occur."""
        deepest = []
        for j in range(8):
            ids = grams >> (8 - j)
            at = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
            total, ones = (np.add.reduceat(x, at) if len(at) else x for x in (n, n * (grams >> (7 - j) & 1)))
            deepest.append(Nodes(ids[at], total - ones, ones))
        return cls(depth, lowest, deepest)

    def shorter(self) -> tuple[np.ndarray, ...]:
        """key (bits known, then id), a, b, longer: what these grams add to the nodes below the lowest level."""
        parts = [self.levels[self.lowest, j].below(8 * (self.lowest - 1) + j) for j in range(8)]
        return np.concatenate([(j << 40) + p[0] for j, p in enumerate(parts)]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))

    def mix(self, top: Tree | None) -> Tree:
        """Mix all levels, from the ``top`` levels on, which are then part of this tree."""
        if top is not None:
            self.levels |= top.levels
        for d in range(self.lowest, self.depth + 1):
            for j in range(8):
                self.levels[d, j].mix(self.levels.get((d - 1, j)), 8 * (d - 1) + j)
        return self

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """ln of the probability of each gram's last byte: each bit from the deepest node of its path that is known; nothing known: 1/2."""
        out = np.zeros(len(grams))
        for j in range(8):
            one, value, open_ = grams >> (7 - j) & 1, np.full(len(grams), log(0.5)), np.arange(len(grams))
            for d in range(self.depth, -1, -1):
                nodes = self.levels.get((d, j))
                if nodes is None or not len(nodes.ids) or not len(open_):
                    continue
                ids = (grams[open_] & mask(d + 1)) >> (8 - j)
                at = np.minimum(np.searchsorted(nodes.ids, ids), len(nodes.ids) - 1)
                hit = nodes.ids[at] == ids
                at, met = at[hit], open_[hit]
                value[met] = np.where(one[met] == 1, nodes.l1[at], nodes.l0[at])
                open_ = open_[~hit]
            out += value
        return out


def top_tree(rows: DataFrame, lowest: int) -> Tree | None:
    """The mixed levels below ``lowest`` from the sums (up, a, b, lc) of what buckets add to them: with contexts of two bytes, 65,536 contexts of 255
    nodes at most, of which UTF-8 text has some hundred thousand."""
    if not lowest:
        return None
    got = rows.groupBy("up").agg(*(F.sum(c).alias(c) for c in ("a", "b", "lc"))).sort("up").toArrow()
    key, a, b, longer = (got.column(c).to_numpy() for c in ("up", "a", "b", "lc"))
    cuts = np.searchsorted(key, np.arange(9) << 40)
    deepest = [Nodes(key[x:y] - (j << 40), a[x:y], b[x:y], longer[x:y]) for j, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return Tree(lowest - 1, 0, deepest).mix(None)


def gram_buckets(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """bucket, grams, trained, held: the sorted distinct grams of a bucket (of the last context bytes) and how often training and other texts of ``docs`` (text,
    held_out) have them, packed (8 bytes each), a row each; and rows up, a, b, lc: what a bucket adds to the tree's levels below (:meth:`Tree.shorter`).

    Counts are summed per task before they travel, packed by bucket: a count costs its bytes and no row of the shuffle."""
    lowest = min(BUCKET_BYTES, depth)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = GramCounts()  # of a gram and a bit: held out?

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = counts.take()
            place = ((keys >> 9 & mask(lowest)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % buckets
            order, at = by_bucket(place)
            parts = [order[a:b] for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([place[p[0]] for p in parts], pa.int64()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([n[p].tobytes() for p in parts], pa.binary())], ["bucket", "keys", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                grams, borders = byte_grams(*Words(batch.column("text")).events(depth, END[0]), depth)
                held = np.repeat(batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(borders))
                counts.add(grams << 1 | held)
                if len(counts) > 3_000_000:
                    yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, GramCounts()

        def bucket() -> Iterator[pa.RecordBatch]:
            keys, n = counts.take()
            grams, where = np.unique(keys >> 1, return_inverse=True)
            held = np.bincount(where, n * (keys & 1), len(grams)).astype(np.int64)
            trained = np.bincount(where, n, len(grams)).astype(np.int64) - held
            own = trained > 0
            up = Tree.of_grams(grams[own], trained[own], depth, lowest).shorter() if lowest else (np.zeros(0),) * 4
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (grams, trained, held)]
            yield pa.RecordBatch.from_arrays([pa.array([at]), *blobs, *(pa.nulls(1, t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names)
            yield from in_parts(dict(zip(names, [pa.nulls(len(up[0]), pa.int64()), *[pa.nulls(len(up[0]), pa.binary())] * 3, pa.array(up[0], pa.int64()), *(pa.array(x, pa.float64()) for x in up[1:])], strict=True)))

        names = ["bucket", "grams", "trained", "held", "up", "a", "b", "lc"]
        for batch in batches:
            for own, keys, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "n")), strict=True):
                if own != at and at is not None:
                    yield from bucket()
                at = own
                counts.held.append((np.frombuffer(keys, dtype=np.int64), np.frombuffer(n, dtype=np.int64)))
                if len(counts.held) > 64:
                    counts.held = [counts.merged()]
        if at is not None:
            yield from bucket()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("text", "held_out").mapInArrow(lambda b: releasing(count(b)), "bucket long, keys binary, n binary")
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: releasing(merge(b)), "bucket long, grams binary, trained binary, held binary, up long, a double, b double, lc double")


def gram_logs(buckets: DataFrame, depth: int) -> DataFrame:
    """gram, n, log of all grams in ``buckets``: how often all texts have it, and ln of the probability that the tree of the training texts gives to its last byte."""
    lowest = min(BUCKET_BYTES, depth)
    top = buckets.sparkSession.sparkContext.broadcast(top_tree(buckets.where("up is not null").select("up", "a", "b", "lc"), lowest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in zip(*(batch.column(c).to_pylist() for c in ("grams", "trained", "held")), strict=True):
                grams, trained, held = (np.frombuffer(x, dtype=np.int64) for x in cells)
                own = trained > 0
                tree = Tree.of_grams(grams[own], trained[own], depth, lowest).mix(top.value)
                yield from in_parts({"gram": pa.array(grams), "n": pa.array(trained + held), "log": pa.array(tree.logs(grams))})

    return buckets.where("up is null").select("grams", "trained", "held").mapInArrow(lambda b: releasing(run(b)), "gram long, n long, log double")


def lm_scores(docs: DataFrame, remainder: int = 2, modulus: int = 7, depth: int = DEPTH, hot_grams: int = HOT_GRAMS, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_code_bytes, bits_per_byte per row of ``docs`` (doc_id, text).

    Training texts are those whose crc32(doc_id as text) mod ``modulus`` is not ``remainder``. Tokens are the words of the text with A-Z
    lower-cased, then one end. base_score is the unigram log10 probability with add-one smoothing. score is the log10 probability of
    the same tokens as bytes (words with single spaces, then a newline) under context-tree weighting of ``depth`` context bytes, trained
    on all training texts; bits_per_byte is its code length over n_code_bytes. The two predict the same event. Where a path leaves the known tree,
    the weight that is left goes to its deepest known node's estimate, not to the 1/2 of a node without data.

    Grams and words are counted over all texts, summed per task before the shuffle. Each distinct gram's log is worked out once, in the bucket of its context's
    last bytes; logs and counts are then joined to the texts' frequencies. Of both, the most frequent, ``hot_grams`` and ``hot_words`` at most, are
    broadcast, so that no frequent one is a key of the join.

    Null text counts as empty: one token, the end. A null doc_id is kept and trained on. Repeated rows count and score as often as they
    are there. Other columns are ignored; an empty table gives an empty table, texts without training texts score 0.5 a bit.
    """
    context = docs.sparkSession.sparkContext
    held = F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))
    rows = few_rows(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), held.alias("held_out"))
    size = {r["held_out"]: r["count"] for r in rows.groupBy("held_out").count().collect()}
    buckets = materialize(gram_buckets(rows, depth, max(256, sum(size.values()) // DOCS_A_BUCKET)), "buckets")
    known = materialize(gram_logs(buckets, depth), "known")
    discard(buckets)
    words = materialize(word_counts(rows.where(~F.col("held_out"))), "words")

    ends = size.get(False, 0)  # an end for each training text
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, distinct = total["n"] + ends, total["v"] + (ends > 0)
    least_word, least_gram = hot_from(words, hot_words), hot_from(known, hot_grams)
    frequent = words.where(F.col("n") >= least_word).toArrow()
    hot = context.broadcast((pa.concat_arrays([*frequent.column("word").chunks, pa.array([], pa.binary())]), np.log10(frequent.column("n").to_numpy() + 1.0)))
    logs = broadcast_hot(known, least_gram)
    del frequent
    give_back()
    scored = materialize(_scored(rows, logs, hot, depth, ends, train_tokens + distinct + 1), "scored")
    pairs = scored.select("rid", F.explode("cold_words").alias("c")).select("rid", F.col("c.word").alias("word"), F.col("c.n").alias("m"))
    rare = words.where(F.col("n") < least_word)
    more = pairs.join(rare, "word").groupBy("rid").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("cold_score"), F.sum("m").alias("cold_known"))
    out = scored.drop("cold_words", "cold_grams").join(more, "rid", "left").join(cold_sums(scored, "rid", "cold_grams", known, least_gram), "rid", "left")
    score = (F.col("hot_log") + F.coalesce("more", F.lit(0.0))) / F.lit(log(10))
    out = out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("cold_score", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        "n_code_bytes",
        (-score * F.lit(float(np.log2(10))) / F.col("n_code_bytes")).alias("bits_per_byte"),
    )
    return holding(out, scored, words, known)


def _scored(rows: DataFrame, logs, hot, depth: int, ends: int, size: int) -> DataFrame:
    """A row per text, numbered: the sums over frequent words and grams, and the other ones with their frequencies. ``ends``: how often the end is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_logs = Logs(*logs.value)
        frequent, values = hot.value
        rid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text"):
                words, n_rows = Words(batch.column("text")), batch.num_rows
                hot_log, cold_grams = gram_logs.sums(*(got := byte_grams(*words.events(depth, END[0]), depth)))
                codes, distinct = coded(frequent, words.array())
                rare = codes >= len(values)
                base = sums(np.append(values, np.zeros(len(distinct) - len(values)))[codes], words.borders) + np.log10(ends + 1.0)
                n_tokens = np.diff(words.borders) + 1
                found = sums((~rare).astype(np.int64), words.borders) + (ends > 0)
                text, code, n = per_text(codes[rare], np.searchsorted(np.flatnonzero(rare), words.borders), len(distinct))
                cold_words = lists(text, n_rows, {"word": distinct.take(pa.array(code)), "n": pa.array(n)})
                columns = {"rid": pa.array(np.arange(rid, rid + n_rows)), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(n_tokens), "hot_known": pa.array(found), "base_score": pa.array(base - n_tokens * np.log10(size))}
                columns |= {"hot_log": pa.array(hot_log), "n_code_bytes": pa.array(np.diff(got[1])), "cold_words": cold_words, "cold_grams": cold_grams}
                yield pa.RecordBatch.from_pydict(columns)
                rid += n_rows

    kinds = "rid long, doc_id long, held_out boolean, n_tokens long, hot_known long, base_score double, hot_log double, n_code_bytes long, cold_words array<struct<word:binary,n:long>>, cold_grams array<struct<gram:long,n:long>>"
    return rows.mapInArrow(lambda b: releasing(run(b)), kinds)


def is_held_out(doc_id: int, remainder: int = 2, modulus: int = 7) -> bool:
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder
