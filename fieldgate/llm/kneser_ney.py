"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, against quantiles by language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, few_rows, grouped, holding, materialize, only_rows, releasing, slices, small, text_hash
from .grams import HOT_GRAMS, GramCounts, byte_grams, in_parts, log_sums, look_up, mask, padded

#: Bytes of an n-gram.
ORDER = 5
#: Quantile of the trusted texts' deviation by language, the least that a text may have; labelled bad texts choose among it and those above.
QUANTILE = 0.99
#: Quantiles that labelled bad texts choose from.
CHOICES = (0.99, 0.9925, 0.995, 0.9975, 0.999)
#: Parts of the texts to fit on, by a hash of doc_id. One is held out of a model of the others, under which it shows what unseen good texts have.
HELD_OUT = 3
#: Bytes at which a text may deviate twice as much as a very long one.
SHORT = 500
#: Unseen trusted texts that the quantile of all languages counts as beside a language's own.
PRIOR_TEXTS = 50


def tag(tagged: Column, order: int) -> Column:
    """What a number of ``order`` bytes at most carries above these."""
    return tagged.bitwiseAND(F.lit(-1 - mask(order)))


def tagged_grams(batch: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of each text (text, m) of a batch, m above their ``order`` bytes, and the texts' borders among these."""
    grams, borders = byte_grams(*padded(batch.column("text"), order - 1), order - 1)
    return grams | np.repeat(batch.column("m").to_numpy() << 8 * order, np.diff(borders)), borders


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """g, c: how often ``texts`` (text, m) have each gram of ``order`` bytes, tagged with m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = GramCounts()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = counts.take()
            yield from in_parts({"g": pa.array(keys), "c": pa.array(n)})

        for whole in batches:
            for batch in slices(whole, "text"):
                counts.add(tagged_grams(batch, order)[0])
                if len(counts) > 4_000_000:
                    yield from flush()
        yield from flush()

    return texts.select("text", "m").mapInArrow(lambda b: releasing(run(b)), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame, order: int, models: int) -> list[tuple[float, float, float]]:
    """D1, D2 and D3+ of each of ``models`` from its counts of counts; where these are too few for the formula, 0.5, 1 and 1.5."""
    rows = counts.where("c <= 4").groupBy(F.shiftright("g", 8 * order).alias("m"), "c").count().collect()
    n = {(r["m"], r["c"]): r["count"] for r in rows}
    out = []
    for m in range(models):
        n1, n2, n3, n4 = (n.get((m, k), 0) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3 and n4):
            out.append((0.5, 1.0, 1.5))
            continue
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        out.append(tuple(min(max(d, 0.01), k - 0.01) for k, d in enumerate(found, 1)))
    return out


def fit(parts: DataFrame, turns: int, order: int = ORDER) -> DataFrame:
    """k, ctx, byte, value: 1 + ``turns`` models as rows, written, from the counts (g, c) of each part's grams (tag). Model 0 is of all parts, model
    i + 1 of all but part i; ctx has the model's number as its tag. A gram of k bytes has its discounted probability; a context (byte -1) of k - 1 bytes
    has the weight of the order below. Lower orders count the distinct bytes before a gram, as Kneser and Ney have it.

    Counts are sharded by the gram, contexts' sums by the context, and a shuffle join brings them together: nothing here is sized by assumption.
    """
    part, low = F.shiftright("g", 8 * order), F.col("g").bitwiseAND(F.lit(mask(order)))
    uses = F.filter(F.array(F.lit(0).cast("long"), *(F.when(part != i, F.lit(i + 1).cast("long")) for i in range(turns))), lambda m: m.isNotNull())
    dealt = parts.select(F.explode(uses).alias("m"), low.alias("low"), "c").select((F.shiftleft("m", 8 * order) + F.col("low")).alias("g"), "c")
    now = materialize(dealt.groupBy("g").agg(F.sum("c").alias("c")), f"grams{order}")
    out, written = None, [now]
    for k in range(order, 0, -1):
        found = discounts(now, order, 1 + turns)
        d1, d2, d3 = (F.get(F.array(*(F.lit(d[j]) for d in found)), F.shiftright("g", 8 * order).cast("int")) for j in range(3))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        ctx = tag(F.col("g"), order) + F.shiftright(low, 8)
        cells = now.select(ctx.alias("ctx"), F.col("g").bitwiseAND(F.lit(255)).alias("byte"), F.col("c"), cut.alias("d"))
        context = cells.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("cut"))
        grams = cells.join(context, "ctx").select(F.lit(k).alias("k"), "ctx", "byte", ((F.col("c") - F.col("d")) / F.col("total")).alias("value"))
        weights = context.select(F.lit(k).alias("k"), "ctx", F.lit(-1).cast("long").alias("byte"), (F.col("cut") / F.col("total")).alias("value"))
        rows = grams.unionAll(weights)
        out = rows if out is None else out.unionAll(rows)
        if k > 1:
            shorter = tag(F.col("g"), order) + F.col("g").bitwiseAND(F.lit(mask(k - 1)))
            now = materialize(now.groupBy(shorter.alias("g")).agg(F.count(F.lit(1)).alias("c")), f"grams{k - 1}")
            written.append(now)
    model = materialize(out, "model")
    for x in written:
        discard(x)
    return model


def short_tables(model: DataFrame, order: int, models: int) -> np.ndarray:
    """By model, the probability of each byte (column) after each byte (row) by the orders 1 and 2 alone: 65,536 numbers each, from as many rows at most."""
    got = model.where(F.col("k") <= 2).select("k", "ctx", "byte", "value").toArrow()
    of_all, ctx_of_all, byte_of_all, value_of_all = (got.column(c).to_numpy() for c in ("k", "ctx", "byte", "value"))
    out = np.empty((models, 256, 256))
    for m in range(models):
        here = ctx_of_all >> 8 * order == m
        k, ctx, byte, value = of_all[here], ctx_of_all[here] & 255, byte_of_all[here], value_of_all[here]
        p = np.full((256, 256), 1 / 256)
        for j in range(1, min(order, 2) + 1):
            values, weights = np.zeros((256, 256)), np.ones(256)
            own, known = (k == j) & (byte >= 0), (k == j) & (byte < 0)
            rows = ctx[own] if j == 2 else slice(None)
            values[rows, byte[own]] = value[own]
            weights[ctx[known] if j == 2 else slice(None)] = value[known] if known.any() else 1
            p = values + weights[:, None] * p
        out[m] = p
    return out


def gram_logs(grams: DataFrame, model: DataFrame, order: int, models: int) -> DataFrame:
    """gram, n, log: the natural log of the probability that the model in its tag gives to the last byte of each of ``grams`` (g, c) after the others.

    Distinct grams and the models' counts are sharded by the model and the last two bytes of the context and joined shard by shard, from order 3 up to
    ``order``; a context that is not known adds nothing. Orders 1 and 2 are tables of fixed size. Under one key are 2^24 grams of five bytes at most.
    """
    tables = model.sparkSession.sparkContext.broadcast(short_tables(model, order, models))
    low = lambda tagged: F.col(tagged).bitwiseAND(F.lit(mask(order)))
    shard = lambda tagged, ctx: (F.shiftleft(F.shiftright(tagged, 8 * order), 16) + ctx.bitwiseAND(F.lit(mask(2)))).alias("shard")
    rows = grams.select(shard("g", F.shiftright(low("g"), 8)), F.lit(0).alias("k"), F.col("g").alias("key"), F.col("c").cast("double").alias("value"))
    key = F.when(F.col("byte") >= 0, tag(F.col("ctx"), order) + F.shiftleft(low("ctx"), 8) + F.col("byte")).otherwise(-F.col("ctx") - 1)
    rows = rows.unionAll(model.where("k > 2").select(shard("ctx", F.col("ctx")), "k", key.alias("key"), "value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in grouped(batches, ["shard"]):
            k, key, value = (part.column(c).combine_chunks().to_numpy() for c in ("k", "key", "value"))
            order_of = np.argsort(key, kind="stable")
            k, key, value = k[order_of], key[order_of], value[order_of]
            g = key[k == 0]
            m, own_tag = g >> 8 * order, g & ~mask(order)
            p = tables.value[m, g >> 8 & 255, g & 255]
            for j in range(3, order + 1):
                own, context = (k == j) & (key >= 0), (k == j) & (key < 0)
                weight, known = look_up(~key[context][::-1], value[context][::-1], own_tag | g >> 8 & mask(j - 1), 1.0)
                found, _ = look_up(key[own], value[own], own_tag | g & mask(j))
                p = np.where(known, found + weight * p, p)
            yield from in_parts({"gram": pa.array(g), "n": pa.array(value[k == 0].astype(np.int64)), "log": pa.array(np.log(p))})

    n = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(lambda b: releasing(run(b)), "gram long, n long, log double")


def perplexities(texts: DataFrame, grams: DataFrame, model: DataFrame, models: int, order: int = ORDER, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """``texts`` (doc_id, t, text, lang, m) to doc_id, t, lang, m, log_p, n_bytes: the natural log of the text's probability (its bytes and an end) under
    model m, and how many bytes these are; null log_p for null and empty texts. Written.

    The models' counts are joined to the distinct ``grams`` of all texts (:func:`gram_logs`), and their logs to the texts' frequencies.
    """
    known = materialize(gram_logs(grams, model, order, models), "known")
    rows = texts.select("doc_id", "t", "lang", "m", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("some"), "text")
    sums = log_sums(rows, known, lambda batch: tagged_grams(batch, order), hot_grams)
    out = materialize(sums.select("doc_id", "t", "lang", "m", F.when(F.col("some"), F.col("log_p")).alias("log_p"), F.col("n_grams").alias("n_bytes")), "scores")
    discard(known, sums)
    return out


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of the labelled texts to trust: every label says quality 1 and toxic 0 (null toxic counts as 0)."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id")


def rows_of(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids`` (doc_id, written). Texts are never shuffled: ids are broadcast, or, where they are more than ``most``,
    dealt into blocks of about as many; each block is broadcast alone, in a pass over ``docs`` that writes its rows.
    """
    blocks = -(-ids.count() // most)
    if blocks <= 1:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    written = [materialize(docs.join(F.broadcast(ids.where(block == i)), "doc_id", "left_semi"), "learned") for i in range(blocks)]
    return holding(reduce(DataFrame.unionAll, written), *written)


def spread(n_bytes: Column) -> Column:
    """How much more the log perplexity of a text of ``n_bytes`` varies than that of a very long one."""
    return 1 + F.sqrt(F.lit(float(SHORT)) / n_bytes)


def language(lang: str) -> Column:
    """A key of a language; null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))


def limits(good: DataFrame, bad: DataFrame, quantile: float, prior_texts: int) -> DataFrame:
    """l, level, cut of every language and of all (null l): the median log perplexity of ``good``, and the deviation from it, over spread, that a text may have.

    cut is the quantile of ``good`` (l, perplexity, n_bytes), of ``quantile`` at least, that rejects the smallest share of ``good`` and keeps the smallest
    of ``bad`` together. A language's cut is drawn towards that of all, as if that had been found in ``prior_texts`` of its texts; its level is its own.
    """
    choices = sorted({quantile, *(q for q in CHOICES if q > quantile)})
    log_of = lambda rows: rows.select("l", F.log("perplexity").alias("h"), "n_bytes")
    both = lambda rows: rows.unionByName(rows.withColumn("l", F.lit(None).cast("string")))
    levels = materialize(both(log_of(good)).groupBy("l").agg(F.percentile_approx("h", 0.5, 10_000).alias("level"), F.count(F.lit(1)).alias("n")), "levels")
    overall = levels.where("l is null").select("level").first()
    overall = F.lit(overall["level"] if overall else None).cast("double")
    own = small(levels.where("l is not null"))
    z = lambda rows: log_of(rows).join(own, "l", "left").select("l", ((F.col("h") - F.coalesce("level", overall)) / spread(F.col("n_bytes"))).alias("z"))
    cuts = materialize(both(z(good)).groupBy("l").agg(F.percentile_approx("z", choices, 10_000).alias("at")).where("at is not null"), "cuts")
    # how much of the bad each choice keeps, by language and over all
    met = both(z(bad)).withColumnRenamed("l", "of").join(small(cuts), F.col("of").eqNullSafe(F.col("l")))
    kept = met.groupBy("of").agg(F.count(F.lit(1)).alias("bad"), *(F.count_if(F.col("z") <= F.col("at")[i]).alias(f"k{i}") for i in range(len(choices))))
    costs = F.array(*(F.struct((F.lit(1 - q) + F.coalesce(F.col(f"k{i}") / F.col("bad"), F.lit(0.0))).alias("cost"), F.lit(i).alias("i"), F.col("at")[i].alias("cut")) for i, q in enumerate(choices)))
    best = cuts.join(kept, F.col("l").eqNullSafe(F.col("of")), "left").select("l", F.array_min(costs)["cut"].alias("cut"))
    found = materialize(best.join(levels.withColumnRenamed("l", "of"), F.col("l").eqNullSafe(F.col("of"))).select("l", "level", "cut", "n"), "found")
    pooled = found.where("l is null").select("cut").first()
    weight = F.when(F.col("l").isNull(), 1.0).otherwise(F.col("n") / (F.col("n") + F.lit(float(prior_texts))))
    discard(levels, cuts)
    out = found.select("l", "level", (weight * F.col("cut") + (1 - weight) * F.lit(pooled["cut"] if pooled else None).cast("double")).alias("cut"))
    return holding(out, found)


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, turns: int = 1, prior_texts: int = PRIOR_TEXTS, hot_grams: int = HOT_GRAMS, most_ids: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept and t (a hash of the text) per row of ``docs`` (doc_id, text, lang).

    perplexity is per byte of the text and its end, under an interpolated modified Kneser-Ney model of ``order`` bytes. It is fitted on
    all trusted texts (see :func:`trusted`). threshold follows the row's language and the text's length (see :func:`limits`, :func:`spread`): it comes
    from trusted texts that a model has not seen and from labelled texts of quality 0. For the first, trusted texts are dealt into ``HELD_OUT`` parts;
    ``turns`` of these are held out, each scored by a model of all others. With ``HELD_OUT`` turns every trusted text counts. kept: there is text, and its
    perplexity is not above the threshold.

    Null and empty texts have null perplexity and are not kept. Null languages are a language of their own; one without trusted texts has the threshold
    of all. A null doc_id is never trusted, and kept like any other. Without trusted texts there is no threshold (null) and every text is kept. Repeated rows give
    repeated rows; other columns are ignored; an empty table gives an empty table. Trusted ids are broadcast, ``most_ids`` or so at once (:func:`rows_of`).
    """
    rows = few_rows(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].cast("string").alias("lang"), text_hash(docs).alias("t"))
    good = materialize(trusted(labels), "trusted")
    learned = rows_of(rows.where("text is not null and text <> ''"), good, most_ids)
    part = F.pmod(F.xxhash64(F.lit("held out"), F.col("doc_id")), F.lit(HELD_OUT))
    parts = materialize(gram_counts(learned.withColumn("m", part), order), "parts")
    model = fit(parts, turns, order)
    # the rows to score: all under model 0, and part i under model i + 1
    every = rows.withColumn("m", F.lit(0).cast("long"))
    unseen = learned.where(part < turns).withColumn("m", part + 1)
    of_unseen = parts.where(F.shiftright("g", 8 * order) < turns).select((F.col("g") + F.lit(1 << 8 * order)).alias("g"), "c")
    grams = materialize(gram_counts(every, order).unionByName(of_unseen), "grams")
    discard(parts)
    scores = perplexities(every.unionByName(unseen), grams, model, 1 + turns, order, hot_grams)
    discard(model, grams, learned)
    scored = scores.where("m = 0")
    each = lambda x: x.withColumn("perplexity", F.exp(-F.col("log_p") / F.col("n_bytes"))).withColumn("l", language("lang"))
    pick = lambda x: each(x).where("perplexity is not null").select("l", "perplexity", "n_bytes")
    calm = pick(scores.where("m > 0"))
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("most")).where("most = 0")
    by = limits(calm, pick(scored.join(bad, "doc_id", "left_semi")), quantile, prior_texts)
    overall = by.where("l is null").first() or {"level": None, "cut": None}
    out = each(scored).join(small(by.where("l is not null")), "l", "left")
    level, cut = (F.coalesce(c, F.lit(overall[c]).cast("double")) for c in ("level", "cut"))
    threshold = F.exp(level + cut * spread(F.col("n_bytes")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    discard(good)
    return holding(out.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), kept.alias("kept"), "t"), scores, by)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`classify` keeps: what it states on nulls, ties and empty tables holds."""
    verdicts = classify(docs, labels, **options)
    return only_rows(docs, verdicts.where(~F.col("kept")).select("doc_id", "t"), "left_anti", verdicts)
