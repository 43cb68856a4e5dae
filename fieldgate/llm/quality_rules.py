"""Quality rules: text statistics, and an ordered decision list learned from labelled ones by sequential covering. SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"
#: What rules may test: ratios of the statistics, so that a text's length alone rejects nothing.
FEATURES = ("mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio")


def text_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper, n_marks per row of ``docs`` (doc_id, text).

    Words are runs outside of space and U+0009 to U+000D of the whole text. n_repeat_words counts the words that lie in a 3-word window
    that the text has twice or more. Null and empty texts have zeros. One narrow projection: nothing is shuffled.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("w"))
    # windows as 64-bit hashes; the lambda reads the next two words by position
    windows = F.when(F.size("w") >= 3, F.expr("transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))")).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    only = lambda kept: F.length(F.regexp_replace("text", f"[^{kept}]+", ""))
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        only("#*$%&|<>").cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("h"),
        only("A-Z").cast("long").alias("n_upper"),
        only("!?").cast("long").alias("n_marks"),
    )
    # windows that occur again: sorted with their positions, equal ones are neighbours
    ordered = F.expr("array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))")
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered))
    again = F.expr("array_sort(transform(filter(transform(s, (x, j) -> named_struct('i', x.i, 'r', x.h = s[greatest(j - 1, 0)].h and j > 0 or x.h = s[least(j + 1, size(s) - 1)].h and j < size(s) - 1)), x -> x.r), x -> x.i))")
    rows = rows.withColumn("p", again)
    # each such window adds the words that the one before it does not cover
    covered = F.expr("case when p is null or size(p) = 0 then 0 else 3 + aggregate(transform(slice(p, 2, size(p)), (x, j) -> least(3, x - p[j])), 0, (a, x) -> a + x) end")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), "n_upper", "n_marks", F.size("lines").cast("long").alias("n_lines")
    )


def features() -> list[Column]:
    """The ratios of FEATURES, in that order; zero where there is nothing to divide by."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    found = [over("word_chars", "n_words"), over("n_symbols", "word_chars"), over("n_dup_lines", "n_lines"), over("n_repeat_words", "n_words"), over("n_upper", "word_chars"), over("n_marks", "n_words")]
    return [c.alias(n) for c, n in zip(found, FEATURES, strict=True)]


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def rejects(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the first rule that holds rejects, otherwise the text is kept."""
    out = None
    for rule in rules:
        out = F.when(holds(rule), F.lit(True)) if out is None else out.when(holds(rule), F.lit(True))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def _histogram(rows: DataFrame, thresholds: list[list[float]]) -> list[tuple[int, int, int, int]]:
    """(feature, bin, bad, good) of ``rows``: at most features x (thresholds + 1) rows reach the driver."""
    bins = [sum([(F.col(n) > t).cast("int") for t in ts], F.lit(0)) for n, ts in zip(FEATURES, thresholds, strict=True)]
    each = rows.select("bad", F.posexplode(F.array(*bins)).alias("f", "b"))
    return [tuple(r) for r in each.groupBy("f", "b").agg(F.sum("bad"), F.sum(1 - F.col("bad"))).collect()]


def _best(counts: list[tuple[int, int, int, int]], thresholds: list[list[float]], p0: int, n0: int) -> tuple[float, Condition | None]:
    """The condition of the highest FOIL gain."""
    base = log2(p0 / (p0 + n0)) if p0 else 0.0
    best: tuple[float, Condition | None] = (0.0, None)
    for f, ts in enumerate(thresholds):
        for k, t in enumerate(ts):
            for above in (True, False):
                inside = [c for c in counts if c[0] == f and (c[1] > k) == above]
                p, n = sum(c[2] for c in inside), sum(c[3] for c in inside)
                if p and (gain := p * (log2(p / (p + n)) - base)) > best[0] + 1e-9:
                    best = gain, Condition(f, above, t)
    return best


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, least_precision: float = 0.9, least_cover: int = 5, cuts: int = 31) -> list[Rule]:
    """An ordered decision list from ``labelled``: doc_id, the FEATURES and ``bad`` (1 or 0), every row of it.

    Sequential covering: on two thirds of the rows (by the hash of their doc_id) a conjunction of threshold conditions grows
    by FOIL gain; on the other third its last conditions are pruned while (p - n) / (p + n) does not fall; rows it covers go, and
    the next rule starts. A rule whose precision on the pruning rows is below ``least_precision`` ends the list. Thresholds are
    midway between neighbours among ``cuts`` quantiles of each feature, over the good rows and over the bad. Only histograms of bounded size reach the driver.
    """
    steps = [i / (cuts + 1) for i in range(1, cuts + 1)] + [0.995]
    found = labelled.groupBy("bad").agg(*(F.percentile_approx(n, steps, 2000).alias(n) for n in FEATURES)).collect()
    if {r["bad"] for r in found} != {0, 1}:
        return []
    seen = [sorted({float(x) for r in found for x in r[n]}) for n in FEATURES]
    thresholds = [[(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for v in seen]
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    rest, rules = labelled.withColumn("fold", fold), []
    for _ in range(max_rules):
        grow, prune = rest.where("fold <> 0"), rest.where("fold = 0")
        rule: Rule = ()
        while len(rule) < max_conditions:
            counts = _histogram(grow.where(holds(rule)), thresholds)
            p0, n0 = (sum(c[i] for c in counts if c[0] == 0) for i in (2, 3))
            if p0 < least_cover or not n0:
                break
            _, condition = _best(counts, thresholds, p0, n0)
            if condition is None:
                break
            rule = (*rule, condition)
        if not rule:
            break
        heads = [rule[:i] for i in range(1, len(rule) + 1)]
        got = prune.agg(*(F.sum(F.when(holds(h), v).otherwise(0)).alias(f"{k}{i}") for i, h in enumerate(heads) for k, v in (("p", F.col("bad")), ("n", 1 - F.col("bad"))))).first()
        scored = [(((p := got[f"p{i}"] or 0) - (n := got[f"n{i}"] or 0)) / max(1, p + n), i, p, n) for i in range(len(heads))]
        worth, at, p, n = max(scored, key=lambda x: (x[0], -x[1]))
        if p + n == 0 or p / (p + n) < least_precision:
            break
        rules.append(heads[at])
        rest = rest.where(~holds(heads[at]))
    return rules


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, list[Rule]]:
    """(verdicts, rules). Verdicts: the statistics of each row of ``docs`` with the FEATURES, base_failed and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: neither base_failed nor
    rejected by the rules learned from the statistics of all labelled rows (``labels``: doc_id, quality; 0 is bad; the lowest label counts
    where a doc_id has several, null ones don't).

    Null and empty texts have zero statistics and are base_failed. Without labels of both kinds there are no rules. Repeated rows
    give repeated rows, a null doc_id stays null and unlabelled, other columns are ignored, an empty table gives an empty table.
    """
    stats = materialize(text_statistics(docs), "statistics").select("*", *features())
    quality = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    labelled = materialize(stats.join(quality, "doc_id").select("doc_id", *FEATURES, (F.col("quality") == 0).cast("int").alias("bad")), "labelled")
    rules = learn(labelled, **options)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejects(rules)), rules
