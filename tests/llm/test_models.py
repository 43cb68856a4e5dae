"""Language-model scores and the quality classifier against direct computation."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldgate.llm.common import discard
from fieldgate.llm.context_tree import Tree, is_held_out, lm_scores, log_gamma
from fieldgate.llm.kneser_ney import classify, keep_good, trusted

from . import fixtures as X


def event(text):
    return b" ".join(X.words_of(text)) + b"\n"


def tree_scores(training, every, depth):
    """Context-tree weighting node by node: counts, weighted probabilities bottom-up, mixed predictions top-down."""
    counts = defaultdict(lambda: [0, 0])
    for text in training:
        data = b"\n" * depth + event(text)
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for j in range(8):
                    counts[data[i - d : i], 1 << j | data[i] >> 8 - j][data[i] >> 7 - j & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, children = {}, defaultdict(list)
    for c, p in counts:
        if c:
            children[c[1:], p].append((c, p))
    for node in sorted(counts, key=lambda n: -len(n[0])):
        own = kt(*counts[node])
        if len(node[0]) == depth:
            weighted[node] = own
        else:
            below = sum(weighted[k] for k in children[node])
            m = max(own, below)
            weighted[node] = m + math.log((math.exp(own - m) + math.exp(below - m)) / 2)

    def one(context, prefix):
        p, rest = 0.5, 1.0
        total = 0.0
        for d in range(depth + 1):
            node = (context[len(context) - d :], prefix)
            if node not in counts:
                return total + rest * p
            a, b = counts[node]
            p = (b + 0.5) / (a + b + 1)
            w = 1.0 if d == depth else math.exp(kt(a, b) - math.log(2) - weighted[node])
            total += rest * w * p
            rest *= 1 - w
        return total

    out = []
    for text in every:
        data, s = b"\n" * depth + event(text), 0.0
        for i in range(depth, len(data)):
            for j in range(8):
                q = one(data[i - depth : i], 1 << j | data[i] >> 8 - j)
                s += math.log10(q if data[i] >> 7 - j & 1 else 1 - q)
        out.append(s)
    return out


@pytest.mark.parametrize("depth, hot_grams, hot_words", [(2, 4_000_000, 100_000), (2, 300, 20), (5, 3000, 20)])
def test_scores(spark, depth, hot_grams, hot_words):
    """Several partitions and buckets, frequent and rare items, long texts; at the registered depth on the shorter texts."""
    data = [r for r in X.rows() if depth < 5 or r[1] is None or len(r[1]) < 300]
    training = [r[1] for r in data if r[0] is None or not is_held_out(r[0])]
    words = Counter(w for t in training for w in [*X.words_of(t), b"\0end"])
    n, v = sum(words.values()), len(words)
    scores = tree_scores(training, [r[1] for r in data], depth)
    want = []
    for r, s in zip(data, scores, strict=True):
        own = [*X.words_of(r[1]), b"\0end"]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        want.append((r[0] if r[0] is not None else -1, r[0] is not None and is_held_out(r[0]), len(own), sum(words[w] > 0 for w in own), n, round(base, 6), round(s, 3)))
    result = lm_scores(X.frame(spark, data), depth=depth, hot_grams=hot_grams, hot_words=hot_words)
    got = [(-1 if g["doc_id"] is None else g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6), round(g["score"], 3)) for g in result.collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-5, rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-4, abs=2e-3)
    assert len({g[0] for g in got}) > 15
    discard(result)


def test_nearly_certain_node():
    """1e8 ones and one zero in a node: the rare byte, a training text's own, has a finite score."""
    tree = Tree.of_grams(np.array([0x60, 0x61]), np.array([1, 10**8]), 0, 0).mix(None)
    n = 10**8 + 1
    same = 7 * math.log((n + 0.5) / (n + 1))
    want = [same + math.log((10**8 + 0.5) / (n + 1)), same + math.log(1.5 / (n + 1))]
    assert tree.logs(np.array([0x61, 0x60])).tolist() == pytest.approx(want, rel=1e-6, abs=1e-9)
    assert np.exp(tree.logs(np.arange(256))).sum() == pytest.approx(1)


def test_empty_tables(spark):
    assert lm_scores(X.empty(spark), depth=2).collect() == []
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert classify(X.empty(spark), labels).collect() == []
    none = classify(X.frame(spark), labels).collect()
    assert len(none) == len(X.rows()) and all(r["kept"] == bool(r["perplexity"]) and r["threshold"] is None for r in none)


def test_log_gamma():
    for x in np.arange(0.5, 200, 0.5):
        assert log_gamma(np.array([x]))[0] == pytest.approx(math.lgamma(x), rel=1e-8, abs=1e-8)


def kneser_ney(training, order):
    grams = Counter()
    for t in training:
        data = b"\n" * (order - 1) + t + b"\n"
        for i in range(order - 1, len(data)):
            grams[data[i - order + 1 : i + 1]] += 1
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, totals, weights = {}, {}, {}
    for k, own in levels.items():
        n = Counter(own.values())
        if all(n[c] for c in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            d = [min(max(x, 0.01), c - 0.01) for c, x in enumerate((1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]), 1)]
        else:
            d = [0.5, 1.0, 1.5]
        cuts[k] = lambda c, d=d: d[min(c, 3) - 1]
        totals[k], weights[k] = Counter(), Counter()
        for g, c in own.items():
            totals[k][g[:-1]] += c
            weights[k][g[:-1]] += cuts[k](c)

    def p(g, k):
        lower = 1 / 256 if k == 1 else p(g[1:], k - 1)
        total = totals[k][g[:-1]]
        if not total:
            return lower
        c = levels[k][g]
        return ((c - cuts[k](c)) / total if c else 0) + weights[k][g[:-1]] / total * lower

    return p


def rank(values, q):
    return sorted(values)[max(math.ceil(q * len(values)), 1) - 1]


@pytest.mark.parametrize("hot_grams", [2_000_000, 60])
def test_classifier(spark, hot_grams):
    """Perplexities, thresholds and verdicts against direct computation."""
    rng = random.Random(9)
    clean = [(i, X.prose(rng, 60), ["en", "fr"][i % 2]) for i in range(80)]
    junk = [(1000 + i, "".join(rng.choice("#$%&*QXZ0987") for _ in range(200)), ["en", "de"][i % 2]) for i in range(10)]
    data = [*clean, *junk, (2000, None, "en"), (2001, "", "fr"), (None, clean[0][1], None), (5, clean[5][1], "fr"), (2002, clean[2][1], ""), (2003, X.prose(rng, 4000), "en")]
    docs = spark.createDataFrame([(*d, "x", 1) for d in data], "doc_id bigint, text string, lang string, t string, g int").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80) if i % 4] + [(1000, 0, 0), (1001, 0, 1), (0, 1, 1), (4, 1, None), (None, 1, 0), (1, 1, 0), (8, 1, 0), (8, 0, 0)], "doc_id bigint, quality int, toxic int")
    good = {r["doc_id"] for r in trusted(labels).collect()}
    assert good == {i for i in range(80) if i % 4} | {4}
    out = {r["doc_id"] for r in spark.createDataFrame([(i,) for i in good], "doc_id long").where("pmod(xxhash64('held out', doc_id), 3) = 0").collect()}
    perplexity = lambda p, own: math.exp(-sum(math.log(p((b"\n\n" + own + b"\n")[i : i + 3], 3)) for i in range(len(own) + 1)) / (len(own) + 1))
    spread = lambda text: 1 + math.sqrt(500 / (len(text) + 1))
    p = kneser_ney([d[1].encode() for d in data if d[0] in good], 3)
    blind = kneser_ney([d[1].encode() for d in data if d[0] in good - out], 3)
    unseen = [(d[2], math.log(perplexity(blind, d[1].encode())), d[1].encode()) for d in data if d[0] in out]
    level = {l: rank([h for k, h, _ in unseen if l in (None, k)], 0.5) for l in (None, "en", "fr")}
    z = [(l, (h - level[l]) / spread(t)) for l, h, t in unseen]
    bad = [(d[2], (math.log(perplexity(p, d[1].encode())) - level.get(d[2], level[None])) / spread(d[1].encode())) for d in data if d[0] in (1000, 1001)]
    cut = {}
    for l in (None, "en", "fr"):
        own, other = ([v for k, v in x if l in (None, k)] for x in (z, bad))
        costs = [(1 - q + (sum(v <= rank(own, q) for v in other) / len(other) if other else 0), i, rank(own, q)) for i, q in enumerate((0.99, 0.9925, 0.995, 0.9975, 0.999))]
        cut[l] = min(costs)[2], len(own)
    threshold = {l: (c * n + 20 * cut[None][0]) / (n + 20) if l else c for l, (c, n) in cut.items()}
    got = classify(docs, labels, order=3, prior_texts=20, hot_grams=hot_grams).collect()
    text = {(d[0], d[2]): d[1] for d in data}
    for r in got:
        own = (text[r["doc_id"], r["lang"]] or "").encode()
        if not own:
            assert r["perplexity"] is None and not r["kept"]
            continue
        l = r["lang"] if r["lang"] in threshold else None
        assert r["perplexity"] == pytest.approx(perplexity(p, own), rel=1e-4) and r["n_bytes"] == len(own) + 1
        assert r["threshold"] == pytest.approx(math.exp(level[l] + threshold[l] * spread(own)), rel=1e-4)
        assert r["kept"] == (r["perplexity"] <= r["threshold"])
        assert r["kept"] or r["doc_id"] not in good - out
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] < 1000) or r["doc_id"] in (2002, 2003) or r["doc_id"] is not None and r["doc_id"] < 80
    assert len(got) == len(data) and sum(not r["kept"] for r in got) <= 10 + 2 + 4
    kept = keep_good(docs, labels, order=3, prior_texts=20)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert keep_good(docs.limit(0), labels, order=3).collect() == []


def test_classifier_fits_on_every_trusted_text(spark):
    """25,000 trusted texts: the model is that of all of them."""
    docs = spark.range(25_000).selectExpr("id AS doc_id", "concat(id * 7919 % 25000, ' ', id % 97) AS text", "'en' AS lang")
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    texts = {d["doc_id"]: d["text"].encode() for d in docs.collect()}
    p = kneser_ney(texts.values(), 3)
    got = classify(docs, labels, order=3)
    for r in got.where("doc_id % 50 = 0").collect():
        own = texts[r["doc_id"]]
        log_p = sum(math.log(p((b"\n\n" + own + b"\n")[i : i + 3], 3)) for i in range(len(own) + 1))
        assert r["perplexity"] == pytest.approx(math.exp(-log_p / (len(own) + 1)), rel=1e-5)
    discard(got)


@pytest.mark.parametrize("most_ids", [1_000_000, 25])
def test_classifier_holds_out_every_part(spark, most_ids):
    """Thresholds come from all trusted texts, each scored by a model of the parts that it isn't in; ids in one block and in several."""
    rng = random.Random(3)
    data = [(i, X.prose(rng, rng.randint(5, 60)), ["en", "fr"][i % 2]) for i in range(90)] + [(100, X.prose(rng, 20), "en"), (None, X.prose(rng, 20), "fr"), (7, X.prose(rng, 9), "fr")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id bigint, quality int, toxic int")
    part = {r["doc_id"]: r["part"] for r in labels.selectExpr("doc_id", "pmod(xxhash64('held out', doc_id), 3) AS part").collect()}
    learned = [(part[i], lang, t.encode()) for i, t, lang in data if i in part]
    log_perplexity = lambda p, own: -sum(math.log(p((b"\n\n" + own + b"\n")[i : i + 3], 3)) for i in range(len(own) + 1)) / (len(own) + 1)
    blind = [kneser_ney([t for k, _, t in learned if k != i], 3) for i in range(3)]
    whole = kneser_ney([t for *_, t in learned], 3)
    spread = lambda own: 1 + math.sqrt(500 / (len(own) + 1))
    unseen = [(lang, log_perplexity(blind[k], t), t) for k, lang, t in learned]
    level = {l: rank([h for k, h, _ in unseen if k == l], 0.5) for l in ("en", "fr")}
    z = [(l, (h - level[l]) / spread(t)) for l, h, t in unseen]
    # without bad texts the highest quantile rejects the least
    cut = {l: rank([v for k, v in z if l in (None, k)], 0.999) for l in (None, "en", "fr")}
    n = {l: sum(k == l for k, _ in z) for l in ("en", "fr")}
    got = classify(docs, labels, order=3, turns=3, prior_texts=20, most_ids=most_ids)
    rows = got.collect()
    texts = {(i, lang): t.encode() for i, t, lang in data if i != 7}
    for r in rows:
        if r["doc_id"] == 7:
            continue
        l, own = r["lang"], texts[r["doc_id"], r["lang"]]
        assert r["perplexity"] == pytest.approx(math.exp(log_perplexity(whole, own)), rel=1e-4)
        assert r["threshold"] == pytest.approx(math.exp(level[l] + (cut[l] * n[l] + cut[None] * 20) / (n[l] + 20) * spread(own)), rel=1e-4)
    assert len(rows) == len(data)
    discard(got)


def test_classifier_rejects_repeats_and_navigation(spark):
    """Words repeated after one another and menus, labelled and not, go; unseen good texts stay, short ones too."""
    rng = random.Random(4)
    clean = [(i, X.prose(rng, rng.choice([8, 60, 200])), "en") for i in range(240)]
    unseen = [(1000 + i, X.prose(rng, rng.choice([8, 60, 200])), "en") for i in range(60)]
    repeats = [(2000 + i, " ".join([clean[i][1].split()[0].capitalize()] * 150), "en") for i in range(30)]
    menus = [(3000 + i, " | ".join(w.capitalize() for w in X.prose(rng, 80).split()), "en") for i in range(30)]
    labels = spark.createDataFrame([(d[0], 1, 0) for d in clean] + [(d[0], 0, 0) for d in [*repeats[:20], *menus[:20]]], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([*clean, *unseen, *repeats, *menus], "doc_id bigint, text string, lang string").repartition(3)
    kept = {r["doc_id"] for r in classify(docs, labels).where("kept").collect()}
    of = lambda rows: sum(d[0] in kept for d in rows)
    assert of(repeats) <= 5 and of(menus) == 0 and of(unseen) >= 57 and of(clean) >= 235
