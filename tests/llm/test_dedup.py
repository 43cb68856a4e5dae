"""Near-duplicates, line dedup and decontamination against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldgate.llm.common import components
from fieldgate.llm.decontaminate import decontaminate, find_contamination, similarity
from fieldgate.llm.line_dedup import dedup_lines, line_components, line_hashes, normal
from fieldgate.llm.simhash import fingerprint_of, hamming_links, keep_one, near_duplicates

from . import fixtures as X


def fingerprint(text):
    w = X.words_of(text)
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_spark_hash(spark):
    assert spark.sql("SELECT xxhash64('a b c') AS h").first()["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)
    assert fingerprint_of(np.zeros(0, np.uint64)) == 0
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    assert fingerprint_of(h) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > 700)


def test_near_duplicates(spark):
    data = X.rows()
    prints = [fingerprint(r[1]) for r in data]
    roots = X.closure(range(len(data)), [(i, j) for i in range(len(data)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    groups = {}
    for i, r in roots.items():
        groups.setdefault(r, []).append(i)
    want = []
    for own in groups.values():
        ids = [data[i][0] for i in own if data[i][0] is not None]
        want += [(data[i][0], f"{prints[i]:016x}", min(ids, default=None)) for i in own]
    got = [tuple(r) for r in near_duplicates(X.frame(spark)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert near_duplicates(X.empty(spark)).collect() == []
    kept = keep_one(X.frame(spark))
    assert kept.columns == X.frame(spark).columns and kept.count() == len(groups)
    assert keep_one(X.empty(spark)).collect() == []


@pytest.mark.parametrize("parts, radius", [(2, 3), (4, 3), (4, 6)])
def test_links_of_a_hot_group(spark, parts, radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(base[0]) ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 7), replace=False)) for _ in range(1500)} | {int(x) for x in base}
    prints |= {int(x) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for x in base[1:20]}
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    links = [(r["a"], r["b"]) for r in hamming_links(df, radius, parts).collect()]
    true = [(signed[i], signed[j]) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    assert X.closure(signed, links) == X.closure(signed, true)
    assert all((a % (1 << 64) ^ b % (1 << 64)).bit_count() <= radius for a, b in links)


def test_components(spark):
    import random

    rng = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(250)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == X.closure(nodes, links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def shingle_set(line):
    s = line.decode("utf-8", "replace").ljust(5, "\0")
    return frozenset(s[i : i + 5] for i in range(len(s) - 4))


def brute_lines(data):
    where = [(r[0], n, normal(x)) for r in data for n, x in enumerate(X.utf8(r[1]).split(b"\n")) if normal(x)]
    lines = sorted({w[2] for w in where})
    sets = {x: shingle_set(x) for x in lines}
    pairs = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return where, lines, pairs


def test_lines(spark):
    rng_rows = X.rows()
    line = "A rather long line of words that is here with one letter changed now and then to be near"
    variants = [(500 + i, "\n".join((f"head {i} unlike any other {i * 7919}", line[:i] + "#" + line[i + 1 :], line.upper() + "  "))) for i in range(60)]
    data = rng_rows + [(*v, "en", "s", 1, *("x", 1, "x", 1, "x", "x", "x", "x", "x", 1, 1, 1, 1)) for v in variants]
    where, lines, pairs = brute_lines(data)
    h = dict(zip(lines, line_hashes(lines).tolist(), strict=True))
    want = X.closure(h.values(), [(h[a], h[b]) for a, b in pairs])
    got = line_components(X.frame(spark, data)).collect()
    assert len(got) == len(where) and {r["line_id"]: r["component_id"] for r in got} == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["component_id"] for r in kept}) == len(set(want.values()))
    first = {}
    for d, n, x in where:
        root = want[h[x]]
        first[root] = min(first.get(root, (2**62, 0)), (2**62 if d is None else d, n))
    assert all((2**62 if r["doc_id"] is None else r["doc_id"], r["line_no"]) == first[r["component_id"]] for r in kept)
    assert line_components(X.empty(spark)).collect() == []


def test_dedup_of_documents(spark):
    data = [(1, "keep this line\n\nand this other one"), (2, "keep this line"), (3, "KEEP  this line\nnew words stand here"), (4, None), (5, " \n "), (6, "same row"), (6, "same row"), (None, "and this other one\nlast of all lines")]
    docs = spark.createDataFrame([(*d, "x", 0) for d in data], "doc_id bigint, text string, _d string, n_chars int")
    got = sorted((str(r["doc_id"]), r["text"]) for r in dedup_lines(docs).collect())
    assert got == sorted([("1", "keep this line\n\nand this other one"), ("3", "new words stand here"), ("4", None), ("5", " \n "), ("6", "same row"), ("None", "last of all lines")], key=lambda x: (str(x[0]), str(x[1])))
    again = dedup_lines(dedup_lines(docs))
    assert again.columns == docs.columns and {r["_d"] for r in again.collect()} == {"x"}
    assert again.count() == 6 and {r["n_chars"] for r in again.where("doc_id = 3").collect()} == {20}


def brute_contamination(data, items):
    out = {}
    for k, (d, t) in enumerate(data):
        w = X.words_of(t)
        for i, x in items:
            q = X.words_of(x)
            if not q or not w:
                continue
            size = min(5, len(q))
            shingle = lambda v, size=size: [tuple(v[j : j + size]) for j in range(len(v) - size + 1)]
            own, width = shingle(q), min(len(q), len(w))
            best = None
            for s in range(len(w) - width + 1):
                got = shingle(w[s : s + width])
                left, both = list(own), 0
                for g in got:
                    if g in left:
                        left.remove(g)
                        both += 1
                v = both / (len(own) + len(got) - both) if got else 0
                if v >= 0.8 and (best is None or v > best[0]):
                    best = (v, s)
            if best:
                out[k, i] = (d, i, round(best[0], 9), best[1])
    return sorted(map(str, out.values()))


def test_contamination(spark):
    import random

    rng = random.Random(2)
    items = [(i, X.prose(rng, n)) for i, n in enumerate((3, 12, 20, 30, 45, 60, 45))] + [(90, None), (91, ""), (92, "again and again and again and again and again and again and again")]
    plain = [(r[0], r[1]) for r in X.rows() if r[1] is None or len(r[1]) < 3000]
    item = {i: t for i, t in items}
    planted = [(700, X.prose(rng, 30) + "\n" + item[4].upper() + " " + X.prose(rng, 40)), (701, item[5]), (702, " ".join(item[5].split()[2:-2])), (703, " ".join([*item[4].split()[:20], "swapped", *item[4].split()[21:]])), (704, X.prose(rng, 5) + " " + item[0] + " end"), (705, item[92] + " and again"), (706, item[2] + " " + item[3]), (706, item[2] + " " + item[3])]
    data = plain + planted
    docs = spark.createDataFrame([(*d, "x", 1) for d in data], "doc_id bigint, text string, item_id string, similarity int").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_contamination(data, items)
    for block in (20_000, 3):
        got = [(r["doc_id"], r["item_id"], round(r["similarity"], 9), r["first_word"]) for r in find_contamination(docs, bench, block_items=block).collect()]
        assert sorted(map(str, got)) == want and len(want) >= 8
    hit = {g[0] for g in got}
    assert {r["doc_id"] for r in decontaminate(docs, bench).collect()} == {d[0] for d in data} - hit
    assert find_contamination(docs, bench.where("false")).collect() == [] and find_contamination(docs.where("false"), bench).collect() == []
    assert similarity(np.array([1, 1, 2], np.uint64), np.array([1, 2, 2], np.uint64)) == 0.5
    assert decontaminate(docs.withColumn("n", F.lit(1)), bench).columns == [*docs.columns, "n"]
