"""Small invented documents with every awkward case, and brute-force helpers."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, h bigint, key string, n int, fp string, kept string, word string, t string, line string, node int, a int, b int, count int"


def prose(rng, n):
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ti", "é", "in", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    out = ""
    for i, w in enumerate(words):
        out += (w.capitalize() if rng.random() < 0.1 else w) + ("." if rng.random() < 0.08 else "") + ("\n" if rng.random() < 0.05 else " ")
    return out.strip()


def texts(seed=7):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 160)) for _ in range(50)]
    near = []
    for t in base[:15]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    return base + near + base[:6] + [
        None, None, "", "   \n\t ", "a", "a b", "Same line here twice\nSame line here twice\n\nsame  LINE here   twice", "ÀÉ été 日本語 🙂🙂 ½", "\x1c\x85   odd　spaces", "<|endoftext|> and <|startoftext|> inside", "'s don't I'LL we've",
        "!! " * 40, " ".join(["repeat me now"] * 60), prose(rng, 9000), "x" * 5000, "### Assistant: </turn> \\ <image>",
    ]


def rows(seed=7):
    out = [(i, t) for i, t in enumerate(texts(seed))]
    out += [(3, out[3][1]), (3, out[3][1]), (4, "another text under a used id"), (None, "no id at all"), (None, "no id at all"), (None, None)]
    return [(i, t, None if k % 9 == 0 else ["en", "fr"][k % 2], "s", 0 if t is None else len(t), *("x", 1, "x", 1, "x", "x", "x", "x", "x", 1, 1, 1, 1)) for k, (i, t) in enumerate(out)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def utf8(text):
    return (text or "").encode()


def words_of(text):
    return utf8(text).lower().split()


def closure(nodes, links):
    """Smallest reachable node of each."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
