"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from fieldgate.llm.byte_bpe import decode_ids, encode_documents, load
from fieldgate.llm.common import discard
from fieldgate.llm.token_counts import check_vocabulary, token_counts
from fieldgate.llm.words import Words

from . import fixtures as X

VOCABULARY, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("hot_words", [0, 20, 200_000])
def test_counts_match_the_library(spark, hot_words):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    more = ["x<|STARTOFTEXT|>y", "x<|startoftext|>y and <|EndOfText|>", "<|endoftext|>", "<|END", "OFTEXT|> \u212a<|startoftext|", "I\u0307 A\u030a \u0308x"]
    data = X.rows() + [(900 + i, t, *X.rows()[0][2:]) for i, t in enumerate(more)]
    want = [(r[0], len(X.utf8(r[1])), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in data]
    result = token_counts(X.frame(spark, data), VOCABULARY, 2048, hot_words)
    got = [tuple(r) for r in result.collect()]
    discard(result)
    assert sorted((g[:3] for g in got), key=key) == sorted(want, key=key)
    assert all(g[3] == (g[2] > 2048) for g in got) and any(g[3] for g in got)
    assert token_counts(X.empty(spark), VOCABULARY).collect() == []


def test_other_vocabularies_are_refused(tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.BPE({"a": 0, " ": 1, "a ": 2, "b": 3}, [("a", " ")])).save(str(tmp_path / "joins.json"))
    with pytest.raises(ValueError):
        check_vocabulary(str(tmp_path / "joins.json"))
    check_vocabulary(VOCABULARY)


def test_words_of_batches():
    import pyarrow as pa

    texts = [r[1] for r in X.rows()] + ["", None, " ", "a  b", "\u3000x", "A\x0b\x0cB\n"]
    for part in (texts, texts[3:], [None], [""], []):
        words = Words(pa.array(["skip", *part], pa.string()).slice(1))
        want = [X.words_of(t) for t in part]
        assert words.array().to_pylist() == [w for t in want for w in t] and np.diff(words.borders).tolist() == list(map(len, want))
        flat, starts = words.events(3, 10)
        assert [flat[a:b].tobytes() for a, b in zip(starts, starts[1:])] == [b"\n\n\n" + b" ".join(t) + b"\n" for t in want]


def test_merge_replay_matches_the_library(encoding):
    rng = random.Random(1)
    words = [bytes(rng.choices(b"abeinrthAB \xc3\xa9\xff", k=rng.randint(0, 40))) for _ in range(3000)] + [b"", b"a" * 300, b"ab" * 200, b"the"]
    flat, offsets = load(RANKS).replay(words)
    for i, w in enumerate(words):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == (load(RANKS).plain(w) if w else [])
    assert load(RANKS).plain(b"the") == encoding.encode_ordinary("the")
    assert load(RANKS).replay([])[0].tolist() == []


def test_encoding_matches_the_library(spark, encoding):
    for replay in (1 << 20, 500):
        want = []
        for r in X.rows():
            ids = encoding.encode_ordinary(r[1] or "")
            want.append((r[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(X.utf8(r[1])).hexdigest()))
        got = encode_documents(X.frame(spark), RANKS, replay_bytes=replay).collect()
        assert sorted(((g["doc_id"], g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) for g in got), key=key) == sorted(want, key=key)
        assert all(g["exact"] and len(g["ids"]) == g["n_tokens"] for g in got)
    assert encode_documents(X.empty(spark), RANKS).collect() == []


def test_round_trip(spark):
    encoded = encode_documents(X.frame(spark), RANKS)
    got = sorted((bytes(r["text"]) for r in decode_ids(encoded, RANKS).collect()))
    assert got == sorted(X.utf8(r[1]) for r in X.rows())
