"""Token counts without ids: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, holding, materialize, releasing, slices, utf8
from .words import Words, coded, hot_from, lists, per_text, sums, word_counts

#: Pre-tokens whose piece counts are broadcast, the most frequent ones; all others are joined.
HOT_WORDS = 200_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, [str(t.content).lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]


def check_vocabulary(path: str) -> None:
    """Raise ValueError where splitting at ASCII white space and folding ASCII case could change the library's counts for the file at ``path``."""
    tokenizer, _ = _tokenizer(path)
    encode = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    for apart in ("ab cd", "ab\n.. cd", "'s 12\t'S ab", " ab  cd ", "a\r\n\x0b\x0cb"):
        if encode(apart) != [i for w in apart.lower().split() for i in encode(w)]:
            raise ValueError(f"{path}: pieces depend on white space or on case, so words can't be counted one by one")


def word_pieces(words: DataFrame, vocabulary: str) -> DataFrame:
    """word, n, pieces of ``words`` (word, n): how many pieces the library makes of each word, taken alone and as ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _ = _tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                encoded = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in utf8(part.column("word"))], add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(list(map(len, encoded)), pa.int64())], ["word", "n", "pieces"])

    return words.mapInArrow(lambda b: releasing(run(b)), "word binary, n long, pieces long")


def odd_texts(words: Words, special: list[bytes]) -> set[int]:
    """Numbers of the texts whose lower-cased bytes hold an added token's string."""
    whole, found = words.lower.tobytes(), set()
    for s in special:
        at = whole.find(s)
        while at >= 0:
            found.add(int(np.searchsorted(words.texts, at, side="right")) - 1)
            at = whole.find(s, at + 1)
    return found


def token_counts(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs`` (doc_id, text).

    ``vocabulary`` is the path of a ``tokenizers`` JSON file whose pre-tokenizer never joins what white space separates and whose normalizer folds
    ASCII case; :func:`check_vocabulary` raises for others. Pre-tokens are runs outside of ASCII white space. They are counted over all texts, the library
    counts the pieces of each distinct one once, and documents' pre-token frequencies are joined to these by the pre-token and summed. Ids are never kept.
    The most frequent pre-tokens, ``hot_words`` at most, are broadcast, so that none of the join's keys is frequent.

    Null text counts as empty (0 bytes, 0 tokens). Documents that hold an added token's string, in any case, go to the
    library whole, as its default treats them. Repeated rows give repeated rows; other columns are ignored;
    a null doc_id stays null; an empty table gives an empty table.
    """
    check_vocabulary(vocabulary)
    context = docs.sparkSession.sparkContext
    rows = few_rows(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    known = materialize(word_pieces(word_counts(rows), vocabulary), "pieces")
    least = hot_from(known, hot_words)
    frequent = known.where(F.col("n") >= least).toArrow()
    hot = context.broadcast((pa.concat_arrays([*frequent.column("word").chunks, pa.array([], pa.binary())]), frequent.column("pieces").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, special = _tokenizer(vocabulary)
        frequent, pieces = hot.value
        rid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column("text"))
                codes, distinct = coded(frequent, words.array())
                n_tokens = sums(np.append(pieces, np.zeros(len(distinct) - len(pieces), pieces.dtype))[codes], words.borders)
                rare = codes >= len(pieces)
                text, code, n = per_text(codes[rare], np.searchsorted(np.flatnonzero(rare), words.borders), len(distinct))
                n_bytes = np.diff(words.texts)
                if odd := odd_texts(words, special):
                    texts = utf8(batch.column("text"))
                    for i in odd:
                        n_tokens[i] = len(tokenizer.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False))
                    keep = ~np.isin(text, list(odd))
                    text, code, n = text[keep], code[keep], n[keep]
                cold = lists(text, batch.num_rows, {"word": distinct.take(pa.array(code)), "n": pa.array(n)})
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + batch.num_rows)), batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), cold], ["rid", "doc_id", "n_bytes", "hot", "cold"])
                rid += batch.num_rows

    counted = materialize(rows.mapInArrow(lambda b: releasing(run(b)), "rid long, doc_id long, n_bytes long, hot long, cold array<struct<word:binary,n:long>>"), "counted")
    rare = known.where(F.col("n") < least).select("word", "pieces")
    cold = counted.select("rid", F.explode("cold").alias("c")).select("rid", F.col("c.word").alias("word"), F.col("c.n").alias("m"))
    more = cold.join(rare, "word").groupBy("rid").agg(F.sum(F.col("m") * F.col("pieces")).alias("more"))
    total = F.col("hot") + F.coalesce("more", F.lit(0).cast("long"))
    out = counted.drop("cold").join(more, "rid", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > max_tokens).alias("over_limit"))
    return holding(out, known, counted)
