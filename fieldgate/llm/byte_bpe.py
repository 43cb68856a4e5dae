"""Byte-level BPE over many documents: merges are replayed in rank order over all distinct pre-tokens at once."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import few_rows, releasing, slices, utf8

#: The pattern that the public rank files are used with: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text bytes whose distinct pre-tokens one replay takes together.
REPLAY_BYTES = 8 << 20
NONE = np.iinfo(np.int32).max


class Merges:
    """The rank file, as a table from pairs of ids to the id of the merged piece."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        merged = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        # open addressing: a lookup costs a few reads, whatever the vocabulary's size
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        left, value = keys[order], merged[order]
        slot = self._slot(left)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == -1
            at, first = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = left[taken], value[taken]
            stay = np.ones(len(left), dtype=bool)
            stay[taken] = False
            left, value, slot = left[stay], value[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)
        tokens = sorted((r, t) for t, r in self.ranks.items())
        top = tokens[-1][0] + 1
        self.length = np.zeros(top, dtype=np.int64)
        for r, t in tokens:
            self.length[r] = len(t)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.blob = np.frombuffer(b"".join(t for _, t in tokens), dtype=np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id each pair merges into, NONE where it doesn't."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]] == keys[open_]
            out[open_[found]] = self.values[slot[open_[found]]]
            open_ = open_[~found & (self.keys[slot[open_]] != -1)]
        return out

    def plain(self, word: bytes) -> list[int]:
        """One word by the definition: the lowest rank first, the leftmost of equals."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == NONE:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and each word's offset.

        An inverted index from merge (a pair's rank) to positions drives the replay: merges are applied in rank
        order, each at all its positions at once, and only the pairs that touch a merged one are looked up again
        and entered. A word in which a merge makes a pair of a lower rank (a rank file allows that) can't be
        replayed in this order and is encoded by :meth:`plain`.
        """
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(words) else 0
        if not total:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(words) + 1, dtype=np.int64)
        symbol = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        # position `total` is a sentinel after every word's end
        after = np.arange(1, total + 1, dtype=np.int32)
        after[ends[sizes > 0] - 1] = total
        ahead = np.arange(-1, total, dtype=np.int32)
        ahead[(ends - sizes)[sizes > 0]] = total
        ahead[total] = total
        symbol = np.append(symbol, np.int32(-1))
        after = np.append(after, np.int32(total))
        merge = np.append(np.full(total, NONE, dtype=np.int32), np.int32(NONE))
        inner = np.flatnonzero(after[:total] != total)
        merge[inner] = self.rank(symbol[inner], symbol[after[inner]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            ranks = merge[positions]
            keep = ranks != NONE
            positions, ranks = positions[keep], ranks[keep]
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist(), len(ranks)]
            for rank, a, b in zip(ranks[starts[:-1]].tolist(), starts, starts[1:], strict=False):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(positions[a:b])

        enter(inner)
        irregular: list[np.ndarray] = []
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[merge[at] == rank]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1 and (touch := right[:-1] == at[1:]).any():  # in a run of overlapping pairs every other one is applied
                begin = np.concatenate([[True], ~touch])
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
                right = after[at]
            beyond = after[right]
            symbol[at] = rank
            after[at] = beyond
            ahead[beyond] = at
            ahead[total] = total
            merge[right] = NONE
            symbol[right] = -1
            before = ahead[at]
            before = before[before != total]
            touched = np.unique(np.concatenate([at, before])) if len(at) > 1 or len(before) else at
            merge[touched] = NONE
            inner = touched[after[touched] != total]
            merge[inner] = self.rank(symbol[inner], symbol[after[inner]])
            if (low := inner[merge[inner] < rank]).size:
                irregular.append(low)
            enter(inner)
        live = symbol[:total] >= 0
        flat = symbol[:total][live].astype(np.uint32)
        offsets = np.concatenate([[0], np.cumsum(live)[ends - 1] if total else []]).astype(np.int64)
        offsets[1:][ends == 0] = 0
        if irregular:
            odd = np.unique(np.searchsorted(ends, np.concatenate(irregular), side="right")).tolist()
            parts = np.split(flat, offsets[1:-1])
            for k in odd:
                parts[k] = np.array(self.plain(words[k]), dtype=np.uint32)
            flat = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return flat, offsets


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges [start, start + length) of ``flat``, one after another."""
    total = int(lengths.sum())
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return flat[np.repeat(shift, lengths) + np.arange(total)] if total else flat[:0]


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    return Merges(path)


class _Index(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def encode_documents(docs: DataFrame, ranks: str, pattern: str = PATTERN, ids: bool = True, replay_bytes: int = REPLAY_BYTES) -> DataFrame:
    """doc_id, ids (array<long>, if asked for), n_tokens, ids_sha256, decoded_sha256 and exact per row of ``docs`` (doc_id, text).

    ``ranks`` is the path of a rank file. Pre-tokens are the matches of ``pattern``; each distinct one of
    the documents at hand is encoded once by :meth:`Merges.replay`. Ids are then decoded: ``decoded_sha256`` is
    the digest of the bytes they stand for, ``exact`` tells that these are the text's bytes. Nothing is shuffled.

    Null text counts as empty: no ids, digests of nothing. Repeated rows give repeated rows, other columns are
    ignored, a null doc_id stays null, an empty table gives an empty table. A text longer than ``replay_bytes`` is
    replayed alone.
    """
    fields = "doc_id long, " + "ids array<long>, " * ids + "n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        merges = load(ranks)
        for whole in batches:
            for batch in slices(whole, "text", replay_bytes):
                texts = utf8(batch.column("text"))
                number = _Index()
                found = [np.fromiter(map(number.__getitem__, find(t.decode("utf-8", "replace"))), dtype=np.int32) for t in texts]
                flat, offsets = merges.replay([w.encode() for w in number])
                number = None
                sizes = np.diff(offsets)
                out: list[list] = [[], [], [], [], []]
                for text, words in zip(texts, found, strict=True):
                    got = gather(flat, offsets[words], sizes[words])
                    back = gather(merges.blob, merges.start[got], merges.length[got]).tobytes()
                    out[0].append(got.astype(np.int64) if ids else None)
                    out[1].append(len(got))
                    out[2].append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
                    out[3].append(hashlib.sha256(back).hexdigest())
                    out[4].append(back == text)
                kinds = [pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(), pa.bool_()]
                columns = [batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))]
                names = ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "exact"]
                keep = [i for i, n in enumerate(names) if ids or n != "ids"]
                del found, flat, offsets, sizes, out
                yield pa.RecordBatch.from_arrays([columns[i] for i in keep], [names[i] for i in keep])

    rows = few_rows(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(lambda b: releasing(run(b)), fields)


def decode_ids(rows: DataFrame, ranks: str) -> DataFrame:
    """doc_id, text (binary) of ``rows`` (doc_id, ids): the bytes the ids stand for. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(ranks)
        for batch in batches:
            texts = []
            for x in batch.column("ids").to_pylist():
                got = None if x is None else np.asarray(x, dtype=np.int64)
                texts.append(None if got is None else gather(merges.blob, merges.start[got], merges.length[got]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["ids"].cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, text binary")
