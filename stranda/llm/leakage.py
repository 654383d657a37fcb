"""Evaluation texts that stand in training text: a BM25 index of the test items, queried with every training passage.

Impacts are divided by the least score that a passage with `shared` consecutive words of the item can reach, so one
threshold, 1, holds for all items and no leak is lost by it. Postings lie in blocks with their largest impact, and
block-max WAND walks them: from the upper bounds of the words it takes the first item that can reach the threshold, the
pivot; where the block maxima about it don't sum to 1 it skips to the end of the nearest block; items that are scored and
reach 1 are verified word by word.

The index is built on the workers, in shards of bounded size, each a whole index of its items. One shard, the usual case
of a held-out test set, means one scan of the corpus; more items mean more shards and as many scans, never a refusal.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stranda.llm.mail import text_parts

WORD = re.compile(r"[^\W_]+")
SHARED = 12
K1, B = 1.2, 0.75
BLOCK = 16
SHARD_CHARS = 16 << 20
ENOUGH = 1 - 1e-9


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, case ignored; whatever stands between them is ignored."""
    return WORD.findall(text.lower())


def _hashes(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers; what it finds is compared word by word."""
    h = np.full(len(grams), 1469598103934665603, np.uint64)
    for i in range(grams.shape[1]):
        h = (h ^ grams[:, i].astype(np.uint64)) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
    return h


class ItemIndex:
    """Postings of the items' words with the maxima of their blocks, and the items' word windows for the last check."""

    def __init__(self, items: list[tuple[int, str]], shared: int = SHARED):
        self.shared = shared
        known = [(i, words_of(t)) for i, t in items if t is not None]
        known = [(i, w) for i, w in known if len(w) >= shared]
        self.item_ids = [i for i, _ in known]
        self.vocab: dict[str, int] = {}
        texts = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], dtype=np.int32) for _, ws in known]
        n, terms = len(texts), len(self.vocab)
        mean = sum(map(len, texts)) / n if n else 1
        df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=terms) if n else np.zeros(0)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        rows, cols, impacts, places, owners = [], [], [], [], []
        at = 0
        for item, t in enumerate(texts):
            word, tf = np.unique(t, return_counts=True)
            impact = idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))
            by_word = dict(zip(word.tolist(), impact.tolist()))
            grams = np.lib.stride_tricks.sliding_window_view(t, shared)
            least = min(sum(by_word[w] for w in set(g)) for g in grams.tolist())
            rows.append(word)
            cols.append(np.full(len(word), item))
            impacts.append(impact / least)
            places.append(at + np.arange(len(grams)))
            owners.append(np.full(len(grams), item))
            at += len(t)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if n else np.zeros(0, kind)
        row, col, impact = join(rows, np.int64), join(cols, np.int64), join(impacts, np.float64)
        order = np.lexsort((col, row))
        self.items, self.impact = col[order], impact[order]
        self.edges = np.searchsorted(row[order], np.arange(terms + 1))
        self.stride = max(n, 1) + 1
        self.keys = row[order] * self.stride + self.items
        # A word's postings in blocks: where each begins, its last item and its largest impact.
        starts = [np.arange(a, b, BLOCK) for a, b in zip(self.edges[:-1], self.edges[1:])]
        first = join(starts, np.int64)
        last = np.minimum(first + BLOCK, np.repeat(self.edges[1:], [len(s) for s in starts])) - 1 if n else first
        self.block_of = np.searchsorted(first, np.arange(len(self.items)), side="right") - 1
        self.block_last = self.items[last]
        self.block_max = np.maximum.reduceat(self.impact, first) if n else self.impact
        self.word_max = np.maximum.reduceat(self.impact, self.edges[:-1]) if n else self.impact
        # The windows, sorted by hash.
        self.words, place, owner = join(texts, np.int32), join(places, np.int64), join(owners, np.int64)
        h = _hashes(np.lib.stride_tricks.sliding_window_view(self.words, shared)[place]) if n else np.zeros(0, np.uint64)
        by_hash = np.argsort(h, kind="stable")
        self.window_hash, self.window_place, self.window_item = h[by_hash], place[by_hash], owner[by_hash]

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> ItemIndex:
        ix = cls.__new__(cls)
        vars(ix).update(pickle.loads(data))
        return ix

    def candidates(self, terms: np.ndarray) -> list[int]:
        """Items whose score for these distinct words is 1 or more, by block-max WAND.

        place is each word's cursor in its postings; a move to an item is one search of the sorted (word, item) keys for
        all words that move.
        """
        found: list[int] = []
        items, keys, stride = self.items, self.keys, self.stride
        terms = np.sort(terms).astype(np.int64)
        base, place, end, bound = terms * stride, self.edges[terms], self.edges[terms + 1], self.word_max[terms]
        while len(place):
            now = items[place]
            order = np.argsort(now, kind="stable")
            total = np.cumsum(bound[order])
            pivot = int(np.searchsorted(total, ENOUGH))
            if pivot == len(place):
                break
            item = int(now[order[pivot]])
            moving = now <= item
            at = np.searchsorted(keys, base[moving] + item)
            inside = at < end[moving]
            at = np.minimum(at, len(items) - 1)
            block = self.block_of[at]
            if self.block_max[block][inside].sum() >= ENOUGH:
                here = inside & (items[at] == item)
                if self.impact[at][here].sum() >= ENOUGH:
                    found.append(item)
                target = item + 1
            else:
                # No item up to the nearest end of a block, or to the next word's item, can reach the threshold.
                beyond = now[order[np.searchsorted(now[order], item, side="right") :]]
                target = min([int(self.block_last[block][inside].min()) + 1, *beyond[:1].tolist()])
            place[moving] = np.searchsorted(keys, base[moving] + target)
            left = place < end
            if not left.all():
                base, place, end, bound = base[left], place[left], end[left], bound[left]
        return found

    def leaked(self, text: str) -> set[int]:
        """Ids of the items of which the mail holds `shared` consecutive words within one part."""
        found: set[int] = set()
        get, need = self.vocab.get, self.shared
        for part in text_parts(text):
            ids = np.array([get(w, -1) for w in words_of(part)], dtype=np.int32)
            if len(ids) < need:
                continue
            # A word that no item has ends a passage: nothing shared reaches over it.
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2]):
                if b - a < need:
                    continue
                near = self.candidates(np.unique(ids[a:b]))
                if near:
                    found |= self.verified(ids[a:b], near)
        return found

    def verified(self, passage: np.ndarray, near: list[int]) -> set[int]:
        """Ids of those of the near items that share a whole window with the passage."""
        grams = np.lib.stride_tricks.sliding_window_view(passage, self.shared)
        h = _hashes(grams)
        low, high = np.searchsorted(self.window_hash, h), np.searchsorted(self.window_hash, h, side="right")
        allowed, out = set(near), set()
        for g in np.flatnonzero(high > low):
            for w in range(low[g], high[g]):
                item, place = int(self.window_item[w]), int(self.window_place[w])
                if item in allowed and np.array_equal(self.words[place : place + self.shared], grams[g]):
                    out.add(self.item_ids[item])
        return out


def _shards(items: DataFrame, shared: int, most: int) -> Iterator[bytes]:
    """The index of the items, built on the workers in shards of about `most` characters of text, an item_id in one; only
    one shard at a time is on the driver."""
    chars = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    n = max(1, -(-int(chars) // most))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(None if i is None or i != i else int(i), t) for x in batches for i, t in zip(x["item_id"], x["item_text"])]
        yield pd.DataFrame({"index": [ItemIndex(rows, shared).packed()]})

    for k in range(n):
        mine = items.select("item_id", "item_text").where(F.pmod(F.hash("item_id"), F.lit(n)) == k) if n > 1 else items.select("item_id", "item_text")
        yield from (bytes(r[0]) for r in mine.coalesce(1).mapInPandas(build, "index binary").collect())


def leaks(docs: DataFrame, items: DataFrame, shared: int = SHARED, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, item_id: each document and item with `shared` or more consecutive words in common, once.

    Words are compared within one text part of a mail, after transfer encodings, tags and entities. Null and empty texts
    leak nothing, items of fewer words can't leak, null item ids come out null. docs is not shuffled; it is scanned once
    for each shard of the index, which is broadcast and holds about shard_chars characters of items.
    """
    sc = docs.sparkSession.sparkContext

    def scan(index: bytes) -> DataFrame:
        listed = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = ItemIndex.unpacked(listed.value)
            for batch in batches:
                out = [(doc, i) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for i in sorted(ix.leaked(text), key=lambda i: (i is None, i or 0))]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([i for _, i in out], pa.int64())], ["doc_id", "item_id"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long")

    return reduce(DataFrame.unionByName, [scan(p) for p in _shards(items, shared, shard_chars)])
