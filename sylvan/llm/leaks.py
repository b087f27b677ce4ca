"""Evaluation texts leaking into training text: size-partitioned MinHash containment search, then exact containment."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ensure_importable, store
from .words import NONE, WORD, shingle_hashes, window_min

#: Texts are cut into pieces of so many words (overlapping by a passage less one), so arrays stay small for texts of any length.
PIECE = 1 << 20
#: Bytes of index that one word of the items takes at most: its number's entry, its text in the dictionary, its window's sketch and place.
WORD_BYTES = 200
#: Tasks that share the documents of one passage in the join of large item sets.
SALT = 16


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def size_class(n: int) -> int:
    """Size partition of an item with n sketches: 2^(k-1) to 2^k - 1 of them."""
    return n.bit_length()


def class_threshold(k: int) -> float:
    """Share of an item's sketches that a document must hold to be a candidate, for the size class k.

    A document that holds one passage of an item holds its sketch, and an item of the class has fewer than 2^k: so no document with a
    passage lies below the threshold, and within a class the threshold is at most a factor of two under an item's own.
    """
    return 1 / ((1 << k) - 1)


class ItemIndex:
    """Items partitioned by size, with the MinHash sketches of their passages, and their words for the exact check.

    Containment of a whole item in a document says little when the item is long and only a passage leaked, and the MinHash
    of a long document as a whole says nothing about a short item. So both sides are cut to the size of a passage: the
    sketch of an item is the set of the smallest shingle hashes of its windows of ``passage`` words, and likewise for a document.
    The share of an item's sketches that a document holds estimates the containment; candidates reach the threshold of the
    item's size class; their windows are then compared word by word. Words are numbered, so the comparison is exact.
    """

    def __init__(self, items: list[tuple[int, str]], passage: int, shingle: int):
        self.passage, self.shingle = passage, shingle
        self.numbers: dict[str, int] = {}
        put, flat, starts = self.numbers.setdefault, [0], []
        for _, text in items:
            starts.append(len(flat))
            flat += [put(w, len(self.numbers) + 1) for w in _words(text)]
            flat.append(0)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words = np.array(flat, np.uint64)
        place, sketch = self._windows(self.words)
        owner = (np.searchsorted(starts, place, "right") - 1).astype(np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(self.words, passage)[place] if len(place) else np.empty((0, passage), np.uint64)
        _, first, number = np.unique(np.ascontiguousarray(windows).view(f"V{8 * passage}").ravel(), return_index=True, return_inverse=True)  # equal passages have one number
        self.salt = 0
        while True:  # until no two passages share a hash
            h = self._hash(self.words)[place[first]]
            order = np.argsort(h)
            self.hashes = h[order]
            if not (self.hashes[1:] == self.hashes[:-1]).any():
                break
            self.salt += 1
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number = rank[number]  # passages are numbered by their hash
        self.at = place[first][order]  # a place of every passage
        self.sketches, sketch = np.unique(sketch, return_inverse=True)
        self.by_sketch, self.by_passage = _Lists(sketch, owner, len(self.sketches), len(items)), _Lists(number, owner, len(self.hashes), len(items))
        self.held = np.bincount(self.by_passage.items, minlength=len(items))
        sketches = np.bincount(self.by_sketch.items, minlength=len(items))
        self.least = np.array([class_threshold(size_class(int(n))) * n if n else 1 for n in sketches])  # sketches a candidate must hold

    def _hash(self, a: np.ndarray) -> np.ndarray:
        """Hashes of all windows of numbers."""
        return shingle_hashes(np.where(a == 0, a, a + np.uint64(self.salt << 40)), self.passage)

    def _windows(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows without an unknown word, and their sketches."""
        if len(a) < self.passage:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        gap = np.cumsum(np.concatenate([[0], a == 0]))
        place = np.flatnonzero(gap[self.passage :] == gap[: -self.passage])
        return place, window_min(shingle_hashes(a, self.shingle), self.passage - self.shingle + 1)[place]

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the text, number of the item, passage) of every passage of an item that stands in a text, each once."""
        get, p = self.numbers.get, self.passage
        parts, owner, starts, at = [], [], [], 0
        for i, t in enumerate(texts):
            words = _words(t)
            for s in range(0, max(1, len(words) - p + 1), PIECE):
                a = np.array([get(w, 0) for w in words[s : s + PIECE + p - 1]] + [0], dtype=np.uint64)
                parts.append(a)
                owner.append(i)
                starts.append(at)
                at += len(a)
        none = np.empty(0, np.int64)
        if not parts or not len(self.sketches):
            return none, none, none
        a = np.concatenate(parts)
        place, sketch = self._windows(a)
        place, sketch = _found(place, sketch, self.sketches)
        if not len(place):
            return none, none, none
        doc = np.array(owner)[np.searchsorted(starts, place, "right") - 1]
        # candidates: distinct sketches held, against the threshold of the item's size class
        d, item = self.by_sketch.expand(doc, sketch)
        pair, count = np.unique(d * len(self.ids) + item, return_counts=True)
        good = pair[count >= self.least[pair % len(self.ids)] - 1e-9]
        # the exact check: the passage of the window, word by word
        at, number = _found(place, self._hash(a)[place], self.hashes)
        doc = np.array(owner)[np.searchsorted(starts, at, "right") - 1]
        same = np.ones(len(at), bool)
        for k in range(p):
            same &= a[at + k] == self.words[self.at[number] + k]
        d, item, number = self.by_passage.expand(doc[same], number[same], True)
        keep = np.isin(d * len(self.ids) + item, good)
        return d[keep], item[keep], number[keep]


class _Lists:
    """For every key the different items that hold it."""

    def __init__(self, key: np.ndarray, item: np.ndarray, keys: int, items: int):
        both = np.unique(key * max(1, items) + item)
        self.items, key = both % max(1, items), both // max(1, items)
        self.start, self.keys = np.searchsorted(key, np.arange(keys + 1)), keys

    def expand(self, doc: np.ndarray, key: np.ndarray, keys: bool = False) -> tuple[np.ndarray, ...]:
        """(doc, item), or (doc, item, key), of every different pair of a document and a key."""
        both = np.unique(doc * max(1, self.keys) + key)
        doc, key = both // max(1, self.keys), both % max(1, self.keys)
        lo = self.start[key]
        n = self.start[key + 1] - lo
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = (np.repeat(doc, n), self.items[entry])
        return (*out, np.repeat(key, n)) if keys else out


def _found(place: np.ndarray, value: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose value is among the sorted ``known`` ones, and its number there."""
    number = np.searchsorted(known, value)
    hit = known[np.minimum(number, len(known) - 1)] == value
    return place[hit], number[hit]


def _hashes(words: list[str], seen: dict[str, int]) -> np.ndarray:
    if len(seen) > 1_000_000:
        seen.clear()
    return np.array([seen.get(w) or seen.setdefault(w, xxhash.xxh3_64_intdigest(w) or 1) for w in words], dtype=np.uint64)


def _sketch_rows(id_: str, text: str, passage: int, shingle: int):
    """(id, sketch) of every window, each once a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for b in batches:
            for i, t in zip(b[id_], b[text], strict=True):
                words = _words(t)
                for s in range(0, max(1, len(words) - passage + 1), PIECE):
                    m = np.unique(window_min(shingle_hashes(_hashes(words[s : s + PIECE + passage - 1], seen), shingle), passage - shingle + 1))
                    if len(m):
                        yield pd.DataFrame({id_: i, "sketch": m.view(np.int64)})

    return run


def _passage_rows(id_: str, text: str, passage: int, shingle: int, only: str | None = None):
    """(id, h, passage) of every window, or of those whose sketch stands in the array ``only``; h is the hash of its words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for b in batches:
            for i, t, wanted in zip(b[id_], b[text], b[only] if only else [None] * len(b), strict=True):
                words = _words(t)
                for s in range(0, max(1, len(words) - passage + 1), PIECE):
                    a = _hashes(words[s : s + PIECE + passage - 1], seen)
                    h = shingle_hashes(a, passage)
                    keep = np.arange(len(h)) if wanted is None else np.flatnonzero(np.isin(window_min(shingle_hashes(a, shingle), passage - shingle + 1).view(np.int64), wanted))
                    if len(keep):
                        yield pd.DataFrame({id_: i, "h": h[keep].view(np.int64), "passage": [" ".join(words[s + k : s + k + passage]) for k in keep.tolist()]})

    return run


def _joined(docs: DataFrame, items: DataFrame, passage: int, shingle: int) -> DataFrame:
    """(doc_id, item_id, passages, held) by joins, for item sets of any size.

    Sketches of documents meet those of items; only documents with a hit are read again, and of them only the windows of a
    sketch that hit. These meet the items' passages on a hash and are compared as text. A passage that stands in very many documents
    has them dealt over SALT tasks, as do the items that hold it.
    """
    sketches = items.mapInPandas(_sketch_rows("item_id", "item_text", passage, shingle), "item_id long, sketch long").select("sketch").distinct()
    hits = docs.mapInPandas(_sketch_rows("doc_id", "text", passage, shingle), "doc_id long, sketch long").join(sketches, "sketch", "left_semi")
    hits = hits.groupBy("doc_id").agg(F.collect_set("sketch").alias("hit"))
    there = docs.join(hits, "doc_id").mapInPandas(_passage_rows("doc_id", "text", passage, shingle, "hit"), "doc_id long, h long, passage string").distinct()
    known = store(items.mapInPandas(_passage_rows("item_id", "item_text", passage, shingle), "item_id long, h long, passage string").distinct())
    held = known.groupBy("item_id").agg(F.count("*").alias("held"))
    there = there.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    both = there.join(known, ["h", "passage", "salt"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("passages"))
    return both.join(held, "item_id")


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", passage: int = 15, shingle: int = 5, index_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, item_id, passages, containment): documents that hold at least ``passage`` consecutive words of an item.

    ``passages`` counts the item's different passages that stand in the document (in any row with its id), ``containment``
    is their share of all different passages of the item. Words are runs of letters or digits in lower case, whatever stands
    between them. Null and blank texts hold nothing; items of fewer words than a passage can't be found. Repeated rows
    count once; two items with the same text are both reported. Empty tables give an empty result. Texts are searched whole. Other
    columns are ignored, whatever their names.

    The items' index (see ``ItemIndex``) goes to every task if it takes at most ``index_bytes``, which is computed from their
    words first; documents are then searched where they are read, and only what leaked is shuffled. A larger item set is joined
    on sketches (see ``_joined``) with the same result.
    """
    ensure_importable(docs.sparkSession)
    items = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).distinct()
    docs = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    words = items.agg(F.sum(F.size(F.split("item_text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    if words * WORD_BYTES > index_bytes:
        return _joined(docs, items, passage, shingle).select("doc_id", "item_id", "passages", (F.col("passages") / F.col("held")).alias("containment"))
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex(sorted(tuple(r) for r in items.collect()), passage, shingle))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage", pa.int64()), ("held", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for b in batches:
            doc, item, number = x.search(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(x.ids[item]), pa.array(number.astype(np.int64)), pa.array(x.held[item].astype(np.int64))], schema=schema)

    found = docs.mapInArrow(run, "doc_id long, item_id long, passage long, held long")
    both = found.groupBy("doc_id", "item_id").agg(F.size(F.collect_set("passage")).cast("long").alias("passages"), F.max("held").alias("held"))
    return both.select("doc_id", "item_id", "passages", (F.col("passages") / F.col("held")).alias("containment"))
