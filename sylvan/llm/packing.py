"""Filling fixed-capacity containers with items: vector best-fit over tokens, documents and attention cost."""
from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, ensure_importable

#: Place of the public tokenizers' files; another place or file is given as a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer splits text before merging, as its README states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Capacity:
    """Limits of one container and the weights of the three dimensions. Attention cost is the sum of squared lengths.

    An attention capacity of ``tokens`` squared or more follows from the tokens; a smaller one binds.
    """

    tokens: int = 2048
    docs: int = 256
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02)

    @property
    def longest(self) -> int:
        """Tokens of the longest item that a container holds: it must fit the tokens, and its square the attention cost."""
        return min(self.tokens, math.isqrt(self.attention))


@lru_cache(maxsize=2)
def _encoder(ranks: bytes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty texts have 0.

    The tokenizer's file (its size is that of its vocabulary, about a megabyte) is read by the driver and broadcast, so executors need no copy.
    """
    ensure_importable(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def best_fit(sizes: np.ndarray, cap: Capacity, choose: str = "norm") -> np.ndarray:
    """Container of every item, longest items first; sizes must fit a container.

    An item goes to the open container that has room in every dimension and, with choose='norm', is left with the smallest
    weighted residual norm, or, with 'dot', whose residual has the largest weighted dot product with the item. Ties go to
    the container opened first. A container without room for the smallest item is closed for good.
    """
    full = np.array([cap.tokens, cap.docs, cap.attention], dtype=float)
    weights = np.array(cap.weights)
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    out = np.empty(len(sizes), np.int64)
    smallest = int(sizes.min()) if len(sizes) else 0
    left, ids, used, opened = np.empty((3, 256)), np.empty(256, np.int64), 0, 0
    for i in order:
        s = int(sizes[i])
        need = np.array([s, 1.0, float(s) * s])
        r = left[:, :used]
        ok = (r[0] >= s) & (r[1] >= 1) & (r[2] >= need[2])
        fit = np.flatnonzero(ok)
        if len(fit):
            rest = r[:, fit]
            if choose == "dot":
                score = -((rest / full[:, None]) * ((need / full) * weights)[:, None]).sum(0)
            else:
                score = ((((rest - need[:, None]) / full[:, None]) ** 2) * weights[:, None]).sum(0)
            at = fit[int(score.argmin())]
        else:
            if used == left.shape[1]:
                left, ids = np.concatenate([left, np.empty_like(left)], 1), np.concatenate([ids, np.empty_like(ids)])
            at = used
            left[:, at], ids[at] = full, opened
            used += 1
            opened += 1
        left[:, at] -= need
        out[i] = ids[at]
        if left[0, at] < smallest or left[1, at] < 1 or left[2, at] < smallest * smallest:
            used -= 1
            left[:, at], ids[at] = left[:, used], ids[used]
    return out


def pack(items: DataFrame, cap: Capacity = Capacity(), shard_items: int = 8192, choose: str = "norm") -> DataFrame:
    """(doc_id, part, n_tokens, container) for items (doc_id, n_tokens).

    An item longer than a container takes (``Capacity.longest``) is split into such lengths and a rest; any other stays
    whole. Items of 0 or null tokens need no room and get no row's worth of it: container is null. Repeated rows are
    items of their own. An empty table gives an empty result. Other columns are ignored, whatever their names.

    Items are dealt by hash into shards of about ``shard_items``, which are packed on their own in parallel, so a task's
    work has a bound at any size; what a shard wastes is its last container or two. Containers are numbered (shard * 2^32 + k).
    The items are checkpointed first, so that rows without an id, which are dealt by their place, come to the same shard if
    a task is run again. Shards are spread over tasks by number, as their few bytes say nothing about the work they are.
    """
    if cap.longest < 1 or cap.docs < 1:
        raise ValueError("a container must hold something")
    ensure_importable(items.sparkSession)
    items = cut(items.select("doc_id", "n_tokens"))
    n = items.count()
    shards = max(1, round(n / shard_items))
    own = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), "n_tokens")
    tasks = min(shards, max(4 * items.sparkSession.sparkContext.defaultParallelism, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spread = items.select("doc_id", "n_tokens", F.pmod(own, F.lit(shards)).cast("long").alias("shard")).repartition(tasks, "shard")

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "n_tokens"], kind="stable")
        tokens = shard["n_tokens"].fillna(0).to_numpy(np.int64)
        parts = np.maximum(1, -(-tokens // cap.longest))
        row = np.repeat(np.arange(len(shard)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(cap.longest, tokens[row] - part * cap.longest)
        box = np.full(len(row), -1, np.int64)
        real = size > 0
        box[real] = best_fit(size[real], cap, choose) + (int(shard["shard"].iloc[0]) << 32)
        out = pd.DataFrame({"doc_id": shard["doc_id"].to_numpy()[row], "part": part, "n_tokens": size})
        out["container"] = pd.array(np.where(real, box, 0), dtype="Int64")
        out.loc[~real, "container"] = pd.NA
        return out

    return spread.groupBy("shard").applyInPandas(run, "doc_id long, part long, n_tokens long, container long")
