"""Repetition inside a single document: zstandard compression bands, then the exact share."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ensure_importable
from .words import LETTERS

#: Words in one fixed chunk.
CHUNK = 2048
#: Bytes of a zstandard frame that carry no content, at most.
FRAME = 24
#: Bytes that one match of a repeated run costs, at most, and the shortest run in bytes (eight words of two bytes).
MATCH, RUN = 6, 16
#: Length-specific limits of the repetitive band: (words at least, ratio at most above which nothing is repeated so far).
#: With a share s of words in runs of at least 16 bytes, each of which is found and costs at most MATCH bytes, and the rest
#: stored as it is, the ratio is at most (1 - s) + s * MATCH / RUN + FRAME / bytes. The compressor does not find every run
#: (it skips positions where nothing matched for long, and looks back one window only), so the limit alone rejects nothing.
SHORTEST = 16
#: Words from which runs are sorted instead of looked up one by one.
SORTED = 4096
#: Odd factors that scatter word numbers over all values of two and four bytes, one to one: neighbouring numbers then share
#: no byte, so nothing but repeated runs of words makes a text smaller.
SCATTER = {2: np.uint16(0x9E37), 4: np.uint32(0x9E3779B1)}
#: A text whose words all differ is incompressible from this ratio on.
INCOMPRESSIBLE = 0.97

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("ratio", pa.float64()), ("chunks", pa.int64()), ("dense_chunks", pa.int64()), ("band", pa.string()), ("repeated", pa.int64())])


def ratio_limit(n_bytes: int, share: float) -> float:
    """Largest whole-text ratio with which ``share`` of the words can be repeated if the compressor finds every run."""
    return (1 - share) + share * MATCH / RUN + FRAME / n_bytes


def repeated_words(ids: np.ndarray, k: int) -> int:
    """Words that lie in k consecutive words which also occur earlier in the text; exact."""
    n = len(ids) - k + 1
    if n <= 0:
        return 0
    if n >= SORTED:
        again = _later_runs(ids, k)
        cover = np.bincount(again, minlength=len(ids) + 1) - np.bincount(again + k, minlength=len(ids) + 1)
        return int((np.cumsum(cover)[:-1] > 0).sum())
    raw, w = ids.tobytes(), ids.itemsize
    first: set[bytes] = set()
    add, width = first.add, k * w
    again = []
    for p in range(0, n * w, w):
        g = raw[p : p + width]
        if g in first:
            again.append(p // w)
        else:
            add(g)
    if not again:
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.array(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _later_runs(ids: np.ndarray, k: int) -> np.ndarray:
    """Positions whose k words also occur from an earlier position on: words are numbered, then pairs of numbers, doubling the width."""
    power, width = ids.astype(np.uint64), 1  # numbers of all runs of ``width`` words, a power of two
    runs, have = None, 0  # numbers of all runs of ``have`` words, the part of k put together so far
    while True:
        if k & width:
            runs, have = (power, width) if runs is None else (_numbered(runs, power, have), have + width)
        if have == k:
            break
        power, width = _numbered(power, power, width), 2 * width
    order = np.argsort(runs, kind="stable")
    return order[1:][runs[order[1:]] == runs[order[:-1]]]


def _numbered(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """Numbers of the pairs (a[i], b[i + gap]), equal for equal pairs; all below 2^32."""
    n = min(len(a), len(b) - gap)
    return np.unique((a[:n] << np.uint64(32)) | b[gap : gap + n], return_inverse=True)[1].astype(np.uint64)


def measure(text: str | None, share: float, k: int, pack: zstandard.ZstdCompressor) -> tuple:
    """(n_words, ratio, chunks, dense_chunks, band, repeated) of one text.

    The text is compressed as the sequence of its words, each a scattered number of its own in two bytes (four beyond 65,536
    different ones), so layout, the length of words and common letters have no weight. Whole text and fixed chunks get a ratio. Bands:
    'short' (too few words to repeat any), 'incompressible', 'clean' (above the limit of its length), 'repetitive' (not
    above it, or ``share`` is repeated by the exact count). Above the limit the count is left out (None) only where it is
    proved to lie below ``share``: a repeated word occurs earlier, so at most words less different words are repeated.
    """
    seen: dict[str, int] = {}
    put = seen.setdefault
    ids = [put(w, len(seen)) for w in LETTERS.findall(text.lower())] if text else []
    n = len(ids)
    if n < SHORTEST or n <= k:
        # too short for the ratios to say anything; the exact count costs next to nothing
        return n, None, 0, 0, "short", repeated_words(np.array(ids, np.uint16), k)
    a = np.array(ids, np.uint16 if len(seen) <= 65_536 else np.uint32)
    raw = (a * SCATTER[a.itemsize]).tobytes()
    ratio = len(pack.compress(raw)) / len(raw)
    limit = ratio_limit(len(raw), share)
    size = CHUNK * a.itemsize
    chunks = -(-len(raw) // size)
    dense = int(ratio <= limit) if chunks == 1 else sum(len(pack.compress(c)) / len(c) <= ratio_limit(len(c), share) for c in (raw[p : p + size] for p in range(0, len(raw), size)))
    # half a word of room, for rounding of the product
    repeated = None if ratio > limit and n - len(seen) < share * n - 0.5 else repeated_words(a, k)
    if ratio > limit and (not repeated or repeated < share * n - 0.5):
        return n, ratio, chunks, dense, "incompressible" if ratio >= INCOMPRESSIBLE else "clean", repeated
    return n, ratio, chunks, dense, "repetitive", repeated


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = 0.4, k: int = 8, level: int = 9) -> DataFrame:
    """(doc_id, n_words, ratio, chunks, dense_chunks, band, repeated) for every document, read whole, one row for each input row.

    Words are runs of letters in lower case; a word is repeated if it lies in ``k`` consecutive words that also occur
    earlier in the text. ``repeated`` is null only where too few words recur at all for a share of ``share``. Null and blank texts have no
    words and 0 repeated. Empty table, empty result. Other columns are ignored, whatever their names. No shuffle.
    """
    ensure_importable(docs.sparkSession)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level, write_checksum=False)
        for b in batches:
            rows = [measure(t, share, k, pack) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, _SCHEMA.types[1:], strict=True))], schema=_SCHEMA)

    return src.mapInArrow(run, "doc_id long, n_words long, ratio double, chunks long, dense_chunks long, band string, repeated long")
