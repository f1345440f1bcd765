"""Benchmark decontamination: item-sized windows, SimHash with block indexes, exact check.

A document contains a benchmark item if some window of it, as long as the item, has a weighted
shingle similarity of at least ``least`` to it: the shared occurrences of five-word shingles over
all occurrences of either.  Such a window consists of the benchmark's shingles almost throughout,
so only stretches that do are cut into windows and fingerprinted.  A window's fingerprint is looked
up in ``radius + 1`` tables, one per block of bits: within ``radius`` bits one block is untouched,
so no item within the radius is missed.  What is found is checked exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.llm.hashing import shingles, word_hashes
from sigweave.llm.simhash import majority
from sigweave.llm.tables import added, text_of

SHINGLE = 5
#: Shingles in one index; a larger benchmark is compared block by block, so what is broadcast stays bounded.
INDEX_SHINGLES = 1_000_000

HITS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start_word", T.IntegerType()),
    T.StructField("end_word", T.IntegerType()), T.StructField("similarity", T.DoubleType()),
]))


@dataclass
class Item:
    item_id: int | None
    hashes: np.ndarray
    counts: Counter


@dataclass
class Length:
    """The items of one number of shingles: fingerprints, and per block the items of each value."""

    items: list[Item] = field(default_factory=list)
    prints: np.ndarray | None = None
    blocks: list[dict[int, np.ndarray]] = field(default_factory=list)


@dataclass
class Index:
    least: float
    radius: int
    known: np.ndarray  # all shingles of the items, sorted
    in_lengths: list[set[int]]  # the lengths of the items that have it
    lengths: dict[int, Length]
    whole: dict[int, list[int | None]]  # items too short for a shingle, by the hash of all words


def _edges(radius: int) -> list[tuple[int, int]]:
    """The bits of each block: first, and how many."""
    at = np.linspace(0, 64, radius + 2).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(at, at[1:], strict=False)]


def _block(prints: np.ndarray, first: int, n: int) -> np.ndarray:
    return (prints >> np.uint64(first)) & np.uint64((1 << n) - 1)


def build(items: list[tuple[int | None, str | None]], least: float, radius: int) -> Index:
    lengths: dict[int, Length] = {}
    whole: dict[int, list[int | None]] = {}
    owners: dict[int, set[int]] = {}
    for (item_id, _), words in zip(items, word_hashes([text or "" for _, text in items]), strict=True):
        if not len(words):
            continue
        hashes = shingles(words, SHINGLE)
        if len(words) < SHINGLE:
            whole.setdefault(int(hashes[0]), []).append(item_id)
            continue
        counts = Counter(hashes.tolist())
        lengths.setdefault(len(hashes), Length()).items.append(Item(item_id, hashes, counts))
        for h in counts:
            owners.setdefault(h, set()).add(len(hashes))
    for group in lengths.values():
        group.prints = np.array([majority(i.hashes) for i in group.items], np.uint64)
        for first, n in _edges(radius):
            value = _block(group.prints, first, n)
            group.blocks.append({int(v): np.flatnonzero(value == v) for v in np.unique(value)})
    known = np.array(sorted(owners), np.uint64)
    return Index(least, radius, known, [owners[h] for h in known.tolist()], lengths, whole)


def _within(index: Index, group: Length, window: int) -> np.ndarray:
    """The items whose fingerprint lies within the radius of the window's, by the block tables."""
    prints = np.uint64(window)
    tables = zip(_edges(index.radius), group.blocks, strict=True)
    none = np.empty(0, np.int64)
    near = np.unique(np.concatenate([table.get(int(_block(prints, a, n)), none) for (a, n), table in tables]))
    return near[np.bitwise_count(group.prints[near] ^ prints) <= index.radius]


def hits(index: Index, words: np.ndarray) -> list[tuple[int | None, int, int, float]]:
    """``(item_id, start word, end word, similarity)`` of the best window for each item found, first of equals.

    ``words`` are the hashes of a document's words.
    """
    if not len(words):
        return []
    own = shingles(words, SHINGLE)
    if len(words) < SHINGLE:
        return [(i, 0, len(words), 1.0) for i in dict.fromkeys(index.whole.get(int(own[0]), []))]
    if not len(index.known):
        return []
    place = np.minimum(np.searchsorted(index.known, own), len(index.known) - 1)
    is_known = index.known[place] == own
    if not is_known.any():
        return []
    known = np.concatenate([[0], np.cumsum(is_known)])
    best: dict[int | None, tuple[float, int, int]] = {}
    # An item shares shingles with what it is similar to, so other lengths need no windows.
    for length in sorted(set().union(*(index.in_lengths[p] for p in np.unique(place[is_known]).tolist()))):
        group = index.lengths[length]
        n = min(length, len(own))
        # Shared occurrences s give s / (n + length - s); a window with fewer known shingles cannot reach it.
        needed = index.least * (n + length) / (1 + index.least) - 1e-9
        for at in np.flatnonzero(known[n:] - known[:-n] >= needed).tolist():
            window = own[at : at + n]
            near = _within(index, group, majority(window))
            if not len(near):
                continue
            have = Counter(window.tolist())
            for item in (group.items[i] for i in near.tolist()):
                shared = sum(min(c, item.counts[h]) for h, c in have.items() if h in item.counts)
                similarity = shared / (n + length - shared)
                if similarity >= index.least and similarity > best.get(item.item_id, (0.0,))[0]:
                    best[item.item_id] = (similarity, at, at + n + SHINGLE - 1)
    order = sorted(best, key=lambda i: (best[i][1], i is None, i or 0))
    return [(i, best[i][1], best[i][2], best[i][0]) for i in order]


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in portions that are bounded by their words; they pass the driver one portion at a time."""
    portion, size = [], 0
    for row in benchmark.select(F.col(item).cast("long"), text).toLocalIterator():
        portion.append((row[0], row[1]))
        size += len(row[1] or "") // 2 + 1
        if size > INDEX_SHINGLES:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


def _finder(index: Broadcast):
    names = ("item_id", "start_word", "end_word", "similarity")

    @F.pandas_udf(HITS)
    def of(texts: pd.Series) -> pd.Series:
        parts = (word_hashes(texts.iloc[i : i + 512].tolist()) for i in range(0, len(texts), 512))
        found = [hits(index.value, words) for part in parts for words in part]
        return pd.Series([[dict(zip(names, h, strict=True)) for h in hit] for hit in found], dtype=object)

    return of


def marked(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 15,
    text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "benchmark_hits",
) -> DataFrame:
    """All rows and columns with ``out``: the benchmark items each document contains, with place and similarity.

    Words are cut at ASCII white space, A-Z in lower case.  An item of fewer than five words has no
    shingle; it is found only where it is the whole document.  Documents and items without words
    match nothing; a document shorter than an item is one window.  Items with one id count as one.
    """
    sc = docs.sparkSession.sparkContext
    found = F.array().cast(HITS)
    for portion in _blocks(benchmark, item, item_text):
        found = F.concat(found, _finder(sc.broadcast(build(portion, least, radius)))(text_of(text)))
    return docs.select(*added(docs, out), found.alias(out))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of documents that contain no benchmark item, columns as in ``docs``."""
    return marked(docs, benchmark, out="__hits", **how).filter(F.size("__hits") == 0).drop("__hits")
