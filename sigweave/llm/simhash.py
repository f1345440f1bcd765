"""Near-duplicates by SimHash, found through segments with one bit left out.

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit in one of
their two halves.  Leaving out each bit of each half in turn gives 64 keys per fingerprint, and
every such pair agrees on a key: an equality shuffle finds it, and the distance is checked there.
With a key of 31 bits, fingerprints meet by chance rarely, at any size of the input.

Deduplication keeps one key of each group of linked fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.llm.components import components
from sigweave.llm.tables import added, cut, text_of

SEED = 42
#: The distance up to which the keys lose no pair.
MAX_RADIUS = 3
#: A run of more fingerprints than this is searched by masks, not pair by pair.
LONG_RUN = 20_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of the text in UTF-8, A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by spaces; of all of them if there are fewer; none for no word."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(first, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit by bit what more than half of the hashes have; zero for none."""
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 100_000)):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(df: DataFrame, size: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    """All columns and ``out``, the fingerprint of word shingles with repeats, as a signed long.

    A text without words, or null, has fingerprint zero.
    """

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(majority(shingle_hashes(words_of(t), size))) for t in texts], dtype="int64")

    return df.select(*added(df, out), of(text_of(text)).alias(out))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """64 keys for each fingerprint: half (bit 38), bit left out (bits 32-37), the other bits of the half."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4_096):
            part = batch.slice(at, 4_096)
            fp = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            node = part.column("node").to_numpy(zero_copy_only=False)
            halves = np.stack([fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32)], axis=1)
            bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
            place = (np.arange(2, dtype=np.uint64)[:, None] << np.uint64(38)) | (np.arange(32, dtype=np.uint64)[None, :] << np.uint64(32))
            keys = (halves[:, :, None] & ~bit) | place
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, 64).view(np.int64)), pa.array(np.repeat(node, 64))],
                names=["key", "fp", "node"],
            )


def _by_masks(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a long run: what is equal without some ``radius`` of the bits that differ at all in it."""
    varying = int(np.bitwise_or.reduce(fp) ^ np.bitwise_and.reduce(fp))
    bits = [1 << i for i in range(64) if varying >> i & 1]
    out = []
    for gone in itertools.combinations(bits, min(radius, len(bits))):
        masked = fp & np.uint64(~sum(gone) & (1 << 64) - 1)
        order = np.argsort(masked, kind="stable")
        same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
        out += zip(order[same].tolist(), order[same + 1].tolist(), strict=True)
    return out


def _tree(fp: np.ndarray, bit: int, radius: int) -> list[tuple[int, int]]:
    """Links that join what the run's pairs within ``radius`` join, fewer than it has members.

    ``bit`` is the one left out by the key: pairs that agree on it agree on the whole half and are
    found by the half's first key, so the other keys only look across it.
    """
    side = (fp >> np.uint64(bit)) & np.uint64(1)
    first = bit % 32 == 0
    if not first and (side.all() or not side.any()):
        return []
    if len(fp) > LONG_RUN:
        return _by_masks(fp, radius)
    out, open_ = [], np.arange(len(fp))
    while len(open_):
        frontier, open_ = [int(open_[0])], open_[1:]
        while frontier and len(open_):
            at = frontier.pop()
            near = np.bitwise_count(fp[open_] ^ fp[at]) <= radius
            if not first:
                near &= side[open_] != side[at]
            found = open_[near]
            out += [(at, int(x)) for x in found]
            frontier += found.tolist()
            open_ = open_[~near]
    return out


def _pairs(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        bit = ((key >> 38) & 1) * 32 + ((key >> 32) & 31)
        two = starts[sizes == 2]  # by far the most
        apart = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        across = ((fp[two] ^ fp[two + 1]) >> bit[two].astype(np.uint64)) & np.uint64(1) == 1
        two = two[apart & (across | (bit[two] % 32 == 0))]
        a, b = [node[two]], [node[two + 1]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if tree := _tree(fp[at : at + n], int(bit[at]), radius):
                i = np.array(tree)
                a.append(node[at + i[:, 0]])
                b.append(node[at + i[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of the key; a run that is not over waits for the next batch."""
        kept: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "node")]
            if kept is not None:
                new = [np.concatenate([x, y]) for x, y in zip(kept, new, strict=True)]
            if not len(new[0]):
                continue
            last = int(np.searchsorted(new[0], new[0][-1]))
            kept = [x[last:] for x in new]
            if last:
                yield links(new[0][:last], new[1][:last].view(np.uint64), new[2][:last])
        if kept is not None and len(kept[0]):
            yield links(kept[0], kept[1].view(np.uint64), kept[2])

    return run


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """``(a, b)`` of ``nodes`` (node, fp): enough links to join all that lie within ``radius`` bits.

    Within a run of equal keys a spanning forest is given, not all pairs.  Give each fingerprint
    once where many rows share one.
    """
    if radius > MAX_RADIUS:
        raise ValueError(f"two halves find at most {MAX_RADIUS} differing bits")
    keys = nodes.select("node", "fp").mapInArrow(_keys, "key long, fp long, node long")
    runs = keys.repartition("key").sortWithinPartitions("key")
    return runs.mapInArrow(_pairs(radius), "a long, b long")


def near_groups(
    docs: DataFrame, size: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All rows and columns with ``fp`` and ``component_id``, the smallest key linked to the row, over any steps.

    Rows are linked if their fingerprints differ in at most ``radius`` bits.  Null and empty texts
    have fingerprint zero and are linked like others.  A component of null keys has a null id.
    Columns of the input named like a result are replaced.
    """
    marked = cut(fingerprint(docs.select(*added(docs, "fp", "component_id")), size, text), "fingerprints")
    rooted = _rooted(marked, radius, key)
    ids = rooted.groupBy("__root").agg(F.min("__first").alias("component_id"))
    of = cut(rooted.join(ids, "__root").select("fp", "component_id"), "groups")
    return marked.join(of, "fp").select(*[F.col(f"`{c}`") for c in marked.columns], "component_id")


def _rooted(marked: DataFrame, radius: int, key: str) -> DataFrame:
    """``fp``, once each, with ``__root``, the fingerprint its component goes by, and ``__first``, the smallest key that has it."""
    once = cut(marked.groupBy("fp").agg(F.min(key).alias("__first")), "distinct")
    found = components(links(once.select("fp", F.col("fp").alias("node")), radius))
    rooted = once.join(found, once.fp == found.node, "left").withColumn("__root", F.coalesce("root", "fp"))
    return cut(rooted.select("fp", "__root", "__first"), "rooted")


def deduplicate(docs: DataFrame, size: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, columns as in ``docs``: one key of each group of ``near_groups``.

    The smallest key stays, of equal keys the one whose text has the smallest SHA-256; null keys come
    after all others.  Rows that repeat a key and its text share their fate.  Texts without words have
    fingerprint zero, so one of them stays.  An empty table stays empty.
    """
    sha = F.sha2(text_of(text).cast("binary"), 256)
    narrow = docs.select(F.col(key).alias("__key"), sha.alias("__sha"), text_of(text).alias("__text"))
    # Only keys and hashes are written and shuffled; texts are read again where rows go.
    marked = cut(fingerprint(narrow, size, "__text").select("__key", "__sha", "fp"), "fingerprints")
    rows = marked.join(_rooted(marked, radius, "__key").select("fp", "__root"), "fp")
    rows = cut(rows.select("__root", "__key", "__sha"), "members")
    order = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), F.col("__sha").alias("sha"))
    first = rows.groupBy("__root").agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    stays = F.col("__key").eqNullSafe(F.col("__first.key")) & (F.col("__sha") == F.col("__first.sha"))
    gone = cut(rows.join(cut(first, "first"), "__root").filter(~stays).select("__key", "__sha").distinct(), "gone")
    return docs.join(gone, F.col(key).eqNullSafe(F.col("__key")) & (sha == F.col("__sha")), "left_anti")
