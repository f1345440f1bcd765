"""Conversation prefix trie, in node tables addressed by a minimal perfect hash.

Conversations that are equal turn by turn are one *sequence*, written as a key with a fixed number of
bytes per turn (a hash of role and text, and the words of the text), so that a node of the trie is a
beginning of keys and the keys below it stand side by side in their order.  Keys are dealt by ranges
into shards of a bounded number of turns.  A shard enumerates the distinct digests of its prefixes,
gives each a slot by a minimal perfect hash that is checked against the digest stored there, scatters
its counts into flat arrays, and sums them up through the array of parent slots from the deepest
turn to the root.  Only nodes on the way to a shard's first or last key can reach into another
shard: these stay open and go on, as two rows a shard, to the next round, which does the same with
them.  A round that fits one shard closes all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.mixing import words
from sigweave.llm.tables import cut

#: Bytes of a turn in a key: 16 of the hash of role and text, 8 of the number of words.
UNIT = 24
#: Turns a shard holds, about.
SHARD = 32_768
#: Conversation ids in one row of a sequence, which is read in their order.
IDS = 1_024
#: Bits of the perfect hash's levels for each digest that is left.
GAMMA = 2
NONE = np.iinfo(np.int64).max
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

#: What a node gathers from below, in the order of the arrays: members, smallest member, children, leaves, saved words.
SUMS = ("members", "smallest", "children", "leaves", "saved")
OUT = (
    "open boolean, digest binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, "
    + ", ".join(f"{c} array<long>" for c in SUMS) + ", ends array<string>"
)


# -- sequences ---------------------------------------------------------------------------------------------------------


def _unit(role: Column, text: Column) -> Column:
    """A turn as 48 hexadecimal digits; the role's length keeps role and text apart."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(said.cast("binary"), 256), 1, 32), F.lpad(F.lower(F.hex(words(text))), 16, "0"))


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, units)``: the turns by ``turn`` (null first), ties by role and then by the turn's hash.

    Only hashes and word counts are shuffled.  Rows without ``conv_id`` belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.struct(F.col("turn").alias("turn"), role.alias("role"), _unit(role, text).alias("unit"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", said.alias("said"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    return chats.select("conv_id", F.transform("said", lambda x: x["unit"]).alias("units"))


def rebuilt(chats: DataFrame, every: int = 20, modulus: int = 4) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation ``c - c % every``; h = crc32(c) % ``modulus``."""
    base = chats.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base_id"), F.slice("units", 1, modulus - 1).alias("base")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    rows = chats.withColumns({"h": h, "base_id": F.col("conv_id") - F.col("conv_id") % every}).join(base, "base_id", "left")
    first = F.slice(F.coalesce("base", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(first, F.slice("units", F.col("h") + 1, F.size("units"))).alias("units"))


def sequences(chats: DataFrame) -> DataFrame:
    """``(key, part, ids)``: the distinct sequences, each with its conversations in rows of bounded length."""
    key = F.unhex(F.array_join("units", "")).alias("key")
    rows = chats.select(key, F.floor(F.col("conv_id") / IDS).alias("part"), "conv_id")
    return rows.groupBy("key", "part").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))


# -- the table of a shard ----------------------------------------------------------------------------------------------


def _mixed(digests: np.ndarray, level: int) -> np.ndarray:
    """64 bits of each digest (rows of two uint64), other ones at every level."""
    x = digests[:, 0] ^ (digests[:, 1] * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * level)
    return x ^ (x >> np.uint64(29))


class Slots:
    """A minimal perfect hash of distinct digests: slots 0 to n - 1, one for each.

    A level is a bit array; a digest that has a bit to itself is placed there, the others go to the
    next level, and the slot is the number of set bits before it.  The digest kept at each slot
    decides whether a digest that is asked for is a member.
    """

    def __init__(self, digests: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, placed = digests, 0
        while len(left):
            bits = max(64, GAMMA * len(left))
            at = _mixed(left, len(self.levels)) % np.uint64(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            self.levels.append((bits, alone, placed + np.cumsum(alone) - alone))
            placed += int(alone.sum())
            left = left[~alone[at.astype(np.int64)]]
        self.kept = np.zeros((placed, 2), np.uint64)
        self.kept[self._raw(digests)] = digests
        self.of(digests)

    def __len__(self) -> int:
        return len(self.kept)

    def _raw(self, digests: np.ndarray) -> np.ndarray:
        slots, todo = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, (bits, alone, rank) in enumerate(self.levels):
            at = (_mixed(digests[todo], level) % np.uint64(bits)).astype(np.int64)
            here = alone[at]
            slots[todo[here]] = rank[at[here]]
            todo = todo[~here]
        return slots

    def of(self, digests: np.ndarray) -> np.ndarray:
        """The slots; a digest that is no member raises KeyError."""
        slots = self._raw(digests)
        if len(slots) and ((slots < 0).any() or (self.kept[slots] != digests).any()):
            raise KeyError("a digest is not in the table")
        return slots


def _chain(key: bytes) -> list[bytes]:
    """The digests of a key's prefixes, root first: each is made of the one before and the next turn."""
    out = [bytes(16)]
    for at in range(0, len(key), UNIT):
        out.append(hashlib.blake2b(out[-1] + key[at : at + UNIT], digest_size=16).digest())
    return out


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _common(a: bytes, b: bytes) -> int:
    """Turns two keys begin with in common."""
    n = min(len(a), len(b)) // UNIT
    return next((k for k in range(n) if a[k * UNIT : (k + 1) * UNIT] != b[k * UNIT : (k + 1) * UNIT]), n)


def _shard(paths: list[dict], last: bool) -> Iterator[pd.DataFrame]:
    """Nodes that are complete here, and the rows of those that are not.

    ``paths`` have a key, sums for the nodes along it and ``ends``.  The sums name what has been found
    of a node so far, without what its children in this table bring.
    """
    chains = [_chain(p["key"]) for p in paths]
    flat = _pairs([d for c in chains for d in c])
    table = Slots(np.unique(flat.view([("a", np.uint64), ("b", np.uint64)])).view(np.uint64).reshape(-1, 2))
    n, slots = len(table), table.of(flat)
    starts = np.cumsum([0] + [len(c) for c in chains])
    steps = np.concatenate([np.arange(len(c)) for c in chains])

    depth, parent, said = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    depth[slots] = steps
    below = np.flatnonzero(steps > 0)
    parent[slots[below]] = slots[below - 1]
    units = b"".join(p["key"] for p in paths)
    said[slots[below]] = np.frombuffer(units, ">u8").reshape(-1, UNIT // 8)[:, -1].astype(np.int64) if units else 0

    sums = {c: np.zeros(n, np.int64) for c in SUMS}
    sums["smallest"][:] = NONE
    ends = np.full(n, None, object)
    for c in SUMS:
        got = np.concatenate([np.asarray(p[c], np.int64) for p in paths])
        (np.minimum if c == "smallest" else np.add).at(sums[c], slots, got)
    for p, at in zip(paths, starts, strict=False):
        for k, sha in enumerate(p["ends"]):
            if sha is not None:
                ends[slots[at + k]] = sha

    opened = np.zeros(n, bool)
    low, high = min(range(len(paths)), key=lambda i: paths[i]["key"]), max(range(len(paths)), key=lambda i: paths[i]["key"])
    if not last:
        for i in {low, high}:
            opened[slots[starts[i] : starts[i + 1]]] = True

    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    for d in range(depth.max(), -1, -1):
        here = order[bounds[d] : bounds[d + 1]]
        here = here[~opened[here]]
        sums["leaves"][here[sums["children"][here] == 0]] = 1
        sums["saved"][here] += (sums["members"][here] - 1) * said[here]
        up = here[parent[here] >= 0]
        np.add.at(sums["children"], parent[up], 1)
        for c in ("members", "leaves", "saved"):
            np.add.at(sums[c], parent[up], sums[c][up])
        np.minimum.at(sums["smallest"], parent[up], sums["smallest"][up])

    digest = lambda s: table.kept[s].tobytes()
    done = np.flatnonzero(~opened)
    has, known = parent[done] >= 0, (parent[done] >= 0) & ~opened[parent[done]]
    if len(done):
        yield _frame({
            "open": False, "digest": [digest(s) for s in done],
            "parent": [digest(parent[s]) if h and not k else None for s, h, k in zip(done, has, known, strict=True)],
            "conv_id": sums["smallest"][done], "depth": depth[done],
            "parent_conv_id": [int(sums["smallest"][parent[s]]) if k else None for s, k in zip(done, known, strict=True)],
            "n_convs": sums["members"][done], "n_children": sums["children"][done], "n_leaves": sums["leaves"][done],
            "saved_tokens": sums["saved"][done], "ends_sha256": [EMPTY_SHA if x is None else x for x in ends[done]],
        })
    if not last:
        rows = [(low, 0)] + ([(high, 1 + _common(paths[low]["key"], paths[high]["key"]))] if high != low else [])
        for i, start in rows:  # what both have in common goes with the first
            own = slots[starts[i] : starts[i + 1]]
            part = {c: sums[c][own] for c in SUMS}
            for c in SUMS:
                part[c][:start] = NONE if c == "smallest" else 0
            names = [None if k < start else x for k, x in enumerate(ends[own])]
            yield _frame({"open": True, "key": [paths[i]["key"]], **{c: [x.tolist()] for c, x in part.items()}, "ends": [names]})


_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
_LONGS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _frame(columns: dict) -> pd.DataFrame:
    n = len(columns["digest" if "digest" in columns else "key"])
    whole = {c: columns.get(c, [None] * n) for c in _COLUMNS} | {"open": [columns["open"]] * n}
    return pd.DataFrame({c: pd.array(x, "Int64") if c in _LONGS else pd.Series(x, dtype=object) for c, x in whole.items()})


def _from_sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A shard of sequences: rows of one key come in the order of their ids, which are hashed as they pass."""
    paths: list[dict] = []
    key, count, smallest, sha = None, 0, 0, None

    def ended() -> None:
        if key is not None:
            n = len(key) // UNIT
            only = lambda value, other: [other] * n + [value]
            paths.append({
                "key": key, "members": only(count, 0), "smallest": only(smallest, NONE), "children": [0] * (n + 1),
                "leaves": [0] * (n + 1), "saved": [0] * (n + 1), "ends": only(sha.hexdigest(), None),
            })

    for batch in batches:
        for k, ids in zip(batch["key"], batch["ids"], strict=True):
            if k != key:
                ended()
                key, count, smallest, sha = bytes(k), 0, int(ids[0]), hashlib.sha256()
            sha.update(((b"," if count else b"") + ",".join(map(str, ids)).encode()))
            count += len(ids)
    ended()
    if paths:
        yield from _shard(paths, last=False)


def _from_open(last: bool):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths = [row for batch in batches for row in batch[["key", *SUMS, "ends"]].to_dict("records")]
        for p in paths:
            p["key"] = bytes(p["key"])
        if paths:
            yield from _shard(paths, last)

    return go


# -- rounds ------------------------------------------------------------------------------------------------------------


def _shards(paths: DataFrame) -> int:
    """Shards of ``SHARD`` turns, but of eight paths at least, so that every round leaves far fewer than it got."""
    n, turns = paths.agg(F.count(F.lit(1)), F.sum(F.length("key") / UNIT + 1)).first()
    return max(1, min(int(turns or 0) // SHARD + 1, n // 8)) if n else 0


def trie(chats: DataFrame) -> DataFrame:
    """One row per node of the trie of ``(conv_id, units)``: ``conv_id`` (the smallest member), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    A conversation without turns is a member of the root alone; no conversation, no node.  A turn's
    words count for its node; one without members ending there has the hash of the empty string.
    The ids of a sequence pass one task in their order, as SHA-256 reads them so; only ids do.
    """
    rows = cut(sequences(chats), "sequences")
    shards = _shards(rows)
    if not shards:
        return rows.sparkSession.createDataFrame([], OUT).select(*_COLUMNS[3:11])
    dealt = rows.repartitionByRange(shards, "key").sortWithinPartitions("key", "part")
    found = [cut(dealt.mapInPandas(_from_sequences, OUT), "trie")]
    while True:
        opened = found[-1].filter("open").select("key", *SUMS, "ends")
        shards = _shards(opened)
        if shards == 1:
            found.append(cut(opened.coalesce(1).mapInPandas(_from_open(last=True), OUT), "trie"))
            break
        found.append(cut(opened.repartitionByRange(shards, "key").mapInPandas(_from_open(last=False), OUT), "trie"))
    done = [f.filter("NOT open") for f in found]
    result = [F.col(c) for c in _COLUMNS[3:11]]
    upper = done[1]
    for f in done[2:]:
        upper = upper.unionByName(f)
    ids = upper.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    every = upper.unionByName(done[0])
    known = every.filter("parent IS NULL").select(*result)
    asked = every.filter("parent IS NOT NULL").join(ids, "parent", "left")
    return known.unionByName(asked.withColumn("parent_conv_id", F.col("above")).select(*result))
