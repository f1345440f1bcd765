"""The prefix trie against brute force, in one shard and in many, and the perfect hash."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sigweave.llm import prefix_trie as pt

ODD = "conv_id long, turn long, role string, text string, depth string, key int, units string"


def brute(rows):
    chats = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            chats[c].append(((turn is not None, turn or 0), role or "", text or ""))
    chats = {c: [(r, t) for _, r, t in sorted(said)] for c, said in chats.items()}
    whole = {}
    for c, said in chats.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(chats.get(c - c % 20, [])[:h] + said[h:])
    members = defaultdict(list)
    for c, said in sorted(whole.items()):
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
    nodes = defaultdict(list)
    for q in members:
        for d in range(len(q) + 1):
            nodes[q[:d]].append(q)
    below = lambda p: nodes[p]
    children = lambda p: [q for q in nodes[p] if len(q) == len(p) + 1]
    words = lambda p: len(p[-1][1].encode().split()) if p else 0
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in own if len(whole[c]) == len(p))
        out.append((
            own[0], len(p), members[p[:-1]][0] if p else None, len(own), len(children(p)), sum(not children(q) for q in below(p)),
            sum((len(members[q]) - 1) * words(q) for q in below(p)), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie_of(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], ODD)
    df = pt.trie(pt.rebuilt(pt.conversations(turns)))
    return sorted((tuple(r) for r in df.collect()), key=str)


def chats(seed, n, texts, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for k in range(rng.randrange(1, longest)):
            rows.append((c, k, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [pt.SHARD, 60])
def test_trie_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(pt, "SHARD", shard)
    rows = chats(1, 60, ["a b", "a", "", None, "c\x0bd\u00a0e"], 5)
    rows += [(c, k, "user", f"copy {k}") for c in range(2000, 2060) for k in range(6)]
    assert trie_of(spark, rows) == brute(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (40, None, "user", "first"), (40, 0, "a", "second"), (40, 0, "a", "second"),
        (41, 0, "user", None), (41, 0, None, "tie"), (43, 5, "us", "er:x"), (47, 5, "user", ":x"), (40, 1, "user", "w " * 200_000),
        (62, 0, "user", "x" * 1_000_000), (63, 0, "user", "only turn"),
    ]
    assert trie_of(spark, rows) == brute(rows)
    assert trie_of(spark, []) == []
    assert trie_of(spark, rows[:1]) == []


def test_a_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(pt, "SHARD", 40)
    rows = [(c, k, "user", f"turn {k}" if k < 110 else f"turn {k} of {c}") for c in (20, 40, 57) for k in range(120)]
    got = trie_of(spark, rows)
    assert max(r[1] for r in got) == 120 and got == brute(rows)


def test_slots_are_minimal_and_verified():
    digests = np.random.default_rng(2).integers(0, 1 << 63, (5_000, 2)).astype(np.uint64)
    table = pt.Slots(digests)
    assert sorted(table.of(digests).tolist()) == list(range(5_000))
    with pytest.raises(KeyError):
        table.of(digests + np.uint64(1))
    assert len(pt.Slots(digests[:0])) == 0 and len(pt.Slots(digests[:1])) == 1
