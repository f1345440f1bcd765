"""Exact, near and substring dedup, and decontamination, against brute force on small rows."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sigweave.llm import decontaminate, exact_dedup, simhash, suffix_dedup
from sigweave.llm.components import components
from sigweave.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, kept int, fp string, n_bytes int, component_id string"


def rows_of(*texts):
    return [(i, t, 7, "x", 1, "y") for i, t in enumerate(texts)]


def test_exact_dedup_of_nulls_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([*rows_of("a", "a", None, "", "b"), (1, "a", 8, "x", 1, "y"), (None, "b", 7, "x", 1, "y")], ODD)
    got = {(r.doc_id, r.text): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.with_copies(docs).collect()}
    assert got == {
        (0, "a"): (1, 3, False), (1, "a"): (1, 3, True), (2, None): (3, 2, False), (3, ""): (3, 2, True),
        (4, "b"): (4, 2, True), (None, "b"): (4, 2, False),
    }
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a"), (3, ""), (4, "b")]
    assert exact_dedup.with_copies(docs.limit(0)).count() == 0
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_exact_dedup_runs_no_python(spark):
    plan = QUERIES["op8_exact_dedup"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def plain_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_near_groups_equal_brute_force(spark):
    random.seed(3)
    words = "the of and in to is that it for was on are with as".split()
    base = [[random.choice(words) for _ in range(random.randrange(0, 60))] for _ in range(30)]
    texts = [" ".join(w) for w in base] + [" ".join(w[:-1] + ["X"]) for w in base] + [None, "", " \n", "Ä b\u00a0c", "A", "a"]
    docs = spark.createDataFrame(rows_of(*texts), ODD)
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = classes(prints, near)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 40, 200])
def test_runs_join_what_pairs_join(n):
    rng = np.random.default_rng(n)
    flips = np.uint64(1) << rng.integers(0, 8, (n, 3)).astype(np.uint64)
    fp = np.uint64(0xABCDEF) ^ np.bitwise_xor.reduce(flips, axis=1)
    for radius in (2, 3):
        pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if int(fp[a] ^ fp[b]).bit_count() <= radius]
        assert classes(range(n), simhash._tree(fp, 0, radius)) == classes(range(n), pairs)
        assert classes(range(n), simhash._by_masks(fp, radius)) == classes(range(n), pairs)


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for link in links for x in link}
    want = {i: r for i, r in classes(nodes, links).items() if i != r}
    assert got == want


def kept_of_groups(rows):
    """The rows that stay by brute force: of each component of fingerprints the smallest (key, hash), nulls last."""
    prints = [plain_print(t) for _, t in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = classes(range(len(rows)), near)
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    best = {}
    for i, r in enumerate(rows):
        best[roots[i]] = min(best.get(roots[i], order(r)), order(r))
    return [r for i, r in enumerate(rows) if order(r) == best[roots[i]]]


def test_near_dedup_keeps_one_key_of_each_group_and_all_else(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("the of and in to is that it for was on are with as".split())
    base = [[word() for _ in range(rng.randrange(0, 80))] for _ in range(30)]
    long = [f"w{i}" for i in range(3_000)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 - i, " ".join(w[:-1] + ["X"])) for i, w in enumerate(base)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (200, None), (None, ""), (201, " \n"), (202, "A b"), (203, "a B"), (None, "lone text here")]
    rows += [(300, " ".join(long)), (299, " ".join(long[:1500] + ["new"] + long[1501:])), (301, "x" * 2_000_000), (302, "x" * 2_000_000)]
    docs = spark.createDataFrame([(i, t, 7, "x", 1, "y") for i, t in rows], ODD)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(kept_of_groups(rows), key=str)
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def without(rows, n):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings_go(spark):
    texts = ["abcabcabcabcabc", "xxabcabcxx", None, "", "zzzzzzzzzzzz", "hello wörld hello wörld", "qwertyuiop", "qwertyuiop", "__wertyuio__"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows_of(*texts), ODD)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs, 6).collect()}
    assert got == without(rows, 6)
    assert suffix_dedup.without_repeats(docs.limit(0), 6).count() == 0


def test_surroundings_alike_are_found_for_every_split_into_batches():
    random.seed(8)
    rows = sorted((random.randrange(6), random.randrange(3), random.randrange(2), u, u) for u in range(40)) + [(9, 0, 0, 99, 99)]
    table = pa.Table.from_pylist([dict(zip(("h", "s1", "s2", "uid", "at"), r)) | {"begin": 0, "end": 9} for r in rows])
    count, digests = Counter(r[:3] for r in rows), Counter(h for h, _, _ in {r[:3] for r in rows})
    last = {r[:3]: r for r in rows}
    expected = [(r[3], count[r[:3]] > 1, digests[r[0]] > 1 and last[r[:3]] == r) for r in rows]
    expected = [e for e in expected if e[1] or e[2]]
    for size in (1, 2, 3, 7, 100):
        out = [x for b in suffix_dedup._alike(iter(table.to_batches(size))) for x in b.to_pylist()]
        assert [(x["uid"], x["twice"], x["sorted"]) for x in out] == expected


def test_surroundings_alike_are_not_sorted(spark, monkeypatch):
    random.seed(9)
    a, b = ("".join(random.choice("abcdefghij") for _ in range(3000)) for _ in range(2))
    near = a[:1500] + "#" + a[1501:]
    texts = [a, a, near, b, b[:900] + a[700:1100], "ä" + a[:199], a[:200] + "y", "z" * 450, None]
    sizes = []
    sort = suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda s, n, *x: sizes.append(n) or sort(s, n, *x))
    docs = spark.createDataFrame(rows_of(*texts), ODD)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs, 200).collect()}
    assert got == without(list(enumerate(texts)), 200)
    assert 0 < sizes[0] < sum(len(t or "") for t in texts) / 2


def edited(n, seed):
    """A text, edited copies of it with a long common line and runs of a period, and null."""
    random.seed(seed)
    base = "".join(random.choice("abcdefghij") for _ in range(1200))
    line = "".join(random.choice("klmnop") for _ in range(120))
    texts = [base, "xyz" * 200, None, "xyz" * 90 + base[300:700], line + "é" * 150]
    for _ in range(n):
        k = random.randrange(1200)
        texts.append(base[:k] + random.choice("#-+") + base[k + random.randrange(3) :] + line + base[random.randrange(1100) :])
    return texts


def cut_texts(docs, length):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs, length).collect()}


def test_one_row_is_sorted_for_the_strings_of_an_anchor(spark, monkeypatch):
    texts = edited(12, 10)
    sizes = []
    sort = suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda s, n, *x: sizes.append(n) or sort(s, n, *x))
    assert cut_texts(spark.createDataFrame(rows_of(*texts), ODD), 200) == without(list(enumerate(texts)), 200)
    assert 0 < sizes[0] < sum(len(t or "") for t in texts) / 40


@pytest.mark.parametrize("length", [60, 200])
def test_grams_too_many_for_a_portion_lose_no_string(spark, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "HELD", 2)
    texts = edited(12, 11)
    docs = spark.createDataFrame(rows_of(*texts), ODD)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "11"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert cut_texts(docs, length) == without(list(enumerate(texts)), length)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_induced_strings_equal_brute_force_for_every_portion(monkeypatch):
    random.seed(12)
    length, texts = 30, ["".join(random.choice("ab") for _ in range(120)) for _ in range(3)]
    texts += [t[:60] + random.choice("abc") + t[61:] for t in texts for _ in range(6)] + ["ab" * 40, "ba" * 20, "\0" * 50]
    rows, strings = [], Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for uid, text in enumerate(texts):
        at, _, first, last = suffix_dedup.anchors(suffix_dedup._bytes(text), length)
        assert [p for f, e in zip(first, last) for p in range(f, e + 1)] == list(range(len(text) - length + 1))
        for a, f, e in zip(at.tolist(), first.tolist(), last.tolist()):
            raw = text.encode()
            rows.append({"uid": uid, "i": a, "before": raw[f:a], "rank": raw[a : e + length], "gram": raw[a : a + 10], "many": True})
    expected = {(u, p) for u, t in enumerate(texts) for p in range(len(t) - length + 1) if strings[t[p : p + length]] > 1}
    table = pa.Table.from_pylist(sorted(rows, key=lambda r: r["rank"]))
    for held in (1, 3, 10, 1000):
        monkeypatch.setattr(suffix_dedup, "HELD", held)
        found = set()
        out = [x for b in suffix_dedup._induced(length)(iter(table.to_batches(min(held, 7)))) for x in b.to_pylist()]
        texts_beyond = Counter(x["text"] for x in out if x["text"] is not None)
        for x in out:
            begin, size = divmod(x["stretch"], 2 * length)
            if x["text"] is None or texts_beyond[x["text"]] > 1:
                found |= {(x["uid"], p) for p in range(begin, begin + size - length + 1)}
        assert found == expected


def test_stretches_alike_in_a_batch_are_told_once_more(spark):
    texts = ["xy" * 2000, "xy" * 2000 + "z", "yx" * 300]
    docs = spark.createDataFrame(rows_of(*texts), ODD)
    assert cut_texts(docs, 200) == without(list(enumerate(texts)), 200)


def test_suffix_order_is_the_order_of_suffixes(spark):
    random.seed(5)
    string = [random.choice((1, 2)) for _ in range(60)]
    order = suffix_dedup.suffix_order(spark.createDataFrame(list(enumerate(string)), "i long, c long"), 60, 200)
    got = [r.i for r in order.orderBy("rank").collect()]
    assert got == sorted(range(60), key=lambda i: string[i:])


def test_decontamination_equals_brute_force(spark):
    random.seed(6)
    words = [f"w{i}" for i in range(400)]
    items = [[random.choice(words) for _ in range(random.randrange(12, 40))] for _ in range(12)]
    texts = []
    for k, item in enumerate(items):
        edited = item[:-1] + ["zz"] if k % 3 == 1 else item[: len(item) // 2] if k % 3 == 2 else item
        texts.append(" ".join([random.choice(words) for _ in range(50)] + edited + [random.choice(words) for _ in range(20)]))
    texts += [" ".join(items[0]).upper(), " ".join(items[1][1:]), "", None, "w1 w2", "short one"]
    benchmark = [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, "Short  one"), (51, None), (None, "")]

    def similar(text):
        own, found = (text or "").lower().split(), set()
        for i, t in benchmark:
            item = (t or "").lower().split()
            if not item:
                continue
            if len(item) < 5 or len(own) < 5:
                found |= {i} if own == item else set()
                continue
            want = Counter(tuple(item[k : k + 5]) for k in range(len(item) - 4))
            n = min(len(own), len(item))
            for at in range(len(own) - n + 1):
                have = Counter(tuple(own[at + k : at + k + 5]) for k in range(n - 4))
                if (have & want).total() >= 0.8 * (have | want).total() - 1e-9:
                    found.add(i)
        return found

    docs = spark.createDataFrame(rows_of(*texts), ODD)
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    got = {r.doc_id: {h.item_id for h in r.benchmark_hits} for r in decontaminate.marked(docs, items).collect()}
    assert got == {i: similar(t) for i, t in enumerate(texts)}
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, found in got.items() if not found}
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == len(texts)
    assert decontaminate.decontaminated(docs.limit(0), items).count() == 0
