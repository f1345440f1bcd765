"""Personal data: base spans against plain regular expressions, the learned part on planted rows."""

import hashlib
import random
import re
import time

import numpy as np

from sigweave.llm import private_data as pd
from sigweave.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, kind string, pii int, form string, start string"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1, "f", "s") for i, t in enumerate(texts)], ODD)


def found(spark, texts):
    out = pd.scan(frame(spark, texts))
    assert out.columns == ["doc_id", "text", "kind", "form", "start", "pii"]
    return {r.doc_id: r.pii for r in out.collect()}


CASES = [
    None, "", "a@b.c", "a@b.c_d@e.f", "a@b@c.de", "x..@-.-. a@b.c.", "a@b.c@d.e f@g", "😀 é a@b.co, ü+x%y@z-1.example.com\nq",
    "1.2.3.4.5.6.7.8.9", "1.2.3.256 256.1.1.1.1 0255.1.1.01", "1.2.3", "12.34.56.78.",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111 1111 1111", "4111 1111 1111 1112", "1 4111111111111111", "0" * 19, "0" * 20, "0" * 13,
    "+1 (017) 555-7713", "+12345678", "+123456789 +1234567890123456", "++1 2 3 4 5 6 7 8 9 ( ", "+1.....2+34 123 456 789()", "\x01+1 555 123 4567\x02\x01",
    "+1 4111 1111 1111 1111", "5500005555555559 5500 0055 5555 5559-1",
]


def test_base_spans_equal_plain_expressions(spark):
    rng = random.Random(5)
    texts = CASES + ["".join(rng.choice("ab@..-+ 0123456789()_\n") for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(60)) for _ in range(200)] + CASES[:5]
    got = found(spark, texts)
    assert {i: [(s.kind, s.start, s.end) for s in got[i] if s.base] for i in got} == dict(enumerate(map(base_spans, texts)))


def test_the_query_equals_plain_expressions_on_whole_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op13_private_data"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == w[0] for w in want) for k in pd.KINDS]
        named = [":".join(map(str, w)) for w in want]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest() and set(named) <= set(filter(None, r.spans.split(",")))


def test_no_python_and_no_exchange_of_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for plan in (pd.candidates(docs), QUERIES["op13_private_data"](spark, SF_DIR)):
        said = plan._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Exchange|Cartesian", said)


def planted(rng, n):
    word = lambda: "".join(rng.choice("bcdfgklmnrst") + rng.choice("aeiou") for _ in range(3))
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows = []
    for i in range(n):
        name, host = word(), word()
        mail, phone = f"{name}@{host}.com", f"+1 {number()}"
        rows.append((f"{word()} {word()} mail {mail} or call {phone} today", []))
        if i % 3 == 0:
            rows.append((f"{word()} please contact {name} (at) {host} (dot) org soon", [("email", f"{name} (at) {host} (dot) org")]))
        if i % 3 == 1:
            local = number()
            rows.append((f"{word()} phone {local} {word()}", [("phone", local)]))
        if i % 3 == 2:
            rows.append((f"order 4{rng.randrange(10**14, 10**15)} {word()}", []))
        rows.append((f"{word()} {word()} {word()}", []))
    return rows


def test_loose_candidates_are_added_where_the_evidence_holds(spark):
    rows = planted(random.Random(6), 120)
    got = found(spark, [t for t, _ in rows])
    hits = wanted = wrong = 0
    for i, (text, more) in enumerate(rows):
        added = {(s.kind, text[s.start : s.end]) for s in got[i] if not s.base}
        hits, wanted, wrong = hits + len(added & set(more)), wanted + len(more), wrong + len(added - set(more))
        assert all(0 <= s.score <= 1 for s in got[i])
    assert hits >= 0.9 * wanted and wrong <= 0.02 * wanted


def test_estimation_finds_the_reliabilities_it_was_given():
    rng = np.random.default_rng(7)
    truth, right = rng.random(20_000) < 0.3, [(0.98, 0.03), (0.9, 0.2), (0.7, 0.1), (0.95, 0.4), (0.6, 0.05)]
    votes = np.stack([np.where(rng.random(len(truth)) < np.where(truth, p, q), 1, 0) for p, q in right], axis=1)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, got = pd.estimate(patterns, counts.astype(float), pd.Settings(rule_weight=20))
    assert abs(prior - 0.3) < 0.02 and np.abs(got - np.array(right)).max() < 0.05


def test_very_long_texts(spark):
    plain = ["a@b.cd " * 50_000, "1." * 2_000, "4111111111111111x" * 300, "a@b" + ".c" * 500_000, "+1" + "()" * 500_000, "(at)" * 300_000]
    # Plain expressions would take the square of the length for these.
    steep = {
        "a" * 1_000_000: 0, "1" * 1_000_000: 0, "1 " * 500_000: 0, "+" * 1_000_000: 0, "a@" * 500_000: 0,
        "1." * 200_000: 50_000, "4111111111111111x" * 20_000: 20_000,
    }
    started = time.time()
    got = found(spark, [*plain, *steep])
    assert time.time() - started < 120
    for i, text in enumerate(plain):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.base] == base_spans(text)
    assert [len(got[len(plain) + i]) for i in range(len(steep))] == list(steep.values())


def test_empty_tables(spark):
    assert found(spark, []) == {} and found(spark, ["no data", None]) == {0: [], 1: []}
