"""Mixing, models, chat formatting and secrets."""

import base64
import gzip
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import compare, connect
from sigweave.llm import chat, language, mixing, quality, secret_scan, toxicity
from sigweave.llm.lexicon import Automaton, Term, default_edits
from sigweave.llm.queries import ORACLES, QUERIES
from sigweave.llm.subword import held_out

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    ok, note = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok and ", types" not in note, note


def water(sizes, weights, total, most):
    level, full = {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        level = {s: most * sizes[s] if s in full else left * weights[s] / weight for s in sizes}
        over = {s for s in sizes if s not in full and level[s] > most * sizes[s]}
        if not over:
            return level
        full |= over


def test_mix_meets_its_targets_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    docs = docs.withColumn("source", F.when(F.col("source") != "src3", F.col("source"))).withColumn("size", F.lit("x"))
    rows = mixing.mixed(docs).drop("text").toPandas()
    again = mixing.mixed(docs.repartition(5)).drop("text").toPandas()
    assert rows.set_index("doc_id").taken.to_dict() == again.set_index("doc_id").taken.to_dict()
    assert (rows.taken <= 2 * rows["size"]).all() and len(rows) == 1000
    by = rows.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    order = sorted(x for x in by.index if isinstance(x, str)) + [x for x in by.index if not isinstance(x, str)]
    sizes = dict(zip(order, by.loc[order, "size"], strict=True))
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    assert by.loc[order, "target"].tolist() == pytest.approx(list(want.values()))
    assert (abs(by.taken - by.target) <= 0.01 * by.target).all()


def test_the_border_keeps_short_and_long_documents_alike():
    rng, sizes, hits = np.random.default_rng(1), np.array([1, 50] * 200), np.zeros(400)
    room = 0.3 * sizes.sum()
    for _ in range(1_000):
        ranked = pd.DataFrame({"key": np.arange(400).astype(str), "tie": np.arange(400), "source": "s", "rank": rng.random(400), "left": room, "target": room, "words": sizes})
        took = mixing._fill(ranked).sort_values("tie").took.to_numpy()
        order = ranked["rank"].argsort().to_numpy()
        border = int((sizes[order].cumsum() <= room).sum())
        assert (took[order] != (np.arange(400) < border)).sum() <= 3 and abs(sizes[took].sum() - room) <= 25
        hits += took
    assert abs(hits[::2].mean() - 300) < 6 and abs(hits[1::2].mean() - 300) < 6


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "x y z", "s"), (3, None, "s"), (4, "", "t"), (5, "q", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit(0))
    got = mixing.mixed(docs).collect()
    assert len(got) == 6 and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert {r.taken for r in got if not r.text} == {0}
    mixture = mixing.mixture(docs)
    assert mixture.columns == ["doc_id", "text", "source", "copy"] and mixture.count() == sum(r.copies for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_models_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    back = held_out(F.col("doc_id"), 5, 0)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !!")], "doc_id long, text string")
    said = language.predicted(docs.select("doc_id", "text", "lang").filter(back).unionByName(odd, True), language.learn(docs, ~back)).toPandas()
    assert said[said.doc_id < 0].lang_pred.tolist() == ["und"] * 3 and said.score.between(0, 1).all()
    real = said[said.doc_id >= 0]
    assert (real.lang == real.lang_pred).mean() > 0.97
    assert language.learn(docs.limit(0), ~back) is None
    assert language.predicted(odd, None).count() == 3

    third = held_out(F.col("doc_id"), 3, 1)
    model = quality.learn(docs, labels.filter(~third))
    got = quality.scored(docs.join(labels, "doc_id").filter(third).select("doc_id", "text", "quality").unionByName(odd, True), model).toPandas()
    real = got[got.doc_id >= 0]
    assert (real.predicted == real.quality).mean() > 0.95 and got.score.between(0, 1).all() and len(got) == len(real) + 3

    model = toxicity.learn(docs, labels.filter(~back))
    got = toxicity.scored(docs.join(labels, "doc_id").filter(back).select("doc_id", "text", "toxic").unionByName(odd, True), model).toPandas()
    real = got[got.doc_id >= 0]
    assert real[real.toxic == 0].predicted.sum() == 0 and real[real.toxic == 1].predicted.mean() >= 0.6
    term = next(t.text for t in model.terms if t.edits)
    texts = [f"you {term} person", f"you {term[:2]}x{term[2:]} person", f'the word "{term}" is rude', "a fine day"]
    scores = [r.score for r in toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert scores[0] > 0.5 and scores[1] > 0.5 and scores[2] < scores[0] and scores[3] < 0.5
    none = toxicity.learn(docs, labels.limit(0))
    assert none.terms == [] and toxicity.scored(odd, none).count() == 3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = [Term("stupid", 1), Term("worthless", 2), Term("scum", 0), Term("stump", 1)]
    reader = Automaton(terms)
    for word in "stupid stupidity stpid sttupid stuped sxxpid upid scum scam scummy worthles wortles wrthlss stum stumpy s w".split():
        least = [min((edits(word[:n], t.text), i) for n in range(1, len(word) + 1)) for i, t in enumerate(terms)]
        want = min((x for x in least if x[0] <= terms[x[1]].edits), default=None)
        got = reader.match(word)
        assert (got and got[0]) == (want and want[0]), (word, got, want)


def test_first_characters_symbols_and_short_terms_may_be_misspelled():
    terms = [Term(t, default_edits(t)) for t in ("idiot", "stupid", "scum", "worthless")]
    reader = toxicity.Reader(terms, [1.0] * len(terms))
    for word in "1diot ldiot diot xidiot riot tupid scam cum orthles vvorthless the ot".split():
        least = [(min(edits(word[:n], t.text) for n in range(1, len(word) + 1)), i) for i, t in enumerate(terms)]
        want = min((x for x in least if x[0] <= terms[x[1]].edits), default=None)
        assert reader.match(word) == want, word
    for text, term in {"$tupid": 1, "you ($tupid)": 1, "st*pid!": 1, "a sc*m": 2, "**idiot**": 0, "so/1d*ot": None, "fine-day": None, "w*rthl*ss": 3}.items():
        assert {h[1] for h in reader.hits(text)[0]} == ({term} - {None}), text


def test_a_forgetful_automaton_reads_the_same():
    terms = [Term(t, default_edits(t)) for t in ("idiot", "stupid", "scum", "worthless", "ass")]
    small, large, rng = Automaton(terms, most=40), Automaton(terms), random.Random(2)
    for _ in range(5_000):
        word = "".join(rng.choice("idotsupcmwrhleäx1$") for _ in range(rng.randrange(1, 12)))
        assert small.match(word) == large.match(word), word
    assert len(small.states) < len(large.states)


def test_masked_words_and_quotations_equal_plain_expressions():
    masked = re.compile(r"\w*(?:[^\w\s\"“”«»„]+\w+)+")
    quoted = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("ab$ *\"“”«»„\n!") for _ in range(rng.randrange(25)))
        assert [m.span() for m in toxicity.MASKED.finditer(text)] == [m.span() for m in masked.finditer(text)], text
        assert toxicity.quotations(text) == [m.span() for m in quoted.finditer(text)], text


def test_very_long_texts_are_read_once():
    terms = [Term(t, default_edits(t)) for t in ("idiot", "stupid")]
    reader = toxicity.Reader(terms, [1.0, 1.0])
    began = time.process_time()
    for part, tells in {"a": False, "!": False, "a$": False, "“\"": False, "stupid ": True}.items():
        assert (reader.features(part * (1_000_000 // len(part)))[0] > 0) == tells
    far = '"' + "a fine day " * 2_000 + 'you idiot"'
    assert reader.hits(far)[0][0][3] and not reader.hits(far.replace("day", "day\n"))[0][0][3]
    assert time.process_time() - began < 60


def test_chats_round_trip(spark):
    rows = [
        (1, 1, "assistant", "####</tur\\"), (1, 0, "user", "a###b\\3</turn>\n\\e"), (2, 0, "assistant", None), (2, 1, None, "x\n:\nb"),
        (3, 0, "we\nird:\n### ", "</turn></turn>"), (None, None, "user", "é"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    got = {r.conv_id: r for r in chat.parse(chat.format_chats(turns)).collect()}
    read = {i: [(t.role, t.text) for t in r.turns] for i, r in got.items()}
    assert read == {
        1: [("user", "a###b\\3</turn>\n\\e"), ("assistant", "####</tur\\")], 2: [("assistant", ""), ("", "x\n:\nb")],
        3: [("we\nird:\n### ", "</turn></turn>")], None: [("user", "é")],
    }
    assert got[1].valid and not got[2].valid and got[1].loss_text == "####</tur\\"
    assert chat.parse(chat.format_chats(turns.limit(0))).count() == 0
    plan = QUERIES["op6_chat"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets_in_layers(spark):
    key = b"password=hunter2secret"
    wrapped = base64.b64encode(gzip.compress(base64.b64encode(key))).decode()
    twice = "".join(f"%{c:02x}" for c in b"token%3Dabcdefgh")
    texts = [
        "é token: token=abcdef", f"x {wrapped} y", twice, "\\u0041KIA" + "A1" * 10, "secret=abc passwd='0123456'", None, "",
        "deadbeef" * 4, "%41%", "AKIA", "=" * 50, base64.b64encode(b"\x00\xff" * 20).decode(),
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, secrets int")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.secrets] for r in secret_scan.scan(docs).collect()}
    assert got == {
        0: [("assign", 2, 21, True)], 1: [("assign", 2, 2 + len(wrapped), False)], 2: [("assign", 0, len(twice), False)],
        3: [("access", 0, 29, False)], 4: [("assign", 11, 26, True)], 5: [], 6: [], 7: [("hex", 0, 32, True)], 8: [], 9: [], 10: [], 11: [],
    }
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_secrets_in_wrapped_lines_broken_layers_and_repeated_compression(spark):
    key = b"note " * 20 + b"password=hunter2secret" + b" end" * 20
    def lines(raw, width=76, end="\n"):
        text = base64.b64encode(raw).decode()
        return end.join(text[i : i + width] for i in range(0, len(text), width))

    def spans(text):
        return {(text[a:b].replace("\r", "").replace("\n", ""), base) for _, a, b, base, _ in secret_scan.unwrap(text)[0]}

    def found(text, part=key):
        return any(b"password=hunter2secret" in base64.b64decode(s + "=" * (-len(s) % 4)) for s, base in spans(text) if not base)

    for width, end in ((76, "\n"), (64, "\r\n"), (30, "\n")):
        assert found("x: y\n" + lines(key, width, end) + "\nrest"), (width, end)
    packed = lines(gzip.compress(bytes(random.Random(5).randbytes(150)) + key))
    assert [s[:3] for s in secret_scan.unwrap("a\n" + packed)[0]] == [("assign", 2, 2 + len(packed))]
    broken = base64.b64encode(b"\xff\xfe password=hunter2secret \x80").decode()
    assert [s[0] for s in secret_scan.unwrap(broken)[0]] == ["assign"] and found(broken)
    nested = b"token=abcdefgh"
    for _ in range(70):
        nested = gzip.compress(nested)
    assert [s[0] for s in secret_scan.unwrap(base64.b64encode(nested).decode())[0]] == ["assign"]
    small = secret_scan.Limits(times=1, floor=1_000)
    bomb = base64.b64encode(gzip.compress(b" " * 100_000 + key)).decode()
    assert secret_scan.unwrap(bomb, small) == ([], True) and secret_scan.unwrap(bomb)[1] is False
    docs = spark.createDataFrame([(1, bomb, True), (2, None, True)], "doc_id long, text string, secrets_cut boolean")
    got = {r.doc_id: (len(r.secrets), r.secrets_cut) for r in secret_scan.scan(docs).collect()}
    assert got == {1: (1, False), 2: (0, False)}


def test_secrets_of_very_long_texts():
    began = time.process_time()
    for part in ("a", "=", "%41", "\\u0041", "QUJD\n", "password=hunter2 ", "0123456789abcdef" * 4 + "\n"):
        secret_scan.unwrap(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 90


def test_pipeline_runs_and_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF_DIR)
        assert after.columns == docs.columns
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        before = after
    final = corpus_pipeline.STAGES[-1][1](spark, before, SF_DIR)
    assert final.columns == [*docs.columns, "copy"] and final.count() > 0
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), SF_DIR).count() == 0
