"""Toxicity: misspelled terms by Levenshtein automata, weighed by the window around them.

The lexicon is learned from labelled rows: beginnings of words that toxic documents use and clean
ones do not, in more documents than chance explains.  A hit is direct or quoted, and a misspelled
one tells a little less; a logistic model turns the most telling hits of a document, and how closely
its hits stand together, into a score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.llm.hashing import shingles, word_hashes
from sigweave.llm.lexicon import Automaton, Term, default_edits
from sigweave.llm.subword import Settings, sampled
from sigweave.llm.tables import added, cut, text_of

RESULT = ("score", "predicted")
WORDS = re.compile(r"\w+")
#: Words with symbols before or between them: one may stand for a character.  Tried only where a token
#: begins, as it fits there or nowhere in it: so a long token is read once.
MASKED = re.compile(r"(?<![^\s\"“”«»„])\w*(?:[^\w\s\"“”«»„]+\w+)+")
QUOTE = re.compile(r"[\"“”«»„\n]")
# What ends a quotation, by the mark that begins it.
CLOSED_BY = {'"': '"', "“": "”", "«": "»", "„": "“”"}
# Words that, shortly before a term, tell that it is mentioned rather than used.
REPORTING = frozenset("said says called calls word term quote quoted insult sagte wort nannte dijo palabra dit mot".split())
WINDOW = 8
FEATURES = 4
#: What is left of a term's weight for each edit of a misspelling.
EDITED = 0.85


@dataclass(frozen=True)
class Learning:
    """``rows`` of each label bound what is read; a term needs ``least`` toxic documents.

    A term is the beginning of words, of ``shortest`` to ``longest`` characters; a longer word is met by
    its beginning.  There are as many terms as the rows bear out.
    """

    rows: int = 3_000
    least: int = 4
    margin: float = 3.0
    clean_rate: float = 0.02
    ratio: float = 20.0
    shortest: int = 3
    longest: int = 16
    seed: int = 11


@dataclass
class Model:
    terms: list[Term]
    odds: list[float]  # how strongly a term tells, as a logarithm
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -4.0


def _beginnings(word: str, how: Learning) -> Iterator[str]:
    for n in range(how.shortest, min(len(word), how.longest) + 1):
        yield word[:n]


def _term_counts(how: Learning):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            count = {0: Counter(), 1: Counter()}
            for label, text in zip(frame["label"], frame["text"], strict=True):
                count[label].update({b for w in set(WORDS.findall((text or "").lower())) for b in _beginnings(w, how)})
            terms = list(count[0].keys() | count[1].keys())
            yield pd.DataFrame({"term": terms, "clean": [count[0][t] for t in terms], "toxic": [count[1][t] for t in terms]})

    return run


@F.pandas_udf(T.LongType())
def _family(texts: pd.Series) -> pd.Series:
    """Copies and near copies mostly share this: the least hash of five-word shingles."""
    least = [int(shingles(w, 5).min()) >> 1 if len(w) else 0 for w in word_hashes(texts.tolist())]
    return pd.Series(least, dtype="int64")


def _lexicon(counts: list[tuple[str, int, int]]) -> list[str]:
    """Of the beginnings that tell, the shortest that no longer one nearly replaces."""
    toxic = {term: n for term, _, n in counts}
    longer: dict[str, int] = {}
    for term, n in toxic.items():
        longer[term[:-1]] = max(n, longer.get(term[:-1], 0))
    chosen: set[str] = set()
    for term in sorted(toxic, key=len):
        begun = any(term[:n] in chosen for n in range(1, len(term)))
        if not begun and longer.get(term, 0) < 0.9 * toxic[term]:
            chosen.add(term)
    return sorted(chosen)


def quotations(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of what stands in quotation marks on one line, however long, leftmost first."""
    marks = [(m.start(), m[0]) for m in QUOTE.finditer(text)]
    ends: list[int | None] = [None] * len(marks)
    ahead: dict[str, int] = {}
    for i in range(len(marks) - 1, -1, -1):
        mark = marks[i][1]
        if mark == "\n":
            ahead.clear()
            continue
        ends[i] = min((ahead[c] for c in CLOSED_BY.get(mark, "") if c in ahead), default=None)
        ahead[mark] = i
    out, i = [], 0
    while i < len(marks):
        last = ends[i]
        if last is not None:
            out.append((marks[i][0], marks[last][0] + 1))
        i = i + 1 if last is None else last + 1
    return out


class Reader:
    """Reads texts with one model; words once read are remembered, within a bound."""

    REMEMBER = 200_000

    def __init__(self, terms: list[Term], odds: list[float]):
        self.automaton, self.odds = Automaton(terms), odds
        self.longest = max((len(t.text) + t.edits for t in terms), default=0)
        self.seen: dict[str, tuple[int, int] | None] = {}

    def match(self, word: str) -> tuple[int, int] | None:
        word = word[: self.longest]  # no term reaches further
        if word not in self.seen:
            if len(self.seen) >= self.REMEMBER:
                self.seen.clear()
            self.seen[word] = self.automaton.match(word)
        return self.seen[word]

    def masked(self, low: str) -> dict[int, tuple[int, int]]:
        """``(edits, term)`` by the place of a word that fits a term with the symbols around it: st*pid, $tupid."""
        out = {}
        for token in MASKED.finditer(low):
            first, stop = token.span()
            for word in WORDS.finditer(low, first, stop):
                at = word.start()
                read = [self.match(low[a : min(a + self.longest, stop)]) for a in {at, max(at - 1, first)}]
                if any(read):
                    out[at] = min(m for m in read if m)
        return out

    def hits(self, text: str | None) -> tuple[list[tuple[int, int, int, bool]], int]:
        """``(word number, term, edits, quoted)`` of each hit, and the number of words."""
        low = (text or "").lower()
        words = WORDS.findall(low)
        found = {w: m for w in set(words) if (m := self.match(w)) is not None}
        masked = self.masked(low)
        if not found and not masked:
            return [], len(words)
        quotes = quotations(low)
        begins, out = [a for a, _ in quotes], []
        for i, m in enumerate(WORDS.finditer(low)):
            if m[0] in found or m.start() in masked:
                edits, term = min(x for x in (found.get(m[0]), masked.get(m.start())) if x is not None)
                told = any(w in REPORTING for w in words[max(0, i - 3) : i])
                last = bisect_left(begins, m.start()) - 1  # the last quotation that begins before the word
                out.append((i, term, edits, told or (last >= 0 and m.start() < quotes[last][1])))
        return out, len(words)

    def features(self, text: str | None) -> list[float]:
        """The most telling direct and quoted hit; what direct hits tell per word, and within a window."""
        hits, n = self.hits(text)
        told = [(place, self.odds[term] * EDITED**edits, quoted) for place, term, edits, quoted in hits]
        direct = [(place, tells) for place, tells, quoted in told if not quoted]
        dense, first, sum_ = 0.0, 0, 0.0
        for place, tells in direct:
            sum_ += tells
            while place - direct[first][0] > WINDOW:
                sum_ -= direct[first][1]
                first += 1
            dense = max(dense, sum_)
        return [
            max((tells for _, tells in direct), default=0.0), max((tells for _, tells, quoted in told if quoted), default=0.0),
            math.log1p(100 * sum(tells for _, tells in direct) / max(n, 1)), math.log1p(dense),
        ]


def _fit(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Logistic regression with a little shrinkage; ``share`` of the weight is on label 1, and no hit speaks for a text."""
    w, b = np.zeros(x.shape[1]), 0.0
    each = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, len(y) - y.sum()))
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = each * (p - y)
        w = np.maximum(0, w - 0.3 * (x.T @ g + 1e-5 * w))
        b -= 0.3 * g.sum()
    return w, b


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text", how: Learning | None = None
) -> Model:
    """Lexicon and weights from labelled rows; without toxic rows the lexicon is empty.

    Null labels are left out, of several labels of a key the largest counts.  At most about
    ``rows`` rows of each label are used, of near copies one each.
    """
    how = how or Learning()
    once = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    some = F.broadcast(sampled(once, "label", "key", Settings(rows=how.rows, seed=how.seed)))
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).join(some, "key").select("label", "text")
    rows = cut_families(rows)
    n = dict(rows.groupBy("label").count().collect())
    all_labels = dict(once.groupBy("label").count().collect())
    counts = rows.mapInPandas(_term_counts(how), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = cut(counts.filter(F.col("toxic") >= how.least), "terms")
    tested, share = counts.count(), n.get(1, 0) / max(1, sum(n.values()))
    # How much likelier the counts are for a term that tells than by chance, against the number of terms tried.
    both = F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))
    ).otherwise(0.0)
    telling = counts.filter(
        (gain >= math.log(tested + 1) + how.margin) & (F.col("clean") <= how.clean_rate * n.get(0, 0))
        & (F.col("toxic") * (n.get(0, 0) + 1) >= how.ratio * (F.col("clean") + 0.5) * (n.get(1, 0) + 1))
    ) if 0 < share < 1 else counts.limit(0)
    best = telling.select("term", "clean", "toxic").collect()  # beginnings that the bounded sample of rows bears out
    toxic = {r[0]: r[2] for r in best}
    odds = {r[0]: math.log((r[2] + 0.5) * (n.get(0, 0) + 1) / (r[1] + 0.5) / (n.get(1, 0) + 1)) for r in best}
    chosen = sorted(_lexicon([tuple(r) for r in best]), key=lambda t: (-toxic[t], t))
    terms = [Term(t, default_edits(t)) for t in chosen]
    # A misspelling that clean documents write is a word of its own: such terms are taken exactly.
    loose = rows.filter("label = 0").mapInPandas(_misread(terms, [odds[t] for t in chosen]), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    odd = {r["term"] for r in loose if r["n"] > 0.0005 * n.get(0, 0)}
    terms = [Term(t.text, 0) if i in odd else t for i, t in enumerate(terms)]
    model = Model(terms, [odds[t] for t in chosen])
    got = rows.select("label", featured(model, docs)("text").alias("f")).toPandas()
    if got["label"].nunique() == 2:
        order = sorted(range(len(got)), key=lambda i: (got["label"].iloc[i], tuple(got["f"].iloc[i])))
        x = np.array([got["f"].iloc[i] for i in order], float)
        model.weights, model.bias = _fit(x, got["label"].iloc[order].to_numpy(), all_labels.get(1, 0) / max(1, sum(all_labels.values())))
    return model


def cut_families(rows: DataFrame) -> DataFrame:
    """One row of each family of near copies and label."""
    rows = rows.withColumn("family", _family("text"))
    first = rows.groupBy("label", "family").agg(F.min("text").alias("text"))
    return cut(first.select("label", "text"), "labelled")


def _misread(terms: list[Term], odds: list[float]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(terms, odds)
        for frame in frames:
            count = Counter(t for text in frame["text"] for t in {h[1] for h in reader.hits(text)[0] if h[2]})
            yield pd.DataFrame({"term": list(count), "n": list(count.values())})

    return run


def featured(model: Model, df: DataFrame):
    sent = df.sparkSession.sparkContext.broadcast((model.terms, model.odds))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(*sent.value)
        for part in texts:
            yield pd.Series([reader.features(t) for t in part], dtype=object)

    return features


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows with ``score``, the probability of label 1, and ``predicted``.

    Null and empty texts have no hit and score as any text without one.  Columns of the input named
    like a result are replaced.
    """
    rows = docs.withColumn("__f", featured(model, docs)(text_of(text)))
    z = F.lit(float(model.bias))
    for i, w in enumerate(model.weights):
        z = z + F.lit(float(w)) * F.col("__f")[i]
    rows = rows.withColumn("__score", 1 / (1 + F.exp(-z)))
    return rows.select(*added(docs, *RESULT), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, columns as in ``docs``."""
    kept = docs.withColumn("__row", F.struct(*added(docs)))
    return scored(kept, model, text).filter("predicted = 0").select("__row.*")
