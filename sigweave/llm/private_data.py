r"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidates: those of the base rules, and looser ones (written-out addresses, numbers
without a country code, card numbers that fail their check).  Five labelers - pattern, gazetteer, context
words, neighbouring characters, variety of digits - vote on a candidate or abstain.  Which of them to
believe is learned without labels: expectation-maximisation over the counts of vote patterns, a table of
bounded size, estimates how often each labeler is right, per kind.  The posteriors are soft labels for the
final classifier, a logistic model over the candidate's own features.  Base spans always stay; others are
added where the classifier accepts them.

A pattern is matched once per text: it puts marks around its matches, and the text is cut at the marks.
The pieces are gap, match, gap, ..., so their running lengths are the places of the matches.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.tables import cut, text_of

# The kinds, in the order of results, and the base rules.  The patterns say the same as
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+  with 13 to 19 digits
#   phone  \+[0-9][\x20().0-9-]+[0-9]
# but start only where a match can start and never step back, so that a text of one endless word or
# number takes linear time.  \G lets a match begin right behind the one before.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates.  None shares a character with a base match of its kind.
LOOSE = {
    "email": (
        r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+"
        r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}+"
    ),
    "phone": (
        r"(?<![0-9A-Za-z+.()-])(?<![0-9)][\x20.-])(?:\([0-9]{3}\)\x20?|(?:00[1-9][0-9]{0,2}[\x20.-])?[0-9]{3}[\x20.-])"
        r"[0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])(?![A-Za-z])"
    ),
}
#: A text without this has no match of the pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "email loose": "at", "phone loose": None, "card": None}

# Gazetteers and context words.
TOP_DOMAINS = (
    "com org net edu gov mil int info biz name io co dev app me tv example test invalid localhost "
    "de fr es it pt nl be ch at se no dk fi pl cz ru ua gr tr uk ie us ca mx br ar cl au nz jp kr cn in za eu"
)
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91"
ISSUERS = r"\A(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|35[0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12}|62[0-9]{14,17})\z"
NO_HOST = r"\A(?:0|127|255|169\.254|22[4-9]|2[3-5][0-9])\."
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)",
    "ip": r"(?i)\b(?:ip|address|host|client|server|login|from|visitor)\b",
    "card": r"(?i)\b(?:card|visa|master|amex|credit|debit|pan|cc|payment)",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|contact|whatsapp|sms|dial)",
}
AGAINST = r"(?i)\b(?:order|invoice|version|release|section|isbn|issn|doi|serial|part|ref|ticket|hash|build|figure|table)\b[^\n]{0,16}\z"

#: Marks put around a match; a text's own are read as the other, which no pattern takes either.
MARK, OTHER = "\x01", "\x02"
#: Characters before a candidate that its context labeler reads.
CONTEXT_CHARS = 48
LABELERS = ("pattern", "gazetteer", "context", "neighbours", "variety")
FORMS = (*KINDS, "email loose", "phone loose")


# -- candidates --------------------------------------------------------------------------------------------------------


def _sums(values: Column) -> Column:
    """The running sums of an array, in blocks of about the root of its length, as appending copies a block."""
    block = F.ceil(F.sqrt(F.size(values))).cast("int")
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(values, b * block + 1, block))
    none = F.array().cast("array<long>")

    def run(items: Column) -> Column:
        return F.aggregate(items, none, lambda done, x: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x))

    inner = F.transform(blocks, run)
    before = F.concat(F.array(F.lit(0).cast("long")), run(F.transform(inner, lambda b: F.element_at(b, -1))))
    pairs = F.arrays_zip(inner.alias("b"), F.slice(before, F.lit(1), F.size(starts)).alias("o"))
    return F.flatten(F.transform(pairs, lambda p: F.transform(p["b"], lambda x: x + p["o"])))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _passes(kind: str, text: Column) -> Column:
    """The base rule beyond its pattern."""
    if kind == "ip":
        part = r"0*(?:[1-9]?[0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return text.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return _luhn(_digits(text))
    return F.length(_digits(text)).between(9, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    """1, 0, or -1 where the labeler abstains."""
    return F.when(yes, 1).when(no, 0).otherwise(-1).cast("byte")


def _votes(form: str, x: Column) -> list[Column]:
    """The labelers' votes, in the order of LABELERS."""
    kind, text, digits = form.split()[0], x["text"], _digits(x["text"])
    in_list = lambda words: "(?:" + "|".join(words.split()) + ")"
    if form == "email":
        known = text.rlike(rf"(?i)\.{in_list(TOP_DOMAINS)}\z")
        gazetteer = _vote(known, ~known)
    elif form == "email loose":
        known = text.rlike(rf"(?i)(?:\.|dot.)\x20?{in_list(TOP_DOMAINS)}\z")
        gazetteer = _vote(known, ~known)
    elif kind == "ip":
        gazetteer = _vote(F.lit(False), text.rlike(NO_HOST))
    elif kind == "card":
        known = digits.rlike(ISSUERS)
        gazetteer = _vote(known, ~known)
    elif form == "phone":
        known = text.rlike(rf"\A\+{in_list(CALLING_CODES)}(?![0-9]{{11}})")
        gazetteer = _vote(known, ~known)
    else:
        gazetteer = _vote(text.startswith("00"), F.lit(False))
    rule = F.lit(False) if form.endswith("loose") else x["base"]
    pattern = _vote(rule, F.lit(kind == "card") & ~rule)
    context = _vote(x["before"].rlike(CONTEXT[kind]), x["before"].rlike(AGAINST))
    word = r"[\p{L}\p{N}_]"
    joined = x["before"].rlike(word + r"\z") | x["after"].rlike(r"\A" + word)
    variety = F.size(F.array_distinct(F.split(digits, "")))
    poor = (variety <= 2) | F.lit("0123456789012345678901234567890").contains(digits)
    dull = F.lit(False) if kind in ("email", "ip") else poor
    return [pattern, gazetteer, context, _vote(~joined, joined), _vote(F.lit(False), dull)]


def _class(text: Column) -> Column:
    """What a neighbouring character is: nothing 0, white space 1, letter or digit 2, another 3."""
    return F.when(text == "", 0).when(text.rlike(r"\A\s"), 1).when(text.rlike(r"\A[\p{L}\p{N}]"), 2).otherwise(3).cast("byte")


def candidates(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns, if not given) and ``__found``: the candidates of a text, with votes and features."""
    keep = docs.columns if keep is None else keep
    clean = F.translate(text_of(f"`{text}`"), MARK, OTHER)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], clean.alias("__text"))
    patterns = {**PATTERNS, **{f"{k} loose": p for k, p in LOOSE.items()}}

    def pieces(form: str) -> Column:
        marked = F.regexp_replace("__text", patterns[form], f"{MARK}$0{MARK}")
        need = F.lit(True) if NEEDS[form] is None else F.col("__text").contains(NEEDS[form])
        return F.when(need, F.split(marked, MARK, -1)).otherwise(F.array(F.lit("")))

    name = lambda what, form: f"__{what}_{form.replace(' ', '_')}"
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], *[pieces(f).alias(name("cut", f)) for f in FORMS])
    rows = rows.withColumns({
        name("end", f): F.transform(name("cut", f), lambda p: F.length(p).cast("long")) for f in FORMS
    })
    rows = rows.withColumns({
        name("end", f): F.when(F.size(name("cut", f)) > 1, _sums(F.col(name("end", f)))).otherwise(F.array(F.lit(0).cast("long")))
        for f in FORMS
    })

    def matches(form: str) -> Column:
        cuts, ends, n = F.col(name("cut", form)), F.col(name("end", form)), F.expr(f"(size({name('cut', form)}) - 1) div 2").cast("int")

        def one(i: Column) -> Column:
            match = cuts[2 * i + 1]
            return F.struct(
                ends[2 * i].alias("start"), ends[2 * i + 1].alias("end"), match.alias("text"),
                F.right(cuts[2 * i], F.lit(CONTEXT_CHARS)).alias("before"), F.left(cuts[2 * i + 2], F.lit(1)).alias("after"),
            )

        found = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), one)
        rule = F.lit(False) if form.endswith("loose") else None
        checked = F.transform(found, lambda x: x.withField("base", _passes(form, x["text"]) if rule is None else rule))
        if form in ("ip", "phone"):
            checked = F.filter(checked, lambda x: x["base"])

        def labelled(x: Column) -> Column:
            size = F.least(F.floor(F.length(x["text"]) / 8), F.lit(3)).cast("byte")
            return F.struct(
                F.lit(form.split()[0]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"),
                F.lit(form).alias("form"), F.array(*_votes(form, x)).alias("votes"), size.alias("size"),
                _class(F.right(x["before"], F.lit(1))).alias("left"), _class(x["after"]).alias("right"),
            )

        return F.transform(checked, labelled)

    return rows.select(*[F.col(f"`{c}`") for c in keep], F.concat(*[matches(f) for f in FORMS]).alias("__found"))


# -- reliabilities and the classifier ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """``belief``: what a labeler's being right is taken for before counting, and with what weight.  A checksum and
    a base pattern are known to be right, so theirs weighs more.  ``prior``: of a candidate being personal."""

    belief: float = 0.8
    weight: float = 20.0
    rule_belief: float = 0.98
    rule_weight: float = 1e6
    prior: float = 0.5
    rounds: int = 200
    steps: int = 60
    shrink: float = 1e-3


@dataclass(frozen=True)
class Model:
    """Reliabilities per kind and labeler as (says 1 if personal, says 1 if not), the priors, and the classifier's weights."""

    reliabilities: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    priors: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)


def _posterior(votes: np.ndarray, prior: float, right: np.ndarray) -> np.ndarray:
    logit = np.full(len(votes), math.log(prior / (1 - prior)))
    for k, (p, q) in enumerate(right):
        logit += np.where(votes[:, k] == 1, math.log(p / q), np.where(votes[:, k] == 0, math.log((1 - p) / (1 - q)), 0.0))
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def estimate(votes: np.ndarray, counts: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """Prior and reliabilities by expectation-maximisation over distinct vote patterns (rows) and their counts."""
    belief = np.array([s.rule_belief] + [s.belief] * (len(LABELERS) - 1))
    weight = np.array([s.rule_weight] + [s.weight] * (len(LABELERS) - 1))
    right, prior = np.stack([belief, 1 - belief], axis=1), s.prior
    for _ in range(s.rounds):
        p = _posterior(votes, prior, right)
        before = right.copy(), prior
        prior = float((counts @ p + s.weight * s.prior) / (counts.sum() + s.weight))
        for k in range(len(LABELERS)):
            spoke, yes = votes[:, k] >= 0, votes[:, k] == 1
            for side, share in enumerate((p, 1 - p)):
                start = belief[k] if side == 0 else 1 - belief[k]
                right[k, side] = (counts[yes] @ share[yes] + weight[k] * start) / (counts[spoke] @ share[spoke] + weight[k])
        right = np.clip(right, 1e-4, 1 - 1e-4)
        if np.abs(right - before[0]).max() < 1e-9 and abs(prior - before[1]) < 1e-9:
            break
    return prior, right


def _features(row) -> list[str]:
    """Names of what holds for a candidate: its form (with the base check), size, neighbours, and what its labelers saw."""
    seen = [f"{row['form']} {name} {v}" for name, v in zip(LABELERS[1:], row["votes"][1:], strict=True) if v >= 0]
    return [f"form {row['form']} {str(row['base']).lower()}", f"size {row['kind']} {row['size']}", f"left {row['left']}", f"right {row['right']}", *seen]


def _logistic(rows: list[list[str]], counts: np.ndarray, labels: np.ndarray, s: Settings) -> dict[str, float]:
    """Weights of the features by Newton's method on soft labels; a row stands for ``counts`` candidates."""
    names = sorted({f for r in rows for f in r})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r]] = 1
    c, w = counts / counts.sum(), np.zeros(len(names))
    for _ in range(s.steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        slope = x.T @ (c * (labels - p)) - s.shrink * w
        step = np.linalg.solve((x.T * (c * np.maximum(p * (1 - p), 1e-6))) @ x + s.shrink * np.eye(len(names)), slope)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-10:
            break
    return dict(zip(names, w.tolist(), strict=True))


def learn(found: DataFrame, settings: Settings = Settings()) -> Model:
    """Labelers' reliabilities and the classifier, from ``__found`` of all documents.

    One aggregation; the driver gets the counts of distinct (form, votes, features), at most
    6 forms x 3^5 votes x 4 sizes x 4 x 4 neighbours x 2, however large the corpus.
    """
    of = ["kind", "form", "base", "votes", "size", "left", "right"]
    groups = (
        found.select(F.explode("__found").alias("f")).groupBy(*[F.col(f"f.{c}").alias(c) for c in of])
        .agg(F.count(F.lit(1)).alias("n")).collect()
    )
    if not groups:
        return Model()
    groups.sort(key=lambda g: (g["form"], g["base"], list(g["votes"]), g["size"], g["left"], g["right"]))
    votes, counts = np.array([g["votes"] for g in groups]), np.array([float(g["n"]) for g in groups])
    labels, reliabilities, priors = np.zeros(len(groups)), {}, {}
    by = defaultdict(list)
    for i, g in enumerate(groups):
        by[g["kind"]].append(i)
    for kind, own in by.items():
        priors[kind], right = estimate(votes[own], counts[own], settings)
        labels[own] = _posterior(votes[own], priors[kind], right)
        reliabilities[kind] = [tuple(r) for r in right.tolist()]
    return Model(reliabilities, priors, _logistic([_features(g) for g in groups], counts, labels, settings))


def _score(x: Column, model: Model) -> Column:
    weight = F.create_map(*[F.lit(v) for item in sorted(model.weights.items()) for v in item])
    name = lambda *parts: F.concat_ws(" ", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    own = [
        name("form", x["form"], x["base"].cast("string")), name("size", x["kind"], x["size"].cast("string")),
        name("left", x["left"].cast("string")), name("right", x["right"].cast("string")),
        *[name(x["form"], labeler, x["votes"][k].cast("string")) for k, labeler in enumerate(LABELERS) if k],
    ]
    logit = F.lit(0.0)
    for feature in own:
        logit = logit + F.coalesce(weight[feature], F.lit(0.0))
    return 1 / (1 + F.exp(-logit))


def accepted(found: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``pii`` in place of ``__found``: (kind, start, end, base, score), by kind as in KINDS and then by start."""
    keep = [F.col(f"`{c}`") for c in found.columns if c not in ("__found", "pii")]
    if not model.weights:
        return found.select(*keep, F.array().cast("array<struct<kind:string,start:long,end:long,base:boolean,score:double>>").alias("pii"))
    spans = F.transform("__found", lambda x: F.struct(
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("order"), x["start"].alias("start"),
        x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"), _score(x, model).alias("score"),
    ))
    good = F.array_sort(F.filter(spans, lambda x: x["base"] | (x["score"] >= least)))
    return found.select(*keep, F.transform(good, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "base", "score")])).alias("pii"))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """The columns ``keep`` (all, if not given) and ``pii``, the personal data of the whole text.

    Spans count code points, the end excluded.  A null text is empty.  Each row is scanned for itself,
    also where keys or texts repeat; repeated rows count each for the estimates.  A text of any length
    takes linear time and no shuffle.  A column named ``pii`` is replaced.  An empty table, and one
    without candidates, has no spans.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "pii"]
    found = cut(candidates(docs, text, keep), "private")
    return accepted(found, learn(found, settings))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
