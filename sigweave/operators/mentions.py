"""Technology mentions in text.

An alias counts where neither neighbour is ``[a-z0-9]`` in the lower-cased text.  A text yields
one mention per technology: the longest alias found, the first listed on a tie.

``scan`` (the default) walks each text once with a single regular expression that all aliases
share, and picks the best alias per technology inside the row: no shuffle, no Python.  ``join`` is
for a large taxonomy: the same walk finds the aliases, whose number hardly matters to it, and a
join with the table of aliases says which technologies they name.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sigweave.functions.text import WORD_CHAR, posting_text
from sigweave.sources.taxonomy import (
    Alias, load_aliases, resolved,
)

BEFORE, AFTER = f"(?<!{WORD_CHAR})", f"(?!{WORD_CHAR})"

# Sorting these structs puts the longest alias of a technology first, the first listed on a tie.
_CANDIDATE = "struct<canonical:string,neg_len:int,alias_ord:int,raw_mention:string,category:string>"


def _shared_prefix_pattern(words: Sequence[str]) -> str:
    """One pattern for all words; common beginnings are written once, longer words are tried first."""
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [
            (ch if ch.isalnum() or ch == " " else "\\" + ch) + render(child)
            for ch, child in node.items()
            if ch
        ]
        if not branches:
            return ""
        joined = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
        return f"(?:{joined})?" if "" in node else joined

    return render(tree)


def _same_start(longer: str, shorter: str) -> bool:
    """A match of ``longer`` is also a match of ``shorter`` at the same position."""
    rest = longer[len(shorter):]
    return longer.startswith(shorter) and (not rest or not (rest[0].isascii() and rest[0].isalnum()))


def _candidate(a: Alias) -> dict:
    return {
        "canonical": a.canonical, "neg_len": -len(a.alias), "alias_ord": a.alias_ord,
        "raw_mention": a.alias, "category": a.category,
    }


def _pattern(words: Sequence[str]) -> str:
    """Finds the longest word at every place where one stands free."""
    return f"{BEFORE}(?=({_shared_prefix_pattern(words)}){AFTER})"


def _implied(known: Sequence[Alias]) -> dict[str, list[dict]]:
    """What a hit stands for: its own alias, and those that its beginning is."""
    by_prefix = {a.alias: a for a in known}
    return {
        a.alias: [
            _candidate(by_prefix[a.alias[:n]])
            for n in range(1, len(a.alias) + 1)
            if a.alias[:n] in by_prefix and _same_start(a.alias, a.alias[:n])
        ]
        for a in known
    }


def _hits(text: Column, known: Sequence[Alias]) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_pattern([a.alias for a in known])), F.lit(1))


def _scan(text: Column, aliases: Sequence[Alias]) -> Column:
    """All (technology, alias) candidates of a text as an array of structs."""
    known = resolved(aliases)
    # A JSON literal folds to one constant map, which keeps the expression tree small.
    lookup = F.from_json(F.lit(json.dumps(_implied(known))), f"map<string,array<{_CANDIDATE}>>")
    hits = F.array_distinct(_hits(text, known))
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: lookup[h])))


# One entry per technology from the sorted array ``_candidates``.
_BEST = """
transform(
  filter(_candidates, (c, i) -> i = 0 or get(_candidates, i - 1).canonical != c.canonical),
  c -> named_struct(
    'canonical', c.canonical, 'category', c.category, 'raw_mention', c.raw_mention,
    'alias_ord', array_min(transform(
      filter(_candidates, o -> o.canonical = c.canonical), o -> o.alias_ord))))
"""


def with_mentions(
    postings: DataFrame,
    aliases: Sequence[Alias],
    keep: Sequence[str],
    text: Column | None = None,
) -> DataFrame:
    """``keep`` plus ``mentions``, an array of (canonical, category, raw_mention, alias_ord).

    ``alias_ord`` is the position of the first listed alias found, which orders the technologies
    of one text; ``raw_mention`` is the longest alias found.
    """
    text = posting_text(F.col("title"), F.col("description")) if text is None else text
    found = postings.select(*keep, F.array_sort(_scan(text, aliases)).alias("_candidates"))
    return found.select(*keep, F.expr(_BEST).alias("mentions"))


#: Aliases in one pattern.  A larger taxonomy takes a pass over the text for each such part.
PATTERN_ALIASES = 50_000


def _joined(postings: DataFrame, aliases: Sequence[Alias], keep: Sequence[str]) -> DataFrame:
    """Mentions of a large taxonomy: patterns find the aliases, a join says whose they are.

    Only ``keep`` and the aliases found leave a task, never a text or all its words.
    """
    known = resolved(aliases)
    parts = [known[i : i + PATTERN_ALIASES] for i in range(0, len(known), PATTERN_ALIASES)]
    text = posting_text(F.col("title"), F.col("description"))
    found = F.array_distinct(F.flatten(F.array(*[_hits(text, part) for part in parts])))
    # The outer form, as a plain one would be searched twice; a hit that is null meets no alias.
    hits = postings.select(*keep, F.explode_outer(found).alias("_hit"))
    rows = [
        (hit, c["canonical"], c["category"], c["raw_mention"], c["neg_len"], c["alias_ord"])
        for part in parts for hit, candidates in _implied(part).items() for c in candidates
    ]
    table = postings.sparkSession.createDataFrame(
        rows, "_hit string, canonical string, category string, raw_mention string, neg_len int, alias_ord int"
    )
    best = F.min_by(F.struct("category", "raw_mention"), F.struct("neg_len", "alias_ord"))
    return hits.join(table, "_hit").groupBy(*keep, "canonical").agg(
        best.alias("best"), F.min("alias_ord").alias("alias_ord")
    ).select(*keep, "canonical", "best.category", "best.raw_mention", "alias_ord")


def mentions(
    postings: DataFrame,
    taxonomy: DataFrame | Sequence[Alias],
    strategy: str = "scan",
    keep: Sequence[str] = ("domain", "source", "scraped_at", "posting_id", "pos"),
) -> DataFrame:
    """One row per posting and technology: ``keep``, canonical, category, raw_mention, alias_ord.

    The caller picks the strategy; the results are the same.  ``scan`` needs no shuffle and is for
    hundreds to a few thousand aliases; ``join`` is for tens of thousands.  ``keep`` must identify a
    posting for ``join``, nulls being equal.
    """
    if strategy not in ("scan", "join"):
        raise ValueError(f"unknown strategy {strategy!r}")
    rows = load_aliases(taxonomy) if isinstance(taxonomy, DataFrame) else taxonomy
    if not rows:
        none = [F.lit(None).cast("string").alias(c) for c in ("canonical", "category", "raw_mention")]
        return postings.select(*keep, *none, F.lit(None).cast("int").alias("alias_ord")).limit(0)
    if strategy == "join":
        return _joined(postings, rows, keep)
    found = with_mentions(postings, rows, keep)
    # The outer form, with the empty row dropped after it: for a plain inline the optimizer would
    # infer a size() > 0 filter below it, and so search every text twice.
    return found.select(*keep, F.inline_outer("mentions")).filter(F.col("canonical").isNotNull())
