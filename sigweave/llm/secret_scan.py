"""Secret scan that unwraps encodings.

A document is a worklist of layers.  A layer is scanned, then every encoding found in it gives a
further layer: percent and unicode escapes are undone in place, base64 runs and what is compressed
inside them are cut out.  A layer knows for each of its characters where that stood in the
document, so spans always name places of the original text.  The list ends when no layer changes
anything; a layer that was seen before at the same place is not taken again.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.llm.tables import added, text_of

# What counts as a secret.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Scanning only for runs that are long enough finds the same spans for this kind, as its runs are maximal.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/]{16,}|[A-Za-z0-9_-]{16,}")
#: Base64 over several lines; tried only where a run begins, and never read back.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]++)++")
GZIP, ZLIB = b"\x1f\x8b", (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("base", T.BooleanType()), T.StructField("via", T.StringType()),
]))


@dataclass(frozen=True)
class Limits:
    """Guards against compression bombs: the characters all layers of one document may add up to, the
    larger of ``times`` its own length and ``floor``.  What would exceed them is not unwrapped, and the
    document is marked as cut."""

    times: int = 64
    floor: int = 1 << 24


#: Everything that cannot be inside a run of base64 or hexadecimal digits, as a space.
_RUN_BYTES = bytes(c if chr(c).isalnum() and c < 128 or chr(c) in "+/_-" else 32 for c in range(256))
#: One of these is in every match of ASSIGN.
_NAMES = ("passw", "secret", "token", "apikey", "api_key")


def long_runs(text: str, least: int = 16) -> list[tuple[int, str]]:
    """``(start, run)`` of the runs of base64 characters that are at least so long."""
    out, at = [], 0
    for word in text.encode("utf-8", "surrogatepass").translate(_RUN_BYTES).split():
        if len(word) >= least:
            run = word.decode()
            at = text.index(run, at)
            out.append((at, run))
            at += len(run)
    return out


def find(text: str, runs: list[tuple[int, str]] | None = None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the secrets that stand in the text as it is, leftmost first per kind."""
    out, low = [], text.lower()
    if any(name in low for name in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    for at, run in long_runs(text) if runs is None else runs:
        out += [("hex", at + m.start(), at + m.end()) for m in LONG_HEX.finditer(run)] if len(run) >= LEAST["hex"] else []
    return out


@dataclass
class Layer:
    text: str
    start: np.ndarray | None  # where each character began and ended in the document; None: at its own index
    end: np.ndarray | None
    via: str

    def place(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))


def _in_place(layer: Layer, pattern: re.Pattern, decode, via: str) -> Layer | None:
    """The layer with every match replaced by what ``decode`` yields: (character, first, last) of the match."""
    pieces, first, last, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        new = decode(m)
        if new is None:
            continue
        pieces.append(layer.text[at:m.start()])
        first.append(np.arange(at, m.start(), dtype=np.int64))
        last.append(np.arange(at, m.start(), dtype=np.int64))
        pieces.append("".join(x[0] for x in new))
        first.append(np.array([m.start() + x[1] for x in new], np.int64))
        last.append(np.array([m.start() + x[2] - 1 for x in new], np.int64))
        at = m.end()
    if not at:
        return None
    pieces.append(layer.text[at:])
    first.append(np.arange(at, len(layer.text), dtype=np.int64))
    last.append(np.arange(at, len(layer.text), dtype=np.int64))
    a, b = np.concatenate(first), np.concatenate(last)
    start, end = (a, b + 1) if layer.start is None else (layer.start[a], layer.end[b])
    return Layer("".join(pieces), start, end, f"{layer.via}>{via}")


def _percent(m: re.Match):
    raw = bytes.fromhex(m[0].replace("%", ""))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(text)]
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out.append((c, 3 * at, 3 * (at + n)))
        at += n
    return out


def _escape(m: re.Match):
    code = int(next(x for x in m.groups()[:5] if x), 16) if not m[6] else int(m[6])
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), 0, m.end() - m.start())]


class TooLarge(Exception):
    """What is compressed would exceed the limits."""


def _expand(raw: bytes, room: int) -> bytes | None:
    """What is compressed, if anything is."""
    if raw[:2] == GZIP:
        box = zlib.decompressobj(31)
    elif raw[:2] in ZLIB:
        box = zlib.decompressobj()
    else:
        return None
    try:
        out = box.decompress(raw, max(room, 0) + 1)
    except zlib.error:
        return None
    if len(out) > room:
        raise TooLarge
    return out


def _text(raw: bytes) -> tuple[str, np.ndarray]:
    """The text and the bytes that each character takes; bytes that are no UTF-8 are a character each."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1"), np.ones(len(raw), np.int64)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return text, 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


def _base64_runs(text: str, runs: list[tuple[int, str]]):
    """``(places, run)`` in one of the two base64 alphabets: in one line, or over lines of one width.

    A line that is longer than the one before begins a new run, unless that one is the first (which
    may begin inside a line), and a line that is shorter ends it.
    """
    for at, run in runs:
        if not (("+" in run or "/" in run) and ("-" in run or "_" in run)):
            yield np.arange(at, at + len(run)), run
        else:
            yield from ((np.arange(at + m.start(), at + m.end()), m[0]) for m in BASE64.finditer(run))
    for block in WRAPPED.finditer(text) if "\n" in text else ():
        group: list[tuple[int, str]] = []
        for line in re.finditer(r"[^\r\n]+", block[0]):
            if group and (len(line[0]) > len(group[-1][1]) and len(group) > 1 or len(group) > 2 and len(group[-1][1]) < len(group[-2][1])):
                yield from _joined_lines(group)
                group = []
            group.append((block.start() + line.start(), line[0]))
        yield from _joined_lines(group)


def _joined_lines(group: list[tuple[int, str]]):
    if len(group) > 1:
        yield np.concatenate([np.arange(at, at + len(line)) for at, line in group]), "".join(line for _, line in group)


def _decoded(layer: Layer, runs: list[tuple[int, str]], room: int) -> tuple[list[Layer], bool]:
    """A layer for what each base64 run holds, at once or compressed; and whether some would exceed ``room``."""
    out, cut = [], False
    for places, run in _base64_runs(layer.text, runs):
        if len(run) % 4 == 1:
            places, run = places[:-1], run[:-1]
        stop = int(places[-1]) + 1
        while stop < len(layer.text) and stop - int(places[-1]) < 3 and layer.text[stop] == "=":
            stop += 1
        try:
            raw = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))
        except binascii.Error:
            continue
        via, past = "base64", set()
        try:
            while raw not in past and (unpacked := _expand(raw, room)) is not None:
                past.add(raw)
                raw, via = unpacked, via + ">inflate"
        except TooLarge:
            cut = True
            continue
        if not raw:
            continue
        text, size = _text(raw)
        if past:
            start, end = layer.place(int(places[0]), stop)
            where = np.full(len(text), start, np.int64), np.full(len(text), end, np.int64)
        else:
            # Four characters hold three bytes: a character goes back to the groups its bytes are in.
            places = np.concatenate([places, np.arange(int(places[-1]) + 1, stop)])
            last = np.cumsum(size)
            a = places[(last - size) // 3 * 4]
            b = places[np.minimum((last - 1) // 3 * 4 + 3, len(places) - 1)]
            where = (a, b + 1) if layer.start is None else (layer.start[a], layer.end[b])
        out.append(Layer(text, *where, f"{layer.via}>{via}"))
    return out, cut


def unwrap(text: str, limits: Limits = Limits()) -> tuple[list[tuple[str, int, int, bool, str]], bool]:
    """All spans ``(kind, start, end, base, via)``, each place once, by start, then kind, then end.

    The second result tells whether the limits left layers unscanned.
    """
    found: dict[tuple[str, int, int], tuple[bool, str]] = {}
    room, cut = max(limits.floor, limits.times * len(text)), False
    work, seen = [Layer(text, None, None, "text")], set()
    while work:
        layer = work.pop()
        mark = (layer.text, *layer.place(0, len(layer.text))) if layer.text else None
        if mark is None or mark in seen:
            continue
        if layer.start is not None:
            if len(layer.text) > room:
                cut = True
                continue
            room -= len(layer.text)
        seen.add(mark)
        runs = long_runs(layer.text)
        for kind, a, b in find(layer.text, runs):
            found.setdefault((kind, *layer.place(a, b)), (layer.start is None, layer.via))
        new = [_in_place(layer, PERCENT, _percent, "url") if "%" in layer.text else None]
        new.append(_in_place(layer, ESCAPE, _escape, "unicode") if "\\" in layer.text or "&#" in layer.text else None)
        work += [x for x in new if x is not None]
        layers, large = _decoded(layer, runs, room)
        work += layers
        cut |= large
    order = sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [(*s, *found[s]) for s in order], cut


FOUND = T.StructType([T.StructField("spans", SPANS), T.StructField("cut", T.BooleanType())])


@F.pandas_udf(FOUND)
def _spans(texts: pd.Series) -> pd.DataFrame:
    fields = ("kind", "start", "end", "base", "via")
    read = [unwrap(t or "") for t in texts]
    spans = pd.Series([[dict(zip(fields, s, strict=True)) for s in r[0]] for r in read], dtype=object)
    return pd.DataFrame({"spans": spans, "cut": pd.Series([r[1] for r in read], dtype=bool)})


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """All rows and columns with ``out``: the spans of their secrets, in code points, end exclusive.

    ``base`` marks those that stand in the text itself; ``via`` tells how the others were wrapped.
    ``<out>_cut`` is true where the limits on unwrapping left something unscanned.  Null and empty
    texts have no span.  Columns of the input named like a result are replaced.
    """
    cut = f"{out}_cut"
    rows = docs.select(*added(docs, out, cut), _spans(text_of(text)).alias("__found"))
    return rows.select(*added(docs, out, cut), F.col("__found.spans").alias(out), F.col("__found.cut").alias(cut))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, in the order of the spans."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
