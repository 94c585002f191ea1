"""Secrets in texts: patterns, and candidates that are reported once their structure is confirmed.

The base kinds are patterns. The method's kinds are decoded first: armored blocks and runs of base64 or
hex must decode to a private key whose nested lengths all hold (or to printable text with such a thing
inside, however often it is encoded), and dotted tokens must open with the header of a signed token.

A batch is first passed through necessary conditions (matched by Arrow); only texts that meet one are
scanned, each whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .key_formats import armored_key, from_base64, from_hex, private_key, signed_token

#: In the order in which kinds at the same place are listed.
KINDS = ("assign", "access", "hex", "armor", "key", "token")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ARMOR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{40,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])e[wy][A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]*)+")
#: What a text must match to hold a kind at all.
NEEDED = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{14}", "hex": "[0-9a-f]{16}",
    "armor": "PRIVATE KEY-----", "key": "[A-Za-z0-9+/_-]{40}", "token": r"e[wy][A-Za-z0-9_-]{6,}\.",
}

Span = tuple[str, int, int]


def _armored(text: str) -> Iterator[Span]:
    opened = None
    for m in ARMOR.finditer(text):
        if m[1] == "BEGIN":
            opened = m
        elif opened and opened[2] == m[2] and armored_key(m[2], text[opened.end() : m.start()]):
            yield "armor", opened.start(), m.end()
            opened = None
        else:
            opened = None


def _hides_key(data: bytes | None) -> bool:
    """Whether decoded bytes are a private key, or printable text that holds a confirmed secret."""
    if not data:
        return False
    if private_key(data):
        return True
    if not data.isascii():
        return False
    text = data.decode("ascii")
    return all(c.isprintable() or c in "\t\r\n" for c in text) and bool(confirmed(text))


def confirmed(text: str) -> list[Span]:
    """Spans of the method's kinds; runs inside an armored block or a token belong to it."""
    found = [*_armored(text)]
    for m in TOKEN.finditer(text):
        for token in (m[0], m[0].removesuffix(".")):  # the dot may end a sentence
            if signed_token(token.split(".")):
                found.append(("token", m.start(), m.start() + len(token)))
                break
    taken = sorted((a, b) for _, a, b in found)
    at = 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        if _hides_key(from_base64(m[0])):
            found.append(("key", m.start(), m.end()))
        else:
            found += [("key", m.start() + h.start(), m.start() + h.end()) for h in HEX_RUN.finditer(m[0]) if _hides_key(from_hex(h[0]))]
    return found


def scan(text: str, kinds: frozenset[str] = frozenset(KINDS)) -> list[Span]:
    """All spans of a whole text by start, then kind; `kinds` names those that the text can hold."""
    found: list[Span] = []
    if "assign" in kinds:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "access" in kinds:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    if "hex" in kinds:
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if not kinds.isdisjoint(("armor", "key", "token")):
        found += confirmed(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SECRETS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """The `keep` columns (all, unless given) of every row with its secrets: array of (kind, start, end).

    Places are code points, the end exclusive, listed by start, then kind. Base kinds are leftmost and do
    not overlap within a kind; kinds may overlap each other. A null or empty text has none. Repeated
    rows stay and get the same answer; an empty table stays empty; texts are scanned whole, whatever their
    length. A column of `docs` that has the name `out` is replaced: choose another name to keep it. A run
    that is glued to other base64 characters (a path before it, say) decodes to nothing and is not reported.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    # Inside tasks columns go by place, so that their names can be anything.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(names, rows.schema, strict=False)), T.StructField(out, SECRETS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            can = {k: pc.fill_null(pc.match_substring_regex(texts, need), False).to_numpy(zero_copy_only=False) for k, need in NEEDED.items()}
            found = []
            for i in range(b.num_rows):
                kinds = frozenset(k for k in KINDS if can[k][i])
                found.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(texts[i].as_py(), kinds)] if kinds else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    """'kind:start:end' of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every run of overlapping or touching spans replaced by `mark`; a null text stays null."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        fresh = (s["start"] > done["at"]) | ((done["at"] == 0) & (done["text"] == ""))
        return F.struct(F.when(fresh, F.concat(done["text"], gap, F.lit(mark))).otherwise(done["text"]).alias("text"),
                        F.greatest(done["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda done: F.concat(done["text"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))
