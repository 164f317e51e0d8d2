"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near hits, checksum validation.

`find_secrets(df)` adds `secrets`, an array of (kind, start, end) in code points, end exclusive, ordered by start and
then by kind as listed in KINDS. `redacted(df)` puts a mark in place of each span.

Kinds `assign`, `access` and `hex` are patterns; `checked` is a token of a public format (prefix, 30 base-62 letters,
six more that are the CRC-32 of those 30 in base 62), kept only if its checksum is right.

Defined results: a null text counts as empty and has no spans; whole texts are scanned, of any length; repeated rows get
equal results; other columns pass through, but a column named `secrets` is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import give_back, map_batches, masked, schema_of, text_or_empty
from .spans import SPAN, count, joined, of_kinds

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "checked")
MARK = "[SECRET]"
# Keywords and public token prefixes.
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
TOKEN_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CHECKED = re.compile(r"[a-z]{3}_[0-9A-Za-z]{36}(?![0-9A-Za-z])")


def base62(value: int, width: int) -> str:
    digits = ""
    for _ in range(width):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, keys in (("assign", ASSIGN_KEYS), ("access", ("akia",)), ("checked", TOKEN_PREFIXES)):
        for key in keys:
            found.add_word(key, (kind, len(key)))
    found.make_automaton()
    return found


_KEYS = _automaton()


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text."""
    found: list[tuple[str, int, int]] = []
    after = dict.fromkeys(KINDS, 0)
    # U+0130 alone grows when lowered; with it replaced, positions in both strings agree.
    for at, (kind, width) in _KEYS.iter(text.replace("\u0130", "i").lower()):
        start = at - width + 1
        if start < after[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(text, start):
                after[kind] = m.end()
                if len(m[2]) >= 12:
                    found.append((kind, start, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                after[kind] = m.end()
                if m.end() - start >= 18:
                    found.append((kind, start, m.end()))
        elif (m := _CHECKED.match(text, start)) and m[0].startswith(TOKEN_PREFIXES) and base62(zlib.crc32(m[0][4:34].encode()), 6) == m[0][34:]:
            after[kind] = m.end()
            found.append((kind, start, m.end()))
    # A run of hexadecimal letters has no keyword; its own pattern is the anchor.
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def find_secrets(df: DataFrame, keep_text: bool = True) -> DataFrame:
    """df with the column `secrets`; a column of that name is replaced."""
    kept = df.drop("secrets").withColumn("text", text_or_empty())
    names = [c for c in kept.columns if keep_text or c != "text"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans_of(t.as_py())] for t in batch.column("text")]
        yield {c: batch.column(c) for c in names} | {"secrets": pa.array(rows, kind)}

    return map_batches(kept, step, ", ".join(x for x in (schema_of(kept if keep_text else kept.drop("text")), f"secrets {SPAN}") if x))


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """Overlapping spans are merged; each gets one mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame) -> DataFrame:
    """df with every span of a secret replaced by MARK and, if there and whole numbers, n_chars counted anew; a null text stays null.

    Texts without secrets are left as they are. All other columns keep their values, names, order and types.
    """
    plain = masked(df, "text", "n_chars")
    names = plain.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(at).to_pylist()
            after = [redact(t, [s[1:] for s in found]) if t and (found := spans_of(t)) else t for t in before]
            columns = list(batch.columns)
            columns[at] = pa.array(after, pa.string())
            if "n_chars" in names and pa.types.is_integer((size := columns[names.index("n_chars")]).type):
                sizes = [n if a is b else len(a) for n, a, b in zip(size.to_pylist(), after, before, strict=True)]
                columns[names.index("n_chars")] = pa.array(sizes, size.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return plain.mapInArrow(run, schema_of(plain)).toDF(*df.columns)


def digest(df: DataFrame) -> DataFrame:
    """The contract's row per document; base spans and all spans are those of find_secrets()."""
    spans = F.col("secrets")
    return find_secrets(df.select("doc_id", "text"), keep_text=False).select(
        "doc_id",
        *(count(spans, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(of_kinds(spans, BASE_KINDS)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
