"""PII: Aho-Corasick finds at-signs, schemes and identifier cues; local parsers expand and validate boundaries.

`find_pii(df)` adds `pii`, an array of (kind, start, end) in code points, end exclusive, by kind as listed in KINDS and
then by start. Base kinds: email, ip, card (Luhn), phone. Added kinds: `iban` (the countries of IBAN_LENGTH, their
length and remainder 97), `ssn` (groups of 3, 2 and 4 digits with hyphens whose areas are assigned, not within longer
ones) and `login` (user and password before the at-sign of a URL with a scheme).

Defined results: a null text counts as empty and has no spans; whole texts are scanned, of any length; repeated rows get
equal results; other columns pass through, but a column named `pii` is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_batches, schema_of, text_or_empty
from .spans import SPAN, count, joined, of_kinds

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "login")

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOGIN = re.compile(r"[^\s:/@]+:[^\s/@]+@")
# Lengths of account numbers by country, as the public registry has them.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _automaton() -> ahocorasick.Automaton:
    """Each cue with the kinds that it may begin and its width."""
    found = ahocorasick.Automaton()
    cues: dict[str, tuple[str, ...]] = {"@": ("email",), "://": ("login",)}
    for a in _DIGITS:
        cues[f"+{a}"] = ("phone",)
        for b in _DIGITS:
            cues |= {f"{a}{b}": ("card",), f"{a} {b}": ("card",), f"{a}-{b}": ("card", "ssn"), f"{a}.{b}": ("ip",)}
    for country in IBAN_LENGTH:
        cues |= {f"{country}{a}{b}": ("iban",) for a in _DIGITS for b in _DIGITS}
    for cue, kinds in cues.items():
        found.add_word(cue, (kinds, len(cue)))
    found.make_automaton()
    return found


_CUES = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_end(text: str, start: int) -> int:
    """Where a valid account number that begins at start ends, or 0."""
    if not (m := _IBAN.match(text, start)) or (start and text[start - 1].isalnum()):
        return 0
    at, letters = start, ""
    while at < m.end() and len(letters) < IBAN_LENGTH[m[0][:2]]:
        letters += text[at].strip()
        at += 1
    if len(letters) < IBAN_LENGTH[m[0][:2]] or (at < len(text) and text[at].isalnum()):
        return 0
    return at if int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4])) % 97 == 1 else 0


def _email(text: str, cue: int, after: int) -> tuple[int, int, bool] | None:
    left = cue
    while left > after and text[left - 1] in _LOCAL:
        left -= 1
    return (left, m.end(), True) if left < cue and (m := _DOMAIN.match(text, cue + 1)) else None


def _ip(text: str, cue: int, after: int) -> tuple[int, int, bool] | None:
    left = cue
    while left > after and text[left - 1] in _DIGITS:
        left -= 1
    if not (m := _IP.match(text, left)):
        return None
    return left, m.end(), all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))


def _card(text: str, cue: int, after: int) -> tuple[int, int, bool] | None:
    m = _CARD.match(text, cue)
    digits = m[0].replace(" ", "").replace("-", "")
    return cue, m.end(), 13 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, cue: int, after: int) -> tuple[int, int, bool] | None:
    return (cue, m.end(), 9 <= sum(c in _DIGITS for c in m[0]) <= 15) if (m := _PHONE.match(text, cue)) else None


def _iban(text: str, cue: int, after: int) -> tuple[int, int, bool] | None:
    return (cue, end, True) if (end := iban_end(text, cue)) else None


def _ssn(text: str, cue: int, after: int) -> tuple[int, int, bool] | None:
    """The cue is a number's first hyphen with the digits on both sides."""
    left = cue - 2
    if left < after or (left and (text[left - 1] in _DIGITS or text[left - 1] == "-")) or not (m := _SSN.match(text, left)):
        return None
    return left, m.end(), True


def _login(text: str, cue: int, after: int) -> tuple[int, int, bool] | None:
    return (cue + 3, m.end() - 1, True) if (m := _LOGIN.match(text, cue + 3)) else None


#: From a cue and where the kind's last match ended: the match's bounds and whether it is valid.
_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "iban": _iban, "ssn": _ssn, "login": _login}


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text."""
    found: list[tuple[str, int, int]] = []
    after = dict.fromkeys(KINDS, 0)
    for last, (kinds, width) in _CUES.iter(text):
        cue = last - width + 1
        for kind in kinds:
            if cue >= after[kind] and (match := _PARSERS[kind](text, cue, after[kind])):
                after[kind] = match[1]
                if match[2]:
                    found.append((kind, *match[:2]))
    found.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return found


def find_pii(df: DataFrame, keep_text: bool = True) -> DataFrame:
    """df with the column `pii`; a column of that name is replaced."""
    kept = df.drop("pii").withColumn("text", text_or_empty())
    names = [c for c in kept.columns if keep_text or c != "text"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans_of(t.as_py())] for t in batch.column("text")]
        yield {c: batch.column(c) for c in names} | {"pii": pa.array(rows, kind)}

    return map_batches(kept, step, ", ".join(x for x in (schema_of(kept if keep_text else kept.drop("text")), f"pii {SPAN}") if x))


def digest(df: DataFrame) -> DataFrame:
    """The contract's row per document; base spans and all spans are those of find_pii()."""
    spans = F.col("pii")
    return find_pii(df.select("doc_id", "text"), keep_text=False).select(
        "doc_id",
        *(count(spans, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(of_kinds(spans, BASE_KINDS)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
