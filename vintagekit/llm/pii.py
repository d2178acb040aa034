"""PII by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, digits, plus signs, schemes, identifier
cue words) in one pass over a text; from each anchor a deterministic local parser expands to the
left and right and validates what it finds. Whole texts are scanned; a text without anchors
costs one automaton pass.

Kinds. Base: ``email``, ``ip``, ``card``, ``phone``. Added by cue: ``url`` (scheme, host, rest),
``iban`` (cue + mod-97 check), ``account`` (cue such as "account", "acct", "ssn", "passport", then
an identifier of 6 to 34 letters and digits with at least 4 digits). Offsets are code points,
end exclusive.

Cases: a null or empty text has no spans; very long texts are scanned whole (memory follows the
longest text of an Arrow batch); repeated rows give equal rows; an empty table gives an empty
table with the same columns; other columns, whatever their names, are neither read nor returned
by :func:`find_pii` and pass unchanged through :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("url", "iban", "account")
#: Kinds that name a person or an account; a plain web address does not.
PRIVATE_KINDS = ("email", "ip", "card", "phone", "iban", "account")

_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE_RUN = re.compile(r"[ ().0-9-]+")
_CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_AUTHORITY = re.compile(r"(?:[A-Za-z0-9._~%!$&'*+,;=:-]+@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?")
_URL_REST = re.compile(r"[/?#][A-Za-z0-9._~%!$&'()*+,;=:@/?#-]*")
_IBAN = re.compile(r"[\s:#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: (?:number|no|nr|id))?\.?[ ]?[:#=]?[ ]?([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)(?![A-Za-z0-9-])")
#: What may follow an account cue: a value that touches it belongs to a longer word. A value holds none of these, so no
#: character is read for more than one cue.
_AFTER_CUE = frozenset(" .:#=")

#: Anchors. Fixed values.
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("account", "acct", "ssn", "passport", "customer id", "konto", "cuenta", "compte")
IBAN_CUES = ("iban",)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for d in sorted(_DIGITS):
        a.add_word(d, ("digit", 1))
    for kind, words in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("iban", IBAN_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of one text, sorted by start, then kind order."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    email_end = dotted_end = card_end = url_end = 0
    n = len(text)
    for last, (kind, size) in _automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= dotted_end:
                m = _DOTTED.match(text, at)
                dotted_end = m.end()
                if "." in m.group():
                    _addresses(text, at, m.group(), out)
            if at >= card_end:
                m = _CARD_RUN.match(text, at)
                card_end = m.end()
                if card_end - at >= 12:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, card_end, "card"))
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.append((start, email_end, "email"))
        elif kind == "plus":
            if at + 1 < n and text[at + 1] in _DIGITS and (m := _PHONE_RUN.match(text, at + 2)):
                end = m.end()
                while text[end - 1] not in _DIGITS:
                    end -= 1
                if end - 1 >= at + 3 and 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    out.append((at, end, "phone"))
        elif kind == "scheme":
            if at >= url_end and (m := _AUTHORITY.match(text, last + 1)):
                rest = _URL_REST.match(text, m.end())
                url_end = rest.end() if rest else m.end()
                while text[url_end - 1] in ".,;:!?)'":
                    url_end -= 1
                out.append((at, url_end, "url"))
        elif at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            continue
        elif kind == "iban":
            if m := _IBAN.match(text, last + 1):
                value = m.group(1).replace(" ", "")
                if 15 <= len(value) <= 34 and _mod97(value):
                    out.append((m.start(1), m.end(1), "iban"))
        elif text[last + 1:last + 2] in _AFTER_CUE and (m := _ACCOUNT.match(text, last + 1)):
            value = m.group(1).replace("-", "")
            if 6 <= len(value) <= 34 and sum(c in _DIGITS for c in value) >= 4:
                out.append((m.start(1), m.end(1), "account"))
    out = sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return out


def _addresses(text: str, at: int, chain: str, out: list) -> None:
    """Groups of four in a maximal chain of dotted numbers, from the left; a group with a part
    over 255 is dropped and the next starts after it."""
    parts = chain.split(".")
    pos = at
    for i in range(0, len(parts) - 3, 4):
        four = parts[i:i + 4]
        end = pos + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in four):
            out.append((pos, end, "ip"))
        pos = end + 1


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


_RESULT = pa.struct([("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()),
                     ("base_sha256", pa.string()), ("spans", pa.string())])


@arrow_udf(T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
                        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]))
def pii_digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = []
        for text in texts:
            spans = scan(text.as_py())
            base = [s for s in spans if s[2] in BASE_KINDS]
            row = {f"n_{k}": sum(s[2] == k for s in base) for k in BASE_KINDS}
            rows.append(row | {"base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans)})
        yield pa.array(rows, _RESULT)


@arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                     T.StructField("kind", T.StringType())])))
def pii_spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    for texts in batches:
        yield pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in scan(t.as_py())] for t in texts], kind)


@arrow_udf(T.StringType())
def _masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([mask(t.as_py()) for t in texts], pa.string())


def mask(text: str | None) -> str | None:
    """The text with every private span replaced by its kind in brackets; overlapping spans
    are replaced as one, under the kind that starts first. Null stays null."""
    spans = [s for s in scan(text) if s[2] in PRIVATE_KINDS]
    if not spans:
        return text
    merged: list[list] = []
    for s, e, k in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    out, at = [], 0
    for s, e, k in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, text: str = "text") -> Column:
    """Column of all spans of the whole text: array of (start, end, kind)."""
    return pii_spans(docs[text])


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans."""
    return docs.select("doc_id", pii_digest("text").alias("r")).select("doc_id", "r.*")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with private spans masked; all columns stay, ``n_chars`` follows the text."""
    out = docs.withColumn("text", _masked("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
