"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

Kinds: email, card (Luhn), iban (mod 97), ipv4 (octets up to 255), ssn (area, group and serial rules), phone (7 to 15
digits).  A span whose validator fails is dropped.  A word of the kind's context within ``CONTEXT`` characters raises
the score by ``RAISE``; a word that speaks against it (``version``, ``isbn``...) lowers it by as much.  Spans with a score
of at least ``MIN_SCORE`` count; of overlapping ones the higher score, then the longer, then the earlier stays.

Cases: null and empty texts have no spans, and redaction leaves them as they are; an empty table stays empty.  Texts are read whole, however long.
Each row stands for itself, so that repeated rows give repeated spans and a null ``doc_id`` is carried along.  Columns
besides ``text`` (and ``n_chars``, which redaction recounts) aren't touched.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _flat
from ._spark import table

MIN_SCORE = 0.5
CONTEXT = 40
RAISE = 0.25

_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_SPANS_SQL = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w])", re.ASCII)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", re.ASCII)
_IPV4 = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", re.ASCII)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
# with a country code; or an area code in brackets, a trunk digit, or neither, before groups of any length, none of which begins an address or a card
_PHONE = re.compile(
    r"(?<![\w+.])(?:(?:\(\+\d{1,4}\)[ .-]?|\+(?:\d{1,4}[ .-]?(?=\())?)(?:\(\d{1,5}\)[ .-]?)?\d{1,15}(?:[ .-]\d(?!\d))?|(?:\d{1,4}[ .-])?\(\d{1,5}\)[ .-]?\d{2,14}|(?:[01][ -])?\d{2,15}(?:/\d{3,12})?)"
    r"(?:[ .-](?!\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d)\d{2,12}){0,6}(?!\w|[.-]\d)",
    re.ASCII,
)
_GROUP = re.compile(r"[ .-]\d+$", re.ASCII)
#: Characters of an IBAN by country.
_IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

_WORDS = {
    "email": r"e-?mail|contact|correo|courriel|mailto|kontakt",
    "card": r"card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta|payment",
    "iban": r"iban|account|bank|konto|compte|cuenta|transfer",
    "ipv4": r"ip|host|server|address|adresse|addr|client|login",
    "ssn": r"ssn|social|security",
    "phone": r"phone|tel|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono|handy|contact",
}
_FOR = {k: re.compile(rf"(?<!\w)(?:{w})", re.I) for k, w in _WORDS.items()}
_AGAINST = re.compile(r"(?<!\w)(?:version|isbn|issn|doi|section|chapter|figure|release|serial|sku|order|invoice|page)", re.I)


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN's check digits are right."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban(s: str) -> str | None:
    """The beginning of a proposal that is an IBAN: of its country's length, else all of it, else, for other countries, of fewer groups."""
    ends = [i for i in range(15, len(s)) if s[i] == " "] + [len(s)]
    length = _IBAN_LENGTHS.get(s[:2])
    exact = [e for e in ends if len(s[:e].replace(" ", "")) == length]
    rest = ends[:-1][::-1] if length is None else []
    return next((s[:e] for e in [*exact, len(s), *rest] if mod97(s[:e])), None)


def _phone(s: str) -> str | None:
    """The beginning of a proposal, up to a space or its end, that has at most 15 digits; None if it has fewer than 7."""
    if _CARD.fullmatch(s):
        return None if len(_digits(s)) > 15 else s
    after = " "
    while (len(_digits(s)) > 15 or after != " ") and (last := _GROUP.search(s)):
        s, after = s[: last.start()], last.group()[0]
    return s if 7 <= len(_digits(s)) <= 15 and after == " " else None


def _pieces(expression: re.Pattern, accept, text: str):
    """(start, end) of what accept() takes of each match; the search goes on at its end."""
    at = 0
    while m := expression.search(text, at):
        s = accept(m.group())
        at = m.start() + len(s) if s else m.end()
        if s:
            yield m.start(), at


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _ssn(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _proposals(text: str):
    """(kind, start, end, score) of spans that their validators confirm, before context."""
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            start = local.start() + len(local.group()) - len(local.group().lstrip(".-%+"))
            if start < at and text[at - 1] != ".":
                yield "email", start, domain.end(), 0.9
        at = text.find("@", at + 1)
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if luhn(digits) and len(set(digits)) > 1:
            yield "card", m.start(), m.end(), 0.8
    for start, end in _pieces(_IBAN, _iban, text):
        yield "iban", start, end, 0.9
    for m in _IPV4.finditer(text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            yield "ipv4", m.start(), m.end(), 0.6
    for m in _SSN.finditer(text):
        if _ssn(m.group()):
            yield "ssn", m.start(), m.end(), 0.6
    for start, end in _pieces(_PHONE, _phone, text):
        s = text[start:end]
        # one group behind an area code says little by itself
        yield "phone", start, end, 0.7 if "+" in s or re.search(r"\).*\d[ .-]\d", s) else 0.3


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """Spans of one text in order, without overlaps."""
    found = []
    for kind, start, end, score in _proposals(text or ""):
        around = text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT]
        score += RAISE * bool(_FOR[kind].search(around)) - RAISE * bool(_AGAINST.search(around))
        score = round(min(1.0, max(0.0, score)), 4)
        if score >= MIN_SCORE:
            found.append((kind, start, end, score))
    found.sort(key=lambda x: (-x[3], x[1] - x[2], x[1]))
    # spans kept so far, apart and in order: only neighbours can overlap
    starts: list[int] = []
    kept: dict[int, tuple[str, int, int, float]] = {}
    for x in found:
        at = bisect_left(starts, x[1])
        if (at == 0 or kept[starts[at - 1]][2] <= x[1]) and (at == len(starts) or starts[at] >= x[2]):
            starts.insert(at, x[1])
            kept[x[1]] = x
    return [kept[a] for a in starts]


def _may_hold(texts: pa.Array) -> np.ndarray:
    """False for texts without any digit or @, in which no expression can match."""
    out = []
    for low, high in _flat.slices(texts):
        data, ends = _flat.utf8(texts.slice(low, high - low))
        hits = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
        out.append(hits[ends[1:]] > hits[ends[:-1]])
    return np.concatenate(out) if out else np.zeros(0, bool)


def _spans(texts: pa.Array) -> pa.Array:
    look = _may_hold(texts)
    return pa.array([[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans(t.as_py())] if here else [] for t, here in zip(texts, look, strict=True)], _SPANS)


def _redacted(texts: pa.Array) -> pa.Array:
    look = _may_hold(texts)
    if not look.any():
        return texts
    out = []
    for t, here in zip(texts, look, strict=True):
        text = t.as_py()
        if here and (found := spans(text)):
            parts, at = [], 0
            for kind, start, end, _ in found:
                parts += [text[at:start], f"[{kind.upper()}]"]
                at = end
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, score): a row for each span."""
    return docs.select("doc_id", F.inline(F.arrow_udf(_spans, _SPANS_SQL)("text")))


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with each span replaced by its kind in brackets; n_chars, if there, is recounted."""
    out = docs.withColumn("text", F.arrow_udf(_redacted, "string")("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
