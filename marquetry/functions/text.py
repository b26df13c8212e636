"""White space, punctuation, normalisation, noise and cleaning of text columns."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..resources import NO_WHITESPACE, PUNCTUATION

#: The 29 code points that Python takes for white space, for regular expressions of Java and of RE2.
WS_CLASS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_CLASS}]"
NOT_WS = f"[^{WS_CLASS}]"


def let(value: Column, f) -> Column:
    """f of a value that is evaluated once; inside other lambdas an expression would be evaluated for every element."""
    return F.transform(F.array(value), f)[0]


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+\\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_WS)


def separator(lang: Column) -> Column:
    """What stands between the sentences of a language; a blank where it isn't known."""
    return F.when(lang.isin(*NO_WHITESPACE), F.lit("")).otherwise(F.lit(" "))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", " ")


def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark has no function for."""
    return F.arrow_udf(_nfkc, "string")(text)


_BLANKS = re.compile(r"\s+")


def _preprocess(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        if t is not None:
            t = t.replace("\u200f", "").lstrip("-").strip()
            t = _BLANKS.sub(" ", t if t.isascii() else unicodedata.normalize("NFKC", t))
        out.append(t)
    return pa.array(out, pa.string())


def preprocess(text: Column) -> Column:
    """A sentence as evaluation reads it: no U+200F, no leading dashes, stripped, NFKC, single blanks (in this order)."""
    return F.arrow_udf(_preprocess, "string")(text)


def drop_punctuation(text: Column) -> Column:
    return F.translate(text, "".join(PUNCTUATION), "")


def corrupt(text: Column, lower: bool = True, punctuation: bool = True) -> Column:
    """Lower case and without punctuation marks, as asked."""
    text = F.lower(text) if lower else text
    return drop_punctuation(text) if punctuation else text


#: Marks that stay where they join two letters or digits, and what stands for them meanwhile.
_JOINERS = ".,-'’"
_HELD = "".join(chr(0xE001 + i) for i in range(len(_JOINERS)))
_CHAR = r"[\p{L}\p{M}\p{N}]"


def drop_mark_tokens(text: Column) -> Column:
    """Without the marks that a tokenizer takes for tokens: what stands within a word (don't, well-known, e.g) or a number stays, others leave a blank."""
    for mark, held in zip(_JOINERS, _HELD, strict=True):
        char = r"\p{N}" if mark == "," else _CHAR
        text = F.regexp_replace(text, f"(?<={char}){re.escape(mark)}(?={char})", held)
    bare = strip(squeeze(F.translate(text, "".join(PUNCTUATION), " " * len(PUNCTUATION))))
    return F.translate(bare, _HELD, _JOINERS)


def corrupt_asr(text: Column, lang: Column | None = None) -> Column:
    """Like recognised speech: each line in lower case, without marks that are tokens; in languages without blanks, without any marks."""
    whole = F.transform(F.split(text, "\n"), lambda line: F.lower(drop_mark_tokens(line)))
    if lang is None:
        return whole
    return F.when(lang.isin(*NO_WHITESPACE), F.transform(F.split(text, "\n"), lambda line: F.lower(drop_punctuation(line)))).otherwise(whole)


def corrupt_social_media(text: Column, key: Column, seed: int = 0) -> Column:
    """Like social media: half without marks, else each mark repeated geometrically (perhaps not at all); half in lower case.

    Draws are digits of md5 hashes of seed, key and place, so that they don't depend on partitions.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    draws = F.md5(name)
    times = lambda i: F.length(F.regexp_extract(F.md5(F.concat(name, F.lit(":"), i.cast("string"))), "^[0-7]*", 0))
    repeated = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.isin(*PUNCTUATION), F.repeat(c, times(i))).otherwise(c)), "")
    noisy = F.when(F.substring(draws, 1, 1) < "8", drop_punctuation(text)).otherwise(repeated)
    return preprocess(F.when(F.substring(draws, 2, 1) < "8", F.lower(noisy)).otherwise(noisy))


def ends_with_punctuation(text: Column) -> Column:
    """Whether the stripped text ends in a mark or symbol."""
    return strip(text).rlike(r"[\p{P}\p{S}]\z")


def whitespace_ratio(text: Column) -> Column:
    """White space of the text with a line break at its end, over its length."""
    whole = F.concat(text, F.lit("\n"))
    return (F.length(whole) - F.length(F.regexp_replace(whole, WS, ""))) / F.length(whole)


def paragraphs(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(text, "\n"), lambda x: ~is_blank(x))


EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}\x{20E3}]"
EMOTICON = r"[:;=8xX]['o*-]?[)\](\[dDpP/|\\@3<>]"


def clean_tweet(text: Column) -> Column:
    """Words that begin with http, # or @ go, and so do emoji and emoticons; the rest is joined by blanks."""
    words = F.filter(F.split(text, " "), lambda w: ~w.rlike("^(?:http|#|@)") & ~w.rlike(f"^{EMOTICON}\\z"))
    return strip(squeeze(F.regexp_replace(F.array_join(words, " "), EMOJI, "")))


def clean_tweets(texts: Column, most: int = 5) -> Column:
    """The cleaned texts of a list that aren't empty; null if there is none, or more than most."""
    left = F.filter(F.transform(texts, lambda t: clean_tweet(t)), lambda t: t != "")
    return let(left, lambda x: F.when((F.size(x) > 0) & (F.size(x) <= most), x))


def ends_in_two_letters(text: Column) -> Column:
    """A sign that a cut may have gone through a word."""
    return text.rlike(r"\p{L}{2}\z")


def language_name(lang: Column) -> Column:
    from ..resources import LANGUAGE_NAMES

    pairs = [F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), lang)


def clean_answer(text: Column, gap: str = "@", delimiter: str = "\n") -> Column:
    """A model's answer before alignment: gap characters become blanks, line breaks one delimiter, other white space single blanks."""
    text = F.translate(strip(text), gap, " ")
    lines = F.transform(F.split(text, "\n"), lambda x: strip(squeeze(x)))
    return F.array_join(F.filter(lines, lambda x: x != ""), delimiter)


def is_refusal(alignment: Column, gap: str = "@") -> Column:
    """Whether nothing of the answer was aligned."""
    return alignment.rlike(f"^(?:{re.escape(gap)})+\\z")


def _bounds(i: Column, n: Column, k: Column) -> tuple[Column, Column]:
    start = F.floor(i * n / k).cast("int")
    return start + 1, F.floor((i + 1) * n / k).cast("int") - start


def equal_split_chars(text: Column, k: Column) -> Column:
    """k parts of as equal a number of characters as can be: part i begins at floor(i n / k)."""
    return let(F.length(text), lambda n: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substring(text, *_bounds(i, n, k))))


def equal_split_words(text: Column, k: Column) -> Column:
    """The same by words."""
    return let(F.split(text, " "), lambda w: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.array_join(F.slice(w, *_bounds(i, F.size(w), k)), " ")))


def code_points(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


PRIMES = tuple(map(int, "31 43 59 61 73 97 103 113 137 149 157 173 181 193 211 223".split()))


def hash_codes(text: Column, hashes: int = 8, buckets: int = 8192) -> Column:
    """For each character (code point + 1) times a prime, modulo buckets, for as many primes as hashes."""
    if hashes > len(PRIMES):
        raise ValueError(f"at most {len(PRIMES)} hashes are supported, not {hashes}")
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES[:hashes]])
    return F.transform(F.split(text, ""), lambda c: F.transform(primes, lambda p: F.pmod((F.ascii(c) + 1) * p, F.lit(buckets)).cast("int")))


_LABELS = np.zeros(max(map(ord, PUNCTUATION)) + 2, np.int32)
_LABELS[[10, *map(ord, PUNCTUATION)]] = np.arange(1, len(PUNCTUATION) + 2)


def _next_labels(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        if t is not None:
            cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            t = np.zeros(len(cp), np.int32)
            t[:-1] = _LABELS[np.minimum(cp[1:], len(_LABELS) - 1)]
        out.append(t)
    return pa.array(out, pa.list_(pa.int32()))


def next_labels(text: Column) -> Column:
    """Each character's label is the class of the next: 1 for a line break, 2 + k for the kth mark, else 0; the last has 0."""
    return F.arrow_udf(_next_labels, "array<int>")(text)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
