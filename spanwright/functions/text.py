"""Canonical text form, hashes and technical tokens as Column functions.

Offsets everywhere count code points of the normalized text. Null in, null out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The normalizer's version and the code points it folds.
NORMALIZER_VERSION = "1.0.0"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d"
SPACES = "\t\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f"

FOLD_FROM = DASHES + SPACES + SINGLE_QUOTES + DOUBLE_QUOTES
FOLD_TO = "-" * len(DASHES) + " " * len(SPACES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES)

#: Python's white space as a Java character class.
WS = r"\p{IsWhite_Space}\x1c-\x1f"

# What counts as a technical token, first alternative wins.
TECHNICAL_TOKEN_FORMS = [
    r"[A-Za-z_][A-Za-z0-9_]*[ ]*[=:][ ]*[^{ws},;.?!]+",  # key=value, key:value
    r"0x[0-9A-Fa-f]+",  # hex
    r"[0-9]+(?:\.[0-9]+){2,}",  # dotted version
    r"[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+",  # snake_case
    r"[A-Z]{2,}[0-9]+[A-Za-z0-9_]*",  # capitals and digits
    r"[A-Z]{3,}",  # acronym
]
#: Possessive quantifiers, where what follows can't match what they take, keep Java from trying in vain.
TECHNICAL_TOKEN = re.sub(
    r"(\[[^\]]*\](?:\*|\+|\{\d,\}))(?=\[|_|\(|0x)", r"\1+", "(?:" + "|".join(TECHNICAL_TOKEN_FORMS).replace("{ws}", WS) + ")"
)


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC. Only texts with a code point beyond ASCII travel to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def py_strip(text: Column) -> Column:
    """Strip all Unicode white space at both ends, as Python's ``str.strip`` does."""
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+\z", "")


def fold(text: Column) -> Column:
    """Everything the normalizer does after NFC."""
    t = F.translate(text, FOLD_FROM + ZERO_WIDTH, FOLD_TO)
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, " {2,}", " ")
    t = F.regexp_replace(t, r"(?md) +$", "")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return py_strip(t)


#: ASCII white space and control characters that never stand at the ends of a normalized text.
_ASCII_WS = " \n\x0b\x0c\x1c\x1d\x1e\x1f"


def is_normal(text: Column) -> Column:
    """Whether a text surely is in normal form: plain ASCII without anything the normalizer would rewrite.

    Byte searches only, so that the many clean texts cost no regular expression.
    """
    clean = F.octet_length(text) == F.char_length(text)
    for dirt in ("\t", "\r", "  ", " \n", "\n\n\n"):
        clean = clean & ~F.contains(text, F.lit(dirt))
    return clean & (F.octet_length(F.btrim(text, F.lit(_ASCII_WS))) == F.octet_length(text))


def normalize(text: Column) -> Column:
    """The canonical form of a text: NFC, folded dashes, spaces and quotes, tidy white space; case stays."""
    return F.when(is_normal(text), text).otherwise(fold(nfc(text)))


def content_hash(text: Column) -> Column:
    """SHA-256, hex, of the normalized text. ``text`` may be normalized already.

    The normalizer isn't quite idempotent (a zero-width character may part a letter from its accent),
    so the text is normalized here whatever the caller did before.
    """
    return F.sha2(normalize(text).cast("binary"), 256)


#: A word of small letters that no token can begin in: the search steps over it at once.
_PLAIN_WORD = r"[a-z]++(?![A-Za-z0-9_])(?![ ]*+[=:])"


def technical_tokens(text: Column) -> Column:
    """Array of the technical tokens of a text, in order, with repeats."""
    found = F.regexp_extract_all(normalize(text), F.lit(f"{_PLAIN_WORD}|({TECHNICAL_TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: t != "")


def missing_tokens(tokens: Column, normalized_span: Column) -> Column:
    """Those of a question's technical tokens that are no substring of the normalized span; empty when all are there.

    Both come from columns that were computed before: a lambda can't call the NFC function.
    """
    return F.when(normalized_span.isNotNull(), F.filter(tokens, lambda t: ~F.contains(normalized_span, t)))


def canonical_sha256(column: Column) -> Column:
    """A SHA-256 as 64 lower-case hex digits, however it is spelled; null if it is none."""
    bare = F.regexp_replace(F.lower(F.trim(column)), "^sha-?256:", "")
    return F.when(bare.rlike(r"^[0-9a-f]{64}\z"), bare)


def canonical_label(column: Column) -> Column:
    """An enumerated value in its one spelling: lower case, inner spaces and hyphens as underscores."""
    return F.regexp_replace(F.lower(py_strip(column)), "[ -]+", "_")


_PY_FOLD = {**dict(zip(map(ord, FOLD_FROM), FOLD_TO, strict=True)), **dict.fromkeys(map(ord, ZERO_WIDTH))}
_PY_LINE_END = re.compile("\r\n?")
_PY_SPACES = re.compile(" {2,}")
_PY_TRAILING = re.compile("(?m) +$")
_PY_LINES = re.compile("\n{3,}")


def normalize_str(text: str) -> str:
    """``normalize`` for one Python string, for use inside Arrow kernels."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = text.translate(_PY_FOLD)
    if "\r" in text:
        text = _PY_LINE_END.sub("\n", text)
    if "  " in text:
        text = _PY_SPACES.sub(" ", text)
    if " \n" in text or text.endswith(" "):
        text = _PY_TRAILING.sub("", text)
    if "\n\n\n" in text:
        text = _PY_LINES.sub("\n\n", text)
    return text.strip()
