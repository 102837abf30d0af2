"""Words of a text, folded so that differences of form don't matter."""

from __future__ import annotations

import re
import unicodedata

_TAG = re.compile(r"</?[A-Za-z!][^<>\n]*>")
_LIST_MARK = re.compile(r"(?m)^[ \t>]*(?:[-*+\u2022\u2013\u2014]|\d{1,3}[.)])[ \t]+")
_ENTITY = re.compile(r"&(?:[a-z]{2,8}|#\d{1,6}|#x[0-9a-f]{1,5});")
_WRAP_HYPHEN = re.compile(r"(?<=[^\W\d_])(?:\u00ad|[-\u2010]\n[ \t]*)(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
# UTF-8 that was read as a one-byte code page leaves these before the second byte
_MOJIBAKE = re.compile(r"[\u00c2\u00c3\u00e2][\u0080-\u00bf\u0152-\u0178\u02c6-\u02dc\u2013-\u2122]{1,2}")
_COMBINING = re.compile(r"[\u0300-\u036f]+")


def _mend(match: re.Match) -> str:
    broken = match.group(0)
    for page in ("cp1252", "latin-1"):
        try:
            return broken.encode(page).decode("utf-8")
        except UnicodeError:
            continue
    return broken


def fold_text(text: str) -> str:
    """Lower case without markup, list marks, accents, wrapped hyphens and mended where UTF-8 was misread."""
    if not text.isascii():
        text = _MOJIBAKE.sub(_mend, text)
        text = _WRAP_HYPHEN.sub("", text)
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", text))
    elif "-\n" in text:
        text = _WRAP_HYPHEN.sub("", text)
    text = _LIST_MARK.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text.lower()
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    return text


def words(text: str) -> list[str]:
    """The folded words: runs of letters and digits."""
    return _WORD.findall(fold_text(text))
