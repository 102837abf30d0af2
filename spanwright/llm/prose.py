"""The running prose of a Markdown text, in sentences."""

from __future__ import annotations

import re

from spanwright.llm.words import _MOJIBAKE, _mend

_FRONT_MATTER = re.compile(r"\A\ufeff?---[ \t]*\n(?:.*\n)*?(?:---|\.\.\.)[ \t]*(?:\n|\Z)")
_FENCE = re.compile(r"(?m)^ {0,3}(`{3,}|~{3,})[^\n]*\n(?:(?s:.*?)^ {0,3}\1[`~]*[ \t]*$|(?s:.*)\Z)")
_NO_PROSE = re.compile(r"(?m)^[ \t]*(?:#{1,6}(?:[ \t][^\n]*)?|\|[^\n]*|[-*_=]{3,}[ \t]*|<[A-Za-z/!][^\n]*>[ \t]*)$")
_INDENTED = re.compile(r"(?m)(?:(?<=\n\n)|\A)(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+")
_LIST_MARK = re.compile(r"(?m)^[ \t>]*(?:[-*+\u2022\u2013\u2014]|\d{1,3}[.)])[ \t]+")
_LINK = re.compile(r"(?<=\])\([^)\n]*\)|https?://\S+")
_TAG = re.compile(r"</?[A-Za-z!][^<>\n]*>")
_CODE = re.compile(r"`[^`\n]*`")
_SPLIT = re.compile(r"(?<=[.!?])[\"')\]*_]*\s+|\n\s*\n")


def sentences(text: str) -> list[str]:
    """Sentences, items of lists among them, without front matter, code, tables, headings and markup.

    A sentence ends at a full stop, exclamation or question mark before white space, or at a blank line;
    line ends inside a sentence stay.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = _MOJIBAKE.sub(_mend, text)
    if text.startswith(("---", "\ufeff---")):
        text = _FRONT_MATTER.sub("", text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "\n\n    " in text or "\n\n\t" in text or text.startswith(("    ", "\t")):
        text = _INDENTED.sub("\n", text)
    text = _NO_PROSE.sub("\n", text)
    text = _LIST_MARK.sub("\n\n", text)
    if "](" in text or "://" in text:
        text = _LINK.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "`" in text:
        text = _CODE.sub(" ", text)
    return [s for s in _SPLIT.split(text) if s and not s.isspace()]
