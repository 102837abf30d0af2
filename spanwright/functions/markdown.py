"""Markdown structure of a normalized text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions.text import WS, py_strip

LOADER = "markdown"
LOADER_VERSION = "builtin-markdown-1.1.0"
SUFFIXES = (".md", ".markdown")

# What a heading line and a fence line look like.
HEADING_LINE = r"(?d)^(#{1,6})(?:[ \t]+(.+))?\z"
FENCE_LINE = r"(?d)^ {0,3}(`{3,}|~{3,})(.*)\z"

REGIONS = "array<struct<start:int,end:int>>"
_HEADS = "array<struct<level:int,title:string,line_start:int,start:int>>"
HEADINGS = "array<struct<path:array<string>,level:int,start:int,end:int>>"


def _scan(text: Column) -> Column:
    """One pass over the lines: ``(pos, fence_char, fence_length, fence_start, regions, heads)``."""
    begin = F.struct(
        F.lit(0).alias("pos"),
        F.lit("").alias("fence_char"),
        F.lit(0).alias("fence_length"),
        F.lit(0).alias("fence_start"),
        F.array().cast(REGIONS).alias("regions"),
        F.array().cast(_HEADS).alias("heads"),
    )

    def step(s: Column, line: Column) -> Column:
        end = s["pos"] + F.char_length(line)
        mark = F.regexp_extract(line, FENCE_LINE, 1)
        info = F.regexp_replace(F.regexp_extract(line, FENCE_LINE, 2), f"[{WS}]+", "")
        char = F.substring(mark, 1, 1)
        is_open = s["fence_char"] != ""
        opens = ~is_open & (mark != "") & ~((char == "`") & F.contains(info, F.lit("`")))
        closes = is_open & (char == s["fence_char"]) & (F.char_length(mark) >= s["fence_length"]) & (info == "")
        is_head = ~is_open & (mark == "") & line.rlike(HEADING_LINE)
        region = F.array(F.struct(s["fence_start"].alias("start"), end.alias("end")))
        head = F.array(
            F.struct(
                F.char_length(F.regexp_extract(line, HEADING_LINE, 1)).alias("level"),
                py_strip(F.regexp_extract(line, HEADING_LINE, 2)).alias("title"),
                s["pos"].alias("line_start"),
                (end + 1).alias("start"),
            )
        )
        return F.struct(
            (end + 1).alias("pos"),
            F.when(opens, char).when(closes, F.lit("")).otherwise(s["fence_char"]).alias("fence_char"),
            F.when(opens, F.char_length(mark)).otherwise(s["fence_length"]).alias("fence_length"),
            F.when(opens, s["pos"]).otherwise(s["fence_start"]).alias("fence_start"),
            F.when(closes, F.concat(s["regions"], region)).otherwise(s["regions"]).alias("regions"),
            F.when(is_head, F.concat(s["heads"], head)).otherwise(s["heads"]).alias("heads"),
        )

    def finish(s: Column) -> Column:
        rest = F.array(F.struct(s["fence_start"].alias("start"), F.char_length(text).alias("end")))
        return F.struct(
            F.when(s["fence_char"] != "", F.concat(s["regions"], rest)).otherwise(s["regions"]).alias("regions"), s["heads"].alias("heads")
        )

    return F.aggregate(F.split(text, "\n", -1), begin, step, finish)


def fenced_regions(text: Column) -> Column:
    """Ranges ``[start, end)`` of fenced code, an unclosed fence up to the end of the text."""
    return _scan(text)["regions"]


def parse_headings(text: Column) -> Column:
    """Headings of a normalized text: ``path, level, start, end`` of their bodies, in order.

    ATX headings outside of fenced code. A body runs from behind the heading's line to the next heading of
    any level. A heading without title is one, with an empty title.
    """
    begin = F.struct(
        F.array().cast("array<struct<level:int,title:string>>").alias("open"),
        F.array().cast("array<struct<path:array<string>,level:int,start:int,line_start:int>>").alias("out"),
    )

    def step(s: Column, h: Column) -> Column:
        # the ancestors are the open headings of lesser level
        stack = F.concat(F.filter(s["open"], lambda x: x["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))
        entry = F.struct(
            F.transform(stack, lambda x: x["title"]).alias("path"), h["level"].alias("level"), h["start"].alias("start"), h["line_start"].alias("line_start")
        )
        return F.struct(stack.alias("open"), F.concat(s["out"], F.array(entry)).alias("out"))

    heads = F.aggregate(_scan(text)["heads"], begin, step, lambda s: s["out"])
    bound = F.get(
        F.transform(
            F.array(heads),
            lambda hs: F.transform(
                hs,
                lambda h, k: F.struct(
                    h["path"].alias("path"),
                    h["level"].alias("level"),
                    h["start"].alias("start"),
                    F.coalesce(F.get(hs, k + 1)["line_start"], F.char_length(text)).alias("end"),
                ),
            ),
        ),
        F.lit(0),
    )
    return F.when(text.isNotNull(), bound)
