"""Spans, heading paths and their contexts, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions.text import WS, content_hash

#: Characters on either side of a span that make up its context.
CONTEXT_WINDOW = 400


def occurrences(text: Column, needle: Column) -> Column:
    """All offsets at which ``needle`` stands in ``text``, overlapping ones too; none for an empty needle."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    ends = F.aggregate(
        F.slice(F.split(text, quoted, -1), 1, F.greatest(F.size(F.split(text, quoted, -1)) - 1, F.lit(0))),
        F.array().cast("array<int>"),
        lambda acc, piece: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.char_length(piece))),
    )
    at_start = F.when(F.startswith(text, needle), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(needle == "", F.array().cast("array<int>")).when(F.contains(text, needle), F.array_distinct(F.concat(at_start, ends))).when(
        text.isNotNull() & needle.isNotNull(), F.array().cast("array<int>")
    )


def heading_path_at(headings: Column, position: Column) -> Column:
    """Path of the deepest heading whose body holds a position, the first of equals; empty if there is none."""
    best = F.aggregate(
        F.filter(headings, lambda h: (h["start"] <= position) & (position < h["end"])),
        F.struct(F.lit(-1).alias("level"), F.array().cast("array<string>").alias("path")),
        lambda b, h: F.when(h["level"] > b["level"], F.struct(h["level"].alias("level"), h["path"].alias("path"))).otherwise(b),
    )
    return F.coalesce(best["path"], F.array().cast("array<string>"))


def context_hash(text: Column, start: Column, end: Column) -> Column:
    """Hash of up to 400 characters before and after a span, the span left out."""
    before = F.substr(text, F.greatest(start - CONTEXT_WINDOW, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_WINDOW)))
    after = F.substr(text, end + 1, F.lit(CONTEXT_WINDOW))
    return content_hash(F.concat(before, F.lit("\x00"), after))


def common_suffix(a: Column, b: Column) -> Column:
    """How many last elements two paths have in common, up to the first difference."""
    equal = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(equal, F.lit(False)).cast("int")
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b)))


def paths_resolve(a: Column, b: Column) -> Column:
    """Whether two heading paths lead to the same section: both empty, or with a last element in common."""
    return ((F.size(a) == 0) & (F.size(b) == 0)) | (common_suffix(a, b) > 0)


def find_heading(headings: Column, path: Column) -> Column:
    """The heading that a path leads to: the first of that very path, else the first with the longest common suffix; null if none."""
    scored = F.transform(
        headings,
        lambda h, k: F.struct(
            F.when(h["path"] == path, F.lit(1 << 30)).otherwise(common_suffix(h["path"], path)).alias("score"), (-k).alias("order"), h.alias("h")
        ),
    )
    best = F.array_max(F.transform(F.filter(scored, lambda s: s["score"] > 0), lambda s: F.struct(s["score"], s["order"])))
    return F.when(F.size(path) > 0, F.get(headings, -best["order"]))


def paragraphs(text: Column, start: Column, end: Column) -> Column:
    """Runs of non-blank lines in ``[start, end)``: ``array<struct<text, start, end>>``."""
    part = F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))
    begin = F.struct(
        start.cast("int").alias("pos"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )

    def closed(s: Column) -> Column:
        return F.when(s["first"] >= 0, F.concat(s["out"], F.array(F.struct(s["first"].alias("start"), s["last"].alias("end"))))).otherwise(s["out"])

    def step(s: Column, line: Column) -> Column:
        blank = line.rlike(rf"^[{WS}]*\z")
        stop = s["pos"] + F.char_length(line)
        return F.struct(
            (stop + 1).alias("pos"),
            F.when(blank, F.lit(-1)).when(s["first"] >= 0, s["first"]).otherwise(s["pos"]).alias("first"),
            F.when(blank, F.lit(-1)).otherwise(stop).alias("last"),
            F.when(blank, closed(s)).otherwise(s["out"]).alias("out"),
        )

    ranges = F.aggregate(F.split(part, "\n", -1), begin, step, closed)
    return F.transform(
        ranges, lambda r: F.struct(F.substr(text, r["start"] + 1, r["end"] - r["start"]).alias("text"), r["start"].alias("start"), r["end"].alias("end"))
    )


def locator(doc_key: Column, headings: Column, text: Column, start: Column, end: Column) -> Column:
    """A span's place in words: ``doc_key [path > of > headings] @start-end: text``."""
    path = F.array_join(heading_path_at(headings, start), " > ")
    return F.concat(
        doc_key, F.lit(" ["), F.when(path == "", "(no heading)").otherwise(path), F.lit("] @"), start.cast("string"), F.lit("-"), end.cast("string"),
        F.lit(": "), F.substr(text, start + 1, end - start),
    )
