"""Anchors: capturing spans, finding them again, and resolving them against a later snapshot.

All functions take ``documents(source, doc_key, text, headings)`` with normalized texts (see
``load_documents``) and, where they resolve, ``anchors(anchor_ord, source, doc_key, heading_path,
span_hash, context_hash, char_range, span_text)``. An anchor is resolved within the documents of its
``source``. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions import spans as S
from spanwright.functions.markdown import parse_headings
from spanwright.functions.text import canonical_sha256, content_hash, normalize
from spanwright.session import materialize

_TOKEN = r"[\p{L}\p{N}_]+"
_NOT_TOKEN = r"[^\p{L}\p{N}_]+"


def load_documents(documents: DataFrame) -> DataFrame:
    """``(source, doc_key, text, headings)`` from ``(source, doc_key, normalized_text)``: normalized and parsed.

    Rows without key or text are left out.
    """
    text = normalize(F.col("normalized_text"))
    loaded = documents.where("doc_key IS NOT NULL AND normalized_text IS NOT NULL").select("source", "doc_key", text.alias("text"))
    return loaded.withColumn("headings", parse_headings(F.col("text")))


def distinct_anchors(anchors: DataFrame) -> DataFrame:
    """One row for each ``anchor_ord``; of rows that differ the greatest. A null path is the empty one, hashes get their one spelling."""
    columns = ["source", "doc_key", "heading_path", "span_hash", "context_hash", "char_range", "span_text"]
    one = anchors.where("anchor_ord IS NOT NULL").groupBy("anchor_ord").agg(F.max(F.struct(*columns)).alias("a")).select("anchor_ord", "a.*")
    return one.withColumns(
        {
            "heading_path": F.coalesce("heading_path", F.array().cast("array<string>")),
            "span_hash": canonical_sha256(F.col("span_hash")),
            "context_hash": canonical_sha256(F.col("context_hash")),
        }
    )


def capture(requests: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors for ``requests(request_id, source, doc_key, span, occurrence)``, and the requests that have none.

    ``occurrence`` counts from 0; a negative one counts from the end. Rejected, with a reason, are requests
    whose document or span isn't there, or that ask for an occurrence beyond the last.
    """
    wanted = requests.select("request_id", "source", "doc_key", normalize(F.col("span")).alias("span_text"), F.coalesce("occurrence", F.lit(0)).alias("k"))
    found = wanted.join(documents, ["source", "doc_key"], "left").withColumn("at", S.occurrences(F.col("text"), F.col("span_text")))
    start = F.when(F.col("k") >= 0, F.get("at", F.col("k"))).otherwise(F.try_element_at("at", F.col("k")))
    found = found.withColumn("start", start).withColumn("end", F.col("start") + F.char_length("span_text"))
    anchors = found.where("start IS NOT NULL").select(
        "request_id",
        "source",
        "doc_key",
        S.heading_path_at(F.col("headings"), F.col("start")).alias("heading_path"),
        content_hash(F.col("span_text")).alias("span_hash"),
        S.context_hash(F.col("text"), F.col("start"), F.col("end")).alias("context_hash"),
        F.struct("start", "end").alias("char_range"),
        "span_text",
    )
    reason = (
        F.when(F.col("text").isNull(), "no such document")
        .when(F.col("span_text").isNull() | (F.size("at") == 0), "span not found")
        .otherwise("no such occurrence")
    )
    return anchors, found.where("start IS NULL").select("request_id", "source", "doc_key", reason.alias("reason"))


def _held(spans: DataFrame, documents: DataFrame, rare_token: bool) -> DataFrame:
    """Documents with each span of their source that they hold: ``(source, span_text, doc_key, text, headings)``.

    A token inside of a span, with neighbours on both sides, is a whole token of every document that holds
    the span. So spans and documents are joined on each span's rarest inner token, and verified. Of the
    documents' tokens only those that stand inside of a span are counted and joined. Spans without inner
    token, and all with ``rare_token=False``, are compared with every document of the source.
    """
    spans = spans.select("source", "span_text").where("span_text <> ''").distinct()
    if not rare_token:
        return spans.join(documents, "source").where(F.contains("text", F.col("span_text")))
    pieces = F.split("span_text", _NOT_TOKEN, -1)
    inner = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda t: t != "")
    with_inner = materialize(spans.withColumn("inner", F.array_distinct(inner)), "spans")
    of_span = with_inner.select("source", "span_text", F.explode("inner").alias("token"))
    # written, so that its size is known: few enough tokens are broadcast to the documents
    wanted = materialize(of_span.select("source", "token").distinct(), "span-tokens")
    tokens = documents.select("source", "doc_key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)))).alias("token"))
    tokens = materialize(tokens.join(wanted, ["source", "token"], "left_semi"), "document-tokens")
    frequency = tokens.groupBy("source", "token").agg(F.count("*").alias("df"))
    # a token that no document has: the span is nowhere
    rarest = (
        of_span.join(frequency, ["source", "token"], "left")
        .groupBy("source", "span_text")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("r"))
        .where("r.df > 0")
        .select("source", "span_text", F.col("r.token").alias("token"))
    )
    candidates = rarest.join(tokens, ["source", "token"]).select("source", "span_text", "doc_key")
    held = candidates.join(documents, ["source", "doc_key"]).where(F.contains("text", F.col("span_text")))
    rest = with_inner.where(F.size("inner") == 0).drop("inner")
    return held.unionByName(rest.join(documents, "source").where(F.contains("text", F.col("span_text"))))


def span_pairs(spans: DataFrame, documents: DataFrame, rare_token: bool = True) -> DataFrame:
    """``(source, span_text, doc_key)`` of every document that holds a span of its source."""
    return _held(spans, documents.select("source", "doc_key", "text"), rare_token).select("source", "span_text", "doc_key")


def span_matches(spans: DataFrame, documents: DataFrame, rare_token: bool = True) -> DataFrame:
    """Every occurrence of every span: ``(source, span_text, doc_key, start, end, path, context, place)``."""
    at = _held(spans, documents.select("source", "doc_key", "text", "headings"), rare_token)
    at = at.withColumn("start", F.explode(S.occurrences(F.col("text"), F.col("span_text"))))
    at = at.withColumn("end", F.col("start") + F.char_length("span_text"))
    return at.select(
        "source",
        "span_text",
        "doc_key",
        "start",
        "end",
        S.heading_path_at(F.col("headings"), F.col("start")).alias("path"),
        S.context_hash(F.col("text"), F.col("start"), F.col("end")).alias("context"),
        S.locator(F.col("doc_key"), F.col("headings"), F.col("text"), F.col("start"), F.col("end")).alias("place"),
    )


def _stale_or_destroyed(missing: DataFrame, documents: DataFrame) -> DataFrame:
    """Outcome of anchors whose span is nowhere: what stands under their heading, or around their context, now."""
    own = missing.join(documents.select("source", "doc_key", F.col("text").alias("own_text"), F.col("headings").alias("own_headings")), ["source", "doc_key"], "left")
    own = own.withColumn("own_heading", S.find_heading(F.col("own_headings"), F.col("heading_path")))
    # a path resolves to another one where both end alike, so the first document with such a leaf is enough
    leaves = documents.select("source", "doc_key", F.explode("headings").alias("h")).select("source", "doc_key", F.element_at("h.path", -1).alias("leaf"))
    first = leaves.groupBy("source", "leaf").agg(F.min("doc_key").alias("other_key"))
    need = own.where("own_heading IS NULL AND size(heading_path) > 0").select("anchor_ord", "source", F.element_at("heading_path", -1).alias("leaf"), "heading_path")
    other = need.join(first, ["source", "leaf"]).join(
        documents.select("source", F.col("doc_key").alias("other_key"), F.col("text").alias("other_text"), F.col("headings").alias("other_headings")), ["source", "other_key"]
    )
    other = other.select("anchor_ord", "other_text", S.find_heading(F.col("other_headings"), F.col("heading_path")).alias("other_heading"))
    both = own.join(other, "anchor_ord", "left")
    both = both.withColumn("heading", F.coalesce("own_heading", "other_heading")).withColumn(
        "doc_text", F.when(F.col("own_heading").isNull() & F.col("other_heading").isNotNull(), F.col("other_text")).otherwise(F.col("own_text"))
    )
    under = S.paragraphs(F.col("doc_text"), F.col("heading.start"), F.col("heading.end"))
    both = both.withColumn("under", F.when(F.col("heading").isNotNull() & F.col("doc_text").isNotNull(), under))
    is_under = F.coalesce(F.size("under"), F.lit(0)) > 0
    whole = S.paragraphs(F.col("doc_text"), F.lit(0), F.char_length("doc_text"))
    shown = both.withColumn("is_under", is_under).withColumn("p", F.explode(F.when(F.col("is_under"), F.col("under")).otherwise(whole)))
    context = S.context_hash(F.col("doc_text"), F.col("p.start"), F.col("p.end"))
    shown = shown.select("anchor_ord", "is_under", "p.start", "p.text", F.coalesce(context == F.col("context_hash"), F.lit(False)).alias("fits"))
    # outside of the heading only what stands in the old context counts
    shown = shown.where("is_under OR fits").groupBy("anchor_ord").agg(F.array_sort(F.collect_list(F.struct("start", "text", "fits"))).alias("c"))
    texts = F.transform("c", lambda c: c["text"])
    suggestion = F.get(F.filter("c", lambda c: c["fits"]), F.lit(0))["text"]
    spans = F.when(suggestion.isNotNull(), F.concat(F.array(suggestion), F.filter(texts, lambda t: t != suggestion))).otherwise(texts)
    return missing.select("anchor_ord", "heading_path").join(shown.select("anchor_ord", spans.alias("spans")), "anchor_ord", "left").select(
        "anchor_ord",
        F.when(F.col("spans").isNotNull(), "stale").otherwise("destroyed").alias("resolution"),
        F.lit(None).cast("struct<start:int,end:int>").alias("new_char_range"),
        F.when(F.col("spans").isNotNull(), F.col("heading_path")).alias("new_heading_path"),
        F.coalesce("spans", F.array().cast("array<string>")).alias("candidate_spans"),
    )


def resolve(anchors: DataFrame, documents: DataFrame, rare_token: bool = True) -> tuple[DataFrame, DataFrame]:
    """Resolve anchors against documents: ``(resolutions, unresolvable)``.

    ``resolutions``: ``(anchor_ord, resolution, new_char_range, new_heading_path, candidate_spans)``, one row
    for each distinct anchor. ``unresolvable``: ``(anchor_ord, reason)`` of anchors whose text doesn't have
    their hash, a missing text or hash included; they are in no count of outcomes.

    The span found more than once is ambiguous; once in another document, or under a heading with another
    leaf, valid_relocated; at its old start with its old context, valid; else valid_repaired. Found nowhere,
    it is stale if text stands under its heading (in its document, else in the first document with such a
    heading) or, without, in its old context; else destroyed. A null doc_key is no document's.
    """
    # both are read several times, and parsing or searching again would cost most of the work
    documents = materialize(documents.select("source", "doc_key", "text", "headings"), "documents")
    one = distinct_anchors(anchors)
    sound = F.coalesce(content_hash(F.col("span_text")) == F.col("span_hash"), F.lit(False))
    checked = materialize(one.withColumn("sound", sound), "anchors")
    unresolvable = checked.where("NOT sound").select("anchor_ord", F.lit("span_text does not have span_hash").alias("reason"))
    good = checked.where("sound").drop("sound")
    matches = span_matches(good, documents, rare_token)
    owned = good.select("anchor_ord", "source", "span_text", F.col("doc_key").alias("own_key")).join(matches, ["source", "span_text"])
    is_other = ~F.coalesce(F.col("own_key") == F.col("doc_key"), F.lit(False))
    order = F.struct(is_other.alias("other"), "doc_key", "start", "end", "path", "context", "place")
    found = owned.groupBy("anchor_ord").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(order)).alias("m"))
    joined = materialize(good.join(found, "anchor_ord", "left"), "matches")
    m = F.get("m", F.lit(0))
    single = joined.where("n IS NOT NULL").withColumn("f", m)
    many = F.col("n") > 1
    outcome = (
        F.when(many, "ambiguous")
        .when(F.col("f.other") | ~S.paths_resolve(F.col("heading_path"), F.col("f.path")), "valid_relocated")
        .when(F.coalesce((F.col("f.start") == F.col("char_range.start")) & (F.col("f.context") == F.col("context_hash")), F.lit(False)), "valid")
        .otherwise("valid_repaired")
    )
    resolved = single.select(
        "anchor_ord",
        outcome.alias("resolution"),
        F.when(~many, F.struct(F.col("f.start").alias("start"), F.col("f.end").alias("end"))).alias("new_char_range"),
        F.when(~many, F.col("f.path")).alias("new_heading_path"),
        F.when(many, F.transform("m", lambda x: x["place"])).otherwise(F.array().cast("array<string>")).alias("candidate_spans"),
    )
    return resolved.unionByName(_stale_or_destroyed(joined.where("n IS NULL"), documents)), unresolvable


class Unresolvable(ValueError):
    """Anchors whose text doesn't have their hash."""


def resolve_all(anchors: DataFrame, documents: DataFrame) -> DataFrame:
    """``resolve``, in the order of the anchors; raises ``Unresolvable``, naming some, if any can't be resolved."""
    resolutions, unresolvable = resolve(anchors, documents)
    bad = [r["anchor_ord"] for r in unresolvable.orderBy("anchor_ord").limit(5).collect()]
    if bad:
        raise Unresolvable(f"span_text does not have span_hash: anchors {bad} and maybe more")
    return resolutions.orderBy("anchor_ord")


SPAN_FOUND = ("valid", "valid_repaired", "valid_relocated")
NEEDS_REVIEW = ("stale", "ambiguous")


def needs_review(resolutions: DataFrame) -> DataFrame:
    return resolutions.where(F.col("resolution").isin(*NEEDS_REVIEW))


def repaired(resolutions: DataFrame) -> DataFrame:
    return resolutions.where(F.col("resolution").isin(*SPAN_FOUND[1:]))


def unresolved(resolutions: DataFrame) -> DataFrame:
    return resolutions.where(F.col("resolution") == "destroyed")

