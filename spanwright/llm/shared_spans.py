"""Long verbatim passages that several texts share.

A run of 150 characters holds 76 overlapping grams of 75. Of each such window every text keeps the gram
with the least hash, so two texts that share a run keep a common gram of it (winnowing): about one gram
in 38 stands for all windows, and no shared run is lost. A count-min sketch of the kept grams, merged from
the sketches of all partitions, overestimates how many texts hold a gram; it grows with the grams. The second
pass sends on only grams that the sketch takes to be repeated, with the characters around them; these are
grouped exactly, and every pair in a group is compared character by character to the left and right of the
gram. A gram that very many texts hold is split further, by all windows of 150 characters around it. As long
as the sketch is small it is broadcast to the second pass, else grams are sent to its slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import normalize
from spanwright.llm import sketch
from spanwright.llm.sketch import mix
from spanwright.session import materialize

RUN = 150
#: A gram of more texts than this is split by its windows.
HOT = 1000
#: Characters worked on at a time, and rows of a bucket.
_CHUNK, _BUCKET_ROWS = 1_000_000, 50_000
#: Up to so many frequent grams are broadcast to be set apart.
_MOST_HOT = 100_000
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width``."""
    out, done = values, 1
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


class Winnower:
    """Keeps the grams that stand for all windows of ``run`` characters."""

    def __init__(self, run: int):
        self.run, self.gram = run, run // 2
        self.grams = run - self.gram + 1
        self.forth = self.back = np.ones(1, np.uint64)

    def kept(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text number, position, gram hash)`` of the kept grams of texts of any length."""
        found = []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= _CHUNK):
                size += len(texts[stop])
                stop += 1
            text, pos, gram = self._kept(texts[start:stop])
            found.append((text + start, pos, gram))
            start = stop
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _kept(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        ends = np.cumsum([len(t) for t in texts])
        n = len(codes)
        if n < self.run:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.forth) < n:
            self.forth, self.back = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.back[:n])])
        gram = mix((sums[self.gram :] - sums[: -self.gram]) * self.forth[: n - self.gram + 1])
        least = _sliding(gram, self.grams, np.minimum)  # of the windows of a run's length
        owner = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)))
        crosses = np.arange(len(least)) + self.run > ends[owner[: len(least)]]
        least[crosses] = 0
        padded = np.concatenate([np.zeros(self.grams - 1, np.uint64), least, np.zeros(self.grams - 1, np.uint64)])
        at = np.flatnonzero((_sliding(padded, self.grams, np.maximum) == gram) & (gram != 0))
        text = owner[at]
        return text, at - np.append(0, ends)[text], gram[at].view(np.int64)


def _sketcher(run: int, width: int):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(run)
        for batch in batches:
            text, _, gram = winnower.kept(batch.column(0).to_pylist())
            # a text counts a gram once
            order = np.lexsort((gram, text))
            text, gram = text[order], gram[order]
            gram = gram[np.append(True, (text[1:] != text[:-1]) | (gram[1:] != gram[:-1]))] if len(gram) else gram
            yield sketch.partial(gram, width)

    return run_


_OCCURRENCES = "class string, gram bigint, pos int, before int, around string"


def _around(texts: list[str], text: np.ndarray, pos: np.ndarray, run: int) -> tuple[np.ndarray, list[str]]:
    """How many characters of the texts stand before the grams, half a run at most, and these with what follows."""
    before = np.minimum(pos, run - run // 2)
    return before, [texts[t][p - b : p + run] for t, p, b in zip(text.tolist(), pos.tolist(), before.tolist(), strict=True)]


def _occurrences(run: int, bits, found_only: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(run)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            text, pos, gram = winnower.kept(texts)
            on = sketch.repeated(bits.value, gram)
            text, pos, gram = text[on], pos[on], gram[on]
            before, around = _around(texts, text, pos, run)
            if found_only:  # in monotonous texts the same surroundings come again and again; once is enough for a pair
                seen: set[tuple[int, int, str]] = set()
                new = [k for k, x in enumerate(zip(text.tolist(), before.tolist(), around, strict=True)) if x not in seen and not seen.add(x)]
                text, pos, gram, before, around = text[new], pos[new], gram[new], before[new], [around[k] for k in new]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), pa.array(gram), pa.array(pos.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(around, pa.string())],
                ["class", "gram", "pos", "before", "around"],
            )

    return find


def _placed_grams(run: int, width: int):
    """All kept grams, with their slice and cells of the sketch."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(run)
        for batch in batches:
            text, pos, gram = winnower.kept(batch.column(1).to_pylist())
            at = sketch.cells(gram, width)
            columns = [gram, pos.astype(np.int32), (at[0] // sketch.SLICE).astype(np.int32), *((c % sketch.SLICE).astype(np.int32) for c in at)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *map(pa.array, columns)], ["class", "gram", "pos", "slice", *(f"cell{r}" for r in range(len(at)))])

    return find


def _surroundings(run: int):
    """Occurrences from ``(class, text, grams ARRAY<STRUCT<pos, gram>>)``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(2)
            text = np.repeat(np.arange(len(batch)), np.diff(grams.offsets.to_numpy()))
            pos, gram = (grams.flatten().field(k) for k in range(2))
            before, around = _around(batch.column(1).to_pylist(), text, pos.to_numpy(), run)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), gram, pos, pa.array(before.astype(np.int32)), pa.array(around, pa.string())], ["class", "gram", "pos", "before", "around"]
            )

    return find


def _spread_occurrences(classes: DataFrame, run: int, partials: DataFrame, width: int) -> DataFrame:
    """As ``_occurrences``, by a sketch that stays spread over its slices."""
    cells = [f"cell{r}" for r in range(sketch.DEPTH)]
    placed = classes.select("class", "text").mapInArrow(_placed_grams(run, width), "class string, gram bigint, pos int, slice int, " + ", ".join(f"{c} int" for c in cells))
    slices = materialize(sketch.merged_slices(partials, bits=True), "sketch")
    byte = "conv(hex(substring(data, {0} div 8 + 1, 1)), 16, 10)"
    on = " AND ".join(f"shiftright(cast({byte.format(c)} AS int), 7 - {c} % 8) % 2 = 1" for c in cells)
    kept = placed.join(slices.hint("merge"), "slice").where(on).groupBy("class").agg(F.collect_list(F.struct("pos", "gram")).alias("grams"))
    return classes.select("class", "text").join(kept, "class").select("class", "text", "grams").mapInArrow(_surroundings(run), _OCCURRENCES)


_PAIR_COLUMNS = ("a", "a_start", "a_end", "b", "b_start", "b_end")
_PAIRS = "a string, a_start int, a_end int, b string, b_start int, b_end int"


def _pairs_of(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows within groups that lie at ``first`` and have ``size`` rows."""
    start = np.repeat(first, size)
    row = np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size) + start
    later = np.repeat(first + size, size) - row - 1
    i = np.repeat(row, later)
    j = np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later) + i + 1
    return i, j


def _comparer(run: int, found_only: bool):
    gram = run // 2
    side = run - gram

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("gram", "ascending"), ("class", "ascending"), ("pos", "ascending")])
        owner, pos = table.column("class").to_numpy(), table.column("pos").to_numpy()
        key, before = table.column("gram").to_numpy(), table.column("before").to_numpy()
        again = np.append(False, key[1:] == key[:-1])
        on = again | np.append(again[1:], False)  # grams of one text only, which the sketch let pass, go
        table, owner, pos, key, before = table.filter(pa.array(on)), owner[on], pos[on], key[on], before[on]
        n = len(key)
        if not n:
            return pa.table({c: pa.array([], pa.string() if c in "ab" else pa.int32()) for c in _PAIR_COLUMNS})
        # characters by column, the gram from column `side` on; outside of a text nothing equals anything
        wide = np.empty((n, side + run), np.uint32)
        wide[:] = 0x110000 + np.arange(n, dtype=np.uint32)[:, None]
        for k, (text, b) in enumerate(zip(table.column("around").to_pylist(), before.tolist(), strict=True)):
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            wide[k, side - b : side - b + len(codes)] = codes
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, n))
        seen, out = set(), []
        left, right = wide[:, :side][:, ::-1], wide[:, side + gram :]
        groups = np.cumsum(size * (size - 1) // 2)
        cuts = np.searchsorted(groups, np.arange(200_000, int(groups[-1]) + 200_000, 200_000)) + 1
        for lo, hi in zip(np.append(0, cuts[:-1]), cuts, strict=True):
            i, j = _pairs_of(first[lo:hi], size[lo:hi])
            on = owner[i] != owner[j]
            i, j = i[on], j[on]
            for k in range(0, len(i), 50_000):
                p, q = i[k : k + 50_000], j[k : k + 50_000]
                same = (wide[p, side : side + gram] == wide[q, side : side + gram]).all(axis=1)
                to_left = np.concatenate([left[p] != left[q], np.ones((len(p), 1), bool)], axis=1).argmax(axis=1)
                to_right = np.concatenate([right[p] != right[q], np.ones((len(p), 1), bool)], axis=1).argmax(axis=1)
                on = same & (to_left + gram + to_right >= run)
                p, q, to_left, to_right = p[on], q[on], to_left[on], to_right[on]
                if found_only:
                    new = [m for m, pair in enumerate(zip(owner[p], owner[q], strict=True)) if pair not in seen and not seen.add(pair)]
                    p, q, to_left, to_right = p[new], q[new], to_left[new], to_right[new]
                out.append((p, q, to_left, to_right))
        p, q, to_left, to_right = (np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]).astype(np.int64) for k in range(4))
        return pa.table(
            {
                "a": pa.array(owner[p], pa.string()),
                "a_start": pa.array((pos[p] - to_left).astype(np.int32)),
                "a_end": pa.array((pos[p] + gram + to_right).astype(np.int32)),
                "b": pa.array(owner[q], pa.string()),
                "b_start": pa.array((pos[q] - to_left).astype(np.int32)),
                "b_end": pa.array((pos[q] + gram + to_right).astype(np.int32)),
            }
        )

    return compare


def _windows(occurrences: DataFrame, run: int) -> DataFrame:
    """``(class, start, w)``: all windows of ``run`` characters around the grams, by their hash."""
    start = F.explode(F.sequence(F.lit(0), F.char_length("around") - run))
    return (
        occurrences.where(F.char_length("around") >= run)
        .select("class", F.col("pos"), "before", "around", start.alias("k"))
        .select("class", (F.col("pos") - F.col("before") + F.col("k")).alias("start"), F.md5(F.substr("around", F.col("k") + 1, F.lit(run)).cast("binary")).alias("w"))
        .distinct()
    )


def _hot_pairs(hot: DataFrame, run: int) -> DataFrame:
    """Pairs of texts that hold very frequent grams, by exact equality of windows around them."""
    holders = _windows(hot, run).groupBy("w", "class").agg(F.min("start").alias("start"))
    # windows that no other text has leave before the join
    repeated = holders.groupBy("w").count().where("count > 1").select("w")
    holders = holders.join(repeated, "w", "left_semi")
    a, b = (holders.select("w", F.col("class").alias(x), F.col("start").alias(f"{x}_start"), (F.col("start") + run).alias(f"{x}_end")) for x in "ab")
    return a.join(b, "w").where("a < b").select(*_PAIR_COLUMNS)


def _grouped(classes: DataFrame, run: int, found_only: bool, hot: int, most_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Occurrences of grams that may be repeated: those compared pair by pair, with a bucket, and the very frequent ones."""
    spark = classes.sparkSession
    long = classes.where(F.col("n_chars") >= run)
    total = long.agg(F.sum("n_chars")).first()[0] or 0
    width = sketch.width_for(2 * total // (run // 4), None)
    partials = long.select("text").mapInArrow(_sketcher(run, width), sketch.PARTIALS)
    if sketch.DEPTH * width <= 8 * most_bytes:
        bits = spark.sparkContext.broadcast(sketch.merged(partials, width, bits=True))
        found = long.select("class", "text").mapInArrow(_occurrences(run, bits, found_only), _OCCURRENCES)
    else:
        found = _spread_occurrences(long, run, partials, width)
    found = materialize(found, "grams")
    frequent = found.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("gram")
    n_frequent = frequent.count()
    few, many = found, None
    if n_frequent:
        frequent = F.broadcast(frequent) if n_frequent <= _MOST_HOT else frequent
        few, many = found.join(frequent, "gram", "left_anti"), found.join(frequent, "gram", "left_semi")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // _BUCKET_ROWS)
    return few.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets))), many


def sharing_pairs(classes: DataFrame, run: int = RUN, hot: int = HOT, most_bytes: int = sketch.MOST_BYTES) -> DataFrame:
    """Pairs ``(a, b)`` of different texts of ``classes(class, text, n_chars)`` that share a run; pairs may repeat."""
    few, many = _grouped(classes, run, True, hot, most_bytes)
    pairs = few.groupBy("bucket").applyInArrow(_comparer(run, True), _PAIRS)
    return (pairs.unionByName(_hot_pairs(many, run)) if many is not None else pairs).select("a", "b")


def text_refs(documents: DataFrame, anchors: DataFrame, run: int = RUN) -> DataFrame:
    """``(ref, doc_key, is_anchor, class, text)`` of all documents and anchors whose normalized text has ``run`` characters."""

    def refs(df: DataFrame, ref: Column, text: str, is_anchor: bool) -> DataFrame:
        return df.select(ref.alias("ref"), "doc_key", F.lit(is_anchor).alias("is_anchor"), normalize(F.col(text)).alias("text"))

    both = refs(documents, F.col("doc_key"), "normalized_text", False).unionByName(
        refs(anchors, F.concat(F.lit("anchor:"), F.col("anchor_ord").cast("string")), "span_text", True)
    )
    both = both.where((F.char_length("text") >= run) & F.col("ref").isNotNull())
    return both.withColumn("class", F.md5(F.col("text").cast("binary")))


class SharedSpans:
    """Shared passages of documents and anchors.

    ``documents(doc_key, normalized_text)`` holds one row for each document, ``anchors(anchor_ord, doc_key,
    span_text)`` may repeat rows. Null texts and keys, and texts of fewer than ``run`` characters, share
    nothing. Equal texts are worked on once, as a class. An anchor without ``doc_key`` belongs to no
    document, so any document may share its text. An anchor that was delivered with several texts counts
    with each.
    """

    def __init__(self, documents: DataFrame, anchors: DataFrame, run: int = RUN, hot: int = HOT, most_bytes: int = sketch.MOST_BYTES):
        self.run, self.hot, self.most_bytes = run, hot, most_bytes
        refs = materialize(text_refs(documents, anchors, run), "refs")
        self.texts = text_refs(documents, anchors, 0)
        self.members = refs.select("ref", "doc_key", "is_anchor", "class", F.char_length("text").alias("n_chars")).distinct()
        # whole documents may be equal; of a class any text will do
        classes = refs.select("class", "text").dropDuplicates(["class"]).withColumn("n_chars", F.char_length("text"))
        self.classes = materialize(classes, "classes")  # both passes read it

    def _expand(self, pairs: DataFrame) -> DataFrame:
        """Pairs of classes as pairs of members ``x``, ``y``, each pair once; never two anchors, nor an anchor and its own document."""
        x, y = (
            self.members.select(F.col("class").alias(c), *(F.col(k).alias(f"{m}_{k}") for k in ("ref", "doc_key", "is_anchor"))) for c, m in (("a", "x"), ("b", "y"))
        )
        joined = pairs.join(x, "a").join(y, "b")
        other = F.coalesce(F.col("x_doc_key") != F.col("y_doc_key"), F.lit(True))
        return joined.where(~(F.col("x_is_anchor") & F.col("y_is_anchor")) & other)

    def pairs(self) -> DataFrame:
        """Distinct ``(ref_a, ref_b)``, ``ref_a < ref_b``, that share a run."""
        between = sharing_pairs(self.classes, self.run, self.hot, self.most_bytes).distinct()
        within = self.members.groupBy("class").count().where("count > 1").select(F.col("class").alias("a"), F.col("class").alias("b"))
        all_pairs = self._expand(between).unionByName(self._expand(within).where("x_ref < y_ref"))
        return all_pairs.select(F.least("x_ref", "y_ref").alias("ref_a"), F.greatest("x_ref", "y_ref").alias("ref_b")).distinct()

    def coverage(self) -> DataFrame:
        """For each document and anchor the passages that other documents hold too, and their share of its text, 0 where there are none.

        ``(ref, is_anchor, n_chars, spans ARRAY<STRUCT<start, end>>, covered, share)``; overlapping and
        adjoining passages are merged.
        """
        few, many = _grouped(self.classes, self.run, False, self.hot, self.most_bytes)
        runs = few.groupBy("bucket").applyInArrow(_comparer(self.run, False), _PAIRS)
        ends = (F.struct(F.col(x).alias("class"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end"), F.col(y).alias("holder")) for x, y in ("ab", "ba"))
        sides = runs.select(F.explode(F.array(*ends)).alias("side")).select("side.*")
        # which documents hold a text: two different ones tell for any owner whether another holds it
        owners = self.members.where("NOT is_anchor").groupBy("class").agg(F.min("doc_key").alias("least"), F.max("doc_key").alias("greatest"))
        other = F.col("least").isNotNull() & (F.col("doc_key").isNull() | (F.col("least") != F.col("doc_key")) | (F.col("greatest") != F.col("doc_key")))
        held = self.members.select("ref", "doc_key", "class")
        parts = (
            sides.join(owners.withColumnRenamed("class", "holder"), "holder")
            .groupBy("class", "start", "end")
            .agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
            .join(held, "class")
            .where(other)
            .select("ref", "start", "end")
            .unionByName(held.join(owners, "class").where(other).select("ref", F.lit(0).alias("start"), F.lit(None).cast("int").alias("end")))
        )
        if many is not None:
            windows = materialize(_windows(many, self.run), "windows")
            holders = windows.select("w", "class").distinct().join(owners, "class").groupBy("w").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
            places = windows.join(holders, "w").join(held, "class").where(other)
            parts = parts.unionByName(places.select("ref", "start", (F.col("start") + self.run).alias("end")))
        parts = parts.distinct()
        refs = self.texts.select("ref", "is_anchor", F.char_length("text").alias("n_chars")).groupBy("ref").agg(F.first("is_anchor").alias("is_anchor"), F.max("n_chars").alias("n_chars"))
        parts = parts.join(refs, "ref").select("ref", "start", F.coalesce("end", "n_chars").alias("end"))
        sorted_parts = F.array_sort(F.collect_set(F.struct("start", "end")))
        merged = F.aggregate(
            sorted_parts,
            F.array().cast("array<struct<start:int,end:int>>"),
            lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
                F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))),
            ).otherwise(F.concat(acc, F.array(s))),
        )
        spans_of = parts.groupBy("ref").agg(merged.alias("spans"))
        covered = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
        return (
            refs.join(spans_of, "ref", "left")
            .withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
            .withColumn("covered", covered)
            .select("ref", "is_anchor", "n_chars", "spans", "covered", F.when(F.col("n_chars") > 0, F.round(F.col("covered") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("share"))
        )
