"""Lightly edited copies among documents.

A document is the set of its sentences, a sentence the set of its words. Equal texts are one class. A
sentence's signature has one bit for each of its rarest words, in a space as wide as the vocabulary, so a
word more or less moves one bit, and one that is frequent moves none. The signature is cut into two segments
by the words' hashes; each segment is indexed as it is and in all variants with one bit left out, and
variants are joined by equality: sentences meet if a segment differs by a bit, or by one bit replaced. So
keys have several rare words, and there are the more of them the larger the vocabulary is. What meets is
checked for its distance.

Copies share most sentences, so of a document only so many sentences need to be looked up, those whose keys
are rarest by a count-min sketch, which also keeps keys of one document out of the join. Documents linked
often enough, seen from either side, are candidates, and each candidate pair is verified on all its sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import normalize
from spanwright.llm import sketch
from spanwright.llm.batches import by_size
from spanwright.llm.prose import sentences
from spanwright.llm.sketch import mix
from spanwright.llm.words import words
from spanwright.session import materialize

#: Sentences of either document that must recur in the other, as a share.
RECURRING = 0.6
#: Likeness (Dice, of their words) of two sentences that are the same but for edits.
SENTENCE_LIKENESS = 0.75
#: Linked sentences that a candidate pair has at least, or all that have to recur.
LINKS = 2
#: Bits of a sentence's signature: its rarest words.
BITS = 8
#: Sentences of up to so many words have one segment, of at least so many two; between, both.
ONE_SEGMENT, TWO_SEGMENTS = 9, 7
#: Cells in which words are counted, to order them; the counts are broadcast (1 MB).
CELLS = 1 << 18
#: Sentences of fewer different words recur only with the same words.
LEAST_WORDS = 4
#: Sentences compared at a time, of either side; bounds a worker's memory.
_BLOCK = 512


class _WordTable(dict):
    """Numbers words; keeps a 64-bit hash of each."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.hashes)
        h = 0xCBF29CE484222325
        for b in word.encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
        self.hashes.append(h ^ (h >> 33))
        return at


_SENTENCES = "class string, sizes array<int>, words array<int>"


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it, of sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different sentences of each text, each with its different words."""
    for batch in by_size(batches):
        table = _WordTable()
        number = table.__getitem__
        ids: list[int] = []
        first: list[int] = []
        of_text = [0]
        for text in batch.column(1).to_pylist():
            for sentence in sentences(text or ""):
                ws = words(sentence)
                if ws:
                    first.append(len(ids))
                    ids.extend(map(number, ws))
            of_text.append(len(first))
        n = len(first)
        of = np.repeat(np.arange(n), np.diff(np.append(np.array(first, np.int64), len(ids))))
        word = np.array(table.hashes, np.uint64).astype(np.uint32).view(np.int32)[np.array(ids, np.int64)] if ids else np.zeros(0, np.int32)
        order = np.lexsort((word, of))
        of, word = of[order], word[order]
        new = _starts(of, word)
        of, word = of[new], word[new]
        text_of = np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))
        if n:
            whole = np.add.reduceat(mix(word.view(np.uint32).astype(np.uint64) + np.uint64(1)), np.flatnonzero(_starts(of)))
            order = np.lexsort((np.arange(n), whole, text_of))
            kept = np.zeros(n, bool)
            kept[order[_starts(text_of[order], whole[order])]] = True
        else:
            kept = np.zeros(0, bool)
        sizes = np.bincount(of, minlength=n)[kept].astype(np.int32)
        word = word[kept[of]]
        texts = np.searchsorted(text_of[kept], np.arange(len(of_text))).astype(np.int32)
        word_offsets = np.append(0, np.cumsum(sizes))[texts].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(texts, pa.array(sizes)), pa.ListArray.from_arrays(word_offsets, pa.array(word))],
            ["class", "sizes", "words"],
        )


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often words stand in the cells; ``words`` is the only column."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])


@dataclass
class _Variants:
    """Variants of the sentences of a batch of documents."""

    sentence: np.ndarray
    key: np.ndarray
    left_out: np.ndarray  # of a variant, bits that tell the word left out, else 0


def _variants(of: np.ndarray, word: np.ndarray, size: np.ndarray, counts: np.ndarray) -> _Variants:
    """``of``, sorted, is the sentence of each word, ``size`` the sentences' numbers of words."""
    n = counts[word & (CELLS - 1)]
    order = np.lexsort((word, n, of))
    of, word, n = of[order], word[order], n[order]
    mixed = mix(word.view(np.uint32).astype(np.uint64) + np.uint64(1))
    tiny = size < LEAST_WORDS
    whole = np.zeros(len(size), np.uint64)
    np.add.at(whole, of[tiny[of]], mixed[tiny[of]])
    out = [(np.flatnonzero(tiny), mix(whole[tiny] + np.uint64(0x7157)), np.zeros(int(tiny.sum()), np.int64))]
    # words that stand nowhere else can't be shared
    on = (n > 1) & ~tiny[of]
    of, mixed = of[on], mixed[on]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    of, mixed = of[rank < BITS], mixed[rank < BITS]
    for segments, fits in ((1, size <= ONE_SEGMENT), (2, size >= TWO_SEGMENTS)):
        o, m = of[fits[of]], mixed[fits[of]]
        if not len(o):
            continue
        segment = (m >> np.uint64(40) & np.uint64(segments - 1)).astype(np.int64)
        order = np.argsort(o * 2 + segment, kind="stable")
        o, m, segment = o[order], m[order], segment[order]
        new = _starts(o, segment)
        at, inverse = np.flatnonzero(new), np.cumsum(new) - 1
        total, bits = np.add.reduceat(m, at), np.diff(np.append(at, len(o)))
        salt = (segment[at] + 2 * segments).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out.append((o[at], mix(total + salt), np.zeros(len(at), np.int64)))
        more = bits[inverse] > 1
        out.append((o[more], mix(total[inverse] - m + salt[inverse])[more], (m >> np.uint64(12) & np.uint64(0xFFFF))[more].astype(np.int64) | 1))
    return _Variants(*(np.concatenate(c) for c in zip(*out, strict=True)))


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Document, size and words of all sentences of ``(..., sizes, words)``."""
    sizes, words_ = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    size, word = sizes.flatten().to_numpy(), words_.flatten().to_numpy()
    doc = np.repeat(np.arange(len(batch)), np.diff(sizes.offsets.to_numpy()))
    return doc, size, word, np.repeat(np.arange(len(size)), size)


def _sketcher(frequency, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, size, word, of = _unpack(batch)
            if len(size):
                v = _variants(of, word, size, frequency.value)
                order = np.lexsort((v.key, doc[v.sentence]))
                once = _starts(doc[v.sentence][order], v.key[order])
                yield sketch.partial(v.key[order][once], width)

    return run


_INDEX = "key bigint, doc bigint, info bigint"
_LOOKUPS = "key bigint, doc bigint, info bigint, place bigint"


def _postings(frequency, levels, recurring: float, lookups: bool):
    """Rows of ``(doc, sizes, words)`` as variants of their sentences, all or of those that are looked up.

    ``info`` packs 40 bits, of which each word of the sentence flips one, the sentence's size, and the bits
    of the word left out; ``place`` the sentence's number and how many links its document needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, size, word, of = _unpack(batch)
            if not len(size):
                continue
            v = _variants(of, word, size, frequency.value)
            level = sketch.estimate(levels.value, v.key)
            on = level >= sketch.TWICE
            sentence, key, left_out, level = v.sentence[on], v.key[on], v.left_out[on], level[on]
            mixed = mix(word.view(np.uint32).astype(np.uint64) + np.uint64(1))
            flips = np.zeros(len(size), np.uint64)
            np.bitwise_xor.at(flips, of, np.uint64(1) << (mixed % np.uint64(40)))
            info = (flips[sentence] << np.uint64(24) | np.minimum(size, 255).astype(np.uint64)[sentence] << np.uint64(16)).view(np.int64) | left_out
            ids = batch.column(0).to_numpy()
            columns = [key.view(np.int64), ids[doc[sentence]], info]
            if lookups:
                cost = np.bincount(sentence, weights=sketch.counts_of(level), minlength=len(size))
                order = np.lexsort((np.arange(len(size)), cost, doc))
                n = np.bincount(doc, minlength=len(batch))
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - (np.cumsum(n) - n)[doc[order]]
                recur = np.ceil(recurring * n - 1e-9).astype(np.int64)
                need = np.minimum(LINKS, recur)
                on = (rank < (n - recur + need)[doc])[sentence]
                columns = [c[on] for c in columns] + [(rank << 8 | need[doc])[sentence[on]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc", "info", "place"][: len(columns)])

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smaller share of sentences that recur in the other text, for each pair."""

    def matrix(of: np.ndarray, column: np.ndarray, height: int, width: int) -> np.ndarray:
        m = np.zeros((height, width), np.float32)
        m[of, column] = 1
        return m

    for batch in batches:
        shares = np.zeros(len(batch))
        for k in range(len(batch)):
            sa, wa, sb, wb = (batch.column(c)[k].values.to_numpy() for c in range(2, 6))
            a_first, b_first = np.append(0, np.cumsum(sa)), np.append(0, np.cumsum(sb))
            a_on, b_on = np.zeros(len(sa), bool), np.zeros(len(sb), bool)
            for i in range(0, len(sa), _BLOCK):
                size_a = sa[i : i + _BLOCK]
                part = wa[a_first[i] : a_first[min(i + _BLOCK, len(sa))]]
                vocabulary, at = np.unique(part, return_inverse=True)
                a = matrix(np.repeat(np.arange(len(size_a)), size_a), at, len(size_a), len(vocabulary))
                for j in range(0, len(sb), _BLOCK):
                    size_b = sb[j : j + _BLOCK]
                    part = wb[b_first[j] : b_first[min(j + _BLOCK, len(sb))]]
                    at = np.minimum(np.searchsorted(vocabulary, part), len(vocabulary) - 1)
                    same = vocabulary[at] == part
                    b = matrix(np.repeat(np.arange(len(size_b)), size_b)[same], at[same], len(size_b), len(vocabulary))
                    both, sizes = a @ b.T, size_a[:, None] + size_b[None, :]
                    alike = 2 * both >= SENTENCE_LIKENESS * sizes
                    alike &= (np.minimum(size_a[:, None], size_b[None, :]) >= LEAST_WORDS) | (2 * both == sizes)
                    a_on[i : i + _BLOCK] |= alike.any(axis=1)
                    b_on[j : j + _BLOCK] |= alike.any(axis=0)
            shares[k] = min(a_on.mean(), b_on.mean())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares)], ["a", "b", "share"])


def sentence_table(classes: DataFrame) -> DataFrame:
    """The sentences of ``classes(class, text)``: their sizes and words, one row for each text that has any."""
    return materialize(classes.select("class", "text").mapInArrow(_reader, _SENTENCES).where(F.size("sizes") > 0), "sentences")


def _joined(lookups: DataFrame, index: DataFrame) -> DataFrame:
    """Links ``(a, b, place)``: a sentence that document ``a`` looks up has a variant in common with one of ``b``."""
    looked, held = F.col("l.info"), F.col("i.info")

    def size(info: Column) -> Column:
        return F.shiftright(info, 16).bitwiseAND(F.lit(255))

    def left_out(info: Column) -> Column:
        return info.bitwiseAND(F.lit(0xFFFF))

    apart = F.bit_count(F.shiftrightunsigned(looked.bitwiseXOR(held), 24))
    near = (apart <= (1 - SENTENCE_LIKENESS) * (size(looked) + size(held))) | (F.greatest(size(looked), size(held)) == 255)
    # variants that leave out the same word meet as a whole too
    other = (left_out(looked) == 0) | (left_out(looked) != left_out(held))
    return (
        lookups.alias("l")
        .join(index.alias("i"), F.col("l.key") == F.col("i.key"))
        .where((F.col("l.doc") != F.col("i.doc")) & near & other)
        .select(F.col("l.doc").alias("a"), F.col("i.doc").alias("b"), "place")
    )


def near_duplicate_classes(docs: DataFrame, recurring: float = RECURRING) -> DataFrame:
    """Pairs ``(a, b, share)``, ``a < b``, of the texts of a ``sentence_table`` that are edited copies of each other.

    ``share`` is the smaller of the two shares of different sentences that recur in the other text.
    """
    context = docs.sparkSession.sparkContext
    frequency = np.zeros(CELLS, np.int64)
    for row in docs.select("words").mapInArrow(_counter, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        frequency[row["cell"]] = row["n"]
    frequency = context.broadcast(np.minimum(frequency, np.iinfo(np.int32).max).astype(np.int32))
    keyed = docs.withColumn("doc", F.xxhash64("class"))
    n_sentences = docs.agg(F.sum(F.size("sizes"))).first()[0] or 0
    width = sketch.width_for(n_sentences * (BITS + 2))
    levels = context.broadcast(sketch.merged(docs.select("sizes", "words").mapInArrow(_sketcher(frequency, width), sketch.PARTIALS), width))
    source = keyed.select("doc", "sizes", "words")
    index = source.mapInArrow(_postings(frequency, levels, recurring, False), _INDEX)
    lookups = source.mapInArrow(_postings(frequency, levels, recurring, True), _LOOKUPS)
    # each pair as seen from its lesser and its greater document; one shuffle for both steps
    sides = _joined(lookups, index).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("a") < F.col("b")).alias("lesser"), "place")
    sides = sides.repartition("x", "y").distinct()
    need = F.col("place").bitwiseAND(F.lit(255))
    lesser, greater = (F.count(F.when(on, 1)) >= F.max(F.when(on, need)) for on in (F.col("lesser"), ~F.col("lesser")))
    candidates = materialize(sides.groupBy("x", "y").agg((lesser & greater).alias("often")).where("often").select("x", "y"), "candidates")
    # only the documents of candidates are shuffled
    ids = candidates.select(F.explode(F.array("x", "y")).alias("doc")).distinct()
    needed = keyed.join(ids, "doc", "left_semi")
    a, b = (needed.select(F.col("doc").alias(k), F.col("class").alias(c), F.col("sizes").alias(f"{c}_sizes"), F.col("words").alias(f"{c}_words")) for k, c in (("x", "a"), ("y", "b")))
    with_texts = candidates.join(a, "x").join(b, "y")
    compared = with_texts.select("a", "b", "a_sizes", "a_words", "b_sizes", "b_words").mapInArrow(_recurring, "a string, b string, share double")
    return compared.where(F.col("share") >= recurring).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "share")


def linked_groups(links: DataFrame) -> DataFrame:
    """``(class, group)`` of all classes in ``links(a, b)``: the least class that is reached over links.

    Labels are handed to neighbours and shortened by the labels' own labels, so long chains take few rounds.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = edges.groupBy(F.col("a").alias("class")).agg(F.least(F.first("a"), F.min("b")).alias("group"))
    while True:
        labels = materialize(labels, "labels")
        offered = edges.join(labels, F.col("b") == F.col("class")).select(F.col("a").alias("class"), "group")
        nearer = labels.unionByName(offered).groupBy("class").agg(F.min("group").alias("near"))
        ends = labels.select(F.col("class").alias("near"), "group")
        shorter = nearer.join(ends, "near").select("class", "group")
        if shorter.join(labels.withColumnRenamed("group", "before"), "class").where("group <> before").isEmpty():
            return labels
        labels = shorter


class NearDuplicates:
    """Edited copies among ``documents(doc_key, normalized_text)``, one row for each document.

    Null keys and texts, and texts without a sentence (only tables, code or headings), have no copies. Repeated rows count once.
    """

    def __init__(self, documents: DataFrame, recurring: float = RECURRING):
        self.recurring = recurring
        texts = documents.select("doc_key", normalize(F.col("normalized_text")).alias("text")).dropna()
        rows = materialize(texts.withColumn("class", F.md5(F.col("text").cast("binary"))), "texts")
        self.members = rows.select("doc_key", "class").distinct()
        self.sentences = sentence_table(rows.select("class", "text").dropDuplicates(["class"]))
        self.links = materialize(near_duplicate_classes(self.sentences, recurring), "links")

    def pairs(self) -> DataFrame:
        """Distinct ``(doc_key_a, doc_key_b)``, ``doc_key_a < doc_key_b``, of all copies."""
        copies = self.members.groupBy("class").count().where("count > 1").join(self.sentences.select("class"), "class", "left_semi")
        same = copies.select(F.col("class").alias("a"), F.col("class").alias("b"))
        x, y = (self.members.select(F.col("class").alias(c), F.col("doc_key").alias(k)) for c, k in (("a", "x"), ("b", "y")))
        joined = self.links.select("a", "b").unionByName(same).join(x, "a").join(y, "b").where("x <> y")
        return joined.select(F.least("x", "y").alias("doc_key_a"), F.greatest("x", "y").alias("doc_key_b")).distinct()

    def groups(self) -> DataFrame:
        """Each document with its group, the class of its equal texts, and the number of other classes it is linked to.

        ``(doc_key, group, class, n_copies, n_links)``; a group is what is reached over links, under the name of its least class.
        """
        ends = self.links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
        ends = ends.join(linked_groups(self.links), "class")
        sizes = self.members.groupBy("class").agg(F.count("*").alias("n_copies"))
        return self.members.join(sizes, "class").join(ends, "class", "left").select(
            "doc_key", F.coalesce("group", "class").alias("group"), "class", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
        )
