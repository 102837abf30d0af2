"""Questions of evaluation splits that stand, exactly or almost, among training candidates.

A question is the set of its shingles, two words each, weighted by their rarity. A candidate asks a test's
question if what they have in common is enough of the weight of either. So they have a shingle in common
among the heaviest of each (prefix filter): the heaviest shingles of the evaluation questions are indexed and
probed with the heaviest of the candidates, along with the numbers and codes, which must be the same, and a
name of the test, whose letters the candidate must have. A pair that meets passes filters on its total weights and on the places of its first common shingle, and is verified
on the whole questions. The filters are exact for the measure. Rarity is told by a count-min sketch of both
sides, so ordering the shingles takes no shuffle, and a sketch of the evaluation side keeps the probes that
can't meet anything out of the join.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm import sketch
from spanwright.session import materialize

SHINGLE = 2
#: Share of the weight of a test's shingles, and of a candidate's, that both have in common.
CONTAINED, CARRIED = 0.45, 0.35
#: Share of a test's words, weighted by rarity, that a candidate must hold.
WORDS_HELD = 0.6
# Words of which a question asks the opposite with the other.
OPPOSITES = (
    ("before", "after"), ("above", "below"), ("first", "last"), ("minimum", "maximum"), ("least", "most"), ("enable", "disable"),
    ("enabled", "disabled"), ("open", "close"), ("opens", "closes"), ("start", "stop"), ("starts", "stops"), ("on", "off"), ("with", "without"),
    ("lock", "unlock"), ("locks", "unlocks"), ("increase", "decrease"), ("raise", "lower"), ("allowed", "forbidden"),
)
_SWAP_LETTERS = 6

_WORD = re.compile(r"[\w=]+(?:[.:][\w=]+)*")
_EXACT = re.compile(r"[\d_=:.]")
_QUESTION = "qid bigint, words array<string>, exact bigint, names array<string>, shingles array<bigint>, letters array<bigint>"


def _hash(words: tuple[str, ...]) -> int:
    return int.from_bytes(blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Hashes(dict):
    def __missing__(self, words: tuple[str, ...]) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[words] = _hash(words)
        return h


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        columns: list[list] = [[], [], [], [], [], []]
        for qid, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spelled = _WORD.findall(q)
            if not spelled:
                continue
            lowered = [w.lower() for w in spelled]
            one_case = q in (q.lower(), q.upper())
            names = None if one_case else sorted({w.lower() for w in spelled[1:] if w[0].isupper() and not _EXACT.search(w)})
            shingles = {hashes[s] for s in zip(*(lowered[k:] for k in range(SHINGLE)), strict=False)} or {hashes[tuple(lowered)]}
            exact = _hash(tuple(sorted({w for w in lowered if _EXACT.search(w)})))
            words = sorted(set(lowered))
            letters = [hashes["letters", "".join(sorted(w))] for w in words]
            for column, value in zip(columns, (qid, words, exact, names, sorted(shingles), letters), strict=True):
                column.append(value)
        types = (pa.int64(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["qid", "words", "exact", "names", "shingles", "letters"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Question texts in NFC, without outer and repeated white space."""
    for batch in batches:
        texts = [None if t is None else " ".join(unicodedata.normalize("NFC", t).split()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "q"])


def questions(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, qid)`` and distinct questions of a table with a ``question``; null ids, null and empty questions are left out.

    ``exact`` is a hash of the words with digits or signs, ``names`` are words with a capital that don't begin
    the question; null where the question is written in one case throughout, so that capitals say nothing.
    ``letters`` are hashes of the words' letters in any order.
    """
    rows = df.select(F.col(key).cast("string").alias("id"), "question").dropna().mapInArrow(_plain, "id string, q string").where("q <> ''")
    rows = materialize(rows.withColumn("qid", F.xxhash64("q")), f"questions-{key}")
    return rows.select("id", "qid"), materialize(rows.select("qid", "q").dropDuplicates(["qid"]).mapInArrow(_parser, _QUESTION), f"shingles-{key}")


def _sketcher(width: int, first: int):
    """Partial sketches of the shingles; slices are numbered from ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = sketch.partial(batch.column(0).flatten().to_numpy(), width)
            number = pa.array(part.column(0).to_numpy() + np.int32(first), pa.int32())
            yield pa.RecordBatch.from_arrays([number, *part.columns[1:]], part.schema.names)

    return run


def _weights(levels: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Weights of shingles or words by how many of ``n`` questions have them."""
    return np.log((n + 1) / np.clip(sketch.counts_of(sketch.estimate(levels, keys)), 1, n)) ** 2


_PREFIX = "shingle bigint, exact bigint, qid bigint, before double, total double"


def _name(t_words: list[str], t_names: list[str] | None, weight: np.ndarray) -> str:
    """The rarest of a test's names, or of its words where it has no names."""
    names = set(t_names or t_words)
    return max(zip(weight, t_words, strict=True), key=lambda x: (x[1] in names, x[0]))[1]


def _prefix(levels, other, n: int, least: float, word_levels=None):
    """Of questions ``(qid, exact, shingles, letters)`` the heaviest shingles, of which one must be shared, as far as ``other`` knows them.

    ``before`` is the weight of a question's heavier shingles, ``total`` that of all. With ``word_levels`` the
    questions are tests ``(..., letters, words, names)``, and of their letters only those of a name go with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingle = batch.column(2).flatten().to_numpy()
            of = np.repeat(np.arange(len(batch)), np.diff(batch.column(2).offsets.to_numpy()))
            weight = _weights(levels.value, shingle, n)
            order = np.lexsort((shingle, -weight, of))
            shingle, weight = shingle[order], weight[order]
            total = np.bincount(of, weights=weight, minlength=len(batch))
            sums = np.cumsum(weight) - weight
            first = np.searchsorted(of, np.arange(len(batch)))
            before = sums - sums[np.minimum(first, max(len(of) - 1, 0))][of] if len(of) else sums
            on = before <= (1 - least) * total[of] + 1e-6
            if other is not None:
                on &= sketch.estimate(other.value, shingle) > 0
            at = pa.array(of[on])
            letters = batch.column(3)
            if word_levels is not None:
                names = [_name(w, x, _word_weights(word_levels.value, w, n)) for w, x in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
                letters = pa.array([_hash(("letters", "".join(sorted(w)))) for w in names], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle[on]), batch.column(1).take(at), batch.column(0).take(at), pa.array(before[on]), pa.array(total[of[on]]), letters.take(at)],
                ["shingle", "exact", "qid", "before", "total", "letters"],
            )

    return run


def _word_counts(word_levels: np.ndarray, words: list[str]) -> np.ndarray:
    return sketch.counts_of(sketch.estimate(word_levels, np.array([_hash(("word", w)) for w in words], np.int64)))


def _word_weights(word_levels: np.ndarray, words: list[str], n: int) -> np.ndarray:
    return np.log((n + 1) / np.clip(_word_counts(word_levels, words), 1, n)) ** 2


def _swapped(a: str, b: str) -> bool:
    """Whether two neighbouring letters have changed places."""
    at = [k for k in range(len(a)) if a[k] != b[k]] if len(a) == len(b) else []
    return len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]


def _commoner(levels, n: int):
    """Pairs of ``(t, c, needed, t_shingles, c_shingles)`` that have the needed weight in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column("t_shingles"), batch.column("c_shingles")):
                shingle = column.flatten().to_numpy()
                of = np.repeat(np.arange(len(batch)), np.diff(column.offsets.to_numpy()))
                sides.append((of, shingle, sketch.mix(shingle.view(np.uint64) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
            (of, shingle, t_key), (*_, c_key) = sides
            shared = np.isin(t_key, c_key)
            common = np.bincount(of[shared], weights=_weights(levels.value, shingle[shared], n), minlength=len(batch))
            on = pa.array(common >= batch.column("needed").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("c")], ["t", "c"]).filter(on)

    return run


def _verifier(word_levels, n: int):
    """Pairs of ``(t, t_words, t_names, c, c_words)`` that ask the same, if they have enough shingles in common."""

    def same(t_words, t_names, c_words) -> bool:
        t, c = set(t_words), set(c_words)
        weight = _word_weights(word_levels.value, t_words, n)
        if weight[[w in c for w in t_words]].sum() < WORDS_HELD * weight.sum() - 1e-6:
            return False
        if any((x in t and y in c and y not in t and x not in c) or (y in t and x in c and x not in t and y not in c) for x, y in OPPOSITES):
            return False
        names = t_names or [_name(t_words, None, weight)]
        # a longer name with two letters swapped counts if the word stands in no other question; short words become others
        return all(m in c or (len(m) >= _SWAP_LETTERS and any(_swapped(m, w) and _word_counts(word_levels.value, [w])[0] < 1.5 for w in c - t)) for m in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("t_words", "t_names", "c_words")]
            on = pa.array([same(*row) for row in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("c")], ["t", "c"]).filter(on)

    return run


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words, in the shape of shingles."""
    hashes = _Hashes()
    for batch in batches:
        words = batch.column(0)
        flat = pa.array([hashes[("word", w)] for w in words.flatten().to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(words.offsets, flat)], ["shingles"])


def question_overlaps(
    tests: DataFrame, candidates: DataFrame, contained: float = CONTAINED, carried: float = CARRIED
) -> DataFrame:
    """Distinct ``(candidate_id, test_id)`` of ``candidates(candidate_id, question)`` that ask what a test of ``tests(test_id, question)`` asks.

    Differences of case, white space, punctuation, the order of clauses, articles, added phrases and a few
    other words don't matter. Numbers, codes, versions and settings must be the same set; names of the test
    must all be in the candidate (where a test's capitals say nothing, or there are none, its rarest word is its name), and
    neither may hold the opposite of a word of the other.
    Null or empty questions and null ids match nothing; repeated rows count once; equal questions are
    compared once, as one.
    """
    context = tests.sparkSession.sparkContext
    context = tests.sparkSession.sparkContext
    test_rows, t = questions(tests, "test_id")
    candidate_rows, c = questions(candidates, "candidate_id")
    counted = t.select(F.lit(1).alias("t"), F.size("shingles").alias("n")).unionByName(c.select(F.lit(0).alias("t"), F.size("shingles").alias("n")))
    n, shingles = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = sketch.width_for(shingles)
    slices = sketch.DEPTH * width // sketch.SLICE
    both = t.select("shingles").unionByName(c.select("shingles"))
    words = t.select("words").unionByName(c.select("words")).mapInArrow(_word_hashes, "shingles array<bigint>")
    partials = (
        both.mapInArrow(_sketcher(width, 0), sketch.PARTIALS)
        .unionByName(t.select("shingles").mapInArrow(_sketcher(width, slices), sketch.PARTIALS))
        .unionByName(words.mapInArrow(_sketcher(width, 2 * slices), sketch.PARTIALS))
    )
    levels, of_tests, of_words = (context.broadcast(x) for x in np.split(sketch.merged(partials, 3 * width), 3))
    index = t.select("qid", "exact", "shingles", "letters", "words", "names").mapInArrow(_prefix(levels, None, n, contained, of_words), _PREFIX + ", letters bigint")
    probe = c.select("qid", "exact", "shingles", "letters").mapInArrow(_prefix(levels, of_tests, n, carried), _PREFIX + ", letters array<bigint>")

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select("shingle", "exact", *(F.col(x).alias(f"{side}_{x}") for x in ("qid", "before", "total", "letters")))

    # a name of the test stands in the candidate, if with letters swapped
    holds = F.array_contains("c_letters", F.col("t_letters"))
    # the least weight that both must have in common; shingles before the first common one aren't in common
    needed = F.greatest(contained * F.col("t_total"), carried * F.col("c_total")) - 1e-6
    met = named(index, "t").join(named(probe, "c"), ["shingle", "exact"]).where(holds & (F.least("t_total", "c_total") >= needed))
    first = met.groupBy(F.col("t_qid").alias("t"), F.col("c_qid").alias("c"), "t_total", "c_total").agg(F.min("t_before").alias("i"), F.min("c_before").alias("j"))
    pairs = first.where(F.least(F.col("t_total") - F.col("i"), F.col("c_total") - F.col("j")) >= needed).select("t", "c", needed.alias("needed"))

    def whole(df: DataFrame, side: str, *columns: str) -> DataFrame:
        return df.select(F.col("qid").alias(side), *(F.col(x).alias(f"{side}_{x}") for x in columns))

    in_common = pairs.join(whole(t, "t", "shingles"), "t").join(whole(c, "c", "shingles"), "c").mapInArrow(_commoner(levels, n), "t bigint, c bigint")
    joined = materialize(in_common, "questions-in-common").join(whole(t, "t", "words", "names"), "t").join(whole(c, "c", "words"), "c")
    verified = joined.mapInArrow(_verifier(of_words, n), "t bigint, c bigint")

    def ids(df: DataFrame, side: str, key: str) -> DataFrame:
        return df.select(F.col("qid").alias(side), F.col("id").alias(key))

    return verified.join(ids(test_rows, "t", "test_id"), "t").join(ids(candidate_rows, "c", "candidate_id"), "c").select("candidate_id", "test_id").distinct()
