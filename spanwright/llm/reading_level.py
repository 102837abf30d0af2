"""Reading levels by harmonic propagation over a graph of documents and words.

Each document is linked to nodes: its words, each with the length class of the sentence it stands in (a
word of a short sentence and the same word of a long one are two nodes), and the shapes of its sentences
(sentence length by mean word length). A node's level is the weighted mean of its documents' levels, a
document's the weighted mean of its nodes'. Graded documents are clamped to their grades, and the means are
iterated until they hardly move. Nodes belong to languages, but for shapes that all languages share, from which
rarely graded ones learn; a language with enough grades of its own has its own cuts between the bands. Nodes are hashed into a
table whose size follows the amount of text: an iteration broadcasts that table, passes over the stored links
once, and adds up partial sums of the nodes, slice by slice, one partial after the other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import canonical_label
from spanwright.llm.batches import by_size
from spanwright.llm.prose import sentences
from spanwright.session import materialize

#: Nodes of the table, at least and at most; its two float32 columns are what a round broadcasts and collects (32 MB at most).
LEAST_NODES, MOST_NODES = 1 << 18, 1 << 22
#: Rounds end when nodes move less than this on average, by weight, or after so many.
STILL, MOST_ROUNDS = 0.002, 12
MIN_WORDS = 50
BANDS = {"easy": -1.0, "mid": 0.0, "hard": 1.0}
#: Weight of the shapes of a document's sentences against that of its words.
SHAPE_WEIGHT = 2.5
#: Graded documents that are used, at most: a bounded sample by hash where there are more.
MOST_GRADES = 200_000
#: Grades of each band that a language needs to have cuts of its own.
OWN_GRADES = 5
#: Steps of the scale in which texts are counted.
STEPS = 400
_SLICE = 1 << 14
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 500_000
# Frequent words of some languages.
FREQUENT_WORDS = {
    "de": "der die das und ist nicht ein eine zu den mit auf von im dem wird sich oder auch bei nach für wenn sind des",
    "en": "the of and to is in a that it for on with as are be by this or at when not from its an has",
    "es": "el la los las de que y en un una es por con para se del al no su como o más cuando está lo",
    "fr": "le la les des et est un une dans que pour par sur il du au ne pas avec ce se qui sont ou en",
    "it": "il lo la gli le e di che è un una per con non si del della nel al da sono come in quando i",
    "pt": "o a os as e de que é um uma para com não se do da em no na por ao dos mais quando ou",
}
_LANGUAGES = sorted(FREQUENT_WORDS)


def _language_of_words() -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {}
    for k, name in enumerate(_LANGUAGES):
        for word in FREQUENT_WORDS[name].split():
            out[word] = (*out.get(word, ()), k)
    return out


class _Language:
    """Tells the language of a text by its frequent words, or else by its label."""

    def __init__(self):
        self.of_word = _language_of_words()

    def __call__(self, words: list[str], label: str | None) -> str:
        hits = [0] * len(_LANGUAGES)
        for languages, n in Counter(filter(None, map(self.of_word.get, words))).items():
            for k in languages:
                hits[k] += n
        best = max(range(len(hits)), key=hits.__getitem__)
        return _LANGUAGES[best] if hits[best] * 20 >= len(words) and hits[best] else label or "und"


def _length_class(n_words: int) -> int:
    return 0 if n_words <= 10 else 1 if n_words <= 21 else 2


def _shape_names(language: str, n_words: int, mean_length: float) -> list[str]:
    """A sentence's coarse shape in its language, and its fine and coarse shape for all languages, from which rarely graded ones learn."""
    coarse = f"coarse {min(n_words // 7, 3)} {min(int(mean_length / 2.2), 3)}"
    return [f"{language} {coarse}", f"shape {min(n_words // 3, 20)} {min(int(2 * mean_length), 30)}", coarse, coarse]


class _Nodes(dict):
    """Node numbers of the words of one language and one class of sentences."""

    def __init__(self, language: str, length_class: int, nodes: int):
        super().__init__()
        self.name, self.mask = f"{language} {length_class} ", nodes - 1

    def __missing__(self, word: str) -> int:
        node = self[word] = zlib.crc32((self.name + word).encode("utf-8", "surrogatepass")) & self.mask
        return node


_LINKS = "doc_id bigint, n_words int, language string, grade double, nodes array<int>, weights array<float>"


def _linker(n_nodes: int, grades):
    """Links of ``(doc_id, text, label)``; ``grades`` are sorted ids and their grades."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language_of = _Language()
        tables: dict[tuple[str, int], _Nodes] = {}
        shapes: dict[tuple[str, int, float], list[int]] = {}
        graded, grade = grades.value
        for batch in by_size(batches):
            nodes: list[int] = []
            shape_nodes: list[int] = []
            words_of, shapes_of, totals, languages = [0], [0], [], []
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = [ws for s in sentences(text) if (ws := _WORD.findall(s.lower()))] if text else []
                language = language_of([w for ws in parts for w in ws], label)
                for ws in parts:
                    n = len(ws)
                    key = (language, _length_class(n))
                    table = tables.get(key)
                    if table is None:
                        table = tables[key] = _Nodes(*key, n_nodes)
                    nodes.extend(map(table.__getitem__, ws))
                    shape = (language, n, sum(map(len, ws)) / n)
                    at = shapes.get(shape)
                    if at is None:
                        at = shapes[shape] = [zlib.crc32(name.encode()) & (n_nodes - 1) for name in _shape_names(*shape)]
                    # long sentences count for as many words as they have
                    shape_nodes.extend(at * n)
                words_of.append(len(nodes))
                shapes_of.append(len(shape_nodes))
                totals.append(sum(map(len, parts)))
                languages.append(language)
            for table in (*tables.values(), shapes):
                if len(table) > _CACHE:
                    table.clear()
            n = len(totals)
            doc = np.concatenate([np.repeat(np.arange(n), np.diff(words_of)), np.repeat(np.arange(n), np.diff(shapes_of))])
            node = np.concatenate([np.array(nodes, np.int64), np.array(shape_nodes, np.int64)])
            is_shape = np.repeat([0, 1], [len(nodes), len(shape_nodes)])
            cell, times = np.unique((doc << 24 | node) << 1 | is_shape, return_counts=True)
            doc, node, is_shape = cell >> 25, (cell >> 1) & (n_nodes - 1), cell & 1
            # a word counts by the root of its frequency, a shape by its share of the words
            share = times / np.maximum(np.array(totals), 1)[doc]
            spread = np.bincount(doc[is_shape == 0], weights=np.sqrt(times[is_shape == 0]), minlength=n)
            weight = np.where(is_shape, SHAPE_WEIGHT / 4 * share * spread[doc], np.sqrt(times))
            offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            ids = batch.column(0).cast(pa.int64())
            filled = ids.fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(graded, filled), max(len(graded) - 1, 0))
            known = (graded[at] == filled) & ids.is_valid().to_numpy(zero_copy_only=False) if len(graded) else np.zeros(n, bool)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.array(totals, np.int32)),
                    pa.array(languages, pa.string()),
                    pa.array(grade[at] if len(graded) else np.zeros(n), pa.float64(), mask=~known),
                    pa.ListArray.from_arrays(offsets, pa.array(node.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(weight.astype(np.float32))),
                ],
                ["doc_id", "n_words", "language", "grade", "nodes", "weights"],
            )

    return run


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of ``(..., grade, nodes, weights)``: node, weight and document of each link, and the documents' grades."""
    grade, nodes, weights = batch.columns[-3:]
    doc = np.repeat(np.arange(len(batch)), np.diff(nodes.offsets.to_numpy()))
    return nodes.flatten().to_numpy(), weights.flatten().to_numpy().astype(np.float64), doc, grade.to_numpy(zero_copy_only=False).astype(np.float64)


def _mean(doc: np.ndarray, weight: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=weight * value, minlength=n) / np.maximum(np.bincount(doc, weights=weight, minlength=n), 1e-9)


def _summer(state, n_nodes: int):
    """Partial sums of the nodes by slice: of weights times levels, and of weights. Without a state, of graded documents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = None if state is None else state.value
        sums = np.zeros((2, n_nodes))
        for batch in batches:
            node, weight, doc, grade = _unpack(batch)
            if level is None:
                on = ~np.isnan(grade)[doc]
                node, weight, doc = node[on], weight[on], doc[on]
                value = grade
            else:
                value = np.where(np.isnan(grade), _mean(doc, weight, level[node], len(batch)), grade)
            sums[0] += np.bincount(node, weights=weight * value[doc], minlength=n_nodes)
            sums[1] += np.bincount(node, weights=weight, minlength=n_nodes)
        parts = np.split(sums.astype(np.float32), n_nodes // _SLICE, axis=1)
        on = [k for k, p in enumerate(parts) if p[1].any()]
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in on], pa.binary())], ["slice", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if number not in total:
                total[number] = np.zeros(2 * _SLICE)
            total[number] += np.frombuffer(zlib.decompress(part), np.float32)
    for number, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([sums.astype(np.float32).tobytes()], pa.binary())], ["slice", "sums"])


def _node_sums(links: DataFrame, state, n_nodes: int) -> np.ndarray:
    """One harmonic step: sums of weights times levels, and of weights, of all nodes. Collects one table of bounded size."""
    partials = links.select("grade", "nodes", "weights").mapInArrow(_summer(state, n_nodes), "slice int, sums binary")
    out = np.zeros((2, n_nodes), np.float32)
    for row in partials.repartition("slice").mapInArrow(_add, "slice int, sums binary").toLocalIterator():
        out[:, row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["sums"], np.float32).reshape(2, -1)
    return out


def _levels(sums: np.ndarray) -> np.ndarray:
    # nodes that nothing is known of yet, at first, lie in the middle
    return np.where(sums[1] > 0, sums[0] / np.maximum(sums[1], 1e-9), 0.0).astype(np.float32)


def node_sums(links: DataFrame, n_nodes: int) -> np.ndarray:
    """The nodes' sums once the levels hardly move any more."""
    context = links.sparkSession.sparkContext
    sums = _node_sums(links, None, n_nodes)
    for _ in range(MOST_ROUNDS - 1):
        level = _levels(sums)
        state = context.broadcast(level)
        sums = _node_sums(links, state, n_nodes)
        state.destroy()
        if (np.abs(_levels(sums) - level) * sums[1]).sum() <= STILL * sums[1].sum():
            break
    return sums


_SCORED = "doc_id bigint, n_words int, language string, level double, grade double"


def _scorer(state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = state.value
        for batch in batches:
            node, weight, doc, grade = _unpack(batch)
            # a graded document's own part is taken out of its nodes
            own = np.where(np.isnan(grade)[doc], 0.0, weight)
            total = sums[1][node] - own
            known = total > 1e-4 * weight
            value = (sums[0][node] - own * np.nan_to_num(grade)[doc]) / np.where(known, total, 1.0)
            level = _mean(doc[known], weight[known], value[known], len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.clip(level, -1, 1)), batch.column(3)], ["doc_id", "n_words", "language", "level", "grade"])

    return run


def _middle(values: np.ndarray, counts: np.ndarray) -> float:
    """Median of values that count several times."""
    order = np.argsort(values)
    return float(values[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)])


def cut_points(level: np.ndarray, grade: np.ndarray, density: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """Levels below which texts are easy, and above which they are hard.

    A cut lies between the medians of the two bands. Readers err, so cuts under which hardly more graded
    texts go wrong than under the best are taken to be as good; of these the one is chosen at which the
    fewest texts lie, graded or not: ``density`` counts texts by level, in equal steps from -1 to 1.
    Without easy (hard) grades nothing is easy (hard). A graded text counts ``counts`` times, once by default.
    """
    counts = np.ones(len(level)) if counts is None else counts
    edges = np.linspace(-1, 1, len(density) + 1)[1:-1]
    kernel = np.hanning(2 * (len(density) // 100) + 3)
    near = np.convolve(density, kernel / kernel.sum(), "same")
    near = (near[1:] + near[:-1]) / 2
    band = np.where(grade <= -0.5, -1, np.where(grade >= 0.5, 1, 0))
    start = _middle(level[band == 0], counts[band == 0]) if (band == 0).any() else _middle(level, counts)

    def cut(side: int) -> float:
        end = band == side
        if not end.any():
            return np.inf * side
        x, at = edges * side, level * side
        wrong = ((end & (at < x[:, None])) * counts).sum(axis=1) + ((~end & (at >= x[:, None])) * counts).sum(axis=1)
        median = _middle(level[end], counts[end])
        between = (x > start * side) & (x < median * side)
        if not between.any():
            return float((start + median) / 2)
        fine = between & (wrong <= wrong[between].min() + max(1, 0.02 * counts[end].sum()))
        least = np.flatnonzero(fine & (near <= near[fine].min() + 1e-9))
        return float(edges[least[len(least) // 2]])

    return cut(-1), cut(1)


def _cuts(scored: DataFrame, min_words: int) -> dict[str | None, tuple[float, float]]:
    """The cuts of all languages with enough grades, and under None those of all texts together. Collects counts by steps of the scale."""
    step = F.greatest(F.least(F.floor((F.col("level") + 1) / 2 * STEPS), F.lit(STEPS - 1)), F.lit(0)).cast("int")
    rows = scored.where(F.col("n_words") >= min_words).groupBy("language", step.alias("step"), F.round("grade", 2).alias("grade")).count().toPandas()
    cuts: dict[str | None, tuple[float, float]] = {}
    for name in [None, *sorted(set(rows["language"]))]:
        part = rows if name is None else rows[rows["language"] == name]
        graded = part[part["grade"].notna()]
        if name is None:
            if not len(graded):
                return {None: (-np.inf, np.inf)}
        elif min(graded["count"][on].sum() for on in (graded["grade"] <= -0.5, graded["grade"] >= 0.5, graded["grade"].abs() < 0.5)) < OWN_GRADES:
            continue
        density = np.bincount(part["step"], weights=part["count"], minlength=STEPS)
        middle = (graded["step"].to_numpy() + 0.5) * 2 / STEPS - 1
        cuts[name] = cut_points(middle, graded["grade"].to_numpy(float), density, graded["count"].to_numpy(float))
    return cuts


def grade_table(grades: DataFrame, most: int = MOST_GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and mean grades of read documents, -1 easy to 1 hard; unknown bands and null ids are left out."""
    scale = F.create_map(*(F.lit(x) for pair in BANDS.items() for x in pair))
    read = grades.select("doc_id", scale[canonical_label(F.col("band"))].alias("g")).dropna()
    means = read.groupBy("doc_id").agg(F.avg("g").alias("g")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas()
    means = means.sort_values("doc_id")
    return means["doc_id"].to_numpy(np.int64), means["g"].to_numpy(np.float64)


def _n_nodes(documents: DataFrame) -> int:
    """Nodes by the amount of text: words grow with its root, roughly, and some share a node beyond ``MOST_NODES``."""
    chars = documents.agg(F.sum(F.char_length("text"))).first()[0] or 0
    nodes = LEAST_NODES
    while nodes < min(MOST_NODES, 24 * chars**0.5):
        nodes *= 2
    return nodes


def reading_levels(documents: DataFrame, grades: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, n_words, language, level, band)`` of every document.

    ``documents(doc_id, text)``, with ``lang`` or without, ``grades(doc_id, band)``. ``level`` runs from -1,
    easy, to 1, hard; it comes from the words and sentences alone, not from the document's own grade.
    ``band`` is easy, mid or hard by cuts that part the graded texts of the language best, or those of all
    languages where there are fewer than ``OWN_GRADES`` of a band; it is null with fewer than ``min_words``
    words of running prose; null and empty texts have none. The language is told by frequent words, else
    by ``lang``, else it is und. Documents that readers disagree on count with their mean. Up to
    ``MOST_GRADES`` graded documents are clamped (a bounded sample by hash beyond). Without any grade all
    levels are 0 and all bands mid. Each input row is a document of its own.
    """
    context = documents.sparkSession.sparkContext
    label = F.lower(F.regexp_extract(F.col("lang"), r"^\s*([A-Za-z]{2})(?:[-_].*)?\s*$", 1)) if "lang" in documents.columns else F.lit(None).cast("string")
    n_nodes = _n_nodes(documents)
    rows = documents.select("doc_id", "text", label.alias("label"))
    links = materialize(rows.mapInArrow(_linker(n_nodes, context.broadcast(grade_table(grades))), _LINKS), "links")
    sums = context.broadcast(node_sums(links, n_nodes))
    scored = materialize(links.mapInArrow(_scorer(sums), _SCORED), "levels")
    cuts = _cuts(scored, min_words)
    easy, hard = (reduce(lambda rest, name: F.when(F.col("language") == name, float(cuts[name][side])).otherwise(rest), sorted(filter(None, cuts)), F.lit(float(cuts[None][side]))) for side in (0, 1))
    band = F.when(F.col("level") < easy, "easy").when(F.col("level") > hard, "hard").otherwise("mid")
    return scored.select("doc_id", "n_words", "language", "level", F.when(F.col("n_words") >= min_words, band).alias("band"))
