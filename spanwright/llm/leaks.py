"""Held-out passages that stand, whole or in part, in the documents of a corpus.

The passages are indexed, block by block, with BM25 over shingles of three words. Every document is cut
into overlapping windows, each of them a query. As in block-max WAND a window is dropped as soon as an
upper bound of its scores lies under the least score that a leak can have: first the sum of each term's
best score over all passages, then the sum of its best score in each block of passages, and only the
window-block pairs left over are scored in full. A run of twice 30 words or more can be halved, and one
half has its share of edits at most; so a leak has a run of 30 to 59 words, which a window holds whole.
The least score of a passage is the least that any such run has after its worst edits, so pruning loses
no leak.
Whatever reaches the score is verified by edit distance between the words. Passages of one or two words
have no shingle and are looked up as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.words import words
from spanwright.session import materialize

SHINGLE = 3
RUN_WORDS = 30
#: Words of a run that may be changed, added or dropped: one in ten.
EDITS_PER_WORD = 0.1
#: Passages, and characters of them, in one pass over the corpus; the index of a pass is broadcast, so this bounds its size.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 20_000_000
#: Words searched at a time; bounds a worker's memory, not the result.
CHUNK_WORDS = 250_000
#: Passages that share an upper bound.
GROUP_ITEMS = 16
K1, B = 1.2, 0.75


class _Numbers(dict):
    """Numbers of the passages' words; any other word is -1."""

    def __missing__(self, word: str) -> int:
        return -1


class PassageIndex:
    """BM25 index of a bounded block of passages, with upper bounds of the scores."""

    def __init__(self, item_ids: list[int], texts: list[list[str]], run_words: int = RUN_WORDS):
        self.item_ids = np.array(item_ids, np.int64)
        self.word_id = _Numbers()
        number = self.word_id.setdefault
        self.texts = [np.array([number(w, len(self.word_id)) for w in ws], np.int64) for ws in texts]
        if len(self.word_id) >= 1 << 21:
            raise ValueError("too many different words for one block of passages")
        self.runs = [self._runs(len(t), run_words) for t in self.texts]
        self.short = {len_: self._short(len_) for len_ in range(1, SHINGLE)}
        n = len(self.texts)
        keys = [self.shingles(t) for t in self.texts]
        item = np.repeat(np.arange(n), [len(k) for k in keys])
        pair, tf = np.unique(np.stack([np.concatenate([*keys, np.zeros(0, np.int64)]), item]), axis=1, return_counts=True)
        self.terms, term = np.unique(pair[0], return_inverse=True)
        item = pair[1]
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        length = np.array([len(k) for k in keys], float)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(length.mean() if n else 1.0, 1e-9)))
        # postings of a term, and its best score: in all, and in each group of passages
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.posting_item, self.posting_weight = item, weight
        self.best = np.maximum.reduceat(weight, self.first[:-1]) if len(weight) else weight
        weights = self._weights(item, term, weight, n)
        self.least = np.array([min(self._least_score(k, w, r, e) for r, e in runs) if runs else np.inf for k, w, runs in zip(keys, weights, self.runs, strict=True)])
        group = item // GROUP_ITEMS
        at = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (group[1:] != group[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.group_first = np.searchsorted(term[at], np.arange(len(self.terms) + 1))
        self.group_of, self.group_best = group[at], np.maximum.reduceat(weight, at) if len(at) else weight
        groups = -(-n // GROUP_ITEMS)
        self.group_least = np.array([self.least[g * GROUP_ITEMS : (g + 1) * GROUP_ITEMS].min() for g in range(groups)])

    @staticmethod
    def shingles(ids: np.ndarray) -> np.ndarray:
        """Keys of the runs of three words; -1 where a word is unknown."""
        if len(ids) < SHINGLE:
            return np.zeros(0, np.int64)
        key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        return np.where((ids[:-2] < 0) | (ids[1:-1] < 0) | (ids[2:] < 0), -1, key)

    def _weights(self, item, term, weight, n):
        order = np.argsort(item, kind="stable")
        cuts = np.searchsorted(item[order], np.arange(1, n))
        return [dict(zip(self.terms[term[o]].tolist(), weight[o].tolist(), strict=True)) for o in np.split(order, cuts)] if n else []

    @staticmethod
    def _runs(words_: int, run_words: int) -> list[tuple[int, int]]:
        """Lengths of runs, each with the most edits it may have, of which every leak of so long a passage has one."""
        if words_ < run_words:
            return [(words_, int(words_ * EDITS_PER_WORD))] if words_ else []
        edits = [(n, int(n * EDITS_PER_WORD + 1e-9)) for n in range(run_words, min(2 * run_words, words_ + 1))]
        return [e for k, e in enumerate(edits) if k == 0 or e[1] > edits[k - 1][1]]

    def _short(self, len_: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the passages of so few words, in order, and the passages."""
        item = np.array([i for i, t in enumerate(self.texts) if len(t) == len_], np.int64)
        key = np.array([self._short_keys(self.texts[i], len_)[0] for i in item], np.int64)
        order = np.argsort(key, kind="stable")
        return key[order], item[order]

    @staticmethod
    def _short_keys(ids: np.ndarray, len_: int) -> np.ndarray:
        if len_ == 1:
            return ids
        return np.where((ids[:-1] < 0) | (ids[1:] < 0), -1, ids[:-1] << 21 | ids[1:])

    def short_leaks(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """``(passage, document)`` of the passages too short for a shingle."""
        found: set[tuple[int, int]] = set()
        for len_, (keys, items) in self.short.items():
            if not len(keys) or len(ids) < len_:
                continue
            at = self._short_keys(ids, len_)
            pos = np.flatnonzero(np.isin(at, keys))
            doc = np.searchsorted(starts, pos, "right") - 1
            inside = pos + len_ <= starts[doc + 1]
            for d, k in set(zip(doc[inside].tolist(), at[pos[inside]].tolist(), strict=True)):
                found |= {(i, d) for i in items[np.searchsorted(keys, k) : np.searchsorted(keys, k, "right")].tolist()}
        return sorted(found)

    @staticmethod
    def _least_score(keys: np.ndarray, weights: dict, run: int, edits: int) -> float:
        """The least score of any run of words of a passage, after the worst edits it may have."""
        if not len(keys):
            return np.inf
        size = max(1, run - SHINGLE + 1)
        lost = SHINGLE * int(edits)
        least = np.inf
        keys = keys.tolist()
        for start in range(max(1, len(keys) - size + 1)):
            kept = sorted(weights[k] for k in set(keys[start : start + size]))
            least = min(least, sum(kept[: max(0, len(kept) - lost)]))
        return least * 0.999

    def candidates(self, ids: np.ndarray, starts: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, window start, passage)`` of every window of words that reaches a passage's least score.

        ``ids`` are the word numbers of all documents in a row, ``starts`` where each begins.
        """
        none = np.zeros(0, np.int64)
        if not len(self.terms) or not len(ids):
            return none, none, none
        key = self.shingles(ids)
        at = np.flatnonzero(key >= 0)
        found = np.minimum(np.searchsorted(self.terms, key[at]), len(self.terms) - 1)
        hit = self.terms[found] == key[at]
        pos, term = at[hit], found[hit]
        doc = np.searchsorted(starts, pos, "right") - 1
        inside = pos + SHINGLE <= starts[doc + 1]  # not across two documents
        pos, term, doc = pos[inside], term[inside], doc[inside]
        # every position lies in the windows that cover it
        per = -(-window // stride)
        local = pos - starts[doc]
        last = local // stride
        number = last[:, None] - np.arange(per)
        fits = (number >= 0) & (local[:, None] + SHINGLE <= number * stride + window)
        wide = int((np.diff(starts).max() if len(starts) > 1 else 1) // stride + 2)
        slot = (doc[:, None] * wide + number)[fits]
        term = np.broadcast_to(term[:, None], fits.shape)[fits]
        # bound over all passages: at first with repeats, which needs no sorting
        on = np.bincount(slot, weights=self.best[term])[slot] >= self.least.min()
        slot, term = slot[on], term[on]
        slot_term = np.unique(slot * (len(self.terms) + 1) + term)
        slot, term = slot_term // (len(self.terms) + 1), slot_term % (len(self.terms) + 1)
        slot, term = self._prune(slot, term, self.best[term], self.least.min())
        if not len(slot):
            return none, none, none
        # bound over each group of passages
        row, take = _spread(self.group_first, term)
        cell = slot[row] * len(self.group_least) + self.group_of[take]
        kept, inverse = np.unique(cell, return_inverse=True)
        bound = np.bincount(inverse, weights=self.group_best[take])
        kept = kept[bound >= self.group_least[kept % len(self.group_least)]]
        live = np.unique(kept // len(self.group_least))
        on = np.isin(slot, live)
        slot, term = slot[on], term[on]
        # full scores in the groups left over
        row, take = _spread(self.first, term)
        item = self.posting_item[take]
        on = np.isin(slot[row] * len(self.group_least) + item // GROUP_ITEMS, kept)
        cell = slot[row][on] * len(self.item_ids) + item[on]
        pairs, inverse = np.unique(cell, return_inverse=True)
        score = np.bincount(inverse, weights=self.posting_weight[take][on], minlength=len(pairs))
        item = pairs % len(self.item_ids)
        on = score >= self.least[item]
        slot, item = pairs[on] // len(self.item_ids), item[on]
        return slot // wide, slot % wide * stride, item

    @staticmethod
    def _prune(slot, term, weight, least):
        if not len(slot):
            return slot, term
        edge = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        total = np.add.reduceat(weight, edge)
        on = np.repeat(total >= least, np.diff(np.append(edge, len(slot))))
        return slot[on], term[on]

    def leaked(self, item: int, segment: np.ndarray) -> bool:
        """Whether a run of the passage, or a longer one, stands in a segment of words with few enough edits."""
        passage, runs = self.texts[item], self.runs[item]
        n = len(segment)
        if not n or not runs:
            return False
        run, allowed = runs[0]
        starts = len(passage) - run + 1
        equal = passage[:, None] == segment[None, :]
        there = np.cumsum(np.append(0, equal.any(axis=1)))
        if all((there[r:] - there[:-r]).max() < r - e for r, e in runs):
            return False
        # without shifts: enough equal words along one diagonal
        p, s = np.nonzero(equal)
        shift = s - p + len(passage)
        for d in np.flatnonzero(np.bincount(shift) >= run - allowed):
            on = np.zeros(len(passage) + 1, np.int64)
            on[p[shift == d] + 1] = 1
            along = np.cumsum(on)
            if (along[run:] - along[:-run]).max() >= run - allowed:
                return True
        # with shifts: edit distance of every run to its best place, all runs that begin somewhere at once
        begin, differ = np.arange(starts), (~equal).astype(np.int32)
        most = np.floor((len(passage) - begin) * EDITS_PER_WORD + 1e-9)
        far = np.arange(n + 1, dtype=np.int32)
        row = np.zeros((starts, n + 1), np.int32)
        for k in range(len(passage)):
            on = begin + k < len(passage)
            begin, most, row = begin[on], most[on], row[on]
            new = np.empty_like(row)
            new[:, 0] = row[:, 0] + 1
            new[:, 1:] = np.minimum(row[:, :-1] + differ[begin + k], row[:, 1:] + 1)
            row = np.minimum.accumulate(new - far, axis=1) + far
            best = row.min(axis=1)
            if k + 1 >= run and best.min() <= int((k + 1) * EDITS_PER_WORD + 1e-9):
                return True
            on = best <= most
            if not on.any():
                return False
            begin, most, row = begin[on], most[on], row[on]
        return False


def _spread(first: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and posting positions of all postings of a column of terms."""
    size = first[term + 1] - first[term]
    ends = np.cumsum(size)
    row = np.repeat(np.arange(len(term)), size)
    return row, np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[term] - (ends - size), size)


def _verified(ix: PassageIndex, ids: np.ndarray, starts: np.ndarray, window: int, stride: int) -> list[tuple[int, int]]:
    """``(passage, document)`` of the leaks into documents whose words stand in ``ids`` from ``starts`` on."""
    doc, begin, item = ix.candidates(ids, starts, window, stride)
    order = np.lexsort((begin, item, doc))
    found: list[tuple[int, int]] = []
    for d, b, i in zip(doc[order].tolist(), begin[order].tolist(), item[order].tolist(), strict=True):
        if (not found or found[-1] != (i, d)) and ix.leaked(i, ids[starts[d] + b : min(starts[d] + b + window, starts[d + 1])]):
            found.append((i, d))
    return found + ix.short_leaks(ids, starts)


def _searcher(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: PassageIndex = index.value
        stride = max((r + e for runs in ix.runs for r, e in runs), default=0) + 1
        window = 2 * stride  # a run, with words added to it, always lies in one window
        known = ix.word_id.__getitem__
        for batch in batches:
            docs, texts = batch.column(0).cast(pa.int64()), batch.column(1).to_pylist()
            found: list[tuple[int, int]] = []
            ids: list[int] = []
            starts, first = [0], 0
            for k, text in enumerate(texts):
                if text:
                    ids.extend(map(known, words(text)))
                starts.append(len(ids))
                if len(ids) >= CHUNK_WORDS or k == len(texts) - 1:
                    found += [(i, first + d) for i, d in _verified(ix, np.array(ids, np.int64), np.array(starts, np.int64), window, stride)]
                    ids, starts, first = [], [0], k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ix.item_ids[[i for i, _ in found]], pa.int64()), docs.take(pa.array([d for _, d in found], pa.int64()))],
                ["item_id", "doc_id"],
            )

    return run


def passage_leaks(
    documents: DataFrame, passages: DataFrame, run_words: int = RUN_WORDS, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """Distinct ``(item_id, doc_id)``: document ``doc_id`` holds passage ``item_id``, or ``run_words`` consecutive words of it.

    Words are compared without case, accents, markup, list marks and punctuation; up to one word in ten may
    be changed, added or dropped, also where a longer run has more edits in these words. A passage of fewer
    words has to be there whole. Passages without id or
    words, and documents without id or text, match nothing; rows delivered twice count once. The corpus is
    scanned once for every ``block_items`` passages, or ``BLOCK_CHARS`` of them, the stated query set, and
    never shuffled.
    """
    spark: SparkSession = documents.sparkSession
    held = passages.select("item_id", "text").dropna().distinct()
    n, chars = held.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // BLOCK_CHARS))
    parts = []
    for k in range(blocks):
        rows = held.where(f"pmod(xxhash64(item_id), {blocks}) = {k}").orderBy("item_id", "text").collect()
        texts = [(r["item_id"], w) for r in rows if (w := words(r["text"]))]
        index = spark.sparkContext.broadcast(PassageIndex([i for i, _ in texts], [w for _, w in texts], run_words))
        part = documents.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_searcher(index), "item_id bigint, doc_id bigint").distinct()
        if blocks > 1:  # one index at a time
            part = materialize(part, "leaks")
            index.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)
