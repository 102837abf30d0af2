"""Fill containers of a fixed number of tokens with texts, neighbours in wording together.

Texts are measured once, in Arrow batches. A text longer than a container is cut into whole containers
and a rest; every other text stays in one piece. Each item gets a key from its wording: the term that a hash,
weighted by the terms' rarity, draws from its terms, so items alike in wording mostly draw the same. Items
are ranged by these keys and go by in shards of a bounded number of items, neighbours in wording together,
however many share a key; a shard builds a BM25 inverted index of its items. The largest unused item seeds a
container, the index returns its unused neighbours in order of their score, and these fill the container
greedily; what room then is left goes to the largest unused items that fit. Containers that stay too empty,
at a shard's end, are dissolved and their items packed once more, in shards of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.batches import by_size
from spanwright.llm.sketch import mix
from spanwright.llm.tokens import DEFAULT_TOKENIZER, ChunkTable, load_encoding
from spanwright.session import materialize

CAPACITY = 2048
SHARD_ITEMS = 2048
#: Shards that one task packs, one after the other.
TASK_SHARDS = 4
#: Cells in which terms are counted, to weight them; the counts are broadcast (1 MB).
CELLS = 1 << 18
#: Containers filled less than this are packed again.
REPACK_BELOW = 0.97
K1, B = 1.2, 0.75

_ITEMS = "doc_id bigint, piece int, start_token bigint, n_tokens bigint, terms array<int>, freqs array<int>"


def _measurer(tokenizer, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(load_encoding(tokenizer.value))
        for batch in by_size(batches):
            tokens, offsets, terms, freqs = table.measure(batch.column(1).to_pylist())
            whole = (tokens - 1) // capacity * (tokens > capacity)  # whole containers cut off in front
            start = whole * capacity
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(whole.astype(np.int32)),
                    pa.array(start),
                    pa.array(tokens - start),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(terms)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(freqs.astype(np.int32))),
                ],
                ["doc_id", "piece", "start_token", "n_tokens", "terms", "freqs"],
            )

    return run


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many items have terms in the cells; ``terms`` is the only column."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])


def _keyer(counts, n: int):
    """Items with the key of their wording: of their terms the one that a weighted hash draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = counts.value
        for batch in batches:
            terms = batch.column("terms")
            term, offsets = terms.flatten().to_numpy(), terms.offsets.to_numpy()
            u = (mix(term.view(np.uint32).astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(float) / (1 << 53)
            seen = df[term & (CELLS - 1)]
            # a term of one item draws nobody else
            drawn = -np.log(np.maximum(u, 1e-300)) / np.where(seen > 1, np.log((n + 1) / np.minimum(seen, n)) + 1e-6, 1e-9)
            of = np.repeat(np.arange(len(batch)), np.diff(offsets))
            order = np.lexsort((drawn, of))
            key = np.zeros(len(batch), np.int64)
            has = np.diff(offsets) > 0
            key[has] = mix(term[order][(offsets[:-1] - offsets[0])[has]].view(np.uint32).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "wording"])

    return run


class _Index:
    """BM25 inverted index of a shard's items."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, freqs: np.ndarray):
        n = len(offsets) - 1
        item = np.repeat(np.arange(n), np.diff(offsets))
        self.vocabulary, term = np.unique(terms, return_inverse=True)
        df = np.bincount(term, minlength=len(self.vocabulary))
        idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))  # a term of half the items says nothing
        length = np.bincount(item, weights=freqs, minlength=n)
        norm = K1 * (1 - B + B * length / max(length.mean(), 1e-9)) if n else length
        weight = idf[term] * freqs * (K1 + 1) / (freqs + norm[item])
        keep = weight > 0
        item, term, weight = item[keep], term[keep], weight[keep]
        order = np.argsort(term, kind="stable")
        self.items, self.weights = item[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.terms, self.of = term, np.searchsorted(item, np.arange(n + 1))
        self.n = n

    def scores(self, item: int) -> np.ndarray:
        """Scores of all items for the query of one item's terms."""
        terms = self.terms[self.of[item] : self.of[item + 1]]
        lo, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - size), size)
        return np.bincount(self.items[at], weights=self.weights[at], minlength=self.n)


def pack(sizes: np.ndarray, index: _Index, capacity: int) -> np.ndarray:
    """The container number of each item; items must not be larger than the capacity."""
    n = len(sizes)
    container = np.full(n, -1, np.int64)
    by_size = np.argsort(sizes, kind="stable")
    ordered = sizes[by_size]
    rank = np.empty(n, np.int64)
    rank[by_size] = np.arange(n)
    # below[r]: the last unused rank at or before r, found by path halving
    below = list(range(-1, n))

    def unused(r: int) -> int:
        r += 1
        while below[r] != r - 1:
            below[r] = below[below[r] + 1]
            r = below[r] + 1
        return r - 1

    def take(item: int, k: int) -> None:
        container[item] = k
        below[rank[item] + 1] = below[rank[item]]

    k = smallest = 0
    while (top := unused(n - 1)) >= 0:
        seed = by_size[top]
        take(seed, k)
        room = capacity - int(sizes[seed])
        while smallest < n and container[by_size[smallest]] >= 0:
            smallest += 1
        if smallest < n and ordered[smallest] <= room:
            score = index.scores(seed)
            near = np.flatnonzero((score > 0) & (container < 0) & (sizes <= room))
            near = near[np.argsort(-score[near], kind="stable")]
            near_sizes = sizes[near]
            at = 0
            while room and at < len(near):
                fits = np.flatnonzero(near_sizes[at:] <= room)
                if not len(fits):
                    break
                at += int(fits[0])
                if room - near_sizes[at] < ordered[smallest]:
                    # the last gap goes to the item that fits it best, a neighbour if one fits as well
                    best = ordered[unused(int(np.searchsorted(ordered, room, "right")) - 1)]
                    alike = np.flatnonzero(near_sizes[at:] == best)
                    if not len(alike):
                        break
                    at += int(alike[0])
                take(near[at], k)
                room -= int(near_sizes[at])
                at += 1
            while room and (best := unused(int(np.searchsorted(ordered, room, "right")) - 1)) >= 0:
                take(by_size[best], k)
                room -= int(ordered[best])
        k += 1
    return container


def _pack_shard(table: pa.Table, name: str, capacity: int) -> pa.RecordBatch:
    order = [(c, "ascending") for c in ("n_tokens", "doc_id", "piece")]
    table = table.combine_chunks().sort_by(order).combine_chunks()
    sizes = table.column("n_tokens").to_numpy()
    terms, freqs = table.column("terms").chunk(0), table.column("freqs").chunk(0)
    offsets = terms.offsets.to_numpy().astype(np.int64)
    index = _Index(offsets - offsets[0], terms.flatten().to_numpy(), freqs.flatten().to_numpy().astype(np.float64))
    number = pack(sizes, index, capacity)
    used = np.bincount(number, weights=sizes).astype(np.int64)
    names = np.array([f"{name}-{k}" for k in range(len(used))], dtype=object)
    columns = {"container_id": pa.array(names[number], pa.string()), "used": pa.array(used[number])}
    return pa.table(columns | {c: table.column(c) for c in _COLUMNS}).combine_chunks().to_batches()[0]


def _packer(prefix: str, capacity: int, shard_items: int):
    """Packs the items of a partition, shard after shard as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard, held, n = f"{prefix}{TaskContext.get().partitionId()}", 0, [], 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, shard_items - n)
                batch = batch.slice(len(part))
                held.append(part)
                n += len(part)
                if n == shard_items:
                    yield _pack_shard(pa.Table.from_batches(held), f"{name}-{shard}", capacity)
                    shard, held, n = shard + 1, [], 0
        if n:
            yield _pack_shard(pa.Table.from_batches(held), f"{name}-{shard}", capacity)

    return run


_COLUMNS = ["doc_id", "piece", "start_token", "n_tokens", "terms", "freqs", "wording"]
_PACKED = "container_id string, used bigint, doc_id bigint, piece int, start_token bigint, n_tokens bigint, terms array<int>, freqs array<int>, wording bigint"
_OUT = ["container_id", "doc_id", "piece", "start_token", "n_tokens"]


def pack_texts(
    documents: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str = DEFAULT_TOKENIZER,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Put the texts of ``documents(doc_id, text)`` into containers of ``capacity`` tokens.

    One row ``(container_id, doc_id, piece, start_token, n_tokens)`` for each piece of a text. Texts of up
    to ``capacity`` tokens are piece 0 and whole. Longer ones are cut into pieces ``0, 1, ...`` of exactly
    ``capacity`` tokens, each a container of its own, and a last piece that is packed like a short text.
    Each input row is an item of its own, also when ids or texts repeat. Null and empty texts have no
    tokens and are reported once, with a null container. An empty table gives no rows.
    """
    if capacity < 1 or shard_items < 1:
        raise ValueError("capacity and shard_items must be positive")
    context = documents.sparkSession.sparkContext
    with open(tokenizer, "rb") as f:
        ranks = context.broadcast(f.read())
    items = materialize(documents.select("doc_id", "text").mapInArrow(_measurer(ranks, capacity), _ITEMS), "pack-items")
    cut = (
        items.where(F.col("piece") > 0)
        .select("doc_id", F.expr("uuid()").alias("row"), F.explode(F.sequence(F.lit(0), F.col("piece") - 1)).alias("piece"))
        .select(
            F.concat_ws("-", F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), "row", F.col("piece").cast("string")).alias("container_id"),
            "doc_id",
            "piece",
            (F.col("piece").cast("bigint") * capacity).alias("start_token"),
            F.lit(capacity).cast("bigint").alias("n_tokens"),
        )
    )
    nothing = items.where("n_tokens = 0").select(F.lit(None).cast("string").alias("container_id"), *_OUT[1:])
    short = items.where("n_tokens > 0")
    counts, n = np.zeros(CELLS, np.int64), short.count()
    for row in short.select("terms").mapInArrow(_counter, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    keyed = short.mapInArrow(_keyer(context.broadcast(counts), n), _ITEMS + ", wording bigint")

    def packed_by_wording(rows: DataFrame, n: int, prefix: str) -> DataFrame:
        # items of one wording, if there are many, are parted by their hash
        place = ["wording", F.xxhash64("doc_id", "n_tokens", F.hash("terms"))]
        ranged = rows.repartitionByRange(max(1, -(-n // (shard_items * TASK_SHARDS))), *place).sortWithinPartitions(*place)
        return materialize(ranged.mapInArrow(_packer(prefix, capacity, shard_items), _PACKED), "packed")

    packed = packed_by_wording(keyed, n, "s")
    full = F.col("used") >= int(REPACK_BELOW * capacity)
    rest = packed.where(~full)
    repacked = packed_by_wording(rest.select(*_COLUMNS), rest.count(), "r")
    return packed.where(full).select(*_OUT).unionByName(repacked.select(*_OUT)).unionByName(cut).unionByName(nothing)
