from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanwright.llm import plans_sample
from spanwright.llm.packing import pack_texts
from spanwright.llm.stable_sample import ROUNDS, stable_sample
from spanwright.llm.tokens import DEFAULT_TOKENIZER, ChunkTable, load_encoding

SCHEMA = (
    "record string, cohort int, quarter string, cohort_sha string, cohort_date string, churn_90d int, span_hash string, doc_key string, "
    "stratum string, offset_days int, observed_sha string, resolution string, batch int, written_at timestamp, _latest string"
)


def observation(cohort, h, offset=7, batch=0, resolution="valid"):
    return ("observation", cohort, "2024Q1", "c", "2024-01-01", None, h, None, None, offset, "o", resolution, batch, None, "clash")


def sha(k):
    return f"{k * 2654435761 % (1 << 61):064x}"


def reference(cohort, h, seed, rate):
    """The permutation, by hand."""
    import hashlib

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    l0, l1, r0, r1 = (signed(int(h[16 * k : 16 * k + 16], 16)) for k in range(4))
    for n in range(ROUNDS):
        d = hashlib.md5(f"{seed}|{n}|{cohort}|{r0}|{r1}".encode()).hexdigest()
        l0, l1, r0, r1 = r0, r1, l0 ^ signed(int(d[:16], 16)), l1 ^ signed(int(d[16:], 16))
    return (r0 % (1 << 64)) / (1 << 64) < rate


def test_sample_is_the_permutation_and_grows(spark):
    rows = [observation(c, sha(k), o) for c in (1, 2) for k in range(400) for o in (7, 14)]
    df = spark.createDataFrame(rows, SCHEMA)
    chosen = {(r.cohort, r.span_hash) for r in stable_sample(df, 0.2, "s").collect()}
    assert chosen == {(c, sha(k)) for c in (1, 2) for k in range(400) if reference(c, sha(k), "s", 0.2)}
    assert 100 < len(chosen) < 220
    more = spark.createDataFrame(rows + [observation(c, sha(k)) for c in (1, 2, 3) for k in range(400, 700)], SCHEMA).repartition(13)
    later = stable_sample(more, 0.2, "s")
    assert chosen <= {(r.cohort, r.span_hash) for r in later.collect()}
    assert {(r.cohort, r.span_hash) for r in stable_sample(df, 0.1, "s").collect()} <= chosen
    assert all(n == 2 for n in (r["count"] for r in stable_sample(df, 0.2, "s").groupBy("cohort", "span_hash").count().collect()))


def test_sample_of_dirty_rows(spark):
    h = "ab" * 32
    rows = [observation(1, h), observation(1, f" {h.upper()}", batch=2, resolution="VALID "), observation(1, None), observation(None, h), observation(1, "short")]
    got = stable_sample(spark.createDataFrame(rows, SCHEMA), 1.0).collect()
    assert [(r.span_hash, r.batch, r.resolution, r._latest) for r in got] == [(h, 2, "valid", "clash")]
    assert stable_sample(spark.createDataFrame(rows, SCHEMA), 0).count() == 0 == stable_sample(spark.createDataFrame([], SCHEMA), 1.0).count()
    with pytest.raises(ValueError):
        stable_sample(spark.createDataFrame([], SCHEMA), 1.5)


def test_sample_keeps_the_observation_of_each_document(spark):
    def of(doc_key, batch, h="ab" * 32):
        row = observation(1, h, batch=batch)
        return (*row[:7], doc_key, *row[8:])

    one, none = "cd" * 32, "ef" * 32
    rows = [of("a.md", 0), of("b.md", 0), of("b.md", 3), of(None, 4), of("c.md", 0, one), of(None, 2, one), of(None, 1, none), of(None, 2, none)]
    got = stable_sample(spark.createDataFrame(rows, SCHEMA), 1.0).collect()
    assert sorted((r.span_hash[:2], r.doc_key or "", r.batch) for r in got) == [("ab", "", 4), ("ab", "a.md", 0), ("ab", "b.md", 3), ("cd", "c.md", 2), ("ef", "", 2)]


def test_sample_query_has_an_oracle():
    assert "p1_sample" in plans_sample.ORACLES


def test_token_counts_are_exact():
    encoding = load_encoding(Path(DEFAULT_TOKENIZER).read_bytes())
    texts = ["", None, "a", " a", "a  b", "a b ", "x\n y\n\n z", "it's  fine", "\t\n", "été — naïve x", "  ", "a　b c", "1234 5,6", "don't 'll 's"]
    texts += ["a \n b  \n\n  c", "end.\n", " \n", "tab\tseparated text "]
    table = ChunkTable(encoding)
    for _ in range(2):
        counts, offsets, terms, freqs = table.measure(texts)
        assert counts.tolist() == [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
        assert len(offsets) == len(texts) + 1 and offsets[-1] == len(terms) == len(freqs)


def check(rows, sizes, capacity):
    """Every item placed once, in pieces that cover it, and no container too full."""
    used, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        if r.container_id is None:
            assert r.n_tokens == 0 and sizes[r.doc_id] == 0
            continue
        used[r.container_id] += r.n_tokens
        pieces[r.doc_id].append((r.piece, r.start_token, r.n_tokens))
    assert max(used.values(), default=0) <= capacity
    for doc, size in sizes.items():
        at = 0
        for k, (piece, start, n) in enumerate(sorted(pieces[doc])):
            assert (piece, start) == (k, at)
            at += n
            assert len(pieces[doc]) == 1 or n == capacity or k == len(pieces[doc]) - 1
        assert at == size
        assert size > capacity or len(pieces[doc]) <= 1
    return used


def test_packing(spark):
    rows = [(k, " ".join(f"word{(k * 7 + j) % 50}" for j in range(3 + (k * 37) % 90)), "x") for k in range(400)]
    rows += [(1000, "long " * 5000, "x"), (1001, None, "x"), (1002, "", "x"), (1003, "y" * 3000, "x"), (None, "no id", "x")]
    encoding = load_encoding(Path(DEFAULT_TOKENIZER).read_bytes())
    sizes = {k: len(encoding.encode_ordinary(t)) if t else 0 for k, t, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    used = check(pack_texts(docs, capacity=512, shard_items=64).collect(), sizes, 512)
    assert sum(used.values()) / len(used) / 512 > 0.95
    one = pack_texts(docs, capacity=512, shard_items=10_000).collect()
    assert {(r.doc_id, r.piece) for r in one} == {(r.doc_id, r.piece) for r in pack_texts(docs.repartition(5), capacity=512).collect()}


def test_packing_puts_neighbours_together(spark):
    topics = ["pump valve litre housing seal", "court judge verdict appeal clerk", "violin tempo chord sonata score"]
    rows = [(k, " ".join([topics[k % 3]] * 8)) for k in range(60)]
    packed = pack_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=256).collect()
    by = defaultdict(set)
    for r in packed:
        by[r.container_id].add(r.doc_id % 3)
    assert sum(len(t) == 1 for t in by.values()) >= len(by) - 2


def test_packing_puts_neighbours_together_over_many_shards(spark):
    """Forty topics in shards of sixteen items: by chance a container of eight would hold some eight topics."""
    rows = [(k, " ".join(f"t{k % 40}w{j} t{k % 40}w{j} common words of all" for j in range(4))) for k in range(640)]
    size = len(load_encoding(Path(DEFAULT_TOKENIZER).read_bytes()).encode_ordinary(rows[0][1]))
    assert {len(load_encoding(Path(DEFAULT_TOKENIZER).read_bytes()).encode_ordinary(rows[k][1])) for k in (0, 15, 39)} == {size}
    packed = pack_texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), capacity=8 * size, shard_items=16).collect()
    by = defaultdict(set)
    for r in packed:
        by[r.container_id].add(r.doc_id % 40)
    assert len(packed) == 640 and sum(map(len, by.values())) / len(by) < 3


def test_packing_cuts_rows_of_one_id_apart(spark):
    rows = [(1, "long " * 1000), (1, "long " * 1000), (None, "long " * 1000)]
    packed = pack_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=256).collect()
    used = defaultdict(int)
    for r in packed:
        used[r.container_id] += r.n_tokens
    assert None not in used and max(used.values()) <= 256


def test_packing_nothing(spark):
    assert pack_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    repeated = spark.createDataFrame([(1, "same text")] * 3, "doc_id bigint, text string")
    assert pack_texts(repeated).select(F.sum("n_tokens")).first()[0] == 3 * 2
