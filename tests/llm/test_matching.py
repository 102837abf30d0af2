import itertools
import random

import pytest

from spanwright.llm.leaks import PassageIndex, passage_leaks
from spanwright.llm.near_duplicates import NearDuplicates
from spanwright.llm.prose import sentences
from spanwright.llm.question_overlap import question_overlaps
from spanwright.llm.shared_spans import SharedSpans, Winnower
from spanwright.llm.words import words

NOUNS = [f"{a}{b}" for a in "pump valve rotor gauge motor belt tank lamp wire card".split() for b in ("", "er", "ing", "line", "set", "box", "rod")]


def sentence(rnd, n=14):
    return " ".join(rnd.choice(NOUNS) for _ in range(n)).capitalize() + f" {rnd.randrange(100_000)}."


def text(rnd, n):
    return " ".join(sentence(rnd) for _ in range(n))


def shared(documents, anchors, run):
    refs = [(k, k, t, False) for k, t in documents if k and t] + [(f"anchor:{o}", k, t, True) for o, k, t in anchors if o is not None and t]
    out = set()
    for (r, k, t, a), (s, l, u, b) in itertools.combinations(set(refs), 2):
        if r == s or (a and b) or (k is not None and k == l):
            continue
        if {t[i : i + run] for i in range(len(t) - run + 1)} & {u[i : i + run] for i in range(len(u) - run + 1)}:
            out.add((min(r, s), max(r, s)))
    return out


def spans_fixture():
    rnd = random.Random(2)
    parts = [text(rnd, 3) for _ in range(6)]
    notice = text(rnd, 1)[:70]
    docs = [(f"d{k}", f"{notice} {text(rnd, 2)} {parts[k % 6][: 60 + 8 * k]} {text(rnd, 1)}") for k in range(24)]
    docs += [("copy1", docs[0][1]), ("copy2", docs[0][1]), ("short", "x"), (None, docs[0][1]), ("null", None), ("same", "ab" * 400), ("same2", "ab" * 500)]
    anchors = [(k, f"d{k % 7}", docs[k][1][20 : 20 + 40 * (k % 6 + 1)].strip()) for k in range(20)] + [(90, None, docs[3][1][10:200]), (91, "d3", None), (None, "d3", "x" * 200)]
    return docs, anchors


def spans_of(spark, docs, anchors, **options):
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs + docs[:3]], "doc_key string, normalized_text string, text string, class int")
    a = spark.createDataFrame([(*r, "clash") for r in anchors + anchors[:3]], "anchor_ord bigint, doc_key string, span_text string, ref string")
    return SharedSpans(d, a, **options)


def test_shared_spans_like_brute_force(spark):
    docs, anchors = spans_fixture()
    for run, hot in ((150, 1000), (60, 1000), (60, 2)):
        got = [(r.ref_a, r.ref_b) for r in spans_of(spark, docs, anchors, run=run, hot=hot).pairs().collect()]
        assert set(got) == shared(docs, anchors, run) and len(got) == len(set(got))


@pytest.mark.parametrize("hot", [1000, 3])
def test_coverage_like_brute_force(spark, hot):
    docs, anchors = spans_fixture()
    run = 100
    rows = {r.ref: r for r in spans_of(spark, docs, anchors, run=run, hot=hot).coverage().collect()}
    refs = [(k, k, t) for k, t in docs if k and t] + [(f"anchor:{o}", k, t) for o, k, t in anchors if o is not None and t]
    for ref, key, t in refs:
        others = [u for k, u in docs if k and u and k != ref and (key is None or k != key)]
        covered = set()
        for i in range(len(t) - run + 1):
            if any(t[i : i + run] in u for u in others):
                covered |= set(range(i, i + run))
        assert (rows[ref].covered if ref in rows else 0) == len(covered), ref


def test_shared_spans_with_the_sketch_spread_over_its_slices(spark):
    docs, anchors = spans_fixture()
    got = {(r.ref_a, r.ref_b) for r in spans_of(spark, docs, anchors, run=60, most_bytes=0).pairs().collect()}
    assert got == shared(docs, anchors, 60)


def test_sketch_of_many_partitions(spark):
    """A thousand partial sketches; no count is underestimated, and bits tell the same."""
    import numpy as np

    from spanwright.llm import sketch

    def partials(batches):
        for batch in batches:
            yield sketch.partial(batch.column(0).to_numpy(), sketch.LEAST_WIDTH)

    keys = spark.range(0, 6000, 1, 1000).selectExpr("xxhash64(id % 4000) AS k")
    parts = keys.mapInArrow(partials, sketch.PARTIALS)
    levels, bits = sketch.merged(parts, sketch.LEAST_WIDTH), sketch.merged(parts, sketch.LEAST_WIDTH, bits=True)
    counts = {r.k: r["count"] for r in keys.groupBy("k").count().collect()}
    k, n = np.array(list(counts), np.int64), np.array(list(counts.values()))
    estimated = sketch.estimate(levels, k)
    assert (estimated >= sketch.level(n)).all() and (estimated == sketch.level(n)).mean() > 0.98
    assert (sketch.repeated(bits, k) == (estimated >= sketch.TWICE)).all()
    assert sketch.partial(np.zeros(0, np.int64), sketch.LEAST_WIDTH).num_rows == 0


def test_coverage_names_what_shares_nothing(spark):
    docs = [("a", text(random.Random(1), 4)), ("b", "short"), ("null", None)]
    rows = spans_of(spark, docs, [(7, "a", "brief")]).coverage().collect()
    assert {(r.ref, r.is_anchor, len(r.spans), r.covered, r.share) for r in rows} == {("a", False, 0, 0, 0.0), ("b", False, 0, 0, 0.0), ("anchor:7", True, 0, 0, 0.0)}


def test_shared_spans_of_nothing(spark):
    assert spans_of(spark, [], []).pairs().count() == 0 and spans_of(spark, [], []).coverage().count() == 0


def test_winnower_keeps_one_gram_of_every_window():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc ") for _ in range(n)) for n in (0, 10, 59, 60, 61, 300, 2000)]
    winnower = Winnower(60)
    of, pos, _ = winnower.kept(texts)
    for k, t in enumerate(texts):
        kept = {p for o, p in zip(of.tolist(), pos.tolist(), strict=True) if o == k}
        assert all(0 <= p <= len(t) - winnower.gram for p in kept)
        assert all(any(s <= p <= s + 60 - winnower.gram for p in kept) for s in range(len(t) - 59))


def test_near_duplicates(spark):
    rnd = random.Random(6)
    base = [[sentence(rnd) for _ in range(12)] for _ in range(5)]
    notice = [sentence(rnd), sentence(rnd)]

    def edited(ss, changed, seed):
        r = random.Random(seed)
        out = []
        for k, s in enumerate(ss):
            w = s.split(" ")
            if k < changed:
                w[r.randrange(1, 12)] = "silently"
            out.append(" ".join(w))
        r.shuffle(out)
        return out

    docs = []
    for k, ss in enumerate(base):
        docs += [(f"a{k}", "# One\n\n" + " ".join(ss + notice)), (f"b{k}", "# Two\n\n" + "\n\n".join(edited(ss, 7, k) + notice)), (f"c{k}", " ".join(edited(ss, 0, k)[:10]))]
        docs.append((f"half{k}", " ".join(ss[:4] + [sentence(rnd) for _ in range(8)] + notice)))
    docs += [("same", docs[0][1]), ("empty", ""), ("null", None), (None, docs[0][1]), ("table", "| a | b |\n|---|---|"), ("table2", "| a | b |\n|---|---|")]
    df = spark.createDataFrame([(*d, "clash") for d in docs + docs[:2]], "doc_key string, normalized_text string, class string")
    near = NearDuplicates(df)
    got = {(r.doc_key_a, r.doc_key_b) for r in near.pairs().collect()}
    want = {p for k in range(5) for p in itertools.combinations((f"a{k}", f"b{k}", f"c{k}"), 2)} | {("a0", "same"), ("b0", "same"), ("c0", "same")}
    assert got == want
    groups = {r.doc_key: (r.n_copies, r.n_links) for r in near.groups().collect()}
    assert groups["same"] == groups["a0"] == (2, 2) and groups["half1"] == (1, 0) and groups["table"] == (2, 0)


def test_near_duplicates_with_every_sentence_edited(spark):
    rnd = random.Random(11)
    docs, want = [], set()
    for k in range(30):
        ss = [sentence(rnd) for _ in range(3 + k % 4)]
        changed = [s.split(" ") for s in ss]
        for n, w in enumerate(changed):
            w[n + 2], w[10] = f"supervision{k}", str(rnd.randrange(10_000, 99_999))
        docs += [(f"a{k}", " ".join(ss)), (f"b{k}", " ".join(" ".join(w) for w in changed))]
        want.add((f"a{k}", f"b{k}"))
    got = NearDuplicates(spark.createDataFrame(docs, "doc_key string, normalized_text string")).pairs().collect()
    assert {(r.doc_key_a, r.doc_key_b) for r in got} == want


def test_near_duplicates_of_repeated_sentences(spark):
    rnd = random.Random(12)
    once = [sentence(rnd) for _ in range(8)]
    docs = [("once", " ".join(once)), ("thrice", " ".join(once * 3)), ("other", text(rnd, 8))]
    got = NearDuplicates(spark.createDataFrame(docs, "doc_key string, normalized_text string")).pairs().collect()
    assert [(r.doc_key_a, r.doc_key_b) for r in got] == [("once", "thrice")]


def test_near_duplicates_of_short_sentences(spark):
    steps = "- Stop pump\n- Open valve\n- Wait\n- Close {}\n- Start pump\n"
    docs = [("a", steps.format("valve")), ("b", steps.format("valve")), ("c", steps.format("tank")), ("d", "- Fill tank\n- Open lid now\n- Close valve now\n")]
    got = NearDuplicates(spark.createDataFrame(docs, "doc_key string, normalized_text string")).pairs().collect()
    assert {(r.doc_key_a, r.doc_key_b) for r in got} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_near_duplicates_of_nothing(spark):
    assert NearDuplicates(spark.createDataFrame([], "doc_key string, normalized_text string")).pairs().count() == 0


def test_questions(spark):
    q = "How long does the Sorjatnir relay wait before it rejects the sealed turbine once code E205 is shown?"
    fill = [f"Which {NOUNS[k % 70]} limit has the {NOUNS[k * 3 % 70].capitalize()}dar{'abcdefghij'[k % 10]} {NOUNS[k * 7 % 70]} at {NOUNS[k * 11 % 70]} {k}?" for k in range(80)]
    same = [q, q.upper(), q.lower() + "??", "Quick one: " + q[0].lower() + q[1:], q.replace("the ", ""), q.replace("before", "befroe"), q.replace("wait", "hold"), q.replace(" ", "\n", 3),
            "Once code E205 is shown, how long does the Sorjatnir relay wait before it rejects the sealed turbine?"]
    other = [q.replace("Sorjatnir", "Kelvabmut"), q.replace("E205", "E206"), "Why is the Sorjatnir relay sealed while code E205 is shown in red?", "", None]
    candidates = [(f"c{k}", x, "clash") for k, x in enumerate(same + other + fill)]
    tests = [("t1", q, 1), ("t2", q, 1), ("t3", None, 1), ("t4", "", 1), (None, q, 1)] + [(f"u{k}", x.replace("limit", "bound"), 1) for k, x in enumerate(fill[:40])]
    got = {
        (r.candidate_id, r.test_id)
        for r in question_overlaps(
            spark.createDataFrame(tests + tests, "test_id string, question string, words int"), spark.createDataFrame(candidates + candidates[:5], "candidate_id string, question string, q string")
        ).collect()
    }
    n = len(same) + len(other)
    assert got == {(f"c{k}", t) for k in range(len(same)) for t in ("t1", "t2")} | {(f"c{n + k}", f"u{k}") for k in range(40)}


def test_questions_with_another_word_are_others(spark):
    tests = [("t1", "When does the trial of the pump end?"), ("t2", "Which valve opens at the west gate before the alarm of the Belkarun boiler is heard?"), ("t3", "word"), ("t4", "Was?")]
    candidates = [
        ("c1", "When does the trail of the pump end?"),
        ("c2", "Which valve opens at the west gate after the alarm of the Belkarun boiler is heard?"),
        ("c3", "Word!"),
        ("c4", "was"),
        ("c5", "Before the alarm of the Belkarun boiler is heard, which valve opens at the west gate?"),
    ]
    got = question_overlaps(spark.createDataFrame(tests, "test_id string, question string"), spark.createDataFrame(candidates, "candidate_id string, question string"))
    assert {(r.candidate_id, r.test_id) for r in got.collect()} == {("c3", "t3"), ("c4", "t4"), ("c5", "t2")}


def test_questions_of_nothing(spark):
    tests, candidates = "test_id string, question string", "candidate_id string, question string"
    full = spark.createDataFrame([("t", "What is this?")], tests)
    assert question_overlaps(full, spark.createDataFrame([], candidates)).count() == 0
    assert question_overlaps(spark.createDataFrame([], tests), spark.createDataFrame([("c", "What is this?")], candidates)).count() == 0


def leaks_fixture():
    rnd = random.Random(9)
    passages = [(k, text(rnd, 6)) for k in range(30)]
    docs, want = [], set()
    for k, (item, passage) in enumerate(passages):
        ws = passage.split(" ")
        noise = text(rnd, 4)
        docs.append((100 + k, f"{noise} {passage.upper()} {noise}"))
        part = ws[10:45]
        part[5], part[20] = "changed", "words"
        docs.append((200 + k, f"> {noise}\n\n- " + "\n".join(part) + "\n- more"))
        docs.append((300 + k, noise + " " + " ".join(ws[:24]) + " " + text(rnd, 2)))
        many = [w if i % 5 else "other" for i, w in enumerate(ws)]
        docs.append((400 + k, " ".join(many)))
        want |= {(item, 100 + k), (item, 200 + k)}
    return passages, docs, want


def test_leaks(spark):
    passages, docs, want = leaks_fixture()
    docs += [(900, None), (901, ""), (None, passages[0][1]), (902, "| " + passages[1][1] + " | 3 |"), (903, " ".join(passages[2][1].split(" ")[:40] * 400))]
    passages += [(50, None), (None, "x y z"), (51, ""), (52, "tiny passage here")]
    want = want | {(1, 902), (2, 903)}
    d = spark.createDataFrame([(*x, "clash") for x in docs + docs[:3]], "doc_id bigint, text string, item_id string")
    p = spark.createDataFrame([(*x, "en") for x in passages + passages[:2]], "item_id bigint, text string, lang string")
    for block in (20_000, 7):
        got = [(r.item_id, r.doc_id) for r in passage_leaks(d, p, block_items=block).collect()]
        assert set(got) == want and len(got) == len(set(got))


def test_leaks_of_longer_runs_and_short_passages(spark):
    rnd = random.Random(13)
    passages = [(k, text(rnd, 6)) for k in range(6)] + [(50, "Zephyrine"), (51, "quokka burrow"), (52, "quokka warren")]
    docs = [(1, "the quokka, burrow and"), (2, "a zephyrine day"), (3, "quokka"), (4, "burrow quokka")]
    want = {(51, 1), (50, 2)}
    for k, (length, edits) in enumerate([(40, 4), (45, 4), (50, 5), (85, 8), (40, 5), (50, 6)]):
        part = passages[k][1].split(" ")[:length]
        places = [26, 27, 28, 29, 55, 56, 57, 58] if edits == 8 else range(length // 2 - 3, length // 2 - 3 + edits)
        for at in places:
            part[at] = "changed"
        docs.append((100 + k, f"{text(rnd, 3)} {' '.join(part)} {text(rnd, 3)}"))
        if edits <= length // 10:
            want.add((k, 100 + k))
    d, p = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "item_id bigint, text string")
    assert {(r.item_id, r.doc_id) for r in passage_leaks(d, p).collect()} == want


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "some other text of a passage")], "item_id bigint, text string")
    assert passage_leaks(docs, items.limit(0)).count() == 0 == passage_leaks(docs.limit(0), items).count()


def test_pruning_loses_no_leak():
    """With the bounds off, every passage and document verified: the same pairs."""
    import numpy as np

    passages, docs, want = leaks_fixture()
    index = PassageIndex([i for i, _ in passages], [words(t) for _, t in passages])
    got = set()
    for doc, t in docs:
        ids = np.array([index.word_id[w] for w in words(t)], np.int64)
        got |= {(int(index.item_ids[i]), doc) for i in range(len(passages)) if index.leaked(i, ids)}
    assert got == want


def test_sentences():
    t = "---\na: b\n---\n# Head\n\nOne wrapped\nline. Two!\n\n```py\ncode. here\n```\n\n| a | b |\n|---|---|\n\n- item one\n- item two. Done\n\n<b>Bold</b> [x](http://y.z) `code` end.\n"
    assert [" ".join(s.split()) for s in sentences(t)] == ["One wrapped line.", "Two!", "item one", "item two.", "Done", "Bold [x] end."]
    assert sentences("") == [] and sentences("```\nnever closed. x") == []


def test_words():
    assert words("Café <b>X</b> &amp; 1. foo_bar\n2. gate=0 3.5 FÃ¼r exam­ple") == ["cafe", "x", "1", "foo", "bar", "gate", "0", "3", "5", "fur", "example"]


def test_queries_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"p{n}_found" for n in (2, 3, 4, 5, 7, 8)} | {"p1_sample", "p6_pack"} <= set(names) and set(entry.oracle_sql()) <= set(names)


def planted_edits(seed=21, n=40):
    """Documents, and for each a copy with one to three words of every sentence replaced; ``edits`` words of at least 4 x ``edits``."""
    rnd = random.Random(seed)
    docs, want = [], set()
    for k in range(n):
        sentences_ = [[rnd.choice(NOUNS) + rnd.choice("abcdefghij") for _ in range(rnd.randint(12, 16))] for _ in range(rnd.randint(4, 14))]
        edited = [list(s) for s in sentences_]
        for s in edited:
            for at in rnd.sample(range(len(s)), 1 + k % 3):
                s[at] = rnd.choice((rnd.choice(NOUNS) + rnd.choice("abcdefghij"), f"n{rnd.randrange(10**6)}"))
        rnd.shuffle(edited)
        docs += [(f"a{k}", " ".join(" ".join(s).capitalize() + "." for s in sentences_)), (f"b{k}", " ".join(" ".join(s).capitalize() + "." for s in edited))]
        want.add((f"a{k}", f"b{k}"))
    return docs, want


def test_near_duplicates_recall_with_words_of_every_sentence_replaced(spark):
    docs, want = planted_edits()
    got = {(r.doc_key_a, r.doc_key_b) for r in NearDuplicates(spark.createDataFrame(docs, "doc_key string, normalized_text string")).pairs().collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_near_duplicates_where_one_text_says_everything_more_often(spark):
    rnd = random.Random(22)
    once = [sentence(rnd) for _ in range(10)]
    docs = [("a", " ".join(once)), ("b", " ".join(once + once[:8] + once[3:10])), ("c", " ".join(f"Go to {x}." for x in "abc" * 3))]
    docs += [("d", " ".join(f"Press {x} twice." for x in NOUNS[:30])), ("e", " ".join(f"Press {x} twice." for x in NOUNS[2:30]) + " Wait here.")]
    got = {(r.doc_key_a, r.doc_key_b) for r in NearDuplicates(spark.createDataFrame(docs, "doc_key string, normalized_text string")).pairs().collect()}
    assert got == {("a", "b"), ("d", "e")}


def test_near_duplicate_groups(spark):
    rnd = random.Random(23)
    parts = [[sentence(rnd) for _ in range(10)] for _ in range(2)]
    chain = [" ".join(parts[0][: 10 - 2 * k] + [sentence(rnd) for _ in range(2 * k)]) for k in range(3)]
    docs = [(f"c{k}", x) for k, x in enumerate(chain)] + [("same", chain[0]), ("lone", " ".join(parts[1])), ("null", None), (None, chain[0])]
    rows = {r.doc_key: r for r in NearDuplicates(spark.createDataFrame(docs, "doc_key string, normalized_text string")).groups().collect()}
    assert len({rows[k].group for k in ("c0", "c1", "same")}) == 1 and rows["lone"].group == rows["lone"]["class"] and rows["same"].n_copies == 2
    assert set(rows) == {"c0", "c1", "c2", "same", "lone"}
