import random

import numpy as np

from spanwright.llm.reading_level import cut_points, reading_levels

EASY = ["Look at the {} box.", "Do not press the {} lid.", "The {} fan is hot.", "Now turn it.", "Wait for the {} bell."]
HARD = ["Practitioners who presuppose probabilistic characterization without considering precautionary {} heterogeneity frequently encounter quasistationary susceptibility, complicating subsequent interoperability considerably across installations."]
MID = ["The default pressure of the {} feeder is 42 litres, measured at the yard office during a cold start.", "Crews at the upper deck should reload the {} router by hand when it stays idle for nine hours."]
LONG_EASY = ["We look at the {} box and then we put the lid on the old pan and now we go to the red door and sit by the sun with the dog and the cat and have a cup of tea."]


def corpus(seed=1, n=40):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for k in range(n):
        for j, (band, pool) in enumerate((("easy", EASY), ("hard", HARD), ("mid", MID), ("mid", LONG_EASY))):
            size = {"easy": 20, "hard": 5}.get(band, 8)
            text = "# Title\n\n" + " ".join(rnd.choice(pool).format(rnd.choice(("old", "new", "red", "big", "wet"))) for _ in range(size))
            text += "\n\n```\nunquestionably_incomprehensible = 1\n```\n"
            docs.append((4 * k + j, text))
            truth[4 * k + j] = band
    return docs, truth


def levels(spark, docs, grades, **options):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, level string")
    g = spark.createDataFrame(grades, "doc_id bigint, band string, graded_by string")
    return reading_levels(d, g, **options).collect()


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    graded = [(k, truth[k].upper(), "r") for k in range(48)] + [(3, "easy", "s"), (2, None, "s"), (None, "easy", "s"), (7, "odd", "s")]
    rows = levels(spark, docs, graded)
    held_out = [r for r in rows if r.doc_id >= 48]
    assert sum(r.band == truth[r.doc_id] for r in held_out) / len(held_out) >= 0.98
    mean = {b: np.mean([r.level for r in held_out if truth[r.doc_id] == b]) for b in ("easy", "mid", "hard")}
    assert mean["easy"] < mean["mid"] < mean["hard"]


def test_little_prose_nulls_and_repeats(spark):
    docs, truth = corpus(n=10)
    graded = [(k, truth[k], "r") for k in range(24)]
    odd = [(900, None), (901, ""), (902, "Too short."), (903, "| a | b |\n" * 80), (None, docs[0][1]), (0, docs[0][1])]
    rows = levels(spark, docs + odd, graded)
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) + len(odd)
    assert all(by[k].band is None for k in (900, 901, 902, 903)) and by[903].n_words == 0
    assert {r.band for r in rows if r.doc_id in (0, None)} == {"easy"}


def test_without_grades_or_documents(spark):
    docs, _ = corpus(n=2)
    assert {(r.level, r.band) for r in levels(spark, docs, [])} == {(0.0, "mid")}
    assert levels(spark, [], [(1, "easy", "r")]) == []


def test_cuts_forgive_a_wrong_reader():
    level = np.concatenate([np.linspace(-0.6, -0.4, 20), np.linspace(-0.05, 0.05, 60), np.linspace(0.3, 0.6, 20)])
    grade = np.concatenate([np.full(20, -1.0), np.zeros(60), np.ones(20)])
    grade[25], grade[70] = 1.0, -1.0
    easy, hard = cut_points(level, grade, np.histogram(level, 400, (-1, 1))[0])
    assert -0.4 < easy < -0.05 and 0.05 < hard < 0.3
    assert cut_points(level, np.zeros(100), np.histogram(level, 400, (-1, 1))[0]) == (-np.inf, np.inf)


def test_a_documents_own_grade_does_not_move_its_level(spark):
    docs, truth = corpus(n=12)
    graded = [(k, truth[k], "r") for k in range(1, 40)]
    of = [{r.doc_id: r.level for r in levels(spark, docs, [(0, band, "r"), *graded])} for band in ("easy", "hard")]
    assert abs(of[0][0] - of[1][0]) < 0.05 and of[1][0] < -0.3


def test_languages_by_frequent_words_and_label(spark):
    docs = [
        (1, "Die Pumpe ist an der Wand und der Filter liegt in dem Lager. Das ist nicht gut.", "en"),
        (2, "The pump is on the wall and the filter is in the store. This is not good.", None),
        (3, "La bomba está en la pared y el filtro se guarda en el armario para que no se moje.", "und"),
        (4, "Pompa filtr magazyn zawory.", " PL-pl "),
        (5, "", "zz"),
        (6, None, None),
    ]
    rows = reading_levels(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame([], "doc_id bigint, band string")).collect()
    assert {r.doc_id: r.language for r in rows} == {1: "de", 2: "en", 3: "es", 4: "pl", 5: "zz", 6: "und"}


def test_many_partitions_and_growing_tables(spark):
    docs, truth = corpus(n=20)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(300)
    g = spark.createDataFrame([(k, truth[k]) for k in range(48)], "doc_id bigint, band string")
    rows = reading_levels(d, g).collect()
    assert len(rows) == len(docs) and np.mean([r.band == truth[r.doc_id] for r in rows]) >= 0.98
