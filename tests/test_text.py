import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from spanwright.functions import text as T


def model(t):
    t = unicodedata.normalize("NFC", t)
    t = "".join(c for c in t if c not in T.ZERO_WIDTH).replace("\r\n", "\n").replace("\r", "\n")
    t = t.translate(dict(zip(map(ord, T.FOLD_FROM), T.FOLD_TO, strict=True)))
    t = re.sub(" {2,}", " ", t)
    t = "\n".join(line.rstrip(" ") for line in t.split("\n"))
    return re.sub("\n{3,}", "\n\n", t).strip()


def test_normalize_like_model_on_random_texts(spark):
    alphabet = "ab \n\r\t\x0b\x1c\x85  –“​́eé \U0001f600#"
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(14))) for _ in range(4000)] + ["", "x" * 100_000 + "  "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize(F.col("t")).alias("n"), T.content_hash(F.col("t")).alias("h")).collect()
    for r in rows:
        assert r.n == model(r.t) == T.normalize_str(r.t)
        assert r.h == hashlib.sha256(r.n.encode()).hexdigest()


def test_nulls_stay_null(spark):
    row = spark.createDataFrame([(None,)], "t string").select(T.normalize(F.col("t")), T.content_hash(F.col("t")), T.technical_tokens(F.col("t"))).first()
    assert list(row) == [None, None, None]


def test_technical_tokens(spark):
    text = "Set be=0 and PWR_VAL = 3, 0xFF on 3.1.2; see some_name, SOC3B, ABC; F:LINK_SYNC. Ab 1.2 AB"
    got = spark.createDataFrame([(text,)], "t string").select(T.technical_tokens(F.col("t"))).first()[0]
    assert got == ["be=0", "PWR_VAL = 3", "0xFF", "3.1.2", "some_name", "SOC3B", "ABC", "F:LINK_SYNC"]


def test_missing_tokens_is_literal(spark):
    df = spark.createDataFrame([(["A_B=1", "C_D"], "x A_B = 1 C_D"), ([], "x"), (["A"], None)], "q array<string>, s string")
    assert [r[0] for r in df.select(T.missing_tokens(F.col("q"), F.col("s"))).collect()] == [["A_B=1"], [], None]


def test_canonical_spellings(spark):
    h = "AB" * 32
    df = spark.createDataFrame([(f" {h}", "Valid Repaired"), (f"sha256:{h}", " valid-repaired "), ("abc", None), (None, "")], "h string, r string")
    rows = df.select(T.canonical_sha256(F.col("h")), T.canonical_label(F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [(h.lower(), "valid_repaired"), (h.lower(), "valid_repaired"), (None, None), (None, "")]
