import hashlib

from pyspark.sql import functions as F

from spanwright.operators.ordered_hash import ordered_hash


def test_like_hashlib(spark):
    rows = [(k % 3 if k % 7 else None, f"k{k:03}", f"é{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "g int, k string, v string").repartition(11)
    got = {r.g: (r.hash, r.n) for r in ordered_hash(df, ["g"], "k", F.concat("k", F.lit("\x00"), "v"), "p").collect()}
    for g in (0, 1, 2, None):
        lines = [f"{k}\x00{v}" for h, k, v in sorted(rows, key=lambda r: r[1]) if h == g]
        assert got[g] == (hashlib.sha256(("p" + "".join(lines)).encode()).hexdigest(), len(lines))
    whole = ordered_hash(df.drop("g"), [], "k", F.col("k")).collect()
    assert [(r.hash, r.n) for r in whole] == [(hashlib.sha256("".join(r[1] for r in rows).encode()).hexdigest(), 200)]
    assert ordered_hash(df.limit(0), ["g"], "k", F.col("k")).count() == 0
