from pathlib import Path

from spanwright.session import clear_materialized, materialize, scratch, shared_dir


def test_materialize_and_clear(spark):
    df = materialize(spark.range(5), "numbers")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "spanwright"
    assert any(p.name.startswith("numbers-") for p in folder.iterdir())
    clear_materialized(spark)
    assert not folder.exists()


def test_scratch_tables_go_at_the_end(spark):
    folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "spanwright"
    with scratch(spark):
        df = materialize(spark.range(5), "inner")
        assert df.count() == 5 and any(p.name.startswith("inner-") for p in folder.iterdir())
    assert not any(p.name.startswith("inner-") for p in folder.iterdir())
