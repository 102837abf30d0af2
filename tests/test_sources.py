import os

import pytest

from spanwright.sources.markdown_directory import load_directory
from spanwright.sources.study_log import append_log, read_log


def test_directory(spark, tmp_path):
    (tmp_path / "_dir").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "_index.md").write_text("# A\r\n\r\nx–y")
    (tmp_path / "_dir" / "b.MARKDOWN").write_text("b")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / ".git" / "d.md").write_text("no")
    (tmp_path / "e.md").write_text("")
    os.symlink(tmp_path / "e.md", tmp_path / "f.md")
    header, docs = load_directory(spark, str(tmp_path))
    rows = {r.doc_key: r for r in docs.collect()}
    assert sorted(rows) == ["_dir/b.MARKDOWN", "_index.md", "e.md"]
    assert rows["_index.md"].normalized_text == "# A\n\nx-y" and rows["_index.md"].headings[0].path == ["A"]
    assert header.first().source == str(tmp_path)


def test_directory_without_documents(spark, tmp_path):
    header, docs = load_directory(spark, str(tmp_path))
    assert docs.count() == 0 and header.first().loader_versions == {"markdown": "builtin-markdown-1.1.0"}


def test_bad_bytes_raise(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xff\xfe\xfa")
    with pytest.raises(Exception, match="utf-8"):
        load_directory(spark, str(tmp_path))[1].collect()


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(3, "h", 7, "r" * 500)], "cohort int, span_hash string, offset_days int, reason string")
    append_log(df, path, "unresolvable")
    append_log(df, path, "unresolvable")
    rows = read_log(spark, path, "unresolvable").collect()
    assert len(rows) == 2 and len(rows[0].reason) == 200 and read_log(spark, path, "observation").count() == 0
