import pytest

from quillspark.sources import corpora


def test_text_column(spark, tmp_path):
    spark.createDataFrame([("a", 1), (None, 2)], "t string, n int").write.parquet(f"{tmp_path}/p")
    assert sorted(r["text"] for r in corpora.text_column(spark, f"{tmp_path}/p", "t").collect()) == ["", "a"]
    assert corpora.text_column(spark, f"{tmp_path}/p", "t", 1).count() == 1
    with pytest.raises(KeyError):
        corpora.text_column(spark, f"{tmp_path}/p", "x")
    with pytest.raises(TypeError):
        corpora.text_column(spark, f"{tmp_path}/p", "n")


def test_text_lines(spark, tmp_path):
    (tmp_path / "f.txt").write_text("one\n\nthree")
    assert [tuple(r) for r in corpora.text_lines(spark, str(tmp_path / "f.txt")).collect()] == [(0, "one"), (1, ""), (2, "three")]


def test_text_lines_of_several_files(spark, tmp_path):
    """Files count by name, whatever their sizes; a long file is read in several splits."""
    (tmp_path / "a.txt").write_text("a0\na1\n")
    (tmp_path / "b.txt").write_text("".join(f"b{i} {'x' * (i % 40)}\n" for i in range(3000)))
    (tmp_path / "c.txt").write_text("c0")
    (tmp_path / "d.txt").write_text("")
    want = ["a0", "a1", *(f"b{i} {'x' * (i % 40)}" for i in range(3000)), "c0"]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = corpora.text_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3 and [tuple(r) for r in rows.orderBy("doc_id").collect()] == list(enumerate(want))
        assert [r["doc_id"] for r in corpora.text_lines(spark, str(tmp_path), 4).orderBy("doc_id").collect()] == [0, 1, 2, 3]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_zipf(spark):
    a = corpora.zipf(spark, 200, 50, partitions=3)
    b = corpora.zipf(spark, 200, 50, partitions=5)
    rows = {r["doc_id"]: r["tokens"] for r in a.collect()}
    assert rows == {r["doc_id"]: r["tokens"] for r in b.collect()}
    assert 0.5 < sum(t[0] == "w0000000" for t in rows.values()) / 200 < 0.95
    assert all(5 <= len(t) <= 19 for t in rows.values())
