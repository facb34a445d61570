import pytest

from loomwork.llm import _store as st


def test_folders_get_their_scheme(spark, tmp_path):
    for given, want in ((f"{tmp_path}/a", f"file://{tmp_path}/a"), (f"file:{tmp_path}/a", f"file://{tmp_path}/a"), (f"file://{tmp_path}", f"file://{tmp_path}"), ("hdfs://n:9000/x", "hdfs://n:9000/x"), ("hdfs:/x", "hdfs:///x")):
        assert st._qualified(spark, given) == want
    where, name = st.opened(st._qualified(spark, str(tmp_path)))
    assert name == str(tmp_path) and where.type_name == "local"


def test_files_are_whole_under_their_names(tmp_path):
    def torn(f):
        f.write(b"half")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        st.put(f"file://{tmp_path}", "block", torn)
    assert not (tmp_path / "block").exists()
    for content in (b"one", b"one"):
        st.put(f"file://{tmp_path}", "block", lambda f, c=content: f.write(c))
    assert (tmp_path / "block").read_bytes() == b"one"


def test_tables_are_written_and_their_shuffle_files_go(spark):
    before = spark.conf.get(st._CLEAN, None)
    df, path = st.written(spark.range(100).repartition(5), "numbers")
    assert df.count() == 100 and spark.conf.get(st._CLEAN, None) == before
    st.drop(spark, path)
    st.later(path)
    st._delete()


def test_batches_only_get_smaller(spark):
    st.small_batches(spark)
    rows, size = spark.conf.get(st._ROWS), spark.conf.get(st._BYTES)
    assert (int(rows), int(size)) == (st.BATCH_ROWS, st.BATCH_BYTES)
    spark.conf.set(st._ROWS, "10")
    st.small_batches(spark)
    assert spark.conf.get(st._ROWS) == "10"
    spark.conf.set(st._ROWS, rows)
