import pytest

from tableworks.operators import profile as P
from tableworks.session import shared_dir
from tableworks.sources import tables as S


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError, match="Cannot find file"):
        S.read_table(spark, "/nowhere/x.parquet")


def test_unknown_column_names_the_first_five(spark, sf):
    with pytest.raises(ValueError, match="Column 'x' not found. Available columns: l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity..."):
        P.profile_numeric_target(spark.read.parquet(f"{sf}/lineitem.parquet"), col="x")


def test_csv_round_trip_with_quotes_and_breaks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, "line\nbreak")], "id INT, t STRING")
    S.write_predictions(df, str(tmp_path / "p"))
    back = S.read_table(spark, str(tmp_path / "p"), multi_line=True)
    assert sorted((r.id, r.t) for r in back.collect()) == [(1, 'a "q", b'), (2, "line\nbreak")]


def test_appended_vectors_get_new_ids(spark, tmp_path):
    path = str(tmp_path / "index")
    for first in (0, 10, 20):
        df = spark.createDataFrame([(first + i, [float(first + i), 1.0]) for i in range(10)], "k INT, v ARRAY<DOUBLE>").repartition(3)
        S.build_vector_index(df, path, vector="v", dim=2, overwrite=False)
    rows = spark.read.parquet(path).collect()
    assert len({r.id for r in rows}) == 30 and {(r.k, r.v[0]) for r in rows} == {(k, float(k)) for k in range(30)}


def test_bad_lines_are_skipped_or_kept(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"task": "t", "metrics": {"r2": 1}}\n\n   \n{"task": \n{"task": "u"} tail\n')
    good = S.read_jsonl_lenient(spark, str(tmp_path / "log"))
    assert [(r.task, r.metrics) for r in good.collect()] == [("t", {"r2": 1.0})]
    assert S.read_jsonl_lenient(spark, str(tmp_path / "log"), keep_bad=True).where("bad_line IS NOT NULL").count() == 2


def test_reset_empties_the_log(spark, tmp_path):
    path, df = str(tmp_path / "log"), spark.createDataFrame([("m",)], "model STRING")
    S.append_jsonl(df, path)
    S.append_jsonl(df, path)
    assert S.read_jsonl_lenient(spark, path).count() == 2
    S.append_jsonl(df, path, reset=True, now=0.0)
    rows = S.read_jsonl_lenient(spark, path).collect()
    assert [(r.model, r.timestamp) for r in rows] == [("m", 0.0)] and len(rows[0].date) == 19


def test_text_folder_is_read_recursively_and_whole(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("one\ntwo\n")
    (tmp_path / "a" / "b" / "y.md").write_text("deep")
    rows = {r.source.rsplit("/", 1)[1]: r.text for r in S.read_text_corpus(spark, str(tmp_path / "a")).collect()}
    assert rows == {"x.txt": "one\ntwo\n", "y.md": "deep"}
    assert S.read_text_corpus(spark, str(tmp_path / "a"), glob="*.md").count() == 1


def test_image_folder(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(b"\x89PNG")
    assert bytes(S.read_binary_images(spark, str(tmp_path)).first().bytes) == b"\x89PNG"


def test_index_checks_its_dimension(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="expected 2 dimensions, got 1"):
        S.build_vector_index(df, str(tmp_path / "i"), vector="v", dim=2)


def test_replication_to_fewer_and_more_rows(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    for n in (0, 3, 5, 12):
        rows = S.replicate_to(df, n=n, key="k").collect()
        assert sorted((r.row_no, r.k) for r in rows) == [(i, i % 5) for i in range(n)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_gate_and_types(spark):
    df = spark.createDataFrame([(1, "a", 1.0, True)], "i INT, s STRING, d DOUBLE, b BOOLEAN")
    kinds = {r.column: r.kind for r in P.profile_types(df).collect()}
    assert kinds == {"i": "numeric", "s": "categorical", "d": "numeric", "b": "other"}
    strict = {r.column: r.kind for r in P.profile_types(df, rule="strict64").collect()}
    assert strict == {"i": "categorical", "s": "categorical", "d": "numeric", "b": "categorical"}


def test_a_file_per_text_as_the_text_writer_leaves_them(spark, tmp_path):
    rows = [("a b", "x\ny"), ("a=b/c", "two\n"), (None, "none"), ("", ""), ("ü", None), ("a b", "x\ny")]
    df = spark.createDataFrame(rows, "source STRING, text STRING")
    df.write.option("maxRecordsPerFile", 1).partitionBy("source").text(f"{tmp_path}/spark")
    S.write_text_corpus(df, f"{tmp_path}/own", text="text", by="source")
    found = [sorted((r.source.split("/")[-2], r.text) for r in S.read_text_corpus(spark, f"{tmp_path}/{k}").collect()) for k in ("spark", "own")]
    assert len(found[1]) == len(rows) and found[0] == found[1]


def test_pages_are_made_once_for_an_export(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def page(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    S.export_pages(spark.range(50).repartition(4).mapInArrow(page, "id long"), f"{tmp_path}/pages", by=["id"])
    assert made.value == 50 and sorted(r.id for r in spark.read.parquet(f"{tmp_path}/pages").collect()) == list(range(50))
    assert [p.name for p in tmp_path.iterdir()] == ["pages"]


def test_text_folders_are_read_without_an_index_in_the_driver(spark, tmp_path, monkeypatch):
    import bz2
    import gzip
    import zlib

    top = tmp_path / "a b" / "c%20ü=x"
    files = {
        "x y%é+.txt": b"one\xff\n", "empty": b"", "_h/in": b"h", "_k=1/in": b"k", ".q/in": b"q", ".hid": b"h", "_hid": b"h", "_x=y": b"xy", "_metadata": b"m",
        "z.gz": gzip.compress(b"gz") + gzip.compress(b"2"), "Z.BZ2": bz2.compress(b"bz"), "z.deflate": zlib.compress(b"de"), "s/bom": b"\xef\xbb\xbfbom\r\n",
        "s/w._COPYING_": b"c", "s/t/u/v": b"deep", "s/[q] {r};'#~": b"marks\x00",
    }
    for name, data in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(data)
    (tmp_path / "a b" / "_top").mkdir()
    (tmp_path / "a b" / "_top" / "f").write_text("under a hidden root")

    def rows(df):
        return sorted((r.source, bytes(r.text)) for r in df.selectExpr("source", "cast(text AS binary) AS text").collect())

    cases = [(str(tmp_path / "a b"), None), (str(tmp_path / "a*" / "*x"), "{x,z}*"), (str(top / "z.gz"), None), (str(tmp_path / "a b" / "_top"), None), (str(tmp_path), "*.nothing")]
    expected = [rows(S._indexed_texts(spark, [p], g)) for p, g in cases]
    assert len(expected[0]) >= 8 and expected[1] and expected[3] and not expected[4]
    monkeypatch.setattr(S, "_indexed_texts", None)
    for batch in (S.LISTED, 2):
        monkeypatch.setattr(S, "LISTED", batch)
        assert [rows(S.read_text_corpus(spark, p, glob=g)) for p, g in cases] == expected


def test_a_text_folder_that_is_missing_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_text_corpus(spark, str(tmp_path / "none"))
