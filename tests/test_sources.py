import datetime
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.operators import triple_lock as tl
from vacanta.operators.match import classify_group, match_keywords
from vacanta.operators.prepare import text_date_bounds
from vacanta.operators.running import running_total
from vacanta.plans import catalog_jobs
from vacanta.plans.views import TEST_DICTIONARY, ads
from vacanta.sources import io
from vacanta.plans.jobs import run_export, run_incremental
from vacanta.sources.incremental import partition_digests, process_stale, stale_partitions, with_language
from vacanta.sources.staging import stage, staging_dir
from vacanta.sources.supertypes import NoCommonType, common_type
from vacanta.streaming import classify as classify_module
from vacanta.streaming.classify import run_available


def test_staging_needs_a_shared_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_stage_round_trip(spark):
    df = spark.range(10).withColumn("a", F.array(F.struct(F.col("id").alias("x"))))
    staged = stage(df, "t")
    assert staged.schema.simpleString() == df.schema.simpleString()
    assert staged.count() == 10
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in staged.inputFiles())


def test_ingest_takes_new_files_and_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ndjson").write_text('{"x": 1}\nnot json\n{"x": 2}\n')
    target, pattern = str(tmp_path / "out"), str(tmp_path / "in/*.ndjson")
    assert io.ingest_ndjson(spark, pattern, target, "x int").count() == 2
    (tmp_path / "in/b.ndjson").write_text('{"x": 3}\n')
    (tmp_path / "in/c.ndjson").write_text("{oops\n")
    (tmp_path / "in/d.ndjson").write_text("")
    for _ in range(2):
        assert sorted(r.x for r in io.ingest_ndjson(spark, pattern, target, "x int").collect()) == [1, 2, 3]
    told = {r.file[-8]: (r.n_rows, r.n_bad) for r in io.ingested_files(spark, target).collect()}
    assert told == {"a": (2, 1), "b": (1, 0), "c": (0, 1), "d": (0, 0)}
    assert sorted(r.line for r in io.bad_lines(spark, target).collect()) == ["not json", "{oops"]


def test_a_file_delivered_again_replaces_its_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "in it").mkdir()
    monkeypatch.setattr(io, "FILES_AT_ONCE", 2)
    target, pattern = str(tmp_path / "out"), str(tmp_path / "in it/*.ndjson")
    for name, text in (("a", '{"x": 1}\n{bad\n'), ("b", '{"x": 2}\n'), ("c", '{"x": 3}\n'), ("d e", '{"x": 4}\n'), ("f", '{"x": 5}\n')):
        (tmp_path / f"in it/{name}.ndjson").write_text(text)
    rows = lambda: sorted(r.x for r in io.ingest_ndjson(spark, pattern, target, "x int").collect())
    assert rows() == [1, 2, 3, 4, 5] and io.bad_lines(spark, target).count() == 1
    parts = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "out/rows").glob("source=*/*.parquet")}
    before = parts()
    assert rows() == [1, 2, 3, 4, 5] and parts() == before
    # Other rows, other bad lines, and nothing at all under the old names.
    (tmp_path / "in it/a.ndjson").write_text('{"x": 10}\n{"x": 11}\n')
    (tmp_path / "in it/b.ndjson").write_text("")
    assert rows() == [3, 4, 5, 10, 11] and io.bad_lines(spark, target).count() == 0
    told = {r.file.rsplit("/", 1)[1][:1]: (r.n_rows, r.n_bad) for r in io.ingested_files(spark, target).collect()}
    assert told == {"a": (2, 0), "b": (0, 0), "c": (1, 0), "d": (1, 0), "f": (1, 0)}
    assert {f: t for f, t in parts().items() if f in before} == before


def test_shards_of_two_integer_types(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1,)], "x int").write.parquet(a)
    spark.createDataFrame([(2**40, "y")], "x bigint, y string").write.parquet(b)
    out = io.scan_shards(spark, a, b)
    assert out.schema.simpleString() == "struct<x:bigint,y:string>"
    assert {r.x: r.y for r in out.collect()} == {1: None, 2**40: "y"}


@pytest.mark.parametrize(
    ("a", "b", "both"),
    [
        ("int", "bigint", "bigint"), ("bigint", "string", "string"), ("tinyint", "float", "float"), ("int", "float", "double"), ("boolean", "int", "int"),
        ("boolean", "string", "string"), ("date", "timestamp", "timestamp"), ("date", "string", "string"), ("int", "decimal(5,2)", "decimal(12,2)"),
        ("decimal(38,0)", "decimal(10,5)", "double"), ("void", "date", "date"), ("string", "binary", "binary"), ("date", "int", "string"),
        ("array<int>", "array<string>", "array<string>"), ("struct<x:int,y:date>", "struct<z:int,x:bigint>", "struct<x:bigint,y:date,z:int>"),
        ("map<int,array<struct<a:int>>>", "map<bigint,array<struct<a:string,b:date>>>", "map<bigint,array<struct<a:string,b:date>>>"),
        ("struct<x:int>", "string", None), ("array<int>", "int", None), ("binary", "int", None), ("struct<x:array<int>>", "struct<x:map<int,int>>", None),
    ],
)
def test_common_types(spark, a, b, both):
    kinds = [T._parse_datatype_string(x) if x != "void" else T.NullType() for x in (a, b)]
    for x, y in (kinds, kinds[::-1]):
        if both is None:
            with pytest.raises(NoCommonType, match="here"):
                common_type(x, y, "here")
        else:
            found = common_type(x, y, "here")
            wanted = T._parse_datatype_string(both)
            assert found == wanted or {f.name: f.dataType for f in found.fields} == {f.name: f.dataType for f in wanted.fields}


def test_shards_of_conflicting_types(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in "abc")
    spark.createDataFrame([(1, (5, None), [1], {"k": 1}, True), (None, None, None, None, None)], "x bigint, s struct<p:int,q:string>, l array<int>, m map<string,int>, f boolean").write.parquet(a)
    spark.createDataFrame([("one", ("six", 7), [2.5, None], {"k": "v"}, 3)], "X string, s struct<p:string,r:int>, l array<double>, m map<string,string>, f int").write.parquet(b)
    spark.createDataFrame([(1,)], "other int").write.parquet(c)
    out = io.scan_shards(spark, a, b, c)
    assert out.schema.simpleString() == "struct<x:string,s:struct<p:string,q:string,r:int>,l:array<double>,m:map<string,string>,f:int,other:int>"
    rows = sorted((tuple(r) for r in out.collect()), key=str)
    nothing = (None, None, None, None, None)
    assert rows == sorted([("1", ("5", None, None), [1.0], {"k": "1"}, 1, None), (*nothing, None), ("one", ("six", None, 7), [2.5, None], {"k": "v"}, 3, None), (*nothing, 1)], key=str)
    plan = out.where("f > 2").select("x")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<X:string,f:int>" in plan


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_reports_in_every_kind(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "n int, names array<string>")
    io.write_report(df, str(tmp_path / "r"), kind)
    back = spark.read.option("header", True).format(kind).load(str(tmp_path / "r"))
    assert sorted(int(r.n) for r in back.collect()) == [1, 2]
    with pytest.raises(ValueError, match="unknown"):
        io.write_report(df, str(tmp_path / "x"), "xlsx")


def test_dynamic_overwrite_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_by(spark.createDataFrame([(1, 2020), (2, 2021)], "v int, year int"), path, "year")
    io.write_by(spark.createDataFrame([(3, 2021)], "v int, year int"), path, "year")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("v", "year").collect()) == [(1, 2020), (3, 2021)]


def test_nothing_stale_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    src = spark.createDataFrame([(1, 2020), (2, 2021)], "v int, year int")
    process_stale(src, None, "year", lambda d: d, path)
    before = sorted(spark.read.parquet(path).inputFiles())
    process_stale(src, spark.read.parquet(path), "year", lambda d: d, path)
    assert sorted(spark.read.parquet(path).inputFiles()) == before
    assert stale_partitions(src, spark.read.parquet(path), "year").count() == 0


def test_changed_content_and_null_partitions_are_redone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "a", 2020), (2, "b", 2020), (3, "c", None), (4, None, None), (5, "e", 2021)]
    frame = lambda some: spark.createDataFrame(some, "id int, text string, year int")
    redone = lambda some: sorted((str(r.year), r.n_source, r.n_done) for r in run_incremental(frame(some), lambda d: d, path).collect())
    back = lambda: sorted((r.id, r.text, r.year) for r in spark.read.parquet(path).collect())
    assert redone(rows) == [("2020", 2, None), ("2021", 1, None), ("None", 2, None)]
    assert back() == sorted(rows) and redone(rows[::-1]) == []
    # An equal number of rows, another text; nulls that move to another column are a change too.
    rows[2] = (3, "changed", None)
    assert redone(rows) == [("None", 2, 2)] and back() == sorted(rows)
    rows[1] = (2, None, 2020)
    assert redone(rows) == [("2020", 2, 2)] and back() == sorted(rows) and redone(rows) == []
    # Output that was lost is redone although the digest is there.
    part = next(f for f in (tmp_path / "t/year=2021").iterdir() if f.name.startswith("part"))
    io.write_by(frame([]), path, "year")
    spark.createDataFrame([(5, "e"), (6, "f")], "id int, text string").write.mode("overwrite").parquet(str(tmp_path / "t/year=2021"))
    assert part and redone(rows) == [("2021", 1, 2)] and back() == sorted(rows)


def test_text_partitions_keep_their_type(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, "01"), (2, "1"), (3, ""), (4, None)], "id int, part string")
    assert sorted((str(r.part), r.n_source) for r in run_incremental(frame, lambda d: d, path, "part").collect()) == [("01", 1), ("1", 1), ("None", 2)]
    assert run_incremental(frame, lambda d: d, path, "part").count() == 0


def test_postings_without_a_date_are_exported(spark, tmp_path):
    rows = [(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 2)), (3, None)]
    postings = spark.createDataFrame(rows, "id int, ts timestamp")
    for _ in range(2):
        out = run_export(postings, lambda d: d, str(tmp_path / "x"), "ts").first()
        assert (out.expected, out.exported, out.complete) == (3, 3, True)


def test_digests_do_not_depend_on_order_but_on_content(spark):
    kinds = "p int, m map<string,int>, a array<int>, s struct<x:int,y:map<int,string>>"

    def digest(rows, turn=False):
        df = spark.createDataFrame(rows, kinds).repartition(3)
        df = df.select("s", "a", "m", "p") if turn else df
        return {r.p: (r.n_source, r.total, r.parity) for r in partition_digests(df, "p").collect()}

    rows = [(1, {"a": 1, "b": 2}, [1, None], (1, {1: "x", 2: "y"})), (1, None, [None, 1], None), (None, {}, [], (None, {}))]
    first = digest(rows)
    assert first == digest(rows[::-1], turn=True) == digest([(1, {"b": 2, "a": 1}, [1, None], (1, {2: "y", 1: "x"})), *rows[1:]])
    for other in ((1, {"a": 1, "b": 3}, [1, None], (1, {1: "x", 2: "y"})), (1, {"a": 1, "b": 2}, [None, 1], (1, {1: "x", 2: "y"})), (1, {"a": 1, "b": 2}, [1, None], (1, {1: "x", 2: None}))):
        assert digest([other, *rows[1:]])[1] != first[1]
    # A row that is there twice is told from one that is not there at all.
    assert digest([rows[0], rows[1], rows[1], rows[1]])[1] != first[1]


def test_language_tag_is_kept(spark):
    df = spark.createDataFrame([("de", "fr")], "language string, detected_language string")
    assert with_language(df).first().detected_language == "fr"
    assert with_language(df.drop("detected_language")).first().detected_language == "de"


def test_crosswalk_files(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("ISCO_version,unit,description\nISCO-08,111, Führung – € \nISCO-88,111,x\n".encode("cp1252"))
    assert [tuple(r) for r in io.read_isco_titles(spark, str(tmp_path / "t.csv")).collect()] == [(111, "Führung – €")]
    (tmp_path / "m.csv").write_text("id (x),name (x),code (A),name (A),name (Catalogue)\n5,Koch,7,K,2020\n")
    assert [tuple(r) for r in io.read_occupation_map(spark, str(tmp_path / "m.csv")).collect()] == [(5, "Koch", 7, "2020")]


def test_stream_equals_batch_and_resumes(spark, sf_dir, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    made = ads(spark, sf_dir).select(
        "ad_id", "text", "language", F.make_timestamp("year", "month", F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("created"), "year"
    ).withColumn("copy", F.concat("language", F.md5("text")))

    def arrive(df):
        df.coalesce(1).write.mode("append").parquet(source)
        run_available(spark, source, made.schema, target, marks, TEST_DICTIONARY, "copy", "created").awaitTermination()
        return spark.read.parquet(target)

    first = arrive(made.where("year <= 2020")).count()
    assert 0 < first <= made.where("year <= 2020").count()
    out = arrive(made.where("year > 2020"))
    batch = classify_group(match_keywords(made.dropDuplicates(["copy"]), TEST_DICTIONARY))
    want = sorted((r.copy, r.group, r.matched_group_keywords) for r in batch.select("copy", "group", "matched_group_keywords").collect())
    got = sorted((r.copy, r.group, r.matched_group_keywords) for r in out.select("copy", "group", "matched_group_keywords").collect())
    assert got == want


def test_stream_keeps_null_keys_and_late_postings(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "id int, text string, language string, copy string, created timestamp"

    def arrive(rows):
        df = spark.createDataFrame([(i, "tion", "en", k, datetime.datetime(2024, m, d)) for i, k, m, d in rows], schema)
        df.coalesce(1).write.mode("append").parquet(source)
        run_available(spark, source, df.schema, target, marks, TEST_DICTIONARY, "copy", "created").awaitTermination()
        return {r.id for r in spark.read.parquet(target).collect()}

    assert arrive([(1, None, 6, 1), (2, None, 6, 1), (3, "a", 6, 2), (4, "a", 6, 1)]) == {1, 2, 4}
    assert arrive([(5, "b", 1, 1), (6, "a", 1, 1), (7, None, 1, 1), (8, "c", 6, 3)]) == {1, 2, 4, 5, 7, 8}
    told = sorted((r.n_read, r.n_written, r.n_duplicates, r.n_late) for r in spark.read.parquet(f"{target}-report").collect())
    assert told == [(4, 1, 1, 2), (4, 3, 1, 0)]


def test_a_batch_reads_its_own_files_and_no_written_posting(spark, tmp_path):
    """Keys come from the state store: a later batch works although all written postings are out of reach."""
    source, target, marks = (str(tmp_path / n) for n in ("in folder", "out", "marks"))
    schema = "id int, text string, language string, copy string, created timestamp"

    def arrive(rows):
        df = spark.createDataFrame([(i, "tion", "en", k, datetime.datetime(2024, 6, 1)) for i, k in rows], schema)
        df.coalesce(1).write.mode("append").parquet(source)
        query = run_available(spark, source, df.schema, target, marks, TEST_DICTIONARY, "copy", "created")
        query.awaitTermination()
        return query.lastProgress

    arrive([(i, f"k{i}") for i in range(200)])
    (tmp_path / "out/batch=0").rename(tmp_path / "moved")
    told = arrive([(1000, "k5"), (1001, "new"), (1002, None), (1003, "new")])
    written = spark.read.parquet(f"{target}/batch=1").collect()
    assert sorted(r.id for r in written if r.id != 1003) == [1001, 1002] or sorted(r.id for r in written) == [1002, 1003]
    assert len(written) == 2
    (state,) = told.stateOperators
    # One narrow row per key and per file; the batch touched four of them.
    assert state.numRowsTotal == 200 + 1 + 2 and state.numRowsUpdated == 3
    assert "rocksdb" in str(state.customMetrics).lower()


def test_a_repeated_batch_writes_the_same(spark, tmp_path, monkeypatch):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "id int, text string, language string, copy string, created timestamp"
    df = spark.createDataFrame([(i, "tion", "en", f"k{i % 5}", datetime.datetime(2024, 6, 1 + i)) for i in range(20)], schema)
    df.coalesce(2).write.parquet(source)
    stop = classify_module.unstage
    monkeypatch.setattr(classify_module, "unstage", lambda *_: 1 / 0)
    with pytest.raises(Exception, match="division"):
        run_available(spark, source, df.schema, target, marks, TEST_DICTIONARY, "copy", "created").awaitTermination()
    monkeypatch.setattr(classify_module, "unstage", stop)
    run_available(spark, source, df.schema, target, marks, TEST_DICTIONARY, "copy", "created").awaitTermination()
    assert sorted((r.id, r.batch) for r in spark.read.parquet(target).collect()) == [(i, 0) for i in range(5)]
    assert [(r.n_read, r.n_written, r.n_duplicates) for r in spark.read.parquet(f"{target}-report").collect()] == [(20, 5, 15)]


def test_old_counts_are_refused_and_recounted(spark, tmp_path):
    path = str(tmp_path / "counts")
    ads = spark.createDataFrame([(2024, 1, "en", "x", [("en", "k", 1)])], "year int, month int, language string, text string, matches array<struct<bucket:string,keyword:string,`group`:int>>")
    old = tl.monthly_counts(ads).withColumn("format_version", F.lit(tl.COUNTS_FORMAT_VERSION - 1))
    old.write.parquet(path)
    with pytest.raises(Exception, match="old format"):
        tl.check_counts_version(spark.read.parquet(path)).select("year", "n").collect()
    assert tl.reusable_counts(ads, path).select("n").first().n == 1
    assert spark.read.parquet(path).first().format_version == tl.COUNTS_FORMAT_VERSION
    tl.reusable_counts(ads.where("false"), path)
    assert spark.read.parquet(path).count() == 1


def test_only_changed_months_are_counted(spark, tmp_path):
    path = str(tmp_path / "counts")
    kinds = "year int, month int, language string, text string, matches array<struct<bucket:string,keyword:string,`group`:int>>"
    hit = lambda *names: [("en", n, 1) for n in names]
    rows = [(2024, 1, "en", "x", hit("a")), (2024, 1, "en", "y", hit("a", "b")), (2024, 2, "en", "x", hit("a")), (2024, None, "de", "x", hit("c")), (None, None, "de", "x", hit("d"))]

    def run(some, dictionary="one"):
        got = tl.reusable_counts(spark.createDataFrame(some, kinds), path, dictionary)
        assert got.columns == ["year", "month", "bucket", "keyword", "n", "month_total", "language_total", "format_version"]
        plain = tl.monthly_counts(spark.createDataFrame(some, kinds))
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.select(got.columns).collect()))
        return {f.parent.name: f.name for f in (tmp_path / "counts").glob("period=*/part-*.parquet")}

    first = run(rows)
    assert set(first) == {"period=202400", "period=202401", "period=202402"} | ({"period=__HIVE_DEFAULT_PARTITION__"} & set(first))
    assert run(rows[::-1]) == first
    more = run([*rows, (2024, 3, "fr", "x", hit("a"))])
    assert {k: more[k] for k in first} == first and set(more) - set(first) == {"period=202403"}
    # A month whose postings match nothing any more, and one that is gone.
    rows[2] = (2024, 2, "en", "x", [])
    other = run(rows)
    assert {k for k in other if other[k] != more.get(k)} == {"period=202402"}
    again = run(rows, "two")
    assert not set(again.values()) & {other[k] for k in again if k != "period=202403"}


def test_running_total_in_ranges(spark):
    rows = [(i * 7919 % 1000, i % 13 if i % 5 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(6)
    total, expected = 0, {}
    for k, v in sorted(rows, reverse=True):
        total += v or 0
        expected[k] = total
    out = running_total(df, F.col("k").desc(), "v", "total")
    assert {r.k: r.total for r in out.collect()} == expected
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert running_total(df.where("false"), F.col("k"), "v", "total").count() == 0


def test_date_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "ads")
    spark.createDataFrame([("2024-01-05 10:00:00 UTC", 1), ("2024-02-01 00:00:00", 2), ("2023-12-31 23:59:59.5", 3)], "tst_created string, x int").write.parquet(path)
    df = text_date_bounds(spark.read.parquet(path), "tst_created", "2024-01-01", "2024-01-31")
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(tst_created,2023-12-31)" in plan and "LessThan(tst_created,2024-02-03)" in plan
    assert {r.x for r in df.collect()} == {1, 2, 3}
    assert text_date_bounds(df, "x", "2024-01-01", None) is df


def test_dictionary_documents_are_bounded(spark, sf_dir, monkeypatch):
    """Many documents instead of one, and the same result."""
    whole = sorted(map(tuple, catalog_jobs.dictionary_files(spark, sf_dir).collect()))
    n, folders = sum(r[2] for r in whole if r[0] == "validated"), []
    for name in ("read_validated", "read_translations"):
        read = getattr(catalog_jobs, name)
        monkeypatch.setattr(catalog_jobs, name, lambda session, path, read=read: folders.append(path) or read(session, path))
    monkeypatch.setattr(catalog_jobs, "DOCUMENT", 10, raising=False)
    assert sorted(map(tuple, catalog_jobs.dictionary_files(spark, sf_dir).collect())) == whole
    documents = [[json.loads(r.value) for r in spark.read.text(folder).collect()] for folder in folders]
    sizes = [[len(d["keywords"]) for d in documents[0]], [sum(len(x["keywords"]) for x in d["translations"]["de"].values()) for d in documents[1]]]
    assert all(sum(x) == n and max(x) <= 40 for x in sizes)
