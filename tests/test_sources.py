from pyspark.sql import functions as F

from lumigraph.sources import blobs, cdx, files, sinks
from lumigraph.streaming import running

PAGES = {None: ([("20200101000000", "https://a.example/"), ("20200202000000", "https://a.example/")], "k1"), "k1": ([("20200303000000", "https://a.example/")], None)}


def fetch(params):
    assert params["from"] in (2020, 2021)
    return PAGES[params["resumeKey"]] if params["from"] == 2020 else ([], None)


def test_csv_dialects(spark, tmp_path):
    p = str(tmp_path / "s.csv")
    open(p, "w").write("url,category\n https://a.example ,\n,x\nhttps://b.example,art\n")
    assert sorted(tuple(r) for r in files.read_seeds(spark, p).collect()) == [("https://a.example", "uncategorized", "uncategorized"), ("https://b.example", "art", "uncategorized")]
    assert files.read_sites(spark, p).columns == ["url", "sector", "subsector", "organization_name"]
    assert files.read_sites_by_position(spark, p).count() == 2
    assert files.read_csv_or_empty(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    assert files.read_merged_csv(spark, [p]).select("source_file").distinct().first()[0] == "s.csv"
    t = str(tmp_path / "u.txt")
    open(t, "w").write("https://c.example\n# no\n\nhttps://d.example\nhttps://c.example\n")
    assert [r["url"] for r in files.read_url_list(spark, t, ["https://d.example"]).orderBy("pos").collect()] == ["https://d.example", "https://c.example"]


def test_json_and_images(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"file_hash": "x", "stored_filename": "image_7.jpg"}')
    (tmp_path / "j" / "b.json").write_text("{bad")
    df = files.read_json_folder(spark, str(tmp_path / "j"), "file_hash string, stored_filename string")
    n, seen = files.resume_state(df)
    assert n == 7 and seen.count() == 1
    d = tmp_path / "i" / "2021" / "0_real"
    d.mkdir(parents=True)
    (d / "x.png").write_bytes(b"1")
    found = files.image_files(spark, str(tmp_path / "i"))
    assert files.years_of(found).first()["year"] == 2021
    assert files.labelled_files(found, "train").first()["class"] == 0
    assert files.latest(spark, str(tmp_path / "j" / "*.json")).endswith("b.json")
    assert files.latest(spark, str(tmp_path / "j" / "*.none")) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b c", 1), ("d", 2)], "k string, a int")
    sinks.write_csv(df, str(tmp_path / "c"), union_header=True)
    assert spark.read.option("header", True).option("sep", "|").csv(str(tmp_path / "c")).columns == ["a", "k"]
    assert not sinks.write_csv_if_any(df.limit(0), str(tmp_path / "n"))
    sinks.append_jsonl(df, str(tmp_path / "l"))
    sinks.append_jsonl(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    p = str(tmp_path / "t")
    assert sinks.replace_table(spark, df, p) == "" and sinks.replace_table(spark, df.limit(1), p) == p + ".bak"
    assert spark.read.parquet(p).count() == 1 and spark.read.parquet(p + ".bak").count() == 2
    sinks.write_partitioned(df, str(tmp_path / "p"), ["k"], 2)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert sinks.union_of([df, spark.createDataFrame([(1,)], "z int")]).columns == ["a", "k", "z"]


def test_blobs(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "root.csv").write_text("image,class\nf/x.bin,1\n")
    (tmp_path / "f" / "x.bin").write_bytes(b"\x00\x01")
    store = str(tmp_path / "store")
    blobs.put_files(spark, str(tmp_path / "f"), store, str(tmp_path))
    assert blobs.get(spark, store, "f/x.bin") == b"\x00\x01" and blobs.get(spark, store, "none") is None
    all_ = blobs.blobs(spark, store)
    assert blobs.csv_rows(all_, "f/root.csv", "image string, class int").first()["class"] == 1
    assert {r["key"] for r in blobs.csv_closure(spark, all_, ["f/root.csv"]).collect()} >= {"f/root.csv", "f/x.bin"}
    new = spark.createDataFrame([("f/x.bin", bytearray(b"2"))], "key string, value binary")
    assert {r["key"]: r["status"] for r in blobs.verify(all_, blobs.merged(all_, new)).collect()} == {"f/root.csv": "same", "f/x.bin": "different"}


def test_cdx(spark):
    df = cdx.read_cdx(spark, ["https://a.example/"], 2020, 2021, "tests.test_sources:fetch")
    assert [r["timestamp"] for r in df.orderBy("timestamp").collect()] == ["20200101000000", "20200202000000", "20200303000000"]
    assert df.filter("year = 2021").count() == 0
    wanted = spark.createDataFrame([("https://a.example/", "20200201000000")], "original string, wanted_ts string")
    assert cdx.nearest(df, wanted).first()["nearest_ts"] == "20200202000000"


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, value double")
    df.write.parquet(src)
    stream = lambda: running.file_stream(spark, src, df.schema, 10).filter(F.col("value") > 0)
    running.run_available(stream(), out, ck)
    df.write.mode("append").parquet(src)
    running.run_available(stream(), out, ck)
    assert spark.read.parquet(out).count() == 4
