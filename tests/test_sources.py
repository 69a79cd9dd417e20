import os

from lodestat.sources import tables


def test_latin_1_falls_back_and_columns_are_chosen(spark, tmp_path):
    p = str(tmp_path / "a.csv")
    with open(p, "wb") as f:
        f.write("id,name,x\n1,Jos\xe9,2\n".encode("latin-1"))
    assert [tuple(r) for r in tables.read_csv(spark, p, ["name", "id"]).collect()] == [("José", "1")]
    with open(p, "wb") as f:
        f.write("id,name,x\n1,José,2\n2,b,3\n".encode())
    assert tables.read_csv(spark, p, ["name"]).first()[0] == "José"
    assert tables.read_csv(spark, p, ["name"], limit=1).count() == 1


def test_encoding_and_records_are_decided_on_bytes(spark, tmp_path):
    def read(data, name="b.csv"):
        p = str(tmp_path / name)
        with open(p, "wb") as f:
            f.write(data)
        return tables.text_form(spark, p), [tuple(r) for r in tables.read_csv(spark, p, ["id", "name"]).collect()]

    assert read("id,name\n1,a\ufffdb\n".encode()) == (("UTF-8", False), [("1", "a\ufffdb")])
    assert read("id,name\n1,é\ufffd\n".encode()[:-2] + b"\n") == (("ISO-8859-1", False), [("1", "Ã©ï¿")])
    assert read('id,name\n1,"two\nlines"\n2,"say ""x"""\n'.encode()) == (("UTF-8", True), [("1", "two\nlines"), ("2", 'say "x"')])
    assert read('id,name\n1,"say ""x"""\n2,\n'.encode()) == (("UTF-8", False), [("1", 'say "x"'), ("2", None)])
    assert read(b"id,name\n1,caf\xe9\n2,\"a\nb\"\n") == (("ISO-8859-1", True), [("1", "café"), ("2", "a\nb")])
    assert read(b"id,name\n") == (("UTF-8", False), [])


def test_large_files_of_plain_records_are_split(spark, tmp_path):
    p = str(tmp_path / "c.csv")
    with open(p, "w") as f:
        f.write("id,name\n" + "".join(f"{i},name {i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = tables.read_csv(spark, p, ["id"])
        assert df.rdd.getNumPartitions() > 3 and df.agg({"id": "count"}).first()[0] == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_results_read_back_as_written(spark, tmp_path):
    p = str(tmp_path / "out")
    rows = [("NA", 0.1 + 0.2, None), ('say "None", twice', 1e-300, "x"), (None, 123456789.123456789, "None")]
    df = spark.createDataFrame(rows, "a string, b double, c string")
    tables.write_csv(df, p, order=["b"], one_file=True)
    assert len([f for f in os.listdir(p) if f.endswith(".csv")]) == 1
    assert sorted(map(str, (tuple(r) for r in tables.read_exact(spark, p, df.schema).collect()))) == sorted(map(str, rows))
    assert tables.read_optional(spark, str(tmp_path / "none"), "a string").count() == 0


def test_cache_follows_its_source(spark, tmp_path):
    source, cache, made = str(tmp_path / "s.csv"), str(tmp_path / "cache"), []
    os.mkdir(cache)

    def build():
        made.append(1)
        return spark.read.option("header", True).csv(source)

    for text, rows, builds in (("a\n1\n", 1, 1), ("a\n1\n", 1, 1), ("a\n1\n22\n", 2, 2)):
        if not os.path.exists(source) or open(source).read() != text:
            open(source, "w").write(text)
        assert tables.cached(spark, source, cache, build).count() == rows and len(made) == builds
    assert len(os.listdir(cache)) == 1


def test_json_and_renamed_reference(spark, tmp_path):
    p = str(tmp_path / "m.json")
    tables.write_json(spark, {"a": {"b": 1}}, p, "orders")
    assert tables.read_json(spark, p) == {"data_source": "orders", "a": {"b": 1}}
    c = str(tmp_path / "d.csv")
    open(c, "w").write("id,rec,CCF\n7,0.5,0.25\n")
    assert tables.read_defaults(spark, c, {"id": "id", "CCF": "ccf"}).first().asDict() == {"id": "7", "ccf": "0.25"}
