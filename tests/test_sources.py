"""Files, catalogue, collections, row preparation and ingest."""

import os
import shutil
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trove.functions.models import FunctionEmbedder, HashEmbedder
from trove.operators import prep
from trove.session import shared_dir, sized, small_side, spread, stored
from trove.sources import catalog, collections, files, statements
from trove.streaming import ingest


@pytest.fixture
def name():
    return f"made_{uuid.uuid4().hex}"


def test_ragged_csv_is_flagged(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text("emb,desc,schema,table_name\n1,2,3,4,5,6,7\n1\na,b,c,d\n")
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in ("emb", "desc", "schema", "table_name")]
    )
    rows = stored(files.read_csv(spark, str(path), schema)).collect()
    flagged = [r for r in rows if r[files.CORRUPT] is not None]
    assert len(rows) == 3 and len(flagged) == 2
    filled = prep.fill_missing(files.read_csv(spark, str(path), schema).drop(files.CORRUPT))
    assert filled.where("desc = 'missing-data'").count() == 1


def test_inferred_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a,\"b\"\nc")], "id int, price double, text string")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"))
    assert dict(back.dtypes) == {"id": "int", "price": "double", "text": "string"}
    assert back.first()["text"] == "a,\"b\"\nc"


def test_jdbc_options():
    options = files.jdbc_options("jdbc:x:y", "t", "id", 0, 99, 4, user="u")
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "4"
    assert options["lowerBound"] == "0" and options["user"] == "u"
    assert "partitionColumn" not in files.jdbc_options("jdbc:x:y", "t")
    with pytest.raises(ValueError):
        files.jdbc_options("jdbc:x:y", "t", "id")


BAD_STATEMENTS = [
    "DROP TABLE x",
    "SELECT 1; SELECT 2",
    "insert into t values (1)",
    "WITH t AS (SELECT 5 AS a) INSERT OVERWRITE kept SELECT * FROM t",
    "WITH t AS (SELECT 5 AS a) INSERT INTO seen SELECT * FROM t",
    "FROM seen INSERT INTO kept SELECT *",
    "SELECT * FROM kept",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
    "SELECT 1 FROM seen WHERE a IN (SELECT a FROM kept)",
    "SELECT (SELECT max(a) FROM kept) FROM seen",
    "SELECT 1 FROM seen WHERE EXISTS (SELECT 1 FROM kept)",
    "SELECT * FROM seen, LATERAL (SELECT * FROM kept)",
    "SELECT * FROM (SELECT * FROM seen UNION ALL SELECT * FROM kept)",
    # Without RECURSIVE the inner name is still the table.
    "WITH kept AS (SELECT * FROM kept) SELECT * FROM kept",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
    "SELECT * FROM (WITH kept AS (SELECT 1 AS a) SELECT * FROM kept) x, kept",
    "SELECT * FROM identifier('kept')",
    "SELECT * FROM python_worker_logs()",
    "SELECT java_method('java.lang.System', 'getenv', 'HOME')",
    "SELECT a FROM seen WHERE reflect('java.lang.System', 'gc') IS NULL",
    "CACHE TABLE z AS SELECT 1",
    "EXPLAIN SELECT 1",
    "SET x = 1",
    "BEGIN SELECT 1; END",
    "SELECT TRANSFORM (a) USING 'cat' FROM seen",
    "not sql",
    "",
]
GOOD_STATEMENTS = {
    "SELECT a FROM seen": 3,
    "select A from SEEN;": 3,
    "SELECT ';' AS a FROM seen": 3,
    "WITH kept AS (SELECT 1 AS a) SELECT a FROM kept": 1,
    "WITH t AS (SELECT a FROM seen), u AS (SELECT a FROM t) SELECT a FROM u WHERE a IN (SELECT a FROM t)": 3,
    "WITH RECURSIVE r AS (SELECT 1 AS a UNION ALL SELECT a + 1 FROM r WHERE a < 4) SELECT a FROM r": 4,
    "SELECT a, row_number() OVER w AS n FROM seen WINDOW w AS (ORDER BY a)": 3,
    "SELECT DISTINCT a % 2 AS a FROM seen ORDER BY 1 LIMIT 5 OFFSET 1": 1,
    "SELECT a FROM seen EXCEPT SELECT 1": 2,
    "SELECT a FROM (VALUES (1), (2)) v(a) JOIN seen USING (a)": 2,
    "SELECT count(*) AS a FROM seen GROUP BY a HAVING count(*) > 0": 3,
    "SELECT id AS a FROM range(4)": 4,
    "SELECT x AS a FROM seen LATERAL VIEW explode(array(a, a)) t AS x": 6,
    "FROM seen |> WHERE a > 1": 2,
}


@pytest.fixture(scope="module")
def seen_and_kept(spark):
    spark.range(1, 4).toDF("a").createOrReplaceTempView("seen")
    spark.sql("DROP TABLE IF EXISTS kept")
    spark.range(1).toDF("a").write.saveAsTable("kept")
    yield
    spark.sql("DROP TABLE kept")
    spark.catalog.dropTempView("seen")


@pytest.mark.parametrize("bad", BAD_STATEMENTS)
def test_only_reading_statements_run(spark, seen_and_kept, bad):
    with pytest.raises(statements.Refused):
        files.run_sql(spark, bad)
    assert [r["a"] for r in spark.table("kept").collect()] == [0]


@pytest.mark.parametrize("good", GOOD_STATEMENTS)
def test_reading_statements_run(spark, seen_and_kept, good):
    assert files.run_sql(spark, good).count() == GOOD_STATEMENTS[good]


def test_tables_may_be_listed(spark, seen_and_kept):
    assert files.run_sql(spark, "SELECT * FROM kept", relations=["KEPT"]).count() == 1
    assert files.run_sql(spark, "SELECT * FROM default.kept", relations=["default.kept"]).count() == 1
    for text in ("SELECT * FROM seen", "SELECT * FROM default.kept"):
        with pytest.raises(statements.Refused):
            files.run_sql(spark, text, relations=["kept"])
    assert files.run_sql(spark, "SELECT * FROM default.kept", read_only=False).count() == 1


def test_statement_may_end_with_semicolon(spark):
    assert files.run_sql(spark, "WITH a AS (SELECT 1 AS x) SELECT x FROM a;").first()["x"] == 1


def test_fill_by_type(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, None), (1, float("nan"), 2, "x", True)],
        "a int, b double, c long, d string, e boolean",
    )
    got = [tuple(r) for r in prep.fill_missing(df).collect()]
    assert got == [(0, 0.0, 0, "missing-data", False), (1, 0.0, 2, "x", True)]


def test_prepare_rows_shapes(spark):
    df = spark.createDataFrame([(1, "big red", 2.0)], "id long, desc string, price double")
    assert prep.prepare_rows(df).columns == ["price", "embedding"]
    assert prep.prepare_rows(df, keep_text=True).columns == ["desc", "price", "embedding"]
    sparse = spark.createDataFrame([(1, {"red": 0.5})], "id long, sparse map<string,double>")
    got = prep.prepare_rows(df, exclude=["price"], sparse=sparse)
    assert got.columns == ["id", "sparse", "embedding"] and got.first()["sparse"] == {"red": 0.5}


def test_bad_casts_become_null(spark):
    df = spark.createDataFrame([("1", "x"), ("y", "2.5")], "a string, b string")
    target = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.FloatType())])
    assert [tuple(r) for r in prep.cast_to_schema(df, target).collect()] == [(1, None), (None, 2.5)]


def test_embedders(spark):
    df = spark.createDataFrame([(1, "Red red apple"), (2, ""), (3, None)], "id int, t string")
    for dim in (8, 64, 100):
        rows = {r["id"]: np.array(r["embedding"]) for r in HashEmbedder(dim).embed(df, "t").collect()}
        assert all(len(v) == dim for v in rows.values())
        assert abs(np.linalg.norm(rows[1]) - 1) < 1e-6
        assert not rows[2].any() and not rows[3].any()
    made = FunctionEmbedder(lambda texts: np.array([[len(t), 1.0] for t in texts]), 2)
    assert made.embed(df, "t").orderBy("id").first()["embedding"] == [13.0, 1.0]


def test_hash_embedder_by_hand(spark):
    import hashlib

    df = spark.createDataFrame([(1, "one two two three")], "id int, t string")
    want = np.zeros(64)
    for w in "one two two three".split():
        code = int(hashlib.md5(w.encode()).hexdigest()[:2], 16)
        want[code % 64] += -1 if code >= 128 else 1
    got = HashEmbedder().embed(df, "t").first()["embedding"]
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-7)


def test_collection_life(spark, name):
    fields = T.StructType([T.StructField("price", T.FloatType())])
    schema = collections.collection_schema(fields, hybrid=True)
    collections.create(spark, name, schema, metric="ip", dim=2)
    collections.create(spark, name, schema, if_absent=True)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_ALREADY_EXISTS"):
        collections.create(spark, name, schema)
    collections.insert_row(spark, name, id=1, embedding=[0.5, 1.0], price=2.0)
    extra = spark.createDataFrame(
        [(2, [1.0, 0.0], "9.5", "red", 7)],
        "id long, embedding array<double>, price string, colour string, size int",
    )
    collections.insert(extra, name)
    rows = spark.table(name).orderBy("id")
    assert [r["price"] for r in rows.collect()] == [2.0, 9.5]
    got = rows.select(
        collections.dynamic_field("colour").alias("c"), collections.dynamic_field("size", kind="int").alias("s")
    ).collect()
    assert [tuple(r) for r in got] == [(None, None), ("red", 7)]
    described = {(r["kind"], r["name"]): r["value"] for r in collections.describe(spark, name).collect()}
    assert described["property", "metric"] == "ip" and described["rows", "row_count"] == "2"
    assert name in [r[0] for r in collections.list_collections(spark).collect()]
    collections.set_index(spark, name, "IVF_FLAT")
    assert described["property", "index"] == "AUTOINDEX"
    collections.set_index(spark, name, "IVF_FLAT", replace=True)
    again = {r["name"]: r["value"] for r in collections.describe(spark, name).collect()}
    assert again["index"] == "IVF_FLAT"
    collections.recreate(spark, name, schema)
    assert spark.table(name).count() == 0


def test_product_collection_and_auto_id(spark, name):
    collections.create(spark, name, collections.product_schema(), metric="l2", dim=3)
    rows = spark.createDataFrame(
        [("A", f"P{i}", float(i), [1.0, 2.0, 3.0]) for i in range(50)],
        "store_name string, product_name string, price double, embedding array<double>",
    ).repartition(6)
    for _ in range(3):
        collections.insert(collections.with_auto_id(rows, name), name)
    ids = [r["id"] for r in spark.table(name).select("id").collect()]
    assert len(ids) == len(set(ids)) == 150


def test_catalogue_of_a_database(spark, name):
    spark.createDataFrame([(1, "a")], "k int, v string").write.option(
        "path", f"{shared_dir(spark)}/{name}"
    ).saveAsTable(name)
    tables = catalog.database_tables(spark, "default")
    assert name in tables
    mine = {name: tables[name]}
    assert [tuple(r) for r in catalog.list_columns(mine).collect()] == [
        (name, 1, "k", "int"), (name, 2, "v", "string"),
    ]
    assert catalog.reflect(catalog.list_columns(mine)).first()["columns"] == {"k": "int", "v": "string"}
    near = spark.createDataFrame([(name, [4])], "table_name string, neighbours array<long>")
    card = catalog.cards(
        catalog.list_columns(mine), catalog.list_tables(mine), "default", neighbours=near
    ).first()
    assert card["desc"] == f"Schema for table {name}" and card["access"] == "read-only"
    assert card["neighbours"] == [4] and card["constraints"] is None and card["row_count"] == 1


def test_stream_repeats_without_doubling(spark, tmp_path):
    schema = "doc_id long, text string"
    folder, out, mark = (str(tmp_path / p) for p in ("in", "out", "mark"))
    spark.createDataFrame([(i, f"w{i}") for i in range(20)], schema).repartition(4).write.parquet(folder)
    types = spark.read.parquet(folder).schema
    for _ in range(2):
        ingest.ingest_stream(spark, folder, types, out, "text", files_per_batch=1, checkpoint=mark)
    assert ingest.read_table(spark, out).count() == 20
    spark.createDataFrame([(99, None)], schema).write.mode("append").parquet(folder)
    ingest.ingest_stream(spark, folder, types, out, "text", checkpoint=mark)
    table = ingest.read_table(spark, out)
    assert table.count() == 21 and table.where("text = 'missing-data'").count() == 1
    batch = str(tmp_path / "batch")
    ingest.ingest_batch(spark.read.parquet(folder), batch, "text")
    assert sorted(ingest.read_table(spark, batch).collect()) == sorted(table.collect())


def test_stream_calls_add_up(spark, tmp_path):
    schema = "doc_id long, text string"
    out = str(tmp_path / "out")
    for n, at in ((10, 0), (20, 100)):
        folder = str(tmp_path / f"in{at}")
        spark.createDataFrame([(at + i, f"w{i}") for i in range(n)], schema).write.parquet(folder)
        types = spark.read.parquet(folder).schema
        for size in (1, 1000):
            ingest.ingest_stream(spark, folder, types, out, "text", files_per_batch=size)
    ids = [r["doc_id"] for r in ingest.read_table(spark, out).select("doc_id").collect()]
    assert sorted(ids) == [*range(10), *range(100, 120)]


@pytest.mark.parametrize("kind", ["folder", "file"])
def test_stream_of_a_named_table(spark, tmp_path, kind):
    """A table beside others may be one file or a folder of part files."""
    made, base, out = (str(tmp_path / p) for p in ("made", "base", "out"))
    rows = spark.range(20).selectExpr("id AS doc_id", "concat('w', id) AS text")
    rows.repartition(1 if kind == "file" else 4).write.parquet(made)
    os.makedirs(base)
    if kind == "file":
        (part,) = (f for f in os.listdir(made) if f.endswith(".parquet"))
        shutil.copy(f"{made}/{part}", f"{base}/docs.parquet")
    else:
        shutil.copytree(made, f"{base}/docs.parquet")
    rows.selectExpr("doc_id + 100 AS doc_id", "text").write.parquet(f"{base}/other.parquet")
    for _ in range(2):
        ingest.ingest_stream(spark, base, rows.schema, out, "text", pattern="docs.parquet")
    ids = [r["doc_id"] for r in ingest.read_table(spark, out).select("doc_id").collect()]
    assert sorted(ids) == [*range(20)]


def test_batch_and_stream_fill_one_table(spark, tmp_path):
    schema = "doc_id long, text string"
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    ingest.ingest_batch(spark.createDataFrame([(i, "a") for i in range(10)], schema), out, "text")
    spark.createDataFrame([(100 + i, "b") for i in range(10)], schema).write.parquet(folder)
    types = spark.read.parquet(folder).schema
    for name in (folder, f"{folder}/", f"file:{folder}", f"{tmp_path}/./in"):
        ingest.ingest_stream(spark, name, types, out, "text")
    ingest.ingest_batch(spark.createDataFrame([(50, "c")], schema), out, "text")
    # Files of another layout beside them count as well.
    found = ingest.read_table(spark, out)
    found.where("doc_id = 50").withColumn("doc_id", F.lit(51).cast("long")).write.mode("append").parquet(out)
    ids = sorted(r["doc_id"] for r in ingest.read_table(spark, out).select("doc_id").collect())
    assert ids == [*range(10), 50, 51, *range(100, 110)]


def test_size_checked_helpers(spark):
    df = spark.range(50)
    joined = df.join(small_side(spark.range(10), 10), "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = df.join(small_side(spark.range(10), 9), "id")
        assert "SortMergeJoin" in wide._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 8
    assert spread(spark.range(0, 10, 1, 30)).rdd.getNumPartitions() == 30
    assert stored(df.select(F.col("id").alias("x"))).count() == 50


def test_partition_sizes():
    small = sized(1 << 30, 8)
    assert small["spark__sql__shuffle__partitions"] == "24"
    assert small["spark__sql__files__maxPartitionBytes"] == str(128 << 20)
    huge = sized(100 << 40, 8000)
    assert huge["spark__sql__shuffle__partitions"] == "50000"
    assert huge["spark__sql__files__maxPartitionBytes"] == str(1 << 30)


@pytest.mark.parametrize("bad", [[1.0, 2.0, 3.0], [1.0, None], []])
def test_insert_refuses_wrong_vectors(spark, bad):
    name = f"refusing_{uuid.uuid4().hex}"
    collections.create(spark, name, collections.collection_schema(dynamic=False), dim=2)
    schema = "id long, embedding array<float>"
    collections.insert(spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], schema), name)
    rows = spark.createDataFrame([(3, [1.0, 2.0]), (4, bad)], schema)
    with pytest.raises(Exception, match="another length than 2"):
        collections.insert(rows, name)
    taken, refused = collections.split_vectors(rows, 2)
    assert [r["id"] for r in taken.collect()] == [3] and [r["id"] for r in refused.collect()] == [4]
    assert collections.settings(spark, name) == {"metric": "cosine", "index": "AUTOINDEX", "dim": "2"}
    spark.sql(f"DROP TABLE {name}")
