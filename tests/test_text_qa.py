"""Display forms, chat look-ups, cards, questions and plan shapes."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from trove.functions import text as txt
from trove.functions.models import ColumnTextModel, FunctionTextModel
from trove.operators import bm25, chatlog, dense
from trove.plans import cards, hybrid, joins, qa
from trove.sources.files import run_sql
from workload import queries as q


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_display_forms(spark):
    assert one(spark, txt.percent_change(F.lit(-5.0), F.lit(40.0))) == -12.5
    assert one(spark, txt.percent_change(F.lit(1.0), F.lit(0.0))) is None
    day = F.lit(dt.datetime(2024, 3, 5, 23, 59))
    assert one(spark, txt.short_date(day)) == "05 Mar, 2024"
    assert one(spark, txt.long_date(day)) == "March 5, 2024"
    assert one(spark, txt.dollars(F.lit(-1234.5))) == "-$1,234.50"
    assert one(spark, txt.dollars(F.lit(0.0))) == "$0.00"
    assert one(spark, txt.hex_text(F.lit("aż"))) == "61c5bc"
    assert one(spark, txt.preview(F.lit("x" * 80))) == "x" * 70 + "..."
    assert one(spark, txt.tokens(F.lit("Żółw-ĄĘ 12,5"))) == ["żółw", "ąę", "12", "5"]


def test_models_trim(spark):
    df = spark.createDataFrame([("a",)], "p string")
    assert ColumnTextModel(lambda c: F.concat(F.lit("  "), c)).generate(df, "p", "o").first()["o"] == "a"
    assert FunctionTextModel(lambda ps: [f" {p}! " for p in ps]).generate(df, "p", "o").first()["o"] == "a!"


def test_history_and_ownership(spark):
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(1, "u", t(1, 0)), (2, "u", t(1, 0)), (3, "u", t(3, 5)), (4, "v", t(2, 0)), (5, None, t(2, 0))]
    df = spark.createDataFrame(rows, "id int, user string, ts timestamp_ntz")
    got = {(r["user"], r["place"]): r["id"] for r in chatlog.history_by_user(df, "user", "ts", "id").collect()}
    assert got == {("u", 1): 3, ("u", 2): 2, ("u", 3): 1, ("v", 1): 4}
    top = chatlog.newest(df, "user", "ts", "id", 1).collect()
    assert {r["id"] for r in top} == {3, 4}
    asked = spark.createDataFrame([(1, "u"), (4, "u"), (5, None), (1, "u")], "id int, user string")
    assert [r["id"] for r in chatlog.owned(df, asked, "id", "user").collect()] == [1]


def test_long_chats_go_on_in_blocks(spark):
    df = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(25)], "c int, turn int, role string, text string")
    out = chatlog.nest_messages(df, "c", "turn", ["role", "text"], block_turns=10).orderBy("block").collect()
    assert [r["n_messages"] for r in out] == [10, 10, 5]
    assert [m["text"] for r in out for m in r["messages"]] == [f"m{t}" for t in range(25)]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "product": spark.createDataFrame([(1, "bolt"), (2, "ring")], "product_id int, name string"),
        "customer": spark.createDataFrame([(7, "Ann")], "customer_id int, surname string"),
    }


def test_question_to_answer(spark, tables):
    built = cards.build(tables, "sales")
    assert {r["table_name"]: r["card_id"] for r in built.collect()} == {"customer": 0, "product": 1}
    asked = spark.createDataFrame([(1, "which product name"), (2, "customer surname")], "qid int, text string")
    matched = qa.question_cards(asked, built, "qid")
    assert {r["qid"]: r["table_name"] for r in matched.collect()} == {1: "product", 2: "customer"}
    sql = qa.to_sql(matched, "shop")
    assert {r["query"] for r in sql.collect()} == {
        "SELECT * FROM shop.sales.product", "SELECT * FROM shop.sales.customer",
    }
    for name, df in tables.items():
        df.createOrReplaceTempView(f"view_{name}")
    rows = qa.run_statements(spark, sql, lambda s: s.replace("shop.sales.", "view_"))
    assert rows.count() == 3
    done = {r["qid"]: r["answer"] for r in qa.answers(sql, rows).collect()}
    assert done[2] == 'Found: {"customer_id":7,"surname":"Ann"}'
    assert done[1].count("product_id") == 2
    blocks = qa.answers(sql, rows, block_rows=1).where("qid = 1").orderBy("block").collect()
    assert [(r["block"], r["response"].count("product_id")) for r in blocks] == [(0, 1), (1, 1)]
    bad = qa.to_sql(matched, "shop", ColumnTextModel(lambda _: F.lit("DROP TABLE x")))
    with pytest.raises(ValueError):
        qa.run_statements(spark, bad)


def test_cards_through_a_model(spark, tables):
    rows = cards.build(tables, "sales", model=FunctionTextModel(lambda ps: [p[-14:] for p in ps]))
    assert rows.where("table_name = 'product'").first()["description"].endswith("name string")
    hits = cards.retrieve(
        spark.createDataFrame([(1, "string")], "qid int, text string"), rows, "qid", where="access = 'other'"
    )
    assert hits.count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_answers_hold_one_block_at_a_time(spark):
    """The questions go to a statement's blocks; none of both meets the others."""
    card = "array(named_struct('name', 'v', 'type', 'int')) AS schema"
    asked = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "w")], "qid int, query string, question string")
    asked = asked.selectExpr("*", card)
    rows = spark.range(25).selectExpr("'a' AS query", "to_json(struct(id)) AS row")
    out = qa.answers(asked, rows, block_rows=10)
    shown = plan(out)
    assert "collect_list" not in shown and "SortMergeJoin" not in shown
    texts = sorted(f'{{"id":{i}}}' for i in range(25))
    want = {(q, b): "\n".join(texts[10 * b : 10 * b + 10]) for q in (1, 2) for b in range(3)}
    got = {(r["qid"], r["block"]): r["response"] for r in out.collect()}
    assert got == want | {(3, 0): "", (4, 0): ""}


def test_blocks_are_joined_where_rows_were_sorted(spark):
    """Rows are shuffled once; only blocks that two tasks share are put together."""
    asked = spark.createDataFrame([(i, q, "x") for i, q in enumerate("abcab")], "qid int, query string, question string")
    asked = asked.selectExpr("*", "array(named_struct('name', 'v', 'type', 'int')) AS schema")
    texts = {"a": [f"{i % 700:04d}é" for i in range(2000)], "b": [f"r{i}" for i in range(37)], "z": ["none asks"]}
    rows = spark.createDataFrame([(q, r) for q, found in texts.items() for r in found], "query string, row string").repartition(3)
    short = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in short}
    try:
        for name, value in short.items():
            spark.conf.set(name, value)
        out = qa.answers(asked, rows, block_rows=10)
        assert "NOT whole" in plan(out) and "Sort [" not in plan(out).split("FlatMapGroupsInArrow")[0]
        got = [(r["qid"], r["block"], r["response"]) for r in out.collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    want = []
    for i, q in enumerate("abcab"):
        lines = sorted(texts.get(q, []))
        want += [(i, at // 10, "\n".join(lines[at : at + 10])) for at in range(0, len(lines), 10)] or [(i, 0, "")]
    assert sorted(got) == sorted(want)


def test_answers_without_any_rows(spark):
    asked = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "qid int, query string, question string")
    asked = asked.selectExpr("*", "array(named_struct('name', 'v', 'type', 'int')) AS schema")
    out = qa.answers(asked, spark.createDataFrame([], "query string, row string"))
    assert sorted((r["qid"], r["block"], r["response"]) for r in out.collect()) == [(1, 0, ""), (2, 0, "")]


def test_filter_and_columns_reach_the_scan(spark, small_dir):
    shown = plan(q.filter_search(spark, small_dir))
    assert "EqualTo(p_brand,Brand#7)" in shown and "GreaterThanOrEqual(p_retailprice" in shown
    assert "p_type" not in shown
    shown = plan(q.search_cosine(spark, small_dir))
    assert "TakeOrderedAndProject" in shown and "In(label" in shown


@pytest.mark.parametrize(
    "name",
    ["bm25_search", "hybrid_search", "knn_join_topk", "ivf_search_label_cells", "knn_graph",
     "summarise_extractive", "equal_embedding_pairs", "history_by_user", "owned_lookup"],
)
def test_no_nested_loops(spark, small_dir, name):
    shown = plan(q.__dict__[name](spark, small_dir))
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown


def test_texts_are_counted_where_they_lie(spark, small_dir):
    """No text is shuffled before it is split; only counts move."""
    docs = q.table(spark, small_dir, "documents")
    model = bm25.fit(docs, "doc_id", "text")
    coded = bm25.encode_documents(docs, model, "doc_id", "text")
    assert plan(coded).count("Exchange") == 0
    assert plan(coded.groupBy("doc_id").count()).count("Exchange") == 1
    best = plan(hybrid.sparse_search(q.table(spark, small_dir, "benchmark"), docs, 5, "item_id", "doc_id"))
    assert "WindowGroupLimit" in best


def test_texts_are_split_once_per_scan(spark, small_dir):
    docs = q.table(spark, small_dir, "documents")
    shown = plan(bm25.term_counts(docs, "doc_id", "text"))
    assert shown.count("regexp_extract_all") == 1


def test_shipped_queries_scan_without_a_shuffle(spark, small_dir):
    rows = q._vectors(spark, small_dir)
    shown = plan(dense.knn_join(q._as_queries(rows), rows, 3, "l2"))
    assert shown.count("Exchange") == 1 and "WindowGroupLimit" in shown


def test_stored_index_reads_only_what_a_query_holds(spark, small_dir):
    docs = q.documents(spark, small_dir)
    index = hybrid.build_index(docs, "doc_id", drop_ratio=0.0)
    asked = spark.createDataFrame([(1, "the than")], "qid long, text string")
    hits = hybrid.search_index(asked, index, "qid", limit=5, drop_ratio=0.0)
    shown = plan(hits)
    # Segments in force are chosen by folder, terms in the scan.
    assert re.search(r"PartitionFilters: \[\(concat_ws\(\|, part", shown)
    assert "In(_term" in shown
    read = re.findall(r"ReadSchema: struct<([^>]*)", shown)
    assert read and not any("text" in columns for columns in read)
    fresh = hybrid.hybrid_search(asked, docs, "qid", "doc_id", limit=5, drop_ratio=0.0)
    assert sorted(hits.collect()) == sorted(fresh.collect())


def test_a_history_at_one_instant_is_ranked(spark):
    rows = [(i, 7, "2024-01-01 00:00:00") for i in range(500)] + [(900, None, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "id long, user long, ts string").repartition(6)
    got = chatlog.history_by_user(df, "user", "ts", "id")
    assert sorted((r["place"], r["id"]) for r in got.collect()) == [(i + 1, 499 - i) for i in range(500)]


# ---- how tables join


@pytest.fixture(scope="module")
def shop(spark):
    make = spark.createDataFrame
    return {
        "area": make([(1, "north"), (2, "south")], "a_areakey int, a_name string"),
        "buyer": make([(i, 1 + i % 2, f"b{i}") for i in range(50)], "b_buyerkey long, b_areakey int, b_name string"),
        "sale": make(
            [(i, i % 40, None if i % 7 else "x") for i in range(300)], "s_salekey long, s_buyerkey long, s_note string"
        ),
        "apart": make([(-5.0, "z"), (-6.0, "z")], "value double, mark string"),
        "none": make([], "n_buyerkey long"),
    }


@pytest.mark.parametrize("sketch", [1024, 3])
def test_inclusions_hold_in_the_data(shop, sketch):
    found = {tuple(r) for r in joins.inclusions(shop, sketch).collect()}
    values = {
        (t, f.name): [r[0] for r in df.select(f.name).collect() if r[0] is not None]
        for t, df in shop.items()
        for f in df.schema.fields
        if f.dataType.typeName() in ("integer", "long", "string")
    }
    want = set()
    for (t, c), mine in values.items():
        for (u, d), theirs in values.items():
            key = len(theirs) == len(set(theirs)) > 0
            if t != u and mine and key and set(mine) <= set(theirs):
                want.add((t, c, u, d, len(set(mine)), len(set(theirs))))
    assert found == want and ("sale", "s_buyerkey", "buyer", "b_buyerkey", 40, 50) in want


def test_tables_are_linked_at_least_cost(spark, shop):
    found = joins.edges(joins.inclusions(shop))
    assert joins.cheapest(found, "sale")["area"][0] == 2 * joins.ALIKE
    text = joins.join_statement(found, ["sale", "area"], "sale.s_salekey, area.a_name")
    assert text == (
        "SELECT sale.s_salekey, area.a_name FROM sale JOIN buyer ON sale.s_buyerkey = buyer.b_buyerkey "
        "JOIN area ON buyer.b_areakey = area.a_areakey"
    )
    for name, df in shop.items():
        df.createOrReplaceTempView(name)
    rows = run_sql(spark, text).collect()
    assert len(rows) == 300 and {r["a_name"] for r in rows if r["s_salekey"] % 40 % 2} == {"south"}
    for name in shop:
        spark.catalog.dropTempView(name)
    with pytest.raises(ValueError, match="apart"):
        joins.join_tree(found, ["sale", "apart"])
    assert joins.join_tree(found, ["area"]) == []


@pytest.mark.parametrize("sketch", [1024, 3])
def test_sketches_sort_few_hashes(spark, sketch):
    """Bounded, the sketch is that of all hashes; one with too few below is whole."""
    values = spark.range(5000).selectExpr("'t' AS table", "'c' AS column", "'number' AS kind", "xxhash64(id) AS hash")
    high = spark.range(400).selectExpr("'t' AS table", "'d' AS column", "'number' AS kind", "id + 9000000000000 AS hash")
    values = values.unionByName(high)
    columns = values.groupBy("table", "column", "kind").agg(F.count("hash").alias("distinct"))
    low = joins._lowest(values, columns, sketch)
    got = sorted((r["column"], r["hash"]) for r in low.collect())
    want = []
    for c in "cd":
        hashes = sorted(r["hash"] for r in values.where(F.col("column") == c).collect())
        want += [(c, h) for h in hashes[:sketch]]
    assert got == want
