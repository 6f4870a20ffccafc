"""The pipeline, stage by stage, against plain rules on its own input."""

import re

import corpus_pipeline
from tests.llm.test_llm_operators import brute_components, brute_lines, shingle_set
from trove.session import stored

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        kept.append({r.doc_id: r for r in docs.collect()} if "text" in docs.columns else {})
        docs = stored(stage(spark, docs, DIR), re.sub("[^a-z]", "", name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    first, good, lines, single, clean = kept

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    right = sum((i in good) <= (q == 1) for i, q in labels.items() if i in first)
    assert right >= 0.97 * len(labels)

    gone = brute_lines([(i, r.text) for i, r in good.items()])
    for i, r in good.items():
        left = [x for n, x in enumerate(r.text.split("\n")) if (i, r.text, n) not in gone]
        if "\n".join(left).split():
            assert lines[i].text == "\n".join(left) and lines[i].n_chars == len(lines[i].text)
        else:
            assert i not in lines

    groups = brute_components([(i, r.text) for i, r in lines.items()])
    assert set(single) == {i for i, _, c in groups if i == c}

    items = [shingle_set(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for i, r in single.items():
        have = shingle_set(r.text)
        dirty = any(100 * len(have & x) >= 80 * len(x) for x in items)
        assert (i in clean) != dirty

    packed = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert packed == set(clean)


def test_odd_and_empty_tables(spark, tmp_path):
    """Null and empty texts, repeated rows, ties, and tables without rows."""
    given = spark.read.parquet(f"{DIR}/documents.parquet").limit(30).collect()
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    odd = [
        (10_001, None, "en", "src0", None), (10_002, "", None, None, 0), (10_003, " \n\t", "en", "src1", 3),
        (None, "no id at all", "en", "src1", 12), (10_004, long, "en", "src1", len(long)),
    ]
    rows = [tuple(r) for r in given] + [tuple(given[0])] * 2 + odd + odd[:1]
    for name, some in (("odd", rows), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            of = spark.read.parquet(f"{DIR}/{table}.parquet")
            (of if some else of.where("false")).write.parquet(f"{folder}/{table}.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert bool(out) == bool(some)
        # Every piece once: no sequence holds two ids in one place.
        places = [(r.sequence_id, r.offset) for r in out]
        assert len(set(places)) == len(places)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and out.count() > 0
