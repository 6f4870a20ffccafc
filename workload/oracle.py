"""The queries as SQL over the same parquet tables."""

from __future__ import annotations

TABLES = (
    "benchmark conversations customer documents embeddings events labels lineitem nation "
    "orders pages part region supplier"
).split()



def words(column: str) -> str:
    return rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}]+')"


def embed(name: str, source: str, key: str, text: str = "text") -> str:
    """CTEs ending in ``name (key, embedding)``: the hashed embedder."""
    return f"""
{name}_w AS (SELECT {key}, unnest({words(text)}) AS w FROM {source}),
{name}_c AS (SELECT {key}, ('0x' || substr(md5(w), 1, 2))::INT AS code FROM {name}_w),
{name}_s AS (SELECT {key}, code % 64 AS bucket,
    sum(CASE WHEN code >= 128 THEN -1 ELSE 1 END)::DOUBLE AS v FROM {name}_c GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS len FROM {name}_s GROUP BY ALL),
{name}_d AS (SELECT {key}, unnest(range(64)) AS bucket FROM {source}),
{name} AS (SELECT {key}, list(CASE WHEN len > 0 THEN coalesce(v, 0) / len ELSE 0 END::FLOAT
    ORDER BY bucket) AS embedding
    FROM {name}_d LEFT JOIN {name}_s USING ({key}, bucket) LEFT JOIN {name}_n USING ({key})
    GROUP BY {key})"""


def total(column: str = "embedding") -> str:
    return f"round(list_sum({column}::DOUBLE[]), 5) + 0.0"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def score(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        return f"round({dot(a, a)} + {dot(b, b)} - 2 * {dot(a, b)}, 6) + 0.0"
    if metric == "ip":
        return f"round({dot(a, b)}, 6) + 0.0"
    return (
        f"round(CASE WHEN {dot(a, a)} * {dot(b, b)} > 0 "
        f"THEN {dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)}) ELSE 0 END, 6) + 0.0"
    )


def squared(a: str, b: str) -> str:
    """Squared distance term by term, never below zero."""
    return (
        f"round(list_sum(list_transform(list_zip({a}, {b}), "
        f"lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6)"
    )


def ranked(source: str, query: str, key: str, k: int, ascending: bool = False) -> str:
    direction = "ASC" if ascending else "DESC"
    return f"""SELECT {query}, rank, {key}, score FROM (
    SELECT {query}, {key}, score, row_number() OVER (
        PARTITION BY {query} ORDER BY score {direction}, {key})::INTEGER AS rank FROM {source})
    WHERE rank <= {k}"""


def bm25(name: str, source: str, key: str, text: str = "text") -> str:
    """CTEs: ``_len``, ``_st``, ``_tf``, ``_df`` and ``_w (key, term, weight)``."""
    return f"""
{name}_len AS (SELECT {key}, len({words(text)}) AS dl FROM {source} WHERE {text} IS NOT NULL),
{name}_st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_len FROM {name}_len),
{name}_t AS (SELECT {key}, unnest({words(text)}) AS term FROM {source}),
{name}_tf AS (SELECT {key}, term, count(*) AS tf FROM {name}_t GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_w AS (SELECT {key}, term,
    round(tf / (tf + 1.2 * (1 - 0.75 + 0.75 * (dl / avg_len))), 6) AS weight
    FROM {name}_tf JOIN {name}_len USING ({key}), {name}_st)"""


DOCS = bm25("d", "documents", "doc_id")

QUERY_IDF = f"""
q_t AS (SELECT DISTINCT item_id, unnest({words("text")}) AS term FROM benchmark),
q_i AS (SELECT item_id, term, ln((n_docs + 1) / (coalesce(df, 1) + 0.5)) AS idf
    FROM q_t LEFT JOIN d_df USING (term), d_st),
q_w AS (SELECT item_id, term, round(idf / sum(idf) OVER (PARTITION BY item_id), 6) AS weight
    FROM q_i)"""

QUERY_TF = f"""
u_len AS (SELECT item_id, len({words("text")}) AS dl FROM benchmark),
u_t AS (SELECT item_id, unnest({words("text")}) AS term FROM benchmark),
u_tf AS (SELECT item_id, term, count(*) AS tf FROM u_t GROUP BY ALL),
u_w AS (SELECT item_id, term,
    round(tf / (tf + 1.2 * (1 - 0.75 + 0.75 * (dl / avg_len))), 6) AS weight
    FROM u_tf JOIN u_len USING (item_id), d_st)"""


def dropped(name: str, source: str, query: str) -> str:
    return f"""
{name} AS (SELECT {query}, term, weight FROM (SELECT *,
    row_number() OVER (PARTITION BY {query} ORDER BY weight, term) AS o,
    floor(count(*) OVER (PARTITION BY {query}) * 0.2) AS n FROM {source}) WHERE o > n)"""


def sparse_scores(name: str, queries: str, postings: str, query: str, key: str) -> str:
    return f"""
{name} AS (SELECT {query}, {key}, round(sum(q.weight * p.weight), 6) AS score
    FROM {queries} q JOIN {postings} p USING (term) GROUP BY ALL)"""


def fused(name: str, legs: list[str], query: str, key: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {query}, {key}, rank FROM {leg}" for leg in legs)
    return f"""
{name} AS (SELECT {query}, {key}, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score
    FROM ({parts}) GROUP BY ALL)"""


def row_counts() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES
    )


LISTED = ", ".join(f"'{t}'" for t in TABLES)
COLUMNS = f"""
n AS ({row_counts()}),
c AS (SELECT table_name, ordinal_position::INTEGER AS position, column_name,
    CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
        WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
        WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
        ELSE data_type END AS data_type
    FROM information_schema.columns WHERE table_name IN ({LISTED})),
r AS (SELECT table_name, string_agg(column_name || ' ' || data_type, ', ' ORDER BY position)
    AS schema, count(*) AS n_columns FROM c GROUP BY table_name)"""

CARDS = f"""{COLUMNS},
k AS (SELECT row_number() OVER (ORDER BY table_name) - 1 AS card_id, table_name, schema,
    'Table ' || table_name || ' has ' || row_count || ' rows and ' || n_columns ||
    ' columns: ' || schema || '.' AS description FROM r JOIN n USING (table_name)),
{embed("ke", "k", "card_id", "description")}"""

# The columns that may refer to a key: whole numbers and texts.
NUMBERS = """benchmark.item_id conversations.conv_id conversations.turn customer.c_custkey
customer.c_nationkey documents.doc_id documents.n_chars embeddings.vec_id embeddings.label
events.event_id events.user_id labels.doc_id labels.quality labels.toxic lineitem.l_orderkey
lineitem.l_partkey lineitem.l_suppkey lineitem.l_linenumber nation.n_nationkey nation.n_regionkey
orders.o_orderkey orders.o_custkey pages.page_id part.p_partkey part.p_size region.r_regionkey
supplier.s_suppkey supplier.s_nationkey""".split()
TEXTS = """benchmark.text conversations.role conversations.text customer.c_name
customer.c_mktsegment documents.text documents.lang documents.source events.event_type
events.props lineitem.l_returnflag lineitem.l_linestatus nation.n_name orders.o_orderstatus
orders.o_orderpriority pages.url pages.html part.p_name part.p_brand part.p_type region.r_name
supplier.s_name""".split()


def join_keys() -> str:
    """CTEs ending in ``j``: columns whose values all lie in a key of another table."""
    cells = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, '{kind}' AS kind, {c}::VARCHAR AS x FROM {t}"
        for kind, names in (("number", NUMBERS), ("text", TEXTS))
        for t, c in (name.split(".") for name in names)
    )
    return f"""
v AS MATERIALIZED (SELECT t, c, kind, x, count(*) AS n FROM ({cells}) WHERE x IS NOT NULL GROUP BY ALL),
z AS MATERIALIZED (SELECT t, c, count(*) AS distinct_n, max(n) = 1 AS is_key FROM v GROUP BY t, c),
shared AS (SELECT a.t AS t1, a.c AS c1, b.t AS t2, b.c AS c2, count(*) AS both_n
    FROM v a JOIN (SELECT v.* FROM v JOIN z USING (t, c) WHERE is_key) b USING (kind, x)
    WHERE a.t <> b.t GROUP BY ALL),
j AS (SELECT t1 AS child_table, c1 AS child_column, t2 AS parent_table, c2 AS parent_column,
    x.distinct_n AS n_child, y.distinct_n AS n_parent
    FROM shared JOIN z x ON x.t = t1 AND x.c = c1 JOIN z y ON y.t = t2 AND y.c = c2
    WHERE both_n = x.distinct_n)"""


CELLS = """
e AS (SELECT vec_id AS id, embedding, label FROM embeddings),
parts AS (SELECT label, unnest(range(64)) AS position, unnest(embedding)::DOUBLE AS x FROM e),
means AS (SELECT label, position, avg(x) AS mean FROM parts GROUP BY ALL),
cells AS (SELECT label AS cell, list(mean ORDER BY position) AS centroid FROM means GROUP BY label)"""


def hybrid(limit: int, leg: int, where: str = "TRUE", cut: float = 0.0) -> str:
    """CTEs ending in ``h``: the fused scores of both legs.

    ``cut`` drops the lightest share of all document weights first.
    """
    return f"""
{DOCS}, {QUERY_IDF}, {dropped("qd", "q_w", "item_id")},
kept AS (SELECT * FROM documents WHERE {where}),
cut AS (SELECT quantile_cont(weight, {cut}) AS c FROM d_w),
p AS (SELECT d_w.* FROM d_w SEMI JOIN kept USING (doc_id) WHERE weight >= (SELECT c FROM cut)),
{sparse_scores("s", "qd", "p", "item_id", "doc_id")},
sl AS ({ranked("s", "item_id", "doc_id", leg)}),
{embed("qe", "benchmark", "item_id")}, {embed("de", "kept", "doc_id")},
x AS (SELECT item_id, doc_id, {score("cosine", "qe.embedding", "de.embedding")} AS score
    FROM qe, de),
xl AS ({ranked("x", "item_id", "doc_id", leg)}),
{fused("f", ["sl", "xl"], "item_id", "doc_id")},
h AS ({ranked("f", "item_id", "doc_id", limit)})"""


def indexed_step(step: int, where: str) -> str:
    """The hybrid search over the rows that are in force at one step."""
    body = hybrid(10, 20, "lang <> 'de'", 0.2).replace("documents", "held")
    return f"""SELECT {step} AS step, * FROM (WITH held AS (SELECT * FROM documents WHERE {where}), {body}
SELECT item_id, rank, doc_id AS id, score, source FROM h JOIN held USING (doc_id))"""


def card_hits() -> str:
    return f"""{CARDS},
{bm25("d", "k", "card_id", "description")}, {QUERY_IDF}, {dropped("qd", "q_w", "item_id")},
{sparse_scores("s", "qd", "d_w", "item_id", "card_id")},
sl AS ({ranked("s", "item_id", "card_id", 10)}),
{embed("qe", "benchmark", "item_id")},
x AS (SELECT item_id, card_id, {score("cosine", "qe.embedding", "ke.embedding")} AS score
    FROM qe, ke),
xl AS ({ranked("x", "item_id", "card_id", 10)}),
{fused("f", ["sl", "xl"], "item_id", "card_id")},
h AS ({ranked("f", "item_id", "card_id", 1)})"""


def level(number: int, source: str, cell: str) -> str:
    """CTEs ending in ``s{number} (cluster, summaries)`` over ``source (id, text)``."""
    b = f"b{number}"
    return f"""
{bm25(b, source, "id")},
{b}_m AS (SELECT id, round(avg(weight), 6) AS m FROM {b}_w GROUP BY id),
s{number} AS (SELECT cluster, text AS summaries FROM (SELECT {cell} AS cluster, text,
    row_number() OVER (PARTITION BY {cell} ORDER BY coalesce(m, 0) DESC, id) AS o
    FROM {source} LEFT JOIN {b}_m USING (id)) WHERE o = 1)"""


TREE = f"""
i1 AS (SELECT doc_id AS id, text, substr(source, 4)::INTEGER AS cell FROM documents),
{level(1, "i1", "cell")},
i2 AS (SELECT cluster::BIGINT AS id, summaries AS text FROM s1),
{level(2, "i2", "(id % 3)::INTEGER")},
i3 AS (SELECT cluster::BIGINT AS id, summaries AS text FROM s2),
{level(3, "i3", "0")},
t AS (SELECT 1 AS level, * FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 3, * FROM s3),
nodes AS (SELECT 0 AS level, id AS node, text FROM i1
    UNION ALL SELECT level, cluster::BIGINT, summaries FROM t)"""

COLLECTION = (
    f"SELECT vec_id AS id, label, len(embedding)::INTEGER AS n_dims, {total()} AS total "
    "FROM embeddings"
)

INGESTED = f"""WITH {embed("e", "documents", "doc_id")}
SELECT doc_id, lang, source, n_chars, length(text)::INTEGER AS n_text, {total()} AS total
FROM documents JOIN e USING (doc_id)"""

MEMBERS = """m AS (SELECT doc_id,
    unnest(list_distinct([(n_chars % 7)::INTEGER, (n_chars % 5)::INTEGER])) AS cluster
    FROM documents)"""

FIRST_VECTOR = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def search(metric: str, k: int, where: str = "TRUE", label: bool = False) -> str:
    value = squared("embedding", "q") if metric == "l2" else score(metric, "embedding", "q")
    order = "ASC" if metric == "l2" else "DESC"
    extra = ", label" if label else ""
    return f"""SELECT row_number() OVER (ORDER BY score {order}, id)::INTEGER AS rank, id, score{extra}
FROM (SELECT vec_id AS id, label, {value} AS score
    FROM embeddings, (SELECT {FIRST_VECTOR} AS q) WHERE {where})
ORDER BY rank LIMIT {k}"""


def statements() -> dict[str, str]:
    return {
        "csv_roundtrip": "SELECT * FROM part",
        "run_sql_products": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice "
        "FROM part",
        "catalog_tables": row_counts(),
        "catalog_columns": f"WITH {COLUMNS} SELECT * FROM c JOIN n USING (table_name)",
        "catalog_reflect": f"""WITH {COLUMNS}
SELECT table_name AS name, schema AS columns, row_count FROM r JOIN n USING (table_name)""",
        "catalog_cards": f"""WITH {COLUMNS} SELECT 'Schema for table ' || table_name AS "desc",
schema, table_name, 'read-only' AS access, row_count FROM r JOIN n USING (table_name)""",
        "collection_create_insert": COLLECTION,
        "collection_recreate": COLLECTION,
        "collection_if_absent": COLLECTION,
        "collection_describe": """SELECT * FROM (VALUES ('column', 'id', 'bigint'),
('column', 'embedding', 'array<float>'), ('column', 'label', 'int'),
('property', 'metric', 'cosine'), ('property', 'index', 'AUTOINDEX'), ('property', 'dim', '64'))
AS v(kind, name, value)
UNION ALL SELECT 'rows', 'row_count', count(*)::VARCHAR FROM embeddings""",
        "collection_hybrid_search": f"""WITH {hybrid(10, 20)}
SELECT item_id, rank, doc_id AS id, score FROM h""",
        "collection_append_search": f"""WITH {hybrid(10, 20)}
SELECT item_id, rank, doc_id AS id, score, source FROM h JOIN documents USING (doc_id)""",
        "collection_indexed_append_search": f"""{indexed_step(1, "doc_id % 3 = 0")}
UNION ALL {indexed_step(2, "doc_id % 7 <> 3 AND doc_id % 11 <> 5")}""",
        "collection_refused_vectors": """SELECT vec_id AS id, label % 2 = 0 AS taken
FROM embeddings""",
        "auto_id_unique": "SELECT 2 * count(*) AS n_rows, 2 * count(*) AS n_ids FROM documents",
        "dynamic_fields": """SELECT event_id AS id, value, event_type, user_id,
json_extract_string(props, '$.k')::BIGINT AS k FROM events""",
        "ingest_batch": INGESTED,
        "ingest_stream": INGESTED,
        "ingest_stream_twice": INGESTED,
        "ingest_batch_then_stream": INGESTED,
        "fill_missing": """SELECT doc_id, lang, coalesce(quality, 0) AS quality,
coalesce(toxic, 0) AS toxic, coalesce(quality / 2.0::DOUBLE, 0.0) AS half,
coalesce('q' || quality, 'missing-data') AS mark, coalesce(toxic = 1, FALSE) AS is_toxic
FROM documents LEFT JOIN labels USING (doc_id)""",
        "prepare_rows": f"""WITH {embed("e", "documents", "doc_id")}
SELECT doc_id, lang, source, {total()} AS total FROM documents JOIN e USING (doc_id)""",
        "prepare_rows_keep_text": f"""WITH {embed("e", "documents", "doc_id")}
SELECT doc_id, text, lang, source, {total()} AS total FROM documents JOIN e USING (doc_id)""",
        "filter_category": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'de'",
        "filter_search": "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part "
        "WHERE p_brand = 'Brand#7' AND p_retailprice >= 910 AND p_retailprice <= 980",
        "filter_expr": "SELECT * FROM part WHERE p_size > 10 AND p_type IN ('LARGE', 'SMALL')",
        "cast_to_schema": """SELECT p_partkey::VARCHAR AS p_partkey, p_name,
p_brand, p_type, p_size::BIGINT AS p_size,
p_retailprice::FLOAT AS p_retailprice FROM part""",
        "preview_top5": "SELECT * FROM documents ORDER BY doc_id LIMIT 5",
        "hash_embed": f"""WITH {embed("e", "documents", "doc_id")},
u AS (SELECT doc_id, unnest(range(64))::INTEGER AS bucket, unnest(embedding) AS v FROM e)
SELECT doc_id, bucket, round(v::DOUBLE, 6) AS value FROM u WHERE v <> 0""",
        "token_counts": f"SELECT doc_id, len({words('text')})::INTEGER AS n_tokens FROM documents",
        "token_length_stats": f"""SELECT lang, median(n) AS median_tokens,
round(avg(n), 6) AS mean_tokens, max(n)::INTEGER AS max_tokens, min(n)::INTEGER AS min_tokens
FROM (SELECT lang, len({words('text')}) AS n FROM documents WHERE text IS NOT NULL) GROUP BY lang""",
        "bm25_fit": f"""WITH {DOCS} SELECT term, df, n_docs, round(avg_len, 6) AS avg_len
FROM d_df, d_st""",
        "bm25_encode_docs": f"WITH {DOCS} SELECT doc_id, term, weight FROM d_w",
        "bm25_encode_query_idf": f"WITH {DOCS}, {QUERY_IDF} SELECT * FROM q_w",
        "bm25_encode_query_tf": f"WITH {DOCS}, {QUERY_TF} SELECT * FROM u_w",
        "prompt_render": """SELECT conv_id, turn,
'Describe this database table and what it is likely used for.' || chr(10) || 'Columns:' || chr(10)
    || role AS describe,
'Table card:' || chr(10) || role || chr(10) || 'Question: ' || text || chr(10) ||
    'Write one SQL query and nothing else. Prefix every schema with warehouse.' AS ask_sql,
'Table card:' || chr(10) || role || chr(10) || 'Question: ' || text || chr(10) ||
    'Query: SELECT 1' || chr(10) || 'Rows: 1' || chr(10) || 'Answer in plain words.' AS ask_answer,
'Summarise these passages in detail.' || chr(10) || chr(10) || text AS summarise
FROM conversations""",
        "describe_tables": f"WITH {CARDS} SELECT table_name, description FROM k",
        "pct_change": """SELECT l_orderkey, l_linenumber,
round((l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice) / l_extendedprice * 100,
    2) + 0.0 AS change FROM lineitem""",
        "date_display": """SELECT o_orderkey, strftime(o_orderdate, '%d %b, %Y') AS short_form,
strftime(o_orderdate, '%B %-d, %Y') AS long_form FROM orders""",
        "text_preview": "SELECT doc_id, substring(text, 1, 70) || '...' AS preview FROM documents",
        "currency_display": """SELECT c_custkey, CASE WHEN round(c_acctbal, 2) < 0 THEN '-' ELSE ''
END || '$' || format('{:,.2f}', abs(c_acctbal)) AS balance FROM customer""",
        "hex_bytes": "SELECT conv_id, turn, lower(hex(encode(text))) AS hex_text FROM conversations",
        "search_cosine": search("cosine", 100, "label IN (1, 2, 3, 5, 8)", label=True),
        "search_l2": search("l2", 10),
        "search_ip": search("ip", 10, label=True),
        "search_filtered_semi": search("l2", 10, "label BETWEEN 2 AND 4"),
        "knn_join_topk": f"""WITH {embed("qe", "benchmark", "item_id")},
{embed("de", "documents", "doc_id")},
x AS (SELECT item_id, doc_id, {score("cosine", "qe.embedding", "de.embedding")} AS score FROM qe, de)
{ranked("x", "item_id", "doc_id", 10)}""",
        "ivf_build_label_cells": f"""WITH {CELLS} SELECT label::BIGINT AS cell,
position::INTEGER AS position, round(mean, 6) AS mean FROM means""",
        "ivf_search_label_cells": f"""WITH {CELLS},
near AS (SELECT id AS query_id, embedding AS q, cell, row_number() OVER (PARTITION BY id
    ORDER BY {squared("embedding", "centroid")}, cell) AS o FROM e, cells),
x AS (SELECT query_id, id, {squared("q", "embedding")} AS score
    FROM near JOIN e ON e.label = near.cell WHERE o <= 3)
{ranked("x", "query_id", "id", 10, ascending=True)}""",
        "ivf_full_probe": f"""WITH {CELLS},
x AS (SELECT a.id AS query_id, b.id AS id, {squared("a.embedding", "b.embedding")} AS score
    FROM e a, e b)
{ranked("x", "query_id", "id", 10, ascending=True)}""",
        "ivf_recall": "SELECT count(*) AS n_queries, TRUE AS nine_tenths FROM embeddings",
        "knn_graph_descent": "SELECT count(*) AS n_queries, TRUE AS nine_tenths FROM embeddings",
        "pq_recall": "SELECT count(*) AS n_queries, TRUE AS nine_tenths FROM embeddings",
        "pq_scores": f"""WITH {CELLS},
x AS (SELECT a.id AS query_id, b.id AS id, {squared("a.embedding", "b.embedding")} AS score
    FROM e a, e b)
{ranked("x", "query_id", "id", 10, ascending=True)}""",
        "auto_index_search": f"""WITH {CELLS},
x AS (SELECT a.id AS query_id, b.id AS id, {squared("a.embedding", "b.embedding")} AS score
    FROM e a, e b)
SELECT r.*, kind FROM ({ranked("x", "query_id", "id", 10, ascending=True)}) r,
    (VALUES ('exact'), ('cells')) k(kind)""",
        "sparse_index_build": f"""WITH {DOCS}, cut AS (SELECT quantile_cont(weight, 0.2) AS c FROM d_w)
SELECT doc_id, term, weight FROM d_w, cut WHERE weight >= c""",
        "bm25_search": f"""WITH {DOCS}, {QUERY_IDF},
{sparse_scores("s", "q_w", "d_w", "item_id", "doc_id")}
{ranked("s", "item_id", "doc_id", 10)}""",
        "bm25_search_stored": f"""WITH {DOCS}, {QUERY_IDF},
{sparse_scores("s", "q_w", "d_w", "item_id", "doc_id")}
{ranked("s", "item_id", "doc_id", 10)}""",
        "bm25_search_drop": f"""WITH {DOCS}, {QUERY_IDF}, {dropped("qd", "q_w", "item_id")},
{sparse_scores("s", "qd", "d_w", "item_id", "doc_id")}
{ranked("s", "item_id", "doc_id", 10)}""",
        "rrf_fuse": f"""WITH {DOCS}, {QUERY_IDF}, {QUERY_TF},
{sparse_scores("s", "q_w", "d_w", "item_id", "doc_id")},
sl AS ({ranked("s", "item_id", "doc_id", 10)}),
{sparse_scores("v", "u_w", "d_w", "item_id", "doc_id")},
vl AS ({ranked("v", "item_id", "doc_id", 10)}),
{fused("f", ["sl", "vl"], "item_id", "doc_id")}
{ranked("f", "item_id", "doc_id", 10)}""",
        "hybrid_search": f"""WITH {hybrid(10, 20, "lang = 'en'")} SELECT * FROM h""",
        "hybrid_search_stored": f"""WITH {hybrid(10, 20, "lang = 'en'", 0.2)}
SELECT h.*, source, lang FROM h JOIN documents USING (doc_id)""",
        "hybrid_top1": f"""WITH {hybrid(1, 10)} SELECT item_id, source AS "SOURCE_NAME",
lang AS "LANGUAGE", text AS "TEXT" FROM h JOIN documents USING (doc_id)""",
        "reduce_global_products": """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v))
    * sqrt(list_dot_product(b.v, b.v))), 5) + 0.0 AS product
FROM u a JOIN u b ON b.vec_id = a.vec_id + 1""",
        "reduce_local_products": """WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v
    FROM embeddings WHERE label IS NOT NULL)
SELECT a.vec_id AS id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v))
    * sqrt(list_dot_product(b.v, b.v))), 5) + 0.0 AS product
FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 AND a.label = b.label""",
        "group_covariance": """WITH p AS (SELECT vec_id, label,
    unnest(range(64))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
g AS (SELECT a.label, a.i AS i, b.i AS j, avg(a.x * b.x) - avg(a.x) * avg(b.x) AS v
    FROM p a JOIN p b USING (vec_id) GROUP BY ALL)
SELECT label, i, j, round(v, 6) + 0.0 AS covariance FROM g""",
        "knn_graph": f"""WITH {CELLS},
x AS (SELECT a.id AS query_id, b.id AS id, {score("cosine", "a.embedding", "b.embedding")} AS score
    FROM e a, e b WHERE a.id <> b.id)
SELECT query_id, rank, id, score FROM ({ranked("x", "query_id", "id", 1000000)})
WHERE rank <= floor(sqrt((SELECT count(*) FROM embeddings) - 1))""",
        "bic_single_gaussian": f"""WITH {CELLS},
s AS (SELECT position, count(*) AS n, greatest(var_pop(x), 1e-6) AS v FROM parts GROUP BY position),
l AS (SELECT max(n) AS n_rows, count(*) AS n_dims,
    -0.5 * max(n) * sum(ln(2 * pi() * v) + 1) AS ll FROM s)
SELECT n_rows, n_dims, round(ll, 3) AS log_likelihood,
round(-2 * ll + 2 * n_dims * ln(n_rows), 3) AS bic FROM l""",
        "soft_assign": f"""WITH {CELLS},
g AS (SELECT label, position, count(*) AS n, avg(x) AS mu, var_pop(x) + 1e-6 AS v
    FROM parts GROUP BY ALL),
o AS (SELECT id, unnest(range(64)) AS position, unnest(embedding)::DOUBLE AS x FROM e),
d AS (SELECT id, label, max(n) AS n,
    sum(-0.5 * (ln(2 * pi()) + ln(v) + (x - mu) * (x - mu) / v)) AS ld
    FROM o JOIN g USING (position) GROUP BY ALL),
w AS (SELECT id, label, ln(n / (SELECT count(*) FROM e)) + ld AS ll FROM d),
r AS (SELECT id, label, exp(ll - max(ll) OVER (PARTITION BY id)) AS p FROM w),
z AS (SELECT id, label, p / sum(p) OVER (PARTITION BY id) AS p FROM r)
SELECT id, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS component,
round(p, 4) AS probability FROM z QUALIFY p > 0.1""",
        "cluster_offsets": """WITH n AS (SELECT source, count(DISTINCT lang) AS n_local
    FROM documents GROUP BY source)
SELECT source, n_local, coalesce(sum(n_local) OVER (ORDER BY source ROWS BETWEEN
    UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM n""",
        "small_group_bypass": """SELECT doc_id, lang || source AS grp,
count(*) OVER (PARTITION BY lang || source) <= 11 AS bypassed FROM documents""",
        "explode_membership": f"WITH {MEMBERS} SELECT doc_id, cluster FROM m",
        "distinct_clusters": f"WITH {MEMBERS} SELECT DISTINCT cluster FROM m",
        "concat_cluster": f"""WITH s AS (SELECT lang, doc_id, text,
    (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 256 AS block FROM documents),
j AS (SELECT lang, block,
    string_agg(text, '--- --- ' || chr(10) || ' --- --- ' ORDER BY doc_id) AS joined
    FROM s GROUP BY ALL)
SELECT lang, block, length(joined)::INTEGER AS n_chars, md5(joined) AS digest FROM j""",
        "concat_cluster_text_keys": """WITH s AS (SELECT source, 'k' || (doc_id * 100000)::VARCHAR AS key,
    text FROM documents),
p AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key) - 1) // 20 AS block FROM s),
j AS (SELECT source, block,
    string_agg(text, '--- --- ' || chr(10) || ' --- --- ' ORDER BY key) AS joined FROM p GROUP BY ALL)
SELECT source, block, length(joined)::INTEGER AS n_chars, md5(joined) AS digest FROM j""",
        "summarise_extractive": f"""WITH {DOCS},
m AS (SELECT doc_id, round(avg(weight), 6) AS m FROM d_w GROUP BY doc_id)
SELECT source, doc_id, text AS summary FROM (SELECT source, doc_id, text, row_number() OVER (
    PARTITION BY source ORDER BY coalesce(m, 0) DESC, doc_id) AS o
    FROM documents LEFT JOIN m USING (doc_id)) WHERE o = 1""",
        "raptor_tree_fixed": f"WITH {TREE} SELECT level, cluster, summaries FROM t",
        "flatten_tree": f"WITH {TREE} SELECT level, node, text FROM nodes",
        "tree_export": f"""WITH {TREE} SELECT level, node, length(text)::INTEGER AS n_chars
FROM nodes""",
        "equal_embedding_pairs": f"""WITH {embed("e", "documents", "doc_id")}
SELECT doc_id, min(doc_id) OVER (PARTITION BY embedding) AS first_id,
count(*) OVER (PARTITION BY embedding) AS copies FROM e""",
        "table_cards": f"""WITH {CARDS} SELECT card_id, table_name, description,
'read-only' AS access, {total()} AS total FROM k JOIN ke USING (card_id)""",
        "retrieve_cards": f"""WITH {card_hits()} SELECT item_id, card_id, table_name, description
FROM h JOIN k USING (card_id)""",
        "question_to_sql": f"""WITH {card_hits()} SELECT item_id,
'SELECT * FROM warehouse.main.' || table_name AS query
FROM h JOIN k USING (card_id)""",
        "question_answer_rows": f"""WITH {card_hits()} SELECT item_id,
'SELECT count(*) AS row_count FROM warehouse.main.' || table_name AS query,
'{{"row_count":' || row_count || '}}' AS response,
'Found: {{"row_count":' || row_count || '}}' AS answer
FROM h JOIN k USING (card_id) JOIN n USING (table_name)""",
        "question_answer_all_rows": f"""WITH {card_hits()} SELECT item_id,
count(*) AS n_blocks, sum(row_count)::BIGINT AS n_rows FROM (
    SELECT item_id, unnest(range((row_count + 999) // 1000)) AS block,
        least(1000, row_count - 1000 * unnest(range((row_count + 999) // 1000))) AS row_count
    FROM h JOIN k USING (card_id) JOIN n USING (table_name)) GROUP BY item_id""",
        "join_keys": f"WITH {join_keys()} SELECT * FROM j",
        "join_paths": f"""WITH RECURSIVE {join_keys()},
w AS (SELECT child_table AS a, parent_table AS b, CASE WHEN
    regexp_replace(child_column, '^[a-z]{{1,2}}_', '') = regexp_replace(parent_column, '^[a-z]{{1,2}}_', '')
    THEN 1 ELSE 3 END AS cost FROM j),
e AS MATERIALIZED (SELECT a, b, min(cost) AS cost
    FROM (SELECT * FROM w UNION ALL SELECT b, a, cost FROM w) GROUP BY a, b),
p AS (SELECT a, b, cost FROM e
    UNION SELECT p.a, e.b, p.cost + e.cost FROM p JOIN e ON p.b = e.a WHERE p.cost + e.cost <= 12)
SELECT a AS from_table, b AS to_table, min(cost)::INTEGER AS cost FROM p WHERE a <> b GROUP BY a, b""",
        "join_two_tables": """SELECT c_custkey, c_name, r_name FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        "history_by_user": """SELECT event_id, user_id, ts, row_number() OVER (
    PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place
FROM events WHERE user_id IS NOT NULL""",
        "owned_lookup": "SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'",
        "nest_messages": """SELECT conv_id, turn // 1000 AS block, count(*) AS n_messages,
string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS rendered
FROM conversations GROUP BY ALL""",
    }
