"""The SQL of the queries that SQL can state."""

from __future__ import annotations

# Words as the operators take them: A-Z lower-cased, split at ASCII white space.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _LOWER + ", '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _shingles(table: str, key: str) -> str:
    """``key`` and ``s``: the distinct runs of five words; fewer words are one run."""
    words = _WORDS.format("coalesce(text, '')")
    return f"""
        SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(
            range(1, greatest(len(w) - 4, 1) + 1),
            lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s
        FROM (SELECT {key}, {words} AS w FROM {table})"""


_OP6 = f"""
WITH d AS ({_shingles("documents", "doc_id")}), b AS ({_shingles("benchmark", "item_id")}),
size AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, any_value(n) AS n_shingles
FROM d JOIN b USING (s) JOIN size USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)
"""

_OP3 = f"""
WITH RECURSIVE d AS MATERIALIZED ({_shingles("documents", "doc_id")}),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM d a JOIN d b USING (s) JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
    WHERE a.doc_id <> b.doc_id
    GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (
    SELECT a AS doc_id, a AS other FROM links
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, t.doc_id) AS component_id
FROM documents t LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
"""

# The marks and the strings that are escaped; see ``chat``.
_CONTROL = "(<[|](start|message|next|end|im_start|im_end)[|]>|</?s>|\\[/?INST\\])"
_ESCAPED = f"length(regexp_replace(replace({{0}}, chr(92), '##'), '{_CONTROL}', '\\0#', 'g'))"

_OP12 = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
marked AS (
    SELECT *, role IS DISTINCT FROM lag(role) OVER (
        PARTITION BY conv_id ORDER BY turn, role, text) AS opens
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({_ESCAPED.format("text")} + CASE WHEN opens
        THEN length('<|start|><|message|><|end|>') + {_ESCAPED.format("role")}
        ELSE length('<|next|>') END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_OP13 = f"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM documents),
words AS MATERIALIZED (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (
    SELECT lang, term, count(*) AS total FROM words GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
size AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY 1),
cells AS MATERIALIZED (
    SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS MATERIALIZED (
    SELECT lang, source, coalesce((SELECT sum(n) FROM cells c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n
    FROM (SELECT DISTINCT lang, source FROM d) g),
shares AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS have,
        CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (g.n + 2 * v) AS BIGINT) AS p,
        CAST(1 + 1000000000 * (k.total + 2)::HUGEINT // (lang_n + 2 * v) AS BIGINT) AS q
    FROM groups g JOIN size USING (lang) JOIN kept k USING (lang)
    LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY 1, 2, 3),
ranked AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE have > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 10
"""


def statements() -> dict[str, str]:
    return {"op3_ngram_join": _OP3, "op6_decontamination": _OP6, "op12_chat": _OP12, "op13_divergence": _OP13}
