"""DuckDB SQL for those pN_ queries that SQL can express on whole tables.

The others (token counts, label models, alignment, sampling by hash) are tested
against brute force on small fixtures in tests/llm.
"""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}\x{{00AD}}]', '', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_DIALOGUE = r"list_reduce(list_prepend('', list_transform(messages, lambda m: m.role || ':' || regexp_replace(lower(coalesce(m.content, '')), '[^\p{L}\p{N}]+', '', 'g') || '|')), lambda a, b: a || b)"

P3 = f"""WITH k AS (SELECT rec_id, {_DIALOGUE} AS k FROM v12_ru_dialogues WHERE messages IS NOT NULL),
g AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS n FROM k) """

P7 = """WITH tenth AS (SELECT floor(count(*) / 10.0) AS t FROM v13_shape_synth),
v AS (SELECT 'locale' AS field_name, lower(trim(meta.locale)) AS category FROM v13_shape_synth UNION ALL SELECT 'state', lower(trim(meta.state)) FROM v13_shape_synth UNION ALL SELECT 'persona', lower(trim(meta.persona)) FROM v13_shape_synth),
a AS (SELECT field_name, category, count(*) AS n FROM v GROUP BY 1, 2) """

P8 = f"""WITH i AS (SELECT id, {_WORDS.format("message")} AS w FROM cross_topic_regression), d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
iw AS (SELECT DISTINCT id, array_to_string(w[p:p + 11], ' ') AS g FROM i, unnest(range(1, len(w) - 10)) AS t(p)), dw AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS t(p)) """

# Any usual tokenizer gives the same sources, so words stand in for tokens.
P9 = f"""WITH t AS (SELECT source, sum(len({_WORDS.format("coalesce(text, '')")})) AS n FROM documents WHERE source IN (SELECT source FROM mix_targets) GROUP BY source), s AS (SELECT sum(n) AS total FROM t) """


# The language slice of problem 2: a lower-case primary subtag.
_TAG = "nullif(regexp_extract(lower(trim({0})), '^([a-z]{{2,3}})(?:$|[^a-z])', 1), '')"
P2 = f"""WITH u AS (SELECT 'val' AS tbl, source, {_TAG.format("lang")} AS tag FROM val UNION ALL SELECT 'documents', source, {_TAG.format("lang")} FROM documents UNION ALL SELECT 'v13_shape_synth', batch_name, {_TAG.format("meta.locale")} FROM v13_shape_synth),
d AS (SELECT source, min(domain_name) AS domain FROM sources GROUP BY source) """


def oracle_sql() -> dict[str, str]:
    return {
        "p2_slice_rows": P2 + "SELECT tbl, u.source, CASE tag WHEN 'eng' THEN 'en' WHEN 'rus' THEN 'ru' WHEN 'kaz' THEN 'kk' WHEN 'kz' THEN 'kk' ELSE tag END AS lang, domain, count(*) AS n_rows FROM u LEFT JOIN d ON d.source = u.source GROUP BY ALL",
        "p7_margins": P7 + "SELECT s.field_name, s.category, coalesce(a.n, 0) AS available, true AS kept FROM sample_targets s LEFT JOIN a ON a.field_name = s.field_name AND a.category = s.category",
        "p9_margins": "SELECT m.source, count(*) AS n_docs, true AS within FROM documents d JOIN mix_targets m ON m.source = d.source GROUP BY m.source",
        "p3_found": P3 + "SELECT keep_id, rec_id AS dup_id FROM g WHERE rec_id <> keep_id",
        "p3_collapsed": P3 + "SELECT rec_id, n AS n_copies FROM g WHERE rec_id = keep_id",
        "p7_found": P7 + "SELECT s.field_name, s.category FROM sample_targets s LEFT JOIN a ON a.field_name = s.field_name AND a.category = s.category, tenth WHERE coalesce(a.n, 0) < greatest(s.min_rows, s.target_share * t)",
        "p8_found": P8 + "SELECT DISTINCT doc_id, id AS item_id FROM dw JOIN iw ON dw.g = iw.g",
        "p8_items": P8 + "SELECT id AS item_id, count(DISTINCT doc_id) AS n_docs FROM dw JOIN iw ON dw.g = iw.g GROUP BY id",
        "p9_found": P9 + "SELECT m.source FROM mix_targets m LEFT JOIN t ON t.source = m.source, s WHERE coalesce(t.n, 0) * m.max_repeats < m.target_share * s.total",
    }
