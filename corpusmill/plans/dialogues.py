"""Queries over turns, records and their keys: parsing, pairing, deduplication, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import lang, text
from corpusmill.functions.text import CYRILLIC
from corpusmill.operators import chunking, dedup, sampling, turns
from corpusmill.plans.catalog import query
from corpusmill.runtime import load

TURNS = "turns AS (SELECT rec_id, (i - 1)::INT AS turn, messages[i].role AS role, messages[i].content AS content FROM v12_ru_dialogues, unnest(generate_series(1, len(messages))) AS t(i))"
SQUASH = r"trim(regexp_replace({0}, '[ \t\r\n\f]+', ' ', 'g'))"
NORM = "lower(" + SQUASH.format("coalesce(response, '')") + ")"
KEY = "md5(concat_ws(':', {0}::VARCHAR, '{1}'))"
TURN_RE = r"(?s)<\|im_start\|>([A-Za-z]+)[ \t]*\r?\n?(.*?)<\|(?:redacted_)?im_end\|>"
TOK = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _turns(spark, sf_dir):
    return turns.explode_turns(load(spark, sf_dir, "v12_ru_dialogues"), "rec_id")


@query(f"WITH {TURNS} SELECT * FROM turns")
def explode_turns(spark, sf_dir):
    return _turns(spark, sf_dir)


@query(f"SELECT row_id, array_to_string(regexp_extract_all(text, '{TURN_RE}', 1), ',') AS roles, list_sum(list_transform(regexp_extract_all(text, '{TURN_RE}', 2), lambda x: length(x)))::BIGINT AS n_chars FROM val")
def chatml_parse(spark, sf_dir):
    m = turns.parse_chatml(F.col("text"))
    t = load(spark, sf_dir, "val").withColumn("m", m)
    return t.select("row_id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("n_chars"))


@query(r"SELECT row_id, coalesce(regexp_extract_all(text, '(?s)<\|im_start\|>assistant[ \t]*\r?\n?(.*?)<\|(?:redacted_)?im_end\|>', 1)[-1], '') AS reply FROM train")
def last_assistant(spark, sf_dir):
    return load(spark, sf_dir, "train").select("row_id", turns.last_of(turns.parse_chatml(F.col("text")), "assistant").alias("reply"))


@query(f"WITH {TURNS} SELECT rec_id, min_by(content, turn) FILTER (role = 'user') AS first_user, min_by(content, turn) FILTER (role = 'assistant') AS first_assistant FROM (SELECT * REPLACE (coalesce(content, '') AS content) FROM turns) GROUP BY rec_id")
def first_turns(spark, sf_dir):
    t = load(spark, sf_dir, "v12_ru_dialogues")
    m = F.col("messages")
    return t.select("rec_id", F.coalesce(turns.first_of(m, "user"), F.lit("")).alias("first_user"), F.coalesce(turns.first_of(m, "assistant"), F.lit("")).alias("first_assistant"))


@query("SELECT rec_id, array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10)), '') AS text FROM v12_ru_dialogues")
def chatml_render(spark, sf_dir):
    return load(spark, sf_dir, "v12_ru_dialogues").select("rec_id", turns.render_chatml(F.col("messages")).alias("text"))


@query("SELECT rec_id, len(messages) + 1 AS n, 'Locale ' || coalesce(lower(trim(meta.locale)), 'en') || ', persona ' || coalesce(lower(trim(meta.persona)), 'flexible') || '.' AS system FROM v13_shape_synth")
def system_prompt_fill(spark, sf_dir):
    prompt = F.concat(F.lit("Locale "), F.coalesce(F.lower(F.trim("meta.locale")), F.lit("en")), F.lit(", persona "), F.coalesce(F.lower(F.trim("meta.persona")), F.lit("flexible")), F.lit("."))
    t = load(spark, sf_dir, "v13_shape_synth").withColumn("m", turns.with_system(F.col("messages"), prompt))
    return t.select("rec_id", F.size("m").alias("n"), F.col("m")[0]["content"].alias("system"))


@query(f"WITH {TURNS}, p AS (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS reply FROM turns WINDOW w AS (PARTITION BY rec_id ORDER BY turn)) SELECT rec_id, turn, content AS query, reply FROM p WHERE role = 'user' AND nr = 'assistant' AND length(content) >= 8 AND length(reply) >= 16")
def user_assistant_pairs(spark, sf_dir):
    return turns.adjacent_pairs(_turns(spark, sf_dir), "rec_id")


@query(f"WITH {TURNS} SELECT rec_id, turn, role, content, row_number() OVER (PARTITION BY rec_id ORDER BY turn DESC) AS back FROM turns QUALIFY back <= 2")
def last_k_turns(spark, sf_dir):
    return turns.last_turns(_turns(spark, sf_dir), "rec_id", 2)


@query(f"WITH {TURNS}, u AS (SELECT *, sum(coalesce(length(content), 0)) OVER w AS used, count(*) OVER w AS back FROM turns WINDOW w AS (PARTITION BY rec_id ORDER BY turn DESC)) SELECT rec_id, turn, role, content, used::BIGINT AS used FROM u WHERE used <= 400 OR back = 1")
def token_budget_fit(spark, sf_dir):
    return turns.within_budget(_turns(spark, sf_dir), "rec_id", 400)


@query(f"WITH {TURNS}, u AS (SELECT *, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM turns) SELECT rec_id, turn, role, content, CASE WHEN n = 0 THEN 'open' WHEN n >= 5 THEN 'closing' ELSE 'deepening' END AS phase FROM u")
def phase_by_turn(spark, sf_dir):
    return turns.phase_by_count(_turns(spark, sf_dir), "rec_id")


@query(f"WITH {TURNS} SELECT rec_id, string_agg(left(coalesce(content, ''), 120), ' / ' ORDER BY turn) AS context, count(*) AS n FROM turns WHERE role = 'user' GROUP BY rec_id")
def recent_user_context(spark, sf_dir):
    t = _turns(spark, sf_dir).where("role = 'user'")
    g = t.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.left(F.coalesce("content", F.lit("")), F.lit(120)).alias("c")))).alias("a"), F.count(F.lit(1)).alias("n"))
    return g.select("rec_id", F.array_join(F.transform("a", lambda x: x["c"]), " / ").alias("context"), "n")


_PHASES = ["crisis", "psychoed", "action", "disclosure", "intake"]


@query(r"""WITH u AS (SELECT rec_id, list_filter(messages, lambda m: m.role = 'user')[-1].content AS c FROM v12_ru_dialogues)
SELECT rec_id, CASE WHEN regexp_matches(lower(c), 'опасно|не хочу жить') THEN 'crisis' WHEN regexp_matches(lower(c), 'почему|откуда|зачем') THEN 'psychoed' WHEN regexp_matches(lower(c), 'пробую|советуют|обещаю') THEN 'action'
WHEN regexp_matches(lower(c), 'чувству|стыд|боюсь') OR len(string_split(c, ' ')) > 25 THEN 'disclosure' ELSE 'intake' END AS phase FROM u""")
def detect_phase(spark, sf_dir):
    c = turns.last_of(F.col("messages"), "user")
    low = F.lower(c)
    phase = (
        F.when(low.rlike("опасно|не хочу жить"), "crisis").when(low.rlike("почему|откуда|зачем"), "psychoed").when(low.rlike("пробую|советуют|обещаю"), "action")
        .when(low.rlike("чувству|стыд|боюсь") | (F.size(F.split(c, " ")) > 25), "disclosure").otherwise("intake")
    )
    return load(spark, sf_dir, "v12_ru_dialogues").select("rec_id", phase.alias("phase"))


@query(r"""WITH a AS (SELECT rec_id, coalesce(list_filter(messages, lambda m: m.role = 'assistant')[-1].content, '') AS c FROM v12_ru_dialogues)
SELECT rec_id, CASE WHEN regexp_matches(lower(c), '^(привет|здравствуй)') THEN 'greeting' WHEN regexp_matches(lower(c), 'один маленький шаг|попробовать') THEN 'action' WHEN contains(c, '?') AND regexp_matches(lower(c), 'слышу|похоже|здесь есть') THEN 'reflect_question'
WHEN contains(c, '?') THEN 'question' WHEN c = '' THEN 'empty' ELSE 'reflect' END AS shape FROM a""")
def response_shape(spark, sf_dir):
    c = turns.last_of(F.col("messages"), "assistant")
    low = F.lower(c)
    shape = (
        F.when(low.rlike("^(привет|здравствуй)"), "greeting").when(low.rlike("один маленький шаг|попробовать"), "action").when(F.contains(c, F.lit("?")) & low.rlike("слышу|похоже|здесь есть"), "reflect_question")
        .when(F.contains(c, F.lit("?")), "question").when(c == "", "empty").otherwise("reflect")
    )
    return load(spark, sf_dir, "v12_ru_dialogues").select("rec_id", shape.alias("shape"))


# --- keys and deduplication ---
@query(f"SELECT resp_id, id, response FROM endpoint_baseline QUALIFY row_number() OVER (PARTITION BY {NORM} ORDER BY ingested_at, resp_id) = 1")
def dedup_first_wins(spark, sf_dir):
    t = load(spark, sf_dir, "endpoint_baseline").select("resp_id", "id", "response", "ingested_at")
    return dedup.first_by_key(t, text.norm_key(F.coalesce("response", F.lit(""))), [F.col("ingested_at"), F.col("resp_id")]).drop("ingested_at")


@query("SELECT dialog_id, max_by(rec_id, (ingested_at, rec_id)) AS rec_id, count(*) AS deliveries FROM v12_ru_dialogues GROUP BY dialog_id")
def checkpoint_upsert(spark, sf_dir):
    """Latest delivery of each dialogue (last write wins)."""
    t = load(spark, sf_dir, "v12_ru_dialogues")
    return t.groupBy("dialog_id").agg(F.max_by("rec_id", F.struct("ingested_at", "rec_id")).alias("rec_id"), F.count(F.lit(1)).alias("deliveries"))


@query("SELECT min(row_id) AS row_id, sha256(text) AS digest, count(*) AS n FROM train GROUP BY sha256(text)")
def dedup_exact_hash(spark, sf_dir):
    return load(spark, sf_dir, "train").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, source FROM train WHERE sha256(text) NOT IN (SELECT sha256(text) FROM val)")
def dedup_vs_gold(spark, sf_dir):
    train, val = load(spark, sf_dir, "train"), load(spark, sf_dir, "val")
    return dedup.not_in(train, val.withColumnRenamed("text", "gold"), F.sha2("text", 256), F.sha2("gold", 256)).select("row_id", "source")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY substr(lower(text), 1, 160) ORDER BY doc_id) = 1")
def dedup_prefix_160(spark, sf_dir):
    return dedup.first_by_key(load(spark, sf_dir, "documents").select("doc_id", "text"), text.prefix_key(F.col("text"), 160), [F.col("doc_id")]).select("doc_id")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY substr(lower(text), 1, 40) ORDER BY doc_id) <= 2 OR substr(lower(text), 1, 40) = ''")
def keep_m_per_key(spark, sf_dir):
    return dedup.keep_per_key(load(spark, sf_dir, "documents").select("doc_id", "text"), text.prefix_key(F.col("text"), 40), [F.col("doc_id")], 2).select("doc_id")


@query("SELECT substr(lower(response), 1, 100) AS key, count(*) AS n FROM endpoint_baseline WHERE response IS NOT NULL GROUP BY 1 HAVING count(*) > 3 ORDER BY n DESC, key LIMIT 5")
def duplicates_top_5(spark, sf_dir):
    t = load(spark, sf_dir, "endpoint_baseline").where("response is not null")
    return dedup.over_frequency(t, text.prefix_key(F.col("response"), 100), 3).orderBy(F.desc("n"), "key").limit(5)


@query("SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.35")
def similar_vector_pairs(spark, sf_dir):
    return dedup.similar_pairs(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.35).withColumn("sim", F.round("sim", 9))


@query()
def greedy_semantic_dedup(spark, sf_dir):
    """Vectors a sequential pass keeps at cosine 0.30 (iterative; checked against brute force in the tests)."""
    v = load(spark, sf_dir, "embeddings")
    return dedup.greedy_keep(v, dedup.similar_pairs(v, "vec_id", "embedding", 0.30), "vec_id").withColumnRenamed("id", "vec_id")


@query("SELECT source FROM documents WHERE source IS NOT NULL UNION SELECT source FROM sources UNION SELECT source FROM mix_targets")
def source_discovery(spark, sf_dir):
    t = [load(spark, sf_dir, n).select("source") for n in ("documents", "sources", "mix_targets")]
    return t[0].where("source is not null").union(t[1]).union(t[2]).distinct()


@query("SELECT row_id, coalesce(nullif(trim(lower(lang)), ''), 'und') AS lang FROM train WHERE text IS NOT NULL AND trim(text) <> ''")
def nonempty_rows(spark, sf_dir):
    t = load(spark, sf_dir, "train").where("text is not null and trim(text) <> ''")
    return t.select("row_id", F.coalesce(F.nullif(F.trim(F.lower("lang")), F.lit("")), F.lit("und")).alias("lang"))


# --- splits, quotas, weights ---
@query(f"SELECT doc_id, CASE WHEN ('0x' || substr({KEY.format('doc_id', 42)}, 1, 7))::BIGINT % 1000 < 100 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return sampling.hash_split(load(spark, sf_dir, "documents"), "doc_id", 100).select("doc_id", "split")


@query(f"WITH k AS (SELECT doc_id, coalesce(tone, '') AS s, {KEY.format('doc_id', 42)} AS k FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) AS r, count(*) OVER (PARTITION BY s) AS n FROM k) SELECT doc_id, CASE WHEN r <= floor(n * 0.1 + 0.5) THEN 'val' ELSE 'train' END AS split FROM r")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(load(spark, sf_dir, "documents"), "doc_id", F.col("tone"), 0.1).select("doc_id", "split")


@query(f"WITH k AS (SELECT rec_id, lower(trim(meta.locale)) AS grp, {KEY.format('rec_id', 42)} AS k FROM v13_shape_synth), q AS (SELECT * FROM (VALUES ('en', 60), ('ru', 50), ('kk', 40)) t(grp, n)) SELECT rec_id, grp FROM (SELECT k.*, q.n, row_number() OVER (PARTITION BY k.grp ORDER BY k.k) AS r FROM k JOIN q ON k.grp = q.grp) WHERE r <= n")
def locale_quota(spark, sf_dir):
    q = spark.createDataFrame([("en", 60), ("ru", 50), ("kk", 40)], "grp string, n int")
    return sampling.quota(load(spark, sf_dir, "v13_shape_synth"), "rec_id", F.lower(F.trim("meta.locale")), q).select("rec_id", "grp")


@query("SELECT doc_id, g AS copy FROM documents, unnest(generate_series(1, CASE WHEN source LIKE '%cards' THEN 5 ELSE 1 END)) AS t(g)")
def weighted_copies(spark, sf_dir):
    w = F.when(F.col("source").like("%cards"), 5).otherwise(1)
    return sampling.oversample(load(spark, sf_dir, "documents").select("doc_id", "source"), w).select("doc_id", F.col("copy").cast("long").alias("copy"))


@query("WITH h AS (SELECT left(lower(message), 30) AS s FROM cross_topic_regression) SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE contains(lower(text), h.s)) THEN 'val' ELSE 'train' END AS split FROM documents")
def held_out_routing(spark, sf_dir):
    """Documents with the opening of an evaluation message go to val.

    The evaluation set is fixed material (240 rows); its snippets are counted
    before they become one literal array.
    """
    items = load(spark, sf_dir, "cross_topic_regression").select(F.left(F.lower("message"), F.lit(30)).alias("s")).distinct()
    snippets = items.groupBy().agg(F.collect_set("s").alias("snips"))
    if items.count() > 10_000:
        raise ValueError("too many snippets for a scan; use the window join of the leakage operator")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"), snippets.scalar().alias("snips"))
    hit = F.exists("snips", lambda s: F.contains("low", s))
    return docs.select("doc_id", F.when(hit, "val").otherwise("train").alias("split"))


# --- chunks ---
@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents), n AS (SELECT *, len(w) AS n FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, w, n, g::INT AS start FROM n, unnest(generate_series(0, CASE WHEN n <= 60 THEN 0 ELSE (ceil((n - 60) / 40.0) * 40)::INT END, 40)) AS t(g))
SELECT doc_id, start, array_to_string(w[start + 1:start + 60], ' ') AS chunk FROM s WHERE start = 0 OR least(n - start, 60) >= 10""")
def word_windows(spark, sf_dir):
    return chunking.word_windows(load(spark, sf_dir, "documents"), "doc_id", "text", 60, 20, 10)


@query("""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, unnest(generate_series(1, len(string_split(text, chr(10))))) AS t(i)),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,3} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
SELECT doc_id, section::BIGINT AS section, max(CASE WHEN regexp_matches(line, '^#{1,3} ') THEN regexp_replace(line, '^#{1,3} ', '') END) AS title, count(*) AS n_lines FROM s GROUP BY doc_id, section""")
def section_split(spark, sf_dir):
    return chunking.sections(load(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def pack_paragraphs(spark, sf_dir):
    return chunking.pack_paragraphs(load(spark, sf_dir, "documents"), "doc_id", "text", 400)


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i+1])) AS term FROM (SELECT doc_id, {TOK.format('text')} AS w FROM documents)) GROUP BY term HAVING count(*) >= 5")
def ngram_explode(spark, sf_dir):
    t = load(spark, sf_dir, "documents").select("doc_id", F.explode(text.ngrams(text.tokens(F.col("text")), 2)).alias("term"))
    per = t.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs")).where("n >= 5")


@query("WITH p AS (SELECT config, coalesce(locale, 'und') AS locale, count(*) AS n FROM endpoint_baseline WHERE config IS NOT NULL GROUP BY 1, 2) SELECT config, locale, (b + 1)::INT AS batch, least(50, n - b * 50)::INT AS size FROM p, unnest(generate_series(0, ceil(n / 50.0)::INT - 1)) AS t(b)")
def batch_expansion(spark, sf_dir):
    p = load(spark, sf_dir, "endpoint_baseline").where("config is not null").groupBy("config", F.coalesce("locale", F.lit("und")).alias("locale")).agg(F.count(F.lit(1)).alias("n"))
    t = p.withColumn("b", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / 50) - 1).cast("int"))))
    return t.select("config", "locale", (F.col("b") + 1).alias("batch"), F.least(F.lit(50), F.col("n") - F.col("b") * 50).cast("int").alias("size"))


@query("SELECT doc_id, source, lang, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY doc_id) AS slot, ((doc_id - 1) % 7)::INT AS bucket FROM documents")
def interleave_slots(spark, sf_dir):
    """Round-robin order by language: sort by (slot, lang) to interleave."""
    t = sampling.slots(load(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id", F.col("lang"))
    return t.withColumn("bucket", F.pmod(F.col("doc_id") - 1, F.lit(7)).cast("int"))


@query(f"SELECT doc_id, lang, CASE WHEN length(regexp_replace(text, '[^әғқңөұүһіӘҒҚҢӨҰҮҺІ]', '', 'g')) > length(regexp_replace(text, '[^{CYRILLIC}]', '', 'g')) * 0.05::DOUBLE THEN 'kk' WHEN length(regexp_replace(text, '[^{CYRILLIC}]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'ru' ELSE 'en' END AS detected FROM documents WHERE lang IS NOT NULL AND lower(trim(lang)) <> detected")
def lang_disagreement(spark, sf_dir):
    t = load(spark, sf_dir, "documents").withColumn("detected", lang.with_kazakh(F.col("text")))
    return t.where("lang is not null").where(F.lower(F.trim("lang")) != F.col("detected")).select("doc_id", "lang", "detected")
