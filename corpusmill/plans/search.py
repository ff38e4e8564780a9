"""Queries of retrieval and of event sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import retrieval, timeline
from corpusmill.plans.catalog import query
from corpusmill.runtime import block_join, load, scratch

TOK = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')"
def _bm25_sql(name: str, docs: str) -> str:
    """CTEs that end in ``name``(query_id, id, score) over the documents of a condition."""
    p = name
    return f"""{p}_d AS (SELECT doc_id AS id, {TOK.format("coalesce(text, '')")} AS w FROM documents WHERE {docs}), {p}_len AS (SELECT id, len(w) AS dl FROM {p}_d), {p}_post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM {p}_d) GROUP BY 1, 2),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_post GROUP BY term), {p}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}_len), {p}_raw AS (SELECT term, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM {p}_df, {p}_st), {p}_mi AS (SELECT avg(idf) AS m FROM {p}_raw),
{p}_idf AS (SELECT term, avgdl, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM {p}_raw, {p}_mi), {p}_q AS (SELECT id AS query_id, unnest({TOK.format('message')}) AS term FROM cross_topic_regression),
{p} AS (SELECT q.query_id, post.id, sum(idf.idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {p}_q q JOIN {p}_idf idf ON q.term = idf.term JOIN {p}_post post ON q.term = post.term JOIN {p}_len len ON len.id = post.id GROUP BY 1, 2 HAVING score > 0)"""


def _ranked(name: str, most: int) -> str:
    return f"SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {name} QUALIFY rank <= {most}"


def _queries(spark, sf_dir):
    return load(spark, sf_dir, "cross_topic_regression").select(F.col("id").alias("query_id"), F.col("message").alias("text"), F.col("locale").alias("lang"), F.lit("opening").alias("phase"))


@query(f"WITH {_bm25_sql('bm', 'true')} {_ranked('bm', 5)}")
def bm25_top_k(spark, sf_dir):
    return retrieval.bm25_top(load(spark, sf_dir, "documents"), _queries(spark, sf_dir), "doc_id", "text", 5)


@query(f"WITH {_bm25_sql('bm', 'true')} {_ranked('bm', 5)}")
def bm25_stored_index(spark, sf_dir):
    """The same from an index that was written first."""
    index = retrieval.Index.build(load(spark, sf_dir, "documents"), scratch(spark, "bm25"), "doc_id", "text")
    return index.top(_queries(spark, sf_dir), 5)


BOOKS = ("shelf_scans", "course_texts", "therapy_primers", "clinic_leaflets")
_IS_BOOK = "coalesce(source IN (" + ", ".join(f"'{b}'" for b in BOOKS) + "), false)"
_VEC = "SELECT {0} AS id, b, sum(1) AS c FROM (SELECT {0}, ('0x' || substr(md5(unnest({1})), 1, 2))::INT AS b FROM {2}) GROUP BY 1, 2"
DENSE = f"""qv AS ({_VEC.format("id", TOK.format("message"), "cross_topic_regression")}), dv AS ({_VEC.format("doc_id", TOK.format("coalesce(text, '')"), f"(SELECT * FROM documents WHERE NOT {_IS_BOOK})")}),
qn AS (SELECT id, sqrt(sum(c * c)) AS n FROM qv GROUP BY id), dn AS (SELECT id, sqrt(sum(c * c)) AS n FROM dv GROUP BY id), dots AS (SELECT qv.id AS query_id, dv.id, sum(qv.c * dv.c)::DOUBLE AS dot FROM qv JOIN dv ON qv.b = dv.b GROUP BY 1, 2),
dense AS (SELECT query_id, dots.id, dot / (qn.n * dn.n) AS score FROM dots JOIN qn ON qn.id = query_id JOIN dn ON dn.id = dots.id)"""


@query(f"""WITH {_bm25_sql('talk', f"NOT {_IS_BOOK}")}, {_bm25_sql('books', _IS_BOOK)}, {DENSE}, s AS (SELECT query_id, id, rank, score AS cosine FROM ({_ranked('dense', 24)}) UNION ALL SELECT query_id, id, rank, NULL FROM ({_ranked('talk', 24)}) UNION ALL SELECT query_id, id, rank, NULL FROM ({_ranked('books', 24)})),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max(cosine) AS cosine, bool_or(cosine IS NULL) AS by_words FROM s GROUP BY 1, 2),
c AS (SELECT f.*, list_position(CASE lower(trim(q.locale)) WHEN 'en' THEN ['en'] WHEN 'ru' THEN ['ru', 'en'] WHEN 'kk' THEN ['kk', 'ru', 'en'] ELSE [lower(trim(q.locale)), 'en'] END, coalesce(lower(trim(d.lang)), 'en')) - 1 AS steps, CASE WHEN NOT {_IS_BOOK} AND d.phase = 'opening' THEN 1.0::DOUBLE / 60 ELSE 0 END AS bonus, left(lower(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')), 80) AS start FROM f JOIN documents d ON d.doc_id = f.id JOIN cross_topic_regression q ON q.id = f.query_id),
g AS (SELECT query_id, id, start, round(rrf + bonus - steps * (0.5::DOUBLE / 60), 9) AS score FROM c WHERE steps >= 0 AND (by_words OR cosine >= 0.3) AND start <> ''), h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id, start ORDER BY score DESC, id) = 1)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= 3""")
def rrf_hybrid(spark, sf_dir):
    """Cosine and BM25 over dialogues and BM25 over books, fused, gated by language and cosine, with a phase bonus."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "phase", F.coalesce(F.col("source").isin(*BOOKS), F.lit(False)).alias("book"))
    return retrieval.hybrid(_queries(spark, sf_dir), docs)


@query("SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5")
def cosine_top_k(spark, sf_dir):
    """Every id divisible by 100 against all vectors, in blocks of queries.

    The query block is an array literal of bounded size; vectors stream past it.
    """
    from corpusmill.operators.vector_search import top_k

    v = load(spark, sf_dir, "embeddings")
    return top_k(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 5)


@query("""WITH s AS (SELECT q.vec_id AS query_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score, v.label <> 3 AS consented, v.vec_id > 100 AS recent FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND q.label = v.label WHERE q.vec_id % 100 = 0),
g AS (SELECT query_id, count(*) FILTER (consented) AS nc, count(*) FILTER (consented AND recent) AS nu, max(score) FILTER (consented AND recent) AS best, count(*) FILTER (consented AND recent AND score >= 0.3) AS nf, count(*) FILTER (consented AND recent AND score >= 0.2) AS np, avg(score) FILTER (consented AND recent AND score >= 0.3) AS mf, avg(score) FILTER (consented AND recent AND score >= 0.2) AS mp FROM s GROUP BY 1),
t AS (SELECT *, CASE WHEN nc = 0 THEN 'data_excluded_by_consent' WHEN nu = 0 THEN 'no_data_in_window' WHEN best < 0.2 THEN 'below_threshold' WHEN best >= 0.3 THEN 'fully' ELSE 'partially' END AS state FROM g)
SELECT query_id, state, CASE state WHEN 'fully' THEN nf WHEN 'partially' THEN np ELSE 0 END AS n_evidence, round(CASE state WHEN 'fully' THEN mf WHEN 'partially' THEN mp END, 9) AS similarity FROM t""")
def evidence_sufficiency(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), "label")
    # A label may hold a third of all vectors: its join is cut into blocks.
    s = block_join(q, v, ["label"], F.col("query_id"), F.col("vec_id"), 20_000).where("query_id <> vec_id").select("query_id", retrieval.cosine(F.col("qv"), F.col("embedding")).alias("score"), (F.col("label") != 3).alias("consented"), (F.col("vec_id") > 100).alias("recent"))
    return retrieval.sufficiency(s, 0.3, 0.2).withColumn("similarity", F.round("similarity", 9))


@query("WITH p AS (SELECT a.label, a.vec_id AS ia, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), c AS (SELECT label, ia, avg(s) AS central, count(*) AS n FROM p GROUP BY 1, 2) SELECT label, round(avg(central), 9) AS consensus, avg(central) >= 0.0 AS consistent, max_by(ia, (round(central, 9), -ia)) AS chosen FROM c GROUP BY label")
def self_consistency(spark, sf_dir):
    """Sample groups: mean pairwise cosine, whether it reaches a threshold, and the most central sample."""
    c = retrieval.consensus(load(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return c.select("label", F.round("consensus", 9).alias("consensus"), (F.col("consensus") >= 0.0).alias("consistent"), "chosen")


@query(f"WITH b AS (SELECT resp_id, id, response, 100 * greatest(len(regexp_extract_all(response, '[^.!?]+[.!?]+')), 1) + CASE WHEN contains(response, '?') THEN 50 ELSE 0 END + length(response) AS score FROM endpoint_baseline WHERE response IS NOT NULL) SELECT id, max_by(resp_id, (score, -resp_id)) AS resp_id, max(score)::BIGINT AS score FROM b GROUP BY id")
def best_candidate(spark, sf_dir):
    r = F.col("response")
    score = 100 * text.sentences_closed(r) + F.when(F.contains(r, F.lit("?")), 50).otherwise(0) + F.length(r)
    t = load(spark, sf_dir, "endpoint_baseline").where("response is not null").withColumn("score", score.cast("long"))
    return t.groupBy("id").agg(F.max_by("resp_id", F.struct("score", -F.col("resp_id"))).alias("resp_id"), F.max("score").alias("score"))


@query(f"WITH q AS (SELECT id, {TOK.format('message')} AS w FROM cross_topic_regression), e AS (SELECT resp_id, {TOK.format('message')} AS w FROM endpoint_baseline), s AS (SELECT q.id, e.resp_id, len(list_intersect(list_distinct(q.w), list_distinct(e.w))) AS overlap FROM q, e) SELECT id, resp_id, overlap::BIGINT AS overlap FROM s WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, resp_id) <= 3")
def few_shot_by_overlap(spark, sf_dir):
    """The three prompts that share most words with each case: a join on words, no cross product."""
    q = load(spark, sf_dir, "cross_topic_regression").select("id", F.explode(F.array_distinct(text.tokens(F.col("message")))).alias("w"))
    e = load(spark, sf_dir, "endpoint_baseline").select("resp_id", F.explode(F.array_distinct(text.tokens(F.col("message")))).alias("w"))
    s = q.join(e, "w").groupBy("id", "resp_id").agg(F.count(F.lit(1)).alias("overlap"))
    w = Window.partitionBy("id").orderBy(F.desc("overlap"), "resp_id")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


# --- event sequences ---
EDGES = [("view", "click", 0.0, 24.0), ("click", "purchase", 0.5, 240.0), ("view", "purchase", 1.0, float("inf")), ("signup", "view", 0.0, 720.0), ("error", "view", 0.0, 12.0), ("click", "view", 0.0, 48.0)]
STEPS = "steps AS (SELECT user_id, event_type AS \"from\", lead(event_type) OVER w AS \"to\", ts, date_diff('second', ts, lead(ts) OVER w) / 3600.0 AS hours FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events")


def _steps(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ts", F.date_trunc("second", F.col("ts")).cast("timestamp_ntz"))
    return timeline.adjacent(e, "user_id", ["ts", "event_id"], "event_type")


@query(f"WITH {STEPS.replace('FROM events', '''FROM (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS ts FROM events)''')} SELECT user_id, \"from\", \"to\", ts, hours FROM steps WHERE \"to\" IS NOT NULL AND \"to\" <> \"from\"")
def adjacent_transitions(spark, sf_dir):
    return _steps(spark, sf_dir)


@query(f"WITH {STEPS.replace('FROM events', '''FROM (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS ts FROM events)''')}, e AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {lo}::DOUBLE, {'1e308' if hi == float('inf') else hi}::DOUBLE)" for a, b, lo, hi in EDGES) + ") t(a, b, lo, hi)) SELECT CASE WHEN lo IS NULL THEN 'no_edge' WHEN hours < lo THEN 'too_fast' WHEN hours > hi THEN 'too_slow' ELSE 'ok' END AS verdict, count(*) AS n FROM steps LEFT JOIN e ON a = \"from\" AND b = \"to\" WHERE \"to\" IS NOT NULL AND \"to\" <> \"from\" GROUP BY 1")
def transition_verdicts(spark, sf_dir):
    edges = spark.createDataFrame(EDGES, "`from` string, `to` string, min_hours double, max_hours double")
    return timeline.validate_transitions(_steps(spark, sf_dir), edges).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, CASE WHEN len(v) < 2 THEN NULL WHEN len(list_filter(range(1, len(v)), lambda i: v[i+1] <= v[i])) = 0 THEN 'rising' WHEN len(list_filter(range(1, len(v)), lambda i: v[i+1] >= v[i])) = 0 THEN 'falling' ELSE 'mixed' END AS trend FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3) GROUP BY user_id)")
def monotone_trend(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = _events(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3")
    g = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("a"))  # three rows per user
    return g.select("user_id", timeline.monotone(F.transform("a", lambda x: x["value"])).alias("trend"))


@query("SELECT user_id, event_type, count(*) AS n, count(DISTINCT date_trunc('day', ts)) AS n_days, date_diff('second', min(ts), max(ts)) / 3600.0 AS span_hours, count(*) >= 3 AND count(DISTINCT date_trunc('day', ts)) >= 2 AND date_diff('second', min(ts), max(ts)) / 3600.0 >= 0.7 * 336 AS supported FROM (SELECT user_id, event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id, event_type")
def span_coverage(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_type", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    span = timeline.hours_between(F.min("ts"), F.max("ts"))
    days = F.count_distinct(F.date_trunc("day", "ts"))
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), days.alias("n_days"), span.alias("span_hours"), ((F.count(F.lit(1)) >= 3) & (days >= 2) & (span >= 0.7 * 336)).alias("supported"))


@query("SELECT user_id, event_type, count(*) AS n, max(ts) AS latest FROM events WHERE ts > TIMESTAMP '2024-01-16 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY user_id, event_type")
def recency_window(spark, sf_dir):
    t = _events(spark, sf_dir).where((F.col("ts") > F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")) & (F.col("ts") <= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")))
    return t.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


@query("SELECT DISTINCT a.user_id, a.d AS day FROM (SELECT DISTINCT user_id, date_trunc('day', ts)::DATE AS d FROM events WHERE event_type = 'error') a JOIN (SELECT DISTINCT user_id, date_trunc('day', ts)::DATE AS d FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.d = b.d")
def same_day_cooccurrence(spark, sf_dir):
    """Two labels of one subject on one day: one group and two flags, no self-join."""
    t = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "error").alias("e"), F.bool_or(F.col("event_type") == "purchase").alias("p"))
    return t.where("e and p").select("user_id", "day")


@query("WITH n AS (SELECT user_id, ts, CASE WHEN date_diff('second', lag(ts) OVER w, ts) / 3600.0 * 60 > 60 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new, event_id FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session FROM n) SELECT user_id, session, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM s GROUP BY 1, 2")
def session_windows(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ts", F.date_trunc("second", F.col("ts")).cast("timestamp_ntz"))
    return timeline.sessions(e, "user_id", 60)


@query("SELECT user_id, string_agg(event_type || ': ' || round(value, 2)::VARCHAR || '/5', chr(10) ORDER BY ts, event_id) AS report FROM (SELECT * REPLACE (floor(value) AS value) FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 4) GROUP BY user_id")
def checkin_report(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    t = _events(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 4").withColumn("line", F.concat("event_type", F.lit(": "), F.floor("value").cast("double").cast("string"), F.lit("/5")))
    g = t.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "line"))).alias("a"))  # four rows per user
    return g.select("user_id", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("report"))


@query()
def levenshtein_attribution(spark, sf_dir):
    """Similarity of answer and prompt; SQL engines differ on letters beyond ASCII, so the tests check it."""
    a, b = F.lower("response"), F.lower("message")
    ratio = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return load(spark, sf_dir, "endpoint_baseline").where("response is not null").select("resp_id", F.round(ratio, 9).alias("ratio"))
