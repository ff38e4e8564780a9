"""Queries of row gates, balance, order, repair of model output, and of reading back what was written."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import chunking, cleaning, dedup, sampling, timeline
from corpusmill.plans.catalog import query
from corpusmill.plans.search import TOK
from corpusmill.runtime import load, scratch
from corpusmill.sources import files
from corpusmill.streaming import events

R = lambda: F.col("response")

# --- model output ---
_STEP = r"""{'c': b.c, 'i': b.i, 'e': a.q AND NOT a.e AND b.c = chr(92), 'q': CASE WHEN a.q THEN a.e OR b.c <> '"' ELSE b.c = '"' END,
'd': CASE WHEN a.q THEN a.d WHEN b.c = '{' THEN a.d + 1 WHEN b.c = '}' THEN a.d - 1 ELSE a.d END,
's': CASE WHEN NOT a.q AND b.c = '{' AND a.d = 0 THEN b.i WHEN NOT a.q AND b.c = '}' AND a.d = 1 THEN 0 ELSE a.s END,
'o': CASE WHEN NOT a.q AND b.c = '}' AND a.d = 1 AND a.s > 0 THEN a.o || a.s || ':' || b.i || ' ' ELSE a.o END}"""


@query(rf"""WITH t AS (SELECT resp_id, regexp_replace(response, '(?i)```(?:jsonl?)?', '', 'g') AS t FROM endpoint_baseline WHERE contains(response, '{{')),
st AS (SELECT resp_id, t, list_reduce(list_prepend({{'c': '', 'i': 0::BIGINT, 'e': false, 'q': false, 'd': 0::BIGINT, 's': 0::BIGINT, 'o': ''}}, list_transform(range(1, length(t) + 1), lambda i: {{'c': substr(t, i, 1), 'i': i, 'e': false, 'q': false, 'd': 0::BIGINT, 's': 0::BIGINT, 'o': ''}})), lambda a, b: {_STEP}).o AS spans FROM t),
x AS (SELECT resp_id, t, unnest(string_split(trim(spans), ' ')) AS s FROM st WHERE spans <> ''), y AS (SELECT resp_id, substr(t, split_part(s, ':', 1)::BIGINT, split_part(s, ':', 2)::BIGINT - split_part(s, ':', 1)::BIGINT + 1) AS object FROM x) SELECT resp_id, object FROM y WHERE json_valid(object)""")
def json_salvage(spark, sf_dir):
    """Every top-level object in a model's output, found by a scanner that knows strings and escapes."""
    return files.salvage_rows(load(spark, sf_dir, "endpoint_baseline"), "resp_id", "response")


#: Strings that leak into answers.
LEAKS = ["Assistant:", "Question:", "User:", "Human:", "TODO:", "CRITICAL OUTPUT"]


@query()
def minimal_clean(spark, sf_dir):
    """One-pass cleanup of answers (a backreference keeps it from SQL; tests hold it against brute force)."""
    return load(spark, sf_dir, "endpoint_baseline").select("resp_id", cleaning.minimal_clean(R(), LEAKS).alias("response"))


# --- gates ---
_LAST = "list_filter(messages, lambda m: m.role = 'assistant')[-1].content"


@query(f"SELECT rec_id, coalesce(length(trim({_LAST})) >= 15 AND NOT contains({_LAST}, 'source_md:') AND NOT contains({_LAST}, '```'), false) AS kept FROM v12_ru_dialogues")
def quality_gate(spark, sf_dir):
    """A dialogue is kept if its last answer has 15 characters or more and is no dump of a book or of code."""
    last = F.element_at(F.filter("messages", lambda m: m["role"] == "assistant"), -1)["content"]
    last = F.when(F.size(F.filter("messages", lambda m: m["role"] == "assistant")) > 0, last)
    ok = (F.length(F.trim(last)) >= 15) & ~F.contains(last, F.lit("source_md:")) & ~F.contains(last, F.lit("```"))
    return load(spark, sf_dir, "v12_ru_dialogues").select("rec_id", F.coalesce(ok, F.lit(False)).alias("kept"))


ADVICE = r"^\s*(you should|you need to|you must|try to|here'?s a plan|step one|first,|first step|one:|тебе (нужно|следует|надо|стоит)|вам (нужно|следует|надо|стоит)|попробуй|во-первых|шаг (первый|один))"


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) - length(replace(replace(text, '?', ''), '？', '')) > 1 THEN false WHEN tone = 'plain' THEN NOT contains(text, '?') AND NOT contains(text, '？') WHEN tone = 'warm' THEN NOT regexp_matches(lower(text), '" + ADVICE.replace("'", "''") + "') ELSE true END AS consistent FROM documents")
def tone_consistency(spark, sf_dir):
    """One question at most; none in a plain text; a warm one doesn't open with advice."""
    t = F.col("text")
    asks = F.length(t) - F.length(F.replace(F.replace(t, F.lit("?"), F.lit("")), F.lit("？"), F.lit("")))
    ok = F.when(t.isNull(), F.lit(None)).when(asks > 1, False).when(F.col("tone") == "plain", asks == 0).when(F.col("tone") == "warm", ~F.lower(t).rlike(ADVICE)).otherwise(True)
    return load(spark, sf_dir, "documents").select("doc_id", ok.alias("consistent"))


_SENT = r"len(list_filter(string_split_regex(response, '[.!?…]+'), lambda x: trim(regexp_replace(x, '[\r\n\t]', ' ', 'g')) <> ''))"
_LONG = {c: "list_filter(list_distinct(" + TOK.format(f"coalesce({c}, '')") + "), lambda x: length(x) > 4)" for c in ("response", "message")}


@query(f"SELECT resp_id, CASE WHEN response IS NULL THEN 'no_response' WHEN coalesce(lower(trim(locale)) IN ('ru', 'kk'), false) AND regexp_matches(response, '[A-Za-z]{{4,}}') THEN 'latin_script_leak' WHEN regexp_matches(lower(trim(response)), '^(it sounds|i hear|похоже|слышу)') THEN 'hollow_opener' WHEN length(trim(response)) < 45 THEN 'too_short' WHEN {_SENT} < 2 AND NOT ({_SENT} = 1 AND length(response) >= 80) THEN 'not_substantive' WHEN len(list_intersect({_LONG['response']}, {_LONG['message']})) = 0 THEN 'not_specific' ELSE 'pass' END AS verdict FROM endpoint_baseline")
def probe_verdict(spark, sf_dir):
    """The first check of an ordered list that an answer fails: script, opener, length, sentences, words of the prompt."""
    from corpusmill.functions import text

    r = R()
    long_ = lambda c: F.filter(F.array_distinct(text.tokens(F.coalesce(F.col(c), F.lit("")))), lambda x: F.length(x) > 4)
    n = F.size(F.filter(F.split(r, "[.!?…]+"), lambda x: F.trim(F.regexp_replace(x, r"[\r\n\t]", " ")) != ""))
    verdict = (
        F.when(r.isNull(), "no_response").when(F.lower(F.trim("locale")).isin("ru", "kk") & r.rlike("[A-Za-z]{4,}"), "latin_script_leak")
        .when(F.lower(F.trim(r)).rlike("^(it sounds|i hear|похоже|слышу)"), "hollow_opener").when(F.length(F.trim(r)) < 45, "too_short")
        .when((n < 2) & ~((n == 1) & (F.length(r) >= 80)), "not_substantive").when(F.size(F.array_intersect(long_("response"), long_("message"))) == 0, "not_specific").otherwise("pass")
    )
    return load(spark, sf_dir, "endpoint_baseline").select("resp_id", verdict.alias("verdict"))


_CYR_LAT = "[A-Za-z][А-Яа-яЁёӘәҒғҚқҢңӨөҰұҮүҺһІі]|[А-Яа-яЁёӘәҒғҚқҢңӨөҰұҮүҺһІі][A-Za-z]"
_LATIN_SENTENCE = r"len(list_filter(string_split_regex(coalesce(response, ''), '[.!?…]+'), lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) > length(regexp_replace(x, '[^А-Яа-яЁёӘәҒғҚқҢңӨөҰұҮүҺһІі]', '', 'g'))))"


@query(f"SELECT resp_id, coalesce(regexp_matches(response, '{_CYR_LAT}'), false) AS mixed_word, {_LATIN_SENTENCE} AS latin_sentences, coalesce(regexp_matches(response, '^\\s*[A-Za-z]'), false) AS latin_opening FROM endpoint_baseline")
def script_leak_signs(spark, sf_dir):
    """Words of two scripts, sentences with more Latin than Cyrillic letters, and a Latin first letter."""
    latin = F.filter(F.split(F.coalesce(R(), F.lit("")), "[.!?…]+"), lambda x: F.length(F.regexp_replace(x, "[^A-Za-z]", "")) > F.length(F.regexp_replace(x, "[^А-Яа-яЁёӘәҒғҚқҢңӨөҰұҮүҺһІі]", "")))
    sign = lambda p: F.coalesce(R().rlike(p), F.lit(False))
    return load(spark, sf_dir, "endpoint_baseline").select("resp_id", sign(_CYR_LAT).alias("mixed_word"), F.size(latin).cast("long").alias("latin_sentences"), sign(r"^\s*[A-Za-z]").alias("latin_opening"))


@query(r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '(?m)^[ \t]*(?:[-*•]|[0-9]+[.)])[ \t]')), 0) AS list_items, coalesce(regexp_matches(text, '(?m)^(?:user|assistant|system|human)[ \t]*:', 'i'), false) AS role_label, coalesce(regexp_matches(text, '<\|[a-z_]+\|>|\{\s*\"[a-z_]+\"\s*:'), false) AS markup FROM documents")
def structural_leak_signs(spark, sf_dir):
    """List items, role labels at a line's start, and control tokens or JSON."""
    t = F.col("text")
    found = lambda p: F.coalesce(t.rlike(p), F.lit(False))
    items = F.coalesce(F.regexp_count(t, F.lit(r"(?m)^[ \t]*(?:[-*•]|[0-9]+[.)])[ \t]")), F.lit(0)).cast("long")
    return load(spark, sf_dir, "documents").select("doc_id", items.alias("list_items"), found(r"(?im)^(?:user|assistant|system|human)[ \t]*:").alias("role_label"), found(r'<\|[a-z_]+\|>|\{\s*"[a-z_]+"\s*:').alias("markup"))


# --- balance ---
KEY = "md5(concat_ws(':', {0}, '{1}'))"
SHAPES = [("action_step", 400), ("short_greeting", 150), ("crisis_redirect", 60), ("psychoeducation", 200)]


def _balanced(group: str, values: list[tuple[str, int]], table: str, key: str) -> str:
    listed = ", ".join(f"('{g}', {n})" for g, n in values)
    return (
        f"WITH q AS (SELECT * FROM (VALUES {listed}) t(grp, n)), r AS (SELECT {key}, {group} AS grp, row_number() OVER (PARTITION BY {group} ORDER BY {KEY.format(key, 42)}) AS r, count(*) OVER (PARTITION BY {group}) AS total FROM {table}), "
        f"u AS (SELECT r.*, n // total + CASE WHEN r <= n % total THEN 1 ELSE 0 END AS uses FROM r JOIN q ON q.grp = r.grp) SELECT {key}, grp, c AS copy FROM u, unnest(range(1, uses + 1)) AS t(c)"
    )


@query(_balanced("shape", SHAPES, "v13_shape_synth", "rec_id"))
def shape_balance(spark, sf_dir):
    """Target numbers per shape; short shapes are used over and over."""
    q = spark.createDataFrame(SHAPES, "grp string, n int")
    t = sampling.balance(load(spark, sf_dir, "v13_shape_synth").select("rec_id", "shape"), "rec_id", F.col("shape"), q)
    return t.select("rec_id", "grp", F.col("copy").cast("long").alias("copy"))


LOCALES = [("en", 300), ("ru", 900), ("kk", 500)]


@query(_balanced("lower(trim(lang))", LOCALES, "documents", "doc_id"))
def locale_quota_oversample(spark, sf_dir):
    q = spark.createDataFrame(LOCALES, "grp string, n int")
    t = sampling.balance(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", F.lower(F.trim("lang")), q)
    return t.select("doc_id", "grp", F.col("copy").cast("long").alias("copy"))


# --- order and joins ---
@query("SELECT a.doc_id, b.doc_id AS partner_id, a.pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) a JOIN (SELECT doc_id, row_number() OVER (ORDER BY created_at, doc_id) - 1 AS pos FROM documents) b ON a.pos = b.pos")
def positional_join(spark, sf_dir):
    """Row i by id with row i by time; both sides must have as many rows."""
    d = load(spark, sf_dir, "documents")
    return sampling.zip_rows(d.select("doc_id"), d.select(F.col("doc_id").alias("partner_id"), "created_at"), [F.col("doc_id")], [F.col("created_at"), F.col("partner_id")]).select("doc_id", "partner_id", "pos")


_CASES = "c AS (SELECT id, lag(id) OVER (PARTITION BY cluster, locale ORDER BY id) AS before, len(history) AS turns FROM cross_topic_regression), e AS (SELECT id, CASE WHEN coalesce(turns, 0) > 0 THEN before END AS needs FROM c)"


def _case_needs(spark, sf_dir):
    t = load(spark, sf_dir, "cross_topic_regression").select("id", "cluster", "locale", F.coalesce(F.size("history"), F.lit(0)).alias("turns"))
    before = F.lag("id").over(Window.partitionBy("cluster", "locale").orderBy("id"))
    return t.withColumn("needs", F.when(F.col("turns") > 0, before)).select("id", "needs")


@query(f"WITH RECURSIVE {_CASES}, d(id, root, level) AS (SELECT id, id, 0 FROM e WHERE needs IS NULL UNION ALL SELECT e.id, d.root, d.level + 1 FROM e JOIN d ON e.needs = d.id) SELECT id, root, level::BIGINT AS level FROM d")
def dependency_order(spark, sf_dir):
    """A case with a history needs the case before it: how many come first, and the first of all."""
    return timeline.dependency_order(_case_needs(spark, sf_dir), "id", "needs")


@query(f"WITH {_CASES}, p AS (SELECT id, min_by(response, resp_id) AS response FROM endpoint_baseline WHERE response IS NOT NULL GROUP BY id), s AS (SELECT t.id, generate_subscripts(history, 1) - 1 AS pos, unnest(history) AS m FROM cross_topic_regression t) SELECT s.id, s.pos, s.m.role AS role, CASE WHEN s.pos % 2 = 1 AND p.response IS NOT NULL THEN p.response ELSE s.m.content END AS content FROM s JOIN e ON e.id = s.id LEFT JOIN p ON p.id = coalesce(e.needs, e.id)")
def history_resolved(spark, sf_dir):
    """Answers in a case's history stand for what its predecessor was really answered (its own id, if it has none)."""
    told = load(spark, sf_dir, "endpoint_baseline").where("response is not null").groupBy("id").agg(F.min_by("response", "resp_id").alias("told"))
    t = load(spark, sf_dir, "cross_topic_regression").select("id", F.posexplode("history").alias("pos", "m")).join(_case_needs(spark, sf_dir), "id")
    t = t.withColumn("from", F.coalesce("needs", "id")).join(told.withColumnRenamed("id", "from"), "from", "left")
    content = F.when((F.col("pos") % 2 == 1) & F.col("told").isNotNull(), F.col("told")).otherwise(F.col("m.content"))
    return t.select("id", F.col("pos").cast("long").alias("pos"), F.col("m.role").alias("role"), content.alias("content"))


@query("SELECT c.id, g.config FROM cross_topic_regression c, (SELECT DISTINCT config FROM endpoint_baseline WHERE config IS NOT NULL) g WHERE NOT EXISTS (SELECT 1 FROM endpoint_baseline e WHERE e.id = c.id AND e.config = g.config AND e.response IS NOT NULL)")
def resume_by_id(spark, sf_dir):
    """What is left to run: cases and configurations without an answer yet, by their ids."""
    e = load(spark, sf_dir, "endpoint_baseline")
    configs = e.where("config is not null").agg(F.array_sort(F.collect_set("config")).alias("configs"))  # one entry per configuration
    work = load(spark, sf_dir, "cross_topic_regression").select("id", F.explode(configs.scalar()).alias("config"))
    return work.join(e.where("response is not null").select("id", "config"), ["id", "config"], "left_anti")


SWEEP = [(0.3, 0.8), (0.3, 0.95), (0.7, 0.8), (0.7, 0.95)]


@query("SELECT id, t AS temperature, p AS top_p FROM cross_topic_regression, (VALUES (0.3::DOUBLE), (0.7)) a(t), (VALUES (0.8::DOUBLE), (0.95)) b(p)")
def decoding_sweep(spark, sf_dir):
    """Every case under each setting of a short list."""
    settings = F.array(*[F.struct(F.lit(t).alias("temperature"), F.lit(p).alias("top_p")) for t, p in SWEEP])
    return load(spark, sf_dir, "cross_topic_regression").select("id", F.explode(settings).alias("s")).select("id", "s.temperature", "s.top_p")


@query("SELECT source, row_number() OVER (ORDER BY lower(source), source) AS place FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def collated_order(spark, sf_dir):
    """Sources in dictionary order, letter case aside."""
    t = load(spark, sf_dir, "documents").where("source is not null").select("source").distinct()
    return sampling.positions(t, [F.lower("source"), F.col("source")]).select("source", (F.col("pos") + 1).alias("place"))


@query("SELECT doc_id, i AS part_no, p AS part FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents)) QUALIFY row_number() OVER (ORDER BY doc_id, i) <= 500")
def ingestion_cap(spark, sf_dir):
    """The first 500 paragraphs in order of document and place: the cap is the feature."""
    parts = F.transform(F.split("text", "\n\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    t = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.filter(parts, lambda x: x != "")).alias("part_no", "part"))
    return t.orderBy("doc_id", "part_no").limit(500).withColumn("part_no", F.col("part_no").cast("long"))


# --- splitting ---
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PARTS = rf"""CASE WHEN len(ps) >= 3 THEN list_transform(range(0, 3), lambda k: {_STRIP.format("array_to_string(list_transform(list_filter(range(1, len(ps) + 1), lambda i: (i - 1) % 3 = k), lambda i: ps[i]), chr(10) || chr(10))")})
WHEN length(text) < 3 THEN [text] ELSE list_filter(list_transform(range(0, 3), lambda i: {_STRIP.format("substr(text, i * greatest(1, length(text) // 3) + 1, greatest(1, length(text) // 3))")}), lambda x: x <> '') END"""


@query(rf"WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string({_PARTS}, '¶') AS parts FROM d")
def split_parts(spark, sf_dir):
    """Texts dealt out into three parts."""
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(chunking.split_parts(F.col("text"), 3), "¶").alias("parts"))


@query(rf"WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, {_PARTS} AS a FROM d) SELECT doc_id, i AS turn, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, a[i + 1] AS content FROM p, unnest(range(0, len(a))) AS t(i) WHERE len(a) >= 2")
def dialogue_from_text(spark, sf_dir):
    """A text's parts as turns of user and assistant; texts of one part make no dialogue."""
    t = load(spark, sf_dir, "documents").where("text is not null").withColumn("a", chunking.split_parts(F.col("text"), 3)).where("size(a) >= 2")
    t = t.select("doc_id", F.posexplode("a").alias("turn", "content"))
    return t.select("doc_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"), "content")


# --- reports ---
_GEN = "g AS (SELECT config, avg((coalesce(regexp_matches(lower(response), '^(it sounds|похоже|i hear|здесь есть)'), false))::INT) AS canned, avg((fallback_suspected)::INT) AS fallback FROM endpoint_baseline WHERE config IS NOT NULL GROUP BY config)"


@query(f"WITH {_GEN}, s AS (SELECT lag(config) OVER (ORDER BY config) AS \"from\", config AS \"to\", canned - lag(canned) OVER (ORDER BY config) AS delta, fallback FROM g) SELECT \"from\", \"to\", round(delta, 9) AS delta, row_number() OVER (ORDER BY round(delta, 9) DESC, \"to\") AS place, CASE WHEN coalesce(fallback, 0) >= 0.5 THEN 'fallback' WHEN delta > 0.02 THEN 'step' ELSE 'none' END AS verdict FROM s WHERE \"from\" IS NOT NULL")
def dominant_cause(spark, sf_dir):
    """The steps between neighbouring configurations by how much more canned they make the answers, with a verdict each."""
    canned = F.coalesce(F.lower(R()).rlike("^(it sounds|похоже|i hear|здесь есть)"), F.lit(False))
    g = load(spark, sf_dir, "endpoint_baseline").where("config is not null").groupBy("config").agg(F.avg(canned.cast("double")).alias("canned"), F.avg(F.col("fallback_suspected").cast("double")).alias("fallback"))
    w = Window.orderBy("config")  # one row per configuration
    s = g.select(F.lag("config").over(w).alias("from"), F.col("config").alias("to"), (F.col("canned") - F.lag("canned").over(w)).alias("delta"), "fallback").where("`from` is not null").withColumn("delta", F.round("delta", 9))
    verdict = F.when(F.coalesce("fallback", F.lit(0.0)) >= 0.5, "fallback").when(F.col("delta") > 0.02, "step").otherwise("none")
    return s.select("from", "to", "delta", F.row_number().over(Window.orderBy(F.desc("delta"), "to")).cast("long").alias("place"), verdict.alias("verdict"))


@query("SELECT config, n, score, row_number() OVER (ORDER BY score DESC, config) AS place FROM (SELECT config, count(*) AS n, round(avg(length(response)) / 100 - avg(latency_s) / 10, 9) AS score FROM endpoint_baseline WHERE config IS NOT NULL GROUP BY config)")
def rank_configs(spark, sf_dir):
    g = load(spark, sf_dir, "endpoint_baseline").where("config is not null").groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length(R())) / 100 - F.avg("latency_s") / 10, 9).alias("score"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "config")).cast("long"))  # one row per configuration


@query(f"WITH e AS (SELECT resp_id, id, message FROM endpoint_baseline), q AS (SELECT id, {TOK.format('message')} AS w FROM cross_topic_regression), s AS (SELECT q.id, e.resp_id, e.message, len(list_intersect(list_distinct(q.w), list_distinct({TOK.format('e.message')}))) AS overlap FROM q, e), t AS (SELECT * FROM s WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, resp_id) <= 2) SELECT id, 'Examples:' || chr(10) || string_agg('- ' || left(message, 80), chr(10) ORDER BY overlap DESC, resp_id) AS block FROM t GROUP BY id")
def example_block(spark, sf_dir):
    """The two nearest prompts of each case as a block of text for its system prompt."""
    from corpusmill.plans.search import few_shot_by_overlap

    near = few_shot_by_overlap(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("overlap"), "resp_id"))
    t = near.withColumn("r", first).where("r <= 2").join(load(spark, sf_dir, "endpoint_baseline").select("resp_id", "message"), "resp_id")
    g = t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("- "), F.substring("message", 1, 80)).alias("line")))).alias("a"))  # two per case
    return g.select("id", F.concat(F.lit("Examples:\n"), F.array_join(F.transform("a", lambda x: x["line"]), "\n")).alias("block"))


@query(f"WITH d AS (SELECT resp_id AS id, {TOK.format('response')} AS w FROM endpoint_baseline WHERE response IS NOT NULL), s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5), e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT a.id, b.id AS other, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2), l AS (SELECT id, count(*) AS n FROM p WHERE c / (na + nb - c) >= 0.8 - 1e-9 GROUP BY id) SELECT s.id AS resp_id, coalesce(l.n, 0) AS n_links FROM s LEFT JOIN l ON l.id = s.id")
def near_duplicate_links(spark, sf_dir):
    """How many other answers share four fifths of each answer's five-word shingles."""
    members, links = dedup.near_texts(load(spark, sf_dir, "endpoint_baseline"), "resp_id", "response")
    return dedup.link_counts(members, links).select(F.col("id").alias("resp_id"), "n_links")


@query("SELECT v.vec_id FROM embeddings v WHERE v.label <> 0 AND NOT EXISTS (SELECT 1 FROM embeddings g WHERE g.label = 0 AND list_cosine_similarity(v.embedding::DOUBLE[], g.embedding::DOUBLE[]) > 0.3)")
def far_from_gold(spark, sf_dir):
    """Vectors unlike every gold one (label 0)."""
    v = load(spark, sf_dir, "embeddings")
    return dedup.far_from_gold(v.where("label <> 0"), v.where("label = 0"), "vec_id", "embedding", 0.3).select("vec_id")


@query()
def greedy_dedup_with_gold(spark, sf_dir):
    """What a sequential pass keeps that drops what is like a gold vector or like one kept before."""
    v = load(spark, sf_dir, "embeddings")
    rest = dedup.far_from_gold(v.where("label <> 0"), v.where("label = 0"), "vec_id", "embedding", 0.3)
    return dedup.greedy_keep(rest, dedup.similar_pairs(rest, "vec_id", "embedding", 0.3), "vec_id").withColumnRenamed("id", "vec_id")


# --- dialogues made by models ---
_ROLES = "list_transform(messages, lambda m: m.role)"


@query(f"SELECT rec_id, CASE WHEN messages IS NULL OR len(messages) = 0 THEN 'no_messages' WHEN messages[1].role <> 'user' THEN 'user_first' WHEN len(list_filter(range(2, len(messages) + 1), lambda i: messages[i].role = messages[i - 1].role)) > 0 THEN 'roles_alternate' WHEN len(messages) % 2 = 1 THEN 'answer_missing' WHEN len(list_filter(messages, lambda m: coalesce(trim(m.content), '') = '')) > 0 THEN 'blank_message' WHEN len(list_distinct(list_transform(messages, lambda m: lower(trim(m.content))))) < len(messages) THEN 'repeated_message' WHEN len(list_filter(messages, lambda m: m.role = 'assistant' AND length(m.content) > 600)) > 0 THEN 'too_long' ELSE 'ok' END AS verdict FROM v13_shape_synth")
def validate_synthetic(spark, sf_dir):
    """The first rule that a generated dialogue breaks: order of roles, blanks, repeats, length."""
    m = F.col("messages")
    n = F.size(m)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(m, i)["role"] == F.get(m, i - 1)["role"])
    said = F.transform(m, lambda x: F.lower(F.trim(x["content"])))
    verdict = (
        F.when(m.isNull() | (n == 0), "no_messages").when(m[0]["role"] != "user", "user_first").when((n > 1) & F.exists(pairs, lambda x: F.coalesce(x, F.lit(False))), "roles_alternate")
        .when(n % 2 == 1, "answer_missing").when(F.exists(m, lambda x: F.coalesce(F.trim(x["content"]), F.lit("")) == ""), "blank_message").when(F.size(F.array_distinct(said)) < n, "repeated_message")
        .when(F.exists(m, lambda x: (x["role"] == "assistant") & (F.length(x["content"]) > 600)), "too_long").otherwise("ok")
    )
    return load(spark, sf_dir, "v13_shape_synth").select("rec_id", verdict.alias("verdict"))


@query("SELECT rec_id, 'Language: ' || coalesce(nullif(lower(trim(meta.locale)), ''), 'en') || chr(10) || 'Persona: ' || coalesce(nullif(lower(trim(meta.persona)), ''), 'flexible') || chr(10) || 'Shape: ' || coalesce(shape, 'any') || chr(10) || 'Write ' || coalesce(len(messages), 2) // 2 || ' exchange(s).' AS prompt FROM v13_shape_synth")
def task_prompt(spark, sf_dir):
    """The prompt of a worker's task, filled from the record's fields with their defaults."""
    field = lambda k, default: F.coalesce(F.nullif(F.lower(F.trim(f"meta.{k}")), F.lit("")), F.lit(default))
    n = F.floor(F.when(F.col("messages").isNull(), 2).otherwise(F.size("messages")) / 2).cast("string")
    lines = F.concat_ws("\n", F.concat(F.lit("Language: "), field("locale", "en")), F.concat(F.lit("Persona: "), field("persona", "flexible")), F.concat(F.lit("Shape: "), F.coalesce("shape", F.lit("any"))), F.concat(F.lit("Write "), n, F.lit(" exchange(s).")))
    return load(spark, sf_dir, "v13_shape_synth").select("rec_id", lines.alias("prompt"))


@query("WITH m AS (SELECT author_id, unnest(list_filter(messages, lambda m: m.role = 'user' AND m.content IS NOT NULL)).content AS c FROM v12_ru_dialogues) SELECT author_id, count(*) AS n, round(avg(length(c)), 9) AS mean_length, sum(length(c) - length(replace(c, '?', '')))::BIGINT AS asks, sum(length(c) - length(replace(c, '!', '')))::BIGINT AS shouts, CASE WHEN avg(length(c)) < 80 THEN 'brief' WHEN avg(length(c)) > 300 THEN 'long' ELSE 'medium' END AS style FROM m GROUP BY author_id")
def communication_style(spark, sf_dir):
    """How each author writes: length, questions, exclamations."""
    t = load(spark, sf_dir, "v12_ru_dialogues").select("author_id", F.explode("messages").alias("m")).where("m.role = 'user' and m.content is not null").select("author_id", F.col("m.content").alias("c"))
    count = lambda mark: F.sum(F.length("c") - F.length(F.replace("c", F.lit(mark), F.lit("")))).cast("long")
    mean = F.avg(F.length("c"))
    return t.groupBy("author_id").agg(F.count(F.lit(1)).alias("n"), F.round(mean, 9).alias("mean_length"), count("?").alias("asks"), count("!").alias("shouts"), F.when(mean < 80, "brief").when(mean > 300, "long").otherwise("medium").alias("style"))


@query("WITH c AS (SELECT md5(lower(trim(message)) || '|' || coalesce(lower(trim(locale)), 'en')) AS key, min_by(response, resp_id) AS cached FROM endpoint_baseline WHERE response IS NOT NULL AND message IS NOT NULL GROUP BY 1) SELECT t.id, c.key IS NOT NULL AS hit, coalesce(c.cached, t.message) AS text FROM cross_topic_regression t LEFT JOIN c ON c.key = md5(lower(trim(t.message)) || '|' || coalesce(lower(trim(t.locale)), 'en'))")
def cached_or_given(spark, sf_dir):
    """What a cache keyed by text and language holds for each case, else the case's own text."""
    key = F.md5(F.concat(F.lower(F.trim("message")), F.lit("|"), F.coalesce(F.lower(F.trim("locale")), F.lit("en"))))
    cache = load(spark, sf_dir, "endpoint_baseline").where("response is not null and message is not null").groupBy(key.alias("key")).agg(F.min_by("response", "resp_id").alias("cached"))
    t = load(spark, sf_dir, "cross_topic_regression").select("id", "message", key.alias("k"))
    return t.join(cache, F.col("k") == F.col("key"), "left").select("id", F.col("key").isNotNull().alias("hit"), F.coalesce("cached", "message").alias("text"))


@query("SELECT user_id, event_type, event_type || ' ' || count(*) || ' time(s), ' || strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') || CASE WHEN count(*) >= 3 THEN ', often' ELSE '' END AS claim FROM events GROUP BY user_id, event_type")
def claim_text(spark, sf_dir):
    """A claim of each user's events as a sentence with its evidence."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    n = F.count(F.lit(1))
    t = load(spark, sf_dir, "events").groupBy("user_id", "event_type")
    return t.agg(F.concat(F.col("event_type"), F.lit(" "), n.cast("string"), F.lit(" time(s), "), day(F.min("ts")), F.lit(" to "), day(F.max("ts")), F.when(n >= 3, ", often").otherwise("")).alias("claim"))


# --- written and read back ---
_RESP = "resp_id long, id string, config string, message string, response string"
_RESP_SQL = "SELECT resp_id, id, config, message, response FROM endpoint_baseline"


def _responses(spark, sf_dir):
    return load(spark, sf_dir, "endpoint_baseline").select("resp_id", "id", "config", "message", "response")


@query(_RESP_SQL)
def jsonl_round_trip(spark, sf_dir):
    """JSON lines, written in files of 1,000 rows and read strictly."""
    path = scratch(spark, "jsonl")
    files.write_jsonl(_responses(spark, sf_dir), path, rows_per_file=1000)
    return files.read_jsonl_strict(spark, path, _RESP)


@query("SELECT count(*) FILTER (resp_id % 7 <> 0) AS n_good, count(*) FILTER (resp_id % 7 = 0) AS n_bad FROM endpoint_baseline")
def jsonl_lenient_counts(spark, sf_dir):
    """Lines of which every seventh is broken off, read leniently: good and malformed ones."""
    path = scratch(spark, "jsonl-broken")
    whole = F.to_json(F.struct("resp_id", "id"))
    _responses(spark, sf_dir).select(F.when(F.col("resp_id") % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("value")).write.text(path)
    good, bad = files.read_jsonl_lenient(spark, path, "resp_id long, id string")
    return good.agg(F.count(F.lit(1)).alias("n_good")).withColumn("n_bad", bad.agg(F.count(F.lit(1))).scalar())


@query("SELECT source, domain_name, array_to_string(langs, ',') AS langs FROM sources")
def json_array_round_trip(spark, sf_dir):
    """A file whose root is a list of objects."""
    path = scratch(spark, "json-array")
    rows = load(spark, sf_dir, "sources").agg(F.to_json(F.collect_list(F.struct("source", "domain_name", "langs"))).alias("value"))  # the dimension table as one document
    rows.coalesce(1).write.text(path)
    return files.read_json_array(spark, path, "source string, domain_name string, langs array<string>").select("source", "domain_name", F.array_join("langs", ",").alias("langs"))


@query("SELECT coalesce(config, 'none') AS folder, count(*) AS n FROM endpoint_baseline GROUP BY 1")
def directory_scan(spark, sf_dir):
    """Files in folders of folders, each row with where it comes from."""
    path = scratch(spark, "folders")
    _responses(spark, sf_dir).withColumn("folder", F.coalesce("config", F.lit("none"))).write.partitionBy("folder").json(path)
    t = files.read_directory(spark, path, _RESP, "*.json")
    return t.groupBy(F.regexp_extract("source_file", "folder=([^/]*)/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT resp_id, id FROM endpoint_baseline")
def append_resume(spark, sf_dir):
    """A table filled in two runs of which the second meets rows of the first again: each id once."""
    path = scratch(spark, "append")
    t = _responses(spark, sf_dir).select("resp_id", "id")
    files.append_unseen(t.where("config = 'C4_full'") if "config" in t.columns else t.where("id < 'm'"), path, "resp_id")
    files.append_unseen(t, path, "resp_id")
    return spark.read.parquet(path).select("resp_id", "id")


@query("SELECT row_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS role FROM (SELECT row_id, regexp_extract_all(text, '<\\|im_start\\|>(\\w+)', 1) AS m FROM train)")
def unified_messages(spark, sf_dir):
    """Roles in order, from rows that hold ChatML text only."""
    t = files.unify_messages(load(spark, sf_dir, "train").select("row_id", "text"))
    return t.select("row_id", F.posexplode("messages").alias("pos", "m")).select("row_id", F.col("pos").cast("long").alias("pos"), F.col("m.role").alias("role"))


@query("SELECT 'report' AS name, '# Answers' AS title, count(DISTINCT config) + 1 AS n_rows FROM endpoint_baseline WHERE config IS NOT NULL")
def markdown_report(spark, sf_dir):
    """A report as written: its title and number of table rows, head included."""
    t = load(spark, sf_dir, "endpoint_baseline").where("config is not null").groupBy("config").agg(F.count(F.lit(1)).alias("n"))
    lines = files.report_markdown(t, "Answers").split("\n")
    return spark.createDataFrame([("report", lines[0], sum(x.startswith("| ") for x in lines))], "name string, title string, n_rows long")


# --- streams, worked off to the end of the source ---
def _stream(spark, sf_dir):
    """The event table as a stream; a folder of part files streams file by file."""
    return events.read_events(spark, sf_dir, pattern="events.parquet")


@query("SELECT event_id, event_type FROM (SELECT DISTINCT event_id, event_type FROM events)")
def stream_first_deliveries(spark, sf_dir):
    return events.run_once(events.first_deliveries(_stream(spark, sf_dir)), scratch(spark, "stream")).select("event_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_hourly(spark, sf_dir):
    """Hours that the watermark has closed."""
    t = events.run_once(events.hourly(_stream(spark, sf_dir)), scratch(spark, "stream"))
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH s AS (SELECT user_id, lag(event_type) OVER w AS \"from\", event_type AS \"to\", ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)) SELECT user_id, \"from\", \"to\", ts, false AS late FROM s WHERE \"from\" <> \"to\" AND NOT (\"from\" = 'view' AND \"to\" IN ('click', 'purchase'))")
def stream_transition_alerts(spark, sf_dir):
    """Steps other than from a view to a click or purchase, each user's last event kept as state."""
    t = events.run_once(events.transition_alerts(_stream(spark, sf_dir), {("view", "click"), ("view", "purchase")}), scratch(spark, "stream"))
    return t.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
