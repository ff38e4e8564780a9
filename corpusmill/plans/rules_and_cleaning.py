"""Queries of the cleaning chains and of the rule engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import cleaning, rules, turns
from corpusmill.operators.rules import Rule, RuleSet
from corpusmill.plans.catalog import query
from corpusmill.runtime import load



def R():  # noqa: N802
    """The answer; a function, as columns can't be made before a session is there."""
    return F.col("response")




@query()
def clean_model_text(spark, sf_dir):
    """Backreferences have no SQL counterpart; checked against Python in the tests."""
    return load(spark, sf_dir, "endpoint_baseline").select("resp_id", cleaning.clean_chain(R()).alias("value"))


@query()
def complete_sentence_head(spark, sf_dir):
    return load(spark, sf_dir, "endpoint_baseline").select("resp_id", cleaning.complete_head(R()).alias("value"))


@query()
def strip_latin_leaks(spark, sf_dir):
    return load(spark, sf_dir, "endpoint_baseline").select("resp_id", cleaning.strip_latin_leaks(R()).alias("value"))


@query()
def normalize_nfkc(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", cleaning.nfkc(F.col("text")).alias("value"))


@query("SELECT resp_id, CASE WHEN len(t) = 0 THEN '' WHEN len(list_filter(t, lambda x: x = 'and')) > 0 THEN array_to_string(t[len(t) - list_position(list_reverse(t), 'and') + 2:], ' ') WHEN list_contains(t, 'the') THEN '' ELSE array_to_string(t, ' ') END AS value FROM (SELECT resp_id, string_split(lower(coalesce(response, '')), ' ') AS t FROM endpoint_baseline)")
def split_think_tokens(spark, sf_dir):
    """Any pair of marks; words stand in for special tokens here."""
    t = F.split(F.lower(F.coalesce(R(), F.lit(""))), " ")
    return load(spark, sf_dir, "endpoint_baseline").select("resp_id", F.array_join(cleaning.answer_after_thinking(t, "the", "and"), " ").alias("value"))


@query("SELECT doc_id, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(doc_id::VARCHAR), ''), lambda d: (instr('0123456789abcdef', d) - 1)::BIGINT)), lambda a, d: (a * 16 + d) % 7))::BIGINT AS pick FROM documents")
def stable_pick(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", cleaning.stable_pick(F.col("doc_id").cast("string"), 7).alias("pick"))


@query()
def lcg_split(spark, sf_dir):
    return cleaning.lcg_split(load(spark, sf_dir, "documents"), "doc_id", "tone")


@query("SELECT rec_id, coalesce(nullif(lower(trim(meta.locale)), ''), 'en') || '/' || coalesce(lower(trim(meta.persona)), 'flexible') || '/' || coalesce(lower(trim(meta.state)), 'any') AS settings FROM v13_shape_synth")
def settings_overlay(spark, sf_dir):
    """A map of defaults with each record's own values over it."""
    base = F.create_map(*map(F.lit, ("locale", "en", "persona", "flexible", "state", "any")))
    own = F.map_filter(F.create_map(F.lit("locale"), F.nullif(F.lower(F.trim("meta.locale")), F.lit("")), F.lit("persona"), F.lower(F.trim("meta.persona")), F.lit("state"), F.lower(F.trim("meta.state"))), lambda _, v: v.isNotNull())
    m = cleaning.overlay(base, own)
    return load(spark, sf_dir, "v13_shape_synth").select("rec_id", F.concat_ws("/", m["locale"], m["persona"], m["state"]).alias("settings"))


LIMITS = [("intake", 1, 12, 1), ("disclosure", 2, 12, 2), ("psychoed", 2, 20, 1), ("action", 1, 16, 1), ("closing", 1, 10, 0)]


@query("WITH l AS (SELECT * FROM (VALUES " + ", ".join(map(str, LIMITS)) + ") t(phase, lo, hi, q)), s AS (SELECT doc_id, phase, greatest(len(regexp_extract_all(text, '[^.!?]+[.!?]+')), 1) AS n, length(text) - length(replace(text, '?', '')) AS asks FROM documents) SELECT doc_id, CASE WHEN lo IS NULL THEN 'unknown_phase' WHEN n NOT BETWEEN lo AND hi THEN 'sentences' WHEN asks > q THEN 'questions' ELSE 'ok' END AS verdict FROM s LEFT JOIN l ON s.phase = l.phase")
def phase_limits(spark, sf_dir):
    """Sentence and question bounds per phase from a small dimension."""
    dim = spark.createDataFrame(LIMITS, "phase string, lo int, hi int, q int")
    t = load(spark, sf_dir, "documents").join(dim, "phase", "left")
    n, asks = text.sentences_closed(F.col("text")), text.count_of(F.col("text"), "?")
    return t.select("doc_id", F.when(F.col("lo").isNull(), "unknown_phase").when(~n.between(F.col("lo"), F.col("hi")), "sentences").when(asks > F.col("q"), "questions").otherwise("ok").alias("verdict"))


def _drafts(spark, sf_dir):
    """One draft per user over all of its events: counts, days, span, labels, and whether the last event tops all before."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    last = F.max_by("event_id", F.struct("ts", "event_id"))
    top = F.max_by("event_id", F.struct("value", -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")))  # the first of the largest values
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("ts")).alias("n_days"), (F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / 3600.0).alias("hours"),
        F.collect_set("event_type").alias("labels"), (last == top).alias("tops"),  # the vocabulary of labels bounds the set
    )


@query("""WITH d AS (SELECT user_id, list(date_trunc('second', ts) ORDER BY ts, event_id) AS times, list(event_type ORDER BY ts, event_id) AS labels, list(value ORDER BY date_trunc('second', ts), event_id) AS vals FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN len(list_filter(labels, lambda x: x NOT IN ('view', 'click', 'purchase', 'error', 'signup'))) > 0 THEN 'KNOWN_LABELS' WHEN len(times) < 3 THEN 'ENOUGH_CITES' WHEN len(list_distinct(list_transform(times, lambda t: t::DATE))) < 2 THEN 'DISTINCT_DAYS'
WHEN date_diff('second', list_min(times), list_max(times)) / 3600.0 < 24 THEN 'SPAN' WHEN list_contains(labels, 'error') AND list_contains(labels, 'purchase') AND NOT list_contains(labels, 'signup') THEN 'COOCCUR' WHEN vals[-1] > list_max(vals[1:len(vals) - 1]) THEN 'MAX_INTENSITY' END AS rule FROM d""")
def rule_first_violation(spark, sf_dir):
    """Rules in order of precedence over drafts built from all events."""
    found = RuleSet(
        Rule("KNOWN_LABELS", "block", True, "label outside the vocabulary", ~rules.all_known(F.col("labels"), ["view", "click", "purchase", "error", "signup"])),
        Rule("ENOUGH_CITES", "block", True, "under three citations", F.col("n") < 3),
        Rule("DISTINCT_DAYS", "block", True, "one day only", F.col("n_days") < 2),
        Rule("SPAN", "block", True, "under a day of evidence", F.col("hours") < 24),
        Rule("COOCCUR", "block", False, "labels that exclude each other", F.array_contains("labels", "error") & F.array_contains("labels", "purchase") & ~F.array_contains("labels", "signup")),
        Rule("MAX_INTENSITY", "warn", True, "above anything cited", F.col("tops")),
    )
    return found.apply(_drafts(spark, sf_dir)).select("user_id", F.col("violation.rule").alias("rule"))


@query("SELECT resp_id, (n = 0 OR (n = 1 AND ends_with(rtrim(response), '?'))) AS one_closing_question FROM (SELECT resp_id, response, coalesce(length(response) - length(replace(response, '?', '')), 0) AS n FROM endpoint_baseline)")
def one_closing_question(spark, sf_dir):
    return load(spark, sf_dir, "endpoint_baseline").select("resp_id", rules.last_sentence_asks(R()).alias("one_closing_question"))


@query("SELECT split_part(k, ':', 1) AS pattern, count(*) AS n FROM (SELECT unnest(list_filter(['ask:' || CASE WHEN contains(response, '?') THEN 'y' END, 'shout:' || CASE WHEN contains(response, '!') THEN 'y' END, 'list:' || CASE WHEN regexp_matches(response, '(?m)^- ') THEN 'y' END], lambda x: x IS NOT NULL)) AS k FROM endpoint_baseline WHERE response IS NOT NULL) GROUP BY 1")
def pattern_histogram(spark, sf_dir):
    flag = lambda name, cond: F.when(cond, F.lit(f"{name}:y"))
    hits = F.array_compact(F.array(flag("ask", F.contains(R(), F.lit("?"))), flag("shout", F.contains(R(), F.lit("!"))), flag("list", R().rlike("(?m)^- "))))
    t = load(spark, sf_dir, "endpoint_baseline").where("response is not null").select(F.explode(hits).alias("k"))
    return t.groupBy(F.split("k", ":")[0].alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT row_id, len(regexp_extract_all(text, '<\|(?:redacted_)?im_end\|>')) AS n_ends, contains(text, chr(13)) AS crlf FROM train")
def chatml_structure(spark, sf_dir):
    return load(spark, sf_dir, "train").select("row_id", turns.n_turns(F.col("text")).alias("n_ends"), F.contains("text", F.lit("\r")).alias("crlf"))
