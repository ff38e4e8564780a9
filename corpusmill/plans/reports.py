"""Evaluation reports: pass rates, failures, comparisons, gates, diversity, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.functions.text import CYRILLIC
from corpusmill.operators import evaluation, retrieval
from corpusmill.operators.checks import CheckSet
from corpusmill.plans.catalog import query
from corpusmill.runtime import load

BANNED = ["обратись к специалисту", "понимаю твои чувства", "маманға жүгініңіз", "please contact a professional"]
REASONS = ["EMPTY", "TOO_SHORT", "BANNED_PHRASE", "MANY_QUESTIONS", "TOO_LONG", "MARKUP"]


def R():  # noqa: N802
    """The answer; a function, as columns can't be made before a session is there."""
    return F.col("response")



CHECKED = (
    "checked AS (SELECT *, CASE WHEN response IS NULL OR trim(response) = '' THEN 'EMPTY' WHEN length(response) < 40 THEN 'TOO_SHORT' WHEN "
    + " OR ".join(f"contains(lower(response), '{p}')" for p in BANNED)
    + " THEN 'BANNED_PHRASE' WHEN length(response) - length(replace(response, '?', '')) > 2 THEN 'MANY_QUESTIONS' WHEN length(response) > 330 THEN 'TOO_LONG' WHEN regexp_matches(response, '[<>{}]') THEN 'MARKUP' END AS failed, failed IS NULL AS passed FROM endpoint_baseline)"
)
TOK = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')"


def checks() -> CheckSet:
    """The report's row checks in order."""
    return CheckSet(
        ("EMPTY", R().isNull() | (F.trim(R()) == "")), ("TOO_SHORT", F.length(R()) < 40), ("BANNED_PHRASE", text.contains_any(R(), BANNED)),
        ("MANY_QUESTIONS", text.count_of(R(), "?") > 2), ("TOO_LONG", F.length(R()) > 330), ("MARKUP", R().rlike("[<>{}]")),
    )


def _checked(spark, sf_dir):
    return checks().apply(load(spark, sf_dir, "endpoint_baseline"))


@query(f"WITH {CHECKED} SELECT cluster, locale, (CASE WHEN grouping(cluster) = 1 THEN 2 ELSE 0 END + CASE WHEN grouping(locale) = 1 THEN 1 ELSE 0 END)::BIGINT AS gid, count(*) AS total, count(*) FILTER (passed) AS n_passed, count(*) - count(*) FILTER (passed) AS failed_n, count(*) FILTER (passed) / count(*) AS pass_rate FROM checked GROUP BY GROUPING SETS ((), (cluster), (locale), (cluster, locale))")
def eval_pass_by_group(spark, sf_dir):
    """Flagship: ordered row checks, then pass rates overall, by cluster, by locale and by both in one pass."""
    return evaluation.pass_rates(_checked(spark, sf_dir), [[], ["cluster"], ["locale"], ["cluster", "locale"]])


@query(f"WITH {CHECKED} SELECT resp_id, failed FROM checked WHERE failed IS NOT NULL")
def validate_first_failure(spark, sf_dir):
    return _checked(spark, sf_dir).where("failed is not null").select("resp_id", "failed")


@query("SELECT resp_id, array_to_string(list_filter([CASE WHEN response IS NULL OR trim(response) = '' THEN 'EMPTY' END, CASE WHEN length(response) < 40 THEN 'TOO_SHORT' END, CASE WHEN " + " OR ".join(f"contains(lower(response), '{p}')" for p in BANNED) + " THEN 'BANNED_PHRASE' END, CASE WHEN length(response) - length(replace(response, '?', '')) > 2 THEN 'MANY_QUESTIONS' END, CASE WHEN length(response) > 330 THEN 'TOO_LONG' END, CASE WHEN regexp_matches(response, '[<>{}]') THEN 'MARKUP' END], lambda x: x IS NOT NULL), ',') AS failures FROM endpoint_baseline")
def validate_all_failures(spark, sf_dir):
    return load(spark, sf_dir, "endpoint_baseline").select("resp_id", F.array_join(checks().failures(), ",").alias("failures"))


@query(f"WITH {CHECKED}, d AS (SELECT unnest({REASONS}) AS reason) SELECT reason, count(failed) AS n FROM d LEFT JOIN checked ON failed = reason GROUP BY reason")
def failure_breakdown(spark, sf_dir):
    t = _checked(spark, sf_dir).withColumn("reasons", F.array_compact(F.array("failed")))
    return evaluation.explode_reasons(t, "reasons", REASONS)


@query(f"WITH {CHECKED} SELECT cluster, count(*) AS total, count(*) FILTER (passed) AS n_passed, count(*) FILTER (passed) / count(*) AS rate, count(*) FILTER (passed AND locale = 'en') AS en_pass, count(*) FILTER (passed AND locale = 'ru') AS ru_pass FROM checked GROUP BY cluster")
def pass_rate_by_cluster(spark, sf_dir):
    t = _checked(spark, sf_dir)
    return t.groupBy("cluster").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("n_passed"), F.avg(F.col("passed").cast("double")).alias("rate"), F.count_if(F.col("passed") & (F.col("locale") == "en")).alias("en_pass"), F.count_if(F.col("passed") & (F.col("locale") == "ru")).alias("ru_pass"))


@query(f"WITH {CHECKED}, b AS (SELECT id, bool_and(passed) AS p FROM checked WHERE config = 'C2_prompt' GROUP BY id), a AS (SELECT id, bool_and(passed) AS p FROM checked WHERE config = 'C4_full' GROUP BY id) SELECT coalesce(b.id, a.id) AS id, coalesce(b.p, false) AS was, coalesce(a.p, false) AS now, CASE WHEN coalesce(b.p, false) = coalesce(a.p, false) THEN 'same' WHEN coalesce(a.p, false) THEN 'fixed' ELSE 'broken' END AS change FROM b FULL JOIN a ON b.id = a.id")
def before_after_compare(spark, sf_dir):
    t = _checked(spark, sf_dir)
    one = lambda c: t.where(F.col("config") == c).groupBy("id").agg(F.bool_and("passed").alias("passed"))
    return evaluation.full_compare(one("C2_prompt"), one("C4_full"), ["id"])


@query(f"WITH {CHECKED}, b AS (SELECT cluster, avg(passed::INT) AS r FROM checked WHERE config = 'C2_prompt' AND cluster IS NOT NULL GROUP BY 1), a AS (SELECT cluster, avg(passed::INT) AS r FROM checked WHERE config = 'C4_full' AND cluster IS NOT NULL GROUP BY 1) SELECT coalesce(b.cluster, a.cluster) AS cluster, coalesce(b.r, 0) AS rate_before, coalesce(a.r, 0) AS rate_after, CASE WHEN coalesce(a.r, 0) - coalesce(b.r, 0) > 0.001 THEN 'improved' WHEN coalesce(a.r, 0) - coalesce(b.r, 0) < -0.001 THEN 'worse' ELSE 'flat' END AS direction FROM b FULL JOIN a ON a.cluster = b.cluster")
def group_compare(spark, sf_dir):
    t = _checked(spark, sf_dir).where("cluster is not null")
    one = lambda c, n: t.where(F.col("config") == c).groupBy("cluster").agg(F.avg(F.col("passed").cast("double")).alias(n))
    j = one("C2_prompt", "rate_before").join(one("C4_full", "rate_after"), "cluster", "full").fillna(0.0, ["rate_before", "rate_after"])
    return j.withColumn("direction", evaluation.direction(F.col("rate_after") - F.col("rate_before")))


@query(f"WITH {CHECKED}, g AS (SELECT config, cluster, avg(passed::INT) AS r, count(*) AS n FROM checked GROUP BY 1, 2), o AS (SELECT config, avg(passed::INT) AS overall FROM checked GROUP BY 1) SELECT g.config, o.overall, min(g.r) AS worst_cluster, o.overall >= 0.8 AND min(g.r) >= 0.6 AS gate FROM g JOIN o ON g.config = o.config GROUP BY g.config, o.overall")
def release_gate(spark, sf_dir):
    g = _checked(spark, sf_dir).where("config is not null").groupBy("config", "cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("p"))
    o = g.groupBy("config").agg((F.sum("p") / F.sum("n")).alias("overall"), F.min(F.col("p") / F.col("n")).alias("worst_cluster"))
    return o.withColumn("gate", (F.col("overall") >= 0.8) & (F.col("worst_cluster") >= 0.6))


@query("SELECT coalesce(lower(trim(locale)), 'unknown') AS locale, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS fraction FROM endpoint_baseline GROUP BY 1")
def locale_mix(spark, sf_dir):
    g = load(spark, sf_dir, "endpoint_baseline").groupBy(F.coalesce(F.lower(F.trim("locale")), F.lit("unknown")).alias("locale")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("SELECT cluster, resp_id, left(response, 80) AS preview FROM endpoint_baseline WHERE response IS NOT NULL AND cluster IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY resp_id) <= 5")
def first_n_samples(spark, sf_dir):
    """Five samples per cluster: bounded heaps per key, combined before the shuffle."""
    t = load(spark, sf_dir, "endpoint_baseline").where("response is not null and cluster is not null")
    w = Window.partitionBy("cluster").orderBy("resp_id")
    return t.withColumn("n", F.row_number().over(w)).where("n <= 5").select("cluster", "resp_id", F.left("response", F.lit(80)).alias("preview"))


@query(f"SELECT config, count(DISTINCT g) AS n_distinct, count(*) AS n_all, count(DISTINCT g) / count(*) AS distinct_2 FROM (SELECT config, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i+1])) AS g FROM (SELECT config, {TOK.format('response')} AS w FROM endpoint_baseline WHERE response IS NOT NULL AND config IS NOT NULL)) GROUP BY config")
def distinct_2_by_config(spark, sf_dir):
    return evaluation.distinct_n(load(spark, sf_dir, "endpoint_baseline").where("response is not null and config is not null"), ["config"], R())


@query("SELECT config, count(*) AS n, avg((coalesce(regexp_matches(lower(response), '^(it sounds|похоже|i hear|здесь есть)'), false))::INT) AS canned_rate, avg(length(response)) AS mean_len, avg((fallback_suspected)::INT) AS fallback_rate, max(latency_s) AS max_latency, avg(latency_s) AS mean_latency FROM endpoint_baseline WHERE config IS NOT NULL GROUP BY config")
def summarize_config(spark, sf_dir):
    canned = F.coalesce(F.lower(R()).rlike("^(it sounds|похоже|i hear|здесь есть)"), F.lit(False))
    return load(spark, sf_dir, "endpoint_baseline").where("config is not null").groupBy("config").agg(
        F.count(F.lit(1)).alias("n"), F.avg(canned.cast("double")).alias("canned_rate"), F.avg(F.length(R())).alias("mean_len"), F.avg(F.col("fallback_suspected").cast("double")).alias("fallback_rate"), F.max("latency_s").alias("max_latency"), F.avg("latency_s").alias("mean_latency")
    )


@query("WITH m AS (SELECT config, avg(latency_s) AS latency FROM endpoint_baseline WHERE config IS NOT NULL GROUP BY config) SELECT config, latency, lag(latency) OVER (ORDER BY config) AS previous, latency - lag(latency) OVER (ORDER BY config) AS delta FROM m")
def adjacent_config_delta(spark, sf_dir):
    m = load(spark, sf_dir, "endpoint_baseline").where("config is not null").groupBy("config").agg(F.avg("latency_s").alias("latency"))
    return evaluation.adjacent_delta(m, "config", "latency")


@query("SELECT config, count(latency_s) AS n, min(latency_s) AS least, quantile_cont(latency_s, 0.5) AS p50, quantile_cont(latency_s, 0.9) AS p90, max(latency_s) AS most FROM endpoint_baseline WHERE config IS NOT NULL GROUP BY config")
def latency_stats(spark, sf_dir):
    """Exact percentiles; ``percentiles`` takes an accuracy where groups are too large for them."""
    return evaluation.percentiles(load(spark, sf_dir, "endpoint_baseline").where("config is not null"), "config", "latency_s", [0.5, 0.9])


@query("SELECT config, count(latency_s) AS n, true AS near FROM endpoint_baseline WHERE config IS NOT NULL GROUP BY config")
def latency_sketch(spark, sf_dir):
    """Percentiles of bounded state: whether each lies between the exact ones a tenth to either side (in small groups a sketch takes a whole value, no mean of two)."""
    t = load(spark, sf_dir, "endpoint_baseline").where("config is not null")
    exact = evaluation.percentiles(t, "config", "latency_s", [0.4, 0.6, 0.8, 1.0]).drop("least", "most", "n")
    got = evaluation.percentiles(t, "config", "latency_s", [0.5, 0.9], 1000).join(exact, "config")
    return got.select("config", "n", (F.col("p50").between(F.col("p40"), F.col("p60")) & F.col("p90").between(F.col("p80"), F.col("p100"))).alias("near"))


@query("SELECT CASE WHEN n BETWEEN 2 AND 4 THEN n::VARCHAR ELSE 'other' END AS bucket, count(*) AS n_rows FROM (SELECT greatest(len(regexp_extract_all(response, '[^.!?]+[.!?]+')), 1) AS n FROM endpoint_baseline WHERE response IS NOT NULL) GROUP BY 1")
def sentence_distribution(spark, sf_dir):
    n = text.sentences_closed(R())
    t = load(spark, sf_dir, "endpoint_baseline").where("response is not null")
    return t.groupBy(F.when(n.between(2, 4), n.cast("string")).otherwise("other").alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT id, avg(-latency_s / 20) FILTER (isfinite(latency_s)) AS mean_logprob, CASE WHEN avg(latency_s / 20) >= 1.2 THEN 0.0 ELSE 1 - avg(latency_s / 20) / 1.2 END AS confidence FROM endpoint_baseline WHERE latency_s IS NOT NULL GROUP BY id")
def entropy_confidence(spark, sf_dir):
    lp = -F.col("latency_s") / 20
    m = F.avg(F.col("latency_s") / 20)
    t = load(spark, sf_dir, "endpoint_baseline").where("latency_s is not null")
    return t.groupBy("id").agg(F.avg(F.when(~F.isnan(lp) & (F.abs(lp) < float("inf")), lp)).alias("mean_logprob"), F.when(m >= 1.2, 0.0).otherwise(1 - m / 1.2).alias("confidence"))


@query("SELECT tone, array_to_string(list_sort(list_distinct(list(emotion) FILTER (emotion IS NOT NULL))), ',') AS emotions, array_to_string(list_sort(list_distinct(list(phase) FILTER (phase IS NOT NULL))), ',') AS phases FROM documents WHERE tone IS NOT NULL GROUP BY tone")
def rubric_merge(spark, sf_dir):
    """Set union per state; sets of a small vocabulary, never of rows."""
    return load(spark, sf_dir, "documents").where("tone is not null").groupBy("tone").agg(F.array_join(F.array_sort(F.collect_set("emotion")), ",").alias("emotions"), F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("phases"))


@query("WITH f AS (SELECT label, min_by(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY label) SELECT count(*) AS n_pairs, round(avg(list_cosine_similarity(a.v, b.v)), 9) AS genericness FROM f a JOIN f b ON a.label < b.label")
def cross_group_genericness(spark, sf_dir):
    """Mean cosine between the first vectors of the groups; one vector per label, so few pairs."""
    f = load(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    a, b = f.select(F.col("label").alias("la"), F.col("v").alias("va")), f.select(F.col("label").alias("lb"), F.col("v").alias("vb"))
    return a.join(b, F.col("la") < F.col("lb")).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(retrieval.cosine(F.col("va"), F.col("vb"))), 9).alias("genericness"))


@query("SELECT label, round(avg(list_cosine_similarity(e.embedding::DOUBLE[], c.v)), 9) AS mean_cosine FROM embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1) c GROUP BY label")
def similarity_to_reference(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    ref = e.where("vec_id = 1").select("embedding").scalar()  # the fixed reference vector
    return e.select("label", "embedding", ref.alias("v")).groupBy("label").agg(F.round(F.avg(retrieval.cosine(F.col("embedding"), F.col("v"))), 9).alias("mean_cosine"))


# --- joins and set operations ---
@query("SELECT d.doc_id, coalesce(s.domain_name, 'none') AS domain_name, coalesce(list_contains(s.langs, lower(trim(d.lang))), false) AS lang_expected FROM documents d LEFT JOIN sources s ON d.source = s.source")
def lookup_domain(spark, sf_dir):
    d, s = load(spark, sf_dir, "documents"), load(spark, sf_dir, "sources")
    return d.join(s, "source", "left").select("doc_id", F.coalesce("domain_name", F.lit("none")).alias("domain_name"), F.coalesce(F.array_contains("langs", F.lower(F.trim("lang"))), F.lit(False)).alias("lang_expected"))


@query("SELECT doc_id FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM mix_targets)")
def anti_join_sources(spark, sf_dir):
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "mix_targets"), "source", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IN (SELECT source FROM mix_targets)")
def semi_join_sources(spark, sf_dir):
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "mix_targets"), "source", "left_semi").select("doc_id")


@query("SELECT source FROM documents WHERE source IS NOT NULL INTERSECT SELECT source FROM mix_targets")
def set_intersect(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("source").where("source is not null").intersect(load(spark, sf_dir, "mix_targets").select("source"))


@query("SELECT source FROM sources EXCEPT SELECT source FROM mix_targets")
def set_except(spark, sf_dir):
    return load(spark, sf_dir, "sources").select("source").subtract(load(spark, sf_dir, "mix_targets").select("source"))


@query("SELECT source, lang, count(*) AS n FROM (SELECT source, lang FROM train UNION ALL SELECT source, lang FROM val) GROUP BY source, lang")
def union_all_sources(spark, sf_dir):
    return load(spark, sf_dir, "train").select("source", "lang").unionByName(load(spark, sf_dir, "val").select("source", "lang")).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split, origin, lang, count(*) AS n FROM (SELECT 'train' AS split, CASE WHEN source LIKE 'v1%' THEN 'dialogue' WHEN source IS NULL THEN 'unknown' ELSE 'other' END AS origin, coalesce(lower(lang), 'und') AS lang FROM train UNION ALL SELECT split_name, CASE WHEN source LIKE 'v1%' THEN 'dialogue' WHEN source IS NULL THEN 'unknown' ELSE 'other' END, coalesce(lower(lang), 'und') FROM val) GROUP BY ALL")
def split_buckets(spark, sf_dir):
    origin = F.when(F.col("source").like("v1%"), "dialogue").when(F.col("source").isNull(), "unknown").otherwise("other")
    t = load(spark, sf_dir, "train").select(F.lit("train").alias("split"), origin.alias("origin"), F.coalesce(F.lower("lang"), F.lit("und")).alias("lang"))
    v = load(spark, sf_dir, "val").select(F.col("split_name").alias("split"), origin.alias("origin"), F.coalesce(F.lower("lang"), F.lit("und")).alias("lang"))
    return t.unionByName(v).groupBy("split", "origin", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT metric, config, value FROM (SELECT config, avg(latency_s) AS latency, avg(length(response)) AS length, avg(voice_retry_count) AS retries FROM endpoint_baseline WHERE config IS NOT NULL GROUP BY config) UNPIVOT (value FOR metric IN (latency, length, retries))")
def metric_rows(spark, sf_dir):
    g = load(spark, sf_dir, "endpoint_baseline").where("config is not null").groupBy("config").agg(F.avg("latency_s").alias("latency"), F.avg(F.length(R())).alias("length"), F.avg("voice_retry_count").alias("retries"))
    return g.unpivot("config", ["latency", "length", "retries"], "metric", "value").select("metric", "config", "value")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def report_lineitem_summary(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def report_orders_by_nation(spark, sf_dir):
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
