"""One query per scalar function and row predicate: (id, value) over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import lang, text
from corpusmill.functions.text import CJK, CYRILLIC, KAZAKH_ONLY
from corpusmill.plans.catalog import QUERIES, SQL
from corpusmill.runtime import load

WS = r"[ \t\r\n\f]+"
_SQUASH = f"trim(regexp_replace({{0}}, '{WS}', ' ', 'g'))"
_IDS = {"documents": "doc_id", "endpoint_baseline": "resp_id", "v12_ru_dialogues": "rec_id", "v13_shape_synth": "rec_id", "train": "row_id", "val": "row_id", "events": "event_id", "cross_topic_regression": "id"}


def scalar(name: str, table: str, value: Callable[[], Column], sql: str, where: str | None = None) -> None:
    """Register ``name``: the value of every row of ``table`` (null where the text is null)."""
    key = _IDS[table]

    def run(spark, sf_dir):
        t = load(spark, sf_dir, table)
        return (t.where(where) if where else t).select(key, value().alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, {sql} AS value FROM {table}" + (f" WHERE {where}" if where else "")




def D() -> Column:  # noqa: N802
    return F.col("text")


def R() -> Column:  # noqa: N802
    return F.col("response")


def M() -> Column:  # noqa: N802
    return F.col("message")


squash = _SQUASH.format
STOPS = ["<|im_end|>", "\n\n", "—"]
# Phrases that the checks look for (examples; every check takes its list as a parameter).
BANNED = ["as an ai", "i understand how you feel", "everything happens for a reason", "обратись к специалисту", "понимаю твои чувства", "маманға жүгініңіз"]
OPENERS = ["it sounds", "i hear", "похоже", "слышу", "мұнда"]
KEYWORDS = ["sleep", "fear", "страх", "стыд", "сон", "ұят"]

scalar("norm_squash", "documents", lambda: text.squash(D()), squash("text"))
scalar("norm_assistant_key", "endpoint_baseline", lambda: text.norm_key(R()), f"lower({squash('response')})")
scalar("norm_plain_words", "endpoint_baseline", lambda: text.plain_words(R()), squash(f"regexp_replace(lower(response), '[^a-z0-9_{CYRILLIC} \\t\\r\\n]', '', 'g')"))
scalar("truncate_ellipsis", "documents", lambda: text.ellipsis(D(), 160), "CASE WHEN length(text) <= 160 THEN text ELSE rtrim(substr(text, 1, 159)) || '…' END")
scalar("middle_collapse", "documents", lambda: text.middle_collapse(D(), 200), "CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 100) || chr(10) || '…' || chr(10) || right(text, 100) END")
scalar("strip_cjk", "documents", lambda: text.strip_cjk(D()), squash(f"regexp_replace(text, '[{CJK}]', '', 'g')"))
scalar(
    "apply_stop_strings", "val", lambda: text.until_stop(D(), STOPS),
    "CASE WHEN least(" + ", ".join(f"CASE WHEN instr(text, {s}) > 0 THEN instr(text, {s}) ELSE 1073741824 END" for s in ("'<|im_end|>'", "chr(10) || chr(10)", "'—'")) + ") < 1073741824 THEN substr(text, 1, least("
    + ", ".join(f"CASE WHEN instr(text, {s}) > 0 THEN instr(text, {s}) ELSE 1073741824 END" for s in ("'<|im_end|>'", "chr(10) || chr(10)", "'—'")) + ") - 1) ELSE text END",
)
scalar("strip_markdown", "documents", lambda: text.strip_markdown(D()), r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
scalar("sanitize_page_lines", "documents", lambda: F.regexp_replace(D(), r"(?im)^[ \t]*page[ ]+[0-9]+[ \t]*$", ""), r"regexp_replace(text, '(?im)^[ \t]*page[ ]+[0-9]+[ \t]*$', '', 'g')")
scalar("title_from_heading", "documents", lambda: F.coalesce(F.nullif(F.regexp_extract(D(), r"(?m)^#{1,3}[ ]+([^\n]+)$", 1), F.lit("")), F.col("source"), F.lit("untitled")), r"coalesce(nullif(regexp_extract(text, '(?m)^#{1,3}[ ]+([^\n]+)$', 1), ''), source, 'untitled')")
scalar("row_sha256_16", "train", lambda: F.left(F.sha2(D(), 256), F.lit(16)), "left(sha256(text), 16)")
scalar("row_md5", "documents", lambda: F.md5(D()), "md5(text)")
scalar("prefix_key_80", "documents", lambda: text.prefix_key(D(), 80), "substr(lower(text), 1, 80)")
scalar("phase_state_map", "documents", lambda: F.create_map(*map(F.lit, ["intake", "listening", "disclosure", "reflecting", "psychoed", "teaching", "action", "planning", "closing", "ending"]))[F.col("phase")], "CASE phase WHEN 'intake' THEN 'listening' WHEN 'disclosure' THEN 'reflecting' WHEN 'psychoed' THEN 'teaching' WHEN 'action' THEN 'planning' WHEN 'closing' THEN 'ending' END")
scalar("persona_canonical", "v13_shape_synth", lambda: F.array_join(F.slice(F.filter(F.transform(F.split(F.coalesce(F.lower(F.col("meta.persona")), F.lit("")), "[,+]"), lambda x: F.trim(x)), lambda x: x != ""), 1, 2), "+"), "array_to_string(list_slice(list_filter(list_transform(string_split_regex(coalesce(lower(meta.persona), ''), '[,+]'), lambda x: trim(x)), lambda x: x <> ''), 1, 2), '+')")
scalar("json_profile_risk", "v12_ru_dialogues", lambda: F.get_json_object(F.col("meta.psych_profile"), "$.riskLevel"), "meta.psych_profile::JSON ->> 'riskLevel'")
scalar("json_profile_scale", "v12_ru_dialogues", lambda: F.get_json_object(F.col("meta.psych_profile"), "$.SSI").cast("double"), "(meta.psych_profile::JSON ->> 'SSI')::DOUBLE")
scalar("events_prop", "events", lambda: F.get_json_object(F.col("props"), "$.k"), "props::JSON ->> 'k'")

scalar("question_count", "endpoint_baseline", lambda: text.count_of(R(), "?"), "coalesce(length(response) - length(replace(response, '?', '')), 0)")
scalar("sentence_final_exclamation", "endpoint_baseline", lambda: F.coalesce(R().rlike("!([ \\t\\r\\n\"'»)]|$)"), F.lit(False)), "coalesce(regexp_matches(response, '!([ \\t\\r\\n\"''»)]|$)'), false)")
scalar("sentences_by_marks", "documents", lambda: text.sentences_by_marks(D()), r"len(list_filter(string_split_regex(text, '[.!?…]+'), lambda x: trim(regexp_replace(x, '[\r\n\t]', ' ', 'g')) <> ''))")
scalar("sentences_by_gap", "documents", lambda: text.sentences_by_gap(D()), r"CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_extract_all(regexp_replace(text, '[ \t\r\n]+$', ''), '[.!?][ \t\r\n]+')) + 1 END")
scalar("sentences_closed", "documents", lambda: text.sentences_closed(D()), "greatest(len(regexp_extract_all(text, '[^.!?]+[.!?]+')), 1)")
scalar("sentences_spaced", "documents", lambda: text.sentences_spaced(D()), r"len(list_filter(string_split_regex(text, '[.!?。।]+[ \t\r\n]+'), lambda x: trim(x) <> ''))")
scalar("token_estimate", "documents", lambda: text.token_estimate(D()), f"floor(len(list_filter(string_split({squash('text')}, ' '), lambda x: x <> '')) * 1.3 + 0.5)::BIGINT")
scalar("token_window_check", "endpoint_baseline", lambda: text.token_estimate(R()).between(20, 60), f"(floor(len(list_filter(string_split({squash('response')}, ' '), lambda x: x <> '')) * 1.3 + 0.5) BETWEEN 20 AND 60)")
scalar("guarded_phrase", "endpoint_baseline", lambda: text.guarded(R(), "fear"), "coalesce(regexp_matches(lower(response), '(^|[^a-z0-9_])fear([^a-z0-9_]|$)'), false)")
scalar("banned_phrase", "endpoint_baseline", lambda: text.contains_any(R(), BANNED), " OR ".join(f"coalesce(contains(lower(response), '{p}'), false)" for p in BANNED))
scalar("first_banned_phrase", "endpoint_baseline", lambda: text.first_hit(R(), BANNED), "coalesce(" + ", ".join(f"CASE WHEN contains(lower(response), '{p}') THEN '{p}' END" for p in BANNED) + ")")
scalar("opener_kind", "endpoint_baseline", lambda: F.coalesce(*[F.when(F.startswith(F.lower(F.trim(R())), F.lit(p)), F.lit(p)) for p in OPENERS], F.lit("other")), "coalesce(" + ", ".join(f"CASE WHEN starts_with(lower(trim(response)), '{p}') THEN '{p}' END" for p in OPENERS) + ", 'other')")
scalar("hollow_closing", "endpoint_baseline", lambda: F.coalesce(F.endswith(F.rtrim(F.lower(R())), F.lit("i am here")) | F.endswith(F.rtrim(F.lower(R())), F.lit("я рядом")), F.lit(False)), "coalesce(ends_with(rtrim(lower(response)), 'i am here') OR ends_with(rtrim(lower(response)), 'я рядом'), false)")
scalar("hollow_one_liner", "endpoint_baseline", lambda: F.coalesce((text.sentences_spaced(R()) < 2) & (F.length(R()) < 60), F.lit(True)), r"coalesce(len(list_filter(string_split_regex(response, '[.!?。।]+[ \t\r\n]+'), lambda x: trim(x) <> '')) < 2 AND length(response) < 60, true)")
scalar("keyword_match", "endpoint_baseline", lambda: text.contains_any(R(), KEYWORDS), " OR ".join(f"coalesce(contains(lower(response), '{p}'), false)" for p in KEYWORDS))
scalar("formal_address", "v12_ru_dialogues", lambda: F.aggregate("messages", F.lit(0), lambda a, m: a + text.count_of(F.lower(F.coalesce(m["content"], F.lit(""))), " вы ")), "list_sum(list_transform(messages, lambda m: (length(lower(coalesce(m.content, ''))) - length(replace(lower(coalesce(m.content, '')), ' вы ', ''))) // 4))::INT")
scalar("degenerate_answer", "endpoint_baseline", lambda: F.coalesce((F.length(R()) < 2) | ~R().rlike(f"[A-Za-z0-9{CYRILLIC}]"), F.lit(True)), f"coalesce(length(response) < 2 OR NOT regexp_matches(response, '[A-Za-z0-9{CYRILLIC}]'), true)")
scalar("accent_marks", "documents", lambda: text.count_matches(D(), "[áéíóúýÁÉÍÓÚâêîôû]"), "coalesce(len(regexp_extract_all(text, '[áéíóúýÁÉÍÓÚâêîôû]')), 0)")
scalar("degenerate_dots", "endpoint_baseline", lambda: F.coalesce(R().rlike(r"(\.[ ]*){3,}"), F.lit(False)), r"coalesce(regexp_matches(response, '(\.[ ]*){3,}'), false)")
scalar("structural_leak", "endpoint_baseline", lambda: F.coalesce(R().rlike(r"(?m)^(#{1,4} |\* |[0-9]+\. )|\*\*|```|<\|"), F.lit(False)), r"coalesce(regexp_matches(response, '(?m)^(#{1,4} |\* |[0-9]+\. )|\*\*|```|<\|'), false)")
scalar("citation_markers", "documents", lambda: F.coalesce(D().rlike(r"(?i)\[[0-9]+\]|\bpage [0-9]+|\bchapter [0-9]+"), F.lit(False)), r"coalesce(regexp_matches(text, '(?i)\[[0-9]+\]|\bpage [0-9]+|\bchapter [0-9]+'), false)")

_CYR, _LAT, _KK = (f"length(regexp_replace({{0}}, '[^{k}]', '', 'g'))" for k in (CYRILLIC, "A-Za-z", KAZAKH_ONLY))
c, la, kk = (x.format("text") for x in (_CYR, _LAT, _KK))
cr, lr, kr = (x.format("response") for x in (_CYR, _LAT, _KK))
cm, lm, km = (x.format("message") for x in (_CYR, _LAT, _KK))
_INTENT = f"CASE WHEN {km} > 0 AND {cm} >= 2 THEN 'kk' WHEN {cm} >= 15 OR coalesce(len(regexp_extract_all(message, '[{CYRILLIC}]+')), 0) >= 2 THEN 'ru' WHEN {cm} + {lm} = 0 THEN NULL WHEN {cm} > {lm} THEN 'ru' ELSE 'en' END"
scalar("cyrillic_share", "documents", lambda: lang.cyrillic_share(D()), f"coalesce({c} / nullif({c} + {la}, 0), 0.0)")
scalar("lang_by_ratio", "documents", lambda: lang.by_ratio(D()), f"CASE WHEN coalesce({c} / nullif({c} + {la}, 0), 0.0) >= 0.30 THEN 'ru' ELSE 'en' END")
scalar("lang_with_kazakh", "documents", lambda: lang.with_kazakh(D()), f"CASE WHEN {kk} > {c} * 0.05::DOUBLE THEN 'kk' WHEN {c} > {la} THEN 'ru' ELSE 'en' END")
scalar("intent_language", "endpoint_baseline", lambda: lang.intent(M()), _INTENT)
scalar("resolve_reply_language", "endpoint_baseline", lambda: lang.resolve(M(), F.col("locale")), f"coalesce({_INTENT}, CASE WHEN lower(trim(locale)) IN ('en', 'ru', 'kk') THEN lower(trim(locale)) END, 'en')")
scalar("cjk_drift", "documents", lambda: lang.cjk_drift(D()), "{n} >= 6 OR ({n} > 0 AND {n} >= ({n} + {c} + {la}) * 0.06::DOUBLE)".format(n=f"length(regexp_replace(text, '[^{CJK}]', '', 'g'))", c=c, la=la))
scalar("latin_run_leak", "endpoint_baseline", lambda: lang.latin_run(R()), "coalesce(regexp_matches(response, '([A-Za-z]{2,}[ ]+){2}[A-Za-z]{2,}'), false)")
_LWS = f"coalesce(len(regexp_extract_all(response, '[A-Za-z]+')) / nullif(len(regexp_extract_all(response, '[A-Za-z]+')) + len(regexp_extract_all(response, '[{CYRILLIC}]+')), 0), 0.0)"
scalar("latin_word_share", "endpoint_baseline", lambda: lang.latin_word_share(R()), _LWS)
scalar("script_leak_kind", "endpoint_baseline", lambda: lang.script_leak(R()), f"CASE WHEN {cr} > 0 AND regexp_matches(response, '([A-Za-z]{{2,}}[ ]+){{2}}[A-Za-z]{{2,}}') THEN 'run' WHEN {cr} > 0 AND {_LWS} > 0.12 THEN 'ratio' WHEN {cr} > 0 AND {lr} > 0 THEN 'any' END")
scalar("latin_words", "endpoint_baseline", lambda: F.array_join(F.coalesce(F.regexp_extract_all(R(), F.lit("([A-Za-z]+)"), F.lit(1)), F.array().cast("array<string>")), " "), "coalesce(array_to_string(regexp_extract_all(response, '([A-Za-z]+)', 1), ' '), '')")
scalar("fix_latin_leaks", "v12_ru_dialogues", lambda: F.transform("messages", lambda m: F.when(text.letters(m["content"], CYRILLIC) > 0, text.squash(F.regexp_replace(m["content"], r"\([A-Za-z ,'-]+\)|[A-Za-z][A-Za-z'-]+", ""))).otherwise(m["content"])).getItem(0), f"CASE WHEN {_CYR.format('messages[1].content')} > 0 THEN " + squash(r"regexp_replace(messages[1].content, '\([A-Za-z ,''-]+\)|[A-Za-z][A-Za-z''-]+', '', 'g')") + " ELSE messages[1].content END")
scalar("fallback_chain", "documents", lambda: F.array_join(lang.fallback_chain(F.coalesce(F.col("lang"), F.lit("en"))), ","), "CASE coalesce(lang, 'en') WHEN 'en' THEN 'en' WHEN 'ru' THEN 'ru,en' WHEN 'kk' THEN 'kk,ru,en' ELSE lang || ',en' END")
scalar("locale_correct", "endpoint_baseline", lambda: F.coalesce(F.lower(F.trim(F.col("locale"))) == lang.with_kazakh(R()), F.lit(False)), f"coalesce(lower(trim(locale)) = CASE WHEN {kr} > {cr} * 0.05::DOUBLE THEN 'kk' WHEN {cr} > {lr} THEN 'ru' ELSE 'en' END, false)")

_TOK = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')"
tr, tm = _TOK.format("coalesce(response, '')"), _TOK.format("coalesce(message, '')")
_tr, _tm = lambda: text.tokens(F.coalesce(R(), F.lit(""))), lambda: text.tokens(F.coalesce(M(), F.lit("")))
scalar("echo_user_overlap", "endpoint_baseline", lambda: F.coalesce(F.try_divide(F.size(F.array_intersect(_tm(), _tr())), F.size(F.array_distinct(_tm()))), F.lit(0.0)), f"coalesce(len(list_intersect(list_distinct({tm}), list_distinct({tr}))) / nullif(len(list_distinct({tm})), 0), 0.0)")
scalar("canned_jaccard_7", "endpoint_baseline", lambda: text.jaccard(F.slice(_tr(), 1, 7), F.array(*map(F.lit, "it sounds as though fear is the".split()))) >= 0.6, f"coalesce(len(list_intersect(list_distinct({tr}[1:7]), ['it','sounds','as','though','fear','is','the'])) / nullif(len(list_distinct(list_concat({tr}[1:7], ['it','sounds','as','though','fear','is','the']))), 0), 0.0) >= 0.6")
scalar("bigram_jaccard_prompt", "endpoint_baseline", lambda: F.round(text.jaccard(text.char_bigrams(F.lower(F.coalesce(R(), F.lit("")))), text.char_bigrams(F.lower(M()))), 9), "round(coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0.0), 9)".format(a="list_distinct(list_transform(range(1, greatest(length(coalesce(response, '')), 1)), lambda i: substr(lower(coalesce(response, '')), i, 2)))", b="list_distinct(list_transform(range(1, greatest(length(message), 1)), lambda i: substr(lower(message), i, 2)))"))
scalar("word_ngrams_3", "endpoint_baseline", lambda: F.array_join(text.ngrams(_tr(), 3), "|"), f"array_to_string(list_transform(range(1, greatest(len({tr}) - 1, 1)), lambda i: array_to_string({tr}[i:i+2], ' ')), '|')")
scalar("stem_reference", "cross_topic_regression", lambda: F.forall(F.coalesce(F.col("must_reference_prior"), F.array().cast("array<string>")), lambda k: F.contains(F.lower(M()), F.left(F.lower(k), F.lit(4)))), "coalesce(len(list_filter(must_reference_prior, lambda k: NOT contains(lower(message), left(lower(k), 4)))) = 0, true)")
scalar("keyword_any", "cross_topic_regression", lambda: F.exists("keywords", lambda k: F.contains(F.lower(M()), F.lower(k))), "len(list_filter(keywords, lambda k: contains(lower(message), lower(k)))) > 0")
scalar("history_last_4", "cross_topic_regression", lambda: F.array_join(F.transform(F.slice(F.reverse("history"), 1, 4), lambda m: F.concat(m["role"], F.lit(": "), F.left(F.coalesce(m["content"], F.lit("")), F.lit(100)))), "\n"), "array_to_string(list_transform(list_reverse(history)[1:4], lambda m: m.role || ': ' || left(coalesce(m.content, ''), 100)), chr(10))")
scalar("technique_chunk_filter", "documents", lambda: F.length(D()).between(120, 1200) & ~F.lower(D()).rlike("isbn|table of contents") & (text.count_of(D(), "\n") <= 8), "length(text) BETWEEN 120 AND 1200 AND NOT regexp_matches(lower(text), 'isbn|table of contents') AND length(text) - length(replace(text, chr(10), '')) <= 8")
scalar("infer_modality", "documents", lambda: F.when(F.lower(F.col("source")).rlike("sleep|night"), "sleep").when(F.lower(F.col("source")).rlike("couple|parent|family"), "family").when(F.lower(F.col("source")).rlike("therapy|clinic|card"), "practice").otherwise("general"), "CASE WHEN regexp_matches(lower(source), 'sleep|night') THEN 'sleep' WHEN regexp_matches(lower(source), 'couple|parent|family') THEN 'family' WHEN regexp_matches(lower(source), 'therapy|clinic|card') THEN 'practice' ELSE 'general' END")
scalar("line_filter_clean", "documents", lambda: F.array_join(F.filter(F.split(D(), "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^[ ]*(#|[0-9]+$|\[[0-9]+\])")), "\n"), r"array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^[ ]*(#|[0-9]+$|\[[0-9]+\])')), chr(10))")
scalar("paragraphs_over_20", "documents", lambda: F.size(F.filter(F.split(D(), "\n\n"), lambda x: F.length(F.trim(x)) > 20)), "len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: length(trim(x)) > 20))")
scalar("window_hours", "documents", lambda: text.window_hours(D()), "TRY_CAST(nullif(regexp_extract(lower(text), '([0-9]+(\\.[0-9]+)?)[ ]*(hour|day|week|month)s?', 1), '') AS DOUBLE) * CASE regexp_extract(lower(text), '([0-9]+(\\.[0-9]+)?)[ ]*(hour|day|week|month)s?', 3) WHEN 'hour' THEN 1 WHEN 'day' THEN 24 WHEN 'week' THEN 168 WHEN 'month' THEN 720 END")
scalar("post_check_fallback", "endpoint_baseline", lambda: F.when(F.coalesce(F.length(R()), F.lit(0)) < 20, "too_short").when(lang.script_leak(R()) == "run", "script_leak").when((text.letters(R(), CYRILLIC) > 0) & (lang.latin_word_share(R()) > 0.08), "latin_ratio").otherwise("ok"), f"CASE WHEN coalesce(length(response), 0) < 20 THEN 'too_short' WHEN {cr} > 0 AND regexp_matches(response, '([A-Za-z]{{2,}}[ ]+){{2}}[A-Za-z]{{2,}}') THEN 'script_leak' WHEN {cr} > 0 AND {_LWS} > 0.08 THEN 'latin_ratio' ELSE 'ok' END")
scalar("emotion_sequence", "documents", lambda: F.array_join(F.filter(F.transform(F.split(F.concat_ws("->", "emotion", "tone", "phase"), "->|→"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "none")), ">"), "array_to_string(list_filter(list_transform(string_split_regex(concat_ws('->', emotion, tone, phase), '->|→'), lambda x: trim(x)), lambda x: x <> '' AND x <> 'none'), '>')")
scalar("book_dump_marker", "train", lambda: F.coalesce(F.contains(D(), F.lit("source_md:")), F.lit(True)) | ~F.contains(D(), F.lit("<|im_start|>assistant")), "coalesce(contains(text, 'source_md:'), true) OR NOT contains(text, '<|im_start|>assistant')")
scalar("confidence_pass", "endpoint_baseline", lambda: F.coalesce(-F.col("latency_s") / 20 >= -2.5, F.lit(True)), "coalesce(-latency_s / 20 >= -2.5, true)")
