"""Problem 1: template residue and error-page text.

Messages are cut into sentences; distinct sentences (digits folded) are labelled
once.  Trusted labels come from patterns of placeholders, filler, error pages and
script notices.  A 64-bit SimHash of every sentence is kept in four partitioned
tables of 16 bits each; sentences that share a partition with a labelled one, are
within HAMMING bits of it and at least SIMILAR in text take its label, and so on
through the connected component until nothing changes.  A label is handed on only with
the words that speak for it (KEPT of their letters, over all steps): a notice may stand within
a sentence of real talk, whose near-copies without it are no residue.  Sentences are too short for
SimHash to bring all such pairs together, so they also meet by their prefixes: of two
sentences that reach SIMILAR, the first words in a fixed order have one in common.
Words with a digit count as one.

Placeholders are evidence by themselves, not by their surroundings, so only
filler, error and script labels propagate.

Defined cases: null and empty messages carry no residue; null rows of messages
are skipped; a message counts once however many of its sentences are residue;
very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import salted_join, salts_for, settle

#: Two sentences are near-duplicates within this many differing SimHash bits ...
HAMMING = 3
#: ... and this share of words in the same order.
SIMILAR = 0.8
#: Share of the letters of a label's evidence that a sentence must keep, and the likeness of a spoilt word to the right one.
KEPT, LIKE = 0.5, 0.65
#: Rows of labelled sentences and their keys are broadcast up to this number (about 100 bytes each), more of them in turns.
BROADCAST_ROWS = 200_000

# What the words of placeholders, service pages and filler look like in the three languages.
SLOT_WORDS = (
    "name user username emotion feeling reason topic mood situation tbd insert add your here "
    "имя имени чувство чувства причину причина тема тему вставьте укажите введите ваше "
    "аты есім есімді есімі сезім жағдай жазыңыз тақырып"
).split()
HTTP_ERRORS = "bad gateway|forbidden|gateway time out|gateway timeout|not found|service unavailable|too many requests|internal server error|unauthorized|bad request|request timeout"
# What a service speaks of, and what befell it at most two words on; talk about errors puts more between.
_THING = (
    r"(?:server|service|page|site|session|requests?|connection|gateway|deployment|access|upstream|resource|сервер|сервис|страница|сайт|сессия|доступ|запрос|соединение|ресурс"
    r"|қызмет|бет|сессия|сұраныс|байланыс|кіруге)"
)
_FATE = (
    r"(?:unavailable|not available|expired|denied|refused|reset|removed|moved or|deleted|timed out|not found|not ready|overloaded|did not (?:answer|respond)|is not responding|limit"
    r"|недоступ\w+|истек\w*|запрещен\w*|сброшен\w*|удален\w*|не найден\w*|не ответил\w*|не отвечает|перегружен\w*|табылмады|қолжетімсіз|аяқталды|тыйым салын\w+|жауап берме\w+|тым көп|үзілді)"
)
SERVICE = re.compile(
    rf"\b{_THING} (?:\w+ ){{0,2}}{_FATE}\b|\b(?:too many|слишком много|тым көп) (?:requests|запросов|сұраныс)\b|\btraceback most recent call last\b|\bread timed out\b|\bout of memory (?:while|error)\b"
    r"|\bmaintenance (?:in progress|mode)\b|\bтехнические работы\b|\bтехникалық жұмыс\w*|^(?:back soon|скоро вернемся)$|\b(?:checking your browser|проверяем (?:ваш )?браузер|браузерді тексер\w*)"
    r"|\b(?:reference number|error code|номер обращения|код ошибки|өтініш нөмірі) 0+\b"
)
FILLER = re.compile(
    r"\blorem ipsum\b|\bdolor sit amet\b|\b(?:your text|ваш текст|мәтініңіз) (?:here|здесь|осында)\b|\b(?:reply|answer|response) goes here\b|\bздесь будет (?:ваш )?(?:ответ|текст)\b|\bжауабы осында болады\b"
    r"|\b(?:type a|введите|enter your) (?:message|сообщение)\b|\bхабарлама жазыңыз\b|\b(?:replace|заменить|ауыстыр\w*) (?:before|перед) (?:release|выпуском|публикацией)\b|\bалдында ауыстыр\w*"
    r"|\b(?:write the reply|дописать ответ|жауапты жазу) 0\b|\b(?:start|end) of (?:reply|answer|text)\b"
)
#: Endings of words in mock Latin, and the share of a sentence's words (five or more) that end so.
MOCK_LATIN, MOCK_SHARE = re.compile(r"[a-z]{2,}(?:us|is|um|a|em|unt|ur)$"), 0.8
FILLER_WHOLE = ("stub", "заглушка", "толтырылмаған", "todo", "fixme", "tbd", "placeholder", "q a", "instruction", "response", "q", "a")

_SCRIPT = r"(?:javascript|java script|js|scripts?|cookies?|скрипт\w*|сценари\w*|скрипттер\w*|куки)"
_DEMAND = r"(?:enable|allow|activate|turn(?:ed)? on|turned off|switch(?:ed)? off|switch(?:ed)? on|disabled|requires?|required|without|reload|включит[еь]|разрешит[еь]|отключен\w*|запускается без|требует\w*|необходим\w*|қосыңыз|өшірулі|болмаса|рұқсат беріңіз)"
SCRIPTS = re.compile(rf"\b{_SCRIPT}\b.*\b{_DEMAND}\b|\b{_DEMAND}\b.*\b{_SCRIPT}\b|^разрешите их чтобы продолжить|^оларды қосыңыз")
HTTP = re.compile(rf"\b[0-9]{{3}} (?:{HTTP_ERRORS})\b")
CODE_ONLY = re.compile(r"(?:error|ошибка|қате) [0-9]+$")
FILE_LINE = re.compile(r"^file \S+ py line [0-9]+ in\b")
#: Strings that must occur before the slower patterns of a kind are tried.
SCRIPT_HINTS = ("javascript", "java script", " js ", "script", "cookie", "скрипт", "сценари", "куки", "разрешите их", "оларды қосыңыз")
MARKED = re.compile(r"[{}<>\[\]_@$#%&]|undefined|NaN\b", re.I)
PLACEHOLDER = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|[$#]\{[^}]*\}|\{[^{}\"]{0,60}\}|\[\[.*?\]\]|<<[^<>]*>>|@@\w+@@|%[^\W\d]\w*%|%\(\w+\)[sd]|(?<![\w%])%[sd]\b|(?<!\w)\$[A-Za-z_]{2,}"
    r"|_{2,}|[^\W\d_]_[^\W\d_]|&lt;|&gt;|<[^\W\d_][^<>]{0,60}>|\[object object\]|\bundefined\b|\bNaN\b",
    re.I | re.S,
)
MARKUP = re.compile(r"</?(?:html|head|body|title|center|noscript|div|span|script|p|br|hr|reply|h[0-9])\b[^>]*>|^#{2,} (?:instruction|response)|<\|\w+\|>", re.I)
BRACKET = re.compile(r"\[([^\[\]]{1,60})\]")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")
_SLOTS = frozenset(SLOT_WORDS)


def words(text: str) -> list[str]:
    return _WORD.findall(INVISIBLE.sub("", text).lower().replace("ё", "е"))


def label(text: str | None, tokens: list[str] | None = None) -> str | None:
    """placeholder, markup, error_page, script_notice, filler, or None."""
    if not text:
        return None
    if MARKED.search(text):
        if MARKUP.search(text):
            return "markup"
        if PLACEHOLDER.search(text):
            return "placeholder"
        for inner in BRACKET.findall(text):
            rest = text.replace(inner, "")
            if _SLOTS.intersection(words(inner)) or inner.isupper() and len(inner) > 2 and not (rest.isupper() and len(rest) > 12):
                return "placeholder"
    tokens = words(text) if tokens is None else tokens
    if not tokens:
        return None
    if len(tokens) >= 3 and len(set(tokens)) == 1 or tokens[0] in ("todo", "fixme", "tbd"):
        return "filler"
    n = " ".join(tokens)
    if n in FILLER_WHOLE and (len(n) > 1 or ":" in text):
        return "filler"
    if len(tokens) >= 5 and text.isascii() and tokens[0].endswith(("us", "is", "um", "a", "em")) and sum(MOCK_LATIN.match(t) is not None for t in tokens) >= MOCK_SHARE * len(tokens):
        return "filler"
    if any(t.endswith(("error", "exception")) and len(t) > 7 for t in tokens[:2]) or CODE_ONLY.match(n):
        return "error_page"
    for _, kind in hints().iter(f" {n} "):
        if kind == "filler" and FILLER.search(n):
            return kind
        if kind == "error_page" and (SERVICE.search(n) or HTTP.search(n)) or kind == "file" and FILE_LINE.search(n):
            return "error_page"
        if kind == "script_notice" and SCRIPTS.search(n):
            return kind
    return None


_SPEAKS = {"filler": [FILLER], "error_page": [SERVICE, HTTP, CODE_ONLY, FILE_LINE], "script_notice": [re.compile(rf"\b{_SCRIPT}\b"), re.compile(rf"\b{_DEMAND}\b")]}


def evidence(tokens: list[str], kind: str) -> list[int]:
    """Places of the words that speak for a label: those its patterns match, else all."""
    n = " ".join(tokens)
    places = {i for p in _SPEAKS[kind] for m in p.finditer(n) for i in range(n.count(" ", 0, m.start()), n.count(" ", 0, m.end()) + 1)}
    if kind == "error_page":
        places |= {i for i, t in enumerate(tokens[:2]) if t.endswith(("error", "exception")) and len(t) > 7}
    if kind == "filler" and tokens[0] in ("todo", "fixme", "tbd"):
        places.add(0)
    return sorted(places) or list(range(len(tokens)))


# Strings one of which must occur before the slower patterns of a kind are tried.
HINTS = {
    "error_page": [
        *HTTP_ERRORS.split("|"), "server ", "service ", "page ", " site ", "session ", " request", "connection ", "gateway ", "deployment ", "access ", "upstream ", "resource ", "сервер ", "сервис ", "страница ", "сайт ", "сессия ", "доступ ",
        "запрос", "соединение ", "ресурс ", "қызмет ", " бет ", "сұраныс", "байланыс ", "кіруге ", "traceback", "timed out", "out of memory", "maintenance", "технические", "техникалық", "back soon", "скоро вернемся", "браузер", "browser",
        "reference number", "error code", "номер обращения", "код ошибки", "өтініш нөмірі",
    ],
    "filler": [
        "lorem", "dolor", " text ", " текст ", "мәтініңіз", "goes here", "здесь будет", "осында", "message", "сообщение", "хабарлама", "replace", "заменить", "ауыстыр", "write the reply", "дописать", "жауапты", "start of", "end of",
    ],
    "script_notice": SCRIPT_HINTS, "file": [" py line "],
}


@lru_cache(maxsize=1)
def hints():
    """One automaton over all hints, each with the kind it speaks for."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, strings in HINTS.items():
        for x in strings:
            a.add_word(x, kind)
    a.make_automaton()
    return a


PROPAGATE = ("filler", "error_page", "script_notice")
_hashes: dict[str, int] = {}


def _word_hash(w: str) -> int:
    h = _hashes.get(w)
    if h is None:
        if len(_hashes) > 300_000:
            _hashes.clear()
        shown = "0" if any(c.isdigit() for c in w) else w  # numbers and ids are all one
        h = _hashes[w] = int.from_bytes(hashlib.blake2b(shown.encode(), digest_size=8).digest(), "little")
    return h


def simhashes(token_lists: list[list[str]]) -> np.ndarray:
    """64-bit SimHash of each list over its words and word pairs; empty lists give 0."""
    n = np.array([len(t) for t in token_lists], np.int64)
    out = np.zeros(len(n), np.uint64)
    flat = np.fromiter((_word_hash(w) for t in token_lists for w in t), np.uint64, int(n.sum()))
    if not len(flat):
        return out
    with np.errstate(over="ignore"):
        pair = flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:]
        pair ^= pair >> np.uint64(31)
        pair *= np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum(n)
    some = n > 0
    starts = (ends - n)[some]
    bits = lambda x: np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * 2 - 1
    one = np.add.reduceat(bits(flat), starts, axis=0)
    both = np.zeros((len(flat), 64), np.int16)
    both[:-1] = bits(np.ascontiguousarray(pair))
    both[ends[some] - 1] = 0  # no pair over the end of a text
    total = one + np.add.reduceat(both, starts, axis=0)
    out[some] = np.packbits(total > 0, axis=1).view(np.uint64).ravel()
    return out


def prefix(tokens: list[str]) -> list[int]:
    """Word hashes (repeats of a word apart) of which sentences of similarity SIMILAR share one.

    With M words in common, 2 M / (a + b) >= SIMILAR and M <= b give
    M >= a SIMILAR / (2 - SIMILAR): so many words but that are left out at most, and
    the rest in one fixed order, long words (rare ones) first, must meet.
    """
    seen: dict[str, int] = {}
    keys = []
    for w in tokens:
        k = seen[w] = seen.get(w, 0) + 1
        keys.append((-len(w), (_word_hash(w) + k * 0x9E3779B97F4A7C15) % (1 << 64)))
    need = max(1, math.ceil(len(keys) * SIMILAR / (2 - SIMILAR) - 1e-9))
    return [k - (1 << 63) for _, k in sorted(keys)[: len(keys) - need + 1]]


def _label_batches(batches):
    for batch in batches:
        texts = batch.column("seg").to_pylist()
        tokens = [words(t) for t in texts]
        plain = [["0" if any(c.isdigit() for c in w) else w for w in t] for t in tokens]
        labels = [label(t, w) for t, w in zip(texts, tokens, strict=True)]
        spread = [k in PROPAGATE and bool(w) for k, w in zip(labels, tokens, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("h"), pa.array([" ".join(t) for t in plain], pa.string()), batch.column("n"), pa.array(simhashes(tokens).view(np.int64)), pa.array(labels, pa.string()),
             pa.array([len(w) for w in tokens], pa.int32()), pa.array([prefix(t) for t in plain], pa.list_(pa.int64())), pa.array([hashlib.blake2b(" ".join(t).encode(), digest_size=16).digest() for t in plain], pa.binary()),
             pa.array([evidence(w, k) if s else None for w, k, s in zip(tokens, labels, spread, strict=True)], pa.list_(pa.int32())), pa.array([1.0 if s else None for s in spread], pa.float64())],
            ["h", "plain", "n", "sim", "label", "n_words", "prefix", "fold", "evidence", "share"],
        )


def handed_on(seed: list[str], places: list[int], other: list[str]) -> tuple[float, list[int]] | None:
    """Share of the letters of ``seed``'s evidence that ``other`` keeps in its place, and where; None unless the two are SIMILAR."""
    if not seed or not other or min(len(seed), len(other)) < 3 and seed != other or 2 * (Counter(seed) & Counter(other)).total() < SIMILAR * (len(seed) + len(other)):
        return None
    match = SequenceMatcher(None, seed, other, autojunk=False)
    if match.ratio() < SIMILAR:
        return None
    kept: dict[int, int] = {}  # place in other: letters
    for what, i1, i2, j1, j2 in match.get_opcodes():
        for i in places:
            if i1 <= i < i2 and what == "equal":
                kept[j1 + i - i1] = len(seed[i])
            elif i1 <= i < i2 and what == "replace":
                like = [j for j in range(j1, j2) if j not in kept and SequenceMatcher(None, seed[i], other[j], autojunk=False).ratio() >= LIKE]
                kept |= {j: len(seed[i]) for j in like[:1]}
    return sum(kept.values()) / sum(len(seed[i]) for i in places), sorted(kept)


def _verify_batches(batches):
    """Keeps candidates whose words agree with the labelled sentence's, its evidence among them."""
    for batch in batches:
        got = []
        for h, plain, seed, kind, places, share in zip(*(batch.column(c).to_pylist() for c in ("h", "plain", "seed", "label", "evidence", "share")), strict=True):
            if (on := handed_on(seed.split(" "), places, plain.split(" "))) and on[0] * share >= KEPT:
                got.append((h, kind, on[1], on[0] * share))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.binary(), pa.string(), pa.list_(pa.int32()), pa.float64()))], ["h", "label", "evidence", "share"])


_TABLE = "h binary, plain string, n long, sim long, label string, n_words int, prefix array<long>, fold binary, evidence array<int>, share double"


def segments(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with one row per sentence: its text with digits folded, and 128 bits over it."""
    cut = F.split(F.col(text), r"(?<=[.!?…])\s+|\n+")
    seg = F.translate(F.trim(F.col("_seg")), "123456789", "000000000")
    rest = [c for c in messages.columns if c != text]
    out = messages.where(F.col(text).isNotNull()).select(*rest, F.explode(cut).alias("_seg")).select(*rest, seg.alias("seg")).where("seg <> ''")
    return out.withColumn("h", F.unhex(F.concat(F.lpad(F.hex(F.xxhash64("seg")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("s"), "seg")), 16, "0"))))


def _blocks(df: DataFrame, *keep: str) -> DataFrame:
    """One row per partition table: table number and its 16 bits."""
    parts = F.array(*[F.struct(F.lit(i).alias("tab"), F.shiftrightunsigned("sim", 16 * i).bitwiseAND(0xFFFF).alias("bits")) for i in range(4)])
    return df.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.tab", "p.bits")


def residue_segments(messages: DataFrame, text: str = "text", propagate: bool = True) -> DataFrame:
    """(h, label, n occurrences) of every residue sentence, labels propagated to near-duplicates."""
    distinct = segments(messages.select(text), text).groupBy("seg").agg(F.first("h").alias("h"), F.count(F.lit(1)).alias("n"))
    table = settle(distinct.mapInArrow(_label_batches, _TABLE), "residue-segments")
    found = table.where("label is not null").select("h", "label", "n")
    frontier = table.where(F.col("label").isin(*PROPAGATE) & (F.col("n_words") > 0))
    open_ = table.where("label is null and n_words > 0")
    while propagate:
        # Sentences of the same folded words are one node of the graph: one seed each.
        seeds = frontier.groupBy("fold").agg(F.max(F.struct("share", "label", "evidence", "plain")).alias("s"), F.first("sim").alias("seed_sim"), F.first("n_words").alias("seed_words"), F.first("prefix").alias("seed_prefix"))
        seeds = settle(seeds.select("fold", F.col("s.plain").alias("seed"), "s.label", "s.evidence", "s.share", "seed_sim", "seed_words", "seed_prefix"), "residue-seeds")
        n, rows = seeds.agg(F.count(F.lit(1)), F.sum(F.size("seed_prefix") + 4 + F.length("seed") / 50)).first()
        if not n:
            break
        turns = min(n, math.ceil(rows / max(1, BROADCAST_ROWS)))
        near = [_near(open_, seeds.where(F.pmod(F.xxhash64("fold"), F.lit(turns)) == i)) for i in range(turns)]
        fresh = near[0]
        for x in near[1:]:
            fresh = fresh.unionByName(x)
        fresh = fresh.mapInArrow(_verify_batches, "h binary, label string, evidence array<int>, share double").groupBy("h").agg(F.max(F.struct("share", "label", "evidence")).alias("s")).select("h", "s.*")
        fresh = settle(fresh, "residue-fresh")
        fresh = F.broadcast(fresh) if fresh.count() <= BROADCAST_ROWS else fresh
        frontier = settle(open_.drop("label", "evidence", "share").join(fresh, "h"), "residue-frontier")
        found = found.unionByName(frontier.select("h", "label", "n"))
        open_ = open_.join(fresh.select("h"), "h", "left_anti")
    return found


def _near(open_: DataFrame, seeds: DataFrame) -> DataFrame:
    """Open sentences that may be near-duplicates of seeds and hold a word of their evidence; nothing is shuffled or written.

    By prefixes a pair meets once, at the first key that both have.
    """
    speaks = F.transform("evidence", lambda i: F.element_at(F.split("seed", " "), i + 1))
    seeds = seeds.withColumnRenamed("fold", "seed_fold").withColumn("speaks", F.transform(F.array_distinct(speaks), lambda w: F.concat(F.lit(" "), w, F.lit(" "))))
    whole = F.broadcast(seeds.select("seed_fold", "seed", "label", "evidence", "share", "speaks", "seed_prefix"))
    held = F.exists("speaks", lambda w: F.contains(F.concat(F.lit(" "), F.col("plain"), F.lit(" ")), w))
    cols = ["h", "plain", "seed", "label", "evidence", "share"]
    open_ = open_.select("h", "plain", "sim", "n_words", "prefix")
    marked = F.broadcast(_blocks(seeds.withColumn("sim", F.col("seed_sim")), "seed_sim", "seed_fold"))
    by_hash = _blocks(open_, "h", "plain", "sim").join(marked, ["tab", "bits"]).where(F.bit_count(F.col("sim").bitwiseXOR(F.col("seed_sim"))) <= HAMMING)
    met = F.broadcast(seeds.select("seed_fold", "seed_words", F.explode("seed_prefix").alias("key")))
    by_word = open_.select("h", "plain", "n_words", "prefix", F.explode("prefix").alias("key")).join(met, ["key"])
    by_word = by_word.where(F.least("n_words", "seed_words") * (2 - SIMILAR) >= SIMILAR * F.greatest("n_words", "seed_words") - 1e-6)
    by_word = by_word.join(whole, "seed_fold").where(held).where(F.element_at(F.array_intersect("prefix", "seed_prefix"), 1) == F.col("key"))
    return by_hash.join(whole, "seed_fold").where(held).select(*cols).unionByName(by_word.select(*cols))


def all_messages(dialogues: DataFrame, responses: DataFrame) -> DataFrame:
    """(tbl, row_key, msg_idx, text) of both tables."""
    a = dialogues.select(F.lit("v12_ru_dialogues").alias("tbl"), F.col("rec_id").alias("row_key"), F.posexplode("messages").alias("msg_idx", "m")).select("tbl", "row_key", "msg_idx", F.col("m.content").alias("text"))
    b = responses.select(F.lit("endpoint_baseline").alias("tbl"), F.col("resp_id").alias("row_key"), F.lit(0).alias("msg_idx"), F.col("response").alias("text"))
    return a.unionByName(b)


def residue_messages(messages: DataFrame, text: str = "text", propagate: bool = True) -> DataFrame:
    """The keys of ``messages`` (all columns but ``text``) that hold residue, and ``residue``, its kind."""
    keys = [c for c in messages.columns if c not in (text, "residue")]
    packed = messages.select(F.struct(*keys).alias("_key"), F.col(text).alias("_text"))
    bad = settle(residue_segments(packed, "_text", propagate), "residue-labels")
    found = segments(packed, "_text").select("_key", "h")
    if bad.count() <= BROADCAST_ROWS:
        hits = found.join(F.broadcast(bad), "h")
    else:  # a residue sentence may be a third of all: spread it over salts
        hits = salted_join(found, bad.withColumn("n_salts", salts_for(F.col("n"))).drop("n"), ["h"], F.col("_key"))
    return hits.groupBy("_key").agg(F.min("label").alias("residue")).select("_key.*", "residue")


def without_residue(dialogues: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the residue messages (dialogues keep their other messages)."""
    bad = settle(residue_messages(all_messages(dialogues, responses)), "residue-messages")
    per = bad.where("tbl = 'v12_ru_dialogues'").groupBy(F.col("row_key").alias("_rk")).agg(F.collect_set("msg_idx").alias("_bad"))  # at most one entry per message of a row
    kept = dialogues.join(per, F.col("rec_id") == F.col("_rk"), "left").drop("_rk")
    kept = kept.withColumn("messages", F.when(F.col("_bad").isNull(), F.col("messages")).otherwise(F.filter("messages", lambda m, i: ~F.array_contains("_bad", i)))).drop("_bad")
    gone = bad.where("tbl = 'endpoint_baseline'").select(F.col("row_key").alias("_rk"))
    return kept, responses.join(gone, F.col("resp_id") == F.col("_rk"), "left_anti")
