"""Problem 5: broken prompt and response pairs.

Each defect has several noisy labelling functions that vote for (1), against (-1)
or abstain (0).  A label model per defect, fitted by expectation-maximization on
the counts of vote patterns (never on rows), gives each pattern a posterior; a
pair carries every defect whose posterior exceeds the cutoff.

Defined cases: a null or wordless answer is empty unless it is an emoji or emoticon; a null or wordless question
can't be copied and has no language; pairs with template residue in either
message are left out; only an assistant message right after a user message makes
a pair; repeated deliveries are pairs of their own.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import language, residue, terminality
from corpusmill.runtime import salted_join, salts_for, settle

DEFECTS = ("empty", "copies_question", "other_language", "refusal", "truncated")
#: Posterior from which a defect holds; precision and recall of each defect at it are held on labelled pairs in tests/llm.
CUTOFF = 0.5
#: Votes per defect.
N_VOTES = 3
#: Most distinct vote patterns that may reach the driver (a few hundred occur); more are an error.
MAX_PATTERNS = 200_000

# Stand-ins for an answer that says nothing.
STAND_INS = frozenset("null none nil nan na n/a undefined empty blank пусто нет бос жоқ".split()) | {"n a", "no answer", "no response", "нет ответа", "без ответа", "жауап жоқ"}
#: Emoji and emoticons, which say something without words.
SIGNS = re.compile(r"[\U0001F300-\U0001FAFF☀-➿]|[:;]-?[)(DP]|<3")
# How refusals open and what they say.
APOLOGY = re.compile(r"^(?:sorry|i apologi[sz]e|apologies|unfortunately|i m afraid|i am afraid|извини\w*|прости\w*|к сожалению|увы|кешір\w*|өкінішке қарай)\b")
REFUSING = re.compile(
    r"\bi (?:must|have to|will) (?:pass|decline)\b|\bno answer from me\b|\bi (?:cannot|can t|can not) (?:help|assist|answer|discuss|respond|comply|talk)\b|\bwon t be able to (?:assist|help|answer)\b"
    r"|\boff limits for me\b|\bunable to (?:respond|answer|help|assist)\b|\bmy (?:rules|guidelines|policy) \w+ not\b|\bbeyond what i may do\b|\bi would rather skip\b|\bnot something i (?:discuss|can)\b"
    r"|\bnot (?:permitted|allowed|able) to (?:talk|discuss|answer|help)\b|\bagainst my (?:guidelines|rules|policy)\b|\bas an? (?:language )?(?:program|model|ai|assistant)\b"
    r"|\bя не (?:могу|смогу|в силах) (?:помочь|ответить|отвечать|обсуждать)\b|\bне в моих силах\b|\bправила (?:сервиса )?запрещают\b|\bза рамки моих правил\b|\bотвечать на это мне нельзя\b|\bответа от меня не будет\b"
    r"|\bпридется отказаться от ответа\b|\bтакие темы я не обсуждаю\b|\bпропущу этот вопрос\b|\bтут я пас\b|\bне уполномочен\w*\b|\bобсуждение для меня закрыто\b|\bкак (?:языковая )?(?:программа|модель)\b|\bне даю ответов\b"
    r"|\bжауап бере алмаймын\b|\bкөмектесе алмаймын\b|\bбас тартамын\b|\bайтуға болмайды\b|\bрұқсат бермейді\b|\bталқыламаймын\b|\bөткізіп жіберемін\b|\bбағдарлама (?:ретінде|болғандықтан)\b|\bқұзырымда емес\b|\bқолымнан келмейді$"
)
SOFT_CLOSING = re.compile(
    r"^(?:ask me something else|let us change the subject|please contact a professional|i understand (?:your feelings|how you feel)|thanks for (?:writing|your trust)|thank you for your trust"
    r"|спроси (?:что нибудь другое|кого нибудь живого)|давай сменим тему|обратись к специалисту|разговор на этом закрываю|понимаю твои чувства|спасибо за доверие"
    r"|басқа нәрсе сұраңыз|маманға жүгініңіз|тақырыпты ауыстырайық|сезіміңді түсінемін|жазғаныңа рақмет|сенгеніңе рақмет)"
)
GREETING = frozenset("привет здравствуй здравствуйте да хм ок hi hello hey yes hm ok иә сәлем рақмет".split())
_WORD = re.compile(r"[^\W_]+")
_DIGITS = str.maketrans("123456789", "0" * 9)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
#: Words that put a quoted question before an answer.
LEAD_IN = frozenset("you ask asked say said write wrote question your ты спрашиваешь спросил пишешь написал говоришь вопрос твой сен сұрадың жаздың дедің сұрақ".split())


def words(text: str | None) -> list[str]:
    return _WORD.findall(residue.INVISIBLE.sub("", text).lower().replace("ё", "е")) if text else []


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & at.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def vote_empty(answer: str | None, wq: list[str], wa: list[str]) -> tuple[int, int, int]:
    """By what is said, by the letters there are, and by size against the question."""
    if not wa and SIGNS.search(answer or ""):
        return -1, -1, 0  # a smile is an answer
    said = -1 if wa and " ".join(wa) not in STAND_INS else 1
    letters = sum(map(str.isalnum, answer or ""))
    sizes = sum(map(len, wa)), sum(map(len, wq))
    return said, 1 if not letters else 0 if letters < 6 else -1, 0 if sizes[1] < 40 else 1 if sizes[0] <= 0.03 * sizes[1] else -1 if sizes[0] >= 0.1 * sizes[1] else 0


def vote_copy(wq: list[str], wa: list[str]) -> tuple[int, int, int]:
    if len(wq) < 3 or len(wa) < 3:
        return -1, -1, 0
    known = set(wq)
    new = [w for w in wa if w not in known and w not in LEAD_IN]
    inside = 1 - len(new) / len(wa)
    if inside < 0.55:
        return -1, -1, -1
    share = lcs(wq, wa) / len(wa)
    twice = len(wa) > 1.7 * len(wq)
    covered = len(known.intersection(wa)) / len(known)
    return (1 if inside >= 0.8 else 0 if inside >= 0.65 else -1, 1 if share >= 0.75 or twice and inside >= 0.9 else 0 if share >= 0.6 else -1, 1 if covered >= 0.7 or share >= 0.9 else -1 if covered < 0.3 else 0)


def vote_language(best, wq: list[str], wa: list[str]) -> tuple[int, int, int]:
    q = Counter(k for w in wq if (k := best(w)) is not None)
    a = Counter(k for w in wa if w not in GREETING and (k := best(w)) is not None)
    if not q or not a:
        return 0, 0, 0
    lq, la = min(q, key=lambda k: (-q[k], k)), min(a, key=lambda k: (-a[k], k))
    share, back = a[la] / a.total(), a[lq] / a.total()
    differs = lq != la
    return (1 if differs and a[la] >= 3 else -1, 1 if differs and share >= 0.7 and a[la] >= 3 else -1 if back >= 0.5 else 0, 1 if back < 0.3 and a[la] >= 3 else -1 if back > 0.6 else 0)


def vote_refusal(answer: str | None, wa: list[str]) -> tuple[int, int, int]:
    n = " ".join(wa)
    says = bool(REFUSING.search(n))
    if not says:
        return -1, 1 if APOLOGY.match(n) and len(wa) < 12 else 0, -1
    rest = 0
    sorry = False
    for s in _SENTENCE.split(answer or ""):
        w = words(s)
        m = " ".join(w)
        sorry |= bool(APOLOGY.match(m))
        if w and not REFUSING.search(m) and not SOFT_CLOSING.match(m) and not (len(w) <= 2 and w[0] in GREETING):
            rest += len(w)
    return 1, 1 if sorry else 0, 1 if rest <= 8 else 0 if rest <= 16 else -1


def vote_truncated(answer: str | None, wa: list[str], ends: terminality.Terminality | None) -> tuple[int, int, int]:
    """By the closing words in their sentence, by the last word alone, and by how sure the first is (these two aren't independent).

    Without a model all three are against; for an answer of which something is ``asked`` that isn't its verdict yet.
    """
    text = terminality.clean(answer or "")
    if ends is None or not wa or text[-1:] in ".!?":
        return -1, -1, -1
    p = ends.complete(text)
    last = wa[-1]
    e, m = ends.ends.get(last, (0, 0))
    dangling = m > 4 * e or (not e and not m and ends._begins(ends.vocabulary, last))
    return (1 if p < 0.5 else -1, 1 if dangling and p < 0.9 else -1 if e > m else 0, 1 if p < 0.2 else 0 if p < 0.8 else -1)


def asked(answer: str | None, wa: list[str]) -> list[tuple[str, str]]:
    """(kind, key) of all entries that ``vote_truncated`` may look up; none for an answer that it judges without them."""
    text = terminality.clean(answer or "")
    if not wa or text[-1:] in ".!?":
        return []
    return list(dict.fromkeys([*terminality.asked(text), ("w", wa[-1]), ("v", wa[-1])]))


def pack(votes: tuple[tuple[int, int, int], ...]) -> int:
    """All votes as one number in base 3."""
    code = 0
    for v in votes:
        for x in v:
            code = code * 3 + x + 1
    return code


def unpack(code: int) -> list[tuple[int, ...]]:
    out = []
    for _ in range(len(DEFECTS) * N_VOTES):
        code, x = divmod(code, 3)
        out.append(x - 1)
    out.reverse()
    return [tuple(out[i * N_VOTES : (i + 1) * N_VOTES]) for i in range(len(DEFECTS))]


def votes(question: str | None, answer: str | None, best, ends: terminality.Terminality | None) -> int:
    wq, wa = words(question), words(answer)
    return pack((vote_empty(answer, wq, wa), vote_copy(wq, wa), vote_language(best, wq, wa), vote_refusal(answer, wa), vote_truncated(answer, wa, ends)))


def dictionary(model: language.Model, margin: float = 2.0):
    """word -> its language, or None where it could be of several; cached, bounded."""
    cache: dict[str, str | None] = {}

    def best(w: str) -> str | None:
        if w in cache:
            return cache[w]
        if len(cache) > 300_000:
            cache.clear()
        got = None
        if model.langs and not w[0].isdigit():
            s = model.scores(w)
            order = sorted(s, reverse=True)
            if len(s) == 1 or order[0] - order[1] >= margin:
                got = model.langs[s.index(order[0])]
        cache[w] = got
        return got

    return best


def has_residue(text: str | None) -> bool:
    """Whether a sentence is labelled as residue, its digits folded as in problem 1."""
    return bool(text) and any(residue.label(s.strip()) for s in _SENTENCE.split(text.translate(_DIGITS)))


def _vote_batches(shared_language, shared_ends=None):
    """Votes by the whole model of sentence ends, or without it; then an open answer goes along, and whether residue is in its pair."""
    neutral = pack(((-1, -1, -1), (-1, -1, -1), (-1, -1, -1), (-1, 0, -1), (-1, -1, -1)))  # the usual sound pair

    def run(batches):
        best, ends = dictionary(shared_language.value), shared_ends and shared_ends.value
        for batch in batches:
            codes, keep, answers, spoilt = [], [], [], []
            for i, (q, a) in enumerate(zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist(), strict=True)):
                code = votes(q, a, best, ends)
                is_open = ends is None and bool(asked(a, words(a)))
                speaks = code != neutral and any(1 in v for v in unpack(code))
                residual = (speaks or is_open) and (has_residue(q) or has_residue(a))
                if speaks and residual:
                    continue
                keep.append(i)
                codes.append(code)
                answers.append(a if is_open else None)
                spoilt.append(residual)
            got = batch.select(["tbl", "row_key", "msg_idx"]).take(pa.array(keep, pa.int64()))
            columns = {**dict(zip(got.schema.names, got.columns, strict=True)), "code": pa.array(codes, pa.int64())}
            if ends is None:
                columns |= {"answer": pa.array(answers, pa.string()), "spoilt": pa.array(spoilt, pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _ask_batches(batches):
    for batch in batches:
        rows = [(h, kind, key) for h, a in zip(batch.column("h").to_pylist(), batch.column("answer").to_pylist(), strict=True) for kind, key in asked(a, words(a))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["h", "kind", "key"])


def _cut_batches(batches):
    """Votes on truncation of open answers by what each was ``told``, packed, and whether one is for it."""
    for batch in batches:
        cut = [vote_truncated(a, words(a), terminality.told(r)) for a, r in zip(batch.column("answer").to_pylist(), batch.column("told").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("h"), batch.column("n_salts"), pa.array([pack((v,)) for v in cut], pa.int64()), pa.array([1 in v for v in cut], pa.bool_())],
            ["h", "n_salts", "cut", "speaks"],
        )


def _voted(pairs: DataFrame, lang: language.Model, max_entries: int) -> DataFrame:
    """(tbl, row_key, msg_idx, code) of all pairs: by a model of sentence ends sent to all tasks or, beyond ``max_entries``, by a join of each open answer with the entries it asks for."""
    context = pairs.sparkSession.sparkContext
    total = settle(terminality.totals(pairs, F.col("answer")), "pair-counts")
    b_lang = context.broadcast(lang)  # bounded: MAX_WORDS
    keys = "tbl string, row_key long, msg_idx int"
    if total.count() <= max_entries:
        return pairs.mapInArrow(_vote_batches(b_lang, context.broadcast(terminality.fit(total))), f"{keys}, code long")
    voted = settle(pairs.mapInArrow(_vote_batches(b_lang), f"{keys}, code long, answer string, spoilt boolean"), "pair-open")
    # Copies of an answer share a verdict by hash.
    both = F.concat(F.lpad(F.hex(F.xxhash64("answer")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("t"), F.col("answer"))), 16, "0"))
    opened = voted.where("answer is not null").withColumn("h", both)
    texts = settle(opened.groupBy("h").agg(F.first("answer").alias("answer"), salts_for(F.count(F.lit(1))).alias("n_salts")), "pair-texts")
    asks = settle(texts.mapInArrow(_ask_batches, "h string, kind string, key string"), "pair-asked")
    cut = texts.join(terminality.tell(asks, total, "pair"), "h", "left").mapInArrow(_cut_batches, "h string, n_salts int, cut long, speaks boolean")
    late = salted_join(opened.drop("answer"), settle(cut, "pair-cuts"), ["h"], F.col("row_key")).where("not (spoilt and speaks)")
    late = late.withColumn("code", F.col("code") + F.col("cut"))  # truncated is the last of DEFECTS, so its votes are the lowest digits
    return voted.where("answer is null").unionByName(late, allowMissingColumns=True).select("tbl", "row_key", "msg_idx", "code")


def label_model(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each vote pattern, by expectation-maximization.

    Votes are taken as independent given the class.  Priors say that functions
    are right nine times out of ten and that defects are rare; they keep the
    classes from trading places on data without any defect.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    v = np.array(keys)  # patterns x functions
    n = np.array([patterns[k] for k in keys], float)
    total = n.sum()
    prior = np.array([[0.05, 0.10, 0.85], [0.85, 0.10, 0.05]])  # class: defect, sound; vote -1, 0, 1
    theta = np.repeat(prior[:, None, :], v.shape[1], axis=1)
    share = 0.01
    post = np.zeros(len(keys))
    strength = np.array([max(20.0, 0.002 * total), max(20.0, 0.05 * total)])
    for _ in range(rounds):
        logp = np.log(np.array([share, 1 - share]))[:, None] + sum(np.log(theta[:, j, :])[:, v[:, j] + 1] for j in range(v.shape[1]))
        logp -= logp.max(axis=0)
        p = np.exp(logp)
        new = p[0] / p.sum(axis=0)
        weight = np.stack([n * new, n * (1 - new)])
        for j in range(v.shape[1]):
            for x in range(3):
                theta[:, j, x] = (weight[:, v[:, j] + 1 == x].sum(axis=1) + strength * prior[:, x]) / (weight.sum(axis=1) + strength)
        share = float((weight[0].sum() + 1) / (total + 100))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return {k: float(x) if 1 in k else 0.0 for k, x in zip(keys, post, strict=True)}  # no defect for which nothing speaks


def pair_rows(dialogues: DataFrame, responses: DataFrame) -> DataFrame:
    """(tbl, row_key, msg_idx, question, answer) of both tables."""
    step = F.transform(
        F.sequence(F.lit(0), F.size("messages") - 2),
        lambda i: F.struct((i + 1).alias("msg_idx"), F.get("messages", i)["role"].alias("r0"), F.get("messages", i + 1)["role"].alias("r1"), F.get("messages", i)["content"].alias("question"), F.get("messages", i + 1)["content"].alias("answer")),
    )
    a = dialogues.where(F.size("messages") >= 2).select(F.lit("v12_ru_dialogues").alias("tbl"), F.col("rec_id").alias("row_key"), F.explode(step).alias("p"))
    a = a.where("p.r0 = 'user' and p.r1 = 'assistant'").select("tbl", "row_key", "p.msg_idx", "p.question", "p.answer")
    b = responses.select(F.lit("endpoint_baseline").alias("tbl"), F.col("resp_id").alias("row_key"), F.lit(0).alias("msg_idx"), F.col("message").alias("question"), F.col("response").alias("answer"))
    return a.unionByName(b)


def defects(dialogues: DataFrame, responses: DataFrame) -> DataFrame:
    """(tbl, row_key, msg_idx, posteriors array<double> by DEFECTS) of every pair with a defect."""
    spark = dialogues.sparkSession
    pairs = pair_rows(dialogues, responses)
    lang = language.fit(responses, F.col("locale"), F.concat_ws("\n", "message", "response"), F.col("resp_id"))
    voted = settle(_voted(pairs, lang, terminality.MAX_ENTRIES), "pair-votes")
    counted = voted.groupBy("code").count()
    per: list[Counter] = [Counter() for _ in DEFECTS]
    codes = counted.limit(MAX_PATTERNS + 1).collect()
    if len(codes) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} vote patterns")
    for r in codes:
        for c, v in zip(per, unpack(r["code"]), strict=True):
            c[v] += r["count"]
    models = [label_model(c) for c in per]
    found = [(r["code"], [m[v] for m, v in zip(models, unpack(r["code"]), strict=True)]) for r in codes]
    found = [(c, p) for c, p in found if max(p) >= CUTOFF]
    table = spark.createDataFrame(found, "code long, posteriors array<double>")
    return voted.join(F.broadcast(table), "code").drop("code")


def labels(found: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Every defect above the cutoff, one row each (several per pair are possible)."""
    zipped = F.explode(F.arrays_zip(F.array(*map(F.lit, DEFECTS)).alias("defect"), F.col("posteriors").alias("posterior")))
    return found.select("tbl", "row_key", "msg_idx", zipped.alias("z")).select("tbl", "row_key", "msg_idx", F.col("z.defect").alias("defect"), F.col("z.posterior").alias("posterior")).where(F.col("posterior") >= cutoff)


def single(found: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One defect per pair: the first in the order of DEFECTS above the cutoff."""
    first = F.coalesce(*[F.when(F.col("posteriors")[i] >= cutoff, F.lit(d)) for i, d in enumerate(DEFECTS)])
    return found.select("tbl", "row_key", "msg_idx", first.alias("defect"))
