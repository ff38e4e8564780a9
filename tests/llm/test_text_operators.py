import pytest

from corpusmill.llm import leakage, pairs, residue, terminality, truncation
from corpusmill.llm.language import CLAUSE_WORDS, fit, label_rows, romanise
from pyspark.sql import functions as F


# --- problem 1 ---
@pytest.mark.parametrize(
    "text",
    [
        "Привет, {{name}}!", "Hi [add reason]!", "Dear ${user},", "Здравствуй, ИМЯ_ПОЛЬЗОВАТЕЛЯ", "Lorem ipsum dolor", "502 Bad Gateway", "<html><head><title>x</title>", "Please enable JavaScript to continue.",
        "Feltuma norfelus oraora emquisa oramitus perfelus rudsula darperis.", "Our server is currently overloaded.", "Sorry, this site is not available.", "Запрос отклонён: слишком много запросов.", "Соединение сброшено.", "Байланыс үзілді.",
        "В вашем браузере отключены скрипты.", "Traceback (most recent call last):", "asdf asdf asdf", "TODO: write the reply (3)", "Доступ запрещён.", "[object Object]", "Hello undefined", "%(topic)s", "Ваш текст здесь",
    ],
)
def test_residue_is_labelled(text):
    assert residue.label(text)


@pytest.mark.parametrize(
    "text",
    [
        "Учу JavaScript по ночам и ничего не успеваю.", "Ошибка 500 на сервере — не твоя вина.", "[вздыхает] Ну вот так.", "Уверенность упала на 90%, честно.", "They answered with a template and left out my name.",
        "Сервер в голове будто недоступен.", "Access to rest is not denied to you.", "Доступ к этой радости не закрыт навсегда.", "The page of my life where he was not found is turned.", "My mama has a panda, a koala and a gorilla.", "I <3 you", "", None, "...", "null", "[ВЗДЫХАЕТ] НУ ВОТ ТАК И ЖИВЁМ.",
    ],
)
def test_talk_about_such_things_is_none(text):
    assert residue.label(text) is None


def test_residue_messages_propagate_and_keep_keys(spark):
    rows = [
        (1, 0, "Всё хорошо. Сервис временно недоступен, повторите запрос позже."), (2, 0, "Спокойной ночи"), (3, 0, None), (4, 0, ""), (5, 1, "Please, enable JAVASCRIPT to continue"),
        (5, 1, "Please, enable JAVASCRIPT to continue"), (6, 0, "x " * 50_000 + "{first_name}"),
    ]
    t = spark.createDataFrame(rows, "h long, seg int, text string")  # names that clash with the operator's own
    got = {(r["h"], r["seg"]) for r in residue.residue_messages(t).collect()}
    assert got == {(1, 0), (5, 1), (6, 0)}
    assert residue.residue_messages(t.limit(0)).count() == 0


def test_simhash_of_near_sentences():
    a, b, c = residue.simhashes([residue.words("connection reset by the remote side ref 1a2"), residue.words("connection reset by the remote side ref 9f"), residue.words("тебе не нужно доказывать")])
    assert a == b and bin(int(a) ^ int(c)).count("1") > residue.HAMMING


SERVICE_LINES = [
    "our gateway had a problem while it was reading the long reply of the upstream model today: 502 bad gateway", "sorry for the wait, the page was not found on this site or its address is out of date by now",
    "this service is temporarily unavailable because of planned works on the line, please come back in the evening", "you need to enable javascript in the settings of your browser in order to read the rest of this page",
    "к сожалению, сервис временно недоступен из-за плановых работ на линии, зайдите к нам снова сегодня вечером", "для просмотра остальной части этой страницы вам нужно включить javascript в настройках вашего браузера",
    "please replace before release this sample line that the editors left here for the next version of the form", "кешіріңіз, желідегі жоспарлы жұмыстарға байланысты бұл қызмет уақытша қолжетімсіз, кешке қайта кіріп көріңіз",
]
SPOILT = [("502", "five"), ("bad", "bat"), ("found", "fount"), ("unavailable", "unavailible"), ("javascript", "javascrypt"), ("недоступен", "недоступин"), ("before", "befor"), ("қолжетімсіз", "қолжетмсіз")]


def test_propagation_finds_what_no_pattern_does(spark):
    """Wordings that escape the patterns are found through their near-duplicates, and only so."""
    import random

    rng = random.Random(1)
    rows, spoilt = [(i, x) for i, x in enumerate(SERVICE_LINES)], set()
    for k in range(80):
        ws = SERVICE_LINES[k % 8].split()
        for old, new in SPOILT:
            ws = [w.replace(old, new) for w in ws]
        if k >= 8:
            ws[rng.randrange(len(ws))] = rng.choice(["indeed", "также", "әрі"])  # now and then only near a spoilt one
        if residue.label(" ".join(ws)) is None:
            spoilt.add(100 + k)
        rows.append((100 + k, " ".join(ws)))
    rows += [(500 + i, x) for i, x in enumerate(["thank you for the long and quiet evening at the river", "учу javascript по ночам и ничего не успеваю", "the server in my head is down today and i can not sleep"])]
    t = spark.createDataFrame(rows, "k long, text string")
    without = {r["k"] for r in residue.residue_messages(t, propagate=False).collect()}
    with_ = {r["k"] for r in residue.residue_messages(t).collect()}
    assert len(spoilt) > 60 and not spoilt & without
    assert len(spoilt & with_) >= 0.95 * len(spoilt) and max(with_) < 500


def test_blocks_give_the_same_labels(spark, monkeypatch):
    lines = [(i, x) for i, x in enumerate(SERVICE_LINES)] + [(20 + i, x.replace("502 bad", "502 bat").replace("not found", "not fount").replace("недоступен", "недоступин")) for i, x in enumerate(SERVICE_LINES)]
    t = spark.createDataFrame(lines, "k long, text string")
    want = sorted(tuple(r) for r in residue.residue_messages(t).collect())
    monkeypatch.setattr(residue, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in residue.residue_messages(t).collect()) == want


def test_label_spreads_through_components(spark):
    base = "our gateway had a problem while it was reading the long reply of the upstream model today: 502 bad gateway"
    near = base.replace("502 bad gateway", "502 bad gatewey")
    t = spark.createDataFrame([(1, base), (2, near), (3, "спасибо за доверие, это было непросто сказать вслух")], "k long, text string")
    assert {r["k"] for r in residue.residue_messages(t).collect()} == {1, 2}


def test_label_spreads_to_near_sentences(spark):
    base = "our gateway had a problem while it was reading the reply of the upstream: 502 bad gateway"
    near = [base.replace("bad gateway", "bad gatewey"), base.replace("bad gateway", "bad gatewey").replace("problem", "fault")]  # the second by way of the first too
    t = spark.createDataFrame([(1, base), (2, near[0]), (3, near[1]), (4, "thank you for the long and quiet evening")], "k long, text string")
    assert {r["k"] for r in residue.residue_messages(t).collect()} == {1, 2, 3}


def test_notice_within_real_talk_does_not_spread(spark):
    """Near-copies of the talk around a notice are none, neither at the first step nor further on; the notice's own variants are."""
    talk = "в прошлый {} утром в библиотеке мы опять поругались с {} из-за {} и вечером я думаю только про долгий переезд на север"
    days, who, why = ("вторник", "четверг", "понедельник"), ("соседкой", "бригадиром", "врачом"), ("собаки", "тетради", "кофе")
    lines = [talk.format(d, w, y) for d in days for w in who for y in why]
    notices = ["502 bad gateway", "включите cookies и сценарии", "сервис временно недоступен"]
    rows = [(i, x) for i, x in enumerate(lines)] + [(100 + i, f"{lines[i]} {x}") for i, x in enumerate(notices)] + [(200, " ".join(lines[5].split()[:-2]) + " connection reset")]
    rows.append((300, f"{lines[0]} 502 bad gatewey"))
    got = {r["k"] for r in residue.residue_messages(spark.createDataFrame(rows, "k long, text string")).collect()}
    assert got == {100, 101, 102, 200, 300}


def test_turns_of_seeds_give_the_same_labels(spark, monkeypatch):
    lines = [(i, x) for i, x in enumerate(SERVICE_LINES)] + [(20 + i, x.replace("502 bad", "502 bat").replace("not found", "not fount").replace("недоступен", "недоступин")) for i, x in enumerate(SERVICE_LINES)]
    t = spark.createDataFrame(lines, "k long, text string")
    want = sorted(tuple(r) for r in residue.residue_messages(t).collect())
    monkeypatch.setattr(residue, "BROADCAST_ROWS", 30)
    assert sorted(tuple(r) for r in residue.residue_messages(t).collect()) == want and len(want) == len(lines)


def test_prefixes_meet_whenever_sentences_are_near():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    tried = 0
    for _ in range(4000):
        a = [rng.choice("ab cd efg hij klmn o p q1".split()) for _ in range(rng.randrange(3, 21))]
        b = list(a)
        for _ in range(rng.randrange(1, 6)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([["new"], [], [b[k], "more"]]) or ["x"]
        if SequenceMatcher(None, a, b, autojunk=False).ratio() >= residue.SIMILAR:
            tried += 1
            assert set(residue.prefix(a)) & set(residue.prefix(b))
    assert tried > 1000


# --- problem 8 ---
PASSAGE = "the calendar got stuck on 19 while a boat without oars waits in the kitchen today"


def test_leaks_exact_and_reparameterised(spark):
    docs = spark.createDataFrame(
        [(1, f"Intro. {PASSAGE.upper()}, and more"), (2, f"x {PASSAGE.replace('19', '23')} y"), (3, " ".join(PASSAGE.split()[:11])), (4, None), (5, ""), (6, "a​ " * 3 + PASSAGE.replace(" ", "\n"))],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([("i1", PASSAGE), ("i2", None), ("i3", "short one")], "id string, message string")
    got = {(r["doc_id"], r["item_id"]): (r["exact"], r["reparameterised"]) for r in leakage.leaks(docs, items).collect()}
    assert got == {(1, "i1"): (True, False), (2, "i1"): (False, True), (6, "i1"): (True, False)}
    assert leakage.leaks(docs.limit(0), items).count() == 0
    assert leakage.leaks(docs, items.limit(0)).count() == 0


TALE = "Yesterday my friend {0} told me that {1} people came to the old library and {2} waited near the door for half an hour until {0} went home"


def test_names_are_slots_by_form_on_both_paths(spark, monkeypatch):
    """No item holds the names that the documents put in."""
    docs = [
        (1, "So: " + TALE.format("Aliya", 14, "Marat")), (2, TALE.format("Zhanna", 71, "Gulnar")), (3, TALE.format("Zhanna", 14, "Marat").replace("until Zhanna", "until Aliya")),
        (4, TALE.format("Aliya", 14, "Marat").upper()), (5, TALE.format("Zhanna", 14, "Zhanna")), (6, "nothing here"), (7, TALE.format("Zhanna", 71, "Gulnar") + ". " + TALE.format("Aliya", 14, "Marat")),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([("i1", TALE.format("Aliya", 14, "Marat")), ("i2", "another text of more than twelve words that no document of these has in it at all")], "id string, message string")

    def found():
        return sorted(tuple(r) for r in leakage.leaks(docs, items).collect())

    small = found()
    got = {r[0]: r[2:4] for r in small}
    assert got[1] == (True, False) and got[4] == (True, False) and got[2][1] and got[7] == (True, True)
    # 3: one name goes to two values; 5: two names go to one value, which each window still maps.
    assert 3 not in got or not got[3][1]
    assert 6 not in got and {r[1] for r in small} == {"i1"}
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    assert found() == small
    monkeypatch.setattr("corpusmill.runtime.ROWS_PER_SALT", 1)
    assert found() == small


def test_templates_against_brute_force(spark):
    import random

    rng = random.Random(8)
    pool = "we met at noon near old bridge with red boat 12 30 Aliya Marat Dana Olzhas days hours".split()
    text = lambda n: "and " + " ".join(rng.choice(pool) for _ in range(n))
    items = [(f"i{k}", text(18)) for k in range(6)]
    docs = []
    for k in range(60):
        ws = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            swap = rng.choice([("12", "44"), ("Aliya", "Saule"), ("Marat", "Dana"), ("days", "weeks"), ("boat", "ship")])
            ws = [swap[1] if w == swap[0] else w for w in ws]
        docs.append((k, " ".join(ws) + " end"))

    def template(words, names):
        return tuple("#" if any(c.isdigit() for c in w) else "u" if w in leakage.UNITS else "N" if w in names else w for w in words)

    want = set()
    for d, x in docs:
        for i, y in items:
            wx, wy = leakage.words(x), leakage.words(y)
            for shift in range(-len(wy), len(wx)):
                pairs, exact, n = set(), False, 0
                for names_x, names_y in ((set(), set()), (leakage.names(x), leakage.names(y))):
                    tx, ty = template(wx, names_x), template(wy, names_y)
                    for q in range(len(wy) - 11):
                        p = q + shift
                        if 0 <= p <= len(wx) - 12 and tx[p : p + 12] == ty[q : q + 12]:
                            n += 1
                            exact |= wx[p : p + 12] == wy[q : q + 12]
                            pairs |= {(b, a) for a, b, t in zip(wx[p : p + 12], wy[q : q + 12], tx[p : p + 12], strict=True) if t in "#uN"}
                if n and (exact or len(pairs) == len({b for b, _ in pairs})):
                    want.add((d, i))
    made = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "id string, message string"))
    assert {(r["doc_id"], r["item_id"]) for r in made.collect()} == want and len(want) > 20


# --- problem 6 ---
EN = "this is a plain sentence about the long day and the quiet evening at home with my sister"
RU = "это простое предложение про длинный день и тихий вечер дома с моей сестрой и ещё про работу"
KK = "бұл ұзақ күн мен тыныш кеш туралы қарапайым сөйлем және менің әпкем үйде отыр деген әңгіме"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, k, t) for i, (k, t) in enumerate([("en", EN), ("RU", RU), ("kk_KZ", KK), ("xx", RU), (None, EN)] * 20)]
    t = spark.createDataFrame(rows, "id long, lang string, text string")
    return fit(t, F.col("lang"), F.col("text"), F.col("id"))


def test_languages(spark, model):
    mixed = "this is a plain sentence about the long day и ещё про работу дома с моей сестрой"
    rows = [(1, [EN]), (2, [RU]), (3, [KK]), (4, [mixed]), (5, [romanise(RU)]), (6, [None, ""]), (7, None), (8, [RU + " «evening»"]), (9, ["123 ..."])]
    t = spark.createDataFrame(rows, "id long, texts array<string>")
    got = {r["id"]: [x["lang"] for x in r["langs"]] for r in label_rows(t, "id", F.col("texts"), model).collect()}
    assert got[1] == ["en"] and got[2] == ["ru"] and got[3] == ["kk"] and set(got[4]) == {"en", "ru"}
    assert got[5] == ["ru"] and got[6] == [] and got[7] == [] and got[8] == ["ru"] and got[9] == []


def test_short_sentences_count_and_borrowed_words_do_not(model):
    told = "this is a plain sentence about the long day. дома с сестрой. and the quiet evening at home with my sister."
    assert {k for k, *_ in model.languages([told])} == {"en", "ru"}
    borrowed = "this is a plain sentence about дома с the long day and the quiet evening at home with my sister."
    assert [k for k, *_ in model.languages([borrowed])] == ["en"]
    assert [k for k, *_ in model.languages(["дома с сестрой", None, ""])] == ["ru"]


def test_held_out_accuracy(model):
    held = {"en": "my sister and the evening at home", "ru": "вечер дома с моей сестрой", "kk": "менің әпкем үйде отыр"}
    assert all(model.languages([t])[0][0] == k for k, t in held.items())
    assert CLAUSE_WORDS > 3


# --- problem 5 ---
def test_pair_votes():
    ends = terminality.Terminality({}, {})
    best = {"fear": "en", "страх": "ru"}.get
    votes = lambda q, a: dict(zip(pairs.DEFECTS, pairs.unpack(pairs.votes(q, a, best, ends)), strict=True))
    for a in (None, "", " \n", "—", "null", "N/A", "​", "..."):
        got = votes("How are you?", a)["empty"]
        assert got[0] == 1 and -1 not in got
    assert votes("q", "Извини, я не могу помочь с этим запросом.")["refusal"] == (1, 1, 1)
    assert votes("q", "Я не могу обещать, что завтра станет легче, но рядом побуду.")["refusal"][0] == -1
    q = "I keep thinking about the quarrel with my sister in the kitchen"
    assert votes(q, "You ask: «" + q + "»")["copies_question"] == (1, 1, 1)
    assert votes(q, "It makes sense that the quarrel with my sister hurt; what happened before it began that evening?")["copies_question"][0] == -1


def test_lcs_against_brute_force():
    import itertools

    def slow(a, b):
        return max((len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if _sub(c, b)), default=0)

    def _sub(c, b):
        it = iter(b)
        return all(x in it for x in c)

    for a, b in itertools.product([list(x) for x in ("", "ab", "abca", "bcab", "aabb")], repeat=2):
        assert pairs.lcs(a, b) == slow(a, b)


def test_defects_on_labelled_pairs(spark):
    """Precision and recall of each defect on generated pairs whose defect is known, at the cutoff in use."""
    import random

    rng = random.Random(12)
    say = {
        "en": ("my sister called late and the kitchen was quiet|what would help you rest this evening|the road home from work was long today|we can look at the letter together tomorrow|it makes sense that the noise kept you awake|you noticed the change before the others did", "I cannot help with this request."),
        "ru": ("сестра позвонила поздно и на кухне было тихо|что поможет тебе отдохнуть сегодня вечером|дорога домой с работы была длинной|завтра мы вместе посмотрим на это письмо|понятно что шум не давал тебе уснуть|ты заметил перемену раньше остальных", "Извини, я не могу помочь с этим запросом."),
        "kk": ("әпкем кеш қоңырау шалды да ас үй тыныш болды|бүгін кешке саған демалуға не көмектеседі|жұмыстан үйге дейінгі жол ұзақ болды|ертең біз бұл хатты бірге қараймыз|шу саған ұйықтауға мүмкіндік бермегені түсінікті|сен өзгерісті басқалардан бұрын байқадың", "Кешір, бұл туралы жауап бере алмаймын."),
    }
    said = {k: v[0].split("|") for k, v in say.items()}
    text = lambda k, of=slice(3, 6): ". ".join(s.capitalize() for s in rng.sample(said[k][of], 3)) + "."
    rows, want = [], {}
    for i in range(900):
        k = rng.choice(list(said))
        q, a, defect = text(k, slice(3)), text(k), None
        if i % 3 == 0:
            defect = rng.choice(pairs.DEFECTS)
            a = {
                "empty": lambda: rng.choice([None, "", "—", "..."]), "copies_question": lambda: rng.choice([q, q.lower(), q.upper()]), "other_language": lambda: text(rng.choice([x for x in said if x != k])),
                "refusal": lambda: say[k][1], "truncated": lambda: " ".join(a.split()[:-2])[:-1],
            }[defect]()
            want[i] = defect
        rows.append((i, k, q, a))
    resp = spark.createDataFrame(rows, "resp_id long, locale string, message string, response string")
    dial = spark.createDataFrame([], "rec_id long, messages array<struct<role:string,content:string>>")
    got = {r["row_key"]: r["defect"] for r in pairs.single(pairs.defects(dial, resp)).collect()}
    for defect in pairs.DEFECTS:
        true, found = {i for i, d in want.items() if d == defect}, {i for i, d in got.items() if d == defect}
        assert len(true & found) >= 0.95 * len(true) and len(true & found) >= 0.98 * len(found), (defect, len(true), len(found), len(true & found))


def test_label_model_finds_rare_class():
    patterns = {(-1, -1, -1): 9000, (1, 1, 1): 80, (1, 0, 1): 20, (-1, 1, -1): 300, (-1, 0, -1): 600}
    post = pairs.label_model(patterns)
    assert post[(1, 1, 1)] > 0.9 and post[(1, 0, 1)] > 0.9 and post[(-1, 1, -1)] < 0.1 and pairs.label_model({}) == {}
    assert max(pairs.label_model({(-1, -1, -1): 100}).values()) < 0.1


def test_defects_over_tables(spark):
    say = "Мне важно понять, что было вечером дома и почему стало так трудно говорить."
    d = [(i, [("user", f"Расскажи про день {i} и про вечер дома."), ("assistant", say)]) for i in range(60)]
    d += [(100, [("user", "Как быть?"), ("assistant", None)]), (101, [("user", "Как быть?"), ("assistant", "{{name}}")]), (102, None), (103, [("assistant", "a")])]
    e = [(i, "ru", "Что делать вечером дома?", say) for i in range(60)] + [(200, None, None, None), (201, "ru", "Что делать вечером?", "")]
    dial = spark.createDataFrame(d, "rec_id long, messages array<struct<role:string,content:string>>")
    resp = spark.createDataFrame(e, "resp_id long, locale string, message string, response string")
    got = {(r["tbl"], r["row_key"]): r["defect"] for r in pairs.single(pairs.defects(dial, resp)).collect()}
    assert got[("v12_ru_dialogues", 100)] == "empty" and got[("endpoint_baseline", 200)] == "empty" and got[("endpoint_baseline", 201)] == "empty"
    assert ("v12_ru_dialogues", 101) not in got and ("v12_ru_dialogues", 5) not in got
    assert pairs.defects(dial.limit(0), resp.limit(0)).count() == 0


def test_defects_do_not_depend_on_the_size_of_the_model(spark, monkeypatch):
    """With more sentence ends than a task may hold, every pair still gets the posteriors of the whole model."""
    import random

    rng = random.Random(6)
    bank = "мы вчера долго гуляли у тихой реки и всё-таки говорили о доме ещё 12 we walked slowly home and talked about the well-known quiet garden all evening тихо домой garden".split()
    whole = [" ".join(rng.choice(bank) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    said = [". ".join(rng.choices(whole, k=rng.randrange(1, 5))) + rng.choice([".", "", "…", " [...]", ",", "!"]) for _ in range(300)]
    said += [t[: rng.randrange(1, len(t) + 1)] for t in said] + [None, "", "—", "home", "ho", "We wal", "null", "Sorry, I cannot help with this request", "{{name}} we walked"] + ["We walked slowly ho"] * 4
    asked = [rng.choice(whole) for _ in said]
    asked[5:60:5] = ["{{name}}"] * 11
    e = [(i, rng.choice(["ru", "en"]), q, a) for i, (q, a) in enumerate(zip(asked, said, strict=True))]
    resp = spark.createDataFrame(e + e[:40], "resp_id long, locale string, message string, response string")
    dial = spark.createDataFrame([(7, [("user", "Как быть?"), ("assistant", "We walked slowly ho")])], "rec_id long, messages array<struct<role:string,content:string>>")

    def found():
        return sorted((r["tbl"], r["row_key"], r["msg_idx"], tuple(round(x, 9) for x in r["posteriors"])) for r in pairs.defects(dial, resp).collect())

    want = found()
    cut = pairs.DEFECTS.index("truncated")
    n_open = sum(bool(pairs.asked(r[3], pairs.words(r[3]))) for r in e)
    assert 20 < sum(r[3][cut] >= pairs.CUTOFF for r in want) < n_open - 20  # some open answers are cut, some not
    monkeypatch.setattr(terminality, "MAX_ENTRIES", 10)
    assert found() == want


# --- problem 10 ---
FULL = ["The diary shows at which hour the fear is strongest. Notice what happens in the chest before a difficult sentence.", "Repeat the pause seven times and mark what grew quieter. The body is a pointer rather than an enemy."]


def test_truncation(spark):
    long = " ".join(FULL)
    docs = [(i, t, "x") for i, t in enumerate(FULL * 5)] + [
        (100, FULL[0][:-9], "x"), (101, FULL[1][:70], "x"), (102, FULL[0] + "\n#fear #calm", "x"), (103, None, "x"), (104, "", "x"), (105, FULL[1] + " 🙂", "x"), (106, "Notice what happens in the [...]", "x"), (107, long[:-12], "x"), (108, long, "x"), (109, long, "x"),
    ]
    t = spark.createDataFrame(docs, "doc_id long, text string, h string")
    got = {r["doc_id"] for r in truncation.truncated(t).collect()}
    assert {100, 101, 106, 107} <= got and not got & {0, 1, 102, 103, 104, 105, 108, 109}
    assert truncation.truncated(t.limit(0)).count() == 0


def test_verdicts_do_not_depend_on_the_size_of_the_model(spark, monkeypatch):
    """With more entries than a task may hold, every text is still judged by all counts."""
    import random

    rng = random.Random(5)
    bank = "мы вчера долго гуляли у тихой реки и говорили о доме we walked slowly home and talked about the quiet garden all evening тихо домой garden".split()
    whole = [" ".join(rng.choice(bank) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = [". ".join(rng.choices(whole, k=rng.randrange(1, 5))) + rng.choice([".", "", "…", " [...]", ",", "!"]) for _ in range(300)]
    texts += [t[: rng.randrange(1, len(t) + 1)] for t in texts] + [None, "", "—", "- item", "home", "ho", "we wal"] + ["до встречи у реки"] * 4
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def found():
        return sorted(tuple(r) for r in truncation.truncated(t).collect())

    want = found()
    monkeypatch.setattr(terminality, "MAX_ENTRIES", 10)
    assert found() == want and len(want) > 50


def test_aligned_ends():
    a = " ".join(f"w{i}" for i in range(60))
    assert truncation.ends_early(a[: a.index("w57")] + "w5", a)
    assert not truncation.ends_early(a, a)
    assert not truncation.ends_early("w1 w2", a)


def test_min_hash_bands_find_near_copies():
    a = [f"w{i}" for i in range(200)]
    assert set(truncation.bands(a)) & set(truncation.bands(a[:-8])) and truncation.bands(["a"]) == []


def test_cut_copy_meets_its_original_among_longer_siblings(spark):
    shared = " ".join(f"w{i}" for i in range(100))
    original = f"{shared} gamma lambda"
    docs = [(0, original.rsplit(" ", 1)[0]), (1, original + ".")] + [(10 + i, f"{shared} z{i} " + " ".join(f"y{i}x{k}" for k in range(5)) + ".") for i in range(20)]
    t = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in truncation.truncated(t).where("aligned").collect()} == {0}
