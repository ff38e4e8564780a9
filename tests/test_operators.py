import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import lang, text
from corpusmill.operators import chunking, dedup, evaluation, retrieval, sampling, timeline, turns, vector_search
from corpusmill.operators.checks import CheckSet
from corpusmill.runtime import salted_join
from corpusmill.sources import files


def values(spark, f, rows):
    t = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["v"] for r in t.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_text_functions(spark):
    assert values(spark, text.squash, [" a \n\t b ", "", None]) == ["a b", "", None]
    assert values(spark, text.norm_key, [" ПриВет  Мир "]) == ["привет мир"]
    assert values(spark, lambda c: text.ellipsis(c, 5), ["abcdef", "abcde", "abc  xyz", None]) == ["abcd…", "abcde", "abc…", None]
    assert values(spark, lambda c: text.middle_collapse(c, 4), ["abcdefgh", "abcd"]) == ["ab\n…\ngh", "abcd"]
    assert values(spark, lambda c: text.until_stop(c, ["END", "\n\n"]), ["abENDc", "a\n\nbEND", "abc"]) == ["ab", "a", "abc"]
    assert values(spark, lambda c: text.until_stop(c, ["X"]), ["aXb", "ab"]) == ["a", "ab"]
    assert values(spark, text.tokens, ["Привет, мир! x_1", "", "..."]) == [["привет", "мир", "x_1"], [], []]
    assert values(spark, lambda c: text.ngrams(text.tokens(c), 2), ["a b c", "a", ""]) == [["a b", "b c"], [], []]
    assert values(spark, lambda c: text.char_bigrams(c), ["abab", "a", ""]) == [["ab", "ba"], [], []]
    assert values(spark, lambda c: text.guarded(c, "art"), ["Art.", "party", "моart", "x art y", None]) == [True, False, True, True, False]
    assert values(spark, text.window_hours, ["3 days", "1.5 weeks ago", "2 months", "soon", None]) == [72.0, 252.0, 1440.0, None, None]
    assert values(spark, text.strip_markdown, ["a ```x\ny``` b<br>c\n\n\n\nd"]) == ["a b c\n\nd"]
    assert values(spark, lambda c: text.count_of(c, "??"), ["a????b", "", None]) == [2, 0, 0]
    assert values(spark, lambda c: text.first_hit(c, ["b", "a"]), ["A b", "a", "c"]) == ["b", "a", None]


def test_sentence_variants(spark):
    rows = ["One. Two! Three", "", "...", "No end"]
    assert values(spark, text.sentences_by_marks, rows) == [3, 0, 0, 1]
    assert values(spark, text.sentences_by_gap, rows) == [3, 0, 1, 1]
    assert values(spark, text.sentences_closed, rows) == [2, 1, 1, 1]
    assert values(spark, text.sentences_spaced, rows) == [3, 0, 1, 1]


def test_jaccard_of_empty(spark):
    t = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in t.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5]


def test_language_rules(spark):
    rows = ["hello there", "привет как дела у тебя", "сәлем қалайсың", "12", "да ok", None, "漢字漢字漢字"]
    assert values(spark, lang.intent, rows)[:5] == ["en", "ru", "kk", None, "en"]
    assert values(spark, lang.with_kazakh, rows[:3]) == ["en", "ru", "kk"]
    assert values(spark, lang.cjk_drift, rows)[6] is True
    assert values(spark, lang.script_leak, ["привет one two three", "привет ok", "hello", "просто слова тут и там и ещё вот так ok"]) == ["run", "ratio", None, "any"]
    assert values(spark, lambda c: lang.resolve(c, F.lit(" KK ")), ["12", "hello"]) == ["kk", "en"]


def test_chatml_round_trip(spark):
    t = spark.createDataFrame([(1, [("user", "Привет\nмир"), ("assistant", "да?")]), (2, [("user", None)]), (3, [])], "id int, m array<struct<role:string,content:string>>")
    r = t.withColumn("x", turns.render_chatml(F.col("m"))).withColumn("back", turns.parse_chatml(F.col("x"))).orderBy("id").collect()
    assert [tuple(x) for x in r[0]["back"]] == [("user", "Привет\nмир"), ("assistant", "да?")]
    assert [tuple(x) for x in r[1]["back"]] == [("user", "")] and r[2]["back"] == []
    got = t.select(turns.last_of(F.col("m"), "assistant"), turns.first_of(F.col("m"), "user"), F.size(turns.with_system(F.col("m"), F.lit("s")))).collect()
    assert tuple(got[0]) == ("да?", "Привет\nмир", 3) and got[2][0] == ""


def test_turn_windows(spark):
    t = spark.createDataFrame([(1, [("user", "x" * 10), ("assistant", "y" * 20), ("user", "z" * 30)]), (2, None)], "id int, messages array<struct<role:string,content:string>>")
    e = turns.explode_turns(t, "id")
    assert e.count() == 3
    assert [r["turn"] for r in turns.last_turns(e, "id", 1).collect()] == [2]
    assert sorted(r["turn"] for r in turns.within_budget(e, "id", 50).collect()) == [1, 2]
    assert [r["turn"] for r in turns.within_budget(e, "id", 5).collect()] == [2]
    assert [(r["query"][0], r["reply"][0]) for r in turns.adjacent_pairs(e, "id").collect()] == [("x", "y")]
    assert [r["phase"] for r in turns.phase_by_count(e, "id").orderBy("turn").collect()] == ["open", "deepening", "deepening"]


def test_first_by_key_ties_and_clashes(spark):
    t = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, None, 1), (4, None, 0)], "id int, m string, o0 int")
    got = {tuple(r) for r in dedup.first_by_key(t, F.col("m"), [F.col("o0"), F.col("id")]).collect()}
    assert got == {(1, "a", 1), (4, None, 0)}
    assert {r["id"] for r in dedup.keep_per_key(t.fillna("", ["m"]), F.col("m"), [F.col("id")], 1).collect()} == {1, 2, 4}
    assert dedup.first_by_key(t.limit(0), F.col("m"), [F.col("id")]).count() == 0


def brute_greedy(ids, sim, t):
    kept = []
    for i in sorted(ids):
        if not any(sim(i, j) > t for j in kept):
            kept.append(i)
    return set(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_and_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    v = {i: rng.normal(size=4) for i in range(60)}
    v[60] = np.zeros(4)
    t = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()] + [(99, None)], "vec_id long, e array<double>")
    cos = lambda a, b: float(v[a] @ v[b] / max(np.linalg.norm(v[a]) * np.linalg.norm(v[b]), 1e-300))
    for block in (10, 1000):
        pairs = dedup.similar_pairs(t, "vec_id", "e", 0.8, block)
        assert {(r["id_a"], r["id_b"]) for r in pairs.collect()} == {(a, b) for a in v for b in v if a < b and cos(a, b) > 0.8}
    kept = {r["id"] for r in dedup.greedy_keep(t, pairs, "vec_id").collect()}
    assert kept == brute_greedy(v, cos, 0.8) | {99}


def test_top_k_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = {i: rng.normal(size=5) for i in range(80)}
    v[80] = v[10]  # a tie
    t = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()] + [(99, None)], "vec_id long, e array<double>")
    monkeypatch.setattr(vector_search, "BLOCK", 3)
    got = {(r["query_id"], r["id"], r["rank"]) for r in vector_search.top_k(t.where("vec_id % 10 = 0"), t, "vec_id", "e", 4).collect()}
    want = set()
    for q in (i for i in v if i % 10 == 0):
        s = sorted(((-round(float(v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i])), 9), i) for i in v if i != q))[:4]
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(s)}
    assert got == want
    assert vector_search.top_k(t.limit(0), t, "vec_id", "e", 4).count() == 0


def test_splits_and_quotas(spark):
    t = spark.createDataFrame([(i, "hot" if i % 3 else None, 7) for i in range(900)], "id long, s string, n int")
    split = sampling.stratified_split(t, "id", F.col("s"), 0.1)
    n = {(r["s"], r["split"]): r["count"] for r in split.groupBy("s", "split").count().collect()}
    assert n == {("hot", "val"): 60, ("hot", "train"): 540, (None, "val"): 30, (None, "train"): 270}
    q = spark.createDataFrame([("hot", 25)], "grp string, n int")
    got = sampling.quota(t, "id", F.col("s"), q)
    assert got.count() == 25 and "n" in got.columns
    h = sampling.hash_split(t, "id", 100).where("split = 'val'").count()
    assert 50 < h < 140
    assert sampling.oversample(t.limit(3), F.lit(2)).count() == 6
    assert sampling.stratified_split(t.limit(0), "id", F.col("s"), 0.1).count() == 0


def test_salted_join_spreads_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot") for i in range(100)] + [(200, "cool"), (300, "alone")], "id long, k string")
    groups = spark.createDataFrame([("hot", 5, "a"), ("cool", 1, "b")], "k string, n_salts int, v string")
    got = salted_join(rows, groups, ["k"], F.col("id"))
    assert got.count() == 101 and {r["v"] for r in got.where("k = 'hot'").collect()} == {"a"}


def test_chunks(spark):
    t = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100))), (2, "a b"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["start"]): len(r["chunk"].split()) for r in chunking.word_windows(t, "doc_id", "text", 40, 10, 15).collect()}
    assert got == {(1, 0): 40, (1, 30): 40, (1, 60): 40, (2, 0): 2}
    s = spark.createDataFrame([(1, "intro\n## A\nx\ny\n### B\nz")], "doc_id long, text string")
    assert [(r["section"], r["title"], r["n_lines"]) for r in chunking.sections(s, "doc_id", "text").orderBy("section").collect()] == [(0, None, 1), (1, "A", 3), (2, "B", 2)]
    p = spark.createDataFrame([(1, "a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "c" * 130), (2, None)], "doc_id long, text string")
    assert [len(r["body"]) for r in chunking.pack_paragraphs(p, "doc_id", "text", 62).orderBy("part").collect()] == [62, 62, 62, 6]


def test_bm25_against_formula(spark):
    docs = {1: "cat sat mat", 2: "cat cat dog", 3: "bird sang all day long", 4: ""}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame([("q", "cat dog")], "query_id string, text string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(d, q, "doc_id", "text").collect()}
    n, avg = 4, sum(len(t.split()) for t in docs.values()) / 4
    df = {}
    for t in docs.values():
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    want = {}
    for i, t in docs.items():
        ws = t.split()
        s = sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in ("cat", "dog") if w in ws)
        if s > 0:
            want[i] = s
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_fusion_and_sufficiency(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, id long, rank int")
    b = spark.createDataFrame([("q", 2, 1)], "query_id string, id long, rank int")
    assert {r["id"]: round(r["score"], 6) for r in retrieval.fuse([a, b]).collect()} == {1: round(1 / 61, 6), 2: round(1 / 62 + 1 / 61, 6)}
    s = [("a", 0.8, True, True), ("a", 0.79, True, True), ("a", 0.7, True, True), ("b", 0.65, True, True), ("c", 0.5, True, True), ("d", 0.9, False, True), ("e", 0.9, True, False)]
    got = {r["query_id"]: (r["state"], r["n_evidence"]) for r in retrieval.sufficiency(spark.createDataFrame(s, "query_id string, score double, consented boolean, recent boolean"), 0.78, 0.6).collect()}
    assert got == {"a": ("fully", 2), "b": ("partially", 1), "c": ("below_threshold", 0), "d": ("data_excluded_by_consent", 0), "e": ("no_data_in_window", 0)}


def test_check_order_and_nulls(spark):
    t = spark.createDataFrame([(1, None), (2, "ab"), (3, "abcdef?")], "i int, t string")
    c = CheckSet(("SHORT", F.length("t") < 3), ("ASKS", F.contains("t", F.lit("?"))), ("ANY", F.lit(None).cast("boolean")))
    assert [(r["failed"], r["passed"]) for r in c.apply(t).orderBy("i").collect()] == [(None, True), ("SHORT", False), ("ASKS", False)]
    assert [r[0] for r in t.orderBy("i").select(c.failures()).collect()] == [[], ["SHORT"], ["ASKS"]]


def test_evaluation(spark):
    t = spark.createDataFrame([("a", "en", True), ("a", "ru", False), (None, "en", True)], "cluster string, locale string, passed boolean")
    got = {(r["cluster"], r["gid"]): (r["total"], r["n_passed"]) for r in evaluation.pass_rates(t, [[], ["cluster"]]).collect()}
    assert got[(None, 1)] == (3, 2) and got[("a", 0)] == (2, 1) and got[(None, 0)] == (1, 1)
    x = spark.createDataFrame([(1, True), (2, False)], "id int, passed boolean")
    y = spark.createDataFrame([(2, True), (3, True)], "id int, passed boolean")
    assert {r["id"]: r["change"] for r in evaluation.full_compare(x, y, ["id"]).collect()} == {1: "broken", 2: "fixed", 3: "fixed"}


def test_timeline(spark):
    import datetime as dt

    e = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, h), 1, k, float(h)) for i, (h, k) in enumerate([(0, "a"), (1, "b"), (5, "b"), (6, "a")])], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    steps = timeline.adjacent(e, "user_id", ["ts", "event_id"], "event_type")
    assert {(r["from"], r["to"], r["hours"]) for r in steps.collect()} == {("a", "b", 1.0), ("b", "a", 1.0)}
    edges = spark.createDataFrame([("a", "b", 2.0, 5.0)], "`from` string, `to` string, min_hours double, max_hours double")
    assert {(r["from"], r["verdict"]) for r in timeline.validate_transitions(steps, edges).collect()} == {("a", "too_fast"), ("b", "no_edge")}
    assert [r["n"] for r in timeline.sessions(e, "user_id", 90).orderBy("session").collect()] == [2, 2]
    m = spark.createDataFrame([([1.0, 2.0, 3.0],), ([3.0, 1.0],), ([1.0, 1.0],), ([1.0],)], "v array<double>")
    assert [r[0] for r in m.select(timeline.monotone(F.col("v"))).collect()] == ["rising", "falling", "mixed", None]


def test_levenshtein_query_against_brute_force(spark):
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    rng = random.Random(5)
    pairs = [("".join(rng.choice("абвab") for _ in range(rng.randrange(9))), "".join(rng.choice("абвab") for _ in range(rng.randrange(9)))) for _ in range(40)]
    t = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in t.select(F.levenshtein("a", "b")).collect()] == [slow(a, b) for a, b in pairs]


# --- sources ---
def test_json_readers(spark, tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    (d / "a.jsonl").write_text('{"id": 1, "t": "привет"}\n\n{bad\n{"id": 2, "t": null}\n', encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_text("no")
    good, bad = files.read_jsonl_lenient(spark, str(d), "id int, t string")
    assert {r["id"] for r in good.collect()} == {1, 2} and [r[0] for r in bad.collect()] == ["{bad"]
    with pytest.raises(Exception):
        files.read_jsonl_strict(spark, str(d), "id int, t string").collect()
    (d / "a.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": 2, "t": "y", "more": 1}\n', encoding="utf-8")
    assert files.read_directory(spark, str(tmp_path / "in"), "id int, t string").count() == 2
    assert [r["id"] for r in files.read_strict_keys(spark, str(d), "id int, t string").collect()] == [1]
    (tmp_path / "x.json").write_text(json.dumps([{"id": 7, "t": "a"}]))
    assert files.read_json_array(spark, str(tmp_path / "x.json"), "id int, t string").first()["id"] == 7


def test_sinks_and_resume(spark, tmp_path):
    t = spark.createDataFrame([(i, "й") for i in range(10)], "id long, t string").coalesce(1)
    files.write_jsonl(t, str(tmp_path / "o"), rows_per_file=4)
    parts = sorted((tmp_path / "o").glob("part-*"))
    assert len(parts) == 3 and "й" in parts[0].read_text(encoding="utf-8")
    assert files.append_unseen(t.where("id < 6"), str(tmp_path / "p"), "id").count() == 6
    files.append_unseen(t, str(tmp_path / "p"), "id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 10
    assert files.report_markdown(t.limit(1), "T").splitlines()[2] == "| id | t |"
    with pytest.raises(ValueError):
        files.report_markdown(t, "T", 3)


def test_books_markdown_and_salvage(spark, tmp_path):
    (tmp_path / "one.md").write_text("# Title\n\nbody")
    (tmp_path / "_draft.md").write_text("# No")
    (tmp_path / "README.md").write_text("# No")
    assert [(r["file"], r["title"]) for r in files.read_markdown(spark, str(tmp_path)).collect()] == [("one.md", "Title")]
    b = tmp_path / "b"
    b.mkdir()
    (b / "x.fb2").write_text("<FictionBook><description>d</description><body><p>Привет</p><p>мир &amp; всё</p></body></FictionBook>", encoding="utf-8")
    (b / "y.doc").write_bytes(b"\x00")
    assert [r["body"].split("\n")[0].strip() for r in files.read_books(spark, str(b)).collect()] == ["Привет"]
    assert files.salvage_objects('x ```json\n{"a": "}"} y {"b": {"c": 1}}``` {bad}') == ['{"a": "}"}', '{"b": {"c": 1}}']
    t = spark.createDataFrame([(1, 'ok {"a": 1} {"a": 2}'), (2, None), (3, "none")], "id long, t string")
    assert sorted((r["id"], r["a"]) for r in files.salvage_json(t, "id", "t", "a int").collect()) == [(1, 1), (1, 2)]


def test_unify_messages(spark):
    m = "array<struct<role:string,content:string>>"
    t = spark.createDataFrame([(None, [("user", "c")], None), ([("user", "m")], None, None), (None, None, "<|im_start|>user\nt<|im_end|>")], f"messages {m}, conversations {m}, text string")
    assert [r["messages"][0]["content"] for r in files.unify_messages(t).collect()] == ["c", "m", "t"]


def test_consensus_against_pairs(spark):
    rng = np.random.default_rng(6)
    v = {i: rng.normal(size=3) for i in range(12)}
    v[12] = v[3]  # a tie of centrality
    t = spark.createDataFrame([(i, "a" if i != 5 else "lone", x.tolist()) for i, x in v.items()], "vec_id long, label string, e array<double>")
    got = {r["label"]: (r["consensus"], r["chosen"]) for r in retrieval.consensus(t, "label", "vec_id", "e").collect()}
    u = {i: x / np.linalg.norm(x) for i, x in v.items() if i != 5}
    mean = {i: np.mean([u[i] @ u[j] for j in u if j != i]) for i in u}
    assert abs(got["a"][0] - np.mean(list(mean.values()))) < 1e-9
    assert got["a"][1] == min(u, key=lambda i: (-round(mean[i], 9), i))
    assert got["lone"] == (None, 5)


def test_slots_and_bucket_rank(spark):
    t = spark.createDataFrame([(i, "a" if i % 4 else None) for i in range(200)], "doc_id long, lang string")
    got = {(r["doc_id"]): r["slot"] for r in sampling.slots(t, "doc_id", F.col("lang"), width=7).collect()}
    for g in (lambda i: i % 4, lambda i: not i % 4):
        assert [got[i] for i in range(200) if g(i)] == list(range(1, sum(map(bool, map(g, range(200)))) + 1))
