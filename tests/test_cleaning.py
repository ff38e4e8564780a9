import hashlib

from pyspark.sql import functions as F

from corpusmill.operators import cleaning, rules
from corpusmill.operators.rules import Rule, RuleSet


def values(spark, f, rows):
    t = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["v"] for r in t.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_clean_chain(spark):
    rows = ["Assistant: да  да да да !!!!", "a ,b.....\n\n\n\nc", "про́сто", "", None, "ok ok fine"]
    assert values(spark, cleaning.clean_chain, rows) == ["да!!", "a,b...\n\nc", "просто", "", None, "ok ok fine"]


def test_complete_head(spark):
    long = "This sentence is closed and long enough. But this one is"
    assert values(spark, cleaning.complete_head, [long, "Short. But", "no end", None]) == ["This sentence is closed and long enough.", "Short. But", "no end", None]


def test_thinking(spark):
    t = spark.createDataFrame([(["<t>", "a", "</t>", "b", "c"],), (["<t>", "a"],), (["x"],), ([],), (["a", "</t>", "b", "</t>", "c"],)], "t array<string>")
    assert [r[0] for r in t.select(cleaning.answer_after_thinking(F.col("t"), "<t>", "</t>")).collect()] == [["b", "c"], [], ["x"], [], ["c"]]


def test_latin_leaks(spark):
    assert values(spark, cleaning.strip_latin_leaks, ["это очень burnout (very bad) чувство, да, и оно всё никак не проходит", "hello", "да one two", None]) == ["это очень чувство, да, и оно всё никак не проходит", "hello", None, None]


def test_stable_pick_against_python(spark):
    rows = [f"seed-{i}" for i in range(30)]
    want = [int(hashlib.sha256(r.encode()).hexdigest(), 16) % 11 for r in rows]
    assert values(spark, lambda c: cleaning.stable_pick(c, 11), rows) == want


def test_nfkc(spark):
    assert values(spark, cleaning.nfkc, ["ﬁ​ x　y", None, ""]) == ["fi x y", None, ""]


def test_lcg_split_is_a_permutation(spark):
    assert sorted(cleaning.lcg_order(50, 7)) == list(range(50)) and cleaning.lcg_order(50, 7) == cleaning.lcg_order(50, 7)
    t = spark.createDataFrame([(i, "warm" if i % 2 else None) for i in range(40)], "doc_id long, tone string")
    n = {(r["tone"], r["split"]): r["count"] for r in cleaning.lcg_split(t, "doc_id", "tone").groupBy("tone", "split").count().collect()}
    assert n == {("warm", "val"): 2, ("warm", "train"): 18, (None, "val"): 2, (None, "train"): 18}


def test_overlay(spark):
    t = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "x map<string,string>, y map<string,string>")
    assert t.select(cleaning.overlay(F.col("x"), F.col("y"))).first()[0] == {"a": "1", "b": "3", "c": "4"}


def test_rules_in_order(spark):
    t = spark.createDataFrame([(1, ["a"], ["a", "b"]), (2, ["x"], ["a"]), (3, None, None)], "i int, claimed array<string>, evidence array<string>")
    found = RuleSet(Rule("GROUNDED", "block", True, "not in the evidence", ~rules.all_in(F.col("claimed"), F.col("evidence"))), Rule("ONE", "warn", False, "one claim", F.size("claimed") == 1)).apply(t)
    got = {r["i"]: (r["violation"] and r["violation"]["rule"], [v["rule"] for v in r["violations"]]) for r in found.collect()}
    assert got[1] == ("ONE", ["ONE"]) and got[2] == ("GROUNDED", ["GROUNDED", "ONE"]) and got[3][0] is None


def test_rule_helpers(spark):
    t = spark.createDataFrame([("Is it?", "hello world", ["hello wurld", "x"]), ("Is it? Yes.", "abc", ["zzz"]), (None, "a", [])], "t string, q string, e array<string>")
    got = t.select(rules.last_sentence_asks(F.col("t")), rules.quoted_support(F.col("q"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, False)]
