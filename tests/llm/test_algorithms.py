import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing, quota_sample, split_overlap, tokens

HERE = pytest.mark.skipif(not tokens.tokenizer_available(), reason="no vocabulary files")


# --- problem 2 ---
@HERE
def test_cached_counts_equal_plain_encoding():
    path = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
    count, enc = tokens.counter(path, cache_pieces=5), tokens.encoder(path)
    rng = random.Random(2)
    texts = ["", " ", "  a  b ", "Привет,  мир!\n\n Да", "don't stop\t1,000 x", "қазақша сөйлем — жақсы 🙂", "a \n b\r\n"] + ["".join(rng.choice("аб cd \n.'1") for _ in range(40)) for _ in range(200)]
    assert [count(t) for t in texts] == [len(enc.encode_ordinary(t)) for t in texts]
    assert count(None) == 0


@HERE
def test_ledger_deltas_equal_full_recount(spark, tmp_path):
    schema = "id long, source string, lang string, text string"
    one = spark.createDataFrame([(1, "a", "en", "one two"), (2, "a", None, "three"), (3, None, "ru", None), (4, "b", "ru", "привет мир")], schema)
    two = spark.createDataFrame([(1, "a", "en", "one two"), (2, "a", "en", "three four"), (4, "c", "ru", "привет мир"), (5, "b", "kk", "")], schema)
    for k, docs in enumerate((one, two, two.limit(0), one)):
        book = tokens.TokenLedger(spark, str(tmp_path), ["id"], ["source", "lang"])  # each update by a new object
        assert book.version == k - 1
        before = tokens.cube(book.snapshot(), ["source", "lang"]).collect() if k else []
        got = {tuple(r) for r in book.update(docs).select("source", "lang", "n_rows", "n_tokens").collect()}
        snap = tokens.snapshot(docs, None, ["id"], ["source", "lang"])
        assert got == {tuple(r) for r in tokens.cube(snap, ["source", "lang"]).collect()}
        # The signed deltas are the difference of the two cubes.
        sums = {(r[0], r[1]): [r[2], r[3]] for r in before}
        for r in book.changes().collect():
            s = sums.setdefault((r["source"], r["lang"]), [0, 0])
            s[0], s[1] = s[0] + r["d_rows"], s[1] + r["d_tokens"]
        assert {(*key, *v) for key, v in sums.items() if v[0]} == got
    new = [spark.read.parquet(f"{tmp_path}/counts/{v}").count() for v in range(4)]
    assert new == [4, 2, 0, 0]  # only contents never seen are encoded and written


@HERE
def test_broken_update_is_done_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z")], "id long, source string, text string")
    tokens.TokenLedger(spark, str(tmp_path), ["id"], ["source"]).update(docs)
    docs.write.parquet(f"{tmp_path}/counts/1")  # an update that broke before its cube
    book = tokens.TokenLedger(spark, str(tmp_path), ["id"], ["source"])
    assert book.version == 0
    assert book.update(docs.where("id = 1")).collect()[0]["source"] == "a" and book.version == 1


@HERE
@pytest.mark.parametrize("few", [True, False])
def test_removal_equals_an_update_without_the_rows(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(tokens, "BROADCAST_IDS", 0)
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "a", "x y"), (3, None, "x y"), (4, "b", None), (5, "b", None), (6, "c", "z")], "id long, source string, text string")
    a, b = (tokens.TokenLedger(spark, f"{tmp_path}/{x}", ["id"], ["source"]) for x in "ab")
    a.update(docs)
    b.update(docs)
    later = tokens.repeated(a.snapshot().select("content_hash", F.struct("id").alias("_id")))
    assert sorted(r["id"] for r in later.collect()) == [2, 3, 5]

    def rows(df):
        return sorted(map(repr, df.collect()))

    assert rows(a.remove(later)) == rows(b.update(docs.where("id in (1, 4, 6)"))) and a.version == b.version == 1
    assert rows(a.changes()) == rows(b.changes()) and rows(a.snapshot()) == rows(b.snapshot()) and rows(a.counts()) == rows(b.counts())
    assert rows(tokens.TokenLedger(spark, f"{tmp_path}/a", ["id"], ["source"]).update(docs)) == rows(b.update(docs))  # it goes on from there


@HERE
@pytest.mark.parametrize("few", [True, False])
def test_each_content_is_encoded_once(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(tokens, "BROADCAST_IDS", 0)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "a")], "k long, text string")
    known = tokens.count_table(docs, ["k"]).collect()
    assert sorted(r["n_tokens"] for r in known) == [0, 1, 1]
    table = spark.createDataFrame(known, "content_hash string, n_tokens long")
    more = tokens.count_table(spark.createDataFrame([(1, "b"), (2, "c d"), (3, "c d")], "k long, text string"), ["k"], table)
    assert [r["n_tokens"] for r in more.collect()] == [2]


# --- problem 4 ---
def chatml(*turns, end="<|im_end|>", line="\n"):
    return f"<|im_start|>system{line}Same for all.{end}{line}" + "".join(f"<|im_start|>{'user' if i % 2 == 0 else 'assistant'}{line}{t}{end}{line}" for i, t in enumerate(turns))


def test_turn_words_ignore_system_and_form():
    a = split_overlap.turn_words(chatml("Hello, World", "Да"))
    assert a == ["hello", "world", "да"] == split_overlap.turn_words(chatml("hello world!", "да.", end="<|redacted_im_end|>", line="\r\n"))
    assert split_overlap.turn_words(None) == split_overlap.turn_words("plain") == []


def test_overlaps_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    phrases = [" ".join(rng.choice(vocab) for _ in range(6)) for _ in range(12)]  # template parts that many records share
    def record():
        return " ".join(rng.choice(phrases) + " " + " ".join(rng.choice(vocab) for _ in range(4)) for _ in range(8)).split()
    train = [(1000 + i, record()) for i in range(150)]
    held = [(i, record()) for i in range(40)]
    for i in range(40, 80):
        base = list(rng.choice(train)[1])
        for _ in range(rng.randrange(0, 26)):
            k = rng.randrange(len(base))
            base[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [base[k], "extra"]])
        held.append((i, base))
    train += [(2000 + i, list(train[0][1])) for i in range(5)]
    held += [(500, list(train[0][1]))]
    text = lambda ws: chatml(" ".join(ws[:40]), " ".join(ws[40:]))
    schema = "row_id long, text string, n string"
    a = spark.createDataFrame([(i, text(w), "x") for i, w in held] + [(900, None, "x"), (901, "", "x")], schema)
    b = spark.createDataFrame([(i, text(w), "x") for i, w in train] + [(3000, None, "x")], schema)
    got = {(r["held_id"], r["train_id"]) for r in split_overlap.overlaps(a, b).collect()}
    want = {(i, j) for i, x in held for j, y in train if split_overlap.lcs(x, y) >= 0.75 * max(len(x), len(y))}
    # Chunks can't prove completeness right at the threshold; well above it nothing may be lost, and single words lose nothing.
    sure = {(i, j) for i, x in held for j, y in train if split_overlap.lcs(x, y) >= 0.85 * max(len(x), len(y))}
    assert sure <= got <= want and len(got) >= 0.9 * len(want) and (500, 2003) in got
    assert {(r["held_id"], r["train_id"]) for r in split_overlap.overlaps(a, b, short=1 << 30).collect()} == want
    assert split_overlap.overlaps(a.limit(0), b).count() == 0 == split_overlap.overlaps(a, b.limit(0)).count()


def test_no_pair_over_the_chunk_share_is_lost(spark, monkeypatch):
    """Every pair of OVERLAP or more in whole chunks is found, with joins cut into blocks as well."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]  # few words: all chunks are frequent
    base = [[rng.choice(vocab) for _ in range(rng.randrange(5, 90))] for _ in range(25)]

    def edited(words):
        out = list(words)
        for _ in range(rng.randrange(0, len(out) // 4 + 1)):
            out[rng.randrange(len(out))] = rng.choice(vocab)
        return out

    held, train = ([(start + i, edited(rng.choice(base))) for i in range(150)] for start in (0, 1000))
    of = lambda rows: spark.createDataFrame([(i, chatml(" ".join(w))) for i, w in rows], "row_id long, text string")
    like = {(i, j): split_overlap.chunk_overlap(x, y) for i, x in held for j, y in train if split_overlap.lcs(x, y) >= 0.75 * max(len(x), len(y))}
    sure = {(i, j) for (i, j), share in like.items() if share >= split_overlap.OVERLAP or max(len(held[i][1]), len(train[j - 1000][1])) <= split_overlap.SHORT}
    for pairs in (1 << 27, 64):  # 64: chunks of this size are hot
        monkeypatch.setattr(split_overlap, "BLOCK_PAIRS", pairs)
        got = {(r["held_id"], r["train_id"]) for r in split_overlap.overlaps(of(held), of(train)).collect()}
        assert sure <= got <= set(like) and len(got) >= 0.9 * len(like)


def test_family_of_near_copies_is_whole(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    short = [f"v{i}" for i in range(20)]

    def edited(words, i):
        k = rng.randrange(len(words))
        return " ".join([*words[:k], f"edit{i}", *words[k + 1 :]])

    of = lambda start, n: spark.createDataFrame([(start + i, chatml(edited(base, start + i))) for i in range(n)] + [(start + 500 + i, chatml(edited(short, start + i))) for i in range(n)], "row_id long, text string")
    n = 100  # every chunk free of edits is in 100 x 100 pairs
    got = [(r["held_id"], r["train_id"]) for r in split_overlap.overlaps(of(0, n), of(1000, n)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i + k, 1000 + j + k) for i in range(n) for j in range(n) for k in (0, 500)}


# --- problem 7 ---
@pytest.mark.parametrize("seed", range(20))
def test_controlled_rounding_keeps_margins(seed):
    rng = random.Random(seed)
    n, m = rng.randrange(1, 6), rng.randrange(1, 7)
    table = [[rng.random() * rng.choice([0, 1, 5]) for _ in range(m)] for _ in range(n)]
    done = quota_sample.round_table(table)
    for i in range(n):
        assert math.floor(sum(table[i]) + 1e-9) <= sum(done[i]) <= math.ceil(sum(table[i]) - 1e-9)
        for j in range(m):
            assert math.floor(table[i][j] + 1e-9) <= done[i][j] <= math.ceil(table[i][j] - 1e-9)
    for j in range(m):
        col = sum(table[i][j] for i in range(n))
        assert math.floor(col + 1e-9) <= sum(done[i][j] for i in range(n)) <= math.ceil(col - 1e-9)


def test_quota_sample(spark):
    rows = [(i, " A" if i % 3 else "b", f"s{i % 4}" if i % 7 else None, "q") for i in range(1000)] + [(5000, None, "s0", "q"), (5001, "rare", "s1", "q")]
    t = spark.createDataFrame(rows, "rec_id long, cat string, shape string, key string")
    targets = spark.createDataFrame([("cat", "a", 0.5, 10), ("cat", "b", 0.3, 50), ("cat", "rare", 0.1, 3), ("cat", "gone", 0.1, None)], "field_name string, category string, target_share double, min_rows int")
    fields = {"cat": F.col("cat")}
    drawn = quota_sample.sample(t, targets, fields, F.col("shape"), "rec_id").cache()
    n = {r["category"]: r["count"] for r in drawn.groupBy("category").count().collect()}
    assert n == {"a": 50, "b": 50, "rare": 1}
    assert drawn.select("id").distinct().count() == 101
    again = quota_sample.sample(t.repartition(7), targets, fields, F.col("shape"), "rec_id")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in drawn.collect()}
    short = {r["category"] for r in quota_sample.report(t, targets, fields, drawn).where("short").collect()}
    assert short == {"rare", "gone"}
    assert quota_sample.sample(t.limit(0), targets, fields, F.col("shape"), "rec_id").count() == 0


# --- problem 9 ---
@HERE
def test_mixing(spark):
    docs = [(i, "big", "one two three four", 1) for i in range(400)] + [(1000 + i, "small", "one two three four", 1) for i in range(100)] + [(2000, "tiny", "one", 1), (3000, None, "x", 1), (3001, "other", "x", 1), (3002, "big", None, 1)]
    t = spark.createDataFrame(docs, "doc_id long, source string, text string, have int")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 4), ("tiny", 0.05, 3), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    r = mixing.rates(mixing.source_tokens(t, targets), targets).cache()
    by = {x["source"]: x for x in r.collect()}
    assert {k for k, x in by.items() if x["short"]} == {"tiny", "none"}
    assert 0 < by["big"]["rate"] < 1 and 1 < by["small"]["rate"] < 3
    out = mixing.mix(t, r)
    n = {x["source"]: x["count"] for x in out.groupBy("source").count().collect()}
    assert n["tiny"] == 3 and abs(n["small"] / 100 - by["small"]["rate"]) < 0.2 and abs(n["big"] / 401 - by["big"]["rate"]) < 0.1
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4
    assert mixing.mix(t.limit(0), r).count() == 0
    shares = {x["source"]: x["mixed_share"] for x in mixing.shares(t, r).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9
