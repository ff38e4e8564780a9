import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import fold
from corpusmill.llm.form_duplicates import collapse, form_duplicates

SCHEMA = "rec_id long, h1 string, messages array<struct<role:string,content:string>>"


def talk(*contents):
    return [("user" if i % 2 == 0 else "assistant", c) for i, c in enumerate(contents)]


def test_groups_ignore_form_only(spark):
    rows = [
        (5, "x", talk("Привет, мир!", "Да.")), (2, "y", talk("привет МИР", "да")), (9, "z", talk("При​вет мир", " ДА… ")),
        (3, "x", talk("Привет мир мир", "Да")), (4, "x", talk("Привет, мир!", "Нет.")), (6, "x", talk("Привет, мир!")),
        (7, "x", [("assistant", "Привет мир"), ("user", "да")]), (8, "x", talk("12 5", None)), (10, "x", talk("125", None)), (11, "x", talk("12, 5", "")), (12, "x", None), (13, "x", []),
    ]
    got = {tuple(r) for r in form_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, 5), (2, 9), (8, 11)}
    counts = {r["id"]: r["n_copies"] for r in collapse(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert counts[2] == 3 and counts[8] == 2 and counts[3] == 1 and 5 not in counts and 12 not in counts


def test_empty_table(spark):
    assert form_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_hot_group_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr("corpusmill.runtime.ROWS_PER_SALT", 10)
    long = "слово " * 20_000
    rows = [(i, "x", talk("Ошибка ошибка", "нет")) for i in range(100, 200)] + [(1, "x", talk(long)), (2, "x", talk(long.upper()))]
    got = {tuple(r) for r in form_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(100, i) for i in range(101, 200)} | {(1, 2)}


alphabet = st.text(alphabet="aAбБё1 2.,-​\n İß", max_size=12)


@settings(max_examples=200, deadline=None)
@given(alphabet, alphabet)
def test_hash_agrees_with_canonical_form(a, b):
    h1, h2, n = fold.hash_strings(pa.array([a, b, None]))
    same = fold.canonical(a) == fold.canonical(b)
    assert ((h1[0], h2[0], n[0]) == (h1[1], h2[1], n[1])) == same
    assert fold.same_words(a, b) == same
    assert n[2] == 0


def test_hash_matches_over_slices():
    rng = random.Random(1)
    texts = ["".join(rng.choice("абв abc 1.!") for _ in range(rng.randrange(30))) for _ in range(50)]
    arr = pa.array(texts)
    whole = fold.hash_strings(arr)
    part = fold.hash_strings(arr.slice(20, 10))
    for x, y in zip(whole, part, strict=True):
        assert list(x[20:30]) == list(y)


def test_colliding_rows_are_told_apart(spark):
    """Equal hashes of unequal texts fall to the digest of the canonical form."""
    from corpusmill.llm import form_duplicates as m

    batch = pa.RecordBatch.from_pylist([{"id": 2, "keep_id": 1, "messages": [{"role": "user", "content": "a"}], "keep_messages": [{"role": "user", "content": "b"}]}])
    out = next(m._compare_batches([batch]))
    assert out.column("same").to_pylist() == [False] and out.column("digest")[0].as_py()


@pytest.mark.parametrize("text,want", [("Ё!", "ё"), ("a-b", "ab"), ("1 2", "1 2"), ("x 2", "x2")])
def test_canonical(text, want):
    assert fold.canonical(text) == want
