"""Consistent forms: by table, by trie, and pairs that read the same."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.llm import forms


def test_table():
    for a, b in (
        ("ｆｕｌｌ　ｗｉｄｔｈ！", "full width!"), ("é", "é"), ("a​b­c﻿", "abc"), ("a b", "a b"), ("рареr", "paper"),
        ("ｶﾞｷﾞ", "ガギ"), ("⼀⼈", "一人"), ("Mоscow", "Moscow"), ("ﬁne", "fine"), ("ํา", "ํา"),
    ):
        assert forms.consistent_form(a) == forms.consistent_form(b)
    for a, b in (("a", "A"), ("e", "é"), ("1", "2"), ("a\nb", "a b"), ("a b", "b a"), ("a\r\nb", "a\nb")):
        assert forms.consistent_form(a) != forms.consistent_form(b)
    assert forms.consistent_form(None) is None and forms.consistent_form("") == ""
    assert forms.consistent_form("Привет") == "Привет"
    assert forms.consistent_form("Пpивeт") == "Привет"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aбeоpсxАВΟi​́éё ｈ　1", max_size=14))
def test_form_is_stable_and_blind_to_look_alikes(text):
    form = forms.consistent_form(text)
    assert forms.consistent_form(form) == form
    swapped = unicodedata.normalize("NFD", text).replace("о", "o").replace("a", "а")
    assert forms.consistent_form(swapped) == form


def test_trie():
    trie = forms.SpellingTrie([("paper", 5), ("pepper", 9), ("Папир", 2)])
    assert trie.canonical("рареr") == "paper"
    assert trie.canonical("pa​per") == "paper"
    assert trie.canonical("paner") is None
    assert {w for w, _ in trie.matches("paner", budget=1)} == {"paper"}


def test_same_reading(spark):
    rows = [
        (1, "Paper one", "x"), (2, "Рaper one", "x"), (3, "Paper one", None), (4, "paper one", ""), (5, None, "same text"), (6, "", "same text"),
        (7, "Рaper one", "same text"),
    ]
    df = spark.createDataFrame(rows, "rec_no bigint, title string, content string").selectExpr("*", "'z' AS form", "1 AS n")
    got = {tuple(r) for r in forms.same_reading(df, "rec_no", ["title", "content"]).collect()}
    want = {("title", 1, 2), ("title", 2, 3), ("title", 1, 7), ("title", 3, 7), ("content", 5, 6), ("content", 5, 7)}
    assert got == want
    assert forms.same_reading(df.limit(0), "rec_no", ["title", "content"]).count() == 0
    made = {(r.rec_no, r.field): r.form for r in forms.consistent_forms(df, "rec_no", ["title"]).collect()}
    assert made[(2, "title")] == "Paper one"


def test_the_corpus_decides_loose_look_alikes(spark):
    """Words that mix scripts beyond the table take a corpus word they read like; without one, or alone in their script, they stay."""
    rows = [(1, "the ρrice is high"), (2, "the price is high"), (3, "a price tag"), (4, "the кinоmаtiс"), (5, "москва"), (6, "ᎪᏴᏟ βρ"), (7, "the prıce is high"), (8, "zρx")]
    df = spark.createDataFrame(rows, "rec_no bigint, title string")
    made = {r.rec_no: r.form for r in forms.consistent_forms(df, "rec_no", ["title"]).collect()}
    assert made[1] == made[2] and made[5] == "москва" and made[6] == "ᎪᏴᏟ βρ" and made[8] == "zρx"
    decided = [n for n, text in rows if made[n] != forms.consistent_form(text)]
    assert decided == [1]
    assert {tuple(r) for r in forms.same_reading(df, "rec_no", ["title"]).collect()} == {("title", 1, 2)}
