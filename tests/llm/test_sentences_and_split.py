"""Sentence spans, pieces of oversized texts, and what must hold of them for any text."""

import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.llm import sentences, split

DATA = "/root/testdata/sf0.1/articles.parquet"


@pytest.fixture(scope="module")
def splitter():
    texts = duckdb.execute(f"SELECT content FROM '{DATA}' WHERE length(content) > 0 ORDER BY rec_no LIMIT 8000").fetchall()
    return sentences.Splitter(sentences.train([t for (t,) in texts]))


def cut(splitter, text, title=None):
    return [text[a:b] for a, b in splitter.spans(text, title)]


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Nobird checked the prosecutor at approx. 55.3 percent, i.e. less than the banansul claimed.", "Really?!", "They collect dosage, feardbal, etc.", "It was 5 p.m. when it stopped."],
        ["关于岚屹筒的汇率,圩桐社只说了一句话.", "他停了一下……然后枞藻岭的报税又回来了。", "大家都喊：“再也不要报税了！”然后离开了峥枫板。"],
        ["みんなは「もうデータベースはいらない！」と叫んでムントを出た。", "本当に？！"],
        ["Es gibt z. B. Schiedsrichter, Furtpisaun u. a. Dinge auf S. 776 ff. im Heft.", "Am 3. Tag lag Schiedsrichter bei 1.12,10 Punkten, vgl. Abs. 7 bei Firtdö."],
    ],
)
def test_known_sentences(splitter, units):
    gap = "" if units[0][0] > "⺀" else " "
    assert cut(splitter, gap.join(units)) == units
    assert cut(splitter, "Heading\n \t\n" + gap.join(units)) == ["Heading", *units]


def test_defined_results(splitter):
    for empty in (None, "", "  \n\t\n "):
        assert splitter.spans(empty) == []
    title = "Really?! How it works. In 2022"
    assert cut(splitter, f" {title}\n", title) == [title]
    assert cut(splitter, "a " * 5000) == [("a " * 5000).strip()]
    assert sentences.train([]).weights == {}


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="aB .!?。“”\n\r\té中ครับ …1(«»-*​", max_size=120))
def test_spans_cover_everything_but_white_space(splitter, text):
    at = 0
    for a, b in splitter.spans(text):
        assert at <= a < b and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="ab .!\n中。", max_size=400), limit=st.integers(5, 60), overlap=st.integers(0, 4))
def test_pieces_hold_their_limits(splitter, text, limit, overlap):
    made = split.pieces(text, splitter, None, limit, overlap)
    assert made[0][0] == 0 and made[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(made, made[1:], strict=False):
        assert c <= b and b - c <= overlap and d > b and b - a <= limit
    for _, b, kind in made:
        if kind == "word":
            assert not (text[b - 1].isalnum() and text[b : b + 1].isalnum())


def test_pieces_prefer_paragraphs_then_sentences(splitter):
    text = "One two. Three four.\n\n" + "Five six seven. " * 6
    kinds = [k for _, _, k in split.pieces(text, splitter, None, 40, 5)]
    assert kinds[0] == "paragraph" and set(kinds[1:-1]) <= {"sentence", "word"}
    assert split.boundary("a" * 50, splitter, None, 40) == "none"
    assert split.boundary("a b " * 30, splitter, None, 40) == "word"
    assert split.boundary("ab.\n\ncd.", splitter, None, 4) == "paragraph"


def test_tables(spark, splitter):
    rows = [(1, None, None), (2, "t", ""), (3, "t", "One. Two here.\n\nThree."), (3, "t", "One. Two here.\n\nThree.")]
    df = spark.createDataFrame(rows, "rec_no bigint, title string, content string").selectExpr("*", "'x' AS piece", "0 AS starts")
    assert sentences.sentences(df, "rec_no", "content", "title", splitter.model).count() == 6
    pieces = split.split(df, "rec_no", "content", "title", 12, 3, splitter.model).collect()
    assert {r.rec_no for r in pieces} == {3} and all(len(r.piece) <= 12 for r in pieces)
    assert {r.rec_no for r in split.oversized(df, "rec_no", "content", "title", 12, splitter.model).collect()} == {3}
    assert sentences.sentences(df.limit(0), "rec_no", "content").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=80), st.integers(1, 12))
def test_cuts_at_units_alone(text, limit):
    """``cut`` needs no hard cut if, and only if, no unit is over the limit."""
    units = [m.span() for m in re.finditer(r"\S+", text)]
    assert split.cuts_whole(units, len(text), limit) == all(b - a <= limit for a, b in units)
