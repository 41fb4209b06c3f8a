"""Subjects on held-out examples; keyword pages and what must not be taken for them."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from archivolt.llm import patterns, sentences, spam, subjects

DATA = "/root/testdata/sf0.01"


def test_subjects_of_held_out_examples(spark):
    articles, examples = spark.read.parquet(f"{DATA}/articles.parquet"), spark.read.parquet(f"{DATA}/subject_examples.parquet")
    areas = spark.read.parquet(f"{DATA}/subjects.parquet")
    one = F.row_number().over(Window.partitionBy("lang", "subject").orderBy("example_id"))
    examples = examples.withColumn("n", one).cache()
    rules, model = subjects.fit(articles, examples.filter("n > 1"), "title", "content", areas)
    splitter = sentences.Splitter(model)
    held = examples.filter("n = 1").collect()
    right = sum(rules.document(r.title, r.content, splitter) == [r.subject] for r in held)
    assert right >= 0.8 * len(held)
    assert rules.document(None, None, splitter) == [] and rules.document("", "", splitter) == []
    assert rules.document("notes on the database index", None, splitter) == ["software"]


def test_patterns_against_every_set(spark):
    """All items of a transaction take part, however many; patterns are those of counting every set."""
    rng = random.Random(3)
    rows = [(k, rng.choice("xy"), sorted(rng.sample([f"i{n}" for n in range(40)], rng.choice([1, 5, 30])))) for k in range(60)]
    df = spark.createDataFrame(rows, "tid int, label string, items array<string>")
    want = {}
    for n in (1, 2):
        for _, label, own in rows:
            for body in combinations(own, n):
                want.setdefault(body, Counter())[label] += 1
    want = {(body, label, n, c.total()) for body, c in want.items() if c.total() >= 4 for label, n in c.items()}
    assert {(tuple(r["items"]), r.label, r.n, r.total) for r in patterns.frequent_patterns(df, 4, 2).collect()} == want
    assert patterns.frequent_patterns(df.limit(0), 4, 2).count() == 0


def test_pairs_decide_and_long_sentences_count(spark):
    """Two items that say nothing alone make a rule together, also in sentences of many items; no subject is left out."""
    filler = [f"w{k}x" for k in range(30)]
    docs = []
    for k in range(60):
        rng = random.Random(k)
        first, second, subject = (("alpha", "beta", "law"), ("alpha", "gamma", "sport"), ("delta", "beta", "sport"), ("delta", "gamma", "law"))[k % 4]
        docs.append((subject, [" ".join([first, *rng.sample(filler, 20), second])]))
    rules = subjects.mine(spark, docs, subjects.SECOND)
    joint = {b: r[0] for b, r in rules.items() if len(b) == 2}
    assert joint[("^alpha$", "^beta$")] == "law" and joint[("^beta$", "^delta$")] == "sport"
    made = subjects.Rules(rules)
    assert made.subject("the alpha of a beta") == "law" and made.subject("the alpha of a gamma") == "sport"
    names = ["".join(chr(97 + k // 26**n % 26) for n in range(3)) + "qzx" for k in range(1100)]
    rules = subjects.Rules(subjects.mine(spark, [(n, [f"{n} here"] * 3) for n in names for _ in range(2)], subjects.FIRST))
    assert [rules.subject(f"of {n} again") for n in names] == names


def test_calibration():
    points = [(0.5, False), (0.6, False), (1.2, True), (1.3, False), (1.4, False), (2.0, True), (2.5, True), (3.0, False), (3.5, True)]
    assert subjects.calibrated(points) == 2.0
    assert subjects.calibrated([]) == subjects.ENOUGH and subjects.calibrated([(1.0, False)]) == float("inf")


def test_subjects_without_examples(spark):
    articles, examples = spark.read.parquet(f"{DATA}/articles.parquet").limit(20), spark.read.parquet(f"{DATA}/subject_examples.parquet")
    areas = spark.read.parquet(f"{DATA}/subjects.parquet")
    assert subjects.subjects(articles, examples.limit(0), areas, "rec_no", "title", "content").count() == 0
    assert subjects.subjects(articles.limit(0), examples.limit(0), areas, "rec_no", "title", "content").count() == 0


REAL = "The prosecutor kept the notebook for three hundred days and nobody at the court expected that. Really, it took a long time to tell both apart."
PAGES = {
    "stuffed": "best, price, sunglasses, curtain, buy, sale, online, lamp, best, price, lamp, curtain, sale",
    "products": "\n".join(f"Womglun backpack {k} XL {k}0 €" for k in range(12)),
    "links": "\n".join(f"{k}. name → https://shelf.example/x{k}" for k in range(12)),
    "tags": "【a】【bb】【cc】【dd】【ee】【ff】【gg】" * 6,
    "sentences of keywords": "Cheap lamp? Bulb lamp! Lamp price bulb. Price lamp? Bulb lamp! Bulb price lamp. Cheap lamp price. Lamp bulb cheap price.",
}
NOT = {
    "text": REAL,
    "sources": "\n".join(f"[{k}] Name, A title of a note {k}, 2012. https://shelf.example/x{k}" for k in range(12)),
    "code": "```\n" + "\n".join(f"x{k} = call(y, {k})" for k in range(20)) + "\n```",
    "table": "\n".join(f"| term | {k} | 2.{k} |" for k in range(12)),
    "tag line": REAL + "\n\n#law #court #notes",
    "changes": "\n".join(f"1.{k}.0: {REAL}" for k in range(3)),
    "heading": "How it works in 2022",
}


@pytest.mark.parametrize("extra", ["", REAL[:60] + ".\n"])
def test_pages(spark, extra):
    rows = [(n, extra + x) for n, x in PAGES.items()] + [(n, x) for n, x in NOT.items()] + [("null", None), ("empty", ""), ("blank", " \n ")]
    rows.append(("mostly text", (REAL + "\n") * 6 + PAGES["stuffed"]))
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS _total", "explode(array('h', 'i', 'j')) AS host")
    got = {r.doc_id for r in spam.stuffed_pages(df.unionByName(df), "doc_id", "text", F.col("host")).collect()}
    assert got == set(PAGES)
    assert spam.stuffed_pages(df, "doc_id", "text", F.lit("one host")).count() == 0
    assert spam.stuffed_pages(df.limit(0), "doc_id", "text", F.col("host")).count() == 0


def test_rules_of_all_articles(spark):
    """A word of a few articles among thousands becomes a rule: rules and sentence model come of all articles."""
    law, sport = "The court met. The judge of the court spoke. A court has a judge. Day {}.", "The team won. The goal of the team was late. A team needs a goal. Day {}."
    examples = [(s, f"note {k}", x.format(k)) for k in range(12) for s, x in (("law", law), ("sport", sport))]
    rows = [(k, "", f"Nothing here is of note. Row {k}.") for k in range(13_000)]
    rows += [(13_000 + k, "", law.format(100 + k) + " They saw a quibblewort.") for k in range(24)]
    articles = spark.createDataFrame(rows, "rec_no bigint, title string, content string")
    areas = spark.createDataFrame([("law",), ("sport",)], "subject string")
    rules, model = subjects.fit(articles, spark.createDataFrame(examples, "subject string, title string, content string"), "title", "content", areas)
    assert rules.rules[("^quibblewort$",)][0] == "law" and ("^nothing$",) not in rules.rules
    texts = [r.content for r in articles.collect()] + [c for *_, c in examples]
    assert model == sentences.train(texts)
