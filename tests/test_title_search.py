"""Title search over all scripts against brute force."""

from archivolt.plans import queries

TITLES = [
    (0, "關於貓的筆記，第一部"), (1, "關於貓的筆記，第二部"), (2, "關於狗"), (100, "Заметки про  кошку"), (101, "заметки про кошку"), (102, "Заметки про собаку"),
    (200, "Über die  Katze"), (201, "über die Katze"), (300, "猫についてのメモ"), (301, "猫についてのメモ2"), (400, "A note on cats"), (401, "a note on CATS, again"),
    (500, None), (501, None), (600, "ab"), (601, "abc"), (700, "قطة في البيت"), (701, "قطة في البيت الكبير"), (800, "बिल्ली पर टिप्पणी"), (801, "บันทึกเรื่องแมว"), (900, "บันทึกเรื่องแมว"),
]


def grams(title):
    text = " ".join(title.lower().split())
    return {text[k : k + 3] for k in range(len(text) - 2)}


def test_all_titles(spark, tmp_path):
    spark.createDataFrame(TITLES, "rec_no bigint, title string").write.parquet(str(tmp_path / "articles.parquet"))
    got = {(r.query, r.rec_no, r.score) for r in queries.QUERIES["title_search"](spark, str(tmp_path)).collect()}
    titles = [(n, t) for n, t in TITLES if t is not None]
    expected = set()
    for query in {t.lower() for n, t in titles if n % 100 == 0}:
        wanted = grams(query)
        expected |= {(query, n, round(hits / len(wanted), 6)) for n, t in titles if wanted and (hits := len(wanted & grams(t))) and hits / len(wanted) >= 0.6}
    assert got == expected
    assert {n for _, n, _ in got} >= {1, 101, 201, 301, 401, 701, 801}
