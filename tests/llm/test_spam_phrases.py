"""Keyword pages that are known only by repetition in their lines or by phrases of other hosts' lists."""

from pyspark.sql import functions as F

from archivolt.llm import spam

REAL = "The prosecutor kept the notebook for three hundred days and nobody at the court expected that. Really, it took a long time to tell both apart."
LISTS = [
    "best, price, sunglasses, curtain, buy, sale, online, lamp, near, phone case, best, price, lamp, curtain, sale",
    "台灯、特价、表带、太阳镜、包邮、批发、台灯、特价、表带、太阳镜、包邮、批发、台灯、表带",
    "cortina, precio, teclado, barato, wum3lo, cortina, precio, teclado, barato, wum3lo",
    "沙发套、无人机、正品、沙发套、无人机、正品、沙发套、无人机、正品、沙发套、无人机、正品",
]


def found(spark, pages):
    """The flagged ones of ``pages``; the lists stand on four other hosts, real text on three."""
    rows = [(f"list {k} {h}", x, f"h{h}") for k, x in enumerate(LISTS) for h in range(4)] + [(f"real {h}", REAL, f"r{h}") for h in range(3)]
    rows += [(n, x, n) for n, x in pages.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string, host string")
    got = {r.doc_id for r in spam.stuffed_pages(df, "doc_id", "text", F.col("host")).collect()}
    assert {n for n in got if n.startswith(("list", "real"))} == {n for n, _, _ in rows if n.startswith("list")}
    return got & set(pages)


def test_run_of_phrases_of_settled_pages(spark):
    """The phrases of pages that are certain by themselves count for pages that are not; words of sentences don't."""
    stitched = "\n".join(["best lamp", "curtain price", "Wombul", "online", "sunglasses sale", "Tralto", "buy"])
    poem = "\n".join(["the long time", "nobody at court", "a notebook", "three days", "really", "that took both", "prosecutor"])
    assert found(spark, {"stitched": stitched, "poem": poem}) == {"stitched"}


def test_long_blocks(spark):
    """Keywords parted by single spaces, sentences of keywords and tag: lists; not numbers, logs and passing words."""
    spam_pages = {
        "spaced": "precio cortina comprar teclado cortina barato comprar teclado zapatillas precio cortina barato zapatillas comprar teclado precio",
        "spaced zh": "沙发套 无人机 沙发套 正品 无人机 正品 沙发套 无人机 正品 沙发套 沙发套 无人机 正品 无人机",
        "sentences": "If you want a phone case today, our phone case and lamp are surely the best phone case you can want. Order your lamp today, because lamp and phone case in Pronvu always go fast! Everyone in Nolpoon says best lamp, best lamp and again sunglasses.",
        "sentences zh": "璟蓼站人人都说台灯、台灯还有特价台灯。为什么选表带？因为特价台灯就是崖澄站的特价台灯。想要台灯就来涧笙岭看表带，这里的表带就是您要的台灯。",
        "tags": " " + " ".join(f"tag:wum{k}lo" for k in range(20)),
        "joined tags": "".join(f"#wum{k}lo" for k in range(20)),
    }
    real_pages = {
        "numbers": " ".join(str(k % 3) for k in range(40)),
        "log": "\n".join(f"2024-01-0{k} 10:00:0{k} INFO worker {k} has taken the file part-{k} from the queue and wrote {k} rows" for k in range(9)),
        "passing": REAL + " He bought a lamp online for a good price and never mentioned it to anybody in that court again.",
        "text zh": "关于那盏台灯，邻居只说了一句话。检察官把笔记本保存了三百天，法院里没有人想到会这样。",
    }
    assert found(spark, spam_pages | real_pages) == set(spam_pages)


def test_hosts_decide(spark):
    """Without phrases that enough hosts hold no page of the data is flagged; with them those of every shape are."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    host = F.concat_ws("|", "source", "collection_id")
    assert spam.stuffed_pages(df, "doc_id", "text", host).count() > 30
    assert spam.stuffed_pages(df, "doc_id", "text", host, hosts=1000).count() == 0


def test_links_and_tags_of_known_lists(spark):
    """Lists by build count once other hosts' lists hold their domains or keywords, and not before."""
    links = "\n".join(f"https://shelf.example/a{k}" for k in range(8))
    tags = " ".join(f"#wum{k}lo" for k in range(8))
    own = "\n".join(f"https://shelf.example/b{k}" for k in range(8))
    df = spark.createDataFrame([("l", links, f"h{k}") for k in range(3)] + [("t", tags, "h9"), ("o", own, "h8")], "doc_id string, text string, host string")
    assert {r.doc_id for r in spam.stuffed_pages(df, "doc_id", "text", F.col("host")).collect()} == {"l", "o"}


def test_phrases_of_ordinary_words(spark):
    """Phrases that lists of several hosts hold decide although each of their words is common outside lists."""
    words = "green river stone table winter garden letter bridge"
    phrases = ["green table", "river garden", "stone letter", "winter bridge"]
    rows = [(f"list {h}", ", ".join([*phrases[h:], *phrases[:h]] * 2), f"h{h}") for h in range(4)]
    real = [f"The {w} was {v} and nobody had seen a {w} of that kind before the year was over." for w in words.split() for v in ("old", "new")]
    rows += [(f"real {h}", " ".join(real[h % 3 :]), f"r{h}") for h in range(9)]
    rows.append(("bait", "Everybody who wants a green table today takes our green table or river garden. The stone letter of our winter bridge is a river garden for you.", "b"))
    rows.append(("words", "Everybody who wants a table today takes our green letter or garden. The river of our stone bridge is in winter a table for you.", "c"))
    df = spark.createDataFrame(rows, "doc_id string, text string, host string")
    got = {r.doc_id for r in spam.stuffed_pages(df, "doc_id", "text", F.col("host")).collect()}
    assert got == {"bait", *(f"list {h}" for h in range(4))}
