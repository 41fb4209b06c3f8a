"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import forms, history, neardup, packing, sentences, spam, split, subjects, tokenizer
from archivolt.workspace import settle, table

#: Where the public tokenizers' files are; set the variable to take them from elsewhere.
VOCABULARY = os.environ.get("ARCHIVOLT_VOCABULARY", tokenizer.VOCABULARY)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized articles and the best boundary that cuts them."""
    return split.oversized(table(spark, sf_dir, "articles"), "rec_no", "content", "title")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every article."""
    return split.split(table(spark, sf_dir, "articles"), "rec_no", "content", "title")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-duplicate articles."""
    return neardup.NearDuplicates(table(spark, sf_dir, "articles"), "rec_no", "title", "content").pairs()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and number of links of every compared article."""
    return neardup.NearDuplicates(table(spark, sf_dir, "articles"), "rec_no", "title", "content").groups()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of every article."""
    articles, examples = table(spark, sf_dir, "articles"), table(spark, sf_dir, "subject_examples")
    return subjects.subjects(articles, examples, table(spark, sf_dir, "subjects"), "rec_no", "title", "content")


def p3_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of articles by subject."""
    return p3_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_articles"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of titles and of contents that read the same but are stored differently."""
    return forms.same_reading(table(spark, sf_dir, "articles"), "rec_no", ["title", "content"])


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every title and content."""
    return forms.consistent_forms(table(spark, sf_dir, "articles"), "rec_no", ["title", "content"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every article's content."""
    return sentences.sentences(table(spark, sf_dir, "articles"), "rec_no", "content", "title")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles not accepted, batch after batch against the history."""
    return history.rejected(table(spark, sf_dir, "articles"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document."""
    sized = tokenizer.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY)
    return packing.pack(sized, "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of keywords, links and tags."""
    host = F.concat_ws("|", "source", "collection_id")
    return spam.stuffed_pages(table(spark, sf_dir, "documents"), "doc_id", "text", host)


def p1_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of every article cover, and how many break a limit."""
    row = F.struct("piece_no", "start_pos", "end_pos", F.length("piece").alias("size"))
    cut = p1_pieces(spark, sf_dir).groupBy("rec_no").agg(F.array_sort(F.collect_list(row)).alias("p"))
    before = lambda x, k: F.get("p", k - 1)["end_pos"]
    broken = lambda test: F.size(F.filter("p", test)).cast("bigint")
    return cut.select(
        "rec_no",
        F.array_max(F.transform("p", lambda x: x["end_pos"])).alias("covered"),
        broken(lambda x, k: (k > 0) & (x["start_pos"] > before(x, k))).alias("gaps"),
        broken(lambda x: (x["size"] > split.LIMIT) | (x["size"] != x["end_pos"] - x["start_pos"])).alias("over_limit"),
        broken(lambda x, k: (k > 0) & (before(x, k) - x["start_pos"] > split.OVERLAP)).alias("over_overlap"),
    )


#: White space, for the regular expressions of both languages.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points other than white space in the sentences of every article, and overlaps and loose ends of sentences."""
    spans = p5_found(spark, sf_dir).groupBy("rec_no").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("s"))
    rows = spans.join(table(spark, sf_dir, "articles").select("rec_no", "content"), "rec_no")
    text = lambda x: F.substr(F.col("content"), x["start_pos"] + 1, x["end_pos"] - x["start_pos"])
    dense = F.transform("s", lambda x: F.length(F.regexp_replace(text(x), _SPACE, "")))
    loose = lambda x: text(x).rlike(f"^{_SPACE}|{_SPACE}$")
    overlaps = F.filter("s", lambda x, k: (k > 0) & (x["start_pos"] < F.get("s", k - 1)["end_pos"]))
    return rows.select(
        "rec_no",
        F.aggregate(dense, F.lit(0), lambda a, n: a + n).cast("bigint").alias("covered"),
        F.size(overlaps).cast("bigint").alias("overlaps"),
        F.size(F.filter("s", loose)).cast("bigint").alias("loose_ends"),
    )


def p4_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of every title and content, shown where they are printable ASCII."""
    form = F.when(F.col("form").rlike("^[ -~]+$") & ~F.col("form").contains("\n"), F.sha2("form", 256))
    first = table(spark, sf_dir, "articles").select("rec_no", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in ("title", "content")])).alias("r"))
    first = first.select("rec_no", "r.field", F.col("r.raw").rlike("^[ -~]+$").alias("ascii"))
    made = p4_forms(spark, sf_dir).join(first, ["rec_no", "field"])
    return made.select("rec_no", "field", F.when(F.col("ascii"), form).alias("form"))


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of what the token ids of every document stand for."""
    made = tokenizer.texts_of(p7_ids(spark, sf_dir), "doc_id", VOCABULARY)
    return made.select("doc_id", F.sha2("text", 256).alias("hash"))


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers, and how many documents or containers break a rule."""
    sized = tokenizer.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY)
    placed = settle(packing.pack(sized, "doc_id"), "containers")
    pieces = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.countDistinct("piece_no").alias("different"), F.sum("n_tokens").alias("tokens"))
    least = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / packing.CAPACITY))
    wrong = (F.col("pieces") != F.col("different")) | (F.col("pieces") != least) | (F.col("tokens") != F.col("n_tokens"))
    documents = sized.join(pieces, "doc_id", "left").agg(F.count("pieces").alias("documents"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("cut_or_lost"))
    square = F.sum(F.col("n_tokens") * F.col("n_tokens"))
    held = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), square.alias("a"))
    over = (F.col("a") > int(packing.ATTENTION * packing.CAPACITY**2)) & (F.col("n") > 1)
    containers = held.agg(F.count_if(F.col("t") > packing.CAPACITY).alias("over_tokens"), F.count_if(F.col("n") > packing.MOST_DOCUMENTS).alias("over_documents"), F.count_if(over).alias("over_attention"))
    one = F.lit(1).alias("_one")
    return documents.select(one, "*").join(containers.select(one, "*"), "_one").drop("_one")


SQL = {
    "p1_limits": "SELECT rec_no, length(content) AS covered, 0::BIGINT AS gaps, 0::BIGINT AS over_limit, 0::BIGINT AS over_overlap FROM articles WHERE length(content) > 0",
    "p4_plain": """SELECT rec_no, field, CASE WHEN regexp_full_match(raw, '[ -~]+') THEN sha256(raw) END AS form
        FROM (SELECT rec_no, 'title' AS field, title AS raw FROM articles UNION ALL SELECT rec_no, 'content', content FROM articles) WHERE raw <> ''""",
    "p5_coverage": f"""SELECT rec_no, length(regexp_replace(content, '{_SPACE}', '', 'g')) AS covered, 0::BIGINT AS overlaps, 0::BIGINT AS loose_ends
        FROM articles WHERE length(regexp_replace(content, '{_SPACE}', '', 'g')) > 0""",
    "p7_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents",
    "p8_limits": "SELECT count(*) AS documents, 0::BIGINT AS cut_or_lost, 0::BIGINT AS over_tokens, 0::BIGINT AS over_documents, 0::BIGINT AS over_attention FROM documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    made = (
        p1_found, p1_pieces, p1_limits, p2_found, p2_groups, p3_found, p3_composition, p4_found, p4_forms, p4_plain, p5_found, p5_coverage, p6_found,
        p7_ids, p7_texts, p8_containers, p8_limits, p9_found,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """SQL of what can be said of a result without making it; tests hold the operators against brute force."""
    return dict(SQL)
