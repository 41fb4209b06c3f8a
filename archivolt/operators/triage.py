"""Sorting article images into buckets by keyword rules, and the report on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import contains_any, context
from archivolt.functions.urls import is_gif_path

# Buckets in report order, and the keywords of each rule.
BUCKETS = (
    "keep_knowledge", "review_possible_knowledge", "review_unknown", "reject_decorative", "reject_product_or_shopping",
    "reject_game_entertainment",
)
STRONG_KNOWLEDGE = (
    "图表", "表格", "流程图", "架构图", "示意图", "脑图", "截图", "代码", "公式", "数据", "曲线", "统计", "论文",
    "文献", "笔记", "书单", "书页", "课件", "PPT", "路线图", "清单", "模型", "框架", "配置", "界面", "页面",
)
WEAK_KNOWLEDGE = ("模型", "框架", "如图", "下图", "上图", "见图")
POSSIBLE_KNOWLEDGE = (
    "读博", "科研", "学习", "创业", "AI", "编程", "开发", "产品", "职业", "面试", "投资", "经济", "心理", "沟通", "认知",
)
DECORATIVE = (
    "头像", "壁纸", "美图", "自拍", "写真", "美女", "女生照片", "穿搭", "服装", "发型", "表情包", "动漫图", "插画", "背景图",
    "手机拍照",
)
PRODUCT = (
    "淘宝", "京东", "拼多多", "1688", "购买", "买哪", "值得买", "推荐店铺", "好物", "商品", "链接", "优惠券", "价格", "测评", "开箱",
)
GAME = ("galgame", "Galgame", "Steam", "游戏", "手游", "主机", "二次元", "番剧", "漫画", "电影")
MOST_POSSIBLE_IMAGES, EXAMPLES = 10, 8

#: Rules in order: keywords, bucket, reason, greatest number of images.
RULES: tuple[tuple[tuple[str, ...], str, str, int | None], ...] = (
    (STRONG_KNOWLEDGE, "keep_knowledge", "knowledge_context", None),
    (DECORATIVE, "reject_decorative", "decorative_context", None),
    (PRODUCT, "reject_product_or_shopping", "product_or_shopping_context", None),
    (GAME, "reject_game_entertainment", "game_entertainment_context", None),
    (WEAK_KNOWLEDGE, "review_possible_knowledge", "weak_knowledge_context", None),
    (POSSIBLE_KNOWLEDGE, "review_possible_knowledge", "possible_knowledge_context", MOST_POSSIBLE_IMAGES),
)
TITLE_RULES = (
    (DECORATIVE, "reject_decorative", "decorative_title"),
    (PRODUCT, "reject_product_or_shopping", "product_or_shopping_title"),
    (GAME, "reject_game_entertainment", "game_entertainment_title"),
)


def _first_match(rules: list[tuple[Column, str, str]], otherwise: Column) -> Column:
    made = otherwise
    for condition, bucket, reason in reversed(rules):
        made = F.when(condition, F.struct(F.lit(bucket).alias("bucket"), F.lit(reason).alias("reason"))).otherwise(made)
    return made


def triage(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, position, image_url, bucket, reasons) of every non-empty image URL of ``df``.

    The first rule with a keyword in title, content or collection title decides; a rejecting
    title replaces bucket and reasons, or adds its reason if the bucket is the same. Rows
    without usable images have no row. ``df`` is classified before its images are exploded.
    """
    images = F.filter(F.coalesce("images", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    rows = df.select(*[k for k in keys if k != "title"], "title", images.alias("_images"), context(F.col("title"), F.col("content"), F.col("source_collection_title")).alias("_text"))
    rows = rows.filter(F.size("_images") > 0)
    rules = [
        (contains_any(F.col("_text"), words) & (F.size("_images") <= most if most else F.lit(True)), bucket, reason)
        for words, bucket, reason, most in RULES
    ]
    unknown = F.struct(F.lit("review_unknown").alias("bucket"), F.lit("unknown_context").alias("reason"))
    by_title = _first_match([(contains_any(F.col("title"), w), b, r) for w, b, r in TITLE_RULES], F.lit(None))
    rows = rows.select(*keys, "_images", _first_match(rules, unknown).alias("_c"), by_title.alias("_t"))
    bucket = F.coalesce("_t.bucket", "_c.bucket")
    reasons = (
        F.when(F.col("_t").isNull(), F.array("_c.reason"))
        .when(F.col("_t.bucket") == F.col("_c.bucket"), F.array_distinct(F.array("_c.reason", "_t.reason")))
        .otherwise(F.array("_t.reason"))
    )
    rows = rows.select(*keys, bucket.alias("bucket"), reasons.alias("_reasons"), F.posexplode("_images").alias("position", "image_url"))
    gif = F.when(is_gif_path(F.col("image_url")), F.array(F.lit("gif_url"))).otherwise(F.array().cast("array<string>"))
    return rows.select(*keys, "position", "image_url", "bucket", F.concat("_reasons", gif).alias("reasons"))


def bucket_report(items: DataFrame) -> DataFrame:
    """(bucket, images, articles) of every bucket, also of those without images; other buckets are left out."""
    counted = items.groupBy("bucket").agg(F.count("*").alias("images"), F.countDistinct("article_id").alias("articles"))
    spark = items.sparkSession
    domain = spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return domain.join(counted, "bucket", "left").select(
        "bucket", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("articles", F.lit(0)).alias("articles")
    )


def examples(items: DataFrame, order: list[str], most: int = EXAMPLES) -> DataFrame:
    """The first ``most`` rows of each bucket by ``order``, with their place (rank from 1).

    Rows are ranked by parts of a bucket first, so that no task sorts a whole bucket.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    rank = F.row_number().over(Window.partitionBy("bucket", "_part").orderBy(*order))
    few = items.withColumn("_part", part).withColumn("_rank", rank).filter(F.col("_rank") <= most)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return few.withColumn("rank", rank).filter(F.col("rank") <= most).drop("_part", "_rank")


def summary(items: DataFrame) -> DataFrame:
    """(articles_with_images, images_total) in one row."""
    return items.agg(F.countDistinct("article_id").alias("articles_with_images"), F.count("*").alias("images_total"))
