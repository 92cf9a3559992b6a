"""Roles of chunks in results: images whose text was read, and whether a hybrid result stands at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import IDENTIFIER_FLOOR, KEYWORD_FLOOR, VECTOR_FALLBACK

#: Fixed value: the keyword score that a vector hit needs beside it.
KEYWORD_RELEVANT = 1.5


#: Fixed value: words of questions about what a screen or a picture shows.
IMAGE_WORDS = "界面|截图|页面|App|小程序|按钮|点击|屏幕|图片|豫事办|支付宝"


def wants_images(c: Column) -> Column:
    """Whether a question is about what images show, whatever the letters' case."""
    return F.coalesce(c, F.lit("")).rlike(f"(?i)({IMAGE_WORDS})")


def image_alone(block: Column, attached: Column) -> Column:
    """Whether a chunk is an image's text that no text chunk took in."""
    return F.coalesce(block == "image", F.lit(False)) & ~F.coalesce(attached != 0, F.lit(False))


def apply_image_role(rows: DataFrame, alone: Column, wanted: Column, factor: float) -> DataFrame:
    """rows without images alone, or with their `score` times the factor where images are wanted."""
    marked = rows.withColumn("__alone", alone).filter(wanted | ~F.col("__alone"))
    return marked.withColumn("score", F.when(F.col("__alone"), F.col("score") * factor).otherwise(F.col("score"))).drop("__alone")


def result_stands(best_keyword: Column, best_vector: Column, boosted: Column, empty: Column, identifier: Column) -> Column:
    """Whether a fused result is no stray from another subject: nothing was merged, no keyword hit was there (null), the
    best reaches the floor, a vector raised a hit, or both channels are fair."""
    floor = F.when(identifier, IDENTIFIER_FLOOR).otherwise(KEYWORD_FLOOR)
    fair = (best_vector >= VECTOR_FALLBACK) & (best_keyword >= KEYWORD_RELEVANT)
    return empty | best_keyword.isNull() | F.coalesce(best_keyword >= floor, F.lit(False)) | F.coalesce(boosted, F.lit(False)) | F.coalesce(fair, F.lit(False))
