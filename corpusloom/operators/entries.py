"""Entry documents: ordered aggregation of sections, and vectors of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import INTRO_WORDS
from ..functions.text import labelled_parts, normalize_whitespace, strip, trim_to_words, uuid5, word_count


def joined_in_order(value: Column, order: Column, joint: str) -> Column:
    """An aggregate: the values that aren't null, by order, in one string."""
    held = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_join(F.transform(held, lambda x: x["v"]), joint)


def outline_line(number: Column, title: Column) -> Column:
    number, title = normalize_whitespace(number), normalize_whitespace(title)
    return F.when(number != "", F.concat(number, F.lit(". "), title)).otherwise(title)


def entry_documents(sections: DataFrame, intro_words: int = INTRO_WORDS) -> DataFrame:
    """sections(section_ord, entry_slug, entry_title, section_number, section_title, section_text, url) -> one row for each entry.

    Title and URL are the first section's; the introduction takes sections in order while its words last.
    """
    before = Window.partitionBy("entry_slug").orderBy("section_ord").rowsBetween(Window.unboundedPreceding, -1)
    text = normalize_whitespace(F.col("section_text"))
    sized = sections.withColumn("_n", word_count(text)).withColumn("_room", F.lit(intro_words) - F.coalesce(F.sum("_n").over(before), F.lit(0)))
    excerpt = F.when((F.col("_room") > 0) & (F.col("_n") > 0), trim_to_words(F.col("section_text"), F.greatest(F.col("_room"), F.lit(0)).cast("int")))
    sized = sized.withColumn("_excerpt", excerpt).withColumn("_line", outline_line(F.col("section_number"), F.col("section_title")))
    order = F.col("section_ord")
    out = sized.groupBy("entry_slug").agg(
        F.min_by("entry_title", "section_ord").alias("entry_title"),
        F.split_part(F.min_by("url", "section_ord"), F.lit("#"), F.lit(1)).alias("url"),
        F.count(F.lit(1)).alias("section_count"),
        strip(joined_in_order(F.col("_line"), order, "\n")).alias("section_outline"),
        joined_in_order(F.col("_excerpt"), order, "\n\n").alias("intro_text"),
    )
    out = out.withColumn("search_text", labelled_parts(F.col("entry_title"), F.col("section_outline"), F.col("intro_text")))
    return out.select(uuid5(F.col("entry_slug")).alias("entry_id"), *out.columns)


def mean_vectors(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, the mean of its vectors): sums place by place in double, then array<float>."""
    places = rows.select(key, F.posexplode(vector).alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = places.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v"))
    return ordered.select(key, F.transform("v", lambda p: p["x"].cast("float")).alias(vector))
