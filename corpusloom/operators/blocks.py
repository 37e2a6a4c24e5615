"""Blocks: heading paths, strip, levels, titles, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = range(1, 7)


def heading_paths(blocks: DataFrame) -> DataFrame:
    """Adds ``heading``: the open headings of levels 1, 2, ... up to the first level without one.

    A heading closes those of deeper levels: a level's last heading counts only if no heading of a lower level follows it.
    """
    order = Window.partitionBy("path").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("type") == "heading"
    out = blocks
    for k in LEVELS:
        here = is_heading & (F.col("level") == k)
        out = out.withColumn(f"_h{k}", F.last(F.when(here, F.struct("position", "content")), ignorenulls=True).over(order))
    steps, newest, open_ = [], F.lit(-1).cast("bigint"), F.lit(True)
    for k in LEVELS:
        at = F.coalesce(F.col(f"_h{k}.position").cast("bigint"), F.lit(-1))
        open_ = open_ & (at > newest) & (F.coalesce(F.col(f"_h{k}.content"), F.lit("")) != "")
        steps.append(F.when(open_, F.col(f"_h{k}.content")))
        newest = F.greatest(newest, at)
    path = F.filter(F.array(*steps), lambda x: x.isNotNull())
    return out.withColumn("heading", path).drop(*[f"_h{k}" for k in LEVELS])


def min_level(blocks: DataFrame) -> DataFrame:
    """path and the least heading level, 0 without headings."""
    level = F.min(F.when(F.col("type") == "heading", F.col("level")))
    return blocks.groupBy("path").agg(F.coalesce(level, F.lit(0)).cast("bigint").alias("min_level"))


def strip(blocks: DataFrame) -> DataFrame:
    """Drops thematic breaks and HTML comments, moves levels up to 1, renumbers, and finds the heading paths anew."""
    comment = (F.col("type") == "html") & F.ltrim("content").startswith("<!--")
    kept = blocks.where((F.col("type") != "thematic_break") & ~comment)
    whole = Window.partitionBy("path")
    least = F.min(F.when(F.col("type") == "heading", F.col("level"))).over(whole)
    kept = kept.withColumn("level", F.when(F.col("type") == "heading", F.col("level") - least + 1).otherwise(F.col("level")))
    kept = kept.withColumn("position", (F.row_number().over(whole.orderBy("position")) - 1).cast("bigint"))
    return heading_paths(kept)


def warnings(blocks: DataFrame) -> DataFrame:
    """Files without headings."""
    return blocks.groupBy("path").agg(F.bool_or(F.col("type") == "heading").alias("any")).where("not any").select(
        "path", F.lit("file has no headings").alias("warning")
    )


def titles(blocks: DataFrame) -> DataFrame:
    """The first heading of level 1, else the file's stem."""
    first = F.min_by(F.when((F.col("type") == "heading") & (F.col("level") == 1), F.col("content")), F.when(
        (F.col("type") == "heading") & (F.col("level") == 1), F.col("position")))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return blocks.groupBy("path").agg(first.alias("first")).select("path", F.coalesce("first", stem).alias("title"))


def render(blocks: DataFrame, base: int = 2) -> DataFrame:
    """The markdown of each path, with headings moved so that the least level is base + 1."""
    least = F.min(F.when(F.col("type") == "heading", F.col("level"))).over(Window.partitionBy("path"))
    level = F.least(F.greatest(F.col("level") - least + base + 1, F.lit(1)), F.lit(6)).cast("int")
    language = F.coalesce(F.col("language"), F.lit("")) if "language" in blocks.columns else F.lit("")
    text: Column = (
        F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "content"))
        .when(F.col("type") == "code_block", F.concat(F.lit("```"), language, F.lit("\n"), "content", F.lit("\n```")))
        .when(F.col("content") != "", F.col("content"))
    )
    lines = blocks.select("path", "position", text.alias("text")).where(F.col("text").isNotNull())
    own = F.array_sort(F.collect_list(F.struct("position", "text")))
    return lines.groupBy("path").agg(F.array_join(F.transform(own, lambda x: x["text"]), "\n\n").alias("markdown"))
