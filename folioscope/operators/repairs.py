"""Repair plans as tables: what a batch would change, with its evidence, and applying it.

A plan is a DataFrame to look at, count or write as CSV; nothing changes until it is applied to the
tables, which then get a new version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import titles, years
from folioscope.operators.library import applied, head_tail, path_key


def year_plan(pages: DataFrame, stored: DataFrame, head: int = 12, tail: int = 8) -> DataFrame:
    """(path, title, year, confidence, why, old, new, action) for each book.

    pages(path, title, page, text), stored(path, year, page): the year that each page of a book has now; a
    book's stored year is the most frequent one, at a tie the one that a page names first (the earlier
    year, where ``stored`` has no page).  Books of at most ``tail``
    pages have no tail text, since their head holds it all.
    """
    texts = head_tail(pages, head, tail)
    books = pages.groupBy("path").agg(F.min("title").alias("title"), F.count("*").alias("n"))
    place = F.min(F.expr("try_cast(page AS long)")) if "page" in stored.columns else F.min(F.lit(0).cast("long"))
    counts = stored.filter(F.col("year") > 0).groupBy("path", "year").agg(F.count("*").alias("c"), F.coalesce(place, F.lit(10**9).cast("long")).alias("first"))
    now = counts.groupBy("path").agg(F.max_by("year", F.struct(F.col("c"), -F.col("first"), -F.col("year"))).alias("old"))
    rows = books.join(texts, "path").join(now, "path", "left")
    tail_text = F.when(F.col("n") > tail, F.col("tail")).otherwise(F.lit(""))
    found = rows.withColumn("f", years.detected(F.col("title"), F.col("head"), tail_text))
    out = found.withColumn("d", years.decision(F.col("old"), F.col("f")))
    return out.select("path", "title", F.col("f.year").alias("year"), F.col("f.confidence").alias("confidence"), F.col("f.why").alias("why"), "old", F.col("d.year").alias("new"), F.col("d.action").alias("action"))


def title_plan(sources: DataFrame, heads: DataFrame) -> DataFrame:
    """(path, old, new, pub_src, action): publication names derived anew; heads(path, meta_title, head)."""
    rows = sources.join(heads, "path", "left")
    name = titles.resolve(F.col("path"), F.col("collection"), F.col("meta_title"), F.coalesce("head", F.lit("")))
    out = rows.withColumn("r", name)
    changed = ~F.col("pub").eqNullSafe(F.col("r.pub"))
    return out.select("path", F.col("pub").alias("old"), F.col("r.pub").alias("new"), F.col("r.pub_src").alias("pub_src"), F.when(changed, "change").otherwise("same").alias("action"))


def apply_years(stored: DataFrame, plan: DataFrame) -> DataFrame:
    """Page years after a plan: all pages of a changed book get its new year."""
    return applied(stored, plan.filter(F.col("action").isin("assign", "replace")), "path", "year")


def apply_titles(sources: DataFrame, plan: DataFrame) -> DataFrame:
    change = plan.filter("action = 'change'").select("path", F.col("new").alias("_pub"), F.col("pub_src").alias("_src"), F.lit(True).alias("_hit"))
    out = sources.join(change, "path", "left")
    pick = lambda new, old: F.when(F.col("_hit"), F.col(new)).otherwise(F.col(old))
    return out.withColumns({"pub": pick("_pub", "pub"), "pub_src": pick("_src", "pub_src")}).select(*sources.columns)


def mark_copies(jobs: DataFrame, copies: DataFrame, now: float) -> DataFrame:
    """Jobs after copies(path, title, kept) were merged away: each is a duplicate of what was kept."""
    marks = copies.select("path", "title", F.lit("duplicate").alias("status"), F.concat(F.lit("copy of "), F.col("kept")).alias("detail"), F.lit(now).alias("updated"))
    return jobs.join(copies.select("path").distinct(), "path", "left_anti").unionByName(marks, allowMissingColumns=True)


def restore_copies(jobs: DataFrame, paths: DataFrame) -> DataFrame:
    """Jobs without the duplicate marks of some paths; their files are new again for the next scan."""
    keys = paths.select(path_key(F.col("path")).alias("_key")).distinct()
    keyed = jobs.withColumn("_key", path_key(F.col("path")))
    gone = keyed.filter("status = 'duplicate'").join(keys, "_key", "left_semi").select("_key").distinct()
    return keyed.join(gone, "_key", "left_anti").drop("_key").unionByName(keyed.filter("status <> 'duplicate'").join(gone, "_key", "left_semi").drop("_key"))


def bulk_outcome(requested: DataFrame, done: DataFrame) -> DataFrame:
    """(outcome, n) of a bulk operation: done, or not found; each requested path counts once."""
    known = done.select(path_key(F.col("path")).alias("_key")).distinct().withColumn("_done", F.lit(True))
    rows = requested.select(path_key(F.col("path")).alias("_key")).distinct().join(known, "_key", "left")
    return rows.groupBy(F.when(F.col("_done"), "done").otherwise("not found").alias("outcome")).agg(F.count("*").alias("n"))


def first_pages(pages: DataFrame) -> DataFrame:
    """(path, head): the first page's text of each book."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("page"))
    return pages.withColumn("_place", place).filter("_place = 1").select("path", F.col("text").alias("head"))
