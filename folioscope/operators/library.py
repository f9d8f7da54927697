"""Books, sources and jobs: keys, classification, statuses, copies, counters, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.analysis import stripped_length
from folioscope.functions.titles import basename, display_name, display_title, named_by_folder, stem


# ---- keys ---------------------------------------------------------------------------------------------------

def path_key(path: Column, fold_case: bool = True) -> Column:
    """One spelling for a path: forward slashes, none doubled; case folded where the file system does."""
    plain = F.regexp_replace(path, r"[\\/]+", "/")
    return F.lower(plain) if fold_case else plain


def copy_key(path: Column) -> Column:
    """Folder and name without extension and a copy's `` (n)``, in lower case."""
    plain = F.regexp_replace(path, r"[\\/]+", "/")
    folder = F.regexp_extract(plain, r"^(.*/)?[^/]*$", 1)
    return F.lower(F.concat(folder, F.regexp_replace(stem(path), r"\s*\(\d+\)$", "")))


# ---- ingest ---------------------------------------------------------------------------------------------------

def text_pages(pages: DataFrame, least: int = 40) -> DataFrame:
    return pages.filter(stripped_length("text") >= least)


def classify(pages: DataFrame, least: int = 40, ratio: float = 0.15, key: str = "path") -> DataFrame:
    """Per file: pages, indexed_pages, chars of the kept pages, and whether it has text at all."""
    kept = stripped_length(F.coalesce(F.col("text"), F.lit(""))) >= least
    out = pages.groupBy(key).agg(
        F.count("*").alias("pages"), F.count_if(kept).alias("indexed_pages"), F.coalesce(F.sum(F.when(kept, F.char_length("text"))), F.lit(0)).alias("chars")
    )
    return out.withColumn("status", F.when(F.col("indexed_pages") / F.col("pages") < ratio, "image-only").otherwise("indexed"))


def head_tail(pages: DataFrame, head: int = 6, tail: int = 4, key: str = "path", page: str = "page") -> DataFrame:
    """Texts of the first and the last pages of each book, in order."""
    up, down = Window.partitionBy(key).orderBy(F.asc(page)), Window.partitionBy(key).orderBy(F.desc(page))
    few = pages.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)}).filter((F.col("_up") <= head) | (F.col("_down") <= tail))
    joined = lambda cond: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("_up", "text")))), lambda x: x["text"]))
    return few.groupBy(key).agg(joined(F.col("_up") <= head).alias("head"), joined(F.col("_down") <= tail).alias("tail"))


def new_files(files: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files that are neither indexed nor marked as merged copies; failed ones come again."""
    known = sources.select(path_key(F.col("path")).alias("_key")).unionByName(jobs.filter("status = 'duplicate'").select(path_key(F.col("path")).alias("_key")))
    return files.withColumn("_key", path_key(F.col("path"))).join(known.distinct(), "_key", "left_anti").drop("_key")


# ---- jobs -----------------------------------------------------------------------------------------------------

def latest(jobs: DataFrame, keys: list[str], order: str = "updated", tie: str = "id") -> DataFrame:
    """The newest row of each key."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    return jobs.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").drop("_place")


def job_states(events: DataFrame) -> DataFrame:
    """The newest event of each path, or of each title where there is no path; idle signs don't count."""
    real = events.filter(F.col("status") != "idle").withColumn("job", F.coalesce(F.nullif("path", F.lit("")), "title"))
    row = F.max_by(F.struct("path", "title", "status", "detail", "updated"), F.struct("updated", "status", "detail"))
    return real.filter(F.col("job").isNotNull()).groupBy("job").agg(row.alias("r")).select("job", "r.*")


def jobs_with_titles(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs with what their source is called; the first source of a path counts."""
    first = Window.partitionBy("path").orderBy("title")
    own = sources.withColumn("_place", F.row_number().over(first)).filter("_place = 1").select("path", display_title(F.col("pub"), F.col("title")).alias("shown"))
    return jobs.join(own, "path", "left").withColumn("shown", F.coalesce("shown", "title"))


# ---- books ----------------------------------------------------------------------------------------------------

ACTIVE = ("indexing", "ocr_running", "queued", "extracting", "failed")


def effective_status(stored: Column, job: Column, duplicate: Column, exists: Column) -> Column:
    """Duplicate, else missing, else what a job does just now, else what is stored."""
    live = F.when(job.isin(*ACTIVE), job).otherwise(F.coalesce(stored, F.lit("not-indexed")))
    return F.when(duplicate, "duplicate").when(~exists, "missing").otherwise(live)


def book_years(pages: DataFrame, key: str = "path") -> DataFrame:
    """The most frequent year of each book, the earliest at a tie; rows without a year don't count."""
    counts = pages.filter(F.col("year").isNotNull() & (F.col("year") != 0)).groupBy(key, "year").agg(F.count("*").alias("c"))
    return counts.groupBy(key).agg(F.max_by("year", F.struct(F.col("c"), -F.col("year"))).alias("year"))


def books(files: DataFrame, sources: DataFrame, jobs: DataFrame, years: DataFrame) -> DataFrame:
    """One row for each book, indexed or not: files and sources meet on their path keys.

    files(path, length), sources(path, title, collection, pages, indexed_pages, chars, status, pub,
    pub_src), jobs(path, title, status, detail, updated, id), years(key, year).
    """
    first = Window.partitionBy("key").orderBy("path", "title")
    src = sources.withColumn("key", path_key(F.col("path"))).withColumns({"place": F.row_number().over(first), "n": F.count("*").over(Window.partitionBy("key"))})
    src = src.filter("place = 1").select("key", *(F.col(c).alias(f"s_{c}") for c in ("path", "title", "collection", "pages", "indexed_pages", "chars", "status", "pub", "pub_src")), (F.col("n") - 1).alias("dup"))
    own = files.select(path_key(F.col("path")).alias("key"), F.col("path").alias("f_path"), "length").dropDuplicates(["key"])
    keyed = jobs.withColumn("key", path_key(F.col("path")))
    now = latest(keyed.filter(F.col("path").isNotNull()), ["key"]).select("key", F.col("status").alias("job"), "detail")
    marked = keyed.filter("status = 'duplicate'").select("key").distinct().withColumn("marked", F.lit(True))
    rows = own.join(src, "key", "full_outer").join(now, "key", "left").join(marked, "key", "left").join(years, "key", "left")
    path = F.coalesce("s_path", "f_path")
    rows = rows.select(
        display_title(F.lit(None).cast("string"), F.coalesce(F.col("s_title"), stem(path))).alias("title"),
        path.alias("file"),
        F.col("f_path").isNotNull().alias("exists"),
        *(F.coalesce(f"s_{c}", F.lit(0)).alias(c) for c in ("pages", "indexed_pages", "chars")),
        effective_status(F.col("s_status"), F.col("job"), F.coalesce("marked", F.lit(False)), F.col("f_path").isNotNull()).alias("status"),
        F.coalesce("detail", F.lit("")).alias("detail"),
        F.coalesce("length", F.lit(0)).alias("size"),
        "year",
        F.coalesce("dup", F.lit(0)).alias("dup"),
        display_name(F.coalesce(F.col("s_pub"), F.when(F.col("s_path").isNull(), named_by_folder(F.col("s_collection"))))).alias("pub"),
        "s_pub_src",
        basename(path).alias("pdf_name"),
        F.coalesce("s_collection", F.lit("")).alias("collection"),
    ).withColumnRenamed("s_pub_src", "pub_src")
    return with_copies(rows)


def with_copies(rows: DataFrame) -> DataFrame:
    """Marks copies (`x.pdf` beside `x (1).pdf`): the kept one counts them, the others name it."""
    group = Window.partitionBy("copy")
    order = group.orderBy(F.col("status") == "duplicate", F.contains(F.col("pdf_name"), F.lit("(")), "file")
    out = rows.withColumn("copy", copy_key(F.col("file"))).withColumns({"_n": F.count("*").over(group), "_place": F.row_number().over(order), "_keep": F.first("title").over(order)})
    return out.withColumns({"copies": F.when((F.col("_n") > 1) & (F.col("_place") == 1), F.col("_n")), "dup_of": F.when(F.col("_place") > 1, F.col("_keep"))}).drop("_n", "_place", "_keep")


def in_book_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("status") == "missing", F.lower("collection"), "copy", "file")


def collection_counts(rows: DataFrame) -> DataFrame:
    name = F.when(F.coalesce("collection", F.lit("")) == "", "(none)").otherwise(F.col("collection"))
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def counters(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: books, pages and characters indexed, image-only books, active and failed jobs, double paths."""
    a = sources.agg(
        F.count("*").alias("books"), F.coalesce(F.sum("indexed_pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.count_if(F.col("status") == "image-only").alias("image_only")
    )
    b = jobs.agg(F.count_if(~F.col("status").isin("done", "failed", "image-only", "duplicate")).alias("active"), F.count_if(F.col("status") == "failed").alias("failed"))
    c = duplicate_paths(sources).agg(F.count("*").alias("double_indexed"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def duplicate_paths(sources: DataFrame) -> DataFrame:
    return sources.groupBy(path_key(F.col("path")).alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


def fix_duplicates(sources: DataFrame, files: DataFrame) -> DataFrame:
    """One source for each path key: the one spelled like the file on disk, else the first."""
    disk = files.select(F.col("path").alias("_disk")).distinct()
    order = Window.partitionBy("_key").orderBy(F.col("_disk").isNull(), "path", "title")
    out = sources.withColumn("_key", path_key(F.col("path"))).join(disk, F.col("path") == F.col("_disk"), "left")
    return out.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_key", "_disk", "_place")


def spellings(sources: DataFrame, path: str) -> DataFrame:
    """All stored spellings of one path."""
    return sources.filter(path_key(F.col("path")) == path_key(F.lit(path))).select("path").distinct()


def delete_cascade(gone: DataFrame, tables: dict[str, DataFrame], pages: str = "pages", exact: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each table without the books of ``gone`` (path), and a row of counts.

    Tables with a path lose its rows; tables keyed by rowid lose those of the deleted pages.  With
    ``exact`` only rows of that very spelling go, else all that name the same file.
    """
    key = (lambda: F.col("path")) if exact else (lambda: path_key(F.col("path")))
    keys = gone.select(key().alias("_key")).distinct()
    ids = tables[pages].withColumn("_key", key()).join(keys, "_key", "left_semi").select("rowid")
    left, counts = {}, None
    for name, table in tables.items():
        if "path" in table.columns:
            keyed = table.withColumn("_key", key())
            left[name], lost = keyed.join(keys, "_key", "left_anti").drop("_key"), keyed.join(keys, "_key", "left_semi")
        else:
            left[name], lost = table.join(ids, "rowid", "left_anti"), table.join(ids, "rowid", "left_semi")
        n = lost.agg(F.count("*").alias(name))
        counts = n if counts is None else counts.crossJoin(n)  # one row each
    return left, counts


def archive_summary(mapping: DataFrame, pages: DataFrame) -> DataFrame:
    """Per archived file: its title and collection, pages, characters, last page (as a number)."""
    rows = mapping.join(pages, "rowid")
    return rows.groupBy("pdf_path").agg(
        F.min("title").alias("title"), F.min("collection").alias("collection"), F.count("*").alias("n_pages"), F.sum(F.char_length("text")).alias("chars"), F.max(F.expr("try_cast(page AS int)")).alias("last_page")
    )


def applied(rows: DataFrame, plan: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with the plan's new values in a column; a plan is (key, new)."""
    return rows.join(plan.select(key, F.col("new").alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def tally(plan: DataFrame, column: str = "action") -> DataFrame:
    return plan.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
