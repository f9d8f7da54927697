"""Files: walking a library, what to ignore, stability, page extraction by injected readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Marks of files that no one meant to index.
IGNORED_PREFIXES = ("~$", "._", "_tmp_")
IGNORED_SUFFIXES = (".tmp", ".part", ".crdownload", ".bak", ".log")


def ignorable(path: Column) -> Column:
    """Files that are no PDF, or bear the mark of an unfinished download."""
    name = F.lower(F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1))
    marks = [name.startswith(p) for p in IGNORED_PREFIXES] + [name.endswith(s) for s in IGNORED_SUFFIXES]
    out = ~name.endswith(".pdf")
    for m in marks:
        out = out | m
    return out


def in_skipped_folder(path: Column, skip: list[str]) -> Column:
    """Whether a folder on the way is named in ``skip`` (in any case) or begins with a dot."""
    folders = F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^[a-z]+:/+", ""), "/")
    above = F.slice(folders, 1, F.greatest(F.lit(0), F.size(folders) - 1))
    low = [s.lower() for s in skip]
    return F.exists(above, lambda f: f.startswith(".") | F.lower(f).isin(low) if low else f.startswith("."))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length of all files below ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")


def walk(files: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """The indexable files of a listing, small ones first."""
    return files.filter(~ignorable(F.col("path")) & ~in_skipped_folder(F.col("path"), skip or [])).orderBy("length", "path")


def stable(files: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Files that have a size and haven't changed for so long; the rest come with the next batch."""
    return files.filter((F.col("length") > 0) & (F.col("modificationTime") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(seconds))))


def pages(files: DataFrame, extract: Callable[[str, bytes], tuple[list[str], str | None, str]]) -> DataFrame:
    """path, page, text, meta_title, error: one row a page, by a reader (path, content) -> (pages, error, title).

    A file that can't be read gives one row with its error and no page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    texts, error, title = extract(path, bytes(content))
                except Exception as e:  # a broken file must not stop the others
                    texts, error, title = [], f"extract-error: {e}", ""
                rows += [(path, i + 1, t, title, None) for i, t in enumerate(texts)] or [(path, None, None, title, error or "no pages")]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "meta_title", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, meta_title string, error string")


def scanned_pages(images: DataFrame, engine: Callable[[bytes], list[str]], least: int = 25) -> DataFrame:
    """Pages read by an injected OCR engine (image -> segments); segments joined, short pages dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [" ".join(engine(bytes(x))).strip() for x in b["image"]]
            out = b[["path", "page"]].assign(text=texts)
            yield out[out["text"].str.len() >= least]

    return images.select("path", "page", "image").mapInPandas(run, "path string, page int, text string")


def rerooted(path: Column, root: str, library: str) -> Column:
    """A stored path under ``root``, found behind the library folder's last occurrence in it."""
    plain = F.regexp_replace(path, r"\\", "/")
    tail = F.substring_index(plain, f"/{library}/", -1)
    return F.when(F.instr(plain, f"/{library}/") > 0, F.concat(F.lit(root.rstrip("/") + "/"), tail)).otherwise(path)


def collection_of(path: Column, root: str, inbox: str = "inbox") -> Column:
    """First folder below the root; files directly in it belong to the inbox."""
    plain, above = F.regexp_replace(path, r"\\", "/"), root.rstrip("/") + "/"
    below = F.when(plain.startswith(above), F.substr(plain, F.lit(len(above) + 1))).otherwise(plain)
    return F.when(F.instr(below, "/") > 0, F.substring_index(below, "/", 1)).otherwise(F.lit(inbox))
