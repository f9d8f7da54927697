"""What a file is called: publication names from folders, metadata and mastheads, as expressions.

A file name that names a work is never rewritten.  Otherwise the folder decides, then the file's own
title, then a known name in its first page; what can't be named keeps its file name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known publications, structural names, scaffolding words, title keywords, kept capitals, patterns.
KNOWN_PUBLICATIONS = (
    "Fine Woodworking", "Popular Woodworking", "Fine Homebuilding", "The Woodworker's Journal", "Woodworker's Journal", "Shop Notes",
    "American Woodworker", "Modern Woodworking", "Family Handyman", "Popular Mechanics", "Woodsmith",
)
STRUCTURAL = r"(?i)^(?:books?|pdfs?|magazines?|issues?|serie[sz]es?|new\s+books?|archive|downloads?|library|scans?|various|misc|\d{3,4})$"
SCAFFOLDING = r"(?i)^\W*(?:issue|issues|no|nos?|number|part|vol|volume|final|draft|v\d+|scan|copy|new|old|full|complete|the|a|an)\W*$"
TITLE_KEYWORDS = ("wood", "magazine", "journal", "issue", "shop", "craft", "work", "home")
CAPITALS = ("USA", "UK", "EU", "PDF", "DVD", "CD", "CNC", "3D", "TAO", "ISBN", "EST", "USSR")
ISSUE_NUMBER = r"(?i)(?:no\.?|issue|#)?[\s_\-–—.]*(\d{1,4})\s*$"
FENCE = r"[_\-–—.,:;]+"
ONLY_NUMBER = r"^[\s_\-–—.]*\d{1,5}[\s_\-–—.]*$"
VERSION = r"(?i)\bv\d+\s*$"
FOLDER_YEAR = r"^(.*?)[\s_\-]*\d{4}$"
JUNK_BETWEEN_WORDS = "[^a-zA-Z0-9]{0,6}"
EMPTY_BRACKETS = r"\(\s*\)|\[\s*\]|\{\s*\}"
HASH_TAIL = r"(?i)\s*\{[0-9a-f]{6,}\}$"
NE_TAIL = r"(?i)[-_]ne(?:[_ .-]?en)?\b[\s.-]*$"
DASH_RUN = r"\s*[-–—]\s*[-–—]\s*"
LEADING_YEAR = r"^\s*(1[6-9]\d\d|20[0-2]\d)\b"
LATER_YEAR = r"(?<![\w-])(1[6-9]\d\d|20[0-2]\d)\b"
SITE_MARKS = r"(?i)(^|[\s_(\[])(?:vk[_ .-]?com[_ .-]?en(?:glishmagazines)?|englishmagazines?|pdfdrive|libgen|annas-?archive|vk[_ .-]?com(?:[_ .-]?en)?)([\s_)\]]*)"


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def stem(path: Column) -> Column:
    """File name without its extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def issue(path: Column) -> Column:
    """Number of an issue at the end of the name; a version marker is none."""
    name = F.btrim(stem(path))
    return F.when(name.rlike(VERSION), F.lit(None)).otherwise(F.nullif(F.regexp_extract(name, ISSUE_NUMBER, 1), F.lit("")))


def named_by_file(path: Column) -> Column:
    """The name that a file name states, or null: it needs one word of three letters that isn't scaffolding."""
    raw = F.btrim(stem(path))
    name = F.regexp_replace(F.regexp_replace(raw, ISSUE_NUMBER, ""), FENCE, " ")
    name = F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"^[ .\-]+|[ .\-]+$", "")
    telling = F.exists(F.split(name, " "), lambda w: (F.char_length(w) >= 3) & ~w.rlike(SCAFFOLDING))
    bad = raw.rlike(ONLY_NUMBER) | (name == "") | name.rlike(STRUCTURAL) | ~telling
    return F.when(~bad, name)


def named_by_folder(collection: Column) -> Column:
    """The folder's name without a year at its end, unless it only gives structure."""
    c = F.btrim(F.coalesce(collection, F.lit("")))
    before = F.btrim(F.regexp_extract(c, FOLDER_YEAR, 1))
    return F.when((c == "") | c.rlike(STRUCTURAL), F.lit(None)).when(before != "", before).otherwise(c)


def named_by_metadata(title: Column) -> Column:
    """A file's own title if it is short and sounds like a publication."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "), r"^[ ._\-]+|[ ._\-]+$", "")
    low = F.lower(t)
    fits = low.rlike("|".join(TITLE_KEYWORDS)) & ~low.endswith(".pdf") & (F.char_length(t) <= 90)
    return F.when((t != "") & fits, t)


def named_by_masthead(text: Column, publications: tuple[str, ...] = KNOWN_PUBLICATIONS) -> Column:
    """The first known publication in a text, with up to six odd characters between its words."""
    def pattern(name: str) -> str:
        return "(?i)" + JUNK_BETWEEN_WORDS.join(r"\Q" + w + r"\E" for w in name.split())

    return F.coalesce(*(F.when(text.rlike(pattern(p)), F.lit(p)) for p in publications), F.lit(None))


def combined(name: Column, number: Column) -> Column:
    return F.when(number.isNull(), name).otherwise(F.concat(name, F.lit(" No. "), number))


def resolve(path: Column, collection: Column, meta_title: Column, head_text: Column) -> Column:
    """struct(pub, pub_src): the derived name, null where the file names itself or nothing is found."""
    number = issue(path)
    folder, meta, mast = named_by_folder(collection), named_by_metadata(meta_title), named_by_masthead(head_text)
    out = lambda name, src: F.struct(name.cast("string").alias("pub"), F.lit(src).alias("pub_src"))
    return (
        F.when(named_by_file(path).isNotNull(), out(F.lit(None), "keep"))
        .when(folder.isNotNull(), out(combined(folder, number), "folder"))
        .when(meta.isNotNull(), out(combined(meta, number), "metadata"))
        .when(mast.isNotNull(), out(combined(mast, number), "masthead"))
        .otherwise(out(F.lit(None), "fallback"))
    )


def display_name(name: Column) -> Column:
    """A file name made readable; may be empty, then the caller shows the name as it is."""
    t = F.btrim(F.coalesce(name, F.lit("")))
    t = F.regexp_replace(t, SITE_MARKS, "$1$2")
    t = F.regexp_replace(t, EMPTY_BRACKETS, "")
    t = F.regexp_replace(t, HASH_TAIL, "")
    t = F.regexp_replace(t, NE_TAIL, "")
    t = F.translate(t, "_", " ")
    t = F.regexp_replace(t, DASH_RUN, " - ")
    t = F.btrim(F.regexp_replace(t, r"\s{2,}", " "))
    # words of four capitals or more get one; cut between words, so that each piece is a word or what joins them
    edge = r"(?<=[\s\-–—(/&:.,)])|(?=[\s\-–—)/:.,&(])"
    before = lambda parts, i: F.when(i == 0, F.lit(" ")).otherwise(F.element_at(parts, i))
    parts = F.split(t, edge)
    calm = F.transform(
        parts,
        lambda w, i: F.when(w.rlike("^[A-Z]{4,}$") & ~w.isin(*CAPITALS) & before(parts, i).rlike(r"[\s\-–—(/&]$"), F.concat(F.substring(w, 1, 1), F.lower(F.substr(w, F.lit(2))))).otherwise(w),
    )
    t = F.array_join(calm, "")
    return F.regexp_replace(F.regexp_replace(t, r"\({2,}", "("), r"\){2,}", ")")


def display_title(pub: Column, title: Column) -> Column:
    """What is shown: the derived name or else the title, cleaned, never blank."""
    shown = F.coalesce(F.nullif(pub, F.lit("")), title)
    return F.coalesce(F.nullif(display_name(shown), F.lit("")), shown)


def leading_year(title: Column) -> Column:
    """A year that begins a title, else the latest year in it from 1850 on that is no part of a number."""
    first = F.regexp_extract(title, LEADING_YEAR, 1)
    later = F.filter(F.transform(F.regexp_extract_all(title, F.lit(LATER_YEAR), F.lit(1)), lambda y: y.cast("int")), lambda y: y >= 1850)
    return F.when(first != "", first.try_cast("int")).otherwise(F.array_max(later))
