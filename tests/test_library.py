"""Titles, years, topics, books, tables and streams."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import titles, years
from folioscope.operators import library, topics, vectors
from folioscope.sources import files
from folioscope.sources.tables import Versioned, inserted_or_ignored, upserted
from folioscope.streaming import jobs

DEGENERATE = ["vk_com", "-ne", "{ABCDEF}", "____", "( )", "_", "  "]
NAMES = ["Hand_Tools-ne", "THE COMPLETE BOOK", "Jig ((x))", "A - - B", "Wood {AB12CD34}", "1902Plain Joinery", "Boxes [ ] (2nd)", "ISBN-CNC WORK", *DEGENERATE]


def test_display_name_invariants(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "raw string").withColumn("clean", titles.display_name(F.col("raw"))).withColumn("again", titles.display_name(F.col("clean")))
    for r in df.withColumn("shown", titles.display_title(F.lit(None).cast("string"), F.col("raw"))).collect():
        assert r.again == r.clean
        assert len(r.clean) <= len(r.raw)
        assert "_" not in r.clean and "((" not in r.clean
        assert r.shown.strip() or not r.raw.strip()


@pytest.mark.parametrize(
    ("title", "head", "tail", "year"),
    [
        ("x", "© 1979 Press", "", 1979), ("x", "COPYRIGHT 1912 A. WRITER   FOURTH EDITION. 1917", "", 1917), ("x", "only $1995 each", "", None), ("x", "circa 1880", "", None),
        ("2001 A Guide", "", "", 2001), ("x", "", "originally published 1890", 1890), ("x", "", "", None), (None, None, None, None),
    ],
)
def test_detect(title, head, tail, year):
    assert years.detect(title, head, tail).year == year


def test_quick_year():
    assert years.quick_year("1900 1900 1950") == 1900
    assert years.quick_year("1900 1900 copyright 1950") == 1950
    assert years.quick_year(None) is None


def test_decision(spark):
    rows = [(None, 1900, 90, False), (1950, 1900, 90, False), (1950, 1900, 65, True), (1950, 1950, 99, False), (None, 1900, 30, False), (1950, None, 0, False)]
    df = spark.createDataFrame(rows, "stored int, year int, confidence int, title_only boolean")
    found = F.struct("year", "confidence", F.lit("").alias("why"), "title_only")
    got = [r.a for r in df.select(years.decision(F.col("stored"), found)["action"].alias("a")).collect()]
    assert got == ["assign", "replace", "keep", "keep", "none", "keep"]


def test_npmi_bounds(spark):
    df = spark.createDataFrame([(0, 5, 5, 10), (5, 5, 5, 10), (10, 10, 10, 10), (1, 10, 5, 100)], "c long, g long, q long, n long")
    got = [r[0] for r in df.select(topics.npmi(*(F.col(x) for x in "cgqn"))).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(1.0) and got[2] == 0 and -1 <= got[3] <= 1


def test_typo_pairs_equal_brute_force(spark):
    names = ["abc", "abd", "ab", "abcd", "bac", "xyz", "ABC", "abce", "a"]
    freq = spark.createDataFrame([(n, 10 if n == "abc" else 1) for n in names], "tag string, freq long")
    got = {(r.tag, r.main) for r in topics.typo_pairs(freq, 5).collect()}
    assert got == {("abd", "abc"), ("ab", "abc"), ("abcd", "abc"), ("abce", "abc")}


def test_shared_budget():
    budget = topics.Budget()
    assert topics.merge_pool([("A", 1, 0.9)], [("b", 1, 0.5), ("a", 1, 0.8)], [("B", 2, 0.5)], 3) == [("B", 2, 0.5)]
    assert budget.used == {}


def test_vectors(spark):
    texts = spark.createDataFrame([(1, "x" * 50), (2, "short"), (3, "y" * 50)], "rowid long, text string")
    old = spark.createDataFrame([(1, [1.0, 0.0], "m"), (9, [0.0, 1.0], "m"), (3, [1.0, 1.0], "other")], "rowid long, vec array<float>, model_id string")
    built = vectors.build(texts, old, lambda t: [[3.0, 4.0] for _ in t], "m").orderBy("rowid").collect()
    assert [(r.rowid, r.model_id) for r in built] == [(1, "m"), (3, "m")]
    assert built[1].vec == pytest.approx([0.6, 0.8])
    row = vectors.coverage(texts, old).first()
    assert (row.pages, row.skipped, row.embedded, row.pct) == (3, 1, 2, 100)
    assert [r.rowid for r in vectors.top_k(old, [1.0, 0.0], 2).collect()] == [1, 3]


def test_books_and_copies(spark):
    src = spark.createDataFrame([("c", "a", "/l/a.pdf", 3, 3, 9, "indexed", None, "keep"), ("c", "a2", "/L/A.pdf", 3, 3, 9, "indexed", None, "keep"), ("c", "gone", "/l/gone.pdf", 1, 1, 1, "indexed", None, "keep")], "collection string, title string, path string, pages int, indexed_pages int, chars int, status string, pub string, pub_src string")
    disk = spark.createDataFrame([("/l/a.pdf", 5), ("/l/a (1).pdf", 5)], "path string, length long")
    none = spark.createDataFrame([], "id long, path string, title string, status string, detail string, updated double")
    years_of = spark.createDataFrame([("/l/a.pdf", 1950)], "key string, year int")
    got = {r.file: r for r in library.books(disk, src, none, years_of).collect()}
    assert got["/l/gone.pdf"].status == "missing" and got["/l/a (1).pdf"].status == "not-indexed"
    assert got["/l/a (1).pdf"].dup_of is not None
    kept = next(r for f, r in got.items() if f.lower() == "/l/a.pdf")
    assert (kept.dup, kept.year, kept.copies) == (1, 1950, 2)
    assert library.fix_duplicates(src, disk).filter(F.lower("path") == "/l/a.pdf").first().path == "/l/a.pdf"
    new = library.new_files(disk, src, none)
    assert [r.path for r in new.collect()] == ["/l/a (1).pdf"]


def test_versioned_tables(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    table.write(rows((1, "a"), (2, "b")))
    table.upsert(rows((2, "c"), (3, "d")), ["k"])
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    table.delete(rows((1, "")), ["k"])
    assert table.versions() == [2, 3]
    assert {r.k for r in table.read().collect()} == {2, 3}
    assert {r.v for r in inserted_or_ignored(rows((1, "a")), rows((1, "x"), (2, "y")), ["k"]).collect()} == {"a", "y"}
    assert upserted(rows(), rows((1, "a")), ["k"]).count() == 1


def test_files(spark):
    df = spark.createDataFrame([("/r/a.pdf", 2), ("/r/~$a.pdf", 1), ("/r/.x/a.pdf", 1), ("/r/Skip/a.pdf", 1), ("/r/b.PDF", 1), ("/r/c.txt", 1), ("/r/a.pdf.part", 1)], "path string, length long")
    assert [r.path for r in files.walk(df, ["skip"]).collect()] == ["/r/b.PDF", "/r/a.pdf"]
    got = [r[0] for r in df.limit(1).select(files.collection_of(F.lit("/r/c/x.pdf"), "/r")).collect()]
    assert got == ["c"]
    assert df.limit(1).select(files.rerooted(F.lit("D:\\old\\Books\\a\\b.pdf"), "/new", "Books")).first()[0] == "/new/a/b.pdf"


def test_page_extraction(spark):
    df = spark.createDataFrame([("a", bytearray(b"x\fy")), ("b", bytearray(b""))], "path string, content binary")

    def reader(path, content):
        if not content:
            raise ValueError("empty")
        return content.decode().split("\f"), None, "T"

    got = {(r.path, r.page, r.text, r.error) for r in files.pages(df, reader).collect()}
    assert got == {("a", 1, "x", None), ("a", 2, "y", None), ("b", None, None, "extract-error: empty")}


def test_file_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.pdf").write_bytes(b"1")
    (root / "b.txt").write_bytes(b"1")
    seen = []
    for _ in range(2):
        stream = jobs.ingest(jobs.arrivals(spark, str(root)), lambda b: seen.extend(r.path for r in b.select("path").collect()), str(tmp_path / "ck")).trigger(availableNow=True).start()
        stream.awaitTermination(60)
    assert [p.rsplit("/", 1)[1] for p in seen] == ["a.pdf"]


def test_job_stream_is_idempotent(spark, tmp_path):
    events = [(1, "/a", "a", "queued", "", 1.0), (2, "/a", "a", "done", "", 3.0), (3, None, "b", "idle", "", 4.0), (4, None, "b", "failed", "x", 2.0), (5, "/a", "a", "indexing", "", 2.0)]
    source = tmp_path / "events"
    table = Versioned(spark, str(tmp_path / "state"))
    for i, part in enumerate((events[:2], events[2:], events[:1])):
        spark.createDataFrame(part, jobs.EVENT).coalesce(1).write.mode("append").json(str(source))
        stream = jobs.keep_states(spark.readStream.schema(jobs.EVENT).json(str(source)), table, str(tmp_path / "ck")).trigger(availableNow=True).start()
        stream.awaitTermination(60)
    assert {(r.job, r.status) for r in table.read().collect()} == {("/a", "done"), ("b", "failed")}


def test_appends_leave_what_is_there(spark, tmp_path, monkeypatch):
    """An appended version holds its own rows; after some of them a whole one follows."""
    monkeypatch.setattr("folioscope.sources.tables.CHAIN", 2)
    table = Versioned(spark, str(tmp_path / "t"))
    table.append(spark.createDataFrame([(1, "a")], "id long, x string"))
    table.append(spark.createDataFrame([(2, "b", 5)], "id long, x string, y int"))
    assert spark.read.parquet(f"{tmp_path}/t/v=2").count() == 1
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "a", None), (2, "b", 5)]
    for i in range(3, 8):
        table.append(spark.createDataFrame([(i, "c")], "id long, x string"))
    assert sorted(r.id for r in table.read().collect()) == list(range(1, 8))
    assert sorted(r.id for r in table.read(2).collect()) == [1, 2] if 2 in table.versions() else True
    (tmp_path / "t" / "v=99").mkdir()  # a job that was lost before it wrote anything
    assert table.read().count() == 7
    table.delete(spark.createDataFrame([(1,)], "id long"), ["id"])
    assert table.read().count() == 6


def test_vectors_in_batches(spark, tmp_path):
    """Each batch is kept, a stopped build goes on, a changed model begins anew, a reset empties."""
    texts = spark.createDataFrame([(i, f"a text that is long enough number {i}") for i in range(20)] + [(99, "short")], "rowid long, text string")
    table, model = Versioned(spark, str(tmp_path / "v")), lambda xs: [[float(len(x)), 1.0] for x in xs]
    stops = iter([False, True])
    first = list(vectors.build_in_batches(texts, table, model, "m1", 10, rows=7, stop=lambda: next(stops)))
    assert len(first) == 1 and table.read().count() == first[0][0] < 20
    assert list(vectors.build_in_batches(texts, table, model, "m1", 10, rows=7))[-1] == (20 - first[0][0], 20 - first[0][0])
    assert table.read().select("rowid").distinct().count() == table.read().count() == 20
    assert list(vectors.build_in_batches(texts.filter("rowid < 5"), table, model, "m1", 10)) == [] and table.read().count() == 5
    assert list(vectors.build_in_batches(texts, table, model, "m2", 10))[-1] == (20, 20)
    vectors.reset(table)
    assert table.read().count() == 0


def test_delete_by_exact_spelling(spark):
    pages = spark.createDataFrame([(1, "/A/x.pdf"), (2, "/a/x.pdf"), (3, "/a//X.pdf")], "rowid long, path string")
    years_of = spark.createDataFrame([(1, 1900), (2, 1901), (3, 1902)], "rowid long, year int")
    gone = spark.createDataFrame([("/a/x.pdf",)], "path string")
    left, counts = library.delete_cascade(gone, {"pages": pages, "years": years_of}, exact=True)
    assert counts.first() == (1, 1) and [r.rowid for r in left["years"].orderBy("rowid").collect()] == [1, 3]
    assert library.delete_cascade(gone, {"pages": pages, "years": years_of})[1].first() == (3, 3)


def test_collections_below_odd_roots(spark):
    df = spark.createDataFrame([("/my (lib)+/books/a.pdf",), ("/my (lib)+/a.pdf",), ("/my xlib)+/books/a.pdf",)], "path string")
    assert [r[0] for r in df.select(files.collection_of(F.col("path"), "/my (lib)+")).collect()] == ["books", "inbox", ""]


def test_stop_words_are_whole():
    assert len(topics.STOPWORDS) >= 290 and {"wood", "beyond", "neither", "heavy", "shop"} <= set(topics.STOPWORDS)
