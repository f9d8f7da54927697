"""The engine's operators on the driver's tables, one query each; ``oracles`` has the same in SQL.

``documents`` stands for a library's pages: doc_id is the row, lang the collection, source the work; the
year of a row is derived from its id.  The index over it is built once a session and table version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.engine import Engine, Library
from folioscope.functions import titles, udtf, years
from folioscope.functions.analysis import ascii_words, fold, light_stems, unmark
from folioscope.operators import library, postings, ranking, repairs, topics, vectors
from folioscope.operators.postings import Index
from folioscope.plans import querylang
from folioscope.plans.matching import matched, phrase_counts
from folioscope.plans.querylang import Query
from folioscope.sources import files as sources_files
from folioscope.sources.tables import by_id_list, fingerprint, inserted_or_ignored, merge_schema, read, scratch, upserted
from folioscope.streaming.jobs import retained, since, tidied

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# ---- the tables as a library -----------------------------------------------------------------------------

def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("doc_id") % 7 != 0, (1900 + F.col("doc_id") % 120).cast("int"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("rowid"), "text", F.col("lang").alias("collection"), F.col("source").alias("title"), F.col("doc_id").cast("string").alias("page"), F.col("source").alias("path"), year.alias("year")
    )


_indexes: dict[tuple, Index] = {}


def index_of(spark: SparkSession, sf_dir: str, analyser: str = "simple") -> Index:
    """The persisted index of ``documents``; a changed set of files is indexed anew."""
    texts = pages(spark, sf_dir)
    key = (spark.sparkContext.applicationId, tuple(sorted(texts.inputFiles())), analyser)
    if key not in _indexes:
        path = scratch(spark)
        postings.save(texts, path, ["collection", "title", "year"], analyser)
        _indexes[key] = postings.load(spark, path, analyser)
    return _indexes[key]


def found(spark: SparkSession, sf_dir: str, groups: tuple, excluded: tuple = ()) -> DataFrame:
    """Matched rows with score and attributes."""
    index = index_of(spark, sf_dir)
    return matched(index, Query(groups, excluded)).join(index.docs.drop("doc_len"), "rowid")


def best(rows: DataFrame, n: int = 20, *columns: str) -> DataFrame:
    return ranking.top(rows, n, F.desc("score"), F.asc("rowid")).select("rowid", *columns, F.round("score", 6).alias("score"))


def one_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rowid"), F.col("embedding").alias("vec"))


def orders_as_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an article, the brands of its parts are its tags."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_orderkey").alias("rowid")).agg(F.concat_ws("; ", F.array_sort(F.collect_list("p_brand"))).alias("taxonomy"))


def events_as_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("/lib/"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("path"), F.col("user_id").cast("string").alias("title"),
        F.col("event_type").alias("status"), F.coalesce(F.col("props"), F.lit("")).alias("detail"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("updated"),
    )


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sources`` of the library: one row for each work."""
    own = library.classify(pages(spark, sf_dir))
    extra = pages(spark, sf_dir).groupBy("path").agg(F.min("collection").alias("collection"))
    return own.join(extra, "path").select("collection", F.col("path").alias("title"), "path", "pages", "indexed_pages", "chars", "status", F.lit(None).cast("string").alias("pub"), F.lit("keep").alias("pub_src"))


# ---- full text -----------------------------------------------------------------------------------------

@query
def bm25_term(spark, sf_dir):
    return best(found(spark, sf_dir, (("with",),)))


@query
def bm25_and(spark, sf_dir):
    return best(found(spark, sf_dir, (("with",), ("from",))))


@query
def bm25_or_group(spark, sf_dir):
    return best(found(spark, sf_dir, (("this", "that", "était"),)))


@query
def bm25_not(spark, sf_dir):
    return best(found(spark, sf_dir, (("with",),), ("from",)))


@query
def phrase_match(spark, sf_dir):
    return best(found(spark, sf_dir, (("of the",), ("in",))))


@query
def phrase_frequency(spark, sf_dir):
    return phrase_counts(index_of(spark, sf_dir), [["of", "the"], ["the"], ["de", "la"]]).select("phrase", "rowid", F.col("f").alias("f"))


@query
def search_filtered(spark, sf_dir):
    rows = found(spark, sf_dir, (("with",),)).filter((F.col("collection") == "en") & F.col("year").between(1920, 1980))
    return best(rows, 20, "collection", "year")


@query
def search_sort_title(spark, sf_dir):
    rows = found(spark, sf_dir, (("with",),)).withColumn("page", F.col("rowid").cast("string"))
    return rows.orderBy("title", F.expr("try_cast(page AS int)"), "rowid").limit(20).select("rowid", "title")


@query
def search_newest_nulls_last(spark, sf_dir):
    return found(spark, sf_dir, (("with",),)).orderBy(F.desc_nulls_last("year"), "title", "rowid").limit(30).select("rowid", "title", "year")


@query
def search_oldest_nulls_last(spark, sf_dir):
    return found(spark, sf_dir, (("with",),)).orderBy(F.asc_nulls_last("year"), "title", "rowid").limit(30).select("rowid", "title", "year")


@query
def search_total(spark, sf_dir):
    return found(spark, sf_dir, (("with",), ("from",))).agg(F.count("*").alias("total"))


@query
def facet_counts(spark, sf_dir):
    return ranking.facets(found(spark, sf_dir, (("the", "de", "der"),)), "collection")


@query
def top_sources_for_query(spark, sf_dir):
    rows = found(spark, sf_dir, (("with",),))
    return rows.groupBy("title").agg(F.min("collection").alias("collection"), F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(12)


@query
def diversified_top(spark, sf_dir):
    rows = ranking.capped(found(spark, sf_dir, (("with",),)), ["title"], 2, F.desc("score"), F.asc("rowid"))
    return best(rows, 20, "title")


@query
def paged_diversified(spark, sf_dir):
    rows = ranking.capped(found(spark, sf_dir, (("with",),)), ["title"], 2, F.desc("score"), F.asc("rowid"))
    return ranking.paged(rows, 10, 10, F.desc("score"), F.asc("rowid")).select("rowid", "title", F.round("score", 6).alias("score"))


@query
def term_df(spark, sf_dir):
    return postings.term_df(index_of(spark, sf_dir))


@query
def doc_lengths(spark, sf_dir):
    return index_of(spark, sf_dir).docs.select("rowid", "doc_len")


@query
def term_cooccurrence_with_query(spark, sf_dir):
    index = index_of(spark, sf_dir)
    rows = matched(index, Query((("with",), ("from",)))).select("rowid")
    terms = ["this", "that", "which", "be", "are"]
    both = index.postings.filter(F.col("term").isin(terms)).select("term", "rowid").distinct().join(rows, "rowid", "left_semi")
    return both.groupBy("term").agg(F.count("*").alias("n"))


@query
def page_npmi(spark, sf_dir):
    """How words go together with a query over all pages."""
    index = index_of(spark, sf_dir)
    hits = matched(index, Query((("from",),))).select("rowid")
    both = index.postings.filter(F.col("term").isin("this", "was", "which", "la")).select("term", "rowid").distinct().join(hits.withColumn("hit", F.lit(1)), "rowid", "left")
    counts = both.groupBy("term").agg(F.count("*").alias("df"), F.count("hit").alias("n"))
    return counts.select("term", "n", F.round(topics.npmi(F.col("n"), F.col("df"), F.lit(hits.count()), F.lit(index.rows)), 6).alias("score"))


@query
def porter_search(spark, sf_dir):
    """Stemmed search; compared with a brute-force count in the tests."""
    return best(matched(index_of(spark, sf_dir, "porter"), Query((("entions",),))))


@query
def snippet_marked(spark, sf_dir):
    rows = ranking.top(found(spark, sf_dir, (("with",), ("from",))), 20, F.desc("score"), F.asc("rowid"))
    texts = pages(spark, sf_dir).select("rowid", "text").join(F.broadcast(rows.select("rowid")), "rowid")
    return ranking.snippets(texts, ["with", "from"]).select("rowid", "snippet")


@query
def snippet_fallback(spark, sf_dir):
    return ranking.snippets(pages(spark, sf_dir), []).select("rowid", "snippet")


@query
def fetch_in_order(spark, sf_dir):
    return by_id_list(pages(spark, sf_dir).select("rowid", "collection", "title"), [42, 7, 10**9, 3, 19])


@query
def folded_text(spark, sf_dir):
    return pages(spark, sf_dir).select("rowid", F.md5(fold("text")).alias("digest"), F.md5(fold("title")).alias("title_digest"))


@query
def unmarked_text(spark, sf_dir):
    return pages(spark, sf_dir).select("rowid", F.md5(unmark(F.lower("text"))).alias("digest"))


@query
def query_language(spark, sf_dir):
    """Typed queries and the match expressions that they become."""
    typed = ['mitre "band saw" -plywood', "half-blind dovetail", "colour centre", '"quoted only"', "-nothing", ""]
    typed += ["ahşap zıvana nasıl", "gönye", "gönyeli", "vidalar nasıl sıkılır", "bant testere", "meşe cila", "Kırlangıç Kuyruğu", "tornada ceviz oyma", "nasıl yapılır"]
    rows = []
    for q in typed:
        parsed = querylang.parse(q)
        rows.append((q, parsed.text() if parsed else None))
    return spark.createDataFrame(rows, "typed string, match string")


# ---- vectors ---------------------------------------------------------------------------------------------

@query
def vector_topk(spark, sf_dir):
    return vectors.top_k(stored_vectors(spark, sf_dir), one_vector(spark, sf_dir), 20).select("rowid", F.round("score", 6).alias("score"))


@query
def rrf_hybrid(spark, sf_dir):
    keyword = ranking.ranked(found(spark, sf_dir, (("with",),)), 800, F.desc("score"), F.asc("rowid"))
    near = ranking.ranked(vectors.top_k(stored_vectors(spark, sf_dir), one_vector(spark, sf_dir), 400), 400, F.desc("score"), F.asc("rowid"))
    return ranking.rrf([keyword, near], 60, 50).select("rowid", F.round("score", 8).alias("score"))


@query
def hybrid_filtered(spark, sf_dir):
    keep = (F.col("collection") == "en") & (F.col("year") >= 1950)
    keyword = ranking.ranked(found(spark, sf_dir, (("with",),)).filter(keep), 800, F.desc("score"), F.asc("rowid"))
    near = vectors.top_k(stored_vectors(spark, sf_dir), one_vector(spark, sf_dir), 400).join(index_of(spark, sf_dir).docs, "rowid").filter(keep)
    return ranking.rrf([keyword, ranking.ranked(near, 400, F.desc("score"), F.asc("rowid"))], 60, 50).select("rowid", F.round("score", 8).alias("score"))


@query
def pending_vectors(spark, sf_dir):
    return vectors.pending(pages(spark, sf_dir).select("rowid", "text"), stored_vectors(spark, sf_dir)).select("rowid")


@query
def prune_vectors(spark, sf_dir):
    return vectors.prune(stored_vectors(spark, sf_dir), pages(spark, sf_dir).filter(F.col("collection") == "en")).select("rowid")


@query
def embedding_coverage(spark, sf_dir):
    return vectors.coverage(pages(spark, sf_dir).select("rowid", "text"), stored_vectors(spark, sf_dir))


# ---- topics ----------------------------------------------------------------------------------------------

@query
def tag_frequency(spark, sf_dir):
    return topics.tag_frequency(topics.tag_rows(orders_as_articles(spark, sf_dir)))


@query
def tag_cooccurrence(spark, sf_dir):
    return topics.cooccurrence(topics.tag_rows(orders_as_articles(spark, sf_dir)))


def _stats(spark, sf_dir) -> topics.TopicStats:
    rows = topics.tag_rows(orders_as_articles(spark, sf_dir))
    freq = topics.tag_frequency(rows)
    return topics.TopicStats(freq, topics.cooccurrence(rows), orders_as_articles(spark, sf_dir).count(), freq.select("tag", F.col("tag").alias("main")))


@query
def topic_graph_edges(spark, sf_dir):
    return topics.topic_graph(_stats(spark, sf_dir), 12, 3)[1].select("a", "b", "w")


@query
def npmi_related(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    articles = orders_as_articles(spark, sf_dir)
    hits = topics.tag_rows(articles).filter(F.col("tag") == "Brand#11").select("rowid")
    counts = topics.matched_tags(hits, articles, "Brand#11", exact_only=True)
    return topics.scored_tags(counts, stats, hits.count()).select("tag", "n", F.round("score", 6).alias("score"))


@query
def canonical_tag_groups(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.regexp_replace("p_type", " ", "-")).alias("tag"))
    return topics.spelling_groups(topics.tag_frequency(names)).select("tag", "main", "freq")


@query
def typo_pairs_levenshtein(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_brand").alias("tag"))
    return topics.typo_pairs(topics.tag_frequency(names), 1).select("tag", "main")


@query
def tag_merge(spark, sf_dir):
    """Spelling groups and typo variants of a small taxonomy, merged; with hand-made expectations."""
    rows = [(i, t) for i, t in enumerate(["Hand Planes; Dovetails"] * 6 + ["hand planes", "Hand-Planes; Dovetials", "Dovetail", "Dovetials , Water Stones"])]
    articles = spark.createDataFrame(rows, "rowid long, taxonomy string")
    return topics.topic_stats(articles).nodes.select("tag", F.col("freq").alias("n"))


@query
def select_topics_greedy(spark, sf_dir):
    scored = spark.createDataFrame(
        [("Sharpening Stones", 30, 0.9), ("Sharpening Jigs", 20, 0.8), ("Sharpening Chisels", 20, 0.7), ("Sharpening Planes", 20, 0.6), ("Water Tables", 9, 0.5), ("Rare", 2, 0.99), ("Sharpening Saws", 8, 0.55)], "tag string, n long, score double"
    )
    chosen = topics.select_topics(scored, 5, 4)
    return spark.createDataFrame([(i + 1, t, n, round(s, 6)) for i, (t, n, s) in enumerate(chosen)], "place int, tag string, n long, score double")


@query
def light_stem_sets(spark, sf_dir):
    names = spark.createDataFrame([("Boards",), ("Spokeshaves",), ("Sharpening Stones",), ("Boxes and Benches",), ("Tool Making",), ("Berries",)], "name string")
    return names.select("name", F.array_join(F.array_sort(light_stems(F.col("name"))), " ").alias("stems"))


@query
def bigram_candidates(spark, sf_dir):
    return topics.candidate_terms(pages(spark, sf_dir), ["with"], 4, 30)


@query
def concept_profiles(spark, sf_dir):
    articles = orders_as_articles(spark, sf_dir).withColumn("headline", F.concat(F.lit("Order "), F.col("rowid").cast("string")))
    return topics.concept_profiles(articles, _stats(spark, sf_dir))


# ---- names and years -------------------------------------------------------------------------------------

@query
def title_resolver(spark, sf_dir):
    rows = [
        ("/lib/Popular Mechanics 2025/7.pdf", "Popular Mechanics 2025", "", ""), ("/lib/x/Joinery Handbook - A. Miller.pdf", "x", "", ""), ("/lib/books/12.pdf", "books", "The Shop  Journal", ""),
        ("/lib/books/issue 3 final.pdf", "books", "Jane Doe", "POPULAR . woodworking, May"), ("/lib/1999/draft v2.pdf", "1999", "", "nothing"), ("/lib/scans/44.pdf", "scans", "me.pdf", "Shop -- Notes"),
    ]
    df = spark.createDataFrame(rows, "path string, collection string, meta string, head string")
    out = titles.resolve(F.col("path"), F.col("collection"), F.col("meta"), F.col("head"))
    return df.select("path", out["pub"].alias("pub"), out["pub_src"].alias("pub_src"))


@query
def display_clean(spark, sf_dir):
    raw = ["_vk_com_", "Hand_Tools-ne", "THE COMPLETE BOOK (USA) DVD", "Jig ((A. Writer))", "Boxes {AB12CD34}", "A - - B", "wood[ ] turning ( )", "USSR-TIMBER", "The  Joiner   (LIBGEN)"]
    return spark.createDataFrame([(r,) for r in raw], "raw string").select("raw", titles.display_name(F.col("raw")).alias("clean"))


@query
def year_detect(spark, sf_dir):
    rows = [
        ("1871-Of-Stairs", "", "", None), ("Carpentry", "COPYRIGHT 1912 A. PRESS", "", 1924), ("Chairs", "first published in 1931 by a press", "see also 1754", 1931),
        ("Tools", "Phone: (610) 593-1777", "", None), ("T-1810 Manual", "circa 1880", "", None), ("Old book", "printed pages of 1999 words", "", 1950),
        ("Vol 3 Oak 1920", "", "", None), ("Joints", "copyright 1911, 12 plates", "", None), ("Turning", "copies 1,904 - 1905 of them", "", None), ("Inlay", "printed in 1907 - 8 parts", "", None),
    ]
    df = spark.createDataFrame(rows, "title string, head string, tail string, stored int")
    with_found = df.withColumn("f", years.detected(F.col("title"), F.col("head"), F.col("tail")))
    plan = with_found.withColumn("d", years.decision(F.col("stored"), F.col("f")))
    return plan.select("title", F.col("f.year").alias("year"), F.col("f.confidence").alias("confidence"), F.col("d.year").alias("new_year"), F.col("d.action").alias("action"))


@query
def title_years(spark, sf_dir):
    df = spark.createDataFrame([("1902Plain",), ("1902 Plain Joinery",), ("Guide 1850 to 1975",), ("Model-1999",), ("none",)], "title string")
    return df.select("title", titles.leading_year(F.col("title")).alias("year"))


@query
def mode_year_per_customer(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.year("o_orderdate").alias("year"))
    return library.book_years(rows).select(F.col("path").alias("custkey"), "year")


@query
def head_tail_text(spark, sf_dir):
    out = library.head_tail(pages(spark, sf_dir).select("path", F.col("rowid").alias("page"), "text"))
    return out.select("path", F.md5("head").alias("head"), F.md5("tail").alias("tail"))


@query
def year_repair_plan(spark, sf_dir):
    """Plan and application of year repairs over a small library."""
    rows = [("/a", "1855-Stairs", 1, "text"), ("/b", "Carpentry", 1, "COPYRIGHT 1912 IRA"), ("/b", "Carpentry", 2, "more"), ("/c", "Plain", 1, "nothing")]
    own = spark.createDataFrame([*rows, ("/d", "Tie", 1, "x"), ("/d", "Tie", 2, "y")], "path string, title string, page int, text string")
    # the two years of the last book are as frequent, so the one that its first page has counts
    stored = spark.createDataFrame([("/a", None, 1), ("/b", 1924, 1), ("/b", 1924, 2), ("/c", 1950, 1), ("/d", 1931, 1), ("/d", 1930, 2)], "path string, year int, page int")
    plan = repairs.year_plan(own, stored)
    return plan.join(repairs.apply_years(stored, plan).groupBy("path").agg(F.max("year").alias("written")), "path").select("path", "old", "new", "action", "written")


@query
def title_repair_plan(spark, sf_dir):
    rows = [("Popular Mechanics 2025", "7", "/l/7.pdf", None, "keep"), ("x", "Tool Chest", "/l/Tool Chest.pdf", None, "keep"), ("books", "9", "/l/9.pdf", "Old Name", "metadata")]
    src = spark.createDataFrame(rows, "collection string, title string, path string, pub string, pub_src string")
    heads = spark.createDataFrame([("/l/9.pdf", "", "WOODSMITH  magazine")], "path string, meta_title string, head string")
    plan = repairs.title_plan(src, heads)
    return plan.join(repairs.apply_titles(src, plan).select("path", F.col("pub").alias("written")), "path").select("path", "old", "new", "action", "written")


# ---- books and jobs ----------------------------------------------------------------------------------------

@query
def classify_sources(spark, sf_dir):
    return library.classify(pages(spark, sf_dir), 400, 0.9).select("path", "pages", "indexed_pages", "chars", "status")


@query
def library_counters(spark, sf_dir):
    return library.counters(source_rows(spark, sf_dir), events_as_jobs(spark, sf_dir).withColumn("status", F.when(F.col("status") == "error", "failed").when(F.col("status") == "purchase", "done").otherwise(F.col("status"))))


def _paths(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("/Lib/"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "\\").otherwise("//"), F.col("source"), F.when(F.col("doc_id") % 3 == 0, " (1)").otherwise(""), F.lit(".pdf"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), name.alias("path"))


@query
def duplicate_groups(spark, sf_dir):
    return library.duplicate_paths(_paths(spark, sf_dir))


@query
def copy_key_groups(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy(library.copy_key(F.col("path")).alias("copy")).agg(F.count("*").alias("n"))


@query
def walk_filter(spark, sf_dir):
    names = _paths(spark, sf_dir).withColumn("path", F.when(F.col("id") % 11 == 0, F.concat("path", F.lit(".part"))).when(F.col("id") % 13 == 0, F.concat(F.lit("/Lib/.cache/"), F.col("id").cast("string"), F.lit(".pdf"))).otherwise(F.col("path")))
    return sources_files.walk(names.withColumn("length", F.col("id")), ["DE"]).select("id", "path")


@query
def latest_job_status(spark, sf_dir):
    return library.latest(events_as_jobs(spark, sf_dir), ["path"]).select("path", "id", "status")


@query
def job_event_states(spark, sf_dir):
    events = events_as_jobs(spark, sf_dir).withColumn("status", F.when(F.col("status") == "view", "idle").otherwise(F.col("status")))
    return library.job_states(events).select("job", "status", "updated")


@query
def event_resume(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type")
    return since(retained(log, 300), log.agg(F.max("seq")).first()[0] - 50)


@query
def upsert_jobs(spark, sf_dir):
    jobs = events_as_jobs(spark, sf_dir)
    old, new = jobs.filter(F.col("id") % 2 == 0), jobs.filter(F.col("id") % 2 == 1)
    return upserted(library.latest(old, ["path"]), new, ["path"], ["updated", "id"]).select("path", "id", "status")


@query
def insert_or_ignore(spark, sf_dir):
    old = read(spark, sf_dir, "customer").filter(F.col("c_nationkey") < 10).select("c_nationkey").distinct().withColumn("src", F.lit("old"))
    new = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("new").alias("src"))
    return inserted_or_ignored(old, new, ["c_nationkey"])


@query
def additive_schema(spark, sf_dir):
    return merge_schema(read(spark, sf_dir, "region").select("r_regionkey"), read(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query
def tidy_jobs(spark, sf_dir):
    jobs = events_as_jobs(spark, sf_dir)
    return tidied(jobs, jobs.filter("status = 'purchase'").select("path")).select("path", "id", "status")


@query
def merged_copies(spark, sf_dir):
    """Copies merged away and one of them restored."""
    jobs = library.latest(events_as_jobs(spark, sf_dir), ["path"]).select("path", "title", "status", "detail", "updated")
    copies = jobs.filter(F.col("title").cast("int") < 20).select("path", "title", F.lit("keeper").alias("kept"))
    marked = repairs.mark_copies(jobs, copies, 1.0)
    return repairs.restore_copies(marked, spark.createDataFrame([("/LIB/3.pdf",)], "path string")).select("path", "status")


@query
def bulk_outcome(spark, sf_dir):
    asked = spark.createDataFrame([("SRC1",), ("src1",), ("src2",), ("nowhere",)], "path string")
    return repairs.bulk_outcome(asked, source_rows(spark, sf_dir))


@query
def jobs_with_titles(spark, sf_dir):
    jobs = library.latest(events_as_jobs(spark, sf_dir), ["path"])
    src = spark.createDataFrame([("/lib/1.pdf", "One_Title", None), ("/lib/2.pdf", "2", "A Journal No. 2")], "path string, title string, pub string")
    return library.jobs_with_titles(jobs, src).select("path", "status", "shown")


@query
def tokenize_table_function(spark, sf_dir):
    udtf.register(spark)
    return spark.sql("SELECT * FROM tokenize('Café-crème, don''t 12')")


@query
def cascade_delete_counts(spark, sf_dir):
    own = pages(spark, sf_dir)
    gone = spark.createDataFrame([("SRC3",), ("src7",)], "path string")
    return library.delete_cascade(gone, {"pages": own.select("rowid", "path"), "pyear": own.select("rowid", "year"), "sources": source_rows(spark, sf_dir).select("path", "status")})[1]


@query
def archive_summary(spark, sf_dir):
    own = pages(spark, sf_dir)
    return library.archive_summary(own.select("rowid", F.concat(F.lit("/arc/"), F.col("title")).alias("pdf_path")), own.select("rowid", "title", "collection", "text", "page"))


@query
def collection_counts(spark, sf_dir):
    return library.collection_counts(pages(spark, sf_dir).withColumn("collection", F.when(F.col("collection") == "es", "").otherwise(F.col("collection"))))


@query
def books_list(spark, sf_dir):
    """Files, sources, jobs and years meet; copies are marked."""
    src = source_rows(spark, sf_dir)
    files = src.select("path", F.lit(10).cast("long").alias("length")).filter(F.col("path") != "src5").unionByName(spark.createDataFrame([("src1 (1).pdf", 5), ("new.pdf", 6)], "path string, length long"))
    jobs = spark.createDataFrame([(1, "src2", "src2", "queued", "q", 1.0), (2, "src4", "src4", "duplicate", "", 2.0), (3, "src2", "src2", "indexing", "i", 3.0)], "id long, path string, title string, status string, detail string, updated double")
    year_rows = pages(spark, sf_dir).select(library.path_key(F.col("path")).alias("key"), "year")
    return library.in_book_order(library.books(files, src, jobs, library.book_years(year_rows, "key"))).select("file", "status", "year", "exists", "copies", "dup_of")


@query
def table_fingerprint(spark, sf_dir):
    return fingerprint(read(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice").select("n")


# ---- the facade --------------------------------------------------------------------------------------------

@query
def engine_search(spark, sf_dir):
    """A page of hits through the facade, with filters, the cap per work and snippets."""
    own = pages(spark, sf_dir)
    engine = Engine(spark, Library(own.drop("year"), years=own.select("rowid", "year")), index_of(spark, sf_dir))
    return engine.search("with from -this", collection="en", ymin=1910, limit=15).hits.select("rowid", "title", "collection", "year", F.round("score", 6).alias("score"))


@query
def engine_hybrid(spark, sf_dir):
    own = pages(spark, sf_dir)
    vector = one_vector(spark, sf_dir)
    engine = Engine(spark, Library(own.drop("year"), years=own.select("rowid", "year"), vectors=stored_vectors(spark, sf_dir)), index_of(spark, sf_dir), embed=lambda q: vector)
    return engine.search("with", hybrid=True, limit=15).hits.select("rowid", "title", F.round("score", 8).alias("score"))


# ---- queries as typed, single pages ----------------------------------------------------------------------------

@query
def search_form(spark, sf_dir):
    """The fields of the search form together: all words, a phrase, any words and none."""
    parsed = querylang.parse("", all_words="with from", phrase="of the", any_words="this that", none_words="which")
    return best(matched(index_of(spark, sf_dir), parsed))


@query
def search_simple(spark, sf_dir):
    return best(matched(index_of(spark, sf_dir), querylang.simple('"of the" with')))


@query
def search_simple_any(spark, sf_dir):
    return best(matched(index_of(spark, sf_dir), querylang.simple("with from", any_mode=True)))


@query
def search_expanded(spark, sf_dir):
    return best(matched(index_of(spark, sf_dir), querylang.expanded("colour with", any_mode=True)))


@query
def rewritten_queries(spark, sf_dir):
    """What a typed query is said to have become, and what the vector side is asked."""
    typed = ["colour chart", "plain words", "gönye"]
    rows = [(q, "; ".join(" > ".join(x) for x in querylang.describe(q)), querylang.semantic_text(q)) for q in typed]
    return spark.createDataFrame(rows, "typed string, rewritten string, asked string")


@query
def page_text(spark, sf_dir):
    """The text of one page, and no row for a page that isn't there."""
    engine = Engine(spark, Library(pages(spark, sf_dir)), None)
    return engine.text(42).unionByName(engine.text(-1)).select("title", "collection", "page", F.md5("text").alias("digest"))


@query
def page_terms(spark, sf_dir):
    out = Engine(spark, Library(pages(spark, sf_dir)), None).terms(42)
    return out.select("title", "page", F.array_join("terms", " ").alias("terms"))


@query
def ascii_tokens(spark, sf_dir):
    return pages(spark, sf_dir).select("rowid", F.size(ascii_words(F.lower("text"))).alias("n"))


@query
def stored_paths(spark, sf_dir):
    return Engine(spark, Library(pages(spark, sf_dir), sources=_paths(spark, sf_dir)), None).paths()


@query
def hybrid_readiness(spark, sf_dir):
    """Whether the vector layer covers enough pages to take part in ranking."""
    row = vectors.coverage(pages(spark, sf_dir), stored_vectors(spark, sf_dir)).first()
    return spark.createDataFrame([(vectors.ready(row, 64), vectors.ready(row, 0), vectors.ready(row, 64, 10**9))], "usable boolean, without_model boolean, with_too_few boolean")


# ---- upkeep of a library ---------------------------------------------------------------------------------------

@query
def new_files(spark, sf_dir):
    """Customers' files without orders' books and without copies that were merged away."""
    file = lambda c: F.concat(F.lit("/Lib/"), F.col(c).cast("string"), F.lit(".PDF")).alias("path")
    book = F.concat(F.lit("\\lib\\\\"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("path")
    jobs = events_as_jobs(spark, sf_dir).filter("id % 50 = 0").select("path", F.when(F.col("status") == "purchase", "duplicate").otherwise("failed").alias("status"))
    return library.new_files(read(spark, sf_dir, "customer").select(file("c_custkey")), read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(book), jobs)


@query
def one_source_per_file(spark, sf_dir):
    own = _paths(spark, sf_dir).withColumn("title", F.col("id").cast("string"))
    return library.fix_duplicates(own, own.filter(F.col("id") % 5 == 0).select("path")).select("path", "id")


@query
def path_spellings(spark, sf_dir):
    return library.spellings(_paths(spark, sf_dir), "/LIB//en/SRC1.pdf")


@query
def exact_delete_counts(spark, sf_dir):
    """Only rows of that very spelling go."""
    own = pages(spark, sf_dir)
    gone = spark.createDataFrame([("SRC3",), ("src7",)], "path string")
    return library.delete_cascade(gone, {"pages": own.select("rowid", "path"), "pyear": own.select("rowid", "year")}, exact=True)[1]


@query
def collection_of_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", sources_files.collection_of(F.regexp_replace("path", r"[\\/]+", "/"), "/Lib").alias("collection"))


@query
def decision_tally(spark, sf_dir):
    return library.tally(library.classify(pages(spark, sf_dir), 400, 0.9), "status")


@query
def leading_years(spark, sf_dir):
    """Years at the front of names, over all orders."""
    own = read(spark, sf_dir, "orders")
    name = F.concat(F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" Plain ")).otherwise(F.lit("Plain")), F.col("o_orderkey").cast("string"))
    return own.select("o_orderkey", titles.leading_year(name).alias("year"))


@query
def embedded_pages(spark, sf_dir):
    """Vectors of a model that counts characters, at unit length."""
    model = lambda texts: [[float(len(t) % 7), 3.0, 4.0] for t in texts]
    out = vectors.embed(pages(spark, sf_dir).select("rowid", "text"), model, "lengths", 1200)
    return out.select("rowid", F.round(F.col("vec")[1].cast("double"), 4).alias("second"), "model_id")
