"""The engine: search, related topics, graphs, books and counters over a library's tables.

Everything returns DataFrames, but for what a screen shows of one query (a summary, a topic list, an ego
graph).  Ranking touches no text; snippets are made for the rows of the page alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.config import Options
from folioscope.functions.analysis import words
from folioscope.functions.titles import display_name, display_title
from folioscope.operators import library, postings, ranking, topics, vectors
from folioscope.operators.postings import Index
from folioscope.plans import querylang
from folioscope.plans.matching import matched, phrase_counts
from folioscope.plans.querylang import Lexicon, Query

SORTS = ("relevance", "title", "newest", "oldest")


@dataclass
class Result:
    """A page of hits and what goes with it."""

    hits: DataFrame
    total: int
    facets: DataFrame | None
    mode: str
    match: str
    rewritten: list[list[str]]
    kwmiss: bool
    offset: int
    limit: int


@dataclass
class Library:
    """The tables of a library; those that are absent are None.

    pages(rowid, text, collection, title, page, path), years(rowid, year), files(rowid, pdf_path),
    articles(rowid, headline, subhead, abstract, taxonomy), sources, jobs, vectors(rowid, vec),
    concepts(tag, vec).
    """

    pages: DataFrame
    years: DataFrame | None = None
    files: DataFrame | None = None
    articles: DataFrame | None = None
    sources: DataFrame | None = None
    jobs: DataFrame | None = None
    vectors: DataFrame | None = None
    concepts: DataFrame | None = None


def sort_order(sort: str) -> list[Column]:
    """Total orders: every sort ends with the row's id."""
    page = F.expr("try_cast(page AS int)")
    return {
        "relevance": [F.asc("tier"), F.desc("score"), F.asc("rowid")],
        "title": [F.asc("title"), page.asc_nulls_last(), F.asc("rowid")],
        "newest": [F.desc_nulls_last("year"), F.asc("title"), F.asc("rowid")],
        "oldest": [F.asc_nulls_last("year"), F.asc("title"), F.asc("rowid")],
    }[sort]


class Engine:
    def __init__(self, spark: SparkSession, tables: Library, index: Index, options: Options | None = None, embed: Callable[[str], list[float]] | None = None, lexicon: Lexicon | None = None, article_index: Index | None = None, stopwords: list[str] | None = None):
        self.spark, self.tables, self.index, self.embed, self.article_index = spark, tables, index, embed, article_index
        self.options = options or Options()
        #: Words that make no topic; a library's own list may replace the built-in one.
        self.stopwords = stopwords
        self.lexicon = lexicon or Lexicon(translate=self.options.translate)
        self._stats: topics.TopicStats | None = None
        self._ready: bool | None = None

    # ---- search --------------------------------------------------------------------------------------------

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with what filters and sorts need; no text."""
        own = self.tables.pages.select("rowid", "collection", "title", "page", "path")
        out = rows.join(own, "rowid")
        return out.join(self.tables.years.select("rowid", "year"), "rowid", "left") if self.tables.years is not None else out.withColumn("year", F.lit(None).cast("int"))

    def _filtered(self, rows: DataFrame, collection: str, ymin: int | None, ymax: int | None) -> DataFrame:
        if collection:
            rows = rows.filter(F.col("collection") == collection)
        if ymin:
            rows = rows.filter(F.col("year") >= int(ymin))
        if ymax:
            rows = rows.filter(F.col("year") <= int(ymax))
        return rows

    def _hybrid_ready(self) -> bool:
        if self.tables.vectors is None or self.embed is None:
            return False
        if self._ready is None:
            self._ready = vectors.ready(self.embed_status().first(), 1, self.options.min_vectors, self.options.min_coverage)
        return self._ready

    def ranked(self, query: Query, q: str, collection: str = "", ymin: int | None = None, ymax: int | None = None, hybrid: bool = False) -> DataFrame:
        """(rowid, score, tier, collection, title, page, path, year) in the order of the relevance sort.

        Hybrid: the first rows of the keyword list and of the vector list, both filtered, are fused (tier
        0); what else matched follows by its own score (tier 1), so later pages go on in one order.
        """
        o = self.options
        found = self._filtered(self._placed(matched(self.index, query, o)), collection, ymin, ymax)
        if not hybrid:
            return found.withColumn("tier", F.lit(0))
        asked = self.embed(querylang.semantic_text(q, self.lexicon))
        # filters come before the choice of neighbours, so a narrow one still gets as many
        allowed = self._filtered(self._placed(self.tables.vectors.select("rowid")), collection, ymin, ymax) if collection or ymin or ymax else None
        near = self._placed(vectors.top_k(self.tables.vectors, asked, o.vector_pool, allowed))
        if query.excluded:  # what must not occur is no neighbour either
            terms = [t for t in (querylang.python_terms(p, self.index.analyser) for p in query.excluded) if t]
            near = near.join(phrase_counts(self.index, terms).select("rowid"), "rowid", "left_anti")
        keyword_list = ranking.ranked(found.select("rowid", "score"), o.keyword_pool, F.desc("score"), F.asc("rowid"))
        vector_list = ranking.ranked(near.select("rowid", "score"), o.vector_pool, F.desc("score"), F.asc("rowid"))
        fused = ranking.rrf([keyword_list, vector_list], o.rrf_k, o.fused_pool)
        rest = found.join(F.broadcast(fused.select("rowid")), "rowid", "left_anti")  # at most ``fused_pool`` ids
        return self._placed(fused).withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1)))

    def search(self, q: str = "", all_words: str = "", phrase: str = "", any_words: str = "", none_words: str = "", collection: str = "", ymin: int | None = None, ymax: int | None = None, sort: str = "relevance", offset: int = 0, limit: int = 20, hybrid: bool = False) -> Result:
        o = self.options
        query = querylang.parse(q, all_words, phrase, any_words, none_words, self.lexicon, self.index.analyser)
        if query is None:
            empty = self.tables.pages.limit(0)
            return Result(empty, 0, None, "none", "", [], False, offset, limit)
        use_vectors = hybrid and sort == "relevance" and not any_words and self._hybrid_ready()
        rows = self.ranked(query, q, collection, ymin, ymax, use_vectors)
        keyword = self._filtered(self._placed(matched(self.index, query, o)), collection, ymin, ymax)
        # a row for each collection; their sum is the total
        counted = ranking.facets(keyword, "collection").collect()
        total = sum(r.n for r in counted)
        order = sort_order(sort)
        stream = ranking.capped(rows, ["title", "path"], o.per_work, *order) if sort == "relevance" else rows
        page = ranking.paged(stream, offset, limit, *order)
        mode = ("hybrid" if offset < o.fused_pool else "hybrid-tail") if use_vectors else "keyword" if sort == "relevance" else sort
        hits = self.hits(page, [p for g in query.groups for p in g], order)
        facets = self.spark.createDataFrame(counted, "collection string, n long") if offset == 0 else None
        return Result(hits, total, facets, mode, query.text(), querylang.describe(q, self.lexicon), use_vectors and total == 0, offset, limit)

    def hits(self, page: DataFrame, phrases: list[str], order: list[Column]) -> DataFrame:
        """Display columns and snippets of the rows of one page of results.

        The page is collected, so its few ids reach the scans of the texts as a filter.
        """
        shown = page.collect()
        ids = [r.rowid for r in shown]
        small = F.broadcast(self.spark.createDataFrame(shown, page.schema))
        rows = self.tables.pages.select("rowid", "text").filter(F.col("rowid").isin(ids)).join(small, "rowid")
        if self.tables.files is not None:
            rows = rows.join(self.tables.files.select("rowid", "pdf_path").filter(F.col("rowid").isin(ids)), "rowid", "left")
        else:
            rows = rows.withColumn("pdf_path", F.lit(None).cast("string"))
        if self.tables.sources is not None:
            keyed = self.tables.sources.withColumn("_key", library.path_key(F.col("path")))
            wanted = small.select(library.path_key(F.col("path")).alias("_key")).distinct()
            pubs = keyed.join(F.broadcast(wanted), "_key", "left_semi").groupBy("_key").agg(F.max(F.struct("pub", "pub_src")).alias("_pub"))
            rows = rows.join(pubs, library.path_key(F.col("path")) == F.col("_key"), "left")
        else:
            rows = rows.withColumn("_pub", F.lit(None).cast("struct<pub:string,pub_src:string>"))
        out = ranking.snippets(rows, phrases, self.index.analyser, self.options.snippet_tokens, self.options.snippet_chars).orderBy(*order)
        return out.select(
            "rowid", display_title(F.col("_pub.pub"), F.col("title")).alias("title"), F.col("title").alias("file_title"), F.coalesce("_pub.pub_src", F.lit("keep")).alias("pub_src"),
            F.col("path").alias("file"), "collection", "page", F.col("pdf_path").isNotNull().alias("pdf"), "year", "score", "snippet",
        )

    def top_works(self, query: Query, n: int = 12) -> DataFrame:
        """Works with the most matched rows."""
        rows = self._placed(matched(self.index, query, self.options))
        return rows.groupBy("title").agg(F.min("collection").alias("collection"), F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(n)

    def text(self, rowid: int) -> DataFrame:
        return self.tables.pages.filter(F.col("rowid") == rowid).select(display_name(F.col("title")).alias("title"), "collection", "page", "text")

    def terms(self, rowid: int, n: int = 12) -> DataFrame:
        """The first words of a page, for highlighting."""
        return self.tables.pages.filter(F.col("rowid") == rowid).select("title", "page", F.slice(F.filter(words("text"), lambda w: w != ""), 1, n).alias("terms"))

    # ---- topics --------------------------------------------------------------------------------------------

    def stats(self) -> topics.TopicStats:
        """Topic statistics; call ``refresh`` when tables have changed."""
        if self._stats is None:
            made = topics.topic_stats(self.tables.articles, ratio=self.options.typo_ratio)
            self._stats = topics.TopicStats(made.nodes.cache(), made.edges.cache(), made.total, made.map.cache())
        return self._stats

    def refresh(self) -> None:
        if self._stats is not None:
            for df in (self._stats.nodes, self._stats.edges, self._stats.map):
                df.unpersist()
        self._stats = self._ready = None

    def topic_graph(self) -> tuple[DataFrame, DataFrame]:
        return topics.topic_graph(self.stats(), self.options.graph_nodes, self.options.graph_edge)

    def _page_scores(self, terms: list[str], query: Query) -> DataFrame:
        """(tag, n, score): how candidates go together with the query over all pages."""
        hits = matched(self.index, query, self.options).select("rowid")
        as_terms = [querylang.python_terms(t, self.index.analyser) for t in terms]
        known = [(t, p) for t, p in zip(terms, as_terms, strict=True) if p]
        counts = phrase_counts(self.index, [p for _, p in known])
        names = F.array(*(F.lit(t) for t, _ in known))
        both = counts.join(hits.withColumn("hit", F.lit(1)), "rowid", "left").groupBy("phrase").agg(F.count("*").alias("df"), F.count("hit").alias("n"))
        asked = hits.count()
        return both.select(names[F.col("phrase")].alias("tag"), "n", topics.npmi(F.col("n"), F.col("df"), F.lit(asked), F.lit(self.index.rows)).alias("score"))

    def library_related(self, q: str, query: Query, budget: topics.Budget, sample: int = 40) -> list[tuple[str, int, float]]:
        """Topics mined from the query's best pages, scored over all pages."""
        best = ranking.top(matched(self.index, query, self.options), sample, F.desc("score"), F.asc("rowid"))
        texts = self.tables.pages.select("rowid", "text").join(F.broadcast(best.select("rowid")), "rowid", "left_semi")
        found = [r.term for r in topics.candidate_terms(texts, [t for s in querylang.understand(q, self.lexicon) for p in s.spellings for t in p.split()], stopwords=self.stopwords).collect()]  # ``cap`` terms
        if not found:
            return []
        return topics.select_topics(self._page_scores(found, query), self.options.top_topics, self.options.min_support_library, budget, self.options.redundancy, self.options.free_per_stem)

    def concept_neighbours(self, q: str, k: int = 20) -> list[tuple[str, float]]:
        """Concepts nearest to the query by cosine, without the query itself."""
        if self.tables.concepts is None or self.embed is None or not q:
            return []
        own = {w.lower() for t in querylang.understand(q, self.lexicon) for s in t.spellings for w in s.split()}
        near = self.tables.concepts.select("tag", vectors.dot(F.col("vec"), F.array(*(F.lit(float(x)) for x in self.embed(q)))).alias("cos"))
        low = F.lower("tag")
        near = near.filter((F.col("cos") >= self.options.min_cosine) & ~low.isin(*own or [""]) & ~F.contains(F.lit(q.lower()), low))
        return [(r.tag, round(r.cos, 3)) for r in near.orderBy(F.desc("cos"), "tag").limit(k).collect()]

    def semantic_topics(self, q: str, query: Query, have: set[str], k: int, budget: topics.Budget) -> list[tuple[str, int, float]]:
        """Concept neighbours that statistics over the pages bear out."""
        near = [t for t, _ in self.concept_neighbours(q, 12) if t not in have][: 2 * k]
        return topics.select_topics(self._page_scores(near, query), k, self.options.min_support_library, budget) if near else []

    def related(self, q: str, any_mode: bool = False, exact_only: bool = False, n: int | None = None) -> dict:
        """Related topics: from tagged articles, filled up from the pages and the concepts; and top works."""
        o, n = self.options, n or self.options.top_topics
        query = querylang.expanded(q, any_mode, self.lexicon)
        if query is None:
            return {"topics": [], "source": "none", "books": None}
        budget, base = topics.Budget(), []
        if self.tables.articles is not None and self.article_index is not None:
            stats = self.stats()
            hits = matched(self.article_index, query, o)
            counts = topics.matched_tags(hits, self.tables.articles, q, stats.map, exact_only)
            base = topics.select_topics(topics.scored_tags(counts, stats, hits.count()), n, o.min_support, budget, o.redundancy, o.free_per_stem)
        fill, names = [], set()
        if len(base) < n:
            lib = self.library_related(q, query, budget)
            sem = self.semantic_topics(q, query, {t[0] for t in base}, n - len(base), budget)
            fill, names = topics.merge_pool(base, lib, sem, n), {t[0].casefold() for t in lib}
        source = "articles" if base else "none" if not fill else "library" if any(t[0].casefold() in names for t in fill) else "concepts"
        return {"topics": base + fill, "source": source, "books": self.top_works(query)}

    def subgraph(self, q: str, n: int = 18) -> tuple[list[dict], list[dict]]:
        """Ego graph of a query: its topics as spokes, their co-occurrence as rim."""
        return topics.ego_graph(q, self.related(q, exact_only=True, n=n)["topics"], self.stats())

    # ---- books ---------------------------------------------------------------------------------------------

    def books(self, files: DataFrame) -> DataFrame:
        years = self.tables.pages.select("rowid", "path").join(self.tables.years, "rowid") if self.tables.years is not None else self.tables.pages.select("path", F.lit(None).cast("int").alias("year"))
        keyed = years.select(library.path_key(F.col("path")).alias("key"), "year")
        return library.in_book_order(library.books(files, self.tables.sources, self.tables.jobs, library.book_years(keyed, "key")))

    def counters(self) -> DataFrame:
        return library.counters(self.tables.sources, self.tables.jobs)

    def jobs(self, n: int = 100) -> DataFrame:
        """The newest jobs with what their sources are called."""
        return library.jobs_with_titles(self.tables.jobs, self.tables.sources).orderBy(F.desc("updated"), F.desc("id")).limit(n)

    def paths(self) -> DataFrame:
        """Indexed paths and the keys under which spellings of one file meet."""
        return self.tables.sources.select("path", library.path_key(F.col("path")).alias("key")).distinct()

    def embed_status(self) -> DataFrame:
        """Pages, skipped, embedded and percentage of the vector layer."""
        return vectors.coverage(self.tables.pages, self.tables.vectors, self.options.min_embed_chars)

    def build_vectors(self, model: Callable[[list[str]], list[list[float]]], model_id: str, held: DataFrame) -> DataFrame:
        """All vectors after an incremental build; ``held`` has rowid, vec, model_id."""
        return vectors.build(self.tables.pages, held, model, model_id, self.options.min_embed_chars, self.options.max_embed_chars)

    def build_concepts(self, model: Callable[[list[str]], list[list[float]]], model_id: str) -> DataFrame:
        """(tag, vec, model_id): embedded profiles of all tags; no tags give no rows."""
        profiles = topics.concept_profiles(self.tables.articles, self.stats())
        return vectors.embed(profiles, model, model_id, key="tag", text="profile")

    def health(self) -> dict:
        """Whether index and layers are usable."""
        return {"rows": self.index.rows, "hybrid": self._hybrid_ready(), "articles": self.article_index is not None, "concepts": self.tables.concepts is not None}

    def describe(self) -> dict:
        """Options and the index's figures."""
        return {"rows": self.index.rows, "mean_length": self.index.mean, "analyser": self.index.analyser, "options": self.options}


def build_index(pages: DataFrame, path: str, attributes: list[str] | None = None, analyser: str = "porter", fields: tuple[str, ...] = ("text",)) -> Index:
    """Writes the index of a library's pages below ``path`` and opens it."""
    postings.save(pages, path, attributes or [], analyser, fields=fields)
    return postings.load(pages.sparkSession, path, analyser)


def article_index(articles: DataFrame, path: str, analyser: str = "porter") -> Index:
    """The index of articles: headline, subhead, abstract and taxonomy, apart by a break in positions."""
    fields = ("headline", "subhead", "abstract", "taxonomy")
    return build_index(articles.select("rowid", *fields), path, [], analyser, fields)
