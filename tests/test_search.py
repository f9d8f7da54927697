"""Query language, matching, ranking, the facade; on hand-made corpora and against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.config import Options
from folioscope.engine import Engine, Library, article_index, build_index
from folioscope.functions import analysis
from folioscope.operators import postings, ranking, topics
from folioscope.plans import querylang
from folioscope.plans.matching import matched, phrase_counts
from folioscope.plans.querylang import Lexicon, Query

CORPUS = [
    (1, "The mitre joint and the mitre saw"), (2, "A miter joint, sharpened chisel"), (3, "Dovetail joint by hand"), (4, "band saw and hand saw"), (5, "bandsaw tricks; don't rush"), (6, None), (7, "joint joint joint"), (8, ""),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    rows = [(i, t, "a" if i % 2 else "b", f"work{i % 3}", str(i), f"/lib/w{i % 3}.pdf") for i, t in CORPUS]
    pages = spark.createDataFrame(rows, "rowid long, text string, collection string, title string, page string, path string")
    years = spark.createDataFrame([(i, None if i == 3 else 1900 + i) for i, _ in CORPUS], "rowid long, year int")
    index = build_index(pages, str(tmp_path_factory.mktemp("index")), ["collection"], "simple")
    vectors = spark.createDataFrame([(i, [float(i == 3), float(i != 3)]) for i, _ in CORPUS], "rowid long, vec array<float>")
    articles = spark.createDataFrame([(i, "a saw", "", "", "Saws; Joints") if i < 8 else (i, "seats", "", "", "Chairs; Stools") for i in range(20)], "rowid long, headline string, subhead string, abstract string, taxonomy string")
    own = article_index(articles, str(tmp_path_factory.mktemp("articles")))
    return Engine(spark, Library(pages, years=years, vectors=vectors, articles=articles), index, Options(min_vectors=1, min_embed_chars=1, min_support=1, min_support_library=1), embed=lambda q: [1.0, 0.0], article_index=own)


def brute(groups, excluded=()):
    docs = {i: re.findall(r"\w+", (t or "").lower()) for i, t in CORPUS}
    count = lambda d, p: sum(d[k : k + len(p)] == p for k in range(len(d)))
    mean = sum(map(len, docs.values())) / len(docs)
    f = {p: {i: c for i, d in docs.items() if (c := count(d, p.split()))} for g in [*groups, excluded] for p in g}
    out = {}
    for i, d in docs.items():
        if all(any(i in f[p] for p in g) for g in groups) and not any(i in f[p] for p in excluded):
            out[i] = 0.0
            for g in groups:
                for p in g:
                    if i in f[p]:
                        idf = max(math.log((len(docs) - len(f[p]) + 0.5) / (len(f[p]) + 0.5)), 0)
                        out[i] += (idf or 1e-6) * f[p][i] * 2.2 / (f[p][i] + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return out


@pytest.mark.parametrize(
    ("groups", "excluded"),
    [([["joint"]], ()), ([["mitre", "miter"]], ()), ([["joint"], ["saw", "chisel"]], ()), ([["hand saw"]], ()), ([["joint"]], ("mitre",)), ([["joint"], ["joint"]], ()), ([["don t"]], ()), ([["nowhere"]], ())],
)
def test_bm25_equals_brute_force(engine, groups, excluded):
    got = {r.rowid: r.score for r in matched(engine.index, Query(tuple(map(tuple, groups)), excluded)).collect()}
    want = brute(groups, excluded)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_parse():
    assert querylang.parse("mitre saw").text() == '("mitre" OR "miter") AND "saw"'
    assert querylang.parse('"band saw" -plywood half-blind').text() == '"band saw" AND "half-blind" NOT "plywood"'
    assert querylang.parse("", "a b", "c d", "e f", "g g").text() == '"a" AND "b" AND "c d" AND ("e" OR "f") NOT "g"'
    assert querylang.parse("-only") is None
    assert querylang.parse("") is None
    assert querylang.expanded('"band saw" grey').text() == '("band saw" OR "bandsaw") AND ("grey" OR "gray")'
    assert querylang.expanded("a b", any_mode=True).text() == '("a" OR "b")'
    assert querylang.simple("x 'y").text() == '"x" AND "y"'


def test_turkish_queries_are_read_in_english():
    """Seeds become their words, other words their readings, grammar nothing; it can be switched off."""
    assert querylang.parse("kırlangıç kuyruğu nasıl").text() == '"dovetail"'
    assert querylang.parse("zımparalama").text() == '"sandpaper"'
    assert querylang.parse("cila").text() == '"finish" AND "polish"'
    assert querylang.parse("kapılar -masa").text() == '"door" NOT "masa"'
    assert querylang.parse("zımpara", lexicon=Lexicon(translate=False)).text() == '"zımpara"'
    assert querylang.semantic_text("ahşap mitre") == "wood mitre"
    assert querylang.describe("ahşap mitre zivana") == [["ahşap", "wood"], ["mitre", "miter"], ["zivana", "tenon", "mortise", "mortice"]]
    assert querylang.describe("plain words") == []
    assert querylang.parse("nasıl yapılır") is None


def test_no_phrase_goes_over_the_end_of_a_field(spark, tmp_path):
    rows = [(1, "Making a hand", "plane for shops", None, "x"), (2, "A hand plane", None, "by hand", "plane")]
    index = article_index(spark.createDataFrame(rows, "rowid long, headline string, subhead string, abstract string, taxonomy string"), str(tmp_path / "articles"), "simple")
    assert [r.rowid for r in matched(index, querylang.parse('"hand plane"')).collect()] == [2]
    assert {r.rowid: r.doc_len for r in index.docs.collect()} == {1: 7, 2: 6}


def test_a_narrow_filter_still_finds_neighbours(spark, tmp_path):
    """Filters are applied before the nearest rows are chosen."""
    rows = [(i, "word common here" if i < 20 else f"other text {i}", "a" if i < 290 else "b", f"t{i}", "1", f"/p{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "rowid long, text string, collection string, title string, page string, path string")
    vecs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "rowid long, vec array<float>")
    index = build_index(pages, str(tmp_path / "index"), ["collection"], "simple")
    engine = Engine(spark, Library(pages, vectors=vecs), index, Options(vector_pool=5, min_embed_chars=1), embed=lambda q: [1.0, 0.0])
    got = engine.search("common", collection="b", hybrid=True)
    assert got.total == 0 and got.kwmiss and len(got.hits.collect()) == 5
    plan = got.hits._jdf.queryExecution().executedPlan().toString()
    assert "rowid" in plan


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_parse_never_fails(q):
    parsed = querylang.parse(q)
    assert parsed is None or parsed.groups


def test_search_page(engine):
    out = engine.search("joint", limit=10)
    hits = out.hits.collect()
    assert out.total == 4 and out.mode == "keyword" and not out.kwmiss
    assert hits[0].rowid == 7 and "<mark>joint</mark>" in hits[0].snippet
    assert Counter(h.file_title for h in hits).most_common(1)[0][1] <= 2
    assert {r.collection: r.n for r in out.facets.collect()} == {"a": 3, "b": 1}
    assert engine.search("joint", collection="b").total == 1
    assert engine.search("joint", ymin=1903).total == 1  # rows without a year never pass
    assert [h.year for h in engine.search("joint", sort="newest").hits.collect()] == [1907, 1902, 1901, None]
    assert engine.search("-x").total == 0


def test_hybrid_applies_every_filter(engine):
    out = engine.search("mitre", hybrid=True, none_words="chisel", collection="a")
    assert out.mode == "hybrid"
    rows = [h.rowid for h in out.hits.collect()]
    assert rows[0] == 1 and 3 in rows and 2 not in rows
    assert engine.search("mitre", hybrid=True, any_words="saw").mode == "keyword"


def test_rrf_and_cap(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "rowid long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "rowid long, rank int")
    got = ranking.rrf([a, b], 60).collect()
    assert [r.rowid for r in got] == [2, 1, 3]
    assert math.isclose(got[0].score, 1 / 62 + 1 / 61)
    rows = spark.createDataFrame([(i, "w", float(-i)) for i in range(5)], "rowid long, title string, score double")
    assert ranking.capped(rows, ["title"], 2, F.desc("score")).count() == 2


def test_related_and_graphs(engine):
    out = engine.related("saw")
    assert out["source"] == "articles" and out["topics"][0][:2] in (("Saws", 8), ("Joints", 8)) and {t[0] for t in out["topics"]} >= {"Joints", "Saws"}
    nodes, edges = engine.topic_graph()
    assert nodes.count() == 4 and {(r.a, r.b, r.w) for r in edges.collect()} == {("Joints", "Saws", 8), ("Chairs", "Stools", 12)}
    ego, spokes = engine.subgraph("saw")
    assert ego[0]["center"] and {e["to"] for e in spokes if e["from"] == "saw"} >= {"Joints"}
    assert engine.related("") == {"topics": [], "source": "none", "books": None}
    assert engine.terms(1, 3).first().terms == ["The", "mitre", "joint"]
    assert engine.text(99).count() == 0


def test_options(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"per_work": 3, "rrf_k": 10}')
    got = Options.load(str(path), {"FOLIOSCOPE_RRF_K": "20", "FOLIOSCOPE_TRANSLATE": "yes"})
    assert (got.per_work, got.rrf_k, got.translate, got.b) == (3, 20, True, 0.75)


@pytest.mark.parametrize("analyser", ["simple", "porter"])
def test_an_index_moves_no_tokens(spark, analyser):
    """One posting for each term and row, made where the row is read, in segments of few tokens."""
    texts = spark.createDataFrame([(i, "saws saw the saw " * i) for i in range(5)], "rowid long, text string")
    made = postings.postings_of(texts, analyser)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.term, r.rowid): r.pos for r in made.collect()}
    assert made.count() == len(got) == (8 if analyser == "porter" else 12)
    assert got["the", 2] == [2, 6] and got["saw", 1] == ([0, 1, 3] if analyser == "porter" else [1, 3])


@pytest.mark.parametrize("analyser", ["simple", "porter"])
def test_an_index_has_the_analysers_terms(spark, analyser):
    """Texts are sent to be inverted as they are; the terms are those of the analyser's expression, whatever the letters."""
    pool = random.Random(7)
    odd = "".join(map(chr, (*range(1, 0x250), *range(0x300, 0x600), 0x1E9E, 0x2019, 0x2160, 0x4E2D, 0xAC00, 0xFB01, 0xFFFD, 0x10400, 0x1D7D8, 0x1F600)))
    texts = ["", None, " ", "İstanbul Iğdır", "ΟΔΟΣ ΣΑΣ'ΑΣ.Β Σ", "Cafe\u0301s “naïve”—l’été\u0301 ½ x²", odd, "中文 saws", "y" * 2_000 + "ing"]
    texts += ["".join(pool.choices(odd + "aeiou sss " * 40, k=pool.randint(0, 80))) for _ in range(150)]
    docs = spark.createDataFrame([(i, x, pool.choice(texts)) for i, x in enumerate(texts)], "rowid long, text string, more string")
    made = postings.postings_of(docs, analyser, "text", "more")
    assert "regexp" not in made._jdf.queryExecution().executedPlan().toString().lower()
    want = {}
    terms, stems = analysis.ANALYSERS[analyser]
    for r in docs.select("rowid", *(terms(F.coalesce(c, F.lit(""))).alias(c) for c in ("text", "more"))).collect():
        for k, w in [*enumerate(r.text), *enumerate(r.more, len(r.text) + 1)]:
            want.setdefault((analysis.porter(w) if stems else w, r.rowid, len(r.text) + len(r.more)), []).append(k)
    got = [((r.term, r.rowid, r.doc_len), r.pos) for r in made.collect()]
    assert dict(got) == want and len(got) == len(want)


def test_segments_of_an_index_end_between_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT_TOKENS", 3)
    rows = [(i, f"of the w{i} of the", "x") for i in range(20)] + [(20, None, "y"), (21, "", None)]
    index = build_index(spark.createDataFrame(rows, "rowid long, text string, title string").coalesce(1), str(tmp_path / "index"), ["title"], "simple")
    assert {(r.rowid, r.f) for r in phrase_counts(index, [["of", "the"]]).collect()} == {(i, 2) for i in range(20)}
    assert {(r.rowid, r.title, r.doc_len) for r in index.docs.collect()} == {(i, t, 5 if i < 20 else 0) for i, _, t in rows}
    assert index.rows == 22 and math.isclose(index.mean, 100 / 22) and index.unique
    assert {r.term: r.df for r in postings.term_df(index, ["of", "w3"]).collect()} == {"of": 20, "w3": 1}


def test_rows_that_share_an_id(spark, tmp_path):
    """They count as one row, in frequencies, phrases and document figures alike."""
    rows = [(1, "of the saw"), (1, "of the the"), (2, "the of the"), (None, "of the")]
    index = build_index(spark.createDataFrame(rows, "rowid long, text string"), str(tmp_path / "index"), [], "simple")
    assert not index.unique and index.rows == 4
    counts = {(r.phrase, r.rowid): r.f for r in phrase_counts(index, [["the"], ["of", "the"]]).collect()}
    assert counts == {(0, 1): 3, (0, 2): 2, (0, None): 1, (1, 1): 4, (1, 2): 1}
    assert {r.term: r.df for r in postings.term_df(index, ["the", "saw"]).collect()} == {"the": 2, "saw": 1}  # an id that is null is none


def test_an_empty_library(spark, tmp_path):
    index = build_index(spark.createDataFrame([], "rowid long, text string"), str(tmp_path / "index"), [], "porter")
    assert index.rows == 0 and matched(index, Query((("saw",),))).count() == 0 and postings.term_df(index).count() == 0


def _counted(texts, q, min_df):
    """Words and pairs of neighbours by brute force, in order, families of one word each."""
    df = Counter(t for x in texts for w in [x.split()] for t in {*w, *map(" ".join, zip(w, w[1:], strict=False))})
    kept = [(t, n) for t, n in df.items() if n >= min_df and set(t.split()) - {q} and not (" " not in t and t.startswith(q[:5]))]
    return sorted(kept, key=lambda x: (-x[1], -len(x[0]), x[0]))


@pytest.mark.parametrize("frequent", [0, 3, 12, 2_000])
@pytest.mark.parametrize("cap", [4, 60])
def test_mined_terms_equal_a_whole_count(spark, monkeypatch, frequent, cap):
    """However many words are sent along with the scan of pairs; ties at the last place included."""
    monkeypatch.setattr(topics, "FREQUENT", frequent)
    pool = random.Random(5)
    names = ["zaba", "zabu", "zico", "zicu", "zido", "zidu", "zofa", "zofu", "zuga", "zugo"]
    texts = [" ".join(pool.choices(names, range(10, 0, -1), k=pool.randint(0, 9))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, None)], "rowid long, text string")
    got = [(r.term, r.df) for r in topics.candidate_terms(docs, ["zaba"], 2, cap).collect()]
    assert got == _counted(texts, "zaba", 2)[:cap]


def test_pairs_of_rare_words_are_not_counted(spark):
    """Only words as frequent as the last of the best terms make up pairs."""
    docs = spark.createDataFrame([(i, f"zaba zico rare{chr(97 + i)}x other{chr(97 + i)}x") for i in range(20)] * 2, "rowid long, text string")
    made = topics.candidate_terms(docs, ["none"], 2, 2)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.term, r.df) for r in made.collect()] == [("zaba zico", 40), ("zaba", 40)]
    assert "zaba" in plan and "rareax" not in plan
    rows = spark.createDataFrame([(["a", "b", "x", "b", "a", "b"],), ([],)], "w array<string>")
    assert [r.terms for r in topics.neighbours(rows, ["a", "b"]).collect()] == [["a b", "b a"], []]
