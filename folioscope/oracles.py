"""DuckDB SQL with the results of ``queries``; written from the definitions, not from the plans."""

from __future__ import annotations

from folioscope.functions.analysis import LIGHT_SUFFIXES
from folioscope.operators.topics import STOPWORDS

SQL: dict[str, str] = {}

_YEAR = "CASE WHEN doc_id % 7 <> 0 THEN CAST(1900 + doc_id % 120 AS INTEGER) END"
_DOCS = f"""toks AS (SELECT doc_id AS rowid, lang AS collection, source AS title, {_YEAR} AS year,
  regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
d AS (SELECT rowid, collection, title, year, len(t) AS doc_len FROM toks),
p AS (SELECT rowid, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM toks)"""


def _phrase(words: list[str], i: int) -> str:
    joins = " ".join(f"JOIN p p{k} ON p{k}.rowid = p0.rowid AND p{k}.pos = p0.pos + {k} AND p{k}.term = '{w}'" for k, w in enumerate(words) if k)
    return f"SELECT {i} AS phrase, p0.rowid, count(*) AS f FROM p p0 {joins} WHERE p0.term = '{words[0]}' GROUP BY p0.rowid"


def _matched(groups: list[list[str]], excluded: list[str] = ()) -> str:
    """CTEs down to m(rowid, score) by BM25 over the phrases of the groups."""
    phrases = list(dict.fromkeys([x for g in groups for x in g] + list(excluded)))
    place = {x: i for i, x in enumerate(phrases)}
    wanted = ", ".join(str(place[x]) for g in groups for x in g)
    tests = [" OR ".join(f"bool_or(phrase = {place[x]})" for x in g) for g in groups] + [f"NOT bool_or(phrase = {place[x]})" for x in excluded]
    return f"""{_DOCS},
f AS ({' UNION ALL '.join(_phrase(x.split(), i) for x, i in place.items())}),
n AS (SELECT phrase, count(*) AS n FROM f GROUP BY phrase),
c AS (SELECT count(*) AS n_rows, avg(doc_len) AS mean FROM d),
w AS (SELECT phrase, CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM n, c),
m AS (SELECT f.rowid, sum(CASE WHEN f.phrase IN ({wanted}) THEN idf * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * doc_len / mean)) END) AS score
  FROM f JOIN w USING (phrase) JOIN d ON d.rowid = f.rowid, c GROUP BY f.rowid HAVING {' AND '.join(f'({t})' for t in tests)})"""


def _best(groups: list[list[str]], excluded: list[str] = (), n: int = 20) -> str:
    return f"WITH {_matched(groups, excluded)} SELECT rowid, round(score, 6) AS score FROM m ORDER BY m.score DESC, rowid LIMIT {n}"


WITH = _matched([["with"]])
SQL["bm25_term"] = _best([["with"]])
SQL["bm25_and"] = _best([["with"], ["from"]])
SQL["bm25_or_group"] = _best([["this", "that", "était"]])
SQL["bm25_not"] = _best([["with"]], ["from"])
SQL["phrase_match"] = _best([["of the"], ["in"]])
SQL["phrase_frequency"] = f"WITH {_DOCS} {_phrase(['of', 'the'], 0)} UNION ALL {_phrase(['the'], 1)} UNION ALL {_phrase(['de', 'la'], 2)}"
SQL["search_filtered"] = f"WITH {WITH} SELECT rowid, collection, year, round(score, 6) AS score FROM m JOIN d USING (rowid) WHERE collection = 'en' AND year BETWEEN 1920 AND 1980 ORDER BY m.score DESC, rowid LIMIT 20"
SQL["search_sort_title"] = f"WITH {WITH} SELECT rowid, title FROM m JOIN d USING (rowid) ORDER BY title, rowid LIMIT 20"
SQL["search_newest_nulls_last"] = f"WITH {WITH} SELECT rowid, title, year FROM m JOIN d USING (rowid) ORDER BY year DESC NULLS LAST, title, rowid LIMIT 30"
SQL["search_oldest_nulls_last"] = f"WITH {WITH} SELECT rowid, title, year FROM m JOIN d USING (rowid) ORDER BY year ASC NULLS LAST, title, rowid LIMIT 30"
SQL["search_total"] = f"WITH {_matched([['with'], ['from']])} SELECT count(*) AS total FROM m"
SQL["facet_counts"] = f"WITH {_matched([['the', 'de', 'der']])} SELECT collection, count(*) AS n FROM m JOIN d USING (rowid) GROUP BY collection"
SQL["top_sources_for_query"] = f"WITH {WITH} SELECT title, min(collection) AS collection, count(*) AS n FROM m JOIN d USING (rowid) GROUP BY title ORDER BY n DESC, title LIMIT 12"
_CAPPED = f"WITH {WITH}, k AS (SELECT m.rowid, title, score FROM m JOIN d ON d.rowid = m.rowid QUALIFY row_number() OVER (PARTITION BY title ORDER BY score DESC, m.rowid) <= 2)"
SQL["diversified_top"] = f"{_CAPPED} SELECT rowid, title, round(score, 6) AS score FROM k ORDER BY k.score DESC, rowid LIMIT 20"
SQL["paged_diversified"] = f"{_CAPPED} SELECT rowid, title, round(score, 6) AS score FROM k ORDER BY k.score DESC, rowid LIMIT 10 OFFSET 10"
SQL["term_df"] = f"WITH {_DOCS} SELECT term, count(DISTINCT rowid) AS df FROM p GROUP BY term"
SQL["doc_lengths"] = f"WITH {_DOCS} SELECT rowid, doc_len FROM d"
SQL["term_cooccurrence_with_query"] = f"WITH {_matched([['with'], ['from']])} SELECT term, count(DISTINCT p.rowid) AS n FROM p JOIN m ON m.rowid = p.rowid WHERE term IN ('this', 'that', 'which', 'be', 'are') GROUP BY term"
SQL["page_npmi"] = f"""WITH {_matched([['from']])},
x AS (SELECT term, count(DISTINCT p.rowid) AS df, count(DISTINCT m.rowid) AS n FROM p LEFT JOIN m ON m.rowid = p.rowid WHERE term IN ('this', 'was', 'which', 'la') GROUP BY term),
q AS (SELECT (SELECT count(*) FROM m)::DOUBLE AS q, (SELECT count(*) FROM d)::DOUBLE AS t)
SELECT term, n, round(CASE WHEN n <= 0 OR n >= t THEN 0.0 ELSE ln((n::DOUBLE * t) / (q * df)) / -ln(n / t) END, 6) AS score FROM x, q"""
SQL["snippet_fallback"] = """SELECT doc_id AS rowid, CASE WHEN length(t) > 160 THEN substring(t, 1, 160) || ' …' ELSE t END AS snippet
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)"""
SQL["fetch_in_order"] = "SELECT doc_id AS rowid, lang AS collection, source AS title FROM documents WHERE doc_id IN (42, 7, 3, 19)"
SQL["folded_text"] = "SELECT doc_id AS rowid, md5(lower(translate(text, 'ıİşŞğĞüÜöÖçÇâÂîÎûÛ', 'iissgguuooccaaiiuu'))) AS digest, md5(lower(source)) AS title_digest FROM documents"
SQL["unmarked_text"] = "SELECT doc_id AS rowid, md5(strip_accents(lower(text))) AS digest FROM documents"
SQL["query_language"] = """SELECT * FROM (VALUES
('mitre "band saw" -plywood', '"band saw" AND ("mitre" OR "miter") NOT "plywood"'), ('half-blind dovetail', '"half-blind" AND "dovetail"'),
('colour centre', '("colour" OR "color") AND ("centre" OR "center")'), ('"quoted only"', '"quoted only"'), ('-nothing', NULL), ('', NULL), ('ahşap zıvana nasıl', '"wood" AND "tenon" AND ("mortise" OR "mortice")'),
('gönye', '("miter" OR "mitre")'), ('gönyeli', '("miter" OR "square")'), ('vidalar nasıl sıkılır', '"screw" AND "tighten"'), ('bant testere', '"tape measure" AND "saw"'), ('meşe cila', '"oak" AND "finish" AND "polish"'),
('Kırlangıç Kuyruğu', '"dovetail"'), ('tornada ceviz oyma', '"lathe" AND "walnut" AND "carving"'), ('nasıl yapılır', NULL)) v(typed, match)"""

_NEAR = "v AS (SELECT a.vec_id AS rowid, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b)"
SQL["vector_topk"] = f"WITH {_NEAR} SELECT rowid, round(cos, 6) AS score FROM v ORDER BY cos DESC, rowid LIMIT 20"
_FUSED = "SELECT rowid, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM (SELECT rowid, r FROM kw WHERE r <= 800 UNION ALL SELECT rowid, r FROM nr) GROUP BY rowid ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, rowid LIMIT 50"
SQL["rrf_hybrid"] = f"""WITH {WITH}, {_NEAR}, kw AS (SELECT rowid, row_number() OVER (ORDER BY score DESC, rowid) AS r FROM m),
nr AS (SELECT rowid, row_number() OVER (ORDER BY cos DESC, rowid) AS r FROM v QUALIFY r <= 400) {_FUSED}"""
SQL["hybrid_filtered"] = f"""WITH {WITH}, {_NEAR}, ok AS (SELECT rowid FROM d WHERE collection = 'en' AND year >= 1950),
kw AS (SELECT rowid, row_number() OVER (ORDER BY score DESC, rowid) AS r FROM m WHERE rowid IN (SELECT rowid FROM ok)),
pool AS (SELECT rowid, cos FROM v ORDER BY cos DESC, rowid LIMIT 400),
nr AS (SELECT rowid, row_number() OVER (ORDER BY cos DESC, rowid) AS r FROM pool WHERE rowid IN (SELECT rowid FROM ok)) {_FUSED}"""
SQL["pending_vectors"] = "SELECT doc_id AS rowid FROM documents WHERE length(text) >= 40 AND doc_id NOT IN (SELECT vec_id FROM embeddings)"
SQL["prune_vectors"] = "SELECT vec_id AS rowid FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"
SQL["embedding_coverage"] = """SELECT pages, skipped, embedded, CAST(least(100, round(100.0 * embedded / (pages - skipped))) AS INTEGER) AS pct FROM
(SELECT count(*) AS pages, count(*) FILTER (length(text) < 40) AS skipped, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS embedded FROM documents)"""

_TAGS = "t AS (SELECT DISTINCT l_orderkey AS o, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey), fr AS (SELECT tag, count(*) AS freq FROM t GROUP BY tag), co AS (SELECT x.tag AS a, y.tag AS b, count(*) AS w FROM t x JOIN t y ON x.o = y.o AND x.tag < y.tag GROUP BY x.tag, y.tag)"
SQL["tag_frequency"] = f"WITH {_TAGS} SELECT tag, freq FROM fr"
SQL["tag_cooccurrence"] = f"WITH {_TAGS} SELECT a, b, w FROM co"
SQL["topic_graph_edges"] = f"WITH {_TAGS}, k AS (SELECT tag FROM fr ORDER BY freq DESC, tag LIMIT 12) SELECT a, b, w FROM co WHERE w >= 3 AND a IN (SELECT tag FROM k) AND b IN (SELECT tag FROM k)"
SQL["npmi_related"] = f"""WITH {_TAGS}, q AS (SELECT o FROM t WHERE tag = 'Brand#11'), s AS (SELECT count(*)::DOUBLE AS nq, (SELECT count(DISTINCT l_orderkey) FROM lineitem)::DOUBLE AS total FROM q),
x AS (SELECT p_brand AS tag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT o FROM q) AND p_brand <> 'Brand#11' GROUP BY p_brand)
SELECT x.tag, n, round(CASE WHEN n >= total THEN 0.0 ELSE ln((n::DOUBLE * total) / (nq * freq)) / -ln(n / total) END, 6) AS score FROM x JOIN fr USING (tag), s"""
SQL["canonical_tag_groups"] = """WITH n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE replace(p_type, ' ', '-') END AS tag FROM part), f AS (SELECT tag, count(*) AS freq FROM n GROUP BY tag)
SELECT tag, first_value(tag) OVER (PARTITION BY regexp_replace(lower(tag), '[^a-z0-9]+', '', 'g') ORDER BY freq DESC, length(tag), tag) AS main, freq FROM f"""
SQL["typo_pairs_levenshtein"] = """WITH f AS (SELECT p_brand AS tag, count(*) AS freq FROM part GROUP BY p_brand)
SELECT o.tag, m.tag AS main FROM f o, f m WHERE o.tag <> m.tag AND m.freq >= greatest(1, o.freq) AND levenshtein(lower(o.tag), lower(m.tag)) = 1"""
SQL["tag_merge"] = "SELECT * FROM (VALUES ('Hand Planes', 8), ('Dovetails', 7), ('Dovetials', 2), ('Water Stones', 1)) v(tag, n)"
SQL["select_topics_greedy"] = """SELECT * FROM (VALUES (1, 'Sharpening Stones', 30, 0.9), (2, 'Sharpening Jigs', 20, 0.8), (3, 'Sharpening Chisels', 20, 0.7),
(4, 'Water Tables', 9, 0.5), (5, 'Sharpening Planes', 20, 0.372)) v(place, tag, n, score)"""
SQL["light_stem_sets"] = """SELECT * FROM (VALUES ('Boards', 'board'), ('Spokeshaves', 'spokeshave'), ('Sharpening Stones', 'sharpen stone'), ('Boxes and Benches', 'bench boxe'), ('Tool Making', 'making'), ('Berries', 'berry')) v(name, stems)"""

SQL["title_resolver"] = """SELECT * FROM (VALUES ('/lib/Popular Mechanics 2025/7.pdf', 'Popular Mechanics No. 7', 'folder'), ('/lib/x/Joinery Handbook - A. Miller.pdf', NULL, 'keep'),
('/lib/books/12.pdf', 'The Shop Journal No. 12', 'metadata'), ('/lib/books/issue 3 final.pdf', 'Popular Woodworking', 'masthead'), ('/lib/1999/draft v2.pdf', NULL, 'fallback'), ('/lib/scans/44.pdf', 'Shop Notes No. 44', 'masthead')) v(path, pub, pub_src)"""
SQL["display_clean"] = """SELECT * FROM (VALUES ('_vk_com_', ''), ('Hand_Tools-ne', 'Hand Tools'), ('THE COMPLETE BOOK (USA) DVD', 'THE Complete Book (USA) DVD'), ('Jig ((A. Writer))', 'Jig (A. Writer)'), ('Boxes {AB12CD34}', 'Boxes'),
('A - - B', 'A - B'), ('wood[ ] turning ( )', 'wood turning'), ('USSR-TIMBER', 'USSR-Timber'), ('The  Joiner   (LIBGEN)', 'The Joiner')) v(raw, clean)"""
SQL["title_years"] = "SELECT * FROM (VALUES ('1902Plain', NULL), ('1902 Plain Joinery', 1902), ('Guide 1850 to 1975', 1975), ('Model-1999', NULL), ('none', NULL)) v(title, year)"
SQL["mode_year_per_customer"] = "WITH c AS (SELECT o_custkey AS custkey, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1, 2) SELECT custkey, y AS year FROM c QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY n DESC, y) = 1"
SQL["head_tail_text"] = """WITH r AS (SELECT source AS path, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS up, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS down FROM documents)
SELECT path, md5(string_agg(text, ' ' ORDER BY doc_id) FILTER (up <= 6)) AS head, md5(string_agg(text, ' ' ORDER BY doc_id) FILTER (down <= 4)) AS tail FROM r GROUP BY path"""

_SRC = """s AS (SELECT source AS path, min(lang) AS collection, count(*) AS pages, count(*) FILTER (length(trim(text)) >= 40) AS indexed_pages, sum(length(text)) FILTER (length(trim(text)) >= 40) AS chars FROM documents GROUP BY source)"""
SQL["classify_sources"] = """SELECT path, pages, indexed_pages, chars, CASE WHEN indexed_pages / pages < 0.9 THEN 'image-only' ELSE 'indexed' END AS status FROM
(SELECT source AS path, count(*) AS pages, count(*) FILTER (length(trim(text)) >= 400) AS indexed_pages, coalesce(sum(length(text)) FILTER (length(trim(text)) >= 400), 0) AS chars FROM documents GROUP BY source)"""
SQL["library_counters"] = f"""WITH {_SRC} SELECT (SELECT count(*) FROM s) AS books, (SELECT sum(indexed_pages) FROM s) AS pages, (SELECT sum(chars) FROM s) AS chars, (SELECT count(*) FROM s WHERE indexed_pages / pages < 0.15) AS image_only,
count(*) FILTER (event_type NOT IN ('error', 'purchase')) AS active, count(*) FILTER (event_type = 'error') AS failed, 0 AS double_indexed FROM events"""
_PATH = "'/Lib/' || lang || CASE WHEN doc_id % 2 = 0 THEN '\\' ELSE '//' END || source || CASE WHEN doc_id % 3 = 0 THEN ' (1)' ELSE '' END || '.pdf'"
_ONE = "'/' || lang || '/' || source || CASE WHEN doc_id % 3 = 0 THEN ' (1)' ELSE '' END || '.pdf'"
SQL["duplicate_groups"] = f"SELECT lower('/lib' || {_ONE}) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"
SQL["copy_key_groups"] = "SELECT '/lib/' || lower(lang) || '/' || lower(source) AS \"copy\", count(*) AS n FROM documents GROUP BY 1"
SQL["walk_filter"] = f"SELECT doc_id AS id, {_PATH} AS path FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND lang <> 'de'"
_JOBS = "j AS (SELECT event_id AS id, '/lib/' || user_id || '.pdf' AS path, user_id::VARCHAR AS title, event_type AS status, coalesce(props, '') AS detail, epoch_us(ts)::DOUBLE AS updated FROM events)"
_LAST = "QUALIFY row_number() OVER (PARTITION BY path ORDER BY updated DESC, id DESC) = 1"
SQL["latest_job_status"] = f"WITH {_JOBS} SELECT path, id, status FROM j {_LAST}"
SQL["job_event_states"] = f"WITH {_JOBS} SELECT path AS job, status, updated FROM j WHERE status <> 'view' QUALIFY row_number() OVER (PARTITION BY path ORDER BY updated DESC, status DESC, detail DESC) = 1"
SQL["event_resume"] = "SELECT event_id AS seq, event_type FROM events WHERE event_id > (SELECT max(event_id) - 50 FROM events)"
SQL["upsert_jobs"] = f"""WITH {_JOBS}, n AS (SELECT * FROM j WHERE id % 2 = 1 {_LAST}), o AS (SELECT * FROM j WHERE id % 2 = 0 {_LAST})
SELECT path, id, status FROM n UNION ALL SELECT path, id, status FROM o WHERE path NOT IN (SELECT path FROM n)"""
SQL["insert_or_ignore"] = "SELECT n_nationkey AS c_nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 10) THEN 'old' ELSE 'new' END AS src FROM nation"
SQL["additive_schema"] = "SELECT r_regionkey, NULL::VARCHAR AS r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region"
SQL["tidy_jobs"] = f"WITH {_JOBS} SELECT path, id, status FROM j WHERE path IN (SELECT path FROM j WHERE status = 'purchase') {_LAST}"
SQL["cascade_delete_counts"] = "SELECT count(*) AS pages, count(*) AS pyear, count(DISTINCT source) AS sources FROM documents WHERE source IN ('src3', 'src7')"
SQL["archive_summary"] = "SELECT '/arc/' || source AS pdf_path, source AS title, min(lang) AS collection, count(*) AS n_pages, sum(length(text)) AS chars, CAST(max(doc_id) AS INTEGER) AS last_page FROM documents GROUP BY source"
SQL["collection_counts"] = "SELECT CASE WHEN lang = 'es' THEN '(none)' ELSE lang END AS name, count(*) AS n FROM documents GROUP BY 1"
SQL["books_list"] = f"""WITH y AS (SELECT source, {_YEAR} AS year, count(*) AS c FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, year) = 1),
b AS (SELECT DISTINCT d.source AS file, CASE WHEN d.source = 'src4' THEN 'duplicate' WHEN d.source = 'src5' THEN 'missing' WHEN d.source = 'src2' THEN 'indexing' ELSE 'indexed' END AS status, y.year, d.source <> 'src5' AS exists,
CASE WHEN d.source = 'src1' THEN 2 END AS copies, NULL::VARCHAR AS dup_of FROM documents d LEFT JOIN y ON y.source = d.source)
SELECT * FROM b UNION ALL SELECT * FROM (VALUES ('src1 (1).pdf', 'not-indexed', NULL, true, NULL, 'src1'), ('new.pdf', 'not-indexed', NULL, true, NULL, NULL)) v"""
SQL["table_fingerprint"] = "SELECT count(*) AS n FROM orders"
SQL["engine_search"] = f"""WITH {_matched([['with'], ['from']], ['this'])}, k AS (SELECT m.rowid, title, collection, year, score FROM m JOIN d ON d.rowid = m.rowid WHERE collection = 'en' AND year >= 1910
QUALIFY row_number() OVER (PARTITION BY title ORDER BY score DESC, m.rowid) <= 2) SELECT rowid, title, collection, year, round(score, 6) AS score FROM k ORDER BY k.score DESC, rowid LIMIT 15"""
SQL["engine_hybrid"] = f"""WITH {WITH}, {_NEAR}, kw AS (SELECT rowid, row_number() OVER (ORDER BY score DESC, rowid) AS r FROM m), nr AS (SELECT rowid, row_number() OVER (ORDER BY cos DESC, rowid) AS r FROM v QUALIFY r <= 400),
u AS (SELECT rowid, sum(1.0::DOUBLE / (60 + r)) AS s FROM (SELECT rowid, r FROM kw WHERE r <= 800 UNION ALL SELECT rowid, r FROM nr) GROUP BY rowid ORDER BY s DESC, rowid LIMIT 1200),
k AS (SELECT u.rowid, title, s FROM u JOIN d ON d.rowid = u.rowid QUALIFY row_number() OVER (PARTITION BY title ORDER BY s DESC, u.rowid) <= 2)
SELECT rowid, title, round(s, 8) AS score FROM k ORDER BY s DESC, rowid LIMIT 15"""

SQL["year_repair_plan"] = "SELECT * FROM (VALUES ('/a', NULL, 1855, 'assign', 1855), ('/b', 1924, 1912, 'replace', 1912), ('/c', 1950, 1950, 'keep', 1950), ('/d', 1931, 1931, 'keep', 1931)) v(path, old, new, action, written)"
SQL["title_repair_plan"] = """SELECT * FROM (VALUES ('/l/7.pdf', NULL, 'Popular Mechanics No. 7', 'change', 'Popular Mechanics No. 7'), ('/l/Tool Chest.pdf', NULL, NULL, 'same', NULL),
('/l/9.pdf', 'Old Name', 'Woodsmith No. 9', 'change', 'Woodsmith No. 9')) v(path, old, new, action, written)"""
SQL["merged_copies"] = f"WITH {_JOBS}, n AS (SELECT * FROM j {_LAST}) SELECT path, CASE WHEN title::INT < 20 THEN 'duplicate' ELSE status END AS status FROM n WHERE path <> '/lib/3.pdf'"
SQL["bulk_outcome"] = "SELECT * FROM (VALUES ('done', 2), ('not found', 1)) v(outcome, n)"
SQL["jobs_with_titles"] = f"WITH {_JOBS}, n AS (SELECT * FROM j {_LAST}) SELECT path, status, CASE path WHEN '/lib/1.pdf' THEN 'One Title' WHEN '/lib/2.pdf' THEN 'A Journal No. 2' ELSE title END AS shown FROM n"
SQL["tokenize_table_function"] = "SELECT generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS term FROM (SELECT regexp_extract_all(lower('Café-crème, don''t 12'), '[\\p{L}\\p{N}]+') AS t)"
SQL["year_detect"] = """SELECT * FROM (VALUES ('1871-Of-Stairs', 1871, 78, 1871, 'assign'), ('Carpentry', 1912, 88, 1912, 'replace'), ('Chairs', 1931, 96, 1931, 'keep'),
('Tools', NULL, 0, NULL, 'none'), ('T-1810 Manual', 1810, 62, 1810, 'assign'), ('Old book', 1999, 26, 1950, 'keep'),
('Vol 3 Oak 1920', NULL, 0, NULL, 'none'), ('Joints', NULL, 0, NULL, 'none'), ('Turning', NULL, 0, NULL, 'none'), ('Inlay', NULL, 0, NULL, 'none')) v(title, year, confidence, new_year, action)"""
SQL["concept_profiles"] = f"""WITH {_TAGS}, h AS (SELECT tag, o FROM t QUALIFY row_number() OVER (PARTITION BY tag ORDER BY o) <= 8)
SELECT tag, substring(tag || '. ' || string_agg('Order ' || o, '. ' ORDER BY o), 1, 700) AS profile FROM h GROUP BY tag"""


def _light_stem(w: str) -> str:
    plural = f"CASE WHEN len({w}) >= 4 AND {w} LIKE '%ies' THEN left({w}, -3) || 'y' WHEN len({w}) >= 6 AND regexp_matches({w}, '(ch|sh|x|z)es$') THEN left({w}, -2) WHEN len({w}) >= 5 AND regexp_matches({w}, '[^sui]s$') THEN left({w}, -1) ELSE {w} END"
    cases = " ".join(f"WHEN len(p) >= {4 + len(s)} AND p LIKE '%{s}' THEN left(p, -{len(s)})" for s in LIGHT_SUFFIXES)
    return f"(SELECT CASE {cases} ELSE p END FROM (SELECT {plural} AS p))"


SQL["bigram_candidates"] = f"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_extract_all(lower(text), '[a-z][a-z''\\-]{{2,}}') IF NOT list_contains({STOPWORDS}, trim(x, '''-'))] AS w FROM documents),
g AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w))),
c AS (SELECT term, count(*) AS df FROM g GROUP BY term HAVING count(*) >= 4),
f AS (SELECT term, df FROM c WHERE term NOT IN ('with', 'with with') AND (term LIKE '% %' OR left(term, 4) <> 'with'))
SELECT term, df FROM (SELECT term, df, CASE WHEN term LIKE '% %' THEN term ELSE {_light_stem('term')} END AS family FROM f) QUALIFY row_number() OVER (PARTITION BY family ORDER BY df DESC, len(term) DESC, term) = 1
ORDER BY df DESC, len(term) DESC, term LIMIT 30"""

SQL["search_form"] = _best([["with"], ["from"], ["of the"], ["this", "that"]], ["which"])
SQL["search_simple"] = _best([["of the"], ["with"]])
SQL["search_simple_any"] = _best([["with", "from"]])
SQL["search_expanded"] = _best([["colour", "color", "with"]])
SQL["rewritten_queries"] = """SELECT * FROM (VALUES ('colour chart', 'colour > color', 'colour chart'), ('plain words', '', 'plain words'), ('gönye', 'gönye > miter > mitre', 'miter')) v(typed, rewritten, asked)"""
SQL["page_text"] = "SELECT source AS title, lang AS collection, CAST(doc_id AS VARCHAR) AS page, md5(text) AS digest FROM documents WHERE doc_id = 42"
SQL["page_terms"] = "SELECT source AS title, CAST(doc_id AS VARCHAR) AS page, array_to_string(regexp_extract_all(text, '[0-9A-Za-zÇĞİÖŞÜçğıöşüÂâÎîÛû][0-9A-Za-zÇĞİÖŞÜçğıöşüÂâÎîÛû''\\-]*')[1:12], ' ') AS terms FROM documents WHERE doc_id = 42"
SQL["ascii_tokens"] = "SELECT doc_id AS rowid, CAST(len(regexp_extract_all(lower(text), '[0-9A-Za-z][0-9A-Za-z''\\-]*')) AS INTEGER) AS n FROM documents"
_NAMES = """n AS (SELECT doc_id AS id, '/Lib/' || lang || CASE WHEN doc_id % 2 = 0 THEN '\\' ELSE '//' END || source || CASE WHEN doc_id % 3 = 0 THEN ' (1)' ELSE '' END || '.pdf' AS path FROM documents),
k AS (SELECT id, path, lower(replace(replace(path, '\\', '/'), '//', '/')) AS key FROM n)"""
SQL["stored_paths"] = f"WITH {_NAMES} SELECT DISTINCT path, key FROM k"
SQL["hybrid_readiness"] = """SELECT n >= 100 AND floor(100.0 * n / greatest(p, 1)) >= 20 AS usable, false AS without_model, false AS with_too_few
FROM (SELECT count(*) FILTER (WHERE length(text) >= 40) AS p, count(*) FILTER (WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS n FROM documents)"""
SQL["new_files"] = """SELECT '/Lib/' || c_custkey || '.PDF' AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 50 = 0)"""
SQL["one_source_per_file"] = f"""WITH {_NAMES} SELECT path, id FROM k
QUALIFY row_number() OVER (PARTITION BY key ORDER BY path NOT IN (SELECT path FROM n WHERE id % 5 = 0), path, CAST(id AS VARCHAR)) = 1"""
SQL["path_spellings"] = f"WITH {_NAMES} SELECT DISTINCT path FROM k WHERE key = '/lib/en/src1.pdf'"
SQL["exact_delete_counts"] = "SELECT count(*) AS pages, count(*) AS pyear FROM documents WHERE source = 'src7'"
SQL["collection_of_path"] = "SELECT doc_id AS id, lang AS collection FROM documents"
SQL["decision_tally"] = """SELECT status, count(*) AS n FROM (SELECT source, CASE WHEN avg(CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 400 THEN 1 ELSE 0 END) < 0.9 THEN 'image-only' ELSE 'indexed' END AS status
FROM documents GROUP BY source) GROUP BY status"""
SQL["leading_years"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders"
SQL["embedded_pages"] = "SELECT doc_id AS rowid, round(CAST(CAST(3 / sqrt(m * m + 25) AS FLOAT) AS DOUBLE), 4) AS second, 'lengths' AS model_id FROM (SELECT doc_id, least(length(text), 1200) % 7 AS m FROM documents)"
