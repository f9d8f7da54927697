"""DuckDB SQL of the training-data queries that SQL can express.

Left out, and tested against brute force, round trips or held-out accuracy instead: op2 and op6 (their
methods add spans and labels by checksums and bounded errors; their base columns are queries of their
own, ``secrets_base`` and ``licenses_base``), op4 and op7 (networks), op5 (passages
grown around samples), op10 (a tokenizer), and the pipeline made of them.
"""

SQL: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op1_decontaminate"] = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT item, least(8, len(w)) AS n, array_to_string(w[k:k + least(8, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
m AS (SELECT doc_id, k, i.n, item FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i)) x
  JOIN i ON i.n = x.n AND i.g = array_to_string(w[k:k + x.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

SQL["op3_neardup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, top) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.doc_id WHERE r.top < l.b),
c AS (SELECT doc_id, min(top) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_KEYWORDS = "|".join([*map(_ANY_CASE, ("password", "passwd", "secret", "token")), _ANY_CASE("api") + "_?" + _ANY_CASE("key")])


def _matches(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Places of a pattern's leftmost non-overlapping matches: text between them and their own lengths add up."""
    pieces = f"string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {group}) AS said"
    ends = "sum(len(gaps[i]) + len(found[i])) OVER (PARTITION BY r ORDER BY i)"
    rows = f"SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT r, {pieces} FROM d)"
    return f"SELECT r, '{kind}' AS kind, {place} AS place, e - len(found[i]) AS s, e FROM (SELECT *, {ends} AS e FROM ({rows})) WHERE len(said[i]) >= {least}"


_ASSIGN = rf"""({_KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SQL["secrets_base"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_matches("assign", 0, _ASSIGN, 2, 6)} UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_matches("hex", 2, "[0-9a-f]+", 0, 24)}),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, place) AS said FROM m GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)"""

SQL["licenses_base"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
x AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT r, i - 1 AS place, label FROM x JOIN p ON w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase),
g AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (r)"""

SQL["op8_topk"] = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) QUALIFY row_number() OVER w <= 20"""

SQL["op9_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
x AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS t, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length('<|im_start|>' || r || '<|im_sep|>' || t || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars FROM x GROUP BY conv_id"""
