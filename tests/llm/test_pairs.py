"""Near duplicates, substrings, components, top-k search: against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from folioscope.llm import neardup, near, substrings, topk
from folioscope.llm.common import BLANK_BYTES, Shelf, split_words
from folioscope.llm.components import components
from folioscope.llm.near import Rule
from folioscope.llm.shingles import Sketcher, shingles, words


def grams(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(n):
        kind = rng.random()
        if docs and kind < 0.6:
            w = rng.choice(docs).split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(" ".join(w) if kind < 0.4 else " ".join(w[: rng.randint(1, len(w) or 1)]) if w else "")
        else:
            docs.append(" ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 5, 40, 120]))))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_neardup_equals_brute_force(spark, seed, monkeypatch):
    docs = corpus(seed)
    rows = [(i * 3, t) for i, t in enumerate(docs)]
    sets = {i: grams(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rule = Rule(per=85, block_items=5 if seed else 1024, broadcast_ids=0 if seed == 2 else 500_000)
    got = {r.id: (r.n, r.component) for r in neardup.classes(df, rule).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    kept = {r.doc_id for r in neardup.deduplicated(df, rule).collect()}
    assert kept == set(want.values())


def test_neardup_edges(spark):
    long = " ".join(f"x{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  b"), (None, "a b"), (7, long), (8, long + " y"), (8, long + " y"), (9, "b a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.report(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (0, 1, None, True), (7, 2996, 7, True), (8, 2997, 7, False), (8, 2997, 7, False), (9, 1, 9, True)], key=str)
    assert neardup.report(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in neardup.deduplicated(df).collect()) == sorted(["1", "2", "3", "4", "None", "7", "9"])


def test_neardup_of_ids_with_several_texts(spark):
    """Links go through all texts of an id; rows equal in id and text count once."""
    rng = random.Random(4)
    a, b = prose(rng, 60, 0), prose(rng, 60, 0)
    rows = [(5, a), (5, b), (7, a + " x"), (9, b + " x"), (9, b + " x"), (11, prose(rng, 60, 0)), (11, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _gone int")
    assert sorted({(r.doc_id, r.component_id) for r in neardup.report(df).collect()}) == [(5, 5), (7, 5), (9, 5), (11, 11)]
    assert sorted((r.doc_id, r.text) for r in neardup.deduplicated(df).collect()) == sorted([rows[0], rows[1], rows[5], rows[6]])
    many = [(1, " ".join(f"m{(i * 7 + k) % 300}" for k in range(60))) for i in range(40)]  # one id with many texts
    sets = {i: grams(t) for i, t in enumerate([*(t for _, t in many), a])}
    assert len({tuple(sorted(s)) for s in sets.values()}) == 41
    assert {(r.id, r.component) for r in neardup.classes(spark.createDataFrame([*many, (2, many[3][1] + " y"), (0, many[9][1])], "doc_id long, text string")).collect()} == {(0, 0), (1, 0), (2, 0)}


@pytest.mark.parametrize("block", [16, 1024])
def test_hot_group_is_compared_in_blocks(spark, block):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(100)]
    docs = []
    for _ in range(120):
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
        docs.append(" ".join(w))
    sets = {i: grams(t) for i, t in enumerate(docs)}
    want = closure(sets, [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.id: r.component for r in neardup.classes(df, Rule(per=85, block_items=block, hot_members=20 if block == 16 else 1024)).collect()}
    assert got == want


def test_pipeline_links_from_080(spark):
    """A pair of similarity 0.82 is one document to the pipeline, and two to op3."""
    w = [f"b{i}" for i in range(104)]
    other = [*w[:30], "x", *w[31:70], "y", *w[71:]]
    a, b = grams(" ".join(w)), grams(" ".join(other))
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    df = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate((w, other))], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, "").collect()] == [0]
    assert neardup.deduplicated(df).count() == 2


def test_overlaps_equal_sets():
    rng = np.random.default_rng(0)
    for n, v, m in ((5, 20, 8), (70, 90, 60), (3, 10, 0)):
        sets = [np.unique(rng.integers(0, v, m)).astype(np.uint64) for _ in range(n)]
        got = near._overlaps(sets)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(i + 1, n))


def test_odd_sketch_estimates_high_similarity():
    rng, sketcher, errors = random.Random(0), Sketcher(24, 5), []
    for _ in range(60):
        w = [str(rng.random()) for _ in range(400)]
        other = w[:]
        other[rng.randrange(400)] = "x"
        samples = sketcher.samples(*shingles(*words([" ".join(w).encode(), " ".join(other).encode()], BLANK_BYTES), 5))
        odd = sketcher.odd(samples).view(np.uint64)
        differing = sum(int(a ^ b).bit_count() for a, b in zip(*odd.tolist(), strict=True))
        a, b = grams(" ".join(w)), grams(" ".join(other))
        errors.append(abs(sketcher.similarity(differing) - len(a & b) / len(a | b)))
        assert differing <= sketcher.most_bits(0.85)
    assert np.mean(errors) < 0.03


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed, monkeypatch):
    """By rounds alone, by one task alone, and by rounds until one task can finish."""
    rng = random.Random(seed)
    monkeypatch.setattr("folioscope.llm.components.TASK_LINKS", (0, 500_000, 60, 500_000)[seed])
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    nodes = {x for e in links if e[0] != e[1] for x in e}
    want = closure(nodes, [e for e in links if e[0] != e[1]])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Shelf(spark)).collect()}
    assert got == want


def prose(rng, n, stop):
    w = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]
    return " ".join(x + ("." if stop and i % stop == stop - 1 else "") for i, x in enumerate(w))


def substring_report(spark, rows):
    return {r.doc_id: tuple(r)[1:] for r in substrings.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_substrings(spark):
    """Edges, links and removals; what stands in no earlier document stays."""
    rng = random.Random(5)
    shared = [prose(rng, 60, 8) for _ in range(3)]
    rows = []
    for i in range(30):
        own = prose(rng, 90, 9)
        if i % 3 == 0:
            cut = own.index(". ") + 2
            own = own[:cut] + shared[i % 9 // 3] + rng.choice([" ", "\n"]) + own[cut:]
        rows.append((i, own))
    rows += [(100, None), (101, ""), (None, shared[0]), (102, "short line"), (103, "short line"), (104, prose(rng, 50, 0) + "\n" + "same " * 60)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, class_id string")
    got = {r.doc_id: r for r in substrings.report(df).collect()}
    hit = {i for i, r in got.items() if r.n_repeated}
    assert hit == {i for i in range(30) if i % 3 == 0}
    assert {i: got[i].class_id for i in hit} == {i: (i % 9) for i in hit}
    assert all((r.n_removed > 0) == (r.class_id != i) for i, r in got.items() if i in hit)
    assert got[None].class_id is None and got[100].class_id == 100
    clean = {r.doc_id: r.text for r in substrings.deduplicated(df).collect()}
    texts = dict(rows)
    assert all(clean[i] == texts[i] for i in texts if i not in hit or i < 9)
    assert all(len(clean[i].split()) == 90 for i in hit if i >= 9)
    assert substrings.report(df.limit(0)).count() == 0 and substrings.deduplicated(df.limit(0)).count() == 0


def test_substrings_keep_what_near_copies_have_of_their_own(spark):
    """A sentence that only the copies hold stays in the first of them."""
    rng = random.Random(9)
    line, own = prose(rng, 200, 10).split(), prose(rng, 12, 12).split()
    near_copy = " ".join([*line[:100], *own, *line[100:]])
    rows = [(1, " ".join(line)), (2, near_copy), (3, near_copy)]
    assert substring_report(spark, rows) == {1: (1, 1, 200, 0, 0), 2: (1, 1, 212, 2, 200), 3: (1, 1, 212, 1, 212)}
    left = {r.doc_id: r.text.split() for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[1] == line and [w.rstrip(".") for w in left[2] if w != "."] == [w.rstrip(".") for w in own]


@pytest.mark.parametrize("edit", [3, 10, 25, 40, 48])
def test_substrings_near_copies(spark, edit):
    """One changed word in 52: similarity 0.8 or more, wherever it stands; the words around it are taken out."""
    rng, rows = random.Random(edit), []
    for i in range(20):
        shared = prose(rng, 52, 0).split()
        other = [*shared[:edit], "changed", *shared[edit + 1 :]]
        rows += [(2 * i + k, f"{prose(rng, rng.randint(5, 60), 0)} {' '.join(w)} {prose(rng, rng.randint(5, 60), 0)}") for k, w in enumerate((shared, other))]
    got = substring_report(spark, rows)
    assert [i for i, _ in rows if not got[i][1] and 4 < edit < 47] == []
    assert all(got[i][0] == i // 2 * 2 for i in got if got[i][1])
    assert all(got[i][4] == (51 if 4 < edit else 48) * (i % 2) for i in got if got[i][1] and edit < 47)


@pytest.mark.parametrize("stop", [0, 5, 20])
def test_substrings_of_just_over_fifty_words(spark, stop):
    """At random places of different text, without stops, in short and in long sentences: each is found, shorter ones are none."""
    rng, rows = random.Random(stop), []
    for i in range(40):
        shared = prose(rng, 51 if i < 30 else 45, stop)
        rows += [(2 * i + k, f"{prose(rng, rng.randint(0, 90), stop)} {shared} {prose(rng, rng.randint(0, 90), stop)}") for k in range(2)]
    rows += [(100 + i, prose(rng, 150, stop)) for i in range(20)]
    got = substring_report(spark, rows)
    assert [i for i, _ in rows if got[i][1]] == list(range(60))
    assert all(got[i][0] == i // 2 * 2 and got[i][2] == 51 for i in range(60))


def stretches(rows, least):
    """Per document, its words in stretches of so many words that another document, or an earlier one, holds."""
    found = {}
    for d, t in rows:
        w = split_words((t or "").encode())
        for i in range(len(w) - least + 1):
            found.setdefault(tuple(w[i : i + least]), []).append((d, i))
    out = {d: (set(), set()) for d, _ in rows}
    for places in found.values():
        ids = {d for d, _ in places}
        for d, i in places:
            for k, hit in enumerate((len(ids) > 1, d > min(ids))):
                out[d][k].update(range(i, i + least) if hit else ())
    return {d: (len(a), len(b)) for d, (a, b) in out.items()}


@pytest.mark.parametrize("seed", range(2))
def test_substrings_equal_brute_force(spark, seed):
    """Stretches of one text, cut out anywhere, among text that repeats nowhere."""
    rng = random.Random(seed)
    source, rows = prose(rng, 400, 0).split(), []
    for i in range(60):
        a, n = rng.randrange(330), rng.randint(24, 70)
        rows.append((i, f"{prose(rng, rng.randint(1, 40), 0)} {' '.join(source[a : a + n])} {prose(rng, rng.randint(1, 40), 0)}"))
    got = substring_report(spark, rows)
    exact, sure, fragments = (stretches(rows, n) for n in (substrings.PASSAGE, substrings.PASSAGE + 2 * substrings.SHINGLE, substrings.SHINGLE))
    ends = 2 * substrings.SHINGLE  # where stretches of several documents overlap
    assert all(got[i][2] for i in got if sure[i][0])
    assert all(exact[i][0] - ends <= got[i][2] <= fragments[i][0] and exact[i][1] - ends <= got[i][4] <= fragments[i][1] for i in got if got[i][1])


def test_substrings_of_whole_table_equal_brute_force(spark):
    """Every document that shares 50 words in a row is reported, and nearly no other; removed words stand elsewhere."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in substrings.report(docs).collect()}
    exact, fragments = stretches(rows, substrings.PASSAGE), stretches(rows, substrings.K)
    assert all(got[i].n_repeated > 0 for i, (n, _) in exact.items() if n)
    assert all(fragments[i][0] >= r.repeated_words and fragments[i][1] >= r.removed_words for i, r in got.items())
    left = {r.doc_id: split_words((r.text or "").encode()) for r in substrings.deduplicated(docs).collect()}
    assert all(len(split_words((t or "").encode())) - len(left[i]) == got[i].removed_words for i, t in rows)
    kept = {tuple(w[i : i + 5]) for w in left.values() for i in range(len(w) - 4)}
    all_of = {tuple(w[i : i + 5]) for _, t in rows for w in [split_words((t or "").encode())] for i in range(len(w) - 4)}
    assert len(all_of - kept) <= 8 * sum(r.n_removed for r in got.values())  # only across the ends of cuts


def test_substrings_are_cut_whole(spark):
    """To the first and last word, short sentences inside; what only later documents share stays."""
    rng = random.Random(8)
    parts = [prose(rng, n, 6) for n in (30, 30, 30)]
    rows = [(i, f"{prose(rng, 40, 0)} {' '.join(parts[: 2 + (i > 1)])} {prose(rng, 40, 9)}") for i in range(4)]
    got = {i: (r[2], r[4]) for i, r in substring_report(spark, rows).items()}
    assert got == {0: (60, 0), 1: (60, 60), 2: (90, 60), 3: (90, 90)}
    left = {r.doc_id: len(r.text.split()) for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: n - left[i] for i, n in ((i, len(t.split())) for i, t in rows)} == {0: 0, 1: 59, 2: 59, 3: 89}  # a stop stays


def brute_top(rows, k):
    out = []
    whole = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
            out += [(q, p + 1, i, -s) for p, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 400)]  # ties
    rows += [(1000, None), (1001, [None] * 8), (1020, [float("nan")] * 8), (1040, [float("inf")] * 8), (None, rows[0][1]), (1060, [1.0, 2.0]), (1061, [3.0, 1.0]), (1080, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in topk.report(df, 20).collect())
    assert got == brute_top(rows, 20)
    base = topk.whole_numbers(df)
    small = topk.top_k(base, base.filter("id % 20 = 0"), 20, shard_rows=64, block_rows=8)
    assert sorted(tuple(r) for r in small.collect()) == got
    assert topk.report(df.limit(0)).count() == 0


def test_topk_prunes():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-3, 4, (512, 8)) + 200 * np.eye(8)[i] for i in range(8)]).astype(float)
    tree = topk.BallTree(points, 64)
    search = topk.Search(tree, np.arange(len(points)), points[:4], np.arange(4), 5, np.full(4, -np.inf))
    search.run()
    assert search.scored < 0.5 * 4 * len(points)


def test_topk_of_great_numbers(spark):
    points = np.array([[2**40, 1], [2**40, 2], [5, 5]], np.int64)
    got = list(topk._search(np.array([1, 2, 3]), points, np.array([3]), np.array([[2**20, 1]]), np.full(1, -np.inf), 2))
    assert got == [(3, [(2, 2**60 + 2), (1, 2**60 + 1)])]
    rows = [(20, [1e12, 1e12]), (21, [1e12, 1e12]), (22, [-1e12, -1e12]), (23, [1.0, 2.0]), (24, [1e300, -1e300]), (40, [3.0, 1.0])]
    got = sorted(tuple(r) for r in topk.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = {i: [clip(int(np.floor(64 * x))) if abs(x) < 1e17 else clip(int(x)) for x in v] for i, v in rows}
    want = []
    for q in (20, 40):
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], w, strict=True))), i) for i, w in whole.items() if i != q)
        want += [(q, p + 1, i, -s) for p, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_topk_of_repeated_rows(spark):
    """Repeated rows are spread over the shards, and later waves start from the k-th score of earlier ones."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(60)] + [(7, [1.0, 2.0, 3.0, 4.0])] * 200
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    base = topk.whole_numbers(df)
    got = topk.top_k(base, base.filter("id % 20 = 0"), 20, shard_rows=16, block_rows=2)
    assert sorted(tuple(r) for r in got.collect()) == brute_top([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 20)
