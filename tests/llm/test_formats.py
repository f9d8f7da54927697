"""Chat formatting, packing, the pipeline: round trips and invariants."""

import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import chat, packing

HARD = ["", "<", "<|", "<\\|", "\\<|", "<\\\\|x|>", "<|im_end|>\n<|im_start|>", "a\n<|im_sep|>b", "$1 \\1", "é<|é", "|>", "<" + "\\" * 5 + "|"]


def test_escape_round_trip(spark):
    rng = random.Random(0)
    texts = HARD + ["".join(rng.choice("<\\|a>\n") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.t and "<|" not in r.e


def test_report_reads_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "od<|d"]), rng.choice([*HARD, None])) for c in [1, 2, 3, None] for t in range(rng.randint(1, 20))]
    rows += [(7, None, "user", "x"), (7, 1, "assistant", "same"), (7, 1, "assistant", "same"), (8, 0, "user", "y" * 100000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    want = defaultdict(list)
    for c, t, role, text in rows + [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]:
        want[c].append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    got = {r.conv_id: r for r in chat.report(spark, df).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns = [(x[3], x[5]) for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.report(spark, df.limit(0)).count() == 1


def test_trees(spark):
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 3, 1.0), ("t", 5, 99, 9.0), ("u", 1, 2, 0.0), ("u", 2, 1, 0.0), ("u", 3, 2, 0.0), ("v", 1, None, None)]
    rows += [("w", i, i - 1 if i else None, 1.0) for i in range(40)]
    nodes = spark.createDataFrame([(t, n, p, s, "user", f"m{n}") for t, n, p, s in rows], "tree string, node long, parent long, score double, role string, text string")
    found = defaultdict(list)
    for r in chat.paths(nodes).collect():
        found[r.tree, r.leaf].append((-r.up, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == {("t", 2): [1, 2], ("t", 4): [1, 3, 4], ("t", 5): [5], ("v", 1): [1], ("w", 39): list(range(40))}
    best = chat.formatted(nodes, branches=1)
    assert {(r.tree, r.leaf) for r in best.collect()} == {("t", 5), ("v", 1), ("w", 39)}
    assert chat.read_back(best.filter("tree = 'v'")).first().turns[0].text == "m1"


def test_report_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.report(spark, df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def test_encoder_equals_tokenizer(tokenizer):
    rng = random.Random(2)
    bits = [" ", " ", "  ", "\n", "\t", "a", "B", "é", "1", "'s", "!", " ", "　", "\x1c", "\x85", "\0", "ab", ".", ",", "<|endoftext|>", "the"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    encoder = packing.Encoder(packing.default_tokenizer(), 300)
    for lo in range(0, len(texts), 500):
        got = encoder.encode(texts[lo : lo + 500])
        assert got == [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts[lo : lo + 500]]
    assert encoder.encode([]) == []
    assert array("I", encoder.encode(["a <|endoftext|> b"])[0]).tolist() == [64, 220, 50256, 275]
    plain = Tokenizer.from_file(packing.default_tokenizer())
    plain.encode_special_tokens = True
    as_text = packing.Encoder(packing.default_tokenizer(), special=False)
    assert as_text.encode(["a <|endoftext|> b"]) == [array("I", plain.encode("a <|endoftext|> b", add_special_tokens=False).ids).tobytes()]


@pytest.mark.parametrize("max_open", [3, 8192])
def test_packer(max_open):
    rng, packer, docs = random.Random(3), packing.Packer(64, max_open), {}
    for i in range(600):
        docs[i] = array("I", [rng.randrange(1000) for _ in range(rng.choice([0, 1, 5, 40, 63, 64, 65, 300]))]).tobytes()
        packer.add(i, docs[i])
    packer.join(last=True)
    seen, fill = defaultdict(list), defaultdict(list)
    for d, start, ids, total, k, offset in packer.rows:
        assert total == len(docs[d]) // 4 and ids
        seen[d].append((start, ids))
        fill[k].append((offset, len(ids) // 4))
    assert all(b"".join(x for _, x in sorted(seen[d])) == docs[d] for d in docs)
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0


def test_sum_of_squares_placement():
    rng, levels = random.Random(4), packing.Levels(16)
    for _ in range(800):
        s = rng.randint(1, 15)
        n = levels.count.copy()

        def cost(h, n=n, s=s):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + s < 16:
                m[h + s] += 1
            return int((m[1:16] ** 2).sum())

        options = [h for h in range(16 - s + 1) if h == 0 or n[h]]
        h = levels.place(s)
        assert cost(h) == min(cost(x) for x in options)
        assert h == max(x for x in options if cost(x) == cost(h)) or h + s == 16
        if h:
            levels.count[h] -= 1
        if h + s < 16:
            levels.count[h + s] += 1


def test_packed_frames(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (3, "again"), (3, "again"), (None, "x"), (4, "cut <|endoftext|>here"), (5, "<|endoftext|>" * 1500), *((i, f"text number {i} " * (i % 9)) for i in range(10, 60))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, offset int")
    got = packing.packed(df, with_ids=True).collect()
    lengths = sorted((r[0] or -1, len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    per = defaultdict(int)
    texts = {d: array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows if d != 3}
    for r in got:
        assert len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids)
        assert r.doc_id == 3 or r.ids == texts[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(texts[r.doc_id])
        per[r.doc_id or -1] += r.length
    want = defaultdict(int)
    for d, n in lengths:
        want[d] += n
    assert per == want
    assert packing.packed(df.limit(0)).count() == 0
    full = packing.windows(df).collect()
    assert sum(len(r.ids) for r in full) == 4 * sum(want.values()) and all(len(r.ids) <= 4096 for r in full)


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "secrets", "packing"]
    extra = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, "123 !", "en", "s", 5), (900004, "the password = abcdef99 of this and that was with", "en", "s", 40)], docs.schema)
    now, seen = docs.unionByName(extra), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now)
    assert all(set(x.columns) == set(docs.columns) for x in seen[:-1])
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert not ids[0] & {900001, 900002, 900003} and 900004 in ids[0] and len(ids[0]) >= docs.count()
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] == ids[4]
    assert "abcdef99" not in seen[3].filter("doc_id = 900004").first().text
    assert seen[3].filter("n_chars <> char_length(text)").count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 0
