"""Analysis: folding, tokens, the stemmers."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import analysis


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("sky", "sky"), ("controll", "control"), ("adjustment", "adjust"), ("sharpened", "sharpen")],
)
def test_porter(word, stem):
    assert analysis.porter(word) == stem


def test_tokens_and_folding(spark):
    row = spark.createDataFrame([("Zımpara kâğıdı, don't re-use  x",)], "t string").select(
        analysis.words("t").alias("w"), analysis.ascii_words("t").alias("a"), analysis.fold("t").alias("f"), analysis.simple_terms("t").alias("s"), analysis.unmark(F.lit("Café naïve ı é")).alias("u")
    ).first()
    assert row.w == ["Zımpara", "kâğıdı", "don't", "re-use", "x"]
    assert row.a[0] == "Z" and "don't" in row.a
    assert row.f.startswith("zimpara kagidi")
    assert row.s == ["zımpara", "kâğıdı", "don", "t", "re", "use", "x"]
    assert row.u == "Cafe naive ı e"


def test_python_terms_agree_with_columns(spark):
    texts = ["Café-crème 12", "", "ÄÖ ß x_y", "naïve sharpening"]
    for analyser, (terms, stems) in analysis.ANALYSERS.items():
        rows = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(terms(F.col("x")).alias("t")).collect()]
        if stems:
            rows = [[analysis.porter(w) for w in r] for r in rows]
        assert rows == [analysis.python_terms(t, analyser) for t in texts]


def test_light_stems_collapse_inflections(spark):
    df = spark.createDataFrame([("sharpening",), ("sharpen",), ("boards",), ("board",), ("benches",), ("glass",)], "w string")
    got = {r.w: r.s for r in df.select("w", analysis.light_stem(F.col("w")).alias("s")).collect()}
    assert got == {"sharpening": "sharpen", "sharpen": "sharpen", "boards": "board", "board": "board", "benches": "bench", "glass": "glass"}
