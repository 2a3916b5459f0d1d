"""NFD in native expressions against the standard library."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import text as TX

SURROGATES = range(0xD800, 0xE000)


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(8)
    got = {r.i: r.n for r in df.select("i", TX.nfd(F.col("s")).alias("n")).collect()}
    bad = [(t, got[i]) for i, t in enumerate(texts) if got[i] != (None if t is None else unicodedata.normalize("NFD", t))]
    assert not bad, [(ascii(a), ascii(b)) for a, b in bad[:5]]


def test_all_code_points(spark):
    points = [chr(c) for c in range(sys.maxunicode + 1) if c not in SURROGATES and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    assert len(points) > 140_000
    check(spark, ["".join(points[i:i + 200]) for i in range(0, len(points), 200)])
    check(spark, [f"a{c}b" for c in TX.decompositions()[0]] + [f"x{c}\u0327y" for c in "".join(TX.combining()[:1])])


def test_random_marks_and_texts(spark):
    r = random.Random(3)
    marks, found = TX.combining()[0], TX.decompositions()[0]
    hangul = [chr(c) for c in range(0xAC00, 0xD7A4, 97)]
    pools = [marks, marks, found, "abc \n", hangul, "\ue001\ue0e6\U0001F600"]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(1, 40))) for _ in range(4000)]
    check(spark, [*texts, "", None, "plain", "é" * 5000, "\u0301" * 50 + "\u0327" * 50])


def test_the_plan_has_no_python(spark, small_dir):
    from tessera.plans import QUERIES
    plan = QUERIES["normalize_nfd"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for r in TX.normalize(spark.read.parquet(f"{small_dir}/documents.parquet"), "text").collect():
        assert r.normalized == unicodedata.normalize("NFD", docs[r.doc_id].lower())
