"""Language, quality and toxicity models and the pipeline: held-out accuracy and brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as E
import corpus_pipeline
from tessera.llm import langid, nbsvm, poisson_mix, queries, simhash, toxicity_cnn
from tessera.llm.sample import labelled_sample

BIG = "/root/testdata/sf0.01"


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# ---- operator 4

def texts(lang, n, seed):
    words = {"en": "the cat sat with this and that thing over there".split(),
             "fr": "le chat était avec cette chose et ça être là".split(),
             "ru": "кошка сидела на окне и смотрела вдаль".split()}[lang]
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randrange(5, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def small_model(spark):
    rows = [(i, t, lang) for lang in ("en", "fr", "ru") for i, t in enumerate(texts(lang, 40, lang))]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_viterbi_is_the_best_of_all_paths(small_model):
    r = random.Random(6)
    m = langid.Model(["a", "b", "c"], np.zeros((langid.BUCKETS + 1, 3), np.float32), np.ones((len(langid.NAMES), 3), bool))
    for _ in range(200):
        n = r.randrange(1, 7)
        m.scores = np.array([[r.uniform(-30, 0) for _ in range(3)] for _ in range(n)])
        got = m.path(np.arange(n))
        value = lambda p: sum(m.scores[i, k] for i, k in enumerate(p)) - langid.PENALTY * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in itertools.product(range(3), repeat=n))
        assert value(got) == pytest.approx(best)


def test_spans_of_a_mixed_text(small_model):
    en, fr, ru = texts("en", 1, 1)[0], texts("fr", 1, 2)[0], texts("ru", 1, 3)[0]
    text = f"{en}. {fr}! 12 {ru}"
    assert [(text[s["start"]:s["end"]], s["lang"]) for s in small_model.spans(text)] == [(en, "en"), (fr, "fr"), (ru, "ru")]
    assert small_model.predict([text, None, "", "12 !!! ²", "кошка"])[0][1:] == ["und", "und", "und", "ru"]


def test_script_rules_languages_out(small_model):
    s = small_model.score(["вдаль", "there", "日本"])
    assert s[0].argmax() == small_model.languages.index("ru") and s[0, 2] - s[0, 0] > 50
    assert (s[2] == 0).all()


def test_ngrams_against_slices():
    words = ["ab", "abc", "é"]
    rows, starts = langid.ngrams(words)
    same = lambda w, i, v, j, n: (rows[starts[words.index(w)] + i, n] == rows[starts[words.index(v)] + j, n])
    assert same("ab", 0, "abc", 0, 2) and same("ab", 1, "abc", 1, 1) and not same("ab", 1, "abc", 2, 0)
    marked = [f"\x02{w}\x03" for w in words]
    assert [(rows[s:s + len(m)] >= 0).sum() for s, m in zip(starts, marked)] == [
        sum(max(0, len(m) - n + 1) for n in langid.ORDERS) for m in marked]


def test_op4_held_out_accuracy(spark):
    got = queries.QUERIES["op4_language_id"](spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet"), "doc_id").collect()
    assert len(got) == 1000 and all(g.held_out == is_held_out(g.doc_id) and 0 <= g.score <= 1 for g in got)
    held = [g for g in got if g.held_out]
    assert np.mean([g.lang_pred == g.lang for g in held]) > 0.97


def test_langid_edges(spark, edge, none):
    model = langid.fit(edge)
    rows = langid.predict(edge, model).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert langid.predict(none, model).count() == 0 and langid.spans(edge, model).count() == edge.count()
    untaught = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(edge, untaught).collect()} == {"und"}


# ---- operators 3 and 6

@pytest.mark.parametrize("op,label,least", [("op6_nbsvm_quality", "quality", 0.8), ("op3_toxicity_cnn", "toxic", 0.75)])
def test_held_out_accuracy(spark, op, label, least):
    got = queries.QUERIES[op](spark, BIG).collect()
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    cut = 0.3 if label == "quality" else 0.5
    assert len(got) == 1000
    assert all(g.held_out == is_held_out(g.doc_id) and 0 <= g.score <= 1 and g.predicted == (g.score >= cut) for g in got)
    held = [g for g in got if g.held_out and g.doc_id in marks]
    hit = lambda c: np.mean([g.predicted == c for g in held if marks[g.doc_id] == c])
    assert (hit(0) + hit(1)) / 2 > least


def test_labels_of_held_out_rows_and_other_columns_are_not_read(spark, small_dir, documents, labels):
    docs = documents.withColumn("held_out", queries.held_out())
    seen = docs.where("NOT held_out").select("doc_id", "text")
    turned = labels.join(docs.select("doc_id", "held_out"), "doc_id") \
        .select("doc_id", F.when(F.col("held_out"), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    a, b = nbsvm.fit(seen, labels), nbsvm.fit(seen, turned)
    assert (a.weight == b.weight).all() and (a.a, a.b) == (b.a, b.b)


def test_sample_is_bounded_weighted_and_repeatable(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(3000)] + [(5, 1), (7, None), (8, 3), (None, 1)],
                                   "doc_id long, y int")
    got = labelled_sample(docs, labels, "y", 100, "s").collect()
    assert 50 < sum(r.label == 0 for r in got) < 150 and 50 < sum(r.label == 1 for r in got) < 150
    assert {r.label for r in got if r.id == 5} <= {1}
    assert sorted(got) == sorted(labelled_sample(docs, labels, "y", 100, "s").collect())
    total = sum(r.weight for r in got)
    assert 2400 < total < 3600


def test_hinge_fit_reaches_the_best_margin():
    """Against a long run of plain subgradient steps on the same objective."""
    r = np.random.default_rng(1)
    x = r.standard_normal((60, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) + 0.3 * r.standard_normal(60) > 0, 1.0, -1.0)
    cost = np.full(60, 0.7)
    rows, cols = [np.arange(5)] * 60, list(x)
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w = nbsvm.hinge_fit(rows, cols, y, cost, 5, epochs=500)
    v, best = np.zeros(5), np.inf
    for t in range(1, 20001):
        v -= (v - ((cost * y * (y * (x @ v) < 1)) @ x)) / t
        best = min(best, loss(v))
    assert loss(w) <= best * 1.0005


def test_grams_are_a_set_of_the_text():
    g = nbsvm.Grams()
    a = g.of("one two one two one")
    assert len(a) == len(set(a.tolist()))
    assert set(a.tolist()) & set(g.of("two one").tolist()) and not set(a.tolist()) & set(g.of("Zz9.").tolist())
    assert len(g.of("")) == len(g.of(None)) == 0
    assert sorted(nbsvm.Grams().of("one two one two one")) == sorted(a)
    assert [nbsvm.shape(t) for t in ("Hello,", "NO!!!!!", "a1b22", "ß")] == ["Xx,", "X!!!", "x9x9", "x"]


def test_tokens_are_renumbered_as_in_training():
    model = toxicity_cnn.Model.random(*[np.array([0, *sorted({toxicity_cnn.token_number(t) >> by & mask for t in ("the", "cat")})])
                                        for by, mask in ((0, toxicity_cnn._WORD), (toxicity_cnn.WORD_BITS, toxicity_cnn._STEM))])
    text = "The cat, the DOG! catalogue 12"
    assert (model.tokens().of(text) == model.renumber(toxicity_cnn.Tokens().of(text))).all()
    assert toxicity_cnn.Tokens().of(None).tolist() == [0]


def test_pooling_against_windows_one_by_one():
    r = np.random.default_rng(0)
    words, stems = np.arange(30), np.arange(20)
    m = toxicity_cnn.Model.random(words, stems, 3)
    docs = [np.array([(r.integers(30)) | int(r.integers(20)) << toxicity_cnn.WORD_BITS for _ in range(n)]) for n in (1, 2, 5, 17)]
    got, where, *_ = m.pool(docs, places=True)
    start = 0
    for t, doc in enumerate(docs):
        x = np.vstack([m.word[doc & toxicity_cnn._WORD] + m.stem[doc >> toxicity_cnn.WORD_BITS & toxicity_cnn._STEM],
                       np.zeros((2, toxicity_cnn.DIM))])
        want = np.concatenate([np.max([sum(x[i + k] @ f[k] for k in range(len(f))) for i in range(len(doc))], axis=0)
                               for f in m.filters]) + m.bias
        assert np.allclose(got[t], np.where(want > 0, want, toxicity_cnn.LEAK * want), atol=1e-5)
        assert (where[t] >= start).all() and (where[t] < start + len(doc)).all()
        start += len(doc) + 2


@pytest.mark.parametrize("module,label", [(nbsvm, "quality"), (toxicity_cnn, "toxic")])
def test_classifier_edges(spark, edge, none, monkeypatch, module, label):
    monkeypatch.setattr(toxicity_cnn, "STEPS", 30)
    marks = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (5, None), (6, 0), (7, 1), (8, 0), (None, 1)], f"doc_id long, {label} int")
    model = module.fit(edge, marks)
    rows = module.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert module.score(none, model).count() == 0
    kept = module.reject(edge, model, 0.5)
    assert kept.columns == edge.columns
    one_class = module.fit(edge, marks.where(f"{label} = 1"))
    assert {r.score > 0.99 for r in module.score(edge, one_class).collect()} == {True}
    untaught = module.fit(none, marks.limit(0))
    assert {round(r.score) for r in module.score(edge, untaught).collect()} == {1 if label == "quality" else 0}


# ---- pipeline

def test_stages_apply_their_operators(spark, small_dir, documents, labels, monkeypatch):
    monkeypatch.setattr(toxicity_cnn, "STEPS", 200)
    docs = documents
    seen = docs.where(~queries.held_out())
    model = nbsvm.fit(seen, labels)
    scores = {r.doc_id: r.score for r in nbsvm.score(docs, model).collect()}
    kept = corpus_pipeline.quality(spark, docs, small_dir)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.3}

    clean = corpus_pipeline.toxicity(spark, kept, small_dir)
    model = toxicity_cnn.fit(kept.where(~queries.held_out()), labels)
    scores = {r.doc_id: r.score for r in toxicity_cnn.score(kept, model).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5} and clean.schema == docs.schema

    single = corpus_pipeline.near_duplicates(spark, clean, small_dir)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({g.component for g in simhash.groups(clean).collect()})

    mixed = corpus_pipeline.mixture(spark, single, small_dir)
    want = {r.doc_id: r["count"] for r in poisson_mix.copies(single).groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    coded = corpus_pipeline.encode(spark, mixed, small_dir)
    assert coded.count() == sum(want.values()) and all(r.n_tokens == len(r.ids) for r in coded.collect())


def test_pipeline_is_registered_and_runs(spark, small_dir, monkeypatch):
    monkeypatch.setattr(toxicity_cnn, "STEPS", 200)
    assert E.queries()["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixture", "encode"]
    assert corpus_pipeline.run(spark, small_dir).count() > 0


def test_stages_take_odd_rows(spark, edge, none, small_dir, monkeypatch):
    monkeypatch.setattr(toxicity_cnn, "STEPS", 30)
    for rows in (edge, none):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small_dir)
            if name != "encode":
                assert out.columns == [c for c in docs.columns] or name == "mixture" and set(out.columns) <= set(docs.columns)
                docs = out
            assert out.count() >= 0
        assert isinstance(out.schema["ids"].dataType, T.ArrayType)


def test_every_operator_has_one_query():
    names = sorted(k for k in E.queries() if k.startswith("op") and k[2].isdigit())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_quality_reads_tokens_past_64_characters():
    start, plain, marked = "日本語の文章です。" * 9, "続きの文です。" * 12, "!?12!?Ab" * 12
    of = lambda text: set(nbsvm.Grams().of(text).tolist())
    ends = of(marked[:nbsvm.PIECE])
    assert nbsvm.shape("a" * 64 + "9!") == "x9!"
    for text in (start + marked, start[:nbsvm.PIECE] + marked):
        assert len(of(text) - of(text[:nbsvm.PIECE] + plain)) > 2
    assert len(of(start[:nbsvm.PIECE] + marked) & ends) >= 2


def test_viterbi_pays_one_penalty_for_two_gains():
    m = langid.Model(["a", "b", "c"], np.zeros((langid.BUCKETS + 1, 3), np.float32), np.ones((len(langid.NAMES), 3), bool))
    m.scores = np.array([[0.0, -28.0, -13.0], [-28.0, 0.0, -13.0]])
    assert m.path(np.arange(2)).tolist() == [0, 1]


def test_fitting_samples_are_as_documented():
    import pathlib
    readme = (pathlib.Path(__file__).parents[2] / "README.md").read_text()
    assert f"at most about {toxicity_cnn.PER_CLASS:,} and {nbsvm.PER_CLASS:,} labelled texts of each class" in readme


def test_toxicity_training_step_by_finite_differences(monkeypatch):
    monkeypatch.setattr(toxicity_cnn, "LEAK", np.float32(0.1))
    r = np.random.default_rng(8)
    words, stems = np.arange(12), np.arange(7)
    m = toxicity_cnn.Model.random(words, stems, 2)
    for name in ("word", "stem", "bias", "out"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    m.filters = [f.astype(np.float64) for f in m.filters]
    texts = [r.integers(1, 12, n) | r.integers(1, 7, n) << toxicity_cnn.WORD_BITS for n in (1, 4, 9)]
    label, weight = np.array([1, 0, 1]), np.array([0.7, 1.3, 1.0])

    def loss():
        z = (m.pool(texts) * m.out[:-1]).sum(axis=1) + m.out[-1]
        return float((weight * np.logaddexp(0, np.where(label == 1, -z, z))).mean())

    grads, vectors = toxicity_cnn.gradients(m, texts, label, weight)
    dense = [(p, g) for p, g in zip([*m.filters, m.bias, m.out], grads)]
    for table, (rows, g) in zip((m.word, m.stem), vectors):
        full = np.zeros_like(table)
        full[rows] = g
        dense.append((table, full))
    for p, g in dense:
        flat, got = p.reshape(-1), np.asarray(g).reshape(-1)
        for i in r.choice(len(flat), min(25, len(flat)), replace=False):
            if p is m.word and i < toxicity_cnn.DIM or p is m.stem and i < toxicity_cnn.DIM:
                continue                                       # row 0 is blank and stays zero
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-5 == pytest.approx(got[i], rel=2e-2, abs=2e-4)


def test_best_cut_against_all_cuts():
    r = np.random.default_rng(9)
    for _ in range(200):
        n = int(r.integers(2, 30))
        z, y, w = r.integers(0, 12, n).astype(float), r.integers(0, 2, n), r.integers(1, 4, n).astype(float)
        if len(set(y.tolist())) < 2 or len(set(z.tolist())) < 2:
            continue
        f1 = lambda c: 2 * (w * y)[z > c].sum() / ((w * y).sum() + w[z > c].sum())  # noqa: B023,E731
        values = np.unique(z)
        cuts = (values[1:] + values[:-1]) / 2
        best = max(f1(c) for c in cuts)
        cut = toxicity_cnn.best_cut(z, y, w)
        assert f1(cut) == pytest.approx(best)
        gap = {c: b - a for a, b, c in zip(values, values[1:], cuts)}
        assert gap[min(cuts, key=lambda c: abs(c - cut))] == max(g for c, g in gap.items() if f1(c) == pytest.approx(best))


def test_words_that_tell_a_language_are_learned(monkeypatch):
    monkeypatch.setattr(toxicity_cnn, "MIN_LANGUAGE", 5)
    r = np.random.default_rng(10)
    own = {"xx": ["ba", "be", "bi"], "yy": ["ka", "ke", "ba"], "zz": ["lo"]}
    made = lambda lang: " ".join([*own[lang], *[f"w{r.integers(1000)}" for _ in range(5)]])
    langs = ["xx"] * 20 + ["yy"] * 10 + ["zz"] * 2 + [None] * 3
    texts = [toxicity_cnn.Tokens().of(made(lang or "zz")) for lang in langs]
    names, marks, bits = toxicity_cnn.learn_marks(texts, langs)
    assert names == ["xx", "yy"]
    number = {w: toxicity_cnn.token_number(w) & toxicity_cnn._WORD for w in ("be", "bi", "ka", "ke", "ba")}
    assert dict(zip(marks.tolist(), bits.tolist())) == {number["be"]: 1, number["bi"]: 1, number["ka"]: 2, number["ke"]: 2}
    m = toxicity_cnn.Model.random(np.array([0]), np.array([0]))
    m.languages, m.marks, m.bits = names, marks, bits
    told = [toxicity_cnn.language(m.renumber(toxicity_cnn.Tokens().of(t)), 2) for t in ("be x", "ka ke be", "ba", "")]
    assert told == [0, 1, -1, -1]
    assert (m.tokens().of("be ka q ba") == m.renumber(toxicity_cnn.Tokens().of("be ka q ba"))).all()


def test_a_column_of_many_values_is_no_language(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        langid.fit(df)
