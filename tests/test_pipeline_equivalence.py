"""The fast paths agree with their definitions, and the native paths stay native."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import perturb as X
from tessera.operators import scoring as SC
from tessera.plans import q_labels as QL
from tessera.plans import q_scoring as QS


def test_scan_fast_path_equals_rebuilt_strings(spark, small_dir):
    m = QS.model(spark, small_dir)
    s = QL.seq(spark, small_dir)
    fast = X.mean_delta(s, m, "delta").collect()
    slow = X.mean_delta(s, m, "rebuild").collect()
    key = lambda r: (r["chain"], r["grp"], r["prob"], r["aa"], r["position"])
    a = {key(r): r["mean_delta"] for r in fast}
    b = {key(r): r["mean_delta"] for r in slow}
    assert a.keys() == b.keys()
    assert max(abs(a[k] - b[k]) for k in a) <= 1e-6


def test_identity_substitution_has_zero_delta(spark, small_dir):
    """Putting each position's own symbol back leaves every probability unchanged, and
    a real substitution moves the logit by exactly w(new) - w(old)."""
    from tessera.functions.exprs import replace_at
    m = QS.model(spark, small_dir)
    s = QL.seq(spark, small_dir).limit(200)
    e = X.substitution_expand(s, m.symbols, "a", keep=["chain_b"])
    ident = e.withColumn("same", replace_at(F.col("modified"), F.col("idx"), F.col("orig")))
    rows = ident.select(
        *[(m.logit(F.col("same"), F.col("chain_b"), lb)
           - m.logit(F.col("modified"), F.col("chain_b"), lb)).alias(f"d_{lb}") for lb in m.labels],
        "aa", "orig").collect()
    w = m.weights["a"]
    for r in rows:
        for lb in m.labels:
            # 'same' is the original chain; 'modified' has aa at idx
            want = w[lb].get(r["orig"], 0.0) - w[lb].get(r["aa"], 0.0)
            assert abs(r[f"d_{lb}"] - want) < 1e-9


def test_user_model_path_equals_native(spark, small_dir):
    m = QS.model(spark, small_dir)
    test = QL.split_seq(spark, small_dir).where(F.col("split") == "test")
    native = {r["seq_id"]: r["prob"] for r in SC.score_log_odds(test, m).select("seq_id", "prob").collect()}
    user = {r["seq_id"]: r["prob"] for r in SC.score_with_model(test, SC.numpy_log_odds(m)).collect()}
    assert native.keys() == user.keys()
    for k in native:
        assert all(abs(a - b) < 1e-9 for a, b in zip(native[k], user[k]))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_paths_have_no_python_and_no_single_partition(spark, small_dir):
    m = QS.model(spark, small_dir)
    s = QL.seq(spark, small_dir)
    for df in (X.mean_delta(s, m), SC.score_log_odds(s, m)):
        p = _plan(df)
        assert "Python" not in p and "ArrowEval" not in p
        assert "SinglePartition" not in p


def test_scan_aggregates_before_the_shuffle(spark, small_dir):
    m = QS.model(spark, small_dir)
    df = X.mean_delta(QL.seq(spark, small_dir), m)
    df.write.format("noop").mode("overwrite").save()
    p = _plan(df)
    # partial aggregate below the exchange, final above it
    assert p.count("HashAggregate") >= 2


def test_pca_matches_centred_svd_with_fixed_signs(spark, small_dir):
    import numpy as np

    from tessera.operators import reps as RP
    from tessera.sources import tables as T
    v = T.vectors(spark, small_dir)
    got = {r["vec_id"]: [r["pc1"], r["pc2"], r["pc3"]] for r in RP.pca_project(v, "vec", 3).collect()}
    rows = sorted(v.select("vec_id", "vec").collect())
    X = np.array([r["vec"] for r in rows])
    Xc = X - X.mean(axis=0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    comps = vt[:3]
    for c in range(3):
        if comps[c][np.abs(comps[c]).argmax()] < 0:
            comps[c] = -comps[c]
    want = Xc @ comps.T
    for (vid, _), w in zip(rows, want):
        assert np.allclose(got[vid], w, atol=1e-6)


def test_logistic_fits_learn_the_language_label(spark, small_dir):
    from tessera.operators import fit as FT
    from tessera.operators import metrics as M
    split = QL.labelled_split(spark, small_dir)
    out = FT.logreg_multilabel(split)
    assert out.count() == 3 * split.count()
    test = out.where("split = 'test'")
    auc = {r["label"]: r["auc"] for r in M.roc_auc(test).collect()}
    assert auc["X"] > 0.7      # non-English words are easy to tell from their letters
    # the engine's AUC is exact: the share of (positive, negative) pairs in the right order
    rows = test.where("label = 'X'").select("prob", "target").collect()
    pos, neg = np.sort([r.prob for r in rows if r.target]), np.sort([r.prob for r in rows if not r.target])
    below = np.searchsorted(neg, pos, "left").sum() + np.searchsorted(neg, pos, "right").sum()
    assert auc["X"] == round(below / 2 / len(pos) / len(neg), 6)


def test_multiclass_fit_beats_the_largest_class_by_its_labels(spark, small_dir):
    from collections import Counter
    from tessera.operators import fit as FT
    rows = [r for r in FT.logreg_multiclass(QL.labelled_split(spark, small_dir)).collect() if r.split == "test"]
    assert {r.predicted for r in rows} <= {r.tags for r in rows} | {None} | set("QTX")| {"negative", "Q|X", "Q|T", "T|X", "Q|T|X"}
    largest = Counter(r.tags for r in rows).most_common(1)[0][1]
    assert sum(r.predicted == r.tags for r in rows) >= largest


def test_grid_scores_the_same_rows_with_every_parameter(spark, small_dir):
    from tessera.operators import fit as FT
    train = QL.labelled_split(spark, small_dir).where("split = 'train'")
    out = FT.param_grid(train).groupBy("regParam", "elasticNetParam").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("seq_id").cast("decimal(20,0)")).alias("ids")).collect()
    n = train.count()
    assert len(out) == 4 and len({(r.n, r.ids) for r in out}) == 1
    assert out[0].n == n - int(np.ceil(0.7 * n))
    again = FT.param_grid(train.repartition(13)).agg(F.sum(F.xxhash64("seq_id").cast("decimal(20,0)")).alias("ids")).first()
    assert again.ids == 4 * out[0].ids


def test_dense_classifier_predicts_every_vector(spark, small_dir):
    from tessera.plans import q_reps as QR
    rows = QR.mlp_classify(spark, small_dir).collect()
    assert len(rows) == spark.read.parquet(f"{small_dir}/embeddings.parquet").count()
    assert {r.prediction for r in rows} <= set(range(10))
    assert {r.split for r in rows} == {"train", "test"}


def test_pca_centroids_are_means_of_the_projection(spark, small_dir):
    from tessera.plans import q_reps as QR
    points = QR.pca_project(spark, small_dir).collect()
    for c in QR.pca_centroids(spark, small_dir).collect():
        own = np.array([[p.pc1, p.pc2, p.pc3] for p in points if p.label == c.label])
        assert np.allclose([c.c1, c.c2, c.c3], own.mean(axis=0), atol=2e-6)


def test_counts_follow_an_append(spark, small_dir, tmp_path):
    """A changed source is read anew: nothing depends on what ran before."""
    import shutil
    from tessera.plans import q_text as QT
    for t in ("documents", "labels"):
        (tmp_path / f"{t}.parquet").mkdir()
        shutil.copy(f"{small_dir}/{t}.parquet", tmp_path / f"{t}.parquet" / "part-0.parquet")
    at = str(tmp_path)
    first = QL.row_count(spark, at).first().n
    train = QL.split_seq(spark, at).where("split = 'train'").count()
    weights = QS.model(spark, at).prior["Q"]
    for t in ("documents", "labels"):
        more = spark.read.parquet(f"{small_dir}/{t}.parquet").withColumn("doc_id", F.col("doc_id") + 10_000)
        if t == "labels":
            more = more.withColumn("quality", F.lit(1))
        more.write.mode("append").parquet(f"{at}/{t}.parquet")
    spark.catalog.refreshByPath(at)
    assert QL.row_count(spark, at).first().n == 2 * first
    assert QL.split_seq(spark, at).where("split = 'train'").count() == int(np.ceil(0.7 * 2 * first)) != train
    assert QS.model(spark, at).prior["Q"] > weights
    assert QT.train_words(spark, at).agg(F.sum("n")).first()[0] > 0


def test_streaming_leaves_the_file_schema_alone(spark, small_dir):
    from tessera.plans import q_io as QI
    QI.stream_score(spark, small_dir).count()
    assert QI.scan_sequences(spark, small_dir).columns == ["seq_id", "chain_a", "chain_b", "tags"]


def test_no_letter_of_a_text_is_lost(spark, small_dir):
    s = QL.seq(spark, small_dir).agg(F.sum(F.length("chain_a") + F.length("chain_b")).alias("n")).first().n
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    raw = docs.agg(F.sum(F.length(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}]", ""))).alias("n")).first().n
    assert s == raw
    with_words = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert QL.seq(spark, small_dir).select("doc_id").distinct().count() == with_words


def test_too_long_a_text_raises_instead_of_colliding(spark, tmp_path, monkeypatch):
    import pytest
    from tessera.sources import tables as T
    monkeypatch.setattr(T, "PAIR_KEY_STRIDE", 3)
    spark.createDataFrame([(1, "a b c d e f g h", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.raises(Exception, match="too many words"):
        T.derive_sequences(spark, str(tmp_path)).collect()


def test_a_large_vocabulary_is_joined_with_equal_ids(spark, small_dir):
    from tessera.operators import tokens as K
    from tessera.plans import q_tokens as QK
    s, v = QL.seq(spark, small_dir).limit(500), QK.vocab_df(spark, small_dir)
    pick = lambda df: sorted((r.seq_id, r.ids_a, r.ids_b) for r in df.collect())
    assert pick(K.encode_ids(s, v)) == pick(K.encode_ids(s, v, max_inline=3))


def test_label_and_split_joins_do_not_shuffle_the_rows(spark, small_dir):
    """With broadcasts by size turned off, nothing data-sized is exchanged on a tiny key."""
    from tessera.plans import QUERIES
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("label_encode", "one_hot", "pad_ids", "attention_mask", "pair_concat", "matrix_embed"):
            plan = _plan(QUERIES[key](spark, small_dir))
            assert "SortMergeJoin" not in plan, key
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_expansion_is_not_exchanged_by_row(spark, small_dir):
    plan = _plan(QS.substitution_expand(spark, small_dir))
    assert "hashpartitioning" in plan and not any(
        "seq_id" in line for line in plan.splitlines() if "hashpartitioning" in line)


def test_spread_only_repartitions_inputs_with_few_splits(spark):
    from tessera.sources.tables import spread
    few = spark.range(1000, numPartitions=1)
    many = spark.range(1000, numPartitions=spark.sparkContext.defaultParallelism * 8)
    assert "Exchange" in _plan(spread(few, few, "id"))
    assert "Exchange" not in _plan(spread(many, many, "id"))


def test_pair_table_is_rederived_when_its_folder_is_gone(spark, small_dir):
    from tessera.sources import tables as T
    n = T.sequences(spark, small_dir).count()
    path = T.sequence_table(spark, small_dir)
    key = next(k for k, v in T._SEQ_TABLES.items() if v == path)
    T._SEQ_TABLES[key] = "/tmp/tessera-missing-folder-for-test"   # as if cleaned up
    again = T.sequences(spark, small_dir)
    assert again.count() == n and T._SEQ_TABLES[key] != "/tmp/tessera-missing-folder-for-test"


def test_scan_digest_equals_the_raw_deltas(spark, small_dir, monkeypatch):
    """Repeated pairs, an unknown symbol and an empty chain; more blocks than one."""
    monkeypatch.setattr(X, "DELTAS_AT_ONCE", 100)
    m = QS.model(spark, small_dir)
    rows = [(1, "the", "cat", "Q"), (2, "the", "cat", "Q"), (3, "dog", "", "X"), (4, "d€g", "the", "X"), (5, "x", "the", "negative")]
    df = spark.createDataFrame(rows, "seq_id long, chain_a string, chain_b string, grp string")
    want = {}
    for r in X.substitution_deltas(df, m).collect():
        want.setdefault((r.chain, r.grp, r.aa), []).append(r)
    got = {(r.chain, r.grp, r.aa): r for r in X.delta_digest(df, m).collect()}
    assert got.keys() == want.keys()
    for key, rs in want.items():
        assert got[key].n == len(rs)
        for lb in m.labels:
            d = np.array([r[f"d_{lb}"] for r in rs])
            assert np.allclose([got[key][f"{k}_{lb}"] for k in ("total", "squares", "lowest", "highest")],
                               [d.sum(), (d * d).sum(), d.min(), d.max()], atol=1e-9)


def test_counted_chains_tell_what_all_rows_do(spark):
    """Each distinct chain is taken apart once, and counts for all of its rows."""
    from tessera.operators import positions as P
    from tessera.operators import tokens as K
    rows = [(1, "aab", "", "Q"), (2, "aab", "b", None), (3, "ä𝒳", "aab", "Q"), (4, None, "b", "Q")]
    df = spark.createDataFrame(rows, "seq_id long, chain_a string, chain_b string, tags string")
    for extra in ([], ["tags"]):
        by = [*extra, "chain", "aa", "position"]
        want = P.residue_positions(df).groupBy(*by).count().collect()
        assert {r[:-1]: r[-1] for r in want} == {r[:-1]: r[-1] for r in P.counted_positions(df, extra).groupBy(*by).sum("_n").collect()}
    assert K.chain_table(df, [F.count("*").alias("n")]).count() == 4
    assert {r.token: r.n for r in K.token_counts(df).collect()} == {"a": 6, "b": 5, "ä": 1, "𝒳": 1}


def test_equal_chains_are_expanded_once(spark, small_dir):
    from tessera.sources import tables as T
    s = T.sequences(spark, small_dir)
    words = s.select(F.explode(F.array("chain_a", "chain_b")).alias("w")).where("w <> ''")
    distinct = sum(s.select(c).where(f"{c} <> ''").distinct().count() for c in ("chain_a", "chain_b"))
    plan = QS.substitution_expand(spark, small_dir)
    read = plan.inputFiles()
    assert all("/chains-" in f for f in read) and spark.read.parquet(read[0].rsplit("/", 1)[0]).count() == distinct < words.count()


def test_pair_representation_by_row_equals_the_joins(spark, monkeypatch):
    from tessera.operators import reps as RP
    rows = spark.createDataFrame([("a", 0, 0.25), ("a", 2, 0.75), ("b", 1, 1.0), ("𝒳", 2, 0.5)], "symbol string, k int, value double")
    data = [(1, "ab", "ba"), (2, "Aa?", ""), (3, "_a", "𝒳"), (4, "??", None), (5, "ab", "b_")]
    df = spark.createDataFrame(data, "seq_id long, chain_a string, chain_b string")
    flat = lambda d: sorted((r.seq_id, [(e.k, round(e.value, 9)) for e in r.rep], [(e.k, round(e.value, 9)) for e in r.rep_first]) for r in d.collect())
    fast = RP.pair_representation(df, rows, 3)
    assert "hashpartitioning" not in _plan(fast)
    monkeypatch.setattr(RP, "CELLS", 0)
    assert flat(fast) == flat(RP.pair_representation(df, rows, 3))


def test_summed_representation_equals_the_vectors(spark, monkeypatch):
    """The sums are made where the vectors are, so the vectors don't come back to the JVM; the
    residue matrix and its symbols read the train rows once."""
    from tessera.operators import reps as RP
    rows = spark.createDataFrame([("a", 0, 0.25), ("a", 2, 0.75), ("b", 1, 1.0), ("𝒳", 2, 0.5)], "symbol string, k int, value double")
    data = [(1, "ab", "ba"), (2, "Aa?", ""), (3, "_a", "𝒳"), (4, "??", None), (5, "ab", "b_"), (None, None, None), (1, "ab", "ba")]
    df = spark.createDataFrame(data, "seq_id long, chain_a string, chain_b string")
    at = lambda cells: round(sum((e.k + 1) * e.value for e in cells), 9)
    key = lambda r: (r[0] is None, r)
    want = sorted(((r.seq_id, at(r.rep), at(r.rep_first)) for r in RP.pair_representation(df, rows, 3).collect()), key=key)
    for cells, at_once in ((RP.CELLS, RP.CELLS_AT_ONCE), (RP.CELLS, 20), (0, 1)):
        monkeypatch.setattr(RP, "CELLS", cells)
        monkeypatch.setattr(RP, "CELLS_AT_ONCE", at_once)
        got = RP.pair_representation(df, rows, 3, summed=True)
        assert got.columns == ["seq_id", "rep_sum", "first_sum"]
        assert sorted(((r.seq_id, round(r.rep_sum, 9), round(r.first_sum, 9)) for r in got.collect()), key=key) == want


def test_steps_of_the_metrics_log_read_stored_scores(spark, small_dir, monkeypatch):
    from tessera.plans import q_runs as QR
    kept, steps = QR.FS.append_metrics, []
    monkeypatch.setattr(QR.FS, "append_metrics", lambda df, path, run: (steps.append(df.inputFiles()), kept(df, path, run=run))[1])
    assert QR.metrics_long(spark, small_dir).count() > 0
    assert len(steps) == len(QR.THRESHOLDS) + 1 and all(f and all("/scores-" in x for x in f) for f in steps)


def test_only_the_named_columns_meet_the_encoder(spark, small_dir):
    """Nulls stay null, empty chains are empty, unknown symbols raise."""
    import pytest

    from tessera.operators import tokens as K
    v = spark.createDataFrame([("[UNK]", 0), ("a", 5), ("𝒳", 7)], "token string, id int")
    df = spark.createDataFrame([(1, "A𝒳", ""), (2, None, "a")], "seq_id long, chain_a string, chain_b string")
    assert sorted(tuple(r) for r in K.encode_ids(df, v).select("seq_id", "ids_a", "ids_b").collect()) == [(1, [5, 7], []), (2, None, [5])]
    with pytest.raises(Exception, match="token not in vocabulary"):
        K.encode_ids(df.withColumn("chain_b", F.lit("z")), v).collect()
