"""Hand-made golden cases for the semantics the survey lists as traps, and
properties of the kernels (checked against plain windows / brute force)."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import text as TX
from tessera.operators import bpe as B
from tessera.operators import kernels as KN
from tessera.operators import labels as L
from tessera.operators import metrics as M
from tessera.operators import positions as P
from tessera.operators import sampling as S
from tessera.operators import tokens as K

# The reference's word-level vocabulary (specials 0..4, symbols 5..24).
REF_WL_VOCAB = {"[UNK]": 0, "[CLS]": 1, "[SEP]": 2, "[PAD]": 3, "[MASK]": 4,
                "s": 5, "g": 6, "a": 7, "f": 8, "c": 9, "t": 10, "l": 11, "q": 12, "y": 13,
                "n": 14, "v": 15, "e": 16, "r": 17, "k": 18, "d": 19, "i": 20, "p": 21,
                "h": 22, "m": 23, "w": 24}
# The reference's seven composite labels and their flags.
REF_LABELS = [("HA69", 0, (1, 0, 0), (1, 0, 0)), ("HA69|HCRT", 1, (1, 1, 0), (0, 0, 0)),
              ("HA69|NP136", 2, (1, 0, 1), (0, 0, 0)), ("HCRT", 3, (0, 1, 0), (0, 1, 0)),
              ("HCRT|NP136", 4, (0, 1, 1), (0, 0, 0)), ("NP136", 5, (0, 0, 1), (0, 0, 1)),
              ("negative", 6, (0, 0, 0), (0, 0, 0))]
TARGETS = ("HA69", "HCRT", "NP136")


def test_label_codes_and_flags(spark):
    df = spark.createDataFrame([(lb,) for lb, *_ in REF_LABELS], "tags string")
    codes = {r["label"]: r["code"] for r in L.fit_label_codes(df).collect()}
    inc = {r["tags"]: (r["flag_HA69"], r["flag_HCRT"], r["flag_NP136"], r["negative"], r["activated_any"])
           for r in L.flags_inclusive(df, targets=TARGETS).collect()}
    exc = {r["tags"]: (r["flag_HA69"], r["flag_HCRT"], r["flag_NP136"])
           for r in L.flags_exclusive(df, targets=TARGETS).collect()}
    for lb, code, i, e in REF_LABELS:
        assert codes[lb] == code
        assert inc[lb][:3] == i and exc[lb] == e
        assert inc[lb][3] == int(lb == "negative") and inc[lb][4] == int(lb != "negative")


def test_label_encode_unseen(spark):
    train = spark.createDataFrame([("A",), ("B",)], "tags string")
    test = spark.createDataFrame([("A",), ("C",)], "tags string")
    codes = L.fit_label_codes(train)
    kept = {r["tags"]: r["num_label"] for r in L.label_encode(test, codes, handle_invalid="keep").collect()}
    assert kept == {"A": 0, "C": 2}
    with pytest.raises(Exception):
        L.label_encode(test, codes).collect()


def test_exact_group_sends_composites_to_negative(spark):
    df = spark.createDataFrame([("Q",), ("Q|T",), ("negative",), ("X",)], "tags string")
    got = {r["tags"]: r["g"] for r in df.select("tags", L.exact_group().alias("g")).collect()}
    assert got == {"Q": "Q", "Q|T": "negative", "negative": "negative", "X": "X"}


def test_single_target_rejects_unknown(spark):
    df = spark.createDataFrame([(1,)], "flag_Q int")
    with pytest.raises(ValueError):
        L.single_target(df, "num_label")


def test_padding_and_mask_use_id_0(spark):
    df = spark.createDataFrame([("CFA",), ("",)], "s string")
    ids = K.encode_wl("s", REF_WL_VOCAB)
    out = df.select(X.pad(ids, 6).alias("ids"), X.attention_mask(F.size(ids), 6).alias("m")).collect()
    assert out[0]["ids"] == [9, 8, 7, 0, 0, 0] and out[0]["m"] == [1, 1, 1, 0, 0, 0]
    assert out[1]["ids"] == [0] * 6 and out[1]["m"] == [0] * 6


def test_longer_than_pad_length_is_not_truncated(spark):
    df = spark.createDataFrame([("CASSL",)], "s string")
    got = df.select(X.pad(K.encode_wl("s", REF_WL_VOCAB), 3).alias("ids")).first()["ids"]
    assert got == [9, 7, 5, 5, 11]


def test_unknown_symbol_policies(spark):
    df = spark.createDataFrame([("CBA",)], "s string")     # 'b' is not in the vocabulary
    with pytest.raises(Exception):
        df.select(K.encode_wl("s", REF_WL_VOCAB, "error")).collect()
    assert df.select(K.encode_wl("s", REF_WL_VOCAB, "unk")).first()[0] == [9, 0, 7]
    assert df.select(K.encode_wl("s", REF_WL_VOCAB, "drop")).first()[0] == [9, 7]


def test_decode_inverts_encode(spark):
    words = ["CASS", "GAF", "W", "YQN"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    out = df.select(F.array_join(K.decode_ids(K.encode_wl("s", REF_WL_VOCAB), REF_WL_VOCAB), "")).collect()
    assert [r[0] for r in out] == [w.lower() for w in words]


def test_threshold_strict_and_rounding(spark):
    df = spark.createDataFrame([([0.5004, 0.5, 0.7],)], "p array<double>")
    assert df.select(X.threshold("p", 0.5)).first()[0] == [1, 0, 1]
    assert df.select(X.threshold("p", 0.5, round_digits=3)).first()[0] == [0, 0, 1]
    with pytest.raises(ValueError):
        X.threshold("p", 1.5)


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.0125,), (0.0135,), (2.5,)], "x double")
    got = [r[0] for r in df.select(X.round_even("x", 3)).collect()]
    assert got == [float(np.round(0.0125, 3)), float(np.round(0.0135, 3)), 2.5]


def test_auc_golden(spark):
    df = spark.createDataFrame([("L", 0.9, 1), ("L", 0.9, 0), ("L", 0.4, 1), ("L", 0.2, 0)],
                               "label string, prob double, target int")
    assert M.roc_auc(df).first()["auc"] == pytest.approx(0.625)


def test_auc_complement_property(spark):
    rnd = random.Random(7)
    rows = [("L", round(rnd.random(), 3), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "label string, prob double, target int")
    a = M.roc_auc(df).first()["auc"]
    b = M.roc_auc(df.withColumn("prob", 1 - F.col("prob"))).first()["auc"]
    assert a + b == pytest.approx(1.0, abs=1e-6)


def test_precision_recall_zero_division_and_counts(spark):
    df = spark.createDataFrame([(1, [0, 0], [0, 1], [0.1, 0.2]), (2, [0, 0], [0, 0], [0.2, 0.1])],
                               "seq_id long, pred array<int>, target array<int>, prob array<double>")
    b = M.metric_bundle(df.withColumn("split", F.lit("s")), ["A", "B"]).first()
    assert b["recall_A"] == 0.0 and b["precision_A"] == 0.0 and b["recall_B"] == 0.0
    assert b["indv_acc"] == 0.5 and b["acc"] == 0.75
    c = M.confusion_long(M.to_long(df, ["A", "B"])).collect()
    assert sum(r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in c) == 4


def test_bce_clamps_log(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 1.0)], "t int, p double")
    got = [r[0] for r in df.select(X.bce(F.col("t"), F.col("p"))).collect()]
    assert got == [100.0, 100.0, 0.0]


def test_split_exact_uses_double_product(spark):
    df = spark.range(10).select(F.col("id").alias("seq_id"), X_key("id"))
    got = S.split_exact(df).where(F.col("split") == "train").count()
    assert got == math.ceil(0.7 * 10) == 7
    # the product is a double, as in the reference library: 0.55 * 100 = 55.00000000000001
    df100 = spark.range(100).select(F.col("id").alias("seq_id"), X_key("id"))
    got = S.split_exact(df100, 0.55).where(F.col("split") == "train").count()
    assert got == math.ceil(0.55 * 100) == 56


def X_key(c):
    from tessera.sources.tables import seeded_key
    return seeded_key(c).alias("h")


def test_global_index_equals_row_number_with_hot_group(spark):
    # one group holds far more than a third of the rows
    rows = [(i, "hot" if i % 10 < 7 else f"g{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string").withColumn("h", F.md5(F.col("k").cast("string")))
    got = KN.global_index(df, "h", by=["g"], digits=2).select("k", "idx")
    want = df.select("k", F.row_number().over(Window.partitionBy("g").orderBy("h")).alias("idx"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_balanced_sample_sizes(spark):
    rows = [(i, int(i % 5 == 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, y int").withColumn("h", F.md5(F.col("k").cast("string")))
    c = {r["y"]: r["count"] for r in S.balanced_sample(df, "y").groupBy("y").count().collect()}
    assert c == {0: 100, 1: 100}


@pytest.mark.parametrize("how", ["sum", "max", "min"])
def test_prefix_aggregate_equals_window(spark, how):
    rnd = random.Random(3)
    rows = [("r1" if i % 4 else "r2", i, rnd.randint(-50, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "run string, step long, v long")
    got = KN.prefix_aggregate(df, ["run"], "step", ["v"], how, buckets=16).select("run", "step", "v_cum", "v_prev")
    f = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    w = Window.partitionBy("run").orderBy("step")
    want = df.select("run", "step", f("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("v_cum"),
                     f("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("v_prev"))
    if how == "sum":                          # nothing before the first row adds up to 0
        want = want.fillna(0, ["v_prev"])
    assert sorted(got.collect()) == sorted(want.collect())


def test_row_index_descending_ties_free(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(100)], "x long")
    got = KN.row_index(df, "x").orderBy("x").collect()
    assert [r["idx"] for r in got] == list(range(1, 101))


def test_hist_fixed_matches_numpy(spark):
    rnd = np.random.default_rng(1)
    xs = rnd.random(500)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = {r["bin"]: r["n"] for r in P.hist_fixed(df, "x", bins=20, stat="count").collect()}
    want, _ = np.histogram(xs, bins=20)
    assert [got[i] for i in range(20)] == list(want)


def test_auto_bins_match_numpy(spark):
    rnd = np.random.default_rng(2)
    for xs in (rnd.random(300), rnd.integers(0, 5, 200) / 7.0, np.full(10, 0.5)):
        df = spark.createDataFrame([(float(x),) for x in xs], "x double")
        got = P.auto_bin_stats(df, "x").first()["n_bins"]
        assert got == len(np.histogram_bin_edges(xs, bins="auto")) - 1


def test_residue_positions_use_own_length(spark):
    df = spark.createDataFrame([(1, "AB", "CDEF", "Q")], "seq_id long, chain_a string, chain_b string, tags string")
    got = {(r["chain"], r["aa"]): r["position"] for r in P.residue_positions(df).collect()}
    assert got[("a", "b")] == 0.5 and got[("b", "f")] == 0.75


def _bpe_brute(words, n_merges, min_freq):
    """Plain-Python BPE on a word-count dict (reference behaviour)."""
    ids = {}
    for s in sorted({c for w in words for c in w}):
        ids[s] = len(ids)
    seqs = {w: list(w) for w in words}
    merges = []
    for _ in range(n_merges):
        cnt = {}
        for w, n in words.items():
            s = seqs[w]
            for a, b in zip(s, s[1:]):
                cnt[(a, b)] = cnt.get((a, b), 0) + n
        if not cnt:
            break
        best = max(cnt.items(), key=lambda kv: (kv[1], -ids[kv[0][0]], -ids[kv[0][1]]))
        (a, b), n = best
        if n < min_freq:
            break
        merges.append((a, b, n))
        ids.setdefault(a + b, len(ids))
        for w in seqs:
            s, out, i = seqs[w], [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seqs[w] = out
    return merges, seqs


def test_bpe_train_and_encode_match_brute_force(spark, small_dir):
    from tessera.plans.q_text import train_words
    w = train_words(spark, small_dir)
    counts = {r["w"][1:-1].replace("><", "\x00"): r["n"] for r in w.collect()}
    words = {tuple(k.split("\x00")): n for k, n in counts.items()}
    words = {"".join(k): n for k, n in words.items()}
    want_merges, want_seqs = _bpe_brute(words, 12, 2)
    ids, merges = B.train(w, 12, min_frequency=2, segment_tokens=500)
    assert merges == want_merges
    enc = B.encode_words(w, [(a, b) for a, b, _ in merges]).collect()
    for r in enc:
        word = r["w"][1:-1].replace("><", "")
        assert r["tokens"] == want_seqs[word]
        assert "".join(r["tokens"]) == word


def test_normalize_nfd_matches_unicodedata(spark):
    texts = ["Café Élan", "plain ascii", "Ärger über Öl", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["normalized"] for r in TX.normalize(df, "t").collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else unicodedata.normalize("NFD", t.lower()))


def test_pretokenize_ws(spark):
    df = spark.createDataFrame([("Hello, world!! x_1 ",)], "s string")
    assert df.select(TX.pretokenize_ws(F.col("s"))).first()[0] == ["Hello", ",", "world", "!!", "x_1"]


def test_softmax_sigmoid_argmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "z array<double>")
    r = df.select(X.softmax("z").alias("s"), X.argmax("z").alias("a"),
                  X.sigmoid(F.lit(0.0)).alias("g")).first()
    e = np.exp([1.0, 2.0, 3.0])
    assert r["s"] == pytest.approx(list(e / e.sum())) and r["a"] == 2 and r["g"] == 0.5


def test_rank_threshold_reads_the_input_twice(spark, monkeypatch):
    """A bucket that is refined is written once (its keys alone) and read from there."""
    import hashlib
    keys = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(3000)) + ["f" * 32] * 40
    df = spark.createDataFrame([(h, 1) for h in keys], "h string, other int")
    kept, made = KN.materialize, []
    monkeypatch.setattr(KN, "materialize", lambda d, name: made.append(kept(d, name)) or made[-1])
    for k in (1, 1500, 2999, 3000, 3039):
        made.clear()
        assert KN.rank_threshold(df, "h", k, digits=1, max_boundary_rows=5, first_digits=2) == (keys[k - 1], len(keys))
        assert 1 <= len(made) <= 2 and made[0].columns == ["h"] and made[0].count() <= len(keys) // 16
    made.clear()
    same = spark.createDataFrame([("ab" * 16,)] * 60, "h string")       # a bucket with most rows isn't copied
    assert KN.rank_threshold(same, "h", 30, max_boundary_rows=5) == ("ab" * 16, 60) and not made


def test_rank_threshold_refines_and_is_exact(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("h"))
    hs = sorted(r["h"] for r in df.collect())
    for k in (1, 77, 2500, 4999):
        got, n = KN.rank_threshold(df, "h", k, digits=1, max_boundary_rows=50, first_digits=1)
        assert n == 5000 and got == hs[k - 1]
    assert KN.rank_threshold(df, "h", 0)[0] is None
    top, _ = KN.rank_threshold(df, "h", 5000)
    assert top > hs[-1]


def test_epoch_loss_reset_versus_running(spark):
    import datetime as dt
    from tessera.operators import runs as R
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    rows = [(1, "loss", d1, 1.0), (1, "loss", d1, 3.0), (1, "loss", d2, 5.0)]
    log = spark.createDataFrame(rows, "run long, tag string, epoch date, value double")
    got = {r["epoch"]: (r["epoch_mean"], r["running_mean"]) for r in R.epoch_loss(log).collect()}
    assert got[d1] == (2.0, 2.0)
    assert got[d2] == (5.0, 3.0)          # per-epoch resets; the logged running mean does not


def test_batch_macro_differs_from_pooled_on_uneven_batches(spark):
    rows = [(1, "s", 0, [1], [1], [0.9]), (2, "s", 0, [0], [1], [0.1]), (3, "s", 0, [0], [1], [0.2]),
            (4, "s", 1, [1], [1], [0.8])]
    df = spark.createDataFrame(rows, "seq_id long, split string, batch_id long, pred array<int>, "
                                     "target array<int>, prob array<double>")
    pooled = M.metric_bundle(df, ["A"]).first()["acc"]
    macro = M.batch_macro(df, ["A"]).first()["acc"]
    assert pooled == 0.5 and macro == pytest.approx((1 / 3 + 1.0) / 2, abs=1e-6)


def test_best_step_is_max_first_on_ties(spark):
    from tessera.operators import runs as R
    rows = [(1, "acc", 3, 0.9), (1, "acc", 1, 0.9), (1, "acc", 2, 0.5)]
    log = spark.createDataFrame(rows, "run long, tag string, step long, value double")
    r = R.best_step(log).first()
    assert r["best_step"] == 1 and r["best_value"] == 0.9


def test_delta_is_original_minus_modified(spark):
    from tessera.operators import perturb as PT
    from tessera.operators.scoring import LogOddsModel
    w = {"a": {"Q": {"a": 2.0, "b": -2.0}}, "b": {"Q": {"a": 0.0, "b": 0.0}}}
    m = LogOddsModel(("Q",), w, {"Q": 0.0}, ("a", "b"))
    df = spark.createDataFrame([(1, "A", "", "Q")], "seq_id long, chain_a string, chain_b string, tags string")
    r = PT.mean_delta(df, m).where(F.col("aa") == "b").first()
    # replacing a high-weight symbol by a low one lowers p: the delta is positive
    want = 1 / (1 + math.exp(-2.0)) - 1 / (1 + math.exp(2.0))
    assert r["mean_delta"] == pytest.approx(round(want, 6)) and r["mean_delta"] > 0


def test_prefix_aggregate_small_and_empty_inputs(spark):
    df = spark.createDataFrame([("r", 1, 2), ("r", 2, 3)], "g string, o long, v long")
    got = sorted((r["o"], r["v_cum"]) for r in KN.prefix_aggregate(df, ["g"], "o", ["v"]).collect())
    assert got == [(1, 2), (2, 5)]
    assert KN.prefix_aggregate(df.limit(0), ["g"], "o", ["v"]).count() == 0
