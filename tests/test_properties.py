"""Properties from the survey's test strategy, on the real sf0.001 tables."""

from pyspark.sql import functions as F

from tessera.operators import bpe as B
from tessera.operators import bpe_train as BT
from tessera.operators import metrics as M
from tessera.operators import positions as P
from tessera.operators import tokens as K
from tessera.plans import q_labels as QL
from tessera.plans import q_scoring as QS
from tessera.plans import q_text as QT


def test_split_is_a_partition_of_the_rows(spark, small_dir):
    s = QL.split_seq(spark, small_dir)
    n = QL.seq(spark, small_dir).count()
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c["train"] + c["test"] == n
    assert c["train"] == -(-7 * n // 10)          # ceil(0.7 n)
    assert s.select("seq_id").distinct().count() == n


def test_mask_sum_equals_length(spark, small_dir):
    v = K.vocab_dict(K.fit_wl_vocab(spark, K.token_counts(QL.seq(spark, small_dir))))
    e = K.encode_padded(QL.split_seq(spark, small_dir), v)
    bad = e.where(F.aggregate("mask_a", F.lit(0), lambda a, x: a + x) != F.length("chain_a")).count()
    assert bad == 0
    assert e.where(F.size("ids_a") != F.greatest(F.length("chain_a"), F.col("max_len"))).count() == 0


def test_histogram_probabilities_sum_to_one(spark, small_dir):
    p = P.residue_positions(QL.seq(spark, small_dir))
    h = P.hist_fixed(p, "position", ["chain", "aa"], bins=20)
    sums = h.groupBy("chain", "aa").agg(F.sum("prob").alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-4 for r in sums)


def test_confusion_and_accuracy_relations(spark, small_dir):
    s = M.predict(QS.model_scores(spark, small_dir), 0.5)
    n = s.count()
    c = M.confusion_long(M.to_long(s, ["Q", "T", "X"])).collect()
    assert sum(r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in c) == 3 * n
    b = M.metric_bundle(s, ["Q", "T", "X"]).collect()
    assert all(r["acc"] >= r["indv_acc"] for r in b)


def test_bpe_tokens_concatenate_to_the_word(spark, small_dir):
    w = QT.train_words(spark, small_dir)
    ids, merges = B.train(w, 8, min_frequency=2)
    s = QL.seq(spark, small_dir)
    enc = B.encode(s, [(a, b) for a, b, _ in merges], ids)
    pieces = enc.select(*[F.coalesce(B.byte_piece(F.col(f"chain_{c}")), F.lit("")).alias(f"piece_{c}") for c in "ab"], "tokens_a", "tokens_b")
    assert all("".join(r[f"tokens_{c}"]) == r[f"piece_{c}"] for r in pieces.collect() for c in "ab")
    assert enc.count() == s.count()


def test_unicode_pretokenizer_matches_the_tokenizer_library(spark, small_dir):
    """Cross-check (test time only) against the public tokenizers library's Whitespace
    pre-tokenizer, on the whole texts of the smallest tables."""
    import pytest
    pre = pytest.importorskip("tokenizers.pre_tokenizers")
    from tessera.functions import text as TX
    from tessera.sources import tables as T
    d = T.table(spark, small_dir, "documents").select("doc_id", "text")
    got = d.select("doc_id", "text", TX.pretokenize_ws(F.col("text"), unicode=True).alias("p")).collect()
    ws = pre.Whitespace()
    bad = [r["doc_id"] for r in got if [t for t, _ in ws.pre_tokenize_str(r["text"])] != r["p"]]
    assert not bad, bad[:5]


def _corpus(spark, small_dir, tmp_path, spaced):
    from tessera.operators import tokens as K
    train = QL.split_seq(spark, small_dir).where(F.col("split") == "train")
    lines = K.corpus_lines(train, spaced_chars=spaced).orderBy("seq_id", "line_no").collect()
    f = tmp_path / ("spaced.txt" if spaced else "raw.txt")
    f.write_text("".join(r["line"] + "\n" for r in lines))
    return train, str(f)


def test_word_level_vocab_matches_the_tokenizer_library(spark, small_dir, tmp_path):
    import pytest
    tk = pytest.importorskip("tokenizers")
    from tokenizers import normalizers, pre_tokenizers
    from tokenizers.models import WordLevel
    from tokenizers.trainers import WordLevelTrainer
    from tessera.functions.exprs import SPECIAL_TOKENS
    from tessera.operators import tokens as K
    train, path = _corpus(spark, small_dir, tmp_path, spaced=True)
    tok = tk.Tokenizer(WordLevel(unk_token="<unk>"))
    tok.normalizer = normalizers.Lowercase()
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.train([path], WordLevelTrainer(special_tokens=list(SPECIAL_TOKENS)))
    ours = K.vocab_dict(K.fit_wl_vocab(spark, K.token_counts(train)))
    assert ours == tok.get_vocab()
    # encode + right padding to the split's longest chain, pad id 0, mask 1 per token
    enc = K.encode_padded(train, ours).select("chain_a", "ids_a", "mask_a", "max_len").collect()
    tok.enable_padding(length=enc[0]["max_len"])
    for r in enc:
        e = tok.encode(" ".join(r["chain_a"]))
        assert e.ids == r["ids_a"] and e.attention_mask == r["mask_a"]


def test_bpe_merges_match_the_tokenizer_library(spark, small_dir, tmp_path):
    """The whole merge list, the ids and the encodings of both chains equal the library's,
    trained to the same least frequency and nothing else."""
    import json

    import pytest
    tk = pytest.importorskip("tokenizers")
    from tokenizers import normalizers, pre_tokenizers
    from tokenizers.models import BPE
    from tokenizers.trainers import BpeTrainer
    from tessera.functions.exprs import SPECIAL_TOKENS
    _, path = _corpus(spark, small_dir, tmp_path, spaced=False)
    ids, merges = QT.trained(spark, small_dir)
    tok = tk.Tokenizer(BPE())
    tok.normalizer = normalizers.Lowercase()
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.ByteLevel()])
    tok.train([path], BpeTrainer(special_tokens=list(SPECIAL_TOKENS), min_frequency=10))
    lib = json.loads(tok.to_str())["model"]["merges"]
    lib = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in lib]
    assert [(a, b) for a, b, _ in merges] == lib and len(lib) > 100
    assert ids == tok.get_vocab()
    rows = {r["seq_id"]: r for r in QL.seq(spark, small_dir).select("seq_id", "chain_a", "chain_b").collect()}
    for r in QT.encode_bpe(spark, small_dir).collect():
        for c in "ab":
            e = tok.encode(rows[r["seq_id"]][f"chain_{c}"])
            assert " ".join(e.tokens) == r[f"tokens_{c}"] and ",".join(map(str, e.ids)) == r[f"ids_{c}"]


def test_merges_that_share_a_round_are_those_taken_one_by_one():
    import random
    from tests.test_golden import _bpe_brute
    r = random.Random(8)
    for _ in range(60):
        words = {"".join(r.choice("abcdef") for _ in range(r.randrange(1, 7))): r.randrange(1, 40) for _ in range(25)}
        want, _ = _bpe_brute(dict(words), 12, 2)
        got, seqs = [], {w: list(w) for w in words}
        ids = {s: i for i, s in enumerate(sorted({c for w in words for c in w}))}
        while len(got) < 12:
            n = {}
            for w, k in words.items():
                for p in zip(seqs[w], seqs[w][1:]):
                    n[p] = n.get(p, 0) + k
            ranked = sorted(((a, b, k) for (a, b), k in n.items() if k >= 2), key=lambda t: (-t[2], ids[t[0]], ids[t[1]]))[:5]
            if not ranked:
                break
            step = BT.independent(ranked, ())[:12 - len(got)]
            for a, b, _n in step:
                got.append((a, b, _n))
                ids.setdefault(a + b, len(ids))
                for w in seqs:
                    s = "<" + "><".join(seqs[w]) + ">"
                    seqs[w] = s.replace(f"<{a}><{b}>", f"<{a + b}>")[1:-1].split("><")
        assert got == want


def test_bpe_stops_at_the_reference_frequency_at_every_size(spark, small_dir):
    words = QT.train_words(spark, small_dir)
    _, merges = QT.trained(spark, small_dir)
    assert merges[-1][2] in (10, 11) and len(merges) > 1000
    ids, capped = B.train(words, vocab_size=200)
    assert len(ids) == 200 and capped == merges[:len(capped)]
    ids, first = B.train(words, 60)
    assert first == merges[:60]


def test_bpe_phases_do_not_change_the_merges(spark, small_dir):
    """Few segments or few pairs on the driver, or no segments at all: the same merges."""
    words = QT.train_words(spark, small_dir)
    _, merges = QT.trained(spark, small_dir)
    assert B.train(words, segment_tokens=70_000)[1] == merges
    assert B.train(words, pairs=40, max_merges=60)[1] == merges[:60]
    assert B.train(words, segment_tokens=0, max_merges=10)[1] == merges[:10]


def test_bpe_phases_against_brute_force(spark):
    """Few letters: overlapping pairs, long words and tokens made in two ways."""
    import random
    from tests.test_golden import _bpe_brute
    r = random.Random(9)
    for _ in range(2):
        words = {"".join(r.choice("abc") for _ in range(r.randrange(1, 30))): r.randrange(1, 40) for _ in range(60)}
        df = spark.createDataFrame([("<" + "><".join(w) + ">", n) for w, n in words.items()], "w string, n long")
        want, _ = _bpe_brute(dict(words), 25, 4)
        for limit in (150, 10_000):
            assert B.train(df, 25, min_frequency=4, segment_tokens=limit)[1] == want


def test_bpe_encodes_tokens_made_in_two_ways():
    merges = [("b", "c"), ("a", "bc"), ("x", "abc"), ("a", "b"), ("ab", "c")]
    assert B.in_order(merges) == [*merges, ("x", "abc")]


def test_large_vocabularies_are_joined_not_written_into_the_plan(spark):
    words = [(i, "abc"[: 1 + i % 3], "" if i % 4 == 0 else "cba", "train" if i % 2 else "test") for i in range(20)]
    df = spark.createDataFrame(words, "seq_id long, chain_a string, chain_b string, split string")
    small = {"a": 5, "b": 6, "c": 7}
    rows = [*small.items(), *((chr(0x4E00 + i), 8 + i) for i in range(11_000))]
    large = spark.createDataFrame(rows, "token string, id int")
    key = lambda d: sorted(tuple(map(str, r)) for r in d.collect())
    cols = ["seq_id", "ids_a", "mask_a", "ids_b", "mask_b"]
    got = K.encode_padded(df, large)
    assert key(got.select(cols)) == key(K.encode_padded(df, small).select(cols))
    assert chr(0x4E00 + 500) not in got._jdf.queryExecution().analyzed().toString()
    assert key(K.encode_combined(df, large).select("seq_id", "ids")) == key(K.encode_combined(df, small).select("seq_id", "ids"))
    assert key(K.encode_combined(df, large, 2).select("seq_id", "ids")) == key(K.encode_combined(df, small, 2).select("seq_id", "ids"))


def test_every_row_has_the_encoding_of_its_own_chains(spark, monkeypatch):
    merges, ids = [("Ġ", "a"), ("b", "c"), ("Ġa", "bc")], {t: i for i, t in enumerate(["Ġ", "a", "b", "c", "Ġa", "bc", "Ġabc"])}
    rows = [(1, "abc", "b"), (1, "cab", ""), (None, "bc", "abc"), (2, None, "abc"), (3, "", ""), (4, "xa", "abc")]
    want = [["Ġabc | Ġ b"], ["Ġ c a b | "], ["Ġ bc | Ġabc"], [" | Ġabc"], [" | "], ["Ġ x a | Ġabc"]]
    for often in (20_000, 1, 0):                # broadcast, shuffled for one column or both
        monkeypatch.setattr(B, "OFTEN", often)
        got = B.encode(spark.createDataFrame(rows, "seq_id long, chain_a string, chain_b string"), merges, ids).collect()
        text = {(r.seq_id, r.chain_a, r.chain_b): [f"{' '.join(r.tokens_a)} | {' '.join(r.tokens_b)}"] for r in got}
        assert len(got) == len(rows) and text == dict(zip(rows, want))
        assert all(r.ids_a == [ids.get(t) for t in r.tokens_a] and r.ids_b == [ids.get(t) for t in r.tokens_b] for r in got)


def test_a_word_table_is_not_shuffled_by_the_jobs_of_a_phase(spark):
    state = BT._stored(spark.createDataFrame([([i, i + 1], 3) for i in range(50)], BT.STATE))
    assert "Exchange" not in state._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ids, r.n) for r in state.collect()) == [([i, i + 1], 3) for i in range(50)]
