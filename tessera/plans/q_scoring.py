"""Stages C and E queries: log-odds scorer, thresholds, metrics, ROC/AUC, substitution scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import chars, dot, round_even, sigmoid, softmax
from ..operators import metrics as M
from ..operators import perturb as X
from ..operators import sampling as S
from ..operators import scoring as SC
from ..operators import tokens as K
from ..operators.labels import exact_group
from ..session import broadcast_small, materialize
from ..sources import tables as T
from ..sources.tables import LABEL_NAMES
from .q_labels import arr_str, labelled, labelled_split, seq, split_seq
from .q_tokens import vocab
from .registry import add_view, query, with_views

# ---------------------------------------------------------------- oracle views
add_view("symbols", ("vocab",), "SELECT token FROM vocab WHERE NOT contains(token, '[')")
add_view("train_counts", ("train_tokens", "lab"), """
  SELECT chain, token,
         sum(is_q) AS p_Q, sum(1 - is_q) AS n_Q, sum(is_t) AS p_T, sum(1 - is_t) AS n_T,
         sum(is_x) AS p_X, sum(1 - is_x) AS n_X
  FROM train_tokens t JOIN lab s USING (seq_id) GROUP BY chain, token""")
add_view("weights", ("symbols", "train_counts"), """
  WITH g AS (SELECT c.chain, s.token, coalesce(t.p_Q, 0) AS p_Q, coalesce(t.n_Q, 0) AS n_Q,
                    coalesce(t.p_T, 0) AS p_T, coalesce(t.n_T, 0) AS n_T,
                    coalesce(t.p_X, 0) AS p_X, coalesce(t.n_X, 0) AS n_X
             FROM symbols s CROSS JOIN (VALUES ('a'), ('b')) c(chain)
             LEFT JOIN train_counts t ON t.chain = c.chain AND t.token = s.token),
       v AS (SELECT CAST(count(*) AS DOUBLE) AS V FROM symbols),
       n AS (SELECT *, sum(p_Q) OVER (PARTITION BY chain) AS NP_Q, sum(n_Q) OVER (PARTITION BY chain) AS NN_Q,
                       sum(p_T) OVER (PARTITION BY chain) AS NP_T, sum(n_T) OVER (PARTITION BY chain) AS NN_T,
                       sum(p_X) OVER (PARTITION BY chain) AS NP_X, sum(n_X) OVER (PARTITION BY chain) AS NN_X
             FROM g)
  SELECT chain, 'Q' AS label, token, ln((p_Q + 1) / (NP_Q + V)) - ln((n_Q + 1) / (NN_Q + V)) AS weight FROM n, v
  UNION ALL SELECT chain, 'T', token, ln((p_T + 1) / (NP_T + V)) - ln((n_T + 1) / (NN_T + V)) FROM n, v
  UNION ALL SELECT chain, 'X', token, ln((p_X + 1) / (NP_X + V)) - ln((n_X + 1) / (NN_X + V)) FROM n, v""")
add_view("priors", ("labsplit",), """
  SELECT 'Q' AS label, greatest(ln(sum(is_q) / (count(*) - sum(is_q))), -100) AS prior FROM labsplit WHERE split = 'train'
  UNION ALL SELECT 'T', greatest(ln(sum(is_t) / (count(*) - sum(is_t))), -100) FROM labsplit WHERE split = 'train'
  UNION ALL SELECT 'X', greatest(ln(sum(is_x) / (count(*) - sum(is_x))), -100) FROM labsplit WHERE split = 'train'""")
add_view("logits", ("lab", "all_tokens", "weights", "priors"), """
  SELECT s.seq_id, p.label, p.prior + coalesce(sum(w.weight), 0) AS z
  FROM lab s CROSS JOIN priors p
  LEFT JOIN all_tokens t ON t.seq_id = s.seq_id
  LEFT JOIN weights w ON w.chain = t.chain AND w.token = t.token AND w.label = p.label
  GROUP BY s.seq_id, p.label, p.prior""")
add_view("model_scores", ("logits", "split"), """
  SELECT l.seq_id, s.split, l.label, l.z, 1 / (1 + exp(-l.z)) AS prob,
         CASE l.label WHEN 'Q' THEN s.is_q WHEN 'T' THEN s.is_t ELSE s.is_x END AS target
  FROM logits l JOIN split s ON l.seq_id = s.seq_id""")


# ---------------------------------------------------------------- Spark helpers
_MODELS: dict[str, SC.LogOddsModel] = {}


def model(spark, sf) -> SC.LogOddsModel:
    """Vocabulary + log-odds weights fitted on the train split; fitted once for a pair table.

    One grouped aggregate over the train tokens (chains x alphabet rows) and one row
    of label counts; the weight arithmetic runs on those bounded tables.
    """
    path = T.sequence_table(spark, sf)
    if path not in _MODELS:
        train = split_seq(spark, sf).where(F.col("split") == "train")
        _MODELS[path] = SC.fit_vocab_and_model(train)[1]
    return _MODELS[path]


def model_scores(spark, sf, m=None):
    """Split rows with prob/target arrays from the fitted log-odds model."""
    m = m or model(spark, sf)
    sp = labelled_split(spark, sf)
    s = SC.score_log_odds(sp, m, logit_out="logit")
    return s.withColumn("target", F.array("is_q", "is_t", "is_x"))


def scored_arrays(spark, sf):
    """Same fixture built row-locally from the labelled pairs (no pivot shuffle)."""
    s = labelled(spark, sf)
    u = {lb: F.conv(F.substring(F.md5(F.concat(F.lit(lb + "-"), F.col("seq_id").cast("string"))), 1, 6),
                    16, 10).cast("double") for lb in LABEL_NAMES}
    flags = {"Q": "is_q", "T": "is_t", "X": "is_x"}
    prob = F.array(*[F.lit(0.6) * u[lb] / F.lit(16777215.0) + F.lit(0.4) * F.col(flags[lb])
                     for lb in LABEL_NAMES])
    return s.select("seq_id", prob.alias("prob"),
                    F.array(*[F.col(flags[lb]) for lb in LABEL_NAMES]).alias("target"))


# ---------------------------------------------------------------- scorer
@query("train_log_odds", with_views("""
SELECT chain, label, token, round(weight, 6) AS weight FROM weights""", "weights"))
def train_log_odds(spark, sf):
    v = vocab(spark, sf)
    train = labelled_split(spark, sf).where(F.col("split") == "train")
    w, _ = SC.weight_table(train, SC.spark_symbols(spark, v))
    return w.select("chain", "label", "token", F.round("weight", 6).alias("weight"))


@query("score_log_odds", with_views("""
SELECT seq_id, split, label, round(prob, 6) AS prob FROM model_scores""", "model_scores"))
def score_log_odds(spark, sf):
    s = model_scores(spark, sf)
    lg = M.to_long(s, LABEL_NAMES, keep=["seq_id", "split"], arrays=["prob"])
    return lg.select("seq_id", "split", "label", F.round("prob", 6).alias("prob"))


@query("sigmoid_scores", with_views("""
SELECT seq_id, split, label, round(z, 6) AS logit, round(1 / (1 + exp(-z)), 6) AS prob
FROM model_scores""", "model_scores"))
def sigmoid_scores(spark, sf):
    s = model_scores(spark, sf)
    lg = M.to_long(s, LABEL_NAMES, keep=["seq_id", "split"], arrays=["logit"])
    return lg.select("seq_id", "split", "label", F.round("logit", 6).alias("logit"),
                     F.round(sigmoid(F.col("logit")), 6).alias("prob"))


@query("softmax_scores", with_views("""
SELECT seq_id, split, label, round(e / sum(e) OVER (PARTITION BY seq_id), 6) AS p
FROM (SELECT seq_id, split, label, exp(z - max(z) OVER (PARTITION BY seq_id)) AS e
      FROM model_scores) t""", "model_scores"))
def softmax_scores(spark, sf):
    s = model_scores(spark, sf)
    s = s.withColumn("p", softmax("logit"))
    lg = M.to_long(s, LABEL_NAMES, keep=["seq_id", "split"], arrays=["p"])
    return lg.select("seq_id", "split", "label", F.round("p", 6).alias("p"))


@query("threshold_labels", with_views("""
SELECT seq_id, split, string_agg(CAST(CAST(prob > 0.5E0 AS INT) AS VARCHAR), ',' ORDER BY label) AS pred
FROM model_scores GROUP BY seq_id, split""", "model_scores"))
def threshold_labels(spark, sf):
    s = M.predict(model_scores(spark, sf), 0.5)
    return s.select("seq_id", "split", arr_str("pred").alias("pred"))


@query("round_even", with_views("""
SELECT seq_id, label, round_even(prob, 3) AS p3 FROM scored""", "scored"))
def round_even_q(spark, sf):
    return T.scored(spark, sf).select("seq_id", "label", round_even(F.col("prob"), 3).alias("p3"))


@query("comparison_table", with_views("""
SELECT s.seq_id, s.chain_a AS first_chain, s.chain_b AS second_chain, s.tags AS true_label,
       round_even(max(CASE WHEN m.label = 'Q' THEN m.prob END), 3) AS PROB_Q,
       round_even(max(CASE WHEN m.label = 'T' THEN m.prob END), 3) AS PROB_T,
       round_even(max(CASE WHEN m.label = 'X' THEN m.prob END), 3) AS PROB_X
FROM split s JOIN model_scores m ON s.seq_id = m.seq_id
WHERE s.split = 'test' GROUP BY s.seq_id, s.chain_a, s.chain_b, s.tags""", "model_scores", "split"))
def comparison_table(spark, sf):
    s = model_scores(spark, sf).where(F.col("split") == "test")
    return s.select("seq_id", F.col("chain_a").alias("first_chain"), F.col("chain_b").alias("second_chain"),
                    F.col("tags").alias("true_label"),
                    *[F.bround(F.col("prob")[i], 3).alias(f"PROB_{lb}")
                      for i, lb in enumerate(LABEL_NAMES)])


@query("peek_predictions", with_views("""
SELECT seq_id, string_agg(CAST(round_even(prob, 3) AS VARCHAR), ',' ORDER BY label) AS probs
FROM model_scores WHERE seq_id IN (SELECT seq_id FROM labsplit WHERE split = 'test' ORDER BY seq_id LIMIT 10)
GROUP BY seq_id""", "model_scores", "labsplit"))
def peek_predictions(spark, sf):
    # the first batch of 10 items (a limit is the feature here: a peek)
    s = model_scores(spark, sf).where(F.col("split") == "test").orderBy("seq_id").limit(10)
    return s.select("seq_id", F.array_join(F.transform("prob", lambda p: F.bround(p, 3))
                                           .cast("array<string>"), ",").alias("probs"))


@query("score_mapinpandas", with_views("""
SELECT seq_id, split, label, round(prob, 6) AS prob FROM model_scores""", "model_scores"))
def score_mapinpandas(spark, sf):
    m = model(spark, sf)
    out = SC.score_with_model(labelled_split(spark, sf), SC.numpy_log_odds(m), keep=["seq_id", "split"])
    return M.to_long(out, LABEL_NAMES, keep=["seq_id", "split"], arrays=["prob"]) \
        .select("seq_id", "split", "label", F.round("prob", 6).alias("prob"))


@query("linear_score", with_views("""
SELECT vec_id, round(list_sum(list_transform(range(64),
         lambda i: CAST(embedding[i + 1] AS DOUBLE) / (i + 1))) + 0.5E0, 6) AS score
FROM embeddings""", ))
def linear_score(spark, sf):
    v = T.vectors(spark, sf)
    w = [1.0 / (i + 1) for i in range(64)]   # fixed weights of the dense layer
    return v.select("vec_id", F.round(dot("vec", w, 0.5), 6).alias("score"))


# ---------------------------------------------------------------- metrics (scored fixture)
def scored_pred(spark, sf, t=0.5, rd=None):
    return M.predict(scored_arrays(spark, sf), t, rd)


@query("confusion_by_label", with_views("""
SELECT label, CAST(sum(CASE WHEN prob <= 0.5E0 AND target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(sum(CASE WHEN prob > 0.5E0 AND target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN prob <= 0.5E0 AND target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN prob > 0.5E0 AND target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
FROM scored GROUP BY label""", "scored"))
def confusion_by_label(spark, sf):
    lg = M.to_long(scored_pred(spark, sf), LABEL_NAMES)
    return M.confusion_long(lg)


@query("subset_accuracy", with_views("""
SELECT round(avg(ok), 6) AS indv_acc
FROM (SELECT seq_id, min(CASE WHEN (prob > 0.5E0) = (target = 1) THEN 1 ELSE 0 END) AS ok
      FROM scored GROUP BY seq_id) r""", "scored"))
def subset_accuracy(spark, sf):
    s = scored_pred(spark, sf)
    return s.agg(F.round(F.avg((F.col("pred") == F.col("target")).cast("double")), 6).alias("indv_acc"))


@query("element_accuracy", with_views("""
SELECT round(avg(CASE WHEN (prob > 0.5E0) = (target = 1) THEN 1 ELSE 0 END), 6) AS acc
FROM scored""", "scored"))
def element_accuracy(spark, sf):
    lg = M.to_long(scored_pred(spark, sf), LABEL_NAMES)
    return lg.agg(F.round(F.avg((F.col("pred") == F.col("target")).cast("double")), 6).alias("acc"))


_PR = """
SELECT label, round(CASE WHEN tp + {d} = 0 THEN 0 ELSE tp / (tp + {d}) END, 6) AS {name}
FROM (SELECT label, sum(CASE WHEN prob > 0.5E0 AND target = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN prob > 0.5E0 AND target = 0 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN prob <= 0.5E0 AND target = 1 THEN 1 ELSE 0 END) AS fn
      FROM scored GROUP BY label) c"""


def _pr(spark, sf, which):
    from ..functions.exprs import safe_ratio
    c = M.confusion_long(M.to_long(scored_pred(spark, sf), LABEL_NAMES))
    den = F.col("fn") if which == "recall" else F.col("fp")
    return c.select("label", F.round(safe_ratio(F.col("tp"), F.col("tp") + den), 6).alias(which))


@query("recall_by_label", with_views(_PR.format(d="fn", name="recall"), "scored"))
def recall_by_label(spark, sf):
    return _pr(spark, sf, "recall")


@query("precision_by_label", with_views(_PR.format(d="fp", name="precision"), "scored"))
def precision_by_label(spark, sf):
    return _pr(spark, sf, "precision")


@query("bce_loss", with_views("""
SELECT label, round(avg(-(target * greatest(ln(prob), -100) + (1 - target) * greatest(ln(1 - prob), -100))), 6) AS loss
FROM scored GROUP BY label""", "scored"))
def bce_loss(spark, sf):
    from ..functions.exprs import bce
    lg = M.to_long(scored_arrays(spark, sf), LABEL_NAMES)
    return lg.groupBy("label").agg(F.round(F.avg(bce(F.col("target"), F.col("prob"))), 6).alias("loss"))


@query("labels_long", with_views("""
SELECT seq_id, label, CAST(prob > 0.5E0 AS INT) AS pred, target FROM scored""", "scored"))
def labels_long(spark, sf):
    lg = M.to_long(scored_pred(spark, sf), LABEL_NAMES)
    return lg.select("seq_id", "label", "pred", "target")


@query("row_correct", with_views("""
SELECT seq_id, min(CASE WHEN (prob > 0.5E0) = (target = 1) THEN 1 ELSE 0 END) AS correct
FROM scored GROUP BY seq_id""", "scored"))
def row_correct(spark, sf):
    s = scored_pred(spark, sf)
    return s.select("seq_id", (F.col("pred") == F.col("target")).cast("int").alias("correct"))


_EPOCH = """
SELECT split, count(*) AS n, round(avg(ok), 6) AS indv_acc, round(avg(hits) / 3, 6) AS acc,
       round(avg(loss) / 3, 6) AS loss,
       {pr}
FROM (SELECT seq_id, split,
             min(CASE WHEN (prob > 0.5E0) = (target = 1) THEN 1 ELSE 0 END) AS ok,
             sum(CASE WHEN (prob > 0.5E0) = (target = 1) THEN 1 ELSE 0 END) AS hits,
             sum(-(target * greatest(ln(prob), -100) + (1 - target) * greatest(ln(1 - prob), -100))) AS loss,
             {cells}
      FROM model_scores GROUP BY seq_id, split) r
GROUP BY split"""
_cells = ",\n             ".join(
    f"sum(CASE WHEN label = '{lb}' AND prob > 0.5E0 AND target = 1 THEN 1 ELSE 0 END) AS tp_{lb},\n"
    f"             sum(CASE WHEN label = '{lb}' AND prob > 0.5E0 AND target = 0 THEN 1 ELSE 0 END) AS fp_{lb},\n"
    f"             sum(CASE WHEN label = '{lb}' AND prob <= 0.5E0 AND target = 1 THEN 1 ELSE 0 END) AS fn_{lb}"
    for lb in LABEL_NAMES)
_prs = ",\n       ".join(
    f"round(CASE WHEN sum(tp_{lb}) + sum(fn_{lb}) = 0 THEN 0 ELSE sum(tp_{lb}) / (sum(tp_{lb}) + sum(fn_{lb})) END, 6) AS recall_{lb},\n"
    f"       round(CASE WHEN sum(tp_{lb}) + sum(fp_{lb}) = 0 THEN 0 ELSE sum(tp_{lb}) / (sum(tp_{lb}) + sum(fp_{lb})) END, 6) AS precision_{lb}"
    for lb in LABEL_NAMES)
EPOCH_SQL = _EPOCH.format(pr=_prs, cells=_cells)


@query("epoch_metrics", with_views(EPOCH_SQL, "model_scores"))
def epoch_metrics(spark, sf):
    s = M.predict(model_scores(spark, sf), 0.5)
    return M.metric_bundle(s, LABEL_NAMES, by=["split"])


@query("correct_count", with_views("""
WITH r AS (SELECT seq_id, split, arg_max(label, prob) AS pl,
                  coalesce(min(label) FILTER (WHERE target = 1), 'Q') AS tl
           FROM model_scores GROUP BY seq_id, split)
SELECT split, CAST(sum(CASE WHEN pl = tl THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       count(*) AS n
FROM r GROUP BY split""", "model_scores"))
def correct_count(spark, sf):
    return M.correct_count(model_scores(spark, sf))


_BATCH = """
WITH b AS (SELECT seq_id, CAST(floor((row_number() OVER (PARTITION BY split ORDER BY h) - 1) / 128) AS BIGINT) AS batch_id
           FROM labsplit),
     r AS (SELECT m.seq_id, m.split, b.batch_id,
                  min(CASE WHEN (prob > 0.5E0) = (target = 1) THEN 1 ELSE 0 END) AS ok,
                  sum(CASE WHEN (prob > 0.5E0) = (target = 1) THEN 1 ELSE 0 END) AS hits,
                  sum(-(target * greatest(ln(prob), -100) + (1 - target) * greatest(ln(1 - prob), -100))) AS loss,
                  {cells}
           FROM model_scores m JOIN b ON m.seq_id = b.seq_id GROUP BY m.seq_id, m.split, b.batch_id),
     pb AS (SELECT split, batch_id, avg(ok) AS indv_acc, avg(hits) / 3 AS acc, avg(loss) / 3 AS loss,
                   {pr}
            FROM r GROUP BY split, batch_id)
SELECT split, count(*) AS n_batches, round(avg(indv_acc), 6) AS indv_acc, round(avg(acc), 6) AS acc,
       round(avg(loss), 6) AS loss, {avgs}
FROM pb GROUP BY split"""
_pr_raw = ",\n                   ".join(
    f"CASE WHEN sum(tp_{lb}) + sum(fn_{lb}) = 0 THEN 0 ELSE sum(tp_{lb}) / (sum(tp_{lb}) + sum(fn_{lb})) END AS recall_{lb}, "
    f"CASE WHEN sum(tp_{lb}) + sum(fp_{lb}) = 0 THEN 0 ELSE sum(tp_{lb}) / (sum(tp_{lb}) + sum(fp_{lb})) END AS precision_{lb}"
    for lb in LABEL_NAMES)
_avgs = ", ".join(f"round(avg(recall_{lb}), 6) AS recall_{lb}, round(avg(precision_{lb}), 6) AS precision_{lb}"
                  for lb in LABEL_NAMES)


@query("batch_macro_metrics", with_views(_BATCH.format(cells=_cells, pr=_pr_raw, avgs=_avgs),
                                         "model_scores", "labsplit"))
def batch_macro_metrics(spark, sf):
    m = model(spark, sf)
    sp = S.batch_assign(labelled_split(spark, sf), 128, key="h", batch_col="batch_id", by=["split"])
    s = SC.score_log_odds(sp, m).withColumn("target", F.array("is_q", "is_t", "is_x"))
    return M.batch_macro(M.predict(s, 0.5), LABEL_NAMES, by=["split"])




# ---------------------------------------------------------------- ROC (scored fixture)
@query("roc_points", with_views("""
WITH per AS (SELECT label, prob, sum(target) AS pos, sum(1 - target) AS neg FROM scored GROUP BY label, prob),
     c AS (SELECT label, prob, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
                  sum(pos) OVER (PARTITION BY label) AS P, sum(neg) OVER (PARTITION BY label) AS N
           FROM per WINDOW w AS (PARTITION BY label ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT label, prob AS threshold, round(CASE WHEN N = 0 THEN 0 ELSE cn / N END, 6) AS fpr,
       round(CASE WHEN P = 0 THEN 0 ELSE cp / P END, 6) AS tpr FROM c
UNION ALL SELECT DISTINCT label, CAST('Infinity' AS DOUBLE), 0E0, 0E0 FROM scored""", "scored"))
def roc_points(spark, sf):
    lg = M.to_long(scored_arrays(spark, sf), LABEL_NAMES)
    pts = M.with_origin(M.roc_curve(lg))
    return pts.select("label", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("roc_auc", with_views("""
WITH per AS (SELECT label, prob, sum(target) AS pos, sum(1 - target) AS neg FROM scored GROUP BY label, prob),
     c AS (SELECT label, prob, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
                  sum(pos) OVER (PARTITION BY label) AS P, sum(neg) OVER (PARTITION BY label) AS N
           FROM per WINDOW w AS (PARTITION BY label ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
     r AS (SELECT label, cn / N AS fpr, cp / P AS tpr,
                  coalesce(lag(cn) OVER (PARTITION BY label ORDER BY prob DESC), 0) / N AS fpr0,
                  coalesce(lag(cp) OVER (PARTITION BY label ORDER BY prob DESC), 0) / P AS tpr0 FROM c)
SELECT label, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS auc FROM r GROUP BY label""", "scored"))
def roc_auc(spark, sf):
    lg = M.to_long(scored_arrays(spark, sf), LABEL_NAMES)
    return M.roc_auc(lg)


@query("model_auc", with_views("""
WITH per AS (SELECT split, label, round(z, 9) AS z, sum(target) AS pos, sum(1 - target) AS neg
             FROM model_scores GROUP BY split, label, round(z, 9)),
     c AS (SELECT split, label, z, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
                  sum(pos) OVER (PARTITION BY split, label) AS P, sum(neg) OVER (PARTITION BY split, label) AS N
           FROM per WINDOW w AS (PARTITION BY split, label ORDER BY z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
     r AS (SELECT split, label, cn / N AS fpr, cp / P AS tpr,
                  coalesce(lag(cn) OVER (PARTITION BY split, label ORDER BY z DESC), 0) / N AS fpr0,
                  coalesce(lag(cp) OVER (PARTITION BY split, label ORDER BY z DESC), 0) / P AS tpr0 FROM c)
SELECT split, label, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS auc FROM r GROUP BY split, label""",
                               "model_scores"))
def model_auc(spark, sf):
    s = model_scores(spark, sf)
    lg = M.to_long(s, LABEL_NAMES, keep=["seq_id", "split"], arrays=["logit", "target"])
    # score ties must not depend on float noise: rank on the logit rounded to 9 digits
    lg = lg.withColumn("z", F.round("logit", 9))
    a = M.roc_auc(lg, by=["split", "label"], score="z")
    return a.select("split", "label", "auc")


# ---------------------------------------------------------------- substitution scan
def scan_model(spark, sf):
    return model(spark, sf)


add_view("scan_d", ("positions", "weights", "logits", "symbols"), """
  SELECT p.seq_id, p.chain, CASE WHEN p.tags IN ('Q', 'T', 'X') THEN p.tags ELSE 'negative' END AS grp,
         s.token AS aa, p.position, 'P_' || l.label AS prob,
         1 / (1 + exp(-l.z)) - 1 / (1 + exp(-(l.z + wn.weight - coalesce(wo.weight, 0)))) AS d
  FROM positions p
  JOIN symbols s ON s.token <> p.aa
  JOIN logits l ON l.seq_id = p.seq_id
  JOIN weights wn ON wn.chain = p.chain AND wn.label = l.label AND wn.token = s.token
  LEFT JOIN weights wo ON wo.chain = p.chain AND wo.label = l.label AND wo.token = p.aa""")

MEAN_DELTA_SQL = with_views("""
SELECT chain, grp, prob, aa, position, round(avg(d), 6) + 0.0E0 AS mean_delta
FROM scan_d GROUP BY chain, grp, prob, aa, position""", "scan_d")


@query("mean_delta", MEAN_DELTA_SQL)
def mean_delta(spark, sf):
    return X.mean_delta(labelled(spark, sf), scan_model(spark, sf), method="delta")


def raw_deltas(spark, sf, symbols=None):
    """Every single delta of the scan: (seq_id, chain, grp, aa, position, d_Q, d_T, d_X); or
    those for the given substitutes."""
    x = labelled(spark, sf).withColumn("grp", exact_group("tags"))
    return X.substitution_deltas(x, scan_model(spark, sf), symbols=symbols)


@query("substitution_delta", with_views("""
SELECT chain, grp, prob, aa, count(*) AS n, round(sum(d), 4) + 0.0E0 AS total, round(sum(d * d), 4) AS squares,
       round(min(d), 6) + 0.0E0 AS lowest, round(max(d), 6) + 0.0E0 AS highest
FROM scan_d GROUP BY chain, grp, prob, aa""", "scan_d"))
def substitution_delta(spark, sf):
    """All raw deltas, as a digest of each (chain, group, label, symbol): there are V - 1 for every symbol of the corpus."""
    x = labelled(spark, sf).withColumn("grp", exact_group("tags"))
    zero = F.lit(0.0)
    per = [F.struct(F.lit(f"P_{lb}").alias("prob"), (F.round(f"total_{lb}", 4) + zero).alias("total"),
                    F.round(f"squares_{lb}", 4).alias("squares"), (F.round(f"lowest_{lb}", 6) + zero).alias("lowest"),
                    (F.round(f"highest_{lb}", 6) + zero).alias("highest")) for lb in LABEL_NAMES]
    g = X.delta_digest(x, scan_model(spark, sf))
    return g.select("chain", "grp", "aa", "n", F.explode(F.array(*per)).alias("z")) \
        .select("chain", "grp", "z.prob", "aa", "n", "z.total", "z.squares", "z.lowest", "z.highest")


@query("substitution_expand", with_views("""
SELECT p.chain, p.aa AS orig, s.token AS aa, count(*) AS n, count(DISTINCT p.seq_id) AS n_seq,
       CAST(sum(CAST('0x' || substr(md5(
            substr(c.s, 1, CAST(p.idx AS INT)) || s.token || substr(c.s, CAST(p.idx AS INT) + 2)), 1, 8)
            AS BIGINT)) AS BIGINT) AS checksum
FROM positions p JOIN chars_long c ON c.seq_id = p.seq_id AND c.chain = p.chain
JOIN symbols s ON s.token <> p.aa
GROUP BY p.chain, p.aa, s.token""", "positions", "chars_long", "symbols"))
def substitution_expand(spark, sf):
    # whole expansion, summarised per (chain, original, substitute) with a content checksum:
    # equal chains have equal expansions, so each distinct one is expanded once and counts for
    # all of its rows; the number of rows that hold a symbol is counted before the expansion
    syms = model(spark, sf).symbols
    chain = F.explode(F.array(*[F.struct(F.lit(ch).alias("chain"), F.col(col).alias("s")) for ch, col in K.CHAINS])).alias("z")
    once = materialize(seq(spark, sf).select("seq_id", chain).select("seq_id", "z.chain", "z.s").where("s <> ''").groupBy("chain", "s")
                       .agg(F.min("seq_id").alias("seq_id"), F.count(F.lit(1)).alias("_n")), "chains")
    dealt = once.repartition(4 * spark.sparkContext.defaultParallelism)      # little to read, much to do with each
    parts = [X.substitution_expand(dealt.where(F.col("chain") == ch).withColumnRenamed("s", col), syms, ch, keep=["_n"]) for ch, col in K.CHAINS]
    ck = F.conv(F.substring(F.md5("modified"), 1, 8), 16, 10).cast("long")
    e = parts[0].unionByName(parts[1]).groupBy("chain", "orig", "aa") \
        .agg(F.sum("_n").alias("n"), F.sum(ck * F.col("_n")).alias("checksum"))
    held = once.select("chain", "_n", F.explode(F.array_distinct(chars(F.lower("s")))).alias("orig")) \
        .groupBy("chain", "orig").agg(F.sum("_n").alias("n_seq"))
    return e.join(broadcast_small(held), ["chain", "orig"]).select("chain", "orig", "aa", "n", "n_seq", "checksum")


_WINDOW = """chain = 'b' AND grp = 'X' AND prob = 'P_X' AND position > 0.69E0 AND position < 0.706E0 AND aa = 't'"""


def window_deltas(spark, sf):
    """Raw deltas of one heat-map panel in an open range of positions, for one symbol."""
    d = raw_deltas(spark, sf, ["t"]).where((F.col("chain") == "b") & (F.col("grp") == "X") & (F.col("aa") == "t"))
    return d.where((F.col("position") > 0.69) & (F.col("position") < 0.706)) \
        .select("seq_id", "aa", "position", F.round("d_X", 9).alias("delta"))


@query("filter_position_window", with_views(f"""
SELECT seq_id, aa, position, round(d, 6) + 0.0E0 AS delta FROM scan_d WHERE {_WINDOW}""", "scan_d"))
def filter_position_window(spark, sf):
    return window_deltas(spark, sf).withColumn("delta", F.round("delta", 6) + F.lit(0.0))


@query("distinct_positions", with_views("""
SELECT DISTINCT position FROM positions WHERE chain = 'b' ORDER BY position""", "positions"))
def distinct_positions(spark, sf):
    from ..operators.positions import residue_positions
    return residue_positions(seq(spark, sf)).where(F.col("chain") == "b") \
        .select("position").distinct().orderBy("position")


@query("hist10", with_views(f"""
WITH f AS (SELECT round(d, 9) AS v FROM scan_d WHERE {_WINDOW}),
     st AS (SELECT min(v) AS lo, max(v) AS hi FROM f),
     c AS (SELECT CAST(least(floor((v - CASE WHEN hi = lo THEN lo - 0.5E0 ELSE lo END)
                   * (10.0E0 / (CASE WHEN hi = lo THEN hi + 0.5E0 ELSE hi END - CASE WHEN hi = lo THEN lo - 0.5E0 ELSE lo END))), 9) AS INT) AS bin
           FROM f, st)
SELECT g.bin, coalesce(n, 0) AS n
FROM (SELECT CAST(unnest(range(0, 10)) AS INT) AS bin) g
LEFT JOIN (SELECT bin, count(*) AS n FROM c GROUP BY bin) c ON g.bin = c.bin""", "scan_d"))
def hist10(spark, sf):
    from ..operators.positions import hist_fixed
    return hist_fixed(window_deltas(spark, sf), "delta", bins=10, stat="count")


@query("delta_pivot", with_views("""
SELECT chain, grp, prob, aa, round_even(position, 3) AS position, round(avg(v), 6) + 0.0E0 AS value
FROM (SELECT chain, grp, prob, aa, position, round(avg(d), 6) + 0.0E0 AS v
      FROM scan_d GROUP BY chain, grp, prob, aa, position) m
GROUP BY chain, grp, prob, aa, round_even(position, 3)""", "scan_d"))
def delta_pivot(spark, sf):
    """The whole heat map, in long form: every rounded position is a cell of its own."""
    return X.delta_cells(mean_delta(spark, sf)).withColumn("value", F.col("value") + F.lit(0.0))


@query("zip_rows", with_views("""
SELECT l.idx, l.seq_id, l.tags, r.seq_id AS pred_seq_id, r.pred
FROM (SELECT seq_id, tags, row_number() OVER (ORDER BY seq_id) AS idx FROM labsplit) l
JOIN (SELECT seq_id, row_number() OVER (ORDER BY seq_id) AS idx,
             string_agg(CAST(CAST(prob > 0.5E0 AS INT) AS VARCHAR), ',' ORDER BY label) AS pred
      FROM model_scores GROUP BY seq_id) r ON l.idx = r.idx""", "labsplit", "model_scores"))
def zip_rows(spark, sf):
    """Pair the rows of two tables by position (every pair with its predictions)."""
    from ..operators.kernels import row_index
    left = row_index(labelled_split(spark, sf).select("seq_id", "tags"), "seq_id")
    preds = M.predict(model_scores(spark, sf), 0.5) \
        .select(F.col("seq_id").alias("pred_seq_id"), arr_str("pred").alias("pred"))
    right = row_index(preds, "pred_seq_id")
    return left.join(right, "idx").select("idx", "seq_id", "tags", "pred_seq_id", "pred")
