"""Stage A queries: scan, union, labels, split, balance, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import sampling as S
from ..sources import tables as T
from .registry import query, with_views


def seq(spark, sf):
    return T.sequences(spark, sf)


def labelled(spark, sf):
    return T.labelled(spark, sf)


_BOUNDARY: dict[str, str | None] = {}


def split_seq(spark, sf):
    """The pair table with its seeded 70/30 split. The split boundary is a property of
    the materialized pair table, so it is found once (two small passes over the order
    keys) and kept with that table's path."""
    path = T.sequence_table(spark, sf)
    s = T.sequences(spark, sf)
    if path not in _BOUNDARY:
        _BOUNDARY[path] = S.split_boundary(s)
    return S.apply_split(s, _BOUNDARY[path])


def labelled_split(spark, sf):
    """The split pairs of labelled documents."""
    return split_seq(spark, sf).where("tags IS NOT NULL")


def arr_str(c):
    """Array column -> 'a,b,c' (arrays are compared as joined strings)."""
    return F.array_join(F.col(c).cast("array<string>"), ",")


@query("class_counts", with_views("""
SELECT tags, count(*) AS n FROM lab GROUP BY tags ORDER BY n DESC, tags""", "lab"))
def class_counts(spark, sf):
    return labelled(spark, sf).groupBy("tags").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "tags")


@query("row_count", with_views("SELECT count(*) AS n FROM seq", "seq"))
def row_count(spark, sf):
    return seq(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@query("min_class_size", with_views("""
SELECT min(n) AS min_n FROM (SELECT tags, count(*) AS n FROM lab GROUP BY tags) c""", "lab"))
def min_class_size(spark, sf):
    c = labelled(spark, sf).groupBy("tags").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.min("n").alias("min_n"))


@query("distinct_labels", with_views("""
SELECT tags AS label, count(*) OVER () AS n_labels FROM (SELECT DISTINCT tags FROM lab) d""", "lab"))
def distinct_labels(spark, sf):
    d = labelled(spark, sf).select(F.col("tags").alias("label")).distinct()
    # the distinct set is small (classes): its count is a window over that set only
    from pyspark.sql import Window
    return d.select("label", F.count(F.lit(1)).over(Window.partitionBy()).alias("n_labels"))


@query("flags_inclusive", with_views("""
SELECT seq_id, tags,
       CAST(list_contains(string_split(tags, '|'), 'Q') AS INT) AS flag_Q,
       CAST(list_contains(string_split(tags, '|'), 'T') AS INT) AS flag_T,
       CAST(list_contains(string_split(tags, '|'), 'X') AS INT) AS flag_X,
       CASE WHEN tags = 'negative' THEN 1 ELSE 0 END AS negative,
       CASE WHEN tags = 'negative' THEN 0 ELSE 1 END AS activated_any
FROM lab""", "lab"))
def flags_inclusive(spark, sf):
    return L.flags_inclusive(labelled(spark, sf).select("seq_id", "tags"))


@query("flags_exclusive", with_views("""
SELECT seq_id, tags,
       CAST(tags = 'Q' AS INT) AS flag_Q, CAST(tags = 'T' AS INT) AS flag_T,
       CAST(tags = 'X' AS INT) AS flag_X,
       CASE WHEN tags = 'negative' THEN 1 ELSE 0 END AS negative,
       CASE WHEN tags = 'negative' THEN 0 ELSE 1 END AS activated_any
FROM lab""", "lab"))
def flags_exclusive(spark, sf):
    return L.flags_exclusive(labelled(spark, sf).select("seq_id", "tags"))


@query("exact_group", with_views("""
SELECT seq_id, tags, CASE WHEN tags IN ('Q', 'T', 'X') THEN tags ELSE 'negative' END AS grp
FROM lab""", "lab"))
def exact_group(spark, sf):
    return labelled(spark, sf).select("seq_id", "tags", L.exact_group("tags").alias("grp"))


@query("union_sources", with_views("""
SELECT seq_id, chain_a, chain_b, tags, 'active' AS source FROM lab WHERE tags <> 'negative'
UNION ALL
SELECT seq_id, chain_a, chain_b, tags, 'negative' AS source FROM lab WHERE tags = 'negative'""",
                                   "lab"))
def union_sources(spark, sf):
    s = labelled(spark, sf).select("seq_id", "chain_a", "chain_b", "tags")
    active = s.where(F.col("tags") != "negative").withColumn("source", F.lit("active"))
    negative = s.where(F.col("tags") == "negative").withColumn("source", F.lit("negative"))
    return active.unionByName(negative)


@query("filter_eq", with_views("""
SELECT seq_id, chain_a, chain_b FROM lab WHERE tags = 'Q'""", "lab"))
def filter_eq(spark, sf):
    return labelled(spark, sf).where(F.col("tags") == "Q").select("seq_id", "chain_a", "chain_b")


@query("split_exact", with_views("SELECT seq_id, split FROM split", "split"))
def split_exact(spark, sf):
    return split_seq(spark, sf).select("seq_id", "split")


@query("split_select", with_views("""
SELECT seq_id, chain_a, chain_b, tags FROM labsplit WHERE split = 'test'""", "labsplit"))
def split_select(spark, sf):
    return labelled_split(spark, sf).where(F.col("split") == "test") \
        .select("seq_id", "chain_a", "chain_b", "tags")


@query("label_codes", with_views("""
SELECT tags AS label, CAST(row_number() OVER (ORDER BY tags) - 1 AS INT) AS code
FROM (SELECT DISTINCT tags FROM labsplit WHERE split = 'train') d""", "labsplit"))
def label_codes(spark, sf):
    train = labelled_split(spark, sf).where(F.col("split") == "train")
    return L.fit_label_codes(train).withColumn("code", F.col("code").cast("int"))


@query("label_encode", with_views("""
WITH codes AS (SELECT tags AS label, CAST(row_number() OVER (ORDER BY tags) - 1 AS INT) AS code
               FROM (SELECT DISTINCT tags FROM labsplit WHERE split = 'train') d)
SELECT s.seq_id, s.split, s.tags, c.code AS num_label
FROM labsplit s JOIN codes c ON s.tags = c.label""", "labsplit"))
def label_encode(spark, sf):
    sp = labelled_split(spark, sf)
    codes = L.fit_label_codes(sp.where(F.col("split") == "train"))
    return L.label_encode(sp.select("seq_id", "split", "tags"), codes)


@query("one_hot", with_views("""
WITH codes AS (SELECT tags AS label, CAST(row_number() OVER (ORDER BY tags) - 1 AS INT) AS code
               FROM (SELECT DISTINCT tags FROM labsplit WHERE split = 'train') d),
     k AS (SELECT count(*) AS k FROM codes)
SELECT s.seq_id, c.code AS num_label,
       array_to_string(list_transform(range(0, (SELECT k FROM k)),
                                      lambda i: CAST(i = c.code AS INT)), ',') AS one_hot
FROM labsplit s JOIN codes c ON s.tags = c.label""", "labsplit"))
def one_hot(spark, sf):
    sp = labelled_split(spark, sf)
    codes = L.fit_label_codes(sp.where(F.col("split") == "train"))
    k = codes.count()  # number of classes (a scalar that sets the vector width)
    enc = L.label_encode(sp.select("seq_id", "tags"), codes)
    return L.one_hot(enc, "num_label", k).select("seq_id", "num_label",
                                                  arr_str("one_hot").alias("one_hot"))


@query("target_vector", with_views("""
SELECT seq_id,
       concat_ws(',', CAST(list_contains(string_split(tags, '|'), 'Q') AS INT),
                      CAST(list_contains(string_split(tags, '|'), 'T') AS INT),
                      CAST(list_contains(string_split(tags, '|'), 'X') AS INT),
                      CASE WHEN tags = 'negative' THEN 1 ELSE 0 END) AS target
FROM lab""", "lab"))
def target_vector(spark, sf):
    f = L.flags_inclusive(labelled(spark, sf).select("seq_id", "tags"))
    return L.target_vector(f, with_negative=True).select("seq_id", arr_str("target").alias("target"))


@query("single_target", with_views("""
SELECT seq_id, 'activated_any' AS label, CASE WHEN tags = 'negative' THEN 0 ELSE 1 END AS target
FROM lab""", "lab"))
def single_target(spark, sf):
    f = L.flags_inclusive(labelled(spark, sf).select("seq_id", "tags"))
    return L.single_target(f, "activated_any").select("seq_id", "label", "target")


@query("balanced_sample", with_views("""
WITH f AS (SELECT seq_id, h, CAST(list_contains(string_split(tags, '|'), 'T') AS INT) AS flag_T
           FROM labsplit WHERE split = 'train'),
     r AS (SELECT *, row_number() OVER (PARTITION BY flag_T ORDER BY h) AS i,
                  count(*) OVER (PARTITION BY flag_T) AS n FROM f)
SELECT seq_id, flag_T FROM r WHERE i <= (SELECT min(n) FROM r)""", "labsplit"))
def balanced_sample(spark, sf):
    train = labelled_split(spark, sf).where(F.col("split") == "train")
    f = L.flags_inclusive(train.select("seq_id", "tags", "h"))
    return S.balanced_sample(f, "flag_T").select("seq_id", "flag_T")


@query("batch_assign", with_views("""
SELECT seq_id, CAST(floor((row_number() OVER (ORDER BY h) - 1) / 32) AS BIGINT) AS batch_id
FROM split WHERE split = 'train'""", "split"))
def batch_assign(spark, sf):
    train = split_seq(spark, sf).where(F.col("split") == "train")
    return S.batch_assign(train, 32).select("seq_id", "batch_id")


@query("seeded_shuffle", with_views("""
SELECT seq_id, row_number() OVER (ORDER BY h) AS shuffle_pos FROM seq""", "seq"))
def seeded_shuffle(spark, sf):
    return S.seeded_shuffle(seq(spark, sf)).select("seq_id", "shuffle_pos")
