"""Stage B queries: corpus, word-level vocabulary, encode / pad / mask, look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import chars
from ..operators import tokens as K
from ..session import materialize, scratch_path
from ..sources import files as FS
from .q_labels import arr_str, seq, split_seq
from .registry import add_view, query, with_views

add_view("train_tokens", ("split",), """
  SELECT seq_id, chain, CAST(i - 1 AS BIGINT) AS pos, lower(substr(s, i, 1)) AS token
  FROM (SELECT seq_id, chain, s, unnest(range(1, length(s) + 1)) AS i
        FROM (SELECT seq_id, 'a' AS chain, chain_a AS s FROM split WHERE split = 'train'
              UNION ALL
              SELECT seq_id, 'b' AS chain, chain_b AS s FROM split WHERE split = 'train') c) t""")
add_view("vocab", ("train_tokens",), """
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 4 AS INT) AS id
  FROM (SELECT token, count(*) AS n FROM train_tokens GROUP BY token) tc
  UNION ALL
  SELECT * FROM (VALUES ('[UNK]', 0), ('[CLS]', 1), ('[SEP]', 2), ('[PAD]', 3), ('[MASK]', 4)) v(token, id)""")
add_view("all_tokens", ("seq",), """
  SELECT seq_id, chain, CAST(i - 1 AS BIGINT) AS pos, lower(substr(s, i, 1)) AS token
  FROM (SELECT seq_id, chain, s, unnest(range(1, length(s) + 1)) AS i
        FROM (SELECT seq_id, 'a' AS chain, chain_a AS s FROM seq
              UNION ALL SELECT seq_id, 'b' AS chain, chain_b AS s FROM seq) c) t""")
# ids per row and chain as lists (empty chains give an empty list)
add_view("vocab_map", ("vocab",), "SELECT map(list(token), list(id)) AS m FROM vocab")
add_view("encoded", ("vocab_map", "split"), """
  SELECT seq_id, split,
         CASE WHEN chain_a = '' THEN [] ELSE list_transform(string_split(lower(chain_a), ''), lambda t: m[t]) END AS ids_a,
         CASE WHEN chain_b = '' THEN [] ELSE list_transform(string_split(lower(chain_b), ''), lambda t: m[t]) END AS ids_b
  FROM split, vocab_map""")
add_view("lens", ("split",), """
  SELECT split, greatest(max(length(chain_a)), max(length(chain_b))) AS max_len
  FROM split GROUP BY split""")


def train_rows(spark, sf):
    return split_seq(spark, sf).where(F.col("split") == "train")


def vocab_df(spark, sf, once=None):
    """(token, id) of the train rows (``once``: their counted chains, if known)."""
    return materialize(K.fit_wl_vocab(spark, K.token_counts(train_rows(spark, sf), once)), "vocab")


def vocab(spark, sf) -> dict[str, int]:
    return K.vocab_dict(vocab_df(spark, sf))


def written_corpus(spark, sf, spaced):
    """The corpus lines of the train rows as text files, read back, with their counts."""
    path = scratch_path(spark, "corpus")
    FS.write_corpus(K.corpus_lines(train_rows(spark, sf), spaced_chars=spaced), path)
    return FS.read_corpus(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_raw", with_views("""
SELECT line, count(*) AS n FROM (
SELECT chain_a AS line FROM split WHERE split = 'train' UNION ALL
SELECT chain_b AS line FROM split WHERE split = 'train') t GROUP BY line""", "split"))
def corpus_raw(spark, sf):
    return written_corpus(spark, sf, spaced=False)


@query("corpus_spaced", with_views("""
SELECT line, count(*) AS n FROM (
SELECT array_to_string(string_split(chain_a, ''), ' ') AS line FROM split WHERE split = 'train' UNION ALL
SELECT array_to_string(string_split(chain_b, ''), ' ') AS line FROM split WHERE split = 'train') t GROUP BY line""", "split"))
def corpus_spaced(spark, sf):
    return written_corpus(spark, sf, spaced=True)


@query("chars", with_views("""
SELECT seq_id, CAST(length(chain_a) AS INT) AS n_a,
       array_to_string(string_split(chain_a, ''), ',') AS chars_a, CAST(length(chain_b) AS INT) AS n_b,
       array_to_string(string_split(chain_b, ''), ',') AS chars_b FROM seq""", "seq"))
def chars_q(spark, sf):
    both = [x for ch, col in K.CHAINS for x in (F.size(chars(col)).alias(f"n_{ch}"),
                                                F.array_join(chars(col), ",").alias(f"chars_{ch}"))]
    return seq(spark, sf).select("seq_id", *both)


@query("token_counts", with_views("""
SELECT token, count(*) AS n FROM train_tokens GROUP BY token""", "train_tokens"))
def token_counts(spark, sf):
    return K.token_counts(train_rows(spark, sf))


@query("wl_vocab", with_views("SELECT token, id FROM vocab", "vocab"))
def wl_vocab(spark, sf):
    return vocab_df(spark, sf)


@query("vocab_symbols", with_views("""
SELECT token, id FROM vocab WHERE NOT contains(token, '[')""", "vocab"))
def vocab_symbols(spark, sf):
    return vocab_df(spark, sf).where(~F.col("token").contains("["))


@query("encode_wl", with_views("""
SELECT seq_id, array_to_string(ids_a, ',') AS ids_a, array_to_string(ids_b, ',') AS ids_b
FROM encoded""", "encoded"))
def encode_wl(spark, sf):
    e = K.encode_ids(seq(spark, sf).select("seq_id", "chain_a", "chain_b"), vocab_df(spark, sf))
    return e.select("seq_id", arr_str("ids_a").alias("ids_a"), arr_str("ids_b").alias("ids_b"))


@query("encode_join", with_views("""
SELECT t.seq_id, t.chain, t.pos, t.token, v.id FROM all_tokens t LEFT JOIN vocab v
ON t.token = v.token""", "all_tokens", "vocab"))
def encode_join(spark, sf):
    return K.encode_join(seq(spark, sf), vocab_df(spark, sf)) \
        .select("seq_id", "chain", F.col("pos").cast("long").alias("pos"), "token", "id")


@query("decode_join", with_views("""
SELECT u.seq_id, u.chain, u.pos, v.token
FROM (SELECT seq_id, 'a' AS chain, unnest(range(len(ids_a))) AS pos, unnest(ids_a) AS id FROM encoded UNION ALL
      SELECT seq_id, 'b' AS chain, unnest(range(len(ids_b))) AS pos, unnest(ids_b) AS id FROM encoded) u
LEFT JOIN vocab v ON u.id = v.id""", "encoded", "vocab"))
def decode_join(spark, sf):
    v = vocab_df(spark, sf)
    ids = K.encode_join(seq(spark, sf), v).select("seq_id", "chain", F.col("pos").cast("long").alias("pos"), "id")
    return K.decode_join(ids, v).select("seq_id", "chain", "pos", "token")


@query("max_len", with_views("""
SELECT split, CAST(max(length(chain_a)) AS INT) AS max_len_a,
       CAST(max(length(chain_b)) AS INT) AS max_len_b,
       CAST(greatest(max(length(chain_a)), max(length(chain_b))) AS INT) AS max_len
FROM split GROUP BY split""", "split"))
def max_len_q(spark, sf):
    return K.max_len(split_seq(spark, sf), ["split"])


def _padded(ch: str) -> str:
    return (f"array_to_string(list_concat(e.ids_{ch}, list_transform(range(greatest(0, l.max_len - len(e.ids_{ch}))), "
            f"lambda x: 0)), ',') AS ids_{ch}")


def _masked(ch: str) -> str:
    return (f"array_to_string(list_concat(list_transform(e.ids_{ch}, lambda x: 1), "
            f"list_transform(range(greatest(0, l.max_len - len(e.ids_{ch}))), lambda x: 0)), ',') AS mask_{ch}")


_PAD_SQL = "SELECT e.seq_id, e.split, {cols} FROM encoded e JOIN lens l ON e.split = l.split"


@query("pad_ids", with_views(_PAD_SQL.format(cols=f"{_padded('a')}, {_padded('b')}"), "encoded", "lens"))
def pad_ids(spark, sf):
    e = K.encode_padded(split_seq(spark, sf).select("seq_id", "split", "chain_a", "chain_b"), vocab_df(spark, sf))
    return e.select("seq_id", "split", arr_str("ids_a").alias("ids_a"), arr_str("ids_b").alias("ids_b"))


@query("attention_mask", with_views(_PAD_SQL.format(
    cols=", ".join([_padded("a"), _masked("a"), _padded("b"), _masked("b")])), "encoded", "lens"))
def attention_mask_q(spark, sf):
    e = K.encode_padded(split_seq(spark, sf).select("seq_id", "split", "chain_a", "chain_b"), vocab_df(spark, sf))
    return e.select("seq_id", "split", *[arr_str(c).alias(c) for c in ("ids_a", "mask_a", "ids_b", "mask_b")])


@query("pair_concat", with_views("""
SELECT e.seq_id,
       array_to_string(list_concat(
         list_concat(e.ids_a, list_transform(range(greatest(0, l.max_len - len(e.ids_a))), lambda x: 0)),
         list_concat(e.ids_b, list_transform(range(greatest(0, l.max_len - len(e.ids_b))), lambda x: 0))),
         ',') AS ids_pair
FROM encoded e JOIN lens l ON e.split = l.split""", "encoded", "lens"))
def pair_concat(spark, sf):
    e = K.encode_padded(split_seq(spark, sf).select("seq_id", "split", "chain_a", "chain_b"), vocab_df(spark, sf))
    return e.select("seq_id", F.array_join(F.concat("ids_a", "ids_b").cast("array<string>"), ",")
                    .alias("ids_pair"))


@query("encode_truncate", with_views("""
SELECT seq_id, array_to_string(list_concat(list_concat(ids_a, ids_b),
         list_transform(range((SELECT max(len(ids_a) + len(ids_b)) FROM encoded) - len(ids_a) - len(ids_b)), lambda x: 0)),
         ',') AS ids FROM encoded""", "encoded"))
def encode_truncate(spark, sf):
    """Both chains as one string, padded to the longest pair; ``truncate`` is off unless asked for."""
    e = K.encode_combined(seq(spark, sf).select("seq_id", "chain_a", "chain_b"), vocab_df(spark, sf))
    return e.select("seq_id", arr_str("ids").alias("ids"))
