"""Registry of named queries: a Spark builder and (when SQL can say it) a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


# DuckDB text of the derived views (same definitions as tessera.sources.tables).
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "seq": ((), """
  SELECT doc_id * 1000000 + k AS seq_id, doc_id,
         words[2 * k + 1] AS chain_a, coalesce(words[2 * k + 2], '') AS chain_b,
         CASE WHEN is_q IS NOT NULL THEN
           coalesce(nullif(concat_ws('|', CASE WHEN is_q = 1 THEN 'Q' END,
                                          CASE WHEN is_t = 1 THEN 'T' END,
                                          CASE WHEN is_x = 1 THEN 'X' END), ''), 'negative') END AS tags,
         is_q, is_t, is_x,
         md5(concat('1964-', doc_id * 1000000 + k)) AS h
  FROM (SELECT *, unnest(range(0, CAST(ceil(len(words) / 2) AS BIGINT))) AS k
        FROM (SELECT d.doc_id,
                     CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 1 ELSE 0 END AS is_q,
                     CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 1 ELSE 0 END AS is_t,
                     CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.lang <> 'en' THEN 1 ELSE 0 END AS is_x,
                     regexp_extract_all(lower(d.text), '[\\p{L}\\p{M}]+') AS words
              FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) w) p"""),
    "lab": (("seq",), "SELECT * FROM seq WHERE tags IS NOT NULL"),
    "labsplit": (("split",), "SELECT * FROM split WHERE tags IS NOT NULL"),
    "split": (("seq",), """
  SELECT *, CASE WHEN row_number() OVER (ORDER BY h) <= ceil(0.7E0 * count(*) OVER ())
                 THEN 'train' ELSE 'test' END AS split
  FROM seq"""),
    "scored": (("lab",), """
  SELECT seq_id, label, target,
         0.6E0 * CAST(CAST('0x' || substr(md5(concat(label, '-', seq_id)), 1, 6) AS BIGINT) AS DOUBLE)
           / 16777215.0E0 + 0.4E0 * target AS prob
  FROM (SELECT seq_id, 'Q' AS label, is_q AS target FROM lab UNION ALL
        SELECT seq_id, 'T', is_t FROM lab UNION ALL
        SELECT seq_id, 'X', is_x FROM lab) z"""),
    "runs": ((), """
  SELECT user_id AS run, event_type AS tag, event_id AS step, value / 100 AS value FROM events"""),
    "chars_long": (("seq",), """
  SELECT seq_id, tags, 'a' AS chain, chain_a AS s FROM seq UNION ALL
  SELECT seq_id, tags, 'b' AS chain, chain_b AS s FROM seq"""),
    "positions": (("chars_long",), """
  SELECT seq_id, tags, chain, CAST(i - 1 AS BIGINT) AS idx, CAST(length(s) AS BIGINT) AS len,
         lower(substr(s, i, 1)) AS aa, (i - 1) / length(s) AS position
  FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM chars_long WHERE length(s) > 0) t"""),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEW_SQL[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEW_SQL[n][1]}\n)" for n in order)
    b = body.strip()
    if b[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{b}"


def add_view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEW_SQL[name] = (deps, sql)
