"""DuckDB twins of rules that go from row to row: recursive queries that take the next row of every group at once."""

from __future__ import annotations

from lantern.functions import text

_KEYWORDS = f"list_filter(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '{text.KEYWORD_PATTERN}')), lambda w: NOT list_contains([{', '.join(repr(w) for w in dict.fromkeys(text.STOPWORDS))}], w))"
_ORDER = "coalesce(score, 0) DESC, item_id"


def keyword_clusters(items: str) -> str:
    """(ccir, cluster, place, item_id) of `items`, a query of ccir, item_id, score and title; the state is each cluster's words."""
    return f""", numbered AS MATERIALIZED (
  SELECT ccir, item_id, {_KEYWORDS} AS words, row_number() OVER (PARTITION BY ccir ORDER BY {_ORDER}) - 1 AS place FROM ({items})
), folded AS (
  SELECT DISTINCT ccir, -1::BIGINT AS place, ''::VARCHAR AS item_id, -1::BIGINT AS cluster, []::VARCHAR[][] AS state FROM numbered
  UNION ALL
  SELECT ccir, place, item_id, cluster,
    CASE WHEN cluster = len(state) THEN list_append(state, words) ELSE list_transform(state, lambda s, k: CASE WHEN k = cluster + 1 THEN list_distinct(list_concat(s, words)) ELSE s END) END
  FROM (SELECT n.*, f.state, coalesce(list_position(list_transform(f.state, lambda s: len(list_intersect(s, n.words)) >= 2), true) - 1, len(f.state))::BIGINT AS cluster
    FROM folded f JOIN numbered n ON n.ccir = f.ccir AND n.place = f.place + 1)
)
SELECT ccir, cluster::INTEGER AS cluster, place::INTEGER AS place, item_id FROM folded WHERE place >= 0"""


def centroid_clusters(items: str, threshold: float, part: str = "ccir") -> str:
    """(part, cluster, place, item_id) of `items`, a query of `part`, item_id, score and embedding; the state is each cluster's sum of vectors.

    The cosine of a sum is that of the mean. A cluster whose first item has no vector has no sum, and is never joined.
    """
    lengths = "list_inner_product(s, s) * list_inner_product(n.v, n.v)"
    distance = f"CASE WHEN s IS NULL OR n.v IS NULL THEN 9.0 WHEN {lengths} = 0 THEN 1.0 ELSE 1.0 - list_inner_product(s, n.v) / sqrt({lengths}) END"
    keys = [k.strip() for k in part.split(",")]
    same = " AND ".join(f"n.{k} = f.{k}" for k in keys)
    return f""", numbered AS MATERIALIZED (
  SELECT {part}, item_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY {part} ORDER BY {_ORDER}) - 1 AS place FROM ({items})
), folded AS (
  SELECT DISTINCT {part}, -1::BIGINT AS place, ''::VARCHAR AS item_id, -1::BIGINT AS cluster, []::DOUBLE[][] AS state FROM numbered
  UNION ALL
  SELECT {part}, place, item_id, cluster,
    CASE WHEN cluster = len(state) THEN list_append(state, v) ELSE list_transform(state, lambda s, k: CASE WHEN k = cluster + 1 THEN list_transform(v, lambda x, i: x + s[i]) ELSE s END) END
  FROM (SELECT *, CASE WHEN list_min(far) < {1.0 - threshold!r} THEN list_position(far, list_min(far)) - 1 ELSE len(state) END::BIGINT AS cluster
    FROM (SELECT n.*, f.state, list_transform(f.state, lambda s: {distance}) AS far FROM folded f JOIN numbered n ON {same} AND n.place = f.place + 1))
)
SELECT {part}, cluster::INTEGER AS cluster, place::INTEGER AS place, item_id FROM folded WHERE place >= 0"""


def claims(ttl: int) -> str:
    """(seq, dedupe_id, fired_at, fires) of all attempts; the state is the time of the last fire of each alert."""
    return f""", numbered AS MATERIALIZED (
  SELECT seq, dedupe_id, fired_at, row_number() OVER (PARTITION BY dedupe_id ORDER BY fired_at, seq) AS place FROM (SELECT *, left(sha256(item_id || '|' || cnr_tier), 16) AS dedupe_id FROM alert_claims)
), folded AS (
  SELECT seq, dedupe_id, fired_at, place, true AS fires, fired_at AS held FROM numbered WHERE place = 1
  UNION ALL
  SELECT n.seq, n.dedupe_id, n.fired_at, n.place, f.held <= n.fired_at - {ttl}, CASE WHEN f.held <= n.fired_at - {ttl} THEN n.fired_at ELSE f.held END
  FROM folded f JOIN numbered n ON n.dedupe_id = f.dedupe_id AND n.place = f.place + 1
)
SELECT seq, dedupe_id, fired_at, fires FROM folded"""


def throttled(tiers: tuple[tuple[str, int, int], ...]) -> str:
    """(seq, fired_at, tier) of all alerts, one after the other; the state is the times of those that were delivered lately."""
    longest = max(span for _, span, _ in tiers)
    full = " ".join(f"WHEN len(list_filter(held, lambda t: t > fired_at - {span})) >= {most} THEN '{name}'" for name, span, most in tiers)
    return f""", numbered AS MATERIALIZED (
  SELECT seq, fired_at, row_number() OVER (ORDER BY fired_at, seq) AS place FROM alert_attempts
), folded AS (
  SELECT 0::BIGINT AS place, NULL::BIGINT AS seq, NULL::BIGINT AS fired_at, NULL::VARCHAR AS tier, []::BIGINT[] AS held
  UNION ALL
  SELECT place, seq, fired_at, tier, CASE WHEN tier IS NULL THEN list_append(held, fired_at) ELSE held END
  FROM (SELECT *, CASE {full} END AS tier FROM (SELECT n.place, n.seq, n.fired_at, list_filter(f.held, lambda t: t > n.fired_at - {longest}) AS held FROM folded f JOIN numbered n ON n.place = f.place + 1))
)
SELECT seq, fired_at, tier FROM folded WHERE place > 0"""
