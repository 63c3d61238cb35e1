"""The queries of this subpackage: thin digests over the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, in two increments: the second meets blobs that the ledger has from the first."""
    from . import secret_scan as m

    d = table(spark, sf_dir, "documents")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    found, _ = m.scan_increments([d.where(turn == i) for i in range(2)], path="doc_id")
    return m.digest(found).withColumnRenamed("path", "doc_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing as m

    return m.pack(m.pieces(table(spark, sf_dir, "documents")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join as m

    return m.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text as m

    return m.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality as m

    return m.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup as m

    return m.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media as m

    return m.stored_texts(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts as m

    return m.count_tokens(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup as m

    out = m.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing as m

    return m.mix(table(spark, sf_dir, "documents"), weights=m.targets(spark)).drop("_t")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x20\x09-\x0D]+"

#: All pairs by shared shingle, then everything that each document reaches.
_OP3 = f"""WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_GAP}'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM w)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
  r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""

#: The least runs of ten words, all of up to ten lines, and for each content its first place.
_OP9 = f"""WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
  m AS (SELECT doc_id, text, raw, list_filter(range(1, len(raw) + 1), lambda i: regexp_matches(raw[i], '[^\\x20\\x09-\\x0D]')) AS solid FROM d),
  l AS (SELECT *, list_transform(solid, lambda i: regexp_replace(raw[i], '^{_GAP}|{_GAP}$', '', 'g')) AS s FROM m),
  c AS (SELECT *, list_transform(s, lambda x: len(string_split_regex(x, '{_GAP}'))) AS w FROM l),
  a AS (SELECT doc_id, s, w, unnest(range(1, len(s) + 1)) AS a FROM c),
  ab AS (SELECT *, unnest(range(a, least(a + 10, len(s) + 1))) AS b FROM a),
  run AS (SELECT doc_id, a, b, array_to_string(s[a:b], chr(10)) AS body FROM ab WHERE list_sum(w[a:b]) >= 10 AND (list_sum(w[a:b]) - w[a] < 10 OR list_sum(w[a:b]) - w[b] < 10)),
  later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS i FROM run) WHERE i > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS k FROM later),
  g AS (SELECT doc_id, list(k) AS ks, count(*) AS n, count(*) FILTER (NOT follows) AS runs FROM (SELECT doc_id, k, coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k) = k - 1, false) AS follows FROM gone) GROUP BY doc_id),
  k AS (SELECT c.doc_id, c.text, len(s) AS n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.runs, 0) AS n_runs, raw, list_transform(coalesce(ks, []), lambda k: solid[k]) AS drop FROM c LEFT JOIN g ON c.doc_id = g.doc_id),
  t AS (SELECT *, CASE WHEN n_removed = 0 THEN text WHEN n_removed = n_lines THEN '' ELSE array_to_string(list_transform(list_filter(range(1, len(raw) + 1), lambda i: NOT list_contains(drop, i)), lambda i: raw[i]), chr(10)) END AS kept FROM k)
  SELECT doc_id, n_lines, n_removed, n_runs, length(kept) AS n_chars, sha256(kept) AS kept_sha256 FROM t"""


#: Every window of 400 bytes by its hash; the starts of those that occur again, joined to spans.
_OP6 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
  w AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 399, 0))) AS p FROM d)),
  r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
  s AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM w JOIN r USING (k)),
  i AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM s),
  sp AS (SELECT doc_id, g, min(p) AS b, max(p) + 400 AS e FROM i GROUP BY doc_id, g),
  x AS (SELECT doc_id, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es, CAST(sum(e - b) AS BIGINT) AS removed, count(*) AS spans FROM sp GROUP BY doc_id)
  SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN bs IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(bs) + 1), lambda j: substr(h, 2 * coalesce(es[j], 0) + 1, 2 * (coalesce(bs[j + 1], n) - coalesce(es[j], 0)))), '') END)) AS kept_sha256
  FROM d LEFT JOIN x ON d.doc_id = x.doc_id"""


def _filled(depth: int) -> str:
    """A level's budgets: children by capacity for their weight are full up to some place, those behind it share what is left."""
    keys = ["domain", "lang", "source"][:depth]
    outer, cols = keys[:-1], ", ".join(keys)
    part = f"PARTITION BY {', '.join(outer)} " if outer else ""
    own = f"PARTITION BY {', '.join(f'l.{k}' for k in outer) or '1'} ORDER BY cap / w, {', '.join(f'l.{k} NULLS FIRST' for k in keys)} ROWS BETWEEN"
    on = " AND ".join(f"l.{k} IS NOT DISTINCT FROM p.{k}" for k in outer)
    pot = f"f{depth - 1} p ON {on}" if outer else "(SELECT CAST(sum(tokens) AS DOUBLE) AS budget FROM leaf) p ON true"
    mine = " AND ".join([f"c.{k} IS NOT DISTINCT FROM wt.{k}" for k in keys] + [f"wt.{keys[-1]} IS NOT NULL"] + [f"wt.{k} IS NULL" for k in ["domain", "lang", "source"][depth:]])
    return f"""
  c{depth} AS (SELECT {cols}, CAST(sum(2 * tokens) AS BIGINT) AS cap FROM leaf GROUP BY {cols}),
  l{depth} AS (SELECT {', '.join(f'c.{k}' for k in keys)}, cap, coalesce(wt.weight, 1.0) AS w FROM c{depth} c LEFT JOIN wt ON {mine}),
  m{depth} AS (SELECT *, greatest(pot - done, 0) / open AS mark FROM (SELECT {', '.join(f'l.{k}' for k in keys)}, cap, w, p.budget AS pot,
    CAST(coalesce(sum(cap) OVER ({own} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS done,
    sum(w) OVER ({own} CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM l{depth} l JOIN {pot})),
  f{depth} AS (SELECT {cols}, CASE WHEN cap <= mark * w THEN CAST(cap AS DOUBLE) ELSE least(min(CASE WHEN cap > mark * w THEN {{'c': cap / w, 'm': mark}} END) OVER ({part.strip()}).m * w, CAST(cap AS DOUBLE)) END AS budget FROM m{depth}),"""


def _weights() -> str:
    from .mixing import TARGETS

    shown = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)"
    return f"wt(domain, lang, source, weight) AS (VALUES {', '.join('(' + ', '.join(map(shown, row)) + ')' for row in TARGETS)})"


#: The same levels, and the streams by their running sums over the whole leaf.
_OP10 = f"""WITH t AS (
    SELECT doc_id, lang, source, CASE WHEN regexp_full_match(coalesce(source, ''), 'src[0-9]{{1,9}}') THEN 'domain' || (CAST(source[4:] AS INTEGER) % 4) ELSE 'other' END AS domain,
      CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{_GAP}'), lambda x: x <> '')) AS BIGINT) AS n_tokens, md5(text) AS t FROM documents),
  {_weights()},
  leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM t GROUP BY 1, 2, 3),{_filled(1)}{_filled(2)}{_filled(3)}
  b AS (SELECT f.domain, f.lang, f.source, CAST(floor(budget + 1e-6) AS BIGINT) AS leaf_budget, CAST(tokens AS BIGINT) AS tokens FROM f3 f JOIN leaf ON f.domain = leaf.domain AND f.lang IS NOT DISTINCT FROM leaf.lang AND f.source IS NOT DISTINCT FROM leaf.source),
  e AS (SELECT *, CASE WHEN tokens > 0 THEN leaf_budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN leaf_budget % tokens ELSE 0 END AS rest FROM b),
  o AS (SELECT t.*, leaf_budget, whole, rest, CAST('0x' || substr(md5(concat_ws('|', doc_id, t, '17', whole)), 1, 15) AS BIGINT) AS ord
    FROM t JOIN e ON t.domain = e.domain AND t.lang IS NOT DISTINCT FROM e.lang AND t.source IS NOT DISTINCT FROM e.source),
  r AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o)
  SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, whole + CASE WHEN ahead < rest THEN 1 ELSE 0 END AS copies FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": _OP10, "op6_suffix_dedup": _OP6, "op3_jaccard_join": _OP3, "op9_line_dedup": _OP9}
