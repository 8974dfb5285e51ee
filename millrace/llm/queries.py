"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, bwt_merge, covering_simhash, decontaminate, matroska, packing, patched_frames, repeated_phrases, secret_ledger, toxicity_neighbours
from .common import scratch, table


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries, by source: the second run scans only what the first one's ledger has not seen."""
    docs, ledger = table(spark, sf_dir, "documents"), scratch(spark, "secret-ledger")
    early = F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 2 == 0
    secret_ledger.scan_unseen(docs.where(early), ledger)
    findings, _ = secret_ledger.scan_versions(docs, ledger)
    return secret_ledger.digest(findings)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases.dedup(table(spark, sf_dir, "documents"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(table(spark, sf_dir, "documents"))


def op5_patched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patched_frames.read(patched_frames.write(table(spark, sf_dir, "documents")))


def op6_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(table(spark, sf_dir, "documents"))


def op7_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_merge.dedup(table(spark, sf_dir, "documents"))


def op8_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity_neighbours.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity_neighbours.score(docs, index)
    return scored.select("doc_id", toxicity_neighbours.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_ledger, op2_decontamination, op3_repeated_phrases, op4_matroska, op5_patched_frames, op6_token_attribution, op7_bwt_merge, op8_covering_simhash, op9_toxicity, op10_best_fit_packing)}

_SHINGLES = r"""
  {name}_w AS (SELECT {id} AS id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w FROM {table} WHERE {id} IS NOT NULL),
  {name}_s AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM {name}_w WHERE len(w) > 0))"""

#: The words of a keyword in either case, ASCII letters alone.
_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_KINDS = (
    ("assign", "(?:" + "|".join(map(_EITHER, ("password", "passwd", "secret", "token", "api"))).replace(_EITHER("api"), _EITHER("api") + "_?" + _EITHER("key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
)
#: Matches lie between the pieces that splitting by the pattern leaves, so lengths give their places.
_SPANS = """
  {kind}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, regexp_split_to_array(t, '{pattern}') AS p FROM d),
  {kind}_e AS (SELECT doc_id, i, length(m) AS n, length(g) AS k, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(g) AS g, unnest(p[1 : len(m)]) AS p FROM {kind}_m)),
  {kind}_s AS (SELECT doc_id, {rank} AS r, '{kind}' AS kind, (e - n)::BIGINT AS a, e::BIGINT AS b FROM {kind}_e WHERE k >= {least})"""

_SECRETS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)," + ",".join(_SPANS.format(kind=k, pattern=p, group=g, least=n, rank=i) for i, (k, p, g, n) in enumerate(_KINDS)) + """,
  s AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s),
  o AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)"""

_PHRASES = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
  late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
  gone AS (SELECT DISTINCT doc_id, i + j AS i FROM late, range(20) AS r(j)),
  word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
  kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Bytes as pairs of hexadecimal digits.
_BYTES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
  s AS (SELECT doc_id, i, md5(substr(t, 2 * i + 1, 100)) AS h FROM (SELECT doc_id, t, unnest(range(length(t) // 2 - 49)) AS i FROM d)),
  late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM s) WHERE doc_id > least),
  edge AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 50 AS new FROM late),
  run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edge) GROUP BY doc_id, k),
  part AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
  gone AS (SELECT doc_id, count(*) AS n, sum(b - a) AS bytes, max(b) AS last, string_agg(substr(t, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(t) // 2 AS n_bytes, coalesce(bytes, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(t, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)"""

ORACLES = {
    "op1_secret_ledger": _SECRETS,
    "op3_repeated_phrases": _PHRASES,
    "op7_bwt_merge": _BYTES,
    "op2_decontamination": "WITH" + _SHINGLES.format(name="d", id="doc_id", table="documents") + "," + _SHINGLES.format(name="b", id="item_id", table="benchmark") + """,
  n AS (SELECT id, count(*) AS n FROM b_s GROUP BY id)
SELECT d_s.id AS doc_id, b_s.id AS item_id, count(*) AS n_shared, any_value(n.n) AS n_item, count(*) / any_value(n.n) AS containment
FROM d_s JOIN b_s ON d_s.s = b_s.s JOIN n ON n.id = b_s.id GROUP BY ALL HAVING count(*) >= any_value(n.n) * 0.8 - 1e-9""",
}
