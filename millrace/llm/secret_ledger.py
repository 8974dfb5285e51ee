"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every document is addressed by the SHA-256 of its text. The ledger holds one row for each
(blob, rule version) that was ever scanned, findings or none; a run scans only pairs that the ledger lacks, appends
them, and joins the findings back to every path that holds the blob.

Defined cases: a null text is the empty blob; null ids are kept and match each other; copies share one scan and each get
its findings; a row that is repeated is scanned each time, and the ledger has it once; spans that start together are listed
by the order of the rules; very long texts are scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored, text_digest, texts, unused

#: kind, pattern, group whose length counts, least length. Kinds in the order in which ties are listed.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: One linear-time pass over a batch; every text with a finding of RULES matches it.
SIEVE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"""

SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rule_version string, spans {SPANS}"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """Spans in code points by start, then by the rules' order; of each kind leftmost and non-overlapping."""
    out = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text, re.ASCII):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(out)]


def _scan(batches: Iterator[pa.RecordBatch], rules, sieve) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        hit = pc.match_substring_regex(batch.column("text"), sieve) if sieve else None
        spans = [[] if hit is not None and not h else find(t.as_py(), rules) for h, t in zip(hit.to_pylist() if hit is not None else [True] * batch.num_rows, batch.column("text"))]
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, pa.list_(item))], ["blob", "spans"])


def scan_unseen(versions: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sieve: str | None = SIEVE) -> DataFrame:
    """Scans the blobs of `versions` that the ledger has not seen under these rules, appends them and gives the ledger."""
    spark, version = versions.sparkSession, rule_version(rules)
    docs = texts(versions, id_col, text_col).withColumn("blob", F.unhex(F.sha2("text", 256)))
    # The narrow side of the join is hashed, so that texts are dealt out once and never sorted.
    unseen = docs.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if _exists(spark, ledger_path):
        seen = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version") == version)
        unseen = unseen.join(seen.select("blob"), "blob", "left_anti")
    unseen = unseen.select(F.col("blob").alias("b"), F.col("doc_id").alias("d"))
    todo = docs.join(unseen.hint("shuffle_hash"), (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("blob", "text")
    scanned = todo.mapInArrow(lambda it: _scan(it, rules, sieve), f"blob binary, spans {SPANS}")
    fresh = scanned.groupBy("blob").agg(F.first("spans").alias("spans"))
    fresh.select("blob", F.lit(version).alias("rule_version"), "spans").write.mode("append").parquet(ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path)


def scan_versions(versions: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sieve: str | None = SIEVE) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger). findings: a row for each row of `versions` with its blob and its spans, perhaps none.

    `ledger_path` names a ledger to continue, made on its first use; without one the run starts afresh. `sieve` must
    match whatever `rules` find; None switches it off."""
    ledger = scan_unseen(versions, ledger_path or scratch(versions.sparkSession, "secret-ledger"), id_col, text_col, rules, sieve)
    paths = texts(versions, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"))
    found = ledger.where((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).select("blob", "spans")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans")), ledger


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def digest(findings: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    as_text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return findings.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(as_text, 256).alias("base_sha256"), as_text.alias("spans"))


def redact(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with each span of a finding replaced by `mark`; every document and column stays.

    Spans that overlap are replaced as one."""
    findings, _ = scan_versions(docs, ledger_path, id_col, text_col)
    (spans_col,) = unused(docs, "spans")
    # By digest and id, so that the copies of one text are dealt out.
    found = findings.where(F.size("spans") > 0).groupBy("blob", F.col("doc_id").alias("of_id")).agg(F.first("spans").alias(spans_col))
    found = stored(found, "secret-spans")
    same = (text_digest(docs[text_col]) == found["blob"]) & docs[id_col].cast("long").eqNullSafe(found["of_id"])
    joined = docs.join(found.hint("shuffle_hash"), same, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1)
            at = batch.schema.get_field_index(text_col)
            text = batch.column(at)
            hit = [i for i, s in enumerate(spans.is_valid().to_pylist()) if s]
            if hit:
                new = [_without(text[i].as_py(), spans[i].as_py(), mark) for i in hit]
                mask = np.zeros(len(text), bool)
                mask[hit] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
            yield batch.set_column(at, batch.schema.field(at), text).select(names)

    names = docs.columns
    return joined.select(*[docs[n] for n in names], found[spans_col]).mapInArrow(cut, docs.schema)


def _without(text: str, spans: list[dict], mark: str) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])
