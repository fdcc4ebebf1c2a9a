"""Secret scans with an incremental blob ledger.

Every historical version of a file is content-addressed by the SHA-256 of its bytes. The
ledger, a Parquet table of (blob digest, rule version, spans), remembers each blob that a
version of the rules has seen, with or without findings. Only blobs that the ledger lacks
are scanned, each once however many paths and versions share it; then the findings are
joined back to all of them. The texts are shuffled once, after copies have met in their map
tasks; the join back carries digests only.

Defined results: a null content counts as empty; empty contents have no findings; whole
contents are scanned; each row, repeated or not, gets the findings of its content; other
columns pass through. Spans count code points, with exclusive ends.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candleframe.llm.common import distinct_misses, free_name, read_or_empty


class Rule(NamedTuple):
    """Matches of ``pattern`` count, whole, if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


# The patterns that the task gives, in its order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

LEDGER_SCHEMA = "blob_digest binary, rule_version string, spans array<struct<kind:string,start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()


def find(content: str, rules: tuple[tuple[Rule, re.Pattern], ...]) -> list[dict]:
    """Spans in ``content``: by start, then in the order of the rules."""
    out = []
    for place, (rule, pattern) in enumerate(rules):
        for m in pattern.finditer(content):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), place, rule.kind, m.end()))
    return [{"kind": kind, "start": start, "stop": stop} for start, _, kind, stop in sorted(out)]


def scan(df: DataFrame, content: str, ledger_path: str, rules: tuple[Rule, ...] = BASE_RULES, spans: str = "spans") -> DataFrame:
    """Add the spans found in ``content``; scan only what the ledger has not seen under these rules."""
    spark = df.sparkSession
    version = rule_version(rules)
    digest, blob = free_name(df, "blob_digest"), free_name(df, "blob")
    whole = F.coalesce(F.col(content), F.lit(""))

    def seen() -> DataFrame:
        rows = read_or_empty(spark, ledger_path, LEDGER_SCHEMA).filter(F.col("rule_version") == version)
        return rows.groupBy(F.col("blob_digest").alias(digest)).agg(F.first("spans").alias(spans))

    def run(batches):
        compiled = tuple((r, re.compile(r.pattern, re.ASCII)) for r in rules)
        for batch in batches:
            found = [find(t.as_py(), compiled) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(found), pa.string()), pa.array(found, _SPANS)], names=["blob_digest", "rule_version", "spans"])

    blobs = df.select(whole.alias(blob)).withColumn(digest, F.unhex(F.sha2(F.col(blob).cast("binary"), 256)))
    unseen = distinct_misses(blobs, digest, blob, seen()).select(digest, blob)
    unseen.mapInArrow(run, LEDGER_SCHEMA).write.mode("append").parquet(ledger_path)
    return df.withColumn(digest, F.unhex(F.sha2(whole.cast("binary"), 256))).join(seen(), digest, "left").drop(digest)


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:stop of the spans of ``kinds``, comma-joined in their order."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
