"""Secret scans through an incremental ledger of blobs.

A text's blob id is its sha256. The ledger is a Parquet table of (blob,
rule_version, spans); a scan looks only at blobs that the ledger lacks for
the current rule version, once for each different text, appends what it
found (blobs without findings too), and joins the findings back to every
path (row) that holds the blob, so copies and history are never scanned again.

Defined cases: a null text is the empty text; repeated rows each get their
blob's findings; an empty table gives an empty result; extra columns pass
through; a ledger of another rule version is kept and not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path, stage_table
from .common import text_slices

RULE_VERSION = 1
#: Kind, pattern, group that counts and its least length. The
#: first three are the base kinds; the last two are added by this library.
BASE = ("assign", "access", "hex")
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 0),
)
#: A run of at least the least length holds one of these; the full pattern
#: then runs from the left so that leftmost matches stay the same.
_HEX_RUN = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HEAD = re.compile(r"pass(?:word|wd)|secret|token|api_?key", re.ASCII | re.IGNORECASE)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        if kind == "hex":  # a maximal run of 24 or more is the same match
            hits = [m.span() for m in _HEX_RUN.finditer(text)]
        elif kind == "assign" and not _ASSIGN_HEAD.search(text):
            continue
        elif kind == "access" and "AKIA" not in text or kind == "pem" and "-----BEGIN" not in text or kind == "jwt" and "eyJ" not in text:
            continue
        else:
            hits = [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        found += [(a, order, b, kind) for a, b in hits]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


FINDINGS = "blob string, rule_version int, spans array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(version: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            spans = [[{"kind": k, "start": a, "end": z} for k, a, z in find_secrets(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * b.num_rows, pa.int32()),
                                              pa.array(spans, _SPAN)], ["blob", "rule_version", "spans"])
    return run


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows; none if nothing was written there yet."""
    try:
        return spark.read.schema(FINDINGS).parquet(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], FINDINGS)


def scan_secrets(docs: DataFrame, ledger: str | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """All rows and columns of ``docs`` with blob and spans. ``ledger`` is a
    folder that all executors share (default: a new one in the checkpoint
    folder). A task that is run again writes its part again, and a blob that
    two interrupted scans both wrote counts once."""
    spark = docs.sparkSession
    ledger = ledger or stage_path(spark, "secret-ledger")
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob")
    # copies collapse to one text a task before the shuffle
    fresh = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left_anti")
    fresh.mapInArrow(_scan(rule_version), FINDINGS).write.mode("append").parquet(ledger)
    # one row a blob, written first, so that the join below can split the paths of a hot blob
    found = stage_table(read_ledger(spark, ledger).where(F.col("rule_version") == rule_version)
                        .select(F.col("blob").alias("_b"), F.col("spans").alias("_s")).dropDuplicates(["_b"]), "secret-findings")
    rest = [c for c in docs.columns if c not in ("blob", "spans")]
    paths = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.sha2(text, 256).alias("blob"))
    return paths.join(found, F.col("blob") == F.col("_b"), "left").select("_row.*", "blob", F.col("_s").alias("spans"))
