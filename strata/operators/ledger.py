"""Duplicate rows across runs (AG-09, QL-01): a ledger of the digests of all
rows seen so far, so that a new batch is compared with the old ones without
reading or hashing their rows again.

Layout: ``{path}/_batch=N/_prefix=P/part-*.parquet`` with one digest (SHA-256 of
the row) per different row, in the batch that brought it first, dealt by
the digest's first byte into some prefixes. A batch counts once the note beside the ledger names
it; one that was interrupted is written again under its number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table
from ..sources.manifest import read_note, write_note
from .quality import duplicate_check_columns

DIGESTS = "digest binary, _batch int, _prefix int"
#: New digests of at most so many rows are broadcast against the ledger.
BROADCAST_DIGESTS = 500_000


def row_digest(columns: Sequence[str]):
    """SHA-256 of a row's values; equal exactly where the rows are (nulls and
    empty texts differ, and so do the names of the columns)."""
    return F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])), 256))


class DuplicateLedger:
    """``prefixes`` is fixed when the ledger is made (up to 256; few for a small one)."""

    def __init__(self, spark: SparkSession, path: str, prefixes: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.note = read_note(spark, f"{self.path}.json") or {"rows": 0, "distinct": 0, "batches": 0, "columns": None, "prefixes": prefixes}

    @property
    def duplicates(self) -> int:
        """Rows beyond the first of each identical group, over all batches."""
        return self.note["rows"] - self.note["distinct"]

    def digests(self) -> DataFrame:
        """The digests of all counted batches."""
        if not self.note["batches"]:
            return self.spark.createDataFrame([], DIGESTS)
        return self.spark.read.schema(DIGESTS).parquet(self.path).where(F.col("_batch") < self.note["batches"])

    def add(self, rows: DataFrame, columns: Sequence[str] | None = None) -> int:
        """Count a batch in; the number of its rows that repeat an earlier row
        or one of its own. Equal rows meet in the partial aggregate; of the
        ledger only the digests are read, of the prefixes that the batch has."""
        columns = list(columns) if columns is not None else duplicate_check_columns(rows)
        if self.note["columns"] not in (None, columns):
            raise ValueError(f"the ledger holds rows of {self.note['columns']}")
        fresh = stage_table(rows.select(row_digest(columns).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
                            .withColumn("_prefix", (F.conv(F.hex(F.substring("digest", 1, 1)), 16, 10).cast("int") % self.note["prefixes"])), "digests")
        total, different, prefixes = fresh.agg(F.sum("n"), F.count(F.lit(1)), F.collect_set("_prefix")).first()
        old = self.digests().where(F.col("_prefix").isin(prefixes or [])).select("digest", "_prefix")
        keys = fresh.select("digest", "_prefix")
        seen = stage_table(old.join(F.broadcast(keys) if different <= BROADCAST_DIGESTS else keys, ["_prefix", "digest"], "left_semi"), "seen-digests")
        known = seen.count()
        new = fresh.join(seen, ["_prefix", "digest"], "left_anti").select("digest", F.lit(self.note["batches"]).alias("_batch"), "_prefix")
        new.repartition("_prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch", "_prefix").parquet(self.path)
        total = int(total or 0)
        self.note = {**self.note, "rows": self.note["rows"] + total, "distinct": self.note["distinct"] + different - known,
                     "batches": self.note["batches"] + 1, "columns": columns}
        write_note(self.spark, f"{self.path}.json", self.note)
        return total - (different - known)
