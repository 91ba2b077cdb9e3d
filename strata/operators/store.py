"""Keyed document store (SC-16): a table of one row a key, dealt to buckets by
the key's hash, in which an upsert rewrites only the buckets it touches.

Layout: ``{path}/_bucket=N/part-*.parquet``. The number of buckets is fixed
when the store is made (``{path}`` remembers it in the folder names only, so
it is passed again); a key's bucket never changes. Reads of single keys look
at single buckets (partition pruning).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_table

BUCKET, SHARE = "_bucket", "_share"
#: Updates with at most so many rows of any key are not reduced to one row a
#: key before they are dealt to the buckets.
HOT_ROWS = 1000


def latest_rows(df: DataFrame, key: str, version: str, within: Sequence[str] = ()) -> DataFrame:
    """The latest row of each key (nulls are one key): the highest version and,
    among equal versions, the largest values of the other columns, so that they
    resolve alike however the rows are dealt. Columns without an order (maps,
    variants) are compared as JSON. A partial aggregate: a hot key sends one
    row a task. ``within``: columns that follow from the key; rows dealt by
    them are not dealt again."""
    rest = [f for f in df.schema.fields if f.name not in (key, version, *within)]
    odd = [f.name for f in rest if not _ordered(f.dataType)]
    plain = [f.name for f in rest if f.name not in odd]
    order = F.struct(F.col(f"`{version}`"), *[F.col(f"`{c}`") for c in plain], *[F.to_json(F.struct(f"`{c}`")).alias(c) for c in odd])
    groups = df.groupBy(*within, F.col(f"`{key}`"))
    if not odd:
        agg = groups.agg(F.max(order).alias("_r"))
    else:
        whole = F.struct(F.col(f"`{version}`"), *[F.col(f"`{f.name}`") for f in rest])
        agg = groups.agg(F.max_by(whole, order).alias("_r"))
    return agg.select(*[F.col(f"`{c}`") if c in (key, *within) else F.col(f"_r.`{c}`").alias(c) for c in df.columns])


def _ordered(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _ordered(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_ordered(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def upsert_latest(current: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """SC-16 on frames: the latest row of each key of both."""
    return latest_rows(current.unionByName(updates, allowMissingColumns=True), key, version)


@dataclass
class KeyedStore:
    spark: SparkSession
    path: str
    key: str
    version: str
    buckets: int = 256

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, schema: T.StructType | None = None) -> DataFrame | None:
        """All rows; None before the first upsert."""
        try:
            df = self.spark.read.option("mergeSchema", True).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None if schema is None else self.spark.createDataFrame([], schema)
        return df.withColumn(BUCKET, F.col(BUCKET).cast("int"))

    def get(self, keys: Sequence) -> DataFrame:
        """The rows of some keys: only their buckets are read."""
        spark = self.spark
        stored = self.read()
        kind = stored.schema[self.key].dataType
        wanted = spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("k", kind)]))
        touched = sorted({r[0] for r in wanted.select(self.bucket(F.col("k"))).collect()})
        return stored.where(F.col(BUCKET).isin(touched) & F.col(f"`{self.key}`").isin(list(keys))).drop(BUCKET)

    def first(self, n: int = 5) -> DataFrame:
        """The first documents by key (the query text is not used)."""
        return self.read().drop(BUCKET).orderBy(f"`{self.key}`").limit(n)

    def upsert(self, updates: DataFrame) -> list[int]:
        """Merge ``updates`` in: the latest row of each key stays. Only the
        buckets of the updates' keys are read, merged and replaced. A row is
        dealt once, to its bucket's tasks, and written once: dynamic partition
        overwrite writes beside the buckets and replaces them when all is
        written, so they may be read meanwhile. Returns the touched buckets.
        An upsert that is run again gives the same store."""
        heaviest = updates.groupBy(F.col(f"`{self.key}`")).count().agg(F.max("count")).first()[0]
        if heaviest is None:
            return []
        fresh = latest_rows(updates, self.key, self.version) if heaviest > HOT_ROWS else updates
        stored = self.read()
        if stored is None:
            self._replace(fresh, self.buckets)
            return sorted(r[0] for r in self.read().select(BUCKET).distinct().collect())  # at most one row a bucket
        # the same rows settle the buckets and are merged, so they are written
        fresh = stage_table(fresh.withColumn(BUCKET, self.bucket(F.col(f"`{self.key}`"))), "upserts")
        touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())
        self._replace(stored.where(F.col(BUCKET).isin(touched)).unionByName(fresh, allowMissingColumns=True).drop(BUCKET), len(touched))
        return touched

    def _replace(self, rows: DataFrame, buckets: int) -> None:
        """Replace the buckets of ``rows`` by the latest row of each key. A
        bucket is shared by as many tasks as there are shuffle partitions for it."""
        key = F.col(f"`{self.key}`")
        share = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        dealt = (rows.withColumn(BUCKET, self.bucket(key)).withColumn(SHARE, F.pmod(F.xxhash64(F.lit(SHARE), key), F.lit(share)).cast("int"))
                 .repartition(BUCKET, SHARE))
        (latest_rows(dealt, self.key, self.version, (BUCKET, SHARE)).drop(SHARE).sortWithinPartitions(BUCKET, key)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path))
