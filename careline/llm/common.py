"""Shared folder, written tables and text helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A table of at most so many rows, and bytes as JSON, may be broadcast; beyond it the join is left to a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000
#: Bytes of texts that a Python worker takes out of an Arrow batch at a time (more only if one text has more).
SLICE = 8_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, which a cluster names. Only a
    local session without that setting gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints", str(os.getuid()))
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/careline/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a table written once to the shared folder and read again. It cuts the
    lineage, survives lost executors, and is scanned by column."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """True if a written table has at most so many rows and bytes; stops counting beyond the rows."""
    size = F.octet_length(F.to_json(F.struct("*"))).cast("bigint")
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= rows and held <= most


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if its counted size allows one."""
    return F.broadcast(df) if bounded(df, rows) else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def filled(c: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(c), F.lit(""))


def sliced(batch: pa.RecordBatch, at: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts in column ``at`` have about ``most`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype("int64")
    before, first = sizes.cumsum() - sizes, 0
    while first < len(sizes):
        end = max(first + 1, int(before.searchsorted(before[first] + most)))
        yield batch.slice(first, end - first)
        first = end


def widened(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` with further columns, given as DDL."""
    return StructType(df.schema.fields + StructType.fromDDL(more).fields)


def appended(df: DataFrame, source: str, more: str, make: Callable[[list], Sequence],
             keep: list[str] | None = None, done: Callable[[], None] = lambda: None) -> DataFrame:
    """The columns ``keep`` (by default all) and further ones (``more``, as DDL) that ``make`` works out
    from the values of the column ``source`` of a batch. Further columns replace those of their names.
    ``done`` is called at the end of a task, to free what ``make`` holds.

    Arrow batches pass through Python once, in slices of bounded bytes; nothing is shuffled.
    """
    new = [f.name for f in StructType.fromDDL(more).fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = widened(df.select(kept), more)
    types = [to_arrow_type(f.dataType) for f in schema.fields[len(kept):]]
    columns = [F.col(f"`{c}`") for c in kept]
    if source in kept:
        at = kept.index(source)
    else:
        at = len(kept)
        columns.append(F.col(f"`{source}`").alias("_source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in (part for whole in batches for part in sliced(whole, at)):
                made = make(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(kept)], *(pa.array(v, t) for v, t in zip(made, types))], names=schema.names)
        finally:
            done()

    return df.select(columns).mapInArrow(run, schema)


def only(docs: DataFrame, id_col: str, digest: Column, stays: DataFrame, stays_id: str, stays_digest: str) -> DataFrame:
    """The rows of ``docs`` whose id and digest are in ``stays``, each pair once, with their columns. The
    row travels as one value, so its column names do not matter."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), digest.alias("row_digest"))
    kept = rows.join(stays, rows["row_id"].eqNullSafe(stays[stays_id])
                     & (rows["row_digest"] == stays[stays_digest]), "left_semi")
    pairs = docs.select(F.col(id_col).alias("row_id"), digest.alias("row_digest"))
    if pairs.groupBy("row_id", "row_digest").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["row_id", "row_digest"])
    return kept.select("row.*")
