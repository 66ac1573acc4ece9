"""File sources and sinks."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DIALOGUE_SCHEMA = (
    "id string, patient_info string, "
    "dialogue array<struct<speaker:string,role:string,text:string,content:string,"
    "timestamp:string>>, "
    "turns array<struct<speaker:string,role:string,text:string,content:string,"
    "timestamp:string>>"
)


def read_corpus(spark: SparkSession, directory: str, category: str | None = None,
                recursive: bool = False, pattern: str = "*.txt") -> DataFrame:
    """Whole text files with path, file stem and category."""
    reader = spark.read.option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    path = F.col("_metadata.file_path")
    return reader.text(directory, wholetext=True).select(
        path.alias("path"),
        F.regexp_extract(F.url_decode(path), r"([^/]*)\.[^./]*$", 1).alias("source"),
        F.lit(category).alias("category"), F.col("value").alias("content"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken line is a row of nulls."""
    return spark.read.schema(schema).json(path)


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Raw dialogues under either set of field names, as one shape."""
    raw = read_jsonl(spark, path, DIALOGUE_SCHEMA)
    turns = F.transform(F.coalesce("dialogue", "turns"), lambda t: F.struct(
        F.coalesce(t["speaker"], t["role"], F.lit("")).alias("speaker"),
        F.coalesce(t["text"], t["content"], F.lit("")).alias("text"),
        t["timestamp"].alias("timestamp")))
    return raw.select("id", "patient_info", turns.alias("dialogue"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, text not escaped, null fields left out."""
    df.write.mode(mode).json(path)


def export_csv(df: DataFrame, directory: str, base: str, columns: list[str],
               nickname: str | None = None, now: datetime | None = None) -> str | None:
    """CSV with header and byte order mark under a timestamped folder name.

    Other columns are ignored, missing ones are empty. Nothing is written for no rows.
    Each part file has its own header, so parts can be read alone or together; the export
    stays distributed.
    """
    missing = [c for c in columns if c not in df.columns]
    full = df.select("*", *[F.lit("").alias(c) for c in missing]).select(*columns)
    if full.isEmpty():
        return None
    local = now or datetime.now(timezone(timedelta(hours=9)))
    suffix = f"_{nickname}" if nickname and nickname.isascii() else ""
    path = f"{directory.rstrip('/')}/{base}{suffix}_{local:%Y%m%d_%H%M}"
    marked = full.toDF("\ufeff" + columns[0], *columns[1:])
    marked.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return path


def refresh_corpus(chunks: DataFrame, path: str, replace: bool = True) -> None:
    """Replace the stored chunks, or add to them."""
    chunks.write.mode("overwrite" if replace else "append").parquet(path)


def _committed(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path was finished: its commit leaves a marker file."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """New version of a keyed table next to the old one. Readers take finished versions only, so a
    lost job leaves the old one intact, and its remains are replaced by the next try. A finished
    version is not written again."""
    path = f"{root.rstrip('/')}/version={version}"
    if _committed(df.sparkSession, path):
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(path)
    return path


def snapshot_versions(spark: SparkSession, root: str) -> list[str]:
    """Finished versions in order of their names."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
    found = [n.removeprefix("version=") for n in names if n.startswith("version=")]
    return sorted(v for v in found if _committed(spark, f"{root.rstrip('/')}/version={v}"))


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """A finished version, by default the last by name."""
    versions = snapshot_versions(spark, root)
    if not versions or version not in (None, *versions):
        raise FileNotFoundError(f"{root}: no finished version" + (f" {version}" if version else ""))
    return spark.read.parquet(f"{root.rstrip('/')}/version={version or versions[-1]}")


def write_eval_report(summary: DataFrame, trials: DataFrame, path: str) -> None:
    """Summary row and trial rows as JSON under one folder."""
    summary.write.mode("errorifexists").json(f"{path}/summary")
    trials.write.mode("errorifexists").json(f"{path}/trials")
