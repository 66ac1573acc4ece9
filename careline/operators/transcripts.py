"""From files to chunks and from transcripts to turns."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careline.functions import chunks as C
from careline.functions import segments as S
from careline.functions.core import nz, rx, strip, unpack
from careline.functions.text import strip_quotes
from careline.rules import dialogue


def explode_chunks(df: DataFrame, chunks: Column, source: str, category: str = "healthcare_docs",
                   path: str | None = None, prefix: str = "") -> DataFrame:
    """One row per chunk with its metadata; blank chunks count but are left out."""
    place = F.col(path) if path else F.lit(None).cast("string")
    return (
        df.withColumn("_chunks", chunks)
        .select(F.col(source).cast("string").alias("source"), place.alias("file_path"),
                F.size("_chunks").alias("total_chunks"),
                F.posexplode_outer("_chunks").alias("chunk_index", "text"))
        .filter(strip(F.col("text")) != "")
        .select(
            F.concat(F.lit(prefix), "source", F.lit("_"), F.col("chunk_index").cast("string"))
            .alias("chunk_id"),
            "text", "source", "file_path", "chunk_index", "total_chunks",
            F.lit(category).alias("category"))
    )


def nfc(c: Column | str) -> Column:
    """Unicode NFC; there is no built-in for it."""
    @F.pandas_udf(T.StringType())
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return normal(c)


def transcript_turns(files: DataFrame, path: str = "path", content: str = "content",
                     topic: Column | None = None, version: int = 2) -> DataFrame:
    """Turns of every section of every transcript file.

    Result: path, section, topic, turn, role, text.
    """
    name = F.regexp_extract(F.col(path), r"([^/]*?)(\.[^./]*)?$", 1) if topic is None else topic
    sections = unpack(files, [path], C.transcript_sections(content, name), "_s", "section", ["_s"])
    return unpack(
        sections, [path, "section", F.col("_s.topic").alias("topic")],
        C.extract_turns(F.col("_s.text"), version), "_t", "turn", ["_t"],
    ).select(path, "section", "topic", F.col("turn").cast("long").alias("turn"),
             F.col("_t.role").alias("role"), F.col("_t.content").alias("text"))


def line_dialogues(files: DataFrame, path: str = "path", content: str = "content",
                   size: int = S.SEGMENT_ROWS) -> DataFrame:
    """Turns of line-based transcripts; a persona line opens the next conversation.

    Result: path, conversation, has_system, turn, role, text. Lines are numbered inside
    their file and the conversation number is a running sum over segments of lines, so a
    very long file is not held by one task.
    """
    lines = files.select(path, F.posexplode(F.split(nz(content), "\n", -1)).alias("_i", "_l"))
    bare = strip(F.col("_l"))
    user, helper = rx(dialogue.LINE_USER), rx(dialogue.LINE_ASSISTANT)
    said_user = strip_quotes(F.regexp_extract(bare, user, 2))
    said_helper = F.regexp_replace(
        strip_quotes(F.regexp_extract(bare, helper, 2)), r"\[([^\]]+)\]", "($1)")
    opens = F.startswith(bare, F.lit(dialogue.LINE_SYSTEM)) & F.contains(
        bare, F.lit(dialogue.LINE_PERSONA))
    marked = lines.select(
        path, F.col("_i").cast("long").alias("line"), opens.alias("opens"),
        F.when(~opens & bare.rlike(user), "user").when(~opens & bare.rlike(helper), "assistant")
        .alias("role"),
        F.when(bare.rlike(user), said_user).otherwise(said_helper).alias("text"),
    ).filter(F.col("opens") | (F.col("role").isNotNull() & (F.col("text") != "")))
    most = files.agg(F.max(F.size(F.split(nz(content), "\n", -1)))).first()[0] or 0
    whole = most <= size  # of lines, in every file
    numbered = S.running(marked, [path], ["line"],
                         {"conversation": ("sum", F.col("opens").cast("int"))},
                         S.segment("line", size), whole)
    said = numbered.filter(~F.col("opens"))
    return S.dense_position(
        said.select(path, "conversation", (F.col("conversation") > 0).alias("has_system"),
                    "line", "role", "text"),
        [path, "conversation"], ["line"], S.segment("line", size), "turn", whole).drop("line")


def merge_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing in one source become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
