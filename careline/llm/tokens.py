"""Token counts per document: pieces of each distinct pre-token, joined to frequencies per document.

1. One pass over the texts cuts them into pre-tokens. A task numbers the distinct ones as they come; after about
   ``VOCABULARY`` of them it begins a new segment with numbers of its own. It writes a row per document, with the numbers
   it has and how often each (a long text is cut, where a pre-token starts, into several such rows), and a row per
   segment, with its pre-tokens in order.
2. The pre-tokens of a segment are dealt to buckets by a hash, so that equal ones of all segments meet in a
   bucket, where the pieces of each distinct one are counted once. Only their numbers go back to the segments.
3. Segment by segment, numbers of pieces meet the frequencies of documents and are summed. No ids are kept anywhere.

Strings and numbers travel packed, some bytes each. A hot pre-token comes once per segment, whatever its frequency;
segments and buckets are bounded, so no task grows with the corpus.

Defined cases: null and empty texts have no tokens; the special token's string inside a
text is one token; repeated rows and other columns stay as they are; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from careline.llm.common import sliced, written
from careline.llm.pretokens import blocks, pieces, pre_tokens

#: Distinct pre-tokens after which a segment ends, about.
VOCABULARY = 300_000


def document_counts(texts: list[str | None], known: dict[str, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the text, pre-tokens by number in ``known``, their frequencies) of parts of texts; pre-tokens that are not
    known yet get the next numbers. A text without any is one empty part."""
    met = np.zeros(len(texts), bool)
    for parts in blocks(texts):
        block = pre_tokens(parts)
        numbers = np.fromiter((known.setdefault(w, len(known)) for w in block.words), np.int64, len(block.words))
        pair, count = np.unique(block.text_of * len(known) + numbers[block.codes], return_counts=True)
        text, code = np.divmod(pair, len(known))
        edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            met[text[a]] = True
            yield int(text[a]), code[a:b], count[a:b]
    for i in np.flatnonzero(~met).tolist():
        yield i, np.empty(0, np.int64), np.empty(0, np.int64)


def planes(values: np.ndarray) -> tuple[int, bytes]:
    """Numbers from 0 on with as many bytes as the largest needs, first all low bytes and then all higher ones, which are
    mostly zero and compress well."""
    width = next(w for w in (1, 2, 4) if int(values.max(initial=0)) < 1 << 8 * w)
    return width, values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unplaned(raw: bytes, width: int, n: int, at: int) -> np.ndarray:
    found = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return np.ascontiguousarray(found).view(f"<u{width}").ravel().astype(np.int64)


def packed_counts(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising numbers as differences, then what belongs to each; the widths stand first."""
    (a, steps), (b, values) = planes(np.diff(codes, prepend=0)), planes(counts)
    return bytes((a, b)) + steps + values


def unpacked_counts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = packed[:2]
    n = (len(packed) - 2) // (a + b)
    return np.cumsum(unplaned(packed, a, n, 2)), unplaned(packed, b, n, 2 + a * n)


def summed(packed: bytes, n_pieces: np.ndarray) -> int:
    """Tokens of a document, from the pieces of each number."""
    codes, counts = unpacked_counts(packed)
    return int((n_pieces[codes] * counts).sum())


def packed_words(words: list[str]) -> bytes:
    """Words in UTF-8, behind their lengths in bytes."""
    raw = [w.encode() for w in words]
    width, lengths = planes(np.array([len(w) for w in raw], np.int64))
    return len(raw).to_bytes(4, "little") + bytes([width]) + lengths + b"".join(raw)


def unpacked_words(packed: bytes) -> list[bytes]:
    n, width = int.from_bytes(packed[:4], "little"), packed[4]
    ends = np.cumsum(unplaned(packed, width, n, 5)) + 5 + n * width
    return [packed[a:b] for a, b in zip([5 + n * width, *ends[:-1].tolist()], ends.tolist())] if n else []


def frequencies(docs: DataFrame, text_col: str, keep: list[str], vocabulary: int = VOCABULARY) -> DataFrame:
    """Rows of documents: segment, row (its number), kept (their columns ``keep``), counts. Rows of segments: segment, words."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    source = docs.select(kept.alias("kept"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType([*StructType.fromDDL("segment bigint, words array<string>, row bigint").fields,
                         StructField("kept", source.schema["kept"].dataType), *StructType.fromDDL("counts binary").fields])
    arrow = to_arrow_schema(schema)

    def words_row(segment: int, known: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([list(known)], arrow.types[1]),
                                           *(pa.nulls(1, t) for t in arrow.types[2:])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = row = TaskContext.get().partitionId() << 32
        known: dict[str, int] = {}
        for batch in (part for whole in batches for part in sliced(whole, 1)):
            found = [(i, packed_counts(codes, counts)) for i, codes, counts in document_counts(batch.column(1).to_pylist(), known)]
            at = np.array([i for i, _ in found], np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), segment)), pa.nulls(len(at), arrow.types[1]), pa.array(at + row),
                batch.column(0).take(pa.array(at)).cast(arrow.types[3]), pa.array([c for _, c in found], pa.binary())], schema=arrow)
            row += len(batch)
            if len(known) > vocabulary:
                yield words_row(segment, known)
                segment, known = segment + 1, {}
        if known:
            yield words_row(segment, known)

    return source.mapInArrow(run, schema)


def dealt(segments: DataFrame, buckets: int) -> DataFrame:
    """bucket, segment, numbers (packed, with zeros), words (packed): the pre-tokens of (segment, words) by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words = batch.column(1)[i].as_py()
                of = pd.util.hash_array(np.array(words, object)) % np.uint64(buckets)
                order = np.argsort(of, kind="stable")
                edges = np.searchsorted(of[order], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(edges)).tolist()
                parts = [order[edges[b]:edges[b + 1]] for b in used]
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(used)),
                    pa.array([packed_counts(x, np.zeros(len(x), np.int64)) for x in parts]),
                    pa.array([packed_words([words[j] for j in x.tolist()]) for x in parts])], names=["bucket", "segment", "numbers", "words"])

    return segments.mapInArrow(run, "bucket int, segment bigint, numbers binary, words binary")


def piece_counts(segments: DataFrame, ranks_file: str, json_file: str) -> DataFrame:
    """segment, pieces (numbers and pieces, packed) for (segment, words). Equal pre-tokens meet in a bucket, and each distinct
    one of it is counted once; there are as many buckets as segments, so a bucket is about as large as one."""
    buckets = max(16, segments.count())
    parts = dealt(segments, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bucket, known = pieces(ranks_file, json_file), None, {}
        try:
            for batch in batches:
                found = []
                for i in range(len(batch)):
                    if batch.column(0)[i].as_py() != bucket:
                        bucket, known = batch.column(0)[i].as_py(), {}
                    counts = []
                    for word in unpacked_words(batch.column(3)[i].as_py()):
                        n = known.get(word)
                        if n is None:
                            n = known[word] = table.count(word.decode())
                        counts.append(n)
                    numbers, _ = unpacked_counts(batch.column(2)[i].as_py())
                    found.append(packed_counts(numbers, np.array(counts, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["segment", "pieces"])
        finally:
            pieces.cache_clear()

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "segment bigint, pieces binary")


def token_counts(docs: DataFrame, ranks_file: str, json_file: str, text_col: str = "text",
                 keep: list[str] | None = None, name: str = "n_tokens", vocabulary: int = VOCABULARY) -> DataFrame:
    """The columns ``keep`` (by default all; they travel along, so leave out what is not needed) and the token
    count as ``name``, which replaces a column of that name. The vocabulary files are at the same paths on every executor."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    table = written(frequencies(docs, text_col, kept, vocabulary), "frequencies", compression="zstd")
    counted = piece_counts(table.filter("words IS NOT NULL").select("segment", "words"), ranks_file, json_file)
    documents = table.filter("words IS NULL").select("segment", "row", "kept", "counts")
    schema = StructType([*documents.schema.fields[1:3], *StructType.fromDDL("n bigint").fields])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [unpacked_counts(p) for p in right["pieces"].to_pylist()]
        n_pieces = np.zeros(sum(len(x) for x, _ in found), np.int64)  # a segment without pre-tokens has none
        for numbers, counts in found:
            n_pieces[numbers] = counts
        n = [summed(c, n_pieces) if len(c) > 2 else 0 for c in left["counts"].to_pylist()]
        return pa.table([left["row"], left["kept"], pa.array(n, pa.int64())], names=schema.names)

    parts = documents.groupBy("segment").cogroup(counted.groupBy("segment")).applyInArrow(meet, schema)
    whole = parts.groupBy("row").agg(F.first("kept").alias("kept"), F.sum("n").alias("n"))
    return whole.select(*[F.col(f"kept.`{c}`").alias(c) for c in kept], F.col("n").alias(name))
