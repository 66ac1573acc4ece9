"""Held-out documents and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One document in so many is held out.
FOLDS = 5
#: Parts of a long text that a span is taken from, each.
PARTS = 4


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def sampled(rows: DataFrame, id_col: str, label_col: str, per_label: int,
            labels: int = 1000) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows (all, if there are fewer) of each of the ``labels`` most frequent labels, chosen by a
    hash of the id, and the share of each label's rows that was taken. A pass over ids and labels counts them."""
    top = rows.groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(labels)
    counts = {r[0]: r[1] for r in top.collect()}
    shares = {label: min(1.0, per_label / n) for label, n in counts.items()}
    if not shares:
        return rows.limit(0), {}
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in shares.items()
                                        for x in (k, int(v * (1 << 30)))]), F.col(label_col))
    return rows.filter(F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) < limit), shares


def spans(text: Column, id_col: Column, most: Column | int) -> Column:
    """A text of at most about ``most`` characters as it is; of a longer one ``PARTS`` spans that hold
    ``most`` characters together, one from anywhere in each part (by a hash of the id), joined by spaces."""
    most = F.lit(most) if isinstance(most, int) else most
    size = F.greatest(F.floor(most / PARTS), F.lit(1)).cast("int")
    part = F.greatest(F.floor(F.length(text) / PARTS), size).cast("int")
    taken = [F.substring(text, (part * i + 1 + F.pmod(F.xxhash64(id_col, F.lit(f"span{i}")), part - size + 1)).cast("int"), size)
             for i in range(PARTS)]
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws(" ", *taken))
