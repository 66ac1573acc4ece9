"""Web archives: writing records and reading them back by verified boundaries.

Writing. A record is ``WARC/1.1``, header lines, an empty line, the payload and two line
ends. The text writer of Spark writes them, as its line separator may be the two line ends
(CR LF CR LF); so files go wherever Spark can write, and failed tasks leave nothing.

Reading. The text reader cuts files into byte ranges and, with the magic as line separator,
into segments between magics. A segment is a candidate record; its header tells the offset of
its successor. Offsets are sums of lengths, by range and then by file. A payload may hold
the magic, even whole records, so candidates are not trusted: the chain of successors that
starts at the start of the file is followed, and only what it reaches is a record. Runs of
candidates that follow each other directly are one node of that chain; pointer jumping over
the nodes halves the longest way in each round. The payload of a record that holds magics is
put together from its segments.

Records without a payload of their own (revisits) name the record whose payload they repeat.

Only DataFrame operations are used. A compressed file is one range. Payloads move once when written; when read, only
payloads that hold a magic move.

Defined cases: a null payload is empty; of equal payloads the smallest id is the response; of
repeated rows of that id one is, and the others revisit it; null ids count as larger than
any; rows keep other columns out of the archive. A broken file keeps the records up to the break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careline.llm.common import filled, written

MAGIC = "WARC/1.1\r\n"
CLOSE = "\r\n\r\n"
# fixed values: the alphabets of digits in base 32, as counted and as written (RFC 4648)
COUNTED, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: No more records than this in a file.
FILE_RECORDS = 20_000


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: 160 bits are 8 groups of 5 hex or 4 base-32 digits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), COUNTED, BASE32)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_bytes: int = 0, compression: str | None = None) -> None:
    """A record per row under ``path``. Rows whose payload, of at least ``least_bytes``, equals
    that of a row with a smaller id are revisits of it. With ``compression`` ("gzip") files are
    compressed as a whole; then a file is read by one task, and without it by one per range."""
    payload = filled(payload_col)
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.octet_length(payload).alias("n"), base32_sha1(payload).alias("sha1"),
        F.sha2(payload, 256).alias("same"))
    small = rows.filter(F.col("n") >= least_bytes).select("id", "same")
    first = small.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("members"))
    copies = first.filter("members > 1").select("same", "first")
    refers = small.distinct().join(copies, "same").select(
        F.col("same").alias("_same"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("_id"), "first")
    known = rows.withColumn("_id", F.coalesce(F.col("id").cast("string"), F.lit("")))
    nth = F.row_number().over(Window.partitionBy("same", "_id").orderBy("url"))
    met = known.withColumn("nth", nth).join(
        refers.withColumnRenamed("_id", "_rid"), (F.col("same") == F.col("_same")) & (F.col("_id") == F.col("_rid")), "left")
    revisit = F.col("_same").isNotNull() & ~((F.col("id").eqNullSafe(F.col("first"))) & (F.col("nth") == 1))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    url = F.regexp_replace(F.col("url"), r"[\r\n]", "")
    kind = F.when(revisit, "revisit").otherwise("response")
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")), F.lit("\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    (met.select(F.concat(head, body).alias("value")).write
     .option("lineSep", CLOSE).option("maxRecordsPerFile", FILE_RECORDS)
     .option("compression", compression or "none").text(path))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Segments between magics: file, range, rid, raw. The first segment of a file is empty if
    the file starts with the magic."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("rid"), F.col("value").alias("raw"))


def _parsed(lines: DataFrame) -> DataFrame:
    """Segments with what their header says; ``whole`` if the segment is exactly one record, and
    then the digest of its payload."""
    head = F.substring_index("raw", CLOSE, 1)

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))

    rows = lines.withColumn("n", F.octet_length("raw")).withColumn("head", head)
    rows = rows.withColumn("head_n", F.octet_length("head") + 4).withColumn(
        "content_n", F.regexp_extract("head", r"(?m)^Content-Length: (\d{1,18})\r?$", 1).try_cast("bigint"))
    size = F.when(F.col("head_n") <= F.col("n"), F.col("head_n") + F.col("content_n") + 4)
    whole = F.coalesce(size == F.col("n"), F.lit(False))
    payload = F.substring(F.col("raw").cast("binary"), F.col("head_n") + 1, F.col("content_n").cast("int"))
    return rows.select(
        "file", "range", "rid", "n", size.alias("size"), "head_n", "content_n", whole.alias("whole"),
        field("WARC-Type").alias("kind"), field("WARC-Record-ID").alias("id"),
        field("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("url"),
        field("WARC-Payload-Digest").alias("declared"),
        F.when(whole & (F.col("content_n") > 0), base32_sha1(payload)).alias("digest"))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds ``at``, the offset of the magic in front of a segment: sums of lengths within ranges,
    then of ranges within files."""
    step = F.col("n") + len(MAGIC)
    total = rows.groupBy("file", "range").agg(F.sum(step).alias("bytes"))
    by_range = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select("file", "range", F.coalesce(F.sum("bytes").over(by_range), F.lit(0)).alias("base"))
    in_range = Window.partitionBy("file", "range").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum(step).over(in_range), F.lit(0))).join(
        before, ["file", "range"]).withColumn("at", F.col("base") + F.col("inside") - len(MAGIC)
                                              ).drop("base", "inside", "range", "rid")


def reachable(nodes: DataFrame) -> DataFrame:
    """file, at of the nodes (file, at, next) on the chain from offset 0: pointer jumping. After
    round k a node knows its 2**k-th successor and all nodes up to there are marked."""
    jump = written(nodes.select("file", "at", "next"), "jump")
    marked = written(jump.filter("at = 0").select("file", "at"), "marked")
    n = marked.count()
    while True:
        ahead = marked.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).join(
            jump.select("file", "at"), ["file", "at"], "left_semi")
        marked = written(marked.unionByName(ahead).distinct(), "marked")
        more = marked.count()
        if more == n:
            return marked
        n = more
        far = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = written(jump.join(far, ["file", "next"]).select("file", "at", F.col("far").alias("next"))
                       .unionByName(jump.join(far, ["file", "next"], "left_anti").select("file", "at", "next")), "jump")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, at (offset), kind, id, url, refers_to, declared (digest in the header), content_n and
    digest (of the payload itself, null if that is empty) of every record; offsets are those of the uncompressed file."""
    rows = written(_placed(_parsed(_lines(spark, path))), "segments").filter("at >= 0")
    rows = rows.withColumn("next", F.col("at") + len(MAGIC) + F.col("size"))
    order = Window.partitionBy("file").orderBy("at")
    landing = rows.filter("NOT whole AND next IS NOT NULL").select("file", F.col("next").alias("at")).distinct()
    flagged = rows.join(landing.withColumn("landed", F.lit(True)), ["file", "at"], "left")
    starts = (F.col("at") == 0) | ~F.coalesce(F.lag("whole").over(order), F.lit(False)) | F.col("landed").isNotNull()
    node = F.max(F.when(F.col("starts"), F.col("at"))).over(order)
    runs = written(flagged.withColumn("starts", starts).withColumn("node", node), "runs")
    nodes = runs.withColumnRenamed("at", "place").groupBy("file", F.col("node").alias("at")).agg(F.max_by("next", "place").alias("next"))
    met = reachable(nodes).withColumnRenamed("at", "node")
    records = written(runs.join(met, ["file", "node"], "left_semi"), "records")
    columns = ["file", "at", "kind", "id", "url", "refers_to", "declared", "content_n", "digest"]
    torn = records.filter("NOT whole AND next IS NOT NULL")
    if not torn.limit(1).count():
        return records.filter("whole").select(columns)
    # payloads that hold magics: their segments, from the files again, put together
    owner = F.max(F.when(F.col("mine").isNotNull(), F.col("at"))).over(order)
    parts = rows.join(records.select("file", "at", F.lit(1).alias("mine")), ["file", "at"], "left").select(
        "file", "at", owner.alias("owner"))
    parts = parts.join(torn.select("file", F.col("at").alias("owner")), ["file", "owner"])
    raw = _placed(_lines(spark, path).withColumn("n", F.octet_length("raw")))
    joined = raw.join(parts, ["file", "at"]).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("segments"))
    text = F.array_join(F.transform("segments", lambda s: s["raw"]), MAGIC)
    whole = joined.select("file", F.col("owner").alias("at"), text.cast("binary").alias("bytes"))
    payload = F.substring("bytes", F.col("head_n") + 1, F.col("content_n").cast("int"))
    mended = torn.join(whole, ["file", "at"]).filter(
        F.octet_length("bytes") >= F.col("head_n") + F.col("content_n")).withColumn("digest", base32_sha1(payload))
    return records.filter("whole").select(columns).unionByName(mended.select(columns))


def resolved(records: DataFrame) -> DataFrame:
    """Pages of read records: id, url, kind, refers_to, payload_bytes, payload_digest. Revisits have
    those of the response that they name; both digests must agree."""
    number = r"<urn:page:(-?\d+)>"
    rows = records.withColumn("payload_digest", F.coalesce("digest", base32_sha1(F.lit("")))).select(
        F.regexp_extract("id", number, 1).try_cast("bigint").alias("id"), "url", "kind",
        F.regexp_extract("refers_to", number, 1).try_cast("bigint").alias("refers_to"),
        F.regexp_replace("declared", "^sha1:", "").alias("declared"),
        F.col("content_n").alias("payload_bytes"), "payload_digest")
    responses = rows.filter("kind = 'response'")
    target = responses.select(F.col("id").alias("_id"), F.col("payload_bytes").alias("_bytes"),
                              F.col("payload_digest").alias("_digest"))
    revisits = rows.filter("kind = 'revisit'").join(
        target, F.col("refers_to").eqNullSafe(F.col("_id")) & (F.col("declared") == F.col("_digest")), "left")
    columns = ["id", "url", "kind", "refers_to", "payload_bytes", "payload_digest"]
    return responses.select(columns).unionByName(revisits.select(
        "id", "url", "kind", "refers_to", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest")))
