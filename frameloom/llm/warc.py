"""WARC archives as a chunked record table.

A page becomes rows (page_id, segment, ...) of bounded payload: the first segment is a response (or a revisit without payload),
further ones are continuation records that name the first, as the format's segmentation defines. Spark's text writer puts the
rows into archives of any size on any store, and its reader splits them again at the two lines that start a record. No segment
contains that separator, since a payload that does is cut inside it; and none can begin before a segment and end in it, or begin
in it and end behind, since what stands around a segment are line ends, with which the separator does not begin. So reading is
exact and splittable, and no page can forge a record. Digests of payloads in
several segments are carried from segment to segment when read, where no page is put together in memory. Writing hashes whole payloads
and makes the segments of a page in one row, so it holds the longest page about twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from frameloom.llm._common import broadcast_if_few, checkpointed, ensure_checkpoint_dir, python_ready, remove, table, whole

#: Characters of payload in a segment at most.
SEGMENT = 1 << 16
#: Fixed values of the format.
VERSION, NEWLINE = "WARC/1.1", "\r\n"
END = NEWLINE * 2
#: What starts a record here. Its start never comes again within it, so readers that look for it need not go back.
SEPARATOR = VERSION + NEWLINE + "WARC-Type: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Where a payload is cut that contains the separator.
CUT = r"(?<=WA)(?=RC/1\.1\r\nWARC-Type: )"


def base32(hexes: Column, size: int = 20) -> Column:
    """Upper-case base32 of `size` bytes (a multiple of 5) in hexadecimal."""
    digits = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(size // 5)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def segments(payload: Column, size: int = SEGMENT) -> Column:
    """The payload's segments, none of which contains the separator; an empty payload has one."""
    part = lambda i: F.substring(payload, (i * size + 1).cast("int"), F.lit(size))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(payload) - 1) / size), F.lit(0)).cast("int")), part)
    mark = lambda p: F.when(F.contains(p, F.lit(SEPARATOR)), F.split(p, CUT)).otherwise(F.array(p))  # noqa: E731  cuts of no width
    return F.when(F.length(payload) <= size, mark(payload)).otherwise(F.flatten(F.transform(pieces, mark)))


def row_tag(text: Column, uri: str) -> Column:
    """What tells the rows of one page_id apart in record identifiers: a digest of payload and address."""
    address = F.col(uri).cast("string")
    return F.sha1(F.concat(F.sha1(text.cast("binary")), F.coalesce(F.concat(F.lit(" "), address), F.lit(""))).cast("binary"))


def record_roles(pages: DataFrame, payload: str = "html", least: int = 0, uri: str = "url") -> DataFrame:
    """Rows (sha1, payload_bytes, first_id, first_tag): of equal payloads of at least `least` bytes the smallest page_id."""
    text = whole(payload)
    sized = pages.select("page_id", row_tag(text, uri).alias("tag"), F.sha1(text.cast("binary")).alias("sha1"), F.octet_length(text).cast("bigint").alias("payload_bytes"))
    return checkpointed(sized.where(F.col("payload_bytes") >= least).groupBy("sha1", "payload_bytes").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "tag"))).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha1", "payload_bytes", F.col("first.page_id").alias("first_id"), F.col("first.tag").alias("first_tag")))


def write_archives(pages: DataFrame, path: str, payload: str = "html", uri: str = "url", least: int = 0, size: int = SEGMENT, date: str = "2024-01-01T00:00:00Z", compression: str = "none") -> None:
    """Write a record for each page below `path`; null payloads are empty, null addresses leave their header out.

    Long payloads are segmented (several records of one row); other columns than page_id, payload and address are not read,
    whatever their names; an empty table writes no records. Of equal payloads of one smallest page_id all rows are responses.
    A record's identifier names page_id, a digest of payload and address, and for rows equal in all of these a number, so each row
    has records of its own. A revisit names such equal rows without the number. A null page_id is written as `null`, with its payload.
    """
    text = whole(payload)
    keyed = pages.select("page_id", row_tag(text, uri).alias("tag"), F.monotonically_increasing_id().alias("row"), F.col(uri).cast("string").alias("uri"), text.alias("body"), F.sha1(text.cast("binary")).alias("sha1"), F.octet_length(text).cast("bigint").alias("payload_bytes"))
    roles = record_roles(pages, payload, least, uri)
    equal = checkpointed(pages.select(F.col("page_id").alias("page2"), row_tag(text, uri).alias("tag2")).groupBy("page2", "tag2").count().where("count > 1").select("page2", "tag2"))
    keyed = keyed.join(broadcast_if_few(equal), F.col("page_id").eqNullSafe(F.col("page2")) & (F.col("tag") == F.col("tag2")), "left")
    keyed = keyed.withColumn("tag", F.when(F.col("tag2").isNotNull(), F.concat_ws("-", "tag", "row")).otherwise(F.col("tag"))).drop("page2", "tag2", "row")
    joined = keyed.join(broadcast_if_few(roles), ["sha1", "payload_bytes"], "left").withColumn("again", F.coalesce(F.col("first_id") < F.col("page_id"), F.lit(False)))
    parts = F.when(F.col("again"), F.array(F.lit(""))).otherwise(segments(F.col("body"), size))
    rows = joined.select("page_id", "tag", "uri", "sha1", "payload_bytes", "first_id", "first_tag", "again", parts.alias("parts")).select("*", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "part")).drop("parts")
    urn = lambda page, tag, i: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.lit(":"), F.col(tag), F.when(i > 0, F.concat(F.lit(":"), (i + 1).cast("string"))).otherwise(F.lit("")), F.lit(">"))
    first, several, again = F.col("i") == 0, F.col("n") > 1, F.col("again")
    line = lambda name, value, on=None: F.when(F.lit(True) if on is None else on, F.concat(F.lit(name + ": "), value.cast("string"), F.lit(NEWLINE))).otherwise(F.lit(""))
    safe = F.regexp_replace("uri", "[\\x00-\\x20\\x7F]", "%20")
    head = F.concat(
        F.lit(SEPARATOR), F.when(again, F.lit("revisit")).when(first, F.lit("response")).otherwise(F.lit("continuation")), F.lit(NEWLINE),
        line("WARC-Record-ID", urn("page_id", "tag", F.col("i"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", safe, F.col("uri").isNotNull()), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1"))), first),
        line("WARC-Profile", F.lit(PROFILE), again),
        F.coalesce(line("WARC-Refers-To", urn("first_id", "first_tag", F.lit(0)), again), F.lit("")),
        line("WARC-Segment-Number", F.col("i") + 1, several),
        line("WARC-Segment-Origin-ID", urn("page_id", "tag", F.lit(0)), several & ~first),
        line("WARC-Segment-Total-Length", F.col("payload_bytes"), several & (F.col("i") == F.col("n") - 1)),
        line("Content-Type", F.lit("text/html; charset=utf-8"), ~again),
        line("Content-Length", F.octet_length("part")),
        F.lit(NEWLINE),
    )
    rows.select(F.concat(head, "part").alias("value")).write.mode("error").option("lineSep", END).option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, origin (the first record's identifier), segment (from 1), record_type, refers_to, stated_digest, total, length, payload (binary).

    Archives as write_archives makes them, with the type as the first header; what lacks headers or an identifier is refused.
    """
    rows = spark.read.option("lineSep", SEPARATOR).text(path).where("value <> ''")  # before the first record of a file
    split = F.instr("value", END)
    rows = rows.select(F.concat(F.lit("WARC-Type: "), F.substring("value", F.lit(1), split - 1)).alias("head"), F.expr(f"substring(value, instr(value, '{END}') + {len(END)})").alias("rest"))
    field = lambda name: F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head"), F.lit("\r\n")), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    number = lambda urn: F.regexp_extract(urn, r"<urn:page:(-?\d+)", 1)  # noqa: E731  empty for null
    origin = F.when(field("WARC-Type") == "continuation", field("WARC-Segment-Origin-ID")).otherwise(field("WARC-Record-ID"))
    origin = F.when(origin == "", F.raise_error(F.lit("a record has no identifier"))).otherwise(origin)
    length = F.try_to_number(field("Content-Length"), F.lit("9" * 18)).cast("bigint")
    optional = lambda c, kind: F.when(c != "", c.cast(kind))
    return rows.select(
        optional(number(origin), "bigint").alias("page_id"),
        origin.alias("origin"),
        F.coalesce(optional(field("WARC-Segment-Number"), "int"), F.lit(1)).alias("segment"),
        field("WARC-Type").alias("record_type"),
        optional(number(field("WARC-Refers-To")), "bigint").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
        (field("WARC-Segment-Number") != "").alias("segmented"),
        optional(field("WARC-Segment-Total-Length"), "bigint").alias("total"),
        length.alias("length"),
        F.expr("cast(rest as binary)").alias("raw"),
    ).withColumn("payload", F.expr("substring(raw, 1, cast(length as int))")).drop("raw")


def payload_digests(records: DataFrame) -> DataFrame:
    """(page_id, sha1, payload_bytes) of each response, from its payload.

    Payloads of one segment are hashed where they are read. Segments of longer ones meet in order in one task, which carries
    the digest on and never holds more than a batch of segments.
    """
    python_ready(records.sparkSession)
    alone = records.where("record_type = 'response' and not segmented").select("page_id", F.sha1("payload").alias("sha1"), F.col("length").alias("payload_bytes"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, record, digest, size = None, None, None, 0
        names = ["page_id", "sha1", "payload_bytes"]
        row = lambda: pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([digest.hexdigest()]), pa.array([size], pa.int64())], names=names)
        for batch in batches:
            for p, origin, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or origin != record:
                    if digest is not None:
                        yield row()
                    page, record, digest, size = p, origin, hashlib.sha1(), 0
                digest.update(data)
                size += len(data)
        if digest is not None:
            yield row()

    long = records.where("segmented and record_type in ('response', 'continuation')").select("page_id", "origin", "segment", "payload")
    long = long.repartition("origin").sortWithinPartitions("origin", "segment").select("page_id", "origin", "payload").mapInArrow(carry, "page_id bigint, sha1 string, payload_bytes bigint")
    return alone.unionByName(long)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per row written: page_id, payload_bytes, payload_digest, record_type, refers_to.

    What a revisit says of its payload comes from the response that it names; one whose response is not there has the digest that it
    states and null bytes. A page that was written without an id is read with a null one, an empty payload has 0 bytes, and rows
    that repeat an id are rows of their own. Payloads of many segments are never put together. Archives without records give no rows.
    """
    records = read_records(spark, path)
    found = checkpointed(payload_digests(records).select("page_id", base32(F.col("sha1")).alias("payload_digest"), "payload_bytes"))
    full = found.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    again = checkpointed(records.where("record_type = 'revisit'").select("page_id", "refers_to", "stated_digest"))
    origins = found.select(F.col("page_id").alias("origin"), "payload_digest", "payload_bytes").dropDuplicates(["origin", "payload_digest"])
    named = again.join(origins, (F.col("refers_to") == F.col("origin")) & (F.col("stated_digest") == F.col("payload_digest")), "left")
    again = named.select("page_id", "payload_bytes", F.coalesce("payload_digest", "stated_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return full.unionByName(again)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{spark.sql('select uuid()').first()[0]}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    out = checkpointed(read_archives(spark, folder))
    remove(spark, folder)
    return out


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS f FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(h, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to
FROM q
"""
