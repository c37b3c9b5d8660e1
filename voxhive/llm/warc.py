"""WARC archives: a record per page, and a reader that verifies the chain of record boundaries.

Writing: payloads are grouped by digest; of equal payloads of at least 100 bytes the
smallest page_id is the response, the others are revisits, which carry no block and
refer to it (profile identical-payload-digest).

Reading: the archives are read as text cut at the magic line, in any splits.  Every
piece is a candidate record: its header gives the offset of its successor.  The
magic may also stand inside a payload, so candidates are followed from the file's
start by pointer jumping, and only those on the chain are records.  A record whose
payload holds the magic consists of several pieces; only these are read again, by
content, and joined.

Edge cases: null and empty html give an empty payload; a null page_id is always a
response and never referred to; repeated pages give repeated records; line breaks
in a url are dropped; a record cut off by the file's end raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxhive.llm.common import shared_path, stage

#: Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LEAST_SHARED = 100
RECORDS_PER_FILE = 4096
#: Rows of (digest, page_id) that may be sent to every task, about 60 bytes each.
HEADS_LIMIT = 200_000


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record_types(pages: DataFrame) -> DataFrame:
    """Add payload, payload_bytes, payload_digest, record_type and refers_to to page_id and url."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    heads = stage(
        rows.where((F.col("payload_bytes") >= LEAST_SHARED) & F.col("page_id").isNotNull())
        .groupBy(F.col("payload_digest").alias("shared"))
        .agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "heads",
    )
    heads = F.broadcast(heads) if heads.count() <= HEADS_LIMIT else heads
    revisit = F.coalesce(F.col("page_id") > F.col("head"), F.lit(False))
    return (
        rows.join(heads, F.col("payload_digest") == F.col("shared"), "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("head")))
        .drop("shared", "head")
    )


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One WARC record per page, in files of at most ``records_per_file`` records."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", urn("page_id")),
        F.when(F.col("url").isNull(), "").otherwise(_line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", ""))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", urn("refers_to")), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n"),
    )
    writer = record_types(pages).select(record.alias("value")).write.option("lineSep", "\r\n")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between magic lines with its header fields; every split of a file numbers its own pieces."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), "value",
    )
    end = F.locate("\r\n\r\n", F.col("value"))
    header = F.when(end > 0, F.concat(F.lit("\r\n"), F.substring(F.col("value"), F.lit(1), end + 1)))
    named = raw.withColumn("header", header).withColumn(
        "header", F.when(F.col("header").rlike(r"\A\r\n([A-Za-z-]+: [^\r\n]*\r\n)+\z"), F.col("header"))
    )
    field = lambda name: F.regexp_extract("header", rf"(?i)\r\n{name}: *([^\r\n]*)\r\n", 1)
    sized = named.withColumn("length", F.octet_length("value").cast("long")).withColumn(
        "block_at", F.octet_length("header").cast("long")  # the added line break stands for the empty line
    ).withColumn("block_bytes", F.expr("try_cast(regexp_extract(header, '(?i)\\\\r\\\\nContent-Length: *(\\\\d+)\\\\r\\\\n', 1) as bigint)"))
    whole = F.col("length") == F.col("block_at") + F.col("block_bytes") + 4
    block = F.substring(F.col("value").cast("binary"), (F.col("block_at") + 1).cast("int"), F.col("block_bytes").cast("int"))
    return sized.withColumn("whole", F.coalesce(whole, F.lit(False))).select(
        "file", "split", "place", "length", "block_at", "block_bytes", "whole",
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers_id"), field("WARC-Payload-Digest").alias("claimed"),
        F.sha2(F.when(F.col("whole"), block).otherwise(F.col("value").cast("binary")), 256).alias("digest"), "value",
    ).withColumn("content", F.sha2(F.concat_ws("\n", "digest", "record_id", "claimed", F.col("length").cast("string"), F.col("whole").cast("string")), 256))


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from offset 0, by pointer jumping.

    Each round doubles the reach of every pointer and marks what the marked ones
    point to, so a chain of n records takes about log2 n rounds.
    """
    state = stage(candidates.select("file", "offset", F.col("successor").alias("jump"), (F.col("offset") == 0).alias("marked")), "chain")
    while not state.where("marked and jump is not null").isEmpty():
        hit = state.where("marked and jump is not null").select(F.col("file").alias("h_file"), F.col("jump").alias("h_at")).distinct()
        far = state.select(F.col("file").alias("f_file"), F.col("offset").alias("f_at"), F.col("jump").alias("further"))
        state = stage(
            state.join(hit, (F.col("file") == F.col("h_file")) & (F.col("offset") == F.col("h_at")), "left")
            .join(far, (F.col("file") == F.col("f_file")) & (F.col("jump") == F.col("f_at")), "left")
            .select("file", "offset", F.col("further").alias("jump"), (F.col("marked") | F.col("h_at").isNotNull()).alias("marked")),
            "chain",
        )
    return state.where("marked").select("file", "offset")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_type, page_id, refers_to, claimed digest, block_bytes and block digest of every record."""
    pieces = stage(_pieces(spark, path).drop("value"), "pieces")
    order = Window.partitionBy("file").orderBy("split", "place").rowsBetween(Window.unboundedPreceding, -1)
    # the piece before a file's first magic line is not a candidate and has no magic of its own
    offset = F.coalesce(F.sum(F.col("length") + len(MAGIC)).over(order), F.lit(0)) - len(MAGIC)
    placed = stage(
        pieces.withColumn("offset", offset).withColumn(
            "successor", F.col("offset") + len(MAGIC) + F.col("block_at") + F.col("block_bytes") + 4
        ).drop("split", "place"), "placed",
    )
    chain = reachable(placed.where("offset >= 0"))
    on_chain = chain.select(F.col("file").alias("c_file"), F.col("offset").alias("c_at"))
    met = placed.join(on_chain, (F.col("file") == F.col("c_file")) & (F.col("offset") == F.col("c_at")), "left")
    met = stage(met.withColumn("real", F.col("c_at").isNotNull()).drop("c_file", "c_at"), "records")
    records = met.where("real")
    joined = records.where("whole")
    if not records.where("not whole").isEmpty():
        joined = joined.unionByName(_rejoined(spark, path, met))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    return joined.select(
        "record_type", number("record_id").alias("page_id"), number("refers_id").alias("refers_to"), "claimed",
        "block_bytes", "digest",
    )


def _rejoined(spark: SparkSession, path: str, met: DataFrame) -> DataFrame:
    """Records of several pieces: their pieces are fetched by content, joined in order and hashed."""
    so_far = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = met.where("offset >= 0").withColumn("owner", F.last(F.when(F.col("real"), F.col("offset")), ignorenulls=True).over(so_far))
    split = owned.where("real and not whole").select(F.col("file").alias("o_file"), F.col("offset").alias("o_at"))
    parts = stage(owned.join(split, (F.col("file") == F.col("o_file")) & (F.col("owner") == F.col("o_at"))).drop("o_file", "o_at"), "parts")
    wanted = parts.select("content").distinct()
    texts = _pieces(spark, path).select("content", "value").join(wanted, "content", "left_semi").dropDuplicates(["content"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC)
    whole = parts.join(texts, "content").groupBy("file", "owner").agg(text.alias("text"))
    heads = parts.where("real").drop("owner", "digest").join(
        whole.select(F.col("file").alias("w_file"), F.col("owner").alias("w_at"), "text"),
        (F.col("file") == F.col("w_file")) & (F.col("offset") == F.col("w_at")),
    )
    block = F.substring(F.col("text").cast("binary"), (F.col("block_at") + 1).cast("int"), F.col("block_bytes").cast("int"))
    cut_off = F.octet_length(block) < F.col("block_bytes")
    digest = F.when(cut_off, F.raise_error(F.lit("record cut off by the end of its file"))).otherwise(F.sha2(block, 256))
    return heads.withColumn("digest", digest).drop("w_file", "w_at", "text")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes its payload from its response."""
    told = F.concat(F.lit("sha256:"), F.col("digest"))
    checked = records.where("record_type = 'response'").withColumn("digest", F.when(
        told == F.col("claimed"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), told))))
    plain = checked.select("page_id", F.col("block_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                           "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = records.where("record_type = 'revisit'")
    heads = checked.join(again.select(F.col("claimed").alias("need")).distinct(), F.col("claimed") == F.col("need"), "left_semi").select(
        F.col("page_id").alias("h_id"), F.col("claimed").alias("h_claim"), F.col("block_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest")).distinct()
    found = again.join(heads, (F.col("refers_to") == F.col("h_id")) & (F.col("claimed") == F.col("h_claim")), "left")
    return plain.unionByName(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder, read them back and report every page."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return resolved(stage(read_archives(spark, path), "read"))


ROWS_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN coalesce(p.page_id > h.head, false) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > h.head THEN h.head END AS refers_to
FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest AND p.payload_bytes >= 100
"""
