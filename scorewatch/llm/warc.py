"""WARC archives: writing with revisit records, reading by boundary-chain verification.

Writing: one record per page, payload the html in UTF-8. Of pages with equal
payloads of at least ``MIN_REVISIT`` bytes the one with the largest id is a
*response*, the others *revisit* it and carry no payload. A record ends in two
line breaks, so Spark's text sink writes valid archives with that separator.

Reading: the text source splits archives at every ``WARC/1.`` (its separator), in
byte ranges of a file, so one large archive is read by many tasks. Every piece is
a *candidate* record; its header gives the offset of its successor. The magic
also occurs inside payloads, so candidates are verified: starting from offset 0
of each file, pointer jumping (pointers double their reach every round, the
reached set follows them) keeps exactly the records on the chain. A header that
holds the magic (a URL may) spans pieces too: its end and its length are taken from
the pieces that follow. Headers and payloads that span pieces are put together
again from their pieces. The writer percent-encodes the magic in target URIs.

Only narrow rows (offsets, header fields, digests) are shuffled; payload digests
are computed where the bytes are read. Offsets are running sums per byte range
plus the range's base, and are checked against the file size.

Defined cases: a null html is an empty payload; a null url writes no target; a
null page_id sorts below every other id and reads back as null; rows that share
the largest id of their group are all responses; several files and empty files
or tables are fine; a broken chain (truncated file) ends at the last whole record
and is warned of, or is an error if whole files are asked for; headers and payloads
have any length; other columns are ignored.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorewatch.llm.common import stored, table
from scorewatch.session import fresh_dir

# Fixed values of the WARC format.
MAGIC = "WARC/1."
MAGIC_ENCODED = "WARC/1%2E"  # the same URI, without the magic
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT = 1000          # bytes; shorter payloads are never revisits
BIN = 1 << 20               # bytes; byte-range bins of records that span pieces
WARC_DATE = "2024-01-01T00:00:00Z"


def largest_of_equals(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(digest, n_bytes, keep) of each group of two or more equal long payloads."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    return stored(
        pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("digest"),
                     F.octet_length(payload).alias("n_bytes"))
        .filter(F.col("n_bytes") >= MIN_REVISIT).groupBy("digest", "n_bytes")
        .agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND keep IS NOT NULL").drop("n"), "warc-groups")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", date: str = WARC_DATE) -> None:
    """Write ``pages`` as uncompressed WARC/1.1 files, one per task, below ``path``."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("digest"),
                        F.octet_length(payload).alias("n_bytes"))
    rows = rows.join(largest_of_equals(pages, id_col, html_col), ["digest", "n_bytes"], "left")
    revisit = F.col("keep").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("keep")))
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = F.replace(target, F.lit(MAGIC), F.lit(MAGIC_ENCODED))
    lines = F.concat_ws(
        CRLF, F.lit(MAGIC + "1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")),
                 F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("keep").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(CRLF))
    record = F.concat(lines, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between magics: file, start of the byte range, place, text."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value"))


def _field(name: str, head: str = "head"):
    """The value of a header line; the line after the magic is no header line."""
    return F.regexp_extract(head, rf"(?imd)\n{name}:[ \t]*(.*?)[ \t]*\r?$", 1)


def _named(head: str = "head") -> list:
    return [_field("WARC-Type", head).alias("type"), _field("WARC-Record-ID", head).alias("record_id"),
            F.nullif(_field("WARC-Refers-To", head), F.lit("")).alias("refers_to")]


def _across(at: DataFrame) -> DataFrame:
    """Candidates whose header goes on in later pieces get its end, and its length
    if that stands there: both from the nearest piece behind that has one."""
    later = W.partitionBy("file", "block").orderBy(F.desc("start")).rowsBetween(W.unboundedPreceding, -1)
    later_block = W.partitionBy("file").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    end = F.when(F.col("skip").isNotNull(), F.col("start") + len(MAGIC) + F.col("skip"))
    size = F.when(F.col("length").isNotNull(), F.struct("start", "length"))
    blocks = at.groupBy("file", "block").agg(F.min(end).alias("end"), F.min(size).alias("size"))
    blocks = blocks.select("file", "block", F.last("end", True).over(later_block).alias("next_end"),
                           F.last("size", True).over(later_block).alias("next_size"))
    near = (at.withColumn("own_end", end).withColumn("own_size", size)
            .withColumn("end", F.last("own_end", True).over(later))
            .withColumn("size", F.last("own_size", True).over(later)).join(blocks, ["file", "block"])
            .withColumn("end", F.coalesce("end", "next_end")).withColumn("size", F.coalesce("size", "next_size")))
    goes_on = F.col("opens") & F.col("skip").isNull()
    there = F.when(F.col("size.start") < F.col("end"), F.col("size.length"))
    return near.withColumn("length", F.when(goes_on, F.coalesce("length", there)).otherwise(F.col("length"))) \
        .withColumn("skip", F.when(goes_on, F.col("end") - F.col("start") - len(MAGIC)).otherwise(F.col("skip"))) \
        .select(*at.columns)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One narrow row per piece: its offset, header fields, the offset of its
    successor (null: no record header) and, if header and payload lie within the
    piece, the payload's digest."""
    p = _pieces(spark, path).select(
        "file", "file_bytes", "block", "seq", "value", F.octet_length("value").cast("long").alias("n"),
        F.substring_index("value", CRLF + CRLF, 1).alias("head"))
    ends = F.octet_length("head") < F.col("n")
    opens = F.substring("value", 1, 3).rlike(r"^\d\r\n")
    p = p.select("file", "file_bytes", "block", "seq", "n", "value", opens.alias("opens"),
                 F.when(ends, F.octet_length("head") + 4).cast("long").alias("skip"),
                 _field("Content-Length").try_cast("long").alias("length"), *_named())
    whole = F.col("opens") & (F.col("skip") + F.col("length") <= F.col("n"))
    body = F.expr("substring(cast(value AS binary), cast(skip + 1 AS int), cast(length AS int))")
    rows = stored(p.select("file", "file_bytes", "block", "seq", "n", "opens", "skip", "length", "type",
                           "record_id", "refers_to", F.when(whole, F.sha1(body)).alias("digest")),
                  "warc-pieces")
    step = F.col("n") + len(MAGIC)
    in_block = F.sum(step).over(W.partitionBy("file", "block").orderBy("seq")) - step
    bases = (rows.groupBy("file", "file_bytes", "block").agg(F.sum(step).alias("size"))
             .withColumn("base", F.sum("size").over(W.partitionBy("file").orderBy("block")) - F.col("size"))
             .withColumn("total", F.sum("size").over(W.partitionBy("file")) - len(MAGIC)))
    sound = F.assert_true(F.col("total") == F.col("file_bytes"),
                          F.concat(F.lit("byte ranges do not add up: "), F.col("file")))
    bases = bases.filter(sound.isNull()).select("file", "block", "base")
    at = rows.withColumn("start", in_block).join(bases, ["file", "block"])
    start = F.col("start") + F.col("base") - len(MAGIC)
    at = stored(at.withColumn("start", start).drop("base"), "warc-candidates")
    if at.filter("opens AND skip IS NULL").head(1):
        at = stored(_across(at), "warc-headers")
    after = F.col("start") + len(MAGIC) + F.col("skip") + F.col("length") + 4
    return at.withColumn("next", F.when(F.col("opens"), after)).drop("opens")


def chain(found: DataFrame) -> DataFrame:
    """(file, start) of the candidates reachable from offset 0, by pointer jumping."""
    at = found.filter("next IS NOT NULL").select("file", "start", F.col("next").alias("jump"),
                                                 (F.col("start") == 0).alias("reached"))
    while True:
        hop = at.select("file", F.col("start").alias("jump"), F.col("jump").alias("far"))
        hit = at.filter("reached").select("file", F.col("jump").alias("start"), F.lit(True).alias("hit"))
        at = stored(at.join(hop, ["file", "jump"], "left").join(hit.distinct(), ["file", "start"], "left")
                    .select("file", "start", F.col("far").alias("jump"),
                            (F.col("reached") | F.col("hit").isNotNull()).alias("reached")), "warc-chain")
        if not at.filter("jump IS NOT NULL").head(1):
            return at.filter("reached").select("file", "start")


def broken(found: DataFrame, own: DataFrame) -> DataFrame:
    """(file, file_bytes, chain_end) of the files whose chain of records does not end
    where the file ends (null: it has no record)."""
    ends = own.groupBy("file").agg(F.max("next").alias("chain_end"))
    return (found.select("file", "file_bytes").distinct().join(ends, "file", "left")
            .filter("NOT chain_end <=> file_bytes"))


def records(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Verified records: file, start, block, seq, type, record_id, refers_to,
    length and digest (lower-case hex SHA-1) of the payload as archived. A chain that
    does not end with its file is a warning, with ``whole_files`` an error."""
    found = candidates(spark, path)
    own = stored(found.join(chain(found), ["file", "start"]).drop("n"), "warc-records")
    cut = broken(found, own).orderBy("file").head(5)
    if cut:
        text = "records end before or behind the end of the file (first five files): " + ", ".join(
            f"{r.file} at {r.chain_end} of {r.file_bytes} bytes" for r in cut)
        if whole_files:
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    own = own.drop("file_bytes")
    long = own.filter("digest IS NULL")
    spans = long.select("file", F.col("start").alias("rec"), "next", "skip", "length",
                        F.explode(F.sequence(F.floor(F.col("start") / BIN),
                                             F.floor((F.col("next") - 1) / BIN))).alias("bin"))
    parts = (found.select("file", "seq", "start", F.floor(F.col("start") / BIN).alias("bin"))
             .join(spans, ["file", "bin"])
             .filter("start >= rec AND start < next").drop("bin"))
    text = _pieces(spark, path).select("file", "seq", "value")
    inner = F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"])
    whole = (text.join(stored(parts, "warc-parts"), ["file", "seq"])
             .groupBy("file", "rec", "skip", "length").agg(F.array_join(inner, MAGIC).alias("value"))
             .filter("skip + length <= octet_length(value)")
             .select("file", F.col("rec").alias("start"), F.expr(
                 "sha1(substring(cast(value AS binary), cast(skip + 1 AS int), cast(length AS int)))")
                 .alias("digest"), F.substring_index("value", CRLF + CRLF, 1).alias("head"))
             .select("file", "start", "digest", *_named()))
    fields = ["file", "start", "block", "seq", "type", "record_id", "refers_to", "length"]
    return own.filter("digest IS NOT NULL").select(*fields, "digest").unionByName(
        long.drop("digest", "type", "record_id", "refers_to").join(whole, ["file", "start"])
        .select(*fields, "digest"))


def with_originals(recs: DataFrame) -> DataFrame:
    """Records with the length and digest of the full payload: a revisit takes
    both from the response it refers to."""
    recs = stored(recs, "warc-read")
    own = recs.filter("type <> 'revisit'").select("record_id", "length", "digest")
    wanted = recs.filter("type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    # repeated ids share one payload: one row each
    originals = stored(own.join(wanted, "record_id", "left_semi").distinct(), "warc-originals")
    back = (recs.filter("type = 'revisit'").drop("length", "digest")
            .join(originals.withColumnRenamed("record_id", "refers_to"), "refers_to", "left"))
    return recs.filter("type <> 'revisit'").unionByName(back.select(*recs.columns))


def page_id_of(urn: str):
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back, one row per page."""
    path = fresh_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return with_originals(records(spark, path, whole_files=True)).select(
        page_id_of("record_id").alias("page_id"), F.col("length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        page_id_of("refers_to").alias("refers_to"))


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS keep FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id < keep THEN keep END AS refers_to
FROM k
"""
