"""Object listings and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom import constants as K

MANIFEST_SCHEMA = "path string, size bigint, mtime bigint, hash string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as files with one JSON array of rows each, or with one row per line.

    A row of an array ends with a brace and a comma, which serves as the separator of a text
    source: Spark reads even one very large array by ranges of bytes, in many tasks. Only
    where a name holds the separator itself, so that a piece is no row, are the files read
    as whole arrays."""
    head = spark.read.option("lineSep", "{").text(path).where(F.trim("value") != "").first()
    if head is None or not head["value"].lstrip("\ufeff \t\r\n").startswith("["):
        return spark.read.schema(MANIFEST_SCHEMA).json(path)
    piece = F.regexp_replace(F.regexp_replace("value", r"^[\s\x{feff}]*\[?[\s,]*", ""), r"\}?\s*\]?\s*$", "")
    rows = spark.read.option("lineSep", "},").text(path).select(piece.alias("p")).where("p <> ''")
    parsed = rows.select(F.from_json(F.concat("p", F.lit("}")), f"{MANIFEST_SCHEMA}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    if parsed.where("r IS NULL OR r._bad IS NOT NULL").isEmpty():
        return parsed.select("r.path", "r.size", "r.mtime", "r.hash")
    return spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)


def manifest_from_text(docs: DataFrame, column: str = "value") -> DataFrame:
    """Manifest rows held as JSON array texts in a column."""
    rows = F.from_json(column, f"array<struct<{MANIFEST_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    return docs.select(F.inline(rows))


def write_manifest(manifest: DataFrame, target: str) -> None:
    """One JSON object per line, in path order; `read_manifest` reads it back."""
    manifest.select("path", "size", "mtime", "hash").orderBy("path").write.mode("overwrite").json(target)


def parse_listing(lines: DataFrame, bucket: str, column: str = "value") -> DataFrame:
    """(key, size, mtime, etag) of lines `date time zone … size class etag bucket/key`.

    Columns are counted from the end, so text before the size may vary. A time without
    zone is read as +0800; a line without the bucket or with too few columns is dropped."""
    head = F.substring_index(F.col(column), bucket + "/", 1)
    key = F.trim(F.substring(F.col(column), F.length(head) + len(bucket) + 2, F.length(column)))
    shape = r"^\s*(\S.*?)\s+(\S+)\s+\S+\s+(\S+)\s*$"  # time, size, class, etag
    clock = r"(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})\s*([+-]\d{4})?"
    part = lambda i: F.regexp_extract("_time", clock, i)
    zone = F.when(part(3) == "", "+0800").otherwise(part(3))
    stamp = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit(" "), zone), F.lit("yyyy-MM-dd HH:mm:ss Z"))
    return (
        lines.where(F.contains(F.col(column), F.lit(bucket + "/")) & head.rlike(shape))
        .select(
            key.alias("key"), F.regexp_extract(head, shape, 1).alias("_time"),
            F.regexp_extract(head, shape, 2).alias("_size"), F.regexp_extract(head, shape, 3).alias("etag"),
        )
        .select(
            "key", F.coalesce(F.regexp_extract("_size", r"^[+-]?\d+", 0).try_cast("bigint"), F.lit(0)).alias("size"),
            F.coalesce(F.unix_millis(stamp), F.lit(0)).alias("mtime"), "etag",
        )
    )


def content_hash(etag: Column, size: Column, mtime: Column) -> Column:
    """The etag when it is a digest, else size and time, which also tell a change."""
    h = F.lower(F.regexp_replace(etag, "[\"']", ""))
    fallback = F.concat(F.lit("s"), size.cast("string"), F.lit("-m"), mtime.cast("string"))
    return F.when(h.rlike(r"^[0-9a-f]{32}(-\d+)?$"), h).otherwise(fallback)


def _hashed(listing: DataFrame, name: str, prefix: str) -> DataFrame:
    return listing.select(
        F.substring("key", F.lit(len(prefix) + 2), F.length("key")).alias(name), "size", "mtime",
        content_hash(F.col("etag"), F.col("size"), F.col("mtime")).alias("hash"),
    ).where(F.length(name) > 0)


def build_manifest(listing: DataFrame, prefix: str, manifest_key: str = "manifest.json") -> DataFrame:
    """Notes of a listing with paths relative to the prefix, in path order."""
    inside = F.col("key").startswith(prefix + "/")
    own = F.col("key") == f"{prefix}/{manifest_key}"
    md = F.lower("key").endswith(".md")
    return _hashed(listing.where(inside & ~own & md), "path", prefix).orderBy("path")


def image_manifest(listing: DataFrame, prefix: str) -> DataFrame:
    """Images directly below the prefix, in name order."""
    image = F.lower("key").rlike(rf"\.({'|'.join(K.IMAGE_EXTENSIONS)})$")
    rows = _hashed(listing.where(F.col("key").startswith(prefix + "/") & image), "name", prefix)
    return rows.where(F.instr("name", "/") == 0).select("name", "size", "hash").orderBy("name")
