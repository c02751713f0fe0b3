"""WARC archives and their fixity audit by Merkle trees.

Pages become WARC records, in order of their id, in archives of a bounded number of records. A manifest gives each record's
archive, place, offset and length. An audit reads each record's stored bytes from the archives of a store, checks and hashes
them, and folds the hashes of neighbouring ranges, with their offsets, level by level into one root per archive. Two stores are
compared at the roots; only the children of nodes that differ are looked at, down to the records.

A null url or html counts as empty and a null id comes first. Repeated rows are records of their own, ordered by their digest.
Only the three named columns are read. An archive that a store lacks shows as all its records, a file cut short as the records
behind the cut, and a changed stored byte, compressed or not, as the one record it belongs to. An empty table has no archives.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.llm.common import stored

#: Records of an archive, and children of a node.
PER_ARCHIVE, FAN_OUT = 4096, 16
GAP = "\r\n\r\n"


def record(key: Column, url: Column, html: Column) -> Column:
    """The record without the two line ends that follow it."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    one_line = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\r\n]+", " ")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit("resource")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", one_line), line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body,
    )


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, archive, no, offset, length, digest, record: the pages as records at their places."""
    rows = pages.select(F.col(key).alias("key"), record(F.col(key), F.col(url), F.col(html)).alias("record")).select(
        "key", F.coalesce(F.floor(F.col("key") / PER_ARCHIVE), F.lit(-1)).alias("range"), "record",
        F.sha2(F.concat("record", F.lit(GAP)), 256).alias("digest"),
        (F.octet_length("record") + len(GAP)).cast("bigint").alias("length"),
    )
    order = Window.partitionBy("range").orderBy("key", "digest")
    numbered = rows.withColumn("rank", F.row_number().over(order) - 1).withColumn("piece", F.floor(F.col("rank") / PER_ARCHIVE))
    before = Window.partitionBy("range", "piece").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return numbered.select(
        "key", F.concat_ws("-", "range", "piece").alias("archive"), (F.col("rank") % PER_ARCHIVE).cast("bigint").alias("no"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest", "record",
    )


def write_archives(rows: DataFrame, folder: str, copies: dict[str, Column], flipped: dict[str, Column] | None = None) -> None:
    """For each copy, in ``folder/copy=name``, one WARC file per archive: records in order, each followed by two line ends.
    ``copies`` gives the text of a record in each copy. Every record is a gzip member of its own, and an index, made from the
    files as written, says where each member stands. Offsets of the manifest count the bytes before compression. To exercise
    audits, one stored byte is flipped in a copy's members for which ``flipped`` holds.

    The rows come from ``records``, which has all rows of an archive in one partition, so they are not shuffled again."""
    no_flip = F.lit(False)
    each = F.array(*[
        F.struct(F.lit(name).alias("copy"), text.alias("record"), F.coalesce((flipped or {}).get(name, no_flip), no_flip).alias("flip"))
        for name, text in copies.items()
    ])
    placed = rows.select("archive", "no", F.explode(each).alias("x")).select("x.copy", "archive", "no", "x.record", "x.flip")
    schema = placed.select("copy", "archive", "no", F.lit(b"").alias("member")).schema
    members = placed.mapInArrow(_members, schema).sortWithinPartitions("copy", "archive", "no")
    # The text writer puts the bytes of a string into the file as they are, and ends each with another (empty) gzip member.
    lines = members.select("copy", "archive", F.col("member").cast("string").alias("member"))
    lines.write.mode("overwrite").partitionBy("copy", "archive").option("encoding", "ISO-8859-1").option(
        "lineSep", LAST.decode("latin-1")).text(folder)
    spark = rows.sparkSession
    for name in copies:
        index = _files(spark, f"{folder}/copy={name}").mapInArrow(_places, "archive string, no bigint, at bigint, size bigint")
        index.write.mode("overwrite").option("compression", "zstd").parquet(_index_folder(f"{folder}/copy={name}"))


def _index_folder(store: str) -> str:
    folder, _, name = store.rstrip("/").rpartition("/")
    return f"{folder}/_index/{name}"


def _files(spark: SparkSession, store: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(store)
    return files.select(F.regexp_extract("path", r"archive=([^/]+)/", 1).alias("archive"), "content")


#: A gzip member's first bytes, with an extra field of 20 bytes: the member's size and 128 bits of its stored body's digest.
HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + b"\x18\0TM\x14\0"
#: An empty member, which follows every record's.
LAST = b"\x1f\x8b\x08\0\0\0\0\0\0\xff\x03\0" + bytes(8)
FIXED = len(HEAD) + 20


def pack_member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return HEAD + struct.pack("<I", FIXED + len(body)) + hashlib.sha256(body).digest()[:16] + body


def unpack_member(stored_bytes: bytes) -> bytes | None:
    """The content of a member and the empty one behind it; none if any stored byte is not as it was written."""
    end = len(stored_bytes) - len(LAST)
    body = stored_bytes[FIXED:end]
    if end < FIXED + 8 or stored_bytes[end:] != LAST or stored_bytes[:FIXED] != HEAD + struct.pack("<I", end) + hashlib.sha256(body).digest()[:16]:
        return None
    return zlib.decompress(body[:-8], -15)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            members = []
            for text, flip in zip(part.column("record"), part.column("flip").to_pylist()):
                member = pack_member(text.as_py().encode() + GAP.encode())
                if flip:
                    middle = (FIXED + len(member)) // 2
                    member = member[:middle] + bytes([member[middle] ^ 1]) + member[middle + 1:]
                members.append(member)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("copy", "archive", "no")], pa.array(members, pa.binary())], ["copy", "archive", "no", "member"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each record's member, with the empty one behind it, stands in a file just written."""
    for batch in batches:
        for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
            data, at, places = memoryview(content.as_buffer()).cast("B"), 0, []
            while at < len(data):
                size = struct.unpack_from("<I", data, at + len(HEAD))[0] + len(LAST)
                if data[at:at + len(HEAD)] != HEAD or data[at + size - len(LAST):at + size] != LAST:
                    raise ValueError(f"archive {archive} is not as written")
                places.append((at, size))
                at += size
            columns = [range(len(places)), *([p[k] for p in places] for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array([archive] * len(places), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["archive", "no", "at", "size"])


def read_ranges(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The manifest with ``found``, the digest of each record as it is in the store; null where its stored bytes are gone,
    cut off or changed. Each record's bytes are judged on their own."""
    index = spark.read.schema("archive string, no bigint, at bigint, size bigint").parquet(_index_folder(folder))
    ranges = manifest.select("archive", "no", "offset", "length").join(index, ["archive", "no"], "left")
    ranges = ranges.groupBy("archive").agg(F.collect_list(F.struct("no", "offset", "length", "at", "size")).alias("ranges"))
    schema = manifest.select("archive", "no", "offset", "length", F.lit(None).cast("string").alias("found")).schema
    return _files(spark, folder).join(ranges, "archive", "right").select("archive", "content", "ranges").mapInArrow(_digests, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the records in each archive's stored bytes."""
    for batch in batches:
        for n in range(batch.num_rows):
            content = batch.column("content")[n]
            data = memoryview(content.as_buffer()).cast("B") if content.is_valid else memoryview(b"")
            ranges, found = batch.column("ranges")[n].as_py(), []
            for r in ranges:
                record = None if r["at"] is None else unpack_member(bytes(data[r["at"]:r["at"] + r["size"]]))
                found.append(None if record is None else hashlib.sha256(record).hexdigest())
            columns = [[r[c] for r in ranges] for c in ("no", "offset", "length")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("archive")[n].as_py()] * len(ranges), pa.string()), *[pa.array(c, pa.int64()) for c in columns], pa.array(found, pa.string())],
                ["archive", "no", "offset", "length", "found"],
            )


def tree(ranges: DataFrame, digest: str, levels: int) -> list[DataFrame]:
    """Nodes of every level, records first: archive, node, offset, end, hash. A node folds its children's ranges and hashes."""
    nodes = ranges.filter(F.col(digest).isNotNull()).select(
        "archive", F.col("no").alias("node"), "offset", (F.col("offset") + F.col("length")).alias("end"), F.col(digest).alias("hash")
    )
    out = [stored(nodes, "tree-0", "zstd")]
    for n in range(levels):
        child = F.struct("node", "offset", "end", "hash")
        line = lambda c: F.concat_ws(":", c["offset"].cast("string"), c["end"].cast("string"), c["hash"])
        parents = out[-1].groupBy("archive", F.floor(F.col("node") / FAN_OUT).alias("parent")).agg(
            F.array_sort(F.collect_list(child)).alias("c")
        )
        level = parents.select(
            "archive", F.col("parent").alias("node"), F.array_min("c.offset").alias("offset"), F.array_max("c.end").alias("end"),
            F.sha2(F.array_join(F.transform("c", line), "\n"), 256).alias("hash"),
        )
        out.append(stored(level, f"tree-{n + 1}", "zstd"))
    return out


def tree_levels(records_per_archive: int = PER_ARCHIVE) -> int:
    levels, nodes = 1, FAN_OUT
    while nodes < records_per_archive:
        levels, nodes = levels + 1, nodes * FAN_OUT
    return levels


def mismatches(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """archive, no, expected, found: the records where two trees differ. Each level compares only the children of nodes
    that differ in the level above."""
    suspects = None
    for a, b in zip(reversed(one), reversed(other)):
        left = a.select("archive", "node", F.col("hash").alias("expected"))
        right = b.select("archive", "node", F.col("hash").alias("found"))
        if suspects is not None:
            parent = F.floor(F.col("node") / FAN_OUT)
            left, right = (x.withColumn("parent", parent).join(suspects, ["archive", "parent"], "left_semi").drop("parent") for x in (left, right))
        differ = left.join(right, ["archive", "node"], "full").filter(~F.col("expected").eqNullSafe(F.col("found")))
        differ = stored(differ, "differ")
        suspects = differ.select("archive", F.col("node").alias("parent"))
    return differ.withColumnRenamed("node", "no")


def audit(spark: SparkSession, manifest: DataFrame, store: str, replica: str) -> tuple[DataFrame, DataFrame]:
    """The records that differ between two stores, and the roots of the first."""
    levels = tree_levels()
    # A record that a store lacks has a mark of that store as its hash, so it differs even if both lack it.
    found = lambda side, folder: read_ranges(spark, folder, manifest).withColumn("found", F.coalesce("found", F.lit(f"lost in the {side}")))
    trees = [tree(found(side, folder), "found", levels) for side, folder in (("store", store), ("replica", replica))]
    return mismatches(*trees), trees[0][-1]
