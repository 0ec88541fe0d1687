"""WARC fixity audit with Merkle trees: two replicas are compared by their roots, then down mismatching branches.

A replica is a table of records: file, offset, bytes. Each record is hashed where it lies; only (file, offset,
length, digest) goes on. A file's offsets are cut into ranges of `span` bytes; a leaf hashes the offsets
and digests of the records that start in its range, and `fanout` neighbouring nodes make a node of the next level,
up to one root per file. Trees are written, as a fixity store would keep them.

The audit joins the roots. From each level it passes on only the children of nodes that differ, so the work
below the roots follows the damage, not the archive. At the leaves, the records of differing ranges
are compared: changed, missing or extra.

Defined cases: null bytes are a record of no bytes; null files or offsets are values like any other; records
repeated at one offset are compared as a multiset of digests; an empty replica makes every record of the
other missing or extra; two empty ones give an empty result; further columns are ignored.
"""

from __future__ import annotations

import gzip
import re
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.scratch import settle

CRLF = "\r\n"


def warc_records(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    """Pages as WARC records in crawl order, `per_file` ids to a file; the record's bytes as `record`."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"),
                    F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">{CRLF}WARC-Target-URI: "), url,
                    F.lit(f"{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    return pages.select(
        F.floor(F.coalesce("page_id", F.lit(0)) / per_file).cast("long").alias("file"), "page_id",
        F.encode(F.concat(head, html, F.lit(CRLF + CRLF)), "UTF-8").alias("record"))


def hashed(records: DataFrame) -> DataFrame:
    """file, offset, length, digest of records that have their offset and bytes (`record`)."""
    body = F.coalesce("record", F.lit(b""))
    return records.select("file", "offset", F.octet_length(body).cast("long").alias("length"), F.sha2(body, 256).alias("digest"))


def laid_out(records: DataFrame, order: str = "page_id") -> DataFrame:
    """Hashes records and gives each the offset it has when a file's records follow one another."""
    body = F.coalesce("record", F.lit(b""))
    rows = records.select("file", order, F.octet_length(body).cast("long").alias("length"), F.sha2(body, 256).alias("digest"))
    before = Window.partitionBy("file").orderBy(order, "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset and record of .warc and .warc.gz files (each record its own gzip member)."""

    def split(data: bytes, zipped: bool):
        at = 0
        while at < len(data):
            if zipped:
                z = zlib.decompressobj(wbits=31)
                body = z.decompress(data[at:])
                size = len(data) - at - len(z.unused_data)
                yield at, body
            else:
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    yield at, data[at:]
                    return
                told = re.search(rb"(?im)^content-length:\s*(\d+)", data[at:end])
                size = end + 4 - at + (int(told[1]) if told else 0) + 4
                yield at, data[at:at + size]
            at += max(size, 1)

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for path_, data in zip(pdf["path"], pdf["content"]):
                rows = list(split(bytes(data), path_.endswith(".gz")))
                yield pd.DataFrame({"file": [path_.rsplit("/", 1)[-1]] * len(rows), "offset": [r[0] for r in rows],
                                    "record": [r[1] for r in rows]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, offset long, record binary")


def zipped(record: bytes) -> bytes:
    return gzip.compress(record, 6, mtime=0)


def tree(leaves: DataFrame, levels: int, span: int, fanout: int) -> DataFrame:
    """file, level, node, digest of every node of each file's tree; `leaves` has file, offset, digest."""
    entry = F.concat_ws(":", F.coalesce(F.col("offset").cast("string"), F.lit("")), "digest")
    nodes = settle(leaves.groupBy("file", F.floor(F.col("offset") / span).cast("long").alias("node"))
                   .agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "\n"), 256).alias("digest"))
                   .select("file", F.lit(0).alias("level"), "node", "digest"), "merkle-0")
    out = nodes
    for level in range(1, levels + 1):
        child = F.concat_ws(":", F.coalesce(F.col("node").cast("string"), F.lit("")), "digest")
        nodes = settle(nodes.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("up"))
                       .agg(F.sha2(F.array_join(F.sort_array(F.collect_list(child)), "\n"), 256).alias("digest"))
                       .select("file", F.lit(level).alias("level"), F.col("up").alias("node"), "digest"), f"merkle-{level}")
        out = out.unionByName(nodes)
    return out


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, node) whose digest is not the same on both sides."""
    a, b = left.select("file", "node", F.col("digest").alias("a")), right.select("file", "node", F.col("digest").alias("b"))
    both = a.alias("l").join(b.alias("r"), F.expr("l.file <=> r.file and l.node <=> r.node"), "full")
    return both.where("not (a <=> b)").selectExpr("coalesce(l.file, r.file) as file", "coalesce(l.node, r.node) as node")


def _within(rows: DataFrame, marked: DataFrame, node) -> DataFrame:
    """The rows whose node is marked."""
    m = marked.select(F.col("file").alias("m_file"), F.col("node").alias("m_node"))
    return rows.join(m, rows["file"].eqNullSafe(F.col("m_file")) & node.eqNullSafe(F.col("m_node")), "left_semi")


def audit(left: DataFrame, right: DataFrame, span: int = 1 << 18, fanout: int = 16) -> DataFrame:
    """file, offset, status (changed, missing, extra), and the digests, of what `right` has otherwise than `left`.

    Both sides have file, offset, length, digest and should be cheap to read twice (written tables)."""
    most = max((df.agg(F.max("offset")).first()[0] or 0) for df in (left, right)) // span
    levels = 1
    while most >= fanout ** levels:
        levels += 1
    trees = [settle(tree(df, levels, span, fanout), "merkle") for df in (left, right)]
    marked = settle(_differing(*[t.where(F.col("level") == levels) for t in trees]), "merkle-differing")
    for level in range(levels - 1, -1, -1):
        below = [t.where(F.col("level") == level) for t in trees]
        marked = settle(_differing(*[_within(t, marked, F.floor(t["node"] / fanout).cast("long")) for t in below]),
                        "merkle-differing")
    rows = [_within(df, marked, F.floor(df["offset"] / span).cast("long")).groupBy("file", "offset").agg(
        F.sort_array(F.collect_list("digest")).alias("digests")) for df in (left, right)]
    a, b = rows[0].alias("l"), rows[1].alias("r")
    both = a.join(b, F.expr("l.file <=> r.file and l.offset <=> r.offset"), "full").where("not (l.digests <=> r.digests)")
    return both.selectExpr(
        "coalesce(l.file, r.file) as file", "coalesce(l.offset, r.offset) as offset",
        "case when r.digests is null then 'missing' when l.digests is null then 'extra' else 'changed' end as status",
        "array_join(l.digests, ' ') as expected", "array_join(r.digests, ' ') as found")
