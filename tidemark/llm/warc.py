"""A deterministic sharded WARC writer with revisit records, and its reader."""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.prefix import with_running_sum
from tidemark.llm.common import materialise

#: Compressed bytes after which a writer starts the next file.
ROLL = 32 << 20
#: Bytes meant for one shard, records' headers included; and shards, at most: beyond, shards get larger. Their borders take about 120 bytes each.
SHARD, SHARDS = 48 << 20, 200_000
#: Bytes counted for a record beside its payload.
HEAD = 512
#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: The date that records carry unless a column is named for it; a fixed one keeps files equal between runs.
DATE = "2024-01-01T00:00:00Z"

_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, file string"


def ident(key: str, copy: int = 0) -> str:
    """The record id of the row with this key; `copy` counts rows that are alike."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{key}:{copy}'.encode()).digest()[:16], version=5)}"


def _packed(lines: list[str], block: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def info(name: str) -> bytes:
    """The warcinfo record that every file begins with."""
    block = b"format: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{ident(name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return _packed([*lines, f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"], block)


def record(key: str, copy: int, page_id: int | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: int | None, refers_key: str | None) -> bytes:
    """One WARC/1.1 record, a gzip member of its own; a revisit carries no payload.

    The page's id, and a URL that is no plain URI, stand in headers of their own, so that they are read back exactly.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    raw = (url or "").encode("utf-8", "surrogatepass")
    uri = urllib.parse.quote(raw, safe="/:?#[]@!$&'()*+,;=%-._~")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ident(key, copy)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    lines += [] if uri.encode() == raw else [f"X-Target-URI: {base64.urlsafe_b64encode(raw).decode()}"]
    if revisit:
        lines += [f"WARC-Refers-To: <{ident(refers_key or '')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return _packed(lines, block)


def records(raw: bytes):
    """(headers, payload) of each record of a file's bytes; checks lengths and digests."""
    view, at = memoryview(raw), 0
    while at < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:  # a piece at a time: what follows a member is never copied as a whole
            piece = view[at : at + (1 << 16)]
            if not len(piece):
                raise ValueError("a file ends inside a record")
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        member = b"".join(parts)
        head, _, rest = member.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        if len(block) != int(headers["Content-Length"]) or f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
            raise ValueError("a record's block differs from its headers")
        if headers["WARC-Type"] == "warcinfo":
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(http.rsplit(b"Content-Length: ", 1)[1])
        if headers["WARC-Type"] == "response" and f"sha256:{hashlib.sha256(payload).hexdigest()}" != headers["WARC-Payload-Digest"]:
            raise ValueError("a payload differs from its digest")
        yield headers, length, payload


def _key(page_id: Column, digest: Column, url: Column, date: Column) -> Column:
    """A fixed-width string whose order is that of page_id (null first), then digest, then URL and date."""
    number = F.when(page_id.isNull(), F.lit("-" * 16)).otherwise(F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(number, digest, F.md5(F.to_json(F.struct(url.alias("u"), date.alias("d")))))


def shards(groups: DataFrame, shard_bytes: int) -> tuple[list[str], list[str], DataFrame]:
    """The first key of every shard; the keys whose rows, all alike, fill a shard or more; and those keys' pieces.

    groups: key, n, bytes (of all its rows). Shards are cut from the sums of bytes before each key in key order, so they
    follow from the data alone and hold about shard_bytes each, however the ids lie. Pieces: key, shard, first, copies.
    At most SHARDS keys of either sort reach the driver.
    """
    placed = with_running_sum(groups, [F.col("key")], "bytes", "before", materialise)
    shard = F.floor(F.col("before") / shard_bytes).cast("int")
    borders = placed.groupBy(shard.alias("shard")).agg(F.min("key").alias("key"))
    borders = materialise(borders, "warc-borders").orderBy("shard").collect()
    hot = placed.filter(F.col("bytes") > shard_bytes).withColumn("each", F.col("bytes") / F.col("n"))
    at = F.explode(F.sequence(shard, F.floor((F.col("before") + F.col("bytes") - F.col("each")) / shard_bytes).cast("int")))
    start = lambda s: F.least(F.greatest(F.ceil((s * shard_bytes - F.col("before")) / F.col("each")), F.lit(0)), F.col("n"))
    pieces = hot.select("key", "n", "before", "each", at.alias("shard")).select("key", "shard", start(F.col("shard")).alias("first"), start(F.col("shard") + 1).alias("last"))
    pieces = materialise(pieces.select("key", "shard", "first", (F.col("last") - F.col("first")).alias("copies")).filter("copies > 0"), "warc-pieces")
    # A shard that a hot key alone fills has no border of its own, so that numbers and borders are kept together.
    return [r["key"] for r in borders], [r["shard"] for r in borders], pieces


def write(pages: DataFrame, to: str, date: str | None = None) -> None:
    """Write pages (page_id, url, html) as WARC files below the folder `to`, and to/manifest when all are in place.

    date names a timestamp column for WARC-Date; without it all records carry DATE. Of equal payloads of LEAST bytes or more the
    smallest page_id is the response and the others are revisits of it; only digests are grouped and joined. Shards are cut
    by sums of bytes over the rows sorted by key; each is one task, which sorts its records and rolls files by compressed size. Rows
    that are alike and fill more than a shard are written from one of them, its copies dealt to several shards. A file
    is written under a temporary name and renamed; its name follows from the shard and its place, so a repeated
    attempt renames an equal file over it. Files not in the manifest don't count.
    """
    spark = pages.sparkSession
    target, base = fs.FileSystem.from_uri(to)
    target.create_dir(f"{base}/files", recursive=True)
    payload, page_id, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("page_id").cast("long"), F.col("url").cast("string")
    when = F.lit(DATE) if date is None else F.coalesce(F.date_format(F.col(date), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(DATE))
    digest = F.sha2(payload, 256)
    rows = pages.select(page_id.alias("page_id"), url.alias("url"), when.alias("date"), payload.alias("html"), digest.alias("payload_digest"))
    rows = rows.withColumn("key", _key(F.col("page_id"), F.col("payload_digest"), F.col("url"), F.col("date")))
    about = rows.select("key", "page_id", "payload_digest", F.octet_length("html").cast("long").alias("payload_bytes"))
    about = materialise(about.groupBy("key", "page_id", "payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n")), "warc-about")
    firsts = about.filter((F.col("payload_bytes") >= LEAST) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min(F.struct("page_id", "key")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = about.join(firsts, "payload_digest").filter("page_id <> first.page_id").select("page_id", "payload_digest", "first").distinct()
    groups = about.select("key", "n", (F.col("n") * (F.col("payload_bytes") + HEAD)).alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    shard_bytes = max(SHARD, total // SHARDS + 1)
    borders, numbers, pieces = shards(groups, shard_bytes)
    hot = sorted(r["key"] for r in pieces.select("key").distinct().collect())  # at most one for each shard
    told = spark.sparkContext.broadcast((np.array(borders, "S120"), np.array(numbers, np.int32), np.array(hot, "S120")))

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        edges, number, hottest = told.value
        names = key.to_numpy(object).astype("S120")
        found = number[np.maximum(np.searchsorted(edges, names, "right") - 1, 0)] if len(edges) else np.zeros(len(names), np.int32)
        return pd.Series(np.where(np.isin(names, hottest), -1, found))

    none = lambda kind: F.lit(None).cast(kind)
    dealt = rows.withColumn("shard", shard_of("key")).withColumns({"first": F.lit(0), "copies": F.lit(1), "refers_to": none("long"), "refers_key": none("string"), "kind": F.lit(1)})
    if hot:
        alike = rows.join(F.broadcast(pieces.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"]).join(F.broadcast(pieces), "key")
        same = alike.withColumns({"first": F.col("first").cast("int"), "copies": F.col("copies").cast("int"), "refers_to": none("long"), "refers_key": none("string"), "kind": F.lit(1)})
        dealt = dealt.filter("shard >= 0").unionByName(same)
    prefix = F.substring(_key(F.col("page_id"), F.col("payload_digest"), none("string"), none("string")), 1, 80)
    # The rows that a revisit's notice is for may lie on both sides of a border, and between.
    notice = revisits.select("page_id", none("string").alias("url"), none("string").alias("date"), none("string").alias("html"), "payload_digest", prefix.alias("key"), F.col("first.page_id").alias("refers_to"), F.col("first.key").alias("refers_key"))
    notice = notice.withColumns({"low": shard_of("key"), "high": shard_of(F.concat("key", F.lit("~")))}).withColumns({"first": F.lit(0), "copies": F.lit(1), "kind": F.lit(0)})
    notice = notice.withColumn("shard", F.explode(F.sequence("low", "high"))).drop("low", "high")
    last = max(numbers[-1] if numbers else 0, pieces.agg(F.max("shard")).first()[0] or 0)
    placed = dealt.unionByName(notice).repartitionById(last + 1, F.col("shard")).sortWithinPartitions("key", "kind", "first")

    def run(batches):
        target, base = fs.FileSystem.from_uri(to)
        out, place, size, count, sums, known, alike = None, -1, 0, 0, None, (None, None, None, None), (None, 0)
        kinds = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])

        def put(raw: bytes) -> None:
            nonlocal size
            out.write(raw)
            sums.update(raw)
            size += len(raw)

        def close() -> pa.RecordBatch:
            nonlocal out
            out.close()
            target.move(temporary, f"{base}/{name}")
            out = None
            return pa.RecordBatch.from_pylist([{"file": name, "bytes": size, "records": count, "sha256": sums.hexdigest()}], kinds)

        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    known = (r["page_id"], r["payload_digest"], r["refers_to"], r["refers_key"])
                    continue
                refers = known[2:] if known[:2] == (r["page_id"], r["payload_digest"]) else (None, None)
                before = alike[1] if alike[0] == r["key"] else r["first"]
                alike = (r["key"], before + r["copies"])
                html = r["html"].encode("utf-8", "surrogatepass")
                for copy in range(before, before + r["copies"]):
                    if out is not None and size >= ROLL:
                        yield close()
                    if out is None:
                        place, size, count, sums = place + 1, 0, 0, hashlib.sha256()
                        name = f"files/{r['shard']:08d}-{place:04d}.warc.gz"
                        temporary = f"{base}/files/.{uuid.uuid4().hex}.tmp"
                        out = target.open_output_stream(temporary, compression=None)
                        put(info(name))
                    put(record(r["key"], copy, r["page_id"], r["url"], r["date"], html, r["payload_digest"], *refers))
                    count += 1
        if out is not None:
            yield close()

    placed.mapInArrow(run, "file string, bytes long, records long, sha256 string").write.parquet(f"{to}/manifest")


def read(spark: SparkSession, at: str) -> DataFrame:
    """Every record of the archives that the manifest in folder `at` lists, with payloads; checks file and record digests.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits), file.
    """
    listed = spark.read.parquet(f"{at}/manifest").select("file", "bytes", "records", "sha256")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{at}/files").select(F.concat(F.lit("files/"), F.element_at(F.split("path", "/"), -1)).alias("file"), "content")
    whole = F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.lit("a file differs from the manifest")))

    def run(batches):
        for b in batches:
            for name, content, count in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), b.column("records").to_pylist(), strict=True):
                found = []
                for h, length, payload in records(content):
                    own, refers = (h.get(k, "") for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
                    revisit = h["WARC-Type"] == "revisit"
                    url = base64.urlsafe_b64decode(h["X-Target-URI"]).decode("utf-8", "surrogatepass") if "X-Target-URI" in h else h["WARC-Target-URI"]
                    found.append((int(own) if own else None, length, h["WARC-Payload-Digest"][7:], h["WARC-Type"], int(refers) if refers else None, url, None if revisit else payload, name))
                    if len(found) == 256:
                        yield _batch(found)
                        count, found = count - 256, []
                if len(found) != count:
                    raise ValueError("a file has other records than the manifest says")
                yield _batch(found)

    return files.join(listed, "file").select("file", whole.alias("content"), "records").mapInArrow(run, _FOUND)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])


def round_trip(pages: DataFrame, to: str) -> DataFrame:
    """Write pages to `to`, read the archives back, and give each record's page_id, payload_bytes, payload_digest, record_type and refers_to.

    pages: page_id long, url, html; other columns are ignored. Null html: an empty payload. Null url: an empty one.
    Null page_id: a response, never a revisit, and never referred to. Payloads under LEAST bytes: always responses.
    Repeated page_ids: each row is a record with a record id of its own; rows equal to the response in id and payload are responses too. Empty table: no rows.
    """
    write(pages, to)
    return read(pages.sparkSession, to).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY html)
SELECT page_id, payload_bytes::bigint AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON payload_bytes >= 100 AND p.html = f.html
"""
