"""WARC archives with revisit resolution.

Headers (id, size and digest) are shuffled by payload digest: of records with one payload, one response keeps it and the others become revisit
records that refer to it. The payloads meet their decisions by id and digest, so that a payload that many pages share is spread over all tasks.
Deduplicated archives are written with fresh headers, each record a gzip member of its own; Spark's text writer puts them to any
file system that it knows, under its commit protocol, with an empty gzip member as its line separator. So an archive is a valid sequence of members, and is read
record by record, whatever its size. Reading back joins each revisit to the response that it refers to.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, in_arrow, shared_dir

LEAST_BYTES = 1000
END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member of nothing. It can't occur within a member of UTF-8 text: 1F 8B is no UTF-8, and deflated data hold such 20 bytes by no chance.
EMPTY = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
HEADER_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"
READ_SCHEMA = HEADER_SCHEMA + ", payload string"
KINDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.string()}


def payload_of(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each row of pages.

    Digests that occur more than once are counted with map-side combination and checkpointed, so that Spark can split the join of the headers that share
    one. A null html is an empty payload. Of equal page_ids with equal payloads, each that has the largest id is a response; a null id is the least of all.
    """
    key = ["payload_digest", "payload_bytes"]
    heads = payload_of(pages).where(F.col("payload_bytes") >= least_bytes).select("page_id", *key)
    shared = heads.groupBy(*key).agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").drop("n")
    again = heads.join(checkpoint(shared), key).where(~F.col("page_id").eqNullSafe(F.col("original")))
    again = checkpoint(again.select(F.col("page_id").alias("again"), F.col("payload_digest").alias("digest"), F.col("original").alias("refers_to"), F.lit(True).alias("found")).distinct())
    rows = payload_of(pages)
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["again"]) & (rows["payload_digest"] == again["digest"]), "left")
    return rows.select("page_id", "url", "payload", *reversed(key), F.when(F.col("found"), "revisit").otherwise("response").alias("record_type"), "refers_to")


def record_id(number: int | None, of: str = "page") -> str:
    """urn:uuid made of the page's id, so that a record that is written again gets the same one."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{of}:{number}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, again: bool) -> bytes:
    """A WARC record: a response with its HTTP headers and payload, or a revisit with neither."""
    block = b"" if again else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END + payload
    head = {
        "WARC-Type": "revisit" if again else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": (url or "urn:none").replace("\r", "").replace("\n", ""),
        "WARC-Page-ID": "null" if page_id is None else str(page_id),
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if again:
        head |= {"WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Page-ID": str(refers_to), "WARC-Profile": PROFILE}
    return framed(head | {"Content-Type": "application/http; msgtype=response"}, block)


def framed(head: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def warcinfo(number: int) -> bytes:
    return framed({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(number, "archive"), "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"software: lodestone\r\nformat: WARC File Format 1.1\r\n")


def member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def raw_strings(values: list[bytes]) -> pa.Array:
    """Bytes as a string column, as they are: Spark's text writer copies them."""
    a = pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(a), a.buffers(), a.null_count)


def write_archives(resolved: DataFrame, folder: str) -> None:
    """An archive for each task, that begins with a warcinfo record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, size = [member(warcinfo(task.partitionId() if task else 0))], 0
        for b in batches:
            cells = (b.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "record_type"))
            for page, url, payload, digest, other, kind in zip(*cells, strict=True):
                payload = payload.as_buffer().to_pybytes() if kind.as_py() == "response" else b""
                out.append(member(record(page.as_py(), url.as_py(), payload, digest.as_py(), other.as_py(), kind.as_py() == "revisit")))
                size += len(out[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([raw_strings(out)], ["record"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([raw_strings(out)], ["record"])

    lines = resolved.transform(in_arrow, run, "record string")
    lines.write.mode("overwrite").option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of each record. A broken one raises ValueError."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        first, *lines = data[at:stop].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        size = int(head["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size or data[stop + 4 + size : stop + 8 + size] != END:
            raise ValueError(f"the record at byte {at} is cut off")
        yield head, block
        at = stop + 8 + size


def row_of(head: dict[str, str], block: bytes) -> tuple | None:
    """READ_SCHEMA of a response or revisit, with the payload in bytes; None for other records. A response whose digest is wrong raises ValueError."""
    if head["WARC-Type"] not in ("response", "revisit"):
        return None
    page, other = head["WARC-Page-ID"], head.get("WARC-Refers-To-Page-ID")
    again, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None if again else block[block.index(END) + 4 :]
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"digest mismatch on page {page}")
    return None if page == "null" else int(page), head["WARC-Target-URI"], "revisit" if again else "response", digest, None if again else len(payload), int(other) if other else None, payload


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder: READ_SCHEMA, or HEADER_SCHEMA alone. Archives are split at members, one of which is in memory at a time."""
    lines = spark.read.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder).select(F.col("value").cast("binary").alias("value"))
    names = list(KINDS) if payloads else list(KINDS)[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for x in b.column("value"):
                for head, block in parse(zlib.decompress(x.as_buffer(), 31)):
                    if (r := row_of(head, block)) is not None:
                        rows.append(r[: len(names)])
                        size += len(block) if payloads else 100
                if size > 4 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[n]) for c, n in zip(columns, names, strict=True)], names)

    return lines.transform(in_arrow, run, READ_SCHEMA if payloads else HEADER_SCHEMA)


def restore(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record that was read.

    A revisit's size comes from the response that it refers to, and one whose response is missing or has another digest raises an error.
    """
    rows = checkpoint(found.select("page_id", "payload_digest", "payload_bytes", "record_type", "refers_to"))
    head = F.col("record_type") == "response"
    originals = checkpoint(rows.where(head).groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("size")))
    joined = rows.where(~head).join(originals, ["refers_to", "payload_digest"], "left")
    size = F.coalesce("size", F.raise_error(F.concat(F.lit("no response for page "), F.col("page_id").cast("string"))).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where(head).select(*columns).unionByName(joined.withColumn("payload_bytes", size).select(*columns))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes a deduplicated record for each page to archives in the shared folder, and returns what reading them gives; the archives are removed then.

    An empty table writes no record and gives no rows; columns other than page_id, url and html are ignored."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    write_archives(resolve(pages), folder)
    out = restore(read_archives(spark, folder, payloads=False))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
