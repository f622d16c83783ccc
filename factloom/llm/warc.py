"""WARC archives as chunked record tables.

A record travels as rows (record id, chunk number, bytes, running digest). The JVM cuts a payload over the chunk size into
rows before any Python sees it; the first becomes a record and the others continuation records, as WARC/1.1 segments
them. Writer and reader feed digests chunk by chunk and hold no more than a chunk; each segment carries the digest of the
payload through it. Archives are written by Spark's text writer (bytes pass unchanged; its line separator is the CRLF CRLF
that ends a record), so any file system Spark knows will do, and commits survive lost executors. They are read back with
that separator, joined again, and taken apart by Content-Length, so payloads may hold separators too.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, the one of the smallest id is the response; the rest
are revisits without payload, which name it. Only digests decide that: payloads that occur once go from the scan to the
archive without a shuffle; of those that occur again one copy for each task travels, to become the response.

Edge cases: a null payload is empty. Null ids come last in their order, and a record's name in the archive doesn't hang on
its id, so null and equal ids do no harm: of rows with equal ids and payloads one is the response and the others revisit
it, under the same id; revisits of a response without an id have refers_to null. Null addresses become empty. A payload of
any length passes in chunks. An empty table gives an archive without records, and no rows. Columns other than the named
ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from factloom.llm.shared import Scratch, partitions, sieve

CHUNK, MIN_REVISIT = 1 << 20, 100
#: Tasks among which the revisits of one response are dealt.
SALTS = 16
END = b"\r\n\r\n"
RECORD = "page_id long, url string, payload binary, digest string, length long, record_type string, refers_to long"
_CHUNK = "record string, page_id long, chunk_no long, last boolean, data binary, offset long, through string, record_type string, refers_to long, digest string, length long"


def roles(pages: DataFrame, scratch: Scratch, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """RECORD rows of pages (page_id, url, payload binary), payload null in revisits. ``pages`` is read twice."""
    pages = pages.withColumn("payload", F.coalesce("payload", F.lit(b""))).withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    long_ = F.col("length") >= min_revisit
    again = pages.where(long_).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    again = scratch.table(again.select(F.xxhash64("digest").alias("k")), "again")
    pages = pages.withColumn("_maybe", long_ & sieve(again, "k")(F.xxhash64("digest")))
    plain = lambda df: df.select("page_id", "url", "payload", "digest", "length", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    once, maybe = pages.where("NOT _maybe"), pages.where("_maybe")
    # The response: the first row by id and address. Its payload is any of the group's, which are equal.
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    first = maybe.groupBy("digest").agg(F.min(order).alias("f"), F.first("payload").alias("payload"), F.first("length").alias("length"))
    responses = plain(first.select("f.page_id", "f.url", "payload", "digest", "length"))
    # The revisits: how often each (digest, id, address) occurs, less one for the response.
    rows = maybe.groupBy("digest", "page_id", F.coalesce("url", F.lit("")).alias("url")).agg(F.count("*").alias("n"), F.first("length").alias("length"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    named = maybe.groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("all")).where("all > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.join(named, ["digest", "_salt"])
    own = F.col("f.page_id").eqNullSafe(F.col("page_id")) & (F.col("f.url") == F.col("url"))
    rows = rows.withColumn("n", F.col("n") - own.cast("long")).where("n > 0")
    revisits = rows.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "length", F.lit("revisit").alias("record_type"), F.col("f.page_id").alias("refers_to"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_n")).drop("_n")
    return plain(once).unionByName(responses).unionByName(revisits)


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """RECORD rows cut into rows of one chunk each, in order: chunk_no, last and data in the place of the payload."""
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("payload"), F.lit(0)) / chunk)).cast("int")
    rows = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("last", F.col("chunk_no") == parts - 1)
    data = F.expr(f"substring(coalesce(payload, X''), chunk_no * {chunk} + 1, {chunk})")
    return rows.withColumn("data", data).drop("payload")


def write_archives(records: DataFrame, path: str, chunk: int = CHUNK, min_revisit: int = MIN_REVISIT) -> None:
    """Write RECORD rows under ``path`` as gzipped WARC files, one for each task.

    A response of ``min_revisit`` bytes or more is named by its digest, which no other has; any other record by its task
    and place in it.
    """

    def written(batches):
        out, size, n, name, origin, digest, offset = [], 0, 0, "", "", None, 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for i in range(batch.num_rows):
                k, last, page, kind, refers, stated, length, url = (batch.column(c)[i].as_py() for c in ("chunk_no", "last", "page_id", "record_type", "refers_to", "digest", "length", "url"))
                data = batch.column("data")[i].as_buffer()
                if not k:
                    n += 1
                    named = kind == "response" and length >= min_revisit
                    origin, digest, offset = f"<urn:sha256:{stated}>" if named else f"<urn:factloom:{task}:{n}>", hashlib.sha256(), 0
                name = origin if not k else f"{origin[:-1]}:{k}>"
                digest.update(data)
                url = re.sub(r"[\x00-\x20\x7f]+", "%20", url or "")
                head = [f"WARC-Type: {'continuation' if k else kind}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}"]
                if not k:
                    head += [f"WARC-Payload-Digest: sha256:{stated}", f"X-Payload-Length: {length}"]
                    head += [] if page is None else [f"X-Page: {page}"]
                if kind == "revisit":
                    head += [f"WARC-Refers-To: <urn:sha256:{stated}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                    head += [] if refers is None else [f"X-Refers-To-Page: {refers}"]
                if k or not last:
                    head += [f"WARC-Segment-Number: {k + 1}", f"X-Segment-Offset: {offset}", f"X-Digest-Through: sha256:{digest.copy().hexdigest()}"]
                offset += len(data)
                if k:
                    head += [f"WARC-Segment-Origin-ID: {origin}"]
                if k and last:
                    head += [f"WARC-Segment-Total-Length: {offset}"]
                if last and kind == "response" and (digest.hexdigest(), offset) != (stated, length):
                    raise ValueError(f"chunks of {origin} are out of place")
                head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(data).hexdigest()}", f"Content-Length: {len(data)}"]
                out.append(b"".join([b"WARC/1.1\r\n", "\r\n".join(head).encode(), END, data]))
                size += len(data)
                if size > 4 * chunk or len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["data"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["data"])

    bytes_ = chunked(records, chunk).mapInArrow(written, "data binary")
    bytes_.select(F.col("data").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the archives under ``path``: one for each chunk, with its place in the payload and the digest through it; headers stand in chunk 0.

    A gzipped archive is one task; files are as small as their writers' tasks.
    """
    raw = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary"))

    def parse(batches):
        head, need, left = None, 0, bytearray()
        for batch in batches:
            out = []
            for cell in batch.column(0):
                left += cell.as_buffer()
                left += END  # of the record, or bytes of its block
                while True:
                    if head is None:
                        at = left.find(END)
                        while at == 0:  # a block's own line breaks shifted the last separator of a file
                            del left[:4]
                            at = left.find(END)
                        if at < 0:
                            break
                        lines = left[:at].decode().split("\r\n")
                        if lines[0] != "WARC/1.1":
                            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
                        head = dict(x.split(": ", 1) for x in lines[1:])
                        need = int(head["Content-Length"])
                        del left[: at + 4]
                    if len(left) < need + 4:
                        break
                    data = bytes(left[:need])
                    if left[need : need + 4] != END or f"sha256:{hashlib.sha256(data).hexdigest()}" != head["WARC-Block-Digest"]:
                        raise ValueError(f"length or digest of {head['WARC-Record-ID']}")
                    del left[: need + 4]
                    out.append(_row(head, data))
                    head = None
            if out:
                yield pa.RecordBatch.from_pylist(out, _ROWS)
        if head is not None:
            raise ValueError("an archive ends within a record")

    return raw.mapInArrow(parse, _CHUNK)


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_ROWS = pa.schema([(c, _KINDS[t]) for c, t in (x.split() for x in _CHUNK.split(", "))])


def _row(head: dict, data: bytes) -> dict:
    number = int(head.get("WARC-Segment-Number", 1))
    whole = lambda key: int(head[key]) if key in head else None
    plain = lambda key: head[key].removeprefix("sha256:") if key in head else None
    first = head["WARC-Type"] != "continuation"
    return {
        "record": head["WARC-Record-ID" if first else "WARC-Segment-Origin-ID"], "page_id": whole("X-Page"), "chunk_no": number - 1, "last": "WARC-Segment-Total-Length" in head or "WARC-Segment-Number" not in head, "data": data,
        "offset": whole("X-Segment-Offset") or 0, "through": plain("X-Digest-Through"), "record_type": head["WARC-Type"] if first else None, "refers_to": whole("X-Refers-To-Page"), "digest": plain("WARC-Payload-Digest"), "length": whole("X-Payload-Length"),
    }


def records_of(chunks: DataFrame) -> DataFrame:
    """One row for each record: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Single chunks are digested where they are read; only chunks of longer payloads are brought together, sorted by number
    and fed into an incremental digest, which must agree with what each segment states. A digest or place other than the
    archive states raises.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def digest(batches):
        now, head, size, digest_, want = None, None, 0, None, 0
        for batch in batches:
            out = []
            cols = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                r = {c: cols[c][i].as_py() for c in cols if c != "data"}
                data = cols["data"][i].as_buffer()
                if r["chunk_no"] == 0:
                    if now is not None:
                        raise ValueError(f"record {now} lacks its last chunk")
                    now, head, size, digest_, want = r["record"], r, 0, hashlib.sha256(), 0
                if r["record"] != now or r["chunk_no"] != want or r["offset"] != size:
                    raise ValueError(f"chunk {r['chunk_no']} of record {r['record']} is out of place")
                digest_.update(data)
                size, want = size + len(data), want + 1
                if r["through"] is not None and r["through"] != digest_.copy().hexdigest():
                    raise ValueError(f"digest of record {now} through chunk {r['chunk_no']}")
                if r["last"]:
                    if head["record_type"] == "response" and (size, digest_.hexdigest()) != (head["length"], head["digest"]):
                        raise ValueError(f"payload of record {now}")
                    out.append(dict(zip(names, (head["page_id"], head["length"], head["digest"] if head["record_type"] == "revisit" else digest_.hexdigest(), head["record_type"], head["refers_to"]), strict=True)))
                    now = None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            raise ValueError(f"record {now} lacks its last chunk")

    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    alone = (F.col("chunk_no") == 0) & F.col("last")
    short = chunks.where(alone).mapInArrow(digest, out)
    long_ = chunks.where(~alone).repartition(partitions(chunks.sparkSession), "record").sortWithinPartitions("record", "chunk_no")
    return short.unionByName(long_.mapInArrow(digest, out))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK, min_revisit: int = MIN_REVISIT, path: str | None = None) -> DataFrame:
    """Write one record for each row of pages, read the archives back, and return what they hold."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = path or scratch.path("archives")
    payload = F.col(payload_col) if dict(pages.dtypes)[payload_col] == "binary" else F.encode(F.col(payload_col), "UTF-8")
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    write_archives(roles(named, scratch, min_revisit), path, chunk, min_revisit)
    return records_of(read_archives(pages.sparkSession, path))
