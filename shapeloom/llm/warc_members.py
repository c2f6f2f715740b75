"""WARC archives: a writer, a normaliser for monolithic gzip files, and a reader by offset index.

Some archives are one gzip stream over all their records, so nothing can be read without inflating everything before it. The
normaliser inflates such a file once, as a stream, writes every record as a gzip member of its own, and puts the offset and
length of each member into a sidecar index, by which a reader takes single records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import commit_file, filesystem, materialize, slices, table_folder

DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
#: Uncompressed bytes in an archive file, about; one record more fits always.
FILE_BYTES = 64 << 20


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record. A revisit (refers_to isn't None) has the HTTP head only and says the payload's size and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = f"urn:page:{quote(page_id, safe='')}" if page_id is not None else f"urn:nameless:{digest}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}"] if url is not None else []
    head += [f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(rec: bytes) -> dict:
    """Headers of a record in lower case, and its block under ''."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    out[""] = rest[: int(out["content-length"])]
    return out


def inflated(stream) -> object:
    """Pieces of the data of a gzip file, of one member or many. A file that ends within a member (one byte of its trailer missing
    is enough) is an error, as its records may be fewer than were written."""
    z, started = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            started = True
            if piece := z.decompress(data, CHUNK):
                yield piece
            data = z.unconsumed_tail
            if z.eof:
                data = z.unused_data
                z, started = zlib.decompressobj(31), False
    if piece := z.flush():
        yield piece
    if started and not z.eof:
        raise ValueError("the archive ends within a gzip member")


def records(pieces):
    """Whole records from pieces of a WARC file; no more than one record is held."""
    buf = bytearray()
    need = None
    for piece in pieces:
        buf += piece
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                sizes = [x.split(b":", 1)[1] for x in bytes(buf[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
                need = end + 4 + int(sizes[0]) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = None
    if buf.strip():
        raise ValueError("the archive ends within a record")


def normalise(uri: str, to: str) -> tuple[int, int]:
    """Rewrite the archive at uri into to, a member for each record, and the index into to + '.idx'. Returns records and bytes."""
    fs, path = filesystem(uri)
    out_fs, out_path = filesystem(to)
    part, index, at = f"{out_path}.{uuid.uuid4().hex}.tmp", [], 0
    with fs.open_input_stream(path, compression=None) as stream, out_fs.open_output_stream(part, compression=None) as out:
        for rec in records(inflated(stream)):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(rec) + z.flush()
            out.write(member)
            index.append(f"{at} {len(member)}\n")
            at += len(member)
    out_fs.move(part, out_path)
    commit_file(f"{to}.idx", "".join(index).encode())
    return len(index), at


def read_members(uri: str):
    """The records of a normalised archive, each inflated alone from its place in the index."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(f"{path}.idx", compression=None) as f:
        index = [tuple(map(int, x.split())) for x in f.read().decode().splitlines()]
    with fs.open_input_file(path) as f:
        for at, size in index:
            yield zlib.decompress(f.read_at(size, at), 31)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """_id, _url, _html, _digest, _refers of every row: of equal payloads of at least `least` bytes the smallest id is the response.

    A null payload is empty. A row whose id is null refers to the smallest id of its group, if there is one; rows that repeat the
    smallest id are all responses. Groups are aggregated before they are joined, so their size doesn't matter."""
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].alias("_id"), pages[url_col].cast("string").alias("_url"), html.alias("_html"), F.sha2(html, 256).alias("_digest"))
    first = rows.filter(F.octet_length("_html") >= least).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 and _first is not null")
    first = materialize(first.drop("_n"), "warc-groups")
    refers = F.when(F.col("_id").isNull() | (F.col("_id") > F.col("_first")), F.col("_first"))
    return rows.join(first, "_digest", "left").select("_id", "_url", "_html", "_digest", refers.alias("_refers"))


def write_archives(planned: DataFrame, out_dir: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write each partition's records into whole-file gzip streams under out_dir; returns their uris (written once, kept)."""
    planned = planned.select(F.col("_id").cast("string"), "_url", "_html", "_digest", F.col("_refers").cast("string"))

    def run(batches):
        z = sink = None
        fs, base = filesystem(out_dir)
        fs.create_dir(base, recursive=True)

        def close():
            sink.write(z.flush())
            sink.close()
            fs.move(f"{base}/{name}.tmp", f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{out_dir}/{name}"])], names=["uri"])

        for b in slices(batches, 8 << 20):
            for page_id, url, html, digest, refers in zip(*[c.to_pylist() for c in b.columns]):
                if sink is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0  # only names that reach the manifest count
                    z, sink = zlib.compressobj(1, zlib.DEFLATED, 31), fs.open_output_stream(f"{base}/{name}.tmp", compression=None)
                rec = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                sink.write(z.compress(rec))
                size += len(rec)
                if size >= file_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return materialize(planned.mapInArrow(run, "uri string"), "warc-written")


def normalise_archives(written: DataFrame, out_dir: str) -> DataFrame:
    """Normalise every archive of `uri`, each by one task, which may have several; returns uri, records, bytes of the new ones.

    A file that is cut short or isn't WARC fails the job with its error; an empty table gives an empty result."""

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                to = f"{out_dir}/{uri.rsplit('/', 1)[1]}"
                fs, path = filesystem(out_dir)
                fs.create_dir(path, recursive=True)
                n, size = normalise(uri, to)
                yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["uri", "records", "bytes"])

    return materialize(_spread(written).mapInArrow(run, "uri string, records long, bytes long"), "warc-normal")


def _spread(files: DataFrame) -> DataFrame:
    n = files.count()
    return files.select("uri").repartition(max(1, min(n, 100_000)), "uri")


def read_archives(normal: DataFrame, id_type: T.DataType) -> DataFrame:
    """_id, _bytes, _digest, _type, _refers of every record; a response's size and digest are taken from its payload as read."""

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows: list[tuple] = []
                for rec in read_members(uri):
                    r = parse(rec)
                    head, _, payload = r[""].partition(b"\r\n\r\n")
                    name = r["warc-record-id"][1:-1]
                    page = unquote(name[9:]) if name.startswith("urn:page:") else None
                    if r["warc-type"] == "revisit":
                        size = next(int(x[16:]) for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))
                        rows.append((page, size, r["warc-payload-digest"][7:], "revisit", unquote(r["warc-refers-to"][10:-1])))
                    else:
                        rows.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "response", None))
                for k in range(0, len(rows), 10_000):
                    c = list(zip(*rows[k : k + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string())], names=["_id", "_bytes", "_digest", "_type", "_refers"])

    got = _spread(normal).mapInArrow(run, "_id string, _bytes long, _digest string, _type string, _refers string")
    return got.withColumn("_id", F.col("_id").cast(id_type)).withColumn("_refers", F.col("_refers").cast(id_type))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    top = table_folder(spark, "warc")
    normal = normalise_archives(write_archives(plan_records(pages), f"{top}/whole"), f"{top}/members")
    got = read_archives(normal, pages.schema["page_id"].dataType)
    return got.select(F.col("_id").alias("page_id"), F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), F.col("_type").alias("record_type"), F.col("_refers").alias("refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
