"""WARC archives: monolithic gzip files rewritten with a gzip member per record and an offset index beside them."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, map_frames, pick, table, with_key_value
from docloom.sources.files import arrow_uri, opened

#: Bytes of payload and records after which a task begins another archive.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 16_000_000, 20_000
#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 100
CHUNK = 1 << 20
GZIP = 31


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def record(kind: str, page: str, block: bytes, payload_bytes: int, digest: str, refers_to: str | None = None) -> bytes:
    """A WARC record; a revisit has an empty block and names the page that it refers to."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{page}>", "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(payload_bytes)}
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """Fields of the record at the start of data and the place of its block; (.., -1) if its head isn't whole."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return {}, -1
    lines = data[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) for x in lines[1:]), end + 4


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a gzip stream, one or many members, inflated once; only the record at hand is held."""
    inflate, held = zlib.decompressobj(GZIP), bytearray()
    for chunk in chunks:
        while chunk:
            held += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if chunk:
                inflate = zlib.decompressobj(GZIP)
        while True:
            head, at = parse_head(bytes(held[:4096])) if held else ({}, -1)
            if at < 0:
                break
            end = at + int(head["Content-Length"])
            if len(held) < end + 4:
                break
            yield head, bytes(held[at:end])
            del held[: end + 4]
    if held:
        raise ValueError("the archive ends inside a record")


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, GZIP)
    return z.compress(data) + z.flush()


class _File:
    """A file that appears under its name when it is whole; a task that runs again replaces it by the same bytes."""

    def __init__(self, path: str):
        self.fs, self.path = opened(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def _name(page) -> str:
    return "none" if page is None or page is pd.NA else str(page)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, html) as monolithic gzip archives, a stream per file, and list their records.

    A partition writes its own archives, named after it, so nothing is shuffled and a task that
    runs again writes the same files. Null html is an empty payload.
    """
    folder = arrow_uri(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, file, gz = TaskContext.get().partitionId(), 0, None, None
        size = count = 0
        for b in batches:
            listed = []
            for page, html, digest in zip(b["page_id"], b["html"], b["digest"]):
                if file is None:
                    path = f"{folder}/crawl-{part:06d}-{n:05d}.warc.gz"
                    file, gz, size, count = _File(path), zlib.compressobj(1, zlib.DEFLATED, GZIP), 0, 0
                html = bytes(html)
                file.out.write(gz.compress(record("response", _name(page), _http(html), len(html), digest)))
                listed.append((path, count, len(html)))
                size, count = size + len(html), count + 1
                if size >= ARCHIVE_BYTES or count >= ARCHIVE_RECORDS:
                    file.out.write(gz.flush())
                    file.close()
                    file, n = None, n + 1
            made = pd.DataFrame(listed, columns=["archive", "n", "payload_bytes"])
            yield made.assign(page_id=b["page_id"].to_numpy(), payload_digest=b["digest"].to_numpy())[["archive", "n", "page_id", "payload_bytes", "payload_digest"]]
        if file is not None:
            file.out.write(gz.flush())
            file.close()

    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    return map_frames(rows, run, "archive string, n long, page_id long, payload_bytes long, payload_digest string")


def decide(listed: DataFrame) -> DataFrame:
    """Add record_type and refers_to: of equal payloads of LEAST_REVISIT bytes the smallest page is kept, others revisit it.

    Of repeated page ids the first record is kept. Pages without an id come last.
    """
    big = F.col("payload_bytes") >= LEAST_REVISIT
    order = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("rank"), "archive", "n", "page_id")
    spread = F.xxhash64("archive", "n")
    first = with_key_value(listed.where(big), "payload_digest", spread, {"first": F.min(order)}, {"first": F.min("first")})
    kept = (F.col("first.archive") == F.col("archive")) & (F.col("first.n") == F.col("n"))
    first = first.withColumn("record_type", F.when(kept, "response").otherwise("revisit")).withColumn("refers_to", F.when(~kept, F.col("first.page_id"))).drop("first")
    small = listed.where(~big).withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long"))
    return first.unionByName(small)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows with an archive, each archive in one task, in as many tasks as there are archives."""
    return rows.repartition(max(1, rows.select("archive").distinct().count()), "archive")


def _sidecar(archive: str) -> str:
    return archive.replace(".warc.gz", ".idx.jsonl")


def _read_all(path: str) -> Iterator[bytes]:
    files, at = opened(path)
    with files.open_input_stream(at, compression=None) as f:
        while chunk := f.read(CHUNK):
            yield chunk


def normalise(decided: DataFrame) -> DataFrame:
    """Rewrite each monolithic archive with a member per record and write its offset index beside it.

    Returns a row (archive, records, bytes) per archive. Its decisions, at most ARCHIVE_RECORDS
    short rows, meet it in one task, which inflates the stream once. Payloads are never shuffled.
    """

    def rewrite(source: str, fate: list[tuple[str, object]]) -> tuple[str, int, int]:
        target = source.replace("/crawl-", "/normal-")
        out, beside, at = _File(target), _File(_sidecar(target)), 0
        for n, (head, block) in enumerate(records(_read_all(source))):
            kind, to = fate[n]
            page = head["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
            size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
            made = _gzip(record(kind, page, block, size, digest) if kind == "response" else record(kind, page, b"", size, digest, _name(to)))
            out.out.write(made)
            beside.out.write((json.dumps({"offset": at, "bytes": len(made), "n": n, "type": kind}) + "\n").encode())
            at += len(made)
        out.close()
        beside.close()
        return target, len(fate), at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, fate = None, []
        made = []
        for b in batches:
            for archive, kind, to in zip(b["archive"], b["record_type"], b["refers_to"]):
                if archive != source and fate:
                    made.append(rewrite(source, fate))
                    fate = []
                source = archive
                fate.append((kind, to))
        if fate:
            made.append(rewrite(source, fate))
        yield pd.DataFrame(made, columns=["archive", "records", "bytes"])

    rows = _spread(decided.select("archive", "n", "record_type", "refers_to")).sortWithinPartitions("archive", "n")
    return map_frames(rows.select("archive", "record_type", "refers_to"), run, "archive string, records long, bytes long")


def read_archives(normalised: DataFrame) -> DataFrame:
    """Read the records of normalised archives (archive), each member at the offset that the index beside the archive gives.

    Rows have page_id, payload_bytes, payload_digest, record_type, refers_to and the member's place.
    The payload of a response is hashed and measured anew and held against its record's head.
    """
    page_of = lambda x: pd.NA if x is None or x == "<urn:page:none>" else int(x[10:-1])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "member_offset", "member_bytes"]

    def members(archive: str) -> Iterator[tuple]:
        index = [json.loads(x) for x in b"".join(_read_all(_sidecar(archive))).splitlines()]
        files, path = opened(archive)
        with files.open_input_file(path) as f:
            for x in index:
                f.seek(x["offset"])
                (head, block), = records(iter([f.read(x["bytes"])]))
                digest, n = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                if head["WARC-Type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, n):
                        raise ValueError(f"payload of {archive} at {x['offset']} differs from its head")
                yield page_of(head["WARC-Record-ID"]), n, digest, head["WARC-Type"], page_of(head.get("WARC-Refers-To")), archive, x["offset"], x["bytes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["archive"]:
                rows = pd.DataFrame(list(members(archive)), columns=columns)
                yield rows.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, member_offset long, member_bytes long"
    return map_frames(_spread(normalised.select("archive")), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every page written to archives, normalised, and read back by the offset indexes. Repeated rows are records of their own."""
    scratch = Scratch(spark, "op1")
    pages = pick(table(spark, sf_dir, "pages"), page_id="page_id", html="html")
    listed = scratch.write(write_archives(pages, f"{scratch.root}/archives"), "listed")
    normalised = scratch.write(normalise(decide(listed)), "normalised")
    return read_archives(normalised).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM q
"""
