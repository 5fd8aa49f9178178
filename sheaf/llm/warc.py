"""WARC archives: records with revisits, and a normaliser for files that are one gzip stream."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.parse
import uuid
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import shared_folder, store_table
from sheaf.sources.storage import StagedFile, open_storage

DATE = "2000-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 100
STREAM_BYTES = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Records ----------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, size: int, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head with the full length, but no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = "none" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + urllib.parse.quote(url or "about:blank", safe="".join(map(chr, range(33, 127)))),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}


def split_records(chunks):
    """The records of a stream of bytes, one at a time, whatever the chunks' borders."""
    held = bytearray()
    need = None  # length of the record at the start of `held`, once its head is known
    for chunk in chunks:
        held += chunk
        while held:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(fields(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            if held[need - 4 : need] != b"\r\n\r\n":
                raise ValueError("a WARC record does not end where its length says")
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole WARC record")


def parsed(data: bytes) -> dict:
    """What a record says, and the payload that it holds (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    f = fields(head)
    block = rest[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    revisit = f["warc-type"] == "revisit"

    def page(name):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", f.get(name, ""))
        return int(found[1]) if found else None

    return {
        "page_id": page("warc-record-id"),
        "record_type": f["warc-type"],
        "payload_bytes": size,
        "payload_digest": f["warc-payload-digest"].removeprefix("sha256:"),
        "refers_to": page("warc-refers-to"),
        "payload": None if revisit else payload,
    }


# Gzip -------------------------------------------------------------------------------------


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member; its header holds no time, so reruns give the same bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def inflate(stream):
    """The content of a gzip file, chunk by chunk; one member or many."""
    z = zlib.decompressobj(31)
    began = False
    while data := stream.read(STREAM_BYTES):
        while data:
            if z.eof:
                z, began = zlib.decompressobj(31), False
            began = True
            yield z.decompress(data, STREAM_BYTES)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, STREAM_BYTES)
            data = z.unused_data
    if began and not z.eof:
        raise ValueError("the gzip stream ends early")


def normalise_file(source: str, target: str) -> list[tuple[int, int, str]]:
    """Inflate ``source`` once; write each record as its own member, and ``target``.cdxj with their offsets."""
    system, path = open_storage(source)
    out, index, offset = StagedFile(target), [], 0
    with system.open_input_stream(path, compression=None) as stream:
        for data in split_records(inflate(stream)):
            packed = member(data)
            out.write(packed)
            index.append((offset, len(packed), fields(data.partition(b"\r\n\r\n")[0])["warc-record-id"]))
            offset += len(packed)
    out.commit()
    side = StagedFile(f"{target}.cdxj")
    for at, length, name in index:
        side.write((json.dumps({"id": name, "offset": at, "length": length}) + "\n").encode())
    side.commit()
    return index


def read_index(target: str) -> list[tuple[int, int, str]]:
    system, path = open_storage(f"{target}.cdxj")
    with system.open_input_stream(path, compression=None) as stream:
        return [(x["offset"], x["length"], x["id"]) for x in map(json.loads, stream.read().splitlines())]


# Spark ------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, url, payload, size, digest, refers_to``: of equal payloads of at least 100 bytes, that with the smallest id stays a response."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("size"),
        F.sha2(payload, 256).alias("digest"),
    )
    # Hashes are grouped, not pages; digests that occur once need no partner.
    first = (
        rows.where(F.col("size") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    kept = F.when(refers.isNull(), F.col("payload"))  # a revisit's payload travels no further
    return rows.join(first, "digest", "left").select("page_id", "url", kept.alias("payload"), "size", "digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, prefix: str = "part") -> DataFrame:
    """One file, one gzip stream, per partition; returns ``path, records``. A repeated task replaces its own file."""

    def write(batches):
        name = f"{folder}/{prefix}-{TaskContext.get().partitionId():05d}.warc.gz"
        out, z, n = None, zlib.compressobj(1, zlib.DEFLATED, 31), 0
        for pdf in batches:
            for page_id, url, payload, size, digest, refers_to in zip(*(pdf[c] for c in ("page_id", "url", "payload", "size", "digest", "refers_to"))):
                out = out or StagedFile(name)
                out.write(z.compress(record(_int(page_id), _none(url), int(size), digest, payload or b"", _int(refers_to))))
                n += 1
        if out:
            out.write(z.flush())
            out.commit()
            yield pd.DataFrame({"path": [name], "records": [n]})

    # Ids travel as text: pandas would turn a bigint column with nulls into doubles.
    sent = records.select(F.col("page_id").cast("string"), "url", "payload", "size", "digest", F.col("refers_to").cast("string"))
    return store_table(sent.mapInPandas(write, "path string, records bigint"))


def _none(x):
    return None if x is None or x != x else x


def _int(x):
    return None if _none(x) is None else int(x)


def normalise_archives(files: DataFrame) -> DataFrame:
    """Rewrites every ``path``; returns ``path, records`` of the new files, one task per file."""

    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                target = path.removesuffix(".warc.gz") + ".members.warc.gz"
                yield pd.DataFrame({"path": [target], "records": [len(normalise_file(path, target))]})

    return store_table(_one_each(files).mapInPandas(run, "path string, records bigint"))


def _one_each(files: DataFrame) -> DataFrame:
    return files.select("path").repartitionByRange(max(1, files.count()), "path")


def read_archives(files: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` of every record, member by member.

    The digest of each payload that is there is computed anew and must be the one that the record states.
    """

    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                system, place = open_storage(path)
                rows, size = [], 0
                with system.open_input_file(place) as f:
                    for offset, length, _ in read_index(path):
                        f.seek(offset)
                        rows.append(parsed(zlib.decompress(f.read(length), 31)))
                        _verify(rows[-1], path, offset)
                        size += len(rows[-1]["payload"] or b"")
                        if size > 8 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                yield _frame(rows)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return _one_each(files).mapInPandas(run, schema)


def _verify(row: dict, path: str, offset: int) -> None:
    payload = row["payload"]
    if payload is not None and (len(payload) != row["payload_bytes"] or hashlib.sha256(payload).hexdigest() != row["payload_digest"]):
        raise ValueError(f"{path} at {offset}: the payload is not the one that the record states")


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as WARC files of one gzip stream, normalise them, and read every record back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` (null for a revisit).
    A null payload counts as empty, a null url is ``about:blank``, a page without id is a record without
    a page id and never what others refer to. Rows that repeat the response's id and payload are the same
    capture and are responses too. No rows, no files. Other columns are ignored.
    """
    folder = folder or new_folder(pages.sparkSession)
    return read_archives(normalise_archives(write_archives(with_revisits(pages, id_col, url_col, payload_col), folder)))
