"""WARC archives: writing with an index first, and reading back by coalesced byte ranges.

Writing: one record per page, each a gzip member of its own, in archives that the tasks write to the shared folder. The
index (archive, offset, length, url, digest and page_id per record) is written before anything is read back. Of records
with equal payloads of at least MIN_REVISIT bytes the one with the smallest page_id is a response and the others are
revisits without payload.

Payloads are not shuffled. Only (place of a row, digest) is, to find the digests that occur more than once and their
responses; for each input file a note of its own such digests is left in the shared folder, and the task that reads
the file looks there. A row's place is its file and its number in it, which do not depend on how tasks are cut; pages
that do not come straight from Parquet are written there first.

Reading: selected index rows are sorted by archive and offset; neighbouring records are fetched by one read of at most
RANGE bytes, over gaps of at most GAP bytes; each record is then decompressed and parsed by itself and its digest held
against its payload. The archives' file system is found from their address (pyarrow.fs).

A task that is run again writes another archive under a new name, and the index that is committed names the archives of
the run that counted; so a lost executor leaves a file unused, never an index without its file.

Results: null html is an empty payload; null urls and page_ids give no such header and come back null; each digest has one
response: of rows with the same smallest page_id (null ids last) the first by place; a revisit of a response without
id has a null refers_to; record ids are of the place and differ; line ends in a url are percent-encoded in the record;
an empty table gives no archive and an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, salted_join, stage

MIN_REVISIT = 100
#: Bytes of an archive after which the task begins another.
ARCHIVE = 256 << 20
RANGE = 4 << 20
#: Bytes of archives that a reading task gets.
SHARE = 8 << 20
GAP = 64 << 10
#: Notes on repeated digests lie in as many folders as there are input files, up to this.
NOTES = 4096
#: Stamped on every record: pages carry no date.
DATE = "2000-01-01T00:00:00Z"
INDEX = "page_id long, url string, payload_digest string, archive string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, place: str, refers_to: tuple[int | None, str] | None = None, date: str = DATE) -> bytes:
    """A WARC/1.1 record. A revisit, which refers to the page_id and place of a response, keeps the HTTP headers and leaves the
    payload out."""
    name = lambda at: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{at}:{digest}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(place)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to[1])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [] if refers_to[0] is None else [f"X-Refers-To-Page: {refers_to[0]}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode("utf-8") + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8").split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(raw: bytes) -> dict:
    """A record's fields; raises ValueError if it is broken or a payload does not have its digest."""
    head, cut, rest = raw.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    h = _headers(head)
    size = int(h["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    digest, kind = h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"]
    length = int(_headers(http)["content-length"])
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload does not have its digest")
    whole = lambda key: int(h[key]) if key in h else None
    return {
        "page_id": whole("x-page-id"),
        "url": h.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": whole("x-refers-to-page"),
        "payload": payload if kind == "response" else None,
    }


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _files(address: str):
    """(file system, path) of an address with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(address))


def _noted(notes: str, bucket: int, file: str) -> dict[bytes, tuple[int | None, str]]:
    """By digest, of those in `file` that occur more than once: page_id and place of the response."""
    system, root = _files(f"{notes}/bucket={bucket}")
    from pyarrow import fs

    found = {}
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            t = pq.read_table(info.path, filesystem=system, partitioning=None, filters=[("file", "==", file)])
            found.update((d, (p, f"{f}#{r}")) for d, p, f, r in zip(*(t[c].to_pylist() for c in ("digest", "page_id", "first_file", "first_row"))))
    return found


def _writer(folder: str, notes: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _files(folder)
        out, name, at = None, "", 0
        now, noted = None, {}
        try:
            for pdf in batches:
                rows = []
                for page_id, url, html, digest, file, row, bucket in zip(*(pdf[c] for c in ("page_id", "url", "html", "digest", "file", "row", "bucket"))):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    if file != now:
                        now, noted = file, _noted(notes, bucket, file)
                    page_id, payload, place = _whole(page_id), html.encode("utf-8"), f"{file}#{row}"
                    first = noted.get(digest) if len(payload) >= MIN_REVISIT else None
                    raw = record(page_id, url, payload, digest.hex(), place, None if first is None or first[1] == place else first)
                    press = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = press.compress(raw) + press.flush()
                    out.write(member)
                    rows.append((page_id, url, digest.hex(), name, at, len(member)))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["page_id", "url", "payload_digest", "archive", "offset", "length"]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) to archives in folder, which all executors can reach; returns the index, already
    written to the shared folder."""
    system, root = _files(folder)
    system.create_dir(root, recursive=True)
    rows = _placed(pages)
    buckets = min(NOTES, max(1, len(rows.inputFiles())))
    rows = rows.withColumn("digest", F.unhex(F.sha2("html", 256))).withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int"))
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "row")
    # one entry for a digest and file, so that a payload that is everywhere has as many entries as there are files
    seen = rows.filter(F.octet_length("html") >= MIN_REVISIT).groupBy("bucket", "file", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    seen = stage(seen, "warc-digests")
    heads = seen.groupBy("digest").agg(F.min("first").alias("head"), F.sum("n").alias("n")).filter("n > 1").select("digest", "head")
    noted = salted_join(seen.select("bucket", "file", "digest"), stage(heads, "warc-heads"), ["digest"], "inner", F.col("file"))
    noted = noted.select("bucket", "file", "digest", "head.page_id", F.col("head.file").alias("first_file"), F.col("head.row").alias("first_row"))
    noted.repartition("bucket").sortWithinPartitions("bucket", "file").write.partitionBy("bucket").parquet(notes := new_path(pages.sparkSession, "warc-notes"))
    return stage(rows.mapInPandas(_writer(folder, notes), INDEX), "warc-index")


def _placed(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html, file, row): each with its file and its number there."""
    plain = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return pages.select(*plain, *place)
    except AnalysisException:
        return stage(pages.select(*plain), "warc-pages").select("*", *place)


def ranges(offsets: list[int], lengths: list[int], most: int = RANGE, gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """Sorted records of one archive, gathered: (first, one past the last, byte begun at, bytes)."""
    out, k = [], 0
    while k < len(offsets):
        first, begin, end = k, offsets[k], offsets[k] + lengths[k]
        k += 1
        while k < len(offsets) and offsets[k] - end <= gap and offsets[k] + lengths[k] - begin <= most:
            end = max(end, offsets[k] + lengths[k])
            k += 1
        out.append((first, k, begin, end - begin))
    return out


def _reader(folder: str, with_payload: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")][: None if with_payload else -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _files(folder)
        for pdf in batches:
            for archive, part in pdf.groupby("archive", sort=False):
                part = part.sort_values("offset")
                offsets, lengths = part["offset"].tolist(), part["length"].tolist()
                with system.open_input_file(f"{root}/{archive}") as f:
                    for a, b, begin, size in ranges(offsets, lengths):
                        got = f.read_at(size, begin)
                        found = [parse(zlib.decompress(got[offsets[k] - begin : offsets[k] - begin + lengths[k]], 31)) for k in range(a, b)]
                        if with_payload:
                            for r in found:
                                r["payload"] = None if r["payload"] is None else r["payload"].decode("utf-8")
                        yield pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that the rows of index select. Revisits have no payload of their own."""
    schema = RECORDS if with_payload else RECORDS.rpartition(", ")[0]
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // SHARE))
    dealt = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInPandas(_reader(folder, with_payload), schema)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, read all archives back; a row per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = new_path(spark, "warc")
    return read_records(write_archives(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
