"""WARC archives: written as one gzip stream, then normalised and read by offset.

:func:`write_archives` writes one archive after the other as a single gzip
stream, as crawlers and ``gzip`` leave them: nothing in it can be reached but
by inflating all that stands before it. The normaliser (:func:`normalise`)
inflates such a stream once, rewrites every record as a gzip member of its own
and writes a sidecar index beside the archive: a line of JSON for each record,
with the offset and length of its member, its type and its ids. Streams of
several members, or of one a record already, are rewritten alike. A task works
on one archive at a time and holds some 64 KB of it, however long a record or
an archive is. :func:`records` then reads any members by their offsets.

Of the pages with one payload the least page_id is a response; the others are
revisits of it, without the payload. Payloads are told apart by SHA-1, another
64-bit hash and their length. Equal ones are counted per cell first, so a
payload that a third of all pages share doesn't meet in one task; repeated
payloads are broadcast where at most :data:`BROADCAST_ROWS` were counted, else
joined by shuffle.

Archives are files of the shared folder, which tasks open through pyarrow (so
file, hdfs, s3, gs and abfs addresses). A task names its files afresh, and
what it has written is a row of the manifest, a table that Spark commits: files
of a lost executor are in no manifest, and its task writes them anew.

Defined results: a null html is an empty payload; a payload below ``min_bytes``
is always a response; a null page_id is greater than all others and stands as
``-`` in record ids; rows equal in page_id and payload are all responses if
theirs is the least page_id; a null url leaves the record's own id as address,
and what can't stand in a header line is percent-encoded; payloads may have any
length, as they are neither held whole nor collected; an empty table leaves no
archive; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.llm.common import discard, only, remove, shared_dir, stored

#: Bytes of payload after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Compressed bytes that are inflated at once.
CHUNK = 64 << 10
#: Rows of repeated payloads (some 50 bytes each) that are broadcast.
BROADCAST_ROWS = 200_000
#: Pages of one payload that share a group, and the least number of groups.
CELL_ROWS, CELLS = 50_000, 64
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, n_records long, n_bytes long"
ENTRY = "archive string, offset long, length long, record_type string, record_id string"
RECORD = f"{ENTRY}, target_uri string, refers_to string, payload_bytes long, payload_digest string, intact boolean, payload binary"
_ODD = re.compile(r"[^\x21-\x7E]")


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", address))


def _folder(spark, name: str) -> str:
    """A fresh shared folder, with the scheme of its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark, name))
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    return store.makeQualified(path).toString()


# -- which pages are revisits --------------------------------------------


def digest32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_firsts(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (no nulls), sha1 (hex) and first_id: the page that a
    revisit refers to, null for responses; ``has_first`` tells them apart."""
    html = F.coalesce("html", F.lit(""))
    rows = only(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha1"), F.xxhash64(html).alias("other"), F.octet_length(html).cast("long").alias("size"))
    key, ident = ["sha1", "other", "size"], F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"))
    cell = lambda n: F.pmod(F.xxhash64("page_id", "url"), F.lit(n))
    digests = stored(rows.where(F.col("size") >= min_bytes).drop("html"), "payload-digests")
    cells = max(CELLS, digests.count() // CELL_ROWS)
    per_cell = digests.groupBy(*key, cell(cells).alias("cell")).agg(F.count("*").alias("n"), F.min(ident).alias("first"))
    several = stored(per_cell.groupBy(*key).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.collect_list("cell").alias("cells")).where("n > 1").drop("n"), "repeated-payloads")
    discard(digests)
    if several.count() <= BROADCAST_ROWS:
        both = rows.join(F.broadcast(several.drop("cells")), key, "left")
    else:
        both = rows.withColumn("cell", cell(cells)).join(several.select(*key, "first", F.explode("cells").alias("cell")), [*key, "cell"], "left")
    again = F.coalesce(F.col("first") < ident, F.lit(False))
    return both.select("page_id", "url", "html", "sha1", again.alias("has_first"), F.when(again, F.col("first.id")).alias("first_id"))


# -- records --------------------------------------------------------------


def _head(**fields: str) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def _ident(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}:{digest}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: tuple[int | None] | None) -> bytes:
    """A response, or a revisit of the page in ``first``. A revisit has the
    HTTP headers alone, which still give the length of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    ident = _ident(page_id, digest)
    uri = ident[1:-1] if url is None else _ODD.sub(lambda m: quote(m[0]), url)
    block = http if first else http + payload
    kind = {"WARC_Type": "revisit", "WARC_Profile": PROFILE, "WARC_Refers_To": _ident(first[0], digest)} if first else {"WARC_Type": "response"}
    head = _head(**kind, WARC_Record_ID=ident, WARC_Target_URI=uri, WARC_Date=DATE, WARC_Payload_Digest=f"sha1:{digest}", Content_Type="application/http; msgtype=response", Content_Length=str(len(block)))
    return head + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _head(WARC_Type="warcinfo", WARC_Record_ID=f"<urn:uuid:{name}>", WARC_Date=DATE, Content_Type="application/warc-fields", Content_Length=str(len(block))) + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """The manifest of archives that are one gzip stream each, and their folder."""
    folder = _folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []

        def close() -> None:
            out.write(pack.flush())
            done.append((address, n, out.tell()))
            out.close()

        for batch in batches:
            for page_id, url, html, sha1, again, first in zip(*[c.cast(pa.binary()) if i == 2 else c.to_pylist() for i, c in enumerate(batch.columns)]):
                if out is None:
                    name = uuid.uuid4()
                    address = f"{folder}/{name}.warc.gz"
                    store, path = _opened(address)
                    out, pack, n, size = store.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                    out.write(pack.compress(_info(str(name))))
                payload = html.as_py()
                out.write(pack.compress(page_record(page_id, url, payload, digest32(bytes.fromhex(sha1)), (first,) if again else None)))
                n, size = n + 1, size + len(payload)
                if size >= archive_bytes:
                    out = close()
        if out is not None:
            close()
        yield _rows(done, MANIFEST)

    return stored(with_firsts(pages, min_bytes).mapInArrow(run, MANIFEST), "warc-manifest"), folder


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What a gzip file of any number of members holds."""
    box = zlib.decompressobj(31)
    fresh = True
    for chunk in chunks:
        while chunk:
            if box.eof:
                box = zlib.decompressobj(31)
            fresh = False
            yield box.decompress(chunk)
            chunk = box.unused_data
    if not (box.eof or fresh):
        raise ValueError("a gzip stream ends before its end")


def _chunks(stream) -> Iterator[bytes]:
    while chunk := stream.read(CHUNK):
        yield chunk


class _Bytes:
    """Chunks of bytes, by marks and lengths."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held, self.at = iter(chunks), b"", 0

    def more(self) -> bool:
        for chunk in self.chunks:
            if chunk:
                self.held, self.at = self.held[self.at :] + chunk, 0
                return True
        return False

    def through(self, mark: bytes) -> bytes:
        """Up to and with the mark; what is left if it never comes."""
        while (found := self.held.find(mark, self.at)) < 0 and self.more():
            pass
        begin, self.at = self.at, len(self.held) if found < 0 else found + len(mark)
        return self.held[begin : self.at]

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.held) and not self.more():
                raise ValueError("a record ends before its Content-Length")
            out = self.held[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out

    def rest(self) -> Iterator[bytes]:
        while self.at < len(self.held) or self.more():
            begin, self.at = self.at, len(self.held)
            yield self.held[begin:]


def parsed(chunks: Iterable[bytes]) -> Iterator[tuple[bytes, dict[str, str], _Bytes, int]]:
    """(head, its fields by lower-case name, source, length of the block) of
    every record; the block has to be taken before the next one is asked for."""
    data = _Bytes(chunks)
    while head := data.through(b"\r\n\r\n"):
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/") or not head.endswith(b"\r\n\r\n"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}
        yield head, fields, data, int(fields["content-length"])
        if b"".join(data.take(4)) != b"\r\n\r\n":
            raise ValueError("a record isn't followed by two line ends")


# -- the normaliser ---------------------------------------------------------


def _normalised(address: str, target: str) -> tuple[str, int, int]:
    """Rewrite one archive to ``target`` with a member a record and write
    ``target``.idx; both are streamed."""
    store, path = _opened(address)
    _, to = _opened(target)
    n = 0
    with store.open_input_stream(path, compression=None) as source, store.open_output_stream(to, compression=None) as out, store.open_output_stream(f"{to}.idx") as index:
        for head, fields, data, length in parsed(inflated(_chunks(source))):
            pack, offset = zlib.compressobj(6, zlib.DEFLATED, 31), out.tell()
            out.write(pack.compress(head))
            for part in data.take(length):
                out.write(pack.compress(part))
            out.write(pack.compress(b"\r\n\r\n") + pack.flush())
            entry = {"offset": offset, "length": out.tell() - offset, "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id")}
            index.write(json.dumps(entry).encode() + b"\n")
            n += 1
        return target, n, out.tell()


def _dealt(archives: DataFrame) -> DataFrame:
    """An archive a task, or as near to it as there are cores for."""
    return archives.repartition(max(1, archives.count()))


def normalise(archives: DataFrame) -> tuple[DataFrame, str]:
    """The manifest of archives with a member a record, each with its index,
    and their folder. ``archives`` has the addresses of gzip files in a column
    ``archive``; they stay as they are."""
    folder = _folder(archives.sparkSession, "warc-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                yield _rows([_normalised(address, f"{folder}/{uuid.uuid4()}.warc.gz")], MANIFEST)

    return stored(_dealt(archives.select("archive")).mapInArrow(run, MANIFEST), "warc-members-manifest"), folder


# -- reading by offset --------------------------------------------------------


def entries(archives: DataFrame) -> DataFrame:
    """Rows of :data:`ENTRY` from the sidecar indexes, in the order of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                store, path = _opened(f"{address}.idx")
                with store.open_input_stream(path) as lines:
                    some, data = [], _Bytes(_chunks(lines))
                    while line := data.through(b"\n"):
                        e = json.loads(line)
                        some.append((address, e["offset"], e["length"], e["record_type"], e["record_id"]))
                        if len(some) == 10_000:
                            yield _rows(some, ENTRY)
                            some = []
                    yield _rows(some, ENTRY)

    return _dealt(archives.select("archive")).mapInArrow(run, ENTRY)


def _member(file, offset: int, length: int) -> Iterator[bytes]:
    file.seek(offset)
    while length:
        chunk = file.read(min(CHUNK, length))
        if not chunk:
            raise ValueError("an archive ends before its index says")
        length -= len(chunk)
        yield chunk


def _read(file, entry: tuple, keep: bool) -> tuple:
    """A row of :data:`RECORD` from one member."""
    for _, fields, data, length in parsed(inflated(_member(file, entry[1], entry[2]))):
        block, http = _Bytes(data.take(length)), {}
        if fields.get("content-type", "").startswith("application/http"):
            lines = block.through(b"\r\n\r\n").decode("latin-1").split("\r\n")
            http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}
        seen, size, kept = hashlib.sha1(usedforsecurity=False), 0, []
        for part in block.rest():
            seen.update(part)
            size += len(part)
            if keep:
                kept.append(part)
        said = fields.get("warc-payload-digest", "")
        said = said[5:].upper() if said.lower().startswith("sha1:") else None
        revisit = fields.get("warc-type") == "revisit"
        found = said if revisit else digest32(seen.digest())
        size = int(http.get("content-length", 0)) if revisit else size
        intact = None if revisit or said is None else said == found
        row = (*entry[:3], fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), size, found, intact, b"".join(kept) if keep and not revisit else None)
    return row


def records(wanted: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows of :data:`RECORD` for the members that ``wanted`` (rows of
    :data:`ENTRY`) names, each read by its offset alone. ``intact`` says whether
    a payload has the digest that its record states; payloads themselves come
    back only if asked for, and revisits have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            some, size = [], 0
            for entry in zip(*[c.to_pylist() for c in batch.columns]):
                if entry[0] != at:
                    if file:
                        file.close()
                    store, path = _opened(at := entry[0])
                    file = store.open_input_file(path)
                some.append(_read(file, entry, payloads))
                size += len(some[-1][-1] or b"")
                if size >= ARCHIVE_BYTES >> 4:
                    yield _rows(some, RECORD)
                    some, size = [], 0
            yield _rows(some, RECORD)
        if file:
            file.close()

    return wanted.select(*[f.split()[0] for f in ENTRY.split(", ")]).mapInArrow(run, RECORD)


def page_of(record_id: Column) -> Column:
    """The page_id in a record id of :func:`page_record`."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+):", 1).try_cast("long")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The manifest of normalised archives of ``pages``."""
    whole, folder = write_archives(pages, min_bytes)
    archives, _ = normalise(whole)
    discard(whole)
    remove(pages.sparkSession, folder)
    return archives


def page_records(archives: DataFrame) -> DataFrame:
    """Per page, read back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, intact."""
    read = records(entries(archives).where("record_type <> 'warcinfo'"))
    return read.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"), "intact")
