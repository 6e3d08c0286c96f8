"""WARC archives as a Python data source: format "warc", for reading and writing.

Reading plans one partition per span of whole files and takes filters on record_type, target_uri, refers_to and page_id
from the query. A record's header is parsed first; where the filters or the wanted columns do not ask for the payload, its
bytes are never inflated: every record is a gzip member of its own whose header carries the member's compressed and plain
length in the 'sl' extra field that the WARC standard describes, so the reader inflates the head alone and steps over the
rest. Members without that field are inflated, as they must be.

Writing makes one file per task under a name of its own, which commit moves into place; appending adds files, overwriting
replaces them. Drafts lie in a folder of the write that commit and abort remove, so a task that is run again, or twice, or
whose executor is lost, leaves nothing behind.

archive_pages() decides which of the records with equal payloads is the response, the others are revisits: equal payloads
of at least MIN_SHARED bytes, smallest page_id first. Smaller ones are all responses.

Defined cases: null html is the empty payload; a null page_id is never the smallest of several; rows with equal page_id and
equal payload are alike, both responses if theirs is the smallest; an empty table makes an empty archive. Reading refuses
files that are cut off, records without an end of their header and lengths that are no numbers, with file and place; page
ids and payload lengths that are no numbers read as null.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from weft.llm.common import fresh_path, until_exit

MIN_SHARED = 100
SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: Columns that the header alone gives.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes")
HEAD_CHUNK = 2048
#: Bytes that one request for a file brings, that one step inflates, and that a header may have.
BLOCK_BYTES, INFLATED, MOST_HEADER = 1 << 20, 1 << 16, 1 << 20
#: Bytes of archives that one partition reads.
SPLIT_BYTES = 32 << 20


def filesystem(path: str):
    """(pyarrow file system, path in it) for a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:/", path) else (fs.LocalFileSystem(), path)


def archives(system, folder: str) -> list:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((x for x in found if x.is_file and re.search(r"\.warc(\.gz)?$", x.path)), key=lambda x: x.path)


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def record(kind: str, page_id: int | None, uri: str | None, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """One record as a gzip member with its lengths in the 'sl' field."""
    block = http_block(payload) if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{uri}/{digest}')}>", "WARC-Date: 2000-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {re.sub(r'[\x00-\x1f]+', ' ', uri)}"] if uri is not None else []), *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"] if kind == "revisit" else []),
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    extra = 12
    total = 10 + 2 + extra + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", extra, b"sl", 8, total & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """Compressed length of the gzip member, if its 'sl' field tells."""
    if len(head) < 24 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= end and at + 4 <= len(head):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"sl" and size == 8:
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return None


def parse_header(head: bytes) -> dict:
    """The header's fields by column. Own numbers that are none read as null; a length that is none is an error."""
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    number = lambda k: int(fields[k]) if re.fullmatch(r"-?[0-9]{1,18}", fields.get(k, "")) else None
    length = number("content-length")
    if length is None and fields.get("content-length") or (length or 0) < 0:
        raise ValueError(f"Content-Length is {fields['content-length']!r}")
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "page_id": number("x-page-id"),
        "refers_to": number("x-refers-to-page-id"), "payload_digest": fields.get("warc-payload-digest", "").partition(":")[2] or None, "payload_bytes": number("x-payload-length"), "content_length": length or 0,
    }


class Blocks:
    """A file read in blocks: what lies within the block at hand costs no request, a seek past it does."""

    def __init__(self, file, size: int = BLOCK_BYTES):
        self.file, self.size, self.held, self.begin, self.at = file, size, b"", 0, 0

    def read(self, n: int) -> bytes:
        begun = self.at - self.begin
        if begun + n > len(self.held):
            if begun < len(self.held):
                self.held = self.held[begun:]
            else:
                self.file.seek(self.at)
                self.held = b""
            self.begin, begun = self.at, 0
            self.held += self.file.read(max(self.size, n - len(self.held)))
        out = self.held[begun : begun + n]
        self.at += len(out)
        return out

    def seek(self, at: int) -> None:
        if not self.begin <= at <= self.begin + len(self.held):
            self.held, self.begin = b"", at
        self.at = at

    def tell(self) -> int:
        return self.at


class Member:
    """One gzip member, inflated as far as is asked for."""

    def __init__(self, file, head: bytes):
        self.file, self.inflate = file, zlib.decompressobj(31)
        self.plain = self.inflate.decompress(head, INFLATED)

    def more(self) -> bytes:
        """The next part; the member must go on."""
        held = self.inflate.unconsumed_tail or self.file.read(HEAD_CHUNK * 16)
        if not held:
            raise ValueError("the file ends within a gzip member")
        return self.inflate.decompress(held, INFLATED)

    def header(self) -> int:
        """Bytes of the header, after which the block begins."""
        while (cut := self.plain.find(b"\r\n\r\n")) < 0:
            if self.inflate.eof or len(self.plain) > MOST_HEADER:
                raise ValueError("a record has no end of its header")
            self.plain += self.more()
        return cut

    def rest(self) -> bytes:
        parts = [self.plain]
        while not self.inflate.eof:
            parts.append(self.more())
        return b"".join(parts)

    def skip(self) -> None:
        while not self.inflate.eof:
            self.more()


def read_records(file, wanted, with_payload: bool) -> Iterator[dict]:
    """Records of one archive; wanted(header) tells which. Plain and per-record gzip files are understood.

    What is cut off or malformed is refused with its place: ValueError.
    """
    begun = 0
    try:
        while head := file.read(HEAD_CHUNK):
            begun = file.tell() - len(head)
            if head[:2] == b"\x1f\x8b":
                member = Member(file, head)
                cut = member.header()
                found = parse_header(member.plain[:cut])
                length = member_length(head)
                take = wanted(found)
                plain = member.plain
                if take and with_payload and found["content_length"]:
                    plain = member.rest()
                elif length is None:
                    member.skip()
                if length is not None:
                    file.seek(begun + length - 1)
                    if not file.read(1):
                        raise ValueError("the file ends within a gzip member")
                else:
                    file.seek(file.tell() - len(member.inflate.unused_data))
            else:
                plain = head.lstrip(b"\r\n")
                if not plain:
                    continue
                while (cut := plain.find(b"\r\n\r\n")) < 0:
                    more = file.read(HEAD_CHUNK)
                    if not more or len(plain) > MOST_HEADER:
                        raise ValueError("a record has no end of its header")
                    plain += more
                found = parse_header(plain[:cut])
                take = wanted(found)
                body = file.tell() - len(plain) + cut + 4
                if take and with_payload and found["content_length"]:
                    file.seek(body)
                    plain = plain[: cut + 4] + file.read(found["content_length"])
                if found["content_length"]:
                    file.seek(body + found["content_length"] - 1)
                    if not file.read(1):
                        raise ValueError("the file ends within a record")
                file.seek(body + found["content_length"])
            if take:
                if with_payload:
                    block = plain[cut + 4 : cut + 4 + found["content_length"]]
                    if len(block) < found["content_length"]:
                        raise ValueError("a record is shorter than its length says")
                    found["payload"] = block.partition(b"\r\n\r\n")[2] if block else None
                yield found
    except (ValueError, zlib.error) as e:
        raise ValueError(f"{e}, in the record at byte {begun}") from e


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], skipped=None):
        self.path, self.columns, self.tests = path, columns, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in HEADER_COLUMNS and isinstance(f, EqualTo):
                self.tests.append((name, {f.value}))
            elif name in HEADER_COLUMNS and isinstance(f, In):
                self.tests.append((name, set(f.value)))
            elif name in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                yield f

    def partitions(self):
        system, path = filesystem(self.path)
        files = archives(system, path)
        groups, held = [[]], 0
        for x in files:
            if groups[-1] and held + x.size > SPLIT_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(x.path)
            held += x.size
        return [Files(g) for g in groups]

    def read(self, partition):
        system, _ = filesystem(self.path)
        wanted = lambda h: all(h[k] is not None and (v is None or h[k] in v) for k, v in self.tests)
        for path in partition.paths:
            with system.open_input_file(path) as file:
                try:
                    for found in read_records(Blocks(file), wanted, "payload" in self.columns):
                        yield tuple(found.get(k) for k in self.columns)
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e


class Written(WriterCommitMessage):
    def __init__(self, draft: str, final: str):
        self.draft, self.final = draft, final


class WarcWriter(DataSourceWriter):
    """Files are named by the write and the task, so a write never meets another's; drafts are in a folder of the write."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.write_id = path, overwrite, uuid.uuid4().hex
        system, inner = filesystem(path)
        system.create_dir(f"{inner}/_drafts-{self.write_id}", recursive=True)

    def write(self, rows):
        from pyspark import TaskContext

        system, inner = filesystem(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.write_id}"
        draft = f"{inner}/_drafts-{self.write_id}/{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(draft, compression=None) as out:
            for r in rows:
                out.write(record(r.record_type, r.page_id, r.target_uri, r.refers_to, r.payload_digest, r.payload_bytes, bytes(r.payload or b"")))
        return Written(draft, f"{inner}/{name}.warc.gz")

    def commit(self, messages):
        """New files first, then the old ones go where the write replaces them, then what lost tasks have left."""
        system, inner = filesystem(self.path)
        before = archives(system, inner) if self.overwrite else []
        for m in messages:
            if m:
                system.move(m.draft, m.final)
        for x in before:
            system.delete_file(x.path)
        system.delete_dir(f"{inner}/_drafts-{self.write_id}")

    def abort(self, messages):
        system, inner = filesystem(self.path)
        system.delete_dir(f"{inner}/_drafts-{self.write_id}")


class WarcSource(DataSource):
    """Options: path. A schema given by the user may leave columns out; without payload none is decoded."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame) -> DataFrame:
    """Rows for the writer. Shuffled once by digest without payloads, and once with the payloads by page."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    base = base.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    light = base.where(F.col("payload_bytes") >= MIN_SHARED).select("page_id", "payload_digest")
    first = light.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    again = light.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    found = base.join(again, base.payload_digest.eqNullSafe(again.payload_digest) & base.page_id.eqNullSafe(again.page_id), "left").select(base["*"], F.col("first").alias("refers_to"))
    revisit = F.col("refers_to").isNotNull()
    return found.select(
        F.lit(None).cast("string").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> str:
    """Write the pages as WARC files; the folder's path."""
    spark = pages.sparkSession
    register(spark)
    path = path or fresh_path(spark, "warc")
    records(pages).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    register(spark)
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages, read the archives back, and describe what was read.

    Responses are read with their payloads, which give size and digest; revisits by their headers alone. Either kind is
    asked for by a predicate that the reader takes, so no payload is inflated that is not wanted.
    """
    spark = pages.sparkSession
    path = archive_pages(pages, until_exit(spark, fresh_path(spark, "warc")))
    columns = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    body = F.coalesce("payload", F.lit(b"").cast("binary"))
    responses = read_archive(spark, path, [*columns, "payload"]).where("record_type = 'response'")
    responses = responses.withColumns({"payload_bytes": F.length(body).cast("long"), "payload_digest": F.sha2(body, 256)})
    revisits = read_archive(spark, path, columns).where("record_type = 'revisit'")
    return responses.drop("payload").unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
