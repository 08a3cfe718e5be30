"""WARC archives of web pages with a two-level capture index.

``write_archives`` writes one gzip member a page into .warc.gz files (one or more a task) of the shared
folder and returns where each lies. ``build_index`` sorts the captures by URL key (host labels reversed, then
the path) over range partitions, writes them as compressed blocks of ``BLOCK_LINES`` lines, and beside each
part's block file a sparse directory: first key, place and size of each block. ``lookup`` answers (url, page_id)
rows: the part is found among the parts' first keys, the block by binary search in that part's directory, the
line by binary search in the block; then the record alone is range-read, unpacked and checked against its
digest.

Of records with equal payloads of ``LEAST_BYTES`` or more, that with the smallest page_id is a response and
the others are revisits without payload that refer to it; shorter payloads are always responses.

File names hold the task attempt, and only the rows of committed attempts are indexed, so a lost executor's
half-written file is never read. Files are reached through pyarrow's file systems, by URI.

Cases: null html: an empty payload. Null url: the empty key. Null page_id: a response of its own, found by its
url like others, never referred to. Repeated rows: each is written; those with the smallest page_id are all responses and are
read back once for every row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches

LEAST_BYTES, BLOCK_LINES, FILE_BYTES, LEVEL = 100, 500, 256 << 20, 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_NAME = "urn:groundloom:page:"


def url_key(url: str | None) -> str:
    """``https://blog.example.com:80/a?b#c`` becomes ``com,example,blog:80)/a?b``."""
    rest = (url or "").split("#", 1)[0].strip()
    rest = rest.split("://", 1)[-1]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:]
    host, _, port = host.partition(":")
    return (",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path).replace("\n", "%0A").replace("\t", "%09")


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Appends byte strings to numbered files of at most FILE_BYTES (a longer string goes alone)."""

    def __init__(self, folder: str, suffix: str):
        context = TaskContext.get()
        self.fs, self.folder = opened(folder)
        self.stem, self.suffix, self.count, self.at, self.out = f"{context.partitionId():05d}-{context.taskAttemptId()}", suffix, 0, 0, None

    def put(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at and self.at + len(data) > FILE_BYTES:
            self.close()
            self.fs.create_dir(self.folder, recursive=True)
            self.name, self.at, self.count = f"{self.stem}-{self.count}{self.suffix}", 0, self.count + 1
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        place = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Reader:
    """Range reads, with the most recently used files kept open."""

    def __init__(self, folder: str, most: int = 64):
        self.fs, self.folder = opened(folder)
        self.files: OrderedDict[str, object] = OrderedDict()
        self.most = most

    def get(self, name: str, offset: int, length: int) -> bytes:
        file = self.files.pop(name, None) or self.fs.open_input_file(f"{self.folder}/{name}")
        self.files[name] = file
        if len(self.files) > self.most:
            self.files.popitem(last=False)[1].close()
        file.seek(offset)
        return file.read(length)

    def whole(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.folder}/{name}", compression=None) as f:
            return f.read()


def packed(data: bytes) -> bytes:
    """One gzip member, the same for the same data."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_NAME}{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + _END + block + _END


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, payload) of an unpacked record."""
    head, rest = data.split(_END, 1)
    first, *lines = head.decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != _END:
        raise ValueError("cut record")
    return fields, block.split(_END, 1)[1]


def _id(uri: str) -> int | None:
    return int(x) if (x := uri.strip("<>").removeprefix(_NAME)) else None


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, url_key, file, offset, length of each page's record; evaluate it once (see ``Scratch.save``)."""
    full = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    full = full.withColumn("digest", F.sha2("payload", 256))
    shared = full.filter(f"octet_length(payload) >= {LEAST_BYTES} and page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("digest", "first")
    full = full.join(shared, "digest", "left").withColumn("refers_to", F.expr("if(page_id > first, first, null)")).select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder, ".warc.gz")
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                data = packed(record(page_id, url, payload, digest, refers_to))
                file, at = out.put(data)
                rows.append((page_id, url_key(url), file, at, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()])], ["page_id", "url_key", "file", "offset", "length"])
        out.close()

    return full.mapInArrow(run, "page_id long, url_key string, file string, offset long, length long")


def _order(key: str, page_id: int | None) -> tuple[bytes, int]:
    return key.encode("utf-8", "replace"), -(2**63) if page_id is None else page_id


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes block and directory files; a row (directory file, first key, first id) for each part."""
    parts = max(2, captures.sparkSession.sparkContext.defaultParallelism, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = captures.repartitionByRange(parts, F.col("url_key").asc(), F.col("page_id").asc_nulls_first(), F.col("file").asc(), F.col("offset").asc()).sortWithinPartitions("url_key", F.col("page_id").asc_nulls_first(), "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, lines, directory = Writer(folder, ".blocks"), [], []

        def flush() -> None:
            data = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode("utf-8", "replace"), LEVEL)
            file, at = blocks.put(data)
            directory.append((*lines[0][:2], file, at, len(data)))
            lines.clear()

        for batch in batches:
            for key, page_id, *place in zip(*(batch.column(n).to_pylist() for n in ("url_key", "page_id", "file", "offset", "length"))):
                lines.append((key, "" if page_id is None else page_id, *place))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        blocks.close()
        found = []
        if directory:
            out = Writer(folder, ".dir")
            name, _ = out.put("\n".join("\t".join(map(str, x)) for x in directory).encode("utf-8", "replace"))
            out.close()
            found = [(name, directory[0][0], None if directory[0][1] == "" else directory[0][1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 3, [pa.string(), pa.string(), pa.int64()])], ["directory", "first_key", "first_id"])

    return ordered.mapInArrow(run, "directory string, first_key string, first_id long")


class Part:
    """One part of the index: its sparse directory, and the blocks that were read last."""

    def __init__(self, reader: Reader, name: str):
        self.reader = reader
        rows = [x.split("\t") for x in reader.whole(name).decode("utf-8").split("\n")]
        self.firsts = [_order(k, int(i) if i else None) for k, i, *_ in rows]
        self.places = [(f, int(o), int(n)) for _, _, f, o, n in rows]
        self.last: tuple[int, list, list] | None = None

    def block(self, k: int):
        if self.last is None or self.last[0] != k:
            lines = [x.split("\t") for x in zlib.decompress(self.reader.get(*self.places[k])).decode("utf-8").split("\n")]
            self.last = k, [_order(x[0], int(x[1]) if x[1] else None) for x in lines], [(f, int(o), int(n)) for _, _, f, o, n in lines]
        return self.last[1:]

    def find(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """Places of all captures of one key and id."""
        want, out = _order(key, page_id), []
        k = max(0, bisect_left(self.firsts, want) - 1)
        while k < len(self.firsts) and self.firsts[k] <= want:
            keys, places = self.block(k)
            out += places[bisect_left(keys, want) : bisect_right(keys, want)]
            k += 1
        return out


def lookup(queries: DataFrame, parts: DataFrame, archives: str, index: str) -> DataFrame:
    """Reads the records of (url, page_id) rows: page_id, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits).

    ``parts`` has a row for each part of the index; their number is that of the range partitions, not of pages."""
    tops = sorted((_order(r["first_key"], r["first_id"]), r["directory"]) for r in parts.collect())
    firsts, names = [a for a, _ in tops], [b for _, b in tops]
    if not tops:
        return queries.sparkSession.createDataFrame([], "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("page_id").to_pylist()
            keys = [url_key(u) for u in batch.column("url").to_pylist()]
            want = [_order(k, i) for k, i in zip(keys, ids)]
            # equal captures may straddle a boundary: every part that may hold some is asked
            pairs = [(p, k, i) for w, k, i in zip(want, keys, ids) for p in range(max(0, bisect_left(firsts, w) - 1), max(1, bisect_right(firsts, w)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*pairs)) or [[]] * 3, [pa.int32(), pa.string(), pa.int64()])], ["part", "url_key", "page_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warcs, blocks, part, at = Reader(archives), Reader(index), None, -1
        for batch in batches:
            rows = []
            for p, key, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                if p != at:
                    part, at = Part(blocks, names[p]), p
                for place in part.find(key, page_id):
                    fields, payload = parse(zlib.decompress(warcs.get(*place), 31))
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"record of page {page_id} doesn't match its digest")
                    rows.append((_id(fields["warc-record-id"]), kind, _id(fields["warc-refers-to"]) if kind == "revisit" else None, digest, len(payload) if kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"])

    routed = queries.select("url", "page_id").distinct().mapInArrow(route, "part int, url_key string, page_id long").distinct()
    # a range of keys a task: parts are cut further, and no task reads all parts
    tasks = max(2, queries.sparkSession.sparkContext.defaultParallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = routed.repartitionByRange(tasks, "part", "url_key", "page_id").sortWithinPartitions("part", "url_key", "page_id")
    return dealt.mapInArrow(read, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes, indexes and reads back all pages: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    small_batches(spark, 500)
    scratch = Scratch(spark, "warc")
    archives, index = scratch.path("archives"), scratch.path("index")
    captures = scratch.save(write_archives(pages, archives), "captures")
    parts = scratch.save(build_index(captures, index), "parts")
    found = scratch.save(lookup(pages, parts, archives, index), "found")
    # a revisit's payload is its response's
    whole = found.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    return found.join(whole, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


__all__ = ["build_index", "lookup", "parse", "record", "round_trip", "url_key", "write_archives"]
