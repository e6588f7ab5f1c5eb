"""Deterministic sharded WARC archives: written by range, rolled by compressed size, committed by a manifest, read back.

Rows are sorted by page id and payload. Shards are ranges of that order of equal bytes: exact running sums over narrow
rows (id, size, digest) give each shard's first key, whatever the partitions of the input. A task streams one shard's rows
into files that begin anew when the next compressed record would exceed the size asked for. Headers, record ids and
digests are made from the row alone, so that equal tables give equal files, byte for byte.

Each attempt of a task writes under temporary names of its own. The names that count are those in the manifest, which
Spark commits once for each task; `commit` then moves these files to their final names and marks the archive. It can be
repeated at any time, so that a driver lost between the steps loses nothing, and readers refuse an archive that isn't marked.

Of equal payloads one record holds the payload, the others refer to it. Files are written and read by pyarrow's file systems,
which must know the folder's scheme.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .repeats import spooled
from .textops import Batches, utf8

#: Bytes of payload in a shard, compressed bytes of a file, and payloads from which equal ones are revisits.
SHARD_BYTES, FILE_BYTES, LEAST = 128 << 20, 64 << 20, 1000
#: Bytes of repeated payloads' keys that are broadcast, bytes of records given at once, and of a file read at once.
BROADCAST_BYTES, CHUNK, PAGE = 64 << 20, 1 << 20, 1 << 16
LEVEL = 6
#: Fixed values of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
SPACE_OF_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "formline:warc")
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "shard int, number int, temporary string, name string, records long, bytes long, sha1 string"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder given as a URI or a path, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: bytes, copy: int) -> str:
    """The id of the copy-th record of a page id and payload."""
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, f'{page_id}/{digest.hex()}/{copy}')}>"


def record(fields: list[tuple[str, str | bytes | None]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(k.encode() + b": " + (v if isinstance(v, bytes) else v.encode()) for k, v in fields if v is not None)]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block, b"", b""])


def page_record(page_id: int | None, url: bytes | None, payload: bytes, copy: int, date: str, refers: tuple[int | None] | None) -> bytes:
    """A response, or a revisit of the page in `refers`, as one record."""
    digest = hashlib.sha1(payload).digest()
    head = HEAD % len(payload)
    block = head + payload if refers is None else head
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url and UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url)),
        ("WARC-Page-ID", None if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", labelled(digest)),
        ("WARC-Block-Digest", labelled(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers[0], digest, 0)), ("WARC-Refers-To-Page-ID", None if refers[0] is None else str(refers[0]))]
    return record(fields, block)


def zipped(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member without a time."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Roll:
    """Files of one shard, the next of which begins before a member would exceed the size."""

    def __init__(self, path: str, shard: int, most: int, date: str):
        self.fs, self.root = file_system(path)
        self.shard, self.most, self.date = shard, most, date
        self.done: list[tuple] = []
        self.stream = None

    def add(self, member: bytes) -> None:
        if self.stream is not None and self.records and self.size + len(member) > self.most:
            self.close()
        if self.stream is None:
            self.name = f"part-{self.shard:08d}-{len(self.done):05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.stream = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.records, self.size, self.sha1 = 0, 0, hashlib.sha1()
            info = "software: formline\r\nformat: WARC File Format 1.1\r\n".encode()
            fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, self.name)}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("WARC-Block-Digest", labelled(hashlib.sha1(info).digest())), ("Content-Type", "application/warc-fields")]
            self._put(zipped(record(fields, info)))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes) -> None:
        self.stream.write(member)
        self.sha1.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append((self.shard, len(self.done), self.temporary, self.name, self.records, self.size, self.sha1.hexdigest()))
            self.stream = None


def _key(page_id: Column, digest: Column) -> Column:
    """A string that sorts by page id, null first, then payload."""
    return F.concat(F.coalesce(F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("")), F.lit("/"), digest)


def _first_keys(narrow: DataFrame, shard_bytes: int) -> list[str]:
    """The first key of each shard: where the running sum of bytes in the order of keys passes a multiple of shard_bytes."""
    dealt = narrow.select("key", "size").repartitionByRange("key").withColumn("part", F.spark_partition_id())
    held = spooled(dealt)
    total = {r.part: int(r.size) for r in held.groupBy("part").agg(F.sum("size").alias("size")).collect()}
    before, offsets = 0, {}
    for part in sorted(total):
        offsets[part] = before
        before += total[part]
    if not offsets:
        return []
    base = F.get(F.lit([offsets.get(i, 0) for i in range(max(offsets) + 1)]), F.col("part"))
    running = F.sum("size").over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    shard = F.floor((base + F.coalesce(running, F.lit(0))) / F.lit(shard_bytes))
    return [r.key for r in held.select(shard.alias("shard"), "key").groupBy("shard").agg(F.min("key").alias("key")).orderBy("key").collect()]


def stage(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least: int = LEAST, date: str = "1970-01-01T00:00:00Z", level: int = LEVEL, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the files of an archive under temporary names, and the manifest that names those that count. See `write`."""
    spark = pages.sparkSession
    fs, root = file_system(path)
    if fs.get_file_info(f"{root}/_manifest").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{path} holds an archive")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    narrow = spooled(rows.select(_key(F.col("page_id"), F.col("digest")).alias("key"), "page_id", "digest", F.octet_length("html").cast("long").alias("size")))
    repeated = narrow.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("again"), "response", F.lit(True).alias("repeated"))
    repeated = spooled(repeated)
    first = np.array([k.encode() for k in _first_keys(narrow, shard_bytes)] or [b""])
    if repeated.count() * 200 <= BROADCAST_BYTES:
        repeated = F.broadcast(repeated)

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(first, key.to_numpy().astype("S"), side="right") - 1, 0))

    decided = rows.join(repeated, rows.digest == repeated.again, "left").withColumn("key", _key(F.col("page_id"), F.col("digest")))
    dealt = decided.withColumn("shard", shard_of("key")).select("shard", "key", "page_id", "url", "html", "repeated", "response")
    dealt = dealt.repartitionById(len(first), F.col("shard")).sortWithinPartitions("shard", "key", "url")

    def run(batches: Batches) -> Batches:
        roll, last, copy, done = None, None, 0, []
        for b in batches:
            ids, again, response = (b.column(c).to_pylist() for c in ("page_id", "repeated", "response"))
            urls = [x if x is None else x.encode() for x in b.column("url").to_pylist()]
            for shard, key, page_id, url, payload, more, to in zip(b.column("shard").to_pylist(), b.column("key").to_pylist(), ids, urls, utf8(b.column("html")), again, response):
                if roll is None or roll.shard != shard:
                    if roll is not None:
                        roll.close()
                        done += roll.done
                    roll = Roll(path, shard, file_bytes, date)
                copy = copy + 1 if key == last else 0
                last = key
                refers = None if not more or (page_id == to and not copy) else (to,)
                roll.add(zipped(page_record(page_id, url, payload, copy, date, refers), level))
        if roll is not None:
            roll.close()
            done += roll.done
        columns = list(zip(*done)) or [[]] * 7
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{path}/_manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def commit(spark: SparkSession, path: str) -> None:
    """Gives the manifest's files their final names, drops what other attempts left and marks the archive; repeating it changes nothing."""

    def run(batches: Batches) -> Batches:
        fs, root = file_system(path)
        for b in batches:
            for temporary, name, size in zip(*(c.to_pylist() for c in b.columns)):
                there = fs.get_file_info(f"{root}/{temporary}")
                if there.type == pafs.FileType.File:
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
                if (told := fs.get_file_info(f"{root}/{name}")).type != pafs.FileType.File or told.size != size:
                    raise FileNotFoundError(f"{path}/{name} is missing or not whole")
            yield b.select(["name"])

    fs, root = file_system(path)
    if fs.get_file_info(f"{root}/_SUCCESS").type == pafs.FileType.File:
        return
    manifest(spark, path).select("temporary", "name", "bytes").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
    if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{root}/_temporary")
    with fs.open_output_stream(f"{root}/_SUCCESS") as mark:
        mark.write(b"")


def write(pages: DataFrame, path: str, **settings) -> DataFrame:
    """Writes each row of pages as a WARC record under path, and returns the manifest: one row for each file.

    Of rows with equal payloads of at least `least` bytes, the one of the largest page id is the response; if it has
    several, the one of the smallest url. The others, and all of them if ids are null but one, revisit it. A null html is
    empty, a null url leaves out the target; spaces and control characters of urls are escaped. Equal rows have a record
    each. Null ids come first and stand in no header. An empty table gives an empty manifest; other columns aren't read.
    A record is held whole in a task, a shard isn't. path must not hold an archive yet.
    """
    stage(pages, path, **settings)
    commit(pages.sparkSession, path)
    return manifest(pages.sparkSession, path)


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member of a stream."""
    unpacker, out, rest = None, [], b""
    while data := rest or stream.read(PAGE):
        rest = b""
        unpacker = unpacker or zlib.decompressobj(31)
        out.append(unpacker.decompress(data))
        if unpacker.eof:
            rest, unpacker = unpacker.unused_data, None
            yield b"".join(out)
            out = []
    if unpacker is not None:
        raise ValueError("the last record of an archive isn't whole")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError(f"a record of {len(rest) - 4} bytes says it has {size}")
    return fields, rest[:size]


def told(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, record_type, record_id, payload_bytes, payload_digest, refers_to, payload) of a response or revisit, whose digests are checked."""
    if fields["warc-block-digest"] != labelled(hashlib.sha1(block).digest()):
        raise ValueError(f"block of {fields['warc-record-id']} differs from its digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or fields["warc-payload-digest"] != labelled(hashlib.sha1(payload).digest())):
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    number = lambda name: int(fields[name]) if name in fields else None
    return number("warc-page-id"), fields.get("warc-target-uri"), kind, fields["warc-record-id"], size, digest, number("warc-refers-to-page-id"), payload if kind == "response" else None


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The responses and revisits of a committed archive, one row each: page_id, url (escaped), record_type, record_id, payload_bytes, payload_digest, refers_to, payload (null in revisits, or left out).

    Payload size and digest are those of the whole payload, in revisits too. Raises if the archive isn't committed, or a
    file, record or digest differs from what was written.
    """
    fs, root = file_system(path)
    if fs.get_file_info(f"{root}/_SUCCESS").type != pafs.FileType.File:
        raise FileNotFoundError(f"{path} holds no committed archive")
    schema = RECORDS if payload else pa.schema([f for f in RECORDS if f.name != "payload"])

    def run(batches: Batches) -> Batches:
        fs, root = file_system(path)
        for b in batches:
            for name, records in zip(*(c.to_pylist() for c in b.columns)):
                rows, size, n = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, block = parsed(data)
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        row = told(fields, block)
                        rows.append(row if payload else row[:-1])
                        n, size = n + 1, size + (len(block) if payload else 200)
                        if size > CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if n != records:
                    raise ValueError(f"{name} holds {n} records, its manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = manifest(spark, path).select("name", "records")
    kinds = "page_id long, url string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, kinds)
