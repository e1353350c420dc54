"""WARC archives with a two-level capture index.

Writing: equal payloads are grouped by digest, the largest page_id of a group is the response and the others revisit it;
each task writes its records, one gzip member each, to a file of its own in the shared folder and returns a manifest row
per record. A second try of a task writes another file; only files that the manifest names count.
Index: captures sorted by reversed-host URL key are cut into compressed blocks (level one). A sparse directory keeps each
block's first and last key and place (level two); it is itself cut into compressed pages beside the blocks, so that what
the driver holds is one row for each page: one in about a million captures, and one for each task that wrote.
Reading: a lookup finds its page by binary search over those rows; lookups are sorted, so a task range-reads a page once,
finds the block by binary search in it, range-reads and inflates that once, and searches its key there. The record is then
range-read; reads of records that adjoin are merged.

Cases: a null html is an empty payload; a null url has the empty key; a null page_id is archived but is no one's
referent (it revisits if a row with an id has its payload, and responds otherwise); rows that repeat a page_id are each
archived, and the referent of equal payloads is still the largest page_id: of several rows with it, all are responses; a
payload of any length is one record; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import hot_keys, materialize, scratch_path, spread_join

BLOCK_CAPTURES = 1000
PAGE_BLOCKS = 1000
#: Records whose gap is under this are fetched by one range read, up to this many bytes.
MERGE_GAP, MERGE_BYTES = 16 << 10, 8 << 20
RECORDED_AT = "2024-01-01T00:00:00Z"
MANIFEST = "capture_key string, page_id long, payload_digest string, record_type string, file string, offset long, size long"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: `com,example,www)/a?b`. Scheme, port and fragment are left out."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str, page_id, payload: bytes, payload_digest: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has no payload but says whose it is and how long it was."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", f"WARC-Date: {RECORDED_AT}",
        f"WARC-Target-URI: {''.join(c for c in url if c >= ' ')}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return {"fields": fields, "payload": payload, "length": length}


#: Names that Hadoop has for stores which Arrow opens by another name.
SAME_STORE = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs", "viewfs": "hdfs"}


def store_uri(uri: str) -> str:
    """A folder's address as Arrow knows it. Archives are files with ranges in them, so a store must be one that Arrow opens
    (local, s3, gcs, abfs, hdfs), by whichever of its names Hadoop is set up with."""
    scheme, colon, rest = uri.partition("://")
    return SAME_STORE.get(scheme, scheme) + colon + rest if colon else uri


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(store_uri(uri))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write every row of (page_id, url, html) and return the manifest, itself a table in the shared folder."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    referents = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1 and largest is not null")
    referents = materialize(referents, "warc-referents")
    # A payload that a large share of the pages have is dealt to several tasks.
    salt = F.xxhash64(F.coalesce("page_id", F.lit(0)), F.coalesce("url", F.lit("")))
    told = spread_join(rows, referents.drop("n"), ["sha"], hot_keys(referents, ["sha"]), salt, "left").select("page_id", "url", "html", F.when((F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))

    def run(batches):
        filesystem, root = _filesystem(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        sink, at = None, 0
        for batch in batches:
            out = []
            for page_id, url, text, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if sink is None:
                    filesystem.create_dir(root, recursive=True)
                    sink = filesystem.open_output_stream(f"{root}/{name}", compression=None)
                payload = text.encode("utf-8", "surrogatepass")
                kind, sha = "response" if refers_to is None else "revisit", digest(payload)
                member = record(kind, url or "", page_id, payload, sha, refers_to)
                sink.write(member)
                out.append((url_key(url), page_id, sha, kind, name, at, len(member)))
                at += len(member)
            if sink is not None:
                sink.flush()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
                ["capture_key", "page_id", "payload_digest", "record_type", "file", "offset", "size"],
            )
        if sink is not None:
            sink.close()

    return materialize(told.mapInArrow(run, MANIFEST), "warc-manifest")


def escaped(key: str) -> F.Column:
    """The key as a block's line holds it: the order of blocks and look-ups is that of this form."""
    return F.replace(F.replace(F.col(key), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))


def build_index(manifest: DataFrame, folder: str, block_captures: int = BLOCK_CAPTURES, page_blocks: int = PAGE_BLOCKS) -> DataFrame:
    """Write the captures' blocks and the directory's pages; returns the pages' places: low and high (first and last key),
    blocks, index_file, offset, size."""
    captures = manifest.select(escaped("capture_key").alias("capture_key"), F.to_json(F.struct("page_id", "file", "offset", "size")).alias("entry"))
    n = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = captures.repartitionByRange(int(n), "capture_key", F.xxhash64("entry")).sortWithinPartitions("capture_key", "entry")

    def run(batches):
        filesystem, root = _filesystem(folder)
        task = TaskContext.get()
        name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.cdx"
        sink, at = None, 0
        held, blocks, pages = [], [], []  # captures of this block, blocks of this page, pages not yet told

        def put(lines: list[str]) -> tuple[int, int]:
            nonlocal sink, at
            if sink is None:
                filesystem.create_dir(root, recursive=True)
                sink = filesystem.open_output_stream(f"{root}/{name}", compression=None)
            packed = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            sink.write(packed)
            at += len(packed)
            return at - len(packed), len(packed)

        def end_block():
            if held:
                place = put([f"{k} {e}" for k, e in held])
                blocks.append((held[0][0], held[-1][0], *place))
                held.clear()

        def end_page():
            if blocks:
                pages.append((blocks[0][0], blocks[-1][1], len(blocks), name, *put([" ".join(map(str, b)) for b in blocks])))
                blocks.clear()

        def told():
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pages) if pages else [[]] * 6, kinds)], ["low", "high", "blocks", "index_file", "offset", "size"])
            pages.clear()
            return out

        for batch in batches:
            for capture in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(capture)
                if len(held) >= block_captures:
                    end_block()
                    if len(blocks) >= page_blocks:
                        end_page()
            if pages:
                yield told()
        end_block()
        end_page()
        if pages:
            yield told()
        if sink is not None:
            sink.close()

    return materialize(ordered.mapInArrow(run, "low string, high string, blocks long, index_file string, offset long, size long"), "warc-directory")


class Index:
    """Reads pages of the directory and blocks of captures, one of each at a time."""

    def __init__(self, folder: str, pages: list[dict]):
        self.filesystem, self.root = _filesystem(folder)
        self.pages, self.page, self.block = pages, None, None

    def inflate(self, file: str, offset: int, size: int) -> list[str]:
        with self.filesystem.open_input_file(f"{self.root}/{file}") as source:
            return zlib.decompress(source.read_at(size, offset)).decode("utf-8", "surrogatepass").split("\n")

    def open_page(self, no: int):
        if no != self.page:
            place = self.pages[no]
            rows = [x.split(" ") for x in self.inflate(place["index_file"], place["offset"], place["size"])]
            self.lows, self.highs, self.places = [r[0] for r in rows], [r[1] for r in rows], [(int(r[2]), int(r[3])) for r in rows]
            self.page, self.block = no, None

    def open_block(self, no: int):
        if no != self.block:
            rows = [x.split(" ", 1) for x in self.inflate(self.pages[self.page]["index_file"], *self.places[no])]
            self.keys, self.entries, self.block = [r[0] for r in rows], [r[1] for r in rows], no

    def captures(self, page: int, key: str):
        """The entries of a key in a page, from all blocks that it reaches into."""
        self.open_page(page)
        for no in range(bisect.bisect_left(self.highs, key), bisect.bisect_right(self.lows, key)):
            self.open_block(no)
            for at in range(bisect.bisect_left(self.keys, key), bisect.bisect_right(self.keys, key)):
                yield json.loads(self.entries[at])


def lookup(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Captures of each (lookup_id, capture_key): lookup_id, capture_key, page_id, file, offset, size. A key with no
    capture has no row; a key with several captures has a row for each, from every page and block that it reaches into."""
    asked = keys.filter("lookup_id is not null and capture_key is not null").select("lookup_id", escaped("capture_key").alias("capture_key"))
    pages = sorted(directory.toArrow().to_pylist(), key=lambda x: (x["low"], x["high"], x["index_file"], x["offset"]))
    lows, highs = [x["low"] for x in pages], [x["high"] for x in pages]

    def choose(batches):
        for batch in batches:
            found = [(i, no) for i, key in enumerate(batch.column(1).to_pylist()) for no in range(bisect.bisect_left(highs, key), bisect.bisect_right(lows, key))]
            picked = batch.take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), pa.array([no for _, no in found], pa.int64())], ["lookup_id", "capture_key", "page"])

    placed = asked.mapInArrow(choose, "lookup_id long, capture_key string, page long")
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(n, "page", "capture_key", "lookup_id").sortWithinPartitions("page", "capture_key")

    def run(batches):
        index = Index(folder, pages)
        for batch in batches:
            out = []
            for lookup_id, key, page in zip(*(batch.column(k).to_pylist() for k in range(3))):
                out += [(lookup_id, key, e.get("page_id"), e["file"], e["offset"], e["size"]) for e in index.captures(page, key)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["lookup_id", "capture_key", "page_id", "file", "offset", "size"])

    return ordered.mapInArrow(run, "lookup_id long, capture_key string, page_id long, file string, offset long, size long")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Range-read and parse the records at (file, offset, size): page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, html (null for a revisit). A response's digest is checked against its payload."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.select("file", "offset", "size").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"

    def run(batches):
        filesystem, root = _filesystem(folder)
        source = name = None
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            i = 0
            while i < len(places):
                j = i + 1
                while j < len(places) and places[j][0] == places[i][0] and places[j][1] - places[j - 1][1] - places[j - 1][2] <= MERGE_GAP and places[j][1] + places[j][2] - places[i][1] <= MERGE_BYTES:
                    j += 1
                if places[i][0] != name:
                    if source is not None:
                        source.close()
                    name = places[i][0]
                    source = filesystem.open_input_file(f"{root}/{name}")
                low = places[i][1]
                raw = source.read_at(places[j - 1][1] + places[j - 1][2] - low, low)
                out = []
                for _, offset, size in places[i:j]:
                    found = parse(raw[offset - low : offset - low + size])
                    fields, payload = found["fields"], found["payload"]
                    kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != sha:
                        raise ValueError(f"damaged record at {offset} of {name}")
                    text = payload.decode("utf-8", "surrogatepass") if kind == "response" else None
                    page = fields["X-Page-ID"]
                    refers_to = int(fields["X-Refers-To-Page"]) if kind == "revisit" else None
                    out.append((int(page) if page else None, fields["WARC-Target-URI"], found["length"], sha, kind, refers_to, text))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
                i = j
        if source is not None:
            source.close()

    return ordered.mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive every page, index the archives, look every capture up by its URL key and read its record back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write_archives(pages, folder, min_bytes)
    directory = build_index(manifest, folder)
    keys = manifest.select(escaped("capture_key").alias("capture_key")).distinct().select(F.xxhash64("capture_key").alias("lookup_id"), "capture_key")
    return read_records(lookup(keys, directory, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
