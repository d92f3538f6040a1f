"""Web archives: WARC files written and read on any file system of the cluster, and their merged capture index.

A record is one gzip member, as the format asks for, so a capture's file, offset
and length are all that a reader needs to get at it (`record_at`). Files are
written by Spark's text writer: a row is a member, and the writer's line
separator is a member of no bytes, so a part file is a whole .warc.gz. A task
begins a new file after `FILE_BYTES`. Payloads of `LEAST_REVISIT` bytes or more
that several pages share are stored once, by the page of smallest key; the
others are revisit records with the digest, the response they refer to and the
HTTP head, whose Content-Length is that of the full payload.

Reading takes a file at a time, unpacks it record by record, checks each stored
payload against its digest and emits the file's captures sorted by URL key and
time: one run per file. `merge` cuts the runs into ranges of about `RANGE`
captures; in each range the runs' slices arrive one after another, as they were
sorted, and a loser tree merges them, so the result is in global order
(partition by partition).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import bounded_batches, materialise, shared_dir, skewed_lookup, text_of

CRLF = "\r\n"
LEAST_REVISIT = 100
#: Packed bytes after which a task begins a new file; captures in a merged range, about; rows of a batch that a range emits.
FILE_BYTES, RANGE, EMITTED = 16 << 20, 50_000, 10_000
LEVEL = 6  # of deflate
GZIP = 31  # zlib's window bits for gzip members
URN = "urn:x-capture:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
UNSAFE = re.compile(r"^\s+|\s+$|[\x00-\x1f\x7f]+")


def packed(data: bytes) -> bytes:
    """A gzip member; the same bytes give the same member."""
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return made.compress(data) + made.flush()


NOTHING = packed(b"")


def record(key: str | None, url: str | None, date: str, digest: str, payload: bytes, refers_to: str | None = None, revisit: bool = False) -> bytes:
    """One record. A null URL has no header; line ends, control characters and outer blanks of a URL are percent-encoded, and so is whatever a key has besides letters, digits and _.-~"""
    name = lambda k: f"<{URN}{quote(k or '', safe='')}>"
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(key)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {UNSAFE.sub(lambda m: quote(m[0]), url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return CRLF.join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def write(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> str:
    """Write one record per row and return the folder. A null payload is empty; a null date, or no `date` at all, is the epoch."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"), text_of(html).alias("payload"), (F.coalesce(F.col(date).cast("string"), F.lit(EPOCH)) if date else F.lit(EPOCH)).alias("date")
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    shared = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    shared = materialise(shared, "digests")
    typed = skewed_lookup(rows, shared, "digest", "n", pages.count()).withColumn("revisit", F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")))
    named = bounded_batches(typed.select(F.col("key").cast("string").alias("key"), "url", F.regexp_replace("date", r"\s+", " ").alias("date"), "digest", F.col("payload").cast("binary").alias("payload"), F.col("first").cast("string").alias("first"), "revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "url", "date", "digest", "payload", "first", "revisit")]
            members, volumes = [], []
            for k, u, d, digest, payload, first, revisit in zip(*columns, strict=True):
                members.append(packed(record(k, u, d, digest, payload, first, revisit)))
                volumes.append(written // FILE_BYTES)
                written += len(members[-1]) + len(NOTHING)
            yield pa.RecordBatch.from_pydict({"member": pa.array(members, pa.binary()), "volume": pa.array(volumes, pa.int32())})

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    made = named.mapInArrow(run, "member binary, volume int")
    # a string column is written byte for byte
    made.select(F.col("member").cast("string").alias("value"), "volume").write.partitionBy("volume").option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path)
    return path


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host reversed, without scheme, credentials, default port, leading www and fragment."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").lower().removeprefix("www."), u.port
    except ValueError:
        return (url or "").strip()
    if not host:
        return (url or "").strip()
    shown = f":{port}" if port and port != {"http": 80, "https": 443}.get(u.scheme) else ""
    return ",".join(reversed(host.split("."))) + shown + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers by lower-case name, block, offset, length) of every record of an unpacked WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(headers["content-length"])
        close = start + size + 4
        if data[close - 4 : close] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not close")
        yield headers, data[start : start + size], at, close - at
        at = close


def members(data: memoryview | bytes) -> Iterator[tuple[bytes, int, int]]:
    """(unpacked bytes, offset, length) of every gzip member that holds any; a damaged file raises."""
    data, at = memoryview(data), 0
    while at < len(data):
        unpack, out, fed = zlib.decompressobj(GZIP), [], at
        while not unpack.eof:
            if fed >= len(data):
                raise ValueError(f"the gzip member at byte {at} doesn't end")
            part = data[fed : fed + (1 << 14)]
            out.append(unpack.decompress(part))
            fed += len(part)
        end = fed - len(unpack.unused_data)
        if whole := b"".join(out):
            yield whole, at, end - at
        at = end


def record_at(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at a capture's place in its file."""
    headers, block, *_ = next(records(zlib.decompress(content[offset : offset + length], GZIP)))
    return headers, block


def _named(value: str | None) -> str | None:
    return unquote((value or "").strip("<>").removeprefix(URN)) or None


CAPTURE = "url_key string, date string, record_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, file string, offset bigint, length bigint, seq bigint"
NAMES = [f.split()[0] for f in CAPTURE.split(", ")]
WHOLE = ("payload_bytes", "offset", "length", "seq")


def capture_of(headers: dict[str, str], block: bytes, where: str) -> tuple:
    """A record's capture up to its digest; a payload that isn't what its digest says raises."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = headers["warc-payload-digest"].partition(":")[2], len(payload)
    if headers["warc-type"] == "revisit":
        size = int(next(x for x in http.decode().split(CRLF) if x.lower().startswith("content-length:")).partition(":")[2])
    elif hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{where}: a payload differs from its digest")
    uri = headers.get("warc-target-uri")
    return url_key(uri), headers["warc-date"], _named(headers["warc-record-id"]), uri, headers["warc-type"], _named(headers.get("warc-refers-to")), size, digest


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures per archive file."""
    files = bounded_batches(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for member, offset, length in members(memoryview(content.as_buffer())):
                    for headers, block, *_ in records(member):
                        rows.append((*capture_of(headers, block, f"{file}, byte {offset}"), file, offset, length))
                rows.sort(key=_order)
                columns = [*zip(*rows, strict=True)] or [()] * (len(NAMES) - 1)
                out = {n: pa.array(c, pa.int64() if n in WHOLE else pa.string()) for n, c in zip(NAMES[:-1], columns, strict=True)}
                yield pa.RecordBatch.from_pydict(out | {"seq": pa.array(range(len(rows)), pa.int64())})

    return files.mapInArrow(run, CAPTURE)


def _order(row: tuple) -> tuple:
    """URL key, time, then the record's name, shorter first, so that numbers are in numeric order."""
    return row[0], row[1], len(row[2] or ""), row[2] or ""


class LoserTree:
    """k-way merge of sorted lists: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[list[tuple]], order=_order):
        self.runs, self.order = runs, order
        self.k = max(1, len(runs))
        self.at = [0] * len(runs)
        self.head = [self._key(i) for i in range(len(runs))]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if runs else -1

    def _key(self, i: int):
        return self.order(self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else None

    def _beats(self, a: int, b: int) -> bool:
        """An exhausted run loses; of equal heads the earlier run wins."""
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.head[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.head[w] = self._key(w)
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge(runs: DataFrame) -> DataFrame:
    """Captures in global order: by partition, and by `position` within a partition.

    Ranges are cut by URL key, time, record and place, so a URL that many
    captures share, and even captures alike in all but their place, are spread
    over partitions and a history stays contiguous. A range of about `RANGE`
    captures is held as Arrow columns while its order is found, and emitted in
    batches.
    """
    stored = materialise(runs, "runs")
    ranges = max(1, -(-stored.count() // RANGE))
    dealt = bounded_batches(stored.repartitionByRange(ranges, "url_key", "date", F.length(F.coalesce("record_id", F.lit(""))), "record_id", "file", "seq").sortWithinPartitions("file", "seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*batches]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [*zip(*(table.column(n).to_pylist() for n in ("url_key", "date", "record_id", "file")), strict=True)]
        slices: dict[str, list[int]] = {}
        for i, k in enumerate(keys):
            slices.setdefault(k[3], []).append(i)
        order = [*LoserTree([*slices.values()], lambda i: _order(keys[i]))]
        for low in range(0, len(order), EMITTED):
            part = table.take(pa.array(order[low : low + EMITTED], pa.int64())).combine_chunks()
            out = {n: part.column(n).combine_chunks() for n in NAMES}
            yield pa.RecordBatch.from_pydict(out | {"position": pa.array(range(low, low + part.num_rows), pa.int64())})

    return dealt.select(*NAMES).mapInArrow(run, CAPTURE + ", position bigint")


def archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """Write the archives, read them back and merge their indexes: one capture per row of `pages`.

    Repeated rows are captures of their own; of rows with the smallest key of a
    shared payload all are responses. A null key is a response unless another
    row holds the payload. An empty table gives no capture.
    """
    return merge(captures(pages.sparkSession, write(pages, key=key, url=url, html=html, date=date)))
