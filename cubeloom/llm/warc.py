"""WARC archives of pages, and one index of them by an external merge.

Pages are written as WARC/1.0 files of gzipped records to shared storage.  Of
records with equal payloads of at least ``MIN_REVISIT`` bytes that of the least
page_id is the response, and the others are revisits that refer to it.  Reading
an archive back gives a capture run, sorted by URL key and timestamp.  Runs are
cut at common splitters, and each range of keys merges its k cut runs with a
loser tree, so that ranges one after another are the globally ordered capture
histories.

Splitters come from a sample of at most about ``SAMPLE`` keys; they decide how
even the ranges are, never what is in them.  They hold the timestamp, so that
captures of one frequent URL fall into several ranges.

Pages carry no capture time: by default the n-th page is captured n seconds
after the start of 2020.  Defined results: null html is an empty payload; a null
url has the empty key and no target; a null page_id is always a response, and
nothing refers to it; repeated rows are repeated captures, and of rows with
equal page_id and payload none refers to the other; extra columns are ignored;
an empty table gives no archives and an empty index.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from typing import Any
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 100
#: Bytes of compressed records after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Keys that are looked at for each range of the merge, on average.
SAMPLE = 32
#: Captures for each range of the merge, on average.
RANGE_CAPTURES = 200_000
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
_ID = "urn:capture:page:"


# -- records ----------------------------------------------------------------------------------


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host from the right, no scheme, port, www. or fragment, parameters in order."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return quote(url.lower())
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    path = parts.path.lower().rstrip("/") or "/"
    return ",".join(reversed(host.split("."))) + ")" + path + ("?" + query if query else "")


def capture_time(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 33))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzipped record: a response, or a revisit if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {capture_time(page_id)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def records(data: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record of an archive."""
    at = 0
    while at < len(data):
        begin, unpack, out = at, zlib.decompressobj(31), []
        while not unpack.eof:
            part = data[at : at + step]
            if not part:
                raise ValueError("an archive ends inside a record")
            out.append(unpack.decompress(part))
            at += len(part)
        at -= len(unpack.unused_data)
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield begin, at - begin, fields, rest[:size]


def _page(ref: str | None) -> int | None:
    number = ref.strip("<>").removeprefix(_ID) if ref else ""
    return int(number) if number else None


def capture(archive: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> dict[str, Any]:
    """What the index holds of a record; a response's payload is checked against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{archive}: a payload differs from its digest")
    key = url_key(fields.get("WARC-Target-URI"))
    return {
        "url_key": key, "timestamp": fields["WARC-Date"], "page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get("WARC-Refers-To")), "archive": archive, "offset": offset,
        "length": length,
    }


_CAPTURE = pa.struct([
    ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
CAPTURE = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def order(c: dict[str, Any]) -> tuple:
    return c["url_key"], c["timestamp"], c["page_id"] is not None, c["page_id"] or 0, c["archive"], c["offset"]


# -- the merge --------------------------------------------------------------------------------


def merge_runs(runs: list[Iterable[dict[str, Any]]]) -> Iterator[dict[str, Any]]:
    """k sorted runs as one, by a loser tree: each output replays one path of about log2 k matches."""
    streams = [iter(r) for r in runs]
    k = len(streams)
    if not k:
        return
    head: list[dict[str, Any] | None] = [next(s, None) for s in streams]
    key: list[tuple | None] = [None if h is None else order(h) for h in head]

    def beats(a: int, b: int) -> bool:
        """An exhausted run loses; of equal heads the earlier run wins."""
        if key[a] is None or key[b] is None:
            return key[b] is None and (key[a] is not None or a < b)
        return (key[a], a) < (key[b], b)

    loser = [-1] * k  # inner nodes 1..k-1 keep the loser of their match; node 0 the winner of all
    winner = [-1] * (2 * k)
    winner[k:] = range(k)
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while head[top] is not None:
        yield head[top]
        head[top] = next(streams[top], None)
        key[top] = None if head[top] is None else order(head[top])
        node = (top + k) // 2
        while node:
            if beats(loser[node], top):
                top, loser[node] = loser[node], top
            node //= 2


# -- Spark ------------------------------------------------------------------------------------


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    digest = F.unhex(F.sha2(payload, 256)).alias("digest")
    short = common.settle(pages.filter(F.octet_length(payload) >= MIN_REVISIT).select("page_id", digest), "payloads")
    first = short.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = common.settle(first, "copied-payloads")
    copied = common.join_counted(short, first, "digest", short.count())
    revisits = copied.filter("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    whole = pages.select("page_id", "url", "html", digest)
    return whole.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html, refers_to); returns the settled list of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            name = f"{uuid.uuid4().hex}.warc.gz"
            common.put(folder, name, b"".join(held))
            row = pa.RecordBatch.from_pydict({"archive": [name], "n": pa.array([len(held)], pa.int64())})
            held, size = [], 0
            return row

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, (html or "").encode(), refers_to))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long"))
    return common.settle(rows.mapInArrow(task, "archive string, n long"), "archives")


def splitters(pages: DataFrame, n_rows: int, ranges: int) -> list[tuple[str, str]]:
    """At most ``ranges`` - 1 (URL key, timestamp) pairs, from a sample of ``SAMPLE`` rows for each range."""
    every = max(1, n_rows // (SAMPLE * ranges))
    # equal rows are drawn one by one
    some = pages.select("page_id", "url").filter(F.pmod(F.xxhash64("url", "page_id", F.monotonically_increasing_id()), F.lit(every)) == 0)
    keys = sorted((url_key(r["url"]), capture_time(r["page_id"])) for r in some.toLocalIterator())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def index(folder: str, archives: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Captures of all archives in global order of (range, position)."""
    spark = archives.sparkSession
    if archives.isEmpty():
        return spark.createDataFrame([], f"range int, position long, {CAPTURE}")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = posixpath.basename(path)
                run = sorted((capture(name, *r) for r in records(content.as_buffer().to_pybytes())), key=order)
                parts: dict[int, list[dict]] = {}
                for c in run:
                    parts.setdefault(bisect_right(cuts, (c["url_key"], c["timestamp"])), []).append(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(parts), pa.int32()), pa.array([name] * len(parts), pa.string()), pa.array(list(parts.values()), pa.list_(_CAPTURE))],
                    names=["range", "archive", "run"],
                )

    def merge(table: pa.Table) -> pa.Table:
        # runs in order of their archive, so that reruns agree
        rows = sorted(zip(table.column("archive").to_pylist(), table.column("run").to_pylist(), strict=True), key=lambda x: x[0])
        merged = pa.array(list(merge_runs([run for _, run in rows])), _CAPTURE)
        n, number = len(merged), table.column("range")[0].as_py()
        return pa.table(
            [pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int64()), *merged.flatten()],
            names=["range", "position", *[f.name for f in _CAPTURE]],
        )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    cut = files.mapInArrow(runs, f"range int, archive string, run array<struct<{', '.join(x.replace(' ', ':') for x in CAPTURE.split(', '))}>>")
    whole = cut.join(archives.select("archive"), "archive", "left_semi")  # not those of lost attempts
    return whole.groupBy("range").applyInArrow(merge, f"range int, position long, {CAPTURE}")


def histories(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html), read them back, and merge their index."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html")
    folder = folder or common.shared_dir(spark, "warc")
    archives = write(with_references(rows), folder)
    n_rows = archives.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // RANGE_CAPTURES)
    return index(folder, archives, splitters(rows, n_rows, ranges))


def op1(pages: DataFrame) -> DataFrame:
    return histories(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Payloads by their bytes; the merged index behind the rows is tested in ``tests/llm``.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""
