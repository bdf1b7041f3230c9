"""WARC archives of web pages with revisit records, and a globally ordered capture index.

Each task writes one archive, a gzip member a record, and beside it a capture run: its index
lines sorted by URL key, timestamp and page, with a sparse index of their offsets. The runs are then
merged with a k-way loser tree: the key space is cut at sampled keys, each merge task reads its
key range out of every run and writes one part of the global index; with more than
``FAN_IN`` runs, groups of runs are first merged into longer ones. Archives are read back through the merged
index, so every URL's capture history comes in order.

Of pages with equal payloads of at least 1000 bytes, that with the largest page_id is stored as a response;
the others are revisit records, which name it and hold no payload.

Nulls and edge cases: a null html is an empty payload; a null url has an empty key; a null page_id
is kept as null and is never the response of a group with other ids; rows that repeat a
group's largest page_id are all responses; an empty table writes nothing and reads nothing; other
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.llm.workspace import fresh_dir, publish

LEAST_REVISIT = 1000
FAN_IN = 256
SPARSE = 128
SAMPLES = 8
#: Largest number of repeated payloads whose digests are broadcast (about 60 bytes each).
BROADCAST_DIGESTS = 500_000
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query; without scheme, user, default port and fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return quote(url, safe="/:?&=%~+,;")
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return quote(key + ")" + (u.path or "/") + (f"?{u.query}" if u.query else ""), safe="/:?&=%~+,;)(!*'$@[]")


def capture_time(page_id: int | None) -> datetime:
    """When a page without a capture time counts as captured: a second for each page_id."""
    return _EPOCH + timedelta(seconds=(page_id or 0) % 10**8)


class LoserTree:
    """k-way merge: inner nodes hold the losers of a tournament of the runs' heads, so that each
    next item costs one replay from its leaf to the root."""

    def __init__(self, sources: list):
        self.sources = [iter(s) for s in sources]
        self.k = len(self.sources)
        self.heads = [next(s, None) for s in self.sources]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, at = leaf, (leaf + self.k) // 2
        while at > 0:
            other = self.tree[at]
            if other == -1 and building:
                self.tree[at] = winner
                return
            if self._before(other, winner):
                self.tree[at], winner = winner, other
            at //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.heads[winner := self.tree[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = next(self.sources[winner], None)
            self._replay(winner)


def _order(line: str) -> tuple[str, str, int]:
    key, stamp, page = line.split("\t", 3)[:3]
    return key, stamp, int(page)


def write_run(out, lines) -> tuple[int, list]:
    """Sorted index lines, then a sparse index of every 128th line's place and its length. Returns
    the number of lines and sampled keys."""
    sparse, at, n = [], 0, 0
    for _, line in lines:
        data = (line + "\n").encode()
        if n % SPARSE == 0:
            sparse.append([*_order(line), at])
        out.write(data)
        at += len(data)
        n += 1
    tail = zlib.compress(json.dumps([at, sparse]).encode())
    out.write(tail + len(tail).to_bytes(8, "little"))
    return n, [s[:3] for s in sparse[:: max(1, len(sparse) // SAMPLES)]][: SAMPLES + 1]


def read_run(system: fs.FileSystem, path: str, low: tuple | None, high: tuple | None):
    """(order, line) of a run's lines with low <= order < high."""
    with system.open_input_file(path) as source:
        size = source.size()
        source.seek(size - 8)
        length = int.from_bytes(source.read(8), "little")
        source.seek(size - 8 - length)
        end, sparse = json.loads(zlib.decompress(source.read(length)))
        at = 0
        if low is not None and sparse:
            at = sparse[max(0, bisect.bisect_left([tuple(s[:3]) for s in sparse], low) - 1)][3]
        rest = b""
        source.seek(at)
        while at < end:
            data = source.read(min(1 << 16, end - at))
            at += len(data)
            *lines, rest = (rest + data).split(b"\n")
            for raw in lines:
                line = raw.decode()
                order = _order(line)
                if high is not None and order >= high:
                    return
                if low is None or order >= low:
                    yield order, line


def record(page_id, url, stamp, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member; a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {stamp:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {quote(url or '', safe='/:?&=%~+,;#!*()@[]$')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(member: bytes) -> dict:
    """What a record says: page_id, type, payload size, hex digest, the page it refers to, url and payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if field["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda x: None if x == "none" else int(x)
    page = number(field["WARC-Record-ID"].removeprefix("<urn:page:").rstrip(">"))
    refers = field.get("WARC-Refers-To")
    return {
        "page_id": page,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": field["WARC-Type"],
        "refers_to": None if refers is None else number(refers.removeprefix("<urn:page:").rstrip(">")),
        "payload": payload,
    }


def _archive(folder: str):
    def run(batches):
        part = TaskContext.get().partitionId()
        system, path = fs.FileSystem.from_uri(folder)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        lines: list = []
        total = 0

        def write(out):
            nonlocal total
            for source in ([first], batches):
                for batch in source:
                    for page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                        stamp = capture_time(page)
                        member = record(page, url, stamp, (html or "").encode("utf-8", "surrogatepass"), digest, refers)
                        out.write(member)
                        line = f"{url_key(url)}\t{stamp:%Y%m%d%H%M%S}\t{-1 if page is None else page}\t{part}\t{total}\t{len(member)}"
                        lines.append((_order(line), line))
                        total += len(member)

        publish(system, f"{path}/pages-{part:06d}.warc.gz", write)
        lines.sort()
        got: list = []
        publish(system, f"{path}/run-0-{part:06d}.cdx", lambda out: got.extend(write_run(out, lines)))
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [got[0]], "samples": [json.dumps(got[1])]})

    return run


def write_archives(pages: DataFrame, folder: str) -> list[dict]:
    """Write all rows of (page_id, url, html) as archives with sorted runs; a manifest row for each. Pages
    cross no shuffle; only digests do, and those that repeat are few."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    again = keyed.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("times")).where("times > 1").drop("times")
    few = again.count() <= BROADCAST_DIGESTS
    if few:
        marked = keyed.join(F.broadcast(again), "digest", "left")
    else:  # small pages take no part, so their few digests are no hot keys; Spark splits those of popular pages
        large, small = keyed.where(F.col("size") >= LEAST_REVISIT), keyed.where(F.col("size") < LEAST_REVISIT)
        marked = large.join(again, "digest", "left").unionByName(small.withColumn("winner", F.lit(None).cast("bigint")))
    marked = marked.withColumn("refers_to", F.when((F.col("size") >= LEAST_REVISIT) & F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner")))
    chosen = marked.select("page_id", "url", "html", "digest", "refers_to")
    if not few:  # a shuffled partition's order must not differ between attempts
        chosen = chosen.sortWithinPartitions("page_id", "url", "digest")
    rows = chosen.mapInArrow(_archive(folder), "part bigint, n bigint, samples string").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["part"])


def merge_runs(spark, folder: str, manifest: list[dict], tasks: int) -> list[int]:
    """Merge all runs into a global index of parts in order; returns their numbers."""
    level, names = 0, [f"run-0-{m['part']:06d}.cdx" for m in manifest]
    while len(names) > FAN_IN:
        groups = [names[i : i + FAN_IN] for i in range(0, len(names), FAN_IN)]
        level += 1
        names = [f"run-{level}-{k:06d}.cdx" for k in range(len(groups))]
        _merge(spark, folder, [(g, None, None, n) for g, n in zip(groups, names, strict=True)])
    samples = sorted({tuple(s) for m in manifest for s in json.loads(m["samples"])})
    cuts = sorted({samples[len(samples) * k // tasks] for k in range(1, tasks)}) if samples else []
    edges = [None, *cuts, None]
    _merge(spark, folder, [(names, lo, hi, f"index-{k:06d}.cdx") for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
    return list(range(len(edges) - 1))


def _merge(spark, folder: str, jobs: list[tuple]) -> None:
    def run(batches):
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                names, low, high, target = jobs[k]
                tree = LoserTree([read_run(system, f"{path}/{n}", low, high) for n in names])
                publish(system, f"{path}/{target}", lambda out, tree=tree: write_run(out, tree))
                yield pa.RecordBatch.from_pydict({"done": [k]})

    done = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "done bigint").count()
    if done != len(jobs):
        raise RuntimeError("a merge left parts out")


_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string, captured string, index_part bigint, index_row bigint"


def read_archives(spark, folder: str, parts: list[int], at_once: int = 2000) -> DataFrame:
    """A row for each record, found through the merged index: what the archive says, its key and
    time, and its place in the global order (index_part, index_row)."""

    def run(batches):
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                held, row = [], 0
                for _, line in read_run(system, f"{path}/index-{parts[k]:06d}.cdx", None, None):
                    key, stamp, _, part, at, length = line.split("\t")
                    held.append((int(part), int(at), int(length), key, stamp, row))
                    row += 1
                    if len(held) >= at_once:
                        yield _fetch(system, path, held, k)
                        held = []
                if held:
                    yield _fetch(system, path, held, k)

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, _READ)


def _fetch(system, path: str, held: list[tuple], index_part: int) -> pa.RecordBatch:
    rows, source, opened = [], None, None
    for part, at, length, key, stamp, row in sorted(held):
        if part != opened:
            if source is not None:
                source.close()
            source, opened = system.open_input_file(f"{path}/pages-{part:06d}.warc.gz"), part
        source.seek(at)
        r = parse_record(source.read(length))
        rows.append((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], key, stamp, index_part, row))
    if source is not None:
        source.close()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split(" ")[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write archives and their global index to a new shared folder and read them back."""
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    manifest = write_archives(pages, folder)
    if not manifest:
        return spark.createDataFrame([], _READ)
    parts = merge_runs(spark, folder, manifest, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_archives(spark, folder, parts)


def warc_sql(table: str = "pages") -> str:
    return f"""
with p as (select page_id, encode(coalesce(html, '')) as body, sha1(coalesce(html, '')) as digest from {table}),
q as (select page_id, octet_length(body) as n, digest,
             case when octet_length(body) >= {LEAST_REVISIT} then max(page_id) over (partition by digest) end as winner from p)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when winner is not null and page_id is distinct from winner then 'revisit' else 'response' end as record_type,
       case when winner is not null and page_id is distinct from winner then winner end as refers_to
from q"""
