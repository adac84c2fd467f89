"""WARC archives with an external index merge.

Payloads are compared by digest; of equal ones the capture with the largest id
is the response, the others revisit it. Tasks write gzip records to archive
files in a shared folder and, per file, one run of index rows sorted by URL key
and time. Runs are dealt out by ranges of (URL key, time) and merged there with
a loser tree, so the index is in global order; archives are read back by it.

A file's name is new for every attempt of a task. Only files that a committed
index names are ever read, so a lost or repeated task leaves nothing behind but
an unnamed file.

Cases: null html is an empty payload; null urls have an empty key; repeated
ids and rows are captures of their own (the row key breaks ties); one URL or
payload may hold most rows: its captures are dealt out by time, its digest is
aggregated before the shuffle; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import row_keyed, shared_folder, written

#: An archive file is closed once it has so many bytes.
FILE_BYTES = 64 << 20
INDEX = "urlkey string, captured long, id {kind}, file long, pos long, record_type string, archive string, start long, length long, run string"


def surt(url: str) -> str:
    """URL key: host labels turned round, then path and query, in lower case."""
    try:
        u = urlsplit(url.strip().lower())
        host, port = u.hostname or "", f":{u.port}" if u.port else ""
    except ValueError:
        return url.strip().lower()
    key = ",".join(reversed(host.removeprefix("www.").split("."))) + port + ")" + (u.path or "/")
    return key + (f"?{u.query}" if u.query else "")


def record(kind: str, uri: str, when: int, payload: bytes, digest: str, n: int, own: str, page: str, refers: tuple[str, str] | None) -> bytes:
    """One record as its bytes; ``payload`` is left out of revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    date = datetime.datetime.fromtimestamp(when, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Capture-Id: {page}", f"X-Payload-Length: {n}",
    ]
    if refers:
        head += [f"WARC-Refers-To: <urn:uuid:{refers[0]}>", f"X-Refers-To-Capture: {refers[1]}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def zipped(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record_id(file: int, pos: int) -> str:
    return str(uuid.UUID(bytes=hashlib.md5(f"{file}:{pos}".encode()).digest()))


def decided(pages: DataFrame) -> DataFrame:
    """``pages`` (file, pos, id, url, payload, captured) with the digest and the capture that holds its payload (null: itself)."""
    d = pages.withColumn("sha", F.unhex(F.sha1("payload")))
    one = F.struct(F.col("id").isNotNull().alias("known"), "id", "file", "pos")
    shared = written(d.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max(one).alias("holder")).where("n > 1").drop("n"), "payloads")
    own = (F.col("holder.file") == F.col("file")) & (F.col("holder.pos") == F.col("pos"))
    return d.join(shared, "sha", "left").withColumn("holder", F.when(~own, F.col("holder")))


def archived(captures: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives under ``folder``; their index, one sorted run per file."""
    kind = captures.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sink = None
        where, at, rows = "", 0, []
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    where, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{where}", compression=None)  # records are members already
                    sink = out.write
                payload = r["payload"] or b""
                digest = base64.b32encode(r["sha"]).decode()
                holder = r["holder"]
                uri = quote(r["url"] or "urn:none", safe="%/:=&?~#+!$,;'@()*[]")
                refers = (record_id(holder["file"], holder["pos"]), "" if holder["id"] is None else str(holder["id"])) if holder else None
                what = "revisit" if holder else "response"
                raw = zipped(record(what, uri, r["captured"], payload, digest, len(payload), record_id(r["file"], r["pos"]), "" if r["id"] is None else str(r["id"]), refers))
                sink(raw)
                rows.append((surt(r["url"] or ""), r["captured"], r["id"], r["file"], r["pos"], what, where, at, len(raw), where))
                at += len(raw)
                if at >= file_bytes:
                    out.close()
                    yield index(rows)
                    out, rows = None, []
        if out is not None:
            out.close()
            yield index(rows)

    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    kinds = [pa.string(), pa.int64(), id_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["urlkey", "captured", "id", "file", "pos", "record_type", "archive", "start", "length", "run"]

    def index(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda x: (x[0], x[1], x[3], x[4]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return captures.select("file", "pos", "id", "url", "payload", "captured", "sha", "holder").mapInArrow(run, INDEX.format(kind=kind))


class LoserTree:
    """Merges sorted runs: inner nodes hold the loser of their match, one replay per row."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self.replay(i)

    def less(self, a: int, b: int) -> bool:
        """Does run a's head come before run b's? An empty slot (-1) beats all while the tree is filled."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.runs[a], self.runs[b]
        if self.at[a] >= len(x) or self.at[b] >= len(y):
            return self.at[a] < len(x)
        p, q = x[self.at[a]], y[self.at[b]]
        return p < q or (p == q and a < b)

    def replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            w = self.losers[0]
            if self.at[w] >= len(self.runs[w]):
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.replay(w)


def merged(runs: DataFrame) -> DataFrame:
    """The index in global order of (urlkey, captured), ties by row key: ranges of it, each a merge of the runs' parts."""
    names = runs.columns
    keys = ["urlkey", "captured", "file", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[list[tuple]]] = {}
        rows: list[tuple] = []
        schema = None
        for b in batches:
            schema = b.schema
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = (r[0], r[1], r[3], r[4], len(rows))
                rows.append(r)
                own = parts.setdefault(r[9], [[]])
                if own[-1] and own[-1][-1] > key:  # the run's other half came first
                    own.append([])
                own[-1].append(key)
        out = []
        for key in LoserTree([p for own in parts.values() for p in own if p]):
            out.append(rows[key[4]])
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return runs.select(*names).repartitionByRange(*keys).mapInArrow(run, runs.schema)


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """One row per record of the index, from the archives: id, payload_bytes, payload_digest, record_type, refers_to, urlkey, captured."""
    kind = index.schema["id"].dataType.simpleString()
    number = kind in ("bigint", "int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, store, root = None, None, None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if store is None:
                    store, root = fs.FileSystem.from_uri(folder)
                if r["archive"] != name:
                    name, f = r["archive"], store.open_input_file(f"{root}/{r['archive']}")
                f.seek(r["start"])
                head, payload = parse(zlib.decompress(f.read(r["length"]), 31))
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(head["x-payload-length"])):
                    raise ValueError(f"{name} at {r['start']}: the payload differs from its digest")
                ids = [int(x) if x and number else x or None for x in (head["x-capture-id"], head.get("x-refers-to-capture"))]
                out.append((ids[0], int(head["x-payload-length"]), digest, head["warc-type"], ids[1], r["urlkey"], r["captured"]))
            kinds = [pa.int64() if kind == "bigint" else pa.int32() if number else pa.string()]
            kinds = [kinds[0], pa.int64(), pa.string(), pa.string(), kinds[0], pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured"])

    by_file = index.repartition("archive").sortWithinPartitions("archive", "start")
    return by_file.mapInArrow(run, f"id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, urlkey string, captured long")


def archive(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Writes the archives of ``pages``; their merged index and folder. ``captured``: seconds since 1970; by default a second per id from 2024 on."""
    when = captured if captured is not None else F.lit(1704067200) + F.pmod(F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(0)), F.lit(100_000_000))
    rows = row_keyed(pages.withColumn("__when", when.cast("long")))
    rows = rows.select(F.col("__file").alias("file"), F.col("__pos").alias("pos"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("payload"), F.col("__when").alias("captured"))
    folder = shared_folder(pages.sparkSession, "archives")
    runs = written(archived(decided(rows), folder, file_bytes), "runs")
    return written(merged(runs), "histories"), folder
