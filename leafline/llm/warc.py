"""WARC records in ZIP-packaged archives: written by scan tasks, read back by range, never extracted.

An archive is a ZIP file with three stored members: archive/data.warc.gz (a gzip member a record),
indexes/index.cdxj (a line a record, sorted by url, with offset and length) and datapackage.json.
write() makes one or more archives a task; read() parses the end record, the ZIP64 records and the central
directory, finds the stored members' places, reads the index and then record ranges, and
unpacks each record by itself. A record whose payload is equal to an earlier one's is a revisit without
payload; its HTTP header keeps the payload's length and its WARC header the digest.

Cases: null html counts as empty, a null url as an empty target. Payloads below `least` bytes are
always responses, as is one record of the smallest page_id of equal payloads: of rows that repeat that page_id, one with the
least url. Null page_ids come last and are never referred to: a payload
that only they have is a response each time. Very long payloads are held one at a time when written, and with the records of one
range (SPAN bytes, or one record) when read. An empty table gives an empty table. Other columns are ignored, whatever their names.

read() opens archives of other writers as well: any members under archive/ and indexes/ (CDXJ, or gzip of it), offsets as numbers or
text, records named by `filename`. Members that aren't needed may be compressed; of one that is needed that raises ValueError. Records
without `urn:page` have no page_id.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, new_path, store_of, written

#: Bytes after which a task begins a new archive, and records of one range read.
ROLL, CHUNK = 256 << 20, 400
#: Bytes of a range, unless one record has more.
SPAN = 8 << 20
DATE = "2024-01-01T00:00:00Z"
WARC, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Fixed values of the ZIP format: signatures and record layouts.
LOCAL = struct.Struct("<4s5H3I2H")
CENTRAL = struct.Struct("<4s6H3I5H2I")
END = struct.Struct("<4s4H2IH")
END64 = struct.Struct("<4sQ2H2I4Q")
LOCATOR = struct.Struct("<4sIQI")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class ZipWriter:
    """Streams stored members; sizes follow each member (data descriptor) and stand in the central directory.

    Sizes and places are always given in ZIP64 fields, so that an archive's layout doesn't change with its size.
    """

    def __init__(self, out) -> None:
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append([name.encode(), self.at, 0, 0])
        raw = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL.pack(b"PK\x03\x04", 45, 0x808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> None:
        m = self.members[-1]
        m[2], m[3] = zlib.crc32(data, m[2]), m[3] + len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, at, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._put(CENTRAL.pack(b"PK\x01\x02", 45, 45, 0x808, 0, 0, 0x21, crc, FULL32, FULL32, len(name), len(extra), 0, 0, 0, 0, FULL32) + name + extra)
        size, n = self.at - start, len(self.members)
        end64 = self.at
        self._put(END64.pack(b"PK\x06\x06", END64.size - 12, 45, 45, 0, 0, n, n, size, start))
        self._put(LOCATOR.pack(b"PK\x06\x07", 0, end64, 1))
        self._put(END.pack(b"PK\x05\x06", 0, 0, min(n, FULL16), min(n, FULL16), FULL32, FULL32, 0))


class Compressed(ValueError):
    """A member that is needed isn't stored."""


def members(f, size: int) -> dict[str, tuple[int, int] | None]:
    """name -> (place of its first byte, length) of the stored members of a ZIP file, by range reads, None for compressed ones; f has read_at(n, at)."""
    tail_at = max(0, size - (1 << 16) - END.size - LOCATOR.size)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, start, _ = END.unpack_from(tail, at)
    if FULL16 == n or FULL32 in (length, start):
        _, _, end64, _ = LOCATOR.unpack_from(tail, at - LOCATOR.size)
        signature, _, _, _, _, _, _, n, length, start = END64.unpack(f.read_at(END64.size, end64))
        if signature != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
    directory, at, found = f.read_at(length, start), 0, {}
    for _ in range(n):
        _, _, _, flags, method, _, _, _, packed, whole, n_name, n_extra, n_comment, _, _, _, place = CENTRAL.unpack_from(directory, at)
        at += CENTRAL.size
        name = directory[at : at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, at = directory[at + n_name : at + n_name + n_extra], at + n_name + n_extra + n_comment
        while len(extra) >= 4:
            tag, k = struct.unpack_from("<HH", extra)
            if tag == 1:  # the fields that are full, in this order
                wide = iter(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                whole = next(wide) if whole == FULL32 else whole
                packed = next(wide) if packed == FULL32 else packed
                place = next(wide) if place == FULL32 else place
            extra = extra[4 + k :]
        if method != 0:
            found[name] = None
            continue
        head = LOCAL.unpack(f.read_at(LOCAL.size, place))
        found[name] = (place + LOCAL.size + head[-2] + head[-1], packed)
    return found


def _record(page_id, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; refers_to makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (None for a revisit) of one WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    number = lambda name: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    out = {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri", "").strip("<>"), "record_type": fields.get("warc-type", ""), "refers_to": number("warc-refers-to")}
    payload, http = rest[: int(fields.get("content-length", len(rest)))], b""
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
    if out["record_type"] == "revisit":
        size = re.search(rb"(?i)^content-length: *(\d+)", http, re.M)
        return out | {"payload": None, "payload_bytes": int(size[1]) if size else None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:")}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


def index_lines(f, at: int, length: int, packed: bool) -> Iterator[dict]:
    """The entries of a CDXJ member, read in pieces."""
    unpack, rest = zlib.decompressobj(31) if packed else None, b""
    for start in range(at, at + length, 1 << 20):
        data = f.read_at(min(1 << 20, at + length - start), start)
        while data:
            rest += unpack.decompress(data) if packed else data
            data = b""
            if packed and unpack.eof:  # the next gzip member
                data, unpack = unpack.unused_data, zlib.decompressobj(31)
        *lines, rest = rest.split(b"\n")
        yield from (json.loads(x[x.index(b"{") :]) for x in lines if b"{" in x)
    if b"{" in rest:
        yield json.loads(rest[rest.index(b"{") :])


def ranges_of(f, size: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(place of the member, offsets, lengths) of the archive's ranges: at most CHUNK records that lie within SPAN bytes."""
    known = members(f, size)
    archives = [n for n in known if n.startswith("archive/") and not n.endswith("/")]
    found: dict[str, list[tuple[int, int]]] = {}
    for name in sorted(n for n in known if n.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", n)):
        if known[name] is None:
            raise Compressed(f"{name} is not stored")
        for e in index_lines(f, *known[name], name.endswith(".gz")):
            member = f"archive/{e['filename'].rsplit('/', 1)[-1]}" if e.get("filename") else archives[0]
            found.setdefault(member, []).append((int(e["offset"]), int(e["length"])))
    for member, entries in sorted(found.items()):
        if known.get(member) is None:
            raise Compressed(f"{member} is not stored") if member in known else ValueError(f"no member {member}")
        part: list[tuple[int, int]] = []
        for at, length in sorted(set(entries)):
            if part and (len(part) == CHUNK or at + length - part[0][0] > SPAN):
                yield known[member][0], [p[0] for p in part], [p[1] for p in part]
                part = []
            part.append((at, length))
        yield known[member][0], [p[0] for p in part], [p[1] for p in part]


class ArchiveWriter:
    """One archive file; index lines are held until it closes, so an archive is rolled by size."""

    def __init__(self, folder: str) -> None:
        task = TaskContext.get()
        self.path = f"{folder}/{task.partitionId() if task else 0}-{task.taskAttemptId() if task else 0}-{uuid.uuid4().hex[:8]}.wacz"
        store, name = store_of(self.path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(name)
        self.zip, self.at, self.lines = ZipWriter(self.out), 0, []
        self.zip.begin(WARC)

    def add(self, page_id, url: str, payload: bytes, digest: str, refers_to: int | None) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(_record(page_id, url, payload, digest, refers_to)) + packer.flush()
        self.zip.add(packed)
        self.lines.append(f"{json.dumps(url)[1:-1].replace(' ', '%20')} 20240101000000 {json.dumps({'offset': self.at, 'length': len(packed), 'digest': digest})}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.zip.end()
        self.zip.begin(INDEX)
        for line in sorted(self.lines):
            self.zip.add(line.encode())
        self.zip.end()
        self.zip.begin(PACKAGE)
        self.zip.add(json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": WARC}, {"path": INDEX}]}).encode())
        self.zip.end()
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


def write(pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """Writes pages(page_id, url, html) and returns the archives as a table (archive, records).

    Payloads that recur are found on digests alone and made a table first: Spark broadcasts it if its size is
    below spark.sql.autoBroadcastJoinThreshold, and else joins by digest, where AQE splits a hot digest's rows.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    same = keyed.where(F.octet_length("payload") >= least).groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    equal = same.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "n"))).alias("first"), F.sum("n").alias("n"))
    equal = equal.where("n > 1 and first is not null").select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), F.col("first.n").alias("repeats"))
    equal = written(spark, equal, "payloads")
    met = keyed.join(equal, "digest", "left")
    is_first = F.expr("page_id <=> first and url <=> first_url")
    columns = ["page_id", "url", "payload", "digest"]
    typed = met.where(~is_first | F.expr("repeats is null or repeats = 1")).select(*columns, F.when(~is_first, F.col("first")).alias("refers_to"))
    if not equal.where("repeats > 1").isEmpty():  # equal rows: summed to one, and dealt out again as one response and its revisits
        again = keyed.join(equal.where("repeats > 1"), "digest").where(is_first).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "payload", "repeats")])
        again = again.select("*", F.explode(F.expr("sequence(1L, repeats)")).alias("nth"))
        typed = typed.unionByName(again.select(*columns, F.when(F.col("nth") > 1, F.col("page_id")).alias("refers_to")))

    def make():
        state: dict = {"open": None, "done": []}

        def step(batch: pa.RecordBatch | None) -> dict | None:
            if batch is not None:
                for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")], strict=True):
                    state["open"] = state["open"] or ArchiveWriter(folder)
                    state["open"].add(*row)
                    if state["open"].at >= ROLL:
                        state["done"].append(state["open"].close())
                        state["open"] = None
                return None
            if state["open"]:
                state["done"].append(state["open"].close())
            return {"archive": [p for p, _ in state["done"]], "records": [n for _, n in state["done"]]}

        return step

    return written(spark, mapped(typed, make, "archive string, records long", last=True), "archives")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload) of every record of archives(archive)."""
    spark = archives.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ranges():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for archive in batch.column("archive").to_pylist():
                store, name = store_of(archive)
                with store.open_input_file(name) as f:
                    for base, offsets, lengths in ranges_of(f, f.size()):
                        yield {"archive": [archive], "base": [base], "offsets": [offsets], "lengths": [lengths]}

        return step

    def records():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for row in batch.to_pylist():  # a batch for each range
                store, name = store_of(row["archive"])
                with store.open_input_file(name) as f:
                    start, end = row["offsets"][0], row["offsets"][-1] + row["lengths"][-1]
                    block = f.read_at(end - start, row["base"] + start)
                out: dict = {}
                for at, length in zip(row["offsets"], row["lengths"], strict=True):
                    raw = block[at - start : at - start + length]
                    for c, v in parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw).items():
                        if payloads or c != "payload":
                            out.setdefault(c, []).append(v)
                yield out

        return step

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    chunks = mapped(archives.select("archive").repartition(parts, "archive"), ranges, "archive string, base long, offsets array<long>, lengths array<long>")
    return mapped(chunks.repartition(parts, "archive", F.col("offsets")[0]), records, schema)
