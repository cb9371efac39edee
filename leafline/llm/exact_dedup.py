"""Exact deduplication through an extendible-hash index on shared files.

1. Scan tasks normalise each text, collapse rows whose bytes equal a text that the task saw of late (the
   pre-aggregation: a hot text is about one entry a task, not one a row; RECENT bytes of texts are held) and append the entry's bytes
   to a heap file in the shared folder. Rows and entries are written as one table.
2. Owner tasks each take a range of 64-bit keys. An owner inserts its entries into an
   extendible-hash index: an overfull bucket splits, and the directory doubles where the
   bucket's depth is that of the directory. Entries with equal keys meet in one chain and are
   compared byte by byte with the chain's texts, read by range from the heap files. First each
   range is dealt over SALTS tasks by the entry's scan task, then the survivors meet in the
   range's one owner: no owner reads a hot text more often than scan tasks / SALTS times.
   That owner writes its buckets and directory as a file in the shared folder.
3. Survivors probe the file of their range by range reads: directory slot, bucket page, chain. A chain of one
   text is their class, in longer chains bytes decide. find() is the same probe for a single key.
4. Sizes and smallest doc_ids are aggregated by entry, then by class, and joined to the rows.

Files carry the attempt that wrote them, and only rows of committed tasks name a file, so a
task that runs twice leaves at most an unread file.

Cases: null text counts as empty; empty texts are equal to each other, as are texts of white
space only (one space). Of equal texts the row with the smallest doc_id stays (null last); of
rows that repeat a doc_id as well, exactly one stays. Very long texts are held one at a time beside RECENT bytes, and read whole to be
compared. An empty table gives an empty table. Other columns of the input are ignored by dedup() and kept by kept(), whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, mapped, new_path, staying, store_of, written
from .heap import Heap, HeapWriter

SALTS = 8
#: Entries of an owner, at most on average; an owner's memory is some 200 bytes an entry.
OWNED = 400_000
BUCKET = 64
#: Bytes of texts that a scan task holds to compare with, the last seen; of pages that a probing task holds.
RECENT = 24 << 20
KEY = 2**64 - 1
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
PAGE_ROW = struct.Struct("<QIQIq")
FOOTER = struct.Struct("<QQIIQ")


def normalise(text: bytes) -> bytes:
    """Each run of white space as one space."""
    if not text:
        return b""
    body = b" ".join(text.split())  # bytes.split() splits at just the contract's white space
    if not body:
        return b" "
    return b" " * (text[0] in WHITE) + body + b" " * (text[-1] in WHITE)


class ExtendibleIndex:
    """Key -> chain of values; buckets of at most `capacity` keys under a directory that doubles."""

    def __init__(self, capacity: int = BUCKET) -> None:
        self.capacity, self.depth = capacity, 0
        self.directory: list[list] = [[0, {}]]  # buckets: local depth, chains by key

    def chain(self, key: int) -> list:
        """The key's chain, made if need be."""
        while True:
            bucket = self.directory[key & ((1 << self.depth) - 1)]
            if (found := bucket[1].get(key)) is not None:
                return found
            if len(bucket[1]) < self.capacity:
                return bucket[1].setdefault(key, [])
            self._split(bucket, key)

    def _split(self, bucket: list, key: int) -> None:
        if bucket[0] == self.depth:
            self.directory += self.directory
            self.depth += 1
        bit, old = 1 << bucket[0], bucket[1]
        zero, one = [bucket[0] + 1, {}], [bucket[0] + 1, {}]
        for k, c in old.items():
            (one if k & bit else zero)[1][k] = c
        low = key & (bit - 1)
        for slot in range(low, len(self.directory), bit):
            self.directory[slot] = one if slot & bit else zero

    def dump(self, out) -> None:
        """Pages, the pages' places by directory slot, file names, footer. Chains hold (file, offset, length, entry)."""
        at, places, files = 0, {}, {}
        for bucket in self.directory:
            if id(bucket) not in places:
                rows = [PAGE_ROW.pack(k, files.setdefault(v[0], len(files)), *v[1:]) for k, c in bucket[1].items() for v in c]
                out.write(page := b"".join(rows))
                places[id(bucket)] = (at, len(page))
                at += len(page)
        out.write(table := b"".join(struct.pack("<QI", *places[id(b)]) for b in self.directory))
        out.write(names := "\n".join(files).encode())
        out.write(FOOTER.pack(at, at + len(table), self.depth, len(names), len(self.directory)))


class IndexFile:
    """An index file, read by range: the directory whole, pages as they are asked for and while they fit."""

    def __init__(self, path: str) -> None:
        store, name = store_of(path)
        self.file, self.pages, self.held = store.open_input_file(name), {}, 0
        table, names, self.depth, n_names, slots = FOOTER.unpack(self.file.read_at(FOOTER.size, self.file.size() - FOOTER.size))
        self.names = self.file.read_at(n_names, names).decode().split("\n")
        self.directory = np.frombuffer(self.file.read_at(12 * slots, table), np.dtype([("at", "<u8"), ("size", "<u4")]))

    def chain(self, key: int) -> list[tuple[str, int, int, int]]:
        """(heap file, offset, length, entry) of the key's texts."""
        at, size = self.directory[key & ((1 << self.depth) - 1)].tolist()
        if at not in self.pages:
            if self.held + size > RECENT:
                self.pages, self.held = {}, 0
            page: dict[int, list] = {}
            for k, file, *place in PAGE_ROW.iter_unpack(self.file.read_at(size, at)):
                page.setdefault(k, []).append((self.names[file], *place))
            self.pages[at], self.held = page, self.held + size
        return self.pages[at].get(key, [])

    def close(self) -> None:
        self.file.close()


def find(path: str, key: int) -> list[tuple[str, int, int, int]]:
    """(heap file, offset, length, entry) of the key's texts in an index file, by range reads."""
    index = IndexFile(path)
    found = index.chain(key)
    index.close()
    return found


class Recent:
    """The entries of the texts that a task saw of late, by digest; equal bytes only count as seen."""

    def __init__(self) -> None:
        self.entries, self.held = OrderedDict(), 0

    def entry(self, digest: bytes, text: bytes, row: int) -> int:
        known = self.entries.get(digest)
        if known is not None and known[1] == text:
            self.entries.move_to_end(digest)
            return known[0]
        if known is None and len(text) <= RECENT:
            self.entries[digest] = row, text
            self.held += len(text) + 100
            while self.held > RECENT:
                self.held -= len(self.entries.popitem(last=False)[1][1]) + 100
        return row


def _scan(docs: DataFrame, folder: str, raw: bool) -> DataFrame:
    """A row for each row of docs; those whose text the task hasn't seen of late carry its place. raw: with the hash of the text as it stands."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    binary = F.col("text").cast("string").cast("binary")
    also = [F.sha2(F.coalesce(binary, F.lit(b"")), 256).alias("raw")] if raw else []

    def make():
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 36
        heap, seen, state = HeapWriter(folder), Recent(), {"row": 0}

        def step(batch: pa.RecordBatch | None) -> dict | None:
            if batch is None:
                heap.close()
                return None
            out = {k: [] for k in ("row", "entry", "key", "sha", "file", "at", "length")}
            for text in batch.column("text").to_pylist():
                text = normalise(text or b"")
                digest = hashlib.sha256(text).digest()
                row = base + state["row"]
                state["row"] += 1
                entry = seen.entry(digest, text, row)
                out["row"].append(row)
                out["entry"].append(entry)
                out["key"].append(int.from_bytes(digest[:8], "little", signed=True))
                out["sha"].append(digest.hex())
                for k, v in zip(("file", "at", "length"), heap.put(text) if entry == row else (None,) * 3, strict=True):
                    out[k].append(v)
            return out | {c: batch.column(c) for c in ("doc_id", "raw")[: 1 + raw]}

        return step

    schema = f"doc_id {kind}, row long, entry long, key long, sha string, file string, at long, length int" + ", raw string" * raw
    return mapped(docs.select("doc_id", binary.alias("text"), *also), make, schema, last=True)


def _owner(owners: int) -> Column:
    """Key ranges: the high bits of the key; low bits serve the directory."""
    return F.floor(F.shiftrightunsigned("key", 40) * F.lit(owners) / F.lit(1 << 24)).cast("int")


def _leaders(chain: list, heap: Heap, place: tuple[str, int, int], entry: int) -> int:
    """The entry of the chain's text of equal bytes, else the entry itself, then part of the chain."""
    if chain:
        text = heap.read(*place)
        for v in chain:
            if heap.read(*v[:3]) == text:
                return v[3]
    chain.append((*place, entry))
    return entry


def _salted(entries: DataFrame, owners: int) -> DataFrame:
    """(entry, leader): the first entry of equal bytes within the owner's range and salt."""

    def make():
        tree, heap = ExtendibleIndex(), Heap()

        def step(batch: pa.RecordBatch) -> dict:
            columns = [batch.column(c).to_pylist() for c in ("key", "entry", "file", "at", "length")]
            return {"entry": batch.column("entry"), "leader": [_leaders(tree.chain(key & KEY), heap, place, entry) for key, entry, *place in zip(*columns, strict=True)]}

        return step

    dealt = entries.select("entry", "key", "file", "at", "length").repartitionById(owners * SALTS, _owner(owners) * SALTS + F.pmod(F.shiftright("entry", 36), F.lit(SALTS)).cast("int"))
    return mapped(dealt.sortWithinPartitions("key", "entry"), make, "entry long, leader long")


def _indexed(entries: DataFrame, owners: int, folder: str) -> DataFrame:
    """(owner, path): the index file of each key range that has entries, written by the range's one owner."""

    def make():
        tree, heap, task, owner = ExtendibleIndex(), Heap(), TaskContext.get(), []

        def step(batch: pa.RecordBatch | None) -> dict | None:
            if batch is not None:
                owner[:] = batch.column("owner")[:1].to_pylist()
                for key, entry, *place in zip(*[batch.column(c).to_pylist() for c in ("key", "entry", "file", "at", "length")], strict=True):
                    _leaders(tree.chain(key & KEY), heap, place, entry)
                return None
            path = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.index"
            if owner:
                store, name = store_of(path)
                store.create_dir(name.rpartition("/")[0], recursive=True)
                with store.open_output_stream(name) as out:
                    tree.dump(out)
            return {"owner": owner, "path": [path] * len(owner)}

        return step

    dealt = entries.select("entry", "key", "file", "at", "length", _owner(owners).alias("owner")).repartitionById(owners, F.col("owner"))
    return mapped(dealt.sortWithinPartitions("key", "entry"), make, "owner int, path string", last=True)


def _probed(entries: DataFrame, owners: int, paths: dict[int, str]) -> DataFrame:
    """(leader, class): what the index file of its range says of each of the indexed entries."""

    def make():
        heap, index, at = Heap(), None, None

        def step(batch: pa.RecordBatch) -> dict:
            nonlocal index, at
            out = []
            for owner, key, entry, *place in zip(*[batch.column(c).to_pylist() for c in ("owner", "key", "entry", "file", "at", "length")], strict=True):
                if owner != at:
                    index, at = IndexFile(paths[owner]), owner
                chain = index.chain(key & KEY)
                out.append(chain[0][3] if len(chain) == 1 else _leaders(chain, heap, place, entry))
            return {"leader": batch.column("entry"), "class": out}

        return step

    dealt = entries.select("entry", "key", "file", "at", "length", _owner(owners).alias("owner")).repartitionById(owners, F.col("owner"))
    return mapped(dealt.sortWithinPartitions("key", "entry"), make, "leader long, class long")


def dedup(docs: DataFrame, index: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of docs(doc_id, text).

    index: folder in the shared folder for the owners' index files, kept for find().
    """
    return _classes(docs, index)


def _classes(docs: DataFrame, index: str | None = None, raw: bool = False) -> DataFrame:
    """dedup(), with raw: the hash of the text as it stands too."""
    spark = docs.sparkSession
    heap = new_path(spark, "heap")
    rows = written(spark, _scan(docs, heap, raw), "dedup-rows")
    entries = rows.where("file is not null")
    owners = max(1, -(-entries.count() // OWNED), int(spark.conf.get("spark.sql.shuffle.partitions")) // SALTS)
    first = written(spark, _salted(entries, owners), "dedup-salted")
    left = entries.join(first.where("entry = leader").select("entry"), "entry", "left_semi")
    own = index or new_path(spark, "index")
    files = written(spark, _indexed(left, owners, own), "dedup-indexes")
    paths = {r.owner: r.path for r in files.collect()}  # one for OWNED entries
    second = _probed(left, owners, paths)
    classes = written(spark, first.join(second, "leader").select("entry", "class"), "dedup-classes")
    drop(spark, first, files, *([] if index else [heap, own]))  # an index that is kept needs its texts
    of_entry = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    of_class = of_entry.join(classes, "entry").groupBy("class").agg(F.sum("n").alias("group_size"), F.min("first").alias("first"))
    known = classes.join(of_class, "class").select("entry", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    return rows.join(known, "entry").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), *["raw"] * raw)


def kept(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of docs that stay, with these columns: of equal texts the one with the smallest doc_id."""
    marked = _classes(docs, raw=True).select("doc_id", F.col("raw").alias("text_sha256"), F.lit(False).alias("all"), F.col("kept").alias("one"), F.lit(1).alias("rows"))
    return staying(docs, columns, marked)
