"""Similarity join of documents on word n-grams by Jaccard, through parity sketches.

A document's set of shingles is XOR-hashed into a parity sketch: every shingle flips one bit of
a (virtual, 2**64 bits wide) sketch, so the Hamming distance of two sketches is at most the
symmetric difference of the sets. Sets with 100 * I >= T * U differ in at most
D(a) = floor((100 - T) * a / T) shingles, a being the smaller size. Sizes fall into bands, made on demand; each band
cuts the sketch into P > D + 1 parts. Of two linked sets, at least P - D parts
are equal (pigeonhole), and parts of equal sketch meet in a join on (band, part, part's bits).

Only rich parts, of two shingles or more, make keys: an empty part is equal in sets that share nothing, a part of one
shingle in all that share that one. A set is settled by a cut if its poor parts are fewer than the equal parts that a
linked set must have; then one of the equal parts is rich. A set that isn't settled makes the keys of its rich parts and goes
on to another cut of the sketch (LEVELS cuts, each with a seed of its own). Of a linked pair, both sets take part in each cut up
to the first that settles either, and meet there. What no cut settles, and bands too narrow for any, is filed by its
size - ceil(T * size / 100) + 1 least hashes, of which two linked sets share one. So no link is lost, and sets that
share nothing never meet.

Links are sought between distinct sets only (copies are collapsed per scan task, then by class)
and not as all pairs of a group: each bucket links its members with its smallest member; pairs
are made distinct, sieved by explicit sketches of 64 * LONGS bits and then of four bits a shingle (the
Hamming distance is at most the symmetric difference) and verified on the whole sets of 64-bit hashes of
shingles, made from texts that are read from heap files. Where a bucket's members are
still in several components, another member meets the rest, TURNS times; at last all members of
different components meet, sieved inside that join. That leaves every two linked
documents in one component. Components come from contracting each node into its least neighbour.

Cases: null text counts as empty. Fewer words than n: the whole sequence is one shingle; no
words: an empty set, linked with nothing. Very long texts make keys in proportion to their length and are read whole. Repeated rows have
equal sets and are linked. Ties of doc_id within a component: one row stays in kept(), that of the least hash of its text. A null
doc_id is never the smallest unless all are null. An empty table gives an empty table. Other columns of
the input are ignored by join() and kept by kept(), whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, mapped, new_path, staying, written
from .heap import Heap, HeapWriter

#: Longs of the explicit parity sketch that pairs are sieved by: 64 bits each.
LONGS = 16
#: Rounds in which a bucket's members meet another one of them, before the last, in which all of different components meet.
TURNS = 2
#: Cuts of the sketch that a set takes part in until one settles it.
LEVELS = 3
WORDS_KEPT = 150_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


#: Seeds of the cuts after the first.
_LEVEL = [np.uint64(x) for x in (0, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Hash sets of word n-grams."""

    def __init__(self, n: int) -> None:
        self.n, self.words = n, Words()
        self.odd = [np.uint64(int(_ODD[i % 4]) * (2 * i + 1) % 2**64) for i in range(n)]

    def __call__(self, text: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles of a lower-cased text."""
        words = text.split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if len(words) < self.n:
            return _mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64))
        m = len(words) - self.n + 1
        out = h[:m] * self.odd[0]
        for i in range(1, self.n):
            out += h[i : m + i] * self.odd[i]
        return np.unique(_mix(out))


class Bands:
    """Size bands, and the parts that each cuts the sketch into; 0 where no cut would settle most sets."""

    def __init__(self, percent: int) -> None:
        if not 0 < percent <= 100:
            raise ValueError("percent must be above 0 and at most 100")
        self.percent, self.low, self.high, self.parts = percent, [], [], []
        # the smallest size that allows a difference; at 100 percent only equal sets are linked
        self.least = -(-percent // (100 - percent)) if percent < 100 else None

    def differ(self, size: int) -> int:
        """The largest symmetric difference of a set of this size from a linked set that isn't smaller."""
        return (100 - self.percent) * size // self.percent

    def _extend(self, size: int) -> None:
        while not self.high or self.high[-1] < size:
            low = self.high[-1] + 1 if self.high else self.least
            high = max(low, low * 10000 // self.percent**2)
            self.low.append(low)
            self.high.append(high)
            self.parts.append(self._cut(low, high))

    def _cut(self, low: int, high: int) -> int:
        """The least number of parts of which sets of the band leave poor, by expectation and half a deviation, fewer than must be equal; 0 if none does."""
        apart = self.differ(high)
        for p in range(apart + 2, 2 * apart + 5) if apart < 64 else np.linspace(apart + 2, 2 * apart + 4, 256).astype(int).tolist():
            poor = ((p * np.exp(-a / p) * (1 + a / p), p - self.differ(a) - 1) for a in (low, (low + high) // 2, high))
            if all(n + 0.5 * np.sqrt(n) <= spare for n, spare in poor):
                return int(p)
        return 0

    def roles(self, size: int) -> list[int]:
        """The bands in which a set of this size takes part: its own, and the next below if a smaller partner may be there."""
        if self.least is None or size < self.least:
            return []
        self._extend(size)
        k = int(np.searchsorted(self.low, size, "right")) - 1
        below = k > 0 and 100 * self.high[k - 1] >= self.percent * size
        return [k, k - 1] if below else [k]

    @lru_cache(maxsize=64)
    def salt(self, k: int, level: int) -> np.ndarray:
        return _mix((np.uint64(k + 1) << np.uint64(40)) + (np.uint64(level) << np.uint64(60)) + np.arange(self.parts[k], dtype=np.uint64))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Join keys of a sorted set of hashes: rich parts of its parity sketch, by band, cut and part, or its least hashes."""
        size, out, cuts = len(shingles), [], {}
        for k in self.roles(size):
            p, allowed = self.parts[k], self.parts[k] - self.differ(min(size, self.high[k])) - 1
            for level in range(LEVELS if p else 0):
                if level not in cuts:
                    dealt = np.sort(_mix(shingles ^ _LEVEL[level])) if level else shingles
                    cuts[level] = dealt >> np.uint64(32), np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_mix(dealt + _ODD[1]))])
                high, bits = cuts[level]
                # the hash's high half deals shingles to parts in sorted order; a part's bits, as a Zobrist hash, are the XOR of its run
                edges = np.searchsorted((high * np.uint64(p)) >> np.uint64(32), np.arange(p + 1, dtype=np.uint64))
                rich = np.flatnonzero(np.diff(edges) > 1)
                out.append(_mix(bits[edges[rich + 1]] ^ bits[edges[rich]] ^ self.salt(k, level)[rich]))
                if p - len(rich) <= allowed:
                    break
            else:
                out.append(_mix(shingles[: size + (-self.percent * size) // 100 + 1] ^ _mix(_ODD[0] + np.uint64([k + 1]))))
        return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the numbers of shingles at each of 64 * LONGS bits, as longs."""
    at = _mix(shingles ^ _ODD[2]) % np.uint64(64 * LONGS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=64 * LONGS) & 1).astype(np.uint8)).view(np.int64)


def wide_bits(size: int) -> int:
    """Bits of a set's wide sketch: four a shingle or more, so that it doesn't fill up."""
    return 64 << max(0, (size - 1) // 16).bit_length()


def wide_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch of wide_bits() bits, as bytes; one of half the bits is the XOR of its halves."""
    bits = wide_bits(len(shingles))
    at = _mix(shingles ^ _ODD[3]) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def wide_near(a: np.ndarray, b: np.ndarray, sizes: int, percent: int) -> bool:
    """Whether two wide sketches leave a link possible; sizes: the sum of both sets' sizes."""
    if len(a) != len(b):
        a, b = (a, b) if len(a) < len(b) else (b, a)
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) * (100 + percent) <= (100 - percent) * sizes


def near(percent: int) -> Column:
    """Whether nodes a and b can be linked by their sizes and sketches: each bit that differs is a shingle that differs."""
    apart = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(1, LONGS)), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
    sizes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    return sizes & (apart * (100 + percent) <= (100 - percent) * (F.col("a_n") + F.col("b_n")))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes are linked."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _scan(docs: DataFrame, n: int, percent: int, folder: str) -> DataFrame:
    """A row for each row of docs; the first of each set in a task has the keys and the text's place."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 36
        shingles, bands, heap, seen, state = Shingler(n), Bands(percent), HeapWriter(folder), {}, {"row": 0}

        def step(batch: pa.RecordBatch | None) -> dict | None:
            if batch is None:
                heap.close()
                return None
            out = {k: [] for k in ("row", "entry", "n_shingles", "node", "check", "text_sha256", "keys", "sketch", "file", "at", "length")}
            for text in batch.column("text").to_pylist():
                text = text or b""
                lower = text.lower()  # of bytes: A-Z only
                s = shingles(lower)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                row = base + state["row"]
                state["row"] += 1
                entry = seen.setdefault(digest, row) if len(s) else row
                first = entry == row and len(s) > 0
                out["row"].append(row)
                out["entry"].append(entry)
                out["n_shingles"].append(len(s))
                out["node"].append(int.from_bytes(digest[:8], "little", signed=True) if len(s) else None)
                out["check"].append(int.from_bytes(digest[8:], "little", signed=True))
                out["text_sha256"].append(hashlib.sha256(text).hexdigest())
                out["keys"].append(bands.keys(s) if first else None)
                out["sketch"].append(sketch(s) if first else None)
                for k, v in zip(("file", "at", "length"), heap.put(lower, wide_sketch(s).tobytes()) if first else (None,) * 3, strict=True):
                    out[k].append(v)
            return out | {"doc_id": batch.column("doc_id")}

        return step

    schema = f"doc_id {kind}, row long, entry long, n_shingles long, node long, check long, text_sha256 string, keys array<long>, sketch array<long>, file string, at long, length int"
    return mapped(docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")), make, schema, last=True)


def _verified(pairs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact shingle sets are linked. Sizes and sketches sieve, then the words from the heap files decide."""
    end = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in nodes.columns if c not in ("node", "check")])
    full = pairs.join(end("a"), "a").join(end("b"), "b").where(near(percent)).select("a", "b", *[f"{x}_{c}" for x in "ab" for c in ("n", "file", "at", "length")])
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def make():
        heap, hashed, wide, sets = Heap(), Shingler(n), {}, {}

        def kept(known: dict, key: tuple, make_it):
            if (found := known.get(key)) is None:
                if len(known) >= 8:
                    known.pop(next(iter(known)))
                found = known[key] = make_it()
            return found

        def bits(r: dict, x: str) -> np.ndarray:
            place = r[f"{x}_file"], r[f"{x}_at"]
            return kept(wide, place, lambda: np.frombuffer(heap.raw(*place, wide_bits(r[f"{x}_n"]) // 8), np.uint8))

        def shingles(r: dict, x: str) -> np.ndarray:
            file, at = r[f"{x}_file"], r[f"{x}_at"]
            return kept(sets, (file, at), lambda: hashed(heap.read(file, at + wide_bits(r[f"{x}_n"]) // 8, r[f"{x}_length"])))

        def step(batch: pa.RecordBatch) -> dict:
            rows = [r for r in batch.to_pylist() if wide_near(bits(r, "a"), bits(r, "b"), r["a_n"] + r["b_n"], percent) and linked(shingles(r, "a"), shingles(r, "b"), percent)]
            return {"a": [r["a"] for r in rows], "b": [r["b"] for r in rows]}

        return step

    # a hot node's pairs go to several tasks, and within a task stand together
    dealt = full.repartition(parts, "a", F.pmod("b", F.lit(16))).sortWithinPartitions("a")
    return mapped(dealt, make, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges(a, b): the smallest node that each can reach.

    Every node hooks onto its least neighbour if that is smaller, the trees are flattened by
    doubling, and edges between trees make the next, smaller graph. Each step is a table in the
    shared folder; the numbers of steps grow with the logarithm of the graph.
    """
    spark = edges.sparkSession
    order = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(spark, order(edges), "edges")
    labels = written(spark, edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    while not edges.isEmpty():
        up = written(spark, edges.groupBy("a").agg(F.min("b").alias("p")), "parents")
        while True:
            above = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = written(spark, up.join(above, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
            drop(spark, up)
            up = jumped
            if jumped.where("moved").isEmpty():
                break
        root = lambda df, c: df.join(up.select(F.col("a").alias(c), F.col("p").alias("_p")), c, "left").withColumn(c, F.coalesce("_p", c)).drop("_p")  # noqa: B023, E731
        old = edges, labels, up
        labels = written(spark, root(labels, "root").select("node", "root"), "labels")
        edges = written(spark, order(root(root(edges, "a"), "b")), "edges")
        drop(spark, *old)
    drop(spark, edges)
    return labels


def _named(spark: SparkSession, rows: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows, entries and the table of nodes, a node for each set, named by 64 bits of its hash.

    Sets that share those bits are named anew from both halves of the hash, until all names differ.
    """
    first = entries.groupBy("node", "check").agg(F.min(F.struct("row", "n_shingles", "file", "at", "length", "sketch")).alias("x"))
    nodes = written(spark, first.select("node", "check", F.col("x.n_shingles").alias("n"), "x.file", "x.at", "x.length", *[F.col("x.sketch")[i].alias(f"s{i}") for i in range(LONGS)]), "nodes")
    salt = 0
    while True:
        shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("_sets")).where("_sets > 1").select("node", F.lit(True).alias("_shared"))
        if shared.isEmpty():
            return rows, entries, nodes
        shared, salt = written(spark, shared, "shared"), salt + 1
        anew = lambda df: df.join(shared, "node", "left").withColumn("node", F.when(F.col("_shared"), F.xxhash64("node", "check", F.lit(salt))).otherwise(F.col("node"))).select(*df.columns)  # noqa: B023, E731
        rows, entries, nodes = anew(rows), anew(entries), written(spark, anew(nodes), "nodes")


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, text_sha256 of each row of docs(doc_id, text).

    component_id is the smallest doc_id that the row's document reaches by links of
    100 * intersection >= percent * union, itself included.
    """
    return _joined(docs, n, percent).drop("root")


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """join() with root, which names the component also where doc_ids are null or repeated."""
    spark = docs.sparkSession
    heap = new_path(spark, "ngram-heap")
    rows = written(spark, _scan(docs, n, percent, heap), "ngram-rows")
    entries = rows.where("file is not null")
    rows, entries, nodes = _named(spark, rows, entries)
    least = F.min("node").over(Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    keyed = entries.where("size(keys) > 0").select("node", F.explode("keys").alias("key"))
    star = written(spark, keyed.withColumn("rep", least).where("node <> rep").distinct(), "star")
    links = [written(spark, _verified(star.select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct(), nodes, n, percent), "links")]
    roots = components(links[0])
    of = lambda df, c, to: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
    members = written(spark, star.select("key", "node").union(star.select("key", F.col("rep").alias("node"))).distinct(), "members")
    drop(spark, star)
    for turn in range(TURNS + 1):
        # only buckets whose members are in several components can still hold a link that matters
        inside = written(spark, of(members, "node", "root"), "inside")
        split = inside.groupBy("key").agg((F.min("root") != F.max("root")).alias("split")).where("split").select("key")
        open_ = inside.join(split, "key", "left_semi")
        if turn < TURNS:  # another member of each bucket, chosen by hash, meets the rest
            by = Window.partitionBy("key").orderBy(F.xxhash64("key", "node", F.lit(turn)), "node").rowsBetween(Window.unboundedPreceding, 0)
            met = open_.withColumn("first", F.first(F.struct("node", "root")).over(by)).where("root <> first.root")
            more = met.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")).distinct()
        else:  # all members of different components meet, sieved inside the join
            full = open_.join(nodes.select("node", "n", *[f"s{i}" for i in range(LONGS)]), "node")
            end = lambda x: full.select(F.col("key").alias(f"{x}_key"), F.col("node").alias(x), F.col("root").alias(f"{x}_root"), *[F.col(c).alias(f"{x}_{c}") for c in ("n", *[f"s{i}" for i in range(LONGS)])])  # noqa: B023, E731
            more = end("a").join(end("b"), F.expr("a_key = b_key and a < b and a_root <> b_root") & near(percent)).select("a", "b").distinct()
        late = written(spark, _verified(more, nodes, n, percent), "links")
        links.append(late)
        if not late.isEmpty():
            drop(spark, roots)
            roots = components(reduce(DataFrame.union, links))
        drop(spark, inside)
    # smallest doc_id by entry, by class, by component; entries are at most as hot as a scan task
    of_entry = rows.where("node is not null").groupBy("entry", "node").agg(F.min("doc_id").alias("least"))
    placed = written(spark, of(of_entry, "node", "root").select("entry", "least", "root"), "placed")
    narrow = written(spark, rows.select("doc_id", "entry", "n_shingles", "node", "text_sha256"), "ngram-narrow")
    drop(spark, rows, heap, nodes, members, roots, *links)  # what follows reads the two tables above only
    rows = narrow
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(named, "root").select("entry", "component_id", "root")
    return rows.join(known, "entry", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_sha256", "root")


def kept(docs: DataFrame, columns: list[str], n: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, that of the smallest doc_id and then of the least hash of its text; documents without words stay."""
    found = _joined(docs, n, percent)
    # rows of a component that share its smallest doc_id, or have none, may differ in their texts: the least hash stays
    able = found.where("n_shingles > 0 and doc_id <=> component_id").select("root", "doc_id", "text_sha256")
    chosen = able.groupBy("root").agg(F.min("text_sha256").alias("least"))
    one = able.join(chosen, "root").where("text_sha256 = least").select("doc_id", "text_sha256", F.lit(False).alias("all"), F.lit(True).alias("one"), F.lit(0).alias("rows"))
    return staying(docs, columns, found.select("doc_id", "text_sha256", (F.col("n_shingles") == 0).alias("all"), F.lit(False).alias("one"), F.lit(1).alias("rows")).union(one))
