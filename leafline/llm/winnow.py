"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of w consecutive hashes the
minimum is selected, the rightmost of equal ones, with its position. Two texts that share a passage of
w + k - 1 code points share a selected hash, where w is the larger window of the two. The window of a text is
an eighth of its number of grams, W at most and 1 at least, so that short texts keep several: from 24 code points on, two
thirds of a text left unchanged always share a hash with it. From 399 code points on the window is W. The hash of a k-gram is built by doubling from those of its
halves, the windows' minima likewise, so that a text costs a fixed number of passes over arrays.

neighbours() gives each document the one that follows it by descending doc_id: documents are dealt to
ranges of doc_id, and the first row of each range also goes to the range before. Only the ranges' bounds
and heads, a row a range, come to the driver; texts are shuffled once. A doc_id or null that many rows share
fills several ranges, dealt by the hash of the text.

Cases: null text counts as empty. An empty text selects nothing; a text shorter than k is one gram. Two empty
fingerprints are alike (1), an empty one and another are not (0). Rows that repeat a doc_id follow each other by
a hash of the text; null doc_ids stand at the end. A single row follows itself. An empty table
gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, texts

K, W, SHARE = 16, 48, 8
EXACT = 2.0**53  # below it a doc_id and its double are one and the same
_R = 0x9E3779B97F4A7C15 | 1


def kgram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of the k-grams of an array of code points (of the whole, if it is shorter)."""
    k = min(k, len(points))
    power, block = points.astype(np.uint64) + np.uint64(1), 1
    out, length = None, 0
    while True:
        if k & block:  # appends a block of this length to what there is
            if out is None:
                out, length = power, block
            else:
                m = len(points) - length - block + 1
                out = power[:m] * np.uint64(pow(_R, length, 2**64)) + out[block : block + m]
                length += block
        block *= 2
        if block > k:
            break
        m, half = len(points) - block + 1, block // 2
        power = power[:m] * np.uint64(pow(_R, half, 2**64)) + power[half : half + m]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((out ^ (out >> np.uint64(32))) >> np.uint64(16)).astype(np.uint32)


def window(n: int) -> int:
    """The window of a text of n grams."""
    return min(W, max(1, n // SHARE))


def winnow(text: str, k: int = K, w: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the selected k-grams, by position; the window is that of the text's length if it isn't given."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    hashes = kgram_hashes(points, k)
    n = len(hashes)
    # the hash above, the position reversed below: the least is the rightmost of equal hashes
    low = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(2**32 - 1, 2**32 - 1 - n, -1, dtype=np.uint64)
    w, size = min(w or window(n), n), 1
    while 2 * size <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    chosen = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return (np.uint64(2**32 - 1) - (chosen & np.uint64(2**32 - 1))).astype(np.uint32), (chosen >> np.uint64(32)).astype(np.uint32)


def as_text(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Sixteen hexadecimal digits a selected k-gram: position, hash."""
    return np.stack(print_, 1).astype(">u4").tobytes().hex() if len(print_[0]) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = K, w: int | None = None) -> DataFrame:
    """doc_id, positions and hashes of each row of docs(doc_id, text). No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            got = [winnow(t, k, w) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "positions": [p.astype(np.int64) for p, _ in got], "hashes": [h.astype(np.int64) for _, h in got]}

        return step

    return mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), make, f"doc_id {kind}, positions array<long>, hashes array<long>")


def neighbours(docs: DataFrame, make, schema: str) -> DataFrame:
    """Deals docs(doc_id, text) to ranges by descending doc_id and maps them; make() gives a function of a row (doc_id, text) and the text that follows it, whose results are rows of schema."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    number = F.col("doc_id").cast("double")
    bounds = sorted(docs.select(number.alias("d")).approxQuantile("d", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else [])
    bounds = [b for i, b in enumerate(bounds) if abs(b) < EXACT or b not in bounds[:i]]
    every = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    spare = parts * (every.n - every.known) // max(1, every.n)
    met = lambda test: F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), test)) if bounds else F.lit(0)
    above, equal = met(lambda b: b >= number), met(lambda b: b == number)
    # a doc_id that is several bounds fills as many ranges, and null doc_ids as many as their share, by the text's hash
    split = lambda n: F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * n), n - 1)
    part = F.when(number.isNull(), len(bounds) + split(F.lit(spare + 1))).when(equal > 1, above - equal + 1 + split(equal)).otherwise(above)
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("part", part.cast("int"))
    heads = sorted((r.part, r.first) for r in keyed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "h")).alias("first")).collect())
    guests = [(first.down, first.h, heads[i - 1][0]) for i, (_, first) in enumerate(heads)]  # the head of a range follows the last of the range before; the first head, all
    known = spark.createDataFrame(guests, "down long, head long, target int")
    sent = keyed.join(F.broadcast(known), F.bitwise_not("doc_id").eqNullSafe(known.down) & (keyed.h == known["head"])).select("doc_id", "text", "h", F.col("target").alias("part"), F.lit(1).alias("guest"))
    dealt = keyed.select("doc_id", "text", "h", "part", F.lit(0).alias("guest")).unionByName(sent)
    dealt = dealt.repartitionById(len(bounds) + 1 + spare, "part").sortWithinPartitions("guest", F.desc_nulls_last("doc_id"), "h", "text")

    def start():
        process = make()
        names = [f.split()[0] for f in schema.split(", ")]
        held: list = []

        def step(batch: pa.RecordBatch | None) -> dict | None:
            out = []
            if batch is not None:
                for doc_id, text, guest in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "guest")], strict=True):
                    if held and not held[0][2]:
                        out.append(process(*held[0][:2], text))
                    if held and held[0][2] and guest:
                        continue
                    held[:] = [(doc_id, text, guest)]
            return {c: [r[i] for r in out] for i, c in enumerate(names)}

        return step

    return mapped(dealt.select("doc_id", "text", "guest"), start, schema)


def compare(docs: DataFrame, k: int = K, w: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (its last third replaced by the following document's beginning) and of the following document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        last: list = [None, None]

        def print_of(text: str):
            if last[0] != text:
                last[:] = [text, winnow(text, k, w)]
            return last[1]

        def process(doc_id, text: str, following: str):
            n = len(text)
            edited = text[: n - n // 3] + following[: n // 3]
            own, other = print_of(text), winnow(edited, k, w)
            after = print_of(following)
            a, b, c = (np.unique(p[1]) for p in (own, other, after))
            return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other), likeness(a, b), likeness(a, c)

        return process

    return neighbours(docs, make, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
