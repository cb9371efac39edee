"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

fit() takes at most SAMPLE labelled rows (those of the smallest hash of doc_id). Every word of theirs is a
term; document frequencies of the terms are counted over all documents and whole texts. A text is the unit vector of
(1 + ln tf) * idf * weight over its terms, weight being FLOOR plus the share that the term's log-likelihood ratio with the
label has of the largest, so that words which go with a label count most and none counts nothing. Words outside the
examples are no terms, in texts as in examples.

score() finds each text's K nearest examples exactly. Examples stand in blocks of BLOCK, in the order of their
strongest term. Rare terms have posting lists by block; terms of a DENSE-th of the examples or more have whole rows, and the
largest weight of each block. A text's rare terms give each example a sum; that, and for the dense terms the sum of weights
times the block's largest, bounds the block. Blocks are computed by falling bound, in turns, until no bound
reaches the K-th cosine. Neighbours vote with 1 / (SOFT + 1 - cosine), shrunk towards the base rate; they are the evidence.
A logistic curve, fitted on the votes that the examples get from each other (none from itself), makes the vote a calibrated score.

The model is bounded by SAMPLE rows and is broadcast. fit_score() tokenises each document once: a narrow pass writes the counts of
its terms, which give the frequencies, and then the scores. No text is shuffled.

Cases: a null or empty text, or one without known terms, has no direction; its vote is the rate of such examples. Very long texts
count whole. Repeated rows are scored alike. A doc_id with several labels counts as toxic if any label is; with several texts,
the least text is the example; equal texts are one example, toxic if any is. Null doc_ids and null labels teach nothing. An empty
table gives an empty table; without labels every score is 0. Of equally near examples those nearer the front of the index vote; their
order is that of their terms and texts, never of doc_id. Other columns of the input are kept by score() (score,
predicted and evidence give way), ignored by fit().
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass, field, replace
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, kept, mapped, texts, trim, written

SAMPLE, K, BLOCK, DENSE, SOFT, PRIOR, FLOOR = 6_000, 15, 64, 32, 0.05, 1.0, 0.01
#: Texts that are scored together.
BATCH = 128
#: Decimals to which cosines are told apart: sums are of single precision.
EXACT = 5
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ratio(n: np.ndarray, toxic: np.ndarray, rows: int, positive: int) -> np.ndarray:
    """Log-likelihood ratio of each term with the label: in how many examples, and toxic ones, it stands."""

    def cell(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    share, clean = positive / rows, n - toxic
    return 2 * (cell(toxic, n * share) + cell(clean, n * (1 - share)) + cell(positive - toxic, (rows - n) * share) + cell(rows - positive - clean, (rows - n) * (1 - share)))


def counted(text: str, terms: dict[str, int]) -> tuple[list[int], list[int]]:
    """The terms of a whole text, in order, and how often each stands in it."""
    found = sorted(Counter([i for w in words(text) if (i := terms.get(w)) is not None]).items())
    return [i for i, _ in found], [n for _, n in found]


@dataclass
class Index:
    """Examples as unit vectors over all their terms, in blocks."""

    terms: dict[str, int]
    weight: np.ndarray
    base: float = 0.0
    bare: float = 0.0
    curve: tuple[float, float] = (1.0, 0.0)
    ids: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Postings by term: places of the terms' first entries, then examples and weights.
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms, in order, and weights of a whole text, of length one."""
        return self.unit(*counted(text, self.terms))

    def unit(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        """The same from terms, in order, and their counts."""
        t = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(counts, np.float64))) * self.weight[t]
        return t, w / math.sqrt(float(w @ w) or 1.0)

    def fill(self, examples: list[tuple[object, int, str, np.ndarray, np.ndarray]]) -> None:
        """examples: (doc_id, label, hash of the text, terms, weights), with terms."""
        rows = sorted(examples, key=lambda r: (int(r[3][r[4].argmax()]), len(r[3]), r[2]))
        rows = [rows[i] for i in self._near_together(rows)]
        self.vectors = [(r[3], r[4]) for r in rows]
        self.ids, self.labels = [r[0] for r in rows], np.array([r[1] for r in rows], float)
        size = [len(r[3]) for r in rows]
        term = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.start = np.searchsorted(term[order], np.arange(len(self.weight) + 1))
        self.place = np.repeat(np.arange(len(rows), dtype=np.int32), size)[order]
        self.value = (np.concatenate([r[4] for r in rows]) if rows else np.zeros(0))[order]

    def _near_together(self, rows: list) -> list[int]:
        """An order in which like examples share blocks, so that blocks' largest weights say much: halved along the main direction again and again."""
        n = np.bincount(np.concatenate([r[3] for r in rows]), minlength=len(self.weight)) if rows else np.zeros(0)
        common = np.argsort(-n, kind="stable")[:512]
        column = np.full(len(self.weight), -1, np.int64)
        column[common] = np.arange(len(common))
        table = np.zeros((len(rows), len(common)), np.float32)
        for i, r in enumerate(rows):
            c = column[r[3]]
            table[i, c[c >= 0]] = r[4][c >= 0]
        out, todo = [], [np.arange(len(rows))]
        while todo:
            part = todo.pop()
            if len(part) <= BLOCK:
                out += part.tolist()
                continue
            x = table[part] - table[part].mean(0)
            v = x[np.argmax((x * x).sum(1))]
            for _ in range(8):
                v = (x @ v) @ x
                v /= max(float(np.sqrt(v @ v)), 1e-12)
            part = part[np.argsort(x @ v, kind="stable")]
            half = -(-len(part) // (2 * BLOCK)) * BLOCK
            todo += [part[half:], part[:half]]
        return out

    def layout(self) -> None:
        """The dense terms' rows and block maxima; made where the index is used, not sent."""
        n = len(self.ids)
        self.blocks = -(-n // BLOCK)
        dense = np.flatnonzero(np.diff(self.start) >= max(2, n / DENSE))
        self.row = np.full(len(self.weight), -1, np.int64)
        self.row[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), self.blocks * BLOCK), np.float32)
        for i, t in enumerate(dense.tolist()):
            self.dense[i, self.place[self.start[t] : self.start[t + 1]]] = self.value[self.start[t] : self.start[t + 1]]
        self.maxima = self.dense.reshape(len(dense), self.blocks, BLOCK).max(2) if n else np.zeros((len(dense), 0), np.float32)
        self.dense = np.ascontiguousarray(self.dense.reshape(len(dense), self.blocks, BLOCK).transpose(1, 0, 2))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the k examples of the largest positive cosine for each vector, ties to the smaller place; `without` leaves out an example each."""
        if not hasattr(self, "blocks"):
            self.layout()
        m, width = len(vectors), self.blocks * BLOCK
        sums, dense = np.zeros((m, width), np.float32), np.zeros((m, len(self.maxima)), np.float32)
        for i, (t, q) in enumerate(vectors):
            row = self.row[t]
            dense[i, row[row >= 0]] = q[row >= 0]
            rare, q = t[row < 0], q[row < 0]
            spans = [slice(x, y) for x, y in zip(self.start[rare].tolist(), self.start[rare + 1].tolist(), strict=True)]
            if spans:
                weights = np.concatenate([self.value[x] for x in spans])
                weights *= np.repeat(q, [x.stop - x.start for x in spans])
                sums[i] = np.bincount(np.concatenate([self.place[x] for x in spans]), weights, width)
        by_block = sums.reshape(m, self.blocks, BLOCK)
        bounds = dense @ self.maxima + by_block.max(2) if self.blocks else np.zeros((m, 0))
        order, turn, step = np.argsort(-bounds, axis=1, kind="stable"), 0, max(1, -(-2 * k // BLOCK))
        rank = np.argsort(order, axis=1)
        who_, at_, cosine_ = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(m, 10.0**-EXACT)  # below the k-th cosine yet, nothing counts
        while turn < self.blocks:
            # the blocks of this turn that may still hold one of the k; the last turn takes all that are left
            asked = (rank >= turn) & (rank < turn + step) & (bounds >= floor[:, None] - 10.0**-EXACT)
            if not asked.any():
                break
            parts = [(who_, at_, cosine_)]
            for b in np.flatnonzero(asked.any(0)).tolist():
                who = np.flatnonzero(asked[:, b])
                cosines = np.round((dense[who] @ self.dense[b] + by_block[who, b]).astype(np.float64), EXACT)
                i, j = np.nonzero(cosines >= floor[who, None])
                parts.append((who[i], j + b * BLOCK, cosines[i, j]))
            who_, at_, cosine_ = (np.concatenate(p) for p in zip(*parts, strict=True))
            if without is not None:
                other = at_ != np.asarray(without)[who_]
                who_, at_, cosine_ = who_[other], at_[other], cosine_[other]
            sort = np.lexsort((at_, -cosine_, who_))
            who_, at_, cosine_ = who_[sort], at_[sort], cosine_[sort]
            first = np.searchsorted(who_, np.arange(m + 1))
            near = np.arange(len(who_)) - first[who_] < k
            who_, at_, cosine_ = who_[near], at_[near], cosine_[near]
            full = np.flatnonzero(np.bincount(who_, minlength=m) == k)
            floor[full] = cosine_[np.searchsorted(who_, full, "right") - 1]
            turn, step = turn + step, step * 4 if turn < 4 else self.blocks
        first = np.searchsorted(who_, np.arange(m + 1)).tolist()
        return [(at_[x:y], cosine_[x:y]) for x, y in pairwise(first)]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """The neighbours' weighted share of toxic ones, shrunk towards the base rate."""
        weight = 1 / (SOFT + np.maximum(0, 1 - cosine))
        return (float(weight @ self.labels[at]) + PRIOR * self.base) / (float(weight.sum()) + PRIOR)

    def calibrate(self, k: int) -> None:
        """Fits the logistic curve on the examples' votes about each other."""
        vectors = self.vectors
        votes = np.concatenate([[self.vote(*near) for near in self.nearest(vectors[i : i + BATCH], k, list(range(i, min(i + BATCH, len(vectors)))))] for i in range(0, len(vectors), BATCH)])
        x, y, a, b = _logit(votes), self.labels, 1.0, 0.0
        for _ in range(50):  # Newton's steps; a small ridge around the vote itself keeps separable labels finite
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            s = p * (1 - p)
            gradient = np.array([(p - y) @ x + a - 1.0, (p - y).sum() + b])
            step = np.linalg.solve(np.array([[s @ (x * x) + 1.0, s @ x], [s @ x, s.sum() + 1.0]]), gradient)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        if np.isfinite(a) and a > 0 and np.isfinite(b):
            self.curve = (float(a), float(b))

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[float, str]]:
        """Score, and the evidence as doc_id:label:similarity of the neighbours, of each vector."""
        out = []
        for at in range(0, len(vectors), BATCH):
            for places, cosine in self.nearest(vectors[at : at + BATCH], k):
                p = self.vote(places, cosine) if len(places) else self.bare
                p = 1 / (1 + math.exp(-(self.curve[0] * float(_logit(p)) + self.curve[1]))) if self.ids else p
                out.append((round(p, 9), ",".join(f"{self.ids[i]}:{int(self.labels[i])}:{c:.4f}" for i, c in zip(places.tolist(), cosine.tolist(), strict=True))))
        return out


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _taught(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, label, sha, terms and counts of the examples, a table."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample is bounded, so its ids may be broadcast
    taught = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    taught = taught.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    # copies teach once
    taught = taught.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = [Counter(words(t)) for t in texts(batch)]
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "sha": sha, "terms": [list(f) for f in found], "counts": [list(f.values()) for f in found]}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(spark, mapped(taught.select("doc_id", "label", "text"), make, f"doc_id {kind}, label int, sha string, terms array<string>, counts array<int>"), "taught")


def _bags(docs: DataFrame, shared: Broadcast, columns: list[str]) -> DataFrame:
    """These columns of docs, and the terms of each text with their counts. shared: the terms' numbers."""
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)

    def make():
        terms = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            found = [counted(t, terms) for t in texts(batch, "_leafline_text")]
            return {c: batch.column(c) for c in columns} | {"_leafline_terms": [t for t, _ in found], "_leafline_counts": [n for _, n in found]}

        return step

    return mapped(docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("_leafline_text")), make, schema + "_leafline_terms array<int>, _leafline_counts array<int>")


def _learn(docs: DataFrame, labels: DataFrame, columns: list[str], sample: int, k: int) -> tuple[Index, DataFrame | None]:
    """The index, and the table of _bags() that its frequencies come from; none without examples."""
    spark = docs.sparkSession
    taught = _taught(docs, labels, sample)
    rows, positive = taught.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not rows:
        return Index({}, np.zeros(0)), None
    # what the driver gets is bounded by `sample` rows
    seen = taught.select(F.explode("terms").alias("term"), "label").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).orderBy("term").toArrow()
    terms = {t: i for i, t in enumerate(seen.column("term").to_pylist())}
    llr = ratio(seen.column("n").to_numpy().astype(float), seen.column("toxic").to_numpy().astype(float), rows, positive)
    shared = spark.sparkContext.broadcast(terms)
    bags = written(spark, _bags(docs, shared, columns), "bags")
    # over all documents: idf
    found = bags.select(F.explode("_leafline_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toArrow()
    df = np.zeros(len(terms))
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    weight = (np.log((1 + bags.count()) / (1 + df)) + 1) * (FLOOR + llr / max(float(llr.max(initial=0.0)), 1e-9))
    index = Index(terms, weight, base=positive / rows)

    def make():
        numbers = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            both = [sorted((numbers[t], n) for t, n in zip(*b, strict=True)) for b in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            return {c: batch.column(c) for c in ("doc_id", "label", "sha")} | {"terms": [[t for t, _ in b] for b in both], "counts": [[n for _, n in b] for b in both]}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    examples, bare = [], []
    for batch in mapped(taught, make, f"doc_id {kind}, label int, sha string, terms array<int>, counts array<int>").toArrow().to_batches():
        for i, (doc, label, sha) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "label", "sha")], strict=True)):
            t, n = batch.column("terms")[i].values.to_numpy(), batch.column("counts")[i].values.to_numpy()
            if len(t):
                examples.append((doc, label, sha, *index.unit(t, n)))
            else:
                bare.append(label)
    index.bare = (sum(bare) + PRIOR * index.base) / (len(bare) + PRIOR)
    index.fill(examples)
    if len(examples) > k:
        index.calibrate(k)
    index.__dict__ = {f: v for f, v in index.__dict__.items() if f not in ("blocks", "row", "dense", "maxima", "vectors")}  # made anew by each process, or done with
    shared.unpersist()
    drop(spark, taught)
    del examples, seen, found
    trim()
    return index, bags


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int = K) -> Index:
    """The index of at most `sample` labelled rows of docs(doc_id, text); labels(doc_id, toxic)."""
    index, bags = _learn(docs, labels, [], sample, k)
    if bags is not None:
        drop(docs.sparkSession, bags)
    return index


def _scored(bags: DataFrame, index: Index, columns: list[str], k: int) -> DataFrame:
    shared, key = bags.sparkSession.sparkContext.broadcast(replace(index, terms={})), uuid.uuid4().hex
    keep = [c for c in columns if c not in ("score", "predicted", "evidence")]
    schema = "".join(f"`{c}` {bags.schema[c].dataType.simpleString()}, " for c in keep)

    def make():
        model = kept(key, lambda: shared.value)  # one index a worker

        def step(batch: pa.RecordBatch) -> dict:
            terms, counts = batch.column("_leafline_terms"), batch.column("_leafline_counts")
            at, t, n = terms.offsets.to_numpy(), terms.values.to_numpy(), counts.values.to_numpy()
            out = model.scores([model.unit(t[a:b], n[a:b]) for a, b in pairwise(at.tolist())], k)
            return {c: batch.column(c) for c in keep} | {"score": [s for s, _ in out], "predicted": [int(s >= 0.5) for s, _ in out], "evidence": [e for _, e in out]}

        return step

    return mapped(bags.select(*[F.col(f"`{c}`") for c in keep], "_leafline_terms", "_leafline_counts"), make, schema + "score double, predicted int, evidence string", keeps=key)


def score(docs: DataFrame, index: Index, columns: list[str], k: int = K) -> DataFrame:
    """These columns of docs, with score, predicted (1 from 0.5 on) and evidence. `text` is read; columns of these three names give way."""
    shared = docs.sparkSession.sparkContext.broadcast(index.terms)
    return _scored(_bags(docs, shared, columns), index, columns, k)


def fit_score(docs: DataFrame, labels: DataFrame, columns: list[str], sample: int = SAMPLE, k: int = K) -> DataFrame:
    """score() of docs by the index of their own labelled rows; each text is tokenised once."""
    index, bags = _learn(docs, labels, columns, sample, k)
    return score(docs, index, columns, k) if bags is None else _scored(bags, index, columns, k)
