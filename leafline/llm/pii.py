"""Personal data: patterns for e-mail, IP, card and phone, and terms that reveal such an entity.

Information-theoretic sanitisation. A term close to a mention of an entity e discloses it to the
degree PMI(t, e) / I(e) = log(p(e|t) / p(e)) / log(1 / p(e)), 1 where the term names the entity with
certainty. p(e) and p(t) come from document counts over the whole corpus, the joint count from the
documents that have the term within WINDOW words of a mention, each counted once. A pair counts only with SUPPORT
different contents: documents whose words around their mentions of the entity differ (so that copies of a text, and mentions
in one text, count once). Mentions of terms at or above GENERALISE
are spans of kind `term`; sanitise() replaces them by a general word, or removes them at or above
REMOVE; pattern spans are replaced by their kind.

One scan makes a row a document (spans, terms near entities) and the counts of all words, a row a word and
scan task; counts are aggregated, and only terms near entities are joined. No text is shuffled: sanitise() joins
a row's spans to the row by doc_id and hashes of the text.

Cases: a null or empty text has no spans. Spans are in code points, the end exclusive; spans of
different kinds may overlap. Very long texts are read whole; work grows in proportion to words and spans. Repeated rows count as documents
of their own, but their contents only once; equal doc_ids, and null ones, are told apart by their texts. Ties: of equal starts the kind listed
first goes first. An empty table gives an empty table. Other columns are ignored by find(), kept by sanitise(), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

WINDOW, SUPPORT, GENERALISE, REMOVE = 5, 3, 0.6, 0.9
#: Words whose counts a task holds at a time, give or take a batch.
HELD = 150_000
KINDS = ("email", "ip", "card", "phone", "term")
#: Patterns of the contract. A run of digits is tried at its beginning only, as from within it the same parts follow; an address is sought at its `@`.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = re.compile(r"[^\W\d_]{2,}")
DIGIT = re.compile("[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, entity) of the patterns' matches, by start, then kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, 0, end, "e" + text[start:end].lower()))
        at = text.find("@", max(at + 1, end))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "i" + m[0]))
    for m in CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end(), "c" + d))
    for m in PHONE.finditer(text):
        if 10 <= len(d := _digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "p" + d))
    return sorted(out)


def near_terms(text: str, spans: Sequence[tuple[int, int, int, str]], window: int) -> list[tuple[int, str, int, int, int]]:
    """(entity, term, start, end, surroundings) of the words within the window of each span, outside all spans.

    The window is the last words that end before the span and the first that begin after it; surroundings are the words near all the text's
    mentions of the entity. Words are found in one pass, a span's by bisection.
    """
    at = [m.span() for m in WORD.finditer(text)]
    firsts, lasts = [s for s, _ in at], [e for _, e in at]
    free, reach = [True] * len(at), 0
    for start, _, end, _ in spans:  # words that overlap a span, each looked at once
        for i in range(bisect_right(lasts, max(start, reach)), bisect_left(firsts, end)):
            free[i] = False
        reach = max(reach, end)
    found: dict[int, dict[int, None]] = {}
    for start, _, end, entity in spans:
        left, right = bisect_right(lasts, start), bisect_left(firsts, end)
        near = found.setdefault(xxhash.xxh3_64_intdigest(entity) - 2**63, {})
        near.update((i, None) for i in (*range(max(0, left - window), left), *range(right, min(len(at), right + window))) if free[i])
    out = []
    for key, near in found.items():
        words = [text[firsts[i] : lasts[i]].lower() for i in near]
        context = xxhash.xxh3_64_intdigest(" ".join(sorted(words))) - 2**63
        out += [(key, w, firsts[i], lasts[i], context) for i, w in zip(near, words, strict=True)]
    return out


def _scan(docs: DataFrame, window: int, also: bool = False) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("row", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "near", "word", "n")

    def make():
        task = TaskContext.get()
        state, counts = {"row": (task.partitionId() if task else 0) << 36}, Counter()

        def step(batch: pa.RecordBatch | None) -> dict | None:
            out: dict = {c: [] for c in names}
            ids = [] if batch is None else batch.column("doc_id").to_pylist()

            def flush() -> None:
                for c in names[:-2]:
                    out[c] += [None] * len(counts)
                ids.extend([None] * len(counts))
                out["word"] += counts
                out["n"] += counts.values()
                counts.clear()

            if batch is None:
                flush()
                return out | {"doc_id": ids} | ({"sha": [None] * len(ids)} if also else {})
            sha = batch.column("sha").to_pylist() if also else []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                counts.update(set(WORD.findall(text.lower())))
                found = near_terms(text, spans, window) if spans else []
                per = Counter(s[1] for s in spans)
                values = (state["row"], per[0], per[1], per[2], per[3], ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans), list({xxhash.xxh3_64_intdigest(x[3]) - 2**63 for x in spans}), [dict(zip(("entity", "term", "start", "end", "context"), f, strict=True)) for f in found], None, None)
                state["row"] += 1
                for c, v in zip(names, values, strict=True):
                    out[c].append(v)
            if len(counts) > HELD:  # counts of parts are summed later
                flush()
            return out | {"doc_id": ids} | ({"sha": sha + [None] * (len(ids) - len(sha))} if also else {})

        return step

    near = "array<struct<entity:long,term:string,start:int,end:int,context:long>>"
    schema = f"doc_id {kind}, row long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, near {near}, word string, n long" + ", sha string" * also
    sha = [F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias("sha")] if also else []
    return mapped(docs.select("doc_id", F.col("text").cast("string").alias("text"), *sha), make, schema, last=True)


def disclosures(scan: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or above the threshold, from a scan's table."""
    rows, words = scan.where("row is not null"), scan.where("word is not null")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    mentions = rows.where("size(near) > 0").select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term", "x.context").distinct()
    # a row once for each pair, whatever its mentions; first by surroundings, so that a hot pair is summed before it meets in one place
    pairs = mentions.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("rows")).groupBy("entity", "term").agg(F.sum("rows").alias("n_et"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= support)
    entities = rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    df = words.groupBy(F.col("word").alias("term")).agg(F.sum("n").alias("n_t"))
    # one row, so a broadcast of a constant
    known = pairs.join(entities, "entity").join(df, "term").join(F.broadcast(total))
    degree = F.when(F.col("n_e") < F.col("total"), 1 + F.log(F.least(F.col("n_et"), F.col("n_t")) / F.col("n_t")) / F.log(F.col("total") / F.col("n_e"))).otherwise(0.0)
    return known.withColumn("disclosure", degree).where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")


def find(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, also: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (kind:start:end of the patterns' spans), terms (array of start, end, term, disclosure) and row of each row of docs(doc_id, text). also: with the text's sha."""
    scan = written(docs.sparkSession, _scan(docs, window, also), "pii")
    revealing = disclosures(scan, support, generalise)
    rows = scan.where("row is not null")
    mentions = rows.where("size(near) > 0").select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term", "x.start", "x.end")
    marked = mentions.join(revealing, ["entity", "term"]).groupBy("row", "start", "end", "term").agg(F.max("disclosure").alias("disclosure"))
    terms = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "term", "disclosure"))).alias("terms"))  # at most the mentions of one document
    return rows.join(terms, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "terms", "row", *["sha"] * also)


def digest(found: DataFrame) -> DataFrame:
    """The rows of find() with base_sha256 and all spans in one text, by start, then kind."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {"base_sha256": [], "spans": []}
            for base, terms in zip(batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                spans = [(int(s), KINDS.index(k), int(e)) for x in base.split(",") if x for k, s, e in [x.split(":")]]
                spans += [(t["start"], 4, t["end"]) for t in terms or []]
                out["spans"].append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)))
            return out | {c: batch.column(c) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")}

        return step

    return mapped(found.drop("row"), make, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def replaced(text: str, base: str, terms: Sequence[dict], remove: float = REMOVE) -> str:
    """The text without its spans: a pattern's by its kind, a term generalised or removed. Overlapping spans go as one, under the first's name."""
    spans = [(int(s), int(e), f"[{k}]") for x in base.split(",") if x for k, s, e in [x.split(":")]]
    spans += [(t["start"], t["end"], "" if t["disclosure"] >= remove else "[term]") for t in terms or []]
    out, at = [], 0
    for s, e, name in sorted(spans):
        if s >= at:
            out += [text[at:s], name]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, columns: Sequence[str], remove: float = REMOVE) -> DataFrame:
    """These columns of docs with the spans of each text replaced.

    A row meets its spans by doc_id and two hashes of its text: rows equal in these have equal texts and so equal spans. Only rows
    with revealing terms are on the other side of that join; patterns are found anew.
    """
    id_, text_, terms_ = "_leafline_id", "_leafline_text", "_leafline_terms"
    key = lambda d: [F.col("doc_id").cast("string").alias(id_), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias(text_)]  # noqa: E731, ARG005
    found = find(docs.select("doc_id", "text"), also=True)
    terms = found.where("terms is not null").select(F.col("doc_id").cast("string").alias(id_), F.col("sha").alias(text_), F.col("terms").alias(terms_))
    terms = terms.groupBy(id_, text_).agg(F.first(terms_).alias(terms_))  # equal in all rows of a key
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("_leafline_whole"), *key(docs)).alias("a")
    rows = rows.join(terms.alias("b"), F.expr(f"a.{id_} <=> b.{id_} and a.{text_} = b.{text_}"), "left").select(*[F.col(f"a.`{c}`") for c in columns], "_leafline_whole", terms_)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out = []
            for text, terms in zip(batch.column("_leafline_whole").to_pylist(), batch.column(terms_).to_pylist(), strict=True):
                out.append(None if text is None else replaced(text, ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base_spans(text)), terms, remove))
            return {c: batch.column(c) for c in columns} | ({"text": out} if "text" in columns else {})

        return step

    return mapped(rows, make, schema)
