"""URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rules. A host rule (`host/path`, allow or block) fits a host and its subdomains if
the url's path starts with the rule's; the longest that fits decides. A pattern rule blocks urls; they decide where no host rule fits, and no
match means allow. Patterns are literal text with `*` (anything), `^` (an end of the url, or any sign but letters and digits), `|` at
either end (the url begins or ends there) and `||` at the beginning (a host or subdomain begins there).

Every rule is compiled to a regular expression over host + path when it is first a candidate, and filed under one literal token, that of its
tokens that is rarest in the urls at hand (counted over all of them). A token is a run of letters and digits that a match holds whole: its
ends in the rule are anchors or other signs. Rules without one are filed under the GRAM letters of their rarest part of a token instead. A
url's tokens and, if a rule needs them, their parts fetch the candidate rules; only those run. A rule without either raises
ValueError, so none is tried on every url.

Cases: a null url, or one without `://`, has an empty host and path; no host rule fits, no pattern finds anything, and
the verdict is allow. Very long urls count whole. Null or repeated page_ids and repeated rows are judged each on their own; ties of host rules
are of equal text, and of patterns the first by its text is reported. An empty table gives an empty table, and
other columns are ignored, whatever their names. Hosts compare with A-Z lower-cased, paths as they are; patterns against both lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

GRAM = 3
TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that mark advertising, gambling, adult and download pages, as parts of a host or path.
BLOCKED = ("ads", "adserver", "banner", "banners", "casino", "clickbait", "download", "lottery", "malware", "phishing", "popup", "porn", "sexcam", "torrent", "tracker", "warez", "xxx")
_SIGN = "[^a-z0-9]"


@dataclass(frozen=True)
class Rule:
    """text: what to report. pattern: over host + path. tokens: of which every match has each, whole, or `~` and parts of tokens."""

    text: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    host: bool


def host_rule(text: str, verdict: str) -> Rule:
    """`example.com/en/7`: a host with its subdomains, and a beginning of the path."""
    host, slash, path = text.partition("/")
    host = host.translate(_LOWER)
    # a token that the rule's end may cut isn't whole in every match
    last = len(slash + path) if (slash + path)[-1:] and not (slash + path)[-1].isalnum() else len((slash + path).rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    tokens = TOKEN.findall(host) + TOKEN.findall((slash + path)[:last].translate(_LOWER))
    if not tokens:
        raise ValueError(f"no token in {text!r}")
    return Rule(text, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(slash + path) if slash else '(?=/|$)'}", verdict, tuple(tokens), True)


def pattern_rule(text: str) -> Rule:
    """`||ads.example.com^`, `/banner/*.gif|`, `^popup^`: blocks urls whose lower-cased host and path it finds."""
    body = text.translate(_LOWER)
    lead = 2 if body.startswith("||") else 1 if body.startswith("|") else 0
    trail = len(body) > lead and body.endswith("|")
    body = body[lead : len(body) - trail]
    begin = ("", "^", r"^(?:[^/?#]*\.)?")[lead]
    pattern = begin + "".join({"*": ".*", "^": rf"(?:^|{_SIGN}|$)"}.get(c) or re.escape(c) for c in body) + ("$" if trail else "")
    whole, parts = [], []
    for m in TOKEN.finditer(body):
        left = body[m.start() - 1] != "*" if m.start() else lead > 0
        right = body[m.end()] != "*" if m.end() < len(body) else trail
        # `^` may stand for a sign between tokens or an end of the url, both of which end a token
        if left and right:
            whole.append(m[0])
        else:
            parts += ["~" + m[0][i : i + GRAM] for i in range(len(m[0]) - GRAM + 1)]
    if not whole and not parts:
        raise ValueError(f"no token, nor {GRAM} letters of one, in {text!r}")
    return Rule(text, pattern, "block", tuple(whole or parts), False)


DEFAULT = [pattern_rule(f"^{n}^") for n in BLOCKED] + [pattern_rule(f".{n}|") for n in ("exe", "apk", "msi")]


def split(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return m[1].translate(_LOWER), m[2]


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[Rule]] = {}
        self.compiled: dict[Rule, re.Pattern] = {}
        for r in rules:
            self.by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(r)
        self.parts = any(t.startswith("~") for t in self.by_token)

    def fits(self, rule: Rule, text: str) -> bool:
        if (compiled := self.compiled.get(rule)) is None:
            compiled = self.compiled[rule] = re.compile(rule.pattern, re.S)
        return bool(compiled.search(text))

    def candidates(self, low: str) -> list[Rule]:
        """The rules that a lower-cased host and path fetches."""
        keys = set(TOKEN.findall(low))
        if self.parts:
            keys |= {"~" + t[i : i + GRAM] for t in keys for i in range(len(t) - GRAM + 1)}
        return [r for t in keys & self.by_token.keys() for r in self.by_token[t]]

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None]:
        """The host rule that decides or None, the verdict, and the pattern rule that blocked or None."""
        if not host and not path:
            return None, "allow", None
        whole = host + path
        low = whole.translate(_LOWER)
        hit = [r for r in self.candidates(low) if self.fits(r, whole if r.host else low)]
        if hosts := [r for r in hit if r.host]:
            best = max(hosts, key=lambda r: (len(r.text), r.text))
            return best.text, best.verdict, None
        names = [r.text for r in hit if not r.host]
        return None, "block" if names else "allow", min(names, default=None)


def token_counts(pages: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many urls each of the rules' tokens, or parts of tokens, stands. At most one count for each of them; they are joined as a table, whatever the length of the list."""
    spark = pages.sparkSession
    known = sorted({t for r in rules for t in r.tokens})
    wanted = spark.createDataFrame(pa.table({"t": pa.array(known, pa.string())}))
    tokens = F.regexp_extract_all(F.lower(F.col("url").cast("string")), F.lit("[a-z0-9]+"), F.lit(0))
    if any(t.startswith("~") for t in known):
        grams = F.flatten(F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (GRAM - 1), F.lit(1))), lambda i: F.concat(F.lit("~"), t.substr(i, F.lit(GRAM))))))
        tokens = F.concat(tokens, grams)
    found = pages.select(F.explode(F.array_distinct(tokens)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return {r.t: r.n for r in found.join(wanted, "t").collect()}


def judge(pages: DataFrame, rules: Sequence[Rule], defaults: Sequence[Rule] = tuple(DEFAULT)) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of each row of pages(page_id, url). The rules are the caller's list and are broadcast; no shuffle of urls."""
    both = [*rules, *defaults]
    shared = pages.sparkSession.sparkContext.broadcast((both, token_counts(pages, both)))
    kind = pages.schema["page_id"].dataType.simpleString()

    def make():
        index = RuleIndex(*shared.value)

        def step(batch: pa.RecordBatch) -> dict:
            parts = [split(u) for u in batch.column("url").to_pylist()]
            found = [index.judge(*p) for p in parts]
            return {"page_id": batch.column("page_id"), "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [f[0] for f in found], "verdict": [f[1] for f in found], "pattern": [f[2] for f in found]}

        return step

    return mapped(pages.select("page_id", F.col("url").cast("string").alias("url")), make, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")
