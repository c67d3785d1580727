"""Secret scans: a trigram inverted index in front of the rules' regular expressions.

From the parse tree of each regular expression a Boolean trigram query is derived: an AND/OR formula of
trigrams that every matching text holds (ASCII letters folded). Each block of documents, an Arrow batch, has
an inverted index of the trigrams that the queries name: trigram -> documents. Postings are intersected and
united as the query says, and only the candidates run the expression. Rules for which no trigram is mandatory
scan every document. Candidate search loses nothing: the queries are necessary conditions.

Nulls and odd rows: a null text is an empty one. Every row is judged by itself, so ties and repeated rows give
equal results and empty tables empty ones. Texts are searched whole. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, table

#: A formula: True (no condition), a trigram, or ("and" | "or", frozenset of formulas).
Query = bool | str | tuple


@dataclass(frozen=True)
class SecretRule:
    """kind: the name in spans; least: code points that the match (or group, if given) must have, or it is dropped."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    least: int = 0
    group: int = 0


ASSIGN = SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 6, 2)
ACCESS = SecretRule("access", r"AKIA[A-Z0-9]+", re.ASCII, 20)
HEX = SecretRule("hex", r"[0-9a-f]+", re.ASCII, 24)
#: The three that the query fixes come first; their order is the order of kinds.
BASE = [ASSIGN, ACCESS, HEX]
#: Further public formats of credentials.
EXTRA = [
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
]
LIMIT = 64
BLOCK_CHARS = 2_000_000


def both(kind: str, *parts: Query) -> Query:
    """AND or OR of formulas, simplified."""
    flat: set[Query] = set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def needs(strings: set[str]) -> Query:
    """A text that holds one of the strings holds one's trigrams; True if one has none."""
    return both("or", *(both("and", *(s[i : i + 3] for i in range(len(s) - 2))) if len(s) > 2 else True for s in strings)) if strings else True


@dataclass
class Info:
    """What is known of the texts that a piece of an expression matches: all of them (exact) while they are few,
    else what they may begin and end with, and the formula that they imply."""

    exact: set[str] | None
    first: set[str]
    last: set[str]
    query: Query


def opened(x: Info) -> Info:
    """x without exact texts."""
    return x if x.exact is None else Info(None, {s[:3] for s in x.exact}, {s[-3:] for s in x.exact}, both("and", x.query, needs(x.exact)))


def joined(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= LIMIT:
        return Info({x + y for x in a.exact for y in b.exact}, set(), set(), both("and", a.query, b.query))
    first = {x + y for x in a.exact for y in (b.first if b.exact is None else b.exact)} if a.exact is not None and len(a.exact) * len(b.exact or b.first) <= LIMIT else opened(a).first
    last = {x + y for x in (a.last if a.exact is None else a.exact) for y in b.exact} if b.exact is not None and len(b.exact) * len(a.exact or a.last) <= LIMIT else opened(b).last
    a, b = opened(a), opened(b)
    across = {x + y for x in a.last for y in b.first} if len(a.last) * len(b.first) <= LIMIT else {""}
    return Info(None, first, last, both("and", a.query, b.query, needs(first), needs(last), needs(across)))


ANY = Info(None, {""}, {""}, True)
EMPTY = Info({""}, set(), set(), True)


def info(node: object) -> Info:
    """Of a parsed expression (or a part of one). Characters are folded to ASCII lower case; a part that this
    doesn't know counts as anything, which only makes the formula weaker."""
    if isinstance(node, sre_parser.SubPattern):
        return reduce(joined, map(info, node), EMPTY)
    kind, value = node
    if kind is sre.LITERAL:
        return Info({chr(value).lower() if value < 128 else chr(value)}, set(), set(), True) if value < 128 else ANY
    if kind is sre.IN:
        chars: set[str] = set()
        for k, v in value:
            if k is sre.LITERAL and v < 128:
                chars.add(chr(v).lower())
            elif k is sre.RANGE and v[1] < 128:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return ANY
        return Info(chars, set(), set(), True) if len(chars) <= 8 else ANY
    if kind is sre.SUBPATTERN:
        return info(value[3])
    if kind is sre.BRANCH:
        found = [info(x) for x in value[1]]
        if all(x.exact is not None for x in found) and sum(len(x.exact) for x in found) <= LIMIT:
            return Info(set().union(*(x.exact for x in found)), set(), set(), both("or", *(x.query for x in found)))
        found = [opened(x) for x in found]
        return Info(None, set().union(*(x.first for x in found)), set().union(*(x.last for x in found)), both("or", *(x.query for x in found)))
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = value
        one = info(inner)
        if high == 1 and low == 0:
            return Info(one.exact | {""}, set(), set(), True) if one.exact is not None else ANY
        if low == 0:
            return ANY
        if high == low == 1:
            return one
        one = opened(one)
        return Info(None, one.first, one.last, one.query)
    if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return EMPTY
    return ANY


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """A formula of ASCII-lower-case trigrams that holds for every text in which the pattern matches; True if it has no mandatory trigram."""
    return opened(info(sre_parser.parse(pattern, flags))).query


def trigrams(q: Query) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))


def answer(q: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Which of n documents satisfy the formula: postings (sorted document numbers) are intersected or united."""
    if q is True:
        return np.arange(n)
    if isinstance(q, str):
        return postings.get(q, np.empty(0, int))
    found = sorted((answer(x, postings, n) for x in q[1]), key=len)
    return reduce(np.intersect1d if q[0] == "and" else np.union1d, found)


class Index:
    """The inverted index of a block of texts over a set of trigrams."""

    def __init__(self, names: set[str]):
        self.names = sorted(x for x in names if x.isascii())
        self.codes = np.array([ord(x[0]) << 16 | ord(x[1]) << 8 | ord(x[2]) for x in self.names], np.uint32)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower folds ASCII only
        ends = np.cumsum([len(r) + 2 for r in raw])
        b = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8)
        if len(b) < 3 or not len(self.codes):
            return {}
        code = b[:-2].astype(np.uint32)
        code <<= 8
        code |= b[1:-1]
        code <<= 8
        code |= b[2:]
        at = np.flatnonzero(self.wanted[code])
        docs = np.searchsorted(ends, at, "right").astype(np.int64)
        pairs = np.unique(np.searchsorted(self.codes[(order := np.argsort(self.codes))], code[at]).astype(np.int64) << 32 | docs)
        which, docs = order[pairs >> 32], pairs & 0xFFFFFFFF
        return {self.names[k]: docs[which == k] for k in np.unique(which)}


class Scanner:
    """Finds the spans of rules in blocks of texts."""

    def __init__(self, rules: list[SecretRule]):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        self.index = Index(set().union(*(trigrams(q) for *_, q in self.rules)))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text (start, number of the rule, end), sorted. Texts are indexed in blocks of about BLOCK_CHARS."""
        out, block, chars = [], [], 0
        for t in texts:
            block.append(t)
            chars += len(t)
            if chars >= BLOCK_CHARS:
                out += self.block(block)
                block, chars = [], 0
        return out + self.block(block)

    def block(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.index.postings(texts)
        for k, (rule, compiled, query) in enumerate(self.rules):
            for i in answer(query, postings, len(texts)):
                for m in compiled.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in found]


def scan(df: DataFrame, rules: list[SecretRule], text: str = "text", out: str = "spans", redacted: str | None = None) -> DataFrame:
    """df with a column of spans (array of structs kind, start, end by start, then the rules' order) and, if
    redacted is given, one of the text with each span (overlapping ones together) replaced by ``[SECRET]``; an
    existing column of that name is replaced. A null text has no spans and stays null. No shuffle."""
    bounded_batches(df.sparkSession)
    names = [r.kind for r in rules]
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kind = T.StructType([T.StructField("spans", span), T.StructField("redacted", T.StringType())])
    made: dict[str, Scanner] = {}

    @F.pandas_udf(kind)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = made.setdefault("", Scanner(rules))
        for texts in batches:
            values = [x or "" for x in texts]
            found = scanner.spans(values)
            yield pd.DataFrame({"spans": [[{"kind": names[k], "start": s, "end": e} for s, k, e in f] for f in found], "redacted": [None if raw is None else redact(v, f) if redacted else "" for raw, v, f in zip(texts, values, found, strict=True)]})

    (tmp,) = fresh(df, "_found")
    cols = {out: F.col(f"{tmp}.spans")} | ({redacted: F.col(f"{tmp}.redacted")} if redacted else {})
    return df.withColumn(tmp, find(F.col(text))).withColumns(cols).drop(tmp)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """Text with the union of the spans, each stretch, replaced by mark."""
    out, at = [], 0
    stretch: list[int] | None = None
    for start, _, end in [*spans, (len(text) + 1, 0, 0)]:
        if stretch and start < stretch[1]:
            stretch[1] = max(stretch[1], end)
            continue
        if stretch:
            out += [text[at : stretch[0]], mark]
            at = stretch[1]
        stretch = [start, end]
    return "".join(out) + text[at:]


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every whole text of documents."""
    rules = BASE + EXTRA
    base, known = [r.kind for r in BASE], [r.kind for r in rules]
    made: dict[str, Scanner] = {}

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = made.setdefault("", Scanner(rules))
        for texts in batches:
            rows = []
            for found in scanner.spans([x or "" for x in texts]):
                ours = [f"{known[k]}:{s}:{e}" for s, k, e in found if k < len(base)]
                rows.append((*(sum(k == n for _, k, _ in found) for n in range(len(base))), hashlib.sha256(",".join(ours).encode()).hexdigest(), ",".join(f"{known[k]}:{s}:{e}" for s, k, e in found)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    docs = table(spark, sf_dir, "documents").select("doc_id", digest("text").alias("f"))
    return docs.select("doc_id", "f.*")


ORACLE: dict[str, str] = {}
