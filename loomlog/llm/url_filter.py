"""URL filters: rules indexed by their rarest literal token.

A URL is split into tokens (runs of ASCII letters and digits, lower-cased). Every rule knows tokens
that each URL it fits must hold; it is filed under the one that fewest URLs of the table hold. A URL's
tokens fetch candidate rules, and only those run their regular expression. Rules without a literal
token are tried on every URL.

Nulls and odd rows: a null url, or one without ``://``, has an empty host and path, fits no host rule
and is allowed. Repeated rows and ties in page_id are judged each by itself, since nothing is grouped
by them. An empty table gives an empty result. Rules of equal length tie by their text, smallest first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, fresh, table

TOKEN = re.compile(r"[a-z0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """name: as written; action: block or allow; pattern: matched against host + NUL + path;
    tokens: literals of which every fitting URL holds each as a whole token; by_host: a (host, path) rule,
    which goes before the patterns, the longest first."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    by_host: bool


def host_rule(name: str, action: str) -> Rule:
    """A rule such as ``example.net/en/``: its host and all subdomains, paths that start with its path."""
    host, slash, rest = name.partition("/")
    host, path = host.translate(LOWER), slash + rest
    tokens = TOKEN.findall(host)
    # the last token of a path prefix may go on in the URL, unless a delimiter ends it
    found = list(TOKEN.finditer(path.translate(LOWER)))
    tokens += [m[0] for m in found if m.end() < len(path) and m.start() > 0]
    return Rule(name, action, rf"(?:^|\.){re.escape(host)}\x00{re.escape(path)}", tuple(tokens), True)


def label_rule(words: str, action: str = "block") -> Rule:
    """A host label that is these hyphenated words, or starts or ends with them between hyphens."""
    return Rule(words, action, rf"(?:^|[.-]){re.escape(words)}(?:[.-]|\x00)", tuple(TOKEN.findall(words)), False)


#: The rules that the query fixes.
HOST_RULES = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]
#: The method's own verdict on URLs that no host rule fits: labels of hosts that sell or cheat.
LABELS = ["casino", "casino-win", "cheap-pills", "spam-farm", "poker", "betting", "porn", "xxx", "viagra", "warez"]
PATTERN_RULES = [label_rule(x) for x in LABELS]


def parts(df: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Add the host (ASCII lower-cased) and path of a url column; both empty for null or no ``://``."""
    (name,) = fresh(df, "_rest")
    u, rest = F.col(url), F.col(name)
    lower = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    return df.withColumn(name, F.coalesce(cut, F.lit(""))).withColumns({host: lower, path: F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}).drop(name)


def token_counts(df: DataFrame, host: str, path: str, tokens: set[str], max_broadcast: int = BROADCAST_BYTES) -> dict[str, int]:
    """In how many rows each of the rules' tokens occurs; other tokens are not counted, so the result is as small as the rules.

    The tokens travel to the rows, in blocks of at most max_broadcast, and are counted within tasks first, so a
    token that a third of all rows have is a row a task."""
    spark = df.sparkSession
    blocks: list[list[str]] = [[]]
    size = 0
    for t in sorted(tokens):
        if size + len(t) + 64 > max_broadcast and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(t)
        size += len(t) + 64
    found = df.select(F.explode(F.array_distinct(F.split(F.lower(F.concat_ws("/", host, path)), "[^a-z0-9]+"))).alias("token"))
    out: dict[str, int] = {}
    for block in blocks:
        wanted = spark.createDataFrame([(t,) for t in block], "token string")
        out |= {r["token"]: r["n"] for r in found.join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    return out


class Index:
    """Rules by their rarest token. fits() tries the candidates of a URL only."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[tuple, Rule, re.Pattern]]] = {}
        self.always: list[tuple[tuple, Rule, re.Pattern]] = []
        for r in rules:
            # the best of several: host rules first, then the longest, then the smallest text
            entry = ((not r.by_host, -len(r.name), r.name, r.action), r, re.compile(r.pattern))
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def fits(self, host: str, path: str) -> tuple[tuple, Rule] | None:
        subject = f"{host}\x00{path}"
        best = None
        candidates = [self.always, *(self.by_token[t] for t in set(TOKEN.findall(subject.translate(LOWER))) if t in self.by_token)]
        for entry in (e for c in candidates for e in c):
            if (best is None or entry[0] < best[0]) and entry[2].search(subject):
                best = entry[:2]
        return best


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of df, then host, path, rule and verdict (prefixed by _ where the names are taken).

    rule is the (host, path) rule that fits best, else null; verdict is that rule's action, else that of the
    first pattern rule that fits, else default. Only the rules' token counts are shuffled, a row for a token and
    task: the index travels to the rows while its size, checked here, is at most max_broadcast. Larger rule lists are taken in blocks of that size, one pass
    over the rows each, that carry the best rule so far.
    """
    host, path, rule, verdict = fresh(df, "host", "path", "rule", "verdict")
    sizes = [2 * len(r.name) + len(r.pattern) + 400 for r in rules]
    blocks: list[list[Rule]] = [[]]
    room = max_broadcast
    for r, size in zip(rules, sizes, strict=True):
        if size > room and blocks[-1]:
            blocks.append([])
            room = max_broadcast
        blocks[-1].append(r)
        room -= size
    out = parts(df, url, host, path)
    order, action = fresh(out, "_order", "_action")
    counts = token_counts(out, host, path, {t for r in rules for t in r.tokens}, max_broadcast)
    none = F.lit(None).cast("string")
    out = out.withColumns({order: none, rule: none, action: none})
    names = out.columns
    for block in blocks:
        index = df.sparkSession.sparkContext.broadcast(Index(block, counts))

        def judge(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                best = [(o, r, a) for o, r, a in zip(pdf[order], pdf[rule], pdf[action], strict=True)]
                for i, (h, p) in enumerate(zip(pdf[host], pdf[path], strict=True)):
                    if found := index.value.fits(h, p):
                        key, r = found
                        text = f"{int(key[0])}{10**9 + key[1]:010d}{key[2]}"
                        if best[i][0] is None or text < best[i][0]:
                            best[i] = (text, r.name if r.by_host else None, r.action)
                pdf[order], pdf[rule], pdf[action] = (pd.Series([b[k] for b in best], index=pdf.index, dtype=object) for k in range(3))
                yield pdf[names]

        out = out.mapInPandas(judge, T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema]))
    return out.withColumn(verdict, F.coalesce(F.col(action), F.lit(default))).drop(order, action)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the fixed host rules and the label patterns."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), HOST_RULES + PATTERN_RULES).select("page_id", "host", "path", "rule", "verdict")


_LABEL_SQL = "|".join(LABELS)
ORACLE = {
    "op1_url_filter": rf"""
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|[.-])({_LABEL_SQL})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM c
""",
}
