"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations alone.

The index holds a posting (term, doc_id, text_key, position) for every word of every document. It is written
once, in the order of the documents, so building it shuffles nothing; it answers any benchmark, and exact
phrases as well as proximity. Phrases are windows of item words (10 by default; an item of fewer words is one
phrase). The index gives the frequencies of the phrases' terms. Then each phrase's lists, one for each of its
words, are shifted by the words' offsets and intersected from the rarest on: first the FIRST rarest ones, and
what is in both of these is looked up in the lists of all the other words, of which only postings of documents
that are still candidates are read on. A start that is in all lists is an exact occurrence.

Words are ASCII-lower-cased runs of characters other than ASCII ones outside 0-9 and a-z. The terms and lists
of items travel to the index while they take at most BROADCAST_BYTES; beyond that they are taken in blocks of
that size, a pass each. So neither the text nor the index is shuffled, only postings of rare terms and of
candidate documents are, and keys always hold the document, which spreads a passage that a third of all documents
share.

Nulls and odd rows: a null or empty text has no words and isn't hit; items without words have no phrases. Rows
that share a doc_id are told apart in the index (text_key is a hash of the text), so a phrase lies within one of
them; they share their hits. Items that share an item_id are one item with the phrases of all of them. A null doc_id or item_id
is a value like others (a null item_id isn't listed in the digest). Empty tables give no hits. Phrases that several
items have count for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, table, written

PHRASE = 10
#: Lists of a phrase, the rarest, that are intersected before the others are read.
FIRST = 2
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Words in order; an empty string may stand first and last, and is never a word of a phrase."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), DELIMITERS)


def word_count(text: Column) -> Column:
    """Number of words; the case of letters makes no difference to it."""
    parts = F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.coalesce(F.size(parts) - edges, F.lit(0)).cast("long")


def phrases(items: DataFrame, size: int = PHRASE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, phrase (array of words): distinct windows of the items' words."""
    words = items.select(F.col(item_id).alias("item_id"), F.filter(terms(F.col(text)), lambda w: w != "").alias("words")).where("size(words) > 0")
    starts = words.withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (size - 1)))))
    return starts.select("item_id", F.slice("words", F.col("start"), F.lit(size)).alias("phrase")).distinct()


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, text_key, position (from 0): every word of docs (doc_id, text)."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), terms(F.col("text")).alias("words"))
    words = words.withColumn("words", F.when(F.get("words", F.lit(0)) == "", F.slice("words", F.lit(2), F.size("words"))).otherwise(F.col("words")))
    return words.select("doc_id", "text_key", F.posexplode("words").alias("position", "term")).where("term <> ''")


def indexed(docs: DataFrame) -> DataFrame:
    """The positional index of docs, written to the shared folder."""
    return written(postings(docs), "index")


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.text_key == b.text_key)


def blocks_of(df: DataFrame, column: str, max_bytes: int) -> list[DataFrame]:
    """df, a written table, whole if it takes at most max_bytes, else cut by a hash of the column into blocks that do."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32)).first()[0] or 0
    n = -(-size // max_bytes) if size else 1
    return [df if n == 1 else df.where(F.pmod(F.xxhash64(column), F.lit(n)) == k) for k in range(n)]


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def term_counts(index: DataFrame, vocabulary: DataFrame, max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """term, n: postings of the terms of a written table (0 where there are none)."""

    def counted(part: DataFrame) -> DataFrame:
        found = index.select("term").join(F.broadcast(part), "term").groupBy("term").agg(F.count("*").alias("n"))
        return part.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))

    return united([counted(part) for part in blocks_of(vocabulary, "term", max_broadcast)])


def ranked_lists(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """phrase_id, of, term, offset (from 0), nr: a list for each word of each phrase, the rarest term's first."""
    at = windows.select("phrase_id", F.size("phrase").alias("of"), F.posexplode("phrase").alias("offset", "term")).join(counts, "term")
    return at.select("phrase_id", "of", "term", "offset", F.row_number().over(Window.partitionBy("phrase_id").orderBy("n", "offset")).alias("nr"))


def intersected(index: DataFrame, lists: DataFrame) -> DataFrame:
    """doc_id, text_key, phrase_id, of, start: where the first lists of a phrase meet, shifted by their offsets."""
    start = F.col("position") - F.col("offset")
    at = index.join(F.broadcast(lists.where(F.col("nr") <= FIRST)), "term").select("doc_id", "text_key", "phrase_id", "of", start.alias("start"), F.expr("shiftleft(1, nr - 1)").alias("seen"))
    met = at.groupBy("doc_id", "text_key", "phrase_id", "of", "start").agg(F.bit_or("seen").alias("seen"))
    return met.where(F.bit_count("seen") == F.least(F.lit(FIRST), F.col("of"))).drop("seen")


def of_candidates(index: DataFrame, candidates: DataFrame, vocabulary: DataFrame, max_broadcast: int) -> DataFrame:
    """The distinct postings of documents of candidates (a written table), of the vocabulary's terms if that is small."""
    found = written(candidates.select("doc_id", "text_key").distinct(), "candidate-documents")
    there = index.join(F.broadcast(vocabulary), "term", "left_semi") if len(blocks_of(vocabulary, "term", max_broadcast)) == 1 else index
    small = 40 * found.count() <= max_broadcast
    there = there.join(F.broadcast(found) if small else found.hint("shuffle_merge"), same_document(there, found), "left_semi")
    return there.distinct()


def find_phrases(index: DataFrame, windows: DataFrame, max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_key, phrase_id, start, of: every exact occurrence of phrases (phrase_id, phrase) in an index."""
    windows = written(windows, "phrases")
    vocabulary = written(windows.select(F.explode("phrase").alias("term")).distinct(), "vocabulary")
    counts = written(term_counts(index, vocabulary, max_broadcast), "term-counts")
    lists = written(ranked_lists(windows, counts), "lists")
    out = []
    # all lists of a phrase are in one block
    for part in blocks_of(lists, "phrase_id", max_broadcast):
        candidates = written(intersected(index, part), "candidates")
        there = of_candidates(index, candidates.where(F.col("of") > FIRST), vocabulary, max_broadcast)
        rest = F.broadcast(part.where(F.col("nr") > FIRST).select(F.col("phrase_id").alias("id"), F.col("term").alias("word"), "offset"))
        wanted = candidates.join(rest, F.col("phrase_id") == F.col("id")).withColumn("place", F.col("start") + F.col("offset"))
        met = wanted.join(there, same_document(wanted, there) & (wanted.word == there.term) & (wanted.place == there.position))
        met = met.groupBy(wanted.doc_id, wanted.text_key, "phrase_id", "start", "of").agg(F.count("*").alias("n"))
        out.append(met.where(F.col("n") == F.col("of") - FIRST).drop("n"))
        out.append(candidates.where(F.col("of") <= FIRST).select("doc_id", "text_key", "phrase_id", "start", "of"))
    return united(out)


def proximity(index: DataFrame, queries: DataFrame, slop: int, max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, doc_id, start: documents of an index with all the distinct terms of a query (query_id, text) within `slop` words.

    start is the position of a posting of the query's rarest term around which, at most slop - 1 words away,
    the others occur within one stretch of slop words. Positions count from the first word, 0. Rows that share a
    doc_id share their hits here.
    """
    wanted = queries.select("query_id", F.array_distinct(F.filter(terms(F.col("text")), lambda w: w != "")).alias("terms")).where("size(terms) > 0")
    wanted = written(wanted, "proximity")
    vocabulary = written(wanted.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    counts = written(term_counts(index, vocabulary, max_broadcast), "term-counts")
    lists = written(ranked_lists(wanted.select(F.col("query_id").alias("phrase_id"), F.col("terms").alias("phrase")), counts), "lists")
    out = []
    for part in blocks_of(lists, "phrase_id", max_broadcast):
        part = part.select(F.col("phrase_id").alias("query_id"), "of", F.col("term").alias("word"), "nr")
        rarest = index.join(F.broadcast(part.where("nr = 1")), F.col("term") == F.col("word"))
        found = written(rarest.select("doc_id", "text_key", "query_id", "of", F.col("position").alias("start")).distinct(), "candidates")
        there = of_candidates(index, found, vocabulary, max_broadcast)
        # all postings of a query's terms near each candidate, by stretches of slop words
        near = there.join(F.broadcast(part), F.col("term") == F.col("word")).withColumn("bin", F.floor(F.col("position") / slop))
        around = found.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - slop + 1) / slop), F.floor((F.col("start") + slop - 1) / slop))))
        both = around.join(near, same_document(around, near) & (around.query_id == near.query_id) & (around.bin == near.bin) & (F.abs(near.position - around.start) < slop))
        met = both.groupBy(around.doc_id, around.text_key, around.query_id, around.of, "start").agg(F.collect_set(F.struct("position", "nr")).alias("places"))
        stretch = lambda p: F.size(F.array_distinct(F.transform(F.filter("places", lambda q: (q.position >= p.position) & (q.position < p.position + slop)), lambda q: q.nr)))
        holds = F.exists("places", lambda p: (p.position <= F.col("start")) & (p.position + slop > F.col("start")) & (stretch(p) == F.col("of")))
        out.append(met.where(holds).select("query_id", "doc_id", "start"))
    return united(out).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = PHRASE, index: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row per row of docs (doc_id, text), for items
    (item_id, text). index: the documents' index, if there is one already."""
    docs = docs.select("doc_id", "text")
    owned = written(phrases(items, size).withColumn("phrase_id", F.unhex(F.md5(F.array_join("phrase", " ")))), "item-phrases")
    places = written(find_phrases(indexed(docs) if index is None else index, owned.select("phrase_id", "phrase").distinct()), "places")
    # words under any occurrence: each adds what reaches beyond all before it
    ends = F.max(F.col("start") + F.col("of")).over(Window.partitionBy("doc_id").orderBy("start", "of").rowsBetween(Window.unboundedPreceding, -1))
    spans = places.select("doc_id", "start", "of").distinct().withColumn("reached", F.coalesce(ends, F.lit(-1)))
    hit = spans.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("of") - F.greatest("start", "reached"))).cast("long").alias("n_hit"))
    of_items = places.select("doc_id", "phrase_id").distinct().join(owned.select("phrase_id", "item_id"), "phrase_id").select("doc_id", "item_id").distinct()
    listed = of_items.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))
    found = hit.withColumnRenamed("doc_id", "hit_id").join(listed.withColumnRenamed("doc_id", "list_id"), F.col("hit_id").eqNullSafe(F.col("list_id")))
    words = docs.select("doc_id", word_count(F.col("text")).alias("n_words"))
    out = words.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = {
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
g AS (SELECT DISTINCT item_id, len(words[i:i + 9]) AS n, array_to_string(words[i:i + 9], ' ') AS key FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)),
l AS (SELECT DISTINCT n FROM g),
o AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, l WHERE len(words) >= n)),
h AS (SELECT o.doc_id, g.item_id, o.i, o.n FROM o JOIN g ON g.n = o.n AND g.key = o.key),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items, sha256(coalesce(s.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
""",
}
