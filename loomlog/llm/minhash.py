"""MinHash near-duplicates with min-max hashing.

Under each of 64 permutations a document keeps both the least and the greatest hash of its shingles, so 128
signature values cost 64 evaluations a shingle. Both match with probability J (the Jaccard similarity), and
as they vary against each other the estimate has less variance than 128 independent ones. 32 bands of 4
values, each from 4 permutations, make candidates: a pair at J = 0.75 shares no band with probability 5e-6.

Documents with one shingle set are one class. Within a band's bucket classes are not paired with each
other: each is compared with the bucket's least one, links are confirmed on full sets of shingles, and
components follow. A bucket in one component is done, as no further link could change components. In the
others comparisons across components are still open: small buckets make them as pairs; of large ones all
classes outside the bucket's largest component are a query set, which goes to the bucket's classes in blocks
of bounded size and is compared by an inverted index of its shingles, without a row for a pair. So no link that
the bands find is lost to a cap, and groups of thousands of copies cost one comparison each.

Nulls and odd rows: a null text, or one without words, has an empty set and is linked with nothing; its
component is its own doc_id. Rows that share a doc_id are one node with the links of all their texts, each with
its own n_shingles. A null doc_id has a null component and is kept. An empty table gives an empty result. Whole
texts count, of any length.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, by_ids, kept_in_worker, table, written
from .components import components
from .words import block_windows, mixed, windows, word_hashes

SHINGLE = 5
PERMUTATIONS, BANDS, ROWS = 64, 32, 4
#: Words that are hashed together, so that NumPy's arrays stay in the cache.
BLOCK_WORDS = 20_000
#: Buckets of up to so many classes compare all pairs across components.
SMALL_BUCKET = 24


def shingle_hashes(texts: list[bytes | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of documents end to end, and their number in each (duplicates included).
    A document of fewer words, but not none, has its whole sequence as its one shingle."""
    words = [(t or b"").lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    h = word_hashes([x for w in words for x in w])
    starts = block_windows(counts, k)
    out, numbers = windows(h, k)[starts] if len(h) >= k else np.empty(0, np.uint64), np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        at, ends = np.cumsum(numbers)[short], np.cumsum(counts)
        extra = np.array([windows(h[ends[i] - counts[i] : ends[i]], int(counts[i]))[0] for i in short], np.uint64)
        out, numbers = np.insert(out, at, extra), numbers + ((counts > 0) & (counts < k))
    return out, numbers


def permutation(h: np.ndarray, i: int) -> np.ndarray:
    a, b = (int.from_bytes(hashlib.blake2b(f"{i} {x}".encode(), digest_size=8).digest(), "little") for x in "ab")
    out = h ^ np.uint64(b)
    out *= np.uint64(a | 1)
    out ^= out >> np.uint64(29)
    return out


def band_keys(h: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """BANDS keys (int64) of each of the documents, all of which have shingles."""
    starts = np.cumsum(numbers) - numbers
    least, greatest = (np.empty((PERMUTATIONS, len(numbers)), np.uint64) for _ in range(2))
    for i in range(PERMUTATIONS):
        p = permutation(h, i)
        least[i], greatest[i] = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
    keys = np.empty((len(numbers), BANDS), np.uint64)
    half = BANDS // 2
    for j in range(BANDS):
        # bands of greatest values take other permutations together than those of least values
        rows = [(least, r) for r in range(j * ROWS, j * ROWS + ROWS)] if j < half else [(greatest, (j - half) + half * r) for r in range(ROWS)]
        key = np.full(len(numbers), j + 1, np.uint64)
        for values, r in rows:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[r])
        keys[:, j] = key
    return keys.view(np.int64)


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_key (binary, null without shingles) and bands of docs (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("signatures", dict)  # lets go of what another operator has kept
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                block: list[bytes | None] = []
                size = 0
                while at < len(batch) and size < 6 * BLOCK_WORDS:
                    block.append(None if (t := texts[at].as_py()) is None else t.encode("utf-8", "surrogatepass"))
                    size += len(block[-1] or b"")
                    at += 1
                h, numbers = shingle_hashes(block, k)
                full = np.flatnonzero(numbers)
                bands: list[np.ndarray | None] = [None] * len(block)
                keys: list[bytes | None] = [None] * len(block)
                distinct = np.zeros(len(block), np.int64)
                if len(full):
                    for i, row in zip(full, band_keys(h, numbers[full]), strict=True):
                        bands[i] = row
                    ends = np.cumsum(numbers)
                    for i in full:
                        own = np.unique(h[ends[i] - numbers[i] : ends[i]])
                        distinct[i], keys[i] = len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([ids[at - len(block) : at], pa.array(distinct), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def similar(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (u, v) those with 100 * |intersection| >= percent * |union| of their full shingle sets; texts: doc_id, text."""
    with_u = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    with_both = with_u.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, set] = OrderedDict()

        def shingles(text: str) -> set:
            if text not in known:
                w = text.encode("utf-8", "surrogatepass").lower().split()
                known[text] = {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
                if len(known) > 64:
                    known.popitem(last=False)
            known.move_to_end(text)
            return known[text]

        for batch in batches:
            us, vs = [], []
            for u, v, a, b in zip(*(batch.column(i) for i in range(4)), strict=True):
                u, v = u.as_py(), v.as_py()
                x, y = shingles(a.as_py()), shingles(b.as_py())
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return with_both.select("u", "v", "text_u", "text_v").mapInArrow(confirm, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs (doc_id, text)."""
    rows = written(signatures(docs, k), "signatures")
    keyed = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(keyed.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    own = keyed.join(classes, (keyed.set_key == classes.set_key) & (keyed.doc_id == classes.rep)).select("rep", F.col("n_shingles").alias("n"), "bands", keyed.set_key).dropDuplicates(["set_key"]).drop("set_key")
    entries = own.select(F.explode("bands").alias("band"), "rep", "n")
    # written before it is joined, so that Spark can split a large bucket's classes over several tasks
    shared = written(entries.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("pivot"), F.count("*").alias("size")).where("size > 1").select("band", "pivot"), "pivots")
    members = written(entries.join(shared, "band"), "members")
    wanted = written(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    texts = written(by_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted).where("text IS NOT NULL"), "texts")
    # a doc_id that isn't the least of its class: to the class
    same = keyed.join(classes, "set_key").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = links_of_classes(members, texts, k, percent)
    found = components(links.union(same))
    out = rows.join(found, rows.doc_id == found.node, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def links_of_classes(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) of classes that share a band, enough of them for the components of all such links.

    members: band, rep, n (size of the set), pivot (struct of rep and n)."""
    close = f"{percent} * greatest(a, b) <= 100 * least(a, b)"  # else the sizes alone rule a link out
    first = members.select(F.col("rep").alias("u"), F.col("pivot.rep").alias("v"), F.col("n").alias("a"), F.col("pivot.n").alias("b"))
    tried = written(first.where(f"u <> v AND {close}").select("u", "v").distinct(), "pairs")
    links = written(similar(tried, texts, k, percent), "links")
    found = components(links)
    now = members.where("rep <> pivot.rep").join(found, F.col("rep") == found.node, "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("label"))
    labels = written(now, "labels")
    mixed_bands = labels.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("band", "size")
    mixed_bands = written(mixed_bands, "mixed-bands")
    left = written(labels.join(mixed_bands, "band"), "mixed")
    small, large = left.where(F.col("size") <= SMALL_BUCKET), left.where(F.col("size") > SMALL_BUCKET)
    others = small.select("band", F.col("rep").alias("v"), F.col("n").alias("b"), F.col("label").alias("label_v"))
    pairs = small.withColumnRenamed("n", "a").join(others, "band").where(f"rep > v AND label <> label_v AND {close}")
    more = similar(written(pairs.select(F.col("rep").alias("u"), "v").distinct(), "pairs"), texts, k, percent)
    if not large.isEmpty():
        more = more.union(similar(written(across(large, texts, k, percent), "pairs"), texts, k, percent))
    return written(links.union(more), "links")


def across(large: DataFrame, texts: DataFrame, k: int, percent: int, max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """Links (u, v) of classes of different components that share a bucket, at least one for each class u outside
    the bucket's largest component and component of v. large: band, rep, n, label."""
    sizes = large.groupBy("band", "label").agg(F.count("*").alias("members"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("members", "label"))["label"].alias("main"))
    outside = large.join(largest, "band").where("label <> main").select("rep").distinct()
    rows = large.groupBy("rep").agg(F.max("label").alias("label"), F.collect_set("band").alias("bands"))
    members = written(rows.join(texts.withColumnRenamed("doc_id", "rep"), "rep"), "large")
    queries = written(members.join(outside, "rep", "left_semi"), "queries")
    total = queries.agg(F.sum(F.octet_length("text") + 400)).first()[0] or 0
    blocks, out = max(1, -(-2 * total // max_broadcast)), None
    for block in range(blocks):
        # bounded by max_broadcast, and the next block is another pass over these members
        shared = large.sparkSession.sparkContext.broadcast([tuple(r) for r in queries.where(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == block).select("rep", "label", "bands", "text").collect()])

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            reps, labels = (np.array([q[i] for q in asked], np.int64) for i in range(2))
            sets = [shingle_set(q[3], k) for q in asked]
            size = np.array([len(x) for x in sets], np.int64)
            shingles = np.concatenate([*sets, np.empty(0, np.uint64)])
            owners = np.repeat(np.arange(len(sets)), size)
            order = np.argsort(shingles, kind="stable")
            shingles, owners = shingles[order], owners[order]
            by_band: dict[int, list[int]] = {}
            for i, q in enumerate(asked):
                for band in q[2]:
                    by_band.setdefault(band, []).append(i)
            seen: set[tuple[int, int]] = set()
            for batch in batches:
                us, vs = [], []
                for rep, label, bands, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                    rep, label = rep.as_py(), label.as_py()
                    near = np.zeros(len(reps), bool)
                    for band in bands.as_py():
                        near[by_band.get(band, [])] = True
                    near &= labels != label
                    if not near.any():
                        continue
                    own = shingle_set(text.as_py(), k)
                    lo, hi = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
                    long = hi - lo
                    at = np.repeat(hi - np.cumsum(long), long) + np.arange(long.sum())
                    common = np.bincount(owners[at], minlength=len(reps))
                    for i in np.flatnonzero(near & (100 * common >= percent * (size + len(own) - common))):
                        if (int(reps[i]), label) not in seen:
                            seen.add((int(reps[i]), label))
                            us.append(int(reps[i]))
                            vs.append(rep)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        found = members.select("rep", "label", "bands", "text").mapInArrow(compare, "u long, v long")
        out = found if out is None else out.union(found)
    return out


def shingle_set(text: str, k: int) -> np.ndarray:
    return np.unique(shingle_hashes([text.encode("utf-8", "surrogatepass")], k)[0])


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = {
    "op8_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * both_ >= 75 * (a.n + b.n - both_)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.v FROM r JOIN e ON e.u = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
}
