"""Quality rules: counts of each text, and an n-gram language model with perplexity bands for each language.

The model is a modified Kneser-Ney model of a text's characters, its words with one space between them, so
n-grams cross from word to word and the order of words counts. There is one model for all languages, so that a
passage in another language than the document's is no surprise to it. Spark counts the n-grams of all documents
(within a task first, then the sums over all tasks), continuation counts and back-off weights come from these counts by joins, discounts from five sums for
each order, and the probabilities end in a trie of sorted arrays, one level for each order: an n-gram's key is
the place of its first n - 1 characters in the level before and its last character, so n-grams are told apart
exactly, however many there are, and one that never occurred is never found. The arrays take 16 bytes an n-gram.
Up to MODEL_BYTES they are broadcast; beyond that they stay in files that Spark brings to each node's disk, where
the workers map them, so neither the driver's nor a worker's memory bounds the model.

A document has two scores, the logarithms of its perplexity for a word and for a character. Each language has a
band for either, around the median score, whose lower and upper widths are multiples of the median distance from
it among documents that pass the base rules; that distance is kept above a floor, and the band widens for short
texts. Documents outside a band are rejected.

Nulls and odd rows: a null text has no words and fails the base rules. A null language is one of its own. Rows
are judged each by themselves, so ties and repeated rows have equal results (they count twice in the model).
An empty table gives an empty result. Whole texts are counted, of any length.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, kept_in_worker, table, written
from .words import block_windows, mixed, windows, word_hashes

ORDER = 4
#: Stands before the first word of a text; no word holds it.
START = "\n"
#: Bits of a character in a key; the place of what comes before it has the rest, so 2**43 n-grams of an order.
CHAR_BITS = 21
#: Largest model that is broadcast.
MODEL_BYTES = 96 * 1024 * 1024
#: N-grams that a task holds before it passes its counts on.
HELD_GRAMS = 1_000_000
#: Scores of windows that a worker remembers.
CACHE = 1_000_000
#: Of each score: how far the band reaches below and above the median, in scaled median distances; and the least distance,
#: in units of log perplexity.
BANDS = {"score": (5.0, 5.0, 0.1), "char_score": (7.0, 3.5, 0.01)}
#: A text of n words has a band wider by the factor sqrt(1 + SHORT / n).
SHORT = 100
REPEAT_WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
#: Characters that are handled together; fewer than there are numbers for in a key, so any part of a text fits.
STEP = 50_000
#: Text bytes that are handled together.
BLOCK = 500_000


class Alphabet:
    """Numbers, from 1, of the characters met so far, and keys of the windows of `order` characters made of them."""

    def __init__(self, order: int):
        self.order, self.bits = order, 64 // order
        self.number, self.points = np.zeros(0x110000, np.uint32), np.zeros(1, np.uint32)

    def has_room(self, points: np.ndarray) -> bool:
        """Enter the characters, if there are numbers left for all of them."""
        new = np.unique(points[self.number[points] == 0])
        if len(self.points) + len(new) > 1 << self.bits:
            return False
        self.number[new] = np.arange(len(self.points), len(self.points) + len(new))
        self.points = np.concatenate((self.points, new.astype(np.uint32)))
        return True

    def keys(self, points: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Places from `first` on that follow a text's start and the space behind it, and the keys of the windows that end there; a
        window doesn't reach beyond its text's start."""
        own = self.number[points].astype(np.uint64)
        starts = points == ord(START)
        key, open_ = own[first:].copy(), ~starts[first:]
        given = np.zeros(len(key), bool)
        for back in range(1, self.order):
            at = first - back
            before = own[max(at, 0) : len(own) - back]
            start = starts[max(at, 0) : len(own) - back]
            if at < 0:
                before, start = (np.concatenate((np.zeros(-at, x.dtype), x)) for x in (before, start))
            key |= np.where(open_, before, 0) << np.uint64(self.bits * back)
            if back == 1:
                given = start
            open_ &= ~start
        at = np.flatnonzero(~starts[first:] & ~given)
        return at + first, key[at]

    def grams(self, keys: np.ndarray) -> list[str]:
        """The windows that keys stand for."""
        backs = np.arange(self.order - 1, -1, -1).astype(np.uint64) * np.uint64(self.bits)
        numbers = (keys[:, None] >> backs) & np.uint64((1 << self.bits) - 1)
        text = np.where(numbers > 0, self.points[numbers.astype(np.int64)], 0x20).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        skip = (numbers == 0).sum(axis=1).tolist()
        return [text[self.order * i + k : self.order * i + self.order] for i, k in enumerate(skip)]


def streams(words: list[list[bytes]]) -> np.ndarray:
    """The characters of texts that have words, end to end: a start, and a space before, between and behind the words."""
    return code_points(b"".join(b"\n " + b" ".join(w) + b" " for w in words if w).decode("utf-8", "surrogatepass")).astype(np.uint32)


def slices(points: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """points in parts of at most STEP, each with what a window may reach back to; where the own part begins in it, and in all."""
    for at in range(0, len(points), STEP):
        before = max(0, at - order + 1)
        yield points[before : at + STEP], at - before, at


def merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(which, np.concatenate(times), len(found)).astype(np.int64)


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n over all documents (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("counts", dict)
        alphabet, texts, pending = Alphabet(order), 0, 0
        keys, times = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

        def flush() -> pa.RecordBatch:
            found, n = merged(keys, times)
            del keys[1:], times[1:]
            keys[0], times[0] = np.empty(0, np.uint64), np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(alphabet.grams(found), pa.string()), pa.array(n)], ["gram", "n"])

        for batch in batches:
            for raw in blocks_of_texts(batch.column(0)):
                words = [t.split() for t in raw]
                texts += sum(map(bool, words))
                for points, first, _ in slices(streams(words), order):
                    if not alphabet.has_room(points):
                        yield flush()
                        alphabet = Alphabet(order)
                        alphabet.has_room(points)
                    found, n = np.unique(alphabet.keys(points, first)[1], return_counts=True)
                    keys.append(found)
                    times.append(n)
                    pending += len(found)
                if pending > HELD_GRAMS:
                    keys[:], times[:] = ([x] for x in merged(keys, times))
                    pending = 0
                    if len(keys[0]) > HELD_GRAMS:
                        yield flush()
        yield flush()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([START + " "]), pa.array([texts], pa.int64())], ["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def blocks_of_texts(column: pa.Array) -> Iterator[list[bytes]]:
    """Texts in UTF-8 (null: empty), so many at a time that they take about BLOCK bytes."""
    out, size = [], 0
    for text in column:
        out.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(out[-1])
        if size >= BLOCK:
            yield out
            out, size = [], 0
    if out:
        yield out


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What n-grams counted once, twice and more often lose; n1 to n4: how many are counted once to four times."""
    n, out = (0, n1, n2, n3, n4), []
    for i in (1, 2, 3):
        value = i - (i + 1) * n1 / (n1 + 2 * n2) * n[i + 1] / n[i] if n1 and n[i] else 0.0
        out.append(value if 0 < value < i else 0.5 + 0.25 * (i - 1))  # else too few counts to tell
    return out


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """gamma (boolean), gram, value: interpolated probabilities of all n-grams, weights of all contexts.

    counts: gram, n, a written table. The gamma of the empty context is the probability of an unknown
    character.
    """
    levels: dict[int, DataFrame] = {order: counts.where(F.length("gram") == order).select("gram", F.col("n").alias("c"))}
    for k in range(order - 1, 0, -1):
        seen = levels[k + 1].groupBy(F.expr("substr(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
        first = counts.where((F.length("gram") == k) & F.col("gram").startswith(START)).select("gram", F.col("n").alias("c"))
        levels[k] = written(seen.union(first), "grams")
    out, lower = None, None
    for k in range(1, order + 1):
        level = levels[k]
        *ones, distinct = level.agg(*(F.count_if(F.col("c") == i) for i in range(1, 5)), F.count("*")).first()
        d1, d2, d3 = map(F.lit, discounts(*ones))
        one = level.withColumn("context", F.expr(f"substr(gram, 1, {k - 1})")).withColumn("d", F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3))
        contexts = one.groupBy("context").agg((F.sum("d") / F.sum("c")).alias("gamma"), F.sum("c").alias("total"))
        given = one.select("context", "gram", (F.col("c") - F.col("d")).alias("left")).join(contexts, "context")
        if k == 1:
            p = given.select("gram", (F.col("left") / F.col("total") + F.col("gamma") / (distinct + 1)).alias("p"))
            gamma = contexts.select("context", (F.col("gamma") / (distinct + 1)).alias("gamma"))
        else:
            p = given.withColumn("rest", F.expr("substr(gram, 2)")).join(lower, "rest").select("gram", (F.col("left") / F.col("total") + F.col("gamma") * F.col("q")).alias("p"))
            gamma = contexts.select("context", "gamma")
        p = written(p, "probabilities")
        lower = p.select(F.col("gram").alias("rest"), F.col("p").alias("q"))
        rows = p.select(F.lit(False).alias("gamma"), "gram", F.col("p").alias("value")).union(gamma.select(F.lit(True), "context", "gamma"))
        out = rows if out is None else out.union(rows)
    return out


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def keys_of(prefixes: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (prefixes.astype(np.uint64) << np.uint64(CHAR_BITS)) | points.astype(np.uint64)


class Model:
    """For each order the sorted keys of its n-grams, with their probabilities and their weights as contexts
    (NaN where there is none). The arrays are held, or named as files that Spark brings to each node."""

    KINDS = {"key": np.uint64, "p": np.float32, "gamma": np.float32}

    def __init__(self, order: int, unknown: float, arrays: dict[str, np.ndarray] | None, files: dict[str, str]):
        self.order, self.unknown, self.arrays, self.files = order, unknown, arrays, files

    def __getstate__(self) -> dict:
        return self.__dict__ | {"arrays": None if self.files else self.arrays}

    def array(self, kind: str, k: int) -> np.ndarray:
        if self.arrays is None:
            paths = {name: SparkFiles.get(file) for name, file in self.files.items()}
            self.arrays = {name: mapped(path, self.KINDS[name.split("-")[0]]) for name, path in paths.items()}
        return self.arrays[f"{kind}-{k}"]

    def scores(self, strings: list[str], given: np.ndarray) -> np.ndarray:
        """For each of the strings, none empty, the log probability of what follows its first `given` characters."""
        if not strings:
            return np.empty(0)
        points = code_points("".join(strings))
        sizes = np.array([len(x) for x in strings], np.int64)
        starts = np.cumsum(sizes) - sizes
        since = np.arange(len(points)) - np.repeat(starts, sizes)
        places = [np.zeros(len(points), np.int64)]  # for each k the place of the k-gram that ends at each position, or -1
        for k in range(1, self.order + 1):
            at = np.flatnonzero(since >= k - 1)  # the gram lies within one string
            before = places[-1][at - 1] if k > 1 else places[-1][at]
            places.append(np.full(len(points), -1, np.int64))
            places[-1][at[before >= 0]] = found(self.array("key", k), keys_of(before[before >= 0], points[at[before >= 0]]))
        p, weight = np.ones(len(points)), np.ones(len(points))
        open_ = np.flatnonzero(since >= np.repeat(given, sizes))
        for k in range(self.order, 0, -1):
            fits = since[open_] >= k - 1
            at = open_[fits]
            own = valued(self.array("p", k), places[k][at])
            p[at] = weight[at] * np.nan_to_num(own, nan=1.0)
            missed = at[np.isnan(own)]
            if k > 1:
                weight[missed] *= np.nan_to_num(valued(self.array("gamma", k - 1), places[k - 1][missed - 1]), nan=1.0)
            open_ = np.sort(np.concatenate((open_[~fits], missed)))
        p[open_] = weight[open_] * self.unknown
        return np.add.reduceat(np.log(p), starts)


class Scorer:
    """Scores of texts. A character's probability depends on the window that ends with it; each window is scored once."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.alphabet = Alphabet(self.model.order)
        self.known, self.of_known = np.empty(0, np.uint64), np.empty(0)

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, keys)
        missed = np.ones(len(keys), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] != keys
        if missed.any():
            new = np.unique(keys[missed])
            grams = self.alphabet.grams(new)
            place = np.searchsorted(self.known, new)
            self.of_known = np.insert(self.of_known, place, self.model.scores(grams, np.array([len(g) - 1 for g in grams])))
            self.known = np.insert(self.known, place, new)
            at = np.searchsorted(self.known, keys)
        return self.of_known[at]

    def __call__(self, words: list[list[bytes]]) -> np.ndarray:
        """log p of the words of each text, and of the spaces behind them."""
        out = np.zeros(len(words))
        full = np.flatnonzero([bool(w) for w in words])
        all_points = streams(words)
        text = np.cumsum(all_points == ord(START)) - 1
        for points, first, at in slices(all_points, self.model.order):
            if len(self.known) > CACHE or not self.alphabet.has_room(points):
                self.forget()
                self.alphabet.has_room(points)
            places, keys = self.alphabet.keys(points, first)
            np.add.at(out, full[text[places - first + at]], self.of_keys(keys))  # one after the other, whatever stands beside a text
        return out


def mapped(path: str, kind: type) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)


def found(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys among the sorted known ones; -1 where there is none."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def valued(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Values at the places; NaN where there is none."""
    if not len(values):
        return np.full(len(places), np.nan)
    return np.where(places >= 0, values[np.maximum(places, 0)].astype(float), np.nan)


def trained(docs: DataFrame, order: int = ORDER, max_broadcast: int = MODEL_BYTES) -> Model:
    """The model of docs (text). Spark sorts the n-grams and the driver appends them to files, a partition at a time
    if there are many."""
    table_ = kneser_ney(written(gram_counts(docs, order), "gram-counts"), order)
    values = [F.max(F.when(F.col("gamma") == gamma, F.col("value"))).cast("float").alias(name) for gamma, name in ((False, "p"), (True, "gamma"))]
    grams = written(table_.groupBy("gram").agg(*values), "model")  # a gram has one value of each kind at most
    small = 16 * grams.count() <= max_broadcast

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            p, gamma = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float32) for i in (2, 3))  # null becomes NaN
            cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)] if len(lengths) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                points = code_points("".join(batch.column(1)[lo:hi].to_pylist())).astype(np.uint32) if lengths[lo] else np.empty(0, np.uint32)
                columns = [[int(lengths[lo])], [points.tobytes()], [p[lo:hi].tobytes()], [gamma[lo:hi].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 3], strict=True)], ["k", "points", "p", "gamma"])

    # Spark orders strings by their UTF-8 bytes, which is by code points, so keys come in ascending order
    rows = grams.select(F.length("gram").alias("k"), "gram", "p", "gamma").orderBy("k", "gram").mapInArrow(packed, "k int, points binary, p binary, gamma binary")
    top, unknown = os.path.realpath(tempfile.mkdtemp(prefix="loomlog-model-")), 1e-6
    tag, names = uuid.uuid4().hex, [f"{kind}-{k}" for k in range(1, order + 1) for kind in Model.KINDS]
    path = {name: f"{top}/{tag}-{name}" for name in names}
    for name in names:
        open(path[name], "wb").close()
    levels: dict[int, np.ndarray] = {}
    for r in rows.collect() if small else rows.toLocalIterator():
        if not r["k"]:
            unknown = float(np.frombuffer(r["gamma"], np.float32)[0])
            continue
        points = np.frombuffer(r["points"], np.uint32).reshape(-1, r["k"])
        place = np.zeros(len(points), np.int64)
        for k in range(1, r["k"]):  # the levels before are whole
            if k not in levels:
                levels[k] = mapped(path[f"key-{k}"], np.uint64)
            place = found(levels[k], keys_of(place, points[:, k - 1]))
        for kind, part in (("key", keys_of(place, points[:, -1]).tobytes()), ("p", r["p"]), ("gamma", r["gamma"])):
            with open(path[f"{kind}-{r['k']}"], "ab") as f:
                f.write(part)
    levels.clear()
    if small:
        arrays = {name: np.fromfile(path[name], Model.KINDS[name.split("-")[0]]) for name in names}
        shutil.rmtree(top)
        return Model(order, unknown, arrays, {})
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    for name in names:
        docs.sparkSession.sparkContext.addFile(path[name])
    return Model(order, unknown, None, {name: f"{tag}-{name}" for name in names})


MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, char_score double"


def measured(docs: DataFrame, model: Model) -> DataFrame:
    """MEASURES of docs (doc_id, text, lang); score, char_score: log of the perplexity for a word, and for a character; null without words."""
    shared, tag = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker(f"scores {tag}", lambda: Scorer(shared.value))
        for batch in batches:
            ids, langs, at = batch.column(0), [x or "" for x in batch.column(2).to_pylist()], 0
            for raw in blocks_of_texts(batch.column(1)):
                words = [t.split() for t in raw]
                counts = np.array([len(w) for w in words], np.int64)
                sums = scorer(words)
                spaces = [len(t) - len(t.translate(None, SPACE)) for t in raw]
                chars = [len(t.as_py() or "") for t in batch.column(1)[at : at + len(raw)]]
                lines = [[x for x in t.split(b"\n") if x.strip()] for t in raw]
                columns = [
                    ids[at : at + len(raw)],
                    langs[at : at + len(raw)],
                    counts.tolist(),
                    [c - s for c, s in zip(chars, spaces, strict=True)],
                    [len(t) - len(t.translate(None, SYMBOLS)) for t in raw],
                    [len(x) - len(set(x)) for x in lines],
                    repeated_words(words).tolist(),
                    [-x / n if n else None for x, n in zip(sums.tolist(), counts.tolist(), strict=True)],
                    [-x / (n + c - s) if n else None for x, n, c, s in zip(sums.tolist(), counts.tolist(), chars, spaces, strict=True)],
                ]
                at += len(raw)
                types = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in MEASURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(measure, MEASURES)


def repeated_words(words: list[list[bytes]], size: int = REPEAT_WINDOW) -> np.ndarray:
    """For each text, how many of its words are in windows that it holds twice or more."""
    counts = np.array([len(w) for w in words], np.int64)
    starts = block_windows(counts, size)
    ends = np.cumsum(counts)
    covered = np.zeros(int(counts.sum()) + 1, np.int32)
    if len(starts):
        h = windows(word_hashes([x for w in words for x in w]), size)[starts]
        h = mixed(h + np.searchsorted(ends, starts, "right").astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))  # texts apart
        _, where, times = np.unique(h, return_inverse=True, return_counts=True)
        again = starts[times[where] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + size, -1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(covered)[:-1] > 0)))
    return total[ends] - total[ends - counts]


def bands(measures: DataFrame, of: dict[str, tuple[float, float, float]] = BANDS) -> DataFrame:
    """band_lang and for each score its median, and how far the band reaches below and above, in each language: from documents
    that pass the base rules."""
    good = measures.where("NOT base_failed AND score IS NOT NULL")
    middle = good.groupBy(F.col("lang").alias("band_lang")).agg(*(F.percentile_approx(x, 0.5, 10_000).alias(f"{x}_middle") for x in of))
    distances = (F.percentile_approx(F.abs(F.col(x) - F.col(f"{x}_middle")), 0.5, 10_000).alias(f"{x}_distance") for x in of)
    spread = joined_small(good, middle).groupBy("band_lang", *(f"{x}_middle" for x in of)).agg(*distances)
    reach = {x: F.greatest(F.lit(floor), 1.4826 * F.col(f"{x}_distance")) for x, (_, _, floor) in of.items()}
    return spread.select("band_lang", *(f"{x}_middle" for x in of), *((times * reach[x]).alias(f"{x}_{side}") for x, (*both, _) in of.items() for side, times in zip(("below", "above"), both, strict=True)))


def joined_small(rows: DataFrame, by_lang: DataFrame) -> DataFrame:
    """rows with their language's row, which travels to them while all of those are small."""
    by_lang = written(by_lang, "languages")
    small = 64 * by_lang.count() <= BROADCAST_BYTES
    return rows.join(F.broadcast(by_lang) if small else by_lang, F.col("lang") == F.col("band_lang"), "left")


def judged(docs: DataFrame, of: dict[str, tuple[float, float, float]] = BANDS) -> DataFrame:
    """MEASURES, base_failed and kept: a row per row of docs (doc_id, text, lang)."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    measures = written(measured(docs, trained(docs)).withColumn("base_failed", base), "measures")
    found = bands(measures, of)
    within, wider = F.lit(True), F.sqrt(1 + SHORT / F.greatest(F.col("n_words"), F.lit(1)))
    for x in of:
        away = F.col(x) - F.col(f"{x}_middle")
        within = within & F.coalesce((away >= -wider * F.col(f"{x}_below")) & (away <= wider * F.col(f"{x}_above")), F.lit(True))
    return joined_small(measures, found).withColumn("kept", ~F.col("base_failed") & within).drop(*found.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands over all documents."""
    return judged(table(spark, sf_dir, "documents")).drop("lang", *BANDS)


ORACLE: dict[str, str] = {}
