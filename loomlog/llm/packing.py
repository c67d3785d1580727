"""Best-fit packing of tokenised documents by linear grouping.

Only the number of pieces of each length (at most as many numbers as a sequence has tokens) is brought
together, so the plan is made from a summary whose size doesn't depend on the corpus:

1. Large lengths, sorted, are cut into groups of equal cardinality (GROUPS at most), and each is rounded up to its
   group's largest. For these few sizes configurations are optimised by column generation: a linear programme over the
   configurations found so far gives each size a price, and a knapsack of the dearest sizes is the next
   configuration, until none is worth more than a sequence. Each is used as often as its part rounded down says; what
   remains, less than a sequence a size, is filled by the fullest configurations of what is left.
2. Actual lengths take the places of the rounded ones, group by group.
3. Small lengths go, largest first, to the best fitting sequences (least room that suffices), then to new ones.

Large is tried as several parts of a sequence, and so is best fit alone (no length is large), so the plan kept, with
the fewest sequences, is never worse than best fit by falling length. The plan is a list of
runs, "of length L, ranks a to b go to sequences s to s+b-a at offset o"; pieces find theirs by their rank
among those of their length, which is counted in two levels (buckets, then an offset for each), never in one
task.

Nulls and odd rows: a null text is an empty one, i.e. the final id alone. Pieces of repeated rows, or of ties
in doc_id, are packed each for itself; identical ones are interchangeable. A null doc_id is kept as null. An
empty table gives an empty result. Very long texts are tokenised whole, then cut.
"""

from __future__ import annotations

import os
import string
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from itertools import pairwise
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_in_worker, table, written

CAPACITY = 2048
#: Pieces longer than such a part of a sequence are large; with 1 none is.
LARGE = (1 / 4, 1 / 2, 1)
#: Number of groups of large pieces.
GROUPS = 64
#: Chunks that a worker remembers in both generations, besides those of the batch at hand; it changes no result.
CACHE = 400_000
#: What may stand behind a word's letters as a word of its own.
MARKS = string.punctuation
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Token ids of texts, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and its words don't cross it, so ids of stretches between spaces concatenate to
    those of the text. Of a batch of texts each distinct stretch is looked up once. Words and the marks behind them
    are remembered in two generations; what the older one alone holds goes when the newer one is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters: dict[str, bool] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def stays_letter(self, letter: str) -> bool:
        """Whether a mark behind the letter is a word of its own: not if its normal form ends with a combining mark, or
        the tokenizer doesn't take it for a letter."""
        if letter not in self.letters:
            normal = self.tokenizer.normalizer.normalize_str(letter + ".")
            self.letters[letter] = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)[-1][0] == "."
        return self.letters[letter]

    def split(self, part: str) -> tuple[str, str]:
        """Letters (lower-cased if ASCII, as the tokenizer does) and marks behind them have ids of their own."""
        if part.isalpha():
            return part.lower() if part.isascii() else part, ""
        word = part.rstrip(MARKS)
        if not word.isalpha() or not (word.isascii() or self.stays_letter(word[-1])):
            return part, ""
        return word.lower() if word.isascii() else word, part[len(word) :]

    def learn_words(self, words: list[str]) -> None:
        """Ids of words of letters alone, encoded together: each ends with its one token that ends a word."""
        for k in range(0, len(words), 2048):
            block = words[k : k + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(block):  # else there are letters that the tokenizer doesn't take for such
                raw, at = ids.tobytes(), 0
                for w, end in zip(block, (4 * ends).tolist(), strict=True):
                    self.known[w] = raw[at:end]
                    at = end

    def learn(self, chunks: set[str]) -> None:
        """Makes sure that all chunks are known."""
        if len(self.known) > CACHE // 2:
            self.older, self.known = self.known, {}
        missing = chunks.difference(self.known)
        self.known |= {x: self.older[x] for x in missing if x in self.older}
        missing.difference_update(self.known)
        self.learn_words([x for x in missing if x.isalpha()])
        rest = list(missing.difference(self.known))
        for x, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[x] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; a null has none."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        words, marks = [], []
        for part in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            word, mark = self.split(part)
            words.append(word)
            marks.append(mark)
        self.learn(set(words).union(marks))
        raw = list(map(add, map(self.known.__getitem__, words), map(self.known.__getitem__, marks)))
        index, ends = coded.indices.to_numpy(), parts.offsets.to_pylist()
        for at, end in pairwise(ends):
            yield b"".join([raw[i] for i in index[at:end].tolist()])


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of docs (doc_id, text): ids and then end_id, cut every capacity ids."""
    last = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = kept_in_worker(f"ids {path}", lambda: Ids(path))
        step = 4 * capacity
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), ids(batch.column(1)), strict=True):
                raw += last
                for k, at in enumerate(range(0, len(raw), step)):
                    rows.append((doc, k, at // 4, min(step, len(raw) - at) // 4, zlib.crc32(raw[at : at + step])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, columns), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


class Plan:
    """Runs (length, first rank, number, first sequence, offset) that put every piece into a sequence."""

    def __init__(self, counts: dict[int, int], capacity: int, part: float, groups: int = GROUPS):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.ranks: Counter[int] = Counter()
        self.room: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # room -> runs of sequences
        large = {x: n for x, n in counts.items() if x > capacity * part and n}
        self.place_large(large, groups)
        for x in sorted((x for x in counts if x not in large and counts[x]), reverse=True):
            self.place_small(x, counts[x])

    def put(self, length: int, number: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.ranks[length], number, sequence, offset))
        self.ranks[length] += number

    def new(self, number: int) -> int:
        self.sequences += number
        return self.sequences - number

    def place_large(self, counts: dict[int, int], groups: int) -> None:
        each = max(1, -(-sum(counts.values()) // groups))
        sizes: list[int] = []
        members: list[deque[list[int]]] = []
        free = 0
        for x in sorted(counts, reverse=True):
            left = counts[x]
            while left:
                if not free:
                    if not (sizes and sizes[-1] == x):
                        sizes.append(x)
                        members.append(deque())
                    free = each
                n = min(left, free)
                members[-1].append([x, n])
                free -= n
                left -= n
        demand = [sum(n for _, n in m) for m in members]
        for pattern, times in configurations(sizes, demand, self.capacity):
            self.substitute([members[k] for k, n in pattern.items() for _ in range(n)], times)

    def substitute(self, slots: list[deque[list[int]]], times: int) -> None:
        """Actual pieces into `times` sequences of one configuration, a slot after the other."""
        taken: list[list[list[int]]] = []
        for queue in slots:
            mine, left = [], times
            while left:
                n = min(left, queue[0][1])
                mine.append([queue[0][0], n])
                left -= n
                queue[0][1] -= n
                if not queue[0][1]:
                    queue.popleft()
            taken.append(mine)
        first, done = self.new(times), 0
        while done < times:
            n, offset = min(m[0][1] for m in taken), 0
            for m in taken:
                self.put(m[0][0], n, first + done, offset)
                offset += m[0][0]
                m[0][1] -= n
                if not m[0][1]:
                    m.pop(0)
            self.leave(self.capacity - offset, first + done, n)
            done += n

    def leave(self, room: int, sequence: int, number: int) -> None:
        if room and number:
            self.room[room].append((sequence, number))

    def place_small(self, length: int, count: int) -> None:
        for room in sorted(r for r in self.room if r >= length):
            while count and self.room[room]:
                count = self.fill(length, count, room, *self.room[room].popleft())
            if not self.room[room]:
                del self.room[room]
            if not count:
                return
        each = self.capacity // length
        number = -(-count // each)
        self.fill(length, count, self.capacity, self.new(number), number)

    def fill(self, length: int, count: int, room: int, sequence: int, number: int) -> int:
        """Put as many as fit into each of the sequences in turn; returns the pieces left over."""
        each = min(room // length, count)
        full = min(number, count // each)
        for k in range(each):
            self.put(length, full, sequence, self.capacity - room + k * length)
        self.leave(room - each * length, sequence, full)
        count -= full * each
        if full < number and count:
            for k in range(count):
                self.put(length, 1, sequence + full, self.capacity - room + k * length)
            self.leave(room - count * length, sequence + full, 1)
            full, count = full + 1, 0
        self.leave(room, sequence + full, number - full)
        return count


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations (group -> times) and how often each is used, that meet the demand of falling sizes exactly."""
    if not sizes:
        return []
    m, left, out = len(sizes), list(demand), []
    columns = np.diag([float(capacity // x) for x in sizes])
    need = np.array(demand, float)
    for _ in range(40 * m):
        prices = np.linalg.solve(columns.T, np.ones(m))
        worth, found = dearest(sizes, prices, capacity)
        if worth <= 1 + 1e-9:
            break
        column = np.array([found.get(k, 0) for k in range(m)], float)
        used, step = np.linalg.solve(columns, need), np.linalg.solve(columns, column)
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(ratio.argmin())] = column
    used = np.linalg.solve(columns, need)
    for j in np.argsort(-used):
        pattern = {k: int(round(n)) for k, n in enumerate(columns[:, j]) if n > 0.5}
        times = min([int(used[j] + 1e-9), *(left[k] // n for k, n in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for k, n in pattern.items():
                left[k] -= n * times
    top = 0
    while top < m:
        if not left[top]:
            top += 1
            continue
        pattern = fullest(sizes, left, top, capacity)
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
    return out


def dearest(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The configuration whose sizes' prices add up to most, by dynamic programming over the room."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k, (size, price) in enumerate(zip(sizes, prices, strict=True)):
        if price > 1e-12:
            for at in range(size, capacity + 1, size):  # a stretch of room at a time builds on the one before
                here, before = slice(at, min(at + size, capacity + 1)), slice(at - size, min(at, capacity + 1 - size))
                more = best[before] + price > best[here] + 1e-12
                best[here] = np.where(more, best[before] + price, best[here])
                last[here] = np.where(more, k, last[here])
    at = int(best.argmax())
    worth, out = float(best[at]), Counter()
    while at and last[at] >= 0:
        out[int(last[at])] += 1
        at -= sizes[last[at]]
    return worth, dict(out)


def fullest(sizes: list[int], demand: list[int], top: int, capacity: int) -> dict[int, int]:
    """The configuration with one of sizes[top] that fills a sequence most, larger sizes preferred: group -> times.

    Sets of reachable sums are the bits of an integer."""
    room = capacity - sizes[top]
    mask = (1 << room + 1) - 1
    items: list[tuple[int, int]] = []  # (group, times) by binary splitting
    for k in range(len(sizes) - 1, top - 1, -1):  # smallest first, so that the way back starts with the largest
        left = min(demand[k] - (k == top), room // sizes[k])
        step = 1
        while left > 0:
            n = min(step, left)
            items.append((k, n))
            left -= n
            step *= 2
    reach, states = 1, [1]
    for k, n in items:
        reach |= reach << n * sizes[k] & mask
        states.append(reach)
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out = Counter({top: 1})
    for i in range(len(states) - 2, -1, -1):
        if not states[i] >> at & 1:
            k, n = items[i]
            out[k] += n
            at -= n * sizes[k]
    return dict(out)


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences; one that no plan can better ends the search."""
    bound, best = -(-sum(x * n for x, n in counts.items()) // capacity), None
    for part in LARGE:
        plan = Plan(counts, capacity, part)
        best = plan if best is None or plan.sequences < best.sequences else best
        if best.sequences <= bound:
            break
    return best


def packed(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be a written table, as it is read more than once."""
    per_bucket = 20_000
    total = pieces.count()
    buckets = max(1, total // per_bucket)
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counted = rows.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_plan(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(runs)  # as large as the number of lengths allows
    within = Window.partitionBy("_bucket", "length").orderBy(*keys)
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["_bucket", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = shared.value
        key = np.searchsorted(r[:, 0] << 40 | r[:, 1], length.to_numpy() << 40 | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": r[key, 3] + rank.to_numpy() - r[key, 1], "offset": r[key, 4]})

    return ranked.withColumn("_place", place("length", "_rank")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all docs (doc_id, text)."""
    return packed(written(tokenised(docs, path or tokenizer_path(), capacity, end_id), "pieces"), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
