"""Substring dedup of repeated word windows, with a count-min prefilter.

Documents are laid into blocks of about the same number of bytes by a hash of the whole row. Four steps, of which
the first, third and last read the blocks (one exchange of the texts, which Spark reuses):

1. Each block counts the hashes of its windows into a sketch of its own, DEPTH rows of as many cells as there
   are windows in all, times WIDTH. Being sparse, the sketch travels as its occupied cells, sorted and coded by
   differences, cut into segments of the cell space.
2. Segment by segment, the blocks' sketches are added up (saturating at 2). As cells are shared, a sum can only
   overestimate a window's count. Back to each block goes a bit for each of its cells: 2 or more, or not.
3. Windows of which every cell says 2 or more are estimated to be repeated; all others are surely single.
   Of the former alone, 128-bit keys go out to be grouped exactly, each with the first place (doc_id, start) that
   the block has for it, again sorted, segment by segment; back comes a bit for each: whether another block has
   an earlier place.
4. A window starts earlier elsewhere if another block says so or it has an earlier place in its own block.
   Words under such windows are removed.

No window is lost to the sketch, no group of copies meets in one task (a block sends a window once, however
often it holds it), and nothing depends on the number of copies. A block exchanges a row for each segment; there
are SEGMENTS of them in a row of the sketch for any input up to SEGMENTS << SEGMENT_BITS cells, so up to there
rows grow in proportion to the input, and beyond it a segment's memory stays bounded instead.

Nulls and odd rows: a null text has no words. Rows that share a doc_id hold the same places: none of them is
earlier than the other, so repeated rows get equal results; they may lie in different blocks. A null doc_id counts
as smaller than all others. An empty table gives an empty result. Texts are taken whole; a longer text than a
block's share makes a larger block.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes
from .words import P2, Q2, block_windows, windows, word_hashes

WINDOW = 20
DEPTH, WIDTH = 2, 4
#: Text bytes of a block.
BLOCK = 6 * 1024 * 1024
#: Least number of segments of a row of the sketch, and the most cells of one, as a power of two; keys that a segment of
#: the exact step may expect.
SEGMENTS, SEGMENT_BITS, KEYS = 32, 24, 1 << 21
#: Least number of cells in a row of the sketch, as a power of two.
CELL_BITS = 20
#: Bytes of text that a word takes at least, nearly always; only the sketch's width depends on it.
WORD_BYTES = 5
PART = "block long, segment long, payload binary"
#: Stands for a null doc_id.
NO_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Shape:
    """window: words; cell_bits: of the cells in a row of the sketch; inner_bits: of those in a segment of it; key_bits: of
    the segments of the exact step."""

    window: int
    cell_bits: int
    inner_bits: int
    key_bits: int


def shape(total_bytes: int, window: int) -> Shape:
    words = max(1, total_bytes // WORD_BYTES)
    cell_bits = max(CELL_BITS, (WIDTH * words - 1).bit_length())
    return Shape(window, cell_bits, min(SEGMENT_BITS, cell_bits - (SEGMENTS - 1).bit_length()), max(0, (words // KEYS).bit_length()))


class Block:
    """The documents of a block in the order of doc_id, their words, and the hashes of their windows."""

    def __init__(self, rows: pa.Table, window: int):
        ids = rows.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        texts = rows.column("text")
        self.ids = [ids[i] for i in order]
        self.distinct = np.array(sorted({NO_ID if x is None else x for x in ids}), np.int64)
        words = [(texts[i].as_py() or "").encode("utf-8", "surrogatepass").split() for i in order]
        self.counts = np.array([len(w) for w in words], np.int64)
        self.words = [x for w in words for x in w]
        self.window = window
        self.starts = block_windows(self.counts, window)  # places of windows among the block's words
        self.first = windows(word_hashes(self.words), window)[self.starts] if len(self.starts) else np.empty(0, np.uint64)

    def second(self, which: np.ndarray) -> np.ndarray:
        """The other half of the keys of some windows."""
        return windows(word_hashes(self.words, P2), self.window, Q2)[self.starts[which]] if len(which) else np.empty(0, np.uint64)

    def places(self, which: np.ndarray) -> np.ndarray:
        """Of some windows (document, start), as one number; rows that share a doc_id count as one document."""
        ends = np.cumsum(self.counts)
        doc = np.searchsorted(ends, self.starts[which], "right")
        same = np.cumsum([0] + [int(a != b) for a, b in zip(self.ids, self.ids[1:])])[: len(self.ids)]
        return same[doc] << 40 | self.starts[which] - (ends - self.counts)[doc]


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (h * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)[row])) >> np.uint64(64 - bits)


def coded(sorted_cells: np.ndarray) -> bytes:
    """Differences of sorted numbers below 2**32, by byte planes."""
    return np.diff(sorted_cells.astype(np.uint32), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def decoded(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int64)


def packed(payload: list[tuple[int, int, bytes]]) -> pa.Table:
    blocks, segments, data = zip(*payload, strict=True) if payload else ((), (), ())
    return pa.Table.from_arrays([pa.array(blocks, pa.int64()), pa.array(segments, pa.int64()), pa.array(data, pa.binary())], ["block", "segment", "payload"])


def stretches(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of the stretches of equal numbers."""
    cuts = [*np.flatnonzero(np.diff(numbers, prepend=-1)).tolist(), len(numbers)]
    return list(zip(cuts, cuts[1:]))


def sketch(rows: pa.Table, s: Shape) -> pa.Table:
    """A block's sketch: for each segment the occupied cells, and for each whether it counts 2 or more."""
    press = zstandard.ZstdCompressor(level=1)
    block = Block(rows, s.window)
    out: list[tuple[int, int, bytes]] = []
    number = rows.column("block")[0].as_py()
    for row in range(DEPTH):
        cell, count = np.unique(cells(block.first, row, s.cell_bits), return_counts=True)
        segment = (cell >> np.uint64(s.inner_bits)).astype(np.int64)
        for a, b in stretches(segment):
            inner = coded(cell[a:b] & np.uint64((1 << s.inner_bits) - 1))
            out.append((number, (row << 40) + int(segment[a]), press.compress(inner + np.packbits(count[a:b] > 1).tobytes())))
    return packed(out)


def cell_parts(payload: bytes, press: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    raw = press.decompress(payload)
    n = max(k for k in range((len(raw) * 8 - 7) // 33, len(raw) * 8 // 33 + 1) if 4 * k + -(-k // 8) == len(raw))
    return decoded(raw[: 4 * n]), np.unpackbits(np.frombuffer(raw[4 * n :], np.uint8), count=n)


def added(parts: pa.Table, s: Shape) -> pa.Table:
    """A segment's sum over all blocks, and for each block the bits of its cells."""
    read, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    total = np.zeros(1 << s.inner_bits, np.uint8)
    column = parts.column("payload")
    for payload in column:
        cell, more = cell_parts(payload.as_py(), read)
        total[cell] = np.minimum(total[cell] + 1 + more, 2)
    out = []
    for block, segment, payload in zip(parts.column("block").to_pylist(), parts.column("segment").to_pylist(), column, strict=True):
        out.append((block, segment, press.compress(np.packbits(total[cell_parts(payload.as_py(), read)[0]] > 1).tobytes())))
    return packed(out)


def estimated(rows: pa.Table, bits: pa.Table, s: Shape) -> pa.Table:
    """The exact keys of a block's windows that the sketch says are repeated, by segment; and, as a part of its
    own (negative segment), which windows those are."""
    read, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    if not rows.num_rows:
        return packed([])
    block, number = Block(rows, s.window), rows.column("block")[0].as_py()
    answers = dict(zip(bits.column("segment").to_pylist(), bits.column("payload"), strict=True))
    repeated = np.ones(len(block.first), bool)
    for row in range(DEPTH):
        cell, where = np.unique(cells(block.first, row, s.cell_bits), return_inverse=True)
        segment, number_of = np.unique((cell >> np.uint64(s.inner_bits)).astype(np.int64), return_counts=True)
        found = [np.unpackbits(np.frombuffer(read.decompress(answers[(row << 40) + int(k)].as_py()), np.uint8), count=n) for k, n in zip(segment, number_of, strict=True)]
        if found:
            repeated &= np.concatenate(found).astype(bool)[where]
    which = np.flatnonzero(repeated)
    a, b, _, first = keys_of(block, which)
    doc, start = block.distinct[first >> 40], (first & (1 << 40) - 1).astype(np.uint32)
    segment = (a >> np.uint64(64 - s.key_bits)).astype(np.int64) if s.key_bits else np.zeros(len(a), np.int64)
    out = [(number, int(segment[x]), (y - x).to_bytes(8, "little") + a[x:y].tobytes() + b[x:y].tobytes() + press.compress(planes(doc[x:y]) + planes(start[x:y]))) for x, y in stretches(segment)]
    return packed([*out, (number, -1 - number, press.compress(np.packbits(repeated).tobytes()))])


def planes(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes, of which the high ones hold little."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def from_planes(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, n * size).reshape(size, -1).T.copy().view(kind).ravel()


def keys_of(block: Block, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of some windows in order (two halves), the number of each window's key, and each key's first place."""
    a, b = block.first[which], block.second(which)
    place = block.places(which) if len(which) else np.empty(0, np.int64)
    order = np.lexsort((place, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    heads = order[new]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return a[heads], b[heads], number, place[heads]


def grouped(parts: pa.Table) -> pa.Table:
    """For each block's keys of a segment whether another block has an earlier place of them. Negative segments pass through."""
    if parts.column("segment")[0].as_py() < 0:
        return parts.select(["block", "segment", "payload"])
    blocks, column, read = parts.column("block").to_pylist(), [p.as_py() for p in parts.column("payload")], zstandard.ZstdDecompressor()
    sizes = [int.from_bytes(p[:8], "little") for p in column]
    places = [read.decompress(p[8 + 16 * n :]) for p, n in zip(column, sizes, strict=True)]
    a = np.concatenate([np.frombuffer(p, np.uint64, n, 8) for p, n in zip(column, sizes, strict=True)])
    b = np.concatenate([np.frombuffer(p, np.uint64, n, 8 + 8 * n) for p, n in zip(column, sizes, strict=True)])
    doc = np.concatenate([from_planes(p, n, np.int64) for p, n in zip(places, sizes, strict=True)])
    start = np.concatenate([from_planes(p[8 * n :], n, np.uint32) for p, n in zip(places, sizes, strict=True)])
    order = np.lexsort((start, doc, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = order[new][np.cumsum(new) - 1]  # of each key, in order, the earliest place
    later = np.empty(len(order), bool)
    later[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    ends = np.cumsum(sizes)
    segment = parts.column("segment")[0].as_py()
    press = zstandard.ZstdCompressor(level=1)
    return packed([(k, segment, press.compress(np.packbits(later[e - n : e]).tobytes())) for k, n, e in zip(blocks, sizes, ends, strict=True)])


def marked(rows: pa.Table, bits: pa.Table, s: Shape) -> tuple[Block, np.ndarray]:
    """A block and, for each of its words, whether it is removed."""
    read = zstandard.ZstdDecompressor()
    block = Block(rows, s.window)
    answers = dict(zip(bits.column("segment").to_pylist(), bits.column("payload"), strict=True))
    number = rows.column("block")[0].as_py()
    which = np.flatnonzero(np.unpackbits(np.frombuffer(read.decompress(answers[-1 - number].as_py()), np.uint8), count=len(block.first)))
    a, _, key, first = keys_of(block, which)
    segment, sizes = np.unique((a >> np.uint64(64 - s.key_bits)).astype(np.int64) if s.key_bits else np.zeros(len(a), np.int64), return_counts=True)
    found = [np.unpackbits(np.frombuffer(read.decompress(answers[int(k)].as_py()), np.uint8), count=n) for k, n in zip(segment, sizes, strict=True)]
    removed = np.zeros(len(block.words) + 1, np.int32)
    if found:
        gone = block.starts[which[np.concatenate(found).astype(bool)[key] | (block.places(which) > first[key])]]
        np.add.at(removed, gone, 1)
        np.add.at(removed, gone + s.window, -1)
    return block, np.cumsum(removed)[:-1] > 0


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def removed_substrings(docs: DataFrame, window: int = WINDOW, text_out: bool = False, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with text_out, kept_text: a row per row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = text_bytes(docs, "text")
    s = shape(total, window)
    number = max(1, -(-total // block_bytes))
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(number))).groupBy("block")
    estimates = blocks.applyInArrow(lambda rows: sketch(rows, s), PART).groupBy("segment").applyInArrow(lambda parts: added(parts, s), PART)
    exact = blocks.cogroup(estimates.groupBy("block")).applyInArrow(lambda rows, bits: estimated(rows, bits, s), PART).groupBy("segment").applyInArrow(grouped, PART)

    def kept(rows: pa.Table, bits: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows:
            block, gone = marked(rows, bits, s)
            at = 0
            for doc, n in zip(block.ids, block.counts.tolist(), strict=True):
                mask = gone[at : at + n]
                left = b" ".join([w for w, g in zip(block.words[at : at + n], mask, strict=True) if not g] if mask.any() else block.words[at : at + n])
                out.append((doc, n, int(mask.sum()), hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "surrogatepass")] if text_out else [])))
                at += n
        columns = zip(*out, strict=True) if out else [[]] * (4 + text_out)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(map(list, columns), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + text_out])

    return blocks.cogroup(exact.groupBy("block")).applyInArrow(kept, DIGEST + ", kept_text string" * text_out)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under 20-word windows that start earlier elsewhere, over all documents."""
    return removed_substrings(table(spark, sf_dir, "documents"))


ORACLE = {
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS key FROM g),
f AS (SELECT doc_id, i, first_value(doc_id) OVER v AS d, first_value(i) OVER v AS s FROM k WINDOW v AS (PARTITION BY key ORDER BY doc_id, i)),
b AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE doc_id <> d OR i <> s),
m AS (SELECT doc_id, count(*) AS n, list(j) AS gone FROM b GROUP BY doc_id),
p AS (SELECT w.doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
q AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.j) AS kept FROM p LEFT JOIN b ON b.doc_id = p.doc_id AND b.j = p.j WHERE b.j IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(m.n, 0) AS n_removed, sha256(coalesce(q.kept, '')) AS kept_sha256 FROM w LEFT JOIN m ON m.doc_id = w.doc_id LEFT JOIN q ON q.doc_id = w.doc_id
""",
}
