"""Chat formatting: cumulative snapshots collapsed, then rendered, in DataFrame operations alone.

A logged conversation that is a prefix of a longer one is a snapshot of it and is dropped, and so is a repeat
of an equal one with a smaller conv_id. Every turn gets a term, a hash of its position, role and text; the sum
of the terms up to a turn is the rolling hash of that prefix (two sums, 128 bits). Prefix hashes of all
conversations are brought to one row each (the longest conversation that has it, and the least id of those
that end there), and an anti-join with the hashes of whole conversations leaves the maximal ones.

A conversation is cut into parts of PART turn numbers. Positions and sums are made within parts and then
carried over from part to part, so a conversation with a third of all rows isn't the work of one task; it is
rendered part by part too. A common first turn is combined within tasks.

Nulls and odd rows: turns are ordered by number (null first), then role and text; repeated rows are turns of
their own. Null roles and texts are equal to each other, not to empty ones, and are rendered as empty. Rows
with a null conv_id are one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

PART = 1024
TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def carried(rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """conv, p and, for each total, its sum over the conversation's earlier parts."""
    sums = rows.groupBy("conv", "p").agg(*(c.alias(n) for n, c in totals.items()))
    before = Window.partitionBy("conv").orderBy(F.col("p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("conv", "p", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals))


def positioned(turns: DataFrame) -> DataFrame:
    """conv, p (part), pos (from 1), role, text, h1, h2: turns with the rolling hashes of the prefixes that they end."""
    rows = turns.select(F.col("conv_id").alias("conv"), F.floor(F.col("turn") / PART).alias("p"), "turn", "role", "text")
    order = Window.partitionBy("conv", "p").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    local = rows.withColumn("at", F.row_number().over(order))
    base = carried(rows, {"n": F.count("*")})
    placed = local.join(base, same(local, base, "conv", "p")).select(local.conv, local.p, (F.col("at") + F.col("n")).alias("pos"), "role", "text")
    parts = [F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    terms = placed.withColumns({f"t{k}": F.xxhash64(F.lit(k), *parts).cast("decimal(38,0)") for k in (1, 2)})
    upto = Window.partitionBy("conv", "p").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = terms.withColumns({f"s{k}": F.sum(f"t{k}").over(upto) for k in (1, 2)})
    before = carried(terms, {"b1": F.sum("t1"), "b2": F.sum("t2")})
    return summed.join(before, same(summed, before, "conv", "p")).select(summed.conv, summed.p, "pos", "role", "text", (F.col("s1") + F.col("b1")).alias("h1"), (F.col("s2") + F.col("b2")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv: conversations that are no prefix of another one, of equal ones the least. turns: as positioned, written."""
    ends = turns.groupBy("conv").agg(F.max(F.struct("pos", "h1", "h2")).alias("end")).select(F.col("conv").alias("end_conv"), "end.pos", "end.h1", "end.h2")
    sizes = ends.select("end_conv", F.col("pos").alias("size"))
    prefixes = turns.join(sizes, turns.conv.eqNullSafe(sizes.end_conv)).select("conv", "pos", "h1", "h2", "size")
    known = prefixes.groupBy("pos", "h1", "h2").agg(F.max("size").alias("longest"), F.min(F.when(F.col("size") == F.col("pos"), F.struct(F.col("conv").isNotNull().alias("known"), "conv"))).alias("least"))
    known = known.select(*(F.col(n).alias(f"k_{n}") for n in ("pos", "h1", "h2")), "longest", F.col("least.conv").alias("least"))
    known = written(known, "prefixes")  # so that Spark can split many equal ends over tasks
    covered = (F.col("pos") == F.col("k_pos")) & (F.col("h1") == F.col("k_h1")) & (F.col("h2") == F.col("k_h2")) & ((F.col("longest") > F.col("pos")) | ~F.col("least").eqNullSafe(F.col("end_conv")))
    return ends.join(known, covered, "left_anti").select("end_conv")


def rendered(role: Column, text: Column, template: str = TURN) -> Column:
    """A turn in the template; what looks like a control token in the text is broken up."""
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(head), F.coalesce(role, F.lit("")), F.lit(middle), clean, F.lit(tail))


def chats(conversations: DataFrame, template: str = TURN, whole: bool = False) -> DataFrame:
    """conv_id, part, n_turns, text: the maximal conversations (conv_id, turn, role, text), a row for each PART of turn numbers.

    With whole, each conversation is one row with one text (and part 0), made in one task."""
    turns = written(positioned(conversations), "turns")
    kept = maximal(turns)
    rows = turns.join(kept, turns.conv.eqNullSafe(kept.end_conv), "left_semi").select("conv", "p", "pos", rendered(F.col("role"), F.col("text"), template).alias("line"))
    if whole:
        rows = rows.withColumn("p", F.lit(0).cast("long"))
    parts = rows.groupBy("conv", "p").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return parts.select(F.col("conv").alias("conv_id"), F.col("p").alias("part"), F.size("lines").cast("long").alias("n_turns"), F.array_join(F.col("lines.line"), "").alias("text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return chats(table(spark, sf_dir, "conversations"))


ORACLE = {
    "op4_chat": r"""
WITH c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.conv_id <> c.conv_id AND o.n >= c.n AND o.turns[1:c.n] = c.turns AND (o.n > c.n OR o.conv_id < c.conv_id)))
SELECT conv_id, CAST(floor(turn / 1024) AS BIGINT) AS part, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
FROM conversations WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY ALL
""",
}
