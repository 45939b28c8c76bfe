"""Chat formatting of logged conversations, without those that a longer log continues. DataFrame functions only.

A turn's prefix hash is the exclusive-or of the hashes of all turns up to it, each with its position, so it can be
rolled in any grouping: within chunks of turns first, then over the chunks. A conversation whose whole hash is another's
prefix hash at the same length, with more turns to come there, is a snapshot of it; an anti-join drops it. Of equal
conversations the smallest id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.llm.work import stored

#: Turn numbers in a chunk, and turns in a rendered part.
CHUNK = 64
#: One turn's text; {role} and {text} are replaced.
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"


def _rendered(template: str) -> Column:
    before, after = template.split("{role}", 1)
    between, end = after.split("{text}", 1)
    text = F.coalesce("text", F.lit(""))
    return F.concat(F.lit(before), F.coalesce("role", F.lit("user")), F.lit(between), text, F.lit(end))


def _placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with their position pos, from 1; conv, chunk, pos and the prefix hashes p1 and p2)."""
    # positions and hashes are rolled within chunks, then over the chunks, so that a long conversation isn't sorted in one task; only
    # turns of one number, or of none, are
    order = Window.partitionBy("conv", "chunk").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    local = turns.withColumn("k", F.row_number().over(order))
    sizes = turns.groupBy("conv", "chunk").agg(F.count("*").alias("c"))
    over = Window.partitionBy("conv").orderBy(F.asc_nulls_first("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("conv", "chunk", F.coalesce(F.sum("c").over(over), F.lit(0)).alias("base"))
    numbered = stored(local.join(bases, ["conv", "chunk"]).withColumn("pos", F.col("base") + F.col("k")).drop("k", "base"), "turns")
    what = [F.col("pos"), F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()]
    hashed = numbered.select("conv", "chunk", "pos", F.xxhash64(*what).alias("h1"), F.xxhash64(F.lit(1), *reversed(what)).alias("h2"))
    sums = hashed.groupBy("conv", "chunk").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    earlier = sums.select("conv", "chunk", *(F.coalesce(F.bit_xor(s).over(over), F.lit(0)).alias(b) for s, b in (("s1", "b1"), ("s2", "b2"))))
    upto = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({"r1": F.bit_xor("h1").over(upto), "r2": F.bit_xor("h2").over(upto)}).join(earlier, ["conv", "chunk"])
    prefixes = rolled.select("conv", "chunk", "pos", F.col("r1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("p2"))
    return numbered, stored(prefixes, "prefixes")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, n): the conversations that no longer one continues, one of each group of equal ones."""
    last = prefixes.groupBy("conv").agg(F.max_by(F.struct("pos", "p1", "p2"), "pos").alias("w"))
    whole = last.select("conv", F.col("w.pos").alias("n"), "w.p1", "w.p2")
    one = whole.groupBy("n", "p1", "p2").agg(F.min("conv").alias("conv"))
    # a prefix that ends before its conversation does; hot ones are merged before they are shuffled
    ends = whole.select("conv", "n")
    inner = prefixes.join(ends, "conv").filter("pos < n").select(F.col("pos").alias("n"), "p1", "p2").distinct()
    return one.join(inner, ["n", "p1", "p2"], "left_anti").select("conv", "n")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """(conv_id long, part long, n_turns long, text string): each maximal conversation, rendered in order.

    A conversation's parts 0, 1, ... hold 64 turns each, the last one what is left; almost all have one part. n_turns counts
    the part's turns. Rows with a null conversation are left out; null turn numbers come first; exactly repeated rows count once; turns with equal numbers follow by role and
    text, nulls first. A null role is rendered as `user`, a null text as an empty one; both differ from those for the
    comparison. An empty table gives no rows; other columns are ignored."""
    own = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).filter("conv is not null").distinct()
    chunk = F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / CHUNK)
    numbered, prefixes = _placed(own.withColumn("chunk", chunk))
    kept = maximal(prefixes).select("conv")
    part = F.floor((F.col("pos") - 1) / CHUNK).alias("part")
    rows = numbered.join(kept, "conv").select("conv", part, F.struct("pos", _rendered(template).alias("t")).alias("x"))
    parts = rows.groupBy("conv", "part").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # 64 turns at most
    return parts.select(F.col("conv").alias("conv_id"), "part", F.size("xs").cast("long").alias("n_turns"), F.array_join(F.transform("xs", lambda x: x["t"]), "").alias("text"))


#: DuckDB SQL for format_chats(conversations): whole lists of turns are compared.
ORACLE = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM turns),
lists AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS l FROM placed GROUP BY conv_id),
one AS (SELECT n, l, min(conv_id) AS conv_id FROM lists GROUP BY n, l),
cuts AS (
  SELECT DISTINCT k AS n, l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM lists WHERE n > 1)),
kept AS (SELECT conv_id FROM one WHERE NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.n = one.n AND cuts.l = one.l)),
parts AS (
  SELECT conv_id, (pos - 1) // 64 AS part, count(*) AS n_turns,
    string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
  FROM placed JOIN kept USING (conv_id) GROUP BY 1, 2)
SELECT conv_id, part, n_turns, text FROM parts
"""
