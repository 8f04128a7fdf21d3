"""Chat formatting with cumulative-snapshot collapse (DataFrame operations only).

A conversation that was logged again after each turn leaves snapshots that prefix the last one. Turns are ordered by
turn, then role, then md5 of the text; rows equal in all three are one run of so many copies. Each run gets two 64-bit
hashes of its place, turn, role, text digest and copies, and the running xor of those before it is the hash of the
prefix that it continues. A conversation goes, by an anti-join, if another has the same prefix and the same run where its
own last one stands, and there has more copies or goes on; the maximal ones are rendered.

No step has more of a conversation in one task than its share. The narrow runs are sorted by ranges over all of them,
which cut a large conversation where it has many runs; places and hashes are found within a range's piece of a
conversation, and over the totals of a conversation's pieces. Rendering makes a row for BLOCK turns: (conv_id, part, n_turns,
text); nearly all conversations have one. Texts are shuffled twice: by run, where copies become one, and to be rendered.

Results: a null text or role is empty; null turns come first; rows with a null conv_id are left out; equal
conversations do not prefix a longer one by being equal: each stays; repeated rows are turns; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import salted_join, stage

BLOCK = 1024
ORDER = ["conv_id", "turn", "role", "digest"]
#: What names a run: two hashes of its turn, role and text digest.
RUN = ["conv_id", "a", "b"]


def _turns(conversations: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.unhex(F.md5(text)).alias("digest"), text.alias("text")
    )
    return rows.withColumns({"a": F.xxhash64("turn", "role", "digest"), "b": F.xxhash64("digest", F.lit("second"), "role", "turn")})


def _before(placed: DataFrame, **totals: Column) -> DataFrame:
    """For each piece of a conversation, the totals over the pieces before it; and the rows of the whole conversation."""
    w = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("conv_id", "piece").agg(F.count("*").alias("rows"), *[x.alias(name) for name, x in totals.items()])
    over = {name: (F.bit_xor if name.startswith("x") else F.sum)(name) for name in ("rows", *totals)}
    size = F.sum("rows").over(Window.partitionBy("conv_id")).alias("size")
    return sums.select("conv_id", "piece", size, *[F.coalesce(x.over(w), F.lit(0)).alias(f"{name}_before") for name, x in over.items()])


def runs(turns: DataFrame) -> DataFrame:
    """Rows RUN, copies, place (of the run, from 0), at (turns before it), last, h1, h2 (hashes of the runs before it)."""
    found = turns.groupBy(*ORDER).agg(F.count("*").alias("copies"), F.first("a").alias("a"), F.first("b").alias("b"))
    piece = [F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("row")]
    rows = stage(found.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(*RUN, "copies", *piece), "runs")
    here = Window.partitionBy("conv_id", "piece").orderBy("row")
    past = here.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", (F.row_number().over(here) - 1).alias("i"), F.coalesce(F.sum("copies").over(past), F.lit(0)).alias("n"))
    placed = local.join(_before(rows, copies=F.sum("copies")), ["conv_id", "piece"])
    place = F.col("i") + F.col("rows_before")
    hashed = [F.xxhash64(place, "a", "b", "copies").alias("x1"), F.xxhash64("copies", "b", F.lit("second"), "a", place).alias("x2")]
    placed = stage(placed.select(*RUN, "copies", "piece", "row", place.alias("place"), (F.col("n") + F.col("copies_before")).alias("at"), *hashed), "places")
    xor = lambda c: F.coalesce(F.bit_xor(c).over(past), F.lit(0)).alias(f"{c}_here")
    out = placed.select("*", xor("x1"), xor("x2")).join(_before(placed, x1=F.bit_xor("x1"), x2=F.bit_xor("x2")), ["conv_id", "piece"])
    prefix = [F.col(f"{x}_here").bitwiseXOR(F.col(f"{x}_before")).alias(h) for x, h in (("x1", "h1"), ("x2", "h2"))]
    return out.select(*RUN, "copies", "place", "at", (F.col("place") == F.col("size") - 1).alias("last"), *prefix)


def absorbed(every: DataFrame) -> DataFrame:
    """The conv_ids of conversations that prefix a longer one."""
    key = [F.xxhash64("place", "h1", "h2", "a", "b").alias("k1"), F.xxhash64("b", "h2", "h1", "a", F.lit("key"), "place").alias("k2")]
    keyed = every.select("conv_id", *key, F.struct("copies", (~F.col("last")).alias("more")).alias("length"), "last")
    longest = keyed.groupBy("k1", "k2").agg(F.max("length").alias("longest"))
    ends = keyed.filter("last").drop("last")
    return salted_join(ends, longest, ["k1", "k2"], "inner", F.col("conv_id"), 4).filter("longest > length").select("conv_id")


def collapse_and_render(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per part of each maximal conversation: conv_id, part, n_turns (of the part), text."""
    turns = _turns(conversations)
    every = stage(runs(turns), "prefixes")
    kept = salted_join(every.select(*RUN, "copies", "place", "at"), stage(absorbed(every), "absorbed"), ["conv_id"], "left_anti", F.col("place"))
    part_of = lambda n: F.floor(n / block)
    kept = kept.select(*RUN, "at", "copies", F.explode(F.sequence(part_of(F.col("at")), part_of(F.col("at") + F.col("copies") - 1))).alias("part"))
    here = F.least(F.col("at") + F.col("copies"), (F.col("part") + 1) * block) - F.greatest(F.col("at"), F.col("part") * block)
    texts = turns.groupBy(*RUN).agg(F.first(F.struct("role", "text")).alias("t")).select(*RUN, "t.*")
    rows = kept.select(*RUN, "part", "at", here.cast("int").alias("times")).join(texts.hint("merge"), RUN)
    one = F.struct("at", "times", "role", "text")
    rows = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(one)).alias("ts"), F.sum("times").alias("n_turns"))
    said = lambda t: F.repeat(F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")), t["times"])
    return rows.select("conv_id", "part", "n_turns", F.array_join(F.transform("ts", said), "").alias("text"))
