"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame operations only).

Each input partition makes a run: its digests, sorted, one entry per distinct text with the smallest identifier and
a count. Runs are numbered by their partitions, in bits, and exchanged in binomial rounds: in a round the runs that
differ in one bit only (with fan_in = 2**b, in b bits) meet. Each of them sends every entry to the one of them that
has, at those bits, the bits of the entry's digest, and what a run has received is merged in order of digest. After the
last round a run's number is the first bits of its digests, so that entries of a text have all met; no run is ever
larger than its share of the digests, and one that holds few texts stays small.

An entry holds digest, length and a second hash, all of which must agree before identifiers are compared, so each level
retains verified smallest identifiers. What the last round says of groups goes down again by way of the first runs:
a row asks the entry of its own run, so that a hot text is spread over as many keys as there are partitions. Texts are
read once and do not enter a shuffle.

Results: null text counts as empty; ties (a doc_id repeated with equal text) leave one row; null doc_ids stay only
where no other row of the group has an id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_name, one_of_each, stage

FAN_IN = 4
#: Beyond so many input partitions, several make a run together.
MAX_RUNS = 1 << 14
KEY = ["digest", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest_columns(text: Column) -> list[Column]:
    norm = normalised(text)
    return [F.unhex(F.sha2(norm, 256)).alias("digest"), F.octet_length(norm).cast("long").alias("n_bytes"), F.xxhash64(norm).alias("check")]


def exchange(entries: DataFrame, runs: int, number: Column) -> DataFrame:
    """Send each entry to the run of that number; a partition holds one run, sorted."""
    return entries.withColumn("run", number.cast("int")).repartitionById(runs, "run").sortWithinPartitions("run", *KEY)


def merge(entries: DataFrame) -> DataFrame:
    """Of sorted entries of the same run and text, one. Aggregating in the order that is there is the merge."""
    return entries.groupBy("run", *KEY).agg(F.min("head").alias("head"), F.sum("size").alias("size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            *digest_columns(F.col(text_col)),
            F.pmod(F.spark_partition_id(), F.lit(MAX_RUNS)).alias("run"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    head = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    leaves = stage(merge(rows.select("run", *KEY, head.alias("head"), F.lit(1).cast("long").alias("size"))), "runs")
    bits, step = max(0, leaves.agg(F.max("run")).first()[0] or 0).bit_length(), fan_in.bit_length() - 1
    first_bits = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    level = leaves
    for at in range(0, bits, step):
        mask = ((1 << min(step, bits - at)) - 1) << at
        level = merge(exchange(level, 1 << bits, F.col("run").bitwiseAND(~mask).bitwiseOR(first_bits.bitwiseAND(mask))))
    groups = stage(level.filter("size > 1").select(*KEY, "head", "size"), "repeated")
    down = leaves.select("run", *KEY).join(groups, KEY)
    own = F.coalesce(F.col("head.row"), F.col("row"))
    return rows.join(down, ["run", *KEY], "left").select(
        "doc_id",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (own == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns. Rows are found again by id and digest; of rows equal in both,
    one stays, the one with the least text and hash of the row."""
    groups = stage(exact_groups(docs, id_col, text_col), "groups")
    gid, gsha = free_name(docs, "_gid"), free_name(docs, "_gsha")
    keys = groups.groupBy(F.col("doc_id").alias(gid), F.col("text_sha256").alias(gsha)).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    keys = stage(keys.filter("not kept or n > 1"), "verdicts")
    sha = F.sha2(normalised(F.col(text_col)), 256)
    left = docs.join(keys.filter("not kept").select(gid, gsha).hint("merge"), F.col(id_col).eqNullSafe(F.col(gid)) & (sha == F.col(gsha)), "left_anti")
    return left if keys.filter("kept").isEmpty() else one_of_each(left, id_col, sha, text_col)
