"""What the operators of this subpackage share: staging, samples, salted joins, table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import clean_up, new_path, shared_dir  # noqa: F401

#: Copies of the small side of a salted join; a hot key's rows are spread over as many tasks.
SALTS = 32
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor costs nothing written."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def one_of_each(df: DataFrame, id_col: str, digest: Column, text_col: str) -> DataFrame:
    """Of rows with the same id and digest the one with the least text, then hash of the whole row; df's columns."""
    hashed = [F.col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col(text_col), F.xxhash64(*hashed))
    return df.groupBy(F.col(id_col).alias("_id"), digest.alias("_digest")).agg(F.min_by(F.struct("*"), order).alias("_row")).select("_row.*")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """left join right on keys, right being unique by key: each right row is copied `salts` times, and a
    hot key's left rows are dealt to the copies by `spread` (an expression over left that varies within a key).
    The copies are not counted in Spark's estimate of right's size, so it is told not to broadcast them."""
    salt = "_salt"
    return left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts))).join(
        right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))).hint("merge"), [*keys, salt], how
    ).drop(salt)


def in_training(id_col: Column) -> Column:
    """Whether a row may be learned from: crc32 of its id as text is not 0 mod 5; a null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 != 0, F.lit(False))


def held_out(id_col: Column) -> Column:
    """Whether that remainder is 0; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def sample_ids(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """Of rows (_id, label), about per_class ids of each label at most: of each of SALTS parts that a hash deals the ids
    to, those with the smallest hash. So a hot label is spread over tasks, and as few rows of a part are wanted as
    Spark limits before the shuffle."""
    part = F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(SALTS))
    w = Window.partitionBy(label, "_part").orderBy(F.xxhash64("_id", F.lit("sample")), "_id")
    ranked = rows.withColumn("_part", part).withColumn("_rank", F.row_number().over(w))
    return ranked.filter(F.col("_rank") <= -(-per_class // SALTS)).select("_id", label)


def sampled_rows(rows: DataFrame, ids: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Of rows (keys, t) those that the sample ids (keys, label) name, one for each: of rows that repeat an id the one whose
    text has the smallest hash. So no more rows come than were sampled."""
    named = rows.join(F.broadcast(ids.distinct()), keys)
    return named.groupBy("_id", label).agg(F.min_by("t", F.xxhash64("t")).alias("t"))


def text_window(text: Column, id_col: Column, chars: int) -> Column:
    """At most `chars` characters of a text to learn from, from a place that the id's hash picks."""
    room = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substr(text, F.pmod(F.xxhash64(id_col, F.lit("at")), room).cast("int") + 1, F.lit(chars))
