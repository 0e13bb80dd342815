"""Shared storage, materialised tables and salted joins for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds at least 1 / HEAVY of all rows counts as heavy, so there are at most HEAVY of them.
HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; in local mode (tests) one is set where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and outlives any executor."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def salted_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """left LEFT JOIN right on `key`, where right has one row a key and `weight` rows of left use it.

    Keys with at least total / HEAVY rows (at most HEAVY of them, so they may be broadcast) are spread
    over as many salts as they hold such shares, row by row; right is there under each salt, so it
    doesn't matter which a row gets.  The rest join as they are, each with less than 1 / HEAVY of the rows.
    """
    share = max(1, total // HEAVY)
    salts = F.when(F.col(weight) >= share, F.least(F.lit(4 * HEAVY), F.ceil(F.col(weight) / share)))
    heavy = right.filter(F.col(weight) >= share).select(F.col(key).alias("_hk"), salts.cast("int").alias("_hn"))
    l = left.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_hk")), "left")
    l = l.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_hn")).cast("int"), F.lit(0))).drop("_hk", "_hn")
    n = F.coalesce(salts, F.lit(1)).cast("int")
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return l.join(r, [key, "_salt"], "left").drop("_salt")


def numbered(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """The rows with their rank (from 0) by `order` over the whole table, and how many they are.

    Rows are dealt by range and sorted within each partition; a rank is the partition's offset, of which
    there are as many as partitions, plus the place in it.  Rows alike in `order` are told apart by
    where they lie, so that no number of them fills one partition.  `rows` should be a read table.
    """
    spark = rows.sparkSession
    keys = [*order, F.col("_place")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = materialise(dealt.drop("_place").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = sorted((r["_part"], r["count"]) for r in dealt.groupBy(part.alias("_part")).count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    known = spark.createDataFrame(offsets, "_part long, _offset long")
    ranked = dealt.withColumn("_part", part).join(F.broadcast(known), "_part")
    return ranked.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_offset", "_at"), total


def row_mark(docs: DataFrame) -> Column:
    """A hash of all columns: with the id, it tells rows apart that repeat an id or have none."""
    return F.xxhash64(*docs.columns)


def keep_rows(docs: DataFrame, fate: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs, with all their columns, that `fate` (doc_id, mark, kept: one row a row of docs) keeps.

    Rows that are alike in every column share a fate and count as one.  Only doc_id and mark of what
    goes, and of what repeats, meet the rows.
    """
    fate = materialise(fate.groupBy("doc_id", "mark").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("_id"), row_mark(docs).alias("_mark"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark"))
    left = rows.join(fate.select("doc_id", "mark"), same, "left_anti").select("row.*")
    again = fate.filter("kept").select("doc_id", "mark")
    if again.isEmpty():
        return left
    return left.unionByName(rows.join(again, same, "left_semi").select("row.*").dropDuplicates())
