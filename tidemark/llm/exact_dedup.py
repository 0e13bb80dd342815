"""Exact deduplication by a stateful stream over content digests.

A feed of (digest, identifier, code points, locator) runs through Structured Streaming.  The state is
keyed by digest, lives on disk in RocksDB, has no watermark and so never expires; it retains the
digest, the identifier of the text that stays, its locator and the group's size.  Every hit is then
checked on its full bytes; groups in which bytes differ are dealt out again by the bytes themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import HEAVY, keep_rows, materialise, row_mark, salted_join, shared_dir

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without any of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def feed(docs: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    """doc_id, n_cp, locator, digest, text_sha256 and mark (a hash of all columns) of every row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(F.coalesce(text, F.lit(""))).alias("n_cp"), normalised(text).alias("_norm"), F.input_file_name().alias("locator"), row_mark(docs).alias("mark"))
    return rows.select("doc_id", "n_cp", "locator", "mark", F.expr(_digest(digest_bits)).alias("digest"), F.sha2("_norm", 256).alias("text_sha256"))


def _digest(bits: int) -> str:
    return f"substring(unhex(sha2(_norm, 256)), 1, {bits // 8})"


#: What is retained of the row that stays: most code points, then the least id (none comes last), then the least mark.
KEPT = "max_by(struct(doc_id, n_cp, mark, locator), struct(n_cp, ~doc_id as i, ~mark as m))"
SHOWN = ("doc_id", "keep_id", "group_size", "kept", "text_sha256", "locator", "mark")


def run_state(source: DataFrame, files_per_batch: int | None = None, state_dir: str | None = None) -> DataFrame:
    """digest, keep_id, keep_cp, keep_mark, locator, group_size after the feed's files went through the stream.

    `state_dir` names a lasting checkpoint: a later call with new feed files goes on from its state
    and returns the digests that those files touched.
    """
    spark, base = source.sparkSession, state_dir or shared_dir(source.sparkSession)
    old = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(source.schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        state = reader.parquet(source.inputFiles()[0].rpartition("/")[0]).groupBy("digest").agg(F.expr(KEPT).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        out = f"{shared_dir(spark)}/state"

        def store(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = state.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    seen = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    if files_per_batch or state_dir:  # a digest is told again by each batch that touches it; its size only grows
        seen = seen.groupBy("digest").agg(F.max_by("keep", "group_size").alias("keep"), F.max("group_size").alias("group_size"))
    return seen.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.n_cp").alias("keep_cp"), F.col("keep.mark").alias("keep_mark"), F.col("keep.locator").alias("locator"), "group_size")


def hit_bits(state: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Bitmaps of the digests seen more than once, 4 KB a bucket, and the number of buckets.

    Four bits a row, 16 MB at most, so they may be broadcast however many hits there are.  A digest that was seen once may
    bear the bit of another; of those seen more than once none is missed.
    """
    buckets = 1 << min(12, max(4, (total >> 13).bit_length()))
    hits = state.filter("group_size > 1").select(*_bit_of(buckets)).repartition("_bucket")  # dealt out as bits, not as bitmaps
    return hits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")), buckets


def _bit_of(buckets: int) -> tuple[Column, Column]:
    h = F.xxhash64("digest")
    return h.bitwiseAND(F.lit(buckets - 1)).alias("_bucket"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(32767)).cast("int").alias("_bit")


def differing(docs: DataFrame, state: DataFrame, total: int, text_col: str, digest_bits: int) -> DataFrame:
    """Digests of groups whose rows don't all hold the same bytes.

    Only rows of hits, digests seen more than once, are looked at: bitmaps keep the others where they
    lie, so that their texts aren't moved.  Each is compared with the one before it in its group; heavy
    groups are checked in salted parts, and the parts' first texts are then compared with one another.
    """
    bits, buckets = hit_bits(state, total)
    share = max(1, total // HEAVY)
    salts = F.when(F.col("group_size") >= share, F.least(F.lit(4 * HEAVY), F.ceil(F.col("group_size") / share))).otherwise(F.lit(1)).cast("int")
    hits = state.filter("group_size > 1").select("digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    heavy = state.filter(F.col("group_size") >= share).select("digest", F.least(F.lit(4 * HEAVY), F.ceil(F.col("group_size") / share)).cast("int").alias("_n"))
    rows = docs.select(F.monotonically_increasing_id().alias("_place"), normalised(F.col(text_col)).alias("_norm"))
    rows = rows.withColumn("digest", F.expr(_digest(digest_bits))).select("*", *_bit_of(buckets)).join(F.broadcast(bits), "_bucket")
    rows = rows.filter("getbit(cast(conv(hex(substring(_bits, shiftright(_bit, 3) + 1, 1)), 16, 10) as int), _bit & 7) = 1").select("_place", "_norm", "digest")
    rows = rows.join(F.broadcast(heavy), "digest", "left")
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_place"), F.col("_n")).cast("int"), F.lit(0)))
    rows = rows.join(hits, ["digest", "_salt"], "left_semi")  # salted before they move, so that no digest fills a task
    w = Window.partitionBy("digest", "_salt").orderBy("_place")
    checked = rows.select("digest", "_norm", (F.col("_norm") != F.lag("_norm").over(w)).alias("differs"), F.lag("_norm").over(w).isNull().alias("first"), F.col("_n").isNotNull().alias("heavy")).filter("differs or (first and heavy)")
    heads = F.when(F.col("first") & F.col("heavy"), F.col("_norm"))
    told = checked.groupBy("digest").agg(F.max("differs").alias("d"), F.min(heads).alias("a"), F.max(heads).alias("b"))
    return told.filter("d or a != b").select("digest")


def _decided(docs: DataFrame, id_col: str, text_col: str, digest_bits: int, files_per_batch: int | None) -> DataFrame:
    source = materialise(feed(docs, id_col, text_col, digest_bits))
    total = source.count()
    if not total:
        return source.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "locator", "mark")
    state = run_state(source, files_per_batch)
    kept = (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp")) & (F.col("mark") == F.col("keep_mark"))).alias("kept")
    shown = [kept if x == "kept" else x for x in SHOWN]
    wrong = materialise(differing(docs, state, total, text_col, digest_bits))
    right = salted_join(source.drop("locator"), state, "digest", "group_size", total)
    if wrong.isEmpty():
        return right.select(*shown)
    by_bytes = F.expr("sha2(_norm, 512)") if digest_bits < 256 else F.col("_norm")
    again = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("n_cp"), normalised(F.col(text_col)).alias("_norm"), F.input_file_name().alias("locator"), row_mark(docs).alias("mark"))
    again = again.withColumn("digest", F.expr(_digest(digest_bits))).join(wrong, "digest", "left_semi")
    again = again.select("doc_id", "n_cp", "mark", "locator", F.sha2("_norm", 256).alias("text_sha256"), by_bytes.alias("bytes"))
    best = again.groupBy("bytes").agg(F.expr(KEPT).alias("k"), F.count(F.lit(1)).alias("group_size"))
    apart = again.drop("locator").join(best, "bytes").select("doc_id", "n_cp", "mark", "text_sha256", "group_size", F.col("k.doc_id").alias("keep_id"), F.col("k.n_cp").alias("keep_cp"), F.col("k.mark").alias("keep_mark"), F.col("k.locator").alias("locator")).select(*shown)
    return right.join(wrong, "digest", "left_anti").select(*shown).unionByName(apart)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, files_per_batch: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator for every row.

    Texts are equal when identical without white space; null counts as empty, and all empty texts are
    one group.  Of a group the row with the most code points, then the smallest doc_id, stays; null
    ids come last.  Of rows that are alike in id and length but for where white space stands, one stays;
    rows alike in id and text are all marked kept if one is.  An empty table gives no rows; other
    columns are not read.
    """
    return _decided(docs.select(id_col, text_col), id_col, text_col, digest_bits, files_per_batch).drop("mark")


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of equal texts: the one that exact_dedup keeps.

    Rows are decided on by their texts, so rows without an id, and rows that repeat an id with another
    text, take part like all others.  Rows alike in every column count as one; an empty table stays empty.
    """
    return keep_rows(docs, _decided(docs, id_col, text_col, 256, None).select("doc_id", "mark", "kept"), id_col)
