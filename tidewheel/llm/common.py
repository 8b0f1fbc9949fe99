"""Shared plumbing of the training-data operators: scratch tables, row keys and salted ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space that separates words (space, \t \n \v \f \r), as a Java regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches of at most so many rows and bytes go to Python, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = "500", "16m"

#: Bytes of input text for which one group of a shuffle stands, at most.
SHARD_BYTES = 32 << 20

_made: list[tuple[object, str]] = []
_tables: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's own. Without either, a local
    master gets a temporary folder; on a cluster there is no folder that every machine sees, and that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local"):
            base = f"{tempfile.gettempdir()}/checkpoints"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base.rstrip("/")


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, system = _file(spark, path)
    return system.exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    target, system = _file(spark, path)
    system.delete(target, True)


@atexit.register
def drop_scratch() -> None:
    """Deletes the scratch tables of this process; a session that is already gone leaves them."""
    while _tables:
        spark, name = _tables.pop()
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _made:
        spark, path = _made.pop()
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            drop_path(spark, path)


def forget_table(spark: SparkSession, name: str) -> None:
    """Takes a table of files that stay out of the catalog when this process ends."""
    _tables.append((spark, name))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when this process ends."""
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage is cut, and any executor can read it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"{name}_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and the bytes of an Arrow batch, unless the session sets such bounds itself.

    The bounds stay in the session: results are lazy, and they have to hold when the results are read."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shards_for(spark: SparkSession, n_bytes: int) -> int:
    """Groups for a shuffle whose groups a task holds whole: one for each SHARD_BYTES of input at least."""
    return max(tasks(spark), -(-n_bytes // SHARD_BYTES))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): text null counts as empty; key tells rows of one id with different texts apart.

    A null id sorts after every other id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    return docs.select(ident.alias("id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], uses: str, total: int | None = None) -> DataFrame:
    """rows joined with table, which has one row a key and in `uses` how many rows use it; rows without a key there are left out.

    Keys that fill more than a quarter of an even task meet their rows by broadcast, so that none of them fills a task:
    as uses add up to no more than all rows, there are at most four such keys a task. All others are shuffled."""
    total = rows.count() if total is None else total
    least = max(100, total // (4 * tasks(rows.sparkSession)))
    hot = F.broadcast(table.where(F.col(uses) > least))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(uses) <= least), keys)
    return rows.join(hot, keys).unionByName(cold)


#: Bits of `without`'s bitmap for each row of gone, and the most bits that are broadcast (32 MB).
_BITS, _MOST_BITS = 32, 1 << 28


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are not in gone, as by a left anti-join, but only rows that may be in it are shuffled.

    A bitmap of bounded size marks the hashes of gone's first key. Rows whose place is not marked stay where they are; the
    others (all that go, and about one of 32 besides, more where gone has over 8 million rows) are joined on all keys.
    Both sides are read twice, so gone is best a scratch table. A null first key is in no gone row."""
    bits = min(_MOST_BITS, max(1 << 15, 1 << (_BITS * gone.count()).bit_length()))
    number, bitmap, marked = (fresh(rows, c) for c in ("number", "bitmap", "marked"))
    place = F.pmod(F.xxhash64(F.lit(37), keys[0]), F.lit(bits)) + 1
    maps = gone.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias(number)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(bitmap))
    seen = rows.withColumn(number, F.bitmap_bucket_number(place)).join(F.broadcast(maps), number, "left")
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    seen = seen.withColumn(marked, F.coalesce(F.getbit(byte, at % 8), F.lit(0).cast("tinyint"))).select(*rows.columns, marked)
    some = seen.where(F.col(marked) == 1).join(gone.select(*keys), keys, "left_anti")
    return seen.where(F.col(marked) == 0).unionByName(some).select(*rows.columns)


def salted_rank(df: DataFrame, group: list[str], order: list[Column], salts: int = 64, attach: DataFrame | None = None) -> DataFrame:
    """Adds rank (from 0) within each group by a seeded hash of `order`, then by `order` itself.

    No group meets in one task: the hash cuts each into `salts` ranges, ranges are counted (with map-side
    combine), and only rows of one range are sorted together; what earlier ranges hold is added. Group columns
    hold no nulls. attach: a table by group whose other columns are added (null where it has no row).
    Rows equal in `order` get different ranks in no fixed order; they can't be told apart."""
    mark = F.xxhash64(F.lit(17), *order)
    cut = df.withColumn("_mark", mark).withColumn("_salt", F.pmod(F.shiftright("_mark", 20), F.lit(salts)).cast("int"))
    counts = cut.groupBy(*group, "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if attach is not None:
        counts = counts.join(attach, group, "left")
    inside = W.partitionBy(*group, "_salt").orderBy("_mark", *order)
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1).join(counts, [*group, "_salt"])
    return ranked.withColumn("rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_rank", "_before", "_mark", "_salt")
