"""Exact dedup by a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import drop_path, forget_table, fresh, hot_join, path_exists, scratch, scratch_path, tasks, without


class DigestIndex:
    """A table (digest, keep_id, group_size, batch) at `path`, bucketed and sorted by digest.

    New data is deduplicated by a sort-merge anti-join on the digest, for which the index side is neither shuffled nor
    re-bucketed, and what is new is appended. The files outlive the session: opening the same path again registers them
    again. A batch is a folder of its own, and becomes part of the index when it is registered, which is the last step and
    writes one small file. So the part of a batch that a broken append left counts for nothing (drop_unused() deletes it),
    and a batch that is registered is not appended again. compact() makes one folder of all, with one file a bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, name: str | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = name or f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING, folder STRING) USING parquet "
            f"PARTITIONED BY (folder) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/rows'"
        )
        if path_exists(spark, f"{self.path}/rows"):
            spark.catalog.recoverPartitions(self.name)
        forget_table(spark, self.name)

    def _registered(self) -> tuple[int, dict[str, str]]:
        """(version, folder of each batch): a row a batch."""
        at = f"{self.path}/registered"
        if not path_exists(self.spark, at):
            return 0, {}
        rows = self.spark.read.schema("batch string, folder string, version int").parquet(at).collect()
        last = max((r["version"] for r in rows), default=0)
        return last, {r["batch"]: r["folder"] for r in rows if r["version"] == last and r["batch"] is not None}

    def _register(self, version: int, folders: dict[str, str]) -> None:
        rows = self.spark.createDataFrame(list(folders.items()), "batch string, folder string").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/registered/version={version}")

    def _write(self, rows: DataFrame, folder: str) -> None:
        """rows: (digest, keep_id, group_size, batch), as a new folder."""
        out = rows.select("digest", "keep_id", "group_size", "batch", F.lit(folder).alias("folder"))
        out = out.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        out.write.mode("append").insertInto(self.name)

    def rows(self) -> DataFrame:
        folders = sorted(set(self._registered()[1].values()))
        return self.spark.table(self.name).where(F.col("folder").isin(*folders) if folders else F.lit(False)).drop("folder")

    def add(self, digests: DataFrame, batch: str) -> None:
        """digests: (digest, id). Appends the digests that no other batch has; of equal ones the largest id is kept."""
        version, folders = self._registered()
        if batch in folders:
            return
        # Written first: else the anti-join would move below the aggregation, where a hot digest has all its rows.
        groups = scratch(digests.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        folder = f"batch-{uuid.uuid4().hex}"
        self._write(new.withColumn("batch", F.lit(batch)), folder)
        self._register(version + 1, folders | {batch: folder})

    def compact(self) -> None:
        """Rewrites the index as one folder; the old ones stay until drop_unused()."""
        version, folders = self._registered()
        folder = f"all-{uuid.uuid4().hex}"
        self._write(self.rows(), folder)
        self._register(version + 1, dict.fromkeys(folders, folder))

    def drop_unused(self) -> None:
        """Deletes folders that no batch is registered in. No reader of an older version may be at work."""
        used = set(self._registered()[1].values())
        for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect():
            folder = r["partition"].removeprefix("folder=")
            if folder not in used:
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (folder = '{folder}')")
                drop_path(self.spark, f"{self.path}/rows/folder={folder}")


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the whole text in UTF-8; null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, keep_id, group_size, kept) for every row of docs.

    Texts are equal when identical. Of equal texts in the batch the largest id stays, unless an earlier batch
    of the index has the text: then none stays. Null text is the empty text, which is a text like others.
    A null id is below every other; a group of null ids only has keep_id null and its rows stay. Rows repeated
    under one id are one document: kept is the same for all of them. An empty table gives an empty result."""
    found = scratch(digests_of(docs, id_col, text_col), "digests")
    index.add(found, batch)
    held = found.groupBy("digest").agg(F.count("*").alias("uses")).join(index.rows(), "digest")
    joined = hot_join(found, scratch(held, "groups"), ["digest"], "uses")
    kept = (F.col("batch") == batch) & F.col("id").eqNullSafe(F.col("keep_id"))
    return joined.select("id", "digest", "keep_id", "group_size", F.coalesce(kept, F.lit(False)).alias("kept"))


def dedup_in_batches(docs: DataFrame, index: DigestIndex, parts: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, keep_id, group_size, kept) for every row of docs, which come to the index in `parts` batches.

    Batches are ranges of ids, the largest first, null ids last. So whatever batch brings a text, the index, which later
    batches are anti-joined with, holds the largest of all its ids. group_size counts all rows of docs with the text.
    Nulls, ties, repeated rows and empty tables are as in exact_dedup."""
    found = scratch(digests_of(docs, id_col, text_col), "digests")
    cuts = found.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 1000)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or ()), reverse=True)
    for k, (low, high) in enumerate(zip([*cuts, None], [None, *cuts])):
        some = F.lit(True) if low is None else F.col("id") >= low
        some = some if high is None else some & (F.col("id") < high)
        index.add(found.where(some | F.col("id").isNull() if low is None else some), f"part {k} of {parts}")
    sizes = found.groupBy("digest").agg(F.count("*").alias("group_size"))
    held = scratch(sizes.join(index.rows().select("digest", "keep_id"), "digest"), "groups")
    joined = hot_join(found, held, ["digest"], "group_size")
    return joined.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder, for this process only."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"), max(8, tasks(spark)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document; see dedup_in_batches for nulls, empty texts, ties, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_in_batches(docs, new_index(spark))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the largest id, null ids being below all others.

    Null text is the empty text. Rows repeated under one id and text stay once. An empty table gives an empty result.
    Rows are chosen by id and digest; only then are texts read again, against the list of those that go, and only texts that
    may be in it are shuffled."""
    digests = digests_of(docs, id_col, text_col)
    # As in keyed(), null is a number that no document has, here the smallest.
    found = scratch(digests.withColumn("id", F.coalesce("id", F.lit(-(2**63)))), "digests")
    index = new_index(docs.sparkSession)
    index.add(found, "documents")
    kept = index.rows().select(F.col("keep_id").alias("id"), "digest")
    gone = scratch(found.distinct().join(kept, ["id", "digest"], "left_anti"), "gone")
    repeated = found.count() - gone.count() > kept.count() and found.join(kept, ["id", "digest"], "left_semi").count() > kept.count()
    mark, ident = fresh(docs, "digest"), fresh(docs, "keep_id")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias(ident), F.unhex(F.sha2(text, 256)).alias(mark))
    out = without(rows, gone.toDF(ident, mark), [ident, mark])
    return (out.dropDuplicates([ident, mark]) if repeated else out).select(*docs.columns)
