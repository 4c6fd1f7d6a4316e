"""The vector index: one Parquet table in buckets by record_id, kept in step with records by content hash.

A sync compares ids, hashes and what else a row shows of its record, without reading a vector; it reads and rewrites only the buckets in which
something changed (dynamic partition overwrite), and embeds only what is new or changed in text. A bucket is replaced when its new files are written
whole, so a job that is lost before its commit leaves the index as it was; whatever of it was committed, the next sync finds what is still to be
done. Writers of different buckets don't disturb each other; of two that write one bucket the later counts, so one index has one sync
at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.errors import IndexNotBuiltError, IndexStaleError
from lodestone.functions.text import content_hash
from lodestone.operators.corpus import unique
from lodestone.operators.models import Embedder
from lodestone.sources.files import read_or_empty
from lodestone.stage import stash


def changes(records: DataFrame, stored: DataFrame) -> DataFrame:
    """record_id, change: embed, unchanged or delete. records: record_id, and text or content_hash; stored: record_id, content_hash. If both have `shown`
    there is also moved: the text is the same, what is shown of the record is not."""
    both_show = "shown" in records.columns and "shown" in stored.columns
    more = ["shown"] if both_show else []
    now = records.select("record_id", (F.col("content_hash") if "content_hash" in records.columns else content_hash("text")).alias("now"), *more)
    both = now.join(stored.select("record_id", F.col("content_hash").alias("old"), *(F.col(c).alias(f"_{c}") for c in more)), "record_id", "full_outer")
    change = F.when(F.col("now").isNull(), "delete").when(F.col("now").eqNullSafe(F.col("old")), "unchanged").otherwise("embed")
    return both.select("record_id", change.alias("change"), *([((change == "unchanged") & ~F.col("shown").eqNullSafe(F.col("_shown"))).alias("moved")] if both_show else []))


def sync_report(changed: DataFrame) -> DataFrame:
    """embedded, unchanged, deleted, total."""
    n = lambda what: F.count_if(F.col("change") == what)
    return changed.agg(n("embed").alias("embedded"), n("unchanged").alias("unchanged"), n("delete").alias("deleted"), (n("embed") + n("unchanged")).alias("total"))


COLUMNS = [f.split()[0] for f in schemas.INDEX.split(", ")]
#: What a row shows of its record besides the text: if only this changes, the vector stays.
SHOWN = ["parent_id", "content_type", "title", "start_page", "end_page"]
META = f"{schemas.INDEX_META}, buckets int"
#: Rows that a bucket has when the index is written whole; with more than GROWTH times as many it is written whole again.
BUCKET_ROWS, GROWTH = 1 << 16, 4


class VectorIndex:
    """An index at a path that Spark can read and write."""

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows

    def _meta(self) -> Row | None:
        return read_or_empty(self.spark, f"{self.path}/meta", META).first()

    def exists(self) -> bool:
        return self._meta() is not None

    def metadata(self) -> dict:
        """Model, dimension and fingerprint; {} if there is no index."""
        found = self._meta()
        return {k: found[k] for k in ("embedding_model", "embedding_dimension", "embedding_fingerprint")} if found else {}

    def _table(self) -> DataFrame:
        """All rows with their bucket. A row without record_id holds a bucket's place that has none."""
        return read_or_empty(self.spark, f"{self.path}/rows", f"{schemas.INDEX}, bucket int") if self.exists() else self.spark.createDataFrame([], f"{schemas.INDEX}, bucket int")

    def rows(self) -> DataFrame:
        return self._table().where("record_id is not null").drop("bucket")

    def existing(self) -> DataFrame:
        return self.rows().select("record_id", "content_hash")

    def count(self) -> int:
        return self.rows().count()

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, buckets: int, mode: str) -> None:
        """rows: COLUMNS and bucket. A bucket's rows come from one task, so it is one file."""
        rows.repartitionById(buckets, F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(f"{self.path}/rows")

    def put(self, rows: DataFrame, meta: dict, n: int | None = None) -> None:
        """Makes rows the index, written whole. n: their number, if it is known and they are not read from this index."""
        rows = rows.select(*COLUMNS)
        if n is None:
            rows = stash(rows, "index-rows")
            n = rows.count()
        buckets = max(1, -(-n // self.bucket_rows))
        self._write(rows.select("*", self._bucket(buckets)), buckets, "static")
        row = [(meta.get("embedding_model"), meta.get("embedding_dimension"), meta.get("embedding_fingerprint"), buckets)]
        self.spark.createDataFrame(row, META).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")

    def _part(self, ids: DataFrame, buckets: int) -> tuple[list[int], DataFrame]:
        """The buckets of some ids, and the rows there now."""
        touched = sorted(r.bucket for r in ids.select(self._bucket(buckets)).distinct().collect())  # as many as buckets at most
        return touched, self._table().where(F.col("bucket").isin(touched) & F.col("record_id").isNotNull())

    def _replace(self, touched: list[int], old: DataFrame, buckets: int, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Makes old, with these rows put in and without the ids that are gone, all that these buckets have. One shuffle brings a bucket together: there a row
        takes the place of the one it replaces. An empty bucket keeps a row without an id: one without rows would not be replaced."""
        if not touched:
            return
        x = self.spark.createDataFrame([(b, 0) for b in touched], "bucket int, _rank int")
        for rank, part in enumerate((old, rows, gone)):
            if part is not None:
                x = x.unionByName(part.select(*(c for c in COLUMNS if c in part.columns), self._bucket(buckets), F.lit(rank).alias("_rank")), allowMissingColumns=True)
        first = F.row_number().over(Window.partitionBy("bucket", "record_id").orderBy(F.desc("_rank")))
        last = x.repartitionById(buckets, F.col("bucket")).withColumn("_nth", first).where("_nth = 1 and _rank < 2")
        last.select(*COLUMNS, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")

    def upsert(self, rows: DataFrame) -> None:
        """Puts in these rows, each record_id once; only their buckets are read and written."""
        rows, buckets = stash(rows.select(*COLUMNS), "index-rows"), self._meta().buckets
        touched, old = self._part(rows, buckets)
        self._replace(touched, old, buckets, rows)

    def delete(self, ids: DataFrame) -> None:
        ids, buckets = stash(ids.select("record_id"), "index-ids"), self._meta().buckets
        touched, old = self._part(ids, buckets)
        self._replace(touched, old, buckets, gone=ids)

    def reset(self) -> None:
        if self.exists():
            self._write(self._table().limit(0), 1, "static")
            self.spark.createDataFrame([], META).write.mode("overwrite").parquet(f"{self.path}/meta")

    def sync(self, records: DataFrame, embedder: Embedder, rebuild: bool = False) -> DataFrame:
        """Brings the index in step; gives the one-row report with model, dimension and rebuilt. Another model or
        fingerprint than the stored one rebuilds; an index without stored metadata goes on where it is."""
        meta, found = self.metadata(), self._meta()
        rebuild = rebuild or bool(meta.get("embedding_model")) and (meta["embedding_model"], meta["embedding_fingerprint"]) != (embedder.name, embedder.fingerprint)
        now = unique(records, "record_id").withColumn("content_hash", content_hash("text")).withColumn("start_page", F.array_min("pages")).withColumn("end_page", F.array_max("pages"))
        old = self.rows().limit(0) if rebuild else self.rows()
        shown = lambda df: df.select("record_id", "content_hash", F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in SHOWN)).alias("shown"))
        changed = stash(changes(shown(now), shown(old)), "index-changes")
        report = sync_report(changed).first()
        own = {"embedding_model": embedder.name, "embedding_dimension": embedder.dimension, "embedding_fingerprint": embedder.fingerprint}
        if rebuild or not found:
            self.put(now.withColumn("embedding", embedder.documents(F.col("text"))), own, report.total)
        elif report.total > GROWTH * found.buckets * self.bucket_rows:
            kept = old.join(changed.where("change = 'unchanged' and not moved"), "record_id", "left_semi")
            self.put(kept.select(*COLUMNS).unionByName(self._altered(now, old, changed, embedder)), own)
        else:
            touched, part = self._part(changed.where("change != 'unchanged' or moved"), found.buckets)
            if touched:
                self._replace(touched, part, found.buckets, self._altered(now, part, changed, embedder), changed.where("change = 'delete'"))
            if any(meta[k] != v for k, v in own.items()):
                self.spark.createDataFrame([(*own.values(), found.buckets)], META).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        return self.spark.createDataFrame([(*report, embedder.name, embedder.dimension, rebuild)], "embedded long, unchanged long, deleted long, total long, model string, dimension int, rebuilt boolean")

    def _altered(self, now: DataFrame, old: DataFrame, changed: DataFrame, embedder: Embedder) -> DataFrame:
        """The rows that differ from the index's: embedded, or with the old vector where the text is the same. Rows that stay are not among them."""
        new = now.join(changed.where("change = 'embed'"), "record_id", "left_semi").withColumn("embedding", embedder.documents(F.col("text"))).select(*COLUMNS)
        if not changed.where("moved").head(1):
            return new
        vectors = old.join(changed.where("moved"), "record_id", "left_semi").select("record_id", "embedding")
        return new.unionByName(now.join(vectors, "record_id").select(*COLUMNS))

    def guard(self, embedder: Embedder) -> None:
        """Raises unless the index can answer this embedder's questions. Missing metadata passes."""
        if not self.exists():
            raise IndexNotBuiltError(self.path)
        meta = self.metadata()
        stored = (meta.get("embedding_model"), meta.get("embedding_fingerprint"))
        if stored[0] and stored != (embedder.name, embedder.fingerprint):
            raise IndexStaleError(f"{stored[0]}/{stored[1]}", f"{embedder.name}/{embedder.fingerprint}")
