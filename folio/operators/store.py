"""The chunk store: a parquet table partitioned by ``topic_bucket``.

``ChunkStore`` keeps it as versions of its buckets: a change writes the buckets it
touches anew, and a reader takes for each bucket the version that the last commit
names.  Writing in place is not possible (a static overwrite of a path being read
fails), and a dynamic partition overwrite cannot empty a bucket, so purges would
silently keep rows.

All maintenance operators are plain DataFrame -> DataFrame joins:

* merge (upsert):  existing LEFT ANTI new ON key, UNION ALL new
* delete by ids:   existing LEFT ANTI ids ON chunk_id
* purge topics:    existing LEFT ANTI topics ON topic
* replace topics:  existing LEFT ANTI new topics ON topic, UNION ALL new

The smaller side is broadcast only after its row count is checked; otherwise
the anti join shuffles on the key (sha1 ids and topic buckets hash evenly; AQE
splits a skewed topic partition).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import py_strip

DEFAULT_BUCKETS = 64
BROADCAST_MAX_ROWS = 1_000_000
MAX_LISTED_IDS = 10_000  # ids named in a filter (1 MB of SHA-1 names)
# parquet Bloom filters on the ids, as large as each row group needs
ID_FILTERS = {"parquet.bloom.filter.enabled#chunk_id": "true",
              "parquet.bloom.filter.adaptive.enabled": "true"}


def topic_bucket(topic, buckets: int = DEFAULT_BUCKETS):
    t = F.col(topic) if isinstance(topic, str) else topic
    return F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")


def _small(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def _maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only after a bounded row count proves the side small."""
    return F.broadcast(df) if _small(df, max_rows) else df


def materialize(df: DataFrame) -> DataFrame:
    """Write a batch once to the shared folder and read it back: the size check,
    the key join (two columns) and the rewrite read the same rows, and the
    ingest pipeline is not computed again."""
    from ..session import write_shared
    return write_shared(df, "batch")


# ---------------------------------------------------------------------------
# Column defaults and provenance
# ---------------------------------------------------------------------------
def apply_defaults(chunks: DataFrame, ingested_at=None) -> DataFrame:
    """tokens -> 0, model/url/title -> '', null section -> '', ingested_at ->
    now (epoch seconds)."""
    now = ingested_at if ingested_at is not None else F.unix_timestamp()
    return (chunks
            .withColumn("tokens", F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")))
            .withColumn("embedding_model", F.coalesce("embedding_model", F.lit("")))
            .withColumn("url", F.coalesce("url", F.lit("")))
            .withColumn("title", F.coalesce("title", F.lit("")))
            .withColumn("section", F.coalesce("section", F.lit("")))
            .withColumn("ingested_at", F.coalesce(F.col("ingested_at").cast("long"), now.cast("long"))))


def dedup_new(new: DataFrame, key=("topic", "chunk_id"), order=("url", "section", "text")) -> DataFrame:
    """Rows of one batch that share a key (same-named sections of one page)
    collapse to one, deterministically (lowest ``order`` values win)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return new.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _same_key(left: DataFrame, right: DataFrame, key):
    """Null parts of a key are equal, as in a grouping."""
    return reduce(and_, (left[k].eqNullSafe(right[k]) for k in key))


def dedup_written(new: DataFrame, key=("topic", "chunk_id"), order=("url", "section", "text")) -> DataFrame:
    """``dedup_new`` of a batch that ``materialize`` wrote.

    Only the key columns are shuffled, to find the keys that repeat; only their rows
    are sorted and written once more.  The others, texts and vectors with them, stay
    where they are."""
    again = materialize(new.groupBy(*key).count().where("count > 1").select(*key))
    if again.isEmpty():
        return new
    again = _maybe_broadcast(again)
    same = _same_key(new, again, key)
    once = materialize(dedup_new(new.join(again, same, "left_semi"), key, order))
    return new.join(again, same, "left_anti").unionByName(once)


def dropped_rows(new: DataFrame, key=("topic", "chunk_id")) -> DataFrame:
    """``(topic, dropped)``: how many rows of each topic ``dedup_new`` drops."""
    per_key = new.groupBy(*dict.fromkeys(("topic", *key))).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return per_key.groupBy("topic").agg(F.sum("extra").alias("dropped"))


# ---------------------------------------------------------------------------
# Maintenance
# ---------------------------------------------------------------------------
def merge(existing: DataFrame, new: DataFrame, key=("topic", "chunk_id"), *,
          max_broadcast_rows: int = BROADCAST_MAX_ROWS, materialize_new: bool = True) -> DataFrame:
    """Upsert: rows of ``existing`` whose key appears in ``new`` are replaced.

    ``key=('chunk_id',)`` is the id-only mode, where one id replaces rows of
    any topic; ``('topic', 'chunk_id')`` keeps topics apart.  An empty
    ``new`` leaves ``existing`` unchanged.  ``new`` is materialized once
    (``materialize``) unless ``materialize_new=False``.
    """
    key = list(key)
    if materialize_new:
        new = materialize(new)
    keys = new.select(*key)
    if _small(keys, max_broadcast_rows):
        kept = existing.join(F.broadcast(keys), on=key, how="left_anti")
    else:  # the keys settle which rows stay; texts and vectors move only if many do
        stay = materialize(existing.select(*key).join(keys, on=key, how="left_anti").distinct())
        stay = _maybe_broadcast(stay, max_broadcast_rows)
        kept = existing.join(stay, _same_key(existing, stay, key), "left_semi")
    return kept.unionByName(new.select(*existing.columns))


def delete_ids(existing: DataFrame, ids: DataFrame, *,
               max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Remove rows whose ``chunk_id`` is in ``ids`` (one anti join; no
    IN-lists, no batches).  The id list is materialized once."""
    ids = materialize(ids.select("chunk_id"))
    return existing.join(_maybe_broadcast(ids, max_broadcast_rows),
                         on="chunk_id", how="left_anti")


def purge_topics(existing: DataFrame, topics: DataFrame) -> DataFrame:
    """Remove every row of the given topics (stripped)."""
    t = topics.select(py_strip(F.col("topic")).alias("topic")).distinct()
    return existing.join(_maybe_broadcast(t), on="topic", how="left_anti")


def replace_topics(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The topics present in ``new`` are replaced wholesale (stale chunks of a
    re-ingested topic disappear)."""
    t = new.select("topic").distinct()
    kept = existing.join(_maybe_broadcast(t), on="topic", how="left_anti")
    return kept.unionByName(new.select(*existing.columns))


def present_topics(chunks: DataFrame, topics: DataFrame) -> DataFrame:
    """Which of ``topics`` have at least one stored row.  The chunk side is
    semi-joined against the (small) topic list first, so only matching
    topics are aggregated."""
    t = topics.select("topic").distinct()
    return chunks.select("topic").join(_maybe_broadcast(t), "topic", "left_semi").distinct()


def is_indexed(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(topic, indexed)`` for every requested topic."""
    t = topics.select(py_strip(F.col("topic")).alias("topic")).distinct()
    present = present_topics(chunks, t).withColumn("_hit", F.lit(True))
    return (t.join(present, "topic", "left")
             .select("topic", F.coalesce(F.col("_hit"), F.lit(False)).alias("indexed")))


def missing_topics(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """Requested topics with no stored row: the ones to ingest."""
    t = topics.select(py_strip(F.col("topic")).alias("topic")).distinct()
    return t.join(present_topics(chunks, t), "topic", "left_anti")


def topic_counts(chunks: DataFrame, window: int = config.COUNT_WINDOW) -> DataFrame:
    """Exact rows per topic (map-side partial counts, then one small
    shuffle), plus the count as a capped store window would report it."""
    return (chunks.groupBy("topic").agg(F.count(F.lit(1)).alias("n_chunks"))
                  .withColumn("n_capped", F.least(F.col("n_chunks"), F.lit(window)))
                  .withColumn("capped", F.col("n_chunks") >= F.lit(window)))


def capacity_violations(chunks: DataFrame, dim: int = config.DEFAULT_DIM) -> DataFrame:
    """One row per (chunk, column) breaking a declared width (bytes) or the
    vector dimension."""
    checks = [F.when(F.octet_length(F.col(c)) > F.lit(w),
                     F.struct(F.lit(c).alias("column"), F.octet_length(F.col(c)).alias("size"),
                              F.lit(w).alias("limit")))
              for c, w in config.STORE_WIDTHS.items() if c in chunks.columns]
    if "embedding" in chunks.columns:
        checks.append(F.when(F.coalesce(F.size("embedding"), F.lit(-1)) != F.lit(dim),
                             F.struct(F.lit("embedding").alias("column"),
                                      F.size("embedding").alias("size"), F.lit(dim).alias("limit"))))
    bad = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return chunks.select("chunk_id", "topic", F.explode(bad).alias("v")).select(
        "chunk_id", "topic", "v.column", "v.size", "v.limit")


# ---------------------------------------------------------------------------
# Versioned table on the shared file system
# ---------------------------------------------------------------------------
class ChunkStore:
    """A chunk table with cheap changes and readable old versions.

    Layout::

        <root>/data/version=<n>/topic_bucket=<b>/   rows that change <n> wrote
        <root>/_commits/<n>                         the snapshot: a line ``b v`` a bucket
        <root>/meta.txt                             the number of buckets

    A change rewrites only the buckets it touches, straight into a folder of its
    own version; nothing is renamed or overwritten.  The commit record is written
    last and names, for every bucket that has rows, the version that holds them,
    so a reader opens one small file however many commits there were, and a
    crashed write (no record) is invisible.  Older versions stay readable until
    ``vacuum``.  Single writer per root, enforced by a lock file.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None,
                 max_records_per_file: int = 500_000):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = self._stored_buckets(buckets)
        self.max_records_per_file = max_records_per_file

    def _stored_buckets(self, asked: int | None) -> int:
        """The bucket count that the store was written with.  A new store takes
        the count asked for (and stores it with its first commit); a count that
        differs from the stored one is refused."""
        fs, jvm = self._fs()
        meta = self._path("meta.txt")
        if not fs.exists(meta):
            return DEFAULT_BUCKETS if asked is None else asked
        stored = int(self.spark.read.text(str(meta)).first()["value"])
        if asked is not None and asked != stored:
            raise ValueError(f"store {self.root} has {stored} buckets, not {asked}")
        return stored

    def _store_meta(self) -> None:
        fs, _ = self._fs()
        meta = self._path("meta.txt")
        if not fs.exists(meta):
            out = fs.create(meta, False)
            out.write(bytearray(str(self.buckets).encode()))
            out.close()

    # -- file system (Hadoop API: local, HDFS and object stores alike) ------
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def _path(self, *parts: str):
        _, jvm = self._fs()
        return jvm.org.apache.hadoop.fs.Path("/".join((self.root,) + parts))

    def versions(self) -> list[int]:
        """Committed versions."""
        fs, _ = self._fs()
        commits = self._path("_commits")
        if not fs.exists(commits):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(commits)]
        return sorted(int(n) for n in names if n.isdigit())

    def current_version(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def snapshot(self, version: int | None = None) -> dict[int, int]:
        """bucket -> the version holding its rows, as of ``version``; buckets
        without rows are left out."""
        committed = [v for v in self.versions() if version is None or v <= version]
        if not committed:
            return {}
        lines = self.spark.read.text(f"{self.root}/_commits/{committed[-1]}").collect()
        return {int(b): int(v) for b, v in (r["value"].split() for r in lines)}

    def bucket_of(self, topics: list[str]) -> list[int]:
        if not topics:
            return []
        df = self.spark.createDataFrame([(t,) for t in topics], "t string")
        return sorted({r[0] for r in df.select(topic_bucket("t", self.buckets)).collect()})

    # -- read ----------------------------------------------------------------
    def _schema(self):
        from pyspark.sql import types as T

        from ..schemas import CHUNKS
        return T.StructType(CHUNKS.fields + [T.StructField("topic_bucket", T.IntegerType()),
                                             T.StructField("version", T.IntegerType())])

    def _scan(self, snap: dict[int, int], buckets=None) -> DataFrame:
        """Explicit schema (a bucket version may hold no rows); only the
        snapshot's directories are listed."""
        from ..schemas import CHUNKS
        chosen = {b: v for b, v in snap.items() if buckets is None or b in buckets}
        if not chosen:
            return self.spark.createDataFrame([], CHUNKS).withColumn(
                "topic_bucket", F.lit(None).cast("int"))
        paths = [f"{self.root}/data/version={v}/topic_bucket={b}" for b, v in sorted(chosen.items())]
        return (self.spark.read.schema(self._schema()).option("basePath", f"{self.root}/data")
                .parquet(*paths).drop("version"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._scan(self.snapshot(version)).drop("topic_bucket")

    def read_buckets(self, buckets, version: int | None = None) -> DataFrame:
        return self._scan(self.snapshot(version), set(buckets)).drop("topic_bucket")

    def read_topics(self, topics: list[str], version: int | None = None) -> DataFrame:
        """Only the topics' bucket directories are listed and read; topics
        are pushed into the parquet scan."""
        df = self._scan(self.snapshot(version), set(self.bucket_of(topics)))
        return df.filter(F.col("topic").isin(*topics)).drop("topic_bucket")

    def read_topic(self, topic: str, version: int | None = None) -> DataFrame:
        return self.read_topics([topic], version)

    # -- write ---------------------------------------------------------------
    def _lock(self):
        """One writer per root: ``_lock`` is created atomically (create
        without overwrite) and removed when the write ends."""
        fs, _ = self._fs()
        lock = self._path("_lock")
        fs.mkdirs(lock.getParent())
        if not fs.createNewFile(lock):
            raise RuntimeError(f"store {self.root} is locked by another writer "
                               f"(remove {self.root}/_lock if that writer is gone)")
        return fs, lock

    def _commit(self, rows: DataFrame, buckets) -> int:
        fs, lock = self._lock()
        try:
            self._store_meta()
            return self._commit_locked(rows, buckets)
        finally:
            fs.delete(lock, False)

    def _commit_locked(self, rows: DataFrame, buckets) -> int:
        """Write ``rows`` as the new content of ``buckets`` (other buckets are
        untouched).  Rebalancing sizes the write tasks by data: a bucket holding a
        hot topic is split over many, small buckets share one; each task's rows
        are sorted by topic so files keep tight topic ranges."""
        fs, jvm = self._fs()
        before = self.snapshot()
        version = (self.current_version() or 0) + 1
        target = self._path("data", f"version={version}")
        fs.delete(target, True)  # left by a crashed, uncommitted attempt
        staged = (rows.withColumn("topic_bucket", topic_bucket("topic", self.buckets))
                      .hint("rebalance", "topic_bucket")
                      .sortWithinPartitions("topic_bucket", "topic", "chunk_id"))
        writer = staged.write.mode("errorifexists").option("maxRecordsPerFile", self.max_records_per_file)
        for key, value in ID_FILTERS.items():
            writer = writer.option(key, value)
        writer.partitionBy("topic_bucket").parquet(str(target))
        written = [st.getPath().getName() for st in fs.listStatus(target)]
        filled = {int(n.partition("=")[2]) for n in written if n.startswith("topic_bucket=")}
        after = {b: v for b, v in before.items() if b not in set(buckets)} | dict.fromkeys(filled, version)
        self._publish(version, "".join(f"{b} {v}\n" for b, v in sorted(after.items())))
        return version

    def _publish(self, version: int, text: str) -> None:
        """Write the commit record under another name, then give it its own:
        readers see all of it or nothing."""
        fs, _ = self._fs()
        draft, record = self._path("_commits", f"_{version}"), self._path("_commits", str(version))
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(record) or not fs.rename(draft, record):
            raise RuntimeError(f"version {version} of store {self.root} was committed by another writer")

    def write(self, chunks: DataFrame) -> int:
        """Replace the whole table with ``chunks`` (every bucket)."""
        return self._commit(chunks, range(self.buckets))

    def rows_of_ids(self, ids: DataFrame) -> DataFrame:
        """(chunk_id, topic_bucket) of the stored rows with one of ``ids``.

        Few ids are named in the scan's filter: row groups whose Bloom filter knows
        none of them are skipped.  More are found with a semi join over the id and
        bucket columns.
        """
        scan = self._scan(self.snapshot()).select("chunk_id", "topic_bucket")
        listed = ids.select("chunk_id").limit(MAX_LISTED_IDS + 1).collect()
        if len(listed) <= MAX_LISTED_IDS:
            return scan.where(F.col("chunk_id").isin([r.chunk_id for r in listed if r.chunk_id is not None]))
        return scan.join(_maybe_broadcast(ids.select("chunk_id")), "chunk_id", "left_semi")

    def _buckets_holding(self, ids: DataFrame) -> set[int]:
        return {r[0] for r in self.rows_of_ids(ids).select("topic_bucket").distinct().collect()}

    def upsert(self, new: DataFrame, key=("topic", "chunk_id"), *,
               materialized: bool = False) -> int:
        """Merge ``new``; only the buckets of ``new``'s topics are rewritten,
        plus, for an id-only key, the buckets already holding its ids.
        ``materialized``: ``new`` was already written once by ``materialize``."""
        if not materialized:
            new = materialize(new)
        touched = {r[0] for r in new.select(topic_bucket("topic", self.buckets))
                   .distinct().collect()}
        if "topic" not in key:
            touched |= self._buckets_holding(new)
        touched = sorted(touched)
        merged = merge(self.read_buckets(touched), new, key, materialize_new=False)
        return self._commit(merged, touched)

    def replace(self, new: DataFrame) -> int:
        new = materialize(new)
        touched = [r[0] for r in new.select(topic_bucket("topic", self.buckets)).distinct().collect()]
        return self._commit(replace_topics(self.read_buckets(touched), new), touched)

    def purge(self, topics: DataFrame) -> int:
        t = topics.select(py_strip(F.col("topic")).alias("topic")).distinct()
        touched = [r[0] for r in t.select(topic_bucket("topic", self.buckets)).distinct().collect()]
        return self._commit(purge_topics(self.read_buckets(touched), t), touched)

    def delete(self, ids: DataFrame) -> int:
        """Only buckets that hold one of the ids are rewritten (``rows_of_ids``)."""
        ids = materialize(ids.select("chunk_id"))
        touched = sorted(self._buckets_holding(ids))
        if not touched:
            return self.current_version() or 0
        return self._commit(delete_ids(self.read_buckets(touched), ids), touched)

    def vacuum(self) -> int:
        """Delete the bucket folders that the current snapshot does not read and
        the records of older commits; returns how many folders were removed."""
        fs, _ = self._fs()
        snap, current = self.snapshot(), self.current_version()
        removed = 0
        data = self._path("data")
        for st in fs.listStatus(data) if fs.exists(data) else ():
            version = int(st.getPath().getName().partition("=")[2])
            for sub in fs.listStatus(st.getPath()):
                bucket = sub.getPath().getName().partition("=")[2]
                if bucket and version <= current and snap.get(int(bucket)) != version:
                    fs.delete(sub.getPath(), True)
                    removed += 1
        for v in self.versions():
            if v < current:
                fs.delete(self._path("_commits", str(v)), False)
        return removed
