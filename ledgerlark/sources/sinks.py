"""Sinks: insert if absent, merge, prune, run log, in batch and per micro-batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def only_new(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known, one per key. Their number is what a conflict-ignoring insert reports as new."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def insert_absent(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the new rows to a parquet table and returns how many there are (`inserted`)."""
    spark = rows.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = rows.where("false")
    new = only_new(rows, existing, key)
    before = existing.count()
    new.select(rows.columns).write.mode("append").parquet(path)
    return spark.range(1).select((F.lit(spark.read.parquet(path).count()) - before).alias("inserted"))


def foreach_batch(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch sink without unbounded state: what is known is the table itself; a replayed batch adds nothing."""
    return lambda df, _: insert_absent(df, path, key) and None


def merge(current: DataFrame, incoming: DataFrame, key: str, prefer: Callable[[str], Column] | None = None) -> DataFrame:
    """Full outer merge by key: a new value that is not null replaces the old one; rows of either side stay."""
    i = incoming.select(F.col(key), F.struct(*[c for c in incoming.columns if c != key]).alias("_new"), F.lit(True).alias("_in"))
    out = current.join(i, key, "full_outer")
    pick = prefer or (lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(c)))
    return out.select(key, *[(pick(c) if c in incoming.columns else F.col(c)).alias(c) for c in current.columns if c != key])


def merge_people(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by handle; people without a handle by full name."""
    with_, without = (lambda d: d.where("handle is not null")), (lambda d: d.where("handle is null"))
    return merge(with_(current), with_(incoming), "handle").unionByName(merge(without(current), without(incoming), "full_name"))


def merge_pools(pool: DataFrame, extra: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """Two lists of people by normalised name: a verified handle, family and role of the second win."""
    a = pool.withColumn("_k", name(F.col("full_name")))
    b = extra.select(name(F.col("full_name")).alias("_k"), *[F.col(c).alias(f"_{c}") for c in ("full_name", "handle", "famille", "role", "verif")])
    out = a.join(b, "_k", "full_outer")
    new = lambda c: F.coalesce(F.nullif(f"_{c}", F.lit("")), c)
    handle = F.when((F.col("_verif") == "ok") & F.col("_handle").isNotNull(), F.col("_handle")).otherwise(F.coalesce("handle", "_handle"))
    return out.select(F.coalesce("full_name", "_full_name").alias("full_name"), handle.alias("handle"), new("famille").alias("famille"), new("role").alias("role"))


def prune(table: DataFrame, wanted: DataFrame, children: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): rows absent from `wanted` go unless they have children; those are the skipped ones."""
    absent = table.join(wanted.select(key), key, "left_anti")
    parents = children.select(F.col(parent).alias(key)).distinct()
    gone = absent.join(parents, key, "left_anti")
    return table.join(gone.select(key), key, "left_anti"), absent.join(parents, key, "left_semi")


def create_unique(rows: DataFrame, existing: DataFrame, label: str, slug: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(created, conflicts) by slug of the label."""
    s = rows.withColumn("slug", slug(F.col(label)))
    return only_new(s, existing, "slug"), s.join(existing.select("slug"), "slug", "left_semi")


def fill_column(df: DataFrame, updates: DataFrame, key: str, column: str, overwrite: bool = False) -> DataFrame:
    """Sets a column where it is null (or everywhere) from updates by key."""
    u = updates.select(key, F.col(column).alias("_u"))
    both = (F.coalesce("_u", column) if overwrite else F.coalesce(column, "_u")).alias(column)
    return df.join(u, key, "left").select(*[both if c == column else df[c] for c in df.columns])


def run_state(log: DataFrame) -> DataFrame:
    """Latest state of each run of an append-only log (run_id, kind, status, at)."""
    return log.groupBy("run_id").agg(F.max_by("status", "at").alias("status"), F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "RUNNING", F.col("at"))).alias("completed_at"), F.first("kind").alias("kind"))


def last_completed(log: DataFrame) -> DataFrame:
    return log.where("status = 'COMPLETED'").groupBy("kind").agg(F.max("at").alias("completed_at"))


def to_archive(items: DataFrame, limit: int = 40) -> DataFrame:
    """The newest items that have no receipt yet."""
    return items.where("archived_at is null").orderBy(F.desc("id")).limit(limit)


def apply_receipts(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """Marks items for which a receipt came (id, snapshot_url, at)."""
    r = receipts.where("snapshot_url is not null").select("id", F.col("snapshot_url").alias("_s"), F.col("at").alias("_t"))
    return items.join(r, "id", "left").withColumn("archived_at", F.coalesce("archived_at", "_t")).withColumn("snapshot_url", F.coalesce("snapshot_url", "_s")).drop("_s", "_t")


def archive_stats(selected: DataFrame, receipts: DataFrame) -> DataFrame:
    out = selected.join(receipts, "id", "left")
    return out.agg(F.count(F.lit(1)).alias("considered"), F.count("snapshot_url").alias("archived"), F.count_if(F.coalesce("created", F.lit(False))).alias("created"), F.count_if(F.col("snapshot_url").isNull()).alias("failed"))


def snapshots(pages: DataFrame, folder: str, url: str = "url", html: str = "html") -> DataFrame:
    """Each page as folder/<sha256 of its address>.html; (url, path, created), where created is false if the file was there.

    Written by the tasks when the result is used, through pyarrow, so the folder may be in any store
    that it reaches; on a cluster it must be a shared one. A file appears whole, under its name, by a
    rename: a task that runs again finds it. Rows without address or html give nothing.
    """
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where("url is not null and html is not null")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root)
        for batch in batches:
            paths, created = [], []
            for address, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                path = f"{root.rstrip('/')}/{hashlib.sha256(address.encode()).hexdigest()}.html"
                new = store.get_file_info(path).type == fs.FileType.NotFound
                if new:
                    part = f"{path}.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as out:
                        out.write(page.encode())
                    store.move(part, path)
                paths.append(path), created.append(new)
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(paths, pa.string()), pa.array(created, pa.bool_())], ["url", "path", "created"])

    return rows.mapInArrow(write, "url string, path string, created boolean")


#: Rows of a dimension table that may become one JSON document.
DOCUMENT_ROWS = 100_000


def json_document(df: DataFrame, path: str, *order: str) -> None:
    """A dimension table (people, sources, cookies) as one JSON array in one text file below `path`; a larger table is refused."""
    rows = df.select(F.row_number().over(Window.orderBy(*order)).alias("k"), F.struct(*df.columns).alias("r")) if order else df.select(F.lit(0).alias("k"), F.struct(*df.columns).alias("r"))
    if df.limit(DOCUMENT_ROWS + 1).count() > DOCUMENT_ROWS:
        raise ValueError(f"more than {DOCUMENT_ROWS} rows; write lines instead")
    every = F.transform(F.array_sort(F.collect_list(F.struct("k", F.to_json("r", {"ignoreNullFields": "false"}).alias("j")))), lambda x: x["j"])
    rows.agg(F.concat(F.lit("["), F.array_join(every, ","), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    """A table of any size as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def conform(df: DataFrame, schema) -> DataFrame:
    """Columns of a schema, missing ones as null: additive evolution."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def schema_diff(spark, expected: dict[str, list[str]], actual: dict[str, list[str]]) -> DataFrame:
    """Missing tables and columns as rows."""
    rows = [(t, None) for t in expected if t not in actual] + [(t, c) for t, cs in expected.items() if t in actual for c in cs if c not in actual[t]]
    return spark.createDataFrame(rows, "table string, missing_column string")
