"""Incremental maintenance of an index: differences, upserts, versions, knowledge bases."""

from __future__ import annotations

import json
import os
import shutil
import socket
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import chunk_uuid, path_is_inside
from quillspan.operators.chunking import pack_segments
from quillspan.profiles import STATUS_EMPTY, STATUS_INDEXED
from quillspan.sources.files import list_files, read_segments

MANIFEST = "source_path string, relative_path string, source_name string, extension string, size bigint, mtime_ns bigint, sha256 string, status string, error string"
CHUNKS = "chunk_id string, source_path string, source_name string, relative_path string, extension string, location string, chunk_index int, text string"


#: Seconds after which a lock counts as left behind.
STALE_AFTER = 24 * 3600.0


def manifest_diff(listing: DataFrame, manifest: DataFrame, key: str = "source_path") -> DataFrame:
    """(key, action): new, unchanged, candidate (its size or time differs) or removed, for every file of either side."""
    cur = listing.select(key, F.col("size").alias("__s"), F.col("mtime_ns").alias("__m")).withColumn("__cur", F.lit(True))
    old = manifest.select(key, F.col("size").alias("__os"), F.col("mtime_ns").alias("__om")).withColumn("__old", F.lit(True))
    action = (
        F.when(F.col("__cur").isNull(), "removed")
        .when(F.col("__old").isNull(), "new")
        .when(F.col("__s").eqNullSafe(F.col("__os")) & F.col("__m").eqNullSafe(F.col("__om")), "unchanged")
        .otherwise("candidate")
    )
    return cur.join(old, key, "full_outer").select(key, action.alias("action"))


def judged_candidates(diff: DataFrame, hashes: DataFrame, manifest: DataFrame, key: str = "source_path") -> DataFrame:
    """The actions with candidates settled by content: touched (same hash) or changed."""
    x = diff.join(hashes.select(key, F.col("sha256").alias("__new")), key, "left").join(manifest.select(key, F.col("sha256").alias("__was")), key, "left")
    settled = F.when(F.col("action") != "candidate", F.col("action")).when(F.col("__new") == F.col("__was"), "touched").otherwise("changed")
    return x.select(key, settled.alias("action"))


def removed_files(manifest: DataFrame, listing: DataFrame, root: str | Column, key: str = "source_path") -> DataFrame:
    """Files of the manifest inside the root that are no longer listed."""
    r = F.lit(root) if isinstance(root, str) else root
    return manifest.filter(path_is_inside(key, r)).join(listing.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones whose key none of them has."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def sync_summary(actions: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """One row with the counts of a run."""
    a = actions.agg(
        F.count_if(F.col("action") != "removed").alias("scanned"),
        F.count_if(F.col("action").isin("new", "changed")).alias("processed"),
        F.count_if(F.col("action").isin("unchanged", "touched")).alias("skipped"),
        F.count_if(F.col("action") == "removed").alias("removed"),
    )
    return a.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks_added"), F.count_distinct("source_path").alias("with_text"))).crossJoin(errors.agg(F.count(F.lit(1)).alias("errors")))


def _local(path: str) -> str | None:
    u = urlparse(path)
    return unquote(u.path) if u.scheme in ("", "file") else None


class Catalog:
    """Tables as numbered versions below a folder; a pointer names the current one.

    A version is written completely before the pointer moves, so that a killed
    run leaves the former version in place and is simply run again.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._owner = spark, folder.rstrip("/"), ""
        if _local(folder) is None:
            raise ValueError("the catalog needs a mounted file system")
        os.makedirs(_local(folder), exist_ok=True)

    def _pointer(self) -> str:
        return os.path.join(_local(self.folder), "current.json")

    def versions(self) -> dict[str, str]:
        try:
            with open(self._pointer()) as f:
                return json.load(f)
        except (OSError, ValueError):
            return {}

    def read(self, table: str, schema: str) -> DataFrame:
        """The current version; an empty table if there is none."""
        at = self.versions().get(table)
        if at is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/{at}")

    def publish(self, tables: dict[str, DataFrame]) -> None:
        """Writes new versions of several tables and makes all of them current at once."""
        now = self.versions()
        for name, df in tables.items():
            at = f"{name}/v={uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{at}")
            now[name] = at
        temporary = self._pointer() + f".{uuid.uuid4().hex}"
        with open(temporary, "w") as f:
            json.dump(now, f)
        os.replace(temporary, self._pointer())

    def reset(self) -> None:
        self.publish({"manifest": self.spark.createDataFrame([], MANIFEST), "chunks": self.spark.createDataFrame([], CHUNKS)})

    def lock(self, stale_after: float = STALE_AFTER) -> None:
        """Fails if another run holds the index.

        The lock says who holds it and since when. That of a process of this
        machine that is gone, and any that is older than ``stale_after``
        seconds, is taken over; of several that try only one gets it.
        """
        path = os.path.join(_local(self.folder), "lock")
        mine = {"owner": uuid.uuid4().hex, "host": socket.gethostname(), "pid": os.getpid(), "since": time.time()}
        for _ in range(2):
            try:
                with os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    json.dump(mine, f)
                self._owner = mine["owner"]
                return
            except FileExistsError:
                if not self._is_stale(path, stale_after):
                    raise
                aside = f"{path}.{mine['owner']}"
                try:
                    os.rename(path, aside)
                    os.unlink(aside)
                except FileNotFoundError:
                    pass  # another run was quicker
        raise FileExistsError(path)

    @staticmethod
    def _is_stale(path: str, stale_after: float) -> bool:
        try:
            with open(path) as f:
                held = json.load(f)
            since, here, pid = held["since"], held["host"] == socket.gethostname(), held["pid"]
        except FileNotFoundError:
            return True
        except (ValueError, KeyError):  # half written, or by a run that was killed while it wrote
            since, here, pid = os.path.getmtime(path), False, 0
        if time.time() - since > stale_after:
            return True
        if not here:
            return False
        try:
            os.kill(pid, 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            return False
        return False

    def unlock(self) -> None:
        """Gives up the lock if this run still holds it."""
        path = os.path.join(_local(self.folder), "lock")
        try:
            with open(path) as f:
                mine = json.load(f).get("owner") == self._owner
        except (FileNotFoundError, ValueError):
            return
        if mine:
            os.unlink(path)

    def vacuum(self) -> int:
        """Deletes the versions that are no longer current; for when no reader uses them. Returns their number."""
        kept, gone = set(self.versions().values()), 0
        root = _local(self.folder)
        for table in [t for t in os.listdir(root) if os.path.isdir(os.path.join(root, t))]:
            for version in os.listdir(os.path.join(root, table)):
                if version.startswith("v=") and f"{table}/{version}" not in kept:
                    shutil.rmtree(os.path.join(root, table, version))
                    gone += 1
        return gone


def file_hashes(files: DataFrame) -> DataFrame:
    """(source_path, sha256) of the given files; only these are read."""

    def run(batches):
        import hashlib

        import pandas as pd

        for batch in batches:
            out = []
            for path in batch["source_path"]:
                h = hashlib.sha256()
                try:
                    with open(path, "rb") as f:
                        while block := f.read(1 << 20):
                            h.update(block)
                    out.append((path, h.hexdigest()))
                except OSError:
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["source_path", "sha256"])

    return files.select("source_path").mapInPandas(run, "source_path string, sha256 string")


def apply_files(catalog: Catalog, listing: DataFrame, reindex: bool = False, removed_below: str | None = None) -> dict[str, int]:
    """Brings the index up to the listed files; what isn't listed below ``removed_below`` is taken out.

    Cheap tests come first: contents are hashed only where size or time differ.
    An error keeps the file's former state except for its message, which a later
    success clears.
    """
    manifest, chunks = catalog.read("manifest", MANIFEST), catalog.read("chunks", CHUNKS)
    listing = listing.cache()
    diff = manifest_diff(listing, manifest)
    if removed_below is None:
        diff = diff.filter("action <> 'removed'")
    else:
        gone = removed_files(manifest, listing, removed_below).select("source_path", F.lit("removed").alias("action"))
        diff = diff.filter("action <> 'removed'").unionByName(gone)
    hashes = file_hashes(diff.filter(F.lit(reindex) | F.col("action").isin("new", "candidate"))).cache()
    actions = judged_candidates(diff, hashes, manifest).withColumn("action", F.when(F.lit(reindex) & (F.col("action") != "removed"), "changed").otherwise(F.col("action"))).cache()
    work = listing.join(actions.filter(F.col("action").isin("new", "changed")).select("source_path"), "source_path", "left_semi").join(hashes, "source_path", "left")
    read = read_segments(work).cache()
    errors = read.filter("error is not null").select("source_path", "error")
    good = work.join(errors.select("source_path"), "source_path", "left_anti")
    packed = pack_segments(read.filter("error is null"), ["source_path"], ["seg_idx"])
    made = packed.join(good, "source_path").select(
        chunk_uuid("source_path", "sha256", "chunk_index").alias("chunk_id"), "source_path", "source_name", "relative_path", "extension", "location", "chunk_index", "text"
    )
    with_text = made.select("source_path").distinct().withColumn("__t", F.lit(True))
    entries = good.join(with_text, "source_path", "left").select(
        *[c for c in listing.columns], "sha256", F.when(F.col("__t"), STATUS_INDEXED).otherwise(STATUS_EMPTY).alias("status"), F.lit(None).cast("string").alias("error")
    )
    touched = listing.join(actions.filter("action = 'touched'").select("source_path"), "source_path", "left_semi").join(manifest.select("source_path", "sha256", "status", "error"), "source_path")
    dropped = actions.filter("action = 'removed'").select("source_path")
    kept = upsert(manifest.join(dropped, "source_path", "left_anti"), entries.unionByName(touched), "source_path")
    failed = listing.join(errors, "source_path")
    fresh = failed.join(kept.select("source_path"), "source_path", "left_anti").select(*listing.columns, F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("status"), "error")
    noted = kept.alias("k").join(errors.alias("e"), "source_path", "left").select("source_path", *[F.col(f"k.{c}") for c in kept.columns if c not in ("source_path", "error")], F.coalesce("e.error", "k.error").alias("error"))
    # an unread new file has no size on record, so that the next run tries it again
    fresh = fresh.withColumn("size", F.lit(-1).cast("bigint"))
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    replaced = good.select("source_path").unionByName(dropped)
    summary = sync_summary(actions, made, errors).first().asDict()
    catalog.publish({"manifest": noted.select(*names).unionByName(fresh.select(*names)), "chunks": chunks.join(replaced, "source_path", "left_anti").unionByName(made)})
    for df in (listing, hashes, actions, read):
        df.unpersist()
    return summary


def sync_index(spark: SparkSession, root: str, folder: str, reindex: bool = False) -> dict[str, int]:
    """Indexes a folder tree incrementally; one run at a time. Returns the counts of the run."""
    catalog = Catalog(spark, folder)
    catalog.lock()
    try:
        return apply_files(catalog, list_files(spark, root), reindex, os.path.abspath(root))
    finally:
        catalog.unlock()


def base_stats(chunks: DataFrame) -> DataFrame:
    """Per base: sources, chunks, chunks with a vector, and whether all have one."""
    vector = F.coalesce(F.size("embedding") > 0, F.lit(False))
    return chunks.groupBy("base_id").agg(
        F.count_distinct("source_id").alias("sources"),
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(vector).alias("embedded"),
        F.bool_and(vector).alias("semantic_ready"),
    )


PORTABLE = "quillspan.base.v1"


def export_base(chunks: DataFrame, base_id: str, name: str) -> DataFrame:
    """One JSON object per chunk of a base, without vectors, for exchange; rows stay distributed."""
    own = chunks.filter(F.col("base_id") == base_id).drop("embedding")
    return own.select(F.to_json(F.struct(F.lit(PORTABLE).alias("schema"), F.lit(name).alias("base_name"), F.struct(*own.columns).alias("chunk"))).alias("value"))


def _colons(schema: str) -> str:
    """A column list as the inside of a struct type."""
    return ", ".join(f"{n}: {t}" for n, t in (c.strip().split(" ", 1) for c in schema.split(", ")))


def import_base(lines: DataFrame, chunk_schema: str, base_id: str) -> DataFrame:
    """The chunks of an exported base under a new base id, with ids of their own and without vectors.

    Fails on lines of another shape: a chunk needs its source's id, name and
    type, a location and a text. The new ids follow from the base and the old
    ids, so that a repeated import gives the same rows.
    """
    parsed = lines.select(F.from_json("value", f"schema string, base_name string, chunk struct<{_colons(chunk_schema)}>").alias("p"))
    needed = [c for c in ("source_id", "source_name", "source_type", "location", "text") if f"{c} " in f", {chunk_schema} "]
    right = (F.col("p.schema") == PORTABLE) & F.col("p.base_name").isNotNull()
    for c in needed:
        right = right & F.col(f"p.chunk.{c}").isNotNull()
    checked = parsed.select(F.when(F.coalesce(right, F.lit(False)), F.col("p.chunk")).otherwise(F.raise_error(F.lit("not an exported base"))).alias("c"))
    renewed = F.substring(F.sha2(F.concat_ws("\x01", F.lit(base_id), "chunk_id"), 256), 1, 24)
    return checked.select("c.*").withColumn("base_id", F.lit(base_id)).withColumn("chunk_id", renewed).withColumn("embedding", F.lit(None).cast("array<float>"))
