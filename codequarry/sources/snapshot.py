"""Versioned snapshots: a Parquet directory per table under a run id, published by a pointer file that is written last."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "2.4"


class Store:
    """Snapshots of one repository below a root that Spark can read and write (any Hadoop path)."""

    def __init__(self, spark: SparkSession, root: str, repo_id: str):
        self.spark, self.root, self.repo_id = spark, root.rstrip("/"), repo_id
        self.pointer = f"{self.root}/{repo_id}.current"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _put(self, path: str, text: str) -> None:
        """The file appears whole: it is written beside and renamed."""
        fs, p = self._fs(path)
        _, tmp = self._fs(f"{path}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(tmp, p)

    def _text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        return "\n".join(r.value for r in self.spark.read.text(path).collect())

    def write(self, run_id: str, tables: dict[str, DataFrame], metadata: dict, partition: dict[str, list[str]] | None = None) -> None:
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            if partition and name in partition:
                writer = writer.partitionBy(*partition[name])
            writer.parquet(f"{self.root}/{self.repo_id}/{run_id}/{name}")
        self._put(f"{self.root}/{self.repo_id}/{run_id}/metadata.json", json.dumps(metadata | {"schema_version": SCHEMA_VERSION, "repo_id": self.repo_id, "run_id": run_id}, sort_keys=True))

    def publish(self, run_id: str) -> None:
        """Readers see the former snapshot or this one."""
        self._put(self.pointer, json.dumps({"run_id": run_id, "published_at": time.time()}))

    def current(self) -> str | None:
        text = self._text(self.pointer)
        return json.loads(text)["run_id"] if text else None

    def metadata(self, run_id: str | None = None) -> dict | None:
        text = self._text(f"{self.root}/{self.repo_id}/{run_id or self.current()}/metadata.json")
        return json.loads(text) if text else None

    def table(self, name: str, run_id: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.repo_id}/{run_id or self.current()}/{name}")

    def previous(self, fingerprint: str, tables: list[str]) -> dict[str, DataFrame] | None:
        """The active snapshot's tables, if its schema and parser are today's; else everything is built anew."""
        meta = self.metadata() if self.current() else None
        if not meta or meta["schema_version"] != SCHEMA_VERSION or meta.get("fingerprint") != fingerprint:
            return None
        return {t: self.table(t) for t in tables}

    def runs(self) -> list[str]:
        fs, p = self._fs(f"{self.root}/{self.repo_id}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _age(self, run_id: str) -> float:
        """Seconds since a run's folder was last written."""
        fs, p = self._fs(f"{self.root}/{self.repo_id}/{run_id}")
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def collect_garbage(self, keep: int = 1, older_than: float = 0) -> list[str]:
        """Deletes the runs that are not the current one, nor among the `keep` latest others, nor younger than so many seconds (a build that goes on)."""
        others = sorted((r for r in self.runs() if r != self.current()), key=self._age, reverse=True)
        gone = [r for r in others[: max(0, len(others) - keep)] if self._age(r) >= older_than]
        for r in gone:
            fs, p = self._fs(f"{self.root}/{self.repo_id}/{r}")
            fs.delete(p, True)
        return gone

    def storage(self) -> DataFrame:
        """Bytes by class of run: the active one, superseded ones, and orphans without metadata."""
        rows = []
        for r in self.runs():
            fs, p = self._fs(f"{self.root}/{self.repo_id}/{r}")
            kind = "ACTIVE" if r == self.current() else "SUPERSEDED" if self.metadata(r) else "ORPHAN"
            rows.append((r, kind, fs.getContentSummary(p).getLength()))
        df = self.spark.createDataFrame(rows, "run_id string, class string, bytes long")
        return df.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def delta(previous: DataFrame, kept_keys: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The next version of a table: rows of kept keys and the changed ones."""
    return previous.join(kept_keys, key, "left_semi").unionByName(changed)


def freshness(indexed: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, state) of indexed files: fresh, changed or missing. With sizes and times on both sides, equal ones spare the hash."""
    now = listing.select("path", *[F.col(c).alias(f"new_{c}") for c in listing.columns if c != "path"], F.lit(True).alias("there"))
    joined = indexed.join(now, "path", "left")
    same = F.col("new_sha256") == F.col("sha256")
    if {"size", "mtime_ns"} <= set(indexed.columns) & set(listing.columns):
        same = same | ((F.col("new_size") == F.col("size")) & (F.col("new_mtime_ns") == F.col("mtime_ns")))
    return joined.select("path", F.when(F.col("there").isNull(), "missing").when(same, "fresh").otherwise("changed").alias("state"))


def pending(indexed: DataFrame, listing: DataFrame) -> DataFrame:
    return freshness(indexed, listing).filter("state <> 'fresh'").select("path")


def repo_state(indexed: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: stale if any file changed, went or came."""
    states = freshness(indexed, listing).agg(F.coalesce(F.bool_or(F.col("state") != "fresh"), F.lit(False)).alias("touched"))
    added = listing.join(indexed, "path", "left_anti").agg((F.count("*") > 0).alias("added"))
    return states.join(F.broadcast(added)).select(F.when(F.col("touched") | F.col("added"), "stale").otherwise("fresh").alias("state"))


def reusable(previous: DataFrame, listing: DataFrame, scanned_ns: Column, racy_ns: int = 2_000_000_000) -> DataFrame:
    """Paths of which size and time are as before, and the time lies safely before the last scan: they need not be read."""
    p = previous.select("path", F.col("size").alias("p_size"), F.col("mtime_ns").alias("p_mtime"))
    return listing.join(p, "path").filter((F.col("size") == F.col("p_size")) & (F.col("mtime_ns") == F.col("p_mtime")) & (F.col("mtime_ns") < scanned_ns - racy_ns)).select("path")


def tree_signature(listing: DataFrame) -> DataFrame:
    """One digest of all paths, sizes and times: digests of rows are summed, so that no task gathers them."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime_ns").cast("string")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return listing.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string")), 256).alias("signature"))
