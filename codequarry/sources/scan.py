"""Sources: source trees, JSON lines, TOML registries, entry points, VCS heads."""

from __future__ import annotations

import fnmatch
import pathlib
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T

MAX_BYTES, MAX_FILES = 2_000_000, 25_000


def ignore_regex(patterns: list[str]) -> list[tuple[str, bool]]:
    """Regular expressions of gitignore lines, in order, each with whether it excludes (else it includes again)."""
    out = []
    for line in patterns:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        exclude = not line.startswith("!")
        line = line.lstrip("!")
        rooted, folder = "/" in line.rstrip("/"), line.endswith("/")
        body = ""
        for part in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?)", line.strip("/")):
            body += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
        out.append((("^" if rooted else "(?:^|.*/)") + body + ("/.*$" if folder else "(?:/.*)?$"), exclude))
    return out


def _listed(spark: SparkSession, root: str, ignore: list[str] | None, max_bytes: int, only: list[str] | None) -> DataFrame:
    """The file source's rows below `root` that no rule excludes, with the path from the root as `rel`. Contents are read only if a plan uses them."""
    escaped = None if only is None else [f"{root.rstrip('/')}/" + re.sub(r"([\\*?{}\[\]])", r"\\\1", p) for p in only]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root if escaped is None else escaped)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString()
    path = F.regexp_replace(F.col("path"), "^" + re.escape(base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file:///") else base) + "/?", "")
    path = F.regexp_replace(path, "^" + re.escape(base) + "/?", "")
    listing = raw.filter(F.col("length") <= max_bytes).withColumn("rel", path).filter(~T.hard_denied(F.col("rel")))
    gone = F.lit(False)
    for pattern, exclude in ignore_regex(ignore or []):
        hit = F.col("rel").rlike(pattern)
        gone = (gone | hit) if exclude else (gone & ~hit)
    return listing.filter(~gone)


_ROW = "path string, size long, mtime_ns long, language string"


def listing(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, size, mtime_ns and language of what `tree` reads (and of binaries), without reading any content."""
    return _listed(spark, root, ignore, max_bytes, None).select(F.col("rel").alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), T.language(F.col("rel")).alias("language"))


def tree(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int = MAX_BYTES, only: list[str] | None = None) -> DataFrame:
    """path, size, mtime_ns, language and content of the files below `root` (or of `only` some) that may be indexed.

    Denied paths, ignored ones and large files go before contents are read (length and path are the file listing's own columns), then binaries."""
    if only is not None and not only:
        return spark.createDataFrame([], _ROW + ", content binary")
    kept = _listed(spark, root, ignore, max_bytes, only).filter(~T.probably_binary(F.col("content")))
    return kept.select(F.col("rel").alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), T.language(F.col("rel")).alias("language"), "content")


def count_guard(listing: DataFrame, max_files: int = MAX_FILES) -> None:
    if listing.limit(max_files + 1).count() > max_files:
        raise ValueError(f"more than {max_files} files")


def files_table(found: DataFrame) -> DataFrame:
    """The files table of a scan."""
    status = F.when(F.col("language").isNull(), "unsupported").otherwise("parsed")
    return found.select("path", F.sha2("content", 256).alias("sha256"), "size", "mtime_ns", "language", status.alias("parse_status"), F.array().cast("array<string>").alias("warnings"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines keyed by id or task_id; of equal keys the last line counts."""
    rows = spark.read.json(path)
    key = F.coalesce(*[F.col(c).cast("string") for c in ("id", "task_id") if c in rows.columns])
    numbered = rows.withColumn("__key", key).withColumn("__pos", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return numbered.groupBy("__key").agg(F.max_by(F.struct(*rows.columns), "__pos").alias("r")).select(F.col("__key").alias("key"), "r.*")


def benchmark_runs(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark runs; malformed lines, missing fields, tool errors and failed health checks are errors."""
    rows = spark.read.schema(schema.RUNS).option("mode", "FAILFAST").json(path)
    need = ["arm", "task_id", "seed", "total_tokens", "latency_seconds", "task_success"]
    bad = F.when(F.greatest(*[F.col(c).isNull() for c in need]), "a run lacks a required field").when(F.coalesce("mcp_errors", F.lit(0)) > 0, "a run had tool errors").when(F.col("mcp_health") == "failed", "a run's health check failed")
    return rows.filter(F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.lit(True)).cast("boolean"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of a TOML file: repo_id, root and the rest as a map."""
    with open(path, "rb") as f:
        config = tomllib.load(f)
    repos = config.get("repositories", [])
    rows = repos.items() if isinstance(repos, dict) else ((r.get("id"), r) for r in repos)
    return spark.createDataFrame([(k, r.get("root"), {a: str(b) for a, b in r.items()}) for k, r in rows], "repo_id string, root string, settings map<string, string>")


def entry_points(spark: SparkSession, root: str) -> DataFrame:
    """(name, target) of the scripts and entry points that a project declares."""
    path = pathlib.Path(root, "pyproject.toml")
    project = tomllib.loads(path.read_text()).get("project", {}) if path.exists() else {}
    found = dict(project.get("scripts", {}))
    for group in project.get("entry-points", {}).values():
        found |= group
    return spark.createDataFrame(sorted(found.items()), "name string, target string")


def vcs_head(root: str) -> str | None:
    """The commit a work tree stands at, read from its files."""
    git = pathlib.Path(root, ".git")
    try:
        head = (git / "HEAD").read_text().strip()
        if not head.startswith("ref: "):
            return head
        ref = git / head[5:]
        if ref.exists():
            return ref.read_text().strip()
        for line in (git / "packed-refs").read_text().splitlines():
            if line.endswith(" " + head[5:]):
                return line.split()[0]
    except OSError:
        return None
    return None


def safe_path(root: str, supplied: str) -> str:
    """A relative path inside the root, or an error: nothing absolute, no way up, no links out."""
    p = pathlib.PurePosixPath(supplied.replace("\\", "/"))
    if p.is_absolute() or ".." in p.parts or re.match(r"^[A-Za-z]:", supplied) or not p.parts:
        raise ValueError(f"unsafe path: {supplied}")
    full = pathlib.Path(root, *p.parts)
    if pathlib.Path(root).resolve() not in [full.resolve(), *full.resolve().parents]:
        raise ValueError(f"path leaves the root: {supplied}")
    return p.as_posix()


def matches_any(path: str, patterns: list[str]) -> bool:
    return any(fnmatch.fnmatchcase(path, p) for p in patterns)
