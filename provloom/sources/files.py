"""Source trees: a recursive scan with globs, size limits and content hashes."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.operators.scope import ALWAYS_EXCLUDED, inventory
from provloom.operators.store import StoreError
from provloom.storage import Scratch, attach


@dataclass
class ScanConfig:
    """Fixed defaults: what is included, and the limits of files."""

    root: str
    includes: list[str] = field(default_factory=lambda: ["**/*.sol"])
    excludes: list[str] = field(default_factory=list)
    max_file_bytes: int = 2 * 1024 * 1024
    max_files: int = 5000
    never: list[str] = field(default_factory=list)  # more folders that are never scanned


REMOTE = ("hdfs:", "s3", "gs:", "abfs", "viewfs:")


def _entries(root: str, apart: list[str]):
    """Entries of folders (path below the root), as (path, kind, real, bytes, apart).

    Links are resolved by ``realpath``; in folders that stand ``apart``, and where one would lead
    to such a name, they are left out.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for folder, inside in zip(batch.column("path").to_pylist(), batch.column("apart").to_pylist()):
                for entry in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name):
                    path = f"{folder}/{entry.name}" if folder else entry.name
                    if entry.is_symlink() and (inside or entry.name in apart):
                        continue
                    real = os.path.realpath(entry.path)
                    kind = "folder" if os.path.isdir(real) else "file" if os.path.isfile(real) else None
                    if kind:  # not so a link that leads nowhere, or what is no plain file
                        rows.append((path, kind, real, os.path.getsize(real) if kind == "file" else 0, inside or (kind == "folder" and entry.name in apart)))
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["path", "kind", "real", "bytes", "apart"])

    return run


def walk(spark: SparkSession, root: str, apart: list[str]) -> DataFrame:
    """(path, real, bytes) of the files below a local root that all executors reach, folder by folder.

    Every folder is walked once, by the shortest and then least of its paths, however many
    links lead to it, so loops of links end.  In folders named in ``apart`` no link is followed.
    """
    scratch = Scratch(spark, "walk")
    seen = scratch.keep(spark.createDataFrame([("", os.path.realpath(root), False)], "path string, real string, apart boolean"), "folders-0")
    frontier, files, depth = seen, None, 0
    while True:
        depth += 1
        met = scratch.keep(frontier.select("path", "apart").mapInArrow(_entries(root, apart), "path string, kind string, real string, bytes long, apart boolean"), f"met-{depth}")
        here = met.where("kind = 'file'").select("path", "real", "bytes")
        files = here if files is None else files.unionByName(here)
        fresh = met.where("kind = 'folder'").groupBy("real", "apart").agg(F.min("path").alias("path")).join(seen.select("real", "apart"), ["real", "apart"], "left_anti").select("path", "real", "apart")
        frontier = scratch.keep(fresh, f"folders-{depth}")
        if frontier.isEmpty():
            return files
        seen = seen.unionByName(frontier)


def listing(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """(path, bytes, rule, location) of the files under the root; no content is read.

    In a local tree links are followed; where a file that would be kept has its real place
    outside the real root, the tree is refused with RootEscape.
    """
    never = [*ALWAYS_EXCLUDED, *config.never]
    if config.root.startswith(REMOTE):
        root = config.root.rstrip("/")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
        plain = F.substr("path", F.lit(len(root) + 2))
        files = found.select(plain.alias("path"), F.col("length").alias("bytes"), F.col("path").alias("location"))
        return inventory(files, config.includes, config.excludes, config.max_file_bytes, never)
    root = os.path.abspath(config.root.removeprefix("file://"))
    files = walk(spark, root, never).select("path", "bytes", F.col("real").alias("location"))
    listed = inventory(files, config.includes, config.excludes, config.max_file_bytes, never)
    inside = F.startswith("location", F.lit(os.path.realpath(root).rstrip("/") + "/"))
    escaped = listed.where((F.col("rule").isNull() | F.col("rule").startswith("limit:")) & ~inside).agg(F.min("path").alias("path")).first()
    if escaped["path"] is not None:
        raise StoreError("RootEscape", {"path": escaped["path"]})
    return listed


def _digests(batches):
    """sha256 of local files, a piece at a time."""
    for batch in batches:
        found = []
        for place in batch.column("location").to_pylist():
            with open(place, "rb") as f:
                found.append(hashlib.file_digest(f, "sha256").hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("location"), pa.array(found, pa.string())], names=["location", "sha256"])


def hashes(spark: SparkSession, listed: DataFrame, config: ScanConfig) -> DataFrame:
    """(location, sha256) of files that are kept; in a remote store of ``max_files`` and one at most, named to the reader."""
    kept = listed.where("rule is null").select("location").distinct()
    if not config.root.startswith(REMOTE):
        return kept.mapInArrow(_digests, "location string, sha256 string")
    names = [r["location"] for r in kept.limit(config.max_files + 1).collect()]
    if not names:
        return kept.select("location", F.lit(None).cast("string").alias("sha256"))
    return spark.read.format("binaryFile").load(names).select(F.col("path").alias("location"), F.sha2("content", 256).alias("sha256"))


def scan(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """Files under the root as (path, bytes, sha256, rule); only what is kept is read and hashed."""
    listed = listing(attach(spark), config)
    return listed.join(hashes(spark, listed, config), "location", "left").select("path", "bytes", "sha256", "rule")


def parse_config(raw: dict) -> ScanConfig:
    """A config of known fields of the right kinds; anything else is refused."""
    kinds = {"root": str, "includes": list, "excludes": list, "max_file_bytes": int, "max_files": int, "never": list}
    wrong = [k for k, v in raw.items() if k not in kinds or not isinstance(v, kinds[k]) or (kinds[k] is list and not all(isinstance(x, str) for x in v)) or (kinds[k] is int and (isinstance(v, bool) or v < 1))]
    if wrong or not raw.get("root"):
        raise StoreError("SchemaValidationFailed", {"fields": sorted(wrong) or ["root"]})
    return ScanConfig(**raw)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON document with one array of records; a malformed one is refused as InvalidReconState."""
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    scratch = Scratch(spark, "state")
    try:
        return scratch.keep(read, "read")
    except Exception as error:
        raise StoreError("InvalidReconState", {"path": path}) from error


def discover(spark: SparkSession, config: ScanConfig) -> tuple[DataFrame, DataFrame]:
    """(files, issues): what is analyzed, and an issue for every file over the size limit.

    Refused are a tree of no matching file (NoSourcesFound), of more than ``max_files``, too
    large ones counted (SourceLimitExceeded), and one that leads out of its root (RootEscape).
    """
    found = scan(spark, config)
    matched = found.where("rule is null or rule like 'limit:%'")
    many = matched.limit(config.max_files + 1).count()
    if many == 0:
        raise StoreError("NoSourcesFound", {"root": config.root})
    if many > config.max_files:
        raise StoreError("SourceLimitExceeded", {"limit": config.max_files})
    files = found.where("rule is null").select("path", "bytes", "sha256")
    large = found.where("rule = 'limit:maxFileBytes'")
    issues = large.select(F.lit("RECOVERABLE").alias("severity"), F.lit("file_too_large").alias("code"), F.col("path").alias("file"))
    return files, issues
