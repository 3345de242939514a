"""Saves of many tables that become visible together or not at all.

A save writes its new rows into folders of its own and then puts one manifest in place, named
by the version after the one that the saver has seen.  Putting it in place is one rename that
never replaces a file, so of two savers that have seen the same version one is refused, and a
save that dies before it leaves nothing that a reader meets.  Readers follow the newest
manifest alone; a version once read stays readable as it was.

Tables are saved in the order in which they refer to one another; what a row refers to must be
stored or come in the same save.  Rows whose id is stored with equal content are left out, so
a save can be repeated; other content is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.operators.store import StoreError, conflicting_rows, new_rows
from provloom.storage import attach

#: The tables of a state, each after those it refers to.
TABLES = ["projects", "contracts", "functions", "state_variables", "assets", "roles", "dependencies", "relationships", "facts", "observations", "assumptions", "hypotheses", "evidence", "traceability"]
#: Columns that refer to rows of another table.
REFERENCES = {("functions", "contract_id"): "contracts", ("state_variables", "contract_id"): "contracts", ("assets", "contract_id"): "contracts", ("roles", "contract_id"): "contracts"}
#: Fixed value: the schema that a saved state has.
SCHEMA_VERSION = "recon-state/v1"


@dataclass(frozen=True)
class Manifest:
    """What one version holds: the folders of each table, and values by name."""

    version: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)


class StateStore:
    """Versions of a state under ``root``, a folder that every executor reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = attach(spark), root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._fs.Path("/".join((self.root, *parts)))

    def _versions(self) -> list[int]:
        folder = self._path("versions")
        fs = folder.getFileSystem(self._conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or the one asked for; 0 is the empty state."""
        known = self._versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return Manifest()
        if version not in known:
            raise StoreError("EntityNotFound", {"version": version})
        path = self._path("versions", f"{version:012d}.json")
        stream = path.getFileSystem(self._conf).open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _publish(self, made: Manifest) -> None:
        """One rename, which fails where the version is there already."""
        staged, final = self._path("staged", f"{uuid.uuid4().hex}.json"), self._path("versions", f"{made.version:012d}.json")
        fs = final.getFileSystem(self._conf)
        fs.mkdirs(final.getParent())
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(made.__dict__).encode()))
        out.close()
        if made.version in self._versions():  # some local file systems would replace it
            fs.delete(staged, False)
            raise StoreError("VersionConflict", {"version": made.version})
        jvm = self.spark._jvm
        none = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._fs.FileContext.getFileContext(final.toUri() if final.isAbsoluteAndSchemeAuthorityNull() else fs.getUri(), self._conf).rename(staged, final, options)
        except Exception as error:
            fs.delete(staged, False)
            if made.version in self._versions():
                raise StoreError("VersionConflict", {"version": made.version}) from error
            raise

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """Rows of a table as of a version; None where the version has no such table."""
        folders = self.manifest(version).folders.get(table)
        return self._table(folders) if folders else None

    def _table(self, folders: list[str]) -> DataFrame:
        first = self.spark.read.parquet(f"{self.root}/{folders[0]}")
        return self.spark.read.schema(first.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def load(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of a version, those of a state in their order first."""
        found = self.manifest(version).folders
        return {t: self._table(found[t]) for t in [*TABLES, *sorted(set(found) - set(TABLES))] if t in found}

    def meta(self, key: str, version: int | None = None) -> str | None:
        return self.manifest(version).meta.get(key)

    def _broken(self, table: str, rows: DataFrame, fresh: dict[str, DataFrame], base: Manifest) -> None:
        """Refuses rows that refer to nothing."""
        for (name, column), target in REFERENCES.items():
            if name != table or column not in rows.columns:
                continue
            known = [x.select(F.col("id").alias(column)) for x in (fresh.get(target), self._table(base.folders[target]) if target in base.folders else None) if x is not None]
            asked = rows.where(F.col(column).isNotNull()).select(column).distinct()
            for k in known:
                asked = asked.join(k, column, "left_anti")
            lost = asked.limit(5).collect()
            if lost:
                raise StoreError("InvalidSourceReference", {"table": table, "column": column, "ids": sorted(r[0] for r in lost)})

    def save(self, tables: dict[str, DataFrame], *, seen: int | None = None, meta: dict[str, str] | None = None) -> Manifest:
        """Save ``tables`` (each with ``id``) as one new version and return it.

        ``seen`` is the version that the caller has worked from; where a newer one stands, the save
        is refused with VersionConflict, before or when the manifest is put in place.
        """
        base = self.manifest()
        if seen is not None and seen != base.version:
            raise StoreError("VersionConflict", {"seen": seen, "stored": base.version})
        number, folders = uuid.uuid4().hex, {t: list(f) for t, f in base.folders.items()}
        fresh: dict[str, DataFrame] = {}
        for table in [*[t for t in TABLES if t in tables], *sorted(set(tables) - set(TABLES))]:
            patch = tables[table]
            stored = self._table(folders[table]) if table in folders else patch.limit(0)
            clash = conflicting_rows(stored, patch).limit(5).collect()
            if clash:
                raise StoreError("DuplicateCanonicalEntity", {"table": table, "ids": sorted(r[0] for r in clash)})
            folder = f"data/{table}/{number}"
            new_rows(stored, patch).write.parquet(f"{self.root}/{folder}")
            fresh[table] = self.spark.read.schema(patch.schema).parquet(f"{self.root}/{folder}")
            self._broken(table, fresh[table], fresh, base)
            if not fresh[table].isEmpty() or table not in folders:
                folders[table] = [*folders.get(table, []), folder]
        made = Manifest(base.version + 1, folders, base.meta | {"schema_version": SCHEMA_VERSION} | (meta or {}))
        self._publish(made)
        return made

    def compact(self, table: str) -> Manifest:
        """A version in which the table lies in one folder; its rows are the same."""
        base = self.manifest()
        folder = f"data/{table}/{uuid.uuid4().hex}"
        self._table(base.folders[table]).write.parquet(f"{self.root}/{folder}")
        made = Manifest(base.version + 1, base.folders | {table: [folder]}, base.meta)
        self._publish(made)
        return made

    def unreferenced(self) -> list[str]:
        """Folders that no version names: what saves that died, or were refused, have left."""
        named = {f for v in self._versions() for fs in self.manifest(v).folders.values() for f in fs}
        data = self._path("data")
        fs = data.getFileSystem(self._conf)
        found = [f"data/{t.getPath().getName()}/{s.getPath().getName()}" for t in (fs.listStatus(data) if fs.exists(data) else []) for s in fs.listStatus(t.getPath())]
        return sorted(set(found) - named)

    def remove_unreferenced(self) -> list[str]:
        """Deletes them; only while no save is under way."""
        gone = self.unreferenced()
        for folder in gone:
            path = self._path(folder)
            path.getFileSystem(self._conf).delete(path, True)
        return gone
