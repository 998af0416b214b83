"""The snapshot store: a sync writes the partitions that it changes, then one new manifest names those of every table.

A manifest is a numbered file that appears whole, by a rename to a name that was not there before; the highest number counts. So a
crash between any two steps leaves the snapshot before, and readers of an older one are not disturbed while its files are kept."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamdex.session import file_system

SCHEMA_VERSION = 2
# The tables and their schemas. Those of BUCKETED are cut by knowledge base and path, the others by knowledge base.
TABLES = {
    "documents": "kb string, doc_id long, path string, content string, content_hash string, extracted boolean, updated_at timestamp",
    "chunks": "kb string, chunk_id long, doc_id long, path string, ordinal int, content string, line_start int, line_end int, chunk_type string",
    "vectors": "kb string, path string, chunk_id long, embedding array<float>",
    "postings": "kb string, path string, level string, key long, term string, tf int, positions array<int>, length int",
    "lengths": "kb string, path string, level string, n long, tokens long",
    "vocabulary": "kb string, word string, frequency long",
    "nodes": "kb string, node_id string, label string, name string, type string, description string, path string",
    "edges": "kb string, src string, dst string, rel_type string, description string, source_doc string",
    "meta": "kb string, key string, value string",
}
BUCKETED = ("documents", "chunks", "vectors", "postings", "lengths")
#: How rows lie within a partition's files: postings by term, so that a search reads few pages of them.
ORDER = {"postings": ["level", "term"], "chunks": ["path", "ordinal"]}
#: Partitions of a knowledge base's large tables.
BUCKETS = 16
#: A lock of another host is taken over after so many seconds.
LEASE = 6 * 3600


def columns_of(name: str) -> list[str]:
    return [f.split()[0] for f in TABLES[name].split(", ")]


class Store:
    """Tables of the current snapshot below a folder any Hadoop file system can hold."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs, self._path = file_system(spark, self.folder)
        self.buckets = self.manifest().get("buckets", buckets)

    # files

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    # snapshots

    def _versions(self) -> list[str]:
        return [n for n in self._names(f"{self.folder}/manifests") if n.endswith(".json")]

    def manifest(self) -> dict:
        """{version, schema_version, buckets, tables: {name: {partition: folder}}} of the current snapshot; empty without one."""
        found = self._versions()
        return json.loads(self._read_text(f"{self.folder}/manifests/{found[-1]}")) if found else {}

    def current(self) -> int | None:
        return self.manifest().get("version")

    @staticmethod
    def base_part(kb: str) -> str:
        return f"{zlib.crc32(kb.encode()):08x}"

    def part(self, name: str) -> Column:
        """The partition of a row of a table."""
        base = F.lpad(F.lower(F.hex(F.crc32(F.col("kb").cast("binary")))), 8, "0")
        return F.concat(base, F.lit("-"), F.pmod(F.xxhash64("kb", "path"), F.lit(self.buckets)).cast("string")) if name in BUCKETED else base

    def read(self, name: str, bases: list[str] | None = None, parts: list[str] | None = None) -> DataFrame:
        """A table, or what lies in the partitions of some knowledge bases, or in some partitions. Other files are not opened."""
        held = self.manifest().get("tables", {}).get(name, {})
        wanted = None if bases is None else {self.base_part(b) for b in bases}
        folders = sorted(f for p, f in held.items() if (wanted is None or p.split("-")[0] in wanted) and (parts is None or p in parts))
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        df = self.spark.read.schema(TABLES[name]).parquet(*[f"{self.folder}/{f}" for f in folders])
        return df if bases is None else df.where(F.col("kb").isin(list(bases)))

    def commit(self, changes: dict[str, tuple[list[str], DataFrame]]) -> int:
        """changes: for each table the partitions that change and all rows they hold from now on. Other partitions stay as they are."""
        now = self.manifest()
        tables = {name: dict(now.get("tables", {}).get(name, {})) for name in TABLES}
        stamp = uuid.uuid4().hex[:12]
        for name, (parts, df) in changes.items():
            folder = f"data/{stamp}/{name}"
            rows = df.select(*columns_of(name)).withColumn("_part", self.part(name))
            rows = rows.repartition("_part").sortWithinPartitions("_part", *ORDER.get(name, []))
            rows.write.partitionBy("_part").parquet(f"{self.folder}/{folder}")
            for p in parts:
                tables[name].pop(p, None)
            for n in self._names(f"{self.folder}/{folder}"):
                if n.startswith("_part="):
                    tables[name][n.removeprefix("_part=")] = f"{folder}/{n}"
        version = now.get("version", 0) + 1
        self._publish({"version": version, "schema_version": SCHEMA_VERSION, "buckets": self.buckets, "tables": tables})
        self.vacuum()
        return version

    def _publish(self, manifest: dict) -> None:
        fresh, name = f"{self.folder}/manifests/{uuid.uuid4().hex}.tmp", f"{self.folder}/manifests/{manifest['version']:012d}.json"
        self._write_text(fresh, json.dumps(manifest))
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(fresh), self._path(name)):
            raise RuntimeError(f"another writer published version {manifest['version']}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last manifests, and the partitions that none of these names."""
        versions = self._versions()
        used = {f for v in versions[-keep:] for t in json.loads(self._read_text(f"{self.folder}/manifests/{v}"))["tables"].values() for f in t.values()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{v}"), False)
        for stamp in self._names(f"{self.folder}/data"):
            kept = {f for f in used if f.startswith(f"data/{stamp}/")}
            if not kept:
                self._fs.delete(self._path(f"{self.folder}/data/{stamp}"), True)
                continue
            for name in self._names(f"{self.folder}/data/{stamp}"):
                for part in self._names(f"{self.folder}/data/{stamp}/{name}"):
                    if part.startswith("_part=") and f"data/{stamp}/{name}/{part}" not in kept:
                        self._fs.delete(self._path(f"{self.folder}/data/{stamp}/{name}/{part}"), True)

    def migrate(self) -> bool:
        """Bring a snapshot of an older schema up to date; whether there was one."""
        from loamdex.operators.ingest import migrate

        now = self.manifest()
        if not now or now.get("schema_version", 0) >= SCHEMA_VERSION:
            return False
        held = now["tables"].get("documents", {})
        if held:
            docs = self.spark.read.parquet(*[f"{self.folder}/{f}" for f in sorted(held.values())])
            docs, _ = migrate(docs, now.get("schema_version", 0))
            self.commit({"documents": (list(held), docs)})
        else:
            self._publish(now | {"version": now["version"] + 1, "schema_version": SCHEMA_VERSION})
        return True

    # the single writer's lock

    def lock(self) -> bool:
        """Take the single-writer lock; False if another holds it. A lock is stale if its process on this host is gone, or after LEASE elsewhere."""
        path = f"{self.folder}/LOCK"
        for _ in range(2):
            if self._fs.createNewFile(self._path(path)):
                self._write_text(path, json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "at": time.time()}))
                return True
            if not self._stale(path):
                return False
            self._fs.delete(self._path(path), False)
        return False

    def _stale(self, path: str) -> bool:
        try:
            age = time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000
            holder = json.loads(self._read_text(path))
            if holder["host"] != socket.gethostname():
                return age > LEASE
            os.kill(int(holder["pid"]), 0)
        except (ValueError, KeyError):  # just being written, or of a writer that died then
            return age > 60
        except ProcessLookupError:
            return True
        except PermissionError:
            return False
        return False

    def unlock(self) -> None:
        self._fs.delete(self._path(f"{self.folder}/LOCK"), False)
