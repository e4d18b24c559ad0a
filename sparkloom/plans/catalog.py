"""Generations of Parquet tables under one manifest: write beside, then swap, so readers keep what they opened.

All file work goes through Spark's file system classes, so a catalog may lie in any store Spark can reach.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

PACK = "1"  # form of packs
# Bounds of unpacking a member, an archive, a manifest.
MOST_BYTES, MOST_RATIO, MOST_MANIFEST = 200 * 1024 * 1024, 100, 10 * 1024 * 1024
_SAFE = re.compile(r"[A-Za-z0-9._=+-]+")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, generation: int | None = None) -> dict:
        """Table name to folder, of a generation or the last; empty where nothing was committed."""
        known = self._manifests()
        if not known:
            return {}
        g = known[-1] if generation is None else generation
        row = self.spark.read.text(f"{self.root}/_manifest/{g:08d}.json", wholetext=True).first()
        return json.loads(row.value)

    def table(self, name: str, schema: str | None = None, generation: int | None = None) -> DataFrame:
        """A table as of a generation; a missing one is empty if its schema is given."""
        where = self.manifest(generation).get(name)
        if where is None and schema:
            return self.spark.createDataFrame([], schema)
        if where is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{where}")

    def commit(self, tables: dict[str, DataFrame], sort_by: dict[str, str] | None = None) -> int:
        """Write new folders for the given tables and then one manifest that also keeps the others; returns its number.

        The manifest is written under another name and renamed; a rename onto an existing number fails, so of two
        writers one must start again.
        """
        known = self._manifests()
        now, g = (self.manifest(known[-1]), known[-1] + 1) if known else ({}, 1)
        for name, df in tables.items():
            key = (sort_by or {}).get(name)
            out = df.repartitionByRange(key).sortWithinPartitions(key) if key else df  # narrow row-group ranges for point reads
            out.write.mode("overwrite").parquet(f"{self.root}/{name}/gen={g}")
            now[name] = f"{name}/gen={g}"
        return self._publish(now, g)

    def _publish(self, now: dict, g: int) -> int:
        self._fs.mkdirs(self._path(f"{self.root}/_manifest"))
        part = self._path(f"{self.root}/_manifest/.{g:08d}.part")
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(now, sort_keys=True).encode()))
        stream.close()
        if not self._fs.rename(part, self._path(f"{self.root}/_manifest/{g:08d}.json")):
            raise RuntimeError(f"generation {g} was committed by another writer")
        return g

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """(name, bytes) of a table folder's data files; success marks and checksums are left out."""
        listed = self._fs.listStatus(self._path(f"{self.root}/{folder}"))
        return sorted((s.getPath().getName(), s.getLen()) for s in listed if s.isFile() and not s.getPath().getName().startswith(("_", ".")))

    def status(self) -> DataFrame:
        """(name, generation, files, bytes) of the tables of the last generation, from listings alone."""
        rows = [(n, int(f.rpartition("=")[2]), *(lambda x: (len(x), sum(b for _, b in x)))(self._files(f))) for n, f in sorted(self.manifest().items())]
        return self.spark.createDataFrame(rows, "name string, generation long, files long, bytes long")

    def delete_runs(self, gone: DataFrame, key: str = "run_uuid") -> int:
        """A new generation in which no table that has the key holds rows of the runs in gone (key); others are kept as they are."""
        tables = {n: self.table(n) for n in self.manifest()}
        return self.commit({n: t.join(gone.select(key).distinct(), key, "left_anti").select(t.columns) for n, t in tables.items() if key in t.columns})

    def export_pack(self, archive: str) -> int:
        """Write the last generation's files and manifest into one ZIP for transport; returns the number of data files.

        Parquet is compressed already, so members are stored nearly as they are. Streams, so memory stays small.
        """
        java = self.spark._jvm.java.util.zip
        out = java.ZipOutputStream(self._path(archive).getFileSystem(self.spark._jsc.hadoopConfiguration()).create(self._path(archive), True))
        count, now = 0, self.manifest()
        out.setLevel(1)
        out.putNextEntry(java.ZipEntry("manifest.json"))
        out.write(bytearray(json.dumps({"schema_version": PACK, "tables": sorted(now)}).encode()))
        out.closeEntry()
        for name, folder in sorted(now.items()):
            for file, _ in self._files(folder):
                out.putNextEntry(java.ZipEntry(f"{name}/{file}"))
                data = self._fs.open(self._path(f"{self.root}/{folder}/{file}"))
                self.spark._jvm.org.apache.commons.io.IOUtils.copyLarge(data, out)
                data.close()
                out.closeEntry()
                count += 1
        out.close()
        return count

    def import_pack(self, archive: str, most: int = MOST_BYTES, ratio: int = MOST_RATIO) -> int:
        """Take a pack's tables in as a new generation; returns its number.

        A member that unpacks to more than `most` bytes, an archive that unpacks to more than `ratio` times its size
        (beyond a megabyte), a name that is not one table and one plain file, and another schema version raise
        ValueError. Files written up to then belong to no generation and are collected as garbage.
        """
        java, io = self.spark._jvm.java.util.zip, self.spark._jvm.org.apache.commons.io.IOUtils
        store = self._path(archive).getFileSystem(self.spark._jsc.hadoopConfiguration())
        left = max(1 << 20, ratio * store.getFileStatus(self._path(archive)).getLen())
        data = java.ZipInputStream(store.open(self._path(archive)))
        known = self._manifests()
        now, g = (self.manifest(known[-1]), known[-1] + 1) if known else ({}, 1)
        tables = None
        try:
            while (entry := data.getNextEntry()) is not None:
                member = entry.getName()
                if tables is None:
                    tables = self._head(member, data)
                    continue
                name, _, file = member.partition("/")
                if name not in tables or not _SAFE.fullmatch(file) or ".." in file:
                    raise ValueError(f"unsafe member {member}")
                out = self._fs.create(self._path(f"{self.root}/{name}/gen={g}/{file}"), True)
                allowed = min(most, left)
                got = io.copyLarge(data, out, 0, allowed + 1)
                out.close()
                if got > allowed:
                    raise ValueError(f"{member} unpacks to more than {allowed} bytes")
                left -= got
                now[name] = f"{name}/gen={g}"
        finally:
            data.close()
        if tables is None:
            raise ValueError("no manifest")
        return self._publish(now, g)

    def _head(self, member: str, data) -> list[str]:
        """Table names of a pack's manifest, its first member."""
        text = bytes(data.readNBytes(MOST_MANIFEST + 1))
        if member != "manifest.json" or len(text) > MOST_MANIFEST:
            raise ValueError("no manifest, or one too long")
        head = json.loads(text)
        if head.get("schema_version") != PACK or not all(_SAFE.fullmatch(n) and not n.startswith((".", "_")) for n in head["tables"]):
            raise ValueError(f"schema version {head.get('schema_version')} or unsafe names")
        return head["tables"]

    def collect_garbage(self, keep: int = 1) -> list[str]:
        """Delete folders that none of the last `keep` manifests names, and older manifests; returns the folders."""
        known = self._manifests()
        if not known:
            return []
        live = {f for g in known[-keep:] for f in self.manifest(g).values()}
        gone = []
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if s.isDirectory() and name != "_manifest":
                for d in self._fs.listStatus(s.getPath()):
                    f = f"{name}/{d.getPath().getName()}"
                    if f not in live:
                        self._fs.delete(d.getPath(), True)
                        gone.append(f)
        for g in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_manifest/{g:08d}.json"), False)
        return sorted(gone)
