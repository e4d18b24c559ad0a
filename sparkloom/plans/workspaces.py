"""Named workspaces: a small registry of catalogs, and tables read over all of them at once."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog

# States, watch modes, and the bounds and default of the debounce time.
SYNC_STATES = ("idle", "pending", "patching", "error")
WATCH_MODES = ("auto", "fs", "off")
DEBOUNCE_MS = (100, 2000, 60000)


@dataclass(frozen=True)
class Workspace:
    name: str
    path: str
    watch: bool = False
    watch_mode: str = "auto"
    debounce_ms: int = DEBOUNCE_MS[1]
    sync_state: str = "idle"


def _valid(w: Workspace) -> Workspace:
    """w with a debounce time inside its bounds and known states; what is neither gets the default."""
    low, usual, high = DEBOUNCE_MS
    try:
        wait = min(max(int(w.debounce_ms), low), high)
    except (TypeError, ValueError):
        wait = usual
    return replace(w, debounce_ms=wait, sync_state=w.sync_state if w.sync_state in SYNC_STATES else "idle", watch_mode=w.watch_mode if w.watch_mode in WATCH_MODES else "auto")


class Workspaces:
    """The registry is one JSON file in any store that Spark reaches; it is written beside and renamed."""

    def __init__(self, spark: SparkSession, file: str):
        self.spark, self.file = spark, file
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(file).getFileSystem(spark._jsc.hadoopConfiguration())

    def all(self) -> list[Workspace]:
        """By name; entries without name or path are passed over, unknown fields too."""
        if not self._fs.exists(self._path(self.file)):
            return []
        rows = json.loads(self.spark.read.text(self.file, wholetext=True).first().value).get("workspaces", [])
        known = Workspace.__dataclass_fields__
        return sorted((_valid(Workspace(**{k: v for k, v in r.items() if k in known})) for r in rows if r.get("name") and r.get("path")), key=lambda w: w.name)

    def _save(self, rows: list[Workspace]) -> None:
        part = self._path(self.file + ".part")
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps({"workspaces": [asdict(r) for r in rows]}, sort_keys=True).encode()))
        stream.close()
        self._fs.delete(self._path(self.file), False)
        self._fs.rename(part, self._path(self.file))

    def add(self, w: Workspace) -> Workspace:
        """Add, or replace the one of that name; another name for the same path raises ValueError."""
        rest = [x for x in self.all() if x.name != w.name]
        if any(x.path == w.path for x in rest):
            raise ValueError(f"{w.path} is registered")
        self._save([*rest, _valid(w)])
        return _valid(w)

    def get(self, name: str) -> Workspace | None:
        return next((w for w in self.all() if w.name == name), None)

    def remove(self, name: str) -> bool:
        """Whether there was one; its catalog is left alone."""
        rows = self.all()
        self._save([w for w in rows if w.name != name])
        return any(w.name == name for w in rows)

    def frame(self) -> DataFrame:
        fields = "name string, path string, watch boolean, watch_mode string, debounce_ms long, sync_state string"
        return self.spark.createDataFrame([tuple(asdict(w).values()) for w in self.all()], fields)

    def table(self, name: str) -> DataFrame:
        """The table over all workspaces whose catalog has it, with a column workspace; a filter on that prunes whole scans."""
        parts = []
        for w in self.all():
            c = Catalog(self.spark, w.path)
            if name in c.manifest():
                parts.append(c.table(name).withColumn("workspace", F.lit(w.name)))
        if not parts:
            raise KeyError(name)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
