"""Tables that a stream writes batch by batch.

A batch goes into a folder of its own, and a short list names the folders that count.  The list is replaced
as a whole when a batch is complete, so a reader sees all of a batch or nothing, and a batch that is repeated
adds nothing.  When several folders of a size have gathered they are written again as one, so files follow the
size of the table, not the number of batches, and a row is rewritten as often as the logarithm of that number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FAN = 8             # folders of a size that are written as one
KEPT = 16           # lists, and folders that no longer count, stay for so many commits: a reader may be at them
_LISTS = "_commits"


@dataclass
class BatchTable:
    """A table under ``path``, written by one stream.

    ``reduce`` folds rows that belong together (sums, maxima, newest) and must give the same whether it sees all
    rows at once or rows reduced before; it is applied when folders are merged and when the table is read.
    """

    spark: SparkSession
    path: str
    partition_by: tuple[str, ...] = ()
    reduce: Callable[[DataFrame], DataFrame] | None = None
    fan: int = FAN

    # ------------------------------------------------------------------ the list
    def _place(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _versions(self) -> list[int]:
        files, place = self._place(_LISTS)
        if not files.exists(place):
            return []
        names = [f.getPath().getName() for f in files.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self._versions())

    def listed(self) -> dict:
        """The newest list: version, last batch, schema, parts (name, level), dropped (name, version), notes."""
        versions = self._versions()
        if not versions:
            return {"version": -1, "last_batch": -1, "schema": None, "parts": [], "dropped": [], "notes": {}}
        files, place = self._place(_LISTS, f"{versions[-1]:020}.json")
        stream = files.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, listed: dict) -> None:
        version = listed["version"] + 1
        old = [d for d in listed["dropped"] if d["version"] <= version - KEPT]
        listed = listed | {"version": version, "dropped": [d for d in listed["dropped"] if d not in old]}
        files, draft = self._place(_LISTS, f"draft-{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(listed).encode()))
        stream.close()
        _, place = self._place(_LISTS, f"{version:020}.json")
        if files.exists(place) or not files.rename(draft, place):
            raise RuntimeError(f"another writer committed version {version} of {self.path}")
        for name in [f"part={d['name']}" for d in old] + [f"{_LISTS}/{v:020}.json" for v in self._versions() if v <= version - KEPT]:
            files.delete(self._place(name)[1], True)

    # ------------------------------------------------------------------- writing
    def _write(self, rows: DataFrame, name: str) -> None:
        if self.partition_by:
            rows = rows.hint("rebalance", *self.partition_by)
        rows.write.mode("overwrite").partitionBy(*self.partition_by).parquet(f"{self.path}/part={name}")

    def append(self, rows: DataFrame, batch_id: int, notes: dict | None = None) -> bool:
        """Add a batch, unless it or a later one was added before.  ``notes`` are kept with the list."""
        listed = self.listed()
        if batch_id <= listed["last_batch"]:
            return False
        name = f"{batch_id}-{uuid.uuid4().hex}"
        self._write(rows, name)
        self._commit(listed | {
            "last_batch": batch_id, "schema": rows.schema.json(), "parts": [*listed["parts"], {"name": name, "level": 0}],
            "notes": listed["notes"] | (notes or {}),
        })
        self.compact()
        return True

    def compact(self) -> None:
        """Write ``fan`` folders of one level as one of the next level, as long as there are so many."""
        while True:
            listed = self.listed()
            levels = [p["level"] for p in listed["parts"]]
            full = [level for level in sorted(set(levels)) if levels.count(level) >= self.fan]
            if not full:
                return
            merged = [p for p in listed["parts"] if p["level"] == full[0]]
            name = f"merged-{uuid.uuid4().hex}"
            self._write(self._read(listed, merged), name)
            dropped = [{"name": p["name"], "version": listed["version"] + 1} for p in merged]
            rest = [p for p in listed["parts"] if p not in merged]
            self._commit(listed | {"parts": [*rest, {"name": name, "level": full[0] + 1}], "dropped": [*listed["dropped"], *dropped]})

    # ------------------------------------------------------------------- reading
    def _read(self, listed: dict, parts: list[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(listed["schema"]))
        reader = self.spark.read.schema(schema).option("basePath", self.path)
        rows = reader.parquet(*[f"{self.path}/part={p['name']}" for p in parts]).select(*schema.names)
        return self.reduce(rows) if self.reduce else rows

    def read(self) -> DataFrame:
        """All rows of the batches that are complete now."""
        listed = self.listed()
        if not listed["parts"]:
            raise FileNotFoundError(f"no batch of {self.path} is complete")
        return self._read(listed, listed["parts"])
