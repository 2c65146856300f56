"""Tables and their indexes: Parquet segments under a folder, described by numbered manifests.

A table is the list of segments in its newest manifest. An insert adds a segment; a delete rewrites only segments
that hold matching rows; compaction makes one of many. A change writes its data first and then manifest number
n + 1, which fails if another writer has made it, so readers see all of a change or nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marlstone.storage import Store
from marlstone.types import as_declared, pad_vector, spark_type

# Other names of index methods.
METHODS = {
    "b+": "bplus", "btree": "bplus", "b+tree": "bplus", "bplus": "bplus", "bplustree": "bplus", "hash": "hash", "heap": "heap", "seq": "sequential", "sequential": "sequential", "isam": "isam",
    "rtree": "rtree", "r-tree": "rtree", "invtext": "invtext", "inverted": "invtext", "text": "invtext", "img": "bovw", "image": "bovw", "visual": "bovw", "bovw": "bovw", "sound": "audio", "audio": "audio",
}
PRIMARY, CONTENT = ("heap", "sequential", "isam", "bplus"), ("invtext", "bovw", "audio")


def method_name(name: str | None, default: str) -> str:
    found = METHODS.get((name or default).lower())
    if found is None:
        raise ValueError(f"unknown index method {name}")
    return found


@dataclass
class Field:
    name: str
    type: str
    length: int | None = None


@dataclass
class Manifest:
    table: str
    fields: list[Field]
    key: str
    organisation: str = "heap"
    #: column: method and name; for content indexes path and version; parts: what an index has for each segment
    indexes: dict[str, dict] = field(default_factory=dict)
    segments: list[str] = field(default_factory=list)
    data_version: int = 0

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, spark_type(f.type)) for f in self.fields])

    def column(self, name: str) -> str:
        """The column's own spelling; KeyError if there is none."""
        for f in self.fields:
            if f.name.lower() == name.lower():
                return f.name
        raise KeyError(f"{self.table} has no column {name}")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark)
        self.opened: dict[str, object] = {}  # readers of stored indexes by their paths, which never change

    def _home(self, table: str) -> str:
        return f"{self.root}/{table.lower()}"

    def _newest(self, table: str) -> int | None:
        found = [int(n[:-5]) for n in self.store.names(f"{self._home(table)}/manifests") if n.endswith(".json")]
        return max(found, default=None)

    def tables(self) -> dict[str, dict]:
        return {t: {"relation": [asdict(f) for f in self.load(t).fields], "indexes": self.load(t).indexes} for t in self.store.names(self.root) if self._newest(t) is not None}

    def exists(self, table: str) -> bool:
        return self._newest(table) is not None

    def load(self, table: str) -> Manifest:
        n = self._newest(table)
        if n is None:
            raise KeyError(f"no table {table}")
        d = json.loads(self.store.read(f"{self._home(table)}/manifests/{n:09d}.json"))
        return Manifest(**d | {"fields": [Field(**f) for f in d["fields"]]})

    def save(self, m: Manifest, after: int | None) -> None:
        """Publish m as the successor of manifest number `after`."""
        self.store.write_new(f"{self._home(m.table)}/manifests/{0 if after is None else after + 1:09d}.json", json.dumps(asdict(m)))

    def change(self, table: str):
        """(manifest to change, its number)"""
        n = self._newest(table)
        return self.load(table), n

    def create(self, m: Manifest) -> None:
        if not self.exists(m.table):
            self.save(m, None)

    def drop(self, table: str) -> None:
        self.store.delete(self._home(table))

    def new_folder(self, table: str, kind: str) -> str:
        return f"{self._home(table)}/{kind}/{uuid.uuid4().hex}"

    def read(self, m: Manifest) -> DataFrame:
        if not m.segments:
            return self.spark.createDataFrame([], m.schema)
        return self.spark.read.schema(m.schema).parquet(*m.segments)

    def write_segment(self, m: Manifest, rows: DataFrame) -> str:
        """rows as declared, as a new segment; sequential, isam and bplus tables keep segments in key order, so scans prune."""
        path = self.new_folder(m.table, "data")
        rows = as_declared(rows, m.schema)
        for f in m.fields:
            if f.length and isinstance(spark_type(f.type), T.ArrayType):
                rows = rows.withColumn(f.name, pad_vector(rows[f"`{f.name}`"], f.length))
        if m.organisation != "heap":
            rows = rows.repartitionByRange(m.key).sortWithinPartitions(m.key)
        rows.write.parquet(path)
        return path
