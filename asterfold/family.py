"""Families: a table as an append-only log of immutable Parquet segments, and a catalog of them.

A family's manifest is a folder of small JSON versions; a version lists the live segments, oldest first. A
change writes its segment's files first and then adds the next version in one atomic create, which fails if
another writer was faster (that one then tries again on top). Readers see one version or the next, never half
of one, and a crash leaves at most files that no version names.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asterfold.schemas import SORT_ORDER, TABLES, empty


@dataclass(frozen=True)
class Segment:
    name: str
    rows: int
    batch: str | None = None


class Files:
    """A folder on any store that Hadoop reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(""))] if self.fs.exists(self._path("")) else []

    def changed(self) -> tuple[int, int, int]:
        """Files here (or the file that this is), their bytes, and when the last was changed."""
        found = list(self.fs.listStatus(self._path("")))
        return len(found), sum(s.getLen() for s in found), max((s.getModificationTime() for s in found), default=0)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, content: str) -> bool:
        """False if the file is there already. The content is complete once the name exists."""
        temporary = self._path(f".{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        done = not self.fs.exists(self._path(name)) and self.fs.rename(temporary, self._path(name))
        if not done:
            self.fs.delete(temporary, False)
        return done

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Family:
    """An ordered list of written segments and at most one current one, in memory, of a table type."""

    def __init__(self, spark: SparkSession, path: str, name: str, table: str, keys: list[str] | None = None, schema: T.StructType | None = None):
        self.spark, self.name, self.table = spark, name, table
        self.schema = schema or TABLES[table]
        self.keys = keys or SORT_ORDER[table]
        self.path = f"{path.rstrip('/')}/{name}"
        self.log = Files(spark, f"{self.path}/log")
        self.current: DataFrame | None = None
        self.sealed = False

    # -- the log
    def _latest(self) -> tuple[int, list[Segment]]:
        versions = sorted(int(m[1]) for n in self.log.names() if (m := re.fullmatch(r"(\d+)\.json", n)))
        if not versions:
            return 0, []
        return versions[-1], [Segment(**s) for s in json.loads(self.log.read(f"{versions[-1]:08d}.json"))["segments"]]

    def _change(self, how) -> None:
        """Puts how(segments) in the place of the latest version's segments."""
        for _ in range(100):
            version, segments = self._latest()
            new = how(segments)
            if new == segments or self.log.create(f"{version + 1:08d}.json", json.dumps({"table": self.table, "segments": [asdict(s) for s in new]})):
                return
        raise RuntimeError(f"{self.name}: too many writers at once")

    def segments(self) -> list[Segment]:
        return self._latest()[1]

    def segment(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}")

    # -- the current segment
    def insert(self, rows: DataFrame, dedup: bool = False) -> None:
        """Adds rows to the current segment. With dedup, rows whose key is there already are left out, and of new
        rows of one key the first stays, in the rows' own order."""
        if self.sealed:
            raise RuntimeError("the current segment is sealed")
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        if dedup:
            first = F.min_by(F.struct(*self.schema.names), "_place").alias("_row")
            rows = rows.withColumn("_place", F.monotonically_increasing_id()).groupBy(*(F.col(k).alias(f"_{k}") for k in self.keys)).agg(first).select("_row.*")
            if self.current is not None:
                rows = rows.join(self.current.select(*self.keys), self.keys, "left_anti").select(*self.schema.names)
        self.current = rows if self.current is None else self.current.unionByName(rows)

    def seal(self) -> DataFrame:
        """Ends inserting; the current rows in key order."""
        self.sealed = True
        return (self.current if self.current is not None else empty(self.spark, self.table)).orderBy(*self.keys)

    def clear(self) -> None:
        self.current, self.sealed = None, False

    def flush(self) -> str | None:
        """Writes the current segment and starts anew; its name, or None if there is no row."""
        name = self.append(self.current) if self.current is not None else None
        self.clear()
        return name

    # -- written segments
    def _write(self, rows: DataFrame, name: str) -> int:
        """Key ranges of their own for each file, sorted inside: range scans skip files and row groups."""
        path = f"{self.path}/data/{name}"
        rows.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path).count()

    def append(self, rows: DataFrame, batch: str | None = None) -> str | None:
        """Writes rows as a segment. A batch name that the log has already is not written again, so that a
        replayed batch changes nothing."""
        if batch is not None and any(s.batch == batch for s in self.segments()):
            return None
        name = f"s-{uuid.uuid4().hex}"
        count = self._write(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)), name)
        if not count:
            Files(self.spark, f"{self.path}/data").delete(name)
            return None
        self._change(lambda old: old if batch is not None and any(s.batch == batch for s in old) else [*old, Segment(name, count, batch)])
        return name

    def erase(self, names: list[str], files: bool = True) -> None:
        self._change(lambda old: [s for s in old if s.name not in names])
        if files:
            for name in names:
                Files(self.spark, f"{self.path}/data").delete(name)

    def compact(self, names: list[str] | None = None, delete: bool = True) -> str:
        """Merges segments to one in key order, which is then the newest. Rows and duplicates stay as they are.

        Batch names of merged segments are kept, joined, so that replays are still recognised.
        """
        chosen = [s for s in self.segments() if names is None or s.name in names]
        if not chosen or names is not None and len(chosen) != len(set(names)):
            raise KeyError("no such segments")
        merged = f"s-{uuid.uuid4().hex}"
        paths = [f"{self.path}/data/{s.name}" for s in chosen]
        count = self._write(self.spark.read.schema(self.schema).parquet(*paths), merged)
        gone = {s.name for s in chosen}

        def swap(old: list[Segment]) -> list[Segment]:
            if not gone <= {s.name for s in old}:
                raise RuntimeError("a segment was merged or erased meanwhile")
            return [*(s for s in old if s.name not in gone), Segment(merged, count, ",".join(s.batch for s in chosen if s.batch) or None)]

        self._change(swap)
        if delete:
            for s in chosen:
                Files(self.spark, f"{self.path}/data").delete(s.name)
        return merged

    def read(self, main: DataFrame | None = None) -> DataFrame:
        """Everything: a main table if given, all written segments, the current one."""
        names = [s.name for s in self.segments()]
        parts = [main] if main is not None else []
        if names:
            parts.append(self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{n}" for n in names)))
        if self.current is not None:
            parts.append(self.current)
        out = parts[0] if parts else empty(self.spark, self.table)
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


class Engine:
    """A data folder with families and registered tables. Families are found again in the folder: each notes its
    table type, keys and schema in its log folder when it is created."""

    NOTE = "family.json"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.tables: dict[str, DataFrame] = {}
        self.families: dict[str, Family] = {}
        for name in sorted(self.files.names()):
            if not name.startswith(".") and (found := self._found(name)):
                self.families[name] = found

    def _found(self, name: str) -> Family | None:
        """The family of that name in the folder, if there is one."""
        log = Files(self.spark, f"{self.path}/{name}/log")
        if self.NOTE not in log.names():
            return None
        note = json.loads(log.read(self.NOTE))
        return Family(self.spark, self.path, name, note["table"], note["keys"], T.StructType.fromJson(note["schema"]))

    def register(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.tables:
            raise KeyError(f"{name} exists")
        self.tables[name] = df
        df.createOrReplaceTempView(name)
        return df

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def drop(self, name: str) -> None:
        del self.tables[name]
        self.spark.catalog.dropTempView(name)

    def create_family(self, name: str, table: str) -> Family:
        """A new family; KeyError if there is one of that name, made by this engine or by another on the folder."""
        family = Family(self.spark, self.path, name, table)
        note = {"table": table, "keys": family.keys, "schema": family.schema.jsonValue()}
        if name in self.families or not family.log.create(self.NOTE, json.dumps(note)):
            raise KeyError(f"{name} exists")
        self.families[name] = family
        return family

    def family(self, name: str) -> Family:
        if name not in self.families and (found := self._found(name)):
            self.families[name] = found
        return self.families[name]

    def erase_family(self, name: str) -> None:
        del self.families[name]
        self.files.delete(name)

    def describe(self) -> DataFrame:
        """kind, name, type, segments, rows of what the engine knows."""
        rows = [("table", name, df.schema.simpleString()[:80], 0, None) for name, df in self.tables.items()]
        rows += [("family", f.name, f.table, len(s := f.segments()), sum(x.rows for x in s)) for f in self.families.values()]
        return self.spark.createDataFrame(rows, "kind string, name string, type string, segments int, rows long")
