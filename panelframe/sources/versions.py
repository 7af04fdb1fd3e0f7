"""Tables by date with versions: a manifest names the folder of each date, and one file is the pointer.

A change writes the dates it touches to a new folder and then a manifest under the next number; the rename that gives the
manifest its name is the commit. Readers take the highest number and never see half of a change: a frame
that was made before goes on reading the version it was made from, until `clean` removes what no kept version names. Two writers
can't take the same number: the second one raises. Manifests have an entry a date.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelframe.operators.relational import upsert

_PART = "_part"


@dataclass(frozen=True)
class Manifest:
    version: int
    what: str
    schema: str
    parts: dict[str, list[str]]  # date: folders, relative to the table's
    done: dict[str, int] = field(default_factory=dict)  # last batch of each stream


class Versions:
    """S14-S19 of a table under `path`, by the dates of the column `day`."""

    def __init__(self, spark: SparkSession, path: str, day: str = "d"):
        self.spark, self.path, self.day = spark, path.rstrip("/"), day
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    # ---- manifests

    def versions(self) -> list[int]:
        return [int(x[:-5]) for x in self._names("manifests") if x.endswith(".json") and not x.startswith((".", "_"))]

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest one (None if there is none), or that of a version."""
        if version is None:
            version = max(self.versions(), default=None)
            if version is None:
                return None
        source = self._fs.open(self._at(f"manifests/{version:09d}.json"))
        try:
            return Manifest(**json.loads(bytes(source.readAllBytes())))
        finally:
            source.close()

    def _commit(self, base: Manifest | None, what: str, schema: str, parts: dict[str, list[str]], done: dict[str, int] | None = None) -> Manifest:
        new = Manifest((base.version if base else 0) + 1, what, schema, dict(sorted(parts.items())), {**(base.done if base else {}), **(done or {})})
        aside, to = self._at(f"aside/{uuid.uuid4().hex}"), self._at(f"manifests/{new.version:09d}.json")
        self._fs.mkdirs(self._at("manifests"))
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        plain = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename") and getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = plain
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(to), options)  # fails if another writer has taken the number
        return new

    # ---- reading

    def read(self, start=None, end=None, version: int | None = None) -> DataFrame:
        """Rows of a version with dates from start to end (both included, None: open): only the folders of these dates are listed."""
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(f"no version under {self.path}")
        lo, hi = (None if x is None else str(x) for x in (start, end))
        at = [f"{self.path}/{x}" for d, xs in m.parts.items() if (lo is None or d >= lo) and (hi is None or d <= hi) for x in xs]
        schema = StructType.fromJson(json.loads(m.schema))
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def dates(self, version: int | None = None) -> list[str]:
        """From the manifest; no file is opened."""
        m = self.manifest(version)
        return list(m.parts) if m else []

    # ---- writing

    def _write(self, df: DataFrame) -> dict[str, list[str]]:
        """The dates of df, a file each, in a new folder."""
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn(_PART, F.col(self.day).cast("string")).repartition(F.col(_PART)).write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        return {x.split("=", 1)[1]: [f"{folder}/{x}"] for x in self._names(folder) if x.startswith(f"{_PART}=")}

    def replace(self, df: DataFrame, batch: tuple[str, int] | None = None) -> Manifest:
        """The dates of df get its rows; the others stay. batch: (stream, number), which is done once."""
        base = self.manifest()
        if batch and base and base.done.get(batch[0], -1) >= batch[1]:
            return base
        parts = {**(base.parts if base else {}), **self._write(df)}
        return self._commit(base, "replace", df.schema.json(), parts, dict([batch]) if batch else None)

    def upsert(self, new: DataFrame, keys: Sequence[str], batch: tuple[str, int] | None = None) -> Manifest:
        """New rows win by key within their dates; only these dates are read and written."""
        base = self.manifest()
        if base is None or batch and base.done.get(batch[0], -1) >= batch[1]:
            return self.replace(new, batch)
        days = {str(r[0]) for r in new.select(self.day).distinct().collect()}  # dates, not rows
        at = [f"{self.path}/{x}" for d in days for x in base.parts.get(d, ())]
        merged = upsert(self.spark.read.schema(StructType.fromJson(json.loads(base.schema))).parquet(*at), new, keys) if at else new
        parts = {**base.parts, **self._write(merged)}
        return self._commit(base, "upsert", merged.schema.json(), parts, dict([batch]) if batch else None)

    def drop(self, *days) -> Manifest:
        """Versions from now on lack the dates; no file is touched."""
        base, gone = self.manifest(), {str(d) for d in days}
        return self._commit(base, "drop", base.schema, {d: x for d, x in base.parts.items() if d not in gone})

    def compact(self, most: int = 1) -> Manifest:
        """The dates with more than `most` files are written anew."""
        base = self.manifest()
        many = {d: x for d, x in base.parts.items() if len(x) > 1 or sum(1 for y in x for n in self._names(y) if n.startswith("part-")) > most}
        if not many:
            return base
        rows = self.spark.read.schema(StructType.fromJson(json.loads(base.schema))).parquet(*[f"{self.path}/{y}" for x in many.values() for y in x])
        return self._commit(base, "compact", base.schema, {**base.parts, **self._write(rows)})

    def reset(self) -> Manifest:
        """An empty table; the versions before are its backup."""
        base = self.manifest()
        return self._commit(base, "reset", base.schema, {})

    def rollback(self, version: int) -> Manifest:
        """A new version with what a former one had."""
        then = self.manifest(version)
        return self._commit(self.manifest(), f"rollback to {version}", then.schema, then.parts)

    def clean(self, keep: int = 2) -> int:
        """Removes all but the last `keep` versions and the folders that none of these names; the number of folders removed.

        Frames of removed versions fail, and so may a writer that has not committed yet: clean when none is at work.
        """
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        named = {x for v in kept for xs in self.manifest(v).parts.values() for x in xs}
        gone = [f"data/{a}/{b}" for a in self._names("data") for b in self._names(f"data/{a}") if b.startswith(f"{_PART}=") and f"data/{a}/{b}" not in named]
        for v in old:
            self._fs.delete(self._at(f"manifests/{v:09d}.json"), False)
        for x in gone:
            self._fs.delete(self._at(x), True)
        for a in self._names("data"):
            if not any(b.startswith(f"{_PART}=") for b in self._names(f"data/{a}")):
                self._fs.delete(self._at(f"data/{a}"), True)
        return len(gone)

    def stats(self, version: int | None = None) -> dict:
        """Dates, files, bytes and the last date, without opening a file."""
        m = self.manifest(version)
        files = [x for xs in m.parts.values() for y in xs for x in self._fs.listStatus(self._at(y)) if x.getPath().getName().startswith("part-")]
        return {"version": m.version, "dates": len(m.parts), "files": len(files), "bytes": sum(x.getLen() for x in files), "latest": max(m.parts, default=None)}
