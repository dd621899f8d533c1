"""Which files of a table are live, so that a part of it is replaced at once.

A table is made of units, folders like `year=2024/month=3/range=5`. Each write puts its units' files into a folder of
its own, `version=<id>`, and then commits a manifest that names the live version of every unit: one line for each unit, and a last
line that says it is whole. Manifests are numbered files; the newest whole one holds. So a reader sees a commit or not, a
write that is killed before its commit leaves the old state, and files of units that a commit doesn't name aren't read or moved.

Of two writers only one gets a number, as files are created only where none is. The other one tries the next number if the units it
has read are unchanged, and else gets `Conflict` and starts again from the new state. The file system must
create files exclusively, as HDFS does.

Replaced files stay for readers that have begun, until `clean`.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from taxweave.session import exists, remove

MANIFESTS = "_manifests"
WHOLE = "whole"


class Conflict(Exception):
    """Another writer has replaced a unit that this one has read."""


@dataclass(frozen=True)
class State:
    number: int
    notes: dict[str, str]  # what the table's first writer has fixed
    units: dict[str, str]  # version of each live unit


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{MANIFESTS}/{name}")
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def state(self, number: int | None = None) -> State:
        """The newest whole manifest, or the one of this number. One short line a unit is read, whatever the table's size."""
        if number == 0:
            return State(0, {}, {})
        folder, store = self._file("")
        if not store.exists(folder):
            return State(0, {}, {})
        names = sorted((f.getPath().getName() for f in store.listStatus(folder)), reverse=True)
        numbers = [n for n in names if n.isdigit() and number in (None, int(n))]
        for name in numbers:
            lines = self._read(name).split("\n")
            if lines[-1] == WHOLE:
                pairs = [line.split("\t") for line in lines[:-1]]
                return State(int(numbers[0]), {k: v for kind, k, v in pairs if kind == "note"}, {k: v for kind, k, v in pairs if kind == "unit"})
        return State(int(numbers[0]) if numbers else 0, {}, {})

    def _read(self, name: str) -> str:
        target, store = self._file(name)
        stream = store.open(target)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, seen: State, changes: dict[str, str | None], notes: dict[str, str] | None = None, alone: bool = False, marks: dict[str, str] | None = None) -> None:
        """Make these versions of units live; None ends a unit. `seen` is the state that the new files were made from.

        With `alone` any commit in between is a conflict, for writers whose result hangs on all units. The first
        `notes` of a table stay, `marks` replace what they were.
        """
        now = seen
        while True:
            units = {k: v for k, v in {**now.units, **changes}.items() if v is not None}
            rows = [*(f"note\t{k}\t{v}" for k, v in {**(notes or {}), **now.notes, **(marks or {})}.items()), *(f"unit\t{k}\t{v}" for k, v in sorted(units.items()))]
            if self._create(f"{now.number + 1:020d}", "\n".join([*rows, WHOLE])):
                return
            now = self.state()
            if alone and now.units != seen.units or any(now.units.get(k) != seen.units.get(k) for k in changes):
                raise Conflict(self.path)

    def _create(self, name: str, text: str) -> bool:
        target, store = self._file(name)
        if store.exists(target):
            return False
        try:
            stream = store.create(target, False)
        except Exception as error:  # another writer was first
            if store.exists(target):
                return False
            raise error
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def fresh(self, mark: str = "") -> tuple[str, str]:
        """A new version, whose name ends with the mark, and the folder its files go to."""
        version = f"v{uuid.uuid4().hex}{mark}"
        return version, f"{self.path}/version={version}"

    def read(self, state: State, schema: StructType | None, units: list[str] | None = None, fmt: str = "parquet") -> DataFrame | None:
        """The live rows of these units (of all by default), None if there are none."""
        paths = [f"{self.path}/version={state.units[u]}/{u}" for u in (state.units if units is None else units) if u in state.units]
        if not paths:
            return None
        reader = self.spark.read.format(fmt).option("basePath", self.path).option("header", "true")
        rows = (reader.schema(schema) if schema is not None else reader).load(paths)
        return rows.drop("version") if schema is None else rows.select(*schema.names)

    def clean(self) -> None:
        """Remove what no live unit names, once no reader or writer of an older state is at work."""
        state = self.state()
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        live = {f"version={v}" for v in state.units.values()}
        for entry in store.listStatus(folder):
            name = entry.getPath().getName()
            if name.startswith("version=") and name not in live:
                remove(self.spark, f"{self.path}/{name}")


def is_versioned(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path.rstrip('/')}/{MANIFESTS}")
