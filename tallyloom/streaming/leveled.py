"""Tables that grow by small batches and are read from few files.

A batch is written as a folder of level 0. When a level holds ``FAN`` folders they are folded into one of the next level,
by the same reduction that made the batches. A manifest lists the folders that count and the last batch they hold; it
appears under its final name by a rename, so a reader sees all of a commit or nothing. A crash before the commit leaves folders that
no manifest names, and the stream gives the batch again; a batch that was committed is not added twice. Folders that a commit replaced
are deleted by the next one, so a reader of the manifest before it can finish.

A table of n batches is read from at most (FAN - 1) x (log of n to the base FAN + 1) folders.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FAN = 4


@dataclass(frozen=True)
class Manifest:
    last: int  # newest batch
    folders: tuple[tuple[int, str], ...]  # level and name
    replaced: tuple[str, ...] = ()  # to be deleted by the next commit


class Leveled:
    """A leveled table at ``path``; ``reduced`` maps rows, or rows of several reductions, to one row for each key."""

    def __init__(self, spark: SparkSession, path: str, reduced: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.reduced = spark, path, reduced
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def manifest(self) -> Manifest:
        found = self._fs.globStatus(self._at("manifest-*")) if self._fs.exists(self._at("")) else []
        names = sorted(s.getPath().getName() for s in found)
        if not names:
            return Manifest(-1, ())
        lines = self.spark.read.text(f"{self.path}/{names[-1]}").collect()  # one short line
        held = json.loads(lines[0][0])
        return Manifest(held["last"], tuple(map(tuple, held["folders"])), tuple(held["replaced"]))

    def _commit(self, m: Manifest) -> None:
        name, draft = f"manifest-{m.last:012d}", f".draft-{m.last:012d}"
        out = self._fs.create(self._at(draft), True)
        out.write(bytearray(json.dumps({"last": m.last, "folders": m.folders, "replaced": m.replaced}).encode()))
        out.close()
        if not self._fs.rename(self._at(draft), self._at(name)):
            raise RuntimeError(f"{self.path}/{name} could not be committed")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch, unless it is in the table already; batches come in order of their ids."""
        before = self.manifest()
        if batch_id <= before.last:
            return
        name = f"level0-{batch_id:012d}"
        self.reduced(batch).write.mode("overwrite").parquet(f"{self.path}/{name}")
        folders, replaced, level = [*before.folders, (0, name)], [], 0
        while len(full := [f for f in folders if f[0] == level]) >= FAN:
            name = f"level{level + 1}-{batch_id:012d}"
            self.reduced(self._read([n for _, n in full])).write.mode("overwrite").parquet(f"{self.path}/{name}")
            folders = [f for f in folders if f[0] != level] + [(level + 1, name)]
            replaced += [n for _, n in full]
            level += 1
        self._commit(Manifest(batch_id, tuple(folders), tuple(replaced)))
        for old in before.replaced:
            self._fs.delete(self._at(old), True)
        if before.last >= 0:  # manifests but for this one and the one before it
            for s in self._fs.globStatus(self._at("manifest-*")):
                if s.getPath().getName() < f"manifest-{before.last:012d}":
                    self._fs.delete(s.getPath(), True)

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in names])

    def rows(self) -> DataFrame:
        """One row for each key."""
        names = [n for _, n in self.manifest().folders]
        if not names:
            raise FileNotFoundError(f"no batch was committed to {self.path}")
        return self.reduced(self._read(names))
