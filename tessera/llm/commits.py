"""Numbered commits in a folder of a shared file system, and the tiers by which written parts are merged.

A commit is one small JSON file whose name is its number. It is written aside and then given its name by an operation
that fails if the name is there already, so that of two writers one succeeds and the other learns of it. Readers see
a commit whole or not at all; a crash leaves files aside that nobody reads.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

#: Parts of one tier that are merged, and the factor between tiers.
FAN = 4


class Commits:
    """Commits ``1, 2, ...`` under ``root``; an empty or missing folder has none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, jvm = spark, root.rstrip("/"), spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._seen: dict[int, dict] = {}

    def numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[1:11]) for n in names if n.startswith("v"))

    def _named(self, number: int):
        return self._path(f"{self.root}/v{number:010d}.json")

    def read(self, number: int) -> dict:
        """What was committed; commits never change, so each is read once."""
        if number not in self._seen:
            stream = self._fs.open(self._named(number))
            try:
                self._seen[number] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self._seen[number]

    def latest(self) -> tuple[int, dict]:
        """Number and content of the last commit; ``0, {}`` if there is none."""
        number = max(self.numbers(), default=0)
        return number, self.read(number) if number else {}

    def all(self) -> Iterator[dict]:
        return map(self.read, self.numbers())

    def commit(self, number: int, content: dict) -> bool:
        """False if the number is taken."""
        made = self._path(f"{self.root}/.tmp-{uuid.uuid4().hex}")
        stream = self._fs.create(made, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        try:
            self._name(made, self._named(number))
        except Exception as error:  # noqa: BLE001  the file system's own
            if "AlreadyExists" not in str(error):
                raise
            return False
        finally:
            self._fs.delete(made, False)
        return True

    def _name(self, made, final) -> None:
        """Give a file its name; fails with an "AlreadyExists" error if the name is there."""
        jvm = self.spark._jvm
        if self._fs.getUri().getScheme() == "file":  # renaming replaces files there; a second link to a name does not
            of = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(of(final), of(made))
            return
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(self._path(self._fs.makeQualified(made).toString()), self._path(self._fs.makeQualified(final).toString()), options)


def tier(size: int, least: int) -> int:
    """Parts of up to ``least * FAN`` are tier 0; each tier above spans a factor of ``FAN``."""
    return max(0, math.floor(math.log(max(1, size) / least, FAN) + 1e-9))


def full_tier(parts: list[dict], size: Callable[[dict], int], least: int) -> list[dict]:
    """The parts of the lowest tier that has ``FAN`` of them or more; none if no tier has."""
    tiers: dict[int, list[dict]] = {}
    for part in parts:
        tiers.setdefault(tier(size(part), least), []).append(part)
    return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FAN), [])
