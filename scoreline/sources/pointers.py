"""Numbered pointers: what a folder's readers see is what its newest pointer names.

Data is written aside first; a pointer is a small file that appears whole, by a rename. So readers never see half of a
write, and a write may read what it replaces. Files go through Hadoop's file systems, as Spark's own do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Pointers that stay: frames read through one of them still find their files.
KEEP = 3


class Folder:
    """A folder with numbered pointers, each of which holds a small value that JSON can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        """What stands in this part of the folder; nothing if there is none."""
        if not self._fs.exists(self._at(name)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.names("pointers") if n.isdigit())

    def value(self, number: int):
        stream = self._fs.open(self._at(f"pointers/{number:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self, upto: int | None = None):
        """The value of the newest pointer, or of the newest up to a number; None without one."""
        numbers = [n for n in self.numbers() if upto is None or n <= upto]
        return self.value(numbers[-1]) if numbers else None

    def point(self, number: int, value) -> None:
        """Makes a pointer appear; it replaces one of the same number."""
        aside, place = self._at(f"pointers/.{uuid.uuid4().hex}"), self._at(f"pointers/{number:012d}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._fs.delete(place, False)
        if not self._fs.rename(aside, place):
            raise RuntimeError(f"{place} can't be written")

    def forget(self, keep: int = KEEP) -> None:
        """Removes all but the last pointers."""
        for number in self.numbers()[:-keep]:
            self.remove(f"pointers/{number:012d}")


def replace_table(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Makes df the table at path; df may read that table. Without a new pointer the old table stays. One writer at a time."""
    folder = Folder(df.sparkSession, path)
    numbers = folder.numbers()
    name = uuid.uuid4().hex
    df.write.format(fmt).save(f"{folder.path}/tables/{name}")
    folder.point(numbers[-1] + 1 if numbers else 1, name)
    folder.forget()
    # Tables that no pointer names and that an earlier call has finished go; one still being written stays.
    named = {folder.value(n) for n in folder.numbers()}
    for old in set(folder.names("tables")) - named:
        if "_SUCCESS" in folder.names(f"tables/{old}"):
            folder.remove(f"tables/{old}")


def current_table(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """The table at path as it is now; empty where there is none."""
    name = Folder(spark, path).newest()
    if name is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(f"{path.rstrip('/')}/tables/{name}")
