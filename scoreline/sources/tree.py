"""A data source that writes one file for each row: folder/stem.json, in a tree that replaces what stood at its path."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceWriter):
    """Tasks write beside the path; the commit puts the new tree in its place, an abort leaves the old one.

    A file that a repeated task writes again replaces its first copy. What the driver gets of a task is a number.
    """

    def __init__(self, path: str):
        self.path, self.aside = path.rstrip("/"), f"{path.rstrip('/')}-{uuid.uuid4().hex}"

    def _at(self, path: str):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(path)

    def write(self, iterator) -> Written:
        fs, root = self._at(self.aside)
        made, files = set(), 0
        for row in iterator:
            folder = f"{root}/{row['folder']}"
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(f"{folder}/{row['stem']}.json") as out:
                out.write(row["doc"].encode())
            files += 1
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        from pyarrow.fs import FileType

        fs, root = self._at(self.path)
        new, old = self._at(self.aside)[1], f"{root}-{uuid.uuid4().hex}"
        fs.create_dir(new, recursive=True)  # no rows, no tree yet
        stands = fs.get_file_info(root).type != FileType.NotFound
        if stands:
            fs.move(root, old)
        fs.move(new, root)
        if stands:
            fs.delete_dir(old)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, new = self._at(self.aside)
        if fs.get_file_info(new).type != FileType.NotFound:
            fs.delete_dir(new)


class Tree(DataSource):
    """Rows (folder, stem, doc) under the path that the option tree names."""

    @classmethod
    def name(cls) -> str:
        return "scoreline_tree"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["tree"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tree)
