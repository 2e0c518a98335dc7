"""Data sources for folders of many named files.

``scene_files`` reads the folders of scenes below a root. The driver lists the scenes' folders only, and deals them out in groups; what
is inside is listed and read by the tasks. A filter on ``seed`` leaves out other scenes' folders, and a schema of fewer columns saves
reading what they would need: of a mask without its counts only the header is read.

``named_files`` writes rows of (path, content) as files below a root. A task that runs again writes the same files again."""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import written

KINDS = {
    "markers": "seed string, task string",
    "masks": "seed string, path string, height int, width int, ids array<bigint>, counts array<bigint>",
    "index": "seed string, type string, ext string, rig string, subcam string, frame string, path string",
}
#: Scenes' folders that one task reads.
GROUP = 64
#: Tasks that list a level of folders at most, and bytes of files that are held at once.
TASKS, BYTES = 2_000, 16 << 20
#: The prefix of a marker's name, the folder of markers, and the name of an index.
MARKER, LOGS, SUMMARY = "FINISH_", "logs", "summary.json"


def located(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if root.startswith("file:/") and not root.startswith("file:///"):
        root = "file:///" + root[5:].lstrip("/")
    return fs.FileSystem.from_uri(root)


def shown(root: str) -> str:
    """What stands before a path of :func:`located` in the paths that Spark's readers show."""
    scheme, colon, rest = root.partition(":")
    if not colon or scheme == "file":
        return "file:"
    return f"{scheme}://{rest[2:].split('/', 1)[0]}" if scheme in ("hdfs", "viewfs") else f"{scheme}://"


def _listed(files: fs.FileSystem, path: str, recursive: bool = False) -> list[fs.FileInfo]:
    return sorted(files.get_file_info(fs.FileSelector(path, recursive=recursive, allow_not_found=True)), key=lambda f: f.path)


@dataclass
class Scenes(InputPartition):
    """The names of the folders that one task reads."""

    names: list[str]


class SceneReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.root, self.kind = schema.names, options["path"], options.get("kind", "markers")
        self.group = int(options.get("group", GROUP))
        self.seeds: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("seed",):
                self.seeds = wanted if self.seeds is None else self.seeds & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, path = located(self.root)
        names = [f.base_name for f in _listed(files, path) if f.type == fs.FileType.Directory]
        names = [n for n in names if self.seeds is None or n in self.seeds]
        return [Scenes(names[k : k + self.group]) for k in range(0, len(names), self.group)] or [Scenes([])]

    def read(self, partition: Scenes) -> Iterator[tuple]:
        files, root = located(self.root)
        make = {"markers": self._markers, "masks": self._masks, "index": self._index}[self.kind]
        for name in partition.names:
            for row in make(files, posixpath.join(root, name), name):
                yield tuple(row[c] for c in self.columns)

    def _markers(self, files, folder: str, seed: str) -> Iterator[dict]:
        for f in _listed(files, posixpath.join(folder, LOGS)):
            if f.base_name.startswith(MARKER):
                yield {"seed": seed, "task": f.base_name[len(MARKER) :]}

    def _masks(self, files, folder: str, seed: str) -> Iterator[dict]:
        counted = "ids" in self.columns or "counts" in self.columns
        for f in _listed(files, folder, recursive=True):
            if not f.path.endswith(".npy"):
                continue
            with files.open_input_file(f.path) as file:
                if counted:
                    mask = np.load(io.BytesIO(file.read()))
                    shape, (ids, counts) = mask.shape, np.unique(mask, return_counts=True)
                else:
                    head = io.BytesIO(file.read(4096))
                    read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(head) == (1, 0) else np.lib.format.read_array_header_2_0
                    shape, ids, counts = read(head)[0], np.zeros(0), np.zeros(0)
            yield {"seed": seed, "path": f.path[len(folder) + 1 :], "height": shape[0], "width": shape[1], "ids": ids.astype(int).tolist(), "counts": counts.astype(int).tolist()}

    def _index(self, files, folder: str, seed: str) -> Iterator[dict]:
        path = posixpath.join(folder, SUMMARY)
        if files.get_file_info(path).type != fs.FileType.File:
            return
        with files.open_input_file(path) as file:
            found: list[tuple] = [((), json.loads(file.read()))]
        # Types whose index has fewer levels (mask tags by frame) are another table.
        for _ in range(5):
            found = [((*at, k), x) for at, inner in found if isinstance(inner, dict) for k, x in inner.items()]
        for (kind, ext, rig, subcam, frame), x in found:
            if isinstance(x, str):
                yield {"seed": seed, "type": kind, "ext": ext, "rig": rig, "subcam": subcam, "frame": frame, "path": x}


class SceneFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scene_files"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "markers")]

    def reader(self, schema: StructType) -> SceneReader:
        return SceneReader(schema, dict(self.options))


class FileWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, root = located(self.root)
        made: set[str] = set()
        for row in rows:
            path = posixpath.join(root, row["path"])
            if (folder := posixpath.dirname(path)) not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            with files.open_output_stream(path) as file:
                file.write(bytes(row["content"] or b""))
        return WriterCommitMessage()


def hidden(name: str) -> bool:
    """Whether Spark's readers pass a file or folder of that name over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path): every file below ``root``, at any depth. Folders are listed by the tasks, level by level, and what a level holds is
    written, so no list of the files or folders is ever on the driver."""

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = located(root)[0]
        for pdf in batches:
            for folder in pdf["path"]:
                found = [f for f in _listed(files, folder) if not hidden(f.base_name)]
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    yield pd.DataFrame({"path": [f.path for f in part], "folder": [f.type == fs.FileType.Directory for f in part]})

    levels = []
    folders = spark.createDataFrame([(located(root)[1],)], "path string")
    while True:
        # Dealt by their names, as one folder may hold them all.
        level = written(folders.mapInPandas(inside, "path string, folder boolean"), "tree")
        levels.append(level.where("NOT folder").select("path"))
        folders = level.where("folder").select("path")
        count = folders.count()
        if not count:
            return reduce(DataFrame.unionByName, levels)
        folders = folders.repartition(max(1, min(-(-count // GROUP), TASKS)), "path")


def contents(paths: DataFrame, root: str) -> DataFrame:
    """``paths`` (path, and others) with the ``content`` of the files, which the tasks read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = located(root)[0]
        for pdf in batches:
            start, size, found = 0, 0, []
            for k, path in enumerate(pdf["path"]):
                with files.open_input_file(path) as file:
                    found.append(file.read())
                size += len(found[-1])
                if size > BYTES or k + 1 == len(pdf):
                    yield pdf.iloc[start : k + 1].assign(content=found)
                    start, size, found = k + 1, 0, []

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema)
    return paths.mapInPandas(read, f"{kinds}, content binary")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def scene_files(spark: SparkSession, root: str, kind: str, *columns: str, group: int = GROUP) -> DataFrame:
    """The rows of a kind (see ``KINDS``) below ``root``, with the given columns only."""
    spark.dataSource.register(SceneFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    fields = [f for f in KINDS[kind].split(", ") if not columns or f.split()[0] in columns]
    return spark.read.format("scene_files").schema(", ".join(fields)).option("kind", kind).option("group", group).load(root)


def write_files(rows: DataFrame, root: str) -> None:
    """Rows of (path, content) as files below ``root``, written by the tasks; a path's folders are made."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("path", "content").write.format("named_files").mode("append").save(root)
