"""Text files under exact names, written by Spark tasks.

``DataFrame.write`` makes folders of part files. Formats that fix the names of their files need more: here each task
writes the files whose lines it holds into a staging folder of its own attempt, and the job's commit moves the files of
the attempts that succeeded to their names. A task that runs twice leaves one file; a job that fails leaves none.
"""

from __future__ import annotations

import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "named_text_files"


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Files of one attempt: their names, and the folder they are staged in."""

    folder: str
    names: list[str]


class NamedTextWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, staging = _store(self.staging)
        folder = f"{staging}/{uuid.uuid4().hex}"
        names: list[str] = []
        out = None
        for batch in iterator:
            column = batch.column("name").dictionary_encode()
            codes, lines = column.indices.to_numpy(), batch.column("line")
            # a run of rows with one name is one piece of its file
            cuts = [0, *((codes[1:] != codes[:-1]).nonzero()[0] + 1).tolist(), len(codes)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                name = column.dictionary[int(codes[lo])].as_py()
                if not names or name != names[-1]:
                    if name in names:
                        raise ValueError(f"lines of {name} are not next to one another")
                    if out:
                        out.close()
                    parent = f"{folder}/{name}".rpartition("/")[0]
                    store.create_dir(parent, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                    names.append(name)
                out.write(("\n".join(lines.slice(lo, hi - lo).to_pylist()) + "\n").encode())
        if out:
            out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        done = [m for m in messages if m is not None]
        twice = [n for n, k in Counter(n for m in done for n in m.names).items() if k > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several tasks hold lines of {sorted(twice)[:5]}")
        for message in done:
            for name in message.names:
                store.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
                store.move(f"{message.folder}/{name}", f"{path}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, staging = _store(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class NamedTextFiles(DataSource):
    """Sink of rows (name, line); the option ``path`` is the folder. Files that exist under a name are replaced."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, line string"

    def writer(self, schema, overwrite: bool) -> NamedTextWriter:
        return NamedTextWriter(self.options["path"])


def write_named_text(lines: DataFrame, folder: str, *order: str) -> None:
    """Write the column ``line`` of ``lines`` to the files ``folder/name``, in the order of the columns ``order``.

    A file is written by one task, line by line, as it has to be one file; files are dealt over the tasks. Folders are
    local or shared paths, or URIs of a store that pyarrow knows (hdfs, s3, gs).
    """
    lines.sparkSession.dataSource.register(NamedTextFiles)
    dealt = lines.repartition("name").sortWithinPartitions("name", *order).select("name", F.col("line").cast("string"))
    dealt.write.format(FORMAT).mode("append").option("path", folder).save()
