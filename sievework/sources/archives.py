"""Archives as Python data sources: NumPy archives of scores, and Arrow IPC files.

    archives.register(spark)
    scores.write.format("score_archive").mode("append").save(path)
    spark.read.format("score_archive").load(path).where("dim = 'safety' and step > 50")
    archives.arrow_scan(spark, path, ["doc_id", "lang"])

Tasks write into a folder of their own job, which a commit moves into place as a whole and an abort deletes; files appear under names that
readers pass over until then. Paths are URIs that pyarrow reaches, or absolute ones; driver and executors must see the same.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

SCORES = "sample_id long, step long, dim string, score double, label string"
NAME = re.compile(r"step=(-?\d+),dim=([^,/]*),[0-9a-f]+\.npz")
METADATA = "_about.json"


def at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def listed(path: str, end: str) -> list[str]:
    """The files below a folder, in order; those in folders of jobs that have not committed are passed over."""
    files, root = at(path)
    if files.get_file_info(root).type == fs.FileType.NotFound:
        return []
    found = [x.path for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File]
    return sorted(x for x in found if x.endswith(end) and not any(p.startswith(("_", ".")) for p in x[len(root) :].strip("/").split("/")))


@dataclass
class Wrote(WriterCommitMessage):
    names: list[str]


class Staged(DataSourceArrowWriter):
    """A writer whose files are moved into place when all tasks have written theirs."""

    def __init__(self, path: str, overwrite: bool, about: str | None = None) -> None:
        self.path, self.overwrite, self.about, self.job = path, overwrite, about, f"_job-{uuid.uuid4().hex}"

    def put(self, name: str, data: bytes) -> str:
        files, root = at(self.path)
        files.create_dir(f"{root}/{self.job}", recursive=True)
        with files.open_output_stream(f"{root}/{self.job}/{name}") as f:
            f.write(data)
        return name

    def commit(self, messages: list[Wrote | None]) -> None:
        files, root = at(self.path)
        before = listed(self.path, self.end) if self.overwrite else []
        files.create_dir(root, recursive=True)
        for name in [n for m in messages if m for n in m.names]:
            files.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        for x in before:
            files.delete_file(x)
        if self.about is not None:
            with files.open_output_stream(f"{root}/{METADATA}") as f:
                f.write(self.about.encode())
        self._drop()

    def abort(self, messages: list[Wrote | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        files, root = at(self.path)
        if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")


class ScoreWriter(Staged):
    """One archive for each step and dimension that a task has, of ``most`` rows at most."""

    end, most = ".npz", 1_000_000

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        held: dict[tuple[int, str], list[pa.RecordBatch]] = {}
        names: list[str] = []

        def give(key: tuple[int, str]) -> None:
            rows = pa.Table.from_batches(held.pop(key))
            out = io.BytesIO()
            column = lambda k: rows.column(k).to_numpy()
            label = np.array([x or "" for x in rows.column("label").to_pylist()], str)
            np.savez_compressed(out, sample_id=column("sample_id"), score=column("score"), label=label, has_label=rows.column("label").is_valid().to_numpy())
            names.append(self.put(f"step={key[0]},dim={key[1]},{uuid.uuid4().hex}.npz", out.getvalue()))

        for b in batches:
            keys = list(zip(b.column("step").to_pylist(), b.column("dim").to_pylist(), strict=True))
            for key in dict.fromkeys(keys):
                if key[0] is None or key[1] is None or not re.fullmatch(r"[^,/]*", key[1]):
                    raise ValueError(f"step and dim {key} cannot name an archive")
                held.setdefault(key, []).append(b.filter(pa.array([k == key for k in keys])))
                if sum(x.num_rows for x in held[key]) > self.most:
                    give(key)
        for key in list(held):
            give(key)
        return Wrote(names)


@dataclass
class Piece(InputPartition):
    path: str
    step: int = 0
    dim: str = ""
    batches: tuple[int, int] | None = None


class ScoreReader(DataSourceReader):
    """One task for each archive whose step and dimension the filters let pass; files of other names are passed over."""

    TESTS = {
        EqualTo: lambda a, b: a == b,
        In: lambda a, b: a in b,
        GreaterThan: lambda a, b: a > b,
        GreaterThanOrEqual: lambda a, b: a >= b,
        LessThan: lambda a, b: a < b,
        LessThanOrEqual: lambda a, b: a <= b,
    }

    def __init__(self, path: str) -> None:
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in self.TESTS and f.attribute in (("step",), ("dim",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        out = []
        for x in listed(self.path, ".npz"):
            if m := NAME.fullmatch(x.rsplit("/", 1)[-1]):
                p = Piece(x, int(m[1]), m[2])
                if all(self.TESTS[kind](getattr(p, name), value) for name, kind, value in self.tests):
                    out.append(p)
        return out

    def read(self, p: Piece | None) -> Iterator[pa.RecordBatch]:
        if p is None:  # no file is left
            return
        files, _ = at(self.path)
        with files.open_input_file(p.path) as f:
            found = np.load(io.BytesIO(f.read()))
        n = len(found["sample_id"])
        for lo in range(0, n, 10_000):
            part = slice(lo, lo + 10_000)
            ids, label = found["sample_id"][part], pa.array(found["label"][part].tolist(), pa.string(), mask=~found["has_label"][part])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), p.step)), pa.array([p.dim] * len(ids)), pa.array(found["score"][part]), label], ["sample_id", "step", "dim", "score", "label"])


class ScoreArchive(DataSource):
    """Scores, and labels of a selection where there are any, as one NumPy archive for each step and dimension."""

    @classmethod
    def name(cls) -> str:
        return "score_archive"

    def schema(self) -> str:
        return SCORES

    def reader(self, schema: StructType) -> ScoreReader:
        return ScoreReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ScoreWriter:
        return ScoreWriter(self.options["path"], overwrite, self.options.get("about"))


class ArrowWriter(Staged):
    """One IPC file for each task."""

    end = ".arrow"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        name = f"{uuid.uuid4().hex}.arrow"
        files, root = at(self.path)
        files.create_dir(f"{root}/{self.job}", recursive=True)
        writer = None
        with files.open_output_stream(f"{root}/{self.job}/{name}") as f:
            for b in batches:
                writer = writer or ipc.new_file(f, b.schema)
                writer.write_batch(b)
            if writer:
                writer.close()
        return Wrote([name] if writer else [])


#: Bytes of an Arrow file that a task reads.
TASK_BYTES = 64 << 20


class ArrowReader(DataSourceReader):
    """Tasks by record batches, as many to a task as have so many rows or, at the file's mean, TASK_BYTES; a file in stream form, which has no index, is one task. Only the columns of
    the schema are read."""

    def __init__(self, path: str, schema: StructType, rows: int) -> None:
        self.path, self.columns, self.rows = path, schema.names, rows

    def partitions(self) -> list[Piece]:
        files, _ = at(self.path)
        out = []
        for x in listed(self.path, ".arrow"):
            with files.open_input_file(x) as f:
                if f.read(6) != b"ARROW1":
                    out.append(Piece(x))
                    continue
                found = ipc.open_file(f, options=ipc.IpcReadOptions(included_fields=[0]))  # to count rows, one column is read
                begin, n = 0, 0
                most = max(1, TASK_BYTES * found.num_record_batches // max(1, f.size()))
                for k in range(found.num_record_batches):
                    n += found.get_batch(k).num_rows
                    if n >= self.rows or k + 1 - begin >= most or k == found.num_record_batches - 1:
                        out.append(Piece(x, batches=(begin, k + 1)))
                        begin, n = k + 1, 0
        return out

    def read(self, p: Piece | None) -> Iterator[pa.RecordBatch]:
        if p is None:  # no file is left
            return
        files, _ = at(self.path)
        with files.open_input_file(p.path) as f:
            if p.batches is None:
                for b in ipc.open_stream(f):
                    yield b.select(self.columns)
                return
            names = ipc.open_file(f).schema.names
            found = ipc.open_file(f, options=ipc.IpcReadOptions(included_fields=[names.index(c) for c in self.columns]))
            for k in range(*p.batches):
                yield found.get_batch(k).select(self.columns)


class ArrowFiles(DataSource):
    """A folder of Arrow IPC files."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        return arrow_schema(self.options["path"])

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self.options["path"], schema, int(self.options.get("rows", 100_000)))

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"], overwrite)


def arrow_schema(path: str) -> StructType:
    """The schema of the first file."""
    found = listed(path, ".arrow")
    if not found:
        raise FileNotFoundError(f"there are no Arrow files in {path}")
    with at(path)[0].open_input_file(found[0]) as f:
        stream = f.read(6) != b"ARROW1"
        f.seek(0)
        return from_arrow_schema((ipc.open_stream(f) if stream else ipc.open_file(f)).schema)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets filters reach them. Register them in the session that reads, as others do not find them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for x in (ScoreArchive, ArrowFiles):
        spark.dataSource.register(x)


def arrow_scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a folder of Arrow files; of their columns only those named are read."""
    whole = arrow_schema(path)
    some = StructType([whole[c] for c in columns]) if columns else whole
    return spark.read.format("arrow_ipc").schema(some).load(path)


def about(path: str) -> dict:
    """What was written beside the scores with the option ``about``; nothing of none."""
    files, root = at(path)
    if files.get_file_info(f"{root}/{METADATA}").type != fs.FileType.File:
        return {}
    with files.open_input_file(f"{root}/{METADATA}") as f:
        return json.loads(f.read())


def adapter_checkpoints(path: str) -> dict[int, str]:
    """The folders checkpoint-NUMBER that hold an adapter's settings, by number; others are passed over."""
    files, root = at(path)
    if files.get_file_info(root).type == fs.FileType.NotFound:
        return {}
    out = {}
    for x in files.get_file_info(fs.FileSelector(root)):
        m = re.fullmatch(r"checkpoint-(\d+)", x.base_name)
        if m and x.type == fs.FileType.Directory and files.get_file_info(f"{x.path}/adapter_config.json").type == fs.FileType.File:
            out[int(m[1])] = x.path
    return dict(sorted(out.items()))
