"""Vector archives: folders of ``.npz`` files as a partitioned source and a transactional sink."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

#: Members of an archive, and rows an archive or a read partition holds at most.
KEYS, VECTORS, MISSING = "keys", "vectors", "missing"
ROWS = 65_536
#: Components that one batch of rows may have.
BATCH_CELLS = 1 << 20
#: Bits of ``missing``: the key or the vector is null.
NO_KEY, NO_VECTOR = 1, 2

SCHEMA = "key string, vec array<float>"


def _open(path: str):
    """File system and path within it; a path without a scheme is one every executor reaches by the same name."""
    from pyarrow import fs

    if ":/" not in path:
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _header(member) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, column order and type that an array's header states."""
    version = np.lib.format.read_magic(member)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(member)


def _rows(archive: zipfile.ZipFile, name: str, start: int, stop: int) -> Iterator[np.ndarray]:
    """Rows ``start`` to ``stop`` of a member in bounded slices: what stands before is skipped, not held."""
    with archive.open(f"{name}.npy") as member:
        shape, by_column, kind = _header(member)
        if by_column and len(shape) > 1:
            raise ValueError(f"{name} is stored by columns; its rows cannot be read apart")
        width = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        left = start * width
        while left:
            left -= len(member.read(min(left, 1 << 20)))
        step = max(1, BATCH_CELLS // max(1, int(np.prod(shape[1:], dtype=np.int64))))
        for at in range(start, stop, step):
            n = min(step, stop - at)
            yield np.frombuffer(member.read(n * width), kind, count=n * width // max(1, kind.itemsize)).reshape((n, *shape[1:]))


@dataclass
class RowRange(InputPartition):
    """Rows ``start`` to ``stop`` of one archive."""

    path: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int, vectors: str, keys: str, kind: pa.DataType):
        self.path, self.rows, self.vectors, self.keys, self.kind = path, rows, vectors, keys, kind

    def partitions(self) -> list[RowRange]:
        from pyarrow import fs

        system, path = _open(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path))
        out = []
        for f in sorted(f.path for f in files if f.is_file and f.path.endswith(".npz")):
            with system.open_input_file(f) as raw, zipfile.ZipFile(raw) as archive, archive.open(f"{self.vectors}.npy") as member:
                n = _header(member)[0][0]
            out += [RowRange(f, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as archive:
            def rest(name: str) -> np.ndarray | None:
                if f"{name}.npy" not in archive.namelist():
                    return None
                return np.concatenate([np.zeros(0), *_rows(archive, name, partition.start, partition.stop)]) if name == MISSING else (
                    np.concatenate(list(_rows(archive, name, partition.start, partition.stop)))
                )

            keys, missing, at = rest(self.keys), rest(MISSING), 0
            for block in _rows(archive, self.vectors, partition.start, partition.stop):
                n, width = block.shape
                bits = np.zeros(n, np.uint8) if missing is None else missing[at : at + n].astype(np.uint8)
                own = np.arange(partition.start + at, partition.start + at + n) if keys is None else keys[at : at + n]
                values = pa.array(block.reshape(-1).astype(self.kind.to_pandas_dtype()))
                vec = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * width), values, mask=pa.array((bits & NO_VECTOR) > 0)
                )
                key = pa.array(own.astype(str), pa.string(), mask=(bits & NO_KEY) > 0)
                yield pa.RecordBatch.from_arrays([key, vec], names=["key", "vec"])
                at += n


@dataclass
class Written(WriterCommitMessage):
    """Archives one task wrote under names that no reader sees."""

    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, overwrite: bool):
        self.path, self.rows, self.overwrite, self.job = path, rows, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _open(self.path)
        folder = f"{path}/_job-{self.job}"
        system.create_dir(folder, recursive=True)
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        counts: dict[int, int] = {}
        files: list[str] = []

        def flush(width: int) -> None:
            keys, vectors, missing = (np.concatenate(p) for p in zip(*waiting.pop(width), strict=True))
            name = f"{folder}/{uuid.uuid4().hex}.npz"
            with system.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                for member, array in ((KEYS, keys), (VECTORS, vectors), (MISSING, missing)):
                    with archive.open(f"{member}.npy", "w", force_zip64=True) as m:
                        np.lib.format.write_array(m, array, allow_pickle=False)
            files.append(name)
            counts[width] = 0

        for batch in iterator:
            keys, vecs = batch.column(0), batch.column(1)
            bits = keys.is_null().to_numpy(zero_copy_only=False) * NO_KEY + vecs.is_null().to_numpy(zero_copy_only=False) * NO_VECTOR
            sizes = np.array([len(v) if v.is_valid else 0 for v in vecs], np.int64)
            names = np.array(keys.fill_null("").to_pylist(), str)
            for width in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == width)
                flat = vecs.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False)
                kind = vecs.type.value_type.to_pandas_dtype()
                waiting.setdefault(width, []).append(
                    (names[here], flat.astype(kind).reshape(len(here), width), bits[here].astype(np.uint8))
                )
                counts[width] = counts.get(width, 0) + len(here)
                if counts[width] >= self.rows:
                    flush(width)
        for width in list(waiting):
            flush(width)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(".npz")]
        for f in (f for m in messages if m for f in m.files):
            system.move(f, f"{path}/{f.rsplit('/', 1)[1]}")
        for f in old if self.overwrite else ():
            system.delete_file(f)
        self._clear(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, system, path: str) -> None:
        folder = f"{path}/_job-{self.job}"
        if system.get_file_info(folder).type.name == "Directory":
            system.delete_dir(folder)


class VectorArchives(DataSource):
    """Data source ``npz``: rows (key, vec) of every archive in a folder, or of one archive.

    Options: ``path``; ``rows``, of an archive or a read partition at most; ``vectors``
    and ``keys``, names of the members to read (an archive without keys gives row
    numbers). Tasks read ranges of rows. Each task writes archives of its own into a
    folder of the job; a commit moves them in place, an abort deletes them, so a
    failed job leaves nothing. Vectors of different lengths go to different archives;
    null keys, null vectors and empty tables are kept, a null component becomes NaN.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def _rows(self) -> int:
        return int(self.options.get("rows", ROWS))

    def reader(self, schema) -> DataSourceReader:
        kind = pa.float64() if schema["vec"].dataType.elementType.typeName() == "double" else pa.float32()
        return _Reader(
            self.options["path"], self._rows(), self.options.get("vectors", VECTORS), self.options.get("keys", KEYS), kind
        )

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self._rows(), overwrite)


def write_vectors(vectors: DataFrame, path: str, key: str = "concept_id", vec: str = "vec", rows: int = ROWS, mode: str = "overwrite") -> None:
    """K3: ``vectors`` as a folder of archives; only key and vector are written."""
    vectors.sparkSession.dataSource.register(VectorArchives)
    rows_of = vectors.select(F.col(key).cast("string").alias("key"), F.col(vec).alias("vec"))
    rows_of.write.format("npz").mode(mode).option("rows", str(rows)).save(path)


def read_vectors(spark: SparkSession, path: str, key: str = "concept_id", vec: str = "vec", rows: int = ROWS, **members: str) -> DataFrame:
    """K3: keys and vectors of a folder of archives, or of one archive."""
    spark.dataSource.register(VectorArchives)
    found = spark.read.format("npz").options(rows=str(rows), **members).load(path)
    return found.select(F.col("key").alias(key), F.col("vec").alias(vec))
