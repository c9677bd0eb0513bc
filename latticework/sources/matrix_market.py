"""Matrix Market files: read and written in parallel as text, and as a data source of its own, spark.read.format("mtx")."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.matrix import SparseMatrix, check

#: Bytes of a file that a partition of the data source takes, and that a task parses together.
PARTITION_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20

FIELDS, SYMMETRIES = ("real", "integer", "pattern", "double"), ("general", "symmetric")


def parse_header(line: str) -> tuple[str, str]:
    """(field, symmetry) of the first line."""
    words = line.lower().split()
    check(len(words) == 5 and words[0] == "%%matrixmarket" and words[1] == "matrix", "not a Matrix Market header")
    check(words[2] == "coordinate", f"{words[2]} files are not supported")
    check(words[3] in FIELDS, f"{words[3]} values are not supported")
    check(words[4] in SYMMETRIES, f"{words[4]} matrices are not supported")
    return words[3], words[4]


def mmread(spark: SparkSession, path: str) -> SparseMatrix:
    """A coordinate file with real, integer or pattern values, general or symmetric. Values are float64.

    The header and the size line are read alone; entries are parsed by all tasks. Blank lines and comments are skipped,
    and a symmetric file gives each entry off the diagonal twice."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"))
    # the parts of a folder are not read in the order of their names: the size line follows the header in its own part
    head = lines.where(F.lower("value").startswith("%%matrixmarket")).first()
    check(head is not None, f"{path} has no Matrix Market header")
    (field, symmetry), part = parse_header(head["value"]), F.col("_file") == head["_file"]
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = lines.select(text.alias("t"), "_file").where((F.col("t") != "") & ~F.col("t").startswith("%"))
    size = rows.where(part).first()
    check(size is not None and len(size["t"].split()) == 3, "no size line")
    m, n, stored = map(int, size["t"].split())
    parts = F.split("t", " ")
    # The size line is the first of the rows; ordered ids tell it from an entry that reads alike.
    numbered = rows.withColumn("_id", F.monotonically_increasing_id())
    first = numbered.where(part).agg(F.min("_id")).first()[0]
    value = F.lit(1.0) if field == "pattern" else parts[2].cast("double")
    entries = numbered.where(F.col("_id") != first).select((parts[0].cast("long") - 1).alias("i"), (parts[1].cast("long") - 1).alias("j"), value.alias("v"))
    if symmetry == "symmetric":
        mirror = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
        entries = entries.select(F.explode(mirror).alias("e"), "v").select("e.i", "e.j", "v")
    return SparseMatrix(entries, (m, n), "float64", "coo")


def mmwrite(a: SparseMatrix, path: str) -> None:
    """A folder of parts whose first holds the header; mmread takes the folder."""
    count = a.df.count()
    head = a.spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{a.shape[0]} {a.shape[1]} {count}")], "_o int, value string")
    body = a.df.select(F.lit(2).alias("_o"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v").cast("double")).alias("value"))
    head.unionByName(body).repartitionByRange(F.col("_o"), F.xxhash64("value")).sortWithinPartitions("_o", "value").select("value").write.text(path)


# The data source


@dataclass(frozen=True)
class Header:
    field: str
    symmetry: str
    shape: tuple[int, int]
    stored: int
    path: str
    ends: int  # where the entries begin


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, name = fs.FileSystem.from_uri(path)
    info = system.get_file_info(name)
    check(info.type != fs.FileType.NotFound, f"{path} is not there")
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name))
    return system, sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def read_header(path: str) -> Header:
    """The header and size line of a file, or of the part of a folder that has them."""
    system, files = _files(path)
    for f in files:
        with system.open_input_file(f.path) as stream:
            head = b""
            while not head.startswith(b"%%") and len(head) < 2 < f.size:
                head += stream.read(2)
            if head != b"%%":
                continue
            lines, at, size = [], 0, None
            for line in _lines(stream, 0, f.size):
                at += len(line)
                text = line.decode("utf-8", "replace").strip()
                if not lines:
                    lines.append(parse_header(text))
                elif text and not text.startswith("%"):
                    size = text.split()
                    break
            check(size is not None and len(size) == 3, "no size line")
            return Header(*lines[0], (int(size[0]), int(size[1])), int(size[2]), f.path, at)
    raise ValueError(f"{path} has no Matrix Market header")


def _lines(stream, start: int, end: int) -> Iterator[bytes]:
    """Lines with their ends from a place on."""
    stream.seek(start)
    rest = b""
    while block := stream.read(min(1 << 16, end - stream.tell())):
        *lines, rest = (rest + block).split(b"\n")
        yield from (x + b"\n" for x in lines)
    if rest:
        yield rest


class _Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int, header_ends: int):
        self.path, self.start, self.end, self.header_ends = path, start, end, header_ends


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        check("path" in options, "a path is needed")
        self.path, self.bytes = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))
        self.header = read_header(self.path)

    def partitions(self) -> list[InputPartition]:
        out = []
        for f in _files(self.path)[1]:
            first = self.header.ends if f.path == self.header.path else 0
            out += [_Stretch(f.path, k, min(k + self.bytes, f.size), first) for k in range(first, f.size, self.bytes)]
        return out

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the stretch; the last of them may end beyond it."""
        system, _ = fs.FileSystem.from_uri(self.path)
        width = 2 if self.header.field == "pattern" else 3
        with system.open_input_file(partition.path) as stream:
            at = partition.start
            if at > partition.header_ends:  # a line that began before is another task's
                stream.seek(at - 1)
                at += self._to_line_end(stream) - 1
            while at < partition.end:
                stream.seek(at)
                chunk = stream.read(min(CHUNK_BYTES, partition.end - at))
                at += len(chunk)
                if not chunk.endswith(b"\n"):
                    stream.seek(at)
                    tail = self._line_end(stream)
                    chunk += tail
                    at += len(tail)
                if b"%" in chunk:
                    chunk = b"\n".join(x for x in chunk.split(b"\n") if not x.lstrip().startswith(b"%"))
                yield self._batch(np.array(chunk.split(), dtype=np.bytes_), width)

    @staticmethod
    def _line_end(stream) -> bytes:
        out = b""
        while block := stream.read(4096):
            cut = block.find(b"\n")
            if cut >= 0:
                return out + block[: cut + 1]
            out += block
        return out

    def _to_line_end(self, stream) -> int:
        return len(self._line_end(stream))

    def _batch(self, words: np.ndarray, width: int) -> pa.RecordBatch:
        check(len(words) % width == 0, "a line with too few or too many values")
        table = words.reshape(-1, width)
        i, j = table[:, 0].astype(np.int64) - 1, table[:, 1].astype(np.int64) - 1
        v = table[:, 2].astype(np.float64) if width == 3 else np.ones(len(table))
        if self.header.symmetry == "symmetric":
            off = i != j
            i, j, v = np.concatenate((i, j[off])), np.concatenate((j, i[off])), np.concatenate((v, v[off]))
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], names=["i", "j", "v"])


class MatrixMarket(DataSource):
    """spark.read.format("mtx").load(path): the entries (i, j, v), counted from zero, of a file or of a folder of parts.

    Tasks take stretches of bytes, aligned to lines, and a symmetric file is mirrored where it is read, so nothing is
    shuffled and no line is held twice. Paths are those that pyarrow's file systems open; mmread takes any that Spark does.
    Option partitionBytes: the length of a stretch."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "i long, j long, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixMarket)


def load(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> SparseMatrix:
    """The matrix of a path through the data source, with its shape."""
    register(spark)
    entries = spark.read.format("mtx").option("partitionBytes", str(partition_bytes)).load(path)
    return SparseMatrix(entries, read_header(path).shape, "float64", "coo")
