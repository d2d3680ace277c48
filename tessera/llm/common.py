"""What the operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import ship, shared_dir, stage_table, workspace  # noqa: F401

#: Bytes that split words: space and \x09-\x0D, just what bytes.split() splits on.
SPACE = "\\x20\\x09-\\x0D"
#: Fixed tables: ASCII upper case to lower case, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def spread(names: DataFrame) -> DataFrame:
    """Names of files dealt evenly, one or a few to a task."""
    most = 8 * int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(max(1, min(names.count(), most)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(table: pa.Table, codec: str = "zstd") -> pa.Buffer:
    """As a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as w:
        w.write_table(table)
    return sink.getvalue()


class Files:
    """Files of a shared folder, each written whole or not at all."""

    def __init__(self, uri: str):
        self.files, self.root = pafs.FileSystem.from_uri(uri)
        self.files.create_dir(self.root, recursive=True)

    def write(self, name: str, parts: list) -> None:
        own = f"{self.root}/.{name}-{np.random.SeedSequence().entropy:x}"
        with self.files.open_output_stream(own) as out:
            for x in parts:
                out.write(x)
        try:
            self.files.move(own, f"{self.root}/{name}")
        except OSError:  # another attempt's file, of the same content, is there
            if self.files.get_file_info(f"{self.root}/{name}").type != pafs.FileType.File:
                raise
            self.files.delete_file(own)

    def read(self, name: str) -> pa.Buffer:
        with self.files.open_input_stream(f"{self.root}/{name}") as f:
            return pa.py_buffer(f.read())

    def read_if(self, name: str) -> pa.Buffer:
        """Empty if there is no such file."""
        there = self.files.get_file_info(f"{self.root}/{name}").type == pafs.FileType.File
        return self.read(name) if there else pa.py_buffer(b"")


#: Rows of an Arrow batch at most: a batch of whole texts lies in the memory of the executor and of its worker more than once.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow with this package shipped to the workers; columns with dots in their names pass under other names."""
    ship(df.sparkSession)
    if not 0 < int(df.sparkSession.conf.get(_ROWS)) <= BATCH_ROWS:
        df.sparkSession.conf.set(_ROWS, str(BATCH_ROWS))
    if any("." in c or "`" in c for c in df.columns):
        df = df.toDF(*(f"{i}_th_column" if "." in c or "`" in c else c for i, c in enumerate(df.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Memory that a task has freed goes back to the machine: workers live on, and each keeps what its largest task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def append(df: DataFrame, column: str, added: T.StructType, f: Callable[[list], list[list]]) -> DataFrame:
    """df with new columns from one string column, row for row.

    f takes the column's values of a batch as UTF-8 bytes (None: null) and
    returns one list for each added column. The names in ``added`` must not
    be in df. No shuffle.
    """
    arrow = to_arrow_schema(added)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                new = f(raw(part.column(at)))
                arrays = [pa.array(v, type=t.type) for v, t in zip(new, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *arrow.names])

    return map_arrow(df, run, T.StructType([*df.schema.fields, *added.fields]))


def raw(column: pa.Array) -> list:
    """Strings as UTF-8 bytes; nulls as None."""
    return column.cast(pa.binary()).to_pylist()


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text (null: 0), and all words one after the other. Words are runs without SPACE."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = split.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.append(0, np.cumsum(real))
    ends = np.cumsum(np.append(0, pc.list_value_length(split).to_numpy(zero_copy_only=False)))
    return np.diff(before[ends]), words.filter(pa.array(real))


def byte_values(words: pa.Array) -> list[bytes]:
    """Binary or string values, none of them null."""
    if not len(words):
        return []
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    every = data.to_pybytes() if data is not None else b""
    return [every[a:z] for a, z in zip(at, at[1:], strict=False)]


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def fields(spec: str) -> T.StructType:
    """"name type, ..." with plain types or array<type>; needs no session, unlike Spark's own parser."""

    def kind(t: str) -> T.DataType:
        return T.ArrayType(kind(t[6:-1])) if t.startswith("array<") else _TYPES[t]

    return T.StructType([T.StructField(*(n, kind(t))) for n, t in (x.split() for x in spec.split(","))])
