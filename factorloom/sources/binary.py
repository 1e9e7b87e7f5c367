"""Big-endian binary graph files: splittable scans of fixed records, whole files otherwise, and a writer data source.

Weights and variables have fixed records, and so have factor and domain files whose records are alike
in arity, as files of one factor rule are. Those are read through Hadoop's fixed-length input, so a file
of any size is cut into splits, and a task decodes its records as numpy record types, a batch at a time.
Files of mixed records have no place to cut them at: they come through Spark's binaryFile source, a file
a row, which bounds them at 2 GB. The writer puts a file per partition under a folder, through pyarrow's
file systems, and moves it in place when all tasks have committed.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from factorloom import schema
from factorloom.sources.text import dense_ids

#: Layouts of fixed-length records.
WEIGHT = np.dtype([("wid", ">u8"), ("is_fixed", "u1"), ("init_value", ">f8")])
VARIABLE = np.dtype([("vid", ">u8"), ("role", "u1"), ("init_value", ">u8"), ("dtype", ">u2"), ("cardinality", ">u8")])
PAIR = {"domains": np.dtype([("value", ">u8"), ("truthiness", ">f8")]), "factors": np.dtype([("vid", ">u8"), ("equal_to", ">u8")])}
KINDS = {"weights": schema.WEIGHTS, "variables": schema.VARIABLES, "domains": schema.DOMAINS, "factors": schema.FACTORS.split(", ", 1)[1]}


def layout(kind: str, n: int = 0) -> np.dtype:
    """The record type of a kind, for factors and domains of n pairs."""
    if kind == "weights":
        return WEIGHT
    if kind == "variables":
        return VARIABLE
    if kind == "domains":
        return np.dtype([("vid", ">u8"), ("cardinality", ">u8"), ("pairs", PAIR[kind], (n,))])
    return np.dtype([("func", ">u2"), ("arity", ">u8"), ("pairs", PAIR[kind], (n,)), ("wid", ">u8"), ("feature_value", ">f8")])


def decode_fixed(kind: str, a: np.ndarray, n: int = 0) -> pa.RecordBatch:
    """Columns of equally long records."""
    i8 = lambda x: np.ascontiguousarray(x).astype("i8")
    if kind == "weights":
        columns = {"wid": i8(a["wid"]), "is_fixed": a["is_fixed"] != 0, "init_value": a["init_value"].astype("f8")}
    elif kind == "variables":
        columns = {c: a[c].astype(t) for c, t in (("vid", "i8"), ("role", "i1"), ("init_value", "i8"), ("dtype", "i2"), ("cardinality", "i8"))}
    else:
        pairs, offsets = a["pairs"].reshape(-1), pa.array(np.arange(len(a) + 1, dtype=np.int32) * n)
        if kind == "domains":
            items = pa.StructArray.from_arrays([pa.array(i8(pairs["value"])), pa.array(pairs["truthiness"].astype("f8"))], names=["value", "truthiness"])
            columns = {"vid": i8(a["vid"]), "cardinality": i8(a["cardinality"]), "vals": pa.ListArray.from_arrays(offsets, items)}
        else:
            at = pa.array(np.tile(np.arange(n, dtype=np.int32), len(a)))
            items = pa.StructArray.from_arrays([at, pa.array(i8(pairs["vid"])), pa.array(i8(pairs["equal_to"]))], names=["pos", "vid", "equal_to"])
            columns = {"func": a["func"].astype("i2"), "arity": i8(a["arity"]), "vifs": pa.ListArray.from_arrays(offsets, items), "wid": i8(a["wid"]), "feature_value": a["feature_value"].astype("f8")}
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def decode(kind: str, content: bytes) -> pd.DataFrame:
    """Rows of one file of mixed records."""
    rows, at = [], 0
    while at < len(content):
        if kind == "domains":
            vid, n = struct.unpack_from(">QQ", content, at)
            vals = np.frombuffer(content, PAIR[kind], n, at + 16)
            at += 16 + 16 * n
            rows.append((vid, n, [{"value": int(v), "truthiness": float(t)} for v, t in vals]))
        else:
            func, n = struct.unpack_from(">HQ", content, at)
            pairs = np.frombuffer(content, PAIR[kind], n, at + 10)
            wid, feature = struct.unpack_from(">Qd", content, at + 10 + 16 * n)
            at += 26 + 16 * n
            rows.append((func, n, [{"pos": i, "vid": int(v), "equal_to": int(e)} for i, (v, e) in enumerate(pairs)], wid, feature))
    return pd.DataFrame(rows, columns=["vid", "cardinality", "vals"] if kind == "domains" else ["func", "arity", "vifs", "wid", "feature_value"])


def encode(kind: str, row) -> bytes:
    """One record."""
    if kind == "weights":
        return struct.pack(">QBd", row.wid, row.is_fixed, row.init_value)
    if kind == "variables":
        return struct.pack(">QBQHQ", row.vid, row.role, row.init_value, row.dtype, row.cardinality)
    if kind == "domains":
        return struct.pack(">QQ", row.vid, row.cardinality) + b"".join(struct.pack(">Qd", v["value"], v["truthiness"]) for v in row.vals)
    pairs = b"".join(struct.pack(">QQ", v["vid"], v["equal_to"]) for v in sorted(row.vifs, key=lambda v: v["pos"]))
    return struct.pack(">HQ", row.func, row.arity) + pairs + struct.pack(">Qd", row.wid, row.feature_value)


def _fixed(spark: SparkSession, kind: str, paths: list[str], n: int) -> DataFrame:
    """Records of one length as rows of one binary column, read in splits by the JVM."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    records = jsc.binaryRecords(",".join(p.replace(",", "\\,") for p in paths), layout(kind, n).itemsize)
    return DataFrame(spark._jsparkSession.createDataset(records.rdd(), jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).withColumnRenamed("value", "record")


def _decoded(records: DataFrame, kind: str, n: int) -> DataFrame:
    kept = layout(kind, n)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decode_fixed(kind, np.frombuffer(b"".join(batch.column(0).to_pylist()), kept), n)

    return records.mapInArrow(rows, KINDS[kind])


def _files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of the files that aren't empty, in the order given and by name inside folders."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        every = at.getFileSystem(conf).globStatus(at)
        for top in every or []:
            inner = sorted(top.getPath().getFileSystem(conf).listStatus(top.getPath()), key=lambda s: s.getPath().getName())
            found += [(s.getPath().toString(), s.getLen()) for s in inner if s.isFile() and s.getLen() and not s.getPath().getName().startswith((".", "_"))]
        if not every:
            raise FileNotFoundError(path)
    return found


def _first_pairs(spark: SparkSession, kind: str, path: str) -> int:
    """How many pairs the first record of a file has."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        stream.skipBytes(8 if kind == "domains" else 2)
        return stream.readLong()
    finally:
        stream.close()


def read_binary(spark: SparkSession, kind: str, paths) -> DataFrame:
    """weights, variables, domains or factors from files or folders; factors are numbered in file order.

    Neighbouring files of one record length are one scan. Whether all records of such a scan are alike
    is looked at first, by their arity fields alone; if not, its files are read whole.
    """
    files, parts = _files(spark, [paths] if isinstance(paths, str) else list(paths)), []
    runs: list[tuple[int, list[str]]] = []
    for path, size in files:
        n = _first_pairs(spark, kind, path) if kind in PAIR else 0
        n = n if n >= 0 and size % layout(kind, n if n < 1 << 26 else 0).itemsize == 0 and n < 1 << 26 else -1
        if runs and runs[-1][0] == n:
            runs[-1][1].append(path)
        else:
            runs.append((n, [path]))
    for n, some in runs:
        records = _fixed(spark, kind, some, n) if n >= 0 else None
        if records is not None and kind in PAIR:
            field = F.conv(F.hex(F.substring("record", 9 if kind == "domains" else 3, 8)), 16, 10)
            records = records if records.where(field != str(n)).isEmpty() else None
        parts.append(_decoded(records, kind, n) if records is not None else _whole(spark, kind, some))
    found = spark.createDataFrame([], KINDS[kind]) if not parts else parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return dense_ids(found, "fid").select("fid", "func", "arity", "vifs", "wid", "feature_value") if kind == "factors" else found


def _whole(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield decode(kind, content)

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(rows, KINDS[kind])


class _Committed(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


def _store(path: str):
    """(pyarrow file system, path in it); plain paths are local ones."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


class GraphBinarySource(DataSource):
    """format("factorloom_binary") with options path and kind; write only."""

    @classmethod
    def name(cls) -> str:
        return "factorloom_binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return GraphBinaryWriter(self.options["path"], self.options["kind"])


class GraphBinaryWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path, kind

    def write(self, rows) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        made = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(made) as f:
            for row in rows:
                f.write(encode(self.kind, row))
        return _Committed(made)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        for i, m in enumerate(messages):
            if m is not None:
                store.move(m.path, f"{root}/part-{i:05d}.bin")

    def abort(self, messages) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


def write_binary(df: DataFrame, kind: str, path: str) -> None:
    df.sparkSession.dataSource.register(GraphBinarySource)
    df.write.format("factorloom_binary").option("path", path).option("kind", kind).mode("append").save()
