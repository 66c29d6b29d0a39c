"""Tensor bundles: columns as numpy files in shards, with a description, written by a Spark job in two phases.

Tasks write shards of at most `SHARD_ROWS` rows into a staging folder of the job under names of their own.  Only when
all have ended does the driver move the shards that it was told of into place, in the order of partitions, and write the description
last; a bundle without it doesn't exist.  Shards of failed or repeated tasks stay behind in the staging folder, which goes with the job's end, and an
aborted job leaves nothing."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quadrille.session import ship

SHARD_ROWS = 1 << 16
META = "meta.json"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    shards: list[tuple[str, int, dict]]  # name, rows, and by column the type and the shape of a row


def array_of(column: pa.Array, name: str) -> np.ndarray:
    """Numbers as a vector, lists of one length as a matrix; nulls have no place in a tensor."""
    if column.null_count:
        raise ValueError(f"{name} has nulls: fill them before they become a tensor")
    if pa.types.is_list(column.type):
        size = np.unique(np.diff(column.offsets.to_numpy()))
        flat = column.flatten()
        if len(size) > 1 or flat.null_count:
            raise ValueError(f"the rows of {name} aren't all of one length, or have nulls")
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.timestamp("us")).to_numpy(zero_copy_only=False).astype("datetime64[us]").astype(np.int64)
    out = column.to_numpy(zero_copy_only=False)
    if out.dtype.kind not in "biuf":
        raise ValueError(f"{name} is neither numbers nor times")
    return out


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite, self.about = options["path"], overwrite, json.loads(options.get("about", "{}"))
        self.rows = int(options.get("shard_rows", SHARD_ROWS))
        self.job = uuid.uuid4().hex
        files, root = pyarrow.fs.FileSystem.from_uri(self.uri)
        if not overwrite and files.get_file_info(f"{root}/{META}").is_file:
            raise ValueError(f"there is a bundle at {self.uri}")

    @property
    def _staging(self) -> str:
        return f"_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = pyarrow.fs.FileSystem.from_uri(self.uri)
        files.create_dir(f"{root}/{self._staging}", recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        done: list[tuple[str, int, dict]] = []

        def flush(batches):
            table = pa.Table.from_batches(batches).combine_chunks()
            name, kinds = f"{task:06d}-{len(done):06d}-{attempt}", {}
            for c in table.column_names:
                x = array_of(table.column(c).chunk(0), c)
                kinds[c] = (str(x.dtype), list(x.shape[1:]))
                body = io.BytesIO()
                np.save(body, x, allow_pickle=False)
                with files.open_output_stream(f"{root}/{self._staging}/{c}.{name}.npy") as f:
                    f.write(body.getvalue())
            done.append((name, table.num_rows, kinds))

        held, rows = [], 0
        for batch in iterator:
            while batch.num_rows:
                part = batch.slice(0, self.rows - rows)
                held, rows, batch = [*held, part], rows + part.num_rows, batch.slice(part.num_rows)
                if rows == self.rows:
                    flush(held)
                    held, rows = [], 0
        if rows:
            flush(held)
        return Written(task, done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = pyarrow.fs.FileSystem.from_uri(self.uri)
        shards = [s for m in sorted((m for m in messages if m), key=lambda m: m.partition) for s in m.shards]
        kinds = {json.dumps(k, sort_keys=True) for _, _, k in shards}
        if len(kinds) > 1:
            self.abort(messages)
            raise ValueError("shards differ in the types or lengths of their rows")
        columns = {c: {"type": t, "shape": [sum(n for _, n, _ in shards), *row]} for c, (t, row) in json.loads(kinds.pop()).items()} if kinds else {}
        if self.overwrite:
            for old in files.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
                if old.is_file and (old.base_name == META or old.extension == "npy"):
                    files.delete_file(old.path)
        files.create_dir(root, recursive=True)
        for i, (name, _, _) in enumerate(shards):
            for c in columns:
                files.move(f"{root}/{self._staging}/{c}.{name}.npy", f"{root}/{c}.{i:06d}.npy")
        with files.open_output_stream(f"{root}/{META}.{self.job}") as f:
            f.write(json.dumps({"columns": columns, "rows": [n for _, n, _ in shards], **self.about}, indent=1).encode())
        files.move(f"{root}/{META}.{self.job}", f"{root}/{META}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*pyarrow.fs.FileSystem.from_uri(self.uri))

    def _clear(self, files, root: str) -> None:
        if files.get_file_info(f"{root}/{self._staging}").type == pyarrow.fs.FileType.Directory:
            files.delete_dir(f"{root}/{self._staging}")


class BundleSink(DataSource):
    """Format `bundle`: path (a URI or an absolute path that driver and executors share), shard_rows, and `about`, JSON that goes into the description."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options, overwrite)


def write_bundle(df: DataFrame, path: str, about: dict | None = None, overwrite: bool = False, shard_rows: int = SHARD_ROWS) -> None:
    """Rows in the order of partitions and, inside each, as they stand; sort before."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(BundleSink)
    df.write.format("bundle").mode("overwrite" if overwrite else "append").options(path=path, about=json.dumps(about or {}), shard_rows=shard_rows).save()


def description(path: str) -> dict:
    files, root = pyarrow.fs.FileSystem.from_uri(path)
    with files.open_input_file(f"{root}/{META}") as f:
        return json.loads(f.read())


def shard(path: str, column: str, i: int) -> np.ndarray:
    files, root = pyarrow.fs.FileSystem.from_uri(path)
    with files.open_input_file(f"{root}/{column}.{i:06d}.npy") as f:
        return np.load(io.BytesIO(f.read()), allow_pickle=False)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The bundle as a table (position, columns ...): vectors as numbers, matrices as arrays of doubles; a task reads whole shards."""
    ship(spark)
    about = description(path)
    columns = about["columns"]
    starts = np.concatenate([[0], np.cumsum(about["rows"])]).tolist()
    kind = lambda c: ("array<double>" if len(columns[c]["shape"]) > 1 else "double" if columns[c]["type"][0] == "f" else "long")

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                out = [pa.array(np.arange(starts[i], starts[i + 1]))]
                for c in columns:
                    x = shard(path, c, i)
                    if x.ndim > 1:
                        out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(float).ravel())))
                    else:
                        out.append(pa.array(x.astype(float if kind(c) == "double" else np.int64)))
                yield pa.RecordBatch.from_arrays(out, names=["position", *columns])

    schema = ", ".join(["position long", *(f"`{c}` {kind(c)}" for c in columns)])
    return spark.range(0, len(about["rows"]), 1, max(1, len(about["rows"]))).mapInArrow(run, schema)
