"""Binary sets as DataFrames: (set_id, payload) to and from (set_id, value), and files of them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import key, low, spread
from . import codec


def encode(sets: DataFrame, standard: bool = False, write=codec.assemble) -> DataFrame:
    """set_id, payload of each set; write is the form's writer. Blocks are built in parallel, 65,536 values at most each; a set's
    compact payloads then meet in one row, as its bytes must."""

    def block(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [codec.container(x.values.to_numpy()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x.values) for x in batch.column(2)], pa.int32()), pa.array([k for k, _ in made], pa.int32()), pa.array([p for _, p in made], pa.binary())], ["set_id", "key", "card", "form", "data"])

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            ends, items = lists.offsets.to_pylist(), lists.values
            fields = [items.field(k) for k in range(4)]
            for k in range(batch.num_rows):  # a set at a time, as payloads can be large
                numbers = [f.slice(ends[k], ends[k + 1] - ends[k]).to_pylist() for f in fields]
                made = write(list(zip(*numbers, strict=True)), standard)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([made], pa.binary())], ["set_id", "payload"])

    lows = spread(sets.select(F.col("set_id").cast("string").alias("set_id"), key().alias("key"), low().alias("low")), "set_id", "key").distinct()
    lists = lows.groupBy("set_id", "key").agg(F.array_sort(F.collect_list("low")).alias("lows"))
    blocks = lists.mapInArrow(block, "set_id string, key int, card int, form int, data binary")
    rows = blocks.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("key", "card", "form", "data"))).alias("blocks"))
    return rows.mapInArrow(whole, "set_id string, payload binary")


def decode(blobs: DataFrame, validate: bool = True, read=codec.decode) -> DataFrame:
    """set_id, value of every sound payload; read is the form's reader."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k, payload in enumerate(batch.column(1)):
                values = read(payload.as_py(), validate)
                for at in range(0, 0 if values is None else len(values), 1 << 16):
                    part = values[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(part), k))), pa.array(part, pa.int64())], ["set_id", "value"])

    return blobs.select(F.col("set_id").cast("string").alias("set_id"), "payload").mapInArrow(run, "set_id string, value bigint")


def validity(blobs: DataFrame) -> DataFrame:
    """set_id, is_valid, n (null if not valid)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [codec.decode(p.as_py()) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v is not None for v in found]), pa.array([None if v is None else len(v) for v in found], pa.int64())], ["set_id", "is_valid", "n"])

    return blobs.select(F.col("set_id").cast("string").alias("set_id"), "payload").mapInArrow(run, "set_id string, is_valid boolean, n bigint")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """set_id (the file's name, without the .set that write_files() adds), payload of a folder with one set a file."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[.]set$", "")
    return spark.read.format("binaryFile").load(path).select(F.url_decode(name).alias("set_id"), F.col("content").alias("payload"))


def _store(path: str):
    """The file system of a path or URI, as workers see it, and the path in it."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def write_files(blobs: DataFrame, path: str) -> DataFrame:
    """Write one file a set, named by set_id with .set after it, into a folder that all workers share.

    Gives set_id, file, length of what was written. A file appears whole under its name, so a task that
    runs again writes the same file again. Characters of set_id outside letters, digits, -, _ and . are
    written as % and their UTF-8 bytes, as read_files() reads them.
    """

    def run(batches: Iterator) -> Iterator:
        from urllib.parse import quote

        import pyarrow as pa

        store, top = _store(path)
        store.create_dir(top)
        for batch in batches:
            files = []
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                files.append(f"{quote(name, safe='')}.set")
                _write(store, f"{top}/{files[-1]}", [payload.as_py()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string()), pa.array([len(p.as_py()) for p in batch.column(1)], pa.int64())], ["set_id", "file", "length"])

    out = blobs.select(F.col("set_id").cast("string").alias("set_id"), "payload").mapInArrow(run, "set_id string, file string, length bigint")
    return out.sparkSession.createDataFrame(out.collect(), out.schema)  # a row a set, names only


def _write(store, target: str, parts: list[bytes]) -> None:
    import uuid

    draft = f"{target}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        for part in parts:
            f.write(part)
    store.move(draft, target)


def write_packed(blobs: DataFrame, path: str, files: int = 1) -> DataFrame:
    """Write sets packed in some files of a shared folder, each set at a multiple of 64 bytes.

    Gives the directory: set_id, file, offset, length. A set's file is a hash of its id, so a file holds
    its share of all sets; take as many files as make them a fit size.
    """

    def run(key, table):
        import pyarrow as pa

        store, top = _store(path)
        store.create_dir(top)
        name, at, offsets, parts = f"packed-{key[0].as_py():05d}", 0, [], []
        for payload in table.column("payload"):
            data = payload.as_py()
            offsets.append(at)
            parts += [data, bytes(-len(data) % 64)]
            at += len(data) + len(parts[-1])
        _write(store, f"{top}/{name}", parts)
        lengths = [len(p) for p in parts[::2]]
        return pa.table({"set_id": table.column("set_id"), "file": pa.array([name] * len(lengths)), "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())})

    dealt = blobs.select(F.col("set_id").cast("string").alias("set_id"), "payload", F.expr(f"cast(pmod(xxhash64(set_id), {files}) as int)").alias("part"))
    out = dealt.groupBy("part").applyInArrow(run, "set_id string, file string, offset bigint, length bigint")
    return out.sparkSession.createDataFrame(out.collect(), out.schema)


def read_packed(path: str, directory: DataFrame) -> DataFrame:
    """set_id, payload of sets packed in files of a folder; directory has set_id, file, offset, length.

    Every directory row reads its own range of its file, on the worker that has the row. A range past
    the file's end gives the bytes that are there.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, top = _store(path)
        for batch in batches:
            for k in range(batch.num_rows):
                with store.open_input_file(f"{top}/{batch.column(1)[k].as_py()}") as f:
                    size, at = f.size(), batch.column(2)[k].as_py()
                    data = f.read_at(max(0, min(batch.column(3)[k].as_py(), size - at)), min(at, size))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([data], pa.binary())], ["set_id", "payload"])

    rows = directory.select(F.col("set_id").cast("string").alias("set_id"), F.col("file").cast("string").alias("file"), F.col("offset").cast("bigint").alias("offset"), F.col("length").cast("bigint").alias("length"))
    return rows.mapInArrow(run, "set_id string, payload binary")
