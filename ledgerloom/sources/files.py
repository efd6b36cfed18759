"""File formats: trace lines, 24-byte workload records, the segmented log, commits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

TRACE = "`from` STRING, `to` STRING, value STRING, input STRING"
#: Fixed value: bytes of a workload record: source, 6 zero bytes, target, 6 zero bytes; numbers of 6 bytes, lowest first.
RECORD = 24
RECORDS_PER_SPLIT = 1 << 18


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines from files of one JSON object a line; malformed lines are left out."""
    return spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)


def parse_traces(lines: DataFrame, column: str = "line") -> DataFrame:
    """The same from a column of lines; other columns stay."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.withColumn("_t", F.from_json(column, TRACE + ", _bad STRING", options)).where("_t._bad IS NULL")
    return parsed.select(*[c for c in lines.columns if c != column], "_t.from", "_t.to", "_t.value", "_t.input")


class _Split(InputPartition):
    def __init__(self, path: str, start: int, count: int) -> None:
        self.path, self.start, self.count = path, start, count


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.endswith(".bin")), key=lambda f: f.path)
        out: list[InputPartition] = []
        for f in found:
            if f.size % RECORD:
                raise ValueError(f"{f.path} does not hold whole records")
            out += [_Split(f.path, k, min(RECORDS_PER_SPLIT, f.size // RECORD - k)) for k in range(0, f.size // RECORD, RECORDS_PER_SPLIT)]
        return out

    def read(self, split: _Split) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(split.path) as file:
            file.seek(split.start * RECORD)
            raw = np.frombuffer(file.read(split.count * RECORD), "<u2").reshape(-1, 12).astype(np.int64)
        number = lambda k: raw[:, k] | raw[:, k + 1] << 16 | raw[:, k + 2] << 32
        yield pa.RecordBatch.from_arrays([pa.array(number(0)), pa.array(number(6))], ["src", "dst"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        temporary = f"{root}/_{part:06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            for row in rows:
                out.write(int(row.src).to_bytes(6, "little") + b"\0" * 6 + int(row.dst).to_bytes(6, "little") + b"\0" * 6)
        store.move(temporary, f"{root}/part-{part:06d}.bin")
        return WriterCommitMessage()


class WorkloadSource(DataSource):
    """``format("workload")``: (src, dst) in 24-byte records. A folder of .bin files or one file; ``path`` is a URI."""

    @classmethod
    def name(cls) -> str:
        return "workload"

    def schema(self) -> str:
        return "src long, dst long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def decode_records(files: DataFrame) -> DataFrame:
    """(path, n, src, dst) of records in whole files as the built-in binary source gives them (path, content)."""
    from ..functions.hashing import from_little_endian

    each = files.select("path", "content", F.posexplode(F.sequence(F.lit(0), (F.length("content") / RECORD).cast("int") - 1)).alias("n", "_i"))
    at = F.col("n") * RECORD + 1
    return each.select("path", "n", from_little_endian(F.substring("content", at, F.lit(6)), 6).alias("src"), from_little_endian(F.substring("content", at + 12, F.lit(6)), 6).alias("dst"))


# --- the segmented log ----------------------------------------------------------------------------------------------


def segmented(positioned: DataFrame, size: int) -> DataFrame:
    """Positions with the segment file that holds them."""
    return positioned.withColumn("segment", F.floor(F.col("pos") / size).cast("bigint"))


def byte_range(data: F.Column, start: F.Column, end: F.Column) -> F.Column:
    """Bytes ``start`` to before ``end``; a range that does not lie within the data is an error."""
    sound = (start >= 0) & (start <= end) & (end <= F.octet_length(data))
    return F.when(sound, F.substring(data, (start + 1).cast("int"), (end - start).cast("int"))).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no bytes"), start, F.lit("to"), end, F.lit("of"), F.octet_length(data))).cast("binary"))


def segment_files(positioned: DataFrame, size: int) -> DataFrame:
    """(shard, segment, entries, first_pos, bytes, overflow): an entry belongs to the segment it starts in; what it writes
    past that segment's end lies at the head of the next, which is therefore padded by ``overflow``."""
    rows = segmented(positioned, size).groupBy("shard", "segment").agg(F.count("*").alias("entries"), F.min("pos").alias("first_pos"), F.sum("len").alias("bytes"), F.max(F.col("pos") + F.col("len")).alias("end"))
    return rows.withColumn("overflow", F.greatest(F.lit(0), F.col("end") - (F.col("segment") + 1) * size).cast("bigint")).drop("end")


def prune_head(segments: DataFrame, offset: int | F.Column, size: int) -> DataFrame:
    """What is left when whole segments below ``offset`` are dropped."""
    bound = F.lit(offset // size) if isinstance(offset, int) else F.floor(offset / size)
    return segments.where(F.col("segment") >= bound)


def truncate_tail(segments: DataFrame, size: int | F.Column) -> DataFrame:
    return segments.where(F.col("pos") + F.col("len") <= size)


def write_log(positioned: DataFrame, path: str, size: int) -> None:
    """Appends entries as Parquet, partitioned by shard and segment, so that pruning drops folders."""
    segmented(positioned, size).write.mode("append").partitionBy("shard", "segment").parquet(path)


def newest(commits: DataFrame) -> DataFrame:
    """The commit row with the greatest height of each slot, of alternating slots by height parity, and then of both."""
    slots = commits.groupBy((F.col("height") % 2).alias("slot")).agg(F.max_by(F.struct(*commits.columns), "height").alias("c")).select("c.*")
    return slots.agg(F.max_by(F.struct(*commits.columns), "height").alias("c")).select("c.*")
