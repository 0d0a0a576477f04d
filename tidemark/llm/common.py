"""What the operators share: the cluster's shared folder, cutting lineage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What parts words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Keeps an Arrow batch at a few MB whatever the length of its texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; on one machine (tests) a folder of our own where it is unset."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster sees")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: a cut lineage that outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name`` of longs that are different for each row and stay the same however often they are read: the row's file, hashed, and its place in it.

    Nothing is written and no text is moved. File hashes are tried until all files have different ones, which is counted. What is not read straight from files
    is written as a table first.
    """
    def placed(df):
        at = df.metadataColumn("_metadata")
        return df.withColumn("_file_of_row", at["file_path"]).withColumn(name, at["row_index"])

    try:
        rows = placed(docs)
        rows.schema  # noqa: B018
    except AnalysisException:
        rows = placed(cut(docs, "rows"))
    files = rows.groupBy("_file_of_row").agg(F.max(name).alias("_last"))
    last, n = files.agg(F.max("_last"), F.count("*")).first()
    bits = max(1, int(last or 0).bit_length())
    code = lambda seed: F.pmod(F.xxhash64("_file_of_row", F.lit(seed)), F.lit(1 << (63 - bits)))
    for seed in range(100):
        if files.agg(F.count_distinct(code(seed))).first()[0] == n:
            return rows.withColumn(name, F.shiftleft(code(seed), bits).bitwiseOR(F.col(name))).drop("_file_of_row")
    raise RuntimeError(f"no hash parts {n} files")


def drop_cut(df: DataFrame) -> None:
    """Deletes the table that ``cut`` wrote, once nothing reads it any more."""
    if path := getattr(df, "cut_path", None):
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


#: A key with over one in HOT of all rows is salted; there can be only HOT of them. Each goes to SALTS tasks.
HOT, SALTS = 1000, 64


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], spread: str, rows: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row for each key and in _n how many rows of ``big`` have it, of ``rows`` in all.

    Rows of a key with over a thousandth of all are dealt over 64 tasks by a hash of ``spread``, and small's row goes to each. Such keys are at most 1000,
    which bounds what is broadcast. ``small`` is read twice, so it should be a table.
    """
    often = F.col("_n") > max(rows // HOT, 1)
    hot = small.where(often).select(*keys, F.lit(True).alias("_hot"))
    salted = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    each = small.withColumn("_salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_n")
    return salted.join(each, [*keys, "_salt"], how).drop("_salt")


def arrow_map(df: DataFrame, fn: Callable, schema: str, pieces: int = 0) -> DataFrame:
    """``mapInArrow`` over whole rows; ``fn`` gets a RecordBatch and returns a dict of columns (or None).

    pieces: the most bytes of a string column "text" in one call, if over 0; a batch over that is taken in slices.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)
    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, pieces) if pieces else (whole,):
                if (got := fn(batch)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out_schema], schema=out_schema)

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, keep: Callable, pieces: int) -> DataFrame:
    """The rows of ``df`` for which ``keep`` says so, with all their columns; it gets RecordBatches of about ``pieces`` bytes of "text" and returns a flag for each row."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, pieces):
                yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; a longer text is alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i under at least n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def windows(values: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of each run of ``length`` successive uint64 values (of any documents)."""
    n = len(values)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix64((sums[length:] - sums[:-length]) * down[: n - length + 1])


class Words:
    """The words of a batch of texts: byte places, hashes and the document of each, found for all texts at once."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        b = np.frombuffer(joined, np.uint8)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.bytes = joined
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.offset = offsets[:-1]
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._b = b

    def hashes(self, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        up, down = powers(base, len(self._b) + 1)
        sums = np.zeros(len(self._b) + 1, np.uint64)
        np.cumsum((self._b.astype(np.uint64) + np.uint64(1)) * up[: len(self._b)], out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def word_count(text):
    """Words of a text column; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)), F.lit(0)).cast("long")


def count_pieces(rows: int, each: int) -> int:
    return max(1, -(-int(rows) // each))
