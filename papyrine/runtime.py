"""Session-level helpers: where lineage is cut, and joins that stay safe when one side or one key is large."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side that was measured may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder shared by all executors. A temporary one is set only for local masters without a setting."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="papyrine-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise df reliably: later plans read the shared folder, so lost executors cost no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """As cut(), in a compressed columnar table: for wide rows that later steps read column by column.

    The tables stand in the folder `tables` of the shared folder until sweep() removes them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Removes the tables that saved() wrote; results that read them must have been written before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sample_of(df: DataFrame, rows: int, key: Column) -> DataFrame:
    """A deterministic sample of about `rows` rows at most, chosen by the hash of key; for fitting models only.

    Whatever the table's size, little more than the sample leaves the executors.
    """
    total = df.count()
    if total > rows:
        df = df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < max(1, round(1_000_003 * rows / total)))
    return df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row, behind a generator, wherever they are used later.

    Expressions that are merely projected are inlined at each use, which repeats costly ones and may outgrow what code
    generation can compile.
    """
    packed = df.withColumn("_once", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return packed.select(*[c for c in df.columns if c not in columns], *(F.col("_once")[n].alias(n) for n in columns))


def bytes_of(df: DataFrame) -> Column:
    """About how many bytes a row takes: strings and arrays by their length, other values as eight."""
    out = F.lit(8)
    for field in df.schema.fields:
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, T.ArrayType):
            inner = F.aggregate(c, F.lit(0), lambda s, x: s + 16 + F.coalesce(F.octet_length(x), F.lit(0))) if isinstance(kind.elementType, (T.StringType, T.BinaryType)) else F.size(c) * 8
            out = out + 16 + F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0))
        elif isinstance(kind, (T.StringType, T.BinaryType)):
            out = out + 16 + F.coalesce(F.octet_length(c), F.lit(0))
        else:
            out = out + 8
    return out


def sized_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    *,
    limit: int = BROADCAST_ROWS,
    salts: int = 32,
    salt_by: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Join a large, possibly skewed left side with a right side that is unique by keys.

    The right side, which should be materialised, is measured (or `rows` says how many small rows it has). Up to `limit`
    rows and BROADCAST_BYTES it is broadcast. Beyond either both sides are spread over `salts` copies of each key, so that a key with a third of
    all left rows still ends up in many tasks. `how` is inner, left or left_semi.
    """
    size = 0
    if rows is None:
        rows, size = right.agg(F.count("*"), F.coalesce(F.sum(bytes_of(right).cast("long")), F.lit(0))).first()
    if rows <= limit and size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    by = F.xxhash64(*left.columns) if salt_by is None else salt_by
    salted = left.withColumn("_salt", F.pmod(by, F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
