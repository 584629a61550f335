"""What the operators of this package share: durable tables, partition counts and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules, as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]+"


#: Durable tables made within each scratch() that is open.
_MADE: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is named and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        made = tempfile.mkdtemp(prefix="cairnpath-")
        spark.conf.set("spark.checkpoint.dir", f"file://{made}")
        return f"file://{made}"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    for made in _MADE:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Lists the durable tables made inside, for forget() once nothing reads them any more."""
    made: list[DataFrame] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)


def forget(df: DataFrame) -> None:
    """Removes what durable() wrote, once nothing reads it any more."""
    jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
    path = jvm.org.apache.hadoop.fs.Path(df._cairn_path)
    path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(aggregated: DataFrame) -> DataFrame:
    """An aggregate dealt out anew: a join with it then shuffles both sides, and Spark can split a key with very many rows."""
    return aggregated.repartition(parts(aggregated.sparkSession))


def sorted_in(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting and never by way of the driver: what is left of many rows, as those that an explode makes, is sized by the small file that they come from."""
    return df.hint("merge")


def whole(column: str) -> Column:
    """A text column whose null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores behind it as make it a column that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
