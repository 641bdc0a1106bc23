"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the six
    white space characters that ``WORD`` leaves out."""
    return text.encode("utf-8", "replace").split() if text else []


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores put in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def lowest(rows: DataFrame, h: str, n: int) -> DataFrame:
    """``n`` rows whose 64-bit hash in column ``h`` is lowest, ties by the row.
    A bound on the hash leaves a few times as many, so that no task takes in
    more than that, however many partitions there are."""
    total = rows.count()
    if total > 8 * n:
        rows = rows.where(F.col(h) <= F.lit(int(4.0 * n / total * 2.0**64 - 2.0**63)).cast("long"))
    return rows.orderBy(h, *[c for c in rows.columns if c != h]).limit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it;
    one is set only where it names none and all runs on one machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="cueframe-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as compressed Parquet into the shared folder and read
    back: for wide rows, where a checkpoint would take too much disk.  What a
    session has written goes when its program ends."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/cueframe-{spark.sparkContext.applicationId}"
    if top not in _WRITTEN:
        _WRITTEN.add(top)
        atexit.register(_remove, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


#: Keys that hold more than this share of all rows are fewer than its inverse: small enough to broadcast, whatever the data.
HOT_SHARE = 2.0**-16
#: Rows of a side that are broadcast whole at most.
BROADCAST_ROWS = 1 << 17


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined by ``keys`` to ``right``, which has a row per key and in
    column ``n`` how many of the ``total`` rows of ``left`` hold it; ``how`` is
    inner, left_semi or left.  ``right`` is broadcast below a checked number of
    rows.  Beyond it only its hot keys are, by ``HOT_SHARE``, and the others
    are shuffled: no key moves more of ``left`` than that share.  ``left`` is
    read twice then, so it should be a checkpoint or a table."""
    rest = right.drop(n)
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(rest), keys, how)
    hot = right.where(F.col(n) > total * HOT_SHARE).drop(n)
    lacking = F.lit(False)
    for key in keys:
        lacking = lacking | F.col(key).isNull()
    without, left = left.where(lacking), left.where(~lacking)
    one = left.join(F.broadcast(hot), keys, "inner" if how == "left" else how)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    both = one.unionByName(cold)
    return both.unionByName(without, allowMissingColumns=True) if how == "left" else both
