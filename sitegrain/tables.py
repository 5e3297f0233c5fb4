"""Tables that are written between steps, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none and runs in one process (tests), a temporary folder is used.
    On a cluster without the setting this raises, as no machine-local folder could be right.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOTS:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN_ROOTS[app] = tempfile.mkdtemp(prefix="sitegrain-")
        spark.sparkContext.setCheckpointDir(_OWN_ROOTS[app])
    return _OWN_ROOTS[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks alone, and nothing
    upstream runs twice or is planned anew.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def release(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing reads them any more; others are passed over."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path is not None:
            delete_folder(table.sparkSession, path)


#: A key is hot if it has more rows than this, and more than one in ``HOT_SHARE`` of all.
HOT_ROWS, HOT_SHARE = 10_000, 4096


def hot_keys(counts: DataFrame, total: int) -> DataFrame:
    """Hot keys of ``counts`` (key columns and ``_n``, rows a key has of ``total``) and ``_parts`` to deal them into.

    There are fewer than ``HOT_SHARE`` of them whatever the input's size, so they are broadcast.
    """
    most = max(HOT_ROWS, total // HOT_SHARE)
    keys = [c for c in counts.columns if c != "_n"]
    return F.broadcast(counts.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))


def join_hot(many: DataFrame, few: DataFrame, on: list[str], hot: DataFrame, by: Column, how: str = "inner", hint: str | None = None) -> DataFrame:
    """``many`` joined with ``few``; rows of a hot key are dealt out by ``by``, and ``few`` has a copy for each part.

    ``by`` is an expression over ``many`` that differs between the rows of a key; ``hint`` is
    a join hint for ``few``.
    """
    dealt = many.join(hot, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = few.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies.hint(hint) if hint else copies, [*on, "_part"], how).drop("_part")
