"""What the operators share: scratch tables, tokenizer paths, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabulary `name` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of our own."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("oddsmill.scratch.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-oddsmill-")
        spark.conf.set("oddsmill.scratch.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs one stage and not the lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
        """The saved table, its rows, and a sum of hashes of them, all from the one write."""
        seen = Observation()
        out = self.save(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")), name)
        return out, seen.get["n"], int(seen.get["h"] or 0)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def drop_but(self, *names: str) -> None:
        """Drops every table but these, after a failure as after success."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(conf)
        if fs.exists(root):
            for found in fs.listStatus(root):
                if found.getPath().getName() not in names:
                    fs.delete(found.getPath(), True)

    def finish(self, df: DataFrame, *names: str) -> DataFrame:
        """Keeps df, which is small, and drops the tables it came from."""
        out = self.save(df, "result")
        self.drop(*names)
        return out


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled at every size and never broadcast by its file's size."""
    return df.hint("merge")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges by alternating large and small stars.

    edges has two columns of one orderable type. Returns (node, component), component being the least node of
    its part; nodes without an edge to another node aren't returned. Every round is written to the shared
    folder; a round moves at most one row for each edge, so a hub with most of the nodes is no larger than its
    edge list, and the minima are taken map-side first.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    run = f"edges-{uuid.uuid4().hex[:8]}"
    e, *before = scratch.save_counted(e, f"{run}-0")
    for k in range(1, 1000):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, *now = scratch.save_counted(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{run}-{k}")
        scratch.drop(f"{run}-{k - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("no end of the rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
