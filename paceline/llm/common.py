"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python. Whole texts can be long, so batches are kept small.
BATCH_ROWS = 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` if it is larger, to bound a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's own checkpoint folder. A local
    session, whose executors are the driver, may do without either and gets a new folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="paceline-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with more than this share of all rows is hot, so there are never more than a thousand.
HOT_SHARE = 0.001
SPREAD = 32


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (a row a key) on ``key``, the rows of hot keys dealt over ``SPREAD`` tasks by ``by``.

    ``counts`` has ``key, n``, the rows of ``left`` by key, of which ``total`` is the sum. At most a thousand keys can be hot,
    so their list is bounded; every other key is joined as usual.
    """
    hot = [r[0] for r in counts.where(F.col("n") > max(1000, HOT_SHARE * total)).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    (salt,) = unused(left.join(right.limit(0), key), "salt")
    warm = F.col(key).isin(hot)
    dealt = left.withColumn(salt, F.when(warm, F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).otherwise(0))
    copies = right.withColumn(salt, F.explode(F.when(warm, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, salt], how).drop(salt)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and lost executors lose nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of ``stored`` that nothing will read again."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, factor: float = 1.0) -> int:
    """A partition count in proportion to the session's own setting, which is the user's knob for scale."""
    return max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) * factor))


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.encode(F.col(column), "UTF-8"), F.lit(b""))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls, without copying; offsets start at 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that near values land far apart."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Links that one task of ``contracted`` joins at a time.
LINKS_AT_ONCE = 1 << 18


def contracted(edges: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """``edges`` (``a, b`` long) with the same components and mostly fewer rounds to them: so many links of a partition at a time are
    replaced by links from each of their nodes to the smallest that it reaches over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        def stars() -> pa.RecordBatch:
            nodes = list(up)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) >= at_once:
                yield stars()
                up.clear()
        yield stars()

    return edges.where("a is not null and b is not null").select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list.

    ``edges`` has the long columns ``a`` and ``b``. Returns ``node, root`` for every node that is not
    itself the smallest of its component; ``root`` is the smallest node. Alternating large-star and
    small-star rounds, each of which is a minimum by node (summed up before the shuffle) and a join,
    written to the shared folder: no component is ever gathered in one task, and the number of rounds
    grows with the logarithm of its size. Nulls and loops are ignored; repeated edges do no harm.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
    told = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = told(now)
    for _ in range(max_rounds):
        before = now
        both = now.unionByName(now.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = both.join(least, "a").where("b > a").selectExpr("b as a", "m as b").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b as a", "m as b").where("a <> b").unionByName(low.selectExpr("a", "m as b"))
        now = stored(small.selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
        discard(before)
        state = told(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.selectExpr("a as node", "b as root")
