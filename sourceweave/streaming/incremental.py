"""What an update has to do: which files to parse again, which results to reuse, which to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action) from two states (path, hash): parsed, reused or dropped."""
    both = old.select("path", F.col("hash").alias("old")).join(new.select("path", F.col("hash").alias("new")), "path", "full")
    return both.select("path", F.when(F.col("new").isNull(), "dropped").when(F.col("old") == F.col("new"), "reused").otherwise("parsed").alias("action"))


def update(spark, root: str, state: str, with_manifests: bool = True, with_cargo: bool = False):
    """The graph of root; only files whose bytes changed are parsed again. state: a folder with the last run's fragments and hashes.

    Returns the graph and the counts of parsed, reused and dropped files. The new state replaces the old one when it is whole.
    """
    import os
    import shutil

    from ..extract import dispatch
    from ..plans import build
    from ..sources import listing

    paths = listing.collect(root).files
    files = spark.createDataFrame([(p, i) for i, p in enumerate(paths)] or [], "path string, idx int")
    read = build.read_files(spark, root, paths).withColumn("hash", F.sha2("content", 256))
    had = os.path.isdir(f"{state}/hashes")
    now = read.select("path", "hash").persist()
    old = spark.read.parquet(f"{state}/hashes") if had else now.limit(0)
    actions = plan_update(old, now).persist()
    parsed = dispatch.extract_files(read.join(actions.where("action = 'parsed'"), "path", "left_semi"))
    found = parsed
    if had:
        kept = spark.read.parquet(f"{state}/fragments").drop("file_idx").join(actions.where("action = 'reused'").select(F.col("path").alias("file")), "file", "left_semi")
        again = kept.join(files.select(F.col("path").alias("file"), F.col("idx").alias("file_idx")), "file")
        found = parsed.unionByName(again)
    new = state.rstrip("/") + ".new"
    shutil.rmtree(new, ignore_errors=True)
    found.write.parquet(f"{new}/fragments")
    now.write.parquet(f"{new}/hashes")
    counts = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}
    shutil.rmtree(state, ignore_errors=True)
    os.rename(new, state)
    found = spark.read.parquet(f"{state}/fragments")
    extra = build.fragments(spark, root, [], with_manifests, with_cargo)
    return build.from_fragments(found.unionByName(extra.withColumn("file_idx", F.col("file_idx") + len(paths))), files), counts


def watch(spark, root: str, state: str, on_change, interval: str = "1 second", once: bool = False):
    """A streaming query that looks at the tree in each interval and calls on_change(graph, counts) if anything was added, changed or deleted.

    The stream is only the clock: a file source never reports deletions, so each tick compares the tree with the last state.
    """
    last: dict[str, tuple] = {}

    def look() -> dict[str, tuple]:
        import os

        from ..sources import listing

        out = {}
        for p in listing.collect(root).files:
            s = os.stat(os.path.join(root, p))
            out[p] = (s.st_size, s.st_mtime_ns)
        return out

    def tick(batch, number: int) -> None:
        seen = look()
        if seen != last or not number:
            last.clear()
            last.update(seen)
            on_change(*update(spark, root, state))

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(tick)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
