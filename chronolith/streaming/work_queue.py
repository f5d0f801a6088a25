"""A resumable queue: work is taken in order, cut where a group ends, and a mark tells how far it is done.

The cuts of many batches are found in one pass over running sums. Each batch is written under its number and counts only once its mark has been renamed into place.
Whatever breaks off, the next run goes on from the last mark and writes the open batch anew; a
batch's rows are never read without its mark. Marks also serve as the cursor of a sync: order by
the time of the update, and the next run takes what is newer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class WorkQueue:
    """Batches and marks under ``path``, a folder of any store that Spark reaches and that renames whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _store(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        return hadoop, hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def marks(self) -> int:
        """How many batches are done."""
        hadoop, store = self._store()
        folder = hadoop.Path(f"{self.path}/marks")
        return len(store.listStatus(folder)) if store.exists(folder) else 0

    def mark(self) -> dict | None:
        """The last batch's mark: number, at (text), key, rows; None before the first."""
        done = self.marks()
        if not done:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/marks/{done - 1:012d}", wholetext=True).first()[0])

    def _put(self, number: int, mark: dict) -> bool:
        """Puts a mark in place; False if another run has done the batch."""
        hadoop, store = self._store()
        draft, target = hadoop.Path(f"{self.path}/drafts/{uuid.uuid4().hex}"), hadoop.Path(f"{self.path}/marks/{number:012d}")
        store.mkdirs(target.getParent())
        stream = store.create(draft, False)
        stream.write(bytearray(json.dumps(mark).encode()))
        stream.close()
        context = hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(target), self.spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass()):
                raise
            store.delete(draft, False)
            return False
        return True

    def take(self, pending: DataFrame, at: str, key: str, size: int) -> tuple[DataFrame, dict] | None:
        """The next batch and its mark: groups (at, key) after the last mark, in order, until ``size`` rows are reached; None if nothing is left.

        A group is never cut, so a batch may be larger than ``size`` by less than its last group.
        The cut is found on the sizes of at most ``size`` groups.
        """
        mark = self.mark()
        place = F.struct(F.col(at), F.col(key))
        todo = pending.where(F.col(at).isNotNull() & F.col(key).isNotNull())
        if mark:
            since = F.lit(mark["at"]).cast(pending.schema[at].dataType)
            todo = todo.where((F.col(at) > since) | ((F.col(at) == since) & (F.col(key) > F.lit(mark["key"]))))
        groups = todo.groupBy(at, key).agg(F.count("*").alias("n")).orderBy(at, key).limit(size)
        # At most ``size`` groups are left, so one window over them is bounded.
        before = groups.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(at, key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        last = before.where(F.col("before") < size).agg(F.max(place).alias("p"), F.sum("n").alias("n"), F.max(F.col(at)).cast("string").alias("at")).first()
        if last["p"] is None:
            return None
        end = F.lit(last["at"]).cast(pending.schema[at].dataType)
        batch = todo.where((F.col(at) < end) | ((F.col(at) == end) & (F.col(key) <= F.lit(last["p"][key]))))
        return batch, {"number": (mark["number"] + 1) if mark else 0, "at": last["at"], "key": last["p"][key], "rows": last["n"]}

    def run(self, pending: DataFrame, at: str, key: str, size: int, work: Callable[[DataFrame], DataFrame], budget: int | None = None, together: int = 1) -> int:
        """Does batches until nothing is left or ``budget`` batches are done; how many it did.

        ``work`` turns a batch's rows into its result. Rows without ``at`` or ``key`` are never taken;
        what arrives before the mark later on isn't either, so a cursor's order must be one of arrival.
        With ``together``, up to so many batches are written by one job: ``work`` gets their rows with
        ``batch`` and must keep that column. Cuts, marks and results are those of single batches.
        """
        if together > 1:
            return self._run_together(pending, at, key, size, work, budget, together)
        done = 0
        while budget is None or done < budget:
            taken = self.take(pending, at, key, size)
            if taken is None:
                break
            batch, mark = taken
            work(batch).write.mode("overwrite").parquet(f"{self.path}/rows/batch={mark['number']}")
            done += self._put(mark["number"], mark)
        return done

    def _run_together(self, pending: DataFrame, at: str, key: str, size: int, work: Callable[[DataFrame], DataFrame], budget: int | None, together: int) -> int:
        done, mark = 0, self.mark()
        todo = pending.where(F.col(at).isNotNull() & F.col(key).isNotNull())
        if mark:
            since = F.lit(mark["at"]).cast(pending.schema[at].dataType)
            todo = todo.where((F.col(at) > since) | ((F.col(at) == since) & (F.col(key) > F.lit(mark["key"]))))
        sums, number, start = running_sums(todo, at, key), mark["number"] + 1 if mark else 0, 0
        hadoop, store = self._store()
        while budget is None or done < budget:
            some = together if budget is None else min(together, budget - done)
            cuts = sorted(next_cuts(sums, start, size, some).join(sums, "total").select("total", F.col(at).cast("string").alias("at"), F.col(key).alias("key")).collect())
            if not cuts:
                break
            ends = [start, *(c["total"] for c in cuts)]
            place = F.array(*(F.lit(e).cast("long") for e in ends[1:-1])) if len(cuts) > 1 else F.array().cast("array<long>")
            batch = F.size(F.filter(place, lambda e: e < F.col("total"))) + F.lit(number)
            groups = sums.where((F.col("total") > start) & (F.col("total") <= ends[-1])).select(at, key, batch.alias("batch"))
            first, last = groups.agg(F.min(at).cast("string"), F.max(at).cast("string")).first()
            rows = todo.where(F.col(at).between(*(F.lit(t).cast(pending.schema[at].dataType) for t in (first, last)))).join(groups, [at, key])
            for n in range(number, number + len(cuts)):  # what a run that broke off has left
                store.delete(hadoop.Path(f"{self.path}/rows/batch={n}"), True)
            work(rows).repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/rows")
            for n, (cut, before) in enumerate(zip(cuts, ends), number):
                if not self._put(n, {"number": n, "at": cut["at"], "key": cut["key"], "rows": cut["total"] - before}):
                    return done + self._run_together(pending, at, key, size, work, None if budget is None else budget - done, together)
                done += 1
            number, start = number + len(cuts), ends[-1]
        return done

    def results(self) -> DataFrame | None:
        """The rows of all marked batches, with batch; None before the first."""
        done = self.marks()
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("batch") < done) if done else None


def running_sums(rows: DataFrame, at: str, key: str) -> DataFrame:
    """(at, key, total): rows up to and with each group, in order; the driver sees a number a partition."""
    place = F.spark_partition_id()
    groups = rows.groupBy(at, key).agg(F.count("*").alias("n")).repartitionByRange(at, key).checkpoint()
    sizes = groups.groupBy(place.alias("part")).agg(F.sum("n").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for s in sizes:
        before.append((s["part"], total))
        total += s["n"]
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(at, key).rowsBetween(Window.unboundedPreceding, 0))
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    return groups.withColumn("part", place).withColumn("inside", inside).join(F.broadcast(offsets), "part").select(at, key, (F.col("inside") + F.col("before")).alias("total")).checkpoint()


def next_cuts(sums: DataFrame, start: int, size: int, most: int) -> DataFrame:
    """(total): the ends of the next ``most`` batches, each the first total that is ``size`` or more after the one before, or the last of all.

    One task reads the totals of a stretch of twice ``most`` times ``size`` rows and at most one that lies
    beyond; where groups are larger than ``size``, the stretch may hold fewer cuts, and always holds one.
    """
    reach = start + 2 * size * most
    beyond = sums.where(F.col("total") > reach).agg(F.min("total").alias("total")).where("total IS NOT NULL")
    totals = sums.where((F.col("total") > start) & (F.col("total") <= reach)).select("total").unionByName(beyond)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.sort(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)]))
        cuts, end, last = [], start, len(found) - 1
        while len(cuts) < most and last >= 0 and end < found[last]:
            i = int(np.searchsorted(found, end + size))
            if i > last and found[last] > reach:  # ends in the next stretch
                break
            end = int(found[min(i, last)])
            cuts.append(end)
        yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int64())], ["total"])

    return totals.coalesce(1).mapInArrow(run, "total long")
