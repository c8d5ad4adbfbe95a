"""Streaming twins: keyed event projection, validation on arrival, resumable rounds."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dossier.functions.text import MARK, file_size

TOOL_RESULT = "tool/result"


def matching(events: DataFrame) -> DataFrame:
    """Tool results with a key, bytes defaulting to 0, and their size as text."""
    rows = events.filter((F.col("type") == TOOL_RESULT) & F.col("call_id").isNotNull())
    return rows.withColumn("bytes", F.coalesce("bytes", F.lit(0))).withColumn("size", file_size(F.col("bytes")))


def first_per_key(events: DataFrame) -> DataFrame:
    """Batch form: the first event of each key by ``seq``."""
    rows = matching(events).withColumn("__n", F.row_number().over(Window.partitionBy("call_id").orderBy("seq")))
    return rows.filter("__n = 1").drop("__n")


class FirstOfKey(StatefulProcessor):
    """The event of least ``seq`` of one key: a value in the state, whatever the days of its events.

    Without ``settle_ms`` it is published as soon as it arrives, and again where an earlier one follows; the state goes when its key was idle for ``forget_ms`` of processing time. With it, an event-time
    timer publishes it once, ``settle_ms`` after the first arrival's time; a second one drops the state ``forget_ms`` later.
    """

    def __init__(self, settle_ms: int | None, forget_ms: int):
        self.settle_ms, self.forget_ms = settle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = self.forget_ms or None if self.settle_ms is None else None  # the state store's own expiry knows processing time alone
        self.first = handle.getValueState("first", "seq long, ts timestamp, bytes long, size string, settled boolean", ttl)

    def _said(self, key, seq, ts, bytes_, size) -> Row:
        return Row(call_id=key[0], seq=seq, ts=ts, bytes=bytes_, size=size)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        old = self.first.get() if self.first.exists() else None
        least = min(rows, key=lambda r: r["seq"])
        if old is not None and (old[4] or old[0] <= least["seq"]):
            return
        self.first.update((least["seq"], least["ts"], least["bytes"], least["size"], False))
        if self.settle_ms is None:
            yield self._said(key, least["seq"], least["ts"], least["bytes"], least["size"])
        elif old is None:
            self.handle.registerTimer(least["ts_ms"] + self.settle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        seq, ts, bytes_, size, settled = self.first.get()
        if settled:
            self.first.clear()
            return
        self.first.update((seq, ts, bytes_, size, True))
        if self.forget_ms:
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.forget_ms)
        yield self._said(key, seq, ts, bytes_, size)


_FIRST = "call_id long, seq long, ts timestamp, bytes long, size string"


def first_arrivals(events: DataFrame, forget_ms: int = 0) -> DataFrame:
    """Stream form: ``call_id, seq, ts, bytes, size`` of each key's first event by ``seq``, whatever the order of arrival and its days; one state for each key.

    A key is published as soon as it arrives, and again if an earlier event of it follows (update mode). ``forget_ms``: a key that was idle so long is new again (0: never). Needs the RocksDB state store.

    Without ``forget_ms`` the state is an aggregation's, in the JVM: the least event with the time of the batch that brought it, and a batch publishes those that are its own.
    """
    rows = matching(events.withColumn("ts", F.col("ts").cast("timestamp")))
    if forget_ms:
        return rows.withColumn("ts_ms", F.unix_millis("ts")).groupBy("call_id").transformWithState(FirstOfKey(None, forget_ms), _FIRST, "Update", "ProcessingTime")
    now = F.current_timestamp()  # the same all over a batch, also when it is run again
    least = rows.withColumn("came", now).groupBy("call_id").agg(F.min(F.struct("seq", "came", "ts", "bytes", "size")).alias("e"))
    return least.filter(F.col("e.came") == now).select("call_id", *[F.col(f"e.{c}") for c in ("seq", "ts", "bytes", "size")])


def settled_arrivals(events: DataFrame, delay: str = "10 minutes", settle_ms: int = 600_000, forget_ms: int = 0) -> DataFrame:
    """Stream form with one row for each key: its first event by ``seq`` of those that arrive until the watermark (``delay`` behind the latest event) passes the first arrival's time by ``settle_ms``.

    Later events of the key change nothing (append mode); its state is kept for that, or ``forget_ms`` of event time. Needs the RocksDB state store.
    """
    rows = matching(events.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", delay)
    return rows.groupBy("call_id").transformWithState(FirstOfKey(settle_ms, forget_ms), _FIRST, "Append", "EventTime")


#: Rows up to which the keys of a batch are broadcast to those that are there.
FEW = 100_000


class Arrivals:
    """A table that grows by micro-batches, each key once, whatever is run again.

    Rows lie in ``rows/part=<p>/batch=<b>`` (parts by a hash of the key), and ``log`` has a marker for each batch that is complete. Readers see the rows of complete batches alone. A batch that was complete is left out when it comes again; what one that died has left goes before it is written again.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, parts: int = 64):
        self.spark, self.path, self.key, self.parts = spark, path, key, parts

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _there(self, path: str) -> bool:
        files, where = self._at(path)
        return files.exists(where)

    def _complete(self, df: DataFrame) -> DataFrame:
        return df.join(self.spark.read.schema("batch string").text(f"{self.path}/log"), "batch", "left_semi")

    def rows(self, schema: T.StructType) -> DataFrame:
        """The rows of complete batches, with ``part`` and ``batch``."""
        full = T.StructType([*schema.fields, T.StructField("part", T.IntegerType()), T.StructField("batch", T.StringType())])
        return self._complete(self.spark.read.schema(full).parquet(f"{self.path}/rows")) if self._there("log") else self.spark.createDataFrame([], full)

    def add(self, rows: DataFrame, batch: str) -> None:
        """``rows`` whose keys aren't there yet (of one key in ``rows`` the first by all columns; null is a key), as ``batch``."""
        if self._there(f"log/{batch}"):
            return
        self._drop(batch)
        # A task holds few parts and a part few tasks, so that the files of a batch follow its rows, not tasks times parts.
        slices = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.parts)
        dealt = {"__part": F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int"), "__slice": F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(slices))}
        both = rows.withColumn("__old", F.lit(False))
        if self._there("log"):
            both = both.unionByName(self._done(rows, dealt["__part"]).withColumn("__old", F.lit(True)), allowMissingColumns=True)
        one = Window.partitionBy(*dealt, self.key).orderBy(F.desc("__old"), *[c for c in rows.columns if c != self.key])
        both = both.withColumns(dealt).repartition(*dealt).withColumn("__n", F.row_number().over(one))
        fresh = both.filter("__n = 1 AND NOT __old").select(*rows.columns, F.col("__part").alias("part"), F.lit(batch).alias("batch"))
        fresh.write.mode("append").partitionBy("part", "batch").parquet(f"{self.path}/rows")
        self._commit(batch)

    def _done(self, rows: DataFrame, part: Column) -> DataFrame:
        """The keys that are there; for a few ``rows`` those of their parts alone that are among theirs."""
        done = self.rows(rows.schema)
        if rows.select(self.key).limit(FEW + 1).count() > FEW:
            return done.select(self.key)
        mine = [r[0] for r in rows.select(part).distinct().collect()]  # at most ``parts``
        keys = F.broadcast(rows.select(F.col(self.key).alias("__key")).distinct())
        return done.filter(F.col("part").isin(mine)).select(self.key).join(keys, F.col(self.key).eqNullSafe(F.col("__key")), "left_semi")

    def _drop(self, batch: str) -> None:
        files, where = self._at(f"rows/part=*/batch={batch}")
        for found in files.globStatus(where) or []:
            files.delete(found.getPath(), True)

    def _commit(self, batch: str) -> None:
        """The marker is written aside and moved, so it is there whole or not at all."""
        files, aside = self._at(f"pending-{batch}")
        out = files.create(aside, True)
        out.write(f"{batch}\n".encode())
        out.close()
        _, log = self._at("log")
        files.mkdirs(log)
        files.rename(aside, self._at(f"log/{batch}")[1])


def as_they_arrive(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, key: str, checkpoint: str, parts: int = 64):
    """Each micro-batch judged and added to the :class:`Arrivals` at ``path``, each key once: repeats within a batch, in later batches, and in another run from the start add nothing.

    A batch is named by its checkpoint and its number, so one that is run again is the same.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        Arrivals(batch.sparkSession, path, key, parts).add(judge(batch), f"{run}-{number:09d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


#: Columns of the texts that hold the rounds and the sources of a bucket of items.
_ROUNDS, _SOURCES = ("item_id", "round_no", "path", "seq", "value", "renewed"), ("item_id", "url", "seq", "renewed")


class RoundState(StatefulProcessor):
    """The last value by ``seq`` of each round and path of an item, and its sources; what wasn't renewed for ``idle_ms`` is dropped.

    A state holds a bucket of items as one text, read and written once a batch: a key and each call of the state store cost round trips between Python and the JVM.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "text string", self.idle_ms or None)

    def _hold(self, rows, timer_values) -> tuple[dict, dict, dict]:
        """Rounds and sources of each item after ``rows``, kept in the state; and the items of ``rows``."""
        old, now = self.held.get(), timer_values.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        held: dict = {}
        urls: dict = {}
        if old is not None:
            kept = json.loads(old[0])
            for i, n, p, seq, v, at in zip(*[kept["rounds"][c] for c in _ROUNDS], strict=True):
                if at + self.idle_ms >= now:
                    held.setdefault(i, {})[n, p] = (seq, v, at)
            for i, u, seq, at in zip(*[kept["sources"][c] for c in _SOURCES], strict=True):
                if at + self.idle_ms >= now:
                    urls.setdefault(i, {})[u] = (seq, at)
        came: dict = {}
        for r in rows:
            i, at, seq = r["item_id"], (r["round_no"], r["path"]), r["seq"]
            came[i] = True
            own = held.setdefault(i, {})
            if at not in own or own[at][0] < seq:
                own[at] = (seq, r["value"], now)
            for url in r["sources"] or []:
                its = urls.setdefault(i, {})
                if url not in its or its[url][0] > seq:
                    its[url] = (seq, now)
        columns = lambda names, each: dict(zip(names, zip(*each, strict=True), strict=True)) if each else {c: [] for c in names}
        rounds = columns(_ROUNDS, [(i, *k, *v) for i, own in held.items() for k, v in own.items()])
        self.held.update((json.dumps({"rounds": rounds, "sources": columns(_SOURCES, [(i, u, *x) for i, its in urls.items() for u, x in its.items()])}),))
        return held, urls, came

    def handleInitialState(self, key, initialState, timerValues):  # noqa: N802, N803
        self._hold(initialState["rounds"], timerValues)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        held, sources, came = self._hold(rows, timerValues)
        for item in came:
            yield self._result(item, {k: v[1] for k, v in held[item].items()}, sources.get(item, {}))

    @staticmethod
    def _result(item, held: dict, sources: dict) -> Row:
        started = any(n == 1 for n, _ in held)
        gap = any(n == 1 and v is not None and MARK in v for (n, _), v in held.items())
        refined = started and gap and any(n == 2 for n, _ in held)
        out: dict[str, str | None] = {}
        for n in (1, 2, 3):
            if started and (n != 2 or refined):
                out.update({p: v for (k, p), v in held.items() if k == n})
        urls = [u for u, _ in sorted(sources.items(), key=lambda x: (x[1][0], x[0]))]
        values = [Row(path=p, value=v) for p, v in sorted(out.items())]
        return Row(item_id=item, failed=not started, rounds_used=2 if refined else int(started), gaps=sorted(p for p, v in out.items() if v is None or MARK in v), values=values, sources=urls)


ROUND_STATE = "item_id long, failed boolean, rounds_used int, gaps array<string>, values array<struct<path:string,value:string>>, sources array<string>"


def round_states(rounds: DataFrame, idle_ms: int = 0, before: DataFrame | None = None, buckets: int = 16_384) -> DataFrame:
    """Rounds of each item (``item_id, round_no, seq, path, value, sources``) as they arrive, in any order, one row per item after every batch that has rows of it: :data:`ROUND_STATE`.

    The result applies the batch form's rule to what is there. ``before``: a batch table of rounds that the state starts with. Needs the RocksDB state store. ``idle_ms``: an entry of the state goes when it
    wasn't renewed for so long (0: never). ``buckets``: states that the items share, by a hash; fixed for a checkpoint. A batch reads and writes the states of its items whole.
    """
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int").alias("bucket")
    first = None
    if before is not None:  # one row a bucket
        first = before.select(bucket, F.struct(*rounds.columns).alias("r")).groupBy("bucket").agg(F.collect_list("r").alias("rounds")).groupBy("bucket")
    return rounds.select(bucket, *rounds.columns).groupBy("bucket").transformWithState(RoundState(idle_ms), ROUND_STATE, "Update", "ProcessingTime" if idle_ms else "None", initialState=first)


def held_rounds(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``item_id, round_no, path, seq, value``: the state of :func:`round_states` after its last complete batch, read from the state store of ``checkpoint``."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    held = F.from_json("value.text", "rounds struct<item_id:array<long>,round_no:array<int>,path:array<string>,seq:array<long>,value:array<string>>")["rounds"]
    columns = ("item_id", "round_no", "path", "seq", "value")
    return state.select(held.alias("h")).select(F.inline(F.arrays_zip(*[F.col(f"h.{c}") for c in columns])).alias(*columns))
