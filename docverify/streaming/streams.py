"""Order checks of event logs, in batch and as a stream, and scans of arriving documents and quotes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import fingerprint
from ..operators.graph import new_folder
from ..operators.structure import lines
from ..operators.verify import RUN as WINNOWED
from ..operators.verify import kinds_of, pattern_scan, term_scan, verbatim_match, write_index, write_keys

#: The events in the order that a run must take, and the lenses.
INTAKE, GATE, CANDIDATES, LENSES = "intake", "input_gate", "candidates", ("L1", "L2", "L3")
RUN = ["run_id"]
IDLE_MS = 3_600_000
#: Batches with short quotes that read all texts before keys of short runs are written: writing them costs about as much as four readings.
READS = 4
#: The setting for the state store and the store that keeps entries one by one.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FOUND = StructType([StructField("run_id", LongType()), StructField("violation", StringType()), StructField("seq", LongType())])


def trace_order(events: DataFrame) -> DataFrame:
    """st1: run_id, violation, seq of the first event (run_id, seq, event) of each run that comes out of order: intake once and first, then the gate once, then each known
    lens once, candidates once after all lenses.  Other events may come at any time; runs in order give no row."""
    before = Window.partitionBy(*RUN).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = F.col("event")
    seen = lambda name: F.coalesce(F.max(e == name).over(before), F.lit(False))
    marked = events.withColumns({"_i": seen(INTAKE), "_g": seen(GATE), "_c": seen(CANDIDATES), **{f"_{x}": seen(f"lens_{x}") for x in LENSES}})
    lens, again = e.startswith("lens_"), F.lit(False)
    for x in LENSES:
        again = again | ((e == f"lens_{x}") & F.col(f"_{x}"))
    broken = (
        F.when((e == INTAKE) & F.col("_i"), "intake_repeated").when((e == GATE) & ~F.col("_i"), "gate_before_intake").when((e == GATE) & F.col("_g"), "gate_repeated").when(lens & ~F.col("_i"), "lens_before_intake").when(lens & ~F.col("_g"), "lens_before_gate")
        .when(lens & ~e.isin(*(f"lens_{x}" for x in LENSES)), "lens_unknown").when(again, "lens_repeated").when((e == CANDIDATES) & ~(F.col("_L1") & F.col("_L2") & F.col("_L3")), "candidates_early").when((e == CANDIDATES) & F.col("_c"), "candidates_repeated")
    )
    return marked.withColumn("v", broken).where("v is not null").groupBy(*RUN).agg(F.min_by("v", "seq").alias("violation"), F.min("seq").alias("seq"))


def _judge(event: str, seen: set[str]) -> str | None:
    """The same rules for one event, given what came before it."""
    lens = event.removeprefix("lens_") if event.startswith("lens_") else None
    tests = [
        (event == INTAKE and INTAKE in seen, "intake_repeated"), (event == GATE and INTAKE not in seen, "gate_before_intake"), (event == GATE and GATE in seen, "gate_repeated"), (lens is not None and INTAKE not in seen, "lens_before_intake"), (lens is not None and GATE not in seen, "lens_before_gate"),
        (lens is not None and lens not in LENSES, "lens_unknown"), (lens is not None and event in seen, "lens_repeated"), (event == CANDIDATES and not {f"lens_{x}" for x in LENSES} <= seen, "candidates_early"), (event == CANDIDATES and CANDIDATES in seen, "candidates_repeated"),
    ]
    return next((name for test, name in tests if test), None)


class Order(StatefulProcessor):
    """One run: a value with the number awaited, what was seen before it, and whether the run was reported; and a map of the events that came too soon, an entry each."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "awaited long, seen array<string>, reported boolean")
        self.early = handle.getMapState("early", "seq long", "event string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        awaited, seen, reported = self.run.get() if self.run.exists() else (1, [], False)
        seen, found = set(seen), []
        for frame in rows:
            if reported:
                continue
            # what was taken already may come again
            came = {int(n): e for n, e in zip(frame["seq"], frame["event"], strict=True) if n >= awaited}
            while not reported and (awaited in came or self.early.containsKey((awaited,))):
                if (event := came.pop(awaited, None)) is None:
                    event = self.early.getValue((awaited,))[0]
                self.early.removeKey((awaited,))
                if broken := _judge(event, seen):
                    reported = True
                    found.append((key[0], broken, awaited))
                seen.add(event)
                awaited += 1
            if not reported:
                for n, event in came.items():
                    self.early.updateValue((n,), (event,))
        if reported:
            self.early.clear()
        self.run.update((awaited, sorted(seen), reported))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(found, columns=FOUND.names)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.run.clear()
        self.early.clear()
        return iter(())

    def close(self) -> None:
        pass


def trace_order_stream(events: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """st2: the rows of st1 as they come up.  Events count in the order of seq, from 1 without gaps, whatever order they arrive in; repeated ones are passed over; a run that
    has been idle for ``idle_ms`` is forgotten.  None for a stream that ends (availableNow): a timer would keep it going.

    An early event is one entry of state, written when it comes and removed when its turn comes; a batch rewrites none of the others.  The
    stream needs the state store named in STORE, which the session must name when the stream starts (``run_to_end`` does)."""
    return events.groupBy(*RUN).transformWithStateInPandas(Order(idle_ms), FOUND, "append", "processingTime" if idle_ms else "none")


def scan_stream(docs: DataFrame, terms: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """st3: doc_id, line_no, kind, hit of arriving documents: forbidden terms, patterns, and each document's fingerprint (line 0).  Stateless."""
    rows = lines(docs)
    found = term_scan(rows, terms).select("doc_id", "line_no", F.lit("term").alias("kind"), F.col("variant").alias("hit"))
    hits = pattern_scan(rows, patterns).select("doc_id", "line_no", F.col("pattern").alias("kind"), "hit")
    marks = docs.select("doc_id", F.lit(0).alias("line_no"), F.lit("sha16").alias("kind"), fingerprint(F.col("text"))["sha16"].alias("hit"))
    return found.unionByName(hits).unionByName(marks)


def _place(df: DataFrame) -> str:
    """A new folder in the one that driver and executors share."""
    return new_folder(df.sparkSession, "stream")


def _arriving(rows: DataFrame, place: str) -> DataFrame:
    rows.write.parquet(f"{place}/in")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(f"{place}/in")


def run_to_end(make: Callable[[DataFrame], DataFrame], rows: DataFrame) -> DataFrame:
    """Lets rows arrive as a file stream, takes all that are there, and returns what the stream wrote."""
    place = _place(rows)
    out = make(_arriving(rows, place))
    conf = rows.sparkSession.conf
    before = conf.get(STORE[0])
    conf.set(*STORE)
    try:
        stream = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    finally:
        conf.set(STORE[0], before)
    stream.awaitTermination()
    return rows.sparkSession.read.schema(out.schema).parquet(f"{place}/out")


def verbatim_stream_to_end(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """st4: vf2 of arriving quotes against static sources, of which an index is written once: each micro-batch is matched against that and appended under its number, so a batch that runs twice is written once.

    Texts come first.  Keys of winnowed runs are added when a batch first has quotes that are sought by them; those of short runs, which are
    many, once READS batches had such quotes: until then such a batch reads the texts."""
    place = _place(quotes)
    write_index(sources, f"{place}/index", ())
    asked, written = Counter(), set()

    def match(batch: DataFrame, number: int) -> None:
        for kind in kinds_of(batch):
            asked[kind] += 1
            if kind not in written and (kind == WINNOWED or asked[kind] > READS):
                write_keys(batch.sparkSession, f"{place}/index", kind)
                written.add(kind)
        verbatim_match(batch, index=f"{place}/index", kinds=written).write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    _arriving(quotes, place).writeStream.foreachBatch(match).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return quotes.sparkSession.read.parquet(f"{place}/out").drop("batch")
