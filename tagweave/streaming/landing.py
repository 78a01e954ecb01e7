"""An extension beyond batch work: drawings are extracted as their words land.

Consensus needs a whole drawing.  ``watch`` takes files that hold whole drawings.  ``watch_pages`` takes pages in any
order and in any number of batches: a stateful operator holds a drawing's words until its last page has come or none
has come for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import tables
from ..plans.pipeline import extract_drawing
from ..schema import WORDS, Settings

#: a landed word also says how many pages its drawing has; a page without words is one row whose text is null
LANDED = WORDS + ", pages int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HELD = WORDS + ", revision int, complete boolean"


def _extracted(out: str, settings: Settings):
    def each(batch: DataFrame, number: int) -> None:
        with tables.scope(batch.sparkSession):
            held = tables.stored(batch, "landed")
            if held.isEmpty():  # a batch that only moves timers on
                return
            found, _ = extract_drawing(held.select(*[c.split(" ")[0] for c in WORDS.split(", ")]).filter("text IS NOT NULL"), settings=settings)
            if "revision" in held.columns:
                status = held.select("drawing_id", "revision", "complete").distinct()
                found = status.join(found, "drawing_id", "left")  # a drawing without tags has a row as well
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each


def watch(spark: SparkSession, landing: str, out: str, checkpoint: str, settings: Settings = Settings(), once: bool = False) -> StreamingQuery:
    """Parquet files of words under ``landing``, each of whole drawings, become tags under ``out``, by batch: a repeated batch replaces its own."""
    writer = spark.readStream.schema(WORDS).parquet(landing).writeStream.option("checkpointLocation", checkpoint).foreachBatch(_extracted(out, settings))
    return (writer.trigger(availableNow=True) if once else writer).start()


class HoldDrawing(StatefulProcessor):
    """Words of a drawing, until all its pages are here (complete) or ``wait_ms`` have passed since the last came (not complete).

    Pages that come after their drawing was let go are held anew, by the same rule, and go out as its next revision: that holds
    the late pages alone.  A page that comes twice counts once, its first words stay.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.words = handle.getListState("words", WORDS)
        self.about = handle.getValueState("about", "pages int, revision int, timer long, seen array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pages, revision, timer, seen = self.about.get() if self.about.exists() else (0, 0, 0, [])
        seen, fresh, new = set(seen or []), set(), []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                pages = max(pages, int(r.pages))
                if r.page not in seen:
                    fresh.add(int(r.page))
                    if isinstance(r.text, str):
                        new.append(tuple(r[:-1]))
        seen |= fresh
        if new:
            self.words.appendList(new)
        if timer:
            self.handle.deleteTimer(timer)
        if len(seen) >= pages:
            self.about.update((0, revision + 1, 0, []))
            yield from self._let_go(key, revision, True)
        else:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.handle.registerTimer(timer)
            self.about.update((pages, revision, timer, sorted(seen)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, revision, _, _ = self.about.get()
        self.about.update((0, revision + 1, 0, []))
        yield from self._let_go(key, revision, False)

    def _let_go(self, key, revision: int, complete: bool) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in _HELD.split(", ")]
        rows = [(*w, revision, complete) for w in self.words.get()] or [(key[0], *[None] * (len(names) - 3), revision, complete)]
        self.words.clear()
        yield pd.DataFrame(rows, columns=names)

    def close(self) -> None:
        pass


def held_drawings(words: DataFrame, wait_ms: int) -> DataFrame:
    """A stream of words (LANDED) -> the words of each drawing, all at once, with revision and complete.  Needs the RocksDB state store."""
    return words.groupBy("drawing_id").transformWithStateInPandas(statefulProcessor=HoldDrawing(wait_ms), outputStructType=_HELD, outputMode="Append", timeMode="ProcessingTime")


def watch_pages(spark: SparkSession, landing: str, out: str, checkpoint: str, settings: Settings = Settings(), wait_ms: int = 600_000, once: bool = False) -> StreamingQuery:
    """Parquet files of words (LANDED), in any order of pages, become tags (drawing_id, revision, complete, ...) under ``out``, by batch: a repeated batch replaces its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # timers ask for batches without data for ever; a run that ends leaves them to the next batch with data
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not once).lower())
    landed = spark.readStream.schema(LANDED).parquet(landing)
    names = [c.split(" ")[0] for c in LANDED.split(", ")]
    writer = held_drawings(landed.select(*names), wait_ms).writeStream.option("checkpointLocation", checkpoint).foreachBatch(_extracted(out, settings))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
