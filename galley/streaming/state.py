"""Keywords watched in a stream: a rise is told once, and state goes away by itself.

Each keyword has state of its own: the days on which it was seen with their counts, ``keep`` of them at most,
and whether its rise has been told. Time to live is in event time, so that a replay gives the same: days older than
``keep`` go with each sighting, and a timer ends the watch when the watermark has passed the last
sighting by ``keep`` days. A keyword that nobody mentions any more costs nothing, however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Sightings within so many days that make a rise; days that a sighting is kept.
LEAST, WITHIN, KEEP = 3, 7, 90
_DAY = 86_400_000
RISES = "keyword string, event string, day date, n long"


class Watch(StatefulProcessor):
    """Tells (keyword, 'rise', day, n) when n sightings, ``least`` or more, lie within ``within`` days, and 'gone' when the watch ends.

    A rise is told once until the watch ends. Within a batch sightings count in order of their days; late ones, as
    long as the watermark lets them through, count on their own day.
    """

    def __init__(self, least: int = LEAST, within: int = WITHIN, keep: int = KEEP) -> None:
        if within > keep:
            raise ValueError("a rise can't reach further back than sightings are kept")
        self.least, self.within, self.keep = least, within, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "n long")
        self.told = handle.getValueState("told", "day int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        new: dict[int, int] = {}
        for part in rows:
            for day, n in part.groupby("day")["n"].sum().items():
                new[int(day)] = new.get(int(day), 0) + int(n)
        out = []
        for day in sorted(new):
            held = self.days.getValue((day,))[0] if self.days.containsKey((day,)) else 0
            self.days.updateValue((day,), (held + new[day],))
            if not self.told.exists():
                n = sum(v[0] for k, v in self.days.iterator() if day - self.within < k[0] <= day)
                if n >= self.least:
                    self.told.update((day,))
                    out.append((key[0], "rise", pd.Timestamp(day * _DAY, unit="ms").date(), n))
        seen = [k[0] for k, _ in self.days.iterator()]
        last = max(seen)
        for day in seen:  # sightings too old for any rise to come go at once
            if day <= last - self.keep:
                self.days.removeKey((day,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.keep) * _DAY)
        yield pd.DataFrame(out, columns=["keyword", "event", "day", "n"]).astype({"keyword": object, "event": object, "day": object, "n": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        days = [(k[0], v[0]) for k, v in self.days.iterator()]
        if self.days.exists():
            self.days.clear()
        if self.told.exists():
            self.told.clear()
        end = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms").date()
        yield pd.DataFrame([(key[0], "gone", end, sum(n for _, n in days))], columns=["keyword", "event", "day", "n"])

    def close(self) -> None:
        pass


def rises(articles: DataFrame, least: int = LEAST, within: int = WITHIN, keep: int = KEEP, delay: str = "7 days") -> DataFrame:
    """keyword, event ('rise' or 'gone'), day, n from a stream of articles (ts, keywords).

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which keeps state on disk.
    """
    rows = articles.withWatermark("ts", delay).select("ts", F.explode("keywords").alias("keyword")).filter("keyword is not null")
    rows = rows.select("keyword", F.unix_date(F.to_date("ts")).alias("day"), F.lit(1).cast("long").alias("n"), "ts")
    return rows.groupBy("keyword").transformWithStateInPandas(Watch(least, within, keep), RISES, "append", "eventTime")


#: The setting that :func:`rises` needs.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
