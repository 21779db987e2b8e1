"""Open items on a stream: predictions that wait for a fact, hypotheses and anomalies that end by time.

One operator, keyed by buckets of keys, holds all of them.  Its input is tagged: items have a kind, a number and a time until which they stand;
facts have a number alone.  Nothing is decided until the watermark has passed it, so what comes out depends on event times
and not on how the stream is cut: the first fact after a prediction resolves it, once; what has not met its fact by its time
ends then.  Facts are kept until the watermark passes them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerline.streaming.jobs import bucket_of, micros, one_timer

PREDICTION, HYPOTHESIS, ANOMALY, FACT = "prediction", "hypothesis", "anomaly", "fact"
#: Hours a prediction stands after the end of its interval, minutes an anomaly stands after it was last seen.
PREDICTION_HOURS, ANOMALY_MINUTES = 6, 45
#: How each kind ends when its time has come.
ENDS = {PREDICTION: "expired", HYPOTHESIS: "expired", ANOMALY: "resolved"}
OUT = "key string, kind string, id long, status string, at timestamp, fact_id long"


def standing(items: DataFrame, facts: DataFrame) -> DataFrame:
    """``key, kind, id, at, until``: items and facts in one tagged stream.

    ``items`` has these columns, with the end of a prediction's interval, the expiry of a hypothesis and nothing for an anomaly
    in ``until``; a null one stands until its fact.  ``facts`` has ``key, id, at``.
    """
    until = F.when(F.col("kind") == PREDICTION, F.col("until") + F.expr(f"INTERVAL {PREDICTION_HOURS} HOURS")).when(F.col("kind") == ANOMALY, F.col("at") + F.expr(f"INTERVAL {ANOMALY_MINUTES} MINUTES")).otherwise(F.col("until"))
    tagged = facts.select("key", F.lit(FACT).alias("kind"), "id", "at", F.lit(None).cast("timestamp").alias("until"))
    return items.select("key", "kind", "id", "at", until.alias("until")).unionByName(tagged)


class OpenItems(StatefulProcessor):
    """The open items of a bucket of keys and the facts not yet passed by the watermark, with one timer for the next end or fact."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "key array<string>, kind array<string>, id array<long>, at array<long>, until array<long>")
        self.facts = handle.getValueState("facts", "key array<string>, at array<long>, id array<long>")

    def _read(self) -> tuple[dict[str, dict], dict[str, set]]:
        items, facts = {}, {}
        for key, kind, item, at, until in zip(*self.open.get(), strict=True) if self.open.exists() else ():
            items.setdefault(key, {})[kind, item] = (at, until)
        for key, at, fact in zip(*self.facts.get(), strict=True) if self.facts.exists() else ():
            facts.setdefault(key, set()).add((at, fact))
        return items, facts

    def _write(self, items: dict[str, dict], facts: dict[str, set], clear: bool) -> None:
        rows = [(key, kind, item, at, until) for key, mine in items.items() for (kind, item), (at, until) in mine.items()]
        seen = [(key, at, fact) for key, mine in facts.items() for at, fact in mine]
        for state, values in ((self.open, rows), (self.facts, seen)):
            if values:
                state.update(tuple(map(list, zip(*values, strict=True))))
            else:
                state.clear()
        one_timer(self.handle, min([*(until for *_, until in rows if until is not None), *(at for _, at, _ in seen)], default=None), clear)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items, facts = self._read()
        for batch in rows:
            ends = [None if none else until for none, until in zip(batch["until"].isna().tolist(), micros(batch["until"]), strict=True)]
            for name, kind, item, at, until in zip(batch["key"].tolist(), batch["kind"].tolist(), batch["id"].tolist(), micros(batch["at"]), ends, strict=True):
                if kind == FACT:
                    facts.setdefault(name, set()).add((at, item))
                    continue
                mine = items.setdefault(name, {})
                if (kind, item) in mine:  # seen again: it stands longer
                    first, last = mine[kind, item]
                    at, until = min(first, at), None if last is None or until is None else max(last, until)
                mine[kind, item] = (at, until)
        self._write(items, facts, True)
        yield _rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        items, facts = self._read()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        out, left = [], {}
        for name, mine in items.items():
            known = sorted(f for f in facts.get(name, ()) if f[0] < passed)
            times = [at for at, _ in known]
            for (kind, item), (at, until) in mine.items():
                first = bisect_right(times, at) if kind == PREDICTION else len(known)
                if first < len(known) and (until is None or times[first] <= until):
                    out.append((name, kind, item, "resolved", times[first], known[first][1]))
                elif until is not None and until < passed:
                    out.append((name, kind, item, ENDS[kind], until, None))
                else:
                    left.setdefault(name, {})[kind, item] = (at, until)
        facts = {name: {f for f in mine if f[0] >= passed} for name, mine in facts.items()}
        self._write(left, facts, False)
        yield _rows(out)

    def close(self) -> None:
        pass


def _rows(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["key", "kind", "id", "status", "at", "fact_id"])
    return frame.assign(at=pd.to_datetime(frame["at"].astype("int64"), unit="us"), fact_id=frame["fact_id"].astype("Int64"))


def ended(tagged: DataFrame, late: str = "1 hour") -> DataFrame:
    """``OUT``: how and when each item of ``standing`` ended, once.  Needs the RocksDB state store."""
    rows = tagged.where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return rows.withColumn("bucket", bucket_of("key")).groupBy("bucket").transformWithStateInPandas(OpenItems(), OUT, "append", "eventtime")
