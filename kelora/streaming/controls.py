"""Reports and the operator's commands as one stateful stream; its state can be saved and given to a new query.

A key's state is the list of its reports within WINDOW and its status. Reports open an incident; a command clears or
rejects it; a report later than the command opens it again. Rows are applied in order of their time within a key as far as
they arrive together; a report that arrives after a command but is older than it changes nothing but the count, as in the
batch form. A timer at the end of the window removes a key's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

WINDOW_MINUTES = 24 * 60
COMMANDS = {"clear": "CLEARED", "reject": "REJECTED"}
STATUS = StructType([StructField("status", StringType()), StructField("decided", TimestampType()), StructField("last", TimestampType())])
REPORT = StructType([StructField("seq", LongType()), StructField("at", TimestampType())])
OUT = StructType([StructField("key", LongType()), StructField("status", StringType()), StructField("reports", IntegerType()), StructField("updated", TimestampType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Incidents(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reports = handle.getListState("reports", REPORT)
        self.status = handle.getValueState("status", STATUS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "kind", "seq"])
        own = [(r[0], r[1]) for r in self.reports.get()]
        status, decided, last = self.status.get() if self.status.exists() else (None, None, None)
        for r in new.itertuples():
            at = r.at.to_pydatetime()
            if r.kind == "report":
                own.append((int(r.seq), at))
                if decided is None or at > decided:
                    status = "REPORTED"
            elif r.kind in COMMANDS and own and (decided is None or at >= decided) and any(a <= at for _, a in own):
                decided = at
                status = COMMANDS[r.kind] if not any(a > at for _, a in own) else "REPORTED"
            last = at if last is None else max(last, at)
        if not own:
            return  # a command without a report does nothing
        self.reports.put(own)
        self.status.update((status, decided, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(last.timestamp() * 1000) + WINDOW_MINUTES * 60_000)
        yield pd.DataFrame([(key[0], status, len(own), last)], columns=["key", "status", "reports", "updated"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.reports.clear()
        self.status.clear()
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Takes over what ``saved`` has read from another query."""
        own = [(int(s), a.to_pydatetime()) for r in initialState.itertuples() for s, a in zip(r.seqs, r.ats)]
        row = initialState.iloc[0]
        time = lambda x: None if pd.isna(x) else x.to_pydatetime()
        self.reports.put(own)
        self.status.update((row["status"], time(row["decided"]), time(row["last"])))
        self.handle.registerTimer(int(row["last"].timestamp() * 1000) + WINDOW_MINUTES * 60_000)


def incidents(rows: DataFrame, late: str = "1 hour", restored: DataFrame | None = None) -> DataFrame:
    """(key, status, reports, updated) of each key that a batch touches. ``rows``: key, at, seq, kind (report, clear, reject)."""
    start = None if restored is None else restored.groupBy("key")
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(statefulProcessor=Incidents(), outputStructType=OUT, outputMode="update", timeMode="eventTime", initialState=start)


def saved(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a stopped query, read from its checkpoint: key, seqs, ats, status, decided, last; a table to keep or to give on."""
    of = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    reports = of("reports").groupBy("key.key").agg(F.sort_array(F.collect_list("list_element")).alias("own"))  # a key's reports of one window
    status = of("status").select("key.key", "value.*")
    return reports.join(status, "key").select("key", F.transform("own", lambda r: r["seq"]).alias("seqs"), F.transform("own", lambda r: r["at"]).alias("ats"), "status", "decided", "last")


def batch(rows: DataFrame) -> DataFrame:
    """The batch form: status by the last command that has a report before it, and reports after it."""
    first = F.min(F.when(F.col("kind") == "report", F.col("at")))
    own = rows.groupBy("key").agg(first.alias("first"), F.count_if(F.col("kind") == "report").alias("n"), F.max(F.when(F.col("kind") == "report", F.col("at"))).alias("newest"))
    told = rows.where("kind <> 'report'").join(own, "key").where(F.col("at") >= F.col("first")).groupBy("key").agg(F.max_by("kind", F.struct("at", "kind", "seq")).alias("kind"), F.max("at").alias("decided"))
    names = F.create_map(*(F.lit(x) for kv in COMMANDS.items() for x in kv))
    out = own.where("n > 0").join(told, "key", "left")
    status = F.when(F.col("decided").isNull() | (F.col("newest") > F.col("decided")), "REPORTED").otherwise(F.element_at(names, F.col("kind")))
    return out.select("key", status.alias("status"), F.col("n").cast("int").alias("reports"), F.greatest("newest", "decided").alias("updated"))
