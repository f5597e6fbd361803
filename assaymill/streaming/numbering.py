"""Session numbers that hold under concurrency: given out by the state of a stream, one target at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from assaymill.streaming.committed import CommittedTable

#: What the session has to be set to: such state is kept on disk, and in the checkpoint.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
NUMBERED = "target_id string, submission string, session long, again boolean"


class Numbering(StatefulProcessor):
    """Of each target: the last number given, and the number of each submission."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number long")
        self.given = handle.getMapState("given", "submission string", "number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else 0
        out = []
        for submission in sorted({s for frame in rows for s in frame["submission"]}):
            again = self.given.containsKey((submission,))
            if again:
                number = self.given.getValue((submission,))[0]
            else:
                number = last = last + 1
                self.given.updateValue((submission,), (number,))
            out.append((key[0], submission, number, again))
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["target_id", "submission", "session", "again"])

    def close(self) -> None:
        pass


def numbered(submissions: DataFrame) -> DataFrame:
    """target_id, submission, session, again of a stream of ``submissions`` (target_id, submission).

    The first submission of a target has session 1, each new one the next number; within a batch they go by
    their keys. A submission that comes again, in one batch or a later one, keeps its number and is marked so.
    Rows without a target or a submission are left out.
    """
    if submissions.sparkSession.conf.get(STORE[0]) != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}")
    rows = submissions.select("target_id", "submission").where("target_id is not null and submission is not null")
    return rows.groupBy("target_id").transformWithStateInPandas(Numbering(), NUMBERED, "Update", "None")


def store_sessions(submissions: DataFrame, path: str, checkpoint: str, name: str = "sessions") -> StreamingQuery:
    """Stores each submission's number once, in the table of commits at ``path``, and ends when all there is is read.

    A batch that is run again after a failure has the state it had before, so it gives the same numbers, and its
    commit bears the batch's number, so it adds nothing that is there.
    """

    def store(rows: DataFrame, batch: int) -> None:
        table, transaction = CommittedTable(rows.sparkSession, path), f"{name}-{batch}"
        new = rows.where("not again").select("target_id", "session", "submission")
        if any(c["transaction"] == transaction for c in table.commits()):
            new.write.format("noop").mode("overwrite").save()  # the batch's state must come about all the same
        else:
            table.append(new, transaction, ["target_id", "session"])

    writer = numbered(submissions).writeStream.outputMode("update").foreachBatch(store).queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
