"""The streams' own progress as the frames of a status: subscriptions, slots and lag.

A listener notes the start, the last progress and the end of each query; nothing is asked of a server.
Names are those of the queries, which `operators.status` matches to databases.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

SUBSCRIPTIONS = "subname string, pid string, enabled boolean, last_batch long, received long, received_at string, error string"
SLOTS = "slot_name string, active boolean, wal_status string, confirmed_batch long"
LAG = "application_name string, state string, behind_rows long, write_lag double, rows_per_second double"


class ProgressListener(StreamingQueryListener):
    """Attach it with `spark.streams.addListener`. Events come on a thread of Spark's."""

    def __init__(self) -> None:
        self._lock, self._seen = threading.Lock(), {}

    def _note(self, run_id: str, **what) -> None:
        with self._lock:
            self._seen.setdefault(run_id, {"name": "", "batch": None, "rows": 0, "at": None, "active": True, "error": None, "seconds": None, "speed": None, "behind": None}).update(what)

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self._note(str(event.runId), name=event.name or str(event.id), at=event.timestamp)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        with self._lock:
            rows = self._seen.get(str(p.runId), {}).get("rows", 0) + p.numInputRows
        waiting = [s.metrics.get("numFilesOutstanding") or s.metrics.get("estimatedTotalBytesBehindLatest") for s in p.sources if s.metrics]
        behind = sum(int(float(w)) for w in waiting if w)
        self._note(str(p.runId), name=p.name or str(p.id), batch=p.batchId, rows=rows, at=p.timestamp, seconds=p.batchDuration / 1000, speed=p.processedRowsPerSecond, behind=behind)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self._note(str(event.runId), at=event.timestamp)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self._note(str(event.runId), active=False, error=event.exception)

    def wait_until_ended(self, run_ids: list[str], seconds: float = 30.0) -> None:
        """Until the ends of these runs have come here: events follow the queries a little later."""
        until = time.monotonic() + seconds
        while time.monotonic() < until:
            with self._lock:
                if all(r in self._seen and not self._seen[r]["active"] for r in run_ids):
                    return
            time.sleep(0.1)
        raise TimeoutError("the listener has not seen every query's end")

    def _rows(self) -> list[tuple[str, dict]]:
        """The last run of each name."""
        with self._lock:
            last = {}
            for run_id, seen in self._seen.items():  # in the order in which they began
                last[seen["name"]] = (run_id, dict(seen))
        return [last[name] for name in sorted(last)]

    def subscriptions(self, spark: SparkSession) -> DataFrame:
        """A row for each query; `pid` is its run while it is active."""
        rows = [(s["name"], run if s["active"] else None, s["active"], s["batch"], s["rows"], s["at"], s["error"]) for run, s in self._rows()]
        return spark.createDataFrame(rows, SUBSCRIPTIONS)

    def slots(self, spark: SparkSession) -> DataFrame:
        """What holds a query's position, its checkpoint: kept while it runs or ended well, `lost` after an error."""
        rows = [(s["name"], s["active"], "lost" if s["error"] else "reserved", s["batch"]) for _, s in self._rows()]
        return spark.createDataFrame(rows, SLOTS)

    def lag(self, spark: SparkSession) -> DataFrame:
        """What was waiting for the last batch (rows or files, as the source counts), and how long the batch took."""
        state = lambda s: "streaming" if s["active"] else "failed" if s["error"] else "stopped"
        rows = [(s["name"], state(s), s["behind"], s["seconds"], s["speed"]) for _, s in self._rows()]
        return spark.createDataFrame(rows, LAG)

    def sections(self, spark: SparkSession, prefix: str = "") -> dict[str, DataFrame]:
        """The frames by section for `operators.status.collect_sections`; a query's name is the prefix and its database."""
        def by_database(rows: DataFrame, name: str) -> DataFrame:
            found = rows.where(rows[name].startswith(prefix))
            return found.withColumn("database", found[name].substr(len(prefix) + 1, 1 << 20))

        return {
            "subscription": by_database(self.subscriptions(spark), "subname"), "slots": by_database(self.slots(spark), "slot_name"),
            "lag": by_database(self.lag(spark), "application_name"),
        }
