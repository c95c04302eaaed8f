"""The life of a change stream: it is started on a table or on a whole replica, paused, resumed, dropped, waited for."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.marks import Marks
from .replica import Replica
from .tables import ChangeTable, RowTable, StreamedTable  # noqa: F401  the first two are what others take from here


def start_apply(changes: DataFrame, target: StreamedTable | Replica, checkpoint: str, after: int | None = None, **trigger):  # noqa: ANN201
    """Start the query; `after` is the position of the snapshot that the table began with."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        target.append(batch if after is None else batch.where(batch.lsn > after), batch_id)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class NotStreaming(RuntimeError):
    """The stream didn't come up."""


class Stream:
    """A stream: started, paused with its position, resumed, or dropped."""

    def __init__(self, make_changes: Callable[[], DataFrame], target: StreamedTable | Replica, checkpoint: str, after: int | None = None):
        self.make_changes, self.target, self.checkpoint, self.after = make_changes, target, checkpoint, after
        self.query = None

    def enable(self, **trigger) -> None:
        if self.query is None or not self.query.isActive:
            self.query = start_apply(self.make_changes(), self.target, self.checkpoint, self.after, **trigger)

    def disable(self) -> None:
        """Stop; the checkpoint keeps the position."""
        if self.query is not None:
            self.query.stop()

    def drop(self) -> None:
        """Stop and forget the position: the next start reads the changes from the first, so those that came are forgotten, too."""
        self.disable()
        Marks(self.target.spark, self.checkpoint).clear()
        self.target.restart()

    def is_streaming(self) -> bool:
        return self.query is not None and self.query.exception() is None and (self.query.isActive or self.query.lastProgress is not None)

    def wait_until_streaming(self, attempts: int = 15, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> None:
        """Until the stream has made progress; at once an error if it failed, NotStreaming if it never comes up."""
        for _ in range(attempts):
            if self.query is None:
                raise NotStreaming("the stream isn't enabled")
            if (error := self.query.exception()) is not None:
                raise NotStreaming(str(error))
            if self.query.lastProgress is not None:
                return
            sleep(delay)
        raise NotStreaming(f"no progress after {attempts} looks")
