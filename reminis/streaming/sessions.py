"""The last query of each session as the state of a stream, by user.

``session_queries`` holds for each user at most ``capacity`` sessions in the order in which they first asked. A full user
drops the oldest session for every new query, of a known session or not; a session that asks again keeps its place (unless it
was the one dropped: then it comes last). What changes is put out as rows: a session's query, or its removal.
``SessionQueries`` in ``pipelines`` does the same for one process. Capacity counts by user, as one map for all users would be
one group; the state outlives a restart from the checkpoint.

Rows of one user in one batch are taken in the order of ``asked_at``, then session and query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CAPACITY = 1000
CHANGES = "user_id string, session_id string, query string, removed boolean"
#: What the stream's session has to be set to: the state store that keeps a map by entry.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class LastQueries(StatefulProcessor):
    """``places``: session by number of its first query; ``known``: number and query by session; ``ends``: the numbers of the
    oldest session there is, and of the next one. Each is read and written by entry, whatever the capacity."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "number long", "session string")
        self.known = handle.getMapState("known", "session string", "number long, query string")
        self.ends = handle.getValueState("ends", "oldest long, next long, size long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["asked_at", "session_id", "query"], kind="stable")
        oldest, following, size = self.ends.get() if self.ends.exists() else (0, 0, 0)
        changed: dict[str, str | None] = {}
        for session, query in zip(asked["session_id"], asked["query"]):
            if size >= self.capacity:
                while not self.places.containsKey((oldest,)):
                    oldest += 1
                gone = self.places.getValue((oldest,))[0]
                self.places.removeKey((oldest,))
                self.known.removeKey((gone,))
                oldest, size, changed[gone] = oldest + 1, size - 1, None
            if self.known.containsKey((session,)):
                number = self.known.getValue((session,))[0]
            else:
                number, following, size = following, following + 1, size + 1
                self.places.updateValue((number,), (session,))
            self.known.updateValue((session,), (number, query))
            changed.pop(session, None)
            changed[session] = query
        self.ends.update((oldest, following, size))
        out = [(key[0], session, query, query is None) for session, query in changed.items()]
        yield pd.DataFrame(out, columns=["user_id", "session_id", "query", "removed"])

    def close(self) -> None:
        pass


def session_queries(asked: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The changes of a stream of user_id, session_id, query, asked_at (all but the time strings)."""
    rows = asked.where("session_id is not null and query is not null").select("user_id", "session_id", "query", "asked_at")
    return rows.groupBy("user_id").transformWithStateInPandas(LastQueries(capacity), CHANGES, "Update", "None")
