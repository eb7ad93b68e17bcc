"""Session queries as stream state against the map of one process."""

import random
from datetime import datetime, timedelta

from reminis.streaming.pipelines import SessionQueries
from reminis.streaming.sessions import STATE_STORE, session_queries

NOW = datetime(2026, 1, 1)
SCHEMA = "user_id string, session_id string, query string, asked_at timestamp_ntz"


def test_same_evictions_as_one_process_also_after_a_restart(spark, tmp_path):
    r = random.Random(4)
    kept = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    maps, state = {u: SessionQueries(3) for u in "ab"}, {}
    try:
        for batch in range(4):
            rows = [(r.choice("ab"), f"s{r.randrange(5)}", f"q{batch}-{i}", NOW + timedelta(days=batch, seconds=i)) for i in range(7)]
            for user, session, query, _ in rows:
                maps[user].put(session, query)
            spark.createDataFrame(rows + [("a", None, "x", NOW), ("a", "s", None, NOW)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

            def keep(changes, number):
                for x in changes.collect():
                    state.pop((x.user_id, x.session_id), None)
                    if not x.removed:
                        state[x.user_id, x.session_id] = x.query

            stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
            # each round is a query that starts from the checkpoint of the one before
            query = session_queries(stream, 3).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint")
            query.trigger(availableNow=True).start().awaitTermination()
            assert state == {(u, s): q for u, m in maps.items() for s, q in m.queries.items()}
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
