"""Streams give what a loop over the same hours gives."""

import pandas as pd

from cobordia.plans import streams
from cobordia.streaming import agents
from tests.conftest import SF


def hours(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    return e.groupby(["event_type", e.ts.dt.floor("h")]).value.sum().reset_index()


def test_keyed_state_equals_a_loop(spark):
    x = hours(spark)
    got = {r["agent"]: r for r in streams.stream_agents(spark, SF).collect()}
    assert set(got) == set(x.event_type)
    for agent, own in x.groupby("event_type"):
        theta, phi, r, last = 0.0, 0.0, 0.0, 0.0
        own = own.sort_values("ts")
        closed = got[agent]["steps"]
        assert len(own) - 3 <= closed <= len(own)  # the watermark leaves the last hours open
        for v in own.value.tolist()[:closed]:
            theta, phi, r = agents.step(theta, phi, r, last, v)
            last = v
        assert abs(got[agent]["theta"] - theta) < 1e-6 and abs(got[agent]["last"] - last) < 1e-6


def test_exchange_agrees_on_parameters(spark):
    rows = streams.stream_exchange(spark, SF).collect()
    assert len({round(r["theta"], 9) for r in rows}) == 1 and all(r["steps"] > 0 for r in rows)


def test_exchange_by_weights_and_by_mean(spark, tmp_path):
    """Batches through the sink, with weights of a ring and as a mean over all, against a loop."""
    kinds, lots = "abc", [[("a", 1, 2.0), ("b", 1, -1.0), ("c", 2, 3.0)], [("a", 2, 1.0), ("a", 3, 4.0), ("c", 3, 1.0)], [("b", 4, 2.0)]]
    ring = [(x, y, 0.5 if x == y else 0.25) for x in kinds for y in kinds]
    # an agent without new rows keeps its parameters but mixes
    for weights, table in ((None, [(x, y, 1 / 3) for x in kinds for y in kinds]), (ring, ring)):
        at = str(tmp_path / ("mean" if weights is None else "ring"))
        sink = agents.ExchangeSink(at, None if weights is None else spark.createDataFrame(weights, "src string, dst string, w double"))
        state = {k: (0.0, 0.0, 0.0, 0.0) for k in kinds}
        for n, lot in enumerate(lots):
            sink(spark.createDataFrame(lot, "agent string, t long, x double"), n)
            for k in kinds:
                theta, phi, r, last = state[k]
                for _, _, x in sorted(row for row in lot if row[0] == k):
                    theta, phi, r = agents.step(theta, phi, r, last, x)
                    last = x
                state[k] = theta, phi, r, last
            mixed = {x: sum(w * state[y][0] for a, y, w in table if a == x) for x in kinds}
            state = {k: (mixed[k], *state[k][1:]) for k in kinds}
            got = {r["agent"]: r["theta"] for r in sink.state(spark, n).collect()}
            assert all(abs(got[k] - state[k][0]) < 1e-12 for k in kinds)


def test_messages_are_read_once(spark, tmp_path):
    """Across micro-batches and a restart: later messages replace unread ones, and what was read is gone."""
    from cobordia.streaming import inbox

    before = spark.conf.get(inbox.STORE[0])
    spark.conf.set(*inbox.STORE)
    schema = "agent long, t long, id long, reads boolean, source string, value double"
    lots = [
        [(1, 1, 1, False, "a", 1.0), (1, 2, 2, False, "a", 2.0), (1, 3, 3, False, "b", 3.0), (2, 1, 4, True, None, None)],
        [(1, 4, 5, False, "b", 4.0), (1, 5, 6, True, None, None), (1, 6, 7, True, None, None), (2, 5, 8, False, "c", None)],
        [(1, 7, 9, True, None, None), (2, 8, 10, True, None, None), (1, 8, 11, False, "a", 9.0)],
        [(1, 9, 12, True, None, None), (3, 9, 13, True, None, None)],
    ]
    try:
        for stop in (2, 4):  # a query over the first files, and the same one again over all of them
            for k, lot in enumerate(lots[:stop]):
                if not (tmp_path / f"in/lot={k}").exists():
                    spark.createDataFrame(lot, schema).coalesce(1).write.parquet(str(tmp_path / f"in/lot={k}"))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            streams._drain(inbox.read_once(stream), str(tmp_path / "at"), lambda d, k: d.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={k}")), "append")
        got = sorted(tuple(r) for r in spark.read.schema(inbox.READ).parquet(str(tmp_path / "out")).select(*inbox.READ.names).collect())
    finally:
        spark.conf.set(inbox.STORE[0], before)
    assert got == [(1, 5, 6, "a", 2, 2.0), (1, 5, 6, "b", 4, 4.0), (1, 9, 12, "a", 8, 9.0), (2, 8, 10, "c", 5, None)]


class Store:
    """Stands for an agent's list of messages, and counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = [], 0

    def getListState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return iter(self.held)

    def put(self, rows):
        self.calls += 1
        self.held = list(rows)

    def clear(self):
        self.calls += 1
        self.held = []


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def took(box, rows, now=0):
    lot = pd.DataFrame(rows, columns=["t", "id", "reads", "source", "value"])
    return [tuple(r) for d in box.handleInputRows((1,), iter([lot[:2], lot[2:]] if len(lot) > 2 else [lot]), Clock(now)) for r in d.itertuples(index=False)]


def test_inbox_asks_its_store_twice_however_many_messages_come():
    from cobordia.streaming.inbox import Inbox

    box, store = Inbox(), Store()
    box.init(store)
    assert not took(box, [(k, k, False, "abc"[k % 3], float(k)) for k in range(3000)][::-1])
    assert store.calls == 2 and sorted(m[:3] for m in store.held) == [("a", 2997, 2997.0), ("b", 2998, 2998.0), ("c", 2999, 2999.0)]
    assert sorted(took(box, [(4000, 1, True, None, None)])) == [(1, 4000, 1, k, 2997 + n, 2997.0 + n) for n, k in enumerate("abc")]
    assert store.calls == 4 and not store.held


def test_inbox_gives_up_each_message_at_its_own_age():
    from cobordia.streaming.inbox import Inbox

    box, store = Inbox(keep_ms=100), Store()
    box.init(store)
    took(box, [(1, 1, False, "a", 1.0)], now=0)
    took(box, [(2, 2, False, "b", 2.0)], now=60)  # "a" keeps its age though the list is written anew
    assert took(box, [(3, 3, True, None, None)], now=120) == [(1, 3, 3, "b", 2, 2.0)]


def test_events_may_be_a_folder_of_files(spark, tmp_path):
    e = pd.read_parquet(f"{SF}/events.parquet")
    (tmp_path / "events.parquet").mkdir()
    for k in range(3):
        e.iloc[k::3].to_parquet(tmp_path / f"events.parquet/part-{k}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    got = sorted(tuple(r) for r in streams.stream_inbox(spark, str(tmp_path)).collect())
    assert got == sorted(tuple(r) for r in streams.stream_inbox(spark, SF).collect()) and got
