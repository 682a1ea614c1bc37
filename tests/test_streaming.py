import sys
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerline import filter as f
from ledgerline.condition import gt
from ledgerline.model import Event
from ledgerline.operators import dcb
from ledgerline.operators.fold import Projection, StateTable
from ledgerline.operators.saga import Command, Saga, StartTimer, Timeout
from ledgerline.sources.store import EventStore
from ledgerline.streaming.checkpoints import IF_ABSENT, AppliedAppends, Checkpoints, Lease, NotOlderThan, every_n, parse_checkpoint, position_checkpoint, time_checkpoint
from ledgerline.streaming.deadlines import Deadlines
from ledgerline.streaming.position_source import register
from ledgerline.streaming.saga_stream import run_stream
from ledgerline.streaming.subscriptions import NOW, Outcome, PushFeed, RecentIds, Subscriptions, deduplicated, events_of_kafka, forward, kafka_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])
T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def store(spark, tmp_path):
    s = EventStore(spark, f"file://{tmp_path}/store")
    s.write("a", [Event(f"e{i}", "even" if i % 2 == 0 else "odd", time=T0 + timedelta(hours=i), data={"n": i}) for i in range(1, 7)])
    return s


@pytest.fixture
def subs(store, tmp_path):
    made = []

    def make(**kw):
        made.append(Subscriptions(store, f"file://{tmp_path}/checkpoints", **kw))
        return made[-1]

    yield make
    for s in made:
        s.stop()


def test_backlog_and_live_events_are_one_stream(store, subs):
    s, got, batches = subs(), [], []

    def act(df, n):
        got.extend(r.id for r in df.collect())
        batches.append(n)

    s.subscribe("all", act, most=4)
    s.run_available("all")
    store.append([Event("x1", "A", tags=("t",)), Event("x2", "B", tags=())])
    s.run_available("all")
    assert got == [f"e{i}" for i in range(1, 7)] + ["x1", "x2"] and len(batches) >= 3
    s.pause("all")
    store.write("b", [Event("late", "odd")])
    assert s.is_paused("all") and not s.is_running("all")
    s.resume("all")
    s.run_available("all")
    assert got[-1] == "late" and got.count("e1") == 1 and s.ids() == ["all"]
    with pytest.raises(ValueError):
        s.subscribe("all", act)
    s.cancel("all")
    assert s.ids() == []


def test_filters_and_starts(store, subs):
    s, got = subs(), {}

    def into(k):
        return lambda df, n: got.setdefault(k, []).extend(r.id for r in df.collect())

    s.subscribe("payload", into("payload"), f.type_("even") & f.data("n", gt(2)))
    s.subscribe("position", into("position"), start=4)
    s.subscribe("time", into("time"), start=T0 + timedelta(hours=5))
    s.subscribe("now", into("now"), start=NOW)
    s.subscribe("tags", into("tags"), dcb.tags("t"), start=lambda: 0)
    for k in s.ids():
        s.run_available(k)
    store.append([Event("x", "even", tags=("t",), data={"n": 9})])
    for k in s.ids():
        s.run_available(k)
    assert got == {"payload": ["e4", "e6", "x"], "position": ["e5", "e6", "x"], "time": ["e6", "x"], "now": ["x"], "tags": ["x"]}
    with pytest.raises(ValueError):
        subs(payload_filters=False).subscribe("p", into("p"), f.data("n", 1))


def test_most_counts_events_of_the_types(store, subs):
    s, got = subs(), []
    take = lambda df, n: got.append([r.id for r in df.collect()])
    s.subscribe("s", take, f.type_("even") & f.data("n", gt(2)), most=2)
    s.run_available("s")
    assert got == [["e4"], ["e6"]]  # e2 and e4, of which the payload leaves one, then e6
    store.write("b", [Event("late", "odd"), Event("later", "even", data={"n": 9})])
    s.run_available("s")
    assert [x for x in got if x] == [["e4"], ["e6"], ["later"]]


def test_batches_read_the_row_groups_that_they_need(spark, tmp_path):
    from ledgerline.streaming.position_source import Reader

    store = EventStore(spark, f"file://{tmp_path}/store")
    frame = lambda n, of: spark.range(n).select(F.concat(F.lit(of), "id").alias("id"), F.lit("s").alias("source"), F.concat(F.lit("t"), F.col("id") % 5).alias("type"), F.lit("a").alias("stream"), F.col("id").alias("at"))
    store.append_frame(frame(60_000, "x"), "stream", ["at"])
    store.append_frame(frame(10, "y"), "stream", ["at"])
    plain = Reader({"path": store.path})
    (found,) = plain.partitions({"position": 12_000}, {"position": 12_100})
    assert sum(len(groups) for _, groups in found.groups) == 1
    rows = [x for b in plain.read(found) for x in b["position"].to_pylist()]
    assert rows == list(range(12_001, 12_101))
    own, start, ends = Reader({"path": store.path, "maxeventspertrigger": "5000", "types": '["t1"]', "onlytypes": "true"}), {"position": 0}, []
    while (end := own.latestOffset()) != start:
        got = [p for r in own.partitions(start, end) for b in own.read(r) for p in b["position"].to_pylist()]
        ends.append((end["position"], len(got)))
        start = end
    assert ends == [(24_997, 5000), (49_997, 5000), (60_010, 2002)]


def test_projection_over_a_subscription(spark, store, subs, tmp_path):
    table, applied = StateTable(spark, f"file://{tmp_path}/t", "key string, n long"), AppliedAppends(spark, f"file://{tmp_path}/applied")
    p = Projection("n", lambda: {"n": 0}, F.col("streamid")).on("even", lambda s, e: {"n": s["n"] + 1}).on("odd", lambda s, e: {"n": s["n"] + 10})
    s = subs()
    s.project("p", p, table, "n long", lambda x: x, applied, ["type"], most=4)
    s.run_available("p")
    r = store.write("b", [Event("z", "odd")])
    s.run_available("p")
    assert {x.key: x.n for x in table.current().collect()} == {"a": 33, "b": 10}
    assert applied.wait_until("p", r.append_id, 5) and not applied.has("p", "none") and not applied.wait_until("p", "none", 0.1)
    applied.clear("p")
    assert not applied.has("p", r.append_id)


def test_a_projections_batch_is_read_once(spark, store, subs, tmp_path):
    """Batches of handled types, each in one commit."""
    table = StateTable(spark, f"file://{tmp_path}/t", "key string, n long")
    p = Projection("n", lambda: {"n": 0}, F.col("streamid")).on("even", lambda s, e: {"n": s["n"] + 1})
    reads = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(position):
        reads.add(1)
        return position > 0

    s = subs()
    plain = s.subscribe
    s.subscribe = lambda id, act, f=None, **kw: plain(id, lambda batch, n: act(batch.where(seen("position")), n), f, **kw)
    s.project("p", p, table, "n long", lambda x: x, columns=["type"], most=2)
    s.run_available("p")
    assert reads.value == 3 and table._version()[0] == 2 and table.position("p") == 6


def test_only_the_lease_holder_runs(spark, store, subs, tmp_path):
    now = [0.0]
    lease = lambda: Lease(spark, f"file://{tmp_path}/lease", 10, lambda: now[0])
    a, b, ledger = lease(), lease(), Checkpoints(spark, f"file://{tmp_path}/ledger")
    first, second, got = subs(lease=a, ledger=ledger), subs(lease=b), []
    assert first.subscribe("s", lambda df, n: got.extend(r.id for r in df.collect())) is not None
    assert second.subscribe("s", lambda df, n: None) is None
    first.run_available("s")
    assert len(got) == 6 and ledger.read("s") == "position:6"
    assert a.holds("s") and not b.holds("s")
    first.cancel("s")
    assert b.acquire("s") is not None and a.acquire("s") is None
    now[0] = 11
    assert a.acquire("s") is not None and not b.holds("s")


def test_checkpoints(spark, tmp_path):
    c = Checkpoints(spark, f"file://{tmp_path}/c")
    assert c.read("x") is None and not c.exists("x")
    assert c.save("x", position_checkpoint(3), NotOlderThan(2)) and c.read("x") == "position:3"
    assert not c.save("x", "position:9", IF_ABSENT) and not c.save("x", "position:9", NotOlderThan(1)) and c.save("x", "position:4", NotOlderThan(2))
    c.delete("x")
    assert c.read("x") is None and c.save("x", "position:1", IF_ABSENT)
    assert parse_checkpoint("position:7") == 7 and parse_checkpoint(time_checkpoint(T0)) == T0 and parse_checkpoint("token") == "token"
    third = every_n(3)
    assert [third(i) for i in range(6)] == [False, False, True] * 2


def test_replays_and_sql_predicates(store, subs):
    s, heard, got = subs(), [], []
    s.subscribe("r", lambda df, n: got.extend(r.id for r in df.collect()), "position % 3 = 0", replay=heard.append)
    s.run_available("r")
    assert got == ["e3", "e6"] and heard == ["started", "completed"]
    s.subscribe("c", lambda df, n: None, F.col("type") == "none", replay=heard.append)
    s.run_available("c")
    s.cancel("c")
    assert heard == ["started", "completed", "started", "completed"]  # though nothing passes the filter


def test_push_feed():
    got = []
    feed = PushFeed(accepts=lambda e: e.get("type") != "no", buffer=2)
    e = lambda i, t="yes": {"id": i, "source": "s", "type": t}
    assert feed.push(e(1)) is Outcome.UNAVAILABLE
    feed.action = got.append
    assert feed.push({"x": 1}) is Outcome.NOT_DELIVERABLE and feed.push(e(1, "no")) is Outcome.FILTERED and feed.push(e(1)) is Outcome.DELIVERED
    outcomes = []

    def backlog():
        yield e(1)
        outcomes.extend(feed.push(e(i)) for i in (2, 3, 4))
        yield e(2)

    feed.catch_up(backlog())
    assert outcomes == [Outcome.DEFERRED, Outcome.DEFERRED, Outcome.REFUSED]
    assert [x["id"] for x in got] == [1, 2, 3]
    ids = RecentIds(2)
    assert [ids.add(i) for i in (1, 2, 1, 3, 1)] == [True, True, False, True, True]


def test_forwarding(store):
    parked = []

    def broken(df):
        raise OSError("down")

    with pytest.raises(OSError):
        forward(store.log(), broken)
    forward(store.log(), broken, lambda df, e: parked.append(df.count()))
    assert parked == [6]
    row = kafka_rows(store.log().where("id = 'e1'")).first()
    assert row.topic == "events.odd" and row.key == "a" and '"id":"e1"' in row.value and kafka_rows(store.log(), "t").first().topic == "t"
    back = events_of_kafka(kafka_rows(store.log()).unionByName(kafka_rows(store.log()).limit(1).withColumn("value", F.lit("nope")))).collect()
    assert sorted(r.id or "" for r in back) == ["", *(f"e{i}" for i in range(1, 7))] and {r.time for r in back if r.id == "e1"} == {datetime(2026, 1, 1, 1)}
    again = store.log().unionByName(store.log())
    assert deduplicated(again).count() == 6


def test_deadlines(spark, tmp_path):
    d, got = Deadlines(spark, f"file://{tmp_path}/d"), []
    d.schedule("b", "mail", T0 + timedelta(hours=1), {"to": "x"})
    d.schedule("a", "mail", T0)
    d.schedule("c", "other", T0)
    d.schedule("g", "mail", T0)
    d.cancel("g")
    assert d.poll(T0) == 0
    d.register("mail", lambda id, category, at, data: got.append((id, data)))
    assert d.poll(T0) == 1 and d.poll(T0 + timedelta(hours=2)) == 1 and got == [("a", None), ("b", {"to": "x"})]
    d.unregister("mail")
    d.schedule("a", "mail", T0)
    assert d.poll(T0) == 0


def test_manual_start(store, subs):
    s, got = subs(), []
    s.stop()
    assert s.subscribe("m", lambda df, n: got.extend(r.id for r in df.collect())) is None and not s.is_running("m")
    s.start_all()
    s.run_available("m")
    assert len(got) == 6


def stream_saga():
    def react(s, given):
        return [Command("late" if isinstance(given, Timeout) else given["type"])]

    return Saga("s", lambda: 0, frozenset(("odd",)), lambda s, g: s + 1, react, lambda s, e: [StartTimer("t", seconds=0.5)], lambda s: s >= 9, frozenset(("even",)))


def test_saga_on_a_stream(spark, store, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    register(spark)
    stream = spark.readStream.format("ledgerline").option("path", store.path).load()
    out = run_stream(stream, stream_saga(), F.col("streamid"), ["streamid", "streamversion"])
    q = out.writeStream.format("memory").queryName("saga_out").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/saga").start()
    try:
        end = time.time() + 60  # timers make batches without end, so there is no processing all
        while time.time() < end and not spark.sql("select 1 from saga_out where command = '\"late\"'").count():
            time.sleep(0.5)
        rows = spark.sql("select * from saga_out where command is not null order by saga_version").collect()
        assert [r.command for r in rows] == ['"odd"', '"even"', '"odd"', '"even"', '"odd"', '"even"', '"late"']
        assert {r.saga_id for r in rows} == {"a"} and rows[-1].saga_version == 7
    finally:
        q.stop()


def test_moving_and_starting_again(spark, store, subs):
    got, s = [], subs()
    take = lambda df, n: got.extend(r.id for r in df.collect())
    s.subscribe("m", take, start=4)
    s.run_available("m")
    s.reposition("m", 5)
    s.run_available("m")
    assert got == ["e5", "e6", "e6"]
    s.stop()
    again, got[:] = subs(), []
    again.subscribe("m", take, start=0)  # the move outlives the process
    again.run_available("m")
    assert got == []
    from ledgerline.streaming.subscriptions import FROM_START

    for _ in range(2):
        once = subs()
        once.subscribe("each", take, start=5, resume=FROM_START)
        once.run_available("each")
        once.stop()
    assert got == ["e6", "e6"]


def test_failed_forwards_are_parked(store):
    from ledgerline.functions.retry import Retry
    from ledgerline.streaming.subscriptions import DeliveryPolicy, destinations

    tries, parked = [], []

    def sink(rows):
        tries.append(1)
        raise OSError("down")

    forward(store.log(), sink, policy=DeliveryPolicy(Retry(attempts=3, initial=0.0), lambda rows, e: parked.append((rows.count(), str(e)))))
    assert len(tries) == 3 and parked == [(6, "down")]
    with pytest.raises(OSError):
        forward(store.log(), sink)
    assert sorted({(r.type, r.to) for r in store.log().select("type", destinations({"odd": "o"}).alias("to")).collect()}, key=str) == [("even", None), ("odd", "o")]


def test_lost_history(spark, store, subs, tmp_path):
    from ledgerline.streaming.subscriptions import FROM_BEGINNING, FROM_NOW, HistoryLost

    got, first = [], subs()
    take = lambda df, n: got.extend(r.id for r in df.collect())
    for id in ("a", "b", "c"):
        first.subscribe(id, take)
        first.run_available(id)
    first.stop()
    new = EventStore(spark, f"file://{tmp_path}/new")  # the same subscriptions over a store that began anew
    new.write("s", [Event("n1", "odd")])
    again, got[:] = Subscriptions(new, f"file://{tmp_path}/checkpoints"), []
    try:
        with pytest.raises(HistoryLost):
            again.subscribe("a", take)
        again.subscribe("b", take, lost=FROM_BEGINNING)
        again.run_available("b")
        assert got == ["n1"]
        again.subscribe("c", take, lost=FROM_NOW)
        new.write("s", [Event("n2", "odd")])
        for id in ("b", "c"):
            again.run_available(id)
        assert got == ["n1", "n2", "n2"]
    finally:
        again.stop()
