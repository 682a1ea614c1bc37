import json

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerline.functions.retry import Retry
from ledgerline.model import Event
from ledgerline.operators import flow, saga, snapshot
from ledgerline.operators.decider import Decider
from ledgerline.operators.fold import Projection, StateTable, View, algebraic, expression_fold, last_by, project, python_fold
from ledgerline.operators.saga import CancelTimer, Command, Saga, SagaRunner, SagaState, SagaStore, StartTimer, Timeout, replay
from ledgerline.sources.store import EventStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])
ROWS = [(1, "a", "add", 5), (2, "b", "add", 1), (3, "a", "sub", 2), (4, "a", "note", 9), (5, None, "add", 7), (6, "b", "reset", 0), (7, "b", "add", 4)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, "position long, key0 string, type string, n long").cache()


def total(state, e):
    return {"add": state + e["n"], "sub": state - e["n"], "reset": 0}.get(e["type"], state)


def test_three_folds_agree(spark, log):
    known = log.where("key0 is not null")
    want = {"a": 3, "b": 4}
    a = python_fold(known, F.col("key0"), View(int, total), "v long", lambda s: {"v": s}, ["type", "n"])
    b = expression_fold(known, F.col("key0"), ["type", "n"], F.lit(0).cast("long"), lambda s, e: F.when(e["type"] == "add", s + e["n"]).when(e["type"] == "sub", s - e["n"]).when(e["type"] == "reset", F.lit(0).cast("long")).otherwise(s), "v")
    assert {r.key: r.v for r in a.collect()} == {r.key: r.v for r in b.collect()} == want
    c = algebraic(known, F.col("key0").alias("key"), v=last_by(F.col("n"), when=F.col("type") == "add"))
    assert {r.key: r.v for r in c.collect()} == {"a": 5, "b": 4}


def test_fold_goes_on_from_states(spark, log):
    states = spark.createDataFrame([("a", 100), ("z", 5)], "key string, v long")
    out = python_fold(log.where("key0 = 'a' and position > 1"), F.col("key0"), View(lambda: {"v": 0}, lambda s, e: {"v": total(s["v"], e)}), "v long", lambda s: s, ["type", "n"], state=states)
    assert {r.key: r.v for r in out.collect()} == {"a": 98, "z": 5}


def test_fold_goes_on_from_states_where_joins_have_dealt_both(spark):
    """Tables that are partitioned by key, of sizes so different that their partitions are coalesced apart."""
    n = spark.range(40_000)
    log = n.select(F.concat(F.lit("s"), F.col("id") % 100).alias("streamid"), (F.floor(F.col("id") / 100) + 1).alias("streamversion"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    kept = log.where("streamversion <= 20").groupBy(F.col("streamid").alias("key")).agg(F.max("streamversion").alias("version"), F.count("*").alias("n")).withColumn("schema_version", F.lit(1))
    view = View(lambda: {"n": 0}, lambda s, e: {"n": s["n"] + 1})
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = snapshot.refreshed(log, kept, view, "n bigint", lambda s: s, ["streamversion", "pad"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r.key, r.n) for r in out) == sorted((f"s{i}", 400) for i in range(100))


def test_projections(spark, log):
    p = Projection("t", int, F.col("key0")).on("add", lambda s, e: s + e["n"]).on("any", lambda s, e: s + 1000)
    p = Projection("t", int, F.col("key0"), p.handlers, parents={"sub": "any"})
    run = lambda q, i=None: {r.key: r.v for r in project(log, q, "v long", lambda s: {"v": s}, i, ["type", "n"]).collect()}
    assert run(p) == {"a": 1005, "b": 5} and run(p, "b") == {"b": 5}
    assert run(p.adapted(lambda s: s, lambda s: s)) == {"a": 1005, "b": 5}
    single = Projection("all", int).on("add", lambda s, e: s + e["n"])
    assert run(single) == {"": 17}
    with pytest.raises(ValueError):
        run(single, "x")


def test_state_table(spark, tmp_path):
    t = StateTable(spark, f"file://{tmp_path}/t", "key string, v long")
    assert t.current().count() == 0
    t.save(spark.createDataFrame([("a", 1), ("b", 2)], "key string, v long"))
    t.save(spark.createDataFrame([("b", 3), ("c", 4)], "key string, v long"))
    assert {r.key: r.v for r in t.current().collect()} == {"a": 1, "b": 3, "c": 4} and t.find("b", "x").count() == 1


def test_snapshots(spark, tmp_path):
    p = snapshot.every(3).or_(snapshot.on_event("x"))
    assert p.test(3, [], None) and p.test(1, ["x"], None) and not p.test(2, ["y"], None)
    assert not snapshot.never().test(9, [], None) and snapshot.always().test(1, [], None) and snapshot.when_state(bool).test(0, [], 1)
    rows = spark.createDataFrame([(3, ["y"]), (1, ["x"]), (2, ["y"])], "since int, types array<string>")
    assert [r[0] for r in rows.select(p.column()).collect()] == [True, True, False]
    s = snapshot.Snapshot(7, 5)
    assert snapshot.usable(s, 5, 1) and not snapshot.usable(s, 4, 1) and not snapshot.usable(s, 9, 2) and not snapshot.usable(None, 9, 1)
    assert snapshot.redelivered(5, s, 6) and not snapshot.redelivered(6, s, 6) and not snapshot.redelivered(5, s, 4)
    with pytest.raises(ValueError):
        snapshot.every(0)

    store, kept = EventStore(spark, f"file://{tmp_path}/s"), snapshot.SnapshotStore()
    n = lambda e: json.loads(e["data"])["n"] if isinstance(e, dict) else e.data["n"]
    d = Decider(0, lambda c, s: [Event(f"{c}", "add", data={"n": c, "before": s})], lambda s, e: s + n(e))
    service = snapshot.SnapshotService(store, kept, snapshot.every(2))
    service.execute("a", d, 1)
    assert kept.find("a") is None
    service.execute("a", d, 2)
    assert kept.find("a") == snapshot.Snapshot(3, 2)
    service.execute("a", d, 4)
    assert json.loads(store.log().where("id = '4'").first().data)["before"] == 3
    store.delete_stream("a")
    service.execute("a", d, 8)
    assert kept.find("a") is None and json.loads(store.log().where("id = '8'").first().data)["before"] == 0


def order():
    def evolve(s, given):
        return s + [given.name if isinstance(given, Timeout) else given["type"]]

    def react(s, given):
        if isinstance(given, Timeout):
            return [Command(f"late {given.name}")]
        return {"pay": [CancelTimer("due"), Command("ship")], "again": [StartTimer("due", seconds=5)], "two": [StartTimer("b", at=30), StartTimer("a", at=20)]}.get(given["type"], [])

    return Saga("o", list, frozenset(("open",)), evolve, react, lambda s, e: [StartTimer("due", seconds=10), Command("ask")], lambda s: "close" in s, frozenset(("pay", "close", "again", "two")))


def ev(p, type, t=None, **kw):
    return {"position": p, "type": type, "t": p if t is None else t, **kw}


def bodies(made):
    return [json.loads(c["command"]) for c in made]


def test_saga_steps():
    s = order()
    time = lambda e: e["t"]
    assert replay(s, [ev(1, "pay")], 99, time) == (None, [])
    kept, made = replay(s, [ev(1, "open"), ev(2, "pay"), ev(3, "close"), ev(4, "pay")], 99, time)
    assert kept.status == saga.COMPLETED and kept.version == 3 and bodies(made) == ["ask", "ship"] and kept.timers == {}
    kept, made = replay(s, [ev(1, "open"), ev(2, "pay", 50)], 99, time)
    assert bodies(made) == ["ask", "late due", "ship"] and kept.state == ["open", "due", "pay"]
    kept, made = replay(s, [ev(1, "open"), ev(2, "two")], 40, time)
    assert bodies(made) == ["ask", "late due", "late a", "late b"]
    kept, made = replay(s, [ev(1, "open"), ev(2, "again", 8)], 12, time)
    assert bodies(made) == ["ask"] and kept.timers == {"due": 13}
    assert [(c["version"], c["ordinal"]) for c in replay(s, [ev(1, "open"), ev(2, "pay")], 2, time)[1]] == [(1, 0), (2, 0)]


def test_saga_redelivery():
    s = order()
    kept, _ = saga.step(s, None, ev(5, "open", streamid="x", streamversion=2), 0)
    for again in (ev(5, "open", streamid="x", streamversion=2), ev(9, "pay", streamid="x", streamversion=1), ev(5, "pay")):
        assert saga.step(s, kept, again, 1) == (kept, [])
    after, _ = saga.step(s, kept, ev(3, "pay", streamid="y", streamversion=1), 1)
    assert after.version == 2 and after.streams == {"x": 2, "y": 1} and after.position == 5


def test_saga_runner():
    given, store = [], SagaStore()
    runner = SagaRunner(order(), store, given.append)
    runner.on_event("i", ev(1, "open"), 0)
    runner.on_event("j", ev(2, "open"), 1)
    assert store.with_due_timers(10) == ["i"] and runner.poll(10) == 1 and runner.poll(10) == 0
    assert given == ["ask", "ask", "late due"]
    runner.on_event("j", ev(3, "close"), 2)
    assert store.by_status(saga.COMPLETED, 99) == ["j"] and store.by_status(saga.ACTIVE, 5) == []
    assert not store.compare_and_save("i", 1, SagaState([]))
    store.delete("i")
    assert store.find("i") is None


def test_saga_batch_equals_replay(spark):
    rows = [(p, f"k{p % 3}" if p % 7 else None, ["open", "pay", "again", "two", "close"][p * p % 5], p) for p in range(1, 40)]
    log = spark.createDataFrame(rows, "position long, k string, type string, s long").withColumn("time", F.timestamp_seconds("s"))
    got = {r.saga_id: r for r in saga.run_batch(log, order(), F.col("k"), 100.0, []).collect()}
    for k in ("k0", "k1", "k2"):
        own = [ev(p, t, s) for p, key, t, s in rows if key == k]
        kept, made = replay(order(), own, 100.0, lambda e: e["t"])
        if kept is None:
            assert k not in got
            continue
        assert (got[k].status, got[k].version, json.loads(got[k].state), got[k].timers) == (kept.status, kept.version, kept.state, kept.timers)
        assert [json.loads(c.command) for c in got[k].commands] == bodies(made)


def names(made):
    return bodies(made)


def test_flow():
    steps = [
        flow.Step("look", (flow.Branch(flow.any_of(flow.all_of(flow.event("view", 2), flow.event("click")), flow.event("skip")), commands=lambda r: [f"looked {r.count('view')}"]), flow.Branch(flow.event("back"), flow.END, lambda r: ["gone"])), 10, flow.Branch(None, "buy", lambda r: ["slow"])),
        flow.Step("buy", (flow.Branch(flow.event("pay", predicate=lambda e: e["n"] > 5), flow.END, lambda r: ["paid"]), flow.Branch(flow.event("pay"), None, lambda r: ["little"], lambda r: r.none("view")), flow.Branch(flow.event("again"), "look"))),
        flow.Step("end", (flow.Branch(flow.event("bye")),), 5),
    ]
    own = flow.flow("f", "start", steps, keep=("type", "n"))
    time = lambda e: e["t"]
    run = lambda *events, until=0: replay(own, list(events), until, time)
    kept, made = run(ev(1, "start"), ev(2, "view"), ev(3, "click"), ev(4, "view"), ev(5, "pay", n=9))
    assert bodies(made) == ["looked 2", "paid"] and kept.status == saga.COMPLETED
    kept, made = run(ev(1, "start"), ev(2, "view"), ev(3, "skip"), ev(4, "pay", n=1), until=99)
    assert bodies(made) == ["looked 1"] and kept.state["step"] == "buy"  # the guard refused
    kept, made = run(ev(1, "start"), ev(2, "skip"), ev(3, "pay", n=1), until=7)
    assert kept.state["step"] == "end" and bodies(made) == ["looked 0", "little"] and kept.timers == {"f.end": 8}
    kept, made = run(ev(1, "start"), ev(2, "skip"), ev(3, "pay", n=1), until=9)
    assert kept.status == saga.COMPLETED
    kept, made = run(ev(1, "start"), until=20)
    assert bodies(made) == ["slow"] and kept.state["step"] == "buy"
    kept, made = run(ev(1, "start"), ev(2, "skip"), ev(3, "again"), ev(4, "skip"))
    assert kept.state["step"] == "buy" and bodies(made) == ["looked 0", "looked 0"]
    kept, made = run(ev(1, "start"), ev(2, "back"))
    assert bodies(made) == ["gone"]


def test_flow_window_and_checks():
    own = flow.flow("w", "start", [flow.Step("s", (flow.Branch(flow.event("x", 3), flow.END),))], history=3)
    kept, _ = replay(own, [ev(1, "start"), *[ev(2 + i, "y") for i in range(9)], ev(20, "x")], 0, lambda e: e["t"])
    assert len(kept.state["events"]) == 11  # a step's own events stay, whatever the history
    r = flow.Received([{"type": "a"}, {"type": "b"}, {"type": "b"}])
    assert r.initiating["type"] == "a" and r.count("b") == 2 and r.first("c") is None and r.any("b") and r.none("c")
    for bad in (lambda: flow.all_of(flow.event("a"), flow.event("a", 2)), lambda: flow.event("a", 0), lambda: flow.any_of(), lambda: flow.flow("e", "s", []), lambda: flow.flow("e", "s", [flow.Step("s", (flow.Branch(flow.event("x"), "nowhere"),))])):
        with pytest.raises(ValueError):
            bad()
    assert len(flow.all_of(flow.event("a"), flow.all_of(flow.event("b"), flow.event("c"))).parts) == 3


def test_windows_are_cut_when_a_step_is_left():
    """a, b and c wait for three x each; each reports what it can read."""
    read = lambda r: ["".join(str(e["n"]) for e in r.events)]
    step = lambda n: flow.Step(n, (flow.Branch(flow.event("x", 3), commands=read),))
    events = [ev(1, "start", n=0), *[ev(2 + i, "x", n=1 + i) for i in range(9)]]
    run = lambda **k: bodies(replay(flow.flow("w", "start", [step("a"), step("b"), step("c")], keep=("n",), **k), events, 0, lambda e: e["t"])[1])
    assert run() == ["0123", "0123456", "0123456789"]
    assert run(history=0) == ["0123", "0456", "0789"]
    assert run(history=2) == ["0123", "023456", "056789"]
    assert run(step_window=1) == ["03", "06", "09"]
    assert run(history=1, step_window=3) == ["0123", "03456", "06789"]
    with_noise = flow.flow("w", "start", [step("a")], keep=("n",), step_window=2)
    kept, _ = replay(with_noise, [events[0], ev(2, "x", n=1), ev(3, "y", n=2), ev(4, "x", n=3), ev(5, "y", n=4)], 0, lambda e: e["t"])
    assert [e["n"] for e in kept.state["events"]] == [0, 1, 2, 3, 4] and not kept.state["short"]


def test_step_windows_need_names_and_the_same_step():
    some = lambda e: True
    for leaves in ([flow.event("x", 2, some)], [flow.event("x", 2, some, "n"), flow.event("y", 2, lambda e: False, "n")]):
        steps = [flow.Step("a", tuple(flow.Branch(x, flow.END) for x in leaves))]
        assert flow.flow("w", "start", steps)
        with pytest.raises(ValueError):
            flow.flow("w", "start", steps, step_window=3)
    make = lambda n, window, *more: flow.flow("w", "start", [flow.Step("a", (flow.Branch(flow.event("x", n), flow.END), *[flow.Branch(flow.event(t), flow.END) for t in more]))], step_window=window)
    begun = [ev(1, "start"), ev(2, "x"), ev(3, "x"), ev(4, "x")]
    kept, _ = replay(make(9, 1), begun, 0, lambda e: e["t"])
    assert kept.state["short"] and kept.state["counts"]["n"] == [3]
    assert saga.step(make(4, 1), kept, ev(5, "x"), 5)[0].status == saga.COMPLETED  # another count of the same events
    with pytest.raises(ValueError):
        saga.step(make(9, 1, "y"), kept, ev(5, "x"), 5)
    kept, _ = replay(make(9, None), begun, 0, lambda e: e["t"])
    assert saga.step(make(4, None, "y"), kept, ev(5, "x"), 5)[0].status == saga.COMPLETED
    for bad in ({"history": -1}, {"step_window": 0}):
        with pytest.raises(ValueError):
            flow.flow("w", "start", [flow.Step("a", (flow.Branch(flow.event("x"), flow.END),))], **bad)


def test_flow_conditions_count_beyond_the_window():
    views = [ev(2 + i, "view") for i in range(3)]
    look = flow.Step("look", (flow.Branch(flow.all_of(flow.event("view", 3), flow.event("click", 2)), flow.END, lambda r: ["looked"]), flow.Branch(flow.event("x", 150), flow.END, lambda r: ["many"])))
    noise = [ev(10 + i, "x") for i in range(149)]
    own = flow.flow("c", "start", [look])
    kept, made = replay(own, [ev(1, "start"), *views, *noise, ev(200, "click"), ev(201, "click")], 0, lambda e: e["t"])
    assert bodies(made) == ["looked"] and kept.status == saga.COMPLETED
    kept, made = replay(own, [ev(1, "start"), *noise, ev(200, "x")], 0, lambda e: e["t"])
    assert bodies(made) == ["many"] and len(kept.state["events"]) == 151


def test_retry():
    slept, tried = [], []

    def fail():
        tried.append(1)
        if len(tried) < 4:
            raise KeyError("x")
        return "ok"

    assert Retry(sleep=slept.append).run(fail) == "ok" and slept == [0.1, 0.2, 0.4]
    tried.clear()
    with pytest.raises(RuntimeError):
        Retry.fixed(1, 2).with_(sleep=slept.append, map_error=lambda e: RuntimeError(e)).run(fail)
    tried.clear()
    with pytest.raises(KeyError):
        Retry.none().run(fail)
    assert [w for w, _ in zip(Retry.exponential(1, 5).waits(), range(4))] == [1, 2, 4, 5]


def test_state_tables_merge_and_conflict(spark, tmp_path, monkeypatch):
    from ledgerline.operators.fold import Conflict

    monkeypatch.setattr(StateTable, "PARTS", 3)
    table = StateTable(spark, f"file://{tmp_path}/s", "key string, n long")
    rows = lambda *r: spark.createDataFrame(r, "key string, n long")
    for i in range(5):
        table.save(rows((f"k{i % 2}", i), ("all", i)), {"p": i})
    assert {r.key: r.n for r in table.current().collect()} == {"k0": 4, "k1": 3, "all": 4} and table.position("p") == 4 and table.position("q") == 0
    assert [r.n for r in table.find("k1").collect()] == [3]

    def late(now):
        if not done:
            done.append(StateTable(spark, f"file://{tmp_path}/s", "key string, n long").save(rows(("all", 10))))
        return now.where("key = 'all'").selectExpr("key", "n + 1 AS n")

    for policy, want in (("raise", 10), ("ignore", 10), ("retry", 11)):
        done = []
        if policy == "raise":
            with pytest.raises(Conflict):
                table.save(late)
        else:
            assert table.save(late, conflict=policy) == (policy == "retry")
        assert table.find("all").first().n == want
    with pytest.raises(ValueError):
        table.save(rows(), conflict="maybe")


def test_file_stores_and_gated_polls(spark, tmp_path):
    from ledgerline.operators.saga import FileSagaStore
    from ledgerline.operators.snapshot import FileSnapshotStore, Snapshot
    from ledgerline.streaming.checkpoints import Lease

    now, sent = [0.0], []
    store = FileSagaStore(spark, f"file://{tmp_path}/sagas")
    own = Saga("o", lambda: 0, frozenset(("a",)), lambda s, i: s + 1, lambda s, i: [Command(s)], lambda s, e: [StartTimer("t", 5)])
    leases = [Lease(spark, f"file://{tmp_path}/leases", 10, lambda: now[0]) for _ in range(2)]
    one, two = (SagaRunner(own, FileSagaStore(spark, f"file://{tmp_path}/sagas"), sent.append, lease=x, require_key=True) for x in leases)
    with pytest.raises(ValueError):
        one.on_event("x/1", {"type": "a"}, 0)
    one.on_event("x/1", {"type": "a", "position": 1}, 0)
    kept = store.find("x/1")
    assert kept.version == 1 and store.with_due_timers(5) == ["x/1"] and store.with_due_timers(4) == []
    assert not store.compare_and_save("x/1", 0, kept) and leases[1].acquire("timers-o") is not None
    assert one.poll(6) == 0 and two.poll(6) == 1 and sent == [1, 2]
    assert store.by_status("active", 100) == ["x/1"]
    store.delete("x/1")
    assert store.find("x/1") is None and store.by_status("active", 100) == [] and store.compare_and_save("x/1", 0, SagaState(0, version=1))
    snapshots = FileSnapshotStore(spark, f"file://{tmp_path}/snapshots")
    snapshots.save("a b", Snapshot({"n": 1}, 4))
    assert snapshots.find("a b") == Snapshot({"n": 1}, 4) and snapshots.find("c") is None
    snapshots.delete("a b")
    assert snapshots.find("a b") is None


def test_blocked_conditions_of_a_tag_that_all_have(spark):
    """The join is on the other tag: on the common one, it has 400 million pairs. A tag that an event has twice counts once, conditions of one key add up."""
    import time

    from ledgerline.operators import dcb

    n = spark.range(20_000)
    user = F.concat(F.lit("user:"), "id")
    log = n.select(F.col("id").alias("position"), F.lit("x").alias("type"), F.array(F.lit("all"), user, user).alias("dcbtags"))
    asked = n.select(F.col("id").cast("string").alias("key"), F.lit(None).cast("array<string>").alias("types"), F.array(F.lit("all"), user).alias("tags"), F.lit(9_999).alias("token"))
    began = time.time()
    out = dcb.blocked(log, asked.unionByName(asked.where("id = 15000"))).agg(F.count("*").alias("n"), F.sum("events").alias("events")).first()
    assert (out.n, out.events) == (20_001, 10_000 + 3) and time.time() - began < 40


def test_blocked_conditions_and_coalesced_flushes(spark):
    from ledgerline.operators import dcb
    from ledgerline.operators.fold import coalesced

    log = spark.createDataFrame([(i, "x" if i % 2 else "y", ["a", "b"] if i % 3 else ["a"], i % 2) for i in range(1, 11)], "position long, type string, dcbtags array<string>, k long")
    asked = spark.createDataFrame([("1", ["x"], ["a", "b"], 0), ("2", None, ["b"], 8), ("3", [], ["c"], 0), ("4", ["y"], ["a"], 10)], "key string, types array<string>, tags array<string>, token long")
    assert {r.key: r.events for r in dcb.blocked(log, asked).collect()} == {"1": 3, "2": 1, "3": 0, "4": 0}
    got = sorted(map(tuple, coalesced(log, F.col("type"), 4, {"n": (F.count("*"), F.sum)}, after=1).collect()))
    assert got == [(0, "x", 2, 2), (0, "y", 2, 2), (1, "x", 2, 4), (1, "y", 2, 4), (2, "y", 1, 5)]
    with pytest.raises(ValueError):
        coalesced(log, F.col("type"), 0, {})
