import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerline import filter as f
from ledgerline.condition import gt, lt, not_, or_
from ledgerline.model import Event, PositionRange, decode_tags, encode_tags, format_time, parse_time, tag
from ledgerline.operators import dcb
from ledgerline.operators.decider import ApplicationService, DcbApplicationService, Decider, Dispatcher, composed_commands, partially
from ledgerline.sources.store import AppendCondition, AppendConditionNotFulfilled, DuplicateEvent, EventStore, WriteConditionNotFulfilled


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, f"file://{tmp_path}/store")


def ev(i, type="t", **kw):
    return Event(f"e{i}", type, **kw)


def ids(df):
    return [r.id for r in df.collect()]


def test_writes_stamp_versions_and_positions(store):
    one = store.write("a", [ev(1), ev(2)])
    two = store.write("b", [ev(3, data={"x": 1}, time=datetime(2026, 1, 1, 1, tzinfo=timezone(timedelta(hours=1))))])
    three = store.write("a", [ev(4)], 2)
    assert (one.old_version, one.new_version, three.old_version, three.new_version) == (0, 2, 2, 3) and one.append_id != two.append_id
    rows = {r.id: r for r in store.log().collect()}
    assert {k: (r.streamid, r.streamversion, r.position) for k, r in rows.items()} == {"e1": ("a", 1, 1), "e2": ("a", 2, 2), "e3": ("b", 1, 3), "e4": ("a", 3, 4)}
    assert rows["e3"].data == '{"x": 1}' and rows["e3"].time == datetime(2026, 1, 1) and rows["e3"].time_offset_s == 3600
    assert rows["e1"].appendid == rows["e2"].appendid == one.append_id and store.current_position() == 4
    nothing = store.write("a", [])
    assert (nothing.old_version, nothing.new_version, nothing.append_id) == (3, 3, None)


def test_write_conditions(store):
    store.write("a", [ev(1), ev(2)])
    for bad in (0, 3, gt(2), not_(2), or_(5, lt(1))):
        with pytest.raises(WriteConditionNotFulfilled):
            store.write("a", [ev(9)], bad)
    assert store.write("a", [ev(3)], or_(gt(1), 7)).new_version == 3
    assert store.write("new", [ev(4)], 0).new_version == 1


def test_duplicates_and_refusals(store):
    store.write("a", [ev(1)])
    for events in ([ev(1)], [ev(2), ev(2)]):
        with pytest.raises(DuplicateEvent):
            store.write("b", events)
    store.write("b", [ev(1, source="urn:other")])
    with pytest.raises(ValueError):
        store.write("a", [ev(5, tags=("x",))])
    with pytest.raises(ValueError):
        store.append([])
    assert store.log().count() == 2


def test_stream_reads(store):
    store.write("a", [ev(i, "even" if i % 2 == 0 else "odd") for i in range(1, 7)])
    store.write("b", [ev(9)])
    q = store.queries()
    assert ids(q.read("a").events) == [f"e{i}" for i in range(1, 7)]
    s = q.read("a", f.type_("even"), skip=2, limit=1)
    assert ids(s.events) == ["e4"] and s.version == 6
    assert q.read("none").is_empty() and q.exists_stream("b") and not q.exists_stream("none")
    assert ids(q.read_in_position_order(f.type_("odd"), PositionRange(1, 5))) == ["e3", "e5"]
    assert ids(q.after_position(6)) == ["e9"] and q.current_position() == 7
    for bad in ((-1, None), (3, 2)):
        with pytest.raises(ValueError):
            PositionRange(*bad)
    with pytest.raises(ValueError):
        q.read_events("a", f.stream_version(1))


def test_deletes_and_updates(store):
    store.write("a", [ev(1), ev(2, data={"n": 1}), ev(3)])
    store.write("b", [ev(4)])
    assert store.delete_event("e3", "urn:ledgerline") == 1 and store.delete_event("e3", "urn:ledgerline") == 0
    assert store.write("a", [ev(5)]).new_version == 3 and store.current_position() == 5
    changed = store.update_event("e2", "urn:ledgerline", lambda e: {**e, "data": {"n": 2}, "streamid": "z", "position": 99})
    row = store.log().where("id = 'e2'").first()
    assert (row.data, row.streamid, row.streamversion, row.position) == ('{"n": 2}', "a", 2, 2) and changed["data"] == '{"n": 2}'
    assert store.update_event("none", "x", lambda e: e) is None
    with pytest.raises(ValueError):
        store.update_event("e2", "urn:ledgerline", lambda e: None)
    assert store.delete_stream("a") == 3 and store.delete_stream("a") == 0
    assert store.write("a", [ev(6)]).new_version == 1
    assert store.log().where("id = 'e6'").first().position == 6
    assert store.delete(f.type_("t")) == 2 and store.log().count() == 0 and store.current_position() == 6


def test_two_writers_take_turns(spark, store):
    store.write("a", [ev(0)])
    errors = []

    def run(k):
        try:
            for i in range(3):
                EventStore(spark, store.path).write("a", [ev(f"{k}-{i}")])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = store.log().orderBy("position").collect()
    assert not errors and [r.position for r in rows] == list(range(1, 11)) and [r.streamversion for r in rows] == list(range(1, 11))


def test_of_two_conditional_writers_one_wins(spark, store):
    won, lost = [], []

    def run(k):
        try:
            won.append(EventStore(spark, store.path).write("a", [ev(k)], 0))
        except WriteConditionNotFulfilled:
            lost.append(k)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 3


def test_dcb_appends_and_reads(store):
    store.write("plain", [ev(0, "A")])
    r = store.append([ev(1, "A", tags=("u:1", "c:1", "u:1")), ev(2, "B", tags=("u:1",)), ev(3, "A", tags=())])
    assert (r.first_position, r.last_position, r.count) == (2, 4, 3)
    store.append([ev(4, "C", tags=("u:2",)), ev(5, "A", tags=("c:1", "u:2"))])
    log = store.log()
    pick = lambda c, **o: ids(dcb.select(log, c, dcb.ReadOptions(**o)))
    assert pick(dcb.everything()) == ["e1", "e2", "e3", "e4", "e5"]
    assert pick(dcb.types("A")) == ["e1", "e3", "e5"] and pick(dcb.tags("u:1")) == ["e1", "e2"] and pick(dcb.tags("c:1", "u:2")) == ["e5"]
    assert pick(dcb.tags_any_of("u:1", "u:2").excluding_types("A")) == ["e2", "e4"]
    assert pick(dcb.any_of(dcb.criterion(("A",), ("c:1",)), dcb.types("C"))) == ["e1", "e4", "e5"]
    assert pick(dcb.everything(), limit=2, direction=dcb.BACKWARD) == ["e4", "e5"] and pick(dcb.everything(), skip=1, limit=2, direction=dcb.BACKWARD) == ["e3", "e4"]
    assert pick(dcb.everything(), positions=PositionRange(2, 4)) == ["e2", "e3"]
    assert dcb.count(log, dcb.types("A"), dcb.ReadOptions(PositionRange(2), dcb.BACKWARD, 5, 1)) == 2
    assert dcb.exists(log, dcb.tags("u:2")) and not dcb.exists(log, dcb.tags("u:9"))
    read = dcb.read(log, dcb.tags("u:9"))
    assert read.head == read.token == 6 and read.events.count() == 0
    assert log.where("id = 'e1'").first().dcbtags == ["c:1", "u:1"] and log.where("id = 'e3'").first().dcbtags == []


def test_append_conditions(store):
    first = store.append([ev(1, "A", tags=("u:1",))])
    with pytest.raises(AppendConditionNotFulfilled):
        store.append([ev(2, tags=("u:1",))], AppendCondition(dcb.tags("u:1")))
    store.append([ev(3, "A", tags=("u:2",))])
    store.append([ev(2, tags=("u:1",))], AppendCondition(dcb.tags("u:1"), first.last_position))
    with pytest.raises(AppendConditionNotFulfilled):
        store.append([ev(4)], AppendCondition(dcb.tags("u:1"), first.last_position))


def test_criteria():
    for bad in (lambda: dcb.criterion(), lambda: dcb.criterion(("A",), excluding=("A",)), lambda: dcb.types(" "), lambda: dcb.everything().excluding_types("A"), lambda: dcb.any_of(), lambda: dcb.ReadOptions(limit=0), lambda: dcb.ReadOptions(skip=-1)):
        with pytest.raises(ValueError):
            bad()
    assert dcb.any_of(dcb.types("A"), dcb.everything()) == dcb.everything() and dcb.any_of(dcb.types("A")) == dcb.types("A")
    a, b = dcb.any_of(dcb.types("A", "B"), dcb.tags("x")), dcb.any_of(dcb.tags("x"), dcb.types("B", "A"))
    assert a.key() == b.key() != dcb.types("AB").key() and dcb.types("A", "B").key() != dcb.types("A1:B").key()
    placed = {dcb.stream_of([f"u:{i}"]) for i in range(500)}
    assert len(placed) == dcb.PARTITIONS and dcb.stream_of(["b", "a"]) == dcb.stream_of(["a", "b", "a"])


def test_bulk_append(spark, store):
    store.write("s1", [ev("x")])
    rows = spark.createDataFrame([(f"b{i}", "urn:b", "t", f"s{i % 3}", i) for i in range(30)], "id string, source string, type string, stream string, n int")
    r = store.append_frame(rows, "stream", ["n"])
    assert (r.first_position, r.last_position) == (2, 31)
    got = {x.id: (x.streamid, x.streamversion, x.position) for x in store.log().collect()}
    assert got["b0"] == ("s0", 1, 2) and got["b1"] == ("s1", 2, 3) and got["b29"] == ("s2", 10, 31)
    with pytest.raises(DuplicateEvent):
        store.append_frame(rows, "stream", ["n"])
    store.compact()
    assert store.log().count() == 31 and len(store._state().parts) == 1


LEDGER = Decider(0, lambda c, s: [ev(f"{c}", "deposited", data={"n": c})] if s + c <= 10 else [], lambda s, e: s + (__import__("json").loads(e["data"])["n"] if isinstance(e, dict) else e.data["n"]), lambda s: s >= 10)


def test_services(store):
    service = ApplicationService(store)
    seen = []
    service.execute_decider("acc", LEDGER, 3, side_effect=seen.extend)
    r = service.execute_decider("acc", LEDGER, 4, 9)
    assert r.new_version == 2 and len(seen) == 1
    assert service.execute("acc", lambda events: [], f.type_("none")).new_version == 2
    tagged = DcbApplicationService(store, lambda e: (f"kind:{e.type}",))
    assert tagged.execute(dcb.types("deposited"), lambda events: []) is None
    out = tagged.execute(dcb.tags("kind:opened"), lambda events: [] if events else [ev("o", "opened")])
    assert out.count == 1 and tagged.execute(dcb.tags("kind:opened"), lambda events: [] if events else [ev("p", "opened")]) is None


def test_deciders_and_commands():
    d = Decider(0, lambda c, s: [c], lambda s, e: s + e, lambda s: s >= 5)
    assert d.fold([2, 3, 4]) == 5 and d.decide_on_events([1], 2, 2, 7) == (5, [2, 2])
    both = Decider.composed(a=d, b=Decider("", lambda c, s: [], lambda s, e: s + str(e)))
    assert both.fold([4, 4, 4]) == {"a": 8, "b": "444"}
    assert d.adapted(lambda c: c > 0, lambda e: e != 9).fold([9, 1]) == 1
    assert composed_commands(lambda es: [len(es)], lambda es: [len(es), "x"])(["p"]) == [1, 2, "x"]
    assert partially(pow, 2)(3) == 8
    got = Dispatcher({int: lambda c: c + 1, "say": lambda c: c["what"]})
    assert got.dispatch_all([1, {"type": "say", "what": "hi"}]) == [2, "hi"]
    with pytest.raises(LookupError):
        got.dispatch("s")


def test_tags_and_times():
    assert tag(" a ") == "a" and tag("v", "k") == "k:v" and encode_tags(["b", "a", "b"]) == "a\nb" and decode_tags("a\nb") == ["a", "b"] and decode_tags(None) == []
    for bad in (lambda: tag(" "), lambda: tag("a\nb"), lambda: tag("v", "k:x"), lambda: parse_time("2026-01-01"), lambda: parse_time("2026-01-01T00:00:00.0000001Z")):
        with pytest.raises(ValueError):
            bad()
    for text in ("2026-07-28T12:00:00.123456000Z", "2026-07-28T12:00:00.000000000+02:30", "2026-07-28T12:00:00.000000000-01:00"):
        assert format_time(parse_time(text)) == text
    assert parse_time("2026-07-28T12:00Z") == datetime(2026, 7, 28, 12, tzinfo=timezone.utc)


def test_listeners_and_types(store):
    heard = []
    from ledgerline.streaming.subscriptions import synchronous

    synchronous(store, lambda rows: heard.extend(ids(rows)), f.type_("b"))
    store.write("a", [ev(1, "a"), ev(2, "b")])
    assert heard == ["e2"]
    assert store.log().schema["dcbtags"].dataType.simpleString() == "array<string>"
    assert store.log().select(F.max("position")).first()[0] == 2


def test_bulk_appends_refuse_repeats_and_are_heard(spark, store):
    heard = []
    store.listeners.append(lambda rows: heard.append(rows.count()))
    frame = spark.createDataFrame([("x1", "urn:b", "t", "s"), ("x2", "urn:b", "t", "s"), ("x1", "urn:c", "t", "r")], "id string, source string, type string, stream string")
    with pytest.raises(DuplicateEvent):
        store.append_frame(frame.union(frame.limit(1)), "stream", ["id"])
    assert store.append_frame(frame, "stream", ["id", "source"]).count == 3 and heard == [3]
    with pytest.raises(DuplicateEvent):
        store.append_frame(frame.limit(1), "stream", ["id"])
    assert store.append_frame(frame.limit(0), "stream", ["id"]) is None and store.log().count() == 3


def test_an_update_is_made_of_the_event_as_it_is(spark, store):
    """Another writer's update comes between the read and the commit: both count."""
    store.write("a", [ev(1, data={"n": 0}), ev(2)])
    other, calls = EventStore(spark, store.path), []

    def add(e):
        import json

        return {**e, "data": {"n": json.loads(e["data"])["n"] + 1}}

    def change(e):
        calls.append(e["data"])
        if len(calls) == 1:
            other.update_event("e1", "urn:ledgerline", add)
        return add(e)

    assert store.update_event("e1", "urn:ledgerline", change)["data"] == '{"n": 2}' and calls == ['{"n": 0}', '{"n": 1}']
    with pytest.raises(DuplicateEvent):
        store.update_event("e1", "urn:ledgerline", lambda e: {**e, "id": "e2"})
    assert store.update_event("e1", "urn:ledgerline", lambda e: {**e, "id": "e9"})["id"] == "e9" and sorted(ids(store.log())) == ["e2", "e9"]


def test_a_whole_store_condition(store):
    token = store.append([ev(1, tags=("x",))]).last_position
    store.write("a", [ev(2)])
    with pytest.raises(AppendConditionNotFulfilled):
        store.append([ev(3, tags=("y",))], AppendCondition(dcb.tags("y"), token, whole_store=True))
    assert store.append([ev(3, tags=("y",))], AppendCondition(dcb.tags("y"), store.current_position(), whole_store=True)).count == 1


def test_stale_claims_have_one_successor(spark, tmp_path, monkeypatch):
    from ledgerline.sources import files

    one, two = (files.Folder(spark, f"file://{tmp_path}/f") for _ in range(2))
    assert one._claimed("c-1.claim", "slow") and not two.create("c-1", "x")
    monkeypatch.setattr(files, "CLAIM_SECONDS", -1)
    assert two._claimed("c-1.claim-slow", "next") and not two._claimed("c-1.claim-slow", "other")
    assert one.create("c-1", "third") and one.read_text("c-1") == "third" and not two.create("c-1", "late")
    one.delete("c-1")
    assert one.names("c-1") == []


def test_commits_are_short_and_parts_outside_a_range_are_not_read(spark, store, monkeypatch):
    import json

    monkeypatch.setattr("ledgerline.sources.commits.CHECKPOINT", 4)
    for i in range(1, 7):
        store.write("a", [ev(i), ev(f"{i}b")])
    store.delete_event("e2", "urn:ledgerline")
    commits = [json.loads(store.commits.read_text(f"c-{n:012d}")) for n in range(1, 8)]
    assert ["parts" in c for c in commits] == [True, False, False, False, True, False, False] and len(commits[5]["added"]) == 1
    state = store._state()
    assert len(state.parts) == 6 and state.head == 12 and EventStore(spark, store.path)._state() == state
    found = store.positions(4, 7)
    assert sorted(ids(found)) == ["e3", "e3b", "e4"] and len(found.inputFiles()) == 2
    assert store.positions(2, 4).count() == 1 and store.positions(0, 4).count() == 3 and store.log().count() == 11


def test_copies_are_apart(store, tmp_path):
    store.write("a", [ev(1), ev(2)])
    other = store.copied(f"file://{tmp_path}/copy")
    other.write("a", [ev(3)], 2)
    assert ids(store.log().orderBy("position")) == ["e1", "e2"] and ids(other.log().orderBy("position")) == ["e1", "e2", "e3"]
