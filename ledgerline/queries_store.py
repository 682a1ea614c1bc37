"""Queries that write: each fills a store of its own with the whole canonical log, changes it, and reads it back; subscriptions deliver from such a store."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter as f
from . import sort
from .condition import and_, eq, gt, gte, in_, lt, ne, not_, or_
from .functions.retry import Retry
from .model import Event
from .operators import dcb, flow, saga, snapshot
from .operators.decider import ApplicationService, DcbApplicationService, Decider, Dispatcher, composed_commands
from .operators.fold import Projection, StateTable
from .operators.queries import EventQueries
from .operators.saga import FileSagaStore, SagaRunner
from .operators.snapshot import FileSnapshotStore, SnapshotService
from .queries import IDS, _ids, _instances, _order_saga, _plain, _versioned, query
from .sources.event_log import event_log
from .sources.shared import temporary
from .sources.store import AppendCondition, AppendConditionNotFulfilled, DuplicateEvent, EventStore, WriteConditionNotFulfilled

#: The stores that are only read, by session and tables.
_kept: dict[tuple[str, str], EventStore] = {}


def _store(spark: SparkSession, d: str) -> EventStore:
    """A store that holds the canonical log, filled by one bulk append. Not to be changed."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _kept:
        store = EventStore(spark, temporary(spark, "store"))
        store.append_frame(_frame(spark, d), "stream", ["at"])
        _kept[at] = store
    return _kept[at]


def _frame(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d, versions=False)
    return log.select("id", "source", "type", "subject", "time", "datacontenttype", "data", "dcbtags", F.col("streamid").alias("stream"), F.col("position").alias("at"))


def _own(spark: SparkSession, d: str) -> EventStore:
    """A store of the same events that may be changed."""
    return _store(spark, d).copied(temporary(spark, "store"))


def _stamped(log: DataFrame) -> DataFrame:
    return log.select("id", "streamid", "streamversion", "position")


STAMPED = "id, streamid, streamversion, position"
HEADS = "h AS (SELECT max(position) AS p FROM log), v AS (SELECT max(streamversion) AS v FROM log WHERE streamid = 'user-7')"


def _refused(what, *errors: type[Exception]) -> bool:
    try:
        what()
    except errors:
        return True
    return False


# --- writes ----------------------------------------------------------------------------------------------------------------
@query(f"SELECT {STAMPED} FROM log")
def store_bulk_append(spark, d):
    """A bulk append numbers streams and positions as the log's own order does."""
    return _stamped(_store(spark, d).log())


@query(
    f"SELECT * FROM (WITH {HEADS} SELECT {STAMPED} FROM log UNION ALL SELECT 'n1', 'user-7', v + 1, p + 1 FROM h, v UNION ALL SELECT 'n2', 'user-7', v + 2, p + 2 FROM h, v "
    "UNION ALL SELECT 'n3', 'fresh', 1, p + 3 FROM h UNION ALL SELECT 'n4', 'user-7', v + 3, p + 4 FROM h, v)"
)
def store_write_stamps(spark, d):
    """Versions go on in each stream, positions in the store; a write of nothing leaves no trace."""
    store = _own(spark, d)
    first = store.write("user-7", [Event("n1", "note"), Event("n2", "note")])
    store.write("fresh", [Event("n3", "note")], 0)
    store.write("user-7", [], first.new_version)
    store.write("user-7", [Event("n4", "note")], first.new_version)
    return _stamped(store.log())


@query(f"SELECT * FROM (WITH {HEADS} SELECT 'two' AS call, v AS old_version, v + 2 AS new_version, true AS has_append FROM v UNION ALL SELECT 'none', v + 2, v + 2, false FROM v UNION ALL SELECT 'first', 0, 1, true)")
def store_write_results(spark, d):
    store = _own(spark, d)
    made = {"two": store.write("user-7", [Event("n1", "note"), Event("n2", "note")]), "none": store.write("user-7", []), "first": store.write("fresh", [Event("n3", "note")])}
    return spark.createDataFrame([(k, r.old_version, r.new_version, r.append_id is not None) for k, r in made.items()], "call string, old_version long, new_version long, has_append boolean")


@query(
    "SELECT streamid, version = 90 AS is_90, version > 90 AS above, NOT (version < 100) AS not_below, version = 3 OR version > 110 AS either, version >= 80 AND version <> 90 AS both FROM "
    "(SELECT 'user-' || u AS streamid, (SELECT count(*) FROM log WHERE streamid = 'user-' || u) AS version FROM generate_series(1, 5) AS t(u))"
)
def store_write_conditions(spark, d):
    """Which conditions on a stream's version let a write through."""
    store, rows = _store(spark, d), []
    conditions = [90, gt(90), not_(lt(100)), or_(3, gt(110)), and_(gte(80), ne(90))]
    for u in range(1, 6):
        rows.append((f"user-{u}", *[not _refused(lambda c=c, u=u: store.write(f"user-{u}", [], c), WriteConditionNotFulfilled) for c in conditions]))
    return spark.createDataFrame(rows, "streamid string, is_90 boolean, above boolean, not_below boolean, either boolean, both boolean")


@query("SELECT * FROM (VALUES ('in the log', true), ('twice in a batch', true), ('in the log of a frame', true), ('twice in a frame', true), ('of another source', false), ('tagged in a stream write', true), ('nothing appended', true)) AS t(what, refused)", log=False)
def store_duplicates_refused(spark, d):
    store = _own(spark, d)
    frame = _frame(spark, d).where("at <= 2")
    new = frame.withColumn("id", F.lit("twice"))
    source = "urn:testdata:events"
    cases = {
        "in the log": lambda: store.write("s", [Event("17", "note", source)]),
        "twice in a batch": lambda: store.write("s", [Event("x", "note"), Event("x", "note")]),
        "in the log of a frame": lambda: store.append_frame(frame, "stream", ["at"]),
        "twice in a frame": lambda: store.append_frame(new, "stream", ["at"]),
        "of another source": lambda: store.write("s", [Event("17", "note", "urn:other")]),
        "tagged in a stream write": lambda: store.write("s", [Event("y", "note", tags=("a",))]),
        "nothing appended": lambda: store.append([]),
    }
    return spark.createDataFrame([(k, _refused(c, DuplicateEvent, ValueError)) for k, c in cases.items()], "what string, refused boolean")


@query(f"SELECT * FROM (WITH {HEADS} SELECT {STAMPED} FROM log WHERE streamid <> 'user-7' UNION ALL SELECT 'n1', 'user-7', 1, p + 1 FROM h)")
def store_delete_stream(spark, d):
    """An emptied stream begins at 1 again; positions are never used twice; a stream that isn't there is no error."""
    store = _own(spark, d)
    store.delete_stream("user-7")
    store.delete_stream("nobody")
    store.write("user-7", [Event("n1", "note")], 0)
    return _stamped(store.log())


@query(f"SELECT {STAMPED} FROM log WHERE id <> '17'")
def store_delete_event(spark, d):
    store = _own(spark, d)
    store.delete_event("17", "urn:testdata:events")
    store.delete_event("17", "urn:nowhere")
    return _stamped(store.log())


@query(f"SELECT {STAMPED} FROM log WHERE NOT (type = 'error' AND k > 50)")
def store_delete_by_filter(spark, d):
    store = _own(spark, d)
    store.delete(f.type_("error") & f.data("k", gt(50)))
    return _stamped(store.log())


@query("SELECT id, streamid, streamversion, position, CASE WHEN id = '17' THEN 'changed' ELSE type END AS type, CASE WHEN id = '17' THEN -1 ELSE k END AS k FROM log")
def store_update_event(spark, d):
    """An update changes what its function changes, and never the stamps."""
    store = _own(spark, d)
    store.update_event("17", "urn:testdata:events", lambda e: {**e, "type": "changed", "data": {"k": -1}, "streamid": "other", "position": 1, "streamversion": 99})
    store.update_event("17", "urn:nowhere", lambda e: {**e, "type": "never"})
    return store.log().select("id", "streamid", "streamversion", "position", "type", F.get_json_object("data", "$.k").cast("long").alias("k"))


@query(f"SELECT {STAMPED} FROM log WHERE id <> '3' UNION ALL SELECT 'n1', 'fresh', 1, max(position) + 1 FROM log")
def store_compacted(spark, d):
    store = _own(spark, d)
    store.write("fresh", [Event("n1", "note")])
    store.delete_event("3", "urn:testdata:events")
    store.compact()
    return _stamped(store.log())


@query("SELECT 'user-' || u AS streamid, EXISTS (SELECT 1 FROM log WHERE streamid = 'user-' || u) AS found FROM (VALUES (1), (7), (99), (100000), (-1)) AS t(u)")
def stream_exists(spark, d):
    q = _store(spark, d).queries()
    return spark.createDataFrame([(f"user-{u}", q.exists_stream(f"user-{u}")) for u in (1, 7, 99, 100000, -1)], "streamid string, found boolean")


# --- appends by criteria ---------------------------------------------------------------------------------------------------
@query("SELECT * FROM (WITH h AS (SELECT max(position) AS p FROM log) SELECT 'd1' AS id, p + 1 AS position, 'a:1,b:2' AS tags FROM h UNION ALL SELECT 'd2', p + 2, '' FROM h UNION ALL SELECT 'd3', p + 3, 'a:1' FROM h)")
def dcb_append(spark, d):
    """Tags are kept once each and in order; an event without tags is one of them all the same."""
    store = _own(spark, d)
    store.append([Event("d1", "placed", tags=("b:2", "a:1", "b:2")), Event("d2", "placed"), Event("d3", "placed", tags=("a:1",))])
    return store.log().where("type = 'placed'").select("id", "position", F.array_join("dcbtags", ",").alias("tags"))


@query(
    "SELECT * FROM (WITH h AS (SELECT max(position) AS p FROM log), m AS (SELECT max(position) AS p FROM log WHERE type = 'purchase' AND list_contains(dcbtags, 'user:7')) "
    "SELECT 'any purchase' AS what, true AS refused UNION ALL SELECT 'after the last one', false UNION ALL SELECT 'before the last one', true UNION ALL SELECT 'unknown tag', false "
    "UNION ALL SELECT 'whole store at its head', false UNION ALL SELECT 'whole store before it', h.p > m.p FROM h, m)"
)
def dcb_append_conditions(spark, d):
    """Which conditions fail an append. Each append that goes through is of an event that no later condition asks for."""
    store = _own(spark, d)
    own = dcb.criterion(("purchase",), ("user:7",))
    last = store.log().where(own.column()).agg(F.max("position")).first()[0]
    head = store.current_position()
    cases = {
        "any purchase": AppendCondition(own),
        "after the last one": AppendCondition(own, last),
        "before the last one": AppendCondition(own, last - 1),
        "unknown tag": AppendCondition(dcb.tags("user:none")),
        "whole store before it": AppendCondition(dcb.tags("user:none"), last, whole_store=True),
    }
    refused = {k: _refused(lambda k=k, c=c: store.append([Event(k, "asked", tags=("asked",))], c), AppendConditionNotFulfilled) for k, c in cases.items()}
    now = store.current_position()
    assert now > head
    refused["whole store at its head"] = _refused(lambda: store.append([Event("z", "asked", tags=("asked",))], AppendCondition(dcb.tags("user:none"), now, whole_store=True)), AppendConditionNotFulfilled)
    return spark.createDataFrame(list(refused.items()), "what string, refused boolean")


@query("SELECT max(position) AS head, max(position) AS token, count(*) FILTER (list_contains(dcbtags, 'k:3') AND type = 'signup') AS n FROM log")
def dcb_head_and_token(spark, d):
    """The head is the log's, whatever the criteria match."""
    found = dcb.read(_store(spark, d).log(), dcb.criterion(("signup",), ("k:3",)))
    return spark.createDataFrame([(found.head, found.token, found.events.count())], "head long, token long, n long")


@query(f"SELECT {IDS} FROM log WHERE dcbtags IS NOT NULL")
def dcb_everything(spark, d):
    return _ids(dcb.select(event_log(spark, d, False), dcb.everything()))


@query(f"SELECT {IDS} FROM log WHERE dcbtags IS NOT NULL AND (list_contains(dcbtags, 'k:1') OR list_contains(dcbtags, 'k:2')) AND type <> 'purchase'")
def dcb_tags_any_of(spark, d):
    return _ids(dcb.select(event_log(spark, d, False), dcb.tags_any_of("k:1", "k:2").excluding_types("purchase")))


# --- services --------------------------------------------------------------------------------------------------------------
@query(f"SELECT * FROM (WITH {HEADS} SELECT 'sum' AS id, v + 1 AS streamversion, p + 1 AS position, (SELECT CAST(sum(k) AS BIGINT) FROM log WHERE streamid = 'user-7' AND type = 'purchase' AND streamversion > 10) AS spent, 1 AS heard FROM h, v)")
def application_service(spark, d):
    """Reads a stream's purchases after version 10, decides on them, writes at the version it has read, and tells of it."""
    store, heard = _own(spark, d), []
    service = ApplicationService(store)

    def decide(events):
        return [Event("sum", "summed", data={"spent": sum(json.loads(e["data"])["k"] for e in events)})]

    service.execute("user-7", decide, f.only_types("purchase"), 10, heard.extend)
    service.execute("user-7", lambda events: [], side_effect=heard.extend)
    return store.log().where("type = 'summed'").select("id", "streamversion", "position", F.get_json_object("data", "$.spent").cast("long").alias("spent"), F.lit(len(heard)).alias("heard"))


@query("SELECT * FROM (WITH h AS (SELECT max(position) AS p FROM log), n AS (SELECT count(*) AS n FROM log WHERE list_contains(dcbtags, 'user:7') AND type = 'signup') SELECT 'c' || i AS id, p + i AS position, n + i - 1 AS seen FROM h, n, generate_series(1, 2) AS t(i))")
def dcb_application_service(spark, d):
    """Decides on a user's signups across streams and appends with the token of that read; the second decision sees the first's event."""
    store = _own(spark, d)
    service = DcbApplicationService(store, lambda e: ("user:7",))
    own = dcb.criterion(("signup",), ("user:7",))
    for i in (1, 2):
        service.execute(own, lambda events, i=i: [Event(f"c{i}", "signup", data={"seen": len(events)})])
    service.execute(own, lambda events: [])
    return store.log().where("id like 'c%'").select("id", "position", F.get_json_object("data", "$.seen").cast("long").alias("seen"))


def _account() -> Decider:
    """Spends up to what a stream's views are worth, and closes at nothing."""

    def decide(c, s):
        return [Event(f"spend-{c['n']}-{s['left'] % 7}", "spent", data={"k": min(c["n"], s["left"])})] if s["left"] > 0 else []

    def evolve(s, e):
        kind, data = (e["type"], e["data"]) if isinstance(e, dict) else (e.type, e.data)
        k = (json.loads(data) if isinstance(data, str) else data)["k"]
        return {"left": s["left"] + (k if kind == "view" else -k if kind == "spent" else 0)}

    return Decider({"left": 0}, decide, evolve)


@query(
    f"SELECT * FROM (WITH {HEADS}, s AS (SELECT CAST(sum(k) AS BIGINT) AS k FROM log WHERE streamid = 'user-7' AND type = 'view') SELECT v + 1 AS streamversion, least(100, k) AS k FROM v, s UNION ALL SELECT v + 2, least(50, k - 100) FROM v, s WHERE k > 100 UNION ALL SELECT v + 3, least(1000000, k - 150) FROM v, s WHERE k > 150)"
)
def decider_on_a_store(spark, d):
    """Commands on a stream: those of one call see each other's events, and those of the next what was written."""
    store = _own(spark, d)
    service = ApplicationService(store)
    service.execute_decider("user-7", _account(), {"n": 100}, {"n": 50})
    service.execute_decider("user-7", _account(), {"n": 1_000_000}, {"n": 5})
    return store.log().where("type = 'spent'").select("streamversion", F.get_json_object("data", "$.k").cast("long").alias("k"))


@query(f"SELECT * FROM (WITH {HEADS}, s AS (SELECT CAST(sum(k) AS BIGINT) AS k FROM log WHERE streamid = 'user-7' AND type = 'view') SELECT v + 2 AS version, k - 15 AS left, true AS resumed FROM v, s)")
def decider_with_snapshots(spark, d):
    """The second call folds from the first one's snapshot, kept in files, and reads only what came after it."""
    store, kept = _own(spark, d), FileSnapshotStore(spark, temporary(spark, "snapshots"))
    SnapshotService(store, kept, snapshot.always()).execute("user-7", _account(), {"n": 10})
    found = kept.find("user-7")
    result = SnapshotService(store, kept, snapshot.always()).execute("user-7", _account(), {"n": 5})
    last = kept.find("user-7")
    return spark.createDataFrame([(last.version, last.state["left"], found.version == result.old_version)], "version long, left long, resumed boolean")


@query("SELECT type, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM log WHERE streamid = 'user-7' AND type IN ('view', 'click') GROUP BY type UNION ALL SELECT 'both', count(*), CAST(sum(k) AS BIGINT) FROM log WHERE streamid = 'user-7' AND type IN ('view', 'click')")
def composed_command_functions(spark, d):
    """A chain of commands over a stream's events: the last one sees what the ones before have made."""
    events = [(r.type, json.loads(r.data)["k"]) for r in _store(spark, d).queries().read_events("user-7", f.type_(in_("view", "click"))).collect()]  # one stream
    count = lambda kind: lambda es: [(f"n:{kind}", len([1 for e in es if e[0] == kind]), sum(e[1] for e in es if e[0] == kind))]
    both = lambda es: [("n:both", sum(e[1] for e in es if e[0].startswith("n:")), sum(e[2] for e in es if e[0].startswith("n:")))]
    made = composed_commands(count("view"), count("click"), both)(events)
    return spark.createDataFrame([(t.removeprefix("n:"), n, k) for t, n, k in made], "type string, n long, total long")


@query("SELECT * FROM (VALUES ('add', 3), ('add', 4), ('drop', -1), ('none', NULL)) AS t(type, result)", log=False)
def command_dispatch(spark, d):
    own = Dispatcher({"add": lambda c: c["n"] + 1, "drop": lambda c: -c["n"]})
    made = [("add", x) for x in own.dispatch_all([{"type": "add", "n": 2}, {"type": "add", "n": 3}])] + [("drop", own.dispatch({"type": "drop", "n": 1}))]
    return spark.createDataFrame([*made, ("none", None if _refused(lambda: own.dispatch({"type": "none"}), LookupError) else 0)], "type string, result int")


@query("SELECT * FROM (VALUES (1, 100), (2, 200), (3, 400), (4, 800), (5, 1600), (6, 2000), (7, 2000)) AS t(attempt, wait_ms)", log=False)
def retry_backoff(spark, d):
    waits, tries = [], []

    def fails():
        tries.append(1)
        raise OSError("not yet")

    _refused(lambda: Retry.exponential(0.1, 2.0, attempts=8).with_(sleep=waits.append).run(fails), OSError)
    return spark.createDataFrame([(i + 1, round(w * 1000)) for i, w in enumerate(waits)], "attempt int, wait_ms int")


# --- filters on every attribute --------------------------------------------------------------------------------------------
def _dressed(spark, d) -> DataFrame:
    """The log with all attributes, some of them missing."""
    p = F.col("position")
    log = event_log(spark, d, versions=False)
    log = log.withColumn("source", F.when(p % 5 == 0, "urn:five").otherwise(F.col("source"))).withColumn("specversion", F.when(p % 4 == 0, "0.3").otherwise("1.0"))
    return log.withColumn("dataschema", F.when(p % 3 == 0, F.concat(F.lit("urn:schema:"), p % 2))).withColumn("datacontenttype", F.when(p % 7 == 0, "text/plain").when(p % 7 == 1, None).otherwise("application/json"))


@query(f"SELECT {IDS} FROM log WHERE position % 5 = 0 AND position % 4 <> 0")
def filter_source_and_spec_version(spark, d):
    return _ids(EventQueries(_dressed(spark, d)).query(f.source("urn:five") & f.spec_version(ne("0.3"))))


@query(f"SELECT {IDS} FROM log WHERE (position % 3 = 0 AND position % 2 = 1) OR (position % 3 <> 0 AND position % 7 = 1)")
def filter_schema_and_content_type(spark, d):
    """A missing attribute equals null."""
    return _ids(EventQueries(_dressed(spark, d)).query(f.data_schema("urn:schema:1") | (f.data_schema(eq(None)) & f.data_content_type(eq(None)))))


@query(f"SELECT {IDS} FROM log WHERE k = 42 AND position % 7 <> 0")
def filter_payload_of_json_only(spark, d):
    """Payloads of another content type have no paths; those without a type are JSON."""
    return _ids(EventQueries(_dressed(spark, d)).query(f.data("k", 42)))


@query(f"SELECT {IDS} FROM log WHERE subject >= '3' AND subject < '5'")
def filter_subject_range(spark, d):
    return _ids(_plain(spark, d).query(f.subject(and_(gte("3"), lt("5")))))


@query(f"SELECT {IDS} FROM log WHERE type IN ('signup', 'purchase') AND streamid = 'user-7'")
def filter_only_types(spark, d):
    """What an application service reads if it names its types."""
    return _ids(_versioned(spark, d).read_events("user-7", f.only_types("signup", "purchase")))


@query(f"SELECT {IDS} FROM log WHERE k IN (10, 20)")
def filter_mapped_condition(spark, d):
    """A condition over another kind of values, turned to one over the payload's."""
    return _ids(_plain(spark, d).query(f.data("k", in_("10", "20").map(int))))


@query(f"SELECT {IDS} FROM log WHERE type = 'view' AND (subject = '3' OR true)")
def filter_without_payload(spark, d):
    """A filter with its payload conditions taken as met, as for events that come without payloads."""
    own = f.type_("view") & (f.subject("3") | f.data("k", 4))
    assert f.references_payload(own) and not f.references_payload(f.without_payload(own))
    return _ids(EventQueries(event_log(spark, d, versions=False), payloads=False).query(f.without_payload(own)))


@query(f"SELECT {IDS} FROM log WHERE k = 5")
def filter_repeated_keys(spark, d):
    """Of a key that a payload has twice, the first counts."""
    log = event_log(spark, d, versions=False).drop("data_v").withColumn("data", F.format_string('{"k":%d,"k":%d,"of":{"z":1}}', F.col("k"), F.col("k") + 1))
    return _ids(EventQueries(log).query(f.data("k", 5) & f.data("of.z", 1)))


@query("SELECT position, id, CASE WHEN position % 3 = 0 THEN NULL ELSE subject END AS subject FROM log ORDER BY (CASE WHEN position % 3 = 0 THEN NULL ELSE subject END) NULLS FIRST, position LIMIT 3400")
def sort_nulls_first(spark, d):
    """Missing values come before all others."""
    log = event_log(spark, d, versions=False).withColumn("subject", F.when(F.col("position") % 3 != 0, F.col("subject")))
    return EventQueries(log).all(limit=3400, sort=sort.by("subject").then_natural()).select("position", "id", "subject")


# --- folds, snapshots, sagas -----------------------------------------------------------------------------------------------
@query("SELECT streamid AS key, streamversion AS version FROM log WHERE type = 'purchase'")
def snapshot_on_event(spark, d):
    """on_event, asked after every event: a snapshot at each purchase."""
    return snapshot.taken(_versioned(spark, d).log, snapshot.on_event("purchase"))


@query("SELECT streamid AS key, streamversion AS version FROM (SELECT *, streamversion - coalesce(max(streamversion) FILTER (type = 'purchase') OVER (PARTITION BY streamid ORDER BY streamversion ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM log) WHERE type = 'purchase' OR since % 4 = 0")
def snapshot_every_or_on_event(spark, d):
    """Either policy: at each purchase, and whenever four events have come since the last snapshot."""
    return snapshot.taken(_versioned(spark, d).log, snapshot.every(4).or_(snapshot.on_event("purchase")))


@query("SELECT streamid AS key, streamversion AS version FROM (SELECT *, sum(k) OVER w AS total, lag(streamid) OVER w AS prev FROM log WINDOW w AS (PARTITION BY streamid ORDER BY streamversion)) WHERE (total // 500) % 2 = 1")
def snapshot_when_state(spark, d):
    """A policy that looks at the state: while the total's five hundreds are odd."""
    from .operators.fold import View

    return snapshot.taken(_versioned(spark, d).log, snapshot.when_state(lambda s: s // 500 % 2 == 1), View(lambda: 0, lambda s, e: s + e["k"]), ["k"])


@query("SELECT count(*) AS n FROM log WHERE false")
def snapshot_never(spark, d):
    return snapshot.taken(_versioned(spark, d).log, snapshot.never()).agg(F.count("*").alias("n"))


@query("SELECT streamid AS key, CAST(sum(position) FILTER (type = 'view') AS BIGINT) AS at, max(streamversion) FILTER (type = 'click') AS last FROM log WHERE type IN ('view', 'click') GROUP BY streamid")
def projection_of_metadata(spark, d):
    """Handlers get an event's metadata: positions and versions."""
    from .operators.fold import project

    p = Projection("meta", lambda: {"at": None, "last": None}, F.col("streamid")).on("view", lambda s, e: {**s, "at": (s["at"] or 0) + e["position"]}).on("click", lambda s, e: {**s, "last": max(s["last"] or 0, e["streamversion"])})
    return project(event_log(spark, d), p, "at bigint, last bigint", lambda s: s, columns=["type", "streamversion"])


@query("SELECT streamid AS key, count(*) FILTER (type = 'view') AS n FROM log GROUP BY streamid")
def state_table_of_batches(spark, d):
    """States kept over batches: each is one read and one write, and a conflict is tried again."""
    table = StateTable(spark, temporary(spark, "states"), "key string, n long")
    log = _store(spark, d).log()
    head = _store(spark, d).current_position()
    for lo, hi in ((0, head // 3), (head // 3, head // 2), (head // 2, head)):
        new = log.where((F.col("position") > lo) & (F.col("position") <= hi)).groupBy(F.col("streamid").alias("key")).agg(F.count_if(F.col("type") == "view").alias("m"))
        table.save(lambda now, new=new: new.join(now, "key", "left").select("key", (F.col("m") + F.coalesce("n", F.lit(0))).alias("n")), {"p": hi}, conflict="retry")
    assert table.position("p") == head
    return table.current()


@query("SELECT saga_id, step FROM (WITH began AS (SELECT streamid, min(position) AS began FROM log WHERE type = 'signup' GROUP BY streamid) SELECT b.streamid AS saga_id, CASE WHEN (SELECT count(*) FROM log l WHERE l.streamid = b.streamid AND l.position > b.began AND l.type IN ('view', 'click')) >= 150 THEN '__end__' ELSE 'watch' END AS step FROM began b)")
def flow_count_past_window(spark, d):
    """150 events, more than the history that a flow keeps by default; streams are paired so that some have as many."""
    own = flow.flow("watch", "signup", [flow.Step("watch", (flow.Branch(flow.any_of(flow.event("seen", 150), flow.event("never")), flow.END),))])
    log = event_log(spark, d, False).withColumn("type", F.when(F.col("type").isin("view", "click"), "seen").otherwise(F.col("type")))
    return saga.run_batch(log, own, F.col("streamid"), 4e9, []).select("saga_id", F.get_json_object("state", "$.step").alias("step"))


@query(
    "SELECT saga_id, command FROM (WITH began AS (SELECT streamid, arg_min(time, position) AS t, min(position) AS p FROM log WHERE type = 'signup' GROUP BY streamid), "
    "first AS (SELECT b.streamid, b.t, (SELECT min(l.time) FROM log l WHERE l.streamid = b.streamid AND l.position > b.p AND l.type = 'purchase') AS bought FROM began b) "
    "SELECT streamid AS saga_id, CASE WHEN bought < t + INTERVAL 1 DAY THEN 'thanks' ELSE 'remind' END AS command FROM first)"
)
def flow_step_timeout(spark, d):
    """A purchase within a day of the signup, or else the step's timeout and its command."""
    own = flow.flow("buy", "signup", [flow.Step("wait", (flow.Branch(flow.event("purchase"), flow.END, lambda r: ["thanks"]),), 86400, flow.Branch(None, flow.END, lambda r: ["remind"]))])
    found = saga.commands(_instances(spark, d, own))
    return found.select("saga_id", F.get_json_object(F.concat(F.lit('{"c":'), F.col("command"), F.lit("}")), "$.c").alias("command"))


@query("SELECT saga_id, version, purchases FROM (SELECT 'user-7' AS saga_id, count(*) AS version, count(*) FILTER (type = 'purchase') AS purchases FROM (SELECT * FROM log WHERE streamid = 'user-7' AND type IN ('signup', 'purchase') AND position >= (SELECT min(position) FROM log WHERE streamid = 'user-7' AND type = 'signup')))")
def saga_runner_on_files(spark, d):
    """An instance over one stream's events, kept in files; events that come twice count once."""
    from dataclasses import replace

    kept, sent = FileSagaStore(spark, temporary(spark, "sagas")), []
    own = replace(_order_saga(), events=frozenset(("purchase",)))
    runner = SagaRunner(own, kept, sent.append, require_key=True)
    rows = _store(spark, d).queries().read_events("user-7", f.type_(in_("signup", "purchase"))).collect()  # one stream
    for r in rows:
        e = {"type": r.type, "k": json.loads(r.data)["k"], "position": r.position, "streamid": r.streamid, "streamversion": r.streamversion}
        for _ in range(1 + r.position % 2):
            runner.on_event("user-7", e, r.position)
    found = kept.find("user-7")
    assert len(sent) == found.state["n"] and kept.by_status("active", 1e18) == ["user-7"]
    return spark.createDataFrame([("user-7", found.version, found.state["n"])], "saga_id string, version long, purchases long")


# --- subscriptions ---------------------------------------------------------------------------------------------------------
def _delivered(spark, d, f_=None, **kwargs) -> DataFrame:
    """What a subscription over the store gets until it has caught up: batch and position of each event."""
    from .streaming.subscriptions import Subscriptions

    at = temporary(spark, "delivered")
    subs = Subscriptions(_store(spark, d), temporary(spark, "checkpoints"))
    try:
        query = subs.subscribe("s", lambda batch, n: batch.select("position", "id", "type", "streamid", F.lit(n).alias("batch")).write.mode("overwrite").parquet(f"{at}/batch={n:06d}"), f_, **kwargs)
        query.processAllAvailable()
    finally:
        subs.stop()
    return spark.read.schema("position long, id string, type string, streamid string").option("recursiveFileLookup", "true").parquet(at)


@query(f"SELECT {IDS} FROM log WHERE type = 'purchase' AND k > 20")
def subscription_from_the_beginning(spark, d):
    """The backlog of a filter, payload conditions among it, in several batches."""
    return _ids(_delivered(spark, d, f.type_("purchase") & f.data("k", gt(20)), most=4000))


@query(f"SELECT {IDS} FROM log WHERE position > 4000 AND dcbtags IS NOT NULL AND list_contains(dcbtags, 'k:3')")
def subscription_of_criteria_after_a_position(spark, d):
    return _ids(_delivered(spark, d, dcb.tags("k:3"), start=4000))


@query(f"SELECT {IDS} FROM log WHERE type = 'error' AND position > (SELECT max(position) FROM log WHERE time <= TIMESTAMP '2024-01-03')")
def subscription_from_a_time(spark, d):
    """A time stands for the last position at or before it."""
    return _ids(_delivered(spark, d, f.type_("error"), start=datetime(2024, 1, 3, tzinfo=timezone.utc)))


@query("SELECT position, id, type, streamid, row_number() OVER (ORDER BY time, streamversion, position) AS n FROM log WHERE time > TIMESTAMP '2024-01-02' AND type <> 'view'")
def catch_up_in_time_order(spark, d):
    """By time, then version in the stream: what a subscription that starts at a time gets before it goes on live."""
    from .sources.event_log import numbered
    from .streaming.subscriptions import catch_up_by_time

    got = []
    head = catch_up_by_time(_store(spark, d), got.append, datetime(2024, 1, 2, tzinfo=timezone.utc), f.type_(ne("view")))
    assert head == _store(spark, d).current_position()
    return numbered(got[0], ["time", "streamversion", "position"], "n").select("position", "id", "type", "streamid", "n")


@query("SELECT streamid AS key, count(*) FILTER (type = 'view') AS views, count(*) FILTER (type = 'click') AS clicks FROM log WHERE type IN ('view', 'click') GROUP BY streamid")
def subscription_keeps_a_projection(spark, d):
    """States and the position they are of are one commit per batch."""
    from .streaming.subscriptions import Subscriptions

    table = StateTable(spark, temporary(spark, "states"), "key string, views long, clicks long")
    p = Projection("seen", lambda: {"views": 0, "clicks": 0}, F.col("streamid")).on("view", lambda s, e: {**s, "views": s["views"] + 1}).on("click", lambda s, e: {**s, "clicks": s["clicks"] + 1})
    subs = Subscriptions(_store(spark, d), temporary(spark, "checkpoints"))
    try:
        subs.project("p", p, table, "views long, clicks long", lambda s: s, columns=["type"], most=5000).processAllAvailable()
    finally:
        subs.stop()
    return table.current()


@query("SELECT * FROM (VALUES ('if absent', true, 'position:5'), ('again if absent', false, 'position:5'), ('any', true, 'position:6'), ('older writer', false, 'position:6'), ('same writer', true, 'position:7'), ('deleted', true, NULL)) AS t(what, saved, kept)", log=False)
def checkpoint_conditions(spark, d):
    from .streaming.checkpoints import IF_ABSENT, Checkpoints, NotOlderThan, position_checkpoint

    own, rows = Checkpoints(spark, temporary(spark, "checkpoints")), []
    for what, position, condition, version in [("if absent", 5, IF_ABSENT, 3), ("again if absent", 9, IF_ABSENT, 3), ("any", 6, "any", 3), ("older writer", 9, NotOlderThan(2), 0), ("same writer", 7, NotOlderThan(3), 0)]:
        rows.append((what, own.save("s", position_checkpoint(position), condition, version), own.read("s")))
    own.delete("s")
    return spark.createDataFrame([*rows, ("deleted", True, own.read("s"))], "what string, saved boolean, kept string")


@query("SELECT * FROM (VALUES (1, 'a', true), (2, 'b', false), (3, 'b', true), (4, 'a', false), (5, 'a', true)) AS t(n, who, holds)", log=False)
def competing_consumers(spark, d):
    """One holder at a time: the other gets the lease when it runs out or is given back."""
    from .streaming.checkpoints import Lease

    now, at = [0.0], temporary(spark, "leases")
    a, b = (Lease(spark, at, 10, lambda: now[0]) for _ in range(2))
    rows = [(1, "a", a.acquire("s") is not None), (2, "b", b.acquire("s") is not None)]
    now[0] = 11.0
    rows += [(3, "b", b.acquire("s") is not None), (4, "a", a.acquire("s") is not None)]
    b.release("s")
    return spark.createDataFrame([*rows, (5, "a", a.acquire("s") is not None)], "n int, who string, holds boolean")


@query("SELECT type, CASE type WHEN 'purchase' THEN 'sales' WHEN 'signup' THEN 'people' ELSE 'rest' END AS topic, streamid AS key, k FROM log WHERE type <> 'view'")
def forwarding_by_destination(spark, d):
    """Rows for a broker, to destinations by type; a sink that fails once is tried again."""
    from .streaming.subscriptions import DeliveryPolicy, Subscriptions, destinations, events_of_kafka, forwarding

    at, tries = temporary(spark, "sent"), []

    def sink(rows):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("not yet")
        rows.write.mode("overwrite").parquet(at)

    subs = Subscriptions(_store(spark, d), temporary(spark, "checkpoints"))
    try:
        own = destinations({"purchase": "sales", "signup": "people"}, "rest")
        forwarding(subs, "f", own, sink, DeliveryPolicy(Retry(attempts=3, initial=0.0)), f=f.type_(ne("view")), trigger={"availableNow": True}).awaitTermination()
    finally:
        subs.stop()
    sent = spark.read.parquet(at)
    back = events_of_kafka(sent.select("value")).select("id", "type", F.get_json_object("data", "$.k").cast("long").alias("k"))
    return sent.select("topic", "key", F.get_json_object(F.col("value").cast("string"), "$.id").alias("id")).join(back, "id").select("type", "topic", "key", "k")


@query("SELECT CAST(id AS BIGINT) AS n, type FROM log WHERE position <= 30 AND time <= TIMESTAMP '2024-01-01 12:00:00' AND type <> 'view'")
def deadlines_due(spark, d):
    """Deadlines at the times of the first 30 events, a category for each type: those due by noon go to the categories' consumers."""
    from .streaming.deadlines import Deadlines

    own, got = Deadlines(spark, temporary(spark, "deadlines")), []
    rows = event_log(spark, d, False).where("position <= 30").select("id", "type", F.unix_micros(F.col("time").cast("timestamp")).alias("us")).collect()  # 30 rows
    at = lambda us: datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)
    for r in rows:
        own.schedule(r.id, r.type, at(r.us))
    for kind in {r.type for r in rows} - {"view"}:
        own.register(kind, lambda id, category, due, data: got.append((int(id), category)))
    own.poll(datetime(2024, 1, 1, 12, tzinfo=timezone.utc))
    return spark.createDataFrame(got, "n long, type string")


@query("SELECT * FROM (VALUES (1, 'delivered'), (2, 'delivered'), (3, 'filtered'), (4, 'not deliverable'), (5, 'deferred'), (6, 'refused')) AS t(n, outcome)", log=False)
def push_feed_outcomes(spark, d):
    from .streaming.subscriptions import PushFeed

    got = []
    feed = PushFeed(got.append, lambda e: e["type"] != "view", buffer=1)
    e = lambda i, t="x": {"id": str(i), "source": "s", "type": t}
    made = [feed.push(e(1)), feed.push(e(1)), feed.push(e(2, "view")), feed.push({"type": "x"})]
    feed.replaying = True
    made += [feed.push(e(3)), feed.push(e(4))]
    feed.catch_up([])
    assert [x["id"] for x in got] == ["1", "3"]
    return spark.createDataFrame([(i + 1, o.value) for i, o in enumerate(made)], "n int, outcome string")


@query("SELECT * FROM (VALUES ('one', 1, 'a', 'delivered'), ('many', 1, 'a', 'delivered'), ('many', 1, 'b', 'filtered'), ('many', 2, 'a', 'delivered'), ('many', 2, 'b', 'delivered')) AS t(hub, n, consumer, outcome)", log=False)
def push_hub_consumers(spark, d):
    """One consumer or many of one source; a second one is refused where there may be one only."""
    from .streaming.subscriptions import PushHub

    one, many = PushHub(many=False), PushHub()
    one.register("a", lambda e: None)
    assert _refused(lambda: one.register("b", lambda e: None), ValueError)
    many.register("a", lambda e: None)
    many.register("b", lambda e: None, lambda e: e["id"] != "1")
    rows = [("one", 1, k, o.value) for k, o in one.push({"id": "1", "source": "s"}).items()]
    rows += [("many", i, k, o.value) for i in (1, 2) for k, o in many.push({"id": str(i), "source": "s"}).items()]
    return spark.createDataFrame(rows, "hub string, n int, consumer string, outcome string")


@query(f"SELECT {IDS} FROM log WHERE position > 9990 UNION ALL SELECT {IDS} FROM log WHERE position > 9980")
def subscription_moved_back(spark, d):
    """A subscription that is sent back gets events again; one whose position the store hasn't reached goes on from the beginning, if it is told to."""
    from .streaming.subscriptions import FROM_BEGINNING, Subscriptions

    at = temporary(spark, "delivered")
    subs = Subscriptions(_store(spark, d), temporary(spark, "checkpoints"))
    runs = []

    def keep(batch, n):
        runs.append(f"{at}/{len(runs)}")
        batch.select("position", "id", "type", "streamid").write.parquet(runs[-1])

    try:
        subs.subscribe("s", keep, start=9990).processAllAvailable()
        subs.reposition("s", 9980).processAllAvailable()
        subs.subscribe("t", lambda batch, n: None, start=10**12, lost=FROM_BEGINNING)
        assert subs.known["t"].start == 0
    finally:
        subs.stop()
    return _ids(spark.read.schema("position long, id string, type string, streamid string").parquet(*runs))
