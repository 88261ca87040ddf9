"""Feeds as keyed state, and archives of which a batch rewrites only what it touches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from parley.sources import readers, writers
from parley.sources.buckets import LOWEST, BucketArchive, Conflict
from parley.sources.schemas import ARCHIVE, UPDATES
from parley.streaming import chats, feed


def event(n, chat=1, **more):
    """The n-th event of a chat: a new message."""
    base = {"kind": "new", "slice_id": n, "seq": 1, "peer_id": chat, "message_id": 100 + n, "date": 10, "text": f"t{n}", "state": "active", "pts": n, "pts_count": 1, "affects_state": False}
    return base | {"peer": {"peer_id": chat, "peer_type": "user", "name": f"p{n}"}} | more


class Feed:
    """A folder of files, each of which is a batch."""

    def __init__(self, spark, folder, name="feed"):
        self.spark, self.folder, self.name, self.files = spark, folder, name, 0
        (folder / name).mkdir()

    def put(self, *events):
        path = self.folder / self.name / f"{self.files:04d}.json"
        path.write_text("\n".join(map(json.dumps, events)))
        os.utime(path, (1_700_000_000 + self.files, 1_700_000_000 + self.files))
        self.files += 1

    def stream(self):
        return self.spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).json(str(self.folder / self.name))

    def run(self, archive, patience=0, checkpoint=None, name=None):
        query = chats.stream_into(self.stream(), archive, str(self.folder / (checkpoint or f"{self.name}-checkpoint")), name or self.name, patience)
        query.awaitTermination()


@pytest.fixture
def archive(spark, tmp_path):
    made = BucketArchive(spark, str(tmp_path / "archive"), bucket_rows=50)
    made.create({t: feed.empty_table(spark, t) for t in ("peers", "messages", "sync_state")})
    return made


def held(archive):
    return sorted((r.peer_id, r.message_id, r.text, r.state) for r in archive.read("messages").collect())


def state(archive):
    return {r.peer_id: (r.pts, r.uncertain) for r in archive.read("sync_state").collect()}


def messages(*numbers, chat=1):
    return [(chat, 100 + n, f"t{n}", "active") for n in numbers]


def test_events_out_of_order_wait_and_gaps_are_reported(spark, tmp_path, archive):
    source = Feed(spark, tmp_path)
    source.put(event(1), event(3), event(4))
    source.run(archive, patience=3_600_000)
    assert held(archive) == messages(1) and state(archive) == {1: (1, False)}
    source.put(event(2), event(4), event(1))  # what was missing comes, with replays
    source.run(archive, patience=3_600_000)
    assert held(archive) == messages(1, 2, 3, 4) and state(archive) == {1: (4, False)}
    assert archive.read_log("gaps").count() == 0


def test_a_gap_is_left_behind_when_its_time_is_up(spark, tmp_path, archive):
    source = Feed(spark, tmp_path)
    source.put(event(1), event(4), event(5), event(9))
    source.put(event(1, chat=2))
    source.run(archive)
    assert held(archive) == messages(1, 4, 5, 9) + messages(1, chat=2)
    assert sorted((r.peer_id, r.before, r.pts) for r in archive.read_log("gaps").collect()) == [(1, 1, 4), (1, 5, 9)]
    # too late: the chat is beyond it
    source.put(event(2))
    source.run(archive)
    assert held(archive)[:4] == messages(1, 4, 5, 9)


def test_a_chat_may_show_its_later_events_first(spark, tmp_path, archive):
    source = Feed(spark, tmp_path)
    source.put(event(4), event(3, chat=2))
    source.run(archive, patience=3_600_000)
    assert held(archive) == []
    source.put(event(1), event(2))
    source.run(archive)
    # chat 2 begins where it can be seen to begin
    assert held(archive) == messages(1, 2, 4) + messages(3, chat=2)
    assert [(r.peer_id, r.before, r.pts) for r in archive.read_log("gaps").collect()] == [(1, 2, 4)]
    assert state(archive) == {1: (4, False), 2: (3, False)}


def test_a_freeze_outlasts_restarts_until_recovery(spark, tmp_path, archive):
    source = Feed(spark, tmp_path)
    source.put(event(1), event(2, kind="unsupported", affects_state=True, message_id=None), event(3), event(1, chat=2), event(2, chat=2, kind="unsupported", message_id=None), event(3, chat=2))
    source.put(event(4), event(4, chat=2))
    source.run(archive)
    source.put(event(5))
    source.run(archive)
    assert held(archive) == messages(1) + messages(1, 3, 4, chat=2)
    assert state(archive) == {1: (1, True), 2: (4, False)}
    source.put(event(9, kind="recovered", pts=3, message_id=None, peer=None), event(6))
    source.run(archive)
    # 3 is in the snapshot that the recovery stands for
    assert held(archive) == messages(1, 4, 5, 6) + messages(1, 3, 4, chat=2)
    assert state(archive) == {1: (6, False), 2: (4, False)}
    assert sorted((r.peer_id, r.event_id) for r in archive.read_log("unsupported_events").collect()) == [(1, "1:2:1"), (2, "2:2:1")]


def test_two_feeds_and_lost_checkpoints_lose_nothing(spark, tmp_path, archive):
    one, other = Feed(spark, tmp_path, "one"), Feed(spark, tmp_path, "other")
    one.put(event(1), event(2))
    one.run(archive)
    other.put(event(1, chat=2))
    other.run(archive)
    # an edit must not be undone when the feed is read from its beginning
    one.put(event(3), event(4, kind="edit", message_id=101, text="edited", state="edited"))
    one.run(archive)
    before = held(archive)
    assert [r[1] for r in before] == [101, 102, 103, 101]
    one.run(archive, checkpoint="new", name="one again")
    assert held(archive) == before and (1, 101, "edited", "edited") in before


def test_two_feeds_into_one_versioned_archive(spark, tmp_path):
    folder = str(tmp_path / "archive")
    writers.write_archive({t: feed.empty_table(spark, t) for t in ("peers", "messages", "sync_state")}, folder, "start")
    for name, chat in (("a", 1), ("b", 2)):
        source = Feed(spark, tmp_path, name)
        source.put(event(1, chat=chat))
        for _ in range(2):
            feed.stream_apply_updates(source.stream(), folder, str(tmp_path / f"{name}-check")).awaitTermination()
    assert sorted(r.peer_id for r in readers.read_archive(spark, folder, "messages").collect()) == [1, 2]
    assert spark.read.parquet(f"{folder}/log/message_revisions").count() == 0
    assert sorted(writers.current_version(spark, folder)[1].values()) == [0, 0]


def many(spark, chats_=20, each=10):
    rows = spark.range(chats_ * each).select((F.col("id") / each).cast("long").alias("peer_id"), (F.col("id") % each).alias("message_id"), F.lit(5).cast("long").alias("date"), F.lit(3).cast("long").alias("sender_id"), F.lit("old").alias("text"), F.lit("active").alias("state"))
    return feed.empty_table(spark, "messages").unionByName(rows, allowMissingColumns=True)


def actions(spark, *events):
    rows = [{**e, "action": "apply", "number": k, "before": None, "uncertain": False} for k, e in enumerate(events)]
    last = {e["peer_id"]: {**{c: None for c in chats.COLUMNS}, "action": "state", "number": 99, "before": None, "uncertain": False, "peer_id": e["peer_id"], "pts": e["pts"]} for e in events}
    return spark.createDataFrame([*rows, *last.values()], chats.ACTIONS)


def test_a_batch_writes_the_buckets_that_it_touches(spark, tmp_path):
    archive = BucketArchive(spark, str(tmp_path / "archive"), bucket_rows=25)
    archive.create({"messages": many(spark), "peers": feed.empty_table(spark, "peers"), "sync_state": feed.empty_table(spark, "sync_state")})
    first = archive.manifest()
    buckets = first["tables"]["messages"]["buckets"]
    assert len(buckets) >= 8 and sum(b[2] for b in buckets) == 200 and max(b[2] for b in buckets) <= 25
    assert chats.commit_actions(archive, actions(spark, event(1, chat=7, message_id=3, text="new", kind="edit", state="edited"), event(2, chat=7, message_id=500, text="more")), "feed", 0)
    second = archive.manifest()
    kept = {b[1] for b in buckets} & {b[1] for b in second["tables"]["messages"]["buckets"]}
    touched = {b[1] for b in buckets} - kept
    assert 1 <= len(touched) <= 2  # 3 and 500 may lie in two buckets
    written = [f for d, _, names in os.walk(tmp_path / "archive/data/messages") for f in names if f.endswith(".parquet")]
    assert len(written) == len(buckets) + len(second["tables"]["messages"]["buckets"]) - len(kept)
    rows = archive.read("messages")
    assert rows.count() == 201 and rows.columns == [c.split()[0] for c in ARCHIVE["messages"].split(", ")]
    changed = rows.where("peer_id = 7 and message_id = 3").first()
    assert (changed.text, changed.sender_id, changed.state) == ("new", 3, "edited")  # what the event doesn't carry stays
    assert archive.read_log("message_revisions").select("text").collect()[0].text == "old"
    # the same batch again
    assert not chats.commit_actions(archive, actions(spark, event(1, chat=7, message_id=3, text="other")), "feed", 0)
    assert archive.manifest() == second
    assert {r.peer_id for r in archive.read("messages", [7, 12]).collect()} == {7, 12}
    assert len(archive.read("messages", [7]).inputFiles()) <= 3


def test_a_growing_bucket_splits(spark, archive):
    chats.commit_actions(archive, actions(spark, *(event(n) for n in range(1, 201))), "feed", 0)
    buckets = archive.manifest()["tables"]["messages"]["buckets"]
    assert len(buckets) == 4 and [b[2] for b in buckets] == [50] * 4 and [b[0][1] for b in buckets] == [101, 151, 201, 251]
    chats.commit_actions(archive, actions(spark, event(300), event(120, text="again")), "feed", 1)
    assert archive.read("messages").count() == 201
    archive.compact("messages")
    assert archive.read("messages").count() == 201 and archive.applied("feed") == 1


def test_writers_at_the_same_time(spark, archive):
    stale = archive.manifest()
    chats.commit_actions(archive, actions(spark, event(1)), "one", 0)
    with pytest.raises(Conflict):
        archive._commit(stale | {"number": stale["number"] + 1})
    real, calls = archive._commit, []

    def late(manifest):
        """Another feed commits just before."""
        calls.append(manifest["number"])
        if len(calls) == 1:
            other = BucketArchive(spark, archive.folder, 50)
            chats.commit_actions(other, actions(spark, event(1, chat=2)), "two", 0)
        real(manifest)

    archive._commit = late
    chats.commit_actions(archive, actions(spark, event(2)), "one", 1)
    assert len(calls) == 2 and held(archive) == messages(1, 2) + messages(1, chat=2)
    assert archive.manifest()["feeds"] == {"one": 1, "two": 0}


def test_keys_without_values_and_chats_between_buckets(spark, tmp_path):
    archive = BucketArchive(spark, str(tmp_path / "archive"), bucket_rows=2)
    archive.create({"sync_state": spark.createDataFrame([(k, k) for k in (10, 20, 30, 40)] + [(None, 1)], "peer_id long, pts int")})
    assert archive.manifest()["tables"]["sync_state"]["buckets"][0][0] == [LOWEST, LOWEST]
    for chat in (5, 15, 35, 99):
        assert archive.read("sync_state", [chat]).count() == 0
        archive.update({"sync_state": spark.createDataFrame([(chat,)], "peer_id long")}, lambda t, chat=chat: {"sync_state": t["sync_state"].union(spark.createDataFrame([(chat, 0)], "peer_id long, pts int"))}, "f", chat)
        assert archive.read("sync_state", [chat]).count() == 1
    assert archive.read("sync_state").count() == 9


def test_a_chats_state_only_sees_what_decides_an_events_turn():
    """The rest of an event goes through as it came, in one string."""
    from pyspark.sql import Row

    class Held(dict):
        def exists(self):
            return bool(self)

        def get(self):
            return self["value"]

        def update(self, value):
            self["value"] = value

        def iterator(self):
            return iter(self.items())

        def updateValue(self, key, value):
            self[key] = value

        def containsKey(self, key):
            return key in self

    class Handle:
        def getValueState(self, *_):
            return Held()

        getMapState = getValueState

    feed = chats.ChatFeed()
    feed.init(Handle())
    rows = [Row(kind=kind, slice_id=n, seq=n, peer_id=1, pts=n, pts_count=1, affects_state=True, rest=rest, arrived_ms=5) for n, kind, rest in ((2, "edit", '{"text":"\\"é"}'), (1, "new", "{}"), (3, "unsupported", None), (4, "new", "x"))]
    found = list(feed.handleInputRows((1,), iter(rows), None))
    assert [(r.action, r.pts, r.rest) for r in found] == [("dead", 3, None), ("apply", 1, "{}"), ("apply", 2, '{"text":"\\"é"}'), ("state", 2, None)]
    assert feed.stopped[(4, 4)] == ("new", 4, 4, 1, 4, 1, True, "x")


class Calls:
    """A state of a group, whose calls are counted."""

    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return iter(list(self.value or [])) if isinstance(self.value, list) else self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def put(self, values):
        self.calls.append("put")
        self.value = list(values)

    def appendList(self, values):
        self.calls.append("appendList")
        self.value = (self.value or []) + list(values)

    def clear(self):
        self.calls.append("clear")
        self.value = []


def group_feed():
    """A feed's group with its states, its timers, and what a batch at a time and a timer make of it."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    states, timers = {"early": Calls(), "stopped": Calls(), "places": Calls()}, set()
    states["early"].value, states["stopped"].value = [], []
    group = chats.GroupFeed()
    group.init(SimpleNamespace(getValueState=lambda name, _: states[name], getListState=lambda name, _: states[name], registerTimer=timers.add, deleteTimer=timers.remove))

    def told(rows):
        out = []
        for row in rows:
            columns = json.loads(row.actions)
            out += zip(*(columns[c] for c in ("peer_id", "action", "before", "pts")))
        return sorted(out, key=str)

    def batch(now, *events):
        columns = {c: [e.get(c) for e in events] for c in chats.FIELDS}
        return told(group.handleInputRows((0,), iter([Row(chats=0, events=json.dumps(columns), arrived_ms=now)]), None))

    def timer(at, watermark):
        found = told(group.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
        timers.discard(at)
        return found

    return states, timers, batch, timer


def test_a_group_calls_its_state_once_for_many_events():
    """A call for each event that waits cost far more than the event."""
    states, timers, batch, timer = group_feed()
    wait = [event(n, chat=chat) for chat in (1, 2, 3) for n in range(2, 5_000)]
    assert batch(5, *wait) == [(c, "state", None, None) for c in (1, 2, 3)] and timers == {5}
    assert [sum(map(len, map(json.loads, (p for (p,) in states["early"].value))))] == [len(wait)]
    found = batch(6, event(1, chat=2))
    assert len(found) == 5_000 and found[-1] == (2, "state", None, 4_999) and timers == {5}
    assert {name: state.calls for name, state in states.items()} == {"early": ["appendList", "get", "put"], "stopped": [], "places": ["get", "update"] * 2}


def test_the_chats_of_a_group_have_their_own_time():
    """A group has one timer, but what its chats wait for is left behind when each one's time is up."""
    states, timers, batch, timer = group_feed()
    assert batch(5, event(1), event(3), event(1, chat=2)) == [(1, "apply", None, 1), (1, "state", None, 1), (2, "apply", None, 1), (2, "state", None, 1)]
    assert batch(9, event(4, chat=2)) == [] and batch(12, event(1, chat=3), event(7, chat=3)) and timers == {5}
    # chats 1 and 2 at once, though the group's timer was chat 1's
    assert timer(5, 9) == [(1, "apply", None, 3), (1, "gap", 1, 3), (1, "state", None, 3), (2, "apply", None, 4), (2, "gap", 1, 4), (2, "state", None, 4)]
    assert timers == {12}
    assert timer(12, 12) == [(3, "apply", None, 7), (3, "gap", 1, 7), (3, "state", None, 7)] and not timers
    assert states["early"].value == []


def test_what_a_groups_chat_has_stopped_is_its_own():
    states, timers, batch, timer = group_feed()
    stop = {"kind": "unsupported", "affects_state": True}
    batch(5, event(1), event(2, **stop), event(3), event(1, chat=2), event(2, chat=2, **stop), event(3, chat=2))
    assert batch(6, event(4), event(2, **stop)) == []
    assert batch(7, event(9, kind="recovered", pts=2)) == [(1, "apply", None, 3), (1, "apply", None, 4), (1, "state", None, 4)]
    assert [(e[3], e[2]) for (pack,) in states["stopped"].value for e in map(tuple, json.loads(pack))] == [(2, 1), (2, 1)]
    assert batch(8, event(9, chat=2, kind="recovered", pts=1)) == [(2, "apply", None, 3), (2, "state", None, 3)]
    assert states["stopped"].value == [] and not timers


def test_a_feed_goes_on_where_an_archive_began_it(spark, tmp_path, archive):
    """The archive's chats only count for the first batch; a restart has no need of them."""
    chats.commit_actions(archive, actions(spark, event(1), event(2)), "before", 0)
    source = Feed(spark, tmp_path)
    assert chats._initial(archive, str(tmp_path / "feed-checkpoint")).count() == 1
    source.put(event(2, text="again"), event(3))
    source.run(archive, patience=3_600_000)
    assert chats._initial(archive, str(tmp_path / "feed-checkpoint")) is None
    source.put(event(5), event(4))
    source.run(archive, patience=3_600_000)
    assert held(archive) == messages(1, 2, 3, 4, 5) and state(archive) == {1: (5, False)}
