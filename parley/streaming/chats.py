"""Each chat's place in its feed as keyed state of a stream: order, gaps, freezes and recoveries.

A chat's events are applied in the order of (slice_id, seq), and only if their counter follows on from the last one: pts - pts_count is
the chat's pts, which is 0 at first. What comes early waits in the state. If the missing events don't come within `patience`, a
timer reports the gap and the chat goes on behind it; where no event came before, the chat begins there and nothing is reported. An unsupported event that affects state freezes the chat from its
slice on, until an event of the kind `recovered` says up to which pts a snapshot has brought the archive. Events up to the chat's pts
are replays and are dropped. The keys of the state are groups of chats.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.merge import COALESCE, merge
from ..operators.staging import staged
from ..sources.buckets import BucketArchive
from ..sources.schemas import UPDATES
from .feed import apply_ready

#: What happened to a chat. action: apply (an event whose turn it is), dead (an unsupported event), gap (before, pts, pts_count) or
#: state (the chat's pts, and whether it is uncertain); number: its place among all of the chat's actions.
ACTIONS = f"action string, number long, before long, uncertain boolean, {UPDATES}"
COLUMNS = [c.split()[0] for c in UPDATES.split(", peer struct")[0].split(", ")] + ["peer"]

#: When an event arrived: the time of its batch, which no event is behind.
ARRIVED = "arrived"

#: What decides an event's turn, and the rest of it as JSON: Python and the state pass that on as it is, which costs much less than a dozen columns and a struct.
_EVENT = "kind string, slice_id long, seq long, peer_id long, pts long, pts_count long, affects_state boolean, rest string"
FIELDS = [c.split()[0] for c in _EVENT.split(", ")]
_KIND, _SLICE, _SEQ, _PEER, _PTS, _COUNT, _AFFECTS, _REST_AT = (FIELDS.index(c) for c in ("kind", "slice_id", "seq", "peer_id", "pts", "pts_count", "affects_state", "rest"))
REST = [c for c in COLUMNS if c not in FIELDS]
_REST = ", ".join([c for c in UPDATES.split(", peer struct")[0].split(", ") if c.split()[0] in REST] + [UPDATES[UPDATES.index("peer struct") :]])

#: What is said of an event, and the event.
_SAID = f"action string, number long, before long, uncertain boolean, {_EVENT}"
SAID = [c.split()[0] for c in _SAID.split(", ")]


def _arrays(columns: str) -> str:
    """Columns as arrays."""
    return ", ".join(f"{name} array<{kind}>" for name, kind in (c.split() for c in columns.split(", ")))


#: Groups of chats. With few chats in each, calls of the state cost more than events; with many, a task holds more of them.
GROUPS = 1 << 11
#: Events of a group, and about how many characters of them, that are one row on their way into the state and out of it, and one value in it.
PACK, PACK_CHARS = 1 << 12, 1 << 20
#: Rows, and their bytes, that are packed at once.
PACK_ROWS, PACK_BYTES = 1 << 18, 1 << 26

_PLACE = "pts long, frozen_from long, number long, timer long, uncertain boolean"
_TIMER = 3
_KEY, _EARLY = "slice_id long, seq long", f"{_EVENT}, arrived_ms long"
ALL = -(1 << 63)


class ChatFeed(StatefulProcessor):
    """The state of one chat. A task holds the chat's events of one batch, and those that wait for a gap to close."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", _PLACE)
        self.early = handle.getMapState("early", _KEY, _EARLY)
        self.stopped = handle.getMapState("stopped", _KEY, _EVENT)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A chat that an archive knows goes on where the archive stands."""
        self.place.update((initialState["pts"], ALL if initialState["uncertain"] else None, 0, None, bool(initialState["uncertain"])))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._load(key)
        yield from self._take((tuple(row[c] for c in FIELDS), row["arrived_ms"]) for row in rows)

    def _take(self, events: Iterator[tuple[tuple, int]]) -> Iterator[Row]:
        """Events of a batch, with its time."""
        fresh: dict[tuple, tuple] = {}
        recovered: list[int] = []
        for event, self.now in events:
            if event[_KIND] == "recovered":
                recovered.append(ALL if event[_PTS] is None else event[_PTS])
            elif not self._replayed(event[_PTS]):
                fresh[event[_SLICE], event[_SEQ]] = event
        told = set()
        if recovered:
            # what froze the chat is settled by the snapshot; its counter still counts
            waited = {k: tuple(False if c == "affects_state" else x for c, x in zip(FIELDS, v)) for k, v in self._held(self.stopped)}
            fresh, told = waited | fresh, set(waited)
            self.stopped.clear()
            self.frozen_from = None
            if self.pts is None or max(recovered) > self.pts:
                self.pts = max(recovered)
            fresh = {k: v for k, v in fresh.items() if not self._replayed(v[_PTS])}
        yield from self._go_on(fresh, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What was waited for has not come: the gap is reported, and left behind."""
        self._load(key)
        due, self.timer, self.now = self.timer, None, timerValues.getCurrentWatermarkInMs()
        yield from self._go_on({}, set(), self.now if due is None else max(due, self.now))

    def close(self) -> None:
        pass

    def _load(self, key) -> None:
        self.chat = key[0]
        self.known = self._known()
        self.pts, self.frozen_from, self.number, self.timer, self.uncertain = self.known or (None, None, 0, None, None)

    def _known(self) -> tuple | None:
        return tuple(self.place.get()) if self.place.exists() else None

    def _keep(self, place: tuple) -> None:
        self.place.update(place)

    def _replayed(self, pts: int | None) -> bool:
        return pts is not None and self.pts is not None and pts <= self.pts

    @staticmethod
    def _held(state) -> Iterator[tuple[tuple, tuple]]:
        return ((tuple(k), tuple(v)) for k, v in state.iterator()) if state.exists() else iter(())

    @staticmethod
    def _affects(event: tuple) -> bool:
        return event[_KIND] == "unsupported" and bool(event[_AFFECTS])

    def _action(self, action: str, event: Iterable, before: int | None = None) -> Row:
        self.number += 1
        return Row(action=action, number=self.number, before=before, uncertain=self.frozen_from is not None, **dict(zip(FIELDS, event)))

    def _go_on(self, fresh: dict[tuple, tuple], told: set, until: int = ALL) -> Iterator[Row]:
        """Apply what is due of the fresh events and of those that came early, and keep the rest.

        told: those reported before. Gaps before events that arrived at `until` or earlier are left behind.
        """
        blocked = min((k[0] for k, v in fresh.items() if self._affects(v)), default=None)
        if blocked is not None and (self.frozen_from is None or blocked < self.frozen_from):
            self.frozen_from = blocked
        due = {}
        early = dict(self._held(self.early))
        held = {k: event[:-1] for k, event in early.items()}
        for k, event in sorted((held | fresh).items()):
            stop = self.frozen_from is not None and k[0] >= self.frozen_from
            if event[_KIND] == "unsupported" and k not in held and k not in told and not (stop and self.stopped.containsKey(k)):
                yield self._action("dead", event)
            if stop:
                self.stopped.updateValue(k, event)
                if k in held:
                    self.early.removeKey(k)
            else:
                due[k] = event
        waits, first = False, self.now
        for k, event in due.items():
            arrived = early[k][-1] if k in early else self.now
            pts, count = event[_PTS], event[_COUNT] or 0
            # counters begin at 0: what an unknown chat shows first may not be its beginning
            if not waits and pts is not None and pts - count > (0 if self.pts is None else self.pts):
                waits = arrived > until
                if not waits and self.pts is not None:
                    yield self._action("gap", event, before=self.pts)
            if waits:
                first = min(first, arrived)
                if k not in held:
                    self.early.updateValue(k, (*event, arrived))
                continue
            if k in held:
                self.early.removeKey(k)
            if self._replayed(pts):
                continue
            if event[_KIND] != "unsupported":
                yield self._action("apply", event)
            self.pts = pts if pts is not None else self.pts
        if waits and self.timer is None:
            self.timer = first
            self.handle.registerTimer(self.timer)
        elif not waits and self.timer is not None:
            self.handle.deleteTimer(self.timer)
            self.timer = None
        self.uncertain = self.frozen_from is not None
        if self.known is None or (self.pts, self.uncertain) != (self.known[0], self.known[4]):
            empty = [None] * len(FIELDS)
            empty[_PTS], empty[FIELDS.index("peer_id")] = self.pts, self.chat
            yield self._action("state", empty)
        self._keep((self.pts, self.frozen_from, self.number, self.timer, self.uncertain))


def _cut(events: list[tuple], rest: int) -> Iterator[list[tuple]]:
    """Lists of PACK events, or of fewer if they are long. rest: where an event's longest part stands."""
    first = size = 0
    for n, event in enumerate(events):
        size += len(event[rest] or "")
        if n + 1 - first == PACK or size >= PACK_CHARS:
            yield events[first : n + 1]
            first, size = n + 1, 0
    if first < len(events):
        yield events[first:]


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class Packs:
    """The events that a group's chats hold, in packs: JSON texts of many events each, of which the last one that has a key counts."""

    def __init__(self, state):
        self.state = state

    def enter(self) -> None:
        """Another group's turn."""
        self.old, self.new, self.anew = None, {}, False

    def turn(self, chat: int, held: bool) -> None:
        """A chat's turn. held: whether it may have events; the group's are read when such a chat's are asked for."""
        self.chat, self.held = chat, held

    def _old(self) -> dict[tuple, tuple]:
        if not self.held:
            return {}
        if self.old is None:
            self.old = {}
            for (pack,) in self.state.get():
                for event in json.loads(pack):
                    self.old.setdefault(event[_PEER], {})[event[_SLICE], event[_SEQ]] = tuple(event)
        return self.old.setdefault(self.chat, {})

    def exists(self) -> bool:
        return True

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return iter((self._old() | self.new.get(self.chat, {})).items())

    def containsKey(self, key: tuple) -> bool:
        return key in self.new.get(self.chat, ()) or key in self._old()

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.new.setdefault(self.chat, {})[key] = value

    def removeKey(self, key: tuple) -> None:
        self.new.get(self.chat, {}).pop(key, None)
        if self._old().pop(key, None) is not None:
            self.anew = True

    def clear(self) -> None:
        self.new.pop(self.chat, None)
        old = self._old()
        self.anew = self.anew or bool(old)
        old.clear()

    def leave(self) -> None:
        """Write what has changed: if events have only come, they are added and nothing else is written again."""
        left = ((self.old or {}).get(c, {}) | self.new.get(c, {}) for c in {**self.old, **self.new}) if self.anew else self.new.values()
        packs = [(_json(pack),) for pack in _cut([v for events in left for v in events.values()], _REST_AT)]
        if self.anew:
            self.state.put(packs) if packs else self.state.clear()
        elif packs:
            self.state.appendList(packs)


class NoTimers:
    """What a chat of a group has instead of timers of its own."""

    def registerTimer(self, at: int) -> None:
        pass

    deleteTimer = registerTimer


class GroupFeed(ChatFeed):
    """The state of a group of chats, each of which goes its own way as in a ChatFeed.

    Rows, calls of the state and its values cost far more than events, so they are those of a group: packs of
    its events as JSON, one value with its chats' places, one timer, which is the first of theirs. A task
    holds a group's events of one batch, and those that wait or are stopped if one of its chats asks for them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.group, self.places_state, self.handle = handle, handle.getValueState("places", "places string"), NoTimers()
        self.early, self.stopped = (Packs(handle.getListState(name, "events string")) for name in ("early", "stopped"))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Chats that an archive knows go on where the archive stands."""
        places = {c["peer_id"]: (c.get("pts"), ALL if c["uncertain"] else None, 0, None, c["uncertain"]) for c in json.loads(initialState["known"])}
        self.places_state.update((_json(list(places.items())),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._enter()
        chats: dict[int, list] = {}
        for row in rows:
            events, now = json.loads(row["events"]), row["arrived_ms"]
            for event in zip(*(events[c] for c in FIELDS)):
                chats.setdefault(event[_PEER], []).append((event, now))
        actions = []
        for chat, events in chats.items():
            self._load((chat,))
            actions += self._take(events)
        return self._leave(key, actions)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._enter()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        due = max(expired, timerValues.getCurrentWatermarkInMs())
        actions = []
        for chat, place in list(self.places.items()):
            if place[_TIMER] is not None and place[_TIMER] <= due:
                actions += super().handleExpiredTimer((chat,), timerValues, expiredTimerInfo)
        return self._leave(key, actions, expired)

    def _enter(self) -> None:
        held = self.places_state.get()
        self.places = {chat: tuple(place) for chat, place in json.loads(held[0])} if held else {}
        self.first = self._first()
        self.early.enter()
        self.stopped.enter()

    def _first(self) -> int | None:
        return min((place[_TIMER] for place in self.places.values() if place[_TIMER] is not None), default=None)

    def _known(self) -> tuple | None:
        return self.places.get(self.chat)

    def _keep(self, place: tuple) -> None:
        self.places[self.chat] = place

    def _load(self, key) -> None:
        super()._load(key)
        # a timer runs as long as events wait, and only a frozen chat stops any
        self.early.turn(self.chat, self.timer is not None)
        self.stopped.turn(self.chat, self.frozen_from is not None)

    def _action(self, action: str, event: Iterable, before: int | None = None) -> tuple:
        self.number += 1
        return (action, self.number, before, self.frozen_from is not None, *event)

    def _leave(self, key, actions: list[tuple], expired: int | None = None) -> Iterator[Row]:
        """expired: a timer that is gone by itself."""
        self.early.leave()
        self.stopped.leave()
        first = self._first()
        if first != self.first:
            if self.first is not None and self.first != expired:
                self.group.deleteTimer(self.first)
            if first is not None:
                self.group.registerTimer(first)
        self.places_state.update((_json(list(self.places.items())),))
        return (Row(chats=key[0], actions=_json(dict(zip(SAID, zip(*pack))))) for pack in _cut(actions, -1))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events as rows of the events of a group, PACK at most."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACK_ROWS or sum(b.nbytes for b in held) >= PACK_BYTES:
            yield _pack(held)
            held = []
    if any(b.num_rows for b in held):
        yield _pack(held)


def _pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches)
    rows = rows.take(pc.sort_indices(rows["chats"])).combine_chunks().to_batches()[0]
    groups = rows["chats"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    # a group's further packs
    place = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
    first = np.flatnonzero(place % PACK == 0)
    offsets = pa.array(np.append(first, len(groups)), pa.int32())
    return pa.RecordBatch.from_pydict({"chats": pa.array(groups[first])} | {c: pa.ListArray.from_arrays(offsets, rows[c]) for c in rows.schema.names if c != "chats"})


def ordered_events(updates: DataFrame, patience_ms: int = 60_000, known: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """The ACTIONS of a streamed feed. known: peer_id, pts, uncertain of chats that an archive has already.

    groups: of chats, which share a state; a feed must keep to its number. Events carry UPDATES; those without a counter (pts) are applied in the order of their slices as they come. An
    event with the chat's slice_id and seq of one that waits takes its place. Time is that of the batches, so no event is too late:
    a gap is left behind in the first batch that begins patience_ms after the one in which it showed.
    """
    group = F.pmod(F.xxhash64("peer_id"), F.lit(groups)).cast("int").alias("chats")
    rows = updates.where("peer_id is not null").select(group, *FIELDS[:-1], F.to_json(F.struct(*REST)).alias("rest"))
    packs = rows.repartition("chats").mapInArrow(_packed, f"chats int, {_arrays(_EVENT)}").select("chats", F.to_json(F.struct(*FIELDS)).alias("events"), F.current_timestamp().alias(ARRIVED))
    packs = packs.withWatermark(ARRIVED, f"{patience_ms} milliseconds").withColumn("arrived_ms", F.unix_millis(ARRIVED))
    initial = None
    if known is not None:
        one = F.struct("peer_id", F.col("pts").cast("long").alias("pts"), F.coalesce("uncertain", F.lit(False)).alias("uncertain"))
        initial = known.where("peer_id is not null").groupBy(group).agg(F.to_json(F.collect_list(one)).alias("known")).groupBy("chats")
    actions = packs.groupBy("chats").transformWithState(GroupFeed(), "chats int, actions string", "Update", "EventTime", initial)
    said = actions.select(F.from_json("actions", _arrays(_SAID), {"mode": "FAILFAST"}).alias("said")).select(F.inline(F.arrays_zip(*(F.col(f"said.{c}").alias(c) for c in SAID))).alias(*SAID))
    return said.withColumn("rest", F.from_json("rest", _REST)).select("action", "number", "before", "uncertain", *(F.col(c if c in FIELDS else f"rest.{c}").alias(c) for c in COLUMNS))


def start(stream, checkpoint: str, trigger: dict | None):
    """Start a stream with state, whose store must be the one that keeps lists, maps and timers."""
    conf, key = SparkSession.active().conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(key, before) if before else conf.unset(key)


def commit_actions(archive: BucketArchive, actions: DataFrame, stream: str, batch: int) -> bool:
    """Apply a batch of actions to the buckets that hold its chats' rows; whether the archive has changed.

    A batch of a stream that the archive has applied already changes nothing.
    """
    if archive.applied(stream) >= batch:
        return False
    events = actions.where("action = 'apply'")
    state = actions.where("action = 'state'").groupBy("peer_id").agg(F.max_by(F.struct("pts", "uncertain"), "number").alias("s")).select("peer_id", F.col("s.pts").cast("int").alias("pts"), F.col("s.uncertain").alias("uncertain"))
    seen = {r[0] for r in actions.select("action").distinct().collect()}
    if "dead" in seen:
        archive.append("unsupported_events", actions.where("action = 'dead'").select(F.concat_ws(":", "peer_id", "slice_id", "seq").alias("event_id"), "peer_id", "kind", "affects_state"), stream, batch)
    if "gap" in seen:
        archive.append("gaps", actions.where("action = 'gap'").select("peer_id", "before", "pts", "pts_count"), stream, batch)
    keys = {
        "sync_state": state.select("peer_id"),
    } | ({
        "messages": events.where("message_id is not null").select("peer_id", "message_id").distinct(), "peers": events.where("peer is not null").select("peer.peer_id").distinct(),
    } if "apply" in seen else {})

    def changed(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        after = {}
        if "apply" in seen:
            after = apply_ready(tables, events, "number")
            archive.append("message_revisions", after.pop("message_revisions"), stream, batch)
        return after | {"sync_state": merge(tables["sync_state"], state, ["peer_id"], {"pts": COALESCE})}

    archive.update(keys, changed, stream, batch)
    return True


def _initial(archive: BucketArchive, checkpoint: str) -> DataFrame | None:
    """The archive's chats, for a feed's first batch. Spark hands every group over on its own where there is such a table, so there is none if it is empty or the batch is done."""
    path = archive.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/[0-9]*")
    done = path.getFileSystem(archive.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return None if done or not archive.manifest()["tables"]["sync_state"]["buckets"] else archive.read("sync_state")


def stream_into(updates: DataFrame, archive: BucketArchive, checkpoint: str, stream: str, patience_ms: int = 60_000, trigger: dict | None = None):
    """Start a query that applies a feed, known by the name `stream`, to an archive that other feeds may write to as well.

    Chats start from the archive's own state, so a feed whose checkpoint was lost can be read again from its beginning: give it a new name.
    Feeds that write at the same time must not share chats.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        if archive.applied(stream) < batch_id:
            commit_actions(archive, staged(batch), stream, batch_id)

    return start(ordered_events(updates, patience_ms, _initial(archive, checkpoint)).writeStream.outputMode("update").foreachBatch(one), checkpoint, trigger)
