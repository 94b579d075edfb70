"""The online reducer: a stream of system-call events to triples, with state for each build.

A build's processes share one file cache, so its events are one key's; builds spread over the cluster. What a build knows is
kept in map states: live processes and their open files by process id, the newest version of a file by path and content, the
source of a rename that is under way. A batch reads and writes the entries that its events touch, not the build's whole state.

Events may come in any order if they are numbered from 0 without a gap in each build (dense): what comes too early waits in
a map state, in blocks of events that lie next to each other, until what is before it has come; what comes again is passed
over. So what a log yields doesn't depend on how it is cut into batches or dealt to them. Other logs are put in the order of
seq within each batch. However many events of a build a batch holds, a task keeps a bounded number of them: they are sorted in
runs in a temporary file and merged, and triples leave in blocks.

A query that runs on and on is given patience: then a timer says when a missing event isn't waited for any more, and the
state of a build that ended with its last live process goes once it has been idle for as long. A bounded query has none, as
timers keep a query going.
"""

from __future__ import annotations

import heapq
import json
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, islice
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.scalar import CMDLINE_BYTES, format_time
from ..operators.reducer import EXECS, FORKS, OPENS, RENAMES, WRITE_CREATE
from ..plans.model import TRIPLES
from ..storage import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIME = "%Y-%m-%dT%H:%M:%SZ"
#: What of an event travels and waits, as a JSON text.
FIELDS = ("pid", "op", "syscall", "fd", "flags", "path", "abspath", "new_path", "new_abspath", "hash", "child_pid", "cmdline", "env", "rval")
#: Events that are sorted at once, events of a block (in a sorted run, in the state), triples of a block.
RUN, BLOCK, OUT = 50_000, 500, 10_000


def blocks(rows: Iterable, n: int) -> Iterator[list]:
    rows = iter(rows)
    while part := list(islice(rows, n)):
        yield part


def ordered(events: Iterator[tuple[int, str]]) -> Iterator[tuple[int, str]]:
    """events (seq, text) by seq, those of one seq as they come. Of more than RUN, all but a block of each run are in a file."""
    first = list(islice(events, RUN))
    if len(first) < RUN:
        yield from sorted(first, key=lambda e: e[0])
        return
    with tempfile.TemporaryFile() as f:
        runs = []
        for run in chain([first], blocks(events, RUN)):
            run.sort(key=lambda e: e[0])
            places = []
            for part in blocks(run, BLOCK):
                places.append(f.tell())
                pickle.dump(part, f)
            runs.append(places)
        first = run = part = None  # what is in the file needn't be held

        def read(places: list[int]) -> Iterator[tuple[int, str]]:
            for at in places:
                f.seek(at)
                yield from pickle.load(f)

        yield from heapq.merge(*map(read, runs), key=lambda e: e[0])


class Event(SimpleNamespace):
    """An event's fields; one that its text leaves out is null."""

    ts = pid = op = syscall = fd = flags = path = abspath = new_path = new_abspath = hash = child_pid = cmdline = env = rval = None


def event(text: str, read=json.JSONDecoder().raw_decode) -> Event:
    return Event(**read(text)[0])


def moment(ts) -> str:
    return ts if isinstance(ts, str) else ts.strftime(TIME)


def rendered(args: list[str]) -> str | None:
    """As functions.scalar.command_line has it."""
    ends = list(accumulate(len(a.encode()) + 1 for a in args))
    whole = [e for e in ends if e <= CMDLINE_BYTES]
    more = whole and len(whole) < len(args) and whole[-1] < CMDLINE_BYTES
    return " ".join(f"'{a}'" if " " in a else a for a in args[: len(whole)]) + (" " if more else "") if args else None


class Cached:
    """A map state as a dictionary: entries are read when they are first asked for and written back once, by save()."""

    def __init__(self, state=None):
        self.state, self.held, self.changed = state, {}, set()

    def get(self, key: str):
        if key not in self.held:
            found = self.state.getValue((key,)) if self.state is not None and self.state.containsKey((key,)) else None
            self.held[key] = None if found is None else json.loads(found[0])
        return self.held[key]

    def put(self, key: str, value) -> None:
        self.held[key] = value
        self.changed.add(key)

    def pop(self, key: str):
        value = self.get(key)
        if value is not None:
            self.put(key, None)
        return value

    def save(self) -> None:
        for key in self.changed:
            value = self.held[key]
            if value is not None:
                self.state.updateValue((key,), (json.dumps(value),))
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))
        self.changed = set()


class Build:
    """What a build's reducer remembers: live processes by pid, their open files, the newest version of (path, content)."""

    def __init__(self, counts: dict[str, int] | None = None, maps: Callable[[str], Cached] = lambda name: Cached()):
        self.counts = counts or {"p": 0, "f": 0, "rename": 0, "live": 0}
        self.nodes, self.open, self.cache, self.moving = (maps(n) for n in ("nodes", "open", "cache", "moving"))

    def save(self) -> None:
        for m in (self.nodes, self.open, self.cache, self.moving):
            m.save()

    def fresh(self, kind: str) -> str:
        n = self.counts[kind]
        self.counts[kind] = n + 1
        return f"_:rename{n}" if kind == "rename" else f":{kind}{n}"

    def process(self, pid: int) -> str:
        key = str(pid)
        if self.nodes.get(key) is None:
            self.nodes.put(key, self.fresh("p"))
            self.counts["live"] += 1
        return self.nodes.get(key)

    def described(self, node: str, path, abspath, digest) -> list[tuple]:
        out = [(node, "a", "b:file", "iri"), (node, "b:name", path, "literal"), (node, "b:abspath", abspath, "literal")]
        return out + ([(node, "b:hash", digest, "literal")] if digest is not None else [])

    def version(self, e) -> tuple[str, list[tuple]]:
        """The newest known version of what is read, executed or moved, or a new one."""
        key = json.dumps([e.abspath, e.hash])
        if (node := self.cache.get(key)) is not None:
            return node, []
        node = self.fresh("f")
        self.cache.put(key, node)
        return node, self.described(node, e.path, e.abspath, e.hash)

    def step(self, e) -> list[tuple]:
        """Triples (s, p, o, kind) that an event gives."""
        if e.op == "exited":
            node = self.nodes.pop(str(e.pid))
            if node is None:
                return []
            self.counts["live"] -= 1
            self.moving.pop(str(e.pid))
            self.open.pop(str(e.pid))
            return [(node, "b:end", moment(e.ts), "literal")]
        node = self.process(e.pid)
        out = [(node, "b:env", x, "literal") for x in (e.env if e.env is not None else [])]
        if e.op == "entry" and e.syscall in RENAMES and e.abspath is not None:
            source, made = self.version(e)
            self.moving.put(str(e.pid), [source, e.hash])
            return out + made
        if e.op != "exit" or e.rval is None or e.rval < 0:
            return out
        if e.syscall in OPENS:
            mode = (WRITE_CREATE if e.syscall == "creat" else int(e.flags)) & 3
            if mode == 0:
                file, made = self.version(e)
                return out + made + [(node, "b:reads", file, "iri")]
            if mode in (1, 2):
                file = self.fresh("f")
                held = self.open.get(str(e.pid)) or {}
                held.setdefault(str(e.fd), []).append([file, e.abspath])
                self.open.put(str(e.pid), held)
                edges = ["b:reads", "b:writes"] if mode == 2 else ["b:writes"]
                return out + self.described(file, e.path, e.abspath, None) + [(node, p, file, "iri") for p in edges]
        elif e.syscall == "close":
            held = self.open.get(str(e.pid)) or {}
            if stack := held.get(str(e.fd)):
                file, abspath = stack.pop()
                self.open.put(str(e.pid), held)
                self.cache.put(json.dumps([abspath, e.hash]), file)
                return out + ([(file, "b:hash", e.hash, "literal")] if e.hash is not None else [])
        elif e.syscall in EXECS:
            file, made = self.version(e)
            out += [(node, "a", "b:process", "iri"), (node, "b:start", moment(e.ts), "literal")]
            if e.cmdline is not None:
                cmd = rendered(list(e.cmdline))
                out += [(node, "b:cmd", cmd, "literal")] if cmd is not None else []
            return out + made + [(node, "b:executable", file, "iri")]
        elif e.syscall in RENAMES and (moved := self.moving.pop(str(e.pid))) is not None:
            source, digest = moved
            target, name = self.fresh("f"), self.fresh("rename")
            edges = [(node, "b:rename", name, "bnode"), (name, "b:rename-from", source, "iri"), (name, "b:rename-to", target, "iri")]
            return out + self.described(target, e.new_path, e.new_abspath, digest) + edges
        elif e.syscall in FORKS:
            return out + [(node, "b:creates", self.process(int(e.child_pid)), "iri")]
        return out


class Reducer(StatefulProcessor):
    """dense: events are numbered from 0 in each build, and taken in that order whatever they come in. patience: milliseconds
    after which a missing event is given up and an ended build's state goes; None: never."""

    def __init__(self, dense: bool, patience: int | None):
        self.dense, self.patience = dense, patience

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "saved string")
        self.maps = {n: handle.getMapState(n, "key string", "saved string") for n in ("nodes", "open", "cache", "moving")}
        self.waiting = handle.getMapState("blocks", "block long", "events binary")

    def saved(self) -> dict:
        """Numbers given so far, live processes, the next seq, and the blocks of events that wait: first seq and key of each."""
        return json.loads(self.counts.get()[0]) if self.counts.exists() else {"p": 0, "f": 0, "rename": 0, "live": 0, "next": 0, "waiting": [], "blocks": 0}

    def take(self, counts: dict, build: Build, fresh: Iterator[tuple[int, str]]) -> Iterator[tuple]:
        """Triples of the next events, among those that have come (by seq) and those that wait, up to the first that is missing.
        What is left is kept. Only blocks that begin at or before the next event are read."""
        held: dict[int, str] = {}
        front = next(fresh, None)
        while True:
            seq = counts["next"]
            while counts["waiting"] and counts["waiting"][0][0] <= seq:
                _, key = heapq.heappop(counts["waiting"])
                held |= {n: text for n, text in pickle.loads(self.waiting.getValue((key,))[0]) if n >= seq}
                self.waiting.removeKey((key,))
            text = held.pop(seq, None)
            while front is not None and front[0] <= seq:
                text = front[1] if text is None and front[0] == seq else text
                front = next(fresh, None)
            if text is None:
                break
            yield from build.step(event(text))
            counts["next"] = seq + 1
        rest = chain([front], fresh) if front is not None else ()
        for part in blocks(heapq.merge(sorted(held.items()), rest, key=lambda e: e[0]), BLOCK):
            self.waiting.updateValue((counts["blocks"],), (pickle.dumps(list(dict(part).items())),))
            heapq.heappush(counts["waiting"], [part[0][0], counts["blocks"]])
            counts["blocks"] += 1

    def run(self, build_id: str, counts: dict, events: Iterator[tuple[int, str]], now: int) -> Iterator[pd.DataFrame]:
        """Triples that the events give; then the state is kept, and timers ask to be called again if something is missing or
        the build is over."""
        build = Build(counts, lambda n: Cached(self.maps[n]))
        triples = self.take(counts, build, events) if self.dense else (t for _, text in events for t in build.step(event(text)))
        for part in blocks(triples, OUT):
            yield pd.DataFrame([(build_id, *t) for t in part], columns=["build_id", "s", "p", "o", "o_kind"])
        build.save()
        self.counts.update((json.dumps(counts),))
        if self.patience is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if counts["waiting"] or not counts["live"]:
            self.handle.registerTimer(now + self.patience)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = 0 if self.patience is None else timerValues.getCurrentProcessingTimeInMs()
        yield from self.run(key[0], self.saved(), ordered(e for x in rows for e in zip(x["seq"].tolist(), x["event"].tolist())), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counts = self.saved()
        if counts["waiting"]:  # what is missing is given up
            counts["next"] = counts["waiting"][0][0]
            yield from self.run(key[0], counts, iter(()), timerValues.getCurrentProcessingTimeInMs())
        elif not counts["live"]:
            for state in (self.counts, self.waiting, *self.maps.values()):
                state.clear()

    def close(self) -> None:
        pass


def reduce_stream(log: DataFrame, dense: bool = False, patience: int | None = None) -> DataFrame:
    """Triples of a streaming (or batch) log, appended as events come; a set only after distinct. The session's state store
    becomes RocksDB, which map states and timers need."""
    spark = log.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    said = F.to_json(F.struct(format_time("ts").alias("ts"), *FIELDS))
    return log.select("build_id", "seq", said.alias("event")).groupBy("build_id").transformWithStateInPandas(Reducer(dense, patience), TRIPLES, "append", "none" if patience is None else "processingTime")
