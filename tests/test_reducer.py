import json
import random
from datetime import datetime, timedelta

import pytest

from buildloom.operators.reducer import LOG, reduce_log
from buildloom.plans import reports
from buildloom.plans.model import from_triples
from buildloom.streaming.reducer import Build, Cached, reduce_stream

COLS = [c.strip().split()[0] for c in LOG.split(",")]
T0 = datetime(2026, 5, 30, 10)


def log(*events, build="b"):
    out = []
    for i, e in enumerate(events):
        e = {"build_id": build, "seq": i, "ts": T0 + timedelta(seconds=i), "op": "exit", "rval": 0} | e
        out.append(tuple(e.get(c) for c in COLS))
    return out


def use(pid, path, digest, flags=0, fd=3, **more):
    return {"pid": pid, "syscall": "openat", "path": path.rsplit("/", 1)[-1], "abspath": path, "hash": digest, "flags": flags, "fd": fd} | more


def exe(pid, path, digest, *args, **more):
    return {"pid": pid, "syscall": "execve", "path": path, "abspath": path, "hash": digest, "cmdline": list(args)} | more


def close(pid, digest, fd=3):
    return {"pid": pid, "syscall": "close", "fd": fd, "hash": digest}


def fork(pid, child):
    return {"pid": pid, "syscall": "clone", "child_pid": child, "rval": child}


def move(pid, a, digest, b):
    e = {"pid": pid, "syscall": "rename", "path": a, "abspath": a, "hash": digest, "new_path": b, "new_abspath": b}
    return [e | {"op": "entry", "rval": None}, e]


def gone(pid):
    return {"pid": pid, "op": "exited", "rval": None}


STORY = [
    exe(10, "/usr/bin/make", "m", "make", "-j2", env=["A=1"]), {"pid": 11, "op": "stop", "rval": None}, fork(10, 11), exe(11, "/bin/sh", "s", "sh", "-c", "cc a.c"), exe(11, "/usr/libexec/cc1", "c", "cc1", "a.c"),
    use(11, "/src/a.c", "h1"), use(11, "/src/a.c", "h1"), use(11, "/none", "x", rval=-2), use(11, "/src/a.o", None, 577), close(11, "h2"), gone(11),
    fork(10, 12), use(12, "/src/a.o", "h2"), use(12, "/src/a.c", "h1"), use(12, "/lib/x", None, 2), use(12, "/lib/y", None, 1), close(12, "h4"), close(12, "h3"), close(12, "h9"), gone(12),
    fork(10, 11), exe(11, "/usr/bin/ld", "l", "ld"), use(11, "/lib/x", "h3"), use(11, "/tmp/never", None, 65), *move(11, "/lib/x", "h3", "/lib/z"), use(11, "/lib/z", "h3"), *[e | {"rval": -1} if e["op"] == "exit" else e for e in [{"op": "exit"} | m for m in move(11, "/q", "hq", "/r")]],
    use(11, "/p", "hp", 3), {"pid": 11, "syscall": "creat", "path": "n", "abspath": "/n", "hash": None, "fd": 5}, close(11, "hn", 5), gone(11), gone(10),
]


def facts(g, build=None):
    """What a graph says of a build, or of all."""
    rows = lambda df: [r for r in df.collect() if build in (None, r["build_id"])]
    pairs = lambda df, *to: sorted((r["build_id"], r["pid_node"], *(r[c] for c in to)) for r in rows(df))
    return {
        "file": sorted(((r["build_id"], int(r["file_node"][2:])), (r["file_node"], r["abspath"], r["hash"])) for r in rows(g.file)),
        "process": sorted((r["build_id"], r["pid_node"], r["typed"], r["end_ts"]) for r in rows(g.process)),
        **{n: pairs(getattr(g, n), "file_node") for n in ("reads", "writes", "executable")},
        "creates": pairs(g.creates, "child_node"), "rename": pairs(g.rename, "rename_node", "from_node", "to_node"),
        "cmd": pairs(g.process_cmd, "cmd"), "env": pairs(g.process_env, "entry"), "start": pairs(g.process_start, "start_ts"),
    }


def by_steps(spark, rows):
    """The online reducer's triples, event by event."""
    builds, out = {}, []
    from collections import defaultdict, namedtuple

    class State(dict):
        """A map state, as far as the reducer uses one."""

        getValue, containsKey, removeKey, updateValue = dict.get, dict.__contains__, dict.pop, dict.__setitem__

    Event = namedtuple("Event", COLS)
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        e = Event(*r)
        counts, states = builds.setdefault(e.build_id, ({"p": 0, "f": 0, "rename": 0, "live": 0}, defaultdict(State)))
        build = Build(counts, lambda n: Cached(states[n]))  # made anew from what the last event left
        out += [(e.build_id, *t) for t in build.step(e)]
        build.save()
    return from_triples(spark.createDataFrame(out, "build_id string, s string, p string, o string, o_kind string"))


def test_story(spark):
    g = reduce_log(spark.createDataFrame(log(*STORY), LOG))
    f = facts(g)
    assert f == facts(by_steps(spark, log(*STORY)))
    files = {n: (a, h) for _, (n, a, h) in f["file"]}
    assert list(files.values()).count(("/src/a.c", "h1")) == 1 and ("/src/a.o", "h2") in files.values() and ("/tmp/never", None) in files.values()
    a_o = next(n for n, x in files.items() if x == ("/src/a.o", "h2"))
    assert ("b", ":p1", a_o) in f["writes"] and ("b", ":p2", a_o) in f["reads"]
    assert len(f["process"]) == 4 and {p: t for _, p, t, _ in f["process"]}[":p2"] is False
    assert ("/q", "hq") in files.values() and ("/r", "hq") not in files.values() and len(f["rename"]) == 1
    assert ("b", ":p1", "sh -c 'cc a.c'") in f["cmd"]
    assert reports.untyped_processes(g).count() == 1


def test_random_logs_agree(spark):
    r = random.Random(7)
    rows = []
    for b in range(4):
        live, events, free = [100], [exe(100, "/m", "m", "m")], 101
        for _ in range(120):
            pid, path, fd = r.choice(live), f"/d/{r.randint(0, 5)}", r.randint(3, 5)
            kind = r.choice(["read", "read", "write", "rdwr", "close", "close", "fork", "exec", "move", "exit", "fail"])
            h = r.choice([None, "h1", "h2", "h3"])
            if kind in ("read", "write", "rdwr"):
                events.append(use(pid, path, h, {"read": 0, "write": 1, "rdwr": 2}[kind], fd))
            elif kind == "close":
                events.append(close(pid, h, fd))
            elif kind == "fork":
                child = r.choice([x for x in range(101, 106) if x not in live] or [free])
                free = max(free, child) + 1
                order = [fork(pid, child), {"pid": child, "op": "stop", "rval": None}]
                r.shuffle(order)
                events += order
                live.append(child)
            elif kind == "exec":
                events.append(exe(pid, path, h, "x", "y z"))
            elif kind == "move":
                events += move(pid, path, h, f"/d/{r.randint(0, 5)}")
            elif kind == "exit" and len(live) > 1:
                live.remove(pid)
                events.append(gone(pid))
            elif kind == "fail":
                events.append(use(pid, path, h, 1, fd, rval=-1))
        rows += log(*events, build=f"b{b}")
    got, want = facts(reduce_log(spark.createDataFrame(rows, LOG))), facts(by_steps(spark, rows))
    for name in want:
        assert got[name] == want[name], name


def test_stream_equals_batch(spark, tmp_path):
    rows = log(*STORY) + log(*STORY, build="c")
    df = spark.createDataFrame(rows, LOG)
    for i in range(3):  # three files, three micro-batches, in order
        df.where(f"seq >= {i * 15} and seq < {i * 15 + 15 if i < 2 else 1000}").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    import glob
    import os
    import shutil

    os.makedirs(tmp_path / "all")
    for i in range(3):
        for f in glob.glob(str(tmp_path / f"in{i}" / "*.parquet")):
            to = tmp_path / "all" / f"{i}.parquet"
            shutil.copy(f, to)
            os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    q = reduce_stream(stream).writeStream.outputMode("append").format("memory").queryName("reduced").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    g = from_triples(spark.createDataFrame(spark.table("reduced").collect(), "build_id string, s string, p string, o string, o_kind string"))
    want = reduce_log(df)
    assert facts(g) == facts(want)


def run_stream(spark, tmp_path, files, **options):
    """The online reducer over lists of rows, a file and a micro-batch for each."""
    import os

    (tmp_path / "in").mkdir()
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        part = next(p for p in (tmp_path / f"part{i}").iterdir() if p.suffix == ".parquet")
        part.rename(tmp_path / "in" / f"{i:03d}.parquet")
        os.utime(tmp_path / "in" / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    triples = reduce_stream(stream, **options)
    writer = triples.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    if options.get("patience") is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:  # runs until it is stopped
        q = writer.trigger(processingTime="500 milliseconds").start()
        q.awaitTermination(25)
        q.stop()
    return from_triples(spark.read.parquet(str(tmp_path / "out")))


def test_stream_out_of_order(spark, tmp_path):
    """Events dealt to batches in any order, some twice, give what they give in order."""
    r = random.Random(3)
    rows = log(*STORY) + log(*STORY, build="c")
    dealt = rows + r.sample(rows, 9)
    r.shuffle(dealt)
    files = [dealt[i::7] for i in range(7)]
    assert facts(run_stream(spark, tmp_path, files, dense=True)) == facts(reduce_log(spark.createDataFrame(rows, LOG)))


def test_stream_gives_up_on_what_is_missing(spark, tmp_path):
    """An event that never comes holds up the others until the timer says that it won't come; then the log goes on without it."""
    rows = log(*STORY)
    lost = [x for x in rows if x[1] != 6]
    tail = log(*STORY[:4], build="z")
    got = run_stream(spark, tmp_path, [lost[:20], lost[20:], tail[:2], tail[2:], []], dense=True, patience=1)
    assert facts(got, "b") == facts(reduce_log(spark.createDataFrame(lost, LOG)), "b")


@pytest.mark.parametrize("name", ["stats", "timeline", "tree", "headers"])
def test_cli(spark, tmp_path, capsys, name):
    import golden

    from buildloom import cli
    from buildloom.sources import turtle

    p = tmp_path / "pkg-build.out"
    p.write_text(turtle.header() + "\n" + "\n".join(golden.lines()) + "\n", encoding="utf-8")
    assert cli.main([str(p), "-q", name], spark) == 0
    out = capsys.readouterr().out
    assert "160 троек" in out and "═" in out
    if name == "stats":
        assert cli.main([str(p), "--report", str(tmp_path / "r.md"), "--quiet"], spark) == 0
        text = (tmp_path / "r.md").read_text()
        assert text.startswith("# Build Report: pkg\n") and "| `libx.so.1` | `0004` |" in text and "### Исполняемые файлы (4)" in text
        assert cli.main([str(p), "--sparql", "SELECT ?p WHERE { ?p b:creates ?c }"], spark) == 0
        assert cli.main([str(tmp_path / "missing")], spark) == 1


def test_record(spark, tmp_path, sf_dir, capsys):
    """A log in, a Turtle file out; several builds make a folder."""
    from buildloom import record
    from buildloom.sources import projection, turtle

    log = projection.event_log(spark.read.parquet(f"{sf_dir}/events.parquet"))
    log.where("build_id = 'b1'").write.json(str(tmp_path / "one"))
    log.where("build_id in ('b1', 'b2')").write.json(str(tmp_path / "two"))
    assert record.main([], spark) == record.USAGE and "missing log" in capsys.readouterr().err
    assert record.main(["-o", str(tmp_path / "x-build.out"), str(tmp_path / "one")], spark) == 0
    assert record.main(["-o", str(tmp_path / "out"), str(tmp_path / "two")], spark) == 0
    want = reduce_log(log.where("build_id = 'b1'")).triples().distinct().count()
    assert turtle.read_turtle(spark, str(tmp_path / "x-build.out")).count() == want
    assert (tmp_path / "out" / "build_id=b1").is_dir() and (tmp_path / "out" / "build_id=b2").is_dir()


def test_sorting_in_runs(monkeypatch):
    """More events than are sorted at once come in order, those of one seq as they came, and few are held."""
    from buildloom.streaming import reducer

    monkeypatch.setattr(reducer, "RUN", 100)
    monkeypatch.setattr(reducer, "BLOCK", 7)
    events = [(random.Random(3).randint(0, 5) + i * 7919 % 1009, f"e{i}") for i in range(1050)]
    assert list(reducer.ordered(iter(events))) == sorted(events, key=lambda e: e[0])
    assert list(reducer.ordered(iter(events[:50]))) == sorted(events[:50], key=lambda e: e[0])


def test_waiting_events_are_kept_in_blocks(monkeypatch):
    """What comes too early makes a state entry for a block of events, not one each, and only blocks that are due are read."""
    from buildloom.streaming import reducer

    class State(dict):
        def updateValue(self, key, value):
            self[key], self.writes = value, getattr(self, "writes", 0) + 1

        getValue, removeKey = dict.get, dict.pop

    class Steps:
        def step(self, e):
            return [(e.n,)]

    monkeypatch.setattr(reducer, "BLOCK", 10)
    r = reducer.Reducer(True, None)
    r.waiting = State()
    counts, seen, seqs = {"next": 0, "waiting": [], "blocks": 0}, [], list(range(400))
    random.Random(5).shuffle(seqs)
    for i in range(0, 400, 100):
        batch = sorted((n, json.dumps({"n": n})) for n in [*seqs[i : i + 100], *seqs[:20]])
        seen += [n for (n,) in r.take(counts, Steps(), iter(batch))]
    assert seen == list(range(400)) and not r.waiting and not counts["waiting"]
    assert r.waiting.writes <= 60


def test_rows_are_numbered_where_they_were_sorted(spark):
    """Null keys too; the rows don't move again to be numbered."""
    from buildloom.operators.events import numbered

    rows = [(k, i * 7919 % 1009) for k in ("a", "b", None) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "k string, n long"), ("k",), ("n",))
    want = {(k, n, i) for k in ("a", "b", None) for i, n in enumerate(sorted(n for x, n in rows if x == k))}
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan


def test_stream_state_has_few_partitions(spark, tmp_path):
    """A batch doesn't start Python and commit state for many partitions of few builds; the session's setting stays."""
    from buildloom.log_queries import _counted

    spark.createDataFrame(log(*STORY), LOG).write.parquet(str(tmp_path / "in"))
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        got = _counted(reduce_stream(spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))), str(tmp_path / "at"))
        assert got.count() > 5 and spark.conf.get("spark.sql.shuffle.partitions") == "30"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)
    assert sum(p.name.isdigit() for p in (tmp_path / "at" / "state" / "state" / "0").iterdir()) <= 2 * spark.sparkContext.defaultParallelism
