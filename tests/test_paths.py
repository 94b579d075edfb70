import random

from buildloom.operators import paths

CALLS = "build_id string, pid long, seq long, op string, fd int, dirfd int, path string"


def plain_named(rows, root):
    cwd, fds, out = {}, {}, {}
    for b, pid, seq, op, fd, dirfd, path in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        who, whole = (b, pid), None
        if path is not None:
            base = "" if path.startswith("/") else cwd.get(who, root.rstrip("/")) if dirfd is None else fds.get((*who, dirfd))
            whole = path if path.startswith("/") else None if base is None else f"{base}/{path}"
            out[b, pid, seq] = whole
        if op == "open":
            fds[(*who, fd)] = whole
        elif op == "close":
            fds.pop((*who, fd), None)
        elif op == "chdir":
            cwd[who] = whole
    return out


def test_paths_from_descriptors(spark):
    r = random.Random(6)
    rows = []
    for seq in range(900):
        op = r.choice(["open", "open", "open", "close", "chdir", "use"])
        path = None if op == "close" else r.choice(["a", "b/c", "../d", "/r", "e"]) if r.random() < 0.95 else "/x/y"
        rows.append((r.choice("xy"), r.randint(1, 3), seq, op, r.randint(3, 6) if op in ("open", "close") else None, r.choice([None, 3, 4, 5, 6]), path))
    got = {(x["build_id"], x["pid"], x["seq"]): x["path"] for x in paths.named_paths(spark.createDataFrame(rows, CALLS), "/build").collect()}
    want = plain_named(rows, "/build")
    assert got == want and None in want.values() and max(len(p or "") for p in want.values()) > 12


def plain_links(path, links):
    done, todo, n = [], [s for s in path.split("/") if s not in ("", ".")], 0
    while todo:
        s = todo.pop(0)
        if s == "..":
            done = done[:-1]
            continue
        target = links.get("/" + "/".join([*done, s]))
        if target is None:
            done.append(s)
            continue
        n += 1
        if n > paths.MOST_LINKS:
            return None
        todo = [t for t in target.split("/") if t not in ("", ".")] + todo
        done = [] if target.startswith("/") else done
    return "/" + "/".join(done)


def test_links(spark):
    r = random.Random(2)
    names = ["a", "b", "c", "d"]
    links = {}
    for _ in range(12):
        link = "/" + "/".join(r.choice(names) for _ in range(r.randint(1, 2)))
        links[link] = r.choice(["/", "", "../", "./"]) + "/".join(r.choice([*names, ".."]) for _ in range(r.randint(1, 3)))
    links = {k: v for k, v in links.items() if not any(k.startswith(o + "/") for o in links)} | {"/loop": "/loop/x", "/l1": "l2", "/l2": "/l3", "/l3": "a/../b"}
    every = ["/" + "/".join(r.choice([*names, "..", ".", "loop", "l1"]) for _ in range(r.randint(0, 6))) for _ in range(300)] + ["/", "//a//", "/..", "/l1/../x"]
    got = paths.resolved_links(spark.createDataFrame([("x", p) for p in every] + [("y", "/l1/z"), ("y", None)], "build_id string, path string"), spark.createDataFrame([("x", k, v) for k, v in links.items()], "build_id string, link string, target string")).collect()
    assert {x["path"]: x["resolved"] for x in got if x["build_id"] == "x"} == {p: plain_links(p, links) for p in every}
    assert [x["resolved"] for x in got if x["build_id"] == "y"] == ["/l1/z"]
    none = spark.createDataFrame([], "build_id string, path string")
    assert paths.resolved_links(none, spark.createDataFrame([], "build_id string, link string, target string")).count() == 0
