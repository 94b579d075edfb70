import random

import pytest
from pyspark.sql import functions as F

from buildloom.functions import scalar as fn
from buildloom.operators import auxiliary, events


def value(spark, x, schema="x string", **kw):
    return lambda expr: spark.createDataFrame([(x,)], schema).select(expr).first()[0]


@pytest.mark.parametrize("x, name, ext", [("/a/b.c", "b.c", "c"), ("x.tar.gz", "x.tar.gz", "gz"), ("noext", "noext", "no-ext"), ("/a/b/", "", "no-ext"), (".gitignore", ".gitignore", "gitignore")])
def test_names(spark, x, name, ext):
    df = spark.createDataFrame([(x,)], "x string").select(fn.basename("x").alias("n"))
    assert df.first()[0] == name
    assert df.select(fn.extension("n")).first()[0] == ext


def test_blob_hash(spark):
    df = spark.createDataFrame([("",), ("hello\n",)], "x string").select(fn.blob_hash("x"))
    assert [r[0] for r in df.collect()] == ["e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "ce013625030ba8dba906f756967f9e9ca394464a"]


def test_command_line(spark):
    assert value(spark, ["sh", "-c", "a b"], "x array<string>")(fn.command_line("x")) == "sh -c 'a b'"


def test_access(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "x int").select(fn.access_edges("x"))
    assert [r[0] for r in df.collect()] == [["reads"], ["writes"], ["reads", "writes"], []]


def test_escapes_round_trip(spark):
    r = random.Random(3)
    xs = ["".join(r.choice('\\"\n\rnr a') for _ in range(r.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x string").select("x", fn.escape("x").alias("e"))
    got = df.select("x", "e", fn.unescape("e").alias("u")).collect()
    assert all(g["x"] == g["u"] and "\n" not in g["e"] and "\r" not in g["e"] for g in got)


def test_paths(spark):
    df = spark.createDataFrame([("/w/d", "../x/./y"), ("/w", "/a//b/../c"), ("/", "../../z")], "c string, p string")
    assert [r[0] for r in df.select(fn.resolve_path("c", "p")).collect()] == ["/w/x/y", "/a/c", "/z"]
    assert value(spark, "https://h/o/name.git")(fn.repository_name("x")) == "name"


def test_path_search(spark):
    names = spark.createDataFrame([(1, "gcc", "/a:/b"), (2, "ld", "/b:/a"), (3, "nil", "/a")], "key int, name string, path string")
    files = spark.createDataFrame([("/a/gcc",), ("/b/gcc",), ("/a/ld",)], "abspath string")
    assert sorted(tuple(r) for r in auxiliary.path_search(names, files).collect()) == [(1, "/a/gcc"), (2, "/a/ld")]


@pytest.mark.parametrize("log, want", [("w1 c2", {(1, 2)}), ("w1 w2 c3 c4", {(2, 3), (1, 4)}), ("c1 w2 c3", {(2, 3)}), ("w1 c3", {(1, 3)}), ("w1", {(1, None)})])
def test_fd_sessions(spark, log, want):
    rows = [(1, 3, int(x[1:]), 1 if x[0] == "w" else -1) for x in log.split()]
    got = events.fd_sessions(spark.createDataFrame(rows, "pid int, fd int, seq int, d int"))
    assert {(r["open_seq"], r["close_seq"]) for r in got.collect()} == want


def test_fd_sessions_are_stacks(spark):
    r = random.Random(5)
    rows, want = [], set()
    stacks: dict = {}
    for i in range(400):
        k, d = (r.randint(1, 3), r.randint(3, 4)), r.choice([1, 1, -1])
        rows.append((*k, i, d))
        if d == 1:
            stacks.setdefault(k, []).append(i)
        elif stacks.get(k):
            want.add((stacks[k].pop(), i))
    want |= {(i, None) for s in stacks.values() for i in s}
    got = events.fd_sessions(spark.createDataFrame(rows, "pid int, fd int, seq int, d int"))
    assert {(x["open_seq"], x["close_seq"]) for x in got.collect()} == want


def test_section_strip(spark):
    lines = ["%build", "x", "%check", "t", "%if 1", "u", "%install"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    got = [r["line"] for r in auxiliary.strip_section(df, ()).orderBy("n").collect()]
    assert got == ["%build", "x", "%check", "exit 0", "%if 1", "u", "%install"]


def test_metrics(spark, tmp_path):
    (tmp_path / "a").write_text("CPU utilization: 50%\nReal: 0\nFaults: 8\nOnly: 2\n")
    (tmp_path / "b").write_text("CPU utilization: 75%\nReal: 3\nFaults: 4:9\n")
    got = auxiliary.compare_metrics(auxiliary.read_metrics(spark, str(tmp_path / "a")), auxiliary.read_metrics(spark, str(tmp_path / "b")))
    assert {r["metric"]: r["pct"] for r in got.collect()} == {"CPU utilization": "150%", "Real": "N/A", "Faults": "50%", "Only": "0%"}


def test_build_system(spark):
    df = spark.createDataFrame([("a", "Makefile"), ("a", "configure"), ("b", "README"), ("c", "CMakeLists.txt"), ("c", "Makefile")], "repo string, filename string")
    got = {r["repo"]: r["cmd"] for r in auxiliary.choose_build_system(df).collect()}
    assert got["a"].startswith("./configure") and got["b"] is None and got["c"].startswith("cmake")


def test_line_counts(spark):
    df = spark.createDataFrame([(":p0 a b:process .",), (":f0 a b:file .",), ("x",)], "value string")
    assert {r["pattern"]: r["n"] for r in auxiliary.line_counts(df).collect()} == {r"\.": 2, "a.*b:process": 1, "a.*b:file": 1}


def test_command_line_is_cut(spark):
    """As recorded: the first 1023 bytes; an argument that doesn't end there is left out."""
    cmd = lambda args: value(spark, args, "x array<string>")(fn.command_line("x"))
    assert cmd(["a" * 1022]) == "a" * 1022 and cmd(["a" * 1023]) == "" and cmd(["sh", "a" * 1023, "b"]) == "sh "
    assert cmd(["a" * 510, "b" * 511, "c"]) == "a" * 510 + " " + "b" * 511  # both end at byte 1023
    assert cmd(["é" * 510, "bc"]) == "é" * 510 + " " and cmd(["é" * 511, "b"]) == "é" * 511 and cmd([]) is None
    from buildloom.streaming.reducer import rendered
    for args in (["a" * 1022], ["a" * 1023], ["sh", "a b" * 400, "b"], ["a" * 510, "b" * 511, "c"], ["é" * 510, "bc"], [], ["x y", "z"]):
        assert rendered(args) == cmd(args)


def test_comparison(spark):
    for base, run, want in (("3", "1", "33.3333%"), ("8", "2", "25%"), ("0", "2", "N/A"), ("3", "20000000", "6.66667e+08%"), ("1", None, "0%"), ("70000", "0.00001", "1.42857e-08%")):
        df = spark.createDataFrame([(base, run)], "a string, b string")
        assert df.select(fn.comparison(F.col("a"), F.col("b"))).first()[0] == want
