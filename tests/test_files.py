from buildloom.operators import auxiliary
from buildloom.sources import files


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("empty", "also empty"):
        (tmp_path / "d" / name).write_bytes(b"")
    (tmp_path / "d" / "hello").write_bytes(b"hello\n")
    got = {r["abspath"].rsplit("/", 1)[-1]: (r["size"], r["hash"]) for r in files.hash_files(spark, str(tmp_path / "d")).collect()}
    assert got == {"hello": (6, "ce013625030ba8dba906f756967f9e9ca394464a"), "empty": (0, files.EMPTY_HASH), "also empty": (0, files.EMPTY_HASH)}
    spec = tmp_path / "p.spec"
    spec.write_text("%build\nmake\n%check\nmake check\n%install\n")
    stripped = auxiliary.strip_section(files.numbered_lines(spark, str(spec)), ("file",)).orderBy("n")
    assert [r["line"] for r in stripped.collect()] == ["%build", "make", "%check", "exit 0", "%install"]


def test_listings_and_environment(spark):
    listing = spark.createDataFrame([("r", "b.spec"), ("r", "a.spec"), ("r", "a.c"), ("s", "x")], "repo string, filename string")
    assert [tuple(r) for r in files.first_file(listing).collect()] == [("r", "a.spec")]
    env = spark.createDataFrame([("b", ":p0", "A=1=2"), ("b", ":p0", "EMPTY="), ("b", ":p0", "bare")], "build_id string, pid_node string, entry string")
    assert sorted((r["var"], r["value"]) for r in files.environment(env).collect() if r["value"] is not None) == [("A", "1=2"), ("EMPTY", "")]


def test_event_logs(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"build_id": "b", "seq": 1, "ts": "2026-05-30T10:00:00Z", "pid": 7, "op": "exit", "syscall": "close", "fd": 3, "rval": 0}\n')
    row = files.read_events(spark, str(tmp_path)).first()
    assert (row["pid"], row["fd"], row["env"]) == (7, 3, None)
    assert files.stream_events(spark, str(tmp_path)).isStreaming


def test_files_are_hashed_in_blocks(spark, tmp_path, monkeypatch):
    """Nested folders, names with spaces and signs, links, and files of many blocks."""
    import hashlib

    monkeypatch.setattr(files, "BLOCK_BYTES", 1000)
    want = {}
    for name, size in (("a", 0), ("b c%20.txt", 999), ("d/e", 1000), ("d/f/g é", 123_456), ("d/f/h#1", 1)):
        at = tmp_path / "x" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        data = bytes(i * 7 % 251 for i in range(size))
        at.write_bytes(data)
        want[str(at)] = (size, hashlib.sha1(b"blob %d\x00" % size + data).hexdigest())
    (tmp_path / "x" / "none").mkdir()
    assert {r["abspath"]: (r["size"], r["hash"]) for r in files.hash_files(spark, str(tmp_path / "x")).collect()} == want
    one = files.hash_files(spark, str(tmp_path / "x" / "d" / "e")).collect()
    assert [(r["abspath"], r["size"]) for r in one] == [(str(tmp_path / "x" / "d" / "e"), 1000)]
