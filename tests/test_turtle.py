"""General Turtle: whatever the layout, the same triples; what isn't understood is listed and nothing is made up."""

import random

import pytest

from buildloom.plans.model import PART
from buildloom.sources import turtle
from buildloom.sources.turtle_text import RDF, Reader

HEAD = f"@prefix : <{turtle.DATA}> .\n@prefix b: <{turtle.VOCABULARY}> .\n"


def read(text, prefixes=None):
    triples, unread = [], []
    for made, bad, _ in Reader(text, prefixes or {}).statements():
        triples += made
        if bad is not None:
            unread.append(bad)
    return triples, unread


def test_tokens_of_every_kind():
    text = HEAD + r"""
PREFIX d: <http://host.example/data#>
base <http://base.example/x/>
:p0 a b:process ; b:cmd 'single', '''long
"two" lines''', "uni\u00e9 \U0001F600 \t\"q\"", 12, -1.5, 2e3, true ; ; .
d:p1 b:reads [ a b:file ; b:abspath "/anon" ], [] ; b:creates d:p2.
:p3 b:list ( :a "b" ( ) ) .
[ b:cmd "x"@en-US ] .
<rel> b:start "2020-01-01T00:00:00Z"^^<http://www.w3.org/2001/XMLSchema#dateTime> . # remark . <not> <a> "statement" .
:we\~ird b:name "dots. in. names" . :a.b b:name "." .
"""
    got, unread = read(text)
    assert unread == []
    assert set(got) == {
        (":p0", "a", "b:process", "iri"), (":p0", "b:cmd", "single", "literal"), (":p0", "b:cmd", 'long\n"two" lines', "literal"), (":p0", "b:cmd", 'unié 😀 \t"q"', "literal"),
        (":p0", "b:cmd", "12", "literal"), (":p0", "b:cmd", "-1.5", "literal"), (":p0", "b:cmd", "2e3", "literal"), (":p0", "b:cmd", "true", "literal"),
        (":p1", "b:reads", "_:anon0", "bnode"), ("_:anon0", "a", "b:file", "iri"), ("_:anon0", "b:abspath", "/anon", "literal"), (":p1", "b:reads", "_:anon1", "bnode"), (":p1", "b:creates", ":p2", "iri"),
        (":p3", "b:list", "_:anon2", "bnode"), ("_:anon2", f"<{RDF}first>", ":a", "iri"), ("_:anon2", f"<{RDF}rest>", "_:anon3", "bnode"), ("_:anon3", f"<{RDF}first>", "b", "literal"), ("_:anon3", f"<{RDF}rest>", "_:anon4", "bnode"),
        ("_:anon4", f"<{RDF}first>", f"<{RDF}nil>", "iri"), ("_:anon4", f"<{RDF}rest>", f"<{RDF}nil>", "iri"),
        ("_:anon5", "b:cmd", "x", "literal"), ("<http://base.example/x/rel>", "b:start", "2020-01-01T00:00:00Z", "literal"), (":we~ird", "b:name", "dots. in. names", "literal"), (":a.b", "b:name", ".", "literal"),
    }


@pytest.mark.parametrize("bad", [":p0 b:cmd \"open .", ":p0 a .", ":p0 :p1 .", "\"x\" b:cmd :y .", ":p0 none:x :y .", ":p0 b:cmd \"bad \\q\" .", ":p0 b:reads [ b:cmd \"x\" .", ":p0 b:reads :a :b .", ":p0 \"x\" :a .", ":p0 b:cmd \"\\uD800\" .", "} { .", "@prefix x <y> .", ":p0 b:reads <a b> ."])
def test_what_is_not_understood_is_listed(bad):
    got, unread = read(HEAD + ':a b:cmd "1" .\n' + bad + '\n:b b:cmd "2" .\n')
    assert len(unread) >= 1 and (":a", "b:cmd", "1", "literal") in got
    assert set(got) <= {(":a", "b:cmd", "1", "literal"), (":b", "b:cmd", "2", "literal")}


def written(r, triples):
    """Random layouts of triples, subject by subject."""
    space = lambda: r.choice([" ", "\n", "\t", "  # note . ;\n", "\n\n"])
    def text(x):
        style = r.randrange(4)
        if style == 0:
            return '"' + "".join({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}.get(c, c) for c in x) + '"'
        if style == 1:
            return "'" + "".join({"\\": "\\\\", "'": "\\'", "\n": "\\u000A", "\r": "\\r"}.get(c, c) for c in x) + "'"
        q = '"' if style == 2 else "'"
        return q * 3 + "".join({"\\": "\\\\", q: "\\" + q, "\r": "\\r"}.get(c, c) for c in x) + q * 3
    def term(t, kind="iri"):
        if kind == "literal":
            return text(t) + r.choice(["", "", "@en", "^^<http://x.example/t>"])
        if t == "a" or t.startswith("_:"):
            return t
        space_of = turtle.VOCABULARY if t.startswith("b:") else turtle.DATA
        return r.choice([t, f"<{space_of}{t.split(':')[1]}>"])
    by = {}
    for s, p, o, k in triples:
        by.setdefault(s, []).append((p, o, k))
    out = ""
    for s, rest in by.items():
        out += term(s) + space() + (space() + ";" + space()).join(term(p) + space() + term(o, k) for p, o, k in rest) + space() + "." + space()
    return out


def test_any_layout_gives_the_same_triples():
    r = random.Random(4)
    for _ in range(150):
        letters = 'ab"\'\\.;,#<>[]\n é😀@^:_'
        triples = list({(r.choice([":p0", ":f1", "_:x", ":é"]), r.choice(["b:cmd", "b:reads", "a"]), r.choice([":q", "b:file", "_:y"]), "iri") if r.random() < 0.4 else (r.choice([":p0", ":f1", "_:x"]), "b:cmd", "".join(r.choice(letters) for _ in range(r.randint(0, 12))), "literal") for _ in range(8)})
        got, unread = read(HEAD + written(r, triples))
        assert not unread and sorted((s, p, o) for s, p, o, _ in got) == sorted((s, p, o) for s, p, o, _ in triples)


def test_files_are_read_line_by_line_or_whole(spark, tmp_path):
    """Files in the recorder's layout and others, side by side; a line that only looks like a statement isn't one."""
    (tmp_path / "one-build.out").write_text(turtle.header() + ':p0 a b:process .\n:p0 b:cmd "x" .\n')
    (tmp_path / "two-build.out").write_text(HEAD + ':p0 b:cmd """text\n:p9 b:cmd "not a statement" .\n""" ;\n    a b:process .\n:p1 b:reads [ a b:file ] .\n:p2 b:bad .\n')
    (tmp_path / "three-build.out").write_text(HEAD + ':p0 b:cmd "old" .\n@prefix : <urn:other/data#> .\n@prefix v: <urn:other/rdf#> .\n:p1 v:cmd "new" .\n')
    loaded = turtle.load(spark, str(tmp_path))
    got = {tuple(r)[:4] for r in loaded.triples.collect()}
    assert got == {
        ("one", ":p0", "a", "b:process"), ("one", ":p0", "b:cmd", "x"), ("two", ":p0", "b:cmd", 'text\n:p9 b:cmd "not a statement" .\n'), ("two", ":p0", "a", "b:process"),
        ("two", ":p1", "b:reads", "_:anon0"), ("two", "_:anon0", "a", "b:file"), ("three", ":p0", "b:cmd", "old"), ("three", ":p1", "b:cmd", "new"),
    }
    assert [tuple(r) for r in loaded.unread.collect()] == [("two", ":p2 b:bad .", 8)]


def test_lines_that_hold_more_than_lists_are_not_guessed(spark):
    lines = [':p0 b:reads [ a b:file ; b:abspath "/anon" ] .', "PREFIX b: <urn:x/rdf#>", ":p0 b:cmd 'single' .", ':p0 b:cmd """long""" .', ":p0 b:cmd 12 .", ":p0 none:x :y .", ':p0 b:cmd "x" . :p1 b:cmd "y" .', ':p0 "x" :y .', ":p0 b:reads :a :b .", ":p0 a b:file, .", "a a a ."]
    good = [":p0 b:reads :f0 .", "\t:p0\ta\tb:process\t.", '<urn:x/data#p1> b:cmd "a . b"@en, "c"^^xsd:string ; b:reads :f.1 ; .', ":p2 b:reads :f2."]
    frame = spark.createDataFrame([("x", l) for l in lines + good], "build_id string, value string")
    assert sorted(r["value"] for r in turtle.unread(frame).collect()) == sorted(lines)
    assert {(r["s"], r["p"], r["o"]) for r in turtle.parse_lines(frame).collect()} == {(":p0", "b:reads", ":f0"), (":p0", "a", "b:process"), (":p1", "b:cmd", "a . b"), (":p1", "b:cmd", "c"), (":p1", "b:reads", ":f.1"), (":p2", "b:reads", ":f2")}


def test_command_line_tells_what_was_not_read(spark, tmp_path, capsys):
    from buildloom import cli

    p = tmp_path / "pkg-build.out"
    p.write_text(turtle.header() + ':p0 a b:process .\n:p0 b:cmd "open .\n:p1 b:cmd "fine" .\n')
    assert cli.main([str(p), "-q", "stats"], spark) == cli.UNREAD
    err = capsys.readouterr().err
    assert "1" in err and 'b:cmd "open .' in err


def test_reading_is_dealt_to_all_tasks(spark):
    """Statements and texts that come in one partition are read by many tasks."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(0, 4000, 1, 1).selectExpr("'b' AS build_id", "concat(':p', id, ' b:cmd \"x\" .') AS value")
    texts = rows.selectExpr("build_id", "concat('@prefix : <http://x/data#> . @prefix b: <http://x/rdf#> . ', value) AS value")
    tasks = lambda df: df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len([x for x in tasks(turtle.parse_texts(texts)) if x]) == n > 1
    assert "RoundRobinPartitioning" in turtle.parse_lines(rows)._jdf.queryExecution().executedPlan().toString()
    assert turtle.parse_lines(rows).count() == turtle.parse_texts(texts).count() == 4000


def test_plain_lines_are_read_as_their_tokens_are(spark, monkeypatch):
    """Lines of one triple are told by one look: with it and without, the same triples and the same unread lines, whatever
    the file's prefixes are."""
    r = random.Random(5)
    names = [":p0", ":", "::x", ":a.b", ":f.", ":é", "_:rename-p0-f1", "_:x.", "b:file", "b:", "b", "a", "rdf:type", "xsd:int", "none:x", "<urn:x/data#p1>", "<urn:y>", "<>", "x:data#y", ":a:b-", "-:x"]
    texts = ['""', '"x"', '"a b . ;"', '"q\\"@en"', '"\\\\n\\n\\t\\\'"', '"\\\\"', '"\\b"', '"bad \\q"', '"open', '"x"@en', '"x"^^xsd:string', '"é😀\x85 "', '"\r"', "'single'", '":p0"', '"_:b"', '"""long"""']
    gap = lambda: r.choice(["\t", "\t", " ", "  ", "\t \x0b", ""])
    lines = {r.choice(["", "", "", " ", "#"]) + gap().join([r.choice(names[:8] if r.random() < 0.8 else names), r.choice(["a", "b:cmd"] if r.random() < 0.8 else names), r.choice(names + texts)]) + gap() + r.choice([".", ".", ".", "", "..", ";", ". .", ".\n", ".\x85", ". # x"]) for _ in range(6000)}
    lines |= {f":p0\tb:cmd\t{x} ." for x in names + texts} | {f"{x} a {y}." for x in names for y in names} | {":p0 b:cmd \"" + "ab\\\\\\n" * 50_000 + "\" .", ""}
    usual = "map('', 'urn:build-provenance:data#', 'b', 'urn:build-provenance:rdf#', 'xsd', 'urn:xsd#')"
    maps = [usual, "map('', 'urn:x/data#', 'b', 'urn:x/rdf#')", "map('', 'urn:x/other#', 'b', 'urn:x/rdf#', 'x', 'urn:x/')", "map('', 'urn:x/rdf#', 'b', 'urn:x/data#')", "map('b', 'urn:x/rdf#')", "map('', 'urn:x/data#a')", "map('', 'urn:xdata#', 'b', 'urn:x/rdf#')"]
    frame = spark.createDataFrame([(x,) for x in sorted(lines)], "value string").selectExpr("posexplode(array(" + ", ".join(maps) + ")) AS (build_id, prefixes)", "value").selectExpr("string(build_id) AS build_id", "prefixes", "value").cache()
    bare = frame.where("build_id = '0'").select("build_id", "value")

    def both():
        read = [turtle.parse_lines(frame, "prefixes"), turtle.parse_lines(bare), turtle.parse_lines(bare, about=10), turtle.unread(frame, "prefixes").select("build_id", "value"), turtle.unread(bare)]
        return [sorted(map(repr, df.collect())) for df in read]

    quick = both()
    assert frame.where(turtle._plain(frame.value, frame.prefixes)).count() > 300
    monkeypatch.setattr(turtle, "PLAIN", "(?!)")
    assert frame.where(turtle._plain(frame.value, frame.prefixes)).count() == 0
    assert quick == both()
    assert len(quick[0]) > 1000 < len(quick[3])


def test_a_line_is_taken_apart_once(spark):
    """A line's tokens are found at one place of the plan, and the set of triples has tasks by how many there are."""
    lines = spark.createDataFrame([("x", f":p{i} b:cmd \"x\" .") for i in range(9)] * 2, "build_id string, value string")
    read = turtle.parse_lines(lines, about=23 * PART)
    assert read._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert ", 23)" in read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == 9
