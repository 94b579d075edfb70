import re

import golden
import pytest
from pyspark.sql import functions as F

from buildloom.plans import model, reports
from buildloom.plans.sparql import SparqlError, compile_query
from buildloom.sources import turtle


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("ttl") / "pkg-build.out"
    p.write_text(turtle.header() + "\n" + "\n".join(golden.lines()) + "\n", encoding="utf-8")
    return str(p)


@pytest.fixture(scope="module")
def triples(spark, path):
    return turtle.read_turtle(spark, path).cache()


@pytest.fixture(scope="module")
def graph(triples):
    g = model.from_triples(triples)
    for t in vars(g).values():
        t.cache()
    return g


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def n(df):
    return df.first()[0]


def test_triples_are_a_set(triples):
    assert triples.count() == 89
    assert {r[0] for r in triples.select("build_id").distinct().collect()} == {"pkg"}


def test_schema_header_is_71_triples(spark, path):
    assert turtle.read_turtle(spark, path, with_schema=True).count() == 89 + 71


def test_escapes(graph):
    assert ("sh -c 'echo \"hi\\n\"'",) in rows(graph.process_cmd.select("cmd"))


def test_overview(graph):
    assert [n(f(graph)) for f in (reports.processes, reports.files, reports.reads, reports.writes, reports.renames, reports.creates)] == [4, 12, 9, 4, 1, 3]


def test_timeline(graph):
    assert rows(reports.timeline(graph)) == [("2026-05-30T10:00:00Z", "2026-05-31T10:00:10Z", 86410, 10)]


def test_programs(graph):
    assert {r[0] for r in rows(reports.exec_counts(graph))} == {"/bin/sh", "/build/src/gen", "/usr/bin/ld", "/usr/bin/make", "/usr/libexec/gcc/cc1"}
    assert {(r[0], r[1]) for r in rows(reports.tools_by_package(graph))} == {("bash", 1), ("gen", 1), ("binutils", 1), ("make", 1), ("gcc", 1)}
    assert rows(reports.source_reads_by_ext(graph)) == [("c", 1, "C")]


def test_externals(graph):
    assert [r[0] for r in rows(reports.external_executables(graph))] == ["/bin/sh", "/usr/bin/ld", "/usr/bin/make", "/usr/libexec/gcc/cc1"]
    assert {(r[0], r[2]) for r in rows(reports.external_libs(graph))} == {("/usr/lib64/libc.so.6", None), ("/usr/lib64/libx.so.1", "0004")}
    assert rows(reports.renamed_external(graph)) == [("/usr/lib64/libx.so.1",)]


def test_sources_and_artifacts(graph):
    assert rows(reports.project_sources_relative(graph)) == [("/build/src/src/a.c", "src/a.c")]
    assert rows(reports.project_sources_report(graph)) == []
    assert [r[0] for r in rows(reports.artifacts(graph))] == ["/build/src/gen", "/build/src/libx.so.1", "/build/src/out/Makefile", "/build/src/src/a.o"]
    assert rows(reports.artifacts_by_ext(graph)) == [("1", 1, "libx.so.1"), ("no-ext", 2, "gen, Makefile"), ("o", 1, "a.o")]
    assert rows(reports.built_libs(graph)) == [("/build/src/libx.so.1", "0004")]


def test_tree_and_headers(graph):
    assert [r[0] for r in rows(reports.process_roots(graph))] == [":p0", ":p4"]
    children = [r for r in rows(reports.root_children(graph)) if r[0] == ":p0"]
    assert len(children) == 4 and (":p0", ":p2", None) in children
    assert rows(reports.headers_top(graph)) == [("/usr/include/stdio.h", "<inc>/stdio.h", 2)]


def test_roundtrip(spark, graph, triples, tmp_path):
    assert rows(graph.triples().select("s", "p", "o")) == rows(triples.select("s", "p", "o"))
    one = tmp_path / "again-build.out"
    turtle.write_one(triples, str(one))
    back = turtle.read_turtle(spark, str(one))
    assert rows(back.select("s", "p", "o", "o_kind")) == rows(triples.select("s", "p", "o", "o_kind"))
    assert one.read_text().startswith("@prefix")
    model.save(graph, str(tmp_path / "store"))
    assert rows(model.load(spark, str(tmp_path / "store")).triples()) == rows(graph.triples())


def test_full_iris_are_read(spark):
    lines = spark.createDataFrame([("x", f"<{turtle.DATA}p0> <{turtle.RDF}type> <{turtle.VOCABULARY}process> .")], "build_id string, value string")
    assert [tuple(r) for r in turtle.parse_lines(lines).collect()] == [("x", ":p0", "a", "b:process", "iri")]


def test_sparql(graph):
    ask = lambda q: rows(compile_query(graph, q))
    assert ask("SELECT (COUNT(?p) AS ?n) WHERE { ?p a b:process }") == [(4,)]
    assert ask("SELECT (COUNT(?c) AS ?n) WHERE { ?s b:creates ?c . FILTER(STR(?c) = \"nobody\") }") == [(0,)]
    assert ask("SELECT ?p WHERE { ?p a b:process . FILTER NOT EXISTS { ?parent b:creates ?p } }") == [(":p0",), (":p4",)]
    assert len(ask("PREFIX d: <urn:x/data#> SELECT ?child ?cmd WHERE { d:p0 b:creates ?child . OPTIONAL { ?child b:cmd ?cmd } }")) == 4
    assert ask("SELECT DISTINCT ?path WHERE { ?proc a b:process ; b:reads ?f . ?f b:abspath ?path . FILTER(STRENDS(STR(?path), \".c\")) } ORDER BY ?path") == [("/build/src/src/a.c",)]
    assert ask("SELECT ?to WHERE { ?p b:rename ?r . ?r b:rename-to ?f . ?f b:abspath ?to }") == [("/usr/lib64/libx.so.1",)]
    assert ask("SELECT ?x WHERE { { ?p b:reads ?x } UNION { ?p b:writes ?x } FILTER(!BOUND(?none)) } LIMIT 3").__len__() == 3
    assert ask("SELECT (COUNT(DISTINCT ?f) AS ?n) WHERE { ?p b:reads ?f }") == [(6,)]
    assert ask("SELECT ?p (COUNT(*) AS ?n) WHERE { ?p b:reads ?f } GROUP BY ?p ORDER BY DESC(?n) LIMIT 1") == [(":p3", 4)]


@pytest.mark.parametrize("text", ["ASK { ?s ?p ?o }", "SELECT ?x WHERE { ?s b:reads ?f . ?a b:writes ?b }", "SELECT ?y WHERE { ?s b:reads ?f }", "SELECT ?f WHERE { ?s b:reads ?f", "SELECT ?f WHERE { ?s b:nothing ?f }", "SELECT ?f WHERE { ?f b:name ?n . OPTIONAL { ?f b:hash ?h } OPTIONAL { ?g b:hash ?h } }"])
def test_sparql_refuses(graph, text):
    with pytest.raises(SparqlError):
        compile_query(graph, text)


def test_exists_sees_the_group_around(spark):
    rows = [("x", s, p, o, "iri") for s, p, o in ((":p0", "b:writes", ":f0"), (":p1", "b:writes", ":f0"), (":p1", "b:writes", ":f1"), (":p1", "b:reads", ":f2"), (":p2", "b:reads", ":f1"))]
    g = model.from_triples(turtle.from_rows(spark, rows))
    ask = lambda text: sorted(tuple(r) for r in compile_query(g, text).collect())
    assert ask("SELECT ?p ?f WHERE { ?p b:writes ?f . FILTER NOT EXISTS { ?q b:writes ?f . FILTER(?q != ?p) } }") == [(":p1", ":f1")]
    assert ask("SELECT ?p ?f WHERE { ?p b:writes ?f . FILTER EXISTS { ?q b:writes ?f . FILTER(?q != ?p) } }") == [(":p0", ":f0"), (":p1", ":f0")]
    assert ask("SELECT ?p WHERE { ?p b:writes ?f . FILTER EXISTS { ?q b:reads ?f . FILTER(?q = \"none\") } }") == []
    with pytest.raises(SparqlError):
        ask("SELECT ?p WHERE { ?p b:writes ?f . FILTER EXISTS { ?q b:reads ?f . FILTER NOT EXISTS { ?r b:writes ?f . FILTER(?r != ?p) } } }")
    with pytest.raises(SparqlError):
        ask("SELECT ?p WHERE { ?p b:writes ?f . OPTIONAL { ?q b:reads ?f . FILTER(?q != ?p) } }")


def test_turtle_lists_and_prefixes(spark, tmp_path):
    text = """@prefix d: <http://host.example/data#> .
@prefix v: <http://host.example/rdf#> .
# a comment; not a . statement
v:process a <http://www.w3.org/2000/01/rdf-schema#Class> .
d:p0 a v:process ; v:cmd "x ; y . , \\"z\\"", "two" .
<http://host.example/data#p1> v:creates d:p0 , d:p2 .
<http://elsewhere.example/q> v:cmd "kept" .
"""
    want = {(":p0", "a", "b:process"), (":p0", "b:cmd", 'x ; y . , "z"'), (":p0", "b:cmd", "two"), (":p1", "b:creates", ":p0"), (":p1", "b:creates", ":p2"), ("<http://elsewhere.example/q>", "b:cmd", "kept")}
    (tmp_path / "x-build.out").write_text(text)
    (tmp_path / "y-build.out").write_text(text.replace(" ; v:cmd", " ;\n    v:cmd").replace('", "two"', '",\n      "two"').replace("d:p0 , d:p2", "d:p0 ,\n  d:p2"))
    got = {(r["s"], r["p"], r["o"]) for r in turtle.read_turtle(spark, str(tmp_path / "x-build.out")).collect()}
    assert got == want
    got = {(r["s"], r["p"], r["o"]) for r in turtle.read_turtle(spark, str(tmp_path / "y-build.out"), whole=True).collect()}
    assert {t for t in got if not t[0].startswith("<http://host.example/rdf#")} == want
    lines = spark.createDataFrame([("x", l) for l in (":p0 a b:process .", ":p0 b:cmd \"open .", ":p0 a b:process ;", "", "# no", "b:process a rdfs:Class .", ":f0 b:name \"a\" .")], "build_id string, value string")
    assert sorted(r["value"] for r in turtle.unread(lines).collect()) == [":p0 a b:process ;", ":p0 b:cmd \"open ."]


def test_terms_keep_their_kind(spark):
    """A text is neither the node nor the name that is spelled like it."""
    rows = [("x", ":p0", "a", "b:process", "iri"), ("x", ":p0", "b:cmd", "b:process", "literal"), ("x", ":p0", "b:cmd", ":f0", "literal"), ("x", ":p0", "b:reads", ":f0", "iri"), ("x", ":f0", "a", "b:file", "iri"), ("x", ":f0", "b:name", "two", "literal"), ("x", ":f0", "b:name", "one", "literal"), ("x", ":p0", "<urn:x#note>", "other", "literal"), ("x", "_:b", "b:cmd", "blank", "literal")]
    read = model.from_triples(turtle.from_rows(spark, rows))
    stored = model.Graph(**{n: getattr(read, n) for n in model.SCHEMAS})
    ask = lambda g, text: sorted(tuple(r) for r in compile_query(g, text).collect())
    for g in (read, stored):
        assert ask(g, 'SELECT ?s ?p WHERE { ?s ?p "b:process" }') == [(":p0", "b:cmd")]
        assert ask(g, "SELECT ?s ?p WHERE { ?s ?p b:process }") == [(":p0", "a")]
        assert ask(g, "SELECT ?s WHERE { ?s b:cmd b:process }") == []
        assert ask(g, "SELECT ?s ?x WHERE { ?s b:cmd ?x . ?s b:reads ?x }") == []
        assert ask(g, "SELECT ?s ?x WHERE { ?s ?p ?x . ?s b:reads ?x }") == [(":p0", ":f0")]
        assert ask(g, "SELECT ?x WHERE { ?s b:cmd ?x . FILTER(?x = :f0) }") == [] == ask(g, 'SELECT ?x WHERE { ?s b:reads ?x . FILTER(?x = ":f0") }')
        assert ask(g, 'SELECT ?x WHERE { ?s ?p ?x . FILTER(?x != ":f0" && ?x != b:process && ?x != b:file) FILTER(?p IN (b:cmd, b:reads)) }') == [(":f0",), ("b:process",), ("blank",)]
        assert ask(g, f'SELECT ?s WHERE {{ ?s a b:process . FILTER(STR(?s) = "{turtle.DATA}p0" && CONTAINS(STR(?s), "#") && STRENDS(STR(?s), "#p0")) }}') == [(":p0",)]
        assert ask(g, 'SELECT ?s WHERE { ?s b:cmd ?x . FILTER(CONTAINS(STR(?s), "b")) }') == [(":p0",), (":p0",)]
        assert ask(g, 'SELECT ?s WHERE { ?s b:reads ?x . FILTER(!CONTAINS(?x, "f")) }') == []
    assert ask(read, "SELECT ?n WHERE { ?f b:name ?n }") == [("one",), ("two",)]
    assert ask(read, "SELECT ?n WHERE { ?f <urn:x#note> ?n }") == [("other",)]


def test_joins_on_variables_that_may_be_unbound(spark):
    rows = [("x", ":a", "b:reads", ":f", "iri"), ("x", ":a", "b:writes", ":g", "iri"), ("x", ":b", "b:writes", ":f", "iri"), ("x", ":b", "b:reads", ":f", "iri"), ("x", ":c", "b:reads", ":h", "iri"), ("x", ":a", "b:creates", ":c", "iri"), ("x", ":c", "b:cmd", "c", "literal"), ("x", ":a", "b:cmd", "a", "literal"), ("x", ":b", "b:cmd", "b", "literal")]
    g = model.from_triples(turtle.from_rows(spark, rows))
    ask = lambda text: sorted((tuple(r) for r in compile_query(g, text).collect()), key=repr)
    assert ask("SELECT ?p ?f WHERE { ?p b:cmd ?x . OPTIONAL { ?p b:writes ?f } OPTIONAL { ?p b:reads ?f } }") == [(":a", ":g"), (":b", ":f"), (":c", ":h")]
    assert ask("SELECT ?p ?f WHERE { { ?p b:creates ?x } UNION { ?p b:writes ?f } ?p b:reads ?f }") == [(":a", ":f"), (":b", ":f")]
    assert ask("SELECT ?p WHERE { ?p b:cmd ?x . OPTIONAL { ?p b:writes ?f } FILTER NOT EXISTS { ?p b:reads ?f } }") == [(":a",)]
    assert ask("SELECT ?p WHERE { ?p b:reads ?f . MINUS { ?p b:writes ?g } }") == [(":c",)]
    assert ask("SELECT ?p (COUNT(?f) AS ?n) WHERE { { ?p b:reads ?f } UNION { ?p b:writes ?f } } GROUP BY ?p HAVING (?n > 1)") == [(":a", 2), (":b", 2)]


def test_paths(spark):
    """Chains of any length, cycles and loops, from either end."""
    pairs = [("p", "q"), ("q", "r"), ("r", "p"), ("r", "s"), ("s", "s")] + [(f"n{i}", f"n{i + 1}") for i in range(25)]
    rows = [("x", f":{a}", "b:creates", f":{b}", "iri") for a, b in pairs] + [("x", ":s", "b:writes", ":f", "iri"), ("x", ":p", "b:reads", ":f", "iri"), ("y", ":p", "b:creates", ":z", "iri")]
    g = model.from_triples(turtle.from_rows(spark, rows))
    ask = lambda text: sorted(tuple(r) for r in compile_query(g, text).collect())
    reach = {(a, b) for a, b in pairs}
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    reach |= {("p", "z")}
    assert ask("SELECT ?a ?b WHERE { ?a b:creates+ ?b }") == sorted((f":{a}", f":{b}") for a, b in reach)
    assert ask("SELECT ?b WHERE { :n3 b:creates+ ?b }") == sorted((f":n{i}",) for i in range(4, 26))
    assert ask("SELECT ?a WHERE { ?a b:creates+ :n3 }") == [(":n0",), (":n1",), (":n2",)]
    assert ask("SELECT ?b WHERE { :n24 b:creates* ?b }") == [(":n24",), (":n25",)]
    assert ask("SELECT ?b WHERE { :n24 b:creates? ?b }") == [(":n24",), (":n25",)]
    assert ask("SELECT ?a WHERE { ?a b:reads/^b:writes ?b . ?b ^b:creates|b:creates ?c . FILTER(?c = :r) }") == [(":p",)]
    with pytest.raises(SparqlError):
        ask("SELECT ?b WHERE { ?a b:cmd+ ?b }")


def closed(pairs):
    """Reachability, plainly."""
    out = set(pairs)
    while more := {(a, d) for a, b in out for c, d in pairs if b == c} - out:
        out |= more
    return out


@pytest.mark.parametrize("kind", ["chain", "tree", "cycle", "long cycle below a chain", "loop", "diamond", "none"])
def test_closure(spark, kind, monkeypatch):
    """Forests take as many rounds as their depth has binary digits; cycles and shared children are right too."""
    from buildloom.operators import closure

    pairs = {
        "chain": [(i, i + 1) for i in range(20)], "tree": [(i // 3, i) for i in range(1, 60)], "cycle": [(0, 1), (1, 2), (2, 0)],
        "long cycle below a chain": [(i, (i + 1) % 7) for i in range(7)] + [(10, 11), (11, 12)], "loop": [(0, 0), (1, 2)], "diamond": [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], "none": [],
    }[kind]
    made, stored = [], closure.stored
    monkeypatch.setattr(closure, "stored", lambda df, label: made.append(label) or stored(df, label))
    got = closure.closure(spark.createDataFrame([("b", str(a), str(b)) for a, b in pairs] * 2, "build_id string, s string, o string"))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(("b", str(a), str(b)) for a, b in closed(pairs))
    if kind in ("chain", "tree"):
        assert len(made) <= 6


def test_path_from_a_given_end_makes_its_edges_once(spark, monkeypatch):
    """What the fixpoint begins with is read from the stored edges, not worked out again."""
    from buildloom.operators import closure

    plans, stored = [], closure.stored
    monkeypatch.setattr(closure, "stored", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, label))
    said = spark.createDataFrame([("b", f":p{i}", "b:creates", f":p{i + 1}", "iri") for i in range(4)], "build_id string, s string, p string, o string, o_kind string")
    got = compile_query(model.from_triples(said), "SELECT ?x WHERE { :p1 b:creates+ ?x }")
    assert sorted(r.x for r in got.collect()) == [":p2", ":p3", ":p4"]
    assert sum("LogicalRDD" in p or "LocalRelation" in p for p in plans) == 1


def test_tasks_over_triples_do_not_grow_with_them(spark):
    """Told how many triples there are, as many tasks make a set of them and join them; the answers are the same."""
    said = [(f":p{i}", "a", "b:process", "iri") for i in range(9)] + [(f":p{i // 2}", "b:creates", f":p{i}", "iri") for i in range(1, 12)] + [(f":p{i}", "b:cmd", f":p{i // 2}", "literal") for i in range(9)]
    triples = spark.createDataFrame([("b", *t) for t in said * 2], "build_id string, s string, p string, o string, o_kind string")
    for text in ("SELECT ?s ?x WHERE { ?s ?p ?x . ?x a b:process }", "SELECT ?s ?c WHERE { ?s a b:process . OPTIONAL { ?s b:creates ?c } MINUS { ?x b:creates ?s . ?x b:cmd ':p1' } }", "SELECT ?s WHERE { ?s a b:process . FILTER NOT EXISTS { ?s b:creates ?c } }"):
        few, many = (compile_query(model.from_triples(triples, about), text) for about in (None, 23 * model.PART))
        assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))
        assert many._jdf.queryExecution().optimizedPlan().toString().count(", 23") >= 3


def test_a_graph_has_tables_alone(spark):
    """How many tasks there are is no part of a graph whose triples weren't counted; of others it stays with each build's part."""
    triples = spark.createDataFrame([("b", ":p0", "a", "b:process", "iri")], "build_id string, s string, p string, o string, o_kind string")
    plain, counted = model.from_triples(triples), model.from_triples(triples, 23 * model.PART)
    assert plain.parts is None and set(vars(plain)) == {*model.SCHEMAS, "said"} and all(hasattr(t, "cache") for t in vars(plain).values())
    assert counted.parts == counted.only("b").parts == 23 and counted.only("b").triples().count() == 1
