"""A bounded SPARQL front-end: query text to algebra to one DataFrame plan over the property tables.

SELECT [DISTINCT] variables and COUNT / MIN / MAX aggregates; groups of triple patterns with `;` and `,` lists, `a`,
prefixed names, IRIs, blank nodes and string literals; FILTER with || && ! = != < > <= >=, STR, CONTAINS, STRSTARTS,
STRENDS, REGEX, BOUND, IN; FILTER [NOT] EXISTS, whose filters may use variables of the group around it; MINUS; OPTIONAL;
UNION; property paths of / | ^ + * ? between nodes; GROUP BY, HAVING over selected names, ORDER BY, LIMIT, OFFSET. Anything
else is refused with a message. Results are bags of rows, one column for each variable, null where it isn't bound.

Terms keep their kind: a text is never equal to a node or to a name that is spelled like it, and STR of a node is its whole
IRI. Which kind a variable has follows from the property that binds it; only where it may have both is the kind a column.
A join on a variable that may be unbound (after OPTIONAL or UNION) takes rows that are compatible: equal, or unbound on a side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import RDF, iri_of
from ..operators.closure import closure
from .model import Graph, dealt

TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<num>\d+)|(?P<name>(?:_:|[A-Za-z][\w-]*)?:[\w.-]*\w|(?:[A-Za-z][\w-]*)?:|[A-Za-z]\w*)|(?P<op>\|\||&&|!=|<=|>=|[{}().;,!=<>*/^|+?])""")


class SparqlError(ValueError):
    """The text isn't in the supported subset."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    value: str
    literal: bool = False


@dataclass
class Group:
    patterns: list[tuple] = field(default_factory=list)
    filters: list[tuple] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)
    exists: list[tuple[bool, Group]] = field(default_factory=list)
    minus: list[Group] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)


@dataclass
class Query:
    select: list[tuple]
    distinct: bool
    where: Group
    group_by: list[str]
    having: list[tuple]
    order_by: list[tuple[str, bool]]
    limit: int | None
    offset: int | None


def tokens(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text):
        m = TOKEN.match(text, i)
        if not m:
            raise SparqlError(f"can't read {text[i : i + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        i = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.rest, self.at, self.prefixes, self.fresh = tokens(text), 0, {}, 0

    def peek(self) -> tuple[str, str]:
        return self.rest[self.at]

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.rest[self.at - 1]

    def word(self, *words: str) -> bool:
        kind, text = self.peek()
        if kind == "name" and text.upper() in words:
            self.at += 1
            return True
        return False

    def sign(self, text: str) -> bool:
        if self.peek() == ("op", text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.sign(text):
            raise SparqlError(f"expected {text!r}, found {self.peek()[1]!r}")

    def number(self) -> int:
        kind, text = self.next()
        if kind != "num":
            raise SparqlError(f"expected a number, found {text!r}")
        return int(text)

    def query(self) -> Query:
        while self.word("PREFIX"):
            name, iri = self.next()[1], self.next()
            if iri[0] != "iri" or not name.endswith(":"):
                raise SparqlError("expected PREFIX name: <iri>")
            self.prefixes[name[:-1]] = iri[1][1:-1]
        if not self.word("SELECT"):
            raise SparqlError("only SELECT queries are supported")
        distinct, select = self.word("DISTINCT"), []
        while True:
            kind, text = self.peek()
            if kind == "var":
                self.next()
                select.append(("var", text[1:]))
            elif self.sign("("):
                what = self.next()[1].upper()
                if what not in ("COUNT", "MIN", "MAX"):
                    raise SparqlError(f"{what} isn't supported")
                self.need("(")
                once = self.word("DISTINCT")
                arg = "*" if self.sign("*") else self.next()[1][1:]
                self.need(")")
                if not self.word("AS"):
                    raise SparqlError("expected AS")
                select.append((what, arg, self.next()[1][1:], once))
                self.need(")")
            elif self.sign("*"):
                select.append(("all",))
            else:
                break
        self.word("WHERE")
        where = self.group()
        out = Query(select, distinct, where, [], [], [], None, None)
        if self.word("GROUP"):
            self.word("BY")
            while self.peek()[0] == "var":
                out.group_by.append(self.next()[1][1:])
        if self.word("HAVING"):
            while self.peek() == ("op", "("):
                out.having.append(self.primary())
        if self.word("ORDER"):
            self.word("BY")
            while True:
                if self.peek()[0] == "var":
                    out.order_by.append((self.next()[1][1:], False))
                elif (down := self.word("DESC")) or self.word("ASC"):
                    self.need("(")
                    out.order_by.append((self.next()[1][1:], bool(down)))
                    self.need(")")
                else:
                    break
        while self.peek()[0] != "end":
            if self.word("LIMIT"):
                out.limit = self.number()
            elif self.word("OFFSET"):
                out.offset = self.number()
            else:
                raise SparqlError(f"{self.peek()[1]!r} isn't supported")
        return out

    def group(self) -> Group:
        self.need("{")
        out = Group()
        while not self.sign("}"):
            if self.word("FILTER"):
                no = self.word("NOT")
                if self.word("EXISTS"):
                    out.exists.append((not no, self.group()))
                elif no:
                    raise SparqlError("expected EXISTS")
                else:
                    out.filters.append(self.primary())
                self.sign(".")
            elif self.word("OPTIONAL"):
                out.optionals.append(self.group())
                self.sign(".")
            elif self.word("MINUS"):
                out.minus.append(self.group())
                self.sign(".")
            elif self.peek() == ("op", "{"):
                choices = [self.group()]
                while self.word("UNION"):
                    choices.append(self.group())
                out.unions.append(choices)
                self.sign(".")
            elif self.peek()[0] == "end":
                raise SparqlError("a group isn't closed")
            else:
                self.triples(out)
        return out

    def triples(self, out: Group) -> None:
        s = self.term()
        while True:
            p = self.path() if self.peek()[0] != "var" else self.term()
            while True:
                out.patterns.append((s, p, self.term()))
                if not self.sign(","):
                    break
            if not self.sign(";"):
                break
            if self.peek() in (("op", "."), ("op", "}")):
                break
        self.sign(".")

    def path(self) -> Term | tuple:
        """A property, or ("|" or "/", left, right), ("^", path), ("+" or "*" or "?", path)."""
        left = self.steps()
        while self.sign("|"):
            left = ("|", left, self.steps())
        return left

    def steps(self) -> Term | tuple:
        left = self.step()
        while self.sign("/"):
            left = ("/", left, self.step())
        return left

    def step(self) -> Term | tuple:
        if self.sign("^"):
            return ("^", self.step())
        if self.sign("("):
            inner = self.path()
            self.need(")")
        else:
            inner = Term("a") if self.peek() == ("name", "a") and self.next() else self.term()
            if not isinstance(inner, Term) or inner.literal:
                raise SparqlError("a property is a name")
        for times in "+*?":
            if self.sign(times):
                return (times, inner)
        return inner

    def term(self) -> Var | Term:
        kind, text = self.next()
        if kind == "var":
            return Var(text[1:])
        if kind == "iri":
            return Term(self.local(text[1:-1]))
        if kind == "str":
            return Term(text_of(text), True)
        if kind == "name" and text.startswith("_:"):
            return Var(f"_blank_{text[2:]}")
        if kind == "name" and ":" in text:
            prefix, _, name = text.partition(":")
            if prefix in self.prefixes:
                return Term(self.local(self.prefixes[prefix] + name))
            if prefix in ("", "b", "rdf"):
                return Term("a" if text == "rdf:type" else text if prefix != "rdf" else f"<{RDF}{name}>")
        raise SparqlError(f"{text!r} isn't a term that is supported here")

    def local(self, iri: str) -> str:
        """The name as it stands in the tables: vocabulary names end in rdf#name, nodes in data#name; others are whole IRIs."""
        head, mark, name = iri.rpartition("#")
        if iri == "http://www.w3.org/1999/02/22-rdf-syntax-ns#type":
            return "a"
        if mark and re.search(r"\brdf$", head):
            return f"b:{name}"
        if mark and re.search(r"\bdata$", head):
            return f":{name}"
        return f"<{iri}>"

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.sign("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.comparison()
        while self.sign("&&"):
            left = ("and", left, self.comparison())
        return left

    def comparison(self) -> tuple:
        left = self.primary()
        kind, text = self.peek()
        if kind == "op" and text in ("=", "!=", "<", ">", "<=", ">="):
            self.next()
            return (text, left, self.primary())
        no = kind == "name" and text.upper() == "NOT"
        if no:
            self.next()
        if self.word("IN"):
            self.need("(")
            listed = [self.primary()]
            while self.sign(","):
                listed.append(self.primary())
            self.need(")")
            found = ("=", left, listed[0])
            for x in listed[1:]:
                found = ("or", found, ("=", left, x))
            return ("not", found) if no else found
        if no:
            raise SparqlError("expected IN")
        return left

    def primary(self) -> tuple:
        if self.sign("!"):
            return ("not", self.primary())
        if self.sign("("):
            inner = self.expression()
            self.need(")")
            return inner
        kind, text = self.next()
        if kind == "var":
            return ("var", text[1:])
        if kind == "str":
            return ("text", text_of(text))
        if kind == "num":
            return ("number", int(text))
        if kind == "name" and text.upper() in ("STR", "CONTAINS", "STRSTARTS", "STRENDS", "BOUND", "REGEX"):
            self.need("(")
            args = [self.expression()]
            while self.sign(","):
                args.append(self.expression())
            self.need(")")
            if len(args) != (1 if text.upper() in ("STR", "BOUND") else 2):
                raise SparqlError(f"{text} has another number of arguments")
            return (text.upper(), *args)
        if kind == "iri" or (kind == "name" and ":" in text):
            self.at -= 1
            return ("node", self.term().value)
        raise SparqlError(f"{text!r} isn't supported in a filter")


def text_of(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), quoted[1:-1])


# Compilation: a relation has the columns build_id and its variables.

EDGES = {"b:reads": ("reads", "file_node"), "b:writes": ("writes", "file_node"), "b:executable": ("executable", "file_node"), "b:creates": ("creates", "child_node"), "b:cmd": ("process_cmd", "cmd"), "b:start": ("process_start", "start_ts"), "b:env": ("process_env", "entry")}
OF_FILE = {"b:name": "name", "b:abspath": "abspath", "b:hash": "hash"}
#: Properties whose objects are texts; those of all others are nodes or names.
TEXTS = {"b:cmd", "b:start", "b:end", "b:env", "b:pid", "b:size", *OF_FILE}


@dataclass
class Relation:
    """kinds: whether each variable is a text (else a node or name); None where it may be either, as the column flag(variable)
    says. loose: variables that may be unbound."""

    rows: DataFrame
    kinds: dict[str, bool | None]
    loose: set[str] = field(default_factory=set)

    def is_text(self, v: str) -> Column:
        return F.col(flag(v)) if self.kinds[v] is None else F.lit(self.kinds[v])


def flag(v: str) -> str:
    return f"{v} is text"


def _pattern(g: Graph, p: str) -> tuple[DataFrame, bool | None]:
    """build_id, s, o of a predicate, from the table that holds it, and o's kind; of a graph that was read as triples, from these."""
    if p.startswith("b:") and p not in {*TEXTS, *EDGES, "b:rename", "b:rename-from", "b:rename-to"}:
        raise SparqlError(f"unknown property {p}")
    if g.said is not None:
        rows = g.said.where(F.col("p") == p)
        return rows.select("build_id", "s", "o", (F.col("o_kind") == "literal").alias(flag("o"))), None
    cols = lambda df, s, o: (df.select("build_id", F.col(s).alias("s"), F.col(o).alias("o")), p in TEXTS)
    if p == "a":
        kinds = g.typed.select("build_id", F.col("pid_node").alias("s"), F.lit("b:process").alias("o"))
        return kinds.unionByName(g.file.select("build_id", F.col("file_node").alias("s"), F.lit("b:file").alias("o"))), False
    if p in EDGES:
        name, o = EDGES[p]
        return cols(getattr(g, name), "pid_node", o)
    if p in OF_FILE:
        return cols(g.file.where(F.col(OF_FILE[p]).isNotNull()), "file_node", OF_FILE[p])
    if p == "b:end":
        return cols(g.process.where("end_ts is not null"), "pid_node", "end_ts")
    if p == "b:rename":
        return cols(g.rename, "pid_node", "rename_node")
    if p in ("b:rename-from", "b:rename-to"):
        return cols(g.rename, "rename_node", "from_node" if p == "b:rename-from" else "to_node")
    if p in ("b:pid", "b:size"):
        return cols(g.file.where(F.lit(False)), "file_node", "hash")
    raise SparqlError(f"unknown property {p}")


def _nodes(g: Graph) -> DataFrame:
    """build_id, s: every node, name and blank node that is a subject or an object."""
    t = g.triples()
    return t.select("build_id", "s").union(t.where("o_kind <> 'literal'").select("build_id", "o")).distinct()


def _path(g: Graph, path: Term | tuple, s: Var | Term, o: Var | Term) -> DataFrame:
    """build_id, s, o of a path between nodes. A fixpoint begins at its subject or its object if that is given."""
    if isinstance(path, Term):
        if path.value in TEXTS:
            raise SparqlError(f"{path.value} leads to texts, so it can't stand in a path")
        rows, kind = _pattern(g, path.value)
        return (rows.where(~F.col(flag("o"))) if kind is None else rows).select("build_id", "s", "o")
    op, anything = path[0], Var("")
    if op == "^":
        return _path(g, path[1], o, s).select("build_id", F.col("o").alias("s"), F.col("s").alias("o"))
    if op == "|":
        return _path(g, path[1], s, o).unionByName(_path(g, path[2], s, o))
    if op == "/":
        left = _path(g, path[1], s, anything).withColumnsRenamed({"o": "mid"})
        right = _path(g, path[2], anything, o).withColumnsRenamed({"s": "mid"})
        return left.join(right, ["build_id", "mid"]).select("build_id", "s", "o")
    once = _path(g, path[1], anything, anything).distinct()
    if op == "?":
        far = once
    elif isinstance(s, Term):
        far = closure(once, F.col("s") == s.value)
    elif isinstance(o, Term):
        back = once.select("build_id", F.col("o").alias("s"), F.col("s").alias("o"))
        far = closure(back, F.col("s") == o.value).select("build_id", F.col("o").alias("s"), F.col("s").alias("o"))
    else:
        far = closure(once)
    return far if op == "+" else far.unionByName(_nodes(g).select("build_id", "s", F.col("s").alias("o"))).distinct()


def _relation(g: Graph, pattern: tuple) -> Relation:
    s, p, o = pattern
    kinds: dict[str, bool | None] = {"s": False, "p": False}
    if isinstance(p, Var):
        rows = g.triples().select("build_id", "s", "p", "o", (F.col("o_kind") == "literal").alias(flag("o")))
        kinds["o"] = None
    elif isinstance(p, tuple):
        rows, kinds["o"] = _path(g, p, s, o), False
    elif g.said is None and p.value == "a" and o in (Term("b:process"), Term("b:file")):
        table, node = (g.typed, "pid_node") if o.value == "b:process" else (g.file, "file_node")
        rows, kinds["o"] = table.select("build_id", F.col(node).alias("s"), F.lit(o.value).alias("o")), False
    else:
        rows, kinds["o"] = _pattern(g, p.value)
    is_text = lambda name: F.col(flag(name)) if kinds[name] is None else F.lit(kinds[name])
    bound: dict[str, str] = {}
    for name, t in (("s", s), ("p", p), ("o", o)):
        if isinstance(t, Var):
            if t.name in bound:
                rows = rows.where((F.col(bound[t.name]) == F.col(name)) & (is_text(bound[t.name]) == is_text(name)))
            else:
                bound[t.name] = name
        elif name != "p":
            rows = rows.where((F.col(name) == t.value) & (is_text(name) == F.lit(t.literal)))
    flags = [F.col(flag(c)).alias(flag(v)) for v, c in bound.items() if kinds[c] is None]
    return Relation(rows.select("build_id", *(F.col(c).alias(v) for v, c in bound.items()), *flags), {v: kinds[c] for v, c in bound.items()})


def _meet(g: Graph, left: Relation, right: Relation, how: str, test: tuple | None = None) -> Relation:
    """Rows of left with the compatible rows of right: inner, left, left_semi or left_anti. test: a filter that both must pass."""
    shared = [v for v in right.kinds if v in left.kinds]
    loose = {v for v in shared if v in left.loose | right.loose}
    if not set(shared) - loose:
        raise SparqlError("patterns that share no variable which is always bound aren't supported: their product isn't bounded")
    theirs = {c: f"right {c}" for c in right.rows.columns}
    other = right.rows.select(*(F.col(c).alias(n) for c, n in theirs.items()))
    kind = lambda r, v, named: F.col(named(flag(v))) if r.kinds[v] is None else F.lit(r.kinds[v])
    mine = lambda c: c
    match = F.col("build_id") == F.col(theirs["build_id"])
    for v in shared:
        same = F.col(v) == F.col(theirs[v])
        if left.kinds[v] is None or right.kinds[v] is None or left.kinds[v] != right.kinds[v]:
            same &= kind(left, v, mine) == kind(right, v, theirs.get)
        match &= same if v not in loose else same | F.col(v).isNull() | F.col(theirs[v]).isNull()
    both = {v: (F.col(v), kind(left, v, mine)) for v in left.kinds}
    both |= {v: (F.col(theirs[v]), kind(right, v, theirs.get)) for v in right.kinds if v not in both or (v in loose and how in ("left_semi", "left_anti") and test)}
    if test:
        match &= F.coalesce(_truth(test, both), F.lit(False))
    by = [v for v in shared if v not in loose]
    joined = dealt(left.rows, g.parts, "build_id", *by).join(dealt(other, g.parts, *(theirs[c] for c in ("build_id", *by))), match, how)
    if how in ("left_semi", "left_anti"):
        return Relation(joined, left.kinds, left.loose)
    kinds, columns = dict(left.kinds), ["build_id"]
    for v in [*left.kinds, *(v for v in right.kinds if v not in left.kinds)]:
        if v not in left.kinds:
            kinds[v] = right.kinds[v]
            columns.append(F.col(theirs[v]).alias(v))
            columns += [F.col(theirs[flag(v)]).alias(flag(v))] if kinds[v] is None else []
        elif v in loose:
            kinds[v] = left.kinds[v] if left.kinds[v] == right.kinds[v] else None
            columns.append(F.coalesce(F.col(v), F.col(theirs[v])).alias(v))
            if kinds[v] is None:
                columns.append(F.when(F.col(v).isNotNull(), kind(left, v, mine)).otherwise(kind(right, v, theirs.get)).alias(flag(v)))
        else:
            columns += [v, flag(v)] if kinds[v] is None else [v]
    unbound = set(right.kinds) - set(left.kinds) if how == "left" else set()
    still = {v for v in left.loose | right.loose | unbound if not (v in loose and how == "inner" and not (v in left.loose and v in right.loose))}
    return Relation(joined.select(*columns), kinds, still)


def _mentioned(e: tuple) -> set[str]:
    """The variables of an expression."""
    return {e[1]} if e[0] == "var" else set().union(*(_mentioned(x) for x in e[1:] if isinstance(x, tuple)))


def _term(e: tuple, known: dict[str, tuple[Column, Column]]) -> tuple[Column, Column | None]:
    """The value of an operand, and whether it is a text; None of a number."""
    if e[0] == "var":
        return known.get(e[1], (F.lit(None).cast("string"), F.lit(None).cast("boolean")))
    if e[0] == "number":
        return F.lit(e[1]), None
    if e[0] in ("text", "node"):
        return F.lit(e[1]), F.lit(e[0] == "text")
    if e[0] == "STR":
        value, is_text = _term(e[1], known)
        if is_text is None:
            raise SparqlError("STR of a number isn't supported")
        return F.when(is_text, value).otherwise(iri_of(value)), F.lit(True)
    raise SparqlError("a truth value isn't supported as an operand")


def _truth(e: tuple, known: dict[str, tuple[Column, Column]]) -> Column:
    """A filter's truth, null where it is an error. known: of each variable its value, and whether it is a text; one that isn't
    there is unbound."""
    op = e[0]
    if op == "BOUND":
        return _term(e[1], known)[0].isNotNull()
    if op == "not":
        return ~_truth(e[1], known)
    if op in ("or", "and"):
        a, b = _truth(e[1], known), _truth(e[2], known)
        return a | b if op == "or" else a & b
    if op not in ("=", "!=", "<", ">", "<=", ">=", "CONTAINS", "STRSTARTS", "STRENDS", "REGEX"):
        raise SparqlError("a filter needs a comparison")
    (a, a_text), (b, b_text) = _term(e[1], known), _term(e[2], known)
    if a_text is None or b_text is None:
        if op not in ("=", "!=", "<", ">", "<=", ">="):
            raise SparqlError(f"{op} needs texts")
        a, b = (x if t is None else F.when(t, x.try_cast("double")) for x, t in ((a, a_text), (b, b_text)))
        texts = F.lit(True)
    else:
        texts = a_text & b_text
    compared = {"=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "CONTAINS": lambda: a.contains(b), "STRSTARTS": lambda: a.startswith(b), "STRENDS": lambda: a.endswith(b), "REGEX": lambda: F.regexp_like(a, b)}[op]()
    if op in ("=", "!=") and a_text is not None and b_text is not None:
        same = (a == b) & (a_text == b_text)
        return same if op == "=" else ~same
    return F.when(texts, compared)


def _known(r: Relation) -> dict[str, tuple[Column, Column]]:
    return {v: (F.col(v), r.is_text(v)) for v in r.kinds}


def _group(g: Graph, group: Group, around: frozenset[str] = frozenset()) -> Relation:
    """The group's rows. around: variables of the groups around that only an EXISTS lets a filter see; elsewhere such a filter
    is refused."""
    waiting = [_relation(g, p) for p in group.patterns]
    for choices in group.unions:
        parts = [_group(g, c, around) for c in choices]
        kinds: dict[str, bool | None] = {}
        for r in parts:
            for v, k in r.kinds.items():
                kinds[v] = k if kinds.get(v, k) == k else None
        loose = set().union(*(r.loose | (set(kinds) - set(r.kinds)) for r in parts))
        one = None
        for r in parts:
            columns = ["build_id"]
            for v, k in kinds.items():
                columns.append(F.col(v) if v in r.kinds else F.lit(None).cast("string").alias(v))
                columns += [(r.is_text(v) if v in r.kinds else F.lit(None).cast("boolean")).alias(flag(v))] if k is None else []
            rows = r.rows.select(*columns)
            one = rows if one is None else one.unionByName(rows)
        waiting.append(Relation(one, kinds, loose))
    if not waiting:
        raise SparqlError("a group needs a triple pattern")
    out = waiting.pop(0)
    while waiting:
        i = next((i for i, w in enumerate(waiting) if (set(w.kinds) & set(out.kinds)) - w.loose - out.loose), 0)
        out = _meet(g, out, waiting.pop(i), "inner")
    for optional in group.optionals:
        out = _meet(g, out, _group(g, optional, around | set(out.kinds)), "left")
    for inner in group.minus:
        right = _group(g, inner, frozenset())
        if set(right.kinds) & set(out.kinds):  # else nothing is taken away
            out = _meet(g, out, right, "left_anti")
    for there, inner in group.exists:
        out = _exists(g, out, inner, there, around)
    for f in group.filters:
        if _mentioned(f) & around - set(out.kinds):
            raise SparqlError("a filter uses a variable of a group around its own, which is supported directly in EXISTS only")
        out = Relation(out.rows.where(_truth(f, _known(out))), out.kinds, out.loose)
    return out


def _exists(g: Graph, rows: Relation, inner: Group, there: bool, around: frozenset[str]) -> Relation:
    """rows that have (or haven't) a match in inner. Its filters that use variables of rows become part of the join."""
    right = _group(g, replace(inner, filters=[]), frozenset(around | set(rows.kinds)))
    shared_test = None
    for f in inner.filters:
        if _mentioned(f) & around - set(rows.kinds) - set(right.kinds):
            raise SparqlError("a filter in EXISTS uses a variable from further out than the group around it")
        if _mentioned(f) & set(rows.kinds) - set(right.kinds):
            shared_test = f if shared_test is None else ("and", shared_test, f)
        else:
            right = Relation(right.rows.where(_truth(f, _known(right))), right.kinds, right.loose)
    used = {v for v in right.kinds if v in rows.kinds or (shared_test and v in _mentioned(shared_test))}
    kept = {v: k for v, k in right.kinds.items() if v in used}
    columns = [c for v, k in kept.items() for c in ([v, flag(v)] if k is None else [v])]
    few = Relation(right.rows.select("build_id", *columns).distinct(), kept, right.loose & used)
    return _meet(g, rows, few, "left_semi" if there else "left_anti", shared_test)


def compile_query(g: Graph, text: str) -> DataFrame:
    q = Parser(text).query()
    found = _group(g, q.where)
    rows, known = found.rows, set(found.kinds)
    if q.select == [("all",)]:
        q.select = [("var", v) for v in found.kinds if not v.startswith("_blank_")]
    columns = [x[1] for x in q.select if x[0] == "var"]
    aggregates = [x for x in q.select if x[0] != "var"]
    for v in (*columns, *q.group_by, *(x[1] for x in aggregates if x[1] != "*")):
        if v not in known:
            raise SparqlError(f"?{v} isn't bound in the pattern")
    with_flags = lambda names: [c for v in names for c in ([v, flag(v)] if found.kinds.get(v, False) is None else [v])]
    if q.having and not (aggregates or q.group_by):
        raise SparqlError("HAVING needs groups")
    if aggregates or q.group_by:
        if set(columns) - set(q.group_by):
            raise SparqlError("a selected variable isn't grouped by")
        made = []
        for what, arg, name, once in aggregates:
            if arg == "*":
                x = F.lit(1)
            else:
                x = F.when(F.col(arg).isNotNull(), F.struct(arg, flag(arg))) if once and found.kinds[arg] is None else F.col(arg)
            made.append(({"COUNT": F.count_distinct if once else F.count, "MIN": F.min, "MAX": F.max}[what](x)).alias(name))
        by = with_flags(q.group_by)
        rows = rows.groupBy(*by).agg(*made) if made else rows.select(*by).distinct()
        numbers = {x[2] for x in aggregates if x[0] == "COUNT"}
        for h in q.having:
            if _mentioned(h) - set(q.group_by) - {x[2] for x in aggregates}:
                raise SparqlError("HAVING may use what is grouped by and the names of aggregates")
            terms = {v: (F.col(v), found.is_text(v)) for v in q.group_by} | {x[2]: (F.col(x[2]), None if x[2] in numbers else F.lit(True)) for x in aggregates}
            rows = rows.where(_truth(h, terms))
        rows = rows.select(*with_flags(columns), *(x[2] for x in aggregates))
    for v, _ in q.order_by:
        if v not in rows.columns:
            raise SparqlError(f"?{v} can't be ordered by")
    if not (aggregates or q.group_by):
        kept = list(dict.fromkeys([*columns, *(v for v, _ in q.order_by)])) if not q.distinct else columns
        rows = rows.select(*with_flags(kept))
    if q.distinct:
        rows = rows.distinct()
    if q.order_by:
        rest = [F.col(c) for c in columns if c not in {v for v, _ in q.order_by}] if q.limit is not None else []
        order = [(c, down) for v, down in q.order_by for c in ([flag(v), v] if found.kinds.get(v, False) is None else [v])]
        rows = rows.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order), *rest)
    if q.offset:
        rows = rows.offset(q.offset)
    if q.limit is not None:
        rows = rows.limit(q.limit)
    return rows.select(*columns, *(x[2] for x in aggregates))
