"""Statements of one Turtle text, in whatever layout: what tasks apply to files that aren't a statement on each line.

A text is read as a sequence of tokens, each statement by itself. A statement that isn't understood whole gives no triple
but its own text, and reading goes on after its full stop; nothing is guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from ..functions.scalar import RDF

_ESCAPE = r"\\(?:[tbnrf\"'\\]|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"
_LABEL = r"[\w\u00B7](?:[\w\u00B7.-]*[\w\u00B7-])?"
_LOCAL = r"(?:[\w:\u00B7]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])"
_TOKEN = re.compile(
    rf"""(?P<skip>[\x20\t\r\n]+|\#[^\n\r]*)
    |(?P<text>"{{3}}(?:"{{0,2}}(?:[^"\\]|{_ESCAPE}))*"{{3}}|'{{3}}(?:'{{0,2}}(?:[^'\\]|{_ESCAPE}))*'{{3}}|"(?!"")(?:[^"\\\n\r]|{_ESCAPE})*"|'(?!'')(?:[^'\\\n\r]|{_ESCAPE})*')
    |(?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
    |(?P<order>@prefix\b|@base\b)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)
    |(?P<label>_:{_LABEL})
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_](?:[\w\u00B7.-]*[\w\u00B7-])?)?:(?:{_LOCAL}(?:(?:{_LOCAL}|[.-])*(?:{_LOCAL}|-))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>[.;,\[\]()])""",
    re.X,
)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
#: A place where a statement that isn't understood may end.
_STOP = re.compile(r"\.(?=\s|$)")


class Unread(Exception):
    """A statement isn't understood."""


def unescaped(text: str) -> str:
    """A literal's or an IRI's characters."""

    def put(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" else _PLAIN.get(x, x)

    try:
        out = re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", put, text, flags=re.S)
        out.encode()
    except (ValueError, OverflowError) as e:
        raise Unread(f"no such character in {text!r}") from e
    return out


def local_name(iri: str) -> str:
    """An IRI as the graph has it: a, b:name in a namespace that ends in rdf#, :name in one that ends in data#, else <IRI>."""
    if iri == RDF + "type":
        return "a"
    m = re.search(r"\b(rdf|data)#([^#]*)$", iri)
    return (("b:" if m[1] == "rdf" else ":") + m[2]) if m else f"<{iri}>"


class Reader:
    def __init__(self, text: str, prefixes: dict[str, str]):
        self.text, self.prefixes, self.base, self.at = text, dict(prefixes), "", 0
        self.made, self.out = 0, []
        self.anon = "anon"
        while f"_:{self.anon}" in text:
            self.anon += "x"
        self.kind = self.token = ""
        self.began = self.end = 0

    def next(self) -> None:
        """The next token; kind is empty at the end of the text."""
        while True:
            if self.at >= len(self.text):
                self.kind, self.token, self.began = "", "", self.at
                return
            m = _TOKEN.match(self.text, self.at)
            if not m:
                self.began = self.at
                raise Unread("no token")
            self.began, self.at = self.at, m.end()
            if m.lastgroup != "skip":
                self.kind, self.token = m.lastgroup, m[0]
                return

    def sign(self, token: str) -> bool:
        if self.kind == "sign" and self.token == token:
            self.next()
            return True
        return False

    def need(self, ok: bool) -> None:
        if not ok:
            raise Unread(f"unexpected {self.token!r}")

    def statements(self) -> Iterator[tuple[list[tuple[str, str, str, str]], str | None, int]]:
        """Each statement's triples (s, p, o, kind), None and its first character; or none, its text and first character."""
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if m and m.lastgroup == "skip":
                self.at = m.end()
                continue
            start, held = self.at, (dict(self.prefixes), self.base, self.made)
            self.out = []
            try:
                self.next()
                self.end = 0
                self.statement()
                self.at = self.end
                yield self.out, None, start
            except (Unread, RecursionError):
                self.prefixes, self.base, self.made = held
                self.at = self.stop(start)
                yield [], self.text[start : self.at].strip(), start

    def stop(self, start: int) -> int:
        """Where reading goes on after a statement that isn't understood: past the next full stop outside of texts and IRIs."""
        at = start
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if m:
                at = m.end()
                if m.lastgroup == "sign" and m[0] == "." and (at == len(self.text) or self.text[at].isspace() or self.text[at] == "#"):
                    return at
            else:
                m = _STOP.match(self.text, at)
                if m:
                    return m.end()
                at += 1
        return at

    def statement(self) -> None:
        sparql = self.kind == "word" and self.token.upper() in ("PREFIX", "BASE")
        if sparql or self.kind == "order":
            what = self.token.lstrip("@").upper()
            self.next()
            if what == "PREFIX":
                self.need(self.kind == "name" and self.token.endswith(":"))
                name = self.token[:-1]
                self.need(":" not in name)
                self.next()
            self.need(self.kind == "iri")
            iri, self.end = self.iri(self.token), self.at
            if not sparql:
                self.next()
                self.need(self.kind == "sign" and self.token == ".")
                self.end = self.at
            if what == "PREFIX":
                self.prefixes[name] = iri
            else:
                self.base = iri
            return
        if self.kind == "sign" and self.token == "[":
            s = self.bracket()
            if not (self.kind == "sign" and self.token == "."):
                self.properties(s)
        else:
            s = self.collection() if self.kind == "sign" and self.token == "(" else self.node()
            self.properties(s)
        self.need(self.kind == "sign" and self.token == ".")
        self.end = self.at

    def iri(self, token: str) -> str:
        iri = unescaped(token[1:-1])
        return urljoin(self.base, iri) if self.base else iri

    def node(self) -> str:
        """An IRI, a name or a blank node's label."""
        kind, token = self.kind, self.token
        if kind == "iri":
            out = local_name(self.iri(token))
        elif kind == "name":
            prefix, _, name = token.partition(":")
            self.need(prefix in self.prefixes)
            out = local_name(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", name))
        else:
            self.need(kind == "label")
            out = token
        self.next()
        return out

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.anon}{self.made - 1}"

    def bracket(self) -> str:
        self.next()
        s = self.fresh()
        if not self.sign("]"):
            self.properties(s)
            self.need(self.sign("]"))
        return s

    def collection(self) -> str:
        self.next()
        items = []
        while not self.sign(")"):
            items.append(self.object())
        nil = f"<{RDF}nil>"
        nodes = [*(self.fresh() for _ in items), nil]
        for s, (o, kind), rest in zip(nodes, items, nodes[1:]):
            self.out += [(s, f"<{RDF}first>", o, kind), (s, f"<{RDF}rest>", rest, "iri" if rest == nil else "bnode")]
        return nodes[0]

    def properties(self, s: str) -> None:
        while True:
            if self.kind == "word" and self.token == "a":
                p = "a"
                self.next()
            else:
                self.need(self.kind in ("iri", "name"))
                p = self.node()
            while True:
                o, kind = self.object()
                self.out.append((s, p, o, kind))
                if not self.sign(","):
                    break
            if not self.sign(";"):
                return
            while self.sign(";"):
                pass
            if self.kind == "sign" and self.token in ".]":
                return

    def object(self) -> tuple[str, str]:
        kind, token = self.kind, self.token
        if kind == "text":
            quote = 3 if token[:3] in ('"""', "'''") else 1
            out = unescaped(token[quote:-quote])
            self.next()
            if self.kind == "lang":
                self.next()
            elif self.kind == "type":
                self.next()
                self.need(self.kind in ("iri", "name"))
                self.node()
            return out, "literal"
        if kind == "number" or (kind == "word" and token in ("true", "false")):
            self.next()
            return token, "literal"
        o = self.bracket() if token == "[" and kind == "sign" else self.collection() if token == "(" and kind == "sign" else self.node()
        return o, "bnode" if o.startswith("_:") else "iri"
