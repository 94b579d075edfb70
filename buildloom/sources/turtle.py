"""Provenance files in Turtle: a schema header, then one statement on each line; and general Turtle.

The recorder's writer escapes line ends in literals, so a data line is a whole statement and files can be split anywhere. A
line may hold `;` and `,` lists of names, IRIs, labels and texts in double quotes. A line is read only if all of it is
understood; of a file in which some line isn't, or that binds a prefix twice, each statement is read by its tokens, in
whatever layout, a task for each such file (see turtle_text). What isn't understood there is listed, not dropped unseen.
Names are kept as :local and b:local: full IRIs and names of any prefix that a file binds are brought to that form by their
namespaces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import DATA, RDF, VOCABULARY, escape, unescape
from ..plans.model import TRIPLES, dealt, tasks
from ..storage import scratch, ship, stored
from .turtle_text import Reader

#: A literal, an IRI, a sign of lists and ends, or a name; and any other run of characters, which is none of these.
_LITERAL = r'"(?:[^"\\\n]|\\[tbnrf"\'\\])*+"(?:\^\^(?:<[^<>\s]*>|[\w.-]*:[\w.-]*\w)|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?'
_LABEL, _LOCAL = r"_:\w(?:[\w.-]*[\w-])?", r"(?:[\w:](?:[\w:.-]*[\w:-])?)?"
_NAME = rf"{_LABEL}|(?:[A-Za-z](?:[\w.-]*[\w-])?)?:{_LOCAL}"
TOKEN = rf'{_LITERAL}(?=[\s;,]|\.?\s*$)|<[^<>"{{}}|^`\\\s]*>|{_NAME}|\ba\b|[;,]|\.(?=\s*$)|[^\s]+'
#: A token of each kind that a line may hold, as a letter, and the order in which they may stand in it.
KINDS = (("n", rf"^(?:<.*>|{_NAME})$"), ("l", f"^{_LITERAL}$"), ("a", "^a$"), (";", "^;$"), (",", "^,$"), (".", r"^\.$"))
SHAPE = r"^n[na][nl](?:,[nl])*(?:;+[na][nl](?:,[nl])*)*;*\.$"
#: A line of one triple, as statements() writes it: what most lines are.
PLAIN = rf'^(?:{_LABEL}|:{_LOCAL})\s+(?:a|b:{_LOCAL})\s+(?:{_LABEL}|b?:{_LOCAL}|"(?:[^"\\\n]++|\\[tbnrf"\'\\])*+")\s*\.\s*\z'

# The vocabulary: property, label, domain, range, comment.
CLASSES = (("process", "Process", "Represents a process."), ("file", "File", "Represents a file."))
PROPERTIES = (
    ("pid", "PID", "b:process", "xsd:integer", "the process ID."),
    ("cmd", "Command", "b:process", "xsd:string", "The actual command line, obtained by concatenating all arguments separated by white space."),
    ("start", "Process start", "b:process", "xsd:dateTime", "The start timestamp."),
    ("end", "Process end", "b:process", "xsd:dateTime", "The end timestamp."),
    ("env", "Environment entry", "b:process", "xsd:string", 'An environment entry in the form of "VAR=value".'),
    ("name", "File name", "b:file", "xsd:string", "The file name."),
    ("size", "File size", "b:file", "xsd:integer", "The file size in bytes."),
    ("hash", "File checksum", "b:file", "xsd:string", "A hexadecimal string representing a unique, git-compatible hash of the file's content."),
    ("abspath", "File absolute path", "b:file", "xsd:string", "The absolute path of the file."),
    ("creates", "Creates", "b:process", "b:process", "Indicates that a process creates another process."),
    ("reads", "Reads", "b:process", "b:file", "Indicates that a process reads a file."),
    ("writes", "Writes", "b:process", "b:file", "Indicates that a process writes a file."),
    ("executable", "Executable", "b:process", "b:file", "Indicates that a process is an executable file."),
)


def schema_triples() -> list[tuple[str, str, str, str]]:
    """The 71 statements about the vocabulary itself that stand at the head of every file."""
    out = []
    for name, label, comment in CLASSES:
        out += [(f"b:{name}", "a", "rdfs:Class", "iri"), (f"b:{name}", "rdfs:label", label, "literal"), (f"b:{name}", "rdfs:comment", comment, "literal")]
    for name, label, domain, range_, comment in PROPERTIES:
        out += [(f"b:{name}", "a", "rdf:Property", "iri"), (f"b:{name}", "rdfs:label", label, "literal"), (f"b:{name}", "rdfs:domain", domain, "iri"), (f"b:{name}", "rdfs:range", range_, "iri"), (f"b:{name}", "rdfs:comment", comment, "literal")]
    return out


def header(data: str = DATA, vocabulary: str = VOCABULARY) -> str:
    quote = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    prefixes = (("", data), ("b", vocabulary), ("xsd", "http://www.w3.org/2001/XMLSchema#"), ("rdf", RDF), ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"))
    lines = [f"@prefix {p}: <{iri}> ." for p, iri in prefixes]
    subject = None
    for s, p, o, kind in schema_triples():
        put = quote(o) if kind == "literal" else o
        if s != subject:
            if subject:
                lines[-1] += " ."
            lines += ["", f"{s} {p} {put}"]
        else:
            lines[-1] += " ;"
            lines.append(f"    {p} {put}")
        subject = s
    return "\n".join([*lines[:-1], lines[-1] + " .", ""])


#: What a file's prefixes stand for that it doesn't bind itself, if it binds none.
USUAL = {"": DATA, "b": VOCABULARY, "xsd": "http://www.w3.org/2001/XMLSchema#", "rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}


def _usual() -> Column:
    return F.create_map(*[F.lit(x) for pair in USUAL.items() for x in pair])


def _prefix(term: Column) -> Column:
    """The prefix of a name; null of anything else."""
    return F.when(term.rlike(rf"^(?:{_NAME})$") & ~F.startswith(term, F.lit("_:")), F.substring_index(term, ":", 1))


def _name(term: Column, prefixes: Column) -> Column:
    """A term as :local, b:local, a or _:label; names of namespaces that are neither vocabulary nor data become whole IRIs."""
    space = F.try_element_at(prefixes, _prefix(term))
    iri = F.coalesce(F.concat(space, F.regexp_replace(term, "^[^:]*:", "")), F.regexp_extract(term, r"^<(.*)>$", 1))

    def short(iri: Column) -> Column:
        local = lambda kind: F.regexp_extract(iri, rf"\b{kind}#([^#]*)$", 1)
        out = F.when(iri == RDF + "type", F.lit("a"))
        out = out.when(iri.rlike(r"\brdf#[^#]*$"), F.concat(F.lit("b:"), local("rdf"))).when(iri.rlike(r"\bdata#[^#]*$"), F.concat(F.lit(":"), local("data")))
        return out.when(iri != "", F.concat(F.lit("<"), iri, F.lit(">"))).otherwise(term)

    # A list of one, so that the IRI is worked out once.
    return F.transform(F.array(iri), short)[0]


def _named(t: Column, prefixes: Column) -> Column:
    """A triple of terms with its names brought to their form and what follows a text's quotes left out."""
    text = F.regexp_extract(t["o"], r'(?s)^(".*")(?:\^\^\S+|@\S+)?$', 1)
    o = F.when(F.startswith(t["o"], F.lit('"')), text).otherwise(_name(t["o"], prefixes))
    return F.struct(_name(t["s"], prefixes).alias("s"), _name(t["p"], prefixes).alias("p"), o.alias("o"))


def _tokens(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0))


def _spelled_out(tokens: Column) -> Column:
    """The s, p, o terms of a statement's triples: its tokens are taken in turn, `;` keeps the subject and `,` the predicate."""
    triples = "array<struct<s:string,p:string,o:string>>"
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("s"), F.lit("").alias("p"), F.array().cast(triples).alias("out"))

    def step(x: Column, t: Column) -> Column:
        sign = F.when(t == ";", 1).when(t == ",", 2).when(t == ".", 0)
        said = sign.isNull() & (x["at"] == 2)
        made = F.array(F.struct(x["s"].alias("s"), x["p"].alias("p"), t.alias("o")))
        return F.struct(
            F.coalesce(sign, x["at"] + 1).alias("at"),
            F.when(sign.isNull() & (x["at"] == 0), t).otherwise(x["s"]).alias("s"),
            F.when(sign.isNull() & (x["at"] == 1), t).otherwise(x["p"]).alias("p"),
            F.when(said, F.concat(x["out"], made)).otherwise(x["out"]).alias("out"),
        )

    return F.aggregate(tokens, start, step, lambda x: x["out"])


def _is_data(value: Column) -> Column:
    """Neither blank nor a comment, a prefix, or part of the vocabulary's own description."""
    return ~value.rlike(r"^\s*(#|b:|$)") & ~value.rlike(rf"^\s*{PREFIX}\s*$") & ~value.rlike(r"^\s+(a|rdfs:\w+)\s")


def _plain(value: Column, prefixes: Column) -> Column:
    """Whether a line is PLAIN, where : and b: are the namespaces whose names are kept as they are: a data line that is
    understood and whose terms need no change, told by one look instead of by its tokens."""
    ends = lambda prefix, kind: F.coalesce(F.try_element_at(prefixes, F.lit(prefix)).rlike(rf"\b{kind}#\z"), F.lit(False))
    return F.coalesce(ends("", "data") & ends("b", "rdf") & value.rlike(PLAIN), F.lit(False))


PREFIX = r"@prefix\s+([^\s:]*):\s*<([^<>\s]*)>\s*\."


def _understood(tokens: Column, prefixes: Column) -> Column:
    """Whether a line's tokens are one whole statement: each token of a known kind, in an order that a statement may have,
    each prefix bound."""

    def kind(t: Column) -> Column:
        out = None
        for letter, pattern in KINDS:
            out = F.when(t.rlike(pattern), letter) if out is None else out.when(t.rlike(pattern), letter)
        return out.otherwise("x")

    bound = F.forall(tokens, lambda t: F.coalesce(F.map_contains_key(prefixes, _prefix(t)), F.lit(True)))
    return F.array_join(F.transform(tokens, kind), "").rlike(SHAPE) & bound


def _dealt(rows: DataFrame) -> DataFrame:
    """rows in equal shares: what they are made from may be a few large splits, and reading statements is far more work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def parse_lines(lines: DataFrame, prefixes: str | None = None, about: int | None = None) -> DataFrame:
    """Triples (a set) of the statements in (build_id, value), each of which is whole; others are left out (see unread).
    prefixes: the column of a map from a prefix to its namespace; lines without one are dealt to all tasks first. about: how
    many triples there are, if that is known; then the set of a task doesn't grow with their number."""
    known = (lines if prefixes else _dealt(lines.select("build_id", "value"))).withColumn("prefixes", F.col(prefixes) if prefixes else _usual())
    value, spaces = F.col("value"), F.col("prefixes")
    # A plain line's terms and another's tokens are columns of their own, so that each is found once.
    x = known.withColumn("terms", F.when(_plain(value, spaces), F.split(value, r"\s+", 3)))
    x = x.withColumn("tokens", F.when(F.isnull("terms") & _is_data(value), _tokens(value)))
    triple = F.struct(F.col("terms")[0].alias("s"), F.col("terms")[1].alias("p"), F.rtrim(F.col("terms")[2], F.lit(". \t\n\x0b\f\r")).alias("o"))
    said = F.when(F.isnotnull("terms"), F.array(triple)).when(_understood(F.col("tokens"), spaces), F.transform(_spelled_out(F.col("tokens")), lambda t: _named(t, spaces)))
    # Outer, as for an inner explode Spark would add a filter that works the list out once more.
    got = x.select("build_id", said.alias("said")).select("build_id", F.explode_outer("said").alias("t")).where("t is not null").select("build_id", "t.*")
    is_text = F.startswith("o", F.lit('"'))
    text = unescape(F.substr("o", F.lit(2), F.length("o") - 2))
    kind = F.when(is_text, "literal").when(F.startswith("o", F.lit("_:")), "bnode").otherwise("iri")
    out = got.where(~F.startswith("s", F.lit("b:"))).select("build_id", "s", "p", F.when(is_text, text).otherwise(F.col("o")).alias("o"), kind.alias("o_kind"))
    return dealt(out, tasks(out.sparkSession, about), "build_id", "s", "p", "o").distinct()


def unread(lines: DataFrame, prefixes: str | None = None) -> DataFrame:
    """The data lines that parse_lines can't read: neither a whole statement nor anything else that may stand in a file."""
    value, spaces = F.col("value"), F.col(prefixes) if prefixes else _usual()
    return lines.where(~_plain(value, spaces) & _is_data(value) & ~_understood(_tokens(value), spaces))


def parse_texts(texts: DataFrame) -> DataFrame:
    """build_id, s, p, o, o_kind, unread, line of (build_id, value), each value a whole Turtle text in any layout: a row for
    each triple, and one for each statement that isn't understood, with its text and first line (else null). Blank nodes
    without a label get one that the text doesn't have."""
    ship(texts.sparkSession)
    names = ["build_id", "s", "p", "o", "o_kind", "unread", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for build, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows, line, at = [], 1, 0
                for triples, bad, start in Reader(text or "", {} if (text or "").find(":") < 0 else usual_of(text)).statements():
                    if bad is None:
                        rows += [(build, *t, None, None) for t in triples if not t[0].startswith("b:")]
                    else:
                        line, at = line + text.count("\n", at, start), start
                        rows.append((build, None, None, None, None, bad, line))
                    if len(rows) >= 10_000:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    def usual_of(text: str) -> dict[str, str]:
        import re

        return {} if re.search(r"(?im)^\s*@?prefix\b", text) else USUAL

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:6]), pa.array(cols[6], pa.int32())], names=names)

    return _dealt(texts.select("build_id", "value")).mapInArrow(run, f"{TRIPLES}, unread string, line int")


def _prefixes(lines: DataFrame) -> DataFrame:
    """file, prefixes, twice: what each file binds, and whether it binds a prefix to two namespaces; a row for each file."""
    line = rf"^\s*{PREFIX}"
    bound = lines.where(F.col("value").rlike(line)).groupBy("file", F.regexp_extract("value", line, 1).alias("prefix"))
    bound = bound.agg(F.min(F.regexp_extract("value", line, 2)).alias("space"), F.max(F.regexp_extract("value", line, 2)).alias("other"))
    return bound.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "space"))).alias("prefixes"), F.max(F.col("space") != F.col("other")).alias("twice"))


#: A file's prefixes are broadcast to its lines up to this many files; as many may need to be read whole.
MOST_FILES = 100_000


@dataclass(frozen=True)
class Loaded:
    """triples: of every statement that was understood. unread: build_id, unread, line of those that weren't."""

    triples: DataFrame
    unread: DataFrame


def load(spark: SparkSession, path: str, with_schema: bool = False, whole: bool = False) -> Loaded:
    """One file, or all files that path names; build_id is the file's stem without `-build`.

    Files are read line by line, each line a statement. Those that aren't written so are found in a first pass and read
    whole, one task each; with whole, all are. The schema header is served from the fixed vocabulary, if asked for."""
    stem = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1), "-build", "").alias("build_id")
    file = F.col("_metadata.file_path").alias("file")
    lines = spark.read.text(path).select(file, stem, "value")
    odd: list[str] = []
    plain = None
    if not whole:
        bound = _prefixes(lines)
        few = bound.limit(MOST_FILES + 1).count() <= MOST_FILES
        known = lines.join(F.broadcast(bound) if few else bound, "file", "left").withColumn("prefixes", F.coalesce("prefixes", _usual()))
        strange = unread(known, "prefixes").select("file").union(bound.where("twice").select("file")).distinct()
        odd = [r["file"] for r in strange.limit(MOST_FILES + 1).collect()]
        if len(odd) > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} files aren't a statement on each line: read them in parts")
        plain = parse_lines(known.where(~F.col("file").isin(odd)) if odd and len(odd) <= 100 else known.join(F.broadcast(strange), "file", "left_anti") if odd else known, "prefixes")
    none = spark.createDataFrame([], "build_id string, unread string, line int")
    triples, missed = plain, none
    if whole or odd:
        general = parse_texts(spark.read.text(path if whole else odd, wholetext=True).select(stem, "value"))
        said = general.where("unread is null").select("build_id", "s", "p", "o", "o_kind").distinct()
        triples = said if plain is None else plain.unionByName(said)
        missed = general.where("unread is not null").select("build_id", "unread", "line")
    if with_schema:
        builds = lines.select("build_id").distinct()
        fixed = spark.createDataFrame(schema_triples(), "s string, p string, o string, o_kind string")
        triples = triples.unionByName(builds.crossJoin(F.broadcast(fixed)).select(*triples.columns))
    return Loaded(triples, missed)


def read_turtle(spark: SparkSession, path: str, with_schema: bool = False, whole: bool = False) -> DataFrame:
    """The triples that load finds."""
    return load(spark, path, with_schema, whole).triples


def statements(triples: DataFrame) -> DataFrame:
    """Each triple as a line."""
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escape("o"), F.lit('"'))).otherwise(F.col("o"))
    return triples.select("build_id", F.concat_ws("\t", "s", "p", F.concat(o, F.lit(" ."))).alias("value"))


def write_turtle(triples: DataFrame, path: str) -> None:
    """A folder for each build with text files of statements; files are readable one by one or together."""
    statements(triples).write.mode("overwrite").partitionBy("build_id").text(path)


def write_one(triples: DataFrame, path: str) -> None:
    """One file with its header. Statements are worked out by all tasks and put together by one of them; the file gets its
    name when it is whole, so a failed job leaves none. A path without a scheme is on the driver's machine."""
    spark = triples.sparkSession
    lines = stored(statements(triples).select("value"), "statements")
    at = scratch(spark, "one")
    # Partitions keep their order: the header's comes first.
    spark.createDataFrame([(header(),)], "value string").union(lines).coalesce(1).write.text(at)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(at)
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    part = next(f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
    if "://" in path:
        store.delete(hadoop.Path(path), False)
        if not store.rename(part, hadoop.Path(path)):
            raise OSError(f"{path} can't be written")
    else:
        store.copyToLocalFile(True, part, hadoop.Path("file://" + os.path.abspath(path)), True)
    store.delete(folder, True)


def from_rows(spark: SparkSession, rows: list[tuple[str, str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, TRIPLES)
