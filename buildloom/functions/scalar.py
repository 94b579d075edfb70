"""Column expressions for paths, hashes, literals, timestamps and command lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a process's argument list that are recorded.
CMDLINE_BYTES = 1023
TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    """What follows the last slash; empty if the path ends with one."""
    return F.substring_index(_col(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """What follows the last dot, or everything."""
    return F.substring_index(_col(path), ".", -1)


def extension(name: Column | str) -> Column:
    """A file name's last extension, `no-ext` without a dot: libx.so.1 has 1, .gitignore has gitignore."""
    return F.when(F.contains(_col(name), F.lit(".")), suffix(name)).otherwise(F.lit("no-ext"))


def shorten(x: Column | str, n: int) -> Column:
    return F.left(_col(x), F.lit(n))


def project_base(path: Column | str, checkout: bool = True) -> Column:
    """The project's folder at the head of a path: up to /BUILD/<name>/ or, with checkout, /build/src/; empty if there is none."""
    inner = r"/BUILD/[^/]+/|/build/src/" if checkout else r"/BUILD/[^/]+/"
    return F.regexp_extract(_col(path), rf"^(.*?(?:{inner}))", 1)


def parse_time(x: Column | str) -> Column:
    return F.to_timestamp(_col(x), TIMESTAMP)


def format_time(ts: Column | str) -> Column:
    return F.date_format(_col(ts), TIMESTAMP)


def seconds_between(first: Column, last: Column) -> Column:
    return F.unix_timestamp(parse_time(last)) - F.unix_timestamp(parse_time(first))


def blob_hash(content: Column | str) -> Column:
    """SHA-1 of a content as a version-control blob: "blob <size>", a zero byte, the bytes."""
    data = _col(content).cast("binary")
    head = F.concat(F.lit("blob "), F.octet_length(data).cast("string"))
    return F.sha1(F.concat(F.encode(head, "UTF-8"), F.unhex(F.lit("00")), data))


def command_line(args: Column | str) -> Column:
    """Arguments joined by spaces, those with a space in single quotes.

    Only what ends within the first CMDLINE_BYTES bytes is there, each argument taking one more byte than its own: a longer
    line ends with a space in place of what is left out, unless that begins just there. No argument: null."""
    grown = lambda acc, a: acc["bytes"] + F.octet_length(a) + 1
    whole = lambda acc, a: grown(acc, a) <= CMDLINE_BYTES
    quoted = lambda a: F.when(F.contains(a, F.lit(" ")), F.concat(F.lit("'"), a, F.lit("'"))).otherwise(a)
    start = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("held"), F.array().cast("array<string>").alias("args"))

    def take(acc: Column, a: Column) -> Column:
        held = F.when(whole(acc, a), grown(acc, a)).otherwise(acc["held"])
        listed = F.when(whole(acc, a), F.concat(acc["args"], F.array(quoted(a)))).otherwise(acc["args"])
        return F.struct(grown(acc, a).alias("bytes"), held.alias("held"), listed.alias("args"))

    def put(acc: Column) -> Column:
        more = (acc["bytes"] > CMDLINE_BYTES) & (acc["held"] > 0) & (acc["held"] < CMDLINE_BYTES)
        return F.when(acc["bytes"] > 0, F.concat(F.array_join(acc["args"], " "), F.when(more, F.lit(" ")).otherwise(F.lit(""))))

    return F.aggregate(_col(args), start, take, put)


def file_hash(content: Column | str, regular: Column) -> Column:
    """The hash of a regular file's (or link's) content; null for anything else, such as a device or a folder."""
    return F.when(regular, blob_hash(content))


def access_edges(flags: Column | str) -> Column:
    """The edges that the access mode of open flags stands for: reads, writes, both or none."""
    mode = _col(flags).bitwiseAND(3)
    return F.when(mode == 0, F.array(F.lit("reads"))).when(mode == 1, F.array(F.lit("writes"))).when(mode == 2, F.array(F.lit("reads"), F.lit("writes"))).otherwise(F.array().cast("array<string>"))


def escape(x: Column | str) -> Column:
    r"""A literal as it is written: backslash, quote, line feed and carriage return escaped, so a statement stays on one line."""
    out = F.replace(_col(x), F.lit("\\"), F.lit("\\\\"))
    for raw, put in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(put))
    return out


def unescape(x: Column | str) -> Column:
    """The reverse of escape, in one pass: what follows an escaped backslash isn't an escape."""

    def plain(part: Column) -> Column:
        for put, raw in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\'", "'")):
            part = F.replace(part, F.lit(put), F.lit(raw))
        return part

    pieces = F.array_join(F.transform(F.split(_col(x), r"\\\\"), plain), "\\")
    return F.when(F.contains(_col(x), F.lit("\\")), pieces).otherwise(_col(x))


#: The namespaces of a graph's nodes and of its vocabulary, and of the property that `a` stands for.
DATA = "urn:build-provenance:data#"
VOCABULARY = "urn:build-provenance:rdf#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def iri_of(node: Column | str) -> Column:
    """The whole IRI of a node or name as graphs have it; null of a blank node. A bare name, as tables may have, stands for itself."""
    x = _col(node)
    out = F.when(x == "a", RDF + "type").when(F.startswith(x, F.lit(":")), F.concat(F.lit(DATA), F.substring(x, 2, 1 << 30)))
    out = out.when(F.startswith(x, F.lit("b:")), F.concat(F.lit(VOCABULARY), F.substring(x, 3, 1 << 30)))
    out = out.when(F.startswith(x, F.lit("<")), F.regexp_extract(x, "^<(.*)>$", 1))
    return out.when(~F.startswith(x, F.lit("_:")), x)


def env_split(entry: Column | str) -> tuple[Column, Column]:
    """Name and value of a NAME=value entry."""
    both = F.split(_col(entry), "=", 2)
    return both[0], F.get(both, F.lit(1))


def resolve_path(cwd: Column | str, path: Column | str) -> Column:
    """A path made absolute by its text alone: joined to cwd unless it is absolute, `.` and `..` folded, links unknown."""
    whole = F.when(F.startswith(_col(path), F.lit("/")), _col(path)).otherwise(F.concat(_col(cwd), F.lit("/"), _col(path)))
    steps = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def repository_name(url: Column | str) -> Column:
    return basename(F.regexp_replace(_col(url), r"\.git$", ""))


def percent(base: Column, run: Column) -> Column:
    """run as a percentage of base; null where base is 0. A trailing percent sign is ignored in both; a missing run is 0."""
    a, b = (F.coalesce(F.rtrim(x.cast("string"), F.lit("%")).try_cast("double"), F.lit(0.0)) for x in (base, run))
    return F.when(a != 0, b / a * 100.0)


def comparison(base: Column, run: Column) -> Column:
    """percent as text, in six significant digits: whole numbers plain, `N/A` where base is 0."""
    x = percent(base, run)
    six = F.format_string("%.5e", x)
    near = six.cast("double")
    zeros = lambda text: F.regexp_replace(text, r"\.?0+$", "")
    plain = zeros(near.cast("decimal(20,10)").cast("string"))
    power = F.concat(zeros(F.substring_index(six, "e", 1)), F.lit("e"), F.substring_index(six, "e", -1))
    number = F.when(x == F.floor(x), x.cast("long").cast("string")).when((near >= 1e-4) & (near < 1e6), plain).otherwise(power)
    return F.when(x.isNull(), F.lit("N/A")).otherwise(F.concat(number, F.lit("%")))


def node_number(node: Column | str) -> Column:
    """The counter in a node's name."""
    return F.regexp_extract(_col(node), r"(\d+)$", 1).cast("long")
