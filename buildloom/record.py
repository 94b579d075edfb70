"""python -m buildloom.record [-o OUTPUT] LOG: the provenance of recorded system-call logs, as Turtle.

LOG is a folder or file of JSON lines in the reducer's columns. A log of one build becomes one file, `build.out` unless named;
with several builds OUTPUT is a folder with a part for each.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from .cli import session
from .operators.reducer import reduce_log
from .sources import files, turtle

#: The exit status of a wrong call.
USAGE = 64


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    output = "build.out"
    if args[:1] == ["-o"] and len(args) > 1:
        output, args = args[1], args[2:]
    if len(args) != 1:
        print("missing log to record", file=sys.stderr)
        return USAGE
    log = files.read_events(spark or session(), args[0])
    graph = reduce_log(log)
    if len(log.select("build_id").distinct().limit(2).collect()) > 1 or os.path.isdir(output):
        turtle.write_turtle(graph.triples(), output)
    else:
        turtle.write_one(graph.triples(), output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
