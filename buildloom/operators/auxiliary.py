"""Dataflows around recording: overhead comparison, line counts, section stripping, build-system choice, PATH search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import comparison, repository_name
from ..plans.lookups import BUILD_SYSTEMS

# What a finished recording's lines are counted by.
LINE_PATTERNS = (r"\.", "a.*b:process", "a.*b:file")
# Where builds are written unless told, how a spec file is built, and what is said where nothing can be built.
OUTPUT_DIR = "/output"
RPM_BUILD = "rpmbuild --nodeps --define '_allow_root_build 1' -bc "
NO_SOURCE = "ERROR: укажите GIT_URL (git-репозиторий) или SRPM (путь к .src.rpm)"
NO_BUILD_SYSTEM = "ERROR: не удалось определить систему сборки"
NO_SPEC = "ERROR: spec не найден"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """metric, value of a `metric: value` file; what follows a second colon is left out."""
    cells = F.split("value", ":")
    return spark.read.text(path).where("value <> ''").select(cells[0].alias("metric"), F.trim(F.get(cells, F.lit(1))).alias("value"))


def compare_metrics(base: DataFrame, run: DataFrame) -> DataFrame:
    """metric, base, run, pct, line: every base metric, with run as a percentage of it (`N/A` where base is 0), and as a
    line of the printed table."""
    both = base.select("metric", F.col("value").alias("base")).join(run.select("metric", F.col("value").alias("run")), "metric", "left")
    out = both.withColumn("pct", comparison(F.col("base"), F.col("run")))
    shown = F.concat_ws(" | ", F.concat("metric", F.lit(": "), "base"), F.coalesce("run", F.lit("")), "pct")
    return out.withColumn("line", shown)


def drop_comments(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that don't begin with #."""
    return lines.where(~F.col(column).startswith("#"))


def line_counts(lines: DataFrame, patterns: tuple[str, ...] = LINE_PATTERNS, column: str = "value") -> DataFrame:
    """pattern, n: lines that match each, counted in one pass."""
    counts = lines.agg(*(F.count_if(F.col(column).rlike(p)).alias(f"n{i}") for i, p in enumerate(patterns)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(p).alias("pattern"), F.col(f"n{i}").alias("n")) for i, p in enumerate(patterns)))).alias("x")).select("x.pattern", "x.n")


def strip_section(lines: DataFrame, keys: tuple[str, ...], section: str = "check") -> DataFrame:
    """Lines (keys, n, line) with the body of %section replaced by `exit 0`; it ends at any next line of % and a word."""
    starts, any_start = F.col("line").rlike(f"^%{section}"), F.col("line").rlike("^%[a-zA-Z_]")
    by = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = F.coalesce(F.last(F.when(any_start, starts), ignorenulls=True).over(by), F.lit(False))
    kept = lines.select(*keys, "n", "line", starts.alias("starts"), within.alias("within")).where("starts or not within")
    put = F.when(F.col("starts"), F.array(F.lit(f"%{section}"), F.lit("exit 0"))).otherwise(F.array("line"))
    return kept.select(*keys, "n", F.explode(put).alias("line"))


def choose_build_system(listing: DataFrame) -> DataFrame:
    """repo, cmd: the command of the first known file that each repository has; null if none."""
    rank = F.when(F.lit(False), 0)
    for i, (name, _) in enumerate(BUILD_SYSTEMS):
        rank = rank.when(F.col("filename") == name, i)
    best = listing.groupBy("repo").agg(F.min(rank).alias("rank"))
    commands = F.array(*[F.lit(c) for _, c in BUILD_SYSTEMS])
    return best.select("repo", F.get(commands, F.col("rank")).alias("cmd"))


def plan_builds(requests: DataFrame, listing: DataFrame, specs: DataFrame) -> DataFrame:
    """What each request builds: request, mode, name, output_file, build_cmd, error (null if it can be built).

    requests: request, git_url, git_build_cmd, srpm, package, output_dir; listing and specs: repo (the request) and filename.
    A repository goes before a source package; an empty text counts as none. A repository's command is the one given, or
    that of its build system; a package is built from its first spec file."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    git = text("git_url").isNotNull()
    asked = requests.join(choose_build_system(listing).select(F.col("repo").alias("request"), F.col("cmd").alias("found")), "request", "left")
    first = specs.where(F.col("filename").endswith(".spec")).groupBy(F.col("repo").alias("request")).agg(F.min("filename").alias("spec"))
    asked = asked.join(first, "request", "left")
    mode = F.when(git, "git").when(text("srpm").isNotNull(), "srpm")
    name = F.when(git, repository_name("git_url")).when(mode == "srpm", F.col("package"))
    cmd = F.when(git, F.coalesce(text("git_build_cmd"), "found")).when(mode == "srpm", F.concat(F.lit(RPM_BUILD), "spec"))
    error = F.when(mode.isNull(), NO_SOURCE).when(cmd.isNull(), F.when(git, NO_BUILD_SYSTEM).otherwise(NO_SPEC))
    put = F.concat(F.coalesce(text("output_dir"), F.lit(OUTPUT_DIR)), F.lit("/"), name, F.lit("-build.out"))
    return asked.select("request", mode.alias("mode"), name.alias("name"), put.alias("output_file"), cmd.alias("build_cmd"), error.alias("error"))


def path_search(names: DataFrame, files: DataFrame) -> DataFrame:
    """key, abspath: the first folder of each row's path list that has the program. names: key, name, path; files: abspath."""
    tried = names.select("key", F.posexplode(F.split("path", ":")).alias("at", "dir"), "name").select("key", "at", F.concat("dir", F.lit("/"), "name").alias("abspath"))
    return tried.join(files.select("abspath").distinct(), "abspath").groupBy("key").agg(F.min_by("abspath", "at").alias("abspath"))
