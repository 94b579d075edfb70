"""Console and Markdown renderings of a graph's reports: small results are collected and formatted on the driver."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reports
from .model import Graph

RULE = "═" * 62

# What the console report says.
TITLES = {
    "stats": "Обзор графа",
    "timeline": "Временной диапазон сборки",
    "languages": "Языки программирования",
    "tools": "Инструменты и пакеты, задействованные в сборке",
    "externals": "Готовые бинари: использованы, но не собраны в этом билде",
    "sources": "Исходники проекта, прочитанные при сборке",
    "artifacts": "Артефакты сборки (записанные файлы, не /tmp)",
    "libs": "Библиотеки, собранные в ходе сборки (.so, .a)",
    "tree": "Дерево процессов (2 уровня)",
    "headers": "Наиболее читаемые системные заголовки",
}
METRICS = {
    "processes": "Процессов",
    "files": "Файлов",
    "reads": "Чтений (reads)",
    "writes": "Записей (writes)",
    "renames": "Переименований",
    "creates": "Создано подпроцессов",
}
BEGIN, FINISH, DURATION = "Начало", "Конец", "Длительность"
COMPILERS, BY_EXTENSION = "\n  Компиляторы/интерпретаторы:", "\n  Исходные файлы по расширению:"
BY_PACKAGE, IN_DETAIL = "\n  По пакетам:", "\n  Детально (утилита → пакет):"
EXECUTED, NEEDED = "\n  Запущенные исполняемые файлы ({}):", "\n  Системные .so библиотеки ({}):"
IN_ALL, AND_MORE = "\n  Всего: {} файлов", "       … и ещё {}"

# What the Markdown report says.
MD_HEAD = ("# Build Report: {}", "\nСгенерировано: {} UTC  ", "Источник: `{}`\n")
MD_OVERVIEW = ("## Обзор\n", "| Метрика | Значение |", "|---------|---------|")
MD_LANGUAGES = ("\n## Языки программирования\n", "| Расширение | Файлов | Язык |", "|-----------|--------|------|")
MD_SOURCES = ("\n## Исходники проекта\n", "Всего: **{}** файлов\n")
MD_TOOLS = ("\n## Инструменты сборки\n", "| Пакет | Инвокаций | Роль |", "|-------|----------|------|")
MD_EXTERNAL = ("\n## Внешние бинарные зависимости\n", "Файлы, **использованные** в сборке, но **не созданные** в ней.\n", "### Исполняемые файлы ({})\n")
MD_NEEDED = ("\n### Системные .so библиотеки ({})\n", "| Библиотека | SHA1 (git-compatible) |", "|-----------|----------------------|")
MD_BUILT = ("\n## Собранные библиотеки\n", "| Библиотека | SHA1 |", "|-----------|------|")


def section(title: str) -> str:
    return f"\n{RULE}\n  {title}\n{RULE}"


def row(label: str, value, width: int = 30) -> str:
    return f"  {label:<{width}} {value}"


def _most_first(df, *names: str) -> list:
    return df.orderBy(F.desc("n"), *names).collect()


def stats(g: Graph) -> list[str]:
    n = {r["metric"]: r["n"] for r in reports.overview(g).collect()}
    return [section(TITLES["stats"]), *(row(label, n[k]) for k, label in METRICS.items())]


def timeline(g: Graph) -> list[str]:
    t = reports.timeline(g).first()
    out = [section(TITLES["timeline"])]
    if t["begin_ts"]:
        out += [row(BEGIN, t["begin_ts"]), row(FINISH, t["finish_ts"]), row(DURATION, f"{t['duration_mod_day']} секунд")]
    return out


def languages(g: Graph) -> list[str]:
    out = [section(TITLES["languages"]), COMPILERS]
    out += [f"  {r['n']:5d}×  {r['name']}" for r in _most_first(reports.exec_counts_by_name(g), "path")]
    out.append(BY_EXTENSION)
    return out + [f"  {'.' + r['ext']:<10} {r['n']:4d} файлов  → {r['lang']}" for r in _most_first(reports.source_reads_by_ext(g), "ext")]


def tools(g: Graph) -> list[str]:
    out = [section(TITLES["tools"]), BY_PACKAGE]
    out += [f"  {r['n']:5d}×  {r['pkg']}" for r in _most_first(reports.tools_by_package(g), "pkg")]
    out.append(IN_DETAIL)
    return out + [f"  {r['n']:5d}×  {r['name']:<42} [{r['pkg']}]" for r in _most_first(reports.tools_detail(g), "name")]


def externals(g: Graph) -> list[str]:
    exes = reports.external_executables(g).orderBy("path").collect()
    libs = reports.external_libs(g).orderBy("path", "hash").collect()
    out = [section(TITLES["externals"]), EXECUTED.format(len(exes))]
    out += [f"    {r['path']}" for r in exes]
    return [*out, NEEDED.format(len(libs)), *(f"    {r['name']:<50} {r['hash16'] or '—'}" for r in libs)]


def sources(g: Graph) -> list[str]:
    rows = reports.project_sources_relative(g).orderBy("path").collect()
    return [section(TITLES["sources"]), IN_ALL.format(len(rows)), *(f"    {r['rel_path']}" for r in rows)]


def artifacts(g: Graph) -> list[str]:
    rows = reports.artifacts_by_ext(g).orderBy("ext").collect()
    return [section(TITLES["artifacts"]), *(row(f".{r['ext']} ({r['n']})", r["sample"], 20) for r in rows)]


def libs(g: Graph) -> list[str]:
    rows = reports.built_libs(g).orderBy("path", "hash").collect()
    return [section(TITLES["libs"]), *(row(r["path"].rsplit("/", 1)[-1], f"hash: {(r['hash'] or '—')[:16]}", 44) for r in rows)]


def tree(g: Graph) -> list[str]:
    cmds = {r["pid_node"]: r["cmd"] for r in reports.root_commands(g).collect()}
    below: dict[str, list] = {}
    for r in reports.tree_two_levels(g).orderBy("root", "rn").collect():
        below.setdefault(r["root"], []).append(r)
    out = [section(TITLES["tree"])]
    for (root,) in reports.process_roots(g).collect():
        out.append(f"\n  {root.lstrip(':')}: {(cmds.get(root) or '?')[:70]}")
        rows = below.get(root, [])
        out += [f"    └─ {r['child'].lstrip(':')}: {r['cmd65']}" for r in rows]
        if rows and rows[0]["hidden"]:
            out.append(AND_MORE.format(rows[0]["hidden"]))
    return out


def headers(g: Graph) -> list[str]:
    return [section(TITLES["headers"]), *(row(str(r["n"]), r["short_path"], 5) for r in _most_first(reports.headers_top(g), "path"))]


AVAILABLE = {"stats": stats, "timeline": timeline, "languages": languages, "tools": tools, "externals": externals, "sources": sources, "artifacts": artifacts, "libs": libs, "tree": tree, "headers": headers}


def markdown(g: Graph, source: str, now: datetime | None = None) -> str:
    """The whole report. Tables that reports share are cached while it is made."""
    shared = [g.file, g.reads, g.writes, g.executable, g.process]
    for t in shared:
        t.cache()
    try:
        return _markdown(g, source, now or datetime.now(timezone.utc))
    finally:
        for t in shared:
            t.unpersist()


def _markdown(g: Graph, source: str, now: datetime) -> str:
    n = {r["metric"]: r["n"] for r in reports.overview(g).collect()}
    t = reports.timeline(g).first()
    span = f"{t['duration_mod_day']} сек ({t['begin_ts']} → {t['finish_ts']})" if t["begin_ts"] else "?"
    out = [MD_HEAD[0].format(Path(source).stem.replace("-build", "")), MD_HEAD[1].format(f"{now:%Y-%m-%d %H:%M}"), MD_HEAD[2].format(source)]
    out += [*MD_OVERVIEW, *(f"| {label} | {n[k]} |" for k, label in METRICS.items() if k != "renames"), f"| {DURATION} | {span} |"]
    out += [*MD_LANGUAGES, *(f"| `.{r['ext']}` | {r['n']} | {r['lang']} |" for r in _most_first(reports.source_reads_by_ext(g), "ext"))]
    made = reports.relative(reports.project_sources_report(g), checkout=False).orderBy("path").collect()
    out += [MD_SOURCES[0], MD_SOURCES[1].format(len(made)), *(f"- `{r['rel_path']}`" for r in made)]
    out += [*MD_TOOLS, *(f"| `{r['pkg']}` | {r['n']} | {r['role']} |" for r in _most_first(reports.tools_by_package(g), "pkg"))]
    exes = reports.external_executables(g).orderBy("path").collect()
    out += [*MD_EXTERNAL[:2], MD_EXTERNAL[2].format(len(exes)), *(f"- `{r['path']}`" for r in exes)]
    needed = reports.external_libs(g).orderBy("path", "hash").collect()
    out += [MD_NEEDED[0].format(len(needed)), *MD_NEEDED[1:], *(f"| `{r['name']}` | `{r['hash'] or '—'}` |" for r in needed)]
    built = reports.built_libs(g).orderBy("path", "hash").collect()
    if built:
        out += [*MD_BUILT, *(f"| `{r['path'].rsplit('/', 1)[-1]}` | `{r['hash'] or '—'}` |" for r in built)]
    return "\n".join([*out, "\n---\n", "*Отчёт сгенерирован на основе записанного графа сборки*"])


# The head of the printed overhead comparison.
COMPARISON_HEAD = ("Baseline run | Recorded run | Comparison %", "")


def comparison(compared: DataFrame) -> list[str]:
    """The printed table of compare_metrics: a few lines, one for each metric."""
    return [*COMPARISON_HEAD, *(r["line"] for r in compared.select("line", "metric").orderBy("metric").collect())]
