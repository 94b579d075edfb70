"""Static lookup tables of the reports."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of a source file's extension.
EXT_LANG = {
    "c": "C",
    "cpp": "C++",
    "cc": "C++",
    "cxx": "C++",
    "inl": "C/C++ (inline headers)",
    "h": "C/C++ header",
    "hpp": "C++ header",
    "lua": "Lua",
    "py": "Python",
    "js": "JavaScript",
    "ssjs": "JavaScript (Duktape server-side)",
    "sh": "Shell",
    "cmake": "CMake",
}

# The package of each program.
PROGRAM_PACKAGE = {
    "cc1": "gcc",
    "cc1plus": "gcc",
    "lto1": "gcc",
    "lto-wrapper": "gcc",
    "collect2": "gcc",
    "gcc": "gcc",
    "g++": "gcc",
    "x86_64-alt-linux-gcc-13": "gcc",
    "x86_64-alt-linux-g++-13": "gcc",
    "x86_64-alt-linux-gcc-ar-13": "gcc",
    "x86_64-alt-linux-gcc-ranlib-13": "gcc",
    "as": "binutils",
    "ld": "binutils",
    "ld.bfd": "binutils",
    "ar": "binutils",
    "ranlib": "binutils",
    "cmake": "cmake",
    "make": "make",
    "gmake": "make",
    "pkg-config": "pkg-config",
    "sh": "bash",
    "sh5": "bash",
    "bash": "bash",
    "python3": "python3",
    "python": "python3",
    "python2.7": "python2",
    "lua": "lua",
    "lua5.3": "lua",
    "lua-5.3": "lua",
    "lua5.4": "lua",
    "patch": "patch",
    "tar": "tar",
    "mkdir": "coreutils",
    "mv": "coreutils",
    "rm": "coreutils",
    "cat": "coreutils",
    "chmod": "coreutils",
    "touch": "coreutils",
    "uname": "coreutils",
    "ln": "coreutils",
    "cp": "coreutils",
    "gcc_wrapper": "gcc-common",
    "rpmb": "rpm-build",
}

# What a package does in a build.
PACKAGE_ROLE = {
    "gcc": "Компиляция C/C++, LTO, линковка",
    "binutils": "Ассемблер, линковщик, ar/ranlib",
    "bash": "RPM-скрипты, cmake-зонды",
    "cmake": "Конфигурация системы сборки",
    "make": "Исполнение сборочных целей",
    "gcc-common": "ALT-специфичный wrapper компилятора",
    "coreutils": "Файловые операции (mv, mkdir, rm…)",
    "pkg-config": "Поиск флагов зависимостей",
    "lua": "Lua-скрипты в cmake-зондах",
    "python3": "Python-скрипты в cmake-зондах",
    "patch": "Применение патчей (%prep)",
    "tar": "Распаковка исходников (%prep)",
    "rpm-build": "Точка входа (rpmbuild/rpmb)",
}

# Extensions that count as sources.
SOURCE_EXTENSIONS = ("c", "cpp", "cc", "inl", "lua", "py", "js", "ssjs", "sh")

# The build command of the first of these files that a repository has.
BUILD_SYSTEMS = (
    ("CMakeLists.txt", "cmake -B _build -DCMAKE_BUILD_TYPE=Release . && make -C _build -j$(nproc)"),
    ("autogen.sh", "./autogen.sh && ./configure && make -j$(nproc)"),
    ("configure.ac", "autoreconf -i && ./configure && make -j$(nproc)"),
    ("configure", "./configure && make -j$(nproc)"),
    ("Makefile", "make -j$(nproc)"),
    ("meson.build", "meson setup _build && ninja -C _build"),
)


def look_up(table: dict[str, str], key: Column, default: Column) -> Column:
    """A literal map: these tables are a few dozen entries, fixed in code."""
    made = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    return F.coalesce(F.try_element_at(made, key), default)


def package_of(name: Column) -> Column:
    return look_up(PROGRAM_PACKAGE, name, name)


def role_of(package: Column) -> Column:
    return look_up(PACKAGE_ROLE, package, F.lit("—"))


def language_of(ext: Column) -> Column:
    return look_up(EXT_LANG, ext, ext)
