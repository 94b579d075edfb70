"""A small graph that holds every trap: repeated statements, several execs, an untyped process, missing ends and hashes,
a version that is read and written, a rename target, an executable made in the build, escapes, and more than a day."""

GOLDEN = r'''
:p0 b:env "A=1"
:p0 a b:process
:p0 b:cmd "make -j2"
:p0 b:start "2026-05-30T10:00:00Z"
:f0 a b:file
:f0 b:name "make"
:f0 b:abspath "/usr/bin/make"
:f0 b:hash "00aa"
:p0 b:executable :f0
:p0 b:creates :p1
:p1 a b:process
:p1 b:cmd "sh -c 'echo \"hi\\n\"'"
:p1 b:start "2026-05-30T10:00:01Z"
:f1 a b:file
:f1 b:name "/bin/sh"
:f1 b:abspath "/bin/sh"
:f1 b:hash "00bb"
:p1 b:executable :f1
:p1 a b:process
:p1 b:cmd "cc1 a.c"
:p1 b:start "2026-05-30T10:00:02Z"
:f2 a b:file
:f2 b:name "cc1"
:f2 b:abspath "/usr/libexec/gcc/cc1"
:f2 b:hash "00cc"
:p1 b:executable :f2
:f3 a b:file
:f3 b:name "a.c"
:f3 b:abspath "/build/src/src/a.c"
:f3 b:hash "0001"
:p1 b:reads :f3
:p1 b:reads :f3
:f4 a b:file
:f4 b:name "stdio.h"
:f4 b:abspath "/usr/include/stdio.h"
:f4 b:hash "0002"
:p1 b:reads :f4
:f5 a b:file
:f5 b:name "a.o"
:f5 b:abspath "/build/src/src/a.o"
:p1 b:writes :f5
:f5 b:hash "0003"
:p1 b:end "2026-05-30T10:00:05Z"
:p0 b:creates :p2
:p2 b:reads :f3
:p2 b:reads :f4
:p2 b:end "2026-05-30T10:00:06Z"
:p0 b:creates :p3
:p3 a b:process
:p3 b:cmd "ld -o libx.so.1"
:p3 b:start "2026-05-30T10:00:06Z"
:f6 a b:file
:f6 b:name "ld"
:f6 b:abspath "/usr/bin/ld"
:f6 b:hash "00dd"
:p3 b:executable :f6
:p3 b:reads :f5
:p3 b:reads :f4
:f7 a b:file
:f7 b:name "libc.so.6"
:f7 b:abspath "/usr/lib64/libc.so.6"
:p3 b:reads :f7
:f8 a b:file
:f8 b:name "libx.so.1"
:f8 b:abspath "/build/src/libx.so.1"
:p3 b:reads :f8
:p3 b:writes :f8
:f8 b:hash "0004"
:f9 a b:file
:f9 b:name "/usr/lib64/libx.so.1"
:f9 b:abspath "/usr/lib64/libx.so.1"
:f9 b:hash "0004"
:p3 b:rename _:rename0
_:rename0 b:rename-from :f8
_:rename0 b:rename-to :f9
:p4 a b:process
:p4 b:cmd "gen"
:p4 b:start "2026-05-30T10:00:07Z"
:f10 a b:file
:f10 b:name "gen"
:f10 b:abspath "/build/src/gen"
:p3 b:writes :f10
:f10 b:hash "0005"
:p4 b:executable :f10
:p4 b:reads :f9
:f11 a b:file
:f11 b:name "Makefile"
:f11 b:abspath "/build/src/out/Makefile"
:p4 b:writes :f11
:p3 b:end "2026-05-30T10:00:09Z"
:p0 b:end "2026-05-31T10:00:10Z"
'''


def lines() -> list[str]:
    out = []
    for line in GOLDEN.strip().splitlines():
        s, p, o = line.split(" ", 2)
        out.append(f"{s}\t{p}\t{o} .")
    return out
