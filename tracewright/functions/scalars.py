"""Scalar rules as column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element kinds that only structure a project, and those that build nothing.
STRUCTURAL_KINDS = ("junction", "import", "filter", "compose", "stack")
NON_BUILDING_KINDS = ("stack", "import", "filter", "junction", "compose", "link")
#: Other spellings of resource names.
RESOURCE_NAMES = {"CPU": "PROCESS", "FETCH": "DOWNLOAD", "PUSH": "UPLOAD"}
RESOURCES = ("PROCESS", "DOWNLOAD", "UPLOAD", "CACHE", "OTHER")
#: What identifies the content of a source.
URL_SCHEMES = ("https", "http", "ssh", "git", "git+ssh", "git+https", "git+http")
KEYED_BY_REF = ("git", "bzr", "tar", "zip", "remote", "deb", "pip", "git_repo", "git_tag", "git_module", "cargo", "docker")
KEYED_BY_CONTENT = ("local", "patch", "workspace")
#: Shells of a command block.
SHELLS = ("sh", "bash", "dash", "ash")


def mapped(column: Column, values: dict[str, str], default: Column | str | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in values.items():
        out = out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(default) if isinstance(default, str) else default) if default is not None else out


def quantise(ts: Column, epsilon: int) -> Column:
    """Nearest multiple of ``epsilon``, ties up; floor division also before the epoch."""
    twice = 2 * ts + epsilon
    return F.shiftright(twice - F.pmod(twice, F.lit(2 * epsilon)), 1)


def resource_name(name: Column) -> Column:
    upper = F.upper(F.trim(name))
    known = mapped(upper, RESOURCE_NAMES, upper)
    return F.when(known.isin(*RESOURCES), known).otherwise("OTHER")


def run_mode(n_cached: Column) -> Column:
    return F.when(n_cached.isNull(), "unknown").when(n_cached > 0, "incremental").otherwise("full")


def incomplete_reason(n_failed: Column, interrupted: Column, suspended_s: Column) -> Column:
    return F.when(n_failed > 0, "failed").when(interrupted, "interrupted").when(suspended_s > 0, "suspended")


def is_structural(kind: Column) -> Column:
    return kind.isin(*STRUCTURAL_KINDS)


def is_building(kind: Column) -> Column:
    return ~kind.isin(*NON_BUILDING_KINDS)


def normalise_url(url: Column) -> Column:
    """Identity of a repository address: no scheme, user, trailing slashes or ``.git``; host in lower case.

    Addresses of schemes that are not known stay as they are.
    """
    trimmed = F.trim(url)
    given = F.instr(trimmed, "://") > 0
    known = F.lower(F.substring_index(trimmed, "://", 1)).isin(*URL_SCHEMES)
    rest = F.when(given, F.substring(trimmed, F.instr(trimmed, "://") + 3, F.length(trimmed))).otherwise(trimmed)
    bare = F.regexp_replace(rest, r"^[^/@]*@", "")
    colon = ~given & bare.contains(":") & ~F.regexp_extract(bare, r"^[^:]*:([^/]*)", 1).rlike(r"^[0-9]+$")
    path = F.when(colon, F.regexp_replace(bare, r"^([^:]*):", "$1/")).otherwise(bare)
    host = F.lower(F.substring_index(path, "/", 1))
    below = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"^[^/]*", "")).otherwise("")
    tidy = F.regexp_replace(F.regexp_replace(F.concat(host, below), r"/+$", ""), r"\.git$", "")
    return F.when(given & ~known, trimmed).otherwise(tidy)


def keying_of(kind: Column) -> Column:
    """Whether a source is keyed by a reference or by its content; other kinds are not guessed at."""
    return F.when(kind.isin(*KEYED_BY_REF), "ref").when(kind.isin(*KEYED_BY_CONTENT), "content").otherwise("unknown")


def unkeyable_path(path: Column) -> Column:
    """Absolute, or leaving the project by ``..``."""
    step = lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
    walk = F.aggregate(F.split(path, "/"), start, lambda at, p: F.struct((at["depth"] + step(p)).alias("depth"), F.least(at["low"], at["depth"] + step(p)).alias("low")))
    return path.startswith("/") | (walk["low"] < 0)


#: Fixed patterns: what differs between runs of one command, and the sign put in its place.
SIGNATURE_PATTERNS = (
    (r"/buildstream/[^/\s]+/[^/\s]+\.bst/", "<element-root>/"),
    (r"/tmp/cc[A-Za-z0-9]+\.\w+", "/tmp/<tmp>"),
    (r"cmTC_[0-9a-fA-F]+", "cmTC_<id>"),
    (r"TryCompile-[A-Za-z0-9]+", "TryCompile-<id>"),
)


def command_signature(cmd: Column) -> Column:
    for pattern, sign in SIGNATURE_PATTERNS:
        cmd = F.regexp_replace(cmd, pattern, sign)
    return cmd


def binary_name(cmd: Column) -> Column:
    name = F.element_at(F.split(F.substring_index(cmd, " ", 1), "/"), -1)
    return F.when(F.substring_index(cmd, " ", 1) == "", "(unknown)").otherwise(name)


#: Programs that do the work of a build, and those that only organise it (compiler drivers among them).
WORK = ("cc1", "cc1plus", "cc1obj", "cc1objplus", "clang", "clang++", "clang-cpp", "as", "ld", "ld.bfd", "ld.gold", "ld.lld", "collect2", "lto1", "ar", "ranlib", "strip", "objcopy", "rustc", "go", "javac")
ORCHESTRATION = ("sh", "bash", "dash", "env", "make", "gmake", "ninja", "cmake", "meson", "python", "python3", "uname", "sed", "grep", "cat", "sort", "gcc", "g++", "cc", "c++", "clang-wrapper")


def binary_class(binary: Column) -> Column:
    return F.when(binary.isin(*WORK), "work").when(binary.isin(*ORCHESTRATION), "orchestration").otherwise("unclassified")


def requested_jobs(cmd: Column) -> Column:
    """The N of ``-jN`` of a make-like command, else null."""
    jobs = F.regexp_extract(cmd, r"(?:^|\s)-j\s*(\d+)(?:\s|$)", 1)
    return F.when(binary_name(cmd).isin("make", "gmake", "ninja") & (jobs != ""), jobs.cast("long"))


def is_element_name(name: Column) -> Column:
    return name.endswith(".bst")


def is_command_block(pid: Column, ppid: Column, cmd: Column) -> Column:
    return ((ppid == 1) & (pid == 2)) | ((ppid == 2) & binary_name(cmd).isin(*SHELLS))


def is_build_driver(cmd: Column) -> Column:
    return cmd.contains("--build") | F.exists(F.split(cmd, " "), lambda t: F.element_at(F.split(t, "/"), -1).isin("make", "gmake", "ninja"))


def is_configure_root(cmd: Column) -> Column:
    """The program behind shells and assignments is a configure step."""
    words = F.filter(F.split(F.trim(cmd), r"\s+"), lambda w: ~w.rlike(r"^[A-Za-z_]\w*=") & ~w.isin("-c", "-e", "-ec") & ~F.element_at(F.split(w, "/"), -1).isin(*SHELLS, "env"))
    program = F.element_at(F.split(F.get(words, F.lit(0)), "/"), -1)
    cmake = (program == "cmake") & ~cmd.rlike(r"(^|\s)(--build|--install|-E)(\s|$)")
    return F.coalesce(program.isin("configure", "autogen.sh", "meson") | cmake, F.lit(False))


def tidy_command(cmd: Column) -> Column:
    return F.trim(F.regexp_replace(cmd, r"\s+", " "))


def is_empty_command(cmd: Column) -> Column:
    return F.trim(F.regexp_replace(cmd, r"\\[nt]|\$'|'|\s", "")) == ""


def phase_family(phase: Column) -> Column:
    return F.substring_index(phase, " at:", 1)


def elapsed_us(text: Column) -> Column:
    """``HH:MM:SS[.ffffff]`` in microseconds; null where the time is unknown."""
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d{2}):(\d{2}(?:\.\d+)?)$", i)
    return F.when(part(1) != "", ((part(1).cast("long") * 60 + part(2).cast("long")) * 60) * 1_000_000 + F.round(part(3).cast("double") * 1_000_000).cast("long"))


_THRESHOLD = re.compile(r"^\s*(>=|<=|>|<|=)?\s*(-?\d+(?:\.\d+)?)\s*([a-zA-Z%]*)\s*$")
_UNITS = {"": 1.0, "us": 1.0, "ms": 1e3, "s": 1e6, "m": 6e7, "min": 6e7, "h": 3.6e9, "%": 0.01, "kb": 1.0, "mb": 1024.0, "gb": 1024.0**2}


def passes_threshold(column: Column, text: str) -> Column:
    """``>= 5 s`` and the like; an unreadable text filters nothing, a missing value never passes."""
    m = _THRESHOLD.match(text)
    if not m or m[3].lower() not in _UNITS:
        return F.lit(True)
    limit = float(m[2]) * _UNITS[m[3].lower()]
    ops = {">=": column >= limit, "<=": column <= limit, ">": column > limit, "<": column < limit, "=": column == limit}
    return F.coalesce(ops[m[1] or ">="], F.lit(False))


def contains_text(columns: list[Column], text: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns)).contains(text.lower())


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.8, "high").when(x >= 0.5, "medium").otherwise("low")


def efficiency_band(x: Column) -> Column:
    return F.when(x >= 0.9, "high").when(x >= 0.7, "medium").otherwise("low")


def same_host(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """``same``, ``different``, or ``unknown`` where either side is not recorded."""
    missing, differs = F.lit(False), F.lit(False)
    for k in ("cpu_model", "cpu_count", "memory_mb"):
        missing |= a[k].isNull() | b[k].isNull()
        differs |= a[k] != b[k]
    return F.when(missing, "unknown").when(differs, "different").otherwise("same")


def slept(wall_s: Column, monotonic_s: Column, least_s: float = 5.0) -> Column:
    return (wall_s - monotonic_s) >= least_s


def effective_cpus(measured: Column, quota_us: Column, period_us: Column, budget: Column, host: Column) -> Column:
    """Struct of the number and of what it rests on."""
    quota = F.when((quota_us > 0) & (period_us > 0), quota_us / period_us)
    label = F.when(measured.isNotNull(), "measured").when(quota.isNotNull(), "quota").when(budget.isNotNull(), "declared").when(host.isNotNull(), "host")
    return F.struct(F.coalesce(measured, quota, budget.cast("double"), host.cast("double")).alias("cpus"), label.alias("source"))


def default_capacity(resource: Column, declared: Column, max_jobs: Column) -> Column:
    return F.coalesce(declared, F.when(resource == "PROCESS", F.coalesce(max_jobs, F.lit(4))).when(resource.isin("DOWNLOAD", "UPLOAD"), F.lit(2)).otherwise(F.lit(1)))
