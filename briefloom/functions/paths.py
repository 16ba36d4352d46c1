"""Path column functions: base name, extension, relative path, corpus filters,
and the file-kind classifier.  All are native Column expressions, so they stay
inside whole-stage codegen and push down where Spark can.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefloom.functions.text import lower_simple

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's defaults for identical results).
# ---------------------------------------------------------------------------
# Directory names skipped during a corpus scan (compared case-insensitively).
IGNORED_DIRS = [
    ".git", "node_modules", "vendor", ".venv", "venv", "__pycache__",
    ".terraform", "dist", "build", "target", ".next", "tmp", "coverage",
    ".nyc_output", ".cache", "out",
]
# File extensions skipped (compared on the lower-cased last extension).
IGNORED_EXTS = [
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".webp",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".pdf", ".zip", ".tar", ".gz", ".bz2", ".xz", ".rar",
    ".exe", ".bin", ".so", ".dylib", ".dll", ".a", ".o",
    ".pyc", ".class", ".jar",
    ".mp3", ".mp4", ".avi", ".mov", ".mkv",
    ".db", ".sqlite", ".sqlite3",
]
# Base-name globs skipped (case-sensitive).
IGNORED_PATTERNS = [
    "*.min.js", "*.min.css", "*.map",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "go.sum", "Cargo.lock", "poetry.lock", "Gemfile.lock",
    "*.pb.go", "*.pb.gw.go",
]
# Default size ceiling in bytes (1 MiB); a file of exactly this size is kept.
DEFAULT_MAX_SIZE_BYTES = 1 * 1024 * 1024

# Kind classifier tables.
SOURCE_EXTS = [
    ".go", ".py", ".ts", ".tsx", ".js", ".jsx", ".rs", ".java",
    ".kt", ".swift", ".c", ".cpp", ".h", ".hpp", ".rb", ".php",
    ".cs", ".scala", ".clj", ".ex", ".exs", ".hs",
]
MARKDOWN_EXTS = [".md", ".mdx", ".rst"]
TEXT_EXTS = [".txt"]
CONFIG_EXTS = [".json", ".yaml", ".yml", ".toml", ".ini", ".env"]
CONFIG_BASENAMES = ["makefile", "dockerfile", "jenkinsfile", "procfile", "rakefile"]
README_BASENAMES = ["readme", "readme.md", "readme.txt", "readme.rst"]
CONFIG_SUFFIXES = [".env.example", ".env.sample"]

# Inbox: accepted extensions (case-sensitive).
INBOX_EXTS = [".md", ".txt", ".json", ".log"]
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_name(path) -> Column:
    """Last ``/``-separated element."""
    return F.substring_index(_c(path), "/", -1)


def extension(path) -> Column:
    """Suffix from the final dot of the base name ('' when there is none)."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def relative_path(path, root) -> Column:
    """Path relative to the ingested root; the base name when the path is the
    root itself or is not below it."""
    path, root = _c(path), _c(root)
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    below = path.startswith(prefix) & (F.length(path) > F.length(prefix))
    return F.when(below, F.substring(path, F.length(prefix) + 1, 1 << 30)).otherwise(base_name(path))


def directory_segments(rel_path) -> Column:
    """Directory names between the root and the file (root itself excluded)."""
    segs = F.split(_c(rel_path), "/")
    return F.slice(segs, 1, F.size(segs) - 1)


def dir_is_ignored(name: Column) -> Column:
    """F1 + F2 on one directory name."""
    lowered = [d.lower() for d in IGNORED_DIRS]
    return lower_simple(name).isin(lowered) | (name.startswith(".") & (name != F.lit(".")))


# A directory segment is any segment followed by '/'.  One anchored regex
# (compiled once, evaluated inside whole-stage codegen) instead of a lambda
# over the split path, matched on the lower-cased path: hidden directories
# ('.x', but not '.') or an ignored name.
IGNORED_DIR_REGEX = (r"(^|/)(\.[^/]+|"
                     + "|".join(re.escape(d.lower()) for d in IGNORED_DIRS if not d.startswith("."))
                     + r")/")


def passes_dir_filter(rel_path) -> Column:
    """F1 + F2 over every directory between the root and the file."""
    return ~lower_simple(rel_path).rlike(IGNORED_DIR_REGEX)


def passes_file_filter(path, size, max_size_bytes: int = DEFAULT_MAX_SIZE_BYTES) -> Column:
    """F3 + F4 + F5 for one file."""
    path, size = _c(path), _c(size)
    base = base_name(path)
    ok_size = F.lit(True) if max_size_bytes <= 0 else (size <= F.lit(max_size_bytes))
    ok_ext = ~lower_simple(extension(path)).isin(IGNORED_EXTS)
    suffixes = [p[1:] for p in IGNORED_PATTERNS if p.startswith("*")]
    literals = [p for p in IGNORED_PATTERNS if not p.startswith("*")]
    hit_glob = F.lit(False)
    for s in suffixes:
        hit_glob = hit_glob | base.endswith(s)
    ok_pattern = ~(hit_glob | base.isin(literals))
    return ok_size & ok_ext & ok_pattern


def file_kind(path) -> Column:
    """Classify a path: source / markdown / text / config / other."""
    path = _c(path)
    ext = lower_simple(extension(path))
    base = lower_simple(base_name(path))
    suffix_hit = F.lit(False)
    for s in CONFIG_SUFFIXES:
        suffix_hit = suffix_hit | base.endswith(s)
    return (
        F.when(ext.isin(SOURCE_EXTS), "source")
        .when(ext.isin(MARKDOWN_EXTS), "markdown")
        .when(ext.isin(TEXT_EXTS), "text")
        .when(ext.isin(CONFIG_EXTS), "config")
        .when(base.isin(CONFIG_BASENAMES), "config")
        .when(base.isin(README_BASENAMES), "markdown")
        .when(suffix_hit, "config")
        .otherwise("other")
    )


def default_project_name(root_path) -> Column:
    """Base name of a directory, spaces to '-', lower-cased."""
    trimmed = F.regexp_replace(_c(root_path), "/+$", "")
    return lower_simple(F.replace(base_name(trimmed), F.lit(" "), F.lit("-")))


def inbox_accepts(path) -> Column:
    """accepted inbox extension, case-sensitive."""
    return extension(path).isin(INBOX_EXTS)
