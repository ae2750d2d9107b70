"""File classification: language, kind, whether to skip, whether to parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import first_filled_line, first_lines, newline_count

#: Languages by extension.
EXTENSIONS = {
    "python": (".py",),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "java": (".java",),
    "go": (".go",),
    "ruby": (".rb",),
    "rust": (".rs",),
    "csharp": (".cs",),
    "cpp": (".cpp", ".cc", ".cxx", ".h", ".hpp"),
    "c": (".c",),
    "kotlin": (".kt", ".kts"),
    "swift": (".swift",),
    "dart": (".dart",),
    "php": (".php",),
    "shell": (".sh", ".bash", ".zsh"),
    "sql": (".sql",),
    "yaml": (".yaml", ".yml"),
    "json": (".json",),
    "toml": (".toml",),
    "markdown": (".md", ".mdx"),
    "html": (".html", ".htm"),
    "css": (".css", ".scss", ".sass"),
}
#: Languages by the start of a first line.
SHEBANGS = (("python", "#!/usr/bin/env python"), ("python", "#!/usr/bin/python"), ("javascript", "#!/usr/bin/env node"), ("shell", "#!/bin/bash"), ("shell", "#!/bin/sh"), ("shell", "#!/usr/bin/env bash"), ("shell", "#!/usr/bin/env zsh"), ("ruby", "#!/usr/bin/env ruby"))
#: Names and patterns by what they say of a file.
VENDOR_PARTS = ("node_modules", "vendor", "third_party", "third-party", ".venv", "venv", "env", "site-packages")
GENERATED_ENDS = ("_pb2.py", "_pb.go", ".generated.ts", ".auto.ts", ".generated.js", "_generated.go", ".g.dart", ".freezed.dart", ".gr.dart", ".config.dart")
GENERATED_MARKS = ("DO NOT EDIT", "Code generated", "This file is auto-generated", "AUTO-GENERATED", "GENERATED CODE - DO NOT MODIFY BY HAND")
TEST_DIRS = ("test", "tests", "spec", "__tests__", "e2e")
TEST_NAMES = ("_test.py", "test_", ".test.ts", ".spec.ts", ".test.js", ".spec.js", "Test.java", "Spec.java")
CONFIG_EXTENSIONS = (".yaml", ".yml", ".json", ".toml", ".ini", ".env", ".cfg")
SKIP_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", "env", "dist", "build", ".idea", ".vscode", "coverage", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".eggs")
LOCK_NAMES = ("package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock", "pnpm-lock.yaml", "bun.lockb")
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".pdf", ".zip", ".tar", ".gz", ".bz2", ".xz", ".whl", ".egg", ".pyc", ".pyo", ".class", ".jar", ".war", ".so", ".dylib", ".dll", ".exe", ".o", ".a", ".wasm", ".bin", ".dat")
SMALLEST, LARGEST = 10, 500_000


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def language_of(extension: Column, first_line: Column | None = None) -> Column:
    """By extension in any case, else by the first line's interpreter, else 'unknown'."""
    ext = F.lower(extension)
    out = F.lit("unknown")
    if first_line is not None:
        for name, start in reversed(SHEBANGS):
            out = F.when(first_line.startswith(start), name).otherwise(out)
    for name, ends in EXTENSIONS.items():
        out = F.when(ext.isin(*ends), name).otherwise(out)
    return out


def file_flags(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Adds language and six flags to files with their text; a binary file (NUL in the first 8192 characters) has no other flag."""
    p, c = F.col(path), F.coalesce(F.col(content), F.lit(""))
    parts = F.split(p, "/")
    name, dirs = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    rows = first_lines(c, 5)
    first = first_filled_line(c)
    binary = F.substring(c, 1, 8192).contains("\x00")
    generated = _any(*(name.endswith(x) for x in GENERATED_ENDS), F.exists(rows, lambda x: _any(*(x.contains(m) for m in GENERATED_MARKS))))
    flags = {
        "is_generated": generated,
        "is_minified": name.contains(".min.") | (F.length(first) > 500),
        "is_vendor": F.arrays_overlap(parts, F.array(*map(F.lit, VENDOR_PARTS))),
        "is_test": F.arrays_overlap(dirs, F.array(*map(F.lit, TEST_DIRS))) | _any(*(name.contains(x) for x in TEST_NAMES)),
        "is_config": ext.isin(*CONFIG_EXTENSIONS),
    }
    lang = F.when(binary, "binary").otherwise(language_of(ext, F.coalesce(F.try_element_at(rows, F.lit(1)), F.lit(""))))
    return files.withColumns({"extension": ext, "language": lang, "is_binary": binary} | {k: ~binary & v for k, v in flags.items()})


def skip_reason(flagged: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Adds skip_reason (null: keep), the first reason that holds."""
    parts = F.split(F.col(path), "/")
    name = F.element_at(parts, -1)
    reason = (
        F.when(F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_DIRS))), "skip_dir")
        .when(F.exists(parts, lambda x: x.rlike(r"^.*\.(egg-info|dist-info)$")), "skip_dir_glob")
        .when(F.exists(parts, lambda x: x.startswith(".")), "hidden_dir")
        .when(F.col("is_vendor"), "vendor")
        .when(F.col("is_binary") | F.col("extension").isin(*BINARY_EXTENSIONS), "binary")
        .when(name.isin(*LOCK_NAMES), "lock_file")
        .when(F.col("is_generated"), "generated")
        .when(F.octet_length(F.coalesce(F.col(content), F.lit(""))) < SMALLEST, "too_small")
    )
    return flagged.withColumn("skip_reason", reason)


def parseable(flagged: DataFrame, content: str = "content") -> DataFrame:
    """Adds is_parseable and line_count (line feeds plus one)."""
    size = F.octet_length(F.coalesce(F.col(content), F.lit("")))
    return flagged.withColumns({"is_parseable": ~((size > LARGEST) | F.col("is_minified") | (F.col("language") == "unknown")), "line_count": newline_count(F.coalesce(F.col(content), F.lit("")))})


def structure_hints(files: DataFrame) -> DataFrame:
    """Per repository: number of top directories, whether one is src, and whether packages mark a monorepo."""
    parts = F.split("path", "/")
    top = F.when(F.size(parts) > 1, parts[0])
    return files.groupBy("repo_name").agg(
        F.count_distinct(top).alias("top_dirs"),
        F.coalesce(F.bool_or(F.array_contains(parts, "src")), F.lit(False)).alias("has_src_layout"),
        F.coalesce(F.bool_or(F.element_at(parts, -1).isin("lerna.json", "nx.json", "pnpm-workspace.yaml", "go.work")), F.lit(False)).alias("is_monorepo"),
    )
