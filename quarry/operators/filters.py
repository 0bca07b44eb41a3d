"""Which files count: ignored folders and suffixes, hidden names, size and .gitignore rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import components, language_of

# Folders and suffixes that are left out.
IGNORED_DIRS = [
    "node_modules", "vendor", "__pycache__", ".pycache", "target", "dist", "build", ".git", ".hg", ".svn", ".next", ".nuxt", ".output", ".cache",
    ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "venv", ".venv", "env", ".env", "coverage", ".coverage", ".nyc_output", "htmlcov",
    ".terraform", ".serverless",
]
IGNORED_SUFFIXES = [
    "min.js", "min.css", "pyc", "pyo", "class", "o", "so", "dylib", "dll", "exe", "a", "lib", "jar", "war", "ear", "zip", "tar", "gz", "bz2", "xz",
    "7z", "rar", "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "webp", "mp3", "mp4", "avi", "mov", "wmv", "flv", "woff", "woff2", "ttf", "eot",
    "otf", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "db", "sqlite", "sqlite3", "lock", "map",
]


def ignored_dir(path: Column) -> Column:
    return F.arrays_overlap(components(path), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def ignored_extension(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(re.escape(s) for s in IGNORED_SUFFIXES) + ")$")


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def filter_ignored_dirs(files: DataFrame) -> DataFrame:
    return files.where(~ignored_dir(F.col("path")))


def filter_ignored_extensions(files: DataFrame) -> DataFrame:
    return files.where(~ignored_extension(F.col("path")))


def filter_hidden(files: DataFrame) -> DataFrame:
    return files.where(~hidden(F.col("path")))


def filter_max_size(files: DataFrame, n: int = 1_000_000) -> DataFrame:
    return files.where(F.col("size") <= n)


def readable_only(files: DataFrame) -> DataFrame:
    return files.where("readable")


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def glob_regex(pattern: str) -> tuple[str, bool, bool]:
    """(regex on a path below the rule's folder, negated, folders only) of one .gitignore line."""
    negated = pattern.startswith("!")
    p = pattern[1:] if negated or pattern.startswith("\\") else pattern
    only_dir = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, k = "", 0
    while k < len(p):
        if p[k : k + 3] == "**/":
            out, k = out + "(?:.*/)?", k + 3
        elif p[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        elif p[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif p[k] == "?":
            out, k = out + "[^/]", k + 1
        elif p[k] == "[" and "]" in p[k + 2 :]:
            end = p.index("]", k + 2)
            own = p[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + own[1:] if own[0] in "!^" else own) + "]", end + 1
        else:
            k += p[k] == "\\" and k + 1 < len(p)
            out, k = out + re.escape(p[k]), k + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, only_dir


def gitignore_rules(files: DataFrame) -> DataFrame:
    """(project, dir, rule_no, regex, negated, only_dir) of the .gitignore files among files."""
    lines = files.where(F.col("path").rlike(r"(^|/)\.gitignore$")).select("project", F.regexp_replace("path", r"/?\.gitignore$", "").alias("dir"), F.posexplode(F.split("content", "\r?\n")).alias("rule_no", "rule"))
    lines = lines.withColumn("rule", F.regexp_replace("rule", r"(?<!\\) +$", "")).where("rule != '' and not startswith(rule, '#')")
    parse = F.udf(lambda r: glob_regex(r), "struct<regex string, negated boolean, only_dir boolean>")
    return lines.withColumn("p", parse("rule")).select("project", "dir", "rule_no", "p.*")


def filter_gitignore(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The files that no rule leaves out: the last matching rule decides, the deeper folder's later; what lies under an ignored folder
    stays ignored."""
    parts = components(F.col("path"))
    paths = files.select("project", "path").distinct()
    # Every ancestor and the file itself, each once per project.
    each = paths.select("project", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("node"), (k < F.size(parts)).alias("is_dir")))).alias("n"))
    nodes = each.select("project", "n.*").distinct()
    above = F.concat(F.array(F.lit("")), F.transform(F.filter(F.sequence(F.lit(1), F.size(F.split("node", "/"))), lambda k: k < F.size(F.split("node", "/"))), lambda k: F.array_join(F.slice(F.split("node", "/"), 1, k), "/")))
    tried = nodes.select("project", "node", "is_dir", F.explode(above).alias("dir")).join(rules, ["project", "dir"])
    own = F.when(F.col("dir") == "", F.col("node")).otherwise(F.substr("node", F.length("dir") + 2))
    hit = tried.where(F.expr("is_dir or not only_dir") & F.rlike(own, F.col("regex")))
    verdict = hit.groupBy("project", "node").agg(F.max_by("negated", F.struct(F.length("dir"), "rule_no")).alias("kept")).where("not kept")
    out = each.select("project", "path", F.col("n.node").alias("node")).join(verdict, ["project", "node"], "left_semi").select("project", "path").distinct()
    return files.join(out, ["project", "path"], "left_anti")
