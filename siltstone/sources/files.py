"""File sources: scanning trees under ignore rules, Markdown files, and glob patterns compiled to one regular expression each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.ids import file_hash

#: What a scan takes and leaves out unless told otherwise.
EXTENSIONS = (".go", ".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".rs", ".php", ".rb", ".swift", ".kt", ".scala", ".m", ".mm", ".dart", ".sol", ".md", ".markdown", ".ipynb")
IGNORED_NAMES = (".git", ".svn", ".hg", ".idea", ".vscode", "node_modules", "dist", "build", "out", "target", "coverage", "__pycache__", ".pytest_cache", ".cache", "tmp", "temp", "logs", ".siltstone")
IGNORED_PATTERNS = (
    "node_modules/**", "dist/**", "build/**", "out/**", "target/**", "coverage/**", ".nyc_output/**", ".git/**", ".svn/**", ".hg/**", ".idea/**", ".vscode/**", "__pycache__/**", ".pytest_cache/**", ".cache/**", "tmp/**", "temp/**", "logs/**",
    "*.log", ".env", ".env.*", "*.local", "*.min.js", "*.min.css", "*.min.map", "*.bundle.js", "*.bundle.css", "*.chunk.js", "*.vendor.js", "*.polyfills.js", "*.runtime.js", "*.map",
)
DOCUMENT_SKIPS = (".git", "node_modules", "dist", "build")


def glob_regex(pattern: str) -> str:
    """``*`` any run of characters, slashes too; ``?`` one character; everything else itself."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) if c.isascii() else c for c in pattern)


def pattern_regex(pattern: str) -> str | None:
    """One anchored expression over a relative path; null for a blank pattern.

    A leading slash anchors at the root. ``x/**`` is x or anything below it, at any depth unless anchored. A pattern without slash
    tests the file name or any segment, one with a slash the whole path or any segment.
    """
    p = pattern.strip()
    anchored = p.startswith("/")
    p = p.strip("/")
    if not p:
        return None
    if p.endswith("/**"):
        base = p[:-3]
        # the base as a pattern for the whole rest, or as literal text before a slash
        return f"^(?:{'' if anchored else '(?:.*/)?'}(?:{glob_regex(base)}|{re.escape(base)}/.*))$"
    if anchored or "/" in p:
        return f"^{glob_regex(p)}$"
    segment = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p)
    return f"^(?:.*/)?{segment}(?:/.*)?$"


def clean_patterns(patterns) -> list[str]:
    """Trimmed, without leading ``./``, each once; blanks, comments and negated ones dropped."""
    out = {}
    for p in patterns:
        q = re.sub(r"^\./", "", p.strip().replace("\\", "/"))
        if q and q[0] not in "#!":
            out[q] = None
    return list(out)


def matches_any(path: Column, patterns) -> Column:
    """Whether the path or one of its parent folders matches a pattern (a scan doesn't enter an ignored folder)."""
    rules = [r for r in map(pattern_regex, clean_patterns(patterns)) if r]
    if not rules:
        return F.lit(False)
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rule = "|".join(f"(?:{r})" for r in rules)
    return F.exists(prefixes, lambda p: p.rlike(rule))


def is_ignored(path: Column, *, names=IGNORED_NAMES, patterns=IGNORED_PATTERNS, extensions=EXTENSIONS) -> Column:
    """Hidden segments are ignored unless their extension is taken, named ones always, patterns on every prefix."""
    parts = F.split(path, "/")
    ext = lambda s: F.lower(F.regexp_extract(s, r"(\.[^.]*)$", 1))
    hidden = F.exists(parts, lambda s: s.startswith(".") & ~ext(s).isin(list(extensions)))
    named = F.exists(parts, lambda s: s.isin(list(names)))
    return hidden | named | matches_any(path, patterns)


def ignore_file_patterns(spark: SparkSession, root: str) -> list[str]:
    """Patterns of the ignore files in the root folder: no blank, comment or negated lines. Spark's readers skip hidden files, so these few are read by name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lines: list[str] = []
    for status in sorted(fs.listStatus(path), key=lambda s: s.getPath().getName()):
        if status.isFile() and re.fullmatch(r"\.[\w.-]*ignore", status.getPath().getName()):
            stream = fs.open(status.getPath())
            try:
                lines += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            finally:
                stream.close()
    return clean_patterns(lines)


def scan_files(spark: SparkSession, root: str, *, extensions=EXTENSIONS, names=IGNORED_NAMES, patterns=IGNORED_PATTERNS, content: bool = True) -> DataFrame:
    """absolute_path, relative_path, extension, size, mod_time_ns and, if wanted, content (string) and hash of the files under ``root``.

    Without content no file is read. Rows come in no order; sort by relative_path where one matters.
    """
    rules = [*patterns, *ignore_file_patterns(spark, root)]
    base = re.sub(r"^file:/+", "/", root).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    files = files.withColumn("absolute_path", path).withColumn("relative_path", F.substring(path, len(base) + 2, 1 << 20)).withColumn("extension", F.lower(F.regexp_extract("relative_path", r"(\.[^./]*)$", 1)))
    files = files.where(F.col("extension").isin(list(extensions)) & ~is_ignored(F.col("relative_path"), names=names, patterns=rules, extensions=extensions))
    cols = ["absolute_path", "relative_path", "extension", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mod_time_ns")]
    return files.select(*cols, F.decode("content", "UTF-8").alias("content"), file_hash(F.col("content")).alias("hash")) if content else files.select(*cols)


#: Up to so many paths are handed to the reader by name; beyond, the whole tree is read and the rest left out.
LISTED = 10_000


def read_files(spark: SparkSession, root: str, wanted: DataFrame, **options) -> DataFrame:
    """relative_path, content and hash of the files of a listing (absolute_path, relative_path); one that has vanished is left out."""
    paths = [r["absolute_path"] for r in wanted.select("absolute_path").limit(LISTED + 1).collect()]
    if len(paths) > LISTED:
        return wanted.join(scan_files(spark, root, **options).select("absolute_path", "content", "hash"), "absolute_path")
    scheme = "file:" if root.startswith("file:") else ""
    there = [scheme + p for p in paths if _there(spark, scheme + p)]
    if not there:
        rows = spark.createDataFrame([], "absolute_path string, content string, hash string")
    else:
        names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in there]  # the reader takes names for globs
        files = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(names)
        rows = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("absolute_path"), F.decode("content", "UTF-8").alias("content"), file_hash(F.col("content")).alias("hash"))
    return wanted.join(rows, "absolute_path")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files under ``root`` (a folder or one file), without those in skipped folders."""
    files = scan_files(spark, root, extensions=(".md", ".markdown"), names=(), patterns=()) if not re.search(r"\.(md|markdown)$", root, re.I) else None
    if files is None:
        rows = spark.read.format("binaryFile").load(root)
        path = F.regexp_replace("path", r"^file:/+", "/")
        return rows.select(path.alias("absolute_path"), F.regexp_extract(path, r"([^/]*)$", 1).alias("relative_path"), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).alias("extension"), F.decode("content", "UTF-8").alias("content"), file_hash(F.col("content")).alias("hash"))
    skip = "|".join(map(re.escape, DOCUMENT_SKIPS))
    return files.where(~F.col("relative_path").rlike(rf"(?:^|/)(?:{skip})(?:/)"))
