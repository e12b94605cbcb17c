"""Line windows, document and Markdown chunks, syntax chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import lines, trim_space

MAX_LINES, OVERLAP = 120, 20


def window_sizes(max_lines: int, overlap: int) -> tuple[int, int]:
    """No or negative size means 120 lines, a negative overlap none, one as large as the window a quarter of it."""
    m = max_lines if max_lines > 0 else MAX_LINES
    o = max(overlap, 0)
    return m, (m // 4 if o >= m else o)


def line_windows(text_lines: Column, first_line: Column, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> Column:
    """array<struct<content, start_line, end_line>> of non-blank windows over an array of lines."""
    m, o = window_sizes(max_lines, overlap)
    step = m - o
    n = F.size(text_lines)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - m) / step) * step).cast("int"), F.lit(step))
    piece = lambda s: F.struct(
        F.array_join(F.slice(text_lines, s + 1, F.lit(m)), "\n").alias("content"), (first_line + s).alias("start_line"), (first_line + F.least(s + m, n) - 1).alias("end_line")
    )
    return F.filter(F.transform(starts, piece), lambda c: trim_space(c["content"]) != "")


def line_chunks(df: DataFrame, text: str = "content", *, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """One row per window, with chunk_content, start_line and end_line; null text gives none."""
    df = df.withColumn("_lines", lines(F.col(text)))
    return df.select(*[c for c in df.columns if c != "_lines"], F.inline(line_windows(F.col("_lines"), F.lit(1), max_lines, overlap)).alias("chunk_content", "start_line", "end_line"))


def keep_outer_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Ranges (start_line, end_line, kind) that don't lie inside one that begins earlier, or at the same line and ends later."""
    w = Window.partitionBy(*by).orderBy("start_line", F.desc("end_line"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.where((F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")))
    return ranges.withColumn("_max", F.max("end_line").over(w)).where("_max is null or end_line > _max").drop("_max")


def range_chunks(files: DataFrame, ranges: DataFrame, key: str, *, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of each file's ranges, clamped to the file, long ones windowed, with the range's metadata.

    ``files`` has ``key`` and content; ``ranges`` key, start_line, end_line, kind, metadata. Both sides shuffle on the key once.
    """
    both = files.select(key, lines(F.col("content")).alias("_l")).join(keep_outer_ranges(ranges, [key]), key)
    both = both.withColumn("end_line", F.least("end_line", F.size("_l"))).where("start_line <= end_line")
    part = F.slice("_l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return both.withColumn("_p", part).select(key, "metadata", F.inline(line_windows(F.col("_p"), F.col("start_line"), max_lines, overlap)).alias("content", "start_line", "end_line"))


# Document nodes: titles and summaries pass, bodies are windowed. With an extender the end depends on the text.

Extender = Callable[[list[str], int, int, int], int]


def is_fence(line: str) -> bool:
    return line.strip().startswith(("```", "~~~"))


def is_table(line: str) -> bool:
    t = line.strip()
    return bool(t) and t.startswith("|") and t.endswith("|")


def markdown_boundary(text_lines: list[str], start: int, end: int, limit: int) -> int:
    """Pushes a window's end past an open fence and an unfinished table."""
    fences = sum(map(is_fence, text_lines[start:end]))
    while fences % 2 and end < limit:
        fences += is_fence(text_lines[end])
        end += 1
    while end < limit and is_table(text_lines[end - 1]) and is_table(text_lines[end]):
        end += 1
    return min(end, limit)


def body_windows(text: str, first_line: int, max_lines: int, overlap: int, extender: Extender | None = None) -> list[tuple[str, int, int]]:
    m, o = window_sizes(max_lines, overlap)
    rows, out, start = text.split("\n"), [], 0
    while True:
        end = min(start + m, len(rows))
        if extender:
            end = extender(rows, start, end, len(rows))
        content = "\n".join(rows[start:end])
        if content.strip():
            out.append((content, first_line + start, first_line + end - 1))
        if end >= len(rows):
            return out
        start = end - o if end - o > start else end


CHUNK_LIST = "array<struct<content:string,start_line:int,end_line:int>>"


def node_chunks(nodes: DataFrame, *, max_lines: int = MAX_LINES, overlap: int = OVERLAP, extender: Extender | None = None) -> DataFrame:
    """Chunks of parsed nodes (kind, content, start_line, end_line, ...): blank ones dropped, bodies windowed, others whole."""
    whole = F.array(F.struct("content", "start_line", "end_line"))
    body = F.col("kind") == "body"
    if extender is None:
        parts = line_windows(lines(F.col("content")), F.col("start_line"), max_lines, overlap)
    else:

        @F.pandas_udf(CHUNK_LIST)
        def extended(text: pd.Series, first: pd.Series) -> pd.Series:
            return pd.Series([[dict(zip(("content", "start_line", "end_line"), c)) for c in body_windows(t, int(f), max_lines, overlap, extender)] if isinstance(t, str) else [] for t, f in zip(text, first)])

        parts = extended(F.when(body, F.col("content")), F.coalesce("start_line", F.lit(1)))
    rest = [c for c in nodes.columns if c not in ("content", "start_line", "end_line")]
    out = nodes.where(trim_space(F.coalesce("content", F.lit(""))) != "")
    return out.select(*rest, F.inline(F.when(body, parts).otherwise(whole)).alias("content", "start_line", "end_line"))


# Syntax chunks: a scanner for top-level declarations of Go and C++. In doubt the whole file falls back to line windows.

_GO = [
    ("package", re.compile(r"package\s+(\w+)")), ("import", re.compile(r"import\b()")), ("const", re.compile(r"const\b\s*(\w*)")), ("var", re.compile(r"var\b\s*(\w*)")),
    ("type", re.compile(r"type\b\s*(\w*)")), ("method", re.compile(r"func\s*\([^)]*\)\s*(\w+)")), ("function", re.compile(r"func\s+(\w+)")),
]
_CPP = [
    ("include", re.compile(r"#\s*include\b\s*()")), ("macro", re.compile(r"#\s*define\s+(\w+)")), ("namespace", re.compile(r"(?:inline\s+)?namespace\b\s*([\w:]*)")), ("template", re.compile(r"template\b()")),
    ("class", re.compile(r"class\s+(\w+)[^;(]*$")), ("struct", re.compile(r"struct\s+(\w+)[^;(]*$")), ("union", re.compile(r"union\s+(\w+)[^;(]*$")),
    ("function", re.compile(r"[\w:<>,*&~\s\[\]]+?([\w:~]+)\s*\([^;]*$")),
]
_QUOTES = {"go": "\"'`", "cpp": "\"'"}


def _bare(text: str, language: str) -> list[str] | None:
    """Lines with comments and string contents blanked; null where a comment or string never ends."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith("//", i):
            j = text.find("\n", i)
            i = n if j < 0 else j
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            if j < 0:
                return None
            out.append("\n" * text.count("\n", i, j))
            i = j + 2
        elif c in _QUOTES[language]:
            j = i + 1
            while j < n and text[j] != c:
                if text[j] == "\n" and c != "`":
                    return None
                j += 2 if text[j] == "\\" and c != "`" else 1
            if j >= n:
                return None
            out.append(c + "\n" * text.count("\n", i, j) + c)
            i = j + 1
        else:
            out.append(c)
            i += 1
    return "".join(out).split("\n")


def syntax_ranges(text: str, language: str) -> list[tuple[int, int, str, str]] | None:
    """(start line, end line, kind, symbol name) of top-level declarations; null on unbalanced text or none found."""
    rows = _bare(text, language)
    if rows is None:
        return None
    rules, out, i = (_GO if language == "go" else _CPP), [], 0
    while i < len(rows):
        line = rows[i].strip()
        found = next(((kind, m.group(1)) for kind, rule in rules if (m := rule.match(line))), None) if line else None
        if found is None:
            if line.count("{") != line.count("}") or (language == "go" and line and not line.startswith("}")):
                return None
            i += 1
            continue
        depth, end, opened = 0, i, False
        while end < len(rows):
            for c in rows[end]:
                if c in "{(":
                    depth, opened = depth + 1, opened or c == "{"
                elif c in "})":
                    depth -= 1
                    if depth < 0:
                        return None
            more = found[0] in ("namespace", "template", "class", "struct", "union", "function", "method") and not opened and not rows[end].rstrip().endswith(";")
            if depth == 0 and not (more and language == "cpp") and not rows[end].rstrip().endswith("\\"):
                break
            end += 1
        if end >= len(rows):
            return None
        out.append((i + 1, end + 1, found[0], found[1]))
        i = end + 1
    return out or None


def syntax_chunks(df: DataFrame, key: str = "relative_path", content: str = "content", language: str = "language", *, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Declaration chunks of Go and C++ files, line windows of all others: key, content, start_line, end_line, metadata."""

    @F.pandas_udf("array<struct<content:string,start_line:int,end_line:int,metadata:map<string,string>>>")
    def parse(text: pd.Series, lang: pd.Series) -> pd.Series:
        out = []
        for t, l in zip(text, lang):  # noqa: E741
            if not isinstance(t, str):
                out.append([])
                continue
            t = re.sub(r"\r\n?", "\n", t)
            found = syntax_ranges(t, l) if l in ("go", "cpp") else None
            rows = t.split("\n")
            pieces = []
            for start, end, kind, name in found or [(1, len(rows), "", "")]:
                info = {k: v for k, v in {"chunk_kind": "syntax_node", "parser": "declaration-scanner", "symbol_kind": kind, "symbol_name": name}.items() if v} if found else {}
                pieces += [{"content": c, "start_line": a, "end_line": b, "metadata": info} for c, a, b in body_windows("\n".join(rows[start - 1 : end]), start, max_lines, overlap)]
            out.append(pieces)
        return pd.Series(out)

    return df.select(F.col(key), F.inline(parse(F.col(content), F.col(language))))
