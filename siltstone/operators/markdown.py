"""Markdown files parsed into title, summary and body nodes, by windows over their lines."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import document_id, knowledge_kind, lines, section_id, trim_space
from siltstone.schema import NODE

_HEADING = re.compile(r"(#{1,6}) (.*\S.*)")
_FENCE = ("```", "~~~")
#: What a summary line begins with.
SUMMARY_PREFIXES = ("summary:", "abstract:", "摘要：", "摘要:")
SECTIONS = "array<struct<path:array<string>,heading:string,summary:string,content:string,start_line:int,end_line:int,summary_line:int>>"


def summary_of(line: str) -> str | None:
    t = line.strip()
    if t.startswith(">"):
        return t[1:].strip()
    low = t.lower()
    return next((t[len(p) :].strip() for p in SUMMARY_PREFIXES if low.startswith(p)), None)


def sections(text: str) -> list[dict]:
    """Sections of one text: heading path, heading, summary under it, body lines (heading line included)."""
    rows = re.sub(r"\r\n?", "\n", text).split("\n")
    if not text.strip():
        return []
    starts: list[tuple[int, int, str]] = []
    fenced = False
    for i, line in enumerate(rows):
        t = line.strip()
        if t.startswith(_FENCE):
            fenced = not fenced
        elif not fenced and (m := _HEADING.fullmatch(t)):
            starts.append((i, len(m.group(1)), m.group(2).strip()))
    bounds = ([] if starts and starts[0][0] == 0 else [(0, 0, "")]) + starts
    out, stack = [], [""] * 6
    for k, (i, level, heading) in enumerate(bounds):
        end = bounds[k + 1][0] if k + 1 < len(bounds) else len(rows)
        if level:
            stack[level - 1 :] = [heading] + [""] * (6 - level)
        first = next((j for j in range(i + bool(level), end) if rows[j].strip()), None)
        summary = summary_of(rows[first]) if first is not None else None
        out.append({"path": [h for h in stack if h] if level else [], "heading": heading, "summary": summary, "content": "\n".join(rows[i:end]), "start_line": i + 1, "end_line": end, "summary_line": (first or 0) + 1})
    return out


def parse_markdown(files: DataFrame, path: str = "relative_path", content: str = "content") -> DataFrame:
    """One row per node, in order: the file's columns (content aside) and kind, content, document_id, section_id, heading_path, knowledge_kind, lines, metadata."""

    @F.pandas_udf(SECTIONS)
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([sections(t) if isinstance(t, str) else [] for t in texts])

    keep = [c for c in files.columns if c != content]
    s = files.select(*keep, document_id(path).alias("_doc"), F.explode(split(F.col(content))).alias("s"))
    sec = section_id(F.col("s.path"))
    node = lambda kind, text, know, a, b: F.struct(
        F.lit(kind).alias("kind"), text.alias("content"), F.col("_doc").alias("document_id"), sec.alias("section_id"), F.col("s.path").alias("heading_path"), know.alias("knowledge_kind"),
        a.alias("start_line"), b.alias("end_line"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    headed = F.size("s.path") > 0
    words = lambda text: knowledge_kind(F.concat_ws(" ", F.array_join("s.path", " "), text))
    title = node("title", F.col("s.heading"), F.lit("concept"), F.col("s.start_line"), F.col("s.start_line"))
    summary = node("summary", F.col("s.summary"), words(F.col("s.summary")), F.col("s.summary_line"), F.col("s.summary_line"))
    body = node("body", F.col("s.content"), words(F.col("s.content")), F.col("s.start_line"), F.col("s.end_line"))
    nodes = F.filter(F.array(F.when(headed, title), F.when(F.col("s.summary").isNotNull(), summary), body).cast(f"array<{NODE}>"), lambda n: n.isNotNull())
    return s.select(*keep, F.inline(nodes))


#: Parsers by extension: a table of files (extension, path and content among its columns) to one of nodes.
Parser = Callable[[DataFrame], DataFrame]
PARSERS: dict[str, Parser] = {".md": parse_markdown, ".markdown": parse_markdown}


def parse_documents(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Nodes of all files whose extension has a parser, each parser over its own extensions; the others give none."""
    by_parser: dict[Parser, list[str]] = {}
    for extension, parser in (PARSERS if parsers is None else parsers).items():
        by_parser.setdefault(parser, []).append(extension.lower())
    out = None
    for parser, extensions in by_parser.items():
        nodes = parser(files.where(F.lower("extension").isin(extensions)))
        out = nodes if out is None else out.unionByName(nodes)
    if out is None:
        raise ValueError("no parser")
    return out


def storage_metadata(node_metadata: Column, document: Column, section: Column, heading: Column, knowledge: Column, kind: Column) -> Column:
    """Five fixed entries, empty ones kept; the node's own entries win."""
    fixed = F.create_map(F.lit("document_id"), document, F.lit("section_id"), section, F.lit("heading_path"), heading, F.lit("knowledge_kind"), knowledge, F.lit("node_kind"), kind)
    own = F.coalesce(node_metadata, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(fixed, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)


def blank(text: Column) -> Column:
    return trim_space(F.coalesce(text, F.lit(""))) == ""


def heading_lines(files: DataFrame, path: str = "relative_path", content: str = "content") -> DataFrame:
    """path, line, level, heading, next_line of each heading outside fences, in the JVM alone.

    A file's lines stay in its own row: fence parity is folded along the array, so there is no shuffle.
    """
    step = lambda acc, line: F.struct(
        (acc["n"] + 1).alias("n"), F.when(trim_space(line).rlike("^(```|~~~)"), ~acc["f"]).otherwise(acc["f"]).alias("f"),
        F.when(~acc["f"] & trim_space(line).rlike(r"^#{1,6} .*\S"), F.concat(acc["h"], F.array(F.struct((acc["n"] + 1).alias("line"), trim_space(line).alias("text"))))).otherwise(acc["h"]).alias("h"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("f"), F.array().cast("array<struct<line:int,text:string>>").alias("h"))
    heads = F.aggregate(lines(F.col(content)), start, step)
    rows = files.select(F.col(path).alias("path"), heads.alias("a")).select("path", F.col("a.n").alias("n"), "a.h")
    rows = rows.select("path", "n", "h", F.posexplode("h").alias("i", "x"))
    following = F.when(F.col("i") + 1 < F.size("h"), F.col("h")[F.col("i") + 1]["line"]).otherwise(F.col("n") + 1)
    return rows.select("path", F.col("x.line").alias("line"), F.length(F.regexp_extract("x.text", "^(#+)", 1)).alias("level"), trim_space(F.regexp_replace("x.text", "^#+ ", "")).alias("heading"), following.alias("next_line"))
