"""Text, path, map and domain functions as Columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{Nd}]+)"
EMBED_WORD = r"([A-Za-z0-9_一-龥]+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_space(x: Column | str) -> Column:
    """Without white space of any kind at the ends (``trim`` takes U+0020 alone)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def first_filled(*xs: Column | str) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(_c(x), F.lit("")) for x in xs), F.lit(""))


def meta(m: Column | str, key: str) -> Column:
    """A map entry; a missing one reads as the empty string."""
    return F.coalesce(_c(m)[key], F.lit(""))


def filled_entries(m: Column | str) -> Column:
    """The map without null, empty and blank values."""
    return F.map_filter(_c(m), lambda _, v: v.isNotNull() & (trim_space(v) != ""))


def overlay(below: Column, above: Column) -> Column:
    """Entries of both maps, those of ``above`` winning."""
    return F.transform(F.array(above), lambda top: F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(top, k)), top))[0]


def newlines(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"\r\n?", "\n")


def lines(x: Column | str) -> Column:
    """Lines after newline normalisation; a trailing empty line is kept."""
    return F.split(newlines(x), "\n", -1)


def keyword_tokens(x: Column | str) -> Column:
    """Runs of letters and digits, split where a lower-case letter meets an upper-case one, lower-cased, longer than one character."""
    parts = F.regexp_extract_all(F.regexp_replace(or_empty(x), r"(\p{Ll})(\p{Lu})", "$1 $2"), F.lit(WORD), F.lit(1))
    return F.filter(F.transform(parts, F.lower), lambda t: F.char_length(t) > 1)


def query_tokens(x: Column | str) -> Column:
    """Distinct keyword tokens in order of first appearance."""
    return F.array_distinct(keyword_tokens(x))


def embed_tokens(x: Column | str) -> Column:
    """Tokens for the hash embedding; a text without any has the one empty token."""
    t = F.regexp_extract_all(F.lower(or_empty(x)), F.lit(EMBED_WORD), F.lit(1))
    return F.when(F.size(t) == 0, F.array(F.lit(""))).otherwise(t)


def truncate_runes(x: Column | str, n: int) -> Column:
    return F.left(_c(x), F.lit(n))


def truncate_utf8(x: Column | str, n: int) -> Column:
    """The longest prefix of at most ``n`` UTF-8 bytes that ends between characters."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t is None else t.encode()[:n].decode(errors="ignore"))

    # Most values are short enough and stay in the JVM.
    long = F.octet_length(_c(x)) > n
    return F.when(long, cut(F.when(long, _c(x)))).otherwise(_c(x))


def collapse_space(x: Column | str) -> Column:
    return trim_space(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def evaluation_path(x: Column | str) -> Column:
    """Trimmed, one leading slash stripped."""
    return F.regexp_replace(trim_space(x), "^/", "")


def slug(x: Column | str) -> Column:
    dashed = F.translate(F.lower(trim_space(x)), "_ ", "--")
    kept = F.regexp_replace(F.regexp_replace(dashed, r"[^\p{L}\p{N}\-]+", ""), r"^-+|-+$", "")
    return F.when(kept == "", F.lit("document")).otherwise(kept)


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def document_id(path: Column | str) -> Column:
    """Slug of the file name without its extension."""
    return slug(F.regexp_replace(base_name(path), r"\.[^.]*$", ""))


def compact_headings(path: Column | str) -> Column:
    return F.filter(_c(path), lambda h: h.isNotNull() & (trim_space(h) != ""))


def heading_text(path: Column | str) -> Column:
    return F.array_join(compact_headings(path), " > ")


def section_id(path: Column | str) -> Column:
    """Slugs of the headings joined by slashes, ``root`` for text before any heading."""
    parts = F.transform(compact_headings(path), slug)
    return F.when(F.size(parts) == 0, F.lit("root")).otherwise(F.array_join(parts, "/"))


#: Keywords of the kinds of knowledge, first match counts.
KNOWLEDGE_KINDS = [
    ("troubleshooting", ["troubleshoot", "faq", "error", "错误", "排障", "故障"]),
    ("example", ["example", "sample", "示例", "例子"]),
    ("api", ["api", "function", "parameter", "接口", "参数", "配置项"]),
    ("rule", ["must", "should", "rule", "禁止", "必须", "应该", "规范", "规则"]),
]


def knowledge_kind(x: Column | str) -> Column:
    low, out = F.lower(or_empty(x)), F
    for kind, words in KNOWLEDGE_KINDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, kind)
    return out.otherwise("concept")


def domain_levels(x: Column | str) -> Column:
    """Lower-case levels of a domain path, blanks inside as dashes, empty ones dropped."""
    parts = F.transform(F.split(F.lower(or_empty(x)), "/"), lambda p: F.regexp_replace(trim_space(p), " ", "-"))
    return F.filter(parts, lambda p: p != "")


def normalize_domain(x: Column | str, strict: bool = False) -> Column:
    """One or two levels joined by ``/``; anything else is null, or an error if ``strict``."""
    levels = domain_levels(x)
    bad = F.raise_error(F.lit("a domain path has one or two levels")) if strict else F.lit(None).cast("string")
    return F.when(F.size(levels).between(1, 2), F.array_join(levels, "/")).otherwise(bad)


def domain_depth(x: Column | str) -> Column:
    return F.size(domain_levels(x))


def domain_parent(x: Column | str) -> Column:
    """The first level of a two-level domain, else the empty string."""
    levels = domain_levels(x)
    return F.when(F.size(levels) > 1, levels[0]).otherwise("")


def domain_matches(x: Column | str, prefix: Column | str) -> Column:
    """Whether the levels of ``prefix`` begin those of ``x``."""
    a, b = domain_levels(x), domain_levels(prefix)
    return (F.size(b) > 0) & (F.size(b) <= F.size(a)) & (F.slice(a, F.lit(1), F.size(b)) == b)


def normalize_extension(x: Column | str) -> Column:
    """Lower case with a dot; build files and Go tests keep their file name."""
    low = F.lower(trim_space(or_empty(x)))
    name = base_name(low)
    dotted = F.when((low == "") | low.startswith("."), low).otherwise(F.concat(F.lit("."), low))
    return F.when(name.isin("dockerfile", "makefile") | name.endswith("_test.go"), name).otherwise(dotted)


def normalized_text(x: Column | str) -> Column:
    return F.lower(trim_space(or_empty(x)))


def metadata_text(m: Column | str) -> Column:
    """Keys and values joined by blanks, in order of the keys."""
    entries = F.array_sort(F.map_entries(F.coalesce(_c(m), F.create_map().cast("map<string,string>"))))
    return F.array_join(F.flatten(F.transform(entries, lambda e: F.array(e["key"], or_empty(e["value"])))), " ")


def string_literal(value: str) -> str:
    """A double-quoted literal of the remote filter language."""
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


#: Language of each extension; every other one is text.
LANGUAGES = {".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".h": "cpp", ".md": "markdown", ".markdown": "markdown"}


def language_of(extension: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(table[F.lower(_c(extension))], F.lit("text"))


def source_id_of(path: Column | str, fallback: Column | str) -> Column:
    """File name without extension, else the fallback."""
    return first_filled(trim_space(F.regexp_replace(base_name(path), r"\.[^.]*$", "")), fallback)


def characters(x: Column | str) -> Column:
    return F.char_length(or_empty(x))


def estimated_tokens(x: Column | str) -> Column:
    """A quarter of the characters of the trimmed text, rounded up."""
    return F.floor((F.char_length(trim_space(or_empty(x))) + 3) / 4).cast("int")
