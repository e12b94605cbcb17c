"""Splitting oversized items at natural boundaries by pointer doubling.

Every line end (and, inside a line that alone exceeds the byte limit, every character) is a boundary. Each boundary is
joined to its farthest legal successor, where the next piece starts with the overlap and ends at the best natural
boundary within both limits. Squaring the successor table log2(n) times then marks every greedy cut of every text of an
Arrow batch at once; no text is walked piece by piece.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import free_name

MAX_LINES, MAX_BYTES, OVERLAP_LINES, OVERLAP_CHARS = 120, 4000, 20, 200
LINE_END = r"\r\n|\n|\r"
PIECES = "array<struct<piece_no:int,content:string,start_line:int,end_line:int,char_start:int,char_end:int>>"

_DEFINITION = re.compile(
    r"(?:func|def|class|interface|struct|enum|namespace|template|impl|fn|type|async def|export|public|private|protected|static|@\w)\b"
    r"|#{1,6}\s|\\(?:sub)*section|={2,}.+=|#(?:include|define)\b"
)
_CLOSE = re.compile(r"[}\])]+[;,)]*\s*$|end\b|\s*```|\s*~~~")
_FENCE = re.compile(r"\s*(?:```|~~~)")


def _strengths(lines: list[str]) -> np.ndarray:
    """How natural a cut after each line is: 4 before a definition or heading, 3 after a closed block or fence, 2 at a
    blank line, 1 at any line, 0 inside a fence."""
    out = np.ones(len(lines), np.int8)
    fenced = False
    for i, line in enumerate(lines):
        fence = _FENCE.match(line)
        if fence:
            fenced = not fenced
        if fenced:
            out[i] = 0
        elif _CLOSE.match(line):
            out[i] = 3
        elif not line.strip():
            out[i] = 2
        if not fenced and i + 1 < len(lines) and _DEFINITION.match(lines[i + 1]):
            out[i] = 4
    return out


def _units(text: str, max_bytes: int):
    """Units of one text: a line each, or a character each in overlong lines.

    Returns char start, char end, line number, byte position at start and end, strength, and whether overlong.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    at_byte = np.concatenate([[0], np.cumsum(width)])
    ends = [m.span() for m in re.finditer(LINE_END, text)]
    start = np.array([0] + [e for _, e in ends], np.int64)
    end = np.array([s for s, _ in ends] + [len(text)], np.int64)
    strength = _strengths([text[a:b] for a, b in zip(start, end)])
    long = at_byte[end] - at_byte[start] > max_bytes
    if not long.any():
        line = np.arange(len(start))
        return start, end, line, at_byte[start], at_byte[end], strength, long
    count = np.where(long, end - start, 1)
    line = np.repeat(np.arange(len(start)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    over = long[line]
    us = np.where(over, start[line] + inside, start[line])
    ue = np.where(over, us + 1, end[line])
    last = inside == count[line] - 1
    char = code[np.minimum(us, len(code) - 1)]
    soft = np.isin(char, np.frombuffer(" \t,;})]>".encode("utf-32-le"), np.uint32))
    st = np.where(over & ~last, soft.astype(np.int8), strength[line])
    return us, ue, line, at_byte[us], at_byte[ue], st, over


def split_texts(
    texts: list[str], max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, overlap_lines: int = OVERLAP_LINES, overlap_chars: int = OVERLAP_CHARS
) -> list[list[tuple[int, int, int, int]]]:
    """Pieces (char start, char end, first line, last line; lines from 0) of each text, all texts in one table."""
    if not texts:
        return []
    cols = [_units(t, max_bytes) for t in texts]
    size = np.array([len(c[0]) for c in cols])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    us, ue, line, bs, be, strength, over = (np.concatenate([c[i] for c in cols]) for i in range(7))
    own = np.repeat(np.arange(len(texts)), size)
    # Gaps of more than a whole limit keep every window inside its own text.
    line_gap = np.concatenate([[0], np.cumsum([c[2][-1] + 1 + 2 * max_lines for c in cols])[:-1]])[own]
    byte_gap = np.concatenate([[0], np.cumsum([c[4][-1] + 2 * max_bytes for c in cols])[:-1]])[own]
    gl, gs, ge = line + line_gap, bs + byte_gap, be + byte_gap
    n = len(us)
    idx = np.arange(n)
    head, tail = first[own], first[own] + size[own] - 1
    line_head = np.searchsorted(gl, gl, "left")
    # Where the piece after a cut at unit u begins: the last lines, or the last characters of an overlong line.
    begin = np.maximum(np.searchsorted(gl, gl - (overlap_lines - 1), "left") if overlap_lines > 0 else idx + 1, head)
    last_over = np.maximum.accumulate(np.where(over, idx, -1))
    has = (last_over >= begin) & (last_over >= head)
    begin = np.where(has, np.maximum(line_head[last_over], last_over - (overlap_chars - 1)), begin)
    if overlap_chars <= 0:
        begin = np.where(over, idx + 1, begin)
    # A cut whose whole overlap leaves room for the next unit is preferred; else it shrinks as far as that needs room.
    nxt = np.minimum(idx + 1, n - 1)
    whole = (ge[nxt] - gs[np.minimum(begin, idx)] <= max_bytes) & (gl[nxt] - gl[np.minimum(begin, idx)] < max_lines)
    begin = np.maximum(begin, np.searchsorted(gs, ge[nxt] - max_bytes, "left"))
    begin = np.maximum(begin, np.searchsorted(gl, gl[nxt] - (max_lines - 1), "left"))
    begin = np.minimum(begin, np.minimum(idx + 1, tail))
    # Node u + 1 + text number: "a piece ended with unit u"; one extra node per text stands before its first unit.
    begin_of = np.insert(begin, first, head[first])
    ended = np.insert(idx, first, first - 1)
    node_own = np.insert(own, first, own[first])
    stop = first[node_own] + size[node_own] - 1
    far = np.searchsorted(ge, gs[np.minimum(begin_of, n - 1)] + max_bytes, "right") - 1
    far = np.minimum(far, np.searchsorted(gl, gl[np.minimum(begin_of, n - 1)] + max_lines - 1, "right") - 1)
    far = np.clip(far, np.minimum(ended + 1, stop), stop)
    # A cut in the nearer half of the new text, or one whose successor would begin no later, isn't worth its boundary.
    low = np.maximum(ended + 1, ended + 1 + (far - ended) // 2)
    grows = np.searchsorted(begin + own * 0, begin_of, "right")
    low = np.minimum(np.maximum(low, np.minimum(grows, far)), far)
    soonest = np.minimum(np.maximum(ended + 1, grows), far)
    to = np.full(len(far), -1)
    latest = lambda ok: np.maximum.accumulate(np.where(ok, idx, -1))[far]
    choices = [(whole & (strength == level), low) for level in (4, 3, 2, 1, 0)] + [(whole, soonest)] + [(strength == level, low) for level in (4, 3, 2, 1, 0)]
    for ok, least in choices:
        last = latest(ok)
        to = np.where((to < 0) & (last >= least), last, to)
    to = np.where(far == stop, stop, to)
    succ = to + 1 + node_own  # node of unit `to`
    at_end = ended == stop
    succ = np.where(at_end, np.arange(len(succ)), succ)
    succ0 = succ.copy()
    reach = np.zeros(len(succ), bool)
    reach[first + np.arange(len(texts))] = True
    while True:  # square the successor table
        more = reach.copy()
        more[succ[reach]] = True
        if (more == reach).all():
            break
        reach, succ = more, succ[succ]
    source = np.flatnonzero(reach & ~at_end)
    target = ended[succ0[source]]
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for k, a, b in zip(node_own[source].tolist(), begin_of[source].tolist(), target.tolist()):
        out[k].append((int(us[a]), int(ue[b]), int(line[a]), int(line[b])))
    return out


def _pieces(content: pd.Series, base: pd.Series, limits: tuple[int, int, int, int]) -> pd.Series:
    out: list = [None] * len(content)
    values, bases = content.tolist(), base.tolist()
    rows = [i for i, t in enumerate(values) if isinstance(t, str)]
    for at in range(0, len(rows), 64):
        some = rows[at : at + 64]
        for i, cuts in zip(some, split_texts([values[i] for i in some], *limits)):
            b = int(bases[i]) if bases[i] == bases[i] and bases[i] is not None and bases[i] >= 1 else 1
            out[i] = [
                {"piece_no": k, "content": values[i][s:e], "start_line": b + ls, "end_line": b + le, "char_start": s, "char_end": e}
                for k, (s, e, ls, le) in enumerate(cuts, 1)
            ]
    return pd.Series(out)


def oversized(content: Column, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> Column:
    return (F.octet_length(content) > max_bytes) | (F.regexp_count(content, F.lit(LINE_END)) + 1 > max_lines)


def split_oversized(
    df: DataFrame, content: str = "content", start_line: str | None = "start_line", *, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES,
    overlap_lines: int = OVERLAP_LINES, overlap_chars: int = OVERLAP_CHARS, only_oversized: bool = False,
) -> DataFrame:
    """One row per piece: all columns of ``df`` and a struct ``piece`` (piece_no, content, start_line, end_line, char_start, char_end) and ``n_pieces``.

    A piece has at most ``max_lines`` lines and ``max_bytes`` UTF-8 bytes and starts with the last ``overlap_lines`` lines of
    the one before (of an overlong line, its last ``overlap_chars`` characters); the overlap is shorter only where no cut
    leaves room for the next line beside all of it. Row within both limits, null and empty contents: one piece, the content as it is. A null
    or non-positive start line counts as 1. Names already taken get a leading underscore. Repeated rows are split alike.
    """
    if overlap_lines >= max_lines or overlap_chars * 4 >= max_bytes:
        raise ValueError("the overlap must be smaller than the limits")
    limits = (max_lines, max_bytes, overlap_lines, overlap_chars)

    @F.pandas_udf(PIECES)
    def pieces(c: pd.Series, b: pd.Series) -> pd.Series:
        return _pieces(c, b, limits)

    taken = df.columns
    piece, count, base = free_name(taken, "piece"), free_name(taken, "n_pieces"), F.coalesce(F.col(start_line).cast("int"), F.lit(1)) if start_line else F.lit(1)
    over = F.coalesce(oversized(F.col(content), max_lines, max_bytes), F.lit(False))
    if only_oversized:
        df = df.where(over)
    tmp = free_name(taken, "pieces_of")
    first = F.greatest(base, F.lit(1))
    lines = F.coalesce(F.regexp_count(F.col(content), F.lit(LINE_END)), F.lit(0))
    whole = F.array(F.struct(
        F.lit(1).alias("piece_no"), F.col(content).alias("content"), first.alias("start_line"), (first + lines).cast("int").alias("end_line"),
        F.lit(0).alias("char_start"), F.coalesce(F.char_length(content), F.lit(0)).alias("char_end"),
    ))
    out = df.withColumn(tmp, F.coalesce(pieces.asNondeterministic()(F.when(over, F.col(content)), base), whole))
    return out.withColumn(count, F.size(tmp)).withColumn(piece, F.explode(tmp)).drop(tmp)
