import random
import re

from siltstone.llm.splitting import LINE_END, split_oversized, split_texts

SCHEMA = "id string, content string, start_line int, piece int"


def greedy(text, max_lines, max_bytes):
    """Fewest pieces a plain walk needs without overlap: a lower bound."""
    n, lines, size = 0, 0, 0
    for line in re.split(LINE_END, text):
        b = len(line.encode()) + (1 if lines else 0)
        if lines and (lines + 1 > max_lines or size + b > max_bytes):
            n, lines, size = n + 1, 0, 0
        lines, size = lines + 1, size + b
    return n + 1


def check(text, max_lines, max_bytes, overlap, chars):
    cuts = split_texts([text], max_lines, max_bytes, overlap, chars)[0]
    lines = re.split(LINE_END, text)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for s, e, a, b in cuts:
        piece = text[s:e]
        assert len(piece.encode()) <= max_bytes and len(re.split(LINE_END, piece)) <= max_lines
        assert len(re.split(LINE_END, text[:s])) - 1 == a and 0 <= a <= b < len(lines)
    for p, q in zip(cuts, cuts[1:]):
        assert q[1] > p[1] and q[0] <= p[1] + 2 and q[0] >= p[0]
    return cuts


def test_random_texts():
    r = random.Random(3)
    for _ in range(150):
        text = "".join(r.choice(["a", "é", "漢字", "}", "\n", "\r\n", "\r", "```\n", "func f() {\n", "x" * r.randint(1, 30), "\n\n", "🙂"]) for _ in range(r.randint(1, 250)))
        check(text, r.choice([4, 9, 30]), r.choice([60, 90, 400]), 3, 10)


def test_long_texts_together_equal_alone():
    r = random.Random(5)
    texts = ["\n".join("w" * r.randint(0, 80) for _ in range(r.randint(1, 900))) for _ in range(12)] + ["z" * 30_000, "", "\n" * 500]
    assert split_texts(texts) == [split_texts([t])[0] for t in texts]
    for t in texts[:-2]:
        cuts = check(t, 120, 4000, 20, 200)
        assert len(cuts) >= min(2, greedy(t, 120, 4000))
    assert all(q[0] == p[1] - 200 for p, q in zip(*(lambda c: (c, c[1:]))(split_texts(["z" * 30_000])[0])))


def test_overlap_and_boundaries():
    text = "\n".join(f"line {i}" for i in range(400))
    cuts = split_texts([text])[0]
    assert all(q[2] == p[3] - 19 for p, q in zip(cuts, cuts[1:]))
    code = "\n".join(["func a() {"] + ["\tx()"] * 90 + ["}", ""] + ["func b() {"] + ["\ty()"] * 90 + ["}"])
    assert split_texts([code])[0][0][3] == 92  # before the second function


def test_a_cut_with_the_whole_overlap_is_preferred():
    r = random.Random(9)
    for _ in range(60):
        text = "\n".join("w" * r.choice([0, r.randint(100, 500)]) for _ in range(200))
        size = [len(x) for x in text.split("\n")]
        room = lambda a, b: sum(size[a : b + 1]) + b - a
        cuts = split_texts([text])[0]
        for p, q in zip(cuts, cuts[1:]):
            if p[3] - q[2] + 1 < 20:  # only where no cut leaves room for the next line beside 20 lines
                assert not [u for u in range(p[2] + 20, 199) if room(p[2], u) <= 4000 and u - p[2] < 120 and room(u - 19, u + 1) <= 4000]


def test_frame(spark):
    big = "\n".join("x" for _ in range(121))
    rows = [("a", big, None, 1), ("a", big, None, 1), ("b", None, 5, 2), ("c", "", 7, 3), ("d", "one\ntwo", 9, 4), ("e", "y" * 5000, -1, 5)]
    out = split_oversized(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["n_pieces"] for r in out if r["id"] == "a"] == [2, 2, 2, 2]
    by = {r["id"]: r for r in out}
    assert by["b"]["_piece"]["content"] is None and by["c"]["_piece"]["content"] == "" and by["d"]["_piece"]["end_line"] == 10 and by["d"]["piece"] == 4
    assert {(r["_piece"]["start_line"], r["_piece"]["end_line"]) for r in out if r["id"] == "e"} == {(1, 1)}
    assert split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0
