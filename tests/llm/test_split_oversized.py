import random

from pyspark.sql import functions as F

from cairnlake.llm.split_oversized import MIN_SHARE, cut, split, strengths

SCHEMA = "id string, start_line int, end_line int, content string, text string, line int, item_id string"


def slow(text, limit, overlap):
    """The same rule, position by position."""
    s, low, start, out = strengths(text), max(int(limit * MIN_SHARE), overlap + 1), 0, []
    while len(text) - start > limit:
        end = max(range(start + low, start + limit + 1), key=lambda i: (s[i], i))
        out.append((start, end))
        begin = end - overlap
        lines = [i for i in range(begin, end) if text[i - 1] == "\n"]
        words = [i for i in range(begin, end) if text[i - 1] in " \t" and text[i] not in " \t\r\n"]
        begin = lines[0] if lines else words[0] if words else begin
        start = max(begin + (text[begin - 1:begin + 1] == "\r\n"), start + 1)
    return [*out, (start, len(text))]


def test_against_slow_rule():
    rng = random.Random(1)
    for _ in range(120):
        text = "".join(rng.choice("abc   \n\n.\r;é") for _ in range(rng.choice([60, 300, 3000]))).replace("\r", "\r\n")
        limit, overlap = rng.choice([(43, 4), (103, 20), (1003, 200), (43, 0)])
        assert cut(text, limit, overlap) == (slow(text, limit, overlap) if overlap else cut(text, limit, 0))


def test_very_long_text_in_segments():
    rng = random.Random(2)
    text = "\n".join("x" * rng.randrange(90) for _ in range(6000))
    spans = cut(text, 3203, 320)
    assert all(0 < e - s <= 3203 for s, e in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a[1] - 320 <= b[0] < a[1] for a, b in zip(spans, spans[1:]))


def test_pieces(spark):
    long = "\n".join(f"line {i} of the text" for i in range(900))
    none = "x" * 9000
    data = [("a", 11, 5, long, "c", 1, "z"), ("a", 11, 5, long, "c", 1, "z"), ("b", None, 1, none, None, None, None), ("c", 3, 3, "short\n", "", 1, ""), ("d", 1, 1, None, "", 1, ""), ("e", 1, 1, "", "", 1, ""),
            ("f", 1, 1, "é" * 3203, "", 1, ""), ("g", 1, 1, "é" * 3204, "", 1, "")]
    got = {}
    for r in split(spark.createDataFrame(data, SCHEMA)).orderBy("item_id", "piece_no").collect():
        got.setdefault(r["item_id"], []).append(r)
    assert set(got) == set("abcdefg")
    assert all(p["token_count"] <= 800 for ps in got.values() for p in ps)
    for p in got["a"]:  # the lines are where the piece says
        body = p["content"].rstrip("\n").split("\n")
        assert body[0] == f"line {p['start_line'] - 11} of the text" and body[-1] == f"line {p['end_line'] - 11} of the text"
    whole, at = "", 0
    for p in got["a"]:
        whole, at = whole + p["content"][at - p["start_char"]:], p["end_char"]
    assert whole == long
    assert [len(got[k]) for k in "cdef"] == [1, 1, 1, 1] and len(got["g"]) == 2 and len(got["b"]) == 4
    assert (got["c"][0]["start_line"], got["c"][0]["end_line"]) == (3, 3) and got["d"][0]["token_count"] == 0


def test_crlf_is_not_cut():
    text = "ab\r\n" * 3000
    for s, e in cut(text, 1001, 100):
        assert text[e - 1:e + 1] != "\r\n" and text[s - 1:s + 1] != "\r\n"


def test_empty(spark):
    assert split(spark.createDataFrame([], SCHEMA)).count() == 0
    assert split(spark.createDataFrame([], SCHEMA), keep_small=False).select(F.col("item_id")).count() == 0


def test_rows_without_an_id_are_items(spark):
    data = [(None, 1, 1, t, "", 1, "") for t in ("a\n", "b\n", "b\n", None, "x y " * 1200, "z y " * 1200)]
    got = split(spark.createDataFrame(data, SCHEMA)).groupBy("n_pieces").count().collect()
    assert {r["n_pieces"]: r["count"] for r in got} == {1: 3, 2: 4}


def test_rows_that_differ_under_an_id(spark):
    data = [("a", 9, 1, "short", "", 1, ""), ("a", 1, 1, "x y " * 1200, "", 1, "")]
    for keep in (True, False):
        got = split(spark.createDataFrame(data, SCHEMA), keep_small=keep).collect()
        assert [r["n_pieces"] for r in got] == [2, 2] and got[0]["start_line"] == 1
