import random

from cairnlake.llm.leakage import code_lines, code_passage, leaks, longest_passage, masked, words

DOCS = "doc_id bigint, text string, case_id string, h int, kind string"
ITEMS = "case_id string, title string, body string, new_code string, text string, doc_id int"


def body(rng, n=60):
    return " ".join(rng.choice("alpha beta gamma delta omega sigma kappa theta lambda zeta rho tau phi chi psi eta iota".split()) + str(rng.randrange(40)) for _ in range(n))


def code(rng, n=8):
    return "\n".join(f"    {rng.choice('abcdefg')}_{rng.randrange(99)} = call_{rng.randrange(99)}(x{rng.randrange(99)}, {rng.randrange(99)})" for _ in range(n))


SHARED = "Read the change below with care and report only what you can prove from its lines today."


def setup(spark, docs, n=6):
    rng = random.Random(7)
    items = [(f"c{i}", f"title {i}", SHARED + " " + body(rng), code(rng), "x", 1) for i in range(n)]
    return items, leaks(spark.createDataFrame([(i, t, "c", 1, "k") for i, t in docs(items)], DOCS), spark.createDataFrame(items, ITEMS))


def test_cases(spark):
    def docs(items):
        w = items[0][2].split()[17:]
        lines = items[1][3].split("\n")
        changed = list(w[:40])
        changed[9] = changed[25] = "other"
        split = w[:22] + "and this was put between the two".split() + w[22:50]
        return [(1, "Before. " + " ".join(w[:25]) + " after."), (2, " ".join(w[:19])), (3, "**" + "** <b>".join(w[5:30]).upper() + "</b>"), (4, " ".join(changed)), (5, "\n".join("+ " + x for x in lines[2:7])), (6, "\n".join(lines[2:6])),
                (7, SHARED + " nothing else"), (8, " ".join(split)), (9, items[2][1]), (10, None), (11, ""), (None, items[0][2]), (12, "\n".join("> " + " ".join(w[i:i + 4]) for i in range(0, 40, 4))), (13, "filler " * 100_000 + " ".join(w[:30])),
                (14, items[0][2] + "\n" + items[3][3]), (15, " ".join(x for k, x in enumerate(w[:40]) if k not in (11, 29)))]
    items, got = setup(spark, docs)
    assert sorted((r["doc_id"], r["case_id"]) for r in got.collect()) == [(1, "c0"), (3, "c0"), (4, "c0"), (5, "c1"), (8, "c0"), (12, "c0"), (13, "c0"), (14, "c0"), (14, "c3"), (15, "c0")]


def test_against_brute_force(spark):
    rng = random.Random(3)

    def docs(items):
        out = []
        for i in range(60):
            it = rng.choice(items)
            w = it[2].split()
            a = rng.randrange(len(w) - 8)
            piece = w[a:a + rng.randrange(8, 45)]
            for k in range(len(piece)):
                if rng.random() < 0.06:
                    piece[k] = "swap"
            out.append((i, body(rng, 20) + " " + " ".join(piece) + " " + body(rng, 20)))
        return out
    seen = {}

    def keep(items):
        seen["d"] = docs(items)
        return seen["d"]
    items, got = setup(spark, keep)
    from cairnlake.llm.leakage import shingles
    from collections import Counter

    n = Counter(h for it in items for h in set(shingles(words(it[2])).tolist()))
    shared = {h for h, c in n.items() if c > len(items) / 2}
    want = set()
    for i, t in seen["d"]:
        for it in items:
            a = words(it[2])
            if longest_passage(a, words(t), masked(a, shared), 20)[0] or code_passage(code_lines(it[3]), words(t), [False] * len(words(it[3])), 5)[0]:
                want.add((i, it[0]))
    assert want and {(r["doc_id"], r["case_id"]) for r in got.collect()} == want


def test_shuffled_join_gives_the_same(spark):
    rng = random.Random(9)
    items = [(f"c{i}", "t", body(rng), code(rng), "x", 1) for i in range(3)]
    docs = spark.createDataFrame([(i, items[i][2], "c", 1, "k") for i in range(3)] * 2, DOCS)
    it = spark.createDataFrame(items + items[:1] + [(None, "t", body(rng), None, "x", 1), ("n", None, None, None, None, None), ("short", "t", "too short", "", "x", 1)], ITEMS)
    for limit in (0, 10**6):
        assert sorted((r["doc_id"], r["case_id"]) for r in leaks(docs, it, broadcast_rows=limit).collect()) == [(0, "c0"), (1, "c1"), (2, "c2")]


def test_empty(spark):
    assert leaks(spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_repeated_words_take_linear_time(spark):
    from cairnlake.llm.leakage import _verify
    import pyarrow as pa
    import time

    def run(n):
        cols = {"doc_id": [1], "case_id": ["c"], "kind": ["prose"], "text": ["a b " * (n // 2)], "item": ["a a b " * 60 + "z"], "shared": [None], "buckets": [list(range(n // 181 + 1))]}
        began = time.process_time()
        list(_verify(20, 5)([pa.RecordBatch.from_pydict(cols)]))
        return time.process_time() - began
    run(2_000)
    assert run(200_000) < 5


def test_surroundings_hold_every_passage():
    from cairnlake.llm.leakage import GAP, surroundings

    rng = random.Random(3)
    for _ in range(300):
        m, n = rng.randrange(20, 60), rng.randrange(20, 3000)
        hits = [rng.randrange(n) for _ in range(rng.randrange(1, 9))]
        spans = surroundings([h // m for h in hits], m, n)
        for h in hits:
            size = rng.randrange(1, 2 * m + 2 * GAP + 1)
            a = rng.randrange(max(0, h - size + 1), h + 1)
            assert any(lo <= a and min(n, a + size) <= hi for lo, hi in spans)


def test_shared_text_is_one_rule_at_every_number_of_items(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    for n, want in ((1, 1), (2, 0), (5, 0)):
        items = spark.createDataFrame([(f"c{k}", text, "") for k in range(n)], "case_id string, body string, new_code string")
        assert leaks(docs, items).count() == want
