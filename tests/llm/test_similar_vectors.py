import numpy as np

from cairnlake.llm.similar_vectors import encode, estimate, neighbours, rotation

SCHEMA = "embedding_model string, content_hash string, embedding array<float>, model string, key string, vec string, rid int"


def frame(spark, rows):
    return spark.createDataFrame([(m, k, None if v is None else [None if x is None else float(x) for x in v], "m", "k", "v", 1) for m, k, v in rows], SCHEMA)


def brute(vectors, k, least):
    keys = sorted(vectors)
    x = np.array([vectors[q] for q in keys], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for i, a in enumerate(keys):
        best = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-round(s[i, j], 9), keys[j]))[:k]
        out |= {(a, keys[j]) for j in best if s[i, j] >= least}
    return out


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 96)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, rot = x[:20].mean(axis=0), rotation(96)
    est, bound = estimate(x[:50], c, rot, *encode(x, np.broadcast_to(c, x.shape), rot))
    off = np.abs(est - x[:50] @ x.T)
    assert (off <= bound).mean() > 0.97 and off.mean() < 0.08


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 64))
    vectors = {f"h{i:04d}": base[i % 150] + 0.35 * rng.standard_normal(64) for i in range(900)}
    got = {(r["key"], r["other"]) for r in neighbours(frame(spark, [("m", k, v) for k, v in vectors.items()]), k=5, least=0.8, cell_rows=40).collect()}
    want = brute(vectors, 5, 0.8)
    assert len(want) > 1500 and len(got & want) / len(want) > 0.97 and got <= want


def test_blocks_of_hot_cells(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    vectors = {f"h{i:03d}": centre + 0.05 * rng.standard_normal(64) for i in range(300)}
    got = {(r["key"], r["other"]) for r in neighbours(frame(spark, [("m", k, v) for k, v in vectors.items()]), k=3, least=0.5, cell_rows=1000, block_rows=64).collect()}
    want = brute(vectors, 3, 0.5)
    assert len(got & want) / len(want) > 0.9 and len(got) == 900


def test_defined_cases(spark):
    a, b, c = [1.0, 0.1, 0, 0], [1.0, 0.2, 0, 0], [0, 0, 1.0, 0]
    rows = [("m", "a", a), ("m", "a", a), ("m", "b", b), ("m", "c", c), ("m", "z", [0, 0, 0, 0]), ("m", "w", [1.0, 0.1]), ("m", "n", None), ("m", None, a), ("m", "x", [None, 1, 1, 1]), ("m", "y", [float("nan"), 1, 1, 1]),
            ("m", "i", [float("inf"), 1, 1, 1]), ("other", "a2", a), (None, "p", a), (None, "q", b), ("m", "s", [2 * v for v in b])]
    got = {(r["model"], r["key"], r["other"]) for r in neighbours(frame(spark, rows), k=2, least=0.8).collect()}
    assert got == {("m", x, y) for x in "abs" for y in "abs" if x != y} | {(None, "p", "q"), (None, "q", "p")}


def test_equal_vectors_are_linear(spark):
    rows = [("m", f"k{i:02d}", [1.0, 2, 3, 4]) for i in range(30)] + [("m", "near", [1.0, 2, 3, 4.1])]
    got = [(r["key"], r["other"]) for r in neighbours(frame(spark, rows), k=3, least=0.8).collect()]
    assert len(got) == 31 * 3 and set(o for k, o in got if k == "k20") == {"k00", "k01", "k02"} and set(o for k, o in got if k == "k01") == {"k00", "k02", "k03"}
    assert set(o for k, o in got if k == "near") == {"k00", "k01", "k02"}


def test_empty_and_single(spark):
    assert neighbours(frame(spark, []), k=2).count() == 0
    assert neighbours(frame(spark, [("m", "a", [1.0, 2])]), k=2).count() == 0
    assert neighbours(frame(spark, [("m", "a", [1.0, 2]), ("m", "b", [1.0, 2, 3])]), k=2, dims={"m": 2}).count() == 0
