import random

import numpy as np

from cairnlake.llm.packing import best_fit, containers, count_tokens, encoder, pack, token_sizes, VOCABULARY


def test_best_fit_takes_the_fullest_bin():
    bins, rooms = best_fit(np.array([6, 5, 4, 3, 0]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 0] and rooms == [0, 2]


def test_best_fit_against_search():
    rng = random.Random(1)
    sizes = [rng.randrange(0, 101) for _ in range(600)]
    bins, rooms = best_fit(np.array(sizes), 100)
    mine: list[int] = []
    for s, b in zip(sizes, bins.tolist()):
        fits = [r for r in mine if r >= s]
        if fits:
            assert mine[b] == min(fits)
        else:
            assert b == len(mine)
            mine.append(100)
        mine[b] -= s
    assert mine == rooms


def test_every_document_once(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 1, rng.randrange(50), rng.randrange(400), 1000, 2500]) for i in range(1500)}
    d = spark.createDataFrame(list(sizes.items()), "doc_id bigint, tokens bigint")
    p = pack(d, capacity=1000, items_per_partition=100).toPandas()
    assert p.groupby("doc_id").tokens.sum().to_dict() == sizes
    assert p.groupby("doc_id").size().max() == 3 and not p.duplicated(["doc_id", "piece_no"]).any()
    load = p.groupby("container_id").tokens.sum()
    assert load.max() <= 1000 and len(load) <= 1.02 * sum(sizes.values()) / 1000 + 1
    whole = p[p.doc_id.map(sizes) <= 1000]
    assert len(whole) == whole.doc_id.nunique()
    got = containers(pack(d, capacity=1000), 1000)
    assert got.filter("tokens + unused <> 1000 or unused < 0").count() == 0


def test_sizes(spark):
    text = "Words and more words. " * 50
    d = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, None, None), (3, "", 0), (None, "x", 1), (4, "a" * 300_000, 1), (5, "short", 1), (5, "a longer text", 1)], "doc_id bigint, text string, tokens int")
    got = {r["doc_id"]: r["tokens"] for r in token_sizes(d).collect()}
    enc = encoder(VOCABULARY)
    assert got[1] == len(enc.encode_ordinary(text)) and got[2] == got[3] == 0 and got[4] > 1000 and got[5] == len(enc.encode_ordinary("a longer text")) and len(got) == 5
    assert count_tokens("<|endoftext|>") > 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, tokens bigint")).count() == 0
    one = pack(spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, tokens bigint")).toPandas()
    assert one.container_id.nunique() == 1


def test_items_that_fit_with_no_other(spark):
    d = spark.range(1000).selectExpr("id as doc_id", "bigint(600) as tokens")
    p = pack(d, capacity=1000, items_per_partition=100).toPandas()
    assert p.container_id.nunique() == 1000 and len(p) == 1000
    mixed = spark.range(1000).selectExpr("id as doc_id", "bigint(if(id % 2 = 0, 600, 400)) as tokens")
    assert pack(mixed, capacity=1000, items_per_partition=100).select("container_id").distinct().count() <= 540
