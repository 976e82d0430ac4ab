"""Feature-hash embeddings of texts: signed counts of identifier parts, unit length."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cairnlake.functions import fixed_values as V, text as T

MODEL = "hash-v1"


def hash_vectors(token_lists: pd.Series, dim: int) -> list[np.ndarray]:
    """Bucket and sign of a token from the eight bytes of its BLAKE2b digest."""
    cache: dict[str, tuple[int, float]] = {}
    out = []
    for toks in token_lists:
        v = np.zeros(dim)
        for t in toks if toks is not None else ():
            if t not in cache:
                h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
                cache[t] = h % dim, 1.0 if h >> 63 else -1.0
            i, sign = cache[t]
            v[i] += sign
        out.append((v / (math.sqrt(float(v @ v)) or 1.0)).astype(np.float32))
    return out


def embed(text: Column, dim: int = V.EMBEDDING_DIM) -> Column:
    """array<float>; all zero for a text without identifiers."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(hash_vectors(b, dim))
    return run(T.identifier_tokens(F.coalesce(text, F.lit(""))))


def embed_missing(chunks: DataFrame, cache: DataFrame, dim: int = V.EMBEDDING_DIM) -> DataFrame:
    """(content_hash, embedding_model, embedding) of contents that the cache lacks, each computed once."""
    have = cache.filter(F.col("embedding_model") == MODEL).select("content_hash").distinct()
    todo = chunks.groupBy("content_hash").agg(F.min("content").alias("content")).join(have, "content_hash", "left_anti")
    return todo.select("content_hash", F.lit(MODEL).alias("embedding_model"), embed(F.col("content"), dim).alias("embedding"))


def jvm_embed(text: Column, dim: int = 256) -> Column:
    """The same idea with a hash of the JVM, hence a model of its own ('xxhash-v1'): no Python, vector as map bucket -> weight."""
    toks = T.identifier_tokens(F.coalesce(text, F.lit("")))
    signed = F.transform(toks, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dim)).alias("b"), F.when(F.xxhash64(t) < 0, 1.0).otherwise(-1.0).alias("s")))
    buckets = F.array_distinct(F.transform(signed, lambda x: x["b"]))
    sums = F.transform(buckets, lambda b: F.struct(b.alias("b"), F.aggregate(F.filter(signed, lambda x: x["b"] == b), F.lit(0.0), lambda a, x: a + x["s"]).alias("w")))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return F.map_from_entries(F.transform(sums, lambda x: F.struct(x["b"], F.when(norm > 0, x["w"] / norm).otherwise(0.0))))
