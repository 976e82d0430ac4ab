"""Evaluation texts leaking into training text.

Prefix-filtered set join over shingles of five words. A passage that leaked has, in any window of the item
that is as long as the shortest passage asked for, at least a known number of the window's shingles left
(each changed word spoils five). So of each window only its rarest shingles, one more than may be
spoiled, need to be looked up: the windows' prefixes under the order of document frequency. Documents that
hold a prefix shingle are kept if the words on both sides suffice for a passage (length and positional
bounds), and each pair is verified word by word: an alignment over item-sized windows that allows changed,
missing and added words, up to one in ten.

Item text that more than half of the items, and more than one, share is masked before windows are formed: it neither
makes nor fills a passage. Layout, letter case, punctuation and markup are gone with everything that is no word.

Plan. A first pass over the documents counts in how many of them each item shingle is; only counts leave it. The
prefixes are formed under that order, and a second pass keeps the hits of prefix shingles alone. Both look shingles up
in a sorted array of hashes, sent to the executors when their number, counted first, is within `broadcast_rows`;
beyond it the shingles are shuffled and joined. Texts are fetched only for the documents that are left, and each is
tokenised once for all its items; of a long document only the surroundings of its hits are aligned.

Defined results
- null or empty texts hold no passage; null ids of documents or items are left out.
- repeated rows count once; of different texts under one item id, or one document id, each is looked at.
- items shorter than a passage cannot leak. Texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnlake.session import durable

SHINGLE, MIN_WORDS, MIN_LINES, CHANGED, SHARED = 5, 20, 5, 0.1, 0.5
BROADCAST_ROWS = 2_000_000
#: Words that may lie between two runs of equal words.
GAP = 2

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>|&(?:[a-z]{2,8}|#\d{1,5});")
PRIME = np.uint64(0x9E3779B97F4A7C15)

class _Codes(dict):
    """64-bit code of each word, kept per worker up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_codes = _Codes()


def words(text: str) -> list[str]:
    return WORD.findall((TAG.sub(" ", text) if "<" in text or "&" in text else text).lower())


def shingles(tokens: list[str]) -> np.ndarray:
    """64-bit hash of each run of SHINGLE words, by position."""
    if len(tokens) < SHINGLE:
        return np.zeros(0, np.int64)
    return _mixed(np.fromiter(map(_codes.__getitem__, tokens), np.uint64, len(tokens)))


def _mixed(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = (h ^ codes[k:k + n]) * PRIME
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _shingle_rows(n_ids: int):
    """(ids..., n_words, pos, h) of every text; the text is the last column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, size, pos, hs = [], [], [], []
            for i, t in enumerate(b.column(n_ids).to_pylist()):
                tokens = words(t or "")
                h = shingles(tokens)
                if len(h):
                    index.append(np.full(len(h), i))
                    size.append(np.full(len(h), len(tokens), np.int32))
                    pos.append(np.arange(len(h), dtype=np.int32))
                    hs.append(h)
            if not hs:
                continue
            index, size, pos, hs = map(np.concatenate, (index, size, pos, hs))
            for at in range(0, len(hs), 100_000):
                part = slice(at, at + 100_000)
                take = pa.array(index[part])
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(n_ids)), pa.array(size[part]), pa.array(pos[part]), pa.array(hs[part])],
                                                 names=[*b.schema.names[:n_ids], "n_words", "pos", "h"])
    return run


def _hashes(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, row, words of the row, position, index in `wanted`) of the shingles that are in the sorted array `wanted`, by batch. The texts of
    a batch are one sequence of words; runs over a border are left out."""
    for b in batches:
        texts = [words(t) for t in b.column(1).to_pylist()]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(size.sum())
        if total < SHINGLE:
            continue
        h = _mixed(np.fromiter(map(_codes.__getitem__, chain.from_iterable(texts)), np.uint64, total))
        row = np.repeat(np.arange(len(texts)), size)[:len(h)]
        pos = np.arange(len(h)) - (np.cumsum(size) - size)[row]
        k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        hit = np.flatnonzero((wanted[k] == h) & (pos + SHINGLE <= size[row]))
        if len(hit):
            yield b.column(0), row[hit], size[row[hit]].astype(np.int32), pos[hit].astype(np.int32), k[hit]


def _count(wanted):
    """(h, docs): in how many texts of the partition each wanted shingle is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs = wanted.value
        docs = np.zeros(len(hs), np.int64)
        for _, index, _, _, at in _hashes(batches, hs):
            np.add.at(docs, np.unique(index * np.int64(len(hs)) + at) % len(hs), 1)
        got = np.flatnonzero(docs)
        for k in range(0, len(got), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(hs[got[k:k + 100_000]]), pa.array(docs[got[k:k + 100_000]])], names=["h", "docs"])
    return run


def _find(wanted):
    """(doc_id, n_words, pos, h) of the wanted shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs = wanted.value
        for ids, index, size, pos, at in _hashes(batches, hs):
            for k in range(0, len(at), 100_000):
                c = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(index[c])), pa.array(size[c]), pa.array(pos[c]), pa.array(hs[at[c]])], names=["doc_id", "n_words", "pos", "h"])
    return run


def code_lines(text: str) -> list[list[str]]:
    return [w for w in (words(x) for x in text.splitlines()) if w]


def masked(tokens: list[str], shared: set[int]) -> list[bool]:
    out = [False] * len(tokens)
    for i, h in enumerate(shingles(tokens).tolist()):
        if h in shared:
            out[i:i + SHINGLE] = [True] * SHINGLE
    return out


def windows(text: str, kind: str, mask: list[bool], min_words: int, min_lines: int) -> list[tuple[int, int]]:
    """Spans of words as long as the shortest passage, without masked words."""
    if kind == "code":
        sizes = [len(x) for x in code_lines(text)]
        at = np.concatenate([[0], np.cumsum(sizes)])
        spans = [(int(at[i]), int(at[i + min_lines])) for i in range(len(sizes) - min_lines + 1)]
    else:
        spans = [(i, i + min_words) for i in range(len(mask) - min_words + 1)]
    blocked = np.concatenate([[0], np.cumsum(mask)])
    return [(a, b) for a, b in spans if blocked[b] == blocked[a]]


def _prefixes(min_words: int, min_lines: int):
    """Per item text: the shingles that windows need to be found by. Columns: case_id, kind, text, shared, freq (map h -> documents)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cases, kinds, sizes, pos, hs = [], [], [], [], []
            for case, kind, text, shared, freq in zip(*(b.column(c).to_pylist() for c in ("case_id", "kind", "text", "shared", "freq"))):
                tokens = words(text)
                h = shingles(tokens).tolist()
                known = dict(freq or [])
                need = set()
                for s, e in windows(text, kind, masked(tokens, set(shared or ())), min_words, min_lines):
                    spoiled = SHINGLE * int((e - s) * CHANGED)
                    order = sorted(range(s, e - SHINGLE + 1), key=lambda i: (known.get(h[i], 0), h[i]))
                    need.update(order[:spoiled + 1])
                for i in sorted(need):
                    if h[i] in known:  # a shingle no document holds finds nothing
                        cases.append(case)
                        kinds.append(kind)
                        sizes.append(len(tokens))
                        pos.append(i)
                        hs.append(h[i])
            yield pa.RecordBatch.from_arrays([pa.array(cases, pa.string()), pa.array(kinds, pa.string()), pa.array(sizes, pa.int32()), pa.array(pos, pa.int32()), pa.array(hs, pa.int64())],
                                             names=["case_id", "kind", "item_words", "item_pos", "h"])
    return run


def align(a: list[str], b: list[str], mask: list[bool]) -> list[list[tuple[int, int, int]]]:
    """Chains of runs (item position, document position, length) of equal unmasked words, with at most GAP words between two runs."""
    pairs = defaultdict(list)
    for i in range(len(a) - 1):
        if not (mask[i] or mask[i + 1]):
            pairs[a[i], a[i + 1]].append(i)
    runs, ends = [], {}
    for p in range(len(b) - 1):
        for i in pairs.get((b[p], b[p + 1]), ()):
            k = ends.pop((i, p), None)
            if k is None:
                k = len(runs)
                runs.append([i, p, 2])
            else:
                runs[k][2] += 1
            ends[i + 1, p + 1] = k
    runs.sort()
    at = {(i, p): k for k, (i, p, _) in enumerate(runs)}
    used, chains = set(), []
    for k, (i, p, n) in enumerate(runs):
        if k in used:
            continue
        chain = [(i, p, n)]
        while True:
            i, p, n = chain[-1]
            near = [(max(gi, gp), -runs[j][2], gi, gp, j) for gi in range(GAP + 1) for gp in range(GAP + 1) if gi + gp and (j := at.get((i + n + gi, p + n + gp))) is not None]
            if not near:
                break
            nxt = min(near)[4]
            used.add(nxt)
            chain.append(tuple(runs[nxt]))
        chains.append(chain)
    return chains


def longest_passage(a: list[str], b: list[str], mask: list[bool], min_words: int) -> tuple[int, int, int, int]:
    """(item words, changed words, item position, document position) of the longest passage; 0 words if none has min_words."""
    best = (0, 0, 0, 0)
    for chain in align(a, b, mask):
        ends = [i + n for i, _, n in chain]
        if ends[-1] - chain[0][0] < max(min_words, best[0] + 1):
            continue
        changes = [0]
        for x, y in zip(chain, chain[1:]):
            changes.append(changes[-1] + max(y[0] - x[0] - x[2], y[1] - x[1] - x[2]))
        for s, (i, p, _) in enumerate(chain):
            for e in range(len(chain) - 1, s - 1, -1):
                size = ends[e] - i
                if size < min_words or size <= best[0]:
                    break
                if changes[e] - changes[s] <= size * CHANGED:
                    best = (size, changes[e] - changes[s], i, p)
                    break
    return best


def code_passage(lines: list[list[str]], b: list[str], mask: list[bool], min_lines: int) -> tuple[int, int, int, int]:
    """(item words, changed words, item position, document position) of the longest run of lines, all at least half there and nine words in ten of them."""
    a = [w for x in lines for w in x]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(int)
    best = (0, 0, 0, 0)
    for chain in align(a, b, mask):
        if sum(n for _, _, n in chain) <= (1 - CHANGED) * best[0]:
            continue
        hit = np.zeros(len(a), bool)
        for i, _, n in chain:
            hit[i:i + n] = True
        got = [int(hit[at[k]:at[k + 1]].sum()) for k in range(len(lines))]
        there = [2 * g >= len(x) for g, x in zip(got, lines)]
        total = np.concatenate([[0], np.cumsum(got)])
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if not there[e - 1]:
                    break
                size = int(at[e] - at[s])
                if e - s >= min_lines and size > best[0] and total[e] - total[s] >= (1 - CHANGED) * size:
                    best = (size, size - int(total[e] - total[s]), int(at[s]), chain[0][1])
    return best


VERIFIED = "doc_id bigint, case_id string, kind string, passage_words int, changed_words int, item_pos int, doc_pos int"


def surroundings(buckets: list[int], item_words: int, doc_words: int) -> list[tuple[int, int]]:
    """Windows of a document in which every passage that holds a hit lies as a whole; bucket k holds the hits at k * item_words and on."""
    most = 2 * item_words + 2 * GAP  # a passage takes no more words of a document: each run of two may be followed by GAP others
    spans: list[list[int]] = []
    for k in sorted(buckets):
        a, b = max(0, k * item_words - most), min(doc_words, (k + 1) * item_words + most)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    out = []
    for a, b in spans:
        while b - a > 4 * most:
            out.append((a, a + 3 * most))
            a += 2 * most
        out.append((a, b))
    return out


_items: dict = {}


def _item(case: str, kind: str, item: str, shared) -> tuple:
    """(words, mask, lines) of an item text, worked out once per worker."""
    got = _items.get((case, kind))
    if got is None or got[0] != item:
        if len(_items) > 10_000:
            _items.clear()
        a = words(item)
        got = _items[case, kind] = (item, a, masked(a, set(shared or ())), code_lines(item) if kind == "code" else None)
    return got[1:]


def _verify(min_words: int, min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens = None, []
        for b in batches:
            rows = []
            for doc, case, kind, text, item, shared, buckets in zip(*(b.column(c).to_pylist() for c in ("doc_id", "case_id", "kind", "text", "item", "shared", "buckets"))):
                if text != last:
                    last, tokens = text, words(text)
                a, mask, lines = _item(case, kind, item, shared)
                best, seen = (0, 0, 0, 0), set()
                for lo, hi in surroundings(buckets, len(a), len(tokens)):
                    part = tokens[lo:hi]
                    if (same := tuple(part)) in seen:  # repeated text gives nothing new
                        continue
                    seen.add(same)
                    got = code_passage(lines, part, mask, min_lines) if lines is not None else longest_passage(a, part, mask, min_words)
                    if got[0] > best[0]:
                        best = (*got[:3], got[3] + lo)
                    if best[0] == len(a):
                        break
                if best[0]:
                    rows.append((doc, case, kind, *best))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in VERIFIED.split(", ")])
    return run


def _sorted_hashes(spark, hashes: DataFrame):
    """The distinct column h as a sorted array on every executor; the caller has counted it."""
    return spark.sparkContext.broadcast(np.sort(np.asarray(hashes.select("h").distinct().toArrow().column("h").to_numpy(), np.int64)))


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "case_id", prose: str = "body", code: str | None = "new_code",
          min_words: int = MIN_WORDS, min_lines: int = MIN_LINES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document and item (VERIFIED): the longest passage of the item's prose or code in the document."""
    spark = docs.sparkSession
    parts = [items.select(F.col(item_id).cast("string").alias("case_id"), F.lit("prose").alias("kind"), F.col(prose).alias("text"))]
    if code:
        parts.append(items.select(F.col(item_id).cast("string").alias("case_id"), F.lit("code").alias("kind"), F.col(code).alias("text")))
    held = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    held = durable(held.filter("case_id is not null and text is not null").distinct(), "items")
    n_items = held.select("case_id").distinct().count()
    pieces = durable(held.mapInArrow(_shingle_rows(2), "case_id string, kind string, n_words int, pos int, h bigint"), "item-shingles")
    # text that most items share; an item's own are gathered beside it, at most as many as it has words
    common = pieces.groupBy("kind", "h").agg(F.countDistinct("case_id").alias("n")).filter(F.col("n") > max(1.0, SHARED * n_items)).select("kind", "h")
    shared = pieces.select("case_id", "kind", "h").join(common, ["kind", "h"]).groupBy("case_id", "kind").agg(F.collect_set("h").alias("shared"))
    held = durable(held.join(shared, ["case_id", "kind"], "left"), "masked-items")
    wanted = pieces.join(common, ["kind", "h"], "left_anti").select("h").distinct()

    clean = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    few = 0 < wanted.count() <= broadcast_rows
    every = clean.mapInArrow(_shingle_rows(1), "doc_id bigint, n_words int, pos int, h bigint")
    if few:
        freq = clean.mapInArrow(_count(_sorted_hashes(spark, wanted)), "h bigint, docs bigint").groupBy("h").agg(F.sum("docs").alias("docs"))
    else:
        freq = every.select("h").join(wanted, "h", "left_semi").groupBy("h").agg(F.count("*").alias("docs"))
    own = pieces.select("case_id", "kind", "h").distinct().join(freq, "h").groupBy("case_id", "kind").agg(F.collect_list(F.struct("h", "docs")).alias("freq"))
    found = held.join(own, ["case_id", "kind"]).select("case_id", "kind", "text", "shared", F.map_from_entries("freq").alias("freq"))
    prefix = durable(found.mapInArrow(_prefixes(min_words, min_lines), "case_id string, kind string, item_words int, item_pos int, h bigint"), "prefixes")

    if few and prefix.limit(1).count():
        hits = clean.mapInArrow(_find(_sorted_hashes(spark, prefix)), "doc_id bigint, n_words int, pos int, h bigint").join(F.broadcast(prefix), "h")
    else:
        hits = every.join(prefix, "h")
    # length and positional bounds: what can lie before and after the hit must make up a passage
    least = int(min_words * (1 - CHANGED))
    room = F.least("pos", "item_pos") + F.least(F.col("n_words") - F.col("pos"), F.col("item_words") - F.col("item_pos")) + GAP
    near = hits.filter(F.when(F.col("kind") == "code", room >= min_lines).otherwise(room >= least))
    pairs = durable(near.groupBy("doc_id", "case_id", "kind").agg(F.collect_set((F.col("pos") / F.col("item_words")).cast("int")).alias("buckets")), "pairs")
    # only the documents of pairs give their texts; few pairs go to where the texts are, many meet them by id
    small = pairs.count() <= broadcast_rows // 20
    with_text = clean.join(F.broadcast(pairs) if small else pairs, "doc_id")
    checked = (with_text.join(held.withColumnRenamed("text", "item"), ["case_id", "kind"])
               .select("doc_id", "case_id", "kind", "text", "item", "shared", "buckets").mapInArrow(_verify(min_words, min_lines), VERIFIED))
    names = ("passage_words", "kind", "changed_words", "item_pos", "doc_pos")
    return checked.groupBy("doc_id", "case_id").agg(F.max(F.struct(*names)).alias("m")).select("doc_id", "case_id", *[F.col(f"m.{n}").alias(n) for n in names])
