"""Operator 7: benchmark decontamination with a BM25 inverted index and block-max WAND.

Test items are indexed: for each word the items that hold it, with BM25 weights divided by the item's score against
itself, so that one threshold means the same share of every item. Every training text is read as overlapping passages
of twice the longest item's words, a step of one longest item apart, so that a leaked item lies within one passage.
Each passage queries the index; block-max WAND gives all items above the threshold, and those are verified on word
shingles of question and answer.

An item's question is its text up to the last question mark, or up to its last sentence where it has none; the rest is
the answer. A passage leaks an item if it holds 0.8 of the item's 5-word shingles, or 0.8 of its question's and of its
answer's. Parts with fewer words than a shingle count as one shingle of all their words.

The index is broadcast. Its size is checked: items beyond `shard_bytes` are divided into shards by a hash, each with an
index of its own, and the texts are read once for every `shards_per_read` shards. What scores rest on (the number of
items, the items that hold a word, mean and largest length) is counted once over all items and handed to each shard, so
results do not depend on the shards. Texts are not shuffled.

Defined results: null and empty texts leak nothing; items without id or words are left out; rows that repeat an item
count once; each row of a repeated document gives its own results. Documents with a null id are checked and keep it.
Other columns are ignored by leaks() and kept by clean(). Empty tables give no leaks.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Workspace, trimmed

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?…]+[\"')\]]*\s+")
K1, B = 1.2, 0.75


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[str, str]:
    at = text.rfind("?") + 1
    if not at or not words_of(text[at:]):
        ends = [m.end() for m in SENTENCE_END.finditer(text) if words_of(text[m.end() :])]
        at = ends[-1] if ends else len(text)
    return text[:at], text[at:]


def shingles(words: list[str], width: int) -> set[tuple[str, ...]]:
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def held(needed: set[tuple[str, ...]], words: list[str], found: dict[int, set]) -> float:
    """Share of the needed shingles, which all have one length, that stand in the words."""
    if not needed:
        return 1.0
    n = len(next(iter(needed)))
    if n not in found:
        found[n] = set(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else set()
    return len(needed & found[n]) / len(needed)


class Index:
    """Postings by word in ascending item order, with the largest weight of the list and of each of its blocks.

    Blocks are aligned: block k of every list has the items from k * block on, so that block bounds of several words
    add up without walking the lists.
    """

    def __init__(self, items: list[tuple[int, str]], width: int, facts: tuple[int, float, int], df: dict[str, int], block: int = 4):
        """facts: number, mean length and largest length of all items; df: how many of them hold each word of these."""
        split = [(i, t, words_of(t)) for i, t in sorted(items)]
        self.ids = [i for i, _, _ in split]
        n_items, mean, self.longest = facts
        self.parts = []
        for _, t, w in split:
            q, a = question_and_answer(t)
            self.parts.append((shingles(w, width), shingles(words_of(q), width), shingles(words_of(a), width)))
        tfs = [Counter(w) for _, _, w in split]
        lists: dict[str, tuple[list[int], list[float]]] = {}
        for k, tf in enumerate(tfs):
            norm = K1 * (1 - B + B * len(split[k][2]) / mean)
            raw = {x: math.log(1 + (n_items - df[x] + 0.5) / (df[x] + 0.5)) * n * (K1 + 1) / (n + norm) for x, n in tf.items()}
            total = sum(raw.values())
            for x, w in raw.items():
                at = lists.setdefault(x, ([], []))
                at[0].append(k)
                at[1].append(w / total)
        self.block = block
        self.lists = lists
        self.blocks: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for x, (ks, ws) in lists.items():
            most: dict[int, float] = {}
            for k, w in zip(ks, ws, strict=True):
                most[k // block] = max(most.get(k // block, 0.0), w)
            self.blocks[x] = np.array(list(most), np.int32), np.array(list(most.values()))
        self.most = {x: max(ws) for x, (_, ws) in lists.items()}

    def search(self, words: set[str], least: float) -> list[tuple[int, float]]:
        """All items whose score against the words is at least the threshold, by block-max WAND."""
        least -= 1e-9
        terms = words & self.most.keys()
        if sum(map(self.most.__getitem__, terms)) < least:
            return []
        lists = [self.blocks[x] for x in terms]
        bounds = np.bincount(np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists]))
        out = []
        for k in np.flatnonzero(bounds >= least).tolist():
            out += self.within(terms, k * self.block, (k + 1) * self.block, least)
        return out

    def within(self, terms: set[str], start: int, stop: int, least: float) -> list[tuple[int, float]]:
        """WAND over the part of the lists from item start to before stop."""
        out, cur = [], []
        for x in terms:
            items, weights = self.lists[x]
            at = bisect_left(items, start)
            if at < len(items) and items[at] < stop:
                cur.append([items[at], at, items, weights, self.most[x]])
        while cur:
            cur.sort(key=lambda c: c[0])
            total, p = 0.0, -1
            for k, c in enumerate(cur):
                total += c[4]
                if total >= least:
                    p = k
                    break
            if p < 0:
                break
            pivot = cur[p][0]
            if cur[0][0] == pivot:
                while p + 1 < len(cur) and cur[p + 1][0] == pivot:
                    p += 1
                score = math.fsum(c[3][c[1]] for c in cur[: p + 1])  # the same in any order
                if score >= least:
                    out.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            for c in cur[: p + 1]:
                if c[0] < to:
                    c[1] = bisect_left(c[2], to, c[1])
                    c[0] = c[2][c[1]] if c[1] < len(c[2]) else stop
            cur = [c for c in cur if c[0] < stop]
        return out

    def leaks(self, text: str | None, least: float, share: float) -> dict[int, tuple[float, float, float, float]]:
        """Leaked items of a text: best score, and overlap of the item, its question and its answer."""
        words = words_of(text)
        out: dict[int, tuple[float, float, float, float]] = {}
        step = max(1, self.longest)
        for a in range(0, max(1, len(words) - step), step):
            passage = words[a : a + 2 * step]
            found: dict[int, set] = {}
            for k, score in self.search(set(passage), least):
                whole, q, r = (held(x, passage, found) for x in self.parts[k])
                if whole >= share or q >= share and r >= share and self.parts[k][2]:
                    item = self.ids[k]
                    if item not in out or (whole, score) > (out[item][1], out[item][0]):
                        out[item] = (score, whole, q, r)
        return out


def word_lists(batches: Iterator) -> Iterator:
    """The words of each item."""
    import pyarrow as pa

    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([words_of(t) for t in part.column(1).to_pylist()], pa.list_(pa.string()))], names=["item_id", "text", "words"])


def indexes(spark: SparkSession, items: DataFrame, width: int, shard_bytes: int, item_id: str, text: str) -> Iterator:
    """A broadcast index for each shard of the items; one shard unless the items are larger than the bound."""
    some = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    some = some.groupBy("item_id").agg(F.min("text").alias("text")).mapInArrow(word_lists, "item_id long, text string, words array<string>").where(F.size("words") > 0)
    some = Workspace(spark, "benchmark").write(some, "items")
    r = some.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean"), F.max(F.size("words")).alias("longest"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not r["n"]:
        return
    facts, n = (r["n"], float(r["mean"]), int(r["longest"])), max(1, -(-r["bytes"] // shard_bytes))
    held = some.select(F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("shard"), F.explode(F.array_distinct("words")).alias("word"))
    # each word of a shard with the number of all items that hold it, however many shards they are in
    df = held.groupBy("shard", "word").count()
    df = df.join(df.groupBy("word").agg(F.sum("count").alias("df")), "word").select("shard", "word", "df")
    df = Workspace(spark, "benchmark-words").write(df, "df") if n > 1 else df
    for k in range(n):
        rows = some.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).select("item_id", "text").collect()
        words = {x["word"]: x["df"] for x in df.where(F.col("shard") == k).select("word", "df").collect()}
        yield spark.sparkContext.broadcast(Index([(x["item_id"], x["text"]) for x in rows], width, facts, words))


def by_read(found: Iterator, shards_per_read: int) -> Iterator[list]:
    """The indexes that one read of the texts searches."""
    while some := list(islice(found, shards_per_read)):
        yield some


def finder(indexes: list, least: float, share: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = [i.value for i in indexes]
        names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = []
                for doc, text in zip(batch.column(0).slice(a, 500).to_pylist(), batch.column(1).slice(a, 500).to_pylist(), strict=True):
                    for ix in found:
                        rows += [(doc, item, *x) for item, x in sorted(ix.leaks(text, least, share).items())]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(cols)], names=names)

    return run


def cleaner(indexes: list, text: str, least: float, share: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = [i.value for i in indexes]
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield part.filter(pa.array([not any(ix.leaks(t, least, share) for ix in found) for t in part.column(text).to_pylist()], pa.bool_()))

    return run


LEAKS = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def leaks(
    spark: SparkSession, docs: DataFrame, items: DataFrame, least_score: float = 0.4, share: float = 0.8, width: int = 5,
    shard_bytes: int = 4 << 20, shards_per_read: int = 4, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap and answer_overlap of each leaked item in each document."""
    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for found in by_read(indexes(spark, items, width, shard_bytes, item_id, item_text), shards_per_read):
        part = some.mapInArrow(trimmed(finder(found, least_score, share)), LEAKS)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], LEAKS) if out is None else out


def clean(
    spark: SparkSession, docs: DataFrame, items: DataFrame, least_score: float = 0.4, share: float = 0.8, width: int = 5,
    shard_bytes: int = 4 << 20, shards_per_read: int = 4, text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of docs, with all their columns, that leak no item."""
    for found in by_read(indexes(spark, items, width, shard_bytes, item_id, item_text), shards_per_read):
        docs = docs.mapInArrow(trimmed(cleaner(found, text, least_score, share)), docs.schema)
    return docs
