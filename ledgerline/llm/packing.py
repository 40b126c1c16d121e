"""Operator 3: hierarchical multi-length packing.

Documents are tokenised and routed by length to context-size tiers (powers of two up to the window). Whole windows are
cut from long documents first; what is left of each document goes to the smallest tier that holds it. Every tier is
packed from the longest down: a sequence starts with one piece of its own tier and its gap is filled from shorter
tiers, best fit first, closing the last gap by cutting a shorter piece. Sequences of a power of two need no padding,
and what remains at the end of a task is laid out in such sequences too, so padding is zero. Full sequences are dealt
to step groups of about equal attention cost, longest first to the least loaded group, and no group gets more than 1.25
times the tokens that it should have.

All of it runs within the tasks that read the documents: there is no shuffle, and a task holds one block of documents
(`block_tokens`, or one document if that is longer) at a time.

Defined results: null text is empty; an empty text is one piece holding the end id only. A null doc_id stays null.
Repeated rows are packed as often as they occur. Other columns are ignored. An empty table gives no rows. Special-token
strings within a text are encoded as the tokenizer's default does.
"""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import trimmed

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("tier", T.IntegerType()), T.StructField("step_group", T.LongType()),
])


#: Parts of these characters only are cut into the tokenizer's pre-tokens here, after lower-casing.
PLAIN = re.compile(r"[\x21-\x7eß-öø-ÿÀ-ÖØ-Þ]*\Z")
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\s]+")


class WordTokenizer:
    """Caches before a tokenizer that drops white space: no id depends on text beyond the nearest space.

    Texts are split at plain spaces and line feeds only, both white space to the tokenizer, and each part's ids are kept
    as little-endian 32-bit bytes. Unknown parts of plain characters are cut into pre-tokens, whose ids are kept as well;
    unknown pre-tokens are tokenised many at a time and told apart by the ids that end a word. The caches keep the first
    `cache_size` entries; later ones are kept for their batch only. Texts that may hold a special token's string, and
    parts of other characters, are encoded as they are.
    """

    def __init__(self, path: str, cache_size: int = 600_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {"": b""}
        self.pre: dict[str, bytes] = {}
        self.cache_size = cache_size
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pre_tokens(self, parts: list[str]) -> list[bytes]:
        ids = np.array(self.tok.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cuts) != len(parts):
            return [self.whole(p) for p in parts]
        blob = ids.tobytes()
        return [blob[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [None if t is not None and "<|" in t else (t or "").replace("\n", " ").split(" ") for t in texts]
        cache, pre = self.cache, self.pre
        missing = list(set(chain.from_iterable(words for words in split if words)).difference(cache))
        cut = {}
        for w in missing:
            # most words are letters, with no more than a mark behind
            if w.isascii():
                if w.isalpha():
                    cut[w] = (w.lower(),)
                    continue
                if w[-1] in ".,;:!?" and w[:-1].isalpha():
                    cut[w] = (w[:-1].lower(), w[-1])
                    continue
            if PLAIN.match(w):
                cut[w] = PRE_TOKEN.findall(w.lower())
        unknown = list(set(chain.from_iterable(cut.values())).difference(pre))
        for k in range(0, len(unknown), 500):
            some = unknown[k : k + 500]
            pre.update(zip(some, self.pre_tokens(some), strict=True))
        for w in missing:
            c = cut.get(w)
            cache[w] = self.whole(w) if c is None else pre[c[0]] if len(c) == 1 else b"".join([pre[p] for p in c])
        get = cache.__getitem__
        out = [self.whole(t) if words is None else b"".join(map(get, words)) for t, words in zip(texts, split, strict=True)]
        for table, new in ((cache, missing), (pre, unknown)):
            full = len(table) > self.cache_size
            for w in new:
                if full or len(w) > 64:
                    del table[w]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each path and process, so that a worker's later tasks find the cache filled."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Block:
    """Packs a block of documents; gives rows without ids of sequences that are unique over tasks."""

    def __init__(self, window: int, smallest: int):
        self.window = window
        self.tiers = [window >> k for k in range(window.bit_length()) if window >> k >= smallest]  # longest first
        #: Pieces (length, document, start) by tier, each list sorted by length.
        self.free: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}
        self.full: list[tuple[int, list[tuple[int, int, int]]]] = []

    def tier(self, n: int) -> int:
        return next(t for t in reversed(self.tiers) if n <= t)

    def add(self, doc: int, n: int) -> None:
        start = 0
        while n - start >= self.window:
            self.full.append((self.window, [(self.window, doc, start)]))
            start += self.window
        if n > start:
            self.put((n - start, doc, start))

    def put(self, piece: tuple[int, int, int]) -> None:
        t = self.tier(piece[0])
        if piece[0] == t:
            self.full.append((t, [piece]))
        else:
            self.free[t].append(piece)

    def fill(self, gap: int, below: list[int], seq: list[tuple[int, int, int]]) -> int:
        """Fills a gap from the given tiers, each piece the longest that fits; the last one is cut. Gives what is left."""
        while gap:
            best = None
            for t in below:
                if pieces := self.free[t]:
                    k = bisect.bisect_right(pieces, (gap, float("inf"), 0)) - 1
                    if k >= 0:
                        best = (t, k)
                        break
            if best:
                piece = self.free[best[0]].pop(best[1])
                seq.append(piece)
                gap -= piece[0]
                continue
            t = next((t for t in reversed(below) if self.free[t]), None)
            if t is None:
                return gap
            n, doc, start = self.free[t].pop(0)
            seq.append((gap, doc, start))
            self.put_sorted((n - gap, doc, start + gap))
            gap = 0
        return 0

    def put_sorted(self, piece: tuple[int, int, int]) -> None:
        t = self.tier(piece[0])
        if piece[0] == t:
            self.full.append((t, [piece]))
        else:
            bisect.insort(self.free[t], piece)

    def pack(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        for pieces in self.free.values():
            pieces.sort()
        for k, t in enumerate(self.tiers):
            while self.free[t]:
                seq = [self.free[t].pop()]
                # own tier last: its pieces are longer than any gap, so one of them is cut only if nothing shorter is left
                gap = self.fill(t - seq[0][0], [*self.tiers[k + 1 :], t], seq)
                if gap:
                    self.tail(seq)
                else:
                    self.full.append((t, seq))
        return self.full

    def tail(self, pieces: list[tuple[int, int, int]]) -> None:
        """The last pieces of a block: sequences of decreasing powers of two."""
        while pieces:
            size = 1 << (min(self.window, sum(p[0] for p in pieces)).bit_length() - 1)
            seq, need = [], size
            while need:
                n, doc, start = pieces.pop(0)
                if n > need:
                    pieces.insert(0, (n - need, doc, start + need))
                    n = need
                seq.append((n, doc, start))
                need -= n
            self.full.append((size, seq))


def step_groups(sizes: list[int], group_tokens: int, over: float = 1.25) -> list[int]:
    """A group for each sequence: the longest first, each to the group with the least attention cost so far.

    A group that a sequence would take beyond `over` times the wanted tokens waits for shorter ones. There is always one
    with room, as the groups together have more than all sequences need.
    """
    n = max(1, -(-sum(sizes) // group_tokens))
    most = max(over * group_tokens, max(sizes, default=0))
    heap, out, full, last = [(0, 0, g) for g in range(n)], [0] * len(sizes), [], None
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if sizes[i] != last:
            for g in full:
                heapq.heappush(heap, g)
            full, last = [], sizes[i]
        while len(heap) > 1 and heap[0][1] + sizes[i] > most:
            full.append(heapq.heappop(heap))
        cost, tokens, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (cost + sizes[i] * sizes[i], tokens + sizes[i], g))
    return out


def packer(tokenizer_path: str, window: int, smallest: int, end_id: int, block_tokens: int, group_tokens: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        from ledgerline.llm.common import by_bytes

        tok = word_tokenizer(tokenizer_path)
        part = TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        schema = pa.schema([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64()) for f in SCHEMA.fields])
        held: list[tuple[int | None, bytes]] = []
        seq_no = group_no = tokens = 0

        def flush():
            nonlocal seq_no, group_no, held, tokens
            block = Block(window, smallest)
            for i, (_, ids) in enumerate(held):
                block.add(i, len(ids) // 4)
            seqs = block.pack()
            groups = step_groups([size for size, _ in seqs], group_tokens)
            cols: list[list] = [[] for _ in SCHEMA.fields]
            for (size, pieces), g in zip(seqs, groups, strict=True):
                offset = 0
                for n, i, start in pieces:
                    doc, ids = held[i]
                    row = (doc, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, part << 40 | seq_no, offset, size, part << 40 | group_no + g)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    offset += n
                seq_no += 1
            group_no += max(groups, default=-1) + 1
            held, tokens = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            lengths = pc.utf8_length(texts).to_pylist()
            for a, b in by_bytes([range(n or 0) for n in lengths], 4_000_000):
                some = texts.slice(a, b - a).to_pylist()
                for doc, ids in zip(docs.slice(a, b - a).to_pylist(), tok.encode(some), strict=True):
                    held.append((doc, ids + end))
                    tokens += len(ids) // 4 + 1
                if tokens >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    return run


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, window: int = 2048, smallest: int = 256, end_id: int = 1,
    block_tokens: int = 4_000_000, group_tokens: int = 65_536, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row for each piece of a document in a sequence; see the module's docstring."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    if window & (window - 1) or smallest & (smallest - 1):
        raise ValueError("window and smallest must be powers of two")
    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return some.mapInArrow(trimmed(packer(tokenizer_path, window, smallest, end_id, block_tokens, group_tokens)), SCHEMA)
