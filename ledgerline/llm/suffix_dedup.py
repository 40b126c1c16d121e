"""Operator 5: removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte of a document goes that is covered by a string of `least` bytes which also starts in a document with a
smaller doc_id. A global suffix array would put all of the text in one place, so the text is divided by anchors: of the
grams of `gram` bytes within each string of `least` bytes, the one of the smallest hash. Equal strings have equal
anchors, so the occurrences of an anchor, with the bytes around them that such strings can reach, can be solved apart.

1. Documents are packed into chunks, and each chunk gives its anchors by buckets of the anchor's hash: the hash, a hash
   of the bytes around, the smallest document. Equal ones count once, so a very common passage adds one for each chunk.
2. Per bucket: anchors of one document only are dropped. If all occurrences have the same bytes around, they are one
   interval longer than the threshold, and the smallest document is known. The others ask for the bytes themselves,
   once for each different surrounding.
3. Per bucket, surroundings that share the anchor and half of the other bytes on one side with another (no other can
   share a string) are put together in blocks of bounded size and their transform is built. If those of one anchor
   alone exceed a block they are divided: a common string goes on for at least half of its other bytes on one side, so
   the surroundings are dealt by these bytes, once by each side, and what is still too large is divided again with the
   longer string in place of the anchor, until it has all the bytes. Breadth-first
   backward extension splits the interval of all suffixes level by level: level l marks where neighbours share l bytes
   and no more, so common prefixes come up by increasing value, and it stops at `least`. What is not split by then are
   the equal strings; the smallest document of each goes back to the chunks that hold it.
4. Each chunk marks what is covered and gives its documents' digests.

Hashes: 48 bits of the anchor's, 48 bits of its surroundings'; two different surroundings of one anchor are taken for
equal with a chance of 2**-48.

Defined results: null text is empty. Rows with a null doc_id are left whole and remove nothing elsewhere. Rows that
repeat a doc_id do not remove each other. Strings are compared as UTF-8 bytes and never cross documents. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import Workspace, trimmed

NO_DOC = np.int64(2**63 - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOW48 = np.uint64(2**48 - 1)
CHUNK = "chunk long, kind int, docs binary, ends binary, blob binary"
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 2**64))


def slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over x[i : i + n] for every i at which that fits."""
    out, have = x, 1
    while 2 * have <= n:
        out, have = pick(out[:-have], out[have:]), 2 * have
    return pick(out[: len(out) - (n - have)], out[n - have :]) if have < n else out


def packed(x: dict[str, np.ndarray]) -> bytes:
    """Arrays of 64-bit numbers, byte planes apart, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8).T).tobytes() for v in x.values()))


def unpacked(blob: bytes, types: list) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // (8 * len(types))
    return [np.ascontiguousarray(raw[i * 8 * n : (i + 1) * 8 * n].reshape(8, n).T).reshape(-1).view(t) for i, t in enumerate(types)]


class Text:
    """A chunk's documents: ids, ends within the buffer, and the bytes."""

    def __init__(self, docs: bytes, ends: bytes, blob: bytes):
        import zstandard

        self.docs, self.ends = np.frombuffer(docs, np.int64), np.frombuffer(ends, np.int64)
        self.bytes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8) if len(blob) else np.zeros(0, np.uint8)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def pieces(self, size: int = 1_500_000) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about size bytes."""
        a = 0
        while a < len(self.ends):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + size, "right")))
            yield a, b
            a = b

    def anchors(self, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all anchors: place in the buffer, number of the document, hash, hash of the bytes around."""
        out = [self._anchors(a, b, least, gram) for a, b in self.pieces()]
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(np.uint64), z.astype(np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _anchors(self, a: int, b: int, least: int, gram: int):
        import xxhash

        base, stop = int(self.starts[a]), int(self.ends[b - 1])
        t, n, w = self.bytes[base:stop], stop - base, least - gram + 1
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if n < least:
            return none
        grams = {1: t.astype(np.uint64) + np.uint64(1)}
        k = 1
        while 2 * k <= 64 and 2 * k <= n:
            grams[2 * k] = grams[k][: n - 2 * k + 1] * power(k) + grams[k][k : n - k + 1]
            if k not in (1, 4, 16):
                del grams[k]
            k *= 2
        # 21 = 16 + 4 + 1
        h = None
        at = 0
        for bit in (16, 4, 1):
            if gram & bit:
                part = grams[bit][at : at + n - gram + 1]
                h = part if h is None else h * power(bit) + part
                at += bit
        h = mix(h)
        order = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        lows = slide(order, w, np.minimum)  # by the string's start
        left = np.repeat(self.ends[a:b] - base, self.ends[a:b] - self.starts[a:b])[: len(lows)] - np.arange(len(lows))
        lows = np.where(left >= least, lows, np.uint32(0))
        tops = slide(np.concatenate([np.zeros(w - 1, np.uint32), lows, np.zeros(w - 1, np.uint32)]), w, np.maximum)
        p = np.flatnonzero(tops == order)
        doc = np.searchsorted(self.ends[a:b] - base, p, "right")
        ds, de = (self.starts[a:b] - base)[doc], (self.ends[a:b] - base)[doc]
        lo, hi = np.maximum(ds, p - (w - 1)), np.minimum(de, p + least)
        whole = (hi - lo == least + w - 1) & (hi - lo >= 64) & (hi - lo <= 80)
        around = np.zeros(len(p), np.uint64)
        q = np.flatnonzero(whole)
        if len(q):
            around[q] = mix(grams[64][lo[q]] * power(7) + mix(grams[16][hi[q] - 16]))
        raw = t.tobytes()
        for i in np.flatnonzero(~whole).tolist():
            around[i] = xxhash.xxh3_64_intdigest(raw[lo[i] : hi[i]], seed=int(p[i] - lo[i]) + 1)
        return p + base, doc + a, h[p] & LOW48, mix(around) & LOW48


def key(h: np.ndarray, around: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + around)


def chunker(chunk_bytes: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        press, part, count = zstandard.ZstdCompressor(1), TaskContext.get().partitionId(), 0
        docs, texts, size = [], [], 0

        def flush():
            nonlocal docs, texts, size, count
            ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
            row = [part << 32 | count], [0], [np.array(docs, np.int64).tobytes()], [ends.tobytes()], [press.compress(b"".join(texts))]
            count, docs, texts, size = count + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "kind", "docs", "ends", "blob"])

        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                for doc, text in zip(batch.column(0).slice(a, 200).to_pylist(), batch.column(1).slice(a, 200).to_pylist(), strict=True):
                    docs.append(-(2**63) if doc is None else doc)
                    texts.append(text.encode("utf-8", "surrogatepass") if text else b"")
                    size += len(texts[-1])
                    if size >= chunk_bytes or len(docs) >= 200_000:
                        yield flush()
        if docs:
            yield flush()

    return run


#: Stands for a null doc_id within chunks; such documents give no anchors.
NULL_DOC = np.int64(-(2**63))


def offering(least: int, gram: int, buckets: int):
    """Step 1: a chunk's different anchors by bucket."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for chunk, docs, ends, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "docs", "ends", "blob")), strict=True):
                text = Text(docs, ends, blob)
                _, doc, h, around = text.anchors(least, gram)
                ids = text.docs[doc]
                keep = ids != NULL_DOC
                h, around, ids = h[keep], around[keep], ids[keep]
                o = np.lexsort((ids, around, h))
                h, around, ids = h[o], around[o], ids[o]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1])
                starts = np.flatnonzero(first)
                last = ids[np.concatenate([starts[1:], [len(ids)]]) - 1] if len(ids) else ids
                h, around, ids = h[first], around[first], ids[first]
                bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                for b in range(buckets):
                    i = by[cuts[b] : cuts[b + 1]]
                    if len(i):
                        step = np.diff(h[i], prepend=np.uint64(0))
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([chunk], pa.int64()), pa.array([packed({"h": step, "around": around[i], "doc": ids[i], "last": last[i] - ids[i]})], pa.binary())], names=["bucket", "chunk", "blob"])

    return run


def grouped(batches: Iterator, columns: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a partition that is sorted by its first column, group by group."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != at:
                if held:
                    yield at, held
                at, held = row[0], []
            held.append(row[1:])
    if held:
        yield at, held


def starts_of(*sorted_columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = False
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def deciding(batches: Iterator) -> Iterator:
    """Step 2: kind 1, answers to chunks (key, smallest document); kind 2, anchors that chunks are to show; kind 3, for the bucket's step 3: who holds which."""
    import pyarrow as pa

    for bucket, rows in grouped(batches, ["bucket", "chunk", "blob"]):
        cols = [unpacked(blob, [np.uint64, np.uint64, np.int64, np.int64]) for _, blob in rows]
        h = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in cols])
        around, doc, last = (np.concatenate([c[k] for c in cols]) for k in (1, 2, 3))
        last = doc + last
        chunk = np.repeat(np.array([c for c, _ in rows], np.int64), [len(c[0]) for c in cols])
        o = np.lexsort((doc, around, h))
        h, around, doc, last, chunk = h[o], around[o], doc[o], last[o], chunk[o]
        g = starts_of(h)
        sizes = np.diff(np.append(g, len(h)))
        shared = np.repeat(np.minimum.reduceat(doc, g) != np.maximum.reduceat(last, g), sizes)
        single = np.repeat(np.minimum.reduceat(around, g) == np.maximum.reduceat(around, g), sizes)
        least = np.repeat(np.minimum.reduceat(doc, g), sizes)
        k = key(h, around)
        sure, open_ = shared & single, shared & ~single
        first = np.zeros(len(h), bool)
        first[starts_of(h, around)] = True  # the smallest document's chunk shows the bytes around
        out = []
        for kind, keep, second in ((1, sure, least), (2, open_ & first, doc)):
            i = np.flatnonzero(keep)
            i = i[np.argsort(chunk[i], kind="stable")]
            s = starts_of(chunk[i]) if len(i) else []
            for a, b in zip(s, [*s[1:], len(i)], strict=True):
                out.append((int(chunk[i[a]]), kind, bucket, packed({"k": k[i[a:b]], "doc": second[i[a:b]]})))
        if open_.any():
            out.append((-1, 3, bucket, packed({"k": k[open_], "chunk": chunk[open_]})))
        if out:
            c = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary())], names=["chunk", "kind", "bucket", "blob"])


def showing(least: int, gram: int):
    """Step 2, back at the chunks: the bytes around the anchors that were asked for, by bucket."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(1)
        for _, rows in grouped(batches, ["chunk", "kind", "bucket", "docs", "ends", "blob"]):
            text = next((Text(*r[2:]) for r in rows if r[0] == 0), None)
            asked = [r for r in rows if r[0] == 2]
            if text is None or not asked:
                continue
            p, doc, h, around = text.anchors(least, gram)
            k = key(h, around)
            keep = text.docs[doc] != NULL_DOC
            p, doc, h, k = p[keep], doc[keep], h[keep], k[keep]
            o = np.argsort(k, kind="stable")
            k = k[o]
            w = least - gram + 1
            raw = text.bytes.tobytes()
            for r in asked:
                want, ids = unpacked(r[4], [np.uint64, np.int64])
                at = o[np.searchsorted(k, want)]
                lo = np.maximum(text.starts[doc[at]], p[at] - (w - 1))
                hi = np.minimum(text.ends[doc[at]], p[at] + least)
                body = b"".join([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
                head = packed({"k": want, "doc": ids, "n": (hi - lo).astype(np.int64), "h": h[at], "left": (p[at] - lo).astype(np.int64)})
                yield pa.RecordBatch.from_arrays([pa.array([r[1]], pa.int64()), pa.array([4], pa.int32()), pa.array([head], pa.binary()), pa.array([press.compress(body)], pa.binary())], names=["bucket", "kind", "head", "body"])

    return run


def equal_strings(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and where groups with equal first `least` symbols begin; symbol 0 parts strings.

    Symbols are below 512. Order up to `least` symbols comes from sorting by ever longer prefixes. The last one below
    `least` gives the intervals to begin with, and breadth-first backward extension on the transform splits them further.
    """
    n = len(text)
    # seven symbols of nine bits first, then prefix doubling
    have = 7
    ends = np.concatenate([text.astype(np.int64), np.zeros(have, np.int64)])
    value = np.zeros(n, np.int64)
    for j in range(have):
        value = value << 9 | ends[j : j + n]
    level, rank = 1, text  # intervals are known up to so many symbols
    while True:
        suffixes = np.argsort(value)
        ordered = value[suffixes]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if have >= least or new.all():
            break
        rank = np.empty(n, np.int64)
        rank[suffixes] = np.cumsum(new)
        level = have
        # three ranks in one number where they fit, else two
        times, value = 3 if (n + 2) ** 3 <= 2**63 else 2, rank
        for k in range(1, times):
            value = value * (n + 2)
            value[: max(0, n - k * have)] += rank[k * have :]
        have *= times
    place = np.empty(n, np.int64)
    place[suffixes] = np.arange(n)
    after = place[(suffixes + 1) % n]  # where the suffix one symbol shorter stands; the last one's is the first symbol
    bounds, split = np.zeros(n, bool), np.empty(n, bool)
    known = rank[suffixes]
    bounds[0] = True
    bounds[1:] = known[1:] != known[:-1]
    interval, shorter = np.empty(n, np.int32), np.empty(n, np.int32)
    for _ in range(level, least):
        np.cumsum(bounds, dtype=np.int32, out=interval)
        np.take(interval, after, out=shorter, mode="clip")
        np.not_equal(shorter[1:], shorter[:-1], out=split[1:])
        split[0] = True
        split |= bounds
        if np.array_equal(split, bounds):
            break
        bounds, split = split, bounds
    return suffixes, bounds


def may_meet(body: np.ndarray, starts: np.ndarray, size: np.ndarray, left: np.ndarray, least: int, gram: int) -> np.ndarray:
    """Surroundings that another one can share a string of `least` bytes with.

    Such a string has the anchor and, on one of its sides, at least half of the other bytes; so the anchor with that many
    bytes on this side is shared as well.
    """
    half = (least - gram + 1) // 2
    n = gram + half
    factors = np.array([pow(int(BASE), j + 1, 2**64) for j in range(n)], np.uint64)
    out = np.zeros(len(size), bool)
    for first, fits in ((left, left + n <= size), (left - half, left >= half)):
        i = np.flatnonzero(fits)
        h = np.empty(len(i), np.uint64)
        for a in range(0, len(i), 50_000):
            at = (starts[i[a : a + 50_000]] + first[i[a : a + 50_000]])[:, None] + np.arange(n)
            h[a : a + 50_000] = (body[at].astype(np.uint64) * factors).sum(1)
        _, which, times = np.unique(h, return_inverse=True, return_counts=True)
        out[i] |= times[which] > 1
    return out


def smallest(body: np.ndarray, starts: np.ndarray, size: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """The smallest document of each string of `least` bytes in some surroundings, one after the other, by the transform."""
    n = len(size)
    place = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    whose = np.repeat(np.arange(n), size + 1)
    where = np.arange(len(whose)) - place[whose]
    inside = where < size[whose]
    text = np.zeros(len(whose), np.int32)
    text[inside] = body[(starts[whose] + where)[inside]].astype(np.int32) + 1
    suffixes, bounds = equal_strings(text, least)
    fits = where + least <= size[whose]
    ids = np.where(fits, doc[whose], NO_DOC)[suffixes]
    g = np.flatnonzero(bounds)
    of = np.empty(len(text), np.int64)
    of[suffixes] = np.repeat(np.minimum.reduceat(ids, g), np.diff(np.append(g, len(ids))))
    return of[fits]


class Surroundings:
    """Surroundings of anchors and what is found of their strings so far, those of each in a row."""

    def __init__(self, body: np.ndarray, starts: np.ndarray, size: np.ndarray, left: np.ndarray, doc: np.ndarray, least: int, block_bytes: int):
        self.body, self.starts, self.size, self.left, self.doc, self.least, self.block_bytes = body, starts, size, left, doc, least, block_bytes
        self.windows = np.maximum(0, size - least + 1)
        self.first = np.cumsum(self.windows) - self.windows
        self.found = np.repeat(doc, self.windows)

    def solve(self, part: np.ndarray) -> None:
        """Takes up the smallest documents among some surroundings."""
        values = smallest(self.body, self.starts[part], self.size[part], self.doc[part], self.least)
        n = self.windows[part]
        at = np.repeat(self.first[part], n) + np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
        self.found[at] = np.minimum(self.found[at], values)

    def divide(self, part: np.ndarray, before: int, after: int) -> None:
        """Solves surroundings that share the bytes from `before` ahead of the anchor's start to `after` behind it."""
        if len(part) < 2:
            return
        if int((self.size[part] + 1).sum()) <= self.block_bytes:
            self.solve(part)
            return
        rest = self.least - before - after
        if rest <= 0:  # all hold one string of that length
            at = self.first[part] + self.left[part] - before
            self.found[at] = np.minimum(self.found[at], self.doc[part].min())
            return
        half = -(-rest // 2)
        for b, a in ((before, after + half), (before + half, after)):
            some = part[(self.left[part] >= b) & (self.left[part] + a <= self.size[part])]
            if not len(some):
                continue
            factors = np.array([pow(int(BASE), j + 1, 2**64) for j in range(b + a)], np.uint64)
            h = np.empty(len(some), np.uint64)
            for k in range(0, len(some), 50_000):
                few = some[k : k + 50_000]
                at = (self.starts[few] + self.left[few] - b)[:, None] + np.arange(b + a)
                h[k : k + 50_000] = (self.body[at].astype(np.uint64) * factors).sum(1)
            order = np.argsort(h, kind="stable")
            some, h = some[order], h[order]
            g = starts_of(h)
            together: list[np.ndarray] = []  # small groups share a block
            held = 0
            for x, y in zip(g.tolist(), [*g[1:].tolist(), len(some)], strict=True):
                group = some[x:y]
                if len(group) < 2:
                    continue
                size = int((self.size[group] + 1).sum())
                if size > self.block_bytes:
                    self.divide(group, b, a)
                    continue
                if together and held + size > self.block_bytes:
                    self.solve(np.concatenate(together))
                    together, held = [], 0
                together.append(group)
                held += size
            if together:
                self.solve(np.concatenate(together))


def solving(least: int, gram: int, block_bytes: int):
    """Step 3: for each surrounding the smallest document of each string of `least` bytes in it, sent to its holders."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for bucket, rows in grouped(batches, ["bucket", "kind", "head", "body"]):
            shown = [r for r in rows if r[0] == 4]
            if not shown:
                continue
            heads = [unpacked(r[1], [np.uint64, np.int64, np.int64, np.uint64, np.int64]) for r in shown]
            k, doc, size, h, left = (np.concatenate([x[i] for x in heads]) for i in range(5))
            body = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r[2]) for r in shown), np.uint8)
            starts = np.cumsum(size) - size
            # strings that share an anchor can be equal; blocks are cut between anchors
            some = np.flatnonzero(may_meet(body, starts, size, left, least, gram))
            order = some[np.argsort(h[some], kind="stable")]
            around = Surroundings(body, starts, size, left, doc, least, block_bytes)
            sizes, marks = size[order], h[order]
            totals = np.cumsum(sizes + 1)
            a = 0
            while a < len(order):
                done = totals[a - 1] if a else 0
                b = max(int(np.searchsorted(totals, done + block_bytes, "right")), a + 1)
                if b < len(order) and marks[b] == marks[b - 1]:
                    back = int(np.searchsorted(marks[a:b], marks[b - 1])) + a  # where this anchor begins
                    b = back if back > a else int(np.searchsorted(marks[a:], marks[a], "right")) + a
                around.divide(order[a:b], 0, gram) if marks[a] == marks[b - 1] else around.solve(order[a:b])
                a = b
            o = np.argsort(k)
            sorted_k = k[o]
            n, first, found = around.windows, around.first, around.found
            plain = np.ones(len(k), bool)  # all strings have one smallest document
            full = np.flatnonzero(n)
            if len(full):
                plain[full] = np.minimum.reduceat(found, first[full]) == np.maximum.reduceat(found, first[full])
            for r in rows:
                if r[0] != 3:
                    continue
                hk, hc = unpacked(r[1], [np.uint64, np.int64])
                by = np.argsort(hc, kind="stable")
                hk, hc = hk[by], hc[by]
                s = starts_of(hc)
                for x, y in zip(s, [*s[1:], len(hc)], strict=True):
                    at = o[np.searchsorted(sorted_k, hk[x:y])]
                    one = plain[at] & (n[at] > 0)
                    out = [(1, packed({"k": hk[x:y][one], "doc": found[first[at[one]]]}), b"")]
                    if not plain[at].all():
                        each = at[~plain[at]]
                        m = n[each]
                        place = np.repeat(first[each], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                        out.append((5, packed({"k": hk[x:y][~plain[at]], "n": m}), packed({"v": found[place]})))
                    for kind, head, values in out:
                        row = (int(hc[x]), kind, head, values)
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "kind", "docs", "blob"])

    return run


def marking(least: int, gram: int):
    """Step 4: what is covered, and each document's digest."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        w = least - gram + 1
        for _, rows in grouped(batches, ["chunk", "kind", "docs", "ends", "blob"]):
            text = next((Text(*r[1:]) for r in rows if r[0] == 0), None)
            if text is None:
                continue
            p, doc, h, around = text.anchors(least, gram)
            k = key(h, around)
            keep = text.docs[doc] != NULL_DOC
            p, doc, k = p[keep], doc[keep], k[keep]
            o = np.argsort(k, kind="stable")
            sorted_k = k[o]
            ids = text.docs[doc]
            lo, hi = np.maximum(text.starts[doc], p - (w - 1)), np.minimum(text.ends[doc], p + least)
            edge = np.zeros(len(text.bytes) + 1, np.int32)
            for kind, head, _, blob in rows:
                if kind not in (1, 5):
                    continue
                if kind == 1:
                    want, smallest = unpacked(head if head is not None else blob, [np.uint64, np.int64])
                else:
                    want, lengths = unpacked(head, [np.uint64, np.int64])
                    [values] = unpacked(blob, [np.int64])
                    offsets = np.cumsum(lengths) - lengths
                a, b = np.searchsorted(sorted_k, want, "left"), np.searchsorted(sorted_k, want, "right")
                which = np.repeat(np.arange(len(want)), b - a)
                at = o[np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
                if kind == 1:
                    hit = at[ids[at] > smallest[which]]
                    np.add.at(edge, lo[hit], 1)
                    np.add.at(edge, hi[hit], -1)
                else:
                    n = np.maximum(0, hi[at] - lo[at] - least + 1)
                    each = np.repeat(np.arange(len(at)), n)
                    step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    hit = values[offsets[which[each]] + step] < ids[at[each]]
                    s = (lo[at[each]] + step)[hit]
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + least, -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            out = [[] for _ in range(5)]
            for i, (d, s, e) in enumerate(zip(text.docs.tolist(), text.starts.tolist(), text.ends.tolist(), strict=True)):
                g = gone[s:e]
                n = int(g.sum())
                kept = text.bytes[s:e][~g] if n else text.bytes[s:e]
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n else 0
                for c, v in zip(out, (None if d == NULL_DOC else d, e - s, n, spans, hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], names=[f.name for f in RESULT.fields])

    return run


def remove_repeats(
    spark: SparkSession, docs: DataFrame, least: int = 50, chunk_bytes: int = 8 << 20, bucket_bytes: int = 8 << 20,
    block_bytes: int = (2 << 20) - 64, least_buckets: int = 32, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row; see the module's docstring."""
    gram = 21 if least >= 40 else max(1, least // 2 + 1)
    if gram != 21:
        gram = max(g for g in (1, 4, 5, 16, 17, 20, 21) if g <= gram)
    work = Workspace(spark, "suffix")
    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chunks = work.write(some.mapInArrow(trimmed(chunker(chunk_bytes)), CHUNK), "chunks")
    size = some.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(least_buckets, -(-int(size) // bucket_bytes))
    offered = chunks.mapInArrow(trimmed(offering(least, gram, buckets)), "bucket long, chunk long, blob binary")
    decided = offered.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(deciding), "chunk long, kind int, bucket long, blob binary")
    decided = work.write(decided, "decided")
    work.release()

    n_chunks = max(1, chunks.count())
    parts = min(n_chunks, max(1, spark.sparkContext.defaultParallelism * 4, n_chunks // 4))
    nothing = F.lit(None).cast("binary")
    asked = chunks.select("chunk", "kind", F.lit(-1).cast("long").alias("bucket"), "docs", "ends", "blob").union(decided.where("kind = 2").select("chunk", "kind", "bucket", nothing.alias("docs"), nothing.alias("ends"), "blob"))
    shown = asked.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(trimmed(showing(least, gram)), "bucket long, kind int, head binary, body binary")
    holders = decided.where("kind = 3").select("bucket", "kind", F.col("blob").alias("head"), nothing.alias("body"))
    solved = shown.union(holders).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(solving(least, gram, block_bytes)), "chunk long, kind int, docs binary, blob binary")
    solved = work.write(solved, "solved")
    work.release()

    sure = decided.where("kind = 1").select("chunk", "kind", nothing.alias("docs"), nothing.alias("ends"), "blob")
    all_ = chunks.select("chunk", "kind", "docs", "ends", "blob").union(sure).union(solved.select("chunk", "kind", "docs", nothing.alias("ends"), "blob"))
    return all_.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(trimmed(marking(least, gram)), RESULT)
