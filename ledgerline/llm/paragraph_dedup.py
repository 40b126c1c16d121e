"""Operator 6: near-duplicate paragraphs by MinHash banding, exact verification and components.

Paragraphs are taken at two levels. Lines are matched as wholes first (`whole`), and those that are near copies of an
earlier line go with all their sentences. Then the sentences (runs of words up to a word that ends in . ! ? or to a
line's end) of the lines that stay are matched, so that a passage in the midst of different lines is found as well, and
what a sentence gives way to stands in a line that stays. Only sentences are counted. Units may have any length
(`least_words` can leave short sentences out); fewer words than a shingle has are one shingle.

Units with equal shingle sets (128 bits of hash) are one class. Few minima in short bands make recall high (6 bands of 2:
a pair at Jaccard 0.8 is missed with a chance of 0.2 %, one at 0.9 with 5e-5); band hashes travel as packed arrays, and
only classes that share a band's hash go on as rows. Sets too small to reach the threshold with any other set (below 4
shingles at 0.8) have equal ones only, which are one class already, so they have no bands. Those that meet are verified
on full sets, in bounded units, and clustered by components. Of every cluster the first unit (smallest doc_id, then
order in the text) stays, the others are removals.

Passages are found besides, wherever they begin and end: a document is a sequence of words, and each of its windows of
`passage_words` (50) stands for its mark, the smallest hash of the strings of `mark_words` (38) in it. Two equal windows
have equal marks, so every passage of 50 words or more that an earlier document (a smaller doc_id) holds too is found; a
mark that two documents share is a string of 38 words that both hold (hashes have 64 bits: n marks make a chance of
n * n / 2**65 for one that is not). n_passages_repeated counts the distinct marks that an earlier document has. They are
counted, not removed: removals are units. A task sends on one document for each mark at a time, the others are known to
be later ones, so a mark of very many documents takes few rows.

Texts are kept once, as compressed chunks of about `chunk_chars` characters with the places of their units, and a unit's
words are cut out of its chunk when it is verified. A line is held by one task at a time, whole.

Defined results: null, empty and blank texts have no units. Rows without a doc_id take no part and are not returned.
Rows that repeat a doc_id count as one document, and their units as its own. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Workspace, trimmed
from ledgerline.llm.components import components
from ledgerline.llm.minhash import class_links, share_buckets
from ledgerline.llm.suffix_dedup import grouped, packed, slide, starts_of, unpacked

CUT = "doc_id long, seq long, rep long, rep2 long, n long, buckets binary, line long, chunk long, blob binary, places binary, kind int"
#: Kinds of rows: documents and chunks of text (with a chunk's number), lines, sentences, marks of passages. A task has a file for each.
HELD, LINE, SENTENCE, MARK = range(4)
#: A unit's number is its chunk's number, shifted by so many bits, plus its place in the chunk.
UNIT_BITS = 22
#: By a word's last byte: whether a sentence ends with it.
ENDS = np.isin(np.arange(256), list(b".!?"))


def encoded_lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")


class Cut:
    """The units of a chunk of lines as ranges of its words: lines first where whole, then sentences, each in order."""

    def __init__(self, lines: list[list[bytes]], docs: np.ndarray, least_words: int, whole: bool):
        counts = np.array([len(x) for x in lines], np.int64)
        some = np.flatnonzero(counts)
        self.words = [w for x in lines for w in x]
        self.blob = b" ".join(self.words)
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(sizes + 1) - 1  # of each word in the blob
        line_stop = np.cumsum(counts[some])
        line_start = line_stop - counts[some]
        stops = np.zeros(len(self.words), bool)
        if len(stops):
            stops = ENDS[np.frombuffer(self.blob, np.uint8)[self.ends - 1]]
            stops[line_stop - 1] = True
        b = np.flatnonzero(stops) + 1
        a = np.concatenate([[0], b[:-1]]).astype(np.int64)
        keep = b - a >= max(1, least_words)
        a, b = a[keep], b[keep]
        of = np.searchsorted(line_stop, a, "right")  # the line of each sentence
        held = np.unique(of) if whole else np.zeros(0, np.int64)
        self.start, self.stop = np.concatenate([line_start[held], a]), np.concatenate([line_stop[held], b])
        self.doc = docs[some][np.concatenate([held, of])]
        self.head = np.concatenate([np.arange(len(held)), np.searchsorted(held, of) if whole else np.arange(len(of))])
        self.n_lines = len(held)

    def __len__(self) -> int:
        return len(self.start)

    def places(self) -> np.ndarray:
        """Start and end of each unit in the blob."""
        starts = np.concatenate([[0], self.ends + 1])
        return np.stack([starts[self.start], self.ends[self.stop - 1]], 1).astype(np.int64) if len(self) else np.zeros((0, 2), np.int64)

    def sets(self, w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingle hashes of all units, and where each unit's begin; w: the hashes of the words."""
        import xxhash

        from ledgerline.llm.shingles import PLACES, mix

        n = np.maximum(0, self.stop - self.start - width + 1)
        h = np.zeros(0, np.uint64)
        if len(w) >= width:
            h = w[: len(w) - width + 1] * PLACES[0]
            for j in range(1, width):
                part = w[j : len(w) - width + 1 + j]
                h += (part ^ (part >> np.uint64(31))) * PLACES[j]
            h = mix(h)
        of = np.repeat(np.arange(len(self)), n)
        at = np.repeat(self.start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        short = np.flatnonzero(n == 0)
        one = [xxhash.xxh3_64_intdigest(b" ".join(self.words[a:b]), seed=b - a) for a, b in zip(self.start[short].tolist(), self.stop[short].tolist(), strict=True)]
        h, of = np.concatenate([h[at], np.array(one, np.uint64)]), np.concatenate([of, short])
        # repeated shingles within a unit are few: they are found by one plain sort and only they are compared
        both = mix(h) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ordered = np.sort(both)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            some = np.flatnonzero(np.isin(both, twice))
            o = np.lexsort((h[some], of[some]))
            first = np.zeros(len(some), bool)
            first[o[starts_of(of[some][o], h[some][o])]] = True
            keep = np.ones(len(h), bool)
            keep[some[~first]] = False
            h, of = h[keep], of[keep]
        o = np.argsort(of, kind="stable") if len(short) else slice(None)
        return h[o], starts_of(of[o])


class Marks:
    """The marks of the windows of texts that come in pieces, one text after the other."""

    def __init__(self, passage_words: int, mark_words: int):
        self.passage, self.mark = passage_words, mark_words
        self.powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.w, self.text, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, w: np.ndarray, text: np.ndarray, doc: np.ndarray) -> None:
        """The next words: their hashes, the numbers of their texts and their doc_ids."""
        from ledgerline.llm.shingles import mix

        w, text, doc = np.concatenate([self.w, w]), np.concatenate([self.text, text]), np.concatenate([self.doc, doc])
        # the last words of a text that may go on
        k = max(len(w) - self.passage + 1, 0)
        self.w, self.text, self.doc = w[k:].copy(), text[k:].copy(), doc[k:].copy()
        if not k:
            return
        if len(self.powers[0]) < len(w):
            odd = 0x9E3779B97F4A7C15
            self.powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * len(w), b, np.uint64)])) for b in (odd, pow(odd, -1, 2**64)))
        up, down = self.powers
        # the strings' hashes are differences of sums of word hashes times powers, brought back to the first power
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w) * up[: len(w)])])
        m = self.mark
        m = mix((sums[m:] - sums[:-m]) * down[: len(sums) - m])
        m = slide(m, self.passage - self.mark + 1, np.minimum)
        same = text[:k] == text[self.passage - 1 :]
        m, text, doc = m[same], text[:k][same], doc[:k][same]
        if len(m):
            first = starts_of(text, m)
            self.held.append((m[first], doc[first]))
            self.count += len(first)

    def taken(self) -> tuple[int, bytes, bytes]:
        """The marks held so far: how many, each with its smallest doc_id, and the pairs of other documents and marks."""
        m, doc = (np.concatenate([x[k] for x in self.held]) for k in (0, 1))
        self.held, self.count = [], 0
        o = np.lexsort((doc, m))
        m, doc = m[o], doc[o]
        one = starts_of(m, doc)
        m, doc = m[one], doc[one]
        first = np.zeros(len(m), bool)
        first[starts_of(m)] = True
        return int(first.sum()), packed({"mark": np.diff(m[first], prepend=np.uint64(0)), "doc": doc[first]}), packed({"mark": m[~first], "doc": doc[~first]})


def pairs_of(mark: np.ndarray, doc: np.ndarray) -> Iterator:
    import pyarrow as pa

    for k in range(0, len(mark), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(doc[k : k + 100_000]), pa.array(mark[k : k + 100_000].view(np.int64))], names=["doc_id", "mark"])


def known_later(batches: Iterator) -> Iterator:
    """Documents and marks that a task has seen to be in an earlier document."""
    for batch in batches:
        for blob in batch.column(0):
            yield from pairs_of(*unpacked(blob.as_py(), [np.uint64, np.int64]))


def dealing(parts: int):
    """Marks and their smallest doc_ids, packed by part."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bounds = np.array([k * 2**64 // parts for k in range(1, parts)], np.uint64)
        for batch in batches:
            for blob in batch.column(0):
                m, doc = unpacked(blob.as_py(), [np.uint64, np.int64])
                m = np.cumsum(m, dtype=np.uint64)
                cuts = [0, *np.searchsorted(m, bounds).tolist(), len(m)]
                some = [(k, packed({"mark": np.diff(m[a:b], prepend=np.uint64(0)), "doc": doc[a:b]})) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary())], names=["part", "blob"])

    return run


def later(batches: Iterator) -> Iterator:
    """Documents and marks that an earlier document has, part by part."""
    for _, rows in grouped(batches, ["part", "blob"]):
        cols = [unpacked(blob, [np.uint64, np.int64]) for (blob,) in rows]
        m = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in cols])
        doc = np.concatenate([c[1] for c in cols])
        o = np.lexsort((doc, m))
        m, doc = m[o], doc[o]
        g = starts_of(m)
        keep = doc != np.repeat(doc[g], np.diff(np.append(g, len(m))))
        yield from pairs_of(m[keep], doc[keep])


def repeated_passages(work: Workspace, marks: DataFrame, part_marks: int) -> DataFrame:
    """doc_id and passages, the distinct marks that an earlier document has; marks: n, blob, places as the cutter makes them."""
    parts = max(32, -(-(marks.agg(F.sum("n")).first()[0] or 0) // part_marks))
    pairs = "doc_id long, mark long"
    met = marks.select("blob").mapInArrow(trimmed(dealing(parts)), "part long, blob binary").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(trimmed(later), pairs)
    some = marks.select("places").mapInArrow(trimmed(known_later), pairs).union(met)
    return work.write(some.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages")), "passages")


def cutter(width: int, least_words: int, bands: int, rows: int, percent: int, whole: bool, chunk_chars: int, passage_words: int, mark_words: int):
    """Rows for the units, the texts of chunks, the documents with their numbers of sentences (adding up), and the marks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        from ledgerline.llm.shingles import Minima, WordHashes, mix

        minima, cache, press = Minima(bands, rows), WordHashes(), zstandard.ZstdCompressor(3)
        marks = Marks(passage_words, mark_words)
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in CUT.split(", ")])
        next_chunk = TaskContext.get().partitionId() << 20
        bits = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def rows_of(count: int, **columns):
            arrays = (columns.get(f.name) for f in schema)
            return pa.RecordBatch.from_arrays([pa.nulls(count, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(schema, arrays, strict=True)], schema=schema)

        def marked():
            count, firsts, others = marks.taken()
            return rows_of(1, n=[count], blob=[firsts], places=[others], kind=[MARK])

        def solved(lines: list[list[bytes]], docs: list[int], texts: list[int]):
            nonlocal next_chunk
            if len(cache) > 200_000:
                cache.clear()
            cut = Cut(lines, np.array(docs, np.int64), least_words, whole)
            w = np.fromiter(map(cache.__getitem__, cut.words), np.uint64, len(cut.words))
            counts = [len(x) for x in lines]
            marks.add(w, np.repeat(np.array(texts, np.int64), counts), np.repeat(np.array(docs, np.int64), counts))
            if marks.count >= 400_000:
                yield marked()
            n = len(cut)
            if not n:
                return
            ids = cut.doc[cut.n_lines :]
            first = starts_of(ids)
            yield rows_of(len(first), doc_id=ids[first], n=np.diff(np.append(first, len(ids))), kind=np.full(len(first), HELD))
            h, starts = cut.sets(w, width)
            sizes = np.diff(np.append(starts, len(h)))
            rep, rep2 = (mix(np.add.reduceat(mix(h ^ np.uint64(salt)), starts)).view(np.int64) for salt in (0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3))
            banded = 100 * sizes >= percent * (sizes + 1)
            buckets = pa.nulls(n, pa.binary())
            some = np.flatnonzero(banded)
            if len(some):
                x = (h >> np.uint64(32)).astype(np.uint32)
                sig = np.stack([np.minimum.reduceat(x * a_ + b_, starts)[some] for a_, b_ in zip(minima.a, minima.b, strict=True)], 1)
                wide = sig.reshape(len(some), bands, rows).astype(np.uint64)
                b = np.zeros((len(some), bands), np.uint64) + bits
                for r in range(rows):
                    b = mix(b * np.uint64(0xC2B2AE3D27D4EB4F) + wide[:, :, r])
                # 48 bits of each band's hash: chance collisions cost a check, no result
                six = (b >> np.uint64(16)).view(np.uint8).reshape(len(some), bands, 8)[:, :, :6]
                offsets = np.concatenate([[0], np.cumsum(banded * (6 * bands))]).astype(np.int32)
                valid = np.packbits(banded, bitorder="little").tobytes()
                buckets = pa.Array.from_buffers(pa.binary(), n, [pa.py_buffer(valid), pa.py_buffer(offsets.tobytes()), pa.py_buffer(six.tobytes())])
            base = next_chunk << UNIT_BITS
            yield rows_of(n, doc_id=cut.doc, seq=base + np.arange(n), rep=rep, rep2=rep2, n=sizes, buckets=buckets, line=base + cut.head, kind=np.where(np.arange(n) < cut.n_lines, LINE, SENTENCE))
            blob, places = press.compress(cut.blob), cut.places()
            for k in range(0, n, 1 << UNIT_BITS):
                yield rows_of(1, chunk=[next_chunk], blob=[blob], places=[press.compress(places[k : k + (1 << UNIT_BITS)].tobytes())], kind=[HELD])
                next_chunk += 1

        lines: list[list[bytes]] = []
        docs: list[int] = []
        texts: list[int] = []
        size = number = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 300):
                ids = batch.column(0).slice(a, 300)
                yield rows_of(len(ids), doc_id=ids, n=np.zeros(len(ids), np.int64), kind=np.full(len(ids), HELD))
                for doc, text in zip(ids.to_pylist(), batch.column(1).slice(a, 300).to_pylist(), strict=True):
                    whole_text = encoded_lines(text)
                    number += 1
                    for k in range(0, len(whole_text), 1000):
                        more = whole_text[k : k + 1000]
                        lines += [line.split() for line in more]
                        docs += [doc] * len(more)
                        texts += [number] * len(more)
                        size += sum(map(len, more)) + len(more)
                        if size >= chunk_chars:
                            yield from solved(lines, docs, texts)
                            lines, docs, texts, size = [], [], [], 0
        yield from solved(lines, docs, texts)
        if marks.count:
            yield marked()

    return run


def showing(batches: Iterator) -> Iterator:
    """The words of the units that are asked for, cut out of their chunks: rep (the unit's number) and text."""
    import pyarrow as pa
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    for _, rows in grouped(batches, ["chunk", "rep", "blob", "places"]):
        asked = [r[0] for r in rows if r[0] is not None]
        text = next((r for r in rows if r[0] is None), None)
        if not asked or text is None:
            continue
        blob = unpress.decompress(text[1])
        places = np.frombuffer(unpress.decompress(text[2]), np.int64).reshape(-1, 2)
        for k in range(0, len(asked), 5000):
            some = asked[k : k + 5000]
            at = places[np.array(some, np.int64) & ((1 << UNIT_BITS) - 1)].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blob[a:b] for a, b in at], pa.binary())], names=["rep", "text"])


def offering(bands: int, parts: int):
    """Band hashes of a task's classes, packed by part."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(held):
            rep = np.concatenate([r for r, _, _ in held])
            n = np.concatenate([x for _, x, _ in held])
            _, first = np.unique(rep, return_index=True)
            b = np.concatenate([x for _, _, x in held])[first]
            rep, n = np.repeat(rep[first], bands), np.repeat(n[first], bands)
            b = b.reshape(-1)
            o = np.argsort(b, kind="stable")
            b, rep, n = b[o], rep[o], n[o]
            cuts = np.searchsorted(b, np.array([k * 2**48 // parts for k in range(parts)], np.uint64))
            cuts = np.append(cuts, len(b))
            for k in range(parts):
                i = slice(cuts[k], cuts[k + 1])
                if cuts[k + 1] > cuts[k]:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed({"b": np.diff(b[i], prepend=np.uint64(0)), "rep": rep[i], "n": n[i]})], pa.binary())], names=["part", "blob"])

        held, count = [], 0
        for batch in batches:
            wide = np.zeros((batch.num_rows, bands, 8), np.uint8)
            wide[:, :, :6] = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, bands, 6)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), wide.reshape(-1, bands * 8).view(np.uint64)))
            count += batch.num_rows
            if count >= 400_000:
                yield from flush(held)
                held, count = [], 0
        if count:
            yield from flush(held)

    return run


def meeting(batches: Iterator) -> Iterator:
    """Classes that share a band's hash with another class."""
    import pyarrow as pa

    for _, rows in grouped(batches, ["part", "blob"]):
        cols = [unpacked(blob, [np.uint64, np.int64, np.int64]) for (blob,) in rows]
        b = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in cols])
        rep, n = (np.concatenate([c[k] for c in cols]) for k in (1, 2))
        o = np.lexsort((rep, b))
        b, rep, n = b[o], rep[o], n[o]
        first = starts_of(b, rep)
        b, rep, n = b[first], rep[first], n[first]
        g = starts_of(b)
        sizes = np.diff(np.append(g, len(b)))
        keep = np.repeat(sizes > 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(b[keep].view(np.int64)), pa.array(rep[keep]), pa.array(n[keep])], names=["bucket", "rep", "n"])


def keepers(work: Workspace, units: DataFrame, banded_units: DataFrame, chunks: DataFrame, percent: int, width: int, bands: int, rows: int, block_classes: int, block_shingles: int, part_classes: int) -> DataFrame:
    """rep, rep2 and keep (doc_id and seq of the first unit of its cluster) of each class that has a duplicate.

    units: doc_id, seq, rep, rep2; banded_units: rep, n, buckets of the same units at least, as others meet no class of
    these; chunks: chunk, blob, places.
    """
    offers = banded_units.where("buckets IS NOT NULL").select("rep", "n", "buckets")
    parts = max(32, -(-banded_units.count() * bands // (part_classes * 8)))
    offered = offers.mapInArrow(trimmed(offering(bands, parts)), "part long, blob binary")
    banded = offered.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(trimmed(meeting), "bucket long, rep long, n long")
    banded = work.write(banded, "banded")
    work.release()
    # a row for each class that is repeated or meets another: the first unit stands for it, and stays if they are equal
    classes = units.groupBy("rep", "rep2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "seq")).alias("first"))
    classes = classes.join(banded.select("rep", F.lit(True).alias("meets")).distinct().hint("merge"), "rep", "left").where("times > 1 OR meets")
    classes = work.write(classes.select("rep", "rep2", "times", "first"), "classes")
    work.release()
    numbered = work.write(banded.join(classes.select("rep", F.col("first.seq").alias("node")).hint("merge"), "rep").select("bucket", F.col("node").alias("rep"), "n"), "numbered")
    work.drop(banded)
    shared, members = share_buckets(work, numbered, block_classes, block_shingles)
    work.drop(numbered)
    asked = members.select("rep").distinct().select(F.shiftright("rep", UNIT_BITS).alias("chunk"), "rep", F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("binary").alias("places"))
    both = asked.union(chunks.select("chunk", F.lit(None).cast("long"), "blob", "places"))
    texts = both.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(trimmed(showing), "rep long, text binary")
    texts = work.write(texts.withColumn("sig", F.lit(b"")), "texts")
    work.release()
    edges = class_links(work, shared, members, texts, percent, width, 0, block_classes, plain=True)
    work.drop(shared, members, texts)
    work.release()
    linked = components(work, edges)

    clustered = classes.withColumn("node", F.col("first.seq")).join(linked.hint("merge"), "node", "left").where("times > 1 OR root IS NOT NULL")
    clustered = work.write(clustered.select("rep", "rep2", "first", F.coalesce("root", "node").alias("root")), "clustered")
    work.drop(classes)
    keep = work.write(clustered.groupBy("root").agg(F.min("first").alias("keep")), "kept")
    table = work.write(clustered.join(keep, "root").select("rep", "rep2", "keep"), "keepers")
    work.drop(clustered, keep)
    return table


def paragraph_duplicates(
    spark: SparkSession, docs: DataFrame, percent: int = 80, width: int = 5, least_words: int = 1, bands: int = 6, rows: int = 2,
    block_classes: int = 128, block_shingles: int = 1 << 20, part_classes: int = 400_000, whole: bool = True, chunk_chars: int = 1 << 21,
    passage_words: int = 50, mark_words: int = 38, part_marks: int = 1_000_000, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """For each document: doc_id, n_paragraphs, n_removed, the documents that keep what is removed (keepers), n_passages_repeated."""
    if not 1 <= mark_words <= passage_words:
        raise ValueError("mark_words must be 1 to passage_words")
    work = Workspace(spark, "paragraphs", single_files=True)
    options = percent, width, bands, rows, block_classes, block_shingles, part_classes
    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    made = some.mapInArrow(trimmed(cutter(width, least_words, bands, rows, percent, whole, chunk_chars, passage_words, mark_words)), CUT)
    cut = work.write(made, "paragraphs", by="kind", batch_rows=1000)
    chunks = cut.where((F.col("kind") == HELD) & F.col("chunk").isNotNull()).select("chunk", "blob", "places")
    passages = repeated_passages(work, cut.where(F.col("kind") == MARK).select("n", "blob", "places"), part_marks)
    work.drop_part(cut, "kind", MARK)
    work.release()
    key, lost = ["rep", "rep2"], None
    units = sentences = cut.where(F.col("kind") == SENTENCE)
    if whole:
        heads = cut.where(F.col("kind") == LINE)
        table = keepers(work, heads, heads, chunks, *options)
        lost = heads.select("seq", *key).join(table.hint("merge"), key).where("keep.seq != seq").select(F.col("seq").alias("line"), F.col("keep.doc_id").alias("keeper"))
        lost = work.write(lost, "lost")
        work.drop(table)
        work.drop_part(cut, "kind", LINE)
        work.release()
        units = work.write(sentences.select("doc_id", "seq", *key, "line").join(lost.select("line").hint("merge"), "line", "left_anti").drop("line"), "staying")
        work.release()
    table = keepers(work, units, sentences, chunks, *options)
    work.release()
    gone = units.select("doc_id", "seq", *key).join(table.hint("merge"), key).where("keep.seq != seq").select("doc_id", F.lit(0).alias("n"), F.col("keep.doc_id").alias("keeper"))
    if lost is not None:
        gone = gone.union(sentences.select("doc_id", "line").join(lost.hint("merge"), "line").select("doc_id", F.lit(0), "keeper"))
    every = cut.where((F.col("kind") == HELD) & F.col("chunk").isNull()).select("doc_id", "n", F.lit(None).cast("long").alias("keeper")).union(gone)
    every = every.withColumn("passages", F.lit(0).cast("long")).union(passages.select("doc_id", F.lit(0), F.lit(None).cast("long"), "passages"))
    return every.groupBy("doc_id").agg(F.sum("n").alias("n_paragraphs"), F.count("keeper").alias("n_removed"), F.array_sort(F.collect_set("keeper")).alias("keepers"), F.sum("passages").alias("n_passages_repeated"))
