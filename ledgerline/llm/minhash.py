"""Operator 10: MinHash near-dedup.

Texts become sets of word shingles; rows with equal sets are one class, known by the number of one of its rows. Many
universal hash minima of each set are cut into bands, and the classes of a band's bucket are candidates. Pairs are
checked first on signatures (the low 8 bits of each minimum), then on full shingle sets, and components come from
alternating large-star and small-star.

Buckets that hold the same classes are one. No bucket is capped. A bucket is dealt to blocks bounded in classes and
shingles, and a few of its classes, drawn by hash, are put into each block as well; a block is checked as one unit, so
the work is linear in the bucket. For buckets of several blocks a second pass takes the components that came of it:
classes of the bucket's largest component need not be compared with each other, and the others meet all blocks, in
units of two blocks at most. Within a unit a class is compared with all others at once, those connected so far are
passed over, and only the links that connect anew are given out: no pairs are emitted, and every pair of a bucket was
either checked or is connected otherwise.

With 24 bands of 6 rows, a pair at Jaccard 0.85 shares no bucket with a chance of 1.2e-5, one at 0.9 with 1.3e-8. A
signature is refused only if its estimate is 5 standard deviations below the threshold.

Defined results: null and blank texts have no shingles and are linked with nothing. Rows with a null doc_id are linked
with nothing, have a null component and are kept. Rows that repeat a doc_id are one document of several texts: each gets
a row, and a link of one is a link of all. Other columns are ignored. An empty table gives no rows. A text is held by
one task at a time, whole. keep_first() works on texts and not on documents; see there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Workspace, trimmed
from ledgerline.llm.components import components

SIGNED = "doc_id long, text_key long, row long, n_shingles long, set_key binary, buckets array<long>, sig binary, text binary"
#: Classes of a bucket that are put into each of its blocks.
CENTRES = 4
SPREAD = 16


def signer(bands: int, rows: int, width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash
        import zstandard
        from pyspark import TaskContext

        from ledgerline.llm.common import by_bytes
        from ledgerline.llm.shingles import Minima, Shingler

        seq = TaskContext.get().partitionId() << 40
        shingler, minima, press = Shingler(width), Minima(bands, rows), zstandard.ZstdCompressor(1)
        for batch in batches:
            lengths = pc.utf8_length(batch.column(1)).to_pylist()
            for a, b in by_bytes([range(n or 0) for n in lengths], 2_000_000):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                sets = shingler.sets(texts)
                sigs = [minima.signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(range(seq, seq + b - a), pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([minima.buckets(s) if s is not None else None for s in sigs], pa.list_(pa.int64())),
                        pa.array([s.astype("uint8").tobytes() if s is not None else None for s in sigs], pa.binary()),
                        pa.array([press.compress(t.encode("utf-8", "surrogatepass")) if len(s) else None for t, s in zip(texts, sets, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "row", "n_shingles", "set_key", "buckets", "sig", "text"],
                )
                seq += b - a

    return run


def unit_links(sigs, sets, percent: int, least_equal: int, roots=None) -> list[tuple[int, int]]:
    """Links that connect the members of a unit as all its links do, by place; members of one root are connected already."""
    import numpy as np

    n = len(sets)
    root = np.arange(n) if roots is None else np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    found = []
    if n * len(values) <= 4_000_000:  # all intersections at once
        held = np.zeros((n, len(values)), np.float32)
        held[np.repeat(np.arange(n), sizes), flat] = 1
        both = held @ held.T
        linked = np.triu(100 * both >= percent * (sizes[:, None] + sizes - both), 1) & (root[:, None] != root)
        if sigs.shape[1]:
            linked &= (sigs[:, None] == sigs).sum(2) >= least_equal
        for i, j in np.argwhere(linked).tolist():
            if root[i] != root[j]:
                found.append((i, j))
                root[root == root[j]] = root[i]
        return found
    mark = np.zeros(len(values), np.int8)
    for i in range(n):
        others = np.flatnonzero(root != root[i])
        others = others[others > i]
        if len(others):
            # sizes bound the Jaccard index: the smaller set has at least the threshold's share of the larger
            fits = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
            others = others[fits]
            others = others[(sigs[others] == sigs[i]).sum(1) >= least_equal]
        if not len(others):
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = 1
        for j in others.tolist():
            if root[j] == root[i]:
                continue
            both = int(mark[flat[starts[j] : starts[j + 1]]].sum(dtype=np.int64))
            if 100 * both >= percent * (int(sizes[i]) + int(sizes[j]) - both):
                found.append((i, j))
                root[root == root[j]] = root[i]
        mark[own] = 0
    return found


def checker(width: int, percent: int, least_equal: int, plain: bool = False):
    """Links of the units in a partition that is sorted by unit."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        from ledgerline.llm.shingles import Shingler

        shingler, unpress = Shingler(width), zstandard.ZstdDecompressor()
        at, held = None, []

        def solved():
            if len({root for _, root, _, _ in held}) < 2:
                return
            sets = []
            for k in range(0, len(held), 64):
                sets += shingler.sets([(t if plain else unpress.decompress(t)).decode("utf-8", "surrogatepass") for *_, t in held[k : k + 64]])
            sigs = np.frombuffer(b"".join(s for _, _, s, _ in held), np.uint8).reshape(len(held), -1)
            pairs = unit_links(sigs, sets, percent, least_equal, np.array([r for _, r, _, _ in held]))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in pairs], pa.int64()), pa.array([held[j][0] for _, j in pairs], pa.int64())], names=["u", "v"])

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                for *unit, rep, root, sig, text in zip(*(c.to_pylist() for c in batch.slice(a, 500).columns), strict=True):
                    if unit != at:
                        yield from solved()
                        at, held = unit, []
                    if not held or held[-1][0] != rep:
                        held.append((rep, root, sig, text))
        yield from solved()

    return run


def share_buckets(work: Workspace, banded: DataFrame, block_classes: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Buckets of several classes, one of those that hold the same: bucket, blocks, centres; and their members: bucket, rep, blocks.

    banded: bucket, rep and n (size of its set), once for each class of a bucket.
    """
    whole = F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("whole")
    drawn = [F.min_by("rep", F.xxhash64("rep", F.lit(100 + k))).alias(f"c{k}") for k in range(CENTRES)]
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.min("rep").alias("least"), whole, *drawn).where("m > 1")
    shared = shared.groupBy("m", "n", "least", "whole", *[f"c{k}" for k in range(CENTRES)]).agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("m") / block_classes), F.ceil(F.col("n") / block_shingles)).cast("int")
    shared = work.write(shared.select("bucket", blocks.alias("blocks"), F.array_distinct(F.array(*[f"c{k}" for k in range(CENTRES)])).alias("centres")), "shared")
    members = work.write(banded.join(shared.select("bucket", "blocks").hint("merge"), "bucket").select("bucket", "rep", "blocks"), "members")
    return shared, members


def class_links(
    work: Workspace, shared: DataFrame, members: DataFrame, texts: DataFrame, percent: int, width: int, n_minima: int, block_classes: int, plain: bool = False,
) -> DataFrame:
    """Links (u, v) that connect the classes of every bucket as all its pairs at the threshold do.

    shared, members: as share_buckets gives them; texts: rep, sig and compressed text of each class at least, or with
    plain a written table of the members' texts as they are. Without minima nothing is checked on signatures.
    """
    asked = members.select("rep").distinct()
    payload = texts if plain else work.write(texts.select("rep", "sig", "text").join(asked.hint("merge"), "rep", "left_semi"), "payload")
    s = percent / 100
    agree = s + (1 - s) / 256
    least_equal = max(0, int(n_minima * agree - 5 * (n_minima * agree * (1 - agree)) ** 0.5))

    def checked(units: DataFrame, label: str) -> DataFrame:
        full = units.join(payload.hint("merge"), "rep").select("bucket", "i", "j", "rep", "root", "sig", "text")
        dealt = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")
        return work.write(dealt.mapInArrow(trimmed(checker(width, percent, least_equal, plain)), "u long, v long"), label)

    def block(n: str, salt: int):
        return F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")

    none = F.lit(0)
    own = members.select("bucket", none.alias("i"), block("blocks", 7).alias("j"), "rep")
    several = shared.where("blocks > 1")
    centres = several.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "centres").select("bucket", none.alias("i"), "j", F.explode("centres").alias("rep"))
    edges = checked(own.union(centres).withColumn("root", F.col("rep")), "links")
    if several.isEmpty():
        work.drop(payload)
        return edges

    # the second pass: rest are the classes out of their bucket's largest component
    linked = components(work, edges)
    placed = members.where("blocks > 1").join(linked.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    placed = work.write(placed, "placed")
    largest = placed.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.col("count")).alias("largest"), F.max("count").alias("n_main"), F.sum("count").alias("n_all"))
    largest = largest.where("n_all > n_main").select("bucket", "largest", F.ceil((F.col("n_all") - F.col("n_main")) / block_classes).cast("int").alias("p"), F.ceil(F.col("n_main") / block_classes).cast("int").alias("q"))
    # a bucket's members are spread over tasks, and so its line of facts is repeated
    spread = F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(SPREAD)).cast("int")
    largest = largest.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    open_ = placed.withColumn("spread", spread).join(largest, ["bucket", "spread"])
    rest = open_.where("root != largest").withColumn("own", block("p", 11))
    each = F.explode(F.sequence(F.lit(0), F.col("p") + F.col("q") - 1)).alias("other")
    rest = rest.select("bucket", "rep", "root", "own", each).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "root")
    main = open_.where("root = largest").withColumn("own", F.col("p") + block("q", 13))
    main = main.select("bucket", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), F.col("own").alias("j"), "rep", "root")
    more = checked(rest.union(main), "more-links")
    work.drop(payload, placed)
    return edges.union(more)


class Signed:
    """Rows with signatures, classes (set_key, node, least doc_id) and the links between classes."""

    def __init__(self, spark: SparkSession, docs: DataFrame, percent: int, width: int, bands: int, rows: int, block_classes: int, block_shingles: int, doc_id: str, text: str):
        work = self.work = Workspace(spark, "minhash")
        t = F.col(text).cast("string")
        some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("text_key"))
        self.rows = work.write(some.mapInArrow(trimmed(signer(bands, rows, width)), SIGNED), "signed")
        linkable = self.linkable = self.rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        self.classes = work.write(linkable.groupBy("set_key").agg(F.min_by("row", "doc_id").alias("node"), F.min("doc_id").alias("least")), "classes")
        banded = linkable.select("row", "n_shingles", "buckets").join(self.classes.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi")
        banded = work.write(banded.select(F.explode("buckets").alias("bucket"), F.col("row").alias("rep"), F.col("n_shingles").alias("n")), "banded")
        shared, members = share_buckets(work, banded, block_classes, block_shingles)
        work.drop(banded)
        self.edges = class_links(work, shared, members, linkable.withColumnRenamed("row", "rep"), percent, width, bands * rows, block_classes)
        work.drop(shared, members)


def near_duplicates(
    spark: SparkSession, docs: DataFrame, percent: int = 85, width: int = 5, bands: int = 24, rows: int = 6,
    block_classes: int = 128, block_shingles: int = 1 << 20, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row; see the module's docstring."""
    signed = Signed(spark, docs, percent, width, bands, rows, block_classes, block_shingles, doc_id, text)
    work, linkable, classes = signed.work, signed.linkable, signed.classes
    # a document of several texts links them
    several = linkable.groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("a"), F.max(F.xxhash64("set_key")).alias("b")).where("a != b").select("doc_id")
    texts = linkable.select("doc_id", "set_key").join(several, "doc_id").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node")
    texts = work.write(texts, "documents-of-several-texts")
    same = texts.join(texts.groupBy("doc_id").agg(F.min("node").alias("v")), "doc_id").select(F.col("node").alias("u"), "v")
    linked = components(work, signed.edges.union(same))

    known = work.write(linked.join(classes.select("node", "least"), "node"), "linked")
    least = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    named = classes.join(least, "node", "left").select("set_key", F.coalesce("component_id", "least").alias("component_id"))
    named = work.write(named, "class-components")
    head = linkable.select("doc_id", "n_shingles", "set_key").join(named.hint("merge"), "set_key").select("doc_id", "n_shingles", "component_id")
    rest = signed.rows.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return head.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(
    spark: SparkSession, docs: DataFrame, percent: int = 80, width: int = 5, bands: int = 30, rows: int = 5,
    block_classes: int = 128, block_shingles: int = 1 << 20, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of docs, with all their columns, of which no near copy comes before: one row of each component of texts.

    It is that of the smallest doc_id, among those that of the smallest set_key and text_key. Rows that repeat a doc_id
    with other texts are texts of their own; rows equal in both doc_id and text count once. Rows without a doc_id and, but
    for such repetitions, texts without words stay. 30 bands of 5 miss a pair at Jaccard 0.8 with a chance of 7e-6.
    """
    signed = Signed(spark, docs, percent, width, bands, rows, block_classes, block_shingles, doc_id, text)
    work, linkable, classes = signed.work, signed.linkable, signed.classes
    linked = work.write(components(work, signed.edges).join(classes, "node"), "linked")
    winners = linked.groupBy("root").agg(F.min(F.struct("least", "set_key", "node")).alias("first")).select(F.col("first.node").alias("node"))
    losers = linked.select("node").join(winners, "node", "left_anti")
    staying = classes.join(losers, "node", "left_anti").select("set_key", "least")
    first = linkable.select("doc_id", "text_key", "set_key").join(staying.hint("merge"), "set_key").where("doc_id = least")
    first = first.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key")).select("doc_id", "text_key")
    blank = signed.rows.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id", "text_key")
    kept = work.write(first.union(blank), "kept")
    # the row is kept apart, so that no column of docs can clash with the ones made here
    rows_ = docs.select(F.struct("*").alias("_row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"))
    one = rows_.where("doc_id IS NOT NULL").join(kept.hint("merge"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return one.union(rows_.where("doc_id IS NULL").select(*one.columns)).select("_row.*")
