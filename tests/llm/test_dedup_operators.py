"""Near-dedup, substring and paragraph dedup, exact search and tool calls against brute force."""

import hashlib
import itertools
import json
import random
import re

import numpy as np
import pytest

pytest.importorskip("ledgerline.llm")

from ledgerline.llm.common import Workspace  # noqa: E402
from ledgerline.llm.components import components  # noqa: E402
from ledgerline.llm.knn import knn_join  # noqa: E402
from ledgerline.llm.minhash import near_duplicates, unit_links  # noqa: E402
from ledgerline.llm.paragraph_dedup import paragraph_duplicates  # noqa: E402
from ledgerline.llm.queries import QUERIES  # noqa: E402
from ledgerline.llm.shingles import Shingler, overlap  # noqa: E402
from ledgerline.llm.suffix_dedup import equal_strings, remove_repeats, slide  # noqa: E402
from ledgerline.llm.tool_calls import link  # noqa: E402

CLASH = "doc_id long, text string, rep long, bucket long, u long, v long, root long, kind int, chunk long, own int, seq long"


def clash(texts):
    return [(d, t, 1, 2, 3, 4, 5, 6, 7, 8, 9) for d, t in texts]


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def near_texts():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    say = lambda n: [word() for _ in range(n)]
    texts, n = [], 0
    for size in (7, 12, 40, 150):
        for _ in range(6):
            base = say(size)
            for _ in range(r.randint(1, 12)):
                w = list(base)
                for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                    w[r.randrange(len(w))] = word()
                if r.random() < 0.3:
                    w = w[: r.randint(1, len(w))]
                texts.append((n, r.choice([" ", "\n", "\t "]).join(w)))
                n += 1
    texts += [(n, "One two"), (n + 1, "ONE  two"), (n + 2, "a b c d"), (n + 3, None), (n + 4, ""), (n + 5, " \n "), (n + 6, " ".join(say(40_000))), (None, "one two"), (0, texts[0][1]), (0, texts[40][1]), (9, texts[30][1] + " end"), (n + 7, "É one"), (n + 8, "é one"), (n + 9, "x y z")]
    return texts


def shingles(text, width=5):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_near_duplicates_against_brute_force(spark):
    texts = near_texts()
    sets = [(d, shingles(t)) for d, t in texts]
    u = Union()
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
            u.join(a, b)
    frame = spark.createDataFrame(clash(texts), CLASH).repartition(3)
    for block in (512, 4, 2):  # one unit for each bucket, and many
        rows = near_duplicates(spark, frame, block_classes=block).collect()
        assert len(rows) == len(texts)
        for r in rows:
            d = r["doc_id"]
            if d is None:
                assert (r["component_id"], r["kept"]) == (None, True)
                continue
            assert r["n_shingles"] in {len(s) for k, s in sets if k == d}
            assert r["component_id"] == u.find(d) and r["kept"] == (u.find(d) == d)
    assert near_duplicates(spark, frame.limit(0)).count() == 0


def test_shingle_sets():
    texts = [t for _, t in near_texts()]
    got = Shingler().sets(texts)
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    for a, b in itertools.islice(itertools.combinations(range(len(texts)), 2), 0, 4000, 7):
        assert overlap(got[a], got[b]) == len(shingles(texts[a]) & shingles(texts[b]))


def test_unit_links_connect_as_all_pairs_do():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 2**60, 60, np.uint64))
    sets = [np.unique(np.where(r.random(len(base)) < 0.06, r.integers(0, 2**60, len(base), np.uint64), base)) for _ in range(60)]
    u, v = Union(), Union()
    for i, j in itertools.combinations(range(60), 2):
        both = overlap(sets[i], sets[j])
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            u.join(i, j)
    links = unit_links(np.zeros((60, 4), np.uint8), sets, 85, 0)
    assert len(links) < 60
    for i, j in links:
        v.join(i, j)
    assert [u.find(k) for k in range(60)] == [v.find(k) for k in range(60)]


def test_components_of_paths_stars_and_nothing(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(7, 7), (300, 300)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {x["node"]: x["root"] for x in components(Workspace(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: u.find(k) for k in list(u.up)}
    assert components(Workspace(spark, "t"), spark.createDataFrame([], "u long, v long")).count() == 0


# suffix dedup


def brute_repeats(rows, least=50):
    out, first = [], {}
    encoded = [(d, (t or "").encode()) for d, t in rows]
    for d, b in encoded:
        if d is not None:
            for s in range(len(b) - least + 1):
                w = b[s : s + least]
                if first.get(w, d) >= d:
                    first[w] = d
    for d, b in encoded:
        gone = bytearray(len(b))
        if d is not None:
            for s in range(len(b) - least + 1):
                if first[b[s : s + least]] < d:
                    gone[s : s + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    r = random.Random(10)
    piece = lambda n, a="abcé ": "".join(r.choice(a) for _ in range(n))
    shared = [piece(r.choice([30, 49, 50, 51, 80, 300])) for _ in range(12)]
    texts = []
    for k in range(80):
        texts.append((k, "".join(r.choice(shared) if r.random() < 0.5 else piece(r.randint(0, 60)) for _ in range(r.randint(0, 6)))))
    texts += [(90, None), (91, ""), (92, "z" * 500), (93, "z" * 300 + "y"), (94, "zy" * 100), (95, "ab" * 60), (96, "ba" * 60), (None, shared[3] * 3), (3, texts[3][1]), (-5, shared[5] + "q"), (97, piece(20_000, "ab"))]
    r.shuffle(texts)
    return texts


def test_repeats_against_brute_force(spark):
    texts = repeat_texts()
    want = sorted(brute_repeats(texts), key=str)
    frame = spark.createDataFrame(clash(texts), CLASH).repartition(3)
    for chunk, block in ((24 << 20, 2 << 20), (900, 500)):
        got = sorted((tuple(r) for r in remove_repeats(spark, frame, chunk_bytes=chunk, block_bytes=block, least_buckets=3).collect()), key=str)
        assert got == want
    assert sum(w[2] for w in want) > 1000
    assert remove_repeats(spark, frame.limit(0)).count() == 0


def test_an_anchor_with_many_surroundings_is_divided(monkeypatch):
    from ledgerline.llm import suffix_dedup as sd

    r = np.random.default_rng(40)
    least, gram, w = 50, 21, 30
    n = 100_000
    anchor = r.integers(97, 123, gram).astype(np.uint8)
    left = np.full(n, w - 1)
    body = r.integers(97, 101, (n, 2 * (w - 1) + gram)).astype(np.uint8)
    body[:, w - 1 : w - 1 + gram] = anchor
    # some share bytes on one side, others on both; many share 40 bytes that are one more common string
    pool = r.integers(97, 101, (300, w - 1)).astype(np.uint8)
    for at, much in ((0, 0.3), (w - 1 + gram, 0.3)):
        i = np.flatnonzero(r.random(n) < much)
        body[i, at : at + w - 1] = pool[r.integers(0, 300, len(i))]
    i = np.flatnonzero(r.random(n) < 0.4)
    body[i, w - 1 + gram : w - 1 + gram + 19] = pool[0][:19]
    size, starts, doc = np.full(n, body.shape[1]), np.arange(n) * body.shape[1], r.permutation(n).astype(np.int64)
    largest = []
    plain = sd.smallest
    monkeypatch.setattr(sd, "smallest", lambda b, st, sz, d, least_: largest.append(int((sz + 1).sum())) or plain(b, st, sz, d, least_))
    around = sd.Surroundings(body.reshape(-1), starts, size, left, doc, least, 1 << 18)
    around.divide(np.arange(n), 0, gram)
    assert max(largest) <= 1 << 18
    # brute force: the smallest document by string, place by place, as equal strings have the anchor in the same place
    found = around.found.reshape(n, -1)
    for k in range(found.shape[1]):
        _, of = np.unique(np.ascontiguousarray(body[:, k : k + least]).view(f"S{least}").ravel(), return_inverse=True)
        want = np.full(of.max() + 1, n)
        np.minimum.at(want, of, doc)
        assert (found[:, k] == want[of]).all()
    assert (found != doc[:, None]).mean() > 0.05


def test_interval_expansion_groups_equal_strings():
    r = random.Random(11)
    for _ in range(30):
        text = np.array([r.randint(0, 3) for _ in range(r.randint(5, 200))] + [0], np.int32)
        least = r.randint(1, 6)
        suffixes, bounds = equal_strings(text, least)
        head = lambda p: text[p : p + least].tolist()
        for j in range(1, len(text)):
            if suffixes[j] + least <= len(text) and suffixes[j - 1] + least <= len(text):
                assert bounds[j] == (head(suffixes[j]) != head(suffixes[j - 1]))


def test_sliding_minima():
    x = np.array([random.Random(k).randint(0, 99) for k in range(50)])
    for n in (1, 2, 5, 8, 30):
        assert slide(x, n, np.minimum).tolist() == [min(x[k : k + n]) for k in range(len(x) - n + 1)]


# paragraphs


def test_paragraphs_against_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    pool = [[word() for _ in range(r.randint(5, 40))] for _ in range(25)]
    texts = []
    for k in range(60):
        parts = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(pool)) if r.random() < 0.6 else [word() for _ in range(r.randint(3, 30))]
            if r.random() < 0.4:
                w[0 if r.random() < 0.5 else -1] = word()
            parts.append(" ".join(w) + r.choice([".", "!", "\n"]))
        texts.append((k, " ".join(parts)))
    texts += [(90, None), (91, ""), (92, " ".join(word() for _ in range(20_000))), (None, texts[5][1]), (7, texts[7][1])]
    units = []
    for d, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        units += [(d, x) for _, cut in own_units(t) for x, n in cut if n >= 8]
    u = Union()
    for (i, (_, x)), (j, (_, y)) in itertools.combinations(enumerate(units), 2):
        if 100 * len(x & y) >= 80 * len(x | y):
            u.join(i, j)
    want = {d: [0, 0, set()] for d, _ in texts if d is not None}
    for k, (d, _) in enumerate(units):
        want[d][0] += 1
        if u.find(k) != k:
            want[d][1] += 1
            want[d][2].add(units[u.find(k)][0])
    frame = spark.createDataFrame(clash(texts), CLASH).repartition(2)
    got = {x["doc_id"]: [x["n_paragraphs"], x["n_removed"], set(x["keepers"])] for x in paragraph_duplicates(spark, frame, least_words=8, whole=False).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 20
    assert paragraph_duplicates(spark, frame.limit(0)).count() == 0


def own_units(text):
    """Shingle sets of each line and of its sentences, by a splitter of the test's own."""
    for line in re.split(r"\n", text or ""):
        if line.strip():
            cut = re.findall(r"\S[^\n]*?[.!?](?=\s|$)|\S[^\n]*$", line.strip())
            yield shingles(line), [(shingles(x), len(x.split())) for x in cut]


def first_of_clusters(sets):
    u = Union()
    for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2):
        if 100 * len(x & y) >= 80 * len(x | y):
            u.join(i, j)
    return [u.find(k) for k in range(len(sets))]


def test_paragraphs_hold_few_texts_at_once_and_a_file_a_table_and_task(spark, monkeypatch):
    from pathlib import Path

    from ledgerline.llm import paragraph_dedup
    from ledgerline.llm.common import shared_dir

    cutter, conf = paragraph_dedup.cutter, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def watched(*options):
        run = cutter(*options)

        def few(batches):
            for batch in batches:
                if batch.num_rows > 1000:
                    raise ValueError(f"{batch.num_rows} texts at once")
                yield batch

        return lambda batches: run(few(batches))

    monkeypatch.setattr(paragraph_dedup, "cutter", watched)
    folder, before = Path(shared_dir(spark).removeprefix("file:")), spark.conf.get(conf)
    others = set(folder.glob("ledgerline-paragraphs-*"))
    frame = spark.createDataFrame([(i, f"Number {i // 2} has words. And a line of its own {i}.") for i in range(2500)], "doc_id long, text string").coalesce(1)
    got = {x["doc_id"]: (x["n_paragraphs"], x["n_removed"], x["keepers"]) for x in paragraph_duplicates(spark, frame).collect()}
    assert got == {i: (2, i % 2, [i - 1] if i % 2 else []) for i in range(2500)}
    assert spark.conf.get(conf) == before
    files = [f for d in set(folder.glob("ledgerline-paragraphs-*")) - others for f in d.rglob("*") if f.is_file()]
    assert files and {f.suffix for f in files} == {".parquet"}

    # damage is noticed without checksums in files of their own
    work = Workspace(spark, "paragraphs", single_files=True)
    table = work.write(spark.range(20_000).coalesce(1).selectExpr("xxhash64(id) AS x"), "damaged")
    (file,) = Path(work.root.removeprefix("file:")).rglob("*.parquet")
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 2] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        table.selectExpr("sum(x % 7)").collect()


def test_all_paragraphs_as_the_query_takes_them(spark, tmp_path):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    line = lambda: [[word() for _ in range(12)] for _ in range(5)]
    put = lambda x: " ".join(" ".join(s) + "." for s in x)
    pool, texts = [line() for _ in range(12)], []
    for k in range(40):
        parts = []
        for _ in range(r.randint(1, 4)):
            x = [list(s) for s in r.choice(pool)] if r.random() < 0.6 else line()
            if r.random() < 0.5:
                x[2][6] = word()  # the sentence keeps 3 of 13 shingles, its line above 0.8
            parts.append(put(x))
        parts.append(r.choice(["Read more.", "Share this page with friends", "Back to top of page!", word(), "Yes. No. Yes."]))
        texts.append((k, "\n".join(parts)))
    texts += [(50, None), (51, ""), (52, " \n . \n")]
    held = [(d, whole, [s for s, _ in cut]) for d, t in texts for whole, cut in own_units(t)]
    heads = first_of_clusters([whole for _, whole, _ in held])
    want = {d: [0, 0, set()] for d, _ in texts}
    staying = []
    for k, (d, _, cut) in enumerate(held):
        want[d][0] += len(cut)
        if heads[k] != k:
            want[d][1] += len(cut)
            want[d][2].add(held[heads[k]][0])
        else:
            staying += [(d, s) for s in cut]
    for k, first in enumerate(first_of_clusters([s for _, s in staying])):
        if first != k:
            want[staying[k][0]][1] += 1
            want[staying[k][0]][2].add(staying[first][0])
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: [x["n_paragraphs"], x["n_removed"], set(x["keepers"])] for x in QUERIES["op6_paragraphs"](spark, str(tmp_path)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 100


def test_passages_are_found_wherever_they_begin_and_end(spark):
    r = random.Random(33)
    say = lambda n: [r.choice("abcdefgh") + str(r.randrange(10**6)) for _ in range(n)]
    pool, texts = [say(n) for n in (30, 37, 50, 51, 64, 200)], []
    for k in range(90):
        w = say(r.randint(0, 150))
        for _ in range(r.randint(0, 2)):
            p = r.choice(pool)
            a = r.randint(0, len(p) - 1) if r.random() < 0.3 else 0
            w[(at := r.randint(0, len(w))) : at] = p[a:]  # in the midst of a sentence
        for at in range(r.randint(5, 60), len(w), 90):
            w[at] += r.choice([".", "\n"])
        texts.append((k, r.choice([" ", "\n"]).join(w) if k % 9 else " ".join(w).upper()))
    texts += [(100, None), (101, ""), (102, "and " * 300 + " ".join(say(20))), (103, " ".join(say(20)) + " and" * 60), (104, "or " * 49), (105, "or " * 49), (None, texts[4][1])]
    texts += [(2, texts[40][1]), (104, "or " * 49), (200, " ".join(say(3000) + pool[5] + say(2000)))]

    def strings(n):
        held = {}
        for d, t in texts:
            w = (t or "").lower().split()
            held.setdefault(d, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return {d: any(x & s for e, x in held.items() if e is not None and e < d) for d, s in held.items() if d is not None}

    frame = spark.createDataFrame(clash(texts), CLASH)
    got = []
    for parts, chunk in ((1, 1 << 21), (3, 1000)):
        rows = paragraph_duplicates(spark, frame.repartition(parts), chunk_chars=chunk, part_marks=100).collect()
        got.append({x["doc_id"]: x["n_passages_repeated"] for x in rows})
    assert got[0] == got[1]
    long, short = strings(50), strings(38)
    assert got[0].keys() == long.keys() and 20 < sum(long.values()) < 70
    assert all(got[0][d] > 0 for d in long if long[d]) and not any(got[0][d] for d in short if not short[d])


def test_keep_first_against_brute_force(spark):
    from ledgerline.llm.minhash import keep_first

    texts = near_texts()
    order = sorted({x for x in texts if x[0] is not None}, key=lambda x: (x[0], str(x[1])))
    sets = [shingles(t) for _, t in order]
    u = Union()
    for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            u.join(i, j)
    groups = {}
    for k in range(len(order)):
        groups.setdefault(u.find(k), set()).add(order[k])
    frame = spark.createDataFrame(clash(texts), CLASH).repartition(3)
    for block in (128, 3):
        out = keep_first(spark, frame, block_classes=block)
        assert out.columns == frame.columns
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        left = list(got)
        for g in groups.values():  # one of each group, and of the smallest doc_id
            [one] = [x for x in got if x in g]
            assert one[0] == min(d for d, _ in g)
            left.remove(one)
        assert left == [x for x in texts if x[0] is None]
    assert keep_first(spark, frame.limit(0)).count() == 0


def test_pipeline_near_dedup_takes_pairs_from_four_fifths(spark):
    import corpus_pipeline

    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(60):
        w = [word() for _ in range(104)]
        texts.append(" ".join(w))
        n = r.choice([8, 9, 10, 11, 12])  # 100 shingles, n of them changed at the end: J is 0.85 to 0.79
        texts.append(" ".join([*w[: 104 - n], *(word() for _ in range(n))]))
    sets = [shingles(t) for t in texts]
    found = [100 * len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(80 <= x < 85 for x in found) > 20 and any(x < 80 for x in found)
    first = first_of_clusters(sets)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert got == {k for k, x in enumerate(first) if k == x}


# exact search


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(13)
    centres = r.normal(size=(6, 8))
    v = [(k, (centres[k % 6] + 0.2 * r.normal(size=8)).astype(float).tolist(), "x", 1, 0.0) for k in range(900)]
    v += [(k, [1.0] * 8, "x", 1, 0.0) for k in range(1000, 1400)]  # one very common vector, many ties
    v += [(2000, None, "x", 1, 0.0), (2020, [1.0, None, 2.0], "x", 1, 0.0), (2040, [float("nan")] * 8, "x", 1, 0.0), (2060, [float("inf")] * 8, "x", 1, 0.0), (2080, [], "x", 1, 0.0), (2100, [1.0, -1.0], "x", 1, 0.0), (None, [1.0] * 8, "x", 1, 0.0), v[20]]
    v += [(1010, [2.0] * 8, "x", 1, 0.0), (40, v[41][1], "x", 1, 0.0)]  # ids that repeat with other vectors
    frame = spark.createDataFrame(v, "vec_id long, embedding array<double>, g string, slice int, score double")
    good = [(k, [int(np.floor(64 * x)) for x in e] + [0] * (8 - len(e))) for k, e, *_ in v if k is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    ids, m = np.array([k for k, _ in good]), np.array([e for _, e in good])
    want = []
    for at in np.flatnonzero(ids % 20 == 0):  # each row asks, and all other rows are candidates
        s = m @ m[at]
        o = [i for i in np.lexsort((ids, -s)) if i != at][:20]
        want += [(int(ids[at]), n + 1, int(ids[i]), int(s[i])) for n, i in enumerate(o)]
    for options in ({}, {"max_pivots": 7, "group_queries": 5, "slice_rows": 100}):
        assert sorted(tuple(x) for x in knn_join(spark, frame, **options).collect()) == sorted(want)
    few = knn_join(spark, frame.where("vec_id <= 3")).collect()
    assert len(few) == 3 and knn_join(spark, frame.limit(0)).count() == 0


def test_top_k_of_a_large_query_among_small_vectors(spark):
    r = np.random.default_rng(5)
    v = [(0, [2.0**40 + 1 / 64, 3.0, -(2.0**40)])] + [(k, [float(x) for x in r.integers(-9, 9, 3)]) for k in range(1, 2000)]
    rows = knn_join(spark, spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(4), slice_rows=300, group_queries=50).where("query_id = 0").collect()
    ints = [(k, [int(np.floor(64 * x)) for x in e]) for k, e in v]
    best = sorted((-sum(a * b for a, b in zip(ints[0][1], e, strict=True)), k) for k, e in ints[1:])[:20]
    assert sorted((x["rank"], x["vec_id"], x["score"]) for x in rows) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]


def test_top_k_of_large_numbers(spark):
    v = [(k, [float(k % 7 - 3) * 2**22, float(k)]) for k in range(40)]
    rows = knn_join(spark, spark.createDataFrame(v, "vec_id long, embedding array<double>"), k=3).collect()
    ints = {k: [int(np.floor(64 * x)) for x in e] for k, e in v}
    for q in (0, 20):
        best = sorted(((-(ints[q][0] * e[0] + ints[q][1] * e[1]), k) for k, e in ints.items() if k != q))[:3]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]


# tool calls


def calls(*entries):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), e, strict=True)) for e in entries]})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", calls(("a", "search", {"query": "x", "limit": 3}), ("b", "calculate", {"expression": "$a"}))),
        (1, 2, "tool", result("a")), (1, 3, "tool", result("b", "4")), (1, 4, "tool", result("a", "again")), (1, 5, "assistant", calls(("a", "fetch", {}))),
        (2, 0, "assistant", calls(("c", "convert", {"value": "5", "unit": 7, "extra": 1}), ("d", "unknown", {}), ("e", "search", [1]))),
        (2, 1, "assistant", calls(("x", "search", {"query": "$y"}), ("y", "search", {"query": "$x"}), ("z", "search", {"query": "$nope"}), ("w", "search", {"query": "$later"}))),
        (2, 2, "assistant", calls(("later", "search", {"query": "q"}))), (2, 3, "tool", result("missing")), (3, 0, "assistant", "{not json"), (3, 1, None, None), (3, 2, "tool", "plain"), (None, 0, "tool", result("a")), (4, None, "assistant", calls(("a", "fetch", {"url": "u"}))),
        (1, 0, "user", "hello"), (5, 0, "assistant", json.dumps({"tool_call": {"id": "s", "name": "fetch", "arguments": {"url": "u", "a": 1}}})), (5, 1, "assistant", ""), (5, 2, "user", "{" + "x" * 100_000),
    ]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, depth int")
    out = link(spark, frame).collect()
    assert len(out) == len(rows) + 6
    by = {(r["conv_id"], r["call_id"], r["kind"], r["turn"]): r for r in out}
    a, b = by[1, "a", "call", 1], by[1, "b", "call", 1]
    assert (a["link_turn"], a["depth"], a["valid"], a["errors"]) == (2, 0, True, []) and (b["link_turn"], b["depth"], b["valid"]) == (3, 1, True)
    assert a["json"] == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","result_turn":2,"role":"assistant","turn":1}'
    assert by[1, "a", "result", 2]["link_turn"] == 1 and by[1, "a", "result", 2]["linked"] and not by[1, "a", "result", 4]["linked"]
    assert by[1, "a", "call", 5]["errors"] == ["missing:url", "duplicate_id"] and not by[1, "a", "call", 5]["linked"]
    assert by[2, "c", "call", 0]["errors"] == ["type:unit", "type:value", "unknown:extra"] and by[2, "c", "call", 0]["valid"] is False
    assert by[2, "d", "call", 0]["valid"] is None and by[2, "e", "call", 0]["errors"] == ["arguments_not_object"]
    assert by[2, "x", "call", 1]["errors"] == ["cycle"] == by[2, "y", "call", 1]["errors"] and by[2, "x", "call", 1]["depth"] is None
    assert by[2, "z", "call", 1]["errors"] == ["unknown_reference"] and by[2, "w", "call", 1]["errors"] == ["later_reference"]
    assert not by[2, "missing", "result", 3]["linked"] and not by[None, "a", "result", 0]["linked"] and by[5, "s", "call", 0]["valid"] is False
    assert sum(r["kind"] == "message" for r in out) == 7
    for r in out:
        if r["json"]:
            assert json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]
    assert link(spark, frame.limit(0)).count() == 0


def test_tool_call_chains(spark):
    n = 6
    rows = [(1, k, "assistant", calls((f"c{k}", "search", {"query": f"$c{k - 1}" if k else "go"}))) for k in range(n)]
    out = link(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["turn"], r["depth"]) for r in out) == [(k, k) for k in range(n)]


def test_tool_call_entries_and_canonical_json(spark):
    entries = [
        {"id": "a", "name": "search", "arguments": {"query": "x", "limit": 2}}, {"id": 5, "name": "fetch", "arguments": {"url": "u"}}, "junk",
        {"id": {"q": 1}, "name": "x"}, None, {"name": "search", "arguments": {"z": [1, {"d": None, "c": True}], "b": 1.5}}, [1],
    ]
    contents = [{"z": 1, "a": {"y": None, "b": [2]}}, "4", 4, None, [], True, "é \" \\ \n"]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": entries}))] + [(1, k + 1, "tool", json.dumps({"tool_call_id": "a" if k else 5, "content": c})) for k, c in enumerate(contents)]
    rows += [(1, 50, "tool", json.dumps({"tool_call_id": "a"})), (1, 51, "assistant", '{"tool_calls": []}'), (1, 52, "assistant", '{"a": 1, "a": 2}'), (1, 53, "tool", '{"tool_call_id": null, "content": 1}')]
    out = {(r["turn"], r["call_no"]): r for r in link(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(out) == len(entries) + len(contents) + 4
    for k, e in enumerate(entries):
        r, good = out[0, k], k < 2
        assert r["kind"] == "call" and r["valid"] is good and (r["errors"] == []) is good and r["linked"] is good
        want = e if isinstance(e, dict) else {}
        name_of = lambda x: x if x is None or isinstance(x, str) else str(x) if not isinstance(x, dict) else None
        whole = {"arguments": want.get("arguments"), "id": name_of(want.get("id")), "name": want.get("name"), "result_turn": r["link_turn"], "role": "assistant", "turn": 0}
        assert r["json"] == json.dumps(whole, sort_keys=True, separators=(",", ":"))
    assert (out[0, 0]["link_turn"], out[0, 1]["link_turn"]) == (2, 1)
    for k, c in enumerate([*contents]):
        r = out[k + 1, None]
        whole = {"call_turn": r["link_turn"], "content": c, "role": "tool", "tool_call_id": "a" if k else "5", "turn": k + 1}
        assert r["json"] == json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(out[50, None]["json"])["content"] is None
    assert [out[k, None]["kind"] for k in (51, 52, 53)] == ["message"] * 3


def brute_calls(rows):
    """Link, depth and graph errors of each call and result, by loops over one conversation at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        first, results, every = {}, {}, []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            x = json.loads(text)
            for k, c in enumerate(x.get("tool_calls", ())):
                every.append((turn, k, c["id"], c["arguments"]))
                first.setdefault(c["id"], (turn, k, c["arguments"]))
            if role == "tool":
                results.setdefault(x["tool_call_id"], []).append(turn)
        needs = {i: {v[1:] for v in a.values() if v.startswith("$")} for i, (_, _, a) in first.items()}
        depth = {}
        while True:
            ready = [i for i in first if i not in depth and all(n in depth for n in needs[i] if n in first)]
            if not ready:
                break
            depth |= {i: 1 + max((depth[n] for n in needs[i] if n in first), default=-1) for i in ready}
        taken = {i: min((t for t in ts if i in first and t >= first[i][0]), default=None) for i, ts in results.items()}
        for turn, k, i, _ in every:
            if first[i][:2] != (turn, k):
                out[conv, turn, k] = (None, None, ["duplicate_id"])
                continue
            faults = sorted({"unknown_reference" if n not in first else "later_reference" for n in needs[i] if n not in first or first[n][0] > turn})
            out[conv, turn, k] = (taken.get(i), depth.get(i), faults + ([] if i in depth else ["cycle"]))
        for i, ts in results.items():
            for t in ts:
                out[conv, t, None] = (first[i][0] if taken[i] == t else None, None, [])
    return out


def test_tool_calls_of_generated_graphs_against_brute_force(spark):
    r = random.Random(31)
    rows = []
    for conv in range(14):
        ids, turn = [], 0
        for _ in range(r.randint(1, 14)):
            entries = []
            for _ in range(r.randint(0, 6)):
                i = f"c{r.randint(0, 60)}"
                near = [*ids[-6:], *(e[0] for e in entries), i if r.random() < 0.1 else "nope" if r.random() < 0.1 else f"c{r.randint(0, 60)}"]
                entries.append((i, "other", {f"p{k}": "$" + r.choice(near) if r.random() < 0.7 else "text" for k in range(r.randint(0, 3))}))
            rows.append((conv, turn, "assistant", calls(*entries)))
            ids += [e[0] for e in entries]
            turn += 1
            for i in r.sample(ids, min(len(ids), r.randint(0, 3))) + (["none"] if r.random() < 0.2 else []):
                rows.append((conv, turn, "tool", result(i)))
                turn += 1
    chain = [(f"x{k}", "other", {"p": f"$x{k - 1}"} if k else {}) for k in range(70)]  # one message, a chain of 70 in mixed order
    r.shuffle(chain)
    rows += [(100, 0, "assistant", calls(*chain)), (100, 1, "assistant", calls(("y", "other", {"a": "$x69", "b": "$z"}), ("z", "other", {"a": "$y"}), ("w", "other", {"a": "$z"}), ("v", "other", {"a": "$v"})))]
    want = brute_calls(rows)
    out = link(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).where("kind != 'message'").collect()
    got = {(x["conv_id"], x["turn"], x["call_no"]): (x["link_turn"], x["depth"], x["errors"]) for x in out}
    assert got == want and len(out) == len(want)
    found = [e for *_, errors in want.values() for e in errors]
    assert {"cycle", "duplicate_id", "unknown_reference", "later_reference"} <= set(found) and max(d or 0 for _, d, _ in want.values()) == 69
