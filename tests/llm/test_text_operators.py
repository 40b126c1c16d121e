"""Toxicity, licences, packing, personal data, decontamination and the pipeline, against brute force and round trips."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("ledgerline.llm")

from ledgerline.llm import decontaminate, licenses, pii, toxicity  # noqa: E402
from ledgerline.llm.packing import Block, WordTokenizer, pack, step_groups  # noqa: E402

SF = "/root/testdata/sf0.01"
has_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty, blank, very long, repeated rows, and columns that clash with the operators' own names.
CLASH = "doc_id long, text string, _t string, _base int, _all int, rep long, bucket long, score double, toxic int, label int, at int"


def clash_rows(texts):
    return [(d, t, "x", 1, 2, 3, 4, 0.5, 1, 0, 7) for d, t in texts]


# packing


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def check_packing(rows, ids_of, window=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids_of[doc])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids_of[doc][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids_of[doc])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    assert set(by_doc) == set(ids_of)


def test_packing_round_trip(spark, tokenizer_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path)
    r = random.Random(5)
    texts = {k: " ".join(r.choice("alpha Beta gamma, délta 42 x! <|endoftext|> 日本".split()) for _ in range(r.choice([0, 1, 5, 90, 700, 3000, 9000]))) for k in range(60)}
    texts[60], texts[61] = None, "y" * 50_000
    df = spark.createDataFrame(clash_rows(texts.items()), CLASH).repartition(3)
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    check_packing(pack(df).collect(), ids)
    check_packing(pack(df, block_tokens=3000).collect(), ids)


def test_packing_of_nothing(spark):
    assert pack(spark.createDataFrame([], DOCS)).count() == 0
    twice = pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in twice) == [("1", 2), ("1", 2), ("None", 2)]


def test_tokenizer_cache_is_exact(tokenizer_path):
    t = WordTokenizer(tokenizer_path, cache_size=50)
    r = random.Random(1)
    alphabet = "aB 'sé\n1_.日́ÀẞµÿŸ-<|>\t\x85\x01"
    texts = ["".join(r.choice(alphabet) for _ in range(60)) for _ in range(800)]
    assert t.encode(texts) == [t.whole(x) for x in texts]


def test_blocks_fill_every_sequence():
    r = random.Random(2)
    b = Block(64, 8)
    sizes = [r.randint(0, 200) for _ in range(300)]
    for i, n in enumerate(sizes):
        b.add(i, n)
    seqs = b.pack()
    assert sum(n for n, _ in seqs) == sum(sizes) and all(n & (n - 1) == 0 and n == sum(p[0] for p in ps) for n, ps in seqs)
    assert sum(n < 8 for n, _ in seqs) <= 3
    groups = step_groups([n for n, _ in seqs], 640)
    cost = {}
    for g, (n, _) in zip(groups, seqs, strict=True):
        cost[g] = cost.get(g, 0) + n * n
    assert max(cost.values()) - min(cost.values()) <= 64 * 64
    # few long sequences and many short ones: even cost alone would put nearly all short ones into few groups
    sizes = [2048] * 40 + [256] * 4000
    held = {}
    for g, n in zip(step_groups(sizes, 65_536), sizes, strict=True):
        held[g] = held.get(g, 0) + n
    assert sum(held.values()) == sum(sizes) and max(held.values()) <= 1.25 * 65_536


# toxicity


@pytest.fixture(scope="module")
def prose():
    r = random.Random(3)
    words = ["idiot", "stupid", "clown", "the", "thing", "ring", "and", "that", "of", "stone", "listen", "moral", "doing", "trash", "rose", "loses", "soap"]
    return " ".join(r.choice(words) for _ in range(20_000))


@pytest.mark.parametrize(
    ("noisy", "clear"),
    [("you 1d10t", "idiot"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("idiiiiiot", "idiot"), ("tr@sh!", "trash"), ("c l 0 w n", "clown"), ("$tup1d", "stupid"), ("CLOOOOWN", "clown"),
     ("idio7", "idiot"), ("5tone", "stone"), ("i - d - i - o - t", "idiot"), ("c  l  o  w  n", "clown"), ("stu-pid", "stupid"), ("id_iot", "idiot"), ("iidiioott", "idiot"), ("d01ng", "doing"),
     ("іdіоt", "idiot"), ("ѕtuріd", "stupid"), ("ｉｄｉｏｔ", "idiot"), ("𝐜𝐥𝐨𝐰𝐧", "clown"), ("r o s e", "rose"), ("tra$$h", "trash")],
)
def test_obfuscation_is_undone(prose, noisy, clear):
    f = toxicity.Features(toxicity.LanguageModel(*toxicity.added([toxicity.trigrams(prose)])))
    assert clear in f.words([noisy])[0][0]


def test_long_runs_of_pieces_are_restored(prose):
    f = toxicity.Features(toxicity.LanguageModel(*toxicity.added([toxicity.trigrams(prose)])))
    for noisy, clear in (("sto.ne-" * 9 + "stu.pid", "stupid"), ("clo-wn/" * 300 + "idi_ot", "idiot")):
        words, n = f.words(["plain " + noisy + " words"])[0]
        assert len(noisy) > 64 and n == 1 and clear in words


def test_viterbi_finds_the_best_of_all_paths(prose):
    model = toxicity.LanguageModel(*toxicity.added([toxicity.trigrams(prose)]))
    decoder = toxicity.Decoder(model)
    r = random.Random(17)

    def score(path):
        x, y, p = 0, 0, sum(cost for _, cost in path)
        for c in "".join(t for t, _ in path):
            z = toxicity.code_of(c)
            p += model(x, y, z)
            x, y = (0 if z == 0 else y), z
        return p + model(x, y, 0)

    for _ in range(150):
        span = "".join(r.choice("idotscln10$!*.- iiéзо") for _ in range(r.randint(1, 7)))
        lattice = decoder.lattice(span, r.random() < 0.5)
        paths = list(itertools.product(*lattice))
        if len(paths) <= 20_000:
            best, text = decoder.best(lattice)
            assert abs(best - max(map(score, paths))) < 1e-9
            assert any("".join(t for t, _ in p) == text and abs(score(p) - best) < 1e-9 for p in paths)


def test_trigrams_are_counted_by_character():
    text = "ab é ябя 7x 42 ßa\n\nab — 漢字"
    keys, n = toxicity.added([toxicity.trigrams(text, 5), toxicity.trigrams("ab", 5)])
    want = {}
    for t in (text, "ab"):
        c = [0, 0, *(0 if not (x.isalnum()) else ord("0") if x.isdecimal() else ord(x) for x in t), 0]
        for k in range(len(c) - 2):
            a, b, d = c[k : k + 3]
            key = (a if b else 0) << 42 | b << 21 | d
            want[key] = want.get(key, 0) + 1
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == want
    model = toxicity.LanguageModel(keys, n)
    some = [0, ord("a"), ord("b"), ord("я"), ord("0"), ord("漢")]
    for a, b in itertools.product(some, some):
        assert sum(math.exp(model(a, b, c)) for c in model.k1.tolist()) <= 1 + 1e-9


def test_rows_that_repeat_a_labelled_document_count_once(spark):
    texts = [(k, "you idiot" if k % 3 == 0 else "a kind day") for k in range(90)]
    docs = spark.createDataFrame(texts + [(3, "you idiot")] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)], "doc_id long, toxic int")
    a = {(r["doc_id"], round(r["score"], 9)) for r in toxicity.toxicity(spark, docs, labels).where("doc_id < 50").collect()}
    assert len(a) == 50 and all((s >= 0.5) == (k % 3 == 0) for k, s in a)


def test_scores_do_not_depend_on_the_bound_of_the_model(spark):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(["the", "thing", "ring", "stone", "moral", "мир", "слово", "漢字", "kind"]) for _ in range(n))
    noisy = ["you 1d10t", "s.t.u.p.i.d", "с1ово", "tr@sh!", "c l 0 w n", "漢3字", "ѕtuріd", "5tone m0ral", "th1ng"]
    texts = [(k, say(20) + (" idiot stupid clown trash " if k % 3 == 0 else " ") + r.choice(noisy) + " " + r.choice(noisy)) for k in range(120)]
    frame = spark.createDataFrame(clash_rows(texts + [(None, "i d i o t"), (300, None), (301, "")]), CLASH)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    key = lambda x: (x["doc_id"] is None, x["doc_id"])
    whole = sorted(toxicity.toxicity(spark, frame, labels).collect(), key=key)
    kept = sorted(toxicity.keep_clean(spark, frame, labels).collect(), key=key)
    assert sum(x["n_restored"] for x in whole) > 100 and 0 < len(kept) < len(whole)
    for bound in (40, 0):
        assert sorted(toxicity.toxicity(spark, frame, labels, model_trigrams=bound).collect(), key=key) == whole
    assert sorted(toxicity.keep_clean(spark, frame, labels, model_trigrams=40).collect(), key=key) == kept


def test_plain_text_is_left_alone(prose):
    f = toxicity.Features(toxicity.LanguageModel(*toxicity.added([toxicity.trigrams(prose)])))
    assert [n for _, n in f.words(["Plain words, a 1999 price of $5 and more.", "", None, "I a b"])] == [0, 0, 0, 0]


def test_toxicity_edge_cases(spark):
    texts = [(k, ("you idiot fool here " if k % 3 == 0 else "a fine kind day ") + f"w{k % 7}") for k in range(200)]
    texts += [(None, "you idiot fool here"), (500, None), (501, ""), (502, "kind " * 60_000), (3, texts[3][1]), (600, "you 1 d 1 0 t here")]
    docs = spark.createDataFrame(clash_rows(texts), CLASH)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(spark, docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None and r["doc_id"] < 200:
            assert r["predicted"] == int(r["doc_id"] % 3 == 0)
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["predicted"] == 1 and by[600]["predicted"] == 1 and by[600]["n_restored"] == 1
    kept = toxicity.keep_clean(spark, docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 - r["predicted"] for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 1e-6 for r in toxicity.toxicity(spark, docs, none).collect())
    assert toxicity.toxicity(spark, docs.limit(0), labels).count() == 0


@has_data
def test_toxicity_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = toxicity.toxicity(spark, docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    clean = [r for r in rows if not r["toxic"]]
    toxic = [r for r in rows if r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    pairs = sum(a["score"] > b["score"] for a in toxic for b in clean)
    assert pairs >= 0.97 * len(toxic) * len(clean)


# licences


def brute_licenses(text, templates, share):
    words = licenses.template_words(text or "")
    has = lambda n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    out = {}
    for name, t in templates.items():
        w = licenses.template_words(t)
        n = min(5, len(w))
        need = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        c = len(need & has(n)) / len(need)
        if c >= share:
            out[name] = c
    return out


def test_licenses_against_brute_force(spark):
    r = random.Random(4)
    filler = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet license of the work permission".split()) for _ in range(n))
    texts = []
    for k, (_, t) in enumerate(list(licenses.TEMPLATES.items()) * 3):
        w = t.split()
        if k % 3 == 1:
            w[-1] = "changed"
        texts.append((k, f"{filler(r.randint(0, 300))} {' '.join(w).upper() if k % 2 else ' '.join(w)}. {filler(r.randint(0, 50))}"))
    texts += [(100, None), (101, ""), (102, "license"), (103, filler(30_000)), (None, "Licensed under CC BY-NC 4.0"), (0, texts[0][1])]
    got = {}
    for x in licenses.scan(spark, spark.createDataFrame(clash_rows(texts), CLASH)).collect():
        got[x["doc_id"], x["license"]] = x["containment"]
    want = {(d, name): c for d, t in texts for name, c in brute_licenses(t, licenses.TEMPLATES, 0.8).items()}
    assert set(got) == set(want) and len(want) > 30
    assert licenses.scan(spark, spark.createDataFrame([], DOCS)).count() == 0
    assert licenses.scan(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), {}).count() == 0


def test_licenses_without_broadcasts(spark):
    texts = [(k, f"word {t} more") for k, t in enumerate(licenses.TEMPLATES.values())]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    a, b = (sorted(map(str, licenses.scan(spark, docs, best_only=True, broadcast_shingles=n).collect())) for n in (100_000, 0))
    assert a == b and len(a) >= len(texts)


def test_license_gate_loses_nothing():
    words = {k: licenses.template_words(t) for k, t in licenses.TEMPLATES.items()}
    gate = re.compile(licenses.gate(words, 0.8, 5).replace("(?iu)", "").replace(r"\p{L}\p{N}", r"\w"), re.I)
    for w in words.values():
        need = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        for drop in set(w):
            left = [x for x in w if x != drop]
            have = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if drop not in w[k : k + 5]}
            if len(have) >= 0.8 * len(need):
                assert gate.search(" ".join(left))


#: Notices as projects put them into their files, written without the templates at hand.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Released under the terms of the MIT license.", "// Licensed under the MIT License"],
    "All-rights-reserved": ["Copyright (c) 2019 Example Corp. All rights reserved.", "ALL RIGHTS RESERVED"],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC0-1.0": ["To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
}


def test_licenses_of_notices_as_they_are_found(spark):
    texts = [(kind, f"some words before it\n{t}\nand some after it") for kind, more in NOTICES.items() for t in more]
    texts.append(("GPL-2.0 GPL-3.0", f"{NOTICES['GPL-2.0'][0]} {NOTICES['GPL-3.0'][0]}"))  # side by side both count
    rows = licenses.scan(spark, spark.createDataFrame(list(enumerate(t for _, t in texts)), "doc_id long, text string"), best_only=True).collect()
    got = {k: set() for k in range(len(texts))}
    for x in rows:
        got[x["doc_id"]].add(licenses.FORM.sub("", x["license"]))
    assert got == {k: set(kind.split()) for k, (kind, _) in enumerate(texts)}


# personal data

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, rx) in enumerate(RX.items()):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def pii_texts():
    r = random.Random(6)
    parts = ["a.b@c.de", "x@y", "@", "+1 (988) 555-2485", "+", "4111 1111 1111 1111", "4111111111111112", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "000.1.02.255", "é", "日本", "😀", " ", "\n", "-", ".", "0", "12", "999-999-9999", "k_l@m.n_o@p.q", "+12345678", "9" * 25, "deadbeef" * 5]
    texts = [(k, "".join(r.choice(parts) for _ in range(r.randint(1, 25)))) for k in range(300)]
    long = " ".join(f"u{k}@mail.example.com 10.{k % 300}.3.4" for k in range(3000))
    return [*texts, (1000, None), (1001, ""), (1002, long), (1003, "1." * 30_000), (1004, "a" * 60_000), (1005, "7" * 60_000), (1006, "a." * 20_000 + "@b" + ".c" * 20_000), (None, "a@b.c"), (0, texts[0][1])]


def test_personal_data_against_brute_force(spark):
    texts = pii_texts()
    rows = pii.find(spark.createDataFrame(clash_rows(texts), CLASH).coalesce(1)).collect()
    assert len(rows) == len(texts)
    for (doc, text), r in zip(texts, rows, strict=True):
        want = brute_spans(text)
        s = ",".join(f"{k}:{a}:{e}" for a, _, e, k in want)
        assert (r["doc_id"], r["base_sha256"]) == (doc, hashlib.sha256(s.encode()).hexdigest())
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[1] == k for x in want) for k in range(4)]
        assert set(s.split(",")) <= set(r["spans"].split(","))
    assert pii.find(spark.createDataFrame([], DOCS)).count() == 0


def test_redaction(spark):
    texts = pii_texts()
    docs = spark.createDataFrame(clash_rows(texts), CLASH).coalesce(1)
    out = pii.redact(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    for (doc, text), r in zip(texts, out.collect(), strict=True):
        assert (r["doc_id"], r["_t"], r["at"]) == (doc, "x", 7)
        if not brute_spans(text) and "deadbeef" not in (text or ""):
            assert r["text"] == text or "[NUMBER]" in r["text"]
        elif text:
            assert "@mail" not in r["text"]
    one = pii.redact(spark.createDataFrame([(1, "é mail a.b@c.de, ip 10.0.0.1."), (2, "none")], "doc_id long, text string")).collect()
    assert [r["text"] for r in one] == ["é mail [EMAIL], ip [IP].", "none"]


def test_redaction_of_long_texts_follows_the_spans(spark):
    r = random.Random(19)
    kinds = [lambda k: f"u{k}@mail.example.com", lambda k: "+1 (202) 555-0173", lambda k: "10.20.30.4", lambda k: "4111 1111 1111 1111", lambda k: "token = 9233a8ecf7c5b09fe5949719b6b82bc439e9329b", lambda k: f"a{k}@b.c+12025550173.1.2.3.4"]
    def text(n):
        return " ".join(r.choice(kinds)(k) if r.random() < 0.2 else r.choice(["é", "wort", "漢字", "x\n"]) * r.randint(1, 40) for k in range(n))
    texts = [(k, text(r.choice([3, 60, 400]))) for k in range(12)] + [(20, "z" * 4090 + " a@b.cd " + "é" * 4090 + text(4000)), (21, text(9000)), (22, "a@b.cd" * 2), (23, None), (24, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {x["doc_id"]: [y.split(":") for y in x["spans"].split(",") if y] for x in pii.find(docs).collect()}
    assert sum(map(len, found.values())) > 2500 and max(len(t or "") for _, t in texts) > pii.STRETCH
    for x in pii.redact(docs).collect():
        t = dict(texts)[x["doc_id"]]
        out, at = "", 0
        for kind, a, b in found[x["doc_id"]]:
            if int(a) >= at:
                out += t[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert x["text"] == (out + t[at:] if found[x["doc_id"]] else t)


def test_reliabilities_come_from_agreement():
    counts = {(5, 1, 1, 1): 80.0, (5, 2, 0, 0): 100.0, (5, 1, 1, 0): 15.0, (5, 2, 0, 1): 5.0}
    post, _ = pii.expectation_maximisation(counts)
    assert post[5, 1, 1, 1] > 0.9 > 0.1 > post[5, 2, 0, 0]
    w = pii.train(counts, post)
    z = lambda p: sum(w[i] for i in [*pii.features(p), -1])
    assert z((5, 1, 1, 1)) > 0 > z((5, 2, 0, 0))
    # what the labelers do not see is weighed too: here a character before goes with those that they agree on
    seen = {(*p, 1, int(p[1] == 1), 2): n for p, n in counts.items()} | {(5, 2, 2, 2, 1, 0, 2): 300.0, (5, 2, 2, 2, 1, 1, 2): 300.0}
    w = pii.train(seen, post | {(5, 2, 2, 2): 0.5})
    assert z((5, 2, 2, 2, 1, 1, 2)) > z((5, 2, 2, 2, 1, 0, 2))


# decontamination


def brute_leaks(text, items, share=0.8):
    words = decontaminate.words_of(text)
    out = set()
    for k, t in items:
        w = decontaminate.words_of(t)
        if not w:
            continue
        n = min(5, len(w))
        need = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        if len(need & {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) >= share * len(need):
            out.add(k)
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 7)))
    common = [word() for _ in range(30)]
    say = lambda n: [r.choice(common) if r.random() < 0.5 else word() for _ in range(n)]
    items = [(k, " ".join(say(r.randint(6, 60))) + ("?" if k % 2 else ".") + " " + " ".join(say(r.randint(1, 8)))) for k in range(150)]
    docs = []
    for k in range(200):
        w = say(r.randint(0, 200))
        if k % 2:
            t = decontaminate.words_of(items[k % 150][1])
            if k % 3 == 0:
                t = t[: max(1, int(len(t) * r.random()))]
            at = r.randint(0, len(w))
            w[at:at] = t
        docs.append((k, " ".join(w)))
    docs += [(500, None), (501, ""), (502, " ".join(say(30_000)) + " " + items[3][1]), (None, items[4][1]), (1, docs[1][1])]
    frame = spark.createDataFrame(clash_rows(docs), CLASH)
    table = spark.createDataFrame([*items, items[0], (None, "x y z"), (900, None), (901, "")], "item_id long, text string")
    want = {(d, i) for d, t in docs for i in brute_leaks(t, items)}
    found = []
    for bound, reads in ((4 << 20, 4), (8_000, 8), (8_000, 1), (1_000, 100)):  # one shard, and several, in one read or more
        got = decontaminate.leaks(spark, frame, table, shard_bytes=bound, shards_per_read=reads).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(want) > 50
        found.append(sorted(map(str, got)))
    assert all(x == found[0] for x in found)  # scores included
    for bound in (4 << 20, 3_000):
        left = decontaminate.clean(spark, frame, table, shard_bytes=bound)
        assert left.columns == frame.columns and left.count() == sum(not brute_leaks(t, items) for _, t in docs)
    assert decontaminate.leaks(spark, frame, table.limit(0)).count() == 0 and decontaminate.leaks(spark, frame.limit(0), table).count() == 0


def test_block_max_search_is_exhaustive():
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for k in range(300)]
    split = [decontaminate.words_of(t) for _, t in items]
    df = {w: sum(w in x for x in split) for w in vocabulary}
    ix = decontaminate.Index(items, 5, (300, sum(map(len, split)) / 300, max(map(len, split))), df)
    for _ in range(200):
        words = set(r.sample(vocabulary, r.randint(1, 40)))
        want = {}
        for x in words & ix.lists.keys():
            for k, w in zip(*ix.lists[x], strict=True):
                want[k] = want.get(k, 0) + w
        for least in (0.2, 0.5, 0.9):
            assert {k for k, _ in ix.search(words, least)} == {k for k, s in want.items() if s >= least - 1e-9}


def test_questions_and_answers():
    assert decontaminate.question_and_answer("What is it? A cat.") == ("What is it?", " A cat.")
    assert decontaminate.question_and_answer("It rains. So it is wet.") == ("It rains. ", "So it is wet.")
    assert decontaminate.question_and_answer("One only") == ("One only", "")


# pipeline


@has_data
def test_pipeline_stages(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = p.toxicity(spark, docs, SF)
    scored = toxicity.toxicity(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert clean.columns == schema
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in scored.where("score < 0.5").collect()}
    odd = docs.limit(300).union(docs.limit(5)).union(docs.where("doc_id = 7").selectExpr("CAST(NULL AS long)", "text", "lang", "source", "n_chars"))
    one = p.near_dedup(spark, odd, SF)
    assert one.columns == schema and one.where("doc_id IS NULL").count() == 1 and one.where("doc_id < 5").count() <= 5
    left = p.decontamination(spark, docs, SF)
    assert left.columns == schema and {r["doc_id"] for r in left.select("doc_id").collect()} == {d for d, t in texts.items() if not brute_leaks(t, items)}
    safe = p.personal_data(spark, docs, SF)
    assert safe.columns == schema and safe.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    for r in safe.collect():
        assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not brute_spans(texts[r["doc_id"]]) and "[" not in r["text"]:
            assert r["text"] == texts[r["doc_id"]]
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "decontamination", "personal_data", "packing"]
    assert p.run(spark, SF).where("length < 1").count() == 0
