"""Operator 4: personal data by weak-supervision aggregation, in DataFrame functions only.

Regular expressions give base spans (email, ip, card, phone) and wider candidates (obfuscated addresses, digit runs, hex
secrets). Labelers vote on every candidate: a format check, a gazetteer (top-level domains, issuer ranges, country
codes, usual secret lengths) and the words just before it. Votes are 1, 0 or abstain (2). Spark counts how often each
pattern of kind, votes and features (length, character before, letter case) occurs over the whole table;
expectation-maximisation on the counts of kinds and votes estimates the labelers' reliabilities, and a logistic span
classifier over kinds, votes and features is trained on the patterns with the posteriors as soft labels, so that it can
weigh what the labelers do not see. A pattern has few possible values (7 kinds, 3 votes of 3 labelers, 4 x 3 x 3
features: 6804), so what the driver gets is bounded at any size of the input. Base spans stay in any case; a candidate is
added if the classifier gives it 0.5 or more and no base span overlaps it.

The cost stays near linear in a text's length and its number of matches: positions are prefix sums over the pieces
between matches, in steps of 256 matches; pieces of a text are cut out of blocks of 4096 characters; spans are compared
with chunks of other spans first. The expressions avoid backtracking and recursion on long runs: repeated groups are
possessive, and runs are entered at their start only (or where the last match ended).

Defined results: null texts count as empty. A null doc_id stays null. Each repeated row gets its row. Other columns are
ignored by find() and kept by redact(). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@"))),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11,}+", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9][\x20().0-9-]")),
}
WIDER = {
    "handle": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++", lambda t: t.rlike(r"[(\[]at[)\]]")),
    "number": (r"(?<![0-9+.\-])[0-9](?:[ .-]?[0-9]){8,18}+(?![0-9])", lambda t: t.rlike(r"[0-9](?:[ .-]?[0-9]){8}")),
    "secret": (r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,128}+(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Fa-f0-9]{32}")),
}
KINDS = list(BASE) + list(WIDER)

# Gazetteers.
DOMAINS = "com org net edu gov int info biz io de fr es it nl uk us eu ch at be pl se no fi dk pt ie ca au jp cn in br ru example"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|3(?:0[0-5]|[68]))"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SECRET_LENGTHS = r"^(?:.{32}|.{40}|.{56}|.{64}|.{96}|.{128})$"
CUES = {
    "email": r"e-?mail|contact|write|reach|courriel|correo|kontakt",
    "ip": r"\bip\b|address|host|server|login|from",
    "card": r"card|visa|master|amex|credit|payment|carte|tarjeta|karte",
    "phone": r"phone|call|tel|mobile|fax|contact|whatsapp",
    "handle": r"e-?mail|contact|write|reach|courriel|correo|kontakt",
    "number": r"phone|call|tel|mobile|fax|card|visa|account|iban|ssn|passport",
    "secret": r"token|secret|key|passw|api|auth|bearer",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates a value once and uses it several times, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Characters in a block of text, and in a stretch that is cut into blocks.
BLOCK, STRETCH = 4096, 1 << 18


def blocks(text: Column) -> Column:
    """A text as an array of blocks, so that a piece anywhere in it costs no walk from its start."""

    def cut_up(t: Column, size: int, inner: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / size).cast("int")), lambda c: inner(F.substr(t, c * size + 1, F.lit(size))))

    long = F.flatten(cut_up(text, STRETCH, lambda s: let(s, lambda x: cut_up(x, BLOCK, lambda y: y))))
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(long)


def piece(blocks_: Column, a: Column, b: Column) -> Column:
    """The text from a to before b."""

    def part(c: Column) -> Column:
        first = F.greatest(a - c * BLOCK, F.lit(0))
        return F.substr(F.get(blocks_, c), first + 1, F.least(b - c * BLOCK, F.lit(BLOCK)) - first)

    reach = F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int"))
    return F.when(a < b, F.array_join(F.transform(reach, part), "")).otherwise(F.lit(""))


def spans(text: Column, kind: str) -> Column:
    """All matches of a kind's expression: array of (start, k, end, value), in code points, end exclusive."""
    pattern, guard = (BASE | WIDER)[kind]
    k, step = KINDS.index(kind), 256
    none = F.array().cast("array<struct<start:int,k:int,end:int,value:string>>")

    def total(lengths: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(lengths, first, n), F.lit(0), lambda a, x: a + x)

    def placed(s: Column) -> Column:
        lengths = F.transform(s["m"], lambda x, i: F.length(x) + F.length(F.get(s["p"], i)))
        return let(lengths, lambda n: let(
            F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / step).cast("int")), lambda c: total(n, F.lit(1), c * step)),
            lambda chunks: F.transform(s["m"], lambda x, i: let(
                F.get(chunks, F.floor(i / step).cast("int")) + total(n, (F.floor(i / step) * step + 1).cast("int"), i % step) + F.length(F.get(s["p"], i)),
                lambda at: F.struct(at.alias("start"), F.lit(k).alias("k"), (at + F.length(x)).alias("end"), x.alias("value")),
            )),
        ))

    found = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")), placed)
    return F.when(guard(text), found).otherwise(none)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        n = F.substr(d, i, F.lit(1)).cast("int")
        twice = (F.length(d) - i) % 2 == 1
        return F.when(twice & (n > 4), n * 2 - 9).when(twice, n * 2).otherwise(n)

    return let(digits(v), lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + value(d, i)) % 10 == 0)


def valid(kind: str, v: Column) -> Column:
    n = F.length(digits(v))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return v.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(v)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind as listed."""
    def good(kind: str) -> Column:
        return F.filter(spans(text, kind), lambda s: valid(kind, s["value"]))

    return F.array_sort(F.concat(*[good(kind) for kind in BASE]))


def wider_spans(text: Column, base: Column) -> Column:
    """Candidates that no base span overlaps."""
    found, step = F.concat(*[spans(text, kind) for kind in WIDER]), 128

    def chunk(c: Column) -> Column:
        return let(F.slice(base, c * step + 1, step), lambda some: F.struct(F.get(some, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(some, lambda b: b["end"])).alias("hi"), some.alias("some")))

    def free(chunks: Column) -> Column:
        def hit(s: Column) -> Column:
            return F.exists(chunks, lambda c: (c["lo"] < s["end"]) & (s["start"] < c["hi"]) & F.exists(c["some"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

        return F.filter(found, lambda s: ~hit(s))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(base) - 1) / step).cast("int")), chunk)
    return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(let(chunks, free))


def with_context(text: Column, found: Column) -> Column:
    """Spans with the characters just before them, 30 at most, in lower case."""

    def add(b: Column) -> Column:
        before = lambda s: F.lower(piece(b, F.greatest(F.lit(0), s["start"] - 30), s["start"]))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["value"].alias("value"), before(s).alias("before")))

    none = F.array().cast("array<struct<start:int,k:int,end:int,value:string,before:string>>")
    return F.when(F.size(found) == 0, none).otherwise(let(blocks(text), add))


def votes(s: Column) -> list[Column]:
    """Format, gazetteer and context votes on a candidate: 1, 0 or 2 for abstaining."""
    v, k = s["value"], s["k"]
    is_ = {kind: k == i for i, kind in enumerate(KINDS)}
    domain = rf"(?i)\.(?:{DOMAINS.replace(' ', '|')})$"
    form = (
        F.when(is_["email"], v.rlike(r"^[A-Za-z0-9]").cast("int"))
        .when(is_["ip"], (~v.rlike(r"^0|\.0[0-9]")).cast("int"))
        .when(is_["card"], v.rlike(r"^[0-9]{13,16}$|^(?:[0-9]{4}[ -]){3}[0-9]{4}$").cast("int"))
        .when(is_["phone"], v.rlike(r"^\+[0-9]{1,3}[ (.-]").cast("int"))
        .when(is_["handle"], F.lit(1))
        .when(is_["number"], F.when(v.rlike(r"^[0-9]+$"), 0).otherwise(2))
        .otherwise(F.when(v.rlike("[0-9]") & v.rlike("[A-Fa-f]"), 1).otherwise(0))
    )
    listed = (
        F.when(is_["email"] | is_["handle"], v.rlike(domain).cast("int"))
        .when(is_["ip"], (~v.rlike(r"^(?:0|10|127|255|192\.168)\.")).cast("int"))
        .when(is_["card"], v.rlike(ISSUERS).cast("int"))
        .when(is_["phone"], v.rlike(COUNTRIES).cast("int"))
        .when(is_["number"], F.when(v.rlike(ISSUERS) & (F.length(digits(v)) >= 13), 2).otherwise(0))
        .otherwise(v.rlike(SECRET_LENGTHS).cast("int"))
    )
    cue = F.lit(False)
    for kind, words in CUES.items():
        cue = cue | (is_[kind] & s["before"].rlike(words))
    context = F.when(cue, 1).when(is_["number"] | is_["secret"], 0).otherwise(2)
    return [form.cast("int"), listed.cast("int"), context.cast("int")]


#: Numbers of values of the features that the classifier has beside kind and votes.
FEATURES = (4, 3, 3)


def looks(s: Column) -> list[Column]:
    """Features of a candidate that no labeler votes on: its length, the character before it, its letters' case."""
    v, n = s["value"], F.length(s["value"])
    size = F.when(n < 12, 0).when(n < 20, 1).when(n < 40, 2).otherwise(3)
    lead = F.when(s["before"].rlike(r"(?:^|\s)$"), 0).when(s["before"].rlike(r"""[:=("'<\[]$"""), 1).otherwise(2)
    case = F.when(v.rlike("[A-Z]"), 0).when(v.rlike("[a-z]"), 1).otherwise(2)
    return [size.cast("int"), lead.cast("int"), case.cast("int")]


Votes = tuple[int, int, int, int]
Pattern = tuple[int, int, int, int, int, int, int]


def expectation_maximisation(counts: dict[Votes, float], rounds: int = 100) -> tuple[dict[Votes, float], list[list[list[float]]]]:
    """Posterior that a candidate of some kind and votes is personal data, and P(vote | class) by labeler, class and vote."""
    post = {p: min(0.95, max(0.05, (0.5 + sum(v == 1 for v in p[1:])) / (1.0 + sum(v != 2 for v in p[1:])))) for p in counts}
    tables: list[list[list[float]]] = []
    for _ in range(rounds):
        tables = [[[0.0] * 3, [0.0] * 3] for _ in range(3)]
        prior = {k: [1.0, 1.0] for k in range(len(KINDS))}
        for p, n in counts.items():
            for c, w in ((1, post[p] * n), (0, (1 - post[p]) * n)):
                prior[p[0]][c] += w
                for j, v in enumerate(p[1:]):
                    tables[j][c][v] += w
        for j in range(3):
            for c in (0, 1):
                whole = sum(tables[j][c]) + 3.0
                tables[j][c] = [(x + 1.0) / whole for x in tables[j][c]]
        new = {}
        for p in counts:
            z = [math.log(prior[p[0]][c] / sum(prior[p[0]])) + sum(math.log(tables[j][c][v]) for j, v in enumerate(p[1:])) for c in (0, 1)]
            new[p] = 1 / (1 + math.exp(max(-50.0, min(50.0, z[0] - z[1]))))
        moved = max((abs(new[p] - post[p]) for p in counts), default=0.0)
        post = new
        if moved < 1e-6:
            break
    return post, tables


def features(p: tuple[int, ...]) -> list[int]:
    """Places of a pattern's features among the classifier's weights; of kind and votes alone where it has no more."""
    out = [p[0], *(len(KINDS) + 3 * j + v for j, v in enumerate(p[1:4]))]
    at = len(KINDS) + 9
    for v, n in zip(p[4:], FEATURES, strict=False):
        out.append(at + v)
        at += n
    return out


def train(counts: dict[tuple[int, ...], float], post: dict[Votes, float], rounds: int = 500, l2: float = 1e-3) -> list[float]:
    """Weights of a logistic span classifier, soft labels from the posteriors of kind and votes; the last is the bias."""
    n = len(KINDS) + 9 + sum(FEATURES)
    if not counts:
        return [0.0] * (n + 1)
    patterns = sorted(counts)
    x = np.zeros((len(patterns), n + 1))
    for i, p in enumerate(patterns):
        x[i, [*features(p), n]] = 1
    share = np.array([counts[p] for p in patterns]) / sum(counts.values())
    y = np.array([post[p[:4]] for p in patterns])
    w, speed = np.zeros(n + 1), np.full(n + 1, 1e-8)
    for _ in range(rounds):
        g = l2 * w + x.T @ ((1 / (1 + np.exp(-(x @ w))) - y) * share)
        speed += g * g
        w -= 0.5 * g / np.sqrt(speed)
    return w.tolist()


def prepared(docs: DataFrame, text: str) -> DataFrame:
    """Adds _t (the text, never null), _base and _wider."""
    d = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    d = d.withColumn("_base", base_spans(F.col("_t")))
    return d.withColumn("_wider", with_context(F.col("_t"), wider_spans(F.col("_t"), F.col("_base"))))


def learn(docs: DataFrame, text: str = "text") -> list[float]:
    """The span classifier's weights, from all candidates of the table."""
    some = prepared(docs.select(F.col(text).alias("_text")), "_text").where((F.size("_base") > 0) | (F.size("_wider") > 0))
    c = some.select(F.explode(F.concat(with_context(F.col("_t"), F.col("_base")), F.col("_wider"))).alias("s"))
    names = ["v0", "v1", "v2", "f0", "f1", "f2"]
    columns = [x.alias(n) for x, n in zip([*votes(F.col("s")), *looks(F.col("s"))], names, strict=True)]
    counts: dict[tuple[int, ...], float] = {}
    by_votes: dict[Votes, float] = {}
    for r in c.select(F.col("s.k").alias("k"), *columns).groupBy("k", *names).count().collect():
        p = (r["k"], *(r[n] for n in names))
        counts[p] = float(r["count"])
        by_votes[p[:4]] = by_votes.get(p[:4], 0.0) + r["count"]
    return train(counts, expectation_maximisation(by_votes)[0])


def accepted(weights: list[float]) -> Column:
    """Base spans and the candidates that the classifier accepts, by start, then kind."""

    def positive(s: Column) -> Column:
        table = F.array(*[F.lit(float(x)) for x in weights])
        z = F.get(table, s["k"]) + F.lit(float(weights[-1]))
        at = len(KINDS)
        for v, n in zip([*votes(s), *looks(s)], (3, 3, 3, *FEATURES), strict=True):
            z = z + F.get(table, v + F.lit(at))
            at += n
        return z >= 0

    def plain(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["value"].alias("value"))

    return F.when(F.size("_wider") == 0, F.col("_base")).otherwise(F.array_sort(F.concat(F.col("_base"), F.transform(F.filter("_wider", positive), plain))))


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256, spans and n_added for each row."""
    weights = learn(docs, text)
    d = prepared(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text").withColumn("_all", accepted(weights))

    def count(i: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["k"] == i)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return d.select("doc_id", *counts, F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"), (F.size("_all") - F.size("_base")).cast("long").alias("n_added"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; overlapping spans become one."""
    weights = learn(docs, text)
    # the row is kept apart, so that no column of docs can clash with the ones made here
    d = prepared(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), "_text").withColumn("_all", accepted(weights))
    t, row = F.col("_t"), F.col("_row")
    clean = F.when(F.size("_all") > 0, replaced(t, F.col("_all"))).otherwise(row.getField(text))
    return d.select(*[(clean if c == text else row.getField(c)).alias(c) for c in docs.columns])


def replaced(text: Column, found: Column) -> Column:
    """A text with its spans, which are sorted by start, replaced by their kinds; one that overlaps an earlier one vanishes."""
    names, step = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), 256
    most = lambda some: F.coalesce(F.array_max(F.transform(some, lambda s: s["end"])), F.lit(0))

    def build(b: Column, tops: Column) -> Column:
        # tops: the furthest end of each chunk of spans; the furthest end before a span is that of earlier chunks or of its own
        def one(s: Column, i: Column) -> Column:
            c = F.floor(i / step).cast("int")
            reached = F.greatest(F.coalesce(F.array_max(F.slice(tops, F.lit(1), c)), F.lit(0)), most(F.slice(found, c * step + 1, i % step)))
            return let(reached, lambda at: F.when(s["start"] >= at, F.concat(piece(b, at, s["start"]), F.get(names, s["k"]))).otherwise(F.lit("")))

        return F.concat(F.array_join(F.transform(found, one), ""), piece(b, F.array_max(tops), F.length(text)))

    tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / step).cast("int")), lambda c: most(F.slice(found, c * step + 1, step)))
    return let(F.struct(blocks(text).alias("b"), tops.alias("tops")), lambda x: build(x["b"], x["tops"]))
