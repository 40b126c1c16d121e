"""Operator 1: toxicity scores behind noisy-channel deobfuscation.

A character trigram model is counted over every text, on the characters themselves. Passages that look obfuscated
(letters replaced by look-alikes at any place, letters of another script among Latin ones, letters or pieces of a word
set apart by blanks or marks, letters repeated or doubled) become lattices: each character offers the letters that it
may stand for, a run of separators may vanish or part two words, a run of one letter may be shorter. Viterbi decoding
under the model picks the restored text, which may be the text as it was. A logistic model over words and word
beginnings of the text as it is and as restored gives the score. Two ordinary short words that a blank parts are not
tried as one.

The counts come from all rows, added up within tasks first, and grow with what the corpus holds. The model is broadcast
as long as it has no more than `model_trigrams` trigrams. Beyond that the commonest trigrams and pairs are, and the others
are looked up: slices of texts are written with the rarer ones that their lattices ask for, joined with the counts, and
decoded with these. Every count is used, and the scores are the same for any bound. The classifier is fitted on at most `sample_per_class` labelled documents of
each class (the smallest hashes of doc_id, held-out rows excluded; of rows that repeat a doc_id the smallest text),
weighted to the share of each class among all training labels. Features are chosen by a chi-square statistic over that
sample, `n_features` at most. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts have no features and get the model's base score. A null doc_id counts as not held
out, and its labels are not used. Repeated rows are scored each. Labels that are null or contradict each other (one
doc_id, several values) take the largest value that is not null. Without labels of both classes every score is the share
of label 1 (0 without labels). Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Workspace, trimmed
from ledgerline.llm.suffix_dedup import grouped

#: What a mark may stand for.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "#": "h", "(": "c", "¡": "i", "§": "s", "¢": "c", "£": "l", "€": "e"}
#: Latin letters that Cyrillic and Greek ones look like; full-width and other styled letters come by compatibility forms.
HOMOGLYPH = dict(zip("аеорсухіјѕһԁԛԝкмнтвзαορνικυεηωγτ", "aeopcyxijshdqwkmhtbzaopvikuenwyt", strict=True))
SEPARATORS = " ._-*,/~"
#: Codes of characters: a letter is itself in lower case, a digit DIGIT, what may be a mark MARK, all else 0.
TOP = 0x20000
DIGIT, OTHER = ord("0"), 1
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """By character: its code, and whether it is a letter, a Latin one, a styled or foreign one, a mark, a separator, blank."""
    chars = [chr(k) for k in range(TOP)]
    letter = np.array([c.isalpha() for c in chars])
    code = np.where(letter, np.arange(TOP), 0)
    code[[k for k, c in enumerate(chars) if c.isdecimal()]] = DIGIT
    code[[ord(c) for c in "@$|+*%&#=<>~^_?¡§¢£€"]] = OTHER
    flags = {name: np.zeros(TOP, bool) for name in ("mark", "tail", "separator", "blank", "latin", "styled")}
    for name, some in (("mark", LOOKALIKE), ("tail", "0123456789@$"), ("separator", SEPARATORS), ("blank", " \n\t\r\x0b\x0c")):
        flags[name][[ord(c) for c in some]] = True
    flags["latin"][:0x250] = letter[:0x250]
    flags["styled"][[k for k in [*map(ord, HOMOGLYPH), *range(0x1D400, 0x1D800), *range(0xFF21, 0xFF5B)] if plain_letters(chars[k])]] = True
    return {"code": code.astype(np.int64), "letter": letter, **flags}


def plain_letters(c: str) -> str:
    """The Latin letter that a letter of another kind looks like, if there is one."""
    if c in HOMOGLYPH:
        return HOMOGLYPH[c]
    plain = unicodedata.normalize("NFKC", c).lower()
    return plain if plain != c and len(plain) == 1 and "a" <= plain <= "z" else ""


def points(lowered: str) -> np.ndarray:
    """The code points of a text; those beyond the tables count as their last one."""
    return np.minimum(np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32), TOP - 1)


def code_of(c: str) -> int:
    return int(tables()["code"][min(ord(c), TOP - 1)])


def trigrams(lowered: str, dense: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of a text (three codes in one number) and how often they occur; a word's first letter follows two boundaries."""
    c = tables()["code"][points(lowered)]
    c = np.concatenate([[0, 0], c, [0]])
    a, b, d = c[:-2], c[1:-1], c[2:]
    a = np.where(b == 0, 0, a)
    # the commonest characters are counted in a cube, the others by sorting
    times = np.bincount(c, minlength=TOP)
    common = np.argsort(-times, kind="stable")[:dense]
    rank = np.full(TOP, dense)
    rank[common] = np.arange(dense)
    x, y, z = rank[a], rank[b], rank[d]
    inside = (x < dense) & (y < dense) & (z < dense)
    cube = np.bincount(((x * dense + y) * dense + z)[inside], minlength=dense**3)
    at = np.flatnonzero(cube)
    key = common[at // dense**2] << 42 | common[at // dense % dense] << 21 | common[at % dense]
    out = ~inside
    rare, n = np.unique(a[out] << 42 | b[out] << 21 | d[out], return_counts=True)
    return np.concatenate([key, rare]), np.concatenate([cube[at], n])


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key, keys ascending."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(of, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def counter(batches: Iterator) -> Iterator:
    """Trigram counts of a task's texts."""
    import pyarrow as pa

    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        keys, n = added(held)
        for k in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 50_000]), pa.array(n[k : k + 50_000])], names=["trigram", "n"])

    for batch in batches:
        for part in slices(batch):
            texts = [t.lower() for t in part.column(0).to_pylist() if t]
            if texts:
                held.append(trigrams("\n\n".join(texts)))
            if sum(len(k) for k, _ in held) > 4_000_000:
                held = [added(held)]
                if len(held[0][0]) > 2_000_000:
                    yield from flush()
                    held = []
    yield from flush()


class LanguageModel:
    """Log probabilities of a character after two others, each order smoothed with the one below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.k3, self.n3 = keys, counts.astype(np.float64)
        self.k2, self.n2 = self._sums(keys & (2**42 - 1))
        self.k1, self.n1 = self._sums(keys & (2**21 - 1))
        self.c3, self.t3 = self._sums(keys >> 21)
        self.c2, self.t2 = self._sums(keys >> 21 & (2**21 - 1))
        self._begin()

    def _begin(self) -> None:
        self.total, self.kinds = float(self.n1.sum()), len(self.k1) + 1
        self.known: dict[int, float] = {}
        #: Counts that are in none of the tables, by kind and key.
        self.rest: dict[tuple[int, int], int] = {}

    @classmethod
    def common(cls, tables: list[tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
        """A model of the common trigrams, last pairs and first pairs, and of all last and middle characters."""
        made = cls.__new__(cls)
        (made.k3, made.n3), (made.k2, made.n2), (made.c3, made.t3), (made.k1, made.n1), (made.c2, made.t2) = [(k, n.astype(np.float64)) for k, n in tables]
        made._begin()
        return made

    def lacking(self, trigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kinds and keys that the probabilities of trigrams ask for and the tables don't hold."""
        out = [np.setdiff1d(x, have) for x, have in zip((trigrams, trigrams & (2**42 - 1), trigrams >> 21), (self.k3, self.k2, self.c3), strict=True)]
        return np.repeat(np.arange(3), [len(x) for x in out]), np.concatenate(out)

    def _sums(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some, of = np.unique(keys, return_inverse=True)
        return some, np.bincount(of, self.n3, len(some))

    def _at(self, keys: np.ndarray, n: np.ndarray, key: int, kind: int = -1) -> float:
        k = int(np.searchsorted(keys, key))
        return float(n[k]) if k < len(keys) and keys[k] == key else float(self.rest.get((kind, key), 0))

    def __call__(self, a: int, b: int, c: int) -> float:
        key = a << 42 | b << 21 | c
        p = self.known.get(key)
        if p is None:
            p1 = (self._at(self.k1, self.n1, c) + 1) / (self.total + self.kinds)
            p2 = (self._at(self.k2, self.n2, b << 21 | c, 1) + 5 * p1) / (self._at(self.c2, self.t2, b) + 5)
            p = math.log((self._at(self.k3, self.n3, key, 0) + 5 * p2) / (self._at(self.c3, self.t3, key >> 21, 2) + 5))
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[key] = p
        return p


class Asked:
    """In a model's place: notes the trigrams that it is asked for."""

    def __init__(self):
        self.keys: set[int] = set()

    def __call__(self, a: int, b: int, c: int) -> float:
        self.keys.add(a << 42 | b << 21 | c)
        return 0.0


class Decoder:
    def __init__(self, model: LanguageModel | Asked):
        self.model = model
        self.cache: dict[tuple[str, bool], str] = {}

    @staticmethod
    def lattice(span: str, apart: bool) -> list[list[tuple[str, float]]]:
        """The options, each with its cost, for one run of characters after the other."""
        out, i, n = [], 0, len(span)
        # three single letters may well be words
        join, part = (-0.3, -2.0) if sum(c not in SEPARATORS for c in span) > 3 else (-2.0, -0.3)
        doubled = sum(x == y and x.isalpha() for x, y in zip(span, span[1:], strict=False)) > 1
        while i < n:
            c, j = span[i], i + 1
            if apart and c in SEPARATORS:
                while j < n and span[j] in SEPARATORS:
                    j += 1
                gap = [("", join), (" ", part)]
                if "*" in span[i:j] and span[i:j].strip():  # may also hide a letter
                    gap += [(x, -2.5) for x in LOOKALIKE["*"]]
                out.append(gap)
                i = j
                continue
            while j < n and span[j] == c:
                j += 1
            if c.isalpha():
                plain = plain_letters(c)
                for x, cost in ((c, 0.0), (plain, -1.0)) if plain else ((c, 0.0),):
                    if j - i >= 3:
                        options = [(x, cost - 0.3), (x * 2, cost - 1.4)]
                    elif j - i == 2 and doubled:
                        options = [(x * 2, cost), (x, cost - 1.5)]
                    else:
                        options = [(x * (j - i), cost)]
                    out.append(options) if x == c else out[-1].extend(options)
            elif c in LOOKALIKE:
                options = [(x, -1.0 - 0.2 * len(LOOKALIKE[c])) for x in LOOKALIKE[c]]
                if c.isdigit():
                    options.append((c, -2.0))
                else:  # may also be no more than a mark, above all at an end
                    options.append((" ", -0.3 if i == 0 and c not in "$@" or j == n else -3.0))
                out.append(options)
                if j - i == 2:
                    out.append([*options, ("", -1.0)])
            else:
                out.append([(" ", 0.0)])
            i = j
        return out

    def best(self, lattice: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """The likeliest text through a lattice, by Viterbi over the last two characters, and its log probability."""
        model = self.model
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in lattice:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            coded = [(text, cost, [code_of(c) for c in text]) for text, cost in options]
            for (a, b), (p, path) in paths.items():
                for text, cost, codes in coded:
                    x, y, q = a, b, p + cost
                    for z in codes:
                        q += model(x, y, z)
                        x, y = (0 if z == 0 else y), z
                    old = new.get((x, y))
                    if old is None or q > old[0]:
                        new[(x, y)] = (q, (path, text) if text else path)
            paths = new
        best, path = max(((p + model(a, b, 0), path) for (a, b), (p, path) in paths.items()), key=lambda r: r[0])
        parts = []
        while path:
            path, text = path
            parts.append(text)
        return best, "".join(reversed(parts))

    def decode(self, span: str, apart: bool) -> str:
        """The likeliest text behind a span."""
        found = self.cache.get((span, apart))
        if found is None:
            found = self.best(self.lattice(span, apart))[1]
            if len(span) <= 64:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                self.cache[span, apart] = found
        return found


def noisy_spans(lowered: str) -> list[tuple[int, int, bool]]:
    """Where a text looks obfuscated: (start, end, set apart)."""
    t, p = tables(), points(lowered)
    n = len(p)
    if n < 2:
        return []
    letter, mark, blank, sep, tail = t["letter"][p], t["mark"][p], t["blank"][p], t["separator"][p], t["tail"][p]
    spans = []
    ends = np.flatnonzero(np.concatenate([[True], blank, [True]]))

    def words(hits: np.ndarray) -> np.ndarray:
        return np.unique(np.searchsorted(ends, hits, "right"))

    pair = letter[:-1] & (p[:-1] == p[1:])
    hits = [np.flatnonzero(mark[:-1] & letter[1:]), np.flatnonzero(letter[:-1] & tail[1:]), np.flatnonzero(pair[:-1] & pair[1:])]
    if t["styled"][p].any():
        # letters of another kind count in words that have Latin ones too, or that are styled Latin altogether
        latin, styled = np.cumsum(np.append(0, t["latin"][p])), np.flatnonzero(t["styled"][p])
        k = np.searchsorted(ends, styled, "right")
        mixed = latin[np.minimum(ends[k] - 1, n)] > latin[ends[k - 1]]
        hits.append(styled[mixed | (p[styled] > 0x1000)])
    twice = np.flatnonzero(pair)
    if len(twice):
        k, times = np.unique(np.searchsorted(ends, twice, "right"), return_counts=True)
        hits.append(ends[k[times > 1] - 1])  # words with several doubled letters
    k = words(np.concatenate(hits))
    for i, j in zip(ends[k - 1].tolist(), (ends[k] - 1).tolist(), strict=True):
        spans.append((i, j, False))
    # pieces of one word with separators other than blanks between
    if n > 2:
        inner = sep & ~blank
        k = words(np.concatenate([np.flatnonzero(letter[:-2] & inner[1:-1] & letter[2:]), np.flatnonzero(letter[:-3] & inner[1:-2] & inner[2:-1] & letter[3:])]))
        for i, j in zip(ends[k - 1].tolist(), (ends[k] - 1).tolist(), strict=True):
            spans.append((i, j, True))
    # four single characters or more, or three with marks, with one to three separators between each two
    edge = np.concatenate([[True], (sep | blank), [True]])
    single = np.flatnonzero((letter | mark) & edge[:-2] & edge[2:] & ~blank)
    if len(single) > 2:
        others = np.cumsum(np.append(0, ~sep))
        near = (np.diff(single) <= 4) & (others[single[1:]] - others[single[:-1] + 1] == 0)
        a = np.flatnonzero(near & ~np.concatenate([[False], near[:-1]]))
        b = np.flatnonzero(near & ~np.concatenate([near[1:], [False]])) + 1
        for i, j in zip(single[a].tolist(), single[b].tolist(), strict=True):
            some = letter[i : j + 1].sum()
            # three letters with no more than blanks between may well be words
            if (some > 3 or mark[i : j + 1].any() or (sep & ~blank)[i : j + 1].any()) and some:
                spans.append((i, j + 1, True))
    return spans


class Features:
    """Words and word beginnings of texts, as they are and as restored."""

    def __init__(self, model: LanguageModel | Asked):
        self.decoder = Decoder(model)

    def restored(self, lowered: list[str]) -> dict[int, list[str]]:
        """Restored passages, where they differ from the text, by the text's place in the list."""
        starts, at = [], 0
        for t in lowered:
            starts.append(at)
            at += len(t) + 2
        joined = "\n\n".join(lowered)
        out: dict[int, list[str]] = {}
        spans = noisy_spans(joined)
        for (i, j, apart), k in zip(spans, np.searchsorted(starts, [s[0] for s in spans], "right").tolist(), strict=True):
            found = self.decoder.decode(joined[i:j], apart)
            if found != joined[i:j]:
                out.setdefault(k - 1, []).append(found)
        return out

    def words(self, texts: list[str | None]) -> list[tuple[set[str], int]]:
        """The set of words of each text, and how many passages were restored."""
        lowered = [(t or "").lower() for t in texts]
        more = self.restored(lowered)
        out = []
        for k, t in enumerate(lowered):
            words = set(WORD.findall(t))
            for r in more.get(k, ()):
                words.update(WORD.findall(r))
            out.append((words, len(more.get(k, ()))))
        return out


def features_of(words: set[str]) -> set[str]:
    out = {"=" + w for w in words}
    for n in BEGINNINGS:
        out |= {"^" + w[:n] for w in words if len(w) > n}
    return out


def slices(batch, n: int = 1_500_000, column: str = "text"):
    import pyarrow.compute as pc

    from ledgerline.llm.common import by_bytes

    lengths = pc.utf8_length(batch.column(column)).to_pylist()
    for a, b in by_bytes([range(x or 0) for x in lengths], n):
        yield batch.slice(a, b - a)


def feature_counts(model):
    def run(batches: Iterator) -> Iterator:
        """How many texts of each class hold a feature, within a task."""
        import pyarrow as pa

        made, counts = Features(model.value), {}

        def flush():
            keys = list(counts)
            for k in range(0, len(keys), 50_000):
                some = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([counts[x][0] for x in some], pa.int64()), pa.array([counts[x][1] for x in some], pa.int64())], names=["feature", "n0", "n1"])
            counts.clear()

        for batch in batches:
            for part in slices(batch):
                for (words, _), toxic in zip(made.words(part.column("text").to_pylist()), part.column("toxic").to_pylist(), strict=True):
                    for f in features_of(words):
                        counts.setdefault(f, [0, 0])[toxic] += 1
                if len(counts) > 200_000:
                    yield from flush()
        yield from flush()

    return run


def indexed(model, index):
    def run(batches: Iterator) -> Iterator:
        """The chosen features that each sample text holds."""
        import pyarrow as pa

        made, at = Features(model.value), index.value
        for batch in batches:
            for part in slices(batch):
                rows = [sorted(at[f] for f in features_of(w) if f in at) for w, _ in made.words(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "at"])

    return run


def fit(rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, n: int, l2: float = 3e-5, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features by full-batch Adam; weights add up to 1."""
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.fromiter((j for x in rows for j in x), np.int64, len(r))
    w, b = np.zeros(n), float(np.log(max((weights * labels).sum(), 1e-6) / max((weights * (1 - labels)).sum(), 1e-6)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(r, w[c], len(rows))
        e = weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        g, gb = np.bincount(c, e[r], n) + l2 * w, e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.05 * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-9)
        b -= step * mb / (vb**0.5 + 1e-9)
    return w, b


class Scores:
    """Scores of texts under a learned model, and how many passages of each were restored."""

    def __init__(self, model: LanguageModel, weights: dict[str, float], base: float):
        self.features, self.base = Features(model), base
        self.whole = {f[1:]: w for f, w in weights.items() if f[0] == "="}
        self.begin = {n: {f[1:]: w for f, w in weights.items() if f[0] == "^" and len(f) == n + 1} for n in BEGINNINGS}

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[int]]:
        scores, restored = [], []
        for words, n in self.features.words(texts):
            z = self.base + sum(self.whole[w] for w in sorted(words & self.whole.keys()))
            for k, table in self.begin.items():
                z += sum(table[x] for x in sorted({w[:k] for w in words if len(w) > k} & table.keys()))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            restored.append(n)
        return scores, restored


def scorer(model, learned):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        score = Scores(model.value, *learned.value)
        for batch in batches:
            for part in slices(batch):
                scores, restored = score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(restored, pa.int64())], names=["doc_id", "held_out", "score", "predicted", "n_restored"])

    return run


def sieve(model, learned, text: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        score = Scores(model.value, *learned.value)
        for batch in batches:
            for part in slices(batch, column=text):
                scores, _ = score(part.column(text).to_pylist())
                yield part.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))

    return run


def held_out(doc_id: str):
    c = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(c % 5 == 0, F.lit(False))


class Held:
    def __init__(self, value):
        self.value = value


def asking(model, text: str):
    def run(batches: Iterator) -> Iterator:
        """Slices of rows, and the counts that decoding them asks for beyond the model."""
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 300_000, text):
                asked = Asked()
                Features(asked).restored([(t or "").lower() for t in part.column(text).to_pylist()])
                kinds, keys = model.value.lacking(np.array(sorted(asked.keys), np.int64))
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema) as stream:
                    stream.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.array([kinds.astype(np.int32)], pa.list_(pa.int32())), pa.array([keys], pa.list_(pa.int64()))], names=["part", "blob", "kinds", "keys"])
                number += 1

    return run


def answered(model, make):
    def run(batches: Iterator) -> Iterator:
        """What make's function gives for each slice, under the model with the counts that the slice asks for."""
        import pyarrow as pa

        for _, rows in grouped(batches, ["part", "blob", "kind", "key", "n"]):
            model.value.rest = {(kind, key): n for blob, kind, key, n in rows if blob is None}
            for blob in (r[0] for r in rows if r[0] is not None):
                yield from make(Held(model.value))(iter(pa.ipc.open_stream(blob).read_all().to_batches()))

    return run


class Counts:
    """The character model of a table of trigram counts: a broadcast of bounded size, and a table of the rarer counts."""

    def __init__(self, spark: SparkSession, work: Workspace, counted: DataFrame, most: int):
        self.work, self.rest = work, None
        if counted.count() <= most:
            rows = counted.orderBy("trigram").toPandas()
            self.model = spark.sparkContext.broadcast(LanguageModel(rows["trigram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)))
            return
        last, first = F.col("trigram").bitwiseAND(2**42 - 1), F.shiftright("trigram", 21)
        tables, rest = [], []
        for kind, key in enumerate((F.col("trigram"), last, first)):
            sums = work.write(counted.groupBy(key.alias("key")).agg(F.sum("n").alias("n")), "sums")
            powers = [2**k for k in range(63)]
            held = sums.agg(*[F.count_if(F.col("n") >= x).alias(str(x)) for x in powers]).first()
            least = next((x for x in powers if held[str(x)] <= most), 2**63 - 1)
            tables.append(sums.where(F.col("n") >= least).orderBy("key").toPandas())
            rest.append(sums.where(F.col("n") < least).select(F.lit(kind).alias("kind"), "key", "n"))
        # one row for each character at most
        for key in (F.col("trigram").bitwiseAND(2**21 - 1), first.bitwiseAND(2**21 - 1)):
            tables.append(counted.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toPandas())
        self.model = spark.sparkContext.broadcast(LanguageModel.common([(t["key"].to_numpy(np.int64), t["n"].to_numpy(np.int64)) for t in tables]))
        self.rest = work.write(rest[0].union(rest[1]).union(rest[2]), "rest")

    def through(self, df: DataFrame, text: str, make, schema) -> DataFrame:
        """df through make's function of a model, which decodes the column text."""
        if self.rest is None:
            return df.mapInArrow(trimmed(make(self.model)), schema)
        asked = self.work.write(df.mapInArrow(trimmed(asking(self.model, text)), "part long, blob binary, kinds array<int>, keys array<long>"), "asked")
        keys = asked.select("part", F.explode(F.arrays_zip("kinds", "keys")).alias("x")).select("part", F.col("x.kinds").alias("kind"), F.col("x.keys").alias("key"))
        found = keys.join(self.rest.hint("merge"), ["kind", "key"]).select("part", F.lit(None).cast("binary").alias("blob"), "kind", "key", "n")
        blobs = asked.select("part", "blob", F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long"))
        return found.union(blobs).repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(answered(self.model, make)), schema)


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, counts: Counts, sample_per_class: int, n_features: int) -> tuple[dict[str, float], float]:
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    have = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(have.values())
    if len(have) < 2:
        share = min(max(have.get(1, 0) / total if total else 0.0, 1e-9), 1 - 1e-9)
        return {}, float(np.log(share / (1 - share)))
    # a bounded sample: at most 2 * sample_per_class ids, so it may be broadcast
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class) for k in (0, 1)]
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for s in some for r in s.collect()], "doc_id long, toxic int")
    sample = docs.where("doc_id IS NOT NULL").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    work = Workspace(spark, "toxicity")
    sample = work.write(sample.select("text", "toxic"), "sample")  # read three times
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        share = min(max(have[1] / total, 1e-9), 1 - 1e-9)
        return {}, float(np.log(share / (1 - share)))
    a, b = F.col("n1"), F.col("n0")
    A, B = F.lit(float(sizes[1])), F.lit(float(sizes[0]))
    chi = (a * (B - b) - b * (A - a)) ** 2 / ((a + b) * (A + B - a - b) + 1.0)
    counted = counts.through(sample, "text", feature_counts, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    chosen = [r["feature"] for r in counted.where("n0 + n1 >= 3").orderBy(F.desc(chi), "feature").limit(n_features).collect()]
    index = spark.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})
    rows = counts.through(sample, "text", lambda model: indexed(model, index), "toxic int, at array<int>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["at"]))  # sums in one order, however the rows came
    y = np.array([r["toxic"] for r in rows], float)
    share = {k: have[k] / total / max(1, (y == k).sum()) for k in (0, 1)}
    w, base = fit([r["at"] for r in rows], y, np.where(y == 1, share[1], share[0]), len(chosen))
    return {f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-3}, float(base)


def models(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_per_class: int, n_features: int, model_trigrams: int, doc_id: str, text: str, label: str):
    """The rows to score, the character model of all texts, and the classifier as a broadcast of a size fixed by parameters."""
    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic"))
    work = Workspace(spark, "trigrams")
    counted = work.write(some.select("text").mapInArrow(trimmed(counter), "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")), "counts")
    counts = Counts(spark, work, counted, model_trigrams)
    return some, counts, spark.sparkContext.broadcast(learn(spark, some, known, counts, sample_per_class, n_features))


def toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_per_class: int = 6000, n_features: int = 4000, model_trigrams: int = 500_000,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> DataFrame:
    """doc_id, held_out, score, predicted and n_restored for each row; see the module's docstring."""
    some, counts, learned = models(spark, docs, labels, sample_per_class, n_features, model_trigrams, doc_id, text, label)
    return counts.through(some.withColumn("held_out", held_out("doc_id")), "text", lambda model: scorer(model, learned), "doc_id long, held_out boolean, score double, predicted int, n_restored long")


def keep_clean(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_per_class: int = 6000, n_features: int = 4000, model_trigrams: int = 500_000,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> DataFrame:
    """The rows of docs, with all their columns, that score below 0.5."""
    _, counts, learned = models(spark, docs, labels, sample_per_class, n_features, model_trigrams, doc_id, text, label)
    return counts.through(docs, text, lambda model: sieve(model, learned, text), docs.schema)
