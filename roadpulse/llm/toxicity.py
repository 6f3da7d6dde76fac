"""Operator 9: toxicity of texts behind a noisy channel.

Written words reach the reader through a channel that swaps letters for look-alikes,
stretches them and puts separators between them. A suspicious token becomes a lattice: each
character offers the letters it may stand for, a run may shrink, a separator may vanish.
Viterbi picks the reading that is likeliest under a letter-trigram model and the channel's
costs; an unsuspicious token has one path and is its own reading. Short tokens in a row make
one more lattice, in which a space may vanish or end a word. Restored words are scored
by a lexicon of words and word beginnings with their log-odds, and a logistic regression of
two numbers (strongest hit, count of hits) gives the score.

The letter trigrams are counted over all documents; lexicon and regression are learned from
at most ``SAMPLE_ROWS`` labelled training rows, chosen by hash. Texts alone enter a score. Null and empty texts are scored as texts without hits. Repeated rows
get equal scores; without training labels every score is 0. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from roadpulse.llm.common import in_share, pieces
from roadpulse.session import settle

SAMPLE_ROWS = 20_000
PURITY, LEAST_DOCS = 0.9, 4
CACHE_ENTRIES = 200_000
# Letters that a character is used for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = set(".-_*~'`^/\\,: ")
OUTER = '.,;:!?"\'()[]{}<>#*$%&|~`«»“”…-_'
_POINTS = '.,;:?"\''
SWAP, DROP, SHRINK, DOUBLE = -2.0, -1.0, -0.5, -1.5
_LETTERS = set("abcdefghijklmnopqrstuvwxyz")
# Short tokens in a row, of at most PART signs each, are also read over their spaces.
PART, KNOWN = 5, 3.0
_SIGN = "[a-z%s]" % re.escape("".join(sorted(set(LOOKS_LIKE) | SEPARATORS - {" "} | set(";?!\"()"))))
_WINDOW = re.compile(rf"(?<!\S){_SIGN}{{1,{PART}}}(?:\s+{_SIGN}{{1,{PART}}}(?!\S))+")
_CODED = re.compile("[a-z%s]+" % re.escape("".join(sorted(set(LOOKS_LIKE) | SEPARATORS))))
_LETTER, _SIGN_INSIDE, _TRIPLE = re.compile("[a-z]"), re.compile("[^a-z]"), re.compile(r"([a-z])\1\1")
_GAP, _REPEATED, _NO_LETTER = re.compile(r"\s+"), re.compile(r"([a-z])\1+"), re.compile("[^a-z\0]+")
_CLOSING = re.compile(r"""(?<=\S)[.,;:?!"')]+(?=\s|$)|(?<!\S)["'(]+(?=[a-z])""")
# Look-alikes as one sign (l as i, which some of them share with it), or none.
_CANON = str.maketrans({c: "i" if "i" in to or "l" in to else to for c, to in LOOKS_LIKE.items()} | {"l": "i"})
_BARE = str.maketrans({"l": "i"})


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of a hash sample of the labelled rows that may be learned from."""
    key = F.col("doc_id").cast("bigint")
    wanted = labels.where("toxic is not null").select(key.alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.crc32(F.col("l_id").cast("string")) % 5 != 0).distinct()
    share = min(1.0, limit / max(wanted.count(), 1))
    chosen = wanted.where(in_share(F.xxhash64("l_id"), share))
    # a sample of bounded size, so it may be broadcast
    rows = docs.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("text", "toxic")


def features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in range(4, min(len(word) - 1, 7)))]


class Reader:
    """Restores tokens and looks them up; remembers what it has seen."""

    def __init__(self, trigrams: dict[str, float], floor: float, lexicon: dict[str, float]):
        self.trigrams, self.floor, self.lexicon = trigrams, floor, lexicon
        self.weights: dict[str, float] = {}
        self.windows: dict[str, tuple[float, ...]] = {}
        self.heads = {f[1:5] for f in lexicon if f[0] == "^"}
        self.key = uuid.uuid4().hex
        self.beginnings = {f[:n] for f in lexicon if f[0] != "^" for n in range(1, len(f) + 1)}
        self.starts: dict[int, set[str]] = {}
        for start in {_squeezed(f, _CANON)[:PART + 1] for f in lexicon}:
            if len(start) > 1:  # one letter lies over no gap
                self.starts.setdefault(len(start), set()).add(start)
        self.table: np.ndarray | None = None

    def suspicious(self, word: str) -> bool:
        return _CODED.fullmatch(word) is not None and _LETTER.search(word) is not None and (
            _TRIPLE.search(word) is not None or _SIGN_INSIDE.search(word) is not None)

    def restore(self, token: str) -> str:
        """The likeliest reading of a token: a Viterbi search over its lattice.

        A gap of spaces vanishes or ends a word; where there is one, a state also carries
        the word begun so far while a lexicon word begins so, and a whole one gains ``KNOWN``.
        """
        spaced = " " in token
        best = {0: {("^^", "" if spaced else None): (0.0, None)}}
        for i in range(len(token)):
            states = best.pop(i, None)
            if not states:
                continue
            c, run = token[i], 1
            while i + run < len(token) and token[i + run] == c:
                run += 1
            if c == " ":
                steps = [(i + run, "", DROP * run), (i + run, " ", 0.0)]
            else:
                letters = ([(c, 0.0)] if c in _LETTERS else []) + [(x, SWAP) for x in LOOKS_LIKE.get(c, "")]
                steps = [(i + 1, x, cost) for x, cost in letters]
                if run > 1:
                    steps += [(i + run, x, cost + SHRINK) for x, cost in letters] + [(i + run, x + x, cost + DOUBLE) for x, cost in letters]
                if c in SEPARATORS or c not in _LETTERS:
                    steps.append((i + 1, "", DROP if c in SEPARATORS else 3 * SWAP))
            for end, added, cost in steps:
                after = best.setdefault(end, {})
                for (last, begun), (score, path) in states.items():
                    total, context = score + cost, last
                    if added == " ":
                        if context == "^^":  # nothing but dropped signs so far
                            continue
                        total, context, begun = self._ended(total, context, begun), "^^", ""
                    else:
                        for x in added:
                            total += self.trigrams.get(context + x, self.floor)
                            context = context[1] + x
                        if added and begun is not None:
                            begun = begun + added if begun + added in self.beginnings else None
                    if (context, begun) not in after or after[context, begun][0] < total:
                        after[context, begun] = (total, (path, added) if added else path)
        ends = best.get(len(token), {})
        if not ends:
            return token
        path = max(((self._ended(s, c, w), p) for (c, w), (s, p) in ends.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            path, added = path
            out.append(added)
        return "".join(reversed(out))

    def _ended(self, score: float, context: str, begun: str | None) -> float:
        return score + self.trigrams.get(context + "$", self.floor) + (KNOWN if begun and begun in self.lexicon else 0.0)

    def found(self, word: str) -> set[str]:
        return {f for f in features(word) if f in self.lexicon}

    def readings(self, token: str) -> list[str]:
        word = token.strip(OUTER)
        out = [word]
        bare = token.strip(_POINTS)
        if self.suspicious(bare):
            out.append(self.restore(bare))
        return out

    def weight(self, token: str) -> float:
        known = self.weights.get(token)
        if known is None:
            if len(self.weights) > CACHE_ENTRIES:
                self.weights.clear()
            bare = token.strip(_POINTS)
            if bare.isalpha() and bare.isascii() and not _TRIPLE.search(bare):   # its own only reading
                if bare[:4] in self.heads:
                    known = max([self.lexicon[f] for f in features(bare) if f in self.lexicon], default=0.0)
                else:
                    known = self.lexicon.get(bare, 0.0)
            else:
                known = max((self.lexicon[f] for w in self.readings(token) for f in self.found(w)), default=0.0)
            self.weights[token] = known
        return known

    def may_hide(self, windows: list[str]) -> set[int]:
        """Which windows may hold a lexicon word over a gap: look-alikes as one sign, or dropped,
        repeated letters once; not where all of it is inside a token. Saves decoding the others."""
        if self.table is None:
            self.table = np.zeros(27 ** 4, bool)
            for start in set().union(*self.starts.values()):
                code, width = 0, 27 ** max(0, 4 - len(start))
                for c in start[:4]:
                    code = code * 27 + ord(c) - 96
                self.table[code * width:(code + 1) * width] = True
        out: set[int] = set()
        joined, before = "\0".join(windows), None
        for signs in (_CANON, _BARE):
            c = _squeezed(joined, signs)
            if c == before:
                break
            before = c
            codes = np.frombuffer(c.encode() + bytes(3), np.uint8).astype(np.int32)
            codes -= np.where(codes, 96, 0).astype(np.int32)
            at = np.flatnonzero(self.table[((codes[:-3] * 27 + codes[1:-2]) * 27 + codes[2:-1]) * 27 + codes[3:]])
            hits: dict[int, dict[str, int]] = {}
            for i, window in zip(at.tolist(), np.searchsorted(np.flatnonzero(codes[:-3] == 0), at).tolist()):
                for size, starts in self.starts.items():
                    start = c[i:i + size]
                    if start in starts:
                        found = hits.setdefault(window, {})
                        found[start] = found.get(start, 0) + 1
            for window, found in hits.items():
                apart = _squeezed("\0".join(windows[window].split()), signs)
                if any(n > apart.count(x) for x, n in found.items()):
                    out.add(window)
        return out

    def spelled(self, window: str) -> tuple[float, ...]:
        """Weights of the words that short tokens make when read over their spaces."""
        known = self.windows.get(window)
        if known is None:
            if len(self.windows) > CACHE_ENTRIES:
                self.windows.clear()
            known = ()
            if any(c in _LETTERS for c in window):
                apart = Counter(w for t in window.split() for w in self.readings(t))
                words = Counter(self.restore(_CLOSING.sub(_blank, window)).split()) - apart
                known = tuple(w for w in (max((self.lexicon[f] for f in self.found(x)), default=0.0) for x in words.elements()) if w)
            self.windows[window] = known
        return known

    def evidence(self, text: str) -> tuple[float, float]:
        text = text.lower()
        tokens = text.split()
        known = list(map(self.weights.get, tokens))
        if None in known:
            known = [self.weight(t) if w is None else w for t, w in zip(tokens, known)]
        hits = list(filter(None, known))
        windows = _WINDOW.findall(text) if self.lexicon else []
        if windows:
            for i in sorted(self.may_hide(windows)):
                hits += self.spelled(_GAP.sub(_gap, windows[i]))
        return (max(hits), math.log1p(len(hits))) if hits else (0.0, 0.0)


_KEPT: dict[str, Reader] = {}


def _kept(reader: Reader) -> Reader:
    """The reader of this Python worker: what it has seen in one task serves the next."""
    if reader.key not in _KEPT:
        _KEPT.clear()
        _KEPT[reader.key] = reader
    return _KEPT[reader.key]


def _squeezed(text: str, signs: dict) -> str:
    return _REPEATED.sub(r"\1", _NO_LETTER.sub("", text.translate(signs)))


def _gap(found) -> str:
    return " " if len(found[0]) == 1 else "  "


def _blank(found) -> str:
    return " " * len(found[0])


def _table(total: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])


def _summed(rows: DataFrame, run) -> DataFrame:
    """Sum the (key, n) pairs that ``run`` makes of batches of texts."""
    return rows.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(key, n): letter trigrams of the words of all documents."""
    def run(batches):
        words, total = Counter(), Counter()
        for piece in pieces(batches):
            for text in piece.column(0).to_pylist():
                words.update(text.lower().split())
            if len(words) > CACHE_ENTRIES:
                total.update(_letters(words))
                words.clear()
        total.update(_letters(words))
        yield _table(total)
    return _summed(docs, run)


def _letters(words: Counter) -> Counter:
    """Trigrams of the words of letters alone, each between ``^^`` and ``$``."""
    bare = [(w.strip(OUTER), n) for w, n in words.items()]
    bare = [(w, n) for w, n in bare if w.isascii() and w.isalpha()]
    if not bare:
        return Counter()
    signs = np.frombuffer("".join([f"^^{w}$" for w, _ in bare]).encode(), np.uint8).astype(np.int32)
    many = np.repeat([n for _, n in bare], [len(w) + 3 for w, _ in bare])
    code = np.where(signs == ord("^"), 26, np.where(signs == ord("$"), 27, signs - ord("a")))
    inside = (code[:-2] != 27) & (code[1:-1] != 27)
    total = np.bincount(((code[:-2] * 28 + code[1:-1]) * 28 + code[2:])[inside], many[:-2][inside])  # exact to 2 ** 53
    name = "abcdefghijklmnopqrstuvwxyz^$"
    return Counter({name[k // 784] + name[k // 28 % 28] + name[k % 28]: int(total[k]) for k in np.flatnonzero(total).tolist()})


def _seen(rows: DataFrame) -> DataFrame:
    """(key, n): in how many different texts a word or beginning is, however the rows lie in partitions."""
    def run(batches):
        total = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update({f for w in {w.strip(OUTER) for w in text.lower().split()} if len(w) > 2 for f in features(w)})
        yield _table(total)
    return _summed(rows.select("text").distinct(), run)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """All words and beginnings that speak for toxicity, of the (bounded) labelled rows.

    A beginning counts where it says more than any single word under it, and only the
    longest of equally common ones.
    """
    toxic = settle(_seen(rows.where("toxic = 1")), "toxic_words")
    clean = _seen(rows.where("toxic = 0")).select(F.col("key").alias("c_key"), F.col("n").alias("against"))
    beginning = F.col("key").startswith("^")
    sizes = F.when(F.length("key") >= 6, F.sequence(F.lit(4), F.least(F.length("key") - 2, F.lit(6))))
    under = toxic.where(~beginning).select(F.explode(sizes).alias("size"), "key", "n").select(
        F.expr("concat('^', substr(key, 1, size))").alias("b_key"), F.col("n").alias("under"), F.lit(None).cast("bigint").alias("longer"))
    longer = toxic.where(beginning).select(
        F.expr("substr(key, 1, length(key) - 1)").alias("b_key"), F.lit(None).cast("bigint").alias("under"), F.col("n").alias("longer"))
    rivals = under.unionByName(longer).groupBy("b_key").agg(F.max("under").alias("under"), F.max("longer").alias("longer"))
    share, other = F.col("n") / n_toxic, F.coalesce("against", F.lit(0)) / max(n_clean, 1)
    counted = toxic.where(F.col("n") >= LEAST_DOCS).join(clean, F.col("key") == F.col("c_key"), "left").where(share / (share + other) >= PURITY)
    kept = counted.join(rivals, F.col("key") == F.col("b_key"), "left").where(
        ~beginning | ((F.col("n") >= 1.5 * F.coalesce("under", F.lit(0))) & (F.coalesce("longer", F.lit(0)) < 0.9 * F.col("n"))))
    weight = F.log((share + 0.5 / n_toxic) / (other + 0.5 / max(n_clean, 1)))
    return {r["key"]: r["weight"] for r in kept.select("key", weight.alias("weight")).collect()}


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> tuple[Reader, np.ndarray]:
    rows = settle(training_rows(docs, labels, limit), "toxic_sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Reader({}, 0.0, {}), np.array([-30.0, 0.0, 0.0])
    grams = {r["key"]: r["n"] for r in trigram_counts(docs).collect()}  # of 28 signs: at most 22 000
    contexts = Counter()
    for g, n in grams.items():
        contexts[g[:2]] += n
    trigrams = {g: math.log((n + 0.1) / (contexts[g[:2]] + 2.8)) for g, n in grams.items()}
    reader = Reader(trigrams, math.log(1e-4), lexicon(rows, n_toxic, n_clean))

    def evidence(batches):
        kept = _kept(reader)
        for batch in batches:
            pairs = [kept.evidence(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64()),
                                   batch.column(1)], names=["a", "b", "toxic"])
    table = rows.mapInArrow(evidence, "a double, b double, toxic int").groupBy("a", "b", "toxic").agg(
        F.count(F.lit(1)).alias("n")).orderBy("a", "b", "toxic").collect()  # of a bounded sample
    x = np.repeat(np.array([(r["a"], r["b"]) for r in table]), [r["n"] for r in table], axis=0)
    y = np.repeat(np.array([float(r["toxic"]) for r in table]), [r["n"] for r in table])
    return reader, _logistic(x, y)


def scorer(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS):
    """A column function text -> probability of being toxic, learned from the labelled rows."""
    reader, weights = learn(docs, labels, limit)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        kept = _kept(reader)
        pairs = np.array([kept.evidence(t or "") for t in texts], float).reshape(-1, 2)
        return pd.Series(1 / (1 + np.exp(-np.clip(weights[0] + pairs @ weights[1:], -30, 30))))
    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    score = scorer(docs, labels)
    key = F.col("doc_id").cast("bigint")
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
                       score(F.coalesce("text", F.lit(""))).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5, with all their columns."""
    score = scorer(docs, labels)
    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) < 0.5)
