"""Operator 10: secret scan by a linear-chain conditional random field.

Tokens (runs without white space) are tagged begin, inside or outside of a secret. A tag's
score sums weights of the token's shape, length, character mix and prefix, of the classes of
the tokens before and after it, and of the file's own features; tag pairs add transition
weights; Viterbi decodes. The field is trained here, by exact gradients of the
log-likelihood, on a bounded hash sample of rows whose tags come from the base patterns; each
window with a secret is learned again, without the words that announce it, with secrets of
other alphabets, lengths and prefixes, and with everyday long tokens (addresses, names,
times, numbers) that are none, so that shape alone can tell.

Most tokens are settled before decoding: where "outside" beats the other tags by more than
any transitions could win back, it is on the best path. Viterbi runs on what lies between.

Base spans always stay; a decoded span that touches none of them is added as kind ``crf``.
Offsets are code points. Null text: no spans. Empty tables, repeated rows and other columns
need no care: a row's result depends on its text alone.
"""

from __future__ import annotations

import re
import string
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from roadpulse.llm.common import in_share

SAMPLE_ROWS = 8000
WINDOW, PLAIN_EVERY, WINDOWS_A_ROW = 8, 6, 6
EPOCHS, RIDGE = 60, 0.02
CACHE_ENTRIES = 150_000
O, B, I = 0, 1, 2
KINDS = ("assign", "access", "hex", "crf")
# The base patterns and their shortest matches.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as [0-9a-f]+ with at least 16
_KEYWORD = re.compile(r"(?i)passw|secret|token|api_?key|credential|private|bearer|auth")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX_RUN, _HEX_MAP = b"x" * 16, bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
ALPHABETS = (string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits,
             string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_")
DRAWN_SIZES, REDRAWS = (18, 49), 4
_RUN = re.compile(r"(.)\1+")
EDGES = "\"'`,;()[]{}<>.!?:"
CLASSES = ("word", "keyword", "assigner", "keyword assigner", "number", "mixed", "edge")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out, low = [], text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _HEX_RUN in text.encode("utf-8", "replace").translate(_HEX_MAP):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def token_class(token: str) -> int:
    if token.isalpha():
        return 1 if _KEYWORD.search(token) else 0
    if _KEYWORD.search(token):
        return 3 if token[-1] in ":=" else 1
    if token in (":", "=", ":=", "=>"):
        return 2
    core = token.strip(EDGES)
    if core.isdigit():
        return 4
    return 0 if core.isalpha() or not core else 5


def token_features(token: str) -> list[str]:
    core = token.strip(EDGES)
    n = len(core)
    if core.isalpha() and core.islower():
        kinds = "l" * n
    else:
        kinds = "".join("d" if c.isdigit() else "U" if c.isupper() else "l" if c.isalpha() else "s" for c in core)
    shape = _RUN.sub(r"\1+", kinds)
    mix = "".join(k for k in "dUls" if k in kinds)
    out = [f"mix={mix}", f"len={min(n // 4, 10)}", f"mix,len={mix},{min(n // 4, 10)}"]
    if len(shape) <= 8:
        out.append("shape=" + shape)
    if n >= 12:
        out.append(f"variety={min(10 * len(set(core)) // n, 9)}")
        out.append(f"changes={min(10 * sum(a != b for a, b in zip(kinds, kinds[1:])) // n, 9)}")
        out.append("signs=" + "".join(sorted({c for c in core if not c.isalnum()}))[:4])
    if n >= 8 and not core.isalpha():
        out.append("head=" + core[:4])
    if _KEYWORD.search(token):
        out.append("keyword" + ("=" if re.search(r"[:=]", token) else ""))
    if re.fullmatch(r"[0-9a-f]{16,}", core):
        out.append("hex")
    return out


def file_features(tokens: list[str]) -> int:
    """A small number for the kind of file: how many tokens assign or open a bracket."""
    signs = sum(t in ("=", ":", "{", "}") or t.endswith(("{", ";", "=")) for t in tokens[:1] + tokens[1::7])
    return 0 if not signs else 1 if 40 * signs < len(tokens) else 2


class _Numbers(dict):
    """Token -> row of its scores, made on first sight."""

    def __init__(self, field):
        super().__init__()
        self.field = field

    def __missing__(self, token: str) -> int:
        self[token] = at = self.field.add(token)
        return at


class Field:
    """Weights of the field and the decoder."""

    def __init__(self, names: dict[str, int], token_w, before_w, after_w, file_w, pair_w):
        self.names, self.token_w = names, token_w
        self.before_w, self.after_w, self.file_w, self.pair_w = before_w, after_w, file_w, pair_w
        both = pair_w[:, :, None] + pair_w[None, :, :]  # previous, tag, next
        self.most = np.array([(both[:, x, :] - both[:, O, :]).max() for x in range(3)])
        self._reset()

    def _reset(self):
        self.index, self.plain, self.used = _Numbers(self), {}, 0
        self.unary, self.classes = np.zeros((1024, 3)), np.zeros(1024, np.int8)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "plain", "unary", "classes")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def add(self, token: str) -> int:
        core = token.strip(EDGES)
        if core.isalpha() and core[1:].islower() and not _KEYWORD.search(core):
            # plain words with equal features share a row
            n = len(core)
            alike = core[0].isupper(), min(n // 4, 10), min(10 * len(set(core)) // n, 9) if n >= 12 else -1, min(n, 3)
            row = self.plain.get(alike)
            if row is None:
                row = self.plain[alike] = self._row(token)
            return row
        return self._row(token)

    def _row(self, token: str) -> int:
        at = self.used
        self.used += 1
        if at == len(self.classes):
            self.unary = np.concatenate([self.unary, np.zeros_like(self.unary)])
            self.classes = np.concatenate([self.classes, np.zeros_like(self.classes)])
        known = [self.names[f] for f in token_features(token) if f in self.names]
        self.unary[at] = self.token_w[known].sum(axis=0)
        self.classes[at] = token_class(token)
        return at

    def scores(self, tokens: list[str]) -> np.ndarray:
        if len(self.index) > CACHE_ENTRIES:
            self._reset()
        index = self.index
        at = [index[t] for t in tokens]
        kinds = np.concatenate([[6], self.classes[at], [6]])
        return self.unary[at] + self.before_w[kinds[:-2]] + self.after_w[kinds[2:]] + self.file_w[file_features(tokens)]

    def tags(self, tokens: list[str]) -> np.ndarray | None:
        """The best tag of every token, or None if all are outside."""
        if not tokens:
            return None
        u = self.scores(tokens)
        unsettled = (u[:, O, None] - u[:, 1:] < self.most[None, 1:]).any(axis=1)
        if not unsettled.any():
            return None
        out = np.zeros(len(tokens), np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], unsettled.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            out[a:b] = self._viterbi(u[a:b], a > 0, b < len(tokens))
        return out if out.any() else None

    def _viterbi(self, u: np.ndarray, after_outside: bool, before_outside: bool) -> list[int]:
        score = u[0] + (self.pair_w[O] if after_outside else 0)
        back = []
        for row in u[1:]:
            options = score[:, None] + self.pair_w
            back.append(options.argmax(axis=0))
            score = options.max(axis=0) + row
        if before_outside:
            score = score + self.pair_w[:, O]
        path = [int(score.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        base = base_spans(text)
        tokens = text.split()
        tags = self.tags(tokens)
        if tags is None:
            return base
        places = [m.span() for m in re.finditer(r"\S+", text)]
        if len(places) != len(tokens):  # split() also parts at some control characters
            places, at = [], 0
            for t in tokens:
                at = text.index(t, at)
                places.append((at, at + len(t)))
                at += len(t)
        out, i = list(base), 0
        while i < len(tags):
            if tags[i] == O:
                i += 1
                continue
            j = i + 1
            while j < len(tags) and tags[j] == I:
                j += 1
            core = tokens[i].lstrip(EDGES)
            start = places[i][0] + len(tokens[i]) - len(core)
            end = places[j - 1][0] + len(tokens[j - 1].rstrip(EDGES))
            if end > start and not any(a < end and start < b for a, b, _ in base):
                out.append((start, end, "crf"))
            i = j
        return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- training -------------------------------------------------------------------------

def tagged_windows(text: str, plain: bool) -> list[tuple[list[str], list[int], int]]:
    """Windows of tokens around base spans (and some plain ones) with their tags."""
    spans = base_spans(text)
    if not spans and not plain:
        return []
    found = [(m.group(), *m.span()) for m in re.finditer(r"\S+", text)]
    if not found:
        return []
    tokens = [t for t, _, _ in found]
    tags = [O] * len(tokens)
    starts = np.array([a for _, a, _ in found])
    centres = []
    for a, b, kind in spans:
        secret = b - len(ASSIGN.match(text, a)[2]) if kind == "assign" else a  # the keyword itself is no secret
        i = int(np.searchsorted(starts, secret, side="right")) - 1
        centres.append(i)
        while i < len(tokens) and starts[i] < b:
            tags[i] = B if starts[i] <= secret or tags[i] == B else I
            i += 1
    if plain:
        centres += [len(tokens) // 3, 2 * len(tokens) // 3]
    kind = file_features(tokens)
    return [(tokens[max(0, c - WINDOW):c + WINDOW + 1], tags[max(0, c - WINDOW):c + WINDOW + 1], kind)
            for c in sorted(set(centres))[:WINDOWS_A_ROW]]


def redrawn(token: str, draw: int) -> str:
    """The token with another secret after its last assigner: alphabet, length and prefix drawn by hash."""
    rng = np.random.default_rng([zlib.crc32(token.encode()), draw])
    at = max(token.rfind("="), token.rfind(":")) + 1
    stop = len(token.rstrip(EDGES))
    at = 0 if at >= stop else at
    at += len(token[at:stop]) - len(token[at:stop].lstrip(EDGES))
    signs = ALPHABETS[int(rng.integers(len(ALPHABETS)))]
    drawn = "".join(signs[i] for i in rng.integers(0, len(signs), int(rng.integers(*DRAWN_SIZES))).tolist())
    letters = "".join(string.ascii_letters[i] for i in rng.integers(0, 26, int(rng.integers(2, 5))).tolist())
    return token[:at] + ("", "", letters + "_", letters + "-")[int(rng.integers(4))] + drawn + token[stop:]


def everyday(tokens: list[str], draw: int) -> str:
    """A long token that is no secret, made of the window's own words: address, name, path, time or number."""
    rng = np.random.default_rng([zlib.crc32(" ".join(tokens).encode()), draw])
    words = [w for w in (t.strip(EDGES).lower() for t in tokens) if w.isalpha()] or ["word"]
    a, b, c = (words[i][:k] for i, k in zip(rng.integers(0, len(words), 3).tolist(), rng.integers(3, 10, 3).tolist()))
    n = [int(x) for x in rng.integers(10, 60, 8)]
    forms = (f"https://www.{a}.com/{b}/{c}-{n[0]}", f"{a}.{b}{n[0]}@{c}{n[1] % 10}.example.com", f"{a}_{b}_{c}", f"{a}-{b}-{c}{n[0]}",
             f"{a}/{b}/{c}.{b[:3]}", f"20{n[0]}-{n[1] % 12 + 1:02}-{n[2] % 28 + 1:02}T{n[3] % 24:02}:{n[4]}:{n[5]}", "".join(map(str, n[:7])),
             f"{a}{b.title()}{c.title()}{n[0]}", f"{a.upper()}_{b.upper()}_{n[0]}", f"{a}.{b}({c},{n[0]})",
             "-".join(map(str, n[:6])), f"{a}{b.title()}{c.title()}")
    return forms[draw % len(forms)]


def _varied(window: tuple[list[str], list[int], int], number: int) -> list[tuple[list[str], list[int], int]]:
    """The window with redrawn secrets, and with everyday tokens in their place, without announcing words."""
    tokens, gold, kind = window
    quiet = ["the" if not g and token_class(t) in (1, 2, 3) else t for t, g in zip(tokens, gold)]
    out = [([redrawn(t, d) if g else t for t, g in zip(quiet, gold)], gold, kind) for d in range(REDRAWS)]
    first = number * REDRAWS
    return out + [([everyday(tokens, d) if g else t for t, g in zip(quiet, gold)], [O] * len(gold), kind) for d in range(first, first + REDRAWS)]


def fit(windows: list[tuple[list[str], list[int], int]]) -> Field:
    """Maximum-likelihood weights by gradient steps with adaptive rates."""
    marked = [w for w in windows if any(w[1])]
    windows = windows + [v for i, w in enumerate(marked) for v in _varied(w, i)]
    names: dict[str, int] = {}
    length, width = 2 * WINDOW + 1, 10
    n = len(windows)
    feats = np.full((n, length, width), -1)
    before, after = np.full((n, length), 6), np.full((n, length), 6)
    tags, mask, files = np.zeros((n, length), int), np.zeros((n, length), bool), np.zeros(n, int)
    for w, (tokens, gold, kind) in enumerate(windows):
        classes = [token_class(t) for t in tokens]
        m = len(tokens)
        before[w, 1:m], after[w, :m - 1] = classes[:-1], classes[1:]
        tags[w, :m], mask[w, :m], files[w] = gold, True, kind
        for i, t in enumerate(tokens):
            for j, f in enumerate(token_features(t)[:width]):
                feats[w, i, j] = names.setdefault(f, len(names))
    k = len(names)
    sizes = [k + 1, len(CLASSES), len(CLASSES), 3, 3]
    bounds = np.cumsum([0, *sizes])
    weights = np.zeros((bounds[-1], 3))
    m1, m2 = np.zeros_like(weights), np.zeros_like(weights)
    feats[feats < 0] = k
    rows = np.arange(n)

    def split(x):
        return [x[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    for epoch in range(1, (EPOCHS if n else 0) + 1):
        token_w, before_w, after_w, file_w, pair_w = split(weights)
        u = token_w[feats].sum(axis=2) + before_w[before] + after_w[after] + file_w[files][:, None, :]
        fwd, bwd = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        fwd[:, 0] = u[:, 0]
        for i in range(1, length):
            step = np.logaddexp.reduce(fwd[:, i - 1, :, None] + pair_w, axis=1) + u[:, i]
            fwd[:, i] = np.where(mask[:, i, None], step, fwd[:, i - 1])
        for i in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(pair_w + (u[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
            bwd[:, i] = np.where(mask[:, i + 1, None], step, bwd[:, i + 1])
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None])
        error = (np.eye(3)[tags] - p) * mask[:, :, None]
        gradient = np.zeros_like(weights)
        g_token, g_before, g_after, g_file, g_pair = split(gradient)
        for c in range(3):
            g_token[:, c] = np.bincount(feats.ravel(), np.repeat(error[:, :, c].ravel(), width), minlength=k + 1)
            g_before[:, c] = np.bincount(before.ravel(), error[:, :, c].ravel(), minlength=len(CLASSES))
            g_after[:, c] = np.bincount(after.ravel(), error[:, :, c].ravel(), minlength=len(CLASSES))
            g_file[:, c] = np.bincount(files, error[:, :, c].sum(axis=1), minlength=3)
        both = mask[:, 1:]
        joint = np.exp(fwd[:, :-1, :, None] + pair_w + (u[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        g_pair -= (joint * both[:, :, None, None]).sum(axis=(0, 1))
        np.add.at(g_pair, (tags[:, :-1][both], tags[:, 1:][both]), 1.0)
        gradient = gradient / max(n, 1) - RIDGE / max(n, 1) * weights
        g_token[k] = 0
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient ** 2
        weights = weights + 0.3 * (m1 / (1 - 0.9 ** epoch)) / (np.sqrt(m2 / (1 - 0.99 ** epoch)) + 1e-6)
        weights[k] = 0
    if not n:
        weights[:, O] = 1.0
    token_w, before_w, after_w, file_w, pair_w = split(weights)
    del rows
    return Field(names, token_w[:k] if k else np.zeros((1, 3)), before_w, after_w, file_w, pair_w)


def train(docs: DataFrame, limit: int = SAMPLE_ROWS) -> Field:
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    share = min(1.0, limit / max(docs.count(), 1))
    sample = texts.where(in_share(F.xxhash64("text"), share)).withColumn("plain", F.pmod(F.hash("text"), F.lit(PLAIN_EVERY)) == 0)

    def run(batches):
        kind = pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32()
        for batch in batches:
            rows = [w for t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in tagged_windows(t, p)]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kind)], names=["tokens", "tags", "file"])
    # bounded: at most WINDOWS_A_ROW windows of 17 tokens from each sampled row
    found = sample.mapInArrow(run, "tokens array<string>, tags array<int>, file int").distinct().collect()
    return fit(sorted((list(r["tokens"]), list(r["tags"]), r["file"]) for r in found))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (all base spans) and spans (all), as text."""
    field = train(docs)

    @pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base string, spans string")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = field.spans(text)
            base = [s for s in spans if s[2] != "crf"]
            rows.append((*(sum(s[2] == k for s in base) for k in KINDS[:3]),
                         *(",".join(f"{k}:{a}:{b}" for a, b, k in found) for found in (base, spans))))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base", "spans"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), find(F.coalesce("text", F.lit(""))).alias("f")).select("doc_id", "f.*")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` and n_chars, where present, recounted.

    Of an assignment only the value goes. A null text stays null.
    """
    field = train(docs)

    @pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for a, b, kind in field.spans(text):
                if kind == "assign":
                    a = b - len(ASSIGN.match(text, a)[2])
                if b <= at:
                    continue
                out += [text[at:a], mark] if a >= at else []
                at = b
            return "".join(out) + text[at:]
        return texts.map(one)
    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
