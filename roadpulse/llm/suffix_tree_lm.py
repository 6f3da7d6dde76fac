"""Operator 5: scoring texts by a probabilistic suffix tree.

A text is its words and one end; words not seen in training are one symbol more, as they
are for the base score. A token is predicted from the tokens before it: the tree's contexts
are runs of up to ``REACH`` preceding tokens of the same text, whose start is a token too.
A run of tokens enters the tree if it occurs at least ``LEAST`` times in the training texts,
however large these are; a context stays only if the distribution of what follows diverges from
that after its longest kept suffix by ``GAIN`` nats over all its occurrences. A token is
predicted by the longest suffix of what precedes it that is a kept context: the runs in the
tree keep their counts, all other mass and ``PRIOR`` occurrences are spread as the parent
context has it.

The root, the empty context, is the word counts. The mass that Witten and Bell take from
counts, one for every distinct word, is spread by spelling: a seen word has
(count + V * spelling) / (N + V), and the new-word symbol gets what the spellings of seen
words leave. Spelling is a suffix tree again, of bytes: contexts of up to ``DEPTH`` preceding
bytes (the word's start is one) with their next-byte distributions. A context has to occur
in ``SUPPORT`` of all training bytes, so a level holds at most 1/``SUPPORT`` of them, and
stays by the same ``GAIN``. It learns from every distinct training word.

The tree of tokens is nowhere in one place. Documents are dealt to chunks by hash; a chunk
knows its runs by 64-bit hashes and asks, a length at a time, how often each of its distinct
runs occurs everywhere, of those runs only whose two parts occur ``LEAST`` times. Of the runs
that do, one chunk each sends context, count and what the parent context says; where a context's
runs meet it is decided whether it stays, and the chunks get back the mass it leaves to its
parent. After ``REACH`` lengths a chunk has all it needs to score its own texts. What travels are
distinct runs, in sorted lists of differences, and lists without keys as answers.

Words are counted the same way: a chunk asks for each of its distinct words once, totals come
back per chunk, packed. No count table and no run is broadcast, and a word in every document
sends one number per chunk; what is broadcast is the spelling tree.

Inputs: rows with doc_id and text; other columns are ignored. A null text is empty: its
only token is the end. A row is held out if crc32 of its id's text modulo 10 is 0; a null id
is a training row. Repeated rows are learned and scored repeatedly. With nothing to learn
from every token is new and certain: both scores are 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from roadpulse.llm.common import id_and_text, mix, pieces
from roadpulse.session import settle

DEPTH, SUPPORT, GAIN, PRIOR = 4, 1e-4, 12.0, 4.0
REACH, LEAST, BLOCK = 3, 2, 1_000_000  # BLOCK: tokens of a chunk packed together
BITS, START, END = 15, 1, 2  # a token of a ``TokenTree`` is a number of 15 bits: 0 for rare words, others from 3
STOP = 10  # the byte that ends and starts a word; never inside one
_PACKED = "bucket int, chunk int, words binary, counts binary"


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _rows(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                           names=["bucket", "chunk", "words", "counts"])


def _counted(words: list[bytes], counts: list[int]) -> tuple[bytes, bytes]:
    return _zip(b" ".join(words)), _zip(np.array(counts, np.int64).tobytes())


def _list(words: bytes) -> list[bytes]:
    return _unzip(words).split()


def _requests(buckets: int):
    """A chunk's distinct words with their training counts, packed by bucket."""
    def run(batches):
        seen: dict[int, Counter] = {}
        for batch in batches:
            for chunk, learn, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                counts = seen.setdefault(chunk, Counter())
                words = _unzip(text.as_py()).split()
                counts.update(words if learn else dict.fromkeys(words, 0))
        for chunk, counts in seen.items():
            by = [[] for _ in range(buckets)]
            for word in counts:
                by[zlib.crc32(word) % buckets].append(word)
            yield _rows([(i, chunk, *_counted(words, [counts[w] for w in words])) for i, words in enumerate(by) if words])
    return run


def _totals(batches):
    """Answers for the chunks (their words with corpus counts); chunk -1: every trained word once."""
    asked = [(r[0], r[1], _list(r[2]), np.frombuffer(_unzip(r[3]), np.int64)) for b in batches
             for r in zip(*(c.to_pylist() for c in b.columns))]
    total: Counter = Counter()
    for _, _, words, counts in asked:
        for word, n in zip(words, counts.tolist()):
            total[word] += n
    for bucket, chunk, words, _ in asked:
        yield _rows([(bucket, chunk, *_counted(words, [total[w] for w in words]))])
    known = [(w, n) for w, n in total.items() if n]
    if known:
        yield _rows([(0, -1, *_counted([w for w, _ in known], [n for _, n in known]))])


def _spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each word closed by ``STOP``; and for every byte its place in its word."""
    data = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    stops = np.flatnonzero(data == STOP)
    starts = np.concatenate([[0], stops[:-1] + 1])
    return data, np.arange(len(data)) - np.repeat(starts, stops - starts + 1)


def _contexts(data: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """Code of the ``depth`` bytes before each byte, the word's start counting as one; -1 where longer than that."""
    code = np.zeros(len(data), np.int64)
    for back in range(depth, 0, -1):
        before = np.full(len(data), STOP, np.int64)
        before[back:] = data[:-back]
        code = (code << 8) | np.where(place >= back, before, STOP)
    return np.where(place + 1 >= depth, code | (depth << 40), -1)


def _grams(batches):
    """(context code, next byte, n) over distinct words, plus the sums N and V under code -2 and -3."""
    tokens = types = 0
    for batch in batches:
        for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = _list(words)
            tokens += int(np.frombuffer(_unzip(counts), np.int64).sum())
            types += len(words)
            for at in range(0, len(words), 200_000):
                data, place = _spelling(words[at:at + 200_000])
                for depth in range(DEPTH + 1):
                    code = _contexts(data, place, depth) if depth else np.zeros(len(data), np.int64)
                    key, n = np.unique((code[code >= 0] << 8) | data[code >= 0], return_counts=True)
                    yield _gram_rows(key >> 8, key & 255, n)
    yield _gram_rows(np.array([-2, -3]), np.array([0, 0]), np.array([tokens, types]))


def _gram_rows(code, following, n) -> pa.RecordBatch:
    return pa.record_batch([pa.array(code.astype(np.int64)), pa.array(following.astype(np.int16)), pa.array(n.astype(np.int64))],
                           names=["code", "following", "n"])


class SuffixTree:
    """Kept contexts as sorted arrays: context -> (parent, rest mass), (context, byte) -> log10 probability."""

    def __init__(self, code: np.ndarray, following: np.ndarray, n: np.ndarray):
        grouped: dict[int, list[int]] = {}
        for i, c in enumerate(code.tolist()):
            grouped.setdefault(c, []).append(i)
        root = np.full(256, 0.5)
        if 0 in grouped:
            np.add.at(root, following[grouped[0]], n[grouped[0]])
        self.root = root / root.sum()
        dense = {0: self.root}
        parents, rest, entries = {}, {}, []
        for c in sorted(grouped):
            if c == 0:
                continue
            depth, bytes_ = c >> 40, c & ((1 << 40) - 1)
            parent = next(((d << 40 | bytes_ & ((1 << 8 * d) - 1)) if d else 0 for d in range(depth - 1, -1, -1)
                           if d == 0 or (d << 40 | bytes_ & ((1 << 8 * d) - 1)) in dense))
            rows = grouped[c]
            counts, total = n[rows].astype(float), float(n[rows].sum())
            p, q = counts / total, dense[parent][following[rows]]
            if float((counts * np.log(p / q)).sum()) < GAIN:
                continue
            full = PRIOR * dense[parent]
            full[following[rows]] += counts
            dense[c] = full / full.sum()
            parents[c], rest[c] = parent, math.log10(PRIOR / (total + PRIOR))
            entries.append((np.full(len(rows), c) << 8 | following[rows], np.log10(dense[c][following[rows]])))
        self.codes = np.array(sorted(parents), np.int64)
        self.parents = np.searchsorted(self.codes, np.array([parents[c] for c in self.codes.tolist()], np.int64))
        self.parents[[parents[c] == 0 for c in self.codes.tolist()]] = -1
        self.rest = np.array([rest[c] for c in self.codes.tolist()])
        keys = np.concatenate([e[0] for e in entries]) if entries else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order].astype(np.int64)
        self.logs = np.concatenate([e[1] for e in entries])[order] if entries else np.zeros(0)
        self.root = np.log10(self.root)

    def score(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of spelling each word."""
        if not words:
            return np.zeros(0)
        data, place = _spelling(words)
        state = np.full(len(data), -1)
        for depth in range(DEPTH, 0, -1):
            if not len(self.codes):
                break
            open_ = np.flatnonzero(state < 0)
            code = _contexts(data, place, depth)[open_]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            state[open_[hit]] = at[hit]
        out = np.zeros(len(data))
        todo = np.arange(len(data))
        while len(todo):
            top = state[todo] < 0
            out[todo[top]] += self.root[data[todo[top]]]
            todo = todo[~top]
            if not len(todo):
                break
            key = self.codes[state[todo]] << 8 | data[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[todo[hit]] += self.logs[at[hit]]
            todo = todo[~hit]  # not seen after this context: its rest mass times the parent's word
            out[todo] += self.rest[state[todo]]
            state[todo] = self.parents[state[todo]]
        stops = np.flatnonzero(data == STOP)
        return np.diff(np.concatenate([[0.0], np.cumsum(out)])[np.concatenate([[0], stops + 1])])


def _spelled_mass(tree: SuffixTree):
    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([float(np.power(10.0, tree.score(_list(w))).sum()) for w in batch.column(0).to_pylist()],
                                            pa.float64())], names=["q"])
    return run


def grow_spelling(answers: DataFrame) -> tuple[SuffixTree, int, int]:
    """(spelling tree, number of training words, number of distinct ones)."""
    grams = settle(answers.where("chunk = -1").select("words", "counts").mapInArrow(_grams, "code bigint, following smallint, n bigint")
                   .groupBy("code", "following").agg(F.sum("n").alias("n")), "grams")
    sums = {r["code"]: r["n"] for r in grams.where("code < -1").collect()}
    whole = grams.where("code = 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    common = grams.where("code >= 0").groupBy("code").agg(F.sum("n").alias("m")).where(
        (F.col("code") == 0) | (F.col("m") >= F.lit(max(SUPPORT * whole, 2.0)))).select(F.col("code").alias("k"))
    kept = grams.join(common, F.col("code") == F.col("k"), "left_semi").toPandas()  # at most DEPTH / SUPPORT contexts
    return SuffixTree(kept["code"].to_numpy(), kept["following"].to_numpy(), kept["n"].to_numpy()), sums.get(-2, 0), sums.get(-3, 0)


# --- the tree of tokens ---------------------------------------------------------------

def _further(token: np.ndarray, at: np.ndarray, code: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places ``at`` those with ``depth`` frequent tokens before them in their text, and the codes of these."""
    before = token[at - depth]
    fits = before > 0
    if depth > 1:
        fits &= token[at - depth + 1] != START
    return at[fits], code[fits] | before[fits] << (BITS * (depth - 1))


def _find(sorted_: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, found) of ``what`` in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(sorted_, what), len(sorted_) - 1)
    return at, sorted_[at] == what


def _rest(total: np.ndarray, n: np.ndarray, q: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per context the mass left to its parent, 1 if it isn't kept; its runs' counts and parent's words on them begin at ``first``."""
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
    gain = np.add.reduceat(n * np.log(n / total[group] / q), first)
    others = np.maximum(total - np.add.reduceat(n, first), 0.0)
    left = np.maximum(1.0 - np.add.reduceat(q, first), 1e-12)
    gain += np.where(others > 0, others * np.log(np.maximum(others, 1.0) / total / left), 0.0)
    return np.where(gain >= GAIN, (others + PRIOR) / (total + PRIOR), 1.0)


class TokenTree:
    """What the chunks work out between them, for texts of few words and in one place; the tests compare the two.

    The runs as sorted codes: a run as context has ``rest`` (1 and no shares if not kept), a run as (context, token) ``share``.

    ``code`` and ``n`` are all frequent runs from one token on, ``root`` the probability of each
    token number by itself.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, root: np.ndarray):
        order = np.argsort(code)
        self.codes, n = code[order], n[order].astype(float)
        self.rest, self.share = np.ones(len(code)), np.zeros(len(code))
        for depth in range(1, REACH + 1):
            runs = np.flatnonzero((self.codes >> (BITS * depth) > 0) & (self.codes >> (BITS * (depth + 1)) == 0))
            if not len(runs):
                break
            # each run as a text of its own without the oldest token: what its parent context says of its last
            last = self.codes[runs] & ((1 << BITS) - 1)
            before = [self.codes[runs] >> (BITS * k) & ((1 << BITS) - 1) for k in range(1, depth)]
            q = self._after(last, before, root[last].copy())
            context, first = np.unique(self.codes[runs] >> BITS, return_index=True)
            node, _ = _find(self.codes, context)
            total, group = n[node], np.repeat(np.arange(len(context)), np.diff(np.append(first, len(runs))))
            self.rest[node] = _rest(total, n[runs], q, first)
            kept = self.rest[node] < 1
            self.share[runs[kept[group]]] = (n[runs] / (total[group] + PRIOR))[kept[group]]

    def _after(self, last: np.ndarray, before: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        code = np.zeros(len(last), np.int64)
        for depth, token in enumerate(before):
            code = code | token << (BITS * depth)
            p = self._step(code, last, p)[0]
        return p

    def _step(self, code: np.ndarray, token: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``p`` after one token of context more, and which contexts are runs of the tree."""
        node, found = _find(self.codes, code)
        at, seen = _find(self.codes, code[found] << BITS | token[found])
        seen &= token[found] > 0
        p = p.copy()
        p[found] = self.rest[node[found]] * p[found] + np.where(seen, self.share[at], 0.0)
        return p, found

    def predict(self, token: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of the tokens of texts, each between ``START`` and ``END``; ``p``: by the root."""
        p, at = p.copy(), np.flatnonzero(token != START)
        code = np.zeros(len(at), np.int64)
        for depth in range(1, REACH + 1):
            at, code = _further(token, at, code, depth)
            p[at], found = self._step(code, token[at], p[at])
            at, code = at[found], code[found]  # a longer context is in the tree only if this one is
        return p


_FIRST, _LAST = 0, 1  # a chunk's numbers of the start and the end; its words follow
_COUNT, _RUNS, _REST = range(3)
_MAIL = "bucket int, chunk int, kind int, depth int, data array<binary>"
_NUMBERED = ("chunk int, hash binary, n binary, p binary, tokens array<binary>, doc_id array<bigint>, learn array<boolean>, "
             "size array<int>, known array<bigint>, base array<double>")


def _sorted_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte by byte."""
    return _zip(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_unzip(data), np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(-1), dtype=np.uint64)


def _array(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(_unzip(data), kind)


def _mail(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "chunk", "kind", "depth", "data"])


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, its slice) of sorted keys."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    ends = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
    return [(i, slice(ends[i], ends[i + 1])) for i in range(buckets) if ends[i] < ends[i + 1]]


def _walk(key: np.ndarray, n: np.ndarray, p: np.ndarray, token: np.ndarray, learn: np.ndarray, answers: dict, turn: int,
          ask) -> np.ndarray:
    """Probabilities of the tokens as far as the answers reach; what is missing is asked for.

    ``key``, ``n``, ``p``: of the chunk's words. By a ``turn`` as many lengths of runs are counted, of all
    but the last of them what their contexts leave is known too. ``ask(kind, depth, keys, arrays)``: sorted
    keys and arrays beside them.
    """
    symbol, p = key[token], p[token].copy()
    last, count = symbol, n[token]  # of the run of ``depth`` tokens that ends here
    at = np.flatnonzero(token != _FIRST)
    for depth in range(1, REACH + 1):
        at = at[count[at - 1] >= LEAST]
        context, total = last[at - 1], count[at - 1].astype(float)
        asked = np.flatnonzero(count[at] >= LEAST)
        run = mix(context[asked] * np.uint64(0x9E3779B97F4A7C15) + symbol[at[asked]])
        distinct, first, inverse = np.unique(run, return_index=True, return_inverse=True)
        if depth > turn:
            ask(_COUNT, depth, distinct, [np.bincount(inverse, learn[at[asked]], len(distinct)).astype(np.int64)])
            break
        found, mine = answers.get((_COUNT, depth), (np.zeros(0, np.int64), np.zeros(0, np.uint8)))
        whole = np.zeros(len(at), np.int64)
        whole[asked] = found[inverse]
        contexts, of = np.unique(context, return_inverse=True)
        if depth < turn:
            rest = answers.get((_REST, depth), [np.ones(0)])[0][of]
            p[at] = rest * p[at] + np.where((rest < 1) & (whole >= LEAST), whole / (total + PRIOR), 0.0)
        else:
            own = np.flatnonzero(mine.astype(bool) & (found >= LEAST))
            place = asked[first[own]]
            order = np.argsort(context[place], kind="stable")
            place, own = place[order], own[order]
            ask(_RUNS, depth, context[place], [total[place], found[own].astype(float), p[at[place]]])
            ask(_REST, depth, contexts, [])
        last, count = np.zeros(len(token), np.uint64), np.zeros(len(token), np.int64)
        last[at[asked]], count[at] = run, whole
    return p


def _reply(batches):
    """Totals of the runs asked for and which chunk speaks for each; of the contexts asked for, the mass left to the parent."""
    held: dict[tuple, list] = {}
    for batch in batches:
        for bucket, chunk, kind, depth, data in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault((bucket, depth), []).append((kind, chunk, data))
    for bucket, depth in sorted(held):
        rows = held.pop((bucket, depth))
        counted = [(chunk, _keys(d[0]), _array(d[1], np.int64)) for kind, chunk, d in rows if kind == _COUNT]
        if counted:
            distinct, first, inverse = np.unique(np.concatenate([c[1] for c in counted]), return_index=True, return_inverse=True)
            total = np.bincount(inverse, np.concatenate([c[2] for c in counted]), len(distinct)).astype(np.int64)
            mine = np.zeros(len(inverse), np.uint8)
            mine[first] = 1
            start = 0
            for chunk, keys, _ in counted:
                part = slice(start, start + len(keys))
                yield from _mail([(bucket, chunk, _COUNT, depth, [_zip(total[inverse[part]].tobytes()), _zip(mine[part].tobytes())])]).to_batches()
                start = part.stop
        asked = [(chunk, _keys(d[0])) for kind, chunk, d in rows if kind == _REST]
        if asked:
            runs = [[_keys(d[0]), *(_array(x, np.float64) for x in d[1:])] for kind, _, d in rows if kind == _RUNS]
            contexts, rest = np.zeros(0, np.uint64), np.zeros(0)
            if runs:
                context, total, n, q = (np.concatenate([r[i] for r in runs]) for i in range(4))
                order = np.lexsort((q, n, context))  # the same sums in whatever order the chunks come
                context, total, n, q = context[order], total[order], n[order], q[order]
                contexts, first = np.unique(context, return_index=True)
                rest = _rest(total[first], n, q, first)
            for chunk, keys in asked:
                at, found = _find(contexts, keys)
                values = np.ones(len(keys))
                values[found] = rest[at[found]]
                yield from _mail([(bucket, chunk, _REST, depth, [_zip(values.tobytes())])]).to_batches()


def _read_chunk(numbered: pa.Table, mail: pa.Table):
    """(word hashes, counts, root probabilities, tokens, which are learned from, answers so far) of a chunk."""
    row = {name: numbered.column(name)[0].as_py() for name in ("hash", "n", "p", "tokens", "learn", "size")}
    token = np.concatenate([_array(t, np.int32) for t in row["tokens"]])
    learn = np.repeat(np.array(row["learn"], bool), np.array(row["size"]) + 2)
    parts: dict[tuple, list] = {}
    for bucket, kind, depth, data in sorted(zip(*(mail.column(c).to_pylist() for c in ("bucket", "kind", "depth", "data"))), key=lambda r: r[:3]):
        parts.setdefault((kind, depth), []).append(data)
    kinds = {_COUNT: (np.int64, np.uint8), _REST: (np.float64,)}
    answers = {key: [np.concatenate([_array(d[i], t) for d in data]) for i, t in enumerate(kinds[key[0]])] for key, data in parts.items()}
    return _array(row["hash"], np.uint64), _array(row["n"], np.int64), _array(row["p"], np.float64), token, learn, answers


def predict_tokens(numbered: DataFrame, buckets: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of every text; ``numbered`` has one row a chunk."""
    spark = numbered.sparkSession
    answers = spark.createDataFrame([], _MAIL)
    for turn in range(REACH + 1):
        def ask_all(left: pa.Table, right: pa.Table) -> pa.Table:
            mails, chunk = [], left.column("chunk")[0].as_py() if left.num_rows else None
            if chunk is None:
                return _mail([])

            def ask(kind, depth, keys, arrays):
                for bucket, part in _by_bucket(keys, buckets):
                    mails.append((bucket, chunk, kind, depth, [_sorted_keys(keys[part]), *(_zip(a[part].tobytes()) for a in arrays)]))
            _walk(*_read_chunk(left, right), turn, ask)
            return _mail(mails)

        asked = numbered.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask_all, _MAIL)
        answers = answers.unionByName(settle(asked.repartition(buckets, "bucket").mapInArrow(_reply, _MAIL), "tree-answers"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({name: pa.array([], t) for name, t in kinds.items()})
        *words, token, learn, found = _read_chunk(left, right)
        logs = np.log10(_walk(*words, token, learn, found, REACH + 1, None))
        size = np.array(left.column("size")[0].as_py())
        stop = np.cumsum(size + 2)
        logs[stop - size - 2] = 0.0
        own = {name: left.column(name)[0].as_py() for name in ("doc_id", "learn", "known", "base")}
        values = [own["doc_id"], [not x for x in own["learn"]], size + 1, own["known"], own["base"], np.add.reduceat(logs, stop - size - 2)]
        return pa.table({name: pa.array(v, t) for (name, t), v in zip(kinds.items(), values)})

    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    return numbered.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = id_and_text(docs).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("chunk"), "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(True)).alias("learn"), "text")

    def shrink(batches):
        for batch in batches:
            texts = [_zip(t.as_py().lower()) for t in batch.column(3).cast(pa.large_binary())]
            yield pa.record_batch([*batch.columns[:3], pa.array(texts, pa.binary())], names=["chunk", "doc_id", "learn", "text"])
    # bytes.lower() changes A-Z alone
    packed = rows.mapInArrow(shrink, "chunk int, doc_id bigint, learn boolean, text binary")
    asked = packed.repartition(n, "chunk").mapInArrow(_requests(n), _PACKED)
    answers = settle(asked.repartition(n, "bucket").mapInArrow(_totals, _PACKED), "answers")
    tree, words, types = grow_spelling(answers)
    ends = rows.where("learn").count()
    total, distinct = words + ends, types + (1 if ends else 0)
    floor = total + 0.1 * (distinct + 1)
    spelled = answers.where("chunk = -1").select("words").mapInArrow(_spelled_mass(tree), "q double").agg(F.sum("q").alias("q")).first()["q"]
    new = math.log10(distinct * max(1.0 - (spelled or 0.0), 1e-9) / (total + distinct)) if total else 0.0

    def model(count: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            seen = np.log10((count + distinct * np.power(10.0, spelling)) / max(total + distinct, 1))
        return np.where(count > 0, seen, new)

    end_known = int(ends > 0)
    end_base = math.log10((ends + 0.1) / floor)
    end_root = ends / (total + distinct) if ends else 10.0 ** new

    def number(batches):
        """A chunk's words with what is known of them, and its texts as numbers of these words."""
        chunk, at, held, words, docs, tokens, ready, size = None, {}, [], [], [], [], [], 0

        def close():
            base, n, p = values
            # a rarer word is in no run
            keys = np.array([1, 2, *(xxhash.xxh3_64_intdigest(w) if k >= LEAST else 0 for w, k in zip(words, n.tolist()))], np.uint64)
            packed = [_zip(a.tobytes()) for a in (mix(keys), np.concatenate([[ends, ends], n]).astype(np.int64), np.concatenate([[1.0, end_root], p]))]
            pieces_ = [*tokens, *([_zip(np.concatenate(ready).tobytes())] if ready else [])]
            row = [[chunk], *([x] for x in packed), [pieces_], *([list(x)] for x in zip(*docs))]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.bool_()),
                     pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()))
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in _NUMBERED.split(", ")])

        for batch in pieces(batches):
            for i, (c, k) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if c != chunk:
                    if docs:
                        yield close()
                    chunk, at, held, words, docs, tokens, ready, size, values = c, {}, [], [], [], [], [], 0, None
                if k == 0:
                    some = _list(batch.column(5)[i].as_py())
                    counts = _array(batch.column(6)[i].as_py(), np.int64)
                    for j, w in enumerate(some, len(at)):
                        at[w] = j
                    words += some
                    held.append(np.stack([np.log10((counts + 0.1) / floor), counts, np.power(10.0, model(counts, tree.score(some)))]))
                    continue
                if values is None:
                    values = np.concatenate(held, axis=1) if held else np.zeros((3, 0))
                text = _unzip(batch.column(4)[i].as_py()).split()
                place = np.fromiter((at[w] for w in text), np.int64, len(text))
                ready.append(np.concatenate([[_FIRST], place + _LAST + 1, [_LAST]]).astype(np.int32))
                size += len(text) + 2
                if size >= BLOCK:
                    tokens.append(_zip(np.concatenate(ready).tobytes()))
                    ready, size = [], 0
                docs.append((batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), len(text),
                             int((values[1][place] > 0).sum()) + end_known, math.fsum(values[0][place]) + end_base))
        if docs:
            yield close()
    left = answers.where("chunk >= 0").select("chunk", F.lit(0).cast("tinyint").alias("kind"), F.lit(None).cast("bigint").alias("doc_id"),
                                              F.lit(None).cast("boolean").alias("learn"), F.lit(None).cast("binary").alias("text"), "words", "counts")
    right = packed.select("chunk", F.lit(1).cast("tinyint").alias("kind"), "doc_id", "learn", "text",
                          F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("counts"))
    met = left.unionByName(right).repartition(n, "chunk").sortWithinPartitions("chunk", "kind")
    # dealt once, read in every round
    numbered = met.mapInArrow(number, _NUMBERED).repartition(n, "chunk").persist(StorageLevel.DISK_ONLY)
    try:
        scores = settle(predict_tokens(numbered, n), "scores")
    finally:
        numbered.unpersist()
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
