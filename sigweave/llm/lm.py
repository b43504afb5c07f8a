"""Language-model scoring by a weighted backoff automaton.

The model is a trigram model with hierarchical Dirichlet smoothing: p(w | gh) is
(c(ghw) + m3 p(w | h)) / (c(gh) + m3), p(w | h) is (c(hw) + m2 p(w)) / (c(h) + m2), and p(w) is
c(w) / (N + S + 1) for known tokens and (S + 1) / (N + S + 1) for the unknown one, where S
counts the tokens seen once. As an automaton: every history seen (no token, one, or two) is a
state. A state has an arc for each token seen after it, which carries the smoothed log10
probability and leads to the longest seen history of what was read, and one failure arc, which
carries the log10 of m / (c(history) + m), reads nothing and leads to the history without its
first token. A text is read once from left to right: a token takes its arc, or failure arcs
until a state has one; the root has one for every token. The state is carried from token to token.

The counts cover all training documents and are never gathered anywhere. Documents go to
blocks of a bounded size. A block sends its distinct words, pairs and triples with its
training counts to buckets by hash; a bucket adds up what all blocks sent and answers each
with the totals in the order asked. So a block holds the part of the automaton that its own
texts can reach, and a frequent n-gram costs each bucket one entry a block. A block sends to
the buckets it has keys for, so there are never more messages than keys. Keys have 48 bits
beside the bucket number: one in some 10^8 of a text's n-grams may take another's count.

Null texts are empty; an empty text is one end token. Rows that repeat count and are scored
each. A null id counts as an empty text for the training split. Without training rows
every token is unknown: N is 0, and the unknown token has probability 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage, textscan
from .textscan import U64

BLOCK_BYTES, BUCKET_TOKENS = 5 << 20, 1 << 20
START, END = U64(0xA11CE), U64(0xE4D)
TAIL = 48
#: Tokens of a text that are read in lockstep with others; a piece after the first is led in by the two tokens before it.
STRIP = 128


def small(c: np.ndarray) -> bytes:
    """Counts in two bits each; those of 3 and more follow in a byte each, of those 255 and more in four."""
    code = np.zeros(-(-len(c) // 4) * 4, np.uint8)
    code[: len(c)] = np.minimum(c, 3)
    code = code.reshape(-1, 4)
    big = c[c >= 3]
    return (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).tobytes() + np.minimum(big, 255).astype(np.uint8).tobytes() + big[big >= 255].astype("<u4").tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    """The n counts of `small`."""
    code = np.frombuffer(data, np.uint8, -(-n // 4))
    c = (code[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[:n].astype(np.int64)
    at = np.flatnonzero(c == 3)
    c[at] = np.frombuffer(data, np.uint8, len(at), len(code))
    at = at[c[at] == 255]
    c[at] = np.frombuffer(data, "<u4", len(at), len(data) - 4 * len(at))
    return c


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end token after each text, and each text's first place."""
    parts, sizes = [], []
    for _, _, buf, offs in textscan.slices(texts):
        low = textscan.LOWER[buf]
        starts, ends, first = textscan.word_spans(low, offs, textscan.BLANKS)
        parts.append(np.insert(textscan.span_hashes(low, starts, ends), first[1:], END))
        sizes.append(np.diff(first) + 1)
    if not parts:
        return np.zeros(0, U64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def tail_bits(bits: int) -> int:
    return min(TAIL, 64 - bits)


def keys_of(tok: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each token, of it with its predecessor, and with its two predecessors (of a first token: 0, with none).

    A key is a hash, cut to the bucket number and the tail.
    """
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[first[:-1]] = START
    pair = textscan.chain(prev, tok)
    triple = np.empty_like(tok)
    triple[1:] = textscan.chain(pair[:-1], tok[1:])
    cut = U64(64 - bits - tail_bits(bits))
    triple[first[:-1]] = 0
    return textscan.mix(tok) >> cut, pair >> cut, triple >> cut


def by_bucket(keys: np.ndarray, shift: int, n: int) -> np.ndarray:
    """The first place of each bucket's keys among the sorted keys, and their number at the end."""
    return np.append(np.searchsorted(keys, np.arange(n, dtype=U64) << U64(shift)), len(keys))


def packed(tails: np.ndarray) -> bytes:
    """Sorted tails of 48 bits: few in six bytes each; many in five, with the number of those that have each first byte."""
    cells = np.ascontiguousarray(tails.astype("<u8")).view(np.uint8).reshape(-1, 8)
    if len(tails) < 2048:
        return b"\0" + np.ascontiguousarray(cells[:, :6]).tobytes()
    return b"\1" + np.bincount(cells[:, 5], minlength=256).astype("<u4").tobytes() + np.ascontiguousarray(cells[:, :5]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    many = data[:1] == b"\1"
    cells = np.frombuffer(data, np.uint8, offset=1025 if many else 1).reshape(-1, 5 if many else 6)
    out = np.zeros((len(cells), 8), np.uint8)
    out[:, : cells.shape[1]] = cells
    if many:
        out[:, 5] = np.repeat(np.arange(256), np.frombuffer(data, "<u4", 256, 1))
    return out.view("<u8")[:, 0]


_ASK = "block long, bucket int, words binary, word_counts binary, grams binary, gram_counts binary"
_ANSWER = "block long, bucket int, n_words int, word_counts binary, n_grams int, gram_counts binary, total long, distinct long, single long"


def _texts(t: pa.Table) -> pa.Array:
    d = zstandard.ZstdDecompressor()
    return pa.array([d.decompress(x) for x in t.column("_text").to_pylist()], pa.large_binary())


def _grams(pair: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and triples, and the places of each token's among them."""
    both, at = np.unique(np.concatenate([pair, triple]), return_inverse=True)
    return both, at[: len(pair)], at[len(pair) :]


def _asking(bits: int) -> Callable[[pa.Table], pa.Table]:
    def ask(t: pa.Table) -> pa.Table:
        tok, first = tokens(_texts(t))
        weight = np.repeat(np.where(np.asarray(t.column("_train")), np.asarray(t.column("_n")), 0), np.diff(first))
        word, pair, triple = keys_of(tok, first, bits)
        words, at = np.unique(word, return_inverse=True)
        word_n = np.bincount(at, weight, minlength=len(words)).astype(np.int64)
        grams, p, q = _grams(pair, triple)
        later = weight.copy()
        later[first[:-1]] = 0  # a first token has no triple
        gram_n = (np.bincount(p, weight, minlength=len(grams)) + np.bincount(q, later, minlength=len(grams))).astype(np.int64)
        n, shift = 1 << bits, tail_bits(bits)
        w, g = by_bucket(words, shift, n), by_bucket(grams, shift, n)
        full = np.flatnonzero((np.diff(w) > 0) | (np.diff(g) > 0))
        mask = U64((1 << shift) - 1)
        cuts = [(slice(int(w[k]), int(w[k + 1])), slice(int(g[k]), int(g[k + 1]))) for k in full]
        return pa.table([
            pa.array([t.column("_block")[0].as_py()] * len(full), pa.int64()), pa.array(full, pa.int32()),
            pa.array([packed(words[a] & mask) for a, _ in cuts], pa.binary()), pa.array([small(word_n[a]) for a, _ in cuts], pa.binary()),
            pa.array([packed(grams[b] & mask) for _, b in cuts], pa.binary()), pa.array([small(gram_n[b]) for _, b in cuts], pa.binary()),
        ], names=["block", "bucket", "words", "word_counts", "grams", "gram_counts"])

    return ask


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sum over all lists for each key of each list, and for each distinct key."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    return np.split(total[at], np.cumsum([len(k) for k in keys])[:-1]), total


def _answer(t: pa.Table) -> pa.Table:
    cols = t.to_pydict()
    word_keys, gram_keys = ([unpacked(x) for x in cols[c]] for c in ("words", "grams"))
    words, word_total = _totals(word_keys, [large(x, len(k)) for x, k in zip(cols["word_counts"], word_keys, strict=True)])
    grams, _ = _totals(gram_keys, [large(x, len(k)) for x, k in zip(cols["gram_counts"], gram_keys, strict=True)])
    n = len(words)
    return pa.table([
        pa.array(cols["block"], pa.int64()), pa.array(cols["bucket"], pa.int32()),
        pa.array([len(x) for x in words], pa.int32()), pa.array([small(x) for x in words], pa.binary()),
        pa.array([len(x) for x in grams], pa.int32()), pa.array([small(x) for x in grams], pa.binary()),
        pa.array([int(word_total.sum())] * n, pa.int64()), pa.array([int((word_total > 0).sum())] * n, pa.int64()), pa.array([int((word_total == 1).sum())] * n, pa.int64()),
    ], names=["block", "bucket", "n_words", "word_counts", "n_grams", "gram_counts", "total", "distinct", "single"])


def strips(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of pieces of all texts, and the place from which each counts, the longest pieces first.

    A state depends on two tokens, so a reading that begins two tokens early at the root has the right state.
    """
    size = np.diff(first)
    n = np.maximum(1, -(-size // STRIP))
    text = np.repeat(np.arange(len(size)), n)
    k = textscan.ranges(np.zeros(len(n), np.int64), n)
    count = first[text] + k * STRIP
    begin, end = np.where(k > 0, count - 2, count), np.minimum(count + STRIP, first[text + 1])
    order = np.argsort(begin - end, kind="stable")
    return begin[order], end[order], count[order]


class Automaton:
    """States and arcs that a set of texts can reach, from the training counts of their n-grams.

    State 0 is the root, 1 + u the history of word u, 1 + U that of a text's beginning (U words),
    2 + U + b the history of n-gram b, if it is a pair.
    """

    def __init__(self, word_n: np.ndarray, gram_n: np.ndarray, end: int, total: int, single: int, m2: float, m3: float):
        self.n_words, self.word_n, self.gram_n, self.end, self.m2, self.m3 = len(word_n), word_n, gram_n, end, m2, m3
        self.root = np.where(word_n > 0, word_n, single + 1) / (total + single + 1)
        starts = word_n[end] if len(word_n) else 0  # as many texts begin as end
        history = np.concatenate([word_n, [starts]])
        with np.errstate(divide="ignore"):
            self.fail = np.concatenate([[0.0], np.log10(m2 / (history + m2)), np.log10(m3 / (gram_n + m3))])
        self.history_n = history

    def walk(self, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The log10 probability of each token. word, pair, triple: the places of each token's arcs (triple: none for a first token)."""
        n, base = len(word), 2 + self.n_words
        start = np.zeros(n, bool)
        start[first[:-1]] = True
        # Weights of the arcs of every place: interpolated, so that an arc alone gives the probability.
        before = np.empty(n, np.int64)
        before[1:], before[start] = word[:-1], self.n_words
        p2 = (self.gram_n[pair] + self.m2 * self.root[word]) / (self.history_n[before] + self.m2)
        pair_before = np.zeros(n, np.int64)
        pair_before[1:] = pair[:-1]
        c3 = np.where(start, 0, self.gram_n[triple])
        p3 = (c3 + self.m3 * p2) / (self.gram_n[pair_before] + self.m3)
        arcs = np.log10(np.stack([self.root[word], p2, p3]))
        has2, has3 = self.gram_n[pair] > 0, c3 > 0
        longest = np.where(has2, base + pair, np.where(self.word_n[word] > 0, 1 + word, 0))  # where the arcs of a place lead
        shorter = np.where(self.word_n[np.minimum(before, self.n_words - 1)] > 0, 1 + before, 0)
        shorter[start] = 1 + self.n_words
        out = np.zeros(n)
        begin, stop, count = strips(first)
        state = np.where(start[begin], 1 + self.n_words, 0)
        size = stop - begin
        for step in range(int(size[0]) if len(size) else 0):
            on = int(np.searchsorted(-size, -step))  # pieces are sorted: those still being read
            at, s = begin[:on] + step, state[:on]
            got = np.zeros(on)
            level = np.where(s >= base, 2, np.where(s > 0, 1, 0))
            failing = (level == 2) & ~has3[at]
            got += np.where(failing, self.fail[s], 0)
            s = np.where(failing, shorter[at], s)
            level = np.where(failing, np.where(s > 0, 1, 0), level)
            failing = (level == 1) & ~has2[at]
            got += np.where(failing, self.fail[s], 0)
            level = np.where(failing, 0, level)
            out[at] = np.where(at >= count[:on], got + arcs[level, at], out[at])
            state[:on] = longest[at]
        return out


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)


def _squeezed(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows with compressed texts, their number (equal rows of a batch are one) and their block."""
    out = f"_id {rows.schema['_id'].dataType.simpleString()}, _text binary, _train boolean, _n long, _key long"
    names = ["_id", "_text", "_train", "_n", "_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            seen: dict = {}
            for k, row in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if row in seen:
                    seen[row][1] += 1
                else:
                    seen[row] = [k, 1]
            keep = pa.array([k for k, _ in seen.values()], pa.int64())
            part = b.take(keep)
            made = [z.compress((x or "").encode()) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary()), part.column(2), pa.array([n for _, n in seen.values()], pa.int64()), part.column(3)], names=names)

    keyed = rows.withColumn("_key", F.xxhash64(F.col("_id"), F.xxhash64("_text")))
    return keyed.mapInArrow(storage.lean_batches(run), out).select("_id", "_text", "_train", "_n", F.pmod("_key", F.lit(blocks)).alias("_block"))


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", m2: float = 300.0, m3: float = 20.0) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score), one row a document.

    train: whether a row of docs teaches. base_score: add-half unigram log10 probability.
    m2, m3: how many observations of a history weigh as much as the shorter history.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks, bits = size // BLOCK_BYTES + 1, max(3, int(size // 6 // BUCKET_TOKENS).bit_length())
    parts = max(storage.n_partitions(spark), blocks // 2)
    placed = _squeezed(rows, blocks).repartition(parts, "_block")
    answers = placed.groupBy("_block").applyInArrow(storage.lean(_asking(bits)), _ASK).groupBy("bucket").applyInArrow(storage.lean(_answer), _ANSWER)
    out = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    kind = storage.arrow_type(docs.schema[id_col].dataType)
    # Every block gets the same three sums over all buckets, also those that it has no keys for.
    stats = ("total", "distinct", "single")
    sums = answers.groupBy("bucket").agg(*(F.max(c).alias(c) for c in stats)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stats)).withColumn("one", F.lit(1))
    answers = answers.drop(*stats).withColumn("one", F.lit(1)).join(F.broadcast(sums), "one")

    def read(texts: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("bucket").to_pydict()
        total, distinct, single = (told[c][0] for c in stats)
        joined = lambda kind: np.concatenate([large(x, n) for x, n in zip(told[f"{kind}_counts"], told[f"n_{kind}s"], strict=True)] or [np.zeros(0, np.int64)])
        word_n, gram_n = joined("word"), joined("gram")
        tok, first = tokens(_texts(texts))
        key, pair, triple = keys_of(tok, first, bits)
        words, word = np.unique(key, return_inverse=True)
        _, p, q = _grams(pair, triple)
        end = int(np.searchsorted(words, textscan.mix(np.array([END])) >> U64(64 - bits - tail_bits(bits)))[0])
        step = Automaton(word_n, gram_n, end, total, single, m2, m3).walk(word, p, q, first)
        c = word_n[word]
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        cols = [texts.column("_id").cast(kind), pa.array(np.diff(first)), pa.array(_sums((c > 0).astype(np.int64), first)), pa.array(np.full(len(first) - 1, total)), pa.array(_sums(base, first)), pa.array(_sums(step, first))]
        each = pa.array(np.repeat(np.arange(len(first) - 1), np.asarray(texts.column("_n"))))
        return pa.table(cols, names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]).take(each)

    return placed.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(storage.lean(read), out)
