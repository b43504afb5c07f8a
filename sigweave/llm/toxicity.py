"""Toxicity by class-conditional Kneser-Ney language models.

Each class (toxic, ordinary) has a model of words as sequences of bytes, up to order `order`,
with a mark before and after each word; so words of one stem and words that were never seen
are scored as well as known ones. Counts of the highest order, and of n-grams that begin a word, are the documents
of a class; those of lower orders are continuation counts, the number of different bytes
that precede an n-gram in the class. An n-gram's count less the discount is its class's own;
how much of a context's probability backs off to the shorter context comes from the counts of
both classes together, and at the bottom lies one distribution of both, so an expression too
rare to be evidence is as likely in either class. Each class's probabilities add up to 1 after every context.

A word tells the difference of its two log-likelihoods. A document is judged by the largest of
its words and by the length-normalised difference of all others; both go into a
logistic function, fitted on values of documents that the models had not seen.

Nulls and empty texts have no words: both values are 0. Repeated rows are scored
each on its own. An empty label table, or one class only, gives every text the share
of label 1 (0 without labels). Labels other than 0 and 1 and null ids teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textscan
from .textscan import U64, Index

#: The discount, in documents (or continuations): n-grams of fewer are left to shorter contexts.
DISCOUNT = 3.0
ORDER = 8
#: Bytes of text whose distinct words are scored at a time.
SLICE = 2 << 20
#: Marks before and after a word, and the values a byte has.
BEGIN, FINISH, VALUES = 1, 2, 256


@dataclass
class Level:
    """Of one order: n-grams that a class has more of than the discount, with their probabilities; contexts of such, with the share that backs off."""

    keys: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    back: np.ndarray


def _extended(key: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """The hashes of n-grams from those of their last n - 1 bytes and the bytes before."""
    return textscan.mix(key * U64(0xD1342543DE82EF95) + before.astype(U64) + U64(n))


class Grams:
    """The bytes of words with their marks."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts + 2
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.sym = np.full(int(self.first[-1]), FINISH, np.uint8)
        self.sym[self.first[:-1]] = BEGIN
        self.sym[textscan.ranges(self.first[:-1] + 1, ends - starts)] = text[textscan.ranges(starts, ends - starts)]
        self.place = (np.arange(len(self.sym)) - np.repeat(self.first[:-1], size)).astype(np.int32)

    def keys(self, n: int, shorter: np.ndarray | None) -> np.ndarray:
        """The hash of the n-gram that ends at each byte, from that of the (n - 1)-gram."""
        if n == 1:
            return textscan.mix(self.sym.astype(U64) + U64(1))
        before = np.zeros_like(self.sym)
        before[n - 1 :] = self.sym[: max(0, len(self.sym) - n + 1)]
        return _extended(shorter, before, n)


class Places:
    """Hashes of the n-grams that end at some bytes, and of those that end before them."""

    def __init__(self, g: Grams, at: np.ndarray, order: int):
        self.ends, self.befores = [], []
        for out, where in ((self.ends, at), (self.befores, at - 1)):
            for n in range(1, order + 1):
                before = g.sym[np.maximum(where - n + 1, 0)]
                out.append(_extended(out[-1], before, n) if n > 1 else textscan.mix(before.astype(U64) + U64(1)))

    def ending(self, n: int, at: np.ndarray) -> np.ndarray:
        return self.ends[n - 1][at]

    def context(self, n: int, at: np.ndarray) -> np.ndarray:
        """The n - 1 bytes before each place."""
        return self.befores[n - 2][at] if n > 1 else np.zeros(len(at), U64)


class KneserNey:
    """The models of both classes; columns are ordinary and toxic."""

    def __init__(self, levels: list[Level], unseen: np.ndarray):
        self.levels, self.unseen = levels, unseen
        self.keys, self.contexts = [Index(x.keys) for x in levels], [Index(x.contexts) for x in levels]

    def p(self, g: Places, n: int, at: np.ndarray) -> np.ndarray:
        """The probabilities of the bytes at some of the places after the n - 1 bytes before them."""
        out, share, todo = np.zeros((len(at), 2)), np.ones((len(at), 2)), np.arange(len(at))
        for m in range(n, 0, -1):
            found = self.keys[m - 1].find(g.ending(m, at[todo]))
            hit = found >= 0
            out[todo[hit]] = share[todo[hit]] * self.levels[m - 1].p[found[hit]]
            todo = todo[~hit]
            found = self.contexts[m - 1].find(g.context(m, at[todo]))
            share[todo[found >= 0]] *= self.levels[m - 1].back[found[found >= 0]]
        out[todo] = share[todo] * self.unseen
        return out

    def gains(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The toxic less the ordinary log-likelihood of each word."""
        out = np.zeros(len(starts))
        order = len(self.levels)
        for i in range(0, len(starts), 50_000):
            g = Grams(text, starts[i : i + 50_000], ends[i : i + 50_000])
            log = np.zeros(len(g.place))
            places = Places(g, np.arange(len(g.place)), order)
            n = np.minimum(g.place + 1, order)
            for m in range(2, order + 1):
                at = np.flatnonzero(n == m)
                p = np.log(self.p(places, m, at))
                log[at] = p[:, 1] - p[:, 0]
            out[i : i + 50_000] = np.add.reduceat(log, g.first[:-1])
        return out


def kneser_ney(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: np.ndarray, order: int = ORDER, discount: float = DISCOUNT) -> KneserNey:
    """The models from distinct words and the documents of each class that have them."""
    g = Grams(text, starts, ends)
    word = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(g.first))
    sums = lambda at, x, n: np.stack([np.bincount(at, x[:, k], minlength=n) for k in (0, 1)], 1)

    def counted(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams, the documents of each class that have them, and a place of each."""
        at = np.flatnonzero((g.place + 1 >= n) & (g.place > 0))
        keys, some, place = np.unique(key[at], return_index=True, return_inverse=True)
        return keys, np.stack([np.bincount(place, count[word[at], k], minlength=len(keys)) for k in (0, 1)], 1), at[some]

    levels, unseen = [], np.zeros(2)
    model = KneserNey(levels, unseen)
    key = g.keys(1, None)
    now = counted(key, 1)
    for n in range(1, order + 1):
        keys, c, some = now
        if n < order:
            longer = g.keys(n + 1, key)
            now = counted(longer, n + 1)
            several = sums(np.searchsorted(keys, key[now[2]]), (now[1] > 0).astype(float), len(keys))
            c = np.where((g.place[some] + 1 == n)[:, None], c, several)
            key = longer
        places = Places(g, some, n)
        context, place = np.unique(places.context(n, np.arange(len(some))), return_inverse=True)
        own, total = np.maximum(c - discount, 0), sums(place, c, len(context)).sum(1)
        kept = sums(place, own, len(context))
        back = np.where(kept > 0, np.clip(1 - kept.sum(1) / np.maximum(total, 1e-9), 1e-6, 1)[:, None], 1.0)  # one for both classes, but for one that keeps nothing
        if n == 1:
            both = c.sum(1) + 0.5
            low = np.repeat((both / (both.sum() + 0.5 * (VALUES - len(keys))))[:, None], 2, 1)
            unseen = back[0] * 0.5 / (both.sum() + 0.5 * (VALUES - len(keys)))
            firm = np.ones(len(keys), bool)  # all bytes seen; the rest share one probability
        else:
            firm = own.max(1) > 0  # what neither class keeps is what backing off gives
            low = model.p(places, n - 1, np.flatnonzero(firm))
        mine = place[firm]
        p = np.where(kept[mine] > 0, (1 - back[mine]) * own[firm] / np.maximum(kept[mine], 1e-9), 0) + back[mine] * low
        some_kept = kept.max(1) > 0 if n > 1 else np.zeros(len(context), bool)
        levels.append(Level(keys[firm], p, context[some_kept], back[some_kept]))
        model = KneserNey(levels, unseen)
    return model


@dataclass
class ToxicityModel:
    levels: list[Level]
    unseen: np.ndarray
    weights: np.ndarray

    def words(self) -> KneserNey | None:
        return KneserNey(self.levels, self.unseen) if self.levels else None


def features(gain: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document: the largest gain of a word, and the length-normalised gain of all others."""
    out, size = np.zeros((len(first) - 1, 2)), np.diff(first)
    full = np.flatnonzero(size)
    if len(full):
        out[full, 0] = np.maximum.reduceat(gain, first[full])
        out[full, 1] = (np.add.reduceat(gain, first[full]) - out[full, 0]) / size[full]
    return out


def distinct(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the distinct words of a slice, the place of each word among them, and each document's first word."""
    low = textscan.lower_latin(buf)
    starts, ends, first = textscan.word_spans(low, offs, textscan.NON_LETTER)
    _, some, place = np.unique(textscan.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
    return low, starts[some], ends[some], place, first


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, the last for the constant; by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    b, ridge = np.zeros(x.shape[1]), np.array([1e-3, 1e-3, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * b
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(ridge + 1e-9), g)
        size = float(np.abs(step).max())
        b -= step * min(1.0, 8.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return b


def fit(docs: list[bytes], toxic: np.ndarray, share: float, folds: int = 3) -> ToxicityModel:
    """The model from documents (their distinct words, one space apart); share: of label 1 among all labelled rows."""
    toxic = np.asarray(toxic, np.int64)
    buf = np.frombuffer(b"".join(docs), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    low, starts, ends, place, first = distinct(buf, offs)
    if not len(docs) or toxic.min() == toxic.max() or not len(place):
        logit = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -25, 25))
        return ToxicityModel([], np.ones(2), np.array([0.0, 0.0, logit]))
    doc = np.repeat(np.arange(len(docs)), np.diff(first))

    def model(of: np.ndarray) -> KneserNey:
        chosen = of[doc]
        count = np.stack([np.bincount(place[chosen & (toxic[doc] == k)], minlength=len(starts)) for k in (0, 1)], 1).astype(float)
        some = count.sum(1) > 0
        return kneser_ney(low, starts[some], ends[some], count[some])

    fold, x = np.zeros(len(docs), np.int64), np.zeros((len(docs), 2))
    for k in (0, 1):
        fold[toxic == k] = np.arange((toxic == k).sum()) % folds
    for k in range(folds):
        mine = fold == k
        words = np.unique(place[mine[doc]])
        if len(words) and (~mine)[doc].any():
            gain = np.zeros(len(starts))
            gain[words] = model(~mine).gains(low, starts[words], ends[words])
            x[mine] = features(gain[place], first)[mine]
    by_class = np.array([(1 - share) / max((toxic == 0).mean(), 1e-9), share / max((toxic == 1).mean(), 1e-9)])
    m = model(np.ones(len(docs), bool))
    return ToxicityModel(m.levels, m.unseen, _logistic(x, toxic, by_class[toxic]))


def score_slice(weights: np.ndarray, words: KneserNey | None, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    x = np.zeros((len(offs) - 1, 2))
    if words is not None:
        low, starts, ends, place, first = distinct(buf, offs)
        x = features(words.gains(low, starts, ends)[place], first)
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", holdout: tuple[int, int] | None = None, sample_per_class: int = 2000) -> ToxicityModel:
    """Fit on a bounded sample: about `sample_per_class` labelled rows of each class, chosen by the hash of the id.

    holdout: (modulus, remainder) of crc32(id as text) whose rows teach nothing.
    """
    lab = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    if holdout:
        lab = lab.where(storage.id_remainder("_id", holdout[0]) != holdout[1])
    lab = lab.groupBy("_id").agg(F.max("_y").alias("_y"))
    n = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    pick = F.lit(False)
    for y, k in n.items():
        pick = pick | ((F.col("_y") == y) & (F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_per_class / k))))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(lab.where(pick)), "_id")

    def hashed() -> object:
        def run(b: pa.RecordBatch) -> list:
            out: list[bytes] = []
            for i, j, buf, offs in textscan.slices(b.column(b.schema.get_field_index("_text"))):
                low, starts, ends, place, first = distinct(buf, offs)
                raw = low.tobytes()
                for k in range(j - i):
                    mine = np.unique(place[first[k] : first[k + 1]])
                    out.append(b" ".join([*(raw[x:y] for x, y in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)), b""]))
            return [out]

        return run

    share = n.get(1, 0) / total if total else 0.0

    def learn(t: pa.Table) -> ToxicityModel:
        t = t.sort_by([("_id", "ascending"), ("_words", "ascending")])
        return fit(t.column("_words").to_pylist(), np.asarray(t.column("_y").to_pylist(), np.int64), share)

    return storage.fitted(storage.map_columns(rows, [("_words", T.BinaryType())], hashed, keep=["_id", "_y"]), learn)


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; higher means that label 1 is likelier."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def start() -> object:
        m = sent.value
        words = m.words()

        def run(b: pa.RecordBatch) -> list:
            parts = [score_slice(m.weights, words, buf, offs) for _, _, buf, offs in textscan.slices(b.column(place), SLICE)]
            return [pa.array(np.concatenate(parts))]

        return run

    return storage.map_columns(docs, [(score_col, T.DoubleType())], start)
