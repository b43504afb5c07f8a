"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte n-grams (1 to 3 bytes of the lower-cased
letters, words joined by one space), with logarithmic term frequencies, of unit length.
Every language has several centroids, found by spherical k-means. The language of the
most similar centroid wins; a text whose cosine to it is below what that centroid accepts
from texts of so many distinct n-grams is rejected. That comes from a low quantile and the
median of the centroid's own training rows and of their beginnings, each measured against
centroids that were fitted without it, so single odd rows do not move it.

Null texts and texts without a letter get `und`, score 0, and are rejected. Without
training rows every text gets `und`. Ties go to the language that sorts first. Rows
that repeat are treated each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textscan

DIMS = 4096
#: Languages up to which their table is broadcast to the rows that a sample is taken from.
MOST_BROADCAST = 100_000
#: The numbers of distinct n-grams at which a centroid's limit is measured; between them it is interpolated.
SIZES = 2.0 ** np.arange(2, 13)
#: Beginnings of training rows that stand for short texts, in bytes, each up to the end of its word.
HEADS = (1, 6, 12, 24, 48, 96, 192, 384)
HEAD_BYTES = 512
#: A limit needs so many measured texts; a centroid or size with fewer takes that of its language or of the next size.
LEAST_ROWS = 30
#: A limit lies below the low quantile by so much of the quantile's distance to the median.
MARGIN = 1.0


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # the language of each centroid
    least: np.ndarray  # the smallest cosine each centroid accepts, by SIZES


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document and the dimension of every n-gram of a slice."""
    low = textscan.lower_latin(buf)
    letter = ~textscan.NON_LETTER[low]
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    keep = letter.copy()
    if len(low):
        keep[1:] |= letter[:-1]  # one separator after each word
        keep[offs[:-1][offs[:-1] < len(low)]] &= letter[offs[:-1][offs[:-1] < len(low)]]
    low, letter, doc = low[keep], letter[keep], doc[keep]
    x = np.where(letter, low, 32).astype(np.uint32)
    docs, dims = [doc], [(x * np.uint32(2654435761)) >> np.uint32(20)]
    g = x
    for n in (2, 3):
        if len(x) < n:
            break
        g = g[:-1] * np.uint32(257) + x[n - 1 :]
        same = doc[: len(g)] == doc[n - 1 :]
        docs.append(doc[: len(g)][same])
        dims.append((((g + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20))[same])
    return np.concatenate(docs), np.concatenate(dims).astype(np.int64)


def counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Term frequencies, one row a document."""
    doc, dim = _grams(buf, offs)
    n = len(offs) - 1
    return np.bincount(doc.astype(np.int64) * DIMS + dim, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def kmeans(v: np.ndarray, k: int, low: float, rounds: int = 8) -> np.ndarray:
    """Unit centroids; the first is the mean's nearest, each next the farthest from those before but for the share low of the rows.

    Centroids with less than that share are dropped: a few odd rows (junk, wrong labels) would accept their like.
    """
    c = [v[int(np.argmax(v @ v.mean(0)))]]
    best = v @ c[0]
    while len(c) < min(k, len(v)):
        c.append(v[int(np.argsort(best, kind="stable")[int(low * len(v))])])
        best = np.maximum(best, v @ c[-1])
    c = np.array(c)
    for _ in range(rounds):
        mine = np.argmax(v @ c.T, 1)
        for j in range(len(c)):
            if (mine == j).any():
                m = v[mine == j].sum(0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-9)
    n = np.bincount(np.argmax(v @ c.T, 1), minlength=len(c))
    return c[(n >= low * len(v)) | (n == n.max())]


def heads(text: bytes) -> list[bytes]:
    """Beginnings of a text that end where a word ends."""
    buf = np.frombuffer(text, np.uint8)
    stops = np.flatnonzero(textscan.NON_LETTER[buf])
    ends = {int(stops[k]) for k in np.searchsorted(stops, HEADS) if k < len(stops)}
    return [text[:e] for e in sorted(ends) if not textscan.NON_LETTER[buf[:e]].all()]


def limits(size: np.ndarray, cosine: np.ndarray, low: float) -> np.ndarray:
    """The smallest accepted cosine at each of SIZES: as far below the low quantile as that is below the median, but of many texts about low / 10 are below it at most.

    NaN: too few texts.
    """
    out = np.full(len(SIZES), np.nan)
    for k, s in enumerate(SIZES):
        near = cosine[(size > s / 2) & (size < s * 2)]
        if len(near) >= LEAST_ROWS:
            q, mid = np.quantile(near, [low, 0.5])
            out[k] = q - MARGIN * (mid - q)
            if len(near) >= 50 / low:  # enough to know a tenth of the quantile
                out[k] = max(out[k], np.quantile(near, low / 10))
    return out


def filled(least: np.ndarray) -> np.ndarray:
    """least with the next known value for NaN; 0 where none is known."""
    known = np.flatnonzero(~np.isnan(least))
    return np.interp(np.arange(len(least)), known, least[known]) if len(known) else np.zeros(len(least))


def fit(tf: np.ndarray, langs: list[str], starts: list[bytes], clusters: int, low: float) -> LanguageModel:
    """starts: the first bytes of each row's text."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.zeros((0, len(SIZES))))
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    v, size, y = vectors(tf, idf), np.count_nonzero(tf, axis=1), np.array([names.index(x) for x in langs])
    centroids, owner, least = [], [], []
    for k in range(len(names)):
        rows = np.flatnonzero(y == k)
        c = kmeans(v[rows], clusters, low)
        half = np.arange(len(rows)) % 2
        sizes, cosines, places = [], [], []
        for h in (0, 1):
            mine = rows[half == h]
            other = kmeans(v[rows[half != h]], clusters, low) if (half != h).any() else c
            parts = [(v[mine], size[mine])]
            texts = [x for i in mine for x in heads(starts[i])]
            for i in range(0, len(texts), 256):
                some = texts[i : i + 256]
                x = counts(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]))
                parts.append((vectors(x, idf), np.count_nonzero(x, axis=1)))
            for u, n in parts:
                sizes.append(n)
                cosines.append((u @ other.T).max(1) if len(u) else np.zeros(0))
                places.append(np.argmax(u @ c.T, 1))
        sizes, cosines, places = np.concatenate(sizes), np.concatenate(cosines), np.concatenate(places)
        whole = limits(sizes, cosines, low)
        for j in range(len(c)):
            own = limits(sizes[places == j], cosines[places == j], low)
            least.append(filled(np.fmin(own, whole)))  # a tight centroid accepts what its language does
        centroids.append(c)
        owner += [k] * len(c)
    return LanguageModel(names, idf, np.concatenate(centroids).astype(np.float32), np.array(owner), np.array(least))


def predict(m: LanguageModel, buf: np.ndarray, offs: np.ndarray, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the language (-1: none), cosine, and whether it is rejected."""
    n = len(offs) - 1
    lang, cosine, out = np.full(n, -1), np.zeros(n), np.ones(n, bool)
    if not m.languages:
        return lang, cosine, out
    for i in range(0, n, rows):
        j = min(n, i + rows)
        tf = counts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        sim = vectors(tf, m.idf) @ m.centroids.T
        best = np.argmax(sim, 1)
        lang[i:j] = m.owner[best]
        cosine[i:j] = np.clip(sim[np.arange(j - i), best], 0, 1)
        at = np.log2(np.clip(np.count_nonzero(tf, axis=1), SIZES[0], SIZES[-1])) - np.log2(SIZES[0])
        k = np.minimum(at.astype(np.int64), len(SIZES) - 2)
        out[i:j] = sim[np.arange(j - i), best] < m.least[best, k] + (at - k) * (m.least[best, k + 1] - m.least[best, k])
    return lang, cosine, out


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter in the sense of Unicode."""
    ascii_letter = ~textscan.NON_LETTER[buf] & (buf < 0x80)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = sums[offs[1:]] > sums[offs[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[k] = any(c.isalpha() for c in buf[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", holdout: tuple[int, int] | None = None, sample: int = 4000, clusters: int = 4, low: float = 0.05) -> LanguageModel:
    """Fit on a bounded sample: about sample / languages rows of each language, chosen by the hash of the id.

    At most 256 languages are expected. Texts become count vectors where they are read, so
    the one task that fits the model holds about sample * 16 kB, however long the texts are.
    low: the quantile of the cosines of a centroid's own rows that its limit comes from.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_lang is not null and _text is not null")
    if holdout:
        rows = rows.where(storage.id_remainder("_id", holdout[0]) != holdout[1])
    # Each language's share of the sample, as a bound on the hash of a row; a table of a row a language.
    n = rows.groupBy("_lang").agg(F.count("*").alias("_n"))
    share = n.join(n.agg(F.count("*").alias("_of")), F.lit(True)).select("_lang", (F.least(F.lit(1.0), F.lit(float(sample)) / F.col("_of") / F.col("_n")) * (1 << 30)).cast("long").alias("_most"))
    share = storage.written(share, "shares")
    share = F.broadcast(share) if share.count() <= MOST_BROADCAST else share
    rows = rows.join(share, "_lang").where(F.pmod(F.xxhash64("_id", F.length("_text")), F.lit(1 << 30)) < F.col("_most")).select("_id", "_text", "_lang")

    def start() -> object:
        def run(b: pa.RecordBatch) -> list:
            out: list[bytes | None] = []
            begin: list[bytes] = []
            for i, j, buf, offs in textscan.slices(b.column(1), 1 << 19):
                letters = has_letter(buf, offs)
                for k in range(j - i):
                    out.append(counts(buf[offs[k] : offs[k + 1]], np.array([0, offs[k + 1] - offs[k]])).tobytes() if letters[k] else None)
                    begin.append(buf[offs[k] : min(offs[k + 1], offs[k] + HEAD_BYTES)].tobytes())
            return [out, begin]

        return run

    def learn(t: pa.Table) -> LanguageModel:
        t = t.sort_by([("_lang", "ascending"), ("_id", "ascending")])
        tf = np.frombuffer(b"".join(t.column("_tf").to_pylist()), np.float32).reshape(-1, DIMS)
        return fit(tf, t.column("_lang").to_pylist(), t.column("_start").to_pylist(), clusters, low)

    return storage.fitted(storage.map_columns(rows, [("_tf", T.BinaryType()), ("_start", T.BinaryType())], start, keep=["_id", "_lang"]).where("_tf is not null"), learn)


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", rejected_col: str = "rejected") -> DataFrame:
    """docs with the language, the cosine to its nearest centroid and whether the distance is too great."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def start() -> object:
        m = sent.value
        names = np.array([*m.languages, "und"], object)

        def run(b: pa.RecordBatch) -> list:
            parts = []
            for _, _, buf, offs in textscan.slices(b.column(place)):
                lang, cosine, out = predict(m, buf, offs)
                none = ~has_letter(buf, offs)
                lang[none], cosine[none], out[none] = -1, 0, True
                parts.append((names[lang], cosine, out))
            return [pa.array(np.concatenate([p[k] for p in parts]), t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]

        return run

    return storage.map_columns(docs, [(lang_col, T.StringType()), (score_col, T.DoubleType()), (rejected_col, T.BooleanType())], start)
