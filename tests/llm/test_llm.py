"""Operators against brute-force versions, and their defined results for odd input."""

import base64
import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigweave.llm import bm25, chat, components, decontam, htmltext, jaccard, langid, lm, packing, storage, textscan, toxicity, warc
from sigweave.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "x", "...", "Ünïcode ñandú 日本語 Ж", "word " * 30_000, "a b c d e f", "same text twice in this little table", "same text twice in this little table", "\x00\x01 ctrl", "tail sep nbsp"]


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def odd(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(None, "no id here at all", None, None, None), (3, "x", "en", "s", 0)]
    return table(spark, rows).withColumn("score", F.lit("mine")).withColumn("N_WORDS", F.lit(1)).withColumn("sequence_id", F.lit("q"))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def prose(r, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" for _ in range(n))


# --- scanning ---------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=12), st.integers(1, 60))
def test_words_and_hashes(texts, most):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    seen = {}
    for i, j, buf, offs in textscan.slices(pa.array(texts, pa.string()), most):
        starts, ends, first = textscan.word_spans(buf, offs, textscan.BLANKS)
        h = textscan.span_hashes(buf, starts, ends)
        for k in range(j - i):
            got = [bytes(buf[a:b]) for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])]
            assert got == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", texts[i + k] or "")]
        for a, b, x in zip(starts, ends, h):
            assert seen.setdefault(bytes(buf[a:b]), x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_index(keys, more):
    keys = np.array(sorted(keys), np.uint64)
    asked = np.concatenate([keys, np.array(more, np.uint64)])
    assert textscan.Index(keys).find(asked).tolist() == [int(np.flatnonzero(keys == q)[0]) if (keys == q).any() else -1 for q in asked]


@pytest.mark.parametrize("one_task", [200_000, -1])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", one_task)
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(None, 1), (5, 5)]
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    got = components.components(table(spark, edges, "a long, b long"), "a", "b").collect()
    assert {x.node: x.component for x in got} == want and len(got) == len(want)
    assert components.components(table(spark, [], "a long, b long"), "a", "b").count() == 0


# --- toxicity ---------------------------------------------------------------


def tox_corpus(n=240):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        w = prose(r, r.randrange(20, 200)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["rotter", "scoundrel", "villain"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = tox_corpus()
    docs, lab = table(spark, rows), table(spark, labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab, holdout=(4, 2))
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == (i % 4 == 0) for i in held)
    assert len(held) > 30 and right >= 0.95 * len(held)
    other = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.train(docs, other, holdout=(4, 2))).collect()}
    assert again == got  # held-out labels are not used
    shuffled = {x.doc_id: x.score for x in toxicity.score(docs.repartition(3), model).collect()}
    assert shuffled == pytest.approx(got)


def brute_kneser_ney(words, order, discount):
    """p(class, byte, context) from {word: (documents of class 0, of class 1)}, by the definition."""
    own = [[collections.Counter() for _ in range(order + 1)] for _ in (0, 1)]
    for w, by_class in words.items():
        s = bytes([toxicity.BEGIN, *w, toxicity.FINISH])
        for k in (0, 1):
            for i in range(1, len(s)):
                for n in range(1, min(order, i + 1) + 1):
                    own[k][n][s[i - n + 1 : i + 1]] += by_class[k]
    count = [[None] * (order + 1) for _ in (0, 1)]
    for k in (0, 1):
        for n in range(1, order + 1):
            before = collections.Counter(g[1:] for g, c in own[k][n + 1].items() if c) if n < order else None
            count[k][n] = {g: c if n == order or g[0] == toxicity.BEGIN else before[g] for g, c in own[k][n].items()}

    def p(k, byte, context):
        if context is None:
            return (sum(count[j][1].get(byte, 0) for j in (0, 1)) + 0.5) / (sum(sum(count[j][1].values()) for j in (0, 1)) + 0.5 * toxicity.VALUES)
        n = len(context) + 1
        mine = [{g: c for g, c in count[j][n].items() if g[:-1] == context} for j in (0, 1)]
        kept = [sum(max(c - discount, 0) for c in m.values()) for m in mine]
        low = p(k, byte, context[1:] if context else None)
        if not kept[k]:
            return low
        back = min(1, max(1e-6, 1 - sum(kept) / sum(sum(m.values()) for m in mine)))
        return (1 - back) * max(mine[k].get(context + byte, 0) - discount, 0) / kept[k] + back * low

    return p


def test_kneser_ney():
    r = random.Random(2)
    words = {bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 6))): (r.randrange(0, 9), r.randrange(0, 5)) for _ in range(60)}
    words = {w: c for w, c in words.items() if sum(c)}
    raw = b"".join(words)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    m = toxicity.kneser_ney(np.frombuffer(raw, np.uint8), starts, ends, np.array(list(words.values()), float), 4, 1.5)
    p = brute_kneser_ney(words, 4, 1.5)
    asked = [*words, b"zz", b"dcba", b"abzabc"]
    ends = np.cumsum([len(w) for w in asked])
    starts = ends - [len(w) for w in asked]
    want = []
    for w in asked:
        s = bytes([toxicity.BEGIN, *w, toxicity.FINISH])
        log = [sum(math.log(p(k, s[i : i + 1], s[max(0, i - 3) : i])) for i in range(1, len(s))) for k in (0, 1)]
        want.append(log[1] - log[0])
    assert m.gains(np.frombuffer(b"".join(asked), np.uint8), starts, ends).tolist() == pytest.approx(want, abs=1e-9)
    for context in (b"", b"a", b"ab", b"\x01", b"\x01a", b"\x01ab", b"zq", b"bcd"):
        for k in (0, 1):
            assert sum(p(k, bytes([x]), context) for x in range(toxicity.VALUES)) == pytest.approx(1)


def test_toxicity_odd_input(spark):
    rows, labels = tox_corpus(120)
    lab = table(spark, [*labels, (None, 1, 1), (3, 1, None), (7, 0, 9)], "doc_id long, quality int, toxic int")
    model = toxicity.train(table(spark, rows), lab)
    out = toxicity.score(odd(spark), model)
    got = out.collect()
    assert len(got) == len(ODD) + 2 and all(0 <= x.score <= 1 for x in got) and out.columns.count("score") == 1
    by = collections.defaultdict(set)
    for x in got:
        by[x.doc_id].add(x.score)
    assert by[0] == by[1] == by[2] and by[8] == by[9]
    none = toxicity.train(table(spark, rows), lab.limit(0))
    assert {x.score for x in toxicity.score(odd(spark), none).collect()} < {1e-13, 0.0} or max(x.score for x in toxicity.score(odd(spark), none).collect()) < 0.01
    assert toxicity.score(table(spark, []), model).count() == 0


# --- language ---------------------------------------------------------------

_LANGS = {"aa": ["ka", "ko", "ku", "tak"], "bb": ["sch", "ein", "der", "ung"], "cc": ["éau", "ière", "oui", "ç"]}


def lang_rows(n=240):
    r = random.Random(8)
    return [(i, " ".join("".join(r.choice(_LANGS[k]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 60))), k, "s", 0) for i, k in ((i, "abc"[i % 3] * 2) for i in range(n))]


def test_language(spark):
    docs = table(spark, lang_rows())
    model = langid.train(docs, holdout=(3, 1))
    got = langid.identify(docs, model).collect()
    held = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert len(held) > 40 and all(x.lang_pred == x.lang for x in held) and all(0 <= x.score <= 1 for x in got)
    assert not any(x.rejected for x in got)
    strange = langid.identify(table(spark, [(1, "12 34 %% 5", None, None, 0), (2, "qqq xxx jjj zzz vvv", None, None, 0)]), model).collect()
    assert strange[0].lang_pred == "und" and all(x.rejected for x in strange)


def test_language_odd_input(spark):
    model = langid.train(table(spark, [*lang_rows(60), (999, "text without language", None, "s", 0), (998, None, "aa", "s", 0)]))
    assert model.languages == ["aa", "bb", "cc"]
    got = langid.identify(odd(spark), model).collect()
    pred = {x.doc_id: x.lang_pred for x in got}
    assert len(got) == len(ODD) + 2 and all(pred[i] == "und" for i in (0, 1, 2, 4)) and pred[5] in model.languages
    assert langid.identify(table(spark, [(1, "Ж日本", None, None, 0)]), model).first().lang_pred in model.languages
    empty = langid.train(table(spark, []))
    assert {x.lang_pred for x in langid.identify(odd(spark), empty).collect()} == {"und"}


def test_language_rejects(spark):
    r = random.Random(11)

    def text(parts, n):
        return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))

    junk = [(1000 + i, t, k, "s", 0) for i, (t, k) in enumerate([("zq", "aa"), ("x", "bb"), ("j", "cc"), ("lomi frenav lo", "aa"), ("vwx", "cc")])]
    model = langid.train(table(spark, [*lang_rows(600), *junk]))
    known = [text(_LANGS[k], n) for k in _LANGS for n in (1, 2, 3, 5, 8) for _ in range(20)]
    other = [text(["lo", "mi", "fre", "nav"], n) for n in (12, 25, 50) for _ in range(20)]
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(n)) for n in (12, 25, 50) for _ in range(20)]
    out = []
    for texts in (known, other, noise):
        got = langid.identify(table(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), model).collect()
        out.append(sum(x.rejected for x in got) / len(got))
    assert out[0] <= 0.02 and out[1] >= 0.9 and out[2] >= 0.9


# --- Jaccard ----------------------------------------------------------------


def brute_join(rows, size=5, percent=75):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n=130):
    r = random.Random(seed)
    base = [prose(r, r.choice([1, 3, 4, 5, 6, 12, 40, 80]), 5000).split() for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base)) if r.random() < 0.85 else prose(r, 30, 5000).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        if r.random() < 0.3:
            w += base[0]
        rows.append((i, "  ".join(w).title() if r.random() < 0.3 else " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed, monkeypatch):
    rows = near_copies(seed)
    if seed == 2:  # clusters in several blocks, and both sides of the join shuffled
        monkeypatch.setattr(jaccard, "TASK", 60)
        monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    docs = table(spark, [(i, t, None, None, 0) for i, t in rows])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs).collect()}
    assert got == brute_join(rows)
    assert len({c for _, c in got.values()}) < 110


def test_ties_leave_once(spark):
    """As many ties for any number of buckets, one for a class and leader; classes that link share a leader, and sizes that cannot link tie nothing."""
    r = random.Random(5)
    rows = near_copies(3) + [(1000 + i, " ".join([*w[:60], f"edit{i}", *w[61:]])) for w in [prose(r, 120, 5000).split()] for i in range(40)]
    long = prose(r, 400, 5000).split()
    parts = [" ".join(long[i : i + 12]) for i in range(0, 300, 15)]
    rows += [(2000, " ".join(long)), *((2001 + i, t) for i, t in enumerate(parts))]
    sets = {}
    for i, t in rows:
        ((_, _, buf, offs),) = textscan.slices(pa.array([t]))
        (s,) = jaccard.shingle_sets(buf, offs, 5)
        sets[jaccard._class_number(jaccard.key_of(s), 0)] = (i, set(s.tolist()))
    docs = spark.createDataFrame(rows, "_id long, _text string")
    few, many = ([(x.a, x.b) for x in jaccard._ties(docs, 5, 75, buckets, 0).collect()] for buckets in (3, 40))
    assert len(many) == len(set(many)) and sorted(few) == sorted(many)
    leaders = collections.defaultdict(set)
    for a, b in many:
        leaders[b].add(a)
    for (x, (_, s)), (y, (_, t)) in itertools.combinations(sets.items(), 2):
        assert 100 * len(s & t) < 75 * len(s | t) or leaders[x] & leaders[y]
    assert not any(leaders[x] for x, (i, _) in sets.items() if i >= 2000)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.booleans())
def test_divide_skip(seed, sided):
    r = random.Random(seed)
    base = [r.sample(range(300), r.randrange(1, 40)) for _ in range(5)]
    raw = []
    for _ in range(40):
        s = set(r.choice(base))
        for _ in range(r.randrange(4)):
            s ^= {r.randrange(300)}
        raw.append(s)
    side = np.array([r.randrange(2) for _ in raw]) if sided else None
    links = jaccard.divide_skip([np.array(sorted(s), np.uint64) for s in raw], 75, side)

    def labels(pairs):
        lab = list(range(len(raw)))
        for a, b in pairs:
            x, y = lab[a], lab[b]
            lab = [min(x, y) if v in (x, y) else v for v in lab]
        return lab

    ok = [(a, b) for a, b in itertools.combinations(range(len(raw)), 2) if raw[a] and raw[b] and 100 * len(raw[a] & raw[b]) >= 75 * len(raw[a] | raw[b]) and (side is None or side[a] != side[b])]
    assert labels(links) == labels(ok) and {tuple(sorted(x)) for x in links} <= set(ok)


def test_jaccard_odd_input(spark):
    got = jaccard.join(odd(spark)).collect()
    by = collections.defaultdict(set)
    for x in got:
        by[x.doc_id].add((x.n_shingles, x.component_id))
    assert len(got) == len(ODD) + 2
    assert by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(1, 3)} and by[9] == {(3, 8)} and by[6] == {(1, 6)}
    assert by[None] == {(1, None)}
    assert jaccard.join(table(spark, [])).count() == 0


def test_keep_one(spark):
    r = random.Random(4)
    base = prose(r, 60, 5000).split()
    near = [*base[:30], "edit", *base[31:]]
    other = prose(r, 50, 5000)
    lone = prose(r, 40, 5000)
    rows = [(5, " ".join(base)), (3, " ".join(near)), (3, " ".join(near)), (9, other), (5, other), (7, lone), (7, lone), (None, lone), (None, "only without id"), (None, "only without id"), (None, " ".join(base)), (11, ""), (12, None), (11, "")]
    docs = table(spark, [(i, t, "en", str(k), 0) for k, (i, t) in enumerate(rows)])
    got = collections.Counter((x.doc_id, x.text) for x in jaccard.keep_one(docs).collect())
    assert got == {(3, " ".join(near)): 1, (5, other): 1, (7, lone): 1, (None, "only without id"): 1, (11, ""): 2, (12, None): 1}
    assert jaccard.keep_one(table(spark, [])).count() == 0 and jaccard.keep_one(docs).columns == docs.columns


# --- WARC -------------------------------------------------------------------

PAGES = "page_id long, url string, html string, extra string"


def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "same", "same", "x" * 200_000, "same", "\r\n\r\nWARC/1.1\r\n", "\x1f\u008b\b"]
    rows = [(i, None if i == 2 else f"http://h/{i}\n?é", t, "e") for i, t in enumerate(html)] + [(3, "u", "same", "e"), (None, "u", "same", "e")]
    got = warc.round_trip(table(spark, rows, PAGES)).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.page_id, x)
    for i, t in enumerate(html):
        raw = (t or "").encode()
        twin = max(j for j, u in enumerate(html) if (u or "") == (t or ""))
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (by[i].record_type, by[i].refers_to) == (("response", None) if twin == i else ("revisit", twin))
    assert by[None].refers_to == 6
    more = {x.page_id: x.record_type for x in warc.round_trip(table(spark, rows, PAGES), revisit_from=5).collect()}
    assert set(more.values()) == {"response"}
    assert warc.round_trip(table(spark, [], PAGES)).count() == 0


def test_warc_rolls_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 3000)
    r = random.Random(5)
    rows = [(i, "http://h", "".join(chr(r.randrange(33, 127)) for _ in range(1500)), None) for i in range(40)]
    warc.write(table(spark, rows, PAGES).coalesce(1), str(tmp_path / "w"))
    files = list((tmp_path / "w").rglob("part-*"))
    assert len(files) > 8 and max(f.stat().st_size for f in files) < 3000 + 3 * 1800
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert {x.record_id for x in got if x.gap_reason is None} == {f"<urn:x-page:{i}>" for i in range(40)} and not any(x.gap_reason for x in got)


def archive(n, packed):
    parts = []
    for i in range(n):
        p = (f"<p>page {i}</p>" * (i + 1)).encode()
        raw = warc.record(str(i), f"http://h/{i}", p, warc.digest(p), None, "2000-01-01T00:00:00Z")
        parts.append(warc.gzip.compress(raw, mtime=0) if packed else raw)
    return parts


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    r = random.Random(4)
    for _ in range(60):
        parts = archive(12, packed)
        bad = set(r.sample(range(12), r.randrange(0, 4)))
        for k in bad:
            p = bytearray(parts[k])
            how = r.randrange(3)
            if how == 0:
                p[r.randrange(len(p) // 2, len(p) - 6)] ^= 0x55
            elif how == 1:
                del p[r.randrange(1, len(p) - 5) :]
            else:
                p[: r.randrange(1, 12)] = b""
            parts[k] = bytes(p)
        data = b"".join(parts)
        found = list(warc.salvage(data))
        ids = {int(re.search(r"\d+", x[2]["id"])[0]) for x in found if not isinstance(x[2], str)}
        assert ids >= set(range(12)) - bad and len(ids & bad) <= len(bad)
        gaps = [(a, b) for a, b, x in found if isinstance(x, str)]
        assert bool(gaps) == bool(set(range(12)) - ids) or not bad
        spans = sorted({(a, b) for a, b, _ in found})
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("how", ["record", "checksum", "cut", "flip"])
def test_salvage_within_members(how):
    r = random.Random(6)
    parts = []
    for i in range(12):
        p = bytes(r.randrange(32, 127) for _ in range(3000))
        parts.append(warc.record(str(i), f"http://h/{i}", p, warc.digest(p), None, "2000-01-01T00:00:00Z"))
    if how == "record":
        for k in (3, 4, 8):
            parts[k] = parts[k][:1500] + b"?" + parts[k][1502:]
    first = bytearray(warc.gzip.compress(b"".join(parts), mtime=0))
    if how == "checksum":
        first[-6] ^= 0x55
    elif how == "cut":
        del first[len(first) // 2 :]
    elif how == "flip":
        first[len(first) // 2] ^= 0x55
    last = archive(3, True)
    found = list(warc.salvage(bytes(first) + b"".join(last)))
    ids = [int(re.search(r"\d+", x["id"])[0]) for _, _, x in found if not isinstance(x, str)]
    gaps = [(a, b) for a, b, x in found if isinstance(x, str)]
    assert ids[-3:] == [0, 1, 2]
    if how == "record":
        assert ids[:-3] == [0, 1, 2, 5, 6, 7, 9, 10, 11] and gaps == [(0, len(first))] * 2
    elif how == "checksum":
        assert ids[:-3] == list(range(12)) and not gaps
    else:
        assert {0, 1, 2, 3, 4} <= set(ids[:-3]) and len(set(ids[:-3])) < 12 and gaps == [(0, len(first))]
    spans = sorted({(a, b) for a, b, _ in found})
    assert spans[0][0] == 0 and spans[-1][1] == len(first) + sum(map(len, last)) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    tail = list(warc.salvage(bytes(first)[: len(first) // 3]))  # cut off at the end of the file
    assert tail[0][2]["id"] == "<urn:x-page:0>" and isinstance(tail[-1][2], str) and {(a, b) for a, b, _ in tail} == {(0, len(first) // 3)}


def test_salvage_quarantines_noise(spark, tmp_path):
    parts = archive(3, True)
    (tmp_path / "part-0").write_bytes(parts[0] + b"noise \x1f\x8b\x08 more WARC/ noise" + parts[1] + parts[2][:-9])
    (tmp_path / "part-1").write_bytes(b"")
    got = warc.read(spark, str(tmp_path)).orderBy("start").collect()
    assert [x.record_id for x in got if x.gap_reason is None] == ["<urn:x-page:0>", "<urn:x-page:1>"]
    gaps = [(x.start, x.end) for x in got if x.gap_reason]
    assert gaps[0] == (len(parts[0]), len(parts[0]) + len(b"noise \x1f\x8b\x08 more WARC/ noise")) and len(gaps) == 2
    assert bytes(got[0].payload) == b"<p>page 0</p>"


# --- search -----------------------------------------------------------------


def brute_search(rows, asked, k):
    tok = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) for i, t in rows]
    tf = [(i, collections.Counter(w), len(w)) for i, w in tok]
    n, mean = len(tf), sum(x[2] for x in tf) / len(tf)
    df = collections.Counter(w for _, c, _ in tf for w in c)
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    out = {}
    for q, c, _ in tf:
        if q in asked:
            s = [(round(sum(c[w] * idf[w] * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in c if w in d), 6), i) for i, d, length in tf if c.keys() & d.keys()]
            out[q] = sorted(s, key=lambda x: (-x[0], x[1]))[:k]
    return out


@pytest.mark.parametrize("at_once", [1, 20_000, 1 << 30])
def test_search(spark, monkeypatch, at_once):
    monkeypatch.setattr(bm25, "ROUND_BYTES", at_once)  # a round for each block, for some, for all
    monkeypatch.setattr(bm25, "SHARD_BYTES", 6000)
    monkeypatch.setattr(bm25, "QUERY_BYTES", 4000)
    r = random.Random(12)
    rows = [(i, prose(r, r.randrange(1, 120), 600)) for i in range(260)]
    rows += [(400 + i, rows[i][1]) for i in range(0, 60, 7)] + [(900, ""), (901, None), (902, "...")]
    asked = {i for i, _ in rows if i % 20 == 0}
    got = collections.defaultdict(list)
    docs = table(spark, [(i, t, None, None, 0) for i, t in rows])
    for x in bm25.search(docs, F.col("doc_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.score, x.doc_id))
        assert x["rank"] == len(got[x.query_id])
    want = {q: s for q, s in brute_search(rows, asked, 7).items() if s}
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=2e-6)


def test_search_skips_blocks():
    """Short queries of rare words read few of a shard's blocks, and still find the best."""
    r = random.Random(3)
    texts = [prose(r, r.randrange(20, 60), 20_000) for _ in range(4000)]
    s = bm25.Shard(pa.array(texts, pa.large_string()), list(range(4000)), 40.0, 1.2, 0.75)
    for q in range(0, 4000, 500):
        h = np.unique(bm25.terms(pa.array([" ".join(texts[q].split()[:6])], pa.large_string()))[0])
        word = s.words.find(h)
        s.blocks_read = 0
        (best, score) = next(s.search([(word, np.ones(len(word)))], 3))
        assert q in {s.ids[d] for d in best} and (np.diff(score) <= 0).all()
        assert 0 < s.blocks_read < s.n_blocks // 2


def test_search_odd_input(spark):
    docs = odd(spark)
    got = bm25.search(docs, F.lit(True), k=3).collect()
    assert {x.query_id for x in got} == {3, 5, 6, 7, 8, 9, 10, 11}
    assert [(x.doc_id, x["rank"]) for x in got if x.query_id == 9] == [(8, 1), (9, 2)]
    assert bm25.search(docs, F.lit(False)).count() == 0 and bm25.search(table(spark, []), F.lit(True)).count() == 0


# --- language model ---------------------------------------------------------


def brute_lm(rows, train, m2=300.0, m3=20.0):
    """An automaton of dictionaries: arcs by history and token, one failure arc a history."""
    tok = [(i, [*words(t), None]) for i, t in rows]
    grams = [collections.Counter() for _ in range(3)]
    for i, ws in tok:
        if train(i):
            ws = ["<", *ws]
            for k in range(1, len(ws)):
                for n in range(min(3, k + 1)):
                    grams[n][tuple(ws[k - n : k + 1])] += 1
    n, s = sum(grams[0].values()), sum(v == 1 for v in grams[0].values())
    seen = collections.Counter({h: c for g in grams[:2] for h, c in g.items() if h[-1] is not None})
    seen[("<",)] = grams[0][(None,)]

    def p(h, w):
        if not h:
            return (grams[0][(w,)] or s + 1) / (n + s + 1)
        m = (m2, m3)[len(h) - 1]
        return (grams[len(h)][(*h, w)] + m * p(h[1:], w)) / (seen[h] + m)

    out = []
    for i, ws in tok:
        base = sum(math.log10((grams[0][(w,)] + 0.5) / (n + 0.5 * (len(grams[0]) + 1))) for w in ws)
        score, state = 0.0, ("<",)
        for w in ws:  # one reading that carries the state
            while state and not grams[len(state)][(*state, w)]:
                m = (m2, m3)[len(state) - 1]
                score += math.log10(m / (seen[state] + m))
                state = state[1:]
            score += math.log10(p(state, w))
            state = (*state, w)[-2:]
            while state and not seen[state]:
                state = state[1:]
        out.append((i, len(ws), sum(grams[0][(w,)] > 0 for w in ws), n, base, score))
    return out


def test_lm(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(lm, "STRIP", 5)
    r = random.Random(9)
    rows = [(i, prose(r, r.randrange(0, 150), 300)) for i in range(200)] + [(300, None), (301, ""), (302, "W1 w1 W2"), (303, "the " * 700)]
    docs = table(spark, [(i, t, None, None, 0) for i, t in rows])
    train = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    got = {x[0]: tuple(x) for x in lm.score(docs, storage.id_remainder("doc_id", 5) != 1).collect()}
    for want in brute_lm(rows, train):
        assert got[want[0]][:4] == want[:4] and got[want[0]][4:] == pytest.approx(want[4:], abs=1e-8)


def test_lm_odd_input(spark):
    got = lm.score(odd(spark), F.lit(True)).collect()
    assert len(got) == len(ODD) + 2 and {x.n_tokens for x in got if x.doc_id in (0, 1, 2)} == {1}
    none = lm.score(odd(spark), F.lit(False)).collect()
    assert all(x.train_tokens == 0 and x.n_known == 0 and x.score == pytest.approx(0) for x in none)
    assert lm.score(table(spark, []), F.lit(True)).count() == 0


def test_lm_repeated_rows_and_distributions(spark):
    rows = [(None, "a b c a b d", "en", "s", 0)] * 40 + [(1, "a b c", "en", "s", 0), (1, "a b c", "en", "s", 0), (2, "z", "en", "s", 0)]
    got = lm.score(table(spark, rows), F.lit(True)).collect()
    assert len(got) == 43 and len({x.score for x in got if x.doc_id is None}) == 1 and {x.train_tokens for x in got} == {40 * 7 + 2 * 4 + 2}
    # After "a b", the probabilities of all tokens and the unknown one add up to 1.
    text = [t for _, t, *_ in rows]
    tails = ["a", "b", "c", "d", "z", "unknown"]
    more = [*((k, t) for k, t in enumerate(text)), *((1000 + k, f"a b {w} q q") for k, w in enumerate(tails)), (2000, "a b")]
    scored = {x.doc_id: x.score for x in lm.score(table(spark, [(i, t, None, None, 0) for i, t in more]), F.col("doc_id") < 1000).collect()}
    want = {i: sc for i, *_, sc in brute_lm(more, lambda i: i < 1000)}
    assert all(scored[i] == pytest.approx(want[i], abs=1e-9) for i in scored)


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**48 - 1), max_size=40), st.booleans())
def test_key_bytes(keys, many):
    keys = np.array(sorted(keys | set(range(7, 2**48, 2**48 // 2500) if many else ())), np.uint64)
    assert lm.unpacked(lm.packed(keys)).tolist() == keys.tolist()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_count_bytes(c):
    c = np.array(c, np.int64)
    assert lm.large(lm.small(c), len(c)).tolist() == c.tolist()


# --- packing ----------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan(counts):
    rows = packing.plan(counts, 64)
    got = collections.defaultdict(list)
    seen = collections.Counter()
    for length, rank, n, first, offset in rows:
        assert rank == seen[length] and n > 0
        seen[length] += n
        for i in range(n):
            got[first + i].append((offset, length))
    assert seen == counts
    for s in got.values():
        s.sort()
        assert [o for o, _ in s] == [0, *itertools.accumulate(n for _, n in s)][:-1] and sum(n for _, n in s) <= 64
    # As many sequences as best-fit decreasing over single pieces.
    bins = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= length]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= length
        else:
            bins.append(64 - length)
    assert len(got) == len(bins)


def test_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SALT_ROWS", 3)
    slow = Tokenizer.from_file(tokenizer_path())
    r = random.Random(1)
    texts = [*ODD, "stop <|endoftext|> go", "it's  we'll\n\n x1 22 !!", *(prose(r, r.randrange(0, 900)) for _ in range(40)), *["twin"] * 9]
    docs = table(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    got = packing.pack(docs, tokenizer_path(), keep_ids=True).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        pieces[x.doc_id].append(x)
        sequences[x.sequence_id].append(x)
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
    for i, t in enumerate(texts):
        p = sorted(pieces[i], key=lambda x: x.piece)
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        assert [y for x in p for y in x.ids] == ids and [x.piece for x in p] == list(range(len(p)))
        assert [x.start for x in p] == [0, *itertools.accumulate(x.length for x in p)][:-1] and all(x.length == 1024 for x in p[1:])
    for s in sequences.values():
        s.sort(key=lambda x: x.offset)
        assert [x.offset for x in s] == [0, *itertools.accumulate(x.length for x in s)][:-1] and sum(x.length for x in s) <= 1024
    assert len(sequences) == packing_bound(got)


@pytest.mark.parametrize("text", ["\n" * 1_000_000, " " * 300_000 + "x", "a" * 1_000_000, "x \n" * 200_000])
def test_encoder_on_hostile_texts(text):
    import time

    encode, began = packing.Encoder(tokenizer_path()), time.time()
    ids = encode(text)
    assert encode.slow.decode(ids.tolist(), skip_special_tokens=False) == text and time.time() - began < 20
    assert ids.tolist() == encode.slow.encode(text, add_special_tokens=False).ids


def packing_bound(got):
    bins = []
    for n in sorted((x.length for x in got), reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= n
        else:
            bins.append(1024 - n)
    return len(bins)


def test_packing_odd_input(spark):
    got = packing.pack(odd(spark), tokenizer_path())
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    assert {x.length for x in rows if x.doc_id in (0, 1)} == {1} and sum(x.doc_id == 3 for x in rows) == 2 and sum(x.doc_id is None for x in rows) == 1
    assert packing.pack(table(spark, []), tokenizer_path()).count() == 0


# --- decontamination --------------------------------------------------------


def brute_scan(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, found = split(text), set(), set()
    for i, t in items:
        b = split(t)
        k = min(13, len(b))
        for p in range(len(b) - k + 1) if b else ():
            for q in range(len(w) - k + 1):
                if w[q : q + k] == b[p : p + k]:
                    hit |= set(range(q, q + k))
                    found.add(str(i))
    found = sorted(found)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_decontamination(spark, most):
    r = random.Random(6)
    items = [(i, prose(r, r.choice([1, 5, 12, 13, 14, 30]), 3000)) for i in range(14)] + [(50, None), (51, "  "), (52, "Ünder ÜBER é-x")]
    texts = [*ODD, "ünder Über é x"]
    for _ in range(60):
        w = prose(r, r.randrange(0, 60), 3000).split()
        b = r.choice(items[:14])[1].split()
        a = r.randrange(len(b))
        at = r.randrange(len(w) + 1)
        w[at:at] = b[a:] if r.random() < 0.4 else b
        texts.append("\n".join(w).upper() if r.random() < 0.3 else ", ".join(w))
    docs = table(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    bench = table(spark, items, "item_id long, text string")
    got = {x.doc_id: x for x in decontam.scan(docs, bench, most_words=most).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == brute_scan(t, items), t
        inside = sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t[s.start : s.end]))) for s in x.hit_spans)
        assert inside == x.n_hit
    assert sum(x.contaminated for x in got.values()) > 20


def test_decontamination_odd_input(spark):
    bench = table(spark, [(1, "same text twice in this little table"), (None, "x"), (2, "same text twice in this little table")], "item_id long, text string")
    got = decontam.scan(odd(spark), bench).collect()
    assert len(got) == len(ODD) + 2 and {(x.n_items, x.contaminated) for x in got if x.doc_id in (8, 9)} == {(2, True)}
    assert not any(x.contaminated for x in got if x.doc_id not in (8, 9))
    assert sum(x.n_hit for x in decontam.scan(odd(spark), bench.limit(0)).collect()) == 0
    assert decontam.scan(table(spark, []), bench).count() == 0


# --- chat -------------------------------------------------------------------

_CHAT = st.text(alphabet=st.sampled_from(list("<>/[]\\sINSTYURN aé\n")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a b]\n"]), _CHAT | st.sampled_from(["</s>[INST] ok [/INST]", "[TURN x] y [/TURN]", "<\\/s>", "[INST", "[SYS note] hello", "[INST x] hi", "[/INST x] ", "[SYS", "[TURN]"]) | st.lists(st.sampled_from(["[SYS", "[INST", "[TURN", "[/", "] ", " ", "x", "<s>", "</s>", "\\"]), max_size=6).map("".join)), max_size=6))
@example([("assistant", "[SYS note] hello")])
@example([("assistant", "[INST x] hi"), ("user", "q")])
def test_chat_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.read(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_chat_events(spark):
    rows = [
        (1, 1, "user", "hi", "message", 0), (1, 2, "assistant", "he", "message", 1), (1, 3, None, "llo", "delta", None), (1, 4, None, "hey", "edit", 0), (1, 5, None, None, "delta", 1),
        (1, 6, None, "new", "regenerate", 1), (1, 7, None, "er", "delta", 1), (1, 8, None, "lost", "edit", 77), (1, 9, "tool", "t", "message", 2), (1, 10, None, None, "delete", 2),
        (2, 1, "assistant", "a", "delta", 5), (2, 2, "assistant", "b", "delta", 5), (3, 1, None, None, "delete", 1), (None, 1, None, None, None, None),
    ]
    random.Random(2).shuffle(rows)
    log = table(spark, rows, "conv_id long, seq long, role string, text string, kind string, turn long")
    got = {x.conv_id: x for x in chat.format_logs(log, seq_col="seq", kind_col="kind", target_col="turn").collect()}
    assert chat.read(got[1].formatted) == [("user", "hey"), ("assistant", "newer")] and chat.read(got[2].formatted) == [("assistant", "ab")]
    assert got[3].formatted == "<s>" and chat.read(got[None].formatted) == [("", "")]
    assert chat.format_logs(log.limit(0), seq_col="seq").count() == 0


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", None), (2, 0, "user", "é" * 70_000), (1, 1, "assistant", "two"), (3, None, "assistant", "</s>")]
    got = {x.conv_id: x for x in chat.digests(chat.format_logs(table(spark, rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(0)))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("user\n\nassistant\ntwo\nassistant\ntwo\n"), 6, sha("twotwo"))
    assert got[2].loss_sha256 == sha("") and got[2].formatted_chars == 3 + 15 + 70_000 and got[3].loss_sha256 == sha("</s>")


# --- HTML -------------------------------------------------------------------


def test_blocks():
    page = "<p>a <b>b</b>c&amp;d<br>e<p>&lt;x&gt;  y\n z</p><script>if (a<b) '</p>'</script><!-- <p>no</p> --><td>t<style>p{}</style><a href='a>b'>l</a></td><div"
    assert [b[1] for b in htmltext.blocks(page)] == ["a bc&d e", "<x> y z", "tl"]
    assert htmltext.blocks("") == [] and htmltext.blocks("<p></p><")[0][1] == "<"
    assert [b[1] for b in htmltext.blocks("<p class='a>b\">one<p>two</p><p id=x' y'>three")] == ['b">one', "two", "three"]
    assert [b[1] for b in htmltext.blocks("<p>x</p><di")] == ["x"]


@pytest.mark.parametrize("part", ["<p b", "<div>", "<p \"", "<p '\"", "</x>", "<div><p>x", "<!--", "<script>", "<", "<a href='x' class=\"y", "&#x", "<div>x</b></p>", "<li>x<ul>", "<p class"])
def test_blocks_of_hostile_pages(part):
    import time

    began = time.time()
    found = htmltext.blocks(part * (1_000_000 // len(part)))
    htmltext.features([found])
    assert time.time() - began < 10


def test_html_labeller(spark):
    m = htmltext.train(spark)
    x, first, y = htmltext.training_set(250, 4242)
    assert ((m.logits(x, first) > 0) == (y > 0)).mean() > 0.985
    page = "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy it now and save much.</div><article><h1>Title</h1><p>First &amp; best text of it.</p><p>Second one.</p></article><div class='comments'><p>I like it very much.</p></div><footer>&copy; me</footer></body></html>"
    rows = [(1, page), (2, None), (3, ""), (4, "<br><div></div>"), (5, page), (6, "<article>" + "<p>Long words here.</p>" * 3000 + "</article>")]
    pages = table(spark, rows, "page_id long, html string").withColumn("TEXT", F.lit("old"))
    got = {r.page_id: r for r in htmltext.extract(pages).collect()}
    assert got[1].text == got[5].text == "Title First & best text of it. Second one." and got[1].n_chars == len(got[1].text)
    assert [got[i].text for i in (2, 3, 4)] == ["", "", ""] and got[6].text == " ".join(["Long words here."] * 3000)
    assert htmltext.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_html_truth(spark, size):
    """The text of every page of the driver's tables is that of its article."""
    import os

    if not os.path.isdir(f"/root/testdata/{size}"):
        pytest.skip("no test tables here")
    pages = storage.table(spark, f"/root/testdata/{size}", "pages")
    got = {x.page_id: x.text for x in htmltext.extract(pages).collect()}
    for x in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", x.html, re.S)[1]
        want = " ".join(htmltext.html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())
        assert got[x.page_id].split() == want.split()


_ONE = "The committee met on Tuesday to discuss the new proposals and agreed that more work was needed before the vote."
_TWO = "Several members asked for a second reading, which the chair promised to arrange within the month for all parties."
_LINKS = ["<a href='/'>Home</a>", "<a href='/p'>Products</a>", "<a href='/c'>Contact</a>"]
LAYOUTS = {
    "nameless": (f"<div class='x9 q7'><p>{_ONE}</p><p>{_TWO}</p></div>", f"{_ONE} {_TWO}"),
    "nameless with a menu": (f"<div class='a1'>{' '.join(_LINKS)}</div><div class='x9 q7'><h1>A title</h1><p>{_ONE}</p><p>{_TWO}</p></div><div class='zz'>&copy; 2020 Site</div>", f"A title {_ONE} {_TWO}"),
    "no element": (f"<p>{_ONE}</p><p>{_TWO}</p>", f"{_ONE} {_TWO}"),
    "link column": (f"<table><tr><td>{' '.join(_LINKS)}</td><td><h1>Title</h1><p>{_ONE}</p><p>{_TWO}</p></td></tr></table>", f"Title {_ONE} {_TWO}"),
    "link column by lines": (f"<table><tr><td>{'<br>'.join(_LINKS)}</td><td>{_ONE}<br><br>{_TWO}</td></tr></table>", f"{_ONE} {_TWO}"),
    "rows above and below": (f"<table width=100%><tr><td colspan=2>My Site</td></tr><tr><td><ul><li>{'<li>'.join(_LINKS)}</ul></td><td><p>{_ONE}</p><p>{_TWO}</p></td></tr><tr><td colspan=2>&copy; 2003 Me</td></tr></table>", f"{_ONE} {_TWO}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_html_of_old_pages(spark, name):
    page, want = LAYOUTS[name]
    assert htmltext.main_text(htmltext.train(spark), [f"<html><body>{page}</body></html>"]) == [want]


def test_html_weights_are_those_of_the_script():
    """The stored weights have the shapes of the module's parameters, and a small training gives the same twice."""
    assert [w.shape for w in htmltext.stored()] == [w.shape for w in htmltext.Labeller(0).w]
    one, two = (htmltext.fitted(20, 1, 3) for _ in range(2))
    assert all((a == b).all() for a, b in zip(one, two))


def test_html_without_known_names(spark):
    m, r = htmltext.train(spark), random.Random(3)
    right = total = 0
    for k in range(60):
        paragraphs = [prose(r, r.randrange(25, 90)).capitalize() + "." for _ in range(r.randrange(3, 9))]
        links = "".join(f"<li><a href=x>{prose(r, 2)}</a></li>" for _ in range(6))
        page = f"<html><head><title>t</title></head><body><div class='q{k}'><ul>{links}</ul></div><div class='x9 q7'><h1>Some title</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div class='zz'><form><label>mail</label><button>go</button></form></div><div id=b3>&copy; us</div></body></html>"
        got = htmltext.main_text(m, [page])[0]
        right += sum(p in got for p in paragraphs)
        total += len(paragraphs)
    assert right >= 0.9 * total


def test_lstm_gradient():
    x, first, y = htmltext.training_set(3, 1)
    m = htmltext.Labeller(2)
    m.w = [w.astype(np.float64) for w in m.w]

    def loss():
        p = 1 / (1 + np.exp(-m.logits(x, first)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    before = loss()
    m.fit(x, first, y, 5, 0, rate=0.003)
    assert loss() < before


# --- the pipeline -----------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = tox_corpus(120)
    r = random.Random(3)
    item = prose(r, 30, 9000)
    rows += [(500, rows[1][1], "en", "s", 0), (501, item, "en", "s", 0), (502, "123 456", "en", "s", 0), (503, None, None, None, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, [(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = storage.table(spark, str(tmp_path), "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.written(stage(spark, docs, str(tmp_path)), name)
        kept.append({x.doc_id for x in docs.select("doc_id").collect()})
    all_ids = {x[0] for x in rows}
    clean = {i for i, *_ in rows[:120] if i % 4}
    assert len(clean & kept[0]) >= 0.97 * len(clean) and len({i for i in range(0, 120, 4)} & kept[0]) <= 3
    assert kept[1] == kept[0] - {502, 503}
    near = brute_join([(i, t) for i, t, *_ in rows if i in kept[1]])
    assert kept[2] == {i for i, (_, c) in near.items() if c == i} and 500 not in kept[2]
    assert kept[3] == {i for i, t, *_ in rows if i in kept[2] and not brute_scan(t, [(1, item)])[-1]} and 501 in kept[2] - kept[3]
    assert kept[4] == kept[3] and docs.columns[0] == "doc_id" and all_ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


@pytest.mark.parametrize("some", [True, False])
def test_pipeline_odd_input(spark, tmp_path, some):
    """Null ids, texts and labels, rows that repeat, an extra column of a clashing name; and empty tables."""
    import corpus_pipeline

    rows, labels = ([(i + 1000, *more) for i, *more in x] for x in tox_corpus(80))
    docs = odd(spark).drop("N_WORDS").unionByName(table(spark, rows).withColumn("score", F.lit("mine")).withColumn("sequence_id", F.lit("q")))
    docs = docs if some else docs.limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lab = table(spark, [*labels, (None, None, None), (3, None, None), (5, 1, 7)], "doc_id long, quality int, toxic int")
    (lab if some else lab.limit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    bench = table(spark, [(1, "a b c d e f"), (None, None)], "item_id long, text string")
    (bench if some else bench.limit(0)).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {x.doc_id for x in got}
    assert (len(ids & {i + 1000 for i in range(80) if i % 4}) > 40 and 7 not in ids) if some else not got


# --- hostile texts ----------------------------------------------------------


@pytest.mark.parametrize("run", [10, 1000, 5000, 30_000, 49_999, 50_001])
@pytest.mark.parametrize("blank", [" ", "\n", " \t\u00a0"])
def test_blank_runs(run, blank):
    encode = packing.Encoder(tokenizer_path())
    text = ("x" + (blank * run)[:run]) * (1_000_000 // (run + 1) + 1)
    began = time.time()
    ids = encode(text)
    assert time.time() - began < 5
    assert len(text) > 200_000 or ids.tolist() == encode.slow.encode(text, add_special_tokens=False).ids
    assert len(ids) and ids.tolist()[:50] == encode.slow.encode(text, add_special_tokens=False).ids[:50]


MARKS = {
    "version": b"WARC/1.0 ", "version lines": b"WARC/1.0\r\n", "headers": b"WARC/1.0\r\na: b\r\n", "ends": b"WARC/1.0\r\na: b\r\n\r\n", "long lines": b"WARC/1.0\r\nA:" + b"x" * 300,
    "names": b"WARC/1.0\r\n" + b"".join(b"a%d:WARC/1.0\r\n" % i for i in range(400)), "magic": b"\x1f\x8b\x08", "member": b"\x1f\x8b\x08\0\0\0\0\0\0\3", "name": b"\x1f\x8b\x08\x08\0\0\0\0\0\3n",
}


@pytest.mark.parametrize("packed", ["plain", "cut", "stored"])
@pytest.mark.parametrize("mark", MARKS)
def test_salvage_of_marks_is_linear(mark, packed):
    noise = (MARKS[mark] * (1_000_000 // len(MARKS[mark]) + 1))[:1_000_000]
    good = warc.record("1", None, b"payload", warc.digest(b"payload"), None, "2000-01-01T00:00:00Z")
    data = noise if packed == "plain" else gzip.compress(noise, 0 if packed == "stored" else 6)[:-20]
    began = time.time()
    found = [r for _, _, r in warc.salvage(data + good)]
    assert time.time() - began < 5
    assert [r["id"] for r in found if not isinstance(r, str)] == ["<urn:x-page:1>"] and any(isinstance(r, str) for r in found)


def test_round_trip_misses_a_lost_file(spark, monkeypatch):
    import os

    write = warc.write

    def lossy(pages, path, **k):
        n = write(pages, path, **k)
        os.remove(next(os.path.join(d, f) for d, _, fs in os.walk(path.removeprefix("file:")) for f in fs if f.startswith("part-")))
        return n

    pages = table(spark, [(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").repartition(4)
    assert warc.round_trip(pages).count() == 20
    monkeypatch.setattr(warc, "write", lossy)
    with pytest.raises(ValueError, match="are left of"):
        warc.round_trip(pages)
