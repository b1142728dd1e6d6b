"""Hard negatives, collocations and license scans against plain versions, with nulls, ties, repeats, empty tables and clashing names."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import collocations, licenses, negatives
from tapeloom.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, a_bucket string, score double, id int"


def plain_negatives(rows, every=100):
    ok = [(i, [math.floor(256 * float(x)) for x in v], lab) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (i, v, lab) in enumerate(ok):
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, other) for m, (j, w, other) in enumerate(ok) if m != n)
        for s, j, _ in [x for x in scored if x[2] == lab][:5]:
            mine = [(t, k) for t, k, other in scored if other != lab and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(mine, 1)]
    return sorted(out)


def clustered(seed, n, dim=16):
    """Vectors around a few centres with few large coordinates, of very different lengths."""
    rng = np.random.default_rng(seed)
    centres = np.where(rng.random((12, dim)) < 0.2, rng.normal(size=(12, dim)) * 4, 0.05)
    which = rng.integers(0, 12, n)
    vecs = (centres[which] + rng.normal(size=(n, dim)) * 0.15) * rng.lognormal(0, 0.7, n)[:, None]
    return [(int(i), [float(np.float32(x)) for x in v], int(rng.integers(0, 4))) for i, v in enumerate(vecs)]


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], VECTORS)
    return sorted(tuple(r) for r in negatives.mine(df, **how).collect())


def test_hard_negatives_match_a_plain_version(spark):
    rows = clustered(1, 700)
    odd = [(None, [1.0] * 16, 1), (900, None, 1), (901, [1.0] * 16, None), (1000, [1.0, None] * 8, 2), (1100, [float("nan")] + [0.0] * 15, 2), (1200, [float("inf")] + [0.0] * 15, 2)]
    odd += [(1300, [0.0] * 16, 3), (1301, [], 3), (1302, [0.5, 0.25], 3), (1400, [3.0] * 16, 1), (1400, [3.0] * 16, 1), (1401, [3.0] * 16, 1), (1500, [-1.0] * 16, 2), (-200, [0.5] * 20, 0)]
    odd += [(2000 + i, [2.0] * 16, i % 3) for i in range(300)]  # one very common vector
    want = plain_negatives(rows + odd)
    assert len(want) > 300
    assert mined(spark, rows + odd) == want


def test_hard_negatives_of_tables_without_anchors_or_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(100, [1.0], 1), (2, [0.5], 2)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(100, 1, 1, 2, 65536, 32768)]


def test_large_components_are_scored_exactly(spark):
    rows = [(100, [60000.1] * 16, 1), (1, [60000.1] * 15 + [59999.9], 1), (2, [30000.3] * 16, 2), (3, [30000.3] * 15 + [30000.29], 2)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert mined(spark, rows) == plain_negatives(rows)


def search_of(rows, slab, seed, monkeypatch):
    monkeypatch.setattr(negatives, "SLAB", slab)
    monkeypatch.setattr(negatives, "SEED", seed)
    q = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows], np.int32)
    ids, labels = (np.array([r[k] for r in rows], np.int64) for k in (0, 2))
    order = np.argsort(-(q.astype(float) ** 2).sum(1), kind="stable")
    ids, labels, q = ids[order], labels[order], q[order]
    bs = []
    for number, at in enumerate(range(0, len(ids), 100)):
        b = negatives.Bucket.of(ids[at : at + 100], labels[at : at + 100], q[at : at + 100])
        b.number = number
        bs.append(b)
    who = np.flatnonzero(ids % 10 == 0)
    return bs, who, ids, labels, q


@pytest.mark.parametrize(("slab", "seed"), [(7, 5), (500, 1000)])
def test_pruned_searches_lose_nothing_whatever_the_slabs_and_seeds(monkeypatch, slab, seed):
    rows = clustered(2, 900)
    bs, who, ids, labels, q = search_of(rows, slab, seed, monkeypatch)
    met = []
    matches = negatives.Search.matches
    monkeypatch.setattr(negatives.Search, "matches", lambda self, b, w, r: met.append(len(w) * (len(b.ids) if r is None else len(r))) or matches(self, b, w, r))
    search = negatives.Search(who // 100, who % 100, labels[who], q[who], np.full((len(who), 1), negatives.FAR.min), np.full((len(who), 1), negatives.FAR.max), True, 5)
    search.seed(negatives.Bucket.of(ids[who][:seed], labels[who][:seed], q[who][:seed]), np.arange(len(who)))
    met.clear()
    for b in bs:
        search.scan(b)
    slot, score, found = search.hits
    for n, i in enumerate(who):
        s = q.astype(np.int64) @ q[i].astype(np.int64)
        want = sorted((-s[j], ids[j]) for j in range(len(ids)) if labels[j] == labels[i] and j != i)[:5]
        assert [(-a, b) for a, b in zip(score[slot == n], found[slot == n], strict=True)] == want
    assert sum(met) < 0.6 * len(who) * len(ids)  # coordinate ranges and lengths leave out the rest


DOC = "doc_id long, text string, lang string, id int, n long, spans string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_collocations(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lowered(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    covered = Counter()
    for p, a in cand.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                sub = (p[0], *p[i : i + k])
                covered[sub] = max(covered[sub], a)
    found = {}
    for p, a in cand.items():
        if 100 * covered[p] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[p[:c]] + f[(p[0], *p[c:])]), c, f[p[:c]], f[(p[0], *p[c:])]) for c in range(2, len(p))]
        score, _, left, right = min(cuts)
        found.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, xs in found.items() for r, (s, a, p, left, right) in enumerate(sorted(xs)[:top], 1))


def phrases_text(seed, n):
    rng = random.Random(seed)
    stock = ["New York", "of the", "machine learning model", "in spite of", "Éa ñu", "state-of the art thing", "x"]
    words = [rng.choice(stock) if rng.random() < 0.4 else "w%d" % min(rng.randrange(60), rng.randrange(60)) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " \u00a0 "]) for w in words)


TEXTS = [(phrases_text(i, 150), ("en", "fr", None, "und")[i % 4]) for i in range(24)] + [(None, "en"), ("", "en"), (" .\t\n", "xx"), ("alone", "yy"), (phrases_text(3, 150), None), ("Q" * 5000 + " " + "a b " * 400, "en")]


def collocated(spark, rows, **how):
    df = spark.createDataFrame([(i, t, lang, 7, 8, "z") for i, (t, lang) in enumerate(rows)], DOC)
    got = collocations.collocations(df, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_collocations_match_a_plain_version(spark):
    want = plain_collocations(TEXTS, 5)
    assert len(want) > 100 and any(len(r[2].split(" ")) == 4 for r in want)
    assert collocated(spark, TEXTS, least=5) == want
    assert collocated(spark, TEXTS, least=5, top=7) == plain_collocations(TEXTS, 5, 7)


def test_collocations_with_most_words_joined_and_phrases_in_many_passes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HEAD_WORDS", 5)
    monkeypatch.setattr(collocations, "SLICE", 40)
    rows = TEXTS + [(("long" * 30 + " tail ") * 9, "en")]  # a frequent word too long for the head
    assert collocated(spark, rows, least=4) == plain_collocations(rows, 4)


def test_collocations_of_tables_without_phrases(spark):
    assert collocated(spark, []) == []
    assert collocated(spark, [(None, None), ("a b", "en")]) == []


@pytest.mark.parametrize(("chunk", "piece"), [(10, 7), (64, 50), (10**6, 10**6)])
def test_streams_are_the_same_however_they_are_cut(monkeypatch, chunk, piece):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", piece)
    text = phrases_text(5, 300).encode()
    assert b"".join(collocations.text_slices(text)) == text.translate(collocations._LOWER)
    head = pa.table({"lang": ["en"] * 62, "word": pa.array([b"x", b"w1"] + [b"w%d" % i for i in range(2, 62)], pa.binary()), "id": list(range(62))})
    batch = pa.record_batch([pa.array(["en", "fr", "en"]), pa.array([text, b"x x", None], pa.binary())], names=["lang", "text"])
    counts, words = Counter(), 2
    for out in collocations._count_level(words)(iter([next(iter([b])) for b in [
        pa.record_batch([b.column("own"), b.column("ids"), b.column("ids")], names=["own", "ids", "gram"]) for b in collocations._encode(SimpleNamespace(value=(f"k{chunk}", head)))(iter([batch]))]])):
        for a, b, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            counts[a, b] += n
    number = dict(zip(head["word"].to_pylist(), range(62), strict=True))
    want = Counter()
    for part in re.split(rb"[\n]", text.translate(collocations._LOWER)):
        w = [number.get(x, -1) for x in part.split()]
        want.update((w[i], w[i + 2]) for i in range(len(w) - 2) if min(w[i : i + 3]) >= 0)
    assert counts == want


def test_dense_and_sparse_tiles_count_alike(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = (np.minimum(rng.zipf(1.3, 50000) - 1, 40000) for _ in range(2))
    want = Counter(zip(a.tolist(), b.tolist(), strict=True))
    for least in (1, 500, 10**9):
        monkeypatch.setattr(collocations, "DENSE", least)
        got = collocations.count_pairs(a, b)
        assert {(x, y): n for x, y, n in zip(*(c.tolist() for c in got), strict=True)} == want and len(got[0]) == len(want)


def test_cut_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(9_000_000_000_000_000_000, 9_000_000_000_000_000_000, 9_100_000_000_000_000_000), (30, 31, 32), (7, 7, 7)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select(collocations.weakest_cut(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r.s for r in df.collect()] == [2_000_000 * a // (x + y) for a, x, y in rows]


def plain_scan(text, notices, phrases):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    places = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, score = {label for _, label in places}, 0.0
    for words, label in notices:
        t, votes = words.split(), {}
        for i in range(len(w) - 2):
            for j in range(len(t) - 2):
                if w[i : i + 3] == t[j : j + 3]:
                    votes.setdefault(i - j, set()).add(j)
        groups, last = [], None
        for d in sorted(votes):
            if last is None or d - last > 3:
                groups.append(set())
            last = d
            groups[-1] |= {j + k for j in votes[d] for k in range(3)}
        for g in groups:
            if len(g) / len(t) >= 0.6:
                labels.add(label)
                score = max(score, len(g) / len(t))
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


def license_texts():
    rng = random.Random(4)
    filler = lambda n: " ".join("w%d" % rng.randrange(50) for _ in range(n))
    out = [None, "", " .,", "mit", "MIT License; mit-license! CC BY cc by cc", "GNU General Public License " * 3, filler(200)]
    for words, _ in licenses.NOTICES:
        w = words.split()
        out.append(filler(30) + " " + words.title() + ". " + filler(5))
        cut = w[: len(w) // 2] + ["inserted", "words"] + w[len(w) // 2 :]  # neighbouring diagonals
        out.append(" ".join(cut) + "\n" + filler(40))
        out.append(filler(10) + " " + " ".join(w[: len(w) // 2]) + " " + filler(80) + " " + " ".join(w[len(w) // 2 :]))  # far apart
        out.append(" ".join([words] * 3))
    return out + ["Released under the MIT License. " * 4000 + filler(60000)]


def test_license_scans_match_a_plain_version(spark):
    texts = license_texts()
    rows = [(i, t, "en", 1, 2, "s") for i, t in enumerate(texts)] + [(None, texts[8], None, None, None, None), (3, "mit", "en", 1, 2, "s"), (9, texts[9], "en", 1, 2, "s"), (9, texts[9], "en", 1, 2, "s")]
    got = licenses.scan(spark.createDataFrame(rows, DOC))
    assert got.columns[:4] == ["doc_id", "text", "lang", "id"] and got.columns.count("spans") == 1
    mine = sorted(((r.doc_id is None, r.doc_id or 0), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in got.collect())
    want = sorted(((r[0] is None, r[0] or 0), plain_scan(r[1], licenses.NOTICES, licenses.PHRASES)) for r in rows)
    assert str(mine) == str(want)
    assert sum(w[1][6] > 0 for w in want) > 40 and any(w[1][6] == 0 and w[1][1] for w in want)


def test_spans_say_where_a_notice_stands(spark):
    text = "one two Released under the MIT License three"
    (row,) = licenses.scan(spark.createDataFrame([(1, text, "en", 1, 2, "s")], DOC)).collect()
    assert [(s.start, s.end, s.label, s.cover) for s in row.spans] == [(2, 7, "mit", 1.0)] and row.text == text


def test_license_scans_of_an_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], DOC)).collect() == []


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_collocations", "op13_license_scans"])
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 3
