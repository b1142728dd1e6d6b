"""The pipeline against a plain version of its stages, and the guard of the entry module."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import lines, pieces, quality, sharding
from tapeloom.llm.common import table
from tapeloom.llm.queries import QUERIES
from tapeloom.llm.words import ASCII_LOWER

from test_operators import lines_by_force

SF = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def graded(rows, model):
    ids = [x for _, own in quality._features([t.encode() for _, t in rows]) for x in own]
    return [r for r, p in zip(rows, model.tails(ids)[:, -1], strict=True) if p >= quality.CUT]


def without_copied_lines(rows):
    """The lines that stay, by the plain version of the operator's tests."""
    return sorted(lines_by_force(sorted(rows)).items())


def one_of_each(rows):
    sets = {}
    for d, t in rows:
        w = t.encode().translate(ASCII_LOWER).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders = defaultdict(list)
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for d in sorted(sets):
        shared = Counter(e for s in sets[d] for e in holders[s])
        for e, n in shared.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                up[b] = a
        for s in sets[d]:
            holders[s].append(d)
    return [(d, t) for d, t in rows if root(d) == d]


def without_benchmark(rows, bench):
    low = lambda t: re.findall(WORD, t.encode().translate(ASCII_LOWER).decode())
    windows = set()
    for t in bench:
        w = low(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if w else 0)}
    out = []
    for d, t in rows:
        w = low(t)
        hit = {i + j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(n)}
        if hit:
            tokens = re.findall(r"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)
            t = "".join(x for i, x in enumerate(tokens) if i not in hit)
        if t or not hit:
            out.append((d, t))
    return out


def test_run_matches_a_plain_version(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = graded(rows, quality.train(docs, labels))
    rows = without_copied_lines(rows)
    rows = one_of_each(rows)
    rows = without_benchmark(rows, [r.text for r in table(spark, SF, "benchmark").collect()])
    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    want = {d: sp.encode(t) for d, t in rows}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns_and_survive_an_empty_table(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).columns == docs.columns
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_line_query_matches_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    left = dict(without_copied_lines(rows))
    got = {r.doc_id: r.text for r in lines.drop_copied_lines(table(spark, SF, "documents")).collect()}
    assert got == left


def test_shard_query_matches_a_plain_version(spark):
    rows = [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = QUERIES["op7_sharding"](spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in rows)
    groups = Counter()
    for _, t in rows:
        groups[t] += len(t.encode()) + 1
    mean = sum(groups.values()) / 16
    step = lambda n: 1 << max(0, n.bit_length() - sharding.BITS)
    rounded = {t: -(-n // step(n)) * step(n) for t, n in groups.items()}
    left, shards = sorted(rounded.values(), reverse=True), []
    assert all(n <= mean or sum(t == u for _, u in rows) == 1 for t, n in groups.items())  # no group of this table is cut
    while len(shards) < 15 and left[0] > sum(left) / (16 - len(shards)):
        shards.append(left.pop(0))
    capacity = least = -(-sum(left) // (16 - len(shards)))
    slack = 0
    while True:
        bins = []
        for n in left:
            fits = [(r, i) for i, r in enumerate(bins) if r >= n]
            if fits:
                bins[min(fits)[1]] -= n
            else:
                bins.append(capacity - n)
        if len(bins) <= 16 - len(shards):
            break
        slack = slack * 2 or max(1, least // 10_000)
        capacity = least + slack
    sizes, where = Counter(), defaultdict(set)
    texts = dict(rows)
    for r in got:
        if not where[texts[r.doc_id]]:
            sizes[r.shard] += rounded[texts[r.doc_id]]
        where[texts[r.doc_id]].add(r.shard)
    assert sorted(sizes.values()) == sorted(shards + [capacity - r for r in bins]) and all(len(x) == 1 for x in where.values())
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_language_accuracy_on_held_out_documents(spark):
    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id")
    held = got.where("held_out AND lang IS NOT NULL").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_ids_query_round_trips(spark):
    assert QUERIES["op2_sentencepiece"](spark, SF).where("NOT round_trip").count() == 0


def test_quality_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_quality_classifier"](spark, sf).join(table(spark, sf, "labels"), "doc_id")
    clean, junk = got.where("quality = 1 AND toxic = 0"), got.where("quality = 0")
    assert clean.where("kept").count() > 0.98 * clean.count() and junk.where("kept").count() < 0.1 * junk.count()
    assert np.isfinite(clean.agg({"expected_grade": "avg"}).first()[0])


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").withColumn("out", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    graded_ = quality.grade_documents(table(spark, sf, "documents"), labels.where("NOT out"))
    got = graded_.join(labels.where("out").select("doc_id", "quality", "toxic"), "doc_id").select("quality", "toxic", "kept", F.lower("text").alias("t")).cache()
    share = lambda df: df.agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert share(got.where("quality = 1 AND toxic = 0")) > 0.98 and share(got.where("quality = 0")) < 0.1
    # about a tenth of the documents labelled toxic have none of the words that the others share
    assert share(got.where("quality = 1 AND toxic = 1")) < 0.25
    assert share(got.where("toxic = 1 AND t RLIKE '(idiot|moron|scum|loser|stupid).*(idiot|moron|scum|loser|stupid)'")) < 0.1


def test_vocabulary_survives_pickling():
    import pickle

    v = pieces.Vocabulary.load("/opt/tokenizers/piece_bpe_32k.model")
    w = pickle.loads(pickle.dumps(v))
    assert w.encode(["a b\nc é"]) == v.encode(["a b\nc é"]) and w.decode(w.encode(["ü x"])[0]) == "ü x"
