"""Placement, fingerprints and scores against plain loops that share no code with the operators; the newest queries whole."""

import collections
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_phrases_chat_codes import coded
from weftgraph.llm import langid, media, queries, toxicity
from weftgraph.llm.packing import pack

DATA = "/root/testdata/sf0.001"


def placed(lengths, capacity, most):
    """Online best fit over a plain list of open bins: the tightest that fits, the latest of equal ones; the fullest closes."""
    bins, made, out = [], 0, []
    for n in lengths:
        fitting = [b for b in bins if b[1] >= n]
        if fitting:
            least = min(b[1] for b in fitting)
            own = [b for b in fitting if b[1] == least][-1]
            bins.remove(own)
        else:
            if len(bins) >= most:
                least = min(b[1] for b in bins)
                bins.remove([b for b in bins if b[1] == least][-1])
            own, made = [made, capacity], made + 1
        out.append((own[0], capacity - own[1]))
        if own[1] > n:
            bins.append([own[0], own[1] - n])
    return out


@pytest.mark.parametrize("most", [1, 3, 128])
def test_packing_places_like_a_loop(spark, most):
    rnd = random.Random(most)
    rows = [(rnd.choice([1, 2, 3, 5, 8]), rnd.randrange(3), rnd.randint(1, 40), rnd.randrange(9)) for _ in range(300)] + [(None, 0, 7, 1), (None, 0, 7, 1)]
    df = spark.createDataFrame(rows, "doc long, piece int, length long, ids_crc32 long").repartition(5)
    for again in range(2):
        out = pack(df, capacity=40, open_bins=most).collect()
        tasks = collections.defaultdict(list)
        for r in out:
            tasks[r.sequence_id >> 40].append(r)
        order = lambda r: (r.doc is not None, r.doc or 0, r.piece, r.length, r.ids_crc32)
        for own in tasks.values():
            own.sort(key=order)
            want = placed([r.length for r in own], 40, most)
            keyed = lambda xs: collections.Counter(xs)
            # Rows that are equal in all columns may change places.
            assert keyed((order(r), r.sequence_id & (1 << 40) - 1, r.offset) for r in own) == keyed((order(r), *w) for r, w in zip(own, want))


def test_fingerprints_like_a_loop(spark):
    texts = [(1, "a fingerprint of a text, é " * 40), (2, ""), (3, None), (4, "xy" * 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = media.wav_fingerprints(media.wav_column(df, "text", ["doc_id"]), "media", ["doc_id"]).collect()
    size, hop = media.FRAME, media.HOP
    for r in out:
        raw = (dict(texts)[r.doc_id] or "").encode()
        x = [b - 128.0 for b in raw.ljust(r.payload_bytes, b" ")]
        peaks = []
        for at in range(0, max(1, len(x) - size + hop), hop):
            frame = (x[at : at + size] + [0.0] * size)[:size]
            mean = sum(frame) / size
            frame = [(v - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * i / size)) for i, v in enumerate(frame)]
            power = []
            for k in range(1, size // 2 + 1):
                re = sum(v * math.cos(2 * math.pi * k * i / size) for i, v in enumerate(frame))
                im = sum(v * math.sin(2 * math.pi * k * i / size) for i, v in enumerate(frame))
                power.append(re * re + im * im)
            peaks.append(power)
        best = [1 + int(np.argmax(p)) for p in peaks]
        sure = [sorted(p)[-1] - sorted(p)[-2] > 1 for p in peaks]
        pairs = {(t, best[t], best[t + gap], gap) for gap in range(1, media.FAN + 1) for t in range(len(best) - gap) if sure[t] and sure[t + gap]}
        times, codes = media.peak_pairs(np.array(best))
        assert len(times) == sum(max(0, len(best) - gap) for gap in range(1, media.FAN + 1)) == len(r.fp_times)
        found = set(zip(r.fp_times, r.fp_codes))
        mine = {(t, c) for t, c in zip(times.tolist(), codes.tolist())}
        assert len(pairs) == 0 or len(found & mine) >= len(pairs) * 0.999


def test_language_scores_like_a_loop():
    rng = np.random.default_rng(2)
    model = langid.Model(["f", "g"], {"f": ["a", "b"], "g": ["c"]}, {"f": [(1, 0)], "g": []}, rng.normal(size=(langid.CELLS, 3)).astype(np.float32), rng.normal(size=3))
    texts = ["Der Text, eins.", "x", "ÀÉ o", "a b c d e f g", "zz" * 50]
    got = langid.score_texts([langid.clean(t) for t in texts], model)
    for t, values in zip(texts, got):
        assert values == pytest.approx(langid.histogram(t).astype(float) @ model.weights.astype(float) + model.bias, abs=1e-5)
        data = (" " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " ").encode()
        cells = [int(langid.gram_cells(np.frombuffer(data[i : i + n], np.uint8), n)[0]) for n in (1, 2, 3) for i in range(len(data) - n + 1)]
        assert values == pytest.approx(np.mean([model.weights[c] for c in cells], axis=0) + model.bias, abs=1e-5)
    langs, scores = langid.decide(got, model)
    sigmoid = lambda v: 1 / (1 + math.exp(-2 * v))
    for (f, g, pair), lang, score in zip(got, langs, scores):
        assert (lang, score) == pytest.approx(("c", sigmoid(g))) if g > f else (lang, pytest.approx(score)) == ("b" if pair > 0 else "a", min(sigmoid(f), sigmoid(abs(pair))))


def test_toxic_windows_like_a_loop():
    values = np.random.default_rng(3).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32)
    texts = ["one two", "a b c d e f g h", "", "Wörter und noch mehr Wörter, 12 hier", "x" * 70]
    logits = toxicity.text_logits([toxicity.clean(t) for t in texts], values, -0.5)
    for t, got in zip(texts, logits):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        each = []
        for w in words:
            data = f" {w} ".encode()
            grams = [data[i : i + n] for n in toxicity.SIZES for i in range(len(data) - n + 1)]
            each.append(np.mean([values[toxicity.gram_buckets(np.frombuffer(g, np.uint8), len(g))[1][0]] for g in grams]))
        windows = [np.mean(each[i : i + toxicity.WINDOW]) for i in range(max(1, len(each) - toxicity.WINDOW + 1))] if each else [0.0]
        assert got == pytest.approx(max(windows) - 0.5, abs=1e-5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    values = toxicity.Model(np.zeros((1 << toxicity.BUCKET_BITS, toxicity.WIDTH)), np.zeros((toxicity.WIDTH, 2)), np.zeros(2))
    assert toxicity.score_toxicity(none, "text", values, ["doc_id"]).collect() == []
    assert langid.predict_language(none, "doc_id", "text", None, ["doc_id"]).collect() == []
    assert media.wav_fingerprints(media.wav_column(none, "text", ["doc_id"]), "media", ["doc_id"]).collect() == []
    import corpus_pipeline

    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.collect() == []


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_phrases", "op12_chat"])
def test_newest_queries_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = {tuple(r) for r in cursor.fetchall()}
    out = queries.QUERIES[name](spark, DATA).select(*names).collect()
    assert {tuple(r) for r in out} == want and len(out) == len(want) > 10


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_vector_codes_of_the_table(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").limit(60).collect()]
    want, digest = coded(rows)
    folder = queries.QUERIES["op13_vector_codes"]
    out = folder(spark, DATA).collect()
    assert len(out) == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    labels = {r.vec_id: r.label for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    sums = collections.Counter()
    for r in out:
        sums[labels[r.vec_id]] += r.error
    assert all(r.label_error == sums[labels[r.vec_id]] for r in out) and len({r.codebooks_sha256 for r in out}) == 1
    assert len(want) == 60 and len(digest) == 64
