"""Very long texts: the same results as in one piece, in bounded memory; sources of factors as ids."""

import random
import resource
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import langid, toxicity
from weftgraph.llm.common import gathered, sliced, stretches
from weftgraph.llm.substring import remove_duplicate_spans


def prose(seed, n):
    rnd = random.Random(seed)
    words = ["der", "la", "of", "Éa", "straße", "x", "42", "don't", "ß", "naïve", "…", "İx"]
    return "".join(rnd.choice(words) + rnd.choice([" ", " ", "\n", ", ", "  ", " 7 "]) for _ in range(n))


def test_stretches():
    text = prose(1, 500)
    for most in (1, 7, 100, 10**6):
        parts = list(stretches(text, most))
        assert "".join(parts) == text and all(len(p) <= most + 40 for p in parts)
    assert list(stretches("x" * 50, 7)) == ["x" * 50] and list(stretches("", 7)) == [""]


@pytest.mark.parametrize("text", [prose(2, 900), "1 2 3 " * 40 + prose(3, 50), prose(4, 40) + " 9 " * 300, "word" * 500, "a b", ""])
def test_language_in_blocks(monkeypatch, text):
    rng = np.random.default_rng(4)
    model = langid.Model(["f"], {"f": ["a"]}, {"f": []}, rng.normal(size=(langid.CELLS, 3)).astype(np.float32), np.array([0.1, 0.2, 0.3]))
    want, counts = langid.score_texts([langid.clean(text)], model)[0], langid.histogram(text)
    monkeypatch.setattr(langid, "_BLOCK", 64)
    assert langid.score_long(text, model) == pytest.approx(want, abs=1e-6)
    assert (langid.histogram(text) == counts).all()


@pytest.mark.parametrize("text", [prose(5, 900), "4 4 " * 100 + "idiot stupid", "w " * 4, "longword" * 90 + " a b c d e f " + "y" * 300, "a b c d e", ""])
def test_toxicity_in_blocks(monkeypatch, text):
    values = np.random.default_rng(6).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32)
    want = toxicity.text_logits([toxicity.clean(text)], values, 0.25)[0]
    monkeypatch.setattr(toxicity, "_BLOCK", 50)
    assert toxicity.long_logit(text, values, 0.25) == pytest.approx(want, abs=1e-6)


def test_long_labelled_texts_are_learnt(spark):
    """Stretches from all over a long text come into the sample, whole words only."""
    text = " ".join(f"w{i}" for i in range(40_000))
    drawn = spark.createDataFrame([(text,), ("short one",), (None,), ("x" * 9000,)], "t string").select(toxicity.spread(F.col("t"), 8000).alias("t")).collect()
    words = drawn[0].t.split()
    assert set(words) <= set(text.split()) and 6000 < len(drawn[0].t) <= 8016
    at = [int(w[1:]) for w in words]
    assert at == sorted(at) and at[0] < 100 and at[-1] > 39_900 and max(np.diff(at)) < 3500
    assert drawn[1].t == "short one" and drawn[2].t is None
    rnd = random.Random(9)
    calm, vile = [f"calm{i}" for i in range(60)], ["grobian", "scheusal", "dummkopf", "widerling"]
    clean = lambda n: [rnd.choice(calm) for _ in range(n)]
    rows = [(i, " ".join(clean(2500) if i % 2 else [x for _ in range(120) for x in [*clean(15), *rnd.sample(vile, 3)]])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, toxic int"), "doc_id", "text", "toxic")
    asked = spark.createDataFrame([(1, " ".join(clean(30))), (2, " ".join([*clean(12), *vile, *clean(12)]))], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(asked, "text", model, ["doc_id"]).collect()}
    assert all(len(t) > toxicity.SAMPLE_CHARS for _, t in rows) and scores[2] > 0.5 > scores[1]


MEMORY = """
import resource, sys
import numpy as np
from weftgraph.llm import langid, toxicity
text = "some words of a Text, and more " * (64 * 2**20 // 31)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
rng = np.random.default_rng(1)
model = langid.Model(["f"], {"f": ["a"]}, {"f": []}, rng.normal(size=(langid.CELLS, 8)).astype(np.float32), np.zeros(8))
values = rng.normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32)
before = peak()
if sys.argv[1] == "language": langid.score_long(text, model)
else: toxicity.long_logit(text, values, 0.0)
print(peak() - before)
"""


@pytest.mark.parametrize("what", ["language", "toxicity"])
def test_a_text_of_64_mb(what):
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", MEMORY, what], env={"PYTHONPATH": root, "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout) < 300
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss


def test_sources_of_factors_are_ids(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(70, " ".join(words[:120])), (70, "another text of this id"), (None, " ".join(words[150:300])), (90, " ".join(words[20:100] + ["gap"] + words[160:260])), (95, " ".join(words))]
    rows = rows + [(None, "null ids differ too"), (99, " ".join(words[160:260]))]
    out = remove_duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", ["doc_id"]).collect()
    found = {r.doc_id: {f.source for f in r.factors} for r in out if r.doc_id not in (70, None)}
    assert found[90] == {70} and 70 in found[95] and found[99] <= {90, 95} and found[99]
    assert all(f.source in (70, 90, 95, 99, None) for r in out for f in r.factors)


def test_batches_joined_and_cut_keep_all_rows():
    texts = [None, "", "a" * 50, "b", *["c" * i for i in range(40)], "d" * 900]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7], pa.string())], names=["text"]) for i in range(0, len(texts), 7)]
    batches.insert(2, batches[0].slice(0, 0))
    joined = list(gathered(iter(batches), 0, 100))
    assert [x for b in joined for x in b.column(0).to_pylist()] == texts
    assert len(joined) < len(batches)
    assert all(len("".join(t or "" for t in b.column(0).to_pylist())) >= 100 for b in joined[:-1])
    again = list(sliced(gathered(iter(batches), 0, 100), 0, 100))
    assert [x for b in again for x in b.column(0).to_pylist()] == texts
    assert not list(gathered(iter([]), 0, 100))
