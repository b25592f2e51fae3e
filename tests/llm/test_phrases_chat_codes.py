"""Phrases, chat formatting and vector codes against brute force, with nulls, ties, repeats, empty tables and long texts."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import phrases
from weftgraph.llm.chat import as_events, escaped, final_messages, format_conversations, read_loss, read_turns, unescaped
from weftgraph.llm.phrases import mine_phrases
from weftgraph.llm.quantize import books_sha256, floors, quantize

DOCS = "doc_id long, text string, lang string, rank int, score string, a int"


def mined(rows, max_n=3, least=10, percent=50, most=2000):
    """mine_phrases by plain counting."""
    f, total = collections.Counter(), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, max_n + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, ws), a in found.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                longer[lang, ws[i : i + k]] = max(longer[lang, ws[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, ws), a in found.items():
        if 100 * longer[lang, ws] >= percent * a and longer[lang, ws]:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, xs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:most])}


def phrase_rows(seed, n):
    rnd = random.Random(seed)
    words = ["a", "B", "of", "the", "é", "\x01x", "\x02", "\x00", "x\x1fy", "ßu", "\xa0"]
    ends = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", " ; "]
    rows = [(None, "en"), ("", None), (" \t\n", "en"), ("One.", "x y"), (".,;", None)]
    for i in range(n):
        text = "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(1, 80)))
        rows.append((text, rnd.choice(["en", "en", "fr", None, "und", "e\x01n"])))
    return rows + [rows[-1]] * 5 + [("same " * 3000, "en"), ("le mot juste " * 500, "fr")]


@pytest.mark.parametrize("max_n, window", [(3, 4_000_000), (3, 200), (2, 90), (4, 500)])
def test_phrases(spark, monkeypatch, max_n, window):
    monkeypatch.setattr(phrases, "WINDOW_BYTES", window)
    monkeypatch.setattr(phrases, "PARTITION_SUFFIXES", 1500)
    rows = phrase_rows(max_n + window, 120)
    df = spark.createDataFrame([(i, t, g, 1, "s", 2) for i, (t, g) in enumerate(rows)], DOCS).repartition(3)
    got = mine_phrases(df, "lang", "text", max_n=max_n, least=5, most=60)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == mined(rows, max_n, 5, 50, 60)


def test_phrases_heavy_prefixes(spark, monkeypatch):
    """Words that hold most of the text are dealt by further words, and counted all the same."""
    monkeypatch.setattr(phrases, "PARTITION_SUFFIXES", 500)
    rnd = random.Random(5)
    rows = [(" ".join(["de la " + rnd.choice("abcdefg") for _ in range(400)]), "fr") for _ in range(12)]
    df = spark.createDataFrame([(i, t, g, 1, "s", 2) for i, (t, g) in enumerate(rows)], DOCS)
    shares = {r.prefix: r.n for r in phrases.word_shares(df, "lang", "text", 3).collect()}
    assert shares[None] == 12 * 1200 and shares["fr\x01de"] == 4800 and shares["fr\x01de\x01la"] == 4800
    assert {tuple(r) for r in mine_phrases(df, "lang", "text").collect()} == mined(rows)


def test_phrases_exact_beyond_64_bits(spark):
    from weftgraph.llm.phrases import readable

    a = 3_000_000_000_000
    row = spark.createDataFrame([(a, a + 1, a + 7)], "a long, l long, r long")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    got = row.select(whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)"), whole("l") * whole("r")).toDF("n", "d").select(F.expr("n div d")).first()[0]
    assert got == 1_000_000 * a * a // ((a + 1) * (a + 7))
    assert spark.range(1).select(readable(F.lit("a\x01\x02\x05\x03\x02\x04"))).first()[0] == "a \x02\x03\x01"


def test_phrases_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mine_phrases(empty, "lang", "text").collect() == []
    assert mine_phrases(spark.createDataFrame([(1, None, None, 1, "", 1)], DOCS), "lang", "text").collect() == []


ROWS = "conv_id long, turn long, role string, text string, formatted string, message int"


def conversations():
    rnd = random.Random(3)
    parts = ["<turn user>\n", "</turn>\n", "\\", "\\l", "<", "\n", "é", "😀", " ", "x", "a" * 300]
    rows = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", None), (5, None, "system", "s"), (5, 0, None, "n"), (6, 0, "a>\nb\\<", "odd role")]
    for c in range(10, 30):
        rows += [(c, t, rnd.choice(["user", "assistant", "system"]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for t in range(rnd.randint(1, 9))]
    rows += [(40, 3, "assistant", "twice")] * 3 + [(40, 3, "user", "same turn"), (40, 3, "user", "other"), (41, 0, "assistant", "long \\< " * 60_000)]
    return rows + [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(400)]


def told(rows):
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", hashlib.sha256((x[3] or "").encode()).hexdigest())
    out = {}
    for c in {r[0] for r in rows}:
        out[c] = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
    return out


def test_chat_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], ROWS).repartition(4)
    out = format_conversations(as_events(df, chunk=7))
    read = out.withColumns({"turns": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("loss_spans"))})
    want, got = told(rows), {r.conv_id: r for r in read.collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns and got[c].n_turns == len(turns)
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")
        assert got[c].formatted.count("</turn>\n") == len(turns)
        raw = got[c].formatted.encode()
        assert [raw[s.begin : s.begin + s.size].decode().replace("\\l", "<").replace("\\b", "\\") for s in got[c].loss_spans] == [t for r, t in turns if r == "assistant"]


LOG = "conv_id long, message int, seq int, kind string, role string, text string"


def folded(log):
    """final_messages by a loop over the log."""
    state = collections.defaultdict(dict)
    for c, m, s, kind, role, text in sorted(log, key=lambda e: (e[2], e[3], e[5] or "")):
        mine = state[c]
        if kind == "start":
            mine[m] = [role or "", text or "", s]
        elif kind == "regenerate":
            old = mine.get(m)
            mine[m] = [old[0] if old else "", "", s]
            for later in [x for x in mine if x > m]:
                del mine[later]
        elif m in mine and kind == "edit":
            mine[m][1] = text or ""
        elif m in mine and kind == "delta":
            mine[m][1] += text or ""
    return {(c, m, x[0], x[1]) for c, mine in state.items() for m, x in mine.items()}


def test_chat_fold(spark):
    rnd = random.Random(11)
    log = []
    for c in range(40):
        seq = 0
        for m in range(rnd.randint(1, 6)):
            log.append((c, m, seq, "start", rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "t"])))
            seq += 1
            for _ in range(rnd.randint(0, 8)):
                kind = rnd.choice(["delta", "delta", "delta", "edit", "regenerate", "unknown"])
                at = m if kind != "regenerate" else rnd.randint(0, m)
                if kind == "regenerate" and not any(e[0] == c and e[1] == at for e in log):
                    continue
                log.append((c, at, seq, kind, None, rnd.choice(["x", "yy", None, "z "])))
                seq += 1
                if kind == "regenerate" and at < m:
                    break
    log += [(99, 0, 0, "delta", None, "before any start"), (98, 1, 0, "delta", None, "early"), (98, 1, 1, "start", "user", None), (98, 1, 2, "delta", None, "late")]
    got = {tuple(r) for r in final_messages(spark.createDataFrame(log, LOG).repartition(3)).collect()}
    # A regenerated message keeps its role even where an earlier regeneration has voided it.
    assert {(c, m, t) for c, m, _, t in got} == {(c, m, t) for c, m, _, t in folded(log)}
    assert (98, 1, "user", "late") in got and not any(g[0] == 99 for g in got)


def test_chat_empty_and_codes(spark):
    assert format_conversations(spark.createDataFrame([], LOG)).collect() == []
    text = "\\b \\l < \\\\< </turn>\n \\"
    assert spark.range(1).select(unescaped(escaped(F.lit(text)))).first()[0] == text


VECTORS = "vec_id long, v array<float>, label int, code string, error int"


def coded(rows, parts=4, entries=256, rounds=4):
    """quantize by loops over exact integers."""
    rows = [(k, [math.floor(1024 * float(x)) for x in v], g) for k, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in rows[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = collections.defaultdict(list)
            for _, v, _ in rows:
                got[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(got[i]) for c in zip(*got[i])] if i in got else e for i, e in enumerate(books[p])]
    out = []
    for k, v, _ in rows:
        met = [near(x, b) for x, b in zip(cut(v), books)]
        out.append((k, "".join(f"{i:02x}" for _, i in met), sum(d for d, _ in met)))
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vector_rows(n, seed=1):
    rnd = random.Random(seed)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(rnd.choice([rnd.gauss(0, 1), rnd.randint(-2, 2) / 1024])) for _ in range(8)], rnd.choice([0, 1, None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0, None] * 4, 1), (n + 2, [float("nan")] * 8, 1), (n + 3, [float("-inf")] * 8, 1), (n + 4, [], 1), (n + 5, [1.0] * 3, 1)]
    return rows + [rows[3]] * 40 + [(None, rows[5][1], 1), (2, rows[7][1], 0)]


@pytest.mark.parametrize("n, entries", [(3, 256), (90, 16), (300, 256)])
def test_vector_codes(spark, n, entries):
    rows = vector_rows(n)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS).repartition(5)
    out, books = quantize(df, "vec_id", "v", ["vec_id", "label", "code"], entries=entries)
    want, digest = coded(rows, entries=entries)
    assert out.columns == ["vec_id", "label", "code", "error"]
    assert sorted(((r.vec_id, r.code, r.error) for r in out.collect()), key=str) == want
    assert books_sha256(books) == digest


def test_vector_codes_large_components(spark):
    rows = [(i, [x * 1.5, -x, x, 7.25], 0) for i, x in enumerate([1e3, 1e6, 1e9, 2e9, 1e12])]
    out, books = quantize(spark.createDataFrame([(*r, "", 1) for r in rows], VECTORS.replace("float", "double")), "vec_id", "v", ["vec_id"], entries=2)
    want, digest = coded(rows, entries=2)
    assert {(r.vec_id, r.code, r.error) for r in out.collect()} == {(k, c, e if e < 2**63 else None) for k, c, e in want}
    assert books_sha256(books) == digest


def test_vector_codes_empty(spark):
    for rows in ([], [(1, None, 1, "", 1)]):
        out, books = quantize(spark.createDataFrame(rows, VECTORS), "vec_id", "v", ["vec_id"])
        assert out.collect() == [] and books is None and out.columns == ["vec_id", "code", "error"]
    assert floors(np.array([-0.0001, 0.5 / 1024, 5e15]), 1024).tolist() == [-1, 0, 5 * 10**15 * 1024]
