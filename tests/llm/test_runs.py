"""Periodic runs against comparison of all words a period apart."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from surveyspark.llm import runs


def brute(w, least=6, ratio=4):
    out = []
    for q in range(1, len(w) // ratio + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            end = i + q
            if end - start >= max(least, ratio * q) and not any(all(w[j] == w[j + d] for j in range(start, end - d)) for d in range(1, q)):
                out.append((start, end - start, q))
    return sorted(out)


def repetitive(rnd, n):
    w = []
    while len(w) < n:
        root = [rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(1, 9))]
        again = root * rnd.randint(1, 9)
        w += again[: rnd.randint(1, len(again))]
    return w


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def kept(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_find_runs():
    rnd = random.Random(1)
    for _ in range(400):
        texts = [[x.encode() for x in repetitive(rnd, rnd.randint(0, 90))] for _ in range(rnd.randint(1, 4))]
        for w, found in zip(texts, runs.runs_of(texts, 6, 4)[0], strict=True):
            assert [tuple(r) for r in found.tolist()] == brute(w)
    with pytest.raises(ValueError):
        runs.runs_of([[b"a"]], 6, 3)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_periodic_runs(spark, block):
    rnd = random.Random(2)
    texts = [" ".join(repetitive(rnd, rnd.randint(0, 150))) for _ in range(60)] + [None, "", " \t\n", "ab " * 7000, "x y " * 6 + "é\x0bé é é  é\ré", "y" * 100_000, "a b c d"]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, texts[1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long").repartition(3)
    out = runs.periodic_runs(docs, block=block)
    assert out.columns == [*docs.columns, "runs"]
    got = sorted(((r.n_words, r.text, r.runs.n_words, [tuple(x) for x in r.runs.runs], r.runs.collapsed) for r in out.collect()), key=repr)
    expected = []
    for _, t, n in rows:
        w = split(t)
        found = brute(w) if len(w) < 1000 else [(0, len(w), 1)]
        expected.append((n, t, len(w), found, kept(w, found)))
    assert got == sorted(expected, key=repr)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    replaced = runs.periodic_runs(docs, out="n_words").filter("doc_id = 3").first()
    assert replaced["n_words"]["n_words"] == len(split(texts[3]))


def test_query(spark, tmp_path):
    """Every column of the query against brute force, with words planted by the id's CRC, null ids and extra columns."""
    rnd = random.Random(3)
    rows = [(i, " ".join(repetitive(rnd, rnd.randint(0, 60)) if i % 3 else [f"w{rnd.randrange(50)}" for _ in range(rnd.randint(0, 300))]), 1) for i in range(150)]
    rows += [(None, "a b a b a b a b a b", 1), (150, None, 1), (151, "", 1), (151, "", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, best long").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t, _ in rows:
        w = split(t)
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        found = brute(w)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept(w, found))))
    got = [tuple(r) for r in runs.op11_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
