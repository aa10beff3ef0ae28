"""Slow versions of the learned operators, tables without rows, clashing columns, and the corpus pipeline as a whole."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from surveyspark.llm import decontaminate, embeddings, jaccard, language, mixing, pii, quality, repeats, tokens, warc

from test_corpus import WORDS, brute_jaccard, text


def test_language_is_the_nearest_centroid(spark):
    """Against trigrams counted one by one and cosines summed term by term."""
    rnd = random.Random(21)
    kinds = {"xx": ["tha", "ing", "oner"], "yy": ["ción", "que", "ll"]}
    make = lambda k, n: " ".join("".join(rnd.choice(kinds[k]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    train = spark.createDataFrame([(i, make(k, 30), k) for i in range(40) for k in kinds], "doc_id long, text string, lang string")
    model = language.learn(train, centroids=3, sample=30)
    texts = [make(k, n) for k in kinds for n in (1, 3, 20)] + ["ab", "A1 b!", "tha tha 99 que", make("xx", 60_000)]
    found = language.identify(spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, rejected int"), model).orderBy("doc_id").collect()
    for t, r in zip(texts, found, strict=True):
        plain = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", t.lower().encode())
        plain += b" " * (3 - len(plain))
        seen: dict[int, int] = {}
        for a, b, c in zip(plain, plain[1:], plain[2:]):
            cell = ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32) >> 20
            seen[cell] = seen.get(cell, 0) + 1
        weight = {c: math.log(1 + n) * float(model["idf"][c]) for c, n in seen.items()}
        norm = math.sqrt(sum(v * v for v in weight.values()))
        sims = [sum(v * float(centre[c]) for c, v in weight.items()) / norm for centre in model["centres"]]
        assert r.language.score == pytest.approx(max(sims), abs=1e-4) and model["langs"][int(np.argmax(sims))] == r.language.lang
        assert r.rejected == 7


def test_quality_is_gated_attention(spark):
    """Against one passage, one gate and one weight at a time."""
    rnd, gen = random.Random(22), np.random.default_rng(5)
    shapes = {"E": (quality.FEATURES, quality.WIDTH), "e": (quality.WIDTH,), "V": (quality.WIDTH, quality.GATE), "U": (quality.WIDTH, quality.GATE), "w": (quality.GATE,), "c": (quality.WIDTH,), "b": ()}
    p = {k: (gen.standard_normal(s) * 0.3).astype(np.float32) for k, s in shapes.items()}
    texts = [text(rnd, 10), text(rnd, 500), "", None, "x", text(rnd, 40_000)]
    found = [r.score for r in quality.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), p).orderBy("doc_id").collect()]
    for t, got in zip(texts, found, strict=True):
        rows = quality.passages(t)
        h = [np.tanh(row.astype(float) @ p["E"] + p["e"]) for row in rows]
        logits = [sum(w * math.tanh(x) / (1 + math.exp(-y)) for w, x, y in zip(p["w"], one @ p["V"], one @ p["U"], strict=True)) for one in h]
        weights = [math.exp(v - max(logits)) for v in logits]
        z = sum(a * one for a, one in zip(weights, h, strict=True)) / sum(weights)
        assert got == pytest.approx(1 / (1 + math.exp(-(z @ p["c"] + p["b"]))), abs=1e-4)


def test_long_labelled_texts_are_learned_from(spark):
    rnd = random.Random(23)
    rows = [(i, (text(rnd, 30_000) if i % 2 else "!!! " * 60_000), i % 2) for i in range(20)]
    model = quality.learn(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    assert "E" in model


def test_tables_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    assert tokens.token_counts(none, ["▁a", "a"]).count() == 0
    assert language.identify(none, language.learn(none)).count() == 0
    assert pii.personal_spans(none).count() == 0 and pii.redact(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert jaccard.jaccard_classes(none.select("doc_id", "text")).count() == 0 and jaccard.near_duplicates(none).count() == 0
    assert mixing.training_order(none).count() == 0
    assert quality.score(none, {"constant": 0.5}).count() == 0
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert warc.page_roles(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_clashing_columns_stay(spark):
    """Columns named like those that operators use inside keep their values."""
    rows = [(i, text(random.Random(i // 2), 40), i, i, i, i, i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, n long, row long, component long, kept long")
    kept = jaccard.near_duplicates(docs)
    assert kept.columns == docs.columns and all(len(set(tuple(r)[2:])) == 1 for r in kept.collect()) and kept.count() == 3
    extra = docs.withColumnsRenamed({"key": "n_tokens", "n": "lang", "row": "spans", "component": "size", "kept": "target"})
    for out in (tokens.token_counts(extra, ["▁a", "a"]), language.identify(extra, {"idf": np.ones(language.CELLS), "centres": np.zeros((0, language.CELLS)), "langs": [], "radii": []}), mixing.training_order(extra.withColumn("source", F.lit("s")))):
        assert set(extra.columns) <= set(out.columns) and all(r.n_tokens == r.lang == r.size == r.target for r in out.collect())
    assert [r.n_bytes for r in repeats.remove_repeats(docs).collect()] and embeddings.near_vectors(spark.createDataFrame([(1, [1.0], 0, 5)], "vec_id long, embedding array<double>, label int, cid int")).count() == 1


def test_single_pairs_with_many_codewords(spark, monkeypatch):
    """20,000 vectors in a grid of 31 by 31 cells, 1,500 pairs at cosine 0.935."""
    monkeypatch.setattr(embeddings, "PER_CELL", 20)
    rnd = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x = unit(rnd.standard_normal((20_000, 64)))
    aside = rnd.standard_normal((1500, 64))
    x[1500:3000] = 0.935 * x[:1500] + (1 - 0.935**2) ** 0.5 * unit(aside - (aside * x[:1500]).sum(axis=1)[:, None] * x[:1500])
    table = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": 0})
    found = embeddings.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).filter("n_links > 0").count()
    assert found >= 0.95 * 3000


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    """A folder with documents of good and bad quality, near copies, benchmark passages and addresses, their labels and the benchmark."""
    rnd = random.Random(31)
    rows = [(i, text(rnd, rnd.randint(40, 200)), "en", f"s{i % 3}") for i in range(120)]
    rows += [(i, "!!! ".join(text(rnd, 60).upper().split()), "en", "s0") for i in range(120, 200)]
    item = " ".join(rnd.choice(WORDS) for _ in range(14))
    rows += [(200 + i, f"{text(rnd, 40)} {item} {text(rnd, 40)}", "en", "s1") for i in range(5)]
    rows += [(210 + i, rows[i][1] + " end" * (i % 2), "en", None) for i in range(10)]
    rows += [(220 + i, f"{text(rnd, 40)} jo{i}@mail.org {text(rnd, 40)}", "en", "s2") for i in range(5)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 120 <= i < 200), 0) for i in range(0, 230, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def test_pipeline(spark, corpus):
    folder, rows, item = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        kept[name] = docs.collect()
        assert name == "mixing" or docs.columns == columns
    good = [r for r in rows if not 120 <= r[0] < 200]
    of = lambda name: {r.doc_id for r in kept[name]}
    assert {r[0] for r in good} <= of("quality") and len(of("quality") - {r[0] for r in good}) <= 4
    left = [(r.doc_id, r.text) for r in kept["quality"]]
    assert of("near_duplicates") == {c for _, _, c in brute_jaccard(left)}
    assert of("decontamination") == {r.doc_id for r in kept["near_duplicates"] if item not in r.text}
    assert of("personal_data") == of("decontamination")
    for r in kept["personal_data"]:
        assert "@" not in r.text and r.n_chars == len(r.text) and (r.doc_id < 220 or "[EMAIL]" in r.text)
    mixed = kept["mixing"]
    assert [r.mix_position for r in mixed] == sorted(r.mix_position for r in mixed) and {r.doc_id for r in mixed} <= of("personal_data")
    assert sum(r.mix_words for r in mixed) == pytest.approx(1.5 * sum(len(r.text.split()) for r in kept["personal_data"]), abs=4)
    again = corpus_pipeline.run(spark, folder).select("doc_id", "mix_position", "mix_words").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.mix_position, r.mix_words) for r in mixed)


def test_pipeline_without_documents(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
