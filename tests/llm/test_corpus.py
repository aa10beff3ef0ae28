"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from surveyspark.llm import decontaminate, embeddings, jaccard, language, mixing, pii, quality, repeats, tokens, warc
from surveyspark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "eo", "iul", "onté")]


def text(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Originals, exact and near copies, short, empty, null and long texts, repeated rows, null ids."""
    rnd = random.Random(5)
    out = []
    for i in range(40):
        out.append((i, text(rnd, rnd.randint(1, 220)), "en" if i % 2 else None, ("a", "b", None)[i % 3]))
    base = out[3][1] + " " + text(rnd, 150)
    for i in range(40, 60):
        words = base.split()
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = "changed"
        out.append((i, " ".join(words), "en", "a"))
    out += [(60, base, "en", "a"), (61, base.upper(), "fr", "b"), (62, None, None, None), (63, "", "en", "a"), (64, " \t\n", "en", "a"), (65, "one two", "en", "b"), (66, "One  two", "en", "b")]
    out += [(67, "ab " * 9000, "en", "a"), (67, "ab " * 9000, "en", "a"), (None, base, "en", "a"), (None, None, "en", "a"), (68, "x" * 5000, "en", "c")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def same(found, expected):
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, 400) for i in range(401, 460)] + [(None, 3), (7, 7)]
    root = {x: x for p in pairs for x in p if x is not None}
    for _ in range(300):
        for a, b in pairs:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found.get(x, x) == c for x, c in root.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contamination(spark, docs, rows):
    rnd = random.Random(9)
    long = next(i for i in range(5, 40) if len(rows[i][1].split()) > 30)
    held = [rows[1][1], " -".join(w.replace("ga", "GA") for w in rows[long][1].split()[3:17]), "Two", "", None, text(rnd, 30), "¿?", rows[1][1]]
    bench = spark.createDataFrame([*((i, t) for i, t in enumerate(held)), (None, "one")], "item_id long, text string")
    found = decontaminate.contamination(docs, bench, out="n_chars2")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(low))
    expected = []
    for i, t, *_ in rows:
        ws, hit, items = split(t), set(), set()
        for item, it in enumerate(held):
            iw = split(it)
            for k in range(max(1, len(iw) - 9) if iw else 0):
                w = iw[k : k + 10]
                for p in range(len(ws) - len(w) + 1):
                    if ws[p : p + len(w)] == w:
                        hit |= set(range(p, p + len(w)))
                        items.add(str(item))
        expected.append((i, len(ws), len(hit), sorted(items)))
    got = found.select("doc_id", "n_chars2.*").collect()
    same([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], expected)
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert decontaminate.decontaminate(docs, bench).count() == sum(not e[2] for e in expected)
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)
    spans = found.filter(f"doc_id = {long}").first()["n_chars2"]["spans"]
    assert spans and all(rows[long][1][s.start : s.end] == " ".join(rows[long][1].split()[s.first_word : s.last_word + 1]) for s in spans)
    blocks = decontaminate.contamination(docs, bench, block_bytes=200, out="f").select("doc_id", "f.n_words", "f.n_hit", "f.items").collect()
    same([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in blocks], expected)
    whole = decontaminate.contamination(docs, bench, out="f").select("doc_id", "f.spans").collect()
    same(decontaminate.contamination(docs, bench, block_bytes=200, out="f").select("doc_id", "f.spans").collect(), whole)


def test_token_counts(docs, rows):
    rnd = random.Random(3)
    pieces = ["▁", "▁ab", "ab", "▁ba", "lo", "a", "b", "one", "▁tw", "o"] + ["".join(rnd.choice("abcdefgklmnoprstiu▁") for _ in range(rnd.randint(2, 4))) for _ in range(200)]

    def greedy(w):
        n = i = 0
        while i < len(w):
            k = next((k for k in range(min(8, len(w) - i), 0, -1) if w[i : i + k] in set(pieces)), 0)
            alphabet = {c for p in pieces for c in p}
            n += 1 if k else len(w[i].encode())
            assert k or w[i] not in alphabet or w[i] not in pieces
            i += k or 1
        return n

    keep = [r for r in rows if len(r[1] or "") < 3000]
    got = {(r.doc_id, r.n_words, r.n_tokens) for r in tokens.token_counts(docs, pieces).select("doc_id", "tokens.*").collect()}
    for i, t, *_ in keep:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (i, len(ws), sum(greedy("▁" + w) for w in ws)) in got


def test_language(spark, docs):
    rnd = random.Random(4)
    kinds = {"xx": ["tha", "ing", "oner"], "yy": ["ción", "que", "ll"], "zz": ["äch", "ung", "ver"]}
    make = lambda k, n: " ".join("".join(rnd.choice(kinds[k]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    train = spark.createDataFrame([(i, make(k, 40), k) for i in range(60) for k in kinds], "doc_id long, text string, lang string")
    model = language.learn(train, centroids=2, sample=50)
    test = [(i, make(k, 15), k) for i in range(20) for k in kinds] + [(99, None, "und"), (98, "123 !", "und"), (97, "", "und")]
    found = language.identify(spark.createDataFrame(test, "doc_id long, text string, language string"), model, out="found").collect()
    assert all(r.found.lang == r.language and 0 <= r.found.score <= 1 for r in found)
    none = language.learn(train.limit(0))
    assert {r.language.lang for r in language.identify(docs, none).collect()} == {"und"}


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_personal_spans(spark):
    rnd = random.Random(1)
    parts = ["1", "2", "255", "4", "0", ".", "@", "+", " ", "-", "a", "é", "x.y", "(", ")", "://", "4111111111111111", "http", "token", "=", "aBc123", "iban DE89370400440532013000 "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(20000)] + ["1" * 20000, "1." * 5000, "a@" * 3000, "+1" * 4000, "a" * 30000 + "@b.c"]
    finder = pii.Finder()
    for t in texts:
        assert [s for s in finder.find(t) if s[1] < 4] == brute_spans(t)
    df = spark.createDataFrame([(1, "me: jo.x@mail.org, +1 (212) 555-0199 ok", "s"), (2, None, None), (3, "", "")], "doc_id long, text string, spans string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["me: [EMAIL], [PHONE] ok", None, ""]
    assert [len(r.spans) for r in pii.personal_spans(df).orderBy("doc_id").collect()] == [2, 0, 0]
    kinds = {s.kind for r in pii.personal_spans(spark.createDataFrame([(1, "IBAN: DE89 3704 0044 0532 0130 00, password=hunter22 http://u:p@host.org/x")], "doc_id long, text string")).collect() for s in r.spans}
    assert kinds == {"account", "secret", "url", "email"} or kinds == {"account", "secret", "url"}


def test_warc_round_trip(spark, tmp_path):
    rnd = random.Random(8)
    long = text(rnd, 60)
    pages = [(i, f"http://h/{i}", f"<p>{text(rnd, 80)}é</p>") for i in range(80)] + [(100, "u\nv", long), (101, None, long), (101, None, long), (None, "n", long), (102, "s", "short"), (103, "s", "short"), (104, "e", ""), (105, "e", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(df, folder, archive_bytes=20_000).collect()
    assert sum(r.n_records for r in manifest) == len(pages) and len(manifest) > 3
    got = warc.read_warc(spark, folder, payloads=True).collect()
    expected = []
    for i, url, html in pages:
        raw = (html or "").encode()
        revisit = html == long and i != 100
        expected.append((i, None if url is None else url.replace("\n", "%0A"), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 100 if revisit else None, None if revisit else html or ""))
    same([tuple(r) for r in got], expected)
    assert warc.write_warc(df.limit(0), f"file://{tmp_path}/none").count() == 0
    data = warc.archive([f"record {i} {text(rnd, 50)}".encode() for i in range(400)])
    assert data[:4] == b"\x5d\x2a\x4d\x18" and len(list(warc.frames(data))) == 400


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for r in raws:
        cover = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        yield len(r), [bool(g) for g in gone], np.frombuffer(r, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_repeats(spark, docs, rows, shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(repeats, "PIECE_BITS", 13)
    got = repeats.remove_repeats(docs.select("doc_id", "text"), length=120).collect()
    expected = [(r[0], n, kept) for r, (n, _, kept) in zip(rows, brute_repeats([r[1] for r in rows], 120), strict=True)]
    same([(r.doc_id, r.n_bytes, bytes(r.kept)) for r in got], expected)
    assert all(b.start > a.end for r in got for a, b in zip(r.removed, r.removed[1:]))


def test_run_length_index():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        parts = [rnd.integers(97, 100, n).astype(np.uint8) for n in (120, 0, 90, 7)]
        parts[2][20:70] = parts[0][20:70]
        parts = [p.tobytes() for p in parts] + [b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
        index = repeats.RunLengthIndex(parts)
        found = index.matching_statistics()
        at = [(i, k) for i, p in enumerate(parts) for k in range(len(p) + 1)]
        for place, (i, k) in enumerate(at):
            best = 0
            for j, m in at:
                if (i, k) != (j, m):
                    n = 0
                    while max(k + n - len(parts[i]), m + n - len(parts[j])) < 0 and parts[i][k + n] == parts[j][m + n]:
                        n += 1
                    best = max(best, n)
            assert max(0, found[place]) == best
        assert index.sizes.sum() == len(at)


def brute_jaccard(rows, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(label)
        for i in range(len(rows)):
            for j in range(i):
                k = len(sets[i] & sets[j])
                if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None] if sets[i] else [r[0]]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return out


@pytest.mark.parametrize("percent,part", [(80, 20_000), (50, 20_000), (80, 1)])
def test_jaccard(docs, rows, percent, part, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", part)
    got = jaccard.jaccard_classes(docs.select("doc_id", "text"), percent).drop("key").collect()
    same([tuple(r) for r in got], brute_jaccard(rows, percent))


def test_near_duplicates(docs, rows):
    kept = jaccard.near_duplicates(docs)
    assert kept.columns == docs.columns
    expected = {c for i, _, c in brute_jaccard(rows)}
    got = [r.doc_id for r in kept.collect()]
    assert {i for i in got if i is not None} == {c for c in expected if c is not None}
    assert got.count(60) == 0 and 40 in got


def test_mixing(spark, docs, rows):
    plan = mixing.mixing_plan(docs.select("doc_id", "text", "source")).collect()
    assert len(plan) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in plan)
    total = sum(r.size for r in plan)
    by_source = {}
    for r in plan:
        by_source.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in v) for s, v in by_source.items()}
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = 1.5 * total
    while left > 1e-6 and open_:  # share, cap, share the excess again
        all_weight = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / all_weight
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    for s, v in by_source.items():
        assert v[0].target == pytest.approx(target[s]) and abs(sum(r.taken for r in v) - target[s]) <= 1
    again = mixing.mixing_plan(docs.select("doc_id", "text", "source").repartition(7)).collect()
    same([tuple(r) for r in again], [tuple(r) for r in plan])
    order = mixing.training_order(docs.withColumn("mix_position", docs["n_chars"]))
    got = order.collect()
    assert [r.mix_position for r in got] == sorted(r.mix_position for r in got) and sum(r.mix_words for r in got) == sum(r.taken for r in plan)
    assert mixing.mixing_plan(docs.limit(0)).count() == 0


def test_quality(spark):
    rnd = random.Random(6)
    good = [(i, text(rnd, rnd.randint(5, 400)), 1) for i in range(120)]
    bad = [(i, "!!! ".join(text(rnd, rnd.randint(5, 200)).upper().split()), 0) for i in range(120, 240)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad if i % 2] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(df, labels)
    found = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    held = [(found[i] >= 0.3) == bool(q) for i, _, q in good + bad if not i % 2]
    assert sum(held) / len(held) > 0.95
    odd = spark.createDataFrame([(1, None, 3.0), (2, "", 4.0)], "doc_id long, text string, score double")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    assert quality.learn(df, labels.filter("quality = 1")) == {"constant": 1.0}
    assert quality.learn(df, labels.limit(0)) == {"constant": 0.5}


def test_quality_gradient():
    rnd = np.random.default_rng(2)
    x, y, starts = rnd.random((9, quality.FEATURES)), np.array([1.0, 0.0, 1.0]), np.array([0, 2, 6])
    shapes = {"E": (quality.FEATURES, quality.WIDTH), "e": (quality.WIDTH,), "V": (quality.WIDTH, quality.GATE), "U": (quality.WIDTH, quality.GATE), "w": (quality.GATE,), "c": (quality.WIDTH,), "b": ()}
    p = {k: rnd.standard_normal(s) * 0.3 for k, s in shapes.items()}
    loss = lambda p: -np.mean(y * np.log(f := quality.forward(p, x, starts)["p"]) + (1 - y) * np.log(1 - f))
    grad = quality.gradient(p, x, starts, y)
    for k in p:
        step = rnd.standard_normal(shapes[k])
        up, down = {**p, k: p[k] + 1e-6 * step}, {**p, k: p[k] - 1e-6 * step}
        assert (loss(up) - loss(down)) / 2e-6 == pytest.approx(np.sum(grad[k] * step), rel=1e-3, abs=1e-7)


def test_embeddings(spark):
    rnd = np.random.default_rng(1)
    base = rnd.standard_normal((40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + (0.12 * rnd.standard_normal(16) if i % 3 else 0)
        rows.append((i, [float(np.float32(c)) for c in v], int(i % 40 % 3)))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1), (404, rows[0][1], None), (405, [], 0), (None, rows[0][1], 0), (0, rows[0][1], 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (408, [1.0], 0)]
    got = [tuple(r) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()]
    ok = [r[1] is not None and len(r[1]) > 0 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None for r in rows]
    linked = lambda a, b: ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= 0.93
    links = {a: {b for b in range(len(rows)) if a != b and linked(a, b)} for a in range(len(rows))}
    truth = sum(map(len, links.values()))
    assert 0.9 * truth <= sum(r[1] for r in got) <= truth
    label = list(range(len(rows)))
    for _ in range(30):
        for a, others in links.items():
            for b in others:
                label[a] = label[b] = min(label[a], label[b])
    expected = []
    for a, r in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if label[b] == label[a] and rows[b][0] is not None]
        expected.append((r[0], min(ids, default=None)))
    wrong = Counter(expected) - Counter((r[0], r[2]) for r in got)
    assert sum(wrong.values()) <= 0.1 * len(rows)


def test_embeddings_find_single_pairs_of_a_large_table(spark):
    rnd = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    a = unit(rnd.standard_normal((6000, 64)))
    aside = rnd.standard_normal(a.shape)
    b = 0.81 * a + (1 - 0.81**2) ** 0.5 * unit(aside - (aside * a).sum(axis=1)[:, None] * a)
    table = pd.DataFrame({"vec_id": np.arange(12000), "embedding": np.concatenate([a, b]).tolist(), "label": 0})
    rows = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    # Few of the pairs have both ends among the vectors that make the codebooks.
    found = embeddings.near_vectors(rows, cosine=0.8, sample=200).filter("n_links > 0").count()
    assert found >= 0.97 * 12000


def test_near_duplicates_keep_one_row_of_each_component(spark):
    rnd = random.Random(11)
    a, b, c, d, e = (text(rnd, 120) for _ in range(5))
    rows = [(5, a), (5, b), (6, a), (7, c), (7, c), (7, c + " more"), (None, d), (None, d), (None, d + " more"), (None, e), (9, e), (8, ""), (8, ""), (5, None)]
    got = [tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    by_text = Counter(t for _, t in got)
    assert len(got) == 8 and (5, a) in got and (5, b) in got and (9, e) in got and by_text[""] == 2 and by_text[None] == 1
    assert by_text[c] + by_text[c + " more"] == 1 and by_text[d] + by_text[d + " more"] == 1


def test_components_in_parts(spark, monkeypatch):
    """A star, a chain and dense groups, cut into many parts, with hot nodes."""
    from surveyspark.llm import common
    from surveyspark.llm import components as module

    monkeypatch.setattr(module, "FOREST", 300)
    monkeypatch.setattr(common, "HOT", 50)
    pairs = [(0, i) for i in range(1, 1200)] + [(i, i + 1) for i in range(2000, 2060)] + [(a, b) for a in range(3000, 3025) for b in range(a) if b >= 3000]
    found = {r.node: r.component for r in module.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found[i] == (0 if i < 1200 else 2000 if i < 3000 else 3000) for p in pairs for i in p)


def test_near_copies_that_do_not_link_do_not_meet_in_all_pairs(spark, monkeypatch):
    """One posting list holds many documents: a large group that links, and many others that link with nothing."""
    rnd = random.Random(13)
    rare, base = text(rnd, 5).upper().replace(" ", "Q "), text(rnd, 100).split()
    rows = [(i, f"{rare} " + " ".join(w if rnd.random() > 0.004 else f"w{rnd.randrange(10**9)}" for w in base)) for i in range(150)]
    rows += [(1000 + i, f"{rare} " + text(rnd, 100)) for i in range(150)]
    made = []
    across = jaccard.Lists.across
    monkeypatch.setattr(jaccard.Lists, "across", lambda self, *a: (made.append((out := across(self, *a)).count()), out)[1])
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).drop("key").collect()
    same([tuple(r) for r in got], brute_jaccard(rows))
    assert sum(made) < 2000
