"""Chat formatting against plain string building, and back."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest

from surveyspark.llm import chat

PARTS = ["\\", "<turn>", "<text>", "</turn>", "<", "turn>", "</", "a", "é", "日本", "😀", " ", "\n", "### Assistant: ", "\\\\", ">"]


def plain(text, template):
    """Escape by looking at each character."""
    out = ""
    for i, c in enumerate(text or ""):
        begun = any(i and text.startswith(m, i - 1) for m in template.markers)
        out += ("\\" if c == "\\" or begun else "") + c
    return out


def odd(rnd):
    return rnd.choice([None, "", "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))])


@pytest.mark.parametrize("template", [chat.Template(), chat.Template("†open", "†says|", "†end", ("x", "†end"))])
def test_assemble(template, monkeypatch):
    rnd = random.Random(1)
    for step in (3, 1 << 20):
        monkeypatch.setattr(chat, "STEP", step)
        for _ in range(150):
            n = rnd.randint(1, 9)
            roles, texts = [[rnd.choice([odd(rnd), *template.markers, *template.learned]) for _ in range(n)] for _ in "ab"]
            skip = rnd.randrange(n)
            raw, at, chars, spans = chat.assemble(pa.array(roles, pa.string())[skip:], pa.array(texts, pa.string())[skip:], template)
            turns = [template.opens + plain(r, template) + template.says + plain(t, template) + template.ends for r, t in zip(roles[skip:], texts[skip:], strict=True)]
            whole = bytes(raw).decode()
            assert whole == "".join(turns) and [len(bytes(raw)[: a].decode()) for a in at] == chars.tolist()
            assert [whole[s:e] for s, e in spans] == [plain(t, template) for t in texts[skip:]]
            assert template.parse(whole) == [(r or "", t or "") for r, t in zip(roles[skip:], texts[skip:], strict=True)]
            assert sum(whole.count(m) for m in template.markers) == 3 * len(turns)


def test_templates_that_cannot_be_read():
    for markers in (("", "b", "c"), ("<a<", "<b", "<c"), ("\\a", "<b", "<c"), ("<a", ">b<", "<c"), ("<", "<b", "<c")):
        with pytest.raises(ValueError):
            chat.Template(*markers)
    for broken in ("<turn>a", "x<turn>a<text>b</turn>", "<turn>ab</turn>"):
        with pytest.raises(ValueError):
            chat.Template().parse(broken)


@pytest.fixture(scope="module")
def turns():
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), odd(rnd)) for c in range(200) for t in range(rnd.randint(1, 6))]
    rows += [(1 << 60, t, "assistant" if t % 2 else "user", "w" * rnd.randint(0, 400)) for t in range(3000)] + [(None, 1, "user", "no id"), (None, 0, "assistant", "\\"), (7, None, "assistant", "first")]
    rows += [(8, 1, "user", "twice")] * 2 + [(300, 0, "assistant", "long " * 400_000), (301, 0, "assistant", "x"), (-7, 0, "user", "before")]
    rnd.shuffle(rows)
    return rows


def expected(rows, template=chat.Template()):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, said in by.items():
        said = [s[2:] for s in sorted(said)]
        loss = "".join(x for r, x in said if r == "assistant")
        size = sum(len(plain(r, template)) + (len(x) if len(x) > 10_000 else len(plain(x, template))) + sum(map(len, template.markers)) for r, x in said)
        yield c, len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)), len(loss), sha(loss), size


@pytest.mark.parametrize("piece", [100, 4 << 20])
def test_pieces(spark, turns, piece, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", piece)
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn int, role string, text string, piece long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    monkeypatch.setattr(chat, "bounded_batches", lambda spark: None)
    pieces = chat.materialize(chat.format_conversations(df), "chat")
    got = [tuple(r) for r in chat.turn_digests(pieces).collect()]
    assert sorted(got, key=repr) == sorted(expected(turns), key=repr)
    rows = pieces.orderBy("piece").collect()
    ids = [r.conv_id for r in rows]
    assert sum(r.n_turns for r in rows) == len(turns) and all(not r.whole or ids.count(r.conv_id) == 1 for r in rows)
    assert sum(ids.count(i) == 1 for i in set(ids)) > 190 and (piece > 100 or ids.count(1 << 60) > 10)
    assert chat.turn_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_query(spark, turns, tmp_path):
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = list(expected([*turns, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]))
    assert sorted((tuple(r) for r in chat.op13_chat(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(db.sql(chat.OP13_SQL).fetchall(), key=repr) == sorted(want, key=repr)
