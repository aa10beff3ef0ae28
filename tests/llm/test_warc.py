"""Archives with a payload that very many pages share."""

from __future__ import annotations

import hashlib
import random

from surveyspark.llm import warc


def test_a_common_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 5)
    rnd = random.Random(4)
    common, twice, short = "<p>common é</p>" * 20, "<p>twice</p>" * 20, "tiny"
    pages = [(i, f"u{i}", common) for i in range(3000, 100, -1)] + [(i, None, twice) for i in (50, 40)] + [(i, "s", short) for i in range(30)] + [(None, "n", common), (5000, "x", common), (5001, "alone", "".join(rnd.choice("abc ") for _ in range(400_000)))]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(6)
    folder = f"file://{tmp_path}/w"
    assert warc.write_warc(df.select("page_id", "url", "html"), folder).agg({"n_records": "sum"}).first()[0] == len(pages)
    found = {r.page_id: r for r in warc.read_warc(spark, folder, payloads=True).collect()}
    assert len(found) == len(pages)
    for i, _, html in pages:
        first = {common: 101, twice: 40}.get(html)
        assert found[i].refers_to == (first if first not in (None, i) else None) and found[i].payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert found[i].record_type == ("response" if first in (None, i) else "revisit") and (found[i].html == html) == (first in (None, i))
    roles = warc.page_roles(df.select("page_id", "url", "html"))
    assert roles.count() == len(pages)


def test_an_empty_folder_of_archives(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    folder = tmp_path / "none"
    folder.mkdir()
    assert warc.write_warc(none, f"file://{folder}").count() == 0 and warc.read_warc(spark, f"file://{folder}").count() == 0
