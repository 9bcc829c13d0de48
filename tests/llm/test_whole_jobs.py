"""Jobs that were once done in part only."""

from __future__ import annotations

import io

from tidebars.llm import arc, toxicity


def test_filedesc_url_is_a_record():
    opening = arc.arc_opening(1, "part-0.arc", "20240101000000")
    body = b"2 0 not a version block"
    lines = [arc.arc_header(1, url, arc.NO_ADDRESS, "20240101000000", "text/html", len(body)).encode() + b"\n" + body + b"\n" for url in ("filedesc:page", "http://a.b/")]
    found = list(arc.parse_arc(io.BytesIO(opening + b"".join(lines))))
    assert [(r[1], r[2]["URL"], r[3]) for r in found] == [(1, "filedesc:page", body), (1, "http://a.b/", body)]


def test_lexicon_has_no_cap(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TERMS", 1, raising=False)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    assert len(toxicity.learn(docs, labels)[0]) > 1
