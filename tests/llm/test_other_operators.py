"""Chats, archives, nearest neighbours and the pipeline."""

import base64
import hashlib
import importlib.util
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ann, warc
from palimpsest.llm.chat import format_chats, parse_chats

TURNS = "conv_id long, turn long, role string, text string, extra string"


def test_chats_round_trip(spark):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]", ""), (1, 1, "assistant", "</s>[INST] ok [/INST]", ""), (2, 5, "assistant", "b", ""), (2, 3, "user", "a", ""), (2, 4, "user", None, ""), (2, 6, "assistant", "", ""),
        (3, 0, None, "x", ""), (3, 1, "to[ROLE]ol", "y [TURN] z", ""), (3, None, "system", "<<SYS>>\\<\\s>", ""), (4, 0, "user", "same", ""), (4, 0, "user", "same", ""), (5, 0, "assistant", " <", ""), (5, 1, "assistant", "s> [\\\\INST]", ""), (6, 0, "user", "long " * 60_000, ""),
    ]
    df = spark.createDataFrame(rows, TURNS)
    chats = format_chats(df).cache()
    back = {r["conv_id"]: r for r in parse_chats(chats).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert back[c]["loss_text"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    shown = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    assert shown[2] == "[INST] a [TURN]  [/INST]\n<s> b [TURN]  </s>"
    assert shown[1].count("</s>") == 1 and shown[1].count("[INST]") == 1
    assert format_chats(df.limit(0)).collect() == []


def test_chats_use_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "")], TURNS)
    plan = parse_chats(format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3000)
    random.seed(3)
    fake = warc.record(99, "http://x/", b"inner", None).decode()
    pages = [(0, "http://a/", None, "x"), (1, None, "", "x"), (2, "http://b/\r\nWARC/1.0\r\n", fake * 3, "x"), (3, "u", "same", "x"), (4, "u", "same", "x"), (None, "u", "nokey", "x")]
    for i in range(5, 60):
        pages.append((i, f"http://p/{i}", "é" * random.randrange(0, 4000) + random.choice(["", fake, "WARC/1.0\r\n", warc.END.decode()]) + str(i // 2 if i % 3 else i), "x"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string, extra string").repartition(3)
    got = {r["key"]: r for r in warc.read_archives(warc.write_archives(df)).collect()}
    assert len(got) == len(pages)
    by_payload = {}
    for key, _, html, _ in pages:
        by_payload.setdefault((html or "").encode(), []).append(key)
    for key, url, html, _ in pages:
        body = (html or "").encode()
        first = min((k for k in by_payload[body] if k is not None), default=None)
        r = got[key]
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if key == first else ("revisit", first))
        assert r["url"] == (url or "")
        assert r["payload"] == (body if key == first else None)
    assert warc.read_archives(warc.write_archives(df.limit(0))).collect() == []


def test_archives_keep_long_and_escaped_urls(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3000)
    urls = ["http://a/%41%20b", "http://a/" + "x" * 70_000, "http://a/é b\r\n%zz", "http://b/?q=%25&r='1'"]
    rows = [(i, u, f"payload {i} " + "WARC/1.0\r\n" * (i % 3)) for i, u in enumerate(urls * 3)]
    rows += [(5, urls[1], rows[5][2])]  # a repeated row
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(df)
    got = warc.read_archives(manifest).collect()
    assert sorted((r["key"], r["url"], r["payload_bytes"]) for r in got) == sorted((i, u, len(h)) for i, u, h in rows)
    assert [r["record_type"] for r in got if r["key"] == 5] == ["response"] * 2
    cut = manifest.collect()[0]
    path = f"{cut['folder'].removeprefix('file://')}/{cut['name']}"
    with open(path, "r+b") as f:
        f.truncate(cut["bytes"] - 10)
    with pytest.raises(Exception, match="chain of records|no record|digest"):
        warc.read_archives(manifest).collect()


def test_nearest_neighbours_recall_and_ties(spark):
    random_ = np.random.default_rng(1)
    centres = random_.normal(size=(30, 24))
    x = (centres[random_.integers(0, 30, 3000)] + 0.6 * random_.normal(size=(3000, 24))).astype(np.float32)
    x[500:900] = x[500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, []), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [1.0] * 23 + [None]), (5400, [1.0] * 5), (5500, [float("inf")] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        exact = np.lexsort((np.arange(len(d)), d))[:10]
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], rel=1e-12, abs=0) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(exact.tolist()))
    assert hits >= 0.95 * 10 * len(got)
    assert [v for _, v, _ in got[600]] == list(range(500, 510))
    few = ann.nearest(df.filter("vec_id < 4"), F.col("id") % 100 == 0).collect()
    assert [r["vec_id"] for r in few] and len(few) == 3
    assert ann.nearest(df.limit(0), F.col("id") % 100 == 0).collect() == []


def test_nearest_neighbours_of_doubles(spark):
    base = np.array([1.0, 2.0, 3.0, 4.0])
    rows = [(i, (base + i * 1e-12).tolist()) for i in range(40)]
    rows += [(3, rows[3][1]), (41, (1e200 * base).tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 11))
    x = np.array([r[1] for r in rows[:40]])
    assert all(r["score"] == np.sqrt(((x[r["vec_id"]] - x[0]) ** 2).sum()) for r in got)


@pytest.mark.parametrize("kind", ["offset", "scales", "tight", "tiny", "huge"])
def test_nearest_neighbours_are_exact_on_any_rows(spark, kind):
    random_ = np.random.default_rng(4)
    x = random_.normal(size=(2000, 12))
    if kind == "offset":
        x += 1e5
    elif kind == "scales":
        x *= 10.0 ** random_.uniform(-6, 6, size=(2000, 1))
    elif kind == "tight":
        x = random_.normal(size=(4, 12))[random_.integers(0, 4, 2000)] + 1e-9 * x
    else:
        x *= {"tiny": 1e-162, "huge": 1e155}[kind]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 2000, 100))
    for q, found in got.items():
        with np.errstate(all="ignore"):
            d = np.sqrt(sum((x[:, j] - x[q, j]) ** 2 for j in range(12)))
        best = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        assert sorted(found) == [(n, i, d[i]) for n, i in enumerate(best, 1)]


def test_scan_rows_do_not_follow_the_partitions(spark):
    random_ = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(random_.normal(size=(1500, 8)).astype(np.float32))], "vec_id long, embedding array<float>")
    one, many = (sorted(map(tuple, ann.nearest(df.repartition(n), F.col("id") % 100 == 0).collect())) for n in (1, 16))
    assert one == many


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="needs the pipeline")
def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    random.seed(8)
    word = lambda: "".join(random.choices(["the", "ing", "ou", "st", "er"], k=3))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage, base = text(30), text(60), text(120)
    texts = [base, base, base.replace(base.split()[60], "changed", 1), text(50) + " " + passage + " " + text(50), text(40) + " " + passage + " " + text(70), text(40) + " " + item + " " + text(40), "12 34", None, ""]
    texts += [text(80) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        kept[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "tokens":
            assert now.columns == docs.columns
    every = set(range(len(texts)))
    assert set(kept["language"]) == every - {6, 7, 8}
    assert set(kept["near_duplicates"]) == every - {1, 2, 6, 7, 8}
    assert passage in kept["repeated_passages"][3]["text"] and passage not in kept["repeated_passages"][4]["text"]
    assert kept["repeated_passages"][4]["n_chars"] == len(kept["repeated_passages"][4]["text"])
    assert set(kept["clean_of_benchmark"]) == every - {1, 2, 5, 6, 7, 8}
    assert set(kept["tokens"]) == set(kept["clean_of_benchmark"])
