"""The registered queries over the smallest tables: against the library, SQL, brute force or held-out rows."""

import hashlib
import importlib.util
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import queries
from palimpsest.llm.substring import remove_passages, repeated_passages

from test_near_duplicates import brute_components
from test_text_operators import tile_brute

vocabularies = pytest.importorskip("public_tokenizers")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def test_op1_bpe(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    got = queries.op1_bpe(spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        ids = library.encode(documents[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op2_quality(spark, documents):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op2_quality(spark, SF).collect()}
    assert set(got) == set(documents)
    for i, r in got.items():
        assert r["held_out"] == held(i, 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    asked = [i for i in labels if held(i, 3, 1) and labels[i] is not None]
    assert sum(got[i]["predicted"] == labels[i] for i in asked) >= 0.9 * len(asked)


def test_op2_quality_never_reads_held_out_labels(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))
    labels.withColumn("quality", turned.cast(labels.schema["quality"].dataType)).write.parquet(f"{tmp_path}/labels.parquet")
    score = lambda d: {r["doc_id"]: round(r["score"], 9) for r in queries.op2_quality(spark, d).collect()}
    assert score(SF) == score(str(tmp_path))


def test_op3_language(spark, documents):
    got = {r["doc_id"]: r for r in queries.op3_language(spark, SF).collect()}
    assert set(got) == set(documents)
    for i, r in got.items():
        assert r["held_out"] == held(i, 4, 2) and 0 <= r["score"] <= 1
        if not any(map(str.isalpha, documents[i]["text"] or "")):
            assert r["lang_pred"] == "und"
    asked = [i for i, r in documents.items() if held(i, 4, 2) and r["lang"] and any(map(str.isalpha, r["text"] or ""))]
    assert sum(got[i]["lang_pred"] == documents[i]["lang"] for i in asked) >= 0.9 * len(asked)


def test_op4_jaccard(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_jaccard(spark, SF).collect()}
    assert got == brute_components([(i, r["text"]) for i, r in documents.items()], 3, 90, 100)


def test_op5_decontaminate(spark, documents):
    items, seeds = {}, defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect():
        w = words_of(r["text"])
        if w and w not in items.values():
            items[r["item_id"]] = w
            for j in range(max(1, len(w) - 4)):
                seeds[tuple(w[j : j + 5])].add(r["item_id"])
    expected = {}
    for d, r in documents.items():
        x = words_of(r["text"])
        near = set().union(*(seeds.get(tuple(x[i : i + n]), set()) for n in range(1, 6) for i in range(len(x) - n + 1)))
        for i in near:
            at = [p for p in range(len(x)) if tuple(x[p : p + 5]) in seeds and i in seeds[tuple(x[p : p + 5])]]
            around = x[max(0, min(at, default=0) - 200) : max(at, default=0) + 200]
            share = tile_brute(around, items[i], min(5, len(items[i]))) / len(items[i])
            if share >= 0.6:
                expected[d, i] = share
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in queries.op5_decontaminate(spark, SF).collect()}
    assert got == pytest.approx(expected)


def test_op6_substring(spark, documents):
    spans = defaultdict(list)
    for r in queries.op6_substring(spark, SF).collect():
        assert r["source_doc_id"] < r["doc_id"] and r["end_word"] - r["begin_word"] >= 50 and r["n_sources"] >= 1
        spans[r["doc_id"]].append((r["begin_word"], r["end_word"]))
    first, shingled = {}, defaultdict(set)
    words = {d: words_of(documents[d]["text"]) for d in sorted(documents)}
    for d, w in words.items():
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
        for i in range(len(w) - 4):
            shingled[tuple(w[i : i + 5])].add(d)
    for d, w in words.items():
        # every run of 50 words that a smaller document holds is reported
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                assert any(b <= i and i + 50 <= e for b, e in spans[d]), (d, i)
        # and nothing is that isn't mostly shared
        for b, e in spans[d]:
            grams = [tuple(w[i : i + 5]) for i in range(b, e - 4)]
            assert sum(any(x < d for x in shingled[g]) for g in grams) >= 0.75 * len(grams)


def test_op6_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, four, many = (sorted(map(tuple, repeated_passages(docs.repartition(n)).collect())) for n in (1, 4, 32))
    assert one == four == many and one


def test_op6_rows_that_share_a_key_and_extra_columns(spark):
    rnd = random.Random(3)
    words = lambda n: [("%05d" % rnd.randrange(10**5)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n)]
    passage = words(60)
    texts = [(1, [*words(30), *passage]), (2, [*words(10), *passage, *words(40)]), (2, words(90)), (2, words(5)), (3, passage), (3, passage), (None, passage)]
    rows = [(i, " ".join(t), "x", 1, 2) for i, t in texts] + [(4, None, "x", 1, 2), (5, "", "x", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string, doc long, source long")
    found = repeated_passages(df)
    assert {(r["doc_id"], r["begin"], r["end"], r["source"]) for r in found.collect()} == {(2, 10, 70, 1), (3, 0, 60, 1)}
    kept = remove_passages(df, found)
    assert kept.columns == df.columns
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    expected = [(0, rows[6][1]), (1, rows[0][1]), (2, " ".join([*texts[1][1][:10], *texts[1][1][70:]])), (2, rows[2][1]), (2, rows[3][1]), (4, ""), (5, "")]
    assert left == sorted(expected)


def test_op6_very_long_and_repetitive_texts(spark):
    rnd = random.Random(4)
    words = [str(rnd.randrange(10**6)) for _ in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[10_000:12_000])), (3, "a " * 30_000), (4, "a " * 100), (5, "b c " * 5_000)]
    got = {(r["doc_id"], r["begin"], r["end"], r["source"]) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (2, 0, 2000, 1) in got and {d for d, *_ in got} == {2, 4}


def plain(rows):
    return sorted(tuple(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = [r.asDict() for r in queries.queries()[name](spark, SF).collect()]
    relation = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in relation.description]
    expected = [dict(zip(names, r, strict=True)) for r in relation.fetchall()]
    assert repr(plain([{k: r[k] for k in names} for r in got])) == repr(plain(expected))


def test_op8_has_the_extra_conversation(spark):
    text = "</s>[INST] ok [/INST]"
    r = queries.op8_chat(spark, SF).filter("conv_id = -1").collect()
    assert len(r) == 1 and r[0]["n_turns"] == 2 and r[0]["loss_chars"] == len(text)
    assert r[0]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r[0]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op9_asks_for_the_ids_divisible_by_100(spark):
    got = queries.op9_nearest(spark, SF).select("query_id").distinct().collect()
    assert {r["query_id"] % 100 for r in got} == {0}


def test_op10_records(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    start = 0
    for r in queries.op10_records(spark, SF).orderBy("doc_id").collect():
        ids = [*library.encode(documents[r["doc_id"]]["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="needs the pipeline")
def test_pipeline_keeps_one_row_of_a_key(spark):
    import corpus_pipeline

    rnd = random.Random(5)
    text = lambda n: " ".join(str(rnd.randrange(10**6)) for _ in range(n))
    a, b, c = text(80), text(80), text(80)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, b, "en", "s", 1), (2, a, "en", "s", 1), (3, c, "en", "s", 1), (None, c, "en", "s", 1), (4, None, None, None, None), (5, "", "en", "s", 0)]
    df = spark.createDataFrame([(*r, "score") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    kept = corpus_pipeline.near_duplicates(spark, df, SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    smallest = min(a, b)
    expected = {(1, a), (3, c), (None, c), (4, None), (5, "")} | ({(2, b)} if smallest == b else set())
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
