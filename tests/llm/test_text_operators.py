"""Tokens, records, languages, quality and decontamination: exact round trips, held-out accuracy, brute force."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, langid, quality, records
from palimpsest.llm.bpe import ForcedBoundaryBPE, encode_documents

vocabularies = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, extra string"
ODD = [
    None, "", " ", "\n", "a", "Hello <|endoftext|>World's I'LL DON'T 12³ µm", "Σίσυφος ΟΔΟΣ İx naïve é \x1c a\xa0b", "汉字 emoji 😀!! \x85 x\tz", "<|startoftext|><|endoftext|> ", "a  b\n\n c\r\nd", "x.\nNext, 'tis \n end ",
    "́ a", "ß ſ ŉ ª½ _a_", "word " * 3000, "é" * 2000, "<|endoftext|>", "tail\n",
]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], SCHEMA)


def test_encoding_is_that_of_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabularies.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in encode_documents(documents(spark, [*ODD, *ODD]), path, keep_ids=True, keep_text=True).collect()}
    assert len(got) == 2 * len(ODD)
    for i, text in enumerate([*ODD, *ODD]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_cuts_are_certain():
    bpe = ForcedBoundaryBPE(vocabularies.path("word_bpe_49k.json"))
    random.seed(2)
    letters = [c for name in list(bpe.vocab)[:400] for c in name[:1]]
    cut = 0
    for _ in range(300):
        piece = "".join(random.choices(letters, k=random.randrange(1, 12)))
        whole = bpe._merge((piece, True))
        assert bpe.encode_piece(piece) == whole
        cut += len(bpe.cuts(piece)) > 1
    assert cut


def test_empty_tables(spark):
    empty = documents(spark, [])
    path = vocabularies.path("byte_bpe_50k.json")
    assert encode_documents(empty, vocabularies.path("word_bpe_49k.json")).collect() == []
    assert records.read_records(records.write_records(empty, path, 2)).collect() == []
    assert langid.predict(empty, langid.train(empty)).collect() == []
    assert quality.features(empty).collect() == []
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontaminate.contaminated(empty, items).collect() == []
    assert decontaminate.contaminated(documents(spark, ODD), items.limit(0)).collect() == []


def test_records_are_in_order_and_whole(spark):
    from tokenizers import Tokenizer

    path = vocabularies.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i * 7 % 23, t, None, "x") for i, t in enumerate([*ODD, *ODD[5:10]])]
    manifest = records.write_records(spark.createDataFrame(rows, SCHEMA).repartition(3), path, 2)
    got = sorted(records.read_records(manifest).collect(), key=lambda r: r["start"])
    start = 0
    by_key = sorted(rows, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode()))
    for r, (key, text, _, _) in zip(got, by_key, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["key"], r["start"], r["n_tokens"]) == (key, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    first = manifest.orderBy("file_no").first()
    key, ids = records.read_at(first["folder"], first["name"], first["n_docs"] - 1)
    assert (key, len(ids)) == (got[first["n_docs"] - 1]["key"], got[first["n_docs"] - 1]["n_tokens"])


def test_damage_is_noticed():
    data = bytearray(records.frame(5, b"\x01\x00\x02\x00", 2))
    assert records.read_frame(io.BytesIO(data))[0] == 5
    for at in (0, 9, 20, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(broken))


def test_languages_held_out(spark):
    random.seed(4)
    syllables = {"aa": ["the", "ing", "ou", "st"], "bb": ["ção", "nh", "ei", "ra"], "cc": ["sch", "ung", "ei", "tz"]}
    word = lambda lang: "".join(random.choices(syllables[lang], k=random.randrange(1, 4)))
    texts = [(i, " ".join(word(lang) for _ in range(random.randrange(3, 60))), lang, "x") for i, lang in enumerate(["aa", "bb", "cc"] * 150)]
    df = spark.createDataFrame(texts, SCHEMA)
    model = langid.train(df.filter("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    held = [i for i, *_ in texts if i % 4 == 2]
    assert sum(got[i]["lang_pred"] == texts[i][2] for i in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in got.values()) <= 0.02 * len(got)
    odd = langid.predict(documents(spark, [None, "", "12 34 !?", "the ing " * 40_000]), model).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["rejected"]) for r in odd] == [("und", True)] * 3 + [("aa", False)]
    assert odd[0]["score"] == 0


def test_quality_held_out(spark):
    random.seed(6)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        words = ["".join(random.choices("etaoinshr", k=random.randrange(2, 8))) for _ in range(random.randrange(30, 120))]
        if not good:
            words = [w.upper() + random.choice(["!!", "###", "$$"]) if random.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words), int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    x = quality.features(df).cache()
    model = quality.fit(x.join(df.filter("doc_id % 4 <> 1").select("doc_id", "label"), "doc_id"))
    got = {r["doc_id"]: r["score"] for r in quality.score(x, model).collect()}
    held = [r for r in rows if r[0] % 4 == 1]
    assert sum((got[i] >= 0.5) == bool(label) for i, _, label in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    odd = quality.score(quality.features(documents(spark, ODD)), model).collect()
    assert len(odd) == len(ODD) and all(r["score"] == r["score"] for r in odd)
    one = quality.fit(x.join(df.filter("label = 1").select("doc_id", "label"), "doc_id"))
    assert {r["score"] for r in quality.score(x, one).collect()} == {1.0}


def tile_brute(x, y, least):
    """Greedy tiling as it is defined: the longest common run of unmarked places, again and again."""
    mx, my, covered = [False] * len(x), [False] * len(y), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and not mx[i + n] and not my[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        mx[i : i + n] = [True] * n
        my[j : j + n] = [True] * n
        covered += n


def test_tiling_matches_brute_force():
    random.seed(9)
    for _ in range(60):
        item = [random.choice("abcdefghijklmnop") for _ in range(random.randrange(5, 30))]
        cut = random.randrange(len(item))
        x = [*random.choices("abcdefghijklmnop", k=10), *item[cut:], *random.choices("abcd", k=3), *item[:cut]]
        hits = np.array([(i, j) for i in range(len(x) - 4) for j in range(len(item) - 4) if x[i : i + 5] == item[j : j + 5]], int).reshape(-1, 2)
        i, j = hits[:, 0], hits[:, 1]
        coverage = tile_brute(x, item, decontaminate.LEAST) / len(item)
        found, _ = decontaminate.tiled(i, j, decontaminate.LEAST, len(item))
        assert (found >= decontaminate.COVERAGE) == (coverage >= decontaminate.COVERAGE)
        if found >= decontaminate.COVERAGE:
            assert found == pytest.approx(coverage)


def test_contamination_matches_brute_force(spark):
    random.seed(21)
    word = lambda: random.choice("abcdefghijklmnop") * random.randrange(1, 3)
    items = [(i, [word() for _ in range(random.randrange(3, 25))]) for i in range(12)] + [(20, ["zz"] * 12), (21, ["zz", "q"] * 8)]
    texts = [["zz"] * 400, ["q", "zz"] * 60, ["zz"] * 11]
    for _ in range(40):
        parts = [[word() for _ in range(random.randrange(8))] for _ in range(4)]
        own = [w if random.random() < 0.93 else word() for w in random.choice(items)[1]]
        cut = random.randrange(len(own) + 1)
        texts.append([*parts[0], *own[cut:], *parts[1], *own[:cut], *parts[2], *random.choice(items)[1], *parts[3]])
    expected = {}
    for d, x in enumerate(texts):
        for i, y in items:
            share = tile_brute(x, y, min(len(y), decontaminate.LEAST)) / len(y)
            if share >= decontaminate.COVERAGE:
                expected[d, i] = share
    df = spark.createDataFrame([(d, " ".join(x).upper(), None, "x") for d, x in enumerate(texts)], SCHEMA).withColumn("item_id", F.lit(1)).repartition(3)
    bench = spark.createDataFrame([(i, " ".join(y), i) for i, y in [*items, *[(i + 100, y) for i, y in items]]], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contaminated(df.union(df), bench).collect()}
    assert got == pytest.approx(expected)


def test_long_repetitive_texts(spark):
    df = documents(spark, ["w " * 60_000, "a b " * 20_000])
    bench = spark.createDataFrame([(1, "w " * 40), (2, "a b " * 20), (3, "w")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(0, 1): 1.0, (0, 3): 1.0, (1, 2): 1.0}


def test_reordered_passages_are_contamination(spark):
    item = " ".join(f"w{i}" for i in range(40))
    words = item.split()
    texts = [*ODD, f"before {item} after", " ".join(["x", *words[20:], "y", *words[:20]]), " ".join(words[:12]), " ".join(f"u{i}" for i in range(500))]
    items = spark.createDataFrame([(7, item), (9, item), (8, None), (10, ""), (11, "short one")], "item_id long, text string")
    got = decontaminate.contaminated(documents(spark, texts), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(len(ODD), 7), (len(ODD) + 1, 7)}
