"""Words that a weak hash confuses, repeated benchmark ids, located edits, and what the pipeline returns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipsift.llm import decontam, gru, jaccard, merkle, substring, textkit


def thue_morse(n):
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_alike_to_polynomials_are_told_apart(spark, n):
    one, two = thue_morse(n)
    same = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {two}"), (3, f"{same} {two}")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.dedup(docs).orderBy("doc_id").collect()] == [0, 0, 20]
    pairs = spark.createDataFrame([(1, f"x y {one}"), (2, f"x y {two}"), (3, f"x y {two}")], "doc_id long, text string")
    assert [r["component_id"] for r in jaccard.join(pairs, n=3, num=90, den=100).orderBy("doc_id").collect()] == [1, 2, 2]
    trained = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert [r["n_known"] for r in gru.score(trained, F.col("doc_id") == 1).orderBy("doc_id").collect()] == [2, 1]


def test_word_hashes_of_all_lengths_differ():
    import numpy as np

    rng = random.Random(1)
    words = {"".join(rng.choices("ab\x00é", k=k)) for k in range(1, 140) for _ in range(20)} | {"a" * k for k in range(1, 200)} | {"\x00" * k for k in range(1, 80)}
    words = sorted(words)
    import pyarrow as pa

    h, other, ptr = textkit.both_hashes(pa.array([" ".join(words)]))
    assert len(np.unique(h)) == len(np.unique(other)) == len(words) == ptr[-1]
    again = textkit.hashes(pa.array(words))[0]
    assert again.tolist() == h.tolist()
    assert (h != other).all()


def test_rolling_hashes_depend_on_order_and_place():
    import numpy as np

    h = np.array([1, 2, 3, 4, 2, 1, 3, 4, 1, 2, 3, 4], np.uint64)
    for k in (1, 2, 3, 4):
        got = textkit.rolling(h, k)
        for i in range(len(got)):
            for j in range(len(got)):
                assert (got[i] == got[j]) == (h[i : i + k].tolist() == h[j : j + k].tolist())


def test_repeated_windows_of_one_id_in_several_buckets(spark):
    text = " ".join(f"v{i}" for i in range(25))
    rows = [(None, f"{text} a{k}") for k in range(8)] + [(5, f"{text} b{k}") for k in range(8)] + [(5, f"{text} b0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.dedup(docs, bucket_bytes=100).collect()
    assert sorted(r["n_removed"] for r in got) == [0] + [25] * 15 + [26]
    assert [r["doc_id"] for r in got if r["n_removed"] == 0] == [5]


@pytest.mark.parametrize("group_bytes", [20, 4 << 20])
def test_repeated_benchmark_ids(spark, group_bytes):
    rng = random.Random(3)
    items = [(7, "the quick brown fox jumps."), (7, "a much longer text of the very same item, " * 3), (7, "ab"), (8, "the quick brown fox jumps."), (None, "nothing has an id here now"), (None, "nothing has an id there now")]
    texts = [t for _, t in items]
    docs = [(i, " ".join([rng.choice(texts).replace(*rng.choice([("fox", "fax"), ("very", "vary"), ("", ""), ("has", "had")])) for _ in range(2)])) for i in range(30)]
    want = set()
    for d, text in docs:
        for item in {i for i, _ in items}:
            found = []
            for t in (decontam.plain_one(t) for i, t in items if i == item):
                e = decontam.budget(len(t), 0.1)
                best = decontam.myers(t, decontam.masks(t), decontam.plain_one(text))[0]
                if (best <= e) if e else f" {t} " in f" {decontam.plain_one(text)} ":
                    found.append((best if e else 0, -len(t)))
            if found:
                want.add((d, item, min(found)[0], round(1 + min(found)[0] / min(found)[1], 9)))
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), group_bytes=group_bytes).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["item_id"], r["distance"], round(r["similarity"], 9)) for r in got} == want


def brute_edit(a, b):
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    return first, len(a) - last, len(b) - last, len(set(y) - set(x)), len(set(x) - set(y))


def test_edits_are_located_after_insertions(spark):
    rng = random.Random(4)
    lines = [f"line {i} of a text that goes on for a while" for i in range(40)]
    cases = [(lines, ["new", *lines]), (lines, lines[:20] + ["new"] + lines[20:]), (lines, lines[1:]), (lines, lines), ([], ["a"]), (["a"], []), (["a", "a"], ["a"]), (["x"], ["y"])]
    cases += [([rng.choice("abc") for _ in range(rng.randint(0, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 7))]) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i long, a array<string>, b array<string>")
    got = df.select("i", merkle.edit(F.col("a"), F.col("b")).alias("e")).orderBy("i").collect()
    assert [tuple(r["e"]) for r in got] == [brute_edit(a, b) for a, b in cases]
    assert tuple(got[0]["e"]) == (0, 0, 1, 1, 0) and tuple(got[1]["e"]) == (20, 20, 21, 1, 0)


def test_fingerprints_tell_short_pieces_apart(spark):
    """Texts whose first six digits of a piece are alike."""
    docs = spark.createDataFrame([(1, "0" * 21 + "878"), (2, "0" * 20 + "2870")], "doc_id long, text string")
    a, b = merkle.fingerprints(docs).orderBy("doc_id").collect()
    assert a["fingerprint"].split("|")[0] != b["fingerprint"].split("|")[0] and a["near_next"] == 0 and a["root"] != b["root"]


def test_the_pipeline_returns_the_corpus(spark, tmp_path):
    rng = random.Random(5)
    words = {"en": ["river", "house", "money", "light", "garden", "winter"], "fr": ["été", "fenêtre", "où", "garçon", "hiver", "jardin"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=40)), lang, f"s{i % 3}", 0, f"keep {i}", "old") for i, lang in enumerate(["en", "fr"] * 40)]
    rows[4] = (4, rows[4][1] + " password: hunter2hunter2 " + rows[6][1], "en", "s1", 0, "keep 4", "old")
    schema = "doc_id long, text string, lang string, source string, n_chars long, `more of it` string, taken string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no passage of this kind is in any document at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus_pipeline.write(spark, str(tmp_path), f"{tmp_path}/out")
    got = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) > 70 and all(r["taken"] > 0 and r["more of it"] == f"keep {i}" and r["lang"] == rows[i][2] and r["size"] == len(r["text"].split()) for i, r in got.items())
    assert "hunter2" not in got[4]["text"] and got[4]["n_chars"] == len(got[4]["text"])
    assert all(got[i]["text"] == rows[i][1] for i in got if i != 4)


def test_the_mix_of_rows_that_repeat_an_id(spark):
    rows = [(1, "a b c d " * 20, "en", "s0", 0)] * 3 + [(None, "e f g " * 30, "en", "s1", 0)] * 2 + [(2, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert len(got) == 5 and all(0 < r["taken"] <= 2 * r["size"] for r in got)
    assert hashlib.sha256(got[0]["text"].encode()).hexdigest()
