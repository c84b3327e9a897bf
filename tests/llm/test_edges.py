"""Operators at their edges: brute force on random inputs, long texts, ties and repeats, empty tables, columns of any name."""

import hashlib
import random
import re
import string
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipsift.llm import common, decontam, gru, jaccard, langid, merkle, mixing, secrets, substring, textkit, toxicity, urlfilter

#: Names that helpers and results of operators use, and odd ones.
CLASHES = ("_text", "_letter", "_doc", "spans", "redacted", "n_hex", "score", "predicted", "lang_pred", "component_id", "shard", "quota", "hash", "u", "a.b", "_0")


def with_clashes(df):
    for c in CLASHES:
        df = df.withColumn(c, F.concat(F.lit(f"keep {c} "), F.col("doc_id").cast("string")))
    return df


def clashes_kept(row):
    return all(row[c] == f"keep {c} {row['doc_id']}" for c in CLASHES if c in row.asDict())


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(21)
    words = {"en": ["river", "house", "money", "light"], "fr": ["été", "fenêtre", "où", "garçon"], "ru": ["РЕКА", "дом", "свет", "утро"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang, f"s{i % 3}", 0) for i, lang in enumerate(["en", "fr", "ru"] * 40)]
    rows += [(200, None, None, None, 0), (201, "", "en", "s0", 0), (202, "123 45", "en", "s0", 0), (0, rows[0][1], "en", "s0", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


# --- decontamination


def brute(items, text, rate):
    """Best distance of each item within its budget; without a budget only as whole words, unchanged."""
    out = {}
    for i, item in items:
        if not item:
            continue
        e = int(rate * len(item))
        if not e:
            if f" {item} " in f" {text} ":
                out[i] = 0
            continue
        best = decontam.myers(item, decontam.masks(item), text)[0]
        if best <= e:
            out[i] = best
    return out


def test_matches_equal_brute_force(spark):
    rng = random.Random(22)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 8)))
    items = []
    for i in range(60):
        size = [rng.randint(1, 9), rng.randint(10, 40), rng.randint(41, 400)][i % 3]
        items.append((i, " ".join(word("abcde") for _ in range(size))[:size].strip() or "a"))
    docs = []
    for k in range(150):
        parts = [word("abxyz") for _ in range(30)]
        for i in rng.sample(range(60), 3):
            t = list(items[i][1])
            for _ in range(rng.randint(0, 1 + len(t) // 9)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = rng.choices("abcdexyz", k=rng.randint(0, 1))
            parts.insert(rng.randrange(len(parts)), "".join(t))
        docs.append((k, " ".join(parts)))
    got = {}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for r in decontam.matches(d, b, group_bytes=2000).collect():
        got[r.doc_id, r.item_id] = r.distance
    want = {}
    plain = [(i, decontam.plain_one(t)) for i, t in items]
    for k, t in docs:
        for i, x in brute(plain, decontam.plain_one(t), 0.1).items():
            want[k, i] = x
    assert got == want
    assert sum(x > 0 for x in want.values()) > 30


def test_short_items_are_whole_words_and_remove_nothing(spark):
    d = spark.createDataFrame([(1, "It came yesterday, a gift."), (2, "Yes. It did."), (3, "A.")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "A."), (2, "Yes."), (3, "day"), (None, "It came yesterday, a gift")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(d, b).collect()} == {(1, 1), (1, None), (2, 2), (3, 1)}
    assert sorted(r.doc_id for r in decontam.screen(d, b).collect()) == [2, 3]
    assert decontam.screen(with_clashes(d), b.where("item_id < 3")).count() == 3
    assert all(clashes_kept(r) for r in decontam.screen(with_clashes(d), b).collect())
    assert decontam.matches(d, b.limit(0)).count() == 0
    assert decontam.matches(d.unionAll(d), b).count() == 8


# --- language


def test_language_ngrams_are_of_characters(spark, prose):
    data, offsets = textkit.buffers(pa.array(["ÉTÉ 1 Où", "été où", "日本", "a"]))
    code, at = langid.characters(data, offsets)
    assert "".join(map(chr, code[: at[1]])) == "été   où"
    assert at.tolist() == [0, 8, 14, 16, 17]
    doc, _, count = langid.sparse_counts(data, offsets)
    assert [int(count[doc == k].sum()) for k in range(4)] == [7 + 6 + 5, 5 + 4 + 3, 1, 0]
    long = ["Ночь и été " * 3000]
    whole, cut = (langid.sparse_counts(*textkit.buffers(pa.array(long)), most=m) for m in (1 << 21, 1000))
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    model = langid.train(prose)
    got = langid.predict(with_clashes(prose), model, keep=[*[common.quoted(c) for c in CLASHES], "doc_id", "lang"]).collect()
    assert len(got) == prose.count()
    assert all(r.lang_pred == r.lang for r in got if r.doc_id < 200)
    assert {r.lang_pred for r in got if r.doc_id >= 200} == {"und"}
    assert all(r["_text"] == f"keep _text {r.doc_id}" and r["_letter"] == f"keep _letter {r.doc_id}" for r in got)
    assert langid.predict(prose.limit(0), model).count() == 0


# --- toxicity


def test_toxicity_edges(spark, prose):
    labels = prose.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(prose, labels, sample_bytes=3000)
    got = toxicity.score(with_clashes(prose), model, keep=[*[common.quoted(c) for c in CLASHES if c not in ("score", "predicted")], "doc_id"]).collect()
    assert len(got) == prose.count()
    assert all(0 <= r.score <= 1 and r["_text"] == f"keep _text {r.doc_id}" and r["a.b"] == f"keep a.b {r.doc_id}" for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert toxicity.score(prose.limit(0), model).count() == 0
    text = lambda df: df.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    assert toxicity.score(text(prose), toxicity.train(text(prose), text(labels))).count() == prose.count()
    sized = prose.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    kept = toxicity.within_bytes(sized, 3000)
    assert 2000 < kept.agg(F.sum(F.octet_length("text"))).first()[0] <= 3000
    assert toxicity.train(prose, labels.limit(0)).thresholds == {"": 0.5}


def test_toxicity_learns_from_rows_beyond_the_sample(spark):
    rng = random.Random(6)
    bad = [f"{a}{b}vile" for a in "bcdfg" for b in "aeiou"]
    rows = [(i, " ".join([*rng.choices([f"a{k}" for k in range(200)], k=40), *([bad[i // 3 % 25]] if i % 3 == 0 else [])]), "en") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).where("doc_id < 1200")
    model = toxicity.train(docs, labels, per_class=4, shard_bytes=100_000)
    got = toxicity.score(docs.where("doc_id >= 1200"), model).collect()
    assert sum((r.doc_id % 3 == 0) == bool(r.predicted) for r in got) > 0.95 * len(got)
    assert set(model.thresholds) == {"", "en"}
    assert np.array_equal(model.languages.matrix, langid.train(docs, per_language=10_000).matrix)


def test_threshold_equals_search_over_all_steps():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = rng.integers(0, 3, (2, 64)) * rng.integers(0, 2, 64) + 1 * (np.arange(64) == 5)
        counts[0, 0] += 20
        counts[1, 63] += 20
        right = [counts[0, :k].sum() + counts[1, k:].sum() for k in range(65)]
        at = toxicity.best_threshold(counts, 0.5) * 64
        assert max(right[int(at)], right[-int(-at // 1)]) == max(right)
    assert toxicity.best_threshold(np.array([[30, 0, 0, 0], [0, 0, 0, 19]]), 0.5) == 0.5
    assert toxicity.best_threshold(np.array([[30, 0, 0, 0], [0, 0, 0, 20]]), 0.3) == 0.5


# --- secrets


def test_ordinary_identifiers_pass_and_planted_keys_are_found(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = secrets.train(secrets.ordinary_sample(d))
    spans = lambda t: secrets.model_spans(t, model, secrets.base_spans(t))
    for t in ("getUserProfileImage2", "test_case_number_12345", "com/en/products/item-10293", "image_gallery_thumbnail_003", "2024-01-05_report_final"):
        assert spans(t) == [], t
    rng = random.Random(23)
    kinds = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits)
    keys = ["".join(rng.choices(kinds[i % 3], k=rng.randint(16, 48))) for i in range(600)]
    found = sum([(a, b) for a, b, *_ in spans(f"the {k} of")] == [(4, 4 + len(k))] for k in keys)
    others = [s for s in secrets.identifiers(["river", "house", "money", "light", "morning", "market"], 3000, seed=24) if len(s) >= 16]
    wrong = sum(bool(spans(s)) for s in others)
    assert found / len(keys) > 0.98
    assert wrong / len(others) < 0.01


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(25)
    bits = ["token=", "PassWord : ", "api_key='", "secret", "AKIA", "ABCDEF0123456789", "0123abcdef" * 3, "deadbeef" * 4, " ", "\n", "é", "x", "value12345", "=", ":", '"', "😀"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(400)]
    model = secrets.train(["ordinary", "identifier", "words"] * 50)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(d, model).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        count = lambda k: sum(f[3] == k for f in found)  # noqa: E731, B023
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (count("assign"), count("access"), count("hex"))
        listed = [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("markov")] == listed
    assert sum(len(r.spans) > 0 for r in got.values()) > 100


def test_secrets_edges(spark):
    model = secrets.train(["ordinary", "identifier", "words"] * 50)
    d = spark.createDataFrame([(1, "token=abcdefgh12"), (1, "token=abcdefgh12"), (2, None)], "doc_id long, text string")
    packed = corpus_pipeline.packed(with_clashes(d))
    got = secrets.scan(packed, model, text_col="_text", keep=["_doc"], redact=True).collect()
    assert all(clashes_kept(r["_doc"]) for r in got)
    assert [r.spans for r in got if r["_doc"]["doc_id"] == 1] == ["assign:0:16"] * 2
    assert secrets.scan(d.limit(0), model).count() == 0
    assert secrets.ordinary_sample(d.limit(0)) == []
    long = " ".join(f"token=abcdefgh{i:08} q9Zt7LmX2vB8nR4wY6pD{i}" for i in range(20_000))
    assert len(secrets.model_spans(long, model, secrets.base_spans(long))) == 20_000


# --- fingerprints


def test_roots_tell_texts_apart_and_differences_locate(spark):
    rng = random.Random(26)
    base = "\n".join("".join(rng.choices("abc d", k=rng.choice([0, 5, 24, 70]))) for _ in range(20))
    edits = ["000000000000000000000878", "000000000000000000002870", base, base[:300] + "#" + base[301:], base + "\n", base[:-30], base.replace("\n", "", 1), "", None]
    d = spark.createDataFrame(list(enumerate(edits)), "doc_id long, text string")
    prints = {r.doc_id: r for r in merkle.fingerprints(d).collect()}
    assert len({r.root for r in prints.values()}) == len(edits) - 1
    assert prints[7].root == prints[8].root
    t = merkle.trees(d)
    pairs = t.select(F.col("doc_id").alias("i"), F.col("tree").alias("a")).crossJoin(t.select(F.col("doc_id").alias("j"), F.col("tree").alias("b")))
    cut = lambda x: [re.findall("(?s).{1,24}", p) for p in (x or "").split("\n")]
    for r in pairs.select("i", "j", merkle.differences(F.col("a"), F.col("b")).alias("d")).collect():
        a, b = cut(edits[r.i]), cut(edits[r.j])
        want = []
        for p in range(max(len(a), len(b))):
            x, y = (a[p] if p < len(a) else None), (b[p] if p < len(b) else None)
            if x == y:
                continue
            n = max(len(x or []), len(y or []))
            at = [k for k in range(n) if (x or [])[k : k + 1] != (y or [])[k : k + 1]]
            want += [(p // 8, p, k) for k in at or [0]]
        assert [tuple(x) for x in r.d] == want, (r.i, r.j)


def test_edited_texts_are_hashed_as_if_whole(spark):
    rng = random.Random(27)
    rows = [(i, "".join(rng.choices("ab\né😀", k=rng.randint(0, 200)))) for i in range(80)] + [(90, "x" * 100), (91, "\n" * 30), (91, "\n" * 30), (None, "last")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    edited = [(k, t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3]) for k, (_, t) in enumerate(order)]
    whole = {r.doc_id: r.root for r in merkle.fingerprints(spark.createDataFrame(edited, "doc_id long, text string")).collect()}
    got = merkle.fingerprints(with_clashes(d)).collect()
    assert len(got) == len(rows)
    assert sorted(r.edited_root for r in got) == sorted(whole.values())


# --- mixing


def test_capped_apportionment_equals_brute_force(spark):
    rng = random.Random(28)
    cases = [([1000, 1], [2, 1000], 1000), ([1000, 1], [500, 1000], 501), ([0, 0], [5, 5], 3), ([7], [3], 9)]
    for _ in range(120):
        m = rng.randint(1, 10)
        cases.append(([rng.choice([0, 1, rng.randint(1, 10), rng.randint(1, 10**6)]) for _ in range(m)], [rng.choice([0, 1, rng.randint(0, 20), rng.randint(0, 500)]) for _ in range(m)], rng.choice([0, rng.randint(0, 30), rng.randint(0, 900)])))
    rows, want = [], {}
    for g, (votes, caps, seats) in enumerate(cases):
        won = [0] * len(votes)
        for _ in range(seats):
            able = [i for i in range(len(votes)) if votes[i] and won[i] < caps[i]]
            if not able:
                break
            won[max(able, key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1  # noqa: B023
        for i, n in enumerate(won):
            rows.append((g, i, votes[i], seats, caps[i]))
            want[g, i] = n
    df = spark.createDataFrame(rows, "g int, k int, v long, seats long, cap long")
    assert {(r.g, r.k): r.s for r in mixing.sainte_lague(df, ["g"], "v", "seats", "cap", ["k"], "s").collect()} == want


def test_mixing_edges(spark, prose):
    with pytest.raises(ValueError):
        mixing.mix(prose, most=1.5)
    a, b = (sorted(tuple(r[c] for c in ("doc_id", "size", "taken")) for r in mixing.mix(x).collect()) for x in (prose, with_clashes(prose)))
    assert a == b
    assert len(a) == prose.count()


# --- near duplicates


def test_jaccard_skips_long_lists_by_position(spark):
    rng = random.Random(29)
    common_words = [f"c{k}" for k in range(30)]
    rows = []
    for i in range(260):  # one passage in all, so lists of its shingles are long; sizes and places differ
        own = [f"o{i}x{k}" for k in range(rng.choice([0, 1, 2, 3, 4, 8, 30]))]
        rows.append((i, " ".join(own + common_words) if i % 2 else " ".join(common_words + own)))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"slice_shingles": 200}):
        assert {r.doc_id: r.component_id for r in jaccard.join(with_clashes(d), **more).collect()} == {i: root(i) for i in sets}
    assert 10 < len({root(i) for i in sets}) < 250


def test_reach_and_stretches():
    rng = random.Random(30)
    size = np.array(sorted(rng.randint(5, 60) for _ in range(300)))
    place = np.array([rng.randint(0, s // 5) for s in size])
    far = jaccard.reach(size, place, 80, 100)
    token = np.repeat([1, 2, 3], 100)
    first = jaccard.stretches(token, size, far)
    stretch = np.searchsorted(first, np.arange(300), side="right")
    for i in range(300):
        for j in range(i):
            may = token[i] == token[j] and min(size[i] - place[i], size[j] - place[j]) * 180 >= 80 * (size[i] + size[j])
            assert not may or (stretch[i] == stretch[j] and far[i] >= size[j] and far[j] >= size[i])


def test_substring_hashes_are_compared_in_pairs():
    h = np.array([5, 5, 5, 7, 5], np.uint64)
    check = np.array([1, 2, 1, 1, 2], np.uint64)
    assert substring.repeated(h, check).tolist() == [False, False, True, False, True]
    links = substring._links([(0, 0, textkit.planes(np.array([5, 9], np.uint64), 6), None, textkit.planes(np.array([2, 4], np.uint64), 6))])
    assert substring._known(links, h, check).tolist() == [False, True, False, False, True]


# --- language model


def test_gradients():
    rng = np.random.default_rng(31)
    net = gru.Network({k: v.astype(np.float64) for k, v in gru.Network.start().p.items()})
    xs, ys = rng.choice([0, 3, 40, 900], (5, 2)), rng.choice([0, 3, 40, 900], (5, 2))
    start = rng.normal(0, 0.5, (2, gru.HIDDEN))

    def loss():
        table, h, total = net.inputs(), start, 0.0
        for x, y in zip(xs, ys, strict=True):
            h = net.step(table[x], np.where((x == gru.END)[:, None], 0, h))[0]
            total -= net.losses(h, y)[0].sum()
        return total

    grads, _ = net.backward(xs, ys, start)
    for name, v in net.p.items():
        flat, found = v.reshape(-1), grads[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(found), 6):
            kept = flat[i]
            flat[i] = kept + 1e-6
            high = loss()
            flat[i] = kept - 1e-6
            low = loss()
            flat[i] = kept
            assert abs((high - low) / 2e-6 - found[i]) < 1e-5 * max(1, abs(found[i])), name


def test_every_token_of_a_shard_is_trained_on(monkeypatch):
    seen, inner = [], gru.Network.backward
    monkeypatch.setattr(gru.Network, "backward", lambda self, xs, ys, *more: (seen.append(ys.ravel()), inner(self, xs, ys, *more))[1])
    ids = np.concatenate([np.arange(2, 1000), [0]])
    for lanes in (1, 32, 256, 1024):
        seen.clear()
        gru.Network.start().fit(ids, np.array([0, len(ids)]), epochs=1, lanes=lanes)
        assert set(np.concatenate(seen)) == set(ids), lanes


def test_scoring_memory_follows_the_tokens():
    net = gru.Network.start()
    ids = np.tile([5, 9, 40], 50_000)
    ids[-1] = 0
    tracemalloc.start()
    one = net.score(ids, np.array([0, len(ids)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(ids)
    short = net.score(np.concatenate([ids[-300:], ids]), np.array([0, 300, 300 + len(ids)]))
    assert np.allclose(short[1], one[0], rtol=1e-4)


def test_language_model_edges(spark, prose):
    odd = with_clashes(prose)
    got = gru.score(odd, F.col("doc_id") % 2 == 0)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    assert len(rows) == prose.count()
    assert len({(r.n_tokens, r.base_score) for r in rows if r.doc_id == 0}) == 1


def test_a_token_passes_few_logits():
    weight = 1e6 / np.arange(1, 65537)
    net = gru.Network.start(slots=65536, weight=weight)
    share, leaf = weight / weight.sum(), np.arange(65536) // net.fan
    below = np.where(leaf > 0, np.repeat(np.diff(net.cuts), np.diff(net.cuts))[leaf] + net.fan, 0)
    two_levels = 2 * np.sqrt(share).sum()  # the fewest with classes of words alone
    assert len(net.p["wc"]) + share @ below < two_levels / 2
    p = np.exp(net.losses(np.zeros((65536, gru.HIDDEN), np.float32), np.arange(65536))[0])
    assert np.allclose(p, share, rtol=1e-3)


def test_gradients_of_classes_by_weight():
    rng = np.random.default_rng(5)
    start = gru.Network.start(weight=1e4 / np.arange(1, 1025))
    for stretch in (1, 40):  # the larger logits need a shift
        net = gru.Network({k: v.astype(np.float64) * (stretch if k in ("wc", "wm", "wo") else 1) for k, v in start.p.items()}, start.cuts)
        h, y = rng.normal(0, 0.5, (60, gru.HIDDEN)), np.concatenate([rng.integers(0, 1024, 40), np.repeat([0, 9, 70, 1000], 5)])
        grads = {k: np.zeros_like(v) for k, v in net.p.items()}
        dh = net.losses(h, y, grads)[1]
        for v, found in ((h, dh), *((net.p[k], grads[k]) for k in ("wc", "wm", "wo"))):
            for i in rng.choice(np.flatnonzero(found), 12):
                kept = v.flat[i]
                v.flat[i] = kept + 1e-6
                high = net.losses(h, y)[0].sum()
                v.flat[i] = kept - 1e-6
                low = net.losses(h, y)[0].sum()
                v.flat[i] = kept
                assert abs((low - high) / 2e-6 - found.flat[i]) < 1e-4 * max(1, abs(found.flat[i]))


def test_few_rows_are_descended_and_gradients_used_up():
    v, g, m, s = np.ones((9, 4)), np.full((9, 4), 0.5), np.zeros((9, 4)), np.zeros((9, 4))
    gru.adam(v, g, m, s, np.array([2, 5]), 1, 0.1, 1)
    assert np.flatnonzero((v != 1).all(1)).tolist() == np.flatnonzero((g == 0).all(1)).tolist() == [2, 5]
    whole = [np.ones((9, 4)), np.full((9, 4), 0.5), np.zeros((9, 4)), np.zeros((9, 4))]
    gru.adam(*whole, None, 1, 0.1, 1)
    assert np.array_equal(whole[0][[2, 5]], v[[2, 5]]) and not whole[1].any()


def test_distinct_is_unique():
    for keys in (np.random.default_rng(2).integers(0, 2**64, 500, np.uint64)[np.arange(3000) % 500], np.zeros(0, np.uint64)):
        words, at = gru.distinct(keys)
        assert np.array_equal(words, np.unique(keys)) and np.array_equal(words[at], keys)


def test_windows_of_any_size_score_alike():
    rng = np.random.default_rng(6)
    size = np.concatenate([rng.integers(1, 40, 60), [3000, 1]])
    ids, ptr = rng.integers(0, 1024, size.sum()), np.cumsum([0, *size])
    net = gru.Network.start()
    whole = net.score(ids, ptr)
    for lanes, window in ((1, 7), (5, 64), (1024, 1000)):
        assert np.allclose(net.score(ids, ptr, lanes=lanes, window=window), whole, rtol=1e-4)


# --- urls


def test_url_edges(spark):
    rows = [(i, f"http://h{i % 4}.net/es/{i}") for i in range(40)] + [(50, "http://h0.net/x"), (50, "http://h0.net/x"), (51, "http://new.org/"), (52, None), *[(60 + i, f"http://www.shop{i}.com/") for i in range(40)]]
    d = spark.createDataFrame(rows, "page_id long, url string")
    plain = {(r.page_id, r.verdict) for r in urlfilter.judge(d).collect()}
    odd = d
    for c in ("host", "path", "rule", "bound", "suffix", "n", "bad", "_said"):
        odd = odd.withColumn(c, F.lit("x"))
    assert {(r.page_id, r.verdict) for r in urlfilter.judge(odd).collect()} == plain
    assert urlfilter.judge(d).count() == len(rows)
    assert (50, "block") in plain
    assert (51, "allow") in plain


# --- pipeline and shared folders


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path, prose):
    spark.createDataFrame([(1, "A."), (2, "Yes.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with_clashes(prose).write.parquet(f"{tmp_path}/documents.parquet")
    now = docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
        assert all(clashes_kept(r) for r in now.collect())
    assert now.count() > 100
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_folder(Fake, "checkpoints")
    Fake.sparkContext.master = "local[2]"
    assert common.shared_folder(Fake, "checkpoints")
