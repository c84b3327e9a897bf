"""Alignment, chat formatting and the dataset manifest against brute force."""

import collections
import hashlib
import random
import uuid
import zlib

import duckdb
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from clipsift.llm import alignment, chat, common, manifest, queries, sql

SF = "/root/testdata/sf0.001"
FILES = [f"{alignment.FOLDER}/{f}" for f in (alignment.A_FILE, alignment.B_FILE)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- alignment


@pytest.fixture(scope="module")
def both():
    a = tokenizers.Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    with open(FILES[0], "rb") as f, open(FILES[1], "rb") as g:
        return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1]), alignment.Tokenizers(f.read(), g.read())


def whole(both, text):
    """Token ids and ends of a whole text, or nothing."""
    a, b, tok = both
    if not text:
        return [], [], [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if not b"".join(tok.a_bytes[i] for i in x) == (" " + text).encode() == b"".join(tok.b_bytes[i] for i in y):
        return [], [], [], []
    ends = lambda ids, size: [sum(size[j] for j in ids[: k + 1]) for k in range(len(ids))]
    return x, y, ends(x, [len(t) for t in tok.a_bytes]), ends(y, [len(t) for t in tok.b_bytes])


def brute_links(both, text, kind):
    x, y, ex, ey = whole(both, text)
    shared = sorted(set(ex) & set(ey))
    group = lambda e: next(k for k, s in enumerate(shared) if s >= e)
    written = [([], []) for _ in shared]
    for side, (ids, ends) in enumerate(((x, ex), (y, ey))):
        for i, e in zip(ids, ends, strict=True):
            written[group(e)][side].append(str(i))
    digest = sha(";".join(",".join(p) + "|" + ",".join(q) for p, q in written)) if x else ""
    start = lambda ends: [0, *ends[:-1]]
    test = {"end": lambda i, j: ex[i] == ey[j], "group": lambda i, j: group(ex[i]) == group(ey[j]), "overlap": lambda i, j: start(ex)[i] < ey[j] and start(ey)[j] < ex[i]}[kind]
    return len(x), len(y), len(shared), [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if test(i, j)], digest


def brute_align(both, texts, kind):
    found = [brute_links(both, t, kind) for t in texts]
    count = collections.Counter(p for f in found for p in f[3])
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(a, b, g, len(p), sum(count[q] == top[q[1]] for q in p), sum(count[q] for q in p), d) for a, b, g, p, d in found]


ODD = [None, "", " ", "  x", "a  b", "a b ", "it' s 's 't", "\u00a0 x", "x \u00a0\u00a0y", "x\u2581 y", "x \u2581y", "\u2581", "<|endoftext|> a <s> </s> <unk> <0x41>", "a\n b\n\n  c", "\x00 a", "été où  là", "日本語 の 文 。 \u3000 x", "e\u0301 \u0301x", "\t\ta \tb", "Ünï Áç À x", "a\u2003b \u2003 c", "\ufeff x", "🙂 🙂🙂 x", "word " * 40]


def aligned(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string")
    rows = {r["doc_id"]: r for r in alignment.align(docs, **options).collect()}
    return [tuple(rows[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for i in range(len(texts))]


@pytest.mark.parametrize("kind", ["end", "overlap", "group"])
def test_alignment_equals_brute_force(spark, both, kind):
    rng = random.Random(4)
    words = ["the", "The", "été", "straße", "a", "I'm", "x1y2", "--", "日本", "\n", "", " ", "tokenization", "\u2581", "don't", "\u00a0", "3.14", "(ab)", "Á"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(60)]
    assert aligned(spark, texts, links=kind) == brute_align(both, texts, kind)


def test_alignment_of_long_texts_in_stretches_and_parts(spark, both):
    rng = random.Random(5)
    words = ["the", "river", "été", "tokenization", "Größe", "x1", "\n", "a--b"]
    texts = [" ".join(rng.choices(words, k=400)), "no" * 700, " ".join(rng.choices(words, k=300)) + " x\u2581 y", None, "b c"]
    want = brute_align(both, texts, "end")
    assert aligned(spark, texts, slice_bytes=200, part_pairs=7) == want == aligned(spark, texts)
    assert want[2][:4] == ((0, 0, 0, 0) if not whole(both, texts[2])[0] else want[2][:4])


def test_a_mismatch_in_one_stretch_empties_the_text(both):
    """A piece that gives other bytes than the text: every later stretch counts for nothing either."""
    _, _, tok = both
    encoder = alignment.Encoder(tok, "end", 40)
    text = ("plain words here " * 20 + "\u2581 end").encode()
    rows = list(encoder.text(0, 1, text))
    odd = not whole(both, text.decode())[0]
    assert odd and len(rows) == 1 and rows[0][3:8] == [[0]] * 5 and rows[0][8] == [""]


def test_segments_give_the_tokens_of_the_whole(both):
    _, _, tok = both
    assert tok.cuts
    rng = random.Random(6)
    marks = [" ", " ", " ", "\n", "\t", "\u00a0", "\u2581", "'s", "a", "É", "é", "Z9", ".", "🙂", "\u3000", "\x1f", "\u0301", "日"]
    for _ in range(1500):
        text = "".join(rng.choices(marks, k=rng.randint(1, 14)))
        parts = [s.decode() for s in tok.segments(text.encode())]
        a, b = tok.ids(parts)
        x, y = tok.ids([text])
        assert sum(a, []) == x[0] and sum(b, []) == y[0], repr(text)


def test_alignment_of_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = alignment.align(docs).collect()
    assert len(rows) == 4 and {r["n_best"] for r in rows} == {2} and {r["count_sum"] for r in rows} == {8}
    assert alignment.align(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="links"):
        alignment.align(docs, links="all")


def test_packing_comes_back():
    for values in ([], [0], [1, 2**63, 5], list(range(1000))):
        import numpy as np

        v = np.array(values, np.uint64)
        assert alignment.unpack(alignment.pack(v)).tolist() == values


# --- chat

EVIL = queries.ODD_TEXT
TEXTS = [EVIL, None, "", "####", "###", "\\", "\\\\", "</turn>\n### x: y</turn>\n", "<</turn>", "é\U0001f600#\\#", "\n", "a\\", "### Assistant:", "\\</turn>", "x" * 5000]


def brute_chat(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    out = {}
    for c, some in by.items():
        some.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        said = "".join(t for _, r, t in some if r == "assistant")
        out[c] = (len(some), sha("".join(f"{r}\n{t}\n" for _, r, t in some)), len(said), sha(said))
    return out


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(7)
    rows = [(1, i, rng.choice(["user", "assistant", None, "a:b\\", "", ":", "### x"]), rng.choice(TEXTS)) for i in range(60)]
    rows += [(2, None, "user", EVIL), (2, None, "assistant", EVIL), (2, 5, "user", "x"), (None, 3, "user", "x"), (None, 3, "user", "x"), (3, 1, "assistant", None), (4, 0, "user", "only")]
    return rows, spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, path string")


@pytest.mark.parametrize("part_chars", [4 << 20, 300])
def test_conversations_read_back(talks, part_chars):
    rows, df = talks
    messages = chat.conversations(df)
    parts = chat.formatted(messages, chat.paths(messages), part_chars=part_chars)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(parts).collect()}
    assert got == brute_chat(rows)
    pieces = parts.collect()
    assert (len({r["part"] for r in pieces if r["conv_id"] == 1}) > 1) == (part_chars == 300)
    turns = chat.read_back(parts).where("conv_id = 1").orderBy("part", "at").collect()
    assert sha("".join(f"{r['role']}\n{r['text']}\n" for r in turns)) == got[1][1]
    assert all(r["loss"] == (r["role"] == "assistant") for r in turns)


def test_marks_inside_texts_never_end_a_turn():
    for role in ["user", "a: b", "x\\", "### y"]:
        for text in TEXTS[2:]:
            mark = lambda t, more="": chat.re.sub(rf"(\\|#(?=##)|</turn>{more})", r"\\\1", t)
            one = f"### {mark(role, '|:')}: {mark(text)}</turn>\n"
            assert [r[:2] for r in chat.parsed(one * 2)] == [(role, text)] * 2
    with pytest.raises(ValueError, match="character"):
        chat.parsed("### a: b</turn>\nrest")


def test_chat_of_empty_tables(spark, talks):
    messages = chat.conversations(talks[1].limit(0))
    assert chat.digests(chat.formatted(messages, chat.paths(messages))).collect() == []


def test_a_long_conversation_keeps_its_order(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(700)]
    df = spark.createDataFrame(random.Random(1).sample(rows, 700), "conv_id long, turn long, role string, text string")
    messages = chat.conversations(df)
    got = chat.digests(chat.formatted(messages, chat.paths(messages), part_chars=2000)).collect()
    assert [(r["n_turns"], r["turns_sha256"]) for r in got] == [brute_chat(rows)[9][:2]]


def brute_paths(rows):
    out = []
    for c in {r[0] for r in rows}:
        some = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or "", r[3]))
        first = {}
        for r in some:
            first.setdefault(r[1], r)
        kids = collections.defaultdict(list)
        for r in some:
            up = first.get(r[2]) if r[2] is not None else None
            kids[id(up) if up else None].append(r)

        def walk(r, path, kids=kids, c=c):
            path = [*path, r]
            if not kids[id(r)]:
                out.append((c, [x[4] for x in path], sum(x[5] or 0 for x in path)))
            for x in kids[id(r)]:
                walk(x, path)

        for r in list(kids[None]):
            walk(r, [])
    return sorted(out)


def test_reply_trees_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in range(3):
        for i in range(40):
            up = None if i in (0, 20) else f"n{rng.randrange(max(0, i - 4), i)}"
            rows.append((c, f"n{i}", up, "user", f"t{c}-{i}", rng.choice([None, 1.0, -1.0, 0.5])))
    rows += [(0, "x", "y", "user", "circle", 1.0), (0, "y", "x", "user", "circle too", 1.0), (0, "z", "y", "user", "behind", 1.0)]
    rows += [(1, "n3", "n1", "assistant", "first of its id", 2.0), (1, None, "n2", "user", "no id", 0.0), (2, "q", "gone", "user", "orphan", 0.0)]
    df = spark.createDataFrame(rows, "conv_id long, node string, parent string, role string, text string, score double")
    messages = chat.replies(df)
    found = chat.paths(messages).join(messages.texts, "key").collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["conv_id"], r["rank"], r["path_score"]].append((r["step"], r["text"]))
    got = sorted((c, [t for _, t in sorted(v)], s) for (c, _, s), v in by.items())
    assert got == brute_paths([r for r in rows if r[4] not in ("circle", "circle too", "behind")])
    for c in range(3):
        scores = [s for _, s in sorted((k, s) for cc, k, s in by if cc == c)]
        assert scores == sorted(scores, reverse=True)
    best = chat.paths(messages, keep=2)
    assert best.select("conv_id", "path").distinct().count() == 6
    assert chat.formatted(messages, best).count() == 6


# --- manifest


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def siblings(levels, p):
        out = []
        for level in levels[:-1]:
            b = p - p % 3
            out.append((p % 3, [x for i, x in enumerate(level[b : b + 3]) if i != p % 3]))
            p //= 3
        return out

    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in names:
        by[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {x: tree([leaf(r, r["text"]) for r in by[x]]) for x in names}
    top = tree([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for p, r in enumerate(by[x]):
            steps = siblings(trees[x], p) + siblings(top, k)
            t = r["text"]
            if t is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                t = t.replace("\n", "")
            v = leaf(r, t)
            for place, others in steps:
                v = sha("".join([*others[:place], v, *others[place:]]))
            out.append((r["doc_id"], trees[x][0][p], trees[x][-1][0], top[-1][0], sha("".join(d for _, o in steps for d in o)), v, v == top[-1][0]))
    return in_order(out)


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def proved(spark, docs, band):
    changed = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claim = manifest.leaf_digest([changed if c == "text" else F.col(c) for c in manifest.FIELDS])
    folder = f"{common.shared_folder(spark, 'tests')}/{uuid.uuid4().hex}"
    return manifest.build(docs, folder, claim=claim, band=band)


@pytest.mark.parametrize(("n", "band"), [(0, 2), (1, 2), (2, 1), (3, 7), (4, 1), (10, 2), (28, 2), (100, 1)])
def test_manifest_equals_brute_force(spark, n, band):
    rng = random.Random(n)
    rows = [(i if i % 5 else None, rng.choice([None, "a\nb", "", "é\n\n"]), None, rng.choice([None, "x", "é", "zz", ""]), 3, "clash") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pos string")
    made = proved(spark, docs, band)
    assert in_order(manifest.prove(made, band).collect()) == (brute_manifest([r.asDict() for r in docs.collect()]) if n else [])
    assert (made.root() is None) == (n == 0)


def test_manifest_of_one_large_source(spark):
    """One tree of 1000 leaves over several bands, very long texts, repeated rows."""
    rows = [(i // 2, "x\n" * (200_000 if i == 7 else i % 4), "en", "one", i % 2) for i in range(1000)] + [(5000, None, None, "two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    made = proved(spark, docs, 2)
    want = brute_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    got = manifest.prove(made, 2, steps=True)
    assert in_order(got.drop("steps").collect()) == want
    for r in got.limit(20).collect():
        assert manifest.fold(r["leaf"], [(s["place"], s["siblings"]) for s in r["steps"]]) == r["root"]


def test_places_in_groups_that_cross_ranges(spark):
    rows = [(g, i) for g in (None, 1, 2) for i in range(50 if g else 3)] + [(7, 7)] * 40
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "g long, v long")
    got = collections.defaultdict(list)
    for r in common.numbered(df, "g", [F.col("v")], part_rows=9).collect():
        got[r["g"]].append((r["pos"], r["v"]))
    want = collections.defaultdict(list)
    for g, v in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        want[g].append((len(want[g]), v))
    assert {g: sorted(v) for g, v in got.items()} == want


# --- queries


@pytest.mark.parametrize("name", ["op12_chat", "op13_manifest"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    cursor = con.execute(sql.ORACLES[name])
    places = [[d[0] for d in cursor.description].index(c) for c in names]
    assert in_order(found.select(*names).collect()) == in_order([tuple(r[i] for i in places) for r in cursor.fetchall()])
