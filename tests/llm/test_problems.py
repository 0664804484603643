"""Each operator against brute force or an exact round trip on small inputs, with the awkward cases."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from larkspan.llm import aqknn, bpe, langid, maincontent, mixing, neardup, queries, sitelines, splitting, subjects


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, spark, data, duck):
    ours, theirs = same_rows(queries.queries()[name](spark, data), duck, queries.oracle_sql()[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(name, spark, data):
    df = queries.queries()[name](spark, data)
    assert df.count() == df.distinct().count()


# ---------------------------------------------------------------- 1


def brute_neighbours(rows, k, least):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 4 and not any(x is None or not math.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, x in good:
        near = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), j) for j, y in good if j != i)
        out |= {(i, j) for c, j in near[:k] if -c >= least}
    return out


def vectors(n=120, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 4, 4))
    rows = [(i, [float(np.float32(x)) for x in centres[i % len(centres)] + rng.normal(size=4) * 0.1]) for i in range(n)]
    rows += [(1000, None), (1001, [0.0] * 4), (1002, [float("nan")] * 4), (1003, [1.0]), (1004, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(2000 + i, rows[0][1]) for i in range(9)] + [(3000, [2 * x for x in rows[0][1]]), rows[5]]
    return rows


def test_neighbours(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("clash")).withColumn("v", F.lit(None).cast("string"))
    got = {(r["vec_id"], r["neighbour"]) for r in aqknn.nearest(df, k=3, least=0.9, dimensions=4).collect()}
    true = brute_neighbours(dict(rows).items(), 3, 0.9)
    # among equal vectors any order of the last bits is right: compare the number of neighbours and the recall
    assert len(got & true) >= 0.95 * len(true) and len(got) == len(true)
    assert all(a != b and a < 1000 or 2000 <= a for a, b in got)


def test_every_vector_has_its_nearest_without_a_floor(spark, data, monkeypatch):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 64 and np.isfinite(np.array(v, float)).all() and any(v)}
    keys, x = np.array(sorted(good)), np.stack([good[i] for i in sorted(good)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    true = {(int(keys[i]), int(keys[j])) for i in range(len(keys)) for j in np.argsort(-cosine[i], kind="stable")[:5]}
    for block in (aqknn.BLOCK, 40):
        monkeypatch.setattr(aqknn, "BLOCK", block)
        got = {(r["vec_id"], r["neighbour"]) for r in queries.p1_embeddings(spark, data).collect()}
        assert len(got) == len(true) == 5 * len(keys) and len(got & true) >= 0.999 * len(true)


def test_all_neighbours_of_a_crowd(spark, monkeypatch):
    rng = np.random.default_rng(11)
    centre = rng.normal(size=64)
    x = np.concatenate([centre + rng.normal(size=(1500, 64)) * 0.2, rng.normal(size=(1500, 64))]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    true = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-cosine[i])[:5] if cosine[i, j] >= 0.9}
    assert len(true) > 7000
    monkeypatch.setattr(aqknn, "BLOCK", 500)
    for crowded in (aqknn.CROWDED, 400):
        monkeypatch.setattr(aqknn, "CROWDED", crowded)
        got = {(r["vec_id"], r["neighbour"]) for r in aqknn.nearest(df).collect()}
        print("crowd", crowded, len(true), len(got), len(got & true))
        assert len(got & true) >= 0.95 * len(true)


def test_no_usable_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0] * 4)], "vec_id long, embedding array<float>")
    assert aqknn.nearest(df, dimensions=4).count() == 0
    assert aqknn.nearest(df.limit(0), dimensions=4).count() == 0


def test_crowds_are_searched_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    x = aqknn.unit(np.concatenate([rng.normal(size=(500, 16)), rng.normal(size=(1, 16)) + np.zeros((1500, 16))]))
    monkeypatch.setattr(aqknn, "CROWDED", 400)
    codec = aqknn.plan(aqknn.train(x), x, len(x))
    assert codec.crowds
    codes, cells = codec.encode(x)
    rows, names, asking = codec.blocked(np.arange(len(x)), *codec.filed(cells))
    asked = {}
    for r, n, a in zip(rows, names, asking):
        if n < 0 and a:
            asked.setdefault(int(r), set()).add(int(n))
    members = {int(r) for r, n in zip(rows, names) if n < 0}
    assert members and members == set(asked)
    # whoever asks in a block meets every other member of the crowd there
    crowd = len(codec.crowds)
    blocks = {}
    for r, n in zip(rows, names):
        if n < 0:
            blocks.setdefault(int(n), set()).add(int(r))
    for c, k in codec.crowds.items():
        mine = [blocks[-(c * k + i) - 1] for i in range(k)]
        assert all(b == mine[0] for b in mine)
    assert crowd >= 1


def test_recall_of_deeper_cells(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 64))
    x = aqknn.unit(np.concatenate([base, base[:600] + rng.normal(size=(600, 64)) * 0.25]))
    for cell in (600, 20):
        monkeypatch.setattr(aqknn, "CELL", cell)
        codec = aqknn.plan(aqknn.train(x), x, len(x))
        codes, cells = codec.encode(x)
        rows, names = codec.filed(cells)
        found = set()
        for c in np.unique(names):
            at = rows[names == c]
            i, j = codec.near(codes[at], np.ones(len(at), np.int8), 0.9 - aqknn.SLACK)
            found |= {(min(a, b), max(a, b)) for a, b in zip(at[i].tolist(), at[j].tolist())}
        true = [(i, 3000 + i) for i in range(600) if x[i] @ x[3000 + i] >= 0.9]
        assert len(true) > 300 and sum(p in found for p in true) >= 0.95 * len(true)


# ---------------------------------------------------------------- 2


def shingles(text, k):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= 30 else None


def near_copies(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(30, 160))]
        texts.append(" ".join(t))
        for _ in range(rng.randint(0, 3)):
            u = list(t)
            for _ in range(rng.randint(0, 8)):
                u[rng.randrange(len(u))] = rng.choice(words)
            if rng.random() < 0.3:
                u = u[10:] + u[:10]
            texts.append(" ".join(u))
    texts += ["same words here again and again " * 6] * 130
    return [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "too short"), (9003, "ß Ünï " * 20)]


@pytest.mark.parametrize("monkey", [False, True])
def test_near_copies(spark, monkeypatch, monkey):
    rows = near_copies()
    if monkey:  # every token is split into blocks, copies are written as stars
        monkeypatch.setattr(neardup, "HOT", 0)
        monkeypatch.setattr(neardup, "BLOCK", 3)
    df = spark.createDataFrame(rows, "rec_id long, text string").withColumn("key", F.lit(1)).withColumn("size", F.lit("x"))
    members, links = neardup.similar_classes(df, k=3, threshold=0.7)
    got = {(r["rec_a"], r["rec_b"]) for r in neardup.pairs(members, links, expand=200).collect()}
    sets = {i: s for i, t in rows if (s := shingles(t, 3)) is not None}
    true = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-9}
    assert got == true
    star = {(r["rec_a"], r["rec_b"]) for r in neardup.pairs(members, links, expand=100).collect()}
    copies = [i for i, t in rows if t and t.startswith("same words")]
    assert star <= true and {(copies[0], c) for c in copies[1:]} <= star and len(star) < len(true)
    groups = {r["rec_id"]: r for r in neardup.groups(members, links).collect()}
    assert set(groups) == set(sets)
    for a, b in true:
        assert groups[a]["group_id"] == groups[b]["group_id"]
    assert all(r["group_id"] <= i for i, r in groups.items())


def test_no_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "short")], "rec_id long, text string")
    members, links = neardup.similar_classes(df)
    assert members.count() == 0 and neardup.pairs(members, links).count() == 0 and neardup.groups(members, links).count() == 0


def test_asking_for_more_matches_pays():
    assert neardup.matches_to_ask(np.full(100, 50.0), 100, 70) > 1
    assert 1 <= neardup.matches_to_ask(np.array([1.0, 1e9, 1e9]), 3, 2) <= 2


def test_long_chains_are_one_group(spark):
    order = [1, *range(70, 1, -1)]
    shuffled = list(range(1000, 1400))
    random.Random(4).shuffle(shuffled)
    edges = [(min(e), max(e), 0.8) for c in (order, shuffled) for e in zip(c, c[1:])]
    members = spark.createDataFrame([(i, i) for i in [*order, *shuffled, 5000]], "key long, class_id long")
    got = {r["rec_id"]: r["group_id"] for r in neardup.groups(members, spark.createDataFrame(edges, "a long, b long, similarity double")).collect()}
    assert got == {**dict.fromkeys(order, 1), **dict.fromkeys(shuffled, 1000), 5000: 5000}


# ---------------------------------------------------------------- 3


def test_site_lines(spark):
    rows = [(i, "WWW.Site.example", None, f"Share  THIS page 12\nown {'x' * i}\n\nshare this page 7") for i in range(8)]
    rows += [(100 + i, None, "https://user@Other.example:80/x", "Once\nrare") for i in range(7)] + [(107, " ", "http://www.other.example/y", "once \nmore"), (200, None, "file:///x", "share this page 1"), (201, "site.example", None, None), (202, None, None, "once")]
    df = spark.createDataFrame([(a, b, c, d, "extra") for a, b, c, d in rows + rows[:1]], "rec_id long, domain string, url string, text string, src string")
    got = sorted((r["rec_id"], r["line_no"]) for r in sitelines.repeated_lines(df).collect())
    assert got == sorted([(i, n) for i in range(8) for n in (0, 3)] + [(100 + i, 0) for i in range(8)])
    clean = {r["rec_id"]: r["clean_text"] for r in sitelines.remove_repeated_lines(df).collect()}
    assert clean[3] == "own xxx\n" and clean[107] == "more" and clean[200] == "share this page 1" and clean[201] is None
    assert sitelines.repeated_lines(df.limit(0)).count() == 0


def test_site_lines_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, "s.example", "", f"menu\nown {i}\nmenu") for i in range(9)] + [(50, None, None, "menu")]
    df = spark.createDataFrame(rows, "rec_id long, domain string, url string, text string")
    small = {r["rec_id"]: r["clean_text"] for r in sitelines.remove_repeated_lines(df).collect()}
    monkeypatch.setattr(sitelines, "BROADCAST_ROWS", -4)
    assert {r["rec_id"]: r["clean_text"] for r in sitelines.remove_repeated_lines(df).collect()} == small
    assert small[50] == "menu"


# ---------------------------------------------------------------- 4


@pytest.fixture(scope="module")
def model(spark, data):
    return langid.train(spark.read.parquet(f"{data}/lang_samples.parquet"))


def test_held_out_sentences(spark, data):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{data}/lang_samples.parquet").orderBy("sample_id").collect()]
    random.Random(4).shuffle(rows)
    m = langid.Model(rows[: 3 * len(rows) // 4])
    rest = rows[3 * len(rows) // 4 :]
    right = [m.languages[b] == lang for b, (lang, _) in zip(m.best(m.scores([t for _, t in rest])[0]), rest)]
    assert np.mean(right) >= 0.93


def test_labels(spark, data, model):
    text = {r["lang"]: r["t"] for r in spark.read.parquet(f"{data}/lang_samples.parquet").groupBy("lang").agg(F.concat_ws(" ", F.slice(F.sort_array(F.collect_list("text")), 1, 4)).alias("t")).collect()}
    rows = [(1, text["de"], "de"), (2, text["de"], "DE-at"), (3, text["de"], "fr"), (4, text["fr"], None), (5, text["fr"], "xx"), (6, f"{text['en']}\n\n{text['ru']}\n{text['en']}", "en"), (7, None, "en"), (8, "", None), (9, "12 34", "de"), (10, text["ja"] * 50, " ")]
    df = spark.createDataFrame(rows, "rec_id long, text string, language string").withColumn("rec", F.lit(0))
    got = {(r["rec_id"], r["line_no"], r["lang"]) for r in langid.wrong_labels(df, model, ["de", "fr", "en", "ru", "ja"]).collect()}
    assert got == {(3, -1, "de"), (4, -1, "fr"), (5, -1, "fr"), (6, 0, "en"), (6, 2, "ru"), (6, 3, "en"), (10, -1, "ja")}
    whole = {r["rec_id"]: r for r in langid.identify(df, model).filter("line_no = -1").collect()}
    assert len(whole) == len(rows) and whole[7]["lang"] is None and whole[9]["confidence"] == 0.0 and whole[1]["confidence"] > 0.5
    assert langid.wrong_labels(df.limit(0), model, ["de"]).count() == 0


# ---------------------------------------------------------------- 5

BODY = "A paragraph, with commas, that runs on for a good while so that it counts as running text, and then some more of it."
PAGE = f"""<html><head><title>t</title><style>p {{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="sidebar"><h1>Title &amp; more</h1><div><p>By Someone</p></div><p>{BODY}</p><p>{BODY} Again.<ul><li>one item</li></ul>
<div class=x><span>Advertisement</span></div><pre>a = 1
b = 2</pre><blockquote>Quoted words.</blockquote><h2>Part</h2><p>{BODY} Third.</div>
<div><h3>Comments</h3><p>Nice page.</p></div><footer><p>© Somebody, all rights reserved, somewhere, always.</p></footer></body></html>"""


def test_main_content(spark):
    text = f"Home\nTitle & more\nBy Someone\n{BODY}\n{BODY} Again.\none item\nAdvertisement\na = 1\nb = 2\nQuoted words.\nPart\n{BODY} Third.\nComments\nNice page.\n© Somebody, all rights reserved, somewhere, always."
    rows = [(1, PAGE, text), (2, None, text), (3, PAGE, None), (4, " ", text), (5, "no tags at all", "no tags at all"), (6, "<p><div></b></table>", "x"), (7, "<h1>Only</h1>", "Only"), (8, "<div>" * 3000 + BODY + "</div>" * 3000, BODY)]
    df = spark.createDataFrame(rows, "rec_id long, html string, text string").withColumn("main", F.lit("x"))
    got = sorted((r["rec_id"], r["line_no"]) for r in maincontent.main_lines(df).collect())
    assert [n for i, n in got if i == 1] == [1, 3, 4, 5, 7, 8, 9, 10, 11]
    assert {i for i, _ in got} <= {1, 5, 7, 8} and (7, 0) in got
    main = {r["rec_id"]: r["main_text"] for r in maincontent.with_main_text(df).collect()}
    assert main[1].startswith("Title & more") and "Advertisement" not in main[1] and main[2] is None and main[4] is None


# ---------------------------------------------------------------- 6


def test_pieces_put_together_are_the_text():
    rng = random.Random(8)
    space = re.compile(f"[{splitting.WS}]")
    for _ in range(600):
        limit, overlap = rng.choice([(20, 0), (20, 5), (50, 10)])
        text = "".join(rng.choice("aaaabbc  \n.!。　 ") if rng.random() < 0.95 else rng.choice(["x" * rng.randint(1, 80), " " * 40, "\n\n\n", ". "]) for _ in range(rng.choice([0, 30, 400])))
        pieces = splitting.split(text, limit, overlap)
        assert "".join(text[a:b] for a, b, _, _ in pieces) == text
        if len(text) > limit:
            assert all(b - a + c <= limit and c <= overlap for a, b, c, _ in pieces)
            longest = max(map(len, re.split(f"[{splitting.WS}]+", re.sub("([。！？])", r"\1 ", text))))
            assert (longest > limit) == any(level == "character" for *_, level in pieces)
            if longest <= limit:
                assert all(a == 0 or space.match(text[a - 1]) or text[a - 1] in "。！？" or space.match(text[a]) for a, _, _, _ in pieces)


def test_splitting(spark):
    rows = [("d#0", "d", 0, "short"), ("d#1", "d", 1, "word " * 500), ("d#1", "d", 1, "word " * 500), ("d#2", "d", 2, "z" * 2500), ("e#0", "e", 0, None), ("f#0", None, None, ""), ("g#0", "g", 0, "k" * 1001)]
    df = spark.createDataFrame(rows, "chunk_key string, doc_id string, chunk_idx int, chunk_text string").withColumn("n", F.lit(1)).withColumn("idx", F.lit(2))
    assert {(r[0], r[1]) for r in splitting.oversized(df).collect()} == {("d#1", "soft"), ("d#2", "hard"), ("g#0", "hard")}
    got = splitting.renumber(splitting.split_oversized(df)).collect()
    d = sorted((r["new_chunk_idx"], r["chunk_key"]) for r in got if r["doc_id"] == "d")
    assert [i for i, _ in d] == list(range(len(d))) and d[0][1] == "d#0" and d[-1][1] == "d#2"
    assert {r["chunk_key"] for r in got} == {r[0] for r in rows}
    assert splitting.oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, limit=10, overlap=10)


# ---------------------------------------------------------------- 7


def test_encoding_equals_the_library(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    rng = random.Random(6)
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    texts += ["".join(rng.choice("abAB 12 \n\téüß中文日本ñ's.,!?-_“😀​") for _ in range(rng.choice([3, 40, 200]))) for _ in range(300)]
    texts += ["a" * 3000, "aab" * 2000, None, "", "  ", "<|endoftext|>", "x" * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(0))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert all(got[i] == w.ids for i, w in enumerate(want)) and got[texts.index("")] == []
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.with_token_count(df, ["doc_id"]).collect()} == {i: len(w.ids) for i, w in enumerate(want)}


def test_neighbours_are_compatible_exactly_when_merging_keeps_them():
    b = bpe.bpe(open(bpe.TOKENIZER, "rb").read())
    words = {i: w for w, i in b.vocab.items()}
    rng = random.Random(1)
    left, right = (np.array([rng.choice(list(words)) for _ in range(1500)]) for _ in range(2))
    ok = b.compatible(left, right)
    assert all(o == (b.merge(words[x] + words[y]) == [x, y]) for o, x, y in zip(ok, left.tolist(), right.tolist()))


# ---------------------------------------------------------------- 8


def test_cut_off_means():
    for rate, cap in itertools.product([0.01, 0.4, 0.99, 1.7, 3.9], [1, 2, 4, 50]):
        if rate < cap:
            at = mixing.steps(rate, cap)
            assert len(at) == cap and abs(sum(1 - x for x in at) - rate) < 1e-6
    assert mixing.steps(2.0, 2) == [0.0, 0.0]


def test_mixture(spark):
    rows = [(i, "big" if i % 10 else "small", "some words of text " * (1 + i % 3)) for i in range(4000)] + [(9001, None, "x"), (9002, "other", "x"), (9003, "big", None), (9004, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("mix", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("absent", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets)
    got = mixed.collect()
    assert {r["source"] for r in got} == {"big", "small"} and max(r["copy_no"] for r in got) <= 3 and mixed.columns[:3] == docs.columns[:3]
    report = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    assert abs(report["big"]["actual_share"] / report["small"]["actual_share"] - 5 / 3) < 0.2
    assert report["absent"]["tokens"] == 0 and report["small"]["at_most_repeats"] and report["small"]["most_copies"] == 3
    assert sum(r["n_tokens"] for r in got) == sum(r["tokens"] for r in report.values())
    assert sorted(map(tuple, mixing.mix(docs.repartition(7), targets).select("doc_id", "copy_no").collect())) == sorted((r["doc_id"], r["copy_no"]) for r in got)
    over = {r["source"]: r for r in mixing.shares(docs, targets, total_tokens=10**9).collect()}
    assert over["big"]["at_most_repeats"] and over["big"]["copies"] == 2 * over["big"]["source_docs"]
    assert mixing.mix(docs.limit(0), targets).count() == 0


# ---------------------------------------------------------------- 9


def test_subjects(spark):
    names = ["cooking", "law"]
    labelled = [(i, "The broth and the garlic are ready. Add the butter to the sauce.", "cooking") for i in range(6)] + [(100 + i, "The court heard the plaintiff. The verdict followed the appeal.", "law") for i in range(6)]
    rows = [(i, t) for i, t, _ in labelled] + [(500, None), (501, ""), (502, "\n \n"), (503, "The garlic is here. Nothing else. Nobody came. We left. All was quiet."), (504, "The court met. The broth was hot.\nThe verdict came! The garlic burned."), (505, "garlic. " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("subject", F.lit("x")).withColumn("n", F.lit(1))
    labels = spark.createDataFrame([(i, s, "a") for i, _, s in labelled] + [(0, "cooking", "b"), (7777, "law", "a"), (1, "unknown", "a"), (503, "none", "a")], "doc_id long, subject string, annotator string")
    lex = subjects.fit(docs, labels, names)
    got = {}
    for r in subjects.assign(docs, lex).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert got[0] == {"cooking"} and got[100] == {"law"} and got[504] == {"cooking", "law"} and got[505] == {"cooking"}
    assert not {500, 501, 502, 503} & set(got)
    bare = subjects.fit(docs, labels.limit(0), names)
    assert ("cooking" in {r["subject"] for r in subjects.assign(docs.filter("doc_id = 0"), bare).collect()}) and subjects.assign(docs.limit(0), bare).count() == 0


def test_set_phrases_are_neutral():
    docs = [(f"a level playing field in case {i}", set()) for i in range(12)] + [(f"the magnetic field of probe {i}", {0}) for i in range(12)] + [(f"the field of corn {i} grew", {0}) for i in range(20)]
    terms = subjects.learn(["science"], docs)
    lex = subjects.Lexicon(["science"], terms)
    assert lex.score(subjects.sentences("a level playing field here")).sum() == 0 and lex.score(subjects.sentences("the magnetic field here")).sum() > 0


def test_subjects_are_counted_over_all_documents(spark):
    names = ["cooking", "law"]
    rows = [(f"the broth and the garlic of pot {'abcdefgh'[i % 8]}", ["cooking"]) for i in range(30)] + [(f"the verdict of court {'abcdefgh'[i % 8]} with zorbal", ["law"]) for i in range(20)] + [("a verdict on broth", ["cooking", "law", "other"]), ("", []), ("so it goes", [])]
    marked = spark.createDataFrame(rows, "t string, ls array<string>").repartition(5)
    want = subjects.learn(names, [(t, {names.index(x) for x in ls if x in names}) for t, ls in rows])
    for room in (1, 20, 10**6):
        assert subjects.chosen_terms(subjects.counted(marked, names, room=room), names) == want
    assert "zorbal" in want
    # a word of three documents among 12,000 that no label covers
    docs = spark.range(12_000).selectExpr("id as doc_id", "case when id % 4000 = 7 then concat('The court heard the zorbal. The verdict followed on day ', id) else concat('We walked home on day ', id) end as text")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    assert "zorbal" in subjects.fit(docs, labels, names).terms


def test_subject_thresholds_come_from_all_labels(spark):
    lex = subjects.Lexicon(["law"], {"court": (0, 0.6), "verdict": (0, 2.2)})
    known = spark.createDataFrame([("the court", [])] * 90 + [("the verdict", ["law"])] * 60 + [("", ["law", "law"])], "t string, ls array<string>").repartition(4)
    assert list(subjects.calibrate(lex, known)) == [0.8]
    assert list(subjects.calibrate(lex, known.limit(0))) == [subjects.USUAL]


def test_copies_of_a_text_are_one_piece_of_evidence(spark):
    rows = [(i, f"The court met {w}. The verdict followed.") for i, w in enumerate(["mabvervin"] + ["today"] * 3 + ["again", "at once"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    copied = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 100)).unionAll(docs.withColumn("doc_id", F.col("doc_id") + 200))
    terms = subjects.fit(docs, labels, ["cooking", "law"]).terms
    assert "mabvervin" not in terms and subjects.fit(copied, labels, ["cooking", "law"]).terms.keys() == terms.keys()
