import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.functions import vectors as V
from larkspan.operators import chunking, crawl, history, ingest, search, semantic
from larkspan.sources import files, imports

NOW = 1_735_689_600
DOC = "rec_id long, id string, url string, domain string, title string, text string, html string, added long, updated long, type int, language string, user_id long, label string, add_count long, metadata map<string,string>, ingested_at timestamp"


def doc(i, **kw):
    base = {"rec_id": i, "id": f"u{i}", "url": f"https://s{i}.example/", "domain": f"s{i}.example", "title": f"title {i}", "text": "some words", "html": None, "added": 10, "updated": 100 + i, "type": 0, "language": "en", "user_id": 0, "label": None, "add_count": 1, "metadata": {}, "ingested_at": None}
    return tuple((base | kw).values())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [doc(1, text="Go is fun"), doc(2, title=None, text=None, domain=None, metadata=None, add_count=None), doc(3, text="go-fun GO", user_id=1), doc(4, text="", title="fun go"), doc(5, id="u4", text="", title="older", updated=1)]
    return spark.createDataFrame(rows, DOC)


def found(docs, text, **kw):
    return sorted(r["rec_id"] for r in search.matching(search.current(docs), search.Request(text, NOW, **kw)).collect())


def test_nulls_and_negation(docs):
    assert found(docs, "go") == [1, 3, 4]
    assert found(docs, "-go") == [2]
    assert found(docs, "-domain:s1.example") == [2, 3, 4]
    assert found(docs, '"go is"') == [1]
    assert found(docs, "visits:..") == []
    assert found(docs, "*", user_id=2) == [1, 2, 4]


def test_pages_make_the_whole(docs):
    whole = [r["rec_id"] for r in search.search(search.current(docs), search.Request("*", NOW, sort="domain"), ["rec_id"]).collect()]
    key, pages = "", []
    while page := search.search(search.current(docs), search.Request("*", NOW, sort="domain", limit=2, page_key=key), ["rec_id"]).collect():
        pages += [r["rec_id"] for r in page]
        key = search.page_key_of(page[-1], "domain")
    assert pages == whole and len(whole) == 4
    with pytest.raises(ValueError):
        search.after("date", json.dumps([1, 2, 3]))


def test_facets_equal_filters(docs):
    c = search.current(docs)
    n = {r["value"]: r["n"] for r in search.facets(c, search.Request("*", NOW))["domains"].collect() if not r["is_other"]}
    assert all(n[v] == len(found(docs, f"domain:{v}")) for v in n)


def test_empty_corpus(spark, docs):
    none = docs.limit(0)
    assert search.search(none, search.Request("go fun", NOW)).count() == 0
    assert {r["n"] for r in search.facets(none, search.Request("*", NOW))["updated"].collect()} == {0}


def test_deletion_needs_a_query(docs):
    with pytest.raises(ValueError):
        search.delete_by_query(docs, search.Request(" ", NOW))
    with pytest.raises(ValueError):
        search.checked_fields(["title", "secret"], ("title",))


def test_snippet(docs):
    rows = docs.filter("rec_id = 1").select(search.snippet("go").alias("s")).collect()
    assert rows[0]["s"] == "<mark>Go</mark> is fun"


def test_days_of_uneven_length():
    # 2024-03-31 has 23 hours in Berlin, 2024-10-27 has 25
    (a,) = [b for b in history.timeline_buckets(1_711_900_800, None, "Europe/Berlin") if b[0] == "day:2024-03-31"]
    assert a[2] - a[1] == 23 * 3600
    ((_, lo, hi),) = history.day_buckets(1_729_980_000, 1_729_980_000 + 25 * 3600, "Europe/Berlin")
    assert hi - lo == 25 * 3600
    with pytest.raises(ValueError):
        history.day_buckets(0, 40 * 86400)
    assert history.day_buckets(5, 5) == []


def test_months_reach_the_oldest():
    names = [b[0] for b in history.timeline_buckets(NOW, 1_725_148_800 + 10)]
    assert names[-1] == "month:2024-09" and names[7] == "older" and len([n for n in names if n.startswith("day:")]) == 7


def test_diversify(spark):
    rows = [("a", 0, 0.9), ("a", 1, 0.8), ("a", 2, 0.7), ("b", 0, 0.6), ("c", 0, 0.5), ("c", 1, 0.4), ("d", 0, 0.3), ("d", 1, 0.2)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_idx int, similarity double")
    assert sorted((r[0], r[1]) for r in semantic.diversify(df, 3).select("doc_id", "chunk_idx").collect()) == [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1)]
    assert semantic.diversify(df, 2).count() == 3


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    r = df.select(V.cosine_similarity(F.col("a"), F.col("b")).alias("c"), V.l2_distance(F.col("a"), F.col("b")).alias("l")).collect()
    assert r[0]["c"] == 0.0 and r[1]["c"] is None and r[2]["c"] is None and r[3]["l"] is None
    with pytest.raises(ValueError):
        V.part(F.col("a"), 2, 2)


def test_upsert(spark):
    old = spark.createDataFrame([doc(1, id="x", add_count=3, added=5, label="kept"), doc(2, id="y")], DOC)
    new = spark.createDataFrame([doc(9, id="x", added=0, updated=0, label=" "), doc(8, id="x", updated=0), doc(7, id="z", label="new", added=0)], DOC)
    got = {r["id"]: r for r in ingest.upsert(old, new, NOW).collect()}
    assert got["x"]["add_count"] == 4 and got["x"]["added"] == 5 and got["x"]["label"] == "kept" and got["x"]["updated"] == NOW
    assert got["y"]["add_count"] == 1 and got["z"]["add_count"] == 1 and got["z"]["added"] == NOW


def test_patches():
    old, new = "a\nb\nc", "a\nx\nc\nd"
    assert ingest.undo(new, ingest.make_patch(old, new)) == old
    assert ingest.undo("", ingest.make_patch("a", "")) == "a"


def test_crawl_rules(spark):
    rows = [(1, "j", "https://a.example/1", 0), (2, "j", "https://x.a.example/2", 1), (3, "j", "https://b.example/", 1), (4, "j", "https://a.example/3", 9), (5, "j", "https://a.example/4", 1), (6, "k", "https://q.example/", 5)]
    urls = spark.createDataFrame(rows, "crawl_id long, job_id string, url string, depth int")
    jobs = spark.createDataFrame([("j", json.dumps({"max_links": 2, "max_depth": 3, "allowed_domains": ["a.example"]})), ("k", None)], "job_id string, validator_rules string")
    got = {r["crawl_id"]: r["verdict"] for r in crawl.validate(crawl.with_rules(urls, jobs)).collect()}
    assert got == {1: "allow", 2: "allow", 3: "stop", 4: "stop", 5: "stop", 6: "allow"}
    assert crawl.unique_name("a", ["a", "a-2"]) == "a-3"
    assert crawl.robots_allowed("/a/b", [(False, "/a"), (True, "/a/b")]) and not crawl.robots_allowed("/a/c", [(False, "/a")])


def test_breadth_first_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "url string")
    assert {(r["url"], r["depth"]) for r in crawl.breadth_first(edges, roots, 5).collect()} == {("a", 0), ("b", 1), ("c", 1)}


def test_chunking():
    assert chunking.chunk("short", 10, 2) == ["short"] and chunking.chunk(" \n", 10, 2) == []
    text = "# Head\n\nOne two three. Four five six! Seven\n\n- item one\n- item two\n\n```\ncode here\n```\n"
    assert chunking.blocks(text)[0] == "# Head" and chunking.blocks(text)[-1].startswith("```")
    assert all(len(chunking.tokens(c)) <= 8 for c in chunking.chunk(text, 8, 2))
    assert chunking.sentences("これは。それは！ Yes. No") == ["これは。", "それは！", "Yes.", "No"]
    assert chunking.tokens("漢字 ab1, c") == ["漢", "字", "ab1", ",", "c"]
    assert all(len(chunking.tokens(c)) <= 20 for c in chunking.chunk("word " * 500, 20, 5))
    assert chunking.headroom(512) == 26 and chunking.shorter(400) == 300 and chunking.shorter(400, 200) == 180


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.normalize_url(F.lit("https://a/b?z=1&utm_source=x&a=2#f"))) == "https://a/b?a=2&z=1"
    assert one(T.normalize_url(F.lit("https://a/b?z=1&a=2#f"))) == "https://a/b?z=1&a=2"
    assert one(T.normalize_url(F.lit("https://a/b?utm=1"))) == "https://a/b"
    assert one(T.host(F.lit("https://u:p@A.example:80/x"))) == "a.example" and one(T.host(F.lit("file:///x"))) == "local"
    assert one(T.strip_invisible(F.lit("a​\r\nb   c"))) == "a\nb c"
    assert one(T.vtt_text(F.lit("WEBVTT\n\n1\n00:00.000 --> 00:02.000\n<c>hi</c>\nhi\n"))) == "hi"
    assert one(T.analysed(F.lit("漢字かな ab"), "ja")) == ["漢字", "字か", "かな", "ab"]
    assert one(T.crawl_link(F.lit("https://a/b/"), F.lit("../c#x"))) == "https://a/c"
    assert one(T.crawl_link(F.lit("https://a/"), F.lit("mailto:x@y"))) is None
    assert T.sanitize_html('<p onclick="x">a<script>b</script><a href="javascript:x">c</a></p>') == "<p>a<a>c</a></p>"


def test_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.md").write_text("# no")
    (tmp_path / "a.md").write_text("# Title\n\ntext")
    (tmp_path / "b.org").write_text("#+TITLE: Org\n* Head\nbody *bold*")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "empty.txt").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Docx head</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    walked = files.walk(spark, str(tmp_path), types=("md", "org", "txt", "docx"))
    indexed = spark.createDataFrame([], "path string, updated long")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.documents(files.changed(walked, indexed)).collect()}
    assert set(got) == {"a.md", "b.org", "c.txt", "d.docx"}
    assert got["a.md"]["title"] == "Title" and got["b.org"]["title"] == "Org" and got["c.txt"]["error"] == "binary file" and got["d.docx"]["title"] == "Docx head"
    assert "<h1>Title</h1>" in files.markdown_html("# Title\n\n- a\n- **b**") and "<strong>b</strong>" in files.markdown_html("- **b**")
    assert files.docx_text(io.BytesIO((tmp_path / "d.docx").read_bytes()).read())[1] == "Docx head\nbody"


def test_service_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"results": [{"url": "https://a/", "title": " ", "description": "d", "tag_names": ["x", " "], "date_added": "2024-01-01T00:00:00Z"}, {"url": " "}]}))
    (tmp_path / "2.json").write_text(json.dumps([{"url": "https://b/", "title": "B", "date_modified": "2024-01-02"}]))
    spark.dataSource.register(imports.ServicePages)
    records = spark.read.format("service_pages").option("path", str(tmp_path)).load()
    got = {r["url"]: r for r in imports.bookmarks(records, "linkding").collect()}
    assert set(got) == {"https://a/", "https://b/"} and got["https://a/"]["title"] == "https://a/" and got["https://a/"]["updated"] == 1704067200
    assert got["https://a/"]["metadata"]["linkding_tags"] == '["x"]' and "linkding_tags" not in got["https://b/"]["metadata"]


def test_exports(spark, docs, tmp_path):
    some = docs.select("rec_id", "title").filter("rec_id = 1")
    imports.export_json(some, str(tmp_path / "j"))
    imports.export_csv(some, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).first()["title"] == "title 1"


def test_packing(spark):
    ops = spark.createDataFrame([("a", 1, 4), ("a", 2, 4), ("a", 3, 20), ("a", 4, 4), ("b", 1, 1)], "k string, s long, n long")
    got = {(r["k"], r["s"]): (r["batch"], r["status"]) for r in imports.pack(ops, "k", "s", "n", 10).collect()}
    assert got == {("a", 1): (0, 0), ("a", 2): (0, 0), ("a", 3): (1, 413), ("a", 4): (2, 0), ("b", 1): (0, 0)}


def test_scalars_over_all_rows(spark, tmp_path):
    import unicodedata
    from urllib.parse import urljoin

    from larkspan import catalogue

    catalogue.load()

    def tokens(text):
        n, inside = 0, False
        for x in text:
            wide = unicodedata.name(x, "").startswith(("CJK UNIFIED", "HIRAGANA", "KATAKANA LETTER", "HANGUL"))
            word = not wide and unicodedata.category(x)[0] == "L" or unicodedata.category(x) == "Nd"
            n += (word and not inside) or (not word and not x.isspace())
            inside = word
        return n

    texts = ["plain text, 2 marks.", "漢字abcひらカナ한글 x", "a\u00a0b\u3000c\u2028d", "½ Ⅳ naïve é", "", None]
    titles = ["a \\ b", None, '"q"', "12", "x --> y", "NOTE <b>z</b>\nsaid"]
    rows = [(i, t, s, f"https://user{i}@host.test/a/b") for i, (t, s) in enumerate(zip(texts, titles))]
    spark.createDataFrame(rows, "doc_id long, text string, title string, url string").write.parquet(f"{tmp_path}/documents.parquet")
    saved = spark.createDataFrame([(i, str(i), u, s, 0, 1, None) for i, _, s, u in rows], "rec_id long, id string, url string, title string, type int, updated long, ingested_at timestamp")
    saved.write.parquet(f"{tmp_path}/indexed_docs.parquet")
    got = lambda name: {r[0]: r[1] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("t08_embedding_tokens_all") == {i: tokens(t) for i, t in enumerate(texts) if t is not None}
    assert got("w16_csv_fields_all") == {i: '"' + (s or "").replace('"', '""') + '"' for i, s in enumerate(titles)}
    assert got("c05_resolved_link_all") == {i: urljoin(u, "/about") for i, _, _, u in rows}
    assert got("c15_subtitles_all") == {0: "a \\ b", 1: None, 2: '"q"', 3: "", 4: "", 5: "said"}


def test_bookmarks_keep_whole_texts(spark, data):
    from larkspan import catalogue

    catalogue.load()
    got = catalogue.QUERIES["m03_bookmark_documents_whole"](spark, data).selectExpr("max(length(text)) as n").first()["n"]
    want = spark.read.parquet(f"{data}/documents.parquet").filter("trim(url) <> ''").select(F.max(F.length(T.stripped(F.col("text")))).alias("n")).first()["n"]
    assert got == want > 80


@pytest.mark.parametrize("name", ["v08_add", "v08_subtract", "v10_normalize"])
def test_vectors_are_rounded_as_in_sql(name, spark, tmp_path):
    import duckdb

    from larkspan import catalogue

    catalogue.load()
    b = [(-1) ** i * i / 8 for i in range(64)]
    shift = [3e-7, -3e-7, 0.0, 1e30, 0.1234565, 1.5e-6, float("nan"), float("inf")]
    rows = [(0, b), (1, [x + shift[i % 8] for i, x in enumerate(b)]), (2, [-x + shift[i % 8] for i, x in enumerate(b)]), (3, [x + shift[i % 3] for i, x in enumerate(b)]), (4, [-1e-8] * 63 + [-100.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {i: list(map(repr, v)) for i, v in con.execute(f"SELECT vec_id, value FROM ({catalogue.SQL[name]})").fetchall()}
    assert {r["vec_id"]: list(map(repr, r["value"])) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()} == want
    assert "-0.0" in str(want)
