"""Readers of feeds and pages, GEXF and streams."""

import datetime as dt

from pyspark.sql import functions as F

from corvina.functions.registry import register
from corvina.operators import upserts as U
from corvina.settings import Settings
from corvina.sources import feeds, gexf, sheets
from corvina.streaming import ingest


def test_cdx(spark):
    page = '[["original","timestamp","mimetype","statuscode"],["https://a/x","20200102030405","text/html","200"],["https://a/x","20210102030405","text/html","200"],["https://a/y.png","20200101","image/png","200"],[],["org%2Cresume+key+longer+than+that"]]'
    rows = feeds.cdx_pages(spark.createDataFrame([(page,), ("[]",), ("no json",), (None,)], "value string")).collect()
    assert [(r.url, r.timestamp_cdx) for r in rows] == [("https://a/x", "20200102030405")]


def test_sitemaps_and_feeds(spark):
    site = '<urlset xmlns="s"><url><loc>https://a/1</loc><lastmod>2020-05-06T01:02:03Z</lastmod></url><ns:url><ns:loc> https://a/2?x=1&amp;y=2 </ns:loc></ns:url></urlset>'
    index = "<sitemapindex><sitemap><loc>https://a/s1.xml</loc></sitemap></sitemapindex>"
    rss = '<rss><item><link>https://a/3</link><pubDate>Mon, 02 Mar 2015 16:10:01 GMT</pubDate></item><item><guid>https://a/4</guid></item></rss>'
    atom = '<feed><entry><link rel="alternate" href="https://a/5"/><updated>2020-01-01T00:00:00Z</updated></entry></feed>'
    df = spark.createDataFrame([(site,), (index,), (rss,), (atom,), (None,), ("",)], "value string")
    assert {(r.url, r.data_prevista) for r in feeds.sitemap_urls(df).collect()} == {("https://a/1", "2020-05-06"), ("https://a/2?x=1&y=2", None)}
    assert [r.loc for r in feeds.sitemap_children(df).collect()] == ["https://a/s1.xml"]
    assert {(r.url, r.data_prevista) for r in feeds.feed_items(df).collect()} == {("https://a/3", "Mon, 02 Ma"), ("https://a/4", None), ("https://a/5", "2020-01-01")}


def test_pages(spark):
    long = "Um texto comprido. " * 20
    html = f'<html><title>T</title><nav><p>{long}</p></nav><script type="application/ld+json">{{"@graph":[{{"@type":"WebPage"}},{{"@type":"NewsArticle","headline":"H","articleBody":"{long}","author":[{{"name":"Ana"}}],"datePublished":"2020-01-01"}}]}}</script><h1>A <b>B</b></h1><p>{long}</p><p>curto</p><a href="/x">um <i>dois</i></a><a href="https://b/y">fora</a></html>'
    df = spark.createDataFrame([("https://a/p", html), ("https://a/q", None)], "url string, html string")
    r = feeds.json_ld_articles(df).collect()
    assert [(x.titulo, x.autor, x.publicado) for x in r] == [("H", "Ana", "2020-01-01")]
    assert [(x.link, x.anchor) for x in feeds.page_links(df).collect()] == [("https://a/x", "um dois")]
    p = feeds.paragraphs(df).where("url = 'https://a/p'").first()
    assert (p.titulo, p.corpo) == ("A B", long.strip())


def test_gexf(spark):
    n, e = spark.createDataFrame([(1, 'a"&')], "node long, label string"), spark.createDataFrame([(1, 1, 2.0)], "a long, b long, weight double")
    lines = [r.line for r in gexf.gexf_lines(n, e).collect()]
    assert lines[1] == '<node id="1" label="a&quot;&amp;"/>' and len(lines) == 5


def test_streams(spark, tmp_path):
    day = lambda d: dt.datetime(2020, 1, d)
    schema = "id long, url string, veiculo_id long, score_clickbait double, criado_em timestamp"
    rows = [(1, "u", 1, 0.5, day(1)), (2, "u", 1, 0.1, day(2)), (3, "w", 2, 0.2, day(2))]
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = ingest.arriving(spark, src, spark.read.parquet(src).schema)
    keep = lambda old, new: U.insert_or_ignore(old, new, "url", "id")
    ingest.admit(stream, out, f"{tmp_path}/c1", keep).awaitTermination()
    spark.createDataFrame([(4, "u", 1, 0.5, day(3)), (5, "z", 1, 0.5, day(3))], schema).coalesce(1).write.mode("append").parquet(src)
    ingest.admit(stream, out, f"{tmp_path}/c1", keep).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3, 5]
    q = ingest.outlet_counts(ingest.first_seen(stream, "url", "criado_em").select("veiculo_id", "score_clickbait", "criado_em"), "criado_em", late="0 seconds")
    assert q.isStreaming


def test_kinds_and_gzip(spark, tmp_path):
    import gzip

    (tmp_path / "a.xml").write_bytes(gzip.compress(b"<urlset></urlset>"))
    (tmp_path / "b.gz").write_bytes(b"<rss></rss>")
    (tmp_path / "c.xml").write_bytes(b"\x1f\x8bbroken")
    got = {r.path[-5:]: r.kind for r in feeds.opened_texts(spark, f"{tmp_path}/*").select("path", feeds.source_kind(F.col("value")).alias("kind")).collect()}
    assert got == {"a.xml": "sitemap", "/b.gz": "rss", "c.xml": None}


def test_sitemap_tree(spark):
    index = lambda *xs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in xs) + "</sitemapindex>"
    leaf = lambda x: f"<urlset><url><loc>https://a/{x}</loc></url></urlset>"
    files = [("r", index("r", "s", "old-2009", "y-2016")), ("s", index("t", "r")), ("t", index("u")), ("u", index("v")), ("v", leaf("too-deep")), ("old-2009", leaf("old")), ("y-2016", leaf("good"))]
    got = feeds.sitemap_tree(spark.createDataFrame(files, "loc string, value string"), spark.createDataFrame([("r",)], "loc string")).collect()
    assert [(r.loc, r.level, r.url) for r in got] == [("y-2016", 1, "https://a/good")]
    years = [(2016, 2, leaf("late")), (2016, 1, leaf("first")), (2017, 1, None)]
    old = feeds.historical_sitemaps(spark.createDataFrame(years, "ano int, tirado_em int, value string")).collect()
    assert [(r.url, r.ano, r.fonte_coleta) for r in old] == [("https://a/first", 2016, "sitemap_historico")]


def test_cascade_and_sections(spark):
    long = "Um texto comprido sobre o tema. " * 10
    ld = f'<script type="application/ld+json">{{"@type":"NewsArticle","headline":"H","articleBody":"{long}"}}</script><p>{long}</p>'
    rows = [("https://a/1", ld), ("https://a/2", f"<h1>T</h1><p>{long}</p>"), ("https://a/3", "<p>curto</p>"), ("https://a/s", '<a href="/politica/noticia/um-titulo-2019">Senado vota</a><a href="/login/politica/noticia/x">x</a>')]
    df = spark.createDataFrame(rows, "url string, html string")
    assert {(r.url, r.origem) for r in feeds.extracted(df).collect()} == {("https://a/1", "json_ld"), ("https://a/2", "paragrafos")}
    assert [(r.link, r.eixo) for r in feeds.section_links(df).collect()] == [("https://a/politica/noticia/um-titulo-2019", "politico")]


def test_sheets(spark, tmp_path):
    import zipfile

    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "n.csv").write_text("node,label,extra\n1,Um,x\n2,,y\n,z,z\n")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("in/e.csv", "a,b,weight\n1,2,3.5\n1,9,1\n2,1,\n")
    folders = [str(tmp_path / "none"), str(tmp_path / "plain"), str(tmp_path)]
    nodes, edges = sheets.read_sheet(spark, "n.csv", "node long, label string, size double", folders), sheets.read_sheet(spark, "e.csv", "a long, b long, weight double", folders)
    assert sheets.read_sheet(spark, "x.csv", "a long", folders) is None
    n, e = sheets.graph_tables(nodes, edges)
    assert {(r.node, r.label, r.kind, r.size) for r in n.collect()} == {(1, "Um", "evento", 1.0), (2, "2", "evento", 1.0)}
    assert {(r.a, r.b, r.weight, r.distance) for r in e.collect()} == {(1, 2, 3.5, 1.0), (2, 1, 1.0, 1.0)}


def test_gexf_round_trip(spark, tmp_path):
    n = spark.createDataFrame([(1, 'a"&<', "x&y"), (2, "b", None)], "node long, label string, group string")
    e = spark.createDataFrame([(1, 2, 2.5)], "a long, b long, weight double")
    gexf.gexf_lines(n, e).coalesce(1).write.text(f"{tmp_path}/g")
    nodes, edges = gexf.read_gexf(spark, f"{tmp_path}/g")
    assert {(r.node, r.label, tuple(r.attributes.items())) for r in nodes.collect()} == {("1", 'a"&<', (("group", "x&y"),)), ("2", "b", ())}
    assert [(r.a, r.b, r.weight) for r in edges.collect()] == [("1", "2", 2.5)]
    assert tuple(gexf.graph_summary(nodes, edges).first()) == (2, 1, 2.5, 1.0, 1.0)


def test_settings_and_sql_functions(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"events": {"window": {"days": 5}}}')
    s = Settings.read(str(tmp_path / "s.json"))
    assert (s.get("events.window.days"), s.get("events.none", 7), s.get("events.window.days.x", 1)) == (5, 7, 1)
    assert "corvina_tone" in register(spark)
    r = spark.sql("SELECT corvina_tone(0.1D) AS t, corvina_bias(-0.5D, 1D) AS b, corvina_within(DATE '2020-01-01', DATE '2020-01-02', DATE '2020-01-03') AS w").first()
    assert (r.t, r.b, r.w) == ("positivo", 1.0, False)


def test_anchored_windows_of_a_stream(spark, tmp_path):
    day = lambda d, m=1: dt.datetime(2020, m, d)
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    batches = [[("a", day(1)), ("a", day(6)), ("b", day(3)), (None, day(3))], [("a", day(4)), ("a", day(9))], [("a", day(3)), ("a", day(1, 3)), ("b", None)]]
    schema = "eixo string, criado_em timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = ingest.arriving(spark, src, spark.read.parquet(src).schema)
        q = ingest.anchored_counts(stream, "criado_em", "eixo").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.eixo, r.start.day, r.n, r.late) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1, 3, False), ("a", 9, 1, False), ("a", 3, 1, True), ("b", 3, 1, False)}
