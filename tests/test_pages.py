"""Page tables on a hand-made page."""

from fieldsense.sources import pages

URL = "https://host.example/frogs/sounds.html?x=1"
HTML = """<html><head><title>Sounds</title><style>p{content:"<a href='/style.mp3'>"}</style><script>var t = "<a href='no.mp3'>no</a>";</script></head>
<body><!-- <a href="/hidden.mp3">hidden</a> --><h2>Advertisement Calls</h2><p>The following were heard at night.</p>
<table><tr><td><a href="audio/one.MP3"> <img src="/img/Sonogram_one.png"> play </a></td><td>A trill, 12 seconds,
 &amp; more<br>&copy; x</td></tr>
<tr><td><A class="b" HREF='/audio/two.mp3'>two</A></td></tr></table>
<h2>Release Calls</h2><p>Text with <b>bold</b> words.</p><a href="https://other.example/three.mp3">three &lt;3&gt;</a>
<a href="audio/one.MP3">again</a><a href="page.html">page</a><a name="here">no target</a><img src='../img/x.png'><img src="sonogram.png"></body></html>"""
MARKS = {"section": r"(?i)calls?$", "context": r"(?i)^The following"}


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string, caption string, pos int")


def test_links_captions_and_marks(spark):
    got = pages.page_links(table(spark, (1, URL, HTML, "clash", 9), (2, URL, None, None, None), (3, URL, "", None, None)), "page_id", ".mp3", MARKS).orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["link"], r["caption"], r["section"], r["context"]) for r in got] == [
        (1, "https://host.example/frogs/audio/one.MP3", "A trill, 12 seconds, & more &copy; x", "Advertisement Calls", "The following were heard at night."),
        (1, "https://host.example/audio/two.mp3", "two", "Advertisement Calls", "The following were heard at night."),
        (1, "https://other.example/three.mp3", "three <3>", "Release Calls", "The following were heard at night."),
    ]


def test_text_images_and_addresses(spark):
    df = table(spark, (1, URL, HTML, None, None), (4, None, "<a href='x'>t</a>", None, None))
    text = {r["page_id"]: r["text"] for r in pages.page_text(df, "page_id").collect()}
    assert text[1].startswith("Sounds Advertisement Calls The following") and "hidden" not in text[1] and "no.mp3" not in text[1] and text[4] == "t"
    assert pages.page_images(df, "page_id", "sonogram").collect()[0]["images"] == ["https://host.example/frogs/sonogram.png", "https://host.example/img/Sonogram_one.png"]
    links = spark.createDataFrame([("mailto:a@b", URL), ("//c.example/x", URL), ("x", "https://host.example"), ("/y", "https://host.example?q"), ("z", None)], "l string, u string")
    found = [r[0] for r in links.select(pages.resolved(links["l"], links["u"])).collect()]
    assert found == ["mailto:a@b", "https://c.example/x", "https://host.example/x", "https://host.example/y", None]
    assert pages.page_links(df.limit(0), "page_id").collect() == []
