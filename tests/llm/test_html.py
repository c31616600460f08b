import numpy as np
import pytest

from attesta.llm.blocks import blocks
from attesta.llm.html_text import WIDTH, Labeller, features, main_text, trained
from attesta.llm.page_maker import Maker

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Site name</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></ul></nav>
<div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>Accept</button></div>
<div class="ad">Buy this now, only today.</div>
<article><h1>A title &amp; more</h1><p>First   paragraph with <b>bold</b> and
<a href="/x">a link</a> in it, caf&eacute; &lt;3.<p>Second one, unclosed<br>and broken.</p>
<ul><li>an item<li>another item</ul><div class="share"><a href="/t">Share</a></div></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Other story</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with all of this.</p></div></section>
<form class="search"><label>Search</label></form><footer>&copy; Someone</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return trained()


def test_blocks():
    found = blocks(PAGE)
    texts = [b.text for b in found]
    assert "First paragraph with bold and a link in it, café <3." in texts and "Second one, unclosed and broken." in texts
    assert texts.count("an item") == texts.count("another item") == 1
    assert not any("var t" in t or "p{}" in t for t in texts)
    first = next(b for b in found if b.text.startswith("First"))
    assert [e[0] for e in first.path] == ["html", "body", "article", "p"] and first.linked == len("a link")
    assert blocks("") == [] and blocks("<p>") == [] and blocks("plain & text")[0].text == "plain & text"
    assert blocks('<p title="a>b" x=\'c>d\'>in</p><!-- <p>no</p> --><script>x')[0].text == "in"
    assert len(blocks("<div>" * 3000 + "x" + '<p a="' * 50)) >= 1


def test_main_text_of_a_page(spark, model):
    df = spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")
    text = main_text(df, model=model).first()["text"].split("\n")
    assert text == [
        "A title & more", "First paragraph with bold and a link in it, café <3.", "Second one, unclosed and broken.",
        "an item", "another item",
    ]


def test_labeller_on_new_invented_pages(model):
    maker, right, total = Maker(777), 0, 0
    for _ in range(200):
        page, labels = maker.page()
        found = blocks(page)
        assert len(found) == len(labels)
        p = model.label([features(found)])[0]
        right += int(((p > 0.5) == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.97


def test_gradients():
    model, rng = Labeller(1), np.random.default_rng(2)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = rng.standard_normal((5, 3, WIDTH))
    live = np.array([[1, 1, 1], [1, 1, 1], [1, 0, 1], [1, 0, 1], [1, 0, 0]], bool)
    y = (rng.random((5, 3)) > 0.5).astype(float) * live
    _, g = model.gradients(x, live, y)
    for name in ("Wf", "Wb", "Bf", "U", "V", "c"):
        flat = model.w[name].reshape(-1)
        k = int(rng.integers(len(flat)))
        old = flat[k]
        ends = []
        for step in (1e-2, -1e-2):
            flat[k] = old + step
            ends.append(model.gradients(x, live, y)[0])
        flat[k] = old
        assert abs((ends[0] - ends[1]) / 2e-2 - g[name].reshape(-1)[k]) < 2e-3


def test_pages_in_a_batch_dont_touch(model):
    maker = Maker(5)
    pages = [features(blocks(maker.page()[0])) for _ in range(20)]
    together = model.label(pages)
    for p, s in zip(pages, together):
        assert np.allclose(model.label([p])[0], s, atol=1e-4)


def test_odd_pages(spark, model):
    rows = [(1, None, None, 1), (2, "u", "", 1), (None, "u", "<nav>x", 1), (3, "u", "<article><p>" + "word " * 50_000, 1), (3, "u", "<article><p>" + "word " * 50_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r["page_id"], r["url"]): r for r in main_text(df, model=model).collect()}
    assert got[1, None]["text"] == "" and got[2, "u"]["n_chars"] == 0 and got[None, "u"]["text"] == ""
    assert got[3, "u"]["n_chars"] == 249_999
    assert main_text(df, model=model).count() == 5 and main_text(df.filter("page_id = 99"), model=model).count() == 0


def test_real_pages(spark, model):
    """The tables' pages keep their text in one article element."""
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in df.collect():
        own = [b.text for b in blocks(r["html"]) if any(e[0] == "article" for e in b.path)]
        want[r["page_id"]] = "\n".join(own)
    got = {r["page_id"]: r["text"] for r in main_text(df, model=model).collect()}
    assert got == want

#: Pages written by hand, and how the blocks of their main text begin.
BY_HAND = {
    'german': (
        """<html><body><div class="kopfzeile"><a href="/">Tageblatt</a></div><div class="menue"><ul><li><a href=/a>Start</a><li><a href=/b>Politik</a><li><a href=/c>Sport</a></ul></div><div class="inhalt"><h1>Der neue Bahnhof wird später fertig</h1><p>Der Umbau des Bahnhofs dauert nach Angaben der Stadt noch mindestens zwei Jahre länger als bisher geplant.</p><p>Die Kosten steigen damit auf rund vierzig Millionen Euro, wie der Rat am Dienstag mitteilte.</p><p>Kritiker halten das Vorhaben schon lange für zu teuer.</p></div><div class="kommentare"><h3>Kommentare</h3><p>Anna schrieb am 3. Mai</p><p>Das war doch abzusehen, so wie dort geplant wird.</p></div><div class="fusszeile">© Tageblatt. Alle Rechte vorbehalten. Impressum</div></body></html>""",
        ['Der neue Bahnhof', 'Der Umbau', 'Die Kosten', 'Kritiker'],
    ),
    'table': (
        """<table width=800><tr><td colspan=3><b>The Daily Herald</b></td></tr><tr><td><a href=/>Home</a><br><a href=/n>News</a><br><a href=/s>Sports</a></td><td><h1>River levels fall after dry spring</h1><p>Water levels in the river have fallen to their lowest point in twenty years, the agency said on Monday, after a spring with little rain.</p><p>Farmers along the banks have been asked to reduce what they take for their fields until the end of the month.</p><p>Officials expect some relief in June.</p></td><td><h3>Most read</h3><ul><li><a href=/1>Mayor resigns</a></li><li><a href=/2>New bridge opens</a></li><li><a href=/3>Ten recipes for summer</a></li></ul></td></tr><tr><td colspan=3>Copyright 2020 The Daily Herald. All rights reserved.</td></tr></table>""",
        ['River levels', 'Water levels', 'Farmers along', 'Officials expect'],
    ),
    'svg': (
        """<body><nav><a href=/>Home</a> <a href=/x>Blog</a></nav><article><h1>How batteries age</h1><svg viewBox="0 0 1 1"><path d="M0"><p>Every battery loses capacity with time, whether it is used or not, and heat makes it worse.</p><p>The formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for small currents.</p></article><footer>&copy; Someone</footer>""",
        ['How batteries', 'Every battery', 'The formula x=2 holds'],
    ),
    'aside': (
        """<body><header><a href=/>Site</a></header><main><h2>A walk in the hills</h2><p>We set out early in the morning, when the valley was still covered in fog and the birds were quiet.</p><aside><p>The hills here rise to about nine hundred metres and are covered in beech.</p></aside><p>By noon we had reached the ridge and could see the sea.</p><aside><h3>Related articles</h3><ul><li><a href=/1>Walks by the sea</a></li><li><a href=/2>What to pack</a></li></ul></aside></main><div>We use cookies to improve your experience. Accept all</div></body>""",
        ['A walk in', 'We set out', 'The hills here', 'By noon'],
    ),
    'french': (
        """<div id=a1><div id=a2><a href=/>Accueil</a> | <a href=/b>Actualités</a> | <a href=/c>Contact</a></div><div id=a3><h1>La ville change ses bus</h1><p>Dès le mois de mars, la ville remplacera une partie de ses autobus par des véhicules électriques plus silencieux.</p><p>Le projet coûtera douze millions d'euros et sera financé pour moitié par la région.</p><ul><li>Vingt bus sur la ligne A</li><li>Dix bus sur la ligne B</li></ul></div><div id=a4><p>Publicité</p><p>Achetez maintenant votre billet à prix réduit</p></div><div id=a5>Mentions légales - Tous droits réservés</div></div>""",
        ['La ville change', 'Dès le mois', 'Le projet', 'Vingt bus', 'Dix bus'],
    ),
    'comments': (
        """<div class="post"><h1>Why I moved to the country</h1><p>Three years ago my partner and I left the city for a small house near the forest.</p><p>It was not an easy choice, and there are days when we miss the theatres and the late trains.</p></div><div class="share">Share this article <a href=#>Tweet</a></div><div class="comments"><h3>2 comments</h3><div class=c><b>Maria</b> says:<p>Thank you for writing this, I have thought about the same step for a long time and I still hesitate.</p></div><div class=c><b>Jo</b> says:<p>How do you get to work?</p></div></div><form><p>Leave a reply</p><textarea>Your text</textarea></form>""",
        ['Why I moved', 'Three years ago', 'It was not'],
    ),
}


def test_pages_written_by_hand(spark, model):
    """Names in other languages or none, tables as layout, broken markup, asides that belong to the
    text, formulas, adverts and comments."""
    kept = right = wanted = 0
    for name, (page, begins) in BY_HAND.items():
        found = blocks(page)
        score = model.label([features(found)])[0]
        want = [any(b.text.startswith(x) for x in begins) for b in found]
        assert sum(want) == len(begins), name
        kept += int((score > 0.5).sum())
        right += int(((score > 0.5) & np.array(want)).sum())
        wanted += len(begins)
    assert right / kept >= 0.95 and right / wanted >= 0.95


def test_every_word_of_a_block_is_read():
    long = " ".join(f"word{i}" for i in range(400))
    one, other = (features(blocks(f"<p>{long}{end}</p>")) for end in (" cookies", " battery"))
    assert (one != other).any()
    named = [features(blocks(f'<div class="{" ".join("abcdefghijklmnopqrst")} {x}"><p>text</p></div>')) for x in ("menu", "story")]
    assert (named[0] != named[1]).any()


def test_elements_that_are_never_closed():
    assert [b.text for b in blocks("<svg><p>one<p>two<math><mi>x</mi><p>three")] == ["one", "twox", "three"]
    assert [b.text for b in blocks("<title>lost<p>kept</p>")] == ["kept"]
    assert [b.text for b in blocks("<p>a</p><noscript><p>b</p></noscript><object>c</object><video>d")] == ["a", "b", "cd"]
