"""Pages written by hand whose names and phrases stand in no list of the page maker, and long pages.

The pages below were not used to fit or choose anything."""

import resource
import subprocess
import sys

import numpy as np
import pytest

from attesta.llm import page_maker
from attesta.llm.blocks import blocks
from attesta.llm.html_text import PLACES, Labeller, features, fitted, trained, words_of

#: name: (markup, how the blocks of the main text begin)
PAGES = {
    "japanese": (
        "<body><div><a href=/>ホーム</a> <a href=/k>会社概要</a> <a href=/t>お問い合わせ</a></div><article><h1>新しい図書館が開館</h1>"
        "<p>市の中心部に新しい図書館が今週開館し、初日だけで三千人を超える人々が訪れたと関係者が明らかにした。</p>"
        "<p>館内には約二十万冊の本があり、子ども向けの部屋や静かな学習室も用意されている。</p></article><div><a href=/p>個人情報保護方針</a></div></body>",
        ["新しい図書館", "市の中心部", "館内には"],
    ),
    "russian": (
        "<body><ul><li><a href=/>Главная</a><li><a href=/o>О нас</a><li><a href=/n>Новости</a></ul><main><h1>В городе открыли мост</h1>"
        "<p>Новый мост через реку открыли в субботу утром, и первые автомобили проехали по нему уже через час после церемонии.</p>"
        "<p>Строительство продолжалось четыре года и обошлось дороже, чем предполагалось сначала.</p></main><p><a href=/r>Реклама на сайте</a></p></body>",
        ["В городе", "Новый мост", "Строительство"],
    ),
    "greek": (
        "<body><nav><a href=/>Αρχική</a><a href=/e>Επικοινωνία</a></nav><div><h1>Το νησί χωρίς αυτοκίνητα</h1>"
        "<p>Στο μικρό νησί οι κάτοικοι μετακινούνται με ποδήλατα και με βάρκες, ενώ τα αυτοκίνητα απαγορεύονται εδώ και δεκαετίες.</p>"
        "<p>Οι επισκέπτες φτάνουν με το πλοίο της γραμμής δύο φορές την εβδομάδα και μένουν συνήθως λίγες μέρες.</p></div></body>",
        ["Το νησί", "Στο μικρό", "Οι επισκέπτες"],
    ),
    "chinese": (
        "<body><header><a href=/>首页</a> <a href=/x>体育</a> <a href=/c>财经</a></header><section><h2>山区铁路通车</h2>"
        "<p>经过六年的建设，连接两个山区城市的铁路昨天正式通车，全程只需要一个半小时，比以前缩短了一半以上的时间。</p>"
        "<p>当地居民表示，新的线路将会方便学生和老人，也会给沿线的村庄带来更多的游客。</p></section><footer><p>版权所有</p></footer></body>",
        ["山区铁路通车", "经过六年", "当地居民"],
    ),
    "arabic": (
        "<body><nav><a href=/>الرئيسية</a> <a href=/w>من نحن</a></nav><article><h1>حديقة جديدة في وسط المدينة</h1>"
        "<p>افتتحت البلدية حديقة جديدة في وسط المدينة تضم أشجارا نادرة وممرات طويلة للمشي وركوب الدراجات في جميع الأوقات.</p></article></body>",
        ["حديقة جديدة", "افتتحت البلدية"],
    ),
    "dutch table": (
        "<table><tr><td><a href=/>Voorpagina</a><br><a href=/s>Voetbal</a><br><a href=/w>Het weer</a></td><td><h1>Dijk krijgt nieuwe sluis</h1>"
        "<p>De oude sluis bij de dijk wordt volgend jaar vervangen door een exemplaar dat ook bij hoog water open kan blijven.</p>"
        "<p>Schippers hadden al langer geklaagd over de wachttijden, die in de zomer tot drie uur konden oplopen.</p></td></tr></table>",
        ["Dijk krijgt", "De oude sluis", "Schippers hadden"],
    ),
    "figure": (
        "<body><header><a href=/>Alpine Gazette</a></header><article><h1>The glacier that came back</h1><figure><img src=g.jpg>"
        "<figcaption>The tongue of the glacier as seen from the hut in late August.</figcaption></figure>"
        "<p>For three years the ice above the village has grown, to the surprise of the people who measure it every autumn.</p>"
        "<p>Nobody expects this to last, but the heavy snow of recent winters has bought some time.</p></article>"
        "<aside><p><a href=/1>Ten huts worth the climb</a></p><p><a href=/2>How crevasses form</a></p></aside></body>",
        ["The glacier that", "The tongue of", "For three years", "Nobody expects"],
    ),
    "italian": (
        "<div class=testata><a href=/>Il Corriere del Lago</a></div><div class=voci><a href=/c>Cronaca</a> <a href=/m>Meteo</a></div>"
        "<div class=pezzo><h1>Torna il mercato sul lungolago</h1><p>Dopo due anni di lavori il mercato del sabato torna sul lungolago, "
        "con quaranta banchi e un nuovo spazio per i prodotti della valle.</p><p>I commercianti sperano che il ritorno in centro porti anche i turisti che negli ultimi anni si erano fermati altrove.</p></div>"
        "<div class=fondo>Partita IVA 000000</div>",
        ["Torna il mercato", "Dopo due anni", "I commercianti"],
    ),
    "polish": (
        "<div><a href=/>Strona główna</a> <a href=/r>Redakcja</a></div><div><h1>Most kolejowy po remoncie</h1><p>Po rocznej przerwie pociągi wróciły na most "
        "kolejowy nad rzeką, a podróż między miastami trwa znowu niecałą godzinę.</p><p>Kolej zapowiada, że w przyszłym roku na trasie pojawią się nowe składy.</p></div>",
        ["Most kolejowy po", "Po rocznej", "Kolej zapowiada"],
    ),
    "korean": (
        "<body><nav><a href=/>홈</a> <a href=/s>사회</a> <a href=/m>문화</a></nav><main><h1>바닷가 마을의 작은 영화제</h1><p>인구가 천 명이 되지 않는 바닷가 마을에서 해마다 작은 영화제가 열리며 "
        "올해는 열두 나라에서 온 작품들이 상영된다.</p><p>주민들은 손님들에게 방을 내어 주고 저녁마다 함께 음식을 나눈다.</p></main></body>",
        ["바닷가 마을의", "인구가 천", "주민들은"],
    ),
    "recipe": (
        "<div id=z1><span>Kitchen Notes</span></div><div id=z2><h1>Bread without kneading</h1><p>This loaf needs nothing but patience: flour, water, salt and a pinch of yeast, left alone for a night.</p>"
        "<ol><li>Stir everything together in a large bowl.</li><li>Cover it and wait for eighteen hours.</li><li>Bake in a hot pot with the lid on.</li></ol></div>"
        "<div id=z3><a href=/1>Soup for cold days</a> <a href=/2>Pickles</a></div>",
        ["Bread without", "This loaf", "Stir everything", "Cover it", "Bake in"],
    ),
    "thai": (
        "<body><div><a href=/>หน้าแรก</a> <a href=/a>ข่าวสาร</a></div><article><h1>ตลาดน้ำเปิดใหม่</h1><p>ตลาดน้ำแห่งใหม่เปิดให้บริการแล้วที่ริมแม่น้ำทางตอนเหนือของเมืองโดยมีร้านค้ามากกว่าหนึ่งร้อยร้านและเรือพายสำหรับนักท่องเที่ยว</p></article></body>",
        ["ตลาดน้ำเปิดใหม่", "ตลาดน้ำแห่งใหม่"],
    ),
}


@pytest.fixture(scope="module")
def model():
    return trained()


def measured(model, names=PAGES):
    """(precision, recall) over blocks, by page."""
    out = {}
    for name in names:
        page, begins = PAGES[name]
        found = blocks(page)
        want = np.array([any(b.text.startswith(x) for x in begins) for b in found])
        assert want.sum() == len(begins), name
        got = model.label([features(found)])[0] > 0.5
        out[name] = ((got & want).sum() / max(1, got.sum()), (got & want).sum() / want.sum())
    return out


def test_new_pages(model):
    found = measured(model)
    print(found)
    assert np.mean([p for p, _ in found.values()]) >= 0.9 and np.mean([r for _, r in found.values()]) >= 0.9, found


def test_their_names_are_in_no_list():
    told = " ".join([*(n for pair in page_maker._NAMES.values() for n in pair), *(s for said in page_maker._SAID.values() for s in said)]).lower()
    for name in ("testata", "voci", "pezzo", "fondo", "voorpagina", "kitchen notes", "strona", "alpine gazette"):
        assert name not in told


def test_texts_without_spaces_have_words():
    assert words_of("東京都の空") == ["東京", "京都", "都の", "の空"] and words_of("Two Words, é") == ["two", "words", "é"] and words_of("の") == ["の"]


def test_a_long_page_beside_short_ones():
    """50,000 blocks among 127 small pages: the same scores as alone, in bounded memory."""
    code = """
import numpy as np, resource
from attesta.llm.blocks import blocks
from attesta.llm.html_text import Labeller, features
model = Labeller()
rows = ''.join(f'<tr><td>cell {i} of many<td>{i % 9} more' for i in range(25_000))
pages = [features(blocks(f'<p>one {i}<p>two')) for i in range(127)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
pages.append(features(blocks(f'<table>{rows}</table>')))
assert len(pages[-1]) == 50_000
got = model.label(pages)
assert len(got[-1]) == 50_000 and all(len(g) == 2 for g in got[:-1])
assert np.allclose(got[3], model.label([pages[3]])[0], atol=1e-5)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(out.stdout.split()[-1]) < 500


def test_groups_of_pages_give_the_same(monkeypatch):
    from attesta.llm import html_text

    model = Labeller(5)
    pages = [features(blocks("<p>x y z" * n)) for n in (0, 1, 5, 40, 3, 0, 7, 7, 60)]
    want = model.label(pages)
    monkeypatch.setattr(html_text, "PLACES", 20)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(want, model.label(pages))) and PLACES > 20
    assert [len(g) for g in html_text._groups(["<p>a<p>b"] * 25 + [None])] == [10, 10, 6]


def test_the_model_is_stored(spark, model, monkeypatch):
    from attesta.llm import html_text

    first = fitted(spark)
    monkeypatch.setattr(html_text, "trained", lambda: pytest.fail("trained again"))
    again = fitted(spark)
    assert all((again.w[k] == first.w[k]).all() for k in first.w)


if __name__ == "__main__":
    for k, v in measured(trained()).items():
        print(k, *(round(float(x), 2) for x in v))
    print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, "MB")
