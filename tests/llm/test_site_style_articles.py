from gleanspark.llm.site_style import _said, parsed
from tests.llm.test_site_style import made, shown

OFFER = "<article><h2>Offer</h2><p>Half price today.</p></article>"


def own(i, more="", host="a.example"):
    return (
        f"http://{host}/{i}",
        f"<html><body><article><h1>Title {i}</h1><p>Text {i}.</p><p>On this host.</p></article>{more}</body></html>",
    )


def whole(i):
    return f"Title {i}\n\nText {i}.\n\nOn this host."


def test_an_article_that_a_host_repeats_goes_beside_others(spark):
    rows = [own(i, OFFER) for i in range(9)] + [own(i, OFFER, "b.example") for i in range(3)]
    got = made(spark, rows)
    assert [got[i] for i in range(9)] == [whole(i) for i in range(9)]
    # too few pages to tell
    assert [got[9 + i] for i in range(3)] == [whole(i) + "\n\nOffer\n\nHalf price today." for i in range(3)]


def test_inside_main_and_alone(spark):
    def within(row):
        return row[0], row[1].replace("<body>", "<body><main>").replace("</body>", "</main></body>")

    got = made(spark, [within(own(i, OFFER)) for i in range(9)])
    assert [got[i] for i in range(9)] == [whole(i) for i in range(9)]
    alone = [(f"http://c.example/{i}", f"<body><div><p>Word {i}</p></div>{OFFER}</body>") for i in range(9)]
    assert set(made(spark, alone).values()) == {"Offer\n\nHalf price today."}  # the only article


def test_remembered_tags_are_told_apart():
    _said.cache_clear()
    pages = ["<p class=ad>x</p><div class=ad>y</div><p>z", "<header>a</header><main><header>b</header></main>"]
    assert [shown(p) for p in pages * 2] == ["z", "b"] * 2
    long = "x" * 600
    assert shown(f"<p title='{long}' class=ad>x</p><p title='{long}'>y") == "y"
    assert _said.cache_info().currsize < 8 and parsed(b"").children == []
