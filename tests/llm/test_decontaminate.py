import random
import re

import pytest

from gleanspark.llm.decontaminate import contamination, without_contaminated
from tests.llm.cases import ROWS, no_docs, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for item, body in items:
            v = words(body)
            size = min(window, len(v))
            parts = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
            for s in range(len(w) - size + 1 if v else 0):
                if tuple(w[s : s + size]) in parts:
                    hit.update(range(s, s + size))
                    named.add(item)
        out.append((doc, len(w), len(hit), sorted(str(i) for i in named if i is not None)))
    return sorted(out, key=str)


def of(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in frame.collect()), key=str)


@pytest.mark.parametrize("broadcast", [0, 400_000])
def test_windows_of_all_sizes(spark, monkeypatch, broadcast):
    monkeypatch.setattr("gleanspark.llm.decontaminate.BROADCAST_WINDOWS", broadcast)
    rnd = random.Random(2)
    vocabulary = ["the", "of", "Ab", "c3", "É", "naïve", "日本", "x"] + [f"w{i}" for i in range(40)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rnd.choice((1, 3, 4, 5, 7, 10, 11, 25))))) for i in range(25)]
    items += [(100, ""), (101, None), (102, "-- !"), (103, items[3][1]), (None, "only the nameless item")]
    docs = []
    for i in range(60):
        text = prose(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(text))
            text[at:at] = (rnd.choice(items)[1] or "").split()
        docs.append((i, rnd.choice((" ", ", ", "\n")).join(text)))
    docs.append((70, "Only The nameless ITEM"))
    got = contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    want = brute(docs, items)
    assert of(got) == want and sum(w[2] for w in want) > 100


def test_odd_rows(spark):
    items = spark.createDataFrame(
        [(1, "three four FIVE six seven eight nine ten eleven twelve"), (2, "ünïcode"), (3, None)], "item_id long, text string"
    ).selectExpr("*", "1 AS words", "2 AS token")
    rows = [(r.item_id, r.text) for r in items.collect()]
    assert of(contamination(odd_docs(spark), items)) == brute(ROWS, rows)
    clean = without_contaminated(odd_docs(spark), items)
    assert clean.columns == odd_docs(spark).columns
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == ["1", "2", "3", "6", "7", "8", "None", "None"]
    assert contamination(no_docs(spark), items).count() == 0
    assert all(r.n_hit == 0 for r in contamination(odd_docs(spark), items.where("false")).collect())
