import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gleanspark.llm.divergence import pair_value, reordered, runs, shares, source_divergence
from gleanspark.llm.queries import ORACLE, QUERIES
from tests.llm.cases import CLASHING, ROWS, no_docs, odd_docs

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least):
    """The definition, one term at a time, in Python's integers; rows of lang, source, text."""
    rows = [(lang or "", source or "", text or "") for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        found, counts = Counter(), {s: Counter() for spoken, s, _ in rows if spoken == lang}
        for spoken, source, text in rows:
            if spoken == lang:
                terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
                counts[source].update(terms)
                found.update(set(terms))
        kept = [t for t, n in found.items() if n >= least]
        share = {}
        for source, c in counts.items():
            total = sum(c[t] for t in kept)
            share[source] = {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        everywhere = {t: sum(c[t] for c in counts.values()) for t in kept}
        total = sum(everywhere.values())
        q = {t: 1 + 10**9 * (everywhere[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for a in counts:
            pairs = [(sum(f(share[a][t], share[b][t]) for t in kept), b) for b in counts if b != a]
            terms = [(f(share[a][t], q[t]), t) for t in kept if counts[a][t] and share[a][t] > q[t]]
            for part, found_ in (("pair", pairs), ("term", terms)):
                ranked = sorted(found_, key=lambda x: (-x[0], x[1].encode()))
                ranked = ranked[:10] if part == "term" else ranked
                out += [(lang, a, part, item, v, k) for k, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def of(frame):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in frame.collect())


def made(n, seed):
    rnd = random.Random(seed)
    words = ["The", "of", "été", "日本", "ÉTÉ", "x1y", "it's"] + [f"{c}{d}" for c in "abcdefg" for d in "hijklm"]
    sources = [None, "", "web", "books", "Ünï", "a", "b"]
    return [
        (rnd.choice(["en", "en", "en", "fr", None]), rnd.choice(sources), " ".join(rnd.choices(words, k=rnd.randint(0, 30))))
        for _ in range(n)
    ]


@pytest.mark.parametrize(("block", "tile", "held"), [(4096, 128, 300_000), (5, 2, 10)])
def test_as_the_definition(spark, block, tile, held):
    rows = made(300, 3) + [("few", "a", "alpha beta"), ("few", "b", None), ("one", "only", "gamma " * 50)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    for least in (10, 1):
        assert of(source_divergence(docs, least, 10, block, tile, held)) == brute(rows, least)
    zero = [r for r in of(source_divergence(docs, 10, 10, block, tile, held)) if r[0] == "few"]
    assert zero == [("few", "a", "pair", "b", 0, 1), ("few", "b", "pair", "a", 0, 1)]


def test_query_as_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({ORACLE['op11_divergence']})").fetchall()
    assert of(QUERIES["op11_divergence"](spark, folder)) == sorted(want)


def test_shares_are_exact():
    rnd = np.random.default_rng(1)
    counts = rnd.integers(0, 3 * 10**14, 50)
    total = int(counts.sum())
    assert shares(counts, total, 50).tolist() == [1 + 10**9 * (c + 2) // (total + 100) for c in counts.tolist()]
    with pytest.raises(OverflowError):
        shares(counts, 10**16, 50)


def test_runs_are_few_and_pairs_whole():
    rnd = np.random.default_rng(2)
    counts = rnd.integers(0, 3, (4, 500))
    ordered = counts[:, reordered(counts)]
    assert sum(len(runs(r)) for r in ordered) < sum(len(runs(r)) for r in counts) / 2
    some, other = [(runs(r), shares(r[runs(r)], int(r.sum()), 500)) for r in ordered[:2]]
    p, q = (shares(r, int(r.sum()), 500) for r in ordered[:2])
    assert pair_value(some, other, 500) == int(((p - q) ** 2 // (p + q)).sum())


def test_odd_rows(spark):
    docs = odd_docs(spark).drop("lang", "source").selectExpr("*", "if(doc_id < 5, 'en', null) AS lang", "'x' AS source")
    assert set(CLASHING) < set(docs.columns)
    rows = [("en" if i and i < 5 else None, "x", t) for i, t in ROWS]
    assert of(source_divergence(docs, min_docs=1)) == brute(rows, 1)
    assert source_divergence(no_docs(spark).selectExpr("*", "'' AS lang", "'' AS source")).count() == 0
