import random
import re
import shutil
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleanspark.llm import phrases, shared
from gleanspark.llm.phrases import _brought, _score, collocations, tiled, words_of
from gleanspark.llm.queries import ORACLE, QUERIES
from tests.llm.cases import ROWS, no_docs, odd_docs


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, top):
    out = []
    for lang in {r or "und" for r, _ in rows}:
        words = [p for r, t in rows if (r or "und") == lang for p in pieces(t)]
        n = sum(map(len, words))
        f = Counter(tuple(p[i : i + k]) for p in words for k in range(1, 6) for i in range(len(p) - k + 1))
        f = {w: c for w, c in f.items() if c >= least}
        inside = {}
        for w, c in f.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    inside[w[i : i + k]] = max(c, inside.get(w[i : i + k], 0))
        found = []
        for w, a in f.items():
            if len(w) > 1 and inside.get(w, 0) < a:
                score, k = min((1000 * a * n // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
                found.append((" ".join(w), a, f[w[:k]], f[w[k:]], n, score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i, *x) for i, x in enumerate(found[:top], 1)]
    return sorted(out)


def of(frame):
    return sorted(tuple(r) for r in frame.collect())


def made(n, seed):
    rnd = random.Random(seed)
    words = ["The", "of", "a", "a", "été", "日本 語", "x\x01y", "New", "York"] + [f"w{i}" for i in range(25)]
    fixed = ["New York City", "a a a", "of the THE of", "one two three four five six"]
    rows = []
    for _ in range(n):
        text = []
        for _ in range(rnd.randint(0, 12)):
            text += [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(words), rnd.choice(" \t, . \n;  ! ?\r")]
        rows.append((rnd.choice(["en", "en", "fr", None, "und"]), "".join(x if x.strip() else f"{x} " for x in text)))
    return rows


@pytest.mark.parametrize(("chunk", "tile", "top", "sent"), [(16 << 20, 1024, 2000, 1 << 20), (700, 4, 7, 0), (700, 4, 2000, 1 << 20)])
def test_as_counting_every_phrase(spark, chunk, tile, top, sent):
    rows = made(300, 5)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute(rows, 5, top)
    assert of(collocations(docs, 5, top, chunk, tile, sent)) == want
    assert {len(w[2].split(" ")) for w in brute(rows, 5, 2000)} == {2, 3, 4, 5}


def test_query_as_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert of(QUERIES["op12_collocations"](spark, folder)) == sorted(con.execute(ORACLE["op12_collocations"]).fetchall())


@pytest.mark.parametrize("tile", [1, 4, 64])
def test_tiles_count_every_pair(tile):
    rnd = np.random.default_rng(tile)
    x, y = rnd.zipf(1.3, 5000) % 90, rnd.zipf(1.3, 5000) % 90
    left, right, counts, place = tiled(x, y, 90, tile)
    pairs = list(zip(left.tolist(), right.tolist(), strict=True))
    assert dict(zip(pairs, counts.tolist(), strict=True)) == Counter(zip(x.tolist(), y.tolist(), strict=True))
    assert [pairs[i] for i in place] == list(zip(x.tolist(), y.tolist(), strict=True))


def test_words_and_pieces():
    words, counts, seq = words_of("A b,B\n\n c\td. ".encode())
    assert (words.to_pylist(), counts.tolist()) == ([b"a", b"b", b"c", b"d"], [1, 2, 1, 1])
    assert seq.tolist() == [0, 1, -1, 1, -1, 2, 3]
    assert len(words_of(b"")[0]) == len(words_of(b" ., \n")[0]) == 0


def test_scores_pass_64_bits(spark):
    rnd = random.Random(4)
    rows = [(a, rnd.randint(a, 10**14), rnd.randint(a, a * 3), rnd.randint(a, a * 9)) for a in (100, 10**9, 10**12, 9 * 10**12)]
    frame = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = frame.select(_score(*(F.col(c) for c in "anlr")).cast("long").alias("s"), "*").collect()
    assert [r.s for r in got] == [1000 * r.a * r.n // (r.l * r.r) for r in got]


def test_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "if(doc_id < 6, 'en', null) AS lang")
    rows = [("en" if i and i < 6 else None, t) for i, t in ROWS]
    assert of(collocations(docs, 2)) == brute(rows, 2, 2000)
    assert collocations(no_docs(spark).selectExpr("*", "'' AS lang")).count() == 0
    assert collocations(docs, 10**6).count() == 0


def test_few_files_and_no_large_rows_by_spark(spark, tmp_path, monkeypatch):
    """Spark's writer starts a process for each file of a local folder, and holds each row of a chunk whole."""
    for module in (phrases, shared):
        monkeypatch.setattr(module, "shared_folder", lambda _: f"file://{tmp_path}", raising=False)
    rows, before = made(400, 8), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
        assert of(collocations(docs, 5)) == brute(rows, 5, 2000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tables = [p for p in tmp_path.iterdir() if any(p.glob("_SUCCESS"))]
    assert len(tables) >= 10
    assert max(len(list(p.glob("part-*"))) for p in tables) < 12
    assert not [p for p in tables if "chunks" in p.name]
    for file in tmp_path.glob("*/symbols/*.parquet"):
        for row in pq.read_table(file).to_pylist():
            assert sum(len(v) for v in row.values() if isinstance(v, list)) <= 3 * 400


def test_files_of_failed_attempts_are_not_read(spark):
    docs = spark.createDataFrame([("en", "a b a"), ("fr", "c")], "lang string, text string").repartition(1)
    chunks = phrases._word_chunks(docs, 1 << 20)
    folder = Path(chunks.folder.removeprefix("file://"))
    for kind in ("symbols", "texts"):
        (file,) = (folder / kind).iterdir()
        shutil.copy(file, file.with_name("part-00000-other.parquet"))
    words = chunks.symbols(spark).select("lang", F.col("word").cast("string"), "count")
    assert of(words) == [("en", "a", 2), ("en", "b", 1), ("fr", "c", 1)]
    assert sorted(text.tolist() for _, text in chunks.read(0, [])) == [[0], [0, 1, 0]]


def test_brought_rows_of_a_chunk_meet_across_batches():
    batches = [[], [(3, 0, 9), (3, 4, 8)], [(3, 5, 7)], [(3, 6, 1), (1 << 32, 2, 5), (1 << 33, 0, 0)], [(1 << 33, 1, 4)]]
    columns = [[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] for rows in batches]
    got = [(c, at.tolist(), ids.tolist()) for c, at, ids in _brought(pa.RecordBatch.from_arrays(x, ["chunk", "at", "id"]) for x in columns)]
    assert got == [(3, [0, 4, 5, 6], [9, 8, 7, 1]), (1 << 32, [2], [5]), (1 << 33, [0, 1], [0, 4])]
