import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks import compare as comparing
from gleanspark.llm import near_copies
from gleanspark.llm.near_copies import one_of_each, shingles
from gleanspark.llm.queries import ORACLE, QUERIES
from gleanspark.llm.simhash import fingerprint
from tests.conftest import SMALL
from tests.llm.cases import ROWS, no_docs, odd_docs


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, monkeypatch, name):
    monkeypatch.setattr(comparing, "QUERIES", QUERIES)
    monkeypatch.setattr(comparing, "ORACLE", ORACLE)
    assert comparing.compare(spark, comparing.connect(SMALL), SMALL, name) is None


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def similar(a, b):
    both = len(a & b)
    return both >= 0.8 * (len(a) + len(b) - both)


def first_of_each(rows):
    sets = {i: set(shingles((t or "").encode()).tolist()) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in sets if find(i) == i)


def test_near_copies_by_all_pairs(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    shared = " ".join(rnd.choice(words) for _ in range(40))
    rows = []
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(120, 400))]
        rows.append(" ".join(base))
        for _ in range(rnd.choice((0, 1, 4))):
            copy = [rnd.choice(words) if rnd.random() < 0.01 else w for w in base]
            rows.append(rnd.choice((" ", "\n")).join(copy).upper())
        # a passage in common does not make copies
        rows.append(" ".join(rnd.choice(words) for _ in range(200)) + " " + shared)
    rnd.shuffle(rows)
    numbered = list(enumerate(rows))
    kept = [r.doc_id for r in one_of_each(spark.createDataFrame(numbered, "doc_id long, text string")).collect()]
    want = first_of_each(numbered)
    assert sorted(kept) == want and len(want) < len(rows) - 20


def test_near_copies_of_odd_rows(spark):
    got = one_of_each(odd_docs(spark))
    assert got.columns == odd_docs(spark).columns
    assert sorted((str(r.doc_id) for r in got.collect())) == sorted(["1", "4", "6", "8", "None", "None"])
    assert one_of_each(no_docs(spark)).count() == 0


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert 0 < len(rows) <= left
        left, docs = len(rows), spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id: r.decoded_text for r in last} == {r.doc_id: r.text for r in docs.collect()}


def test_stages_take_odd_rows(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr(
        "*", "'en' AS lang", "'s' AS source", "1L AS n_chars"
    )
    for docs in (plain, plain.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SMALL).count() <= len(ROWS)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and all(r.ids for r in rows if r.decoded_text)


def left_of(spark, texts):
    kept = one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return sorted(r.doc_id for r in kept)


def made(rnd, count, name="w"):
    return [f"{name}{rnd.randrange(10**9)}" for _ in range(count)]


@pytest.mark.parametrize("place", ["middle", "last"])
def test_near_copies_of_one_base_are_one_group(spark, place):
    rnd = random.Random(5)
    base, texts = made(rnd, 200), []
    for _ in range(150):
        words = list(base)
        for at in rnd.sample(range(4, 196), 4):
            words[at] = made(rnd, 1)[0]
        texts.append(" ".join(words))
    texts.insert(75 if place == "middle" else 150, " ".join(base))
    want = first_of_each(list(enumerate(texts)))
    assert left_of(spark, texts) == want and len(want) == 1


def test_near_copies_of_short_texts_and_at_the_border(spark):
    rnd = random.Random(8)
    texts = []
    for size in [*range(8, 61, 4), 84, 104, 204]:
        for edits in (1, 2, size // 10, size // 5, (size - 4) // 4, (size - 4) // 4 + 1):
            base = made(rnd, size)
            texts += [" ".join(base), " ".join(base + made(rnd, edits)), " ".join(made(rnd, edits) + base)]
            # a run of changed words costs edits + 4 shingles on either side
            texts.append(" ".join(made(rnd, edits) + base[edits:]))
    want = first_of_each(list(enumerate(texts)))
    assert left_of(spark, texts) == want and len(want) < len(texts) * 2 // 3


def test_near_copies_through_a_text_two_bits_from_another(spark):
    rnd = random.Random(3)
    while True:
        base, more = made(rnd, 404), made(rnd, 101)
        texts = [" ".join(base), " ".join(base[:-1]), " ".join(base + more[:100])]
        texts[0], texts[1] = texts[1], texts[0]
        if (fingerprint(texts[0].encode(), 5) ^ fingerprint(texts[1].encode(), 5)).bit_count() <= 2:
            break
    sets = [set(shingles(t.encode()).tolist()) for t in texts]
    assert similar(sets[1], sets[2]) and not similar(sets[0], sets[2])
    assert left_of(spark, texts) == [0]


def test_near_copies_with_a_line_repeated_in_one(spark):
    rnd = random.Random(4)
    words, line = made(rnd, 300), made(rnd, 12)
    assert left_of(spark, [" ".join(words + line), " ".join(words + line * 60)]) == [0]


def test_a_repeated_line_alone_makes_no_copies(spark):
    rnd = random.Random(6)
    texts = []
    for _ in range(60):
        line = made(rnd, 11) * 60
        texts += [" ".join(line + made(rnd, 40)) for _ in range(2)]
    prints = [fingerprint(t.encode(), 5) for t in texts]
    assert any((a ^ b).bit_count() <= 2 for a, b in zip(prints[::2], prints[1::2], strict=True))
    assert left_of(spark, texts) == list(range(120))


def test_near_copies_in_many_small_cells(spark, monkeypatch):
    rnd = random.Random(7)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near_copies, "TASK_ROWS", 64)
    texts = []
    for _ in range(4):
        base = made(rnd, 60)
        texts += [" ".join(base + made(rnd, k)) for k in range(0, 28)]
    want = first_of_each(list(enumerate(texts)))
    assert left_of(spark, texts) == want


def test_near_copies_are_looked_for_in_simhash_groups(spark):
    far = 255 << 20
    printed = spark.createDataFrame(
        [(1, 0, 10), (2, 3, 20), (3, far, 30), (4, far + 1, 40), (5, 255 << 40, 50)], "doc_id long, fingerprint long, set_id long"
    )
    classes = spark.createDataFrame([(10, [1]), (20, [2]), (30, [3]), (40, [4]), (50, [3])], "set_id long, bands array<long>")
    found = near_copies._grouped(printed, classes).collect()
    assert sorted((r.a, r.b) for r in found) == [(20, 10), (40, 30), (50, 30)]


def test_near_copies_stage_checks_simhash_links(spark, monkeypatch):
    rnd = random.Random(6)
    texts = []
    for _ in range(60):
        line = made(rnd, 11) * 60
        texts += [" ".join(line + made(rnd, 40)) for _ in range(2)]
    real, held = near_copies.stored, {}

    def stored(df, name):
        held[name] = real(df, name)
        return held[name]

    monkeypatch.setattr(near_copies, "stored", stored)
    assert left_of(spark, texts) == list(range(120))
    sets = [int(near_copies._set_id(shingles(t.encode()))) for t in texts]
    prints = [fingerprint(t.encode()) for t in texts]
    near = [i for i in range(0, 120, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 2]
    looked = {frozenset((r.a % 2**64, r.b % 2**64)) for r in held["near-grouped"].collect()}
    assert near and all(frozenset((sets[i], sets[i + 1])) in looked for i in near)
    assert held["links-grouped"].count() == 0
