import hashlib
import random
from collections import Counter

import pytest

from gleanspark.llm.queries import QUERIES
from gleanspark.llm.runlength import RunLengthIndex, without_repeats
from tests.conftest import SMALL
from tests.llm.cases import ROWS, no_docs, odd_docs


def cut(rows, length):
    """Bytes, removed bytes, removed runs and what is left, by counting every string."""
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for doc, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def of(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in frame.collect()), key=str)


def test_index_finds_what_counting_finds():
    rnd = random.Random(5)
    for _ in range(200):
        length, letters = rnd.choice([3, 5, 9, 12]), rnd.choice(["a", "ab", "abc", "abcdefgh"])
        base = "".join(rnd.choice(letters) for _ in range(rnd.randint(5, 60)))
        texts = []
        for _ in range(rnd.randint(1, 8)):
            at = rnd.randrange(len(base))
            more = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
            texts.append((base[at : at + rnd.randint(0, 40)] + more).encode())
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1}
        found = zip(*RunLengthIndex(texts).repeated(length))
        assert {(int(k), i) for k, a, z in found for i in range(a, z + 1)} == want


def test_runs_are_few_where_texts_repeat():
    rnd = random.Random(1)
    text = bytes(rnd.choice(b"abcdefgh") for _ in range(3000))
    one, many = RunLengthIndex([text]), RunLengthIndex([text] * 10)
    # every copy adds its own end, and little else
    assert len(many.heads) < len(one.heads) + 200


@pytest.mark.parametrize("shard_bytes", [1 << 20, 3000, 200])
def test_corpus_against_counting(spark, shard_bytes):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(200)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    common, line = prose(14), prose(9)
    texts = []
    for _ in range(60):
        text = prose(rnd.randint(0, 30)) + common + prose(rnd.randint(0, 30)) + line + prose(rnd.randint(0, 4))
        texts.append(text)
        if rnd.random() < 0.3:
            k = rnd.randrange(len(text))
            texts.append(text[:k] + "#" + text[k + 1 :])
    texts += [prose(1), "", "x" * 300, "xy" * 200, common * 3, texts[0]]
    rows = [(i, t.encode()) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert of(without_repeats(frame, length=64, gram=16, shard_bytes=shard_bytes)) == cut(rows, 64)


def test_query_against_counting(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = [
        (d, n, gone, runs, hashlib.sha256(kept).hexdigest())
        for d, n, gone, runs, kept in cut([(r.doc_id, r.text.encode()) for r in docs], 400)
    ]
    got = QUERIES["op4_runlength"](spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(w[2] for w in want)


def test_odd_rows(spark):
    assert of(without_repeats(odd_docs(spark), length=40, gram=16)) == cut([(i, (t or "").encode()) for i, t in ROWS], 40)
    assert without_repeats(no_docs(spark)).count() == 0
