import base64
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer, models

from gleanspark.llm.bpe import decode, encode, loaded, round_trip
from gleanspark.llm.queries import QUERIES
from gleanspark.llm.unigram import Unigram, counted
from gleanspark.llm.unigram import loaded as loaded_pieces
from tests.conftest import SMALL
from tests.llm.cases import ROWS, no_docs, odd_docs

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(3)
    letters = "abcdeé ñ日\U0001f600\n1'st"
    texts = ["", "a" * 60_000, " " * 5000 + "x", "ab" * 3000, "абв" * 300, "=-" * 500, "don't we'll", "<|endoftext|>", "▁ ▁"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    return texts + ["".join(rnd.choice("et") for _ in range(2000)) for _ in range(5)]


def test_ids_are_the_librarys(library):
    texts = odd_texts()
    flat, ends = loaded(PATH, PATTERN).encode_all(texts)
    for text, a, b in zip(texts, ends[:-1], ends[1:]):
        assert flat[a:b].tolist() == library.encode_ordinary(text)
        assert loaded(PATH, PATTERN).decode(flat[a:b].tolist()) == text.encode()


def test_encode_query(spark, library):
    got = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode_ordinary(doc.text)
        assert got[doc.doc_id].n_tokens == len(ids)
        assert got[doc.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc.doc_id].decoded_sha256 == hashlib.sha256(doc.text.encode()).hexdigest()


def test_encode_odd_rows(spark, library):
    docs = odd_docs(spark)
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS), key=str)
    both = round_trip(docs, PATH, PATTERN, kept=["doc_id"])
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in both.collect()), key=str) == want
    ids = encode(docs, PATH, PATTERN, kept=["doc_id"])
    back = decode(ids, PATH, PATTERN).select("doc_id", "decoded").collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back), key=str) == sorted(((i, d) for i, _, d in want), key=str)
    assert encode(no_docs(spark), PATH, PATTERN).count() == 0


def pieces():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_are_the_librarys(fallback):
    rows = pieces()
    more = [(f"<0x{b:02X}>", 0.0) for b in range(256)] if fallback else []
    whole = Tokenizer(models.Unigram([("<unk>", 0.0), *rows, *more], 0, fallback))
    own = Unigram(rows, fallback)
    assert own.by_unit
    for text in [t for t in odd_texts() if len(t) < 5000] + [" ", "  a", "a  ", "\n\n", "\U0001f600\U0001f601 \U0001f600"]:
        marked = "▁" + text.replace(" ", "▁")
        assert own.count(text)[0] == (len(whole.encode(marked).ids) if text else 0)
        assert not text or own.count(text) == own.unit(marked)


@pytest.mark.parametrize("fallback", [True, False])
def test_ties_and_unknowns_are_the_librarys(fallback):
    rnd = random.Random(6)
    for _ in range(60):
        made = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 9))}
        rows = [(p, float(-rnd.randint(0, 3))) for p in sorted(made)]
        whole = Tokenizer(models.Unigram([("<unk>", 0.0), *rows], 0, False))
        own = Unigram(rows, fallback)
        for _ in range(20):
            text = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12)))
            found = whole.encode(text)
            lost = sum(len(t) for t, i in zip(found.tokens, found.ids) if i == 0)
            want = len(found.ids) if not fallback else sum(i != 0 for i in found.ids) + lost
            assert own.unit(text)[0] == want, (rows, text)


def test_count_query_and_odd_rows(spark):
    model = loaded_pieces(PIECES, True)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.score) for r in QUERIES["op5_token_counts"](spark, SMALL).collect()}
    assert got == {r.doc_id: model.unit("▁" + r.text.replace(" ", "▁")) for r in docs}
    odd = counted(odd_docs(spark), PIECES).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in odd), key=str) == sorted(((i, model.count(t or "")[0]) for i, t in ROWS), key=str)
    assert counted(no_docs(spark), PIECES).count() == 0
