import re
import time

import pytest
from pyspark.sql import functions as F

from gleanspark.llm import surrogates
from gleanspark.llm.queries import QUERIES
from gleanspark.llm.surrogates import assign, with_surrogates
from tests.conftest import SMALL
from tests.llm.cases import HARD, ROWS, no_docs, odd_docs

FOUND = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+\w|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|\+1 \(\d+\) [\d-]+|AKIA\w{16}|\b[0-9a-f]{40}\b")


def replaced(spark, *texts, key="k"):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in with_surrogates(frame, key).orderBy("doc_id").collect()]


def luhn(number):
    digits = [int(d) for d in re.sub(r"\D", "", number)][::-1]
    return sum(digits[0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])


def test_query_leaves_no_mention_and_nothing_else_changed(spark):
    before = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    after = {r.doc_id: r for r in QUERIES["op1_surrogates"](spark, SMALL).collect()}
    real = {m for r in before.values() for m in FOUND.findall(r.text)}
    made = {m for r in after.values() for m in FOUND.findall(r.text)}
    assert len(real) > 10 and not real & made and len(real) == len(made)
    for i, old in before.items():
        new = after[i]
        assert (old.lang, old.source, old.n_chars) == (new.lang, new.source, new.n_chars)
        # outside the mentions nothing is touched
        assert FOUND.split(old.text) == FOUND.split(new.text) or "password" in old.text
        assert new.n_entities > 0 or new.text == old.text


def test_one_entity_one_surrogate_in_every_format(spark):
    a, b, c = replaced(
        spark,
        "Mail Ann.Lee@corp.com or ANN.LEE@CORP.COM; call +49 30 1234567.",
        "ann.lee@corp.com, +49-30-1234567, card 4111 1111 1111 1111",
        "4111-1111-1111-1111 and 4012888888881881",
    )
    mails = re.findall(r"[\w.]+@[\w.]+\w", a)
    assert len(mails) == 2 and mails[0].upper() == mails[1] and mails[0] in b and "corp" not in a
    assert re.sub(r"\D", "", a.split("call")[1]) == re.sub(r"\D", "", b.split(",")[1])
    cards = [re.search(r"4\d{3} \d{4} \d{4} \d{4}", b)[0], re.search(r"4\d{3}-\d{4}-\d{4}-\d{4}", c)[0], c.split()[-1]]
    assert re.sub(" ", "-", cards[0]) == cards[1] and all(luhn(n) % 10 == 0 for n in cards)
    assert cards[2] != re.sub("-", "", cards[1])


def test_names_keep_title_gender_and_script(spark):
    (text,) = replaced(spark, "Mr. John Smith met Mrs Smith; Г-жа Анна Иванова и Г-жа Иванова. Mr Jones was there.")
    found = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+); Г-жа (\w+) (\w+) и Г-жа (\w+)\. Mr (\w+) was there\.", text)
    given, family, again, anna, hers, his, jones = found.groups()
    assert family == again != jones and hers == his and "Smith" not in text
    assert re.search("(o|us|ert)$", given) and re.search("(а|ина|ия)$", anna)
    assert re.fullmatch("[А-Яа-я]+", anna + hers) and re.fullmatch("[A-Za-z]+", given + family)


def test_key_decides_and_clean_text_stays(spark):
    text = "From 10.1.2.3 at bob@x.org"
    assert replaced(spark, text) == replaced(spark, text) != replaced(spark, text, key="other")
    clean = "Version 2.0, CC BY-NC 4.0, 1999-2003, 3.14, the token of it, Dr, e@, a 12 b 34567."
    assert replaced(spark, clean) == [clean]


def test_collisions_are_settled(spark, monkeypatch):
    def narrow(kind, entity, key, attempt):
        # ten names for twelve entities at first, three of them real
        made = F.concat(F.lit("e"), F.pmod(F.xxhash64(entity, attempt), F.lit(10) * (attempt + 1)).cast("string"))
        return entity, made

    monkeypatch.setattr(surrogates, "surrogate", narrow)
    frame = spark.createDataFrame([("ssn", f"e{i}") for i in (0, 1, 2, *range(50, 59))], "kind string, entity string")
    rows = assign(frame, "k").collect()
    made = [r.surrogate for r in rows]
    assert len(rows) == 12 and len(set(made)) == 12 and not set(made) & {r.entity for r in rows}


@pytest.mark.parametrize("count", [None, "found_here"])
def test_odd_rows(spark, count):
    got = with_surrogates(odd_docs(spark), "k", count=count)
    assert got.columns == odd_docs(spark).columns + ([count] if count else [])
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(ROWS, key=str)
    assert with_surrogates(no_docs(spark), "k").count() == 0


def test_cues_in_any_case_and_json(spark):
    token, word = "9233a8ec" * 5, "Hunter2Hunter2"
    got = replaced(
        spark,
        f'TOKEN = "{token.upper()}" here',
        f'{{"token": "{token}"}}',
        f"Password: {word} and API_KEY={word}_abcd",
        f"'Secret' : '{word}_abcd', \"PWD\":\"{word}\"",
        "MR. JOHN SMITH met MRS SMITH; Г-ЖА ИВАНОВА and mr. Smith.",
    )
    assert not any(re.search(f"{token}|{word}|smith|john|иванов", text, re.I) for text in got)
    upper, lower = re.fullmatch('TOKEN = "([0-9A-F]{40})" here', got[0])[1], re.fullmatch(r'\{"token": "([0-9a-f]{40})"\}', got[1])[1]
    assert upper.lower() == lower
    assert re.fullmatch(r"Password: [A-Z]\w+ and API_KEY=[A-Z]\w+_[a-z]{4}", got[2])
    names = re.fullmatch(r"MR\. ([A-Z]+) ([A-Z]+) met MRS ([A-Z]+); Г-ЖА [А-Я]+ and mr\. (\w+)\.", got[4])
    assert names[2] == names[3] == names[4].upper()


def test_long_runs_take_no_time(spark):
    frame = spark.createDataFrame([(t,) for t in HARD], "text string").coalesce(1)
    found = frame.select(F.size(F.regexp_extract_all("text", F.lit(surrogates.MENTION), F.lit(0))).alias("n"))
    begun = time.monotonic()
    assert [r.n for r in found.collect()] == [0] * len(HARD)
    assert time.monotonic() - begun < 30  # some five seconds; by the square of a run it took minutes
    assert replaced(spark, *HARD) == HARD
    long = "a" * 200 + "@corp.com"
    (text,) = replaced(spark, f"(.ann@corp.com) {long} x..bob.lee+1@mail.corp.co.uk.")
    assert "corp" not in text and "ann" not in text and "bob" not in text and "a" * 100 not in text


def test_more_entities_than_surrogates(spark):
    digits = spark.createDataFrame([("secret", str(i)) for i in range(10)], "kind string, entity string")
    made = {r.surrogate for r in assign(digits, "k").collect()}
    assert len(made) == 10 and all(len(m) > 1 for m in made)  # none of one digit is free
    with pytest.raises(ValueError, match="for kinds ssn"):
        assign(digits.withColumn("kind", F.lit("ssn")), "k", rounds=2)
