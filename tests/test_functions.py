"""Edge cases of hashing, content and display functions."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gleanspark.functions import content, display, hashing


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    return [r["r"] for r in df.select("i", expression.alias("r")).orderBy("i").collect()]


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_md5_parts(spark):
    df = spark.createDataFrame([("hello world", "ab", "c", "a", "bc")], "t string, a string, b string, c string, d string")
    row = df.select(
        hashing.md5_parts(["t"]).alias("one"),
        hashing.md5_parts(["a", "b"]).alias("left"),
        hashing.md5_parts(["c", "d"]).alias("right"),
        hashing.md5_parts([hashing.canonical_json(F.lit('{"key":"value"}'))], short=True).alias("short"),
    ).first()
    assert row["one"] == "5eb63bbbe01eeed093cb22bb8f5acdc3"
    assert row["left"] == row["right"]  # no delimiter between parts
    assert row["short"] == "ddce808de0032747"


JSON_TEXTS = [
    "{}",
    "[]",
    '{"a": 1}',
    '{"a": "x y", "b": -20, "c": 0}',
    '{"a":1,"b":"tight"}',
    '{"a": {"b": [1, 2.50, 1e5, true, false, null]}}',
    '{"q": "it\'s"}',
    '{"q": "say \\"hi\\""}',
    '{"q": "tab\\there"}',
    '{"q": "h\\u00e9llo", "r": "é"}',
    '{"a": 1, "a": 2}',
    '{"b": 1, "a": 2}',
    '{"a": -0}',
    '{"a": 1.0}',
    '{"a": "S: N", "N": "S"}',
    '{"a": ", S: N", "b": 10}',
    '{"n": 123456789012345678901234567890}',
    '{"": ""}',
    '"text"',
    "12",
    "null",
    "true",
    None,
    '{"url": "https://example.com/?a=1&b=[x]", "keywords": "a, b: c", "priority": 5}',
]


def test_py_repr_equals_python(spark):
    want = [None if t is None else str(json.loads(t)) for t in JSON_TEXTS]
    assert column(spark, JSON_TEXTS, hashing.py_repr("c")) == want


def test_canonical_json_equals_python(spark):
    want = [
        None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")) for t in JSON_TEXTS
    ]
    assert column(spark, JSON_TEXTS, hashing.canonical_json("c")) == want


ODD_TEXTS = [
    '{"q": "it\'s \\"both\\""}', '{"a": 1, "b": {"z": 1, "y": 2.5, "z": [3]}, "a": []}', "NaN", "[NaN, -Infinity, 1e999]",
    "[-0.0, -0, 1E-5, 0.0001, 1e16, 1e15, 1e22, 12.50e1, 100.0, 0.30000000000000004, 123456789012345680.0]",
    "[5e-324, 1.7976931348623157e308, 2.00, 1e-400, 0e5]", '{"\\ud800": 1, "\\ud83d\\ude00": 2, "\\uffee": 3, "\U0001f600": 4}',
    '["\\u0000\\u00a0\\u2028\u2028\u200b\x7f\\b\\f\\/ \u00e9 \\u0027"]', '{"x": 1, "\\u0078": 2}', "[[[[]]]]", "[" + "1" * 4301 + "]",
    "[1,]", '{"a" 1}', '{"a":1} x', "01", "1.", "[1 2]", '"abc', '{"a":}', "{,}", "]", '"', "-", "", " ", "\u00a0[]", '"a\nb"', "[1]]",
    "[truefalse]", "[" * 300, "[" * 300 + "]" * 300, "plain text",
]


def read_or_none(text, write):
    try:
        return None if text is None else write(json.loads(text))
    except ValueError:
        return None


def test_odd_texts_equal_python(spark):
    rng = random.Random(5)
    texts = list(ODD_TEXTS)
    for _ in range(400):
        text = json.dumps(random_json(rng), ensure_ascii=rng.random() < 0.5).replace('"k k"', '"a"')
        if rng.random() < 0.4 and text:  # cut, repeat or insert a character
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", text[at] * 2, ",", "]", '"', "}", ":"]) + text[at + 1 :]
        texts.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    rows = df.select("i", hashing.py_repr("c").alias("p"), hashing.canonical_json("c").alias("k")).collect()
    for r in rows:
        assert r["p"] == read_or_none(texts[r["i"]], str), texts[r["i"]]
        tight = read_or_none(texts[r["i"]], lambda v: json.dumps(v, sort_keys=True, separators=(",", ":")))
        assert r["k"] == tight, texts[r["i"]]


def test_printing_stays_in_the_jvm_and_takes_long_texts(spark):
    many = json.dumps({f"k{i}": [i, i / 7, "it's \n"] for i in range(300)})
    long = json.dumps({"a": "x'\n" * 20_000})
    repeated = "{" + ", ".join(f'"k{i % 200}": {i}' for i in range(600)) + "}"
    texts = [many, long, repeated, many[:-1], "plain " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = df.select("i", hashing.py_repr("c").alias("p"))
    flat = content.flatten_content(got.withColumnRenamed("p", "content"))
    prints = hashing.task_fingerprint(flat, "canonical", "content_status", "content")
    assert "Python" not in prints._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        assert r["p"] == read_or_none(texts[r["i"]], str)


def random_json(rng, depth=0):
    kind = rng.randrange(8 if depth < 2 else 6)
    if kind < 2:
        return rng.randrange(-50, 1000)
    if kind < 4:
        return "".join(rng.choice("ab '\"\\é,:{}SN0é\n") for _ in range(rng.randrange(6)))
    if kind == 4:
        return rng.choice([True, False, None])
    if kind == 5:
        return rng.choice([0.5, 1e20, -2.0])
    if kind == 6:
        return [random_json(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["a", "b", "k k", "N"]): random_json(rng, depth + 1) for _ in range(rng.randrange(3))}


def test_fingerprints_on_random_objects(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        value = {rng.choice(["a", "b", "c", "d e"]): random_json(rng) for _ in range(rng.randrange(4))}
        rows.append((rng.choice(["reddit", "twitter"]), json.dumps(value)))
    df = spark.createDataFrame(rows, "source_platform string, task_content string")
    got = hashing.task_fingerprint(df)
    for r in got.collect():
        assert r["task_fingerprint"] == md5(r["source_platform"] + str(json.loads(r["task_content"])))
    swapped = spark.createDataFrame([("p", '{"a": 1, "b": 2}'), ("p", '{"b": 2, "a": 1}')], df.schema)
    exact = {r["task_fingerprint"] for r in hashing.task_fingerprint(swapped).collect()}
    canonical = {r["task_fingerprint"] for r in hashing.task_fingerprint(swapped, "canonical").collect()}
    assert (len(exact), len(canonical)) == (2, 1)
    with pytest.raises(ValueError):
        hashing.task_fingerprint(df, "loose")


def flatten_model(text):
    """By the shape of the value: only containers and texts can be gone through, only objects have fields."""
    if text is None:
        return "bad_shape", None
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        return "raw", text
    if value in ({}, "") and isinstance(value, dict | str):
        return "flattened", ""
    if not isinstance(value, list):
        return "bad_shape", None
    lines = []
    for item in value:
        if not isinstance(item, dict) or not {"title", "body"} <= item.keys():
            return "bad_shape", None
        lines += [str(item["title"]) + ":", str(item["body"])]
    return "flattened", "\n".join(lines)


CONTENTS = [
    None, "", "plain text", "[]", " [] ", "{}", '""', "null", "12", '"str"', "NaN", "[1,2]",
    '{"title":"a","body":"b"}', '[{"title":"a","body":"b"}]', '[{"title":"a"}]',
    '[{"title":"a","body":null}]', '[{"title":null,"body":true}]', '[{"title":1,"body":2.50}]',
    '[{"title":"a","body":{"x":[1,null]}}]', "[{'title':'a','body':'b'}]", '[{"title":"a"',
    '[{"title":"a","body":"b"}] tail', '[{"title":"a","body":"b"}],[1]', '[{"title":"a","body":"b"}]] []',
    '[{"title":"a","body":"b"}] ]', '[{"title":"a","body":"b\\n\\u00e9 \\"q\\""},{"title":"c","body":"d","x":1}]',
    '[{"title":"a","title":"z","body":"b"}]', '[{"title":"a","body":"b\nraw"}]', "true story", "nullable",
    "[draft] an article", '"Quoted" beginning', "2024 was a year", "-5 degrees", "{braces} in text",
    '[{"title":"a","body":"b"}, 3]', '[["title","body"]]', '\n[{"title":"a","body":""}]\n', "[" * 50,
    '[{"title":"é","body":"数据"}]', "\u00a0[]", "true", "false", "Infinity", "-1", "1e3",
]


def test_flatten_content_equals_json_loads(spark):
    df = spark.createDataFrame(list(enumerate(CONTENTS)), "i int, content string")
    rows = content.flatten_content(df).orderBy("i").collect()
    got = [(r["content_status"], r["content"]) for r in rows]
    assert got == [flatten_model(t) for t in CONTENTS]


def test_flatten_content_on_broken_json(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        sections = [{"title": random_json(rng, 1), "body": random_json(rng, 1)} for _ in range(rng.randrange(4))]
        text = json.dumps(sections, ensure_ascii=rng.random() < 0.5)
        if rng.random() < 0.5 and text:  # cut, repeat or insert a character
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", text[at] * 2, ",", "]", '"']) + text[at + 1 :]
        texts.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = [(r["content_status"], r["content"]) for r in content.flatten_content(df).orderBy("i").collect()]
    assert got == [flatten_model(t) for t in texts]


def test_flatten_whole_long_text(spark):
    long = json.dumps([{"title": str(i), "body": "x" * 5000} for i in range(400)])
    plain = "word " * 400_000
    df = spark.createDataFrame([(0, long), (1, plain)], "i int, content string")
    rows = content.flatten_content(df).orderBy("i").collect()
    assert [(r["content_status"], r["content"]) for r in rows] == [flatten_model(long), ("raw", plain)]


def test_project_content(spark):
    def project(text, rule):
        df = spark.createDataFrame([(text, rule)], "c string, r string")
        return df.select(content.project_content("c", content.rule_keys("r")).alias("x")).first()["x"]

    text = '{"b": 1, "a": {"x": [1, 2]}, "c": null}'
    assert json.loads(project(text, '{"basic": ["a", "b", "zz"]}')) == {"b": 1, "a": {"x": [1, 2]}}
    assert json.loads(project(text, '{"basic": {"c": "t", "a": 1}}')) == {"a": {"x": [1, 2]}, "c": None}
    assert project(text, '{"basic": []}') == "{}"
    assert project(text, '{"other": 1}') is None


def test_project_content_cuts_members_as_stored(spark):
    texts = [
        '{"p": 1, "a": {"z": 2.50, "y": [1e5, {"q": "h\\u00e9"}]}, "c": "x, {y}: ]", "p": 2}',
        '{"a": {"z": 1, "y": 2, "z": 3}, "\\u0063": 4}',
        "{}", '{"b": {}}', "[1]", '"a"', "broken", None, '{"a": 1} x',
    ]
    keys = F.array(F.lit("a"), F.lit("c"), F.lit("p"))
    assert column(spark, texts, content.project_content("c", keys)) == [
        '{"p":2,"a":{"z":2.50,"y":[1e5,{"q":"h\\u00e9"}]},"c":"x, {y}: ]"}',
        '{"a":{"z":3,"y":2},"\\u0063":4}',
        "{}", "{}", None, None, None, None, None,
    ]


def test_missing_fields(spark):
    want = ("priority", "cron_expr")
    texts = ['{"priority": null, "cron_expr": ""}', '{"cron_expr": 1}', "{}", None, "broken"]
    got = column(spark, texts, content.missing_fields("c", want))
    assert got == [[], ["priority"], list(want), list(want), list(want)]


def test_display(spark):
    long = "x" * 51
    assert column(spark, ["x" * 50, long, None, ""], display.truncate_text("c")) == ["x" * 50, "x" * 50 + "...", "", ""]
    assert column(spark, [0, 1, 2, 3, -1, -2, 9, None], display.status_label("c"), "int") == [
        "待启动", "启动中", "运行中", "已完成", "失败", "已停止", "未知", "未知",
    ]
    assert column(spark, [0, 1, 2, 3, -1, -2, 9, None], display.status_class("c"), "int") == [
        "pending", "running", "running", "completed", "failed", "stopped", "pending", "pending",
    ]
    assert column(spark, ["a@b.c", "plain", None, "x@y@z"], display.email_local("c")) == ["a", "plain", "", "x"]
    assert column(spark, ["a", "", None], display.dash_if_empty("c")) == ["a", "-", "-"]
    when = datetime.datetime(2024, 3, 5, 7, 9, 59)
    assert column(spark, [when, None], display.format_time("c"), "timestamp_ntz") == ["2024/03/05 07:09", "-"]
    assert column(spark, [True, False, None], display.role_label("c"), "boolean") == ["管理员", "普通用户", "普通用户"]
    names = spark.createDataFrame(
        [("ann", "e@x"), ("", "e@x"), (None, "e@x"), (None, None)], "full_name string, email string"
    )
    shown = names.select(display.display_name().alias("n"), display.name_initial().alias("i")).collect()
    assert [(r["n"], r["i"]) for r in shown] == [("ann", "A"), ("e@x", "E"), ("e@x", "E"), ("", "")]
