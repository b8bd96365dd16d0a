"""Paging, projection, contracts, registry and stored SQL."""

import datetime

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import counts, filters, paging, projection
from gleanspark.plans import browse
from gleanspark.sources import conform, outbox, registry, schemas, tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def articles(spark):
    """40 rows in three times, a few without one."""
    day = F.when(F.col("id") % 9 != 0, F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(id % 3 as int))"))
    return spark.range(40).select(
        "id", F.concat(F.lit("http://x/"), "id").alias("url"), F.lit("t").alias("title"), day.alias("publish_time")
    )


def model(rows, nulls):
    timed = sorted((r for r in rows if r["publish_time"]), key=lambda r: r["id"])
    timed.sort(key=lambda r: r["publish_time"], reverse=True)
    untimed = sorted((r for r in rows if not r["publish_time"]), key=lambda r: r["id"])
    return [r["id"] for r in (untimed + timed if nulls == "first" else timed + untimed)]


@pytest.mark.parametrize("nulls", ["first", "last"])
@pytest.mark.parametrize("skip,limit", [(0, 10), (7, 5), (35, 20), (40, 3), (0, 0), (100, 10)])
def test_pages_shallow_and_deep(spark, articles, nulls, skip, limit):
    want = model(articles.collect(), nulls)[skip : skip + limit]
    page = paging.page_desc(articles, "publish_time", skip, limit, nulls)
    assert [r["id"] for r in page.collect()] == want
    order = paging.newest_order("publish_time", "id", nulls)
    deep = paging.slice_ordered(articles.repartition(5), order, skip, limit, shallow=-1)
    assert [r["id"] for r in deep.collect()] == want


def test_deep_page_with_one_time_for_all(spark):
    same = spark.range(0, 5000, 1, 7).withColumn("publish_time", F.expr("timestamp_ntz '2024-01-01'"))
    deep = paging.slice_ordered(same, paging.newest_order("publish_time", "id"), 4321, 5, shallow=-1)
    assert [r["id"] for r in deep.collect()] == list(range(4321, 4326))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("nulls_first", [False, True])
def test_deep_page_sorts_only_a_stretch(spark, descending, nulls_first):
    rows = spark.range(0, 20_000, 1, 4).select(
        "id", F.when(F.col("id") % 10 != 0, F.xxhash64("id") % 100_000).alias("v")
    )
    order = [paging.Order("v", descending, nulls_first), paging.Order("id")]
    want = [r["id"] for r in rows.orderBy(*[o.column() for o in order]).collect()]
    for skip in (0, 1, 1999, 2000, 9000, 17_999, 18_000, 19_990):
        page = paging.slice_ordered(rows, order, skip, 20, shallow=-1)
        assert [r["id"] for r in page.collect()] == want[skip : skip + 20]
    stretch, before = paging._near(rows, order, 9000)
    assert stretch.count() < 400 and 8000 < before <= 9000


def test_deep_page_of_text_and_past_the_end(spark):
    rows = spark.range(0, 500, 1, 4).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("s"))
    deep = paging.slice_ordered(rows, [paging.Order("s", True)], 300, 3, shallow=-1)
    assert [r["s"] for r in deep.collect()] == ["0199", "0198", "0197"]
    assert paging.slice_ordered(rows, [paging.Order("s")], 500, 3, shallow=-1).count() == 0


def test_deep_page_without_tie_break(spark):
    """Rows that tie in all order columns are still cut at the right count."""
    tied = spark.range(0, 300, 1, 4).select((F.col("id") % 3).alias("k"), F.lit("x").alias("v"))
    order = [paging.Order("k", True)]
    deep = paging.slice_ordered(tied, order, 95, 10, shallow=-1)
    assert [r["k"] for r in deep.collect()] == [2] * 5 + [1] * 5


def test_deep_page_inside_a_long_tie(spark, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 20)
    tied = spark.range(0, 300, 1, 4).select((F.col("id") % 3).alias("k"), F.lit("x").alias("v"))
    deep = paging.slice_ordered(tied, [paging.Order("k", True)], 95, 10)
    assert [r["k"] for r in deep.collect()] == [2] * 5 + [1] * 5


def test_deep_page_larger_than_a_page(spark, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 10)
    rows = spark.range(0, 200, 1, 4)
    deep = paging.slice_ordered(rows, [paging.Order("id", True)], 50, 100)
    assert [r["id"] for r in deep.collect()] == list(range(149, 49, -1))


def test_keyset_walk_equals_pages(articles):
    want, got, last = model(articles.collect(), "last"), [], None
    while True:
        page = (
            paging.page_after(articles, "publish_time", last["publish_time"], last["id"], 7)
            if last
            else paging.page_desc(articles, "publish_time", 0, 7)
        ).collect()
        if not page:
            break
        got += [r["id"] for r in page]
        last = page[-1]
    assert got == want


def test_page_bounds_and_plan(articles):
    with pytest.raises(ValueError):
        paging.page_desc(articles, "publish_time", -1, 5)
    with pytest.raises(ValueError):
        paging.page_desc(articles, "publish_time", nulls="middle")
    plan = paging.page_desc(articles, "publish_time", 5, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_page_summary(spark, articles):
    def summary(df, page, size):
        return paging.page_summary(df, page, size).first().asDict()

    got = summary(articles, 2, 15)
    assert (got["total_count"], got["pages"], got["skip"], got["shown_from"], got["shown_to"]) == (40, 3, 15, 16, 30)
    assert summary(articles, 3, 15)["shown_to"] == 40
    assert not summary(articles, 4, 15)["in_range"]
    empty = summary(articles.where("id < 0"), 1, 20)
    assert (empty["pages"], empty["total_count"], empty["in_range"]) == (1, 0, True)


def test_empty_page_keeps_total(articles):
    page, total = paging.page_with_total(articles, paging.page_desc(articles, "publish_time", 100, 10))
    assert page.collect() == []
    assert total.first()["total_count"] == 40


def test_adaptive_page_and_projection(articles):
    bare = articles.select("title", "url")
    assert projection.adaptive_select(bare).columns == ["url", "title"]
    other = articles.select(F.col("id").alias("n"))
    assert projection.adaptive_select(other).columns == ["n"]
    assert [r["n"] for r in paging.page_adaptive(other, "publish_time", 3, 2).collect()] == [3, 4]
    assert projection.id_first(articles.select("url", "id", "title")).columns == ["id", "url", "title"]
    assert browse.browse(bare).rows.columns == ["url", "title"]


def test_scan_reads_only_listed_columns(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    plan = projection.adaptive_select(pages)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    plan = filters.where_key(orders, "o_custkey", 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,5)" in plan


def test_owner_pages_limit_groups_before_the_shuffle(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at")
    )
    page, _ = filters.tasks_of_owners(orders, None, 0, 3)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_contract(spark, articles):
    whole = articles.where("publish_time is not null")
    assert projection.enforce_contract(whole).columns == ["id", "url", "title", "publish_time"]
    with pytest.raises(Exception, match="publish_time: null"):
        projection.enforce_contract(articles).collect()
    with pytest.raises(Exception, match="publish_time: null"):
        projection.enforce_contract(articles).count()  # also where no column is read
    ok, bad = projection.enforce_contract(articles, on_error="split")
    assert (ok.count(), bad.count()) == (35, 5)
    _, lacking = projection.enforce_contract(articles.drop("url"), on_error="split")
    assert lacking.where("reason like '%url: missing column%'").count() == 40
    loose = spark.createDataFrame([(1.0, 5), (1.5, 5)], "id double, url int")
    ok, bad = projection.enforce_contract(loose, {"id": "bigint"}, "split")
    assert [r["id"] for r in ok.collect()] == [1]
    assert [r["reason"] for r in bad.collect()] == ["id: wrong type"]
    assert projection.enforce_contract(loose, {"url": "string"}, "split")[0].count() == 0


def test_exactly_one_and_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, v string")
    keys = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id long")
    got = {r["id"]: (r["status"], r["matches"], r["v"]) for r in paging.exactly_one(df, keys).collect()}
    assert got == {1: ("ok", 1, "a"), 2: ("multiple", 2, None), 3: ("missing", 0, None)}
    assert [r["v"] for r in paging.first_match(df, ["v"], key="id").orderBy("id").collect()] == ["a", "b"]
    assert paging.first_match(df, [F.desc("v")]).first()["v"] == "c"
    assert {(r["id"], r["v"]) for r in paging.last_per_key(df, "id", "v").collect()} == {(1, "a"), (2, "c")}
    looked = {r["id"]: r["v"] for r in paging.lookup(df.where("id = 1"), keys.distinct()).collect()}
    assert looked == {1: "a", 2: None, 3: None}


@pytest.fixture(scope="module")
def task_list(spark):
    rows = [(i, 1 if i % 3 else 2, f"g{i % 2}", i % 4 == 0, f"n{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, user_id long, task_group string, is_delete boolean, task_name string")
    time = F.when(F.col("id") != 5, F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(id div 3 as int))"))
    return df.withColumn("created_at", time).withColumn("status", F.lit(0).cast("smallint"))


def test_owner_and_group_lists(task_list):
    page, total = filters.tasks_of_owner(task_list, 1, 0, 3)
    assert [r["id"] for r in page.collect()] == [5, 28, 29]  # no time first
    assert total.first()["total_count"] == 20
    page, total = filters.tasks_of_group(task_list, 2, "g0", 0, 100)
    assert (page.count(), total.first()["total_count"]) == (5, 15)
    assert filters.tasks_of_group(task_list, 2, "g0", count_scope="owner")[1].first()["total_count"] == 5
    with pytest.raises(ValueError):
        filters.tasks_of_group(task_list, 2, "g0", count_scope="none")


def test_hot_owner_pages(spark, task_list, limits):
    want = sorted(map(str, filters.tasks_of_owners(task_list, None, 1, 4)[0].collect()))
    limits(hotKey_rows=6)
    assert sorted(map(str, filters.tasks_of_owners(task_list, None, 1, 4)[0].collect())) == want


def test_visible_tasks(spark, task_list):
    users = spark.createDataFrame([(1, False), (2, False), (9, True)], "id long, is_superuser boolean")
    shown = filters.visible_tasks(task_list, users, 0, 4)
    by_viewer = {}
    for r in shown.own.collect():
        by_viewer.setdefault(r["viewer_id"], set()).add(r["id"])
    assert [r["viewer_id"] for r in shown.viewers.collect()] == [9] and 9 not in by_viewer
    assert {r["id"] for r in shown.shared.collect()} == {5, 27, 28, 29}  # deleted 28 is shown to a superuser
    assert by_viewer[1] == {5, 29, 25}  # deleted 28 leaves a short page
    filled = filters.visible_tasks(task_list, users, 0, 4, after_paging=False)
    assert filled.own.where("viewer_id = 1").count() == 4


def test_allowed_actions(spark):
    df = spark.createDataFrame([(s, d) for s in (0, 1, 2, 3, -1, -2) for d in (False, True)], "status int, is_delete boolean")
    got = {(r["status"], r["is_delete"]): r["a"] for r in df.withColumn("a", filters.allowed_actions()).collect()}
    assert [got[s, False] for s in (0, 1, 2, 3, -1, -2)] == [
        ["start", "delete"], ["stop", "delete"], ["stop", "delete"], ["delete"], ["delete"], ["start", "delete"],
    ]
    assert all(got[s, True] == [] for s in (0, 1, 2, 3, -1, -2))


def test_dashboard_without_finished_tasks(spark, task_list):
    row = counts.dashboard_totals(task_list, [task_list, task_list]).first()
    assert (row["running_tasks"], row["completed_tasks"], row["success_rate"], row["rows_collected"]) == (0, 0, None, 60)


def registry_frames(spark):
    configs = spark.createDataFrame(
        [(1, "pages", True), (2, "no_such_table", False), (3, "../pages", True), (4, "a", True), (4, "b", True)],
        "id long, table_name string, enabled boolean",
    )
    queries = spark.createDataFrame(
        [
            (1, "SELECT page_id AS id FROM p ORDER BY id DESC -- newest\n;;"),
            (2, "WITH t AS (SELECT 1 AS a) SELECT * FROM t;"),
            (3, "DROP TABLE p"),
            (4, "INSERT INTO p VALUES (1)"),
            (5, "SELECT 1) q; DROP VIEW p --"),
        ],
        "id long, sql string",
    )
    return configs, queries


def test_resolve(spark):
    configs, _ = registry_frames(spark)
    assert registry.resolve_source(spark, configs, 1, SMALL).columns == ["page_id", "url", "html"]
    for config in (2, 3):
        with pytest.raises(tables.TableNotFound):
            registry.resolve_source(spark, configs, config, SMALL)
    for config in (4, 77):
        with pytest.raises(LookupError):
            registry.resolve_source(spark, configs, config, SMALL)


def test_unreadable_table(spark, tmp_path):
    (tmp_path / "broken.parquet").mkdir()
    with pytest.raises(tables.TableUnreadable):
        tables.scan_dynamic(spark, str(tmp_path), "broken")


def test_saved_queries(spark):
    _, queries = registry_frames(spark)
    spark.read.parquet(f"{SMALL}/pages.parquet").createOrReplaceTempView("p")
    ids = [r["id"] for r in registry.run_saved_query(spark, queries, 1).collect()]
    assert ids == sorted(ids, reverse=True) and len(ids) == 50
    assert registry.run_saved_query(spark, queries, 2).first()["a"] == 1
    for refused in (3, 4, 5):
        with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
            registry.run_saved_query(spark, queries, refused)
    assert spark.catalog.tableExists("p")
    spark.catalog.dropTempView("p")


def test_conform(spark):
    assert [conform.current_name(t) for t in ("taskrun", "spiderbuilder", "task")] == ["task_run", "rule", "task"]
    old = spark.createDataFrame([("i", 7, None)], "id string, user long, task_group string")
    target = schemas.T.StructType(
        [f for f in schemas.TASK if f.name in ("id", "task_group", "task_name", "created_at", "user_id")]
    )
    got = conform.conform_schema(old, target, {"user": "user_id"}, {"task_name": "default name", "task_group": "default group"})
    row = got.first()
    assert got.columns == target.fieldNames()
    assert (row["user_id"], row["task_name"], row["task_group"], row["created_at"]) == ("7", "default name", "default group", None)
    with pytest.raises(ValueError, match="task_name"):
        conform.conform_schema(old, target, {"user": "user_id"})
    with pytest.raises(ValueError, match="already exist"):
        conform.conform_schema(old.withColumn("user_id", F.lit("x")), target, {"user": "user_id"})


def test_write_and_scan(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1)
    rows = [(f"u{i}", f"{i}@x.org", True, False, None, "h", now) for i in range(20)]
    users = spark.createDataFrame(rows, schemas.USER)
    path = f"{tmp_path}/user.parquet"
    tables.write_state(users, path, cluster_by="id")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_state(users, path)
    tables.write_append(users.limit(1), path)
    back = tables.scan_table(spark, str(tmp_path), "user")
    assert back.count() == 21 and back.columns == schemas.USER_COLUMNS
    with pytest.raises(ValueError):
        tables.scan_jdbc(spark, "jdbc:none", "t", "id", 0, 10, 0)


def test_outbox(spark, tmp_path):
    records = spark.range(3)
    sent = outbox.publish_outbox(records, "article", "test")
    assert sent.orderBy("record_id").first()["payload"] == '{"table_name":"article","record_id":0,"is_alpha":false}'
    answers = spark.createDataFrame([(0, 200, ""), (1, 500, "boom")], "record_id long, status_code int, text string")
    got = {r["record_id"]: (r["outcome"], r["message"]) for r in outbox.publish_outcome(sent, answers).collect()}
    assert got == {
        0: (200, "Ghost 发送成功：article - 0"),
        1: (502, "Ghost 服务返回错误: boom"),
        2: (503, "无法连接到 Ghost 服务"),
    }
    outbox.write_outbox(sent, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 3


def test_details_reject_bad_content(spark, articles):
    detail = articles.where("publish_time is not null").select(
        "id", "url", F.lit("c").alias("cover_url"), "title", F.lit("d").alias("description"), F.lit("a").alias("author"),
        "publish_time", F.when(F.col("id") == 1, "[1]").otherwise('[{"title":"t","body":"b"}]').alias("content"),
    )
    ids = spark.createDataFrame([(1,), (2,), (999,)], "id long")
    ok, bad = browse.read_details(detail, ids)
    assert [(r["id"], r["content"]) for r in ok.collect()] == [(2, "t:\nb")]
    assert [(r["id"], r["reason"]) for r in bad.collect()] == [(1, "content: null")]
