"""Every operator as a named query over the given tables, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracle import sql
from checks.tables import START, Tables
from gleanspark.functions import content, display, hashing
from gleanspark.operators import (
    access,
    counts,
    filters,
    integrity,
    paging,
    patching,
    projection,
    tasks,
    users,
)
from gleanspark.plans import browse, positions
from gleanspark.plans.durable import checkpoint_folder
from gleanspark.plans.skew import lookup_join
from gleanspark.sources import conform, outbox, registry, schemas
from gleanspark.sources import tables as stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of ``Tables`` as a query, with its SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if oracle is not None:
            ORACLE[key] = oracle
        return build

    return register


def _now():
    return F.expr(START)


NEWEST_TASK = "ORDER BY created_at DESC NULLS FIRST, id"
TASK_FIELDS = (
    "id, task_group, task_name, task_content, source_platform, task_fingerprint, status, is_delete, "
    "created_at, updated_at, user_id"
)

# --- scans, registry, sinks ------------------------------------------------------------------


@query(
    sql(
        "SELECT id::VARCHAR AS id, email, is_active, is_superuser, full_name, hashed_password FROM user_t",
        "user",
    )
)
def scan_table(t: Tables) -> DataFrame:
    root = f"{checkpoint_folder(t.spark)}/scan-{uuid.uuid4().hex}"
    typed = t.user.withColumn("id", F.col("id").cast("string")).withColumn(
        "created_at", F.col("created_at").cast("timestamp")
    )
    stored.write_state(typed, f"{root}/user.parquet", cluster_by="id")
    return stored.scan_table(t.spark, root, "user").drop("created_at")


@query("SELECT page_id, url, length(html)::INTEGER AS html_length FROM pages")
def scan_dynamic(t: Tables) -> DataFrame:
    return stored.scan_dynamic(t.spark, t.folder, "pages").select(
        "page_id", "url", F.length("html").alias("html_length")
    )


@query(
    sql(
        "SELECT id, name, created_at FROM config WHERE enabled ORDER BY created_at DESC NULLS FIRST, id LIMIT 20 OFFSET 5",
        "config",
    )
)
def list_sources(t: Tables) -> DataFrame:
    return registry.list_sources(t.config, 5, 20)[0]


@query(sql("SELECT count(*) AS total_count FROM config WHERE enabled", "config"))
def list_sources_total(t: Tables) -> DataFrame:
    return registry.list_sources(t.config)[1]


@query("SELECT page_id, url, html FROM pages")
def resolve_source(t: Tables) -> DataFrame:
    return registry.resolve_source(t.spark, t.config, 3, t.folder)


@query(
    """SELECT * FROM (
         SELECT 1 AS ordinal, 'doc_id' AS name, 'bigint' AS type, count(doc_id) AS present FROM documents
         UNION ALL SELECT 2, 'text', 'string', count(text) FROM documents
         UNION ALL SELECT 3, 'lang', 'string', count(lang) FROM documents
         UNION ALL SELECT 4, 'source', 'string', count(source) FROM documents
         UNION ALL SELECT 5, 'n_chars', 'bigint', count(n_chars) FROM documents)"""
)
def reflect_schema(t: Tables) -> DataFrame:
    """The reflected columns, with the number of values each holds."""
    source = stored.scan_dynamic(t.spark, t.folder, "documents")
    held = source.agg(*[F.count(c).alias(c) for c in source.columns]).unpivot(
        [], source.columns, "name", "present"
    )
    return registry.reflect_schema(source).join(F.broadcast(held), "name").select("ordinal", "name", "type", "present")


@query(
    sql(
        "SELECT id, name, sql, created_at FROM query_t WHERE config_id = 30 "
        "ORDER BY created_at DESC NULLS FIRST, id LIMIT 20",
        "query",
    )
)
def list_saved_queries(t: Tables) -> DataFrame:
    return registry.list_saved_queries(t.query, 30, 0, 20)[0]


_STORED = """SELECT id, url, title, publish_time FROM article
    WHERE length(title) > (SELECT p_size FROM part WHERE p_partkey = 7)"""


@query(sql(_STORED, "article"))
def run_saved_query(t: Tables) -> DataFrame:
    t.article.createOrReplaceTempView("article")
    return registry.run_saved_query(t.spark, t.query, 7)


def _page_queries(t: Tables) -> DataFrame:
    """Parts as stored queries over two registered tables; a quoted text and a comment name others."""
    text = F.concat(
        F.lit("SELECT d.source, count(*) AS pages, 'FROM orders' AS note FROM pages p JOIN `documents` d "
              "ON p.page_id = d.doc_id -- , customer\nWHERE length(p.html) > "),
        F.col("p_size").cast("string"),
        F.lit(" GROUP BY d.source;"),
    )
    return t.given("part").select(F.col("p_partkey").alias("id"), text.alias("sql"))


@query(
    """SELECT d.source, count(*) AS pages, 'FROM orders' AS note FROM pages p JOIN documents d ON p.page_id = d.doc_id
       WHERE length(p.html) > (SELECT p_size FROM part WHERE p_partkey = 7) GROUP BY d.source"""
)
def run_registered_query(t: Tables) -> DataFrame:
    return registry.run_registered_query(t.spark, t.config, _page_queries(t), 7, t.folder)


@query(sql(f"SELECT count(*) AS count FROM ({_STORED})", "article"))
def count_result(t: Tables) -> DataFrame:
    t.article.createOrReplaceTempView("article")
    return counts.count_result(registry.run_saved_query(t.spark, t.query, 7))


@query(
    sql(
        "SELECT id::VARCHAR AS id, task_group, 'default name' AS task_name, task_content, source_platform, "
        "task_fingerprint, status, is_delete, user_id::VARCHAR AS user_id FROM task",
        "task",
    )
)
def conform_schema(t: Tables) -> DataFrame:
    old = t.task.drop("task_name").withColumnRenamed("user_id", "user").withColumn("legacy", F.lit(1))
    current = conform.conform_schema(old, schemas.TASK, conform.TASK_RENAMES, conform.TASK_BACKFILL)
    return current.drop("created_at", "updated_at")


@query(
    sql(
        "SELECT id, email, full_name FROM user_t UNION ALL "
        "SELECT s_suppkey + 1000000000 AS id, lower(s_name) AS email, s_name AS full_name FROM supplier",
        "user",
    )
)
def append_rows(t: Tables) -> DataFrame:
    new = t.given("supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).cast("string").alias("id"),
        F.lower("s_name").alias("email"),
        F.col("s_name").alias("full_name"),
    )
    return stored.append_rows(t.user.select("id", "email", "full_name"), new)


@query(
    sql(
        """SELECT id AS record_id, 'article' AS table_name,
                  '{"table_name":"article","record_id":' || id || ',"is_alpha":true}' AS payload FROM article""",
        "article",
    )
)
def publish_outbox(t: Tables) -> DataFrame:
    return outbox.publish_outbox(t.article, "article", "alpha")


@query(
    sql(
        """SELECT a.id AS record_id, 'article' AS table_name,
             CASE WHEN quality IS NULL THEN 503 WHEN quality = 1 THEN 200 ELSE 502 END AS outcome,
             CASE WHEN quality IS NULL THEN '无法连接到 Ghost 服务'
                  WHEN quality = 1 THEN 'Ghost 发送成功：article - ' || a.id
                  ELSE 'Ghost 服务返回错误: toxic ' || toxic END AS message
           FROM article a LEFT JOIN labels l ON l.doc_id = a.id""",
        "article",
    )
)
def publish_outcome(t: Tables) -> DataFrame:
    answers = t.given("labels").select(
        F.col("doc_id").alias("record_id"),
        F.when(F.col("quality") == 1, 200).otherwise(500).alias("status_code"),
        F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("text"),
    )
    return outbox.publish_outcome(outbox.publish_outbox(t.article, "article", "test"), answers)


# --- projections -----------------------------------------------------------------------------


@query(sql("SELECT id, url, title, publish_time FROM article", "article"))
def adaptive_select(t: Tables) -> DataFrame:
    return projection.adaptive_select(t.article)


@query(sql("SELECT url FROM article_bare", "article_bare"))
def adaptive_select_partial(t: Tables) -> DataFrame:
    return projection.adaptive_select(t.article_bare)


@query("SELECT * FROM events")
def adaptive_select_none(t: Tables) -> DataFrame:
    return projection.adaptive_select(t.given("events"))


@query(sql(f"SELECT {TASK_FIELDS.removesuffix(', user_id')} FROM task", "task"))
def public_view(t: Tables) -> DataFrame:
    return projection.public_view(t.task, "task")


@query(sql("SELECT email, is_active, is_superuser, full_name, id, created_at FROM user_t", "user"))
def public_view_user(t: Tables) -> DataFrame:
    return projection.public_view(t.user, "user")


@query(sql("SELECT id, url, title, publish_time FROM article", "article"))
def enforce_contract(t: Tables) -> DataFrame:
    return projection.enforce_contract(t.article)


_LOOSE = """SELECT id::VARCHAR || CASE WHEN is_superuser THEN 'x' ELSE '' END AS id, email AS url,
    full_name AS title, created_at AS publish_time FROM user_t"""


def _loose_rows(t: Tables) -> DataFrame:
    return t.user.select(
        F.concat(F.col("id").cast("string"), F.when(F.col("is_superuser"), "x").otherwise("")).alias("id"),
        F.col("email").alias("url"),
        F.col("full_name").alias("title"),
        F.col("created_at").alias("publish_time"),
    )


@query(
    sql(
        "SELECT id::BIGINT AS id, url, title, publish_time FROM loose WHERE title IS NOT NULL AND NOT contains(id, 'x')",
        "user",
        loose=_LOOSE,
    )
)
def enforce_contract_split(t: Tables) -> DataFrame:
    return projection.enforce_contract(_loose_rows(t), on_error="split")[0]


@query(
    sql(
        """SELECT *, CASE WHEN contains(id, 'x') AND title IS NULL THEN 'id: wrong type; title: null'
                          WHEN title IS NULL THEN 'title: null' ELSE 'id: wrong type' END AS reason
           FROM loose WHERE title IS NULL OR contains(id, 'x')""",
        "user",
        loose=_LOOSE,
    )
)
def enforce_contract_rejects(t: Tables) -> DataFrame:
    return projection.enforce_contract(_loose_rows(t), on_error="split")[1]


@query(sql("SELECT id, url, title, publish_time, source_platform FROM article", "article"))
def id_first(t: Tables) -> DataFrame:
    return projection.id_first(t.article.select("url", "title", "id", "publish_time", "source_platform"))


@query(
    sql(
        "SELECT id, url, title, publish_time, source_platform FROM article "
        "WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "article",
    )
)
def record_detail(t: Tables) -> DataFrame:
    ids = t.given("labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return projection.record_detail(t.article, ids)


# --- filters ---------------------------------------------------------------------------------


@query(sql("SELECT * FROM config WHERE enabled", "config"))
def enabled_only(t: Tables) -> DataFrame:
    return filters.enabled_only(t.config)


@query(sql(f"SELECT {TASK_FIELDS} FROM task WHERE source_platform = '1-URGENT'", "task"))
def where_key(t: Tables) -> DataFrame:
    return filters.where_key(t.task, "source_platform", "1-URGENT")


@query(sql(f"SELECT {TASK_FIELDS} FROM task WHERE user_id = 101 {NEWEST_TASK} LIMIT 5 OFFSET 2", "task"))
def tasks_of_owner(t: Tables) -> DataFrame:
    return filters.tasks_of_owner(t.task, 101, 2, 5)[0]


@query(
    sql(
        """SELECT id, user_id, status, created_at, position::INTEGER AS position FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, id) AS position
             FROM task) WHERE position > 1 AND position <= 6""",
        "task",
    )
)
def tasks_of_owners(t: Tables) -> DataFrame:
    page, _ = filters.tasks_of_owners(t.task, None, 1, 5)
    return page.select("id", "user_id", "status", "created_at", "position")


@query(sql("SELECT user_id, count(*) AS total_count FROM task GROUP BY user_id", "task"))
def tasks_of_owners_total(t: Tables) -> DataFrame:
    return filters.tasks_of_owners(t.task)[1]


@query(
    sql(
        f"SELECT {TASK_FIELDS} FROM task WHERE user_id = 101 AND task_group = '3-MEDIUM' {NEWEST_TASK} LIMIT 10",
        "task",
    )
)
def tasks_of_group(t: Tables) -> DataFrame:
    return filters.tasks_of_group(t.task, 101, "3-MEDIUM", 0, 10)[0]


@query(sql("SELECT count(*) AS total_count FROM task WHERE task_group = '3-MEDIUM'", "task"))
def tasks_of_group_total(t: Tables) -> DataFrame:
    return filters.tasks_of_group(t.task, 101, "3-MEDIUM")[1]


@query(
    sql(
        """SELECT id, user_id, task_group, position::INTEGER AS position, total_count FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id, task_group
                                          ORDER BY created_at DESC NULLS FIRST, id) AS position
             FROM task) JOIN (SELECT task_group, count(*) AS total_count FROM task GROUP BY task_group)
             USING (task_group) WHERE position <= 2""",
        "task",
    )
)
def tasks_of_groups(t: Tables) -> DataFrame:
    page, total = filters.tasks_of_groups(t.task, 0, 2)
    return lookup_join(page, total, "task_group").select("id", "user_id", "task_group", "position", "total_count")


@query(sql(f"SELECT {TASK_FIELDS} FROM task WHERE task_name = 'task 77' AND user_id IS NOT NULL", "task"))
def find_by_name(t: Tables) -> DataFrame:
    owner = t.given("orders").where("o_orderkey = 77").first()["o_custkey"]
    return filters.find_by_name(t.task, "task 77", owner)


_OWN_PAGE = """SELECT t.*, row_number() OVER (PARTITION BY t.user_id
    ORDER BY t.created_at DESC NULLS FIRST, t.id) AS position
    FROM task t JOIN user_t u ON u.id = t.user_id AND NOT u.is_superuser"""


@query(
    sql(
        f"""SELECT user_id AS viewer_id, {TASK_FIELDS} FROM ({_OWN_PAGE}) WHERE position <= 5 AND NOT is_delete""",
        "task",
        "user",
    )
)
def visible_tasks(t: Tables) -> DataFrame:
    return filters.visible_tasks(t.task, t.user, 0, 5).own.select("viewer_id", *TASK_FIELDS.split(", "))


@query(sql(f"SELECT {TASK_FIELDS} FROM task {NEWEST_TASK} LIMIT 5", "task"))
def visible_tasks_shared(t: Tables) -> DataFrame:
    return filters.visible_tasks(t.task, t.user, 0, 5).shared.select(*TASK_FIELDS.split(", "))


@query(sql("SELECT id AS viewer_id FROM user_t WHERE is_superuser", "user"))
def visible_tasks_viewers(t: Tables) -> DataFrame:
    return filters.visible_tasks(t.task, t.user, 0, 5).viewers


@query(sql("SELECT seq, user_id, task_id, outcome, refusal AS reason FROM action", "action"))
def task_access(t: Tables) -> DataFrame:
    return access.task_access(t.action_request, t.task, t.user)


@query(
    sql(
        """SELECT seq, user_id, target_id, outcome,
                  CASE WHEN known IS NULL THEN 'User not found' WHEN outcome = 400 THEN 'Inactive user'
                       WHEN outcome = 403 THEN '用户没有足够的权限' WHEN outcome = 404 THEN '用户不存在' END AS reason
           FROM (SELECT r.*, a.id AS known, CASE WHEN a.id IS NULL THEN 404 WHEN NOT a.is_active THEN 400
                                  WHEN r.target_id = r.user_id THEN 200
                                  WHEN a.is_superuser IS NOT TRUE THEN 403
                                  WHEN u.id IS NULL THEN 404 ELSE 200 END AS outcome
                 FROM view_request r LEFT JOIN user_t a ON a.id = r.user_id
                                     LEFT JOIN user_t u ON u.id = r.target_id)""",
        "view_request",
        "user",
    )
)
def user_access(t: Tables) -> DataFrame:
    return access.user_access(t.view_request, t.user)


@query(
    sql(
        """SELECT id, CASE WHEN is_delete THEN '' WHEN status = 0 THEN 'start,delete'
                           WHEN status = 2 THEN 'stop,delete' ELSE 'delete' END AS actions FROM task""",
        "task",
    )
)
def allowed_actions(t: Tables) -> DataFrame:
    return t.task.select("id", F.concat_ws(",", filters.allowed_actions()).alias("actions"))


@query(
    sql(
        "SELECT r.* FROM action_request r JOIN user_t u ON u.id = r.user_id WHERE u.is_superuser AND u.is_active",
        "action_request",
        "user",
    )
)
def superuser_only(t: Tables) -> DataFrame:
    return filters.superuser_only(t.action_request, t.user)


# --- pages and lookups -----------------------------------------------------------------------

_NEWEST = "ORDER BY publish_time DESC NULLS LAST, id"


@query(sql(f"SELECT * FROM article {_NEWEST} LIMIT 20 OFFSET 10", "article"))
def page_desc(t: Tables) -> DataFrame:
    return paging.page_desc(t.article, "publish_time", 10, 20)


@query(sql(f"SELECT {TASK_FIELDS} FROM task {NEWEST_TASK} LIMIT 300 OFFSET 700", "task"))
def page_desc_deep(t: Tables) -> DataFrame:
    """The same cut made from a distributed sort of the order columns, as for a deep page."""
    order = paging.newest_order("created_at", "id", "first")
    return paging.slice_ordered(t.task, order, 700, 300, shallow=0)


@query(sql(f"SELECT {TASK_FIELDS} FROM task {NEWEST_TASK} LIMIT 300 OFFSET 700", "task"))
def page_at(t: Tables) -> DataFrame:
    """The same page by the position index of a stored table."""
    order = paging.newest_order("created_at", "id", "first")
    path = f"{checkpoint_folder(t.spark)}/positions-{uuid.uuid4().hex}"
    positions.write_positions(t.task, path, order, rows_per_file=500)
    return positions.page_at(t.spark, path, order, 700, 300)


@query(sql(f"SELECT {TASK_FIELDS} FROM task ORDER BY created_at DESC NULLS LAST, id LIMIT 50 OFFSET 50", "task"))
def page_after(t: Tables) -> DataFrame:
    last = paging.page_desc(t.task, "created_at", 49, 1).first()
    return paging.page_after(t.task, "created_at", last["created_at"], last["id"], 50)


@query("SELECT * FROM documents ORDER BY doc_id LIMIT 30 OFFSET 15")
def page_adaptive(t: Tables) -> DataFrame:
    return paging.page_adaptive(t.given("documents"), "publish_time", 15, 30)


@query(
    sql(
        f"SELECT id, url, title, publish_time, (SELECT count(*) FROM article) AS total_count "
        f"FROM article {_NEWEST} LIMIT 20 OFFSET 20",
        "article",
    )
)
def page_with_total(t: Tables) -> DataFrame:
    page = projection.adaptive_select(paging.page_desc(t.article, "publish_time", 20, 20))
    return paging.page_with_total(t.article, page)[0]


@query(
    """SELECT n AS total_count, 3::BIGINT AS page, 20::BIGINT AS page_size,
              greatest(ceil(n / 20.0)::BIGINT, 1) AS pages, 40::BIGINT AS skip, 41::BIGINT AS shown_from,
              least(60, n)::BIGINT AS shown_to, 3 <= greatest(ceil(n / 20.0)::BIGINT, 1) AS in_range
       FROM (SELECT count(*) AS n FROM pages)"""
)
def page_summary(t: Tables) -> DataFrame:
    return paging.page_summary(t.given("pages"), 3, 20)


@query(sql(f"SELECT * FROM article {_NEWEST} LIMIT 1", "article"))
def first_match(t: Tables) -> DataFrame:
    newest = [F.col("publish_time").desc_nulls_last(), F.col("id")]
    return paging.first_match(t.article, newest)


@query(
    sql(
        """SELECT o.o_custkey AS id, u.email, u.full_name, u.is_superuser
           FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN user_t u ON u.id = o.o_custkey""",
        "user",
    )
)
def lookup(t: Tables) -> DataFrame:
    keys = t.given("orders").select(F.col("o_custkey").alias("id")).distinct()
    return paging.lookup(t.user.select("id", "email", "full_name", "is_superuser"), keys)


@query(
    """SELECT k.id, coalesce(n, 0) AS matches,
              CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'ok' ELSE 'multiple' END AS status,
              CASE WHEN n = 1 THEN qty END AS quantity
       FROM (SELECT DISTINCT event_id AS id FROM events) k
       LEFT JOIN (SELECT l_orderkey AS id, count(*) AS n, min(l_quantity) AS qty FROM lineitem GROUP BY 1) USING (id)"""
)
def exactly_one(t: Tables) -> DataFrame:
    lines = t.given("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("quantity"))
    return paging.exactly_one(lines, t.given("events").select(F.col("event_id").alias("id")))


# --- counts ----------------------------------------------------------------------------------


@query("SELECT count(*) AS count FROM lineitem")
def count_all(t: Tables) -> DataFrame:
    return counts.count_all(t.given("lineitem"))


@query(sql("SELECT count(*) AS count FROM task WHERE user_id = 101", "task"))
def count_where(t: Tables) -> DataFrame:
    return counts.count_where(t.task, F.col("user_id") == 101)


@query(
    sql(
        """SELECT count(*) FILTER (status IN (1, 2)) AS running_tasks, count(*) FILTER (status = 3) AS completed_tasks,
                  CASE WHEN count(*) FILTER (status IN (3, -1)) > 0
                       THEN count(*) FILTER (status = 3)::DOUBLE / count(*) FILTER (status IN (3, -1)) END AS success_rate,
                  (SELECT count(*) FROM pages) + (SELECT count(*) FROM documents) AS rows_collected
           FROM task""",
        "task",
    )
)
def dashboard_totals(t: Tables) -> DataFrame:
    return counts.dashboard_totals(t.task, [t.given("pages"), t.given("documents")])


@query(
    sql(
        """SELECT count(*) FILTER (status IN (1, 2)) AS running_tasks, count(*) FILTER (status = 3) AS completed_tasks,
                  CASE WHEN count(*) FILTER (status IN (3, -1)) > 0
                       THEN count(*) FILTER (status = 3)::DOUBLE / count(*) FILTER (status IN (3, -1)) END AS success_rate,
                  (SELECT CASE WHEN bool_or(enabled AND table_name = 'pages') THEN (SELECT count(*) FROM pages) ELSE 0 END
                     + CASE WHEN bool_or(enabled AND table_name = 'documents') THEN (SELECT count(*) FROM documents) ELSE 0 END
                   FROM config) AS rows_collected
           FROM task""",
        "task",
        "config",
    )
)
def dashboard_of_enabled(t: Tables) -> DataFrame:
    return counts.dashboard_of(t.task, registry.enabled_rows(t.spark, t.config, t.folder))


@query(
    sql(
        """SELECT coalesce(a.source_platform, b.source_platform) AS source_platform,
                  coalesce(task_count, 0) AS task_count, coalesce(data_count, 0) AS data_count
           FROM (SELECT source_platform, count(*) AS task_count FROM task_request GROUP BY 1) a
           FULL JOIN (SELECT source AS source_platform, count(*) AS data_count FROM documents GROUP BY 1) b
           ON a.source_platform = b.source_platform""",
        "task_request",
    )
)
def platform_stats(t: Tables) -> DataFrame:
    rows = t.given("documents").select(F.col("source").alias("source_platform"))
    return counts.platform_stats(t.task_request, rows)


@query(
    sql(
        """SELECT status, count(*) AS task_count,
                  CASE status WHEN 0 THEN '待启动' WHEN 2 THEN '运行中' WHEN 3 THEN '已完成' END AS status_label
           FROM task GROUP BY status""",
        "task",
    )
)
def tasks_by_status(t: Tables) -> DataFrame:
    return counts.tasks_by_status(t.task)


# --- joins -----------------------------------------------------------------------------------


@query(
    sql(
        """SELECT t.id, t.source_platform, r.crawl_rule,
                  CASE WHEN r.source_platform IS NULL THEN 'no_rule' ELSE 'ok' END AS rule_status
           FROM task t LEFT JOIN rule r USING (source_platform)""",
        "task",
        "rule",
    )
)
def tasks_with_rule(t: Tables) -> DataFrame:
    joined = tasks.tasks_with_rule(t.task, t.rule)
    return joined.select("id", "source_platform", "crawl_rule", "rule_status")


@query(
    sql(
        """SELECT t.id, t.status, r.id AS run_id, r.status AS run_status, r.priority AS run_priority
           FROM task t LEFT JOIN task_run r USING (task_fingerprint)""",
        "task_run",
    )
)
def tasks_with_run(t: Tables) -> DataFrame:
    joined = tasks.tasks_with_run(t.task, t.task_run)
    return joined.select("id", "status", "run_id", "run_status", "run_priority")


@query(
    sql(
        "SELECT event_id AS id, user_id * 20 AS user_id FROM events "
        "WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id * 20)"
    )
)
def orphan_tasks(t: Tables) -> DataFrame:
    owned = t.given("events").select(F.col("event_id").alias("id"), (F.col("user_id") * 20).alias("user_id"))
    return integrity.orphan_tasks(owned, t.user)


@query(
    sql(
        "SELECT id, config_id FROM query_t q WHERE NOT EXISTS (SELECT 1 FROM config c WHERE c.id = q.config_id)",
        "query",
        "config",
    )
)
def orphan_queries(t: Tables) -> DataFrame:
    return integrity.orphan_queries(t.query, t.config).select("id", "config_id")


@query(
    sql(
        """SELECT seq, task_fingerprint,
                  task_fingerprint IN (SELECT task_fingerprint FROM task_seen) AS already_exists
           FROM task_request""",
        "task_request",
        "task_seen",
    )
)
def exists_in(t: Tables) -> DataFrame:
    requests = hashing.task_fingerprint(t.task_request).select("seq", "task_fingerprint")
    return integrity.exists_in(requests, t.task_seen, "task_fingerprint")


def _email_patches(t: Tables) -> DataFrame:
    """Each supplier's number patches a user to the email of the user of its nation's number."""
    return t.given("supplier").select(
        F.col("s_suppkey").alias("seq"),
        F.col("s_suppkey").alias("id"),
        F.when(
            F.col("s_acctbal") > 0,
            F.concat(F.lit("customer."), F.lpad(F.col("s_nationkey").cast("string"), 9, "0"), F.lit("@example.com")),
        ).alias("email"),
    )


_EMAIL_PATCHES = """SELECT s_suppkey AS seq, s_suppkey AS id, CASE WHEN s_acctbal > 0
    THEN 'customer.' || lpad(s_nationkey::VARCHAR, 9, '0') || '@example.com' END AS email FROM supplier"""


@query(
    sql(
        "SELECT p.*, u.id AS holder_id FROM patch p JOIN user_t u ON u.email = p.email AND u.id <> p.id",
        "user",
        patch=_EMAIL_PATCHES,
    )
)
def email_conflicts(t: Tables) -> DataFrame:
    return integrity.email_conflicts(_email_patches(t), t.user)


# --- fingerprints and admission --------------------------------------------------------------


@query(sql("SELECT seq, task_fingerprint FROM task_request", "task_request"))
def task_fingerprint(t: Tables) -> DataFrame:
    return hashing.task_fingerprint(t.task_request).select("seq", "task_fingerprint")


@query(
    sql(
        "SELECT seq, md5(source_platform || chr(10) || replace(task_content, ' ', '')) AS task_fingerprint "
        "FROM task_request",
        "task_request",
    )
)
def task_fingerprint_canonical(t: Tables) -> DataFrame:
    return hashing.task_fingerprint(t.task_request, "canonical").select("seq", "task_fingerprint")


# One-by-one admission: each step takes the next request whose two keys are still free.
_ADMITTED = {
    "numbered": """
        SELECT min(r.seq) AS seq, dense_rank() OVER (ORDER BY r.task_fingerprint) AS f,
               dense_rank() OVER (ORDER BY r.user_id, r.task_name) AS n
        FROM task_request r
        WHERE r.task_fingerprint NOT IN (SELECT task_fingerprint FROM task_seen)
          AND (r.user_id, r.task_name) NOT IN (SELECT (user_id, task_name) FROM task_seen)
        GROUP BY r.task_fingerprint, r.user_id, r.task_name""",
    "walk(seq, fs, ns)": """
        SELECT -1::BIGINT, []::BIGINT[], []::BIGINT[]
        UNION ALL
        SELECT min(c.seq), list_append(any_value(w.fs), arg_min(c.f, c.seq)),
               list_append(any_value(w.ns), arg_min(c.n, c.seq))
        FROM walk w JOIN numbered c ON c.seq > w.seq AND NOT list_contains(w.fs, c.f)
                                   AND NOT list_contains(w.ns, c.n)
        HAVING count(*) > 0""",
    "judged": """
        SELECT r.*, r.seq IN (SELECT seq FROM walk) AS ok, s.task_group AS old_group, s.task_name AS old_name,
               a.task_group AS new_group, a.task_name AS new_name
        FROM task_request r LEFT JOIN task_seen s ON s.task_fingerprint = r.task_fingerprint
        LEFT JOIN (SELECT * FROM task_request WHERE seq IN (SELECT seq FROM walk)) a
          ON a.task_fingerprint = r.task_fingerprint AND a.seq < r.seq""",
}


def _admission_sql(body: str) -> str:
    return sql(body, "task_request", "task_seen", **_ADMITTED).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    _admission_sql(
        """SELECT seq, task_fingerprint, user_id, task_name, CASE WHEN ok THEN 200 ELSE 400 END AS outcome,
             CASE WHEN ok THEN NULL WHEN coalesce(old_name, new_name) IS NOT NULL THEN 'duplicate_fingerprint'
                  ELSE 'duplicate_name' END AS reason,
             CASE WHEN ok THEN NULL
                  WHEN old_name IS NOT NULL THEN '该任务已在系统中存在：[' || old_group || ' - ' || old_name || ']'
                  WHEN new_name IS NOT NULL THEN '该任务已在系统中存在：[' || new_group || ' - ' || new_name || ']'
                  ELSE '该任务名称 [' || task_name || '] 重复，请更换名称。' END AS message
           FROM judged"""
    )
)
def admit_tasks(t: Tables) -> DataFrame:
    return tasks.admit_tasks(t.task_request, t.task_seen, _now()).outcomes


@query(
    _admission_sql(
        """SELECT id::VARCHAR AS id, task_group, task_name, task_content, source_platform, task_fingerprint, status, is_delete,
                  TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at, user_id FROM task_seen
           UNION ALL
           SELECT regexp_replace(md5(task_fingerprint), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5'),
                  task_group, task_name, task_content, source_platform, task_fingerprint, 0::SMALLINT, FALSE,
                  TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01', user_id FROM judged WHERE ok"""
    )
)
def admit_tasks_state(t: Tables) -> DataFrame:
    accepted = tasks.admit_tasks(t.task_request, t.task_seen, _now()).accepted
    seen = t.task_seen.withColumn("id", F.col("id").cast("string")).select(*schemas.TASK_COLUMNS)
    return stored.append_rows(seen, accepted).select(*TASK_FIELDS.split(", "))


@query(
    sql(
        "SELECT seq, user_id, source_platform, task_content, task_fingerprint FROM task_request "
        "QUALIFY row_number() OVER (PARTITION BY task_fingerprint ORDER BY seq) = 1",
        "task_request",
    )
)
def first_per_key(t: Tables) -> DataFrame:
    requests = hashing.task_fingerprint(t.task_request)
    narrow = requests.select("seq", "user_id", "source_platform", "task_content", "task_fingerprint")
    return paging.first_per_key(narrow, "task_fingerprint", "seq")


def _chained_requests(t: Tables) -> DataFrame:
    """Events as chains of 5,000 requests: each shares its content with the one before or its name
    with the one after, in turn."""
    chain, i = F.floor(F.col("event_id") / 5000).cast("bigint"), F.col("event_id") % 5000
    content = F.concat(F.lit('{"k": '), F.floor((i + 1) / 2).cast("string"), F.lit(', "c": '), chain.cast("string"), F.lit("}"))
    return t.given("events").select(
        F.col("event_id").alias("seq"),
        chain.alias("user_id"),
        F.lit("chain").alias("source_platform"),
        content.alias("task_content"),
        F.concat(F.lit("n"), F.floor(i / 2).cast("string")).alias("task_name"),
        F.lit("events").alias("task_group"),
    )


@query(
    """SELECT seq, md5('chain{''k'': ' || (i + 1) // 2 || ', ''c'': ' || user_id || '}') AS task_fingerprint, user_id,
              'n' || i // 2 AS task_name, CASE WHEN i % 2 = 0 THEN 200 ELSE 400 END AS outcome,
              CASE WHEN i % 2 = 1 THEN 'duplicate_name' END AS reason,
              CASE WHEN i % 2 = 1 THEN '该任务名称 [n' || i // 2 || '] 重复，请更换名称。' END AS message
       FROM (SELECT event_id AS seq, event_id // 5000 AS user_id, event_id % 5000 AS i FROM events)"""
)
def admit_tasks_chain(t: Tables) -> DataFrame:
    return tasks.admit_tasks(_chained_requests(t), t.task_seen, _now()).outcomes


# --- runs and the task life cycle ------------------------------------------------------------


@query(
    sql(
        """SELECT task_fingerprint, source_platform, priority, crawl_task, status, enabled FROM task_run
             WHERE task_fingerprint NOT IN (SELECT task_fingerprint FROM fresh)
           UNION ALL SELECT * FROM fresh""",
        "task_run",
        "action",
        fresh="""SELECT task_fingerprint, any_value(source_platform) AS source_platform,
                        max(seq % 5)::SMALLINT AS priority, '{"new":1}' AS crawl_task, 0::SMALLINT AS status,
                        FALSE AS enabled
                 FROM (SELECT * FROM action WHERE task_fingerprint IS NOT NULL
                       QUALIFY row_number() OVER (PARTITION BY task_fingerprint ORDER BY seq DESC) = 1)
                 GROUP BY task_fingerprint""",
    )
)
def upsert_runs(t: Tables) -> DataFrame:
    asked = access.task_access(t.action_request, t.task, t.user, carry=("task_fingerprint", "source_platform"))
    fresh = asked.where(F.col("task_fingerprint").isNotNull()).select(
        "seq",
        integrity.row_id("task_fingerprint", "seq").alias("id"),
        "task_fingerprint",
        "source_platform",
        (F.col("seq") % 5).cast("smallint").alias("priority"),
        F.lit("0 0 * * *").alias("cron_expr"),
        F.lit('{"new":1}').alias("crawl_task"),
        F.lit(0).cast("smallint").alias("status"),
        F.lit(None).cast("string").alias("error_reason"),
        F.lit(False).alias("enabled"),
        _now().alias("started_at"),
        _now().alias("finished_at"),
    )
    state = tasks.upsert_runs(fresh, t.task_run)
    return state.select("task_fingerprint", "source_platform", "priority", "crawl_task", "status", "enabled")


def _task_patches(t: Tables) -> DataFrame:
    """Two kinds of patches on tasks: clicks regroup and undelete, purchases rename or send a null."""
    click = F.col("event_type") == "click"
    return (
        t.given("events")
        .where(F.col("event_type").isin("click", "purchase"))
        .select(
            F.col("event_id").alias("seq"),
            (F.col("user_id") * 120).alias("id"),
            F.when(click, F.concat(F.lit("group "), F.col("event_id").cast("string"))).alias("task_group"),
            F.when(~click & (F.col("value") > 20), F.concat(F.lit("name "), F.col("event_id").cast("string"))).alias(
                "task_name"
            ),
            F.when(click, F.lit(False)).alias("is_delete"),
            F.when(click, F.array(F.lit("task_group"), F.lit("is_delete")))
            .otherwise(F.array(F.lit("task_name")))
            .alias("present"),
        )
    )


_PATCH = """SELECT event_id AS seq, e.user_id * 120 AS id, event_type = 'click' AS click, value > 20 AS named,
    CASE WHEN t.id IS NULL THEN 404 WHEN event_type = 'purchase' AND value <= 20 THEN 500 ELSE 200 END AS outcome
    FROM events e LEFT JOIN task t ON t.id = e.user_id * 120 WHERE event_type IN ('click', 'purchase')"""


@query(
    sql(
        """SELECT seq, id, outcome, CASE outcome WHEN 404 THEN 'not found' WHEN 500 THEN 'null in task_name' END AS reason
           FROM patch""",
        "task",
        patch=_PATCH,
    )
)
def patch_rows(t: Tables) -> DataFrame:
    return patching.patch_rows(t.task, _task_patches(t)).outcomes


@query(
    sql(
        """SELECT t.id, CASE WHEN c.seq IS NULL THEN task_group ELSE 'group ' || c.seq END AS task_group,
                  CASE WHEN p.seq IS NULL THEN task_name ELSE 'name ' || p.seq END AS task_name,
                  c.seq IS NULL AND is_delete AS is_delete, status, task_content
           FROM task t
           LEFT JOIN (SELECT id, max(seq) AS seq FROM patch WHERE outcome = 200 AND click GROUP BY id) c USING (id)
           LEFT JOIN (SELECT id, max(seq) AS seq FROM patch WHERE outcome = 200 AND NOT click GROUP BY id) p USING (id)""",
        "task",
        patch=_PATCH,
    )
)
def patch_rows_state(t: Tables) -> DataFrame:
    state = patching.patch_rows(t.task, _task_patches(t)).state
    return state.select("id", "task_group", "task_name", "is_delete", "status", "task_content")


def _task_updates(t: Tables) -> DataFrame:
    """Requests on tasks as patches: a group, a name (some of them null) or the deleted flag in turn."""
    kind, number = F.col("seq") % 3, F.col("seq").cast("string")
    return t.action_request.select(
        "*",
        F.when(kind == 0, F.concat(F.lit("group "), number)).alias("task_group"),
        F.when((kind == 1) & (F.col("seq") % 5 > 0), F.concat(F.lit("name "), number)).alias("task_name"),
        F.when(kind == 2, F.lit(True)).alias("is_delete"),
        F.array(F.element_at(F.array(*[F.lit(f) for f in patching.TASK_PATCH_FIELDS]), (kind + 1).cast("int"))).alias("present"),
    )


_UPDATED = """SELECT *, CASE WHEN outcome = 200 AND seq % 3 = 1 AND seq % 5 = 0 THEN 500 ELSE outcome END AS code FROM action"""


@query(
    sql(
        """SELECT seq, user_id, task_id, code AS outcome, CASE WHEN code = 500 THEN 'null in task_name' ELSE refusal END AS reason
           FROM updated""",
        "action",
        updated=_UPDATED,
    )
)
def update_tasks(t: Tables) -> DataFrame:
    return tasks.update_tasks(_task_updates(t), t.task, t.user).outcomes


@query(
    sql(
        """SELECT id, coalesce('group ' || g, task_group) AS task_group, coalesce('name ' || n, task_name) AS task_name,
                  is_delete OR d IS NOT NULL AS is_delete, task_content, source_platform, task_fingerprint, status,
                  created_at, updated_at, user_id
           FROM task LEFT JOIN (
             SELECT task_id AS id, max(seq) FILTER (WHERE seq % 3 = 0) AS g, max(seq) FILTER (WHERE seq % 3 = 1) AS n,
                    max(seq) FILTER (WHERE seq % 3 = 2) AS d FROM updated WHERE code = 200 GROUP BY task_id) USING (id)""",
        "action",
        updated=_UPDATED,
    )
)
def update_tasks_state(t: Tables) -> DataFrame:
    return tasks.update_tasks(_task_updates(t), t.task, t.user).state


_BEGIN = """SELECT a.*, CASE WHEN outcome = 200 THEN
      CASE WHEN r.source_platform IS NULL THEN '抓取规则设置错误'
           WHEN NOT contains(r.crawl_rule, '"basic"') THEN '''basic'''
           WHEN NOT contains(task_content, 'cron_expr') THEN '''cron_expr''' END END AS fault
    FROM action a LEFT JOIN rule r ON r.source_platform = a.source_platform"""
_BEGUN = "SELECT DISTINCT task_id FROM begin WHERE outcome = 200 AND fault IS NULL"


@query(
    sql(
        f"""SELECT seq, user_id, task_id, CASE WHEN fault IS NOT NULL THEN 400 ELSE outcome END AS outcome,
                   coalesce(fault, refusal) AS reason FROM begin""",
        "action",
        "rule",
        begin=_BEGIN,
    )
)
def begin_tasks(t: Tables) -> DataFrame:
    return tasks.begin_tasks(t.action_request, t.task, t.rule, t.task_run, t.user, _now()).outcomes


@query(
    sql(
        f"""SELECT id, CASE WHEN id IN ({_BEGUN}) THEN 1 ELSE status END::SMALLINT AS status, is_delete, task_fingerprint
            FROM task""",
        "action",
        "rule",
        begin=_BEGIN,
    )
)
def begin_tasks_state(t: Tables) -> DataFrame:
    state = tasks.begin_tasks(t.action_request, t.task, t.rule, t.task_run, t.user, _now()).tasks
    return state.select("id", "status", "is_delete", "task_fingerprint")


@query(
    sql(
        f"""SELECT task_fingerprint, source_platform, priority, cron_expr, crawl_task, status, enabled FROM task_run
              WHERE task_fingerprint NOT IN (SELECT task_fingerprint FROM task WHERE id IN ({_BEGUN}))
            UNION ALL
            SELECT task_fingerprint, source_platform, (id % 10)::SMALLINT, '0 ' || (id % 24) || ' * * *',
                   CASE WHEN source_platform = '1-URGENT'
                        THEN '{{"priority":' || (id % 10) || ',"target":"' || id || '"}}'
                        ELSE '{{"target":"' || id || '"}}' END, 0::SMALLINT, FALSE
            FROM task WHERE id IN ({_BEGUN})""",
        "action",
        "rule",
        "task_run",
        begin=_BEGIN,
    )
)
def begin_tasks_runs(t: Tables) -> DataFrame:
    state = tasks.begin_tasks(t.action_request, t.task, t.rule, t.task_run, t.user, _now()).runs
    return state.select(
        "task_fingerprint", "source_platform", "priority", "cron_expr", "crawl_task", "status", "enabled"
    )


_END = """SELECT a.*, outcome = 200 AND task_fingerprint NOT IN (SELECT task_fingerprint FROM task_run) AS no_run
    FROM action a"""
_ENDED = "SELECT task_id FROM ended WHERE outcome = 200 AND NOT no_run"


@query(
    sql(
        f"""SELECT seq, user_id, task_id, CASE WHEN no_run THEN 500 ELSE outcome END AS outcome,
                   CASE WHEN no_run THEN 'no_run' ELSE refusal END AS reason FROM ended""",
        "action",
        "task_run",
        ended=_END,
    )
)
def stop_tasks(t: Tables) -> DataFrame:
    return tasks.stop_tasks(t.action_request, t.task, t.task_run, t.user).outcomes


@query(
    sql(
        f"SELECT id, CASE WHEN id IN ({_ENDED}) THEN -2 ELSE status END::SMALLINT AS status, is_delete FROM task",
        "action",
        "task_run",
        ended=_END,
    )
)
def stop_tasks_state(t: Tables) -> DataFrame:
    return tasks.stop_tasks(t.action_request, t.task, t.task_run, t.user).tasks.select("id", "status", "is_delete")


@query(
    sql(
        f"SELECT id, status, is_delete OR id IN ({_ENDED}) AS is_delete FROM task",
        "action",
        "task_run",
        ended=_END,
    )
)
def remove_tasks(t: Tables) -> DataFrame:
    return tasks.remove_tasks(t.action_request, t.task, t.task_run, t.user).tasks.select("id", "status", "is_delete")


@query(
    sql(
        f"""SELECT r.id, CASE WHEN t.id IN ({_ENDED}) THEN -2 ELSE r.status END::SMALLINT AS status
            FROM task_run r JOIN task t USING (task_fingerprint)""",
        "action",
        "task_run",
        ended=_END,
    )
)
def remove_tasks_runs(t: Tables) -> DataFrame:
    return tasks.remove_tasks(t.action_request, t.task, t.task_run, t.user).runs.select("id", "status")


# --- users -----------------------------------------------------------------------------------


def _user_requests(t: Tables) -> DataFrame:
    """Each event asks for a user named after its type and the event's user number."""
    email = F.when(
        F.col("event_type") == "signup",
        F.concat(F.lit("customer."), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@example.com")),
    ).otherwise(F.concat_ws("", "event_type", F.col("user_id").cast("string"), F.lit("@example.com")))
    return t.given("events").select(
        F.col("event_id").alias("seq"), email.alias("email"), F.md5("props").alias("hashed_password")
    )


_USER_REQUESTS = """SELECT event_id AS seq, md5(props) AS hashed_password,
    CASE WHEN event_type = 'signup' THEN 'customer.' || lpad(user_id::VARCHAR, 9, '0') || '@example.com'
         ELSE event_type || user_id || '@example.com' END AS email FROM events"""
_USER_JUDGED = """SELECT r.*, seq = min(seq) OVER (PARTITION BY r.email)
    AND r.email NOT IN (SELECT email FROM user_t) AS ok FROM req r"""


@query(
    sql(
        """SELECT seq, email, CASE WHEN ok THEN 200 ELSE 400 END AS outcome,
                  CASE WHEN NOT ok THEN '该邮箱对应的用户已在系统中存在。' END AS reason FROM judged""",
        "user",
        req=_USER_REQUESTS,
        judged=_USER_JUDGED,
    )
)
def admit_users(t: Tables) -> DataFrame:
    return users.admit_users(_user_requests(t), t.user, _now()).outcomes


@query(
    sql(
        """SELECT email, hashed_password, is_active, is_superuser, full_name FROM user_t
           UNION ALL SELECT email, hashed_password, TRUE, FALSE, NULL FROM judged WHERE ok""",
        "user",
        req=_USER_REQUESTS,
        judged=_USER_JUDGED,
    )
)
def admit_users_state(t: Tables) -> DataFrame:
    base = t.user.withColumn("id", F.col("id").cast("string"))
    state = stored.append_rows(base, users.admit_users(_user_requests(t), t.user, _now()).accepted)
    return state.select("email", "hashed_password", "is_active", "is_superuser", "full_name")


def _delete_requests(t: Tables) -> DataFrame:
    """Each event asks to delete a user; actors are often superusers, and clicks ask for the actor
    or for another superuser."""
    actor = F.when(F.col("event_id") % 3 > 0, F.col("user_id") - F.col("user_id") % 100 + 100).otherwise(F.col("user_id"))
    other = F.floor(F.col("value") * 30).cast("bigint")
    target = F.when(F.col("event_type") != "click", other).when(F.col("event_id") % 2 == 0, actor)
    return t.given("events").select(
        F.col("event_id").alias("seq"), actor.alias("actor_id"), target.otherwise(other - other % 100).alias("user_id")
    )


# One by one: of the requests the state allows, each in turn is carried out unless its user or
# its actor was deleted before.
_DELETE = {
    "asked": """
        SELECT event_id AS seq, actor_id,
               CASE WHEN event_type <> 'click' THEN other WHEN event_id % 2 = 0 THEN actor_id
                    ELSE other - other % 100 END AS user_id
        FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN user_id - user_id % 100 + 100 ELSE user_id END AS actor_id,
                     floor(value * 30)::BIGINT AS other FROM events)""",
    "owner": "SELECT DISTINCT o_custkey * 2 AS user_id FROM orders",
    "del": """
        SELECT r.*, CASE WHEN a.id IS NULL THEN 404 WHEN NOT a.is_active THEN 400 WHEN NOT a.is_superuser THEN 403
                         WHEN u.id IS NULL THEN 404 WHEN r.user_id = r.actor_id THEN 403
                         WHEN o.user_id IS NOT NULL THEN 500 ELSE 200 END AS before,
               CASE WHEN a.id IS NULL THEN 'User not found' WHEN NOT a.is_active THEN 'Inactive user'
                    WHEN NOT a.is_superuser THEN '用户没有足够的权限。' WHEN u.id IS NULL THEN '用户不存在'
                    WHEN r.user_id = r.actor_id THEN '超级用户不允许自行删除。'
                    WHEN o.user_id IS NOT NULL THEN 'user still owns tasks' END AS why,
               coalesce(a.is_superuser AND a.is_active, FALSE) AS may
        FROM asked r LEFT JOIN user_t a ON a.id = r.actor_id LEFT JOIN user_t u ON u.id = r.user_id
        LEFT JOIN owner o ON o.user_id = r.user_id""",
    "walk(seq, gone)": """
        SELECT -1::BIGINT, []::BIGINT[]
        UNION ALL
        SELECT min(c.seq), list_append(any_value(w.gone), arg_min(c.user_id, c.seq))
        FROM walk w JOIN (SELECT * FROM del WHERE before = 200) c
          ON c.seq > w.seq AND NOT list_contains(w.gone, c.user_id) AND NOT list_contains(w.gone, c.actor_id)
        HAVING count(*) > 0""",
    "deleted": "SELECT d.user_id, d.seq FROM del d JOIN walk USING (seq)",
    "judged": """
        SELECT d.*, coalesce(g.seq < d.seq, FALSE) AS no_actor, coalesce(may AND x.seq < d.seq, FALSE) AS no_user
        FROM del d LEFT JOIN deleted g ON g.user_id = d.actor_id LEFT JOIN deleted x ON x.user_id = d.user_id""",
}


def _delete_sql(body: str) -> str:
    return sql(body, "user", **_DELETE).replace("WITH ", "WITH RECURSIVE ", 1)


def _owning(t: Tables) -> DataFrame:
    """Users of even number own the tasks, so that others can be deleted."""
    return t.given("orders").select((F.col("o_custkey") * 2).alias("user_id"))


@query(
    _delete_sql(
        """SELECT seq, actor_id, user_id, CASE WHEN no_actor OR no_user THEN 404 ELSE before END AS outcome,
                  CASE WHEN no_actor THEN 'User not found' WHEN no_user THEN '用户不存在' ELSE why END AS reason
           FROM judged"""
    )
)
def delete_users(t: Tables) -> DataFrame:
    return users.delete_users(_delete_requests(t), t.user, _owning(t)).outcomes


@query(_delete_sql("SELECT * FROM user_t WHERE id NOT IN (SELECT user_id FROM deleted)"))
def delete_users_state(t: Tables) -> DataFrame:
    return users.delete_users(_delete_requests(t), t.user, _owning(t)).state


@query(
    sql(
        "SELECT id, email, full_name FROM user_t UNION ALL SELECT * FROM seed "
        "WHERE email NOT IN (SELECT email FROM user_t)",
        "user",
        seed="""SELECT s_suppkey + 1000000000 AS id, 'customer.' || lpad((s_suppkey * 20)::VARCHAR, 9, '0')
                || '@example.com' AS email, '超级管理员' AS full_name FROM supplier""",
    )
)
def seed_if_absent(t: Tables) -> DataFrame:
    seed = t.given("supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("id"),
        F.concat(
            F.lit("customer."), F.lpad((F.col("s_suppkey") * 20).cast("string"), 9, "0"), F.lit("@example.com")
        ).alias("email"),
        F.lit("超级管理员").alias("full_name"),
    )
    return users.seed_if_absent(t.user.select("id", "email", "full_name"), seed, "email")


def _user_patches(t: Tables) -> DataFrame:
    """Events patch users: signups claim an email of their own number, views take another
    user's, clicks rename, errors send a null email, purchases share one address by user."""
    kind = F.col("event_type")
    number = F.lpad(F.col("user_id").cast("string"), 9, "0")
    email = (
        F.when(kind == "signup", F.concat(F.lit("new."), F.col("event_id").cast("string"), F.lit("@example.com")))
        .when(kind == "view", F.concat(F.lit("customer."), number, F.lit("@example.com")))
        .when(kind == "purchase", F.concat(F.lit("shared."), number, F.lit("@example.com")))
    )
    return t.given("events").select(
        F.col("event_id").alias("seq"),
        F.when(kind == "purchase", F.col("event_id")).otherwise(F.col("user_id") * 11).alias("id"),
        email.alias("email"),
        F.when(kind == "click", F.concat(F.lit("name "), F.col("event_id").cast("string"))).alias("full_name"),
        F.lit(None).cast("boolean").alias("is_active"),
        F.lit(None).cast("boolean").alias("is_superuser"),
        F.lit(None).cast("string").alias("hashed_password"),
        F.when(kind == "click", F.array(F.lit("full_name"))).otherwise(F.array(F.lit("email"))).alias("present"),
    )


_USER_PATCHES = """SELECT event_id AS seq, event_type AS kind,
    CASE WHEN event_type = 'purchase' THEN event_id ELSE user_id * 11 END AS id,
    CASE event_type WHEN 'signup' THEN 'new.' || event_id || '@example.com'
        WHEN 'view' THEN 'customer.' || lpad(user_id::VARCHAR, 9, '0') || '@example.com'
        WHEN 'purchase' THEN 'shared.' || lpad(user_id::VARCHAR, 9, '0') || '@example.com' END AS email
    FROM events"""
# One by one: each claim in turn meets whoever took the address last and has not moved on since.
_USER_CLAIMS = """SELECT row_number() OVER (ORDER BY p.seq) AS k, p.seq, p.id, h.id AS base,
        dense_rank() OVER (ORDER BY p.email) AS mail
    FROM patch p JOIN user_t u ON u.id = p.id LEFT JOIN user_t h ON h.email = p.email WHERE p.email IS NOT NULL"""
_USER_WALK = """
    SELECT 0::BIGINT, -1::BIGINT, FALSE, []::BIGINT[], []::BIGINT[]
    UNION ALL
    SELECT k, seq, ok, CASE WHEN ok THEN list_prepend(id, ids) ELSE ids END,
           CASE WHEN ok THEN list_prepend(mail, mails) ELSE mails END
    FROM (SELECT *, coalesce(CASE WHEN p = 0 THEN CASE WHEN coalesce(list_position(ids, base), 0) = 0 THEN base END
                                  WHEN list_position(ids, ids[p]) = p THEN ids[p] END, id) = id AS ok
          FROM (SELECT m.*, w.ids, w.mails, coalesce(list_position(w.mails, m.mail), 0) AS p
                FROM walk w JOIN claim m ON m.k = w.k + 1))"""
_USER_CLAIMED = """SELECT p.*, CASE WHEN u.id IS NULL THEN 404 WHEN NOT w.ok THEN 409 WHEN kind = 'error' THEN 500 ELSE 200 END AS outcome
    FROM patch p LEFT JOIN user_t u ON u.id = p.id LEFT JOIN walk w ON w.seq = p.seq"""
_USER_UPDATE = {
    "patch": _USER_PATCHES,
    "claim": _USER_CLAIMS,
    "walk(k, seq, ok, ids, mails)": _USER_WALK,
    "claimed": _USER_CLAIMED,
}


def _update_sql(body: str) -> str:
    return sql(body, "user", **_USER_UPDATE).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    _update_sql(
        """SELECT seq, id, outcome, CASE outcome WHEN 404 THEN '该用户ID在系统中不存在' WHEN 409 THEN '该邮箱的用户已存在'
             WHEN 500 THEN 'null in email' END AS reason FROM claimed"""
    )
)
def update_users(t: Tables) -> DataFrame:
    return users.update_users(_user_patches(t), t.user).outcomes


@query(
    _update_sql(
        """SELECT u.id, coalesce(e.email, u.email) AS email,
                  CASE WHEN n.seq IS NULL THEN u.full_name ELSE 'name ' || n.seq END AS full_name
           FROM user_t u
           LEFT JOIN (SELECT id, arg_max(email, seq) AS email FROM claimed
                      WHERE outcome = 200 AND kind <> 'click' GROUP BY id) e USING (id)
           LEFT JOIN (SELECT id, max(seq) AS seq FROM claimed WHERE outcome = 200 AND kind = 'click' GROUP BY id) n
             USING (id)"""
    )
)
def update_users_state(t: Tables) -> DataFrame:
    return users.update_users(_user_patches(t), t.user).state.select("id", "email", "full_name")


def _handed_over(t: Tables) -> DataFrame:
    """Of every three users a, b and c: a leaves its address, b takes it, a takes b's, c asks for
    that (held) and for the one a left between (free); b asks to rename c. A superuser acts but in the last."""
    number = F.floor(F.col("c_custkey") / 3).cast("bigint")
    address = lambda key: F.concat(F.lit("customer."), F.lpad(key.cast("string"), 9, "0"), F.lit("@example.com"))
    first = (number * 3).alias("a")
    trios = t.given("customer").where(F.col("c_custkey") % 3 == 2).select(first, number.alias("j"))
    a, b, c = F.col("a"), F.col("a") + 1, F.col("a") + 2
    actor, between = a - a % 100, F.concat(F.lit("between."), F.col("j").cast("string"), F.lit("@example.com"))
    steps = [
        (1, actor, a, between, None),
        (2, actor, b, address(a), None),
        (3, actor, a, address(b), None),
        (4, actor, c, address(b), None),
        (5, actor, c, between, None),
        (6, b, c, None, F.lit("renamed")),
    ]
    text = F.lit(None).cast("string")
    rows = [
        F.struct(
            (F.col("j") * 10 + n).alias("seq"),
            who.alias("actor_id"),
            whom.alias("id"),
            (text if mail is None else mail).alias("email"),
            (text if name is None else name).alias("full_name"),
            F.array(F.lit("email" if name is None else "full_name")).alias("present"),
        )
        for n, who, whom, mail, name in steps
    ]
    asked = trios.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    none = F.lit(None)
    return asked.withColumns(
        {"is_active": none.cast("boolean"), "is_superuser": none.cast("boolean"), "hashed_password": none.cast("string")}
    )


_HANDED = {
    "trio": """SELECT c_custkey // 3 AS j, c_custkey // 3 * 3 AS a FROM customer WHERE c_custkey % 3 = 2""",
    "step": """SELECT j * 10 + n AS seq, n, j, a, CASE WHEN n = 6 THEN a + 1 ELSE a - a % 100 END AS actor_id,
        CASE WHEN n IN (1, 3) THEN a WHEN n = 2 THEN a + 1 ELSE a + 2 END AS id FROM trio, range(1, 7) t(n)""",
    "judged": """SELECT s.*, CASE WHEN u.id IS NULL THEN 404 WHEN NOT u.is_active THEN 400 WHEN NOT u.is_superuser THEN 403
        WHEN n = 4 THEN 409 ELSE 200 END AS outcome FROM step s LEFT JOIN user_t u ON u.id = s.actor_id""",
}


@query(
    sql(
        """SELECT seq, id, outcome, CASE outcome WHEN 404 THEN 'User not found' WHEN 400 THEN 'Inactive user'
                  WHEN 403 THEN '用户没有足够的权限。' WHEN 409 THEN '该邮箱的用户已存在' END AS reason FROM judged""",
        "user",
        **_HANDED,
    )
)
def update_users_by_actor(t: Tables) -> DataFrame:
    return users.update_users(_handed_over(t), t.user).outcomes


@query(
    sql(
        """SELECT u.id, CASE WHEN m.id IS NULL THEN u.email WHEN m.n = 5 THEN 'between.' || m.j || '@example.com'
                  ELSE 'customer.' || lpad((CASE m.n WHEN 3 THEN a + 1 ELSE a END)::VARCHAR, 9, '0') || '@example.com'
                  END AS email,
                  CASE WHEN u.id IN (SELECT id FROM judged WHERE n = 6 AND outcome = 200) THEN 'renamed' ELSE full_name END
                  AS full_name, is_active, is_superuser, hashed_password, created_at
           FROM user_t u LEFT JOIN (SELECT * FROM judged WHERE n IN (2, 3, 5) AND outcome = 200) m USING (id)""",
        "user",
        **_HANDED,
    )
)
def update_users_by_actor_state(t: Tables) -> DataFrame:
    return users.update_users(_handed_over(t), t.user).state


def _gated_requests(t: Tables) -> DataFrame:
    actor = F.when(F.col("event_id") % 3 > 0, F.col("user_id") - F.col("user_id") % 100 + 100).otherwise(F.col("user_id"))
    asked = t.given("events").select(F.col("event_id").alias("seq"), actor.alias("actor_id"))
    return asked.join(_user_requests(t), "seq")


@query(
    sql(
        """SELECT seq, email, coalesce(refused, CASE WHEN seq = min(seq) FILTER (WHERE refused IS NULL) OVER (PARTITION BY email)
                      AND email NOT IN (SELECT email FROM user_t) THEN 200 ELSE 400 END) AS outcome,
                  CASE WHEN refused = 404 THEN 'User not found' WHEN refused = 400 THEN 'Inactive user'
                       WHEN refused = 403 THEN '用户没有足够的权限。'
                       WHEN seq = min(seq) FILTER (WHERE refused IS NULL) OVER (PARTITION BY email)
                            AND email NOT IN (SELECT email FROM user_t) THEN NULL
                       ELSE '该邮箱对应的用户已在系统中存在。' END AS reason
           FROM gated""",
        "user",
        req=_USER_REQUESTS,
        asked="""SELECT event_id AS seq, CASE WHEN event_id % 3 > 0 THEN user_id - user_id % 100 + 100 ELSE user_id END AS actor_id
                 FROM events""",
        gated="""SELECT r.*, CASE WHEN u.id IS NULL THEN 404 WHEN NOT u.is_active THEN 400 WHEN NOT u.is_superuser THEN 403 END
                 AS refused FROM req r JOIN asked USING (seq) LEFT JOIN user_t u ON u.id = actor_id""",
    )
)
def admit_users_by_actor(t: Tables) -> DataFrame:
    return users.admit_users(_gated_requests(t), t.user, _now()).outcomes


# --- integrity -------------------------------------------------------------------------------


@query(
    sql(
        "SELECT task_fingerprint, count(*) AS occurrences FROM task_request GROUP BY 1 HAVING count(*) > 1",
        "task_request",
    )
)
def unique_violations(t: Tables) -> DataFrame:
    return integrity.unique_violations(hashing.task_fingerprint(t.task_request), "task_fingerprint")


@query(
    """SELECT id, 'email' AS field, 'not_email' AS rule FROM (
         SELECT doc_id AS id, source || '@' || lang AS email FROM documents)
       UNION ALL SELECT doc_id, 'full_name', 'too_long' FROM documents WHERE length(text) > 255"""
)
def field_violations(t: Tables) -> DataFrame:
    rows = t.given("documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("source"), F.lit("@"), F.col("lang")).alias("email"),
        F.col("text").alias("full_name"),
    )
    return integrity.field_violations(rows, integrity.USER_RULES)


@query(
    sql(
        """SELECT seq, task_content, 'default group' AS task_group, 'default name' AS task_name, '' AS source_platform,
                  0::SMALLINT AS status, FALSE AS is_delete, TIMESTAMP '2024-01-01' AS created_at FROM task_request""",
        "task_request",
    )
)
def apply_defaults(t: Tables) -> DataFrame:
    sent = t.task_request.select("seq", "task_content")
    filled = integrity.apply_defaults(sent, integrity.TASK_DEFAULTS, ("created_at",), _now(), id_from=("seq",))
    return filled.drop("id")


# --- scalar functions ------------------------------------------------------------------------


@query("SELECT event_id, md5(event_type || props) AS full_hash, substr(md5(event_type || props), 9, 16) AS short_hash FROM events")
def md5_parts(t: Tables) -> DataFrame:
    return t.given("events").select(
        "event_id",
        hashing.md5_parts(["event_type", "props"]).alias("full_hash"),
        hashing.md5_parts(["event_type", "props"], short=True).alias("short_hash"),
    )


@query(sql("SELECT id, replace(task_content, '\"', '''') AS printed FROM task", "task"))
def py_repr(t: Tables) -> DataFrame:
    return t.task.select("id", hashing.py_repr("task_content").alias("printed"))


@query(
    "SELECT doc_id, printed FROM (SELECT doc_id, '{''lang'': ''' || lang || ''', ''scores'': ['"
    " || quality || ', None, ' || CASE WHEN toxic = 1 THEN 'True' ELSE 'False' END || ']}' AS printed"
    " FROM documents JOIN labels USING (doc_id))"
)
def py_repr_nested(t: Tables) -> DataFrame:
    rated = t.given("documents").join(t.given("labels"), "doc_id")
    nested = F.concat(
        F.lit('{"lang": "'),
        "lang",
        F.lit('", "scores": ['),
        F.col("quality").cast("string"),
        F.lit(", null, "),
        F.when(F.col("toxic") == 1, "true").otherwise("false"),
        F.lit("]}"),
    )
    return rated.select("doc_id", hashing.py_repr(nested).alias("printed"))


@query(
    """SELECT event_id, '{"a":' || user_id || ',"type":"' || event_type || '"}' AS canonical FROM events"""
)
def canonical_json(t: Tables) -> DataFrame:
    swapped = F.concat(
        F.lit('{"type": "'), "event_type", F.lit('", "a": '), F.col("user_id").cast("string"), F.lit("}")
    )
    return t.given("events").select("event_id", hashing.canonical_json(swapped).alias("canonical"))


@query(
    """SELECT conv_id || '-' || turn AS id, 'flattened' AS content_status,
              array_to_string(list_transform(string_split(text, chr(10)), lambda p: role || ':' || chr(10) || p), chr(10))
                AS content FROM conversations"""
)
def flatten_content(t: Tables) -> DataFrame:
    return content.flatten_content(t.content_json)


@query("SELECT doc_id AS id, 'raw' AS content_status, text AS content FROM documents")
def flatten_content_raw(t: Tables) -> DataFrame:
    return content.flatten_content(t.content_raw)


@query(
    sql(
        """SELECT t.id, CASE WHEN contains(r.crawl_rule, '"basic": {')
                            THEN '{"priority":' || (t.id % 10) || ',"target":"' || t.id || '"}'
                            WHEN contains(r.crawl_rule, '"basic"') THEN '{"target":"' || t.id || '"}' END AS crawl_task
           FROM task t JOIN rule r USING (source_platform)""",
        "task",
        "rule",
    )
)
def project_content(t: Tables) -> DataFrame:
    fields = t.rule.select("source_platform", content.rule_keys("crawl_rule").alias("rule_fields"))
    ruled = lookup_join(t.task, fields, "source_platform", "inner")
    return ruled.select("id", content.project_content(F.col("task_content"), "rule_fields").alias("crawl_task"))


@query(
    sql(
        """SELECT id, contains(task_content, 'cron_expr') AS is_complete,
                  CASE WHEN contains(task_content, 'cron_expr') THEN '' ELSE 'cron_expr' END AS missing FROM task""",
        "task",
    )
)
def require_json(t: Tables) -> DataFrame:
    checked = content.require_json(t.task, ("priority", "cron_expr"))
    return checked.select("id", "is_complete", F.concat_ws(",", "missing").alias("missing"))


@query(sql("SELECT id, coalesce(strftime(publish_time, '%Y/%m/%d %H:%M'), '-') AS shown FROM article", "article"))
def format_time(t: Tables) -> DataFrame:
    return t.article.select("id", display.format_time("publish_time").alias("shown"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS shown FROM documents")
def truncate_text(t: Tables) -> DataFrame:
    return t.given("documents").select("doc_id", display.truncate_text("text").alias("shown"))


_CODE = "CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN l_linenumber ELSE -l_linenumber END"


def _coded(t: Tables) -> DataFrame:
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    code = F.when(flag == "A", -1).when(flag == "N", number).otherwise(-number)
    return t.given("lineitem").select("l_orderkey", code.alias("code"))


@query(
    f"""SELECT l_orderkey, code, CASE code WHEN 0 THEN '待启动' WHEN 1 THEN '启动中' WHEN 2 THEN '运行中' WHEN 3 THEN '已完成'
          WHEN -1 THEN '失败' WHEN -2 THEN '已停止' ELSE '未知' END AS label
        FROM (SELECT l_orderkey, {_CODE} AS code FROM lineitem)"""
)
def status_label(t: Tables) -> DataFrame:
    return _coded(t).withColumn("label", display.status_label("code"))


@query(
    f"""SELECT l_orderkey, code, CASE WHEN code IN (1, 2) THEN 'running' WHEN code = 3 THEN 'completed'
          WHEN code = -1 THEN 'failed' WHEN code = -2 THEN 'stopped' ELSE 'pending' END AS class
        FROM (SELECT l_orderkey, {_CODE} AS code FROM lineitem)"""
)
def status_class(t: Tables) -> DataFrame:
    return _coded(t).withColumn("class", display.status_class("code"))


@query(
    sql(
        "SELECT id, coalesce(full_name, email) AS shown, upper(left(coalesce(full_name, email), 1)) AS initial FROM user_t",
        "user",
    )
)
def display_name(t: Tables) -> DataFrame:
    return t.user.select("id", display.display_name().alias("shown"), display.name_initial().alias("initial"))


@query(sql("SELECT id, CASE WHEN is_superuser THEN '管理员' ELSE '普通用户' END AS role FROM user_t", "user"))
def role_label(t: Tables) -> DataFrame:
    return t.user.select("id", display.role_label().alias("role"))


@query(sql("SELECT id, split_part(email, '@', 1) AS local_part FROM user_t", "user"))
def email_local(t: Tables) -> DataFrame:
    return t.user.select("id", display.email_local().alias("local_part"))


@query(sql("SELECT id, coalesce(nullif(full_name, ''), '-') AS shown FROM user_t", "user"))
def dash_if_empty(t: Tables) -> DataFrame:
    return t.user.select("id", display.dash_if_empty("full_name").alias("shown"))


@query(
    sql(
        """SELECT id, CASE status WHEN 0 THEN '该任务名称 [' || task_name || '] 重复，请更换名称。'
                    WHEN 3 THEN '该任务已在系统中存在：[' || task_group || ' - ' || task_name || ']' END AS message
           FROM task""",
        "task",
    )
)
def outcome_message(t: Tables) -> DataFrame:
    parts = {
        0: display.duplicate_name_message("task_name"),
        3: display.duplicate_task_message("task_group", "task_name"),
    }
    return t.task.select("id", display.outcome_message("status", parts).alias("message"))


# --- read paths end to end -------------------------------------------------------------------


def _registered_article(t: Tables) -> tuple[DataFrame, str]:
    """The registry with one entry for the article table, and the folder that table is stored in."""
    root = f"{checkpoint_folder(t.spark)}/browse-{uuid.uuid4().hex}"
    stored.write_state(t.article.where("publish_time IS NOT NULL"), f"{root}/article.parquet", cluster_by="id")
    name = F.when(F.col("id") == 3, F.lit("article")).otherwise(F.col("table_name"))
    return t.config.withColumn("table_name", name), root


_TIMED = "FROM article WHERE publish_time IS NOT NULL"


@query(sql(f"SELECT id, url, title, publish_time {_TIMED} {_NEWEST} LIMIT 20 OFFSET 40", "article"))
def browse_source(t: Tables) -> DataFrame:
    configs, root = _registered_article(t)
    return browse.browse_source(t.spark, configs, 3, root, 40, 20).rows


@query(sql(f"SELECT count(*) AS total_count {_TIMED}", "article"))
def browse_source_total(t: Tables) -> DataFrame:
    configs, root = _registered_article(t)
    return browse.browse_source(t.spark, configs, 3, root, 40, 20).total


_STORED_TIMED = f"SELECT * FROM ({_STORED}) WHERE publish_time IS NOT NULL"


def _run_and_count(t: Tables) -> browse.Page:
    t.article.where("publish_time IS NOT NULL").createOrReplaceTempView("article")
    return browse.run_and_count(t.spark, t.query, 7)


@query(sql(_STORED_TIMED, "article"))
def run_and_count(t: Tables) -> DataFrame:
    return _run_and_count(t).rows


@query(sql(f"SELECT count(*) AS total_count FROM ({_STORED_TIMED})", "article"))
def run_and_count_total(t: Tables) -> DataFrame:
    return _run_and_count(t).total


@query(sql(f"SELECT id, url, title, publish_time FROM article {_NEWEST} LIMIT 20", "article"))
def browse_table(t: Tables) -> DataFrame:
    return browse.browse(t.article, 0, 20).rows


@query(sql(f"SELECT {TASK_FIELDS.removesuffix(', user_id')} FROM task {NEWEST_TASK} LIMIT 100 OFFSET 100", "task"))
def list_tasks(t: Tables) -> DataFrame:
    return browse.list_table(t.task, "task", 100, 100).rows


@query(
    sql(
        "SELECT email, is_active, is_superuser, full_name, id, created_at FROM user_t "
        "ORDER BY created_at DESC NULLS FIRST, id LIMIT 100",
        "user",
    )
)
def list_users(t: Tables) -> DataFrame:
    return browse.list_table(t.user, "user").rows


@query(
    sql(
        """SELECT id, url, cover_url, title, description, author, publish_time, content
           FROM article_detail WHERE id IN (SELECT doc_id FROM labels)""",
        "article_detail",
    )
)
def read_details(t: Tables) -> DataFrame:
    ids = t.given("labels").select(F.col("doc_id").alias("id"))
    return browse.read_details(t.article_detail, ids)[0]
