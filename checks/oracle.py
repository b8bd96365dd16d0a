"""The same derived tables in DuckDB SQL, written independently of the Spark side."""

from __future__ import annotations

CTES = {
    "article": """
        SELECT page_id AS id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
               ts AS publish_time, event_type AS source_platform
        FROM pages LEFT JOIN events ON page_id = event_id""",
    "article_detail": """
        SELECT a.id, a.url, a.url || '/cover' AS cover_url, a.title, a.title AS description,
               d.source AS author, a.publish_time, d.text AS content, a.source_platform
        FROM article a JOIN documents d ON a.id = d.doc_id""",
    "article_bare": "SELECT url, length(html)::INTEGER AS html_length FROM pages",
    "user": """
        SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
               c_custkey % 13 <> 0 AS is_active, c_custkey % 100 = 0 AS is_superuser,
               CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS full_name,
               md5(c_name) AS hashed_password,
               TIMESTAMP '2024-01-01' + to_minutes(c_custkey::INTEGER) AS created_at
        FROM customer""",
    "task": """
        SELECT *, md5(source_platform || replace(task_content, '"', '''')) AS task_fingerprint
        FROM (
          SELECT o_orderkey AS id, o_orderpriority AS task_group, 'task ' || o_orderkey AS task_name,
                 '{"priority": ' || (o_orderkey % 10)
                   || CASE WHEN o_orderstatus <> 'P'
                           THEN ', "cron_expr": "0 ' || (o_orderkey % 24) || ' * * *"' ELSE '' END
                   || ', "target": "' || o_orderkey || '"}' AS task_content,
                 o_orderpriority AS source_platform,
                 (CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 0 ELSE 2 END)::SMALLINT AS status,
                 o_orderkey % 7 = 0 AS is_delete, o_orderdate AS created_at, o_orderdate AS updated_at,
                 o_custkey AS user_id
          FROM orders)""",
    "task_run": """
        SELECT 'run-' || id AS id, task_fingerprint, source_platform, (id % 10)::SMALLINT AS priority,
               '0 0 * * *' AS cron_expr, '{}' AS crawl_task, status, NULL::VARCHAR AS error_reason,
               TRUE AS enabled, created_at AS started_at, created_at AS finished_at
        FROM task WHERE status <> 0""",
    "rule": """
        SELECT o_orderpriority AS source_platform, min(o_orderkey) AS id,
               CASE o_orderpriority WHEN '1-URGENT' THEN '{"basic": {"target": "text", "priority": "int"}}'
                    WHEN '4-NOT SPECIFIED' THEN '{"extra": []}' ELSE '{"basic": ["target"]}' END AS crawl_rule,
               o_orderpriority <> '2-HIGH' AS enabled
        FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderpriority""",
    "task_request": """
        SELECT event_id AS seq, user_id, event_type AS source_platform, props AS task_content,
               event_type || '-' || floor(value)::BIGINT AS task_name, 'events' AS task_group,
               md5(event_type || replace(props, '"', '''')) AS task_fingerprint
        FROM events""",
    "task_seen": """
        SELECT *, md5(source_platform || replace(task_content, '"', '''')) AS task_fingerprint
        FROM (
          SELECT min(p_partkey) AS id, 'parts' AS task_group, 'view-' || p_size AS task_name,
                 '{"k": ' || p_size || '}' AS task_content, 'click' AS source_platform,
                 0::SMALLINT AS status, max(p_retailprice) < 999 AS is_delete,
                 p_size::BIGINT AS user_id
          FROM part GROUP BY p_size)""",
    "action_request": """
        SELECT o_orderkey AS seq, o_custkey AS user_id, o_orderkey AS task_id FROM orders
        UNION ALL
        SELECT event_id + 1000000000000, user_id, event_id * 2 FROM events""",
    "action": """
        SELECT r.seq, r.user_id, r.task_id, t.task_fingerprint, t.source_platform, t.task_content,
               CASE WHEN u.id IS NULL THEN 404 WHEN NOT u.is_active THEN 400 WHEN t.id IS NULL THEN 404
                    WHEN t.user_id = r.user_id OR u.is_superuser THEN 200 ELSE 403 END AS outcome,
               CASE WHEN u.id IS NULL THEN 'User not found' WHEN NOT u.is_active THEN 'Inactive user'
                    WHEN t.id IS NULL THEN '该任务在系统中不存在'
                    WHEN t.user_id <> r.user_id AND NOT u.is_superuser THEN '用户没有足够的权限' END AS refusal
        FROM action_request r LEFT JOIN task t ON t.id = r.task_id LEFT JOIN user_t u ON u.id = r.user_id""",
    "view_request": """
        SELECT event_id AS seq, user_id,
               CASE WHEN event_type = 'click' THEN user_id ELSE event_id END AS target_id
        FROM events""",
    "config": """
        SELECT s_suppkey AS id, s_name AS name, 'data_center' AS db_name,
               CASE WHEN s_suppkey % 2 = 1 THEN 'pages' ELSE 'documents' END AS table_name,
               s_acctbal > 0 AS enabled,
               TIMESTAMP '2024-01-01' + to_days(s_nationkey) AS created_at
        FROM supplier""",
    "query": """
        SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name,
               'SELECT id, url, title, publish_time FROM article WHERE length(title) > ' || p_size
                 || ' ORDER BY publish_time DESC, id -- stored' || chr(10) || ';' AS sql,
               floor(p_retailprice - 880)::BIGINT AS config_id, p_size > 10 AS enabled,
               TIMESTAMP '2024-01-01' + to_days(p_size) AS created_at
        FROM part""",
}
# `user` and `query` are SQL words: the CTEs carry a suffix
NAMES = {"user": "user_t", "query": "query_t"}
# what each table is built from
NEEDS = {
    "article_detail": ["article"],
    "task_run": ["task"],
    "action": ["user", "task", "action_request"],
}


def sql(body: str, *tables: str, **extra: str) -> str:
    """``body`` with the derived tables it uses (and ``extra`` named subqueries) before it."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for table in tables:
        add(table)
    parts = [f"{NAMES.get(n, n)} AS ({CTES[n]})" for n in wanted] + [f"{n} AS ({q})" for n, q in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
