"""The console's tables, derived in Spark from the given parquet tables.

Every table is computed from whole given tables, so its size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = "timestamp_ntz '2024-01-01 00:00:00'"


def _stored_fingerprint():
    """The fingerprint a stored task carries. Flat content prints as itself with single quotes."""
    return F.md5(F.concat("source_platform", F.translate("task_content", '"', "'")))


class Tables:
    """Derived tables of one data folder, each built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- articles ---------------------------------------------------------------------------

    @property
    def article(self) -> DataFrame:
        """Pages with the title from their markup and the time of the event of the same number."""
        return (
            self.given("pages")
            .join(self.given("events"), F.col("page_id") == F.col("event_id"), "left")
            .select(
                F.col("page_id").alias("id"),
                "url",
                F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
                F.col("ts").alias("publish_time"),
                F.col("event_type").alias("source_platform"),
            )
        )

    @property
    def article_detail(self) -> DataFrame:
        """Articles with all detail columns; the content is the whole document text."""
        documents = self.given("documents").select(
            F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("author")
        )
        return (
            self.article.join(documents, "id")
            .withColumn("cover_url", F.concat("url", F.lit("/cover")))
            .withColumn("description", F.col("title"))
            .select("id", "url", "cover_url", "title", "description", "author", "publish_time", "content", "source_platform")
        )

    @property
    def article_bare(self) -> DataFrame:
        return self.given("pages").select("url", F.length("html").alias("html_length"))

    @property
    def content_json(self) -> DataFrame:
        """Conversation turns as JSON arrays, one section per line of the turn."""
        sections = F.transform(
            F.split("text", "\n"), lambda line: F.struct(F.col("role").alias("title"), line.alias("body"))
        )
        return self.given("conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("id"), F.to_json(sections).alias("content")
        )

    @property
    def content_raw(self) -> DataFrame:
        return self.given("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))

    # -- users, tasks, runs, rules ----------------------------------------------------------

    @property
    def user(self) -> DataFrame:
        return self.given("customer").select(
            F.col("c_custkey").alias("id"),
            F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
            (F.col("c_custkey") % 13 != 0).alias("is_active"),
            (F.col("c_custkey") % 100 == 0).alias("is_superuser"),
            F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("full_name"),
            F.md5("c_name").alias("hashed_password"),
            F.expr(f"{START} + make_dt_interval(0, 0, cast(c_custkey as int))").alias("created_at"),
        )

    @property
    def task(self) -> DataFrame:
        """Orders as tasks. Content of orders in state P lacks a schedule."""
        key = F.col("o_orderkey").cast("string")
        schedule = F.when(
            F.col("o_orderstatus") != "P",
            F.concat(F.lit(', "cron_expr": "0 '), (F.col("o_orderkey") % 24).cast("string"), F.lit(' * * *"')),
        ).otherwise(F.lit(""))
        content = F.concat(
            F.lit('{"priority": '),
            (F.col("o_orderkey") % 10).cast("string"),
            schedule,
            F.lit(', "target": "'),
            key,
            F.lit('"}'),
        )
        tasks = self.given("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderpriority").alias("task_group"),
            F.concat(F.lit("task "), key).alias("task_name"),
            content.alias("task_content"),
            F.col("o_orderpriority").alias("source_platform"),
            F.when(F.col("o_orderstatus") == "F", 3)
            .when(F.col("o_orderstatus") == "O", 0)
            .otherwise(2)
            .cast("smallint")
            .alias("status"),
            (F.col("o_orderkey") % 7 == 0).alias("is_delete"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
            F.col("o_custkey").alias("user_id"),
        )
        return tasks.withColumn("task_fingerprint", _stored_fingerprint())

    @property
    def task_run(self) -> DataFrame:
        """Runs of the tasks that are not pending."""
        return self.task.where(F.col("status") != 0).select(
            F.concat(F.lit("run-"), F.col("id").cast("string")).alias("id"),
            "task_fingerprint",
            "source_platform",
            (F.col("id") % 10).cast("smallint").alias("priority"),
            F.lit("0 0 * * *").alias("cron_expr"),
            F.lit("{}").alias("crawl_task"),
            "status",
            F.lit(None).cast("string").alias("error_reason"),
            F.lit(True).alias("enabled"),
            F.col("created_at").alias("started_at"),
            F.col("created_at").alias("finished_at"),
        )

    @property
    def rule(self) -> DataFrame:
        """One rule per platform seen in the orders, none for low priority; the allowed fields
        stand in an object for urgent orders and in a list for the others."""
        return (
            self.given("orders")
            .where(F.col("o_orderpriority") != "5-LOW")
            .groupBy(F.col("o_orderpriority").alias("source_platform"))
            .agg(F.min("o_orderkey").alias("id"))
            .withColumn(
                "crawl_rule",
                F.when(F.col("source_platform") == "1-URGENT", F.lit('{"basic": {"target": "text", "priority": "int"}}'))
                .when(F.col("source_platform") == "4-NOT SPECIFIED", F.lit('{"extra": []}'))
                .otherwise(F.lit('{"basic": ["target"]}')),
            )
            .withColumn("enabled", F.col("source_platform") != "2-HIGH")
        )

    @property
    def task_request(self) -> DataFrame:
        """Events as requests for new tasks."""
        return self.given("events").select(
            F.col("event_id").alias("seq"),
            "user_id",
            F.col("event_type").alias("source_platform"),
            F.col("props").alias("task_content"),
            F.concat_ws("-", "event_type", F.floor("value").cast("string")).alias("task_name"),
            F.lit("events").alias("task_group"),
        )

    @property
    def task_seen(self) -> DataFrame:
        """Tasks that exist before the requests: one per part size."""
        size = F.col("p_size").cast("string")
        seen = (
            self.given("part")
            .groupBy("p_size")
            .agg(F.min("p_partkey").alias("id"), F.max("p_retailprice").alias("price"))
            .select(
                "id",
                F.lit("parts").alias("task_group"),
                F.concat(F.lit("view-"), size).alias("task_name"),
                F.concat(F.lit('{"k": '), size, F.lit("}")).alias("task_content"),
                F.lit("click").alias("source_platform"),
                F.lit(0).cast("smallint").alias("status"),
                (F.col("price") < 999).alias("is_delete"),
                F.expr(START).alias("created_at"),
                F.expr(START).alias("updated_at"),
                F.col("p_size").cast("bigint").alias("user_id"),
            )
        )
        return seen.withColumn("task_fingerprint", _stored_fingerprint())

    @property
    def action_request(self) -> DataFrame:
        """Requests on tasks: each order by its customer, and each event's user on another order."""
        own = self.given("orders").select(
            F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("task_id")
        )
        other = self.given("events").select(
            (F.col("event_id") + F.lit(1_000_000_000_000)).alias("seq"),
            "user_id",
            (F.col("event_id") * 2).alias("task_id"),
        )
        return own.unionByName(other)

    @property
    def view_request(self) -> DataFrame:
        """Each event's user asks to read a user, some of them themselves, some unknown."""
        return self.given("events").select(
            F.col("event_id").alias("seq"),
            "user_id",
            F.when(F.col("event_type") == "click", F.col("user_id")).otherwise(F.col("event_id")).alias("target_id"),
        )

    # -- registry ---------------------------------------------------------------------------

    @property
    def config(self) -> DataFrame:
        """Suppliers as registry entries; creation times have ties."""
        return self.given("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.lit("data_center").alias("db_name"),
            F.when(F.col("s_suppkey") % 2 == 1, F.lit("pages")).otherwise(F.lit("documents")).alias("table_name"),
            (F.col("s_acctbal") > 0).alias("enabled"),
            F.expr(f"{START} + make_dt_interval(s_nationkey)").alias("created_at"),
        )

    @property
    def query(self) -> DataFrame:
        """Parts as stored queries on the article table; some entries do not exist."""
        text = F.concat(
            F.lit("SELECT id, url, title, publish_time FROM article WHERE length(title) > "),
            F.col("p_size").cast("string"),
            F.lit(" ORDER BY publish_time DESC, id -- stored\n;"),
        )
        return self.given("part").select(
            F.col("p_partkey").alias("id"),
            F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
            text.alias("sql"),
            F.floor(F.col("p_retailprice") - 880).cast("bigint").alias("config_id"),
            (F.col("p_size") > 10).alias("enabled"),
            F.expr(f"{START} + make_dt_interval(p_size)").alias("created_at"),
        )
