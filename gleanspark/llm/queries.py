"""The dealt operators and the pipeline as named queries over whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.bpe import round_trip
from gleanspark.llm.crosspolytope import embedding_groups
from gleanspark.llm.decontaminate import contamination
from gleanspark.llm.divergence import source_divergence
from gleanspark.llm.histogram_sort import histogram_shards
from gleanspark.llm.phrases import collocations
from gleanspark.llm.quality import quality_of
from gleanspark.llm.runlength import without_repeats
from gleanspark.llm.shared import shared_folder
from gleanspark.llm.simhash import simhash_groups
from gleanspark.llm.site_style import main_texts
from gleanspark.llm.surrogates import with_surrogates
from gleanspark.llm.unigram import counted
from gleanspark.llm.warc import page_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SURROGATE_KEY = "gleanspark"  # a deployment sets its own


@query
def op1_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return with_surrogates(table(spark, folder, "documents"), SURROGATE_KEY, count="n_entities")


@query
def op2_crosspolytope(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_groups(table(spark, folder, "embeddings"), cosine=0.9)


@query
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = round_trip(table(spark, folder, "documents"), path, pattern, kept=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_runlength(spark: SparkSession, folder: str) -> DataFrame:
    cut = without_repeats(table(spark, folder, "documents"), length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counted(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents"), words=3, radius=2)


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_of(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_histogram_sort(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    dealt = histogram_shards(docs, F.octet_length(text) + 8, shards=24)
    return dealt.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return page_records(table(spark, folder, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")


ORACLE["op9_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND first IS DISTINCT FROM page_id
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = """regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLE["op10_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (
  SELECT item_id, least(len(w), 10) AS size,
         unnest([list_slice(w, s, s + 9) FOR s IN range(1, greatest(len(w) - 9, 1) + 1)]) AS words
  FROM i WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT size FROM iw),
starts AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size
),
dw AS (SELECT doc_id, size, s, list_slice(w, s, s + size - 1) AS words FROM starts),
occ AS (SELECT DISTINCT doc_id, s, dw.size, item_id FROM dw JOIN iw ON dw.words = iw.words),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM occ) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM occ GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"))


ORACLE["op11_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY ALL),
x AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, total,
         sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS own,
         sum(total) OVER (PARTITION BY lang, source) AS spoken, count(*) OVER (PARTITION BY lang, source) AS words
  FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
),
s AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (own + 2 * words) AS HUGEINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (total + 2)) // (spoken + 2 * words) AS HUGEINT) AS q
  FROM x
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
every AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b USING (lang) LEFT JOIN pairs p USING (lang)
  WHERE a.source <> b.source AND ((p.source = a.source AND p.item = b.source) OR lang NOT IN (SELECT lang FROM v))
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM s WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10
"""


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


ORACLE["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
ns AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
starts AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM w, range(1, 6) t(size) WHERE len(w) >= size),
f AS (
  SELECT lang, size, list_slice(w, s, s + size - 1) AS words, count(*) AS f FROM starts GROUP BY ALL HAVING count(*) >= 100
),
cuts AS (
  SELECT c.lang, c.words, c.f AS a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
  JOIN f x ON x.lang = c.lang AND x.words = list_slice(c.words, 1, k)
  JOIN f y ON y.lang = c.lang AND y.words = list_slice(c.words, k + 1, c.size)
  JOIN ns ON ns.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.words ORDER BY score, k) = 1
),
inner_parts AS (
  SELECT lang, list_slice(words, s, s + part - 1) AS words, max(f) AS longer
  FROM (SELECT lang, words, size, f, part, unnest(range(1, size - part + 2)) AS s FROM f, range(2, 5) t(part) WHERE size > part)
  GROUP BY ALL
),
named AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score
  FROM cuts LEFT JOIN inner_parts USING (lang, words) WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000
"""


@query
def op13_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))
