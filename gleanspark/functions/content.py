"""JSON-in-text content: flattening articles, whitelisting task fields, required fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.json_text import (
    STRICT,
    compact,
    decoded,
    json_tokens,
    let,
    marked_pair,
    parts,
    shown,
    whole_value,
)

# Text that may be JSON at all; anything else is plain text without parsing.
_MAY_BE_JSON = r'^[ \t\r\n]*([\[{"]|-?[0-9]|true|false|null|NaN|-?Infinity)'


def _is_text(section: Column, field: str) -> Column:
    return F.coalesce(
        F.schema_of_variant(F.try_variant_get(section, f"$.{field}", "variant")) == F.lit("STRING"), F.lit(False)
    )


def _text_of(section: Column, field: str) -> Column:
    return F.try_variant_get(section, f"$.{field}", "string")


def _member(members: Column, name: str) -> Column:
    """Tokens of the value stored under a key, NULL if there is none."""
    return F.get(F.filter(members, lambda m: decoded(m["key"]) == name), F.lit(0))["value"]


def _section(item: Column) -> Column:
    """Title and body of an array's element as text, NULL if it is no object with both."""
    value = item["value"]

    def of(members: Column) -> Column:
        texts = F.transform(F.array(_member(members, "title"), _member(members, "body")), shown)
        return F.when(~F.exists(texts, F.isnull), F.array_join(texts, ":\n"))

    return F.when(F.get(value, F.lit(0)) == "{", let(parts(value), of))


def _any_shape(text: Column) -> Column:
    """``status`` and ``content`` of a text that may be JSON of any shape."""

    def of(tokens: Column) -> Column:
        listed = F.when(F.get(tokens, F.lit(0)) == "[", F.transform(parts(tokens), _section))

        def told(sections: Column) -> Column:
            flat = F.coalesce(~F.exists(sections, F.isnull), F.lit(False))
            # nothing to go through: an empty object or text has no sections that could be wrong
            empty = compact(tokens).isin("{}", '""')
            status = (
                F.when(tokens.isNull(), F.lit("raw")).when(flat | empty, F.lit("flattened")).otherwise(F.lit("bad_shape"))
            )
            joined = (
                F.when(tokens.isNull(), text).when(empty, F.lit("")).when(flat, F.array_join(sections, "\n"))
            )
            return F.struct(status.alias("status"), joined.alias("content"))

        return let(listed, told)

    return let(json_tokens(text), of)


def flatten_content(df: DataFrame, col: str = "content", status: str = "content_status") -> DataFrame:
    """Turn a JSON array of ``{title, body}`` into ``title:\\nbody`` sections; keep other text.

    The outcome is in ``status``: ``flattened``, ``raw`` (not JSON, kept whole) or
    ``bad_shape`` (NULL, or JSON of another shape; the content is NULL). Arrays whose titles
    and bodies are all strings are rendered inside the JVM, as is text that cannot be JSON.
    What is left (numbers, nested values, repeated keys, broken JSON) is taken apart into tokens.
    """
    text = F.col(col)
    sections = F.try_variant_get(whole_value(F.col("__pair"), text), "$", "array<variant>")
    regular = F.coalesce(
        F.forall("__sections", lambda s: _is_text(s, "title") & _is_text(s, "body")), F.lit(False)
    )
    rendered = F.array_join(
        F.transform("__sections", lambda s: F.concat(_text_of(s, "title"), F.lit(":\n"), _text_of(s, "body"))), "\n"
    )
    may_be_json = F.coalesce(text.rlike(_MAY_BE_JSON), F.lit(False))
    # one column per step, so that no text is parsed twice
    staged = (
        df.withColumn("__json", may_be_json)
        .withColumn("__pair", F.when(F.col("__json"), marked_pair(text)))
        .withColumn("__sections", sections)
        .withColumn("__regular", regular)
        .withColumn("__rest", F.when(F.col("__json") & ~F.col("__regular"), _any_shape(text)))
    )
    new_status = (
        F.when(text.isNull(), F.lit("bad_shape"))
        .when(~F.col("__json"), F.lit("raw"))
        .when(F.col("__regular"), F.lit("flattened"))
        .otherwise(F.col("__rest.status"))
    )
    new_text = F.when(~F.col("__json"), text).when(F.col("__regular"), rendered).otherwise(F.col("__rest.content"))
    return staged.withColumn(status, new_status).withColumn(col, new_text).select(*df.columns, status)


def rule_keys(rule: Column | str) -> Column:
    """Field names allowed by a rule's ``basic`` entry, given as an object or as a list."""
    basic = F.get_json_object(rule, "$.basic")
    listed = F.from_json(basic, "array<string>", STRICT)
    return F.when(F.ltrim(basic).startswith("["), listed).otherwise(F.json_object_keys(basic))


def compact_json(content: Column | str) -> Column:
    """The JSON text without spaces and with each key once, its last value at its first place;
    numbers, escapes and nested order as stored. NULL if the text is no JSON."""
    return compact(json_tokens(F.col(content) if isinstance(content, str) else content))


def project_content(content: Column | str, keys: Column | str) -> Column:
    """Keep the entries of a JSON object whose key is in ``keys``, in stored order.

    Values are cut out as stored, so nested order and spellings like ``2.50`` stay; of repeated
    keys the last value stays at the place of the first. NULL when there are no ``keys`` to go
    by, or the content is no JSON object.
    """
    text = F.col(content) if isinstance(content, str) else content
    allowed = F.col(keys) if isinstance(keys, str) else keys

    def of(tokens: Column) -> Column:
        kept = F.filter(parts(tokens), lambda m: F.array_contains(allowed, decoded(m["key"])))
        members = F.transform(kept, lambda m: F.concat(m["key"], F.lit(":"), compact(m["value"])))
        cut = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
        return F.when(F.get(tokens, F.lit(0)) == "{", cut)

    return F.when(allowed.isNotNull(), let(json_tokens(text), of))


def missing_fields(content: Column | str, fields: Sequence[str]) -> Column:
    """Names from ``fields`` the JSON object does not have. An explicit null counts as present."""
    present = F.coalesce(F.json_object_keys(content), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(f) for f in fields]), present)


def require_json(df: DataFrame, fields: Sequence[str], content: str = "task_content") -> DataFrame:
    """Add ``missing`` (array) and ``is_complete`` for the JSON fields a row needs."""
    return df.withColumn("missing", missing_fields(content, fields)).withColumn(
        "is_complete", F.size("missing") == 0
    )
