"""Content fingerprints: md5 over parts joined without a delimiter.

A task's fingerprint hashes the platform followed by the *printed* form of its content
(quotes and keywords as Python prints a dict, keys in stored order). Flat objects of
plain strings and integers, the usual case, are rendered by a translation of quotes; any other
content is taken apart into tokens (`json_text`). Content that is no JSON has no printed form
and no fingerprint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.json_text import dumped, json_tokens, let, shown


def md5_parts(cols: Sequence[Column | str], short: bool = False) -> Column:
    """Hex md5 of the parts' text joined without a delimiter.

    ``short`` keeps the 16 characters after the eighth.
    """
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    digest = F.md5(F.concat(*parts))
    return F.substring(digest, 9, 16) if short else digest


def _shape(content: Column) -> Column:
    """The JSON text with strings shown as S and integers as N, pairs after the first removed.

    Each step is a linear scan, so long content cannot blow up the matcher.
    """
    skeleton = F.regexp_replace(content, r'"[^"]*"', "S")
    skeleton = F.regexp_replace(skeleton, r"-?[1-9][0-9]*|0", "N")
    return F.regexp_replace(skeleton, r"(?<=[SN]), S: [SN]", "")


# Characters that Python prints as they are: printable ASCII, letters, marks, numbers, signs.
_PRINTED = r"['\\]|[^\x20-\x7e\p{L}\p{M}\p{N}\p{P}\p{S}]"
_ASCII = r"['\\]|[^\x20-\x7e]"


def _is_flat_plain(content: Column, unfit: str = _PRINTED) -> Column:
    """Whether content is a flat JSON object of plain strings and integers, without escapes or
    repeated keys, spaced ``", "`` and ``": "`` as a JSON column stores it."""
    return (
        ~content.rlike(unfit)
        & _shape(content).isin("{}", "{S: S}", "{S: N}")
        & F.try_parse_json(content).isNotNull()  # NULL on a repeated key
    )


def _flat_printed(content: Column) -> Column:
    """Printed form of flat plain content, NULL for any other."""
    return F.when(_is_flat_plain(content), F.translate(content, '"', "'"))


def _flat_sorted(content: Column) -> Column:
    """Canonical form of flat plain content, NULL for any other."""
    return F.when(_is_flat_plain(content, _ASCII), F.to_json(F.try_parse_json(content)))


def py_repr(content: Column | str) -> Column:
    """A JSON value as Python prints it: single quotes, True/False/None, stored key order.

    Of repeated keys the last value stays at the place of the first. Text that is no JSON gives
    NULL. ``json_text`` states how numbers and characters are spelled.
    """
    c = F.col(content) if isinstance(content, str) else content
    return F.coalesce(_flat_printed(c), let(json_tokens(c), shown))


def canonical_json(content: Column | str) -> Column:
    """A JSON value with sorted keys and no spaces, non-ASCII characters escaped."""
    c = F.col(content) if isinstance(content, str) else content
    written = let(json_tokens(c, ordered=True), lambda tokens: F.array_join(F.transform(tokens, dumped), ""))
    return F.coalesce(_flat_sorted(c), written)


def task_fingerprint(
    df: DataFrame,
    mode: str = "exact",
    platform: str = "source_platform",
    content: str = "task_content",
    out: str = "task_fingerprint",
) -> DataFrame:
    """Add the content fingerprint of each task.

    ``exact`` equals the stored fingerprints: platform and printed content joined without a
    delimiter, so key order counts. ``canonical`` ignores key order and keeps the two parts
    apart, for use where stored fingerprints need not match. Content that is no JSON gives NULL.
    """
    if mode == "exact":
        parts = [F.col(platform), py_repr(content)]
    elif mode == "canonical":
        parts = [F.col(platform), F.lit("\n"), canonical_json(content)]
    else:
        raise ValueError(f"unknown fingerprint mode {mode!r}")
    return df.withColumn(out, md5_parts(parts))
