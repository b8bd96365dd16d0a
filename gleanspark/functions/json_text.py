"""JSON text taken apart inside the JVM: tokens by one regular expression, members by their depth.

A text is read as the strict JSON values of the stored columns, with NaN and the infinities that
Python's reader takes as well. Of repeated keys the last value stays, at the place of the first.
Tokens keep the stored spelling of numbers and strings; `printed` and `dumped` respell them.

Most texts pass Spark's own parser, which refuses repeated keys; their tokens are used as they
are. Of what it refuses, broken text is told by a pass with a small state; only texts with repeated
keys, NaN or infinities (and, where keys are ordered, floats) go through `_folded`, a pass with a
stack of open containers, whose cost grows with the square of the members of one container.

Limits: an integer of more than 4,300 digits makes a text no JSON, as in Python. A number with a
point or exponent is printed by the fewest digits of its stored spelling that give the same
double. That is the shortest form for spellings of up to 15 digits and for all that were written
by a shortest-form printer; longer spellings by hand, and numbers below 2.3e-308, may differ in
the last digit. Which characters print as themselves follows the JVM's tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strict JSON, as the stored content was written.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

_STRING = r'"(?:[^"\\\x00-\x1f]++|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"'
_NUMBER = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
# the last alternative shows what fits no token; white space matches none
_TOKEN = rf"{_STRING}|-?Infinity|NaN|true|false|null|{_NUMBER}|[^ \t\r\n]"
_DIGITS = 4300

# characters of a string token that stand for themselves
_PRINTED_RUN = r"""[\x20-\x7e\p{L}\p{M}\p{N}\p{P}\p{S}&&[^'"\\]]"""
_ASCII_RUN = r"""[\x20-\x7e&&[^"\\]]"""
_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_LONE = r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}"

_MEMBERS = "array<struct<name:string,text:string,value:string>>"
_STACK = f"array<struct<kind:string,name:string,text:string,members:{_MEMBERS}>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _join(parts: Column) -> Column:
    return F.array_join(parts, "")


def _char(token: Column) -> Column:
    return F.substring(token, 1, 1)


# --- strings -------------------------------------------------------------------------------


def _atoms(token: Column, run: str) -> Column:
    """Runs of plain characters, escapes and single other characters of a string token."""
    inner = token.substr(F.lit(2), F.length(token) - 2)
    return F.regexp_extract_all(inner, F.lit(rf"{run}++|{_PAIR}|\\u[0-9a-fA-F]{{4}}|\\.|(?s:.)"), F.lit(0))


def _meant(atom: Column) -> Column:
    """The character an atom stands for, NULL for half a surrogate pair."""
    code = F.replace(atom, F.lit("\\u"), F.lit(""))
    single = F.translate(F.substring(atom, 2, 1), "bfnrt", "\b\f\n\r\t")
    return (
        F.when(atom.rlike(f"^{_LONE}$"), F.lit(None).cast("string"))
        .when(atom.startswith("\\u"), F.decode(F.unhex(code), "UTF-16BE"))
        .when(atom.startswith("\\"), single)
        .otherwise(atom)
    )


def _code(atom: Column, char: Column) -> Column:
    """The code point; of half a pair, its own number."""
    return F.coalesce(F.ascii(char), F.conv(F.substring(atom, 3, 4), 16, 10).cast("int"))


def _hex(number: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(number), width, "0"))


def decoded(token: Column) -> Column:
    """The text of a string token; half a surrogate pair gives a question mark."""

    def char(atom: Column) -> Column:
        return F.when(atom.startswith("\\"), F.coalesce(_meant(atom), F.lit("?"))).otherwise(atom)

    plain = token.substr(F.lit(2), F.length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), _join(F.transform(_atoms(token, r"[^\\]"), char))).otherwise(plain)


def _rank(token: Column) -> Column:
    """Hex that orders and tells apart strings by their code points, halves of pairs included."""

    def bytes_of(atom: Column) -> Column:
        def of(char: Column) -> Column:
            code = _code(atom, char)
            tail = F.shiftright(code, 6).bitwiseAND(F.lit(63)) + 128, code.bitwiseAND(F.lit(63)) + 128
            return F.coalesce(F.hex(F.encode(char, "UTF-8")), F.concat(F.lit("ED"), *map(F.hex, tail)))

        return F.when(atom.startswith("\\"), let(_meant(atom), of)).otherwise(F.hex(F.encode(atom, "UTF-8")))

    return _join(F.transform(_atoms(token, r"[^\\]"), bytes_of))


def _printed_string(token: Column) -> Column:
    """A string token as Python prints a text."""
    inner = token.substr(F.lit(2), F.length(token) - 2)
    special = inner.rlike(r"[^\x20-\x7e\p{L}\p{M}\p{N}\p{P}\p{S}]|['\\]")

    def piece(atom: Column, both: Column) -> Column:
        def of(char: Column) -> Column:
            code = _code(atom, char)
            return (
                F.when(code == 92, F.lit("\\\\"))
                .when(code == 39, F.when(both, F.lit("\\'")).otherwise(F.lit("'")))
                .when(code == 34, F.lit('"'))
                .when(code == 9, F.lit("\\t"))
                .when(code == 10, F.lit("\\n"))
                .when(code == 13, F.lit("\\r"))
                .when(char.rlike(f"^{_PRINTED_RUN}$"), char)
                .when(code < 256, F.concat(F.lit("\\x"), _hex(code, 2)))
                .when(code < 65536, F.concat(F.lit("\\u"), _hex(code, 4)))
                .otherwise(F.concat(F.lit("\\U"), _hex(code, 8)))
            )

        return F.when(atom.rlike(f"^{_PRINTED_RUN}"), atom).otherwise(let(_meant(atom), of))

    def whole(atoms: Column) -> Column:
        # a run holds no quote, so a quote is an atom of its own
        single = F.exists(atoms, lambda a: a.rlike(r"^(?:'|\\u0027)$"))
        double = F.exists(atoms, lambda a: a.rlike(r'^\\(?:"|u0022)$'))

        def quoted(has: Column) -> Column:
            quote = F.when(has["single"] & ~has["double"], F.lit('"')).otherwise(F.lit("'"))
            text = _join(F.transform(atoms, lambda a: piece(a, has["single"] & has["double"])))
            return F.concat(quote, text, quote)

        return let(F.struct(single.alias("single"), double.alias("double")), quoted)

    return F.when(special, let(_atoms(token, _PRINTED_RUN), whole)).otherwise(
        F.concat(F.lit("'"), inner, F.lit("'"))
    )


def _dumped_string(token: Column) -> Column:
    """A string token in ASCII, with the escapes of Python's writer."""

    def piece(atom: Column) -> Column:
        def of(char: Column) -> Column:
            code = _code(atom, char)
            short = F.translate(char, '"\\\b\f\n\r\t', '"\\bfnrt')
            halves = F.shiftright(code - 65536, 10) + 0xD800, code.bitwiseAND(F.lit(1023)) + 0xDC00
            return (
                F.when(code.isin(8, 9, 10, 12, 13, 34, 92), F.concat(F.lit("\\"), short))
                .when(code.between(32, 126), char)
                .when(code < 65536, F.concat(F.lit("\\u"), _hex(code, 4)))
                .otherwise(F.concat(*[p for half in halves for p in (F.lit("\\u"), _hex(half, 4))]))
            )

        return F.when(atom.rlike(f"^{_ASCII_RUN}"), atom).otherwise(let(_meant(atom), of))

    escaped = F.concat(F.lit('"'), _join(F.transform(_atoms(token, _ASCII_RUN), piece)), F.lit('"'))
    return F.when(token.rlike(r"[^\x20-\x7e]|\\"), escaped).otherwise(token)


# --- numbers -------------------------------------------------------------------------------


def _printed_float(token: Column, infinite: str) -> Column:
    """A number with point or exponent as Python prints a double."""
    parts = r"^-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"
    sign = F.when(token.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    value = F.abs(token.try_cast("double"))
    fraction = F.regexp_extract(token, parts, 2)
    digits = F.regexp_replace(F.concat(F.regexp_extract(token, parts, 1), fraction), "^0+", "")
    power = F.coalesce(F.nullif(F.regexp_extract(token, parts, 3), F.lit("")).try_cast("int"), F.lit(0)) - F.length(fraction)

    def laid_out(short: Column, first: Column) -> Column:
        """``short`` digits, the first of them at ten to the power ``first``."""
        n = F.length(short)
        fixed = (
            F.when(first >= n - 1, F.concat(F.rpad(short, first + 1, F.lit("0")), F.lit(".0")))
            .when(first >= 0, F.concat(F.substring(short, F.lit(1), first + 1), F.lit("."), short.substr(first + 2, n)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -first - 1), short))
        )
        point = F.when(n > 1, F.concat(F.lit("."), short.substr(F.lit(2), n))).otherwise(F.lit(""))
        exponent = F.abs(first).cast("string")
        exponent = F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent)
        mark = F.when(first < 0, F.lit("e-")).otherwise(F.lit("e+"))
        return F.when(first.between(-4, 15), fixed).otherwise(F.concat(_char(short), point, mark, exponent))

    def of(s: Column) -> Column:
        def rounded(k: Column) -> Column:
            """The first ``k`` digits, rounded, and the power of ten of the last of them."""
            up = F.when(F.substring(s["d"], k + 1, F.lit(1)) >= "5", F.lit(1)).otherwise(F.lit(0))
            kept = (F.substring(s["d"], F.lit(1), k).cast("long") + up).cast("string")
            return F.struct(kept.alias("kept"), (s["q"] + F.length(s["d"]) - F.least(k, F.length(s["d"]))).alias("q"))

        tries = F.transform(F.sequence(F.lit(1), F.least(F.lit(17), F.length(s["d"]))), rounded)
        same = F.filter(tries, lambda t: F.concat(t["kept"], F.lit("E"), t["q"].cast("string")).cast("double") == s["v"])
        # of a spelling that 17 digits do not give back, the 17 digits
        best = F.coalesce(F.get(same, F.lit(0)), F.element_at(tries, -1))
        return let(
            best, lambda b: laid_out(F.regexp_replace(b["kept"], "0+$", ""), b["q"] + F.length(b["kept"]) - 1)
        )

    finite = let(F.struct(digits.alias("d"), power.alias("q"), value.alias("v")), of)
    text = F.when(value == 0, F.lit("0.0")).when(value == float("inf"), F.lit(infinite)).otherwise(finite)
    return F.concat(sign, text)


def _number(token: Column, infinite: str) -> Column:
    whole = F.when(token == "-0", F.lit("0")).otherwise(token)
    return F.when(token.rlike("[.eE]"), _printed_float(token, infinite)).otherwise(whole)


def _is_number(token: Column) -> Column:
    return token.rlike("^-?[0-9]")


def printed(token: Column) -> Column:
    """A token as Python prints the value."""
    words = {
        "true": "True", "false": "False", "null": "None", "NaN": "nan", "Infinity": "inf", "-Infinity": "-inf",
        ",": ", ", ":": ": ",
    }
    out = F.when(_char(token) == '"', _printed_string(token)).when(_is_number(token), _number(token, "inf"))
    for word, text in words.items():
        out = out.when(token == word, F.lit(text))
    return out.otherwise(token)


def dumped(token: Column) -> Column:
    """A token as Python's JSON writer spells it in ASCII without spaces."""
    return (
        F.when(_char(token) == '"', _dumped_string(token))
        .when(_is_number(token), _number(token, "Infinity"))
        .otherwise(token)
    )


# --- texts ---------------------------------------------------------------------------------


def marked_pair(text: Column) -> Column:
    """The text read as the first of two array elements, the second being its own md5.

    Spark's reader ignores text after the first value. Here such text either breaks the array
    or moves the md5 away from second place, so ``whole_value`` sees it.
    """
    return F.from_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')), "array<variant>", STRICT)


def whole_value(pair: Column, text: Column) -> Column:
    """The JSON value of the text, NULL unless all of the text belongs to it."""
    mark = F.try_variant_get(F.try_element_at(pair, F.lit(2)), "$", "string")
    return F.when((F.size(pair) == 2) & (mark == F.md5(text)), F.try_element_at(pair, F.lit(1)))


def _split(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _fits(tokens: Column) -> Column:
    """Whether every token is one of JSON."""
    known = r'^(?:[{}\[\]:,0-9]|-[0-9].*|[^-].+|-Infinity)$'
    return ~F.exists(
        tokens,
        lambda t: ~t.rlike(f"(?s){known}") | ((F.length(t) > _DIGITS) & t.rlike(f"^-?[0-9]{{{_DIGITS + 1},}}$")),
    )


def _folded(tokens: Column, ordered: bool) -> Column:
    """The JSON text of the tokens of one value, of repeated keys the last value at the first
    place; ``ordered`` sorts members by key."""

    def frame(kind: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit("").alias("name"), F.lit("").alias("text"), F.array().cast(_MEMBERS).alias("members"))

    def added(top: Column, value: Column) -> Column:
        new = F.struct(top["name"].alias("name"), top["text"].alias("text"), value.alias("value"))
        members = F.concat(top["members"], F.array(new))
        return F.struct(top["kind"].alias("kind"), top["name"].alias("name"), top["text"].alias("text"), members.alias("members"))

    def once_each(members: Column) -> Column:
        names = members["name"]

        def of(distinct: Column) -> Column:
            def member(name: Column) -> Column:
                first = F.get(members, F.array_position(names, name) - 1)
                last = F.element_at(members, -F.array_position(F.reverse(names), name).cast("int"))
                return F.struct(name.alias("name"), first["text"].alias("text"), last["value"].alias("value"))

            return F.when(F.size(distinct) == F.size(names), members).otherwise(F.transform(distinct, member))

        return let(F.array_distinct(names), of)

    def closed(top: Column) -> Column:
        def written(members: Column) -> Column:
            placed = F.array_sort(members) if ordered else members
            pairs = F.transform(placed, lambda m: F.concat(m["text"], F.lit(":"), m["value"]))
            return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))

        listed = F.concat(F.lit("["), F.array_join(top["members"]["value"], ","), F.lit("]"))
        return F.when(top["kind"] == "{", let(once_each(top["members"]), written)).otherwise(listed)

    def state(key_next, stack, out):
        return F.struct(key_next.alias("key_next"), stack.alias("stack"), out.alias("out"))

    def step(s: Column, token: Column) -> Column:
        stack, head = s["stack"], _char(token)
        top, rest = F.get(stack, F.lit(0)), F.slice(stack, F.lit(2), F.size(stack))
        yes, no, nothing = F.lit(True), F.lit(False), F.lit(None).cast("string")
        closes = head.isin("}", "]")
        # no `let` here: it would copy the open containers for every token
        value = F.when(closes, closed(top)).otherwise(token)
        under = F.when(closes, rest).otherwise(stack)
        onto = F.concat(F.array(added(F.get(under, F.lit(0)), value)), F.slice(under, F.lit(2), F.size(under)))
        key = F.struct(
            top["kind"].alias("kind"), _rank(token).alias("name"), token.alias("text"), top["members"].alias("members")
        )
        return (
            F.when(head == "{", state(yes, F.concat(F.array(frame("{")), stack), nothing))
            .when(head == "[", state(no, F.concat(F.array(frame("[")), stack), nothing))
            .when(head == ":", state(no, stack, nothing))
            .when(head == ",", state(top["kind"] == "{", stack, nothing))
            .when((head == '"') & s["key_next"], state(no, F.concat(F.array(key), rest), nothing))
            .when(F.size(under) == 0, state(no, under, value))
            .otherwise(state(no, onto, nothing))
        )

    start = state(F.lit(False), F.array().cast(_STACK), F.lit(None).cast("string"))
    return F.aggregate(tokens, start, step, lambda s: s["out"])


def _well_formed(tokens: Column) -> Column:
    """Whether tokens make up one value; the state is what may come next and the open containers."""

    def step(s: Column, token: Column) -> Column:
        want, open_, head = s["want"], s["open"], _char(token)
        kind, under = _char(open_), F.substring(open_, 2, 1)
        at_value = want.isin("value", "value or end")
        scalar = ~head.isin(*"{[]}:,")
        closes = ((head == "}") & (kind == "{") & want.isin("key or end", "comma")) | (
            (head == "]") & (kind == "[") & want.isin("value or end", "comma")
        )
        then = (
            F.when(scalar & at_value, F.when(kind == "", "nothing").otherwise("comma"))
            .when(closes, F.when(under == "", "nothing").otherwise("comma"))
            .when((head == "{") & at_value, F.lit("key or end"))
            .when((head == "[") & at_value, F.lit("value or end"))
            .when((head == '"') & want.isin("key", "key or end"), F.lit("colon"))
            .when((head == ":") & (want == "colon"), F.lit("value"))
            .when((head == ",") & (want == "comma"), F.when(kind == "{", "key").otherwise("value"))
            .otherwise(F.lit("broken"))
        )
        now_open = (
            F.when(head.isin("{", "["), F.concat(head, open_))
            .when(head.isin("}", "]"), open_.substr(F.lit(2), F.length(open_)))
            .otherwise(open_)
        )
        return F.struct(then.alias("want"), F.when(then == "broken", F.lit("")).otherwise(now_open).alias("open"))

    start = F.struct(F.lit("value").alias("want"), F.lit("").alias("open"))
    return F.aggregate(tokens, start, step, lambda s: s["want"] == "nothing")


# a key order, or a number, that Spark's own writer would change
_UNORDERED = r"\\u[dD][89a-fA-F]|[^\x00-\ud7ff]"
_RESPELT = r"^-?[0-9]*[.eE]|^-?[0-9]{19}"


def json_tokens(text: Column, ordered: bool = False) -> Column:
    """The tokens of a JSON text, each key once; NULL if the text is no JSON.

    ``ordered`` puts the members of each object in the order of their keys' code points.
    """

    def of(pair: Column) -> Column:
        def taken(tokens: Column) -> Column:
            passed = whole_value(pair, text)
            folded = F.when(_well_formed(tokens), _split(_folded(tokens, ordered)))
            if ordered:
                simple = ~text.rlike(_UNORDERED) & ~F.exists(tokens, lambda t: t.rlike(_RESPELT))
                ready = F.when(passed.isNotNull() & simple, _split(F.to_json(passed)))
            else:
                ready = F.when(passed.isNotNull(), tokens)
            return F.when(_fits(tokens), F.coalesce(ready, folded))

        return let(_split(text), taken)

    may_be = text.rlike(r'^[ \t\r\n]*+(?:[\[{"]|-?[0-9]|true|false|null|NaN|-?Infinity)')
    return F.when(may_be, let(marked_pair(text), of))


def shown(tokens: Column) -> Column:
    """A value as Python prints it: a text by itself bare, within containers in quotes."""
    bare = (F.size(tokens) == 1) & (_char(F.get(tokens, F.lit(0))) == '"')
    return F.when(bare, decoded(F.get(tokens, F.lit(0)))).otherwise(_join(F.transform(tokens, printed)))


def compact(tokens: Column) -> Column:
    """Tokens as text, in their stored spelling and without spaces."""
    return _join(tokens)


def parts(tokens: Column) -> Column:
    """The members of the outermost object or array: ``key`` (a string token, NULL in arrays) and
    ``value`` (its tokens); NULL for a value that is neither."""

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)
        cut = ((s["depth"] == 1) & token.isin(",", "}", "]")) & (depth < 2)
        at = s["at"] + 1
        return F.struct(
            depth.alias("depth"),
            at.alias("at"),
            F.when(cut, F.concat(s["ends"], F.array(at))).otherwise(s["ends"]).alias("ends"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def members(ends: Column) -> Column:
        keyed = F.get(tokens, F.lit(0)) == "{"

        def member(end: Column, i: Column) -> Column:
            first = F.coalesce(F.get(ends, i - 1), F.lit(1)) + 1
            skip = F.when(keyed, 2).otherwise(0)
            return F.struct(
                F.when(keyed, F.get(tokens, first - 1)).alias("key"),
                F.slice(tokens, first + skip, end - first - skip).alias("value"),
            )

        return F.when(F.size(tokens) > 2, F.transform(ends, member)).otherwise(
            F.array().cast("array<struct<key:string,value:array<string>>>")
        )

    ends = F.aggregate(tokens, start, step, lambda s: s["ends"])
    return F.when(F.get(tokens, F.lit(0)).isin("{", "["), let(ends, members))
