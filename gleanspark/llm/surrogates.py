"""Personal data and secrets replaced by keyed surrogates, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.shared import stored

# Titles before a person's name, by the gender they tell.
_MALE = "Mr|Mister|Sir|Herr|Herrn|Monsieur|Señor|Sr|Don|Господин|Г-н|Κύριος"
_FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Mademoiselle|Señora|Señorita|Sra|Srta|Doña|Госпожа|Г-жа|Κυρία"
_NEUTRAL = "Dr|Prof|Professor"
# looks at the first letter and what stands before it to pass by most places at once
_TITLES = f"{_MALE}|{_FEMALE}|{_NEUTRAL}"
_FIRST = "".join(sorted({c for t in _TITLES.split("|") for c in t[0].lower() + t[0].upper()}))
_TITLE = rf"(?=[{_FIRST}])(?<!\w)(?iu:{_TITLES})"
_NAME = r"\p{Lu}[\p{Ll}\p{Lu}\p{M}'’-]*\p{Ll}"
_SHOUTED = r"\p{Lu}[\p{Lu}\p{M}'’-]*\p{Lu}(?!\p{Ll})"

# How each kind looks. A mention is of the first kind that fits it whole.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
KINDS = {
    # bounded and possessive, and begun once in a run of letters, so a long run costs no more than its length
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,255}+@(?:[A-Za-z0-9-]{1,63}+\.){1,12}[A-Za-z]{2,63}",
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.-])(?:\d{4}[ -]?){3}\d{4}(?![\w-])|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}(?!\w)"
    r"|(?<![\w.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "person": rf"{_TITLE}\.? (?:{_NAME}(?: {_NAME})?|{_SHOUTED}(?: {_SHOUTED})?)",
    "secret": r"(?<=[=:\"' ])(?<=(?i:token|secret|api_key|apikey)[\"']? ?[=:] ?[\"']?)[A-Za-z0-9_-]{16,}"
    r"|(?<=[=:\"' ])(?<=(?i:password|passwd|pwd)[\"']? ?[=:] ?[\"']?)[^\s\"']{6,}",
}
MENTION = "|".join(KINDS.values())
# every mention holds one of these, so texts without any are passed by
_HINT = rf"[0-9@]|(?=[PpTtSsAa])(?i:password|passwd|pwd|token|secret|api_?key)|{_TITLE}\.? "
ROUNDS = 64  # attempts to find every entity a free surrogate
# secrets in which letter case tells nothing
_HEX = "^(?:[0-9a-f]{6,64}|[0-9A-F]{6,64})$"

# Letters and syllables that surrogate names are made of, by script.
_SCRIPTS = {
    "latin": (
        ["al", "be", "da", "el", "fa", "ga", "jo", "ka", "li", "ma", "no", "ra", "sa", "te", "vi"],
        ["ber", "dor", "lin", "mar", "nel", "ric", "son", "tan", "ver", "win"],
        {"f": ["a", "ina", "elle"], "m": ["o", "us", "ert"], "n": ["is", "en", "y"]},
        ["feld", "man", "berg", "ton", "ez", "ier", "well", "ley"],
    ),
    "cyrillic": (
        ["ал", "бо", "ва", "га", "да", "ев", "ка", "ла", "ма", "ни", "ро", "са", "та", "фе"],
        ["бер", "дор", "лин", "мар", "нел", "рик", "сан", "тан", "вер"],
        {"f": ["а", "ина", "ия"], "m": ["ий", "ей", "ан"], "n": ["ко", "и"]},
        ["ов", "ин", "енко", "ский", "ец"],
    ),
    "greek": (
        ["αλ", "βα", "γα", "δα", "ελ", "κα", "λα", "μα", "νι", "ρο", "σα", "τα"],
        ["βερ", "δορ", "λιν", "μαρ", "νελ", "ρικ", "σαν", "ταν"],
        {"f": ["α", "η", "ινα"], "m": ["ος", "ης", "ας"], "n": ["ι", "ω"]},
        ["ιδης", "ακης", "πουλος", "ου"],
    ),
}
_ALPHABETS = [
    ("[0-9]", "0123456789"),
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{Ll}", "àâäéèêëîïôöûüñç"),
    (r"\p{Lu}", "ÀÂÄÉÈÊËÎÏÔÖÛÜÑÇ"),
]


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _pick(options: list[str] | str, *seed: Column) -> Column:
    at = F.pmod(F.xxhash64(*seed), F.lit(len(options))).cast("int") + 1
    if isinstance(options, str):
        return F.substring(F.lit(options), at, F.lit(1))
    return F.element_at(F.array(*[F.lit(o) for o in options]), at)


def _reshaped(text: Column, seed: Column) -> Column:
    """Every letter and digit replaced by a keyed one of its kind, case and script."""

    def one(char: Column, at: Column) -> Column:
        out = char
        for kind, letters in reversed(_ALPHABETS):
            out = F.when(F.rlike(char, F.lit(kind)), _pick(letters, seed, at)).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of a digit string by the check rule of card numbers, modulo ten."""
    doubled = F.transform(
        F.reverse(_chars(digits)),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
            F.get(F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.try_cast("int"))
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _script(text: Column) -> Column:
    return (
        F.when(F.rlike(text, F.lit(r"\p{IsCyrillic}")), "cyrillic")
        .when(F.rlike(text, F.lit(r"\p{IsGreek}")), "greek")
        .otherwise("latin")
    )


def _name(kind: Column, entity: Column, seed: Column, attempt: Column) -> Column:
    """A made-up given or family name; later attempts take more syllables."""
    out = None
    for script, (heads, middles, given, family) in _SCRIPTS.items():
        stem = F.concat(
            _pick(heads, seed, F.lit("h")),
            F.array_join(
                F.transform(F.sequence(F.lit(1), F.lit(1) + attempt), lambda i: _pick(middles, seed, i)), ""
            ),
        )
        ending = _pick(family, seed, F.lit("e"))
        for gender in given:
            ending = F.when(kind == f"given_{gender}", _pick(given[gender], seed, F.lit("e"))).otherwise(ending)
        full = F.concat(stem, ending)
        out = full if out is None else F.when(_script(entity) == script, full).otherwise(out)
    return out


def surrogate(kind: Column, entity: Column, key: str, attempt: Column) -> tuple[Column, Column]:
    """Two columns: the entity reshaped (to be named ``__shaped``), and from it the keyed proposal
    for the entity at this attempt, in the entity's canonical form."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string")), 256)
    shaped = _reshaped(entity, seed)
    longer = F.greatest(attempt - 5, F.lit(0)).cast("int")  # of a short secret that finds no free one
    # a valid card number stays valid: its last digit makes up the sum
    body = F.concat(F.substring(entity, 1, 1), F.expr("substring(__shaped, 2, length(__shaped) - 2)"))
    card = F.concat(body, F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    # 10.x.y.z is set aside for private networks, 240 to 255 for no one yet
    net = F.when(attempt > 2, F.lit(240) + F.pmod(F.xxhash64(seed, F.lit("net")), F.lit(16))).otherwise(F.lit(10))
    ip = F.concat_ws(
        ".", net.cast("string"), *[F.pmod(F.xxhash64(seed, F.lit(n)), F.lit(256)).cast("string") for n in range(3)]
    )
    local, host = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    email = F.concat(
        _reshaped(local, seed),
        F.when(attempt > 3, attempt.cast("string")).otherwise(""),
        F.lit("@"),
        _reshaped(F.substring_index(host, ".", 1), F.xxhash64(F.lit(key), host).cast("string")),
        F.lit(".example."),
        F.when(F.substring_index(host, ".", -1).isin("com", "org", "net"), F.substring_index(host, ".", -1)).otherwise("org"),
    )
    made = (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when((kind == "card") & (_luhn(entity) == 0), card)
        .when(kind == "card", F.concat(F.substring(entity, 1, 1), F.expr("substring(__shaped, 2)")))
        .when(kind == "aws_key", F.concat(F.substring(entity, 1, 4), F.expr("substring(__shaped, 5)")))
        .when(kind == "iban", F.concat(F.substring(entity, 1, 2), F.expr("substring(__shaped, 3)")))
        .when((kind == "phone") & F.startswith(entity, F.lit("+1")), F.concat(F.lit("+1"), F.expr("substring(__shaped, 3)")))
        .when(
            (kind == "secret") & F.rlike(entity, F.lit("^[0-9a-f]{6,64}$")), F.substring(seed, F.lit(1), F.length(entity) + longer)
        )
        .when(kind == "secret", F.concat(F.expr("__shaped"), F.substring(F.translate(seed, "abcdef", "012345"), F.lit(1), longer)))
        .when(F.startswith(kind, F.lit("given")) | (kind == "family"), _name(kind, entity, seed, attempt))
        .otherwise(F.expr("__shaped"))
    )
    return shaped, made


def _proposed(df: DataFrame, key: str) -> DataFrame:
    shaped, made = surrogate(F.col("kind"), F.col("entity"), key, F.col("attempt"))
    return df.withColumn("__shaped", shaped).withColumn("surrogate", made).drop("__shaped")


def _kind_of(mention: Column) -> Column:
    out = F.lit("secret")
    for kind in reversed([k for k in KINDS if k != "secret"]):
        # without the context that the patterns look at around a mention
        out = F.when(F.rlike(mention, F.lit(f"^(?:{KINDS[kind]})$")), kind).otherwise(out)
    return out


def parts_of(mentions: DataFrame) -> DataFrame:
    """``mention, kind, parts``: the entities a mention names, in canonical form.

    A person's given and family name are entities of their own, so a family name alone refers
    to the same person as the full name does, whatever the title.
    """
    words = F.split("mention", " ")
    names = F.slice(words, F.lit(2), F.size(words))
    title = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    gender = F.when(title.rlike(f"^(?iu:{_MALE})$"), "m").when(title.rlike(f"^(?iu:{_FEMALE})$"), "f").otherwise("n")
    pair = lambda kind, entity: F.struct(kind.alias("kind"), entity.alias("entity"))
    person = F.when(
        F.size(names) == 2,
        F.array(
            pair(F.concat(F.lit("given_"), gender), F.lower(F.element_at(names, 1))),
            pair(F.lit("family"), F.lower(F.element_at(names, -1))),
        ),
    ).otherwise(F.array(pair(F.lit("family"), F.lower(F.element_at(names, -1)))))
    plain = (
        F.when(F.col("kind") == "email", F.lower("mention"))
        .when(F.col("kind") == "phone", F.regexp_replace("mention", "[^0-9+]", ""))
        .when(F.col("kind").isin("card", "ssn"), F.regexp_replace("mention", "[^0-9]", ""))
        .when(F.col("kind") == "iban", F.regexp_replace("mention", " ", ""))
        .when((F.col("kind") == "secret") & F.rlike("mention", F.lit(_HEX)), F.lower("mention"))
        .otherwise(F.col("mention"))
    )
    return mentions.withColumn("kind", _kind_of(F.col("mention"))).withColumn(
        "parts", F.when(F.col("kind") == "person", person).otherwise(F.array(pair(F.col("kind"), plain)))
    )


def _domain(kind: Column) -> Column:
    """Kinds within which surrogates must differ: given names of all genders are one."""
    return F.when(F.startswith(kind, F.lit("given")), "given").otherwise(kind)


def assign(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """``kind, entity, surrogate``: distinct surrogates, none of them an entity of the corpus.

    All entities propose; a proposal stands if it is no real entity, was not taken in an earlier
    round, and its entity comes first by hash among those proposing the same. The others try
    again with the next attempt; names, e-mail addresses, secrets and IP addresses have more room
    with each. A kind whose format has too few values for its entities is an error after ``rounds``.
    """
    entities = stored(entities.select("kind", "entity").distinct(), "entities")
    real = entities.select(_domain(F.col("kind")).alias("domain"), F.lower("entity").alias("taken")).distinct()
    pending, settled, attempt = entities, None, 0
    while True:
        proposed = _proposed(pending.withColumn("attempt", F.lit(attempt)), key).select(
            "kind", "entity", "surrogate", _domain(F.col("kind")).alias("domain"), F.lower("surrogate").alias("taken")
        )
        proposed = stored(proposed, "proposed")
        free = proposed.join(real, ["domain", "taken"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("domain", "taken"), ["domain", "taken"], "left_anti")
        first = free.groupBy("domain", "taken").agg(
            F.min(F.struct(F.xxhash64("kind", "entity").alias("h"), "kind", "entity", "surrogate")).alias("w")
        )
        won = stored(first.select("w.kind", "w.entity", "w.surrogate", "domain", "taken"), "settled")
        settled = won if settled is None else settled.union(won)
        pending = stored(proposed.join(won, ["kind", "entity"], "left_anti").select("kind", "entity"), "pending")
        if pending.isEmpty():
            return settled.select("kind", "entity", "surrogate")
        attempt += 1
        if attempt == rounds:
            kinds = sorted(r["kind"] for r in pending.select("kind").distinct().collect())
            raise ValueError(f"no free surrogates of the same format for kinds {', '.join(kinds)}")


def _rendered() -> Column:
    """A surrogate in the mention's own format: its separators, title and case."""
    only = F.expr("surrogates[0]")
    digits = _chars(F.regexp_replace(only, "[^0-9A-Za-z]", ""))
    placed = F.array_join(
        F.transform(
            _chars(F.col("mention")),
            lambda c, i: F.when(
                F.rlike(c, F.lit("[0-9A-Za-z]")),
                F.get(
                    digits, F.length(F.regexp_replace(F.substring(F.col("mention"), F.lit(1), i + 1), "[^0-9A-Za-z]", "")) - 1
                ),
            ).otherwise(c),
        ),
        "",
    )
    names = F.expr("substring(mention, instr(mention, ' ') + 1)")
    made = F.array_join(F.transform("surrogates", lambda s: F.initcap(s)), " ")
    person = F.concat_ws(
        " ", F.substring_index("mention", " ", 1), F.when(names == F.upper(names), F.upper(made)).otherwise(made)
    )
    shout = F.col("mention") == F.upper("mention")
    return (
        F.when(F.col("kind").isin("phone", "card", "ssn", "iban"), placed)
        .when(F.col("kind") == "person", person)
        .when((F.col("kind") == "email") & shout, F.upper(only))
        .when((F.col("kind") == "secret") & shout & F.rlike("mention", F.lit(_HEX)), F.upper(only))
        .otherwise(only)
    )


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """``mention, replacement`` for distinct mentions."""
    parted = stored(parts_of(mentions), "mentions")
    laid = parted.select("mention", "kind", F.posexplode("parts").alias("at", "part"))
    given = assign(laid.select("part.kind", "part.entity"), key).select(
        F.struct("kind", "entity").alias("part"), "surrogate"
    )
    return (
        laid.join(given, "part")
        .groupBy("mention", "kind")
        .agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("found"))
        .withColumn("surrogates", F.col("found.surrogate"))
        .select("mention", _rendered().alias("replacement"))
    )


def with_surrogates(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every detected mention in ``text`` replaced; ``count`` names a column for
    the number of mentions, if wanted.

    Found are e-mail and IP addresses, phone, card, social security and bank account numbers,
    keys, tokens and passwords, and names after a title. One entity has one surrogate in the
    whole table, whatever its format; different entities of a kind have different ones, and no
    surrogate is a real entity. Gender, script, letter case, separators and the card check digit
    are kept. Other text and all other columns stay as they are. Null stays null, an empty text
    empty; repeated rows are treated alike; an empty table stays empty. The same ``key`` and
    entities give the same surrogates.
    """
    body, hint = F.col(text), F.coalesce(F.rlike(F.col(text), F.lit(_HINT)), F.lit(False))
    found = F.when(hint, F.regexp_extract_all(body, F.lit(MENTION), F.lit(0))).otherwise(F.array().cast("array<string>"))
    k1, k2 = F.xxhash64(body), F.xxhash64(F.lit("second"), body)
    # equal texts are taken apart once
    lists = stored(
        docs.select(k1.alias("__k1"), k2.alias("__k2"), found.alias("__found"))
        .where("size(__found) > 0")
        .groupBy("__k1", "__k2")
        .agg(F.max("__found").alias("__found")),
        "found",
    )
    laid = lists.select("__k1", "__k2", F.posexplode("__found").alias("__at", "mention"))
    by = replacements(laid.select("mention").distinct(), key)
    put = (
        laid.join(by, "mention")
        .groupBy("__k1", "__k2")
        .agg(F.sort_array(F.collect_list(F.struct("__at", "replacement"))).alias("__put"))
        .select("__k1", "__k2", F.col("__put.replacement").alias("__put"))
    )
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]
    rows = docs.toDF(*names)
    hashes = (F.xxhash64(F.col(at)) == F.col("__k1")) & (F.xxhash64(F.lit("second"), F.col(at)) == F.col("__k2"))
    joined = rows.join(put, hashes, "left")
    around = F.split(F.col(at), MENTION, -1)
    # what stood between two mentions, each with the replacement that follows it
    rebuilt = F.array_join(
        F.transform(around, lambda piece, i: F.concat(piece, F.coalesce(F.get("__put", i), F.lit("")))), ""
    )
    kept = [
        (F.when(F.col("__put").isNotNull(), rebuilt).otherwise(F.col(c)) if c == at else F.col(c)).alias(name)
        for c, name in zip(names, docs.columns, strict=True)
    ]
    counted = [F.coalesce(F.size("__put"), F.lit(0)).cast("long").alias(count)] if count else []
    return joined.select(*kept, *counted)
