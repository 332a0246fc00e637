"""Surrogates for personal data: keyed, of the same kind and form, equal for equal entities.

Detected: e-mail addresses, IPv4 addresses, card numbers with a valid check digit, account numbers
(IBAN), social security numbers, phone numbers of eight digits or more, and names after a title, which
are then replaced wherever the text has them. Everything is built-in functions; texts are not shuffled.

An entity has a canonical form (a phone number without its separators, a name word in lower case), and
its surrogate is a function of the key, the kind, the canonical form and a number of attempts. So an
entity that recurs, in another spelling too, has the same surrogate everywhere. Whether two
entities share a surrogate, or a surrogate is an entity of the corpus itself, is checked over all
distinct entities, and those that clash get another attempt until none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checked_broadcast, fresh, materialize

BROADCAST_ROWS = 500_000  # exceptions that are broadcast at most
LONGER = 20  # attempts after which surrogates of numbers grow by a digit
PHONE = 8  # digits of a phone number at least

# fixed values: titles, by the gender they tell
_MALE = "Mr|Herr|Herrn|Sr|Señor|Monsieur|Mister|Господин"
_FEMALE = "Mrs|Ms|Miss|Frau|Sra|Señora|Srta|Mme|Mlle|Madame|Госпожа"
_NEUTRAL = "Dr|Prof"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MAIL_CHAR = r"[\p{L}\p{N}._%+-]"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_PATTERNS = [
    rf"(?<!{_MAIL_CHAR}){_MAIL_CHAR}++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)+",
    rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    r"(?<![\d.-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![ -]?\d|\p{L})",
    r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)",
    r"(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    rf"(?<![\p{{L}}\p{{N}}])(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? {_NAME}(?: {_NAME}){{0,2}}",
]
PATTERN = "|".join(f"(?:{p})" for p in _PATTERNS)
_TITLED = rf"^(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? "
_APART = (r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])")
_NAME_KINDS = ("name_m", "name_f", "name_n", "surname")
_HINT = rf"[0-9@]|(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? \p{{Lu}}"

# fixed values: name parts, one row of sixteen per script
_SYLLABLES = {
    "latin": "ba de ka li mo na pe ra sa ti vo ju fe go lu mi",
    "cyrillic": "ба де ка ли мо на пе ра са ти во ю фе го лу ми",
    "greek": "βα δε κα λι μο να πε ρα σα τι βο ιου φε γο λου μι",
}
_ENDINGS = {
    ("latin", "name_m"): "n r s l do k m t",
    ("latin", "name_f"): "a ia na ela ina etta lia ra",
    ("latin", "name_n"): "en is ey al in or ay el",
    ("latin", "surname"): "son ler mann ton ard ez ier ing",
    ("cyrillic", "name_m"): "н р с л м к т й",
    ("cyrillic", "name_f"): "а я на ла ина ета лия ра",
    ("cyrillic", "name_n"): "н ль ш ж н ль ш ж",
    ("cyrillic", "surname"): "енко ук ко ич ян швили ых ер",
    ("greek", "name_m"): "ς ρος νος τας κος λος δης μης",
    ("greek", "name_f"): "α να λα ρα τα νη κη ση",
    ("greek", "name_n"): "ι ω υ ε ις ων ες υς",
    ("greek", "surname"): "ου ιδη ακη ατου ογλου εα αρη ιτη",
}
_LETTERS = {"latin": "bcdfghjklmnprstv", "cyrillic": "бвгдежзиклмнопрс", "greek": "αβγδεζηθικλμνξοπ"}
_HEX = "0123456789abcdef"


def _alnum(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", ""))


def _luhn(digits: Column) -> Column:
    """Sum of the check over all digits, the last one counting once."""

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - at, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(at % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def entities(text: Column) -> Column:
    """Array of the matches in a text; a cheap look for digits, @ and titles comes first."""
    value = F.coalesce(text.cast("string"), F.lit(""))
    found = F.regexp_extract_all(value, F.lit(PATTERN), F.lit(0))
    return F.when(value.rlike(_HINT), found).otherwise(F.array().cast("array<string>"))


def parts(match: Column) -> Column:
    """A match as array of (kind, value); kind is null for what stays: titles, phone numbers too short, and
    numbers that look like those of cards but have a wrong check digit."""
    number = _alnum(match)
    kind = (
        F.when(F.contains(match, F.lit("@")), "email")
        .when(match.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(match.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(match.rlike(r"^\+|^\(|^\d{3}[.-]\d{3}[.-]\d{4}$"), F.when(F.length(number) >= PHONE, "phone"))
        .when(_luhn(number) % 10 == 0, "card")
    )
    given = (
        F.when(match.rlike(rf"^(?:{_MALE})\b"), "name_m").when(match.rlike(rf"^(?:{_FEMALE})\b"), "name_f").otherwise("name_n")
    )
    words = F.split(match, " ")
    named = F.transform(
        words,
        lambda w, k: F.struct(
            F.when(k == 0, F.lit(None).cast("string")).when(k == F.size(words) - 1, "surname").otherwise(given).alias("kind"),
            w.alias("value"),
        ),
    )
    single = F.array(F.struct(kind.alias("kind"), match.alias("value")))
    return F.when(match.rlike(_TITLED), named).otherwise(single)


def _names(found: Column) -> Column:
    """Map from the names in an array of matches to their kinds, one for each in a text.

    A word that is a given name somewhere is one everywhere; it has the gender that its titles tell, if they agree.
    """
    named = F.filter(F.flatten(F.transform(found, parts)), lambda u: u["kind"].isin(*_NAME_KINDS))

    def kind_of(word: Column) -> Column:
        def has(kind: str) -> Column:
            return F.exists(named, lambda u: (u["value"] == word) & (u["kind"] == kind))

        male, female = has("name_m"), has("name_f")
        given = F.when(male & ~female, "name_m").when(female & ~male, "name_f")
        return given.when(male | female | has("name_n"), "name_n").otherwise("surname")

    words = F.array_distinct(F.transform(named, lambda u: u["value"]))
    return F.map_from_entries(F.transform(words, lambda w: F.struct(w.alias("name"), kind_of(w).alias("kind"))))


def detected(docs: DataFrame, text: Column, own: str, pieces: str, pattern: str) -> DataFrame:
    """``docs`` with the matches of a text, each one's parts, and the pattern that finds them.

    Names after a title are found first. In a text that has any, the pattern takes these words as
    well, wherever they stand. All other texts have the pattern that is common to all, here null.
    """
    names = fresh("names", docs)
    known = docs.withColumn(own, entities(text))
    titled = F.exists(own, lambda m: m.rlike(_TITLED))
    known = known.withColumn(names, F.when(titled, _names(F.col(own))))
    also = F.concat(F.lit(PATTERN + "|" + _APART[0] + "(?:"), F.array_join(F.map_keys(names), "|"), F.lit(")" + _APART[1]))
    known = known.withColumn(pattern, F.when(F.size(names) > 0, also))
    again = F.regexp_extract_all(text, F.col(pattern), F.lit(0))
    known = known.withColumn(own, F.when(F.col(pattern).isNotNull(), again).otherwise(F.col(own)))

    def resolved(match: Column) -> Column:
        kind = F.try_element_at(F.col(names), match)
        lone = F.array(F.struct(kind.alias("kind"), match.alias("value")))
        whole = F.transform(
            parts(match),
            lambda u: F.struct(
                F.when(u["kind"].isin(*_NAME_KINDS), F.try_element_at(F.col(names), u["value"])).otherwise(u["kind"]).alias("kind"),
                u["value"].alias("value"),
            ),
        )
        return F.when(kind.isNotNull(), lone).otherwise(whole)

    plain = F.transform(own, parts)
    return known.withColumn(pieces, F.when(F.col(pattern).isNotNull(), F.transform(own, resolved)).otherwise(plain)).drop(names)


def _group(kind: Column) -> Column:
    """Given names are one kind of entity, whatever the gender."""
    return F.when(kind.isin("name_m", "name_f", "name_n"), "given").otherwise(kind)


def canonical(kind: Column, value: Column) -> Column:
    return F.when(kind.isin("email", "name_m", "name_f", "name_n", "surname"), F.lower(value)).when(
        kind == "ip", value
    ).otherwise(_alnum(value))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _nibble(stream: Column, at: Column | int) -> Column:
    return F.conv(F.substring(stream, F.lit(at) if isinstance(at, int) else at, F.lit(1)), 16, 10).cast("int")


def _byte(stream: Column, at: int) -> Column:
    return F.conv(F.substring(stream, at, 2), 16, 10).cast("int")


def _spelt(value: Column, stream: Column) -> Column:
    """``value`` with other letters for letters, of the same script, and digits for digits."""

    def one(char: Column, at: Column) -> Column:
        hexed = F.substring(stream, F.pmod(at, F.lit(128)) + 1, F.lit(1))
        letter = F.translate(hexed, _HEX, _LETTERS["latin"])
        for script, test in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}")):
            letter = F.when(char.rlike(test), F.translate(hexed, _HEX, _LETTERS[script])).otherwise(letter)
        digit = F.translate(hexed, "abcdef", "012345")
        return F.when(char.rlike(r"\p{N}"), digit).when(char.rlike(r"\p{L}"), letter).otherwise(char)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _name(kind: Column, value: Column, attempt: Column, stream: Column) -> Column:
    script, out = _script(value), None
    for name, row in _SYLLABLES.items():
        table = F.array(*map(F.lit, row.split()))
        body = F.array_join(
            F.transform(F.sequence(F.lit(1), 2 + F.floor(attempt / 3).cast("int")), lambda k: F.element_at(table, _nibble(stream, k) + 1)), ""
        )
        end = None
        for (of, what), endings in _ENDINGS.items():
            if of == name:
                pick = F.element_at(F.array(*map(F.lit, endings.split())), _nibble(stream, 100) % 8 + 1)
                end = F.when(kind == what, pick) if end is None else end.when(kind == what, pick)
        full = F.concat(body, end)
        out = F.when(script == name, full) if out is None else out.when(script == name, full)
    return out


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """Canonical form of the surrogate for a canonical ``value``."""
    first = F.sha2(F.concat_ws("|", F.lit(key), _group(kind), value, attempt.cast("string")), 256)
    stream = F.concat(first, F.sha2(first, 256))
    digits = F.translate(stream, "abcdef", "012345")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, ".", -1)
    tld = F.when(domain.isin("com", "net", "org"), domain).otherwise("org")
    more = F.substring(F.translate(stream, _HEX, _LETTERS["latin"]), F.lit(60), F.greatest(attempt - 6, F.lit(0)))
    mail = F.concat(_spelt(local, stream), more, F.lit("@mail"), F.substring(digits, 121, 3), F.lit(".example."), tld)
    octets = F.concat_ws(".", *[(_byte(stream, 1) % 223 + 1).cast("string"), *[_byte(stream, k).cast("string") for k in (3, 5, 7)]])
    # the first digit stays, and so does a leading country code of letters
    size = F.length(value)
    longer = F.floor(attempt / LONGER).cast("int")
    more_digits = F.substring(digits, F.lit(65), longer)
    iban = F.concat(F.substring(value, 1, 2), F.substring(_spelt(value, stream), F.lit(3), size - 2))
    number = F.concat(F.substring(value, 1, 1), F.substring(digits, F.lit(2), size - 1))
    body = F.concat(F.substring(number, F.lit(1), size - 1), F.lit("0"))
    card = F.concat(F.substring(body, F.lit(1), size - 1), ((10 - _luhn(body) % 10) % 10).cast("string"))
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", F.when(longer > 0, F.concat(octets, F.lit("."), more_digits)).otherwise(octets))
        .when(kind == "iban", F.concat(F.upper(iban), more_digits))
        .when(kind == "card", F.concat(card, more_digits))
        .when(kind.isin("ssn", "phone"), F.concat(number, more_digits))
        .otherwise(_name(kind, value, attempt, stream))
    )


def _in_form(kind: Column, value: Column, new: Column) -> Column:
    """The surrogate in the form of the value it replaces: separators, or capitals."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(done: Column, char: Column) -> Column:
        taken = F.concat(done["out"], F.substring(new, done["k"] + 1, F.lit(1)))
        return F.when(char.rlike("[0-9A-Za-z]"), F.struct(taken.alias("out"), (done["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(done["out"], char).alias("out"), done["k"].alias("k"))
        )

    spread = F.aggregate(
        F.split(value, ""), start, step, lambda done: F.concat(done["out"], F.substring(new, done["k"] + 1, F.length(new)))
    )
    shaped = F.when(value == F.upper(value), F.upper(new)).when(value == F.lower(value), new).otherwise(F.initcap(new))
    return (
        F.when(kind == "email", F.when(value == F.upper(value), F.upper(new)).otherwise(new))
        .when(kind == "ip", new)
        .when(kind.isin("iban", "card", "ssn", "phone"), spread)
        .otherwise(shaped)
    )


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) for the distinct entities whose first surrogate clashes.

    An entity clashes if a smaller one has the same surrogate, or if the surrogate is itself an
    entity of its kind. Rounds go on until there is none, each one a written table. Names, addresses and, after a
    while, numbers get longer with the attempts, so there always are enough.
    """
    now = materialize(found.select("kind", "value", F.lit(0).alias("attempt")).distinct(), "entities")
    now = now.withColumn("group", _group(F.col("kind")))
    while True:
        made = now.withColumn("new", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
        made = materialize(made, "surrogates")
        first = made.groupBy("group", "new").agg(F.min("value").alias("first"), F.count("*").alias("n")).filter("n > 1")
        twice = made.join(first, ["group", "new"]).filter(F.col("value") != F.col("first")).select("group", "value")
        real = made.join(now.select("group", F.col("value").alias("new")), ["group", "new"], "left_semi").select("group", "value")
        clash = materialize(twice.unionByName(real).distinct(), "clashes")
        if clash.isEmpty():
            return now.filter("attempt > 0").drop("group")
        again = clash.withColumn("again", F.lit(1))
        now = made.join(again, ["group", "value"], "left").select(
            "kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"), "group"
        )
        now = materialize(now, "entities")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``n_entities`` and ``kinds`` (sorted, distinct) added.

    A null text stays null, with no entities. Rows that repeat are rewritten alike, and entities are
    the same in all of them. A name after a title is replaced at every place of its text; the body of
    a given name's surrogate hangs on the name alone, and its ending on the gender that the titles of the text
    tell. All other columns stay; columns named like the added ones are replaced.
    """
    text = F.col("text").cast("string")
    texts = detected(docs.select(text.alias("text")), F.col("text"), "own", "pieces", "pattern")
    each = texts.select(F.xxhash64("text").alias("text_key"), F.explode(F.flatten("pieces")).alias("u"))
    units = each.filter("u.kind IS NOT NULL")
    units = units.select("text_key", F.col("u.kind").alias("kind"), canonical(F.col("u.kind"), F.col("u.value")).alias("value"))
    units = materialize(units.distinct(), "units")
    exceptions = attempts(units, key)
    exceptions = materialize(exceptions, "exceptions")
    n = exceptions.count()
    own, pieces, pattern, tries_of, key_of = (
        fresh(name, docs) for name in ("matches", "parts", "pattern", "tries", "text_key")
    )
    marked = detected(docs, text, own, pieces, pattern)
    if n:
        name = F.concat_ws("|", "kind", "value")
        of_text = (
            units.join(checked_broadcast(exceptions, n, BROADCAST_ROWS), ["kind", "value"])
            .groupBy(F.col("text_key").alias(key_of))
            .agg(F.map_from_entries(F.collect_set(F.struct(name, "attempt"))).alias(tries_of))
        )
        of_text = materialize(of_text, "tries")
        of_text = checked_broadcast(of_text, of_text.count(), BROADCAST_ROWS)
        marked = marked.join(of_text, F.xxhash64(text) == F.col(key_of), "left").drop(key_of)
    else:
        marked = marked.withColumn(tries_of, F.lit(None).cast("map<string,int>"))

    def rewritten(part: Column) -> Column:
        kind, value = part["kind"], part["value"]
        plain = canonical(kind, value)
        tries = F.coalesce(F.try_element_at(tries_of, F.concat_ws("|", kind, plain)), F.lit(0))
        return F.when(kind.isNull(), value).otherwise(_in_form(kind, value, surrogate(kind, plain, tries, key)))

    # only the parts of a name are more than one, and blanks lie between those
    new = F.transform(pieces, lambda p: F.array_join(F.transform(p, rewritten), " "))
    between = F.when(F.col(pattern).isNull(), F.split(text, PATTERN, -1)).otherwise(F.split(text, F.col(pattern), F.lit(-1)))
    joined = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    kinds = F.transform(F.filter(F.flatten(pieces), lambda u: u["kind"].isNotNull()), lambda u: u["kind"])
    return (
        marked.withColumn("text", F.when(F.size(own) > 0, joined).otherwise(text))
        .withColumn("n_entities", F.size(kinds).cast("bigint"))
        .withColumn("kinds", F.array_sort(F.array_distinct(kinds)))
        .drop(own, pieces, pattern, tries_of)
    )


def op6(docs: DataFrame, key: str) -> DataFrame:
    """All rows with surrogates in their texts; cases as in ``replace``."""
    return replace(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), key)
