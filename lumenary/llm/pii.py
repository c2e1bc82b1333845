"""PII replaced by surrogates, in DataFrame operations only.

Patterns detect e-mail addresses, secrets, IP addresses, phone numbers, card numbers, IBANs, social-security numbers and
names (after a title, or a known given name before a surname; Chinese ones of a frequent surname before a title). Each
distinct entity gets one replacement for all documents (coreference), drawn from a keyed hash, of the same type and
format: digits stay digits, letters keep case and script, cards that pass the Luhn check and IBANs whose check digits
hold still do, IP addresses stay valid, telephone numbers and IBANs keep their country and e-mail addresses their
top-level domain. Of a name, title, given name and surname count apart: titles stay, a given name gets one of the same
gender and script, a surname one of the same script, wherever they stand; so a person mentioned in full, by surname or
without the title stays one person. Replacements are checked against each other and against all entities found: where
two collide, all but one are drawn again with the next attempt number, until none collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: From this attempt on, replacements get longer with each (names from the fourth), so that every format has enough of them.
WIDER = 24
#: Given names by script and gender, from which replacements are drawn and by which names are detected.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sophie Emma Clara Elena Marta Alice Nina Irene Helen Paula Sara Eva María Inés Zoë Hélène Renée".split(),
    ("latin", "m"): "Peter Thomas Martin Daniel Paul David Simon Oscar Hugo Felix Bruno Erik Victor Adam Leon Carlos José André François Jürgen Günther".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Вера".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Дмитрий Алексей Николай Андрей Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ειρήνη Δήμητρα Χριστίνα".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Παύλος Πέτρος Ανδρέας Στέφανος".split(),
}
#: Syllables from which surnames and further given names are put together, by script, and the endings of the latter by gender.
SYLLABLES = {
    "latin": "ba ber can cor dal den fa fer gan gor ha hol ka kel lan lor ma mer nor pa per ra ros sal sen ta tor val ver win".split(),
    "cyrillic": "ба бер дан дор ка кол ла лев ма мир на нов па пет ра ров са сол та тон ва вол".split(),
    "greek": "βα γε δα θε κα κο λα λε μα με να νι πα πο ρα ρο σα σο τα το φα χα".split(),
}
ENDINGS = {("latin", "f"): "ina", ("latin", "m"): "on", ("cyrillic", "f"): "ина", ("cyrillic", "m"): "он", ("greek", "f"): "ίνα", ("greek", "m"): "ος"}
#: Frequent Chinese surnames, and characters of given names.
HAN_SURNAMES = "王李張张劉刘陳陈楊杨黃黄趙赵吳吴周徐孫孙馬马朱胡林郭何高羅罗"
HAN = "安柏昌德恩芳光海家静康兰明宁平清仁山书天文祥雅永志"
TITLES = {"f": "Mrs|Ms|Miss|Frau|Señora|Madame", "m": "Mr|Herr|Señor|Monsieur", "": "Dr|Prof"}
_TITLE = "|".join(TITLES.values())
_SURNAME = r"\p{Lu}[\p{L}\p{M}'’-]*[\p{Ll}\p{M}]"
_NAMES = "|".join(n for names in GIVEN.values() for n in names)
_HAN_NAME = rf"[{HAN_SURNAMES}]\p{{IsHan}}{{1,2}}(?=先生|女士|小姐)"
# Country codes of telephone numbers; those that start with none of these have three digits.
CODES = {1: "1 7".split(), 2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: The types in order: of two at one place the first counts.
PATTERNS = {
    "email": r"(?<![\p{L}0-9])[\p{L}0-9][\p{L}\p{M}0-9._%+-]{0,63}+@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)+",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![\p{L}0-9:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{3,4}:(?:[0-9A-Fa-f]{1,4}:){0,5}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}0-9:])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{2,4}(?:[ .-]?(?!(?:[0-9]{4}[ -]){3}[0-9])[0-9]{2,4}){2,3})(?![0-9]|[.-][0-9])|(?<![0-9(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:([ -]?)[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_TITLE})\.? {_SURNAME}(?: {_SURNAME})?|(?:{_NAMES}) {_SURNAME})|{_HAN_NAME}",
}
ANY = "|".join(p.replace("([ -]?)", "[ -]?") for p in PATTERNS.values())
#: A text without any of these has no entity; the cheap test comes first.
MAYBE = rf"[0-9@]|(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}|{_NAMES})\.? \p{{Lu}}|[0-9a-fA-F]{{32}}|AKIA|gh[pousr]_|先生|女士|小姐"


def _kind(entity: Column) -> Column:
    """The type of an entity: the first whose pattern fits it all (looking around it is done already)."""
    out = F.lit("name")
    for name in reversed([n for n in PATTERNS if n != "name"]):
        out = F.when(entity.rlike(rf"\A(?:{PATTERNS[name]})\z"), F.lit(name)).otherwise(out)
    return out


def _normal(kind: Column, entity: Column) -> Column:
    """What makes two mentions one entity: case doesn't matter in addresses and secrets, nor separators between digits."""
    return F.when(kind.isin("email", "secret", "ipv6"), F.lower(entity)).when(kind.isin("card", "phone", "iban", "ssn"), F.regexp_replace(entity, "[ .()-]", "")).otherwise(entity)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").when(name.rlike(r"\p{IsHan}"), "han").otherwise("latin")


def _parts(kind: Column, entity: Column) -> Column:
    """The parts of a mention that are replaced apart: (kind, normal, gender); one, but for names of two words."""
    title = F.regexp_extract(entity, rf"\A({_TITLE})\.? ", 1)
    words = F.split(F.regexp_replace(entity, rf"\A(?:{_TITLE})\.? ", ""), " ")
    gender = F.lit(None).cast("string")
    for g in ("f", "m"):
        gender = F.when(title.isin(TITLES[g].split("|")), g).otherwise(gender)

    def part(kind, normal, gender=F.lit(None).cast("string")):
        return F.struct(kind.alias("kind"), normal.alias("normal"), gender.alias("gender"))

    name = F.when(F.size(words) > 1, F.array(part(F.lit("given"), words[0], gender), part(F.lit("surname"), words[1]))).otherwise(F.array(part(F.lit("surname"), words[0])))
    return F.when(kind == "name", name).otherwise(F.array(part(kind, _normal(kind, entity))))


def _number(seed: Column, i, below: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(below)).cast("int")


def _pick(options: list[str], n: Column) -> Column:
    return F.element_at(F.lit(options), n + 1)


_LOWER = "abcdefghijklmnopqrstuvwxyz"
_CLASSES = [
    ("0123456789", "0123456789"),
    (_LOWER, _LOWER),
    (_LOWER.upper(), _LOWER.upper()),
    ("абвгдежзийклмнопрстуфхцчшщыэюя", "абвгдежзийклмнопрстуфхцчшщыэюя"),
    ("αβγδεζηθικλμνξοπρστυφχψω", "αβγδεζηθικλμνξοπρστυφχψω"),
]


def _scramble(seed: Column, text: Column, hexadecimal: bool = False) -> Column:
    """Each digit becomes a digit, each letter a letter of its script and case; the rest stays. i-th place, i-th draw."""

    def one(c: Column, i: Column) -> Column:
        # Letters of no alphabet below: a Latin one of the same case, or another character.
        out = F.when(c.rlike(r"\p{Lu}"), F.substring(F.lit(_LOWER.upper()), _number(seed, i, 26) + 1, F.lit(1))).when(c.rlike(r"\p{Ll}"), F.substring(F.lit(_LOWER), _number(seed, i, 26) + 1, F.lit(1)))
        out = out.when(c.rlike(r"\p{L}"), F.substring(F.lit(HAN), _number(seed, i, len(HAN)) + 1, F.lit(1))).otherwise(c)
        for members, drawn in _CLASSES:
            if hexadecimal and members != "0123456789":
                drawn = drawn[:6]
            out = F.when(F.lit(members).contains(c), F.substring(F.lit(drawn), _number(seed, i, len(drawn)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum that a valid card number has divisible by 10."""
    n = F.length(digits)

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The remainder that an IBAN's check digits make 1: letters count as the numbers from 10 on."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(normal: Column, rest: Column) -> Column:
    """The country of `normal`, check digits and `rest`; the digits hold as far as those of `normal` do."""
    country = F.substring(normal, 1, 2)
    was = _mod97(F.concat(F.expr("substring(normal, 5)"), country, F.substring(normal, 3, 2)))
    check = F.pmod(was - _mod97(F.concat(rest, country, F.lit("00"))), F.lit(97))
    return F.concat(country, F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), rest)


def _drawn_name(kind: Column, name: Column, gender: Column, seed: Column, longer: Column) -> Column:
    """A surname, or a given name that is in no list: syllables of the same script, and for given names an ending by gender."""
    script, out = _script(name), F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        made = F.array_join(F.transform(F.sequence(F.lit(0), 2 + longer), lambda i: F.element_at(F.lit(syllables), F.pmod(F.xxhash64(seed, i), F.lit(len(syllables))).cast("int") + 1)), "")
        ending = F.when(gender == "f", ENDINGS[s, "f"]).otherwise(ENDINGS[s, "m"])
        made = F.when(kind == "given", F.concat(made, ending)).otherwise(F.concat(made, _pick(syllables, _number(seed, 99, len(syllables)))))
        out = F.when(script == s, F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, 2, 999))).otherwise(out)
    count = F.length(name) - 1 + longer
    han = F.concat(F.substring(F.lit(HAN_SURNAMES), _number(seed, 98, len(HAN_SURNAMES)) + 1, F.lit(1)), F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(F.lit(HAN), F.pmod(F.xxhash64(seed, i), F.lit(len(HAN))).cast("int") + 1, F.lit(1))), ""))
    return F.when(script == "han", han).otherwise(out)


def _listed(key: str) -> dict[str, str]:
    """Each given name of the lists to the next of its script and gender, in an order that the key makes."""
    from hashlib import sha256

    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: sha256(f"{key}|given|{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def _surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, gender, attempt) with the column `surrogate`, the replacement in normal form."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "normal", F.col("attempt").cast("string")), 256)
    longer = F.greatest(F.col("attempt") - F.when(F.col("kind").isin("given", "surname"), 3).otherwise(WIDER - 1), F.lit(0))
    out = entities.withColumn("seed", seed).withColumn("longer", longer).withColumn("plain", _scramble(F.col("seed"), F.col("normal")))
    out = out.withColumn("gender", F.coalesce("gender", F.when(_number(F.sha2(F.concat(F.lit(key), "normal"), 256), 9, 2) == 0, "f").otherwise("m")))
    seed = F.col("seed")
    # There are more IP addresses than a corpus mentions; only attempts that no corpus needs leave their range.
    over = F.greatest(F.col("attempt") - 10 * WIDER, F.lit(0))
    ip = F.array_join(F.transform(F.split("normal", r"\."), lambda c, i: (_number(seed, i, 256) + 256 * over).cast("string")), ".")
    ipv6 = F.when(F.col("longer") > 0, F.regexp_replace(F.substring(F.sha2(seed, 256), 1, 32), "(....)(?=.)", "$1:")).otherwise(_scramble(seed, F.col("normal"), True))
    # The last digit of a card makes its Luhn sum leave the same remainder.
    more = F.when(F.col("longer") > 0, F.substring(F.translate(F.sha2(seed, 256), "abcdef", "012345"), F.lit(1), 2 * F.col("longer"))).otherwise("")
    body = F.concat(F.expr("substring(plain, 1, length(plain) - 1)"), more)
    card = F.concat(body, F.pmod(_luhn(F.col("normal")) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    # Telephone numbers keep the plus sign and the country code.
    code = F.lit(3)
    for digits in (2, 1):
        code = F.when(F.substring("normal", 2, digits).isin(CODES[digits]), digits).otherwise(code)
    out = out.withColumn("code", F.when(F.col("normal").startswith("+"), code + 1).otherwise(0))
    phone = F.expr("concat(substring(normal, 1, code), substring(plain, code + 1))")
    iban = _iban(F.col("normal"), F.concat(F.expr("substring(plain, 5)"), more))
    email = F.regexp_replace("plain", r"[^.@]+\z", F.regexp_extract("normal", r"([^.@]+)\z", 1))
    value = (
        F.when(F.col("kind").isin("given", "surname"), _drawn_name(F.col("kind"), F.col("normal"), F.col("gender"), seed, F.col("longer")))
        .when(F.col("kind") == "ip", ip)
        .when(F.col("kind") == "card", card)
        .when(F.col("kind") == "phone", F.concat(phone, more))
        .when(F.col("kind") == "ipv6", ipv6)
        .when(F.col("kind") == "iban", iban)
        .when(F.col("kind") == "secret", F.concat(F.when(F.col("normal").rlike(r"\A[0-9a-f]+\z"), _scramble(seed, F.col("normal"), True)).otherwise(F.col("plain")), more))
        .when(F.col("kind") == "email", F.concat(more, email))
        .otherwise(F.concat(F.col("plain"), more))
    )
    return out.withColumn("surrogate", value).select("kind", "normal", "gender", "attempt", "surrogate")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Distinct entities (kind, normal, gender) to replacements (kind, normal, surrogate), all different and none an entity found.

    It ends for any number of entities: a format that is used up gets longer replacements.
    """
    entities = T.checkpoint(entities)
    spark = entities.sparkSession
    names = spark.createDataFrame([("given", n) for n in _listed(key)], "kind string, surrogate string")
    taken = entities.select("kind", F.col("normal").alias("surrogate")).unionByName(names)
    todo, done, attempt = entities.withColumn("attempt", F.lit(0)), None, 0
    while True:
        drawn = _surrogates(todo, key).select("kind", "normal", "surrogate", "attempt")
        every = drawn if done is None else done.withColumn("attempt", F.lit(-1)).unionByName(drawn)
        # Of one replacement's takers the earlier round's stays, then the first by name.
        first = every.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "normal")).alias("first"))
        free = first.join(taken, ["kind", "surrogate"], "left_anti")
        done = T.checkpoint(free.select("kind", F.col("first.normal").alias("normal"), "surrogate"))
        attempt += 1
        todo = T.checkpoint(entities.join(done, ["kind", "normal"], "left_anti").withColumn("attempt", F.lit(attempt)))
        if todo.isEmpty():
            return done


def _format(kind: Column, entity: Column, normal_out: Column) -> Column:
    """A replacement in the form of one mention: its separators for numbers, its capitals for secrets and addresses."""
    numbers = kind.isin("card", "phone", "iban", "ssn")
    marks = F.transform(F.split(entity, ""), lambda c: F.when(c.rlike("[ .()-]"), 1).otherwise(0))
    spread = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[ .()-]"), c).otherwise(F.substring(normal_out, i + 1 - F.aggregate(F.slice(marks, 1, i), F.lit(0), lambda a, x: a + x), F.lit(1)))), "")
    over = F.aggregate(marks, F.length(normal_out) - F.size(marks), lambda a, x: a + x)  # digits of a longer replacement
    spread = F.concat(spread, F.when(over > 0, F.right(normal_out, over)).otherwise(""))
    shouted = kind.isin("email", "secret", "ipv6") & (entity == F.upper(entity))
    return F.when(numbers, spread).when(shouted, F.upper(normal_out)).otherwise(normal_out)


def _values(entities: DataFrame, key: str) -> DataFrame:
    """Distinct mentions (entity) to their replacements (entity, kind, value)."""
    forms = entities.withColumn("kind", _kind(F.col("entity"))).withColumn("parts", _parts(F.col("kind"), F.col("entity")))
    forms = T.checkpoint(forms)
    each = forms.select("entity", F.posexplode("parts").alias("at", "p")).select("entity", "at", "p.kind", "p.normal", "p.gender")
    known = F.create_map(*(F.lit(x) for pair in _listed(key).items() for x in pair))
    listed = (F.col("kind") == "given") & F.element_at(known, F.col("normal")).isNotNull()
    # One gender for each given name: what a title says, the first by name where titles differ.
    chosen = assign(each.where(~listed).groupBy("kind", "normal").agg(F.min("gender").alias("gender")), key)
    every = each.withColumn("in_list", F.when(F.col("kind") == "given", F.element_at(known, F.col("normal"))))
    every = every.join(chosen, ["kind", "normal"], "left").withColumn("out", F.coalesce("in_list", "surrogate"))
    outs = every.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]).alias("outs"))
    title = F.regexp_extract("entity", rf"\A((?:{_TITLE})\.? )", 1)
    value = F.when(F.col("kind") == "name", F.concat(title, F.array_join("outs", " "))).otherwise(_format(F.col("kind"), F.col("entity"), F.col("outs")[0]))
    return forms.select("entity", "kind").join(outs, "entity").select("entity", "kind", value.alias("value"))


def replace(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with every entity in `text` replaced, and the columns `n_entities` (long) and `entity_kinds`.

    `key` is a secret of the caller: who knows it can draw the replacements of a guess again. All rows and columns stay,
    whatever their names (those named like the two added are replaced); a null text stays null, an empty one empty, a
    very long one is treated whole. Of overlapping entities the first in the text counts. Equal entities get equal
    replacements in all rows, different ones different; the same `key` and the same entities give the same replacements.
    `doc_id` may be missing, repeat or be null: rows are told apart by their texts, and repeated rows stay repeated.

    Patterns run over all texts once; texts without an entity, told by a bitmap of 2 MB, are passed through where they
    are read. A replacement that stands in very many texts is a skewed join key, which Spark splits.
    """
    if not key:
        raise ValueError("a key is needed: without one anybody can draw the replacements again")
    names = [c for c in docs.columns if c.lower() not in ("n_entities", "entity_kinds")]
    rows = T.packed(docs.select(*(c for c, n in zip(T.columns(docs), docs.columns) if n in names))).withColumn("text", F.col("row.text").cast("string"))
    rows = rows.withColumn("rid", F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b")))
    maybe = rows.where(F.col("text").rlike(MAYBE)).select("rid", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found"))
    found = T.checkpoint(maybe.where(F.size("found") > 0).dropDuplicates(["rid"]))
    mentions = found.select("rid", F.posexplode("found").alias("at", "entity"))
    values = T.checkpoint(_values(mentions.select("entity").distinct(), key))
    lists = mentions.join(values, "entity").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", "value", "kind"))).alias("new"))
    rows = T.marked(rows, "rid.a", found.select("rid.a"), "touched")
    # The text between the entities, and the replacements, in turn.
    pieces = F.transform(F.split("text", ANY, -1), lambda piece, i: F.concat(piece, F.coalesce(F.get("new", i)["value"], F.lit(""))))
    done = rows.where("touched").select("row", "text", "rid").join(lists, "rid", "left")
    done = done.select("row", F.when(F.col("new").isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"), F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("new", lambda x: x["kind"]))), ","), F.lit("")).alias("kinds"))
    rest = rows.where("not touched").select("row", "text", F.lit(0).cast("long").alias("n"), F.lit("").alias("kinds"))
    every = done.unionByName(rest)
    return every.select(*((F.col("text") if c.lower() == "text" else F.col("row").getField(c)).alias(c) for c in names), F.col("n").alias("n_entities"), F.col("kinds").alias("entity_kinds"))


#: The key of the registered query and of the pipeline, so that they can be repeated. Take a secret one for real data.
QUERY_KEY = "for repeatable queries only"


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return replace(T.table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
