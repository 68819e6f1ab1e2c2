"""PII surrogates (operator 1), in DataFrame and SQL functions only.

Personal data is found by patterns and replaced by keyed surrogates of the same kind: an e-mail
address by one of the same shape, digits by digits in the same places (a card number that passes the
check digit by one that does), an address by a valid address, a secret in its own alphabet, a person
with a title by a name of the title's gender and the name's script. The same entity, in whatever
spelling (case, blanks, separators), gets the same surrogate everywhere, in all documents; a family
name alone gets the family name that it has beside a first name.

Numbers, addresses and secrets take a keyed permutation of all strings of their form (:func:`permuted`),
which has no fixed point and gives different entities different surrogates however full the space is;
a surrogate may be the value of another entity, which is itself replaced. Names are drawn by a hash of
key, kind, entity and try and grow with the tries; none is a name of the corpus. Each round checks the
surrogates by grouping and joining, against each other and against those that stand; of those that
meet, the entity with the smallest hash keeps the surrogate and the others draw again.

Documents without personal data are passed by; only the others, and the entities, are shuffled.

Defined results: null text stays null and empty text empty; repeated rows are replaced alike; other
columns are carried as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

#: The query's key; a deployment passes its own secret.
KEY = "palimpsest"

#: Titles that come before a name.
MALE = ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "Господин")
FEMALE = ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа")
EITHER = ("Dr.", "Prof.")

#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    ("f", "latin"): ("Anna", "Clara", "Diana", "Elena", "Flora", "Irene", "Julia", "Laura", "Maria", "Nora", "Sofia", "Vera"),
    ("n", "latin"): ("Alex", "Andrea", "Charlie", "Dominique", "Kim", "Maxime", "Noa", "Robin", "Sascha", "Toni"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Роман"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Слава"),
}
#: Syllables of family names by script.
SYLLABLES = {
    "latin": ("ba", "den", "fal", "gor", "hal", "jen", "kes", "lor", "mar", "nel", "por", "ran", "sel", "tor", "ven", "wes"),
    "cyrillic": ("ба", "ве", "го", "да", "же", "за", "ка", "ле", "мо", "на", "по", "ра", "си", "то", "фе", "ша"),
}

_WORD = r"[\p{L}\p{N}._%+-]"
EMAIL = rf"(?<!{_WORD}){_WORD}{{1,128}}+@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,8}}\.[A-Za-z]{{2,24}}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
#: With a country code, or national: an area code in brackets or after a zero.
PHONE = r"(?:(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?!\d)|(?<![\w+(])\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w.+-])0\d{2,3}[ .-]\d{3}[ .-]\d{4}(?![\w-]))"
CARD = r"(?<![\w.+-])(?:\d{4}[ -]?){3}\d{1,7}(?!\d|[.-]\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
SECRET = r"""(?<=["'])(?<=(?i:token|secret|password|passwd|api_key|apikey|access_key)["']?\s{0,2}[=:]\s{0,2}["'])[^\s"']{8,8192}(?=["'])"""
_NAME = r"\p{Lu}\p{Ll}{1,40}(?:-\p{Lu}\p{Ll}{1,40})?"
_TITLE = "|".join(t.replace(".", r"\.") for t in sorted(MALE + FEMALE + EITHER, key=len, reverse=True))
PERSON = rf"(?=[{"".join(sorted({t[0] for t in MALE + FEMALE + EITHER}))}])(?<!\p{{L}})(?:{_TITLE}) {_NAME}(?: {_NAME})?(?!\p{{L}})"
#: All of them; most characters of a text can begin only a few.
ANY = f"{SECRET}|{EMAIL}|(?=[+(0-9])(?:{PHONE}|{IP}|{SSN}|{CARD})|(?=[A-Z]{{2}}[0-9]){IBAN}|{PERSON}"
#: Words before a quoted secret.
SECRET_WORDS = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")

#: Draws without a new entity placed before the surrogates grow longer.
GROW_AFTER = 4


def may_hold(text: Column) -> Column:
    """Whether a text has what any entity has; one cheap pass that most texts end with."""
    out = text.rlike("[0-9@]")
    words = MALE + FEMALE + EITHER
    # a word that has another one of them in it needs no search of its own
    for word in [w for w in words if not any(o != w and o in w for o in words)]:
        out = out | F.contains(text, F.lit(word))
    # secrets' words in any case
    out = out | text.rlike(rf"""(?i)(?:{"|".join(SECRET_WORDS)})["']?\s{{0,2}}[=:]""")
    return F.coalesce(out, F.lit(False))


def entities(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))


def kind_of(surface: Column) -> Column:
    whole = [("email", EMAIL), ("phone", PHONE), ("ip", IP), ("ssn", SSN), ("card", CARD), ("iban", IBAN), ("person", PERSON)]
    out = F.lit("secret")
    for name, pattern in reversed(whole):
        out = F.when(surface.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, surface: Column) -> Column:
    """What all spellings of one entity share."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    country = F.regexp_extract(surface, r"^\+(\d{1,3})[^0-9]", 1)
    family = F.lower(F.element_at(F.split(surface, " "), -1))
    return (
        F.when(kind == "email", F.lower(surface))
        .when(kind == "phone", F.concat_ws("|", country, F.expr("substr(regexp_replace(surface, '[^0-9]', ''), length(regexp_extract(surface, '^\\\\+(\\\\d{1,3})[^0-9]', 1)) + 1)")))
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "ip", F.array_join(F.transform(F.split(surface, r"\."), lambda o: o.cast("int").cast("string")), "."))
        .when(kind == "iban", F.replace(surface, F.lit(" "), F.lit("")))
        .when(kind == "person", family)
        .otherwise(surface)
    )


def _alphabet(code: Column) -> Column:
    return (
        F.when(code.between(0x370, 0x3FF), F.lit("αβγδεζηθικλμνξοπρστυφχψω"))
        .when(code.between(0x400, 0x4FF), F.lit("абвгдежзиклмнопрстуфхцчшэюя"))
        .when(code.between(0x4E00, 0x9FFF), F.lit("山川田林石水木金土花"))
        .otherwise(F.lit("abcdefghijklmnopqrstuvwxyz"))
    )


def _pick(letters: Column, seed: Column, i: Column) -> Column:
    return F.substring(letters, (F.pmod(F.xxhash64(seed, i), F.char_length(letters)) + 1).cast("int"), F.lit(1))


#: Rounds of the permutation, each way.
ROUNDS = 6


def permuted(rows: DataFrame, seed: Column) -> DataFrame:
    """``rows`` (core, hexadecimal) with ``new``: core under a keyed permutation of the strings of its form.

    Each digit and letter stays of its kind, case and script. A Feistel network over character values: in
    each round one half moves by a hash of the other. Forward, one step of the first character, and back
    again, so no string maps to itself.
    """
    hexadecimal = F.col("hexadecimal")

    def alphabet(c: Column) -> Column:
        return F.when(hexadecimal, F.lit("0123456789abcdef")).when(c.rlike("[0-9]"), F.lit("0123456789")).when(c.rlike(r"\p{L}"), _alphabet(F.ascii(c))).otherwise(F.lit(""))

    def value(c: Column, a: Column) -> Column:
        at = F.instr(a, F.lower(c))  # a letter that the alphabet lacks takes the place of its code
        return F.when(a == "", 0).when(at > 0, at - 1).otherwise(F.pmod(F.ascii(c), F.char_length(a))).cast("int")

    laid = rows.withColumn("places", F.sequence(F.lit(1), F.greatest(F.char_length("core"), F.lit(1)))).withColumn("chars", F.transform("places", lambda i: F.substring("core", i, F.lit(1))))
    laid = laid.withColumn("letters", F.transform("chars", alphabet)).withColumn("sizes", F.transform("letters", lambda a: F.char_length(a).cast("long")))
    laid = laid.withColumn("values", F.zip_with("chars", "letters", value)).withColumn("half", F.floor(F.char_length("core") / 2))
    laid = laid.withColumn("first", F.array_position(F.transform("sizes", lambda n: n > 0), True) - 1)

    def move(now: Column, turn: Column) -> Column:
        back = turn > ROUNDS
        nth = F.when(back, 2 * ROUNDS - turn).otherwise(turn)
        left = F.pmod(nth, F.lit(2)) == 0
        still = F.hash(F.filter(now, lambda v, i: (i < F.col("half")) != left))
        step = F.when(turn == ROUNDS, F.lit(0)).when(back, F.lit(-1)).otherwise(F.lit(1))

        def one(v: Column, i: Column, h: Column) -> Column:
            by = F.when(turn == ROUNDS, (i == F.col("first")).cast("long")).when((i < F.col("half")) == left, step * F.pmod(F.xxhash64(seed, nth, h, i), F.lit(1 << 40)))
            size = F.element_at("sizes", (i + 1).cast("int"))
            return F.when(size > 0, F.pmod(v + F.coalesce(by, F.lit(0)), size)).otherwise(v).cast("int")

        # the hash of the half that stays is taken once a round: the only element of an array
        return F.flatten(F.transform(F.array(still), lambda h: F.transform(now, lambda v, i: one(v, i, h))))

    laid = laid.withColumn("moved", F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), F.col("values"), move))

    def back_to_text(i: Column) -> Column:
        c, a = F.element_at("chars", i), F.element_at("letters", i)
        new = F.substring(a, F.element_at("moved", i) + 1, F.lit(1))
        return F.when(a == "", c).when((c == F.upper(c)) & (c != F.lower(c)) & ~hexadecimal, F.upper(new)).otherwise(new)

    return laid.select(*rows.columns, F.array_join(F.transform("places", back_to_text), "").alias("new"))


def _luhn_sum(digits: Column) -> Column:
    """The sum that the check digit of a card number makes a multiple of ten."""
    places = F.sequence(F.lit(1), F.char_length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((F.char_length(digits) - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def _iban_rest(bban: Column, country: Column) -> Column:
    """The check digits that make country and account a valid number."""
    text = F.concat(bban, country, F.lit("00"))

    def add(rest: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), rest * 10 + c.cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return 98 - F.aggregate(F.sequence(F.lit(1), F.char_length(text)), F.lit(0), add)


def _octets_as_hex(ip: Column) -> Column:
    return F.array_join(F.transform(F.split(ip, r"\."), lambda o: F.lower(F.lpad(F.hex(o.cast("int")), 2, "0"))), "")


def _family(name: Column, seed: Column, tries: Column) -> Column:
    n = F.lit(3) + F.floor(tries / GROW_AFTER).cast("int")

    def of(script: str) -> Column:
        parts = F.array(*map(F.lit, SYLLABLES[script]))
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(parts, (F.pmod(F.xxhash64(seed, i), F.lit(len(SYLLABLES[script]))) + 1).cast("int"))), "")

    return F.when(F.ascii(name).between(0x400, 0x4FF), of("cyrillic")).otherwise(of("latin"))


def _given(canon: Column, seed: Column, tries: Column) -> Column:
    """A given name of the gender and script in ``canon`` (family|gender|script|given), of more parts after some tries."""
    n = F.lit(1) + F.floor(tries / GROW_AFTER).cast("int")

    def of(names: tuple[str, ...]) -> Column:
        parts = F.array(*[F.lit(x.lower()) for x in names])
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(parts, (F.pmod(F.xxhash64(seed, i), F.lit(len(names))) + 1).cast("int"))), "-")

    out = F.lit(None).cast("string")
    for (gender, script), names in GIVEN.items():
        out = F.when(canon.contains(f"|{gender}|{script}|"), of(names)).otherwise(out)
    return F.concat(F.substring_index(canon, "|", 3), F.lit("|"), out)


def _core(kind: Column, canon: Column) -> Column:
    """The part of an entity that is permuted."""
    ending = F.char_length(F.regexp_extract(canon, r"(\.[^.@]+)$", 1))
    head = lambda n: F.substring(canon, F.lit(1), (F.char_length(canon) - n).cast("int"))
    return (
        F.when(kind == "email", head(ending))
        .when(kind == "phone", F.substring_index(canon, "|", -1))
        .when(kind == "ip", _octets_as_hex(canon))
        .when(kind == "card", head(F.lit(1)))
        .when(kind == "iban", F.expr("substr(canon, 5)"))
        .otherwise(canon)
    )


def _whole(kind: Column, canon: Column, core: Column, new: Column) -> Column:
    """The surrogate, from the permuted part; check digits are as right or wrong as they were."""
    last = F.substring(canon, -1, 1).cast("int")
    luhn = lambda digits: F.pmod(-_luhn_sum(F.concat(digits, F.lit("0"))), F.lit(10))
    country = F.substring(canon, 1, 2)
    check = F.pmod(F.substring(canon, 3, 2).cast("int") - _iban_rest(core, country) + _iban_rest(new, country), F.lit(100))
    octets = [F.conv(F.substring(new, k, 2), 16, 10) for k in (1, 3, 5, 7)]
    return (
        F.when(kind == "email", F.concat(new, F.regexp_extract(canon, r"(\.[^.@]+)$", 1)))
        .when(kind == "phone", F.concat_ws("|", F.substring_index(canon, "|", 1), new))
        .when(kind == "ip", F.concat_ws(".", *octets))
        .when(kind == "card", F.concat(new, F.pmod(last - luhn(core) + luhn(new), F.lit(10)).cast("string")))
        .when(kind == "iban", F.concat(country, F.lpad(check.cast("string"), 2, "0"), new))
        .otherwise(new)
    )


def drawn(todo: DataFrame, tries: int, key: str) -> DataFrame:
    """``todo`` (kind, canon) with its surrogates at a try, in the canonical form of their kind."""
    kind, canon = F.col("kind"), F.col("canon")
    own = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, F.lit(str(tries))), 256)
    names = todo.where(kind.isin("person", "given"))
    names = names.withColumn("surrogate", F.when(kind == "person", _family(canon, own, F.lit(tries))).otherwise(_given(canon, own, F.lit(tries))))
    others = todo.where(~kind.isin("person", "given")).withColumn("core", _core(kind, canon))
    # what the form fixes (kind, what isn't permuted) may be in the seed, so equal forms share one permutation
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, F.lit(str(tries))), 256)
    hexadecimal = (kind == "ip") | ((kind == "secret") & F.col("core").rlike("^[0-9a-f]+$"))
    others = permuted(others.withColumn("hexadecimal", hexadecimal), seed)
    return names.unionByName(others.select("kind", "canon", _whole(kind, canon, F.col("core"), F.col("new")).alias("surrogate")))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon), without two surrogates of a kind alike.

    Every round at least one of the entities that meet in a surrogate keeps it, so the rounds end.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo = staged(found.select("kind", "canon").distinct().repartition(parts, "kind", "canon"))
    real = todo.where(F.col("kind").isin("person", "given")).select("kind", F.col("canon").alias("surrogate"))
    placed, tries = None, 0
    while True:
        draw = staged(drawn(todo, tries, key))
        free = draw.join(real, ["kind", "surrogate"], "left_anti")
        if placed is not None:
            free = free.join(placed, ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min_by("canon", F.struct(F.xxhash64("canon"), "canon")).alias("canon"))
        won = staged(first.select("kind", "canon", "surrogate"))
        placed = won if placed is None else placed.unionByName(won)
        todo = staged(todo.join(won, ["kind", "canon"], "left_anti"))
        tries += 1
        if todo.isEmpty():
            return placed
        if tries % 8 == 0:
            placed = staged(placed)


def _script(name: Column) -> Column:
    return F.when(F.ascii(name).between(0x400, 0x4FF), F.lit("cyrillic")).otherwise(F.lit("latin"))


def given_key(kind: Column, surface: Column) -> Column:
    """family|gender|script|given of a person with a given name, else null."""
    parts = F.split(surface, " ")
    gender = F.when(parts[0].isin(*MALE), F.lit("m")).when(parts[0].isin(*FEMALE), F.lit("f")).otherwise(F.lit("n"))
    whole = F.concat_ws("|", F.lower(F.element_at(parts, -1)), gender, _script(parts[1]), F.lower(parts[1]))
    return F.when((kind == "person") & (F.size(parts) > 2), whole)


def _person(surface: Column, family: Column, given: Column) -> Column:
    """Title as it was, the given name's surrogate, family name in the case of the old one."""
    name = F.array_join(F.transform(F.split(F.substring_index(given, "|", -1), "-"), F.initcap), "-")
    return F.concat_ws(" ", F.split(surface, " ")[0], name, F.initcap(family))


def dressed(kind: Column, surface: Column, surrogate: Column, given: Column) -> Column:
    """The surrogate in the format of the surface: separators, blanks and case."""
    places = F.sequence(F.lit(1), F.char_length(surface))
    flat = F.replace(surrogate, F.lit("|"), F.lit(""))

    def digit(i: Column) -> Column:
        c = F.substring(surface, i, F.lit(1))
        nth = F.char_length(F.regexp_replace(F.substring(surface, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(flat, nth, F.lit(1))).otherwise(c)

    def solid(i: Column) -> Column:
        c = F.substring(surface, i, F.lit(1))
        nth = F.char_length(F.replace(F.substring(surface, F.lit(1), i), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substring(flat, nth, F.lit(1)))

    def cased(i: Column) -> Column:
        c, r = F.substring(surface, i, F.lit(1)), F.substring(flat, i, F.lit(1))
        return F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(r)).otherwise(r)

    return (
        F.when(kind.isin("phone", "card", "ssn"), F.array_join(F.transform(places, digit), ""))
        .when(kind == "iban", F.array_join(F.transform(places, solid), ""))
        .when(kind == "email", F.array_join(F.transform(places, cased), ""))
        .when(kind == "person", _person(surface, surrogate, given))
        .otherwise(surrogate)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with its texts' personal data replaced, and the number of entities replaced."""
    marked = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)], docs[text_col].cast("string").alias("_text"))
    columns = [f"_c{i}" for i in range(len(docs.columns))]
    # the patterns run once over each text that may hold something
    tried = staged(marked.where(may_hold(F.col("_text"))).withColumn("_found", entities(F.col("_text"))).withColumn("_row", F.monotonically_increasing_id()))
    clean = marked.where(~may_hold(F.col("_text"))).select(*columns, "_text", F.lit(0).alias("_n"))
    clean = clean.unionByName(tried.where(F.size("_found") == 0).select(*columns, "_text", F.lit(0).alias("_n")))
    held = tried.where(F.size("_found") > 0)
    each = held.select("_row", F.posexplode("_found").alias("_at", "surface"))
    kinds = each.withColumn("kind", kind_of(F.col("surface"))).withColumn("canon", canonical(F.col("kind"), F.col("surface")))
    kinds = staged(kinds.withColumn("_given", given_key(F.col("kind"), F.col("surface"))))
    first_names = kinds.where("_given IS NOT NULL").select(F.lit("given").alias("kind"), F.col("_given").alias("canon"))
    found = staged(surrogates(kinds.select("kind", "canon").unionByName(first_names), key))
    mapped = kinds.join(found.where("kind <> 'given'"), ["kind", "canon"])
    # persons of one family are told apart by their given names
    named = mapped.where("_given IS NOT NULL").join(found.where("kind = 'given'").select(F.col("canon").alias("_given"), F.col("surrogate").alias("_new_given")), "_given")
    mapped = mapped.where("_given IS NULL").withColumn("_new_given", F.lit(None).cast("string")).unionByName(named)
    new = mapped.select("_row", F.struct("_at", dressed(F.col("kind"), F.col("surface"), F.col("surrogate"), F.col("_new_given")).alias("s")).alias("e"))
    ordered = new.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["s"]).alias("_new"))
    literal = F.split("_text", ANY, -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(literal, "_new", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    replaced = held.join(ordered, "_row").select(*columns, rebuilt.alias("_text"), F.size("_new").alias("_n"))
    out = clean.unionByName(replaced)
    return out.select(*[F.col("_text" if c == text_col else f"_c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("_n").alias(count_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, KEY)
