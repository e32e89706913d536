"""PII surrogates, in DataFrame and SQL operations only.

Detected entities are replaced by keyed surrogates of their own kind and form: digits for digits, letters of the same
script and case, the same separators, a valid check digit where there was one, a name of the same gender and script.
The surrogate of an entity is a function of the key and the entity's canonical form, so it is the same wherever the
entity occurs, however it is written there (coreference), and two entities never share one (distinctness).

Distinctness is checked, not hoped for: the distinct entities of the whole table get surrogates from a keyed hash; those
whose surrogate another entity has, or which is itself a real entity, draw again with the next attempt number, and again,
until none is left. The entities of each form are counted first: where a form has fewer than ``ROOM`` surrogates for each
of them (one digit, the addresses of 192.168 when all occur), they get longer ones, an address of a wider network (of
five numbers at last), or a name of more syllables, and so do those that clash ``SAME_FORM`` times. So at most half of
what is left clashes in a round, however full a form is, and every table is served. Only entities travel for that. Texts
without an entity are passed on as they are; the others are cut at their entities and put together again with the
surrogates.

A mention is made of parts: literal text (a title, ``password=``) that stays, and units that are replaced. A name has a
family unit and given units; a given name is drawn for its gender, distinct among those of its family name, an initial
stays an initial. A family name that a title introduces is replaced wherever its document repeats it as a word of its own.

Patterns repeat groups a bounded number of times (Java recurses into each repetition of a group) and characters
possessively, and work on a long entity is in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.runtime import materialize, partitions_for

KEY = "kinfold-surrogates"
#: Surrogates that a form must have for each of its entities; with fewer they are lengthened from the start.
ROOM = 4
#: Attempts after which a surrogate is lengthened once more.
SAME_FORM = 6

MEN = "Mr|Mister|Herrn|Herr|Monsieur|Señor|Sr|Signor|Господин|господин|г-н"
WOMEN = "Mrs|Miss|Ms|Frau|Madame|Mademoiselle|Mme|Mlle|Señora|Señorita|Sra|Srta|Signora|Госпожа|госпожа|г-жа"
NAME_WORD = r"\p{Lu}[\p{L}\p{M}'’\-]*+"
INITIAL = r"\p{Lu}\."

#: Kinds of entities and how they are recognised, the first that matches a place wins. Java's syntax, no groups.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]{1,63}+(?:\.[\p{L}\p{N}\-]{1,63}+){0,125}\.\p{L}{2,63}+",
    "awskey": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|passphrase|secret|token|api[_\-]?key|access[_\-]?key)\s{0,3}[:=]\s{0,3}[\"']?(?=[^\s\"',;]{0,255}[0-9])[^\s\"',;]++[\"']?",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9A-Za-z+])(?:[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9A-Za-z])",
    "hex": r"(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}\p{{N}}\-])(?:{WOMEN}|{MEN})\.?[ \t]{{1,2}}(?:(?:{INITIAL}|{NAME_WORD})[ \t]{{1,2}}){{0,2}}{NAME_WORD}",
}
ANY = "|".join(PATTERNS.values())
#: What a text must hold to be looked at closely: a digit or an at sign, or what some title contains.
HINT = "[0-9@]"
TITLE_HINTS = ("Mr", "Ms", "Mis", "Herr", "Frau", "Mons", "Mada", "Made", "Mme", "Mlle", "Señor", "Sr", "Signor", "осподин", "оспож", "г-н", "г-ж")

# Given names to draw from, by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Albert Anton Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Robert Simon Thomas Victor Walter Xavier".split(),
    ("latin", "f"): "Alice Anna Berta Clara Diana Elena Emma Flora Greta Helena Ida Julia Klara Laura Maria Nina Olivia Paula Rosa Sofia Teresa Ursula Vera Wilma".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
    ("cyrillic", "f"): "Алина Белла Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лидия Мария Нина Ольга Полина Раиса".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga go ha ho ka ke ko la le lo ma me mo na ne no pa po ra re ro sa se so ta te to va ve vo za zo".split(),
    "cyrillic": "ба бе бо ва во га го да де до за зо ка ко ла ле ло ма мо на не но па по ра ре ро са се со та то фа хо ца ша".split(),
}
FAMILY_END = {"latin": "rn ll sk nd rt lm ns tt".split(), "cyrillic": ["енко", "ук", "ич", "ых"]}
ALPHABETS = {
    r"[a-z]": "abcdefghijklmnopqrstuvwxyz",
    r"[0-9]": "0123456789",
    r"[à-öø-ÿ]": "àáâäçèéêëìíîïñòóôöùúûü",
    r"[\p{IsCyrillic}]": "абвгдежзийклмнопрстуфхцчшщыэюя",
    r"[\p{IsGreek}]": "αβγδεζηθικλμνξοπρστυφχψω",
    r"[\p{IsArabic}&&\p{L}]": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"[\p{IsHan}]": "安北成春达东方飞国海和华建江杰金军兰立林美明宁平青荣山文心永",
    r"[\p{L}]": "abcdefghijklmnopqrstuvwxyz",
    r"[\p{N}]": "0123456789",
}


def _char(text: Column, i: Column) -> Column:
    return F.substring(text, i, F.lit(1))


def _chars(text: Column) -> Column:
    """The characters of a text, as an array: the i-th character of a long text is not to be counted off each time."""
    return F.split(text, "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, mod 10."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)
    d = lambda i: _char(digits, i).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
    return F.aggregate(F.transform(at, lambda i: F.when(d(i) > 9, d(i) - 9).otherwise(d(i))), F.lit(0), lambda a, x: a + x) % 10


def kind_of(mention: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        test = mention.rlike(rf"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _part(type_: Column | str | None, scope: Column | str, canon: Column | None, raw: Column) -> Column:
    type_ = F.lit(type_) if type_ is None or isinstance(type_, str) else type_
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return F.struct(type_.cast("string").alias("type"), scope.alias("scope"), (F.lit(None) if canon is None else canon).cast("string").alias("canon"), raw.alias("raw"))


def parts_of(mention: Column, kind: Column) -> Column:
    """The parts of a mention, in order: (type, scope, canon, raw); a null type stays as it is.

    Digits without separators are a card only if their check digit is right; other such numbers stay.
    """
    digits = F.regexp_replace(mention, "[^0-9]", "")
    bare = F.regexp_replace(mention, "[^0-9A-Za-z]", "")
    label = F.regexp_extract(mention, r"^([A-Za-z_\-]+\s*[:=]\s*[\"']?)", 1)
    value = F.regexp_extract(mention, r"^[A-Za-z_\-]+\s*[:=]\s*[\"']?([^\"']*)", 1)
    quote = F.regexp_extract(mention, r"([\"']?)$", 1)
    title = F.regexp_extract(mention, rf"^((?:{WOMEN}|{MEN})\.?[ \t]+)", 1)
    gender = F.when(title.rlike(rf"^(?:{WOMEN})\.?[ \t]"), "f").otherwise("m")
    rest = F.regexp_replace(mention, rf"^(?:{WOMEN}|{MEN})\.?[ \t]+", "")
    family = F.regexp_extract(rest, r"([^ \t]+)$", 1)
    given = F.regexp_extract(rest, r"^(.*?)[ \t]+[^ \t]+$", 1)
    gap = F.regexp_extract(rest, r"([ \t]+)[^ \t]+$", 1)
    name = F.array(
        _part(None, "", None, title), _part(F.when(given != "", "given"), F.concat_ws("|", gender, F.lower(family)), F.lower(given), given),
        _part(None, "", None, gap), _part("family", "", F.lower(family), family),
    )
    secret = F.array(_part(None, "", None, label), _part(F.when(value.rlike("^[0-9a-f]+$"), "hex").otherwise("value"), "", value, value), _part(None, "", None, quote))
    one = lambda type_, canon: F.array(_part(type_, "", canon, mention))
    return (
        F.when((kind == "card") & (digits == mention) & (_luhn(digits) != 0), F.array(_part(None, "", None, mention)))
        .when(kind == "name", name)
        .when(kind == "secret", secret)
        .when(kind.isin("card", "ssn", "phone"), one(kind, F.concat(F.when(F.startswith(mention, F.lit("+")), "+").otherwise(""), digits)))
        .when(kind == "iban", one(kind, bare))
        .when(kind.isin("email", "ipv6"), one(kind, F.lower(mention)))
        .otherwise(one(kind, mention))
    )


def _stream(seed: Column, chars: Column) -> Column:
    """Keyed blocks that ``_number`` reads numbers for ``chars`` characters from."""
    return F.transform(F.sequence(F.lit(0), F.floor(chars / 16).cast("int")), lambda b: F.sha2(F.concat(seed, F.lit("|"), b.cast("string")), 256))


def _number(stream: Column, i: Column) -> Column:
    """The i-th keyed number (0..65535, from 0)."""
    block = F.element_at(stream, (F.floor(i / 16) + 1).cast("int"))
    return F.conv(F.substring(block, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))


def _mapped(body: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each letter and digit of ``body`` replaced by a keyed one of its alphabet; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        out = F.when(hexadecimal & c.rlike("^[0-9a-f]$"), _char(F.lit("0123456789abcdef"), n % 16 + 1))
        for pattern, letters in ALPHABETS.items():
            out = out.when(F.lower(c).rlike(f"^{pattern}$"), _char(F.lit(letters), n % len(letters) + 1))
        out = out.otherwise(c)
        return F.when((F.lower(c) != c) & (F.upper(c) == c), F.upper(out)).otherwise(out)

    return F.array_join(F.transform(_chars(body), one), "")


def _head(type_: Column, canon: Column) -> Column:
    """What a surrogate keeps of the beginning."""
    return (
        F.when(type_ == "awskey", F.substring(canon, 1, 4)).when(type_ == "iban", F.substring(canon, 1, 2)).when(type_ == "card", F.substring(canon, 1, 1))
        .when(type_ == "phone", F.regexp_extract(canon, r"^(\+1|\+7|\+[0-9]{2}|)", 1)).otherwise("")
    )


def _tail(type_: Column, canon: Column) -> Column:
    """What a surrogate keeps of the end."""
    return F.when(type_ == "email", F.regexp_extract(canon, r"(\.example\.(?:com|net|org)|\.\p{L}{1,63})$", 1)).otherwise("")


def _private(canon: Column) -> Column:
    """Leading numbers of an address that name a private network."""
    return F.when(canon.rlike(r"^(10|127)\."), 1).when(canon.rlike(r"^192\.168\."), 2).otherwise(0)


def _lettered(type_: Column, canon: Column) -> Column:
    """Whether a unit's surrogate is made character by character: all but addresses and names of known scripts."""
    return ~type_.isin("ipv4", "family", "given") | type_.isin("family", "given") & (~canon.rlike(r"^[\p{IsLatin}\p{IsCyrillic}]") | canon.rlike(r"^\p{L}\."))


def widened(entities: DataFrame) -> DataFrame:
    """``entities`` with ``base``: by how much their surrogates are lengthened, so that each form has room for all of its
    entities. A form is what surrogates of one kind share: type, scope, length, the kinds of characters, what is kept."""
    type_, canon = F.col("type"), F.col("canon")
    head, tail = _head(type_, canon), _tail(type_, canon)
    body = F.substring(canon, F.length(head) + 1, F.length(canon) - F.length(head) - F.length(tail))
    hexadecimal = type_.isin("hex", "ipv6")
    kinds = F.when(hexadecimal, F.regexp_replace(body, "[0-9a-f]", "9")).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[0-9]", "9"), r"\p{Lu}", "A"), r"[\p{L}&&[^A]]", "a"))
    free = F.length(F.regexp_replace(body, r"[^\p{L}\p{N}]", "")) - (type_ == "card").cast("int")
    private, cyrillic = _private(canon), canon.rlike(r"^\p{IsCyrillic}")
    lettered = _lettered(type_, canon)
    # Powers of ten: how many surrogates the shortest form has, and what each widening multiplies them by.
    room = F.when(lettered, free * F.when(hexadecimal, 1.2).otherwise(1.0)).when(type_ == "ipv4", (4 - private) * 2.4).when(type_ == "family", F.when(cyrillic, 3.6).otherwise(4.1)).otherwise(1.2)
    gain = F.when(lettered, 1.0).when(type_ == "ipv4", 2.4).when(type_ == "family", 1.5).otherwise(1.2)
    form = F.when(lettered, F.concat_ws("|", head, kinds, tail)).when(type_ == "ipv4", F.call_function("substring_index", canon, F.lit("."), private)).otherwise(cyrillic.cast("string"))
    rows = entities.select("*", F.xxhash64("type", "scope", form).alias("form"), room.alias("room"), gain.alias("gain"))
    counts = rows.groupBy("form").agg(F.count("*").alias("n"))
    base = F.greatest(F.lit(0), F.ceil((F.log10(F.col("n") * ROOM) - F.col("room")) / F.col("gain"))).cast("int")
    return rows.join(counts, "form").select(*entities.columns, base.alias("base"))


def draw(todo: DataFrame, key: str, parts: int) -> DataFrame:
    """``todo`` (type, scope, canon, base, attempt) with ``sur``, the surrogate in canonical form.

    Keyed bytes and the pieces of the canonical form are columns of their own before the exchange: the expressions
    behind it refer to them in many places and per character, and must not compute them there.
    """
    type_, canon, scope, attempt = (F.col(c) for c in ("type", "canon", "scope", "attempt"))
    seed = F.sha2(F.concat_ws("|", F.lit(key), type_, scope, canon, attempt.cast("string")), 256)
    wider = F.col("base") + F.floor(attempt / SAME_FORM).cast("int")
    rows = todo.select("*", wider.alias("wider"), seed.alias("seed"), _head(type_, canon).alias("head"), _tail(type_, canon).alias("tail"))
    rows = rows.withColumn("stream", _stream(F.col("seed"), F.length(canon) + 4 * F.col("wider") + 16)).repartition(parts, "canon")
    stream, head, tail, wider = (F.col(c) for c in ("stream", "head", "tail", "wider"))
    body = F.substring(canon, F.length(head) + 1, F.length(canon) - F.length(head) - F.length(tail))
    like = F.regexp_extract(body, r"([\p{L}\p{N}])", 1)
    body = F.concat(F.repeat(F.when(like == "", "0").otherwise(like), wider), body)
    rows = rows.withColumn("mapped", F.when(_lettered(type_, canon), F.concat(head, _mapped(body, stream, type_.isin("hex", "ipv6")), tail)))
    mapped = F.col("mapped")
    # A number that begins with 0 or 1 after its country code is no subscriber's.
    first = F.length(head) + 1
    phone = F.when(_char(canon, first).rlike("[2-9]"), F.concat(head, (_number(stream, F.length(mapped) + 1) % 8 + 2).cast("string"), F.substring(mapped, first + 1, F.length(mapped)))).otherwise(mapped)
    rows = rows.withColumn("stem", F.substring(mapped, F.lit(1), F.length(mapped) - 1))
    check = F.when((type_ == "card") & (_luhn(canon) == 0), F.concat("stem", ((10 - _luhn(F.concat("stem", F.lit("0")))) % 10).cast("string"))).otherwise(mapped)
    private = _private(canon)
    octet = lambda i: F.when(i < private - wider, F.element_at(F.split(canon, r"\."), F.least(i, F.lit(3)) + 1)).otherwise((_number(stream, i) % 254 + 1).cast("string"))
    ipv4 = F.array_join(F.transform(F.sequence(F.lit(0), 3 + F.greatest(F.lit(0), wider - private)), octet), ".")

    def family(script: str) -> Column:
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), 2 + wider), lambda i: _pick(SYLLABLES[script], _number(stream, i))), ""), _pick(FAMILY_END[script], _number(stream, F.lit(0))))

    def given(script: str, gender: str) -> Column:
        return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), wider), lambda i: _pick(GIVEN[script, gender], _number(stream, i))), " "))

    cyrillic, woman = canon.rlike(r"^\p{IsCyrillic}"), F.startswith(scope, F.lit("f|"))
    sur = (
        F.when(type_ == "phone", phone).when(type_ == "card", check).when(type_ == "ipv4", ipv4)
        .when(mapped.isNotNull(), mapped)
        .when(type_ == "family", F.when(cyrillic, family("cyrillic")).otherwise(family("latin")))
        .otherwise(F.when(cyrillic & woman, given("cyrillic", "f")).when(cyrillic, given("cyrillic", "m")).when(woman, given("latin", "f")).otherwise(given("latin", "m")))
    )
    return rows.select(*todo.columns, sur.alias("sur"))


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``(type, scope, canon, sur)`` for a table of distinct entities: no two of a type and scope share a surrogate, and
    none is an entity itself. Entities that clash draw again."""
    unit = ["type", "scope", "canon"]
    entities = materialize(entities.select(*unit), "entities")
    real = entities.select("type", "scope", F.col("canon").alias("sur"))
    todo, done = materialize(widened(entities).withColumn("attempt", F.lit(0)), "todo"), None
    left = todo.count()
    while left or done is None:
        drawn = draw(todo, key, max(1, min(partitions_for(entities.sparkSession, left, 20_000), -(-left // 500)))).join(real.withColumn("taken", F.lit(True)), ["type", "scope", "sur"], "left")
        first = F.row_number().over(Window.partitionBy("type", "scope", "sur").orderBy("canon")) == 1
        drawn = drawn.withColumn("good", first & F.col("taken").isNull())
        if done is not None:
            drawn = drawn.join(done.select("type", "scope", "sur", F.lit(True).alias("used")), ["type", "scope", "sur"], "left").withColumn("good", F.col("good") & F.col("used").isNull())
        drawn = materialize(drawn.select(*unit, "sur", "base", "attempt", "good"), "drawn")
        good = drawn.where("good").select(*unit, "sur")
        done = good if done is None else done.unionAll(good)
        todo = drawn.where("not good").select(*unit, "base", (F.col("attempt") + 1).alias("attempt"))
        left = todo.count()
    return done


def written(type_: Column, raw: Column, sur: Column) -> Column:
    """A surrogate in the way its entity was written: separators, case."""
    capital = F.initcap(sur)
    name = F.when((F.upper(raw) == raw) & (F.length(raw) > 1), F.upper(sur)).when(F.lower(F.substring(raw, 1, 1)) == F.substring(raw, 1, 1), sur).otherwise(capital)
    slots = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(_char(raw, i).rlike("[+0-9A-Za-z]"), 1).otherwise(0))
    number = lambda i: F.aggregate(F.slice(slots, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(F.element_at(slots, i) == 1, _char(sur, number(i))).otherwise(_char(raw, i))), "")
    cased = F.array_join(F.zip_with(_chars(raw), _chars(sur), lambda r, s: F.when(F.lower(r) != r, F.upper(s)).otherwise(s)), "")
    same = F.length(raw) == F.length(sur)
    spaced = F.concat(spaced, F.substring(sur, number(F.length(raw)) + 1, F.length(sur)))  # of a lengthened surrogate
    return F.when(type_.isin("family", "given"), name).when(type_.isin("card", "ssn", "phone", "iban"), spaced).when(type_.isin("email", "ipv6") & (raw != F.lower(raw)) & same, cased).otherwise(sur)


def pseudonymize(docs: DataFrame, text: str = "text", key: str = KEY, count: str = "n_entities") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and a column ``count``, the mentions replaced (family names that
    are repeated without a title not counted); a column of that name is replaced.

    Null texts stay null and have no entity; all rows come back, repeated ones as often as given. Columns may have any
    names but those starting with ``_pii_``.
    """
    docs = docs.drop(count)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    body = F.col(f"`{text}`")
    hint = body.rlike(HINT)
    for title in TITLE_HINTS:
        hint |= body.contains(title)
    marked = F.coalesce(hint & body.rlike(ANY), F.lit(False))
    hits = materialize(docs.where(marked).withColumn("_pii_id", F.monotonically_increasing_id()), "hits")
    found = hits.select("_pii_id", F.posexplode(F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).alias("at", "mention"))
    found = found.withColumn("kind", kind_of(F.col("mention"))).select("_pii_id", "at", F.posexplode(parts_of(F.col("mention"), F.col("kind"))).alias("part", "p")).select("_pii_id", "at", "part", "p.*")
    found = materialize(found.where("raw <> ''"), "mentions")
    units = found.where("type is not null")
    sur = assign(units.groupBy("type", "scope", "canon").count(), key)
    named = units.join(sur, ["type", "scope", "canon"], "left").select("_pii_id", "at", "part", "type", "raw", written(F.col("type"), F.col("raw"), F.col("sur")).alias("new"))
    new = named.unionAll(found.where("type is null").select("_pii_id", "at", "part", "type", "raw", F.col("raw").alias("new")))
    mentions = new.groupBy("_pii_id", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), "").alias("new"), F.max(F.when(F.col("type") == "family", F.struct("raw", "new"))).alias("family"), F.max(F.col("type").isNotNull().cast("int")).alias("real"))
    family = F.when(F.length("family.raw") > 2, F.col("family"))
    lists = mentions.groupBy("_pii_id").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("_pii_new"), F.map_from_entries(F.collect_set(family)).alias("_pii_families"), F.sum("real").cast("int").alias("_pii_count"))
    word = F.lit(r"[\p{L}\p{M}'’\-]++|[^\p{L}\p{M}'’\-]++")
    renamed = lambda p: F.when(F.size("_pii_families") == 0, p).otherwise(F.array_join(F.transform(F.regexp_extract_all(p, word, F.lit(0)), lambda w: F.coalesce(F.element_at("_pii_families", w), w)), ""))
    # A text has one mention between each two pieces, and they come in the order of ``at``.
    rebuilt = F.array_join(F.zip_with("_pii_pieces", "_pii_new", lambda p, m: F.concat(renamed(p), F.coalesce(m["new"], F.lit("")))), "")
    joined = hits.withColumn("_pii_pieces", F.split(body, ANY, -1)).join(lists, "_pii_id")
    changed = joined.select(*[rebuilt.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.col("_pii_count").alias(count))
    return docs.where(~marked).select(*columns, F.lit(0).alias(count)).unionAll(changed)


def op4_query(docs: DataFrame) -> DataFrame:
    found = pseudonymize(docs.select("doc_id", "text"))
    return found.select("doc_id", "text", "n_entities", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
