"""Personal data replaced by surrogates, with DataFrame functions alone.

Detected entities - mail addresses, telephone, card and bank account numbers, network
addresses, social-security numbers, access keys, secrets after a telling word, and
names after a title - are replaced by values of the same kind that a keyed hash
chooses. A name keeps its gender (told by the title, if it tells one) and script; a
number keeps its grouping, and what makes it valid (check digits, octets below 256);
letters stay letters of the same case, digits digits.

A name that a title introduces is replaced in the same text without it, too, word by
word, but for a word that the text also has in lower case, and for a given name that
opens a sentence without the rest of the name: these are mostly other words. Words are
looked up in buckets by hash, so the time does not grow with words times names.

The same entity gets the same surrogate wherever it is found, in whatever
formatting (telephone numbers by their last ten digits); parts of names are entities of their own, so that a full name and the
bare surname still agree, also where the same text has them without a title. Distinct entities get distinct surrogates, none of which
is itself an entity of the corpus: what collides is hashed again, until nothing
does. That needs the distinct entities only, as tables; texts without an entity are
passed on as they are and never shuffled.

Defined cases: null and empty texts are kept as they are; equal texts get equal
replacements; rows that repeat a key are treated each; an empty table gives no rows;
all other columns are kept, whatever their names. A column ``n_entities`` of the
input is replaced by the result's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: The key of the registered query. Whoever publishes a corpus brings a secret one.
DEMONSTRATION_KEY = "demonstration key, not secret"

# FIXED VALUES: titles by gender, and what surrogate names are made of.
MALE = r"Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|господин|г-н"
FEMALE = r"Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mademoiselle|Señora|Sra|госпожа|г-жа"
NEUTRAL = r"Dr|Doctor|Doktor|Docteur|Dra|Prof|Professor|Professeur|Profesor|доктор|профессор"
TITLES = f"{MALE}|{FEMALE}|{NEUTRAL}"
GIVEN = {
    ("male", "latin"): "Adrian Bruno Casper Damian Edgar Fabian Gideon Hugo Ivor Jasper Konrad Leopold Magnus Nestor Oscar Quentin".split(),
    ("female", "latin"): "Ada Beatrix Clara Dora Elena Flora Greta Helena Irma Judith Klara Leonie Mina Nora Olivia Petra".split(),
    ("neutral", "latin"): "Alexis Ariel Auguste Blair Camille Dominique Eden Jules Kim Lou Maxime Noor Robin Sacha Toni Yael".split(),
    ("neutral", "cyrillic"): "Саша Женя Валя Шура Слава Ника Паша Вика Мика Юля Тося Люба Гоша Рома Сима Тая".split(),
    ("male", "cyrillic"): "Антон Борис Вадим Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("female", "cyrillic"): "Алла Белла Вера Галина Дарья Елена Жанна Зоя Инна Клара Лидия Майя Нина Ольга Полина Рада".split(),
}
FIRST = {"latin": "Al Ber Cor Dan El Fen Gar Hol Is Jor Kel Lin Mar Nor Os Per".split(),
         "cyrillic": "Ал Бер Вол Гор Дан Ер Жур Зим Ив Кар Лом Мар Нов Ор Пет Рож".split()}
NEXT = {"latin": "ba den fer gan hol jin kas len mo nel pin ros sen tor vin wick".split(),
        "cyrillic": "ба вен гол дар жен зин кас лен мо нел пин рос сен тор хов цев".split()}

WORD = r"[\p{L}\p{N}_]"
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})"
MAIL_END = r"@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
#: A capitalised word that is no title, or initials; between them, words such as "von".
NAME = rf"(?!(?:{TITLES})(?!\p{{L}}))(?:\p{{Lu}}[\p{{L}}’'-]{{1,40}}|(?:\p{{Lu}}\.){{1,4}})"
PARTICLE = r"(?:von|van|der|den|de|del|della|di|da|dos|du|ten|ter|zu|bin|ibn)"
TITLE = rf"(?:(?:{TITLES})\.? {{1,2}}){{1,3}}"
#: A word of a name, without what makes it a genitive.
NAME_WORD = r"(?<![\p{L}’'-])(?:\p{Lu}\.|\p{L}+(?:[’'-](?!s(?!\p{L}))\p{L}+)*)"
SECRET = r"(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
HEX = r"[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "iban": rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{WORD})",
    # Eight groups, or fewer on both sides of a double colon, one of them with a digit.
    "address6": rf"(?=[A-Fa-f:]{{0,39}}\d)(?:(?:{HEX}:){{7}}{HEX}|{HEX}(?::{HEX}){{1,5}}::(?:{HEX}(?::{HEX}){{0,4}})?|{HEX}::{HEX}(?::{HEX}){{1,5}})(?![\w:])",
    "mail": rf"[A-Za-z0-9._%+-]{{1,64}}+{MAIL_END}",
    "ssn": rf"\d{{3}}-\d{{2}}-\d{{4}}(?!{WORD})",
    "phone": r"(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
    # Ten digits in a row that begin as in North America, and any grouping of 8 to 15 digits after a plus sign.
    rf"|[2-9]\d{{9}}(?!{WORD}|\.\d)|\+[1-9](?:[ .-]?\(?\d\)?){{7,14}}(?!\d))",
    "address": rf"(?<!\d\.)(?:{OCTET}\.){{3}}{OCTET}(?!{WORD}|\.\d)",
    "key": rf"AKIA[0-9A-Z]{{16}}(?!{WORD})",
    "secret": rf"{SECRET}(?=[+/_-]{{0,255}}[0-9A-Za-z])[0-9A-Za-z+/_-]{{8,256}}",
    "person": rf"{TITLE}{NAME}(?:(?:(?: {PARTICLE}){{0,3}} |(?<=\.)){NAME}){{0,7}}",
}
#: Digit groups that may hold a card number, up to the end of the last one (and a letter after it, if
#: there is one), unless that is the start of a mail address. What is in them is told by ``inside``.
NUMBERS = rf"(?=\d(?:[ -]?\d){{12}})\d[\d .-]*\d(?!\d)(?![A-Za-z0-9._%+-]{{0,64}}{MAIL_END}){WORD}?"
ANY = rf"(?<!{WORD})(?:{'|'.join(PATTERNS.values())}|{NUMBERS})"
#: Cards: the usual groupings, found wherever a group begins, and any other, from left to right.
CARD = rf"\d(?:[ -]?\d){{12,18}}(?!{WORD})"
CARDS = [rf"(?<!{WORD})(?=({grouping})(?!{WORD}))" for grouping in (
    r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{4,5}")]
AMONG_NUMBERS = [rf"(?<!{WORD}){PATTERNS[kind]}" for kind in ("ssn", "phone", "address")]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_from_last: int) -> Column:
    """Sum of a number's digits, every second one doubled, from the last (1) or the one before (0)."""
    reverse = F.reverse(digits)
    places = F.sequence(F.lit(1), F.length(digits))

    def term(i: Column) -> Column:
        digit = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(F.pmod(i, F.lit(2)) == doubled_from_last, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.transform(places, term), F.lit(0), lambda a, x: a + x)


def _remainder(text: Column) -> Column:
    """What a number of digits and capitals, as two digits each, leaves when divided by 97."""

    def step(left: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.pmod(left * F.when(letter, 100).otherwise(10) + F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48), F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _account(text: Column) -> Column:
    """An account number with country and check digits at the end, as they are checked."""
    return F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))


def valid_cards(found: Column) -> Column:
    return F.filter(found, lambda hit: F.pmod(_luhn_sum(_digits(hit), 0), F.lit(10)) == 0)


def _quoted(values: Column) -> Column:
    """Patterns that find exactly these digit groups."""
    return F.transform(values, lambda v: F.concat(F.lit(rf"(?<!{WORD})\Q"), v, F.lit(rf"\E(?!{WORD})")))


def inside(numbers: DataFrame) -> DataFrame:
    """``hit``, digit groups, with a ``pattern`` of the entities in them. A card's check digit is tested
    for every grouping at every place, so that no number beside it hides it; a card in an unusual
    grouping is looked for in what the other kinds leave."""
    usual = valid_cards(F.flatten(F.array(*[F.regexp_extract_all("hit", F.lit(c), F.lit(1)) for c in CARDS])))
    first = numbers.withColumn("first", F.concat(_quoted(F.array_distinct(usual)), F.array(*map(F.lit, AMONG_NUMBERS))))
    gaps = F.split("hit", F.array_join("first", "|"), -1)
    unusual = valid_cards(F.flatten(F.transform(gaps, lambda gap: F.regexp_extract_all(gap, F.lit(rf"(?<!{WORD}){CARD}"), F.lit(0)))))
    pattern = F.array_join(F.concat("first", _quoted(F.array_distinct(unusual))), "|")
    return first.select("hit", pattern.alias("pattern"))


def kind_of(hit: Column) -> Column:
    """Kind of a detected string; null for digit groups and cards."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        matches = hit.rlike(f"^(?:{pattern})$")
        if name == "iban":
            matches = F.when(matches, _remainder(_account(F.replace(hit, F.lit(" ")))) == 1).otherwise(False)
        kind = F.when(matches, F.lit(name)).otherwise(kind)
    return kind


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def parts_of(hit: Column, kind: Column) -> Column:
    """The entities of a detected string, each by kind and by a value free of formatting, with the words
    of a name as they are written. Words such as "von" have no kind."""
    words = F.regexp_extract_all(F.regexp_replace(hit, f"^{TITLE}", ""), F.lit(NAME_WORD), F.lit(0))
    title = F.regexp_extract(hit, f"^{TITLE}", 0)
    gender = F.lit("neutral")
    for name_of, titles in (("male", MALE), ("female", FEMALE)):
        gender = F.when(title.rlike(rf"(?<!\p{{L}})(?:{titles})(?!\p{{L}})"), name_of).otherwise(gender)

    def name(word: Column, i: Column) -> Column:
        last = (i == F.size(words) - 1) & ~word.rlike(r"\.$")
        of = F.when(last, F.concat_ws("-", F.lit("surname"), _script(word))).otherwise(F.concat_ws("-", F.lit("given"), gender, _script(word)))
        return F.struct(F.when(~word.rlike(f"^{PARTICLE}$"), of).alias("kind"), F.initcap(word).alias("value"), word.alias("word"))

    value = (
        F.when(kind.isin("mail", "address6"), F.lower(hit)).when(kind == "iban", F.replace(hit, F.lit(" ")))
        .when(kind == "phone", F.when(F.length(_digits(hit)) < 10, _digits(hit)).otherwise(F.right(_digits(hit), F.lit(10))))
        .when(kind.isin("card", "ssn"), _digits(hit))
        .when(kind == "secret", F.regexp_replace(hit, f"^{SECRET}", "")).otherwise(hit)
    )
    short = (kind == "phone") & (F.length(value) < 10)
    single = F.array(F.struct(F.when(short, "short-phone").otherwise(kind).alias("kind"), value.alias("value"), value.alias("word")))
    return F.when(kind != "person", single).otherwise(F.transform(words, name))


def candidate(key: str, kind: Column, value: Column, attempt: int) -> Column:
    """What the key's hash proposes for an entity. Later attempts give other and more varied proposals,
    so that every kind has more of them than a corpus has entities."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(attempt))), 512)
    digit = F.translate(digest, "abcdef", "284617")
    letter = F.translate(digest, "0123456789abcdef", "bcdfghjklmnpqrst")

    def number(place: int | Column) -> Column:
        at = place if isinstance(place, Column) else F.lit(place)
        return F.conv(F.substring(digest, at * 8 + 1, F.lit(7)), 16, 10).cast("long")

    def masked(text: Column, signs: bool = False) -> Column:
        """Digits for digits and letters for letters, place by place; letters for signs if so told."""

        def swap(c: Column, i: Column) -> Column:
            at = F.pmod(i, F.lit(128)) + 1
            other = F.substring(letter, at, F.lit(1))
            return (F.when(c.rlike("[0-9]"), F.substring(digit, at, F.lit(1))).when(c.rlike("[a-z]"), other)
                    .when(c.rlike("[A-Z]"), F.upper(other)).otherwise(other if signs else c))

        return F.array_join(F.transform(F.split(text, ""), swap), "")

    def chosen(words: list[str], place: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.pmod(number(place), F.lit(len(words))) + 1).cast("int"))

    ending = F.regexp_extract(value, r"\.[^.]*$", 0)
    longer = F.substring(letter, 65, max(attempt - 1, 0))  # at most 64 more letters
    mail = F.concat(longer, masked(F.substring(value, F.lit(1), F.length(value) - F.length(ending))), ending)
    length = F.length(value)
    exchange = F.lit("555") if attempt < 3 else F.substring(digit, 17, 3)
    phone = F.concat((F.pmod(number(0), F.lit(8)) + 2).cast("string"), F.substring(digit, 9, 2), exchange, F.substring(digit, 11, 4))
    body = F.concat(F.substring(value, 1, 1), F.substring(digit, F.lit(1), length - 2))
    if attempt > 2:
        body = F.substring(digit, F.lit(1), length - 1)
    card = F.concat(body, F.pmod(-_luhn_sum(body, 1), F.lit(10)).cast("string"))

    bban = masked(F.substring(value, F.lit(5), F.length(value)))
    country = F.substring(value, 1, 2)
    check = F.lpad((98 - _remainder(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")

    def hexed(c: Column, i: Column) -> Column:
        return F.when(c == ":", c).otherwise(F.substring(digest, F.pmod(i, F.lit(128)) + 1, F.lit(1)))

    def octet(o: Column, i: Column) -> Column:
        n = number(i)
        free = F.pmod(n, F.lit(254)) + 1
        if attempt > 2:
            return free.cast("string")
        sized = F.when(F.length(o) == 1, F.pmod(n, F.lit(9)) + 1).when(F.length(o) == 2, F.pmod(n, F.lit(90)) + 10)
        return sized.otherwise(F.pmod(n, F.lit(156)) + 100).cast("string")

    found = (
        F.when(kind == "mail", mail).when(kind == "iban", F.concat(country, check, bban))
        .when(kind == "address6", F.array_join(F.transform(F.split(value, ""), hexed), "")).when(kind == "phone", phone).when(kind == "card", card)
        .when(kind == "address", F.array_join(F.transform(F.split(value, r"\."), octet), "."))
        .when(kind == "ssn", F.concat(F.lit("9") if attempt < 3 else F.substring(digit, 9, 1), F.substring(digit, 1, 8)))
        .when(kind == "short-phone", F.concat(F.substring(value, 1, 1 if attempt < 10 else 0), F.substring(digit, F.lit(1), length - (1 if attempt < 10 else 0))))
        .when(kind == "key", F.concat(F.lit("AKIA"), masked(F.substring(value, 5, 16))))
        .when(kind == "secret", F.concat(masked(value, attempt > 1), longer))
    )
    more = attempt // 2
    for (gender, script), words in GIVEN.items():
        name = F.concat(chosen(words, 0), *[F.lower(chosen(words, 1 + n)) for n in range(min(more, 14))])
        found = found.when(kind == f"given-{gender}-{script}", name)
    for script in FIRST:
        name = F.concat(chosen(FIRST[script], 0), *[chosen(NEXT[script], 1 + n) for n in range(min(1 + more, 14))])
        found = found.when(kind == f"surname-{script}", name)
    return found


#: Attempts after which what still collides is an error; the proposals of every kind are widest long before.
ATTEMPTS = 60


def resolved(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): one to one within a kind, and no surrogate
    is one of the values. If a kind's values are so many that its format leaves none, that is an error."""
    waiting, done, attempt = entities, None, 0
    real = entities.select("kind", F.col("value").alias("surrogate"))
    while not waiting.isEmpty():
        if attempt == ATTEMPTS:
            left = sorted(r.kind for r in waiting.select("kind").distinct().collect())  # a handful of kinds
            raise ValueError(f"no surrogates left after {ATTEMPTS} attempts for entities of the kinds {left}")
        tried = waiting.withColumn("surrogate", candidate(key, F.col("kind"), F.col("value"), attempt))
        free = tried.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = written(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")), "surrogates")
        waiting = written(waiting.join(won, ["kind", "value"], "left_anti"), "waiting")
        done = won if done is None else done.unionByName(won)
        attempt += 1
    return entities.withColumn("surrogate", F.lit("")).limit(0) if done is None else done


def _filled(between: Column, new: Column) -> Column:
    """What lies between hits, with the new strings in place of the hits."""
    return F.array_join(F.zip_with(between, new, lambda piece, n: F.concat(piece, F.coalesce(n, F.lit("")))), "")


def _named(word: Column, surrogate: Column) -> Column:
    """A name's surrogate in the form of a word: an initial, capitals, or as it is."""
    initial = F.concat(F.upper(F.substring(surrogate, 1, 1)), F.lit("."))
    return F.when(word.rlike(r"^\p{Lu}\.$"), initial).when(word == F.upper(word), F.upper(surrogate)).otherwise(surrogate)


#: Buckets of a text's names; a word that may be one, with its apostrophes and hyphens; what ends before a sentence.
BUCKETS = 64
CAPITALISED = rf"(?<!{WORD})\p{{Lu}}\p{{L}}*(?:[’'-](?!s(?!\p{{L}}))\p{{L}}+)*(?!{WORD})"
SENTENCE = r"(?:[.!?…][\"'”’»)\]]*\s+|\n\s*)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Written into the lambda of an array function, it would be
    computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def names_by_bucket(names: Column, text: Column) -> Column:
    """Buckets of (form, surrogate, given): the forms in which a text's ``names`` (length, word, value,
    surrogate, given) may stand in it, but for those whose lower case is a word of the text."""
    lower = F.regexp_extract_all(text, F.lit(rf"(?<!{WORD})\p{{Ll}}+(?!{WORD})"), F.lit(0))

    def forms(common: Column) -> Column:
        rare = F.filter(names, lambda n: ~F.array_contains(common, F.lower(n.value)))
        return F.flatten(F.transform(rare, lambda n: F.transform(F.array(n.word, F.upper(n.word), n.value), lambda form: F.struct(
            F.pmod(F.hash(form), F.lit(BUCKETS)).alias("bucket"), form.alias("form"), n.surrogate.alias("surrogate"), n.given.alias("given")))))

    def dealt(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.filter(found, lambda f: f.bucket == b))

    common = F.array_intersect(F.transform(names, lambda n: F.lower(n.value)), lower)
    return let(let(common, forms), dealt)


def bare(pieces: Column, names: Column, text: Column) -> Column:
    """What lies between hits, as (piece, n): with words that stand in a text's ``names`` replaced, and
    how many were."""

    def known(buckets: Column, word: Column) -> Column:
        return F.get(F.filter(F.get(buckets, F.pmod(F.hash(word), F.lit(BUCKETS))), lambda f: f.form == word), F.lit(0))

    def new_word(buckets: Column, s: Column, w: Column, i: Column) -> Column:
        def chosen(found: Column) -> Column:
            opens = F.get(s.gaps, i).rlike(SENTENCE) | ((i == 0) & (F.get(s.gaps, i) == "") & (s.place == 0))
            alone = F.coalesce((F.get(s.gaps, i + 1) != " ") | known(buckets, F.get(s.words, i + 1)).form.isNull(), F.lit(True))
            whole = F.when(~(found.given & opens & alone), _named(w, found.surrogate))
            # Of a word of several parts, such as Smith-Jones, some may be names.
            parts = F.transform(F.split(w, "(?<=[’'-])|(?=[’'-])"), lambda p: F.coalesce(_named(p, known(buckets, p).surrogate), p))
            return F.when(found.isNotNull(), whole).when(w.rlike("[’'-]"), F.nullif(F.array_join(parts, ""), w))

        return let(known(buckets, w), chosen)

    def treated(buckets: Column) -> Column:
        cut = F.transform(pieces, lambda piece, k: F.struct(
            F.split(piece, CAPITALISED, -1).alias("gaps"), F.regexp_extract_all(piece, F.lit(CAPITALISED), F.lit(0)).alias("words"), k.alias("place")))
        new = F.transform(cut, lambda s: F.struct(
            s.gaps.alias("gaps"), s.words.alias("words"), F.transform(s.words, lambda w, i: new_word(buckets, s, w, i)).alias("new")))
        return F.transform(new, lambda t: F.struct(
            _filled(t.gaps, F.zip_with(t.new, t.words, lambda n, w: F.coalesce(n, w))).alias("piece"),
            F.size(F.filter(t.new, lambda n: n.isNotNull())).alias("n")))

    return let(names_by_bucket(names, text), treated)


def formatted(hit: Column, kind: Column, found: Column) -> Column:
    """A detected string with its surrogates in place of its entities."""
    country = F.substring(_digits(hit), F.lit(1), F.length(_digits(hit)) - F.length(found[0]))
    digits = F.concat(country, found[0])
    refilled = F.aggregate(
        F.split(hit, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("n")),
        lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a.s, F.substring(digits, a.n, F.lit(1))).alias("s"), (a.n + 1).alias("n")))
        .otherwise(F.struct(F.concat(a.s, c).alias("s"), a.n.alias("n"))),
        lambda a: a.s,
    )
    title = F.regexp_extract(hit, f"^{TITLE}", 0)
    rest = F.substring(hit, F.length(title) + 1, F.length(hit))
    words = F.regexp_extract_all(rest, F.lit(NAME_WORD), F.lit(0))
    names = F.concat(title, _filled(F.split(rest, NAME_WORD, -1), F.zip_with(words, found, _named)))
    spaced = F.aggregate(
        F.split(hit, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("n")),
        lambda a, c: F.when(c == " ", F.struct(F.concat(a.s, c).alias("s"), a.n.alias("n")))
        .otherwise(F.struct(F.concat(a.s, F.substring(found[0], a.n, F.lit(1))).alias("s"), (a.n + 1).alias("n"))),
        lambda a: a.s,
    )
    loud = hit.rlike(r"\p{Lu}") & ~hit.rlike(r"\p{Ll}")
    return (
        F.when(kind.isin("phone", "card", "ssn"), refilled).when(kind.isin("mail", "address6"), F.when(loud, F.upper(found[0])).otherwise(found[0]))
        .when(kind == "iban", spaced)
        .when(kind == "secret", F.concat(F.regexp_extract(hit, f"^{SECRET}", 0), found[0])).when(kind == "person", names)
        .otherwise(found[0])
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with surrogates in their texts, and ``n_entities``, how many were put in."""
    names = [c for c in docs.columns if c != "n_entities"]
    own = {name: f"c{n}" for n, name in enumerate(names)}
    target = own[text]
    rows = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in own.items()])
    hits = F.regexp_extract_all(F.coalesce(F.col(target), F.lit("")), F.lit(ANY), F.lit(0))
    clean = rows.filter(F.size(hits) == 0).withColumn("n_entities", F.lit(0).cast("long"))
    dirty = written(rows.withColumn("hits", hits).filter(F.size("hits") > 0).withColumn("content", F.sha2(target, 256)), "entities")

    found = written(dirty.select(F.explode("hits").alias("hit")).distinct().withColumn("of", kind_of(F.col("hit"))), "hits")
    numbers = inside(found.filter("of is null")).select(
        "hit", F.regexp_extract_all("hit", F.col("pattern"), F.lit(0)).alias("inner"), F.split("hit", F.col("pattern"), -1).alias("between"))
    whole = found.filter("of is not null").select("hit", F.array("hit").alias("inner"), F.array(F.lit(""), F.lit("")).alias("between"))
    mentions = written(whole.unionByName(numbers).filter(F.size("inner") > 0), "mentions")
    inner = mentions.select(F.explode("inner").alias("entity")).distinct().withColumn("of", F.coalesce(kind_of(F.col("entity")), F.lit("card")))
    parts = written(inner.select("entity", "of", F.posexplode(parts_of(F.col("entity"), F.col("of"))).alias("pos", "part")).select(
        "entity", "of", "pos", "part.kind", "part.value", "part.word"), "parts")
    entities = written(parts.filter("kind is not null").select("kind", "value").distinct(), "distinct-entities")
    surrogate = resolved(entities, key)
    new = F.col("parts.surrogate")
    renamed = parts.join(surrogate, ["kind", "value"], "left").groupBy("entity", "of").agg(F.sort_array(F.collect_list(  # some eight words at most
        F.struct("pos", F.coalesce("surrogate", "word").alias("surrogate"), "kind", "word", "value"))).alias("parts")
    ).select("entity", formatted(F.col("entity"), F.col("of"), new).alias("new"), F.transform(
        F.filter("parts", lambda p: (F.col("of") == "person") & p.kind.isNotNull() & ~p.word.rlike(r"\.$")),
        lambda p: F.struct(F.length(p.word).alias("length"), p.word.alias("word"), p.value.alias("value"), p.surrogate.alias("surrogate"),
                           p.kind.startswith("given").alias("given"))).alias("names"))
    # One row per hit; only stretches of numbers hold more than one entity.
    replaced = mentions.select("hit", "between", F.posexplode("inner").alias("pos", "entity")).join(renamed, "entity").groupBy("hit").agg(
        F.first("between").alias("between"), F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("new"),
        F.first("names").alias("names"),
    ).select("hit", _filled(F.col("between"), F.col("new.new")).alias("new"), F.size("new").alias("n"), "names")

    texts = dirty.groupBy("content").agg(F.first("hits").alias("hits"))
    placed = texts.select("content", F.posexplode("hits").alias("pos", "hit")).join(replaced, "hit", "left").groupBy("content").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("new", "hit").alias("new")))).alias("placed"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_entities"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("names"))), asc=False).alias("names"),
    )
    # Names found with a title are replaced without one, too.
    between = F.split(target, ANY, -1)
    unnamed = F.transform(between, lambda piece: F.struct(piece.alias("piece"), F.lit(0).alias("n")))
    joined = dirty.join(placed, "content").withColumn(
        "between", F.when(F.size("names") == 0, unnamed).otherwise(bare(between, F.col("names"), F.col(target))))
    treated = joined.withColumn(target, _filled(F.col("between.piece"), F.col("placed.new"))).withColumn(
        "n_entities", F.col("n_entities") + F.aggregate("between.n", F.lit(0), lambda a, n: a + n)).select(*own.values(), "n_entities")
    return clean.unionByName(treated).select(*[F.col(c).alias(n) for n, c in own.items()], "n_entities")


def digest(docs: DataFrame) -> DataFrame:
    return pseudonymised(docs, DEMONSTRATION_KEY).select("doc_id", "text", "n_entities")
