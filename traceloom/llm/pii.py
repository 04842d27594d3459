"""PII surrogates, in DataFrame operations only.

Detection: one pattern finds e-mail addresses, payment cards, IBANs, IPv4 and IPv6 addresses, social-security and phone
numbers, secrets (long hexadecimal strings and key-like tokens), names after titles and runs of capitalised words. A
mention's type is the first that fits. After one to four titles (as written in TITLES or in upper case) come up to four
capitalised words, with particles between them: the first two (or the only one) are one entity, the others are surnames of
their own, so "Dr Anna Maria Schmidt" leaves nothing in clear and "Frau Anna Schmidt" still is one person wherever she
stands. A pair of words in a run counts as a name if some text has it after a title. Not detected: names that never
follow a title, names in lower case, third words of untitled names, titles that are not in TITLES, postal addresses.
No part of the pattern recurs on a text's length (repeated groups are possessive or bounded), and what follows takes time
in proportion to a text's words and mentions, so lists of a hundred thousand names are a text like any other.

Entities: a type and the mention in its canonical form, so spellings corefer over all documents: e-mails in lower case,
IBANs without blanks, cards, social-security and phone numbers as digits (ten digits without `+` get country code 1),
hexadecimal strings and IPv6 addresses in lower case (of more than 128 digits: their SHA-256, and so 64 digits are put in
their place), names without title in lower case. A surname alone is an entity of its own.

Surrogates: a keyed hash (SHA-256 of key, type, entity and attempt) gives a stream from which each character of the
canonical form is replaced by one of its own kind: digits by digits, letters by letters of the same script (those of
SCRIPTS and UNCASED; any other script's letters by Latin ones), hexadecimal digits by hexadecimal digits; a phone's
country code (1, 7, or two digits), an IBAN's country, an e-mail's last label and a token's prefix stay. Addresses keep
octets in range; a card keeps its Luhn validity. Names are made of given names that match the gender of the entity's
titles and its script, and of surnames made from syllables. The surrogate is then written into each mention's own format:
its separators, upper case and title.

Collision checks: all entities are gathered once (distinct, partially aggregated); where two get one surrogate, or a
surrogate is itself some entity, all but one of them take their next attempt until no collision is left, so distinct
entities stay distinct and no surrogate names anyone who is in the data. From attempt GROWS on each attempt makes the
surrogate one syllable or character longer, so there are always enough of them, however few the shape itself has; after
ATTEMPTS attempts RuntimeError names the types. The entities are written to the shared folder between attempts and are
never on the driver.

Rewriting: the pattern runs once over all texts; rows are written with their mentions, and texts without any pass through
from there. For the others the list of mentions is the key of a table of surrogates, joined once; a hot list (many copies
of one text) has one row there, so its join can be split. Only texts with something to replace are cut at the pattern.

Defined results: null and empty texts are returned as they are with 0 replacements; rows keep their other columns and
order of columns, whatever their names; null ids and repeated rows are carried along; an empty table gives no rows. The
key has no default: who knows it can look for the surrogates of guessed entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

# Shapes of the entities. A mention's type is the first of these that matches it whole.
_LOCAL = r"[\p{L}\p{M}\p{N}._%+-]{1,64}"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}-]{0,62})"
TITLES = "Mr Mrs Ms Miss Mister Herr Frau Señor Señora Monsieur Madame Mme Dr Prof Господин Госпожа г-н г-жа".split()
PARTICLES = "von van vom zu zur de der den del della da di do dos du la le ten ter bin ibn al el фон де".split()
_ANY_TITLE = f"(?:{'|'.join(dict.fromkeys(x for t in TITLES for x in (t, t.upper())))})"
_TITLE = rf"{_ANY_TITLE}\.? {{1,2}}"
_TITLES = f"(?:{_TITLE}){{1,4}}+"
_TOKEN = r"(?:AKIA|ASIA)[A-Z0-9]{16}"
# A capitalised word that is no title, token or part of an address.
_WORD = rf"(?!{_TITLE})(?!{_TOKEN})\p{{Lu}}[\p{{L}}'-]{{1,30}}+(?![\p{{L}}\p{{N}}]|[\p{{L}}\p{{N}}._%+-]{{0,64}}+@)"
# A capitalised word after a title; the first or the first two of them with their particles.
_NAME = rf"(?!{_ANY_TITLE}(?!\p{{L}}))\p{{Lu}}[\p{{L}}'-]{{1,30}}+"
_MORE = rf"(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_NAME})"
_FIRST = rf"{_NAME}{_MORE}?"
SHAPES = {
    "email": rf"(?<![\p{{L}}\p{{M}}\p{{N}}._%+-]){_LOCAL}@{_LABEL}(?:\.{_LABEL}){{1,6}}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![\p{L}\p{N}])",
    "ipv4": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,38}[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|" + _TOKEN + r"|(?:sk|pk|ghp|gho|xoxb|xoxp)[_-][A-Za-z0-9_-]{16,128})(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLES}{_FIRST}{_MORE}{{0,2}}+",
    "run": rf"(?<![\p{{L}}\p{{N}}'-]){_WORD}(?: {_WORD})++",
}
PATTERN = "|".join(f"(?:{p})" for p in SHAPES.values())
# Titles by gender, and given names and syllables by gender and script.
FEMALE = "(?i)(?:^| )(?:Mrs|Ms|Miss|Frau|Señora|Madame|Mme|Госпожа|г-жа)(?!\\p{L})"
MALE = "(?i)(?:^| )(?:Mr|Mister|Herr|Señor|Monsieur|Господин|г-н)(?!\\p{L})"
GIVEN = {
    ("female", "latin"): "Alma Berta Clara Dora Edith Flora Greta Hilda Irma Julia Klara Laura Marta Nora Olga Paula Rosa Silvia Tilda Vera".split(),
    ("male", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oskar Paul Robert Simon Tomas Viktor".split(),
    ("any", "latin"): "Alex Chris Dana Eden Jamie Kim Logan Morgan Noel Robin Sam Terry".split(),
    ("female", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("male", "cyrillic"): "Антон Борис Глеб Иван Максим Павел Роман Юрий".split(),
    ("any", "cyrillic"): "Саша Женя Валя Шура".split(),
}
SYLLABLES = {
    "latin": "bel cor dan fel gar hol jen kel lor mar nor pel ras sel tor val wen zim bran dorn".split(),
    "cyrillic": "бел вар гор дан зим кол лев мор нов пет рам сав".split(),
}
SCRIPTS = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "accented": "àáâäçèéêëíîïñóôöùúûü", "Accented": "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "Greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "cyrillic": "абвгдежзийклмнопрстуфхцчшщ", "Cyrillic": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩ"}
# The same for scripts without case, by their names in patterns.
UNCASED = {
    "Han": "安白北成大东方高国海华建江金开李林明南平青仁山石天文西新阳永玉元月云中子", "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねの", "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノ", "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조호",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "Thai": "กขคงจชซดตถทธนบปผพฟมยรลวสหอ", "Devanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह",
}
DIGITS = "0123456789"
# Kinds of characters: pattern and letters, the first that fits. Letters of other scripts count as Latin ones.
KINDS = (
    (r"[0-9]", DIGITS), (r"[A-Z]", SCRIPTS["upper"]), (r"[a-z]", SCRIPTS["lower"]), (r"(?=\p{IsGreek})\p{Lu}", SCRIPTS["Greek"]), (r"(?=\p{IsGreek})\p{L}", SCRIPTS["greek"]), (r"(?=\p{IsCyrillic})\p{Lu}", SCRIPTS["Cyrillic"]), (r"(?=\p{IsCyrillic})\p{L}", SCRIPTS["cyrillic"]), (r"(?=\p{IsLatin})\p{Lu}", SCRIPTS["Accented"]), (r"(?=\p{IsLatin})\p{L}", SCRIPTS["accented"]),
    *((rf"(?=\p{{Is{name}}})\p{{L}}", letters) for name, letters in UNCASED.items()), (r"\p{Lu}", SCRIPTS["upper"]), (r"\p{L}", SCRIPTS["lower"]), (r"\p{N}", DIGITS),
)
HEXADECIMAL = ((r"[0-9a-f]", DIGITS + "abcdef"),)
GROWS = 3  # the first attempt that makes surrogates longer
ATTEMPTS = 64


def type_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, shape in reversed(SHAPES.items()):
        out = F.when(mention.rlike(f"^(?:{shape})$"), F.lit(name)).otherwise(out)
    return out


def mentions_of(text: Column) -> Column:
    """Every mention in a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _number(stream: Column, at: Column) -> Column:
    """A 16-bit number of a hexadecimal stream of 64 digits; positions beyond it are mixed with their lap."""
    piece = F.substring(stream, (at * 4) % 61 + 1, F.lit(4))
    return F.conv(piece, 16, 10).cast("int") + at * 7 + F.floor(at * 4 / 61).cast("int") * 131


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _pick(letters: Column, number: Column) -> Column:
    return F.substring(letters, F.pmod(number, F.length(letters)).cast("int") + 1, F.lit(1))


def _first(kinds, c: Column) -> Column:
    """The letters of the first kind whose pattern fits a character; empty if none does."""
    out = F
    for pattern, letters in kinds:
        out = out.when(c.rlike(pattern), F.lit(letters))
    return out.otherwise(F.lit(""))


def _replaced(text: Column, stream: Column, keep: Column, hexadecimal: Column) -> Column:
    """text with every character after the first `keep` replaced by one of its own kind."""

    def one(c: Column, i: Column) -> Column:
        letters = F.when(i < keep, F.lit("")).when(hexadecimal, _first(HEXADECIMAL, c)).otherwise(_first(KINDS, c))
        return _let(letters, lambda x: F.when(x == "", c).otherwise(_pick(x, _number(stream, i))))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def entity_of(mention: Column, kind: Column) -> Column:
    """The canonical form of a mention."""
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(mention)).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.when(mention.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits)))
        .when(kind == "secret", F.when(_hexadecimal(mention), F.when(F.length(mention) > 128, F.sha2(F.lower(mention), 256)).otherwise(F.lower(mention))).otherwise(mention))
        .when(kind.isin("name", "ipv6"), F.lower(mention)).otherwise(mention)
    )


def _hexadecimal(secret: Column) -> Column:
    return secret.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$")


def surrogate(kind: Column, entity: Column, gender: Column, attempt: Column, key: str) -> Column:
    """(base, extra) of an entity at its attempt: its canonical surrogate and what a later attempt adds to it."""
    stream = F.sha2(F.concat_ws("\0", F.lit(key), kind, entity, attempt.cast("string")), 256)
    return _let(stream, lambda x: _made(kind, entity, gender, attempt, x))


def _made(kind: Column, entity: Column, gender: Column, attempt: Column, stream: Column) -> Column:
    none = F.lit(0)
    longer = F.greatest(attempt - (GROWS - 1), none)
    grown = lambda unit: F.array_join(F.transform(F.sequence(none, longer), lambda k: F.when(k > 0, unit(_number(stream, k * 2 + 9))).otherwise("")), "")
    octet = lambda k: F.pmod(F.conv(F.substring(stream, 8 * k + 1, 4), 16, 10).cast("int"), F.lit(254)) + 1
    # An address has no room for digits within its octets, so they follow it as a port does.
    digits = grown(lambda n: _pick(F.lit(DIGITS), n))
    ipv4 = F.concat_ws(".", *[octet(k).cast("string") for k in range(4)])

    def card(body: Column) -> Column:
        # The last digit of a card is the first of ten, from a keyed start, that gives the entity's Luhn validity.
        ends = F.transform(F.array(*map(F.lit, range(10))), lambda d: F.concat(F.left(body, F.length(body) - 1), F.pmod(_number(stream, F.lit(17)) + d, F.lit(10)).cast("string")))
        return F.element_at(F.filter(ends, lambda x: F.call_function("luhn_check", x) == F.call_function("luhn_check", entity)), 1)

    hexadecimal = (kind == "ipv6") | (kind == "secret") & _hexadecimal(entity)
    tail = F.when(kind == "email", F.regexp_extract(entity, r"\.[^.]+$", 0)).otherwise("")
    prefix = F.length(F.regexp_extract(entity, "^(?:AKIA|ASIA|[a-z]+[_-])", 0))
    keep = F.when(kind == "iban", 2).when(kind == "phone", F.when(entity.rlike("^[17]"), 1).otherwise(2)).when((kind == "secret") & ~hexadecimal, prefix).otherwise(none)
    replaced = _let(keep, lambda k: _let(hexadecimal, lambda h: _replaced(F.left(entity, F.length(entity) - F.length(tail)), stream, k, h)))

    def named(script: str) -> Column:
        at = lambda k: _number(stream, F.lit(k))
        pick = lambda words, n: F.element_at(F.array(*[F.lit(w.lower()) for w in words]), F.pmod(n, F.lit(len(words))).cast("int") + 1)
        first = F.when(gender == "female", pick(GIVEN["female", script], at(1))).when(gender == "male", pick(GIVEN["male", script], at(1))).otherwise(pick(GIVEN["any", script], at(1)))
        last = F.concat(*[pick(SYLLABLES[script], at(k)) for k in (3, 5, 7, 9)], grown(lambda n: pick(SYLLABLES[script], n)))
        return F.when(entity.contains(" "), F.concat(first, F.lit(" "), last)).otherwise(last)

    name = F.when(entity.rlike(r"\p{IsCyrillic}"), named("cyrillic")).otherwise(named("latin"))
    other = _let(replaced, lambda body: F.when(kind == "card", card(body)).otherwise(F.concat(body, tail)))
    base = F.when(kind == "ipv4", ipv4).when(kind == "name", name).otherwise(other)
    extra = F.when(kind == "email", grown(lambda n: _pick(F.lit(SCRIPTS["lower"]), n))).when(kind == "name", "").when((kind == "ipv4") & (longer > 0), F.concat(F.lit(":"), digits)).otherwise(digits)
    return F.struct(base.alias("base"), extra.alias("extra"))


def _whole(kind: Column, made: Column) -> Column:
    """The canonical surrogate with its addition, which stands before an e-mail and after anything else."""
    return F.when(kind == "email", F.concat(made["extra"], made["base"])).otherwise(F.concat(made["base"], made["extra"]))


def render(mention: Column, kind: Column, made: Column) -> Column:
    """A surrogate (base, extra) in the format of a mention."""
    base = made["base"]
    upper = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    cased = lambda m, c: F.when(upper(m), F.upper(c)).otherwise(c)
    aligned = F.array_join(F.zip_with(F.split(mention, ""), F.split(base, ""), lambda m, c: F.coalesce(cased(m, c), F.lit(""))), "")

    def spaced(chars: Column) -> Column:
        # The mention's letters and digits are the last ones of the canonical form.
        places = F.filter(F.transform(chars, lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), i)), lambda i: i.isNotNull())
        at = lambda i: F.length(base) - F.size(places) + F.array_position(places, i).cast("int")
        return F.array_join(F.transform(chars, lambda c, i: F.when(F.array_contains(places, i), F.substring(base, at(i), F.lit(1))).otherwise(c)), "")

    name = F.when(mention == F.upper(mention), F.upper(base)).otherwise(F.initcap(base))
    body = F.when(kind == "name", name).when(kind == "ipv4", base).when(kind.isin("email", "secret", "ipv6"), aligned).otherwise(_let(F.split(mention, ""), spaced))
    return _whole(kind, F.struct(body.alias("base"), made["extra"].alias("extra")))


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, entity, base, extra) from rows (kind, entity, gender): canonical surrogates that do not collide.

    They are compared in lower case over all kinds.
    """
    made = lambda df: df.withColumn("made", surrogate(F.col("kind"), F.col("entity"), F.col("gender"), F.col("attempt"), key))
    now = materialize(made(entities.withColumn("attempt", F.lit(0))), "entities")
    for _ in range(ATTEMPTS):
        shown = now.withColumn("whole", F.lower(_whole(F.col("kind"), F.col("made"))))
        held = shown.groupBy("whole").agg(F.min(F.struct("kind", "entity")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        taken = now.select(F.lower("entity").alias("whole")).distinct().withColumn("taken", F.lit(True))
        bad = held.join(taken, "whole", "left").where("n > 1 OR taken")
        moved = shown.join(bad, "whole").where(F.coalesce("taken", F.lit(False)) | (F.struct("kind", "entity") != F.col("keeper"))).select("kind", "entity").withColumn("moves", F.lit(True))
        moved = materialize(moved, "moved")
        if moved.isEmpty():
            drop_table(moved)
            return now.select("kind", "entity", "made")
        both = now.join(moved, ["kind", "entity"], "left")
        stay = both.where("moves IS NULL").drop("moves")
        after = materialize(stay.unionByName(made(both.where("moves").drop("moves", "made").withColumn("attempt", F.col("attempt") + 1))), "entities")
        drop_table(now)
        drop_table(moved)
        now = after
    raise RuntimeError(f"no free surrogates after {ATTEMPTS} attempts for {[r[0] for r in now.where(F.col('attempt') == ATTEMPTS).select('kind').distinct().collect()]}")


def _rewritten(mention: Column, chosen: Column) -> Column:
    """A mention with some of its words replaced; chosen: sorted array of (first word, number of words, what to show)."""

    def segments(w: Column, c: Column) -> Column:
        end = lambda k: F.when(k < 0, F.lit(0)).otherwise(F.get(c, k)["i"] + F.get(c, k)["words"])
        kept = lambda start, stop: F.slice(w, start + 1, stop - start)
        parts = F.transform(c, lambda x, k: F.array_join(F.concat(kept(end(k - 1), x["i"]), F.array(x["shown"])), " "))
        return F.array_join(F.concat(parts, kept(end(F.size(c) - 1), F.size(w))), " ")

    return _let(F.split(mention, " "), lambda w: _let(chosen, lambda c: segments(w, c)))


def _parts(each: DataFrame) -> DataFrame:
    """Rows (list, at, i, words, mention, title, kind, entity) of what a mention may hold: itself, the parts of a name, or
    all pairs of a run's words; i is the number of the first word."""
    part = lambda i, words, mention, title: F.struct(i.cast("int").alias("i"), words.cast("int").alias("words"), mention.alias("mention"), title.alias("title"))
    count = lambda c: F.size(F.split(c, " "))
    mention, none = F.col("mention"), F.lit(None).cast("string")
    title = F.regexp_extract(mention, f"^{_TITLES}", 0)
    first = F.regexp_extract(F.substring(mention, F.length(title) + 1, F.length(mention)), f"^{_FIRST}", 0)

    def named(t: Column, f: Column) -> Column:
        before = count(t) - 1
        rest = F.slice(F.split(mention, " "), before + count(f) + 1, F.lit(16))
        others = F.filter(F.transform(rest, lambda x, k: part(before + count(f) + k, F.lit(1), x, none)), lambda x: x["mention"].rlike(r"^\p{Lu}"))
        return F.concat(F.array(part(before, count(f), f, t)), others)

    pairs = _let(F.split(mention, " "), lambda w: F.transform(F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("a"), F.slice(w, F.lit(2), F.size(w) - 1).alias("b")), lambda x, k: part(k, F.lit(2), F.concat_ws(" ", x["a"], x["b"]), none)))
    found = F.when(F.col("kind") == "name", _let(title, lambda t: _let(first, lambda f: named(t, f)))).when(F.col("kind") == "run", pairs).otherwise(F.array(part(F.lit(0), F.lit(1), mention, none)))
    rows = each.select("list", "at", "kind", F.explode(found).alias("p"))
    return rows.select("list", "at", "p.*", "kind", F.when(F.col("kind") == "run", F.lower("p.mention")).otherwise(entity_of(F.col("p.mention"), F.col("kind"))).alias("entity"))


def replace_entities(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """df with surrogates in its texts; count_col, if given, is a further column with the number of replacements."""
    if not key:
        raise ValueError("a secret key is needed")
    text, columns = F.col(f"`{text_col}`"), df.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col]).alias("row") if len(columns) > 1 else F.lit(True).alias("row")
    rows = materialize(df.select(row, text.alias("text"), mentions_of(text).alias("mentions")), "mentions")
    found = F.coalesce(F.size("mentions") > 0, F.lit(False))
    hits = rows.where(found).withColumn("list", F.sha2(F.to_json("mentions"), 256))
    lists = hits.select("list", "mentions").dropDuplicates(["list"])
    each = materialize(lists.select("list", F.posexplode("mentions").alias("at", "mention")).withColumn("kind", type_of(F.col("mention"))), "each")
    parts = _parts(each)
    female, male = (F.coalesce(F.max(F.col("title").rlike(p)), F.lit(False)) for p in (FEMALE, MALE))
    gender = F.when(female & ~male, "female").when(male & ~female, "male").otherwise("any")
    made = resolve(parts.where("kind <> 'run'").groupBy("kind", "entity").agg(gender.alias("gender")), key)
    in_run = F.col("kind") == "run"
    of = parts.withColumn("in_run", in_run).withColumn("kind", F.when(in_run, "name").otherwise(F.col("kind")))
    shown = of.join(made, ["kind", "entity"]).select("list", "at", "i", "words", "in_run", render(F.col("mention"), F.col("kind"), F.col("made")).alias("shown"))
    # Of pairs of a run that overlap, the first counts, then the next that does not overlap it, and so on.
    by_run = Window.partitionBy("list", "at").orderBy("i")
    runs = shown.where("in_run").withColumn("before", F.lag("i").over(by_run)).withColumn("chain", F.max(F.when(F.col("before").isNull() | (F.col("before") != F.col("i") - 1), F.col("i"))).over(by_run))
    kept = shown.where("NOT in_run").unionByName(runs.where((F.col("i") - F.col("chain")) % 2 == 0).drop("before", "chain"))
    chosen = kept.groupBy("list", "at").agg(F.array_sort(F.collect_list(F.struct("i", "words", "shown"))).alias("chosen"))
    simple = ~F.col("kind").isin("name", "run")
    text_of = F.when(F.col("chosen").isNull(), F.col("mention")).when(simple, F.col("chosen")[0]["shown"]).otherwise(_rewritten(F.col("mention"), F.col("chosen")))
    swap = F.struct("at", text_of.alias("made"), F.coalesce(F.size("chosen"), F.lit(0)).alias("n"))
    swaps = each.join(chosen, ["list", "at"], "left").groupBy("list").agg(F.array_sort(F.collect_list(swap)).alias("swaps"))
    swaps = swaps.select("list", F.transform("swaps", lambda x: x["made"]).alias("swaps"), F.aggregate("swaps", F.lit(0), lambda a, x: a + F.greatest(x["n"], F.lit(0))).alias("n")).where("n > 0")
    joined = hits.join(materialize(swaps, "swaps"), "list", "left")
    pieces = F.zip_with(F.split("text", PATTERN, -1), F.col("swaps"), lambda p, x: F.concat(p, F.coalesce(x, F.lit(""))))
    changed = joined.select("row", F.when(F.col("swaps").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"), F.coalesce("n", F.lit(0)).alias("n"))
    both = changed.unionByName(rows.where(~found).select("row", "text", F.lit(0).alias("n")))
    out = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns]
    return both.select(*out, *([F.col("n").alias(count_col)] if count_col else []))
