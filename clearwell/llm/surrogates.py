"""Surrogates for personal data, in DataFrame functions only.

Detected entities (mail addresses, phone numbers, payment cards, network addresses, titled names) get replacements of
the same type. A replacement is made from a keyed hash of the entity, the same in every document, so references stay
together; it keeps the format (digits for digits, punctuation in place, a valid check digit on a card that had one) and, for
names, gender, script (Latin, Cyrillic or Greek) and number of words, each word by its own hash. Distinct entities keep distinct surrogates: clashes, with each other or with an
entity that occurs, are drawn again with the next attempt until none is left.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwell.llm.blocks import stored

# Loops over groups are possessive: the engine runs these step by step, and others by one call inside the other, which a junk
# text of many repetitions would end. No loop takes what the rest of its pattern needs. A mail or a row of titles is tried where it
# begins (or where the last entity ended), not once more from each of its letters or titles.
_L = r"\p{L}\p{M}'’\-"
#: Titles by gender, of several languages and scripts.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Госпожа")
MALE_TITLES = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин")
OPEN_TITLES = ("Dr", "Prof")

_SPACE = r"[ \u00A0]"
_TITLE = rf"(?:{'|'.join(FEMALE_TITLES + MALE_TITLES + OPEN_TITLES)})"
#: The titles before a name. "Don" is a title behind a Spanish one only; behind others it is a name.
_TITLES = (rf"(?:(?:Señor|Sr)\.?{_SPACE}Don|{_TITLE})\.?{_SPACE}"
           rf"(?:(?:{'|'.join(t for t in FEMALE_TITLES + MALE_TITLES + OPEN_TITLES if t != 'Don')})\.?{_SPACE})*+")
#: A word of a name, initials, and the small words that stand before one.
_WORD, _FULL, _INITIAL = rf"\p{{Lu}}[{_L}]*", rf"\p{{Lu}}[{_L}]+", r"\p{Lu}\.(?:-?\p{Lu}\.)*+"
_SMALL = rf"(?:(?:v[oa]n(?:{_SPACE}de[rnm])?|de|del|della|di|da|dos|du|la|le|bin|ibn|af|av){_SPACE})*+"
#: One full word at least, any number of further ones and initials, up to the next title.
_NAME = (rf"(?:{_INITIAL}{_SPACE}?|\p{{Lu}}{_SPACE})*+{_SMALL}{_FULL}"
         rf"(?:(?:{_SPACE}|(?<=\.)){_SMALL}(?!{_TITLE}\.?{_SPACE}\p{{Lu}})(?:\p{{Lu}}{_SPACE})*+(?:{_FULL}|{_INITIAL}))*+")

#: type, expression; where two match at one place, the first one counts.
PATTERNS = (
    ("mail", r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]++)++"),
    ("ip", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)"),
    ("phone", r"(?<![\w(])\(\d{3}\) ?\d{3}[.\-]\d{4}(?!\d)"),
    ("phone", r"(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"),
    ("national", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    ("card", r"(?<![\w.\-])\d{4}([ \-]?)\d{4}\1\d{4}\1\d{4}(?![\w\-])"),
    ("card", r"(?<![\w.\-])3[47]\d{13}(?![\w\-])"),
    ("account", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("name", rf"(?<![{_L}])(?<!(?<![{_L}]){_TITLE}\.?{_SPACE}){_TITLES}{_NAME}"),
)


def _plain(pattern: str, group: int) -> str:
    """A backward reference is counted from the group that it stands in once all patterns are one expression."""
    return pattern.replace(r"([ \-]?)", rf"(?<sep{group}>[ \-]?)").replace(r"\1", rf"\k<sep{group}>")


ANY = "|".join(f"(?:{_plain(p, i)})" for i, (_, p) in enumerate(PATTERNS))
#: A text without any of these holds no entity, which spares most texts the full expression.
HINT = rf"@|\d{{3}}|\d\.\d|\+\d|[A-Z]{{2}}\d{{2}}|{_TITLE}\.?{_SPACE}"

#: Syllables of invented names by script: beginnings, then endings by gender.
_LATIN = (("Al", "Bel", "Cor", "Dan", "El", "Fer", "Gil", "Hal", "Ing", "Jor", "Kal", "Lor", "Mar", "Nor", "Or", "Per"),
          ("ba", "de", "ga", "li", "mo", "na", "re", "so", "ta", "vi", "lo", "me", "ni", "ra", "se", "to"),
          ("ina", "ella", "etta", "anna"), ("us", "ert", "old", "ian"), ("er", "man", "sen", "ard"))
_CYRILLIC = (("Ал", "Бел", "Вер", "Дан", "Ел", "Жар", "Зор", "Иг", "Кир", "Лад", "Мар", "Ник", "Ол", "Пав", "Рад", "Сав"),
             ("ба", "ве", "га", "ли", "мо", "на", "ре", "со", "та", "ви", "ло", "ме", "ни", "ра", "се", "то"),
             ("ина", "ана", "елла", "ета"), ("ан", "ор", "ен", "ир"), ("ов", "ев", "ин", "ский"))
_GREEK = (("Αλ", "Βελ", "Γορ", "Δαν", "Ελ", "Ζαν", "Θεο", "Ιαν", "Καλ", "Λορ", "Μαρ", "Νικ", "Ορ", "Περ", "Ραλ", "Σολ"),
          ("βα", "δε", "γα", "λι", "μο", "να", "ρε", "σο", "τα", "βι", "λο", "με", "νι", "ρα", "σε", "το"),
          ("ίνα", "έλλα", "άννα", "έτα"), ("ος", "ης", "ας", "ων"), ("άκης", "ίδης", "άτος", "έας"))
#: Alphabets of initials.
_ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def find_entities(text: Column) -> Column:
    """All entities of a text as they stand there, in order, leftmost and without overlap."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(HINT)), found).otherwise(F.array().cast("array<string>"))


def entity_type(value: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(F.regexp_like(value, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return out


def _normal(kind: Column, value: Column) -> Column:
    """What two mentions must share to be one entity: case for mail, digits for numbers, the words behind the title for names."""
    return (F.when(kind == "mail", F.lower(value))
            .when(kind == "name", F.regexp_replace(F.regexp_replace(F.regexp_replace(value, f"^{_TITLES}", ""), _SPACE, " "), r"\.", ""))
            .when(kind.isin("phone", "card", "national"), F.regexp_replace(value, r"\D", ""))
            .when(kind == "account", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value))


def _hex(key: str, attempt: Column, *parts: Column, size: int = 64) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0001", F.lit(key), attempt.cast("string"), *parts), 256), 1, size)


def _pick(draw: Column, at: Column | int, options: tuple[str, ...]) -> Column:
    """One of 2^n options by the hexadecimal digit at ``at``."""
    digit = F.conv(F.substr(draw, F.lit(at) if isinstance(at, int) else at, F.lit(1)), 16, 10).cast("int") % len(options)
    return F.element_at(F.array(*map(F.lit, options)), digit + 1)


def _stream(key: str, attempt: Column, kind: Column, normal: Column) -> Column:
    """256 hexadecimal digits."""
    return F.concat(*(_hex(key, attempt, kind, normal, F.lit(str(i))) for i in range(4)))


def _shaped(value: Column, draw: Column) -> Column:
    """Each letter and digit of ``value`` is replaced by another of its kind; all else stays. The n-th character takes the n-th draw."""
    def one(pair: Column, i: Column) -> Column:
        c, n = pair, F.conv(F.substr(draw, F.pmod(i * 2, F.lit(254)) + 1, F.lit(2)), 16, 10).cast("int")
        digit = F.substr(F.lit("0123456789"), n % 10 + 1, F.lit(1))
        lower = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))
        return F.when(F.regexp_like(c, F.lit("^[0-9]$")), digit).when(F.regexp_like(c, F.lit("^[a-z]$")), lower).when(
            F.regexp_like(c, F.lit("^[A-Z]$")), F.upper(lower)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Sum of Luhn's digits, those at positions from the right with parity ``odd`` doubled."""
    chars = F.reverse(F.split(digits, ""))
    part = F.transform(chars, lambda c, i: F.when(
        i % 2 == odd, F.try_element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def valid_card(digits: Column) -> Column:
    return _luhn_sum(digits, 1) % 10 == 0


def _card(value: Column, draw: Column) -> Column:
    """The first digit stays (it tells the scheme); the last one is the check digit if the card had a valid one."""
    shaped = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(_shaped(value, draw), F.lit(2)))
    body = F.regexp_replace(F.substr(shaped, F.lit(1), F.length(shaped) - 1), r"\D", "")
    check = (10 - _luhn_sum(body, 0) % 10) % 10
    return F.when(valid_card(F.regexp_replace(value, r"\D", "")), F.concat(F.substr(shaped, F.lit(1), F.length(shaped) - 1), check.cast("string"))).otherwise(shaped)


def _ip(draw: Column) -> Column:
    byte = lambda i: (F.conv(F.substring(draw, 2 * i + 1, 2), 16, 10).cast("int") % 254 + 1).cast("string")
    return F.concat_ws(".", *(byte(i) for i in range(4)))


#: What stands before a word of a name in ``normal``: the gender of a given name (o: open), or s for a surname.
_ROLE = "^([fmos]) "


def _by_script(word: Column, one) -> Column:
    return F.when(F.regexp_like(word, F.lit(r"^\p{IsCyrillic}")), one(_CYRILLIC)).when(F.regexp_like(word, F.lit(r"^\p{IsGreek}")), one(_GREEK)).otherwise(one(_LATIN))


def _name(normal: Column, draw: Column) -> Column:
    """An invented word in the script of a word of a name, as its role asks."""
    role = F.regexp_extract(normal, _ROLE, 1)

    def word(s: tuple) -> Column:
        end = F.when(role == "f", _pick(draw, 4, s[2])).when(role == "m", _pick(draw, 4, s[3])).when(role == "o", _pick(draw, 4, s[3] + s[2])).otherwise(_pick(draw, 4, s[4]))
        return F.concat(_pick(draw, 1, s[0]), _pick(draw, 2, s[1]), _pick(draw, 3, s[1]), end)

    return _by_script(_plain_word(normal), word)


def _plain_word(normal: Column) -> Column:
    return F.regexp_replace(normal, _ROLE, "")


def _initial(key: str, letter: Column) -> Column:
    """Another letter of its alphabet, by a shift that depends on the key: distinct initials stay distinct. Null for other letters."""
    out = F.lit(None).cast("string")
    for letters in _ALPHABETS:
        shift = 1 + int(hashlib.sha256(f"{key}\u0001{letters}".encode()).hexdigest(), 16) % (len(letters) - 1)
        out = F.when(F.contains(F.lit(letters), letter), F.translate(letter, letters, letters[shift:] + letters[:shift])).otherwise(out)
    return out


def _name_words(names: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``names`` (mention, normal) to their heads (mention_key, mention, title, pieces) and their words (mention_key, pos, word, unit).

    The last full word is the surname, which is the same unit in all names. Other words are units by the gender that most
    of the mentions of their name show; ``unit`` is null for initials. Words carry a hash of the mention, which may be long.
    """
    title = F.regexp_extract("mention", f"^{_TITLES}", 0)
    rest = F.substr("mention", F.length("title") + 1)
    held = lambda titles: F.regexp_like("title", F.lit(rf"(?<![{_L}])(?:{'|'.join(titles)})(?![{_L}])")).cast("int")
    rows = names.select("mention", "normal").distinct().withColumn("title", title).withColumn("female", held(FEMALE_TITLES)).withColumn("male", held(MALE_TITLES))
    gender = rows.groupBy("normal").agg(F.sign(F.sum("female") - F.sum("male")).alias("g"))
    rows = rows.join(gender, "normal").withColumn("words", F.regexp_extract_all(rest, F.lit(_WORD), F.lit(0))).withColumn("pieces", F.split(rest, _WORD, -1))
    surname = F.array_max(F.transform("words", lambda w, i: F.when(F.length(w) > 1, i).otherwise(-1)))
    heads = stored(rows.select(F.md5("mention").alias("mention_key"), "mention", "title", "pieces", "words", "g", surname.alias("surname")), "name-heads")
    words = heads.select("mention_key", "g", "surname", F.posexplode("words").alias("pos", "word"))
    role = F.when(F.col("pos") == F.col("surname"), "s").when(F.col("g") > 0, "f").when(F.col("g") < 0, "m").otherwise("o")
    is_initial = (F.length("word") == 1) & _initial(key, F.col("word")).isNotNull()
    words = words.select("mention_key", "pos", "word", F.when(~is_initial, F.concat_ws(" ", role, "word")).alias("unit"))
    return heads.select("mention_key", "mention", "title", "pieces"), stored(words, "names")


def _surrogate(key: str) -> Column:
    """The surrogate of (kind, normal, value) in columns, at the column ``attempt``; for names that of one word."""
    kind, normal, value = F.col("kind"), F.col("normal"), F.col("value")
    draw = _stream(key, F.col("attempt"), kind, normal)
    host = F.regexp_extract(value, r"@[^.]+((?:\..+)?)$", 1)
    mail = F.concat(_shaped(F.substring_index(normal, "@", 1), draw), F.lit("@"), _shaped(F.regexp_extract(normal, r"@([^.]+)", 1), F.substr(draw, F.lit(101))), host)
    return (F.when(kind == "mail", mail).when(kind == "ip", _ip(draw)).when(kind == "card", _card(normal, draw))
            .when(kind == "name", _name(normal, draw)).when(kind == "account", F.concat(F.substr(normal, F.lit(1), F.lit(2)), F.substr(_shaped(normal, draw), F.lit(3))))
            .otherwise(_shaped(normal, draw)))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, surrogate) for distinct ``entities`` (kind, normal, value), stored.

    Each round draws for the entities that are still without a surrogate of their own. A draw is taken if no entity that
    occurs looks like it, nobody has it, and among those that drew it in this round it is the smallest. Rounds end when all
    have one. As the space of a format may be smaller than its entities, a draw longer than that runs on with a suffix from
    the ninth attempt on.
    """
    people = stored(entities, "entities")
    known = people.select("kind", F.when(F.col("kind") == "name", _plain_word(F.col("normal"))).otherwise(F.col("normal")).alias("surrogate")).distinct()
    done, left, attempt = None, people, 0
    while True:
        draw = _surrogate(key)
        if attempt > 8:
            extra = F.conv(_hex(key, F.col("attempt"), F.lit("more"), F.col("normal"), size=4 + attempt // 2), 16, 10)
            draw = F.when(F.col("kind").isin("phone", "national", "account", "card"), F.concat(draw, extra)).when(
                F.col("kind") == "mail", F.concat(extra, draw)).when(F.col("kind") == "name", F.concat(draw, _by_script(_plain_word(F.col("normal")), lambda s: _pick(_hex(key, F.col("attempt"), F.col("normal")), 5, s[1])))).otherwise(draw)
        drawn = stored(left.withColumn("attempt", F.lit(attempt)).select("kind", "normal", "value", draw.alias("surrogate")), "draws")
        # what the format looks like must differ as well: phone numbers and cards are compared by their digits
        first = drawn.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal"))
        free = first.join(known, ["kind", "surrogate"], "left_anti")
        taken = drawn.join(free, ["kind", "surrogate", "normal"], "left_semi")
        done = stored(taken if done is None else done.union(taken), "surrogates")
        known = known.union(taken.select("kind", "surrogate"))
        left = stored(drawn.join(free, ["kind", "surrogate", "normal"], "left_anti").drop("surrogate"), "clashes")
        attempt += 1
        if left.isEmpty():
            return done


def _dressed(kind: Column, mention: Column, surrogate: Column) -> Column:
    """A surrogate in the format of one mention: the mention's punctuation for numbers."""
    digits = F.split(surrogate, "")

    def put(acc: Column, c: Column) -> Column:
        is_own = F.regexp_like(c, F.lit("^[0-9A-Z]$"))
        return F.struct(F.when(is_own, F.concat(acc["s"], F.coalesce(F.try_element_at(digits, acc["n"] + 1), F.lit("")))).otherwise(F.concat(acc["s"], c)).alias("s"),
                        F.when(is_own, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    spaced = F.aggregate(F.split(mention, ""), zero, put, lambda a: F.concat(a["s"], F.array_join(F.slice(digits, a["n"] + 1, F.greatest(F.lit(0), F.size(digits) - a["n"])), "")))
    return F.when(kind.isin("phone", "card", "national", "account"), spaced).otherwise(surrogate)


_PARTS = "array<struct<word: string, rank: int, new: string>>"


def _mentioned_again(piece: Column, known: Column) -> Column:
    """A piece of text between entities, with the words of the text's names replaced where they stand alone, in the genitive as well."""
    word = rf"(?<![{_L}])\p{{Lu}}[{_L}]++"

    def one(w: Column) -> Column:
        bare = F.regexp_replace(w, "['’]s?$", "")
        return F.coalesce(F.try_element_at(known, w), F.concat(F.try_element_at(known, bare), F.substr(w, F.length(bare) + 1)), w)

    words = F.transform(F.regexp_extract_all(piece, F.lit(word), F.lit(0)), one)
    return F.array_join(F.zip_with(F.split(piece, word, -1), words, lambda p, w: F.concat(p, F.coalesce(w, F.lit("")))), "")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (doc_id, n_entities, kinds, text): every entity replaced by its surrogate.

    Names are found behind a title; where a full word of such a name stands again in the same text, it gets the same
    surrogate. ``n_entities`` counts the entities found, without such words.
    ``kinds`` are the distinct types found, sorted and comma-joined ("" if none). One row for each row; texts without
    entities come out as they were, null as null with 0 entities. Repeated rows and repeated doc_ids are told apart by a
    hash of the text, so rows alike come out alike. Other columns are ignored; an empty table gives an empty result.
    The same ``key`` gives the same surrogates for the same table. Jobs run when this is called.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.withColumn("found", find_entities(F.col("text")))
    some = stored(found.where(F.size("found") > 0).withColumn("text_key", F.md5("text")), "personal")
    # one mention of each text is enough: copies of a text share its map
    mentions = some.select("text_key", F.explode(F.array_distinct("found")).alias("mention")).distinct()
    mentions = mentions.withColumn("kind", entity_type(F.col("mention"))).withColumn("normal", _normal(F.col("kind"), F.col("mention")))
    mentions = stored(mentions, "mentions")
    others = mentions.where("kind <> 'name'")
    heads, name_words = _name_words(mentions.where("kind = 'name'"), key)
    entities = others.groupBy("kind", "normal").agg(F.min("mention").alias("value")).union(
        name_words.where("unit is not null").select(F.lit("name"), "unit", "word").distinct())
    table = surrogate_table(entities, key).select("kind", "normal", "surrogate")
    words = others.select("mention", "kind", "normal").distinct().join(table, ["kind", "normal"]).select(
        "mention", "kind", _dressed(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"), F.lit(None).cast(_PARTS).alias("parts"))
    told = name_words.join(table.where("kind = 'name'").select(F.col("normal").alias("unit"), "surrogate"), "unit", "left").withColumn(
        "new", F.coalesce("surrogate", _initial(key, F.col("word"))))
    # a surname goes before a given name where one word is both
    part = F.when(F.col("surrogate").isNotNull() & (F.length("word") > 1), F.struct("word", (~F.col("unit").startswith("s ")).cast("int").alias("rank"), F.col("surrogate").alias("new")))
    told = told.groupBy("mention_key").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("told"), F.collect_list(part).cast(_PARTS).alias("parts"))
    told = told.join(heads, "mention_key")
    name = F.array_join(F.zip_with("pieces", F.col("told.new"), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    words = words.union(told.select("mention", F.lit("name"), F.concat("title", name), "parts"))
    # a hot mention meets one row here; a text's map is as long as the text at most
    maps = mentions.select("text_key", "mention").join(words, "mention").groupBy("text_key").agg(
        F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("new"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"),
        F.sort_array(F.flatten(F.collect_list("parts"))).alias("parts"))
    first = F.filter("parts", lambda x, i: (i == 0) | (x["word"] != F.get("parts", i - 1)["word"]))
    maps = maps.withColumn("again", F.map_from_entries(F.transform(first, lambda x: F.struct(x["word"], x["new"])))).drop("parts")
    pieces = F.transform(F.split("text", ANY, -1), lambda p: F.when(F.size("again") > 0, _mentioned_again(p, F.col("again"))).otherwise(p))
    told = F.transform("found", lambda m: F.element_at(F.col("new"), m))
    text = F.array_join(F.zip_with(pieces, told, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    changed = some.join(maps, "text_key").select("doc_id", F.size("found").cast("long").alias("n_entities"), "kinds", text.alias("text"))
    same = found.where((F.size("found") == 0) | F.col("text").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"), "text")
    return changed.union(same)
