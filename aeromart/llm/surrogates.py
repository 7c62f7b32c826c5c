"""Surrogates for personal data, in DataFrame functions only.

Detected entities (e-mail addresses, IP addresses of version 4 and 6, card,
phone, bank account (IBAN) and social security numbers, secrets, titled
person names) are replaced by keyed surrogates of the same type:

* digits stay digits, letters stay letters of the same case and script (e-mail
  addresses may be Latin, Cyrillic or Greek) and all punctuation stays where
  it is; IP addresses stay valid; a card number that passes the Luhn test and
  an IBAN whose check digits are right get one that does.  What looks like an
  IBAN, but has wrong check digits and no card number in it, stays.  A phone
  number's leading 0 stays;
* names keep their title, number of words, hyphens and apostrophes, capitals,
  script (Latin, Cyrillic, Greek, and letter by letter Hangul, Han, kana,
  Arabic, Hebrew, Devanagari and Thai) and, in given names of the first three,
  the gender that the title shows.  Titles count as listed, in capitals before
  a name in capitals, and a few in small letters;
* coreference: a surrogate hangs on the key and the entity's canonical form
  (digits alone, e-mail addresses in lower case, names word by word), so
  every mention of an entity gets the same one, poured into the format of
  that mention.  Once a text names a person with a title, later mentions
  without it (the whole name, or one of its words) are that person's too;
* distinctness: after each round of assignment the surrogates are checked
  globally.  Where several entities of a type drew the same one, or it is
  itself an entity of the corpus, all but the smallest entity (or all)
  draw again;
* no end of forms: from draw ``FORM_DRAWS`` on each draw has a longer form
  than the last (a name one more syllable, an e-mail address one more letter
  in front, numbers and secrets one more digit at the end, an IP address is
  a private one of version 6), so there is one for every entity however
  many a corpus holds.

Texts are cut at the entities by one pattern, and the pieces are joined
again around the surrogates, so all else stays as it is.  Null texts stay
null, empty texts empty; rows repeat as they did; other columns pass
through (``n_entities`` is replaced if it is there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeromart.llm.common import stored

# Titles that show a gender, as written before a name.
MALE_TITLES = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин", "κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа", "κυρία"]
OTHER_TITLES = ["Dr", "Prof", "Mx"]
SMALL_TITLES = ["mr", "mrs", "dr", "prof"]  # not words of their own in small letters

_LISTED = MALE_TITLES + FEMALE_TITLES + OTHER_TITLES
_TITLE = "|".join(_LISTED + SMALL_TITLES)
_CAPITAL_TITLE = "|".join(x.upper() for x in _LISTED)
_TITLES = "|".join([_TITLE, _CAPITAL_TITLE])
# a word of a name: letters, with parts of two letters or more behind hyphens and apostrophes (no 's)
_JOINT = "['’-]"
_PART = rf"(?:{_JOINT}[\p{{L}}\p{{M}}]{{2,}}+)"
_WORD = rf"\p{{Lu}}(?:[\p{{L}}\p{{M}}]++{_PART}*+|{_PART}++)"
_CAPITALS = rf"\p{{Lu}}(?:\p{{Lu}}++(?:{_JOINT}\p{{Lu}}{{2,}}+)*+|(?:{_JOINT}\p{{Lu}}{{2,}}+)++)(?!\p{{Ll}})"
# scripts without case: two words where names are written in words, else one
_SPACED = r"[\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}&&[\p{L}\p{M}]]{2,}+"
_CASELESS = rf"{_SPACED}(?: {_SPACED})?|\p{{Lo}}[\p{{Lo}}\p{{M}}]++"
_HEX = "[0-9A-Fa-f]{1,4}"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"  # Latin, Greek and Cyrillic as ranges, which are tested faster than scripts
_MAIL = _LETTERS + "0-9"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": rf"(?<![{_MAIL}._%+-])[{_MAIL}._%+-]++@(?:[{_MAIL}-]+\.)+[{_LETTERS}]{{2,}}",
    "secret": r"(?<![A-Za-z0-9])(?:[A-Fa-f0-9]{32,}+|(?:AKIA|ghp_|sk-)[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": rf"(?<![0-9A-Za-z_:.])(?=[A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z_:])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![\d-])"
    # national forms behind a leading 0 (or 8 before an area in brackets)
    r"|(?<![\d.,:/+-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4}(?![\d-])|(?<![\d.,:/+-])0\d(?: \d{2}){4}(?![\d-])"
    r"|(?<![\d+])(?:8[ -]?)?\(\d{3,5}\)[ -]?\d{2,3}-\d{2}-\d{2}(?!\d)",
    "card": r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)",
    "person": rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? (?:{_WORD}(?: {_WORD})?|{_CASELESS})|(?:{_CAPITAL_TITLE})\.? {_CAPITALS}(?: {_CAPITALS})?)",
}
# where none of them starts: inside a word, at a space or a stop
_NOWHERE = r"(?!(?<=[A-Za-z])[A-Za-z]|(?<=[а-яё])[а-яё]|[\s,;:!?\"'<>=])"
PATTERN = f"({_NOWHERE}(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + "))"
NUMBER_TYPES = ("ssn", "phone", "card")
FORM_DRAWS = 8  # draws of the entity's own form
LEAST_NAME = 3  # letters of a name that is looked for without its title; two in scripts without case
# Letters of scripts without case, and where blocks of them start and how many are used.
LETTERS = {
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "Arabic": "بتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Hebrew": "אבגדהוזחטילמנסעפצקרשת",
    "Devanagari": "कखगघचछजटडतदनपबमयरलवशसह",
    "Thai": "กขคงจชดตถทนบปพมยรลวสห",
}
BLOCKS = {"Hangul": (0xAC00, 11172), "Han": (0x4E00, 20902)}


def _type_of(mention: Column) -> Column:
    out = None
    for name, pattern in PATTERNS.items():
        fits = mention.rlike(f"^(?:{pattern})$")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("person")


def _iban_rest(digits: str) -> str:
    """SQL: the account number ``digits`` (country and check digits in front)
    as a number, modulo 97."""
    return f"""aggregate(split(concat(substr({digits}, 5), substr({digits}, 1, 4)), ''), 0L, (s, c) ->
        if(c = '', s, if(c rlike '[0-9]', (s * 10 + ascii(c) - 48) % 97, (s * 100 + ascii(c) - 55) % 97)))"""


def _is_entity(mention: Column) -> Column:
    """Not a code that only looks like an account number."""
    looks = mention.rlike(f"^(?:{PATTERNS['iban']})$") & ~mention.rlike(f"^(?:{PATTERNS['secret']})$")
    sound = F.expr(f"{_iban_rest("replace(mention, ' ', '')")} = 1") | mention.rlike(r"(?:\d ?){12,18}\d$")
    return ~looks | sound


def _mention_units(mentions: DataFrame) -> DataFrame:
    """Distinct mentions (column mention) cut into the units that get a
    surrogate: each name word by itself, any other mention whole."""
    name = F.regexp_extract("mention", rf"^(?:{_TITLES})\.? (.*)$", 1)
    title = F.lower(F.regexp_extract("mention", rf"^({_TITLES})\.? ", 1))
    person = F.col("type") == "person"
    gender = F.when(title.isin([x.lower() for x in MALE_TITLES]), "male").when(title.isin([x.lower() for x in FEMALE_TITLES]), "female").otherwise("any")
    units = (
        mentions.withColumn("type", _type_of(F.col("mention")))
        .withColumn("name", name)
        .withColumn("head", F.when(person, F.expr("substr(mention, 1, length(mention) - length(name))")).otherwise(""))
        .withColumn("gender", gender)
        .select("mention", "type", "head", "gender", F.posexplode(F.when(person, F.split("name", " ")).otherwise(F.array("mention"))).alias("at", "raw"), F.size(F.split("name", " ")).alias("words"))
    )
    last = F.col("at") == F.col("words") - 1
    kind = F.when(~person, F.col("type")).when(last, "family").otherwise(F.concat(F.lit("given-"), "gender"))
    canonical = (
        F.when(F.col("type").isin(*NUMBER_TYPES), F.regexp_replace("raw", r"\D", ""))
        .when(F.col("type").isin("email", "person", "ip6"), F.lower("raw"))
        .when(F.col("type") == "iban", F.regexp_replace("raw", " ", ""))
        .otherwise(F.col("raw"))
    )
    return units.select("mention", "head", "at", "raw", kind.alias("kind"), canonical.alias("entity"))


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """Add ``surrogate``: the draw number ``attempt`` of each (kind, entity)."""
    more = F.greatest(F.lit(0), F.col("attempt") - F.lit(FORM_DRAWS - 1)).cast("int")
    entities = entities.withColumn("more", more).withColumn(
        "grown", F.expr("case when kind = 'email' then concat(repeat('a', more), entity) when kind in ('ssn', 'phone', 'card', 'secret', 'iban') then concat(entity, repeat('0', more)) else entity end")
    )
    block = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("grown") + 1) * (F.col("more") + 3) / 16).cast("int")),
        lambda n: F.sha2(F.concat_ws("\u0001", F.lit(key), F.col("kind"), F.col("entity"), F.col("attempt").cast("string"), n.cast("string")), 256),
    )
    rows = entities.withColumn("stream", F.array_join(block, ""))
    number = "cast(conv(substr(stream, 4 * i - 3, 4), 16, 10) as int)"
    char = "substr(grown, i, 1)"
    # a character of the same sort at each place
    sort_kept = f"""
        array_join(transform(sequence(1, length(grown)), i -> case
            when kind = 'ip6' and {char} <> ':' then substr('123456789abcdef', 1 + {number} % 15, 1)
            when kind = 'phone' and i = 1 and {char} = '0' then '0'
            when {char} rlike '[0-9]' then cast({number} % 10 as string)
            when kind = 'secret' and {char} rlike '[a-f]' and entity rlike '^[0-9A-Fa-f]+$' then substr('abcdef', 1 + {number} % 6, 1)
            when kind = 'secret' and {char} rlike '[A-F]' and entity rlike '^[0-9A-Fa-f]+$' then substr('ABCDEF', 1 + {number} % 6, 1)
            when {char} rlike '[a-z]' then char(97 + {number} % 26)
            when {char} rlike '[A-Z]' then char(65 + {number} % 26)
            when {char} rlike '\\\\p{{IsCyrillic}}' then substr('абвгдежзиклмнопрстуфхцчш', 1 + {number} % 24, 1)
            when {char} rlike '\\\\p{{IsGreek}}' then substr('αβγδεζηθικλμνξοπρστυφχψω', 1 + {number} % 24, 1)
            when {char} rlike '\\\\p{{IsLatin}}' then char(97 + {number} % 26)
            else {char} end), '')"""
    octets = f"""if(more = 0, if(kind = 'ip6', kept, array_join(transform(sequence(1, 4), i -> cast(1 + {number} % 254 as string)), '.')),
        concat('fd', substr(stream, 1, 2), ':', array_join(transform(sequence(2, 8), i -> substr(stream, 4 * i - 3, 4)), ':')))"""

    def luhn(digits: str) -> str:
        # doubled at every second place from the right
        return f"""aggregate(transform(sequence(1, length({digits})), i ->
            cast(substr({digits}, length({digits}) + 1 - i, 1) as int) * (1 + (i + 1) % 2)), 0, (s, d) -> s + d - if(d > 9, 9, 0)) % 10"""

    without_check = "concat(substr(kept, 1, length(kept) - 1), '0')"

    # names: syllables of the entity's script, with an ending for the gender
    scripts = {"latin": ("bdfgklmnprstv", "aeiou", "na"), "cyrillic": ("бдфгклмнпрств", "аеиоу", "на"), "greek": ("βδφγκλμνπρστχ", "αειου", "να")}

    def syllables(consonants: str, vowels: str, ends: str) -> str:
        # three a part of the name, one in a short part behind which others follow
        place = "(i + p * (3 + more))"
        at = number.replace(" i ", f" {place} ")
        return f"""concat(array_join(transform(split(entity, "{_JOINT}"), (part, p) -> concat(array_join(transform(
                sequence(1, if(length(part) < 3 and entity rlike "{_JOINT}", 1, 3) + more), i -> concat(
                substr('{consonants}', 1 + {at} % {len(consonants)}, 1), substr('{vowels}', 1 + (cast({at} / 16 as int)) % {len(vowels)}, 1))), ''),
                coalesce(get(regexp_extract_all(entity, "{_JOINT}", 0), p), ''))), ''),
            case kind when 'given-male' then '{ends[0]}' when 'given-female' then '{consonants[7]}{ends[1]}' else '{consonants[9]}' end)"""

    # scripts without case: a letter of the same script for each letter
    from_list = "".join(f" when c rlike '\\\\p{{Is{script}}}' then substr('{letters}', 1 + {number} % {len(letters)}, 1)" for script, letters in LETTERS.items())
    from_block = "".join(
        f" when c rlike '\\\\p{{Is{script}}}' then decode(unhex(lpad(hex({start} + {number} % {count}), 4, '0')), 'UTF-16BE')" for script, (start, count) in BLOCKS.items()
    )
    letterwise = f"""array_join(transform(transform(sequence(1, length(entity) + more), i -> struct(i, substr(entity, 1 + (i - 1) % length(entity), 1) as c)),
        x -> {f"case{from_list}{from_block} else c end".replace(" i ", " x.i ").replace("when c ", "when x.c ").replace("else c ", "else x.c ")}), '')"""

    name = f"""case when entity rlike '\\\\p{{IsCyrillic}}' then {syllables(*scripts["cyrillic"])}
        when entity rlike '\\\\p{{IsGreek}}' then {syllables(*scripts["greek"])}
        when entity rlike '^\\\\p{{Lo}}' then {letterwise} else {syllables(*scripts["latin"])} end"""
    account = "concat(substr(entity, 1, 2), '00', substr(kept, 5))"
    rows = rows.withColumn("kept", F.expr(sort_kept))
    return rows.withColumn(
        "surrogate",
        F.when(F.col("kind").isin("ip", "ip6"), F.expr(octets))
        # the country stays; check digits are right where they were
        .when(
            F.col("kind") == "iban",
            F.expr(f"concat(substr(entity, 1, 2), if({_iban_rest('entity')} = 1, lpad(cast(98 - {_iban_rest(account)} as string), 2, '0'), substr(kept, 3, 2)), substr(kept, 5))"),
        )
        .when(F.col("kind") == "email", F.concat(F.expr("substr(kept, 1, length(grown) - length(substring_index(entity, '.', -1)))"), F.substring_index("entity", ".", -1)))
        # the last digit makes the check sum right
        .when(
            (F.col("kind") == "card") & F.expr(f"{luhn('entity')} = 0"),
            F.expr(f"concat(substr(kept, 1, length(kept) - 1), cast((10 - {luhn(without_check)}) % 10 as string))"),
        )
        .when(F.col("kind").like("given-%") | (F.col("kind") == "family"), F.expr(name))
        .otherwise(F.col("kept")),
    ).drop("stream", "kept", "more", "grown")


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity): distinct within a
    kind, and never an entity of the table."""
    entities = stored(entities.select("kind", "entity").distinct(), "surrogates-entities")
    taken = entities.select("kind", F.col("entity").alias("surrogate"))
    done, left, attempt = None, entities, 0
    while True:
        drawn = _drawn(left.withColumn("attempt", F.lit(attempt)), key).select("kind", "entity", "surrogate")
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        # one entity a surrogate: the smallest
        won = stored(free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate"), "surrogates-won")
        done = won if done is None else done.union(won)
        left = stored(left.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti"), "surrogates-left")
        if left.isEmpty():
            return done
        attempt += 1


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and ``n_entities`` added."""
    docs = docs.drop("n_entities")
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(1))
    row_key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    # outer, as Spark would else run the pattern once more to test for an empty list
    mentions = docs.select(*row_key, F.explode_outer(F.array_distinct(found)).alias("mention"))
    held = stored(mentions.where(F.col("mention").isNotNull() & _is_entity(F.col("mention"))).distinct(), "surrogates-mentions")
    units = stored(_mention_units(held.select("mention").distinct()), "surrogates-units")
    assigned = assign_surrogates(units, key)
    # poured into the mention's format; what a longer form has more stands at its end (e-mail: in front)
    more = "length(surrogate) - length(raw)"
    digits = "length(regexp_replace(substr(raw, 1, i), '[^0-9]', ''))"
    letters = "length(replace(substr(raw, 1, i), ' ', ''))"
    # the capitals of each part between hyphens and apostrophes
    capitals = f"""array_join(transform(split(surrogate, "{_JOINT}"), (part, p) -> concat(
        if(get(split(raw, "{_JOINT}"), p) rlike '^\\\\p{{Lu}}', initcap(part), part), coalesce(get(regexp_extract_all(raw, "{_JOINT}", 0), p), ''))), '')"""
    poured = F.expr(f"""case
        when kind in ('ssn', 'phone', 'card') then concat(array_join(transform(sequence(1, length(raw)), i ->
            if(substr(raw, i, 1) rlike '[0-9]', substr(surrogate, {digits}, 1), substr(raw, i, 1))), ''), substr(surrogate, length(entity) + 1))
        when kind = 'iban' then concat(array_join(transform(sequence(1, length(raw)), i ->
            if(substr(raw, i, 1) = ' ', ' ', substr(surrogate, {letters}, 1))), ''), substr(surrogate, length(entity) + 1))
        when kind = 'ip6' then if(raw = upper(raw), upper(surrogate), surrogate)
        when kind = 'email' then concat(substr(surrogate, 1, {more}), array_join(transform(sequence(1, length(raw)), i ->
            if(substr(raw, i, 1) rlike '\\\\p{{Lu}}', upper(substr(surrogate, i + {more}, 1)), substr(surrogate, i + {more}, 1))), ''))
        when kind = 'family' or kind like 'given-%' then if(length(raw) > 1 and raw = upper(raw), upper(surrogate), {capitals})
        else surrogate end""")
    drawn = units.join(assigned, ["kind", "entity"]).select("mention", "head", "at", "raw", "kind", poured.alias("s"))
    whole = drawn.groupBy("mention", "head").agg(F.array_sort(F.collect_list(F.struct("at", "s", "raw", "kind"))).alias("units"))
    whole = whole.withColumn("name", F.array_join("units.raw", " ")).withColumn("name_s", F.array_join("units.s", " "))
    replaced = whole.select("mention", F.concat("head", "name_s").alias("s"))
    # the same persons without their title: the whole name and its words
    words = F.transform("units", lambda u: F.struct(u["raw"].alias("form"), u["s"].alias("s")))
    forms = whole.where(F.col("units")[0]["kind"].rlike("^(family|given-)")).select(
        "mention", F.explode(F.array_union(words, F.array(F.struct(F.col("name").alias("form"), F.col("name_s").alias("s"))))).alias("f")
    )
    forms = forms.select("mention", "f.form", "f.s").where((F.length("form") >= LEAST_NAME) | F.col("form").rlike(r"^\p{Lo}{2}"))
    own = ["doc_id", "text_hash"]
    named = held.join(forms, "mention").groupBy(*own, F.col("form").alias("mention")).agg(F.min("s").alias("s"))
    by_row = (
        held.join(replaced, "mention").select(*own, "mention", "s", F.lit(None).cast("string").alias("form"))
        .unionByName(named.withColumn("form", F.col("mention")))
        .groupBy(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"))
        .agg(F.map_from_entries(F.collect_list(F.struct("mention", "s"))).alias("replacements"), F.collect_list("form").alias("forms"))
    )
    joined = docs.withColumn("text_hash", F.xxhash64("text")).join(by_row, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("text_hash") == F.col("k2")), "left")
    # longer forms first; they are letters, apostrophes and hyphens, which mean themselves in a pattern
    by_length = F.array_sort("forms", lambda x, y: F.length(y) - F.length(x))
    # words of scripts without case may stand without a space, as particles follow them
    bounded = F.transform(by_length, lambda x: F.when(x.rlike(r"^\p{Lo}{3}"), x).otherwise(F.concat(F.lit(r"(?<!\p{L})"), x, F.lit(r"(?!\p{L})"))))
    untitled = F.concat(F.lit(PATTERN[:-1] + "|"), F.array_join(bounded, "|"), F.lit(")"))
    pattern = F.when(F.size("forms") > 0, untitled).otherwise(F.lit(PATTERN))
    joined = joined.withColumn("found_", F.when(F.col("replacements").isNotNull(), F.regexp_extract_all("text", pattern, F.lit(1))))
    pieces = F.split("text", pattern, -1)
    inserted = F.concat(F.transform("found_", lambda m: F.coalesce(F.element_at("replacements", m), m)), F.array(F.lit("")))
    text = F.when(F.col("replacements").isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(pieces, inserted, lambda a, b: F.concat(a, b)), ""))
    count = F.when(F.col("replacements").isNull(), F.lit(0)).otherwise(F.size(F.filter("found_", lambda m: F.map_contains_key("replacements", m))))
    columns = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*columns, count.cast("int").alias("n_entities"))
