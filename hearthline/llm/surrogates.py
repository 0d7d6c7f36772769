"""PII surrogates, in DataFrame operations only: every detected entity gets a keyed stand-in.

Detected are e-mail addresses, IPv4 addresses, social security numbers (ddd-dd-dddd), card
numbers (13 to 19 digits), telephone numbers, and names behind a title. A stand-in depends on
the key, the type and the entity's normal form, so an entity has the same one in every document
and spelling (coreference): telephone numbers and cards by their digits, addresses without case,
names word by word, so that "Mrs Ann Smith" and "Mr Smith" keep sharing a family name. It keeps
the type's format: separators, letter case, top-level domain, country code, first card digit and
whether the check digit holds; given names keep the gender of the title, and letters their script.

Distinctness: the stand-ins of all different entities are compared with each other and with the
entities themselves, and those that collide draw again until none does; with the draws names and
addresses grow longer, and digits vary. Entities are few beside text; they are gathered by
distributed aggregations, and texts are rewritten where they stand.

Edge cases: null text stays null, texts without entities are untouched; an entity is found where
it stands whole in one text; overlapping matches go to the leftmost, then to the first kind
listed; equal rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.session import cut_lineage

#: Titles and the gender they say, fixed values.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа", "Κυρία"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н", "Κύριος"]
TITLE = "(?:" + "|".join(FEMALE_TITLES + MALE_TITLES) + r")\.?"
NAME = r"\p{Lu}[\p{L}'’-]+"

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)"
CARD = r"(?<![\d+-])[3-6]\d{3}(?:[ -]?\d){9,15}(?![ -]?\d)"
PHONE = (r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])"
         r"|(?<![\w+.-])\+\d{8,15}(?!\d)")
PERSON = rf"(?<!\p{{L}}){TITLE}\x20{NAME}(?:\x20{NAME}){{0,2}}"
KINDS = {"email": EMAIL, "ip": IP, "ssn": SSN, "card": CARD, "phone": PHONE, "person": PERSON}
ENTITY = "|".join(KINDS.values())

#: The last digits of a telephone number that name it; what stands before is the country's code.
NATIONAL_DIGITS = 10

#: Sixteen stand-in letters and syllables per script, one for each hexadecimal digit.
HEX = "0123456789abcdef"
LETTERS = {"latin": "bcdfghklmnprstvz", "cyrillic": "бвгдежзиклмнопрс", "greek": "βγδζθκλμνξπρστφχ"}
SYLLABLES = {"latin": "ba do fe gi ka lo me ni pa ro se ti va zo ru li",
             "cyrillic": "ба до фе ги ка ло ме ни па ро се ти ва зо ру ли",
             "greek": "βα δο φε γι κα λο με νι πα ρο σε τι κο ζο ρυ λι"}
ENDINGS = {"latin": ("na", "no", "lin"), "cyrillic": ("на", "н", "лин"), "greek": ("να", "νος", "λης")}
BLOCKS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}


def kind_of(mention: Column) -> Column:
    """The kind of a mention, by the first pattern that it matches whole."""
    found = F.lit("person")
    for kind in reversed([k for k in KINDS if k != "person"]):
        shape = {"email": "@", "ip": rf"^{OCTET}(?:\.{OCTET}){{3}}$", "ssn": r"^\d{3}-\d{2}-\d{4}$",
                 "card": r"^[3-6]\d{3}(?:[ -]?\d){9,15}$", "phone": r"^[+(\d]"}[kind]
        found = F.when(mention.rlike(shape), F.lit(kind)).otherwise(found)
    return found


def script_of(word: Column) -> Column:
    script = F.lit("latin")
    for name, block in BLOCKS.items():
        script = F.when(word.rlike(block), F.lit(name)).otherwise(script)
    return script


def parts_of(mentions: DataFrame) -> DataFrame:
    """mention, part_no, part, kind and normal form; a name has a part for every word."""
    digits = F.regexp_replace("part", r"\D", "")
    last = F.size("words") - 1
    gender = F.when(F.regexp_replace(F.element_at("words", 1), r"\.$", "").isin(FEMALE_TITLES), "female").otherwise("male")
    role = (F.when(F.col("part_no") == 0, F.lit("title")).when(F.col("part_no") == last, F.concat(F.lit("family-"), script_of(F.col("part"))))
            .otherwise(F.concat(F.lit("given-"), gender, F.lit("-"), script_of(F.col("part")))))
    parts = (mentions.withColumn("what", kind_of(F.col("mention")))
             .withColumn("words", F.when(F.col("what") == "person", F.split("mention", " ")).otherwise(F.array("mention")))
             .select("mention", "what", "words", F.posexplode("words").alias("part_no", "part")))
    return parts.select("mention", "part_no", "part", F.when(F.col("what") == "person", role).otherwise(F.col("what")).alias("kind"),
                        F.when(F.col("what") == "phone", F.right(digits, F.lit(NATIONAL_DIGITS)))
                        .when(F.col("what").isin("card", "ssn"), digits).otherwise(F.lower("part")).alias("norm"))


def luhn(number: Column) -> Column:
    """Sum of a number's digits in the check-digit scheme, its last digit counting once."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def letters_for(c: Column, hexes: str, i: Column) -> Column:
    at = F.substring(F.col(hexes), i % 128 + 1, F.lit(1))
    out = F.translate(at, HEX, LETTERS["latin"])
    for name, block in BLOCKS.items():
        out = F.when(c.rlike(block), F.translate(at, HEX, LETTERS[name])).otherwise(out)
    return out


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """`entities` (kind, norm, draw) with the stand-in of that draw, `core`."""
    seed = F.concat_ws("|", F.lit(key), "kind", "norm", F.col("draw").cast("string"))
    e = (entities.withColumn("hexes", F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("2"), seed), 256)))
         .withColumn("digits", F.repeat(F.translate("hexes", "abcdef", "927461"), F.lit(2)))
         .withColumn("size", F.length("norm")))
    longer = F.when(F.col("draw") > 5, F.substring(F.translate("hexes", HEX, LETTERS["latin"]), F.lit(1), F.col("draw") - 5)).otherwise("")
    head = F.regexp_extract("norm", r"^(.*)\.[^.]+$", 1)
    email = F.concat(longer, F.array_join(F.transform(F.split(head, ""), lambda c, i: F.when(
        c.rlike(r"\p{N}"), F.substring(F.col("digits"), i % 128 + 1, F.lit(1))).when(
        c.rlike(r"\p{L}"), letters_for(c, "hexes", i)).otherwise(c)), ""), F.regexp_extract("norm", r"(\.[^.]+)$", 1))
    octets = [(F.conv(F.substring("hexes", 1 + 4 * k, 4), 16, 10).cast("int") % 254 + 1).cast("string") for k in range(4)]
    phone = F.concat(F.substring("norm", 1, 1), F.substring("digits", F.lit(1), F.col("size") - 1))
    ssn = F.concat(F.translate(F.substring("digits", 1, 1), "09", "18"), F.substring("digits", 2, 8))
    body = F.concat(F.substring("norm", 1, 1), F.substring("digits", F.lit(1), F.col("size") - 2))
    right = F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    card = F.concat(body, F.when(luhn(F.col("norm")) % 10 == 0, right).otherwise((right + 1) % 10).cast("string"))
    name = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        female, male, family = ENDINGS[script]
        listed = F.array(*map(F.lit, syllables.split()))
        stem = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2) + F.col("draw")), lambda i: F.element_at(
            listed, F.conv(F.substring(F.col("hexes"), i, F.lit(1)), 16, 10).cast("int") + 1)), "")
        ending = (F.when(F.col("kind").startswith("family"), family).when(F.col("kind").startswith("given-female"), female).otherwise(male))
        name = F.when(F.col("kind").endswith(script), F.concat(stem, ending)).otherwise(name)
    core = (F.when(F.col("kind") == "email", email).when(F.col("kind") == "ip", F.concat_ws(".", *octets))
            .when(F.col("kind") == "phone", phone).when(F.col("kind") == "ssn", ssn).when(F.col("kind") == "card", card)
            .when(F.col("kind") == "title", F.col("norm")).otherwise(name))
    return e.select("kind", "norm", "draw", core.alias("core"))


def assigned(entities: DataFrame, key: str, most_draws: int = 60) -> DataFrame:
    """kind, norm, core for every entity: all cores of a kind differ, and none is an entity.

    A core taken by several goes to the one that drew it first (then the smallest), the others
    draw again. `most_draws` guards against a format that has fewer values than entities.
    """
    names = entities.select("kind", "norm").distinct()
    real = cut_lineage(names)
    now = cut_lineage(drawn(real.withColumn("draw", F.lit(0)), key))
    for _ in range(most_draws):
        taken = real.select("kind", F.col("norm").alias("core"), F.lit(True).alias("is_real"))
        ranked = (now.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "core").orderBy("draw", "norm")))
                  .join(taken, ["kind", "core"], "left")
                  .withColumn("again", (F.col("kind") != "title") & ((F.col("nth") > 1) | F.col("is_real").isNotNull())))
        ranked = cut_lineage(ranked.select("kind", "norm", "draw", "core", "again"))
        again = ranked.filter("again")
        if again.isEmpty():
            return ranked.select("kind", "norm", "core")
        now = cut_lineage(ranked.filter("not again").select("kind", "norm", "draw", "core").union(
            drawn(again.select("kind", "norm", (F.col("draw") + 1).alias("draw")), key)))
    raise ValueError(f"no distinct stand-ins after {most_draws} draws: a format has too few values")


def dressed() -> Column:
    """The stand-in of a part in the part's own spelling."""
    digits = F.regexp_replace("part", r"\D", "")
    country = F.substring(digits, F.lit(1), F.length(digits) - F.length("core"))
    filled = F.array_join(F.zip_with(F.split("part", r"\d", -1), F.split(F.concat(country, "core"), ""),
                                     lambda gap, digit: F.concat(gap, F.coalesce(digit, F.lit("")))), "")
    cased = F.array_join(F.zip_with(F.split("part", ""), F.split("core", ""), lambda was, now: F.when(
        was.rlike(r"\p{Lu}"), F.upper(now)).otherwise(now)), "")
    named = F.when((F.col("part") == F.upper("part")) & (F.length("part") > 1), F.upper("core")).otherwise(F.initcap("core"))
    return (F.when(F.col("kind") == "title", F.col("part")).when(F.col("kind").isin("phone", "card", "ssn"), filled)
            .when(F.col("kind") == "email", F.when(F.length("part") == F.length("core"), cased).otherwise(F.col("core")))
            .when(F.col("kind") == "ip", F.col("core")).otherwise(named))


def mentions_in(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(0))


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with stand-ins, and the number of entities replaced, for every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut_lineage(texts.withColumn("mentions", mentions_in("text")).filter(F.size("mentions") > 0)
                        .select("doc_id", F.xxhash64("text").alias("text_key"), "mentions").distinct())
    mentions = found.select(F.explode("mentions").alias("mention")).distinct()
    parts = cut_lineage(parts_of(mentions))
    cores = assigned(parts.select("kind", "norm"), key)
    spelled = (parts.join(cores, ["kind", "norm"]).select("mention", "part_no", dressed().alias("part"))
               .groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("part_no", "part"))).alias("parts"))
               .select("mention", F.array_join(F.col("parts.part"), " ").alias("stand_in")))
    placed = (found.select("doc_id", "text_key", F.posexplode("mentions").alias("nth", "mention")).join(spelled, "mention")
              .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("nth", "stand_in"))).alias("placed"))
              .select(F.col("doc_id").alias("p_id"), F.col("text_key").alias("p_key"), F.col("placed.stand_in").alias("stand_ins")))
    joined = texts.join(placed, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.xxhash64("text") == F.col("p_key")), "left")
    gaps = F.split("text", ENTITY, -1)
    text = F.array_join(F.zip_with(gaps, "stand_ins", lambda gap, own: F.concat(gap, F.coalesce(own, F.lit("")))), "")
    return joined.select("doc_id", F.when(F.col("stand_ins").isNull(), F.col("text")).otherwise(text).alias("text"),
                         F.coalesce(F.size("stand_ins"), F.lit(0)).alias("n_entities"))
