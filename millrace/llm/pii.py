"""Operator 3, PII: surrogate generation. DataFrame functions only.

Entities are found by pattern: e-mail addresses, phone numbers, IPv4 addresses, social security
numbers, payment cards (with a valid Luhn digit only) and persons (a title and a name). Each is
normalised (letters lowered, separators dropped), so all spellings of one entity share a surrogate;
a person's given name and surname are entities of their own, so `Ms. Jane Roe` and `Ms. Roe` keep
their surname in common. Where a text names a person with a title, later and earlier mentions of the
same names without one are replaced alike. The surrogate is drawn by SHA-512 of a key, the kind, the
normal form and an attempt number: digits for digits, letters for letters of the same script, given
names from lists of the gender that the title states, octets that stay valid (and private if they
were), card numbers with a valid Luhn digit. Names in scripts without a list keep their length and
script. It is then laid into the form of the occurrence: separators and case.

Collision check: over the whole corpus, the distinct entities of a kind get distinct surrogates, none
of which is an entity itself. Entities whose surrogate is taken move to the next attempt, until none
is. Later attempts draw longer names and addresses (and leave a private /16 for 10/8, then for all
others), so surrogates don't run out. Only those (few, as hashes rarely meet, except for given names) are joined back to the documents
that mention them; all else is computed within a row.

Defined cases: null text stays null, empty text empty, with 0 entities. Repeated rows get the same
text, rows with a null id too; answers depend on the text alone. Very long texts are handled like others.
Numbers without a valid Luhn digit stay. Texts without an entity are
returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut, fresh
from millrace.llm.fingerprint import let

MALE_TITLES, FEMALE_TITLES, OTHER_TITLES = "Mr|Herr|Monsieur|Señor|Sr|господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа", "Dr|Prof"
MALE_TITLES, FEMALE_TITLES, OTHER_TITLES = (f"{t}|{t.upper()}" for t in (MALE_TITLES, FEMALE_TITLES, OTHER_TITLES))
NAME = r"[\p{Lu}\p{Lo}][\p{L}'’-]*\p{L}"
PATTERN = (
    r"((?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
    r"|(?<![\p{N}+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\p{N})"
    r"|(?<![\p{N}+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\p{N})"
    r"|(?<![\p{N}.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{N}-])"
    r"|(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\p{N}|\.\p{N})"
    r"|(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])"
    r"|(?<![\p{N}-])\d(?:[ -]?\d){12,18}(?![\p{N}])"
    rf"|(?<!\p{{L}})(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.? {NAME}(?: {NAME})?)"
)
#: A text without any of these has no entity.
HINT = rf"[0-9@]|(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.? [\p{{Lu}}\p{{Lo}}]"

# Given names and the parts that surnames are made of, by script.
GIVEN = {
    "given_m": "Adam Albert Alfred Anton Arthur Boris Bruno Carl Daniel David Edgar Emil Eric Felix Frank Georg Gustav Henry Hugo Isaac Jakob Jonas Julian Karl Konrad Leo Louis Lukas Martin Max Nils Oscar Otto Paul Peter Robert Simon Theo Victor Walter",
    "given_f": "Ada Alice Alma Anna Astrid Berta Carla Clara Diana Dora Edith Ella Elsa Emma Erica Eva Flora Frida Gloria Greta Hanna Helen Ida Ingrid Irene Jana Julia Karin Laura Lena Lisa Lucy Maria Marta Nina Nora Olga Paula Rosa Sara",
    "given_mc": "Алексей Андрей Антон Борис Виктор Глеб Денис Егор Иван Игорь Илья Кирилл Лев Максим Михаил Никита Олег Павел Роман Сергей",
    "given_fc": "Алина Анна Вера Галина Дарья Елена Жанна Зоя Инна Ирина Ксения Лариса Марина Мария Надежда Нина Ольга Полина Раиса Софья",
}
SYLLABLES = ("ba be bi bo da de do fa fe ga go ha he ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve vi wa we".split(), "ба бе во га го да де до жа за зо ка ки ко ла ле ли ло ма ми мо на не но па пе по ра ри ро са се со та ти то".split())
ENDINGS = ("ner son man berg feld lin ton ley mann stein".split(), "ров нов лев ков".split(), "рова нова лева кова".split())
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëíîïñóôöùúûü", "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗明华文国平建军芳静丽", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろ", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロ",
    "가나다라마바사아자차카타파하고노도로모보소오조초코토포호", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "אבגדהוזחטיכלמנסעפצקרשת", "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह", "กขคงจฉชซดตถทธนบปผพฟมยรลวสหอ",
)
CLASSES = (
    "[0-9]", "[a-z]", "[A-Z]", r"[\p{IsLatin}&&\p{Ll}]", r"[\p{IsLatin}&&\p{Lu}]", r"[\p{IsCyrillic}&&\p{Ll}]", r"[\p{IsCyrillic}&&\p{Lu}]", r"[\p{IsGreek}&&\p{Ll}]", r"[\p{IsGreek}&&\p{Lu}]",
    r"\p{IsHan}", r"\p{IsHiragana}", r"\p{IsKatakana}", r"\p{IsHangul}", r"[\p{IsArabic}&&\p{L}]", r"[\p{IsHebrew}&&\p{L}]", r"[\p{IsDevanagari}&&\p{L}]", r"[\p{IsThai}&&\p{L}]",
)
LISTED = r"^[\p{IsLatin}\p{IsCyrillic}]"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of a string of digits."""
    back = F.split(F.reverse(d), "")
    each = F.transform(back, lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v)


def kind_of(e: Column) -> Column:
    """The kind of an entity; null for a number that is no card."""
    d = digits(e)
    return (
        F.when(F.contains(e, F.lit("@")), "email")
        .when(e.rlike(r"^\p{L}"), "person")
        .when(e.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(luhn_sum(d) % 10 == 0, "card")
    )


def given_kind(title: Column, name: Column) -> Column:
    gender = F.when(title.rlike(rf"^(?:{FEMALE_TITLES})\.?$"), "f").when(title.rlike(rf"^(?:{MALE_TITLES})\.?$"), "m").otherwise(F.when(name.rlike("(?i)[aаeяo]$") & name.rlike("(?i)[aая]$"), "f").otherwise("m"))
    return F.when(~name.rlike(LISTED), "name").otherwise(F.concat(F.lit("given_"), gender, F.when(name.rlike(r"^\p{IsCyrillic}"), "c").otherwise("")))


def surname_kind(name: Column) -> Column:
    return F.when(~name.rlike(LISTED), "name").when(name.rlike(r"^\p{IsCyrillic}.*[ая]$"), "surname_fc").when(name.rlike(r"^\p{IsCyrillic}"), "surname_mc").otherwise("surname")


def parts_of(e: Column) -> Column:
    """array<struct<kind, norm>>: what of an entity gets a surrogate: itself, or the names of a person."""
    one = lambda kind, norm: F.struct(kind.alias("kind"), norm.alias("norm"))
    words = F.split(e, " ")
    given, last = F.get(words, F.lit(1)), F.element_at(words, -1)
    person = F.when(F.size(words) > 2, F.array(one(given_kind(F.get(words, F.lit(0)), given), F.lower(given)), one(surname_kind(last), F.lower(last)))).otherwise(F.array(one(surname_kind(last), F.lower(last))))
    return let(kind_of(e), lambda k: F.when(k.isNull(), F.array().cast("array<struct<kind:string,norm:string>>")).when(k == "person", person).otherwise(F.array(one(k, F.when(k == "ip", e).when(k == "email", F.lower(e)).otherwise(digits(e))))))


def surrogate(kind: Column, norm: Column, attempt: Column, secret: str) -> Column:
    """The surrogate's normal form."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(secret), kind, norm, attempt.cast("string")).cast("binary"), 512)

    def drawn(seed: Column) -> Column:
        byte = lambda i: F.conv(F.substring(seed, 2 * F.pmod(i, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
        wide = lambda i: F.conv(F.substring(seed, F.lit(8 * i + 1), F.lit(7)), 16, 10).cast("long")

        def letter(c: Column, i: Column) -> Column:
            out = None
            for cls, alphabet in zip(CLASSES, ALPHABETS, strict=True):
                new = F.substring(F.lit(alphabet), F.pmod(byte(i) + 7 * i, F.lit(len(alphabet))) + 1, F.lit(1))
                out = F.when(c.rlike(cls), new) if out is None else out.when(c.rlike(cls), new)
            return out.otherwise(F.when(c.rlike(r"\p{L}"), F.substring(F.lit(ALPHABETS[1]), F.pmod(byte(i), F.lit(26)) + 1, F.lit(1))).otherwise(c))

        mixed = lambda text: F.array_join(F.transform(F.split(text, ""), letter), "")
        # longer from attempt to attempt: so many parts more than the first ones have
        more = F.floor(attempt / 4).cast("int")
        part = lambda i: F.xxhash64(seed, i)
        pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))
        picked = lambda words, n, by: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: pick(words, part(i))), by)
        private = F.when(norm.rlike(r"^(?:10|127)\."), 1).when(norm.rlike(r"^192\.168\."), 2).otherwise(0)
        keep = F.when(attempt < 12, private).otherwise(0)
        octet = lambda o, i: F.when(i < keep, o).when((i == 0) & (private > 0) & (attempt < 40), "10").when(i == 0, (11 + byte(i) % 110).cast("string")).otherwise((1 + byte(i) % 254).cast("string"))
        size = F.length(norm)
        # what is replaced character by character; of a long phone number the first three digits may be a country's: one stays
        core = (
            F.when(kind == "email", F.regexp_replace(norm, r"\.\p{L}{2,}$", ""))
            .when(kind == "card", F.substring(norm, F.lit(2), size - 2))
            .when(kind == "phone", F.substring(norm, F.when(size > 10, size - 8).otherwise(2), size))
            .when(kind == "ssn", norm)
            .when(kind == "name", F.concat(norm, F.repeat(F.substring(norm, size, F.lit(1)), more)))
            .otherwise("")
        )

        def around(m: Column) -> Column:
            email = F.concat(F.when(more > 0, picked(list(ALPHABETS[1]), more, "")).otherwise(""), m, F.regexp_extract(norm, r"(\.\p{L}{2,})$", 1))
            card = let(F.concat(F.substring(norm, 1, 1), m), lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
            phone = F.concat(F.substring(norm, F.lit(1), F.greatest(size - 10, F.lit(0))), pick("23456789", byte(F.lit(60))), m)
            return F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind.isin("ssn", "name"), m)

        out = F.when(kind == "ip", F.array_join(F.transform(F.split(norm, r"\."), octet), "."))
        for name, text in GIVEN.items():
            out = out.when(kind == name, picked(text.lower().split(), more + 1, "-"))
        for name, syllables, ends in (("surname", SYLLABLES[0], ENDINGS[0]), ("surname_mc", SYLLABLES[1], ENDINGS[1]), ("surname_fc", SYLLABLES[1], ENDINGS[2])):
            out = out.when(kind == name, F.concat(picked(syllables, more + 2, ""), pick(ends, wide(2))))
        return out.otherwise(let(mixed(core), around))

    return let(seed, drawn)


def laid(display: Column, norm: Column, kind: Column) -> Column:
    """A surrogate's normal form in the form of an occurrence."""
    chars = F.split(display, "")
    before = lambda i: F.length(digits(F.substring(display, F.lit(1), i)))
    numbers = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(norm, before(i) + 1, F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(F.substring(display, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    name = F.when((F.upper(display) == display) & (F.length(display) > 1), F.upper(norm)).otherwise(F.initcap(F.regexp_replace(norm, "-", "- ")))
    return F.when(kind == "email", cased).when(kind.isin("phone", "card", "ssn"), numbers).when(kind == "ip", norm).otherwise(F.regexp_replace(name, "- ", "-"))


def entities_of(text: Column) -> Column:
    """The displayed entities of a text, in order."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1))).otherwise(none)


def attempts(docs: DataFrame, text: str, secret: str, rounds: int = 400) -> DataFrame:
    """(kind, norm, attempt) of the corpus's distinct entities, after the collision check."""
    parts = F.flatten(F.transform(entities_of(F.col(text)), parts_of))
    known = cut(docs.select(F.explode(parts).alias("_p")).select("_p.kind", "_p.norm").distinct().withColumn("attempt", F.lit(0)))
    taken = W.partitionBy("kind", "_s").orderBy("attempt", "norm")
    originals = known.select(F.col("kind").alias("_k"), F.col("norm").alias("_n"))
    for _ in range(rounds):
        drawn = known.withColumn("_s", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), secret))
        met = drawn.join(originals, (F.col("kind") == F.col("_k")) & (F.col("_s") == F.col("_n")), "left")
        late = met.select("kind", "norm", "attempt", ((F.row_number().over(taken) > 1) | F.col("_n").isNotNull()).alias("again"))
        late = cut(late)
        if late.filter("again").isEmpty():
            return known
        known = late.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def surrogates(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text", out: str = "surrogate_text", count: str = "n_entities") -> DataFrame:
    """docs with the text in which each entity is replaced, and how many were."""
    known = attempts(docs, text, secret)
    again = cut(known.filter(F.col("attempt") > 0))
    found, mapped, ident, own = fresh(docs, "_e"), fresh(docs, "_m"), fresh(docs, "_id"), fresh(docs, "_t")
    d = docs.drop(*[c for c in (out, count) if c not in (key, text)]).withColumn(found, entities_of(F.col(text)))
    if again.isEmpty():
        d = d.withColumn(mapped, F.lit(None).cast("map<string,int>"))
    else:
        # by text, not by id: equal texts share a map, whatever their ids
        d = d.withColumn(own, F.when(F.size(found) > 0, F.xxhash64(F.col(text))))
        mentioned = d.filter(F.col(own).isNotNull()).select(F.col(own).alias(ident), F.explode(F.flatten(F.transform(found, parts_of))).alias("_p")).select(ident, "_p.kind", "_p.norm").distinct()
        maps = mentioned.join(again, ["kind", "norm"]).groupBy(ident).agg(F.map_from_entries(F.collect_set(F.struct(F.concat("kind", F.lit("\x1f"), "norm"), "attempt"))).alias(mapped))
        # texts without an entity need none and stay out of the join
        plain = d.filter(F.col(own).isNull()).withColumn(mapped, F.lit(None).cast("map<string,int>"))
        d = d.filter(F.col(own).isNotNull()).join(maps, F.col(own) == F.col(ident), "left").drop(ident).unionByName(plain).drop(own)
    attempt = lambda p: F.coalesce(F.get(F.map_values(F.map_filter(mapped, lambda k, v: k == F.concat(p["kind"], F.lit("\x1f"), p["norm"]))), F.lit(0)), F.lit(0))

    def resolved(e: Column) -> Column:
        """An entity's replacement, and of a person the names as they stand in the text with their surrogates."""
        person, words = e.rlike(r"^\p{L}") & ~F.contains(e, F.lit("@")), F.split(e, " ")

        def pairs(ps: Column) -> Column:
            shown = lambda i: F.when(person, F.get(words, F.size(words) - F.size(ps) + i)).otherwise(e)
            return F.transform(ps, lambda p, i: let(shown(i), lambda w: F.struct(w.alias("w"), laid(w, surrogate(p["kind"], p["norm"], attempt(p), secret), p["kind"]).alias("s"))))

        def whole(found: Column) -> Column:
            drawn = F.transform(found, lambda x: x["s"])
            text = F.when(F.size(found) == 0, e).when(person, F.concat_ws(" ", F.get(words, F.lit(0)), F.array_join(drawn, " "))).otherwise(F.get(drawn, F.lit(0)))
            return F.struct(text.alias("text"), F.when(person, found).otherwise(F.slice(found, 1, 0)).alias("names"))

        return let(let(parts_of(e), pairs), whole)

    def untitled(piece: Column, names: Column) -> Column:
        """The text between entities, where names found with a title are replaced too; no surrogate is a name of the corpus."""
        return F.aggregate(names, piece, lambda t, n: F.when(F.contains(t, n["w"]), F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{L})\Q"), n["w"], F.lit(r"\E(?!\p{L})")), n["s"])).otherwise(t))

    pieces = F.split(F.col(text), PATTERN, -1)

    def joined(found: Column) -> Column:
        names = F.array_distinct(F.flatten(F.transform(found, lambda x: x["names"])))
        return let(names, lambda names: F.array_join(F.transform(pieces, lambda s, i: F.concat(untitled(s, names), F.coalesce(F.get(found, i)["text"], F.lit("")))), ""))

    built = let(F.transform(found, resolved), joined)
    n = F.size(F.filter(found, lambda e: F.size(parts_of(e)) > 0))
    return d.withColumn(out, F.when(F.size(found) > 0, built).otherwise(F.col(text))).withColumn(count, F.when(F.size(found) > 0, n).otherwise(F.lit(0))).drop(found, mapped)
