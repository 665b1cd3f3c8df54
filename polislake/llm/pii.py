"""Operator 9, format-preserving pseudonyms for personal data. DataFrame functions only.

Found and validated: e-mail addresses, IPv4 addresses (octets up to 255), telephone numbers, card numbers (Luhn), account numbers (IBAN), social security numbers (area, group and serial
that are given out), dates of 1800 to 2199 that exist (2024-01-31, 31/1/2024, 31.1.2024, 31 January 2024, January 31, 2024), and quoted hexadecimal secrets (token = "..."). A candidate that fails its validation stays as it is.

A value is a tuple of symbols, each with its own alphabet: a digit stays a digit, a letter a letter of its case, an octet an octet. Its
halves L and R are permuted by a Feistel network over these alphabets: L[i] += F(key, round, R, i) modulo the size of L[i]'s alphabet, then the same for
R, for ROUNDS rounds, F being keyed SHA-256. So the map is a bijection of each format: equal values stay equal in all documents and different
ones different. A card keeps its first digit and gets a new check digit; a telephone number keeps its country code; an address keeps its
domain; a date is a day number in the 146,097 days of a Gregorian cycle, as two symbols (189 x 773 days).

Nothing is shuffled. Null text stays null. Repeated rows get equal results. There are no ties: of overlapping candidates the one that begins first counts, and of those the first kind in the
order of PATTERNS. A very long text is read whole. An empty table gives an empty result. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import fresh
from .quality_rules import bind

ROUNDS = 8
#: Patterns of the kinds, in order of precedence.
PATTERNS = {
    "secret": r"""(?:token|secret|password|api[_-]?key|TOKEN|SECRET|PASSWORD|API[_-]?KEY) ?[=:] ?"[0-9A-Fa-f]{32,64}\"""",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+){1,8}",
    "ip": r"(?<![\p{L}\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d|\p{L})",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\d])",
    "written": r"(?<![\p{L}\d])(?:\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December)|(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2},) \d{4}(?![\p{L}\d])",
    "iso": r"(?<![\p{L}\d-])\d{4}-\d{2}-\d{2}(?![\p{L}\d]|-\d)",
    "dmy": r"(?<![\p{L}\d./])\d{1,2}[./]\d{1,2}[./]\d{4}(?![\p{L}\d]|[./]\d)",
    "phone": r"(?<![\p{L}\d+(])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\p{L}\d+(.-])(?:\+\d{1,3}[ .-]?)?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\p{L}\d]|[.-]\d)",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\p{L}\d]|-\d)",
    "card": r"(?<![\p{L}\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\p{L}\d]|[.-]\d)",
}
#: Alphabets in natural order.
DIGITS, HEX, HEX_UPPER = "0123456789", "0123456789abcdef", "0123456789ABCDEF"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LATIN_LOWER, LATIN_UPPER = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
CYCLE_START, CYCLE = "1800-01-01", (189, 773)


def anything() -> str:
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def keyed(key: str, *parts: Column) -> Column:
    """A non-negative 60-bit number from SHA-256 of the key and the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, values: Column, sizes: Column) -> Column:
    """The permuted symbols (array<bigint>) of `values`, symbol i below sizes[i]."""

    def run(t: Column) -> Column:
        v, m = t["v"], t["m"]
        half = F.floor(F.size(v) / 2).cast("int")

        def turn(s: Column, n: Column) -> Column:
            left, right = s["l"], s["r"]

            def add(own: Column, other: Column, at: Column, tag: str) -> Column:
                name = F.array_join(F.transform(other, lambda x: x.cast("string")), ",")
                return F.transform(own, lambda x, i: F.pmod(x + F.pmod(keyed(key, F.lit(kind), F.lit(tag), n, F.size(v), name, i), F.get(m, at + i)), F.get(m, at + i)))

            return bind(add(left, right, F.lit(0), "l"), lambda new: F.struct(new.alias("l"), add(right, new, half, "r").alias("r")))

        start = F.struct(F.slice(v, F.lit(1), half).alias("l"), F.slice(v, half + 1, F.size(v) - half).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn, lambda s: F.concat(s["l"], s["r"]))

    return bind(F.struct(values.alias("v"), sizes.alias("m")), run)


def permute_characters(key: str, kind: str, text: Column, alphabet) -> Column:
    """text with each character c at index i moved within alphabet(c, i); an empty alphabet leaves it."""
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    told = F.transform(characters, lambda c, i: F.struct(c.alias("c"), alphabet(c, i).alias("a")))

    def run(cells: Column) -> Column:
        moving = F.filter(cells, lambda x: x["a"] != "")
        values = F.transform(moving, lambda x: (F.call_function("locate", x["c"], x["a"]) - 1).cast("long"))
        sizes = F.transform(moving, lambda x: F.length(x["a"]).cast("long"))

        def rebuild(new: Column) -> Column:
            step = lambda s, x: F.struct(
                F.concat(s["out"], F.when(x["a"] == "", x["c"]).otherwise(F.call_function("substring", x["a"], F.get(new, s["k"]).cast("int") + 1, F.lit(1)))).alias("out"),
                F.when(x["a"] == "", s["k"]).otherwise(s["k"] + 1).alias("k"),
            )
            return F.aggregate(cells, F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step, lambda s: s["out"])

        return bind(feistel(key, kind, values, sizes), rebuild)

    return bind(told, run)


def usual(c: Column) -> Column:
    out = F.lit("")
    for a in (LATIN_UPPER, LATIN_LOWER, UPPER, LOWER, DIGITS):
        out = F.when(F.lit(a).contains(c), F.lit(a)).otherwise(out)
    return out


def digit(c: Column) -> Column:
    return F.when(F.lit(DIGITS).contains(c), F.lit(DIGITS)).otherwise(F.lit(""))


def new_email(key: str, m: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_characters(key, "email", local, lambda c, i: usual(c)), F.call_function("substring", m, F.length(local) + 1))


def new_secret(key: str, m: Column) -> Column:
    value = F.element_at(F.split(m, '"'), -2)
    alphabet = F.when(value.rlike("[A-F]") & ~value.rlike("[a-f]"), F.lit(HEX_UPPER)).otherwise(F.lit(HEX))
    mixed = value.rlike("[A-F]") & value.rlike("[a-f]")
    new = permute_characters(key, "secret", F.when(mixed, F.lower(value)).otherwise(value), lambda c, i: alphabet)
    return F.concat(F.substring_index(m, '"', 1), F.lit('"'), new, F.lit('"'))


def new_ip(key: str, m: Column) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda x: x.cast("long"))
    return bind(octets, lambda o: F.when(F.forall(o, lambda x: x < 256), F.array_join(F.transform(feistel(key, "ip", o, F.array_repeat(F.lit(256).cast("long"), 4)), lambda x: x.cast("string")), ".")).otherwise(m))


def new_date(key: str, m: Column, day: Column, write) -> Column:
    number = F.datediff(day, F.lit(CYCLE_START).cast("date")).cast("long")
    inside = day.isNotNull() & (number >= 0) & (number < CYCLE[0] * CYCLE[1])
    values = F.array(F.floor(number / CYCLE[1]).cast("long"), number % CYCLE[1])
    moved = feistel(key, "date", values, F.array(*[F.lit(x).cast("long") for x in CYCLE]))
    return F.when(inside, bind(moved, lambda v: write(F.date_add(F.lit(CYCLE_START).cast("date"), (v[0] * CYCLE[1] + v[1]).cast("int"))))).otherwise(m)


def new_iso(key: str, m: Column) -> Column:
    return new_date(key, m, F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date"), lambda d: F.date_format(d, "yyyy-MM-dd"))


def new_dmy(key: str, m: Column) -> Column:
    mark = F.substring(F.regexp_replace(m, "[0-9]", ""), 1, 1)
    day = F.try_to_timestamp(F.translate(m, ".", "/"), F.lit("d/M/yyyy")).cast("date")
    padded = F.length(F.substring_index(F.translate(m, ".", "/"), "/", 1)) == 2
    return new_date(key, m, day, lambda d: F.call_function("concat_ws", mark, F.when(padded, F.date_format(d, "dd")).otherwise(F.date_format(d, "d")), F.when(padded, F.date_format(d, "MM")).otherwise(F.date_format(d, "M")), F.date_format(d, "yyyy")))


def new_written(key: str, m: Column) -> Column:
    first = m.rlike("^\\d")
    day = F.when(first, F.try_to_timestamp(m, F.lit("d MMMM yyyy"))).otherwise(F.try_to_timestamp(m, F.lit("MMMM d, yyyy"))).cast("date")
    return new_date(key, m, day, lambda d: F.when(first, F.date_format(d, "d MMMM yyyy")).otherwise(F.date_format(d, "MMMM d, yyyy")))


def mod_97(text: Column) -> Column:
    """The remainder of a number in which letters stand for 10 to 35."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def step(a: Column, c: Column) -> Column:
        at = F.call_function("locate", c, letters).cast("long")
        return F.when(at > 0, (a * 100 + at + 9) % 97).otherwise((a * 10 + F.call_function("locate", c, F.lit(DIGITS)).cast("long") - 1) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)


def new_iban(key: str, m: Column) -> Column:
    """The account part moves, spaces stay, the check digits are made anew."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    valid = mod_97(F.concat(F.call_function("substring", plain, F.lit(5)), F.substring(plain, 1, 4))) == 1
    body = permute_characters(key, "iban", F.call_function("substring", m, F.lit(5)), lambda c, i: usual(c))
    check = lambda b: F.lpad((98 - mod_97(F.concat(F.replace(b, F.lit(" "), F.lit("")), F.substring(m, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, bind(body, lambda b: F.concat(F.substring(m, 1, 2), check(b), b))).otherwise(m)


def new_phone(key: str, m: Column) -> Column:
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))

    def alphabet(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.call_function("substring", m, F.lit(1), i), "[^0-9]", ""))  # digits before this one
        place = nth - (n - 10)
        lead = F.when(c >= "2", F.lit("23456789")).otherwise(F.lit("01"))
        return F.when((digit(c) == "") | (place < 0), F.lit("")).when((place == 0) | (place == 3), lead).otherwise(F.lit(DIGITS))

    return permute_characters(key, "phone", m, alphabet)


def new_ssn(key: str, m: Column) -> Column:
    parts = F.transform(F.split(m, "-"), lambda x: x.cast("long"))

    def run(p: Column) -> Column:
        good = (p[0] > 0) & (p[0] != 666) & (p[0] < 900) & (p[1] > 0) & (p[2] > 0)
        area = F.when(p[0] > 666, p[0] - 2).otherwise(p[0] - 1)  # 898 areas in order
        moved = feistel(key, "ssn", F.array(area, p[1] - 1, p[2] - 1), F.array(*[F.lit(x).cast("long") for x in (898, 99, 9999)]))
        back = lambda a: F.when(a >= 665, a + 2).otherwise(a + 1)
        return F.when(good, bind(moved, lambda v: F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((back(v[0]), 3), (v[1] + 1, 2), (v[2] + 1, 4))]))).otherwise(m)

    return bind(parts, run)


def new_card(key: str, m: Column) -> Column:
    n = F.length(m)
    last = n - 1
    body = permute_characters(key, "card", F.call_function("substring", m, F.lit(1), last), lambda c, i: F.when(i == 0, F.lit("")).otherwise(digit(c)))
    check = lambda b: F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(F.regexp_replace(b, "[^0-9]", ""), d.cast("string"))))[0].cast("string")
    valid = F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", ""))
    return F.when(valid, bind(body, lambda b: F.concat(b, check(b)))).otherwise(m)


MAKERS = {"iban": new_iban, "written": new_written, "secret": new_secret, "email": new_email, "ip": new_ip, "iso": new_iso, "dmy": new_dmy, "phone": new_phone, "ssn": new_ssn, "card": new_card}


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of a found value, or the value itself if it is not valid."""
    shapes = {
        "iban": m.rlike("^[A-Z]{2}\\d{2}"), "written": m.rlike("^(?:\\d{1,2} )?[A-Z][a-z]+ (?:\\d{1,2}, )?\\d{4}$"), "secret": F.substring(m, -1, 1) == '"', "email": m.contains("@"), "ip": m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "iso": m.rlike(r"^\d{4}-\d{2}-\d{2}$"), "dmy": m.rlike(r"^\d{1,2}[./]\d{1,2}[./]\d{4}$"),
        "ssn": m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "phone": m.rlike(r"[(+]") | m.rlike(r"^\d{3}[ .-]\d{3}[ .-]\d{4}$"),
    }
    out = MAKERS["card"](key, m)
    for kind in ("phone", "ssn", "dmy", "iso", "written", "iban", "ip", "email", "secret"):
        out = F.when(shapes[kind], MAKERS[kind](key, m)).otherwise(out)
    return out


def pseudonymize(documents: DataFrame, key: str, column: str = "text", count: str | None = None) -> DataFrame:
    """documents with personal data in `column` replaced; `count` names a column for the number of replaced values."""
    pattern = anything()

    def replaced(text: Column) -> Column:
        pairs = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("m"), pseudonym(key, m).alias("p")))

        def put(found: Column) -> Column:
            gaps = F.split(text, pattern, -1)
            whole = F.array_join(F.flatten(F.zip_with(gaps, found, lambda g, x: F.array(g, F.coalesce(x["p"], F.lit(""))))), "")
            return F.struct(whole.alias("text"), F.size(F.filter(found, lambda x: x["m"] != x["p"])).alias("n"))

        return bind(pairs, put)

    text = F.col(column)
    plain = F.struct(text.alias("text"), F.lit(0).alias("n"))
    # A candidate has a digit, an at sign or the quoted value of a secret; most texts have none and are passed on unread by the larger pattern.
    made = F.when(text.rlike("[0-9@]|[=:] ?\""), replaced(text)).otherwise(plain)
    mark = fresh([*documents.columns, count or ""], "pseudonymized")
    out = documents.withColumn(mark, made)
    keep = [F.col(f"{mark}.text").alias(c) if c == column else F.col(c) for c in documents.columns]
    return out.select(*keep, *([F.col(f"{mark}.n").alias(count)] if count else []))
