"""Format-preserving Feistel pseudonyms of personal numbers and dates, with DataFrame and SQL functions alone.

Validated values are permuted within their format by a keyed Feistel network whose halves are numbers modulo the sizes
of two digit groups, so every result is again a valid value of its format, different values stay different, and equal
values get equal pseudonyms in all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Patterns of candidate values; each alternative is bounded, so that no text makes matching quadratic.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
CARD = r"(?<![\d.-])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./])(?:\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/])"
#: Numbers begin with one of few characters, so at most places one look ahead spares the other alternatives.
CANDIDATE = EMAIL + r"|(?=[\d+(])(?:" + "|".join((CARD, SSN, PHONE, ADDRESS, DATE)) + ")"
#: Stands before and after a candidate while the text is parted; the escape for the first of its characters in a text.
MARK, ESCAPE, FIRST = "\x00\x02", "\x00\x01", "\x00"


def keyed(key: str, tag: Column | str, message: Column) -> Column:
    """60 bits of a nested keyed SHA-256."""
    k = F.lit(key)
    inner = F.sha2(F.concat(k, F.lit("|"), F.lit(tag) if isinstance(tag, str) else tag, F.lit("|"), message), 256)
    return F.conv(F.substring(F.sha2(F.concat(k, inner), 256), 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tag: Column | str) -> Column:
    """A keyed permutation of Z(size_a) x Z(size_b) as struct (a, b): rounds add a keyed function of the other half."""
    state = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    tag = F.lit(tag) if isinstance(tag, str) else tag

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        mask = keyed(key, F.concat_ws("|", tag, r.cast("string")), F.when(even, s["b"]).otherwise(s["a"]).cast("string"))
        return F.struct(
            F.when(even, (s["a"] + mask % size_a) % size_a).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + mask % size_b) % size_b).alias("b"),
        )

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), state, turn)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the digit strings of one length (1 to 19; of one digit: a shift)."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    a = F.coalesce(F.substr(digits, F.lit(1), left).try_cast("bigint"), F.lit(0))
    b = F.substr(digits, left + 1, n - left).try_cast("bigint")
    out = feistel(a, b, size(left), size(n - left), key, F.concat(F.lit(tag), n.cast("string")))
    pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
    return F.concat(F.when(left > 0, pad(out["a"], left)).otherwise(""), pad(out["b"], n - left))


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits, in order, replaced by ``digits``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def turn(s: Column, c: Column) -> Column:
        own = c.rlike(r"^\d$")
        return F.struct(F.concat(s["s"], F.when(own, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("s"), (s["k"] + own.cast("int")).alias("k"))

    return F.aggregate(F.split(value, ""), start, turn)["s"]


def luhn_sum(digits: Column) -> Column:
    """Weighted digit sum whose last digit is 0 for valid numbers."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def card_pseudonym(value: Column, key: str) -> Column:
    """Null unless the check digit holds. The first digit stays, the check digit follows the permuted rest."""
    d = digits_of(value)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    return F.when((luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$"), refill(value, F.concat(body, check.cast("string"))))


def ssn_pseudonym(value: Column, key: str) -> Column:
    """Null unless area is 001 to 899 but not 666, group 01 to 99 and serial 0001 to 9999; these permute among each other."""
    part = lambda a, n: F.substr(value, F.lit(a), F.lit(n)).try_cast("bigint")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    k = area - F.when(area > 666, 2).otherwise(1)
    out = feistel(k * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    k = F.floor(out["a"] / 99)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.when(valid, F.concat_ws("-", pad(k + F.when(k > 664, 2).otherwise(1), 3), pad(out["a"] % 99 + 1, 2), pad(out["b"] + 1, 4)))


def phone_pseudonym(value: Column, key: str) -> Column:
    """Null unless 7 to 15 digits. At most the last ten digits change, so a number with and without its country stays linked."""
    d = digits_of(value)
    n = F.least(F.length(d), F.lit(10))
    return F.when(F.length(d).between(7, 15), refill(value, F.concat(F.substr(d, F.lit(1), F.length(d) - n), permute_digits(F.substr(d, F.length(d) - n + 1, n), key, "phone"))))


def address_pseudonym(value: Column, key: str) -> Column:
    """Null unless all octets are at most 255; the two halves permute as 16-bit numbers."""
    o = F.transform(F.split(value, r"\."), lambda c: c.cast("bigint"))
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "address")
    octets = [F.floor(out["a"] / 256), out["a"] % 256, F.floor(out["b"] / 256), out["b"] % 256]
    return F.when(F.forall(o, lambda x: x <= 255), F.concat_ws(".", *[x.cast("bigint").cast("string") for x in octets]))


def slash_pseudonym(first: Column, second: Column, year: Column, key: str) -> Column:
    """Of a date with slashes that is valid with the day first or else the month first; null of any other.

    Dates that read both ways permute among each other, and so do those that read one way alone, so the pseudonym reads
    the same ways: days 13 to 28 with all months of a century, later days among the months that have them.
    """
    century, of_century = (F.floor(year / 100) * 100).cast("bigint"), year % 100
    tag = lambda name: F.concat(F.lit(f"slash {name} "), century.cast("string"))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    shown = lambda a, b, y: F.concat(two(a), F.lit("/"), two(b), F.lit("/"), F.lpad((century + y).cast("bigint").cast("string"), 4, "0"))

    both = feistel((first - 1) * 12 + second - 1, of_century, F.lit(144), F.lit(100), key, tag("both"))
    either = shown(F.floor(both["a"] / 12) + 1, both["a"] % 12 + 1, both["b"])

    month, day, day_first = F.least(first, second), F.greatest(first, second), first > second
    placed = lambda m, d, y: F.when(day_first, shown(d, m, y)).otherwise(shown(m, d, y))
    some = feistel(of_century * 12 + month - 1, day - 13, F.lit(1200), F.lit(16), key, tag("some"))
    early = placed(some["a"] % 12 + 1, some["b"] + 13, F.floor(some["a"] / 12))
    long_months = F.array(*[F.lit(m) for m in (1, 3, 5, 7, 8, 10, 12)])
    last = feistel(of_century, F.array_position(long_months, month.cast("int")) - 1, F.lit(100), F.lit(7), key, tag("31"))
    last = placed(F.element_at(long_months, (last["b"] + 1).cast("int")), day, last["a"])
    late = feistel(of_century, F.when(month == 1, 0).otherwise(month - 2), F.lit(100), F.lit(11), key, F.concat(tag("late"), day.cast("string")))
    late = placed(F.when(late["b"] == 0, 1).otherwise(late["b"] + 2), day, late["a"])
    leaps = F.when(century % 400 == 0, 25).otherwise(24)  # the first year of other centuries has no such day
    skipped = 25 - leaps
    leap = feistel(F.floor(of_century / 4) - skipped, F.lit(0), leaps, F.lit(1), key, tag("leap"))
    leap = placed(month, day, (leap["a"] + skipped) * 4)

    valid = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(month), two(day)).try_cast("date")
    one_way = F.when(day <= 28, early).when(day == 31, last).when((day == 29) & (month == 2), leap).otherwise(late)
    return F.when((year < 1) | (month < 1), None).when(day <= 12, either).when((month <= 12) & valid.isNotNull(), one_way)


def date_pseudonym(value: Column, key: str) -> Column:
    """Null unless a calendar date. Days permute within their century, which has 92 * 397 or, in the years divisible by
    400, 75 * 487 days; dates with slashes as ``slash_pseudonym`` says, for which order of day and month is unknown."""
    iso = value.rlike("^[0-9]{4}-")
    first, second = F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(4), F.lit(2))
    year = F.substr(value, F.lit(7), F.lit(4))
    day = F.when(iso, value.try_cast("date")).otherwise(F.concat_ws("-", year, second, first).try_cast("date"))
    century = (F.floor(F.year(day) / 100) * 100).cast("int")
    start = F.concat(F.lpad(century.cast("string"), 4, "0"), F.lit("-01-01")).try_cast("date")
    leap = century % 400 == 0
    size_a, size_b = F.when(leap, 75).otherwise(92), F.when(leap, 487).otherwise(397)
    index = F.datediff(day, start).cast("bigint")
    out = feistel(F.floor(index / size_b), index % size_b, size_a, size_b, key, F.concat(F.lit("date"), century.cast("string")))
    new = F.date_add(start, (out["a"] * size_b + out["b"]).cast("int"))
    shown = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "dd.MM.yyyy"))
    number = lambda c: c.try_cast("bigint")
    return F.when(value.contains("/"), slash_pseudonym(number(first), number(second), number(year), key)).when(day.isNotNull() & (F.year(day) >= 1), shown)


def email_pseudonym(value: Column, key: str) -> Column:
    """Local part and domain by keyed digests of 48 and 32 bits of their lower-case forms, under a top-level domain that
    nobody has: addresses are of no fixed length, so this is no permutation, and of very many some may get one name."""
    whole = F.lower(value)
    domain = F.substring_index(whole, "@", -1)
    hexed = lambda tag, c, n: F.substring(F.lower(F.lpad(F.hex(keyed(key, tag, c)), 16, "0")), 17 - n, n)
    return F.concat(F.lit("u"), hexed("email", whole, 12), F.lit("@"), hexed("domain", domain, 8), F.lit(".invalid"))


def kinds_of(value: Column) -> list[tuple[str, Column]]:
    """Each kind with the condition that a candidate is of it, in order."""
    full = lambda p: value.rlike(f"^(?:{p})$")
    return [("email", value.contains("@")), ("ssn", full(r"\d{3}-\d{2}-\d{4}")), ("date", full(r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}")), ("address", full(r"\d{1,3}(?:\.\d{1,3}){3}")), ("card", full(r"\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}")), ("phone", F.lit(True))]


def pseudonym(value: Column, key: str) -> Column:
    """struct (kind, new) of a candidate; ``new`` is null where the value isn't valid."""
    make = {"email": email_pseudonym, "ssn": ssn_pseudonym, "date": date_pseudonym, "address": address_pseudonym, "card": card_pseudonym, "phone": phone_pseudonym}
    kind, new = None, None
    for name, is_kind in kinds_of(value):
        kind = F.when(is_kind, name) if kind is None else kind.when(is_kind, name)
        new = F.when(is_kind, make[name](value, key)) if new is None else new.when(is_kind, make[name](value, key))
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_pii`` long and ``pii_kinds`` string (distinct, sorted, comma-joined).

    Null texts stay null, with 0 values and no kind; texts without a value stay as they are. Candidates that don't
    validate (check digit, octets, calendar, area numbers) stay, too. Each row is worked on by itself: the text is split
    at the candidates and put together again, so repeated rows, hot values and very long texts need no shuffle. Input
    columns named ``n_pii`` or ``pii_kinds`` give way. ``key`` is secret: whoever has it can undo the permutations. It is a
    literal of the plan, so it shows in ``explain``, the UI and event logs, which are to be kept as secret.
    """
    cols = [c for c in docs.columns if c.lower() not in ("n_pii", "pii_kinds")]
    # one scan with the pattern puts marks around the candidates; patterns go to Spark as literals, not by the SQL parser
    escaped = F.when(F.contains(text, F.lit(FIRST)), F.replace(F.col(text), F.lit(FIRST), F.lit(ESCAPE))).otherwise(F.col(text))
    out = docs.select(*cols, F.split(F.regexp_replace(escaped, F.lit(f"({CANDIDATE})"), F.lit(f"{MARK}$1{MARK}")), MARK).alias("__parts"))
    every_other = lambda first: F.filter(F.col("__parts"), lambda _, k: k % 2 == first)
    hits = F.when(F.size("__parts") > 1, every_other(1))
    out = out.withColumn("__found", F.transform(hits, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("p"))))
    put = lambda piece, f: F.concat(piece, F.coalesce(f["p"]["new"], f["old"], F.lit("")))
    rewritten = F.replace(F.array_join(F.zip_with(every_other(0), F.col("__found"), put), ""), F.lit(ESCAPE), F.lit(FIRST))
    valid = F.filter(F.col("__found"), lambda f: f["p"]["new"].isNotNull())
    out = out.withColumn("n_pii", F.when(F.col("__found").isNull(), 0).otherwise(F.size(valid)).cast("long"))
    out = out.withColumn("pii_kinds", F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(valid, lambda f: f["p"]["kind"]))), ","), F.lit("")))
    return out.withColumn(text, F.when(F.col("n_pii") > 0, rewritten).otherwise(F.col(text))).drop("__found", "__parts")
