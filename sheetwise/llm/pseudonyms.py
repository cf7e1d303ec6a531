"""Format-preserving pseudonyms for personal data, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.registry import query, table
from sheetwise.llm.text import without

# The forms that are looked for. Each begins and ends apart from letters and digits.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IPV4 = r"(?<![0-9A-Za-z.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z]|\.\d)"
DATE = r"(?<![0-9A-Za-z])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![0-9A-Za-z])"
NATIONAL = r"(?<![0-9A-Za-z])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+\d{1,3} ?\(\d{1,4}\) ?\d{3,4}[ .-]\d{3,4}|\+\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}|\+\d{7,15}"
    r"|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4})(?![0-9A-Za-z])"
)
CARD = r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![0-9A-Za-z])"
ACCESS_KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
PASSWORD = r"(?<![0-9A-Za-z])password=[0-9A-Za-z]{6,}"
FORMS = [EMAIL, IPV4, DATE, NATIONAL, IBAN, PHONE, CARD, ACCESS_KEY, PASSWORD]
ANY = "|".join(FORMS)
#: no value is without one of these
HINT = r"[0-9@]|password="

#: days of 400 years, a whole cycle of the calendar, as 27 x 5411
FIRST_DAY, DAYS, DAY_RADIX = "1800-01-01", 146_097, (27, 5_411)
#: those of them after the 12th of a month, which no month-first date can be mistaken for, as 9 x 9833
LATE_DAYS, LATE_RADIX = DAYS - 4_800 * 12, (9, 9_833)
#: areas, groups and serial numbers of national numbers
NATIONAL_RADIX = (898, 99, 9_999)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(values: Column, radix: Column, key: str, kind: str, rounds: int = 10) -> Column:
    """A keyed permutation of arrays of ``values``, each below its ``radix``.

    Every round adds to one half of the places, modulo their radix, a keyed hash of the other half; this
    can be undone round by round, so different arrays stay different. ``values`` and ``radix`` should be
    bound by ``let``.
    """

    def turn(half: Column, v: Column, k: Column) -> Column:
        even = k % 2 == 0
        other = F.when(even, F.slice(v, half + 1, F.size(v) - half)).otherwise(F.slice(v, 1, half))
        said = F.concat_ws(",", F.lit(key), F.lit(kind), k, F.array_join(F.transform(other, lambda x: x.cast("string")), "."))

        def place(said: Column, x: Column, i: Column) -> Column:
            added = F.conv(F.substring(F.sha2(F.concat_ws("#", said, i), 256), 1, 12), 16, 10).cast("long")
            return F.when((i < half) == even, ((x + added) % F.get(radix, i)).cast("int")).otherwise(x)

        return let(said, lambda s: F.transform(v, lambda x, i: place(s, x, i)))

    middle = F.floor(F.size(values) / 2).cast("int")
    return let(middle, lambda half: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), values, lambda v, k: turn(half, v, k)))


def _base(code: Column) -> Column:
    return F.when(code.between(48, 57), 48).when(code.between(65, 90), 65).when(code.between(97, 122), 97).otherwise(code)


def _radix(code: Column) -> Column:
    return F.when(code.between(48, 57), 10).when(code.between(65, 90) | code.between(97, 122), 26).otherwise(1)


def scrambled(text: Column, key: str, kind: str) -> Column:
    """ASCII text with digits, capital and small letters permuted among their kind; other characters stay."""

    def moved(codes: Column) -> Column:
        values, radix = F.transform(codes, lambda c: (c - _base(c)).cast("int")), F.transform(codes, _radix)
        new = let(values, lambda v: let(radix, lambda r: feistel(v, r, key, kind)))
        return F.array_join(F.zip_with(new, codes, lambda v, c: F.char(_base(c) + v)), "")

    codes = let(text, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.ascii(F.substr(t, i, F.lit(1)))))
    return F.when(F.length(text) > 0, let(codes, moved)).otherwise(text)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """The Luhn sum of a string of digits; a valid number's is a multiple of ten."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    def total(digits: Column) -> Column:
        def value(i: Column) -> Column:
            d = F.substr(digits, i, F.lit(1)).cast("int")
            return F.when((F.length(digits) - i) % 2 == 1, doubled(d)).otherwise(d)

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x)

    return let(number, total)


def _card(m: Column, key: str) -> Column:
    """All digits but the last permuted, the last made valid again; separators stay where they were."""

    def spread(new: Column) -> Column:
        place = lambda i: F.length(_digits(F.substr(m, F.lit(1), i)))
        sign = lambda i: F.substr(m, i, F.lit(1))
        each = lambda i: F.when(sign(i).rlike("[0-9]"), F.substr(new, place(i), F.lit(1))).otherwise(sign(i))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), each), "")

    def changed(digits: Column) -> Column:
        body = scrambled(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
        check = lambda b: ((F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")
        new = let(body, lambda b: F.concat(b, check(b)))
        return F.when(luhn_sum(digits) % 10 == 0, let(new, spread)).otherwise(m)

    return let(_digits(m), changed)


def _ipv4(m: Column, key: str) -> Column:
    def changed(parts: Column) -> Column:
        moved = feistel(parts, F.array_repeat(F.lit(256), 4), key, "ipv4")
        return F.when(F.forall(parts, lambda p: p < 256), F.array_join(F.transform(moved, lambda p: p.cast("string")), ".")).otherwise(m)

    return let(F.transform(F.split(m, r"\."), lambda p: p.cast("int")), changed)


def _date(m: Column, key: str) -> Column:
    """Year first; between slashes or hyphens month first, or else day first; between dots day first.

    A day first that no month can be is permuted among such days, so that both readings stay apart. What is
    no day of 1800 to 2199 stays.
    """

    def day_of(form: str) -> Column:
        return F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))

    def written(day: Column, padded: str) -> Column:
        # the widths of day and month are those found
        wide = m.rlike(r"^(?:\d{4}|\d{2}\D\d{2}\D)")
        return F.when(wide, F.date_format(day, padded)).otherwise(F.date_format(day, padded.replace("MM", "M").replace("dd", "d")))

    out = F.lit(None).cast("string")
    for sign, start in (("-", "-"), ("/", "/"), (".", r"\.")):
        month, day = f"MM{sign}dd{sign}yyyy", f"dd{sign}MM{sign}yyyy"
        narrow = lambda form: form.replace("MM", "M").replace("dd", "d")
        late = written(_moved_late_day(day_of(narrow(day)), key), day)
        dayfirst = written(_moved_day(day_of(narrow(day)), key), day)
        monthfirst = F.coalesce(written(_moved_day(day_of(narrow(month)), key), month), late)
        out = F.when(m.rlike(rf"^\d{{1,2}}{start}"), dayfirst if sign == "." else monthfirst).otherwise(out)
        if sign != ".":
            year = f"yyyy{sign}MM{sign}dd"
            out = F.when(m.rlike(rf"^\d{{4}}{start}"), F.date_format(_moved_day(day_of(year), key), year)).otherwise(out)
    return F.coalesce(out, m)


def _moved(day: Column, days: int, radix: tuple[int, int], key: str, kind: str, use: Callable[[Column], Column]) -> Column:
    """``use`` of the number below ``days`` that ``day`` is permuted to; null for others."""

    def moved(d: Column) -> Column:
        values = F.array(F.floor(d / radix[1]).cast("int"), (d % radix[1]).cast("int"))
        new = let(values, lambda v: feistel(v, F.array(*map(F.lit, radix)), key, kind))
        number = let(new, lambda v: F.get(v, F.lit(0)) * radix[1] + F.get(v, F.lit(1)))
        return F.when((d >= 0) & (d < days), let(number, use))

    return let(day, moved)


def _moved_day(day: Column, key: str) -> Column:
    return _moved(day, DAYS, DAY_RADIX, key, "date", lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n))


def _moved_late_day(day: Column, key: str) -> Column:
    """Days after the 12th of a month, numbered among themselves."""
    first = F.lit(FIRST_DAY).cast("date")
    date = F.date_add(first, day)
    months = (F.year(date) - int(FIRST_DAY[:4])) * 12 + F.month(date) - 1
    number = F.when(F.dayofmonth(date) > 12, day - 12 * (months + 1))

    def before(month: Column) -> Column:
        return F.datediff(F.add_months(first, month), first) - 12 * month

    def date_of(n: Column) -> Column:
        # the lengths of months add up to their mean with less than a month's difference
        guess = F.floor(n * 4_800 / LATE_DAYS).cast("int")
        near = F.filter(F.sequence(F.greatest(guess - 2, F.lit(0)), guess + 2), lambda k: before(k) <= n)
        return let(F.array_max(near), lambda k: F.date_add(F.add_months(first, k), n - before(k) + 12))

    return _moved(number, LATE_DAYS, LATE_RADIX, key, "late date", date_of)


def _national(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups and serial numbers above zero; others stay."""

    def changed(parts: Column) -> Column:
        area, group, serial = (F.get(parts, F.lit(i)) for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
        new = let(values, lambda v: feistel(v, F.array(*map(F.lit, NATIONAL_RADIX)), key, "national"))
        area_of = lambda x: x + F.when(x >= 665, 2).otherwise(1)
        text = let(new, lambda v: F.format_string("%03d-%02d-%04d", area_of(F.get(v, F.lit(0))), F.get(v, F.lit(1)) + 1, F.get(v, F.lit(2)) + 1))
        return F.when(valid, text).otherwise(m)

    return let(F.transform(F.split(m, "-"), lambda p: p.cast("int")), changed)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of an account number whose letters count 10 to 35."""

    def joined(t: Column) -> Column:
        codes = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.ascii(F.substr(t, i, F.lit(1))))
        return F.aggregate(codes, F.lit(0), lambda a, c: F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97).cast("int"))

    return let(text, joined)


def _iban(m: Column, key: str) -> Column:
    """The account permuted, the check digits made valid again; country and blanks stay."""
    country, account = F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(5), F.length(m))
    bare = lambda a: F.regexp_replace(a, " ", "")

    def changed(new: Column) -> Column:
        check = F.lit(98) - _mod97(F.concat(bare(new), country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

    valid = _mod97(F.concat(bare(account), F.substr(m, F.lit(1), F.lit(4)))) == 1
    return F.when(valid & F.length(bare(m)).between(15, 34), let(scrambled(account, key, "iban"), changed)).otherwise(m)


def _behind(m: Column, fixed: str, key: str, kind: str) -> Column:
    """What follows the fixed beginning is permuted."""
    return let(F.regexp_extract(m, fixed, 0), lambda h: F.concat(h, scrambled(F.substr(m, F.length(h) + 1, F.length(m)), key, kind)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value; a value that is not valid stays as it is."""
    whole = lambda form: m.rlike(f"^(?:{form})$")
    count = F.length(_digits(m))
    phone = F.when(count.between(7, 15), _behind(m, r"^\+\d{1,3}(?=[ .(-])|^", key, "phone")).otherwise(m)
    at = F.instr(m, "@")
    email = F.concat(scrambled(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at, F.length(m)))
    return (
        F.when(at > 0, email)
        .when(whole(IPV4), _ipv4(m, key))
        .when(whole(DATE), _date(m, key))
        .when(whole(NATIONAL), _national(m, key))
        .when(whole(IBAN), _iban(m, key))
        .when(whole(CARD), _card(m, key))
        .when(whole(PHONE), phone)
        .when(whole(ACCESS_KEY), _behind(m, "^AKIA", key, "access key"))
        .otherwise(_behind(m, "^password=", key, "password"))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced in ``text``, and ``n_values``, the number of values changed.

    Found are e-mail addresses (the local part is replaced), IPv4 addresses with parts up to 255, dates of 1800
    to 2199 (year first, month first or day first), payment card numbers that pass the Luhn test, account numbers
    (IBAN) that pass theirs, national numbers of three groups, telephone numbers of 7 to 15 digits, access keys
    and passwords. Each is permuted within its format by a Feistel network with round hashes of ``key``: digits
    stay digits, letters letters, cards valid, dates dates, and equal values get equal pseudonyms in every
    document. Everything runs in the JVM, row by row, without a shuffle; a row without a digit, "@" or
    "password=" is passed on after one scan.

    Cases: a null text stays null with 0 values; text around values is not changed; what has the form of a
    value but is not valid stays; an input column named ``n_values`` is replaced.
    """
    text = F.col(f"`{text_col}`")
    pieces, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    rows = docs.select(*without(docs, "n_values"), F.when(text.rlike(HINT), found).alias("__found"))
    rows = rows.withColumn("__new", F.transform("__found", lambda m: pseudonym(m, key)))
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.concat("__new", F.array(F.lit(""))), lambda p, m: F.array(p, m))), "")
    changed = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda x: x))
    some = F.size("__found") > 0
    made = F.when(some, joined).otherwise(text)
    same = [made.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_values"]
    return rows.select(*same, F.when(some, changed).otherwise(0).cast("long").alias("n_values"))


@query("op5_feistel_pseudonyms")
def feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="corpus")
