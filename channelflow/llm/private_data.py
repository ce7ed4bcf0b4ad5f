"""Private data as format-preserving Feistel pseudonyms, by DataFrame functions only.

Validated numbers and dates go through keyed Feistel permutations of the very values that their format allows: card numbers keep
the Luhn rule, addresses and telephone numbers stay such, dates stay days of 1900 to 2099. Names of mail boxes and secrets
are permuted within their letters and digits. Equal values get equal pseudonyms in all documents, unequal ones unequal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

ROUNDS = 6

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FORMS = {
    "mail": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"(?i:\b(?:token|password|passwd|pwd|secret|api_key|apikey|access_key)) {0,2}[=:] {0,2}[\"']?[A-Za-z0-9_+/-]{8,}",
    "hex": r"\b(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,128}\b",
    "address": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "date": r"(?<![\d/.-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d?/\d\d?/(?:19|20)\d\d|\d\d?\.\d\d?\.(?:19|20)\d\d)(?![\d/-]|\.\d)",
    "social": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\b\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d)",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])",
}
ANY = "|".join(f"(?:{form})" for form in FORMS.values())
# What card numbers of the large issuers begin with, and how long they are.
ISSUED = r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[0-8]\d{10,17}|6\d{11,18}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3[05689]\d{12,17})$"
#: A cheap test that any text with a match passes.
HINT = r"@|\d\.\d|\d-\d|\d[-/ )]|\d{8}|AKIA|[=:] {0,2}[\"']?[A-Za-z0-9_+/-]{8}|[0-9a-f]{32}"


def keyed(key: str, *parts: Column | str | int) -> Column:
    """A keyed hash of the parts: 64 hexadecimal digits."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws("|", F.lit(key), *texts), 256)


def number_of(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, 12), 16, 10).cast("long")


def in_pair(left: Column, right: Column, lefts: int, rights: int, key: str, kind: str, use) -> Column:
    """use(left, right) of the Feistel permutation of pairs of numbers, left below `lefts` and right below `rights`."""
    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    done = F.aggregate(
        F.array(*[F.lit(i) for i in range(ROUNDS)]),
        state,
        lambda s, i: F.when(i % 2 == 0, F.struct(F.pmod(s["l"] + number_of(keyed(key, kind, i, s["r"])), F.lit(lefts).cast("long")).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), F.pmod(s["r"] + number_of(keyed(key, kind, i, s["l"])), F.lit(rights).cast("long")).alias("r"))
        ),
    )
    return F.transform(F.array(done), lambda s: use(s["l"], s["r"]))[0]


def shifted(text: Column, hexadecimal: Column, letters: Column) -> Column:
    """Each digit, small and capital letter moved on within its kind, by the bytes of the hash; other characters stay."""

    def one(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        code = F.ascii(c)
        by = F.conv(F.substr(hexadecimal, (2 * (i - 1)) % 62 + 1, F.lit(3)), 16, 10).cast("int")
        moved = lambda first, size: F.char((F.pmod(code - first + by, size) + first).cast("int"))
        return F.when(c.rlike("^[0-9]$"), moved(48, F.lit(10))).when(c.rlike("^[a-z]$"), moved(97, letters)).when(c.rlike("^[A-Z]$"), moved(65, F.lit(26))).otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise("")


def permuted_text(text: Column, key: str, kind: str) -> Column:
    """Feistel over the halves of a text, within letters and digits. The alphabet is the kind's, whatever a text holds, so all texts of a kind and form are permuted among themselves."""
    letters = F.lit(6 if kind == "hex" else 26)
    half = (F.length(text) / 2).cast("int")
    state = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))
    done = F.aggregate(
        F.array(*[F.lit(i) for i in range(ROUNDS)]),
        state,
        lambda s, i: F.when(i % 2 == 0, F.struct(shifted(s["l"], keyed(key, kind, i, s["r"]), letters).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), shifted(s["r"], keyed(key, kind, i, s["l"]), letters).alias("r"))
        ),
    )
    return F.when(F.length(text) < 2, shifted(text, keyed(key, kind, "short"), letters)).otherwise(F.transform(F.array(done), lambda s: F.concat(s["l"], s["r"]))[0])


def luhn_digit(payload: Column) -> Column:
    """The digit that makes the number valid."""
    n = F.length(payload)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + F.transform(F.array(F.substr(payload, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)), lambda d: F.when(d > 9, d - 9).otherwise(d))[0],
    )
    return F.pmod(-total, F.lit(10))


def refilled(form: Column, digits: Column) -> Column:
    """The digits put in place of those in form, whose other characters stay."""
    places = F.sequence(F.lit(1), F.length(form))
    nth = lambda i: F.length(F.regexp_replace(F.substr(form, F.lit(1), i), r"\D", ""))
    return F.array_join(F.transform(places, lambda i: F.when(F.substr(form, i, F.lit(1)).rlike(r"^\d$"), F.substr(digits, nth(i), F.lit(1))).otherwise(F.substr(form, i, F.lit(1)))), "")


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def card(m: Column, key: str) -> Column:
    """Only numbers that an issuer gives out and that hold the Luhn rule; the pseudonym holds it too. The first four digits, the issuer's, stay."""

    def of(d: Column) -> Column:
        payload = F.substr(d, F.lit(1), F.length(d) - 1)
        new = lambda p: F.concat(p, luhn_digit(p).cast("string"))
        swapped = F.concat(F.substr(payload, F.lit(1), F.lit(4)), permuted_text(F.substr(payload, F.lit(5), F.length(payload)), key, "card"))
        valid = d.rlike(ISSUED) & (luhn_digit(payload) == F.substr(d, F.length(d), F.lit(1)).cast("int")) & ~d.rlike(r"^(\d)\1*$")
        return F.when(valid, refilled(m, bound(swapped, new))).otherwise(m)

    return bound(F.regexp_replace(m, r"\D", ""), of)


def address(m: Column, key: str) -> Column:
    """Any four numbers up to 255."""
    o = F.split(m, r"\.")
    part = lambda i: F.element_at(o, i).cast("long")
    return in_pair(part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536, key, "address", lambda a, b: F.concat_ws(".", F.floor(a / 256), a % 256, F.floor(b / 256), b % 256))


def date(m: Column, key: str) -> Column:
    """Days from 1900 to 2099: 17 * 4297 of them. With strokes, the month comes first if that makes a date; with points, the day."""
    p = F.split(m, r"[-/.]")
    at = lambda i: F.element_at(p, i)
    made = lambda y, mo, d: F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    iso, month_first = m.contains("-"), made(at(3), at(1), at(2))
    american = m.contains("/") & month_first.isNotNull()
    value = F.when(iso, made(at(1), at(2), at(3))).when(american, month_first).otherwise(made(at(3), at(2), at(1)))

    def write(left: Column, right: Column) -> Column:
        day = F.date_add(F.lit("1900-01-01").cast("date"), (left * 4297 + right).cast("int"))
        short = lambda number, like: F.when(F.length(like) == 1, number.cast("string")).otherwise(F.lpad(number.cast("string"), 2, "0"))
        joined = F.when(m.contains("/"), "/").otherwise(".")
        month_day = F.concat(short(F.month(day), at(1)), joined, short(F.dayofmonth(day), at(2)), joined, F.year(day))
        day_month = F.concat(short(F.dayofmonth(day), at(1)), joined, short(F.month(day), at(2)), joined, F.year(day))
        return F.when(iso, F.date_format(day, "yyyy-MM-dd")).when(american, month_day).otherwise(day_month)

    number = F.datediff(value, F.lit("1900-01-01").cast("date")).cast("long")
    return F.when(value.isNull(), m).otherwise(in_pair(F.floor(number / 4297), number % 4297, 17, 4297, key, "date", write))


def social(m: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group from 01, serial from 0001."""
    p = F.split(m, "-")
    area, group, serial = (F.element_at(p, i).cast("long") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)

    def write(left: Column, right: Column) -> Column:
        a = F.floor(left / 99) + 1
        return F.concat_ws("-", F.lpad(F.when(a >= 666, a + 1).otherwise(a).cast("string"), 3, "0"), F.lpad((left % 99 + 1).cast("string"), 2, "0"), F.lpad((right + 1).cast("string"), 4, "0"))

    index = F.when(area > 666, area - 2).otherwise(area - 1)
    return F.when(valid, in_pair(index * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "social", write)).otherwise(m)


def phone(m: Column, key: str) -> Column:
    """The last ten digits, or of numbers without groups all but the first two, change; the country and the form stay."""

    def of(d: Column) -> Column:
        kept = F.when(F.length(d) > 10, F.length(d) - 10).when(F.length(d) == 10, 0).otherwise(2)
        return refilled(m, F.concat(F.substr(d, F.lit(1), kept), permuted_text(F.substr(d, kept + 1, F.length(d)), key, "phone")))

    return bound(F.regexp_replace(m, r"\D", ""), of)


def mail(m: Column, key: str) -> Column:
    """The box's name changes, its domain stays."""
    return F.concat(permuted_text(F.substring_index(m, "@", 1), key, "mail"), F.lit("@"), F.substring_index(m, "@", -1))


def secret(m: Column, key: str) -> Column:
    """What stands after the name and its sign changes."""
    name = F.regexp_extract(m, r"^[A-Za-z_]+ *[=:] *[\"']?", 0)
    return F.concat(name, permuted_text(F.substr(m, F.length(name) + 1, F.length(m)), key, "secret"))


RULES = {
    "mail": mail,
    "key": lambda m, key: F.concat(F.lit("AKIA"), permuted_text(F.substr(m, F.lit(5), F.lit(16)), key, "key")),
    "secret": secret,
    "hex": lambda m, key: permuted_text(m, key, "hex"),
    "address": address,
    "date": date,
    "social": social,
    "phone": phone,
    "card": card,
}


def pseudonym(m: Column, key: str) -> Column:
    """(kind, text) of a match's pseudonym; kind is null where the value isn't valid, and the text then stays."""

    def made(kind: str) -> Column:
        return bound(RULES[kind](m, key), lambda t: F.struct(F.when(t != m, F.lit(kind)).alias("kind"), t.alias("text")))

    chosen = F
    for kind, form in FORMS.items():
        chosen = chosen.when(m.rlike(f"^(?:{form})$"), made(kind))
    return chosen.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with private values in text replaced by pseudonyms under the key; adds private array<string>, the kinds found in text order.

    Whole texts are searched in one pass each; what stands between matches is kept as it is. A null text stays null with no kinds, an
    empty one empty. Values that their rule finds invalid (a Luhn sum, no issuer's number, a day that doesn't exist) stay. Columns keep
    their names and order; one named private is replaced. Rows are changed where they are read, without a shuffle.
    """
    columns = [c for c in docs.columns if c != "private"]
    none = F.array().cast("array<string>")
    text = F.col("row")["text"]
    found = F.coalesce(F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none), none)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).withColumn("found", found)
    made = F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key))).otherwise(F.expr("cast(array() as array<struct<kind: string, text: string>>)"))
    rows = rows.select("row", made.alias("made"))
    gaps = F.split(text, ANY, -1)
    woven = F.concat(F.array_join(F.transform("made", lambda x, i: F.concat(F.get(gaps, i), x["text"])), ""), F.get(gaps, F.size("made")))
    kinds = F.transform(F.filter("made", lambda x: x["kind"].isNotNull()), lambda x: x["kind"])
    rows = rows.select("row", F.struct(F.when(F.size("made") > 0, woven).otherwise(text).alias("text"), kinds.alias("private")).alias("new"))
    return rows.select(*[F.col("new")[c].alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns], F.col("new")["private"].alias("private"))
