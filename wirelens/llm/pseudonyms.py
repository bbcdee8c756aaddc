"""Format-preserving pseudonyms for personal numbers and dates.

Card numbers, bank accounts, telephone and social security numbers, network addresses, dates and the local parts of mail
addresses are found by pattern, validated (check digits, ranges, calendar), and replaced by another valid value of the
same format. The replacement is a keyed permutation of the format's values, a Feistel network over the value's
characters whose round function is SHA-256: each round shifts the characters of one half, within their class, by a
stream made from the key, the kind and the other half. Where not every string of the format is valid, the permutation is
walked on until a valid value comes (which stays a permutation of the valid ones). So equal values stay equal across
documents and layouts, different ones stay different, and whoever holds the key can go back.

All of it is DataFrame functions; texts never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import fresh

ROUNDS = 8
#: Steps of a walk at most; the least share of valid strings in a format is 0.28, so a walk is shorter but once in 10**28.
#: A longer one is an error: no invalid value is given out.
WALK = 200
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31

_L, _R = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _R
IBAN = _L + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _R
CARD = _L + r"[0-9](?:[ -]?[0-9]){12,18}" + _R
NATIONAL = r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}" + _R
ABROAD = r"(?<![0-9A-Za-z+])\+[2-9][0-9](?:[ .-]?[0-9]){7,11}" + _R
SOCIAL = _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R
ISO_DATE = _L + r"[0-9]{4}-[0-9]{2}-[0-9]{2}" + _R
SLASH_DATE = _L + r"[0-9]{2}/[0-9]{2}/[0-9]{4}" + _R
DOT_DATE = _L + r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}" + _R
ADDRESS = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
ANY = "|".join([MAIL, IBAN, ABROAD, NATIONAL, SOCIAL, CARD, ISO_DATE, SLASH_DATE, DOT_DATE, ADDRESS])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then looks at it."""
    return F.transform(F.array(value), then)[0]


def _chars(n: Column) -> Column:
    return F.sequence(F.lit(1), n)


def _shift(half: Column, stream: Column, back: bool = False) -> Column:
    """Each digit and letter of half moved on (or back) in its class by the stream's next four hex digits."""

    def within(c: Column, k: Column, base: int, n: int) -> Column:
        at = F.ascii(c) - base
        return F.char(F.lit(base) + (F.pmod(at - k, F.lit(n)) if back else (at + k) % n))

    def moved(c: Column, k: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), within(c, k, 48, 10)).when(c.rlike("^[a-z]$"), within(c, k, 97, 26)).when(c.rlike("^[A-Z]$"), within(c, k, 65, 26)).otherwise(c)

    def whole(s: Column) -> Column:
        steps = F.transform(_chars(F.length(half)), lambda i: F.conv(s.substr((i - 1) % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int"))
        return F.array_join(F.zip_with(F.split(half, ""), steps, moved), "")

    return F.when(F.length(half) > 0, let(stream, whole)).otherwise("")


def feistel(value: Column, kind: str, key: str, back: bool = False) -> Column:
    """The value's place under the keyed permutation of all strings with its length and character classes."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(value.substr(F.lit(1), half).alias("l"), value.substr(half + 1, F.length(value)).alias("r"))

    def stream(n: Column, other: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), n.cast("string"), F.lit("|"), other), 256)

    def forth(acc: Column, n: Column) -> Column:
        return F.struct(acc["r"].alias("l"), _shift(acc["l"], stream(n, acc["r"])).alias("r"))

    def undo(acc: Column, n: Column) -> Column:
        return F.struct(_shift(acc["r"], stream(n, acc["l"]), back=True).alias("l"), acc["l"].alias("r"))

    turns = F.array(*map(F.lit, range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)))
    return F.aggregate(turns, start, undo if back else forth, lambda acc: F.concat(acc["l"], acc["r"]))


def walk(value: Column, kind: str, key: str, valid: Callable[[Column], Column], back: bool = False) -> Column:
    """feistel() again and again until the value is valid: a permutation of the valid values."""
    step = lambda x: feistel(x, kind, key, back)
    turns = F.sequence(F.lit(1), F.lit(WALK))
    found = F.aggregate(turns, step(value), lambda acc, _: F.when(valid(acc), acc).otherwise(step(acc)))
    return let(found, lambda x: F.when(valid(x), x).otherwise(F.raise_error(F.lit("no valid value within WALK steps")).cast("string")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _relay(m: Column, new_value: Column, kind: str) -> Column:
    """m with its characters of a class replaced, in order, by those of new."""

    def put(acc: Column, i: Column, new: Column) -> Column:
        c = m.substr(i, F.lit(1))
        return F.when(c.rlike(kind), F.struct(F.concat(acc["out"], new.substr(acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))

    return let(new_value, lambda new: F.aggregate(_chars(F.length(m)), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda acc, i: put(acc, i, new), lambda acc: acc["out"]))


def luhn_sum(digits: Column) -> Column:
    """Check sum of a card number, 0 modulo 10 if valid."""

    def whole(x: Column) -> Column:
        each = F.transform(F.reverse(F.split(x, "")), lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)))
        return F.aggregate(each, F.lit(0), lambda acc, d: acc + d)

    return let(digits, whole)


def mod97(text: Column) -> Column:
    """A bank account's check: its first four characters moved to the end, letters as 10 to 35, modulo 97."""

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return let(text, lambda x: F.aggregate(F.split(F.concat(x.substr(F.lit(5), F.length(x)), x.substr(1, 4)), ""), F.lit(0), add))


def _area_ok(d: Column) -> Column:
    return d.rlike("^[2-9][0-9]{2}[2-9]")


def _social_ok(d: Column) -> Column:
    return ~d.rlike("^(000|666|9)|^...00|0000$")


def _date(m: Column) -> Column:
    """The date that m writes, null if there is none; month first between slashes where both readings are dates."""
    read = lambda f: F.try_to_timestamp(m, F.lit(f)).cast("date")
    found = F.when(m.rlike(f"^{ISO_DATE}$"), read("yyyy-MM-dd")).when(m.rlike(f"^{DOT_DATE}$"), read("dd.MM.yyyy")).otherwise(F.coalesce(read("MM/dd/yyyy"), read("dd/MM/yyyy")))
    days = F.date_diff(found, F.lit(FIRST_DAY).cast("date"))
    return F.when((days >= 0) & (days < DAYS), days)


def _date_like(m: Column, days: Column) -> Column:
    month_first = F.try_to_timestamp(m, F.lit("MM/dd/yyyy")).isNotNull()
    return let(F.date_add(F.lit(FIRST_DAY).cast("date"), days.cast("int")), lambda d: F.when(m.rlike("-"), F.date_format(d, "yyyy-MM-dd")).when(m.rlike(r"\."), F.date_format(d, "dd.MM.yyyy")).when(month_first, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy")))


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("long"))


def _address_like(number: Column) -> Column:
    return let(number.cast("long"), lambda n: F.concat_ws(".", *[(F.shiftright(n, k).bitwiseAND(F.lit(255))).cast("string") for k in (24, 16, 8, 0)]))


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """kind and value for a match of ANY: its replacement, or a null kind and the match itself if it isn't valid.

    back: from a replacement to the value that it stands for.
    """
    d = _digits(m)
    flat = F.replace(m, F.lit(" "), F.lit(""))
    go = lambda x, kind, valid=None: walk(x, kind, key, valid, back) if valid else feistel(x, kind, key, back)

    inner = d.substr(F.lit(2), F.length(d) - 2)
    card = let(F.concat(d.substr(1, 1), go(inner, "card")), lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

    country = flat.substr(1, 2)
    account = let(go(flat.substr(F.lit(5), F.length(flat)), "iban"), lambda x: F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), x))).cast("string"), 2, "0"), x))

    ten = F.right(d, F.lit(10))
    national = F.concat(d.substr(F.lit(1), F.length(d) - 10), go(ten, "phone", _area_ok))
    abroad = F.concat(d.substr(1, 2), go(d.substr(F.lit(3), F.length(d)), "abroad"))

    # days after the 12th stay so: between slashes they tell which number is the month, so both readings keep apart
    late = lambda days: F.dayofmonth(F.date_add(F.lit(FIRST_DAY).cast("date"), days.cast("int"))) > 12
    days = let(_date(m), lambda day: go(F.lpad(day.cast("string"), 5, "0"), "date", lambda x: (x.cast("int") < DAYS) & (late(x) == late(day))))
    o = _octets(m)
    number = F.lpad((((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]).cast("string"), 10, "0")
    address = go(number, "address", lambda x: x.cast("long") < 2**32)

    at = F.instr(m, "@")
    mail = F.concat(go(m.substr(F.lit(1), at - 1), "mail"), m.substr(at, F.length(m)))

    is_a = lambda pattern: m.rlike(f"^(?:{pattern})$")
    told = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return (
        F.when(is_a(MAIL), told("mail", mail))
        .when(is_a(ABROAD), told("phone", _relay(m, abroad, "[0-9]")))
        .when(is_a(NATIONAL) & _area_ok(ten), told("phone", _relay(m, national, "[0-9]")))
        .when(is_a(SOCIAL) & _social_ok(d), told("social", _relay(m, go(d, "social", _social_ok), "[0-9]")))
        .when(is_a(IBAN) & (mod97(flat) == 1), told("account", _relay(m, account, "[0-9A-Z]")))
        .when(is_a(CARD) & (luhn_sum(d) % 10 == 0), told("card", _relay(m, card, "[0-9]")))
        .when(is_a(f"{ISO_DATE}|{SLASH_DATE}|{DOT_DATE}") & _date(m).isNotNull(), told("date", _date_like(m, days)))
        .when(is_a(ADDRESS) & F.forall(o, lambda x: x < 256), told("address", _address_like(address)))
        .otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))
    )


def pseudonymize(docs: DataFrame, key: str, back: bool = False) -> tuple[DataFrame, str]:
    """docs with text replaced, and a column (whose name is returned) of the found kinds and their new values, in order.

    Null and empty texts stay as they are, with nothing found. Values that fail their validation stay. Other columns
    are kept, whatever their names; repeated rows are treated alike.
    """
    text = F.col("text")
    raw, gaps, name = fresh("raw", docs.columns), fresh("gaps", docs.columns), fresh("pseudonyms", docs.columns)
    likely = text.rlike("@|[0-9][0-9 ().-]{5}|[0-9]/[0-9]")
    split = docs.withColumns({
        raw: F.when(likely, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, key, back))),
        gaps: F.when(likely, F.split(text, ANY, -1)),
    })
    values = F.concat(F.transform(F.col(raw), lambda x: x["value"]), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.col(gaps), values, lambda gap, value: F.concat(gap, value)), "")
    found = F.coalesce(F.filter(F.col(raw), lambda x: x["kind"].isNotNull()), F.array().cast("array<struct<kind:string,value:string>>"))
    done = split.withColumns({"text": F.when(F.size(F.col(raw)) > 0, whole).otherwise(text), name: found})
    return done.drop(raw, gaps), name


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (replaced), n_found and found (kind and new value, in order) of every document."""
    done, name = pseudonymize(docs.select("doc_id", "text"), key)
    return done.select("doc_id", "text", F.size(F.col(name)).cast("long").alias("n_found"), F.col(name).alias("found"))
