"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions only.

One pattern finds candidates. A run of digits and separators may hold several
values next to other numbers: the kinds are tried at each of its tokens, by their
lengths and groups, and each is validated. Valid numbers and dates are permuted
by a keyed Feistel network within their own format:

* card: all digits but the last are permuted, then the Luhn digit is set anew;
* phone: the digits after the country code; social security number: all digits;
* IPv4 address: its 32 bits; IBAN: the digits of the account, then its check digits;
* date: its day among 270 * 270 days, written the way it was. Dates with slashes
  are read month first if the second number is above 12, else day first; those
  that read either way are permuted among themselves, and so are those of the
  two others, so what is written reads the way it was made.

Separators stay in place. A permutation has no two values of a format share a
pseudonym, and the key and format alone decide it, so equal values stay linked
across documents and nothing is kept or shuffled. E-mail addresses, keys and passwords have no
numeric format; they get a keyed digest in their own alphabet, linked as well.
What fails validation (a number with a wrong Luhn digit, 31 February, octets
over 255) is no personal data and stays.

A text is cut at the matches and put together again with their pseudonyms, so
only matched places change. Cheap tests tell which of four groups of kinds a text
may hold; the pattern it is searched with has those alone, and a text that may
hold none is not searched.

The key is ``spark.threadloom.pii.key`` or an argument; there is no default,
because whoever knows the key can undo the permutations.

Results at the edges: a null text stays null with 0 replacements; an empty text
stays empty; very long texts are searched whole; dates before the year 104 or
after 9882 stay; a mail address has at most 127 labels; repeated rows get equal
results; no column but the kept ones and the text is read, whatever its name; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ROUNDS = 8

#: Where the key is set.
KEY_SETTING = "spark.threadloom.pii.key"

#: The key of the registered query where none is set: an open one, for tests and comparisons only.
OPEN_KEY = "open test key"

#: Dates are permuted among the square of this many days, in blocks counted from 1900-01-01.
DATE_SIDE = 270

#: The first and the last block that lies within the years 1 to 9999.
FIRST_BLOCK, LAST_BLOCK = -9, 39

#: Steps of a walk back into a class of dates; each is the last with a chance of 2 in 5 or more.
WALK = 200

_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

_END = _NO_WORD_AFTER

#: Length of an IBAN: its countries (the registry, and countries that use the format without being in it).
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BF BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}

_IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()) + ")" + _END

#: Kinds without a validation: pattern, in order of precedence.
PLAIN = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[A-Za-z0-9\-]{1,63}\.){1,126}[A-Za-z]{2,}",
    "secret": _NO_WORD_BEFORE + r"(?i:password|passwd|pwd|secret|token|api[_\-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9_/+\-]{8,}",
    "access_key": _NO_WORD_BEFORE + r"AKIA[0-9A-Z]{16}" + _NO_WORD_AFTER,
    "hex_key": _NO_WORD_BEFORE + r"(?=[0-9a-f]{0,63}[0-9])(?=[0-9a-f]{0,63}[a-f])[0-9a-f]{32,64}" + _NO_WORD_AFTER,
}

# a run of digits and separators up to the end of a token, and one that an IBAN leads; they hold
# any number of values, and an address or a named secret after them isn't part of them
_RUN_END = r"[0-9](?:T(?=[0-9])|(?![\p{L}\p{N}_])(?![\p{L}\p{N}._%+\-]{0,64}+@))"
_RUN = r"(?:(?<![\p{L}\p{N}_+])[+(]|[.\-]|(?<![\p{L}\p{N}_]))[0-9][0-9 .\-()/+]{5,}" + _RUN_END
_LED = _NO_WORD_BEFORE + _IBAN + r"(?!(?<=PASSWORD|PASSWD|PWD|SECRET|TOKEN|APIKEY|API)[\"'=: \-])(?:[0-9 .\-()/+]*" + _RUN_END + ")?"
#: Groups of kinds that are looked for together, in order of precedence.
GROUPS = {"email": [PLAIN["email"]], "secret": [PLAIN["secret"]], "key": [PLAIN["access_key"], PLAIN["hex_key"]], "run": [_LED, _RUN]}


def any_of(groups: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for g in groups for p in GROUPS[g])


#: Kind, what must not stand before, pattern; the first valid one at a place is taken. A card's usual
#: groups and unbroken numbers come before its other lengths; of phones the shortest with enough digits,
#: and after one in short groups those short groups that may belong to it.
_MORE = r"(?:(?<=[ .\-][0-9]{2,4})(?:[ .\-](?![0-9]{4}(?:[ \-][0-9]{4}){3}(?![0-9]))[0-9]{2,4}(?![\p{L}\p{N}_])){1,2})"
_ABROAD = r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4})"
INSIDE = [
    ("access_key", "[0-9A-Za-z]", r"AKIA[0-9A-Z]{16}" + _END),
    ("iban", "[0-9A-Za-z]", _IBAN),
    ("ip", "[0-9A-Za-z.]", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[\p{L}\p{N}_])"),
    ("date", "[0-9A-Za-z]", r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?:(?=T)|" + _END + ")"),
    ("ssn", "[0-9A-Za-z\\-]", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_\-])"),
    ("phone", "[0-9A-Za-z+]", r"(?:\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})" + _END),
    *[("phone", "[0-9A-Za-z+]", _ABROAD + f"{{{k}}}" + _END + more) for k in range(1, 5) for more in (_MORE, _MORE.replace("{1,2}", "{1}"), "")],
    *[("card", "[0-9A-Za-z]", p + _END) for p in (r"[0-9]{4}(?:[ \-][0-9]{4}){3}", r"[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}", r"[0-9]{13,19}")],
    *[("card", "[0-9A-Za-z]", rf"[0-9](?:[ \-]?[0-9]){{{n - 1}}}" + _END) for n in range(19, 12, -1)],
]

#: Longer than any value of INSIDE with what follows it.
WINDOW = 64


def bound(value: Column, body) -> Column:
    """``body`` of a value that is made once."""
    return F.transform(F.array(value), body)[0]


#: What names a secret; a text without a digit or an @ can only hold one of these.
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "api")


def may_hold(text: Column) -> dict[str, Column]:
    """By group, true for every text in which a pattern of the group can match."""
    low, named = F.lower(text), F.lit(False)
    for name in SECRET_NAMES:
        named = named | F.contains(low, F.lit(name))
    return {
        "email": F.contains(text, F.lit("@")),
        "secret": (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & named,
        "key": F.contains(text, F.lit("AKIA")) | text.rlike("[0-9a-f]{32}"),
        "run": text.rlike(r"[0-9][0-9 .\-()/+]{5}|[A-Z][A-Z][0-9][0-9] ?[A-Z0-9] ?[A-Z0-9]"),
    }


#: Stands around matches while a text is cut; texts that have it are cut another way.
MARK = "\ufdd0"


def pieces(text: Column) -> Column:
    """The text cut at the matches: what is between them at even places, matches at odd ones; null if there can be none."""
    none = F.lit(None).cast("array<string>")
    out = none
    held = may_hold(text)
    names = list(GROUPS)

    def cut_by(pattern: str) -> Column:
        marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
        gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        two = F.flatten(F.zip_with(gaps, found, lambda g, m: F.array_compact(F.array(g, m))))
        return F.when(F.contains(text, F.lit(MARK)), two).otherwise(marked)

    # one search with the groups that the text may hold; the flags are made once, as a number
    which = sum((F.when(held[n], 2**i).otherwise(0) for i, n in enumerate(names)), F.lit(0))

    def choose(w: Column) -> Column:
        chosen = F.when(w == 0, none)
        for k in range(1, 2 ** len(names)):
            chosen = chosen.when(w == k, cut_by(any_of(tuple(n for i, n in enumerate(names) if k >> i & 1))))
        return chosen

    return out if not names else bound(which, choose)


# --- keyed functions --------------------------------------------------------


def keyed(key: Column, *parts: Column) -> Column:
    """Hex digest of key and parts; the parts are of fixed form, so bars keep them apart."""
    return F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256)


def feistel(key: Column, tag: Column, left: Column, right: Column, left_mod: Column, right_mod: Column) -> Column:
    """struct(left, right) of a keyed permutation of pairs in left_mod x right_mod.

    Each round adds a keyed function of one half to the other, modulo the size
    of that half's place, and swaps them; an even number of rounds puts both
    halves back to their own places.
    """

    def turn(acc: Column, i: Column) -> Column:
        mod = F.when(i % 2 == 0, left_mod).otherwise(right_mod)
        f = F.conv(F.substring(keyed(key, tag, i, acc["b"]), 1, 15), 16, 10).cast("bigint")
        return F.struct(acc["b"].alias("a"), F.pmod(acc["a"] + f, mod).alias("b"))

    start = F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def power_of_ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("bigint")


def permute_digits(key: Column, tag: str, digits: Column) -> Column:
    """A string of 2 to 18 digits as another of the same length."""

    def permuted(x: Column) -> Column:
        d, n, low, high = x["d"], F.length(x["d"]), x["low"], F.length(x["d"]) - x["low"]
        done = feistel(key, F.concat(F.lit(tag), n), d.substr(F.lit(1), high).cast("bigint"), d.substr(high + 1, low).cast("bigint"), power_of_ten(high), power_of_ten(low))
        return bound(done, lambda y: F.concat(F.lpad(y["a"].cast("string"), high, F.lit("0")), F.lpad(y["b"].cast("string"), low, F.lit("0"))))

    return bound(F.struct(digits.alias("d"), F.floor(F.length(digits) / 2).cast("int").alias("low")), permuted)


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def put_digits(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(acc["out"], F.when(is_digit, digits.substr(acc["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, acc["at"] + 1).otherwise(acc["at"]).alias("at")
        )

    return F.aggregate(characters(form), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step)["out"]


# --- kinds ------------------------------------------------------------------


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, its last one counted once."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)


def card_valid(m: Column) -> Column:
    return bound(digits_of(m), lambda d: (luhn_sum(d) % 10 == 0) & (F.length(F.replace(d, d.substr(F.lit(1), F.lit(1)), F.lit(""))) > 0))


def card(key: Column, m: Column) -> Column:
    body = bound(digits_of(m), lambda d: permute_digits(key, "card", d.substr(F.lit(1), F.length(d) - 1)))
    checked = lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))
    return put_digits(m, bound(body, checked))


def phone_valid(m: Column) -> Column:
    return F.length(digits_of(m)).between(10, 15)


def phone(key: Column, m: Column) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .\-(])|^\+[0-9]|^", 0)
    moved = lambda rest: put_digits(rest, permute_digits(key, "phone", digits_of(rest)))
    return bound(country, lambda c: F.concat(c, bound(m.substr(F.length(c) + 1, F.length(m)), moved)))


def ssn_valid(m: Column) -> Column:
    return ~m.rlike("^(000|666|9)|-00-|-0000$")


def ssn(key: Column, m: Column) -> Column:
    return put_digits(m, permute_digits(key, "ssn", digits_of(m)))


def ip_valid(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)


def ip(key: Column, m: Column) -> Column:
    side = F.lit(65536).cast("bigint")
    moved = lambda o: feistel(key, F.lit("ip"), o[0] * 256 + o[1], o[2] * 256 + o[3], side, side)
    done = bound(F.transform(F.split(m, r"\."), lambda x: x.cast("bigint")), moved)
    parts = lambda d: [F.floor(d["a"] / 256), d["a"] % 256, F.floor(d["b"] / 256), d["b"] % 256]
    return bound(done, lambda d: F.concat_ws(".", *[p.cast("string") for p in parts(d)]))


def date_form(m: Column) -> Column:
    return (
        F.when(m.contains("-"), F.lit("yyyy-MM-dd")).when(m.contains("."), F.lit("dd.MM.yyyy")).when(m.substr(4, 2).cast("int") > 12, F.lit("MM/dd/yyyy")).otherwise(F.lit("dd/MM/yyyy"))
    )


def day_of(m: Column) -> Column:
    """The date's day, from 1900-01-01; null if there is no such date."""
    f = date_form(m)
    year = F.when(m.contains("-"), m.substr(1, 4)).otherwise(m.substr(7, 4))
    month = F.when(m.contains("-"), m.substr(6, 2)).when(f == "MM/dd/yyyy", m.substr(1, 2)).otherwise(m.substr(4, 2))
    day = F.when(m.contains("-"), m.substr(9, 2)).when(f == "MM/dd/yyyy", m.substr(4, 2)).otherwise(m.substr(1, 2))
    return F.date_diff(F.to_date(F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd"))), F.to_date(F.lit("1900-01-01")))


def date_valid(m: Column) -> Column:
    return F.coalesce(day_of(m).between(FIRST_BLOCK * DATE_SIDE**2, (LAST_BLOCK + 1) * DATE_SIDE**2 - 1), F.lit(False))


def date_on(day: Column) -> Column:
    return F.date_add(F.to_date(F.lit("1900-01-01")), day.cast("int"))


def date(key: Column, m: Column) -> Column:
    side, square = F.lit(DATE_SIDE).cast("bigint"), DATE_SIDE**2
    both_ways = lambda day, slashed: slashed & (F.dayofmonth(date_on(day)) <= 12)

    def classed(x: Column) -> Column:
        # a class of its own for what reads both ways, for month first and for day first
        both = both_ways(x["day"], x["slashed"])
        kind = F.when(~x["slashed"], "date").when(both, "date/").when(x["form"] == "MM/dd/yyyy", "date/m").otherwise("date/d")
        block = F.floor(x["day"] / square)
        inside = F.pmod(x["day"], F.lit(square)).cast("bigint")
        tag = F.concat(kind, block)
        return bound(F.struct(x["form"].alias("form"), x["slashed"].alias("slashed"), both.alias("both"), (block * square).alias("first"), inside.alias("inside"), tag.alias("tag")), walked)

    def walked(x: Column) -> Column:
        def arrived(y: Column) -> Column:
            inside = (y["a"] * DATE_SIDE + y["b"]).cast("bigint")
            return F.struct(inside.alias("inside"), (both_ways(x["first"] + inside, x["slashed"]) == x["both"]).alias("there"))

        def step(acc: Column, _: Column) -> Column:
            done = feistel(key, x["tag"], F.floor(acc["inside"] / DATE_SIDE), F.pmod(acc["inside"], F.lit(DATE_SIDE)), side, side)
            return F.when(acc["there"], acc).otherwise(bound(done, arrived))

        # walking on until the class is met again permutes the class
        start = F.struct(x["inside"].alias("inside"), F.lit(False).alias("there"))
        steps = F.sequence(F.lit(1), F.when(x["slashed"], WALK).otherwise(1))
        return bound(date_on(x["first"] + F.aggregate(steps, start, step)["inside"]), lambda at: written(at, x["form"]))

    def written(at: Column, form: Column) -> Column:
        y, mo, d = F.lpad(F.year(at).cast("string"), 4, "0"), F.date_format(at, "MM"), F.date_format(at, "dd")
        return (
            F.when(form == "yyyy-MM-dd", F.concat_ws("-", y, mo, d)).when(form == "dd.MM.yyyy", F.concat_ws(".", d, mo, y)).when(form == "MM/dd/yyyy", F.concat_ws("/", mo, d, y)).otherwise(F.concat_ws("/", d, mo, y))
        )

    return bound(F.struct(date_form(m).alias("form"), m.contains("/").alias("slashed"), day_of(m).alias("day")), classed)


def mod97(s: Column) -> Column:
    """The remainder by 97 of a string in which A stands for 10, B for 11, ..."""

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), c.cast("bigint")).otherwise((F.ascii(c) - 55).cast("bigint"))
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(characters(s), F.lit(0).cast("bigint"), step)


def iban_valid(m: Column) -> Column:
    return bound(F.replace(m, F.lit(" "), F.lit("")), lambda s: F.length(s).between(15, 34) & (mod97(F.concat(s.substr(F.lit(5), F.length(s)), s.substr(1, 4))) == 1))


def iban(key: Column, m: Column) -> Column:
    def moved(account: Column) -> Column:
        # up to 18 digits are permuted, the first ones of longer accounts stay
        def tail(d: Column) -> Column:
            stay = F.greatest(F.length(d) - 18, F.lit(0))
            rest = d.substr(stay + 1, F.length(d))
            return F.concat(d.substr(F.lit(1), stay), F.when(F.length(rest) > 1, permute_digits(key, "iban", rest)).otherwise(rest))

        return put_digits(account, bound(digits_of(account), tail))

    def whole(s: Column) -> Column:
        check = lambda fresh: F.lpad((98 - mod97(F.concat(fresh, s.substr(1, 2), F.lit("00")))).cast("string"), 2, "0")
        return bound(bound(s.substr(F.lit(5), F.length(s)), moved), lambda fresh: put_digits(m, F.concat(check(fresh), digits_of(fresh))))

    return bound(F.replace(m, F.lit(" "), F.lit("")), whole)


def email(key: Column, m: Column) -> Column:
    return F.concat(F.lit("p"), F.substring(keyed(key, F.lit("email"), F.lower(m)), 1, 20), F.lit("@pseudonym.invalid"))


def hex_key(key: Column, m: Column) -> Column:
    return F.substring(F.concat(keyed(key, F.lit("hex"), m)), 1, 64).substr(F.lit(1), F.length(m))


def access_key(key: Column, m: Column) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(F.substring(keyed(key, F.lit("access"), m), 1, 16)))


def secret(key: Column, m: Column) -> Column:
    head = F.regexp_extract(m, r"^(.*?[=:]\s{0,2}[\"']?)[A-Za-z0-9_/+\-]{8,}$", 1)
    value = m.substr(F.length(head) + 1, F.length(m))
    # values that differ share a pseudonym only if they collide in the digest's first digits
    return F.concat(head, F.rpad(keyed(key, F.lit("secret"), value), F.least(F.length(value), F.lit(64)), F.lit("0")))


KINDS = {
    "email": (None, email), "secret": (None, secret), "access_key": (None, access_key), "hex_key": (None, hex_key), "iban": (iban_valid, iban),
    "ip": (ip_valid, ip), "date": (date_valid, date), "ssn": (ssn_valid, ssn), "phone": (phone_valid, phone), "card": (card_valid, card),
}


def plain_kind(m: Column) -> Column:
    """The kind of a match that needs no validation, null for a run of digits: each has a mark that no other can have."""
    return (
        F.when(F.contains(m, F.lit("@")), F.lit("email"))
        .when(F.contains(m, F.lit("=")) | F.contains(m, F.lit(":")), F.lit("secret"))
        .when(m.rlike("^AKIA[0-9A-Z]{16}$"), F.lit("access_key"))
        .when(m.rlike("^(?=[0-9]*[a-f])[0-9a-f]{32,64}$"), F.lit("hex_key"))
    )


def slice_text(characters: Column, at: Column, n: Column) -> Column:
    """``n`` characters from the 1-based place ``at`` of an array of them; a substring of a long text would walk it from its start."""
    return F.array_join(F.slice(characters, at, n), "")


def value_at(run: Column, at: Column) -> Column:
    """struct(kind, value) of the first valid value of INSIDE that starts at ``at`` of a run's characters, or null."""

    def checked(kind: str):
        valid = KINDS[kind][0] or (lambda v: F.lit(True))
        return lambda v: F.when((v != "") & valid(v), F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    def first(w: Column, before: Column) -> Column:
        found = []
        for kind, barred, pattern in INSIDE:
            may = ~before.rlike(barred) & F.substring(w, 1, 1).rlike(HEADS[kind])
            found.append(F.when(may, bound(F.regexp_extract(w, f"^(?:{pattern})", 0), checked(kind))))
        return F.coalesce(*found)

    before = F.when(at > 1, F.get(run, at - 2)).otherwise("")
    return bound(F.struct(slice_text(run, at, F.lit(WINDOW)).alias("w"), before.alias("b")), lambda x: first(x["w"], x["b"]))


#: How values of a kind of INSIDE begin.
HEADS = {"access_key": "A", "iban": "[A-Z]", "ip": "[0-9]", "date": "[0-9]", "ssn": "[0-9]", "phone": "[0-9+(]", "card": "[0-9]"}


def pieces_of(run: Column) -> Column:
    """A run's parts in order, array of struct(kind, value); kind is null for what stays.

    Values are looked for at the start of each token, and on after the end of each one found.
    """
    tokens = F.regexp_extract_all(run, F.lit(r"[+(]|[0-9A-Z]+|[^0-9A-Z+(]+"), F.lit(0))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    part = lambda kind, value: F.array(F.struct(kind.cast("string").alias("kind"), value.alias("value")))

    def cut_run(run: Column) -> Column:
        def step(acc: Column, token: Column) -> Column:
            here, n = acc["at"], F.length(token)
            skip = F.struct((here + n).alias("at"), acc["end"].alias("end"), acc["out"].alias("out"))

            def taken(v: Column) -> Column:
                stays = F.when(here > acc["end"], part(F.lit(None), slice_text(run, acc["end"], here - acc["end"]))).otherwise(none)
                return F.when(v.isNull(), skip).otherwise(
                    F.struct((here + n).alias("at"), (here + F.length(v["value"])).alias("end"), F.concat(acc["out"], stays, part(v["kind"], v["value"])).alias("out"))
                )

            return F.when((here < acc["end"]) | ~token.rlike("^[0-9A-Z+(]"), skip).otherwise(bound(value_at(run, here), taken))

        start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("end"), none.alias("out"))
        finish = lambda acc: F.concat(acc["out"], part(F.lit(None), slice_text(run, acc["end"], F.size(run))))
        return F.aggregate(tokens, start, step, finish)

    return bound(characters(run), cut_run)


def replaced(key: Column, kind: Column, m: Column) -> Column:
    out = None
    for k, (_, make) in KINDS.items():
        out = F.when(kind == k, make(key, m)) if out is None else out.when(kind == k, make(key, m))
    return out.otherwise(m)


def pseudonymise(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), key: str | None = None) -> DataFrame:
    """``keep``, the text with pseudonyms, n_private (places replaced) and kinds (distinct, sorted, joined)."""
    secret_key = key or df.sparkSession.conf.get(KEY_SETTING, None)
    if not secret_key:
        raise ValueError(f"pseudonyms need a secret key: set {KEY_SETTING} or give one")
    k = F.lit(secret_key)
    cut_up = df.select(*keep, F.col(text_col).alias("__text"), pieces(F.col(text_col)).alias("__p"))
    plain = lambda kind, m: F.array(F.struct(kind.alias("kind"), m.alias("value")))
    # a match is a list of parts: one, or those of a run
    parts = lambda m: bound(plain_kind(m), lambda k: F.when(k.isNull(), pieces_of(m)).otherwise(plain(k, m)))
    between = lambda m: plain(F.lit(None).cast("string"), m)
    sorted_out = cut_up.withColumn("__k", F.flatten(F.transform("__p", lambda m, i: F.when(i % 2 == 0, between(m)).otherwise(parts(m)))))
    valid = F.coalesce(F.filter(F.transform("__k", lambda x: x["kind"]), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    fresh = F.transform("__k", lambda x: F.when(x["kind"].isNull(), x["value"]).otherwise(replaced(k, x["kind"], x["value"])))
    return sorted_out.select(
        *keep,
        F.when(F.size(valid) > 0, F.array_join(fresh, "")).otherwise(F.col("__text")).alias(text_col),
        F.size(valid).cast("bigint").alias("n_private"),
        F.array_join(F.array_sort(F.array_distinct(valid)), ",").alias("kinds"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document with pseudonyms in place of personal data."""
    return pseudonymise(documents(spark, sf_dir), key=spark.conf.get(KEY_SETTING, OPEN_KEY))
