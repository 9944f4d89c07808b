"""Personal data replaced by format-preserving pseudonyms.

Values are found by pattern, validated (check digits, ranges, calendar), and
permuted by a keyed Feistel network inside their own format: a valid card number
becomes another valid card number, a date another date, a letter stays a letter
and a digit a digit. The permutation depends on the key and the kind of value
alone, so equal values get equal pseudonyms in every document, also where they
are punctuated in another way, and whoever has the key can undo it. Cards and IBANs
are looked for at every group of a longer run, and of two at one place the longer
valid one is taken, so an expiry or a currency behind a number does not hide it.

A Feistel round adds a keyed hash of one half of the value to the other half,
symbol by symbol, modulo the size of each symbol's alphabet. Days are walked
through a five-digit permutation until they fall into the calendar's range.

Main path: DataFrame functions only; no shuffle.

Defined results: a null text stays null, an empty one empty. What does not
validate is left alone. Repeated rows are rewritten alike. An empty table gives
an empty result. A column named like the count is replaced; all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.quality_votes import let

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73_049  # up to 2099-12-31
LOWER, UPPER, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

#: Country calling codes of one and two digits; all others have three.
CALLING_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Names that a secret is given by, and what stands between name and value. A value beside the second has a digit.
PASSWORD_NAME = r"(?i:password|passwd|pwd)[\"']?[ ]?[=:][ ]?[\"']?"
SECRET_NAME = (
    r"(?i:(?:api|secret|access|private|auth)[_-]?(?:access[_-]?)?(?:key|token)|client[_-]?secret|token|secret)"
    r"[\"']?[ ]?[=:][ ]?[\"']?"
)

#: A number ends where no digit and no short group of them follows (a year may).
LAST_GROUP = r"(?![0-9])(?![ .-][0-9]{1,3}(?![0-9]))"
#: Kind: pattern. The first that fits at a place decides.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "password": PASSWORD_NAME + r"[^\s\"']{4,}+",
    "secret": SECRET_NAME + r"(?=[^\s\"']*[0-9])[^\s\"']{8,}+",
    "access_key": r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "hex_secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}" + LAST_GROUP +
             r"|\+[0-9]{1,3}[ .-]?(?:[0-9](?:[ .-][0-9]{2}){4}|[0-9]{1,4}(?:[ .-][0-9]{2,4}){3})" + LAST_GROUP +
             r"|\+[1-9](?:[ .()-]{0,3}[0-9]){7,14}(?![0-9])"
             r"|(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])"
             r"|(?<![0-9+])(?:\([0-9]{3}\)[ .]?[0-9]{3}[ .]|[0-9]{3} [0-9]{3} )[0-9]{4}(?![0-9])"
             r"|(?<![0-9+.])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?!\.?[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: Kinds with check digits, and what may not stand beside them. Any part of a run of groups may be the value,
#: so a text is searched for those of its own values that validate, not for the pattern.
CHECKED = {"iban": "[0-9A-Za-z]", "card": "[0-9]"}
#: No pattern fits a text without one of these.
HINT = "[0-9@]|(?i:passw|pwd)|A[KS]IA"


def _chars(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def permute(values: Column, sizes: Column, key: str, kind: str) -> Column:
    """Feistel permutation of symbols, given as numbers below the sizes of their alphabets."""
    def added(half: Column, size: Column, other: Column, turn: Column) -> Column:
        noise = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn, F.size(half), F.array_join(other.cast("array<string>"), ",")), 512)
        return let(noise, lambda hashed: F.zip_with(
            F.transform(half, lambda x, k: x + F.conv(F.substring(hashed, F.pmod(k, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")),
            size, lambda x, n: F.pmod(x, n),
        ))

    def network(v: Column, n: Column) -> Column:
        cut = F.floor(F.size(v) / 2).cast("int")

        def part(a: Column, second: bool) -> Column:
            return F.slice(a, cut + 1, F.size(a) - cut) if second else F.slice(a, 1, cut)

        first = F.struct(part(v, False).alias("l"), part(v, True).alias("r"))
        turned = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, lambda s, turn: F.when(
            F.pmod(turn, F.lit(2)) == 0, F.struct(added(s["l"], part(n, False), s["r"], turn).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), added(s["r"], part(n, True), s["l"], turn).alias("r"))))
        return let(turned, lambda s: F.concat(s["l"], s["r"]))

    return let(values, lambda v: let(sizes, lambda n: F.when(F.size(v) < 2, F.transform(
        v, lambda x: F.pmod(x + F.conv(F.substring(F.sha2(F.lit(f"{key}|{kind}"), 256), 1, 4), 16, 10).cast("int"), F.get(n, F.lit(0)))
    )).otherwise(network(v, n))))


def _ten(values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(10))


def _refill(text: Column, digits: Column) -> Column:
    """The text with its digits replaced in order."""
    return let(_chars(text), lambda cs: let(
        F.filter(F.transform(cs, lambda c, k: F.when(c.rlike("[0-9]"), k)), lambda k: k.isNotNull()),
        lambda places: F.array_join(F.transform(cs, lambda c, k: F.coalesce(
            F.get(digits, F.array_position(places, k).cast("int") - 1).cast("string"), c
        )), ""),
    ))


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn test over digits in reading order, the last one undoubled."""
    return F.aggregate(F.transform(F.reverse(digits), lambda d, k: F.when(F.pmod(k, F.lit(2)) == 0, d).otherwise(
        d * 2 - F.when(d > 4, 9).otherwise(0)
    )), F.lit(0), lambda s, x: s + x)


def _mod97(text: Column) -> Column:
    """Remainder of an alphanumeric text read as a number, letters from A = 10."""
    return F.aggregate(_chars(text), F.lit(0), lambda s, c: F.when(
        c.rlike("[0-9]"), F.pmod(s * 10 + F.ascii(c) - 48, F.lit(97))
    ).otherwise(F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97))))


def _letters(text: Column, key: str, kind: str) -> Column:
    """Letters and digits of a text permuted within their own alphabets."""
    def alphabet(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.lit("0123456789")).when(c.rlike("[a-z]"), F.lit(LOWER)).when(
            c.rlike("[A-Z]"), F.lit(UPPER))

    def rebuilt(cs: Column) -> Column:
        held = F.filter(cs, lambda c: c.rlike("[0-9A-Za-z]"))
        places = F.filter(F.transform(cs, lambda c, k: F.when(c.rlike("[0-9A-Za-z]"), k)), lambda k: k.isNotNull())
        moved = permute(
            F.transform(held, lambda c: F.instr(alphabet(c), c) - 1), F.transform(held, lambda c: F.length(alphabet(c))), key, kind
        )
        # sorted back into place, as a secret may be long
        changed = F.zip_with(places, moved, lambda k, x: F.struct(
            k.alias("k"), F.substring(alphabet(F.get(cs, k)), x + 1, F.lit(1)).alias("c")))
        kept = F.filter(F.transform(cs, lambda c, k: F.struct(k.alias("k"), c.alias("c"))), lambda x: ~x["c"].rlike("[0-9A-Za-z]"))
        return F.array_join(F.transform(F.array_sort(F.concat(changed, kept)), lambda x: x["c"]), "")
    return let(_chars(text), rebuilt)


def _hex(text: Column, key: str, kind: str) -> Column:
    values = F.transform(_chars(text), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.array_join(F.transform(
        permute(values, F.transform(values, lambda _: F.lit(16)), key, kind), lambda x: F.lower(F.hex(x))
    ), "")


def _card(text: Column, key: str) -> Column:
    def closed(payload: Column) -> Column:
        check = F.pmod(10 - F.pmod(_luhn(F.concat(payload, F.array(F.lit(0)))), F.lit(10)), F.lit(10))
        return F.concat(payload, F.array(check))

    def moved(d: Column) -> Column:
        payload = F.slice(d, 1, F.size(d) - 1)
        return let(let(permute(payload, _ten(payload), key, "card"), closed), lambda n: _refill(text, n))
    return let(_digits(text), lambda d: F.when(F.pmod(_luhn(d), F.lit(10)) == 0, moved(d)))


def _phone(text: Column, key: str) -> Column:
    """The country code stays, which is told by its digits, so spacing makes no difference."""
    code = F.length(F.regexp_extract(text, rf"^\+({CALLING_CODES}|[0-9]{{3}})", 1))
    return let(_digits(text), lambda d: let(
        let(F.slice(d, code + 1, F.size(d)), lambda own: F.concat(F.slice(d, 1, code), permute(own, _ten(own), key, "phone"))),
        lambda n: _refill(text, n),
    ))


def _ip(text: Column, key: str) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    packed = F.array_join(F.transform(octets, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    back = let(_hex(packed, key, "ip"), lambda h: F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(h, 2 * k + 1, F.lit(2)), 16, 10)
    ), "."))
    return F.when(F.array_max(octets) <= 255, back)


def _date(text: Column, key: str) -> Column:
    """ISO dates, and day and month in either order before the year (the day first where both are possible)."""
    def moved(day: Column) -> Column:
        def step(n: Column) -> Column:
            d = F.transform(_chars(F.lpad(n.cast("string"), 5, "0")), lambda c: c.cast("int"))
            return F.array_join(permute(d, _ten(d), key, "date").cast("array<string>"), "").cast("int")
        at = F.aggregate(
            F.sequence(F.lit(1), F.lit(64)), F.struct(day.alias("n"), F.lit(False).alias("done")),
            lambda s, _: F.when(s["done"], s).otherwise(let(step(s["n"]), lambda n: F.struct(n.alias("n"), (n < DAYS).alias("done")))),
        )
        return F.date_add(F.lit(FIRST_DAY).cast("date"), let(at, lambda s: s["n"]))

    def rewritten(form: str, parse: str) -> Column:
        day = F.datediff(F.try_to_timestamp(text, F.lit(parse)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        return let(day, lambda n: F.when((n >= 0) & (n < DAYS), F.date_format(moved(n), form)))
    mark = F.substring(text, 3, 1)
    return F.when(text.rlike("^[0-9]{4}-"), rewritten("yyyy-MM-dd", "yyyy-MM-dd")).when(
        mark == "/", F.coalesce(rewritten("dd/MM/yyyy", "dd/MM/yyyy"), rewritten("MM/dd/yyyy", "MM/dd/yyyy"))
    ).otherwise(rewritten("dd.MM.yyyy", "dd.MM.yyyy"))


def _remainder_is_one(text: Column) -> Column:
    bare = F.regexp_replace(text, " ", "")
    return _mod97(F.concat(F.substring(bare, 5, 60), F.substring(bare, 1, 4))) == 1


def _iban(text: Column, key: str) -> Column:
    """Country and shape stay; the check digits are made anew."""
    def moved(bare: Column) -> Column:
        own = _letters(F.substring(bare, 5, 60), key, "iban")
        def full(body: Column) -> Column:
            check = 98 - _mod97(F.concat(body, F.substring(bare, 1, 2), F.lit("00")))
            return F.concat(F.substring(bare, 1, 2), F.lpad(check.cast("string"), 2, "0"), body)
        return let(own, full)

    def spaced(new: Column) -> Column:
        return let(_chars(text), lambda cs: F.array_join(F.transform(cs, lambda c, k: F.when(c == " ", c).otherwise(
            F.substring(new, k + 1 - (k - F.length(F.regexp_replace(F.substring(text, F.lit(1), k), " ", ""))), F.lit(1))
        )), ""))
    bare = F.regexp_replace(text, " ", "")
    return F.when(_remainder_is_one(text), let(let(bare, moved), spaced))


def _valid_cards(text: Column) -> Column:
    """Runs of whole groups of digits that pass the Luhn test; they may overlap."""
    runs = F.concat(*[F.regexp_extract_all(text, F.lit(
        rf"(?<![0-9])(?=([0-9](?:[ -]?[0-9]){{{n - 1}}})(?![0-9]))"
    ), F.lit(1)) for n in range(13, 20)])
    passed = F.filter(F.array_distinct(runs), lambda m: F.pmod(_luhn(_digits(m)), F.lit(10)) == 0)
    return F.when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), passed).otherwise(F.array().cast("array<string>"))


def _valid_ibans(text: Column) -> Column:
    """Runs of whole groups that pass the remainder test, all with the same start as a run of the longest."""
    runs = F.regexp_extract_all(text, F.lit(
        r"(?<![0-9A-Za-z])(?=([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){8,31})(?![0-9A-Za-z]))"
    ), F.lit(1))
    parts = F.flatten(F.transform(F.array_distinct(runs), lambda run: let(F.split(run, " "), lambda groups: F.transform(
        F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " ")
    ))))
    passed = F.filter(F.array_distinct(parts), lambda m: m.rlike(f"^(?:{PATTERNS['iban']})$") & _remainder_is_one(m))
    return F.when(text.rlike("[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]"), passed).otherwise(F.array().cast("array<string>"))


def _searched(ibans: Column, cards: Column) -> Column:
    """The pattern of a text: that of each kind, or for checked kinds the text's valid values, the longest first."""
    def values(found: Column, beside: str) -> Column:
        longest = F.transform(F.reverse(F.array_sort(F.transform(found, lambda m: F.struct(F.length(m).alias("n"), m.alias("m"))))), lambda x: x["m"])
        return F.when(F.size(found) > 0, F.concat(
            F.lit(f"(?:(?<!{beside})(?:"), F.array_join(longest, "|"), F.lit(f")(?!{beside}))")
        ))

    own = {"iban": ibans, "card": cards}
    return F.concat_ws("|", *[
        values(own[kind], CHECKED[kind]) if kind in CHECKED else F.lit(f"(?:{p})") for kind, p in PATTERNS.items()
    ])


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of a match, or null where it does not validate."""
    def is_a(kind: str) -> Column:
        return match.rlike(f"^(?:{PATTERNS[kind]})$")

    def value_of(name: str, kind: str) -> Column:
        before = F.regexp_extract(match, f"^(?:{name})", 0)
        return F.concat(before, _letters(F.substring(match, F.length(before) + 1, F.length(match)), key, kind))

    at = F.instr(match, F.lit("@"))
    return (
        F.when(is_a("email"), F.concat(_letters(F.substring(match, F.lit(1), at - 1), key, "email"), F.substring(match, at, F.length(match))))
        .when(is_a("password"), value_of(PASSWORD_NAME, "password"))
        .when(is_a("secret"), value_of(SECRET_NAME, "secret"))
        .when(is_a("access_key"), F.concat(F.substring(match, 1, 4), _letters(F.substring(match, 5, 16), key, "access_key")))
        .when(is_a("hex_secret"), _hex(match, key, "hex_secret"))
        .when(is_a("iban"), _iban(match, key))
        .when(is_a("date"), _date(match, key))
        .when(is_a("ip"), _ip(match, key))
        .when(is_a("ssn"), let(_digits(match), lambda d: let(permute(d, _ten(d), key, "ssn"), lambda n: _refill(match, n))))
        .when(is_a("phone"), _phone(match, key))
        .when(is_a("card"), _card(match, key))
    )


def hide_private(docs: DataFrame, key: str, text: str = "text", count: str = "n_private") -> DataFrame:
    """All rows and columns with the text rewritten, and the number of values replaced in it (long)."""
    raw = F.col(text)
    mark = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any column's name, so none is hidden
    ibans, cards, pattern, matches, pairs = (f"{mark}{k}" for k in range(5))
    searched = docs.withColumns({ibans: _valid_ibans(raw), cards: _valid_cards(raw)}).withColumn(
        pattern, _searched(F.col(ibans), F.col(cards)))
    found = F.when(raw.rlike(HINT), F.regexp_extract_all(raw, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    matched = searched.withColumn(matches, found)
    new = F.transform(matches, lambda m: F.struct(m.alias("was"), pseudonym(m, key).alias("now")))
    moved = matched.withColumn(pairs, F.when(F.size(matches) > 0, new).otherwise(F.array()))
    joined = F.array_join(F.zip_with(
        F.split(raw, F.col(pattern), -1), pairs, lambda part, m: F.concat(part, F.coalesce(m["now"], m["was"], F.lit("")))
    ), "")
    return moved.withColumns({
        text: F.when(F.size(pairs) > 0, joined).otherwise(raw),
        count: F.size(F.filter(pairs, lambda m: m["now"].isNotNull())).cast("long"),
    }).drop(ibans, cards, pattern, matches, pairs)
