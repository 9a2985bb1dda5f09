"""PII: format-preserving pseudonyms by keyed Feistel networks.

Found and validated: payment card numbers (issuer's range and Luhn), bank account
numbers (IBAN, modulo 97), dates (the calendar), phone numbers (with a country
code, or of ten digits with an area code), social security numbers (assigned
ranges), IPv4 and IPv6 addresses (octets, groups), e-mail addresses (64 characters
before the @ at most, as the standard has it), access key ids, and quoted keys
after token, secret, password or key.  Each value is permuted within its own
format: digits stay digits, a card number keeps its issuer and a right check
digit, an account number its country and right check digits, a date stays a date
of the same 400-year cycle, a domain stays.  The permutation depends on key and kind alone, so equal values stay equal
across documents, and no table of values is kept or shuffled.

A Feistel network has two halves; a round adds a keyed hash of one half to the
other, alternately.  Strings add character by character within the character's
class; dates, social security numbers and addresses add modulo the size of
their half (a 400-year cycle has 189 * 773 days).  All of it is DataFrame
expressions, and every pattern reads a text in time that grows with its length:
runs of characters are entered at their start only and never given back.

The key is the caller's secret: whoever has it can take the pseudonyms back.

Cases: a null text stays null with no finds; what fails its validation stays.
Equal rows get equal results.  An empty table gives an empty result.  Columns
named ``n_found``, ``kinds``, ``p_found``, ``p_new`` or ``p_between`` are replaced
or left out.  A text is read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: The patterns of each kind, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "secret": r"(?:token|secret|password|key|TOKEN|SECRET|PASSWORD|KEY)[\"']?[ ]?[=:][ ]?[\"'][A-Za-z0-9_+/-]{8,}+[\"']",
    "date": r"(?<![0-9A-Za-z.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9A-Za-z]|[.-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "key_id": r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9A-Za-z.-])(?:\([2-9][0-9]{2}\)[ ]?|[2-9][0-9]{2}[-. ])[0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){11,18}(?![0-9A-Za-z])",
}
#: Issuers of cards, by first digits and length.
_ISSUERS = "|".join((
    "4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})",
    "5[1-5][0-9]{14}",
    "2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}",
    "3[47][0-9]{13}",
    "3(?:0[0-5][0-9]|[689][0-9]{2})[0-9]{10}",
    "35(?:2[89]|[3-8][0-9])[0-9]{12,15}",
    "6(?:011|4[4-9][0-9]|5[0-9]{2}|2[0-9]{2})[0-9]{12,15}",
    "(?:5018|5020|5038|5893|6304|6759|676[1-3])[0-9]{8,15}",
))
#: What the leading digits hold that a card keeps.
_ISSUER = 4
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_FIRST_DAY = -354285  # 1000-01-01 in days of the epoch; cycles of 400 years follow
_CYCLE, _CYCLE_LEFT = 146097, 189


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shift(c: Column, by: Column, hexadecimal: Column) -> Column:
    """The character ``by`` places on in its class: digits, small or large letters; or hexadecimal digits, whose case stays."""
    code, out = F.ascii(c), c
    for low, high in (("0", "9"), ("a", "z"), ("A", "Z")):
        n = ord(high) - ord(low) + 1
        out = F.when(code.between(ord(low), ord(high)), F.chr((code - ord(low) + by) % n + ord(low))).otherwise(out)
    digits = "0123456789abcdef"
    new = F.substring(F.lit(digits), (F.instr(F.lit(digits), F.lower(c)) - 1 + by) % 16 + 1, F.lit(1))
    return F.when(hexadecimal, F.when(F.lower(c) != c, F.upper(new)).otherwise(new)).otherwise(out)


def permute_text(value: Column, key: str, kind: Column | str, hexadecimal: Column | bool = False) -> Column:
    """Permute the letters and digits of short strings, each within its class; one-to-one."""
    half = F.floor(F.length(value) / 2).cast("int")

    def step(s: Column, t: Column) -> Column:
        odd = t % 2 == 1  # one half moves, by a hash of the other
        to, other = F.when(odd, s["r"]).otherwise(s["l"]), F.when(odd, s["l"]).otherwise(s["r"])
        digest = _hash(key, _column(kind), t.cast("string"), F.length(value).cast("string"), F.lower(other))
        moved = F.array_join(F.transform(F.array(digest), lambda d: F.array_join(F.transform(F.split(to, ""), lambda c, i: _shift(c, _byte(d, i), _column(hexadecimal))), "")), "")
        moved = F.when(F.length(to) > 0, moved).otherwise(to)
        return F.when(odd, F.struct(s["l"].alias("l"), moved.alias("r"))).otherwise(F.struct(moved.alias("l"), s["r"].alias("r")))

    first = F.struct(value.substr(F.lit(1), half).alias("l"), value.substr(half + 1, F.length(value)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, step, lambda s: F.concat(s["l"], s["r"]))


def permute_number(number: Column, left: Column | int, right: Column | int, key: str, kind: Column | str) -> Column:
    """Permute 0 .. left * right - 1; one-to-one."""
    left, right = _column(left), _column(right)
    draw = lambda t, x: F.conv(F.substring(_hash(key, _column(kind), t.cast("string"), x.cast("string")), 1, 15), 16, 10).cast("long")
    first = F.struct(F.floor(number / right).cast("long").alias("l"), (number % right).cast("long").alias("r"))
    step = lambda s, t: F.struct(F.when(t % 2 == 0, (s["l"] + draw(t, s["r"])) % left).otherwise(s["l"]).alias("l"), F.when(t % 2 == 1, (s["r"] + draw(t, s["l"])) % right).otherwise(s["r"]).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, step, lambda s: s["l"] * right + s["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number, its last digit in odd place from the right."""
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))
        return F.when((F.length(digits) - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), term), F.lit(0), lambda a, x: a + x)


def _refill(pattern: Column, characters: Column) -> Column:
    """``pattern`` with its letters and digits replaced, in order."""
    before = lambda i: F.regexp_count(pattern.substr(F.lit(1), i), F.lit("[0-9A-Za-z]"))
    return F.array_join(F.transform(F.split(pattern, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), characters.substr(before(i) + 1, F.lit(1))).otherwise(c)), "")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for several uses."""
    return F.transform(F.array(value), body)[0]


def _modulo97(account: Column) -> Column:
    """An account number modulo 97: letters stand for 10 to 35, the first four characters come last."""
    turned = F.concat(account.substr(F.lit(5), F.length(account)), account.substr(F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _after(text: Column, n: int) -> Column:
    return text.substr(F.lit(n + 1), F.length(text))


def _bare(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9A-Za-z]", "")


#: Kinds whose value is a string: whether it is valid, which part of it moves, and the whole value from the found string and the moved part.
_STRINGS = {
    "email": (lambda m: F.lit(True), lambda m: F.regexp_extract(m, "^[._%+-]*([^@]*)@", 1), lambda m, new: F.concat(F.regexp_extract(m, "^[._%+-]*", 0), new, m.substr(F.instr(m, "@"), F.length(m)))),
    "secret": (lambda m: F.lit(True), lambda m: F.regexp_extract(m, "([A-Za-z0-9_+/-]+)[\"']$", 1), lambda m, new: F.concat(m.substr(F.lit(1), F.length(m) - F.length(new) - 1), new, m.substr(F.length(m), F.lit(1)))),
    "key_id": (lambda m: F.lit(True), lambda m: _after(m, 4), lambda m, new: F.concat(m.substr(F.lit(1), F.lit(4)), new)),
}
#: The same for kinds with separators inside, which stay: all letters and digits of the value from the old ones and the moved part.
_SPACED = {
    "iban": (
        lambda d: F.length(d).between(15, 34) & (_modulo97(d) == 1),
        lambda d: _after(d, 4),
        lambda d, new: F.concat(d.substr(F.lit(1), F.lit(2)), F.lpad((98 - _modulo97(F.concat(d.substr(F.lit(1), F.lit(2)), F.lit("00"), new))).cast("string"), 2, "0"), new),
    ),
    "ipv6": (lambda d: F.lit(True), lambda d: d, lambda d, new: new),
    "phone": (lambda d: F.length(d).between(8, 15), lambda d: d, lambda d, new: new),
    "local_phone": (lambda d: F.lit(True), lambda d: _after(d, 1), lambda d, new: F.concat(d.substr(F.lit(1), F.lit(1)), new)),
    "card": (
        lambda d: d.rlike(f"^(?:{_ISSUERS})$") & (_luhn_sum(d) % 10 == 0),
        lambda d: d.substr(F.lit(_ISSUER + 1), F.length(d) - _ISSUER - 1),
        lambda d, new: _let(F.concat(d.substr(F.lit(1), F.lit(_ISSUER)), new), lambda p: F.concat(p, ((10 - _luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))),
    ),
}


def _parsed_date(m: Column) -> Column:
    return F.when(m.rlike("^[0-9]{4}-"), F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(F.translate(m, "/", "."), F.lit("dd.MM.yyyy"))).cast("date")


def _day(m: Column) -> Column:
    return (F.unix_date(_parsed_date(m)) - F.lit(_FIRST_DAY)).cast("long")


def _shown_date(m: Column, n: Column) -> Column:
    day = _day(m)
    new = F.date_from_unix_date((day - day % _CYCLE + n + _FIRST_DAY).cast("int"))
    return F.when(m.rlike("^[0-9]{4}-"), F.date_format(new, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))


def _ssn_parts(m: Column) -> tuple[Column, Column, Column]:
    return tuple(m.substr(F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))


def _valid_ssn(m: Column) -> Column:
    area, group, serial = _ssn_parts(m)
    return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)


def _ssn_number(m: Column) -> Column:
    area, group, serial = _ssn_parts(m)
    return ((F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1).cast("long") * 9999 + serial - 1).cast("long")


def _shown_ssn(m: Column, n: Column) -> Column:
    a = F.floor(n / (99 * 9999)) + 1
    a = F.when(a >= 666, a + 1).otherwise(a)
    return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(n / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((n % 9999 + 1).cast("string"), 4, "0"))


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("long"))


#: Kinds whose value is a number below left * right: whether it is valid, the number, and the value from the found string and the moved number.
_NUMBERS = {
    "date": (lambda m: F.year(_parsed_date(m)).between(1000, 9799), lambda m: _day(m) % _CYCLE, _shown_date, _CYCLE_LEFT, _CYCLE // _CYCLE_LEFT),
    "ssn": (_valid_ssn, _ssn_number, _shown_ssn, 898 * 99, 9999),
    "ip": (
        lambda m: F.forall(_octets(m), lambda x: x <= 255),
        lambda m: F.aggregate(_octets(m), F.lit(0).cast("long"), lambda a, x: a * 256 + x),
        lambda m, n: F.concat_ws(".", *[(F.floor(n / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)]),
        65536,
        65536,
    ),
}
#: How the kind of a found string is told again, without what stands around it; the first that fits.
_SHAPES = {
    "secret": "[\"']$",
    "email": "@",
    "date": r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "ipv6": ":",
    "key_id": "^A[KS]IA[0-9A-Z]{16}$",
    "iban": "^[A-Z]",
    "phone": r"^\+",
    "local_phone": r"^(?:\(|[0-9]{3}[-. ][0-9]{3}[-.][0-9]{4}$)",
}


def _by_kind(kind: Column, cases: dict[str, Column]) -> Column:
    out = None
    for k, x in cases.items():
        out = F.when(kind == k, x) if out is None else out.when(kind == k, x)
    return out


def pseudonym(m: Column, key: str) -> Column:
    """(kind, value) of one found string; kind is null and the value unchanged where validation fails."""
    kind = F.lit("card")
    for k, shape in reversed(_SHAPES.items()):
        kind = F.when(m.rlike(shape), F.lit(k)).otherwise(kind)
    groups = F.regexp_count(m, F.lit("[0-9A-Fa-f]+"))

    def strings(x: Column) -> Column:  # one network serves all kinds of strings
        k, d = x["kind"], x["bare"]
        moves = _by_kind(k, {n: f[1](m) for n, f in _STRINGS.items()} | {n: f[1](d) for n, f in _SPACED.items()})
        # A phone number keeps its country code.
        code = F.when(k == "phone", F.regexp_extract(m, r"^\+([0-9]{1,3})", 1)).otherwise(F.lit(""))
        moves = F.when(k == "phone", F.substring(moves, F.length(code) + 1, F.length(moves))).otherwise(moves)
        hexadecimal = (k == "ipv6") | ((k == "secret") & moves.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))
        moved = _let(F.struct(moves.alias("v"), hexadecimal.alias("h")), lambda y: F.concat(code, permute_text(y["v"], key, k, y["h"])))
        plain = lambda new: _by_kind(k, {n: f[2](m, new) for n, f in _STRINGS.items()})
        spaced = lambda new: _let(_by_kind(k, {n: f[2](d, new) for n, f in _SPACED.items()}), lambda chars: _refill(m, chars))
        return _let(moved, lambda new: F.when(k.isin(*_STRINGS), plain(new)).otherwise(spaced(new)))

    def numbers(x: Column) -> Column:
        k = x["kind"]
        number, left, right = (_by_kind(k, {n: f(v) for n, v in _NUMBERS.items()}) for f in (lambda v: v[1](m), lambda v: F.lit(v[3]), lambda v: F.lit(v[4])))
        moved = _let(F.struct(number.alias("n"), left.alias("l"), right.alias("r")), lambda y: permute_number(y["n"], y["l"], y["r"], key, k))
        return _let(moved, lambda new: _by_kind(k, {n: f[2](m, new) for n, f in _NUMBERS.items()}))

    def judged(x: Column) -> Column:
        k, d = x["kind"], x["bare"]
        valid = _by_kind(k, {n: f[0](m) for n, f in (_STRINGS | _NUMBERS).items()} | {n: f[0](d) for n, f in _SPACED.items()})
        valid = valid & F.when(k == "ipv6", F.when(m.contains("::"), groups.between(3, 7)).otherwise(groups == 8)).otherwise(F.lit(True))
        value = F.when(k.isin(*_NUMBERS), numbers(x)).otherwise(strings(x))
        return F.when(valid, F.struct(k.alias("kind"), value.alias("value"))).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))

    return _let(F.struct(kind.alias("kind"), _bare(m).alias("bare")), judged)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced, n_found (values replaced) and kinds (sorted, distinct); ``key`` is the caller's secret."""
    if not key:
        raise ValueError("pseudonyms need a key")
    columns = [c for c in docs.columns if c not in ("n_found", "kinds", "p_found", "p_new", "p_between", text)]
    any_at_all = F.col(text).rlike(r"[0-9@]|(?:AKIA|ASIA)|(?i:token|secret|password|key)[\"']?[ ]?[=:]")
    df = docs.withColumn("p_found", F.when(any_at_all, F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))))
    some = F.size("p_found") > 0
    df = df.withColumn("p_new", F.when(some, F.transform("p_found", lambda m: pseudonym(m, key))))
    df = df.withColumn("p_between", F.when(some, F.split(text, _ANY, -1)))
    new = F.array_join(F.zip_with("p_between", "p_new", lambda a, b: F.concat(a, F.coalesce(b["value"], F.lit("")))), "")
    kinds = F.filter(F.transform("p_new", lambda x: x["kind"]), lambda k: k.isNotNull())
    return df.select(*columns, F.when(some, new).otherwise(F.col(text)).alias(text), F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_found"), F.coalesce(F.array_sort(F.array_distinct(kinds)), F.array().cast("array<string>")).alias("kinds"))
