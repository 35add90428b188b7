"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Values are found by pattern and validated (card numbers by Luhn, IBANs modulo 97, octets, dates by calendar,
social security numbers by range); what fails stays as it is. A value is then permuted within its format by
a keyed Feistel network, so equal values get equal pseudonyms in all documents and the key's owner can
reverse them. Text is cut in halves; in each of ROUNDS rounds the characters of one half are shifted within
their class (digit, lower case, upper case, hex digit) by a keystream made by SHA-512 of key, kind, round
and the other half. Ranges (dates, octets, social security numbers) are a pair of numbers, each shifted
modulo its size. Check digits are made anew:

* card: looked for in a run of digit groups: from each group the longest 13 to 19 digits that end with a group
  and pass Luhn; first digit kept, the others but the last permuted, Luhn digit recomputed; separators stay.
* IBAN: in one piece or in groups of four, of which the longest valid run counts; country kept, account
  permuted character by character, check digits recomputed; spaces stay.
* date (yyyy-mm-dd, dd/mm/yyyy, mm/dd/yyyy where that is no dd/mm/yyyy, dd.mm.yyyy; years 1800 to 2199): its day among the 146,097 of 400 years
  (189 x 773), so every pseudonym is a real date.
* social security number: area (898 values) and the rest (99 x 9,999). IPv4: two pairs of octets.
* phone: (ddd) ddd-dddd, ddd-ddd-dddd and ddd.ddd.dddd: all ten digits; numbers that begin with + (8 to 15 digits): those after
  the country code, taken as one digit for 1 and 7 and two digits else. A number gets the same pseudonym with +1 and without.
* e-mail: the part before @.
* secret: 32 to 64 hex digits, in lower or upper case alike; keys with a known prefix, which is kept; and values of
  12 or more characters, letters and digits among them, that follow token, secret, password or api key and : or =.

Halves over 32 characters reuse a round's keystream. Null text stays null; text without values is unchanged.
Repeated rows give one row each; a null doc_id is passed through; other columns stay as they are.

An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import bound

from . import common as c

ROUNDS = 8
#: Key of the registered query; give your own.
KEY = "demonstration key"

#: kind: pattern, tried in this order
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)\b",
    "secret": r"\b(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})\b",
    "prefixed": r"\b(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}+|\b(?:AKIA|AIza)[A-Za-z0-9_-]{16,}+",
    "keyed": r"(?<=(?:token|secret|passwd|password|api[_ -]?key)[\"']?\s?[:=]\s?[\"']?)(?=[^0-9\s]*[0-9])(?=[^A-Za-z\s]*[A-Za-z])[A-Za-z0-9_+/.=-]{12,}+",
    "phone": r"\+[0-9]{1,3}+(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}+\b|(?<![0-9.-])(?:\([0-9]{3}\) ?[0-9]{3}[-. ]|[0-9]{3}[-.][0-9]{3}[-.])[0-9]{4}\b(?![-.]?[0-9])",
    "date": r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,}+\b",
    "ipv4": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
}
ANY = "|".join(PATTERNS.values())


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def _number(key: str, kind: str, n: Column, other: Column, at: Column) -> Column:
    """A number below 65,536 from key, kind, round and the other half; at: which of 32."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), other.cast("string")), 512)
    return F.conv(F.substr(digest, F.pmod(at, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("bigint")


def _shift(ch: Column, by: Column, hexadecimal: bool) -> Column:
    code = F.ascii(ch)
    turn = lambda base, size: F.char(F.lit(base) + F.pmod(code - base + by, F.lit(size)))
    if hexadecimal:
        digits = "0123456789abcdef"
        return F.substr(F.lit(digits), F.pmod(F.instr(F.lit(digits), ch) - 1 + by, F.lit(16)).cast("int") + 1, F.lit(1))
    return F.when(code.between(48, 57), turn(48, 10)).when(code.between(97, 122), turn(97, 26)).when(code.between(65, 90), turn(65, 26)).otherwise(ch)


def permuted(s: Column, key: str, kind: str, hexadecimal: bool = False, rounds: int = ROUNDS) -> Column:
    """The Feistel permutation of a string, character classes kept. An even number of rounds keeps the halves' lengths."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("a"), F.substr(s, half + 1, F.length(s)).alias("b"))

    def step(x: Column, n: Column) -> Column:
        moved = F.transform(_chars(x["a"]), lambda ch, i: _shift(ch, _number(key, kind, n, x["b"], i), hexadecimal))
        return F.struct(x["b"].alias("a"), F.array_join(moved, "").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda x: F.concat(x["a"], x["b"]))


def permuted_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, kind: str, then: Callable[[Column, Column], Column], rounds: int = ROUNDS) -> Column:
    """The Feistel permutation of a pair of numbers below size_a and size_b, handed to ``then``."""

    def big(n: Column, other: Column) -> Column:
        return _number(key, kind, n, other, F.lit(0)) * 65536 + _number(key, kind, n, other, F.lit(1))

    def step(x: Column, n: Column) -> Column:
        a2 = F.pmod(x["a"] + big(n * 2, x["b"]), F.lit(size_a))
        return F.struct(a2.alias("a"), F.pmod(x["b"] + big(n * 2 + 1, a2), F.lit(size_b)).alias("b"))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds // 2 - 1)), start, step, lambda x: then(x["a"], x["b"]))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of the digits before the check digit."""
    place = lambda d, i: F.when(F.pmod(i, F.lit(2)) == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int"))
    return F.aggregate(F.transform(_chars(F.reverse(digits)), place), F.lit(0), lambda s, x: s + x)


def luhn_digit(digits: Column) -> Column:
    return F.pmod(10 - F.pmod(luhn_sum(digits), F.lit(10)), F.lit(10)).cast("string")


def mod97(s: Column) -> Column:
    """Value of letters and digits (A = 10 to Z = 35) modulo 97."""
    step = lambda m, ch: F.when(ch.between("0", "9"), F.pmod(m * 10 + F.ascii(ch) - 48, F.lit(97))).otherwise(F.pmod(m * 100 + F.ascii(ch) - 55, F.lit(97)))
    return F.aggregate(_chars(s), F.lit(0), step)


def refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced by the given ones, in order."""
    before = lambda i: F.length(F.regexp_replace(F.substr(form, F.lit(1), i), "[^0-9]", ""))
    return F.array_join(F.transform(_chars(form), lambda ch, i: F.when(ch.between("0", "9"), F.substr(digits, before(i) + 1, F.lit(1))).otherwise(ch)), "")


def _card(m: Column, key: str) -> Column:
    d = F.regexp_replace(m, "[^0-9]", "")
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    new = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted(F.substr(body, F.lit(2), F.length(d)), key, "card"))
    return F.when(F.length(d).between(13, 19) & (F.right(d, F.lit(1)) == luhn_digit(body)), refilled(m, F.concat(new, luhn_digit(new))))


def _cuts(groups: Column) -> Column:
    """First group and number of groups of each card in a run of digit groups."""
    valid = lambda x: F.length(x).between(13, 19) & (F.right(x, F.lit(1)) == luhn_digit(F.substr(x, F.lit(1), F.length(x) - 1)))

    def step(x: Column, i: Column) -> Column:
        lengths = F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i)), lambda k: valid(F.regexp_replace(F.array_join(F.slice(groups, i + 1, k), ""), "[^0-9]", "")))
        size = F.when(i < x["next"], F.lit(0)).otherwise(F.coalesce(F.array_max(lengths), F.lit(0)))
        return bound(size, lambda k: F.struct(
            F.when(i < x["next"], x["next"]).otherwise(i + F.greatest(k, F.lit(1))).alias("next"),
            F.when(k > 0, F.array_append(x["cuts"], F.struct(i.alias("i"), k.alias("k")))).otherwise(x["cuts"]).alias("cuts"),
        ))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,k:int>>").alias("cuts"))
    return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda x: x["cuts"])


def _one(p: Column) -> Column:
    """The pseudonym of a value that is one find."""
    return F.when(p.isNotNull(), F.struct(p.alias("p"), F.lit(1).alias("n")))


def _cards(m: Column, key: str) -> Column:
    """The run of digit groups with its cards replaced, and their number; null if it has none."""

    def filled(groups: Column, cuts: Column) -> Column:
        def put(x: Column, at: Column) -> Column:
            plain = F.array_join(F.slice(groups, x["next"] + 1, at["i"] - x["next"]), "")
            found = F.array_join(F.slice(groups, at["i"] + 1, at["k"]), "")
            return F.struct((at["i"] + at["k"]).alias("next"), F.concat(x["text"], plain, _card(found, key)).alias("text"))

        text = F.aggregate(cuts, F.struct(F.lit(0).alias("next"), F.lit("").alias("text")), put, lambda x: F.concat(x["text"], F.array_join(F.slice(groups, x["next"] + 1, F.size(groups)), "")))
        return F.when(F.size(cuts) > 0, F.struct(text.alias("p"), F.size(cuts).alias("n")))

    groups = F.regexp_extract_all(m, F.lit("([ -]?[0-9]+)"), F.lit(1))
    return bound(groups, lambda g: bound(_cuts(g), lambda cuts: filled(g, cuts)))


def _iban(m: Column, key: str) -> Column:
    """The longest valid run of groups from the first on; the rest stays."""

    def made(s: Column) -> Column:
        plain = F.replace(s, F.lit(" "), F.lit(""))
        country, new = F.substr(plain, F.lit(1), F.lit(2)), permuted(F.substr(plain, F.lit(5), F.length(plain)), key, "iban")
        return bound(new, lambda x: _spaced(s, F.concat(country, F.lpad((98 - mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x)))

    def valid(s: Column) -> Column:
        plain = F.replace(s, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & (mod97(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)

    def cut(groups: Column) -> Column:
        runs = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
        best = F.get(F.filter(runs, valid), F.lit(0))
        return bound(best, lambda s: F.when(s.isNotNull(), F.concat(made(s), F.substr(m, F.length(s) + 1, F.length(m)))))

    return bound(F.split(m, " "), cut)


def _spaced(form: Column, text: Column) -> Column:
    """text with spaces where form has them: in groups of four."""
    return F.when(form.contains(" "), F.regexp_replace(text, "(.{4})(?=.)", "$1 ")).otherwise(text)


def _date(m: Column, key: str) -> Column:
    iso, slash = m.contains("-"), m.contains("/")
    day = F.coalesce(F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).when(slash, F.coalesce(F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "MM/dd/yyyy"))).otherwise(F.try_to_date(m, "dd.MM.yyyy")))
    first = F.to_date(F.lit("1800-01-01"))
    at = F.datediff(day, first)
    new = permuted_pair(F.floor(at / 773), F.pmod(at, F.lit(773)), 189, 773, key, "date", lambda a, b: F.date_add(first, (a * 773 + b).cast("int")))
    text = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(slash & F.try_to_date(m, "dd/MM/yyyy").isNull(), F.date_format(new, "MM/dd/yyyy")).when(slash, F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
    return F.when(at.between(0, 146096), text)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    out = lambda a, b: F.format_string("%03d-%02d-%04d", F.when(a + 1 >= 666, a + 2).otherwise(a + 1), F.floor(b / 9999) + 1, F.pmod(b, F.lit(9999)) + 1)
    return F.when(ok, permuted_pair(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", out))


def _ipv4(m: Column, key: str) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    ok = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    low = lambda x: F.pmod(x, F.lit(256)).cast("string")
    high = lambda x: F.floor(x / 256).cast("string")
    return F.when(ok, permuted_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4", lambda a, b: F.concat_ws(".", high(a), low(a), high(b), low(b))))


def _phone(m: Column, key: str) -> Column:
    d = F.regexp_replace(m, "[^0-9]", "")
    kept = F.when(~m.startswith("+"), 0).when(F.substr(d, F.lit(1), F.lit(1)).isin("1", "7"), 1).otherwise(2)
    new = F.concat(F.substr(d, F.lit(1), kept), permuted(F.substr(d, kept + 1, F.length(d)), key, "phone"))
    return F.when(~m.startswith("+") | F.length(d).between(8, 15), refilled(m, new))


def _email(m: Column, key: str) -> Column:
    local = F.split_part(m, F.lit("@"), F.lit(1))
    return F.concat(permuted(local, key, "email"), F.substr(m, F.length(local) + 1, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    """The same pseudonym in either case."""
    new = permuted(F.lower(m), key, "secret", True)
    return F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new)


def _prefixed(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, "^(?:sk|pk|ghp|gho|xoxb|xoxp)[-_]|^(?:AKIA|AIza)", 0)
    return F.concat(head, permuted(F.substr(m, F.length(head) + 1, F.length(m)), key, "secret"))


def _keyed(m: Column, key: str) -> Column:
    return permuted(m, key, "secret")


MAKERS = {"email": _email, "iban": _iban, "secret": _secret, "prefixed": _prefixed, "keyed": _keyed, "phone": _phone, "date": _date, "ssn": _ssn, "ipv4": _ipv4}
#: How a value of each kind looks when it stands alone; a keyed secret is what nothing else fits.
_ALONE = {k: p for k, p in PATTERNS.items() if k != "keyed"} | {"phone": r"[+(]?[0-9][0-9 ().-]+", "keyed": r"[A-Za-z0-9_+/.=-]{12,}"}


def pseudonym(m: Column, key: str) -> Column:
    """struct(p, n): the pseudonym of one found value and how many values it holds; null if it isn't valid."""
    out = None
    for kind in ("email", "iban", "secret", "prefixed", "date", "ssn", "ipv4", "card", "phone", "keyed"):
        fits = m.rlike(f"^(?:{_ALONE[kind]})$")
        made = _cards(m, key) if kind == "card" else _one(MAKERS[kind](m, key))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


#: Private characters that open and close a find, and those that stand for them where a text has them.
_OPEN, _CLOSE, _ESCAPE, _MARKS = "\ue000", "\ue001", "\ue002", "\ue003\ue004\ue005"
#: What every value needs; texts without are left alone at once.
_LIKELY = r"[0-9@]|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_]|AKIA|AIza|[A-Fa-f]{32}"


def pseudonymised(docs: DataFrame, key: str = KEY, count: str | None = None) -> DataFrame:
    """docs with its text pseudonymised; count: name of a column for the number of values replaced.

    A column of docs that has this name already is replaced.
    """
    plain, marks = F.col("text"), list(zip((_ESCAPE, _OPEN, _CLOSE), _MARKS, strict=True))
    for mark, name in marks:
        plain = F.replace(plain, F.lit(mark), F.lit(_ESCAPE + name))
    safe = F.when(F.col("text").rlike("[\ue000-\ue002]"), plain).otherwise(F.col("text"))
    # one scan: finds are put between two characters, all else is cut at these
    pieces = F.split(F.regexp_replace(safe, ANY, f"{_OPEN}$0{_CLOSE}"), _OPEN)

    def filled(piece: Column, i: Column) -> Column:
        value, rest = F.split_part(piece, F.lit(_CLOSE), F.lit(1)), F.split_part(piece, F.lit(_CLOSE), F.lit(2))
        whole = bound(value, lambda m: bound(pseudonym(m, key), lambda x: F.struct(F.concat(F.coalesce(x["p"], m), rest).alias("t"), F.coalesce(x["n"], F.lit(0)).alias("n"))))
        return F.when(i == 0, F.struct(piece.alias("t"), F.lit(0).alias("n"))).otherwise(whole)

    def joined(x: Column) -> Column:
        text = F.array_join(F.transform(x, lambda p: p["t"]), "")
        back = text
        for mark, name in reversed(marks):
            back = F.replace(back, F.lit(_ESCAPE + name), F.lit(mark))
        return F.struct(F.when(text.contains(_ESCAPE), back).otherwise(text).alias("t"), F.aggregate(x, F.lit(0), lambda n, p: n + p["n"]).cast("bigint").alias("n"))

    whole = F.when(F.col("text").rlike(_LIKELY), bound(F.transform(pieces, filled), joined)).otherwise(F.struct(F.col("text").alias("t"), F.lit(0).cast("bigint").alias("n")))
    # one struct column, then its fields: worked out once a row
    name = "_made"
    while name in docs.columns:
        name += "_"
    made = docs.withColumn(name, whole)
    columns = [F.col(f"{name}.t").alias("text") if k == "text" else F.col(f"`{k}`") for k in docs.columns if k != count]
    return made.select(*columns, *([F.col(f"{name}.n").alias(count)] if count else []))


def op6_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymised(c.read(spark, sf_dir, "documents").select("doc_id", "text"), count="n_values")
