"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found with one pattern and validated: card numbers by Luhn's check
digit, IBANs by their check number, social security numbers and dates by range,
IPv4 addresses by octet.  A keyed Feistel network then permutes each within its
format: halves of the value take turns in being shifted by a keyed hash of the
other, every character within its own class (digits stay digits, letters stay
letters of the same case), and check digits are computed anew.  The same value
therefore gets the same pseudonym in every document, and different values of one
format get different ones.  Phone numbers link across spellings: what follows
the country code is permuted as a row of digits, however it is grouped.  A value
of a single character has no halves; the characters of its class are put in an
order by keyed hashes instead.

Everything is SQL expressions inside one scan; nothing is shuffled.

What is kept: separators, country codes of phone numbers and IBANs, mail
domains, and the 400-year cycle of dates (month/day/year, or day/month/year
where only that is a date; day.month.year; year-month-day).  Values that fail
validation are left alone.

Defined results: a null text stays null and has no values; empty texts and
texts without values stay as they are; repeated rows get equal results; null
ids are kept; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

#: The registered query's key, for comparing runs; real data need a secret one of their own.
QUERY_KEY = "the key of the registered query"
ROUNDS = 10
KINDS = ["email", "ip", "iban", "date", "ssn", "phone", "card"]

_octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Lengths of the account numbers that countries print in groups of four, without the groups' blanks.
IBAN_LENGTHS = {
    "NO": 15, "BE": 16, "DK": 18, "FI": 18, "FO": 18, "GL": 18, "NL": 18, "MK": 19, "SI": 19, "AT": 20, "BA": 20, "EE": 20, "KZ": 20, "LT": 20, "LU": 20,
    "XK": 20, "CH": 21, "HR": 21, "LI": 21, "LV": 21, "BG": 22, "BH": 22, "CR": 22, "DE": 22, "GB": 22, "GE": 22, "IE": 22, "ME": 22, "RS": 22, "AE": 23,
    "GI": 23, "IL": 23, "IQ": 23, "TL": 23, "AD": 24, "CZ": 24, "ES": 24, "MD": 24, "PK": 24, "RO": 24, "SA": 24, "SE": 24, "SK": 24, "TN": 24, "VG": 24,
    "PT": 25, "ST": 25, "IS": 26, "TR": 26, "FR": 27, "GR": 27, "IT": 27, "MC": 27, "MR": 27, "SM": 27, "AL": 28, "AZ": 28, "BY": 28, "CY": 28, "DO": 28,
    "GT": 28, "HU": 28, "LB": 28, "PL": 28, "SV": 28, "BR": 29, "PS": 29, "QA": 29, "UA": 29, "JO": 30, "KW": 30, "MU": 30, "MT": 31, "SC": 31, "LC": 32,
}


def _groups_of_four() -> str:
    """Pattern of grouped account numbers, by country, so that a word behind one is no part of it."""
    parts = []
    for length in sorted(set(IBAN_LENGTHS.values())):
        countries = "|".join(c for c, n in IBAN_LENGTHS.items() if n == length)
        whole, rest = divmod(length - 4, 4)
        parts.append(rf"(?:{countries})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{whole}}}" + (rf" [A-Z0-9]{{{rest}}}" if rest else ""))
    return "|".join(parts)


_grouped = _groups_of_four()
#: The shape of each kind.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}",
    "ip": rf"(?<![0-9.])(?:{_octet}\.){{3}}{_octet}(?!\.?[0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{_grouped})(?![A-Za-z0-9])",
    "date": r"(?<![0-9])(?:[12][0-9]{3}-[01][0-9]-[0-3][0-9]|[0-3][0-9]/[0-3][0-9]/[12][0-9]{3}|[0-3][0-9]\.[01][0-9]\.[12][0-9]{3})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": (
        r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{2,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
        r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
    ),
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
PATTERN = "|".join(PATTERNS[k] for k in KINDS)
#: Country codes, of which none begins another.
COUNTRY = r"^(\+(?:1|7|2[07]|3[0123469]|4[013456789]|5[12345678]|6[0123456]|8[1246]|9[0123458]|[0-9]{3}))"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chars(s: str, which: str = "(?s).") -> str:
    return f"regexp_extract_all({s}, {_text(which)}, 0)"


def _permute(values: str, radices: str, tag: str, key: str) -> str:
    """Feistel network over an array of numbers, each below its radix."""

    def shifted(x: str, i: str, other: str, radix: str) -> str:
        seed = f"concat_ws('|', {_text(key)}, {_text(tag)}, cast(k AS string), cast({i} AS string), array_join(cast({other} AS array<string>), ','))"
        return f"cast(({x} + cast(conv(substring(sha2({seed}, 256), 1, 8), 16, 10) AS bigint)) % {radix} AS int)"

    left = f"cast(transform(s.a, (x, i) -> {shifted('x', 'i', 's.b', 'pr[i]')}) AS array<int>)"
    right = f"cast(transform(s.b, (x, i) -> {shifted('x', 'i', 's.a', 'pr[ph + i]')}) AS array<int>)"
    start = "struct(cast(slice(pv, 1, ph) AS array<int>) AS a, cast(slice(pv, ph + 1, size(pv) - ph) AS array<int>) AS b)"
    network = (
        f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, k) -> if(k % 2 = 0, struct({left} AS a, s.b AS b), struct(s.a AS a, {right} AS b)), s -> concat(s.a, s.b))"
    )
    seed = f"concat_ws('|', {_text(key)}, {_text(tag)}, 'one', cast(x AS string))"
    order = f"array_sort(transform(sequence(0, cast(pr[0] - 1 AS int)), x -> struct(sha2({seed}, 256) AS h, cast(x AS int) AS x)))"
    whole = f"if(size(pv) = 1, array(element_at({order}, cast(pv[0] + 1 AS int)).x), {network})"
    return _let("pv", values, _let("pr", radices, _let("ph", "cast(size(pv) div 2 AS int)", whole)))


def _letters(s: str, tag: str, key: str) -> str:
    """``s`` with its letters and digits permuted, each within its class."""
    base = "(CASE WHEN c BETWEEN '0' AND '9' THEN 48 WHEN c BETWEEN 'a' AND 'z' THEN 97 ELSE 65 END)"
    chars = _chars(s, "[A-Za-z0-9]")
    new = _permute(f"transform({chars}, c -> ascii(c) - {base})", f"transform({chars}, c -> if(c BETWEEN '0' AND '9', 10, 26))", tag, key)
    before = f"length(regexp_replace(substring({s}, 1, i), '[^A-Za-z0-9]', ''))"
    return _let("nv", new, f"array_join(transform({_chars(s)}, (c, i) -> if(c RLIKE '[A-Za-z0-9]', char({base} + nv[{before}]), c)), '')")


def _luhn(s: str, doubled: int) -> str:
    """Sum of digits from the right, those at places of parity ``doubled`` doubled."""
    digits = f"reverse({_chars(s, '[0-9]')})"
    weighed = f"transform({digits}, (c, i) -> if(i % 2 = {doubled}, (2 * cast(c AS int)) div 10 + (2 * cast(c AS int)) % 10, cast(c AS bigint)))"
    return f"aggregate({weighed}, 0L, (a, x) -> a + x)"


def _mod97(s: str) -> str:
    step = "if(c BETWEEN '0' AND '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"aggregate({_chars(s)}, 0L, (a, c) -> cast({step} AS bigint))"


def _date(m: str) -> str:
    """The date that ``m`` stands for, or null."""
    part = lambda at, n: f"substring({m}, {at}, {n})"
    made = lambda y, mo, d: f"try_cast(concat_ws('-', {y}, {mo}, {d}) AS date)"
    return (
        f"CASE WHEN {m} LIKE '%-%' THEN {made(part(1, 4), part(6, 2), part(9, 2))} "
        f"WHEN {m} LIKE '%/%' THEN coalesce({made(part(7, 4), part(1, 2), part(4, 2))}, {made(part(7, 4), part(4, 2), part(1, 2))}) "
        f"ELSE {made(part(7, 4), part(4, 2), part(1, 2))} END"
    )


def _valid(kind: str, m: str) -> str:
    if kind == "card":
        return f"{_luhn(m, 1)} % 10 = 0"
    if kind == "iban":
        plain = f"replace({m}, ' ', '')"
        return f"{_mod97(f'concat(substring({plain}, 5), substring({plain}, 1, 4))')} = 1"
    if kind == "date":
        return f"({_date(m)}) IS NOT NULL"
    if kind == "ssn":
        return f"NOT ({m} RLIKE '^(000|666|9)|-00-|-0000$')"
    return "true"


def kind_of(m: str) -> str:
    """SQL: the kind of a match ``m``, or null if it fails validation."""
    whole = {k: _text(f"^(?:{p})$") for k, p in PATTERNS.items()}
    return "CASE " + " ".join(f"WHEN {m} RLIKE {whole[k]} THEN if({_valid(k, m)}, '{k}', NULL)" for k in KINDS) + " END"


def pseudonym(kind: str, m: str, key: str) -> str:
    """SQL: the pseudonym of the valid value ``m`` of a kind."""
    if kind == "email":
        local = f"substring_index({m}, '@', 1)"
        return f"concat({_let('lv', local, _letters('lv', kind, key))}, substring({m}, length({local}) + 1))"
    if kind == "ip":
        return f"array_join({_permute(f'cast(split({m}, {_text(chr(92) + ".")}) AS array<int>)', 'array(256, 256, 256, 256)', kind, key)}, '.')"
    if kind == "iban":
        bban = _let("lv", f"substring({m}, 5)", _letters("lv", kind, key))
        return _let("bv", bban, f"concat(substring({m}, 1, 2), lpad(cast(98 - {_mod97(f"concat(replace(bv, ' ', ''), substring({m}, 1, 2), '00')")} AS string), 2, '0'), bv)")
    if kind == "date":
        # 400 years have 146097 = 189 * 773 days
        days = "datediff(dv, make_date(400 * (year(dv) div 400), 1, 1))"
        new = _permute(f"array(cast({days} div 773 AS int), cast({days} % 773 AS int))", "array(189, 773)", kind, key)
        moved = f"date_add(make_date(400 * (year(dv) div 400), 1, 1), {_let('nd', new, 'nd[0] * 773 + nd[1]')})"
        month_first = f"try_cast(concat_ws('-', substring({m}, 7, 4), substring({m}, 1, 2), substring({m}, 4, 2)) AS date) IS NOT NULL"
        shape = f"CASE WHEN {m} LIKE '%-%' THEN date_format(mv, 'yyyy-MM-dd') WHEN {m} LIKE '%.%' THEN date_format(mv, 'dd.MM.yyyy') WHEN {month_first} THEN date_format(mv, 'MM/dd/yyyy') ELSE date_format(mv, 'dd/MM/yyyy') END"
        return _let("dv", _date(m), _let("mv", moved, shape))
    if kind == "ssn":
        area, group, serial = (f"cast(substring({m}, {a}, {n}) AS int)" for a, n in ((1, 3), (5, 2), (8, 4)))
        new = _permute(f"array({area} - if({area} > 666, 2, 1), {group} - 1, {serial} - 1)", "array(898, 99, 9999)", kind, key)
        return _let("nd", new, "concat_ws('-', lpad(cast(nd[0] + if(nd[0] >= 665, 2, 1) AS string), 3, '0'), lpad(cast(nd[1] + 1 AS string), 2, '0'), lpad(cast(nd[2] + 1 AS string), 4, '0'))")
    if kind == "phone":
        code = f"regexp_extract({m}, {_text(COUNTRY)}, 1)"
        return f"concat({code}, {_let('lv', f'substring({m}, length({code}) + 1)', _letters('lv', kind, key))})"
    head = _let("lv", f"substring({m}, 1, length({m}) - 1)", _letters("lv", kind, key))
    return _let("bv", head, f"concat(bv, cast((10 - {_luhn('bv', 0)} % 10) % 10 AS string))")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms under a secret ``key``, and the number of values of each kind."""
    if not key:
        raise ValueError("pseudonyms need a key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # most texts have neither a digit pair nor an at sign, and are passed as they are
    found = f"if(text RLIKE '[0-9][0-9./ ()-]*[0-9]|@', regexp_extract_all(text, {_text(PATTERN)}, 0), cast(array() AS array<string>))"
    cases = " ".join(f"WHEN '{k}' THEN {pseudonym(k, 'm', key)}" for k in KINDS)
    rows = rows.withColumn("__found", F.expr(found)).withColumn("__kinds", F.expr(f"transform(__found, m -> {kind_of('m')})"))
    rows = rows.withColumn("__new", F.expr(f"zip_with(__found, __kinds, (m, k_) -> coalesce(CASE k_ {cases} END, m))"))
    joined = f"array_join(transform(split(text, {_text(PATTERN)}, -1), (g, i) -> concat(g, coalesce(get(__new, i), ''))), '')"
    counts = [F.expr(f"cast(size(filter(__kinds, k -> k = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    some = F.expr("exists(__kinds, k -> k IS NOT NULL)")
    counts = [F.coalesce(F.when(F.col("text").isNotNull(), c), F.lit(0).cast("long")).alias(f"n_{k}") for c, k in zip(counts, KINDS)]
    return rows.select("doc_id", F.when(some, F.expr(joined)).otherwise(F.col("text")).alias("text"), *counts)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents"), QUERY_KEY)
