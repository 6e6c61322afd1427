r"""Format-preserving Feistel pseudonyms for personal data, in SQL expressions alone.

Matches of one combined pattern are validated (Luhn, mod 97, calendar, octets, lengths); valid ones are permuted under a key
inside their own format, so that equal values get equal pseudonyms in every document and different ones stay different:

* card: all digits but the last are permuted, the last is recomputed; separators stay;
* iban: letters and digits behind the check digits are permuted, those are recomputed; country and spaces stay;
* phone: the national digits are permuted, country code and punctuation stay;
* ssn, e-mail: digits among digits and letters among letters (lower-cased; the top-level domain stays);
* secret: 32 to 64 hex digits (letters and digits both) among hex digits, the case stays; keys with a known prefix keep it, the rest is permuted by class;
* ip: the 32 or 128 bits are permuted, the latter written in full; date (alone or before a time): the day is permuted among the 146,097 days of 1800
  to 2199, the layout stays.

The key never stands in the plan: round keys are derived from it in the driver and come in as the rows of a one-row table, by a scalar subquery.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import fresh, whole_text

ROUNDS = 8
# Country codes of one and of two digits; all others have three. Prefixes of keys and how many characters follow.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
PREFIXES = {"AKIA": (16, 16), "ASIA": (16, 16), "AIza": (35, 35), "ghp_": (36, 36), "gho_": (36, 36), "ghs_": (36, 36), "sk-": (20, 64), "xoxb-": (20, 72), "xoxp-": (20, 72), "glpat-": (20, 20)}
#: Alternatives in order. Runs are entered only at their start and left whole (possessive), so the scan is linear.
#: A dot belongs to a domain only before another label, so an address may end a sentence; its top-level domain is looked at afterwards.
PATTERN = "|".join((
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?<=\.[A-Za-z]{2,24})",
    r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9A-Za-z]|\.[0-9])",
    r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{4,39}+(?<=[0-9A-Fa-f]|::)(?![0-9A-Za-z:]|\.[0-9])",
    r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9]{2}:)|[/.-][0-9])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    r"(?:(?<![0-9A-Za-z+])\+[0-9]{1,3}+[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9A-Za-z])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z+])\+[1-9](?:[ .-]?\(?[0-9]\)?){7,14}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:(?: [0-9A-Z]{4}){2,7}+(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30}+)(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z_-])(?:" + "|".join(f"{k}[0-9A-Za-z_-]{{{a},{b}}}+" for k, (a, b) in PREFIXES.items()) + r")(?![0-9A-Za-z_-])",
    r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}+(?![0-9A-Za-z])",
))
KINDS = ("card", "date", "email", "iban", "ip", "phone", "secret", "ssn")


def round_keys(key: str, kind: str) -> list[str]:
    """The keys of the rounds, one list for each kind of value."""
    return [sha256(f"{key}|{kind}|{i}".encode()).hexdigest() for i in range(ROUNDS)]


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _stream(keys: str, i: str, b: str) -> str:
    return f"sha2(concat({keys}[{i}], '|', {b}), 256)"


def _shift(kind: str) -> str:
    """Character c moved by s within its class."""
    if kind == "hex":
        return "substr('0123456789abcdef', pmod(locate(c, '0123456789abcdef') - 1 + s, 16) + 1, 1)"
    return "case when c between '0' and '9' then char(48 + pmod(ascii(c) - 48 + s, 10)) when c between 'a' and 'z' then char(97 + pmod(ascii(c) - 97 + s, 26)) when c between 'A' and 'Z' then char(65 + pmod(ascii(c) - 65 + s, 26)) else c end"


def _mix(a: str, b: str, i: str, key: str, kind: str) -> str:
    byte = "cast(conv(substr(st, ((j - 1) % 32) * 2 + 1, 2), 16, 10) as int)"
    each = _let(f"substr({a}, j, 1)", "c", _let(byte, "s", _shift(kind)))
    return f"if(length({a}) = 0, '', {_let(_stream(key, i, b), 'st', f'array_join(transform(sequence(1, length({a})), j -> {each}), {chr(39)}{chr(39)})')})"


def feistel(x: str, key: str, kind: str = "alnum") -> str:
    """SQL for a keyed permutation of the strings that share x's length and character classes. key: SQL for an array of round keys."""
    h = f"(length({x}) div 2)"
    step = f"if(i % 2 = 0, named_struct('l', {_mix('a.l', 'a.r', 'i', key, kind)}, 'r', a.r), named_struct('l', a.l, 'r', {_mix('a.r', 'a.l', 'i', key, kind)}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substr({x}, 1, {h}), 'r', substr({x}, {h} + 1)), (a, i) -> {step}, a -> concat(a.l, a.r))"


def feistel_int(x: str, left: int, right: int, key: str) -> str:
    """SQL for a keyed permutation of the integers below left * right."""
    f = lambda b, m: f"cast(conv(substr({_stream(key, 'i', f'cast({b} as string)')}, 1, 12), 16, 10) as bigint) % {m}"
    step = f"if(i % 2 = 0, named_struct('l', (a.l + {f('a.r', left)}) % {left}, 'r', a.r), named_struct('l', a.l, 'r', (a.r + {f('a.l', right)}) % {right}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({x} div {right} as bigint), 'r', cast({x} % {right} as bigint)), (a, i) -> {step}, a -> a.l * {right} + a.r)"


def luhn_sum(d: str) -> str:
    """SQL for the Luhn sum of a digit string, check digit last."""
    digit = f"(ascii(substr({d}, length({d}) - k, 1)) - 48)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, k) -> t + if(k % 2 = 0, {digit}, {digit} * 2 - if({digit} > 4, 9, 0)))"


def _overlay(m: str, digits: str) -> str:
    """The digits of m replaced in order."""
    return f"aggregate(split({m}, ''), named_struct('o', '', 'k', 0), (a, c) -> if(c between '0' and '9', named_struct('o', concat(a.o, substr({digits}, a.k + 1, 1)), 'k', a.k + 1), named_struct('o', concat(a.o, c), 'k', a.k)), a -> a.o)"


def _card(key: str) -> str:
    body = _let("substr(d, 1, length(d) - 1)", "p", _let(feistel("p", key), "e", _overlay("m", f"concat(e, cast((10 - {luhn_sum('concat(e, chr(48))')} % 10) % 10 as string))")))
    return _let("regexp_replace(m, '[^0-9]', '')", "d", f"if({luhn_sum('d')} % 10 = 0 and d rlike '[1-9]', {body}, null)")


def _phone(key: str) -> str:
    national = "case when m like '+%' and not m rlike '[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}$' then length(d) - case when substr(d, 1, 1) in (" + ", ".join(f"'{c}'" for c in CODES if len(c) == 1) + ") then 1 when substr(d, 1, 2) in (" + ", ".join(f"'{c}'" for c in CODES if len(c) == 2) + ") then 2 else 3 end else 10 end"
    return _let("regexp_replace(m, '[^0-9]', '')", "d", _let(national, "n", _overlay("m", f"concat(substr(d, 1, length(d) - n), {feistel('right(d, n)', key)})")))


def _mod97(x: str) -> str:
    """SQL for the remainder by 97 of a string whose letters stand for 10 to 35."""
    return f"aggregate(split({x}, ''), 0, (t, c) -> case when c between '0' and '9' then (t * 10 + ascii(c) - 48) % 97 when c between 'A' and 'Z' then (t * 100 + ascii(c) - 55) % 97 else t end)"


def _iban(key: str) -> str:
    check = _mod97("concat(e, substr(m, 1, 2), '00')")
    shown = f"concat(substr(m, 1, 2), lpad(cast(98 - {check} as string), 2, '0'), e)"
    spaced = f"if(m like '% %', trim(regexp_replace({shown}, '(.{{4}})', '$1 ')), {shown})"
    body = _let(feistel("b", key), "e", spaced)
    return _let("substr(replace(m, ' ', ''), 5)", "b", f"if({_mod97('concat(b, substr(m, 1, 4))')} = 1, {body}, null)")


def _ssn(key: str) -> str:
    return f"if(substr(m, 1, 3) in ('000', '666') or m like '9%' or substr(m, 5, 2) = '00' or right(m, 4) = '0000', null, {_let('regexp_replace(m, ' + chr(39) + '-' + chr(39) + ', ' + chr(39) * 2 + ')', 'd', _overlay('m', feistel('d', key)))})"


def _email(key: str) -> str:
    return _let("lower(m)", "x", _let("length(x) - length(substring_index(x, '.', -1)) - 1", "n", f"concat({feistel('substr(x, 1, n)', key)}, substr(x, n + 1))"))


def _secret(key: str) -> str:
    prefix = "case " + " ".join(f"when startswith(m, '{k}') then {len(k)}" for k in PREFIXES) + " else 0 end"
    plain = f"if(m rlike '[0-9]' and m rlike '[A-Fa-f]', {_let(feistel('lower(m)', key, 'hex'), 'e', "if(m rlike '[A-F]', upper(e), e)")}, null)"
    return _let(prefix, "n", f"if(n > 0, concat(substr(m, 1, n), {feistel('substr(m, n + 1)', key)}), {plain})")


def _ip(key: str) -> str:
    value = "aggregate(split(m, '[.]'), 0L, (t, o) -> t * 256 + cast(o as bigint))"
    shown = "concat_ws('.', cast(v div 16777216 as string), cast(v div 65536 % 256 as string), cast(v div 256 % 256 as string), cast(v % 256 as string))"
    four = f"if(exists(split(m, '[.]'), o -> cast(o as int) > 255), null, {_let(feistel_int(value, 65536, 65536, key), 'v', shown)})"
    # Both sides of "::", their groups, and zeros between them.
    side = lambda k: f"filter(split(coalesce(split(m, '::', 2)[{k}], ''), ':'), g -> g <> '')"
    groups = _let(side(0), "a", _let("if(m like '%::%', " + side(1) + ", cast(array() as array<string>))", "b", "concat(a, array_repeat('0', if(m like '%::%', 8 - size(a) - size(b), 0)), b)"))
    fits = "size(g8) = 8 and not m rlike '::.*::|:::|^:[^:]|[^:]:$|[0-9A-Fa-f]{5}' and m rlike '[0-9]' and length(m) >= 6 and (not m like '%::%' or size(filter(split(m, ':'), g -> g <> '')) between 1 and 7)"
    six = _let(groups, "g8", f"if({fits}, {_let(feistel("lower(array_join(transform(g8, g -> lpad(g, 4, '0')), ''))", key, 'hex'), 'e', "array_join(transform(sequence(0, 7), i -> substr(e, i * 4 + 1, 4)), ':')")}, null)")
    return f"if(m like '%:%', {six}, {four})"


def _date(key: str) -> str:
    parts = "case when substr(m, 5, 1) = '-' then array(substr(m, 1, 4), substr(m, 6, 2), substr(m, 9, 2)) when substr(m, 3, 1) = '.' then array(substr(m, 7, 4), substr(m, 4, 2), substr(m, 1, 2)) else array(substr(m, 7, 4), substr(m, 1, 2), substr(m, 4, 2)) end"
    day = "case when cast(p[0] as int) not between 1800 and 2199 or cast(p[1] as int) not between 1 and 12 or cast(p[2] as int) < 1 then null when cast(p[2] as int) > day(last_day(make_date(cast(p[0] as int), cast(p[1] as int), 1))) then null else datediff(make_date(cast(p[0] as int), cast(p[1] as int), cast(p[2] as int)), date'1800-01-01') end"
    shown = "date_format(date_add(date'1800-01-01', cast(v as int)), case when substr(m, 5, 1) = '-' then 'yyyy-MM-dd' when substr(m, 3, 1) = '.' then 'dd.MM.yyyy' else 'MM/dd/yyyy' end)"
    return _let(parts, "p", _let(day, "n", f"if(n is null, null, {_let(feistel_int('n', 189, 773, key), 'v', shown)})"))


def _kind() -> str:
    prefixes = "|".join(PREFIXES)
    return f"""case when m like '%@%' then 'email' when m like '%:%' then 'ip' when m rlike '^({prefixes})' then 'secret' when m rlike '^[A-Z][A-Z][0-9][0-9]' then 'iban' when m like '+%' then 'phone' when m rlike '^[0-9]+([.][0-9]+){{3}}$' then 'ip'
        when m rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})$' then 'date' when m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn'
        when m rlike '^([+][0-9]{{1,3}}[ .-]?)?([(][0-9]{{3}}[)] ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}$' then 'phone' when m rlike '^[0-9](.?[0-9]){{12,18}}$' then 'card' else 'secret' end"""


def pseudonymise(docs: DataFrame, key: str = "demo-key", text_col: str = "text") -> DataFrame:
    """Every row and column, ``text_col`` with its personal data replaced, plus a last column ``__found`` (with more underscores where the input has that):
    array<struct<kind,value,pseudonym>> of what was valid, in order.

    Defined cases: a null text comes back empty; invalid matches (Luhn, mod 97, calendar, octets) stay as they are; texts without digits or "@" are passed
    without a scan; very long texts are scanned whole, in time that grows with their length; rows depend on nothing else, so repeated ones get equal
    results; an empty table gives an empty table. A 16-digit run may be read as a secret only with letters in it. ``key`` must be kept secret in
    production."""
    m, every, k, found = fresh(docs, "__m", "__all", "__k", "__found")
    maker = {"card": _card, "date": _date, "email": _email, "iban": _iban, "ip": _ip, "phone": _phone, "secret": _secret, "ssn": _ssn}
    # A 32-digit run that fails as a card has no letters, so it is no secret either.
    pick = "case kind " + " ".join(f"when '{n}' then {f(f'`{k}`.{n}')}" for n, f in maker.items()) + " end"
    each = f"transform(`{m}`, m -> {_let(_kind(), 'kind', f'named_struct({chr(39)}kind{chr(39)}, kind, {chr(39)}value{chr(39)}, m, {chr(39)}pseudonym{chr(39)}, {pick})')})"
    text = whole_text(text_col)
    held = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    scanned = docs.withColumn(m, held).withColumn(k, _secret_keys(docs.sparkSession, key).scalar()).withColumn(every, F.expr(each))
    pieces = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, every, lambda p, x: F.concat(p, F.when(x.isNull(), F.lit("")).otherwise(F.coalesce(x["pseudonym"], x["value"])))), "")
    done = F.when(F.size(m) == 0, text).otherwise(joined)
    return scanned.select(*[done.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.filter(every, lambda x: x["pseudonym"].isNotNull()).alias(found))


def _secret_keys(spark: SparkSession, key: str) -> DataFrame:
    """One row with one struct of the round keys of each kind."""
    return spark.createDataFrame([(tuple(round_keys(key, kind) for kind in KINDS),)], "k struct<" + ", ".join(f"{kind}: array<string>" for kind in KINDS) + ">")
