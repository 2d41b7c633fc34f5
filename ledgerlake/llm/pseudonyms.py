"""Format-preserving pseudonyms by keyed Feistel permutations, in SQL expressions only.

Card numbers (Luhn), IBANs (mod 97), phone and social security numbers, IPv4
addresses and calendar dates are found by one pattern, validated, and permuted
inside their own format. Cards and IBANs are validated first, at every start
and up to every separator, so digits or capitals before or after them do no
harm: a card stays a valid card of its length and
separators, a date a date from 1900 to 2099 in its notation. The permutation
depends on the key and the value without separators, so equal values keep one
pseudonym in all documents and different values keep different ones. Local
parts of e-mail addresses and values of credential assignments are permuted
letter by letter in the same way.

A round adds to one half, place by place, digits drawn from the SHA-256 of
key, kind, round and other half, a fresh digest for every 21 places; halves take
turns. Values of a numbered set (dates, addresses, phone and social security
numbers) are permuted as pairs of numbers; where the pairs outnumber the set,
a number that falls outside is permuted again until it is inside, which is a
permutation of the set.

What is kept: a card its length, separators and check; an IBAN its country and
check; a date its notation and the years 1900 to 2099; a number of the North
American plan an area and an exchange that begin with 2 to 9, any other phone
number its country code and the first digits of both; a social security number
a valid area, group and serial. Day-first and ISO dates of one day are linked;
dates that can only be read month first are permuted among themselves, so no
two dates of a notation meet in one pseudonym. Areas that are never issued
(000, 666, 900 and above, as in taxpayer numbers) stay; the group 00 and the
serial 0000 under an issued area make no number.

Defined results: null text stays null with counts 0; text without private
values is returned unchanged; values that fail their check are no finds; of
patterns that begin at one place the first in PATTERNS wins; repeated rows get
equal results; a very long text is one row's work; an empty table gives no
rows; extra columns are dropped, whatever their names, ids are kept as they are.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Places that draw from one digest; steps of a walk at most: that a value needs more has a chance below 51**-15.
PLACES, WALK = 21, 16
#: Days from 1900 to 2099, and those of them after the 12th of their month.
DAYS, LATE_DAYS = 73_049, 73_049 - 12 * 2_400

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# The notations that are recognised, in order of preference.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?<![A-Za-z])(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Aa]pi[_-]?[Kk]ey|[Tt]oken)[ \t]*+[=:][ \t]*+[\"']?[A-Za-z0-9_+/.-]{8,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "date": r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: Cards and IBANs that stand at a place, the longest run at each; runs may overlap.
CHECKED = ("iban", "card")
_RUNS = "(?=(" + "|".join(PATTERNS[k] for k in CHECKED) + "))"
_SECRET_HEAD = r"^[A-Za-z_-]+[ \t]*[=:][ \t]*[\"']?"


def _q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chars(s: str, var: str, body: str) -> str:
    return f"array_join(transform(sequence(1, length({s})), {var} -> {body}), '')"


def _added(s: str, digest: str) -> str:
    """s with a drawn number added to each digit and letter, within digits, small and capital letters."""
    k = f"cast(conv(substring(element_at(h, cast(j div {PLACES} as int) + 1), 3 * (j % {PLACES}) + 1, 3), 16, 10) as int)"
    cases = " ".join(f"when ascii(c) between {lo} and {hi} then chr({lo} + pmod(ascii(c) - {lo} + {k}, {hi - lo + 1}))" for lo, hi in ((48, 57), (97, 122), (65, 90)))
    stream = _let("g", digest, f"transform(sequence(0, length({s}) div {PLACES}), b -> if(b = 0, g, sha2(concat_ws('|', g, cast(b as string)), 256)))")
    return _let("h", stream, f"if(length({s}) = 0, '', array_join(transform(split({s}, ''), (c, j) -> case {cases} else c end), ''))")


def _permuted(s: str, key: str, kind: str) -> str:
    """A keyed permutation of the strings of s's shape."""
    draw = lambda other: f"sha2(concat_ws('|', {key}, '{kind}', cast(i as string), {other}), 256)"
    left = f"named_struct('l', {_added('s.l', draw('s.r'))}, 'r', s.r)"
    right = f"named_struct('l', s.l, 'r', {_added('s.r', draw('s.l'))})"
    start = _let("v", s, "named_struct('l', substring(v, 1, length(v) div 2), 'r', substring(v, length(v) div 2 + 1))")
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> if(i % 2 = 1, {right}, {left}), s -> concat(s.l, s.r))"


def _permuted_pair(a: str, b: str, n_a: int, n_b: int, key: str, kind: str, body: str) -> str:
    """body over s.a, s.b: a keyed permutation of the pairs below (n_a, n_b)."""
    draw = lambda other, n: f"pmod(cast(conv(substring(sha2(concat_ws('|', {key}, '{kind}', cast(i as string), cast({other} as string)), 256), 1, 12), 16, 10) as bigint), {n})"
    left = f"named_struct('a', pmod(s.a + {draw('s.b', n_a)}, {n_a}), 'b', s.b)"
    right = f"named_struct('a', s.a, 'b', pmod(s.b + {draw('s.a', n_b)}, {n_b}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> if(i % 2 = 1, {right}, {left}), s -> {body})"


def _permuted_below(n: int, value: str, key: str, kind: str) -> str:
    """A keyed permutation of the whole numbers below n: of pairs that are at most a fiftieth more, walked until inside."""
    n_a = isqrt(n - 1) + 1
    n_b = -(-n // n_a)
    assert 50 * n_a * n_b <= 51 * n
    once = _permuted_pair(f"w div {n_b}", f"w % {n_b}", n_a, n_b, key, kind, f"s.a * {n_b} + s.b")
    return f"aggregate(sequence(1, {WALK}), cast({value} as bigint), (w, t) -> if(t > 1 and w < {n}, w, {once}))"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _refilled(token: str, new: str, keep: str = "[0-9]") -> str:
    """The token with its digits (or the characters of `keep`) replaced by those of `new`, in order."""
    place = f"length(regexp_replace(substring({token}, 1, p), '[^{keep[1:-1]}]', ''))"
    return _let("n", new, _chars(token, "p", f"if(substring({token}, p, 1) rlike '{keep}', substring(n, {place}, 1), substring({token}, p, 1))"))


def _luhn_digit(body: str) -> str:
    """The digit that makes body + digit valid."""
    at = f"cast(substring({body}, length({body}) - q, 1) as int)"
    return f"cast(pmod(10 - pmod(aggregate(sequence(0, length({body}) - 1), 0, (t, q) -> t + if(q % 2 = 0, {at} * 2 - if({at} > 4, 9, 0), {at})), 10), 10) as string)"


def _mod97(s: str) -> str:
    c = f"substring({s}, q, 1)"
    return f"aggregate(sequence(1, length({s})), 0, (t, q) -> if({c} rlike '[0-9]', (t * 10 + cast({c} as int)) % 97, (t * 100 + ascii({c}) - 55) % 97))"


def _passes(v: str) -> str:
    """Whether a run is a card or an IBAN by form and check."""
    card = f"{v} rlike {_q('^(?:' + PATTERNS['card'] + ')$')} and luhn_check({_digits(v)})"
    iban = _let("u", f"replace({v}, ' ', '')", f"{_mod97('concat(substring(u, 5), substring(u, 1, 4))')} = 1")
    return f"if(substring({v}, 1, 1) between '0' and '9', {card}, {v} rlike {_q('^(?:' + PATTERNS['iban'] + ')$')} and {iban})"


def _valid_runs(text: str) -> str:
    """The text's valid cards and IBANs, long ones first: of each run, the longest part from its start to a separator or its end."""
    ends = "filter(sequence(length(r), 12, -1), e -> e = length(r) or substring(r, e + 1, 1) in (' ', '-'))"
    longest = f"get(filter(transform({ends}, e -> substring(r, 1, e)), v -> {_passes('v')}), 0)"
    found = f"filter(transform(array_distinct(regexp_extract_all({text}, {_q(_RUNS)}, 1)), r -> {longest}), v -> v is not null)"
    return f"array_sort(array_distinct({found}), (a, b) -> length(b) - length(a))"


def _pattern(runs: str) -> str:
    """The pattern of all kinds, with a text's valid runs in the place of the notations of cards and IBANs.

    A run that fails its check, or the rest of one, so takes nothing that stands in or after it.
    """
    others = "|".join([f"(?:{PATTERNS['date']})", *(f"(?:{p})" for k, p in PATTERNS.items() if k not in ("date", *CHECKED))])  # the date first, for its group's number
    of = lambda test, around: f"if(exists({runs}, r -> {test}), concat('|(?<!{around})(?:', array_join(filter({runs}, r -> {test}), '|'), ')(?!{around})'), '')"
    return f"if(size({runs}) = 0, {_q(others)}, concat({_q(others)}, {of("r < 'A'", '[0-9]')}, {of("r >= 'A'", '[A-Za-z0-9]')}))"


def _date(token: str, pattern: str, key: str) -> str:
    """A day of any month, by its number."""
    return f"date_format(date_add(date'1900-01-01', cast({_permuted_below(DAYS, _day(token, pattern), key, 'date')} as int)), '{pattern}')"


def _late_date(token: str, pattern: str, key: str) -> str:
    """A day after the 12th of its month, by its number among such days."""
    before = lambda m: f"(datediff(add_months(date'1900-01-01', {m}), date'1900-01-01') - 12 * {m})"  # such days before a month
    month = "array_max(filter(sequence(greatest(cast(r div 18.44 as int) - 3, 0), cast(r div 18.44 as int) + 3), m -> " + before("m") + " <= r))"
    back = _let("m", month, f"date_format(date_add(add_months(date'1900-01-01', m), cast(12 + r - {before('m')} as int)), '{pattern}')")
    at = f"{_day(token, pattern)} - 12 * ((year(to_date({token}, '{pattern}')) - 1900) * 12 + month(to_date({token}, '{pattern}')))"
    return _let("r", _permuted_below(LATE_DAYS, at, key, "late_date"), back)


def _day(token: str, pattern: str) -> str:
    return f"datediff(to_date({token}, '{pattern}'), date'1900-01-01')"


def _ssn(key: str) -> str:
    """Over d, the nine digits: nine digits of the same kind, or null."""
    area, group, serial = "cast(substring(d, 1, 3) as int)", "cast(substring(d, 4, 2) as int)", "cast(substring(d, 6, 4) as int)"
    number = f"({area} - 1 - if({area} > 666, 1, 0)) * {99 * 9999}L + ({group} - 1) * 9999 + {serial} - 1"
    a = f"(p div {99 * 9999} + 1)"
    issued = _let("p", _permuted_below(898 * 99 * 9999, number, key, "ssn"), f"concat(lpad(cast({a} + if({a} >= 666, 1, 0) as string), 3, '0'), lpad(cast(p % {99 * 9999} div 9999 + 1 as string), 2, '0'), lpad(cast(p % 9999 + 1 as string), 4, '0'))")
    other = f"concat(substring(d, 1, 3), {_permuted('substring(d, 4)', key, 'taxpayer')})"
    return f"case when {area} = 0 or {area} = 666 or {area} >= 900 then {other} when {group} > 0 and {serial} > 0 then {issued} end"


def _phone(key: str) -> str:
    """Over e, the last ten digits: ten digits of the same kind."""
    planned = _permuted_pair("cast(substring(e, 1, 3) as int) - 200", "(cast(substring(e, 4, 3) as int) - 200) * 10000 + cast(substring(e, 7) as int)", 800, 8_000_000, key, "phone", "concat(cast(s.a + 200 as string), cast(s.b div 10000 + 200 as string), lpad(cast(s.b % 10000 as string), 4, '0'))")
    other = _let("o", _permuted("concat(substring(e, 2, 2), substring(e, 5))", key, "other_phone"), "concat(substring(e, 1, 1), substring(o, 1, 2), substring(e, 4, 1), substring(o, 3))")
    return f"if(e rlike '^[2-9]..[2-9]', {planned}, {other})"


def _in_range(token: str, pattern: str) -> str:
    return f"coalesce(year(try_to_timestamp({token}, '{pattern}')) between 1900 and 2099, false)"


def _pseudonym(key: str) -> str:
    """SQL over t, a token: its kind and pseudonym, or null if it fails its check."""
    is_ = {k: f"t rlike {_q('^(?:' + p + ')$')}" for k, p in PATTERNS.items()}
    card = _let("d", _digits("t"), f"if(luhn_check(d), {_refilled('t', _let('b', _permuted('substring(d, 1, length(d) - 1)', key, 'card'), f'concat(b, {_luhn_digit("b")})'))}, null)")
    iban_new = _let("b", _permuted("substring(u, 5)", key, "iban"), f"concat(substring(u, 1, 2), lpad(cast(98 - {_mod97("concat(b, substring(u, 1, 2), '00')")} as string), 2, '0'), b)")
    iban = _let("u", "replace(t, ' ', '')", f"if({_mod97('concat(substring(u, 5), substring(u, 1, 4))')} = 1, {_refilled('t', iban_new, '[A-Z0-9]')}, null)")
    phone = _let("d", _digits("t"), _refilled("t", f"concat(substring(d, 1, length(d) - 10), {_let('e', 'right(d, 10)', _phone(key))})"))
    ssn = _let("n", _let("d", _digits("t"), _ssn(key)), f"if(n is null, null, {_refilled('t', 'n')})")
    octet = lambda i: f"cast(split_part(t, '.', {i}) as int)"
    ip = _permuted_pair(f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", 65536, 65536, key, "ip", "concat_ws('.', cast(s.a div 256 as string), cast(s.a % 256 as string), cast(s.b div 256 as string), cast(s.b % 256 as string))")
    email = f"concat({_permuted("split_part(t, '@', 1)", key, 'email')}, '@', split_part(t, '@', 2))"
    head = f"regexp_extract(t, {_q(_SECRET_HEAD)}, 0)"
    secret = f"concat({head}, {_permuted(f'substring(t, length({head}) + 1)', key, 'secret')})"
    iso = f"if({_in_range('t', 'yyyy-MM-dd')}, {_date('t', 'yyyy-MM-dd', key)}, null)"
    dated = "case " + " ".join(f"when {_in_range('t', p)} then {make('t', p, key)}" for p, make in (("dd/MM/yyyy", _date), ("MM/dd/yyyy", _late_date), ("dd.MM.yyyy", _date), ("MM.dd.yyyy", _late_date))) + " end"
    new = {"email": email, "secret": secret, "iban": iban, "ip": ip, "iso_date": iso, "date": dated, "ssn": ssn, "phone": phone, "card": card}
    names = {"iso_date": "date"}
    return "case " + " ".join(f"when {is_[k]} then named_struct('kind', '{names.get(k, k)}', 'old', t, 'new', {new[k]})" for k in PATTERNS) + " end"


KINDS = ("card", "date", "email", "iban", "ip", "phone", "secret", "ssn")


def pseudonymize(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, the text with pseudonyms, the number of finds, and of each kind."""
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = found.withColumn("runs", F.expr(_valid_runs("text"))).withColumn("pattern", F.expr(_pattern("runs")))
    found = found.withColumn("tokens", F.expr("coalesce(regexp_extract_all(text, pattern, 0), array())"))
    found = found.withColumn("finds", F.expr(f"if(size(tokens) = 0, null, transform(tokens, t -> {_pseudonym(_q(key))}))"))
    woven = "array_join(flatten(zip_with(split(text, pattern, -1), finds, (a, f) -> array(coalesce(a, ''), coalesce(f.new, f.old, '')))), '')"
    count = lambda k: F.expr(f"cast(coalesce(size(filter(finds, f -> f.new is not null{'' if k is None else f" and f.kind = '{k}'"})), 0) as bigint)")
    counted = lambda k: F.when(F.col("finds").isNull(), F.lit(0).cast("bigint")).otherwise(count(k))
    return found.select(F.col("id").alias(id_col), F.expr(f"if(finds is null, text, {woven})").alias("text"), counted(None).alias("n_found"), *[counted(k).alias(f"n_{k}") for k in KINDS])
