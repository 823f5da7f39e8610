"""Format-preserving pseudonyms for validated numbers and dates, by keyed Feistel permutations in native expressions.

Each kind of value has a domain, and a keyed permutation of that domain stands for the value. Equal values give
equal pseudonyms in every document, different values different ones, and the pseudonym has the same format:

| kind | found when | permuted |
|---|---|---|
| email | local part, host and a top-level name | letters and digits of the local part, in their classes |
| iban | two letters, check digits, 11-30 characters, remainder 1 modulo 97 | account characters in their classes, check digits follow |
| card | 13 to 19 digits whose Luhn sum is right | digits but the first, the check digit follows |
| ssn | area not 000, 666 or 9xx, group and serial not zero | the whole, inside the valid numbers |
| phone | plus and country code, or area code in brackets | digits after country code but the leading area and exchange digits |
| ip | four numbers up to 255 | the 32-bit address |
| date | a day from 1700 to 2099, as y-m-d, m/d/y or d.m.y | the day, inside these 400 years (146,097 = 189 x 773 days) |

Strings use rounds that add a keyed stream, drawn from one half, to the other half character by character, each
in its own class; addresses xor 16-bit halves; days and social security numbers use two unequal moduli whose
product is the size of the domain, so no value has to be walked back into it.

Edge cases: a null text stays null; an empty one stays empty; values that fail their check stay as they are;
repeated rows give repeated results. Digits between separators are read together, and the separators stay where they are.

Each kind is sought at every place by itself, with all ends its form allows, and only candidates that pass their check
count. Where these overlap, those are taken that together cover most letters and digits, then the most values; digits
joined to a card in an unusual grouping count half. So neighbouring values are not lost to a number that joins them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Values that a hyphen may join: without them a hyphen beside digits belongs to a longer number.
JOINED = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}|[0-9]{3}\)? ?[-.]?[0-9]{3}[-.][0-9]{4}"
    r"|[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
    r"|[A-Z]{2}[0-9]{2}[A-Z0-9 ]{10,40}|\+[0-9]{1,3}[0-9 .()-]{6,20}"
)
#: The hyphen is looked at first: the long look-behind costs much at every other place.
AFTER = rf"(?<=-)(?<=(?:{JOINED}|@[A-Za-z0-9.-]{{1,80}}\.[A-Za-z]{{2,24}})-)"
BEFORE = rf"(?=-\(?(?:{JOINED})(?![0-9]))"
EMAIL = rf"(?:(?<![A-Za-z0-9._%+-])|{AFTER})" r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
SSN = rf"(?:(?<![0-9-])|{AFTER})[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?:(?![0-9-])|{BEFORE})"
PHONE = (
    r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
    r"|(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])"
)
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = (
    rf"(?:(?<![0-9-])|{AFTER})[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:(?![0-9-])|{BEFORE})"
    r"|(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
    r"|(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])"
)
KINDS = {"email": EMAIL, "iban": IBAN, "card": CARD, "ssn": SSN, "phone": PHONE, "ip": IP, "date": DATE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Cards as they are written: no separators, or one kind of them between the usual groups.
USUAL_CARD = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
#: A text without these holds no value of any kind.
MARK = "[0-9@]"
#: No value reaches over these places: after a character that none holds, and at blanks beside blanks or lower-case letters.
CUT = r"(?<=[^A-Za-z0-9._%+@()/ -])|(?<=[a-z] )|(?<= )(?=[a-z ])"
SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(tag: str, half: str, key: str, hexits: int = 12) -> str:
    """SQL: a keyed number below 16**hexits drawn from a half of the value; ``i`` is the round."""
    return f"conv(substr(sha2(concat({key}, '{tag}', i, '|', {half}), 256), 1, {hexits}), 16, 10)"


def _stream(tag: str, half: str, key: str) -> str:
    """SQL: 64 keyed hex digits drawn from a half of the value."""
    return f"sha2(concat({key}, '{tag}', i, '|', {half}), 256)"


def permute_text(value: str, tag: str, key: str) -> str:
    """SQL: the characters of a string permuted with their classes kept (digit, lower, upper; others stay).

    The left half is the shorter one. Each round adds a stream drawn from one half and the other's classes.
    """
    classes = f"regexp_replace(regexp_replace(regexp_replace({value}, '[0-9]', '0'), '[a-z]', 'a'), '[A-Z]', 'A')"

    def shifted(part: str, other: str) -> str:
        step = f"cast(conv(substr(k, 2 * pmod(p - 1, 31) + 1, 3), 16, 10) as int)"
        code = f"ascii(substr({part}, p, 1))"
        return (
            f"element_at(transform(array({_stream(tag, other, key)}), k -> array_join(transform(sequence(1, greatest(length({part}), 1)), p -> case "
            f"when {code} between 48 and 57 then chr(48 + pmod({code} - 48 + {step}, 10)) "
            f"when {code} between 97 and 122 then chr(97 + pmod({code} - 97 + {step}, 26)) "
            f"when {code} between 65 and 90 then chr(65 + pmod({code} - 65 + {step}, 26)) "
            f"else substr({part}, p, 1) end), '')), 1)"
        )

    other = "concat(c, '|', s.r)"
    swapped = "concat(c, '|', s.l)"
    return (
        f"element_at(transform(array({classes}), c -> aggregate(sequence(1, {ROUNDS}), "
        f"struct(substr({value}, 1, cast(length({value}) div 2 as int)) as l, substr({value}, cast(length({value}) div 2 as int) + 1) as r), "
        f"(s, i) -> if(i % 2 = 1, struct({shifted('s.l', other)} as l, s.r as r), struct(s.l as l, {shifted('s.r', swapped)} as r)), "
        f"s -> concat(s.l, s.r))), 1)"
    )


def permute_number(value: str, tag: str, key: str, left: int, right: int) -> str:
    """SQL: a permutation of the numbers from 0 to ``left * right - 1``."""
    return (
        f"aggregate(sequence(1, {ROUNDS}), struct(cast({value} div {right} as bigint) as l, cast({value} % {right} as bigint) as r), "
        f"(s, i) -> if(i % 2 = 1, "
        f"struct(pmod(s.l + cast({_number(tag, 's.r', key)} as bigint), {left}L) as l, s.r as r), "
        f"struct(s.l as l, pmod(s.r + cast({_number(tag, 's.l', key)} as bigint), {right}L) as r)), "
        f"s -> s.l * {right}L + s.r)"
    )


def _bind(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def luhn_sum(digits: str) -> str:
    """SQL: the Luhn sum of a digit string, the last digit counting once."""
    digit = f"cast(substr({digits}, length({digits}) - q, 1) as int)"
    return (
        f"aggregate(sequence(0, length({digits}) - 1), 0, (a, q) -> a + "
        f"if(q % 2 = 0, {digit}, 2 * {digit} - if({digit} > 4, 9, 0)))"
    )


def remainder_97(text: str) -> str:
    """SQL: the remainder modulo 97 of letters (10 to 35) and digits."""
    code = f"ascii(substr({text}, q, 1))"
    return (
        f"aggregate(sequence(1, length({text})), 0, (a, q) -> "
        f"if({code} < 58, (a * 10 + {code} - 48) % 97, (a * 100 + {code} - 55) % 97))"
    )


def _refill(match: str, chars: str, cls: str) -> str:
    """SQL: the match with its characters of class ``cls`` replaced one by one."""
    return (
        f"array_join(transform(sequence(1, length({match})), p -> if(substr({match}, p, 1) rlike '{cls}', "
        f"substr({chars}, length(regexp_replace(substr({match}, 1, p), '[^{cls[1:-1]}]', '')), 1), substr({match}, p, 1))), '')"
    )


def pseudonyms(m: str, key: str) -> dict[str, str]:
    """SQL for each kind: the pseudonym of a match of it, or null if its check fails."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    email = f"concat({permute_text(f'''substring_index({m}, '@', 1)''', 'email', key)}, '@', substring_index({m}, '@', -1))"
    compact = f"replace({m}, ' ', '')"
    iban_new = _bind(
        permute_text("substr(v, 5)", "iban", key),
        "b",
        f"concat(substr(v, 1, 2), lpad(cast(98 - {remainder_97('''concat(b, substr(v, 1, 2), '00')''')} as string), 2, '0'), b)",
    )
    iban = _bind(
        compact, "v",
        f"if(length(v) between 15 and 34 and {remainder_97('concat(substr(v, 5), substr(v, 1, 4))')} = 1, "
        f"{_bind(iban_new, 'w', _refill(m, 'w', '[A-Z0-9]'))}, null)",
    )
    card_new = _bind(
        f"concat(substr(v, 1, 1), {permute_text('substr(v, 2, length(v) - 2)', 'card', key)}, '0')",
        "b",
        f"concat(substr(b, 1, length(b) - 1), cast(pmod(-{luhn_sum('b')}, 10) as string))",
    )
    card = _bind(digits, "v", f"if({luhn_sum('v')} % 10 = 0, {_bind(card_new, 'w', _refill(m, 'w', '[0-9]'))}, null)")
    area = "cast(substr(v, 1, 3) as int)"
    # 898 areas (1-665, 667-899), 99 groups and 9,999 serials.
    ssn_index = f"(({area} - if({area} > 666, 2, 1)) * 99 + cast(substr(v, 4, 2) as int) - 1) * 9999L + cast(substr(v, 6) as int) - 1"
    ssn_area = "cast(n div 989901 as int)"
    ssn_new = (
        f"concat(lpad(cast({ssn_area} + if({ssn_area} > 664, 2, 1) as string), 3, '0'), '-', "
        "lpad(cast((n div 9999) % 99 + 1 as string), 2, '0'), '-', lpad(cast(n % 9999 + 1 as string), 4, '0'))"
    )
    ssn = _bind(
        digits, "v",
        f"if({area} between 1 and 899 and {area} <> 666 and substr(v, 4, 2) <> '00' and substr(v, 6) <> '0000', "
        f"{_bind(permute_number(ssn_index, 'ssn', key, 88902, 9999), 'n', ssn_new)}, null)",
    )
    # Digits before the area code stay, and so do the digits that lead the area code and the exchange.
    country = f"if({m} like '+%', length(regexp_replace(regexp_extract({m}, '^[+][0-9]+', 0), '[^0-9]', '')), 0)"
    phone_new = _bind(
        f"if(length(v) - c >= 10, greatest(length(v) - 10, 0), c)", "c",
        _bind(
            permute_text("if(length(v) - c = 10, concat(substr(v, c + 2, 2), substr(v, c + 5)), substr(v, c + 2))", "phone", key), "b",
            "if(length(v) - c = 10, concat(substr(v, 1, c + 1), substr(b, 1, 2), substr(v, c + 4, 1), substr(b, 3)), "
            "concat(substr(v, 1, c + 1), b))",
        ),
    )
    phone = _bind(
        digits, "v",
        f"if(length(v) between 7 and 15, {_bind(_bind(f'least({country}, length(v) - 6)', 'c', phone_new), 'w', _refill(m, 'w', '[0-9]'))}, null)",
    )
    octets = f"transform(split({m}, '[.]'), o -> cast(o as bigint))"
    ip_new = (
        f"aggregate(sequence(1, {ROUNDS}), struct(v[0] * 256 + v[1] as l, v[2] * 256 + v[3] as r), "
        f"(s, i) -> if(i % 2 = 1, struct(s.l ^ cast({_number('ip', 's.r', key, 4)} as bigint) as l, s.r as r), "
        f"struct(s.l as l, s.r ^ cast({_number('ip', 's.l', key, 4)} as bigint) as r)), "
        "s -> concat_ws('.', s.l div 256, s.l % 256, s.r div 256, s.r % 256))"
    )
    ip = _bind(octets, "v", f"if(array_max(v) < 256, {ip_new}, null)")
    shape = f"case when {m} like '%-%' then 'yyyy-MM-dd' when {m} like '%/%' then 'MM/dd/yyyy' else 'dd.MM.yyyy' end"
    iso = (
        f"case when {m} like '%-%' then {m} when {m} like '%/%' then concat(substr({m}, 7), '-', substr({m}, 1, 2), '-', substr({m}, 4, 2)) "
        f"else concat(substr({m}, 7), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)) end"
    )
    date_new = _bind(
        permute_number("cast(datediff(d, date'1700-01-01') as bigint)", "date", key, 189, 773), "n",
        f"date_format(date_add(date'1700-01-01', cast(n as int)), {shape})",
    )
    date = _bind(
        f"try_cast({iso} as date)", "d",
        f"if(d between date'1700-01-01' and date'2099-12-31', {date_new}, null)",
    )
    return {"email": email, "iban": iban, "card": card, "ssn": ssn, "phone": phone, "ip": ip, "date": date}


def _ends(kind: str) -> str:
    """SQL: the ends to try for a match ``h``, whose own end is the furthest."""
    least, after = {"card": (13, "[0-9]"), "iban": (14, "[A-Za-z0-9]"), "phone": (8, "[0-9]")}.get(kind, (0, ""))
    if not least:
        return "array(length(h))"
    whole = _sql("^(?:" + KINDS[kind] + ")$")
    return (
        f"filter(sequence(least({least}, length(h)), length(h)), "
        f"e -> e = length(h) or (not substr(h, e + 1, 1) rlike '{after}' and substr(h, 1, e) rlike {whole}))"
    )


def spans_of(key: str) -> str:
    """SQL: the accepted spans of a piece ``t`` in order, with offsets in the piece."""
    made = pseudonyms("m", key)
    found = []
    for at, (kind, pattern) in enumerate(KINDS.items()):
        unusual = f"if(m rlike {_sql(USUAL_CARD)}, 2, 1)" if kind == "card" else "2"
        weight = f"length(regexp_replace(m, '[^A-Za-z0-9]', '')) * 1000L * {unusual} + 1"
        one = f"struct(a + e as end, a as start, {at} as place, {weight} as weight, '{kind}' as kind, {made[kind]} as value)"
        start = "aggregate(slice(cuts, 1, x + 1), -1, (n, c) -> n + length(c))"
        tried = _bind(start, "a", f"transform({_ends(kind)}, e -> {_bind('substr(h, 1, e)', 'm', one)})")
        # The first character stands for the text's start: a cut there would give no empty part.
        cuts = f"split(concat('\\n', t), {_sql('(?=' + pattern + ')')}, -1)"
        hits = f"regexp_extract_all(t, {_sql('(?=(' + pattern + '))')}, 1)"
        found.append(f"if(t rlike {_sql(pattern)}, {_bind(cuts, 'cuts', f'flatten(transform({hits}, (h, x) -> {tried}))')}, array())")
    ordered = f"array_sort(filter(concat({', '.join(found)}), y -> y.value is not null))"
    # State j: the best of the first j candidates, the last one it takes and the state before that one.
    best = (
        "aggregate(sequence(1, size(cs)), array(struct(0 as end, 0L as weight, 0 as taken, 0 as before)), (s, j) -> array_append(s, "
        + _bind(
            "size(filter(s, o -> o.end <= cs[j - 1].start)) - 1", "p",
            "if(s[p].weight + cs[j - 1].weight > s[j - 1].weight, "
            "struct(cs[j - 1].end as end, s[p].weight + cs[j - 1].weight as weight, j as taken, p as before), "
            "struct(cs[j - 1].end as end, s[j - 1].weight as weight, s[j - 1].taken as taken, s[j - 1].before as before))",
        )
        + "))"
    )
    chosen = (
        f"aggregate(cs, struct(size(cs) as at, cast(array() as {SPANS}) as spans), (s, y) -> if(b[s.at].taken = 0, s, "
        "struct(b[s.at].before as at, array_append(s.spans, named_struct('start', cs[b[s.at].taken - 1].start, 'end', cs[b[s.at].taken - 1].end, "
        "'kind', cs[b[s.at].taken - 1].kind, 'value', cs[b[s.at].taken - 1].value)) as spans)), s -> reverse(s.spans))"
    )
    return _bind(ordered, "cs", f"if(size(cs) = 0, cast(array() as {SPANS}), {_bind(best, 'b', chosen)})")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with values replaced in ``text``, and ``pii_spans``: kind, start and end of each.

    Offsets are code points of the text given, from 0, end exclusive.
    """
    names = docs.columns
    body = F.col(f"`{text}`")
    pieces = F.when(body.rlike(MARK) & body.rlike(ANY), F.split(body, CUT, -1))
    staged = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), pieces.alias("pieces")).select(
        "row",
        "pieces",
        F.expr(f"transform(pieces, t -> if(t rlike '{MARK}' and t rlike {_sql(ANY)}, {spans_of(_sql(key))}, cast(array() as {SPANS})))").alias("made"),
    )
    none = "cast(array() as array<struct<kind:string,start:int,end:int>>)"
    ends = (
        f"aggregate(sequence(1, size(pieces)), struct(0 as at, {none} as spans), "
        "(s, x) -> struct(s.at + length(pieces[x - 1]) as at, if(size(made[x - 1]) = 0, s.spans, concat(s.spans, "
        "transform(made[x - 1], y -> named_struct('kind', y.kind, 'start', s.at + y.start, 'end', s.at + y.end)))) as spans), s -> s.spans)"
    )
    rebuilt = (
        "array_join(transform(pieces, (t, x) -> if(size(made[x]) = 0, t, aggregate(made[x], struct('' as done, 0 as at), "
        "(s, y) -> struct(concat(s.done, substr(t, s.at + 1, y.start - s.at), y.value) as done, y.end as at), "
        "s -> concat(s.done, substr(t, s.at + 1))))), '')"
    )
    row_text = F.col("row").getField(text)
    return staged.select(
        *[
            F.coalesce(F.expr(f"if(size(pieces) > 0, {rebuilt}, null)"), row_text).alias(c)
            if c == text
            else F.col("row").getField(c).alias(c)
            for c in names
        ],
        F.expr(f"if(size(pieces) > 0, {ends}, {none})").alias("pii_spans"),
    )
