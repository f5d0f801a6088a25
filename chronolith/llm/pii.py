"""Op 9: format-preserving Feistel pseudonyms for personal data; DataFrame functions only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Feistel rounds; ten is what published format-preserving ciphers of this shape use.
ROUNDS = 10
#: What the registered query and the pipeline use; a production job reads a secret of its own.
DEMO_KEY = "chronolith-demo-key"
#: Column that carries the key through the plan, as data.
KEY = "__pii_key"

# What each kind looks like (Java syntax). Every alternative starts where no letter,
# digit or joining mark stands before it, and ends where none follows.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@(?:[\p{L}0-9][\p{L}0-9-]*+[.]){1,126}\p{L}{2,24}+",
    "secret": r"(?<![\p{L}0-9])(?:[0-9a-f]{32,64}+|[0-9A-F]{32,64}+)(?![\p{L}0-9])",
    "date": r"(?<![\p{L}0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[.][0-9]{2}[.][0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\p{L}0-9/-]|[.][0-9])",
    "ip": r"(?<![\p{L}0-9.])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![\p{L}0-9]|[.][0-9])",
    "ssn": r"(?<![\p{L}0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}0-9-])",
    "phone": r"(?<![\p{L}0-9+])(?:[+][0-9]{1,3}[ .-]?)(?:[(][0-9]{1,4}[)][ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\p{L}0-9])|(?<![\p{L}0-9+(-])(?:[(][0-9]{3}[)] ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![\p{L}0-9-])",
}
# Numbers in a row, 13 digits or more, up to one that starts another kind; cards are found inside.
_NUMBER = "(?!" + "|".join(PATTERNS[k] for k in ("date", "ip", "ssn", "phone")) + r")[0-9]++(?!\p{L})"
PATTERNS["card"] = rf"(?<![\p{{L}}0-9-])(?=[0-9](?:[ -]?[0-9]){{12}}){_NUMBER}(?:[ -]{_NUMBER})*+"
#: How cards are written, longest first; a head of the numbers in other groups of three or more counts if none of these is there.
CARD_LAYOUTS = (r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}", r"[0-9]{4}(?:[ -][0-9]{4}){3}", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}", r"[0-9]{13,19}")
CARD_HEADS = tuple(rf"[0-9]{{3,}}(?:[ -][0-9]{{3,}}){{{n}}}" for n in range(5, -1, -1))
#: Characters that the longest card and what follows it can take.
CARD_SPAN = 26
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Dates from 1800-01-01 to 2199-12-31: a Gregorian cycle of 146,097 days, which is 189 times 773.
CYCLE_START, CYCLE_DAYS, CYCLE_LEFT, CYCLE_RIGHT = "1800-01-01", 146097, 189, 773
#: Days after the twelfth of a month in the cycle: 9 times 9833. A slash date with such a day first can't have its month first.
FIRST_YEAR, LATE_FROM, LATE_DAYS, LATE_LEFT, LATE_RIGHT = 1800, 13, 88497, 9, 9833
#: Second groups of taxpayer numbers that start with a nine.
ITIN_GROUPS = tuple([*range(50, 66), *range(70, 89), *range(90, 93), *range(94, 100)])


# The functions below build SQL text: nested lambdas need names of their own, which SQL can give.
_numbers = count()


def lambda_of(body, n: int = 1) -> str:
    """SQL lambda with ``n`` fresh parameter names, handed to ``body``."""
    names = [f"v{next(_numbers)}" for _ in range(n)]
    return f"({', '.join(names)}) -> {body(*names)}" if n > 1 else f"{names[0]} -> {body(*names)}"


def let(value: str, body) -> str:
    """``body`` with ``value`` computed once (a one-element array carries it)."""
    return f"element_at(transform(array({value}), {lambda_of(body)}), 1)"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyed_number(key: str, *parts: str) -> str:
    """60 keyed bits as a bigint."""
    return f"cast(conv(substring(sha2(concat_ws('|', {key}, {', '.join(parts)}), 256), 1, 15), 16, 10) AS bigint)"


def feistel(left: str, right: str, a: str, b: str, key: str, tweak: str) -> str:
    """A keyed permutation of pairs (left below a, right below b), as struct l, r."""

    def step(p: str, i: str) -> str:
        odd = f"named_struct('l', ({p}.l + {keyed_number(key, tweak, i, f'{p}.r')}) % {a}, 'r', {p}.r)"
        even = f"named_struct('l', {p}.l, 'r', ({p}.r + {keyed_number(key, tweak, i, f'{p}.l')}) % {b})"
        return f"if({i} % 2 = 1, {odd}, {even})"

    start = f"named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, {lambda_of(step, 2)})"


def digits_of(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def permuted_digits(digits: str, key: str, kind: str) -> str:
    """The digit string (2 to 18 digits) permuted among strings of its length."""

    def body(d: str) -> str:
        half, rest = f"cast(length({d}) div 2 AS int)", f"cast(length({d}) - length({d}) div 2 AS int)"
        pair = feistel(
            f"substring({d}, 1, {half})", f"substring({d}, {half} + 1)", f"cast(pow(10, {half}) AS bigint)", f"cast(pow(10, {rest}) AS bigint)", key, f"concat('{kind}/', length({d}))"
        )
        return let(pair, lambda p: f"concat(lpad(cast({p}.l AS string), {half}, '0'), lpad(cast({p}.r AS string), {rest}, '0'))")

    return let(digits, body)


def lay_out(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced, in order, by ``digits``."""

    def body(d: str) -> str:
        def step(s: str, c: str) -> str:
            return f"if({c} BETWEEN '0' AND '9', named_struct('t', concat({s}.t, substring({d}, {s}.at, 1)), 'at', {s}.at + 1), named_struct('t', concat({s}.t, {c}), 'at', {s}.at))"

        return f"aggregate(filter(split({pattern}, ''), {lambda_of(lambda c: f'{c} <> {quoted(str())}')}), named_struct('t', '', 'at', 1), {lambda_of(step, 2)}, {lambda_of(lambda s: f'{s}.t')})"

    return let(digits, body)


def luhn_sum(digits: str, doubled: int) -> str:
    """Sum of digits; of the places 0, 1, ... from the right, the odd (1) or even (0) ones are doubled."""
    digit = lambda c, i: f"if({i} % 2 = {doubled}, cast({c} AS int) * 2 - if(cast({c} AS int) > 4, 9, 0), cast({c} AS int))"
    places = f"transform(filter(split(reverse({digits}), ''), {lambda_of(lambda c: f'{c} <> {quoted(str())}')}), {lambda_of(digit, 2)})"
    return f"aggregate({places}, 0, {lambda_of(lambda s, x: f'{s} + {x}', 2)})"


def card_pseudonym(value: str, key: str) -> str:
    """The digits before the check digit are permuted; the check digit is made anew."""
    payload = f"substring({digits_of(value)}, 1, length({digits_of(value)}) - 1)"
    new = let(permuted_digits(payload, key, "card"), lambda d: f"concat({d}, cast((10 - {luhn_sum(d, 0)} % 10) % 10 AS string))")
    return lay_out(value, new)


def is_card(value: str) -> str:
    return f"(length({digits_of(value)}) BETWEEN 13 AND 19 AND {luhn_sum(digits_of(value), 1)} % 10 = 0)"


def first_card(text: str, layouts: tuple[str, ...], *more: str) -> str:
    """The first of ``more`` and the layouts at the start of ``text`` that is a card; null if none is."""
    tried = ", ".join([*more, *(f"regexp_extract({text}, r'^{layout}(?![0-9])', 0)" for layout in layouts)])
    return f"get(filter(array({tried}), {lambda_of(is_card)}), 0)"


def cards_replaced(value: str, key: str) -> str:
    """struct n, new: numbers in a row with the cards among them replaced.

    Cards in a known layout are taken wherever a number starts, so that dates of expiry and other
    numbers around them don't hide them; only where there is none, all numbers or their head may be one.
    """

    def step(s: str, _: str) -> str:
        rest = f"substring({value}, {s}.at, {CARD_SPAN})"
        number = f"regexp_extract(substring({value}, {s}.at), '^[0-9]+', 0)"
        after = lambda size: f"substring({value}, {s}.at + {size}, 1)"
        kept = let(number, lambda t: f"named_struct('at', {s}.at + length({t}) + 1, 'n', {s}.n, 'new', concat({s}.new, {t}, {after(f'length({t})')}))")
        masked = lambda c: f"named_struct('at', {s}.at + length({c}) + 1, 'n', {s}.n + 1, 'new', concat({s}.new, {card_pseudonym(c, key)}, {after(f'length({c})')}))"
        found = let(first_card(rest, CARD_LAYOUTS), lambda c: f"if({c} IS NULL, {kept}, {masked(c)})")
        return f"if({s}.at > length({value}), {s}, {found})"

    walk = f"aggregate(sequence(1, size(split({value}, '[ -]'))), named_struct('at', 1, 'n', 0, 'new', ''), {lambda_of(step, 2)})"
    head = let(first_card(value, CARD_HEADS, value), lambda c: f"if({c} IS NULL, named_struct('n', 0, 'new', {value}), named_struct('n', 1, 'new', concat({card_pseudonym(c, key)}, substring({value}, length({c}) + 1))))")
    return let(walk, lambda w: f"if({w}.n > 0, named_struct('n', {w}.n, 'new', {w}.new), {head})")


def as_day(year: str, month: str, day: str) -> str:
    """The date, or null if there is no such day."""
    return f"cast(try_to_timestamp(concat_ws('-', {year}, {month}, {day}), 'yyyy-MM-dd') AS date)"


def date_readings(value: str) -> list[tuple[str, str, str]]:
    """(layout test, date, output format) of each known layout; the first that gives a real day counts.

    The strings of each layout are permuted among themselves, so pseudonyms of different ones never
    meet: a slash date is read month first if it can be, and the others have a day after the twelfth.
    """
    cut = lambda at, n: f"substring({value}, {at}, {n})"
    ymd, dmy, mdy = as_day(cut(1, 4), cut(6, 2), cut(9, 2)), as_day(cut(7, 4), cut(4, 2), cut(1, 2)), as_day(cut(7, 4), cut(1, 2), cut(4, 2))
    return [
        (f"{cut(5, 1)} = '-'", ymd, "yyyy-MM-dd"),
        (f"{cut(5, 1)} = '/'", ymd, "yyyy/MM/dd"),
        (f"{cut(3, 1)} = '.'", dmy, "dd.MM.yyyy"),
        (f"{cut(3, 1)} = '/' AND cast({cut(1, 2)} AS int) <= 12", mdy, "MM/dd/yyyy"),
        (f"{cut(3, 1)} = '/'", dmy, LATE),
    ]


#: Output format of slash dates with the day first.
LATE = "dd/MM/yyyy"


def day_number(value: str) -> str:
    """Days since CYCLE_START; null outside the cycle or for no real day."""
    day = "CASE " + " ".join(f"WHEN {test} THEN {day}" for test, day, _ in date_readings(value)) + " END"
    return let(f"datediff({day}, DATE'{CYCLE_START}')", lambda d: f"if({d} BETWEEN 0 AND {CYCLE_DAYS - 1}, {d}, NULL)")


def late_before(month: str) -> str:
    """Days after the twelfth in the ``month`` months before it in the cycle."""
    return f"(datediff(make_date({FIRST_YEAR} + cast({month} AS int) div 12, cast({month} AS int) % 12 + 1, 1), DATE'{CYCLE_START}') - {LATE_FROM - 1} * {month})"


def late_permuted(day: str, key: str) -> str:
    """The date ``day`` (after the twelfth) permuted among all such days of the cycle."""
    month = f"((year({day}) - {FIRST_YEAR}) * 12 + month({day}) - 1)"
    rank = let(month, lambda m: f"{late_before(m)} + day({day}) - {LATE_FROM}")
    # Twice, cut each way: a part of nine values alone would mix little.
    once = let(rank, lambda r: let(feistel(f"{r} div {LATE_RIGHT}", f"{r} % {LATE_RIGHT}", str(LATE_LEFT), str(LATE_RIGHT), key, "'late date'"), lambda p: f"{p}.l * {LATE_RIGHT} + {p}.r"))
    twice = let(once, lambda r: let(feistel(f"{r} div {LATE_LEFT}", f"{r} % {LATE_LEFT}", str(LATE_RIGHT), str(LATE_LEFT), key, "'late date again'"), lambda p: f"{p}.l * {LATE_LEFT} + {p}.r"))

    def as_date(r: str) -> str:
        # Months have 18.4 such days on average and are never more than one off that.
        guess = let(f"cast({r} * 4800 div {LATE_DAYS} AS int)", lambda g: f"filter(array({g} + 1, {g}, {g} - 1), {lambda_of(lambda m: f'{m} BETWEEN 0 AND 4799 AND {late_before(m)} <= {r}')})[0]")
        return let(guess, lambda m: f"date_add(make_date({FIRST_YEAR} + {m} div 12, {m} % 12 + 1, {LATE_FROM}), cast({r} - {late_before(m)} AS int))")

    return let(twice, as_date)


def date_pseudonym(value: str, key: str) -> str:
    def back(d: str) -> str:
        any_day = let(feistel(f"{d} div {CYCLE_RIGHT}", f"{d} % {CYCLE_RIGHT}", str(CYCLE_LEFT), str(CYCLE_RIGHT), key, "'date'"), lambda p: f"date_add(DATE'{CYCLE_START}', cast({p}.l * {CYCLE_RIGHT} + {p}.r AS int))")
        late = let(f"date_add(DATE'{CYCLE_START}', {d})", lambda day: late_permuted(day, key))
        return "CASE " + " ".join(f"WHEN {test} THEN date_format({late if form == LATE else any_day}, '{form}')" for test, _, form in date_readings(value)) + " END"

    return let(day_number(value), back)


def is_ssn(value: str) -> str:
    """Numbers that may be issued: social security numbers, or taxpayer numbers, which start with a nine."""
    area, group, serial = f"substring({value}, 1, 3)", f"substring({value}, 5, 2)", f"substring({value}, 8)"
    return f"if({area} < '900', {area} NOT IN ('000', '666') AND {group} <> '00' AND {serial} <> '0000', cast({group} AS int) IN {ITIN_GROUPS})"


def ssn_pseudonym(value: str, key: str) -> str:
    """Permuted among the numbers that may be issued; a taxpayer number stays one."""
    area, group, serial = (f"cast(substring({value}, {at}) AS int)" for at in ("1, 3", "5, 2", "8"))
    groups = f"array{ITIN_GROUPS}"
    plain = let(
        feistel(f"({area} - if({area} < 666, 1, 2)) * 99 + {group} - 1", f"{serial} - 1", str(898 * 99), "9999", key, "'ssn'"),
        lambda p: f"concat_ws('-', lpad({p}.l div 99 + if({p}.l div 99 < 665, 1, 2), 3, '0'), lpad({p}.l % 99 + 1, 2, '0'), lpad({p}.r + 1, 4, '0'))",
    )
    nine = let(
        feistel(f"({area} - 900) * {len(ITIN_GROUPS)} + array_position({groups}, {group}) - 1", serial, str(100 * len(ITIN_GROUPS)), "10000", key, "'itin'"),
        lambda p: f"concat_ws('-', {p}.l div {len(ITIN_GROUPS)} + 900, {groups}[cast({p}.l % {len(ITIN_GROUPS)} AS int)], lpad({p}.r, 4, '0'))",
    )
    return f"if({area} < 900, {plain}, {nine})"


def ip_pseudonym(value: str, key: str) -> str:
    def spread(x: str) -> str:
        pair = feistel(f"cast({x}[0] AS int) * 256 + cast({x}[1] AS int)", f"cast({x}[2] AS int) * 256 + cast({x}[3] AS int)", "65536", "65536", key, "'ip'")
        return let(pair, lambda p: f"concat_ws('.', {p}.l div 256, {p}.l % 256, {p}.r div 256, {p}.r % 256)")

    return let(f"split({value}, '[.]')", spread)


def phone_pseudonym(value: str, key: str) -> str:
    """The country code stays; the other digits, read as one number, are permuted."""
    code = digits_of(f"regexp_extract({value}, '^[+][0-9]{{1,3}}(?=[^0-9])', 0)")
    return let(code, lambda c: lay_out(value, f"concat({c}, {permuted_digits(f'substring({digits_of(value)}, length({c}) + 1)', key, 'phone')})"))


def email_pseudonym(value: str, key: str) -> str:
    """Case is ignored, so the spellings of an address stay linked."""
    return let(f"sha2(concat_ws('|', {key}, 'email', lower({value})), 256)", lambda d: f"concat('user.', substring({d}, 1, 16), '@', substring({d}, 17, 8), '.example')")


def secret_pseudonym(value: str, key: str) -> str:
    return let(f"substring(sha2(concat_ws('|', {key}, 'secret', lower({value})), 256), 1, length({value}))", lambda d: f"if({value} = lower({value}), {d}, upper({d}))")


def classified(value: str, key: str) -> str:
    """struct kinds, new: the first kind whose look and validation both fit; no kinds and the value itself if none.

    Only numbers in a row can hold more than one value, all of them cards.
    """
    checks = {
        "secret": f"{value} RLIKE '[0-9]'",
        "date": f"{day_number(value)} IS NOT NULL",
        "ip": f"forall(split({value}, '[.]'), {lambda_of(lambda x: f'cast({x} AS int) <= 255')})",
        "phone": f"length({digits_of(value)}) BETWEEN 7 AND 18",
        "ssn": is_ssn(value),
    }
    new = {
        "email": email_pseudonym, "secret": secret_pseudonym, "date": date_pseudonym, "ip": ip_pseudonym,
        "ssn": ssn_pseudonym, "phone": phone_pseudonym,
    }
    cases = " ".join(f"WHEN {value} RLIKE r'^(?:{p})$' AND {checks.get(k, 'true')} THEN named_struct('kinds', array('{k}'), 'new', {new[k](value, key)})" for k, p in PATTERNS.items() if k != "card")
    none = f"named_struct('kinds', cast(array() AS array<string>), 'new', {value})"
    # By its letters: what follows a number may be what kept it from being another kind.
    cards = let(cards_replaced(value, key), lambda c: f"named_struct('kinds', array_repeat('card', {c}.n), 'new', {c}.new)")
    return f"CASE {cases} WHEN {value} RLIKE '^[0-9]+(?:[ -][0-9]+)*$' THEN {cards} ELSE {none} END"


def pseudonymise(docs: DataFrame, keys: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced and ``pii_kinds``, the kinds found in order.

    ``keys`` has one row and one column, the secret; it is read as a scalar subquery, so it stands in
    no plan, log or query text (no row or a null is an error, and so are two rows). Numbers (card
    numbers that pass the Luhn sum, IPv4 addresses, phone numbers, social security and taxpayer
    numbers that may be issued) and real dates of 1800 to 2199 are permuted by a keyed Feistel
    network within their format: length, separators and check digit stay valid, different values
    stay different, and equal values get equal pseudonyms in every document. A day has one pseudonym
    in all layouts but dd/MM/yyyy with a day after the twelfth, which must stay such dates. E-mail
    addresses and long hexadecimal secrets get keyed digests. What fails its validation stays as it
    is, and so does the rest of the text. Each row is changed on its own: no shuffle, whatever the
    table's size or skew. Null text stays null with no kinds; empty and repeated rows need nothing
    special; all columns of ``docs`` are kept, and one named pii_kinds is replaced.
    """
    text, none = F.col(f"`{text_col}`"), F.array().cast("array<string>")
    key = F.coalesce(keys.select(F.col(keys.columns[0]).cast("string")).scalar(), F.raise_error(F.lit("there is no key")))
    found = docs.withColumn(KEY, key)
    found = found.withColumn("pii_kinds", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none))
    found = found.withColumn("pii_kinds", F.expr(f"transform(coalesce(pii_kinds, cast(array() AS array<string>)), {lambda_of(lambda v: classified(v, KEY))})"))
    pieces = f"zip_with(split(`{text_col}`, r'{ANY}', -1), pii_kinds, {lambda_of(lambda s, m: f'concat({s}, coalesce({m}.new, {quoted(str())}))', 2)})"
    found = found.withColumn(text_col, F.expr(f"if(size(pii_kinds) > 0, array_join({pieces}, ''), `{text_col}`)"))
    return found.withColumn("pii_kinds", F.expr("flatten(pii_kinds.kinds)")).drop(KEY)


def demo_keys(spark: SparkSession) -> DataFrame:
    """One row with DEMO_KEY, in the shared folder."""
    return materialise(spark.range(1).select(F.lit(DEMO_KEY).alias("key")), "pii-key")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), demo_keys(spark))
    counts = [F.expr(f"cast(size(filter(pii_kinds, k -> k = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in KINDS]
    return masked.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_found"), *counts)
