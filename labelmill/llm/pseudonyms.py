"""Format-preserving pseudonyms for numbers and dates in text, in SQL expressions alone.

Candidates are found by one pattern, validated by kind (Luhn for cards, mod 97 for IBANs, calendar
for dates, octets for addresses, assigned ranges for social security numbers, 7 to 15 digits for
phone numbers) and replaced by a keyed permutation of their own format. What does not validate
stays as it is. The permutation is a Feistel network over mixed-radix numbers: the symbols of a value
are split in two halves, and in every round each symbol of one half is moved, modulo its radix, by
a keyed hash of the other half. It is a bijection of the format for any radices, so equal values
stay equal across documents, different ones stay different, and a result validates again:

* card: first digit kept, middle digits permuted, check digit computed anew
* iban: country kept, letters and digits permuted in place, check digits computed anew
* phone: country code and punctuation kept; first digits of area and exchange stay in 2 to 9 or 0 to 1
* ssn: area, group and serial numbers permuted within their assigned ranges
* ipv4: four octets
* date: year-month-day, day.month.year and month/day/year within a 400-year calendar cycle; a
  day/month/year date keeps its order because its day stays over 12
* email: letters and digits of the part before @ permuted in place, each within its own run of an alphabet (Latin with
  accents, Greek, Cyrillic); letters of other alphabets stay

A kind is part of the key, separators are not: one card written with or without spaces has one
pseudonym. Rows are independent; nothing is shuffled.

A value may stand beside other numbers or words, so what is found is cut at its group borders, and the rest
is looked at again. An IBAN ends at its country's length, or else at the last border where it validates. A phone
number with a country code ends at the last border within the country's number lengths, and before a group that
a space parts from a block of six or more digits; a short number behind a shorter phone number of a country with
several lengths cannot be told from it. Cards are looked for in whole runs of digit groups: every start and length on
group borders that validates is a candidate, and of those that overlap the longest wins.

Defined results: a null text stays null with 0 replacements; an empty text stays empty; other
columns are kept unless ``pseudonymise`` is told otherwise; a table's own ``n_replaced`` is replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
CYCLE_START = "1800-01-01"
# A Gregorian cycle of 400 years has 146097 = 189 * 773 days.
CYCLE = (189, 773)

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
# Runs of code points that are letters or digits of one kind, as (first, how many). A symbol stays in its run.
RUNS = ((48, 10), (65, 26), (97, 26), (192, 23), (216, 7), (224, 23), (248, 8), (913, 17), (945, 25), (1040, 32), (1072, 32))
MOVED = "[" + "".join(f"\\x{{{first:x}}}-\\x{{{first + n - 1:x}}}" for first, n in RUNS) + "]"
# Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_KNOWN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:(?:{IBAN_KNOWN})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
ISO_DATE = r"(?<![0-9A-Za-z.,/-])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?!(?!T[0-9]{2}:)[0-9A-Za-z]|[-/.,][0-9])"
DOT_DATE = r"(?<![0-9A-Za-z.,/-])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9A-Za-z]|[-/.,][0-9])"
SLASH_DATE = r"(?<![0-9A-Za-z.,/-])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9A-Za-z]|[-/.,][0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE_HOME = r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}(?![0-9A-Za-z])|" + PHONE_HOME
# Fewest and most digits of a phone number after its country code; others have 4 to 15 with the code.
PHONE_LENGTHS = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9),
    "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (7, 13), "44": (9, 10), "45": (8, 8), "46": (7, 9), "47": (8, 8),
    "48": (9, 9), "49": (6, 11), "52": (10, 10), "55": (10, 11), "60": (8, 10), "61": (9, 9), "64": (8, 10), "65": (8, 8), "66": (8, 9),
    "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "351": (9, 9), "353": (7, 9),
    "380": (9, 9), "420": (9, 9), "421": (9, 9), "852": (8, 8), "966": (9, 9), "971": (8, 9), "972": (8, 9),
}
# All digit groups in a row, with 13 digits at least. Possessive, so that a run of any length is matched without recursion.
CARDS = r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+"
CARD_DIGITS = (13, 19)
# Earlier kinds win where two match at one place. The date's group moves with its place in the whole.
PARTS = {
    "date_ymd": ISO_DATE, "email": EMAIL, "iban": IBAN, "ipv4": IPV4, "date_dmy": DOT_DATE, "date_mdy": SLASH_DATE,
    "ssn": SSN, "phone": PHONE,
}
# Kinds that never reach over a neighbour; they are looked for again in what others leave.
STRICT = PARTS | {"phone": PHONE_HOME}
del STRICT["iban"]
# Stand for values replaced in the first, second and third look; no text character has a meaning of its own there.
MARKS = ("\ufdd0", "\ufdd1", "\ufdd2")
ANY = "|".join(f"(?:{p})" for p in [*PARTS.values(), f"[{''.join(MARKS)}]"])
ANY_STRICT = "|".join(f"(?:{p})" for p in STRICT.values())


def whole(match: Column, kind: str) -> Column:
    """Whether a found value has this kind; its surroundings were checked when it was found."""
    return match.rlike(f"^(?:{PARTS[kind]})$")


def chars(text: Column) -> Column:
    return F.split(text, "(?!^)(?!$)")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written into the expression once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(digits: Column, radices: Column, key: str, kind: str) -> Column:
    """Permute a mixed-radix number, given and returned as an array of ints below their radices."""
    return let(F.struct(digits.alias("d"), radices.alias("r")), lambda v: _feistel(v["d"], v["r"], key, kind))


def _feistel(digits: Column, radices: Column, key: str, kind: str) -> Column:
    half = (F.size(digits) / 2).cast("int")
    rest = F.size(digits) - half
    start = F.struct(
        F.slice(digits, F.lit(1), half).alias("a"),
        F.slice(radices, F.lit(1), half).alias("ra"),
        F.slice(digits, half + 1, rest).alias("b"),
        F.slice(radices, half + 1, rest).alias("rb"),
    )

    def turn(state: Column, n: Column) -> Column:
        salt = F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), F.concat_ws(",", state["b"].cast("array<string>")))

        def move(digit: Column, at: Column) -> Column:
            hashed = F.conv(F.substring(F.sha2(F.concat_ws("#", salt, at.cast("string")), 256), 1, 12), 16, 10)
            radix = F.get(state["ra"], at)
            return ((digit + hashed.cast("bigint") % radix) % radix).cast("int")

        return F.struct(
            state["b"].alias("a"), state["rb"].alias("ra"), F.transform(state["a"], move).alias("b"), state["ra"].alias("rb")
        )

    # An even number of turns brings the halves back to their sides.
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def ints(*values: Column | int) -> Column:
    return F.array(*[(F.lit(v) if isinstance(v, int) else v).cast("int") for v in values])


def number(text: Column, group: int, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, group).cast("int")


def padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def poured(match: Column, symbols: Column, into: str) -> Column:
    """``match`` with its characters of class ``into`` replaced, in order, by ``symbols``."""
    cells = chars(match)
    filled = F.aggregate(
        cells,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("used")),
        lambda s, c: F.when(
            c.rlike(into),
            F.struct(F.concat(s["text"], F.get(symbols, s["used"])).alias("text"), (s["used"] + 1).alias("used")),
        ).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["used"].alias("used"))),
        lambda s: s["text"],
    )
    return filled


def digits_of(match: Column) -> Column:
    return F.transform(chars(F.regexp_replace(match, "[^0-9]", "")), lambda c: c.cast("int"))


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Luhn sum; places counted from the right, ``doubled_from`` 1 doubles the last digit, 2 the one before."""
    def weigh(digit: Column, at: Column) -> Column:
        doubled = digit * 2
        turned = (F.size(digits) - at + doubled_from) % 2 == 0
        return F.when(turned, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(digit)

    return F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, b: a + b)


def card(match: Column, key: str) -> Column:
    return let(digits_of(match), lambda digits: _card(match, digits, key))


def _card(match: Column, digits: Column, key: str) -> Column:
    n = F.size(digits)
    middle = F.slice(digits, F.lit(2), n - 2)
    out = let(
        F.concat(F.slice(digits, 1, 1), feistel(middle, F.transform(middle, lambda _: F.lit(10)), key, "card")),
        lambda moved: F.concat(moved, F.array(((10 - luhn_sum(moved, 1) % 10) % 10).cast("int"))).cast("array<string>"),
    )
    return F.when(valid_card(digits), poured(match, out, "[0-9]"))


def valid_card(digits: Column) -> Column:
    return (luhn_sum(digits, 2) % 10 == 0) & (F.size(F.array_distinct(digits)) > 1)


def cards(run: Column, key: str) -> Column:
    """The parts of a run of digit groups, with its cards replaced."""
    return let(F.regexp_extract_all(run, F.lit("[ -]?[0-9]+"), F.lit(0)), lambda groups: _cards(groups, key))


def _cards(groups: Column, key: str) -> Column:
    least, most = CARD_DIGITS
    n = F.size(groups)
    text = lambda at, k: F.array_join(F.slice(groups, at + 1, k), "")
    # Of each start: how many groups can be a card, and how many digits they have.
    sized = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda at: F.filter(
            F.transform(
                F.sequence(F.lit(1), F.least(F.lit(most), n - at)),
                lambda k: F.struct(k.alias("k"), F.length(F.regexp_replace(text(at, k), "[^0-9]", "")).alias("size")),
            ),
            lambda c: c["size"].between(least, most) & let(digits_of(text(at, c["k"])), valid_card),
        ),
    )

    def choose(state: Column, here: Column) -> Column:
        # A digit more outweighs shorter candidates; ties go to the one that starts first.
        taken = F.transform(
            here, lambda c: F.struct(
                (F.get(state["sums"], c["k"] - 1) + F.call_function("shiftleft", F.lit(1).cast("bigint"), (c["size"] - least) * 3)).alias("sum"),
                c["k"].alias("k"),
            )
        )
        skipped = F.struct(F.get(state["sums"], F.lit(0)).alias("sum"), F.lit(0).alias("k"))
        return let(
            F.array_max(F.concat(F.array(skipped), taken)),
            lambda best: F.struct(
                F.slice(F.concat(F.array(best["sum"]), state["sums"]), 1, most).alias("sums"),
                F.concat(F.array(best["k"]), state["ks"]).alias("ks"),
            ),
        )

    # From the last start to the first: the best sums of the starts that follow, and the groups to take at each.
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), most).alias("sums"), F.array().cast("array<int>").alias("ks"))
    chosen = F.aggregate(F.reverse(sized), start, choose, lambda s: s["ks"])

    def part(ks: Column) -> Column:
        taken = F.aggregate(
            F.sequence(F.lit(0), n - 1),
            F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,k:int>>").alias("parts")),
            lambda s, at: F.when(at < s["next"], s).otherwise(
                F.struct(
                    (at + F.greatest(F.get(ks, at), F.lit(1))).alias("next"),
                    F.concat(s["parts"], F.array(F.struct(at.alias("at"), F.get(ks, at).alias("k")))).alias("parts"),
                )
            ),
            lambda s: s["parts"],
        )
        return F.transform(
            taken,
            lambda p: F.when(p["k"] == 0, plain(F.get(groups, p["at"]))).otherwise(
                let(text(p["at"], p["k"]), lambda t: F.struct(t.alias("t"), card(t, key).alias("p")))
            ),
        )

    return let(chosen, part)


def mod97(text: Column) -> Column:
    """The number that an IBAN's letters and digits spell, modulo 97."""
    return F.aggregate(
        chars(text),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def permuted_letters(cells: Column, key: str, kind: str) -> Column:
    """Each letter or digit becomes one of its own class."""
    return let(cells, lambda c: _permuted_letters(c, key, kind))


def _permuted_letters(cells: Column, key: str, kind: str) -> Column:
    code = F.transform(cells, F.ascii)

    def of_run(c: Column, value) -> Column:
        """``value(first, n)`` of the run that a code point lies in."""
        first, n = RUNS[-1]
        out = F.lit(value(first, n))
        for first, n in reversed(RUNS[:-1]):
            out = F.when(c < first + n, F.lit(value(first, n))).otherwise(out)
        return out

    low = F.transform(code, lambda c: of_run(c, lambda first, n: first))
    radix = F.transform(code, lambda c: of_run(c, lambda first, n: n))
    moved = feistel(F.zip_with(code, low, lambda c, first: c - first), radix, key, kind)
    return F.zip_with(
        moved, low, lambda m, first: F.decode(F.unhex(F.lpad(F.hex((m + first).cast("bigint")), 4, "0")), "UTF-16BE")
    )


def iban(match: Column, key: str) -> Column:
    return let(F.regexp_replace(match, " ", ""), lambda bare: _iban(match, bare, key))


def _iban(match: Column, bare: Column, key: str) -> Column:
    n = F.length(bare)
    account = F.substring(bare, F.lit(5), n - 4)
    country = F.substring(bare, 1, 2)
    out = let(
        F.array_join(permuted_letters(chars(account), key, "iban"), ""),
        lambda moved: chars(F.concat(country, padded(98 - mod97(F.concat(moved, country, F.lit("00"))), 2), moved)),
    )
    return F.when(valid_iban(bare), poured(match, out, "[A-Z0-9]"))


def valid_iban(bare: Column) -> Column:
    n = F.length(bare)
    return (n >= 15) & (n <= 34) & (mod97(F.concat(F.substring(bare, F.lit(5), n - 4), F.substring(bare, 1, 4))) == 1)


def iban_head(match: Column) -> Column:
    """The longest start of ``match`` on its group borders that validates; null without one."""
    starts = let(
        F.split(match, " "),
        lambda g: F.transform(F.sequence(F.size(g), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(g, F.lit(1), k), " ")),
    )
    return F.get(F.filter(starts, lambda s: valid_iban(F.regexp_replace(s, " ", ""))), F.lit(0))


def phone_head(match: Column) -> Column:
    """The start of ``match``, from + on, that its country's number lengths and its groups allow; null without one."""
    return let(F.regexp_extract_all(match, F.lit("[ .-]?[^ .-]+"), F.lit(0)), lambda g: _phone_head(match, g))


def _phone_head(match: Column, groups: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    lengths = F.create_map(*[x for c, (a, b) in PHONE_LENGTHS.items() for x in (F.lit(c), ints(len(c), a, b))])
    # No country code starts with another one.
    known = F.coalesce(*[F.try_element_at(lengths, F.substring(digits, 1, i)) for i in (1, 2, 3)])
    code = F.least(F.length(F.regexp_extract(match, r"^\+([0-9]{1,3})", 1)), F.lit(3))
    size = lambda text: F.length(F.regexp_replace(text, "[^0-9]", ""))
    text = lambda k: F.array_join(F.slice(groups, F.lit(1), k), "")

    def longest(rule: Column) -> Column:
        # A zero that is dialled inside the country alone is not counted.
        own = lambda k: F.length(
            F.regexp_replace(_own(text(k), rule[0]), "^0", "")
        )
        ended = lambda k: (
            F.get(groups, k).startswith(" ") & (k > 1) & (size(F.get(groups, k - 1)) >= 6) & (own(k) >= 7)
        )
        fits = F.filter(
            F.sequence(F.size(groups), F.lit(1), F.lit(-1)),
            lambda k: own(k).between(rule[1], rule[2])
            & ~F.exists(F.sequence(F.lit(1), F.size(groups)), lambda j: (j < k) & F.coalesce(ended(j), F.lit(False))),
        )
        return F.transform(F.slice(fits, 1, 1), text)

    return F.get(let(F.coalesce(known, ints(code, 4, 15 - code)), longest), F.lit(0))


def _own(text: Column, code: Column) -> Column:
    """The digits of a phone number after its country code."""
    return F.substring(F.regexp_replace(text, "[^0-9]", ""), code + 1, F.length(text))


def phone(match: Column, key: str) -> Column:
    return let(digits_of(match), lambda digits: _phone(match, digits, key))


def _phone(match: Column, digits: Column, key: str) -> Column:
    n = F.size(digits)
    code = F.length(F.regexp_extract(match, r"^\+([0-9]{1,3})", 1))
    # +1 is read alone even where the next digits follow at once.
    code = F.when(match.startswith("+1"), F.lit(1)).otherwise(code)
    bare = let(code, lambda c: F.struct(F.slice(digits, F.lit(1), c).alias("code"), F.slice(digits, c + 1, n - c).alias("own")))
    out = let(bare, lambda p: F.concat(p["code"], _subscriber(p["own"], (F.size(p["code"]) == 0) | match.startswith("+1"), key)))
    valid = (n >= 7) & (n <= 15) & (n - code >= 4)
    return F.when(valid, poured(match, out.cast("array<string>"), "[0-9]"))


def _subscriber(own: Column, american: Column, key: str) -> Column:
    """Ten digits after +1, or without a country code, have an area and an exchange that start with 2 to 9."""
    lead = lambda i: american & (F.size(own) == 10) & ((i == 0) | (i == 3))
    low = F.transform(own, lambda d, i: F.when(lead(i) & (d >= 2), F.lit(2)).otherwise(F.lit(0)))
    radix = F.transform(
        own, lambda d, i: F.when(lead(i) & (d >= 2), F.lit(8)).when(lead(i), F.lit(2)).otherwise(F.lit(10))
    )
    moved = feistel(F.zip_with(own, low, lambda d, b: d - b), radix, key, "phone")
    return F.zip_with(moved, low, lambda d, b: d + b)


def ssn(match: Column, key: str) -> Column:
    pattern = r"([0-9]{3})-([0-9]{2})-([0-9]{4})"
    area, group, serial = (number(match, i, pattern) for i in (1, 2, 3))
    valid = (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)
    # 898 areas: 1 to 899 without 666.
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    out = let(
        feistel(ints(place, group - 1, serial - 1), ints(898, 99, 9999), key, "ssn"),
        lambda m: F.concat_ws(
            "-", padded(m[0] + F.when(m[0] >= 665, 2).otherwise(1), 3), padded(m[1] + 1, 2), padded(m[2] + 1, 4)
        ),
    )
    return F.when(valid, out)


def ipv4(match: Column, key: str) -> Column:
    octets = F.transform(F.split(match, r"\."), lambda c: c.cast("int"))
    moved = feistel(octets, F.array_repeat(F.lit(256), 4), key, "ipv4")
    return F.when(F.forall(octets, lambda o: o < 256), F.concat_ws(".", moved.cast("array<string>")))


def calendar_day(year: Column, month: Column, day: Column) -> Column:
    """Days since the cycle's start; null if there is no such day or it lies outside the cycle."""
    date = F.try_to_date(F.concat_ws("-", padded(year, 4), padded(month, 2), padded(day, 2)), "yyyy-MM-dd")
    days = F.date_diff(date, F.lit(CYCLE_START).cast("date"))
    return F.when((days >= 0) & (days < CYCLE[0] * CYCLE[1]), days)


def moved_date(days: Column, key: str) -> Column:
    moved = feistel(ints(F.floor(days / CYCLE[1]), days % CYCLE[1]), ints(*CYCLE), key, "date")
    return let(moved, lambda m: F.date_add(F.lit(CYCLE_START).cast("date"), m[0] * CYCLE[1] + m[1]))


def shown(n: Column, like: Column) -> Column:
    """A day or month with as many digits as the value it replaces is written with, if it fits."""
    return F.when(F.length(like) == 2, padded(n, 2)).otherwise(n.cast("string"))


def date_ymd(match: Column, key: str) -> Column:
    pattern = r"([0-9]{4})([-/.])([0-9]{1,2})[-/.]([0-9]{1,2})"
    part = lambda i: F.regexp_extract(match, pattern, i)
    days = calendar_day(part(1).cast("int"), part(3).cast("int"), part(4).cast("int"))
    write = lambda out: F.concat(
        padded(F.year(out), 4), part(2), shown(F.month(out), part(3)), part(2), shown(F.dayofmonth(out), part(4))
    )
    return let(days, lambda n: F.when(n.isNotNull(), let(moved_date(n, key), write)))


def date_dmy(match: Column, key: str) -> Column:
    pattern = r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})"
    part = lambda i: F.regexp_extract(match, pattern, i)
    days = calendar_day(part(3).cast("int"), part(2).cast("int"), part(1).cast("int"))
    write = lambda out: F.concat_ws(
        ".", shown(F.dayofmonth(out), part(1)), shown(F.month(out), part(2)), padded(F.year(out), 4)
    )
    return let(days, lambda n: F.when(n.isNotNull(), let(moved_date(n, key), write)))


def date_mdy(match: Column, key: str) -> Column:
    """Month first where that is a date; otherwise a day over 12 first, which stays over 12."""
    pattern = r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
    part = lambda i: F.regexp_extract(match, pattern, i)
    first, second, year = (part(i).cast("int") for i in (1, 2, 3))
    write = lambda out: F.concat_ws(
        "/", shown(F.month(out), part(1)), shown(F.dayofmonth(out), part(2)), padded(F.year(out), 4)
    )
    american = let(calendar_day(year, first, second), lambda n: F.when(n.isNotNull(), let(moved_date(n, key), write)))
    day_first = (first > 12) & (second <= 12) & calendar_day(year, second, first).isNotNull()
    return F.coalesce(american, F.when(day_first, _day_first(part, key)))


def _day_first(part, key: str) -> Column:
    """Days 13 to 28 exist in all months; 29 to 31 keep their number and move among the months that have it."""
    day, start = part(1).cast("int"), int(CYCLE_START[:4])
    free = day <= 28
    months = F.when(free, F.sequence(F.lit(1), F.lit(12))).when(day == 31, ints(1, 3, 5, 7, 8, 10, 12)).otherwise(
        ints(1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)
    )

    def write(months: Column) -> Column:
        at = F.array_position(months, part(2).cast("int")).cast("int") - 1
        moved = feistel(
            F.concat(ints(part(3).cast("int") - start, at), F.when(free, ints(day - 13)).otherwise(ints())),
            F.concat(ints(F.lit(400), F.size(months)), F.when(free, ints(16)).otherwise(ints())),
            key, "date_day_first",
        )
        return let(
            moved,
            lambda m: F.concat_ws(
                "/", padded(F.when(free, F.get(m, F.lit(2)) + 13).otherwise(day), 2),
                shown(F.get(months, m[1]), part(2)), padded(m[0] + start, 4),
            ),
        )

    # 29 February has no place among the months that every year gives the day; it stays.
    return let(months, lambda m: F.when(F.array_contains(m, part(2).cast("int")), write(m)))


def email(match: Column, key: str) -> Column:
    name, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    moved = permuted_letters(chars(F.regexp_replace(name, f"[^{MOVED[1:-1]}]", "")), key, "email")
    return F.concat(poured(name, moved, MOVED), F.lit("@"), domain)


KINDS = {
    "date_ymd": date_ymd, "email": email, "iban": iban, "ipv4": ipv4, "date_dmy": date_dmy, "date_mdy": date_mdy,
    "ssn": ssn, "phone": phone,
}


def pseudonym(match: Column, key: str, kinds) -> Column:
    """The pseudonym of one found value; null if it does not validate."""
    return F.coalesce(*[F.when(whole(match, kind), KINDS[kind](match, key)) for kind in kinds])


def plain(text: Column) -> Column:
    """A part of a text that is not replaced."""
    return F.struct(text.alias("t"), F.lit(None).cast("string").alias("p"))


def headed(match: Column, key: str) -> Column:
    """The parts of one found value and of what was found with it; marks of the text itself stay."""
    head = F.when(whole(match, "iban"), iban_head(match)).when(match.startswith("+"), phone_head(match))

    def cut(head: Column) -> Column:
        swapped = F.when(match.isin(*MARKS), match).otherwise(pseudonym(head, key, PARTS))
        rest = F.substring(match, F.length(head) + 1, F.length(match))
        return F.array(F.struct(head.alias("t"), swapped.alias("p")), plain(rest))

    return let(F.coalesce(head, match), cut)


def strict(match: Column, key: str) -> Column:
    return F.array(F.struct(match.alias("t"), pseudonym(match, key, STRICT).alias("p")))


def looked(text: Column, pattern: str, mark: str, parts_of) -> Column:
    """``text`` with a mark for every value replaced, and the parts replaced in order."""
    parts = F.flatten(
        F.zip_with(
            F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda b, f: F.when(f.isNull(), F.array(plain(b))).otherwise(F.concat(F.array(plain(b)), parts_of(f))),
        )
    )
    return let(
        parts,
        lambda p: F.struct(
            F.array_join(F.transform(p, lambda s: F.when(s["p"].isNull(), s["t"]).otherwise(F.lit(mark))), "").alias("text"),
            F.filter(p, lambda s: s["p"].isNotNull()).alias("done"),
        ),
    )


def unmarked(text: Column, mark: str, done: Column) -> Column:
    """``text`` with its marks replaced by the values they stand for."""
    return F.array_join(F.zip_with(F.split(text, mark, -1), done, lambda b, d: F.concat(b, F.coalesce(d["p"], F.lit("")))), "")


def swapped(text: Column, key: str) -> Column:
    """``text`` with its values replaced, and their number."""
    def written(a: Column, b: Column, c: Column) -> Column:
        own = F.filter(a["done"], lambda s: ~s["t"].isin(*MARKS))
        out = unmarked(unmarked(c["text"], MARKS[2], c["done"]), MARKS[1], b["done"])
        return F.struct(
            unmarked(out, MARKS[0], a["done"]).alias("text"), (F.size(own) + F.size(b["done"]) + F.size(c["done"])).alias("n")
        )

    return let(
        looked(text, ANY, MARKS[0], lambda m: headed(m, key)),
        lambda a: let(
            looked(a["text"], ANY_STRICT, MARKS[1], lambda m: strict(m, key)),
            lambda b: let(looked(b["text"], CARDS, MARKS[2], lambda m: cards(m, key)), lambda c: written(a, b, c)),
        ),
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the values in ``text`` replaced and their number in ``n_replaced``."""
    # Most texts have no digit and no @; they are passed on after one scan.
    found = F.when(F.col(text).rlike("[0-9@]"), swapped(F.col(text), key))
    names = [c for c in docs.columns if c != "n_replaced"]
    return docs.withColumn("_found", found).select(
        *[F.coalesce("_found.text", c).alias(c) if c == text else F.col(c) for c in names],
        F.coalesce("_found.n", F.lit(0)).alias("n_replaced"),
    )
