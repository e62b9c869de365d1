"""Pseudonyms against a row-at-a-time rule of the same network."""

import hashlib
from datetime import date, timedelta

from labelmill.llm import pseudonyms

KEY = "k1"


def network(digits, radices, kind):
    half = len(digits) // 2
    a, ra, b, rb = digits[:half], radices[:half], digits[half:], radices[half:]
    for turn in range(1, pseudonyms.ROUNDS + 1):
        salt = "|".join([KEY, kind, str(turn), ",".join(map(str, b))])
        move = [(d + int(hashlib.sha256(f"{salt}#{i}".encode()).hexdigest()[:12], 16) % r) % r for i, (d, r) in enumerate(zip(a, ra))]
        a, ra, b, rb = b, rb, move, ra
    return a + b


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))) % 10


def replaced(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_replaced string")
    rows = pseudonyms.pseudonymise(df, KEY).orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["n_replaced"] for r in rows]


def test_cards_keep_format_and_link(spark):
    (plain, spaced, wrong), n = replaced(spark, ["4041894974608795", "a 4041 8949 7460 8795.", "4041894974608796"])
    digits = [int(c) for c in "4041894974608795"]
    moved = digits[:1] + network(digits[1:-1], [10] * 14, "card")
    moved.append((10 - luhn([*moved, 0])) % 10)
    assert plain == "".join(map(str, moved)) and luhn(moved) == 0
    assert spaced.replace(" ", "") == f"a{plain}." and spaced[6] == spaced[11] == " "
    assert wrong == "4041894974608796" and n == [1, 1, 0]


def test_dates_in_three_orders(spark):
    texts, n = replaced(spark, ["1999-02-28", "28.2.1999", "02/28/1999", "2001-02-30", "31/01/2001", "29/02/2000 x"])
    days = (date(1999, 2, 28) - date(1800, 1, 1)).days
    a, b = network([days // 773, days % 773], list(pseudonyms.CYCLE), "date")
    moved = date(1800, 1, 1) + timedelta(a * 773 + b)
    assert texts[0] == moved.isoformat() and texts[2] == moved.strftime("%m/%d/%Y")
    assert texts[1] == f"{moved.day:02}.{moved.month}.{moved.year}"
    assert texts[3] == "2001-02-30" and texts[4].startswith("31/") and texts[5] == "29/02/2000 x"
    assert n == [1, 1, 1, 0, 1, 0]


def test_permutations_of_whole_formats(spark):
    octets = [f"10.0.{i}.{j}" for i in range(12) for j in range(20)]
    names, _ = replaced(spark, octets)
    assert len(set(names)) == len(octets) and all(all(int(o) < 256 for o in x.split(".")) for x in names)
    phones, _ = replaced(spark, [f"+1 (389) 555-{i:04}" for i in range(200)])
    assert len(set(phones)) == 200 and all(p[4] in "23456789" and p[9] in "23456789" and len(p) == 17 for p in phones)
    ibans, n = replaced(spark, ["DE89 3704 0044 0532 0130 00", "DE88370400440532013000"])
    bare = ibans[0].replace(" ", "")
    assert n == [1, 0] and bare[:2] == "DE" and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    ssns, n = replaced(spark, ["123-45-6789", "000-12-1234"])
    assert n == [1, 0] and ssns[0] != "123-45-6789" and ssns[1] == "000-12-1234"
    mails, n = replaced(spark, ["bosbt.42@mail8.example.com", "a@b"])
    assert n == [1, 0] and mails[0][5] == "." and mails[0].endswith("@mail8.example.com")


def test_awkward_rows(spark, docs, no_docs):
    got = pseudonyms.pseudonymise(docs, KEY)
    before, after = docs.collect(), got.collect()
    assert got.columns == [*docs.columns, "n_replaced"]
    assert [r["text"] for r in before] == [r["text"] for r in after] and {r["n_replaced"] for r in after} == {0}
    assert pseudonyms.pseudonymise(no_docs, KEY).count() == 0
    (many,), (n,) = replaced(spark, ["x 42.144.35.254 " * 5000])
    assert n == 5000 and len(set(many.split())) == 2


def test_only_expressions(docs):
    plan = pseudonyms.pseudonymise(docs, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_values_beside_numbers_and_words(spark):
    card, iban, phone, day = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332", "+49 30 1234567", "2024-01-05"
    (new_card, new_iban, new_phone, new_day), n = replaced(spark, [card, iban, phone, day])
    assert n == [1, 1, 1, 1] and card != new_card and iban != new_iban and phone != new_phone and day != new_day
    swaps = {card: new_card, iban: new_iban, phone: new_phone, day: new_day}
    shapes = [
        f"{card} 12/27", f"{card} 123", f"ref 12345 {card}", f"{card} {card} 7", f"1 {card} 12x", f"{card} {day}", f"7 {day} {card}",
        f"{iban} USA", f"{iban} CODE", f"{iban} {iban}", f"{iban} {card}", f"{iban} {day}",
        f"{phone} 12 times", f"{phone} {card}", f"{phone} {day}", f"+1 {card}", "\ufdd0 " + f"{card}\ufdd2 {day} \ufdd1",
    ]
    got, n = replaced(spark, shapes)
    for shape, text, count in zip(shapes, got, n):
        want = shape
        for old, new in swaps.items():
            want = want.replace(old, new)
        assert (text, count) == (want, sum(shape.count(v) for v in swaps))
    # A number may be longer than any card, and a long row of numbers is no card as a whole.
    (long, row), n = replaced(spark, ["1" * 20_000, "0 " * 3000 + card + " 0" * 3000])
    assert long == "1" * 20_000 and card not in row and len(row) == 12_019


def test_phone_ends(spark):
    phones = ["+33 1 23 45 67 89", "+1 389 555 0123", "+44 20 7946 0958", "+32 (0)475 12 34 56"]
    alone, _ = replaced(spark, phones)
    beside, n = replaced(spark, [f"{p} 12 times" for p in phones])
    assert beside == [f"{p} 12 times" for p in alone] and n == [1] * 4 and not set(alone) & set(phones)


def test_names_beyond_ascii_and_timestamps(spark):
    texts = ["an j\u00fcrgen.m\u00fcller@example.com, user@b\u00fccher.de", "\u0438\u0432\u0430\u043d@example.ru", "at 2021-03-05T10:00:00Z", "2021-03-05Tx", "2021-03-05T10"]
    found, n = replaced(spark, texts)
    assert n == [2, 1, 1, 0, 0] and found[3:] == texts[3:]
    name = found[0].split("@")[0].removeprefix("an ")
    first, last = name.split(".")
    assert len(first) == 6 and len(last) == 6 and name != "j\u00fcrgen.m\u00fcller"
    # Accented letters become accented ones, and no part of the name stays in clear.
    assert all(ord(c) > 127 for c in (first[1], last[1])) and sum(a == b for a, b in zip(name, "j\u00fcrgen.m\u00fcller")) <= 4
    assert found[0].endswith("@b\u00fccher.de") and "@example.com, " in found[0]
    assert all("\u0430" <= c <= "\u044f" for c in found[1].split("@")[0]) and found[1].endswith("@example.ru")
    assert found[2].endswith("T10:00:00Z") and found[2] != texts[2]
    # Equal names stay equal wherever they stand, different ones differ.
    again, _ = replaced(spark, ["j\u00fcrgen.m\u00fcller@example.com", "j\u00fcrgen.m\u00fcllex@example.com"])
    assert again[0].split("@")[0] == name != again[1].split("@")[0]
