"""Personal data beside other digits."""

from lexiforge.llm import pii


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


CASES = [
    ("4111 1111 1111 1111 12/25", "4111 1111 1111 1111", "card"),
    ("4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"),
    ("4111111111111111 737", "4111111111111111", "card"),
    ("5 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
    ("1234 4111 1111 1111 1111 99", "4111 1111 1111 1111", "card"),
    ("3782-822463-10005 17", "3782-822463-10005", "card"),
    ("+14155550123", "+14155550123", "phone"),
    ("2024-01-15T10:00:00Z", "2024-01-15", "date"),
    ("2024-13-15 2024-01-15", "2024-01-15", "date"),
]


def test_values_beside_other_digits(spark):
    texts = [f"so {t} it is" for t, _, _ in CASES]
    rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    for r, whole, (text, value, kind) in zip(rows, texts, CASES):
        before, after = whole.split(value)
        new = [x.new for x in r.pii if x.kind == kind]
        assert len(r.pii) == 1 and len(new) == 1, text
        assert r.text == before + new[0] + after and new[0] != value and len(new[0]) == len(value), text
        assert kind != "card" or _luhn(new[0]), text


def test_equal_cards_change_alike_and_two_in_a_row_are_found(spark):
    texts = ["4111 1111 1111 1111", "7 4111 1111 1111 1111 3", "4111 1111 1111 1111 5500 0000 0000 0004 1", "1111 2222 3333 4445 55"]
    rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    card = rows[0].text
    assert rows[1].text == f"7 {card} 3"
    assert rows[2].text.startswith(card + " ") and rows[2].text.endswith(" 1") and [x.kind for x in rows[2].pii] == ["card", "card"]
    assert rows[3].text == texts[3]


def test_runs_of_a_megabyte(spark):
    """A million digits, digits with blanks, and cards in a row: no crash, and values beside them are found."""
    from time import perf_counter

    card = "4111 1111 1111 1111"
    texts = ["7" * 1_000_000, "7 " * 500_000, f"{'12 ' * 100_000}x {card} y", (card + " ") * 2_000, "1" * 30 + "x", "12-" * 300_000 + "a@b.example.com"]
    at = perf_counter()
    rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert perf_counter() - at < 120
    assert [len(r.text) for r in rows] == [len(t) for t in texts]
    assert [x.kind for x in rows[2].pii] == ["card"] and len(rows[3].pii) == 2_000 and len(set(rows[3].text.split("  "))) == 1
    assert rows[0].pii == [] and rows[0].text == texts[0] and rows[4].text == texts[4]
