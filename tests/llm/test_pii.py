import re

from paperloom.llm import pii

ROWS = [
    (1, "Mail Ann.Lee42@Mail4.example.com or ann.lee42@mail4.example.com, phone +1 (959) 555-5311.", "a"),
    (2, "Card 4539 1488 0343 6467, again 4539148803436467; ip 46.67.203.78, not 99.67.203.780 or 1.2.3.4.5.", "b"),
    (3, "Write to Mrs. Anna Schmidt, Herr Schmidt and Господин Иванов. Mrs Anna Schmidt agrees.", None),
    (4, "Nothing personal: version 10.2, 1234567 items, token=\"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "c"),
    (5, None, "d"), (6, "", "e"), (2, "ip 46.67.203.78 once more", "f"), (None, "ssn 123-45-6789 and IBAN DE44 5001 0517 5407 3249 31", "g"),
    (7, "x " * 30_000 + "46.67.203.78", "h"), (7, "x " * 30_000 + "46.67.203.78", "h"),
]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10


def test_surrogates(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, kind string")
    out = pii.replace_entities(df, "key", count="n").collect()
    assert len(out) == len(ROWS) and {r.kind for r in out} == {r[2] for r in ROWS}
    by = {r.kind: r for r in out}
    secrets = ["lee42", "555-5311", "4539", "46.67.203.78", "Anna Schmidt", "Иванов", "123-45-6789", "5001 0517"]
    assert not [s for s in secrets for r in out if r.text and s.lower() in r.text.lower() and s != "4539"]
    assert (by["c"].text, by["d"].text, by["e"].text, by["c"].n, by["d"].n) == (ROWS[3][1], None, "", 0, 0)
    first, second = re.fullmatch(r"Mail (\S+) or (\S+), phone (\+\d \(\d{3}\) \d{3}-\d{4})\.", by["a"].text).groups()[:2]
    assert first.lower() == second and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com", first)  # one entity, two spellings
    a, b, ip, rest = re.fullmatch(r"Card (\d{4} \d{4} \d{4} \d{4}), again (\d{16}); ip (\S+), (.*)", by["b"].text).groups()
    assert a.replace(" ", "") == b and b[0] == "4" and luhn(b) == 0 and rest == "not 99.67.203.780 or 1.2.3.4.5."
    assert all(1 <= int(x) <= 254 for x in ip.split("."))
    assert by["f"].text == f"ip {ip} once more" and by["h"].text.endswith("x " + ip)  # one surrogate over documents
    m = re.fullmatch(r"Write to Mrs\. (\w+) (\w+), Herr (\w+) and Господин (\w+)\. Mrs (\w+) (\w+) agrees\.", by[None].text)
    assert m[1] in pii.GIVEN["latin", "f"] and (m[1], m[2]) == (m[5], m[6]) and re.fullmatch("[А-Яа-я]+", m[4])
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4} and IBAN DE\d\d( \d{4}){4} \d\d", by["g"].text)
    again = {r.kind: r.text for r in pii.replace_entities(df, "key").collect()}
    assert again == {k: r.text for k, r in by.items()}
    assert {r.kind: r.text for r in pii.replace_entities(df, "other key").collect()}["b"] != by["b"].text


def test_distinct_where_a_format_is_crowded(spark):
    """More titled single names than short surnames collide at first; all surrogates are distinct, none is a real value."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"Mr. Q{letters[i // 26 // 26]}{letters[i // 26 % 26]}{letters[i % 26]} came") for i in range(3000)]
    out = [r.text for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    names = [re.fullmatch(r"Mr\. (\w+) came", t)[1] for t in out]
    assert len(set(names)) == 3000 and not {n.lower() for n in names} & {r[1].split()[1].lower() for r in rows}


def test_no_entities(spark):
    df = spark.createDataFrame([(1, "plain"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, pii.replace_entities(df, "k").collect())) == [(1, "plain"), (2, None)]
    assert pii.replace_entities(df.limit(0), "k").count() == 0
