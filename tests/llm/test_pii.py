import re

from palimpsest.llm import pii

KEY = "a key"

ROWS = [
    (1, "Mail Und.34@mail7.example.com or UND.34@MAIL7.example.com, call +1 (017) 555-7713 / +1-017-555-7713."),
    (2, "card 4111 1111 1111 1111 4111111111111111 and 9807915762804490 ip 97.51.17.173 ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00"),
    (3, 'Mr. John Smith met Mrs. Anna Smith and Mr. Smith. Господин Иван Петров. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'),
    (4, None), (5, ""), (6, "nothing here, version 2.0. CC BY-NC 4.0"), (7, "a" * 200_000 + " b@c.de"), (7, "a" * 200_000 + " b@c.de"), (None, "x 97.51.17.173"),
]


def test_surrogates(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in ROWS], "doc_id long, text string, _text string").repartition(3)
    found = pii.pseudonymise(df, KEY).collect()
    assert len(found) == len(ROWS) and pii.pseudonymise(df, KEY).columns == [*df.columns, "n_entities"]
    by = {r.doc_id: r.text for r in found}
    assert by[4] is None and by[5] == "" and by[6] == ROWS[5][1]
    mails = re.findall(r"\S+@[\w.]+", by[1])
    assert mails[0].lower() == mails[1].rstrip(",").lower() and mails[0] != "Und.34@mail7.example.com" and mails[0][0].isupper()
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) / \+1-(\d{3})-(\d{3})-(\d{4})", by[1])[0]
    assert phones[:3] == phones[3:] and phones[:3] != ("017", "555", "7713")
    spaced, solid, other = re.search(r"card ((?:\d{4} ){3}\d{4}) (\d{16}) and (\d{16})", by[2]).groups()
    assert spaced.replace(" ", "") == solid != other
    digits = [int(c) for c in solid][::-1]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    people = re.search(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Mr\. (\w+)\. Господин (\w+) (\w+)\.", by[3]).groups()
    assert people[1] == people[3] == people[4] != "Smith" and people[0] in pii.GIVEN["m", "latin"] and people[2] in pii.GIVEN["f", "latin"]
    assert people[5] in pii.GIVEN["m", "cyrillic"] and re.fullmatch("[А-Я][а-я]+", people[6])
    assert re.search(r'token = "[0-9a-f]{40}"', by[3]) and "04dbeb" not in by[3]
    assert re.search(r"ip (\S+)", by[2])[1] == by[None][2:] != "97.51.17.173"
    texts = " ".join(t for t in by.values() if t)
    for real in ("und.34@", "555-7713", "4111", "9807915762804490", "97.51.17.173", "123-45-6789", "b@c.de", "3704 0044"):
        assert real not in texts.lower()


def test_collisions_are_drawn_again(spark):
    rows = [("person", f"name{i}") for i in range(3000)]  # more than the short names' space holds without meeting
    found = pii.surrogates(spark.createDataFrame(rows, "kind string, canon string"), KEY).collect()
    assert len({r.canon for r in found}) == len({r.surrogate for r in found}) == 3000
    assert not {r.canon for r in found} & {r.surrogate for r in found}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in digits[::-1])) % 10


def iban_rest(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_every_kind_stays_distinct_and_of_its_form(spark):
    rows = [("phone", f"1|{i:04}") for i in range(6000)] + [("email", f"{a}@b.de") for a in "abcdefghijklmnopqrstuvwxyz"]
    rows += [("card", f"411111111111{i:04}") for i in range(500)] + [("ssn", f"12345{i:04}") for i in range(300)]
    rows += [("iban", f"DE{i:02}3704004405320130{j:02}") for i in range(100) for j in range(5)] + [("ip", f"10.0.{i}.{j}") for i in range(20) for j in range(20)]
    rows += [("secret", f"{i:040x}") for i in range(200)] + [("secret", f"Ab-{i:06}-zéд") for i in range(200)]
    found = {(r.kind, r.canon): r.surrogate for r in pii.surrogates(spark.createDataFrame(rows, "kind string, canon string"), KEY).collect()}
    assert set(found) == set(rows) and len({(k, s) for (k, _), s in found.items()}) == len(rows)
    assert not any(canon == s for (_, canon), s in found.items())
    for (kind, canon), s in found.items():
        assert len(s) == len(canon) or kind == "ip"
        if kind == "card":
            assert luhn(s) == luhn(canon)
        if kind == "iban" and 2 <= int(canon[2:4]) <= 98:
            assert s[:2] == "DE" and (iban_rest(s) == 1) == (iban_rest(canon) == 1)
        if kind == "ip":
            assert all(0 <= int(o) <= 255 for o in s.split("."))
        if kind == "secret" and canon[0] == "A":
            assert re.fullmatch(r"[A-Z][a-z]-\d{6}-[a-z]{2}[а-я]", s)
    again = pii.surrogates(spark.createDataFrame(rows[::-7], "kind string, canon string"), KEY).collect()
    assert all(found[r.kind, r.canon] == r.surrogate for r in again)


def test_empty(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).collect() == []


def test_persons_of_a_family_stay_apart(spark):
    names = ["John", "Peter", "Adam", "Bruno", "Carl", *(f"N{chr(97 + i)}o" for i in range(20))]
    df = spark.createDataFrame([(i, f"Mr. {n} Smith") for i, n in enumerate(names)], "doc_id long, text string")
    found = [r.text for r in pii.pseudonymise(df, KEY).collect()]
    assert len(set(found)) == len(names) and len({t.split()[-1] for t in found}) == 1
    assert not {t.split()[1] for t in found} & set(names)


def test_secrets_in_capitals_and_national_phones(spark):
    rows = [(1, 'TOKEN = "9233A8BCDEF01234"'), (2, "call (017) 555-7713 or 017-555-7713"), (3, 'Password: "abcdefghij"')]
    found = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert "9233A8" not in found[1] and "555-7713" not in found[2] and "abcdefghij" not in found[3]
