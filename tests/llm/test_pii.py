import re

from loomwork.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    t = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    order = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


TEXTS = [
    "🦄 mail a.b+c@d-e.co.uk_x@y.z, x@y a@b.c@d.e",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0000255 1.2.3 99999999999999999999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 378282246310005 and 12 34",
    "call +49 (30) 123-4567 89, +1 23, +1 234 567 8901 2345 678",
    "+4111 1111 1111 1111",
    "IBAN DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01; ssn 123-45-6789; code 123-45-6789",
    "a" * 60_000 + " " + "1" * 60_000 + " " + "1.2." * 20_000,
    " ".join(f"10.0.{i // 250}.{i % 250}" for i in range(900)),
    "",
    None,
]


def test_spans_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.rank < 4] == base(r.text), r.doc_id


def test_checksums_and_context(spark):
    r = pii.find_pii(spark.createDataFrame([(1, TEXTS[5])], "doc_id long, text string")).first()
    added = [(s.kind, r.text[s.start : s.end], s.score) for s in r.spans if s.rank > 3]
    assert added == [("iban", "DE89 3704 0044 0532 0130 00", 1.0), ("ssn", "123-45-6789", 0.65), ("ssn", "123-45-6789", 0.65)]
    far = pii.find_pii(spark.createDataFrame([(1, "code " + "x" * 40 + " 123-45-6789")], "doc_id long, text string")).first()
    assert far.spans == []


def test_odd_rows(odd, none):
    out = pii.find_pii(odd)
    assert out.columns == [*(c for c in odd.columns if c != "spans"), "spans"] and out.count() == 12
    assert {r.doc_id: [s.kind for s in r.spans] for r in out.collect() if r.spans} == {11: ["email"]}
    assert pii.find_pii(none).count() == 0


def test_ibans_of_all_lengths_before_words(spark):
    numbers = (
        "NO9386011117947 BE68539007547034 NL91ABNA0417164300 AT611904300234573201 CH9300762011623852957 DE89370400440532013000 GI75NWBK000000007099453"
        " ES9121000418450200051332 SE4550000000058398257466 CZ6508000000192000145399 FR1420041010050500013M02606 PL61109010140000071219812874 MT84MALT011000012345MTLCAST001S"
    ).split()
    forms = [n for x in numbers for n in (x, " ".join(x[i : i + 4] for i in range(0, len(x), 4)))]
    want = {f"to {n}{after}": [n] for n in forms for after in (" Please", " PLEASE NOW", " 12 Main", " 2024", " A", "and", ".", "")}
    want |= {f"{a} {b}": [a, b] for a in numbers for b in numbers}
    rows = pii.find_pii(spark.createDataFrame([(t,) for t in want], "text string")).collect()
    assert {r.text: [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] for r in rows} == want
    other = pii.find_pii(spark.createDataFrame([("iban DZ580002100001113000000570 Please",), ("AT611904300234573202 Please",), ("AT611904300234573201P",)], "text string")).collect()
    assert [[r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] for r in other] == [["DZ580002100001113000000570"], [], []]
