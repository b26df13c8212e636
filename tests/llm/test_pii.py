import pyarrow as pa
import pytest

from marquetry.llm import pii as P


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("write to jane.doe+x@mail.example.com now", "email", "jane.doe+x@mail.example.com"),
        ("pf die.55@mail4.example.com.", "email", "die.55@mail4.example.com"),
        ("card 4111 1111 1111 1111.", "card", "4111 1111 1111 1111"),
        ("so 4845168114407329 is", "card", "4845168114407329"),
        ("amex 3782-822463-10005 ok", "card", "3782-822463-10005"),
        ("IBAN DE89 3704 0044 0532 0130 00 please", "iban", "DE89 3704 0044 0532 0130 00"),
        ("GB29NWBK60161331926819", "iban", "GB29NWBK60161331926819"),
        ("from 217.75.41.129 and", "ipv4", "217.75.41.129"),
        ("her ssn is 536-22-1234", "ssn", "536-22-1234"),
        ("call +1 (437) 555-0689 ndre", "phone", "+1 (437) 555-0689"),
        ("Telefon 030 1234 5678", "phone", "030 1234 5678"),
    ],
)
def test_found(text, kind, value):
    assert [(k, text[a:b]) for k, a, b, _ in P.spans(text)] == [(kind, value)]


@pytest.mark.parametrize(
    "text",
    ["so 9807915762804490 no", "DE89 3704 0044 0532 0130 01", "300.1.2.3 here", "version 1.2.3.4", "1.2.3.4.5", "000-12-3456", "in 1998 and 2004-2005", "a@b", "@home", "sum 12 345 678", "x4845168114407329", "0000 0000 0000 0000", "isbn 978-3-16-148410-0"],
)
def test_not_found(text):
    assert P.spans(text) == []


@pytest.mark.parametrize(
    "number",
    [
        "+49 30 1234567", "+49 (0)30 1234567", "(+49) 30 1234567", "+44 7911 123456", "+44 20 7946 0958", "+34 612345678", "+1 5551234567", "+1-800-555-1234", "1 (555) 123-4567", "+33 6 12 34 56 78", "+39 06 12345678",
        "+81 3-1234-5678", "+86 138 0013 8000", "+55 11 91234-5678", "+7 (495) 123-45-67", "+46 8 123 456 78", "+45 12345678", "+353 1 234 5678", "+61 2 9876 5432", "+91 98765 43210", "+442079460958",
    ],
)
def test_phones_whatever_the_context(number):
    text = f"so {number} is"
    assert [(k, text[a:b]) for k, a, b, _ in P.spans(text)] == [("phone", number)]


@pytest.mark.parametrize("number", ["(555) 1234567", "5551234567", "07911 123456", "612345678", "01 23 45 67 89", "030/1234567", "0171-12345678", "1-800-5551234", "(030) 1234567", "098765 43210"])
def test_phones_by_context(number):
    for text, want in ((f"phone {number}, yes", [("phone", number)]), (f"so {number}, yes", [])):
        assert [(k, text[a:b]) for k, a, b, _ in P.spans(text)] == want


def test_neighbouring_numbers():
    text = "tel 5551234567 12345678901 or +49 30 1234567 +44 7911 123456"
    assert [text[a:b] for _, a, b, _ in P.spans(text)] == ["5551234567", "12345678901", "+49 30 1234567", "+44 7911 123456"]
    assert P.spans("call 4845 1681 1440 7321 now") == []
    assert [k for k, *_ in P.spans("tel 5551234 10.10.10.10 +1 5551234567 4111 1111 1111 1111")] == ["phone", "ipv4", "phone", "card"]


@pytest.mark.parametrize("after", [" EUR", " IBAN", " BANK EUR", " NL91 ABNA 0417 1643 00", " TOTAL", ""])
def test_iban_before_upper_case_words(after):
    text = "to BE68 5390 0754 7034" + after
    assert [text[a:b] for k, a, b, _ in P.spans(text) if k == "iban"] == ["BE68 5390 0754 7034"] + ["NL91 ABNA 0417 1643 00"] * ("NL91" in after)


def test_check_digits():
    def slow_luhn(s):
        digits = [int(c) for c in s][::-1]
        return sum(d if i % 2 == 0 else sum(map(int, str(2 * d))) for i, d in enumerate(digits)) % 10 == 0

    for k in range(10**15, 10**15 + 300):
        assert P.luhn(str(k)) == slow_luhn(str(k))
    assert sum(P.mod97(f"DE{k:02}370400440532013000") for k in range(2, 99)) == 1


def naive_cards(text):
    """Every run of 13 to 19 digits with nothing word-like around it that passes Luhn, found by a loop over characters."""
    out, i = [], 0
    while i < len(text):
        if not text[i].isdigit():
            i += 1
            continue
        j = i
        while j < len(text) and text[j].isdigit():
            j += 1
        before, after = text[i - 1 : i], text[j : j + 1]
        alone = not (before and (before.isalnum() or before in "_.+-")) and not (after and (after.isalnum() or after == "_"))
        if alone and 13 <= j - i <= 19 and P.luhn(text[i:j]) and len(set(text[i:j])) > 1:
            out.append((i, j))
        i = j
    return out


def naive_ipv4(text):
    """Every substring of four numbers up to 255 joined by dots that isn't part of a longer one."""
    out = []
    for i in range(len(text)):
        for j in range(i + 7, min(len(text), i + 15) + 1):
            parts = text[i:j].split(".")
            if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
                before, after = text[i - 1 : i], text[j : j + 2]
                if not (before and (before.isalnum() or before in "_.")) and not (after[:1].isalnum() or after[:1] == "_" or (after[:1] == "." and after[1:].isdigit())):
                    out.append((i, j))
    return out


def test_against_loops_over_characters():
    import random

    rng = random.Random(0)
    hits = 0
    for _ in range(3000):
        kind = rng.choice("ci")
        if kind == "c":
            text = "".join(rng.choice(["a", " ", "_", ".", "4", "41111111111111", "4845168114407329", "12"]) for _ in range(8))
            want = naive_cards(text)
            got = [(m.start(), m.end()) for m in P._CARD.finditer(text) if m.group().isdigit() and P.luhn(m.group()) and len(set(m.group())) > 1]
        else:
            text = "".join(rng.choice(["1", "25", "256", ".", ".", ".", " ", "a", "99"]) for _ in range(14))
            want = naive_ipv4(text)
            got = [(m.start(), m.end()) for m in P._IPV4.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
        assert got == want, text
        hits += bool(want)
    assert hits > 50


def test_neighbours_and_overlaps():
    text = "7536784127813050 4845168114407329 tel +1 (826) 555-4081 190.137.223.204"
    assert [k for k, *_ in P.spans(text)] == ["card", "card", "phone", "ipv4"]


def test_redaction(spark, odd, empty):
    df = spark.createDataFrame([(1, "ä a@b.de und 217.75.41.129", 99), (2, None, None), (3, "", 0), (4, "clean 12", 8)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in P.redact(df).collect()] == [(1, "ä [EMAIL] und [IPV4]", 20), (2, None, None), (3, "", 0), (4, "clean 12", 8)]
    assert P.redact(odd).columns == odd.columns and P.redact(odd).select("text").collect() == odd.select("text").collect()
    assert P.find(odd).collect() == [] and P.find(empty).collect() == [] and P.redact(empty).collect() == []


def test_planted(spark, sf_dir):
    import re

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = P.op9_pii(spark, sf_dir).collect()
    text = {r["doc_id"]: r["text"] for r in docs}
    got = {(r["doc_id"], text[r["doc_id"]][r["start"] : r["end"]]) for r in rows}
    want = {(i, m) for i, t in text.items() for m in re.findall(r"\+1 \(\d{3}\) 555-\d{4}|[a-z]+\.\d\d@mail\d\.example\.com|(?<!\d)\d{16}(?!\d)", t) if not m.isdigit() or P.luhn(m)}
    assert {(i, m) for i, m in want if "@" not in m} <= got
    assert {i for i, m in want if "@" in m} <= {i for i, m in got if "@" in m}


def test_overlaps_against_all_pairs(monkeypatch):
    import random

    rng = random.Random(5)
    for _ in range(200):
        found = [("email", a, a + rng.randint(1, 12), round(rng.choice([0.5, 0.6, 0.9]), 4)) for a in (rng.randint(0, 80) for _ in range(25))]
        monkeypatch.setattr(P, "_proposals", lambda text, found=found: iter(found))
        want = []
        for x in sorted(found, key=lambda x: (-x[3], x[1] - x[2], x[1])):
            if all(x[2] <= k[1] or x[1] >= k[2] for k in want):
                want.append(x)
        assert P.spans(" " * 100) == sorted(want, key=lambda x: x[1])


def test_many_spans_in_one_text(spark):
    import time

    text = " ".join(f"user{i}@mail.example.com" for i in range(100_000))
    began = time.process_time()
    assert len(P.spans(text)) == 100_000
    assert P._redacted(pa.array([text]))[0].as_py() == " ".join(["[EMAIL]"] * 100_000)
    assert time.process_time() - began < 60
