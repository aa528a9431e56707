import hashlib
import random
import re
import time

from glyphline.llm import pii

# the base patterns as the contract has them
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def expected(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 10 <= len(digits(m)) <= 15,
    }
    spans = []
    for rank, (kind, p) in enumerate([("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)]):
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(p, text or "") if good[kind](m.group())]
    spans.sort()
    counts = [sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone")]
    text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return (*counts, hashlib.sha256(text.encode()).hexdigest()), text


def made(seed):
    rng = random.Random(seed)
    bits = ["a@b.c", "x.y+z@d-e.f.g.", "@", "1.2.3.4", "256.1.1.1", "01.002.3.255.6", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (663) 555-6869",
            "+49 30 1234567 ", "+1", "ü😀", " ", ".", "\n", "7", "+", "-", "(", "ab", "%", "00000000000000", "12345678901234567890"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]


def test_base_spans_equal_the_contract(spark):
    texts = made(3) + [None, "", "9" * 30000, "a" * 200000, "a." * 50000 + "@", "1 " * 40000, "x@" + "y." * 30000 + "z", "+1" + "(" * 100000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.report(df).collect():
        want, spans = expected(texts[r.doc_id])
        assert tuple(r)[1:6] == want, texts[r.doc_id]
        assert not spans or set(spans.split(",")) <= set(r.spans.split(","))


def test_added_spans_and_redaction(spark):
    cases = {
        1: ("Cards 4465758382889437 4465758382889437.", "card:6:22,card:23:39"),
        2: ("pay to DE89 3704 0044 0532 0130 00 now", "iban:7:34"),
        3: ("pay to DE88 3704 0044 0532 0130 00 now", ""),
        4: ("call 555-123-4567 " + "la " * 20 + "order 555-123-4568", "phone:5:17"),
        5: ("+1 (663) 555-6869 4316522678525456", "phone:0:17,card:18:34"),
        6: ('a token = "24be64439e3e49cf46b2d7c90f" b', "secret:2:37"),
        7: ("nothing 2024-01-02 here", ""),
        8: ("mail a@b.co, ip 1.2.3.4", "email:5:11,ip:16:23"),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()] + [(9, None)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    want = {i: s for i, (_, s) in cases.items()} | {9: ""}
    for i in got:
        strip = lambda x: sorted(y for y in x.split(",") if y)
        assert strip(got[i]) == strip(want[i]), (i, got[i])
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[8] == "mail [EMAIL], ip [IP]" and clean[5] == "[PHONE] [CARD]" and clean[9] is None and clean[7] == cases[7][0]


def test_many_matches_in_one_text(spark):
    """The time grows with the matches: thirty thousand addresses, and spans of all kinds around them."""
    mails = " ".join(f"u{i}@example.org" for i in range(30_000))
    mixed = " ".join(f"1.2.3.{i % 256} tel 555-123-{i % 9000 + 1000} a{i}@b.co, DE89 3704 0044 0532 0130 00" for i in range(500))
    df = spark.createDataFrame([(1, mails), (2, mixed), (None, "a@b.c"), (None, "a@b.c")], "doc_id long, text string")
    begun = time.time()
    got = {r.doc_id: r for r in pii.report(df).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert time.time() - begun < 90
    assert got[1].n_email == 30_000 and tuple(got[2])[1:6] == expected(mixed)[0]
    assert clean[1] == " ".join(["[EMAIL]"] * 30_000) and clean[None] == "[EMAIL]"
    assert clean[2] == " ".join(["[IP] tel [PHONE] [EMAIL], [IBAN]"] * 500)


def overlapping(a, b):
    return a[0] < b[2] and b[0] < a[2]


def test_added_spans_against_brute_force(spark):
    """Spans drawn at random: those kept are the ones that overlap no base span; merged ones cover the same places."""
    rng = random.Random(6)
    span = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
    rows = []
    for i in range(60):
        draw = lambda n: sorted((a, 0, a + rng.randint(1, 9), "k", 1.0) for a in (rng.randrange(900) for _ in range(n)))
        rows.append((i, draw(rng.choice([1, 5, 700])), draw(rng.choice([1, 5, 700]))))
    df = spark.createDataFrame(rows, f"id int, base {span}, extra {span}")
    got = {r.id: sorted(map(tuple, r.free)) for r in df.select("id", pii._apart(df["extra"], df["base"]).alias("free")).collect()}
    for i, base, extra in rows:
        assert got[i] == sorted(e for e in extra if not any(overlapping(e, b) for b in base))


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(none).collect() == []
    df = spark.createDataFrame([(1, "a@b.c", 5)], "doc_id long, text string, base_spans int")
    assert pii.redact(df).collect()[0] == (1, "[EMAIL]", 5)
