"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import hex_sha256, let, text_of

# The base patterns. Quantifiers are possessive and an e-mail or address starts only where its
# first run of characters starts (or a match ended), which finds the same matches without going back over long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# the method's own patterns
CARD_RUN = r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"
PHONE_SHAPE = r"\+[0-9]{1,3}[\x20-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20-]?[0-9]{3}[\x20-][0-9]{4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
SECRET = r"(?i)(?:token|secret|password|passwd|api[_-]?key)\x20?[=:]\x20?\"?[A-Za-z0-9_/+-]{16,}+"

BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
# code points looked at on either side of a match
NEAR = 40
STEPS = 256  # items walked before their results are put away


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a text without this has no match; much cheaper to look for
    prior: float
    context: str  # words nearby that add to the score
    against: str = ""  # words nearby that take from it


EXTRA = (
    Kind("card", CARD_RUN, r"[0-9]{4}[\x20-]?[0-9]{4}", 0.6, r"card|visa|master|credit|karte|carte|tarjeta", r"order|isbn|serial"),
    Kind("phone", PHONE_SHAPE, r"\+[0-9]", 0.6, r"tel|phone|call|fax|mobil"),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}", 0.6, r"iban|account|konto|compte|cuenta|bank"),
    Kind("phone", NATIONAL, r"[0-9]{3}\)?[\x20.-][0-9]{3}", 0.3, r"tel|phone|call|fax|mobil", r"isbn|order|version"),
    Kind("secret", SECRET, r"(?i)token|secret|passw|api.?key", 0.6, r"=|:", r"example|placeholder"),
)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right every second digit is doubled, nines cast out."""

    def term(c: Column, i: Column) -> Column:
        v = c.cast("int")
        return F.when(i % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    marks = F.split(F.reverse(digits), "(?<=.)(?=.)")
    return F.aggregate(F.transform(marks, term), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code passes the mod-97 check: first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    marks = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "(?<=.)(?=.)")

    def step(rest: Column, c: Column) -> Column:
        return F.when(c < "A", rest * 10 + c.cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(marks, F.lit(0), step) == 1


def _valid_ip(m: Column) -> Column:
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _valid_card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))


def _valid_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


_CHECK = {"email": lambda m: F.lit(True), "ip": _valid_ip, "card": _valid_card, "phone": _valid_phone, "iban": mod97, "secret": lambda m: F.lit(True)}
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def walk(items: Column, seed: Column, state: str, step, out: str) -> Column:
    """What ``step(state, item) -> (state, struct)`` gives for each item of an array in order.

    An array that grows by one is copied by each step, so items are walked in blocks whose results are then joined:
    the work grows with the items, not with their square. ``state`` and ``out`` are the types of the state and of
    the fields of a result.
    """

    def pieces(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(STEPS)), lambda i: F.slice(all_, i + 1, STEPS))

    def one(acc: Column, item: Column) -> Column:
        now, found = step(acc["s"], item)
        return F.struct(now.alias("s"), F.concat(acc["out"], F.array(found)).alias("out"))

    def block(acc: Column, piece: Column) -> Column:
        own = F.aggregate(piece, F.struct(acc["s"].alias("s"), F.array().cast(f"array<struct<{out}>>").alias("out")), one)
        return let(own, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(seed.cast(state).alias("s"), F.array().cast(f"array<array<struct<{out}>>>").alias("out"))
    return F.flatten(F.aggregate(let(items, pieces), start, block)["out"])


def _apart(extra: Column, base: Column) -> Column:
    """The spans of ``extra`` that overlap none of ``base``: two walks along both in order, one from either end."""
    fields = "start:int,rank:int,end:int,kind:string,score:double"
    item = f"start:int,more:int,end:int,own:struct<{fields}>"
    tag = lambda more: lambda s: F.struct(s["start"].alias("start"), F.lit(more).alias("more"), s["end"].alias("end"), s.alias("own"))
    both = F.array_sort(F.concat(F.transform(base, tag(0)), F.transform(extra, tag(1))).cast(f"array<struct<{item}>>"))

    def onward(reach: Column, s: Column) -> tuple[Column, Column]:
        hit = (s["more"] == 1) & (reach > s["start"])
        now = F.when(s["more"] == 0, F.greatest(reach, s["end"])).otherwise(reach)
        return now, F.struct(s["start"].alias("start"), s["more"].alias("more"), s["end"].alias("end"), F.when(~hit, s["own"]).alias("own"))

    def back(begin: Column, s: Column) -> tuple[Column, Column]:
        hit = (s["more"] == 1) & (begin < s["end"])
        now = F.when(s["more"] == 0, s["start"]).otherwise(begin)
        return now, F.struct(s["start"].alias("start"), s["more"].alias("more"), s["end"].alias("end"), F.when(~hit, s["own"]).alias("own"))

    ahead = let(both, lambda b: walk(b, F.lit(-1), "int", onward, item))
    seen = let(ahead, lambda b: let(F.reverse(b), lambda r: walk(r, F.lit(2147483647), "int", back, item)))
    free = F.filter(seen, lambda s: (s["more"] == 1) & s["own"].isNotNull())
    return F.transform(free, lambda s: s["own"]).cast(_SPAN)


def _proposed(text: Column, kind: str, pattern: str, gate: Column, rank: int, keep) -> Column:
    """Spans of the matches of ``pattern`` for which ``keep(text, match, start)`` gives a score, in order.

    Matches and what stands between them have alternating lengths; their running sum gives the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(between: Column) -> Column:
        def body(matches: Column) -> Column:
            pairs = F.zip_with(between, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))

            def step(at: Column, z: Column) -> tuple[Column, Column]:
                start = at + F.length(z["p"])
                return start + F.coalesce(F.length(z["m"]), F.lit(0)), F.struct(start.alias("start"), z["m"].alias("m"))

            walked = F.filter(walk(pairs, F.lit(0), "int", step, "start:int,m:string"), lambda w: w["m"].isNotNull())
            scored = F.transform(
                walked,
                lambda w: F.struct(
                    w["start"].alias("start"),
                    F.lit(rank).alias("rank"),
                    (w["start"] + F.length(w["m"])).alias("end"),
                    F.lit(kind).alias("kind"),
                    keep(w["m"], w["start"]).alias("score"),
                ),
            )
            return F.filter(scored, lambda s: s["score"] >= THRESHOLD)

        return let(found, body)

    spans = let(F.split(text, pattern, -1), located)
    return F.when(gate, spans).otherwise(F.array().cast(_SPAN))


def _base(text: Column) -> Column:
    """The base spans of all four kinds, by start, then kind."""
    gates = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    kinds = []
    for rank, kind in enumerate(BASE):
        keep = lambda m, start, k=kind: F.when(_CHECK[k](m), F.lit(1.0)).otherwise(F.lit(0.0))
        kinds.append(_proposed(text, kind, patterns[kind], gates[kind], rank, keep))
    return F.array_sort(F.concat(*kinds))


def _extra(text: Column) -> Column:
    """Spans of the method's own patterns with their scores."""
    kinds = []
    for n, k in enumerate(EXTRA):

        def keep(m: Column, start: Column, k=k) -> Column:
            near = F.lower(F.concat(F.substring(text, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR))), F.lit(" "), F.substring(text, start + F.length(m) + 1, F.lit(NEAR))))
            score = F.lit(k.prior) + F.when(near.rlike(k.context), 0.3).otherwise(0.0)
            if k.against:
                score = score - F.when(near.rlike(k.against), 0.3).otherwise(0.0)
            return F.when(_CHECK[k.name](m), score).otherwise(F.lit(0.0))

        kinds.append(_proposed(text, k.name, k.pattern, text.rlike(k.gate), len(BASE) + n, keep))
    return F.concat(*kinds)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, rank, end, kind, score) in code points, end exclusive.

    Base: e-mail, address, card and phone patterns, leftmost and not overlapping within a kind; addresses need parts up
    to 255, cards 14 to 19 digits and the Luhn check, phones 10 to 15 digits; a match that fails is dropped.
    The method adds what its own patterns propose, if the checksum holds (Luhn, mod-97) and prior plus nearby words reach THRESHOLD:
    cards and phones standing in runs of digits that failed as a whole, account codes, national phone numbers,
    secrets. Added spans that overlap a base span are left out; base spans always stay. One pass, no shuffle.

    Null or empty text: no spans. Texts of any length are read whole, in time that grows with them and their matches. Columns
    named ``base_spans`` or ``spans`` are replaced.
    """
    base = docs.withColumn("base_spans", _base(text_of(text)))
    none = F.array().cast(_SPAN)
    found = F.col("base_spans")
    more = let(_extra(text_of(text)), lambda extra: F.when(F.size(extra) == 0, none).when(F.size(found) == 0, extra).otherwise(_apart(extra, found)))
    return base.withColumn("spans", F.array_sort(F.concat("base_spans", more)))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; see ``find_pii``. Null or repeated ids: rows of their own."""
    found = find_pii(docs.select(id, text), text)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return found.select(id, *counts, hex_sha256(_joined(F.col("base_spans"))).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; overlapping spans are replaced as one, named by the first.

    Null texts stay null; every row stays, repeated ones too. Other columns stay as they are.
    """
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = f"c{docs.columns.index(text)}"
    found = find_pii(held, at)
    span = "start:int,end:int,kind:string"
    part = lambda s, end: F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"))

    def widen(open_: Column, s: Column) -> tuple[Column, Column]:
        meets = open_["end"] > s["start"]
        now = F.when(meets, part(open_, F.greatest(open_["end"], s["end"]))).otherwise(part(s, s["end"])).cast(f"struct<{span}>")
        return now, F.when(~meets, open_).cast(f"struct<{span}>")

    # a span past the end closes the last one
    nothing = F.lit(None).cast("string")
    last = F.array(F.struct(F.lit(2147483647).alias("start"), F.lit(0).alias("rank"), F.lit(2147483647).alias("end"), nothing.alias("kind"), F.lit(0.0).alias("score")))
    before = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), nothing.alias("kind"))
    walked = let(F.concat("spans", last.cast(_SPAN)), lambda x: walk(x, before, f"struct<{span}>", widen, span))
    merged = F.filter(walked, lambda s: s.isNotNull() & (s["start"] >= 0))

    # places in a text of single bytes are found at once, in others by counting characters from its start
    single = F.octet_length(at) == F.length(at)

    def rebuilt(spans: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(at)))
        by_byte = lambda raw: F.zip_with(starts, ends, lambda a, b: F.substring(raw, a + 1, b - a).cast("string"))
        by_character = F.zip_with(starts, ends, lambda a, b: F.substring(F.col(at), a + 1, b - a))
        plain = F.when(single, let(F.col(at).cast("binary"), by_byte)).otherwise(by_character)
        marks = F.concat(F.transform(spans, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))), F.array(F.lit("")))
        return F.array_join(F.zip_with(plain, marks, lambda a, b: F.concat(a, b)), "")

    out = F.when(F.size("spans") > 0, let(merged, rebuilt)).otherwise(F.col(at))
    return found.withColumn(at, out).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
