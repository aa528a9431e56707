"""Scalar functions on notation: pitch, duration and text. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Note durations in beats.
STANDARD_DURATIONS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
# Fixed values: (duration, tolerance, suffix), first match wins.
NOTE_SUFFIXES = [
    (1.0 / 12.0, 0.01, "/12"), (1.0 / 6.0, 0.02, "/6"), (1.0 / 3.0, 0.03, "/3"), (2.0 / 3.0, 0.05, "/3*2"),
    (0.25, 0.01, "/4"), (0.5, 0.01, "/2"), (0.75, 0.05, "/2."), (1.5, 0.1, "."),
    (2.0, 0.1, "-"), (3.0, 0.1, "--"), (4.0, 0.1, "---"),
]
# Rest texts, tolerance 0.05.
REST_TEXTS = [(4.0, "0---"), (3.0, "0--"), (2.0, "0-"), (1.5, "0."), (0.75, "0/2."), (0.5, "0/2"), (0.25, "0/4")]
# Fixed values: (durations, underlines, dotted, dashes), tolerance 0.05, first match wins.
RHYTHM_MARKS = [
    ((1.0 / 6.0, 1.0 / 12.0), 2, False, 0), ((1.0 / 3.0,), 1, False, 0), ((2.0 / 3.0,), 0, False, 0),
    ((0.25,), 2, False, 0), ((0.5,), 1, False, 0), ((0.75,), 1, True, 0), ((1.0,), 0, False, 0),
    ((1.5,), 0, True, 0), ((2.0,), 0, False, 1), ((3.0,), 0, False, 2), ((4.0,), 0, False, 3),
]
# The orders in which sharps and flats enter a key signature, as degrees.
SHARP_DEGREES = [4, 1, 5, 2, 6, 3, 7]
FLAT_DEGREES = [7, 3, 6, 2, 5, 1, 4]
# Counted-blank numerals.
BLANK_COUNTS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4}
# the step (octave * 7 + degree - 1) of grid position 0
TREBLE_BASE_STEP = 15
BASS_BASE_STEP = 3


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_within(value, table: list[tuple], default) -> Column:
    """First row of ``(centre, tolerance, label)`` with ``|value - centre| < tolerance``."""
    out = None
    for centre, tol, label in table:
        near = F.abs(_c(value) - F.lit(centre)) < tol
        out = F.when(near, F.lit(label)) if out is None else out.when(near, F.lit(label))
    return out.otherwise(F.lit(default))


def duration_suffix(d) -> Column:
    return first_within(d, NOTE_SUFFIXES, "")


def rest_text(d) -> Column:
    return first_within(F.coalesce(_c(d), F.lit(1.0)), [(v, 0.05, t) for v, t in REST_TEXTS], "0")


def rhythm_marks(d) -> Column:
    """struct(underlines, dotted, dashes)."""

    def mark(u, dot, dash):
        return F.struct(F.lit(u).alias("underlines"), F.lit(dot).alias("dotted"), F.lit(dash).alias("dashes"))

    out = None
    for centres, u, dot, dash in RHYTHM_MARKS:
        near = F.lit(False)
        for c in centres:
            near |= F.abs(_c(d) - F.lit(c)) < 0.05
        out = F.when(near, mark(u, dot, dash)) if out is None else out.when(near, mark(u, dot, dash))
    return out.otherwise(mark(0, False, 0))


def snap(value, steps: list[float] = STANDARD_DURATIONS) -> Column:
    """Nearest of ``steps``; a tie goes to the smaller one.

    A chain of comparisons rather than an array search, so it stays in generated code.
    """
    steps = sorted(steps)
    out = F.lit(steps[-1])
    for lo, hi in reversed(list(zip(steps, steps[1:]))):
        out = F.when(F.abs(_c(value) - lo) <= F.abs(_c(value) - hi), lo).otherwise(out)
    return F.when(_c(value).isNotNull(), out)


def decode_duration(hollow, beams, flag, has_stem, dot) -> Column:
    """Duration from evidence. A dot counts only on a stemmed note."""
    plain = (
        F.when(_c(hollow), 2.0).when(_c(beams) >= 2, 0.25).when((_c(beams) == 1) | _c(flag), 0.5).otherwise(1.0)
    )
    dotted = F.when(F.coalesce(_c(dot), F.lit(False)), plain * 1.5).otherwise(plain)
    return F.when(~_c(has_stem), F.when(_c(hollow), 4.0).otherwise(1.0)).otherwise(dotted)


def grid(lines, extra: int = 0) -> Column:
    """Centres of the 19 half-step positions of a 5-line staff, plus ``extra`` on each side."""
    ys = [F.element_at(_c(lines), i).cast("double") for i in range(1, 6)]
    dy = (ys[4] - ys[0]) / 4.0
    line = [ys[0] - dy * k for k in (3, 2, 1)] + ys + [ys[4] + dy * k for k in (1, 2, 3)]
    half = []
    for a, b in zip(line, line[1:]):
        half += [a, (a + b) / 2.0]
    mid = half[1:20]
    above = [mid[0] - dy / 2.0 * i for i in range(extra, 0, -1)]
    below = [mid[18] + dy / 2.0 * i for i in range(1, extra + 1)]
    return F.array(*above, *mid, *below)


def nearest_index(y, centres: Column, offset: int = 0) -> Column:
    """Index of the nearest centre, the first on ties, minus ``offset``."""
    best = F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(_c(y) - c).alias("d"), i.alias("i"))))
    return best["i"] - offset


def pitch_parts(idx, clef, standard_bass: bool = False) -> Column:
    """struct(degree, octave) of a grid position, on and beyond the 19 positions.

    By default bass staves are read like treble ones.
    """
    base = F.lit(TREBLE_BASE_STEP)
    if standard_bass:
        base = F.when(_c(clef) == "bass", BASS_BASE_STEP).otherwise(base)
    step = base - _c(idx)
    return F.struct((F.pmod(step, F.lit(7)) + 1).alias("degree"), F.floor(step / 7).alias("octave"))


def pitch_text(degree, octave) -> Column:
    o = _c(octave).cast("int")
    marks = F.when(o > 0, F.repeat(F.lit("'"), o)).when(o < 0, F.repeat(F.lit(","), -o)).otherwise("")
    return F.concat(_c(degree).cast("string"), marks)


def split_pitch(pitch) -> Column:
    """struct(digit, octave): octave marks counted up and down."""
    rest = F.substring(_c(pitch), 2, 1_000_000)
    count = lambda ch: F.length(rest) - F.length(F.replace(rest, F.lit(ch), F.lit("")))
    return F.struct(F.substring(_c(pitch), 1, 1).alias("digit"), (count("'") - count(",")).alias("octave"))


def rescale(score) -> Column:
    """Template score to confidence: 0.60 up to 0.55, 1.00 from 0.90, linear between."""
    s = _c(score)
    return F.when(s <= 0.55, 0.60).when(s >= 0.90, 1.00).otherwise(0.60 + (s - 0.55) * (0.40 / 0.35))


def meter_beats(num, den) -> Column:
    return _c(num) * (F.lit(4.0) / _c(den))


# All characters of white space, the wide blank of Chinese text included
WHITE = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACES = "[" + WHITE + "]+"
# digits other than ASCII that headings are written with
WIDE_DIGITS = "".join(map(chr, range(0xFF10, 0xFF1A)))


def strip(text) -> Column:
    """Without white space (of any kind) at either end."""
    return F.btrim(_c(text), F.lit(WHITE))


def whole_number(digits) -> Column:
    """The number a string of ASCII or full-width digits spells, null if it spells none."""
    return F.translate(_c(digits), WIDE_DIGITS, "0123456789").try_cast("int")


def split_measures(text) -> Column:
    """Non-blank parts between bars, trimmed."""
    return F.filter(F.transform(F.split(_c(text), r"\|"), strip), lambda p: p != "")


def tokenize_events(measure) -> Column:
    """Events of a measure: a bracket group with an optional ``/…`` suffix, or a run up to a space or ``[``."""
    return F.regexp_extract_all(_c(measure), F.lit(r"(\[[^\]]*\](?:/[^ \[]*)?|[^ \[]+)"), F.lit(1))


# only digits behind a stroke at the end of an event are a duration
DURATION_AT_END = r"(?U)/\d+$"


def split_event(event) -> Column:
    """struct(notes, duration). Only ``/digits`` at the end counts as a duration."""
    e = _c(event)
    close = F.instr(e, "]")
    after = F.substring(e, close + 1, F.length(e))
    plain = F.when(F.contains(e, F.lit("/")), F.regexp_extract(e, DURATION_AT_END, 0)).otherwise("")
    dur = F.when(close > 0, F.when(F.startswith(after, F.lit("/")), after).otherwise("")).otherwise(plain)
    body = F.when(close > 0, F.substring(e, F.lit(1), close)).otherwise(F.substring(e, F.lit(1), F.length(e) - F.length(plain)))
    body = strip(F.btrim(body, F.lit("[]")))
    notes = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACES))
    return F.struct(notes.alias("notes"), dur.alias("duration"))


def normalize_measure(text) -> Column:
    """Label clean-up: a one-and-a-half-beat remark becomes a dot, other remarks go."""
    s = F.replace(_c(text), F.lit("(1.5拍)"), F.lit("."))
    # other remarks in beats are remarks like any other; most text has none
    return strip(F.when(F.contains(s, F.lit("(")), F.regexp_replace(s, r"\([^)]*\)", "")).otherwise(s))


def blank_measures(n) -> Column:
    """Array of rest measures for a counted blank of ``n`` measures."""
    return F.when(_c(n) == 1, F.array(F.lit("0---"))).otherwise(F.array_repeat(F.lit("0 0 0 0"), _c(n)))


def digits_to_int(digits) -> Column:
    """Number spelled by an array of digits, null below 2."""
    v = F.aggregate(_c(digits), F.lit(0).cast("long"), lambda a, d: a * 10 + d)
    return F.when(v >= 2, v)


def key_degrees(sign, count) -> Column:
    sharps = F.array(*[F.lit(v) for v in SHARP_DEGREES])
    flats = F.array(*[F.lit(v) for v in FLAT_DEGREES])
    return F.slice(F.when(_c(sign) == "#", sharps).otherwise(flats), 1, F.least(_c(count), F.lit(7)))


def slot_x(left, width, margin, i, n) -> Column:
    """Left edge of slot ``i`` of ``n`` equal slots inside a segment."""
    avail = F.greatest(F.lit(1), _c(width) - _c(margin) * 2)
    return _c(left) + _c(margin) + F.floor(_c(i) * (avail / _c(n)))
