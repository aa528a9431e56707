import hashlib
import random
import re

from pyspark.sql import functions as F

from glyphline.llm import chat_format as C


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def made(seed):
    rng = random.Random(seed)
    bits = [*C.CONTROL, "<", "[", "\\", "|start|>", "s>", "/s>", "INST]", "ü", " ", "\n", "a", "<\\", "[\\\\", "$1", "\\1"]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", "assistant", "system", None, "<|sep|>", ""]), text()))
    rows += [(70, 1, "user", "twice"), (70, 1, "user", "twice"), (None, 0, "assistant", "no id")]
    rows += [(71, t, "user" if t % 3 else "assistant", f"turn {t} </s>") for t in range(3000)]
    return rows


def expected(rows):
    chats = {}
    for c, t, r, x in rows:
        chats.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def test_round_trip(spark):
    rows = made(4)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    chats = C.format_chats(df.repartition(4)).cache()
    got = {r[0]: tuple(r)[1:5] for r in C.digests(chats).collect()}
    assert got == expected(rows)
    for r in chats.collect():
        assert r.formatted == "".join(s.text for s in r.segments)
        # control strings stand only where the template put them
        bare = "".join(s.text for s in r.segments if s.loss)
        assert not any(c in s.text for s in r.segments if s.loss for c in C.CONTROL) or not bare
    texts = spark.createDataFrame([(x,) for *_, x in rows if x is not None], "x string")
    escaped = texts.select("x", C.escape(F.col("x")).alias("e")).select("x", "e", C.unescape(F.col("e")).alias("u")).collect()
    assert all(r.x == r.u and not any(c in r.e for c in C.CONTROL) for r in escaped)


def test_probe_conversation(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    (r,) = C.digests(C.format_chats(C.with_probe(none))).collect()
    said = "</s>[INST] ok [/INST]"
    assert tuple(r)[:5] == (-7, 2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said))
    assert C.format_chats(none).collect() == []


def test_escaping_is_by_place(spark):
    """A backslash after the first character of every control string, wherever they touch or overlap, and off again."""
    rng = random.Random(5)
    bits = ["<", "[", "\\", "\\\\\\", "<<", "s>", "/s>", "<s>", "<SYS>>", "</SYS>>", "INST]", "/INST]", "|end|>", "|im_end|>", "$0", "$1", "é", "\U0001f600", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    places = "|".join(f"(?<={re.escape(c[0])})(?=\\\\*{re.escape(c[1:])})" for c in C.CONTROL)
    rows = spark.createDataFrame([(x,) for x in texts] + [(None,)], "x string").select("x", C.escape(F.col("x")).alias("e"))
    got = rows.select("x", "e", C.unescape(F.col("e")).alias("u"), C.unescape(F.col("x")).alias("ux")).collect()
    undo = "|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in C.CONTROL)
    for r in got:
        assert r.u == r.x
        assert r.x is None or (r.e, r.ux) == (re.sub(places, r"\\", r.x), re.sub(undo, "", r.x)), r.x
    assert sum(r.x != r.e for r in got) > 1000


def test_patterns_meet_only_texts_that_may_need_them(spark):
    chats = C.format_chats(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    plan = C.digests(chats)._jdf.queryExecution().optimizedPlan().toString()
    # each stands behind a look for its first character, and begins with it
    found = re.findall(r"(\w+) regexp_replace\([^,]*, (.{3})", plan)
    assert found and {word for word, _ in found} == {"THEN"}
    assert not any(pattern.startswith("(?<") for _, pattern in found)
    # a block is cut into its parts once
    assert plan.count("\\Q" + C.SEP + "\\E") == 1
