"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import ship_package
from .common import chunks, hashed_words, text_of, utf8

HIDDEN = 12
STEPS = 900
BATCH = 256
# bound of the training sample: languages, documents of each, words of a document
LANGUAGES, DOCUMENTS, WORDS = 200, 500, 60
# a network reads one word; longer words are read in pieces
LONGEST = 24
CACHED_WORDS = 400_000
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _cell(x: np.ndarray, h: np.ndarray, u: np.ndarray):
    """One step of a gated unit: (state, update gate, reset gate, candidate, recurrent part of the candidate)."""
    k = h.shape[1]
    back = h @ u
    gates = _sigmoid(x[:, : 2 * k] + back[:, : 2 * k])
    z, r = gates[:, :k], gates[:, k:]
    own = back[:, 2 * k :]
    c = 2 * _sigmoid(2 * (x[:, 2 * k :] + r * own)) - 1
    return c + z * (h - c), z, r, c, own


@dataclass
class Network:
    """Per direction a table of inputs by byte and a recurrent matrix; one output layer for both."""

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    outputs: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        n = len(languages)
        return cls(
            languages,
            [draw(256, 3 * hidden, scale=0.3) for _ in range(2)],
            [draw(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)],
            [draw(hidden, n, scale=hidden**-0.5) for _ in range(2)],
            np.zeros(n, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.outputs, self.bias]

    def _states(self, seq: np.ndarray, way: int):
        """Steps of one direction over words of equal length, in reading order of that direction."""
        h = np.zeros((len(seq), self.recurrent[way].shape[0]), np.float32)
        steps = []
        order = range(seq.shape[1]) if way == 0 else range(seq.shape[1] - 1, -1, -1)
        for t in order:
            before = h
            h, z, r, c, own = _cell(self.inputs[way][seq[:, t]], h, self.recurrent[way])
            steps.append((t, before, h, z, r, c, own))
        return steps

    def label(self, seq: np.ndarray) -> np.ndarray:
        """Log probabilities (word, position, language) of words of equal length."""
        logits = np.zeros((*seq.shape, len(self.languages)), np.float32) + self.bias
        for way in range(2):
            for t, _, h, *_ in self._states(seq, way):
                logits[:, t] += h @ self.outputs[way]
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))

    def gradients(self, seq: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """(loss, gradients in the order of ``parameters``) by backpropagation through time.

        The loss is the mean cross entropy of every position's label with its word's language.
        """
        n, length = seq.shape
        states = [self._states(seq, way) for way in range(2)]
        logits = np.zeros((n, length, len(self.languages)), np.float32) + self.bias
        for way in range(2):
            for t, _, h, *_ in states[way]:
                logits[:, t] += h @ self.outputs[way]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        hit = np.arange(n)[:, None], np.arange(length)[None, :], target[:, None]
        loss = float(-np.log(p[hit] + 1e-9).mean())
        d = p
        d[hit] -= 1
        d /= n * length
        gi, gr, go = ([np.zeros_like(x) for x in xs] for xs in (self.inputs, self.recurrent, self.outputs))
        for way in range(2):
            u = self.recurrent[way]
            k = u.shape[0]
            dh = np.zeros((n, k), np.float32)
            for t, before, h, z, r, c, own in reversed(states[way]):
                go[way] += h.T @ d[:, t]
                dh = dh + d[:, t] @ self.outputs[way].T
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (before - c) * z * (1 - z)
                dr = dc * own * r * (1 - r)
                np.add.at(gi[way], seq[:, t], np.concatenate([dz, dr, dc], axis=1))
                into = np.concatenate([dz, dr, dc * r], axis=1)
                gr[way] += before.T @ into
                dh = dh * z + into @ u.T
        return loss, [*gi, *gr, *go, d.sum(axis=(0, 1))]


def by_length(words: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length → (which word, bytes): words of up to LONGEST bytes; longer ones in pieces."""
    pieces = [(i, w[a : a + LONGEST]) for i, w in enumerate(words) for a in range(0, len(w), LONGEST)]
    out: dict[int, tuple[list, list]] = {}
    for i, w in pieces:
        own = out.setdefault(len(w), ([], []))
        own[0].append(i)
        own[1].append(w)
    return {n: (np.array(i), np.frombuffer(b"".join(w), np.uint8).reshape(-1, n)) for n, (i, w) in sorted(out.items())}


def train(samples: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 0) -> Network | None:
    """A network fitted to (language, word) samples with Adam; None without samples.

    Languages weigh the same however many samples they have. The same samples give the same network.
    """
    samples = sorted(s for s in samples if s[1])
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({s[0] for s in samples})
    number = {x: i for i, x in enumerate(languages)}
    target = np.array([number[s[0]] for s in samples])
    groups = []
    for i, seq in by_length([s[1] for s in samples]).values():
        weight = 1 / np.bincount(target, minlength=len(languages))[target[i]]
        groups.append((seq, target[i], weight / weight.sum(), weight.sum() * seq.shape[1] ** 0.5))
    odds = np.array([g[3] for g in groups]) / sum(g[3] for g in groups)
    net = Network.fresh(languages, hidden, rng)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        seq, goal, weight, _ = groups[rng.choice(len(groups), p=odds)]
        pick = rng.choice(len(seq), BATCH, p=weight)
        _, grads = net.gradients(seq[pick], goal[pick])
        rate = 0.02 * (1 - step / (steps + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


class _Labeller:
    """Summed log probabilities of words' positions; the same word is read once while it is kept."""

    def __init__(self, net: Network):
        self.net = net
        self.keys = np.zeros(0, np.uint64)
        self.sums = np.zeros((0, len(net.languages)), np.float32)

    def _read(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.net.languages)), np.float32)
        for which, seq in by_length(words).values():
            for a in range(0, len(seq), 4096):
                np.add.at(out, which[a : a + 4096], self.net.label(seq[a : a + 4096]).sum(axis=1))
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, positions) per row: log probabilities over all positions of its words, and how many there are."""
        start, end, first, hashes = hashed_words(data, offsets)
        own = data[offsets[0] : offsets[-1]]
        keys, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        sums = np.zeros((len(keys), self.sums.shape[1]), np.float32)
        sums[known] = self.sums[place[known]]
        new = np.flatnonzero(~known)
        sums[new] = self._read([own[start[i] : end[i]].tobytes() for i in at[new]])
        if len(self.keys) + len(new) > CACHED_WORDS:
            self.keys, self.sums = keys[:CACHED_WORDS], sums[:CACHED_WORDS]
        else:
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys, kind="stable")
            self.keys, self.sums = all_keys[order], np.concatenate([self.sums, sums[new]])[order]
        total = np.zeros((len(hashes) + 1, sums.shape[1]))
        np.cumsum(sums[back], axis=0, out=total[1:])
        length = np.concatenate([[0], np.cumsum(end - start)])
        return total[first[1:]] - total[first[:-1]], length[first[1:]] - length[first[:-1]]


def held_out(id: str | Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text leaves 2 modulo 4. A null id counts as empty text."""
    col = F.col(id) if isinstance(id, str) else id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", languages: int = LANGUAGES, documents: int = DOCUMENTS, words: int = WORDS):
    """(language, word) samples for training, bounded by the three parameters.

    From labelled documents with letters that are not held out: of each of the most frequent languages
    about ``documents`` by a hash of id and text, and of each of those ``words`` words spread over the whole
    text. One pass counts languages, one draws.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"), F.xxhash64(F.col(id), F.col(text)).alias("h"), held_out(id).alias("out"))
    rows = rows.filter(~F.col("out") & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return []
    span = 1 << 40
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, documents / r["count"]) * span)))])
    few = rows.filter(F.pmod(F.col("h"), F.lit(span)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0))).filter(has_letter(F.col("text")))

    def draw(batches):
        for b in batches:
            out = []
            for t in b.column(1):
                ws = t.as_buffer().to_pybytes().split()
                out.append(sorted({ws[i * len(ws) // words] for i in range(words)}) if len(ws) > words else sorted(set(ws)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.list_(pa.binary()))], ["lang", "h", "words"])

    drawn = few.select("lang", "text", "h").mapInArrow(draw, "lang string, h bigint, words array<binary>")
    taken = drawn.orderBy("h", "lang").limit(2 * documents * len(counts)).collect()
    return [(r["lang"], bytes(w)) for r in taken for w in r["words"]]


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced. No shuffle.

    Every byte of every word is labelled; a document's probability of a language is the geometric mean over all its
    positions, scaled to sum 1, and score is the largest. A text that is null or has no letter, or a
    network that is None, gives ``und`` and score 0. Of equally likely languages the first in the network's order wins. Texts of
    any length are read whole. Sums are of 32-bit numbers whose order follows the partitioning, so the last digits of a
    score may differ from run to run.
    """
    spark = docs.sparkSession
    ship_package(spark)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], has_letter(F.col(text)).alias("letter"))
    at = keep.index(text)
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        label = _Labeller(net) if net is not None else None
        for b in batches:
            raw, offsets = utf8(b.column(at))
            pred, score = [], []
            for x, y in chunks(offsets):
                if label is None:
                    pred += [UNKNOWN] * (y - x)
                    score += [0.0] * (y - x)
                    continue
                sums, n = label(raw, offsets[x : y + 1])
                mean = sums / np.maximum(n, 1)[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                pred += [net.languages[i] for i in p.argmax(axis=1)]
                score += p.max(axis=1).tolist()
            letter = b.column(b.num_columns - 1).to_pylist()
            pred = [v if k else UNKNOWN for v, k in zip(pred, letter)]
            score = [min(v, 1.0) if k else 0.0 for v, k in zip(score, letter)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    schema = T.StructType([*held.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = held.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", **bounds) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row: trains on the labelled rows that are not held out, predicts all.

    Null languages are not learned from; null or repeated ids are rows of their own; rows with an equal hash of id
    and text are drawn together. An empty table gives an empty result. Further columns are ignored.
    """
    net = train(sample(docs, id, text, lang, **bounds))
    return predict(docs.select(id, text), net, text).select(id, held_out(id).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.3, **bounds) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und`` and a score of ``least`` or more. Columns stay as they are."""
    net = train(sample(docs, id, text, lang, **bounds))
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    found = predict(held, net, f"c{docs.columns.index(text)}")
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
