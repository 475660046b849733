"""Language identification by interpolated Kneser-Ney character models.

One model per language over lower-cased letters, everything else being one
space.  The top order counts n-grams, lower orders count distinct
continuations, each order is discounted and interpolated with the next lower
one, down to a uniform distribution.  All models share one sorted array of
n-gram hashes per order, with a row of interpolated log probabilities (a column
per language) beside it, and one sorted array of context hashes per order with
the log weights that lead to the lower order.  A text goes to the language with
the lowest cross-entropy per symbol, and is rejected if that lies further above
what the language's own texts of that length show than a calibrated bound.

The models are fitted on a bounded sample: of each language the same number of
documents with a letter, at most ``PER_LANGUAGE`` and at least one, about
``IN_ALL`` in all, the least by a hash of id and text; of a longer text ``LONGEST``
characters are learned, from its first letter on.  Every document is scored, whole.

Defined cases: null text and text without a letter give ``und``, score 0,
rejected; without any document to learn from, as in an empty table, every text
gives ``und``; languages tie to the first by code point; rows of one id are
scored each by its own text, and learned from once if the text is the same;
very long texts are scored whole, in memory that grows with the text; extra
columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.llm.common import crc_mod, ensure_checkpoint_dir, slices

ORDER = 5
PER_LANGUAGE, IN_ALL, LONGEST = 400, 4000, 20_000
#: Bytes of text scored at once; scoring takes about 150 bytes of memory for each.
SLICE = 1 << 18
UNKNOWN = "und"
#: Standard deviations above a language's own cross-entropy at which a text is rejected.
BOUND = 8.0
_PAD, _SPACE = 0, 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    return _letters


@dataclass
class Symbols:
    """Texts as one array: ``ORDER - 1`` pads and a space before each, ``ends`` where each ends, ``real`` where symbols are scored."""

    codes: np.ndarray
    starts: np.ndarray
    has_letter: np.ndarray


def symbols(texts: list[str]) -> Symbols:
    pads = "\0" * (ORDER - 1)
    joined = "".join([f"{pads} {t.lower().replace('\0', ' ')} " for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    pad = codes == _PAD
    codes = np.where(letter | pad, codes, np.uint32(_SPACE))
    space = ~(letter | pad)
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space of a run
    at_start = np.zeros(len(codes), bool)
    at_start[1:] = pad[1:] & ~pad[:-1]
    if len(codes):
        at_start[0] = True
    kept = codes[keep]
    starts = (np.cumsum(keep) - 1)[at_start]
    counts = np.add.reduceat(letter[keep], starts) if len(texts) else np.zeros(0)
    return Symbols(kept, starts, counts > 0)


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """``out[k]``: hash of the k symbols that end at each position (shorter at the very start)."""
    out, level = [np.zeros(len(codes), np.uint64)], np.zeros(len(codes), np.uint64)
    codes = codes.astype(np.uint64) + np.uint64(1)
    for _ in range(ORDER):
        shifted = np.zeros_like(level)
        shifted[1:] = level[:-1]
        level = (shifted + codes) * _MULTIPLIER
        level ^= level >> np.uint64(29)
        out.append(level)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted key in the sorted keys, and whether it is there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


@dataclass
class LanguageModels:
    """What is broadcast: sorted hash arrays and the values beside them."""

    names: list[str] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)  # by order - 1
    logs: list[np.ndarray] = field(default_factory=list)  # (n-gram, language)
    contexts: list[np.ndarray] = field(default_factory=list)  # by order - 1; of length order - 1
    weights: list[np.ndarray] = field(default_factory=list)  # (context, language)
    floor: float = 0.0
    mean: np.ndarray | None = None  # of cross-entropy, by language
    spread: np.ndarray | None = None  # (language, 2): variance = a + b / length

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, language) nats per symbol, symbols scored, and whether there is a letter."""
        found = symbols(texts)
        hashed = hashes(found.codes)
        total = np.empty((len(found.codes), len(self.names)), np.float32)
        todo = np.flatnonzero(found.codes != _PAD)
        scored = np.zeros(len(found.codes), bool)
        scored[todo] = True
        scored[found.starts + ORDER - 1] = False  # the space in front
        todo = np.flatnonzero(scored)
        carried: np.ndarray | None = None
        total[~scored] = 0
        for k in range(ORDER, 0, -1):
            at, hit = _find(self.grams[k - 1], hashed[k][todo])
            got = self.logs[k - 1][at[hit]]
            total[todo[hit]] = got if carried is None else got + carried[hit]
            todo, carried = todo[~hit], None if carried is None else carried[~hit]
            if not len(todo):
                break
            at, hit = _find(self.contexts[k - 1], hashed[k - 1][todo - 1] if k > 1 else np.zeros(len(todo), np.uint64))
            if carried is None:
                carried = np.zeros((len(todo), len(self.names)), np.float32)
            carried[hit] += self.weights[k - 1][at[hit]]
        if len(todo):
            total[todo] = carried + np.float32(self.floor)
        length = np.add.reduceat(scored, found.starts).astype(np.int64)
        sums = np.add.reduceat(total, found.starts, axis=0, dtype=np.float64)
        return -sums / np.maximum(length, 1)[:, None], length, found.has_letter

    def predict(self, texts: list[str]) -> list[tuple[str, float, float, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.names or not texts:
            return [(UNKNOWN, 0.0, 0.0, True)] * len(texts)
        entropies, length, known = self.cross_entropies(texts)
        best = entropies.argmin(1)
        least = entropies[np.arange(len(texts)), best]
        exponents = (least[:, None] - entropies) * np.minimum(length, 40)[:, None]
        score = 1 / np.exp(exponents).sum(1)
        bound = self.mean[best] + BOUND * np.sqrt(self.spread[best, 0] + self.spread[best, 1] / np.maximum(length, 1))
        return [(self.names[b], float(s), float(e), bool(e > m)) if k else (UNKNOWN, 0.0, 0.0, True) for b, s, e, m, k in zip(best.tolist(), score.tolist(), least.tolist(), bound.tolist(), known.tolist(), strict=True)]


def fit(samples: dict[str, list[str]]) -> LanguageModels:
    """Models of every language that has a letter in its samples; a fifth of each sample calibrates the rejection."""
    names = sorted(n for n, texts in samples.items() if any(any(c.isalpha() for c in t) for t in texts))
    models = LanguageModels(names)
    if not names:
        return models
    learned = {n: [t for i, t in enumerate(samples[n]) if i % 5 or len(samples[n]) < 10] for n in names}
    held = {n: [t for i, t in enumerate(samples[n]) if not i % 5 or len(samples[n]) < 10] for n in names}
    coded = [symbols(learned[n]) for n in names]
    alphabet = len(np.unique(np.concatenate([c.codes for c in coded]))) + 1
    models.floor = float(-np.log(alphabet))
    # per language: for each order the distinct n-grams with a count (of continuations below the top), and their suffixes and contexts
    counted: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
    for c in coded:
        hashed = hashes(c.codes)
        scored = c.codes != _PAD
        scored[c.starts + ORDER - 1] = False
        spots = np.flatnonzero(scored)
        keys, first, counts = np.unique(hashed[ORDER][spots], return_index=True, return_counts=True)
        at, levels = spots[first], []
        levels.append((keys, counts, hashed[ORDER - 1][at], hashed[ORDER - 1][at - 1]))
        for k in range(ORDER - 1, 0, -1):
            suffixes = hashed[k][at]
            keys, first, counts = np.unique(suffixes, return_index=True, return_counts=True)
            at = at[first]
            levels.append((keys, counts, hashed[k - 1][at] if k > 1 else np.zeros(len(at), np.uint64), hashed[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.uint64)))
        counted.append(levels[::-1])
    for k in range(1, ORDER + 1):
        every = [levels[k - 1] for levels in counted]
        grams, first = np.unique(np.concatenate([e[0] for e in every]), return_index=True)
        suffix, context = (np.concatenate([e[i] for e in every])[first] for i in (2, 3))
        contexts = np.unique(context)
        where = np.searchsorted(contexts, context)
        logs = np.empty((len(grams), len(names)), np.float32)
        weights = np.zeros((len(contexts), len(names)), np.float32)
        if k > 1:
            lower, _ = _find(models.grams[k - 2], suffix)
        for i, (keys, counts, _, own) in enumerate(every):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            spot = np.searchsorted(contexts, own)
            mass = np.bincount(spot, counts, len(contexts))
            kinds = np.bincount(spot, minlength=len(contexts))
            weight = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0)
            count = np.zeros(len(grams))
            count[np.searchsorted(grams, keys)] = counts
            below = np.exp(models.logs[k - 2][lower, i].astype(np.float64)) if k > 1 else 1 / alphabet
            seen = mass[where]
            direct = np.where(seen > 0, np.maximum(count - discount, 0) / np.maximum(seen, 1), 0.0)
            logs[:, i] = np.log(direct + weight[where] * below)
            weights[:, i] = np.log(weight)
        models.grams.append(grams)
        models.logs.append(logs)
        models.contexts.append(contexts)
        models.weights.append(weights)
    models.mean, models.spread = np.zeros(len(names)), np.zeros((len(names), 2))
    for i, n in enumerate(names):
        points = []
        for size in (25, 100, 400, 1600):
            parts = [p for t in held[n] for p in ((t[j : j + size] for j in range(0, min(len(t), 8 * size) - size + 1, size)) if len(t) >= size else [t]) if any(c.isalpha() for c in p)][:400]
            if len(parts) >= 5:
                entropies, length, _ = models.cross_entropies(parts)
                points.append((entropies[:, i].mean(), entropies[:, i].var(), 1 / length.mean()))
        if not points:
            models.mean[i], models.spread[i] = -models.floor, (0.25, 4.0)
            continue
        mean, variance, inverse = map(np.array, zip(*points, strict=True))
        models.mean[i] = mean.max()
        models.spread[i] = max(variance.min(), 0.01), max(((variance - variance.min()) / inverse).max(), 1.0)
    return models


def learn(docs: DataFrame, eligible: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> LanguageModels:
    """Models fitted on the bounded sample of the ``eligible`` rows."""
    ensure_checkpoint_dir(docs.sparkSession)
    row = F.xxhash64(F.coalesce(docs[id_column].cast("string"), F.lit("")), docs[text_column], F.lit(7))
    rows = docs.select(docs[lang_column].alias("lang"), docs[text_column].alias("text"), row.alias("h"), eligible.alias("ok")).where("ok and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    marked = rows.select("lang", "h").checkpoint()
    counts = marked.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row per language
    each = max(1, min(PER_LANGUAGE, IN_ALL // max(1, len(counts))))
    # a share of each language's hashes that holds the `each` least of them many times over, so that no language is sorted whole
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (3.0 * each + 60) / max(1, r["n"]))) for r in counts], "lang string, share double")
    low = marked.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned("h", 11) * (2.0**-53) < F.col("share")).select("lang", "h").distinct()  # a row per language is broadcast
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h"))
    chosen = low.withColumn("place", place).where(F.col("place") <= each).select(F.col("lang").alias("own"), F.col("h").alias("chosen"))
    picked = rows.join(F.broadcast(chosen), (F.col("lang") == F.col("own")) & (F.col("h") == F.col("chosen")), "left_semi")  # at most `each` a language
    picked = picked.select("lang", "h", F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, LONGEST).alias("text")).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        samples: dict[str, list[str]] = {}
        for lang, _, text in found:
            samples.setdefault(lang, []).append(text)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(samples))], pa.binary())], names=["models"])

    # the bounded sample is fitted in one task, so that the driver holds only the models
    fitted = picked.repartition(1).mapInArrow(run, "models binary").collect()
    return pickle.loads(fitted[0]["models"]) if fitted else LanguageModels()


def identify(docs: DataFrame, models: LanguageModels, id_column: str = "doc_id", text_column: str = "text", fold: int | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) of every document; held_out as crc32(id) mod 3 is ``fold``."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text", SLICE):
            ids = batch.column(0).to_pylist()
            lang, score, entropy, rejected = zip(*own.predict([t or "" for t in batch.column(1).to_pylist()]), strict=True)
            held = [None if fold is None else crc_mod(i, 3) == fold for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, models: LanguageModels, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices([whole], whole.schema.names[at], SLICE):
                keep = [not p[3] for p in own.predict([t or "" for t in batch.column(at).to_pylist()])]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
