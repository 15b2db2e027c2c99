"""Language identification in two steps: family, then language.

Languages are put into families by how alike their mean features are.  One
linear support vector machine per family, against the rest, picks the family;
within it, one machine for each pair of languages votes.  Features are square
roots of the shares of hashed byte n-grams (2 to 4 bytes, so also parts of
longer characters) of the whole text.

The classifier is fitted on a bounded sample of labelled rows: about
``LangConfig.sample`` texts, shared evenly by the languages.

Defined results: ``und`` with score 0 for a null text or one without a letter;
if no row has a language to learn from, every text is ``und``; a single
learned language is given to every text with letters.  A row is judged alone,
so repeated rows agree.  Rows with a null doc_id count as training rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import chunks, text_buffer

UNKNOWN = "und"


@dataclass(frozen=True)
class LangConfig:
    sample: int = 2400
    buckets: int = 4096
    orders: tuple[int, ...] = (2, 3, 4)
    epochs: int = 30
    strength: float = 1e-4


@dataclass(frozen=True)
class LangModel:
    """families: tuples of languages; of_family: a row of weights each;
    of_pair: (language a, language b) -> weights, positive for a."""

    families: tuple[tuple[str, ...], ...]
    of_family: np.ndarray
    of_pair: dict[tuple[str, str], np.ndarray]
    config: LangConfig


def features(data: np.ndarray, offsets: np.ndarray, config: LangConfig) -> np.ndarray:
    """One row of unit length for each text."""
    docs, n = len(offsets) - 1, len(data)
    table = np.arange(256, dtype=np.uint32)
    table[65:91] += 32  # lower case
    table[[c for c in range(128) if not chr(c).isalpha()]] = 32  # whatever is not a letter parts words
    low = table[data]
    out = np.zeros((docs, config.buckets), np.float32)
    group = np.repeat(np.arange(docs, dtype=np.int64), np.diff(offsets))
    for order in config.orders:
        if n < order:
            continue
        value = low[: n - order + 1].copy()
        for j in range(1, order):
            value = value * np.uint32(0x01000193) ^ low[j : n - order + 1 + j]
        value = (value * np.uint32(0x9E3779B1)) >> np.uint32(16)
        inside = group[: n - order + 1] == group[order - 1 :]
        key = group[: n - order + 1][inside] * config.buckets + (value[inside] % np.uint32(config.buckets))
        out += np.bincount(key, minlength=docs * config.buckets).reshape(docs, config.buckets)
    out = np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))
    return out


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    count = np.concatenate([[0], np.cumsum(letter)])
    found = count[offsets[1:]] > count[offsets[:-1]]
    for d in np.flatnonzero(~found).tolist():
        text = data[offsets[d] : offsets[d + 1]].tobytes().decode(errors="replace")
        found[d] = any(c.isalpha() for c in text)
    return found


def linear_svm(x: np.ndarray, y: np.ndarray, config: LangConfig) -> np.ndarray:
    """Weights (and bias, last) of a hinge-loss machine by averaged subgradient steps.

    y is +1 or -1; both sides weigh the same, however many rows they have.
    """
    rng = np.random.default_rng(7)
    x = np.hstack([x, np.full((len(x), 1), 0.3, np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    w, total, steps, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 0
    for epoch in range(config.epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            t += 1
            rate = 1 / (config.strength * (t + 100))
            wrong = rows[y[rows] * (x[rows] @ w) < 1]
            w *= 1 - rate * config.strength
            if len(wrong):
                w += (rate / len(rows)) * ((share[wrong] * y[wrong]) @ x[wrong])
            norm = np.sqrt(config.strength) * np.linalg.norm(w)
            if norm > 1:
                w /= norm
            if epoch >= config.epochs // 2:
                total, steps = total + w, steps + 1
    out = total / max(steps, 1)
    return np.append(out[:-1], out[-1] * 0.3).astype(np.float32)


def group_families(means: dict[str, np.ndarray]) -> tuple[tuple[str, ...], ...]:
    """Average-link clusters of the languages' means, about sqrt(n) of them."""
    groups = [[name] for name in sorted(means)]
    unit = {name: v / max(np.linalg.norm(v), 1e-9) for name, v in means.items()}
    most = max(1, round(len(groups) ** 0.5))
    while len(groups) > most:
        alike = {(i, j): np.mean([unit[a] @ unit[b] for a in groups[i] for b in groups[j]]) for i, j in combinations(range(len(groups)), 2)}
        i, j = max(alike, key=lambda ij: (alike[ij], -ij[0], -ij[1]))
        groups[i] += groups.pop(j)
    return tuple(tuple(sorted(g)) for g in groups)


def fit(x: np.ndarray, names: list[str], config: LangConfig) -> LangModel:
    label = np.array(names)
    means = {name: x[label == name].mean(axis=0) for name in sorted(set(names))}
    families = group_families(means)
    family = np.array([next(i for i, f in enumerate(families) if n in f) for n in names]) if names else np.zeros(0, int)
    if len(families) > 1:
        of_family = np.stack([linear_svm(x, np.where(family == i, 1.0, -1.0), config) for i in range(len(families))])
    else:
        of_family = np.zeros((len(families), config.buckets + 1), np.float32)
    pairs = {}
    for group in families:
        for a, b in combinations(group, 2):
            rows = (label == a) | (label == b)
            pairs[a, b] = linear_svm(x[rows], np.where(label[rows] == a, 1.0, -1.0), config)
    return LangModel(families, of_family, pairs, config)


def predict(data: np.ndarray, offsets: np.ndarray, model: LangModel) -> tuple[list[str], np.ndarray]:
    docs = len(offsets) - 1
    names, score = np.full(docs, UNKNOWN, object), np.zeros(docs)
    known = np.flatnonzero(has_letters(data, offsets))
    if not model.families or not len(known):
        return names.tolist(), score
    x = features(data, offsets, model.config)[known]
    margin = x @ model.of_family[:, :-1].T + model.of_family[:, -1]
    pick = margin.argmax(axis=1)
    squash = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
    family_score = squash(margin.max(axis=1)) if len(model.families) > 1 else np.ones(len(known))
    for i, group in enumerate(model.families):
        rows = np.flatnonzero(pick == i)
        votes = np.zeros((len(rows), len(group)))
        sure = np.ones((len(rows), len(group)))
        for a, b in combinations(range(len(group)), 2):
            w = model.of_pair[group[a], group[b]]
            p = squash(x[rows] @ w[:-1] + w[-1])
            votes[:, a] += (p >= 0.5) + p / 1000  # near ties by margin
            votes[:, b] += (p < 0.5) + (1 - p) / 1000
            sure[:, a], sure[:, b] = np.minimum(sure[:, a], p), np.minimum(sure[:, b], 1 - p)
        best = votes.argmax(axis=1)
        names[known[rows]] = np.array(group, object)[best]
        score[known[rows]] = family_score[rows] * sure[np.arange(len(rows)), best]
    return names.tolist(), score


def held_out(doc_id, modulus: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def learn(documents: DataFrame, config: LangConfig = LangConfig()) -> LangModel:
    """Fits on the texts and non-null ``lang`` of ``documents``."""
    labelled = documents.where("lang is not null").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LangModel((), np.zeros((0, config.buckets + 1), np.float32), {}, config)
    each = max(1, config.sample // len(counts))
    share = F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, min(1.0, each / n))])[F.col("lang")]
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("langid")), 11) / F.lit(float(1 << 53))
    sample = labelled.where(draw < share).select("lang", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = features(*text_buffer(part.column("text")), config).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "x"])

    got = sample.mapInArrow(run, "lang string, x binary").toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, config.buckets)
    return fit(x, got.column("lang").to_pylist(), config)


def identify(documents: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, lang_pred and score of each text."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    # plain data: an instance could be read only where this package is
    shared = documents.sparkSession.sparkContext.broadcast((model.families, model.of_family, model.of_pair, asdict(model.config)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, config = shared.value
        model = LangModel(*parts, LangConfig(**config))
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                names, score = predict(*text_buffer(part.column("text")), model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
