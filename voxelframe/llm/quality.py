"""Quality rules: counts of a text and the divergence of its histograms.

A document is compared with references of each language by the Jensen-Shannon
distance of two histograms: its character classes, and its common words
(the most frequent words of each language, and all others as one bin).  The
references cover all documents.  A document fails if its distance from the
nearest language's character classes or common words is above a limit; texts
of fewer than ``judge_from_words`` words are not judged by their histograms, as
these say little.  With the rules as they are, that guard is the base rule's
limit of 50 words: shorter texts fail by that, and are not looked at further.

Defined results: a null text has no words and fails the base rule; a row is
judged alone, so repeated rows get equal results; documents without a language
do not shape a reference; without any reference only the base rule holds.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import set_aside, written
from .textbatch import Words, chunks, mix64, text_buffer

#: Character classes of a byte (fixed values): 0 lower case, 1 upper case,
#: 2 digit, 3 space, 4 line end, 5 sentence marks, 6 symbols, 7 other ASCII,
#: 8 first byte of a longer character, 9 its other bytes (not counted).
CLASSES = 9


@dataclass(frozen=True)
class QualityRules:
    common_words: int = 64
    min_words: int = 50
    most_repeated: float = 0.5
    class_distance: float = 0.28
    word_distance: float = 0.48
    judge_from_words: int = 50


def byte_classes() -> np.ndarray:
    table = np.full(256, 7, np.uint8)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[[32, 9]], table[[10, 11, 12, 13]] = 3, 4
    table[[ord(c) for c in ".,;:'\"!?()-"]] = 5
    table[[ord(c) for c in "#*$%&|<>"]] = 6
    table[128:192], table[192:] = 9, 8
    return table


def histogram(group: np.ndarray, kind: np.ndarray, groups: int, kinds: int) -> np.ndarray:
    return np.bincount(group * kinds + kind, minlength=groups * kinds).reshape(groups, kinds)


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    docs = len(offsets) - 1
    group = np.repeat(np.arange(docs), np.diff(offsets))
    return histogram(group, byte_classes()[data], docs, 10)[:, :CLASSES]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the base-2 divergence, of each row of p from the distribution q."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)
        m = (p + q) / 2
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


@dataclass(frozen=True)
class References:
    """For each language the class histogram, the common words and their shares."""

    names: tuple[str, ...]
    classes: np.ndarray
    words: tuple[np.ndarray, ...]
    shares: tuple[np.ndarray, ...]


#: Counts that a task holds before it sends them.
HELD = 500_000


def _combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    word, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    word, at = np.unique(word, return_inverse=True)
    return word, np.bincount(at, weights=n, minlength=len(word)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): words of a partition, counted; a language's counts are sent when they are many.

    ``word`` -1-k of class k carries the counts of character classes.
    """
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def send(name: str) -> pa.RecordBatch:
        values, counts = _combined(held.pop(name))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            codes = part.column("lang").dictionary_encode()
            lang = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = text_buffer(part.column("text"))
            words = Words(data, offsets, lower=True)
            key, classes = (words.hash >> np.uint64(8)).astype(np.int64), class_counts(data, offsets)
            for k, name in enumerate(codes.dictionary.to_pylist()):
                values, counts = np.unique(key[lang[words.doc] == k], return_counts=True)
                own = held.setdefault(name, [])
                own.append((np.concatenate([values, -1 - np.arange(CLASSES)]), np.concatenate([counts, classes[lang == k].sum(axis=0)])))
            if sum(len(v) for parts in held.values() for v, _ in parts) > 2 * HELD:
                held = {name: [_combined(parts)] for name, parts in held.items()}
                while sum(len(parts[0][0]) for parts in held.values()) > HELD:
                    yield send(max(held, key=lambda n: len(held[n][0][0])))
    for name in list(held):
        yield send(name)


def learn_references(documents: DataFrame, rules: QualityRules = QualityRules()) -> References:
    """References from all documents that have a language.

    What comes to the driver is ``common_words`` + 9 rows for each language.
    """
    rows = documents.where("lang is not null").select("lang", F.col("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(_count_words, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = written(counts)
    # a salted top-k: no task ranks all words of a language
    salted = Window.partitionBy("lang", F.pmod("word", F.lit(64)), F.col("word") < 0).orderBy(F.desc("n"), "word")
    top = Window.partitionBy("lang", F.col("word") < 0).orderBy(F.desc("n"), "word")
    totals = counts.where("word >= 0").groupBy("lang").agg(F.lit(-100).cast("long").alias("word"), F.sum("n").alias("n"))
    some = counts.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= rules.common_words)
    some = some.withColumn("r", F.row_number().over(top)).where(F.col("r") <= rules.common_words).select("lang", "word", "n")
    found: dict[str, dict[int, int]] = {}
    for row in some.unionByName(totals).collect():
        found.setdefault(row["lang"], {})[row["word"]] = row["n"]
    names, classes, words, shares = sorted(n for n in found if found[n].get(-100)), [], [], []
    for name in names:
        got = found[name]
        histogram_ = np.array([got.get(-1 - k, 0) for k in range(CLASSES)], float)
        classes.append(histogram_ / histogram_.sum())
        common = np.array(sorted(w for w in got if w >= 0), np.int64)
        part = np.array([got[int(w)] for w in common], float) / got[-100]
        words.append(common)
        shares.append(np.append(part, max(0.0, 1 - part.sum())))
    return References(tuple(names), np.array(classes).reshape(len(names), CLASSES), tuple(words), tuple(shares))


def _symbols() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in "#*$%&|<>"]] = True
    return table


def _repeat_words(words: Words) -> np.ndarray:
    """Words that lie in windows of three words found twice or more in their text."""
    keys, same = words.shingles(3)
    at = np.flatnonzero(same)
    keys = mix64(keys[at] + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    ranked = keys[order]
    twice = np.zeros(len(at), bool)
    if len(at) > 1:
        equal = ranked[1:] == ranked[:-1]
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
    marked = np.zeros(len(words.doc), bool)
    for j in range(3):
        marked[at[twice] + j] = True
    return np.bincount(words.doc[marked], minlength=words.n_docs)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, byte for byte."""
    ends = np.flatnonzero(data == 10)
    marks = np.sort(np.concatenate([offsets, ends, ends + 1]))  # pieces between marks hold no line end, or just one
    begin, stop = marks[:-1], marks[1:]
    full = np.searchsorted(words.starts, stop) > np.searchsorted(words.starts, begin)
    begin, stop = begin[full], stop[full]
    doc = np.searchsorted(offsets, begin, side="right") - 1
    single = doc[1:] == doc[:-1]
    lonely = np.ones(len(doc), bool)
    lonely[1:] &= ~single
    lonely[:-1] &= ~single
    count, seen, last, raw = np.zeros(len(offsets) - 1, np.int64), set(), -1, data.tobytes()
    for b, e, d in zip(begin[~lonely].tolist(), stop[~lonely].tolist(), doc[~lonely].tolist(), strict=True):
        if d != last:
            seen, last = set(), d
        line = raw[b:e]
        if line in seen:
            count[d] += 1
        else:
            seen.add(line)
    return count


def measure(texts: pa.Array, references: References, rules: QualityRules) -> dict[str, np.ndarray]:
    """Counts, distances and verdicts of a batch of texts."""
    data, offsets = text_buffer(texts)
    docs = len(offsets) - 1
    words = Words(data, offsets)
    n_words = words.per_doc
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=inside[1:])
    space = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data == 32) | ((data >= 9) & (data <= 13)), out=space[1:])
    chars = (inside[offsets[1:]] - inside[offsets[:-1]]) - (space[offsets[1:]] - space[offsets[:-1]])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_symbols()[data], out=symbols[1:])
    repeats = _repeat_words(words)
    failed = (n_words < rules.min_words) | (100 * repeats > 100 * rules.most_repeated * n_words)
    classes = class_counts(data, offsets).astype(float)
    by_class, by_word = np.ones(docs), np.ones(docs)
    if references.names:
        lowered = Words(data, offsets, lower=True)
        key = (lowered.hash >> np.uint64(8)).astype(np.int64)
        by_class = np.min([js_distance(classes, q) for q in references.classes], axis=0)
        far = []
        for common, q in zip(references.words, references.shares, strict=True):
            at = np.minimum(np.searchsorted(common, key), len(common) - 1)
            kind = np.where(common[at] == key, at, len(common))
            far.append(js_distance(histogram(lowered.doc, kind, docs, len(common) + 1).astype(float), q))
        by_word = np.min(far, axis=0)
        judged = n_words >= rules.judge_from_words
        differs = judged & ((by_class > rules.class_distance) | (by_word > rules.word_distance))
    else:
        differs = np.zeros(docs, bool)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": _duplicate_lines(data, offsets, words), "n_repeat_words": repeats,
        "base_failed": failed, "kept": ~failed & ~differs, "class_distance": by_class, "word_distance": by_word,
    }


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def with_quality(documents: DataFrame, keep: list[str], references: References, rules: QualityRules = QualityRules()) -> DataFrame:
    """The columns ``keep`` of each document and its measures (MEASURES)."""
    fields = [documents.schema[c] for c in keep]
    names = [f"_{i}" for i in range(len(keep))]
    rows = documents.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = ", ".join([*[f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True)], MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                got = measure(part.column("text"), references, rules)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *[pa.array(v) for v in got.values()]], [*names, *got])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *[c for c in out.columns if c not in names])


def reject_low_quality(documents: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with all their columns."""
    inner, back = set_aside(documents)
    return back(with_quality(inner, list(inner.columns), learn_references(inner, rules), rules).where("kept"))
