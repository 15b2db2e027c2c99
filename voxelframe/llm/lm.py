"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is P(class | history) * P(member | class, history) *
P(word | member).  Classes group words by their neighbours; a class has its
frequent words as members of their own, and one member for all its other
words, which share its mass by add-one counts.  The history enters through
hashed features: the last word, the last two words, the last word but one
(skip), and the classes of the last three words.  Both softmaxes add up to
one over their classes or members, so the whole does over the vocabulary and
one place for unknown words in each class.

Training goes over all training documents: (1) count all words; (2) sum
random projections of the neighbours of the frequent words, which make the
classes; (3) distributed gradient updates.  The documents are dealt by hash
into ``slices``, and ``rounds`` says how many slices each update takes, so that
all together are one pass.  In an update, tasks add up for each feature how
often each class or member was observed and how often the weights so far
expect it; the sums of all tasks move the weights, which are sent out anew.
Each coordinate's step is its gradient (observed less expected) divided by the
logarithmic mean of the two, times ``rate``.  Results do not depend on the
number of tasks, as only sums over documents enter.

Counts of the ``table_words`` most frequent words are broadcast (a fixed size);
rarer words are joined with the full table of counts.

Defined results: a null text is empty and has one token, the end; a null
doc_id trains; without training words every score is the base score; rows
equal in doc_id and text get equal results.  Extra columns are not read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .textbatch import Words, chunks, mix64, text_buffer

END = np.uint64(0x2545F4914F6CDD1D)
START = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class LmConfig:
    classes: int = 32
    members: int = 48
    bits: int = 14
    head_words: int = 8192
    table_words: int = 1 << 20
    projections: int = 16
    suffixes: int = 8192
    batch: int = 8192
    summed: int = 1 << 14
    slices: int = 16
    rounds: tuple[int, ...] = (2, 2, 4, 8)
    rate: float = 0.5
    prior: float = 1.0

    @property
    def rows(self) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Rows of each feature's weights for classes and for members; 65,536 at most."""
        words = 1 << self.bits
        return (words // 2, words, words // 2, words // 2), (words, self.classes**2)


@dataclass
class Lookup:
    """A table from 64-bit words to row numbers, by open addressing."""

    slots: np.ndarray
    rows: np.ndarray
    shift: np.uint64

    @staticmethod
    def build(keys: np.ndarray) -> Lookup:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        slots, rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        left = np.arange(len(keys))
        at = (mix64(keys) >> shift).astype(np.int64)
        while len(left):
            free = rows[at] < 0
            rows[at[free]] = left[free]  # the last writer of a slot wins
            slots[at[free]] = keys[left[free]]
            lost = rows[at] != left
            left, at = left[lost], (at[lost] + 1) & mask
        return Lookup(slots, rows, shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        mask = len(self.slots) - 1
        left = np.arange(len(keys))
        at = (mix64(keys) >> self.shift).astype(np.int64)
        while len(left):
            row = self.rows[at]
            hit = (row >= 0) & (self.slots[at] == keys[left])
            out[left[hit]] = row[hit]
            on = (row >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & mask
        return out


@dataclass
class Tokens:
    """Tokens of a batch: every text's words, then its end."""

    hash: np.ndarray
    suffix: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # n+1 positions


def tokens_of(column: pa.Array, suffixes: int) -> Tokens:
    words = Words(*text_buffer(column), lower=True)
    n, docs = len(words.doc), words.n_docs
    first = words.first_word + np.arange(docs + 1)
    at = np.arange(n) + words.doc
    hashes, suffix = np.full(n + docs, END, np.uint64), np.zeros(n + docs, np.int32)
    hashes[at] = words.hash
    if n:
        data, last = words.data, words.ends - 1
        mark = np.zeros(256, bool)
        mark[[ord(c) for c in ".,;:!?"]] = True
        last = last - (mark[data[last]] & (last > words.starts))
        value = data[last].astype(np.uint64)
        for j in (1, 2, 3):
            inside = last - j >= words.starts
            value |= np.where(inside, data[np.maximum(last - j, 0)], 0).astype(np.uint64) << np.uint64(8 * j)
        suffix[at] = (mix64(value) % np.uint64(suffixes)).astype(np.int32)
    return Tokens(hashes, suffix, np.repeat(np.arange(docs), np.diff(first)), first)


def back(values: np.ndarray, tokens: Tokens, steps: int, start) -> np.ndarray:
    """The value ``steps`` tokens earlier in the same text, else ``start``."""
    out = np.full(len(values), start, values.dtype)
    if len(values) > steps:
        same = tokens.doc[steps:] == tokens.doc[:-steps]
        out[steps:][same] = values[:-steps][same]
    return out


def count_words(texts: DataFrame, config: LmConfig) -> DataFrame:
    """(word, suffix, n) over all texts."""

    def flush(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, suffix, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        word = word[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        return word[first], suffix[order][first], np.add.reduceat(n[order], first)

    def send(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1].astype(np.int32)), pa.array(part[2].astype(np.int64))], ["word", "suffix", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                got = tokens_of(part.column("text"), config.suffixes)
                held.append(flush([(got.hash, got.suffix, np.ones(len(got.hash), np.int64))]))
                size += len(held[-1][0])
                if size > 1_500_000:
                    held = [flush(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield send(held.pop())
                        size = 0
        if held:
            yield send(flush(held))

    rows = texts.select("text").mapInArrow(run, "word long, suffix int, n long")
    return rows.groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def project_neighbours(texts: DataFrame, head: np.ndarray, config: LmConfig) -> np.ndarray:
    """For each word of ``head``, sums of signs drawn for the words before and after it."""
    shared = texts.sparkSession.sparkContext.broadcast(plain(Lookup.build(head)))
    size = config.projections

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = Lookup(**shared.value).find, np.zeros((len(head), size), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                got = tokens_of(part.column("text"), config.suffixes)
                row = find(got.hash)
                before = mix64(back(got.hash, got, 1, START))
                after = np.append(got.hash[1:], END) if len(got.hash) else got.hash
                after = mix64(after * np.uint64(3)) * (got.hash != END)
                known = np.flatnonzero(row >= 0)
                at = row[known]
                for j in range(size):
                    bit = np.uint64(1) << np.uint64(j)
                    sign = ((before[known] & bit) > 0) * 2.0 - 1 + ((after[known] & bit) > 0) * 2.0 - 1
                    total[:, j] += np.bincount(at, weights=sign, minlength=len(head)).astype(np.int64)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(total[used, j]) for j in range(size)]], ["row", *[f"p{j}" for j in range(size)]])

    sums = texts.select("text").mapInArrow(run, "row long, " + ", ".join(f"p{j} long" for j in range(size)))
    got = sums.groupBy("row").agg(*[F.sum(f"p{j}").alias(f"p{j}") for j in range(size)]).toArrow()
    out = np.zeros((len(head), size))
    out[got.column("row").to_numpy()] = np.stack([got.column(f"p{j}").to_numpy() for j in range(size)], axis=1)
    return out


def cluster(points: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Weighted k-means, begun with points far from each other."""
    if len(points) <= k:
        return np.arange(len(points))
    centres = [int(weight.argmax())]
    near = ((points - points[centres[0]]) ** 2).sum(axis=1)
    while len(centres) < k:
        centres.append(int((near * np.sqrt(weight)).argmax()))
        near = np.minimum(near, ((points - points[centres[-1]]) ** 2).sum(axis=1))
    middle = points[centres]
    for _ in range(25):
        kind = ((points**2).sum(axis=1)[:, None] - 2 * points @ middle.T + (middle**2).sum(axis=1)).argmin(axis=1)
        for c in range(k):
            if (kind == c).any():
                middle[c] = np.average(points[kind == c], axis=0, weights=weight[kind == c])
    return kind


@dataclass
class LmModel:
    """What is broadcast: fixed sizes only."""

    config: LmConfig
    train_tokens: int
    vocabulary: int
    table: Lookup  # frequent words
    count: np.ndarray
    head: Lookup  # words with a class of their own
    head_class: np.ndarray
    head_member: np.ndarray
    suffix_class: np.ndarray
    class_bias: np.ndarray
    member_bias: np.ndarray
    rest_size: np.ndarray  # tokens + words + 1 of each class's last member
    class_weights: list[np.ndarray]
    member_weights: list[np.ndarray]

    def places(self, got: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class and member of each token."""
        row = self.head.find(got.hash)
        kind = np.where(row >= 0, self.head_class[row], self.suffix_class[got.suffix])
        member = np.where(row >= 0, self.head_member[row], self.config.members - 1)
        return kind.astype(np.int64), member.astype(np.int64)

    def features(self, got: Tokens, kind: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Active row of each feature at each token, for its class and for its member."""
        c, (of_class, of_member) = self.config.classes, self.config.rows
        one, two = back(got.hash, got, 1, START), back(got.hash, got, 2, START)
        past = [back(kind, got, j, 0) for j in (1, 2, 3)]
        trio = ((past[0] * c + past[1]) * c + past[2]).astype(np.uint64) + np.uint64(13)
        own = mix64(kind.astype(np.uint64) + np.uint64(101))
        hashes = [one, one * np.uint64(5) + two, two + np.uint64(7), trio, one ^ own]
        for_class = [(mix64(h) % np.uint64(n)).astype(np.uint16) for h, n in zip(hashes, (*of_class, of_member[0]), strict=True)]
        return for_class[:4], [for_class[4], (past[0] * c + kind).astype(np.uint16)]


def _exponentials(weights: Sequence[np.ndarray], rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    logits = bias + weights[0].take(rows[0], axis=0)
    for table, row in zip(weights[1:], rows[1:], strict=True):
        logits += table.take(row, axis=0)
    np.clip(logits, -60, 60, out=logits)
    return np.exp(logits, out=logits)


class Sums:
    """Observed and expected counts of each row of several features; one line for each class or member."""

    def __init__(self, rows: tuple[int, ...], width: int):
        self.width = width
        self.observed = [np.zeros(n * width, np.int64) for n in rows]
        self.expected = [np.zeros((width, n)) for n in rows]

    def observe(self, rows: list[np.ndarray], target: np.ndarray) -> None:
        for table, row in zip(self.observed, rows, strict=True):
            table += np.bincount(row.astype(np.int64) * self.width + target, minlength=len(table))

    def expect(self, weights: list[np.ndarray], rows: list[np.ndarray], bias: np.ndarray) -> None:
        """weights and bias have a line for each class or member, too."""
        rows = [r.astype(np.int64) for r in rows]
        p = weights[0].take(rows[0], axis=1)
        p += bias
        for table, row in zip(weights[1:], rows[1:], strict=True):
            p += table.take(row, axis=1)
        np.clip(p, -60, 60, out=p)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        for table, row in zip(self.expected, rows, strict=True):
            for line, share in zip(table, p, strict=True):
                line += np.bincount(row, weights=share, minlength=len(line))


def plain(model: LmModel | Lookup | None):
    """For a broadcast: unlike an instance, it needs no copy of this package where it is read."""
    if not dataclasses.is_dataclass(model):
        return model
    return {f.name: plain(getattr(model, f.name)) for f in dataclasses.fields(model)}


def restored(fields: dict | None) -> LmModel | None:
    if fields is None:
        return None
    lookup = lambda name: fields[name] and Lookup(**fields[name])
    return LmModel(**fields | {"config": LmConfig(**fields["config"]), "table": lookup("table"), "head": lookup("head")})


def gradient(texts: DataFrame, model: LmModel) -> DataFrame:
    """(number, low, observed, expected, step) of blocks of rows of the classes' tables, then the members'.

    The counts over ``texts``, and how far the weights move for them.

    A task sends at most one pair of counts for each weight; the number of
    tasks that send is bounded by the cluster's cores.
    """
    spark, config = texts.sparkSession, model.config
    light = dataclasses.replace(model, table=None, count=None)
    shared = spark.sparkContext.broadcast(plain(light))
    rows, widths = config.rows, (config.classes, config.members)
    sizes = [(n, w) for group, w in zip(rows, widths, strict=True) for n in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = restored(shared.value)
        sums = [Sums(group, w) for group, w in zip(rows, widths, strict=True)]
        class_weights, member_weights = ([np.ascontiguousarray(w.T) for w in side] for side in (model.class_weights, model.member_weights))
        class_bias, member_bias = model.class_bias[:, None], np.ascontiguousarray(model.member_bias.T)
        for batch in batches:
            for part in chunks(batch, "text"):
                got = tokens_of(part.column("text"), config.suffixes)
                kind, member = model.places(got)
                features = model.features(got, kind)
                for s, f, target in zip(sums, features, (kind, member), strict=True):
                    s.observe(f, target)
                for low in range(0, len(kind), config.summed):
                    at = slice(low, low + config.summed)
                    sums[0].expect(class_weights, [r[at] for r in features[0]], class_bias)
                    sums[1].expect(member_weights, [r[at] for r in features[1]], member_bias.take(kind[at], axis=1))
        tables = [(o.reshape(-1, s.width), e.T) for s in sums for o, e in zip(s.observed, s.expected, strict=True)]
        for number, (observed, expected) in enumerate(tables):
            for low in range(0, len(observed), 1024):  # a block of rows of a table
                o, e = observed[low : low + 1024], expected[low : low + 1024]
                used = np.flatnonzero(o.any(axis=1))
                if len(used):
                    cells = [used.astype(np.int16).tobytes(), o[used].astype(np.int32).tobytes(), np.sqrt(e[used]).astype(np.float16).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([low], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["number", "low", "used", "observed", "expected"])

    def add(table: pa.Table) -> pa.Table:
        number, low = table.column("number")[0].as_py(), table.column("low")[0].as_py()
        n, w = sizes[number]
        o, e = np.zeros((min(1024, n - low), w), np.int64), np.zeros((min(1024, n - low), w))
        for used, observed, expected in zip(*[table.column(c).to_pylist() for c in ("used", "observed", "expected")], strict=True):
            at = np.frombuffer(used, np.int16)
            o[at] += np.frombuffer(observed, np.int32).reshape(-1, w)
            e[at] += np.frombuffer(expected, np.float16).reshape(-1, w).astype(np.float64) ** 2
        step = (config.rate * np.log((o + config.prior) / (e + config.prior))).astype(np.float32)
        return pa.table([pa.array([number], pa.int32()), pa.array([low], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (o, e, step)]], ["number", "low", "observed", "expected", "step"])

    few = texts.coalesce(4 * spark.sparkContext.defaultParallelism)
    sent = few.mapInArrow(run, "number int, low int, used binary, observed binary, expected binary")
    return sent.groupBy("number", "low").applyInArrow(add, "number int, low int, observed binary, expected binary, step binary")


def steps(counts: DataFrame, config: LmConfig) -> list[np.ndarray]:
    """How far the weights of each table move; the driver gets one number for each weight."""
    sizes = [(n, w) for group, w in zip(config.rows, (config.classes, config.members), strict=True) for n in group]
    out = [np.zeros(s, np.float32) for s in sizes]
    got = counts.select("number", "low", "step").toArrow()
    for number, low, step in zip(*[got.column(c).to_pylist() for c in ("number", "low", "step")], strict=True):
        moved = np.frombuffer(step, np.float32).reshape(-1, sizes[number][1])
        out[number][low : low + len(moved)] = moved
    return out


def train(texts: DataFrame, model: LmModel) -> LmModel:
    """One update of all weights for each of ``rounds``, over that many slices of the documents."""
    config, low = model.config, 0
    key = F.xxhash64("text", *(["doc_id"] if "doc_id" in texts.columns else []), F.lit("slice"))
    slice_of = F.pmod(key, F.lit(config.slices))
    for count in config.rounds:
        part = texts.where((slice_of >= low) & (slice_of < low + count)).select("text")
        low += count
        moves = steps(gradient(part, model), config)
        moved = [w + m for w, m in zip([*model.class_weights, *model.member_weights], moves, strict=True)]
        split = len(model.class_weights)
        model = dataclasses.replace(model, class_weights=moved[:split], member_weights=moved[split:])
    return model


def learn(texts: DataFrame, config: LmConfig = LmConfig()) -> tuple[LmModel | None, DataFrame]:
    """The model of the column ``text``, and the table of all counts."""
    texts = texts.select(*(["doc_id"] if "doc_id" in texts.columns else []), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = written(count_words(texts, config))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    if not total["v"]:
        return None, counts
    # the count from which on the words fit the table, by the number of words of each count: nothing is sorted
    upto = F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    least = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", upto).where(F.col("upto") <= config.table_words).agg(F.min("n").alias("n")).first()["n"]
    top = counts.where(F.col("n") >= F.lit(least)).select("word", "suffix", "n").toArrow()
    word, suffix, n = (top.column(c).to_numpy() for c in ("word", "suffix", "n"))
    order = np.lexsort((word, -n))
    word, suffix, n = word[order].view(np.uint64), suffix[order], n[order]
    size = min(config.head_words, len(word))
    head = word[:size]
    points = project_neighbours(texts, head, config) / n[:size, None]
    kind = cluster(points, n[:size].astype(float), config.classes)
    member = np.full(size, config.members - 1)
    for c in range(config.classes):
        own = np.flatnonzero(kind == c)[: config.members - 1]  # by rank
        member[own] = np.arange(len(own))
    votes = np.zeros((config.suffixes, config.classes))
    np.add.at(votes, (suffix[:size], kind), np.sqrt(n[:size]))
    votes += np.bincount(kind, weights=n[:size], minlength=config.classes) * 1e-9  # suffixes without votes
    suffix_class = votes.argmax(axis=1)
    # words and tokens of each class's last member, over the whole table of counts
    shown = texts.sparkSession.createDataFrame(pa.table({"word": head.view(np.int64), "kind": kind.astype(np.int32), "member": member.astype(np.int32)}))
    suffixes = texts.sparkSession.createDataFrame(pa.table({"suffix": np.arange(config.suffixes, dtype=np.int32), "by_suffix": suffix_class.astype(np.int32)}))
    placed = counts.join(F.broadcast(shown), "word", "left").join(F.broadcast(suffixes), "suffix")
    sizes = placed.groupBy(F.coalesce("kind", "by_suffix").alias("kind"), F.coalesce("member", F.lit(config.members - 1)).alias("member")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    mass, kinds = np.zeros((config.classes, config.members)), np.zeros((config.classes, config.members))
    for r in sizes:
        mass[r["kind"], r["member"]], kinds[r["kind"], r["member"]] = r["n"], r["v"]
    bias = lambda x: np.log((x + 0.5) / (x + 0.5).sum(axis=-1, keepdims=True)).astype(np.float32)
    model = LmModel(
        config, int(total["n"]), int(total["v"]), Lookup.build(word), n.astype(np.int64), Lookup.build(head), kind, member, suffix_class,
        bias(mass.sum(axis=1)), bias(mass), mass[:, -1] + kinds[:, -1] + 1,
        *[[np.zeros((n, width), np.float32) for n in rows] for rows, width in zip(config.rows, (config.classes, config.members), strict=True)],
    )
    return train(texts, model), counts


def token_scores(got: Tokens, model: LmModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in the table of counts (or -1), class, and log10 of P(class) P(member), of each token."""
    kind, member = model.places(got)
    of_class, of_member = model.features(got, kind)
    out = np.zeros(len(kind))
    for low in range(0, len(kind), model.config.batch):
        at = slice(low, low + model.config.batch)
        here = np.arange(len(kind[at]))
        for rows, weights, bias, target in ((of_class, model.class_weights, model.class_bias, kind), (of_member, model.member_weights, model.member_bias.take(kind[at], axis=0), member)):
            e = _exponentials(weights, [r[at] for r in rows], bias)
            out[at] += np.log(e[here, target[at]] / (e @ np.ones(e.shape[1], np.float32)))
    row = model.table.find(got.hash)
    # a word in its class's last member has its add-one share of it; of words not in the table, the join adds it
    rest = (member == model.config.members - 1) & (row >= 0)
    share = np.zeros(len(kind))
    share[rest] = np.log((model.count[row[rest]] + 1) / model.rest_size[kind[rest]])
    return row, kind, (out + share) / np.log(10)


def score(documents: DataFrame, model: LmModel | None, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each text."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.xxhash64("doc_id", text).alias("row"), text.cast("binary").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(plain(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = restored(shared.value)
        names = ["doc_id", "row", "n_tokens", "known", "base", "own", "words", "times", "kinds"]
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                got = tokens_of(part.column("text"), model.config.suffixes if model else 1)
                lengths = np.diff(got.first)
                if model is None:
                    zero = np.zeros(part.num_rows)
                    empty = pa.ListArray.from_arrays(pa.array(np.zeros(part.num_rows + 1, np.int32)), pa.array([], pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(lengths), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero), empty, empty, empty], names)
                    continue
                row, classes, own = token_scores(got, model)
                base = np.where(row >= 0, np.log10((model.count[row] + 1) / (model.train_tokens + model.vocabulary + 1)), 0.0)
                rare = np.flatnonzero(row < 0)
                key = np.lexsort((got.hash[rare], got.doc[rare]))
                rare = rare[key]
                new = np.ones(len(rare), bool)
                new[1:] = (got.hash[rare][1:] != got.hash[rare][:-1]) | (got.doc[rare][1:] != got.doc[rare][:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rare)))
                one = rare[first]
                at = pa.array(np.searchsorted(got.doc[one], np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int64))) for x in (got.hash[one].view(np.int64), times, classes[one])]
                total = lambda x: np.bincount(got.doc, weights=x, minlength=part.num_rows)  # noqa: B023, E731
                cells = [pa.array(lengths), pa.array(total(row >= 0).astype(np.int64)), pa.array(total(base)), pa.array(total(own))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *cells, *lists], names)

    scored = written(rows.mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, base double, own double, words array<long>, times array<long>, kinds array<long>"))
    if model is None:
        return scored.select("doc_id", "n_tokens", F.col("known").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("own").alias("score"))
    rare = scored.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times", "kinds")).alias("t"))
    rare = rare.groupBy("row", F.col("t.words").alias("word")).agg(F.max("t.times").alias("times"), F.max("t.kinds").alias("kind"))
    c = F.coalesce("n", F.lit(0))
    sizes = F.array(*[F.lit(float(x)) for x in model.rest_size])
    met = rare.join(counts.select("word", "n"), "word", "left")
    sums = met.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(model.train_tokens + model.vocabulary + 1)))).alias("more_base"),
        F.sum(F.col("times") * F.log10((c + 1) / F.get(sizes, F.col("kind").cast("int")))).alias("more_own"),
    )
    joined = scored.drop("words", "times", "kinds").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return joined.select(
        "doc_id", "n_tokens", plus("known", "more_known").cast("long").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("own", "more_own").alias("score"),
    )
