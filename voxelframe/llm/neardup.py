"""Near-duplicate documents by ProbMinHash.

A text is a weighted set: its shingles of five lower-cased words (all words,
if fewer), weighted by how often they occur.  Each shingle emits points of a
Poisson process whose rate is its weight, each point aimed at one of the
registers; a register keeps the shingle whose point came first, and a shingle
stops as soon as its next point is later than all registers.  Two texts agree
in a register with the probability Jaccard similarity of their sets.

Equal texts are one node.  Registers are cut into bands; nodes with an equal
band form a bucket.  In a bucket of at most ``crowd`` nodes all are compared;
in a larger one each is compared with the first and the last node, and the
bucket is cut finer by joining neighbouring bands, where the same holds.  Pairs are
verified on their whole shingle sets: the greater of Jaccard and probability
Jaccard similarity must be 0.8 or more.  Classes are connected components.

A larger bucket whose nodes are then still in several components is compared
in full, by pairs of blocks of about ``block`` nodes, each pair of blocks in
one task.  Only pairs within one component are left out, which cannot change
a class.  So any two texts with an equal band and 0.8 or more are of one
class.  The work is linear for a crowd that the first step joins, but grows
with the square of the number of nodes for one that stays in many components.

Defined results: a null text counts as empty; equal texts, empty ones too, are
copies of each other; texts without words are similar to nothing else.  The
class id is the least doc_id of the class (null if all are null).  Rows with
the same doc_id and different texts are kept apart by a hash of the text.
An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import maybe_in, row_hash, set_aside, written
from .textbatch import Words, chunks, mix64, text_buffer


@dataclass(frozen=True)
class NearDupConfig:
    words: int = 5
    similarity: float = 0.8
    registers: int = 64
    band: int = 4
    crowd: int = 12
    finer: tuple[int, ...] = (2, 4)
    block: int = 256


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle of 44 bits, count), sorted by text and shingle."""
    words = Words(data, offsets, lower=True)
    value, same = words.shingles(k)
    doc, value = words.doc[: len(value)][same], value[same]
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = words.per_doc[short] > j
            at = words.first_word[short[has]] + j
            whole[has] = mix64(whole[has] * np.uint64(31) + words.hash[at])
        doc, value = np.concatenate([doc, short]), np.concatenate([value, whole])
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), count


def prob_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Winning shingle of each register of each text; 0 for texts without any."""
    first = np.full(docs * registers, np.inf)
    time = np.zeros(len(doc))
    active = np.arange(len(doc))
    kept_slot, kept_time, kept_from = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    step = 0
    while len(active):
        draw = mix64(shingle[active] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 0xD1B54A32D192ED03 + 1) & (2**64 - 1)))
        uniform = ((draw >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
        time[active] += -np.log(uniform) / weight[active]
        aim = (mix64(draw) >> np.uint64(33)).astype(np.int64) % registers
        slot, now = doc[active] * registers + aim, time[active]
        early = now < first[slot]
        np.minimum.at(first, slot[early], now[early])
        kept_slot = np.concatenate([kept_slot, slot[early]])
        kept_time = np.concatenate([kept_time, now[early]])
        kept_from = np.concatenate([kept_from, active[early]])
        still = kept_time <= first[kept_slot]
        kept_slot, kept_time, kept_from = kept_slot[still], kept_time[still], kept_from[still]
        latest = first.reshape(docs, registers).max(axis=1)
        active = active[now < latest[doc[active]]]
        step += 1
    out = np.zeros(docs * registers, np.uint64)
    out[kept_slot] = shingle[kept_from] + np.uint64(1)
    return out.reshape(docs, registers)


def band_keys(signature: np.ndarray, band: int) -> np.ndarray:
    bands = signature.shape[1] // band
    grouped = signature.reshape(len(signature), bands, band)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for j in range(band):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, j])
    return key.astype(np.int64)


def _node(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, a JVM hash that tells rows of one id apart, and the text as bytes."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def signatures(documents: DataFrame, config: NearDupConfig) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                doc, shingle, count = weighted_shingles(data, offsets, config.words)
                signature = prob_minhash(doc, shingle, count.astype(float), part.num_rows, config.registers)
                keys = band_keys(signature, config.band)
                full = signature.any(axis=1)
                lengths = np.where(full, keys.shape[1], 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(keys[full].ravel()))
                nodes = pa.array([_node(t) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), nodes, lists], ["doc_id", "text_key", "node", "bands"])

    return _keyed(documents).mapInArrow(run, f"doc_id {kind}, text_key long, node binary, bands array<long>")


def _buckets(keys: DataFrame) -> DataFrame:
    """(key, node) -> keys of two nodes or more, with first and last node."""
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last")).where("n > 1")


def _pairs(keys: DataFrame, buckets: DataFrame, crowd: int) -> DataFrame:
    """All pairs of buckets of at most ``crowd`` nodes; of others, each node with the first and the last."""
    met = keys.join(buckets, "key")
    small = met.where(F.col("n") <= crowd).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    rest = lambda i: F.slice("nodes", i + 2, crowd)
    listed = F.flatten(F.transform("nodes", lambda x, i: F.transform(rest(i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    full = small.select(F.explode(listed).alias("p")).select("p.a", "p.b")
    ends = F.array_distinct(F.array("first", "last"))
    crowded = met.where(F.col("n") > crowd).select("node", F.explode(F.filter(ends, lambda e: e != F.col("node"))).alias("end"))
    return full.unionByName(crowded.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))).distinct()


def candidates(nodes: DataFrame, config: NearDupConfig) -> tuple[DataFrame, DataFrame]:
    """From (node, bands): pairs (a, b) of nodes to be verified, and (key, node) of the crowded buckets."""
    keys = nodes.select(F.posexplode("bands").alias("band", "key"), "node")
    buckets = written(_buckets(keys))
    pairs = _pairs(keys, buckets, config.crowd)
    # each crowded band of a node is cut finer; elsewhere all are compared already
    crowded = keys.join(buckets.where(F.col("n") > config.crowd).select("key"), "key", "left_semi").select("key", "node", "band")
    crowded = written(crowded.join(nodes, "node"))
    count = config.registers // config.band
    for joined in config.finer:
        fine = F.xxhash64(F.lit(joined), *[F.get("bands", F.pmod(F.col("band") + j, F.lit(count))) for j in range(joined)])
        more = crowded.select(fine.alias("key"), "node")
        pairs = pairs.unionByName(_pairs(more, _buckets(more), config.crowd))
    return pairs.distinct(), crowded.select("key", "node")


def block_pairs(crowded: DataFrame, labels: DataFrame, config: NearDupConfig) -> DataFrame:
    """(task, side, node, label): what is left to compare in crowded buckets.

    The nodes of a bucket are dealt into blocks; a component of more than
    ``block`` nodes has blocks of its own, which are not compared with each
    other.  A task has one block (side 0), or two (sides 0 and 1).
    """
    member = crowded.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    member = written(member)
    sizes = member.groupBy("key", "label").agg(F.count("*").alias("n"))
    own = F.col("n") > config.block
    several = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.sum(F.when(~own, F.col("n"))).alias("rest")).where("labels > 1")
    parts = lambda n: F.ceil(F.col(n) / F.lit(config.block))
    dealt = member.join(sizes.join(several, "key"), ["key", "label"])
    alone = F.when(own, F.xxhash64("label"))
    block = F.when(own, F.xxhash64("label", F.pmod(F.xxhash64("node"), parts("n")))).otherwise(F.xxhash64(F.lit("rest"), F.pmod(F.xxhash64("label"), parts("rest"))))
    dealt = written(dealt.select("key", "node", "label", block.alias("block"), alone.alias("alone")))
    blocks = dealt.select("key", "block", "alone").distinct()
    x, y = blocks.alias("x"), blocks.alias("y")
    apart = F.col("x.alone").isNull() | F.col("y.alone").isNull() | (F.col("x.alone") != F.col("y.alone"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")) & apart)
    task = F.xxhash64("x.key", "x.block", "y.block")
    side = lambda name, i: F.struct(F.col(f"{name}.block").alias("block"), F.lit(i).alias("side"))
    sides = F.when(F.col("x.block") == F.col("y.block"), F.array(side("x", 0))).otherwise(F.array(side("x", 0), side("y", 1)))
    to = met.select("x.key", task.alias("task"), F.explode(sides).alias("s")).select("key", "task", "s.block", "s.side")
    return dealt.join(to, ["key", "block"]).select("task", "side", "node", "label")


def shingle_sets(documents: DataFrame, config: NearDupConfig) -> DataFrame:
    """node, and its shingles (32 bits each, sorted) with their counts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, shingle, count = weighted_shingles(*text_buffer(part.column("text")), config.words)
                low = (shingle & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                order = np.lexsort((low, doc))
                low, count = low[order], count[order].astype(np.uint32)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                sets, counts, nodes = [], [], [_node(t) for t in part.column("text").to_pylist()]
                for a, b in zip(at[:-1], at[1:], strict=True):
                    sets.append(low[a:b].tobytes())
                    counts.append(count[a:b].tobytes() if (count[a:b] > 1).any() else None)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())], ["node", "shingles", "counts"])

    return documents.mapInArrow(run, "node binary, shingles binary, counts binary")


def similarity(a: np.ndarray, wa: np.ndarray | None, b: np.ndarray, wb: np.ndarray | None) -> float:
    """The greater of Jaccard and probability Jaccard of two sorted sets with counts."""
    if not len(a) or not len(b):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    plain = len(ia) / (len(a) + len(b) - len(ia))
    if wa is None and wb is None:
        return plain
    wa = np.ones(len(a)) if wa is None else wa.astype(float)
    wb = np.ones(len(b)) if wb is None else wb.astype(float)
    # sum over shared d of 1 / sum over all e of max(a_e / a_d, b_e / b_d):
    # which is greater depends on whether a_e / b_e is at least a_d / b_d
    ratio = wa[ia] / wb[ib]
    order = np.argsort(ratio, kind="stable")
    ranked = ratio[order]
    left, right = np.append(0.0, np.cumsum(wa[ia][order])), np.append(0.0, np.cumsum(wb[ib][order]))
    only_a, only_b = wa.sum() - left[-1], wb.sum() - right[-1]
    at = np.searchsorted(ranked, ratio, side="left")
    total = (only_a + left[-1] - left[at]) / wa[ia] + (only_b + right[at]) / wb[ib]
    return float(max(plain, (1 / total).sum()))


def verified(pairs: DataFrame, sets: DataFrame, config: NearDupConfig) -> DataFrame:
    """Pairs whose similarity reaches the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda x: None if x is None else np.frombuffer(x, np.uint32)
        for batch in batches:
            out: list[tuple[bytes, bytes, float]] = []
            for a, b, sa, ca, sb, cb in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "sa", "ca", "sb", "cb")], strict=True):
                if min(len(sa), len(sb)) < config.similarity * max(len(sa), len(sb)) and ca is None and cb is None:
                    continue
                found = similarity(numbers(sa), numbers(ca), numbers(sb), numbers(cb))
                if found >= config.similarity:
                    out.append((a, b, found))
            a, b, found = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ca", "sb", "cb")
    return both.mapInArrow(run, "a binary, b binary, similarity double")


def shared_weights(x: list[tuple[np.ndarray, np.ndarray]], y: list[tuple[np.ndarray, np.ndarray]], columns: int = 4096) -> np.ndarray:
    """For each set of x and of y, the sum over shared shingles of x's weight times y's."""
    value = [np.concatenate([s for s, _ in side]) for side in (x, y)]
    weight = [np.concatenate([w for _, w in side]).astype(np.float64) for side in (x, y)]
    owner = [np.repeat(np.arange(len(side)), [len(s) for s, _ in side]) for side in (x, y)]
    both = np.intersect1d(value[0], value[1])
    out = np.zeros((len(x), len(y)))
    for at in range(0, len(both), columns):
        part, dense = both[at : at + columns], []
        for v, w, o, n in zip(value, weight, owner, (len(x), len(y)), strict=True):
            place = np.minimum(np.searchsorted(part, v), len(part) - 1)
            there = part[place] == v
            cells = np.zeros((n, len(part)))
            cells[o[there], place[there]] = w[there]
            dense.append(cells)
        out += dense[0] @ dense[1].T
    return out


def compare_blocks(x: list[tuple], y: list[tuple] | None, limit: float) -> list[tuple[bytes, bytes, float]]:
    """Links that join all components which similar nodes of two blocks (or of one) belong to.

    Nodes are (node, label, shingles, counts or None).  All pairs are
    compared; a link is left out if those before it join its two labels.
    """
    same, y = y is None, x if y is None else y
    ones = lambda side: [(s, np.ones(len(s))) for _, _, s, _ in side]
    sizes = [np.array([len(s) for _, _, s, _ in side], np.int64) for side in (x, y)]
    common = np.rint(shared_weights(ones(x), ones(y)))
    plain = common / np.maximum(sizes[0][:, None] + sizes[1][None, :] - common, 1)
    # probability Jaccard similarity is at most the part of either text's weight that shared shingles have
    counted = [np.array([c is not None for *_, c in side]) for side in (x, y)]
    maybe = counted[0][:, None] | counted[1][None, :]
    if maybe.any():
        parts = lambda side: [(s, np.full(len(s), 1 / max(1, len(s))) if c is None else c / c.sum()) for _, _, s, c in side]
        bound = np.minimum(shared_weights(parts(x), ones(y)), shared_weights(ones(x), parts(y)))
        maybe &= bound >= limit - 1e-6
    parent: dict[bytes, bytes] = {}

    def find(label: bytes) -> bytes:
        while (up := parent.get(label, label)) != label:
            parent[label] = parent.get(up, up)
            label = up
        return label

    out: list[tuple[bytes, bytes, float]] = []
    for i, j in np.argwhere((plain >= limit) | maybe).tolist():
        (a, la, sa, ca), (b, lb, sb, cb) = x[i], y[j]
        if (same and j <= i) or a == b or (p := find(la)) == (q := find(lb)):
            continue
        found = similarity(sa, ca, sb, cb)
        if found >= limit:
            parent[max(p, q)] = min(p, q)
            out.append((min(a, b), max(a, b), found))
    return out


def crowd_links(tasks: DataFrame, sets: DataFrame, config: NearDupConfig) -> DataFrame:
    """Verified links (a, b, similarity) from the tasks of block_pairs()."""

    def run(table: pa.Table) -> pa.Table:
        numbers = lambda v: None if v is None else np.frombuffer(v, np.uint32)
        sides: tuple[list, list] = ([], [])
        for side, node, label, shingles, counts in zip(*[table.column(c).to_pylist() for c in ("side", "node", "label", "shingles", "counts")], strict=True):
            sides[side].append((node, label, numbers(shingles), numbers(counts)))
        got = compare_blocks(sides[0], sides[1] or None, config.similarity) if sides[0] else []
        a, b, found = zip(*got, strict=True) if got else ((), (), ())
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    both = tasks.join(sets, "node").select("task", "side", "node", "label", "shingles", "counts")
    return both.groupBy("task").applyInArrow(run, "a binary, b binary, similarity double")


def classes(documents: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, class_size, links, kept.

    links: verified links of the document's text to other texts (of those
    inside a crowd, as many as its class needs).  kept: true
    for one row of each class, unless equal rows repeat (then for each).
    """
    rows = written(signatures(documents, config))
    by_node = rows.groupBy("node").agg(F.first("bands").alias("bands"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("r"))
    nodes = written(by_node.select("node", "bands", "r.doc_id", "r.text_key"))
    pairs, crowded = candidates(nodes.select("node", "bands"), config)
    pairs = written(pairs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "doc_id", "text_key"), "node")
    wanted = written(wanted.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))
    keyed = maybe_in(_keyed(documents), "text_key", wanted.select("_key"))
    texts = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["_id"]) & (keyed["text_key"] == wanted["_key"]), "left_semi").select("text")
    sets = written(shingle_sets(texts, config).dropDuplicates(["node"]))
    links = written(verified(pairs, sets, config))
    labels = connected_components(links)
    more = written(crowd_links(block_pairs(crowded, labels, config), sets, config))
    if not more.isEmpty():
        joined = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more.select("a", "b"))
        labels = connected_components(joined)
        links = links.unionByName(more).dropDuplicates(["a", "b"])
    degree = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    known = labels.join(degree, "node", "left")
    row = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    marked = rows.drop("bands").join(known, "node", "left").select("doc_id", "text_key", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    marked = written(marked)
    sizes = marked.groupBy("label").agg(F.min(row).alias("first"), F.count("*").alias("class_size"))
    out = marked.join(sizes, "label")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return out.select("doc_id", "text_key", F.col("first.doc_id").alias("class_id"), "class_size", "links", kept.alias("kept"))


def keep_one_of_each(documents: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """The documents without near-duplicates: the row of the least doc_id of each class stays."""
    documents, back = set_aside(documents)
    names = list(documents.columns)
    kept = classes(documents, config).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.count("*").alias("_rows"))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = documents.withColumn("_text_key", key)
    found = found.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")))
    single = found.where("_rows = 1").select(*names)
    # rows equal in doc_id and text: the one of the least hash of all columns, whichever task is asked
    several = found.where("_rows > 1").withColumn("_hash", row_hash(found.select(*names)))
    several = several.groupBy("doc_id", "_text_key").agg(F.min_by(F.struct(*names), "_hash").alias("_least")).select("_least.*")
    return back(single.unionByName(several))
