"""Near-duplicate passages by compact windows.

Tokens are shingles of five lower-cased words, hashed by several functions.
In the Cartesian tree over one function's hashes (a heap by hash, in order by
position), a node and its subtree are a compact window [left, centre, right]:
every subsequence that holds the node and stays inside the subtree has the
node's hash as its min-hash.  Only windows of at least ``least`` tokens can
hold a passage of that length; their nodes are the minima of some ``least``
tokens in a row, and as ancestors of such nodes are such nodes too, the tree
over them alone gives each its whole subtree.

Windows of two functions are intersected within their text; a place where both
agree is a row (signature, text, extent).  Texts meet in rows of an equal
signature, and the extents of a pair of texts that overlap are merged over all
signatures.  The pair is verified token by token around them: a passage of at
least 50 words with a Jaccard similarity of 0.8 or more.

In each signature, all texts are compared with the least one (by row hash).
Rows that share no passage with it go on without it, for ``rounds`` times;
what is then left is compared in full, by pairs of blocks of ``block`` rows,
where each row is linked with the least text of a block that shares a passage
with it.  A passage shared by n texts so gives about n rows, and no pairs of
all its texts.  The full comparison grows with the square of the rows of a
signature that share nothing with its least texts.

Passages equal in at least 50 words share all signatures and are found
always.  At a similarity of exactly 0.8, passages of 50 words share one of the
four signatures with a probability of 0.98, longer or likelier ones with more.

Defined results: null and short texts have no passages; rows equal in doc_id
and text are one document; repeats within one text do not count; a null
doc_id is carried as null.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import shared_weights
from .store import bucketed, maybe_in, set_aside, written
from .textbatch import Words, chunks, mix64, text_buffer
from .winnow import sliding_min


@dataclass(frozen=True)
class PassageConfig:
    words: int = 5
    least_words: int = 50
    similarity: float = 0.8
    signatures: int = 4
    rounds: int = 2
    block: int = 512
    dull: int = 16

    @property
    def least(self) -> int:
        """Tokens of a passage of ``least_words`` words."""
        return self.least_words - self.words + 1


def token_hashes(tokens: np.ndarray, function: int) -> np.ndarray:
    return mix64(tokens ^ np.uint64((0xA0761D6478BD642F * (2 * function + 1)) & (2**64 - 1)))


def next_lower(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Index of the nearest lower value to the left in the same text, or -1: the tree's ancestor on that side.

    All that lies between an index and its pointer is greater, so a pointer to
    a greater value may jump to where that one points.
    """
    to = np.arange(-1, len(values) - 1)
    open_ = np.arange(len(values))
    while len(open_):
        at = to[open_]
        out = (at < 0) | (doc[at] != doc[open_])
        to[open_[out]] = -1
        open_ = open_[~out]
        open_ = open_[values[to[open_]] > values[open_]]
        to[open_] = to[to[open_]]
    return to


@dataclass
class CompactWindows:
    """Nodes that span ``least`` tokens or more of one function's trees: left, centre, right (tokens of the batch),
    and the node of each run of ``least`` tokens that begins at ``starts``."""

    left: np.ndarray
    centre: np.ndarray
    right: np.ndarray
    node: np.ndarray


def compact_windows(words: Words, tokens: np.ndarray, starts: np.ndarray, function: int, config: PassageConfig, extents: bool = True) -> CompactWindows:
    """Of equal hashes, the left one is the parent."""
    low = token_hashes(tokens, function) >> np.uint64(32)
    packed = (low << np.uint64(32)) | np.arange(len(tokens), dtype=np.uint64)
    minima = sliding_min(packed, config.least)[starts]
    new = np.ones(len(minima), bool)
    new[1:] = minima[1:] != minima[:-1]
    value = minima[new]
    centre = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not extents:
        return CompactWindows(centre, centre, centre, np.cumsum(new) - 1)
    doc = words.doc[centre]
    before = next_lower(value, doc)
    after = len(value) - 1 - next_lower(value[::-1], doc[::-1])[::-1]
    left = np.where(before >= 0, centre[before] + 1, words.first_word[doc])
    right = np.where(after < len(value), centre[np.minimum(after, len(value) - 1)] - 1, words.first_word[doc + 1] - config.words)
    return CompactWindows(left, centre, right, np.cumsum(new) - 1)


def joint_windows(words: Words, config: PassageConfig, extents: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, signature, first word, last word, again) where a window of one function meets one of another.

    Words are counted in their text.  ``again``: the text has an equal row with the same tokens before.
    Without ``extents`` only the first two are right.
    """
    tokens = words.shingles(config.words)[0]
    span = config.least + config.words - 1
    count = len(words.doc) - span + 1
    starts = np.flatnonzero(words.doc[:count] == words.doc[span - 1 :]) if count > 0 else np.zeros(0, np.int64)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens, dtype=np.uint64)])
    out = []
    for number in range(config.signatures):
        a, b = (compact_windows(words, tokens, starts, 2 * number + j, config, extents) for j in range(2))
        of_a, of_b = tokens[a.centre][a.node], tokens[b.centre][b.node]
        new = np.ones(len(starts), bool)
        new[1:] = (of_a[1:] != of_a[:-1]) | (of_b[1:] != of_b[:-1]) | (starts[1:] != starts[:-1] + 1) | (words.doc[starts[1:]] != words.doc[starts[:-1]])
        first = np.flatnonzero(new)
        doc = words.doc[starts[first]]
        key = mix64(mix64(of_a[first] + np.uint64(number)) * np.uint64(31) + of_b[first])
        if not extents:
            out.append((doc, key.astype(np.int64), first, first, first > 0))
            continue
        last = np.append(first[1:], len(starts)) - 1
        low = np.maximum(a.left[a.node[first]], b.left[b.node[first]])
        high = np.minimum(a.right[a.node[last]], b.right[b.node[last]])
        place = mix64(key + mix64(doc.astype(np.uint64)))
        order = np.argsort(place, kind="stable")
        again = np.zeros(len(key), bool)
        body = sums[high + 1] - sums[low]
        again[order[1:]] = (place[order[1:]] == place[order[:-1]]) & (body[order[1:]] == body[order[:-1]])
        base = words.first_word[doc]
        out.append((doc, key.astype(np.int64), low - base, high + config.words - 1 - base, again))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.xxhash64("doc_id", text).alias("row"), text.cast("binary").alias("text"))


def signatures(documents: DataFrame, config: PassageConfig) -> DataFrame:
    """(key, row) of all rows, without their extents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, key = joint_windows(Words(*text_buffer(part.column("text")), lower=True), config, extents=False)[:2]
                row = part.column("row").to_numpy()[doc] if len(doc) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row)], ["key", "row"])

    return documents.select("row", "text").mapInArrow(run, "key long, row long")


def windows(documents: DataFrame, config: PassageConfig) -> DataFrame:
    """(key, row, span): span has the first word in its upper and the last in its lower half, and is negative for ``again``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, key, first, last, again = joint_windows(Words(*text_buffer(part.column("text")), lower=True), config)
                row = part.column("row").to_numpy()[doc] if len(doc) else np.zeros(0, np.int64)
                span = first << 32 | last
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.array(np.where(again, -1 - span, span))], ["key", "row", "span"])

    return documents.select("row", "text").mapInArrow(run, "key long, row long, span long")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping extents of a pair of texts become one."""
    for batch in batches:
        out: list[tuple[int, int, int, int, int, int]] = []
        for row, lead, spans in zip(batch.column("row").to_pylist(), batch.column("lead").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            open_: list[list[int]] = []
            for low, high, lead_low, lead_high in sorted((s["span"] >> 32, s["span"] & 0xFFFFFFFF, s["lead_span"] >> 32, s["lead_span"] & 0xFFFFFFFF) for s in spans):
                for x in open_:
                    if low <= x[1] and lead_low <= x[3] and lead_high >= x[2]:
                        x[1], x[2], x[3] = max(x[1], high), min(x[2], lead_low), max(x[3], lead_high)
                        break
                else:
                    out += [(row, lead, *x) for x in open_ if x[1] < low]
                    open_ = [x for x in open_ if x[1] >= low] + [[low, high, lead_low, lead_high]]
            out += [(row, lead, *x) for x in open_]
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "lead", "low", "high", "lead_low", "lead_high"])


def run_hashes(tokens: np.ndarray, least: int) -> np.ndarray:
    """A hash of the ``least`` tokens from each token on."""
    if len(tokens) < least:
        return np.zeros(0, np.uint64)
    values = mix64(tokens.astype(np.uint64))
    total = np.zeros(len(values) - least + 1, np.uint64)
    for j in range(least):
        total = total * np.uint64(0x9E3779B97F4A7C15) + values[j : j + len(total)]
    return total


def equal_runs(own: np.ndarray, lead: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, tokens, first in lead) of runs of ``least`` tokens or more that are equal in order; together they cover all such.

    For texts that repeat a few tokens over and over, where sets of tokens say little.
    """
    if min(len(own), len(lead)) < least:
        return []
    mine, theirs = run_hashes(own, least), run_hashes(lead, least)
    value, place = np.unique(theirs, return_index=True)
    at = np.minimum(np.searchsorted(value, mine), len(value) - 1)
    starts = np.flatnonzero(value[at] == mine)
    out, begin = [], 0
    while (next_ := int(np.searchsorted(starts, begin))) < len(starts):
        first = int(starts[next_])
        there = int(place[at[first]])
        n = min(len(own) - first, len(lead) - there)
        differ = np.flatnonzero(own[first : first + n] != lead[there : there + n])
        n = int(differ[0]) if len(differ) else n
        out.append((first, n, there))
        begin = first + max(1, n - least + 1)  # a run that goes on begins there at the earliest
    return out


def least_distinct(tokens: np.ndarray, least: int) -> int:
    """The fewest distinct tokens of any ``least`` in a row."""
    n = len(tokens)
    if n < least:
        return len(np.unique(tokens))
    order = np.argsort(tokens, kind="stable")
    before = np.full(n, -1)
    same = tokens[order[1:]] == tokens[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    # a token is new in the windows that begin after its last occurrence and at it at the latest
    at = np.arange(n)
    step = np.bincount(np.maximum(before + 1, at - least + 1).clip(0), minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
    return int(np.cumsum(step)[: n - least + 1].min())


def passages(own: np.ndarray, lead: np.ndarray, config: PassageConfig) -> list[tuple[int, int, int, int, float]]:
    """(first, tokens, first in lead, tokens in lead, similarity) of the passages two runs of tokens share.

    Runs of shared tokens are joined over gaps as long as the share of common
    tokens allows the similarity.
    """
    order = np.argsort(lead, kind="stable")
    ranked = lead[order]
    at = np.searchsorted(ranked, own)
    shared = np.append(ranked, np.uint32(0))[at] == own
    shared &= at < len(ranked)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], shared.astype(np.int8), [0]])))
    allowed = 2 * config.similarity / (1 + config.similarity)  # the share of a side that is common, at this similarity
    joined: list[list[tuple[int, int]]] = []
    common = 0
    for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if joined and (common + stop - first) >= allowed * (stop - joined[-1][0][0]):
            joined[-1].append((first, stop))
            common += stop - first
        else:
            joined.append([(first, stop)])
            common = stop - first
    out: list[tuple[int, int, int, int, float]] = []

    def take(runs: list[tuple[int, int]]) -> None:
        """The runs as one passage, or else in two parts, cut at the widest gap."""
        first, stop = runs[0][0], runs[-1][1]
        if stop - first < config.least:
            return
        here = np.arange(first, stop)[shared[first:stop]]
        # the leading text's side begins along the middle offset of the matches,
        # or (tokens may repeat) at the first place of one
        places, mine = order[at[here]], np.unique(own[first:stop])
        likeness, low, high = 0.0, 0, 0
        for begin in {max(0, first + int(np.median(places - here))), int(places.min()), max(0, int(places.max()) + first - stop + 1)}:
            end = min(len(lead), begin + stop - first)
            theirs = np.unique(lead[begin:end])
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            if (now := both / max(1, len(mine) + len(theirs) - both)) > likeness:
                likeness, low, high = now, begin, end
        if likeness >= config.similarity:
            out.append((first, stop - first, low, high - low, likeness))
        elif len(runs) > 1:
            gap = max(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1])
            take(runs[:gap])
            take(runs[gap:])
        else:
            out.extend((first + at_, n, place, n, 1.0) for at_, n, place in equal_runs(own[first:stop], lead, config.least))

    for runs in joined:
        take(runs)
    return out


def first_matches(x: list[tuple], y: list[tuple] | None, config: PassageConfig) -> list[tuple]:
    """For each row of two blocks (or of one), the passages it shares with the least row that shares any.

    Rows are (row, first word, tokens); results (row, lead row, first word,
    tokens, first word of the lead, tokens of the lead, similarity).  All pairs
    are compared by the number of common tokens, those with enough in full:
    as many as two passages of the fewest distinct tokens need.  Texts with
    fewer than ``dull`` distinct ones somewhere must share a run of equal tokens.
    """
    same, y = y is None, x if y is None else y
    ones = lambda sets: [(t, np.ones(len(t))) for t in sets]
    few = [np.array([least_distinct(r[2], config.least) for r in side]) for side in (x, y)]
    share = 2 * config.similarity / (1 + config.similarity)
    needed = np.maximum(1, np.ceil(share * np.minimum(few[0][:, None], few[1][None, :]) - 1e-9))
    enough = shared_weights(ones([np.unique(r[2]) for r in x]), ones([np.unique(r[2]) for r in y])) >= needed - 0.5
    # a few tokens over and over: any two such texts have enough in common, so these must share a run of equal tokens
    dull = [np.flatnonzero(f < config.dull) for f in few]
    enough[dull[0], :], enough[:, dull[1]] = False, False
    if len(dull[0]) and len(dull[1]):
        runs = [ones([np.unique(run_hashes(side[i][2], config.least)) for i in at]) for side, at in zip((x, y), dull, strict=True)]
        enough[np.ix_(*dull)] = shared_weights(*runs) > 0.5
    maybe: dict[int, list[tuple]] = {}
    for i, j in np.argwhere(enough).tolist():
        if (same and j <= i) or x[i][0] == y[j][0]:
            continue
        lead, own = sorted((x[i], y[j]), key=lambda r: (r[0], r[1]))
        maybe.setdefault(id(own), [own]).append(lead)
    out = []
    for own, *leads in maybe.values():
        done = None
        for lead in sorted(leads, key=lambda r: (r[0], r[1])):
            if done is not None and lead[0] != done:
                break
            for first, n, lead_first, lead_n, likeness in passages(own[2], lead[2], config):
                out.append((own[0], lead[0], own[1] + first, n, lead[1] + lead_first, lead_n, likeness))
                done = lead[0]
    return out


_FOUND = "first_word long, n_words long, lead_first_word long, lead_n_words long, similarity double"


def shared_passages(documents: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """One row for each passage of a document that a leading document has too.

    Columns: row, doc_id, lead_row, lead_doc_id, first_word, n_words,
    lead_first_word, lead_n_words, similarity.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = _rows(documents)
    found = windows(rows, config)
    k, pad = config.words, config.least_words
    several = lambda df: df.groupBy("key").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least <> most")
    ends = written(several(signatures(rows, config)).select("key", "least"))
    again = F.col("span") < 0
    span = F.when(again, -1 - F.col("span")).otherwise(F.col("span"))
    open_ = written(found.join(ends, "key").select("key", "row", span.alias("span"), again.alias("again"), "least"))
    wanted = written(open_.select("row").distinct())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(*text_buffer(part.column("text")), lower=True)
                tokens = (words.shingles(k)[0] >> np.uint64(32)).astype(np.uint32)
                cells = [tokens[a : max(a, b - k + 1)].tobytes() for a, b in zip(words.first_word[:-1].tolist(), words.first_word[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(cells, pa.binary())], ["row", "doc_id", "tokens"])

    # dealt by row once; the joins on row below read the buckets and shuffle no texts
    read_rows = maybe_in(rows, "row", wanted).mapInArrow(read, f"row long, doc_id {kind}, tokens binary")
    texts, drop_texts = bucketed(read_rows, "row", lambda dealt: dealt.join(wanted, "row", "left_semi").dropDuplicates(["row"]))

    def piece(tokens: str, low: str, high: str):
        return F.substring(tokens, F.col(low).cast("int") * 4 + 1, (F.col(high) - F.col(low) + (2 - k)).cast("int") * 4)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, got, inside = [], [], []
            own, other = batch.column("own_tokens").to_pylist(), batch.column("lead_tokens").to_pylist()
            low, lead_low, ext_low, ext_high = (batch.column(c).to_pylist() for c in ("from", "lead_from", "low", "high"))
            for i in range(batch.num_rows):
                for first, n, lead_first, lead_n, likeness in passages(np.frombuffer(own[i], np.uint32), np.frombuffer(other[i], np.uint32), config):
                    take.append(i)
                    begin, size = low[i] + first, n + k - 1
                    got.append((begin, size, lead_low[i] + lead_first, lead_n + k - 1, likeness))
                    inside.append(2 * (min(begin + size - 1, ext_high[i]) - max(begin, ext_low[i]) + 1) >= config.least_words)
            columns = list(zip(*got, strict=True)) or [()] * 5
            names = ["first_word", "n_words", "lead_first_word", "lead_n_words", "similarity"]
            same = [batch.column(c).take(pa.array(take, pa.int64())) for c in ("row", "doc_id", "lead", "lead_doc_id", "low", "high")]
            cells = [*same, pa.array(inside, pa.bool_()), *[pa.array(c, pa.int64() if n != "similarity" else pa.float64()) for n, c in zip(names, columns, strict=True)]]
            yield pa.RecordBatch.from_arrays(cells, ["row", "doc_id", "lead_row", "lead_doc_id", "low", "high", "inside", *names])

    out = []
    for _ in range(config.rounds):
        # a leading text that repeats itself counts once for each context
        leads = open_.where("row = least and not again").select("key", F.col("span").alias("lead_span"))
        met = open_.where("row <> least").select("key", "row", "span", "least", "again")
        pairs = met.join(leads, "key").groupBy("row", F.col("least").alias("lead")).agg(F.collect_set(F.struct("span", "lead_span")).alias("spans"))
        pairs = written(pairs.mapInArrow(_merge, "row long, lead long, low long, high long, lead_low long, lead_high long"))
        # with the words around them, as a passage may begin or end with words that no agreeing window holds
        wide = pairs.withColumns({"from": F.greatest(F.col("low") - pad, F.lit(0)), "lead_from": F.greatest(F.col("lead_low") - pad, F.lit(0)), "to": F.col("high") + pad, "lead_to": F.col("lead_high") + pad})
        leads = written(texts.join(pairs.select(F.col("lead").alias("row")).distinct(), "row", "left_semi"))
        leads = leads.select(F.col("row").alias("lead"), F.col("doc_id").alias("lead_doc_id"), F.col("tokens").alias("lead_all"))
        one = wide.join(leads, "lead").withColumn("lead_tokens", piece("lead_all", "lead_from", "lead_to")).drop("lead_all")
        both = one.join(texts, "row").withColumn("own_tokens", piece("tokens", "from", "to")).drop("tokens")
        both = both.select("row", "doc_id", "lead", "lead_doc_id", "low", "high", "from", "lead_from", "own_tokens", "lead_tokens")
        got = written(both.mapInArrow(verify, f"row long, doc_id {kind}, lead_row long, lead_doc_id {kind}, low long, high long, inside boolean, {_FOUND}"))
        out.append(got.drop("low", "high", "inside"))
        solved = got.where("inside").select(F.col("row").alias("_row"), "lead_row", "low", "high").distinct()
        here = (F.col("row") == F.col("_row")) & (F.col("least") == F.col("lead_row")) & (F.shiftright("span", 32) >= F.col("low")) & (F.col("span").bitwiseAND(0xFFFFFFFF) <= F.col("high"))
        rest = written(met.join(solved, here, "left_anti").drop("least"))
        open_ = written(rest.join(several(rest).select("key", "least"), "key"))

    # blocks of a signature's rows that are still open; all pairs of blocks are compared
    keys = open_.groupBy("key").agg(F.ceil(F.count("*") / F.lit(config.block)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    dealt = open_.where("not again").join(keys, "key").withColumn("own", mine)
    dealt = dealt.select("key", "row", "span", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    task = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1)
    begin, end = F.shiftright("span", 32), F.col("span").bitwiseAND(0xFFFFFFFF)
    dealt = dealt.select(task.alias("task"), side.alias("side"), "row", F.greatest(begin - pad, F.lit(0)).alias("from"), (end + pad).alias("to"))
    ready = dealt.join(texts, "row").withColumn("own_tokens", piece("tokens", "from", "to")).select("task", "side", "row", "doc_id", "from", "own_tokens")

    def compare(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        ids = {}
        for s, row, doc, low, tokens in zip(*[table.column(c).to_pylist() for c in ("side", "row", "doc_id", "from", "own_tokens")], strict=True):
            sides[s].append((row, low, np.frombuffer(tokens, np.uint32)))
            ids[row] = doc
        got = first_matches(sides[0], sides[1] or None, config) if sides[0] else []
        cells = list(zip(*got, strict=True)) or [()] * 7
        arrays = [pa.array(cells[0], pa.int64()), pa.array([ids[r] for r in cells[0]], table.schema.field("doc_id").type), pa.array(cells[1], pa.int64()), pa.array([ids[r] for r in cells[1]], table.schema.field("doc_id").type)]
        arrays += [pa.array(cells[2], pa.int64()), pa.array([n + k - 1 for n in cells[3]], pa.int64()), pa.array(cells[4], pa.int64()), pa.array([n + k - 1 for n in cells[5]], pa.int64()), pa.array(cells[6], pa.float64())]
        return pa.table(arrays, ["row", "doc_id", "lead_row", "lead_doc_id", "first_word", "n_words", "lead_first_word", "lead_n_words", "similarity"])

    out.append(ready.groupBy("task").applyInArrow(compare, f"row long, doc_id {kind}, lead_row long, lead_doc_id {kind}, {_FOUND}"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    whole = written(whole.dropDuplicates(["row", "lead_row", "first_word", "n_words"]))
    drop_texts()
    return whole


def cut_words(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """The text without the given (first, count) words and the white space after each."""
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64))
    starts = np.append(words.starts, len(text)).tolist()
    out, at = [], 0
    for first, count in sorted(cuts):
        begin, end = starts[first], starts[min(first + count, len(starts) - 1)]
        if end > at:
            out.append(text[at : max(at, begin)])
            at = end
    return b"".join([*out, text[at:]])


def without_repeats(documents: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """The documents, their repeated passages left in the leading document alone.

    All rows stay; ``n_chars``, if there is such a column, is counted anew.
    """
    documents, back = set_aside(documents)
    names = list(documents.columns)
    cuts = shared_passages(documents, config).groupBy(F.col("row").alias("_cut_row")).agg(F.collect_set(F.struct("first_word", "n_words")).alias("_cuts"))
    cuts = written(cuts)
    keyed = documents.withColumn("_row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    cut_rows = cuts.select("_cut_row")
    maybe = maybe_in(keyed, "_row", cut_rows).join(cuts, F.col("_row") == F.col("_cut_row"), "left").select(*names, "_cuts")
    whole = maybe_in(keyed, "_row", cut_rows, there=False).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(t.encode(), [(c["first_word"], c["n_words"]) for c in cuts]).decode() if cuts else t for t, cuts in zip(batch.column("text").to_pylist(), batch.column("_cuts").to_pylist(), strict=True)]
            sizes = [len(t) if cut else n for t, cut, n in zip(texts, batch.column("_cuts").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)] if "n_chars" in names else []
            changed = {"text": texts, "n_chars": sizes}
            yield pa.RecordBatch.from_arrays([pa.array(changed[n], batch.column(n).type) if n in changed else batch.column(n) for n in names], names)

    return back(whole.unionByName(maybe.mapInArrow(run, documents.schema)))
