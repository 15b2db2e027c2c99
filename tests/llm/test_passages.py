import random

import numpy as np
import pyarrow as pa
from conftest import documents, prose

from voxelframe.llm import substring
from voxelframe.llm.textbatch import Words, text_buffer

CONFIG = substring.PassageConfig()


def tree_windows(values, least):
    """(left, centre, right) of the tree's nodes of ``least`` tokens or more, by definition; of equal values the left one is the parent."""
    out = []
    for centre, value in enumerate(values):
        left = right = centre
        while left and values[left - 1] > value:
            left -= 1
        while right + 1 < len(values) and values[right + 1] >= value:
            right += 1
        if right - left + 1 >= least:
            out.append((left, centre, right))
    return out


def test_compact_windows_are_the_wide_nodes_of_the_tree():
    config = substring.PassageConfig(words=1, least_words=6)
    for seed in range(40):
        texts = [prose(seed * 3 + i, 5 + 9 * (seed + i) % 60) for i in range(3)]
        words = Words(*text_buffer(pa.array(texts)), lower=True)
        tokens = words.shingles(1)[0]
        starts = np.flatnonzero(words.doc[: len(tokens) - 5] == words.doc[5:])
        got = substring.compact_windows(words, tokens, starts, seed, config) if len(starts) else None
        want = []
        for d in range(3):
            base, stop = words.first_word[d], words.first_word[d + 1]
            values = (substring.token_hashes(tokens[base:stop], seed) >> np.uint64(32)).tolist()
            want += [(base + a, base + c, base + b) for a, c, b in tree_windows(values, 6)]
        if got is None:
            assert not want
            continue
        assert list(zip(got.left.tolist(), got.centre.tolist(), got.right.tolist(), strict=True)) == sorted(want, key=lambda w: w[1])
        for start, node in zip(starts.tolist(), got.node.tolist(), strict=True):
            assert got.left[node] <= start <= got.centre[node] <= start + 5 <= got.right[node]


def test_rows_intersect_the_windows_of_two_functions():
    words = Words(*text_buffer(pa.array([prose(1, 300), prose(2, 20), prose(3, 150)])), lower=True)
    doc, key, first, last, again = substring.joint_windows(words, CONFIG)
    tokens = words.shingles(5)[0]
    want = set()
    for d in range(3):
        own = tokens[words.first_word[d] : max(words.first_word[d], words.first_word[d + 1] - 4)]
        for number in range(CONFIG.signatures):
            trees = [tree_windows((substring.token_hashes(own, 2 * number + j) >> np.uint64(32)).tolist(), CONFIG.least) for j in range(2)]
            for a in trees[0]:
                for b in trees[1]:
                    low, high = max(a[0], b[0]), min(a[2], b[2])
                    if low <= min(a[1], b[1]) and max(a[1], b[1]) <= high and high - low + 1 >= CONFIG.least > abs(a[1] - b[1]):
                        want.add((d, low, high + 4))
    assert set(zip(doc.tolist(), first.tolist(), last.tolist(), strict=True)) == want
    assert not again.any()


def test_repeats_within_a_text_are_marked():
    part = prose(4, 200)
    doc, key, first, last, again = substring.joint_windows(Words(*text_buffer(pa.array([f"{part} {part} {part}"])), lower=True), CONFIG)
    assert again.any() and not again.all()
    assert set(key[again].tolist()) <= set(key[~again].tolist())


def common_runs(a, b, least):
    """Whether two lists of words share ``least`` words in a row."""
    runs = {tuple(a[i : i + least]) for i in range(len(a) - least + 1)}
    return any(tuple(b[i : i + least]) in runs for i in range(len(b) - least + 1))


def random_corpus(seed, texts=70):
    """Texts of passages that several share, edited or not, among lines that very many share."""
    rng = random.Random(seed)
    bank, line = [prose(seed * 100 + i, rng.randint(50, 130), "x") for i in range(12)], prose(seed * 100 + 50, 22, "y")
    rows = []
    for i in range(texts):
        parts = [prose(seed * 1000 + i, rng.randint(5, 40), "z")]
        for p in rng.sample(bank, rng.randint(0, 2)):
            words = p.split()
            for _ in range(rng.choice([0, 0, len(words) // 40])):
                words[rng.randrange(len(words))] = f"edit{i}"
            parts += [line if rng.random() < 0.8 else "", " ".join(words), prose(seed * 2000 + i * 7 + len(parts), rng.randint(3, 30), "z")]
        rows.append((i, " ".join(parts), None, None))
    return rows


def test_all_pairs_by_brute_force(spark):
    """Texts that share 50 words in a row end in one group; no pair is reported that shares no such passage."""
    config = substring.PassageConfig(block=8)  # several blocks for each signature
    for seed in (1, 2):
        rows = random_corpus(seed)
        words = {i: t.lower().split() for i, t, _, _ in rows}
        got = substring.shared_passages(documents(spark, rows), config).collect()
        parent = {i: i for i in words}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in got:
            a = words[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]]
            b = words[r["lead_doc_id"]][r["lead_first_word"] : r["lead_first_word"] + r["lead_n_words"]]
            x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
            assert len(a) >= 50 and len(x & y) / len(x | y) >= 0.8 - 1e-9
            assert abs(len(x & y) / len(x | y) - r["similarity"]) < 1e-9
            parent[find(r["doc_id"])] = find(r["lead_doc_id"])
        for i in words:
            for j in range(i):
                if common_runs(words[i], words[j], 50):
                    assert find(i) == find(j), (seed, i, j)


def test_passages_at_the_limit_are_found_whole(spark):
    """Pairs with edited passages of a similarity of 0.8 to 0.85: at least 97 % are found, 95 % whole."""
    rng, rows, sizes = random.Random(9), [], {}
    for n in range(150):
        length, edits = ((60, 1), (100, 2), (150, 3))[n % 3]
        words = prose(5000 + n, length, "p").split()
        other = list(words)
        for e in range(edits):
            other[rng.randrange(e * length // edits + 8, (e + 1) * length // edits - 8)] = "changed"
        rows.append((2 * n, f"{prose(6000 + n, 60, 'q')} {' '.join(words)} {prose(7000 + n, 60, 'r')}", None, None))
        rows.append((2 * n + 1, f"{prose(8000 + n, 90, 's')} {' '.join(other)} {prose(9000 + n, 30, 't')}", None, None))
        sizes[n] = length
    best: dict[int, int] = {}
    for r in substring.shared_passages(documents(spark, rows)).collect():
        assert r["doc_id"] // 2 == r["lead_doc_id"] // 2
        best[r["doc_id"] // 2] = max(best.get(r["doc_id"] // 2, 0), r["n_words"])
    assert len(best) >= 0.97 * len(sizes)
    assert sum(best.get(n, 0) >= size - 2 for n, size in sizes.items()) >= 0.95 * len(sizes)


def test_planted_passages_are_found_and_the_rest_left_alone(spark):
    shared = [prose(1000 + i, 60 + 10 * i) for i in range(4)]
    rows = []
    for i in range(60):
        text = prose(i, 80 + i)
        if i % 3 == 0:
            text = f"{prose(300 + i, 30)} {shared[i % 4].title() if i % 2 else shared[i % 4]} {text}"
        rows.append((i, text, None, None))
    got = substring.shared_passages(documents(spark, rows)).collect()
    texts = {i: t.lower().split() for i, t, _, _ in rows}
    holders = {p: [i for i in range(0, 60, 3) if i % 4 == p] for p in range(4)}
    for p, members in holders.items():
        passage = shared[p].split()
        covered = set()
        for r in got:
            if r["doc_id"] in members:
                assert r["lead_doc_id"] in members
                piece = texts[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]]
                other = texts[r["lead_doc_id"]][r["lead_first_word"] : r["lead_first_word"] + r["lead_n_words"]]
                assert r["n_words"] >= 50 and r["similarity"] >= 0.8
                assert len(set(piece) & set(other)) >= 0.75 * len(set(piece))
                if sum(w in set(passage) for w in piece) >= len(passage) - 4:
                    covered.add(r["doc_id"])
        assert len(covered) == len(members) - 1
    assert {r["doc_id"] for r in got} | {r["lead_doc_id"] for r in got} == set(range(0, 60, 3))


def test_near_passages(spark):
    base = prose(5, 120).split()
    other = list(base)
    other[60] = "changed"
    rows = [(1, prose(6, 70) + " " + " ".join(base), None, None), (2, " ".join(other) + " " + prose(7, 50), None, None)]
    got = substring.shared_passages(documents(spark, rows)).collect()
    assert len(got) == 1 and got[0]["n_words"] == 120 and 0.8 <= got[0]["similarity"] < 1


def test_short_repeats_do_not_count(spark):
    line = prose(8, 40)
    rows = [(i, f"{prose(i, 60)} {line} {prose(50 + i, 60)}", None, None) for i in range(20)]
    assert substring.shared_passages(documents(spark, rows)).count() == 0


def test_cut_words():
    assert substring.cut_words(b" a  b\nc d ", [(1, 2)]) == b" a  d "
    assert substring.cut_words(b"a b c d", [(0, 2), (1, 2)]) == b"d"
    assert substring.cut_words(b"a b", [(0, 2)]) == b""
    assert substring.cut_words("é à ü".encode(), [(2, 1)]) == "é à ".encode()


def test_one_copy_of_a_passage_stays(spark):
    shared = prose(77, 90)
    rows = [(i, f"{prose(i, 60)} {shared} {prose(40 + i, 50)}", "en", "a") for i in range(12)] + [(50, prose(200, 100), "en", "a")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in substring.without_repeats(docs).collect()}
    assert len(got) == 13 and got[50]["text"] == rows[-1][1]
    assert sum(shared in r["text"] for r in got.values()) == 1
    for i, text, _, _ in rows[:-1]:
        assert got[i]["text"] in (text, f"{prose(i, 60)} {prose(40 + i, 50)}")
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_edges(spark, edge, edge_rows, none_at_all):
    got = substring.shared_passages(edge).collect()
    assert {(r["doc_id"], r["lead_doc_id"]) for r in got} <= {(1, 2), (2, 1)} and len(got) == 1
    cut = substring.without_repeats(edge)
    assert cut.schema == edge.schema and cut.count() == len(edge_rows)
    assert substring.shared_passages(none_at_all).count() == 0 and substring.without_repeats(none_at_all).count() == 0


def test_fewest_distinct_tokens():
    rng = np.random.default_rng(2)
    for n in (3, 9, 40):
        tokens = rng.integers(0, 5, n).astype(np.uint32)
        want = min(len(set(tokens[i : i + 6].tolist())) for i in range(max(1, n - 5)))
        assert substring.least_distinct(tokens, 6) == want


def test_equal_runs_cover_all_equal_windows():
    rng = np.random.default_rng(3)
    for _ in range(60):
        own, lead = (rng.integers(0, 2, rng.integers(5, 60)).astype(np.uint32) for _ in range(2))
        got = substring.equal_runs(own, lead, 6)
        theirs = {tuple(lead[i : i + 6]) for i in range(len(lead) - 5)}
        covered = set()
        for first, n, there in got:
            assert n >= 6 and (own[first : first + n] == lead[there : there + n]).all()
            covered |= set(range(first, first + n - 5))
        assert covered == {i for i in range(len(own) - 5) if tuple(own[i : i + 6]) in theirs}


def test_texts_that_repeat_a_word_over_and_over(spark):
    """Runs of one word, of different lengths and in different orders, are cut down to one text."""
    parts = {"a": "of " * 130, "b": "that " * 200, "c": "and so " * 90}
    rows = [(i, f"{prose(i, 40)} " + f" {prose(100 + i, 9)} ".join(parts[x] for x in order), None, None) for i, order in enumerate(["abc", "cab", "ba", "ca", "b", "bc"])]
    for config in (substring.PassageConfig(), substring.PassageConfig(rounds=0)):
        texts = [r["text"].split() for r in substring.without_repeats(documents(spark, rows), config).collect()]
        for i, a in enumerate(texts):
            assert not any(common_runs(a, b, 52) for b in texts[:i])
