import re
from collections import Counter

import numpy as np
import pytest
from conftest import documents, prose

from voxelframe.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, repeated = len(words), len(marked)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeated, n < 50 or 100 * repeated > 50 * n)


def rows_of(spark, texts):
    return documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])


def test_counts_against_brute_force(spark):
    texts = [prose(i, 40 + i) for i in range(20)]
    texts += ["a b c a b c d", "x\nx\n\n x\nx\r\nx\r\n \n \n", "é à é à é à é", "# * | <>& $%", "same line here\n" * 30, "a\n" * 100, "To To To To", "one\ntwo\none\ntwo"]
    docs = rows_of(spark, texts)
    got = {r["doc_id"]: r for r in quality.with_quality(docs, ["doc_id"], quality.learn_references(docs)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), text[:50]
        assert not (r["kept"] and r["base_failed"])


def test_distance_against_the_formula():
    p, q = np.array([[1.0, 3.0, 0.0]]), np.array([0.5, 0.25, 0.25])
    a = p[0] / 4
    m = (a + q) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m, strict=True) if v)
    assert quality.js_distance(p, q)[0] == pytest.approx(np.sqrt((kl(a) + kl(q)) / 2))
    assert quality.js_distance(q[None], q)[0] == pytest.approx(0, abs=1e-7)


def test_odd_texts_go_and_clean_ones_stay(spark):
    clean = [prose(i, 120) for i in range(60)]
    odd = [prose(100, 120).upper(), " ".join(w + "###$$$" for w in prose(101, 120).split()), prose(102, 120, stem="zz") .replace("zz", "9")]
    docs = rows_of(spark, clean + odd)
    kept = {r["doc_id"] for r in quality.reject_low_quality(docs).collect()}
    assert kept == set(range(60))


def test_short_texts_are_not_judged_by_histograms():
    rules = quality.QualityRules(min_words=0, judge_from_words=50)
    references = quality.References(("x",), np.eye(quality.CLASSES)[:1], (np.array([5]),), (np.array([1.0, 0.0]),))
    import pyarrow as pa

    got = quality.measure(pa.array(["ABC " * 3, "ABC DEF GHI JKL " * 20]), references, rules)
    assert got["kept"].tolist() == [True, False]


def test_edges(spark, edge, edge_rows, none_at_all):
    references = quality.learn_references(edge)
    got = quality.with_quality(edge, ["doc_id"], references).collect()
    assert len(got) == len(edge_rows)
    assert {r["n_words"] for r in got if r["doc_id"] == 3} == {0}
    kept = quality.reject_low_quality(edge)
    assert kept.columns == edge.columns and kept.schema == edge.schema
    assert quality.reject_low_quality(none_at_all).count() == 0
    assert quality.learn_references(none_at_all).names == ()


def test_verdicts_against_brute_force(spark):
    """``kept`` again from texts alone: references, histograms, distances and limits."""
    texts = [prose(i, 45 + i) for i in range(50)] + [prose(200 + i, 70).upper() for i in range(3)] + [" ".join("$" + w for w in prose(300, 90).split())]
    docs = documents(spark, [(i, t, "en" if i % 2 else "fr", "a") for i, t in enumerate(texts)])
    rules = quality.QualityRules(common_words=8, judge_from_words=60)
    got = {r["doc_id"]: r for r in quality.with_quality(docs, ["doc_id"], quality.learn_references(docs, rules), rules).collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in enumerate(texts)}
    kinds = quality.byte_classes()
    classes = {i: np.bincount(kinds[np.frombuffer(t.encode(), np.uint8)], minlength=10)[: quality.CLASSES].astype(float) for i, t in enumerate(texts)}

    def distance(p, q):
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return np.sqrt(max(0.0, (kl(p) + kl(q)) / 2))

    from voxelframe.llm.textbatch import Words, text_buffer
    import pyarrow as pa

    key = {w: int(Words(*text_buffer(pa.array([w]))).hash[0] >> np.uint64(8)) for ws in words.values() for w in ws}  # ties go by hash
    near = {i: [1.0, 1.0] for i in words}
    for parity in (0, 1):
        own = [i for i in words if i % 2 == parity]
        counts = Counter(w for i in own for w in words[i])
        common = sorted(counts, key=lambda w: (-counts[w], key[w]))[:8]
        of_words = np.array([counts[w] for w in common] + [sum(counts.values()) - sum(counts[w] for w in common)], float)
        of_classes = sum(classes[i] for i in own)
        for i, ws in words.items():
            mine = Counter(w if w in common else None for w in ws)
            near[i][0] = min(near[i][0], distance(classes[i], of_classes))
            near[i][1] = min(near[i][1], distance(np.array([mine[w] for w in common] + [mine[None]], float), of_words))
    for i, text in enumerate(texts):
        assert (got[i]["class_distance"], got[i]["word_distance"]) == pytest.approx(near[i], abs=1e-6)
        odd = len(words[i]) >= 60 and (near[i][0] > rules.class_distance or near[i][1] > rules.word_distance)
        assert got[i]["kept"] == (not brute(text)[-1] and not odd)
    assert 0 < sum(r["kept"] for r in got.values()) < len(texts)
