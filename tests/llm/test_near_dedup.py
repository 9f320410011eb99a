import random

import numpy as np
import pytest

from stackwave.llm import near_dedup
from stackwave.llm.near_dedup import near_duplicates, sketch
from stackwave.llm.textkit import Words, mix64, shingle_sets, string_buffers

from .cases import EN, WORD, frame, odd_rows, row, sentence


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, threshold=85):
    """Component of each row by its text, over all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


def found(spark, rows):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect()), key=str)


def copies(n, seed=1):
    """Near copies of a few texts, with chains of links."""
    chance = random.Random(seed)
    bases = [sentence(chance, [f"w{chance.randrange(4000)}" for _ in range(300)], chance.randrange(6, 220)) for _ in range(6)]
    rows = []
    for k in range(n):
        words = chance.choice(bases).split()
        for _ in range(chance.choice([0, 0, 1, 1, 2, 4])):
            words[chance.randrange(len(words))] = f"x{chance.randrange(10**6)}"
        rows.append(row(1000 - k, " ".join(words)))
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert by[1, 0]["component_id"] == 1 and by[2, 0]["kept"] and by[3, 0]["component_id"] == 3
    assert by[5, 1]["component_id"] == 4 and not by[5, 1]["kept"]
    assert [r["component_id"] for r in got if r["doc_id"] == 8] == [7]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(7, False)]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_against_all_pairs(spark):
    rows = copies(160)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_blocks_lose_no_link(spark, monkeypatch, seed):
    """Groups of more than eight classes are dealt out in blocks, first with two centres, then between the parts that are left."""
    rows = copies(120, seed=seed)
    want = brute(rows)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "CENTRES", 2)
    assert found(spark, rows) == want


def test_between_parts_compares_what_is_left(spark, monkeypatch):
    """A base and texts that are each like the base only: what the first round can't link, the second does."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "CENTRES", 1)
    chance = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = [row(50, " ".join(words))]
    for k in range(40):
        changed = list(words)
        for at in chance.sample(range(0, 400, 10), 6):
            changed[at] = f"y{k}_{at}"
        rows.append(row(k, " ".join(changed)))
    assert {c for _, _, c in brute(rows)} == {0}
    assert found(spark, rows) == brute(rows)


def test_repeated_and_null_ids(spark):
    """Different texts under one id are different nodes; equal rows and copies without an id leave one row."""
    chance = random.Random(21)
    a, b, c, d = (sentence(chance, [f"v{k}" for k in range(500)], 60) for _ in range(4))
    rows = [row(1, a), row(5, a + " tail"), row(5, b), row(7, b + " end"), row(9, c), row(9, c), row(None, d), row(None, d), row(None, d + " more"), row(None, ""), row(None, None), row(3, d[:40])]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)
    kept = near_dedup.unique(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    one = [x for x in got if x[1] and x[1].startswith(d)]
    assert len(one) == 1 and sorted((x for x in got if x not in one), key=str) == sorted([(1, a), (5, b), (9, c), (None, ""), (None, None), (3, d[:40])], key=str)


@pytest.mark.parametrize("threshold", [80, 85])
def test_unique_leaves_one_row_of_each_component(spark, threshold):
    rows = copies(100, seed=9) + odd_rows()
    kept = [tuple(r)[:2] for r in near_dedup.unique(frame(spark, rows), threshold=threshold).collect()]
    sets = {t: shingles(t) for _, t in kept}
    assert len([t for _, t in kept if sets[t]]) == len({frozenset(sets[t]) for _, t in kept if sets[t]})
    parts = {c for _, n, c in brute(rows, threshold) if n}
    assert len([t for _, t in kept if sets[t]]) >= len(parts) and {k for k, t in kept if sets[t]} >= parts - {None}


@pytest.mark.parametrize("text", ["a", "A b\tC", " lead and trail ", "é É x"])
def test_words_hash_by_lower_ascii(text):
    import pyarrow as pa

    raw, offs = string_buffers(pa.array([text, text.replace("A", "a").replace("C", "c")]))
    w = Words(raw, offs)
    n = len(WORD.findall(text))
    assert w.counts.tolist() == [n, n] and w.hash[:n].tolist() == w.hash[n:].tolist()


def test_sketch_estimates_similarity():
    chance = np.random.default_rng(2)
    for size in (8, 40, 300, 5000):
        gaps = []
        for _ in range(30):
            a = mix64(chance.integers(0, 2**63, size).astype(np.uint64))
            n = max(1, size // 10)
            b = np.concatenate([a[n:], mix64(chance.integers(0, 2**63, n).astype(np.uint64))])
            j = (size - n) / (size + n)
            gaps.append((sketch(np.sort(a)) == sketch(np.sort(b))).mean() - j)
        assert abs(np.mean(gaps)) < 0.06


def test_shingle_counts(spark):
    import pyarrow as pa

    chance = random.Random(9)
    texts = [sentence(chance, EN[:4], n) for n in (0, 1, 4, 5, 6, 50, 400)] + [None]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]
