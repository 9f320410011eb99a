import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwave.llm import mixing, sharding, topk
from stackwave.llm.queries import QUERIES

from ..compare import connection
from .cases import EN, WORD, frame, odd_rows, row, sentence


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score long")


@pytest.mark.parametrize("bounds", [1 << 20, 0])
def test_top_k_against_brute_force(spark, monkeypatch, bounds):
    """By chunks' bounds, and, as if they were too many, with every block at every chunk."""
    monkeypatch.setattr(topk, "BOUND_BYTES", bounds)
    chance = np.random.default_rng(3)
    x = chance.normal(0, 0.3, (900, 24)).astype(np.float32)
    x[200:400] = x[100]  # ties
    rows = [(k, x[k].tolist(), 1, 2) for k in range(len(x))]
    rows += [(5000, None, 1, 2), (5100, [float("nan")] * 24, 1, 2), (5200, [None] + [0.0] * 23, 1, 2), (5300, [float("inf")] * 24, 1, 2), (5400, [0.5] * 3, 1, 2), (5401, [1.0] * 3, 1, 2), (None, [0.1] * 24, 1, 2), (5500, [], 1, 2)]
    monkeypatch.setattr(topk, "CHUNK", 150)
    monkeypatch.setattr(topk, "QUERIES", 4)
    table = vectors(spark, rows)
    got = defaultdict(list)
    for r in topk.top_k(table, table.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(x.astype(float) * 1024).astype(np.int64)
    for k in range(0, 900, 100):
        s = q @ q[k]
        best = [j for j in np.lexsort((np.arange(900), -s)) if j != k][:10]
        assert got[k] == [(n + 1, j, s[j]) for n, j in enumerate(best)]
    assert got[5400] == [(1, 5401, 512 * 1024 * 3)] and set(got) == {*range(0, 900, 100), 5400}
    none = table.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_blocks_meet_few_chunks(spark, monkeypatch):
    """Vectors of clusters: a block of one cluster's queries doesn't meet the chunks of others, and nothing is lost."""
    chance = np.random.default_rng(9)
    centres = chance.normal(0, 1, (6, 32))
    x = (centres[np.repeat(np.arange(6), 150)] + chance.normal(0, 0.02, (900, 32))).astype(np.float32)
    x = x[chance.permutation(900)]
    monkeypatch.setattr(topk, "CHUNK", 50)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "NEAREST", 2)
    met, best = [], topk._routes

    def watched(chunks, again):
        met.append((again, sum(len(p) for p, _ in chunks.values())))
        return best(chunks, again)

    monkeypatch.setattr(topk, "_routes", watched)
    table = vectors(spark, [(k, x[k].tolist(), 1, 2) for k in range(900)])
    got = defaultdict(list)
    for r in topk.top_k(table, table.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = np.floor(x.astype(float) * 1024).astype(np.int64)
    for k in range(0, 900, 100):
        s = q @ q[k]
        want = [j for j in np.lexsort((np.arange(900), -s)) if j != k][:10]
        assert got[k] == [(j, s[j]) for j in want]
    assert [again for again, _ in met] == [False, True] and met[0][1] >= 18


def test_bounds_of_chunks_hold():
    chance = np.random.default_rng(10)
    v, q = chance.integers(-900, 900, (400, 40)), chance.integers(-900, 900, (30, 40))
    stats = topk._statistics(v.astype(float), 16)
    bounds = np.concatenate([stats[:, :16].min(0), stats[:, :16].max(0), stats[:, 16:].max(0)])[None]
    assert (topk._bounds_of(q, bounds)[:, 0] >= (q @ v.T).max(1)).all()


def test_top_k_of_long_and_large_vectors(spark):
    """Components beyond 32 bits, long vectors, and ids that repeat."""
    rows = [(k, [(-1.0) ** k * 2.2e6, float(k % 7)], 1, 2) for k in range(40)] + [(100 + k, [0.001 * ((j * k) % 11) for j in range(3000)], 1, 2) for k in range(30)] + [(5, [1e6, 3.0], 1, 2)]
    got = defaultdict(list)
    table = vectors(spark, rows)
    for r in topk.top_k(table, table.filter("vec_id in (0, 100)")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for own in (0, 100):
        q = {k: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for k, v, *_ in rows if len(v) == len(rows[0 if own == 0 else 40][1])}
        every = [(k, v) for k, v, *_ in rows if len(v) == len(q[own])]
        s = sorted((-sum(a * int(np.floor(1024 * float(np.float32(b)))) for a, b in zip(q[own], v, strict=True)), k) for k, v in every if k != own)[:10]
        assert got[own] == [(k, -x) for x, k in s]


def test_bounds_never_lose_a_neighbour():
    chance = np.random.default_rng(4)
    v = chance.integers(-500, 500, (3000, 50))
    v[:, :25] += 400
    q = v[:20]
    for x, ids, scores in topk.best(q, np.arange(20), v, np.arange(3000), 10):
        s = v @ q[x]
        s[x] = -(10**12)
        want = np.lexsort((np.arange(3000), -s))[:10]
        assert ids.tolist() == want.tolist() and scores.tolist() == s[want].tolist()


def documents(n=400):
    chance = random.Random(2)
    return [row(k, sentence(chance, ["a", "bb", "ccc"], chance.randrange(1, 300)), "en", chance.choice(["s1", "s2", "s3", "s3", "s3", "S"])) for k in range(n)]


def test_targets_are_shared_and_capped():
    got = mixing.targets({"b": 100, "a": 10, "c": 1000, None: 0})
    assert got["a"] == 30 and got[None] == 0 and got["b"] == 300 and np.isclose(got["c"], 780)
    assert mixing.targets({}) == {}


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 16)
    monkeypatch.setattr(mixing, "FANOUT", 4)
    rows = documents() + [row(1000 + k, r[1], r[2], r[3]) for k, r in enumerate(odd_rows())]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["source_size"] == sum(len(WORD.findall(x[1] or "")) for x in rows if x[3] == r["source"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= max((len(WORD.findall(x[1] or "")) for x in rows if x[3] == s), default=0)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_repeat_gives_whole_rows(spark):
    rows = documents(150)
    docs = frame(spark, rows)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    got = mixing.repeat(docs)
    assert got.columns == docs.columns
    seen = defaultdict(int)
    for r in got.collect():
        seen[r["doc_id"]] += 1
    assert dict(seen) == {k: c for k, c in copies.items() if c}
    odd = frame(spark, odd_rows())
    assert mixing.repeat(odd).columns == odd.columns and mixing.repeat(odd).count() >= 0
    assert mixing.repeat(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def crowded(n=3000):
    """Nine tenths of the rows without an id, a third of all rows equal, many others under one id."""
    chance = random.Random(14)
    rows = [row(None, "the same text again", "en", "s1")] * (n // 3)
    rows += [row(None, sentence(chance, EN, chance.randrange(0, 30)), "en", chance.choice(["s1", "s2"])) for _ in range(n * 9 // 10 - n // 3)]
    rows += [row(7, sentence(chance, EN, chance.randrange(1, 30)), "en", "s3") for _ in range(n // 20)] + [row(k, sentence(chance, EN, 12), "en", None) for k in range(n // 20)]
    return rows


def test_mix_of_crowded_ids(spark, monkeypatch):
    """Targets are met, no group holds more rows than its share, and repeating gives as many rows as the mix says."""
    monkeypatch.setattr(mixing, "GROUP", 64)
    monkeypatch.setattr(mixing, "FANOUT", 4)
    monkeypatch.setattr(mixing, "RUN", 100)
    rows = crowded()
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got) == sorted((str(r[0]), str(r[3]), len(WORD.findall(r[1]))) for r in rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1]))
    goal, taken = mixing.targets(size), defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert np.isclose(r["target"], goal[r["source"]]) and r["source_size"] == size[r["source"]] and r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - goal[s]) <= 30 for s in size)
    seen = Counter((r["doc_id"], r["text"]) for r in mixing.repeat(frame(spark, rows)).collect())
    words = defaultdict(int)
    for (doc_id, text), n in seen.items():
        words[next(r[3] for r in rows if r[:2] == (doc_id, text))] += n * len(WORD.findall(text))
    assert all(abs(words[s] - goal[s]) <= 30 for s in ("s3", None))
    assert seen == Counter((r["doc_id"], r["text"]) for r in mixing.repeat(frame(spark, rows[::-1]).repartition(5)).collect())


def test_groups_of_crowded_ids_are_small(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 64)
    seen, level = [], mixing._level

    def watched(rows, last):
        seen.append(rows.groupBy("source", "part").count().agg(F.max("count")).first()[0])
        return level(rows, last)

    monkeypatch.setattr(mixing, "_level", watched)
    mixing.mix(frame(spark, crowded())).count()
    assert max(seen) < 2 * 64


def test_many_sources_get_the_targets_of_few(spark, monkeypatch):
    chance = random.Random(5)
    rows = [row(k, sentence(chance, EN, chance.choice([1, 3, 200])), "en", f"source {chance.randrange(300)}" if k % 50 else None) for k in range(900)]
    few = mixing.mix(frame(spark, rows)).select("source", "source_size", "target").distinct().collect()
    monkeypatch.setattr(mixing, "FEW", 0)
    many = mixing.mix(frame(spark, rows)).select("source", "source_size", "target").distinct().collect()
    assert {r["source"]: round(r["target"], 6) for r in few} == {r["source"]: round(r["target"], 6) for r in many} and len(few) == len(many) > 200


def test_sizes_and_targets_equal_sql(spark):
    """What SQL can say of a mix: sizes, sums of sources, and targets after capping at three times the size."""
    sf = "/root/testdata/sf0.001"
    want = connection(sf).sql(MIX_SQL).fetchall()
    got = QUERIES["op8_source_mixing"](spark, sf).select("doc_id", "size", "source_size", "target").collect()
    assert sorted((a, b, c, round(t, 6)) for a, b, c, t in want) == sorted((r[0], r[1], r[2], round(r[3], 6)) for r in got)


#: Sources are capped in the order of size by weight, so those before the first that fits under its cap are the capped ones.
MIX_SQL = """
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, sum(size) AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
    o AS (SELECT *, sum(n) OVER () AS total, coalesce(sum(n) OVER before, 0) AS cut, sum(w) OVER after AS free FROM s
        WINDOW before AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    u AS (SELECT (total - 3 * cut) / free AS unit FROM o WHERE w * (total - 3 * cut) / free <= 3 * n ORDER BY n / w, source LIMIT 1)
    SELECT d.doc_id, d.size, s.n AS source_size, least(3 * s.n, s.w * u.unit) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source CROSS JOIN u"""


@pytest.mark.parametrize("run", [10, 100_000])
def test_shards_of_crowded_ids(spark, monkeypatch, run):
    """Balance, order and slots against a plain running sum over all rows."""
    monkeypatch.setattr(sharding, "RUN", run)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    rows = [r for r in crowded(1200)]
    got = sorted((r["shard"], r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in sharding.shard(frame(spark, rows), 40).collect())
    kinds = sorted((r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()), len(r[1].encode()) + 16) for r in rows)
    total, at, want, slots = sum(k[3] for k in kinds), 0, [], Counter()
    for k in kinds:
        shard = min(39, (2 * at + k[3]) * 40 // (2 * total))
        want.append((shard, slots[shard], *k))
        slots[shard] += 1
        at += k[3]
    assert got == want


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_balanced_and_contiguous(spark, shards):
    rows = documents(600)
    got = sharding.shard(frame(spark, rows), shards).collect()
    size, slots, shard = defaultdict(int), defaultdict(list), {}
    for r in got:
        text = rows[r["doc_id"]][1].encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shard[r["doc_id"]] = r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) == set(range(shards))
    order = [shard[k] for k in sorted(shard)]
    assert order == sorted(order)
    most = max(len(r[1].encode()) + 16 for r in rows)
    assert max(size.values()) - min(size.values()) <= 2 * most


def test_shards_of_odd_rows(spark):
    rows = odd_rows()
    got = sharding.shard(frame(spark, rows), 40).collect()
    assert len(got) == len(rows) and all(0 <= r["shard"] < 40 for r in got)
    assert sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((r[1] or "").encode()) for r in rows)
    assert sharding.shard(frame(spark, []), 40).count() == 0


def test_shards_use_no_python(spark):
    plan = sharding.shard(frame(spark, documents(50)), 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
