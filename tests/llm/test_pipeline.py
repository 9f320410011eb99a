import random

import corpus_pipeline
from stackwave.llm import mixing

from .cases import EN, SCHEMA, frame, odd_rows, row, sentence
from .test_near_dedup import brute, shingles


def test_stages_and_result(spark, tmp_path):
    chance = random.Random(12)
    words = [f"{w}{k}" for w in EN for k in range(20)]
    item = sentence(chance, words, 30)
    rows = [row(k, sentence(chance, words, chance.randrange(8, 80)), "en", f"s{k % 3}") for k in range(90)]
    rows += [row(200 + k, rows[k][1] + (" tail" if k % 2 else ""), "en", "s0") for k in range(20)]
    rows += [row(300 + k, f"{sentence(chance, words, 10)} {item} {sentence(chance, words, 10)}") for k in range(5)]
    rows += [row(400, "12 34 56"), row(401, ""), row(402, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append({r["doc_id"] for r in docs.collect()})
        assert name == "shard" or docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    language, dedup, clean, mixed, sharded = seen
    assert language == {r[0] for r in rows} - {400, 401, 402}
    kept = {d for d, _, c in brute([r for r in rows if r[0] in language]) if d == c}
    assert dedup == kept and clean == kept - set(range(300, 305))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(frame(spark, [r for r in rows if r[0] in clean])).collect()}
    assert mixed == {d for d, c in copies.items() if c} == sharded
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.count() == sum(copies.values())


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "some benchmark item of seven words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd_rows(), []):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame(spark, rows), str(tmp_path)).count() <= 3 * len(rows)


def test_near_dedup_stage_drops_copies_from_0_8_on(spark, tmp_path):
    """Pairs that share 4 of 5, 21 of 26 and 16 of 21 of their shingles: only the last pair stays whole."""
    words = [f"w{k}" for k in range(400)]
    pairs = [(words[:8], words[:9]), (words[100:125], words[100:130]), (words[200:220], words[200:225])]
    rows = [row(10 * k + j, " ".join(t)) for k, pair in enumerate(pairs) for j, t in enumerate(pair)]
    similar = [len(shingles(rows[i][1]) & shingles(rows[i + 1][1])) / len(shingles(rows[i][1]) | shingles(rows[i + 1][1])) for i in (0, 2, 4)]
    assert similar[0] == 0.8 and 0.8 < similar[1] < 0.85 and similar[2] < 0.8
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 10, 20, 21]
