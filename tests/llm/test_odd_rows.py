"""Every operator and stage with repeated rows, null keys, very long texts, empty tables and clashing columns."""

import itertools
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausewright.llm import chat, decontaminate, packing, quality, sharding, simhash, token_counts, toxicity
from clausewright.llm.common import materialize, shared_dir, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Text` string, score double, shard int, fp long, mark long, bucket int, row long"
LONG = "some words that go on and on without an end " * 30_000
TEXTS = [(None, None), (None, "twice without an id"), (None, "twice without an id"), (1, ""), (2, " \n\t "), (3, "same"), (3, "same"), (3, "other text, same id"), (4, LONG), (5, LONG), (5, LONG), (6, "Ünï \x1c côde 😀")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), "x", 0.5, 9, 7, 7, 7, 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def test_scores_keep_every_row(spark, odd):
    model = quality.QualityModel(np.zeros(4 * quality.BUCKETS, np.float32), -9.0, 1.0, 0.0)
    judged = quality.assess(spark, odd, model).collect()
    assert len(judged) == len(TEXTS) and sorted(r.n_words for r in judged)[-3:] == [300_000] * 3
    toxic = toxicity.score(spark, odd, toxicity.train(odd.limit(0), odd.select("doc_id", F.lit(1).alias("toxic")))).collect()
    assert len(toxic) == len(TEXTS) and not any(r.predicted for r in toxic) and not any(r.held_out for r in toxic if r.doc_id is None)


def test_simhash_keeps_one_of_repeated_rows(spark, odd):
    found = simhash.near_duplicates(spark, odd).collect()
    assert len(found) == len(TEXTS) and {r.component_id for r in found if r.fingerprint == "0" * 16} == {1}
    kept = simhash.keep_one(spark, odd)
    assert kept.columns == odd.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, "twice without an id"), (1, ""), (3, "same"), (3, "other text, same id"), (4, LONG), (6, TEXTS[-1][1])], key=str)


@pytest.mark.parametrize("block", [100_000, 2])
def test_decontamination(spark, odd, block):
    items = [(None, "twice without an id"), ("None", "without an id"), ("7", "go on and on"), ("8", None), ("8", "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.find_contamination(spark, odd, bench, 3, block).collect()
    assert len(found) == len(TEXTS)
    assert [r["items"] for r in found if r.doc_id is None and r.n_words] == [["None", None]] * 2
    assert [r.n_hit for r in found if r.doc_id == 5] == [found[8].n_hit] * 2 if block == 100_000 else True
    kept = decontaminate.keep_clean(spark, odd, bench, 3, block)
    assert kept.columns == odd.columns and kept.count() == len(TEXTS) - 5


def test_sharding_matches_a_jump_hash(spark, odd):
    keys = spark.range(-500, 1500).withColumn("text", F.lit("x")).withColumnRenamed("id", "doc_id")
    draws = {(r.doc_id, r.b): r.d for r in keys.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(25))).alias("b")).select("doc_id", "b", F.shiftrightunsigned(F.xxhash64("doc_id", F.col("b").cast("int")), 33).alias("d")).collect()}

    def jump(key, shards):
        at, to = -1, 0
        while to < shards:
            at, to = to, int((to + 1) * (float(1 << 31) / float(draws[key, to] + 1)))
        return at

    found = sharding.assign_shards(keys).collect()
    assert all((r.shard, r.grown_shard) == (jump(r.doc_id, 24), jump(r.doc_id, 25)) for r in found)
    rows = sharding.assign_shards(odd).collect()
    for shard, group in itertools.groupby(sorted(rows, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert [r.slot for r in group] == list(range(sum(r.shard == shard for r in rows)))
    assert len(rows) == len(TEXTS)


def test_packing(spark, odd):
    found = packing.pack(spark, odd, tokenizer_path("word_bpe_49k.json")).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in found)
    for (s, at, n), (t, to, _) in itertools.pairwise(places):
        assert to == at + n if s == t else to == 0
    assert sum(r.piece == 0 for r in found) == len(TEXTS) and max(at + n for _, at, n in places) <= 4096


def test_token_counts(spark, odd):
    path = tokenizer_path("byte_bpe_50k.json")
    sums = token_counts.count_tokens(odd, path).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    by = {r.doc_id: r.n for r in sums}
    assert by[5] == 2 * by[4] > 0
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0


def test_chat_parts_out_of_order_are_an_error(spark):
    turns = spark.createDataFrame([(1, k, "user", "x" * 30) for k in range(9)], "conv_id long, turn long, role string, text string")
    parts = chat.render(chat.turn_events(turns), 40)
    assert chat.digests(parts).first().n_turns == 9
    with pytest.raises(Exception, match="out of order"):
        chat.digests(parts.coalesce(1).orderBy(F.desc("part")).coalesce(1)).collect()


def test_stages(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        out = stages[name](spark, odd, SF)
        assert out.columns == odd.columns, name
        assert 0 <= out.count() <= len(TEXTS)
        assert stages[name](spark, odd.limit(0), SF).count() == 0
    assert stages["near_dedup"](spark, odd, SF).count() == 6
    assert stages["private_data"](spark, odd, SF).count() == len(TEXTS)
    assert stages["best_fit_packing"](spark, odd, SF).where("piece = 0").count() == len(TEXTS)


def test_run(spark):
    packed = corpus_pipeline.run(spark, SF).collect()
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    docs = {r.doc_id for r in packed}
    assert 0 < len(docs) < documents and sum(r.piece == 0 for r in packed) == len(docs)


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getConf=dict, master="spark://host:7077"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(session)
    session.conf = {"spark.checkpoint.dir": "s3://there/"}
    assert shared_dir(session) == "s3://there"
    assert materialize(spark.range(3), "t").count() == 3
