import zlib

import corpus_pipeline
from tests.llm import helpers as h
from tests.llm.test_neardup import brute
from tests.llm.test_spans import hits
from tests.llm.test_tokens import whole
from weft.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark, tmp_path):
    """Each stage against a plain version, on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = kept[name] = docs.collect()
        if name == "packing":
            break
        assert docs.columns == columns
        ids, old = [r.doc_id for r in after], {r.doc_id: r for r in before}
        assert len(set(ids)) == len(ids) and set(ids) <= set(old)
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        elif name == "near_duplicates":
            assert sorted(ids) == sorted({c for _, c, _ in brute([r.doc_id for r in before], [r.text for r in before])})
        elif name == "decontamination":
            n = {r.doc_id: hits(r.text, items) for r in before}
            assert set(ids) == {d for d, (words, hit, _) in n.items() if hit <= 0.5 * words}
            for r in after:
                assert r.n_chars == len(r.text) if n[r.doc_id][1] else r == old[r.doc_id]
                assert len(h.words(r.text)) == n[r.doc_id][0] - n[r.doc_id][1]
    texts = {r.doc_id: r.text for r in kept["decontamination"]}
    ids = dict(zip(texts, whole(queries.tokenizer("word_bpe_49k.json"), texts.values()), strict=True))
    seen = {}
    for r in kept["packing"]:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {d: len(x) for d, x in ids.items()}


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    h.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, docs in enumerate((h.awkward(spark), h.none(spark))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert (docs.count() == 0) == (k == 1)


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and "sequence_id" in got.columns


#: Names that operators and stages give to columns of their own.
OWN = "_before _class _f1 _f2 _set _top _lone _hits _hits0 _toxicity _language _words _digest _least _group tokens toxicity language hits fails k1 k2 z spans chunk kind id row _id _label _text config"


def test_columns_named_like_the_operators_own_stay(spark, tmp_path):
    from pyspark.sql import functions as F

    h.labels(spark, [(i, 1, int(i == 8)) for i in range(9)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "same text again and once more")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = h.awkward(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in OWN.split()])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        assert rows or name == "language_id"  # too few texts to learn a language from
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r[n] == (None if r.doc_id is None else n + str(r.doc_id)) for r in rows for n in OWN.split())
