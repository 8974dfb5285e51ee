"""The pipeline on small tables with planted cases, stage by stage, against brute force."""

import random

import corpus_pipeline
from millrace.llm import secret_ledger

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _plant(spark, folder):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**5)}" for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    docs = {i: text(rng.randint(60, 90)) for i in range(300)}
    toxic = {i for i in docs if i % 7 == 3}
    for i in toxic:
        docs[i] += " grubling " + text(5)
    clean = [i for i in docs if i not in toxic]
    copies = {1000 + k: clean[k] for k in range(10)}
    near = {2000 + k: clean[20 + k] for k in range(5)}
    leaks = {3000 + k: k for k in range(5)}
    secrets = {4000 + k for k in range(5)}
    for c, i in copies.items():
        docs[c] = docs[i]
    for c, i in near.items():
        w = docs[i].split()
        w[len(w) // 2] = "edited"
        docs[c] = " ".join(w)
    for c, k in leaks.items():
        docs[c] = text(40) + " " + items[k][1] + " " + text(10)
    for c in secrets:
        docs[c] = text(40) + " password=abcdefgh12345678 " + text(9)
    docs |= {5000: None, 5001: ""}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, toxic, copies, near, leaks, secrets


def test_stages(spark, tmp_path):
    docs, toxic, copies, near, leaks, secrets = _plant(spark, str(tmp_path))
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = set(docs)
    gone = [toxic, {*copies, *near, 5001}, set(leaks), set()]
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:4], gone):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        left -= lost
        assert {r["doc_id"] for r in df.collect()} == left, name
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert all("abcdefgh12345678" not in texts[i] and "[secret]" in texts[i] for i in secrets)
    assert all(texts[i] == docs[i] for i in left - secrets)
    assert not any(secret_ledger.find(t or "") for t in texts.values())
    packed = corpus_pipeline.STAGES[4][1](spark, df, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == left
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)


def test_empty_tables_nulls_and_repeats(spark, tmp_path):
    folder = str(tmp_path)
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (None, "a b c d e f", "en", None, 3), (2, long, "en", "s", 1), (3, "", "en", "s", 0), (2, long, "en", "s", 1), (None, None, None, None, None)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    # 3 is a copy of 1 (both empty); the repeated row of 2 is the same document and stays with it; null ids stay
    assert sorted({str(r["doc_id"]) for r in got}) == ["1", "2", "None"]
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == 2 * max(r["start"] + r["length"] for r in got if r["doc_id"] == 2)
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_clashing_columns(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    names = "doc_id long, text string, toxic int, y int, h long, items string, blob string, spans string, digest string, fp long, node long, label long, score double, w string"
    docs = spark.createDataFrame([(i, f"plain text number {i}", 1, 2, 3, "i", "b", "s", "d", 4, 5, 6, 0.5, "w") for i in range(4)], names)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0, name
    assert corpus_pipeline.STAGES[4][1](spark, docs, folder).count() == 4


def test_names_that_the_stages_use_themselves(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(k, 1, 0) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = "one two three four five six seven"
    spark.createDataFrame([(0, item, 0, 0, 0)], "item_id long, text string, doc_id int, h int, n int").write.parquet(f"{folder}/benchmark.parquet")
    extra = "_blob _spans _lost lost_id lost_digest spans_ blob spans of_id found several i g k t a b x y s node digest first_id _i _id _n _d _g copied hs hot own runs start count file ids share row length piece".split()
    rows = [(0, "plain words alone here"), (1, f"a b {item} c"), (2, "password=abcdefgh12345678 is here"), (3, "plain words alone here"), (4, None)]
    docs = spark.createDataFrame([(*r, *(["v"] * len(extra))) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs_out = stage(spark, docs, folder)
        assert docs_out.columns == docs.columns, name
        kept = {r["doc_id"]: r for r in docs_out.collect()}
        assert all(r[c] == "v" for r in kept.values() for c in extra), name
        assert set(kept) == {"near_dedup": {0, 1, 2, 4}, "decontamination": {0, 2, 3, 4}}.get(name, {0, 1, 2, 3, 4}), name
        if name == "secrets":
            assert kept[2]["text"] == "[secret] is here" and kept[4]["text"] is None
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()} == {0, 1, 2, 3, 4}


def test_batches_are_small_and_workers_keep_no_encoder(spark, tmp_path):
    import pyarrow as pa

    from millrace.llm import tokens
    from millrace.llm.common import BATCH_BYTES, lean

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    size = lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in it)
    texts = spark.range(0, 9000, 1, 1).selectExpr("id AS doc_id", "repeat('ab ', 700) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    try:
        dict(corpus_pipeline.STAGES)["toxicity"](spark, texts, str(tmp_path))
        sizes = [r["n"] for r in texts.mapInArrow(size, "n long").collect()]
        assert len(sizes) > 1 and max(sizes) <= BATCH_BYTES + (1 << 13)
        spark.conf.set(setting, "1m")
        dict(corpus_pipeline.STAGES)["near_dedup"](spark, texts.limit(2), str(tmp_path))
        assert spark.conf.get(setting) == "1m"
    finally:
        spark.conf.set(setting, before)
    tokens.encoder()
    assert tokens.encoder.cache_info().currsize
    assert list(lean(lambda it: (2 * x for x in it))([1, 2])) == [2, 4] and not tokens.encoder.cache_info().currsize
