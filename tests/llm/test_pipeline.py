import hashlib

import corpus_pipeline
from blockstrata.llm import exact_dedup, near_dup, quality_rules, queries, site_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows = after.collect()
        if name != "packing":
            assert after.dtypes == docs.dtypes
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.judge(docs, queries.quality_model(spark, SF)).where("kept").collect()}
        elif name == "quality_classifier":
            kept = {r.doc_id for r in site_quality.judge(docs, queries.quality_model(spark, SF)).where("kept").collect()}
        elif name == "near_dedup":
            kept = {r.doc_id for r in near_dup.near_duplicates(docs, 5, 80).where("kept").collect()}
        elif name == "suffix_array_dedup":
            kept = set(before)
            for r in exact_dedup.cut(docs, 50).collect():
                text = next(x.text for x in rows if x.doc_id == r.doc_id)
                assert len(text.encode()) <= r.n_bytes - r.n_removed
                if not r.n_removed:
                    assert hashlib.sha256(text.encode()).hexdigest() == r.kept_sha256
        else:
            kept = {r.doc_id for r in rows}
            assert kept == set(before)
        assert {r.doc_id for r in rows} == kept and 0 < len(kept) <= len(before)
        docs = after


def test_odd_and_empty(spark, odd, none, as_dir):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")
    folder = as_dir(documents=odd.select("doc_id", "text", "lang", "source", "n_chars"), labels=labels)
    corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[2:4]:
        docs = stage(spark, docs, folder)
    assert docs.count() == 16  # of the documents with equal texts the smaller doc_id is left; both rows of the other go
    assert corpus_pipeline.run(spark, as_dir(documents=none, labels=labels)).collect() == []


def test_near_duplicates_go_row_by_row(spark, as_dir):
    words = lambda *n: " ".join(f"w{i}" for i in range(*n))
    first, near, other, lone, last = words(100), words(100) + " more", words(200, 300), words(400, 500), words(600, 700)
    rows = [(1, first), (2, near), (2, other), (3, lone), (3, lone), (None, last), (None, last), (None, first), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    key = lambda r: (r[0] or 0, r[1] or "")
    assert out.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted([(1, first), (2, other), (3, lone), (None, last), (None, None), (None, None)], key=key)


def test_other_columns_and_running_twice(spark, as_dir):
    """Columns of any name beside those of documents are left out; a second run gives the same and finds the first one's tables gone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS kept", "2 AS _row", "3 AS _text", "'x' AS h", "4 AS prior", "5 AS n_ids", "6 AS bin")
    folder = as_dir(documents=docs, labels=spark.read.parquet(f"{SF}/labels.parquet"))
    key = lambda r: (r.doc_id, r.piece, r.n_ids, r.start, r.n_tokens)
    one, two = (sorted(map(key, corpus_pipeline.run(spark, f).collect())) for f in (folder, SF))
    assert one == two and len(one) > 50
    assert corpus_pipeline._LEFT == []


def test_a_task_holds_little_of_what_stages_read_and_write(spark, tmp_path):
    """A stage's result is in small row groups, whoever writes it, and the next one reads few rows at once."""
    import pyarrow.parquet as pq

    for name in ("spark.sql.parquet.columnarReaderBatchSize", "parquet.block.size"):
        spark.conf.unset(name)
    docs = spark.range(600).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12000), x -> hex(xxhash64(id, x)))) AS text", "'en' AS lang", "'a' AS source", "204000L AS n_chars").repartition(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet")).coalesce(1)
    corpus_pipeline.keep_good_sites(spark, read, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    groups = [pq.ParquetFile(f).metadata.row_group(i).total_byte_size for f in (tmp_path / "out").glob("*.parquet") for i in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) > 100 << 20 and max(groups) < 48 << 20
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256
