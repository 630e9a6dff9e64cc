import corpus_pipeline
from tabulens.llm import suite


def test_stages_on_planted_cases(spark, tmp_path):
    item = "the item of a benchmark that nobody should ever train upon because it would spoil the result of the test"
    passage = ("A passage that stands in several documents of the corpus and that has more than fifty words in all so that"
               " it counts as repeated text and has to go wherever it stands again after its first place in the order of"
               " the documents while all the other words of those documents have to stay as they are today and tomorrow.")
    own = lambda i: " ".join(f"word{i}x{j}" for j in range(120))
    docs = {i: f"{own(i)}." for i in range(60)}
    for i in range(10):
        docs[i] = f"{docs[i]} stupidword another stupidword"
    docs[60] = docs[20]
    docs[61] = f"{docs[21]} {passage}"
    docs[62] = f"{own(62)} runs on {passage}"
    docs[63] = f"{own(63)} {item} {own(64)}"
    table = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()] + [(70, None, None, None, None), (71, "", "en", "s", 0)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 10)) for i in range(50)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    cur, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = cur.columns
    for name, stage in corpus_pipeline.STAGES:
        before = cur
        cur = corpus_pipeline.stored(stage(spark, cur, str(tmp_path)))
        kept[name] = {r["doc_id"]: r for r in cur.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert cur.columns == columns and cur.dtypes == before.dtypes
    assert not set(range(10)) & set(kept["toxicity"]) and set(range(10, 64)) <= set(kept["toxicity"])
    assert 60 not in kept["simhash_near_dedup"] and len(kept["simhash_near_dedup"]) >= len(kept["toxicity"]) - 3
    cut = kept["substring_dedup"]
    assert passage in cut[61]["text"] and "stands in several" not in cut[62]["text"] and own(62) in cut[62]["text"]
    assert cut[62]["n_chars"] == len(cut[62]["text"]) and cut[30]["text"] == docs[30]
    assert set(cut) - set(kept["benchmark_decontamination"]) == {63}
    final = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == set(kept["bpe_encoding"]) == set(kept["benchmark_decontamination"])


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in suite.queries())
    assert numbers == list(range(1, 14))
