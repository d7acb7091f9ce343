"""Every operator and stage on odd rows, on empty tables, and with columns of clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from headwind.llm import jaccard, langid, licenses, mixing, quality, rules, tokenfiles, toxicity, urllists
from headwind.llm.decontaminate import decontaminate, find_benchmark_words

N = 48


def _items(spark):
    return spark.createDataFrame([(1, "two texts, one id"), (1, "two texts, one id"), (2, None), (3, ""), (None, "odd")], "item_id bigint, text string")


def _judged(spark, docs):
    """Texts of documents taken as URLs: nulls, empty and very long ones, repeats; none has a host but those made here."""
    urls = docs.withColumns({"url": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("http://Example.com/A/b/"), "text")).otherwise(F.col("text")), "fetched": F.when(F.col("doc_id") % 3 > 0, F.lit("2024-05-05 10:00:00").cast("timestamp"))})
    entries = spark.createDataFrame([("x", "EXAMPLE.com/A", "2024-05-05 09:00:00", "add"), (None, "example.com", None, "add")], "list string, pattern string, day string, action string")
    return urllists.judge_captures(urls, entries)


OPERATORS = {
    "urls": lambda s, d, l: _judged(s, d),
    "languages": lambda s, d, l: langid.languages_of_documents(d),
    "toxicity": lambda s, d, l: toxicity.toxicity_scores(d, l),
    "benchmark": lambda s, d, l: find_benchmark_words(d, _items(s)),
    "rules": lambda s, d, l: rules.apply_rules(d),
    "licenses": lambda s, d, l: licenses.scan_licenses(d, licenses.train_licenses(d)),
    "jaccard": lambda s, d, l: jaccard.near_duplicates(d),
    "quality": lambda s, d, l: quality.quality_scores(d, l),
    "tokens": lambda s, d, l: tokenfiles.read_token_files(s, tokenfiles.write_token_files(d, corpus_pipeline.TOKENIZER)),
    "mixing": lambda s, d, l: mixing.mix_to_targets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, edges, edge_labels, name):
    assert OPERATORS[name](spark, edges, edge_labels).count() == N == edges.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, nothing, edge_labels, name):
    made = OPERATORS[name](spark, nothing, edge_labels)
    assert made.count() == 0 and made.columns


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_without_labels(spark, edges, edge_labels, name):
    assert OPERATORS[name](spark, edges, edge_labels.limit(0)).count() == N
    only = OPERATORS[name](spark, edges, edge_labels.withColumns({"quality": F.lit(1), "toxic": F.lit(1)})).collect()
    assert all(r["predicted"] == 1 and 0 <= r["score"] <= 1 for r in only)


@pytest.mark.parametrize("name", OPERATORS)
def test_reruns_agree(spark, edges, edge_labels, name):
    a, b = (sorted(map(str, OPERATORS[name](spark, d, edge_labels).collect())) for d in (edges, edges.repartition(5, "doc_id")))
    assert a == b


def test_stages_keep_the_columns(spark, edges, nothing, edge_labels):
    stages = {
        "quality": lambda d: quality.keep_good(d, edge_labels), "near": jaccard.one_of_each_class, "benchmark": lambda d: decontaminate(d, _items(spark)), "mix": mixing.repeat_by_mix,
    }
    for name, stage in stages.items():
        assert stage(edges).schema == edges.schema, name
        assert stage(nothing).count() == 0, name
        kept = stage(edges)
        assert kept.exceptAll(edges if name != "mix" else edges.unionByName(edges)).count() == 0, name


def _tables(folder, docs, labels, items):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_on_odd_rows(spark, edges, edge_labels, tmp_path):
    from headwind import session

    session.release(spark)
    made = corpus_pipeline.run(spark, _tables(tmp_path, edges, edge_labels, _items(spark))).orderBy("start").collect()
    ids = {r["doc_id"] for r in edges.select("doc_id").collect()}
    assert made and {r["doc_id"] for r in made} <= ids and all(r["n_tokens"] > 0 for r in made)
    assert [r["start"] for r in made] == [sum(x["n_tokens"] for x in made[:i]) for i in range(len(made))]
    # Only the last written stage and the token files are still there.
    assert session.release(spark) == 2


def test_pipeline_on_empty_tables(spark, nothing, edge_labels, tmp_path):
    assert corpus_pipeline.run(spark, _tables(tmp_path, nothing, edge_labels.limit(0), _items(spark).limit(0))).count() == 0


def test_defined_results(spark, edges, edge_labels):
    found = {(r["doc_id"], r["n_links"], r["class_id"]) for r in jaccard.near_duplicates(edges).where("doc_id in (5, 6, 7) or doc_id is null").collect()}
    # Five rows share the words of `same` up to one: each has four others, and the class has no least id but 5.
    assert found == {(5, 4, 5), (6, 4, 5), (7, 4, 5), (None, 4, 5), (None, 0, None)}
    lang = {r["doc_id"]: r for r in langid.languages_of_documents(edges).collect()}
    assert (lang[1]["lang_pred"], lang[2]["lang_pred"], lang[10]["lang_pred"], lang[10]["score"]) == ("und", "und", "und", 0.0)
    tokens = OPERATORS["tokens"](spark, edges, edge_labels).orderBy("start").collect()
    assert [r["doc_id"] for r in tokens[:4]] == [None, None, -3, 1] and tokens[3]["n_tokens"] == 1
    items = {r["row"]["doc_id"]: r for r in find_benchmark_words(edges, _items(spark)).where("n_hit > 0").collect()}
    assert set(items) == {8, 12} and items[8]["item_ids"] == ["1"] and items[8]["n_hit"] == 4 and items[12]["item_ids"] == []
