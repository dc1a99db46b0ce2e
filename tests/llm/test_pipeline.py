"""The pipeline: each stage against its operator or brute force on its own input, and the run as a whole."""

import zlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from .test_near_dup import brute_classes
from .test_quality import brute_counts

SF = "/root/testdata/sf0.001"


def test_stages(spark, table):
    docs = table("documents")
    labels = {r["doc_id"]: r["quality"] for r in table("labels").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        columns, docs = docs.columns, stage(spark, docs, SF)
        if name == "packing":
            break
        docs = docs.cache()
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        gone = before.keys() - after.keys()
        if name == "near_dedup":
            of = brute_classes(before.values())
            assert len(after) == len(set(of.values())) and {of[t] for t in after.values()} == set(of.values())
        else:
            good = [i for i in before if labels.get(i) == 1 and brute_counts(before[i])[0] >= 50 and 2 * brute_counts(before[i])[4] <= brute_counts(before[i])[0]]
            assert len(gone.intersection(good)) <= 0.05 * len(good)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = docs.collect()
    assert sum(p["length"] for p in pieces) == sum(len(t.encode(s, add_special_tokens=False).ids) + 1 for s in before.values())
    assert zlib.crc32(b"") == 0 and {p["doc_id"] for p in pieces} == before.keys()


def test_edge_rows_and_further_columns(spark, tmp_path, docs_of):
    """Null and empty texts, repeated rows, ids without labels, and columns whose names the operators use."""
    good = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, None), (2, ""), (3, " \n"), (4, good), (4, good), (None, good), (None, None), (5, good + " more"), (6, "x " * 30_000), (7, " ".join(f"other{i}" for i in range(60)))]
    docs = docs_of(rows).selectExpr("*", "'a' as kept", "1 as node", "2 as id_", "3 as n_words", "4 as `odd.name`", "5 as more_", "6 as quality_p")
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() >= 0 and (name == "packing" or out.columns == docs.columns)
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0
        if name == "near_dedup":
            left = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
            assert left == sorted([("1", ""), ("2", ""), ("3", " \n"), ("None", ""), ("4", good), ("6", "x " * 30_000), ("7", rows[-1][1])])
        if name == "quality_rules":
            assert {r["doc_id"] for r in out.collect()} <= {4, 5, 7, None} and out.filter("text is null").count() == 0


def test_run_and_its_empty_input(spark, table, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for name in ("documents", "labels"):
        table(name).filter("false").write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
