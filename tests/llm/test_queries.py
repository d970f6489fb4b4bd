"""The registered queries at the smallest scale: against their SQL where there is one, else their shape."""

import pytest

import oracle
from docgrove.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_near_dup_embeddings": {"vec_id", "n_links", "component_id", "kept"},
    "op2_lm_score": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op5_best_fit": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op8_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op9_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op10_quality": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    oracle.compare(QUERIES[name], ORACLES[name], spark, SF, oracle.connection(SF))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_covers_its_table(spark, name):
    got = QUERIES[name](spark, SF)
    table = spark.read.parquet(f"{SF}/{'embeddings' if name.startswith('op1_') else 'documents'}.parquet")
    key = "vec_id" if name.startswith("op1_") else "doc_id"
    assert COLUMNS[name] <= set(got.columns)
    assert sorted(r[0] for r in got.select(key).distinct().collect()) == sorted(r[0] for r in table.select(key).collect())


def test_all_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from docgrove.llm.common import save

    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in p.STAGES:
        docs = save(stage(spark, docs, SF))
        kept.append(docs.count())
        if name != p.STAGES[-1][0]:
            assert docs.columns == first.columns
    assert kept[0] <= first.count() and kept[1] == kept[0] and kept[2] <= kept[1] and kept[4] >= kept[3] > 0
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_pipeline_stages_define_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an empty table and other columns go through every stage."""
    import corpus_pipeline as p

    long = " ".join(f"word{i}" for i in range(120_000))
    rows = [(1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, None, None, None, None), (4, "", "en", None, 0), (None, "x y z", "fr", "s", 5), (5, "solo", None, "t", 4), (5, "solo", None, "t", 4), (6, long, "en", "t", len(long)), (7, long + " end", "en", "t", 1)]
    line = "this line is shared by many of the documents here"
    rows += [(10 + i, f"text number {i} of {i * 7} and {i * 13} words\n{line}", "en", "s", None) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], schema + ", score string, _id string")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for case, kept in ((docs, True), (docs.limit(0), False)):
        names = ["doc_id", "text", "lang", "source", "n_chars"]
        for name, stage in p.STAGES:
            got = stage(spark, case, str(tmp_path))
            out = [tuple(r) for r in got.collect()]
            if name != p.STAGES[-1][0]:
                assert got.columns == names, name
            if not kept:
                assert out == [], name
        if kept:
            lines = {r["doc_id"]: r["text"] for r in p.drop_lines(spark, docs, "").collect()}
            assert len(lines) == 14 and line in lines[15] and all(line not in lines[10 + i] for i in range(5)) and lines[3] == "" and lines[7] == long + " end"
            near = sorted(((r["doc_id"] or 0), r["text"] or "") for r in p.drop_near_copies(spark, docs, "").collect())
            assert [d for d, _ in near] == sorted([0, 1, 3, 4, 5, 6, *range(10, 16)])
            assert [t for d, t in near if d == 6] == [long] and [d for d, _ in near if d in (2, 7)] == []
            mixed = [r["doc_id"] for r in p.mix(spark, docs, "").collect()]
            assert max(mixed.count(d) for d in set(mixed)) <= 4 and 3 not in mixed
            pieces = p.pack_sequences(spark, docs, "").collect()
            assert {r["doc_id"] for r in pieces} == {r[0] for r in rows} and max(r["length"] for r in pieces) == 2048
