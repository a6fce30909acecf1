"""The stages of the corpus pipeline: edge cases, clashing columns, the whole run."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

EN = "the cat and the dog went to the house with them and that was all there is to it number"
DE = "der hund und die katze gingen nach hause und das war alles was sie nicht wollten nummer"
#: Names that the operators use themselves.
CLASHES = "key row tag near_key bench_key secret_key secret_added spans added mix mix_key place copies m all score lang_pred c0 c1 s first owner repo hash base more item_no term pos".split()


def tables(spark, at):
    shared = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [(i, f"{EN if i % 2 else DE} {' '.join(f'w{i}x{k}' for k in range(30))}", ("en" if i % 2 else "de") if i % 3 else None, f"s{i % 3}" if i % 5 else None) for i in range(40)]
    rows += [(40, rows[1][1], "en", "s1"), (41, rows[1][1] + " end", "en", "s2"), (42, None, "en", "s0"), (43, "", None, None), (44, "12 34 !", "en", "s0")]
    rows += [(45, f"{EN} {shared}", "en", "s0"), (46, f"{EN} {' '.join(f'y{k}' for k in range(20))} password: hunter2hunter2", "en", "s0"), (None, f"{DE} {' '.join(f'z{k}' for k in range(20))}", "de", "s1"), (5, rows[5][1], rows[5][2], rows[5][3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, shared), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return docs


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    return tables(spark, at), at


KEPT = {
    "language_id": [*range(42), 45, 46, 5, None], "simhash_near_dedup": [*range(40), 42, 44, 45, 46, None], "benchmark_decontamination": [*range(45), 46, 5, None],
    "secret_scans": [*range(47), 5, None],
}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, small, name, stage):
    docs, at = small
    more = docs.withColumns({c: F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})
    out = stage(spark, more, at)
    assert out.columns[: len(more.columns)] == more.columns
    got = out.collect()
    for r in got:
        for c in CLASHES:
            assert r[c] == f"own {c} {'none' if r.doc_id is None else r.doc_id}", c
    if name in KEPT:
        order = lambda ids: sorted(ids, key=lambda i: (i is None, i))
        assert order(r.doc_id for r in got) == order(KEPT[name])
    if name == "secret_scans":
        assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got)
        assert [r.text[-8:] for r in got if r.doc_id == 46] == ["<secret>"]
    if name == "language_id":
        assert {r.lang for r in got if r.doc_id is not None and r.doc_id % 3 == 0 and r.doc_id < 40} == {"en", "de"}
    empty = stage(spark, more.where("false"), at)
    assert empty.columns == out.columns and empty.count() == 0


def test_run(spark, small):
    docs, at = small
    out = corpus_pipeline.run(spark, at)
    assert out.columns == [*docs.columns, "copy"]
    got = out.collect()
    ids = {r.doc_id for r in got}
    assert ids <= {*range(40), 46, None} and len(ids) > 20
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
