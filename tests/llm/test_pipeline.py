"""The pipeline's stages over odd rows and none."""

import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mirador.llm.common import staged
from tests.llm.test_llm import ODD, SF


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", out / f"{name}.parquet")
    return out


def test_odd_rows_through_all_stages(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None if i == 0 else 10_000 + i, t) for i, t in enumerate([*ODD, ODD[3], "x"])], "doc_id long, text string")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    planted = spark.createDataFrame([(20_001, f"Before it. {item} After it."), (20_002, "a plain text that nobody else has, on gardens and their gates"), (20_003, "a plain text that nobody else has, on gardens and their gates")], "doc_id long, text string")
    extra = odd.unionByName(planted).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    whole = docs.unionByName(extra).unionByName(extra.filter("doc_id = 10003"))  # a repeated row
    whole.withColumns({"label": F.lit("x"), "key": F.lit(1), "own": F.lit(2.0)}).write.parquet(str(folder / "documents.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, docs, str(folder)), name)
        assert after.columns == docs.columns and after.count() <= docs.count()
        docs = after
        seen[name] = docs.select("doc_id", "text").collect()
    ids = lambda name: [r.doc_id for r in seen[name]]
    assert {None, 10_001, 20_001, 20_002, 20_003} <= set(ids("toxicity")) and ids("toxicity").count(10_003) == 2
    assert len(ids("line_dedup")) == len(ids("toxicity"))  # lines go, documents stay
    assert 20_002 in ids("near_dedup") and 20_003 not in ids("near_dedup") and ids("near_dedup").count(10_003) == 1
    assert sum(not (r.text or "").strip() for r in seen["near_dedup"]) == 1  # of blank ones one stays
    assert 20_001 in ids("near_dedup") and 20_001 not in ids("decontamination") and 20_002 in ids("decontamination")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(folder)).collect()
    assert {r.doc_id for r in packed} == set(ids("decontamination"))
    spans = {}
    for r in packed:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        ends = [0]
        for at, n in sorted(own):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 2048


def test_no_rows_through_all_stages(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, str(folder)), name)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(folder)).count() == 0


def test_near_copies_are_those_of_operator_two(spark, folder):
    """Texts that the fingerprint takes for one, though they share few of their shingles."""
    from mirador.llm import simhash

    common = "lorem ipsum dolor " * 200
    odd = [common + " ".join(f"{a}{k}" for k in range(50)) for a in "xyz"] + ["one text of its own", "ONE text of its own", None, " \n"]
    extra = spark.createDataFrame([(30_000 + i, t, "en", "s", len(t or "")) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(extra)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(folder)).collect())
    assert got == sorted(r.doc_id for r in simhash.near_duplicates(docs).collect() if r.doc_id == r.component_id)
    assert [i for i in got if i >= 30_000] == [30_000, 30_003, 30_005]
