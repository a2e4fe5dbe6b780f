import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codonlake.operators.encoding import _by_batch_id
from codonlake.plans import derived as d, queries
from codonlake.sources import fasta, results

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name, scans",
    [("encoded_without_gaps", 1), ("stage_completeness", 1), ("entropy_attached", 1), ("orf_nucleotides_by_coordinate", 3)],
)
def test_sequences_are_derived_no_more_often_than_needed(spark, monkeypatch, name, scans):
    plain, seen = d.sequences, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(d, "sequences", lambda *where: plain(*where).mapInArrow(counted, "seq_id string, seq string"))
    queries.QUERIES[name](spark, SF).collect()
    assert seen.value <= scans * d.table(spark, SF, "documents").count()


def test_batches_that_span_chunks_are_encoded_whole():
    ids, sizes = [1] * 5 + [2] * 3 + [3] + [4] * 4, []
    rows = pa.record_batch(
        {"batch_id": ids, "parent_id": [f"p{i}" for i in range(13)], "orf_id": ["o"] * 13, "text": [str(i) for i in range(13)]}
    )

    def factory():
        return lambda texts: (sizes.append(len(texts)), [t * 2 for t in texts])[1]

    for step in (1, 2, 3, 5, 13):
        sizes.clear()
        out = pa.Table.from_batches(_by_batch_id(factory)(rows.slice(at, step) for at in range(0, 13, step)))
        assert sizes == [5, 3, 1, 4]
        assert out["three_di"].to_pylist() == [str(i) * 2 for i in range(13)]
        assert out["parent_id"].to_pylist() == [f"p{i}" for i in range(13)]


def test_lines_with_and_without_white_space_are_read_alike(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">a x\nacgt\nAC\n\ngt\n>b\n  ac \t\n gt\x0c\n\n>c\n>d\r\nac\r\ngt\r\n>e z")
    got = {r["seq_id"]: r["seq"] for r in fasta.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"a": "ACGTACGT", "b": "ACGT", "c": "", "d": "ACGT", "e": ""}


def test_both_forms_are_written_in_one_scan(spark, tmp_path):
    """Unified results and lists of one read: the plan has a single scan, and each row is there once."""
    flat = queries.features(spark, SF).limit(60)
    flat.write.parquet(str(tmp_path / "flat"))
    flat = spark.read.parquet(str(tmp_path / "flat"))
    heads = queries.jobs.result_headers(d.sequences(spark, SF), flat).limit(5)
    results.write_results(results.nest_features(flat, heads), str(tmp_path / "in" / "unified"))
    queries._list_results(flat).write.json(str(tmp_path / "in" / "lists"))
    read = results.read_results(spark, [str(p) for p in (tmp_path / "in").glob("*/*.json")], json_lines=True)
    n_lists, n = flat.select("parent_id").distinct().count(), read.count()
    for parts in (1, 3):
        out = results.to_unified(read, parts)
        assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        sizes = out.select(F.size("features").alias("n")).agg(F.sum("n"), F.count("*")).first()
        want = read.where("format = 'unified'").select(F.size("features").alias("n")).agg(F.sum("n")).first()[0]
        assert sizes[0] == want + flat.where("has_start_codon").count()
        assert sizes[1] == n if parts == 1 else sizes[1] >= n
    assert n_lists > 0
