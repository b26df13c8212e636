"""Queries give DuckDB's rows for texts that are blank, empty, null, of one character, or very long."""

import pytest

from marquetry.registry import ORACLES, QUERIES

TEXTS = ["", " ", "\n", " \n\t\n ", ".", "x", "x\n", None, "Ende. ", "A. B!\n" * 1500, "　\n"]


@pytest.mark.parametrize("name", ["predict_hits", "space_removed_hits", "stored_probabilities", "style_probabilities"])
def test_scored_places(spark, tmp_path, name):
    import duckdb

    rows = [(i, t, "de", "src0", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.select(*(f'"{x}"' for x in columns)).fetchall(), key=repr)


def test_batches_are_bounded_in_bytes(spark, tmp_path):
    """Of 3,000 texts of 10 kB no batch that Python gets has more than about BATCH_BYTES."""
    import pyarrow as pa

    from marquetry.queries.common import BATCH_BYTES, table

    spark.range(0, 3000, numPartitions=1).selectExpr("id as doc_id", "repeat('Ein Satz. ', 1000) as text").write.parquet(str(tmp_path / "documents.parquet"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    assert table(spark, str(tmp_path), "documents").mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 2 * BATCH_BYTES
