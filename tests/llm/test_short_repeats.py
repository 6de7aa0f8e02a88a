"""Short repeated units are returned too."""

from weft.llm.queries import QUERIES


def test_every_later_unit_is_returned(spark, tmp_path):
    table = [(1, "Short one. First text here."), (2, "Other words. Short one.\nsHORT  one.\nend"), (3, "end")]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op5_repeated_units"](spark, str(tmp_path)).collect())
    assert got == [(2, 13, 35, 2, 4, 1, 0), (3, 0, 3, 1, 1, 2, 36)]
