import pytest

from veridex.sources.tables import read_table


@pytest.mark.parametrize(("kind", "form"), [("parquet", "parquet"), ("orc", "orc"), ("jsonl", "json"), ("csv", "csv")])
def test_formats(spark, tmp_path, kind, form):
    df = spark.createDataFrame([(1, "a"), (2, "b, c")], "id int, text string")
    df.write.format(form).option("header", True).save(f"{tmp_path}/t.{kind}")
    assert sorted((r["id"], r["text"]) for r in read_table(spark, str(tmp_path), "t", kind).collect()) == [(1, "a"), (2, "b, c")]


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="none of"):
        read_table(spark, "x", "t", "xls")
