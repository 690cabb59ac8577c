"""CSV / TXT / JSON readers on files written by the tests (FIXTURES.md F5)."""

import json

import pytest

from tabscope.sources import readers

CSV = """customer_id,order_date,region,quantity,price,active,const,num_text
1,2024-01-05,North,3,9.5,True,k,10
2,2024-01-06,NA,N/A,10.0,False,k,20
3,null,South,,11.25,True,k,30
4,2024-01-08,  East,7,NA,False,k,40
"""


def test_csv_and_txt(spark, tmp_path):
    for ext in ("csv", "txt"):
        p = tmp_path / f"data.{ext}"
        p.write_text(CSV)
        df = readers.read_table(spark, str(p))
        types = dict(df.dtypes)
        assert types["customer_id"] == "bigint" and types["quantity"] == "bigint"
        assert types["price"] == "double" and types["active"] == "boolean"
        assert types["order_date"] == "string" and types["num_text"] == "bigint"
        rows = df.orderBy("customer_id").collect()
        assert rows[1]["region"] is None and rows[1]["quantity"] is None
        assert rows[2]["order_date"] is None and rows[2]["quantity"] is None
        assert rows[3]["price"] is None and rows[3]["region"] == "  East"


def test_csv_quotes_newlines_and_codes(spark, tmp_path):
    p = tmp_path / "quoted.csv"
    p.write_text('id,note,code\n1,"a ""b"" c",12D\n2,"x, ""y"", z",3F\n3,"two\nlines",7D\n4,plain\n')
    df = readers.scan_csv(spark, str(p)).orderBy("id")
    assert dict(df.dtypes) == {"id": "bigint", "note": "string", "code": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, 'a "b" c', "12D"), (2, 'x, "y", z', "3F"),
                                                (3, "two\nlines", "7D"), (4, "plain", None)]


def test_csv_with_too_many_fields_raises(spark, tmp_path):
    for name, body in (("a", "1,x\n2,y,z\n"), ("b", '1,"p\nq"\n2,y,z\n')):
        p = tmp_path / f"{name}.csv"
        p.write_text("id,note\n" + body)
        with pytest.raises(ValueError, match="more than 2 fields"):
            readers.scan_csv(spark, str(p))


def test_json_array_and_lines(spark, tmp_path):
    recs = [{"customer_id": 1, "region": "North", "price": 9.5},
            {"customer_id": 2, "region": None, "price": 10.0}]
    arr = tmp_path / "a.json"
    arr.write_text(json.dumps(recs))
    lines = tmp_path / "l.json"
    lines.write_text("\n".join(json.dumps(r) for r in recs))
    for p in (arr, lines):
        df = readers.read_table(spark, str(p))
        assert df.count() == 2
        assert set(df.columns) == {"customer_id", "region", "price"}
    assert readers.scan_json(spark, str(lines)).columns == ["customer_id", "region", "price"]


def test_shape_schema_preview(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k bigint, s string")
    assert tuple(readers.table_shape(df).first()) == (3, 2)
    assert [r["data_type"] for r in readers.schema_table(spark, df).collect()] == ["bigint", "string"]
    assert [r["k"] for r in readers.preview_head(df, 2).collect()] == [1, 2]
