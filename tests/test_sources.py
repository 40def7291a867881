"""Delimited text in, CSV and JSON out."""

import json
import random

import pytest

from tabsense.sources import delimited, records, sinks
from tabsense.operators.quality import clean_table, types_of


def write(tmp_path, text, encoding="utf-8", name="t.csv"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


MESSY = """customer_id,join_date,age,monthly_charges,total_charges,contract,churn
K-1,2023-01-15,34,75.50,906.00,Month-to-month,No
K-2,15/02/2023,  45 ,89.00,1068.00,One year,Yes
K-3,2023/03/10,,29.99,None,Month-to-month,No
K-2,15/02/2023,  45 ,89.00,1068.00,One year,Yes
K-5,2023-05-12,52,missing,1500.20,Month-to-month,Yes
"""


def test_messy_file(spark, tmp_path):
    df = delimited.load_delimited(spark, write(tmp_path, MESSY))
    assert dict(df.dtypes) == {
        "customer_id": "string", "join_date": "string", "age": "bigint", "monthly_charges": "string",
        "total_charges": "double", "contract": "string", "churn": "string",
    }
    assert df.count() == 5 and df.where("age IS NULL").count() == 1 and df.where("total_charges IS NULL").count() == 1
    t = types_of(df)
    assert (t["join_date"], t["monthly_charges"], t["churn"], t["contract"]) == ("datetime", "numeric", "boolean", "categorical")
    cleaned = clean_table(df)
    assert cleaned.count() == 4 and cleaned.where("monthly_charges IS NULL").count() == 1


@pytest.mark.parametrize("d", [",", "\t", ";", "|"])
def test_delimiters(spark, tmp_path, d):
    text = "\n".join(d.join(r) for r in [["name", "score", "passed"], ["a", "1", "True"], ["b", "2.5", "False"]])
    df = delimited.load_delimited(spark, write(tmp_path, text))
    assert dict(df.dtypes) == {"name": "string", "score": "double", "passed": "boolean"} and df.count() == 2


def test_quoted_delimiters_do_not_mislead():
    assert delimited.sniff_delimiter(['a;b', '"x,y,z";1', '"p,q,r";2']) == ";"


def test_bad_lines_and_header(spark, tmp_path):
    df = delimited.load_delimited(spark, write(tmp_path, " a , b \n1,2\n1,2,3\n4\n"))
    assert df.columns == ["a", "b"] and sorted(map(tuple, df.collect()), key=str) == [(1, 2), (4, None)]


def test_line_breaks_inside_cells(spark, tmp_path):
    write(tmp_path, 'a,b,c\n1,"line one\nline ""two"", x",5\n2,plain,6\n', name="1.csv")
    write(tmp_path, "a,b,c\n3,y,7\n", name="2 x.csv")
    df = delimited.load_delimited(spark, str(tmp_path))
    rows = sorted(map(tuple, df.collect()))
    assert rows == [(1, 'line one\nline "two", x', 5), (2, "plain", 6), (3, "y", 7)]
    assert df.count() == 3 and delimited.load_delimited(spark, str(tmp_path / "1.csv")).count() == 2


def test_too_long_lines(spark, tmp_path):
    text = 'a,b\n1,"x, ""y"""\n3,4,,9\n5,6,,\n"7,7",8,"",""\n9,"p,q",r\n'
    df = delimited.read_text_table(spark, write(tmp_path, text))
    assert sorted(map(tuple, df.collect())) == [("1", 'x, "y"'), ("5", "6"), ("7,7", "8")]
    assert df.count() == 3 and sorted(r["b"] for r in df.select("b").collect()) == ["6", "8", 'x, "y"']


def test_a_padded_na_text_is_kept(spark, tmp_path):
    df = delimited.load_delimited(spark, write(tmp_path, "a,b\n N/A ,1\nN/A,2\nx,3\n"))
    assert [r["a"] for r in df.orderBy("b").collect()] == [" N/A ", None, "x"]


def test_encodings(spark, tmp_path):
    text = "name,n\ncafé,1\nnaïve,2\n"
    for encoding in ("utf-8", "utf-8-sig", "latin1"):
        df = delimited.load_delimited(spark, write(tmp_path, text, encoding, f"{encoding}.csv"))
        assert df.columns == ["name", "n"] and {r["name"] for r in df.collect()} == {"café", "naïve"}


def test_folder_of_files(spark, tmp_path):
    write(tmp_path, "a,b\n1,x\n", name="1.csv")
    write(tmp_path, "a,b\n2,y\n", name="2.csv")
    assert delimited.load_delimited(spark, str(tmp_path)).count() == 2


def test_errors(spark, tmp_path):
    with pytest.raises(delimited.SourceError):
        delimited.load_delimited(spark, str(tmp_path / "none.csv"))
    with pytest.raises(delimited.SourceError):
        delimited.load_delimited(spark, write(tmp_path, ""))
    with pytest.raises(delimited.SourceError):
        delimited.load_delimited(spark, write(tmp_path, "a,b\n", name="head.csv"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(600)], "id int, t string")
    records = [json.loads(r["record"]) for r in sinks.json_records(df, ["id"]).collect()]
    assert len(records) == 500 and records[1] == {"id": 1, "t": None}
    sinks.export_csv(df, str(tmp_path / "out"), ["id"], ["id"], 10)
    assert delimited.load_delimited(spark, str(tmp_path / "out")).count() == 10
    sinks.write_tables({"all": df}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/all")).count() == 600


def test_files_of_one_folder_in_their_own_ways(spark, tmp_path):
    write(tmp_path, "id,name,n\n1,é,5\n", name="1.csv")
    write(tmp_path, "name;id\né;2\nz;3\n", "latin1", "2 b.csv")
    write(tmp_path, 'id\tname\tnote\n4\t"a\tb"\t"x\ny"\n', name="3[c].csv")
    write(tmp_path, "﻿id,name,n\r\n5,w,7\r\n6,v,\r\n", name="4.csv")
    write(tmp_path, "\n\n", name="5.csv")
    df = delimited.load_delimited(spark, str(tmp_path))
    assert df.columns == ["id", "name", "n", "note"] and df.count() == 6
    rows = sorted(map(tuple, df.collect()))
    assert rows == [(1, "é", 5, None), (2, "é", None, None), (3, "z", None, None), (4, "a\tb", None, "x\ny"), (5, "w", 7, None), (6, "v", None, None)]


def plain_records(text, d=","):
    """Lines joined while a cell is open, character by character."""
    out, held, state = [], "", "F"
    for ch in text:
        if ch == "\n" and state != "Q":
            out.append(held)
            held, state = "", "F"
            continue
        held += ch
        if state == "Q":
            state = "C" if ch == '"' else "Q"
        elif ch == d:
            state = "F"
        elif ch == '"' and state in "FC":
            state = "Q"
        else:
            state = "U"
    return [r for r in [*out, held] if r.strip("\r")]


@pytest.mark.parametrize("seed", range(3))
def test_records_across_splits(spark, tmp_path, seed):
    rng = random.Random(seed)
    pieces = ['a,b', '"x\ny"', '"""', ',', '\n', '\n', 'z', '"', '""', ',"q', '5" pipe,', '"u"v"w', "\n\n", "é"]
    text = "id,v\n" + "".join(rng.choice(pieces) for _ in range(3_000)) + "z"
    path = write(tmp_path, text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        lines = records.lines_of(spark, path)
        assert lines.rdd.getNumPartitions() > 4
        got = records.split_records(lines, ",", chunk_bytes=200).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(bytes(r["record"]).decode() for r in got) == sorted(plain_records(text))
    assert [bytes(r["record"]) for r in got if r["first"]] == [b"id,v"]


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    text = "k,note\n" + "".join(f'{i},"line {i}\nand ""{i}"", more"\n' if i % 3 else f"{i},plain\n" for i in range(4_000))
    path = write(tmp_path, text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = delimited.read_text_table(spark, path)
        assert records.lines_of(spark, path).rdd.getNumPartitions() >= 5
        rows = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    assert rows == sorted(map(tuple, whole.collect())) and len(rows) == 4_000


def test_an_unclosed_cell_goes_to_the_end(spark, tmp_path):
    df = delimited.read_text_table(spark, write(tmp_path, 'a,b\n1,x\n2,"y\n3,z\n'))
    assert sorted(map(tuple, df.collect())) == [("1", "x"), ("2", "y\n3,z")]
