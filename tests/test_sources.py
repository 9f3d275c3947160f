import json
from datetime import datetime

import pandas as pd
import pytest

from tidemill.roles import ROW, data_columns
from tidemill.sources import csv, datasets
from tidemill.streaming.cleaning import clean_rows
from tidemill import CleanSpec


def written(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def loaded(spark, path):
    df = csv.read_csv(spark, path)
    return df.orderBy(ROW).drop(ROW)


SAMPLES = {
    "types": "i,f,b,s,g,e\n1,1.5,True,a,1,\n2,2,false,b,,\n 3,1e3,TRUE,c,3,\n",
    "tokens": "x,y\nNA,1\n#N/A,2\nnull,3\n<NA>,4\nnone,5\n",
    "quotes": 'a,b\n"x, ""y""",1\nplain,2\n',
    "breaks": 'a,b\n"one\ntwo",1\nthree,2\n',
    "repeated": "a,a,a.1,,b\n1,2,3,4,5\n",
    "short": "a,b,c\n1,2,3\n4,5\n",
    "huge": "a,b\n123456789012345678901,1\n5,inf\n",
    "unsigned": "a,b,c,d,e\n18446744073709551615,1,9223372036854775808,9223372036854775808,1.5\n5,-2,-1,x,10000000000000000000\n",
    "spaces": "a,b\n x ,1\n  , 2 \n",
    "mixed_bool": "a,b\nTrue,1\nyes,2\n",
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_read_like_a_data_frame(spark, tmp_path, name):
    path = written(tmp_path, SAMPLES[name])
    df, want = loaded(spark, path), pd.read_csv(path)
    assert df.columns == want.columns.tolist()
    kinds = {"bigint": "int64", "double": "float64", "boolean": "bool", "string": "object", "decimal(20,0)": "uint64"}
    assert [kinds[t] for _, t in df.dtypes] == [str(t) for t in want.dtypes]
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)]
    assert [tuple(r) for r in df.collect()] == rows


def test_unsigned_numbers_survive_a_round_trip(spark, tmp_path):
    df = spark.sql("SELECT CAST(18446744073709551615 AS DECIMAL(20,0)) AS n, 0L AS _row UNION ALL SELECT 7, 1L")
    path = datasets.save_dataset(df, str(tmp_path / "numbers"), preserve_types=False)
    assert datasets.sidecar(df) == {"n": "uint64"} == datasets.read_sidecar(spark, path)
    back = datasets.load_dataset(spark, path)
    assert back.schema["n"].dataType.simpleString() == "decimal(20,0)"
    assert [int(r.n) for r in back.orderBy(ROW).collect()] == [2**64 - 1, 7]


def test_rows_wider_than_the_header_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        csv.read_csv(spark, written(tmp_path, "a,b\n1,2\n1,2,3\n"))


def test_headers():
    assert csv.unique_headers(["a", "A", "a", "a.1", None, "b"]) == ["a", "A.2", "a.3", "a.1", "Unnamed: 4", "b"]


def test_sidecar_is_applied(spark, tmp_path):
    path = written(tmp_path, "code,day,n,x\n007,2024-01-02,1,5\n012,oops,z,6\n")
    (tmp_path / "in.schema.json").write_text(
        json.dumps({"code": "string", "day": "datetime64[ns]", "n": "float64", "x": "Int64", "gone": "int64"})
    )
    df = datasets.load_dataset(spark, path)
    assert dict(df.dtypes) | {ROW: ""} == {"code": "string", "day": "timestamp_ntz", "n": "double", "x": "bigint", ROW: ""}
    assert [tuple(r) for r in df.orderBy(ROW).drop(ROW).collect()] == [
        ("7", datetime(2024, 1, 2), 1.0, 5),
        ("12", None, None, 6),
    ]


def test_unreadable_sidecar_is_ignored(spark, tmp_path):
    path = written(tmp_path, "a\n1\n")
    (tmp_path / "in.schema.json").write_text("{broken")
    assert datasets.load_dataset(spark, path).first()["a"] == 1


@pytest.mark.parametrize("preserve", [True, False])
def test_save_makes_a_new_version(spark, tmp_path, preserve):
    schema = f"{ROW} bigint, s string, f double, b boolean, t timestamp_ntz, `odd name.1` string"
    data = [
        (0, "a, \"b\"\n c", 12345678.5, True, datetime(2024, 1, 2, 3, 4, 5), " pad "),
        (1, None, None, False, None, "x"),
    ]
    df = spark.createDataFrame(data, schema)
    first = datasets.save_dataset(df, str(tmp_path / "d"), preserve)
    second = datasets.save_dataset(datasets.load_dataset(spark, first), str(tmp_path / "d"), preserve)
    assert first != second
    back = datasets.load_dataset(spark, second)
    names = [n for n in df.columns if n != ROW]
    found = {tuple(r) for r in back.select(*[f"`{n}`" for n in names]).collect()}
    assert found == {d[1:] for d in data}


def test_other_formats_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, str(tmp_path / "a.xml"), "xml")
    with pytest.raises(TypeError):
        datasets.register([("v", spark.createDataFrame([([1.0],)], "v array<double>"))])


def test_stream_cleaning_matches_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, " a ", " 5 "), (2, "  ", "x"), (3, "b", None)], "`My Id` int, name string, n string")
    source = str(tmp_path / "in")
    df.write.parquet(source)
    spec = CleanSpec(
        fill_missing="zero", fill_categorical="unknown", remove_duplicates=False, trim_whitespace=True,
        text_case="upper", normalize_headers=True, convert_column="n", convert_type="number", round_numeric=True,
    )
    stream = clean_rows(spark.readStream.schema(df.schema).parquet(source), spec)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [(1, "A", 5.0), (2, "Unknown", 0.0), (3, "B", 0.0)]
    with pytest.raises(ValueError):
        clean_rows(df, CleanSpec())


def test_csv_row_order_over_files_of_unequal_size(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    start = 0
    for i, n in enumerate((3, 4000, 10)):
        lines = [f'{k},5" pipe {k}' for k in range(start, start + n)]
        (folder / f"f{i}.csv").write_text("\n".join(["a,b", *lines]) + "\n")
        start += n
    df = datasets.load_dataset(spark, str(folder), "csv")
    rows = df.orderBy("_row").collect()
    assert [r.a for r in rows] == list(range(start))
    assert rows[3].b == '5" pipe 3'
    out = datasets.save_dataset(df.repartition(7), str(tmp_path / "saved"), preserve_types=False)
    again = datasets.load_dataset(spark, out)
    assert [r.a for r in again.orderBy("_row").collect()] == list(range(start))


@pytest.mark.parametrize(
    ("line", "spans"),
    [('a,"b', True), ('a,5" b', False), ('"a ""x"" b",c', False), ('"a","b ""', True), ("a,b", False), ('5" a,"b,c', True)],
)
def test_quoted_line_breaks(spark, tmp_path, line, spans):
    (tmp_path / "x.csv").write_text(line + "\n")
    assert csv._has_quoted_line_breaks(spark, str(tmp_path / "x.csv")) is spans


def test_a_column_named_like_the_row_position_stays_data(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("_row,b\nx,1\ny,2\n")
    df = datasets.load_dataset(spark, str(path))
    assert data_columns(df) == ["_row.1", "b"] and sorted(r["_row.1"] for r in df.collect()) == ["x", "y"]
    with pytest.raises(TypeError, match="kept for the row position"):
        datasets.register([("t", spark.createDataFrame([("x", 1)], "_row string, b int"))])
