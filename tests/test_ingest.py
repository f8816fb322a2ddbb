import datetime as dt

from pyspark.sql import functions as F

from tablecraft.sources import delimited, typing


def column(df, name):
    return [r[0] for r in df.select(f"`{name}`").collect()]


def test_numbers_as_text(spark):
    df = spark.createDataFrame([("1", "1.5", "1", "1"), ("2", "2.0", None, "2"), ("3", "-3", "3", "apple")], "x string, y string, z string, w string")
    out = typing.coerce_numbers(df)
    assert dict(out.dtypes) == {"x": "bigint", "y": "double", "z": "bigint", "w": "string"}
    assert column(out, "z") == [1, None, 3]


def test_all_missing_text_stays(spark):
    df = spark.createDataFrame([(None,), (None,)], "x string")
    assert dict(typing.coerce_numbers(df).dtypes) == {"x": "string"}
    assert typing.logical_types(df) == {"x": "categorical"}


def test_exponent_and_trailing_point_are_text(spark):
    df = spark.createDataFrame([("1e5", "5.")], "x string, y string")
    assert dict(typing.coerce_numbers(df).dtypes) == {"x": "string", "y": "string"}


def test_unique_names():
    assert typing.unique_names(["a", "a", "b"]) == ["a", "a.1", "b"]
    assert len(set(typing.unique_names(["x", "x", "x.1"]))) == 3


def test_serial_dates_need_a_date_name(spark):
    df = spark.createDataFrame([(44000 + i, 44000 + i) for i in range(200)], "order_date int, price int")
    out = typing.serial_dates(df)
    assert dict(out.dtypes) == {"order_date": "timestamp_ntz", "price": "int"}
    assert out.agg(F.min("order_date")).head()[0] == dt.datetime(2020, 6, 18)


def test_width_is_not_a_date():
    assert not typing.date_named("width")
    assert typing.date_named("order_date") and typing.date_named("orderDate") and typing.date_named("created_at")


def test_finalize(spark):
    df = spark.createDataFrame([("1", "x", "9")], "a string, b string, c string").toDF("a", "b", "a")
    out = typing.finalize(df)
    assert out.columns == ["a", "b", "a.1"]
    assert dict(out.dtypes) == {"a": "bigint", "b": "string", "a.1": "bigint"}


def test_date_formats(spark):
    rows = [("2024-03-05", "05/03/2024 10:20:30", "5 Mar 2024", "Mar 5, 2024", "10:30:00")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    out = typing.convert_dates(df).head()
    assert out["a"] == dt.datetime(2024, 3, 5) and out["c"] == out["d"] == out["a"]
    assert out["b"] == dt.datetime(2024, 3, 5, 10, 20, 30)
    assert out["e"] == dt.datetime(1900, 1, 1, 10, 30)


def test_read_semicolons_and_latin1(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b;c\n1;x;2.5\n3;y;NA\n")
    out = delimited.read_delimited(spark, str(tmp_path / "a.csv"))
    assert dict(out.dtypes) == {"a": "bigint", "b": "string", "c": "double"}
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "x", 2.5), (3, "y", None)]
    (tmp_path / "b.csv").write_bytes("n\xe9,v\ncaf\xe9,1\n".encode("latin-1"))
    out = delimited.read_delimited(spark, str(tmp_path / "b.csv"))
    assert out.columns == ["né", "v"] and out.head()[0] == "café"


def test_duplicate_header_and_no_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,a,"b, c"\n1,2,"x, y"\n')
    out = delimited.read_delimited(spark, str(tmp_path / "a.csv"))
    assert out.columns == ["a", "a.1", "b, c"] and tuple(out.head()) == (1, 2, "x, y")
    out = delimited.read_delimited(spark, str(tmp_path / "a.csv"), header=False)
    assert out.columns == ["0", "1", "2"] and out.count() == 2


def test_more_date_shapes(spark):
    given = {
        "05/01/2024 10:30": (2024, 5, 1, 10, 30), "05-01-2024 10:30:00": (2024, 5, 1, 10, 30), "5-Jan-2024": (2024, 1, 5),
        "1/5/24": (2024, 1, 5), "1/5/99": (1999, 1, 5), "Jan-05-2024": (2024, 1, 5), "10:30": (1900, 1, 1, 10, 30), "10:30 PM": (1900, 1, 1, 22, 30),
    }
    df = spark.createDataFrame([tuple(given)], [f"c{i}" for i in range(len(given))])
    assert list(typing.convert_dates(df).head()) == [dt.datetime(*want) for want in given.values()]
    plain = df.select(*[typing.parsed_date(F.col(c)) for c in df.columns])
    assert list(plain.head()) == [dt.datetime(*want) for want in given.values()]


def test_texts_that_are_no_dates(spark):
    df = spark.createDataFrame([("no date", "1" * 70, "99:99", "13/13/24", "")], "a string, b string, c string, d string, e string")
    assert typing.convert_dates(df).dtypes == df.dtypes
    assert list(df.select(*[typing.parsed_date(F.col(c)) for c in df.columns]).head()) == [None] * 5


def test_files_of_unlike_dialects_are_one_table(spark, tmp_path):
    """Delimiter, encoding and columns per file; names with blanks and brackets."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a comma.csv").write_text('id,name,price\n1,"Café, small",1.5\n2,x,NA\n', encoding="utf-8")
    (folder / "b[1].csv").write_text("price;id;extra\n2.5;3;yes\n3.5;4;no\n", encoding="utf-8")
    (folder / "c_latin.csv").write_bytes("id\tname\n5\tGröße\n6\tÉté\n".encode("latin-1"))
    (folder / "d_empty.csv").write_text("")
    out = delimited.read_delimited(spark, str(folder))
    assert out.columns == ["id", "name", "price", "extra"] and dict(out.dtypes)["id"] == "bigint" and dict(out.dtypes)["price"] == "double"
    assert sorted(map(tuple, out.collect())) == [
        (1, "Café, small", 1.5, None), (2, "x", None, None), (3, None, 2.5, "yes"), (4, None, 3.5, "no"), (5, "Größe", None, None), (6, "Été", None, None)]
    found = {r.file.rsplit("/", 1)[1]: (r.encoding, r.delimiter) for r in delimited.file_dialects(spark, str(folder)).collect()}
    assert found == {"a comma.csv": ("UTF-8", ","), "b[1].csv": ("UTF-8", ";"), "c_latin.csv": ("ISO-8859-1", "\t")}


def test_unlike_files_without_header(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,x\n2,y\n")
    (tmp_path / "in" / "b.csv").write_text("3|z|0.5\n4|w|1.5\n")
    out = delimited.read_delimited(spark, str(tmp_path / "in"), header=False)
    assert sorted(map(tuple, out.collect())) == [(1, "x", None), (2, "y", None), (3, "z", 0.5), (4, "w", 1.5)]
