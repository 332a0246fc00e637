from datetime import datetime

import pytest

from graphloom.operators.clean import reject_report
from graphloom.sources.csv import read_csv, write_csv
from graphloom.sources.interactions import interactions_b_csv
from tests.conftest import SMALL

TEXT = "id bigint, text string, ts timestamp_ntz"


def test_round_trip_of_awkward_values(spark, tmp_path):
    rows = [
        (1, 'a "quoted", comma', datetime(2024, 1, 1, 1, 2, 3, 456789)),
        (2, "line\nbreak\n\n", datetime(2024, 1, 1)),
        (3, "  blanks  ", None),
        (4, "", datetime(1999, 12, 31, 23, 59, 59, 999999)),
        (5, None, None),
        (6, "back\\slash \\\" #", None),
        (7, "#not a comment", None),
        (8, "carriage\r\nreturn\r", None),
        (None, "no key", None),
    ]
    df = spark.createDataFrame(rows, TEXT)
    path = str(tmp_path / "t")
    write_csv(df, path)
    table = read_csv(spark, path, TEXT)
    assert table.bad.count() == 0
    assert sorted(map(str, table.rows.collect())) == sorted(map(str, df.collect()))


def test_small_files_for_free_text(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    path = str(tmp_path / "docs")
    write_csv(docs, path, max_bytes_per_file=200_000)
    assert len(list((tmp_path / "docs").glob("*.csv"))) >= 10
    back = read_csv(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert back.rows.exceptAll(docs).isEmpty()
    assert docs.exceptAll(back.rows).isEmpty()


def test_bad_rows_are_kept_apart(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b,c\n1,2,x\noops,2,x\n1,2\n1,2,x,9\n3,4,y\n")
    table = read_csv(spark, str(path), "a bigint, b int, c string", multiline=False)
    assert {tuple(r) for r in table.rows.collect()} == {(1, 2, "x"), (3, 4, "y")}
    assert {r[0] for r in table.bad.collect()} == {"oops,2,x", "1,2", "1,2,x,9"}
    # the same rows, whatever is selected
    assert table.rows.count() == table.rows.select("c").count() == table.rows.select("b").count() == 2
    assert table.bad.count() == 3


def test_another_header_is_an_error(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_csv(spark, str(path), "a bigint, b bigint").rows.collect()


def test_bad_rows_reach_the_report(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "part.csv").write_text(
        "event_id,ts,user_id,event_type,value,props\n"
        '1,2024-01-01T00:00:00.000000,5,view,1.0,"{""k"": 3}"\n'
        '2,2024-01-02T00:00:00.000000,5,view,1.0,"{""k"": 3}"\n'
        '3,2024-01-02T00:00:00.000000,5,view,1.0,"{""k"": ""none""}"\n'
        '4,2024-01-02T00:00:00.000000,five,view,1.0,"{""k"": 3}"\n'
    )
    table = interactions_b_csv(spark, str(tmp_path))
    report = {r.reason: r.n for r in reject_report(table.rows, "b", table.bad).collect()}
    assert report == {"bad_row": 1, "null_key": 1, "bad_rating": 0, "superseded": 1}
