"""Lenient CSV: files cut into many chunks give the rows of the serial parser; headers of their own; line ends, quotes and byte order marks anywhere."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tagweave.sources import csvs, readers

PIECES = ["a", "b c", '"x"', '"x,y"', '8"', '"8" bore, TBD"', '"multi\nline"', '"multi\r\nli""ne"', "", '" "', '"q"z"', "é中", '"two\n\nlines\r"']
ENDS = ["\n", "\r\n", "\r", "\n\n", " \n"]


@pytest.fixture
def small_chunks(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def written(folder, texts):
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    return str(folder)


def test_rows_equal_the_serial_parser(spark, tmp_path, small_chunks):
    rng = random.Random(1)
    texts = {}
    for k in range(6):
        text = "﻿" * (k % 2) + "".join(",".join(rng.choice(PIECES) for _ in range(rng.randint(1, 4))) + rng.choice(ENDS) for _ in range(120))
        texts[f"f{k}.csv"] = text.rstrip("\r\n")
    texts["open.csv"] = "h,i\n1,2\n" + '"never closed, ' + "x\n" * 900 + "end"
    texts["long.csv"] = 'a,"' + 'long "" field,\n' * 200 + '",z\nlast,one'
    texts["empty.csv"], texts["blank.csv"], texts["one.csv"] = "", "\n \r\n,,\n", 'h,"i\nj"'
    got: dict = {}
    for r in csvs.rows_of(spark, written(tmp_path, texts)).collect():
        got.setdefault(os.path.basename(r["file"]), {})[r["row_seq"]] = r["cells"]
    for name, text in texts.items():
        rows = got.get(name, {})
        assert sorted(rows) == list(range(-1, len(rows) - 1)) and [rows[k] for k in sorted(rows)] == csvs.cells_of(text), name


def test_states_compose_from_any_cut():
    rng = random.Random(2)
    for _ in range(300):
        line = "".join(rng.choice('"",a \r') for _ in range(rng.randint(0, 12)))
        for state in (0, 1):
            ends, after = csvs.scan(line, state)
            whole = ('"' if state else "") + line + '\n",x'  # what follows tells the state
            assert all(line[e - 1] == "\r" for e in ends)
            rows = csvs.cells_of(whole + "Z")
            assert (after == 1) == (rows[-1][-1] == "xZ" and "\n" in rows[-1][-2]), (line, state)


def test_each_file_has_its_own_header(spark, tmp_path):
    path = written(tmp_path, {"a.csv": "Tag,Panel\nPT-1,P1\n", "b.csv": "panel,x,TAG,tag\nP2,y,old,PT-2\nP3\n"})
    got = {r["tag"]: r["panel"] for r in readers.seed_list(spark, path).collect()}
    assert got == {"PT-1": "P1", "PT-2": "P2", "": "P3"}
    with pytest.raises(ValueError, match="c.csv"):
        readers.seed_list(spark, written(tmp_path, {"c.csv": "Function\nx\n"}))


def test_line_lists_of_both_kinds_in_one_folder(spark, tmp_path):
    path = written(tmp_path, {"a.txt": "4\"-IA-0334, 8\"-G-0331\n8\"-G-0331\n\n2\"-BD-1", "b.csv": 'Line Number,Service\n6"-G-7,Gas\n'})
    got = readers.line_list(spark, path).orderBy("drawing_id", "row_seq").collect()
    assert [r["line_number"] for r in got] == ['4"-IA-0334', '8"-G-0331', '2"-BD-1', '6"-G-7'] and got[-1]["service"] == "Gas"


def test_one_large_file_takes_many_tasks(spark, tmp_path, small_chunks):
    text = "n,t\n" + "".join(f'{k},"{"x" * (k % 50)}\n{k}"\n' for k in range(3000))
    rows = csvs.rows_of(spark, written(tmp_path, {"big.csv": text}))
    assert csvs.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 50
    assert rows.count() == 3001 and rows.filter("row_seq >= 0").select(F.sum(F.get("cells", F.lit(0)).cast("long"))).first()[0] == sum(range(3000))


def test_natural_order_of_long_numbers(spark):
    from tagweave.functions import scalars as S

    names = ["a2", "a10", "a" + "9" * 25, "a1" + "0" * 25, "a007", "a7", "b1", "A3", "a"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.natural_key(F.col("n"))).collect()]
    assert got == ["a", "a2", "A3", "a007", "a7", "a10", "a" + "9" * 25, "a1" + "0" * 25, "b1"]
