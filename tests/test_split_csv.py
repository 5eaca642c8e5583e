"""The splittable CSV reader against the csv module."""

import csv
import io
import random

import pytest

from namesieve.sources import datasets, split_csv


@pytest.fixture
def small_blocks(spark):
    sizes = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "8"}
    old = {k: spark.conf.get(k, None) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def made(rows, end, header=("ncid", "full_name", "note")):
    f = io.StringIO()
    w = csv.writer(f, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    return f.getvalue()


@pytest.mark.parametrize(("end", "mark"), [("\n", ""), ("\r\n", "﻿")])
def test_quoted_line_feeds_in_many_tasks(spark, tmp_path, small_blocks, end, mark):
    rnd = random.Random(3)
    kinds = ["Ann, Lee", 'say "hi"\nthere', "", "many\n\n,\nlines" * 40, "pläin", 'a""b', "\n\n", "x" * 300]
    rows = [(str(i), rnd.choice(kinds), rnd.choice(("a", "b\r\nc", ""))) for i in range(700)]
    rows[50] = ("50", "over several blocks\n" * 900, "z")
    path = str(tmp_path / "x.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(mark + made(rows, end).replace(f"{end}7,", f"{end}{end}7,"))  # and a blank line
    assert split_csv._lines(spark, path).rdd.getNumPartitions() >= 4
    got = split_csv.positions(split_csv.read_split(spark, path), "id").collect()
    assert got[0].__fields__ == ["ncid", "full_name", "note", "_record", "id"]
    got.sort(key=lambda r: r.id)
    assert [r.id for r in got] == list(range(700))
    assert [tuple(x or "" for x in tuple(r)[:3]) for r in got] == rows
    read = datasets.read_database(spark, path).collect()
    assert sorted((r.id, r.name) for r in read) == list(enumerate(n.strip(" ") for _, n, _ in rows if n.strip(" ")))


def test_files_of_a_folder_and_empty_ones(spark, tmp_path, small_blocks):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text(made([(f"{k}-{i}", f"name\n{i}") for i in range(200 * (2 - k) + 1)], "\n", ("a", "b")))
    rows = sorted(split_csv.read_split(spark, str(tmp_path)).collect(), key=lambda r: r._record)
    assert [r.a for r in rows] == [f"{k}-{i}" for k in range(3) for i in range(200 * (2 - k) + 1)] and rows[0].b == "name\n0"
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("")
    assert split_csv.read_split(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "none" / "x.csv").write_text("a,b\n")
    assert split_csv.read_split(spark, str(tmp_path / "none")).columns == ["a", "b", "_record"]
    with pytest.raises(ValueError):
        datasets.require_columns(split_csv.read_split(spark, str(tmp_path / "none")), ["c"], "x")
