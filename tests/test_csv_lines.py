"""The parallel CSV reader against the csv module on whole files."""

import csv
import io
import os
import random

import pytest

from factlake import session
from factlake.sources import csv_lines, tables


def by_hand(text):
    reader = csv.DictReader(io.StringIO(text, newline=""), restkey="")
    return [{k: v for k, v in row.items() if k != ""} for row in reader], [f for f in reader.fieldnames or [] if f != ""]


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Small splits for the files themselves, not for what is stored of them."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = [spark.conf.get(n) for n in names]

    def start(size):
        def kept(df, name):
            for n in names:
                spark.conf.set(n, str(size))
            try:
                return session.stored(df, name)
            finally:
                for n, value in zip(names, old, strict=True):
                    spark.conf.set(n, value)

        monkeypatch.setattr(csv_lines, "stored", kept)

    return start


def made_file(rng, names, rows):
    cells = ["", "plain", "two words", "a,b", "line\nbreak", "\n", "\n\n\n", 'say "hi"', '"', '""', ",", "x" * 60, "ä\U0001f600", "\r\n", "end\r"]
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(names)
    for _ in range(rows):
        writer.writerow([rng.choice(cells) for _ in range(rng.choice([len(names), len(names), max(1, len(names) - 1), len(names) + 1]))])
        if rng.random() < 0.1:
            out.write("\n")
        if rng.random() < 0.1:
            out.write('size 5" tall,"closed" then more,"a""b\n')
            out.write('still inside",5" again\n')
    return out.getvalue()


@pytest.mark.parametrize("size", [90, 700, 1 << 20])
def test_same_as_csv_module(spark, folder, small_splits, size):
    rng, want = random.Random(size), {}
    for i, names in enumerate((["name", "note"], ["name", "note", "k"], ["note", "name"], ["name", "name", "Company"])):
        text = made_file(rng, names, 60)
        with open(os.path.join(folder, f"f{i}.csv"), "w", newline="", encoding="utf-8") as file:
            file.write(text)
        want[f"f{i}.csv"] = by_hand(text)
    small_splits(size)
    df = tables.read_csv(spark, folder)
    assert df.columns == [tables.FILE, tables.ROW_NO, "name", "note", "k", "Company"]
    got = {}
    for r in df.collect():
        got.setdefault(os.path.basename(r[tables.FILE]), {})[r[tables.ROW_NO]] = r
    assert sorted(got) == sorted(want)
    for name, (rows, header) in want.items():
        assert sorted(got[name]) == list(range(1, len(rows) + 1))
        for i, row in enumerate(rows, 1):
            assert {h: got[name][i][h] for h in set(header)} == {h: row[h] for h in set(header)}, (name, i)
            assert all(got[name][i][h] is None for h in df.columns[2:] if h not in header)


def test_many_tasks_share_a_file(spark, folder, small_splits):
    with open(os.path.join(folder, "a.csv"), "w", encoding="utf-8") as file:
        file.write("name,id\n" + "".join(f'"row\n""{i}""\nend",{i}\n' for i in range(1, 4001)))
    small_splits(8192)
    rows = csv_lines.read_rows(spark, folder)
    assert rows.filter("row_no > 0").count() == 4000
    assert rows.filter("row_no > 0 AND row_no <> CAST(cells[1] AS BIGINT)").count() == 0


def test_states_of_a_line():
    for line, out, inside in (("a,b", False, True), ('a,"b', True, False), ('"a', True, False), ('a"b,c', False, False), ('""', False, True),
                              ('"a""b"', False, False), ('x"",y"', False, False), ('",', True, False), (',"', True, False), ("", False, True)):
        assert csv_lines.first_state(line) == out, line
        assert csv_lines.ends_inside(line, True) == inside, line


def test_empty_files(spark, folder):
    for name, text in (("a.csv", ""), ("b.csv", "\n\n"), ("c.csv", "name\n")):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
            file.write(text)
    df = tables.read_csv(spark, folder)
    assert df.count() == 0 and df.columns[2:] == ["name"]
