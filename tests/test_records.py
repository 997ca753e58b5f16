"""CSV records over many tasks against Spark's own multi-line reader and Python's csv."""

import csv
import random

import pytest
from pyspark.sql.types import StructType

from screenloom.sources import records

SCHEMA = StructType().add("Id", "long").add("Text", "string").add("Last Part", "string")


def write(path, seed, rows, ends="\n", blank=False):
    rng = random.Random(seed)
    values = []
    for k in range(rows):
        text = "".join(rng.choice(["a", "é", ", ", "\n", '"', '""', "line\n\n", " ", "\r\n" if ends == "\n" else "x"]) for _ in range(rng.randrange(40)))
        values.append((k, text, rng.choice(["", "end", 'q"', "two\nlines"])))
    with path.open("w", newline="") as out:
        writer = csv.writer(out, lineterminator=ends)
        writer.writerow([f.name for f in SCHEMA])
        for row in values:
            writer.writerow(row)
            if blank and rng.random() < 0.1:
                out.write(ends)
    return values


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, str(size)) for k in before]
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("size", [64, 777, 20_000])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_equal_to_the_multi_line_reader(spark, tmp_path, small_ranges, size, ends):
    folder = tmp_path / "people"
    folder.mkdir()
    rows = 60 if size == 64 else 400
    values = [v for k in range(3) for v in write(folder / f"{k}.csv", k, rows, ends, blank=True)]
    small_ranges(size)
    read = records.read_csv(spark, str(folder), SCHEMA, placed=True)
    assert records.read_records(spark, str(folder)).select("start").distinct().count() > 1
    found = read.orderBy("_file", "_start", "_seq").drop("_file", "_start", "_seq").collect()
    small_ranges(1 << 27)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(SCHEMA)
    other = reader.csv([str(folder / f"{k}.csv") for k in range(3)]).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, other), key=repr)
    assert [r["Id"] for r in found] == [v[0] for v in values]
    assert [r["Text"] or "" for r in found] == [v[1] for v in values]


def test_one_record_over_many_ranges(spark, tmp_path, small_ranges):
    long_text = "\n".join(f'line {k} with ""quotes""' for k in range(2000))
    (tmp_path / "a.csv").write_text(f'Id,Text,Last Part\n1,"{long_text}",x\n2,b,c\n3,"never closed\nat all')
    small_ranges(500)
    found = records.read_csv(spark, str(tmp_path), SCHEMA).collect()
    assert sorted((r["Id"], len(r["Text"])) for r in found)[:2] == [(1, len(long_text.replace('""', '"'))), (2, 1)]
    assert len(found) == 3 and records.read_records(spark, str(tmp_path)).select("start").distinct().count() >= 1


def test_header_and_empty_files(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "only.csv").write_text("id,TEXT,Last Part\n")
    assert records.read_csv(spark, str(tmp_path), SCHEMA).collect() == []
    (tmp_path / "wrong.csv").write_text("Id,Other,Last Part\n1,a,b\n")
    with pytest.raises(Exception, match="another header"):
        records.read_csv(spark, str(tmp_path), SCHEMA).collect()
