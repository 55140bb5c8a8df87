from __future__ import annotations

import io
import os
import random

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelloom import queries
from labelloom.operators.sampling import sample_exact
from labelloom.plans.flows import read_and_land
from labelloom.sources.contracts import read_contracts
from labelloom.sources.resolve import first_csv, require_columns, resolve_source
from labelloom.sources.write import config_table, export_split_text, with_config, write_config, write_csv
from tests.conftest import plan

HEADER = "filename,code,label_encoded\n"
BODY = """a,ok,5
b,too,many,1
b2,t,1,
b3,t,1,,
b4,t,1,x,y
c,short

   
q,"s = ""x"";
}",3
"u, 1","x,""y"",z",4
"v, 1","x",4,"surplus, too"
w,NA,2
x,5" pipe,4
"""
KEPT = {
    ("a", "ok", "5"),
    ("c", "short", None),
    ("q", 's = "x";\n}', "3"),
    ("u, 1", 'x,"y",z', "4"),
    ("w", None, "2"),
    ("x", '5" pipe', "4"),
}
SIZES = [None, 200]


@pytest.fixture
def write(tmp_path):
    def write(text, name="a.csv", encoding="utf-8"):
        (tmp_path / name).write_bytes(text.encode(encoding))
        return str(tmp_path)

    return write


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that records run over many of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}

    def set_size(size):
        if size is not None:
            spark.conf.set(names[0], str(size))
            spark.conf.set(names[1], "0")

    yield set_size
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("size", SIZES)
def test_bad_lines_are_skipped(spark, write, small_splits, size):
    small_splits(size)
    rows = read_contracts(spark, write(HEADER + BODY), "skip")
    assert set(map(tuple, rows.collect())) == KEPT
    assert rows.count() == len(KEPT)
    assert rows.select("label_encoded").count() == len(KEPT)


def test_bad_lines_raise_when_strict(spark, write):
    with pytest.raises(PySparkException, match="more than 3 fields"):
        read_contracts(spark, write(HEADER + BODY)).collect()


def cell(rnd, newline):
    kind = rnd.random()
    if kind < 0.3:
        return "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 6)))
    if kind < 0.4:
        return rnd.choice(["NA", "nan", "null", "Nan", "#N/A", " NA", 'x"y"z'])
    pieces = ["a", "b", ",", newline, newline * 2, '""', '""""', " ", f'"",{newline}"",', "é"]
    return '"' + "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) + '"'


def generated(rnd, newline):
    lines = rnd.choice([[], [], [""], ["", "  "]]) + [HEADER.strip()]
    for i in range(rnd.randint(3, 40)):
        fields = 3 if i == 0 else rnd.choice([3, 3, 3, 3, 2, 4, 1, 5])
        lines.append(",".join([str(i)] + [cell(rnd, newline) for _ in range(fields - 1)]))
        if rnd.random() < 0.1:
            lines.append(rnd.choice(["", " ", "   "]))
    return newline.join(lines) + rnd.choice(["", newline])


@pytest.mark.parametrize("seed", range(4))
def test_mixed_folders_agree_with_pandas(spark, write, small_splits, seed):
    rnd = random.Random(seed)
    expected = []
    for name in ("a.csv", "b.csv", "c.csv")[: 1 + seed % 3]:
        path = write(generated(rnd, rnd.choice(["\n", "\r\n"])), name)
        # Lines of white space alone are blank here, and only then is the next one the header.
        text = open(f"{path}/{name}", newline="").read().lstrip()
        frame = pd.read_csv(io.StringIO(text, newline=""), on_bad_lines="skip", engine="python", dtype=str)
        expected += [tuple(None if pd.isna(c) else c for c in row) for row in frame.itertuples(index=False)]
    ids = set()
    for size in SIZES:
        small_splits(size)
        got = read_contracts(spark, path, "skip", row_id="row_id").collect()
        assert sorted((tuple(r)[1:] for r in got), key=str) == sorted(expected, key=str)
        assert len({r.row_id for r in got}) == len(got)
        ids.add(tuple(sorted((r.row_id, tuple(r)[1:]) for r in got)) if got else ())
    assert len(ids) == 1


def test_a_cell_larger_than_many_splits(spark, write, small_splits):
    body = "line, with ""quotes""\n".replace('"', '""') * 100
    path = write(HEADER + f'a,"{body}",1\nb,x,2\nc,"{body}",3\n')
    small_splits(100)
    got = {r.filename: (r.code, r.label_encoded) for r in read_contracts(spark, path).collect()}
    text = body.replace('""', '"')
    assert got == {"a": (text, "1"), "b": ("x", "2"), "c": (text, "3")}


@pytest.mark.parametrize("before, after", [(200, 300), (300, 200)])
def test_splits_may_change_after_reading(spark, write, small_splits, before, after):
    path = write(HEADER + "".join(f'{i},"text,\n{i}",1\n' for i in range(50)))
    small_splits(before)
    rows = read_contracts(spark, path)
    small_splits(after)
    assert sorted(int(r.filename) for r in rows.collect()) == list(range(50))


@pytest.mark.parametrize("size", SIZES)
def test_a_quote_never_closed(spark, write, small_splits, size):
    path = write(HEADER + 'a,x,1\nb,"open,2\n' + "c,y,3\n" * 40)
    small_splits(size)
    got = {r.filename: r.code for r in read_contracts(spark, path, "skip").collect()}
    assert got == {"a": "x", "b": "open,2\n" + "c,y,3\n" * 39 + "c,y,3"}
    with pytest.raises((ValueError, PySparkException), match=r"over 100 bytes in file.*a\.csv"):
        read_contracts(spark, path, "skip", max_record_bytes=100)


def test_records_stay_where_they_were_read(spark, write):
    text = plan(read_contracts(spark, write(HEADER + BODY), "skip"))
    assert "Exchange hashpartitioning" not in text and "Sort" not in text
    assert text.count("from_csv") <= 2  # records of one split, and those over several


def test_encoding_fallback_is_per_file(spark, write):
    write(HEADER + "a,é€😀,1\n", "a.csv", "utf-8")
    path = write(HEADER + 'b,"grün\n, straße",2\nc,plain,3\n', "b.csv", "latin-1")
    got = read_contracts(spark, path, encoding="auto").collect()
    assert set(map(tuple, got)) == {("a", "é€😀", "1"), ("b", "grün\n, straße", "2"), ("c", "plain", "3")}


def test_named_encoding_and_byte_order_mark(spark, write):
    path = write(HEADER + "a,grün,1\n", encoding="latin-1")
    got = read_contracts(spark, path, encoding="ISO-8859-1").collect()
    assert [tuple(r) for r in got] == [("a", "grün", "1")]
    path = write("\ufeff" + HEADER + "a,x,1\n")
    assert read_contracts(spark, path).columns == ["filename", "code", "label_encoded"]
    with pytest.raises(ValueError, match="newline"):
        read_contracts(spark, path, encoding="UTF-16LE")


def test_a_landed_row_keeps_its_id(spark, write, small_splits, tmp_path):
    path = write(HEADER + "".join(f'{i},"cell\n{i}",1\n' for i in range(400)))
    samples = []
    for size in (300, 5000):
        small_splits(size)
        landed = read_and_land(spark, [path], str(tmp_path / f"landed-{size}"))
        samples.append({r.filename for r in sample_exact(landed, 50, 42, "row_id").collect()})
    assert samples[0] == samples[1]


def test_missing_and_unreadable_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_contracts(spark, str(tmp_path / "absent.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        read_contracts(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(ValueError):
        read_contracts(spark, str(tmp_path), on_bad_lines="warn")


def test_resolve(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER)
    found = resolve_source(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path)])
    assert found.endswith("b.csv")
    with pytest.raises(FileNotFoundError, match="a.csv"):
        resolve_source(spark, [str(tmp_path / "a.csv")])
    assert first_csv(["x.txt", "y.csv", "z.csv"]) == "y.csv"
    with pytest.raises(FileNotFoundError):
        first_csv(["x.txt"])


def test_require_columns(spark):
    rows = spark.createDataFrame([("x", 1)], "code string, other int")
    with pytest.raises(ValueError, match=r"label_encoded.*other"):
        require_columns(rows)
    assert require_columns(rows, ["code"]) is rows


def test_written_csv_reads_back(spark, tmp_path):
    cells = ["  edges  ", 'q"uo""te', "a,b", "line\nline\r\nline\rline", "\\back\\", "\t", None, "é😀"]
    rows = spark.createDataFrame([(str(i), c, "1") for i, c in enumerate(cells)], "filename string, code string, label_encoded string")
    path = str(tmp_path / "written")
    write_csv(rows, path)
    assert [r.code for r in read_contracts(spark, path).orderBy("filename").collect()] == cells


def test_config(spark, tmp_path):
    config = {"model": "m", "size": 0.2, "seed": 42, "max_samples": None, "flag": True, "parts": ["q", "v"]}
    rows = config_table(spark, config)
    assert rows.first().asDict() == config
    path = str(tmp_path / "config")
    write_config(rows, path)
    assert spark.read.schema(rows.schema).json(path).first().asDict() == config
    assert '"max_samples":null' in spark.read.text(path).first().value
    figures = spark.range(3).agg(F.count("*").alias("rows"))
    assert with_config(figures, config).first().asDict() == {**config, "rows": 3}


def test_export_has_one_folder_per_part(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", 1), ("test", "b", 2)], "split string, text string, x int")
    path = tmp_path / "out"
    export_split_text(rows, str(path))
    assert {p.name for p in path.iterdir() if p.is_dir()} == {"split=train", "split=test"}
    assert spark.read.parquet(str(path / "split=test")).columns == ["text"]


def test_split_records_are_written_by_every_task(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def spied(session, path, *args, **kwargs):
        names = session.read.text(path).inputFiles()
        split = int(session.conf.get("spark.sql.files.maxPartitionBytes"))
        seen.append((split, [os.path.getsize(name.removeprefix("file://")) for name in names]))
        return read_contracts(session, path, *args, **kwargs)

    monkeypatch.setattr(queries, "read_contracts", spied)
    got = queries.csv_split_records(spark, str(tmp_path)).collect()
    ((split, sizes),) = seen
    assert len(sizes) == 4 and all(size > 3 * split for size in sizes)
    monkeypatch.undo()
    want = queries.csv_roundtrip(spark, str(tmp_path)).collect()
    # Row ids name files, so they differ between any two writes.
    columns = [c for c in got[0].asDict() if c != "row_id"]
    assert sorted(str([r[c] for c in columns]) for r in got) == sorted(str([r[c] for c in columns]) for r in want)
