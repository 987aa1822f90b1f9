"""Looking at the first rows of files, the commit of parts, and one file of many parts."""

import os
import random

import pytest

from tabveil.operators import files, masking
from tabveil.plans.model import Plan, Rule
from tabveil.sources import delimited

KEY = bytes(range(1, 33))


def big_file(path, n=60_000, eol="\r\n", encoding="utf-8"):
    rng = random.Random(2)
    lines = ["id,name,day"]
    for i in range(n):
        lines.append("" if i % 1000 == 7 else f"{i},x" if i % 1000 == 11 else f'{i:07d},"Na""me\n{rng.randint(0, 9)}, é",2024-01-{i % 28 + 1:02d}')
    with open(path, "wb") as f:
        f.write((eol.join(lines) + eol).encode(encoding))
    return str(path)


@pytest.mark.parametrize(("eol", "encoding"), [("\r\n", "utf-8"), ("\r", "utf-8"), ("\n", "utf-16-le")])
def test_the_first_rows_are_those_of_the_whole(spark, tmp_path, eol, encoding):
    path = big_file(tmp_path / "f.csv", eol=eol, encoding=encoding)
    whole = delimited.read_delimited(spark, path, skip_malformed=True)
    for n in (1, 20, 5000):
        first = delimited.read_first(spark, path, n)
        assert first.bytes_read <= (256 << 10 if n <= 20 else 1 << 20) < os.path.getsize(path)
        assert not first.whole and first.header == whole.header and first.dialect.eol == eol
        assert first.rows.orderBy("_rec").collect() == whole.rows.orderBy("_rec").limit(n).collect()
        last = whole.rows.orderBy("_rec").limit(n + 1).agg({"_rec": "max"}).first()[0]
        got, want = first.totals().first(), whole.records.filter(f"_rec < {last}")
        assert (got["n_rows"], got["n_blank"], got["n_malformed"]) == tuple(want.filter(f"kind = '{k}'").count() for k in ("data", "blank", "malformed"))


@pytest.mark.parametrize("content", ["a,b\n1,2\n", "a,b\n1,2", "a,b", "a,b\n\n1,2\n3\n", 'a,b\n1,"x\ny"\n'])
def test_small_files_are_whole(spark, tmp_path, content):
    path = tmp_path / "s.csv"
    path.write_text(content, newline="")
    first, whole = delimited.read_first(spark, str(path), 50), delimited.read_delimited(spark, str(path), skip_malformed=True)
    assert first.whole and first.bytes_read == len(content)
    assert first.rows.collect() == whole.rows.orderBy("_rec").collect() and first.totals().collect() == whole.totals().collect()


def test_errors_beyond_what_is_read_do_not_matter(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("a,b\n" + "1,2\n" * 200_000 + '3,"open', newline="")
    assert delimited.read_first(spark, str(path), 20).rows.count() == 20
    with pytest.raises(Exception, match="UnclosedQuote"):
        delimited.read_first(spark, str(path), 10**6)
    path.write_text("", newline="")
    with pytest.raises(Exception, match="MissingHeader"):
        delimited.read_first(spark, str(path), 5)


def test_profile_and_preview_of_a_file(spark, tmp_path):
    path = big_file(tmp_path / "f.csv", 6000)
    found = files.profile_file(spark, path, 2500)
    rows = {r["column"]: r for r in found.columns.collect()}
    assert not found.whole and all(r["estimated"] and r["n_rows"] == 2500 for r in rows.values()) and rows["day"]["type"] == "Date"
    totals = found.totals.first()
    assert (totals["n_rows"], totals["n_blank"], totals["n_malformed"], totals["malformed_records"]) == (2500, 3, 3, [13, 1013, 2013])
    all_of_it = files.profile_file(spark, path)
    assert all_of_it.whole and not any(r["estimated"] for r in all_of_it.columns.collect())
    plan = Plan({"id": Rule("HashId"), "name": Rule("Lorem"), "day": Rule("DateShift")})
    with masking.MaskingSession(spark, KEY) as session:
        early = files.preview_file(session, spark, path, plan, 30).collect()
        columns, report = files.mask_file(session, spark, path, plan, f"{tmp_path}/out", skip_malformed=True)
        assert not report.first()["has_failures"] and columns.count() == 3
        size = delimited.join_parts(spark, f"{tmp_path}/out", f"{tmp_path}/one.csv")
        assert size == os.path.getsize(tmp_path / "one.csv")
    one = delimited.read_delimited(spark, f"{tmp_path}/one.csv")
    got = [tuple(r)[1:] for r in one.rows.orderBy("_rec").limit(30).collect()]
    assert got == [tuple(r)[1:] for r in early]


def test_one_file_equals_its_source_byte_for_byte(spark, tmp_path):
    path = big_file(tmp_path / "f.csv", 30_000)
    table = delimited.read_delimited(spark, path, skip_malformed=True)
    named = delimited.write_delimited(table.records.repartition(6), table.dialect, f"{tmp_path}/parts")
    assert len(named) > 1 and [n for n, _ in named] == sorted(n for n, _ in named)
    assert sorted(os.listdir(tmp_path / "parts")) == [os.path.basename(n) for n, _ in named]
    delimited.join_parts(spark, f"{tmp_path}/parts", f"{tmp_path}/one.csv")
    assert (tmp_path / "one.csv").read_bytes() == open(path, "rb").read()
    assert sorted(f for f in os.listdir(tmp_path) if f.startswith("one")) == ["one.csv"]


def test_a_failed_write_leaves_no_part(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes("a,b\n".encode() + b"x,\xe9\n" * 3000)
    table = delimited.read_delimited(spark, str(path))
    assert table.dialect.encoding == "windows-1252"
    bad = table.records.selectExpr("file", "_rec", "kind", "eol", "transform(vals, v -> if(_rec = 2999, concat(v, 'ζ'), v)) as vals", "quoted")
    with pytest.raises(Exception, match="UnencodableOutput at record 2999"):
        delimited.write_delimited(bad.repartition(5), table.dialect, f"{tmp_path}/out")
    assert os.listdir(tmp_path / "out") == []
    delimited.write_delimited(table.records.repartition(5), table.dialect, f"{tmp_path}/out")
    assert b"".join((tmp_path / "out" / f).read_bytes() for f in sorted(os.listdir(tmp_path / "out"))) == path.read_bytes()


@pytest.mark.parametrize("ended", [True, False])
def test_files_with_carriage_returns_alone_are_split(spark, tmp_path, ended):
    rng = random.Random(3)
    lines = ["id,name"] + ["" if i % 90 == 5 else f'{i},"a\r{i},""b"' if rng.random() < 0.3 else f"{i},plain é" for i in range(20_000)]
    path = tmp_path / "mac.csv"
    path.write_bytes(("\r".join(lines) + ("\r" if ended else "")).encode())
    want = [(n, vals, quoted, eol) for n, vals, quoted, eol in delimited.parse(path.read_bytes().decode())]
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, "16k")
        pieces = spark.read.option("lineSep", "\r").text(str(path)).rdd.getNumPartitions()
        got = delimited.read_records(spark, str(path)).orderBy("_rec").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert pieces >= 10
    assert [(r["_rec"], [v if v is not None else "" for v in r["vals"]], r["quoted"], r["eol"]) for r in got] == want
    table = delimited.read_delimited(spark, str(path))
    delimited.write_delimited(table.records, table.dialect, f"{tmp_path}/out")
    delimited.join_parts(spark, f"{tmp_path}/out", f"{tmp_path}/again.csv")
    assert (tmp_path / "again.csv").read_bytes() == path.read_bytes()
