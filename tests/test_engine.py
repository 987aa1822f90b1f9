import base64
import hashlib
import os
import random
import threading
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabveil.functions import labels, seeds, strategies
from tabveil.functions.binding import inline, staged
from tabveil.operators import jobs, mapping, masking, spaces, tables, verify
from tabveil.operators import profile as profiling
from tabveil.operators.secret import SessionClosed
from tabveil.plans import model, recipes
from tabveil.plans.model import DateShiftOptions, EntityGroup, FakeOptions, PerturbOptions, Plan, PlanError, RedactOptions, Rule
from tabveil.sources import delimited
from tabveil.streaming.masked_stream import mask_stream

KEY = bytes(range(1, 33))


def frame(spark, columns, rows):
    return spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], "_rec long, " + ", ".join(f"`{c}` string" for c in columns))


def outputs(masked, *columns):
    return [tuple(r[c] for c in columns) for r in masked.rows.orderBy("_rec").collect()]


def sequential(plan, rows, columns):
    """The plain greedy walk, in record and column order."""
    used, known, out = {}, {}, []
    for row in rows:
        line = []
        for c, v in zip(columns, row, strict=True):
            rule = plan.columns[c]
            if not rule.is_mapping or v is None or not v.strip():
                line.append(v)
                continue
            group, domain = plan.group_of(c), plan.mapping_domain(c)
            anchor = row[columns.index(group.anchor)] if group else None
            anchor = anchor if anchor and anchor.strip() else None
            seed = (group.domain, anchor) if anchor else (rule.domain or c, v)
            key = (domain, anchor, v)
            if key not in known:
                taken = used.setdefault((domain, anchor), set())
                for n in range(10_001):
                    o = strategies.choice(rule, KEY, v, *seed, n)
                    if o is None or (o != v and o not in taken):
                        break
                if o is not None:
                    taken.add(o)
                known[key] = o
            line.append(model.REDACTED if known[key] is None else known[key])
        out.append(tuple(line))
    return out


@pytest.mark.parametrize("small", [20_000, 0])
@pytest.mark.parametrize("parts", [1, 7])
def test_mapping_equals_the_sequential_walk(spark, monkeypatch, small, parts):
    monkeypatch.setattr(mapping.resolve, "__defaults__", (None, mapping.MOST_ENTRIES, small))
    rng = random.Random(3)
    columns = ["id", "alt", "city", "zip", "phone"]
    rows = [(f"{rng.randint(10, 90)}", f"{rng.randint(10, 60)}", rng.choice(["Paris", "Rome", "OSLO", "bonn", f"Town {rng.randint(0, 60)}"]), rng.choice(["02134", "213", "02134-9999", "junk"]), rng.choice(["555-1234", "n/a", None, " "])) for _ in range(150)]
    plan = Plan({"id": Rule("HashId", None, "d"), "alt": Rule("HashId", None, "d"), "city": Rule("Fake", FakeOptions("City")), "zip": Rule("ZipRemap"), "phone": Rule("Fake", FakeOptions("Phone"))})
    got = outputs(masking.mask(frame(spark, columns, rows).repartition(parts), plan, KEY), *columns)
    assert got == sequential(plan, rows, columns)


def test_large_classes_have_the_walk_s_answer_however_long_their_lists(spark, monkeypatch):
    """899 of 900 outputs taken: the last values try over 500 entries. Names: about 40 values a base name."""
    rounds = []
    monkeypatch.setattr(mapping, "cut", lambda df, label, cut=mapping.cut: (rounds.append(label), cut(df, label))[1])
    for rule, rows in ((Rule("HashId"), [(str(100 + i * 7 % 899),) for i in range(899)]), (Rule("Fake", FakeOptions("PersonFirst")), [(f"Ada {i}",) for i in range(2000)])):
        plan = Plan({"id": rule})
        got = {r["value"]: (r["output"], r["n"]) for r in mapping.resolve(frame(spark, ["id"], rows), plan, KEY, small=0).collect()}
        assert {v: o for v, (o, _) in got.items()} == {v: o for (v,), (o,) in zip(rows, sequential(plan, rows, ["id"]), strict=True)}
        assert max(n for _, n in got.values()) > (500 if rule.strategy == "HashId" else 80)
    assert rounds.count("mapping-round") <= 80


def test_linked_columns(spark):
    columns = ["id", "first", "full", "amount", "day"]
    rng = random.Random(4)
    rows = [(str(100 + i % 9) if i % 11 else None, f"F{i % 9}", f"N{i % 9}", "100.00", "2024-05-15") for i in range(80)]
    plan = Plan(
        {"id": Rule("HashId"), "first": Rule("Fake", FakeOptions("PersonFirst")), "full": Rule("Fake", FakeOptions("PersonFull")), "amount": Rule("Perturb", PerturbOptions(mode="PerEntity")), "day": Rule("DateShift", DateShiftOptions(60, "PerEntity"))},
        (EntityGroup("id", ("first", "full", "amount", "day")),),
    )
    rng.shuffle(rows)
    masked = masking.mask(frame(spark, columns, rows), plan, KEY)
    got = outputs(masked, *columns)
    names = [(a, b, c) for a, b, c, _, _ in got]
    assert names == [(a, b, c) for a, b, c, *_ in sequential(Plan({k: v if v.is_mapping else Rule("Keep") for k, v in plan.columns.items()}, plan.groups), rows, columns)]
    per_id = {}
    for (i, _, _, amount, day), (src, *_) in zip(got, rows, strict=True):
        assert per_id.setdefault(src, (i, amount, day)) == (i, amount, day)
    assert all(full.split()[0] == first for i, first, full in names if i) and len({v[2] for v in per_id.values()}) > 3


def test_pass_through_and_report(spark):
    columns = ["k", "r", "l", "p", "n"]
    rows = [("a", "secret", "Some Words here", "10", "x"), ("b", None, "", "N/A", " "), ("a", "", " ", None, None), ("c", " ", None, "20.5", "y")]
    plan = Plan({"k": Rule("Keep"), "r": Rule("Redact", RedactOptions("***")), "l": Rule("Lorem"), "p": Rule("Perturb", PerturbOptions(mode="Global")), "n": Rule("HashId")})
    masked = masking.mask(frame(spark, columns, rows), plan, KEY)
    got = outputs(masked, *columns)
    for g, s in zip(got, rows, strict=True):
        assert all(a == b for a, b in zip(g, s, strict=True) if b is None or not b.strip())
    assert got[0][1] == "***" and len(got[0][2]) == 15 and got[0][2][0].isupper() and got[1][3] == model.REDACTED
    report = {r["column"]: r for r in masked.verification().collect()}
    assert all(r["failures"] == [] and r["n_rows"] == 4 for r in report.values())
    assert report["p"]["n_unmaskable"] == 1 and report["p"]["source_sum"] == 30.5 and report["p"]["warnings"]
    assert (report["r"]["source_nulls"], report["r"]["output_nulls"]) == (1, 1)


def test_unmaskable_values_of_a_mapping_fail_the_report(spark):
    masked = masking.mask(frame(spark, ["z"], [("02134",), ("x",), ("y",), ("x",)]), Plan({"z": Rule("ZipRemap")}), KEY)
    row = masked.verification().first()
    assert row["failures"] == ["Distinct count changed"] and row["n_unmaskable"] == 3 and len(row["warnings"]) == 2


def test_limits(spark):
    full = frame(spark, ["d"], [(str(i),) for i in range(10)] + [("a",)])
    with pytest.raises(mapping.MappingLimitExceeded, match="'d'"):
        masking.mask(full, Plan({"d": Rule("HashId")}), KEY, most_entries=5)
    with pytest.raises(mapping.UniqueValueExhausted, match="'z'"):
        masking.mask(frame(spark, ["z"], [(f"021{i:02d}",) for i in range(100)] + [("02100",), ("02199",)] + [("021" + c,) for c in "00 11".split()] + [(f"021{i:02d}",) for i in range(100)]), Plan({"z": Rule("ZipRemap")}), bytes(32), {"021": []}).rows.count()
        raise mapping.UniqueValueExhausted("z")  # a full space may just work out; both outcomes are within the rules


def test_order_and_partitions_do_not_matter(spark):
    rows = [(f"ID-{i % 37:05d}", f"user{i % 29}@corp.com", f"{i * 1.25:.2f}", f"{i % 12 + 1}/{i % 28 + 1}/2023") for i in range(200)]
    columns = ["id", "mail", "amount", "day"]
    plan = Plan({"id": Rule("HashId"), "mail": Rule("Fake", FakeOptions("Email")), "amount": Rule("Perturb"), "day": Rule("DateShift")})
    df = frame(spark, columns, rows)
    a, b, c = (outputs(masking.mask(x, plan, KEY), *columns) for x in (df.coalesce(1), df.repartition(5), df.orderBy(F.rand(1))))
    assert a == b == c
    assert [tuple(r[k] for k in columns) for r in masking.preview(df, plan, KEY, 15).collect()] == a[:15]
    for i in (0, 1):
        pairs = {(s[i], o[i]) for s, o in zip(rows, a, strict=True)}
        assert len(pairs) == len({s for s, _ in pairs}) == len({o for _, o in pairs}) and not any(s == o for s, o in pairs)


def test_plan_problems():
    header = ["a", "b", "c", "d"]
    keep = {c: Rule("Keep") for c in header}
    bad = [
        (Plan({c: keep[c] for c in "abc"}), "no rule for 'd'"), (Plan(keep | {"x": Rule("Keep")}), "the file lacks"), (Plan(keep | {"a": Rule("Fake")}), "has no defaults"),
        (Plan(keep | {"a": Rule("Fake", FakeOptions("Nobody"))}), "no such kind"), (Plan(keep | {"a": Rule("Perturb", PerturbOptions(1.0))}), "percent"),
        (Plan(keep | {"a": Rule("DateShift", DateShiftOptions(0))}), "less than 1"), (Plan(keep | {"a": Rule("DateShift", DateShiftOptions(6, keep_weekday=True))}), "7 or more"),
        (Plan(keep | {"a": Rule("Keep", RedactOptions())}), "takes no RedactOptions"), (Plan(keep | {"a": Rule("HashId", None, " ")}), "blank"), (Plan(keep | {"a": Rule("Perturb", PerturbOptions(mode="PerEntity"))}), "in no group"),
        (Plan(keep | {"a": Rule("HashId", None, "m"), "b": Rule("ZipRemap", None, "m")}), "disagree"), (Plan(keep, (EntityGroup("z", ("a",)),)), "has no 'z'"), (Plan(keep, (EntityGroup("a", ()),)), "empty"),
        (Plan(keep, (EntityGroup("a", ("a",)),)), "its own anchor"), (Plan(keep, (EntityGroup("a", ("b",)), EntityGroup("b", ("c",)))), "the anchor of another"), (Plan(keep, (EntityGroup("a", ("c",)), EntityGroup("b", ("c",)))), "in 2 groups"),
        (Plan(keep, (EntityGroup("a", ("b",)), EntityGroup("a", ("c",)))), "anchors 2 groups"), (Plan(keep | {"b": Rule("HashId", None, "m")}, (EntityGroup("a", ("b",)),)), "no domain of its own"), (Plan(keep | {"a": Rule("Melt")}), "is called Melt"),
    ]
    assert model.problems(Plan(keep), header) == []
    for plan, part in bad:
        assert any(part in p for p in model.problems(plan, header)), part
    with pytest.raises(PlanError):
        model.validate(bad[0][0], header)


def corpus():
    """(column name, values, type); 200 values each."""
    many = lambda f: [f(i) for i in range(200)]
    return [
        ("Contact", many(lambda i: f"user{i}@corp.com"), "Email"), ("Zip_Code", many(lambda i: f"{2000 + i:05d}"), "Zip"), ("Place", many(lambda i: f"{2000 + i:05d}-1234"), "Zip"), ("Account_No", many(lambda i: f"{20000 + i}"), "Identifier"),
        ("Phone", many(lambda i: f"555{i:07d}"), "Phone"), ("Reach", many(lambda i: f"(555) {100 + i}-{1000 + i}"), "Phone"), ("Digits", many(lambda i: f"555{i:07d}"), "Identifier"), ("When", many(lambda i: f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}"), "Date"),
        ("Stamp", many(lambda i: f"2024-01-{i % 28 + 1:02d} 10:{i % 60:02d}"), "DateTime"), ("Order_Date", many(lambda i: f"202401{i % 28 + 1:02d}"), "Date"), ("Batch", many(lambda i: f"{2000 + i // 28}{i % 12 + 1:02d}{i % 28 + 1:02d}"), "Identifier"),
        ("Active", many(lambda i: "YN"[i % 2]), "Boolean"), ("Flag", many(lambda i: ["true", "FALSE"][i % 2]), "Boolean"), ("St", many(lambda i: ["CA", "NY", "TX", "WA", "OR"][i % 5]), "State"), ("State", many(lambda i: ["CA", "NY"][i % 2]), "State"),
        ("Customer_Name", many(lambda i: f"Corp {i}"), "OrgName"), ("Owner_Name", many(lambda i: f"Ann {i}"), "PersonName"), ("City", many(lambda i: f"Town{i}"), "City"), ("Street", many(lambda i: f"{i} Main"), "Address"),
        ("Qty", many(lambda i: str(i % 90)), "Count"), ("Amount", many(lambda i: str(i % 60)), "Measure"), ("Rate", many(lambda i: f"{i / 7:.3f}"), "Measure"), ("Pay", many(lambda i: f"${i}"), "Measure"), ("Region", many(lambda i: f"R{i % 4}"), "Categorical"),
        ("Year", many(lambda i: str(2000 + i % 20)), "Categorical"), ("Notes", many(lambda i: f"a longer note number {i} with words"), "FreeText"), ("Word", many(lambda i: f"w{'abcdefghij'[i % 10]}{i}"), "Text"), ("Seq", many(lambda i: str(i)), "Identifier"),
        ("Product_Code", many(lambda i: f"P{i}"), "Identifier"), ("Empty", [None, "", " ", None, ""] * 40, "Empty"), ("Padded", many(lambda i: f"{i:06d}"), "Identifier"),
    ]


def test_types(spark):
    cases = corpus()
    rows = list(zip(*[v for _, v, _ in cases], strict=True))
    profiled = profiling.profile(frame(spark, [n for n, _, _ in cases], rows))
    got = {r["column"]: r["type"] for r in profiled.collect()}
    assert {n: got[n] for n, _, t in cases if got[n] != t} == {}
    plan = profiling.suggested_plan(profiled)
    assert model.problems(plan, [n for n, _, _ in cases]) == [] and plan.columns["Word"].strategy == "Redact" and plan.columns["Qty"].options.is_count


def test_profile_of_a_sample(spark):
    rows = [(str(i), None if i % 4 == 0 else "" if i % 4 == 1 else f"v{i}") for i in range(100)]
    p = {r["column"]: r for r in profiling.profile(frame(spark, ["id", "x"], rows), 40, with_samples=True).collect()}
    assert (p["x"]["n_rows"], p["x"]["n_null"], p["x"]["n_blank"], p["x"]["n_values"], p["x"]["estimated"]) == (40, 10, 10, 20, True)
    assert p["x"]["samples"] == ["v2", "v3", "v6", "v7", "v10"]
    assert [r["n_rows"] for r in profiling.profile(frame(spark, ["id", "x"], []).limit(0)).collect()] == [0, 0]
    whole = profiling.profile(frame(spark, ["id", "x"], rows), None).collect()
    assert [r["n_rows"] for r in whole] == [100, 100]


def test_date_give_up_runs_over_slices(spark):
    """a fails early and b late only, many slices on; c stays above 95 %."""
    df = spark.range(60_000).selectExpr("id + 2 as _rec", "if(id % 25 < 4 and id < 30000, 'x', '2024-05-15') as a_date", "if(id >= 50000, 'x', '2024-05-15') as b_date", "if(id >= 59000, 'x', '2024-05-15') as c_date").repartition(5)
    found = profiling.date_give_up(df)
    assert {r["column"]: r["gave_up"] for r in found.collect()} == {"a_date": True, "b_date": True, "c_date": False}
    assert "hashpartitioning(column#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", slice#" in plan


def test_registered_types_look_at_all_rows(spark, tmp_path):
    """Dates that turn into words after row 50,000; and dates that fall short early, in a whole table."""
    from tabveil import queries

    o = spark.range(60_000).selectExpr("id as o_orderkey", "id % 700 as o_custkey", "'O' as o_orderstatus", "id / 7 as o_totalprice", "if(id < 52000, '2024-05-15', 'none') as o_orderdate", "'1-URGENT' as o_orderpriority")
    cells = o.selectExpr("o_orderkey + 2 as _rec", *[f"cast({c} as string) as {c}" for c in o.columns])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "table", lambda spark, d, name: o)
        m.setattr(queries, "canonical", lambda df: cells.drop("_rec"))
        got = {r["column"]: r["type"] for r in queries.type_detect_orders(spark, "").collect()}
    assert got["o_orderdate"] == "Categorical"
    early = spark.range(20_000).selectExpr("id + 2 as _rec", "if(id < 40, 'x', '2024-05-15') as day")
    assert [r["type"] for r in profiling.profile(early, None).collect()] == [r["type"] for r in profiling.profile(early).collect()] != ["Date"]


def test_entity_groups():
    types = {"Customer_ID": "Identifier", "Customer_Name": "OrgName", "Customer_Email": "Email", "Customer_City": "City", "Account_Owner_ID": "Identifier", "Account_Owner_Name": "PersonName", "Seq_Code": "Identifier", "ID": "Identifier"}
    assert profiling.entity_groups(types) == (EntityGroup("Customer_ID", ("Customer_Name", "Customer_Email")), EntityGroup("Account_Owner_ID", ("Account_Owner_Name",)))


def test_recipes(tmp_path):
    header = ["Id", "Name", "Name", "When"]
    plan = Plan({"Id": Rule("HashId"), "Name": Rule("Fake", FakeOptions("City")), "Name#2": Rule("Redact"), "When": Rule("DateShift", DateShiftOptions(9, formats=("yyyy-MM-dd",)))}, (EntityGroup("Id", ("Name",)),))
    recipe = recipes.from_plan("  mine ", "Ann", header, plan)
    store = recipes.Store(str(tmp_path))
    store.save(recipe, "ann")
    (tmp_path / "bad.json").write_text("{")
    found, bad = store.all()
    assert found == [recipe] and bad == 1 and recipe.name == "mine"
    with pytest.raises(PermissionError):
        store.save(recipe, "bob")
    other = [" name", "NAME ", "id", "Extra"]
    keep = Plan({k: Rule("Keep") for k in ("name", "NAME", "id", "Extra")})
    made, dropped = recipes.apply(recipe, [o.strip() for o in other], keep)
    assert made.columns["name"].strategy == "Fake" and made.columns["NAME"].strategy == "Redact" and made.columns["Extra"].strategy == "Keep" and made.groups == (EntityGroup("id", ("name",)),) and dropped == 0
    assert recipes.best([recipe], header) == recipe and recipes.best([recipe], ["q"]) is None
    assert store.delete(recipe.id, "ANN") and store.all()[0] == []


ROUND_TRIPS = [
    "a,b\r\n1,2\r\n", "a,b\n1,2", "a\tb\n1\t2\n", "a;b\n1;2\n", "a|b\r1|2\r", 'a,b\n"x,y","q""q"\n', 'a,b\n"line\nbreak",2\r\n3,4\n', 'a,b\n"",\n,""\n', "a,b\n\n1,2\n\n", 'a,b\nx"y,z\n', "a\n\n1\n", 'a,a,\n1,2,3\n', '"a","b"\n1,2\n', "a,b\n1,2\n3\n4,5,6\n",
]


@pytest.mark.parametrize("encoding,mark", [("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\x00\x00")])
def test_files_round_trip(spark, tmp_path, encoding, mark):
    for i, content in enumerate([*ROUND_TRIPS, "é,ü\nñ,日本\n"]):
        data = mark + content.encode(encoding)
        (tmp_path / f"{i}.csv").write_bytes(data)
        assert delimited.detect_encoding(data) == (encoding, mark)
    for i in (5, 6, 13, len(ROUND_TRIPS)):
        path = str(tmp_path / f"{i}.csv")
        table = delimited.read_delimited(spark, path, skip_malformed=True)
        folder = tmp_path / f"out{i}"
        delimited.write_delimited(table.records, table.dialect, str(folder))
        assert b"".join(p.read_bytes() for p in sorted(folder.glob("part-*"))) == (tmp_path / f"{i}.csv").read_bytes()


def test_all_texts_round_trip_as_records(spark, tmp_path):
    for i, content in enumerate(ROUND_TRIPS):
        (tmp_path / f"{i:02d}.csv").write_bytes(content.encode())
    for i, content in enumerate(ROUND_TRIPS):
        d = delimited.detect_dialect(content.encode())
        text = "".join(d.delimiter.join('"' + v.replace('"', '""') + '"' if q else v for v, q in zip(vals, quoted, strict=True)) + eol for _, vals, quoted, eol in delimited.parse(content, d.delimiter))
        assert text == content
    kinds = Counter((r["file"][-6:-4], r["kind"]) for r in delimited.read_records(spark, str(tmp_path)).collect())
    assert kinds["08", "blank"] == 2 and kinds["13", "malformed"] == 2 and kinds["10", "data"] == 2


@pytest.fixture
def small_splits(spark):
    kept = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
    for n, v in kept.items():
        spark.conf.set(n, v)


def as_read(content: bytes, d: delimited.Dialect) -> list[tuple]:
    out = []
    for record, vals, quoted, eol in delimited.parse(delimited.decode(content[len(d.mark) :], d.encoding), d.delimiter):
        out.append((record, [None if v == "" and not q else v for v, q in zip(vals, quoted, strict=True)], quoted, eol))
    return out


@pytest.mark.parametrize("mark,encoding,size", [(b"", "utf-8", 400), (b"\xef\xbb\xbf", "utf-8", 250), (b"", "windows-1252", 600)])
def test_splits_give_the_records_of_the_whole(spark, tmp_path, small_splits, mark, encoding, size):
    rng = random.Random(size)
    cell = lambda: rng.choice(["", '""', "a", "é", "x'y", '"p,q"', '"r\ns"', '"t""u"', '"\r\n\n"', 'v"w', '"' + "z\n" * rng.randint(0, 30) + '"'])
    content = "k,é,m\n" + "".join(",".join(cell() for _ in range(rng.choice([3, 3, 3, 1, 2]))) + rng.choice(["\n", "\r\n", "\n", "\r"]) for _ in range(120)) + rng.choice(["", "1,2,3"])
    data = mark + delimited.encode(content, encoding)
    (tmp_path / "f.csv").write_bytes(data)
    small_splits(size)
    table = delimited.read_delimited(spark, str(tmp_path / "f.csv"), skip_malformed=True)
    assert (table.dialect.encoding, table.dialect.mark) == (encoding, mark)
    assert [(r["_rec"], r["vals"], r["quoted"], r["eol"]) for r in table.records.orderBy("_rec").collect()] == as_read(data, table.dialect)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path / "f.csv")).rdd.getNumPartitions() > 3
    delimited.write_delimited(table.records, table.dialect, str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))) == data


@pytest.mark.parametrize("content,said", [
    (b'a,b\n1,2\n3,"x\ny\n' + b"z\n" * 40, "UnclosedQuote at record 3, field 2"), (b'a,b\n1,2\n"x\n"y,2\n' + b"1,2\n" * 40, "TextAfterClosingQuote at record 3, field 1"),
    (b"a,b\n" + b"1,2\n" * 40 + b"x" * 60 + b",1\n1,2\n", "RecordTooLarge at record 42"), (b"\xef\xbb\xbfa,b\n" + b"1,2\n" * 40 + b"\xe9,1\n", "UndecodableInput at record 42"),
    (b"a,b\n" + b"1,2\n" * 40 + b"1\n1,2\n", "FieldCountMismatch at record 42"), (b"", "MissingHeader at record 1"), (b"\xef\xbb\xbf", "MissingHeader at record 1"),
])
def test_errors_name_their_record_in_any_split(spark, tmp_path, small_splits, content, said):
    (tmp_path / "f.csv").write_bytes(content)
    for size in (60, 1 << 20):
        small_splits(size)
        with pytest.raises(Exception, match=said):
            delimited.read_delimited(spark, str(tmp_path / "f.csv"), most_chars=50)


def test_encodings_without_a_mark(spark, tmp_path):
    text = "name,n\n" + "é" * 10 + ",1\n"
    for encoding in ("utf-16-le", "utf-16-be", "utf-8"):
        data = ("plain,n\nabc,1\n" if encoding != "utf-8" else text).encode(encoding)
        (tmp_path / "f.csv").write_bytes(data)
        table = delimited.read_delimited(spark, str(tmp_path / "f.csv"))
        assert table.dialect.encoding == encoding and table.rows.count() == 1
    assert delimited.detect_encoding("é".encode() * 40_000) == ("utf-8", b"")  # a character over the edge of two pieces
    assert delimited.detect_encoding("ab é".encode()[:-1]) == ("windows-1252", b"") and delimited.detect_encoding("ab é".encode()[:-1], False) == ("utf-8", b"")


def test_header_names_that_spark_would_confuse(spark, tmp_path):
    content = b"Name,name,_rec,a`b,\nA,b,c,d,e\n"
    (tmp_path / "f.csv").write_bytes(content)
    table = delimited.read_delimited(spark, str(tmp_path / "f.csv"))
    assert table.keys == ["Name", "name", "_rec", "a`b", "Column5"] and table.columns == ["Name", "_c2", "_c3", "_c4", "Column5"]
    plan = Plan({c: Rule("Keep") for c in table.columns} | {"_c2": Rule("HashId"), "_c4": Rule("Redact")})
    masked = masking.mask(table.rows, plan, KEY)
    delimited.write_delimited(delimited.masked_records(table, masked.rows), table.dialect, str(tmp_path / "out"))
    out = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert out.startswith(b"Name,name,_rec,a`b,\nA,") and out.endswith(b",c,[REDACTED],e\n") and out != content


def test_writing_checks_what_it_writes(spark, tmp_path):
    records = spark.createDataFrame([(1, "header", "\n", ["a"], [False]), (2, "data", "", ["1"], [False]), (3, "data", "\n", ["2"], [False])], "_rec long, kind string, eol string, vals array<string>, quoted array<boolean>")
    with pytest.raises(delimited.DelimitedError, match="UnterminatedRecord at record 2"):
        delimited.write_delimited(records, delimited.Dialect(), str(tmp_path / "a"))
    delimited.write_delimited(records.limit(0), delimited.Dialect(mark=b"\xef\xbb\xbf"), str(tmp_path / "b"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "b").glob("part-*"))) == b"\xef\xbb\xbf"
    with pytest.raises(FileExistsError):
        delimited.write_delimited(records, delimited.Dialect(), str(tmp_path / "b"))


def test_windows_1252(tmp_path):
    data = b"a,b\n\xe9,\x81\x8d\n"
    assert delimited.detect_encoding(data) == ("windows-1252", b"") and delimited.encode(delimited.decode(data, "windows-1252"), "windows-1252") == data


@pytest.mark.parametrize("content,kind,record,field", [('a,b\n1,"x', "UnclosedQuote", 2, 2), ('a,b\n"x"y,2', "TextAfterClosingQuote", 2, 1), ("a,b\n" + "x" * 50, "RecordTooLarge", 2, 0)])
def test_malformed_text(content, kind, record, field):
    with pytest.raises(delimited.DelimitedError) as e:
        list(delimited.parse(content, ",", 40))
    assert (e.value.kind, e.value.record, e.value.field) == (kind, record, field)


def test_masking_a_file(spark, tmp_path):
    content = b'id,note\r\n"001",secret\n\n002,""\r\n003,"more, secret"\n'
    (tmp_path / "f.csv").write_bytes(content)
    table = delimited.read_delimited(spark, str(tmp_path / "f.csv"))
    masked = masking.mask(table.rows, Plan({"id": Rule("Keep"), "note": Rule("Redact", RedactOptions("x"))}), KEY)
    delimited.write_delimited(delimited.masked_records(table, masked.rows), table.dialect, str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))) == b'id,note\r\n"001",x\n\n002,""\r\n003,"x"\n'
    assert table.totals().first()[:3] == (3, 1, 0)


def test_streams(spark, tmp_path):
    df = frame(spark, ["day", "amount"], [("2024-01-05", "10.00"), ("x", ""), (None, "5")])
    df.write.parquet(str(tmp_path / "in"))
    plan = Plan({"day": Rule("DateShift"), "amount": Rule("Perturb", PerturbOptions(mode="Global"))})
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = mask_stream(stream, plan, KEY).writeStream.format("memory").queryName("masked_rows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("masked_rows").collect()))
    assert got == sorted((i + 2, *r) for i, r in enumerate(outputs(masking.mask(df, plan, KEY), "day", "amount")))
    with pytest.raises(PlanError):
        mask_stream(stream, Plan({"day": Rule("HashId"), "amount": Rule("Keep")}), KEY)


def test_plan_helpers():
    assert model.shared_domains({"a": "b", "b": "c", "x": "y", "y": "x"}) == {"a": "c", "b": "c", "x": "y", "y": "x"}
    plan = Plan({"id": Rule("HashId"), "city": Rule("Fake", FakeOptions("City")), "name": Rule("Fake", FakeOptions("PersonFull"))}, (EntityGroup("id", ("city", "name")),))
    assert model.strategy_tally(plan) == {"HashId": 1, "Fake": 2}
    notes = model.link_notes(plan, {"id": 100, "city": 5, "name": 90})
    assert "distribution" in notes["city"] and "same invented person" in notes["name"]
    assert [delimited.masked_name(n) for n in ("a.csv", "b.TSV", "c", "d.xlsx")] == ["a_masked.csv", "b_masked.tsv", "c_masked.csv", "d_masked.csv"]


def test_jobs_report_progress_and_can_be_cancelled(spark):
    said = []
    job = jobs.Job(spark, lambda: spark.range(100).count(), lambda done, known: said.append((done, known)), 0.05)
    assert job.result(60) == 100
    failed = jobs.Job(spark, lambda: spark.sql("select raise_error('no')").collect())
    with pytest.raises(Exception, match="no"):
        failed.result(60)
    slow = jobs.Job(spark, lambda: spark.range(1 << 40).selectExpr("sum(id * id % 7)").collect())
    time.sleep(1)
    slow.cancel()
    with pytest.raises(jobs.Cancelled):
        slow.result(60)


def test_labels():
    assert [labels.size(n) for n in (5, 1024, 1536, 3 << 20)] == ["5 bytes", "1 KB", "1.5 KB", "3 MB"]
    assert [labels.delimiter(d) for d in ",\t;|:"] == ["comma", "tab", "semicolon", "pipe", "':'"]
    assert [labels.percent(x) for x in (0, 0.125, 1)] == ["0%", "12.5%", "100%"]
    assert labels.shortened("a" * 60) == "a" * 60 and labels.shortened("a" * 61) == "a" * 59 + "…"


def test_custom_strategies_and_groups(spark):
    custom = Rule("Custom", model.CustomOptions(lambda v, seed: F.when(v != "b", F.concat(v, F.left(seed, F.lit(2))))))
    got = outputs(masking.mask(frame(spark, ["a"], [("x",), ("b",), (None,), (" ",)]), Plan({"a": custom}), KEY), "a")
    assert len(got[0][0]) == 3 and [g[0] for g in got[1:]] == ["[REDACTED]", None, " "]
    assert "has no defaults" in str(model.problems(Plan({"a": Rule("Custom")}), ["a"]))
    with pytest.raises(PlanError):
        recipes.from_plan("r", "me", ["a"], Plan({"a": custom}))
    assert model.groups_of({"a": "id", "b": None, "c": "id", "d": "x"}) == (EntityGroup("id", ("a", "c")), EntityGroup("x", ("d",)))
    words = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(8)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    assert [r[0] for r in df.orderBy("i").select(seeds.int32(F.col("w"))).collect()] == [int.from_bytes(bytes.fromhex(w[:8]), "little", signed=True) for w in words]


def test_file_report(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b"id,n\n1,10\n2,20\n3\n\n")
    table = delimited.read_delimited(spark, str(tmp_path / "f.csv"), skip_malformed=True)
    out = masking.mask(table.rows, Plan({"id": Rule("HashId"), "n": Rule("Redact")}), KEY)
    report = verify.file_report(table.totals(), out.rows, out.verification()).first()
    assert tuple(report) == (2, 2, True, 1, 1, [4], False)
    assert verify.file_report(table.totals(), out.rows.limit(1), out.verification()).first()["has_failures"]



def test_merged_profiles_equal_the_profile_of_the_union(spark):
    rng = random.Random(6)
    rows = [(str(rng.randint(0, 30_000)), rng.choice(["Y", "no", None, " "]), f"{rng.random() * 100:.{rng.randint(0, 3)}f}", "x" * rng.randint(1, 9)) for _ in range(20_000)]
    columns = ["id", "flag", "amount", "word"]
    whole, parts = frame(spark, columns, rows), [frame(spark, columns, rows[:7000]), frame(spark, columns, rows[7000:])]
    merged = profiling.merged_measures(*[profiling.measures(p, distinct=False) for p in parts])
    want = profiling.measures(whole, distinct=False)
    assert sorted(map(str, merged.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    sketches = [profiling.distinct_sketches(p) for p in parts]
    one, two = ({r["position"]: r["n_distinct"] for r in profiling.sketched_counts(s).collect()} for s in (profiling.distinct_sketches(whole), profiling.merged_sketches(*sketches)))
    assert one == two
    assert sorted(sketches[0].columns) == ["position", "rank", "register"]


@pytest.mark.parametrize("n", [1, 50, 999, 1001, 5000, 60_000, 300_000])
def test_distinct_counts_are_exact_then_estimated(spark, n):
    df = spark.range(n).unionByName(spark.range(n)).select((F.col("id") + 2).alias("_rec"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.lit(None).cast("string").alias("none"))
    got = {r["position"]: r["n_distinct"] for r in profiling.distinct_counts(df).collect()}
    assert set(got) == {0}
    assert got[0] == n if n <= profiling.EXACT_DISTINCT else abs(got[0] - n) <= 0.03 * n


def test_formats_are_tried_on_hopeful_columns_only(spark, monkeypatch):
    tried = []
    real = profiling.date_masks
    monkeypatch.setattr(profiling, "date_masks", lambda rows, columns=None: (tried.append(columns), real(rows, columns))[1])
    rows = [(str(i), f"{i}.25", f"Customer#{i:09d}", f"2024-01-{i % 28 + 1:02d}", f"202401{i % 28 + 1:02d}", f"202401{i % 28 + 1:02d}") for i in range(300)]
    types = {r["column"]: r["type"] for r in profiling.profile(frame(spark, ["id", "price", "name", "day", "Order_Date", "plain"], rows), None).collect()}
    assert tried == [["day", "Order_Date"]]
    assert (types["day"], types["Order_Date"]) == ("Date", "Date") and types["plain"] not in ("Date", "DateTime")


MIXED = Plan({"name": Rule("HashId"), "amount": Rule("Perturb", PerturbOptions(mode="Global")), "day": Rule("DateShift"), "zip": Rule("ZipRemap"), "city": Rule("Fake", FakeOptions("City")), "note": Rule("Keep")})


def mixed_rows(spark, n=120):
    rows = [(f"Secret#{i % 50:05d}", f"{i * 1.5:.2f}", f"2024-01-{i % 28 + 1:02d}", f"021{i % 9:02d}", f"Sourceville {i % 30}", None if i % 4 else "n") for i in range(n)]
    return rows, frame(spark, list(MIXED.columns), rows)


def files_below(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names]


def test_nothing_of_a_closed_session_is_left(spark):
    rows, df = mixed_rows(spark)
    session = masking.MaskingSession(spark, KEY)
    masked = session.mask(df, MIXED)
    assert outputs(masked, "name") != [(r[0],) for r in rows]
    assert any(f.endswith(".parquet") for f in files_below(session.folder))
    shared = os.path.dirname(session.folder)
    before = {f for f in files_below(shared) if session.folder.removeprefix("file:") not in f}
    session.close()
    assert not os.path.exists(session.folder.removeprefix("file:")) and set(files_below(shared)) == before
    for use in (lambda: session.mask(df, MIXED), lambda: session.preview(df, MIXED), masked.verification, lambda: masked.written(print), lambda: masked.visit(print)):
        with pytest.raises(SessionClosed):
            use()
    session.close()  # again does no harm
    with masking.MaskingSession(spark) as other, pytest.raises(PlanError):
        other.mask(df, Plan({"name": Rule("Keep")}))
    assert not os.path.exists(other.folder.removeprefix("file:"))


def test_sessions_agree_within_and_differ_between(spark):
    _, df = mixed_rows(spark)
    with masking.MaskingSession(spark) as a, masking.MaskingSession(spark) as b:
        once, again, other = (outputs(s.mask(df, MIXED), *MIXED.columns) for s in (a, a, b))
        assert once == again != other
        assert [tuple(r[c] for c in MIXED.columns) for r in a.preview(df, MIXED, 7).collect()] == once[:7]


def test_the_key_stands_in_no_plan(spark):
    _, df = mixed_rows(spark)
    with masking.MaskingSession(spark, KEY) as session:
        masked = session.mask(df, MIXED)
        masked.rows.write.format("noop").mode("overwrite").save()
        plan = masked.rows._jdf.queryExecution().toString()
        needles = [t for k in (KEY, *seeds.pad_bytes(KEY)) for t in (k.hex(), k.hex().upper(), base64.b64encode(k).decode()[:40])]
        needles.append(str(masking.global_factor(KEY, "amount", 0.15)))
        assert "hidden" in plan and not any(n in plan for n in needles)
        assert KEY.hex() not in repr(session._secret)


def test_global_draws_on_the_driver_equal_those_in_expressions(spark):
    for domain in ("a", "b", "c", "price"):
        want = spark.range(1).select(inline(masking.factor_steps(seeds.unit(seeds.draw(seeds.seeded(KEY, F.lit(domain), F.lit(seeds.GLOBAL)))), 0.15)).alias("f")).first()["f"]
        assert masking.global_factor(KEY, domain, 0.15) == want


def test_one_join_equals_a_join_for_each_column(spark, monkeypatch):
    rows, df = mixed_rows(spark)
    linked = Plan(MIXED.columns, (EntityGroup("name", ("city",)),))
    with masking.MaskingSession(spark, KEY) as session:
        for plan in (MIXED, linked):
            apart = outputs(session.mask(df, plan), *plan.columns)
            monkeypatch.setattr(masking, "BROADCAST_ENTRIES", 5)
            masked = session.mask(df, plan)
            assert outputs(masked, *plan.columns) == apart
            monkeypatch.undo()
        monkeypatch.setattr(masking, "BROADCAST_ENTRIES", 5)
        counts = []
        for mapped in (["name"], ["name", "zip", "city"]):
            plan = Plan({c: r if c in mapped else Rule("Keep") for c, r in MIXED.columns.items()})
            shown = session.mask(df, plan).rows._jdf.queryExecution().sparkPlan().toString()
            counts.append(shown.count("Join"))
        assert counts[0] == counts[1] == 2


def test_the_write_counts_what_verification_counts(spark, tmp_path):
    rows, df = mixed_rows(spark)
    linked = Plan(MIXED.columns, (EntityGroup("name", ("city",)),))
    with masking.MaskingSession(spark, KEY) as session:
        for i, plan in enumerate((MIXED, linked)):
            masked = session.mask(df, plan)
            report = masked.written(lambda out, i=i: out.write.parquet(f"{tmp_path}/{i}"))
            assert spark.read.parquet(f"{tmp_path}/{i}").count() == len(rows)
            assert list(map(str, report.collect())) == list(map(str, masked.verification().collect()))
        assert {r["column"]: r["source_distinct"] for r in report.collect()}["city"] == len({(r[0], r[4]) for r in rows})
        assert session.mask(df.limit(0), MIXED).written(lambda out: out.write.parquet(f"{tmp_path}/none")).first()["n_rows"] == 0


def test_rows_are_visited_until_told_to_stop(spark):
    _, df = mixed_rows(spark)
    with masking.MaskingSession(spark, KEY) as session:
        seen = []
        assert session.mask(df, MIXED).visit(lambda r: seen.append(r["_rec"]) or len(seen) < 10) == 10 == len(seen)


def test_known_zips_come_from_a_table(spark):
    values = [(f"021{i:02d}",) for i in range(8)] + [("02134-1234",), ("213",), ("99999",)]
    known = [f"021{i:02d}" for i in range(50, 70)] + ["00211"]
    tables = [spark.createDataFrame([(z,) for z in [*known, *known, "junk", None]], "zip string"), spark.createDataFrame([("x", known)], "prefix string, zips array<string>"), {"021": known[:20], "002": known[20:]}]
    got = []
    for zips in tables:
        with masking.MaskingSession(spark, KEY, zips=zips) as session:
            masked = session.mask(frame(spark, ["z"], values), Plan({"z": Rule("ZipRemap")}))
            got.append([o for (o,) in outputs(masked, "z")])
            assert masked.warnings == {}
    assert got[0] == got[1] == got[2]
    assert all(o in known for o in got[0][:8]) and got[0][8][:5] in known and got[0][9] == "211" and got[0][10][:3] == "999"
    lists = {r["prefix"]: r["listed"] for r in mapping.zip_lists(tables[0]).collect()}
    assert lists == {"021": known[:20], "002": ["00211"]}


def test_scopes_own_their_tables(spark):
    made, errors, gate = {}, [], threading.Barrier(2)

    def work(name):
        try:
            with tables.scope(spark, name) as own:
                frames = [tables.cut(spark.range(50), f"{name}-{i}") for i in range(3)]
                made[name] = own.folder
                gate.wait(60)
                if name == "first":
                    return
                gate.wait(60)  # the other scope is closed by now
                assert sum(f.count() for f in frames) == 150
        except BaseException as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in ("first", "second")]
    for t in threads:
        t.start()
    threads[0].join(120)
    assert not os.path.exists(made["first"].removeprefix("file:"))
    gate.wait(60)
    threads[1].join(120)
    assert not errors and not os.path.exists(made["second"].removeprefix("file:"))
    with tables.scope(spark) as outer:
        kept = tables.cut(spark.range(5), "outer")
        with tables.scope(spark):
            tables.cut(spark.range(5), "inner")
        assert kept.count() == 5
    with pytest.raises(tables.ScopeClosed), outer.active():
        pass


@pytest.mark.parametrize("small", [20_000, 0])
def test_the_last_value_of_a_full_space_changes_places(spark, small):
    """Ten digits, ten outputs, and the last digit finds only itself."""
    values = [str(i) for i in range(10)]
    walked = lambda key: [o for o in _walk_digits(key, values)]
    key = next(k for k in (bytes([i]) * 32 for i in range(256)) if walked(k)[-1] is None)
    got = {r["value"]: (r["output"], r["n"]) for r in mapping.resolve(frame(spark, ["d"], [(v,) for v in values]), Plan({"d": Rule("HashId")}), key, small=small).collect()}
    assert sorted(o for o, _ in got.values()) == values and all(o != v for v, (o, _) in got.items())
    assert [got[v][0] for v in values[:8]] == walked(key)[:8] and got["9"] == (walked(key)[8], mapping.SWAPPED) and got["8"] == ("9", mapping.SWAPPED)


def _walk_digits(key, values):
    taken = set()
    for v in values:
        o = next((o for n in range(10_001) if (o := strategies.choice(Rule("HashId"), key, v, "d", v, n)) != v and o not in taken), None)
        taken.add(o)
        yield o


def test_lists_reach_all_outputs():
    assert strategies.last_attempt(Rule("HashId"), "12345") == 100 + 90_000 and strategies.last_attempt(Rule("HashId"), "012345") == 100 + 100_000
    assert strategies.last_attempt(Rule("Fake", FakeOptions("City")), "Rome") > 1_000_000


def test_splits_grow_with_the_file(spark, tmp_path):
    from tabveil import queries

    (tmp_path / "a.csv").write_bytes(b"a,b\n" * (4 << 20))
    with queries._small_splits(spark, str(tmp_path / "a.csv")):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(64 * 1024)
    with queries._small_splits(spark):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(32 * 1024)


@pytest.mark.parametrize("rule", [Rule("HashId"), Rule("Fake", FakeOptions("PersonFirst")), Rule("Fake", FakeOptions("Email"))])
@pytest.mark.parametrize("block", [70, 1000])
def test_walks_through_spaces_equal_one_by_one(monkeypatch, rule, block):
    """In blocks, with bitmaps of what earlier ones took. Names of one person: numbers meet the names of others."""
    for pool, words in (("FIRST", ["Ada"]), ("LAST", ["Abel"]), ("DOMAINS", ("example.com",))) if rule.strategy == "Fake" and rule.options.kind == "Email" else ():
        monkeypatch.setattr(strategies, pool, words)
    pools = (strategies.FIRST, strategies.LAST, range(100), strategies.DOMAINS)
    monkeypatch.setitem(strategies._POOLS, "Email", (pools, 15))
    monkeypatch.setitem(strategies._AT, "Email", [{str(w).lower(): i for i, w in enumerate(p)} for p in pools])
    key, plan = bytes(range(32)), Plan({"c": rule})
    values = [str(100 + i * 7 % 900) for i in range(900)] if rule.strategy == "HashId" else [f"name {i}" for i in range(400)]
    taken, want = set(), []
    for v in values:
        out, n = next(((o, n) for n in range(1001) if (o := strategies.choice(rule, key, v, "c", v, n)) != v and o not in taken), (None, -1))
        taken.add(out)
        want.append((out, n))
    tail = lambda v: f"x {strategies.choice(rule, key, v, 'c', v, 0)}" if rule.strategy == "Fake" else None
    got, held, walk = [], pd.DataFrame({"space": [], "bucket": [], "bits": [], "name": []}), spaces._walk(plan, key)
    for at in range(0, len(values), block):
        rows = [(spaces.space_of(plan, "c", None, "c", v, "mixed"), i, v) for i, v in enumerate(values[at : at + block])]
        pdf = pd.DataFrame([("c", None, v, "c", i, 0, tail(v), False, s, size, "c", v, own) for (s, size, own), i, v in rows], columns=[*[c.split()[0] for c in spaces.GIVEN.split(", ")], "size", "seed_domain", "seed", "own_place"])
        out = walk(pdf, held)
        got += [(strategies.output_at(rule, r.value, r.place) if r.place >= 0 else r.name_, r.n) for r in out.rename(columns={"name": "name_"}).itertuples()]
        if len(out) < len(pdf):
            break
        bits = np.zeros(spaces.BITS, dtype=np.uint8)
        bits[out["place"][out["place"] >= 0]] = 1
        new = [("s", 1, np.packbits(bits, bitorder="little").tobytes(), None), *[("s", None, None, x) for x in out["name"].dropna()]]
        held = pd.concat([held, pd.DataFrame(new, columns=list(held.columns))], ignore_index=True)
    assert got == want[: len(got)]
    if rule.strategy == "HashId":
        assert len(got) == 900
    else:
        assert 50 < len(got) < 400 and all(n >= strategies.BEFORE_NUMBERS for _, n in want[len(got) :])


def test_full_spaces_and_limits_take_no_rounds(spark, monkeypatch):
    """A full space of identifiers is walked through by blocks; more values than entries allowed are told before any."""
    labels = []
    monkeypatch.setattr(mapping, "cut", lambda df, label, cut=mapping.cut: (labels.append(label), cut(df, label))[1])
    monkeypatch.setattr(spaces, "BLOCK", 30)
    rows = [(f"{i * 7 % 90 + 10}",) for i in range(90)]
    plan = Plan({"id": Rule("HashId")})
    got = {r["value"]: r["output"] for r in mapping.resolve(frame(spark, ["id"], rows), plan, KEY, small=0).collect()}
    assert [(got[v],) for (v,) in rows] == sequential(plan, rows, ["id"]) and "mapping-round" not in labels
    labels.clear()
    with pytest.raises(mapping.MappingLimitExceeded, match="'id'"):
        mapping.resolve(frame(spark, ["id"], [*rows, ("--",)]), plan, KEY, most_entries=89)
    assert labels == ["mapping-keys"]
    assert mapping.resolve(frame(spark, ["id"], [*rows, ("--",)]), plan, KEY, most_entries=90).count() == 91


def test_a_price_that_its_factor_rounds_back_to_itself_is_no_difference(spark, tmp_path):
    """Such prices stay, as in the SQL of mask_perturb_row; any other that stayed, or moved by chance, is told."""
    from tabveil import queries

    orders = [(1937956, 3463.58), (1937957, 3463.58), (1937958, 3463.58), (1937959, 3463.58), (2953297, 3099.09), (8126245, 2409.39)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    rows = queries.mask_perturb_shapes(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and all(r["same_shape"] and r["changed"] for r in rows)
    side = lambda rec, source, output: (rec, {"source": source, "output": output})
    sides = spark.createDataFrame([side(1937958, "(3463.58)", "(3463.58)"), side(1937958, "(3463.58)", "(3463.59)"), side(1937957, "$3,463.58", "$3,463.58")], "_rec long, v struct<source string, output string>")
    assert [r["drawn"] for r in staged(sides, {"drawn": queries._as_drawn("v")}).collect()] == [True, False, False]


def test_columns_of_a_domain_share_a_full_space_without_rounds(spark, monkeypatch):
    """Padded keys and what is made of them, in no order, as in mask_shared_domain."""
    labels = []
    monkeypatch.setattr(mapping, "cut", lambda df, label, cut=mapping.cut: (labels.append(label), cut(df, label))[1])
    rows = [(f"{i * 37 % 100:03d}", f"{i * 37 % 100 % 7:03d}") for i in range(100)]
    plan = Plan({c: Rule("HashId", None, "person") for c in ("a", "b")})
    got = {r["value"]: r["output"] for r in mapping.resolve(frame(spark, ["a", "b"], rows), plan, KEY, small=0).collect()}
    assert len(got) == len(set(got.values())) == 100 and "mapping-round" not in labels
    assert [(got[a], got[b]) for a, b in rows] == sequential(plan, rows, ["a", "b"])


def test_e_mail_names_of_a_full_space_are_dealt_numbers_at_once(spark):
    """One group a person and host: numbers meet those of other names, what is held, names, and the value itself."""
    names = ["Ada.Abel5", "ada.abel51", "ada.abel0", "ADA.ABEL5", "ada.berg5"]
    rows, taken, want = [], {"ada.abel54@example.com", "ada.abel515@example.com", "ada.abel02@example.com"}, []
    for i in range(600):
        base = names[i * 7 % 5].lower() + "@example.com" if i % 5 != 3 else "ADA.ABEL5@EXAMPLE.COM"
        value = f"ada.abel51{i % 10}@example.com" if i % 50 == 0 else f"v{i}"
        out, n = next((o, n) for n in range(50, 2000) if (o := strategies.numbered("Email", base, n)) not in taken and o != value and strategies.name_place("Email", o) < 0)
        taken.add(out)
        want.append((i, out, n))
        rows.append(("c", None, value, i, 0, f"True {base}", False))
    held = [("c", None, -i - 1, 0, "True x", False, 50, o) for i, o in enumerate(sorted(taken - {o for _, o, _ in want}))]
    left = spark.createDataFrame(rows[::-1], "domain string, anchor string, value string, rec long, at int, tail string, own boolean")
    got = spaces.deal_numbers(left, spark.createDataFrame([*held, ("c", None, -9, 0, "True x", False, 3, "ada.abel7@example.com")], spaces.PLACED))
    assert [(r["rec"], r["output"], r["n"]) for r in got.orderBy("rec").collect()] == want
    other = spaces.deal_numbers(left.withColumn("anchor", F.lit("a")), spark.createDataFrame(held, spaces.PLACED)).orderBy("rec").collect()
    assert other[0]["anchor"] == "a" and {r["output"] for r in other} & {h[-1] for h in held}


def test_shared_domain_of_all_keys_of_five_digits(spark, tmp_path):
    """No padded key of five digits is left over, so the last ones go through nearly all outputs there are."""
    from tabveil import queries

    spark.range(100_000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 100_000).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in queries.mask_shared_domain(spark, str(tmp_path)).collect()] == [(100_000, True, True)]
