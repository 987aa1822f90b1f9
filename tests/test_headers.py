"""Headers and recipes as tables, against the functions for one header."""

import random
import time

from pyspark.sql import functions as F

from tabveil.functions import names
from tabveil.operators import headers, jobs
from tabveil.plans import model, recipes

POOL = ["Id", "ID", " id ", "Name", "name", "", None, "  ", "Name#2", "Column3", "Note", "Mail"]


def some_headers(seed, n):
    rng = random.Random(seed)
    return {h: [rng.choice(POOL) for _ in range(rng.randint(1, 7))] for h in range(n)}


def table(spark, made, by="header"):
    return spark.createDataFrame([(h, i, n) for h, of in made.items() for i, n in enumerate(of, 1)], f"{by} long, position int, name string").repartition(3)


def test_keys_and_signatures_equal_those_of_one_header(spark):
    made = some_headers(1, 40)
    got = {}
    for r in headers.keys(table(spark, made)).orderBy("header", "position").collect():
        got.setdefault(r["header"], []).append(r["key"])
    assert got == {h: names.header_keys([n or "" for n in of]) for h, of in made.items()}
    signed = {r["header"]: r["signature"] for r in headers.signatures(table(spark, made)).collect()}
    assert signed == {h: names.header_signature([n or "" for n in of]) for h, of in made.items()}


def test_ranking_equals_that_of_one_header(spark):
    made, saved = some_headers(2, 12), some_headers(3, 15)
    saved[99] = list(made[0])
    kept = {}
    for k, of in saved.items():
        plan = model.Plan({c: model.Rule("Keep") for c in names.header_keys([n or "" for n in of])})
        r = recipes.from_plan(f"r{k}", "me", [n or "" for n in of], plan)
        kept[r.id] = (k, r)
    stamped = spark.createDataFrame([(k, r.updated) for k, r in kept.values()], "recipe long, updated string")
    got = {}
    for r in headers.ranked(table(spark, made), table(spark, saved, "recipe").join(stamped, "recipe")).orderBy("header", "place").collect():
        got.setdefault(r["header"], []).append((r["recipe"], r["exact"], round(r["score"], 9)))
    want = {h: [(kept[r.id][0], e, round(s, 9)) for r, e, s in recipes.ranked([r for _, r in kept.values()], [n or "" for n in of])] for h, of in made.items()}
    assert got == {h: w for h, w in want.items() if w}


def test_recipe_files_as_a_table(spark, tmp_path):
    store = recipes.Store(str(tmp_path))
    plan = model.Plan({"Id": model.Rule("HashId"), "Note": model.Rule("Redact")})
    made = [recipes.from_plan(f"r{i}", "me", ["Id", "Note"], plan) for i in range(3)]
    for r in made:
        store.save(r, "me")
    (tmp_path / "broken.json").write_text("{ not json")
    (tmp_path / "future.json").write_text(recipes.to_json(made[0]).replace('"schemaVersion": 1', '"schemaVersion": 9'))
    (tmp_path / "notes.txt").write_text("no recipe")
    found, bad = headers.read_recipes(spark, str(tmp_path))
    assert bad == 2
    assert sorted(tuple(r) for r in found.select("recipe", "position", "name", "strategy").collect()) == sorted((r.id, i, c, s) for r in made for i, c, s in ((1, "Id", "HashId"), (2, "Note", "Redact")))


def test_progress_is_that_of_the_own_job(spark, tmp_path):
    said, rows = [], []
    other = jobs.Job(spark, lambda: spark.range(2_000_000).repartition(40).write.parquet(f"{tmp_path}/other"))
    own = jobs.Job(spark, lambda: spark.range(0, 50_000, 1, 10).write.parquet(f"{tmp_path}/own"), lambda *p: said.append(p), 0.05, rows.append, 10_000)
    own.result(120)
    other.result(120)
    time.sleep(1)
    assert rows and rows == sorted(rows) and rows[-1] == 50_000
    assert said[-1] == (1, 1) and all(known <= 10 for _, known in said)


def test_the_best_few_are_those_of_the_whole_ranking(spark):
    """Shapes shared by many recipes, equal names in equal order, and ties."""
    rng = random.Random(5)
    made = lambda n, most: [(i, at, rng.choice(["a", " A", "b", "c", ""])) for i in range(n) for at in range(rng.randint(1, most))]
    h = spark.createDataFrame(made(30, 4), "header long, position int, name string")
    r = spark.createDataFrame(made(60, 3), "recipe long, position int, name string").withColumn("updated", (F.col("recipe") % 4).cast("string"))
    key = lambda t: sorted(tuple(x) for x in t.collect())
    assert key(headers.ranked(h, r, 3)) == key(headers.ranked(h, r).filter("place <= 3"))


def some_recipes(spark, seed, n):
    """Some that say the same, some of the same names that say something else."""
    rng = random.Random(seed)
    made = {k: [(rng.choice(POOL), rng.choice(["Keep", "Redact"])) for _ in range(rng.randint(1, 3))] for k in range(n // 2)}
    made |= {k: [(f" {name or ''}  ", s) for name, s in made[k - n // 2]] if k % 2 else [(name, "HashId") for name, _ in made[k - n // 2]] for k in range(n // 2, n)}
    return made, spark.createDataFrame([(k, i, name, s) for k, of in made.items() for i, (name, s) in enumerate(of, 1)], "recipe long, position int, name string, strategy string")


def test_what_recipes_say_equals_that_of_one_header(spark, monkeypatch):
    made = some_headers(7, 25)
    said, saved = some_recipes(spark, 8, 40)
    want = []
    for h, of in made.items():
        of = [n or "" for n in of]
        for k, columns in said.items():
            r = recipes.Recipe("r", "me", tuple(recipes.RecipeColumn(n or "", s) for n, s in columns))
            if match := recipes.aligned(r, of):
                want += [(h, i + 1, key, k, r.columns[match[i]].strategy if i in match else None) for i, key in enumerate(names.header_keys(of))]
    key = lambda t: sorted((tuple(x) for x in t.collect()), key=str)
    assert key(headers.assigned(table(spark, made), saved)) == sorted(want, key=str)
    monkeypatch.setattr(headers, "BROADCAST_SAID", 10)
    monkeypatch.setattr(headers, "LISTED", 3)
    assert key(headers.assigned(table(spark, made), saved)) == sorted(want, key=str)


def test_what_recipes_say_is_dealt_by_the_rows_it_makes(spark, monkeypatch):
    """Small tables whose rows of the result are many: sizes of the input alone put them all in one task."""
    monkeypatch.setattr(headers, "ASSIGNED_ROWS", 5_000, raising=False)
    rows = headers.assigned(table(spark, some_headers(9, 600)), some_recipes(spark, 10, 200)[1])
    by_task = [r["count"] for r in rows.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()]
    assert sum(by_task) > 200_000 and len(by_task) >= 60 and max(by_task) <= 4 * 5_000
