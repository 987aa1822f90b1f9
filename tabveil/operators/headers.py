"""Headers and recipes as tables: keys, signatures, plans and rankings for many files at once.

A header is a few rows (header, position, name). What needs a whole header takes it as one array; what compares headers
with recipes is a join on names and their occurrence, so a thousand recipes against a million headers is one job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabveil.functions import names
from tabveil.functions.text import SPACE
from tabveil.operators.profile import entity_groups

#: The JSON of a recipe, as far as ranking needs it.
RECIPE = "schemaVersion int, id string, name string, owner string, updated string, columns array<struct<name: string, strategy: string>>, _corrupt string"
VERSION = 1


def normal(name: Column) -> Column:
    """How names are compared: without outer white space, inner runs as one space, in lower case."""
    edges = F.regexp_replace(F.coalesce(name, F.lit("")), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")
    return F.lower(F.regexp_replace(edges, f"[{SPACE}]+", " "))


def whole_headers(headers: DataFrame) -> DataFrame:
    """(header, names): a row a header, names in the order of their positions; null names are blank."""
    found = headers.groupBy("header").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("name", F.lit("")).alias("name")))).alias("n"))
    return found.select("header", F.col("n.name").alias("names"))


def _by_header(function: Callable, kind: str) -> Callable:
    @F.pandas_udf(kind)
    def run(headers: pd.Series) -> pd.Series:
        return pd.Series([function(list(h)) for h in headers])

    return run


def keys(headers: DataFrame) -> DataFrame:
    """(header, position, name, key): the unique key of each name."""
    made = whole_headers(headers).withColumn("keys", _by_header(names.header_keys, "array<string>")("names"))
    each = made.select("header", F.posexplode(F.arrays_zip("names", "keys")).alias("at", "x"))
    return each.select("header", (F.col("at") + 1).alias("position"), F.col("x.names").alias("name"), F.col("x.keys").alias("key"))


def signatures(headers: DataFrame) -> DataFrame:
    """(header, signature): equal for headers of equal names in equal order."""
    text = F.array_join(F.transform("names", normal), "\x1f")
    return whole_headers(headers).select("header", F.sha2(text.cast("binary"), 256).alias("signature"))


def tokens(names_: DataFrame) -> DataFrame:
    """names_ with tokens, the words of a column name."""
    return names_.withColumn("tokens", _by_header(lambda n: names.tokenize(n[0]), "array<string>")(F.array("name")))


def groups(columns: DataFrame) -> DataFrame:
    """(header, anchor, member) of columns (header, position, name, type): suggested entity groups."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "name", "type")))

    @F.pandas_udf("array<struct<anchor: string, member: string>>")
    def of(header: pd.Series) -> pd.Series:
        found = [entity_groups({c["name"]: c["type"] for c in h}) for h in header]
        return pd.Series([[{"anchor": g.anchor, "member": m} for g in f for m in g.members] for f in found])

    each = columns.groupBy("header").agg(ordered.alias("c")).select("header", F.explode(of("c")).alias("g"))
    return each.select("header", "g.anchor", "g.member")


def occurrences(headers: DataFrame, by: str = "header") -> DataFrame:
    """headers with norm, the compared name, and nth: the how-manieth of its name it is."""
    w = Window.partitionBy(by, "norm").orderBy("position")
    return headers.withColumn("norm", normal(F.col("name"))).withColumn("nth", F.row_number().over(w))


def read_recipes(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(recipe, updated, position, name, strategy) of the recipe files below folder, and how many files are no recipes:
    broken JSON, no id, or a version still unknown."""
    files = spark.read.schema(RECIPE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(folder).persist()
    try:
        fine = F.col("_corrupt").isNull() & (F.coalesce("id", F.lit("")) != "") & (F.col("schemaVersion") <= VERSION)
        bad = files.filter(~F.coalesce(fine, F.lit(False))).count()
        rows = [(r["id"], r["updated"], i, c["name"], c["strategy"]) for r in files.filter(fine).collect() for i, c in enumerate(r["columns"] or [], 1)]
    finally:
        files.unpersist()
    return spark.createDataFrame(rows, "recipe string, updated string, position int, name string, strategy string"), bad


#: Digits of the hash that names a class.
CLASS = 256


def _classes(rows: DataFrame, by: str) -> DataFrame:
    """(by, names, shape): equal names for the same names in the same order; equal shape for the same names as often."""
    normed = rows.select(by, "position", normal(F.col("name")).alias("norm")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("position", "norm")))["norm"].alias("n"))
    named = lambda c: F.sha2(F.array_join(c, "\x1f").cast("binary"), CLASS)
    return normed.select(by, named(F.col("n")).alias("names"), named(F.array_sort("n")).alias("shape"))


def _shares(rows: DataFrame, classes: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(names (shape, norm, nth) of one header or recipe a shape, (shape, n))."""
    one = classes.groupBy("shape").agg(F.min(by).alias(by))
    each = occurrences(rows, by).join(one, by).select("shape", "norm", "nth")
    return each, each.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


def ranked(headers: DataFrame, recipes: DataFrame, most: int | None = None) -> DataFrame:
    """(header, place, recipe, exact, score): the recipes that share a name with a header, best first: those of the same
    names in the same order, then by the share of both sides' columns that match, then the one updated last. With most,
    that many a header, and the work grows with the shapes of headers and recipes, not with all pairs.

    headers: (header, position, name). recipes: (recipe, updated, position, name). Names and places decide a score, so it
    is worked out once for the headers and the recipes that have the same names as often. Of recipes of the same names in
    the same order, the most that were updated last are always before the others.
    """
    h, r = _classes(headers, "header"), _classes(recipes, "recipe")
    (he, hn), (re, rn) = _shares(headers, h, "header"), _shares(recipes, r, "recipe")
    both = he.withColumnRenamed("shape", "h_shape").join(re.withColumnRenamed("shape", "r_shape"), ["norm", "nth"]).groupBy("h_shape", "r_shape").agg(F.count(F.lit(1)).alias("both"))
    hn, rn = hn.select(F.col("shape").alias("h_shape"), F.col("n").alias("n_h")), rn.select(F.col("shape").alias("r_shape"), F.col("n").alias("n_r"))
    scores = both.join(hn, "h_shape").join(rn, "r_shape").select("h_shape", "r_shape", (F.col("both") / (F.col("n_h") + F.col("n_r") - F.col("both"))).alias("score"))
    r = r.join(recipes.groupBy("recipe").agg(F.max("updated").alias("updated")), "recipe")
    best = [F.desc("updated"), F.asc("recipe")]
    r = r.select("recipe", "updated", F.col("names").alias("r_names"), F.col("shape").alias("r_shape"))
    h = h.select("header", F.col("names").alias("h_names"), F.col("shape").alias("h_shape"))
    order = Window.partitionBy("header").orderBy(F.desc("exact"), F.desc("score"), *best)
    if most is None:
        found = h.join(scores, "h_shape").join(r, "r_shape").select("header", "recipe", "updated", (F.col("h_names") == F.col("r_names")).alias("exact"), "score")
    else:
        first = lambda w, t: t.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= most).drop("_at")
        exact = h.join(first(Window.partitionBy("r_names").orderBy(*best), r), F.col("h_names") == F.col("r_names")).select("header", "recipe", "updated", F.lit(True).alias("exact"), "h_shape", "r_shape").join(scores, ["h_shape", "r_shape"])
        # The best by score alone, a shape of headers; those of a header's own order come on top.
        near = first(Window.partitionBy("r_shape").orderBy(*best), r).join(scores, "r_shape")
        near = first(Window.partitionBy("h_shape").orderBy(F.desc("score"), *best), near)
        near = h.join(near, "h_shape").select("header", "recipe", "updated", (F.col("h_names") == F.col("r_names")).alias("exact"), "score")
        found = exact.select("header", "recipe", "updated", "exact", "score").unionByName(near).distinct()
    out = found.select("header", F.row_number().over(order).alias("place"), "recipe", "exact", "score")
    return out if most is None else out.filter(F.col("place") <= most)


#: Rows of the result that a task of assigned() makes, about, and the most tasks.
ASSIGNED_ROWS, MOST_TASKS = 20_000_000, 20_000
#: Columns of recipes up to which what they say is broadcast; some tens of MB.
BROADCAST_SAID = 500_000
#: Recipes that a list of those of one kind has at most, about; a kind of more has several lists.
LISTED = 1000


def assigned(headers: DataFrame, recipes: DataFrame) -> DataFrame:
    """(header, position, key, recipe, strategy): for each recipe, its strategy for the columns of a header that are the
    same name in the same occurrence; null for the others.

    The result grows with headers times recipes, so headers are dealt to tasks by how many rows they can become, and stay
    there: recipes that say the same are one kind until the end, when a kind's lists of recipes are exploded, and both what
    kinds say and these lists come by broadcast. Only headers are shuffled. Recipes of more columns than are broadcast
    (counted) are joined as Spark sees fit."""
    n_said, n_recipes = recipes.agg(F.count(F.lit(1)), F.count_distinct("recipe")).first()
    tasks = max(2 * headers.sparkSession.sparkContext.defaultParallelism, min(headers.count() * n_recipes // ASSIGNED_ROWS, MOST_TASKS))
    small = F.broadcast if n_said <= BROADCAST_SAID else lambda t: t
    said = occurrences(recipes, "recipe")
    kind = said.groupBy("recipe").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("norm", "nth", "strategy")))).cast("binary"), CLASS).alias("kind"))
    one = kind.groupBy("kind").agg(F.min("recipe").alias("recipe"))
    r = said.join(one, "recipe").select("kind", "norm", "nth", "strategy")
    lists = kind.groupBy("kind", F.pmod(F.xxhash64("recipe"), F.lit(n_recipes // LISTED + 1))).agg(F.collect_list("recipe").alias("recipes"))
    # By number: by size few tasks would get all, since headers are small and their rows of the result are not.
    dealt = lambda t: occurrences(t.repartition(tasks, "header"))
    h = dealt(keys(headers)).select("header", "position", "key", "norm", "nth")
    pairs = dealt(headers).join(small(r.select("kind", "norm", "nth")), ["norm", "nth"]).select("header", "kind").distinct()  # that share a name
    each = h.join(pairs.hint("merge"), "header").join(small(r), ["kind", "norm", "nth"], "left").select("header", "position", "key", "kind", "strategy")
    return each.join(small(lists.select("kind", "recipes")), "kind").select("header", "position", "key", F.explode("recipes").alias("recipe"), "strategy")
