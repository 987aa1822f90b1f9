"""Evaluating an expression once and using it many times without copying its tree.

let binds inside an expression; what it binds is evaluated by an interpreted higher-order function. Steps are
generators that yield what is to be bound, are sent a reference to it, and return their result: staged runs many of
them over a table, binding in columns, which keeps everything in generated code; inline makes one a single expression.
"""

from __future__ import annotations

from collections.abc import Callable, Generator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Steps = Generator[Column, Column, Column]


#: HotSpot leaves longer methods uncompiled, in bytes of code; Spark's own limit is what a class file can hold.
COMPILED_BYTES, SPARKS_LIMIT = 8000, 65535


def short_methods(spark: SparkSession) -> None:
    """Has Spark split expressions into methods short enough to be compiled, unless the session has a limit of its own."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, str(SPARKS_LIMIT))) == SPARKS_LIMIT:
        spark.conf.set(name, str(COMPILED_BYTES))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(x), body), 1)


def inline(steps: Steps) -> Column:
    def step(sent: Column | None) -> Column:
        try:
            return let(steps.send(sent), step)
        except StopIteration as end:
            return end.value

    return step(None)


def staged(df: DataFrame, steps: dict[str, Steps]) -> DataFrame:
    """df with a column per key: the results of its steps. The steps of all keys go on together, a projection each."""
    short_methods(df.sparkSession)
    going, sent, bound, results = dict(steps), dict.fromkeys(steps), [], {}
    while going:
        level = {}
        for at, (name, s) in enumerate(list(going.items())):
            try:
                temp = f"_step{len(bound)}_{at}_"
                level[temp] = s.send(sent[name])
                sent[name] = F.col(temp)
            except StopIteration as end:
                results[name] = end.value
                del going[name]
        if level:
            df = df.withColumns(level)
            bound += level
    return df.withColumns(results).drop(*bound)
