"""Evaluation tables: expansion, samples, groups, resumption."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def union_splits(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """All parts under one schema, each row tagged with its part."""
    out = None
    for name, part in parts.items():
        part = part.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no part to read")
    return out


def expand_pairs(rows: DataFrame, questions: str = "questions", answers: str = "answers") -> DataFrame:
    """One row for each question of a context; an error at run time where the arrays differ in length."""
    same = F.when(F.size(questions) == F.size(answers), F.arrays_zip(questions, answers)).otherwise(F.raise_error(F.lit("questions and answers differ in number")))
    keep = [c for c in rows.columns if c not in (questions, answers)]
    return rows.select(*keep, F.posexplode(same).alias("idx", "pair")).select(*keep, "idx", F.col(f"pair.{questions}").alias("question"), F.col(f"pair.{answers}").alias("answer"))


def group_in_order(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """Values of each group in order. Null keys are no group."""
    held = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.transform(held, lambda x: x[value]).alias(name))


def sample_exact(rows: DataFrame, fraction: float, key: str, seed: int) -> DataFrame:
    """round(n * fraction) rows, those whose hash with the seed comes first: the same rows on every run. Buckets of the hash are counted and taken whole; only the bucket
    on the boundary is ranked."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))).withColumn("_b", F.substring("_h", 1, 4))
    held = sorted(map(tuple, hashed.groupBy("_b").count().collect()))  # 65,536 buckets at the most
    left, whole, cut = round(sum(n for _, n in held) * fraction), "", None
    for bucket, n in held:
        if n > left:
            cut = bucket
            break
        whole, left = bucket, left - n
    out = hashed.where(F.col("_b") <= whole)
    if cut and left:
        out = out.unionByName(hashed.where(F.col("_b") == cut).orderBy("_h", key).limit(left))
    return out.drop("_h", "_b")


def head_per_group(rows: DataFrame, by: str, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; the literal bound is pushed below the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def resume(examples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return examples.join(done.select(key).distinct(), key, "left_anti")


def prefix_within(rows: DataFrame, by: str, order: list[str], weight: str, cap: int) -> DataFrame:
    """The longest prefix of each group whose weights sum to the cap at most."""
    run = F.sum(weight).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("total", run).where(F.col("total") <= cap)


def keep_recent(turns: DataFrame, by: str, order: str, weight: str, last: int, cap: int) -> DataFrame:
    """The last turns of each transcript, `last` at most, dropping the oldest until their weights fit the cap."""
    back = Window.partitionBy(by).orderBy(F.col(order).desc())
    rows = turns.withColumn("back", F.row_number().over(back)).withColumn("held", F.sum(weight).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("back") <= last) & (F.col("held") <= cap))


def insert_needle(docs: DataFrame, needle: str, depths: list[int], limit: int | None = None, text: str = "text") -> DataFrame:
    """A row for each depth: the needle stands int(n * depth / 100) words into the text, or into its first `limit` words."""
    words = F.array_remove(F.split(F.col(text), r"(?U)\s+"), "")
    words = words if limit is None else F.slice(words, 1, limit)
    rows = docs.withColumn("w", words).withColumn("depth", F.explode(F.array(*(F.lit(d) for d in depths))))
    at = F.floor(F.size("w") * F.col("depth") / 100).cast("int")
    return rows.withColumn("context", F.array_join(F.concat(F.slice("w", F.lit(1), at), F.array(F.lit(needle)), F.slice("w", at + 1, F.size("w"))), " ")).withColumn("at", at).drop("w")


def layered(configs: dict[str, dict], name: str) -> dict:
    """A configuration with those it extends beneath it; an error on a cycle."""
    seen: list[str] = []
    chain: list[dict] = []
    while name:
        if name in seen:
            raise ValueError(f"configurations extend each other: {' -> '.join([*seen, name])}")
        seen.append(name)
        chain.append(configs[name])
        name = configs[name].get("extends", "")
    out: dict = {}
    for c in reversed(chain):
        out |= {k: v for k, v in c.items() if k != "extends"}
    return out


def unfinished(runs: DataFrame, artifacts: DataFrame, by: list[str], needed: tuple[str, ...]) -> DataFrame:
    """Runs that lack one of the needed artifacts (rows of the columns `by` and kind)."""
    done = artifacts.where(F.col("kind").isin(*needed)).groupBy(*by).agg(F.count_distinct("kind").alias("_n")).where(F.col("_n") == len(needed))
    return runs.join(done, by, "left_anti")


def config_lines(config: dict, only_with: dict[str, str] | None = None) -> list[str]:
    """A flat config as YAML, its values written as JSON. Nulls go, and so does each key of only_with whose companion key is absent or null."""
    kept = {k: v for k, v in config.items() if v is not None and (k not in (only_with or {}) or config.get(only_with[k]) is not None)}
    return [f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in kept.items()]


def report_lines(metrics: DataFrame, title: str) -> DataFrame:
    """A Markdown report of long-form metrics, one row for each line: section, line_no, line. Sections are datasets; their order and line_no give the text."""
    section = F.col("dataset")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", "metric", F.col("value").cast("string"), F.col("n").cast("string")), F.lit(" |"))
    rows = metrics.select(section.alias("section"), (F.row_number().over(Window.partitionBy("dataset").orderBy("metric")) + 2).alias("line_no"), cells.alias("line"))
    heads = metrics.select(section.alias("section")).distinct()
    heads = heads.select("section", F.posexplode(F.array(F.concat(F.lit(f"## {title}: "), "section"), F.lit("| metric | value | n |"), F.lit("|-|-|-|"))).alias("line_no", "line"))
    return heads.unionByName(rows)
