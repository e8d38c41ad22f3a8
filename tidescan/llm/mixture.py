"""Mixing sources to target weights by hierarchical budgeting.

Weights are propagated down a tree of domain, language and source. A leaf can give at most
its tokens times its repeats; what it cannot give goes to its siblings first and only then
to the relatives of its ancestors. Every leaf then supplies whole epochs and a token prefix
of one more, in an order that the seed and the number of that epoch decide. Documents are put in seeded order by range partitions, and
prefix sums are taken within and across partitions, so a leaf with a third of all
documents is never in one task. Only one row for each leaf and partition is collected.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidescan.llm.leakage import spread
from tidescan.session import materialise
from tidescan.sources.tables import table

#: Domain of each source; a parameter. A source not listed is a domain of its own.
DOMAINS = {
    "scan_reports": "reports", "advisories": "reports", "postmortems": "reports", "changelogs": "reports",
    "guides": "reference", "policy": "reference", "runbooks": "reference", "glossary": "reference", "workshop_notes": "reference",
    "forum": "discussion", "issue_threads": "discussion", "review_notes": "discussion", "mail_archive": "discussion",
}
TOKENIZER, SEED = "byte_bpe_50k.json", 17
#: A plan of at most so many leaves is broadcast, a larger one is joined by its keys.
PLAN_ROWS = 20_000

_LOADED: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (with ``text``) plus ``tokens``, without the text; null and blank texts have 0."""
    where = path or tokenizer_path()
    keep = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if where not in _LOADED:
            from tokenizers import Tokenizer

            _LOADED[where] = Tokenizer.from_file(where)
            _LOADED[where].encode_special_tokens = True
        for pdf in batches:
            texts = [t if t and t.strip() else "" for t in pdf.pop("text")]
            pdf["tokens"] = [len(e.ids) for e in _LOADED[where].encode_batch(texts, add_special_tokens=False)]
            yield pdf

    return docs.mapInPandas(run, schema)


def fill(weights: list[float], capacity: list[float], budget: float) -> list[float]:
    """Split a budget by weight; what exceeds a child's capacity goes to its siblings by weight."""
    given = [0.0] * len(weights)
    open_ = [k for k, (w, c) in enumerate(zip(weights, capacity, strict=True)) if w > 0 and c > 0]
    left = min(budget, sum(capacity[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if given[k] + left * weights[k] / total >= capacity[k] - 1e-9]
        if not full:
            for k in open_:
                given[k] += left * weights[k] / total
            break
        for k in full:
            left -= capacity[k] - given[k]
            given[k] = capacity[k]
        open_ = [k for k in open_ if k not in full]
    return given


def budgets(leaves: list[dict], budget: float, levels: tuple[str, ...]) -> list[float]:
    """Budget of every leaf. ``leaves``: the levels' names, ``weight`` and ``capacity``."""
    out = [0.0] * len(leaves)

    def split(members: list[int], amount: float, depth: int) -> None:
        if depth == len(levels):
            for k, b in zip(members, fill([leaves[k]["weight"] for k in members], [leaves[k]["capacity"] for k in members], amount), strict=True):
                out[k] = b
            return
        groups: dict = {}
        for k in members:
            groups.setdefault(leaves[k][levels[depth]], []).append(k)
        names = sorted(groups)
        parts = fill([sum(leaves[k]["weight"] for k in groups[g]) for g in names], [sum(leaves[k]["capacity"] for k in groups[g]) for g in names], amount)
        for g, part in zip(names, parts, strict=True):
            split(groups[g], part, depth + 1)

    split(list(range(len(leaves))), budget, 0)
    return out


def seeded_order(docs: DataFrame, leaf: list[str], seed: int = SEED) -> DataFrame:
    """``docs`` (with ``epochs``) plus ``upto``: the leaf's tokens up to and with each document in the order of the epoch that is cut."""
    h = F.xxhash64(F.lit(seed), F.col("epochs"), "doc_id")
    order = [*leaf, "h", "doc_id"]
    placed = docs.withColumn("h", h).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "seeded-order")
    sums = placed.groupBy("part", *leaf).agg(F.sum("tokens").alias("s"))
    w = W.partitionBy(*leaf).orderBy("part")
    before = sums.withColumn("base", F.sum("s").over(w) - F.col("s")).drop("s")
    inner = W.partitionBy("part", *leaf).orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.withColumn("run", F.sum("tokens").over(inner)).join(before, ["part", *leaf]).withColumn("upto", F.col("run") + F.col("base")).drop("run", "base", "part", "h")


def mix(docs: DataFrame, weights: DataFrame, budget: int | None = None, seed: int = SEED, domains: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Select documents; returns (doc_id, source, lang, tokens, uses) and one report row per source.

    ``docs``: doc_id, source, lang, tokens. ``weights``: source, weight, max_repeats; the
    weights need not add up to 1, a null or negative one counts as 0, null repeats as 1.
    ``budget``: tokens of the whole mixture, by default the tokens of all weighted sources.
    A source without weight gives nothing; one without documents passes its share on. A
    leaf stops before the document that would exceed its budget, so it misses it by less than
    one document. Equal inputs and seed give the same selection.
    """
    spark = docs.sparkSession
    named = domains or DOMAINS
    want = weights.groupBy("source").agg(F.max(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    clean = docs.filter(F.col("tokens") > 0).withColumn("lang", F.coalesce(F.lower(F.trim("lang")), F.lit("und")))
    leaf = ["source", "lang"]
    held = clean.groupBy(*leaf).agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("docs"))
    rows = [r.asDict() for r in want.join(held, "source", "left").collect()]  # one row for each leaf
    scale = sum(w for w in {r["source"]: r["weight"] for r in rows}.values()) or 1.0
    total: dict = {}
    for r in rows:
        total[r["source"]] = total.get(r["source"], 0) + (r["have"] or 0)
    for r in rows:
        r["have"], r["docs"], r["lang"] = r["have"] or 0, r["docs"] or 0, r["lang"] or ""
        r["domain"] = named.get(r["source"], r["source"])
        share = r["have"] / total[r["source"]] if total[r["source"]] else 1.0
        r["weight"] = r["weight"] / scale * share
        r["capacity"] = float(r["have"] * max(0, r["max_repeats"]))
    whole = float(budget if budget is not None else sum(r["have"] for r in rows if r["weight"] > 0))
    for r, b in zip(rows, budgets(rows, whole, ("domain", "lang")), strict=True):
        r["budget"] = b
        r["epochs"] = min(int(b // r["have"]), r["max_repeats"]) if r["have"] else 0
        r["rest"] = b - r["epochs"] * r["have"] if r["epochs"] < r["max_repeats"] else 0.0
    plan = spark.createDataFrame(
        [(r["source"], r["lang"], r["weight"], r["budget"], r["have"], r["epochs"], r["rest"], r["max_repeats"]) for r in rows],
        "source string, lang string, target double, budget double, have bigint, epochs int, rest double, max_repeats int",
    )
    uses = (F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).alias("uses")
    # The plan has one row for each pair of source and language.
    planned = clean.join(F.broadcast(plan) if len(rows) <= PLAN_ROWS else plan, leaf)
    chosen = seeded_order(planned, leaf, seed).select("doc_id", "source", "lang", "tokens", uses).filter(F.col("uses") > 0)
    return chosen, plan


def report(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: target and reached share, budget, tokens held and taken, documents and uses."""
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("taken"), F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("uses"))
    asked = plan.groupBy("source").agg(F.sum("target").alias("target"), F.sum("budget").alias("budget"), F.sum("have").alias("held"), F.max("max_repeats").alias("max_repeats"))
    full = asked.join(got, "source", "left").fillna(0, ["taken", "documents", "uses"])
    every = W.partitionBy()
    return full.select(
        "source", F.round("target", 6).alias("target_share"), F.round(F.try_divide(F.col("taken").cast("double"), F.sum("taken").over(every)), 6).alias("reached_share"),
        F.round("budget").cast("bigint").alias("budget"), "held", "taken", "documents", "uses", "max_repeats",
        (F.round("budget").cast("bigint") - F.col("taken")).alias("missed_tokens"),
    )


def document_mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = materialise(token_counts(spread(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")), "token-counts")
    return mix(docs, table(spark, sf_dir, "source_weights").select("source", "weight", "max_repeats"))
