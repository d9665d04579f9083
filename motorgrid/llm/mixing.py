"""Mixing sources to target weights by iterative proportional fitting, all in DataFrame operations.

Token counts are summed per cell (source, language, topic). Raking scales the cells to the target
share of each source, then of each language, then of each topic, and again, until all three hold.
A document is then sampled with the probability of its cell: raked share over present share, scaled
so that the scarcest cells are taken whole. Tiny cells do not set the scale: those of the highest
ratios that hold at most ``CLIP`` of the raked weight together are clipped at 1, so they fall short
of their targets by less than that. Hot cells need no care: the corpus is only summed with partial
aggregation and joined with the cell table, whose rows are bounded by the categories.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorgrid.llm.common import settle

DIMENSIONS = ("source", "lang", "topic")
SWEEPS = 12
# Sweeps between two writes of the cell table, so plans stay short.
PER_PLAN = 4
# Exponent of the natural shares when no targets are given: below 1 lifts small categories.
TEMPER = 0.9
# Share of the raked weight whose cells may be clipped at probability 1.
CLIP = 0.02
# Ratios are compared in steps of a sixteenth of a power of two.
STEPS = 16
WORD = r"[^ \t\n\x0B\f\r]+"
HASH_RANGE = float(16**8)


def topic(text: Column) -> Column:
    """Kind of text: 'table', 'numbers', 'brief' or 'prose'."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(text.contains(" | "), "table").when(text.rlike("[0-9]{3}"), "numbers")
            .when(F.length(text) < 400, "brief").otherwise("prose"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _mix_source, _mix_lang, _mix_topic and _mix_tokens; null categories are ''."""
    return docs.withColumns({
        "_mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "_mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "_mix_topic": topic(F.col("text")),
        "_mix_tokens": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
    })


def _shares(cells: DataFrame, name: str, targets: Mapping[str, float] | None, temper: float
            ) -> DataFrame:
    """(name, _target_name): target share per category that has tokens, adding up to 1."""
    sums = cells.groupBy(name).agg(F.sum("tokens").alias("_t")).where("_t > 0")
    if targets is None:
        weighed = sums.select(name, F.pow(F.col("_t").cast("double"), temper).alias("_w"))
    else:
        given = cells.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in targets.items()], f"{name} string, _w double")
        weighed = sums.join(given, name, "left").select(
            name, F.coalesce("_w", F.lit(0.0)).alias("_w"))
    total = weighed.agg(F.sum("_w")).first()[0] or 1.0
    return weighed.select(name, (F.col("_w") / F.lit(float(total))).alias(f"_target_{name}"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None,
         sweeps: int = SWEEPS, temper: float = TEMPER) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with the raked share of each cell as ``weight``.

    ``targets`` gives weights per category of a dimension; a dimension that is not named gets its
    natural shares tempered. Categories without tokens are left out and the rest rescaled; categories
    that a given dimension does not name get nothing.
    """
    cells = cells.where("tokens > 0")
    for name in DIMENSIONS:
        given = (targets or {}).get(name)
        cells = cells.join(_shares(cells, name, given, temper), name)
    cells = settle(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for sweep in range(1, sweeps + 1):
        for name in DIMENSIONS:
            reached = F.sum("weight").over(Window.partitionBy(name))
            cells = cells.withColumn("weight", F.coalesce(
                F.col("weight") * F.col(f"_target_{name}") / F.nullif(reached, F.lit(0.0)),
                F.lit(0.0)))
        if sweep % PER_PLAN == 0 or sweep == sweeps:
            cells = settle(cells, "cells")
    return cells.select(*DIMENSIONS, "tokens", "weight")


def full_ratio(raked: DataFrame, clip: float = CLIP) -> float:
    """The ratio of weight to tokens that gets probability 1.

    Cells are summed by steps of their ratio, a table of some hundred rows at any size. From the
    highest step down, steps are clipped while they hold at most ``clip`` of the weight together.
    """
    steps = raked.where("weight > 0").withColumn("_ratio", F.col("weight") / F.col("tokens")).groupBy(
        F.floor(F.log2("_ratio") * STEPS).alias("_step")).agg(
        F.sum("weight").alias("_held"), F.max("_ratio").alias("_top"))
    every = Window.partitionBy(F.lit(0))
    reached = F.sum("_held").over(every.orderBy(F.desc("_step")))
    return steps.select("_top", (reached > clip * F.sum("_held").over(every)).alias("_full")).where(
        "_full").agg(F.max("_top")).first()[0] or 1.0


def cell_probabilities(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None,
                       sweeps: int = SWEEPS, temper: float = TEMPER, clip: float = CLIP
                       ) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability) of the cells of ``keyed`` documents."""
    cells = settle(docs.groupBy(*[F.col(f"_mix_{n}").alias(n) for n in DIMENSIONS]).agg(
        F.sum("_mix_tokens").alias("tokens")), "tokens")
    raked = rake(cells, targets, sweeps, temper)
    share = F.col("weight") / F.col("tokens") / F.lit(float(full_ratio(raked, clip)))
    return settle(raked.withColumn("probability", F.least(F.lit(1.0), share)), "probabilities")


def shares_reached(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None
                   ) -> DataFrame:
    """(dimension, category, target, expected): share of the tokens that raking gives a category and
    the share to expect in the sample; they differ by the clipped cells alone."""
    cells = cell_probabilities(keyed(docs), targets)
    total = Window.partitionBy("dimension")
    return cells.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("category"))
                            for n in DIMENSIONS])).alias("_c"), "weight",
        (F.col("tokens") * F.col("probability")).alias("_kept")).groupBy("_c").agg(
        F.sum("weight").alias("_weight"), F.sum("_kept").alias("_kept")).select(
        "_c.*", "_weight", "_kept").select(
        "dimension", "category", (F.col("_weight") / F.sum("_weight").over(total)).alias("target"),
        (F.col("_kept") / F.sum("_kept").over(total)).alias("expected"))


def draw(doc_id: Column) -> Column:
    """Uniform number in [0, 1) that depends on the doc_id alone; null counts as ''."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / HASH_RANGE


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None,
        sweeps: int = SWEEPS, temper: float = TEMPER, clip: float = CLIP) -> DataFrame:
    """``docs`` with _mix_probability and _mix_kept beside the columns of ``keyed``.

    A document of a cell without tokens has no share: its probability is 0. Rows of equal doc_id draw
    the same number, so repeated rows stay or go together. An empty table stays empty.
    """
    docs = keyed(docs)
    cells = cell_probabilities(docs, targets, sweeps, temper, clip).select(
        *[F.col(n).alias(f"_mix_cell_{n}") for n in DIMENSIONS],
        F.col("probability").alias("_mix_share"))
    match = F.lit(True)
    for name in DIMENSIONS:
        match = match & (F.col(f"_mix_{name}") == F.col(f"_mix_cell_{name}"))
    return docs.join(cells, match, "left").withColumn(
        "_mix_probability", F.coalesce("_mix_share", F.lit(0.0))).withColumn(
        "_mix_kept", draw(F.col("doc_id")) < F.col("_mix_probability")).drop(
        "_mix_share", *[f"_mix_cell_{n}" for n in DIMENSIONS])


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The sampled rows of ``docs``, all columns as they came."""
    return mix(docs, targets).where("_mix_kept").select(*[docs[c] for c in docs.columns])


def report(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability (9 digits) and kept per row."""
    return mix(docs.select("doc_id", "text", "source", "lang"), targets).select(
        "doc_id", F.col("_mix_source").alias("source"), F.col("_mix_lang").alias("lang"),
        F.col("_mix_topic").alias("topic"), F.col("_mix_tokens").alias("n_tokens"),
        F.round("_mix_probability", 9).alias("probability"), F.col("_mix_kept").alias("kept"))


def sql(sweeps: int = SWEEPS, temper: float = TEMPER, clip: float = CLIP) -> str:
    """DuckDB SQL of ``report`` with tempered targets."""
    steps = ["""d AS (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
             WHEN regexp_matches(coalesce(text, ''), '[0-9]{3}') THEN 'numbers'
             WHEN length(coalesce(text, '')) < 400 THEN 'brief' ELSE 'prose' END AS topic,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
    FROM documents)""", """c AS MATERIALIZED (
    SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL
    HAVING sum(n_tokens) > 0)"""]
    for name in DIMENSIONS:
        steps.append(f"""g_{name} AS MATERIALIZED (
    SELECT {name}, t / sum(t) OVER () AS g_{name}
    FROM (SELECT {name}, sum(tokens) ** {temper} AS t FROM c GROUP BY {name}))""")
    steps.append("""w0 AS MATERIALIZED (
    SELECT c.*, tokens AS w, g_source, g_lang, g_topic
    FROM c JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic))""")
    last = "w0"
    for step in range(sweeps * len(DIMENSIONS)):
        name = DIMENSIONS[step % len(DIMENSIONS)]
        steps.append(f"""w{step + 1} AS MATERIALIZED (
    SELECT * REPLACE (w * g_{name} / sum(w) OVER (PARTITION BY {name}) AS w) FROM {last})""")
        last = f"w{step + 1}"
    steps.append(f"""r AS MATERIALIZED (
    SELECT floor(log2(w / tokens) * {STEPS}) AS step, sum(w) AS held, max(w / tokens) AS top
    FROM {last} WHERE w > 0 GROUP BY ALL), f AS MATERIALIZED (
    SELECT max(top) AS full_ratio
    FROM (SELECT top, sum(held) OVER (ORDER BY step DESC) AS reached, sum(held) OVER () AS held FROM r)
    WHERE reached > {clip} * held), p AS MATERIALIZED (
    SELECT source, lang, topic, least(1.0, w / tokens / full_ratio) AS p FROM {last}, f)""")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(p, 0.0), 9) AS probability,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0
        < coalesce(p, 0.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""
