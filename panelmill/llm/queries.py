"""Queries of the llm problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.mixing import mix
from panelmill.llm.packing import pack
from panelmill.llm.tokens import with_token_counts
from panelmill.llm.topn import top_n
from panelmill.llm.truncation import cut_shares, cut_texts
from panelmill.session import read, written


def p6_top5(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "temp_rank_crsp_mc").select("date", "permno", "ttm_mc")
    return top_n(t, "date", "permno", "ttm_mc", 5).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "permno", "ttm_mc", "place")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_top5(spark, d).select("date", "permno")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per document, counted once and written: ranks, histogram and assignment all read them."""
    return written(with_token_counts(read(spark, d, "documents"), "text", ["doc_id", "source"]), "tokens")


def _specs(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    rows = read(spark, d, "pack_spec").where("spec_id IS NOT NULL AND capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id")
    return [(r[0], r[1]) for r in rows.collect()]  # the caller's few capacities


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d), "doc_id", "n_tokens", _specs(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers, the fewest that the tokens could fill, tokens and the share of the space that is used."""
    cap = {s: c for s, c in _specs(spark, d)}
    x = p7_containers(spark, d)
    caps = F.create_map(*[F.lit(v) for s, c in cap.items() for v in (int(s), int(c))])
    g = x.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    g = g.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.sum("n").alias("pieces"))
    size = caps[F.col("spec_id")]
    return g.withColumns({"bound": F.ceil(F.col("tokens") / size), "fill": F.round(F.col("tokens") / (F.col("containers") * size), 6)})


def _targets(spark: SparkSession, d: str) -> list[tuple[str, float, int]]:
    rows = read(spark, d, "mix_targets").where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL")
    return [(r["source"], r["target_share"], r["max_repeats"]) for r in rows.orderBy("source").collect()]  # the caller's few sources


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), "doc_id", "source", "n_tokens", _targets(spark, d))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), "doc_id", "source", "n_tokens", _targets(spark, d))[1]


def p9_cut(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts(read(spark, d, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_cut(spark, d).where("cut").select("doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return cut_shares(p9_cut(spark, d), "source")


def queries() -> dict:
    return {f.__name__: f for f in (p6_found, p6_top5, p7_containers, p7_report, p8_mixture, p8_report, p9_found, p9_cut, p9_shares)}


_TOP = """WITH b AS (SELECT date, permno, max(ttm_mc) AS ttm_mc FROM temp_rank_crsp_mc
 WHERE date IS NOT NULL AND permno IS NOT NULL AND ttm_mc IS NOT NULL AND NOT isnan(ttm_mc) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ttm_mc DESC, permno) AS place FROM b)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"{_TOP} SELECT strftime(date, '%Y-%m-%d') AS date, permno FROM r WHERE place <= 5",
        "p6_top5": f"{_TOP} SELECT strftime(date, '%Y-%m-%d') AS date, permno, ttm_mc, place FROM r WHERE place <= 5",
    }
