"""Catalogue of the problems: name, dimensions, sources, terms, and what they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, dimensions, sources, terms, flags (X exact solution, P Poisson, C collision, I implicit-explicit).
PROBLEMS = (
    ("advection_1", 1, 1, 1, "X"),
    ("continuity_1", 1, 2, 1, "X"),
    ("continuity_2", 2, 3, 2, "X"),
    ("continuity_3", 3, 4, 3, "X"),
    ("continuity_6", 6, 7, 6, "X"),
    ("diffusion_1", 1, 1, 3, "X"),
    ("diffusion_2", 2, 0, 2, "X"),
    ("fokkerplanck_1d_4p3", 1, 0, 1, "X"),
    ("fokkerplanck_1d_4p4", 1, 0, 2, "X"),
    ("fokkerplanck_1d_4p5", 1, 0, 3, "X"),
    ("fokkerplanck_1d_pitch_C", 1, 0, 1, "X"),
    ("fokkerplanck_1d_pitch_E_case1", 1, 0, 1, "X"),
    ("fokkerplanck_1d_pitch_E_case2", 1, 0, 1, "X"),
    ("fokkerplanck_2d_complete_case1", 2, 0, 6, ""),
    ("fokkerplanck_2d_complete_case2", 2, 0, 6, ""),
    ("fokkerplanck_2d_complete_case3", 2, 0, 6, ""),
    ("fokkerplanck_2d_complete_case4", 2, 0, 6, ""),
    ("vlasov", 2, 0, 5, "I"),
    ("two_stream", 2, 0, 4, "PI"),
    ("relaxation_1x1v", 2, 0, 3, "CX"),
    ("relaxation_1x2v", 3, 0, 6, "CX"),
    ("relaxation_1x3v", 4, 0, 9, "CX"),
    ("riemann_1x2v", 3, 0, 8, "C"),
    ("riemann_1x3v", 4, 0, 11, "C"),
    ("landau", 2, 0, 7, "PC"),
    ("landau_1x2v", 3, 0, 10, "PC"),
    ("landau_1x3v", 4, 0, 13, "PC"),
)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROBLEMS, "name string, dimensions int, sources int, terms int, flags string")


def catalogue_sql() -> str:
    rows = ", ".join(f"('{n}', {d}, {s}, {t}, '{f}')" for n, d, s, t, f in PROBLEMS)
    return f"SELECT name, dimensions::INTEGER AS dimensions, sources::INTEGER AS sources, terms::INTEGER AS terms, flags FROM (VALUES {rows}) v(name, dimensions, sources, terms, flags)"
