"""Assets of several modalities: filters, and search over their embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.upsert import upsert
from .vectors import search


def find(assets: DataFrame, user: str | None = None, modality: str | None = None) -> DataFrame:
    rows = assets
    if user is not None:
        rows = rows.where(F.col("user_id") == user)
    return rows if modality is None else rows.where(F.col("modality") == modality)


def store(assets: DataFrame, new: DataFrame) -> DataFrame:
    """``assets`` with new ones, which replace those under their id."""
    return upsert(assets, new, ["id"])


def get(assets: DataFrame, id_: str | int) -> DataFrame:
    return assets.where(F.col("id") == id_)


def delete(assets: DataFrame, ids: DataFrame) -> DataFrame:
    return assets.join(ids.select("id").distinct(), "id", "left_anti").select(*assets.columns)


def similar(assets: DataFrame, query: list[float], k: int, modality: str | None = None) -> DataFrame:
    return search(assets, query, k, where=None if modality is None else F.col("modality") == modality)
