"""Customer profiles and scores as published batches, and the queries that serve them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ProfileBatch, ScoreBatch
from ..operators import customers, ranking
from .folder import Folder
from .publication import BatchStore, Place, PublicationError

PROFILE_COLUMNS = ("customer_id", "country", "recency_days", "orders", "purchase_amount", "cancellation_amount", "preferred_product", "r_score", "f_score", "m_score", "segment")


class UnknownCustomer(LookupError):
    """A batch has no such customer."""


class CustomerService:
    def __init__(self, spark: SparkSession, root: Place):
        root = Folder.of(spark, root)
        self.profiles, self.scores, self.spark = BatchStore(spark, root / "profiles", facets=("segment",)), BatchStore(spark, root / "scores"), spark

    def publish_profiles(self, batch: ProfileBatch, rows: DataFrame) -> bool:
        return self.profiles.publish(batch.dataset, batch.id, batch, rows.select(*PROFILE_COLUMNS), customers.broken_profiles)

    def publish_scores(self, dataset: str, batch: ScoreBatch, scores: DataFrame) -> bool:
        """Scores (customer_id, score) of exactly the customers of the profile batch, from 0 to 1."""
        known = self.profiles.rows(dataset, batch.profile_batch_id)
        if known is None:
            raise PublicationError(f"there is no profile batch {batch.profile_batch_id}")
        rows = scores.select("customer_id", ranking.stored_score(F.col("score")).alias("score"), F.lit(batch.profile_batch_id).alias("profile_batch"), F.lit(batch.model_id).alias("model_id"), F.lit(batch.horizon_days).alias("horizon_days"))

        def broken(rows: DataFrame) -> DataFrame:
            wide = rows.where(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1)).select("customer_id", F.lit("score out of range").alias("problem"))
            return ranking.coverage(known, rows).unionByName(wide)

        return self.scores.publish(dataset, batch.id, batch, rows, broken)

    def page(self, dataset: str, batch: str | None = None, limit: int = 100, after: str | None = None, segment: str | None = None, customer_id: str | None = None) -> DataFrame | None:
        """A page of a batch; the first page's batch is to be named for those after it, so that they agree.

        Only files that may hold the page's rows, and the row that says whether others follow, are opened.
        """
        customers.check_page(limit)
        batch = batch or self.profiles.current(dataset)
        if customer_id is not None:
            rows = self.profiles.lookup(dataset, customer_id, batch)
        else:
            rows = self.profiles.following(dataset, limit + 1, after, batch, **({} if segment is None else {"segment": segment}))
        return None if rows is None else customers.page(rows.withColumn("batch", F.lit(batch)), limit, after, segment, customer_id)

    def detail(self, dataset: str, customer_id: str, batch: str | None = None) -> dict:
        rows = self.profiles.lookup(dataset, customer_id, batch)
        found = rows.first() if rows is not None else None
        if found is None:
            raise UnknownCustomer(customer_id)
        return found.asDict()

    def prediction(self, dataset: str, customer_id: str, batch: str | None = None) -> dict | None:
        """The customer's score in the current score batch, if that belongs to the profile batch."""
        batch, rows = batch or self.profiles.current(dataset), self.scores.lookup(dataset, customer_id)
        if rows is None:
            return None
        found = rows.where(F.col("profile_batch") == batch).first()
        return found.asDict() if found else None

    def segments(self, dataset: str, batch: str | None = None) -> DataFrame | None:
        rows = self.profiles.rows(dataset, batch)
        return None if rows is None else customers.segment_summary(rows)

    def health(self) -> bool:
        return self.spark.range(1).count() == 1
