"""Graph tables of one input folder, written once and shared by the rule and dashboard queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ranking import Ranked
from ..operators import feed
from ..operators import flags as fl
from ..operators import graph as g
from ..operators import registry as reg
from ..operators import rules as r
from ..operators import scores as sc
from ..session import written_table
from ..sources import tables as t

AS_OF = "2024-06-01"


def detected_at(entity_id: Column) -> Column:
    """Time of a flag: an hour count from the digits of the entity id."""
    hours = F.regexp_extract(entity_id, "[0-9]+", 0).cast("bigint") % 720
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(hours / 24).cast("int"))
    return F.concat(day.cast("string"), F.lit(" "), F.lpad((hours % 24).cast("string"), 2, "0"), F.lit(":00:00"))


class Store:
    """Lazy graph tables of ``sf_dir``. Written: profile, citizens, flags and clusters."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF):
        self.spark, self.sf_dir, self.as_of_text = spark, sf_dir, as_of
        self.as_of = F.lit(as_of).cast("date")

    def _written(self, name: str, build) -> DataFrame:
        return written_table(self.spark, f"{self.sf_dir}|{self.as_of_text}", name, build)

    # sources
    @cached_property
    def persons(self) -> DataFrame:
        return t.persons(self.spark, self.sf_dir)

    @cached_property
    def benef(self) -> DataFrame:
        return t.source_beneficiaries(self.spark, self.sf_dir)

    @cached_property
    def txn(self) -> DataFrame:
        return t.transactions(self.spark, self.sf_dir)

    @cached_property
    def scheme_dim(self) -> DataFrame:
        return t.scheme_dim(self.spark)

    # registry tables
    @cached_property
    def person_detail(self) -> DataFrame:
        return self._written("person_detail", lambda: reg.build_person_detail(self.persons))

    @cached_property
    def enrollments(self) -> DataFrame:
        def build() -> DataFrame:
            cash = reg.cash_enrollments(self.persons, t.cash(self.benef), t.cash(self.txn))
            health = reg.health_enrollments(self.persons, t.health(self.benef), t.health(self.txn))
            return reg.build_enrollments(cash, health)

        return self._written("person_scheme_enrollment", build)

    @cached_property
    def eligibility_status(self) -> DataFrame:
        """Status rows for two thirds of the enrollments."""
        e = self.enrollments
        code = F.substring("ration_card_memberid", 2, 20).try_cast("bigint")
        return e.where(F.coalesce(code % 3, F.lit(0)) != 0).select(
            "ration_card_memberid", "scheme_id", (code % 2 == 0).alias("is_eligible"),
            (F.col("enrollment_status") == "ACTIVE").alias("is_enrolled"),
            F.when(code % 2 == 0, "ELIGIBLE").otherwise("NOT_ELIGIBLE").alias("eligibility_state"),
        )

    # graph tables
    @cached_property
    def profile_raw(self) -> DataFrame:
        return self._written("profile", lambda: t.profile(self.spark, self.sf_dir).withColumn("row_no", F.col("sl_no"))).where("uid IS NOT NULL")

    @cached_property
    def profile(self) -> DataFrame:
        return g.normalize_profile(self.profile_raw)

    @cached_property
    def enrollment_keys(self) -> DataFrame:
        """Every enrollment key of the profile. Nothing is written: without its columns the payment rollup drops out of the plan."""
        rows = t.profile(self.spark, self.sf_dir).withColumn("row_no", F.col("sl_no")).where("uid IS NOT NULL")
        return g.normalize_profile(rows).select("enrollment_key").distinct()

    @cached_property
    def scheme_names(self) -> DataFrame:
        return self._written("scheme_names", lambda: g.scheme_nodes(self.profile, self.scheme_dim))

    @cached_property
    def schemes(self) -> DataFrame:
        return self._written("citizen_schemes", lambda: g.citizen_schemes(self.profile, self.scheme_names))

    @cached_property
    def places(self) -> DataFrame:
        cols = ["uid", "gp_code", "gp_name", "block_code", "block_name", "district_code", "district_name"]
        return self._written("places", lambda: self.profile.select(*cols).distinct())

    @cached_property
    def enrollment_nodes(self) -> DataFrame:
        return self._written("enrollment_nodes", lambda: g.enrollment_nodes(self.profile))

    @cached_property
    def member_of(self) -> DataFrame:
        return self._written("member_of", lambda: g.member_of(self.profile))

    @cached_property
    def operators(self) -> DataFrame:
        return g.operator_edges(self.profile)

    @cached_property
    def mobiles(self) -> DataFrame:
        return self.profile.where("mobile <> ''").select("uid", "mobile").distinct()

    @cached_property
    def scored(self) -> DataFrame:
        """Citizens with rollups, score and tier, before any rule."""
        def build() -> DataFrame:
            nodes = g.citizen_nodes(self.profile, self.as_of)
            rolled = nodes.join(g.citizen_rollups(self.enrollment_nodes), "uid", "left")
            return sc.vulnerability(rolled, self.schemes)

        return self._written("scored", build)

    @cached_property
    def dup(self) -> DataFrame:
        return self._written("duplicate_clusters", lambda: r.duplicate_clusters(self.scored))

    @cached_property
    def dob(self) -> DataFrame:
        return self._written("dob_clusters", lambda: r.dob_clusters(self.scored, self.places))

    @cached_property
    def state(self) -> DataFrame:
        return self._written("flag_state", lambda: fl.flag_state(self.scored, self.dup, self.dob))

    @cached_property
    def flags(self) -> DataFrame:
        def build() -> DataFrame:
            shared = r.shared_member_ids(self.member_of)
            return fl.sync_flags(self.state, self.member_of, self.operators, shared, detected_at)

        return self._written("flags", build)

    @cached_property
    def citizens(self) -> DataFrame:
        """Citizens as the dashboards see them: flag state plus the anomaly mark of H1 and I1."""
        odd = self.flags.where("entity = 'citizen' AND rule IN ('H1', 'I1')").select(F.col("entity_id").alias("uid")).distinct().withColumn("_a", F.lit(True))
        return self.state.join(odd, "uid", "left").withColumn("is_anomaly_flag", F.coalesce("_a", F.lit(False))).drop("_a")

    @cached_property
    def feed_members(self) -> DataFrame:
        return self._written("feed_members", lambda: feed.members(self.dup, self.dob))

    @cached_property
    def feed_entries(self) -> DataFrame:
        return self._written("feed_entries", lambda: feed.entries(self.citizens, self.places, self.schemes, self.flags, self.feed_members))

    @cached_property
    def feed_index(self) -> Ranked:
        return feed.ranked(self.feed_entries)

    @cached_property
    def scheme_totals(self) -> DataFrame:
        return g.scheme_totals(self.schemes)

    @cached_property
    def c1(self) -> DataFrame:
        return r.sync_c1(self.places, self.schemes, self.scheme_totals)

    def batch(self) -> dict[str, DataFrame]:
        return fl.batch_results(self.scored, self.schemes, self.places, self.member_of, self.state)

    @cached_property
    def batch_flags(self) -> DataFrame:
        return self._written("batch_flags", lambda: fl.persist_flags(self.batch()))


_stores: dict[tuple[str, str], Store] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = Store(spark, sf_dir)
    return _stores[key]
