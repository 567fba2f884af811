"""The tables a job reads, built lazily from one folder and shared between the jobs of a session."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions import geo, money
from riskspark.session import prepare
from riskspark.sources import tables

AS_OF = "2024-01-31 00:00:00"


class Lake:
    """Input tables of one folder. Frames are lazy plans; only the feature rows are persisted, because most reports
    start from them (a feature store would hold them on a cluster)."""

    _open: dict[tuple[int, str], Lake] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Lake:
        key = (id(spark._jsparkSession), folder.rstrip("/"))
        if key not in cls._open:
            cls._open[key] = cls(spark, folder)
        return cls._open[key]

    @classmethod
    def forget(cls) -> None:
        """Release persisted frames (the benchmark times every query from the files)."""
        for lake in cls._open.values():
            if "feature_events" in lake.__dict__:
                lake.feature_events.unpersist()
        cls._open.clear()

    def scan(self, table: str) -> DataFrame:
        return tables.scan(self.spark, self.folder, table)

    @property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp_ntz")

    @cached_property
    def events(self) -> DataFrame:
        """The event table; an input of fewer files than cores is spread over the cores first."""
        events = self.scan("events")
        cores = self.spark.sparkContext.defaultParallelism
        return events if events.rdd.getNumPartitions() >= cores else events.repartition(cores, "event_id")

    @cached_property
    def raw_auth_events(self) -> DataFrame:
        return tables.auth_events(self.events)

    @cached_property
    def auth_events(self) -> DataFrame:
        return tables.normalized_events(self.raw_auth_events)

    @cached_property
    def labels(self) -> DataFrame:
        return tables.fraud_labels(self.events)

    @cached_property
    def chargebacks(self) -> DataFrame:
        return tables.chargebacks(self.events)

    @cached_property
    def gazetteer(self) -> DataFrame:
        return geo.gazetteer(self.spark)

    @cached_property
    def rates(self) -> DataFrame:
        return money.default_rates(self.spark)

    @cached_property
    def customers(self) -> DataFrame:
        return tables.dim_customer(self.scan("customer"))

    @cached_property
    def devices(self) -> DataFrame:
        return tables.dim_device(self.events)

    @cached_property
    def ips(self) -> DataFrame:
        return tables.dim_ip(self.events)

    @cached_property
    def merchants(self) -> DataFrame:
        return tables.dim_merchant(self.events)

    @cached_property
    def scored_lines(self) -> DataFrame:
        return tables.scored_lines(self.scan("lineitem"))

    @cached_property
    def challenger_lines(self) -> DataFrame:
        return tables.scored_lines(self.scan("lineitem"), multiplier=37)

    @cached_property
    def ops_metrics(self) -> DataFrame:
        return tables.ops_metrics(self.events)

    @cached_property
    def traces(self) -> DataFrame:
        return tables.agent_traces(self.scan("conversations"))

    @cached_property
    def case_vectors(self) -> DataFrame:
        return tables.case_vectors(self.scan("embeddings"))

    def some_features(self, names: list[str]) -> DataFrame:
        """Events with these features; nothing else is computed and nothing persisted."""
        from riskspark.plans.features import event_features

        return event_features(
            self.auth_events, self.chargebacks, self.customers, self.devices, self.ips, self.gazetteer, names=names)

    @cached_property
    def feature_events(self) -> DataFrame:
        from riskspark.constants import FEATURES

        return self.some_features(FEATURES).persist()

    @cached_property
    def scored_events(self) -> DataFrame:
        """Events with features, rule and model scores and the decision."""
        from riskspark.plans.decisions import score_events

        return score_events(self.feature_events)

    @cached_property
    def decisions(self) -> DataFrame:
        """The decision log: no row for some events, and a later manual override for others."""
        from riskspark.plans.economics import decision_log

        return decision_log(self.scored_events)

    @cached_property
    def model_scores(self) -> DataFrame:
        from riskspark.plans.scoring_views import model_scores

        return model_scores(self.scored_events)

    @cached_property
    def graph_nodes(self) -> DataFrame:
        from riskspark.plans import graph

        return graph.nodes(self)

    @cached_property
    def graph_edges(self) -> DataFrame:
        from riskspark.plans import graph

        return graph.edges(self.auth_events)

    @cached_property
    def graph_pairs(self) -> DataFrame:
        from riskspark.operators.graph import undirected

        return undirected(self.graph_edges)

    @cached_property
    def graph_components(self) -> DataFrame:
        """(node, component), computed once per session from checkpointed rounds."""
        from riskspark.operators.graph import components

        return components(self.graph_nodes.select("node"), self.graph_edges)

    @cached_property
    def graph_risk(self) -> DataFrame:
        from riskspark.plans import graph

        return graph.account_risk(self)
