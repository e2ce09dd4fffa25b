"""Semantic models: metrics over a star of datasets, folded before they are joined and once after."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.validate import repeated_keys
from .marts import FULFILLED, fulfilled

GRAINS = ("day", "week", "month", "quarter", "year")


class ModelError(ValueError):
    """A metric, field or relationship the model does not hold, or one that would multiply rows."""


@dataclass(frozen=True)
class Relationship:
    """Many rows of `from_dataset` to one row of `to_dataset`, by one column each."""

    from_dataset: str
    to_dataset: str
    from_column: str
    to_column: str


@dataclass(frozen=True)
class Model:
    fact: str
    datasets: Mapping[str, Sequence[str]]
    time_fields: Sequence[str]
    relationships: Sequence[Relationship]
    metrics: Mapping[str, str]

    def link_to(self, dataset: str) -> Relationship:
        for link in self.relationships:
            if (link.from_dataset, link.to_dataset) == (self.fact, dataset):
                return link
        raise ModelError(f"no relationship leads from {self.fact} to {dataset}")

    def metric_by(
        self, tables: Mapping[str, DataFrame], metrics: Sequence[str], dimensions: Sequence[str] = (), *,
        verify: bool = True,
    ) -> DataFrame:
        """Metrics by dimensions. A dimension is `dataset.field`, or `dataset.field@grain` for a time field.

        Metrics are sums, so the fact is folded to the keys and fields that the dimensions ask for before any join: a dimension meets one
        row per key, and a second fold adds these up. Only the relationships the dimensions name are joined. With `verify`, a
        target whose key repeats is refused, as it would count its fact rows more than once.
        """
        wanted = [self._dimension(d) for d in dimensions]
        for name in metrics:
            if name not in self.metrics:
                raise ModelError(f"unknown metric {name!r}")
        links = {dataset: self.link_to(dataset) for dataset, _, _ in wanted if dataset != self.fact}
        if verify:
            for dataset, link in links.items():
                if not repeated_keys(tables[dataset], [link.to_column]).isEmpty():
                    raise ModelError(f"{dataset}.{link.to_column} repeats, so {dataset} would multiply the fact's rows")

        def fields(dataset: str) -> list[Column]:
            return [
                (F.date_trunc(grain, f"{dataset}.{field}").cast("date") if grain else F.col(f"{dataset}.{field}")).alias(f"_key{n}")
                for n, (owner, field, grain) in enumerate(wanted)
                if owner == dataset
            ]

        fact = tables[self.fact].alias(self.fact)
        own = [F.col(f"{self.fact}.{link.from_column}").alias(f"_{dataset}") for dataset, link in links.items()]
        rows = fact.groupBy(*own, *fields(self.fact)).agg(*[F.expr(self.metrics[name]).alias(name) for name in metrics])
        keys = [F.col(f"_key{n}").alias(field) for n, (_, field, _) in enumerate(wanted)]
        if not links:
            return rows.select(*keys, *metrics)
        for dataset, link in links.items():
            target = tables[dataset].alias(dataset)
            target = target.select(F.col(f"{dataset}.{link.to_column}").alias(f"_of_{dataset}"), *fields(dataset))
            rows = rows.join(target, F.col(f"_{dataset}") == F.col(f"_of_{dataset}"), "left")
        return rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in metrics])

    def _dimension(self, text: str) -> tuple[str, str, str | None]:
        path, _, grain = text.partition("@")
        dataset, _, field = path.partition(".")
        if field not in self.datasets.get(dataset, ()):
            raise ModelError(f"unknown field {path!r}")
        if grain and (grain not in GRAINS or path not in self.time_fields):
            raise ModelError(f"{text!r} is no time grain of a time field")
        return dataset, field, grain or None


def _fulfilled_sum(column: str) -> str:
    return f"sum(case when fct_order_lines.order_status = '{FULFILLED}' then fct_order_lines.{column} end)"


SALES = Model(
    fact="fct_order_lines",
    datasets={
        "fct_order_lines": (
            "line_id", "order_id", "order_date", "order_status", "order_region", "account_id", "channel_id",
            "promotion_id", "product_id", "quantity", "gross_amount", "discount_amount", "net_amount", "cost_amount",
        ),
        "dim_account": ("account_id", "account_name", "segment", "account_region", "signup_date", "arr"),
        "dim_channel": ("channel_id", "channel_name", "channel_type"),
        "dim_product": ("product_id", "product_name", "category", "unit_cost"),
        "dim_promotion": ("promotion_id", "promotion_name", "discount_type"),
    },
    time_fields=("fct_order_lines.order_date", "dim_account.signup_date"),
    relationships=[
        Relationship("fct_order_lines", f"dim_{name}", f"{name}_id", f"{name}_id")
        for name in ("account", "channel", "product", "promotion")
    ],
    metrics={"net_revenue": _fulfilled_sum("net_amount"), "gross_revenue": _fulfilled_sum("gross_amount")},
)


def active_customers(rows: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Accounts with a fulfilled order in the trailing window that ends at `as_of`, once each."""
    end = F.lit(as_of).cast("date")
    recent = (F.col("order_date") > F.date_sub(end, days)) & (F.col("order_date") <= end)
    return fulfilled(rows).where(recent).select("account_id").where("account_id is not null").distinct()
