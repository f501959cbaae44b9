"""Labels of entries: from the page, else from the topic model."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import first_of, label_of


def work_list(entries: DataFrame, only_missing: bool = False, slugs: list[str] | None = None, limit: int | None = None) -> DataFrame:
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    rows = entries.select("entry_slug", "entry_title", "url", "subdiscipline")
    if only_missing:
        rows = rows.filter("subdiscipline is null")
    if slugs:
        rows = rows.filter(F.col("entry_slug").isin(sorted(set(slugs))))
    rows = rows.orderBy("entry_slug")
    return rows if limit is None else rows.limit(limit)


def page_label(metas: Column, text: Column, aliases: dict[str, str] = K.ALIASES) -> Column:
    """The first meta content that is a label, else the first "field: label" of the text, fields in their order."""
    from_meta = F.get(F.filter(F.transform(metas, lambda m: label_of(m, aliases)), lambda x: x.isNotNull()), F.lit(0))
    fields = [label_of(F.regexp_extract(text, rf"(?i)\b{f}\s*:\s*([A-Za-z ,&/-]+)", 1), aliases) for f in K.LABEL_FIELDS]
    return first_of(from_meta, *fields)


def topic_label(payload: Column, labels: dict[str, str] = K.TOPIC_LABELS, least: float = K.MIN_TOPIC_PROBABILITY) -> Column:
    """The label of the most probable topic of a payload such as [{"topics": {"3": 0.4}}]; the first of equal ones; null under `least`."""
    topics = F.map_entries(F.get(F.from_json(payload, "array<struct<topics:map<string,double>>>"), F.lit(0))["topics"])
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"))
    best = F.aggregate(topics, none, lambda b, t: F.when(b["value"].isNull() | (t["value"] > b["value"]), F.struct(t["key"].alias("key"), t["value"].alias("value"))).otherwise(b))
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.when(best["value"] >= least, F.element_at(names, best["key"]))


def resolved(page: Column, topic: Column) -> Column:
    """(label, source): the page's label, else the topic's."""
    return F.struct(F.coalesce(page, topic).alias("label"), F.when(page.isNotNull(), "page").when(topic.isNotNull(), "topic").otherwise("none").alias("source"))


def color_of(label: Column, colors: dict[str, str] = K.COLORS, default: str = K.DEFAULT_COLOR) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in colors.items() for x in pair]), label), F.lit(default))


#: The keys of a file of categories, and of its topic model.
_MODEL = "inpho_topic_model"
_KEYS = ["default_color", "legend_order", "subdiscipline_colors", "aliases", _MODEL]
_MODEL_KEYS = ["k", "min_topic_probability", "topic_to_subdiscipline"]


@dataclass(frozen=True)
class Categories:
    """Labels, as a file names them: default and other colours, the order of a legend, other spellings, and the topic model's labels by topic id."""

    default_color: str
    legend_order: list[str]
    colors: dict[str, str]
    aliases: dict[str, str]
    topics: dict[str, str]
    least: float

    def resolved(self, metas: Column, text: Column, payload: Column) -> Column:
        """(label, source) of an entry."""
        return resolved(page_label(metas, text, self.aliases), topic_label(payload, self.topics, self.least))

    def color(self, label: Column) -> Column:
        return color_of(label, self.colors, self.default_color)

    def legend(self, labels: DataFrame) -> DataFrame:
        """labels(label) that occur -> (place, label, color), in the legend's order, others after it by name."""
        order = F.array_position(F.array(*map(F.lit, self.legend_order)), F.col("label"))
        rows = labels.filter("label is not null").select("label").distinct().withColumn("order", F.when(order > 0, order))
        return rows.select(F.row_number().over(Window.orderBy(F.asc_nulls_last("order"), "label")).alias("place"), "label", self.color(F.col("label")).alias("color"))  # as few rows as there are labels


def read_categories(spark: SparkSession, path: str) -> Categories:
    """Of a JSON file; a key that is missing, a topic without a label, and a label without a colour are errors."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    model = found.get(_MODEL) or {}
    missing = [k for k in _KEYS if k not in found] + [k for k in _MODEL_KEYS if k not in model]
    if missing:
        raise ValueError(f"{path}: no {', '.join(missing)}")
    topics = {str(k): v for k, v in model["topic_to_subdiscipline"].items()}
    missing = [str(i) for i in range(int(model["k"])) if str(i) not in topics]
    if missing:
        raise ValueError(f"{path}: no label for topics {', '.join(missing)}")
    strange = sorted({*found["aliases"].values(), *topics.values(), *found["legend_order"]} - found["subdiscipline_colors"].keys())
    if strange:
        raise ValueError(f"{path}: no colour for {', '.join(strange)}")
    return Categories(found["default_color"], found["legend_order"], found["subdiscipline_colors"], {k.lower(): v for k, v in found["aliases"].items()}, topics, float(model["min_topic_probability"]))
