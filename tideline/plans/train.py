"""Training job: requests -> history rows -> regression and tree models -> registry."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.c45 import train_c45, tree_texts
from tideline.operators.joins import range_join
from tideline.operators.scoring import REGRESSION, TREE
from tideline.operators.training import annotate_quartiles, model_name, train_linear, training_projection
from tideline.session import materialise
from tideline.sources.registry import Registry
from tideline.specs import QUARTILE_LABELS, Dataset

REQUEST = ("msgid", "row_start", "row_end")


def training_rows(requests: DataFrame, history: DataFrame, spec: Dataset, time: str) -> DataFrame:
    """(request, training columns) for every history row in a request's range."""
    joined = range_join(requests.select(*REQUEST), history, time)
    return training_projection(joined, spec, keep=REQUEST)


def train_regressions(rows: DataFrame, spec: Dataset) -> DataFrame:
    *features, target = spec.training_fields
    models = train_linear(rows, REQUEST, features, target, select=True)
    return models.withColumns(
        {"name": model_name(spec.name, REGRESSION, F.col("row_end")), "kind": F.lit(REGRESSION)}
    )


def train_labelled_trees(
    rows: DataFrame, spec: Dataset, label_by: str | None = None, features: Seq[str] | None = None
) -> DataFrame:
    """Label every request's rows by quarter of one column, then grow and prune one tree per request."""
    column = label_by or spec.training_fields[1]
    labelled = annotate_quartiles(rows, REQUEST, column)
    nodes = train_c45(labelled, REQUEST, features or list(spec.training_fields), "result", QUARTILE_LABELS)
    return nodes.withColumns(
        {"name": model_name(spec.name, TREE, F.col("row_end")), "kind": F.lit(TREE)}
    )


def run(
    requests: DataFrame,
    history: DataFrame,
    spec: Dataset,
    time: str,
    registry: Registry,
    keep: Seq[str] = ("msgid", "name", "kind"),
    batch: str | None = None,
) -> DataFrame:
    """Train, store and return the published (message id, model name, kind) rows.

    With ``batch`` a repeated run under that name replaces the models of the first.

    The selected history rows feed both trainings, so they are written once.
    """
    rows = materialise(training_rows(requests, history, spec, time))
    regressions = materialise(train_regressions(rows, spec))
    trees = materialise(train_labelled_trees(rows, spec))
    registry.append(regressions.select("name", "kind", "intercept", "weights"), batch and f"{batch}-{REGRESSION}")
    texts = tree_texts(trees, ["msgid", "name", "kind"], list(spec.training_fields), QUARTILE_LABELS)
    tree_models = materialise(texts)
    registry.append(tree_models.select("name", "kind", "model"), batch and f"{batch}-{TREE}")
    return regressions.select(*keep).unionByName(tree_models.select(*keep))
