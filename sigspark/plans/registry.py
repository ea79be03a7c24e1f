"""Declared experiment menus. A menu is fixed before anything is scored, and its size is what families of tests count."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession

# The axes of the declared studies.
ESTIMATORS = ("ols", "ridge", "lasso", "enet")
TARGETS = ("raw", "dgtw")
FIT_SESSIONS = (252, 504, 756)
FEATURE_SETS = ("core", "all", "textcore", "textall")
CHARACTERISTIC_SETS = 11
DESIGN_SPECS, DESIGN_HISTORIES, REFITS = 19, ("fixed", "selected"), ("retain", "recent", "union")
INTERACTION_BASES, INTERACTION_ESTIMATORS, SINGLE_PRODUCTS = 13, ("ridge", "lasso", "enet"), 35


def menu(**axes: Sequence) -> list[dict]:
    """Every combination of the axes, in order, each with a model_id."""
    out = []
    for values in product(*axes.values()):
        spec = dict(zip(axes, values, strict=True))
        out.append({"model_id": "_".join(str(v) for v in values)} | spec)
    return out


def studies() -> dict[str, list[dict]]:
    characteristics = [f"set{i:02d}" for i in range(1, CHARACTERISTIC_SETS + 1)]
    interactions = [{"model_id": f"{t}_{s}"} for t in TARGETS for s in [f"basis{b:02d}_{e}" for b in range(1, INTERACTION_BASES + 1) for e in INTERACTION_ESTIMATORS] + [f"single{k:02d}" for k in range(1, SINGLE_PRODUCTS + 1)]]
    return {
        "linear": menu(estimator=ESTIMATORS, features=FEATURE_SETS, target=TARGETS, fit=FIT_SESSIONS),
        "characteristics": menu(estimator=ESTIMATORS, features=characteristics, target=TARGETS, fit=FIT_SESSIONS),
        "design": menu(spec=[f"spec{i:02d}" for i in range(1, DESIGN_SPECS + 1)], history=DESIGN_HISTORIES, refit=REFITS),
        "interactions": interactions,
    }


#: (family, the axis values of the benchmark, which models are compared with it)
COMPARISONS = (
    ("feature", {"features": "core"}, lambda s: s["features"] != "core"),
    ("feature", {"features": "all"}, lambda s: s["features"] == "textall"),
    ("estimator", {"estimator": "ols"}, lambda s: s["estimator"] != "ols"),
    *(("estimator", {"estimator": e}, lambda s: s["estimator"].startswith("nn")) for e in ("ridge", "lasso", "enet")),
    ("history", {"fit": 504}, lambda s: s["fit"] != 504),
)


def declared_contrasts(study: Sequence[dict]) -> list[tuple[str, str, str, str, int]]:
    """(contrast, family, a, b, family_size) of every declared pair of one study's models.

    A benchmark is the same model with some axes set otherwise; its family counts all pairs declared
    under its name, scored or not.
    """
    key = lambda s: tuple(sorted((k, v) for k, v in s.items() if k != "model_id"))
    known = {key(s): s["model_id"] for s in study}
    if len(known) != len(study):
        raise ValueError("two models of the study are the same")
    found = []
    for s in study:
        for family, other, applies in COMPARISONS:
            if applies(s) and (b := known.get(key(s | other))):
                found.append((f"{s['model_id']}-{b}", family, s["model_id"], b))
    size = {f: sum(x[1] == f for x in found) for f in {x[1] for x in found}}
    return [(*x, size[x[1]]) for x in found]


def complete(found: Sequence[str], study: Sequence[dict]) -> list[str]:
    """Declared models that a registry lacks; a model that was not declared is an error."""
    declared = [s["model_id"] for s in study]
    if extra := sorted(set(found) - set(declared)):
        raise ValueError(f"not declared: {extra[:5]}")
    return [d for d in declared if d not in set(found)]


def require_before(dates_max: str, bound: str) -> None:
    """Refuse to score dates from ``bound`` on: the period held back stays held back."""
    if dates_max >= bound:
        raise ValueError(f"scoring ends before {bound}")


def sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, len(s)) for name, s in studies().items()], "study string, n_models long")
