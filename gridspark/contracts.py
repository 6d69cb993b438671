"""What a column means, kept in its schema metadata, and the plan-time refusals that follow from it.

Every check in this file reads schemas only; nothing here starts a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# The closed vocabularies.
SEMANTICS = (
    "Extensive",
    "Intensive",
    "FluxDensity",
    "Fraction",
    "CategoricalLabel",
    "CategoricalFraction",
    "VectorComponent",
    "Quantiles",
)
TIME_SEMANTICS = (
    "Static",
    "Instantaneous",
    "IntervalMean",
    "IntervalAccumulation",
    "EndpointState",
)
MEASURES = ("primal_cell_area", "dual_area")
ATTRIBUTES = ("semantics", "time_semantics", "dimension", "support_id", "owner", "interval")


class Refusal(Exception):
    """A request with no meaning: what was refused, where, and why."""

    def __init__(self, quantity: str, site: str, reason: str):
        super().__init__(f"{site}: {quantity}: {reason}")
        self.quantity, self.site, self.reason = quantity, site, reason


def refuse(quantity: str, site: str, reason: str):
    raise Refusal(quantity, site, reason)


def require(ok: bool, quantity: str, site: str, reason: str) -> None:
    if not ok:
        refuse(quantity, site, reason)


def declare(
    df: DataFrame,
    column: str,
    *,
    semantics: str,
    time_semantics: str = "Static",
    dimension: Sequence[int] = (0, 0, 0, 0, 0),
    support_id: str = "",
    owner: str = "",
    interval: Sequence[float] = (),
    basis: str = "",
) -> DataFrame:
    """Attach a declaration to `column`; refuses a word outside the closed vocabularies."""
    require(semantics in SEMANTICS, column, "declare", f"{semantics!r} is not one of {SEMANTICS}")
    require(
        time_semantics in TIME_SEMANTICS,
        column,
        "declare",
        f"{time_semantics!r} is not one of {TIME_SEMANTICS}",
    )
    require(len(dimension) == 5, column, "declare", "a dimension is five integer exponents")
    return df.withMetadata(
        column,
        {
            "semantics": semantics,
            "time_semantics": time_semantics,
            "dimension": list(dimension),
            "support_id": support_id,
            "owner": owner,
            "interval": list(interval),
            "basis": basis,
        },
    )


def declaration(df: DataFrame, column: str) -> dict:
    """The declaration of `column`; refuses an undeclared one."""
    meta = df.schema[column].metadata or {}
    require("semantics" in meta, column, "declaration", "the column carries no declaration")
    return meta


def require_matching(df: DataFrame, column: str, expected: dict, site: str) -> None:
    """Refuse unless each required attribute is present and equals what the caller expects."""
    meta = df.schema[column].metadata or {}
    for name in ATTRIBUTES:
        require(name in meta, column, site, f"the attribute {name} is absent")
        require(name in expected, column, site, f"the caller states no {name}")
        want = list(expected[name]) if isinstance(expected[name], (list, tuple)) else expected[name]
        require(meta[name] == want, column, site, f"{name} is {meta[name]!r}, expected {want!r}")


def require_combinable(left: dict, right: dict, site: str) -> None:
    """The contract of an elementwise sum or difference of two declared columns."""
    for name in ("semantics", "time_semantics", "dimension", "support_id", "interval"):
        require(
            left[name] == right[name],
            name,
            site,
            f"{left[name]!r} on one side and {right[name]!r} on the other",
        )


# Dimension algebra on the five exponents.


def product(a: Sequence[int], b: Sequence[int]) -> tuple[int, ...]:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def quotient(a: Sequence[int], b: Sequence[int]) -> tuple[int, ...]:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def power(a: Sequence[int], n: int) -> tuple[int, ...]:
    return tuple(x * n for x in a)


# Combinations with no meaning: (operator, semantics, basis, time semantics, needs_rule) -> why.
# None in a slot leaves it open; needs_rule marks a refusal that naming a rule lifts.
REFUSALS = (
    ("coarsen", "Intensive", None, None, True, "name a rule: area mean, masked mean or quantiles"),
    ("coarsen", "VectorComponent", "east_north", None, False, "east differs by longitude: lift first"),
    ("refine", "VectorComponent", "east_north", None, False, "east differs by longitude: project after"),
    ("coarsen", "Quantiles", None, None, False, "order statistics do not re-aggregate"),
    ("refine", "Quantiles", None, None, False, "order statistics are not a moment to spread"),
    ("refine", "CategoricalFraction", None, None, False, "shares do not say which child held a class"),
    ("time_reduce", None, None, "Instantaneous", False, "an instant has no interval to reduce over"),
    ("time_reduce", None, None, "Static", False, "a static value has no interval to reduce over"),
)

# Working combinations that balance nothing: (operator, semantics, time semantics, rule) -> why.
NOT_CONSERVED = (
    ("coarsen", "Intensive", None, "quantiles", "order statistics are not an amount"),
    ("refine", "Intensive", None, None, "a repeated state is not an amount"),
    ("refine", "VectorComponent", None, None, "a repeated component is not an amount"),
    ("time_reduce", None, "EndpointState", None, "the last state balances nothing over the series"),
)


def refusal_reason(operator: str, meta: dict, rule: str | None = None) -> str | None:
    """Why `operator` has no meaning on a column declared by `meta`, or None where it works."""
    for op, sem, basis, time, lifted_by_rule, why in REFUSALS:
        if op != operator or (lifted_by_rule and rule):
            continue
        if sem not in (None, meta["semantics"]) or time not in (None, meta["time_semantics"]):
            continue
        if basis is not None and meta.get("basis") != basis:
            continue
        return why
    return None


def not_conserved_reason(operator: str, meta: dict, rule: str | None = None) -> str | None:
    """Why the working `operator` closes no balance, or None where a ledger applies."""
    for op, sem, time, needed, why in NOT_CONSERVED:
        if op == operator and sem in (None, meta["semantics"]) and time in (None, meta["time_semantics"]):
            if needed is None or needed == rule:
                return why
    return None


def require_meaning(operator: str, meta: dict, rule: str | None = None) -> None:
    why = refusal_reason(operator, meta, rule)
    if why:
        refuse(meta["semantics"], operator, why)


def raise_if_any(problems: DataFrame, quantity: str, site: str) -> None:
    """Run one small job and refuse with an example when `problems` holds a row."""
    found = problems.limit(1).collect()
    if found:
        refuse(quantity, site, f"for example {found[0].asDict()}")
