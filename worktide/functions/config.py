"""Settings: the constants of worked-time and allocation rules, as literals."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Label:
    """What a signal of one source means."""

    source: str
    family: str
    weight: float
    minutes: float
    active: bool
    productive: bool


# The labels of the synthetic events.
LABELS = (
    Label("purchase", "commit", 4.0, 90.0, True, True),
    Label("signup", "file", 3.0, 60.0, True, True),
    Label("click", "mail", 1.5, 20.0, True, True),
    Label("view", "mail", 0.4, 5.0, False, False),
    Label("error", "mail", 0.25, 3.0, False, False),
)


@dataclass(frozen=True)
class Settings:
    std_day_h: float = 8.0
    day_window: tuple[int, int] = (480, 1140)
    lunch: tuple[int, int] = (720, 780)
    dinner: tuple[int, int] = (1080, 1110)
    session_gap_min: float = 45.0
    visit_gap_min: float = 30.0
    visit_tail_min: float = 5.0
    passive_day_max_min: float = 60.0
    trace_pad_min: float = 5.0
    gap_bridge_min: float = 60.0
    flex_edge_h: float = 1.0
    trim_edges_min: float = 10.0
    night_pad_min: float = 30.0
    burst_n: int = 8
    future_slack_min: float = 5.0
    long_day_h: float = 16.0
    per_group: int = 8
    per_day: int = 40
    order_done_days: int = 14
    episode_gap_days: int = 3
    min_weight: float = 1.0
    retention_days: int = 400
    workdays: tuple[int, ...] = (1, 2, 3, 4, 5)
    holidays: tuple[str, ...] = ()
    labels: tuple[Label, ...] = field(default=LABELS)


#: Ranges outside which a setting falls back to its default, with a warning.
RANGES = {"std_day_h": (1.0, 24.0), "session_gap_min": (0.0, 240.0), "passive_day_max_min": (0.0, 1440.0), "burst_n": (2, 1000), "trim_edges_min": (0.0, 120.0), "flex_edge_h": (0.0, 4.0), "min_weight": (0.0, 100.0)}


def settings_from(raw: dict) -> tuple[Settings, list[tuple[str, str]]]:
    """Settings from untyped values, and (name, reason) for each one refused.

    Unknown names, values of another type and values out of range are refused;
    refused settings keep their defaults.
    """
    own, warnings, kept = {f.name: f for f in fields(Settings)}, [], {}
    for name, value in raw.items():
        if name not in own:
            warnings.append((name, "unknown"))
            continue
        default = getattr(Settings(), name)
        if isinstance(default, (int, float)):
            try:
                value = type(default)(value)
            except (TypeError, ValueError):
                warnings.append((name, "not a number"))
                continue
            low, high = RANGES.get(name, (float("-inf"), float("inf")))
            if not low <= value <= high:
                warnings.append((name, "out of range"))
                continue
        elif isinstance(default, tuple):
            value = tuple(value) if isinstance(value, (list, tuple)) else None
            if value is None or (default and name != "labels" and len(default) == 2 and len(value) != 2):
                warnings.append((name, "not a pair or list"))
                continue
        kept[name] = value
    return replace(Settings(), **kept), warnings


def judged_settings(rows: DataFrame) -> DataFrame:
    """``rows`` (name, value as text; many people's settings) with reason: why a value
    is refused, null where it is kept. The rules of ``settings_from`` as columns: pairs
    are two numbers with a comma between them, whole numbers have no fraction. The
    table of settings has a row for each field, so it is broadcast."""
    known = []
    for f in fields(Settings):
        if f.name != "labels":
            default = getattr(Settings(), f.name)
            low, high = RANGES.get(f.name, (float("-inf"), float("inf")))
            kind = "number" if isinstance(default, float) else "whole" if isinstance(default, int) else "pair" if len(default) == 2 else "list"
            known.append((f.name, kind, float(low), float(high)))
    table = rows.sparkSession.createDataFrame(known, "name string, kind string, low double, high double")
    number = F.expr("try_cast(value AS double)")
    whole = (F.col("kind") == "whole") & (number != F.floor(number))
    reason = (
        F.when(F.col("kind").isNull(), "unknown")
        .when((F.col("kind") == "pair") & ~F.coalesce(F.col("value").rlike(r"^-?[0-9.]+,-?[0-9.]+$"), F.lit(False)), "not a pair or list")
        .when(F.col("kind").isin("number", "whole"), F.when(number.isNull() | whole, "not a number").when(~number.between(F.col("low"), F.col("high")), "out of range"))
    )
    return rows.join(F.broadcast(table), "name", "left").select(*rows.columns, reason.alias("reason"))
