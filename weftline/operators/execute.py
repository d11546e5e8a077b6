"""Running a mapping: a target table as one DataFrame over its sources, joined along a path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import transforms as t
from .paths import Step

# Words of columns that count, so that a product with them is meant.
COUNTING = ("quantity", "qty", "count", "units")
PARTS = {"year": t.extract_year, "quarter": t.extract_quarter, "week": t.extract_week, "day": t.extract_day, "hour": t.extract_hour, "month": lambda c: F.month(c)}


def joined(tables: dict[str, DataFrame], primary: str, paths: list[list[Step]]) -> DataFrame:
    """The primary table left-joined along paths; each column is named table.column with two underscores between."""

    def named(name: str) -> DataFrame:
        return tables[name].select(*[F.col(f"`{c}`").alias(f"{name}__{c}") for c in tables[name].columns])

    out, have = named(primary), {primary}
    for path in paths:
        for s in path:
            if s.target in have:
                continue
            on = [F.col(f"{s.source}__{a}") == F.col(f"{s.target}__{b}") for a, b in zip(s.left, s.right)]
            out = out.join(named(s.target), on, "left")
            have.add(s.target)
    return out


def materialize(tables: dict[str, DataFrame], primary: str, paths: list[list[Step]], columns: dict[str, Column]) -> DataFrame:
    """columns maps target names to expressions over table__column. Catalyst prunes what no target needs."""
    return joined(tables, primary, paths).select(*[c.alias(n) for n, c in columns.items()])


def expression(transform: str, refs: list[str], target: str, kind: str) -> Column:
    """The column over table__column that a mapping's transformation stands for."""
    cs = [F.col(r.replace(".", "__", 1)) for r in refs]
    words = target.lower().split("_")
    if not cs:
        return F.lit(None).cast(kind)
    if transform == "concat":
        return t.concat(*cs, sep=" ")
    if transform == "template":
        return F.concat_ws(" - ", *cs)
    if transform == "date_part":
        return next((made(cs[0]) for word, made in PARTS.items() if word in words), F.year(cs[0]))
    if transform == "date_diff":
        return F.abs(F.datediff(cs[-1], cs[0])) if len(cs) > 1 else F.datediff(F.current_date(), cs[0])
    if transform == "date_format":
        return F.date_format(cs[0], "yyyy-MM-dd")
    if transform == "date_parse":
        return F.try_to_date(cs[0])
    if transform == "arithmetic":
        counted = any(w in r.lower() for r in refs for w in COUNTING)
        return reduce((lambda a, x: a * x) if counted else (lambda a, x: a + x), cs)
    return t.type_cast(cs[0], kind) if transform == "type_cast" else cs[0]


def load(tables: dict[str, DataFrame], mappings: list[Row], target: str, kinds: dict[str, str]) -> DataFrame:
    """A target table from the mappings that plan_mappings gives: its primary table, joined along the mappings' join tree.

    kinds: each target column's type, in order. Columns that no mapping fills, or whose join is not known, are null.
    """
    own = {m.tc: m for m in mappings if m.tt == target}
    primary = next((m.primary for m in own.values() if m.primary), None)
    if primary is None:
        raise ValueError(f"no mapping leads to a primary table of {target}")
    steps = [Step(p["from"], p["to"], tuple(p["left_cols"]), tuple(p["right_cols"]), p["confidence"], "") for m in own.values() for p in m.join_path or ()]
    reached = {primary, *(s.target for s in steps)}
    made = {}
    for column, kind in kinds.items():
        m = own.get(column)
        known = m is not None and all(r.split(".")[0] in reached for r in m.refs)
        made[column] = expression(m.transform, m.refs, column, kind) if known and m.refs else F.lit(None).cast(kind)
    return materialize(tables, primary, [list(dict.fromkeys(steps))], made)
