"""Tables brought to a changed catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.catalog import Catalog, Model


def steps(old: Catalog, new: Catalog) -> list[tuple[str, str, str | None, str | None]]:
    """(step, model, column, type) that lead from one catalog's tables to the other's: create_table, drop_table, add_column, drop_column, change_type."""
    out = []
    for name in sorted({*old.models, *new.models}):
        if name not in old.models:
            out.append(("create_table", name, None, None))
            out += [("add_column", name, f.name, f.dataType.simpleString()) for f in new.models[name].schema()]
        elif name not in new.models:
            out.append(("drop_table", name, None, None))
        else:
            before, after = ({f.name: f.dataType.simpleString() for f in c.models[name].schema()} for c in (old, new))
            out += [("add_column", name, c, t) for c, t in after.items() if c not in before]
            out += [("drop_column", name, c, t) for c, t in before.items() if c not in after]
            out += [("change_type", name, c, t) for c, t in after.items() if c in before and before[c] != t]
    return out


def conformed(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with the model's columns alone: new ones are null, values that don't fit a new type, too."""
    out = []
    for f in model.schema():
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name) if df.schema[f.name].dataType == f.dataType else F.col(f.name).try_cast(f.dataType).alias(f.name))
    return df.select(*out)
