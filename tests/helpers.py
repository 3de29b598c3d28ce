"""Plan inspection and small frames."""


def plan_of(df) -> str:
    """The physical plan; after a run, the final one only."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(df) -> int:
    """Shuffles in the plan, broadcasts not counted."""
    return plan_of(df).count("Exchange hashpartitioning") + plan_of(df).count("Exchange rangepartitioning")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
