"""How many rows the joins and shuffles of a plan give, as it runs."""

from __future__ import annotations


def most(df, operator: str, metric: str) -> int:
    """The greatest value of a metric of df's operators of that name, once df has run."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        if operator in name and plan.metrics().contains(metric):
            found = max(found, plan.metrics().apply(metric).value())
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    return found


def most_joined(df) -> int:
    return most(df, "Join", "numOutputRows")


def most_shuffled(df) -> int:
    return most(df, "ShuffleExchange", "shuffleRecordsWritten")


def all_shuffled(df) -> int:
    """The rows of all shuffles of df's plan, as it runs."""
    df.collect()

    def under(plan) -> int:
        name = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
        own = plan.metrics().apply("shuffleRecordsWritten").value() if "ShuffleExchange" in name else 0
        return own + sum(under(x) for x in inner)

    return under(df._jdf.queryExecution().executedPlan())
