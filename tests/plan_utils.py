"""Walk an executed (adaptive) physical plan through py4j."""


def nodes(plan):
    out, todo = [], [plan]
    while todo:
        n = todo.pop()
        out.append(n)
        name = n.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(n.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(n.plan())
            continue
        ch = n.children()
        for i in range(ch.size()):
            todo.append(ch.apply(i))
    return out


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    return nodes(df._jdf.queryExecution().executedPlan())


def shuffled_columns(df):
    """Column names carried by every shuffle exchange of the executed plan."""
    cols = []
    for n in executed(df):
        if n.nodeName() == "Exchange" and "Broadcast" not in n.getClass().getSimpleName():
            out = n.output()
            cols.append({out.apply(i).name() for i in range(out.size())})
    return cols
