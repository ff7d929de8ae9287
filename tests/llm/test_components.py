import pytest

from tessera.llm import components


def test_too_few_rounds_raise(spark, monkeypatch):
    path = spark.range(40).selectExpr("id as a", "id + 1 as b")
    roots = {r["root"] for r in components.connected_components(path).collect()}
    assert roots == {0}
    monkeypatch.setattr(components, "MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError):
        components.connected_components(path)


def test_rounds_of_few_edges_write_few_files(spark, monkeypatch):
    """Each file that an executor writes costs it a task and, on a local disk, other processes."""
    write, tasks = components.materialize, []
    monkeypatch.setattr(components, "materialize", lambda df, name: tasks.append(df.rdd.getNumPartitions()) or write(df, name))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        edges = spark.range(300).selectExpr("id AS a", "id + id % 3 AS b")
        got = {(r["node"], r["root"]) for r in components.connected_components(edges).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    root = {}
    for i in range(300):  # b is a, a + 1 or a + 2
        root.setdefault(i, i)
        root[i + i % 3] = min(root[i], root.get(i + i % 3, i))
    assert all(root[a] == root[a + a % 3] for a in range(300))
    linked = {x for a in range(300) if a % 3 for x in (a, a + a % 3)}
    assert got == {(x, root[x]) for x in linked}
    assert len(tasks) > 1 and max(tasks[1:]) <= components.FEW_TASKS
