"""Queries and operators of the subpackage that must do the whole job: cases that a bound or filter would lose."""

from codestrata.llm import registry

QUERIES = registry.queries()
TASKS = "example_id long, namespace string, project_path string, type string"


def test_split_has_every_task(spark, tmp_path):
    tasks = [(1, "a.x", "P/q", "f"), (2, "a.y", None, "f"), (3, "b.x", None, "m"), (4, None, None, "m"), (5, None, "p/q ", None), (6, "b.y", "r", "f")]
    spark.createDataFrame([*tasks, tasks[1]], TASKS).write.parquet(f"{tmp_path}/filtered.parquet")
    got = QUERIES["p7_split"](spark, str(tmp_path)).collect()
    assert sorted(r.example_id for r in got) == [1, 2, 3, 4, 5, 6]
    of = {r.example_id: (r.component, r.split) for r in got}
    assert of[1] == of[2] == of[5] and of[3] == of[6] and len({of[i][0] for i in (1, 3, 4)}) == 3
    assert QUERIES["p7_found"](spark, str(tmp_path)).count() == 0


def test_found_takes_no_null_project(spark, tmp_path):
    tasks = [(1, "a.x", "p", "f"), (2, "a.y", None, "f"), (3, "a.z", "q", "f")]
    spark.createDataFrame(tasks, TASKS).write.parquet(f"{tmp_path}/filtered.parquet")
    assert [tuple(r) for r in QUERIES["p7_found"](spark, str(tmp_path)).collect()] == [("p", "q")]
