"""How much a Python worker holds at once, and how many tasks share the work on a small file."""

import pandas as pd

from shelfline.functions import text as X
from shelfline.plans import registry


def test_results_come_few_rows_at_a_time():
    seen = []
    read = lambda html, base: seen.append(len(html)) or pd.DataFrame({"n": html + base})
    batch = (pd.Series(range(1000)), pd.Series(range(1000)))
    out = pd.concat(X.in_steps(iter([batch, (pd.Series([7]), pd.Series([8]))]), read))
    assert max(seen) <= X.STEP and list(out["n"]) == [2 * i for i in range(1000)] + [15]


def test_rows_of_a_small_file_are_dealt_over_tasks(spark, tmp_path):
    parts = [(i, "red box tin", "b", "COIL") for i in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("page_identifiers", "page_states", "gtin_check", "second_readings", "search_keys"):
        df = registry.queries()[name](spark, str(tmp_path))
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString(), name
