import pytest

from pulsegrid.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_matches_sql(spark, compare, name):
    compare(registry.queries()[name](spark, FOLDER), registry.oracle_sql()[name], FOLDER)


def test_boxcar_of_ones(spark):
    from pulsegrid.operators.spectra import boxcars

    series = spark.range(21).selectExpr("0 as beam", "id as t", "1L as v")
    for t, w, s in boxcars(series, (1, 4, 13)).select("t", "width", "s").collect():
        assert s == min(t + 1, w)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(registry.queries()) <= set(entry.queries())


def test_registry_binds_each_name_once():
    """Queries look their helpers up when they run, so a name bound again changes queries registered before."""
    import ast
    from collections import Counter
    from pathlib import Path

    bound = Counter()
    for node in ast.parse(Path(registry.__file__).read_text()).body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        bound.update(n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store))
        bound.update([node.name] if isinstance(node, ast.FunctionDef | ast.ClassDef) else [])
    assert not [name for name, times in bound.items() if times > 1]
