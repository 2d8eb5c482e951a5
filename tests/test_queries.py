import pytest

from larkspur.catalog import ORACLE, QUERIES
from tests.conftest import DATA
from tests.helpers import connect, same

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE[name])


WHOLE = {
    "lineitem": "cmp_ints cmp_float case_guards_error greatest_least shared_subexpression int_arith float_arith decimal_arith casts_narrow int_div_mod rint_cast gcd_lcm",
    "orders": "cmp_date_ts in_list any_all_array",
    "embeddings": "array_functions",
}


@pytest.mark.parametrize("name, rows", [(name, f"SELECT count(*) FROM {of}") for of, names in WHOLE.items() for name in names.split()] + [
    ("residual_left_join", "SELECT sum(greatest(n, 1)) FROM (SELECT count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49 GROUP BY o_orderkey)"),
    ("row_compare", "SELECT count(*) FROM orders WHERE o_custkey > 100 OR o_custkey = 100 AND o_orderkey > 500"),
    ("append_partitions", "SELECT count(*) FROM orders WHERE o_orderstatus IN ('F', 'O')"),
    ("dml_schema_evolution", "SELECT 2 * count(*) FROM orders"),
])
def test_query_gives_the_whole_table(spark, con, name, rows):
    assert QUERIES[name](spark, SF).count() == con.sql(rows).fetchall()[0][0]


@pytest.mark.parametrize("name, of", [("order_multi", "orders"), ("order_expression", "customer"), ("order_hidden_key", "customer"), ("sort_over_join", "orders")])
def test_whole_tables_come_in_order(spark, con, name, of):
    df, want = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    got = [tuple(r[c] for c in want.columns) for r in df.collect()]
    assert got == [tuple(r) for r in want.fetchall()]
    assert len(got) == con.sql(f"SELECT count(*) FROM {of}").fetchall()[0][0]
