"""Scope graph (D5) cases: catalog span, column keying, stubs, status, cap."""
import pytest

from lineaweave.operators import graph as G

from lineage_data import lineage_rows

META = ("table_catalog string, table_schema string, table_name string, table_type string, table_owner string, "
        "comment string, created timestamp_ntz, last_altered timestamp_ntz")
COLUMN_META = ("table_catalog string, table_schema string, table_name string, column_name string, data_type string, "
               "full_data_type string, is_nullable string, ordinal_position int")
# a table name that two schemas share, with its own column in each
SHOP = {"intake.visits": "visitor", "intake.clicks": "pressed", "sales.visits": "takings"}
FLOWS = [("shop.intake.clicks", "shop.sales.visits"), ("lab.feeds.sensor", "shop.intake.visits"),
         ("lab.feeds.sensor", "lab.feeds.copy")]


@pytest.fixture(scope="module")
def scoped(spark):
    """(ids -> node rows, edges) of a scope of the shop, given more arguments; each is built once."""
    def split(name):
        return ("shop", *name.split("."))
    tables = spark.createDataFrame([(*split(t), "MANAGED", None, None, None, None) for t in SHOP], META)
    columns = spark.createDataFrame([(*split(t), c, "INT", "int", "YES", 1) for t, c in SHOP.items()], COLUMN_META)
    log = lineage_rows(spark, [(s, t, None, None) for s, t in FLOWS])
    built = {}

    def make(schema, **limits):
        key = (schema, *limits.items())
        if key not in built:
            g = G.build_scope_graph(log, tables, "shop", schema, columns_meta=columns, **limits)
            built[key] = {r.id: r for r in g.nodes.collect()}, {tuple(r) for r in g.edges.collect()}
        return built[key]
    return make


def test_a_catalog_holds_its_schemas_and_what_touches_them(scoped):
    nodes, edges = scoped(None)
    assert set(nodes) == {f"shop.{t}" for t in SHOP} | {"lab.feeds.sensor"}
    assert edges == set(FLOWS[:2])
    for table, column in SHOP.items():
        assert [c.name for c in nodes[f"shop.{table}"].columns] == [column]


def test_a_schema_shows_others_as_stubs(scoped):
    nodes, edges = scoped("intake")
    assert set(nodes) == {"shop.intake.visits", "shop.intake.clicks", "shop.sales.visits", "lab.feeds.sensor"}
    assert edges == set(FLOWS[:2])
    stub = nodes["shop.sales.visits"]
    assert (stub.upstream_count, stub.downstream_count, stub.lineage_status) == (1, 0, "leaf")
    assert (stub.table_type, stub.comment) == ("TABLE", "Cross-schema reference from shop.sales")
    assert set(scoped("sales")[0]) == {"shop.sales.visits", "shop.intake.clicks"}


def test_table_limit_is_for_catalogs(scoped):
    with pytest.raises(ValueError, match="3 tables"):
        scoped(None, max_tables=2)
    assert scoped("intake", max_tables=1) == scoped("intake")


def test_read_after_write_and_coverage(spark):
    """A table an entity writes never feeds it; its read becomes a direct
    edge. L9: a direct pair covered by an entity is not added in scope mode."""
    ev = lineage_rows(spark, [
        ("c.s.a", "c.s.b", "JOB", "1"),   # job reads a, writes b
        ("c.s.b", "c.s.d", "JOB", "1"),   # job reads b back (it wrote it), writes d
        ("c.s.a", "c.s.d", None, None),   # direct pair covered by job 1
    ])
    tables = spark.createDataFrame([("c", "s", t, "MANAGED", None, None, None, None) for t in "abd"],
                                   "table_catalog string, table_schema string, table_name string, "
                                   "table_type string, table_owner string, comment string, "
                                   "created timestamp_ntz, last_altered timestamp_ntz")
    g = G.build_scope_graph(ev, tables, "c", "s")
    edges = {tuple(r) for r in g.edges.collect()}
    e = "entity:JOB:1"
    assert edges == {("c.s.a", e), (e, "c.s.b"), (e, "c.s.d"), ("c.s.b", "c.s.d")}
