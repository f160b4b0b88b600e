"""Cross-operator invariants on the sf0.001 derived inputs."""
from pyspark.sql import functions as F

from lineaweave.operators import cost as CO
from lineaweave.operators import graph as G
from lineaweave.operators import traverse as TV
from lineaweave.plans import common as C
from lineaweave.sources import scans as S

SF = "/root/testdata/sf0.001"


def test_cost_total_equals_priced_usage(spark):
    u, p = C.fx(spark, SF, "usage"), C.fx(spark, SF, "list_prices")
    jc = CO.job_cost(u, p, C.COST_AS_OF, C.COST_DAYS)
    total, n = jc.agg(F.sum("cost_usd"), F.count("*")).first()
    priced = CO.price_usage(S.scan_usage(u, C.COST_AS_OF, C.COST_DAYS).filter(F.col("sku_name").like(CO.JOB_SKU_PATTERN))
                            .filter(F.col("job_id").isNotNull()), S.scan_prices(p))
    raw = float(priced.agg(F.sum("amount")).first()[0])
    assert abs(total - raw) <= 0.005 * n + 1e-9


def test_trace_cone_inside_highlight_closure(spark):
    ev = C.lineage(spark, SF)
    cone = {r.node for r in TV.trace_many(ev, [C.SEED], None).collect()}
    g = G.build_trace_graph(G.normalize_rows(G.dedupe_rows(ev)))
    ids, _ = TV.highlight(g, C.SEED)
    closure = {r.id for r in ids.collect()}
    assert cone and cone <= closure
