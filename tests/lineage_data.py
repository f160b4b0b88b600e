"""Lineage rows for tests."""

import datetime as dt

LINEAGE_SCHEMA = ("source_table_full_name string, target_table_full_name string, source_type string, "
                  "target_type string, source_path string, target_path string, entity_type string, "
                  "entity_id string, event_time timestamp_ntz, created_by string, "
                  "source_table_catalog string, source_table_schema string, "
                  "target_table_catalog string, target_table_schema string")


def lineage_rows(spark, rows):
    """Lineage rows from (src, tgt, entity_type, entity_id[, src_path, tgt_path]) tuples."""
    out = []
    for r in rows:
        src, tgt, et, eid = r[:4]
        sp = r[4] if len(r) > 4 else None
        tp = r[5] if len(r) > 5 else None
        def parts(x):
            return (x.split(".")[0], x.split(".")[1]) if x and x.count(".") == 2 else (None, None)
        sc, ss = parts(src)
        tc, ts = parts(tgt)
        out.append((src, tgt, "TABLE" if src else None, "TABLE" if tgt else None, sp, tp, et, eid,
                    dt.datetime(2024, 1, 10, 12, 0, 0), "u1", sc, ss, tc, ts))
    return spark.createDataFrame(out, LINEAGE_SCHEMA)
