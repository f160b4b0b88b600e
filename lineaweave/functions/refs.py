"""Node-identity expressions: reference normalisation, labels, fqdn split.

All functions return ``Column`` expressions (JVM-side, whole-stage codegen);
none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _truthy(c: Column) -> Column:
    """Python truthiness of an optional string: not NULL and not empty."""
    return c.isNotNull() & (c != F.lit(""))


def path_ref(name: Column, path: Column) -> Column:
    """The path that names a node, ``dbfs:/Volumes/...`` as the bare ``/Volumes/...``; NULL if a table name wins or there is none."""
    return F.when(~_truthy(name) & _truthy(path), F.regexp_replace(path, r"^dbfs:(?=/Volumes/)", ""))


def normalize_ref(name: Column | str, path: Column | str, ref_type: Column | str, ref: Column | None = None) -> tuple[Column, Column]:
    """(full_name, path, type) -> (node_id, node_type).

    A table name wins over a path. ``dbfs:/Volumes/...`` is treated as the
    bare ``/Volumes/...``; a volume path with catalog, schema and volume
    becomes ``cat.schema.volume`` (VOLUME), a shorter one ``volume:<path>``;
    a cloud URL collapses to ``path:<proto>://<bucket>`` (PATH); any other
    path is ``path:<path>``. Both missing -> (NULL, NULL).

    ``ref`` is ``path_ref(name, path)`` as a column, for bulk rows: several
    branches read it, and as an expression it is compiled into each of them,
    which makes a method too large for the JVM to compile."""
    name = F.col(name) if isinstance(name, str) else name
    path = F.col(path) if isinstance(path, str) else path
    ref_type = F.col(ref_type) if isinstance(ref_type, str) else ref_type

    p = path_ref(name, path) if ref is None else ref
    is_vol = p.startswith("/Volumes/")
    vol_full = p.rlike(r"^/Volumes/[^/]*/[^/]*/")
    vol_id = F.regexp_replace(p, r"(?s)^/Volumes/([^/]*)/([^/]*)/([^/]*).*$", "$1.$2.$3")
    cloud_id = F.regexp_replace(p, r"(?s)^(.*?)://([^/]*).*$", "path:$1://$2")

    node_id = (
        F.when(_truthy(name), name)
        .when(is_vol, F.when(vol_full, vol_id).otherwise(F.concat(F.lit("volume:"), p)))
        .when(F.instr(p, "://") > 0, cloud_id)
        .otherwise(F.concat(F.lit("path:"), p))
    )
    node_type = (
        F.when(_truthy(name), F.when(_truthy(ref_type), ref_type).otherwise(F.lit("TABLE")))
        .when(is_vol, F.lit("VOLUME"))
        .when(p.isNotNull(), F.lit("PATH"))
    )
    return node_id, node_type


def is_entity_id(node_id: Column | str) -> Column:
    node_id = F.col(node_id) if isinstance(node_id, str) else node_id
    return node_id.startswith("entity:")


def entity_key(etype: Column | str, eid: Column | str) -> Column:
    etype = F.col(etype) if isinstance(etype, str) else etype
    eid = F.col(eid) if isinstance(eid, str) else eid
    return F.concat(F.lit("entity:"), etype, F.lit(":"), eid)


def has_entity(etype: Column | str, eid: Column | str) -> Column:
    etype = F.col(etype) if isinstance(etype, str) else etype
    eid = F.col(eid) if isinstance(eid, str) else eid
    return _truthy(etype) & _truthy(eid)


def path_display(node_id: Column) -> Column:
    """Bucket (or raw remainder) of a ``path:`` id."""
    raw = F.regexp_replace(node_id, "^path:", "")
    after = raw.substr(F.instr(raw, "://") + 3, F.length(raw))
    return F.when(F.instr(raw, "://") > 0, F.substring_index(after, "/", 1)).otherwise(raw)


def node_label(node_id: Column | str, node_type: Column | str) -> Column:
    """Display name: bucket for PATH, last dot segment otherwise."""
    node_id = F.col(node_id) if isinstance(node_id, str) else node_id
    node_type = F.col(node_type) if isinstance(node_type, str) else node_type
    return F.when(node_type == "PATH", path_display(node_id)).otherwise(
        F.element_at(F.split(node_id, r"\."), -1))


def stub_comment(node_id: Column | str, node_type: Column | str) -> Column:
    """Comment on an external stub node (volume / storage / cross-schema)."""
    node_id = F.col(node_id) if isinstance(node_id, str) else node_id
    node_type = F.col(node_type) if isinstance(node_type, str) else node_type
    parts = F.split(node_id, r"\.")
    prefix = F.when(F.size(parts) >= 2,
                    F.concat_ws(".", F.element_at(parts, 1), F.element_at(parts, 2))).otherwise(F.lit("external"))
    return (
        F.when(node_type == "VOLUME", F.concat(F.lit("Volume in "), prefix))
        .when(node_type == "PATH", F.concat(F.lit("External storage: "), F.regexp_replace(node_id, "^path:", "")))
        .otherwise(F.concat(F.lit("Cross-schema reference from "), prefix))
    )


def split_fqdn(full_name: Column | str) -> tuple[Column, Column, Column]:
    """(catalog, schema, name) only when the id has exactly 3 dot parts,
    else ('', '', '')."""
    full_name = F.col(full_name) if isinstance(full_name, str) else full_name
    parts = F.split(full_name, r"\.")
    ok = F.size(parts) == 3
    return tuple(F.when(ok, F.element_at(parts, i)).otherwise(F.lit("")) for i in (1, 2, 3))


# Display label of each table type (unknown types use MANAGED's).
TYPE_LABELS = {
    "MANAGED": "TABLE",
    "TABLE": "TABLE",
    "EXTERNAL": "TABLE",
    "VIEW": "VIEW",
    "MATERIALIZED_VIEW": "MAT VIEW",
    "EXTERNAL_LINEAGE": "CROSS-SCHEMA",
    "STREAMING_TABLE": "STREAMING",
    "VOLUME": "VOLUME",
    "PATH": "STORAGE",
}
CROSS_SCHEMA_TYPES = ("EXTERNAL_LINEAGE", "VOLUME", "PATH")


def type_label(table_type: Column | str) -> tuple[Column, Column]:
    """(display label, cross-schema flag) of a table type."""
    table_type = F.col(table_type) if isinstance(table_type, str) else table_type
    m = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    label = F.coalesce(m[table_type], F.lit(TYPE_LABELS["MANAGED"]))
    return label, F.coalesce(table_type.isin(*CROSS_SCHEMA_TYPES), F.lit(False))


def entity_label(etype: Column | str, eid: Column | str, name: Column | str | None = None,
                 width: int = 12) -> Column:
    """Resolved name, else ``{TYPE} {id[:width]}``; "—" when there is no entity."""
    etype = F.col(etype) if isinstance(etype, str) else etype
    eid = F.col(eid) if isinstance(eid, str) else eid
    fallback = F.concat(etype, F.lit(" "), F.substring(eid, 1, width))
    resolved = (F.col(name) if isinstance(name, str) else name) if name is not None else F.lit(None)
    return F.when(etype.isNull() | eid.isNull(), F.lit("—")).otherwise(F.coalesce(resolved, fallback))
