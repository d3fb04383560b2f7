"""Every query with SQL gives the SQL's rows; authorization predicates each hide something."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from veridex import registry
from veridex.plans.run import Tables, apply

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    return sorted(tuple("NULL" if v is None else str(round(v, 6) + 0.0) if isinstance(v, float) else str(v.normalize()) if isinstance(v, Decimal) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(registry.ORACLES[name])
    assert cols == sorted(want.columns)
    assert plain(got.select(cols).collect()) == plain(want.select(*cols).fetchall())


def base(spark):
    """One user, one knowledge base and one readable chunk; each test changes one fact."""
    rows = {
        "chunk": ("chunk_id long, generation_id long, version_id long, document_id long, chunk_index long, line string", (1000, 1, 1, 5, 0, "a b")),
        "index_generation": ("generation_id long, version_id long, profile_id long, status string", (1, 1, 1, "READY")),
        "document_version": ("version_id long, document_id long, status string", (1, 5, "READY")),
        "document": ("document_id long, kb_id long, deleted boolean, acl_mode string, active_version_id long", (5, 0, False, "INHERIT", 1)),
        "knowledge_base": ("kb_id long, organization_id long, profile_id long", (0, 0, 1)),
        "chunk_embedding": ("chunk_id long, embedding array<double>, profile_id long", (1000, [1.0], 1)),
        "kb_member": ("user_id long, kb_id long, role string, revoked boolean", (2, 0, "READER", False)),
        "user_account": ("user_id long, organization_id long", (2, 0)),
        "document_acl": ("document_id long, user_id long", (99, 2)),
    }

    def result(table=None, **changes):
        tables = {}
        for name, (schema, row) in rows.items():
            names = [c.split()[0] for c in schema.split(", ")]
            value = tuple(changes.get(n, v) if name == table else v for n, v in zip(names, row, strict=True))
            tables[name] = spark.createDataFrame([value], schema)
        return apply(spark, registry.OPERATORS["authorized_chunks"], tables).count()

    return result


@pytest.mark.parametrize(
    "table, change, rows",
    [(None, {}, 1), ("index_generation", {"status": "BUILDING"}, 0), ("index_generation", {"profile_id": 2}, 0), ("document_version", {"status": "FAILED"}, 0), ("document", {"deleted": True}, 0), ("document", {"active_version_id": 2}, 0), ("document", {"acl_mode": "RESTRICTED"}, 0), ("knowledge_base", {"profile_id": None}, 0), ("chunk_embedding", {"profile_id": 2}, 0), ("kb_member", {"revoked": True}, 0), ("user_account", {"organization_id": 1}, 0)],
)
def test_each_predicate_hides(spark, table, change, rows):
    assert base(spark)(table, **change) == rows


def test_derived_tables_are_not_empty(spark):
    tables = Tables(spark, SF)
    for name in ("chunk", "citation", "gold_span", "candidate", "llm_usage", "outbox_event"):
        assert tables[name].count() > 0
