"""Every query of the subpackage runs over the smallest tables, with the columns that are asked for."""

import pytest
from conftest import DATA

import __spark_entry__ as entry

COLUMNS = {"p1_found": ["ligne", "champ", "code"], "p2_found": ["origine", "ligne", "id"], "p3_found": ["saison", "id", "fiche"], "p4_found": ["saison", "id", "champ", "ligne"], "p5_found": ["ligne", "champ"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if QUERIES[n].__module__.startswith("palabre.llm")))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0
    if name.endswith("_found"):
        assert df.distinct().count() == df.count()


def test_p3_generates_no_classes_for_its_many_stages(spark, monkeypatch):
    from palabre.llm import queries

    key, seen = "spark.sql.codegen.wholeStage", []

    def link(*_):
        seen.append(spark.conf.get(key))
        raise LookupError

    monkeypatch.setattr(queries, "link_sources", link)
    monkeypatch.setattr(queries, "_job_forms", lambda *_: seen.append(spark.conf.get(key)) or [])
    for before in ("true", "false"):
        spark.conf.set(key, before)
        with pytest.raises(LookupError):
            queries.p3_found(spark, DATA)
        assert spark.conf.get(key) == before
    spark.conf.unset(key)
    assert seen == ["false"] * 4
