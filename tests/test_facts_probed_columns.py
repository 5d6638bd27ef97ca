"""Probed facts keep only the columns that are asked for."""

from notespark.plans import reports_facts


def test_kept_facts_have_no_other_columns(spark, monkeypatch):
    kept, cut = [], reports_facts.cut_lineage
    monkeypatch.setattr(reports_facts, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    reports_facts.facts_probed(spark, "/root/testdata/sf0.001")
    assert len(kept) == 1 and not {"source_note", "confidence"} & set(kept[0])
