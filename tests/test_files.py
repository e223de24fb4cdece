"""Facts of instance documents."""

from asofkit.sources.files import dimensional_facts


def test_an_empty_fact_and_a_split_member_shift_no_other_value(spark):
    context = '<context id="{0}"><s><x:explicitMember xmlns:x="u" dimension="seg">{1}</x:explicitMember></s></context>'
    fact = '<f tag="{0}" contextRef="{1}" unitRef="USD">{2}</f>'
    xml = "<xbrl>" + context.format("a", "A<!-- -->1") + context.format("b", "B") + fact.format("Empty", "a", "") + fact.format("One", "a", "1") + fact.format("Two", "b", "2") + "</xbrl>"
    got = dimensional_facts(spark.createDataFrame([(1, xml), (2, None)], "doc int, xml string"), "seg").collect()
    assert {(r["doc"], r["tag"], r["member"], r["value"]) for r in got if r["tag"] != "Empty"} == {(1, "One", "A1", 1.0), (1, "Two", "B", 2.0)}
