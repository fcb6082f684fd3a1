"""Values that lie by case are compared where they lie, with the results of values that do not."""
from pyspark.sql import functions as F

from dossier import queries
from dossier.operators import agreement
from dossier.session import cut_by
from dossier.sources.bindings import Bindings

FOLDER = "/root/testdata/sf0.001"


def _fields(spark):
    rows = [("c1", f"d{k}", "pan", f"f{k}", k, "address", f"{k} long road {k % 7}") for k in range(agreement.FOLD_VALUES + 6)]
    rows += [("c1", "e1", "pan", "e", 90, "address", "-"), ("c1", "e2", "pan", "e", 91, "address", "!"),
             ("c2", "d1", "pan", "f", 1, "full_name", "Anna Doe"), ("c2", "d2", "pan", "f", 2, "full_name", "A Doe"),
             ("c2", "d3", "pan", "f", 3, "full_name", "\u4e2d"), ("c2", "d4", None, "f", 4, "gender", "F"), ("c2", "d5", "pan", "f", 5, "gender", "M"),
             (None, "d6", "pan", "f", 6, "full_name", "Bob"), (None, "d7", "pan", "f", 7, "full_name", "Rob")]
    return spark.createDataFrame(rows, "case_id string, document_id string, document_type string, file_name string, doc_ord int, "
                                       "field_name string, value string")


def test_support_where_values_lie(spark):
    values = agreement.field_values(_fields(spark))
    dealt = cut_by(values.repartition(4, "case_id"), "case_id", 4)
    plain, fuzzy = agreement.support_parts(dealt, together=True)
    got = {(r["case_id"], r["form"]): r["agreeing"] for r in plain.unionByName(fuzzy).collect()}
    want = {(r["case_id"], r["form"]): r["agreeing"] for r in agreement.support(values).collect()}
    assert got == want and len(got) == values.count()
    assert got["c2", ""] == 0 and got["c1", ""] == 0 and got["c2", "A DOE"] == 2 and got[None, "BOB"] == 1


def test_findings_move_no_values(spark):
    """Only findings of written groups are dealt anew; before, every value was."""
    found = queries.QUERIES["consistency_findings"](spark, FOLDER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning" in line and "form#" in line for line in plan.split("\n"))
    fields = Bindings(spark, FOLDER).fields
    want = agreement.consistency(agreement.clusters(agreement.field_values(fields)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_comparison_by_parts(spark):
    b = Bindings(spark, FOLDER)
    values = agreement.field_values(b.fields)
    want = agreement.comparison(agreement.support(values), agreement.consistency(agreement.clusters(values)))
    got = queries.QUERIES["comparison_table"](spark, FOLDER)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert got.filter(F.col("status") == "mismatch").count() > 0
