"""Lists with filters: what is refused, what an empty scope sees, ties."""

import pytest
from pyspark.sql import functions as F

from docuquarry.operators import listings


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, 10, "a", True, 5), (2, None, "b", None, 5), (3, 11, "a", False, 7), (4, 10, None, True, 5)]
    return spark.createDataFrame(rows, "id int, project_id int, action string, succeeded boolean, created_at int")


def test_audit_trail(log):
    ids = lambda *a, **k: [r.id for r in listings.audit_trail(log, *a, **k).collect()]
    assert ids([10], 1, 10) == [4, 2, 1] and ids([10, 11], 1, 2) == [3, 4] and ids([10, 11], 2, 2) == [2, 1] and ids([], 1, 10) == []
    assert ids([10, 11], 1, 10, action="a", succeeded=False) == [3] and ids([10, 11], 0, 1, action=None) == [3]
    with pytest.raises(ValueError):
        listings.audit_trail(log, [10], 1, 10, actor="x")


def test_existence_and_types(spark, log):
    assert listings.exists(log, {"action": "b"}) and not listings.exists(log, {"action": "b", "succeeded": True}) and not listings.exists(log.limit(0), {})
    profiles = spark.createDataFrame([("nda", True), ("msa", True), ("nda", True), ("old", False), (None, True), ("", True)], "agreement_type string, is_active boolean")
    assert [(r.agreement_type, r.place) for r in listings.known_types(profiles).orderBy("place").collect()] == [("msa", 0), ("nda", 1), ("other", 2)]
    assert listings.known_types(profiles.where("NOT is_active")).count() == 0
    shown = listings.response(log.limit(1), {"key": "id", "half": (F.col("created_at") / 2).cast("decimal(10,2)"), "day": F.to_date(F.lit("2024-01-02"))}).first()
    assert shown.asDict() == {"key": 1, "half": 2.5, "day": "2024-01-02"}
