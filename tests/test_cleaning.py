"""Profiling, roles and cleaning on a small table with known faults."""

import csv
import io
import random

import pytest

from keepwell.operators import clean as c
from keepwell.operators import profile as p
from keepwell.roles import OfferRoles, Roles
from keepwell.sources import catalogue as cat
from keepwell.sources import files


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for i in range(120):
        plan = ["Basic", "basic ", " Premium", "Gold"][i % 4] if i else "Basic"
        charges = "1,200.50" if i == 1 else " " if i == 2 else "n/a" if i == 3 else str(20 + i % 50)
        churn = "" if i == 5 else "Yes" if i % 3 == 0 else "No"
        rows.append((i, f"C{i:04d}", charges, plan, churn))
    rows.append((200, "C0010", rows[10][2], rows[10][3], rows[10][4]))
    return spark.createDataFrame(rows, "row_id long, id string, charges string, plan string, "
                                       "Churn string")


ROLES = Roles("Churn", "Yes", ("id",), types={"id": "id", "charges": "numeric",
                                              "plan": "categorical"})


def test_clean_logs_every_fault(table):
    done = c.clean(table, ROLES, "row_id")
    log = {(r["step"], r["column"]): r["rows_affected"] for r in done.log.collect()}
    assert log[("blank_to_missing", "charges")] == 1
    assert log[("coerce_numeric", "charges")] == 1
    assert log[("drop_duplicates", None)] == 1
    assert log[("drop_missing_target", "Churn")] == 1
    assert log[("map_target", "Churn")] == 119
    assert log[("missing_left_for_model", "charges")] == 2
    assert log[("unify_case", "plan")] in (30, 31)
    frame = done.frame
    assert frame.count() == 119
    assert {r["plan"] for r in frame.select("plan").distinct().collect()} == {
        "Basic", "Premium", "Gold"}
    assert frame.where("charges = 1200.5").count() == 1
    h = done.health.first()
    assert (h["rows_before"], h["rows_after"], h["duplicates_removed"]) == (121, 119, 1)
    assert 0 <= h["health_score"] <= 100


def test_clean_does_not_depend_on_partitions(table):
    one = c.clean(table.repartition(1), ROLES, "row_id").frame.orderBy("row_id").collect()
    many = c.clean(table.repartition(7), ROLES, "row_id").frame.orderBy("row_id").collect()
    assert [r.asDict() for r in one] == [r.asDict() for r in many]


def test_clean_refuses_useless_tables(table):
    with pytest.raises(c.CleaningError, match="at least 500"):
        c.clean(table, ROLES, "row_id", min_rows=500)
    with pytest.raises(c.CleaningError, match="one class"):
        c.clean(table.where("Churn = 'No'"), ROLES, "row_id", min_rows=10)
    with pytest.raises(c.CleaningError, match="missing"):
        c.clean(table, Roles("nope", "Yes"), "row_id")


def test_identical_rows_without_id_are_kept(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", "Yes" if i % 2 else "No")
                                for i in range(20)], "row_id long, plan string, Churn string")
    done = c.clean(df, Roles("Churn", "Yes", types={"plan": "categorical"}), "row_id", 5)
    log = {r["step"]: r["rows_affected"] for r in done.log.collect()}
    assert log["possible_duplicates"] == 18 and done.frame.count() == 20


def test_invalid_negatives_rule(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(999)] + [(-5.0, -5.0)],
                               "charges double, balance double")
    got = {r["column"]: r["invalid"] for r in c.negative_shares(df, df.columns).collect()}
    assert got == {"charges": True, "balance": False}
    fixed, bad = c.null_invalid_negatives(df, ["charges", "balance"])
    assert bad == ["charges"] and fixed.where("charges is null").count() == 1


def test_outliers_need_spread(spark):
    flat = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 3, "x double")
    assert c.outlier_counts(flat, ["x"]).first()["either"] == 0
    wide = spark.createDataFrame([(float(i),) for i in range(30)] + [(500.0,)], "x double")
    r = c.outlier_counts(wide, ["x"]).first()
    assert (r["iqr"], r["zscore"]) == (1, 1)


def test_health_score_by_hand(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(c.health_score(
        F.lit(10.0), F.lit(2), F.lit(100), F.lit(0.1), F.lit(0.275)).alias("h")).first()
    # 100 - 40*.1 - 20*.2 - 20*.5 - 20*.5
    assert row["h"] == 72


def test_role_proposal(spark, table):
    facts = p.collect_facts(table, ["id", "charges", "plan", "Churn"], "row_id")
    roles = p.propose_roles(facts)
    assert roles.target == "Churn" and roles.positive == "Yes" and roles.ids == ("id",)
    assert roles.types["charges"] == "numeric" and roles.types["plan"] == "categorical"
    assert p.target_problem(facts) is None
    assert p.role_problems(roles, facts) == []
    bad = Roles("Churn", "Maybe", ("id", "gone"), time="plan")
    text = " ".join(p.role_problems(bad, facts))
    assert "positive label" in text and "gone" in text and "holds no numbers" in text


def test_offer_columns_take_one_part_each(spark):
    df = spark.createDataFrame([("A", "Yes", "2024-01-01", 3.0, "x")] * 5,
                               "OfferName string, OfferAccepted string, OfferDate string, "
                               "OfferCost double, CampaignGroup string")
    facts = p.collect_facts(df, df.columns)
    got = p.likely_offers(facts, set())
    assert got == OfferRoles("OfferName", "OfferAccepted", "OfferDate", "OfferCost",
                             "CampaignGroup", ())
    assert p.likely_offers(facts, set(df.columns)) is None


def test_target_problem_names_single_value(spark):
    df = spark.createDataFrame([("No", 1), ("No", 2), ("No", 3)], "churn string, x int")
    assert "a single value" in p.target_problem(p.collect_facts(df, df.columns))


def test_target_query_shows_every_column(spark):
    from keepwell.plans.catalogue.cleaning import _target_feasible

    kind = "churn string, plan string, x string, note string"
    for rows, feasible in (([("No", "a", "1", " "), ("No", "b", "2", None), ("No", "a", "3", "")], False),
                           ([("No", "a", "1", " "), ("Yes", "b", "2", None), ("No", "a", "3", "")], True)):
        df = spark.createDataFrame(rows, kind)
        got = sorted(tuple(r) for r in _target_feasible(spark, p.collect_facts(df, df.columns)).collect())
        assert got == [("churn", feasible, not feasible, True, feasible), ("plan", True, False, False, feasible),
                       ("x", False, False, False, feasible)]


def test_unordered_integers_need_an_id_name(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101, i * 2, (i * 53) % 101) for i in range(101)],
                               "row_id long, amount long, seq long, user_key long")
    ids = {r["column"] for r in p.likely_id_columns(
        p.column_facts(df, ["amount", "seq", "user_key"], "row_id")).collect()}
    assert ids == {"seq", "user_key"}


def test_headers():
    names, warnings = files.dedupe_headers(["a", "", "a", "a_2", "a", " "])
    assert names == ["a", "Unnamed", "a_2", "a_2_2", "a_3", "Unnamed_2"] and len(warnings) == 4


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("﻿id,plan,plan,x\n1,Café,\"a,b\",10\n,,,\n2,y,z,20\n".encode("utf-8"))
    df, warnings = files.read_csv(spark, str(path), min_rows=2)
    assert df.columns == ["id", "plan", "plan_2", "x", "row_id"] and len(warnings) == 1
    assert [r["plan"] for r in df.orderBy("row_id").collect()] == ["Café", "y"]
    typed = files.unify_mixed_columns(df, ["id", "plan", "x"])
    assert dict(typed.dtypes)["x"] == "bigint" and dict(typed.dtypes)["plan"] == "string"
    with pytest.raises(files.FileRejected, match="100 or more"):
        files.read_csv(spark, str(path))


def test_csv_encoding_and_ragged_rows(spark, tmp_path):
    latin = tmp_path / "latin.csv"
    latin.write_bytes("id,name\n1,Zo\xeb €\n".encode("cp1252"))
    assert files.choose_encoding(spark, str(latin)) == "windows-1252"
    assert files.read_csv(spark, str(latin), 1)[0].first()["name"] == "Zoë €"
    ragged = tmp_path / "ragged.csv"
    ragged.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(files.FileRejected, match="another number"):
        files.read_csv(spark, str(ragged), 1)


def test_export_protects_formulas(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 5, ["a", "b"]), ("ok", None, [])],
                               "t string, n int, r array<string>")
    files.export_tables({"predictions": df}, str(tmp_path), "csv")
    text = "".join(f.read_text() for f in (tmp_path / "predictions").glob("*.csv"))
    assert "'=1+1,5,a; b" in text and "ok,," in text


def test_catalogue_rules(tmp_path):
    path = tmp_path / "offers.json"
    path.write_text('[{"name": "A", "cost": 5, "assumed_acceptance_rate": 0.4, "eligible_segments":'
                    ' [{"column": "tenure", "min": 0, "max": 12}, {"risk_band": ["High"]}]}]')
    offer = cat.load_catalogue(path)[0]
    assert offer.rules[0].high == 12 and offer.rules[1].risk_band == ("High",)
    assert len(cat.load_catalogue()) == 5
    for text, words in (('[{"name": "A", "cost": -1, "assumed_acceptance_rate": 0.4}]', "cost"),
                        ('[{"name": "A", "cost": 1, "assumed_acceptance_rate": 2}]', "rates"),
                        ('[{"name": "A", "cost": 1, "assumed_acceptance_rate": 0.1},'
                         ' {"name": "a", "cost": 1, "assumed_acceptance_rate": 0.1}]', "duplicate"),
                        ('[{"name": "A", "cost": 1, "assumed_acceptance_rate": 0.1,'
                         ' "eligible_segments": [{"column": "x"}]}]', "min, max")):
        path.write_text(text)
        with pytest.raises(cat.CatalogueError, match=words):
            cat.load_catalogue(path)


def _serial(data, encoding="utf-8"):
    """Rows by Python's own reader: record number and cells of each record after the header."""
    rows = list(csv.reader(io.StringIO(data.decode(encoding), newline="")))
    return [(k, [c or None for c in row]) for k, row in enumerate(rows) if k and any(row)]


@pytest.mark.parametrize("end,piece", [("\n", 400), ("\r\n", 1700), ("\n", 1 << 20)])
def test_csv_in_byte_ranges(spark, tmp_path, end, piece):
    rnd = random.Random(piece)
    cell = lambda: rnd.choice(["", "a", "5\" pipe", "x\ny", 'say ""', "a,b", "é", "\n\n", "plain text", '"' * 3,
                               "long " * rnd.randrange(40)])
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "first name", "note"])
    for i in range(400):
        writer.writerow([i, cell(), cell()])
        if i % 97 == 0:
            out.write(f'{i}b,6" tall,an "inner" quote{end}{end}')
    data = out.getvalue().encode()
    (tmp_path / "in.csv").write_bytes(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(piece))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        table, _ = files.read_csv(spark, str(tmp_path / "in.csv"), 1)
        ranges = len(files.layout(spark, str(tmp_path / "in.csv")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ranges >= len(data) // piece * 0.9  # a range may hold no line's beginning
    got = [(r["row_id"], [r["id"], r["first name"], r["note"]]) for r in table.orderBy("row_id").collect()]
    assert got == _serial(data)
    assert [r["row_id"] for r in table.orderBy("row_id").collect()] == [k for k, _ in got]


def test_csv_faults(spark, tmp_path):
    def read(name, data):
        (tmp_path / name).write_bytes(data)
        return files.read_csv(spark, str(tmp_path / name), 1)

    with pytest.raises(files.FileRejected, match="not closed"):
        read("open.csv", b'a,b\n1,"2\n3,4\n')
    with pytest.raises(files.FileRejected, match="no header"):
        read("empty.csv", b"")
    with pytest.raises(files.FileRejected, match="another number"):
        read("short.csv", b"a,b\n1\n")
    two = tmp_path / "two"
    two.mkdir()
    (two / "1.csv").write_bytes(b"a,b\n1,2\n")
    (two / "2.csv").write_bytes(b"a,b\n3,4")
    table, _ = files.read_csv(spark, str(two), 1)
    assert sorted(map(tuple, table.collect())) == [("1", "2", 1), ("3", "4", 3)]
    (two / "3.csv").write_bytes(b"a,c\n3,4")
    with pytest.raises(files.FileRejected, match="differ"):
        files.read_csv(spark, str(two), 1)
