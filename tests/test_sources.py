"""Reading, writing, snapshots, yearly files, legacy and seed loading."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal as D

import pytest
from clinic_cases import KEY, rows
from pyspark.sql import functions as F

from clinicframe import Clinic
from clinicframe.operators import changes, encryption
from clinicframe.plans.explain import differences, plan_text
from clinicframe.plans.views import create_views
from clinicframe.schemas import TABLES
from clinicframe.session import ensure_checkpoint_dir
from clinicframe.sources import legacy, seed, snapshots, tables, years


def test_write_and_read(clinic, spark, tmp_path):
    root = str(tmp_path / "clinic")
    tables.write_clinic(clinic, root)
    again = tables.read_clinic(spark, root)
    for name in Clinic.table_names():
        assert [f.name for f in again.table(name).schema] == TABLES[name].names
        assert differences(again.table(name), clinic.table(name)).isEmpty()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_clinic(clinic, root)


def test_clinic_needs_all_tables(clinic):
    with pytest.raises(ValueError, match="payments"):
        Clinic(**{n: df for n, df in clinic.tables().items() if n != "payments"})


def test_tables_are_built_on_first_use(clinic):
    built = []
    lazy = clinic.with_tables(cbc=lambda: built.append(1) or clinic.cbc)
    assert not built
    assert lazy.cbc is lazy.cbc and built == [1]


def test_catalog_and_views(clinic, spark):
    sealed = clinic.with_tables(
        clinic_patients=encryption.encrypt_column(clinic.clinic_patients, encryption.CONTACT, KEY, "keep"),
        payments=encryption.encrypt_column(clinic.payments, encryption.RECEIPT, KEY, "keep"),
    )
    names = create_views(sealed, KEY)
    assert tables.missing_tables(spark) == []
    assert names == sorted([
        "v_admin_audit_log", "v_doctor_clinical_view", "v_frontdesk_dashboard", "v_labtech_workspace", "v_patient_portal",
        "v_patients_decrypted", "v_payments_decrypted",
    ])
    assert spark.sql("select count(*) from v_frontdesk_dashboard join lab_test_catalog using (test_name) where price > 150").first()[0] == 4
    assert spark.sql("select visible_contact from v_patients_decrypted where patient_id = 'PAT-002'").first()[0] == "0902"
    assert tables.missing_columns(sealed.payments, ("order_id", "tip")) == ["tip"]


def test_row_counts(clinic):
    assert dict(rows(tables.row_count_profile(clinic))) == {
        "clinic_patients": 5, "lab_test_catalog": 4, "lab_test": 8, "cbc": 3, "urinalysis": 2, "fecalysis": 3, "payments": 6, "app_users": 6,
    }


def test_snapshots_publish_all_or_nothing(clinic, spark, tmp_path):
    root = str(tmp_path / "snap")
    assert snapshots.current_version(spark, root) == 0
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.read_snapshot(spark, root)
    assert snapshots.commit_snapshot(clinic, root) == 1
    one = snapshots.read_snapshot(spark, root)
    smaller = one.with_tables(lab_test=changes.delete_where(one.lab_test, F.col("order_id") > 5))
    assert snapshots.commit_snapshot(smaller, root, changed=("lab_test",), check=False) == 2
    two = snapshots.read_snapshot(spark, root)
    assert (two.lab_test.count(), two.payments.count()) == (5, 6)
    assert two.payments.inputFiles() == one.payments.inputFiles()
    assert snapshots.read_snapshot(spark, root, 1).lab_test.count() == 8
    # A failed write publishes nothing.
    broken = two.with_tables(cbc=two.cbc.withColumn("wbc", F.raise_error(F.lit("boom"))))
    with pytest.raises(Exception, match="boom"):
        snapshots.commit_snapshot(broken, root, check=False)
    assert snapshots.current_version(spark, root) == 2


def test_marks_survive_deletes_but_not_a_reload(clinic, spark, tmp_path):
    root = str(tmp_path / "marks")
    snapshots.commit_snapshot(clinic, root)
    less = clinic.with_tables(lab_test=clinic.lab_test.filter("order_id < 4"))
    snapshots.commit_snapshot(less, root, check=False)
    assert snapshots.high_water_marks(spark, root)["lab_test"] == 8
    snapshots.reload(less, root, check=False)
    assert snapshots.high_water_marks(spark, root)["lab_test"] == 3


def test_snapshot_keeps_encryption_columns(clinic, spark, tmp_path):
    root = str(tmp_path / "sealed")
    table = encryption.encrypt_column(clinic.payments, encryption.RECEIPT, KEY)
    snapshots.commit_snapshot(clinic.with_tables(payments=table), root)
    assert "receipt_token_hash" in snapshots.read_snapshot(spark, root).payments.columns


def test_yearly_files_are_pruned(clinic, spark, tmp_path):
    path = str(tmp_path / "years")
    years.write_orders_by_year(clinic.lab_test, path)
    found = years.orders_in_years(spark, path, 2024, 2024)
    assert {r[0] for r in rows(found, "order_id")} == {2, 3, 4, 6, 7, 8}
    plan = plan_text(found)
    assert "PartitionFilters: [isnotnull(order_year" in plan and "GreaterThanOrEqual(order_date,2024-01-01)" in plan
    assert all("order_year=2024" in f for f in found.inputFiles()) or "order_year" in plan


def test_year_ranges(clinic):
    ranges = dict(rows(years.orders_by_year_bucket(clinic.lab_test), "order_id", "year_bucket"))
    assert (ranges[1], ranges[2], ranges[4], ranges[5]) == ("p2023", "p2024", "p2024", "p2025")
    assert set(rows(years.orders_by_year_bucket(clinic.lab_test, (2000, 2001)), "year_bucket")) == {("p_future",)}


def test_legacy_tables(spark):
    now = datetime(2024, 1, 1)
    old = {
        "test_orders": spark.createDataFrame([(1, "PAT-001", 2, "2024-01-05", None)], "order_id int, patient_id string, test_id int, order_date string, status string"),
        "test_catalog": spark.createDataFrame([(2, "CBC", 12.5, None)], "test_id int, test_name string, price double, description string"),
    }
    live = legacy.from_legacy(old, now)
    assert {n: df.schema.names for n, df in live.items()} == {n: TABLES[n].names for n in ("lab_test", "lab_test_catalog")}
    assert rows(live["lab_test"], "order_id", "status", "created_at") == [(1, "PENDING", now)]
    assert rows(live["lab_test_catalog"], "price") == [(D("12.50"),)]
    with pytest.raises(ValueError, match="not legacy"):
        legacy.from_legacy({"payments": old["test_orders"]}, now)


def test_seed_files(spark, tmp_path):
    (tmp_path / "tests.csv").write_text("test_id,test_name,price,description\n7,CBC,200.00,\n9,LIPIDS,300,Fats\n")
    catalog = seed.read_seed(spark, str(tmp_path / "tests.csv"), "lab_test_catalog", ("test_id", "test_name", "price", "description"))
    assert sorted(rows(catalog, "test_id", "price", "description")) == [(7, D("200.00"), None), (9, D("300.00"), "Fats")]
    (tmp_path / "orders.csv").write_text("patient_id,test_id,order_date\nPAT-002,7,2024-01-02\nPAT-001,9,2024-01-01\n")
    orders = seed.read_seed(spark, str(tmp_path / "orders.csv"), "lab_test", ("patient_id", "test_id", "order_date"), ("order_date", "patient_id"))
    assert sorted(rows(orders, "order_id", "patient_id", "status")) == [(1, "PAT-001", "PENDING"), (2, "PAT-002", "PENDING")]
    assert orders.filter("created_at is null").isEmpty()
    (tmp_path / "bad.csv").write_text("test_id,test_name,price,description\nseven,CBC,200.00,\n")
    with pytest.raises(Exception, match="MALFORMED"):
        seed.read_seed(spark, str(tmp_path / "bad.csv"), "lab_test_catalog", ("test_id", "test_name", "price", "description")).collect()


def test_checkpoint_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)
