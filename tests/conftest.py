from __future__ import annotations

import sys
from datetime import date, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clinic_cases import THEN, money  # noqa: E402

from clinicframe import Clinic, build_session  # noqa: E402
from clinicframe.schemas import TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "clinicframe-tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Build a DataFrame of one clinic table from dicts; left-out columns are NULL, time stamps fixed."""

    def table(name: str, *rows: dict):
        schema = TABLES[name]
        filled = [{"created_at": THEN, "updated_at": THEN, **r} for r in rows]
        loose = type(schema)([type(f)(f.name, f.dataType, True) for f in schema.fields])
        return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in filled], loose)

    return table


@pytest.fixture
def clinic(make) -> Clinic:
    """Five invented patients, four tests, eight orders, a few panels and payments."""

    def patient(n, first, last, age, sex, address, contact):
        return {"patient_id": f"PAT-{n:03d}", "first_name": first, "last_name": last, "age": age, "sex": sex, "address": address,
                "contact": contact, "registered_at": THEN}

    def order(n, who, test, day, status):
        return {"order_id": n, "patient_id": f"PAT-{who:03d}", "test_id": test, "order_date": date.fromisoformat(day), "status": status}

    def payment(n, order_id, amount, status, receipt=None, method="CASH"):
        return {"payment_id": n, "order_id": order_id, "amount_paid": money(amount), "payment_method": method,
                "payment_date": datetime(2024, 2, n, 10, 0, 0), "receipt_number": receipt, "status": status}

    return Clinic(
        clinic_patients=make(
            "clinic_patients",
            patient(1, "Ada", "Zimmer", 20, "F", "North Port, Oslo", "0901"),
            patient(2, "Bo", "Young", 30, "M", "South Port, Rome", "0902"),
            patient(3, "Cy", "Young", 31, "M", None, None),
            patient(5, "Di", "Abel", 19, "F", "Hill, OSLO", "0905"),
            patient(6, "Ed", "Moss", 64, "M", "Bay, Lima", "0906"),
        ),
        lab_test_catalog=make(
            "lab_test_catalog",
            {"test_id": 1, "test_name": "CBC", "price": money("200.00"), "description": "Blood"},
            {"test_id": 2, "test_name": "URINALYSIS", "price": money("100.00"), "description": None},
            {"test_id": 3, "test_name": "FECALYSIS", "price": money("120.50"), "description": None},
            {"test_id": 4, "test_name": "LIPIDS", "price": money("300.00"), "description": None},
        ),
        lab_test=make(
            "lab_test",
            order(1, 1, 1, "2023-12-31", "COMPLETED"), order(2, 1, 2, "2024-01-01", "COMPLETED"),
            order(3, 2, 1, "2024-03-05", "PENDING"), order(4, 2, 4, "2024-12-31", "CANCELLED"),
            order(5, 3, 1, "2025-01-01", "COMPLETED"), order(6, 3, 3, "2024-06-01", "PENDING"),
            order(7, 5, 3, "2024-06-02", "COMPLETED"), order(8, 5, 3, "2024-06-03", "PENDING"),
        ),
        cbc=make(
            "cbc",
            {"cbc_id": 1, "order_id": 1, "hemoglobin": money("12.50"), "wbc": money("5.005"), "platelets": 250},
            {"cbc_id": 2, "order_id": 3, "hemoglobin": money("13.00"), "wbc": money("6.00"), "platelets": 251},
            {"cbc_id": 3, "order_id": 7, "hemoglobin": None, "wbc": money("7.00"), "platelets": 255},
        ),
        urinalysis=make("urinalysis", {"ua_id": 1, "order_id": 2, "protein": None}, {"ua_id": 2, "order_id": 3, "protein": "1+"}),
        fecalysis=make(
            "fecalysis", {"fa_id": 1, "order_id": 6, "parasite_id": "None"}, {"fa_id": 2, "order_id": 7, "parasite_id": "Giardia spp."},
            {"fa_id": 3, "order_id": 8, "parasite_id": None},
        ),
        payments=make(
            "payments",
            payment(1, 1, "150.00", "PAID", "R-1"), payment(2, 1, "30.00", "PARTIAL", "R-2", "CARD"), payment(3, 1, "70.00", "REFUNDED"),
            payment(4, 2, "100.00", "REFUNDED", "R-4"), payment(5, 3, "200.00", "PAID", "R-5"), payment(6, 6, "150.00", "PAID"),
        ),
        app_users=make(
            "app_users",
            *[{"user_id": n, "username": u, "password_hash": "x", "role_name": r, "patient_id": p, "mysql_username": f"db_{u}", "is_active": a}
              for n, u, r, p, a in (
                  (1, "root", "role_admin", None, True), (2, "desk", "role_front_desk", None, True), (3, "lab", "role_lab_tech", None, True),
                  (4, "doc", "role_doctor", None, True), (5, "ada", "role_patient", "PAT-001", True), (6, "old", "role_lab_tech", None, False))],
        ),
    )
