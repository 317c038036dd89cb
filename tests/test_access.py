"""Grants, the privilege matrix and the access audit."""

from __future__ import annotations

import pytest
from clinic_cases import rows

from clinicframe.operators import access


@pytest.mark.parametrize("user, thing, privilege, decision", [
    ("lab", "v_labtech_workspace", "SELECT", "ALLOWED"), ("lab", "cbc", "UPDATE", "ALLOWED"), ("lab", "payments", "SELECT", "DENIED"),
    ("lab", "clinic_patients", "UPDATE", "DENIED"), ("lab", "lab_test", "UPDATE", "DENIED"), ("lab", "lab_test", "SELECT", "ALLOWED"),
    ("desk", "clinic_patients", "INSERT", "ALLOWED"), ("desk", "v_frontdesk_dashboard", "SELECT", "ALLOWED"), ("desk", "cbc", "SELECT", "DENIED"),
    ("doc", "v_doctor_clinical_view", "SELECT", "ALLOWED"), ("doc", "payments", "INSERT", "DENIED"), ("doc", "clinic_patients", "UPDATE", "DENIED"),
    ("ada", "v_patient_portal", "SELECT", "ALLOWED"), ("ada", "clinic_patients", "SELECT", "DENIED"),
    ("root", "v_admin_audit_log", "SELECT", "ALLOWED"), ("root", "lab_test", "UPDATE", "ALLOWED"),
    ("old", "cbc", "SELECT", "DENIED"), ("nobody", "cbc", "SELECT", "DENIED"),
])
def test_decisions(clinic, spark, user, thing, privilege, decision):
    request = spark.createDataFrame([(user, thing, privilege)], "username string, object_name string, privilege string")
    assert rows(access.access_audit(clinic, request), "decision") == [(decision,)]


def test_revokes_apply_to_roles_and_accounts(clinic):
    held = set(rows(access.account_grants(clinic)))
    assert ("db_lab", "lab_test", "SELECT") in held and ("db_lab", "lab_test", "UPDATE") not in held
    assert ("db_lab", "lab_test_catalog", "SELECT") not in held and ("db_desk", "lab_test_catalog", "SELECT") in held


def test_matrix(clinic):
    matrix = {(r[0], r[1]): r[2] for r in rows(access.privilege_matrix(access.user_grants(clinic), "role_name"))}
    assert matrix["role_front_desk", "clinic_patients"] == "INSERT, SELECT, UPDATE"
    assert matrix["role_admin", "*"] == "ALL" and matrix["role_lab_tech", "lab_test"] == "SELECT"
    assert ("role_patient", "clinic_patients") not in matrix


def test_portal_shows_own_completed_orders(clinic):
    assert rows(access.portal_for_users(clinic), "username", "test_name") == [("ada", "URINALYSIS"), ("ada", "CBC")]


def test_views_by_role(clinic):
    assert "protein" in access.view_for_role(clinic, "role_doctor").columns
    assert "total_amount" not in access.view_for_role(clinic, "role_lab_tech").columns
    sizes = {r.role_name: (r.object_name, r.n_rows) for r in access.role_projection(clinic).collect()}
    assert sizes["role_admin"] == ("v_admin_audit_log", 10) and sizes["role_patient"] == ("v_patient_portal", 4)
    with pytest.raises(ValueError, match="unknown role"):
        access.view_for_role(clinic, "role_guest")
