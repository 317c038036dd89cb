"""Reference SQL (DuckDB dialect) for the registered queries.

Every text starts from the same common table expressions, which derive the clinic
tables and the incoming batches from the star-schema tables.
"""

from __future__ import annotations

import re

START = "timestamp '2020-01-01 00:00:00'"

TABLES = {
    "clinic_patients": f"""
        select printf('PAT-%03d', c_custkey + 1) as patient_id,
               split_part(c_name, '#', 1) as first_name, split_part(c_name, '#', 2) as last_name,
               cast(18 + c_custkey % 63 as int) as age,
               case when c_custkey % 2 = 0 then 'F' else 'M' end as sex,
               case when c_custkey % 17 <> 0 then c_mktsegment || ' District, ' || n_name || ', ' || r_name end as address,
               case when c_custkey % 29 <> 0 then printf('09%09d', c_custkey) end as contact,
               {START} as registered_at, {START} as created_at, {START} as updated_at
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "lab_test_catalog": f"""
        select p_partkey + 1 as test_id,
               case p_partkey when 0 then 'CBC' when 1 then 'URINALYSIS' when 2 then 'FECALYSIS'
                    else upper(p_name) || ' ' || p_partkey end as test_name,
               cast(p_retailprice as decimal(10,2)) as price, p_type as description,
               {START} as created_at, {START} as updated_at
        from part""",
    "lab_test": """
        select o_orderkey + 1 as order_id,
               printf('PAT-%03d', (case when o_custkey % 10 = 3 then o_custkey - 1 else o_custkey end) + 1) as patient_id,
               case when o_orderkey % 4 < 3 then o_orderkey % 4 + 1 else 4 + o_orderkey % 190 end as test_id,
               cast(o_orderdate as date) as order_date,
               case o_orderstatus when 'F' then 'COMPLETED' when 'P' then 'PENDING' else 'CANCELLED' end as status,
               o_orderdate as created_at, o_orderdate as updated_at
        from orders""",
    "cbc": """
        select l_orderkey + 1 as cbc_id, l_orderkey + 1 as order_id,
               cast(4 + max(l_quantity) / 10 as decimal(5,2)) as wbc, cast(3 + max(l_quantity) / 20 as decimal(5,2)) as rbc,
               cast(8 + min(l_quantity) / 5 as decimal(5,2)) as hemoglobin,
               cast(3 * (8 + min(l_quantity) / 5) as decimal(5,2)) as hematocrit,
               cast(150 + sum(l_quantity) as int) as platelets, cast(87 as int) as mcv, cast(29 as int) as mch,
               cast(55 as decimal(5,2)) as neutrophils, cast(35 as decimal(5,2)) as lymphocytes,
               cast(5 as decimal(5,2)) as monocytes, cast(4 as decimal(5,2)) as eosinophils, cast(1 as decimal(5,2)) as basophils,
               max(l_shipdate) as created_at, max(l_shipdate) as updated_at
        from lineitem where l_returnflag = 'A' group by l_orderkey""",
    "urinalysis": """
        select l_orderkey + 1 as ua_id, l_orderkey + 1 as order_id, 'Clear' as appearance, 'Yellow' as color,
               cast(5 + max(l_quantity) / 25 as decimal(3,1)) as ph, cast(1.010 as decimal(4,3)) as specific_gravity,
               'Negative' as glucose,
               case min(l_linenumber) when 1 then 'Negative' when 2 then 'Trace' when 3 then '1+' when 4 then '2+' end as protein,
               'Negative' as ketones, 'Negative' as nitrites,
               case when max(l_linenumber) > 5 then 'RBCs Present' else 'None' end as other_findings,
               max(l_shipdate) as created_at, max(l_shipdate) as updated_at
        from lineitem where l_returnflag = 'N' group by l_orderkey""",
    "fecalysis": """
        select l_orderkey + 1 as fa_id, l_orderkey + 1 as order_id, 'Brown' as appearance,
               case when max(l_linenumber) > 4 then 'Soft' else 'Formed' end as consistency, 'Negative' as occult_blood,
               case min(l_linenumber) when 1 then 'None' when 2 then 'Giardia spp.' when 3 then 'Ascaris spp.'
                    when 4 then 'Hookworm spp.' end as parasite_id,
               '1/hpf' as wbc, '1/hpf' as rbc, 'Few' as bacteria, 'None' as other_findings,
               max(l_shipdate) as created_at, max(l_shipdate) as updated_at
        from lineitem where l_returnflag = 'R' group by l_orderkey""",
    "payments": """
        select l_orderkey * 8 + l_linenumber as payment_id, l_orderkey + 1 as order_id,
               cast(max(l_quantity) * 10 as decimal(10,2)) as amount_paid,
               case l_linenumber % 4 when 0 then 'CASH' when 1 then 'CARD' when 2 then 'GCASH' else 'INSURANCE' end as payment_method,
               max(l_shipdate) as payment_date,
               case when l_linenumber <> 7 then 'RCPT-' || (l_orderkey * 8 + l_linenumber) end as receipt_number,
               case max(l_returnflag) when 'A' then 'PAID' when 'N' then 'PARTIAL' else 'REFUNDED' end as status,
               max(l_shipdate) as created_at, max(l_shipdate) as updated_at
        from lineitem group by l_orderkey, l_linenumber""",
    "app_users": f"""
        select s_suppkey + 1 as user_id, 'user' || s_suppkey as username, sha256('user' || s_suppkey) as password_hash,
               case s_suppkey % 5 when 0 then 'role_admin' when 1 then 'role_front_desk' when 2 then 'role_lab_tech'
                    when 3 then 'role_doctor' else 'role_patient' end as role_name,
               case when s_suppkey % 5 = 4 then printf('PAT-%03d', s_suppkey + 1) end as patient_id,
               'clinic_user' || s_suppkey as mysql_username, s_suppkey % 7 <> 0 as is_active,
               {START} as created_at, {START} as updated_at
        from supplier""",
    # Incoming batches.
    "in_patients": """
        select printf('PAT-%03d', c_custkey + 1) as patient_id, nullif(c_mktsegment, 'BUILDING') as first_name, c_name as last_name,
               cast(floor(c_acctbal / 100) as int) as age,
               case when c_nationkey < 10 then 'M' when c_nationkey < 20 then 'F' else c_mktsegment end as sex,
               printf('0917%07d', c_nationkey) as contact
        from customer""",
    "in_orders": """
        select o_orderkey + 1 as order_id, printf('PAT-%03d', cast(floor(o_totalprice / 300) as bigint) + 1) as patient_id,
               o_custkey + 601 as test_id,
               case o_orderpriority when '1-URGENT' then 'PENDING' when '2-HIGH' then 'COMPLETED' when '3-MEDIUM' then 'CANCELLED'
                    else o_orderpriority end as status
        from orders""",
    "in_payments": """
        select l_orderkey * 8 + l_linenumber as payment_id, l_orderkey + l_suppkey * 10 + 1 as order_id,
               cast(l_discount as decimal(10,2)) as amount_paid, l_tax,
               cast(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2)) as decimal(18,4)) as typed,
               case l_linenumber when 1 then 'CASH' when 2 then 'CARD' when 3 then 'GCASH' when 4 then 'INSURANCE'
                    when 5 then 'CHEQUE' else 'CASH' end as payment_method,
               case l_returnflag when 'A' then 'PAID' when 'N' then 'PARTIAL' else l_returnflag end as status
        from lineitem""",
    "in_users": """
        select s_suppkey + 1 as user_id, case when s_nationkey < 12 then s_name else 'user' || s_suppkey end as username,
               case s_nationkey % 6 when 0 then 'role_admin' when 1 then 'role_front_desk' when 2 then 'role_lab_tech'
                    when 3 then 'role_doctor' when 4 then 'role_patient' else 'role_guest' end as role_name,
               case when s_acctbal > 5000 then printf('PAT-%03d', s_suppkey + 1) end as patient_id,
               'clinic_user' || s_suppkey as mysql_username
        from supplier""",
    "in_requests": """
        select event_id, printf('PAT-%03d', user_id + 1) as patient_id,
               case event_type when 'view' then 'CBC' when 'click' then 'URINALYSIS' when 'purchase' then 'FECALYSIS'
                    when 'error' then 'CBC' else 'X-RAY' end as test_name,
               cast(ts as date) as order_date
        from events""",
    "in_access": """
        select event_id, 'user' || user_id as username,
               case event_type when 'view' then 'v_frontdesk_dashboard' when 'signup' then 'clinic_patients'
                    when 'click' then 'v_labtech_workspace' when 'error' then 'lab_test' else 'payments' end as object_name,
               case when value < 5 then 'SELECT' when value < 10 then 'INSERT' when value < 15 then 'UPDATE' else 'DELETE' end as privilege
        from events""",
    # Shared steps.
    "people": "select *, first_name || ' ' || last_name as patient_name from clinic_patients",
    "line": """
        select o.*, p.patient_name, p.first_name, p.last_name, p.age, p.sex, t.test_name, t.price
        from lab_test o join people p using (patient_id) join lab_test_catalog t using (test_id)""",
    "reading": """
        select line.*, c.hemoglobin, c.wbc, u.protein, f.parasite_id
        from line left join cbc c using (order_id) left join urinalysis u using (order_id) left join fecalysis f using (order_id)""",
    "counted": "select *, case when status <> 'REFUNDED' then amount_paid else 0 end as net from payments",
    "paid_sum": "select order_id, sum(net) as paid from counted group by order_id",
    "bill": """
        select o.patient_id, o.order_id, o.order_date, t.test_name, t.price,
               cast(coalesce(s.paid, 0) as decimal(20,2)) as paid, cast(t.price - coalesce(s.paid, 0) as decimal(20,2)) as balance
        from lab_test o join lab_test_catalog t using (test_id) left join paid_sum s using (order_id)""",
    "held": """
        select * from (values
            ('role_front_desk', 'clinic_patients', 'SELECT'), ('role_front_desk', 'clinic_patients', 'INSERT'),
            ('role_front_desk', 'clinic_patients', 'UPDATE'), ('role_front_desk', 'lab_test', 'SELECT'),
            ('role_front_desk', 'lab_test', 'INSERT'), ('role_front_desk', 'lab_test', 'UPDATE'),
            ('role_front_desk', 'lab_test_catalog', 'SELECT'), ('role_front_desk', 'payments', 'SELECT'),
            ('role_front_desk', 'payments', 'INSERT'), ('role_front_desk', 'v_frontdesk_dashboard', 'SELECT'),
            ('role_lab_tech', 'cbc', 'SELECT'), ('role_lab_tech', 'cbc', 'UPDATE'), ('role_lab_tech', 'urinalysis', 'SELECT'),
            ('role_lab_tech', 'urinalysis', 'UPDATE'), ('role_lab_tech', 'fecalysis', 'SELECT'),
            ('role_lab_tech', 'fecalysis', 'UPDATE'), ('role_lab_tech', 'lab_test', 'SELECT'),
            ('role_lab_tech', 'v_labtech_workspace', 'SELECT'), ('role_doctor', 'v_doctor_clinical_view', 'SELECT'),
            ('role_doctor', 'clinic_patients', 'SELECT'), ('role_patient', 'v_patient_portal', 'SELECT'),
            ('role_admin', '*', 'ALL')) as g(role_name, object_name, privilege)""",
}
NOW = "timestamp '2001-01-01 08:00:00'"


def sql(select: str, recursive: bool = False, **steps: str) -> str:
    """A query with the shared table expressions it needs, then its own steps in order."""
    needed, todo = set(), [select, *steps.values()]
    while todo:
        text = todo.pop()
        for name, body in TABLES.items():
            if name not in needed and name not in steps and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(body)
    parts = [(name, body) for name, body in TABLES.items() if name in needed] + list(steps.items())
    if not parts:
        return select
    return f"with {'recursive ' if recursive else ''}" + ", ".join(f"{name} as ({body})" for name, body in parts) + " " + select
