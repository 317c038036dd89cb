"""The registered queries: how to run each one, and the reference SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicframe.functions.text import patient_number
from clinicframe.model import Clinic
from clinicframe.operators import access, aggregates, billing, caps, changes, encryption, joins, keys, ledger, listings, quality
from clinicframe.operators.encryption import CONTACT, RECEIPT
from clinicframe.plans.oracle import NOW as SQL_NOW
from clinicframe.plans.oracle import sql
from clinicframe.schemas import PRIMARY_KEY, TABLES
from clinicframe.session import stored
from clinicframe.sources import intake as batches
from clinicframe.sources.intake import Intake
from clinicframe.sources.tables import row_count_profile
from clinicframe.sources.testdata import clinic_from_testdata
from clinicframe.sources.years import orders_by_year_bucket

# Invented for the test tables; real keys come from the caller.
TEST_KEY = "passphrase for synthetic tables only"
NOW = datetime(2001, 1, 1, 8, 0, 0)
AS_OF = date(2001, 1, 1)


class Data:
    """The inputs of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.clinic = clinic_from_testdata(spark, sf_dir)
        self.intake = Intake(spark, sf_dir)

    @cached_property
    def sealed(self) -> Clinic:
        """The clinic with encrypted contacts and receipts; missing text stays missing."""
        return self.clinic.with_tables(
            clinic_patients=lambda: encryption.encrypt_column(self.clinic.clinic_patients, CONTACT, TEST_KEY, "keep"),
            payments=lambda: encryption.encrypt_column(self.clinic.payments, RECEIPT, TEST_KEY, "keep"),
        )

    @cached_property
    def imported(self) -> Clinic:
        """The clinic with unchecked orders and payments in place of its own."""
        return self.clinic.with_tables(lab_test=self.intake.orders, payments=self.intake.payments)

    def payments_with(self, **values: str) -> DataFrame:
        condition = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in values.items()])
        return self.clinic.payments.filter(condition)


Run = Callable[[Data], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


def _columns(table: str) -> str:
    return ", ".join(TABLES[table].names)


# Sources

for _name in Clinic.table_names():
    register(f"src_{_name}", lambda d, t=_name: d.clinic.table(t), sql(f"select {_columns(_name)} from {_name}"))

register(
    "orders_by_year_bucket", lambda d: orders_by_year_bucket(d.clinic.lab_test, (1997, 1998, 1999)),
    sql("""select order_id, order_date, cast(year(order_date) as int) as order_year,
        case when order_date < date '1997-01-01' then 'p1996' when order_date < date '1998-01-01' then 'p1997'
             when order_date < date '1999-01-01' then 'p1998' else 'p_future' end as year_bucket from lab_test"""),
)
register(
    "row_count_profile", lambda d: row_count_profile(d.clinic),
    sql(" union all ".join(f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in Clinic.table_names())),
)

# Listings

register(
    "q01", lambda d: listings.patients_by_name(d.clinic),
    sql("select patient_id, first_name, last_name, age, sex, contact from clinic_patients order by last_name, first_name"),
)
register(
    "patient_list", lambda d: listings.patient_list(d.clinic),
    sql("select patient_id, first_name, last_name, age, sex, address, registered_at from clinic_patients order by last_name, first_name"),
)
register(
    "q02", lambda d: listings.patients_aged(d.clinic, 20, 30),
    sql("select patient_id, patient_name as full_name, age, address from people where age >= 20 and age <= 30 order by age, last_name"),
)
register(
    "q03", lambda d: listings.patients_in_places(d.clinic, ("ASIA", "EUROPE", "BUILDING")),
    sql("""select patient_id, first_name, last_name, address, contact from clinic_patients
        where contains(address, 'ASIA') or contains(address, 'EUROPE') or contains(address, 'BUILDING')"""),
)
register(
    "q03_ignoring_case", lambda d: listings.patients_in_places(d.clinic, ("asia", "Europe", "building"), ci=True),
    sql("""select patient_id, first_name, last_name, address, contact from clinic_patients
        where address ilike '%asia%' or address ilike '%europe%' or address ilike '%building%'"""),
)
register(
    "q04", lambda d: listings.catalog_by_price(d.clinic),
    sql("select test_id, test_name, price, description from lab_test_catalog order by price desc"),
)
register(
    "catalog_by_name", lambda d: listings.catalog_by_name(d.clinic),
    sql("select test_id, test_name, price, description from lab_test_catalog order by test_name"),
)
register(
    "q05", lambda d: listings.catalog_from_price(d.clinic, 950),
    sql("select test_id, test_name, price from lab_test_catalog where price >= 950 order by price desc"),
)
register("q06", lambda d: listings.order_statuses(d.clinic), sql("select status from lab_test group by status"))
register(
    "q07", lambda d: listings.orders_of_year(d.clinic, 1997),
    sql("select order_id, patient_id, test_id, order_date, status from lab_test where year(order_date) = 1997"),
)
register(
    "q08", lambda d: listings.low_hemoglobin(d.clinic, "13.0"),
    sql("select cbc_id, order_id, hemoglobin, hematocrit, platelets from cbc where hemoglobin < 13 order by hemoglobin"),
)
register(
    "q09", lambda d: listings.abnormal_protein(d.clinic),
    sql("select ua_id, order_id, ph, protein, other_findings from urinalysis where protein <> 'Negative'"),
)
register(
    "q10", lambda d: listings.parasites_found(d.clinic),
    sql("select fa_id, order_id, appearance, parasite_id, other_findings from fecalysis where parasite_id <> 'None'"),
)
register(
    "lookup_by_key", lambda d: listings.lookup_many(d.clinic.lab_test, d.payments_with(status="REFUNDED"), "order_id"),
    sql(f"select {_columns('lab_test')} from lab_test where order_id in (select order_id from payments where status = 'REFUNDED')"),
)
register(
    "orderable_tests", lambda d: listings.orderable_tests(d.clinic),
    sql("select test_id, test_name from lab_test_catalog where test_name in ('CBC', 'URINALYSIS', 'FECALYSIS')"),
)
register(
    "patient_picker", lambda d: listings.patient_picker(d.clinic),
    sql("select patient_id, patient_name as full_name from people order by last_name, first_name"),
)
register("test_picker", lambda d: listings.test_picker(d.clinic), sql("select test_id, test_name from lab_test_catalog order by test_name"))
_user_columns = ", ".join(listings.USER_COLUMNS)
register("user_list", lambda d: listings.user_list(d.clinic), sql(f"select {_user_columns} from app_users order by username"))
register("active_users", lambda d: listings.active_users(d.clinic), sql(f"select {_user_columns} from app_users where is_active order by username"))
register(
    "top_k_orders", lambda d: listings.latest_orders(d.clinic, 100),
    sql("select order_id, patient_id, order_date, status from lab_test order by order_date desc, order_id limit 100"),
)

# Joins

register(
    "q11", lambda d: joins.patient_orders_by_date(d.clinic),
    sql("select patient_id, patient_name, test_name, price, order_date, status from line order by order_date desc"),
)
register(
    "q12", lambda d: joins.low_hemoglobin_orders(d.clinic, "13.0"),
    sql("""select order_id, patient_name, order_date, wbc, rbc, hemoglobin, platelets
        from cbc join lab_test using (order_id) join people using (patient_id) where hemoglobin < 13"""),
)
register(
    "q13", lambda d: joins.key_results(d.clinic),
    sql("""select patient_id, patient_name, test_name, order_date,
        case test_name when 'CBC' then 'Hgb: ' || hemoglobin || ' g/dL' when 'URINALYSIS' then 'Protein: ' || protein
             when 'FECALYSIS' then 'Parasite: ' || parasite_id else 'N/A' end as key_result from reading"""),
)
for _panel in ("cbc", "urinalysis", "fecalysis"):
    _own = ", ".join(f"r.{c}" for c in TABLES[_panel].names)
    register(
        f"{_panel}_records", lambda d, p=_panel: joins.panel_records(d.clinic, p),
        sql(f"select p.patient_id, p.patient_name as name, o.order_date, {_own} "
            f"from {_panel} r join lab_test o using (order_id) join people p using (patient_id) order by o.order_date"),
    )
    register(
        "panel_report" if _panel == "cbc" else f"panel_report_{_panel}",
        lambda d, p=_panel: joins.panel_report(d.clinic, p, d.payments_with(payment_method="INSURANCE")),
        sql(f"select p.patient_id, p.first_name, p.last_name, p.age, o.order_date, {_own} "
            f"from {_panel} r join lab_test o using (order_id) join people p using (patient_id) "
            "where order_id in (select order_id from payments where payment_method = 'INSURANCE')"),
    )
register(
    "payment_ledger", lambda d: joins.payment_ledger(d.sealed, TEST_KEY),
    sql("""select y.payment_id, y.order_id, y.amount_paid, y.payment_method, y.payment_date, y.status, l.patient_id, l.patient_name,
        l.test_name, y.receipt_number from payments y join line l using (order_id) order by y.payment_date desc, y.payment_id desc"""),
)
register(
    "payment_detail", lambda d: joins.payment_detail(d.sealed, TEST_KEY, d.payments_with(payment_method="CARD")),
    sql("""select y.payment_id, y.order_id, y.amount_paid, y.payment_method, y.status, y.receipt_number, l.patient_id, l.patient_name,
        l.test_name from payments y join line l using (order_id) where y.payment_method = 'CARD'"""),
)
register(
    "order_payments", lambda d: joins.order_payments(d.sealed, TEST_KEY, d.clinic.lab_test.filter("status = 'PENDING'")),
    sql("""select order_id, payment_id, amount_paid, payment_method, payment_date, status, receipt_number from payments
        where order_id in (select order_id from lab_test where status = 'PENDING')"""),
)
register(
    "payment_header", lambda d: joins.payment_header(d.clinic, d.clinic.lab_test.filter("status = 'PENDING'")),
    sql("select order_id, patient_id, test_name, price from line where status = 'PENDING'"),
)
register(
    "order_list", lambda d: joins.order_list(d.clinic),
    sql("select order_id, order_date, status, patient_id, patient_name, test_id, test_name from line order by order_date desc"),
)
register(
    "patient_orders", lambda d: joins.patient_orders(d.clinic, d.clinic.clinic_patients.filter("address is null")),
    sql("""select patient_id, order_id, order_date, test_name, price, status from line
        where patient_id in (select patient_id from clinic_patients where address is null)"""),
)
register(
    "patient_review", lambda d: joins.patient_review(d.clinic, d.clinic.clinic_patients.filter("contact is null")),
    sql("""select r.patient_id, r.patient_name, r.order_id, r.test_name, r.status as order_status, y.amount_paid, y.payment_method,
        y.status as payment_status, r.hemoglobin, r.wbc from reading r left join payments y using (order_id)
        where r.patient_id in (select patient_id from clinic_patients where contact is null)"""),
)
register(
    "completed_by_age_band", lambda d: joins.completed_by_age(d.clinic, 20, 30),
    sql("""select patient_id, patient_name, test_name, order_date, status from line
        where age >= 20 and age <= 30 and status = 'COMPLETED' order by order_date desc"""),
)
register(
    "v_patient_portal", lambda d: joins.patient_portal(d.clinic),
    sql("select patient_id, first_name, last_name, order_date, test_name, status from line where status = 'COMPLETED'"),
)
register(
    "v_frontdesk_dashboard", lambda d: joins.frontdesk_dashboard(d.clinic),
    sql("select patient_id, patient_name as name, test_name, price as total_amount, status, order_date from line"),
)
register(
    "v_labtech_workspace", lambda d: joins.labtech_workspace(d.clinic),
    sql("""select order_id, first_name, last_name, test_name, status, hemoglobin, wbc, protein, parasite_id from reading
        where status <> 'CANCELLED'"""),
)
register(
    "v_doctor_clinical_view", lambda d: joins.doctor_clinical_view(d.clinic),
    sql("select patient_id, patient_name as name, age, sex, test_name, order_date, hemoglobin, protein, parasite_id from reading"),
)
register(
    "v_admin_audit_log", lambda d: joins.admin_audit_log(d.clinic),
    sql("""select l.order_id, l.patient_id, l.patient_name, l.test_name, l.price as total_amount, l.status as order_status, l.order_date,
        y.payment_id, y.amount_paid, y.payment_method, y.payment_date, y.receipt_number, y.status as payment_status,
        l.created_at as order_created_at, l.updated_at as order_updated_at from line l left join payments y using (order_id)"""),
)

# Aggregates and subqueries

register(
    "q14", lambda d: aggregates.revenue_by_test(d.clinic),
    sql("""select test_name, count(order_id) as times_ordered, cast(sum(price) as decimal(20,2)) as total_revenue
        from lab_test join lab_test_catalog using (test_id) group by test_id, test_name order by total_revenue desc"""),
)
# Means are computed on whole numbers, so both engines round the same exact quotient half up.
register(
    "q15", lambda d: aggregates.blood_count_by_sex(d.clinic),
    sql("""select sex, patient_count,
        cast(cast((2 * h * 10000 + n) // (2 * n) as decimal(38,0)) / 1000000 as decimal(9,6)) as avg_hemoglobin,
        cast(cast((2 * p * 10000 + n) // (2 * n) as decimal(38,0)) / 10000 as decimal(14,4)) as avg_platelets,
        cast(cast((2 * w + n) // (2 * n) as decimal(38,0)) / 100 as decimal(9,2)) as avg_wbc from totals""",
        totals="""select sex, count(distinct patient_id) as patient_count, count(*) as n,
        cast(sum(hemoglobin) * 100 as hugeint) as h, cast(sum(platelets) as hugeint) as p, cast(sum(wbc) * 100 as hugeint) as w
        from clinic_patients join lab_test using (patient_id) join cbc using (order_id) group by sex"""),
)
register(
    "q16", lambda d: aggregates.took_one_test_never_other(d.clinic, "CBC", "URINALYSIS"),
    sql("""select patient_id, patient_name from people
        where exists (select 1 from line where line.patient_id = people.patient_id and test_name = 'CBC')
          and not exists (select 1 from line where line.patient_id = people.patient_id and test_name = 'URINALYSIS')"""),
)
_max_price = sql("""select patient_id, patient_name, max(price) as max_test_price from line group by patient_id, patient_name
    order by max_test_price desc""")
register("q17", lambda d: aggregates.highest_price_of_ordering_patients(d.clinic), _max_price)
register("max_price_rewrite", lambda d: aggregates.highest_price_by_patient(d.clinic), _max_price)
register(
    "patient_overview", lambda d: aggregates.patient_overview(d.clinic),
    sql("""select p.patient_id, p.first_name, p.last_name, p.age, p.sex, p.address, p.registered_at, v.tests_taken, v.last_visit,
        coalesce(v.tests_taken, 'No tests') as tests_taken_text, coalesce(strftime(v.last_visit, '%Y-%m-%d'), 'N/A') as last_visit_text
        from clinic_patients p left join visits v using (patient_id)""",
        visits="""select patient_id, string_agg(distinct test_name, ',' order by test_name) as tests_taken, max(order_date) as last_visit
        from lab_test left join lab_test_catalog using (test_id) group by patient_id"""),
)
register("first_order", lambda d: aggregates.first_order(d.clinic), sql("select min(order_id) as first_order_id from lab_test"))

# Billing

register("billing_by_order", lambda d: billing.billing_by_order(d.clinic), sql("select * from bill"))
register(
    "billing_statement", lambda d: billing.billing_statement(d.clinic),
    sql("""select patient_id, order_id, strftime(order_date, '%m/%d/%Y') as date_text, test_name, cast(price as varchar) as price_text,
        cast(paid as varchar) as paid_text, cast(balance as varchar) as balance_text from bill"""),
)
register(
    "billing_by_patient", lambda d: billing.billing_by_patient(d.clinic),
    sql("""select p.patient_id, p.first_name, p.last_name, cast(coalesce(sum(b.price), 0) as decimal(20,2)) as total,
        cast(coalesce(sum(b.paid), 0) as decimal(20,2)) as paid, cast(coalesce(sum(b.balance), 0) as decimal(20,2)) as balance
        from clinic_patients p left join bill b using (patient_id) group by all"""),
)
register(
    "paid_to_date", lambda d: billing.paid_to_date(d.clinic.payments),
    sql("select order_id, cast(paid as decimal(20,2)) as paid from paid_sum"),
)
register(
    "paid_by_others", lambda d: billing.paid_by_others(d.clinic.payments),
    sql("select payment_id, order_id, cast(paid - net as decimal(20,2)) as paid_by_others from counted join paid_sum using (order_id)"),
)

# Changes

_order_columns = _columns("lab_test")
register(
    "insert_if_absent",
    lambda d: changes.insert_if_absent(d.clinic.clinic_patients.select("patient_id", "first_name"), d.intake.demo_patients(), "patient_id", ("first_name",)),
    sql("""select patient_id, first_name from clinic_patients union all select patient_id, min(first_name) from fresh
        where patient_id not in (select patient_id from clinic_patients) group by patient_id""",
        fresh="""select case when s_acctbal < 5000 then 'DEMO-' || (s_suppkey // 2) else printf('PAT-%03d', s_suppkey + 1) end as patient_id,
        s_name as first_name from supplier"""),
)
_resolved = "select r.*, t.test_id from in_requests r join lab_test_catalog t using (test_name) join clinic_patients p using (patient_id)"
register(
    "insert_orders_by_name",
    lambda d: changes.orders_by_test_name(d.clinic, d.intake.order_requests().drop("ts")),
    sql("select event_id, patient_id, order_date, test_id from resolved", resolved=_resolved),
)
_placed = f"""select {_order_columns} from lab_test union all
    select (select max(order_id) from lab_test) + row_number() over (order by event_id), patient_id, test_id, order_date, 'PENDING',
           {SQL_NOW}, {SQL_NOW} from resolved"""
register(
    "place_orders", lambda d: changes.place_orders(d.clinic, d.intake.order_requests(), ("event_id",), now=NOW),
    sql(_placed, resolved=_resolved),
)
register(
    "assign_ids",
    lambda d: keys.assign_ids(
        d.intake.order_requests().select("event_id", "ts"), "order_id", ("ts", "event_id"), keys.high_water_mark(d.clinic.lab_test, "order_id")
    ).select("event_id", "order_id"),
    sql("""select event_id, cast((select max(order_id) from lab_test) + row_number() over (order by ts, event_id) as bigint) as order_id
        from events"""),
)
_gaps = """select n, row_number() over (order by n) as rank from range(1, (select count(*) from clinic_patients)
    + (select count(*) from supplier) + 1) r(n)
    where n not in (select cast(substr(patient_id, 5) as bigint) from clinic_patients where contact is not null)"""


def _with_gaps(d: Data) -> Clinic:
    """The clinic after the patients without contact have left, so their numbers are free."""
    return d.clinic.with_tables(clinic_patients=d.clinic.clinic_patients.filter("contact is not null"))


register(
    "next_patient_ids", lambda d: keys.next_patient_ids(_with_gaps(d).clinic_patients, d.intake.walk_ins().count()),
    sql("select rank, printf('PAT-%03d', n) as patient_id from gaps where rank <= (select count(*) from supplier)", gaps=_gaps),
)
register(
    "register_patients",
    lambda d: changes.register_patients(_with_gaps(d), d.intake.walk_ins(), ("arrival",), TEST_KEY, NOW).clinic_patients.select(
        "patient_id", "first_name", "last_name", "age", "address", "contact", "registered_at", "contact_token_hash",
        encryption.visible(CONTACT, TEST_KEY).alias("visible_contact"),
    ),
    sql(f"""select patient_id, first_name, last_name, age, address, contact, registered_at, null as contact_token_hash,
        null as visible_contact from clinic_patients where contact is not null
        union all select printf('PAT-%03d', n), 'Walk-in', s_name, cast(20 + s_nationkey as int), '', printf('0800%07d', s_suppkey),
        {SQL_NOW}, sha256(printf('0800%07d', s_suppkey)), printf('0800%07d', s_suppkey)
        from (select *, row_number() over (order by s_suppkey) as rank from supplier) join gaps using (rank)""", gaps=_gaps),
)


def _applicants(d: Data) -> DataFrame:
    """The unchecked import as arrivals: negative ages, unknown sexes, few contacts."""
    return d.intake.patients().withColumnRenamed("patient_id", "arrival").withColumn("address", F.lit(""))


register(
    "register_patients_rejected",
    lambda d: changes.register_patients(d.clinic, _applicants(d), ("arrival",), TEST_KEY, NOW).rejected,
    sql("""select patient_id as arrival, reject_reason from (
        select patient_id, case when age < 0 then 'bad age' when sex not in ('M', 'F') then 'bad sex'
        when row_number() over (partition by contact, age >= 0 and sex in ('M', 'F') order by patient_id) > 1 then 'contact repeated in batch'
        end as reject_reason from in_patients) where reject_reason is not null"""),
)
register(
    "order_requests_rejected",
    lambda d: changes.refused_order_requests(d.clinic, d.intake.order_requests()).select("event_id", "reject_reason"),
    sql("""select event_id, case when patient_id not in (select patient_id from clinic_patients) then 'unknown patient' else 'unknown test' end
        as reject_reason from in_requests where patient_id not in (select patient_id from clinic_patients)
        or test_name not in (select test_name from lab_test_catalog)"""),
)


def _posted(d: Data) -> changes.PostedResults:
    return changes.post_results(d.clinic, "cbc", batches.result_sheets(d.clinic), ("sheet",), NOW)


_sheets = {
    "sheets": """select payment_id as sheet, order_id, amount_paid, payment_method, status,
        row_number() over (partition by order_id, status = 'REFUNDED' order by payment_id) as place from payments""",
    "judged": """select s.*, case when c.order_id is not null then 'result exists' when s.status = 'REFUNDED' then 'unreadable number'
        when s.place > 1 then 'repeated in batch' end as reject_reason from sheets s left join cbc c using (order_id)""",
}
register(
    "post_results", lambda d: _posted(d).lab_test,
    sql(f"""select order_id, patient_id, test_id, order_date,
        case when j.sheet is null then o.status else 'COMPLETED' end as status, created_at,
        case when j.sheet is not null and o.status <> 'COMPLETED' then {SQL_NOW} else updated_at end as updated_at
        from lab_test o left join (select order_id, sheet from judged where reject_reason is null) j using (order_id)""", **_sheets),
)
register(
    "post_results_panel",
    lambda d: _posted(d).panel.select("cbc_id", "order_id", "wbc", "rbc", "hemoglobin", "platelets", "mcv", "created_at"),
    sql(f"""select cbc_id, order_id, wbc, rbc, hemoglobin, platelets, mcv, created_at from cbc union all
        select (select max(cbc_id) from cbc) + row_number() over (order by sheet), order_id, cast(amount_paid as decimal(5,2)),
        cast(4.75 as decimal(5,2)), case when payment_method <> 'CASH' then cast(13.40 as decimal(5,2)) end, cast(250 as int), null, {SQL_NOW}
        from judged where reject_reason is null""", **_sheets),
)
register(
    "post_results_rejected", lambda d: _posted(d).rejected,
    sql("select order_id, reject_reason from judged where reject_reason is not null", **_sheets),
)


def _refund_patch(d: Data) -> DataFrame:
    """Orders all of whose payments were refunded are to be cancelled."""
    refunded = d.clinic.payments.groupBy("order_id").agg(F.bool_and(F.col("status") == "REFUNDED").alias("all_refunded"))
    return refunded.filter("all_refunded").select("order_id", F.lit("CANCELLED").alias("status"))


register(
    "patch_rows", lambda d: changes.patch_rows(d.clinic.lab_test, _refund_patch(d), "order_id", ("status",), NOW),
    sql(f"""select order_id, patient_id, test_id, order_date, case when r.order_id is null then status else 'CANCELLED' end as status,
        created_at, case when r.order_id is not null and status <> 'CANCELLED' then {SQL_NOW} else updated_at end as updated_at
        from lab_test left join r using (order_id)""",
        r="select order_id from payments group by order_id having bool_and(status = 'REFUNDED')"),
)
register(
    "edit_results", lambda d: changes.edit_results(d.clinic, "urinalysis", batches.urinalysis_edits(d.clinic), NOW),
    sql(f"""select ua_id, order_id, case when e then 'Turbid' else appearance end as appearance, case when not e then color end as color, ph,
        case when e then cast(1.020 as decimal(4,3)) else specific_gravity end as specific_gravity,
        case when not e then glucose when other_findings <> 'None' then 'Trace' end as glucose, protein,
        case when not e then ketones end as ketones, nitrites, other_findings, u.created_at,
        case when e then {SQL_NOW} else u.updated_at end as updated_at from edited u""",
        edited="select u.*, o.status = 'COMPLETED' as e from urinalysis u join lab_test o using (order_id)"),
)
def _patient_edits(d: Data) -> DataFrame:
    """Patients without an address give one, and drop the blanks around their name."""
    return d.clinic.clinic_patients.filter("address is null").select(
        "patient_id", F.concat(F.lit(" "), "first_name").alias("first_name"), "last_name", (F.col("age") + 1).alias("age"), "sex",
        F.concat(F.lit("Found, "), "last_name").alias("address"), F.concat("contact", F.lit("-2")).alias("contact"),
    )


register(
    "edit_patients",
    lambda d: changes.edit_patients(d.sealed, _patient_edits(d), TEST_KEY, NOW).select(
        "patient_id", "first_name", "age", "address", "contact", "updated_at", "contact_token_hash",
        encryption.visible(CONTACT, TEST_KEY).alias("visible_contact"),
    ),
    sql(f"""select patient_id, first_name, cast(case when e then age + 1 else age end as int) as age,
        case when e then 'Found, ' || last_name else address end as address, fresh as contact,
        case when e then {SQL_NOW} else updated_at end as updated_at, sha256(fresh) as contact_token_hash, fresh as visible_contact from edited""",
        edited="""select *, address is null as e, case when address is null then coalesce(contact || '-2', '') else contact end as fresh
        from clinic_patients"""),
)
register(
    "edit_tests",
    lambda d: changes.edit_tests(
        d.clinic,
        d.clinic.lab_test_catalog.join(d.clinic.lab_test, "test_id", "left_anti").select(
            "test_id", F.concat("test_name", F.lit(" (retired)")).alias("test_name"), (F.col("price") - 1).alias("price"),
            F.lit(None).cast("string").alias("description"),
        ), NOW,
    ),
    sql(f"""select test_id, case when e then test_name || ' (retired)' else test_name end as test_name,
        cast(case when e then price - 1 else price end as decimal(10,2)) as price, case when not e then description end as description,
        created_at, case when e then {SQL_NOW} else updated_at end as updated_at from edited""",
        edited="select *, test_id not in (select test_id from lab_test) as e from lab_test_catalog"),
)


def _added(d: Data) -> changes.AddedUsers:
    """Ask for the imported accounts where only administrators have one."""
    admins = d.clinic.with_tables(app_users=d.clinic.app_users.filter("role_name = 'role_admin'"))
    return changes.add_users(admins, d.intake.users().withColumns({"password_hash": F.lit("-"), "entry": F.col("user_id")}).drop("user_id"), ("entry",), now=NOW)


_asked = {
    "admins": "select * from app_users where role_name = 'role_admin'",
    "checked": """select u.*, case when not regexp_full_match(username, '[A-Za-z0-9_.-]{1,80}') then 'bad username'
        when role_name = 'role_guest' then 'bad role_name' when role_name = 'role_patient' and u.patient_id is null then 'bad patient_id'
        when u.patient_id is not null and p.patient_id is null then 'unknown patient'
        when username in (select username from admins) then 'name has an account'
        when u.patient_id in (select patient_id from admins where patient_id is not null) then 'patient has an account' end as reject_reason
        from in_users u left join clinic_patients p using (patient_id)""",
}
register(
    "add_users", lambda d: _added(d).app_users.select("user_id", "username", "role_name", "patient_id", "mysql_username", "is_active", "created_at"),
    sql(f"""select user_id, username, role_name, patient_id, mysql_username, is_active, created_at from admins union all
        select (select max(user_id) from admins) + row_number() over (order by user_id), username, role_name, patient_id, mysql_username, true,
        {SQL_NOW} from checked where reject_reason is null""", **_asked),
)
register(
    "add_users_rejected", lambda d: _added(d).rejected,
    sql("select user_id as entry, username, reject_reason from checked where reject_reason is not null", **_asked),
)


def _renumbered(d: Data) -> DataFrame:
    """Orders and payments after every order that may has taken a negative number."""
    numbers = d.clinic.lab_test.select("order_id", (-F.col("order_id")).alias("new_order_id"))
    after = changes.renumber_orders(d.clinic, numbers)
    orders = after.lab_test.select(F.lit("lab_test").alias("table_name"), "order_id", F.col("patient_id").alias("other_key"))
    return orders.unionByName(after.payments.select(F.lit("payments").alias("table_name"), "order_id", F.col("payment_id").cast("string").alias("other_key")))


register(
    "renumber_orders",
    _renumbered,
    sql("""select 'lab_test' as table_name, case when free then -order_id else order_id end as order_id, patient_id as other_key from marked
        union all select 'payments', case when free then -order_id else order_id end, cast(payment_id as varchar)
        from payments join marked using (order_id)""",
        marked="""select order_id, patient_id, order_id not in (select order_id from cbc) and order_id not in (select order_id from urinalysis)
        and order_id not in (select order_id from fecalysis) as free from lab_test"""),
)
register(
    "set_user_status",
    lambda d: listings.user_list(d.clinic.with_tables(app_users=changes.set_user_status(d.clinic, d.intake.account_changes(), NOW))),
    sql("""select user_id, username, role_name, patient_id, mysql_username, s_acctbal > 0 as is_active
        from app_users join supplier on user_id = s_suppkey + 1"""),
)


def _role_changes(d: Data) -> DataFrame:
    """Accounts with a negative balance."""
    return d.intake.account_changes().filter("not is_active").select("mysql_username")


register(
    "grant_roles",
    lambda d: changes.grant_roles(d.clinic, _role_changes(d).withColumn("role_name", F.lit("role_doctor")), NOW).select(
        "user_id", "role_name", "is_active", "updated_at"
    ),
    sql(f"""select user_id, case when s_acctbal <= 0 then 'role_doctor' else role_name end as role_name, is_active,
        case when s_acctbal <= 0 and role_name <> 'role_doctor' then {SQL_NOW} else updated_at end as updated_at
        from app_users join supplier on user_id = s_suppkey + 1"""),
)
register(
    "revoke_roles",
    lambda d: changes.revoke_roles(
        d.clinic, d.intake.account_changes().select("mysql_username", F.lit("role_lab_tech").alias("role_name")), NOW
    ).select("user_id", "role_name", "is_active", "updated_at"),
    sql(f"""select user_id, role_name, is_active and role_name <> 'role_lab_tech' as is_active,
        case when is_active and role_name = 'role_lab_tech' then {SQL_NOW} else updated_at end as updated_at from app_users"""),
)
register(
    "q18",
    lambda d: changes.change_contact(d.sealed, "PAT-001", "09990001111", "Moved, NATION_0", TEST_KEY, NOW).select(
        "patient_id", "address", "contact", "updated_at", "contact_token_hash", encryption.visible(CONTACT, TEST_KEY).alias("visible_contact")
    ),
    sql(f"""select patient_id, case when me then 'Moved, NATION_0' else address end as address, new_contact as contact,
        case when me then {SQL_NOW} else updated_at end as updated_at, sha256(new_contact) as contact_token_hash,
        new_contact as visible_contact from moved""",
        moved="""select *, patient_id = 'PAT-001' as me, case when patient_id = 'PAT-001' then '09990001111' else contact end as new_contact
        from clinic_patients"""),
)
register(
    "q19", lambda d: changes.complete_old_orders(d.clinic, AS_OF, 7, NOW),
    sql(f"""select order_id, patient_id, test_id, order_date, case when due then 'COMPLETED' else status end as status, created_at,
        case when due then {SQL_NOW} else updated_at end as updated_at
        from (select *, status = 'PENDING' and order_date <= date '2000-12-25' as due from lab_test)"""),
)
register("q20", lambda d: changes.delete_cancelled(d.clinic), sql(f"select {_order_columns} from lab_test where status <> 'CANCELLED'"))
register(
    "q21", lambda d: changes.delete_patient_test(d.clinic, "PAT-433", "FECALYSIS"),
    sql(f"select {_order_columns} from line where not (patient_id = 'PAT-433' and test_name = 'FECALYSIS')"),
)


def _sizes(clinic: Clinic) -> DataFrame:
    """Rows left in each table with the sum of their keys, and for accounts those still tied to a patient."""
    found = []
    for name, df in clinic.tables().items():
        key = patient_number("patient_id") if name == "clinic_patients" else F.col(PRIMARY_KEY[name])
        rows = df.filter("patient_id is not null") if name == "app_users" else df
        found.append(rows.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.sum(key).cast("decimal(38,0)").alias("key_sum")
        ))
    return reduce(DataFrame.unionByName, found)


def _sizes_sql(gone_orders: str, gone_patients: str = "select '' as patient_id where false", gone_tests: str = "select 0 as test_id where false") -> str:
    parts = []
    for name in Clinic.table_names():
        key = "cast(substr(patient_id, 5) as bigint)" if name == "clinic_patients" else PRIMARY_KEY[name]
        test = {
            "clinic_patients": "patient_id not in (from gone_patients)", "lab_test_catalog": "test_id not in (from gone_tests)",
            "app_users": "patient_id is not null and patient_id not in (from gone_patients)",
        }.get(name, "order_id not in (from gone_orders)")
        parts.append(f"select '{name}' as table_name, count(*) as n_rows, cast(sum({key}) as decimal(38,0)) as key_sum from {name} where {test}")
    return sql(" union all ".join(parts), gone_patients=gone_patients, gone_tests=gone_tests, gone_orders=gone_orders)


register(
    "cascade_delete_orders", lambda d: _sizes(changes.cascade_delete_orders(d.clinic, d.clinic.lab_test.filter("status = 'CANCELLED'"))),
    _sizes_sql("select order_id from lab_test where status = 'CANCELLED'"),
)
register(
    "cascade_delete_patients",
    lambda d: _sizes(changes.cascade_delete_patients(d.clinic, d.clinic.clinic_patients.filter("address is null"))),
    _sizes_sql("select order_id from lab_test where patient_id in (from gone_patients)", "select patient_id from clinic_patients where address is null"),
)
register(
    "cascade_delete_tests",
    lambda d: _sizes(changes.cascade_delete_tests(d.clinic, d.clinic.lab_test_catalog.filter("description = 'SMALL'"))),
    _sizes_sql("select order_id from lab_test where test_id in (from gone_tests)",
               gone_tests="select test_id from lab_test_catalog where description = 'SMALL'"),
)
register(
    "delete_payments", lambda d: changes.delete_payments(d.clinic, d.payments_with(status="REFUNDED")),
    sql(f"select {_columns('payments')} from payments where status <> 'REFUNDED'"),
)
register(
    "rename_patients",
    lambda d: changes.rename_patients(
        d.clinic, d.clinic.clinic_patients.filter("age > 60").select("patient_id", F.concat(F.lit("OLD-"), "last_name").alias("new_patient_id"))
    ).clinic_patients.select("patient_id", "last_name", "age"),
    sql("""select case when age > 60 and not exists (select 1 from lab_test o where o.patient_id = p.patient_id)
        then 'OLD-' || last_name else patient_id end as patient_id, last_name, age from clinic_patients p"""),
)

# Payments under the cap

_walk = {
    "ranked": """select i.*, row_number() over (partition by order_id order by payment_date, payment_id) as rn,
        b.price - coalesce(k.paid, 0) as room from incoming i join bill b using (order_id) left join known k using (order_id)""",
    "walk": """select order_id, payment_id, rn, (net = 0 or net <= room) as accepted,
        case when net <= room then room - net else room end as room_left from ranked where rn = 1
        union all select r.order_id, r.payment_id, r.rn, (r.net = 0 or r.net <= w.room_left),
        case when r.net <= w.room_left then w.room_left - r.net else w.room_left end
        from walk w join ranked r on r.order_id = w.order_id and r.rn = w.rn + 1""",
}
_verdict = "select payment_id, order_id, accepted, case when not accepted then 'exceeds balance' end as reject_reason from walk"


def _accepted(d: Data, recorded: DataFrame, incoming: DataFrame) -> DataFrame:
    judged = caps.accept_payments(d.clinic.with_tables(payments=recorded), incoming)
    return judged.select("payment_id", "order_id", "accepted", "reject_reason")


register(
    "accept_payments", lambda d: _accepted(d, d.clinic.payments.filter(F.lit(False)), d.clinic.payments),
    sql(_verdict, True, incoming="select * from counted", known="select 0 as order_id, 0 as paid where false", **_walk),
)
register(
    "accept_payments_on_ledger",
    lambda d: _accepted(d, d.payments_with(payment_method="INSURANCE"), d.clinic.payments.filter("payment_method <> 'INSURANCE'")),
    sql(_verdict, True, incoming="select * from counted where payment_method <> 'INSURANCE'",
        known="select order_id, sum(net) as paid from counted where payment_method = 'INSURANCE' group by order_id", **_walk),
)


def _hot_orders(d: Data) -> DataFrame:
    """Judge every payment as one of ten orders, which cost 300 times as much and have nothing paid yet."""
    dear = d.clinic.lab_test_catalog.withColumn("price", (F.col("price") * 300).cast("decimal(10,2)"))
    few = d.clinic.payments.withColumn("order_id", F.col("payment_id") % 10 + 1)
    empty = d.clinic.with_tables(lab_test_catalog=dear, payments=d.clinic.payments.filter(F.lit(False)))
    return caps.accept_payments(empty, few).select("payment_id", "order_id", "accepted", "reject_reason")


register(
    "accept_payments_hot", _hot_orders,
    sql(_verdict, True, ranked="""select c.payment_id, payment_id % 10 + 1 as order_id, net, t.price * 300 as room,
        row_number() over (partition by payment_id % 10 order by payment_date, payment_id) as rn
        from counted c join lab_test o on o.order_id = payment_id % 10 + 1 join lab_test_catalog t using (test_id)""", walk=_walk["walk"]),
)
_edit_walk = {
    "edits": """select payment_id, order_id, net as own, payment_method = 'GCASH' as refund,
        case payment_method when 'GCASH' then 0 when 'CASH' then amount_paid * 2 when 'CARD' then cast(amount_paid / 2 as decimal(10,2))
             else amount_paid end as new from counted""",
    "ranked": """select e.*, b.price, b.paid, row_number() over (partition by order_id
        order by case when refund then 0 when new <= own then 1 else 2 end, payment_id) as rn from edits e join bill b using (order_id)""",
    "walk": """select order_id, payment_id, rn, (refund or paid - own + new <= price) as accepted,
        case when refund or paid - own + new <= price then paid - own + new else paid end as total from ranked where rn = 1
        union all select r.order_id, r.payment_id, r.rn, (r.refund or w.total - r.own + r.new <= r.price),
        case when r.refund or w.total - r.own + r.new <= r.price then w.total - r.own + r.new else w.total end
        from walk w join ranked r on r.order_id = w.order_id and r.rn = w.rn + 1""",
}
register(
    "edit_payments", lambda d: caps.edit_payments(d.clinic, batches.payment_edits(d.clinic)).select("payment_id", "order_id", "accepted", "reject_reason"),
    sql("select payment_id, order_id, accepted, case when not accepted then 'exceeds balance' end as reject_reason from walk", True, **_edit_walk),
)


def _recorded(d: Data) -> ledger.RecordedPayments:
    """Enter every payment anew on a ledger that holds the partial ones.

    The payments are derived by a grouping and needed many times, so they are stored first, as a ledger would be.
    """
    paid = stored(d.clinic.payments)
    partial = encryption.encrypt_column(paid.filter(F.col("status") == "PARTIAL"), RECEIPT, TEST_KEY, "empty")
    entries = batches.payment_entries(d.clinic.with_tables(payments=paid))
    return ledger.record_payments(d.clinic.with_tables(payments=partial), entries, ("entry",), TEST_KEY, now=NOW)


_entered = {
    "incoming": """select payment_id as entry, payment_id, order_id, payment_method, status, payment_date,
        round_even(amount_paid * 1.125, 2)::decimal(10,2) as amount_paid,
        case when status = 'REFUNDED' then 0 else round_even(amount_paid * 1.125, 2)::decimal(10,2) end as net,
        case payment_method when 'CARD' then null when 'GCASH' then receipt_number when 'INSURANCE' then 'N-' || order_id
             else 'E-' || payment_id end as receipt from payments""",
    "known": "select order_id, sum(net) as paid from counted where status = 'PARTIAL' group by order_id",
    # Only insurance receipts repeat, and only within an order.
    "screened": """select i.*, case when receipt in (select receipt_number from payments where status = 'PARTIAL' and receipt_number is not null)
        then 'receipt exists' end as refused from incoming i""",
    "ranked": """select s.*, row_number() over (partition by order_id order by entry) as rn, b.price - coalesce(k.paid, 0) as room,
        payment_method = 'INSURANCE' as shared from screened s join bill b using (order_id) left join known k using (order_id)
        where refused is null""",
    "walk": """select order_id, payment_id, rn, (net = 0 or net <= room) as accepted, false as repeated,
        case when net <= room then room - net else room end as room_left, shared and (net = 0 or net <= room) as used from ranked where rn = 1
        union all select r.order_id, r.payment_id, r.rn, not (r.shared and w.used) and (r.net = 0 or r.net <= w.room_left), r.shared and w.used,
        case when not (r.shared and w.used) and r.net <= w.room_left then w.room_left - r.net else w.room_left end,
        w.used or (r.shared and (r.net = 0 or r.net <= w.room_left))
        from walk w join ranked r on r.order_id = w.order_id and r.rn = w.rn + 1""",
}
register(
    "record_payments",
    lambda d: _recorded(d).payments.select(
        "payment_id", "order_id", "amount_paid", "payment_method", "status", "payment_date", "receipt_number", RECEIPT.token,
        encryption.visible(RECEIPT, TEST_KEY).alias("visible_receipt"),
    ),
    sql(f"""select payment_id, order_id, amount_paid, payment_method, status, payment_date, receipt_number,
        sha256(coalesce(receipt_number, '')) as receipt_token_hash, coalesce(receipt_number, '') as visible_receipt
        from payments where status = 'PARTIAL' union all
        select (select max(payment_id) from payments where status = 'PARTIAL') + row_number() over (order by i.entry), i.order_id, i.amount_paid,
        i.payment_method, i.status, {SQL_NOW}, i.receipt, sha256(coalesce(i.receipt, '')), coalesce(i.receipt, '')
        from walk w join incoming i using (payment_id) where w.accepted""", True, **_entered),
)
register(
    "record_payments_rejected", lambda d: _recorded(d).rejected.select("entry", "order_id", "reject_reason"),
    sql("""select entry, order_id, refused as reject_reason from screened where refused is not null
        union all select payment_id, order_id, case when repeated then 'receipt repeated' else 'exceeds balance' end
        from walk where not accepted""", True, **_entered),
)
register(
    "apply_payment_edits",
    lambda d: ledger.apply_payment_edits(
        d.sealed, batches.payment_edits(d.clinic).withColumn("receipt_number", F.lit(" ")), ("payment_id",), TEST_KEY, NOW
    ).select("payment_id", "amount_paid", "status", "receipt_number", RECEIPT.token, encryption.visible(RECEIPT, TEST_KEY).alias("visible_receipt")),
    sql("""select payment_id, case when not w.accepted then p.amount_paid when p.payment_method = 'CASH' then p.amount_paid * 2
        when p.payment_method = 'CARD' then cast(p.amount_paid / 2 as decimal(10,2)) else p.amount_paid end::decimal(10,2) as amount_paid,
        case when not w.accepted then p.status when p.payment_method = 'GCASH' then 'REFUNDED' else 'PAID' end as status,
        case when not w.accepted then receipt_number end as receipt_number,
        case when not w.accepted then sha256(receipt_number) end as receipt_token_hash,
        case when not w.accepted then receipt_number end as visible_receipt
        from payments p join walk w using (payment_id)""", True, **_edit_walk),
)

# Encryption

register(
    "encrypt_contacts",
    lambda d: encryption.encrypt_column(d.clinic.clinic_patients, CONTACT, TEST_KEY, "empty").select(
        "patient_id", F.length("contact_encrypted").alias("cipher_bytes"), F.length("encryption_iv").alias("iv_bytes"),
        "contact_token_hash", encryption.visible(CONTACT, TEST_KEY).alias("visible_contact"),
    ),
    sql("""select patient_id, cast(16 as int) as cipher_bytes, cast(16 as int) as iv_bytes, sha256(coalesce(contact, '')) as contact_token_hash,
        coalesce(contact, '') as visible_contact from clinic_patients"""),
)
register(
    "contact_tokens", lambda d: encryption.tokens(d.clinic.clinic_patients, CONTACT, "patient_id"),
    sql("select patient_id, sha256(contact) as contact_token_hash from clinic_patients"),
)
register(
    "v_patients_decrypted", lambda d: encryption.patients_decrypted(d.sealed, TEST_KEY),
    sql("select patient_id, first_name, last_name, age, sex, contact as visible_contact from clinic_patients"),
)
register(
    "v_payments_decrypted", lambda d: encryption.payments_decrypted(d.sealed, TEST_KEY),
    sql("select payment_id, order_id, amount_paid, payment_method, payment_date, receipt_number as visible_receipt, status from payments"),
)
register(
    "contact_list", lambda d: encryption.contact_list(d.sealed, TEST_KEY),
    sql("select patient_id, first_name, last_name, contact from clinic_patients order by last_name, first_name"),
)
register(
    "receipt_list", lambda d: encryption.receipt_list(d.sealed, TEST_KEY),
    sql("select payment_id, order_id, amount_paid, payment_method, payment_date, status, receipt_number from payments"),
)


def _migrated(d: Data) -> DataFrame:
    """Encrypt the receipts of a ledger whose card payments are encrypted already."""
    own = encryption.encrypt_column(d.clinic.payments, RECEIPT, TEST_KEY, "keep")
    card = F.col("payment_method") == "CARD"
    half = own.withColumns({c: F.when(card, F.col(c)) for c in RECEIPT.stored}).withColumn("before", F.col(RECEIPT.cipher))
    after = encryption.encrypt_missing(half, RECEIPT, TEST_KEY)
    kept = F.coalesce(F.col("before") == F.col(RECEIPT.cipher), F.lit(False))
    return after.select("payment_id", kept.alias("kept"), RECEIPT.token, encryption.visible(RECEIPT, TEST_KEY).alias("visible_receipt"))


register(
    "encrypt_migration", _migrated,
    sql("""select payment_id, payment_method = 'CARD' and receipt_number is not null as kept, sha256(receipt_number) as receipt_token_hash,
        receipt_number as visible_receipt from payments"""),
)
register(
    "missing_cipher_count", lambda d: encryption.missing_cipher_count(d.sealed),
    sql("""select 'clinic_patients' as table_name, count(*) as missing_rows from clinic_patients where contact is null
        union all select 'payments', count(*) from payments where receipt_number is null"""),
)
register(
    "find_by_contact_token",
    lambda d: encryption.patients_decrypted(
        d.sealed.with_tables(
            clinic_patients=encryption.find_many_by_token(d.sealed.clinic_patients, CONTACT, d.intake.search_terms(), "term")
        ), TEST_KEY,
    ),
    sql("""select patient_id, first_name, last_name, age, sex, contact as visible_contact from clinic_patients
        where contact in (select printf('09%09d', user_id) from events)"""),
)
register(
    "iv_uniqueness", lambda d: encryption.iv_proof(d.clinic.clinic_patients, CONTACT, TEST_KEY),
    sql("""select 2 * count(contact) as n_ciphers, 2 * count(contact) as n_distinct_ciphers, 2 * count(contact) as n_distinct_ivs,
        count(distinct contact) as n_distinct_tokens from clinic_patients"""),
)

# Quality


def _row_rule(rule: str) -> Run:
    def run(d: Data) -> DataFrame:
        return reduce(DataFrame.unionByName, [quality.row_violations(t, df, rule) for t, df in _unchecked(d).items() if _has_rules(t, rule)])
    return run


def _unchecked(d: Data) -> dict[str, DataFrame]:
    """All eight tables as an import might bring them: prices too low, blood counts on the wrong orders, long protein readings."""
    return {
        "clinic_patients": d.intake.patients(), "lab_test": d.intake.orders(), "payments": d.intake.payments(), "app_users": d.intake.users(),
        "lab_test_catalog": d.clinic.lab_test_catalog.withColumn("price", F.col("price") - 1000),
        "cbc": d.clinic.cbc.withColumn("order_id", F.floor(F.col("order_id") / 2)),
        "urinalysis": d.clinic.urinalysis.withColumn("protein", F.rpad("protein", 21, ".")),
        "fecalysis": d.clinic.fecalysis,
    }


def _has_rules(table: str, rule: str) -> bool:
    return bool(quality.RULES[rule](table))


def _rule_sql(rule: str, parts: list[tuple[str, str, str, str, str]]) -> str:
    return sql(" union all ".join(
        f"select '{rule}' as rule, '{table}' as table_name, cast({key} as varchar) as row_key, '{column}' as column_name from {source} where {bad}"
        for table, source, key, column, bad in parts
    ))


_P, _O = ("clinic_patients", "in_patients", "patient_id"), ("lab_test", "in_orders", "order_id")
_Y, _U = ("payments", "in_payments", "payment_id"), ("app_users", "in_users", "user_id")
register("dq_not_null", _row_rule("not_null"), _rule_sql("not_null", [(*_P, "first_name", "first_name is null")]))
register(
    "dq_checks", _row_rule("check"),
    _rule_sql("check", [(*_P, "age", "age < 0"), (*_P, "sex", "sex not in ('M', 'F')"), (*_Y, "amount_paid", "amount_paid <= 0"),
                         ("lab_test_catalog", "lab_test_catalog", "test_id", "price", "price <= 1000")]),
)
register(
    "dq_enums", _row_rule("enum"),
    _rule_sql("enum", [
        (*_O, "status", "status not in ('PENDING', 'COMPLETED', 'CANCELLED')"), (*_Y, "payment_method", "payment_method = 'CHEQUE'"),
        (*_Y, "status", "status not in ('PAID', 'PARTIAL', 'REFUNDED')"), (*_U, "role_name", "role_name = 'role_guest'"),
    ]),
)
register("dq_lengths", _row_rule("length"), _rule_sql("length", [(*_P, "sex", "length(sex) > 1"), (*_P, "patient_id", "length(patient_id) > 10"),
                                                                   ("urinalysis", "urinalysis", "ua_id", "protein", "protein is not null")]))


def _unique_sql(parts: list[tuple[str, str, str]]) -> str:
    return sql(" union all ".join(
        f"select 'unique' as rule, '{table}' as table_name, '{column}' as column_name, cast({column} as varchar) as value, count(*) as n_rows "
        f"from {source} where {column} is not null group by {column} having count(*) > 1" for table, source, column in parts
    ))


register(
    "dq_unique",
    lambda d: reduce(DataFrame.unionByName, [quality.duplicate_keys(t, df) for t, df in _unchecked(d).items()]),
    _unique_sql([("clinic_patients", "in_patients", "contact"), ("payments", "in_payments", "payment_id"),
                 ("cbc", "(select order_id // 2 as order_id from cbc)", "order_id")]),
)
register(
    "dq_orphans", lambda d: quality.orphans(d.imported),
    sql("""select 'reference' as rule, 'lab_test' as table_name, cast(order_id as varchar) as row_key, 'patient_id' as column_name,
        patient_id as value from in_orders where patient_id not in (select patient_id from clinic_patients)
        union all select 'reference', 'lab_test', cast(order_id as varchar), 'test_id', cast(test_id as varchar) from in_orders
        where test_id not in (select test_id from lab_test_catalog)
        union all select 'reference', 'payments', cast(payment_id as varchar), 'order_id', cast(order_id as varchar) from in_payments
        where order_id not in (select order_id from in_orders)
        union all select 'reference', 'app_users', cast(user_id as varchar), 'patient_id', patient_id from app_users
        where patient_id not in (select patient_id from clinic_patients)
        union all select 'reference', 'cbc', cast(cbc_id as varchar), 'order_id', cast(order_id as varchar) from cbc
        where order_id not in (select order_id from in_orders)
        union all select 'reference', 'urinalysis', cast(ua_id as varchar), 'order_id', cast(order_id as varchar) from urinalysis
        where order_id not in (select order_id from in_orders)
        union all select 'reference', 'fecalysis', cast(fa_id as varchar), 'order_id', cast(order_id as varchar) from fecalysis
        where order_id not in (select order_id from in_orders)"""),
)
register(
    "dq_overpaid", lambda d: quality.overpaid_orders(d.clinic),
    sql("select order_id, price, paid, cast(paid - price as decimal(20,2)) as excess from bill where paid > price"),
)
register(
    "dq_payment_input",
    lambda d: quality.payment_input(d.intake.payments()).select("payment_id", "amount_text", "payment_method", "status", "amount", "reject_reason"),
    sql("""select payment_id, amount_text, payment_method, status, cast(cast(cents as decimal(20,0)) / 100 as decimal(20,2)) as amount,
        case when cents is null then 'not a number' when cents <= 0 then 'not positive' when cents > 9999999999 then 'too large'
             when payment_method = 'CHEQUE' then 'unknown method' when status not in ('PAID', 'PARTIAL', 'REFUNDED') then 'unknown status'
        end as reject_reason from rounded""",
        entered="""select *, case when l_tax = 0.08 then 'n/a' when l_tax = 0.07 then '  ' || typed || chr(9)
             when l_tax = 0.06 then typed || 'e1' when l_tax = 0.05 then null else cast(typed as varchar) end as amount_text,
        cast(case when l_tax in (0.08, 0.05) then null when l_tax = 0.06 then typed * 100000 else typed * 10000 end as bigint) as v from in_payments""",
        rounded="""select *, v // 100 + case when v % 100 > 50 or (v % 100 = 50 and (v // 100) % 2 = 1) then 1 else 0 end as cents from entered"""),
)
register(
    "dq_panel_mismatch", lambda d: quality.panel_mismatches(d.clinic),
    sql(" union all ".join(
        f"""select 'panel of another test' as rule, '{p}' as panel, order_id, test_name from line where test_name <> '{t}'
        and order_id in (select order_id from {p}) union all
        select 'completed without panel', '{p}', order_id, test_name from line where test_name = '{t}' and status = 'COMPLETED'
        and order_id not in (select order_id from {p})""" for t, p in (("CBC", "cbc"), ("URINALYSIS", "urinalysis"), ("FECALYSIS", "fecalysis"))
    )),
)
register(
    "dq_identifiers", lambda d: quality.identifier_errors(d.intake.users()),
    sql(" union all ".join(f"select 'account' as rule, user_id, '{c}' as column_name from in_users where {bad}" for c, bad in (
        ("username", "not regexp_full_match(username, '[A-Za-z0-9_.-]{1,80}')"),
        ("mysql_username", "not regexp_full_match(mysql_username, '[A-Za-z0-9_.-]{1,80}')"),
        ("role_name", "role_name = 'role_guest'"), ("patient_id", "role_name = 'role_patient' and patient_id is null"),
    ))),
)

# Access

register(
    "portal_for_users", lambda d: access.portal_for_users(d.clinic),
    sql("""select u.username, l.patient_id, l.first_name, l.last_name, l.order_date, l.test_name, l.status
        from line l join app_users u using (patient_id) where u.is_active and u.role_name = 'role_patient' and l.status = 'COMPLETED'"""),
)
register(
    "role_projection", lambda d: access.role_projection(d.clinic),
    sql("""select 'role_admin' as role_name, 'v_admin_audit_log' as object_name, cast(15 as int) as n_columns, count(*) as n_rows
        from lab_test left join payments using (order_id)
        union all select 'role_front_desk', 'v_frontdesk_dashboard', 6, count(*) from line
        union all select 'role_lab_tech', 'v_labtech_workspace', 9, count(*) from line where status <> 'CANCELLED'
        union all select 'role_doctor', 'v_doctor_clinical_view', 9, count(*) from line
        union all select 'role_patient', 'v_patient_portal', 6, count(*) from line where status = 'COMPLETED'"""),
)
_holders = "select mysql_username as grantee, object_name, privilege from app_users join held using (role_name)"
register("effective_grants", lambda d: access.account_grants(d.clinic), sql(_holders))
register(
    "user_grants", lambda d: access.user_grants(d.clinic),
    sql("""select user_id, username, mysql_username, role_name, object_name, privilege from app_users join held using (role_name)
        where is_active"""),
)
register(
    "privilege_matrix", lambda d: access.privilege_matrix(access.account_grants(d.clinic), "grantee"),
    sql("select grantee, object_name, string_agg(distinct privilege, ', ' order by privilege) as privileges from holders group by 1, 2", holders=_holders),
)
register(
    "access_audit", lambda d: access.access_audit(d.clinic, d.intake.access_requests()),
    sql("""select a.event_id, a.username, a.object_name, a.privilege, u.role_name,
        case when u.role_name = 'role_admin' or h.role_name is not null then 'ALLOWED' else 'DENIED' end as decision
        from in_access a left join (select username, role_name from app_users where is_active) u using (username)
        left join held h on h.role_name = u.role_name and h.object_name = a.object_name and h.privilege = a.privilege"""),
)
