"""Schemas, joins and targets with the source columns and transformations that they should get."""

from __future__ import annotations

from fixtures import RETAIL, RETAIL_EDGES, json_tables
from weftline.operators import candidates, joins
from weftline.sources import catalog

#: Per case: tables, joins, and (target table, column, type, description, sources, transformation or None where none is given).
CASES = {
    "retail": (
        {name: columns for name, (columns, _) in RETAIL.items()},
        [tuple(sorted(pair)) for pair in sorted(RETAIL_EDGES)],
        [
            ("dim_store", "store_key", "int", "surrogate key for store", "stores.store_id", None),
            ("dim_store", "store_name", "string", "store display name", "stores.store_name", None),
            ("dim_store", "city", "string", "store city", "stores.city", None),
            ("dim_store", "region_label", "string", "human-readable region name from region lookup", "regions.region_name", None),
            ("dim_product", "product_key", "int", "surrogate key for product", "products.product_id", None),
            ("dim_product", "product_name", "string", "product name", "products.product_name", None),
            ("dim_product", "category_label", "string", "human-readable category from category lookup", "categories.category_name", None),
            ("dim_product", "unit_cost", "decimal", "product unit cost", "products.unit_cost", None),
            ("dim_customer", "customer_key", "int", "surrogate key for customer", "customers.customer_id", None),
            ("dim_customer", "customer_name", "string", "full name combining first and last name", "customers.first_name customers.last_name", None),
            ("dim_customer", "email", "string", "customer email", "customers.email", None),
            ("dim_customer", "signup_year", "int", "year customer signed up", "customers.signup_date", None),
            ("fact_sales", "order_key", "int", "order identifier", "orders.order_id", None),
            ("fact_sales", "customer_name", "string", "name of customer who placed the order", "customers.first_name customers.last_name", None),
            ("fact_sales", "store_name", "string", "store where order was placed", "stores.store_name", None),
            ("fact_sales", "order_year", "int", "year the order was placed", "orders.order_date", None),
            ("fact_sales", "line_total", "decimal", "quantity multiplied by unit price for the line", "order_lines.quantity order_lines.unit_price", None),
            ("fact_sales", "is_shipped", "boolean", "whether order status is shipped", "orders.status_code", None),
        ],
    ),
    "staff": (
        {
            "employees": "emp_id int pk, first_name string, last_name string, email string, hire_date date, salary decimal, department_id int fk",
            "departments": "dept_id int pk, dept_name string, location string, budget decimal",
        },
        [("employees.department_id", "departments.dept_id")],
        [
            ("dim_employee", "employee_key", "int", "surrogate key", "employees.emp_id", "rename"),
            ("dim_employee", "full_name", "string", "employee full name", "employees.first_name employees.last_name", "concat"),
            ("dim_employee", "hire_year", "int", "year hired", "employees.hire_date", "date_part"),
            ("dim_employee", "department_name", "string", "department name", "departments.dept_name", "fk_lookup"),
            ("dim_employee", "annual_salary", "decimal", "yearly salary", "employees.salary", "rename"),
        ],
    ),
    "shop": (
        {
            "orders": "order_id int pk, customer_id int fk, order_date date, total_amount decimal, status string",
            "customers": "customer_id int pk, first_name string, last_name string, email string, country string",
            "order_items": "item_id int pk, order_id int fk, product_id int fk, quantity int, unit_price decimal",
            "products": "product_id int pk, product_name string, category_code string, weight_grams int",
        },
        [("orders.customer_id", "customers.customer_id"), ("order_items.order_id", "orders.order_id"), ("order_items.product_id", "products.product_id")],
        [
            ("fact_order", "customer_country", "string", "country of the customer", "customers.country", "fk_lookup"),
            ("fact_order", "customer_name", "string", "full name of customer", "customers.first_name customers.last_name", "concat"),
            ("fact_order", "order_year", "int", "year the order was placed", "orders.order_date", "date_part"),
            ("fact_order", "is_completed", "boolean", "whether order is complete", "orders.status", "conditional"),
            ("fact_sales", "line_total", "decimal", "quantity times unit price", "order_items.quantity order_items.unit_price", "arithmetic"),
            ("dim_product", "category_label", "string", "human readable category", "products.category_code", "code_to_label"),
        ],
    ),
    "clinic": (
        {
            "patients": "patient_id int pk, first_name string, last_name string, dob date, gender_code string, insurance_id int fk",
            "insurance_plans": "plan_id int pk, plan_name string, provider_name string, coverage_type_code string",
            "visits": "visit_id int pk, patient_id int fk, doctor_id int fk, visit_date date, diagnosis_code string, visit_cost decimal",
            "doctors": "doctor_id int pk, first_name string, last_name string, specialization_code string, department_id int fk",
            "hospital_departments": "dept_id int pk, dept_name string, floor int",
        },
        [("patients.insurance_id", "insurance_plans.plan_id"), ("visits.patient_id", "patients.patient_id"), ("visits.doctor_id", "doctors.doctor_id"), ("doctors.department_id", "hospital_departments.dept_id")],
        [
            ("dim_patient", "patient_name", "string", "full name of patient", "patients.first_name patients.last_name", "concat"),
            ("dim_patient", "birth_year", "int", "year patient was born", "patients.dob", "date_part"),
            ("dim_patient", "gender_label", "string", "gender in readable form", "patients.gender_code", "code_to_label"),
            ("dim_patient", "insurance_plan", "string", "name of patient insurance plan", "insurance_plans.plan_name", "fk_lookup"),
            ("fact_visit", "patient_age_at_visit", "int", "patient age at time of visit", "patients.dob visits.visit_date", "date_diff"),
            ("fact_visit", "department_name", "string", "department from doctor lookup", "hospital_departments.dept_name", "lookup_join"),
        ],
    ),
    "robust": (
        {
            "src_employees": "emp_id int pk, first_name string, last_name string, email_address string, hire_date date, department_id int fk, salary_amount decimal, manager_id int, phone_num string, job_title string, birth_date date, address_line1 string, zip_code string, performance_rating decimal, is_active boolean",
            "dim_department": "department_id int pk, dept_name string, dept_budget decimal, location_city string",
            "src_projects": "project_id int pk, project_name string, department_id int fk, start_date date, end_date date, budget_usd decimal, status string",
            "src_timesheets": "timesheet_id int pk, emp_id int fk, project_id int fk, log_date date, hours_worked decimal, description string",
            "dim_location": "location_city string pk, country_code string, timezone string, currency string",
        },
        [("src_employees.department_id", "dim_department.department_id"), ("src_employees.emp_id", "src_timesheets.emp_id"), ("src_projects.project_id", "src_timesheets.project_id"),
         ("src_projects.department_id", "dim_department.department_id"), ("dim_department.location_city", "dim_location.location_city")],
        [
            ("dim_employee", "hire_year", "int", "Year employee was hired", "src_employees.hire_date", None),
            ("dim_employee", "birth_month", "int", "Month of birth", "src_employees.birth_date", None),
            ("dim_employee", "hire_date_parsed", "date", "Parsed hire date", "src_employees.hire_date", None),
            ("dim_employee", "is_senior_salary", "boolean", "Whether salary exceeds senior threshold", "src_employees.salary_amount", None),
            ("dim_employee", "rating_text", "string", "Performance rating as text", "src_employees.performance_rating", None),
            ("dim_employee", "department_name", "string", "Department name from lookup", "dim_department.dept_name", None),
            ("dim_employee", "work_timezone", "string", "Employee work timezone via department location", "dim_location.timezone", None),
            ("dim_employee", "pay_currency", "string", "Currency used for employee pay", "dim_location.currency", None),
            ("dim_employee", "email_local_part", "string", "Username from email", "src_employees.email_address", None),
            ("dim_employee", "job_title_lower", "string", "Job title in lowercase", "src_employees.job_title", None),
            ("dim_employee", "employee_full_name", "string", "Employee full name", "src_employees.first_name src_employees.last_name", None),
            ("dim_employee", "clean_address", "string", "Cleaned address text", "src_employees.address_line1", None),
            ("dim_employee", "salary_rounded", "decimal", "Salary rounded to nearest thousand", "src_employees.salary_amount", None),
            ("dim_project", "monthly_budget", "decimal", "Monthly project budget", "src_projects.budget_usd", None),
            ("fct_timesheet", "total_hours", "decimal", "Hours worked copied", "src_timesheets.hours_worked", None),
            ("dim_employee", "emp_tenure_years", "int", "Years since employee was hired", "src_employees.hire_date", None),
            ("dim_employee", "dept_location", "string", "Location of employee department", "dim_department.location_city", None),
            ("dim_project", "proj_duration_days", "int", "Project duration in days", "src_projects.start_date src_projects.end_date", None),
            ("dim_employee", "empl_dob", "date", "Employee date of birth", "src_employees.birth_date", None),
            ("fct_employee", "dept_key", "int", "Department key for employee fact", "src_employees.department_id", None),
            ("dim_project", "project_title", "string", "Project title (renamed from project_name)", "src_projects.project_name", None),
            ("dim_project", "is_active_project", "boolean", "Whether project is currently active", "src_projects.status", None),
        ],
    ),
    "bank": (
        {
            "bank_accounts": "account_id int pk, account_number string, account_type_code string, customer_id int fk, open_date date, balance decimal, status_code string, created_by string, updated_at datetime",
            "bank_customers": "customer_id int pk, first_name string, last_name string, email string, credit_score int, income_annual decimal, risk_category_code string, created_by string, updated_at datetime",
            "bank_transactions": "txn_id int pk, account_id int fk, txn_date date, amount decimal, txn_type_code string, description string, created_by string",
        },
        [("bank_accounts.customer_id", "bank_customers.customer_id"), ("bank_transactions.account_id", "bank_accounts.account_id")],
        [
            ("dim_customer", "customer_name", "string", "customer full name", "bank_customers.first_name bank_customers.last_name", "concat"),
            ("dim_account", "account_type_label", "string", "human readable account type", "bank_accounts.account_type_code", "code_to_label"),
            ("dim_account", "is_active", "boolean", "whether account is currently open", "bank_accounts.status_code", "conditional"),
            ("dim_customer", "income_bracket", "string", "income range bucket", "bank_customers.income_annual", "bucketing"),
            ("fact_txn", "transaction_year", "int", "year of transaction", "bank_transactions.txn_date", "date_part"),
        ],
    ),
}


def planned(spark, name: str) -> dict:
    """(target table, column) -> the mapping of a case."""
    schema, edges, targets = CASES[name]
    columns = catalog.from_json_tables(catalog.json_tables(spark, json_tables({t: (c, []) for t, c in schema.items()})))
    ends = [(a.split("."), b.split(".")) for a, b in edges]
    rows = [(a[0], [a[1]], b[0], [b[1]], "N:1", "right_parent", 0.95, ["pk_fk_relation"], "single") for a, b in ends]
    wanted = spark.createDataFrame([t[:4] for t in targets], "table string, column string, type string, description string")
    return {(r.tt, r.tc): r for r in candidates.plan_mappings(wanted, columns, spark.createDataFrame(rows, joins.EDGE)).collect()}


def scores(spark, name: str) -> list[tuple]:
    """(target, sources right, transformation right or None, sources, transformation) of each target."""
    got = planned(spark, name)
    out = []
    for table, column, _, _, sources, transform in CASES[name][2]:
        r = got.get((table, column))
        out.append((f"{table}.{column}", r is not None and sorted(r.refs) == sorted(sources.split()), transform and (r is not None and r.transform == transform), r and r.refs, r and r.transform))
    return out
