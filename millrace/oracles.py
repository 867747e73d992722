"""The queries of ``queries`` in plain SQL for DuckDB, over the same tables."""

from __future__ import annotations

import re

from millrace.bindings.retail import VIEWS
from millrace.operators.rules import ORDER

#: Intermediate tables by name; each may use the others and the retail tables.
TABLES: dict[str, str] = dict(VIEWS)


def with_tables(sql: str, shadow: dict[str, str] | None = None) -> str:
    """``sql`` preceded by definitions of all tables that it uses, directly or not."""
    known = TABLES | (shadow or {})
    needed: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in known:
            if name not in needed and name not in path and re.search(rf"\b{name}\b", text):
                visit(known[name], (*path, name))
                needed.append(name)

    visit(sql, ())
    return ("WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" + sql) if needed else sql


def longs(sql: str, bigint: str = "", decimal: str = "", double: str = "") -> str:
    """``sql`` with columns cast to the types that the queries give."""
    casts = ", ".join([*(f"cast({c} as bigint) as {c}" for c in bigint.split()), *(f"cast({c} as decimal(18,2)) as {c}" for c in decimal.split()), *(f"cast({c} as double) as {c}" for c in double.split())])
    return f"select * replace ({casts}) from ({sql}) q"


def initcap(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def half_up(total: str, n: str) -> str:
    """Exact total / n rounded half up to cents: DuckDB divides decimals as doubles, so it is done on whole cents."""
    return f"cast(floor((2 * cast(({total}) * 100 as bigint) + ({n}))::double / (2 * ({n}))::double) / 100 as decimal(18,2))"


def _date(x: str) -> str:
    return f"cast(try_strptime(trim({x}), '%Y-%m-%d') as date)"


def _time(x: str) -> str:
    return f"try_strptime(trim({x}), '%Y-%m-%d %H:%M:%S')"


def _dec(x: str, p: int = 10) -> str:
    return f"try_cast(trim({x}) as decimal({p},2))"


_EMAIL = r"'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$'"


def _blank(x: str) -> str:
    return f"coalesce(trim({x}) = '', true)"


def _tagged(flavour: str, name: str, shape: str, key: str, order: str, rules: list[tuple[str, str]], parents: dict[str, tuple[str, str]]) -> None:
    """Adds <flavour>_<name>: shaped rows with their rank and first reason. ``parents``: column -> (dataset, key)."""
    joins = " ".join(f"left join (select distinct {k} as ref_{c}{', total_amount as p_total' if d == 'orders' and name == 'payments' else ''} from {flavour}_{d} where reason is null) f_{c} on s.{c} = f_{c}.ref_{c}" for c, (d, k) in parents.items())
    chain = " ".join(f"when {cond} then '{reason}'" for reason, cond in rules)
    TABLES[f"{flavour}_{name}"] = f"""
      select *, case {chain} end as reason from (
        select s.*, row_number() over (partition by {key} order by {order}) as rnk from (select {shape} from r_{name}) s) s {joins}"""


def _define() -> None:
    b = "batch"
    _tagged(b, "customers", f"trim(customer_id) customer_id, {initcap('trim(first_name)')} first_name, {initcap('trim(last_name)')} last_name, lower(trim(email)) email, trim(phone) phone, trim(address) address, {initcap('trim(city)')} city, upper(trim(state)) state, upper(trim(coalesce(country, 'US'))) country, trim(postal_code) postal_code, {_date('signup_date')} signup_date, upper(coalesce(trim(loyalty_tier), 'STANDARD')) loyalty_tier, signup_date raw_date, email raw_email",
            "customer_id", "signup_date desc nulls last, email asc nulls last",
            [("NULL_MANDATORY_FIELD", f"{_blank('customer_id')} or {_blank('email')}"), ("DUPLICATE_CUSTOMER_ID", "rnk > 1"), ("INVALID_EMAIL_FORMAT", f"not regexp_matches(email, {_EMAIL})"), ("MALFORMED_SIGNUP_DATE", f"signup_date is null and not {_blank('raw_date')}")], {})
    _tagged(b, "products", f"trim(product_id) product_id, trim(product_sku) product_sku, trim(product_name) product_name, {_dec('unit_price')} unit_price", "product_id", "product_sku asc nulls last",
            [("NULL_MANDATORY_FIELD", f"{_blank('product_id')} or {_blank('product_name')} or unit_price is null"), ("DUPLICATE_PRODUCT_ID", "rnk > 1"), ("INVALID_PRICE_NON_POSITIVE", "unit_price <= 0")], {})
    _tagged(b, "stores", f"trim(store_id) store_id, {_date('opened_date')} opened_date", "store_id", "opened_date desc nulls last", [("NULL_MANDATORY_FIELD", _blank("store_id")), ("DUPLICATE_STORE_ID", "rnk > 1")], {})
    _tagged(b, "employees", f"trim(employee_id) employee_id, trim(store_id) store_id, {_date('hire_date')} hire_date", "employee_id", "hire_date desc nulls last",
            [("NULL_MANDATORY_FIELD", _blank("employee_id")), ("DUPLICATE_EMPLOYEE_ID", "rnk > 1"), ("ORPHAN_STORE_FK", "ref_store_id is null")], {"store_id": ("stores", "store_id")})
    _tagged(b, "orders", f"trim(order_id) order_id, trim(customer_id) customer_id, trim(store_id) store_id, trim(employee_id) employee_id, {_time('order_timestamp')} ts, order_timestamp raw_ts, upper(trim(order_status)) order_status, {_dec('total_amount', 12)} total_amount",
            "order_id", "ts desc nulls last",
            [("NULL_MANDATORY_FIELD", f"{_blank('order_id')} or total_amount is null"), ("DUPLICATE_ORDER_ID", "rnk > 1"), ("MALFORMED_ORDER_TIMESTAMP", f"ts is null and not {_blank('raw_ts')}"), ("INVALID_ORDER_STATUS", "order_status not in ('COMPLETED', 'PENDING', 'CANCELLED', 'REFUNDED')"),
             ("ORPHAN_CUSTOMER_FK", "ref_customer_id is null"), ("ORPHAN_STORE_FK", "ref_store_id is null"), ("ORPHAN_EMPLOYEE_FK", "ref_employee_id is null")],
            {"customer_id": ("customers", "customer_id"), "store_id": ("stores", "store_id"), "employee_id": ("employees", "employee_id")})
    items = [("DUPLICATE_ORDER_ITEM_ID", "rnk > 1")]
    refs = {"order_id": ("orders", "order_id"), "product_id": ("products", "product_id")}
    shape = f"trim(order_item_id) order_item_id, order_id, product_id, try_cast(trim(quantity) as int) quantity, {_dec('unit_price')} unit_price"
    _tagged(b, "order_items", shape, "order_item_id", "order_id",
            [("NULL_MANDATORY_FIELD", f"{_blank('order_item_id')} or quantity is null or unit_price is null"), *items, ("INVALID_QUANTITY_NON_POSITIVE", "quantity <= 0"), ("INVALID_UNIT_PRICE_NON_POSITIVE", "unit_price <= 0"), ("ORPHAN_ORDER_FK", "ref_order_id is null"), ("ORPHAN_PRODUCT_FK", "ref_product_id is null")], refs)
    _tagged(b, "payments", f"trim(payment_id) payment_id, trim(order_id) order_id, {_time('payment_timestamp')} ts, upper(trim(payment_status)) payment_status, {_dec('payment_amount', 12)} amount", "payment_id", "ts desc nulls last",
            [("NULL_MANDATORY_FIELD", f"{_blank('payment_id')} or amount is null"), ("DUPLICATE_PAYMENT_ID", "rnk > 1"), ("INVALID_PAYMENT_STATUS", "payment_status not in ('SUCCESS', 'FAILED', 'PENDING')"), ("ORPHAN_ORDER_FK", "ref_order_id is null"), ("PAYMENT_AMOUNT_UNRECONCILED", "payment_status = 'SUCCESS' and abs(amount - p_total) > 0.01")],
            {"order_id": ("orders", "order_id")})
    _tagged(b, "returns", f"trim(return_id) return_id, trim(order_item_id) order_item_id, {_time('return_timestamp')} ts, {_dec('refund_amount')} refund", "return_id", "ts desc nulls last",
            [("NULL_MANDATORY_FIELD", f"{_blank('return_id')} or refund is null"), ("DUPLICATE_RETURN_ID", "rnk > 1"), ("ORPHAN_ORDER_ITEM_FK", "ref_order_item_id is null")], {"order_item_id": ("order_items", "order_item_id")})
    s, newest = "silver", "_ingested_timestamp desc nulls last"
    _tagged(s, "customers", f"customer_id, trim(first_name) first_name, trim(last_name) last_name, lower(trim(email)) email, {_date('signup_date')} d, _ingested_timestamp", "customer_id", newest,
            [("NULL_CUSTOMER_ID", _blank("customer_id")), ("DUPLICATE_CUSTOMER_ID", "rnk > 1"), ("NULL_MANDATORY_NAME", "first_name is null or last_name is null"), ("INVALID_EMAIL_FORMAT", f"email is null or not regexp_matches(email, {_EMAIL})"), ("MALFORMED_SIGNUP_DATE", "d is null")], {})
    _tagged(s, "products", f"product_id, trim(product_name) product_name, {_dec('unit_price')} unit_price, {_dec('cost_price')} cost_price, _ingested_timestamp", "product_id", newest,
            [("NULL_PRODUCT_ID", _blank("product_id")), ("DUPLICATE_PRODUCT_ID", "rnk > 1"), ("NULL_MANDATORY_PRODUCT_INFO", _blank("product_name")), ("INVALID_UNIT_PRICE", "unit_price is null or unit_price <= 0"), ("INVALID_COST_PRICE", "cost_price is null or cost_price <= 0")], {})
    _tagged(s, "stores", f"store_id, trim(store_name) store_name, {_date('opened_date')} d, _ingested_timestamp", "store_id", newest,
            [("NULL_STORE_ID", _blank("store_id")), ("DUPLICATE_STORE_ID", "rnk > 1"), ("NULL_STORE_NAME", _blank("store_name")), ("MALFORMED_OPENED_DATE", "d is null")], {})
    _tagged(s, "employees", f"employee_id, store_id, trim(first_name) first_name, trim(last_name) last_name, lower(trim(email)) email, {_date('hire_date')} d, _ingested_timestamp", "employee_id", newest,
            [("NULL_EMPLOYEE_ID", _blank("employee_id")), ("DUPLICATE_EMPLOYEE_ID", "rnk > 1"), ("NULL_MANDATORY_NAME", "first_name is null or last_name is null"), ("INVALID_EMAIL_FORMAT", f"email is null or not regexp_matches(email, {_EMAIL})"), ("MALFORMED_HIRE_DATE", "d is null"), ("ORPHAN_STORE_FK", "ref_store_id is null")],
            {"store_id": ("stores", "store_id")})
    _tagged(s, "orders", f"order_id, customer_id, store_id, {_time('order_timestamp')} ts, trim(order_status) order_status, _ingested_timestamp", "order_id", newest,
            [("NULL_ORDER_ID", _blank("order_id")), ("DUPLICATE_ORDER_ID", "rnk > 1"), ("MALFORMED_ORDER_TIMESTAMP", "ts is null"), ("INVALID_ORDER_STATUS", "order_status is null or order_status not in ('COMPLETED', 'PENDING', 'CANCELLED', 'REFUNDED', 'PROCESSING')"), ("ORPHAN_CUSTOMER_FK", "ref_customer_id is null"), ("ORPHAN_STORE_FK", "ref_store_id is null")],
            {"customer_id": ("customers", "customer_id"), "store_id": ("stores", "store_id")})
    _tagged(s, "order_items", f"{shape}, _ingested_timestamp", "order_item_id", newest,
            [("NULL_ORDER_ITEM_ID", _blank("order_item_id")), *items, ("INVALID_QUANTITY", "quantity is null or quantity <= 0"), ("INVALID_UNIT_PRICE", "unit_price is null or unit_price <= 0"), ("ORPHAN_ORDER_FK", "ref_order_id is null"), ("ORPHAN_PRODUCT_FK", "ref_product_id is null")], refs)
    _tagged(s, "payments", f"payment_id, order_id, {_time('payment_timestamp')} ts, trim(payment_status) payment_status, {_dec('payment_amount', 12)} amount, null::decimal(12,2) as total_amount, _ingested_timestamp", "payment_id", newest,
            [("NULL_PAYMENT_ID", _blank("payment_id")), ("DUPLICATE_PAYMENT_ID", "rnk > 1"), ("INVALID_PAYMENT_STATUS", "payment_status is null or payment_status not in ('SUCCESS', 'FAILED', 'PENDING', 'REFUNDED')"), ("INVALID_PAYMENT_AMOUNT", "amount is null or amount <= 0"), ("MALFORMED_PAYMENT_TIMESTAMP", "ts is null"), ("ORPHAN_ORDER_FK", "ref_order_id is null")],
            {"order_id": ("orders", "order_id")})
    TABLES["silver_payments"] = TABLES["silver_payments"].replace(", total_amount as p_total", "")
    # delivered twice; a row is behind if all that it says came again later
    delivered = {
        "customers": "customer_id, first_name, last_name, email, phone, address, city, state, country, postal_code, signup_date, loyalty_tier",
        "products": "product_id, product_sku, product_name, category, subcategory, unit_price, cost_price, is_active, description",
        "stores": "store_id, store_name, store_type, region, state, country, opened_date",
    }
    for n, columns in delivered.items():
        moved = "case when ends_with(customer_id, '4') then 'moved' else city end as city, " if n == "customers" else ""
        TABLES[f"twice_{n}"] = f"select * from r_{n} union all select * replace ({moved}_ingested_timestamp + interval 7 day as _ingested_timestamp) from r_{n}"
        TABLES[f"behind_{n}"] = f"select *, max(_ingested_timestamp) over (partition by {columns}) > _ingested_timestamp as behind from twice_{n}"
        told = TABLES[f"silver_{n}"]
        for old, new in ((f"_ingested_timestamp from r_{n}", f"_ingested_timestamp, behind from behind_{n}"), (f"order by {newest}", f"order by behind, {newest}"), ("case when (", "case when behind then 'REDELIVERED' when ("), ("case when coalesce", "case when behind then 'REDELIVERED' when coalesce")):
            told = told.replace(old, new, 1) if old in told else told
        TABLES[f"redelivered_{n}"] = told
    _tagged(s, "returns", f"return_id, order_item_id, {_time('return_timestamp')} ts, {_dec('refund_amount')} refund, _ingested_timestamp", "return_id", newest,
            [("NULL_RETURN_ID", _blank("return_id")), ("DUPLICATE_RETURN_ID", "rnk > 1"), ("INVALID_REFUND_AMOUNT", "refund is null or refund < 0"), ("MALFORMED_RETURN_TIMESTAMP", "ts is null"), ("ORPHAN_ORDER_ITEM_FK", "ref_order_item_id is null")], {"order_item_id": ("order_items", "order_item_id")})

    TABLES["curated_lines"] = """
      select l.*, cast(gross_sales - discount_amount as decimal(12,2)) as net_sales, cast(cast(gross_sales - discount_amount as decimal(12,2)) - cost_amount as decimal(12,2)) as gross_profit from (
        select g.*, cast(gross_sales * discount_percent as decimal(12,2)) as discount_amount from (
          select i.order_item_id, i.order_id, i.product_id, i.quantity, i.discount_percent, o.customer_id, o.order_timestamp, o.order_date, o.channel, p.product_name, p.category, s.region as store_region,
            cast(i.quantity * i.unit_price as decimal(12,2)) as gross_sales, cast(i.quantity * p.cost_price as decimal(12,2)) as cost_amount,
            year(o.order_date) as order_year, month(o.order_date) as order_month, day(o.order_date) as order_day
          from c_order_items i join c_orders o on i.order_id = o.order_id join c_products p on i.product_id = p.product_id join c_customers c on o.customer_id = c.customer_id join c_stores s on o.store_id = s.store_id) g) l"""
    TABLES["line_metrics"] = """
      select customer_id, order_id, row_number() over w as customer_order_sequence, datediff('day', lag(order_date) over w, order_date) as days_since_prior_order,
        cast(sum(spend) over (partition by customer_id order by order_timestamp, order_id rows unbounded preceding) as decimal(14,2)) as customer_running_spend
      from (select customer_id, order_id, order_timestamp, order_date, sum(net_sales) as spend from curated_lines group by all) o window w as (partition by customer_id order by order_timestamp, order_id)"""
    TABLES["line_ranks"] = """
      select category, product_id, dense_rank() over (partition by category order by total desc) as category_product_rank from (select category, product_id, sum(net_sales) as total from curated_lines group by all) t"""
    TABLES["v_curated_sales"], TABLES["v_returns"] = "select * from curated_lines", "select * from c_returns"

    back = "from c_returns r join c_order_items i on r.order_item_id = i.order_item_id join c_orders o on i.order_id = o.order_id"
    TABLES["gold_daily_sales_performance"] = f"""
      select s.*, net_sales - total_cogs as gross_profit, coalesce(returns_count, 0) as returns_count, coalesce(refunds, 0) as total_refunded_amount from (
        select o.order_date, count(distinct o.order_id) as total_orders, sum(quantity) as total_units_sold, sum(quantity * i.unit_price) as gross_revenue, sum(discount_amount) as total_discounts, sum(net_amount) as net_sales, sum(quantity * cost_price) as total_cogs
        from c_order_items i join c_orders o on i.order_id = o.order_id join c_products p on i.product_id = p.product_id group by o.order_date) s
      left join (select order_date, count(*) as returns_count, sum(refund_amount) as refunds {back} group by order_date) b on s.order_date = b.order_date"""
    TABLES["gold_monthly_revenue"] = f"""
      select s.*, coalesce(refunds, 0) as total_refunded_amount from (
        select year(order_date) as year, month(order_date) as month, count(distinct o.order_id) as total_orders, sum(quantity) as total_units_sold, sum(net_amount) as total_net_revenue from c_order_items i join c_orders o on i.order_id = o.order_id group by 1, 2) s
      left join (select year(order_date) as y, month(order_date) as m, sum(refund_amount) as refunds {back} group by 1, 2) b on s.year = b.y and s.month = b.m"""
    TABLES["gold_revenue_by_store_region"] = f"""
      select store_id, store_name, store_type, region, state, country, coalesce(n, 0) as total_orders, coalesce(net, 0) as total_net_revenue, coalesce({half_up('net', 'n')}, 0) as avg_order_value
      from c_stores st left join (select store_id as k, count(distinct o.order_id) as n, sum(net_amount) as net from c_order_items i join c_orders o on i.order_id = o.order_id group by store_id) s on st.store_id = s.k"""
    TABLES["gold_category_revenue_performance"] = f"""
      select s.*, coalesce(n, 0) as units_returned, coalesce(refunds, 0) as total_refunded_amount, {half_up('coalesce(n, 0) * 100', 'units_sold')} as return_rate_pct from (
        select category, subcategory, sum(quantity) as units_sold, sum(quantity * i.unit_price) as gross_revenue, sum(discount_amount) as total_discounts, sum(net_amount) as net_revenue from c_order_items i join c_products p on i.product_id = p.product_id group by 1, 2) s
      left join (select category as c, subcategory as u, count(*) as n, sum(refund_amount) as refunds from c_returns r join c_order_items i on r.order_item_id = i.order_item_id join c_products p on i.product_id = p.product_id group by 1, 2) b on s.category = b.c and s.subcategory = b.u"""
    TABLES["gold_customer_spending_summary"] = f"""
      select customer_id, first_name, last_name, email, loyalty_tier, coalesce(n, 0) as total_orders, coalesce(net, 0) as lifetime_spend, first_order_date, latest_order_date, coalesce({half_up('net', 'n')}, 0) as avg_order_value
      from c_customers c left join (select customer_id as k, count(distinct o.order_id) as n, sum(net_amount) as net, min(order_date) as first_order_date, max(order_date) as latest_order_date from c_order_items i join c_orders o on i.order_id = o.order_id group by 1) s on c.customer_id = s.k"""
    TABLES["gold_return_refund_performance"] = f"""
      select return_reason, count(*) as return_count, sum(refund_amount) as total_refund_amount, {half_up('sum(refund_amount)', 'count(*)')} as avg_refund_amount from c_returns group by 1"""

    TABLES["dim_date"] = calendar("1992-01-01", "1999-12-31")
    for table, key in (("store", "store"), ("product", "product"), ("customer", "customer")):
        if table != "customer":
            TABLES[f"dim_{table}"] = f"select *, row_number() over (order by {key}_id) as {key}_key from c_{table}s"
    fields = "customer_id, first_name, last_name, email, phone, address, city, state, postal_code, country, signup_date, loyalty_tier"
    hashed = "sha256(concat_ws('||', coalesce(loyalty_tier, '<NULL>'), coalesce(address, '<NULL>'), coalesce(city, '<NULL>'), coalesce(state, '<NULL>'), coalesce(postal_code, '<NULL>'))) as attribute_hash"
    start, second = "timestamp '1990-01-01 00:00:00'", "timestamp '1995-06-01 00:00:00'"
    number = "cast(substring(customer_id, 6) as int)"
    first = f"select row_number() over (order by customer_id) as customer_key, {fields}, {hashed}, {start} as effective_from, cast(null as timestamp) as effective_to, true as is_current, 1 as version_number from c_customers"
    TABLES["scd2_all"] = first
    TABLES["scd2_first"] = f"{first} where {number} % 100 <> 0"
    TABLES["scd2_batch"] = f"""
      select n.*, f.version_number as last, case when f.customer_id is null then '0' when f.attribute_hash <> n.attribute_hash then '1' end as kind
      from (select {fields}, {hashed} from c_customers_next) n left join scd2_first f on n.customer_id = f.customer_id"""
    TABLES["dim_customer"] = f"""
      select f.* replace (case when b.kind = '1' then {second} end as effective_to, coalesce(b.kind, '') <> '1' as is_current) from scd2_first f left join scd2_batch b on f.customer_id = b.customer_id
      union all
      select (select max(customer_key) from scd2_first) + row_number() over (order by kind, customer_id), {fields}, attribute_hash, {second}, null, true, coalesce(last, 0) + 1 from scd2_batch where kind is not null"""
    TABLES["scd2_hurt"] = f"select * replace (case when {number} % 17 = 3 then timestamp '1992-01-01 00:00:00' end as effective_to, {number} % 17 <> 3 as is_current) from scd2_all"
    TABLES["scd2_healed"] = f"""
      select * from scd2_hurt union all
      select (select max(customer_key) from scd2_hurt) + row_number() over (order by customer_id), {fields}, attribute_hash, {second}, null, true, 2 from scd2_hurt where not is_current"""
    TABLES["fact_sales"] = """
      select i.order_item_id, i.order_id, coalesce(customer_key, 0) as customer_key, coalesce(product_key, 0) as product_key, coalesce(store_key, 0) as store_key, coalesce(date_key, 0) as order_date_key,
        o.customer_id, i.product_id, o.store_id, o.order_timestamp, o.order_status, o.channel, i.quantity, i.unit_price, cast(i.quantity * i.unit_price as decimal(10,2)) as gross_amount, i.discount_amount, i.net_amount,
        cast(i.quantity * coalesce(p.cost_price, 0) as decimal(10,2)) as cost_amount, cast(i.net_amount - i.quantity * coalesce(p.cost_price, 0) as decimal(10,2)) as profit_amount
      from c_order_items i join c_orders o on i.order_id = o.order_id
        left join dim_customer c on o.customer_id = c.customer_id and o.order_timestamp >= c.effective_from and (c.effective_to is null or o.order_timestamp < c.effective_to)
        left join dim_product p on i.product_id = p.product_id left join dim_store s on o.store_id = s.store_id left join dim_date d on o.order_date = d.full_date"""
    TABLES["fact_returns"] = """
      select r.return_id, r.order_item_id, coalesce(s.order_id, 'UNKNOWN') as order_id, coalesce(customer_key, 0) as customer_key, coalesce(product_key, 0) as product_key, coalesce(store_key, 0) as store_key,
        coalesce(date_key, 0) as return_date_key, r.return_timestamp, r.return_reason, r.return_status, r.refund_amount
      from c_returns r left join fact_sales s on r.order_item_id = s.order_item_id left join dim_date d on cast(r.return_timestamp as date) = d.full_date"""
    TABLES["job_run_audit"] = """
      select cast(y as varchar) || '-' || p as orchestration_run_id, 'dev' as environment, case when rate > 0.2 then 'FAILED' else 'SUCCESS' end as final_status, cast(make_date(y, 1, 1) as timestamp) as started_at, cast(1.0 as double) as duration_seconds,
        n as bronze_rows_ingested, n - bad as silver_valid_rows, bad as silver_quarantine_rows, round(rate, 6) as quarantine_rate, cast(null as varchar) as failure_task, cast(null as varchar) as failure_classification,
        cast(y as varchar) as ingestion_date, rate > 0.2 as quarantine_alert_triggered
      from (select *, cast(bad as double) / cast(n as double) as rate from (
        select year(cast(o_orderdate as date)) as y, o_orderpriority as p, count(*) as n, count(*) filter (o_orderstatus = 'P') as bad from orders group by 1, 2) a) b"""


def calendar(first: str, last: str) -> str:
    return f"""
      select 0 as date_key, date '1900-01-01' as full_date, 0 as day_of_week, 'Unknown' as day_name, 0 as day_of_month, 0 as day_of_year, 0 as week_of_year, 0 as month, 'Unknown' as month_name, 0 as quarter, 'Unknown' as quarter_name, 0 as year, false as is_weekend, false as is_month_end
      union all
      select cast(strftime(d, '%Y%m%d') as int), d, dayofweek(d) + 1, dayname(d), day(d), dayofyear(d), week(d), month(d), monthname(d), quarter(d), 'Q' || cast(quarter(d) as varchar), year(d), dayofweek(d) in (0, 6), d = last_day(d)
      from (select cast(unnest(generate_series(date '{first}', date '{last}', interval 1 day)) as date) as d) t"""


_define()

_DATE_INTS = "date_key day_of_week day_of_month day_of_year week_of_year month quarter year"
_SCD2 = "customer_key, customer_id, address, loyalty_tier, attribute_hash, effective_from, effective_to, is_current, version_number"
_FACT = ("customer_key product_key store_key order_date_key quantity", "unit_price gross_amount discount_amount net_amount cost_amount profit_amount")


def _build() -> dict[str, str]:
    out: dict[str, str] = {}

    def add(name: str, sql: str, bigint: str = "", decimal: str = "", double: str = "") -> None:
        out[name] = with_tables(longs(sql, bigint, decimal, double) if bigint or decimal or double else sql)

    add("revenue_by_region_channel", f"""
      select store_region, channel, count(*) as total_orders, sum(net) as regional_net_revenue, sum(profit) as regional_gross_profit, {half_up('sum(net)', 'count(*)')} as avg_order_value
      from (select store_region, channel, order_id, sum(net_sales) as net, sum(gross_profit) as profit from curated_lines group by 1, 2, 3) o group by 1, 2""",
        "total_orders", "regional_net_revenue regional_gross_profit avg_order_value")
    add("daily_revenue", f"""
      select year(order_date) as order_year, month(order_date) as order_month, order_date, len(list_distinct(list(order_id))) as total_orders, len(list_distinct(list(customer_id))) as unique_customers, sum(quantity) as total_units_sold,
        sum(gross_sales) as total_gross_revenue, sum(discount_amount) as total_discounts, sum(net_sales) as total_net_revenue, {half_up('sum(net_sales)', 'count(*)')} as avg_line_item_value
      from curated_lines group by order_date""",
        "order_year order_month total_orders unique_customers total_units_sold", "total_gross_revenue total_discounts total_net_revenue avg_line_item_value")
    add("top_products_per_category", """
      with t as (select category, product_id, product_name, sum(quantity) as units_sold, cast(sum(net_sales) as decimal(14,2)) as total_net_revenue, cast(sum(gross_profit) as decimal(14,2)) as total_profit from curated_lines group by 1, 2, 3)
      select category, (select count(distinct b.total_net_revenue) + 1 from t b where b.category is not distinct from a.category and b.total_net_revenue > a.total_net_revenue) as category_revenue_rank, product_id, product_name, units_sold, total_net_revenue, total_profit
      from t a qualify dense_rank() over (partition by category order by total_net_revenue desc) <= 5""", "category_revenue_rank units_sold", "total_net_revenue total_profit")
    add("category_return_rate", """
      select category, sum(sold) as total_items_sold, sum(back) as total_returned_items, round(sum(back) * 100.0 / sum(sold), 2) as return_rate_percent,
        sum(net) as category_net_revenue, sum(refund) as total_refunded_amount, sum(net) - sum(refund) as final_net_realized_revenue
      from (
        select category, 1 as sold, net_sales as net, 0 as back, 0::decimal(14,2) as refund from curated_lines
        union all
        select category, 0, 0, 1, refund_amount from c_returns r, curated_lines l where r.order_item_id = l.order_item_id and return_status = 'APPROVED') e
      group by category""",
        "total_items_sold total_returned_items", "return_rate_percent category_net_revenue total_refunded_amount final_net_realized_revenue")
    add("curated_sales_lines", """
      select l.order_item_id, l.order_id, l.customer_id, gross_sales, discount_amount, net_sales, cost_amount, gross_profit, order_year, order_month, order_day, customer_order_sequence, days_since_prior_order, customer_running_spend, category_product_rank
      from curated_lines l join line_metrics m on l.customer_id = m.customer_id and l.order_id = m.order_id left join line_ranks r on l.category = r.category and l.product_id = r.product_id""",
        "order_year order_month order_day customer_order_sequence days_since_prior_order category_product_rank", "gross_sales discount_amount net_sales cost_amount gross_profit customer_running_spend")
    add("customer_order_sequence", "select customer_id, order_id, customer_order_sequence from line_metrics", "customer_order_sequence")
    add("days_since_prior", "select customer_id, order_id, days_since_prior_order from line_metrics", "days_since_prior_order")
    add("running_spend", "select customer_id, order_id, customer_running_spend from line_metrics", "", "customer_running_spend")
    add("category_product_rank", "select * from line_ranks", "category_product_rank")
    for flavour in ("batch", "silver"):
        for name in ORDER:
            add(f"conform_{flavour}_{name}", f"select coalesce(reason, 'VALID') as reason, count(*) as n from {flavour}_{name} group by 1")
    def arrived(ts: str = "_ingested_timestamp") -> str:
        return f"strftime({ts}, '%Y-%m-%d')"

    run = "case when _ingested_timestamp < timestamp '2024-01-02' then 'first' else 'second' end"
    add("landing_to_bronze", " union all ".join(f"select '{n}' as dataset_name, {arrived()} as ingestion_date, {run} as run_id, count(*) as n, count(*) as audited from r_{n} group by 2, 3" for n in ORDER))
    add("silver_from_landing", " union all ".join(f"select '{n}' as dataset_name, {arrived()} as ingestion_date, coalesce(reason, 'VALID') as reason, count(*) as n from silver_{n} group by 2, 3" for n in ("customers", "products", "stores", "employees")))
    add("silver_merge_customers", "select customer_id, address, loyalty_tier from c_customers_next")
    add("redelivered_snapshot", " union all ".join(f"select '{n}' as dataset_name, coalesce(reason, 'VALID') as reason, count(*) as n from redelivered_{n} group by 2" for n in ("customers", "products", "stores")))
    add("conform_valid", "select customer_id, first_name, last_name, concat_ws(' ', first_name, last_name) as full_name, email, phone, address, city, state, country, postal_code, signup_date, loyalty_tier from batch_customers where reason is null")
    add("conform_quarantine", "select customer_id, reason as quarantine_reason, raw_date as delivered_signup_date, raw_email as delivered_email from batch_customers where reason is not null")
    add("json_quarantine_payload", "select customer_id as record_id, 'customers' as source_dataset, reason as rejection_reason, raw_date as raw_signup_date from batch_customers where reason is not null")
    add("quality_metrics", " union all ".join(f"select '{n}' as dataset_name, count(*) as source_row_count, count(*) filter (reason is null) as valid_row_count, count(*) filter (reason is not null) as quarantine_row_count, count(*) filter (reason like 'DUPLICATE%') as duplicate_count, count(*) filter (reason like 'NULL_MANDATORY%') as null_mandatory_count, count(*) filter (reason like 'ORPHAN%') as referential_orphan_count from batch_{n}" for n in ORDER))
    out["dedup_latest_lineitem"] = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc nulls last, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as rn from lineitem) q where rn = 1"
    out["orphan_probe_anti"] = "select o_orderkey, o_custkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_custkey % 10 <> 3)"
    out["fk_valid_semi"] = "select o_orderkey, o_custkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_custkey % 100 <> 0)"
    out["payment_reconcile"] = """
      select case when paid is null then 'NO_PAYMENT' when abs(paid - total) > total * 0.1 then 'UNRECONCILED' else 'RECONCILED' end as state, count(*) as n
      from (select o_orderkey, cast(o_totalprice as decimal(12,2)) as total from orders) o left join (select l_orderkey, sum(cast(l_extendedprice as decimal(12,2))) as paid from lineitem group by 1) l on o_orderkey = l_orderkey group by 1"""

    gold = {
        "gold_daily": ("gold_daily_sales_performance", "total_orders total_units_sold returns_count", "gross_revenue total_discounts net_sales total_cogs gross_profit total_refunded_amount"),
        "gold_monthly": ("gold_monthly_revenue", "year month total_orders total_units_sold", "total_net_revenue total_refunded_amount"),
        "gold_store_region": ("gold_revenue_by_store_region", "total_orders", "total_net_revenue avg_order_value"),
        "gold_category": ("gold_category_revenue_performance", "units_sold units_returned", "gross_revenue total_discounts net_revenue total_refunded_amount return_rate_pct"),
        "gold_customer": ("gold_customer_spending_summary", "total_orders", "lifetime_spend avg_order_value"),
        "gold_returns": ("gold_return_refund_performance", "return_count", "total_refund_amount avg_refund_amount"),
    }
    for name, (table, ints, money) in gold.items():
        add(name, f"select * from {table}", ints, money)
        out[f"{name}_refreshed"] = out[name]  # what a second delivery brings up to date is what is built whole
    turn = "cast(substring(order_id, 5) as bigint) % 100"
    add("change_feed", f"""
      select order_id, order_date, store_id, 'insert' as _change, 1 as _copies from c_orders where {turn} <= 1
      union all select order_id, order_date - 40, 'STR-00001', 'delete', 1 from c_orders where {turn} = 1""", "_copies")
    # KPI queries and views, each in words of its own
    daily, monthly, stores, kinds, spenders, reasons = (t for t, _, _ in gold.values())
    retained = "total_net_revenue - total_refunded_amount"
    add("margin_last30", f"select order_date, total_orders, total_units_sold, gross_revenue, total_discounts, net_sales, total_cogs, gross_profit, case when net_sales <> 0 then round(cast(gross_profit as decimal(18,2)) * 100 / net_sales, 2) end as gross_margin_pct, returns_count, total_refunded_amount from {daily} where order_date in (select order_date from {daily} order by order_date desc limit 30)", "total_orders total_units_sold returns_count", "gross_revenue total_discounts net_sales total_cogs gross_profit total_refunded_amount gross_margin_pct")
    add("monthly_retained", f"select year, month, total_orders, total_units_sold, total_net_revenue, total_refunded_amount, {retained} as net_retained_revenue from {monthly}", "year month total_orders total_units_sold", "total_net_revenue total_refunded_amount net_retained_revenue")
    add("store_rank_top20", f"select store_id, store_name, state, country, total_orders, total_net_revenue, avg_order_value, (select count(distinct b.total_net_revenue) + 1 from {stores} b where b.total_net_revenue > a.total_net_revenue) as revenue_rank from {stores} a order by total_net_revenue desc, store_id limit 20", "total_orders revenue_rank", "total_net_revenue avg_order_value")
    add("category_risk", f"select * exclude (total_discounts) from {kinds}" if "total_discounts" in TABLES[kinds] else f"select * from {kinds}", "units_sold units_returned", "gross_revenue net_revenue total_refunded_amount return_rate_pct")
    add("vip_top50", f"select customer_id, first_name, last_name, email, loyalty_tier, total_orders, lifetime_spend, avg_order_value, first_order_date, latest_order_date from {spenders} where loyalty_tier = 'GOLD' or loyalty_tier = 'PLATINUM' order by lifetime_spend desc, customer_id limit 50", "total_orders", "lifetime_spend avg_order_value")
    add("return_share", f"select return_reason, return_count, total_refund_amount, avg_refund_amount, round(100.0 * return_count / (select sum(return_count) from {reasons}), 2) as pct_of_total_returns from {reasons}", "return_count", "total_refund_amount avg_refund_amount pct_of_total_returns")
    for view, name in (("daily_sales_performance", "gold_daily"), ("revenue_by_store_region", "gold_store_region"), ("category_revenue_performance", "gold_category"), ("customer_spending_summary", "gold_customer"), ("return_refund_performance", "gold_returns")):
        out[f"view_{view}"] = out[name]
    add("view_monthly_revenue", f"select *, {retained} as net_retained_revenue from {monthly}", "year month total_orders total_units_sold", "total_net_revenue total_refunded_amount net_retained_revenue")

    out["dim_date"] = longs(calendar("2020-01-01", "2030-12-31"), _DATE_INTS)
    add("dim_store", "select * from dim_store", "store_key")
    add("dim_product", "select product_id, product_sku, product_name, category, subcategory, cost_price, unit_price, is_active, product_key from dim_product", "product_key", "cost_price unit_price")
    add("dim_employee", "select e.employee_id, coalesce(s.store_key, 0) as store_key, e.store_id, first_name, last_name, email, role, hire_date, is_active, row_number() over (order by employee_id) as employee_key from c_employees e left join dim_store s on e.store_id = s.store_id", "store_key employee_key")
    add("unknown_member_row", "select store_key, store_id, region from dim_store union all select 0, 'Unknown', 'Unknown'", "store_key")
    add("surrogate_keys_initial", "select customer_id, row_number() over (order by customer_id) as customer_key from c_customers")
    add("surrogate_keys_incremental", """
      select customer_id, case when old then row_number() over (partition by old order by customer_id) else (select count(*) from c_customers where cast(substring(customer_id, 6) as int) % 3 <> 0) + row_number() over (partition by old order by customer_id) end as customer_key
      from (select customer_id, cast(substring(customer_id, 6) as int) % 3 <> 0 as old from c_customers) c""")  # fmt: skip
    add("scd1_merge", """
      with p as (select product_id, unit_price, cast(substring(product_id, 6) as int) as n from c_products),
      old as (select *, row_number() over (order by product_id) as product_key from p where n % 100 <> 0),
      new as (select product_id, n, case when n % 5 = 1 then unit_price + 1 else unit_price end as unit_price from p where n % 100 <> 50),
      fresh as (select product_id, (select max(product_key) from old) + row_number() over (order by product_id) as product_key from new where product_id not in (select product_id from old))
      select coalesce(o.product_id, n.product_id) as product_id, coalesce(n.unit_price, o.unit_price) as unit_price, coalesce(o.product_key, f.product_key) as product_key
      from old o full join new n on o.product_id = n.product_id left join fresh f on n.product_id = f.product_id""", "product_key", "unit_price")  # fmt: skip
    out["upsert_merge"] = """
      select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, case when n.o_orderkey is not null and (o.o_orderkey is null or n.total > 100000) then 'X' else o.o_orderstatus end as o_orderstatus,
        case when n.o_orderkey is not null and (o.o_orderkey is null or n.total > 100000) then n.total else o.total end as total
      from (select o_orderkey, o_orderstatus, cast(o_totalprice as decimal(18,2)) as total from orders where o_orderkey % 100 <> 0) o
      full join (select o_orderkey, cast(o_totalprice as decimal(18,2)) as total from orders) n on o.o_orderkey = n.o_orderkey"""
    out["indexed_merge_read"] = """
      select o_orderkey, case when o_orderkey % 100 = 0 then 'X' else o_orderstatus end as o_orderstatus, cast(o_totalprice as decimal(18,2)) as total from orders
      union all select 1000000000000 + c_custkey, 'N', cast(c_acctbal as decimal(18,2)) from customer where c_custkey % 100 = 0"""
    add("scd2_initial", f"select {_SCD2} from scd2_all", "customer_key version_number")
    add("scd2_incremental", f"select {_SCD2} from dim_customer", "customer_key version_number")
    out["scd2_in_place"] = out["scd2_incremental"]
    add("scd2_recovery", f"select {_SCD2} from scd2_healed", "customer_key version_number")
    add("fact_sales_pit", "select * from fact_sales", *_FACT)
    add("fact_returns", "select * from fact_returns", "customer_key product_key store_key return_date_key", "refund_amount")
    # the star, by joining every line first and summing afterwards
    joined = "(select * from fact_sales f left join dim_date on date_key = order_date_key)"
    add("star_sales_by_tier", f"""
      select loyalty_tier, year, quarter_name, count(distinct order_id) as total_orders, sum(quantity) as total_units_sold, sum(gross_amount) as total_gross_sales, sum(discount_amount) as total_discounts,
        sum(net_amount) as total_net_sales, sum(cost_amount) as total_cogs, sum(profit_amount) as total_profit, round(sum(profit_amount)::double / sum(net_amount)::double * 100, 2) as profit_margin_pct
      from {joined} l, (select customer_key as k, loyalty_tier from dim_customer) c where k = customer_key group by 1, 2, 3""", "year total_orders total_units_sold", "total_gross_sales total_discounts total_net_sales total_cogs total_profit")  # fmt: skip
    add("star_category_profit", """
      select category, subcategory, count(*) as items_sold_count, sum(quantity) as total_quantity, sum(gross_amount) as gross_revenue, sum(discount_amount) as total_discounts_given, sum(net_amount) as net_sales_revenue,
        sum(profit_amount) as total_category_profit, round(avg(discount_amount::double / gross_amount::double) * 100, 2) as avg_discount_pct
      from fact_sales f, (select product_key as k, category, subcategory from dim_product) p where k = product_key group by 1, 2""", "items_sold_count total_quantity", "gross_revenue total_discounts_given net_sales_revenue total_category_profit")  # fmt: skip
    add("star_store_month", f"""
      select region, store_name, year, month_name, count(distinct order_id) as order_volume, sum(net_amount) as monthly_net_sales, sum(profit_amount) as monthly_store_profit, {half_up("sum(net_amount)", "count(distinct order_id)")} as avg_order_value
      from {joined} l, (select store_key as k, region, store_name from dim_store) s where k = store_key group by 1, 2, 3, 4""", "year order_volume", "monthly_net_sales monthly_store_profit avg_order_value")  # fmt: skip
    add("star_return_rate", """
      select category, count(distinct sold) as total_sold_items, count(distinct return_id) as returned_items_count, round(count(distinct return_id) / count(distinct sold) * 100, 2) as return_rate_pct, coalesce(sum(refund_amount), 0) as total_refunds_issued
      from (select product_key as k, category from dim_product) p, (select f.order_item_id as sold, f.product_key, r.return_id, r.refund_amount from fact_sales f left join fact_returns r on r.order_item_id = f.order_item_id) l where k = product_key group by 1""", "total_sold_items returned_items_count", "total_refunds_issued")  # fmt: skip
    who = "c.customer_id, c.first_name as customer_first_name, c.last_name as customer_last_name, c.loyalty_tier as customer_historical_loyalty_tier"
    what = "p.product_id, p.product_sku, p.product_name, p.category as product_category, p.subcategory as product_subcategory"
    where = "w.store_id, w.store_name, w.store_type, w.region as store_region, w.state as store_state, w.country as store_country"
    # keys are looked up again from ids and times, not taken from the facts; days outside the calendar are the unknown one
    def day(ts: str) -> str:
        return f"dim_date d on d.date_key = case when {ts} >= timestamp '1992-01-01' and {ts} < timestamp '2000-01-01' then cast(strftime({ts}, '%Y%m%d') as int) else 0 end"

    version = "dim_customer c on c.customer_id = f.customer_id and f.order_timestamp >= c.effective_from and f.order_timestamp < coalesce(c.effective_to, timestamp '9999-01-01')"
    parents = f"join dim_product p on p.product_id = f.product_id join dim_store w on w.store_id = f.store_id join {version}"
    add("sales_detail_view", f"""
      select f.order_item_id, f.order_id, f.order_timestamp, f.order_status, f.channel, f.quantity, f.unit_price, f.gross_amount, f.discount_amount, f.net_amount, f.cost_amount, f.profit_amount,
        d.date_key as order_date_key, d.full_date as order_date, d.year as order_year, d.quarter_name as order_quarter, d.month_name as order_month, d.day_name as order_day_of_week, d.is_weekend as is_weekend_order,
        c.customer_key, {who}, c.email as customer_email, c.city as customer_historical_city, c.state as customer_historical_state, c.postal_code as customer_historical_postal_code,
        p.product_key, {what}, p.unit_price as product_current_unit_price, w.store_key, {where}
      from fact_sales f {parents} join {day("f.order_timestamp")}""", "quantity order_date_key order_year customer_key product_key store_key", "unit_price gross_amount discount_amount net_amount cost_amount profit_amount product_current_unit_price")  # fmt: skip
    add("returns_detail_view", f"""
      select r.return_id, r.order_item_id, f.order_id, r.return_timestamp, r.return_reason, r.return_status, r.refund_amount, d.date_key as return_date_key, d.full_date as return_date, d.year as return_year,
        d.month_name as return_month, c.customer_key, {who}, p.product_key, {what}, w.store_key, {where}
      from c_returns r join fact_sales f on f.order_item_id = r.order_item_id {parents} join {day("r.return_timestamp")}""", "return_date_key return_year customer_key product_key store_key", "refund_amount")  # fmt: skip
    out["pit_versions"] = """
      with v as (select user_id, event_id as version_id, ts as a, lead(ts) over (partition by user_id order by ts, event_id) as b from events where event_type in ('signup', 'error'))
      select e.event_id, coalesce(v.version_id, -1) as version_id from events e left join v on e.user_id = v.user_id and e.ts >= v.a and (v.b is null or e.ts < v.b) where e.event_type = 'purchase'"""

    def check(name: str, table: str, value: str, allowed: bool = False) -> str:
        return f"select '{name}' as check_name, '{table}' as table_name, cast(({value}) as bigint) as failed_rows, ({value}) = 0 as passed"

    complete = {"dim_product": "product_key product_id product_name", "dim_store": "store_key store_id store_name", "dim_date": "date_key full_date year month", "dim_customer": "customer_key customer_id effective_from is_current", "fact_sales": "order_item_id customer_key product_key store_key order_date_key net_amount", "fact_returns": "return_id order_item_id refund_amount"}
    unique = [("dim_product", "product_key"), ("dim_product", "product_id"), ("dim_store", "store_key"), ("dim_store", "store_id"), ("dim_date", "date_key"), ("dim_customer", "customer_key"), ("fact_sales", "order_item_id"), ("fact_returns", "return_id")]
    full = {(t, c): check(f"completeness_{c}", t, f"select count(*) from {t} where {c} is null") for t, cs in complete.items() for c in cs.split()}
    single = {(t, c): check(f"uniqueness_{c}", t, f"select count({c}) - count(distinct {c}) from {t}") for t, c in unique}
    keys = (("product_key", "dim_product", "product_key"), ("store_key", "dim_store", "store_key"), ("customer_key", "dim_customer", "customer_key"), ("order_date_key", "dim_date", "date_key"))
    groups = {
        "completeness": list(full.values()),
        "uniqueness": list(single.values()),
        "ri": [check(f"referential_integrity_{c}", "fact_sales", f"select count(*) from fact_sales f where {c} <> 0 and not exists (select 1 from {t} d where d.{k} = f.{c})") for c, t, k in keys],
        "unknown": [check(f"unknown_member_{c}", t, f"select count(*) from {t} where {c} = 0") for t, d in (("fact_sales", "order_date_key"), ("fact_returns", "return_date_key")) for c in ("customer_key", "product_key", "store_key", d)],
        "scd2": [
            check("scd2_one_current", "dim_customer", "select count(*) from (select customer_id from dim_customer group by 1 having count(*) filter (is_current) <> 1) c"),
            check("scd2_current_open", "dim_customer", "select count(*) from dim_customer where is_current and effective_to is not null"),
            check("scd2_ended_forward", "dim_customer", "select count(*) from dim_customer where not is_current and (effective_to is null or effective_from >= effective_to)"),
            check("scd2_no_overlap", "dim_customer", "select count(*) from (select effective_from, lag(effective_to) over (partition by customer_id order by effective_from) as b from dim_customer) o where b is not null and effective_from < b"),
        ],
        "measures": [check("positive_quantity", "fact_sales", "select count(*) from fact_sales where not coalesce(quantity > 0, false)"), check("net_is_gross_less_discount", "fact_sales", "select count(*) from fact_sales where net_amount <> gross_amount - discount_amount")],
    }
    kind = {"completeness": "COMPLETENESS", "uniqueness": "UNIQUENESS", "ri": "REFERENTIAL_INTEGRITY", "unknown": "UNKNOWN_MEMBER", "scd2": "SCD2_INVARIANT", "measures": "MEASURE"}
    for name, group in groups.items():
        add(f"quality_{name}", " union all ".join(group))
    add("quality_gate_log", " union all ".join(f"select check_name, table_name, '{kind[name]}' as check_type, 'CRITICAL' as severity, passed, failed_rows as failed_row_count from ({v}) x" for name, group in groups.items() for v in group))
    sums = "count(*) as n, cast(sum(quantity * unit_price) as decimal(18,2)) as gross, cast(sum(discount_amount) as decimal(18,2)) as discount, cast(sum(net_amount) as decimal(18,2)) as net"
    add("warehouse_reconciliation", f"""
      select f.n as fact_n, f.gross as fact_gross, f.discount as fact_discount, f.net as fact_net, s.n as source_n, s.gross as source_gross, s.discount as source_discount, s.net as source_net,
        f.n = s.n and f.gross = s.gross and f.discount = s.discount and f.net = s.net as reconciled
      from (select {sums} from fact_sales) f, (select {sums} from c_order_items) s""")  # fmt: skip

    placed = "select cast(o_orderkey as bigint) as k, o_orderpriority as name from orders"
    later = f"{placed} union all select cast(-o_orderkey as bigint), 'later' from orders"
    out["time_travel_v0"], out["time_travel_at"] = placed, later
    evolved = f"select k, name, cast(null as varchar) as extra from ({later}) b union all select cast(1000000000000 + c_custkey as bigint), c_name, 'new' from customer"
    updated = f"select k, case name when '1-URGENT' then '1-urgent' else name end as name, extra from ({evolved}) e"
    out["schema_evolved_read"], out["update_read"] = evolved, updated
    out["named_read"] = out["update_read"]
    out["merge_read"] = f"""
      select k, name, extra from ({updated}) u where k < 1000000000000 union all select cast(1000000000000 + c_custkey as bigint), 'm-' || c_name, 'merged' from customer
      union all select cast(2000000000000 + s_suppkey as bigint), 'm-' || s_name, 'merged' from supplier"""
    n = {t: f"(select count(*) from {t})" for t in ("orders", "customer", "supplier")}
    out["history_ops"] = f"select * from (values (cast(0 as bigint), 'OVERWRITE', {n['orders']}), (1, 'APPEND', {n['orders']}), (2, 'APPEND', {n['customer']}), (3, 'UPDATE', 0), (4, 'MERGE', {n['supplier']})) t(version, operation, rows_added)"
    out["partitioned_sink"] = "select event_type, count(*) as n, cast(sum(event_id) as bigint) as sum_ids, min(user_id) as least_user from events group by 1"
    add("scan_csv", "select coalesce(nullif(trim(order_status), ''), '-') as status, count(*) as n, count(nullif(order_id, '')) as ids, count(total_amount) as totals from r_orders group by 1")
    add("scan_json", "select coalesce(loyalty_tier, '-') as tier, count(*) as n, count(email) as emails from r_customers group by 1")
    out["fact_upsert_rerun"] = out["fact_sales_pit"]
    path = "'retail/' || event_type || '/' || cast(event_id as varchar)"
    out["ingest_pending_files"] = f"select event_id, sha256(lower(event_type) || '|' || lower({path}) || '|') as ingestion_id from events where event_id % 3 <> 0 and not (event_id % 5 = 0 and event_id % 10 <> 0)"
    shown = "orchestration_run_id, environment, final_status, started_at, duration_seconds, bronze_rows_ingested, silver_valid_rows, silver_quarantine_rows, quarantine_rate, failure_task, failure_classification"
    add("run_audit_latest", f"select {shown} from (select *, row_number() over (order by started_at desc, orchestration_run_id) as nth from job_run_audit) r where nth <= 20", "bronze_rows_ingested silver_valid_rows silver_quarantine_rows")
    add("quarantine_trend", "select ingestion_date, count(*) as total_runs, sum(silver_valid_rows) as valid_rows, sum(silver_quarantine_rows) as quarantine_rows, round(sum(silver_quarantine_rows)::double * 100 / sum(silver_valid_rows + silver_quarantine_rows), 2) as quarantine_pct, if(bool_or(quarantine_alert_triggered), 'YES', 'NO') as any_alert from job_run_audit group by 1", "total_runs valid_rows quarantine_rows")
    out["event_props"] = "select event_type, cast(sum(try_cast(json_extract_string(props, '$.k') as bigint)) as bigint) as sum_k, count(try_cast(json_extract_string(props, '$.k') as decimal(10,2))) as n from events group by 1"
    return out


ORACLE_SQL = _build()
