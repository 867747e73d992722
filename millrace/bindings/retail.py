"""The retail tables over the driver's TPC-H-like ones, in SQL that Spark and DuckDB both read.

``RAW`` are dirty text tables with every kind of defect, placed by key; ``CLEAN`` are typed tables. Names say which:
r_<dataset> and c_<dataset>. Defects of order items and returns depend on their key alone, as those keys repeat.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millrace.session import sql_over

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _id(prefix: str, key: str, width: int) -> str:
    return f"'{prefix}-' || lpad(cast({key} as string), {width}, '0')"


_NEW, _OLD = "cast('2024-01-02 00:00:00' as timestamp)", "cast('2024-01-01 00:00:00' as timestamp)"
_TENTH = "cast(floor(c_custkey / 10) as int)"

RAW = {
    "r_customers": f"""
      select case when c_custkey % 97 = 3 then '' else {_id("CUST", "c_custkey", 6)} end as customer_id,
        case when c_custkey % 11 = 1 then '  jANE ' else 'john' end as first_name, case when c_custkey % 103 = 8 then null else ' smith ' || cast(c_nationkey as string) end as last_name,
        case when c_custkey % 71 = 6 then '' when c_custkey % 61 = 4 then 'x_at_example_no_domain' else ' User' || cast(c_custkey as string) || '@Example.com' end as email,
        '555-' || cast(c_custkey as string) as phone, cast(c_nationkey as string) || ' main street' as address, '  new york' as city, ' ca ' as state,
        case when c_custkey % 5 = 0 then null else 'us' end as country, lpad(cast(c_nationkey as string), 5, '0') as postal_code,
        case when c_custkey % 67 = 8 then '2023-99-99' when c_custkey % 73 = 9 then null else '2023-' || lpad(cast(1 + c_custkey % 12 as string), 2, '0') || '-' || lpad(cast(1 + c_custkey % 28 as string), 2, '0') end as signup_date,
        case c_custkey % 5 when 0 then ' gold ' when 1 then 'platinum' when 2 then 'Silver' when 3 then null else 'standard' end as loyalty_tier, {_OLD} as _ingested_timestamp
      from customer
      union all
      select {_id("CUST", "c_custkey", 6)}, 'dup', 'smith', 'dup' || cast(c_custkey as string) || '@example.com', null, null, null, null, null, null, '2024-01-01', 'gold', {_NEW}
      from customer where c_custkey % 53 = 7""",
    "r_products": f"""
      select case when p_partkey % 89 = 2 then '  ' else {_id("PROD", "p_partkey", 6)} end as product_id, 'SKU-P' || cast(p_partkey as string) as product_sku,
        case when p_partkey % 83 = 5 then '' else ' ' || p_name end as product_name, lower(p_type) as category, p_brand as subcategory,
        case when p_partkey % 101 = 7 then 'N/A' when p_partkey % 79 = 4 then '-' || cast(cast(p_retailprice as decimal(10,2)) as string) else cast(cast(p_retailprice as decimal(10,2)) as string) end as unit_price,
        case when p_partkey % 59 = 3 then '0.00' else cast(cast(1 + p_partkey % 500 as decimal(10,2)) as string) end as cost_price,
        case p_partkey % 3 when 0 then 'TRUE' when 1 then 'false' else ' 1' end as is_active, 'text' as description, {_OLD} as _ingested_timestamp
      from part
      union all
      select {_id("PROD", "p_partkey", 6)}, 'SKU-A' || cast(p_partkey as string), 'again', 'x', 'y', '9.99', '1.00', 'true', null, {_NEW} from part where p_partkey % 47 = 11""",
    "r_stores": f"""
      select case when s_suppkey % 31 = 2 then null else {_id("STR", "s_suppkey", 5)} end as store_id, case when s_suppkey % 29 = 3 then ' ' else s_name end as store_name, 'flag SHIP' as store_type,
        lower(r_name) as region, lower(n_name) as state, 'us' as country,
        case when s_suppkey % 13 = 5 then 'INVALID_DATE' else '2015-01-' || lpad(cast(1 + s_suppkey % 28 as string), 2, '0') end as opened_date, {_OLD} as _ingested_timestamp
      from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
      union all
      select {_id("STR", "s_suppkey", 5)}, s_name, 'outlet', 'x', 'y', 'us', '2020-02-02', {_NEW} from supplier where s_suppkey % 17 = 4""",
    "r_employees": f"""
      select case when {_TENTH} % 23 = 1 then '' else {_id("EMP", "c_custkey", 6)} end as employee_id, {_id("STR", f"{_TENTH} % 120", 5)} as store_id, 'ann' as first_name,
        case when {_TENTH} % 41 = 3 then null else 'lee' end as last_name, case when {_TENTH} % 19 = 2 then 'nobody' else 'E' || cast(c_custkey as string) || '@shop.com' end as email, 'clerk' as role,
        case when {_TENTH} % 37 = 4 then '2023-13-01' else '2021-05-05' end as hire_date, 'true' as is_active, {_OLD} as _ingested_timestamp
      from customer where c_custkey % 10 = 0
      union all
      select {_id("EMP", "c_custkey", 6)}, {_id("STR", "1", 5)}, 'bob', 'ray', 'b@shop.com', 'clerk', '2022-06-06', 'false', {_NEW} from customer where c_custkey % 10 = 0 and {_TENTH} % 29 = 6""",
    "r_orders": f"""
      select case when o_orderkey % 97 = 8 then '' else {_id("ORD", "o_orderkey", 9)} end as order_id, case when o_orderkey % 47 = 1 then 'CUST-999999' else {_id("CUST", "o_custkey", 6)} end as customer_id,
        case when o_orderkey % 53 = 6 then null else {_id("STR", "o_custkey % 100", 5)} end as store_id, {_id("EMP", "cast(floor(o_custkey / 10) as int) * 10", 6)} as employee_id,
        case when o_orderkey % 71 = 3 then '2024-02-31 25:61:99' when o_orderkey % 73 = 5 then '' else cast(cast(o_orderdate as date) as string) || ' 10:20:30' end as order_timestamp,
        case when o_orderkey % 67 = 2 then 'UNKNOWN_STATUS_INVALID' when o_orderkey % 89 = 4 then null when o_orderkey % 3 = 0 then ' completed ' when o_orderkey % 3 = 1 then 'PENDING' else 'PROCESSING' end as order_status,
        o_orderpriority as channel, '5.00' as shipping_cost, '1.50' as tax_amount, cast(cast(o_totalprice as decimal(12,2)) as string) as order_subtotal,
        case when o_orderkey % 83 = 7 then null else cast(cast(o_totalprice as decimal(12,2)) as string) end as total_amount, {_OLD} as _ingested_timestamp
      from orders
      union all
      select {_id("ORD", "o_orderkey", 9)}, {_id("CUST", "o_custkey", 6)}, {_id("STR", "1", 5)}, {_id("EMP", "10", 6)}, '2030-01-01 00:00:00', 'COMPLETED', 'WEB', '1.00', '1.00', '1.00', '1.00', {_NEW}
      from orders where o_orderkey % 59 = 11""",
    "r_order_items": f"""
      select case when l_orderkey % 101 = 9 then '' else 'ITEM-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) end as order_item_id, {_id("ORD", "l_orderkey", 9)} as order_id,
        {_id("PROD", "(l_orderkey * 7 + l_linenumber) % 2100", 6)} as product_id,
        case when l_orderkey % 43 = 3 then '0' when l_orderkey % 41 = 2 then 'many' else cast(cast(l_quantity as int) as string) end as quantity,
        case when l_orderkey % 37 = 5 then '-1.00' else cast(cast(l_extendedprice as decimal(10,2)) as string) end as unit_price,
        case when l_linenumber = 3 then null else cast(cast(l_discount as decimal(5,2)) as string) end as discount_percent, {_OLD} as _ingested_timestamp
      from lineitem""",
    "r_payments": f"""
      select case when o_orderkey % 91 = 6 then '' else {_id("PAY", "o_orderkey", 9)} end as payment_id, case when o_orderkey % 43 = 9 then 'ORD-9999999990' else {_id("ORD", "o_orderkey", 9)} end as order_id,
        case when o_orderkey % 61 = 7 then 'never' else cast(cast(o_orderdate as date) as string) || ' 11:00:00' end as payment_timestamp, 'paypal' as payment_method,
        case when o_orderkey % 67 = 9 then 'STATUS_UNKNOWN_INVALID' when o_orderkey % 79 = 1 then null when o_orderkey % 4 = 0 then 'failed' else 'SUCCESS' end as payment_status,
        case when o_orderkey % 83 = 7 then null when o_orderkey % 37 = 2 then cast(cast(o_totalprice as decimal(12,2)) + cast(25 as decimal(12,2)) as string) when o_orderkey % 109 = 3 then '-5.00' else cast(cast(o_totalprice as decimal(12,2)) as string) end as payment_amount,
        'tx' || cast(o_orderkey as string) as transaction_reference, {_OLD} as _ingested_timestamp
      from orders
      union all
      select {_id("PAY", "o_orderkey", 9)}, {_id("ORD", "o_orderkey", 9)}, '2031-01-01 00:00:00', 'CASH', 'PENDING', '1.00', null, {_NEW} from orders where o_orderkey % 57 = 13""",
    "r_returns": """
      select case when l_orderkey % 103 = 5 then null else 'RET-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) end as return_id,
        case when l_orderkey % 47 = 6 then 'ITEM-99999999' else 'ITEM-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) end as order_item_id,
        case when l_orderkey % 59 = 2 then '2024-02-31 25:61:99' else cast(cast(l_shipdate as date) as string) || ' 09:00:00' end as return_timestamp, 'defective' as return_reason,
        case when l_orderkey % 71 = 4 then 'free' when l_orderkey % 73 = 8 then '-3.00' else '10.00' end as refund_amount, 'approved' as return_status, cast('2024-01-01 00:00:00' as timestamp) as _ingested_timestamp
      from lineitem where l_returnflag = 'R'""",
}

_LINE = """select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as rn from lineitem"""

# of rows with one key the first by the columns that order items show; those after them would change nothing that is shown
_ITEM = """select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) as rn from lineitem"""

CLEAN = {
    "c_customers": f"""
      select {_id("CUST", "c_custkey", 6)} as customer_id, 'First' || cast(c_custkey as string) as first_name, 'Last' as last_name, c_name as full_name, 'c' || cast(c_custkey as string) || '@example.com' as email,
        cast(null as string) as phone, cast(c_nationkey as string) || ' Main' as address, n_name as city, n_name as state, lpad(cast(c_nationkey as string), 5, '0') as postal_code, 'US' as country,
        cast('2020-01-01' as date) as signup_date, case c_custkey % 4 when 0 then 'GOLD' when 1 then 'PLATINUM' when 2 then 'SILVER' else 'STANDARD' end as loyalty_tier
      from customer join nation on c_nationkey = n_nationkey""",
    "c_products": f"""
      select {_id("PROD", "p_partkey", 6)} as product_id, 'SKU' || cast(p_partkey as string) as product_sku, p_name as product_name, p_type as category, p_brand as subcategory,
        cast(p_retailprice as decimal(10,2)) as unit_price, cast(1 + p_partkey % 500 as decimal(10,2)) as cost_price, p_partkey % 9 <> 0 as is_active
      from part""",
    "c_stores": f"""
      select {_id("STR", "s_suppkey", 5)} as store_id, s_name as store_name, case s_suppkey % 2 when 0 then 'Mall' else 'Street' end as store_type, r_name as region, n_name as state, 'US' as country, cast('2015-01-01' as date) as opened_date
      from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "c_employees": f"""
      select {_id("EMP", "c_custkey", 6)} as employee_id, {_id("STR", "c_custkey % 130", 5)} as store_id, 'Ann' as first_name, 'Lee' as last_name, 'e' || cast(c_custkey as string) || '@shop.com' as email, 'clerk' as role,
        cast('2021-05-05' as date) as hire_date, true as is_active
      from customer where c_custkey % 10 = 0""",
    "c_orders": f"""
      select {_id("ORD", "o_orderkey", 9)} as order_id, {_id("CUST", "o_custkey", 6)} as customer_id, {_id("STR", "o_custkey % 100", 5)} as store_id, {_id("EMP", "cast(floor(o_custkey / 10) as int) * 10", 6)} as employee_id,
        cast(o_orderdate as timestamp) as order_timestamp, cast(o_orderdate as date) as order_date, case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'PENDING' else 'CANCELLED' end as order_status,
        o_orderpriority as channel, cast(o_totalprice as decimal(12,2)) as total_amount
      from orders""",
    "c_order_items": f"""
      select 'ITEM-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as order_item_id, {_id("ORD", "l_orderkey", 9)} as order_id, {_id("PROD", "l_partkey", 6)} as product_id, cast(l_quantity as int) as quantity,
        cast(l_extendedprice as decimal(10,2)) as unit_price, cast(l_discount as decimal(5,2)) as discount_percent,
        cast(cast(l_quantity as int) * cast(l_extendedprice as decimal(10,2)) * cast(l_discount as decimal(5,2)) as decimal(10,2)) as discount_amount,
        cast(cast(l_quantity as int) * cast(l_extendedprice as decimal(10,2)) - cast(cast(l_quantity as int) * cast(l_extendedprice as decimal(10,2)) * cast(l_discount as decimal(5,2)) as decimal(10,2)) as decimal(10,2)) as net_amount
      from ({_ITEM}) d where rn = 1""",
    "c_returns": f"""
      select 'RET-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as return_id, 'ITEM-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as order_item_id,
        cast(l_shipdate as timestamp) as return_timestamp, case l_orderkey % 3 when 0 then 'DEFECTIVE' when 1 then 'WRONG_SIZE' else 'UNSATISFIED' end as return_reason,
        cast(l_extendedprice as decimal(10,2)) as refund_amount, case l_orderkey % 4 when 0 then 'PENDING' else 'APPROVED' end as return_status
      from ({_LINE}) d where rn = 1 and l_returnflag = 'R'""",
    # a second delivery: some tiers and addresses changed, and the customers that the first one lacked
    "c_customers_next": f"""
      select {_id("CUST", "c_custkey", 6)} as customer_id, 'First' || cast(c_custkey as string) as first_name, 'Last' as last_name, c_name as full_name, 'c' || cast(c_custkey as string) || '@example.com' as email,
        cast(null as string) as phone, case when c_custkey % 13 = 4 then 'Moved' else cast(c_nationkey as string) || ' Main' end as address, n_name as city, n_name as state, lpad(cast(c_nationkey as string), 5, '0') as postal_code, 'US' as country,
        cast('2020-01-01' as date) as signup_date, case when c_custkey % 7 = 2 then 'PLATINUM' else case c_custkey % 4 when 0 then 'GOLD' when 1 then 'PLATINUM' when 2 then 'SILVER' else 'STANDARD' end end as loyalty_tier
      from customer join nation on c_nationkey = n_nationkey""",
}
VIEWS = RAW | CLEAN


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A retail table of a data folder; Catalyst drops the columns and sources that a query does not use."""
    return sql_over(spark, {source: spark.read.parquet(f"{sf_dir}/{source}.parquet") for source in SOURCES if re.search(rf"\b{source}\b", VIEWS[name])}, VIEWS[name])


def frames(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Tables by dataset, without the prefix."""
    return {n.split("_", 1)[1]: frame(spark, sf_dir, n) for n in names}
