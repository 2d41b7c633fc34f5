"""Input views that the registered queries share, as SQL for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Views whose text runs on both engines.
PORTABLE = {
    "v_accounts": """
select user_id as filer_id, concat(cast(user_id as string), '-', event_type) as account_id,
       case event_type when 'click' then 'USD' when 'view' then 'EUR' when 'signup' then 'COP'
                       when 'purchase' then 'KWD' else 'GBP' end as currency
from events group by user_id, event_type""",
    "v_candidates": """
select e.user_id as filer_id, concat(cast(e.user_id as string), '-', e.event_type) as account_id,
       e.event_id as seq, cast(e.ts as date) as balance_date,
       cast(cast(e.value as decimal(18,2)) as decimal(24,6)) as amount,
       case when e.event_type = 'signup' then 'reconstructed-from-movements'
            when e.event_type = 'error' then 'period-end-summary' else 'transaction-row' end as candidate_type,
       case when e.event_id % 50 = 0 then 'low' when e.event_id % 7 = 0 then 'medium' else 'high' end as confidence,
       concat('events:p1:l', cast(e.event_id as string)) as source_ref
from events e""",
    "v_movements": """
select l_orderkey as page_key,
       row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey,
                          l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as row_number,
       cast(l_shipdate as date) as movement_date,
       case when l_returnflag = 'R' then cast(l_extendedprice as decimal(18,2)) else cast(0 as decimal(18,2)) end as debit,
       case when l_returnflag = 'R' then cast(0 as decimal(18,2)) else cast(l_extendedprice as decimal(18,2)) end as credit
from lineitem""",
    "v_checkpoints": """
select page_key, cast(100000 as decimal(18,2)) as opening,
       cast(100000 + sum(credit) - sum(debit) + case when page_key % 7 = 0 then 1 else 0 end as decimal(18,2)) as closing
from v_movements group by page_key""",
    "v_periods": """
select o_custkey as account_id, o_orderkey as file_id, cast(o_orderdate as date) as start_date,
       cast(o_orderdate as date) + cast((o_orderkey % 3 + 1) * 30 - 1 as int) as end_date
from orders""",
    "v_headers": """
select account_id, file_id, month(start_date) as start_month, day(start_date) as start_day,
       month(end_date) as end_month, day(end_date) as end_day, start_date + 5 as anchor_date
from v_periods""",
    "v_secret_lines": "select doc_id, line_no, replace(line, 'token = ', 'access_token = ') as line from v_lines",
    "v_account_hints": """
select c_nationkey as group_id, c_custkey as file_id, lpad(cast(c_custkey as string), 10, '0') as hint, false as is_partial from customer
union all
select c_nationkey, c_custkey, concat('****', right(lpad(cast(c_custkey as string), 10, '0'), 4)), true from customer where c_custkey % 3 = 0""",
    "v_fx": """
select * from (values ('EUR', 2024, cast(0.96 as decimal(14,6)), cast('1.041666666667' as decimal(20,12))),
                      ('COP', 2024, cast(4400 as decimal(14,6)), cast('0.000227272727' as decimal(20,12))),
                      ('KWD', 2024, cast(0.308 as decimal(14,6)), cast('3.246753246753' as decimal(20,12))),
                      ('GBP', 2024, cast(0.797 as decimal(14,6)), cast('1.254705144291' as decimal(20,12)))
) as t(currency, rate_year, foreign_per_usd, usd_per_foreign)""",
    "v_spot": """
select c.currency, d.rate_date, cast(1 + (dayofyear(d.rate_date) * c.k) % 97 / 100.0 as decimal(14,6)) as rate
from (values ('EUR', 3), ('COP', 5), ('KWD', 7), ('GBP', 11)) as c(currency, k)
cross join (select distinct cast(ts as date) as rate_date from events) d
where dayofyear(d.rate_date) % 10 <> 0""",
    "v_attestations": """
select distinct user_id as filer_id, concat(cast(user_id as string), '-attested') as account_id,
       case when user_id % 2 = 0 then 'user-attested-maximum' else 'user-attested-zero' end as evidence_class,
       cast(case when user_id % 2 = 0 then 600 else 0 end as decimal(24,6)) as maximum_native,
       case when user_id % 4 = 0 then date '2024-01-15' end as maximum_date
from events""",
    "v_interest": """
select e.event_id, e.user_id as filer_id, cast(e.ts as date) as event_date, a.currency,
       cast(cast(e.value as decimal(18,2)) as decimal(24,6)) as amount
from events e join v_accounts a on a.account_id = concat(cast(e.user_id as string), '-', e.event_type)
where a.currency <> 'USD'""",
    "v_rates_wide": """
select * from (values ('Eurolandia', 'Euro', cast('0.951' as decimal(14,6)), cast('0.924' as decimal(14,6)), cast('0.96' as decimal(14,6))),
                      ('Republic of Cafeteria', 'Peso', cast('4256' as decimal(14,6)), cast('4326' as decimal(14,6)), cast(null as decimal(14,6))),
                      ('St. Marina', 'Dollar', cast('2.7' as decimal(14,6)), cast('2.71' as decimal(14,6)), cast('2.72' as decimal(14,6)))
) as t(country, currency, y2022, y2023, y2024)""",
    "v_rate_labels": """
select * from (values (date '2024-12-31', 'Rep. of Cafeteria', 'Peso', cast('4400' as decimal(14,6))),
                      (date '2024-12-31', 'Eurolandia', 'Euro', cast('0.96' as decimal(14,6))),
                      (date '2024-12-31', 'Saint Marina', 'Dollar', cast('2.7' as decimal(14,6))),
                      (date '2024-12-31', 'St Marina', 'Dollar', cast('2.8' as decimal(14,6))),
                      (date '2024-12-31', 'Kuwana', 'New Dinar', cast('0.308' as decimal(14,6))),
                      (date '2024-12-31', 'Listed Island', 'Crown', cast('7.1' as decimal(14,6))),
                      (date '2024-12-31', 'Nowhere', 'Token', cast('1.5' as decimal(14,6))),
                      (date '2024-09-30', 'Eurolandia', 'Euro', cast('0.90' as decimal(14,6)))
) as t(record_date, country, currency, exchange_rate)""",
    "v_rate_map": """
select * from (values ('COP', 'Republic of Cafeteria', 'Peso'), ('EUR', 'Eurolandia', 'Euro'), ('XMD', 'Saint Marina', 'Dollar'),
                      ('KWD', 'Kuwana', 'Dinar'), ('ZZZ', 'Missing Land', 'Mark')) as t(code, country, currency)""",
    "v_rate_exceptions": "select * from (values ('Listed Island', 'Crown')) as t(country, currency)",
}

#: Views with one text per engine.
SPARK = {
    "v_files": """
select concat(source, '/', case when doc_id % 11 = 0 then 'outputs/' else '' end, cast(doc_id as string),
              case doc_id % 13 when 0 then '.env' when 1 then '.pdf' when 2 then '.pem' when 3 then '_token.txt' else '.txt' end) as path,
       doc_id, text, sha2(text, 256) as content_sha256, octet_length(text) as content_bytes
from documents""",
    "v_lines": """
select doc_id, pos + 1 as line_no, line
from documents lateral view posexplode(split(text, '\\n')) t as pos, line""",
}
DUCKDB = {
    "v_files": """
select concat(source, '/', case when doc_id % 11 = 0 then 'outputs/' else '' end, cast(doc_id as string),
              case doc_id % 13 when 0 then '.env' when 1 then '.pdf' when 2 then '.pem' when 3 then '_token.txt' else '.txt' end) as path,
       doc_id, text, sha256(text) as content_sha256, strlen(text) as content_bytes
from documents""",
    "v_lines": """
select doc_id, line_no, line from (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents)""",
}

#: Views that a view reads, in order of definition.
_NEEDS = {"v_checkpoints": ["v_movements"], "v_headers": ["v_periods"], "v_secret_lines": ["v_lines"], "v_interest": ["v_accounts"]}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def _names(view: str) -> list[str]:
    return [*(n for need in _NEEDS.get(view, ()) for n in _names(need)), view]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of this module, over the tables in sf_dir; its tables become temporary views of the session."""
    names = _names(name)
    text = " ".join((PORTABLE | SPARK)[n] for n in names)
    for t in TABLES:
        if f" {t}" in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    found = None
    for n in names:
        found = spark.sql((PORTABLE | SPARK)[n])
        found.createOrReplaceTempView(n)
    return found


def with_views(*views: str) -> str:
    """`with v as (...), ...` for DuckDB."""
    names = dict.fromkeys(n for v in views for n in _names(v))
    return "with " + ",\n".join(f"{n} as ({(PORTABLE | DUCKDB)[n].strip()})" for n in names)
