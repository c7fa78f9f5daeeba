"""DuckDB SQL twins of the derived views, for the correctness gate.

The SQL is written independently of the Spark code (joins against rule
tables, window de-duplication, ``median``), built only from the same
fixed value lists in ``tallyspark.constants``.
"""

from __future__ import annotations

from tallyspark.constants import (DEFAULT_CATEGORY, DERIVED_PHRASES, FIRST_MATCH_RULES,
                                  STOP_WORDS, WEIGHTED_RULES, weight_tenths)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


RX_NONWORD = r"'[^\p{L}\p{N}_\s]'"


def clean_desc_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace(lower(trim(coalesce({x}, 'nan'))), {RX_NONWORD}, ' ', 'g'),"
            f" '\\s+', ' ', 'g')")


def norm_sql(x: str) -> str:
    """Lower, punctuation to blank, split on blanks, drop stop words."""
    words = (f"string_split(trim(regexp_replace(regexp_replace(lower({x}), {RX_NONWORD}, ' ', 'g'),"
             f" '\\s+', ' ', 'g')), ' ')")
    return (f"coalesce(array_to_string(list_filter({words}, lambda w: length(w) > 0 and not "
            f"list_contains({sql_list(STOP_WORDS)}, w)), ' '), '')")


RAW = f"""expenses_raw as (
  select row_id,
    case when row_id % 97 = 0 then 'not-a-date' else ds end as fecha,
    case when row_id % 101 = 0 then null
         when row_id % 103 = 0 then concat('  ', upper(m), '!! ') else m end as descripcion,
    case when row_id % 89 = 0 then 'n/a'
         when row_id % 83 = 0 then '0'
         when row_id % 79 = 0 then concat('-', x)
         when row_id % 73 = 0 then concat('$ ', x)
         when row_id % 71 = 0 then replace(x, '.', ',')
         when row_id % 67 = 0 then '1,234.50' else x end as monto
  from (select o_orderkey as row_id,
          ({sql_list(DERIVED_PHRASES)})[o_orderkey % {len(DERIVED_PHRASES)} + 1] as m,
          strftime(o_orderdate, '%Y-%m-%d') as ds,
          cast(cast((case when o_orderkey % 211 = 0 then 40 else 1 end)
               * (round(o_totalprice / 1000) * 50 + 650.5) as decimal(14,2)) as varchar) as x
        from orders) q0)"""

TYPED = f"""typed as (
  select row_id, try_cast(fecha as timestamp) as fecha, {clean_desc_sql('descripcion')} as descripcion,
    abs(try_cast(replace(replace(replace(monto, '$', ''), ',', '.'), ' ', '') as double)) as monto
  from expenses_raw)"""

VALID = """valid as (
  select * from typed
  where monto is not null and not isnan(monto) and monto > 0 and length(descripcion) > 0)"""

CLEAN = """expenses as (
  select row_id, fecha, descripcion, monto from (
    select *, row_number() over (partition by descripcion, monto order by row_id) as rn from valid) d
  where rn = 1)"""


def _weighted_values() -> str:
    rows = []
    for ord_, (cat, w, kws) in enumerate(WEIGHTED_RULES):
        for kw in kws:
            rows.append(f"({q(cat)}, {ord_}, {q(kw)}, {weight_tenths(w)})")
    return "values " + ", ".join(rows)


def _first_values() -> str:
    rows = []
    for ord_, (cat, kws) in enumerate(FIRST_MATCH_RULES):
        for kw in kws:
            rows.append(f"({q(cat)}, {ord_}, {q(kw)})")
    return "values " + ", ".join(rows)


WRULES = f"wrules(cat, ord, kw, w10) as ({_weighted_values()})"
FRULES = f"frules(cat, ord, kw) as ({_first_values()})"


def weighted_cte(src: str, text_col: str = "descripcion", name: str = "scored") -> str:
    """Per distinct text: best category and score (tenths) via a rule join."""
    return f"""texts_{name} as (select distinct {text_col} as t, {norm_sql(text_col)} as nt from {src}),
catscore_{name} as (
  select t, r.cat, r.ord, sum(r.w10) as s from texts_{name} x join wrules r on contains(x.nt, r.kw)
  group by t, r.cat, r.ord),
best_{name} as (
  select t, cat, s from (select *, row_number() over (partition by t order by s desc, ord) as rk
                         from catscore_{name}) z where rk = 1),
{name} as (
  select x.t, coalesce(b.cat, {q(DEFAULT_CATEGORY)}) as categoria, cast(coalesce(b.s, 0) as integer) as s10
  from texts_{name} x left join best_{name} b on x.t = b.t)"""


def first_match_cte(src: str, text_col: str = "descripcion", name: str = "fm") -> str:
    return f"""ftexts_{name} as (select distinct {text_col} as t from {src}),
fhit_{name} as (select t, min(r.ord) as o from ftexts_{name} x join frules r on contains(lower(x.t), r.kw) group by t),
{name} as (
  select x.t, coalesce((select cat from frules f where f.ord = h.o limit 1), {q(DEFAULT_CATEGORY)}) as categoria
  from ftexts_{name} x left join fhit_{name} h on x.t = h.t)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


BASE = (RAW, TYPED, VALID, CLEAN)
# expenses + weighted category + confidence ("cat" view)
CAT = f"""cat as (
  select e.*, s.categoria, case when s.s10 > 0 then least(s.s10 / 50.0, 1.0) else 0.1 end as confidence,
    'rules' as method
  from expenses e join scored s on e.descripcion = s.t)"""
CAT_BASE = BASE + (WRULES, weighted_cte("expenses"), CAT)
