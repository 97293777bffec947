"""Futures queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from barsmith.operators import futures as FU
from barsmith.plans.registry import register

FUT = ["fx_fut_ticks"]
AS_OF = _dt.datetime(2024, 1, 25, 12, 0)
BASE_URL = "https://example.invalid/trading"

DAILY_SQL = """daily AS (SELECT root, symbol, CAST(datetime AS DATE) AS date,
  arg_max(expiry, (datetime, event_id)) FILTER (WHERE expiry IS NOT NULL) AS expiry,
  arg_max(last, (datetime, event_id)) FILTER (WHERE last IS NOT NULL) AS last
  FROM fx_fut_ticks GROUP BY root, symbol, CAST(datetime AS DATE)),
dd AS (SELECT *, last - lag(last) OVER (PARTITION BY root ORDER BY date, expiry, symbol) AS diff FROM daily),
c AS (SELECT root, expiry, max(date) AS max_day, row_number() OVER (PARTITION BY root ORDER BY expiry) AS k,
  count(*) OVER (PARTITION BY root) AS n FROM daily WHERE expiry IS NOT NULL GROUP BY root, expiry),
rec AS (SELECT root, k, n, expiry, CAST(NULL AS DATE) AS start_day, true AS present, expiry AS roll FROM c WHERE k = 1
  UNION ALL SELECT c.root, c.k, c.n, c.expiry, rec.roll, c.max_day > rec.roll,
    CASE WHEN c.max_day > rec.roll THEN c.expiry ELSE rec.roll END FROM rec JOIN c ON c.root = rec.root AND c.k = rec.k + 1),
cal AS (SELECT root, expiry, start_day, CASE WHEN k = n THEN NULL ELSE expiry END AS end_day, present FROM rec),
flags AS (SELECT dd.* FROM dd JOIN cal ON dd.root = cal.root AND dd.expiry = cal.expiry
  WHERE (cal.start_day IS NULL OR dd.date > cal.start_day) AND (cal.end_day IS NULL OR dd.date <= cal.end_day)),
ex AS (SELECT DISTINCT root, expiry AS E FROM dd WHERE expiry IS NOT NULL),
nx AS (SELECT ex.root, ex.E, (SELECT f.expiry FROM flags f WHERE f.root = ex.root AND f.date > ex.E ORDER BY f.date LIMIT 1) AS next_exp FROM ex),
gp AS (SELECT nx.root, nx.E, nx.next_exp, min(dd.diff) AS gap FROM nx JOIN dd ON dd.root = nx.root AND dd.date = nx.E AND dd.expiry = nx.next_exp
  GROUP BY nx.root, nx.E, nx.next_exp),
per AS (SELECT gp.root, gp.E, gp.gap FROM gp JOIN (SELECT root, max(E) AS E FROM gp GROUP BY root) m ON gp.root = m.root AND gp.E = m.E),
flags_g AS (SELECT f.*, CASE WHEN per.E IS NOT NULL AND f.date <= per.E THEN per.gap ELSE 0.0 END AS gap
  FROM flags f LEFT JOIN per ON f.root = per.root),
until AS (SELECT root, max(date) AS last_day FROM daily GROUP BY root),
rng AS (SELECT f.root, min(f.date) AS lo, max(u.last_day) AS last_day FROM flags_g f JOIN until u ON f.root = u.root GROUP BY f.root),
days AS (SELECT root, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(greatest(lo, last_day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM rng),
dense AS (SELECT d.root, d.date, f.symbol AS flag_symbol, f.expiry AS flag_expiry, f.gap FROM days d
  ASOF LEFT JOIN flags_g f ON d.root = f.root AND d.date >= f.date)"""


def fut_daily(spark):
    return FU.daily_last(spark.table("fx_fut_ticks"), ("root", "symbol"), "datetime", "event_id",
                         ["expiry", "last"])


@register("daily_last", dates=['date', 'expiry'], fixtures=FUT, sql="""
SELECT root, symbol, CAST(datetime AS DATE) AS date,
  arg_max(expiry, (datetime, event_id)) FILTER (WHERE expiry IS NOT NULL) AS expiry,
  arg_max(last, (datetime, event_id)) FILTER (WHERE last IS NOT NULL) AS last,
  arg_max(lastsize, (datetime, event_id)) FILTER (WHERE lastsize IS NOT NULL) AS lastsize
FROM fx_fut_ticks GROUP BY root, symbol, CAST(datetime AS DATE)
""")
def daily_last(spark):
    """Last non-null value of each column per contract and day."""
    return FU.daily_last(spark.table("fx_fut_ticks"), ("root", "symbol"), "datetime", "event_id",
                         ["expiry", "last", "lastsize"])


@register("daily_close_diff", dates=['date', 'expiry'], fixtures=FUT, sql=f"WITH RECURSIVE {DAILY_SQL} SELECT * FROM dd")
def daily_close_diff(spark):
    """Day-over-day difference across the interleaved contracts of a root."""
    return FU.daily_close_diff(fut_daily(spark), "last")


@register("roll_calendar", dates=['expiry', 'start_day', 'end_day'], fixtures=FUT, sql=f"WITH RECURSIVE {DAILY_SQL} SELECT * FROM cal")
def roll_calendar(spark):
    """The day range owned by each contract."""
    return FU.roll_calendar(fut_daily(spark))


@register("roll_gap", dates=['expiry', 'date'], fixtures=FUT, sql=f"WITH RECURSIVE {DAILY_SQL} SELECT * FROM flags_g")
def roll_gap(spark):
    """Flag rows (one per day) with the back-adjustment gap."""
    dd = FU.daily_close_diff(fut_daily(spark), "last")
    return FU.roll_gap(dd, FU.contract_flags(dd, FU.roll_calendar(fut_daily(spark))))


@register("asof_contract_flags", dates=['date', 'flag_expiry'], fixtures=FUT, sql=f"WITH RECURSIVE {DAILY_SQL} SELECT * FROM dense")
def asof_contract_flags(spark):
    """The flag in force on every calendar day."""
    daily = fut_daily(spark)
    dd = FU.daily_close_diff(daily, "last")
    flags = FU.roll_gap(dd, FU.contract_flags(dd, FU.roll_calendar(daily)))
    until = daily.groupBy("root").agg(F.max("date").alias("last_day"))
    return FU.asof_contract_flags(flags, until)


@register("continuous_contract", dates=['expiry'], fixtures=FUT, sql=f"""
WITH RECURSIVE {DAILY_SQL}
SELECT t.event_id, t.datetime, t.root, t.symbol, t.expiry, t.last + d.gap AS last, t.lastsize
FROM fx_fut_ticks t JOIN dense d ON t.root = d.root AND CAST(t.datetime AS DATE) = d.date
WHERE t.expiry = d.flag_expiry
""")
def continuous_contract(spark):
    """Back-adjusted continuous tick series per root."""
    return FU.continuous_contract(spark.table("fx_fut_ticks"), seq="event_id")


@register("volume_crossover", dates=['roll_date'], fixtures=FUT, sql="""
WITH d AS (SELECT root, symbol, expiry, CAST(datetime AS DATE) AS date, CAST(sum(lastsize) AS BIGINT) AS volume
  FROM fx_fut_ticks GROUP BY root, symbol, expiry, CAST(datetime AS DATE)),
cs AS (SELECT root, symbol, dense_rank() OVER (PARTITION BY root ORDER BY expiry, symbol) AS k FROM (SELECT DISTINCT root, symbol, expiry FROM d) x),
dk AS (SELECT d.*, cs.k FROM d JOIN cs ON d.root = cs.root AND d.symbol = cs.symbol)
SELECT a.root, a.symbol, b.symbol AS next_symbol, max(a.date) AS roll_date
FROM dk a JOIN dk b ON a.root = b.root AND a.date = b.date AND b.k = a.k + 1
WHERE b.volume > a.volume GROUP BY a.root, a.symbol, b.symbol
""")
def volume_crossover(spark):
    """Roll dates by volume crossover between adjacent contracts."""
    t = spark.table("fx_fut_ticks")
    d = t.groupBy("root", "symbol", "expiry", F.to_date("datetime").alias("date")) \
         .agg(F.sum("lastsize").cast("long").alias("volume"))
    return FU.volume_crossover(d)


ACTIVE_SQL = """s0 AS (SELECT root, listing_order, expiry, CAST(volume AS DOUBLE) AS volume,
  count(*) OVER (PARTITION BY root) AS n, row_number() OVER (PARTITION BY root ORDER BY listing_order) AS rn FROM fx_settlements),
s1 AS (SELECT * FROM s0 WHERE rn < n),
s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, expiry, volume ORDER BY listing_order DESC) AS d FROM s1) x WHERE d = 1),
s3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY listing_order) AS r FROM s2) x
  WHERE r <= 13 AND expiry IS NOT NULL AND volume IS NOT NULL AND expiry <> '202401'),
pick AS (SELECT root, max(volume) AS mv, arg_max(expiry, (volume, expiry)) AS top, arg_min(expiry, listing_order) AS first FROM s3 GROUP BY root),
act AS (SELECT r.root, coalesce(CASE WHEN p.mv > 100 THEN p.top ELSE p.first END, '202403') AS expiry,
  CASE WHEN p.root IS NULL THEN true ELSE false END AS is_fallback
  FROM (SELECT DISTINCT root FROM fx_settlements) r LEFT JOIN pick p ON r.root = p.root)"""


def active(spark, roots=None):
    return FU.active_contract(spark.table("fx_settlements"), roots, AS_OF)


@register("active_contract", fixtures=["fx_settlements"], sql=f"WITH {ACTIVE_SQL} SELECT * FROM act")
def active_contract(spark):
    """Most active contract month per root as of 2024-01-25 (after the
    third Friday: January is skipped, the fallback is two months out)."""
    return active(spark)


SPECS_SQL = """sp AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY listing_order) AS rn
  FROM fx_futures_specs) x WHERE rn = 1),
sp2 AS (SELECT listing_order, exchange, symbol, class, TRY_CAST(intraday_initial AS DOUBLE) AS ii, TRY_CAST(intraday_maintenance AS DOUBLE) AS im,
  TRY_CAST(overnight_initial AS DOUBLE) AS oi, TRY_CAST(overnight_maintenance AS DOUBLE) AS om, coalesce(currency, 'USD') AS currency FROM sp),
specs AS (SELECT listing_order, exchange, symbol, class, coalesce(ii, oi) AS intraday_initial,
  coalesce(im, coalesce(ii, oi)) AS intraday_maintenance, oi AS overnight_initial, coalesce(om, oi) AS overnight_maintenance, currency FROM sp2)"""


def specs(spark):
    return FU.clean_futures_specs(spark.table("fx_futures_specs"))


@register("clean_futures_specs", fixtures=["fx_futures_specs"], sql=f"WITH {SPECS_SQL} SELECT * FROM specs")
def clean_futures_specs(spark):
    """Cleaned margin table."""
    return specs(spark)


REQ_SQL = """req AS (
  SELECT DISTINCT 'sym:' || symbol AS req_id, symbol, CAST(NULL AS VARCHAR) AS exchange FROM fx_futures_specs
  UNION SELECT DISTINCT 'cls:' || class, class, CAST(NULL AS VARCHAR) FROM fx_futures_specs
  UNION SELECT DISTINCT 'xsym:' || exchange || ':' || symbol, symbol, exchange FROM fx_futures_specs
  UNION SELECT DISTINCT 'xcls:' || exchange || ':' || class, class, exchange FROM fx_futures_specs)"""


def requests(spark):
    s = spark.table("fx_futures_specs")
    nul = F.lit(None).cast("string")
    return (s.select(F.concat(F.lit("sym:"), "symbol").alias("req_id"), "symbol", nul.alias("exchange"))
            .union(s.select(F.concat(F.lit("cls:"), "class"), F.col("class"), nul))
            .union(s.select(F.concat(F.lit("xsym:"), "exchange", F.lit(":"), "symbol"), "symbol", "exchange"))
            .union(s.select(F.concat(F.lit("xcls:"), "exchange", F.lit(":"), "class"), F.col("class"), "exchange"))
            .distinct())


LOOKUP_SQL = """m AS (SELECT r.req_id, r.symbol AS rs, r.exchange AS rx, s.*, 'symbol' AS via FROM req r JOIN specs s ON upper(r.symbol) = s.symbol
  UNION ALL SELECT r.req_id, r.symbol, r.exchange, s.*, 'class' FROM req r JOIN specs s ON upper(r.symbol) = s.class),
agg AS (SELECT req_id, via, arg_min((exchange, symbol, class, currency), listing_order) AS first_any,
  count(*) FILTER (WHERE rx IS NOT NULL AND rx = exchange) AS nx,
  arg_min((exchange, symbol, class, currency), listing_order) FILTER (WHERE rx = exchange) AS first_x FROM m GROUP BY req_id, via),
res AS (SELECT r.req_id, r.symbol AS request_symbol, r.exchange AS request_exchange,
  CASE WHEN r.exchange IS NULL THEN coalesce(a1.first_any, a2.first_any)
       WHEN a1.nx = 1 THEN a1.first_x WHEN a2.nx = 1 THEN a2.first_x END AS s
  FROM req r LEFT JOIN agg a1 ON a1.req_id = r.req_id AND a1.via = 'symbol' LEFT JOIN agg a2 ON a2.req_id = r.req_id AND a2.via = 'class')"""


@register("futures_spec_lookup", fixtures=["fx_futures_specs"], sql=f"""
WITH {SPECS_SQL}, {REQ_SQL}, {LOOKUP_SQL}
SELECT req_id, request_symbol, request_exchange, s[1] AS spec_exchange, s[2] AS spec_symbol, s[3] AS spec_class, s[4] AS spec_currency FROM res
""")
def futures_spec_lookup(spark):
    """Spec lookup for every symbol / class, with and without exchange."""
    return FU.futures_spec_lookup(specs(spark), requests(spark))


@register("settlement_url", fixtures=["fx_futures_specs", "fx_catalog"], sql=f"""
WITH {REQ_SQL}
SELECT r.req_id, r.symbol, r.exchange, CASE WHEN c.url IS NOT NULL THEN '{BASE_URL}' || replace(c.url, '{{}}', 'quotes_settlements_futures') END AS url
FROM req r LEFT JOIN fx_catalog c ON upper(r.symbol) = upper(c.symbol)
""")
def settlement_url(spark):
    """Settlement page URL per requested symbol (NULL when unknown)."""
    return FU.settlement_url(requests(spark), spark.table("fx_catalog"), BASE_URL)


@register("futures_catalog_counts", fixtures=["fx_catalog"], sql="""
SELECT product_group, count(*) AS products FROM fx_catalog GROUP BY product_group
""")
def futures_catalog_counts(spark):
    """Products per catalogue group."""
    return FU.futures_catalog_counts(spark.table("fx_catalog"))


@register("resolve_contracts", fixtures=["fx_contracts", "fx_futures_specs", "fx_catalog", "fx_settlements"], sql=f"""
WITH {SPECS_SQL}, {ACTIVE_SQL},
inst AS (SELECT symbol AS instrument FROM fx_contracts
  UNION SELECT 'FUT.' || symbol FROM fx_catalog UNION SELECT 'fut.' || symbol || '.202406' FROM fx_catalog
  UNION SELECT 'FUT.' || class || '.202409' FROM fx_futures_specs),
n AS (SELECT instrument, upper(instrument) AS name, strpos(upper(instrument), 'FUT.') > 0 AS is_fut,
  string_split(upper(instrument), '.') AS parts FROM inst),
n2 AS (SELECT *, CASE WHEN is_fut THEN parts[2] END AS prod,
  CASE WHEN is_fut AND len(parts) = 3 AND parts[3] <> '' THEN parts[3] END AS exp FROM n),
req AS (SELECT DISTINCT name AS req_id, prod AS symbol, CAST(NULL AS VARCHAR) AS exchange FROM n2 WHERE is_fut),
{LOOKUP_SQL},
allact AS (SELECT root, expiry FROM act UNION ALL
  SELECT symbol, '202403' FROM fx_catalog WHERE symbol NOT IN (SELECT root FROM act)),
j AS (SELECT n2.*, k.symbol IS NOT NULL AS known, res.s, a.expiry AS active_exp FROM n2
  LEFT JOIN (SELECT upper(symbol) AS symbol FROM fx_catalog) k ON k.symbol = n2.prod
  LEFT JOIN res ON res.req_id = n2.name
  LEFT JOIN allact a ON upper(a.root) = n2.prod)
SELECT instrument,
  CASE WHEN is_fut THEN upper(s[2]) ELSE name END AS symbol,
  CASE WHEN is_fut THEN 'FUT' ELSE 'STK' END AS sec_type,
  CASE WHEN is_fut THEN upper(s[1]) ELSE 'SMART' END AS exchange,
  CASE WHEN is_fut THEN upper(s[4]) ELSE 'USD' END AS currency,
  CASE WHEN is_fut THEN CAST(TRY_CAST(coalesce(exp, active_exp) AS BIGINT) AS VARCHAR) ELSE '' END AS expiry,
  CAST(0.0 AS DOUBLE) AS strike, '' AS opt_type,
  CASE WHEN NOT is_fut THEN NULL WHEN NOT known THEN 'unsupported symbol' WHEN s IS NULL OR s[2] IS NULL THEN 'unparsable contract'
    WHEN TRY_CAST(coalesce(exp, active_exp) AS BIGINT) IS NULL THEN 'unparsable contract' END AS error
FROM j
""")
def resolve_contracts(spark):
    """Instrument names (stocks and FUT.<product>[.<expiry>]) to
    contract tuples, with the active month when no expiry is given."""
    c = spark.table("fx_contracts").select(F.col("symbol").alias("instrument"))
    cat = spark.table("fx_catalog")
    sp = spark.table("fx_futures_specs")
    inst = c.union(cat.select(F.concat(F.lit("FUT."), "symbol"))) \
            .union(cat.select(F.concat(F.lit("fut."), "symbol", F.lit(".202406")))) \
            .union(sp.select(F.concat(F.lit("FUT."), "class", F.lit(".202409")))).distinct()
    roots = spark.table("fx_settlements").select("root").union(cat.select(F.col("symbol").alias("root")))
    return FU.resolve_contracts(inst, cat, specs(spark), active(spark, roots))


@register("parse_settlement_text", fixtures=["fx_settlements"], sql="""
WITH r AS (SELECT root, listing_order,
  replace(upper(strftime(strptime(expiry, '%Y%m'), '%b %y')), 'JUL', 'JLY') AS month_text,
  format('{:,}', volume) AS volume_text FROM fx_settlements)
SELECT root, listing_order, month_text, volume_text,
  strftime(strptime(replace(month_text, 'JLY', 'JUL'), '%b %y'), '%Y%m') AS expiry,
  CAST(replace(volume_text, ',', '') AS DOUBLE) AS volume
FROM r
""")
def parse_settlement_text(spark):
    """settlement rows rendered as page text ('JLY 24', '1,234') and
    parsed back to YYYYMM and numbers."""
    from barsmith.functions.scalars import parse_contract_month, parse_thousands
    s = spark.table("fx_settlements")
    month = F.replace(F.upper(F.date_format(F.to_date("expiry", "yyyyMM"), "MMM yy")), F.lit("JUL"), F.lit("JLY"))
    r = s.select("root", "listing_order", month.alias("month_text"),
                 F.format_number("volume", 0).alias("volume_text"))
    return r.select("*", parse_contract_month("month_text").alias("expiry"),
                    parse_thousands("volume_text").alias("volume"))


#: the futures ticks with expiries that are not known: one contract of R1, two of R3, all of R2
SOME_EXPIRIES = """SELECT event_id, datetime, root, symbol,
  CASE WHEN root = 'R2' OR (root IN ('R1', 'R3') AND symbol LIKE '%F2024') OR (root = 'R3' AND symbol LIKE '%G2024') THEN NULL
    ELSE expiry END AS expiry, last, lastsize FROM fx_fut_ticks"""


@register("continuous_mixed", dates=["expiry"], fixtures=FUT, sql=f"""
WITH RECURSIVE t AS ({SOME_EXPIRIES}),
daily AS (SELECT root, symbol, CAST(datetime AS DATE) AS date, max(expiry) AS expiry,
  arg_max(last, (datetime, event_id)) FILTER (WHERE last IS NOT NULL) AS last, sum(lastsize) AS volume
  FROM t GROUP BY root, symbol, CAST(datetime AS DATE)),
cs AS (SELECT root, symbol, max(expiry) AS expiry, max(date) AS max_day,
  dense_rank() OVER (PARTITION BY root ORDER BY symbol) AS k, count(*) OVER (PARTITION BY root) AS n FROM daily GROUP BY root, symbol),
dk AS (SELECT d.root, d.symbol, d.date, d.last, d.volume, cs.k, d.last - lag(d.last) OVER (PARTITION BY d.root ORDER BY d.date, cs.k) AS diff
  FROM daily d JOIN cs USING (root, symbol)),
x AS (SELECT a.root, a.k, max(a.date) AS day FROM dk a JOIN dk b ON b.root = a.root AND b.date = a.date AND b.k = a.k + 1
  WHERE b.volume > a.volume GROUP BY a.root, a.k),
c AS (SELECT cs.*, coalesce(cs.expiry, x.day) AS own FROM cs LEFT JOIN x USING (root, k)),
rec AS (SELECT root, k, n, symbol, own, CAST(NULL AS DATE) AS start_day, own AS roll FROM c WHERE k = 1
  UNION ALL SELECT c.root, c.k, c.n, c.symbol, c.own, rec.roll,
    CASE WHEN NOT c.max_day > rec.roll THEN rec.roll WHEN c.own IS NULL THEN NULL ELSE greatest(rec.roll, c.own) END
  FROM rec JOIN c ON c.root = rec.root AND c.k = rec.k + 1 WHERE rec.roll IS NOT NULL),
flags AS (SELECT dk.* FROM dk JOIN rec USING (root, k)
  WHERE (rec.start_day IS NULL OR dk.date > rec.start_day) AND (rec.k = rec.n OR rec.own IS NULL OR dk.date <= rec.own)),
nx AS (SELECT e.root, e.E, (SELECT f.k FROM flags f WHERE f.root = e.root AND f.date > e.E ORDER BY f.date LIMIT 1) AS k
  FROM (SELECT DISTINCT root, own AS E FROM rec WHERE own IS NOT NULL) e),
g AS (SELECT nx.root, max(nx.E) AS E, arg_max(dk.diff, nx.E) AS gap FROM nx JOIN dk ON dk.root = nx.root AND dk.date = nx.E AND dk.k = nx.k
  GROUP BY nx.root),
fg AS (SELECT f.root, f.date, f.symbol, CASE WHEN g.E IS NOT NULL AND f.date <= g.E THEN g.gap ELSE 0 END AS gap FROM flags f LEFT JOIN g USING (root)),
days AS (SELECT root, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT f.root, min(f.date) AS lo, (SELECT max(date) FROM daily d WHERE d.root = f.root) AS hi FROM fg f GROUP BY f.root)),
dense AS (SELECT days.root, days.date, last_value(CASE WHEN fg.symbol IS NOT NULL THEN {{'symbol': fg.symbol, 'gap': fg.gap}} END IGNORE NULLS) OVER (
  PARTITION BY days.root ORDER BY days.date ROWS UNBOUNDED PRECEDING) AS f FROM days LEFT JOIN fg ON fg.root = days.root AND fg.date = days.date)
SELECT t.event_id, t.datetime, t.root, t.symbol, t.expiry, t.last + d.f.gap AS last, t.lastsize
FROM t JOIN dense d ON t.root = d.root AND CAST(t.datetime AS DATE) = d.date WHERE t.symbol = d.f.symbol
""")
def continuous_mixed(spark):
    """W8 + J6: contracts roll on their expiry, those without one by volume."""
    return FU.continuous_mixed(spark.sql(SOME_EXPIRIES), seq="event_id")
