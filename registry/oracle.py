"""Independent SQL for the registered queries, for DuckDB on the same tables.

Written directly from the definitions (plain distinct counts, window
functions, row-wise joins), so that it shares no shortcut with the Spark side.
"""

# Base tables as seen through the test tables, then one definition per level.
VIEWS = {
    "ride": """
        SELECT CAST(event_id AS VARCHAR) AS txid, CAST(user_id AS VARCHAR) AS rfid,
               event_type AS resort, regexp_extract(props, '"k": *([0-9]+)', 1) AS lift,
               ts AS ride_time,
               CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS INTEGER)
                   AS activation_day_count
        FROM events""",
    "season_pass": """
        SELECT 'P' || c_custkey AS txid, CAST(c_custkey AS VARCHAR) AS rfid,
               CAST(DATE '2024-01-01' + CAST(c_custkey % 10 AS INTEGER) AS TIMESTAMP)
                   AS purchase_time,
               CAST(CASE c_custkey % 4 WHEN 0 THEN 1051 WHEN 1 THEN 783 WHEN 2 THEN 537
                    ELSE 407 END AS DECIMAL(7, 2)) AS price_usd,
               CAST(DATE '2024-01-01' + CAST(c_custkey % 10 AS INTEGER) + 365 AS DATE)
                   AS expiration_time,
               c_name AS name,
               CASE WHEN c_custkey % 3 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') END
                   AS postalcode,
               CASE WHEN c_custkey % 5 <> 0 THEN '555-0' || c_custkey END AS phone,
               CASE WHEN c_custkey % 7 <> 0 THEN 'c' || c_custkey || '@example.com' END AS email,
               CASE WHEN c_custkey % 11 <> 0 THEN 'Contact ' || c_custkey END AS contact_name
        FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')""",
    "ticket": """
        SELECT 'T' || o_orderkey AS txid, CAST(c_custkey AS VARCHAR) AS rfid,
               CASE o_orderkey % 5 WHEN 0 THEN 'purchase' WHEN 1 THEN 'signup' WHEN 2 THEN 'view'
                    WHEN 3 THEN 'error' ELSE 'click' END AS resort,
               CAST(DATE '2024-01-01' + CAST(o_orderkey % 20 AS INTEGER) AS TIMESTAMP)
                   AS purchase_time,
               CAST((CAST(round(o_totalprice * 100) AS BIGINT) + 500) // 1000 / 100.0
                    AS DECIMAL(7, 2)) AS price_usd,
               CAST(DATE '2024-01-01' + CAST(o_orderkey % 20 + 2 * (1 + o_orderkey % 7) AS INTEGER)
                   AS DATE) AS expiration_time,
               CAST(1 + o_orderkey % 7 AS INTEGER) AS days,
               c_name AS name,
               CASE WHEN c_custkey % 3 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') END
                   AS postalcode,
               CASE WHEN c_custkey % 5 <> 0 THEN '555-0' || c_custkey END AS phone,
               CASE WHEN c_custkey % 7 <> 0 THEN 'c' || c_custkey || '@example.com' END AS email,
               CASE WHEN c_custkey % 11 <> 0 THEN 'Contact ' || c_custkey END AS contact_name
        FROM customer JOIN (
            SELECT * FROM orders QUALIFY row_number() OVER (
                PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
        ) ON c_custkey = o_custkey
        WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY')""",
    "capacity": """
        SELECT * FROM (VALUES
            ('purchase', 7, 2, 34, 'America/Denver'), ('signup', 5, 2, 25, 'America/Denver'),
            ('view', 6, 2, 35, 'America/Denver'), ('error', 4, 1, 21, 'America/Denver'),
            ('click', 5, 1, 27, 'America/Los_Angeles')
        ) t(resort, max_capacity, hourly_capacity, base_lift_count, iana_timezone)""",
    "first_ride": """
        SELECT resort, rfid, lift AS first_lift, ride_time AS first_ride_time,
               CAST(ride_time AS DATE) AS visit_date,
               activation_day_count AS activation_usage_count
        FROM ride QUALIFY row_number() OVER (
            PARTITION BY resort, rfid, CAST(ride_time AS DATE) ORDER BY ride_time, txid) = 1""",
    "visit": """
        SELECT f.visit_date, f.resort, f.rfid, coalesce(p.name, t.name) AS name,
               f.first_ride_time, f.first_lift, p.rfid IS NOT NULL AS has_season_pass,
               coalesce(p.price_usd, t.price_usd) AS purchase_price_usd,
               f.activation_usage_count, t.days AS ticket_original_duration
        FROM first_ride f LEFT JOIN season_pass p ON f.rfid = p.rfid
        LEFT JOIN ticket t ON f.rfid = t.rfid""",
    "activity": """
        SELECT visit_date AS ride_date, CAST(hour(ride_time) AS INTEGER) AS ride_hour,
               date_trunc('hour', ride_time) AS ride_hour_timestamp, resort,
               count(*) AS total_rides, count(DISTINCT rfid) AS visitor_count,
               count(DISTINCT rfid) FILTER (has_season_pass) AS active_passes,
               count(*) FILTER (has_season_pass) AS pass_rides
        FROM (SELECT *, CAST(ride_time AS DATE) AS visit_date FROM ride)
        LEFT JOIN visit USING (visit_date, resort, rfid) GROUP BY ALL""",
    "revenue": """
        SELECT visit_date AS ride_date, CAST(hour(first_ride_time) AS INTEGER) AS ride_hour,
               date_trunc('hour', first_ride_time) AS ride_hour_timestamp, resort,
               coalesce(sum(per_day) FILTER (NOT has_season_pass), 0) AS recognized_ticket_revenue,
               count(DISTINCT rfid) FILTER (NOT has_season_pass) AS ticket_activations,
               coalesce(sum(per_use) FILTER (has_season_pass AND activation_usage_count <= 20), 0)
                   AS recognized_pass_revenue,
               count(DISTINCT rfid) FILTER (has_season_pass) AS pass_activations
        FROM (SELECT *,
                CAST(CAST(purchase_price_usd AS DOUBLE) / greatest(ticket_original_duration, 1)
                     AS DECIMAL(18, 8)) AS per_day,
                CAST(CAST(purchase_price_usd AS DOUBLE) / 20 AS DECIMAL(18, 8)) AS per_use
              FROM visit) GROUP BY ALL""",
    "hourly": """
        SELECT *, visitor_count - active_passes AS active_tickets,
               total_rides - pass_rides AS ticket_rides,
               recognized_ticket_revenue + recognized_pass_revenue AS total_recognized_revenue,
               (2000 * visitor_count + max_capacity) // (2 * max_capacity) AS capacity_tenths,
               CASE WHEN 10 * visitor_count > 9 * max_capacity THEN 'HIGH'
                    WHEN 10 * visitor_count > 7 * max_capacity THEN 'MODERATE'
                    ELSE 'NORMAL' END AS capacity_status
        FROM (SELECT * REPLACE (coalesce(recognized_ticket_revenue, 0) AS recognized_ticket_revenue,
                                coalesce(recognized_pass_revenue, 0) AS recognized_pass_revenue)
              FROM activity
              LEFT JOIN revenue USING (ride_date, ride_hour, ride_hour_timestamp, resort)
              JOIN capacity USING (resort))""",
    "daily": """
        SELECT ride_date, resort,
               sum(visitor_count) AS total_visitor_hours,
               sum(total_rides) AS total_rides,
               sum(pass_rides) AS total_pass_rides,
               sum(ticket_rides) AS total_ticket_rides,
               sum(recognized_ticket_revenue) AS total_ticket_revenue,
               sum(recognized_pass_revenue) AS total_pass_revenue,
               sum(total_recognized_revenue) AS total_revenue,
               sum(ticket_activations) AS total_ticket_activations,
               sum(pass_activations) AS total_pass_activations,
               sum(ticket_activations) + sum(pass_activations) AS total_visitors,
               count(*) AS operation_hours, max(visitor_count) AS peak_hourly_visitors,
               max(capacity_tenths) AS peak_tenths,
               CAST((2 * sum(capacity_tenths) + count(*)) // (2 * count(*)) AS BIGINT) AS avg_tenths
        FROM hourly GROUP BY ALL""",
    "weekly": """
        SELECT CAST(date_trunc('week', ride_date) AS DATE) AS week_start_date, resort,
               sum(total_visitors) AS week_total_visitors,
               sum(total_rides) AS week_total_rides,
               sum(total_pass_rides) AS week_total_pass_rides,
               sum(total_ticket_rides) AS week_total_ticket_rides,
               sum(total_ticket_revenue) AS week_total_ticket_revenue,
               sum(total_pass_revenue) AS week_total_pass_revenue,
               sum(total_revenue) AS week_total_revenue,
               sum(total_ticket_activations) AS week_total_ticket_activations,
               sum(total_pass_activations) AS week_total_pass_activations,
               max(total_visitors) AS max_daily_unique_visitors,
               (2 * sum(total_visitors) + count(total_visitors)) // (2 * count(total_visitors))
                   AS avg_daily_unique_visitors,
               round(CAST(sum(total_revenue) AS DOUBLE) / count(total_revenue), 0)
                   AS avg_daily_revenue,
               (2 * sum(avg_tenths) + count(*)) // (2 * count(*)) AS avg_week_tenths,
               max(peak_tenths) AS week_peak_tenths, count(DISTINCT ride_date) AS operation_days
        FROM daily GROUP BY ALL""",
    "network": """
        SELECT ride_date, sum(total_visitors) AS total_network_visitors,
               sum(total_revenue) AS total_network_revenue,
               CAST((2 * sum(avg_tenths) + count(*)) // (2 * count(*)) AS BIGINT) AS network_tenths,
               sum(total_rides) AS total_network_rides, count(DISTINCT resort) AS active_resorts
        FROM daily GROUP BY 1""",
    "performance_900": """
        SELECT d.ride_date, d.resort, d.total_revenue, c.max_capacity * 630 AS target
        FROM daily d JOIN capacity c ON d.resort = c.resort""",
    "clock": """
        SELECT max(ride_hour_timestamp) AS reported, CAST(max(ride_hour_timestamp) AS DATE) AS today
        FROM hourly""",
    "media_expiry": """
        SELECT rfid, expiration_time FROM (
            SELECT rfid, expiration_time, purchase_time, txid FROM season_pass
            UNION ALL SELECT rfid, expiration_time, purchase_time, txid FROM ticket)
        QUALIFY row_number() OVER (PARTITION BY rfid ORDER BY purchase_time DESC, txid) = 1""",
    "period": """
        SELECT period, lo, hi, prev_lo, prev_hi FROM (
            SELECT 'Today' AS period, today AS lo, DATE '9999-12-31' AS hi,
                   today - 1 AS prev_lo, today AS prev_hi FROM clock
            UNION ALL SELECT 'Last 7 Days', today - 7, DATE '9999-12-31', today - 14, today - 7
            FROM clock
            UNION ALL SELECT 'Month to Date', CAST(date_trunc('month', today) AS DATE),
                   DATE '9999-12-31',
                   CAST(date_trunc('month', today) - INTERVAL 1 MONTH AS DATE),
                   CAST(date_trunc('month', today) AS DATE) FROM clock)""",
    "kpi": """
        SELECT p.period,
               sum(total_network_visitors) FILTER (ride_date >= lo) AS total_visitors,
               CAST(sum(total_network_revenue) FILTER (ride_date >= lo) AS DOUBLE) AS total_revenue,
               CAST(sum(CAST(network_tenths / 10.0 AS DECIMAL(9, 1))) FILTER (ride_date >= lo)
                    AS DOUBLE) / count(network_tenths) FILTER (ride_date >= lo) AS avg_capacity,
               sum(total_network_rides) FILTER (ride_date >= lo) AS total_rides,
               sum(total_network_visitors) FILTER (ride_date >= prev_lo AND ride_date < prev_hi)
                   AS prev_visitors,
               CAST(sum(total_network_revenue) FILTER (
                   ride_date >= prev_lo AND ride_date < prev_hi) AS DOUBLE) AS prev_revenue,
               sum(total_network_rides) FILTER (ride_date >= prev_lo AND ride_date < prev_hi)
                   AS prev_rides
        FROM network CROSS JOIN period p GROUP BY 1""",
    "recent": """
        SELECT txid, rfid, resort, lift, ride_time FROM ride
        WHERE resort = 'view' AND ride_time > (
            SELECT max(ride_time) FROM ride WHERE resort = 'view') - INTERVAL 1440 MINUTE""",
    "recent_as_of": """
        SELECT txid, rfid, resort, lift, ride_time FROM ride
        WHERE resort = 'view' AND ride_time <= TIMESTAMP '2024-01-15 12:00:00'
          AND ride_time > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1440 MINUTE""",
}

_USES = {
    "first_ride": ["ride"],
    "visit": ["first_ride", "season_pass", "ticket"],
    "activity": ["ride", "visit"],
    "revenue": ["visit"],
    "hourly": ["activity", "revenue", "capacity"],
    "daily": ["hourly"],
    "weekly": ["daily"],
    "network": ["daily"],
    "performance_900": ["daily", "capacity"],
    "clock": ["hourly"],
    "media_expiry": ["season_pass", "ticket"],
    "period": ["clock"],
    "kpi": ["network", "period"],
    "recent": ["ride"],
    "recent_as_of": ["ride"],
}


def _with(names: str, select: str) -> str:
    """``select`` behind the views it needs, in order of definition."""
    needed: set[str] = set()
    open_ = names.split()
    while open_:
        name = open_.pop()
        if name not in needed:
            needed.add(name)
            open_ += _USES.get(name, [])
    texts = [f"{name} AS MATERIALIZED ({text})" for name, text in VIEWS.items() if name in needed]
    return f"WITH {', '.join(texts)} {select}" if texts else select


def _tenths(column: str, alias: str) -> str:
    return f"CAST({column} AS DOUBLE) / 10 AS {alias}"


def _double(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


def _long(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


_HOURLY = f"""
    SELECT ride_date, ride_hour, ride_hour_timestamp, resort, visitor_count,
           {_long('total_rides', 'ticket_activations', 'pass_activations', 'active_passes',
                  'pass_rides', 'active_tickets', 'ticket_rides')},
           {_double('recognized_ticket_revenue', 'recognized_pass_revenue',
                    'total_recognized_revenue')},
           {_tenths('capacity_tenths', 'capacity_pct')}, capacity_status
    FROM hourly"""

_DAILY = f"""
    SELECT ride_date, resort, operation_hours,
           {_long('peak_hourly_visitors', 'total_visitor_hours', 'total_rides',
                  'total_ticket_activations', 'total_pass_activations', 'total_pass_rides',
                  'total_ticket_rides', 'total_visitors')},
           {_double('total_ticket_revenue', 'total_pass_revenue', 'total_revenue')},
           {_tenths('avg_tenths', 'avg_capacity_pct')},
           {_tenths('peak_tenths', 'peak_capacity_pct')} FROM daily"""

_WEEKLY = f"""
    SELECT week_start_date, resort,
           {_long('max_daily_unique_visitors', 'avg_daily_unique_visitors', 'week_total_visitors',
                  'week_total_rides', 'week_total_pass_rides', 'week_total_ticket_rides',
                  'week_total_ticket_activations', 'week_total_pass_activations',
                  'operation_days')},
           {_double('week_total_ticket_revenue', 'week_total_pass_revenue', 'week_total_revenue',
                    'avg_daily_revenue')},
           {_tenths('avg_week_tenths', 'avg_week_capacity_pct')},
           {_tenths('week_peak_tenths', 'week_peak_capacity_pct')}
    FROM weekly"""

_WEEKS = f"""
    SELECT week_start_date, {_long('max_daily_unique_visitors', 'avg_daily_unique_visitors')},
           {_double('week_total_revenue', 'avg_daily_revenue')},
           {_tenths('week_peak_tenths', 'week_peak_capacity_pct')}
    FROM weekly WHERE resort = 'view' ORDER BY week_start_date DESC LIMIT 4"""

_VISIT = """
    SELECT visit_date, resort, rfid, name, first_ride_time, first_lift, has_season_pass,
           CAST(purchase_price_usd AS DOUBLE) AS purchase_price_usd, activation_usage_count,
           ticket_original_duration
    FROM visit"""


def _lifts(window: str) -> str:
    return f"""
    SELECT resort, lift, rides, unique_visitors, first_activity_time, last_activity_time,
           CAST(row_number() OVER (PARTITION BY resort ORDER BY rides DESC, lift) AS INTEGER)
               AS usage_rank_in_resort,
           CAST(row_number() OVER (ORDER BY rides DESC, lift) AS INTEGER) AS overall_usage_rank,
           CASE WHEN span > 0 THEN CAST((1200 * rides + span) // (2 * span) AS DOUBLE) / 10 END
               AS rides_per_hour
    FROM (SELECT *, date_diff('minute', first_activity_time, last_activity_time) AS span FROM (
        SELECT resort, lift, count(*) AS rides, count(DISTINCT rfid) AS unique_visitors,
               min(ride_time) AS first_activity_time, max(ride_time) AS last_activity_time
        FROM {window} GROUP BY 1, 2))"""


_BAND = "CASE WHEN {0} < 700 THEN '{1}' WHEN {0} < 900 THEN '{2}' ELSE '{3}' END"
_MONEY = "'$' || format('{{:,}}', CAST(round_even(CAST({0} AS DOUBLE), 0) AS BIGINT))"
_NUMBER = "format('{{:,}}', CAST(round_even(CAST({0} AS DOUBLE), 0) AS BIGINT))"

_STATUS = """
    SELECT resort, CAST(sum(total_visitors) AS BIGINT) AS current_visitors,
           CAST(sum(CAST(avg_tenths / 10.0 AS DECIMAL(9, 1))) AS DOUBLE) / count(*) AS capacity_pct,
           CAST(sum(total_revenue) AS DOUBLE) AS revenue
    FROM daily WHERE ride_date >= (SELECT lo FROM period WHERE period = '{0}') GROUP BY resort"""
_STATUS_LABEL = """CASE WHEN capacity_pct < 70 THEN '🟢 Normal'
    WHEN capacity_pct < 90 THEN '🟡 Busy' ELSE '🔴 At Capacity' END"""

_CHANGE = """CASE WHEN {1} > 0 THEN printf('%+.1f%%', CAST({0} - {1} AS DOUBLE) / {1} * 100)
    ELSE '+0.0%' END"""

# Parts of a sale as JSON text; the contact fields follow from the customer key.
_SALE = """'","PURCHASE_TIME":"' || strftime(purchase_time, '%Y-%m-%dT%H:%M:%S.%f+00:00')
    || '","PRICE_USD":' || price_usd
    || ',"EXPIRATION_TIME":"' || strftime(expiration_time, '%Y-%m-%dT00:00:00+00:00') || '"'"""
_NAME = '"NAME":"'
_CONTACT = """name || '","ADDRESS":'
    || coalesce('{"STREET_ADDRESS":"' || rfid || ' Main Street","CITY":"Springfield","STATE":"CO",'
                || '"POSTALCODE":"' || postalcode || '"}', 'null')
    || ',"PHONE":' || coalesce('"' || phone || '"', 'null')
    || ',"EMAIL":' || coalesce('"' || email || '"', 'null')
    || ',"EMERGENCY_CONTACT":'
    || coalesce('{"NAME":"' || contact_name || '","PHONE":"555-1' || rfid || '"}', 'null')
    || '}'"""

_EVENTS = "SELECT event_id, ts, user_id, event_type FROM events"

ORACLE = {
    "read_after": f"{_EVENTS} WHERE event_id > 1234 ORDER BY event_id LIMIT 10000",
    "retain_after": f"{_EVENTS} WHERE event_id > 4999",
    "preview": f"{_EVENTS} ORDER BY event_id LIMIT 20",
    "site_capacity": _with(
        "capacity",
        """SELECT resort, max_capacity, hourly_capacity, base_lift_count, iana_timezone
           FROM capacity WHERE resort IN (SELECT event_type FROM events)"""),
    "json_rides": _with("ride", "SELECT * FROM ride"),
    "json_tickets": _with("ticket", "SELECT * REPLACE (CAST(price_usd AS DOUBLE) AS price_usd) FROM ticket"),
    "period_current": _with(
        "daily period",
        """SELECT ride_date, resort, CAST(total_rides AS BIGINT) AS total_rides, period
           FROM daily JOIN period ON ride_date >= lo"""),
    "period_previous": _with(
        "daily period",
        """SELECT ride_date, resort, CAST(total_rides AS BIGINT) AS total_rides, period
           FROM daily JOIN period ON ride_date >= prev_lo AND ride_date < prev_hi"""),
    "trailing_window": _with("recent", "SELECT * FROM recent"),
    "capacity_band": _with(
        "hourly",
        "SELECT ride_date, ride_hour, resort, visitor_count, capacity_status FROM hourly"),
    "target_status": _with(
        "performance_900",
        """SELECT resort, performance_status, icon, count(*) AS days FROM (
             SELECT resort,
               CASE WHEN total_revenue >= target THEN 'ABOVE_TARGET'
                    WHEN 100 * total_revenue >= 90 * target THEN 'NEAR_TARGET'
                    ELSE 'BELOW_TARGET' END AS performance_status,
               CASE WHEN total_revenue >= target THEN '🟢'
                    WHEN 100 * total_revenue >= 90 * target THEN '🟡' ELSE '🔴' END AS icon
             FROM performance_900) GROUP BY 1, 2, 3"""),
    "site_status": _with(
        "daily",
        f"""SELECT ride_date, resort, {_tenths('avg_tenths', 'avg_capacity_pct')},
               {_BAND.format('avg_tenths', '🟢 Normal', '🟡 Busy', '🔴 At Capacity')} AS status,
               {_BAND.format('avg_tenths', '🟢', '🟡', '🔴')} AS icon FROM daily"""),
    "distinct_sites": _with("daily", "SELECT DISTINCT resort FROM daily"),
    "time_functions": _with(
        "ride",
        """SELECT txid, CAST(ride_time AS DATE) AS ride_date,
               CAST(hour(ride_time) AS INTEGER) AS ride_hour,
               date_trunc('hour', ride_time) AS hour_start,
               CAST(date_trunc('week', ride_time) AS DATE) AS week_start,
               ride_time - INTERVAL 30 MINUTE AS half_hour_earlier,
               CAST(ride_time AS DATE) - 14 AS two_weeks_ago,
               CAST(date_trunc('month', ride_time) AS DATE) AS month_start,
               CAST(date_trunc('month', ride_time) - INTERVAL 1 MONTH AS DATE) AS prev_month_start
           FROM ride"""),
    "local_time": _with(
        "ride capacity",
        """SELECT txid, resort, local_time, CAST(hour(local_time) AS INTEGER) AS local_hour FROM (
               SELECT txid, r.resort,
                      (ride_time AT TIME ZONE 'UTC') AT TIME ZONE iana_timezone AS local_time
               FROM ride r JOIN capacity c ON r.resort = c.resort)"""),
    "minutes_between": _with(
        "ride",
        """SELECT rfid, date_diff('minute', min(ride_time), max(ride_time)) AS minutes
           FROM ride GROUP BY 1"""),
    "pct_change": _with(
        "ride",
        """SELECT ride_date, resort, rides, prev_rides,
               CASE WHEN prev_rides > 0
                    THEN CAST(rides - prev_rides AS DOUBLE) / prev_rides * 100 ELSE 0.0 END
                    AS change_pct
           FROM (SELECT d.ride_date, d.resort, d.rides, b.rides AS prev_rides FROM
               (SELECT CAST(ride_time AS DATE) AS ride_date, resort, count(*) AS rides
                FROM ride GROUP BY 1, 2) d LEFT JOIN
               (SELECT CAST(ride_time AS DATE) AS ride_date, resort, count(*) AS rides
                FROM ride GROUP BY 1, 2) b
               ON d.resort = b.resort AND d.ride_date = b.ride_date + 1)"""),
    "pass_enrich": _with(
        "first_ride season_pass",
        """SELECT f.*, p.name AS pass_name, CAST(p.price_usd AS DOUBLE) AS pass_price,
               CASE WHEN p.rfid IS NOT NULL THEN true END AS is_pass
           FROM first_ride f LEFT JOIN season_pass p ON f.rfid = p.rfid"""),
    "ticket_enrich": _with(
        "first_ride ticket",
        """SELECT f.*, t.name AS ticket_name, CAST(t.price_usd AS DOUBLE) AS ticket_price,
               t.days AS ticket_days
           FROM first_ride f LEFT JOIN ticket t ON f.rfid = t.rfid"""),
    "visit_anti_join": _with(
        "first_ride",
        """SELECT visit_date, resort, rfid, first_ride_time FROM first_ride f WHERE NOT EXISTS (
               SELECT 1 FROM first_ride k WHERE k.visit_date < DATE '2024-01-16'
                 AND k.visit_date = f.visit_date AND k.resort = f.resort AND k.rfid = f.rfid)"""),
    "ride_visit_join": _with(
        "ride visit",
        """SELECT CAST(r.ride_time AS DATE) AS ride_date,
               CAST(hour(r.ride_time) AS INTEGER) AS ride_hour, r.resort, r.rfid,
               count(*) AS rides, v.has_season_pass
           FROM ride r LEFT JOIN visit v ON r.rfid = v.rfid AND r.resort = v.resort
                AND CAST(r.ride_time AS DATE) = v.visit_date
           GROUP BY ALL"""),
    "activity_revenue_join": _with(
        "activity revenue",
        f"""SELECT a.*, {_double('recognized_ticket_revenue', 'recognized_pass_revenue')},
               ticket_activations, pass_activations
            FROM activity a LEFT JOIN revenue r ON a.ride_date = r.ride_date
                 AND a.ride_hour = r.ride_hour AND a.resort = r.resort"""),
    "capacity_join": _with(
        "activity capacity",
        """SELECT a.*, c.max_capacity, c.hourly_capacity, c.base_lift_count, c.iana_timezone
           FROM activity a JOIN capacity c ON a.resort = c.resort"""),
    "scalar_max_join": _with(
        "ride",
        """SELECT txid, ride_time, last_ride_time FROM ride CROSS JOIN (
               SELECT max(ride_time) AS last_ride_time FROM ride WHERE resort = 'view')
           WHERE resort = 'view'"""),
    "first_per_day": _with("first_ride", "SELECT * FROM first_ride"),
    "daily_visits": _with("visit", _VISIT),
    "repaired_visits": _with("visit", _VISIT),
    "hourly_activity": _with("activity", "SELECT * FROM activity"),
    "hourly_revenue": _with(
        "revenue",
        f"""SELECT ride_date, ride_hour, ride_hour_timestamp, resort, ticket_activations,
               pass_activations,
               {_double('recognized_ticket_revenue', 'recognized_pass_revenue')} FROM revenue"""),
    "hourly_summary": _with("hourly", _HOURLY),
    "hourly_summary_joined": _with("hourly", _HOURLY),
    "visitor_hours": _with(
        "ride",
        """SELECT CAST(ride_time AS DATE) AS ride_date, CAST(hour(ride_time) AS INTEGER) AS ride_hour,
               resort, rfid, ride_time, txid, lift, activation_day_count,
               CAST(hour(ride_time) // 6 AS INTEGER) AS ride_block,
               count(*) OVER (PARTITION BY resort, rfid, date_trunc('hour', ride_time)) AS rides
           FROM ride QUALIFY row_number() OVER (
               PARTITION BY resort, rfid, date_trunc('hour', ride_time)
               ORDER BY ride_time, txid) = 1"""),
    "daily_summary": _with("daily", _DAILY),
    "weekly_summary": _with("weekly", _WEEKLY),
    "weekly_summary_sql": _with("weekly", _WEEKLY),
    "revenue_performance": _with(
        "performance_900",
        """SELECT ride_date, resort, CAST(total_revenue AS DOUBLE) AS total_revenue,
               CAST(target AS DOUBLE) AS revenue_target_usd,
               round(CAST(total_revenue AS DOUBLE) * 100 / target, 1) AS revenue_target_pct,
               CASE WHEN total_revenue >= target THEN 'ABOVE_TARGET'
                    WHEN 100 * total_revenue >= 90 * target THEN 'NEAR_TARGET'
                    ELSE 'BELOW_TARGET' END AS performance_status
           FROM performance_900"""),
    "network_daily": _with(
        "network",
        f"""SELECT ride_date, active_resorts, {_long('total_network_visitors',
               'total_network_rides')}, {_double('total_network_revenue')},
               {_tenths('network_tenths', 'avg_network_capacity_pct')} FROM network"""),
    "lift_performance": _with("recent", _lifts("recent")),
    "lift_performance_as_of": _with("recent_as_of", _lifts("recent_as_of")),
    "lift_function": _with("recent", _lifts("recent")),
    "lift_function_as_of": _with("recent_as_of", _lifts("recent_as_of")),
    "lift_top10": _with(
        "recent", f"SELECT * FROM ({_lifts('recent')}) WHERE usage_rank_in_resort <= 10"),
    "lift_board": _with(
        "recent",
        f"""SELECT usage_rank_in_resort,
               CASE usage_rank_in_resort WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉'
                    ELSE CAST(usage_rank_in_resort AS VARCHAR) END AS medal,
               lift, rides, unique_visitors, rides_per_hour,
               CAST(rides AS DOUBLE) / max(rides) OVER () AS share_of_max,
               CASE WHEN rides_per_hour > 200 THEN 'Hot' WHEN rides_per_hour > 100 THEN 'Active'
                    ELSE 'Normal' END AS activity_level,
               CASE WHEN rides_per_hour > 200 THEN '🔥' WHEN rides_per_hour > 100 THEN '⚡'
                    ELSE '🟢' END AS activity_icon
            FROM ({_lifts('recent')}) WHERE usage_rank_in_resort <= 10"""),
    "share_of_max": _with(
        "ride",
        """SELECT resort, lift, rides,
               CAST(rides AS DOUBLE) / max(rides) OVER (PARTITION BY resort) AS share_of_max
           FROM (SELECT resort, lift, count(*) AS rides FROM ride GROUP BY 1, 2)"""),
    "latest_hours": _with(
        "hourly", f"{_HOURLY} ORDER BY ride_hour_timestamp DESC, resort LIMIT 100"),
    "latest_weeks": _with("weekly", _WEEKS),
    "weeks_table": _with(
        "weekly",
        f"""SELECT strftime(week_start_date, '%Y-%m-%d') AS "Week Starting",
               {_NUMBER.format('max_daily_unique_visitors')} AS "Max Daily Visitors",
               {_NUMBER.format('avg_daily_unique_visitors')} AS "Avg Daily Visitors",
               {_MONEY.format('week_total_revenue')} AS "Total Revenue",
               {_MONEY.format('avg_daily_revenue')} AS "Avg Daily Revenue",
               printf('%.1f%%', week_peak_capacity_pct) AS "Peak Capacity" FROM ({_WEEKS})"""),
    "reporting_clock": _with(
        "ride season_pass ticket clock",
        """SELECT greatest((SELECT max(ride_time) FROM ride),
                           (SELECT max(purchase_time) FROM season_pass),
                           (SELECT max(purchase_time) FROM ticket)) AS latest_world_timestamp,
               reported AS latest_reporting_timestamp, today AS "current_date",
               CAST(hour(reported) AS INTEGER) AS current_hour, today - 1 AS yesterday,
               today - 7 AS week_ago, today - 14 AS two_weeks_ago,
               CAST(date_trunc('month', today) AS DATE) AS month_start,
               CAST(date_trunc('month', today) - INTERVAL 1 MONTH AS DATE) AS prev_month_start
           FROM clock"""),
    "site_clock": _with(
        "hourly",
        """SELECT max(ride_hour_timestamp) AS reporting_time,
               CAST(max(ride_hour_timestamp) AS DATE) AS reporting_date,
               CAST(hour(max(ride_hour_timestamp)) AS INTEGER) AS reporting_hour
           FROM hourly WHERE resort = 'view'"""),
    "clock_line": _with(
        "ride season_pass ticket hourly capacity",
        """SELECT resort, strftime((reported AT TIME ZONE 'UTC') AT TIME ZONE time_zone,
                   '%A, %m/%d/%y %I:%M:%S %p') AS reporting_time,
               strftime((world AT TIME ZONE 'UTC') AT TIME ZONE time_zone,
                   '%A, %m/%d/%y %I:%M:%S %p') AS latest_event, time_zone
           FROM (SELECT resort, iana_timezone AS time_zone,
                   (SELECT max(ride_hour_timestamp) FROM hourly WHERE resort = 'click') AS reported,
                   greatest((SELECT max(ride_time) FROM ride),
                            (SELECT max(purchase_time) FROM season_pass),
                            (SELECT max(purchase_time) FROM ticket)) AS world
                 FROM capacity WHERE resort = 'click')"""),
    "network_kpis": _with(
        "kpi",
        f"""SELECT period, {_long('total_visitors', 'total_rides', 'prev_visitors', 'prev_rides')},
               total_revenue, avg_capacity, prev_revenue,
               CASE WHEN prev_visitors > 0 THEN CAST(total_visitors - prev_visitors AS DOUBLE)
                    / CAST(prev_visitors AS DOUBLE) * 100 ELSE 0.0 END AS visitor_change_pct,
               CASE WHEN prev_revenue > 0 THEN (total_revenue - prev_revenue) / prev_revenue * 100
                    ELSE 0.0 END AS revenue_change_pct,
               CASE WHEN prev_rides > 0 THEN CAST(total_rides - prev_rides AS DOUBLE)
                    / CAST(prev_rides AS DOUBLE) * 100 ELSE 0.0 END AS rides_change_pct
            FROM kpi"""),
    "site_comparison": _with(
        "daily period",
        """SELECT period, resort, CAST(sum(total_visitors) AS BIGINT) AS total_visitors,
               CAST(sum(total_revenue) AS DOUBLE) AS total_revenue,
               CAST(sum(CAST(avg_tenths / 10.0 AS DECIMAL(9, 1))) AS DOUBLE) / count(*)
                   AS avg_capacity,
               CAST(sum(total_rides) AS BIGINT) AS total_rides
           FROM daily JOIN period ON ride_date >= lo AND (period <> 'Today' OR ride_date = lo)
           GROUP BY period, resort"""),
    "site_time_series": _with(
        "daily period",
        f"""SELECT period, ride_date, resort, CAST(total_visitors AS BIGINT) AS visitors,
               CAST(total_revenue AS DOUBLE) AS revenue, {_tenths('avg_tenths', 'capacity_pct')}
            FROM daily JOIN period ON ride_date >= lo AND (period <> 'Today' OR ride_date = lo)"""),
    "site_status_report": _with(
        "daily period",
        " UNION ALL ".join(
            f"SELECT *, {_STATUS_LABEL} AS status, '{name}' AS period FROM ({_STATUS.format(name)})"
            for name in ("Today", "Last 7 Days", "Month to Date"))),
    "display_status": _with(
        "daily period",
        f"""SELECT resort AS "Resort", {_NUMBER.format('current_visitors')} AS "Visitors",
               printf('%.1f%%', capacity_pct) AS "Capacity", {_MONEY.format('revenue')} AS "Revenue",
               {_STATUS_LABEL} AS "Status" FROM ({_STATUS.format('Last 7 Days')})"""),
    "site_operations": _with(
        "hourly",
        f"""SELECT visitor_count AS current_visitors,
               {_tenths('capacity_tenths', 'current_capacity_pct')},
               total_rides AS current_hour_rides,
               CAST(total_recognized_revenue AS DOUBLE) AS current_hour_revenue, capacity_status
            FROM hourly WHERE resort = 'view' AND ride_hour_timestamp = (
                SELECT max(ride_hour_timestamp) FROM hourly WHERE resort = 'view')"""),
    "hourly_pattern_local": _with(
        "hourly",
        f"""SELECT CAST(hour(local_time) AS INTEGER) AS ride_hour,
               CAST(local_time AS DATE) AS ride_date, ride_hour_timestamp, visitor_count,
               {_tenths('capacity_tenths', 'capacity_pct')},
               {_double('total_recognized_revenue')}
            FROM (SELECT *, (ride_hour_timestamp AT TIME ZONE 'UTC') AT TIME ZONE iana_timezone
                      AS local_time
                  FROM hourly WHERE resort = 'click' AND ride_date = (
                      SELECT max(ride_date) FROM hourly WHERE resort = 'click'))"""),
    "site_revenue_today": _with(
        "performance_900",
        """SELECT CAST(total_revenue AS DOUBLE) AS total_revenue,
               CAST(target AS DOUBLE) AS revenue_target_usd,
               round(CAST(total_revenue AS DOUBLE) * 100 / target, 1) AS revenue_target_pct,
               CASE WHEN total_revenue >= target THEN 'ABOVE_TARGET'
                    WHEN 100 * total_revenue >= 90 * target THEN 'NEAR_TARGET'
                    ELSE 'BELOW_TARGET' END AS performance_status
           FROM performance_900 WHERE resort = 'view' AND ride_date = (
               SELECT max(ride_date) FROM performance_900 WHERE resort = 'view')"""),
    "activation_day": _with("ride", "SELECT txid, rfid, activation_day_count FROM ride"),
    "rides_after_expiry": _with(
        "ride media_expiry",
        """SELECT r.rfid, txid, resort, lift, ride_time, expiration_time
           FROM ride r JOIN media_expiry m ON r.rfid = m.rfid
           WHERE CAST(ride_time AS DATE) > expiration_time"""),
    "overused_tickets": _with(
        "ride ticket",
        """SELECT t.rfid, t.days, count(DISTINCT CAST(ride_time AS DATE)) AS days_used
           FROM ride r JOIN ticket t ON r.rfid = t.rfid GROUP BY 1, 2
           HAVING count(DISTINCT CAST(ride_time AS DATE)) > t.days"""),
    "rides_outside_hours": _with(
        "ride capacity",
        """SELECT * FROM (
               SELECT txid, r.resort, ride_time,
                      (ride_time AT TIME ZONE 'UTC') AT TIME ZONE iana_timezone AS local_time
               FROM ride r JOIN capacity c ON r.resort = c.resort)
           WHERE hour(local_time) < 8 OR hour(local_time) >= 16"""),
    "ride_gaps": _with(
        "ride",
        """SELECT txid, rfid, ride_time, previous_ride_time, gap_seconds,
               coalesce(gap_seconds < 600, false) AS too_fast,
               coalesce(gap_seconds >= 1800, false) AS rested
           FROM (SELECT *, CAST(epoch_us(ride_time) - epoch_us(previous_ride_time) AS DOUBLE)
                     / 1000000 AS gap_seconds
                 FROM (SELECT *, lag(ride_time) OVER (PARTITION BY rfid ORDER BY ride_time, txid)
                       AS previous_ride_time FROM ride))"""),
    "price_band": _with(
        "ticket",
        """SELECT txid, resort, days, CAST(price_usd AS DOUBLE) AS price_usd,
               CAST(low AS DOUBLE) AS lowest_price, CAST(high AS DOUBLE) / 1000 AS highest_price,
               price_usd >= low AND price_usd * 1000 <= high AS in_band
           FROM (SELECT *, (tenths * 900) // 10000 AS low, tenths * 110 AS high FROM (
               SELECT t.*, coalesce(base, 100) * days
                      * CASE WHEN isodow(purchase_time) >= 6 THEN coalesce(weekend, 15) ELSE 10 END
                      AS tenths
               FROM ticket t LEFT JOIN (VALUES ('purchase', 60, 16), ('signup', 55, 15),
                    ('view', 50, 17), ('error', 45, 16)) p(resort, base, weekend)
                    ON t.resort = p.resort))"""),
    "price_tier_share": _with(
        "season_pass",
        """SELECT CAST(price_usd AS DOUBLE) AS price_usd, count(*) AS sales,
               CAST(count(*) AS DOUBLE) * 100 / CAST((SELECT count(*) FROM season_pass) AS DOUBLE)
                   AS share_pct
           FROM season_pass GROUP BY 1"""),
    "active_media": _with(
        "season_pass ticket",
        """SELECT txid, rfid, expiration_time FROM (
               SELECT txid, rfid, expiration_time FROM ticket
               UNION ALL SELECT txid, rfid, expiration_time FROM season_pass)
           WHERE expiration_time >= DATE '2024-01-15'"""),
    "ingest_throughput": _with(
        "ride season_pass ticket",
        """SELECT source, date_trunc('hour', t) AS hour, count(*) AS row_count,
               CAST(count(*) AS DOUBLE) / 3600 AS rows_per_second
           FROM (SELECT 'lift_ride' AS source, ride_time AS t FROM ride
                 UNION ALL SELECT 'season_pass', purchase_time FROM season_pass
                 UNION ALL SELECT 'resort_ticket', purchase_time FROM ticket)
           GROUP BY 1, 2"""),
    "null_profile": _with(
        "season_pass ticket",
        """SELECT source, count(*) AS row_count,
               CAST(count(*) - count(postalcode) AS DOUBLE) / count(*) AS address_null_share,
               CAST(count(*) - count(phone) AS DOUBLE) / count(*) AS phone_null_share,
               CAST(count(*) - count(email) AS DOUBLE) / count(*) AS email_null_share,
               CAST(count(*) - count(contact_name) AS DOUBLE) / count(*)
                   AS emergency_contact_null_share
           FROM (SELECT 'season_pass' AS source, postalcode, phone, email, contact_name
                 FROM season_pass
                 UNION ALL SELECT 'resort_ticket', postalcode, phone, email, contact_name
                 FROM ticket)
           GROUP BY 1"""),
    "stream_visits": _with("visit", _VISIT),
    "stream_visits_first_writer": _with("visit", _VISIT),
    "stream_redelivered": _with("daily", _DAILY),
    "stream_paused": _with(
        "daily",
        """SELECT count(*) AS days, CAST(sum(total_rides) AS BIGINT) AS rides,
               'new,running,stopped,new,running,stopped,new,running,stopped' AS states FROM daily"""),
    "ingest_archived": _with(
        "ride",
        """SELECT txid, rfid, ride_time, CAST(NULL AS VARCHAR) AS rejected FROM ride
           UNION ALL SELECT NULL, NULL, NULL, '{' || txid FROM ride"""),
    "purged_buffer": """
        SELECT event_id, user_id, event_type || ':' || CAST(user_id % 3 AS VARCHAR) AS part
        FROM events WHERE event_id > 400""",
    "buffered_batch": """
        SELECT event_id, user_id, event_type || ':' || CAST(user_id % 3 AS VARCHAR) AS part
        FROM events WHERE event_id > 650 ORDER BY event_id LIMIT 1000""",
    "stream_versions": _with(
        "daily",
        """SELECT version, count(*) AS days, CAST(sum(total_rides) AS BIGINT) AS rides
           FROM daily, (VALUES (1, DATE '2024-01-08'), (2, DATE '2024-01-22'), (3, DATE '9999-12-31'))
                v(version, before) WHERE ride_date < before GROUP BY version"""),
    "stream_out_of_order": _with("hourly", _HOURLY),
    "stream_late_sales": _with("visit", _VISIT),
    "key_filter": _with(
        "ride",
        """SELECT CAST(ride_time AS DATE) AS ride_date, CAST(hour(ride_time) // 6 AS INTEGER) AS ride_block,
               count(*) AS rides, CAST(0 AS BIGINT) AS missed, true AS few_others
           FROM ride GROUP BY 1, 2"""),
    "appended_visits": _with("visit", _VISIT),
    "refresh_log": _with(
        "ride visit hourly daily weekly",
        """SELECT target, 3 AS refreshes, row_count, partitions,
               CAST((SELECT count(*) FROM ride) AS BIGINT) AS input_rows FROM (
               SELECT 'lift_ride' AS target, count(*) AS row_count,
                   count(DISTINCT (CAST(ride_time AS DATE), hour(ride_time) // 6)) AS partitions FROM ride
               UNION ALL SELECT 'visitor_hours', count(*), count(DISTINCT (day, block))
               FROM (SELECT DISTINCT rfid, resort, CAST(ride_time AS DATE) AS day,
                         hour(ride_time) AS hour, hour(ride_time) // 6 AS block FROM ride)
               UNION ALL SELECT 'daily_visits', count(*), count(DISTINCT visit_date) FROM visit
               UNION ALL SELECT 'hourly_resort_summary', count(*), count(DISTINCT ride_date) FROM hourly
               UNION ALL SELECT 'daily_resort_summary', count(*), count(DISTINCT ride_date) FROM daily
               UNION ALL SELECT 'weekly_resort_summary', count(*), count(DISTINCT week_start_date)
               FROM weekly)"""),
    "stream_hours_approx": _with(
        "ride",
        """SELECT date_trunc('hour', ride_time) AS ride_hour_timestamp, resort,
               count(*) AS total_rides, true AS visitors_near FROM ride GROUP BY 1, 2"""),
    "input_log": """
        SELECT CAST(4 AS BIGINT) AS batches, CAST(count(*) AS BIGINT) AS input_rows,
               CAST(0 AS BIGINT) AS without_offset FROM events""",
    "unique_visitors": _with(
        "ride",
        """SELECT 'day' AS level, CAST(ride_time AS DATE) AS start_date, resort,
               count(DISTINCT rfid) AS visitors, true AS near FROM ride GROUP BY 2, 3
           UNION ALL SELECT 'week', CAST(date_trunc('week', ride_time) AS DATE), resort,
               count(DISTINCT rfid), true FROM ride GROUP BY 2, 3
           UNION ALL SELECT 'network', CAST(date_trunc('week', ride_time) AS DATE), NULL,
               count(DISTINCT rfid), true FROM ride GROUP BY 2"""),
    "stream_hours_exact": _with(
        "ride",
        """SELECT date_trunc('hour', ride_time) AS ride_hour_timestamp, resort,
               count(*) AS total_rides, count(DISTINCT rfid) AS visitor_count FROM ride GROUP BY 1, 2"""),
    "stream_hours": _with("hourly", _HOURLY),
    "stream_refresh": _with("weekly", _WEEKLY),
    "stream_dedup": _with(
        "ride", "SELECT * REPLACE (CAST(NULL AS INTEGER) AS activation_day_count) FROM ride"),
    "revenue_card": _with(
        "daily capacity",
        f"""SELECT {_MONEY.format('total_revenue')} AS revenue, {_MONEY.format('target')} AS target,
               printf('%.1f%%', round(CAST(total_revenue AS DOUBLE) * 100 / target, 1)) || ' '
               || CASE WHEN total_revenue >= target THEN '🟢'
                       WHEN 100 * total_revenue >= 90 * target THEN '🟡' ELSE '🔴' END
                   AS achievement
            FROM (SELECT total_revenue, max_capacity * 70 AS target FROM daily
                  JOIN capacity USING (resort) WHERE resort = 'view'
                  ORDER BY ride_date DESC LIMIT 1)"""),
    "kpi_cards": _with(
        "kpi",
        f"""SELECT period, {_NUMBER.format('total_visitors')} AS visitors,
               {_CHANGE.format('total_visitors', 'prev_visitors')} AS visitors_change,
               {_MONEY.format('total_revenue')} AS revenue,
               {_CHANGE.format('total_revenue', 'prev_revenue')} AS revenue_change,
               printf('%.1f%% ', avg_capacity)
               || {_BAND.format('10 * avg_capacity', '🟢', '🟡', '🔴')} AS capacity,
               {_NUMBER.format('total_rides')} AS rides,
               {_CHANGE.format('total_rides', 'prev_rides')} AS rides_change FROM kpi"""),
    "json_payload": _with(
        "ride season_pass ticket",
        f"""SELECT '{{"TXID":"' || txid || '","RFID":"' || rfid || '","RESORT":"' || resort
               || '","LIFT":"' || lift || '","RIDE_TIME":"'
               || strftime(ride_time, '%Y-%m-%dT%H:%M:%S.%f+00:00')
               || '","ACTIVATION_DAY_COUNT":' || activation_day_count || '}}' AS value FROM ride
            UNION ALL SELECT '{{"TXID":"' || txid || '","RFID":"' || rfid || {_SALE}
               || ',{_NAME}' || {_CONTACT} FROM season_pass
            UNION ALL SELECT '{{"TXID":"' || txid || '","RFID":"' || rfid || '","RESORT":"'
               || resort || {_SALE} || ',"DAYS":' || days || ',{_NAME}' || {_CONTACT}
            FROM ticket"""),
    "published_views": _with(
        "network",
        """SELECT name, 'view' AS kind, (SELECT count(*) FROM network) AS network_days
           FROM (VALUES ('lift_ride'), ('season_pass'), ('resort_ticket'), ('resort_capacity'),
                 ('daily_visits'), ('hourly_lift_activity'), ('hourly_amortized_revenue'),
                 ('hourly_resort_summary'), ('daily_resort_summary'), ('weekly_resort_summary'),
                 ('v_daily_network_metrics'), ('v_daily_revenue_performance')) t(name)"""),
}
