"""DuckDB SQL for every registered query, over the same tables.

The statements are written from the rules, with period limits spelled out as literals, so
they check the Spark jobs' calendar arithmetic too. Ordered rules (recent lists, batches,
smoothing, re-ranking) are recursive queries that step through the rows.
"""

from __future__ import annotations

NOW, BEFORE, DAWN, PARTS_NOW = ("2024-01-30 23:00:00", "2024-01-30 22:00:00", "2024-01-30 00:40:00",
                                "2001-07-15 12:00:00")

# Period limits: live ranges start, archives (start, end), by hand for each instant used.
_JAN30 = {
    "day": "2024-01-30 00:01", "week": "2024-01-29 00:01", "month": "2024-01-01 00:01",
    "yesterday": ("2024-01-29 00:01", "2024-01-30 00:01"),
    "last_week": ("2024-01-22 00:01", "2024-01-29 00:01"),
    "last_month": ("2023-12-01 00:01", "2024-01-01 00:01"),
}
LIMITS = {
    NOW: _JAN30, BEFORE: _JAN30, DAWN: _JAN30,
    "2024-01-30 00:01:00": _JAN30,
    "2024-01-29 00:00:59": {
        "day": "2024-01-28 00:01", "week": "2024-01-22 00:01", "month": "2024-01-01 00:01",
        "yesterday": ("2024-01-27 00:01", "2024-01-28 00:01"),
        "last_week": ("2024-01-15 00:01", "2024-01-22 00:01"),
        "last_month": ("2023-12-01 00:01", "2024-01-01 00:01"),
    },
    "2024-01-10 13:00:00": {
        "day": "2024-01-10 00:01", "week": "2024-01-08 00:01", "month": "2024-01-01 00:01",
        "yesterday": ("2024-01-09 00:01", "2024-01-10 00:01"),
        "last_week": ("2024-01-01 00:01", "2024-01-08 00:01"),
        "last_month": ("2023-12-01 00:01", "2024-01-01 00:01"),
    },
    "2024-01-17 00:00:30": {
        "day": "2024-01-16 00:01", "week": "2024-01-15 00:01", "month": "2024-01-01 00:01",
        "yesterday": ("2024-01-15 00:01", "2024-01-16 00:01"),
        "last_week": ("2024-01-08 00:01", "2024-01-15 00:01"),
        "last_month": ("2023-12-01 00:01", "2024-01-01 00:01"),
    },
    "2024-01-29 00:01:00": {
        **_JAN30, "day": "2024-01-29 00:01", "yesterday": ("2024-01-28 00:01", "2024-01-29 00:01"),
    },
    PARTS_NOW: {
        "day": "2001-07-15 00:01", "week": "2001-07-09 00:01", "month": "2001-07-01 00:01",
        "yesterday": ("2001-07-14 00:01", "2001-07-15 00:01"),
        "last_week": ("2001-07-02 00:01", "2001-07-09 00:01"),
        "last_month": ("2001-06-01 00:01", "2001-07-01 00:01"),
    },
}
PAST = ("2024-01-10 13:00:00", "2024-01-17 00:00:30", NOW)
RANGES = ("total", "day", "week", "month", "yesterday", "last_week", "last_month")


def fixed(x: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"floor(({x}) * {scale} + 0.5) / {scale}"


EV = """ev AS (
  SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS post_id, user_id,
         CAST(user_id AS VARCHAR) AS client_id,
         CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
         ts, event_type, value, CAST(trunc(value * 1000) AS BIGINT) AS dwell_ms,
         CAST((event_id * 37) % 101 AS DOUBLE) AS scroll_pct
  FROM events)"""
POSTS = """posts AS (
  SELECT doc_id AS post_id, CASE WHEN doc_id % 10 = 0 THEN 'page' ELSE 'post' END AS post_type,
         CASE WHEN doc_id % 13 = 12 THEN 'draft' ELSE 'publish' END AS status,
         CAST(substr(source, 4) AS BIGINT) AS author_id,
         TIMESTAMP '2024-01-01' + to_hours(CAST((doc_id * 37) % 720 AS INTEGER)) AS published_at,
         'Document ' || doc_id AS title, '/d/' || doc_id AS link, text AS excerpt,
         CASE WHEN doc_id % 4 <> 0 THEN '/img/' || doc_id || '.png' END AS thumbnail, lang
  FROM documents)"""
TERMS = """terms AS (
  SELECT doc_id AS post_id, 'category' AS taxonomy,
         CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS term_id,
         lang AS slug, upper(lang) AS name FROM documents
  UNION ALL SELECT doc_id, 'category', 100 + doc_id % 7, 'topic-' || (doc_id % 7), 'Topic ' || (doc_id % 7) FROM documents
  UNION ALL SELECT doc_id, 'post_tag', 1000 + doc_id % 23, 'tag-' || (doc_id % 23), 'Tag ' || (doc_id % 23) FROM documents)"""
PARTV = "ev AS (SELECT l_partkey AS post_id, l_shipdate AS ts FROM lineitem)"
PARTS = """posts AS (
  SELECT p_partkey AS post_id, CASE WHEN p_partkey % 10 = 0 THEN 'page' ELSE 'post' END AS post_type,
         CASE WHEN p_partkey % 13 = 12 THEN 'draft' ELSE 'publish' END AS status,
         CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS author_id,
         TIMESTAMP '1995-01-01' + to_days(CAST((p_partkey * 37) % 2390 AS INTEGER)) AS published_at,
         p_name AS title, '/p/' || p_partkey AS link, '/img/' || p_partkey || '.png' AS thumbnail, p_type AS segment
  FROM part)"""


def counts(as_of: str, name: str = "cnt", source: str = "ev") -> str:
    lim = LIMITS[as_of]
    cols = ["nullif(count(v.ts), 0) AS total"]
    for r in ("day", "week", "month"):
        cols.append(f"nullif(count(*) FILTER (v.ts >= TIMESTAMP '{lim[r]}'), 0) AS {r}")
    for r in ("yesterday", "last_week", "last_month"):
        lo, hi = lim[r]
        n = f"count(*) FILTER (v.ts >= TIMESTAMP '{lo}' AND v.ts < TIMESTAMP '{hi}')"
        cols.append(f"CASE WHEN p.status = 'publish' AND p.published_at <= TIMESTAMP '{hi}' THEN {n} END AS {r}")
    return f"""{name} AS (
  SELECT p.post_id, {', '.join(cols)}
  FROM posts p LEFT JOIN {source} v ON v.post_id = p.post_id AND v.ts <= TIMESTAMP '{as_of}'
  GROUP BY p.post_id, p.status, p.published_at)"""


def q(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {body}"


E_COUNTS = (EV, POSTS, counts(NOW))
P_COUNTS = (PARTV, PARTS, counts(PARTS_NOW))

# --- requests and addresses ---------------------------------------------------------------

ADDRESS = """addr AS (
  SELECT event_id, ts,
         CASE WHEN event_id % 5 = 0 THEN '198.' || (user_id // 256) || '.' || (user_id % 256) || '.1'
              WHEN event_id % 7 = 0 THEN '2001:db8::' || lower(printf('%X', user_id))
              ELSE '10.' || (user_id // 256) || '.' || (user_id % 256) || '.1' END AS ip
  FROM ev)"""
CRC_BIT = "lambda r, b: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
CRC = f"""crc AS (
  SELECT ip, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(ip, ''), lambda c: ascii(c)::BIGINT)),
      lambda acc, ch: list_reduce(list_concat([xor(acc, ch)], range(8)), {CRC_BIT})), 4294967295) AS n
  FROM (SELECT DISTINCT ip FROM addr))"""
BASE36 = " || ".join(
    f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((n // {36**i}) % 36 AS INTEGER) + 1, 1)" for i in range(6, -1, -1))
HASHED = f"hashed AS (SELECT ip, ltrim({BASE36}, '0') AS ip_hash FROM crc)"


def requested(batch: int) -> str:
    ids = ["post_id", "CAST(floor(value) AS BIGINT)", "user_id"][:batch]
    parts = [f"SELECT event_id, ts, CAST({i} AS BIGINT) AS slot, abs({x}) AS post_id FROM ev" for i, x in enumerate(ids)]
    return f"req AS ({' UNION ALL '.join(parts)})"


def gated(types: str) -> str:
    return f"""gate AS (
  SELECT r.event_id, r.ts, r.slot, r.post_id,
         CASE WHEN r.post_id = 0 OR p.status IS DISTINCT FROM 'publish' THEN 'invalid'
              WHEN p.post_type NOT IN ({types}) THEN 'not enabled' END AS reason
  FROM req r LEFT JOIN posts p USING (post_id))"""


def recent_list(source: str) -> str:
    """Step through each post's views; the state is its list of at most 75 addresses."""
    return f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY ts, seq) AS n FROM {source}),
fold AS (
  SELECT post_id, seq, n, [ip] AS listed, ts AS at, false AS dup FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.post_id, x.seq, x.n,
         CASE WHEN x.hit THEN x.held ELSE list_slice(list_append(x.held, x.ip), greatest(1, len(x.held) + 2 - 75), len(x.held) + 1) END,
         CASE WHEN x.hit THEN x.at ELSE x.ts END, x.hit
  FROM (SELECT y.*, list_contains(y.held, y.ip) AS hit
        FROM (SELECT v.post_id, v.seq, v.n, v.ip, v.ts, f.at,
                     CASE WHEN v.ts - f.at > INTERVAL 14 DAY THEN []::VARCHAR[] ELSE f.listed END AS held
              FROM fold f JOIN numbered v ON v.post_id = f.post_id AND v.n = f.n + 1) y) x)"""


def running(source: str, key: str) -> str:
    def n(part):
        return f"count(*) OVER (PARTITION BY post_id{part} ORDER BY ts, {key} ROWS UNBOUNDED PRECEDING)"
    day, week, month = (f", date_trunc('{u}', ts - INTERVAL 1 MINUTE)" for u in ("day", "week", "month"))
    return (f"SELECT *, {n('')} AS total, {n(day)} AS day, {n(week)} AS week, {n(month)} AS month FROM {source}")


FIRST = "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY {scope}, post_id ORDER BY ts, event_id) = 1"

# --- rankings -------------------------------------------------------------------------

CATS = "cats AS (SELECT post_id, min(name) AS category FROM terms WHERE taxonomy = 'category' GROUP BY post_id)"


def ranked(value: str, where: str = "true", order: str = "views DESC, post_id DESC", types: str = "'post', 'page'") -> str:
    return f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY {order}) AS rank
  FROM (SELECT c.post_id, c.{value} AS views, p.published_at, p.title FROM cnt c JOIN posts p USING (post_id)
        WHERE c.{value} IS NOT NULL AND p.status = 'publish' AND p.post_type IN ({types}) AND {where}))"""


def top(value, first=1, last=5, parts=False, where="true") -> str:
    category = "''" if parts else "coalesce(k.category, '')"
    join = "" if parts else "LEFT JOIN cats k USING (post_id)"
    return q(*(P_COUNTS if parts else (*E_COUNTS, TERMS, CATS)), ranked(value, where), body=f"""
SELECT r.rank, r.post_id AS id, p.title, p.link, r.views, p.post_type,
       CASE p.post_type WHEN 'post' THEN 'Post' ELSE 'Page' END AS type, {category} AS category,
       coalesce(p.thumbnail, '/thumbnail') AS thumbnail, CAST(p.published_at AS DATE) AS date
FROM ranked r JOIN posts p USING (post_id) {join} WHERE r.rank BETWEEN {first} AND {last}""")


def has_term(taxonomy: str, *slugs: str) -> str:
    return (f"c.post_id IN (SELECT post_id FROM terms WHERE taxonomy = '{taxonomy}' "
            f"AND slug IN ({', '.join(repr(s) for s in slugs)}))")


# --- display text -------------------------------------------------------------------------

def short(n: str, suffixes: str) -> str:
    """Exact integer arithmetic: tenths of the unit, rounded half up."""
    cases = []
    for step, s in reversed(list(enumerate(suffixes.split(), start=1))):
        unit = 1000**step
        tenths = f"(({n} * 10 + {unit // 2}) // {unit})"
        whole = f"format('{{:,}}', {n} // {unit})"
        frac = f"format('{{:,}}', {tenths} // 10) || '.' || ({tenths} % 10)"
        cases.append(f"WHEN {n} >= {unit} THEN CASE WHEN {n} % {unit} = 0 THEN {whole} ELSE {frac} END || ' {s}'")
    return f"CASE {' '.join(cases)} ELSE CAST({n} AS VARCHAR) END"


def age(sec: str) -> str:
    units = ((31536000, "year"), (2592000, "month"), (604800, "week"), (86400, "day"), (3600, "hour"), (60, "min"))
    cases = []
    for size, name in units:
        n = f"greatest(({sec} * 2 + {size}) // {2 * size}, 1)"
        cases.append(f"WHEN {sec} >= {size} THEN {n} || ' {name}' || CASE WHEN {n} > 1 THEN 's' ELSE '' END")
    return f"CASE {' '.join(cases)} ELSE greatest({sec}, 1) || CASE WHEN {sec} > 1 THEN ' seconds' ELSE ' second' END END"


# --- traffic shape ------------------------------------------------------------------------

def bins(name: str = "bins", min_daily: int = 20, before: str = "2024-01-30") -> str:
    """Days to learn from, numbered in order. A rollup after midnight closes the day before."""
    arr = ", ".join(f"count(*) FILTER (hour(ts) = {h})" for h in range(24))
    return f"""{name} AS (
  SELECT *, row_number() OVER (ORDER BY d) AS n FROM (
    SELECT CAST(ts AS DATE) AS d, [{arr}] AS b, count(*) AS total FROM ev
    WHERE hour(ts) * 60 + minute(ts) >= 1 GROUP BY 1)
  WHERE total >= {min_daily} AND d < DATE '{before}')"""


def _norm(arr: str) -> str:
    return f"list_transform({arr}, lambda z: z / (list_sum({arr}) / len({arr})))"


SHAPE_FOLD = f"""learn AS (
  SELECT 0::BIGINT AS n, list_transform(range(24), lambda i: 1.0::DOUBLE) AS h, list_transform(range(7), lambda i: 1.0::DOUBLE) AS w
  UNION ALL
  SELECT n, {_norm('nh')}, {_norm('nw')} FROM (
    SELECT b.n,
      list_transform(range(24), lambda i: 0.75::DOUBLE * l.h[i + 1] + 0.25::DOUBLE *
        greatest(0.2::DOUBLE, least(5.0::DOUBLE, ((b.b[i + 1] + 48::DOUBLE / 24) / (b.total + 48)) * 24))) AS nh,
      list_transform(range(7), lambda i: CASE WHEN i = dayofweek(b.d) THEN 0.8::DOUBLE * l.w[i + 1] + 0.2::DOUBLE *
        greatest(0.2::DOUBLE, least(5.0::DOUBLE, ((b.total + 14::DOUBLE) / 15) / (list_sum(l.w) / 7))) ELSE l.w[i + 1] END) AS nw
    FROM learn l JOIN bins b ON b.n = l.n + 1))"""
LEARNED = "learned AS (SELECT h, w FROM learn ORDER BY n DESC LIMIT 1)"

# --- trending -------------------------------------------------------------------------


def hot(as_of: str, name: str = "heat", cnt: str = "cnt", hours: int = 24, seg: str = "''") -> str:
    return f"""{name} AS (
  WITH fresh AS (
    SELECT {seg} AS segment, p.post_id, c.day FROM posts p JOIN {cnt} c USING (post_id)
    WHERE p.status = 'publish' AND p.published_at >= TIMESTAMP '{as_of}' - INTERVAL {hours} HOUR AND c.day > 0
    QUALIFY row_number() OVER (PARTITION BY {seg} ORDER BY c.day DESC, p.post_id DESC) <= 100),
  sums AS (SELECT f.segment, t.taxonomy, t.term_id, sum(f.day)::BIGINT AS views FROM fresh f JOIN terms t USING (post_id) GROUP BY 1, 2, 3)
  SELECT *, views / max(views) OVER (PARTITION BY segment, taxonomy)::DOUBLE AS heat FROM sums)"""


def cands(name: str = "cand", cnt: str = "cnt", limit: int = 100, min_count: int = 20, seg: str = "''") -> str:
    """Ranks in the four lists, then the day list or the fused order."""
    def rk(r):
        return (f"CASE WHEN {r} IS NOT NULL THEN row_number() OVER (PARTITION BY segment ORDER BY {r} DESC NULLS LAST, "
                f"post_id DESC) - 1 END AS {r}_r")
    cut = ", ".join(f"CASE WHEN {r}_r < {limit} THEN {r}_r END AS {r}_rank" for r in ("day", "week", "month", "total"))
    parts = " + ".join(f"coalesce({w}::DOUBLE * (1 - {r}_rank / {float(max(1, limit))}::DOUBLE), 0)"
                       for r, w in (("day", 1.0), ("week", 0.6), ("month", 0.3), ("total", 0.15)))
    return f"""{name} AS (
  WITH base AS (SELECT {seg} AS segment, c.*, p.author_id, p.published_at FROM {cnt} c JOIN posts p USING (post_id)
                WHERE p.status = 'publish' AND p.post_type = 'post'),
  r0 AS (SELECT *, {', '.join(rk(r) for r in ('day', 'week', 'month', 'total'))} FROM base),
  r1 AS (SELECT *, {cut} FROM r0),
  r2 AS (SELECT *, {parts} + CASE WHEN day_rank IS NOT NULL THEN 0.02::DOUBLE ELSE 0 END AS fusion_score,
                count(day_rank) OVER (PARTITION BY segment) >= {min_count} AS by_day,
                CASE WHEN day_rank IS NOT NULL THEN 0 WHEN week_rank IS NOT NULL THEN 1
                     WHEN month_rank IS NOT NULL THEN 2 ELSE 3 END AS lst
         FROM r1 WHERE coalesce(day_rank, week_rank, month_rank, total_rank) IS NOT NULL),
  r3 AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY lst, coalesce(day_rank, week_rank, month_rank, total_rank)) AS pos FROM r2)
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY CASE WHEN pos > {limit} THEN pos ELSE 0 END,
            CASE WHEN by_day THEN day_rank::DOUBLE ELSE -fusion_score END,
            day_rank ASC NULLS LAST, week_rank ASC NULLS LAST, post_id DESC) AS cand_rank
  FROM r3 WHERE CASE WHEN by_day THEN day_rank IS NOT NULL ELSE pos <= {max(limit, min_count)} END)"""


HOURS = """hours AS (
  SELECT t AS as_of, date_trunc('day', t - INTERVAL 1 MINUTE) + INTERVAL 1 MINUTE AS day0,
         date_trunc('week', t - INTERVAL 1 MINUTE) + INTERVAL 1 MINUTE AS week0,
         date_trunc('month', t - INTERVAL 1 MINUTE) + INTERVAL 1 MINUTE AS month0
  FROM (SELECT TIMESTAMP '2024-01-24' + to_hours(CAST(i AS INTEGER)) AS t FROM range(168) r(i)))"""
SWEPT = """swept AS (
  SELECT h.as_of, v.post_id, count(*) AS total, nullif(count(*) FILTER (v.ts >= h.day0), 0) AS day,
         nullif(count(*) FILTER (v.ts >= h.week0), 0) AS week, nullif(count(*) FILTER (v.ts >= h.month0), 0) AS month
  FROM hours h JOIN ev v ON v.ts <= h.as_of GROUP BY 1, 2)"""
SWEEP = (BEFORE, NOW, DAWN, "2024-01-30 00:01:00", "2024-01-29 00:00:59")


TERM_ARRAYS = """tset AS (
  SELECT post_id, coalesce(list_sort(list(DISTINCT term_id) FILTER (taxonomy = 'category')), []) AS categories,
         coalesce(list_sort(list(DISTINCT term_id) FILTER (taxonomy = 'post_tag')), []) AS tags FROM terms GROUP BY post_id)"""


def momentum(name="mom", heat="heat", cand="cand") -> str:
    return f"""{name} AS (
  SELECT c.post_id, least(product(1 + coalesce(h.heat, 0) * CASE t.taxonomy WHEN 'category' THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END), 1.5::DOUBLE) AS momentum,
         coalesce(max(h.heat) FILTER (t.taxonomy = 'category'), 0) AS category_heat
  FROM {cand} c JOIN terms t USING (post_id) LEFT JOIN {heat} h
    ON h.segment = c.segment AND h.taxonomy = t.taxonomy AND h.term_id = t.term_id
  GROUP BY c.post_id)"""


def metrics(as_of: str, name: str = "met") -> str:
    return f"""{name} AS (
  SELECT post_id, count(*) FILTER (event_type = 'signup') AS comments, count(*) FILTER (event_type = 'click') AS likes,
         count(*) FILTER (event_type = 'purchase') AS shares FROM ev WHERE ts <= TIMESTAMP '{as_of}' GROUP BY post_id)"""


def scored(as_of: str, x: str = "", prev: str | None = None, min_count: int = 20, shape: bool = True,
           seg: str = "''") -> list[str]:
    """CTEs ``cnt heat cand mom met score`` (suffix ``x``) of one run; ``prev`` is a run before it."""
    hour = int(as_of[11:13])
    sh = (f"(SELECT {_norm('h')}[{hour + 1}] * {_norm('w')}[dayofweek(TIMESTAMP '{as_of}') + 1] FROM learned)"
          if shape else "1.0::DOUBLE")
    p = f"LEFT JOIN score{prev} s0 USING (post_id)" if prev is not None else ""
    pe, ps = ("s0.ewma_val", "s0.capped") if p else ("NULL::DOUBLE", "NULL::DOUBLE")
    streak = "CASE WHEN s0.streak > 0 THEN s0.streak ELSE 0 END" if p else "0"
    prog = "least(1.0::DOUBLE, greatest(0.05::DOUBLE, age / 24))"
    a = 1.0 - 0.5 ** (1.0 / 6.0)
    wk, mo = "(week / 7::DOUBLE)", "(month / 30::DOUBLE)"
    return [counts(as_of, f"cnt{x}"), hot(as_of, f"heat{x}", f"cnt{x}", seg=seg),
            cands(f"cand{x}", f"cnt{x}", min_count=min_count, seg=seg),
            momentum(f"mom{x}", f"heat{x}", f"cand{x}"), metrics(as_of, f"met{x}"), f"""score{x} AS (
  WITH f0 AS (
    SELECT c.segment, c.post_id, c.cand_rank, c.author_id, coalesce(c.day, 0) AS day, coalesce(c.week, 0) AS week, coalesce(c.month, 0) AS month,
           coalesce(c.total, 0) AS total, greatest(0.5::DOUBLE, epoch_us(TIMESTAMP '{as_of}') - epoch_us(c.published_at)) AS us,
           m.momentum, m.category_heat, coalesce(e.comments, 0) + coalesce(e.likes, 0) + coalesce(e.shares, 0) AS actions,
           {sh} AS shp, {pe} AS prev_ewma, {ps} AS prev_score, {streak} AS prev_streak
    FROM cand{x} c JOIN mom{x} m USING (post_id) LEFT JOIN met{x} e USING (post_id) {p}),
  f1 AS (SELECT *, greatest(0.5::DOUBLE, (us / 3600000000::DOUBLE)) AS age FROM f0),
  f2 AS (SELECT *, CASE WHEN day <> 0 THEN day ELSE greatest(1, greatest(round({wk} * {prog}),
             CASE WHEN month > 0 THEN round(0.3::DOUBLE * {mo} * {prog}) ELSE 0 END)::BIGINT) END AS day_used FROM f1),
  f3 AS (SELECT *, ln(1 + day_used / least(age, 24::DOUBLE)) * 10 * (1
             + CASE WHEN week > 0 AND day_used > {wk} THEN (day_used / {wk} - 1) * 0.3::DOUBLE ELSE 0 END
             + CASE WHEN month > 0 AND {wk} > {mo} THEN ({wk} / {mo} - 1) * 0.2::DOUBLE ELSE 0 END) AS velocity,
           CASE WHEN age <= 2 THEN 1::DOUBLE ELSE exp(-0.693::DOUBLE * (age - 2) / 36) END AS time_decay,
           1 + least(actions / greatest(5, day_used)::DOUBLE * 10, 1::DOUBLE) AS engagement,
           CASE WHEN age <= 1 THEN 1.8 WHEN age <= 3 THEN 1.4 WHEN age <= 6 THEN 1.2 WHEN age <= 12 THEN 1.1
                WHEN age <= 24 THEN 1.05 ELSE 1.0 END::DOUBLE AS freshness,
           {wk} * (least(24::DOUBLE, greatest(1::DOUBLE, age)) / 24) * shp * (1 + 0.1::DOUBLE * category_heat) AS expected,
           day / greatest(1::DOUBLE, least(age, 24::DOUBLE)) AS rate,
           CASE WHEN day / greatest(1::DOUBLE, greatest(1, month) / 30::DOUBLE) > 20 THEN 0.9::DOUBLE ELSE 1 END
           * CASE WHEN day / greatest(1::DOUBLE, greatest(1, total) / 90::DOUBLE) > 50 THEN 0.85::DOUBLE ELSE 1 END AS penalty FROM f2),
  f4 AS (SELECT *, sqrt(day + 0.375::DOUBLE) - sqrt(expected + 0.375::DOUBLE) AS uplift_raw,
           {a!r}::DOUBLE * rate + {1 - a!r}::DOUBLE * coalesce(prev_ewma, rate) AS ewma_val FROM f3),
  f5 AS (SELECT *, 1 + greatest(-0.2::DOUBLE, least(0.5::DOUBLE, uplift_raw * 0.15::DOUBLE)) AS uplift,
           greatest(-0.5::DOUBLE, least(0.5::DOUBLE, ewma_val - coalesce(prev_ewma, rate))) AS acc FROM f4),
  f6 AS (SELECT *, 1 + greatest(-0.2::DOUBLE, least(0.3::DOUBLE, ln(1 + ewma_val) * 0.15::DOUBLE + acc * 0.1::DOUBLE)) AS ewma FROM f5),
  f7 AS (SELECT *, velocity * time_decay * engagement * freshness * momentum * uplift * ewma * penalty AS raw_score FROM f6),
  f8 AS (SELECT *, least(10000 * (1 - exp(-raw_score / 5000)), coalesce(prev_score * 1.8::DOUBLE + 10, 'infinity'::DOUBLE)) AS capped FROM f7),
  f9 AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY round(capped, 4) DESC, cand_rank) AS pre_rank FROM f8),
  f10 AS (SELECT *, CASE WHEN pre_rank <= 20 THEN prev_streak + 1 ELSE 0 END AS streak FROM f9),
  f11 AS (SELECT *, greatest(0.8::DOUBLE, 1 - greatest(0, streak - 6) * 0.03::DOUBLE) AS fatigue FROM f10),
  f12 AS (SELECT *, round(capped, 4) * fatigue AS score FROM f11)
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, pre_rank) AS score_rank FROM f12)"""]


ONE_RUN = [EV, POSTS, TERMS, bins(), SHAPE_FOLD, LEARNED, *scored(NOW)]
TWO_RUNS = [EV, POSTS, TERMS, bins(), SHAPE_FOLD, LEARNED, *scored(BEFORE, "0"), *scored(NOW, "", prev="0"), TERM_ARRAYS]

def mmr(ids: str = "BIGINT") -> str:
    """The greedy pick, one recursion for all segments."""
    return f"""pool AS (
  SELECT s.*, t.categories, t.tags, list_distinct(list_concat(t.categories, t.tags)) AS ids
  FROM score s JOIN tset t USING (post_id)),
mmr AS (
  SELECT DISTINCT segment, 0 AS step, []::BIGINT[] AS sel, []::{ids}[][] AS sel_ids FROM pool
  UNION ALL
  SELECT segment, step + 1, list_append(sel, best.post_id), list_append(sel_ids, best.ids) FROM (
    SELECT segment, step, sel, sel_ids, list({{'post_id': post_id, 'ids': ids}} ORDER BY v DESC, score_rank)[1] AS best FROM (
      SELECT m.segment, m.step, m.sel, m.sel_ids, p.post_id, p.ids, p.score_rank,
             0.75::DOUBLE * p.score - 0.25::DOUBLE * p.score * coalesce(list_max(list_transform(m.sel_ids,
               lambda s: len(list_intersect(s, p.ids)) / len(list_distinct(list_concat(s, p.ids)))::DOUBLE)), 0) AS v
      FROM mmr m JOIN pool p ON p.segment = m.segment AND NOT list_contains(m.sel, p.post_id) WHERE m.step < 20)
    GROUP BY segment, step, sel, sel_ids)),
by_mmr AS (SELECT segment, post_id, pos FROM (
  SELECT segment, unnest(sel) AS post_id, generate_subscripts(sel, 1) AS pos
  FROM (SELECT segment, arg_max(sel, step) AS sel FROM mmr GROUP BY segment)))"""


MMR = mmr()

EXPLORE = """picks AS (
  SELECT post_id, row_number() OVER (ORDER BY round(uplift, 4) * round(ewma, 4) DESC, score_rank) AS k
  FROM pool WHERE score_rank <= 50 QUALIFY k <= 2),
spliced AS (
  SELECT post_id, CASE WHEN pos <= 7 THEN pos ELSE pos + 2 END AS pos FROM by_mmr
  UNION ALL SELECT post_id, 7 + k FROM picks),
first_seen AS (SELECT post_id, min(pos) AS p0 FROM spliced GROUP BY post_id),
explored AS (
  SELECT * FROM (SELECT post_id, row_number() OVER (ORDER BY p0) AS pos FROM first_seen) WHERE pos <= 20)"""


def diversity(source: str, cats: str = "BIGINT") -> str:
    return f"""lined AS (
  SELECT p.segment, x.post_id, x.pos, p.author_id, p.categories,
         CASE WHEN a.authors * 2 < 20 THEN 20 ELSE 2 END AS qa, CASE WHEN coalesce(k.cats, 0) * 3 < 20 THEN 20 ELSE 3 END AS qc
  FROM {source} x JOIN pool p USING (post_id)
  JOIN (SELECT p.segment, count(DISTINCT p.author_id) AS authors FROM pool p JOIN {source} USING (post_id) GROUP BY 1) a ON a.segment = p.segment
  LEFT JOIN (SELECT segment, count(DISTINCT c) AS cats FROM (
    SELECT p.segment, unnest(p.categories) AS c FROM pool p JOIN {source} USING (post_id)) GROUP BY 1) k ON k.segment = p.segment),
walk AS (
  SELECT DISTINCT segment, 0::BIGINT AS pos, []::BIGINT[] AS authors, []::{cats}[] AS cats, []::BIGINT[] AS sel FROM lined
  UNION ALL
  SELECT segment, pos, CASE WHEN ok THEN list_append(authors, author_id) ELSE authors END,
         CASE WHEN ok THEN list_concat(cats, categories) ELSE cats END,
         CASE WHEN ok THEN list_append(sel, post_id) ELSE sel END FROM (
    SELECT l.segment, l.pos, l.post_id, l.author_id, l.categories, w.authors, w.cats, w.sel,
           len(list_filter(w.authors, lambda a: a = l.author_id)) < l.qa
           AND len(list_filter(l.categories, lambda c: len(list_filter(w.cats, lambda z: z = c)) >= l.qc)) = 0 AS ok
    FROM walk w JOIN lined l ON l.segment = w.segment AND l.pos = w.pos + 1)),
final AS (
  SELECT l.segment, l.post_id, row_number() OVER (
    PARTITION BY l.segment ORDER BY CASE WHEN list_contains(w.sel, l.post_id) THEN 0 ELSE 1 END, l.pos) AS position
  FROM lined l JOIN (SELECT segment, arg_max(sel, pos) AS sel FROM walk GROUP BY segment) w ON w.segment = l.segment)"""


FULL = [*TWO_RUNS, MMR, diversity("by_mmr")]


DEBUG_DIGITS = {"velocity": 4, "time_decay": 4, "engagement": 4, "freshness": 4, "momentum": 4, "uplift": 4, "uplift_raw": 4,
                "expected": 2, "ewma": 4, "ewma_val": 4, "acc": 4, "fatigue": 4}


def picked(ctes, *cols: str, source: str = "score") -> str:
    return q(*ctes, recursive=True, body=f"SELECT post_id, {', '.join(f'{fixed(c)} AS {c}' for c in cols)} FROM {source}")


def hour_rows(where: str = "true") -> str:
    return f"""SELECT d AS site_day, total, CAST(i AS BIGINT) AS hour, b[i + 1] AS views
FROM (SELECT * FROM bins WHERE {where}), range(24) t(i)"""


ORACLE = {
    "client_ip": q(EV, ADDRESS, CRC, HASHED, body="SELECT event_id, ip, ip_hash FROM addr JOIN hashed USING (ip)"),
    "request_views": q(EV, requested(3), body="SELECT event_id, slot, post_id FROM req"),
    "request_feed": q(EV, requested(3), body="SELECT event_id, slot, post_id FROM req WHERE event_id % 3 <> 0 OR slot = 0"),
    "eligibility": q(EV, POSTS, requested(2), gated("'post'"), body="SELECT event_id, slot, post_id, reason FROM gate"),
    "count_requests": q(
        EV, POSTS, ADDRESS, requested(2), gated("'post', 'page'"),
        "passing AS (SELECT g.*, a.ip, g.event_id * 2 + g.slot AS seq FROM gate g JOIN addr a USING (event_id) WHERE reason IS NULL)",
        recent_list("passing"),
        """tagged AS (SELECT p.*, CASE WHEN f.dup THEN 'ip_duplicate' WHEN starts_with(p.ip, '198.') THEN 'skipped' END AS why
                      FROM passing p JOIN fold f USING (post_id, seq))""",
        "counted AS (" + running("(SELECT * FROM tagged WHERE why IS NULL)", "seq") + ")",
        recursive=True, body="""
SELECT CAST(g.event_id AS VARCHAR) AS request_id, g.slot, g.post_id, coalesce(g.reason, t.why,
         CASE WHEN starts_with(a.ip, '198.') THEN CASE WHEN g.reason IS NULL THEN 'skipped' END END) AS reason,
       c.total, c.day, c.week, c.month
FROM gate g JOIN addr a USING (event_id) LEFT JOIN tagged t ON t.event_id = g.event_id AND t.slot = g.slot
LEFT JOIN counted c ON c.event_id = g.event_id AND c.slot = g.slot"""),
    "qualified_views": q(EV, body="SELECT event_id, post_id, dwell_ms, scroll_pct FROM ev WHERE dwell_ms >= 15000 AND scroll_pct >= 75"),
    "viewer_dedup": q(EV, body="SELECT event_id, client_id, session_id, post_id FROM (" + FIRST.format(scope="session_id") + ")"),
    "viewer_dedup_client": q(EV, body="SELECT event_id, client_id, session_id, post_id FROM (" + FIRST.format(scope="client_id") + ")"),
    "batch_flush": q(EV, "f AS (" + FIRST.format(scope="client_id") + ")",
                     "n AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts, event_id) - 1 AS rn FROM f)",
                     body="""SELECT client_id, post_id, max(ts) OVER w AS counted_at, rn % 3 AS slot FROM n
                             WINDOW w AS (PARTITION BY client_id, rn // 3) QUALIFY count(*) OVER w = 3"""),
    "batch_flush_session": q(
        EV, "f AS (" + FIRST.format(scope="session_id") + ")",
        "n AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts, event_id) AS rn FROM f)",
        """walk AS (
  SELECT DISTINCT client_id, 0::BIGINT AS rn, NULL::TIMESTAMP AS ts, []::BIGINT[] AS queue, []::BIGINT[] AS sent FROM f
  UNION ALL
  SELECT client_id, rn, ts, CASE WHEN len(held) >= 3 THEN []::BIGINT[] ELSE held END,
         CASE WHEN len(held) >= 3 THEN held ELSE []::BIGINT[] END FROM (
    SELECT n.client_id, n.rn, n.ts, CASE WHEN list_contains(w.queue, n.post_id) THEN w.queue ELSE list_append(w.queue, n.post_id) END AS held
    FROM walk w JOIN n ON n.client_id = w.client_id AND n.rn = w.rn + 1))""",
        recursive=True, body="""SELECT client_id, ts AS counted_at, unnest(sent) AS post_id,
       CAST(generate_subscripts(sent, 1) - 1 AS BIGINT) AS slot FROM walk WHERE len(sent) > 0"""),
    "strict_ip_dedup": q(EV, "src AS (SELECT *, event_id AS seq, client_id AS ip FROM ev)", recent_list("src"), recursive=True,
                         body="SELECT seq AS event_id, post_id, dup AS ip_duplicate FROM fold"),
    "counters_all_ranges": q(*P_COUNTS, body="SELECT * FROM cnt"),
    "counters_events": q(*E_COUNTS, body="SELECT * FROM cnt"),
    "counters_long": q(*E_COUNTS, body="""SELECT post_id, k AS meta_key, v AS meta_value FROM (
        SELECT post_id, unnest(['total', 'day', 'week', 'month', 'yesterday', 'last_week', 'last_month']) AS k,
               unnest([total, day, week, month, yesterday, last_week, last_month]) AS v FROM cnt) WHERE v IS NOT NULL"""),
    "counters_wide": q(*E_COUNTS, body="SELECT * FROM cnt WHERE coalesce(" + ", ".join(RANGES) + ") IS NOT NULL"),
    "counters_renamed": q(*E_COUNTS, body="SELECT * FROM cnt WHERE coalesce(" + ", ".join(RANGES) + ") IS NOT NULL"),
    "counters_applied": q(EV, POSTS, counts("2024-01-30 00:01:00", "c0", "(SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-30 00:01')"),
                          "t AS (SELECT post_id, count(*) AS n FROM ev WHERE ts >= TIMESTAMP '2024-01-30 00:01' AND ts <= TIMESTAMP '2024-01-30 23:00' GROUP BY 1)",
                          body="""SELECT post_id, CASE WHEN n IS NULL THEN total ELSE coalesce(total, 0) + n END AS total,
       CASE WHEN n IS NULL THEN day ELSE coalesce(day, 0) + n END AS day, CASE WHEN n IS NULL THEN week ELSE coalesce(week, 0) + n END AS week,
       CASE WHEN n IS NULL THEN month ELSE coalesce(month, 0) + n END AS month, yesterday, last_week, last_month
FROM c0 FULL JOIN t USING (post_id)"""),
    "running_counts": q(EV, body="SELECT event_id, post_id, total, day, week, month FROM (" + running("ev", "event_id") + ")"),
    "rollover_snapshot": q(EV, POSTS, counts("2024-01-29 00:00:59"), body="""
SELECT post_id, total, CASE WHEN t THEN NULL ELSE day END AS day, CASE WHEN t THEN NULL ELSE week END AS week, month,
       CASE WHEN t THEN coalesce(day, 0) ELSE yesterday END AS yesterday,
       CASE WHEN t THEN coalesce(week, 0) ELSE last_week END AS last_week, last_month
FROM (SELECT c.*, p.status = 'publish' AND p.published_at <= TIMESTAMP '2024-01-29 00:01' AS t FROM cnt c JOIN posts p USING (post_id))"""),
    "rollover_forced": q(*E_COUNTS, body="""
SELECT post_id, total, CASE WHEN t THEN NULL ELSE day END AS day, week, CASE WHEN t THEN NULL ELSE month END AS month,
       CASE WHEN t THEN coalesce(day, 0) ELSE yesterday END AS yesterday, last_week,
       CASE WHEN t THEN coalesce(month, 0) ELSE last_month END AS last_month, t OR day IS NULL AS moved
FROM (SELECT c.post_id, CASE WHEN c.total > 1 THEN c.total END AS total, CASE WHEN c.total > 1 THEN c.day END AS day,
             CASE WHEN c.total > 1 THEN c.week END AS week, CASE WHEN c.total > 1 THEN c.month END AS month,
             CASE WHEN c.total > 1 THEN c.yesterday END AS yesterday, CASE WHEN c.total > 1 THEN c.last_week END AS last_week,
             CASE WHEN c.total > 1 THEN c.last_month END AS last_month, c.total > 1 AS held,
             p.status = 'publish' AND p.published_at <= TIMESTAMP '2024-01-31 00:01' AS t
      FROM cnt c JOIN posts p USING (post_id)) WHERE t OR held"""),
    "rollover_summary": q(POSTS, body="""SELECT count(*) AS total_posts, true AS reset_day, true AS reset_week, false AS reset_month,
       count(*) AS affected_posts FROM posts WHERE status = 'publish' AND published_at <= TIMESTAMP '2024-01-29 00:01'"""),
    "top_total": top("total"),
    "top_day": top("day"),
    "top_week": top("week"),
    "top_month": top("month"),
    "top_yesterday": top("yesterday", 21, 40),
    "top_last_week": top("last_week"),
    "top_last_month": top("last_month", parts=True),
    "top_excerpts": q(*E_COUNTS, ranked("total"), "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\n\\r\\t ]+'), lambda x: x <> '') AS words FROM documents)",
                      body="""SELECT r.rank, r.post_id AS id, p.excerpt, CASE WHEN len(words) > 35
       THEN array_to_string(words[1:35], ' ') || '...' ELSE array_to_string(words, ' ') END AS short_excerpt
FROM ranked r JOIN posts p USING (post_id) JOIN w ON w.doc_id = r.post_id WHERE rank <= 10"""),
    "top_by_terms": top("month", 5, 8, where=has_term("category", "topic-3", "topic-5")),
    "top_by_segment": q(*P_COUNTS, body="""SELECT p.segment, row_number() OVER (PARTITION BY p.segment ORDER BY c.month DESC, c.post_id DESC) AS rank,
       c.post_id AS id, p.title FROM cnt c JOIN posts p USING (post_id) WHERE c.month IS NOT NULL AND p.status = 'publish' QUALIFY rank <= 10"""),
    "view_list": q(*E_COUNTS, TERMS, CATS, ranked("week", has_term("category", "en"), "views, post_id DESC", "'post'"),
                   body="SELECT rank, post_id AS id, title, views, category FROM ranked JOIN cats USING (post_id) WHERE rank <= 10"),
    "view_list_by_date": q(*E_COUNTS, TERMS, ranked("total", has_term("category", "en") + " AND " + has_term("post_tag", "tag-4"),
                                                    "published_at DESC, post_id DESC", "'post'"),
                           body="SELECT rank, post_id AS id, title, views, CAST(published_at AS DATE) AS date FROM ranked WHERE rank = 2"),
    "view_list_by_title": q(*E_COUNTS, ranked("day", order="title, post_id DESC", types="'post'"),
                            body="SELECT rank, post_id AS id, title, views FROM ranked WHERE rank BETWEEN 8 AND 14"),
    "ranking_tabs": q(*P_COUNTS, "u AS (UNPIVOT cnt ON " + ", ".join(RANGES) + " INTO NAME tab VALUE views)",
                      body="""SELECT tab, row_number() OVER (PARTITION BY tab ORDER BY views DESC, post_id DESC) AS rank, post_id AS id, title, link, views
FROM u JOIN posts USING (post_id) WHERE status = 'publish' QUALIFY rank <= 10"""),
    "post_count": q(*P_COUNTS, body=f"SELECT post_id, coalesce(total, 0) AS views, {short('coalesce(total, 0)', 'K M B T')} AS view_text FROM cnt"),
    "format_counts": f"""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice * pow(10::DOUBLE, o_custkey % 9 - 4)) AS BIGINT) AS n,
       CAST(date_diff('second', o_orderdate, TIMESTAMP '2001-12-31') AS BIGINT) AS sec FROM orders)
SELECT o_orderkey, n, {short('n', 'K M B T')} AS short, {short('n', 'N Tr T TT')} AS short_vi,
       format('{{:,}}', n) AS grouped, {age('abs(sec)')} AS age FROM o""",
    "hour_bins": q(EV, bins(min_daily=0, before="2025-01-01"), body=hour_rows()),
    "merged_bins": q(EV, bins(min_daily=0, before="2025-01-01"), body=hour_rows()),
    "hour_shape": q(EV, bins(), SHAPE_FOLD, LEARNED, recursive=True,
                    body=f"SELECT CAST(i AS BIGINT) AS slot, {fixed('h[i + 1]')} AS multiplier FROM learned, range(24) t(i)"),
    "shape_resumed": q(EV, bins(), SHAPE_FOLD, LEARNED, recursive=True,
                       body=f"SELECT CAST(i AS BIGINT) AS slot, {fixed('h[i + 1]')} AS multiplier FROM learned, range(24) t(i)"),
    "shape_skipping": q(
        EV, "fl AS (SELECT floor(avg(n)) AS m FROM (SELECT count(*) AS n FROM ev WHERE hour(ts) * 60 + minute(ts) >= 1 GROUP BY CAST(ts AS DATE)))",
        bins(min_daily="(SELECT m FROM fl)"), SHAPE_FOLD, LEARNED, recursive=True,
        body=f"""SELECT CAST((SELECT count(*) FROM bins) AS INTEGER) AS days_learned, CAST(i AS BIGINT) AS slot,
                        {fixed('h[i + 1]')} AS multiplier FROM learned, range(24) t(i)"""),
    "wday_shape": q(EV, bins(), SHAPE_FOLD, LEARNED, recursive=True,
                    body=f"SELECT CAST(i AS BIGINT) AS slot, {fixed('w[i + 1]')} AS multiplier FROM learned, range(7) t(i)"),
    "shape_factors": q(EV, bins(), SHAPE_FOLD, LEARNED, recursive=True,
                       body=f"SELECT {fixed(_norm('h') + '[24]')} AS hour_factor, {fixed(_norm('w') + '[3]')} AS wday_factor FROM learned"),
    "term_sets": q(TERMS, TERM_ARRAYS, body="SELECT post_id, array_to_string(categories, ',') AS categories, array_to_string(tags, ',') AS tags FROM tset"),
    "engagement_metrics": q(EV, POSTS, metrics(NOW), body="""SELECT post_id, coalesce(comments, 0) AS comments, coalesce(likes, 0) AS likes,
       coalesce(shares, 0) AS shares FROM posts LEFT JOIN met USING (post_id)"""),
    "hot_topics": q(*E_COUNTS, TERMS, hot(NOW, hours=336), body=f"SELECT taxonomy, term_id, views, {fixed('heat')} AS heat FROM heat"),
    "category_momentum": q(*E_COUNTS, TERMS, hot(NOW), cands(), momentum(), TERM_ARRAYS, body=f"""
SELECT post_id, array_to_string(categories, ',') AS categories, array_to_string(tags, ',') AS tags,
       {fixed('momentum')} AS momentum, {fixed('category_heat')} AS category_heat FROM mom JOIN tset USING (post_id)"""),
    "counters_sweep": q(EV, HOURS, SWEPT, body="SELECT * FROM swept"),
    "counters_sweep_archives": q(
        EV, "posts AS (SELECT DISTINCT post_id, 'publish' AS status, TIMESTAMP '2000-01-01' AS published_at FROM ev)",
        *[counts(t, f"at{i}") for i, t in enumerate(SWEEP)], body=" UNION ALL ".join(
            f"""SELECT TIMESTAMP '{t}' AS as_of, post_id, total, day, week, month, {', '.join(
                f'nullif({r}, 0) AS {r}' for r in ('yesterday', 'last_week', 'last_month'))}
            FROM at{i} WHERE total > 0""" for i, t in enumerate(SWEEP))),
    "hourly_candidates": q(EV, POSTS, HOURS, SWEPT, cands(
        cnt="swept", limit=30, min_count=25, seg="strftime(c.as_of, '%Y-%m-%d %H:%M:%S')"), body=f"""
SELECT segment, post_id, cand_rank, day_rank, week_rank, month_rank, total_rank, {fixed('fusion_score')} AS fusion_score FROM cand"""),
    "candidates": q(*E_COUNTS, cands(), body="SELECT post_id, cand_rank, day_rank, week_rank, month_rank, total_rank FROM cand"),
    "rank_fusion": q(EV, POSTS, counts(DAWN), cands(limit=50, min_count=60), body=f"""
SELECT post_id, cand_rank, day_rank, week_rank, month_rank, total_rank, {fixed('fusion_score')} AS fusion_score FROM cand"""),
    "candidates_by_segment": q(*P_COUNTS, cands(limit=30, seg="p.segment"), body=f"""
SELECT segment, post_id, cand_rank, day_rank, week_rank, month_rank, total_rank, {fixed('fusion_score')} AS fusion_score FROM cand"""),
    "velocity": picked(ONE_RUN, "velocity", "time_decay", "engagement", "freshness", "age"),
    "day_fallback": q(EV, POSTS, TERMS, *scored(DAWN, min_count=60, shape=False), body=f"""
SELECT post_id, day, week, month, day_used, {fixed('velocity')} AS velocity, {fixed('engagement')} AS engagement FROM score"""),
    "uplift": picked(ONE_RUN, "expected", "uplift_raw", "uplift"),
    "ewma": picked(TWO_RUNS, "ewma_val", "acc", "ewma"),
    "anti_gaming": picked(ONE_RUN, "penalty"),
    "trend_score": picked(TWO_RUNS, "raw_score", "capped"),
    "fatigue": q(*TWO_RUNS, recursive=True, body=f"SELECT post_id, pre_rank, streak, {fixed('fatigue')} AS fatigue, score_rank FROM score"),
    "fatigue_history": q(
        EV, """runs AS (SELECT d, d + to_hours(CAST(i AS INTEGER)) AS run_at
             FROM (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d FROM ev), range(1, 24) t(i))""",
        """seen AS (SELECT r.run_at, v.post_id, count(*) AS views FROM runs r JOIN ev v
             ON v.ts >= r.d + INTERVAL 1 MINUTE AND v.ts < r.run_at GROUP BY 1, 2)""",
        "hist AS (SELECT *, row_number() OVER (PARTITION BY run_at ORDER BY views DESC, post_id DESC) <= 20 AS in_top FROM seen)",
        """gaps AS (SELECT *, date_diff('minute', lag(run_at) OVER (PARTITION BY post_id ORDER BY run_at), run_at) > 480 AS late FROM hist)""",
        """isl AS (SELECT *, sum(CASE WHEN in_top AND NOT coalesce(late, false) THEN 0 ELSE 1 END) OVER (PARTITION BY post_id ORDER BY run_at) AS g FROM gaps)""",
        "st AS (SELECT *, count(*) FILTER (in_top) OVER (PARTITION BY post_id, g ORDER BY run_at) AS streak FROM isl)",
        body=f"""SELECT post_id, run_at, in_top, streak, {fixed('greatest(0.8::DOUBLE, 1 - greatest(0, streak - 6) * 0.03::DOUBLE)')} AS fatigue FROM st"""),
    "similarity": q(*E_COUNTS, TERMS, "ids AS (SELECT post_id, list(DISTINCT term_id) AS t FROM terms GROUP BY 1)",
                    "x AS (SELECT c.post_id, p.author_id, c.total, i.t FROM cnt c JOIN posts p USING (post_id) JOIN ids i USING (post_id) WHERE c.total IS NOT NULL)",
                    "lead AS (SELECT author_id, t FROM x QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY total DESC, post_id DESC) = 1)",
                    body=f"""SELECT x.post_id, x.author_id, {fixed('len(list_intersect(x.t, l.t)) / len(list_distinct(list_concat(x.t, l.t)))::DOUBLE')} AS similarity
FROM x JOIN lead l USING (author_id)"""),
    "mmr": q(*TWO_RUNS, MMR, recursive=True, body="SELECT post_id, CAST(pos AS INTEGER) AS mmr_position FROM by_mmr"),
    "explore": q(*TWO_RUNS, MMR, EXPLORE, recursive=True, body="SELECT post_id, CAST(pos AS INTEGER) AS explore_position FROM explored"),
    "diversity": q(*TWO_RUNS, MMR, EXPLORE, diversity("explored"), recursive=True,
                   body="SELECT post_id, CAST(position AS INTEGER) AS position FROM final"),
    "trending_full": q(*FULL, recursive=True, body=f"""
SELECT CAST(f.position AS INTEGER) AS position, f.post_id, {fixed('p.score', 3)} AS score, p.day AS views_day, p.week AS views_week,
       p.month AS views_month, p.total AS views_total, p.day_used AS views_day_used, CAST(p.day = 0 AS INTEGER) AS used_day_fallback,
       p.author_id, array_to_string(p.categories, ',') AS categories, array_to_string(p.tags, ',') AS tags
FROM final f JOIN pool p USING (post_id)"""),
    "trending_by_segment": q(
        "ev AS (SELECT l_partkey AS post_id, l_shipdate AS ts, 'view' AS event_type FROM lineitem)", PARTS, """terms AS (
  SELECT DISTINCT post_id, 'post_tag' AS taxonomy, unnest(string_split(title, ' ')) AS term_id FROM posts)""",
        *scored(PARTS_NOW, shape=False, seg="p.segment"), TERM_ARRAYS, mmr("VARCHAR"), diversity("by_mmr", "VARCHAR"),
        recursive=True, body=f"""
SELECT f.segment, CAST(f.position AS INTEGER) AS position, f.post_id, {fixed('p.score', 3)} AS score
FROM final f JOIN pool p USING (post_id)"""),
    "trend_state": q(
        *TWO_RUNS,
        f"""kept AS (SELECT post_id, ewma_val, TIMESTAMP '{BEFORE}' AS renewed, capped, CASE WHEN streak > 0 THEN streak END AS streak
                     FROM score0 WHERE post_id NOT IN (SELECT post_id FROM score))""",
        f"new AS (SELECT post_id, ewma_val, TIMESTAMP '{NOW}' AS renewed, capped, CASE WHEN streak > 0 THEN streak END AS streak FROM score)",
        recursive=True, body=f"""
SELECT post_id, {fixed('ewma_val')} AS ewma, renewed AS ewma_at, {fixed('capped')} AS last_score, CAST(streak AS INTEGER) AS streak
FROM (SELECT * FROM kept UNION ALL SELECT * FROM new)"""),
    "trending_debug": q(*TWO_RUNS, recursive=True, body=f"""
SELECT post_id, score_rank, {fixed('age', 2)} AS age_hours, {", ".join(f"{fixed(c, n)} AS {c}" for c, n in DEBUG_DIGITS.items())},
       streak AS fatigue_streak FROM score WHERE score_rank <= 50"""),
    "trending_refreshed": q(*TWO_RUNS, recursive=True, body=f"""
SELECT post_id, score_rank, {fixed('age', 2)} AS age_hours, {", ".join(f"{fixed(c, n)} AS {c}" for c, n in DEBUG_DIGITS.items())},
       streak AS fatigue_streak FROM score WHERE score_rank <= 50"""),
    "top_trending": q(*FULL, CATS, "s AS (SELECT f.*, p.score, p.day, row_number() OVER (ORDER BY p.score DESC, f.position) AS rank FROM final f JOIN pool p USING (post_id))",
                      recursive=True, body=f"""
SELECT s.rank, s.post_id AS id, p.title, c.total AS views, s.rank AS trending_position, {fixed('s.score', 3)} AS trending_score,
       s.day AS trending_views, k.category
FROM s JOIN posts p USING (post_id) JOIN cnt c USING (post_id) JOIN cats k USING (post_id)
WHERE s.rank BETWEEN 9 AND 16 AND p.post_type = 'post' AND p.status = 'publish'"""),
    "trending_overlay": q(*FULL, ranked("day"), recursive=True, body="""
SELECT r.rank, r.post_id AS id, r.views, f.post_id IS NOT NULL AS trending, CAST(f.position AS INTEGER) AS trending_position,
       CASE WHEN f.post_id IS NOT NULL THEN r.views END AS trending_views
FROM ranked r LEFT JOIN final f USING (post_id) WHERE r.rank <= 20"""),
    "stream_counters": q(EV, "x AS (SELECT post_id, ts - INTERVAL 1 MINUTE AS t FROM ev)", body="""
SELECT 'day' AS range, CAST(date_trunc('day', t) AS DATE) AS period, post_id, count(*) AS views FROM x GROUP BY ALL
UNION ALL SELECT 'week', CAST(date_trunc('week', t) AS DATE), post_id, count(*) FROM x GROUP BY ALL
UNION ALL SELECT 'month', CAST(date_trunc('month', t) AS DATE), post_id, count(*) FROM x GROUP BY ALL"""),
    **{f"stream_{u}s": q(EV, body=f"""SELECT '{u}' AS range, CAST(date_trunc('{u}', ts - INTERVAL 1 MINUTE) AS DATE) AS period,
       post_id, count(*) AS views FROM ev GROUP BY ALL""") for u in ("week", "month")},
    "stream_totals": q(EV, body="SELECT post_id, count(*) AS views FROM ev GROUP BY 1"),
    "stream_bins": q(EV, bins(min_daily=0, before="2025-01-01"), body=hour_rows()),
    "counters_advanced": q(*E_COUNTS, body="SELECT * FROM cnt"),
    "counters_partials": q(EV, POSTS, *[counts(t, f"at{i}") for i, t in enumerate(PAST)], body=" UNION ALL ".join(
        f"SELECT *, TIMESTAMP '{t}' AS as_of FROM at{i}" for i, t in enumerate(PAST))),
    "daily_late": q(EV, POSTS, counts("2024-01-29 00:01:00", "at29"), counts("2024-01-30 00:01:00", "at30"), body="""
SELECT *, TIMESTAMP '2024-01-29 00:01' AS as_of FROM at29 UNION ALL SELECT *, TIMESTAMP '2024-01-30 00:01' FROM at30"""),
    "daily_late_shape": q(EV, bins(), SHAPE_FOLD, LEARNED, recursive=True,
                          body=f"SELECT CAST(i AS BIGINT) AS slot, {fixed('h[i + 1]')} AS multiplier FROM learned, range(24) t(i)"),
    "daily_chain": q(EV, POSTS, counts("2024-01-30 00:01:00"), body="SELECT * FROM cnt"),
    "daily_chain_shape": q(EV, bins(), SHAPE_FOLD, LEARNED, recursive=True,
                           body=f"SELECT CAST(i AS BIGINT) AS slot, {fixed('h[i + 1]')} AS multiplier FROM learned, range(24) t(i)"),
    "pruned_counters": q(*E_COUNTS, body="SELECT post_id, day, yesterday FROM cnt"),
    "stream_ingest_strict": q(
        EV, POSTS, ADDRESS, requested(2), gated("'post', 'page'"),
        "passing AS (SELECT g.*, a.ip, g.event_id * 2 + g.slot AS seq FROM gate g JOIN addr a USING (event_id) WHERE reason IS NULL)",
        recent_list("passing"), recursive=True,
        body="""SELECT p.event_id, p.slot, p.post_id FROM passing p JOIN fold f USING (post_id, seq)
                WHERE NOT f.dup AND NOT starts_with(p.ip, '198.')"""),
    "stream_hours": q(EV, body="SELECT date_trunc('hour', ts) AS hour_start, count(*) AS views FROM ev GROUP BY 1"),
    "stream_viewer_index": q(EV, body="SELECT event_id, client_id, session_id, post_id FROM (" + FIRST.format(scope="client_id") + ")"),
    "stream_viewer_dedup": q(EV, body="SELECT DISTINCT session_id, post_id FROM ev"),
    "stream_viewer_dedup_client": q(EV, body="SELECT DISTINCT client_id, post_id FROM ev"),
    "stream_ip_dedup": q(EV, "src AS (SELECT *, event_id AS seq, client_id AS ip FROM ev)", recent_list("src"), recursive=True,
                         body="SELECT seq AS event_id, post_id, dup AS ip_duplicate FROM fold"),
    "stream_snapshot": q(EV, body="SELECT post_id, count(*) AS views FROM ev GROUP BY 1"),
    "stream_ip_in_order": q(EV, "src AS (SELECT *, event_id AS seq, client_id AS ip FROM ev)", recent_list("src"), recursive=True,
                            body="SELECT seq AS event_id, post_id, dup AS ip_duplicate FROM fold"),
    "stream_ingest": q(EV, POSTS, ADDRESS, CRC, HASHED, requested(2), gated("'post'"),
                       body="SELECT g.event_id, g.slot, g.post_id, h.ip_hash FROM gate g JOIN addr USING (event_id) JOIN hashed h USING (ip) WHERE g.reason IS NULL"),
}
