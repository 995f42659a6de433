"""Queries over the driver's tables, one per operator family, each beside its SQL.

``events`` serves as a device log: the event type is the device, the hour is the time, ``event_id`` orders the log and
its remainder by four is the commit; a deletion of three hours stands in commit 3 for every grave error, on the device
that its user stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import encodings, timeconv
from .operators import annotations, history, intervals, snapshot
from .types import DataType

HOUR = 3_600_000_000
SPAN = 2**32


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(column: str):
    return timeconv.wall_micros(F.col(column))


def _hour(column: str):
    """Hours since 1970, from a time without a zone."""
    at = F.col(column).cast("timestamp_ntz")
    return (F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)).cast("long")


def events_log(spark, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    cno = (F.lit(1) + F.pmod("event_id", F.lit(4))).cast("long")
    return e.select(F.col("event_type").alias("device"), _hour("ts").alias("t"), (cno * SPAN + F.col("event_id")).alias("seq"), cno.alias("cno"), "value", "user_id")


DEVICES = ("click", "error", "purchase", "signup", "view")


def events_deletions(spark, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").filter("event_type = 'error' AND value > 150")
    t, device = _hour("ts"), F.element_at(F.array(*map(F.lit, DEVICES)), (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    return e.select(device.alias("device"), t.alias("lo"), (t + 2).alias("hi"), F.lit(3 * SPAN + SPAN // 2).alias("seq"), F.lit(3).cast("long").alias("cno"))


def events_notes(spark, sf_dir: str) -> DataFrame:
    """Operations on annotations: every larger purchase puts one, on the device that its user stands for; in commit 3
    the largest are changed, in commit 4 those in between are removed."""
    e = _table(spark, sf_dir, "events").filter("event_type = 'purchase' AND value > 60")
    t, device = _hour("ts"), F.element_at(F.array(*map(F.lit, DEVICES)), (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    put = e.select("value", (F.col("event_id") + 1).alias("id"), F.lit("put").alias("op"), device.alias("device"), t.alias("lo"), (t + 12).alias("hi"), F.concat(F.lit("L"), F.pmod("event_id", F.lit(7)).cast("string")).alias("label"), F.lit(None).cast("string").alias("note"), (SPAN * 2 + F.col("event_id")).alias("seq"), F.lit(2).cast("long").alias("cno"))
    gone = put.filter("value BETWEEN 100 AND 150").select("id", F.lit("remove").alias("op"), "device", "lo", "hi", "label", "note", (F.col("seq") + 2 * SPAN).alias("seq"), F.lit(4).cast("long").alias("cno"))
    changed = put.filter("value > 150").select("id", "op", "device", "lo", (F.col("hi") + 1).alias("hi"), F.lit("changed").alias("label"), F.lit("later").alias("note"), (F.col("seq") + SPAN).alias("seq"), F.lit(3).cast("long").alias("cno"))
    return put.drop("value").unionByName(changed).unionByName(gone)


_DEVICE = "['click', 'error', 'purchase', 'signup', 'view'][user_id % 5 + 1]"
LOG = f"""log AS (
  SELECT event_type AS device, cast(floor(epoch_us(ts) / {HOUR}.0) AS bigint) AS t, 1 + event_id % 4 AS cno,
         (1 + event_id % 4) * {SPAN} + event_id AS seq, value, user_id FROM events
), tomb AS (
  SELECT {_DEVICE} AS device, cast(floor(epoch_us(ts) / {HOUR}.0) AS bigint) AS lo, cast(floor(epoch_us(ts) / {HOUR}.0) AS bigint) + 2 AS hi,
         3 AS cno, 3 * {SPAN} + {SPAN // 2} AS seq FROM events WHERE event_type = 'error' AND value > 150
)"""

NOTES = f"""put AS (
  SELECT event_id + 1 AS id, 'put' AS op, {_DEVICE} AS device, cast(floor(epoch_us(ts) / {HOUR}.0) AS bigint) AS lo,
         cast(floor(epoch_us(ts) / {HOUR}.0) AS bigint) + 12 AS hi, 'L' || cast(event_id % 7 AS varchar) AS label, cast(NULL AS varchar) AS note,
         2 * {SPAN} + event_id AS seq, cast(2 AS bigint) AS cno, value FROM events WHERE event_type = 'purchase' AND value > 60
), ops AS (
  SELECT * EXCLUDE (value) FROM put
  UNION ALL SELECT id, op, device, lo, hi + 1, 'changed', 'later', seq + {SPAN}, 3 FROM put WHERE value > 150
  UNION ALL SELECT id, 'remove', device, lo, hi, label, note, seq + 2 * {SPAN}, 4 FROM put WHERE value BETWEEN 100 AND 150
)"""


def _snap(version: int | None, name: str = "snap") -> str:
    upto = "" if version is None else f"AND l.cno <= {version}"
    upto_d = "" if version is None else f"AND d.cno <= {version}"
    return f"""{name} AS (
  SELECT device, t, value, user_id FROM (
    SELECT *, row_number() OVER (PARTITION BY device, t ORDER BY seq DESC) AS rn FROM log l WHERE true {upto} AND NOT EXISTS (
      SELECT 1 FROM tomb d WHERE d.device = l.device AND l.t BETWEEN d.lo AND d.hi AND d.seq > l.seq {upto_d}))
  WHERE rn = 1
)"""


def _state(version: int | None, name: str = "st") -> str:
    upto = "" if version is None else f"WHERE cno <= {version}"
    return f"""{name} AS (
  SELECT id, device, lo, hi, label, note FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ops {upto})
  WHERE rn = 1 AND op = 'put'
)"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where that can express it."""

    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


# ---- reading


def _versions(name: str, version: int | None):
    @query(name, f"WITH {LOG}, {_snap(version)} SELECT * FROM snap")
    def run(spark, sf_dir):
        return snapshot.snapshot(events_log(spark, sf_dir), events_deletions(spark, sf_dir), version)

    return run


snapshot_latest = _versions("snapshot_latest", None)
_versions("snapshot_asof", 3)
_versions("snapshot_asof_first", 1)
_versions("snapshot_empty", 0)

_LOW, _HIGH = 473_400, 475_000


@query("range_projection", f"WITH {LOG}, {_snap(3)} SELECT device, t, user_id FROM snap WHERE t BETWEEN {_LOW} AND {_HIGH}")
def range_projection(spark, sf_dir):
    return snapshot.snapshot(events_log(spark, sf_dir), events_deletions(spark, sf_dir), 3, ["user_id"], _LOW, _HIGH)


@query("point_count", f"WITH {LOG}, {_snap(3)} SELECT device, count(*) AS points FROM snap GROUP BY device")
def point_count(spark, sf_dir):
    return snapshot.count(events_log(spark, sf_dir), events_deletions(spark, sf_dir), 3)


@query("time_bounds", f"WITH {LOG}, {_snap(None)} SELECT device, min(t) AS first, max(t) AS last FROM snap GROUP BY device")
def time_bounds(spark, sf_dir):
    return snapshot.time_range(events_log(spark, sf_dir), events_deletions(spark, sf_dir))


@query("top_limit", f"WITH {LOG}, {_snap(3)} SELECT * FROM snap ORDER BY device, t LIMIT 100")
def top_limit(spark, sf_dir):
    return snapshot.top(snapshot.snapshot(events_log(spark, sf_dir), events_deletions(spark, sf_dir), 3), 100)


@query("deletions_by_bucket", f"WITH {LOG}, {_snap(None)} SELECT * FROM snap")
def deletions_by_bucket(spark, sf_dir):
    kept = snapshot.visible(events_log(spark, sf_dir), events_deletions(spark, sf_dir), shifts=(4, 14))
    return snapshot.newest(kept).select("device", "t", "value", "user_id")


@query(
    "interval_coalesce",
    f"""WITH {LOG}, a AS (
  SELECT device, lo, hi, max(hi) OVER (PARTITION BY device ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tomb
), b AS (
  SELECT device, lo, hi, sum(CASE WHEN reach IS NULL OR lo > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM a
) SELECT device, min(lo) AS lo, max(hi) AS hi FROM b GROUP BY device, g""",
)
def interval_coalesce(spark, sf_dir):
    return intervals.coalesce(events_deletions(spark, sf_dir).select("device", "lo", "hi"))


@query(
    "label_points",
    f"""WITH {LOG}, {NOTES}, {_snap(3)}, {_state(3)} SELECT s.device, s.t, s.value,
  (SELECT max_by(n.label, n.id) FROM st n WHERE n.device = s.device AND s.t BETWEEN n.lo AND n.hi) AS label FROM snap s""",
)
def label_points(spark, sf_dir):
    points = snapshot.snapshot(events_log(spark, sf_dir), events_deletions(spark, sf_dir), 3, ["value"])
    return intervals.label_points(points, annotations.state(events_notes(spark, sf_dir), 3))


# ---- history

_DIFF = f"""{LOG}, {_snap(2, "a")}, {_snap(4, "b")}, diff AS (
  SELECT coalesce(a.device, b.device) AS device, coalesce(a.t, b.t) AS t,
         CASE WHEN a.device IS NULL THEN 'added' WHEN b.device IS NULL THEN 'removed' ELSE 'changed' END AS kind,
         a.value AS before_value, b.value AS after_value, a.user_id AS before_user_id, b.user_id AS after_user_id
  FROM a FULL OUTER JOIN b ON a.device = b.device AND a.t = b.t
  WHERE a.device IS NULL OR b.device IS NULL OR a.value IS DISTINCT FROM b.value OR a.user_id IS DISTINCT FROM b.user_id
)"""


@query("version_diff", f"WITH {_DIFF} SELECT * FROM diff")
def version_diff(spark, sf_dir):
    return history.diff(events_log(spark, sf_dir), events_deletions(spark, sf_dir), 2, 4, touched_only=False)


@query("diff_touched_only", f"WITH {_DIFF} SELECT * FROM diff")
def diff_touched_only(spark, sf_dir):
    return history.diff(events_log(spark, sf_dir), events_deletions(spark, sf_dir), 2, 4)


@query("version_diff_summary", f"WITH {_DIFF} SELECT kind, count(*) AS points FROM diff GROUP BY kind")
def version_diff_summary(spark, sf_dir):
    return diff_touched_only(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("points"))


@query(
    "commit_changes",
    f"""WITH {LOG}, {NOTES}, parts AS (
  SELECT cno, 1 AS r, 0 AS d, 0 AS o, t FROM log UNION ALL SELECT cno, 0, 1, 0, NULL FROM tomb UNION ALL SELECT cno, 0, 0, 1, NULL FROM ops
) SELECT cast(cno AS bigint) AS cno, cast(sum(r) AS bigint) AS rows_written, min(t) AS t_min, max(t) AS t_max, cast(sum(d) AS bigint) AS ranges_deleted,
  cast(sum(o) AS bigint) AS annotation_ops FROM parts GROUP BY cno""",
)
def commit_changes(spark, sf_dir):
    return history.commit_changes(events_log(spark, sf_dir), events_deletions(spark, sf_dir), events_notes(spark, sf_dir))


def order_commits(spark, sf_dir: str) -> DataFrame:
    """A commit log from orders: one commit per order, with times that are not in the order of numbers."""
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("cno"), (_micros("o_orderdate") * 1000).alias("time_ns"), F.col("o_custkey").alias("who"))


@query("commit_at", "SELECT cast(coalesce(max(o_orderkey), 0) AS bigint) AS version FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01'")
def commit_at(spark, sf_dir):
    return history.commit_at(order_commits(spark, sf_dir), 801_964_800 * 10**9)


@query("annotation_state", f"WITH {NOTES}, {_state(3)} SELECT * FROM st")
def annotation_state(spark, sf_dir):
    return annotations.state(events_notes(spark, sf_dir), 3)


@query(
    "annotation_diff",
    f"""WITH {NOTES}, {_state(2, "a")}, {_state(None, "b")} SELECT coalesce(a.id, b.id) AS id,
  CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS kind,
  a.device AS before_device, a.lo AS before_lo, a.hi AS before_hi, a.label AS before_label, a.note AS before_note,
  b.device AS after_device, b.lo AS after_lo, b.hi AS after_hi, b.label AS after_label, b.note AS after_note
  FROM a FULL OUTER JOIN b ON a.id = b.id
  WHERE a.id IS NULL OR b.id IS NULL OR (a.device, a.lo, a.hi, a.label, coalesce(a.note, '?')) <> (b.device, b.lo, b.hi, b.label, coalesce(b.note, '?'))""",
)
def annotation_diff(spark, sf_dir):
    return annotations.diff(events_notes(spark, sf_dir), 2)


@query(
    "annotation_faults",
    f"""WITH {NOTES}, bad AS (
  SELECT * FROM ops
  UNION ALL SELECT event_id + 1, 'remove', event_type, 1, 2, NULL, NULL, 5 * {SPAN} + event_id, 5 FROM events WHERE event_type = 'signup' AND value > 150
  UNION ALL SELECT event_id + 1, 'put', event_type, 2, 1, 'x', NULL, 6 * {SPAN} + event_id, 5 FROM events WHERE event_type = 'view' AND value > 150
  UNION ALL SELECT id, 'remove', device, lo, hi, label, note, seq + 5 * {SPAN}, 5 FROM put WHERE value BETWEEN 100 AND 150
  UNION ALL SELECT -event_id, 'put', event_type, 1, 2, 'x', NULL, 7 * {SPAN} + event_id, 5 FROM events WHERE event_type = 'click' AND value > 150
), b AS (SELECT *, lag(op) OVER (PARTITION BY id ORDER BY seq) AS before FROM bad)
  SELECT * EXCLUDE (before) FROM b WHERE (op = 'remove' AND before IS DISTINCT FROM 'put') OR lo > hi OR id < 1""",
)
def annotation_faults(spark, sf_dir):
    """The log of annotations with removals of ids that were never there, or not any more, inverted ones and bad ids."""
    notes, e = events_notes(spark, sf_dir), _table(spark, sf_dir, "events").filter("value > 150")

    def more(kind, number, op, lo, hi, label, step):
        own = F.col("event_id")
        return e.filter(F.col("event_type") == kind).select(number(own).alias("id"), F.lit(op).alias("op"), F.col("event_type").alias("device"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), F.lit(label).cast("string").alias("label"), F.lit(None).cast("string").alias("note"), (F.lit(step * SPAN) + own).alias("seq"), F.lit(5).cast("long").alias("cno"))

    again = notes.filter("op = 'remove'").withColumn("seq", F.col("seq") + 3 * SPAN).withColumn("cno", F.lit(5).cast("long"))
    parts = [more("signup", lambda x: x + 1, "remove", 1, 2, None, 5), more("view", lambda x: x + 1, "put", 2, 1, "x", 6), more("click", lambda x: -x, "put", 1, 2, "x", 7), again]
    for p in parts:
        notes = notes.unionByName(p)
    return annotations.faults(notes)


_META = "WITH m AS (SELECT o_orderkey % 5 + 1 AS cno, o_orderkey AS seq, o_orderstatus AS a, o_orderpriority AS b FROM orders), l AS (SELECT arg_max(a, seq) AS a, arg_max(b, seq) AS b FROM m WHERE cno <= 3)"


@query("metadata_asof", f"{_META} SELECT 'status' AS key, a AS value FROM l UNION ALL SELECT 'priority', b FROM l")
def metadata_asof(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    entries = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return history.metadata_as_of(o.select((F.col("o_orderkey") % 5 + 1).alias("cno"), F.col("o_orderkey").alias("seq"), entries.alias("entries")), 3)


_CHAIN = f"""c AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS cno, cast(o_orderkey AS varchar) || o_orderstatus AS body, o_orderpriority FROM orders),
  h AS (SELECT *, sha256({history.DOMAIN.decode()[:-1]!r} || chr(10) || body) AS good FROM c),
  g AS (SELECT *, coalesce(lag(good) OVER (ORDER BY cno), '{history.ORIGIN}') AS prev FROM h),
  t AS (SELECT cno, body, CASE WHEN o_orderpriority = '1-URGENT' THEN upper(good) ELSE good END AS hash, prev AS prev_hash FROM g)"""


@query(
    "commit_chain",
    f"""WITH {_CHAIN}, b AS (SELECT *, coalesce(lag(hash) OVER (ORDER BY cno), '{history.ORIGIN}') AS expected, sha256({history.DOMAIN.decode()[:-1]!r} || chr(10) || body) AS own FROM t)
  SELECT cno, body, hash, prev_hash FROM b WHERE prev_hash <> expected OR hash <> own""",
)
def commit_chain(spark, sf_dir):
    """A chain of a commit per order in which those of one priority have had their hashes changed afterwards."""
    o = _table(spark, sf_dir, "orders")
    body = F.concat(F.col("o_orderkey").cast("string"), "o_orderstatus")
    number = F.row_number().over(W.orderBy("o_orderkey")).cast("long")
    good = o.select(number.alias("cno"), body.alias("body"), "o_orderpriority").withColumn("good", history.hash_column(F.col("body")))
    before = good.select((F.col("cno") + 1).alias("__n"), F.col("good").alias("prev"))
    chain = good.join(before, F.col("cno") == F.col("__n"), "left")
    spoilt = F.when(F.col("o_orderpriority") == "1-URGENT", F.upper("good")).otherwise(F.col("good"))
    return history.chain_faults(chain.select("cno", "body", spoilt.alias("hash"), F.coalesce("prev", F.lit(history.ORIGIN)).alias("prev_hash")))


# ---- editing: the versions that edits of the log give


@query(
    "update_cells",
    f"WITH {LOG}, {_snap(None)} SELECT device, t, CASE WHEN t % 10 = 0 THEN -1.0 ELSE value END AS value, user_id FROM snap",
)
def update_cells(spark, sf_dir):
    """An update writes whole rows: the cells it names, the others as they were."""
    log, gone = events_log(spark, sf_dir), events_deletions(spark, sf_dir)
    now = snapshot.snapshot(log, gone)
    new = now.filter("t % 10 = 0").select("device", "t", (F.lit(5 * SPAN) + F.col("t")).alias("seq"), F.lit(5).cast("long").alias("cno"), F.lit(-1.0).alias("value"), "user_id")
    return snapshot.snapshot(log.unionByName(new), gone)


@query(
    "insert_rows",
    f"""WITH {LOG}, new AS (SELECT device, t, 5 AS cno, 5 * {SPAN} + max(seq) % {SPAN} AS seq, cast(NULL AS double) AS value, cast(7 AS bigint) AS user_id FROM log WHERE t % 3 = 0 GROUP BY device, t),
  log2 AS (SELECT device, t, cno, seq, value, user_id FROM log UNION ALL SELECT * FROM new), {_snap(None).replace("FROM log l", "FROM log2 l")} SELECT * FROM snap""",
)
def insert_rows(spark, sf_dir):
    """An insert replaces the whole row; cells it does not name are null."""
    log = events_log(spark, sf_dir)
    new = log.filter("t % 3 = 0").groupBy("device", "t").agg((F.lit(5 * SPAN) + F.max("seq") % SPAN).alias("seq"))
    new = new.select("device", "t", "seq", F.lit(5).cast("long").alias("cno"), F.lit(None).cast("double").alias("value"), F.lit(7).cast("long").alias("user_id"))
    return snapshot.snapshot(log.unionByName(new), events_deletions(spark, sf_dir))


@query("delete_ranges", f"WITH {LOG}, {_snap(None)} SELECT * FROM snap WHERE NOT (device = 'click' AND t <= {_LOW + 300}) AND NOT (device = 'view' AND t >= {_LOW + 300})")
def delete_ranges(spark, sf_dir):
    gone = events_deletions(spark, sf_dir)
    more = spark.createDataFrame([("click", snapshot.LOW, _LOW + 300, 9 * SPAN, 5), ("view", _LOW + 300, snapshot.HIGH, 9 * SPAN + 1, 5)], gone.schema)
    return snapshot.snapshot(events_log(spark, sf_dir), gone.unionByName(more))


@query(
    "device_multi",
    """SELECT 'orders' AS device, count(DISTINCT o_orderkey) AS points, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders
  UNION ALL SELECT 'lines', count(DISTINCT l_orderkey * 8 + l_linenumber), min(l_orderkey * 8 + l_linenumber), max(l_orderkey * 8 + l_linenumber) FROM lineitem""",
)
def device_multi(spark, sf_dir):
    row = lambda t, name: t.select(F.lit(name).alias("device"), t[0].alias("t"), F.col("t").alias("seq"), F.lit(1).alias("cno"))
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"))
    li = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("t"))
    log = row(o, "orders").unionAll(row(li, "lines"))
    return snapshot.keys(log).groupBy("device").agg(F.count(F.lit(1)).alias("points"), F.min("t").alias("first"), F.max("t").alias("last"))


@query(
    "infer_csv_types",
    """SELECT 'o_orderkey' AS column_name, 'int64' AS type UNION ALL SELECT 'o_totalprice', 'float64' UNION ALL SELECT 'o_orderstatus', 'string'
  UNION ALL SELECT 'o_even', 'bool'""",
)
def infer_csv_types(spark, sf_dir):
    from .sources.text import infer_types

    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), "o_orderstatus", (F.col("o_orderkey") % 2 == 0).cast("string").alias("o_even"))
    return spark.createDataFrame([(n, t.label) for n, t in infer_types(o, o.columns).items()], "column_name string, type string")


# ---- encodings


def _user_series(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", _micros("ts").alias("us"))


@query(
    "rle_runs",
    """WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER w - 1 AS place, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  b AS (SELECT *, sum(CASE WHEN place = 0 OR event_type <> p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM a)
  SELECT user_id, cast(run AS bigint) AS run, cast(min(place) AS integer) AS start, count(*) AS length, first(event_type) AS value FROM b GROUP BY user_id, run""",
)
def rle_runs(spark, sf_dir):
    return encodings.runs(_user_series(spark, sf_dir), ["user_id"], "event_id", "event_type")


@query("rle_roundtrip", "SELECT user_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS bigint) AS pos, event_type AS value FROM events")
def rle_roundtrip(spark, sf_dir):
    return encodings.expand_runs(rle_runs(spark, sf_dir), ["user_id"])


_ZZ = "(CASE WHEN {0} >= 0 THEN 2 * {0}::hugeint ELSE -2 * {0}::hugeint - 1 END)"
_VAR = "greatest(1, cast(ceil((CASE WHEN {0} = 0 THEN 0 ELSE len(bin({0}::hugeint)) END) / 7.0) AS bigint))"


def _zz(x: str) -> str:
    return _ZZ.format(x)


def _var(x: str) -> str:
    return _VAR.format(x)


_DELTAS = """d0 AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER w - 1 AS pos, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  d AS (SELECT *, delta - lag(delta) OVER (PARTITION BY user_id ORDER BY event_id) AS dod FROM d0)"""


@query(
    "delta_of_delta_bits",
    f"""WITH {_DELTAS}, z AS (SELECT *, {_zz("dod")} AS z FROM d), s AS (
  SELECT user_id, count(*) AS n, cast(coalesce(sum(CASE WHEN pos >= 2 THEN CASE WHEN z < 1 THEN 1 WHEN z < 256 THEN 10 WHEN z < 65536 THEN 19 WHEN z < 4294967296 THEN 36 ELSE 68 END END), 0) AS bigint) AS dod_bits,
  sum(CASE pos WHEN 0 THEN {_var(_zz("us"))} WHEN 1 THEN {_var(_zz("delta"))} ELSE 0 END) AS head FROM z GROUP BY user_id)
  SELECT user_id, n, dod_bits, cast(head + ceil(dod_bits / 8.0) AS bigint) AS bytes FROM s""",
)
def delta_of_delta_bits(spark, sf_dir):
    return encodings.delta_of_delta_size(_user_series(spark, sf_dir), ["user_id"], "event_id", "us")


@query(
    "bitpack_widths",
    f"""WITH {_DELTAS}, g AS (SELECT user_id, cast((pos - 1) // 128 AS bigint) AS grp, count(*) AS n, min(delta) AS low, max(delta) - min(delta) AS span FROM d WHERE pos >= 1 GROUP BY user_id, (pos - 1) // 128),
  w AS (SELECT *, cast(CASE WHEN span = 0 THEN 0 ELSE len(bin(span::hugeint)) END AS integer) AS width FROM g)
  SELECT user_id, grp, n, low, width, cast({_var(_zz("low"))} + 1 + ceil(n * width / 8.0) AS bigint) AS bytes FROM w""",
)
def bitpack_widths(spark, sf_dir):
    return encodings.bitpack_groups(_user_series(spark, sf_dir), ["user_id"], "event_id", "us")


@query("undelta", "SELECT user_id, event_id, epoch_us(ts) AS value FROM events")
def undelta(spark, sf_dir):
    d = encodings.deltas(_user_series(spark, sf_dir), ["user_id"], "event_id", "us")
    return encodings.undelta(d, ["user_id"], "event_id", "us", "delta").select("user_id", "event_id", "value")


@query(
    "dictionary_codes",
    """WITH f AS (SELECT user_id, event_type AS value, min(event_id) AS f FROM events GROUP BY user_id, event_type)
  SELECT user_id, value, cast(row_number() OVER (PARTITION BY user_id ORDER BY f) - 1 AS integer) AS code FROM f""",
)
def dictionary_codes(spark, sf_dir):
    return encodings.dictionary_codes(_user_series(spark, sf_dir), ["user_id"], "event_id", "event_type")


@query(
    "encoding_choice",
    f"""WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type), s AS (
  SELECT user_id, cast(sum(c) AS bigint) AS n, count(*) AS k, sum({_var("octet_length(encode(event_type))")} + octet_length(encode(event_type))) AS texts FROM c GROUP BY user_id),
  p AS (SELECT user_id, cast(sum({_var("octet_length(encode(event_type))")} + octet_length(encode(event_type))) AS bigint) AS plain FROM events GROUP BY user_id),
  b AS (SELECT user_id, cast({_var("k")} + texts + ceil(n * (CASE WHEN k = 1 THEN 0 ELSE len(bin((k - 1)::hugeint)) END) / 8.0) AS bigint) AS dict, plain FROM s JOIN p USING (user_id))
  SELECT user_id, CASE WHEN dict <= plain THEN 'dictionary' ELSE 'plain' END AS encoding, least(dict, plain) AS bytes FROM b""",
)
def encoding_choice(spark, sf_dir):
    return encodings.choose_encoding(_user_series(spark, sf_dir), ["user_id"], "event_id", "event_type", DataType.STRING)


@query("segment_stats", "SELECT event_type, count(*) AS rows, count(*) FILTER (value IS NULL) AS nulls, min(value) FILTER (NOT isnan(value)) AS min, max(value) FILTER (NOT isnan(value)) AS max FROM events GROUP BY event_type")
def segment_stats(spark, sf_dir):
    return encodings.segment_stats(_table(spark, sf_dir, "events"), ["event_type"], "value", DataType.FLOAT64)


@query("xor_sizes")
def xor_sizes(spark, sf_dir):
    """Sequential windows over spans of the log's order; tested against a bit-by-bit version."""
    rows = encodings.time_blocks(_table(spark, sf_dir, "events"), "event_id", 20_000)
    return encodings.xor_size(rows, ["event_type", "block"], "event_id", "value")


# ---- times


@query("floor_units", "SELECT event_id, cast(floor(epoch_us(ts) / 1000.0) AS bigint) AS ms, cast(ceil(epoch_us(ts) / 1000000.0) AS bigint) AS s, epoch_us(ts) * 1000 AS ns FROM events")
def floor_units(spark, sf_dir):
    us = _micros("ts")
    return _table(spark, sf_dir, "events").select("event_id", timeconv.convert_units(us, "us", "ms", "floor").alias("ms"), timeconv.convert_units(us, "us", "s", "ceil").alias("s"), timeconv.convert_units(us, "us", "ns").alias("ns"))


@query("format_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, strftime(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS east FROM events")
def format_iso(spark, sf_dir):
    us = _micros("ts")
    return _table(spark, sf_dir, "events").select("event_id", timeconv.format_column(us, "us").alias("iso"), timeconv.format_column(timeconv.convert_units(us, "us", "s", "floor"), "s", "+05:30").alias("east"))


@query("parse_iso", "SELECT event_id, epoch_us(ts) * 1000 AS ns, epoch_us(ts) // 1000000 * 1000000000 - 3 * 3600 * 1000000000::bigint AS moscow FROM events")
def parse_iso(spark, sf_dir):
    us = _micros("ts")
    text = timeconv.format_column(us, "us")
    return _table(spark, sf_dir, "events").select("event_id", timeconv.parse_column(text).alias("ns"), timeconv.parse_column(F.substring(text, 1, 19), "Europe/Moscow").alias("moscow"))


@query("guess_unit", "SELECT event_type, 'us' AS guessed, CASE WHEN max(epoch_us(ts) * 1000 % 1000000) = 0 THEN 'ms' ELSE 'us' END AS coarsest FROM events GROUP BY event_type")
def guess_unit(spark, sf_dir):
    us = _micros("ts")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(timeconv.guess_unit(us).alias("guessed"), timeconv.coarsest_unit(us * 1000).alias("coarsest"))
