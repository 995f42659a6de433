"""Queries that go through stores, files and the command line, each beside its SQL.

One store holds the event log of :mod:`.queries`: a device per event type, times in seconds, four commits.  It is made
once for a session and its table folder; queries that change a store work on stores of their own.
"""

from __future__ import annotations

import contextlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .edit import Writer, device_schema
from .maintenance import recover, verify
from .operators import intervals
from .plans.files import Files, scratch
from .queries import _DIFF, DEVICES, LOG, NOTES, _snap, _state, _table, events_deletions, events_log, events_notes, query

S = 3600
_STORES: dict[tuple[str, str], str] = {}

#: Islands of the deletions of a device, as they are recorded.
_GONE = """reach AS (
  SELECT device, lo, hi, max(hi) OVER (PARTITION BY device ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM tomb
), isle AS (
  SELECT device, lo, hi, sum(CASE WHEN r IS NULL OR lo > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM reach
), gone AS (SELECT device, min(lo) AS lo, max(hi) AS hi FROM isle GROUP BY device, g)"""


def event_store(spark, sf_dir: str) -> store.File:
    """The store of the event log."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES or not Files(spark, _STORES[key]).exists():
        _STORES[key] = _build(spark, sf_dir)
    return store.open(_STORES[key], spark)


def _build(spark, sf_dir: str) -> str:
    log = events_log(spark, sf_dir).select("device", (F.col("t") * S).alias("t"), "value", "user_id", (F.col("value") > 100).alias("big"), "seq", "cno")
    gone = intervals.coalesce(events_deletions(spark, sf_dir)).orderBy("device", "lo").collect()
    notes = events_notes(spark, sf_dir).orderBy("seq").collect()
    path = scratch(spark, "events")
    with Writer.create(path, spark=spark) as w:
        for n in range(1, 5):
            for d in DEVICES:
                if n == 1:
                    w.create_device(device_schema(d, "s", {"value": "double", "user_id": "long", "big": "bool"}, time_name="t", timezone="UTC"))
                w.write_table(d, log.filter((F.col("cno") == n) & (F.col("device") == d)).drop("cno", "device"), time_column="t", unit="s", order_by="seq")
            for r in gone if n == 3 else ():
                w.delete_range(r.device, r.lo * S, r.hi * S + S - 1)
            for r in (x for x in notes if x.cno == n):
                if r.op == "remove":
                    w.remove_annotation(r.id)
                elif r.label == "changed":
                    w.update_annotation(r.id, None, r.hi * S, r.label, r.note)
                else:
                    w.restore_annotation(r.id, r.device, r.lo * S, r.hi * S, r.label)
            w.update_metadata({"commit": str(n), f"only {n}": "x"})
            if n == 4:
                w.remove_metadata("only 1")
            w.commit(f"part {n}", f"writer {n}", time_ns=n * 10**9)
    return path


def _all(spark, frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for d, frame in frames.items():
        frame = frame.withColumn("device", F.lit(d))
        out = frame if out is None else out.unionByName(frame)
    return out


def _values(spark, rows, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


_POINTS = f"SELECT device, t * {S} AS t, value, user_id, value > 100 AS big FROM snap"


# ---- reading


@query("store_roundtrip", f"WITH {LOG}, {_snap(3)} {_POINTS}")
def store_roundtrip(spark, sf_dir):
    f = event_store(spark, sf_dir)
    return _all(spark, {d: f.dataframe(d, as_of=3) for d in DEVICES})


@query("store_as_of_each", "WITH " + ", ".join([LOG, *(_snap(n, f"s{n}") for n in range(1, 5))]) + " " + " UNION ALL ".join(f"SELECT {n} AS version, device, count(*) AS points FROM s{n} GROUP BY device" for n in range(1, 5)))
def store_as_of_each(spark, sf_dir):
    """Counts on keys, by version."""
    f = event_store(spark, sf_dir)
    rows = [(n, d, f.count(d, as_of=n)) for n in range(1, 5) for d in DEVICES]
    return _values(spark, [r for r in rows if r[2]], "version int, device string, points long")


_LOW, _HIGH = 473_400 * S, 475_000 * S
_CASES = {"closed": (473_400, 473_500), "inverted": (473_500, 473_400), "from": (473_500, None), "upto": (None, 473_500), "one": (473_450, 473_450)}


def _where(lo, hi) -> str:
    return " AND ".join([*([f"t >= {lo}"] if lo is not None else []), *([f"t <= {hi}"] if hi is not None else [])])


@query("store_ranges", f"WITH {LOG}, {_snap(None)} " + " UNION ALL ".join(f"SELECT '{k}' AS bounds, device, t * {S} AS t, user_id FROM snap WHERE {_where(*v)}" for k, v in _CASES.items()))
def store_ranges(spark, sf_dir):
    """Closed, open and inverted ranges of raw times, with a projection."""
    f, out = event_store(spark, sf_dir), None
    for name, (lo, hi) in _CASES.items():
        one = {d: f.dataframe(d, columns=["user_id"], start=None if lo is None else lo * S, end=None if hi is None else hi * S) for d in DEVICES}
        part = _all(spark, one).withColumn("bounds", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("any_time_bounds", f"WITH {LOG}, {_snap(None)} SELECT device, t * {S} AS t, value FROM snap WHERE t * {S} BETWEEN epoch(TIMESTAMP '2024-01-05 09:30:00') AND epoch(TIMESTAMP '2024-01-20 00:00:00')")
def any_time_bounds(spark, sf_dir):
    """Bounds as a text with an offset and as a datetime, rounded inwards."""
    import datetime as dt

    f = event_store(spark, sf_dir)
    end = dt.datetime(2024, 1, 20, 0, 0, 0, 500_000, dt.UTC)
    return _all(spark, {d: f.dataframe(d, columns=["value"], start="2024-01-05T12:29:59.5+03:00", end=end) for d in DEVICES})


@query("collect_batch", f"WITH {LOG}, {_snap(2)} SELECT t * {S} AS t, value, user_id, value > 100 AS big FROM snap WHERE device = 'view'")
def collect_batch(spark, sf_dir):
    """A whole device as one batch on the driver."""
    b = event_store(spark, sf_dir).query("view", as_of=2).collect()
    return spark.createDataFrame(pa.table({"t": pa.array(b.times), **{n: c.array for n, c in b.columns.items()}}))


@query("stream_batches", f"WITH {LOG}, {_snap(None)}, n AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY t) - 1 AS k FROM snap) SELECT device, cast(k // 100 AS integer) AS batch, count(*) AS rows, min(t) * {S} AS first, max(t) * {S} AS last, sum(user_id)::bigint AS users FROM n GROUP BY device, k // 100")
def stream_batches(spark, sf_dir):
    """Every device in batches of a hundred rows, in the order of time."""
    f, rows = event_store(spark, sf_dir), []
    for d in DEVICES:
        for k, b in enumerate(f.query(d).batches(100)):
            rows.append((d, k, len(b), int(b.times[0]), int(b.times[-1]), sum(b["user_id"])))
    return _values(spark, rows, "device string, batch int, rows long, first long, last long, users long")


@query("reader_shorthand", f"WITH {LOG}, {_snap(3)} SELECT t * {S} AS t, value FROM snap WHERE device = 'click' AND t * {S} BETWEEN {_LOW} AND {_HIGH}")
def reader_shorthand(spark, sf_dir):
    b = event_store(spark, sf_dir).reader().read("click", ["value"], _LOW, _HIGH, 3)
    return spark.createDataFrame(pa.table({"t": pa.array(b.times), "value": b["value"].array}))


@query("store_bounds", f"WITH {LOG}, {_snap(None)} SELECT device, min(t) * {S} AS first, max(t) * {S} AS last FROM snap GROUP BY device")
def store_bounds(spark, sf_dir):
    f = event_store(spark, sf_dir)
    return _values(spark, [(d, *f.time_range(d)) for d in DEVICES if f.time_range(d)], "device string, first long, last long")


@query("store_sinks", f"WITH {LOG}, {_snap(None)}, c AS (SELECT device, count(*) AS rows, sum(user_id)::bigint AS users, min(t) * {S} AS first FROM snap WHERE device IN ('click', 'view') GROUP BY device) SELECT sink, c.* FROM c, (VALUES ('arrow'), ('batches'), ('dict'), ('pandas'), ('reader')) s(sink)")
def store_sinks(spark, sf_dir):
    """Two devices as Arrow table, record batches, lists, pandas frame and through the module functions."""
    f, rows = event_store(spark, sf_dir), []
    stamp = lambda x: x.cast(pa.timestamp("s", tz="UTC")).cast(pa.int64())
    for d in ("click", "view"):
        table, read = f.read_arrow(d), store.read_arrow(f.path, d, spark=spark)
        if not len(table):
            continue
        again = store.read_batches(f.path, d, spark=spark).read_all()
        frame, lists = f.read_pandas(d), f.read(d).to_dict()
        rows += [(k, d, len(x), sum(x.column("user_id").to_pylist()), stamp(x.column("t"))[0].as_py()) for k, x in (("arrow", table), ("reader", read), ("batches", again))]
        rows += [("pandas", d, len(frame), int(frame["user_id"].sum()), int(frame.index[0].timestamp())), ("dict", d, len(lists["t"]), sum(lists["user_id"]), lists["t"][0])]
    return _values(spark, rows, "sink string, device string, rows long, users long, first long")


@query("store_devices", "SELECT d AS device, n AS version, n > 0 AS present, 't' AS time_name, 3 AS columns FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) x(d), (VALUES (0), (1), (4)) y(n)")
def store_devices(spark, sf_dir):
    r = event_store(spark, sf_dir).reader()
    rows = [(s.name, n, r.device_exists_at(s.name, n), s.time_name, len(s.columns)) for s in r.devices for n in (0, 1, 4)]
    return _values(spark, rows, "device string, version int, present boolean, time_name string, columns int")


@query("store_metadata", "SELECT n AS version, 'commit' AS key, cast(n AS varchar) AS value FROM range(1, 5) r(n) UNION ALL SELECT n, 'only ' || k, 'x' FROM range(1, 5) r(n), range(1, 5) s(k) WHERE k <= n AND NOT (n = 4 AND k = 1)")
def store_metadata(spark, sf_dir):
    r = event_store(spark, sf_dir).reader()
    return _values(spark, [(n, k, v) for n in range(1, 5) for k, v in r.metadata_as_of(n).items()], "version long, key string, value string")


# ---- history


@query("store_diff", f"WITH {_DIFF} SELECT device, t * {S} AS t, kind, before_value, after_value, before_user_id, after_user_id, before_value > 100 AS before_big, after_value > 100 AS after_big FROM diff")
def store_diff(spark, sf_dir):
    r = event_store(spark, sf_dir).reader()
    return _all(spark, {d: r.diff_frame(d, 2, 4) for d in DEVICES})


@query("diff_on_driver", f"WITH {_DIFF}, {NOTES}, {_state(2, 'x')}, {_state(4, 'y')}, m AS (SELECT coalesce(x.device, y.device) AS device, CASE WHEN x.id IS NULL THEN 'added' WHEN y.id IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM x FULL OUTER JOIN y ON x.id = y.id WHERE x.id IS NULL OR y.id IS NULL OR x.label <> y.label) SELECT device, 'point' AS what, kind, count(*) AS n FROM diff GROUP BY device, kind UNION ALL SELECT device, 'annotation', kind, count(*) FROM m GROUP BY device, kind")
def diff_on_driver(spark, sf_dir):
    """Points and annotations that differ, as objects."""
    from collections import Counter

    f, n = event_store(spark, sf_dir), Counter()
    for d in DEVICES:
        own = f.diff(2, 4, d)
        n.update((d, "point", p.kind) for p in own.points)
        n.update((d, "annotation", a.kind) for a in own.annotations)
    return _values(spark, [(*k, v) for k, v in n.items()], "device string, what string, kind string, n long")


@query(
    "store_commits",
    f"""WITH {LOG}, {_GONE}, {NOTES} SELECT cast(l.cno AS bigint) AS number, 'part ' || l.cno AS message, 'writer ' || l.cno AS author, l.cno * 1000000000 AS time_ns,
  count(DISTINCT (l.device, l.t)) AS rows_written, CASE WHEN l.cno = 3 THEN (SELECT count(*) FROM gone) ELSE 0 END AS ranges_deleted,
  (SELECT count(*) FROM ops WHERE ops.cno = l.cno) AS annotation_ops, CASE WHEN l.cno = 1 THEN 5 ELSE 0 END AS devices_created FROM log l GROUP BY l.cno""",
)
def store_commits(spark, sf_dir):
    rows = [(c.number, c.message, c.author, c.time_ns, c.changes.rows_written, c.changes.ranges_deleted, c.changes.annotation_ops, len(c.changes.devices_created)) for c in event_store(spark, sf_dir).commits()]
    return _values(spark, rows, "number long, message string, author string, time_ns long, rows_written long, ranges_deleted long, annotation_ops long, devices_created int")


@query("commit_lookup", "SELECT what, cast(n AS bigint) AS number FROM (VALUES ('commit', 2), ('head', 4), ('at 0.5 s', 0), ('at 2.5 s', 2), ('at 1970-01-01T00:00:03Z', 3), ('first of 3', 3), ('last of 3', 3), ('beyond', -1), ('chain', 4)) v(what, n)")
def commit_lookup(spark, sf_dir):
    """Commits by number, moment and place of the log; the number that continue the one before."""
    f = event_store(spark, sf_dir)
    r = f.reader()
    ends = [m.next_seq for m in r.catalog.manifests]
    of = lambda s: r.commit_of(s) or -1
    before = [r.catalog.origin, *(c.hash for c in r.commits())]
    rows = [("commit", r.commit(2).number), ("head", f.head.number), ("at 0.5 s", f.commit_at(5 * 10**8)), ("at 2.5 s", f.commit_at(25 * 10**8)), ("at 1970-01-01T00:00:03Z", f.commit_at("1970-01-01T00:00:03Z")), ("first of 3", of(ends[1])), ("last of 3", of(ends[2] - 1)), ("beyond", of(ends[3])), ("chain", sum(c.prev_hash == h for c, h in zip(r.commits(), before)))]
    return _values(spark, rows, "what string, number long")


@query("store_blocks", f"WITH {LOG} SELECT device, cast(cno AS bigint) AS commit, count(DISTINCT t) AS rows, min(t) * {S} AS first, max(t) * {S} AS last FROM log GROUP BY device, cno")
def store_blocks(spark, sf_dir):
    """Rows and bounds of each commit's files, from the manifests."""
    r = event_store(spark, sf_dir).reader()
    rows = [(d, b.commit, b.rows, b.t_min, b.t_max) for d in DEVICES for b in r.blocks(d)]
    return _values(spark, rows, "device string, commit long, rows long, first long, last long").groupBy("device", "commit").agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))


# ---- annotations


@query("store_annotations", f"WITH {NOTES}, " + ", ".join(_state(n, f"s{n}") for n in (2, 3, 4)) + " " + " UNION ALL ".join(f"SELECT {n} AS version, id, device, lo * {S} AS lo, hi * {S} AS hi, label, note FROM s{n}" for n in (2, 3, 4)))
def store_annotations(spark, sf_dir):
    """Annotations that the writer has added with ids, updated and removed, at three versions."""
    r, rows = event_store(spark, sf_dir).reader(), []
    for n in (2, 3, 4):
        rows += [(n, a.id, a.device, a.start, a.end, a.label, a.note) for a in r.annotations(as_of=n)]
    return _values(spark, rows, "version int, id long, device string, lo long, hi long, label string, note string")


@query("live_annotations", f"WITH {NOTES}, {_state(None)} SELECT id, device, lo * {S} AS lo, hi * {S} AS hi, label, note FROM st")
def live_annotations(spark, sf_dir):
    """The state that an open writer works on."""
    with event_store(spark, sf_dir).writer() as w:
        rows = [(k, *v) for k, v in w.annotations().items()]
    return _values(spark, rows, "id long, device string, lo long, hi long, label string, note string")


@query("store_annotation_diff", f"WITH {NOTES}, {_state(2, 'a')}, {_state(4, 'b')} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS kind, a.label AS before_label, b.label AS after_label, a.hi * {S} AS before_hi, b.hi * {S} AS after_hi FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.label <> b.label")
def store_annotation_diff(spark, sf_dir):
    return event_store(spark, sf_dir).reader().annotation_diff_frame(2, 4).select("id", "kind", "before_label", "after_label", "before_hi", "after_hi")


@query("store_labelled", f"WITH {LOG}, {NOTES}, {_snap(3)}, {_state(3)} SELECT s.device, s.t * {S} AS t, s.user_id, (SELECT max_by(n.label, n.id) FROM st n WHERE n.device = s.device AND s.t BETWEEN n.lo AND n.hi) AS label FROM snap s")
def store_labelled(spark, sf_dir):
    f = event_store(spark, sf_dir)
    return _all(spark, {d: f.labelled(d, as_of=3).select("t", "user_id", "label") for d in DEVICES})


# ---- editing


_MADE: dict[tuple[str, str, str], str] = {}


def _once(spark, sf_dir: str, name: str, make) -> str:
    """The path of a store that is made once for a session and its tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE or not Files(spark, _MADE[key]).exists():
        _MADE[key] = make().path
    return _MADE[key]


def _copy(spark, sf_dir: str) -> store.File:
    """A store of one's own with the newest version."""
    own = Files(spark, _once(spark, sf_dir, "compact", lambda: event_store(spark, sf_dir).compact(scratch(spark, "compact"))))
    target = scratch(spark, "copy")
    own.jvm.org.apache.hadoop.fs.FileUtil.copy(own.fs, own.path(), own.fs, own.jvm.org.apache.hadoop.fs.Path(target), False, own.conf)
    return store.open(target, spark)


@query("compact_snapshot", f"WITH {LOG}, {_snap(None)} {_POINTS}")
def compact_snapshot(spark, sf_dir):
    f = event_store(spark, sf_dir)
    f = f.compact(scratch(spark, "compact"))
    return _all(spark, {d: f.dataframe(d) for d in DEVICES})


_EDITED = f"""edited AS (
  SELECT device, t * {S} AS t, CASE WHEN device = 'view' AND value > 100 THEN -1.0 ELSE value END AS value, user_id, value > 100 AS big FROM snap
  WHERE NOT (device = 'view' AND value < 2) AND NOT (device = 'error' AND t >= 473600)
  UNION ALL SELECT 'signup', k, 0.5, NULL, NULL FROM range(1, 6) r(k)
)"""


def _edited(spark, sf_dir: str) -> store.File:
    return store.open(_once(spark, sf_dir, "edited", lambda: _edit(spark, sf_dir)), spark)


def _edit(spark, sf_dir: str) -> store.File:
    """Cells of points set, points and a range deleted, rows inserted and a label set, in one transaction."""
    f = _copy(spark, sf_dir)
    own = f.read("view")
    with f.edit("edited", "me") as tx:
        for t, v in zip(own.times.tolist(), own["value"]):
            if v > 100:
                tx.update("view", t, value=-1.0)
            if v < 2:
                tx.delete("view", t)
        tx.delete_range("error", 473_600 * S, None)
        for k in range(1, 6):
            tx.insert("signup", k, value=0.5)
        tx.annotate("signup", 1, 5, "early")
        tx.set_metadata("edited", "yes")
    return f


@query("edit_transaction", f"WITH {LOG}, {_snap(None)}, {_EDITED} SELECT * FROM edited")
def edit_transaction(spark, sf_dir):
    f = _edited(spark, sf_dir)
    return _all(spark, {d: f.dataframe(d) for d in DEVICES})


@query("edit_commit", f"WITH {LOG}, {_snap(None)}, v AS (SELECT count(*) FILTER (value > 100) AS u, count(*) FILTER (value < 2) AS d FROM snap WHERE device = 'view') SELECT 'edited' AS message, 'me' AS author, u + 5 AS rows_written, d + 1 AS ranges_deleted, cast(1 AS bigint) AS annotation_ops, true AS metadata_changed, 'early' AS label FROM v")
def edit_commit(spark, sf_dir):
    """What the transaction's one commit says of itself."""
    f = _edited(spark, sf_dir)
    c = f.head
    label = max(f.annotations("signup"), key=lambda a: a.id).label
    return _values(spark, [(c.message, c.author, c.changes.rows_written, c.changes.ranges_deleted, c.changes.annotation_ops, c.changes.metadata_changed, label)], "message string, author string, rows_written long, ranges_deleted long, annotation_ops long, metadata_changed boolean, label string")


@query("own_writes", "SELECT step, cast(value AS double) AS value FROM (VALUES ('before', NULL), ('written', 7.0), ('updated', 8.0), ('deleted', NULL), ('again', 9.0), ('rolled back', NULL), ('committed', 5.0)) v(step, value)")
def own_writes(spark, sf_dir):
    """What a writer sees of its own changes, and what a rollback leaves."""
    path, rows = scratch(spark, "own"), []
    with Writer.create(path, spark=spark) as w:
        w.create_device(device_schema("d", "s", {"value": "double", "n": "int32"}))
        w.commit()
        see = lambda step: rows.append((step, (w.get("d", 1) or {}).get("value")))
        see("before")
        w.write("d", {"time": [1, 2, 1], "value": [1.0, 2.0, 7.0]})
        see("written")
        w.update("d", 1, value=8)
        see("updated")
        w.delete("d", 1)
        see("deleted")
        w.write_row("d", 1, value=9.0)
        see("again")
        assert w.has_pending_changes
        w.rollback()
        assert not w.has_pending_changes
        see("rolled back")
        w.write_row("d", 1, {"value": 5})
    rows.append(("committed", store.open(path, spark).read()["value"][0]))
    return _values(spark, rows, "step string, value double")


@query("last_write_wins", f"WITH {LOG}, c AS (SELECT t, arg_max(value, seq) AS value, arg_max(user_id, seq) AS user_id FROM log WHERE device = 'click' GROUP BY t) SELECT t * {S} AS t, value, user_id FROM c")
def last_write_wins(spark, sf_dir):
    """All rows of a device in one batch, in log order: of equal times the last stays."""
    rows = events_log(spark, sf_dir).filter("device = 'click'").orderBy("seq").select((F.col("t") * S).alias("t"), "value", "user_id").toArrow()
    path = scratch(spark, "wins")
    with Writer.create(path, spark=spark, rows_per_block=200, max_block_bytes=100_000) as w:
        w.create_device(device_schema("click", "s", {"value": "double", "user_id": "long"}, time_name="t"))
        w.write("click", {k: rows.column(k).to_pylist() for k in rows.column_names})
    return store.open(path, spark).dataframe()


@query("write_modes", f"WITH {LOG}, c AS (SELECT * FROM log WHERE device = 'view') SELECT 'x' AS mode, count(DISTINCT t) AS points, 1 AS commits FROM c WHERE cno = 1 UNION ALL SELECT 'a', count(DISTINCT t), 2 FROM c WHERE cno <= 2 UNION ALL SELECT 'w', count(DISTINCT t), 1 FROM c WHERE cno = 3 UNION ALL SELECT 'x again', 0, 0")
def write_modes(spark, sf_dir):
    log = events_log(spark, sf_dir).filter("device = 'view'").select((F.col("t") * S).alias("t"), "value", "seq", "cno")
    path, rows = scratch(spark, "modes"), []
    for n, mode in enumerate(("x", "a", "w"), 1):
        store.write(path, log.filter(F.col("cno") == n).drop("cno"), "view", time_column="t", unit="s", mode=mode, order_by="seq", spark=spark)
        f = store.open(path, spark)
        rows.append((mode, f.count(), len(f.commits())))
    try:
        store.write(path, log.drop("cno"), "view", time_column="t", unit="s", mode="x", order_by="seq", spark=spark)
    except FileExistsError:
        rows.append(("x again", 0, 0))
    return _values(spark, rows, "mode string, points long, commits int")


@query("pinned_readers", f"WITH {LOG}, {_snap(None)} SELECT 'pinned' AS reader, count(*) AS points FROM snap WHERE device = 'click' UNION ALL SELECT 'not reloaded', count(*) + 1 FROM snap WHERE device = 'click' UNION ALL SELECT 'locked out', 1")
def pinned_readers(spark, sf_dir):
    """A reader keeps its version while others commit; a second writer is kept out meanwhile."""
    from .errors import LockedError

    f, rows = _copy(spark, sf_dir), []
    r = f.reader()
    with f.writer() as w:
        w.write_row("click", 1, value=1.0)
        try:
            f.writer()
        except LockedError:
            rows.append(("locked out", 1))
    return _values(spark, [*rows, ("pinned", r.query("click").count()), ("not reloaded", f.count("click"))], "reader string, points long")


# ---- sources and texts


@query("source_kinds", f"WITH {LOG}, c AS (SELECT t, arg_max(value, seq) AS value, arg_max(user_id, seq) AS user_id FROM log WHERE device = 'signup' GROUP BY t) SELECT kind AS source, count(*) AS points, min(t) * {S} AS first, sum(user_id)::bigint AS users FROM c, (VALUES ('arrow'), ('batches'), ('list'), ('mapping'), ('pandas'), ('spark')) k(kind) GROUP BY kind")
def source_kinds(spark, sf_dir):
    """The same rows as a Spark frame, Arrow table, record batch reader, pandas frame, mapping and list of batches."""
    from .operators.snapshot import newest

    log = events_log(spark, sf_dir).filter("device = 'signup'")
    frame = newest(log, ["t"]).select((F.col("t") * S).alias("ts"), "value", "user_id")
    table = frame.orderBy("ts").toArrow()
    pandas = table.to_pandas()
    half = len(table) // 2
    kinds = {"spark": frame, "arrow": table, "batches": pa.RecordBatchReader.from_batches(table.schema, table.to_batches(100)), "pandas": pandas, "mapping": {c: table.column(c).to_pylist() for c in table.column_names}, "list": [table.slice(0, half), table.slice(half)]}
    path, rows = scratch(spark, "kinds"), []
    with Writer.create(path, spark=spark) as w:
        for name, data in kinds.items():
            w.write_table(name, data, unit="s", create=True)  # the time column is guessed
    f = store.open(path, spark)
    for name in kinds:
        one = f.dataframe(name).agg(F.count(F.lit(1)), F.min("t"), F.sum("user_id")).first()
        rows.append((name, *one))
    return _values(spark, rows, "source string, points long, first long, users long")


@query("csv_roundtrip", f"WITH {LOG}, {_snap(None)} SELECT t * {S} * 1000 AS t, value, user_id, value > 100 AS big FROM snap WHERE device = 'purchase'")
def csv_roundtrip(spark, sf_dir):
    """A device written as CSV files with ISO times and read again, in milliseconds, its types inferred."""
    from .sources.text import export_csv_files, import_csv

    f = event_store(spark, sf_dir)
    text, path = scratch(spark, "csv"), scratch(spark, "imported")
    export_csv_files(f.dataframe("purchase"), f.device("purchase"), text)
    import_csv(text, path, "purchase", time_column="t", spark=spark)
    return store.open(path, spark).dataframe()


@query("json_lines", f"WITH {LOG}, {_snap(None)} SELECT t * {S} AS t, user_id, value > 100 AS big FROM snap WHERE device = 'error'")
def json_lines(spark, sf_dir):
    import json

    from .sources.text import export_json

    f, out = event_store(spark, sf_dir), io.StringIO()
    export_json(f.dataframe("error"), f.device("error"), out, raw_time=True)
    rows = [json.loads(line) for line in out.getvalue().splitlines()]
    return _values(spark, [(r["t"], r["user_id"], r["big"]) for r in rows], "t long, user_id long, big boolean")


@query("csv_lines", f"WITH {LOG}, {_snap(None)} SELECT 't,user_id,big' AS line, 1 AS n UNION ALL SELECT (t * {S}) || ',' || user_id || ',' || (value > 100), count(*) FROM snap WHERE device = 'click' GROUP BY ALL")
def csv_lines(spark, sf_dir):
    """The lines of a CSV text with raw times."""
    from .sources.text import export_csv

    q, out = event_store(spark, sf_dir).query("click", columns=["user_id", "big"]), io.StringIO()
    export_csv(q.dataframe(), q.result_schema, out, raw_time=True)
    return _values(spark, [(x, 1) for x in out.getvalue().splitlines()], "line string, n long")


# ---- streams and upkeep


@query("collector_batches", f"WITH {LOG}, c AS (SELECT t, arg_max(value, seq) AS value FROM log WHERE device = 'view' GROUP BY t), l AS (SELECT count(*) AS commits FROM (SELECT DISTINCT cno FROM log WHERE device = 'view')) SELECT t * {S} AS t, value, commits FROM c, l")
def collector_batches(spark, sf_dir):
    """Four micro-batches, each given twice: the second time does nothing."""
    from .streaming.collector import append_batch

    log = events_log(spark, sf_dir).filter("device = 'view'").select((F.col("t") * S).alias("t"), "value", "seq", "cno")
    path = scratch(spark, "collected")
    store.create(path, device_schema("view", "s", {"value": "double"}, time_name="t"), spark=spark)
    for n in (1, 1, 2, 2, 3, 4, 4):
        append_batch(path, "view", log.filter(F.col("cno") == n).drop("cno"), n, "events", time_column="t", unit="s", order_by="seq")
    f = store.open(path, spark)
    return f.dataframe().withColumn("commits", F.lit(len(f.commits()) - 1).cast("long"))


@query("verify_store", f"WITH {LOG} SELECT true AS ok, cast(4 AS bigint) AS commits, count(DISTINCT (device, t, cno)) AS rows, 0 AS problems, 0 AS warnings FROM log")
def verify_store(spark, sf_dir):
    r = verify(event_store(spark, sf_dir).path, spark)
    return _values(spark, [(r.ok, r.commits, r.rows, len(r.problems), len(r.warnings))], "ok boolean, commits long, rows long, problems int, warnings int")


@query("recover_store", f"WITH {LOG}, {_snap(None)} SELECT 2 AS files_removed, 1 AS commits_cut, count(*) AS points FROM snap WHERE device = 'view'")
def recover_store(spark, sf_dir):
    """Files of an unfinished commit go, and a last manifest that breaks off."""
    f = _copy(spark, sf_dir)
    files = Files(spark, f.path)
    files.create("points/9/000000000002-x/part-0.parquet", "unfinished")
    files.create("_log/000000000002.json.x.tmp", "{")
    files.create("_log/000000000002.json", '{"number": 2, "time_')
    r = recover(f.path, spark=spark)
    return _values(spark, [(r.removed_files, r.removed_commits, store.open(f.path, spark).count("view"))], "files_removed int, commits_cut int, points long")


@query("segment_sizes", f"WITH {LOG} SELECT device, c AS column_name, count(DISTINCT (t, cno)) AS rows FROM log, (VALUES ('value'), ('user_id'), ('big')) v(c) GROUP BY device, c")
def segment_sizes(spark, sf_dir):
    """Rows of each column's segments, from the files' footers."""
    r = event_store(spark, sf_dir).reader()
    out = _all(spark, {d: r.segments(d) for d in DEVICES})
    return out.filter(F.col("column").isin("value", "user_id", "big")).groupBy("device", F.col("column").alias("column_name")).agg(F.sum("rows").alias("rows"))


_COMMANDS = (
    ["info", "{}"],
    ["cat", "{}", "--device", "click", "--limit", "3"],
    ["insert", "{}", "--device", "click", "--time", "5", "value=1.5", "big=yes"],
    ["update", "{}", "--device", "click", "--time", "5", "value=2.5"],
    ["annotate", "{}", "--device", "click", "--start", "1", "--end", "9", "--label", "first"],
    ["annotations", "{}", "--device", "click"],
    ["delete", "{}", "--device", "click", "--time", "5"],
    ["log", "{}"],
    ["diff", "{}", "--device", "click", "--from", "1", "--to", "3"],
    ["verify", "{}"],
    ["recover", "{}"],
    ["compact", "{}", "{}-small"],
    ["update", "{}", "--device", "click", "--time", "6", "value=1"],
    ["insert", "{}", "--device", "click", "--time", "6", "colour=1"],
)


@query(
    "command_line",
    f"""WITH {LOG}, {_snap(None)}, {NOTES}, {_state(None)} SELECT * FROM (VALUES ('cat', 0, 4), ('insert', 0, 1), ('update', 0, 1), ('annotate', 0, 1), ('delete', 0, 1), ('log', 0, 10), ('diff', 0, 1),
  ('verify', 0, 1), ('recover', 0, 1), ('compact', 0, 1), ('update', 2, 0), ('insert', 2, 0)) v(command, status, lines)
  UNION ALL SELECT 'annotations', 0, count(*) + 1 FROM st WHERE device = 'click' UNION ALL SELECT 'info', 0, 74""",
)
def command_line(spark, sf_dir):
    """Exit status and lines of output of each command, on a store of one's own."""
    from .cli import main

    f, rows = _copy(spark, sf_dir), []
    for argv in _COMMANDS:
        out = io.StringIO()
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
            status = main([x.replace("{}", f.path) for x in argv])
        rows.append((argv[0], status, len(out.getvalue().splitlines())))
    return _values(spark, rows, "command string, status int, lines long")
