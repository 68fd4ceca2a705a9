"""The registered queries over the key-value views, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions import stats
from kvlake.functions.hashing import crc32c_table, slot, user_key
from kvlake.operators import audit, compact, log, read, shard
from kvlake.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

GROUPS = [10, 20, 30, 40]

# Views as SQL, named as in ``sources.views``.
_OPS = """ops AS (SELECT event_id + 1 AS seq, 'user:' || lpad(user_id::VARCHAR, 8, '0') AS key, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind,
    CASE WHEN event_type <> 'error' THEN props END AS value, user_id AS u FROM events)"""
_NEWEST = f"{_OPS}, newest AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
_ITEMS = """items AS (SELECT l_orderkey AS batch_id, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, round(l_extendedprice * 100)::BIGINT AS cents, round(l_quantity)::BIGINT AS quantity FROM lineitem),
    placed AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n, part, supp, cents, quantity) - 1 AS nth FROM items),
    heads AS (SELECT batch_id, count(*) AS n_ops FROM items GROUP BY batch_id),
    numbered AS (SELECT batch_id, n_ops, (coalesce(sum(n_ops) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS base_seq FROM heads),
    exploded AS (SELECT p.batch_id, base_seq + nth AS seq, 'order/' || lpad(p.batch_id::VARCHAR, 12, '0') || '/line/' || lpad(n::VARCHAR, 2, '0') AS key,
        CASE WHEN quantity % 10 = 0 THEN 0 ELSE 1 END AS kind, CASE WHEN quantity % 10 <> 0 THEN part || ':' || supp || ':' || cents END AS value FROM placed p JOIN numbered USING (batch_id))"""
_COMMANDS = """commands AS (SELECT event_id + 1 AS log_index, event_id // 1000 + 1 AS term, CASE WHEN event_id % 50 = 49 THEN -1 - user_id ELSE user_id END AS client_id, floor(value)::BIGINT AS client_seq,
    event_id % 97 <> 96 AS has_ops, 'user:' || lpad(user_id::VARCHAR, 8, '0') AS key, props AS value FROM events),
    marked AS (SELECT *, client_id < 0 OR client_seq > coalesce(max(client_seq) OVER (PARTITION BY client_id ORDER BY log_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS applied FROM commands)"""
_FILES = """files AS (SELECT (o_custkey % 5)::INT AS level, (o_orderkey // 1000) * 10 + o_custkey % 5 AS file_num, count(*) * 100000 AS size,
    'order/' || lpad(min(o_orderkey)::VARCHAR, 12, '0') AS smallest, 'order/' || lpad(max(o_orderkey)::VARCHAR, 12, '0') AS largest FROM orders GROUP BY o_custkey % 5, o_orderkey // 1000)"""
_EDITS = f"""{_FILES}, edits AS (SELECT file_num AS edit_id, 'add' AS action, * FROM files UNION ALL SELECT file_num + 100000000, 'delete', * FROM files WHERE file_num % 3 = 0
    UNION ALL SELECT file_num + 200000000, 'add', * FROM files WHERE file_num % 9 = 0)"""
_HISTORY = """history AS (SELECT event_id AS op_id, CASE WHEN event_id % 2 = 0 THEN 'put' ELSE 'get' END AS op, 'w' || (event_id // 2) AS key,
    CASE WHEN event_id % 2 = 0 OR user_id % 5 <> 0 THEN 'v' || (event_id // 2) END AS value, event_id * 10 AS start_ts, event_id * 10 + floor(value)::BIGINT % 25 AS end_ts, event_type <> 'error' AS ok FROM events)"""


def _slot_sql(key: str) -> str:
    """CRC-32C of an ASCII string, modulo 256."""
    table = "[" + ",".join(map(str, crc32c_table())) + "]::BIGINT[]"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, ({table})[(xor(a, b) & 255) + 1]))"
    return f"(xor({fold}, 4294967295::BIGINT) % 256)::INT"


_SLOTS = f"slots AS (SELECT key, {_slot_sql('key')} AS slot FROM (SELECT DISTINCT key FROM ops))"
_PLACED = f"""{_OPS}, {_SLOTS}, placed AS (SELECT [10, 20, 30, 40][u % 4 + 1] AS group_id, seq, key, kind, value FROM ops
    UNION ALL SELECT [10, 20, 30, 40][(u + 1) % 4 + 1], seq, key, kind, value FROM ops WHERE u % 7 = 0)"""
_MAP = "m AS (SELECT 1 AS epoch, range::INT AS slot, [10, 20, 30, 40][range % 4 + 1] AS group_id, false AS migrating FROM range(256))"


def registrar(queries: dict[str, Query], sql_of: dict[str, str]) -> Callable[[str], Callable[[Query], Query]]:
    """A decorator that files a query under its name, with its SQL."""

    def query(sql: str) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            queries[f.__name__], sql_of[f.__name__] = f, sql
            return f

        return register

    return query


query = registrar(QUERIES, ORACLE_SQL)


def _text(df: DataFrame, *columns: str) -> DataFrame:
    """Binary columns as strings, for reports."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _ranked(df: DataFrame) -> DataFrame:
    """A page of a scan with places: the rows are limited, so one task numbers them."""
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.orderBy("key")))


@query(f"WITH {_NEWEST} SELECT key, seq, value FROM newest WHERE kind = 1")
def latest_live(spark, sf_dir):
    return _text(read.latest_live(views.ops_from_events(spark, sf_dir)).select("key", "seq", "value"), "key", "value")


@query(f"WITH {_OPS}, w AS (SELECT * FROM ops WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, seq, value FROM w WHERE kind = 1")
def as_of_snapshot(spark, sf_dir):
    return _text(read.as_of(views.ops_from_events(spark, sf_dir), 5000).select("key", "seq", "value"), "key", "value")


@query(f"WITH {_NEWEST} SELECT key, value, row_number() OVER (ORDER BY key) AS place FROM (SELECT key, value FROM newest WHERE kind = 1 AND key >= 'user:00000003' AND key < 'user:00000100' ORDER BY key LIMIT 25)")
def range_scan_limit(spark, sf_dir):
    page = read.scan(views.ops_from_events(spark, sf_dir), b"user:00000003", b"user:00000100", 25)
    return _text(_ranked(page), "key", "value")


@query(f"WITH {_NEWEST} SELECT key, value, row_number() OVER (ORDER BY key) AS place FROM (SELECT key, value FROM newest WHERE kind = 1 AND key > 'user:00000005' ORDER BY key LIMIT 10)")
def next_page(spark, sf_dir):
    return _text(_ranked(read.scan_after(views.ops_from_events(spark, sf_dir), b"user:00000005", 10)), "key", "value")


@query(f"""WITH {_NEWEST} SELECT label, n FROM (VALUES ('equal', 0), ('inverted', 0), ('past_end', 0), ('empty_end', 0)) AS v(label, n)
    UNION ALL SELECT 'open', (SELECT count(*) FROM newest WHERE kind = 1) UNION ALL SELECT 'remote_empty_end', (SELECT count(*) FROM newest WHERE kind = 1)""")
def empty_and_inverted_range(spark, sf_dir):
    ops = views.ops_from_events(spark, sf_dir)
    k = b"user:00000005"
    bounds = {"equal": (k, k), "inverted": (b"user:00000009", k), "past_end": (b"zzz", None), "empty_end": (None, b""), "open": (None, None)}
    counts = [F.count_if(read.key_range(*b)).alias(name) for name, b in bounds.items()]
    counts.append(F.count_if(read.key_range(None, b"", empty_end_is_open=True)).alias("remote_empty_end"))
    row = read.latest_live(ops).agg(*counts)
    return row.unpivot([], row.columns, "label", "n")


@query(f"WITH {_ITEMS}, newest AS (SELECT * FROM exploded QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, value FROM newest WHERE kind = 1 AND starts_with(key, 'order/00000000001')")
def prefix_scan(spark, sf_dir):
    ops = log.explode_batches(log.number_batches(views.batches_from_lineitem(spark, sf_dir)))
    return _text(read.prefix_scan(ops, b"order/00000000001"), "key", "value")


@query(f"WITH {_NEWEST} SELECT key, value FROM newest WHERE kind = 1 AND key = 'user:00000007'")
def point_get(spark, sf_dir):
    return _text(read.get(views.ops_from_events(spark, sf_dir), b"user:00000007"), "key", "value")


@query(f"WITH {_NEWEST}, wanted AS (SELECT 'user:' || lpad(c_custkey::VARCHAR, 8, '0') AS key FROM customer) SELECT w.key, n.key IS NOT NULL AS found, n.value FROM wanted w LEFT JOIN newest n ON n.key = w.key AND n.kind = 1")
def multi_get_found(spark, sf_dir):
    wanted = views.table(spark, sf_dir, "customer").select(views.user_key(F.col("c_custkey")).alias("key"))
    return _text(read.multi_get(views.ops_from_events(spark, sf_dir), wanted), "key", "value")


@query(f"WITH {_OPS} SELECT key, seq, kind::TINYINT AS kind, coalesce(lead(seq) OVER (PARTITION BY key ORDER BY seq), -1) AS next_seq FROM ops")
def version_history(spark, sf_dir):
    return _text(read.versions(views.ops_from_events(spark, sf_dir)).select("key", "seq", "kind", F.coalesce("next_seq", F.lit(-1)).alias("next_seq")), "key")


@query(f"""WITH {_OPS}, probes AS (SELECT o_orderkey AS probe_id, 'user:' || lpad(o_custkey::VARCHAR, 8, '0') AS key, o_orderkey % (SELECT max(seq) + 1 FROM ops) AS at_seq FROM orders)
    SELECT p.probe_id, p.key, p.at_seq, coalesce(o.seq, 0) AS seq, coalesce(o.kind, -1)::TINYINT AS kind, o.value FROM probes p ASOF LEFT JOIN ops o ON p.key = o.key AND p.at_seq >= o.seq""")
def asof_join(spark, sf_dir):
    """Probes of all customers, at positions all over the log."""
    ops = views.ops_from_events(spark, sf_dir)
    end = ops.agg((F.max("seq") + 1).alias("end"))
    probes = views.table(spark, sf_dir, "orders").join(F.broadcast(end)).select(F.col("o_orderkey").alias("probe_id"), views.user_key(F.col("o_custkey")).alias("key"), (F.col("o_orderkey") % F.col("end")).alias("at_seq"))
    met = read.asof_join(probes, ops)
    return _text(met.withColumn("seq", F.coalesce("seq", F.lit(0))).withColumn("kind", F.coalesce("kind", F.lit(-1)).cast("tinyint")), "key", "value")


@query(f"WITH {_NEWEST} SELECT key, seq FROM newest WHERE kind = 0")
def tombstoned_keys(spark, sf_dir):
    return _text(read.tombstones(views.ops_from_events(spark, sf_dir)), "key")


@query(f"WITH {_ITEMS} SELECT batch_id, n_ops, base_seq FROM numbered")
def batch_sequence(spark, sf_dir):
    return log.number_batches(views.batches_from_lineitem(spark, sf_dir)).select("batch_id", "n_ops", "base_seq")


@query(f"WITH {_ITEMS} SELECT batch_id, seq, key, kind::TINYINT AS kind, value FROM exploded")
def batch_ops(spark, sf_dir):
    return _text(log.explode_batches(log.number_batches(views.batches_from_lineitem(spark, sf_dir))), "key", "value")


@query(f"WITH {_ITEMS} SELECT batch_id, seq, key, kind::TINYINT AS kind, value FROM exploded QUALIFY row_number() OVER (PARTITION BY batch_id, key ORDER BY seq DESC) = 1")
def last_op_wins_in_batch(spark, sf_dir):
    return _text(log.last_in_batch(log.explode_batches(log.number_batches(views.batches_from_lineitem(spark, sf_dir)))), "key", "value")


@query("SELECT l_orderkey AS batch_id, CASE WHEN l_orderkey % 11 = 3 THEN 'reserved_key' WHEN l_orderkey % 11 = 5 THEN 'bad_kind' WHEN l_orderkey % 11 = 7 THEN 'bad_value' END AS fault FROM lineitem GROUP BY l_orderkey")
def batch_faults(spark, sf_dir):
    b = views.batches_from_lineitem(spark, sf_dir)
    at = F.col("batch_id") % 11
    extra = lambda kind, key, value: F.array(F.struct(F.lit(kind).cast("tinyint").alias("kind"), F.lit(key).alias("key"), F.lit(value).cast("binary").alias("value")))
    spoilt = F.when(at == 3, F.concat("ops", extra(1, b"\x00!raft/x", b""))).when(at == 5, F.concat("ops", extra(2, b"k", b""))).when(at == 7, F.concat("ops", extra(0, b"k", b"v"))).otherwise(F.col("ops"))
    return log.batch_faults(b.withColumn("ops", spoilt)).select("batch_id", "fault")


@query(f"WITH {_OPS}, {_SLOTS} SELECT key, slot, [10, 20, 30, 40][slot % 4 + 1]::BIGINT AS owner FROM slots")
def slot_assignment(spark, sf_dir):
    keys = views.ops_from_events(spark, sf_dir).select("key").distinct()
    return _text(shard.route(keys, shard.initial_map(spark, GROUPS)).select("key", "slot", "owner"), "key")


@query(f"WITH {_OPS}, {_SLOTS} SELECT slot, count(*) AS n FROM slots GROUP BY slot")
def slot_histogram(spark, sf_dir):
    return views.ops_from_events(spark, sf_dir).select("key").distinct().groupBy(slot(F.col("key")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_OPS}, {_SLOTS} SELECT [10, 20, 30, 40][slot % 4 + 1]::BIGINT AS group_id, count(*) AS n FROM slots GROUP BY 1")
def keys_per_group(spark, sf_dir):
    keys = views.ops_from_events(spark, sf_dir).select("key").distinct()
    return shard.route(keys, shard.initial_map(spark, GROUPS)).groupBy(F.col("owner").alias("group_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MAP} SELECT epoch::BIGINT AS epoch, slot, group_id::BIGINT AS group_id, migrating FROM m")
def shard_map_initial(spark, sf_dir):
    return shard.initial_map(spark, [30, 10, 40, 20])


@query(f"WITH {_MAP} SELECT 3::BIGINT AS epoch, slot, (CASE WHEN slot = 77 THEN 30 ELSE group_id END)::BIGINT AS group_id, slot = 78 AS migrating FROM m")
def shard_map_with_slot(spark, sf_dir):
    m = shard.initial_map(spark, GROUPS)
    return shard.with_migrating(shard.with_slot(m, 77, 30), 78)


@query(f"WITH {_MAP} SELECT 3::BIGINT AS epoch, slot, (CASE WHEN group_id = 20 THEN 10 ELSE group_id END)::BIGINT AS group_id, slot = 5 AS migrating FROM m")
def shard_map_reassign(spark, sf_dir):
    return shard.with_reassign(shard.with_migrating(shard.initial_map(spark, GROUPS), 5), 20, 10)


@query(f"WITH {_MAP} SELECT 2::BIGINT AS epoch, slot, (CASE WHEN slot = 9 THEN 40 ELSE group_id END)::BIGINT AS group_id, false AS migrating FROM m")
def shard_map_adopt(spark, sf_dir):
    m = shard.initial_map(spark, GROUPS)
    return shard.adopt(m.unionByName(shard.with_slot(m, 9, 40)).unionByName(m))


@query(f"WITH {_MAP} SELECT group_id::BIGINT AS group_id, string_agg(slot::VARCHAR, ' ' ORDER BY slot) AS slots FROM m GROUP BY group_id")
def slots_per_group(spark, sf_dir):
    s = shard.slots_of(shard.initial_map(spark, GROUPS))
    return s.select("group_id", F.array_join(F.col("slots").cast("array<string>"), " ").alias("slots"))


@query(f"""WITH {_PLACED}, own AS (SELECT p.* FROM placed p JOIN slots s USING (key) WHERE p.group_id = [10, 20, 30, 40][s.slot % 4 + 1]),
    n AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, value FROM n WHERE kind = 1""")
def cluster_scan_owner_filter(spark, sf_dir):
    return _text(shard.cluster_scan(views.placed_ops(spark, sf_dir, GROUPS), shard.initial_map(spark, GROUPS)), "key", "value")


@query(f"WITH {_PLACED}, n AS (SELECT * FROM placed WHERE group_id = 20 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, value FROM n WHERE kind = 1")
def group_scan(spark, sf_dir):
    return _text(shard.group_scan(views.placed_ops(spark, sf_dir, GROUPS), 20), "key", "value")


@query(f"""WITH {_PLACED}, n AS (SELECT p.* FROM placed p JOIN slots s USING (key) WHERE group_id = 10 AND s.slot % 16 = 4 AND key > 'user:00000004' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
    SELECT s.slot, max(key) AS last_key, count(*) AS copied FROM n JOIN slots s USING (key) WHERE kind = 1 GROUP BY s.slot""")
def copy_slot_resume(spark, sf_dir):
    placed = views.placed_ops(spark, sf_dir, GROUPS)
    copied = shard.copy_slots(placed, list(range(4, 256, 16)), 10, 20, b"user:00000004")
    return _text(shard.copy_cursor(copied, "slot"), "last_key")


@query(f"""WITH {_OPS}, {_SLOTS}, w AS (SELECT seq, key, [10, 20, 30, 40][seq % 4 + 1] AS routed FROM ops)
    SELECT w.seq, w.key, CASE WHEN s.slot % 2 = 1 AND s.slot % 4 = 3 THEN 'unassigned' WHEN s.slot IN (4, 131, 209, 64, 20, 36) THEN 'migrating' WHEN w.routed <> [10, 20, 30, 40][s.slot % 4 + 1] THEN 'wrong_group' ELSE 'ok' END AS verdict
    FROM w JOIN slots s USING (key)""")
def rejected_writes(spark, sf_dir):
    m = shard.with_reassign(shard.initial_map(spark, GROUPS), 40, 0)
    for at in (4, 131, 209, 64, 20, 36):
        m = shard.with_migrating(m, at)
    routed = F.element_at(F.array(*[F.lit(g).cast("long") for g in GROUPS]), (F.col("seq") % 4).cast("int") + 1)
    writes = views.ops_from_events(spark, sf_dir).select("seq", "key").withColumn("routed_group", routed)
    return _text(shard.classify_writes(writes, m).select("seq", "key", "verdict"), "key")


@query(f"WITH {_COMMANDS} SELECT log_index, client_id, client_seq, applied FROM marked")
def dedup_apply(spark, sf_dir):
    return log.mark_applied(views.commands_from_events(spark, sf_dir)).select("log_index", "client_id", "client_seq", "applied")


@query(f"WITH {_COMMANDS} SELECT client_id, max(client_seq) AS client_seq FROM marked WHERE applied AND client_id >= 0 GROUP BY client_id")
def session_table(spark, sf_dir):
    return log.session_table(log.mark_applied(views.commands_from_events(spark, sf_dir)))


@query(f"WITH {_COMMANDS} SELECT row_number() OVER (ORDER BY log_index) AS seq, log_index, key, value FROM marked WHERE applied AND has_ops")
def applied_ops(spark, sf_dir):
    ops = log.applied_ops(log.mark_applied(views.commands_from_events(spark, sf_dir)))
    return _text(ops.select("seq", F.col("batch_id").alias("log_index"), "key", "value"), "key", "value")


@query(f"""WITH {_COMMANDS}, n AS (SELECT log_index, (CASE WHEN applied AND has_ops THEN 1 ELSE 0 END + CASE WHEN applied AND client_id >= 0 THEN 1 ELSE 0 END + 1)::BIGINT AS n_seqs FROM marked)
    SELECT log_index, n_seqs, (coalesce(sum(n_seqs) OVER (ORDER BY log_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS base_seq FROM n""")
def consumed_seqs(spark, sf_dir):
    return log.consumed_seqs(log.mark_applied(views.commands_from_events(spark, sf_dir))).select("log_index", "n_seqs", "base_seq")


@query(f"WITH {_COMMANDS} SELECT max(log_index) AS log_index, arg_max(term, log_index) AS term FROM commands")
def snapshot_meta(spark, sf_dir):
    return log.snapshot_meta(views.commands_from_events(spark, sf_dir))


@query("WITH e AS (SELECT event_id AS log_index FROM events WHERE event_id % 500 <> 17), g AS (SELECT log_index, lag(log_index) OVER (ORDER BY log_index) AS previous_index FROM e) SELECT * FROM g WHERE log_index <> previous_index + 1")
def log_gap_audit(spark, sf_dir):
    return log.log_gaps(views.table(spark, sf_dir, "events").where("event_id % 500 <> 17").select(F.col("event_id").alias("log_index")))


@query(f"""WITH {_NEWEST}, below AS (SELECT smallest, largest FROM (VALUES ('user:00000010', 'user:00000040'), ('user:00000035', 'user:00000060'), ('user:00000099', 'user:00000099')) AS v(smallest, largest))
    SELECT key, seq, kind::TINYINT AS kind, value FROM newest n WHERE kind = 1 OR EXISTS (SELECT 1 FROM below b WHERE n.key BETWEEN b.smallest AND b.largest)""")
def compaction_merge(spark, sf_dir):
    below = spark.createDataFrame([(b"user:00000010", b"user:00000040"), (b"user:00000035", b"user:00000060"), (b"user:00000099", b"user:00000099")], "smallest binary, largest binary")
    return _text(compact.merge(views.ops_from_events(spark, sf_dir), below).select("key", "seq", "kind", "value"), "key", "value")


@query(f"""WITH {_FILES} SELECT level, count(*) AS n_files, sum(size)::BIGINT AS bytes, round(CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE sum(size)::DOUBLE / (10485760.0::DOUBLE * pow(10, level - 1)) END, 6) AS score
    FROM files GROUP BY level""")
def level_scores(spark, sf_dir):
    return compact.level_scores(views.files_from_orders(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"""WITH {_FILES}, s AS (SELECT level, CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE sum(size)::DOUBLE / (10485760.0::DOUBLE * pow(10, level - 1)) END AS score FROM files GROUP BY level)
    SELECT level FROM s WHERE score >= 1 ORDER BY score DESC, level DESC LIMIT 1""")
def compaction_pick(spark, sf_dir):
    return compact.pick_level(compact.level_scores(views.files_from_orders(spark, sf_dir))).select("level")


@query(f"WITH {_FILES} SELECT file_num, smallest FROM files WHERE level = 2 ORDER BY CASE WHEN smallest > 'order/000000003500' THEN 0 ELSE 1 END, smallest LIMIT 1")
def rotation_pick(spark, sf_dir):
    return _text(compact.rotation_pick(views.files_from_orders(spark, sf_dir), 2, b"order/000000003500").select("file_num", "smallest"), "smallest")


@query(f"WITH {_FILES} SELECT a.file_num, b.file_num AS other_num FROM files a JOIN files b ON a.level = 1 AND b.level = 2 AND a.smallest <= b.largest AND a.largest >= b.smallest")
def overlapping_files(spark, sf_dir):
    files = views.files_from_orders(spark, sf_dir)
    return compact.overlapping(files.where("level = 1"), files.where("level = 2"))


@query(f"""WITH {_FILES}, merged AS (SELECT level - level % 2 AS level, file_num, smallest, largest FROM files),
    l AS (SELECT *, lag(largest) OVER w AS before, lag(file_num) OVER w AS previous_num FROM merged WHERE level > 0 WINDOW w AS (PARTITION BY level ORDER BY smallest, file_num)) SELECT level, file_num, previous_num FROM l WHERE smallest <= before""")
def level_disjoint_audit(spark, sf_dir):
    return compact.level_faults(views.files_from_orders(spark, sf_dir).withColumn("level", F.col("level") - F.col("level") % 2))


@query(f"WITH {_EDITS}, l AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY level, file_num ORDER BY edit_id DESC) = 1) SELECT level, file_num, size, smallest, largest FROM l WHERE action = 'add'")
def live_files(spark, sf_dir):
    return _text(compact.live_files(views.edits_from_orders(spark, sf_dir)), "smallest", "largest")


@query(f"WITH {_EDITS}, l AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY level, file_num ORDER BY edit_id DESC) = 1) SELECT file_num FROM files WHERE file_num NOT IN (SELECT file_num FROM l WHERE action = 'add') AND file_num % 2 = 0")
def obsolete_files(spark, sf_dir):
    edits = views.edits_from_orders(spark, sf_dir)
    files = views.files_from_orders(spark, sf_dir)
    return compact.obsolete_files(files, compact.live_files(edits), files.where("file_num % 2 = 1"))


@query(f"""WITH {_EDITS}, more AS (SELECT edit_id + 300000000 AS edit_id, 'add' AS action, level, file_num FROM edits WHERE edit_id < 100000000 AND file_num % 3 <> 0
    UNION ALL SELECT edit_id + 400000000, 'delete', level, file_num FROM edits WHERE edit_id < 100000000 AND file_num % 2 = 0 UNION ALL SELECT edit_id, action, level, file_num FROM edits),
    w AS (SELECT *, coalesce(lag(action) OVER (PARTITION BY level, file_num ORDER BY edit_id), 'delete') AS was FROM more)
    SELECT edit_id, level, file_num, CASE action WHEN 'add' THEN 'already_there' ELSE 'not_there' END AS fault FROM w WHERE action = was""")
def edit_faults(spark, sf_dir):
    """Files added twice, and files deleted that are gone."""
    edits = views.edits_from_orders(spark, sf_dir)
    first = edits.where("edit_id < 100000000")
    again = first.where("file_num % 3 <> 0").withColumn("edit_id", F.col("edit_id") + 300_000_000)
    gone = first.where("file_num % 2 = 0").withColumn("edit_id", F.col("edit_id") + 400_000_000).withColumn("action", F.lit("delete"))
    return compact.edit_faults(edits.unionByName(again).unionByName(gone))


@query("""WITH l AS (SELECT event_type AS op, round(value * 1000)::BIGINT AS nanos FROM events), s AS (SELECT op, list_sort(list(nanos)) AS v, count(*) AS ops FROM l GROUP BY op)
    SELECT op, ops, v[floor(0.5 * (ops - 1))::INT + 1] AS p50, v[floor(0.95 * (ops - 1))::INT + 1] AS p95, v[floor(0.99 * (ops - 1))::INT + 1] AS p99, v[floor(0.999 * (ops - 1))::INT + 1] AS p999, v[ops] AS p100 FROM s""")
def latency_percentiles(spark, sf_dir):
    l = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.round(F.col("value") * 1000).cast("long").alias("nanos"))
    return stats.latency_report(l, ["op"])


@query("""WITH m AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'flush' ELSE 'compaction' END AS kind, round(o_totalprice)::BIGINT AS bytes FROM orders)
    SELECT count(*) FILTER (kind = 'flush') AS flushes, coalesce(sum(bytes) FILTER (kind = 'flush'), 0)::BIGINT AS flushed_bytes, count(*) FILTER (kind = 'compaction') AS compactions,
    coalesce(sum(bytes) FILTER (kind = 'compaction'), 0)::BIGINT AS compacted_bytes, (sum(bytes) * 10000 // 20000000)::BIGINT AS amplification_bp FROM m""")
def write_amplification(spark, sf_dir):
    m = views.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "flush").otherwise("compaction").alias("kind"), F.round("o_totalprice").cast("long").alias("bytes"))
    out = compact.maintenance_metrics(m)
    return out.withColumn("amplification_bp", F.expr("(flushed_bytes + compacted_bytes) * 10000 div 20000000"))


@query("""WITH d AS (SELECT event_type AS method, value / 1000.0 AS s FROM events), b AS (SELECT method, len(list_filter([1e-5 * pow(4, i) for i in range(10)], lambda x: x < s)) AS bucket FROM d)
    SELECT method, bucket::INT AS bucket, count(*) AS n FROM b GROUP BY ALL""")
def request_durations(spark, sf_dir):
    d = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), stats.duration_bucket(F.col("value") / 1000.0).alias("bucket"))
    return d.groupBy("method", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_OPS}, a AS (SELECT key, value FROM (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 1),
    b AS (SELECT key, value FROM (SELECT * FROM ops WHERE seq <= 9900 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 1)
    SELECT coalesce(a.key, b.key) AS key, a.value AS value_a, b.value AS value_b FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def replica_divergence(spark, sf_dir):
    ops = views.ops_from_events(spark, sf_dir)
    return _text(audit.divergence(read.latest_live(ops), read.as_of(ops, 9900)), "key", "value_a", "value_b")


@query(f"WITH {_HISTORY} SELECT r.op_id, r.key FROM history r JOIN history w ON w.key = r.key AND w.op = 'put' AND w.ok AND r.op = 'get' AND r.ok AND r.start_ts > w.end_ts AND r.value IS DISTINCT FROM w.value")
def read_after_ack(spark, sf_dir):
    return _text(audit.stale_reads(views.history_from_events(spark, sf_dir)), "key")


@query(f"WITH {_HISTORY}, s AS (SELECT key, value FROM history WHERE op = 'put' AND op_id % 30 <> 0) SELECT w.key FROM history w LEFT JOIN s ON s.key = w.key WHERE w.op = 'put' AND w.ok AND w.value IS DISTINCT FROM s.value")
def lost_acks(spark, sf_dir):
    h = views.history_from_events(spark, sf_dir)
    return _text(audit.lost_acks(h, h.where("op = 'put' and op_id % 30 <> 0").select("key", "value")), "key")


@query("SELECT event_id // 10 AS term, count(DISTINCT CASE WHEN event_id // 10 % 4 = 0 THEN user_id % 3 ELSE 1 END) AS leaders FROM events GROUP BY 1 HAVING leaders > 1")
def leader_per_term(spark, sf_dir):
    leader = F.when(F.expr("event_id div 10") % 4 == 0, F.col("user_id") % 3).otherwise(1)
    return audit.split_terms(views.table(spark, sf_dir, "events").select(F.expr("event_id div 10").alias("term"), leader.alias("leader")))


@query("SELECT log_index, count(DISTINCT v) AS variants FROM (SELECT event_id // 3 AS log_index, CASE WHEN event_id // 3 % 5 = 0 THEN event_type ELSE 'same' END AS v FROM events) GROUP BY 1 HAVING variants > 1")
def log_agreement(spark, sf_dir):
    data = F.when(F.expr("event_id div 3") % 5 == 0, F.col("event_type")).otherwise("same")
    e = views.table(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("node"), F.expr("event_id div 3").alias("log_index"), F.lit(1).alias("term"), data.alias("data"))
    return audit.log_conflicts(e)


@query("WITH c AS (SELECT event_id AS log_index, user_id AS node, CASE WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'view' THEN 'add_learner' ELSE 'add' END AS action FROM events) SELECT node, CASE WHEN action = 'add' THEN 'voter' ELSE 'learner' END AS role FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY node ORDER BY log_index DESC) = 1) WHERE action <> 'remove'")
def membership(spark, sf_dir):
    action = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "view", "add_learner").otherwise("add")
    return audit.membership(views.table(spark, sf_dir, "events").select(F.col("event_id").alias("log_index"), F.col("user_id").alias("node"), action.alias("action")))


@query("SELECT g AS group_id, list_reverse_sort(list(m))[count(*) // 2 + 1] AS commit_index FROM (SELECT event_id // 5 AS g, floor(value * 100)::BIGINT AS m FROM events) GROUP BY g")
def quorum_commit(spark, sf_dir):
    m = views.table(spark, sf_dir, "events").select(F.expr("event_id div 5").alias("group_id"), F.floor(F.col("value") * 100).alias("match_index"))
    return audit.quorum_index(m, ["group_id"])


@query("SELECT count(*) FILTER (user_id >= 40) AS reached, count(*) AS nodes FROM events")
def map_reach(spark, sf_dir):
    return audit.reached_epoch(views.table(spark, sf_dir, "events").select(F.col("user_id").alias("epoch")), 40)


_MIX = [("a", "read", 50), ("a", "update", 50), ("b", "read", 95), ("b", "update", 5), ("c", "read", 100), ("d", "read", 95), ("d", "insert", 5), ("e", "scan", 95), ("e", "insert", 5), ("f", "read", 50), ("f", "rmw", 50)]


@query(f"""WITH m AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _MIX)}) AS v(workload, op, share)), b AS (SELECT workload, op, sum(share) OVER (PARTITION BY workload ORDER BY op DESC ROWS UNBOUNDED PRECEDING) AS upto, share FROM m),
    e AS (SELECT event_id * 37 % 100 AS draw FROM events) SELECT workload, op, count(*) AS n FROM e JOIN b ON e.draw < b.upto AND e.draw >= b.upto - b.share GROUP BY ALL""")
def ycsb_mix(spark, sf_dir):
    from kvlake.functions import workload

    e = views.table(spark, sf_dir, "events").select((F.col("event_id") * 37 % 100).alias("at"))
    return workload.mixed(e, F.col("at")).groupBy("workload", "op").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id AS i, 'user' || list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(8), lambda k: ((event_id >> (8 * k)) & 255)::HUGEINT)),
    lambda h, b: (((h - h % 256) + xor((h % 256)::BIGINT, b::BIGINT)) * 1099511628211) % 18446744073709551616)::VARCHAR AS key FROM events""")
def ycsb_keys(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), user_key(F.col("event_id")).alias("key"))
