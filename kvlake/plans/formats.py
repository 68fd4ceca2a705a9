"""Registered queries over raw file formats, stored logs, requests and consensus logs, each with its SQL.

Files are made from the tables, read back and compared with what went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.functions import workload
from kvlake.model import RESERVED_PREFIX
from kvlake.operators import audit, compact, log, read, serve, shard
from kvlake.sources import raw, store, views

from . import queries as q
from .lineage import cut, scratch

QUERIES: dict[str, q.Query] = {}
ORACLE_SQL: dict[str, str] = {}
query = q.registrar(QUERIES, ORACLE_SQL)

_BYTES = "(1 + (n >= 128)::INT + (n >= 16384)::INT + (n >= 2097152)::INT)"


def _sized(n: str) -> str:
    """Bytes of a sized string of ``n`` bytes."""
    return f"({n} + {_BYTES.replace('n', f'({n})')})"


_BATCH_BYTES = f"""{q._ITEMS}, sizes AS (SELECT batch_id, (8 + {_BYTES.replace('n', 'count(*)')} + sum(1 + {_sized('strlen(key)')} + CASE WHEN kind = 1 THEN {_sized('strlen(value)')} ELSE 0 END))::BIGINT AS bytes FROM exploded GROUP BY batch_id)"""
_SEGMENTS = f"""{_BATCH_BYTES}, upto AS (SELECT n.batch_id, n.base_seq, n.n_ops, s.bytes, (sum(s.bytes + 8) OVER (ORDER BY n.batch_id) - s.bytes - 8) // 262144 AS c FROM numbered n JOIN sizes s USING (batch_id)),
    cuts AS (SELECT *, dense_rank() OVER (ORDER BY c) AS segment FROM upto)"""


def _segments(spark, sf_dir) -> DataFrame:
    return raw.log_segments(views.batches_from_lineitem(spark, sf_dir), 1 << 18)


@query(f"WITH {_SEGMENTS} SELECT segment, count(*) AS batches, min(base_seq)::BIGINT AS first_seq, max(base_seq + n_ops - 1)::BIGINT AS last_seq, sum(bytes + 8)::BIGINT AS bytes FROM cuts GROUP BY segment")
def log_rotation(spark, sf_dir):
    return _segments(spark, sf_dir).select("segment", "batches", "first_seq", "last_seq", F.octet_length("content").cast("long").alias("bytes"))


@query(f"WITH {q._ITEMS} SELECT seq, key, kind::TINYINT AS kind, value FROM exploded")
def raw_log_round_trip(spark, sf_dir):
    return q._text(raw.ops_of_segments(_segments(spark, sf_dir)), "key", "value")


@query(f"WITH {q._ITEMS} SELECT seq, key, kind::TINYINT AS kind, value FROM exploded WHERE batch_id < (SELECT max(batch_id) FROM exploded)")
def torn_log_tail(spark, sf_dir):
    """The newest segment lacks its last three bytes: its last batch is dropped as a whole."""
    torn = F.when(F.col("newest"), F.expr("substring(content, 1, octet_length(content) - 3)")).otherwise(F.col("content"))
    return q._text(raw.ops_of_segments(_segments(spark, sf_dir).select(torn.alias("content"))), "key", "value")


@query(f"WITH {_SEGMENTS} SELECT segment, max(base_seq + n_ops - 1)::BIGINT AS last_seq FROM cuts GROUP BY segment HAVING segment >= 3 OR segment = (SELECT max(segment) FROM cuts)")
def log_prune(spark, sf_dir):
    """Files are removed by their numbers: only those are kept of what was written, while the rule is applied."""
    return raw.after_prune(cut(_segments(spark, sf_dir).select("segment", "last_seq")), 3)


@query(f"WITH {_BATCH_BYTES} SELECT batch_id, CASE WHEN bytes > 180 THEN 'too_large' END AS fault FROM sizes")
def oversized_batches(spark, sf_dir):
    return log.batch_faults(views.batches_from_lineitem(spark, sf_dir), 180).select("batch_id", "fault")


def _tables(spark, sf_dir) -> DataFrame:
    """Table files of the newest versions: path, content."""
    outputs = compact.split_outputs(read.newest(views.ops_from_events(spark, sf_dir)), 1 << 12)
    return cut(raw.table_files(outputs).select(F.concat_ws("-", F.col("part").cast("string"), F.col("file_no").cast("string")).alias("path"), "content"))


@query(f"WITH {q._NEWEST} SELECT key, seq, kind::TINYINT AS kind, value FROM newest")
def table_round_trip(spark, sf_dir):
    return q._text(raw.ops_of_tables(_tables(spark, sf_dir)).drop("file"), "key", "value")


@query(f"WITH {q._NEWEST} SELECT key, seq, kind::TINYINT AS kind, value FROM newest WHERE key >= 'user:00000050'")
def table_seek(spark, sf_dir):
    return q._text(raw.seek_tables(_tables(spark, sf_dir), b"user:00000050").drop("file"), "key", "value")


@query(f"WITH {q._NEWEST} SELECT n.key, n.seq, n.kind::TINYINT AS kind, n.value FROM newest n JOIN (SELECT 'user:' || lpad((2 * c_custkey)::VARCHAR, 8, '0') AS key FROM customer) c USING (key)")
def table_lookup(spark, sf_dir):
    """Point reads of table files through bloom filters and block indexes."""
    wanted = views.table(spark, sf_dir, "customer").select(views.user_key(2 * F.col("c_custkey")).alias("key"))
    return q._text(raw.look_up(_tables(spark, sf_dir), wanted).drop("file"), "key", "value")


@query(f"""WITH {q._OPS}, k AS (SELECT DISTINCT key FROM ops), w AS (SELECT key, xor(3164544308::BIGINT, (13 * 3332679571::BIGINT) % 4294967296) AS h,
    [ascii(key[4 * i + 1])::BIGINT + 256 * ascii(key[4 * i + 2]) + 65536 * ascii(key[4 * i + 3]) + 16777216 * ascii(key[4 * i + 4]) for i in range(3)] AS words FROM k),
    f AS (SELECT key, list_reduce(list_prepend(h, words), lambda a, b: xor(((((a + b) % 4294967296)::HUGEINT * 3332679571) % 4294967296)::BIGINT, (((((a + b) % 4294967296)::HUGEINT * 3332679571) % 4294967296)::BIGINT) >> 16)) AS h FROM w),
    l AS (SELECT key, ((((h + ascii(key[13])) % 4294967296)::HUGEINT * 3332679571) % 4294967296)::BIGINT AS h FROM f)
    SELECT key, xor(h, h >> 24) AS bloom_hash FROM l""")
def bloom_hash(spark, sf_dir):
    return q._text(raw.bloom_hashes(views.ops_from_events(spark, sf_dir).select("key").distinct()), "key")


_LIVE_FILES = f"WITH {q._EDITS}, l AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY level, file_num ORDER BY edit_id DESC) = 1) SELECT level, file_num, size, smallest, largest FROM l WHERE action = 'add'"


@query(_LIVE_FILES)
def manifest_round_trip(spark, sf_dir):
    edits = raw.edits_of(raw.manifest_file(views.edits_from_orders(spark, sf_dir)))
    return q._text(compact.live_files(edits), "smallest", "largest")


@query(f"{_LIVE_FILES} UNION ALL SELECT 0, 99, 12345, 'last_seq', 'next_file_num'")
def manifest_rotation(spark, sf_dir):
    """A manifest rewritten as one edit: its files, and its two counters as one more row."""
    rows = cut(raw.edits_of(raw.rotated_manifest(compact.live_files(views.edits_from_orders(spark, sf_dir)), {"last_seq": 12345, "next_file_num": 99})))
    numbers = rows.where("number is not null").agg(F.max(F.when(F.col("action") == "next_file_num", F.col("number"))).alias("file_num"), F.max(F.when(F.col("action") == "last_seq", F.col("number"))).alias("size"), F.min("action").alias("smallest"), F.max("action").alias("largest"))
    return q._text(compact.live_files(rows.where("number is null")), "smallest", "largest").unionByName(numbers.withColumn("level", F.lit(0)))


@query(f"WITH {q._MAP} SELECT e::BIGINT AS epoch, slot, (CASE WHEN e >= 2 AND slot = 77 THEN 30 ELSE group_id END)::BIGINT AS group_id, e = 3 AND slot % 100 = 78 AS migrating FROM m, (VALUES (1), (2), (4)) AS v(e) WHERE e < 3 UNION ALL SELECT 4, slot, CASE WHEN slot = 77 THEN 30 ELSE group_id END, slot IN (78, 178) FROM m")
def shard_map_round_trip(spark, sf_dir):
    m = shard.initial_map(spark, q.GROUPS)
    second = shard.with_slot(m, 77, 30)
    last = shard.with_migrating(shard.with_migrating(second, 78), 178)
    return raw.maps_of(raw.map_files(m.unionByName(second).unionByName(last)))


@query(f"WITH {q._COMMANDS} SELECT log_index, term, CASE WHEN has_ops THEN client_id END AS client_id, CASE WHEN has_ops THEN client_seq END AS client_seq, CASE WHEN has_ops THEN key END AS key, CASE WHEN has_ops THEN value END AS value FROM commands")
def command_round_trip(spark, sf_dir):
    found = raw.commands_of(raw.entries_of_commands(views.commands_from_events(spark, sf_dir)))
    return q._text(found.select("log_index", "term", "client_id", "client_seq", F.col("ops")[0]["key"].alias("key"), F.col("ops")[0]["value"].alias("value")), "key", "value")


@query(f"WITH {q._COMMANDS} SELECT log_index, term FROM commands WHERE log_index > 7000")
def log_after_snapshot(spark, sf_dir):
    return log.entries_after(views.commands_from_events(spark, sf_dir), 7000).select("log_index", "term")


@query(f"WITH {q._NEWEST} SELECT key, value FROM newest WHERE kind = 1")
def reserved_keys_hidden(spark, sf_dir):
    """Bookkeeping pairs lie in the log, after the users' own, and no read shows them."""
    ops = views.ops_from_events(spark, sf_dir)
    own = ops.select((F.col("seq") + 10_000_000).alias("seq"), F.concat(F.lit(RESERVED_PREFIX), F.col("key")).alias("key"), "kind", "value")
    return q._text(read.scan(ops.unionByName(own)), "key", "value")


@query(f"WITH {q._FILES} SELECT level, min(smallest) AS smallest, max(largest) AS largest FROM files GROUP BY level")
def level_key_ranges(spark, sf_dir):
    return q._text(compact.key_bounds(views.files_from_orders(spark, sf_dir), "level"), "smallest", "largest")


@query(f"WITH {q._MAP} SELECT DISTINCT group_id::BIGINT AS group_id FROM m WHERE group_id <> 20")
def groups_of_map(spark, sf_dir):
    return shard.groups_of(shard.with_reassign(shard.initial_map(spark, q.GROUPS), 20, 0))


@query(f"WITH {q._NEWEST} SELECT key, value, row_number() OVER (ORDER BY key) AS place FROM (SELECT key, value FROM newest WHERE kind = 1 AND key >= 'user:00000013' ORDER BY key LIMIT 40)")
def scan_from_key(spark, sf_dir):
    return q._text(q._ranked(read.scan_from(views.ops_from_events(spark, sf_dir), b"user:00000013", 40)), "key", "value")


@query(f"""WITH {q._NEWEST}, live AS (SELECT key, value, row_number() OVER (ORDER BY key) AS r FROM newest WHERE kind = 1), s AS (SELECT c_custkey AS scan_id, 'user:' || lpad(c_custkey::VARCHAR, 8, '0') AS start, c_custkey % 9 AS n FROM customer),
    f AS (SELECT s.*, (SELECT count(*) FROM live WHERE live.key < s.start) AS before FROM s) SELECT scan_id, r - before AS place, key, value FROM f JOIN live ON r > before AND r <= before + n""")
def many_scans(spark, sf_dir):
    wanted = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scan_id"), views.user_key(F.col("c_custkey")).alias("start"), (F.col("c_custkey") % 9).alias("n"))
    return q._text(read.multi_scan(views.ops_from_events(spark, sf_dir), wanted), "key", "value")


@query("SELECT o_orderkey AS seq, 'c' || o_custkey AS key, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END)::TINYINT AS kind, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS value FROM orders")
def puts_and_deletes(spark, sf_dir):
    """Ops made from rows: deletes have no value, and a put without one has an empty one."""
    o = views.table(spark, sf_dir, "orders")
    key = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).cast("binary")
    gone = F.col("o_orderstatus") == "F"
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus").cast("binary"))
    ops = o.where(~gone).select(*log.put(F.col("o_orderkey"), key, value)).unionByName(o.where(gone).select(*log.delete(F.col("o_orderkey"), key)))
    return q._text(ops, "key", "value")


@query(f"WITH {q._FILES} SELECT count(*) FILTER (level = 0) >= 12 AS stalled FROM files")
def write_stall(spark, sf_dir):
    return compact.must_stall(views.files_from_orders(spark, sf_dir))


_ROTATED = """p AS (SELECT level FROM (SELECT level, CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE sum(size)::DOUBLE / (10485760.0::DOUBLE * pow(10, level - 1)) END AS score FROM busy GROUP BY level) WHERE score >= 1 ORDER BY score DESC, level DESC LIMIT 1),
    one AS (SELECT b.* FROM busy b JOIN p USING (level) ORDER BY CASE WHEN smallest > 'order/000000003500' THEN 0 ELSE 1 END, smallest LIMIT (SELECT CASE WHEN level = 0 THEN 1000000 ELSE 1 END FROM p)),
    span AS (SELECT min(smallest) AS a, max(largest) AS b, max(level) AS level FROM one)
    SELECT 'input' AS role, level, file_num FROM one UNION ALL SELECT 'next', b.level, b.file_num FROM busy b JOIN span s ON b.level = s.level + 1 AND b.smallest <= s.b AND b.largest >= s.a"""


@query(f"WITH {q._FILES}, busy AS (SELECT * FROM files WHERE level > 0), {_ROTATED}")
def compaction_inputs(spark, sf_dir):
    """The next compaction of a store without files in level 0: one file in rotation and what it overlaps."""
    return compact.pick_compaction(views.files_from_orders(spark, sf_dir).where("level > 0"), dict.fromkeys(range(1, 7), b"order/000000003500"))


@query(f"WITH {q._FILES}, busy AS (SELECT level, file_num, size / 1000 AS size, smallest, largest FROM files), {_ROTATED}")
def compaction_inputs_level_0(spark, sf_dir):
    """The next compaction where level 0 calls the loudest: all of it."""
    return compact.pick_compaction(views.files_from_orders(spark, sf_dir).withColumn("size", F.col("size") / 1000), dict.fromkeys(range(1, 7), b"order/000000003500"))


@query(f"""WITH {q._PLACED}, n AS (SELECT * FROM placed WHERE group_id = 20 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
    SELECT 20::BIGINT AS group_id, (9999999 + row_number() OVER (ORDER BY key))::BIGINT AS seq, key, 0::TINYINT AS kind FROM n JOIN slots s USING (key) WHERE kind = 1 AND s.slot % 4 = 2""")
def clear_slots(spark, sf_dir):
    return q._text(shard.clear_slots(views.placed_ops(spark, sf_dir, q.GROUPS), list(range(2, 256, 4)), 20, 10_000_000).drop("value"), "key")


@query(f"""WITH {q._PLACED}, n AS (SELECT p.*, s.slot FROM placed p JOIN slots s USING (key) WHERE group_id = 10 AND s.slot % 16 = 4 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT slot, key, value, 20::BIGINT AS group_id FROM n WHERE kind = 1""")
def copied_slot_pairs(spark, sf_dir):
    copied = shard.copy_slots(views.placed_ops(spark, sf_dir, q.GROUPS), list(range(4, 256, 16)), 10, 20)
    return q._text(copied.select("slot", "key", "value", "group_id"), "key", "value")


@query(f"""WITH {q._PLACED}, own AS (SELECT p.* FROM placed p JOIN slots s USING (key) WHERE p.group_id = [10, 20, 30, 40][s.slot % 4 + 1] AND key >= 'user:00000004'),
    n AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, value, row_number() OVER (ORDER BY key) AS place FROM (SELECT key, value FROM n WHERE kind = 1 ORDER BY key LIMIT 30)""")
def cluster_scan_page(spark, sf_dir):
    page = shard.cluster_scan(views.placed_ops(spark, sf_dir, q.GROUPS), shard.initial_map(spark, q.GROUPS), b"user:00000004", b"", 30)
    return q._text(q._ranked(page), "key", "value")


_MOVED = [s for s in range(256) if s % 4 == 1]


def _home(spark, sf_dir) -> DataFrame:
    """The event ops, each in its owner's group, and newer strays of a moving slot's pairs in the target."""
    routed = shard.route(views.ops_from_events(spark, sf_dir), shard.initial_map(spark, q.GROUPS)).withColumnRenamed("owner", "group_id")
    stray = routed.where(F.col("slot").isin(_MOVED)).select(F.lit(40).cast("long").alias("group_id"), (F.col("seq") + 1_000_000).alias("seq"), "key", F.lit(1).cast("tinyint").alias("kind"), F.lit(b"stray").alias("value"))
    return cut(routed.select("group_id", "seq", "key", "kind", "value").unionByName(stray))


@query(f"WITH {q._NEWEST}, {q._SLOTS} SELECT key, value, (CASE WHEN s.slot % 4 = 1 THEN 40 ELSE [10, 20, 30, 40][s.slot % 4 + 1] END)::BIGINT AS group_id FROM newest JOIN slots s USING (key) WHERE kind = 1")
def migrate_slots(spark, sf_dir):
    """All live pairs and their owners after a group's slots have moved."""
    after, flipped = shard.migrate_slots(_home(spark, sf_dir), shard.initial_map(spark, q.GROUPS), _MOVED, 20, 40, 10_000_000)
    return q._text(read.latest_live(shard.owned(after, flipped)).select("key", "value", "group_id"), "key", "value")


@query(f"WITH {q._NEWEST}, {q._SLOTS} SELECT key, value, [10, 20, 30, 40][s.slot % 4 + 1]::BIGINT AS group_id FROM newest JOIN slots s USING (key) WHERE kind = 1")
def migrate_there_and_back(spark, sf_dir):
    """All live pairs after a group's slots have moved away and back."""
    there, flipped = shard.migrate_slots(_home(spark, sf_dir), shard.initial_map(spark, q.GROUPS), _MOVED, 20, 40, 10_000_000)
    back, home = shard.migrate_slots(cut(there), flipped, _MOVED, 40, 20, 20_000_000)
    return q._text(read.latest_live(shard.owned(back, home)).select("key", "value", "group_id"), "key", "value")


@query(f"WITH {q._OPS}, w AS (SELECT * FROM ops WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, seq, value FROM w WHERE kind = 1")
def checkpoint_and_install(spark, sf_dir):
    """A checkpoint at 5000, made current twice and opened through CURRENT."""
    root = scratch(spark)
    store.checkpoint(views.ops_from_events(spark, sf_dir), 5000, f"{root}/v1", partitions=4)
    for _ in range(2):
        found = store.install(spark, root, "v1")
    return q._text(read.latest_live(found).select("key", "seq", "value"), "key", "value")


@query(f"WITH {q._NEWEST} SELECT key, seq, value FROM newest WHERE kind = 1")
def stored_log(spark, sf_dir):
    """A log written as one sorted run and one appended, opened again."""
    path, ops = scratch(spark), views.ops_from_events(spark, sf_dir)
    store.write_sorted(ops.where("seq % 2 = 0"), path, partitions=4)
    store.append(ops.where("seq % 2 = 1"), path)
    return q._text(read.latest_live(store.open_ops(spark, path)).select("key", "seq", "value"), "key", "value")


_REQUESTS = f"""{q._OPS}, r AS (SELECT o_orderkey AS i, ['read', 'update', 'rmw', 'insert', 'scan'][o_orderkey % 5 + 1] AS op, 'user:' || lpad((o_custkey % 300)::VARCHAR, 8, '0') AS key, (o_orderkey % 7)::INT AS n_scan, 'new' || o_orderkey AS value FROM orders),
    top AS (SELECT max(seq) AS last_seq FROM ops)"""


def _requests(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    ops, o = views.ops_from_events(spark, sf_dir), views.table(spark, sf_dir, "orders")
    op = F.element_at(F.array(*map(F.lit, ("read", "update", "rmw", "insert", "scan"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = o.select(F.col("o_orderkey").alias("i"), op.alias("op"), views.user_key(F.col("o_custkey") % 300).alias("key"), (F.col("o_orderkey") % 7).cast("int").alias("n_scan"), F.concat(F.lit("new"), F.col("o_orderkey").cast("string")).cast("binary").alias("value"))
    return ops, rows, ops.agg(F.max("seq")).first()[0]


@query(f"""WITH {_REQUESTS}, every AS (SELECT seq, key, kind, value FROM ops UNION ALL SELECT last_seq + 1 + i, key, 1, value FROM r, top WHERE op IN ('update', 'insert', 'rmw')),
    p AS (SELECT i, key, last_seq + i AS at_seq FROM r, top WHERE op IN ('read', 'rmw')) SELECT p.i, coalesce(e.kind = 1, false) AS found, CASE WHEN e.kind = 1 THEN e.value END AS value FROM p ASOF LEFT JOIN every e ON p.key = e.key AND p.at_seq >= e.seq""")
def request_reads(spark, sf_dir):
    """What the reads of a batch of requests return, each after the writes before it."""
    return q._text(serve.reads_of(*_requests(spark, sf_dir)), "value")


@query(f"WITH {_REQUESTS} SELECT last_seq + 1 + i AS seq, key, 1::TINYINT AS kind, value FROM r, top WHERE op IN ('update', 'insert', 'rmw')")
def request_writes(spark, sf_dir):
    _, rows, last = _requests(spark, sf_dir)
    return q._text(serve.writes_of(rows, last), "key", "value")


@query(f"""WITH {_REQUESTS}, live AS (SELECT key, value, row_number() OVER (ORDER BY key) AS nth FROM (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 1),
    keys AS (SELECT key AS start, (SELECT count(*) FROM live WHERE live.key < k.key) AS before FROM (SELECT DISTINCT key FROM r WHERE op = 'scan') k)
    SELECT r.i, count(l.key) AS pairs, coalesce(sum(strlen(l.value)), 0)::BIGINT AS value_bytes FROM r JOIN keys k ON k.start = r.key LEFT JOIN live l ON l.nth > k.before AND l.nth <= k.before + r.n_scan WHERE r.op = 'scan' GROUP BY r.i""")
def request_scans(spark, sf_dir):
    ops, rows, _ = _requests(spark, sf_dir)
    return serve.scans_of(ops, rows)


_ZETA = workload.zeta(1000)
_ZETA2 = workload.zeta(2)
_ETA = (1 - (2.0 / 1000) ** (1 - workload.THETA)) / (1 - _ZETA2 / _ZETA)


@query(f"""WITH u AS (SELECT event_id AS i, ((event_id * 7919 % 10007) + 0.5::DOUBLE) / 10007.0::DOUBLE AS u FROM events), z AS (SELECT i, u, least(CASE WHEN u * {_ZETA!r}::DOUBLE < 1.0 THEN 0 WHEN u * {_ZETA!r}::DOUBLE < 1.0 + pow(0.5::DOUBLE, 0.99::DOUBLE) THEN 1
    ELSE floor(1000.0::DOUBLE * pow({_ETA!r}::DOUBLE * u - {_ETA!r}::DOUBLE + 1, {1 / (1 - workload.THETA)!r}::DOUBLE))::BIGINT END, 999)::BIGINT AS zipfian FROM u)
    SELECT i, zipfian, 1000 + i - 1 - zipfian % (1000 + i) AS latest, floor(u * 1000)::BIGINT AS uniform FROM z""")
def key_pickers(spark, sf_dir):
    """Zipfian, latest and uniform picks from the same draws."""
    u = ((F.col("event_id") * 7919 % 10007) + F.lit(0.5)) / F.lit(10007.0)
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), u.alias("u"))
    return e.select("i", workload.zipfian(F.col("u"), 1000).alias("zipfian"), workload.latest(F.col("u"), 1000 + F.col("i"), 1000).alias("latest"), workload.uniform(F.col("u"), 1000).alias("uniform"))


@query("SELECT event_type AS method, CASE WHEN user_id % 7 = 0 THEN 'Unavailable' ELSE 'OK' END AS code, count(*) AS n FROM events GROUP BY ALL")
def request_counts(spark, sf_dir):
    from kvlake.functions import stats

    code = F.when(F.col("user_id") % 7 == 0, "Unavailable").otherwise("OK")
    return stats.request_counts(views.table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), code.alias("code")))


_GROUPS5 = "m AS (SELECT event_id // 5 AS group_id, user_id % 40 AS match_index FROM events), e AS (SELECT DISTINCT g.group_id, i AS log_index, i // 9 AS term FROM m g, range(40) AS r(i)), l AS (SELECT DISTINCT group_id, 2 AS term, group_id % 25 AS committed FROM m)"


@query(f"""WITH {_GROUPS5}, k AS (SELECT group_id, list_reverse_sort(list(match_index))[count(*) // 2 + 1] AS reached FROM m GROUP BY group_id)
    SELECT l.group_id, CASE WHEN reached > committed AND e.term = l.term THEN reached ELSE committed END AS commit_index FROM l JOIN k USING (group_id) LEFT JOIN e ON e.group_id = l.group_id AND e.log_index = k.reached""")
def commit_in_term(spark, sf_dir):
    """A majority's index commits only if that entry is of the leader's term."""
    m = views.table(spark, sf_dir, "events").select(F.expr("event_id div 5").alias("group_id"), (F.col("user_id") % 40).alias("match_index"))
    groups = m.select("group_id").distinct()
    entries = groups.select("group_id", F.explode(F.expr("sequence(0L, 39L)")).alias("log_index")).withColumn("term", F.expr("log_index div 9"))
    return audit.commit_index(m, entries, groups.select("group_id", F.lit(2).alias("term"), (F.col("group_id") % 25).alias("committed")))


@query("SELECT user_id % 9 AS node, event_id // 40 AS term, count(DISTINCT user_id % 2) AS candidates FROM events GROUP BY ALL HAVING candidates > 1")
def double_votes(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return audit.double_votes(e.select((F.col("user_id") % 9).alias("node"), F.expr("event_id div 40").alias("term"), (F.col("user_id") % 2).alias("candidate")))


@query("WITH c AS (SELECT user_id AS group_id, event_id AS log_index, greatest(event_id - 1 - floor(value)::BIGINT, 0) AS applied FROM events), p AS (SELECT group_id, log_index, applied, lag(log_index) OVER (PARTITION BY group_id ORDER BY log_index) AS previous_index FROM c) SELECT group_id, log_index, previous_index FROM p WHERE previous_index > applied")
def overlapping_member_changes(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return audit.overlapping_changes(e.select(F.col("user_id").alias("group_id"), F.col("event_id").alias("log_index"), F.greatest(F.col("event_id") - 1 - F.floor("value"), F.lit(0)).alias("applied")))
