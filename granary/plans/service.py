"""Queries and oracles of B01-B08, C01-C18 and D01-D09."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from granary.constants import ENGINE_INFO, ENGINES, PERMISSIONS, STATUSES
from granary.operators import access as D
from granary.operators import ledger as C
from granary.operators import routing as B
from granary.plans.views import duck, stream_table, table, tasks_of, v_keys, v_snapshots, v_tasks, v_users
from granary.functions.shared import shared_folder
from granary.sources.results import append_stream
from granary.streaming.lifecycle import drain, task_lifecycle
from granary.streaming.monitor import queue_monitor

AS_OF = dt.datetime(1998, 8, 1)
COLS = ("task_id", "status", "priority", "file_name")


def _options(s, d):
    t = v_tasks(s, d)
    return t.withColumn("options", F.expr("case key % 4 when 0 then '{}' when 1 then '{\"lang\":\"en\",\"table_enable\":false}' when 2 then concat('{\"watermark_dilation\":', key % 20, ',\"remove_watermark\":true,\"method\":\"ocr\"}') end"))


def _events(s, d):
    return table(s, d, "events").select(F.concat("user_id", F.lit("-"), "event_type").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))


def _log(s, d, events=None):
    states = F.array(*[F.lit(x) for x in ("processing", "completed", "pending", "failed", "processing", "cancelled")])
    return (table(s, d, "events") if events is None else events).select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.get(states, (F.col("event_id") % 6).cast("int")).alias("requested_status"), F.concat(F.lit("w"), F.col("event_id") % 3).alias("worker_id"))


def _requests(tasks):
    """What a stream of the tasks' requests holds: a start for each that is started, an end for each that is ended."""
    start = F.when(F.col("started_at").isNotNull(), F.struct(F.lit(1).alias("seq"), F.col("started_at").alias("ts"), F.lit("processing").alias("requested_status")))
    end = F.when(F.col("completed_at").isNotNull(), F.struct(F.lit(2).alias("seq"), F.col("completed_at").alias("ts"), F.col("status").alias("requested_status")))
    return tasks.select("task_id", "worker_id", F.inline(F.array_compact(F.array(start, end))))


def c01_stream(s, d):
    top = shared_folder(s, "c01")
    asked = tasks_of(stream_table(s, d, "orders")).select("file_name", F.concat(F.lit("/in/"), "task_id").alias("file_path"), "priority", "backend", F.col("created_at").alias("submitted_at"))
    append_stream(asked.union(asked), f"{top}/log", f"{top}/progress").awaitTermination()
    return s.read.parquet(f"{top}/log").select("file_path", "status", F.col("priority").cast("long").alias("priority"), "backend", "created_at")


def c03_stream(s, d):
    moves = drain(task_lifecycle(_log(s, d, stream_table(s, d, "events")), "1 day", None, None), "c03")
    return moves.select("task_id", "seq", "accepted", "status")


def c18_lifecycle(s, d):
    life = drain(task_lifecycle(_requests(tasks_of(stream_table(s, d, "orders"))), "1 hour", 60, 30), "c18")
    return life.select("task_id", "event", "at", "accepted", "status", F.col("retry_count").cast("long").alias("retry_count"))


def c11(s, d):
    t = v_tasks(s, d)
    asked = table(s, d, "orders").where("o_orderkey % 5 = 0").selectExpr("cast(o_orderkey + case when o_orderkey % 25 = 0 then 1000000000 else 0 end as string) task_id")
    return C.cancel_pending(t, asked)


def d07(s, d):
    u = v_users(s, d).selectExpr("user_id", "username", "email", "cast(null as string) full_name", "concat('s', user_id) sso_subject", "'oidc' sso_provider", "created_at last_login")
    logins = table(s, d, "customer").selectExpr("concat('s', c_custkey * 2) subject", "'oidc' provider", "c_name username", "cast(null as string) email", "c_mktsegment full_name")
    return D.sso_upsert(u, logins, AS_OF)


def d08(s, d):
    patches = table(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey user_id", "case when c_custkey % 2 = 0 then concat('new', c_custkey, '@example.org') end email", "case when c_custkey % 9 = 0 then 'admin' end role")
    return D.patch_users(v_users(s, d), patches).select("user_id", "email", "role", "is_active")


QUERIES = {
    "b01_route_engine": lambda s, d: B.route_engine(v_tasks(s, d), B.engine_registrations(s)).select("task_id", "engine", "route_error"),
    "b02_lookup_engine": lambda s, d: B.lookup_engine(v_tasks(s, d), B.engine_registrations(s)).select("task_id", "ext", "engine", "supported"),
    "b03_files_by_engine": lambda s, d: B.lookup_engine(v_tasks(s, d), B.engine_registrations(s)).join(F.broadcast(B.engine_catalogue(B.engine_registrations(s))), "engine").groupBy("engine", F.array_join("extensions", ",").alias("extensions")).agg(F.count("*").alias("n")),
    "b03_catalogue": lambda s, d: B.engine_catalogue(B.engine_registrations(s)).join(B.lookup_engine(v_tasks(s, d), B.engine_registrations(s)).groupBy("engine").agg(F.count("*").alias("files")), "engine").select("category", "engine", "display_name", "description", F.array_join("extensions", ",").alias("extensions"), "n", "files"),
    "c01_append_stream": c01_stream,
    "b04_option_defaults": lambda s, d: B.apply_option_defaults(_options(s, d)).select("task_id", "lang", "method", "table_enable", "remove_watermark", "watermark_dilation", "document_lang"),
    "b05_project_options": lambda s, d: B.project_options(_options(s, d), ["watermark_dilation", "method"], {"watermark_dilation": "dilation"}).select("task_id", F.explode("options_map").alias("option", "value")),
    "b06_split_errors": lambda s, d: B.split_errors(B.route_engine(v_tasks(s, d), B.engine_registrations(s)).withColumn("error_type", F.when(F.col("route_error").isNotNull(), "ValueError")), message="route_error")[1].select("task_id", "status", "error_message"),
    "b07_sequence_lang": lambda s, d: table(s, d, "documents").select("doc_id", B.sequence_lang(F.when(F.col("lang") == "de", " ZH-cn ").otherwise(F.col("lang"))).alias("out_lang")),
    "c01_append_tasks": lambda s, d: C.append_tasks(v_tasks(s, d).selectExpr("file_name", "concat('/in/', task_id) file_path", "priority", "backend"), AS_OF).select("file_path", "status", "priority", "backend", "retry_count"),
    "c02_claim_next": lambda s, d: C.claim_next(v_tasks(s, d), 100, 8),
    "c03_apply_transitions": lambda s, d: C.apply_transitions(_log(s, d)),
    "c04_latest_state": lambda s, d: C.latest_state(_events(s, d)).select("task_id", "seq", "status"),
    "c05_queue_stats": lambda s, d: C.queue_stats(v_tasks(s, d)),
    "c06_tasks_by_status": lambda s, d: C.tasks_by_status(v_tasks(s, d), "failed").select(*COLS),
    "c07_list_tasks": lambda s, d: C.list_tasks(v_tasks(s, d), D.permission_table(s), 7, "manager", limit=2000).select(*COLS),
    "c07_list_own_tasks": lambda s, d: C.list_tasks(v_tasks(s, d), D.permission_table(s), 7, "user").select(*COLS),
    "c08_retention_files": lambda s, d: C.retention_files(v_tasks(s, d), AS_OF)[0].select("task_id", "result_path"),
    "c09_retention_records": lambda s, d: C.retention_records(v_tasks(s, d), AS_OF).select("task_id", "status"),
    "c10_reset_stale": lambda s, d: C.reset_stale(v_tasks(s, d), AS_OF).select("task_id", "status", "worker_id", F.col("retry_count").cast("int").alias("retry_count")),
    "c11_cancel_pending": c11,
    "c12_processing_time": lambda s, d: C.processing_time(v_tasks(s, d)).select("task_id", "seconds_text"),
    "c13_search_page": lambda s, d: C.search_tasks(v_tasks(s, d), search="F1", status="completed", page=3)[0].select(*COLS),
    "c13_search_total": lambda s, d: C.search_tasks(v_tasks(s, d), search="F1", status="completed")[1],
    "c14_recent_tasks": lambda s, d: C.recent_tasks(v_tasks(s, d)).select(*COLS),
    "c15_status_split": lambda s, d: C.status_split(v_tasks(s, d), "backend"),
    "c16_snapshot_change": lambda s, d: C.snapshot_change(v_snapshots(s, d)),
    "c17_worker_parts": lambda s, d: C.worker_parts(v_tasks(s, d)).groupBy("host", "device", "tail").agg(F.count("*").alias("n")),
    "c18_queue_monitor": lambda s, d: queue_monitor(_events(s, d)),
    "c03_transition_stream": c03_stream,
    "c18_task_lifecycle": c18_lifecycle,
    "d01_resolve_keys": lambda s, d: D.resolve_keys(v_keys(s, d).select(F.col("key_id").alias("request_id"), "presented"), v_keys(s, d), v_users(s, d), dt.datetime(2024, 1, 10)),
    "d02_key_expiry": lambda s, d: D.key_expiry(v_keys(s, d).drop("expires_at").withColumn("expires_days", F.expr("case when key_id % 4 <> 0 then cast(key_id % 90 as int) end"))).select("key_id", "expires_at"),
    "d03_list_users": lambda s, d: D.list_users(v_users(s, d), 50, 25).select("user_id", "username"),
    "d04_list_keys": lambda s, d: D.list_keys(v_keys(s, d), 8).select("key_id", "name", "prefix"),
    "d05_check_permission": lambda s, d: D.check_permission(v_users(s, d), D.permission_table(s), "user:list").select("user_id", "allowed", D.role_level("role").cast("long").alias("level")),
    "d06_owned_rows": lambda s, d: D.owned_rows(v_tasks(s, d), D.permission_table(s), 7, "user", "task:view:all").select("task_id", "status"),
    "d07_sso_upsert": lambda s, d: d07(s, d).select("username", "email", "full_name", "sso_subject", F.date_format("last_login", "yyyy-MM-dd").alias("last_login")),
    "d08_patch_users": d08,
    "d08_delete_users": lambda s, d: D.delete_users(v_users(s, d), v_keys(s, d), v_users(s, d).where("user_id % 10 = 3").select("user_id"))[1].select("key_id", "user_id"),
    "d09_validate_users": lambda s, d: D.validate_users(v_users(s, d)).select("user_id", F.array_join("violations", ",").alias("violations")),
}

_EXT = "case when regexp_matches(file_name, '[^/.]\\.[^./]+$') then lower(regexp_extract(file_name, '[^/.](\\.[^./]+)$', 1)) else '' end"
_ENGINE = "case ext when '.pdf' then 'pipeline' when '.fasta' then 'fasta' when '.wav' then 'sensevoice' when '.mp4' then 'video' when '.docx' then 'markitdown' end"
_T = f"with x as (select *, {_EXT} ext from v_tasks), y as (select *, {_ENGINE} by_ext from x), r as (select task_id, case when backend in ('pipeline', 'video') then backend when backend = 'auto' then by_ext else 'genbank' end engine, case when backend = 'auto' and by_ext is null then 'unsupported file type: ' || ext end route_error from y) "
_NEW = "order by created_at desc, task_id limit"
_PERMS = ", ".join(f"('{r}', '{p}')" for r, ps in PERMISSIONS.items() for p in ps)
_AS = "timestamp '1998-08-01 00:00:00'"


def _four(tail: str) -> str:
    return duck(f"select task_id, status, priority, file_name from v_tasks {tail}", "v_tasks")


_GUARD = """with recursive e as (select cast(user_id as varchar) task_id, event_id seq, row_number() over (partition by user_id order by event_id) k, ['processing', 'completed', 'pending', 'failed', 'processing', 'cancelled'][event_id % 6 + 1] req, 'w' || (event_id % 3) who from events{only}),
w as (select distinct task_id, 0::bigint k, null::bigint seq, 'pending' status, null::varchar worker, false accepted from e
union all select task_id, k, seq, case when ok then req else status end, case when not ok then worker when req = 'pending' then null when req = 'processing' then who else worker end, ok
from (select e.*, w.status, w.worker, req not in ('completed', 'failed') or (w.status = 'processing' and coalesce(w.worker = who, false)) ok from w join e on e.task_id = w.task_id and e.k = w.k + 1))
select task_id, seq, accepted, status from w where k > 0"""
_OPT = "with o as (select task_id, key % 4 m, key % 20 w from v_tasks) "

_ENGINE_ROWS = ", ".join(f"('{e}', '{c}', '{n}', '{t}', '{','.join(sorted(ENGINES[e]))}', {len(set(ENGINES[e]))}::bigint)" for e, (c, n, t) in ENGINE_INFO.items() if e in ENGINES)

ORACLES = {
    "b03_files_by_engine": duck(_T + f", i(engine, category, display_name, description, extensions, n) as (values {_ENGINE_ROWS}) select engine, extensions, count(*) n from (select by_ext engine from y) join i using (engine) group by 1, 2", "v_tasks"),
    "b03_catalogue": duck(_T + f", i(engine, category, display_name, description, extensions, n) as (values {_ENGINE_ROWS}) select category, engine, display_name, description, extensions, n, count(*) files from (select by_ext engine from y) join i using (engine) group by all", "v_tasks"),
    "c01_append_stream": duck("select '/in/' || task_id file_path, 'pending' status, priority::bigint priority, backend, created_at from v_tasks", "v_tasks"),
    "b01_route_engine": duck(_T + "select * from r", "v_tasks"),
    "b02_lookup_engine": duck(_T + "select task_id, ext, by_ext engine, by_ext is not null supported from y", "v_tasks"),
    "b04_option_defaults": duck(_OPT + "select task_id, case when m = 1 then 'en' else 'auto' end lang, case when m = 2 then 'ocr' else 'auto' end \"method\", m <> 1 table_enable, m = 2 remove_watermark, cast(case when m = 2 then w else 10 end as int) watermark_dilation, case when m = 1 then 'en' else 'ch' end document_lang from o", "v_tasks"),
    "b05_project_options": duck(_OPT + "select task_id, 'dilation' \"option\", cast(w as varchar) \"value\" from o where m = 2 union all select task_id, 'method', 'ocr' from o where m = 2", "v_tasks"),
    "b06_split_errors": duck(_T + "select task_id, 'failed' status, 'ValueError: ' || route_error error_message from r where route_error is not null", "v_tasks"),
    "b07_sequence_lang": "select doc_id, case when lang = 'de' then 'zh' else 'en' end out_lang from documents",
    "c01_append_tasks": duck("select '/in/' || task_id file_path, 'pending' status, priority, backend, 0 retry_count from v_tasks", "v_tasks"),
    "c02_claim_next": duck("with q as (select task_id, row_number() over (order by priority desc, created_at, task_id) rank from v_tasks where status = 'pending') select task_id, rank, (rank - 1) % 8 worker from q where rank <= 100", "v_tasks"),
    "c04_latest_state": "select user_id || '-' || event_type task_id, event_id seq, event_type status from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "c05_queue_stats": duck("with n as (select s status, (select count(*) from v_tasks where status = s) n from (values " + ", ".join(f"('{x}')" for x in STATUSES) + ") t(s)) select * from n union all select 'total', cast(sum(n) as bigint) from n", "v_tasks"),
    "c06_tasks_by_status": _four(f"where status = 'failed' {_NEW} 100"),
    "c07_list_tasks": _four(f"{_NEW} 1000"),
    "c07_list_own_tasks": _four(f"where user_id = 7 {_NEW} 100"),
    "c08_retention_files": duck(f"select task_id, case when completed_at < {_AS} - interval 7 day and status in ('completed', 'failed') then null else result_path end result_path from v_tasks", "v_tasks"),
    "c09_retention_records": duck(f"select task_id, status from v_tasks where not coalesce(completed_at < {_AS} - interval 30 day and status in ('completed', 'failed'), false)", "v_tasks"),
    "c10_reset_stale": duck(f"with s as (select *, coalesce(status = 'processing' and started_at < {_AS} - interval 60 minute, false) stale from v_tasks) select task_id, case when stale then 'pending' else status end status, case when not stale then worker_id end worker_id, retry_count + cast(stale as int) retry_count from s", "v_tasks"),
    "c11_cancel_pending": duck("with a as (select cast(o_orderkey + case when o_orderkey % 25 = 0 then 1000000000 else 0 end as varchar) task_id from orders where o_orderkey % 5 = 0) select task_id, coalesce(status = 'pending', false) cancelled, case when status is null then 'not found' when status <> 'pending' then 'status is ' || status end reason from a left join v_tasks using (task_id)", "v_tasks"),
    "c12_processing_time": duck("select task_id, case when completed_at is null or started_at is null then 'N/A' else printf('%.2f seconds', epoch_us(completed_at) / 1e6 - epoch_us(started_at) / 1e6) end seconds_text from v_tasks", "v_tasks"),
    "c13_search_page": _four("where status = 'completed' and (contains(lower(file_name), 'f1') or contains(lower(task_id), 'f1')) order by created_at desc, task_id limit 20 offset 40"),
    "c13_search_total": duck("select count(*) \"rows\", cast(ceil(count(*) / 20) as bigint) pages from v_tasks where status = 'completed' and (contains(lower(file_name), 'f1') or contains(lower(task_id), 'f1'))", "v_tasks"),
    "c14_recent_tasks": _four(f"{_NEW} 10"),
    "c15_status_split": duck("select backend, " + ", ".join(f"count(*) filter (where status = '{x}') {x}" for x in STATUSES) + " from v_tasks group by 1", "v_tasks"),
    "c16_snapshot_change": duck("select *, lag(n) over (partition by status order by snap_at) is distinct from n changed from v_snapshots", "v_snapshots"),
    "c17_worker_parts": duck("select split_part(worker_id, '-', 2) host, split_part(worker_id, '-', 3) device, split_part(worker_id, '-', 4) tail, count(*) n from v_tasks group by 1, 2, 3", "v_tasks"),
    "c18_queue_monitor": "select time_bucket(interval 5 minute, ts) window_start, event_type status, count(*) n from events group by 1, 2",
    "d01_resolve_keys": duck("select r.key_id request_id, k.user_id from v_keys r join v_keys k on k.api_key_hash = sha256(r.presented) and k.prefix = substr(r.presented, 1, 10) join v_users u on u.user_id = k.user_id where k.is_active and u.is_active and (k.expires_at is null or k.expires_at > timestamp '2024-01-10 00:00:00')", "v_keys", "v_users"),
    "d02_key_expiry": duck("select key_id, case when key_id % 4 <> 0 then created_at + to_days(cast(key_id % 90 as int)) end expires_at from v_keys", "v_keys"),
    "d03_list_users": duck("select user_id, username from v_users order by created_at desc, user_id limit 50 offset 25", "v_users"),
    "d04_list_keys": duck("select key_id, name, prefix from v_keys where user_id = 8", "v_keys"),
    "d05_check_permission": duck("select user_id, role in ('manager', 'admin') allowed, cast(case role when 'user' then 0 when 'manager' then 1 else 2 end as bigint) \"level\" from v_users", "v_users"),
    "d06_owned_rows": duck("select task_id, status from v_tasks where user_id = 7", "v_tasks"),
    "d07_sso_upsert": duck("with l as (select 's' || (c_custkey * 2) subject, c_name username, c_mktsegment full_name from customer), j as (select u.user_id, u.username un, u.email, u.created_at, l.* from (select *, 's' || user_id sso from v_users) u full join l on u.sso = l.subject) select coalesce(un, username) username, coalesce(email, case when un is null then 'oidc_' || subject || '@sso.local' end) email, coalesce(full_name, case when subject is null then null else username end) full_name, coalesce(case when user_id is not null then 's' || user_id end, subject) sso_subject, strftime(case when subject is not null then timestamp '1998-08-01 00:00:00' else created_at end, '%Y-%m-%d') last_login from j", "v_users"),
    "d08_patch_users": duck("select user_id, case when user_id % 3 = 0 and user_id % 2 = 0 then 'new' || user_id || '@example.org' else email end email, case when user_id % 9 = 0 then 'admin' else role end role, is_active from v_users", "v_users"),
    "d08_delete_users": duck("select key_id, user_id from v_keys where user_id not in (select user_id from v_users where user_id % 10 = 3)", "v_keys", "v_users"),
    "d09_validate_users": duck("select user_id, concat_ws(',', case when count(*) over (partition by email) > 1 then 'email_taken' end, case when not regexp_matches(username, '^[a-zA-Z0-9_-]+$') then 'username_format' end, case when length(username) not between 3 and 50 then 'username_length' end, case when count(*) over (partition by username) > 1 then 'username_taken' end) violations from v_users", "v_users"),
    "c03_apply_transitions": _GUARD.format(only=""),
    "c03_transition_stream": _GUARD.format(only=" where ts < (select max(ts) - interval 1 day from events)"),
    "c18_task_lifecycle": duck("""with t as (select task_id, status, started_at s, completed_at c, completed_at > started_at + interval 60 minute late from v_tasks where started_at is not null),
n as (select greatest(max(s), max(c)) - interval 1 hour as now from t),
e as (select task_id, 'request' event, s "at", true accepted, 'processing' status, 0::bigint retry_count from t
union all select task_id, 'reset', s + interval 60 minute, true, 'pending', 1 from t where coalesce(late, true)
union all select task_id, 'request', c, not late or status = 'cancelled', case when late and status <> 'cancelled' then 'pending' else status end, late::bigint from t where c is not null
union all select task_id, 'dropped', c + interval 30 day, true, status, 0 from t where c is not null and not late and status in ('completed', 'failed'))
select e.* from e, n where "at" < now""", "v_tasks"),
}
