"""Views over the given tables that supply the operators' inputs, in Spark and, as CTE text, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files. A stream reads folders and patterns, so the name is written as one."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def v_seq(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.upper(F.regexp_replace("text", "[^ACGTacgt]+", "")).alias("sequence"), F.col("source").alias("file"))


def v_prot(spark, d):
    letters = "ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy"  # one by one: Java looks these up in a table, but walks ranges one after the other for each character
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.upper(F.regexp_replace("text", f"[^{letters}]+", "")).alias("sequence"))


def v_tasks(spark, d):
    return tasks_of(table(spark, d, "orders"))


def tasks_of(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "cast(o_orderkey as string) task_id",
        "concat('f', o_orderkey, case when o_orderkey % 13 = 0 then '.xyz' else case o_orderkey % 6 when 0 then '.pdf' when 1 then '.fasta' when 2 then '.wav' when 3 then '.mp4' when 4 then '.docx' else '.xyz' end end) file_name",
        "case when o_orderstatus = 'O' then 'pending' when o_orderstatus = 'P' then 'processing' when o_orderkey % 17 = 0 then 'failed' when o_orderkey % 19 = 0 then 'cancelled' else 'completed' end status",
        "5 - cast(substr(o_orderpriority, 1, 1) as int) priority",
        "o_custkey user_id",
        "cast(o_orderdate as timestamp) created_at",
        "cast(case when o_orderstatus <> 'O' then o_orderdate + (o_orderkey % 90) * interval '1' minute end as timestamp) started_at",
        "cast(case when o_orderstatus = 'F' then o_orderdate + (o_orderkey % 90) * interval '1' minute + (o_orderkey % 7200) * interval '1' second end as timestamp) completed_at",
        "concat('prep-host', o_orderkey % 5, '-cuda:', o_orderkey % 4, '-', o_orderkey % 100) worker_id",
        "case o_orderkey % 4 when 0 then 'auto' when 1 then 'pipeline' when 2 then 'video' else 'genbank' end backend",
        "case when o_orderkey % 3 <> 0 then concat('/out/', o_orderkey) end result_path",
        "cast(o_orderkey % 3 as int) retry_count",
        "o_orderkey key",
    )


def v_users(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey user_id", "c_name username", "case c_custkey % 10 when 0 then 'admin' when 1 then 'manager' else 'user' end role", "c_custkey % 7 <> 0 is_active", "cast(date'2023-01-01' + cast(c_custkey % 365 as int) as timestamp) created_at", "concat(lower(replace(c_name, '#', '_')), case when c_custkey % 50 = 0 then '' else concat('_', c_custkey) end, '@example.org') email")


def v_keys(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey key_id", "c_custkey % 997 + 1 user_id", "concat('key ', c_custkey) name", "sha2(concat('sk-', c_name), 256) api_key_hash", "substr(concat('sk-', c_name), 1, 10) prefix", "c_custkey % 11 <> 0 is_active", "timestamp'2024-01-01 00:00:00' created_at", "case when c_custkey % 3 = 0 then timestamp'2024-01-15 00:00:00' end expires_at", "concat('sk-', c_name) presented")


def v_segments(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id file_id", "turn id", "case turn % 4 when 0 then concat('<|en|><|HAPPY|><|Speech|>', text) when 1 then concat('<|de|><|BGM|>', text) else text end text", "cast(turn * 5.5 as double) start_s", "cast(turn * 5.5 + 4.0 as double) end_s", "role speaker")


def v_frames(spark, d):
    return table(spark, d, "embeddings").selectExpr("label video_id", "row_number() over (partition by label order by vec_id) - 1 frame_number", "embedding gray")


def v_doc_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "page_text"))


def v_boxes(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey page_id", "l_linenumber box_no", "cast(l_quantity as int) * 10 x1", "cast(l_partkey % 500 as int) y1", "cast(l_quantity as int) * 10 + 40 x2", "cast(l_partkey % 500 as int) + 20 y2", "cast(l_discount as double) * 10 conf")


def v_snapshots(spark, d):
    return table(spark, d, "events").selectExpr("date_trunc('hour', ts) snap_at", "event_type status").groupBy("snap_at", "status").agg(F.count("*").alias("n"))


def v_features(spark, d):
    """Annotation features derived from line items: one record per order."""
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey record_id", "l_linenumber feature_no",
        "case l_partkey % 8 when 0 then 'gene' when 1 then 'CDS' when 2 then 'regulatory' when 3 then 'tRNA' when 4 then 'rRNA' when 5 then 'promoter' when 6 then 'source' else 'mRNA' end type",
        "concat(case when l_suppkey % 2 = 0 then 'complement(' else '' end, l_partkey, '..', l_partkey + 90, case when l_suppkey % 2 = 0 then ')' else '' end) location",
        "map_filter(map('gene', case when l_suppkey % 3 <> 0 then array(concat('g', l_suppkey)) end, 'locus_tag', array(concat('L', l_partkey)), 'product', array(concat('product ', l_partkey % 40)), 'organism', case when l_partkey % 8 = 6 then array(concat('organism ', l_suppkey % 9)) end, 'regulatory_class', case when l_partkey % 8 = 2 then array('promoter') end, 'translation', case when l_partkey % 8 = 1 then array(repeat('M', cast(l_quantity as int))) end), (k, v) -> v is not null) qualifiers",
    )


DUCK = {
    "v_seq": "select doc_id seq_id, upper(regexp_replace(text,'[^ACGTacgt]','','g')) sequence, source file from documents",
    "v_prot": "select doc_id seq_id, upper(regexp_replace(text,'[^A-Za-z]|[BJOUXZbjouxz]','','g')) sequence from documents",
    "v_tasks": """select cast(o_orderkey as varchar) task_id,
  concat('f',o_orderkey,case when o_orderkey%13=0 then '.xyz' else case o_orderkey%6 when 0 then '.pdf' when 1 then '.fasta' when 2 then '.wav' when 3 then '.mp4' when 4 then '.docx' else '.xyz' end end) file_name,
  case when o_orderstatus='O' then 'pending' when o_orderstatus='P' then 'processing' when o_orderkey%17=0 then 'failed' when o_orderkey%19=0 then 'cancelled' else 'completed' end status,
  5-cast(substr(o_orderpriority,1,1) as int) priority, o_custkey user_id, o_orderdate created_at,
  case when o_orderstatus<>'O' then o_orderdate + (o_orderkey%90) * interval '1' minute end started_at,
  case when o_orderstatus='F' then o_orderdate + (o_orderkey%90) * interval '1' minute + (o_orderkey%7200) * interval '1' second end completed_at,
  concat('prep-host',o_orderkey%5,'-cuda:',o_orderkey%4,'-',o_orderkey%100) worker_id,
  case o_orderkey%4 when 0 then 'auto' when 1 then 'pipeline' when 2 then 'video' else 'genbank' end backend,
  case when o_orderkey%3<>0 then concat('/out/',o_orderkey) end result_path, cast(o_orderkey%3 as int) retry_count, o_orderkey key from orders""",
    "v_users": "select c_custkey user_id, c_name username, case c_custkey%10 when 0 then 'admin' when 1 then 'manager' else 'user' end role, c_custkey%7<>0 is_active, cast(date '2023-01-01' + cast(c_custkey%365 as int) as timestamp) created_at, concat(lower(replace(c_name,'#','_')), case when c_custkey%50=0 then '' else concat('_',c_custkey) end, '@example.org') email from customer",
    "v_keys": "select c_custkey key_id, c_custkey%997+1 user_id, concat('key ',c_custkey) name, sha256(concat('sk-',c_name)) api_key_hash, substr(concat('sk-',c_name),1,10) prefix, c_custkey%11<>0 is_active, timestamp '2024-01-01 00:00:00' created_at, case when c_custkey%3=0 then timestamp '2024-01-15 00:00:00' end expires_at, concat('sk-',c_name) presented from customer",
    "v_segments": "select conv_id file_id, turn id, case turn%4 when 0 then concat('<|en|><|HAPPY|><|Speech|>',text) when 1 then concat('<|de|><|BGM|>',text) else text end text, cast(turn*5.5 as double) start_s, cast(turn*5.5+4.0 as double) end_s, role speaker from conversations",
    "v_frames": "select label video_id, row_number() over (partition by label order by vec_id)-1 frame_number, embedding gray from embeddings",
    "v_doc_pages": "select doc_id, unnest(range(0,len(string_split(text,chr(10))))) page_no, unnest(string_split(text,chr(10))) page_text from documents",
    "v_boxes": "select l_orderkey page_id, l_linenumber box_no, cast(l_quantity as int)*10 x1, cast(l_partkey%500 as int) y1, cast(l_quantity as int)*10+40 x2, cast(l_partkey%500 as int)+20 y2, cast(l_discount as double)*10 conf from lineitem",
    "v_snapshots": "select date_trunc('hour',ts) snap_at, event_type status, count(*) n from events group by 1,2",
    "v_features": """select l_orderkey record_id, l_linenumber feature_no,
  case l_partkey%8 when 0 then 'gene' when 1 then 'CDS' when 2 then 'regulatory' when 3 then 'tRNA' when 4 then 'rRNA' when 5 then 'promoter' when 6 then 'source' else 'mRNA' end type,
  concat(case when l_suppkey%2=0 then 'complement(' else '' end,l_partkey,'..',l_partkey+90,case when l_suppkey%2=0 then ')' else '' end) location,
  case when l_suppkey%3<>0 then concat('g',l_suppkey) end q_gene, concat('L',l_partkey) q_locus, concat('product ',l_partkey%40) q_product,
  case when l_partkey%8=6 then concat('organism ',l_suppkey%9) end q_organism, case when l_partkey%8=1 then cast(l_quantity as int) end q_translation from lineitem""",
}


def duck(sql: str, *names: str) -> str:
    """An oracle query with the views it names in front."""
    return "with " + ", ".join(f"{n} as ({DUCK[n]})" for n in names) + (", " + sql.removeprefix("with ") if sql.startswith("with ") else " " + sql)
