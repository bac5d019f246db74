"""Queries and oracles of A01-A11 on inputs that Spark derives from the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from granary.operators import annotations as H
from granary.operators.routing import default_registry, split_errors
from granary.plans.views import duck, table, v_seq, v_tasks
from granary.functions.shared import shared_folder
from granary.sources import fasta as FA
from granary.sources import files as A
from granary.sources.genbank import parse_genbank
from granary.sources.html import html_blocks, html_to_markdown
from granary.sources.results import ResultStore


AS_OF = dt.datetime(1998, 8, 1)


def _files(s, d):
    return table(s, d, "documents").selectExpr("concat('/out/', doc_id % 50, case when doc_id % 4 = 0 then '/page_1/' else '/' end, case doc_id % 3 when 0 then 'a.md' when 1 then 'content.json' else 'x.png' end) path", "doc_id", "octet_length(text) length")


def a02(s, d):
    raw = v_seq(s, d).select("file", F.col("seq_id").alias("key"), F.concat(F.lit(">s"), "seq_id", F.lit(" from "), "file", F.lit("\n"), F.regexp_replace("sequence", "(.{60})", "$1\n")).alias("value"))
    return FA.fasta_records(raw, F.col("key")).select("file", "seq_id", "description", F.md5("sequence").alias("sequence_md5"), "length")


def _fasta_files(s, d):
    """Sequence files of a thousand records each in the shared folder, in order of seq_id."""
    path = shared_folder(s, "fasta")
    lines = F.concat(F.lit(">s"), "seq_id", F.lit(" of "), "file", F.lit("\n"), F.regexp_replace("sequence", "(.{60})", "$1\n"))
    rows = v_seq(s, d).select(F.floor(F.col("seq_id") / 1000).alias("thousand"), "seq_id", lines.alias("value"))
    rows.repartition("thousand").sortWithinPartitions("thousand", "seq_id").drop("seq_id").write.partitionBy("thousand").text(path)
    return f"{path}/thousand=*"


def a02_files(s, d):
    return FA.read_fasta(s, _fasta_files(s, d)).select(F.regexp_extract("file", "thousand=([0-9]+)", 1).cast("long").alias("thousand"), "ord", "seq_id", "description", F.md5("sequence").alias("sequence_md5"), "length")


def a02_chunks(s, d):
    chunks, records = FA.read_fasta_chunks(s, _fasta_files(s, d), 1000)
    named = chunks.join(records.select("seq_id", "name"), "seq_id")
    return named.select("name", "chunk", "start", F.md5("text").alias("text_md5"), F.md5("ahead").alias("ahead_md5"))


def _flat_files(s, d):
    """A flat-file record for each order, its line items as features."""
    f = table(s, d, "lineitem").selectExpr("l_orderkey k", "struct(l_linenumber n, l_suppkey s, l_partkey p) x").groupBy("k").agg(F.collect_list("x").alias("items"))  # numbers are shuffled, texts made from them
    body = f.withColumn("features", F.expr("transform(items, x -> struct(x.n as n, concat(rpad(concat('     ', case x.n % 3 when 0 then 'CDS' when 1 then 'gene' else 'tRNA' end), 21, ' '), case when x.s % 2 = 0 then concat('complement(', x.p, '..', x.p + 90, ')') else concat(x.p, '..', x.p + 90) end, '\n                     /gene=\"g', x.s, '\"\n                     /product=\"a long\n                     name ', x.p, '\"') as t))")).select("k", F.array_join(F.transform(F.array_sort("features"), lambda x: x["t"]), "\n").alias("body"))
    return body.select(F.lit("orders.gb").alias("file"), F.concat(F.lit("LOCUS       L"), "k", F.lit(" 12 bp DNA\nDEFINITION  order "), "k", F.lit("\n            of items\nVERSION     V"), "k", F.lit(".1\n  ORGANISM  Some thing\n            Bacteria; Alpha; Beta.\nREFERENCE   1\nFEATURES             Location/Qualifiers\n"), "body", F.lit("\nORIGIN\n        1 acgtac gtacgt\n")).alias("value"))


def a03_features(s, d):
    return H.with_strand(parse_genbank(_flat_files(s, d))[1]).select("record_id", "feature_no", "type", "location", "strand", H.first_of("gene").alias("gene"), H.first_of("product").alias("product"))


def _malformed(s, d):
    """Delimited files in the shared folder; of some lines a number is none, some lack a value."""
    path = shared_folder(s, "csv")
    line = F.expr("concat_ws(',', l_orderkey, l_linenumber, case when l_partkey % 97 = 0 then 'many' else cast(cast(l_quantity as int) as string) end, case when l_partkey % 89 <> 0 then concat('\"a, ', l_returnflag, '\"') end)")
    table(s, d, "lineitem").select(line.alias("value")).write.text(path)
    return A.read_delimited(s, path, "orderkey long, line int, quantity int, mode string", header=False)


def a11(s, d):
    store = ResultStore(s, shared_folder(s, "results"), "month")
    store.write(v_tasks(s, d).select("task_id", F.when(F.col("key") % 2 == 0, "md").otherwise("json").alias("format"), "status", "completed_at", "result_path"))
    store.expire_files(AS_OF, 7)
    store.expire_records(AS_OF, 30)
    return store.read().select("task_id", "format", "status", "result_path")


def b08(s, d):
    path = shared_folder(s, "flat")
    _flat_files(s, d).select(F.concat("value", F.lit("\n//")).alias("value")).write.text(path)
    rows = default_registry().readers["genbank"][1](s, [path], {"split": 200_000})
    return parse_genbank(rows)[1].select("record_id", "feature_no", "type", "location", H.first_of("gene").alias("gene"), H.first_of("product").alias("product"))


def a05(s, d):
    raw = table(s, d, "documents").select("doc_id", F.to_json(F.struct(F.split("text", "\n").alias("pages"), F.size(F.split("text", "\n")).alias("total_pages"))).alias("value"))
    return A.parse_ocr_pages(raw).select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.md5("page").alias("page_md5"), "total_pages")


QUERIES = {
    "a01_classify_files": lambda s, d: A.classify_files(_files(s, d)).groupBy("kind", "is_result").agg(F.count("*").alias("n")),
    "a02_fasta_records": a02,
    "a02_read_fasta": a02_files,
    "a02_read_fasta_chunks": a02_chunks,
    "a03_genbank_features": a03_features,
    "a03_genbank_records": lambda s, d: parse_genbank(_flat_files(s, d))[0].select("record_id", "name", "description", "sequence", "length", "organism", F.array_join("taxonomy", ">").alias("taxonomy"), "references"),
    "a04_transcripts": lambda s, d: A.parse_transcripts(table(s, d, "conversations").select(F.col("conv_id").alias("file_id"), "turn", F.when(F.col("turn") % 3 == 0, "[]").otherwise(F.to_json(F.array(F.struct("text")))).alias("value"))).groupBy("file_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")),
    "a05_ocr_pages": a05,
    "a06_html_blocks": lambda s, d: html_blocks(table(s, d, "pages")).groupBy("page_id").agg(F.count_if((F.col("kind") == "heading") & (F.col("level") == 1)).alias("h1"), F.count_if(F.col("kind") == "item").alias("items")),
    "a06_html_to_markdown": lambda s, d: html_to_markdown(table(s, d, "pages")),
    "a07_read_delimited": lambda s, d: split_errors(_malformed(s, d))[0],
    "a07_malformed_rows": lambda s, d: split_errors(_malformed(s, d))[1].select("status", F.md5("error_message").alias("message_md5")),
    "a11_results_after_retention": a11,
    "b08_genbank_source": b08,
    "a08_decode_base64": lambda s, d: A.decode_base64(table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "***").otherwise(F.base64("text")).alias("b64")), "b64").select("doc_id", F.md5("payload").alias("payload_md5"), "error"),
    "a09_size_limit": lambda s, d: A.size_limit(_files(s, d), 3000)[1].select("doc_id", "length", "size_mb"),
    "a10_filename_from_source": lambda s, d: A.filename_from_source(table(s, d, "pages").select("page_id", "url", F.expr("case when page_id % 3 = 0 then concat('attachment; filename=\"p', page_id, '.html\"') end").alias("disposition"))).select("page_id", "file_name"),
}

ORACLES = {
    "a01_classify_files": "with f as (select case doc_id % 3 when 0 then 'md' when 1 then 'json' else 'other' end kind, doc_id % 4 <> 0 and doc_id % 3 < 2 is_result from documents) select kind, is_result, count(*) n from f group by 1, 2",
    "a02_fasta_records": duck("select file, 's' || seq_id seq_id, 's' || seq_id || ' from ' || file description, md5(sequence) sequence_md5, length(sequence) length from v_seq", "v_seq"),
    "a02_read_fasta": duck("select seq_id // 1000 thousand, row_number() over (partition by seq_id // 1000 order by seq_id) ord, 's' || seq_id seq_id, 's' || seq_id || ' of ' || file description, md5(sequence) sequence_md5, length(sequence) length from v_seq", "v_seq"),
    "a02_read_fasta_chunks": duck("with c as (select seq_id, sequence, unnest(range(0, greatest(1, (length(sequence) + 999) // 1000))) chunk from v_seq) select 's' || seq_id as name, chunk, chunk * 1000 \"start\", md5(substr(sequence, cast(chunk * 1000 + 1 as bigint), 1000)) text_md5, md5(substr(sequence, cast(chunk * 1000 + 1001 as bigint), 256)) ahead_md5 from c", "v_seq"),
    "a03_genbank_features": "select 'V' || l_orderkey || '.1' record_id, row_number() over (partition by l_orderkey order by l_linenumber, case when l_suppkey % 2 = 0 then 'complement(' || l_partkey || '..' || (l_partkey + 90) || ')' else l_partkey || '..' || (l_partkey + 90) end, 'g' || l_suppkey) feature_no, case l_linenumber % 3 when 0 then 'CDS' when 1 then 'gene' else 'tRNA' end type, case when l_suppkey % 2 = 0 then 'complement(' || l_partkey || '..' || (l_partkey + 90) || ')' else l_partkey || '..' || (l_partkey + 90) end location, case when l_suppkey % 2 = 0 then -1 else 1 end strand, 'g' || l_suppkey gene, 'a long name ' || l_partkey product from lineitem",
    "a03_genbank_records": "select distinct 'V' || l_orderkey || '.1' record_id, 'L' || l_orderkey name, 'order ' || l_orderkey || ' of items' description, 'ACGTACGTACGT' sequence, 12::bigint length, 'Some thing' organism, 'Bacteria>Alpha>Beta' taxonomy, 1::bigint \"references\" from lineitem",
    "a04_transcripts": "select conv_id file_id, cast(sum(case when turn % 3 = 0 then 0 else length(text) end) as bigint) chars, count(*) n from conversations group by 1",
    "a05_ocr_pages": "with p as (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) page_no, unnest(string_split(text, chr(10))) page from documents) select doc_id, page_no, md5(page) page_md5, count(*) over (partition by doc_id) total_pages from p",
    "a07_read_delimited": "select l_orderkey orderkey, l_linenumber line, cast(l_quantity as int) quantity, 'a, ' || l_returnflag as mode from lineitem where l_partkey % 97 > 0 and l_partkey % 89 > 0",
    "a07_malformed_rows": "select 'failed' status, md5('MalformedRow: ' || concat_ws(',', l_orderkey, l_linenumber, case when l_partkey % 97 = 0 then 'many' else cast(cast(l_quantity as int) as varchar) end, case when l_partkey % 89 <> 0 then '\"a, ' || l_returnflag || '\"' end)) message_md5 from lineitem where l_partkey % 97 = 0 or l_partkey % 89 = 0",
    "a11_results_after_retention": duck("select task_id, case when key % 2 = 0 then 'md' else 'json' end format, status, case when completed_at < timestamp '1998-08-01 00:00:00' - interval 7 day and status in ('completed', 'failed') then null else result_path end result_path from v_tasks where not coalesce(completed_at < timestamp '1998-08-01 00:00:00' - interval 30 day and status in ('completed', 'failed'), false)", "v_tasks"),
    "a08_decode_base64": "select doc_id, case when doc_id % 4 <> 0 then md5(text) end payload_md5, case when doc_id % 4 = 0 then 'invalid base64' end error from documents",
    "a09_size_limit": "select doc_id, strlen(text) length, round(strlen(text) / 1048576, 2) size_mb from documents where strlen(text) > 3000",
    "a10_filename_from_source": "with p as (select *, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/')[-1] last from pages) select page_id, case when page_id % 3 = 0 then 'p' || page_id || '.html' when last <> '' then last else 'downloaded_file' end file_name from p",
}
ORACLES["b08_genbank_source"] = f"select * exclude (strand) from ({ORACLES['a03_genbank_features']})"
ORACLES["a06_html_blocks"] = """with p as (select page_id, regexp_replace(regexp_replace(html, '<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)>', '', 'gs'), '<!--.*?-->', '', 'gs') h from pages)
select page_id, len(regexp_extract_all(h, '<h1[ >]')) h1, len(regexp_extract_all(h, '<li[ >]')) items from p"""
