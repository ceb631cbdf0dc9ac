"""Sources, sinks, filters and projections."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from corpusloom.functions import measures as M
from corpusloom.functions import text as T
from corpusloom.plans import fixtures as X
from corpusloom.plans.registry import query
from corpusloom.session import table
from corpusloom.sources import files as IO


@query("S1_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s1(spark, d):
    path = IO.scratch(spark, "csv")
    IO.write_csv(table(spark, d, "nation"), path)
    return IO.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("S1_csv_multiline", "SELECT conv_id, turn, text FROM conversations")
def s1m(spark, d):
    path = IO.scratch(spark, "csv")
    IO.write_csv(table(spark, d, "conversations").select("conv_id", "turn", "text"), path)
    return IO.read_csv(spark, path, "conv_id long, turn long, text string")


@query("S2_pruned_scan", "SELECT doc_id, source FROM documents WHERE lang = 'de'")
def s2(spark, d):
    return table(spark, d, "documents").where("lang = 'de'").select("doc_id", "source")


@query("S3_required_columns", "SELECT doc_id, text FROM documents WHERE text <> ''")
def s3(spark, d):
    return IO.require_columns(table(spark, d, "documents"), ["doc_id", "text"]).where("text <> ''").select("doc_id", "text")


@query("S4_tsv_lexicon", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_size < 10")
def s4(spark, d):
    path = IO.scratch(spark, "tsv")
    IO.write_csv(table(spark, d, "part").where("p_size < 10").select("p_partkey", "p_name", "p_brand"), path, sep="\t")
    return IO.read_csv(spark, path, "p_partkey long, p_name string, p_brand string", sep="\t")


@query("S5_json_document", "SELECT count(*) AS n, CAST(min(doc_id) AS BIGINT) AS least, CAST(max(doc_id) AS BIGINT) AS most FROM documents")
def s5(spark, d):
    row = table(spark, d, "documents").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    path = IO.scratch(spark, "json")
    IO.write_json_document(spark, row.asDict(), path)
    got = IO.read_json_document(spark, path)
    return spark.createDataFrame([(got["n"], got["least"], got["most"])], "n long, least long, most long")


@query("S6_jsonl_log", "SELECT event_id, event_type, value FROM events")
def s6(spark, d):
    path = IO.scratch(spark, "jsonl")
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    for part in range(3):  # three appends
        IO.write_jsonl(events.where(f"event_id % 3 = {part}"), path)
    return IO.read_jsonl(spark, path, "event_id long, event_type string, value double")


@query("S7_csv_sink", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_returnflag = 'R'")
def s7(spark, d):
    path = IO.scratch(spark, "sink")
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    IO.write_csv(rows, path)
    return IO.read_csv(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


@query("S8_append_resume", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s8(spark, d):
    path = IO.scratch(spark, "grid")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    IO.append_new(spark, rows.where("s_suppkey % 2 = 0"), path, ["s_suppkey"])
    IO.append_new(spark, rows, path, ["s_suppkey"])
    return IO.keep_last(spark.read.schema(rows.schema).parquet(path), ["s_suppkey"], ["s_name"])


@query("S9_path_expansion", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1")
def s9(spark, d):
    path = IO.scratch(spark, "oof")
    for part in ("a", "b"):
        IO.write_csv(table(spark, d, "nation").where(F.col("n_nationkey") % 2 == int(part == "b")), f"{path}/{part}")
    found = [r["path"] for r in IO.expand_paths(spark, [path, f"{path}/a"]).collect()]
    return IO.read_csv(spark, found, "n_nationkey int, n_name string, n_regionkey int").groupBy(F.col("n_regionkey").alias("r")).agg(F.count("*").alias("n"))


@query("S10_latest_artifact", "SELECT 'checkpoint-1000' AS checkpoint, 'second' AS newest, CAST(count(*) AS INT) AS n FROM nation")
def s10(spark, d):
    """Two artefacts, of which the newer must win, and checkpoints, of which the highest number must."""
    path = IO.scratch(spark, "latest")
    IO.write_csv(table(spark, d, "region"), f"{path}/second-by-name")
    for number, name in ((900, "first"), (1000, "second")):
        time.sleep(0.05)
        IO.write_csv(table(spark, d, "nation").select("n_name", F.lit(name).alias("written")), f"{path}/run/checkpoint-{number}")
    newest = IO.latest(IO.list_files(spark, path, "*.csv")).first()["path"]
    best = IO.latest_checkpoint(IO.list_files(spark, f"{path}/run", "*.csv")).first()["checkpoint"]
    rows = IO.read_csv(spark, newest, "n_name string, written string")
    return rows.agg(F.lit(best).alias("checkpoint"), F.max("written").alias("newest"), F.count("*").cast("int").alias("n"))


@query("S11_artifact_scan")
def s11(spark, d):
    path = IO.scratch(spark, "artifacts")
    IO.write_csv(table(spark, d, "nation").repartition(3), path)
    files = IO.list_files(spark, path).where(~F.col("path").rlike("/(_temporary|\\.git)/"))
    return files.select(F.element_at(F.split("path", r"\."), -1).alias("suffix"), "length").groupBy("suffix").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("S12_markdown_report")
def s12(spark, d):
    rows = table(spark, d, "region").orderBy("r_regionkey")
    return spark.createDataFrame([(line,) for line in IO.markdown_table(rows, ["r_regionkey", "r_name"]).split("\n")], "line string")


@query("S13_submission", "SELECT c.c_custkey AS id, o.prediction FROM customer c LEFT JOIN (SELECT o_custkey AS id, min(o_orderpriority) AS prediction FROM orders GROUP BY 1) o ON o.id = c.c_custkey")
def s13(spark, d):
    predictions = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("prediction"))
    return IO.submission(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), predictions, strict=False)


@query("S14_sha256_manifest", "SELECT sha256(string_agg(r_name, ',' ORDER BY r_regionkey)) AS sha256, CAST(length(string_agg(r_name, ',' ORDER BY r_regionkey)) AS BIGINT) AS bytes FROM region")
def s14(spark, d):
    path = IO.scratch(spark, "bundle")
    line = table(spark, d, "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"]), ",").alias("value"))
    line.coalesce(1).write.option("lineSep", "\0").text(path)
    files = IO.list_files(spark, path, "*.txt", content=True).select(F.expr("substring(content, 1, length(content) - 1)").alias("body"))
    return files.select(F.sha2("body", 256).alias("sha256"), F.octet_length("body").cast("long").alias("bytes"))


@query("S15_status_record", "SELECT 'load' AS stage, 'done' AS status, count(*) AS n FROM nation")
def s15(spark, d):
    path = IO.scratch(spark, "status")
    IO.write_json_document(spark, {"stage": "load", "status": "done", "rows": table(spark, d, "nation").count()}, path)
    got = IO.read_json_document(spark, path)
    return spark.createDataFrame([(got["stage"], got["status"], got["rows"])], "stage string, status string, n long")


@query("F1_fold_visibility", f"WITH {X.FOLDS} SELECT d.doc_id, CASE WHEN fold = 2 THEN 'val' ELSE 'train' END AS split FROM documents d JOIN folds USING (doc_id) WHERE fold < 4")
def f1(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(X.folds(spark, d), "doc_id").where("fold < 4")
    return joined.select("doc_id", F.when(F.col("fold") == 2, "val").otherwise("train").alias("split"))


@query("F2_drop_blank", f"WITH {X.CHUNKS} SELECT id FROM chunks WHERE trim(source) <> '' AND trim(prediction) <> ''")
def f2(spark, d):
    return X.chunks(spark, d).where((T.strip(T.blank(F.col("source"))) != "") & (T.strip(T.blank(F.col("prediction"))) != "")).select("id")


@query(
    "F3_original_chunks",
    f"""WITH {X.CHUNKS}, m AS (SELECT *, lower(trim(is_short_aligned)) IN ('1','true','t','yes','y') OR starts_with(lower(trim(chunk_mode)), 'short_aligned') AS short FROM chunks)
SELECT count(*) AS rows_in, count(*) FILTER (WHERE NOT short) AS rows_out, count(*) FILTER (WHERE short) AS dropped,
  CASE WHEN count(*) = 0 THEN 'empty_frame' WHEN count(*) FILTER (WHERE short) = 0 THEN 'no_short_alignment_markers' ELSE 'filtered' END AS reason FROM m""",
)
def f3(spark, d):
    from corpusloom.operators.reconstruct import original_chunks

    return original_chunks(X.chunks(spark, d))[1]


@query("F4_feasible", f"WITH {X.PAIRS} SELECT id FROM pairs WHERE strlen(source) + 1 <= 384 AND strlen(target) + 1 <= 384 ORDER BY md5('7' || CAST(id AS VARCHAR)), id LIMIT 50")
def f4(spark, d):
    from corpusloom.operators.sample import hash_sample

    fit = X.pairs(spark, d).where((M.byte_tokens(F.col("source")) <= 384) & (M.byte_tokens(F.col("target")) <= 384))
    return hash_sample(fit, "id", 50, "7").select("id")


@query("F5_hard_cases", f"WITH {X.CHUNKS} SELECT id FROM chunks WHERE chunk_total >= 6 OR strlen(reference) + 1 >= 1500 OR regexp_matches(source, '<gap>|\\{{|\\[')")
def f5(spark, d):
    c = X.chunks(spark, d)
    return c.where((F.col("chunk_total") >= 6) | (M.byte_tokens(F.col("reference")) >= 1500) | F.col("source").rlike(r"<gap>|\{|\[")).select("id")


@query(
    "F6_routing",
    f"""WITH {X.CHUNKS}, m AS (SELECT id, chunk_total, len(list_filter(string_split_regex(reference, '[ \\n]+'), lambda w: w <> '')) AS tok, id % 4 AS markers FROM chunks),
r AS (SELECT id, concat_ws('|', CASE WHEN chunk_total >= 4 THEN 'chunks' END, CASE WHEN tok >= 129 THEN 'long_target' END, CASE WHEN markers >= 2 AND tok >= 96 THEN 'markers' END) AS reason FROM m)
SELECT id, CASE WHEN reason = '' THEN 'pass_a_only' ELSE reason END AS reason FROM r""",
)
def f6(spark, d):
    return X.chunks(spark, d).select("id", M.route_reason(F.col("chunk_total"), T.word_count(F.col("reference")), F.col("id") % 4).alias("reason"))


@query("F7_subset_selector", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY coalesce(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END, 999999), o_orderkey LIMIT 100")
def f7(spark, d):
    rank = F.coalesce(F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")), F.lit(999999))
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(rank, "o_orderkey").limit(100).select("o_orderkey")


@query("F9_sentence_filter", f"WITH {X.PAIRS}, n AS (SELECT *, len(list_filter(string_split_regex(source, '[ \\n]+'), lambda w: w <> '')) AS s, len(list_filter(string_split_regex(target, '[ \\n]+'), lambda w: w <> '')) AS t FROM pairs) SELECT id FROM n WHERE turn % 4 <> 0 OR (s >= 6 AND t >= 6)")
def f9(spark, d):
    p = X.pairs(spark, d)
    return p.where((F.col("turn") % 4 != 0) | ((T.word_count(F.col("source")) >= 6) & (T.word_count(F.col("target")) >= 6))).select("id")


@query(
    "F10_blocklist_flags",
    "SELECT d.doc_id, d.doc_id IN (SELECT item_id FROM benchmark) AS id_blocked, d.text IN (SELECT text FROM documents WHERE lang = 'fr') AS text_blocked FROM documents d",
)
def f10(spark, d):
    from corpusloom.operators.overlap import membership_flag

    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    flagged = membership_flag(docs, ids, "doc_id", "id_blocked")
    return membership_flag(flagged, docs.where("lang = 'fr'").select("text"), "text", "text_blocked").select("doc_id", "id_blocked", "text_blocked")


@query("F11_smoke_keep", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_custkey <= 40) OR (o_orderstatus = 'O' AND o_custkey <= 20)")
def f11(spark, d):
    limit = F.when(F.col("o_orderstatus") == "F", 40).when(F.col("o_orderstatus") == "O", 20)
    return table(spark, d, "orders").where(F.col("o_custkey") <= limit).select("o_orderkey")


@query("F12_eligible", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey >= 5 AND s_suppkey % 2 = 0 AND s_suppkey % 3 > 0")
def f12(spark, d):
    from corpusloom.operators.gates import eligible

    s = table(spark, d, "supplier").select(
        "s_suppkey",
        F.col("s_acctbal").alias("delta_anchor"),
        (F.col("s_nationkey") - 5).alias("delta_hard"),
        (F.col("s_suppkey") % 2 == 0).alias("health_a"),
        (F.col("s_suppkey") % 3 > 0).alias("health_b"),
    )
    return eligible(s).select("s_suppkey")


@query("F13_synonym_columns", "SELECT doc_id AS id, text AS source FROM documents")
def f13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("Transliteration"))
    return docs.select(F.col(IO.detect_column(docs, "id")).alias("id"), F.col(IO.detect_column(docs, "source")).alias("source"))


@query(
    "P1_task_prefix",
    "SELECT doc_id, CASE WHEN starts_with(text, 'The ') THEN text ELSE 'The ' || text END AS with_prefix, CASE WHEN starts_with(text, 'The ') THEN substr(text, 5) ELSE text END AS without_prefix FROM documents",
)
def p1(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.apply_prefix(F.col("text"), "The ").alias("with_prefix"), T.strip_prefix(F.col("text"), "The ").alias("without_prefix")
    )


@query(
    "P2_id_synthesis",
    f"WITH {X.CHUNKS} SELECT id, parent || '__c' || (chunk_index + 1) || 'of' || chunk_total AS chunk_id, 'ext_' || lpad(CAST(id AS VARCHAR), 8, '0') AS long_id, parent || '__replay' || lpad(CAST(chunk_index AS VARCHAR), 5, '0') AS replay_id FROM chunks",
)
def p2(spark, d):
    from corpusloom.operators.reconstruct import chunk_id, padded_id

    return X.chunks(spark, d).select(
        "id",
        chunk_id("parent", "chunk_index", "chunk_total").alias("chunk_id"),
        padded_id("ext_", F.col("id"), 8).alias("long_id"),
        F.concat(F.col("parent").cast("string"), padded_id("__replay", F.col("chunk_index"), 5)).alias("replay_id"),
    )


@query(
    "P3_stable_split",
    "SELECT doc_id, CASE WHEN r < 4 THEN 'tune' WHEN r < 7 THEN 'holdout' ELSE 'report' END AS split FROM (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS r FROM documents)",
)
def p3(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stable_split(F.col("doc_id")).alias("split"))


@query("P4_stable_fold", "SELECT doc_id, 1 + CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS fold FROM documents")
def p4(spark, d):
    return table(spark, d, "documents").select("doc_id", (T.stable_hash(F.col("doc_id")) % 4 + 1).alias("fold"))


@query(
    "P5_gate_rewrite",
    f"WITH {X.PAIRS}, s AS (SELECT id, source, target, (id % 100) / 100.0 AS score FROM pairs) SELECT id, CASE WHEN score >= 0.5 THEN source || ' | ' || target ELSE 'translate: ' || source END AS source, CASE WHEN score >= 0.5 THEN target ELSE '' END AS hint, CASE WHEN score >= 0.5 THEN 'hint' ELSE 'gate_off' END AS mode FROM s",
)
def p5(spark, d):
    from corpusloom.operators.knn import gate_hints

    p = X.pairs(spark, d).select(
        "id", F.col("source").alias("source_raw"), F.concat_ws(" | ", "source", "target").alias("source"), F.col("target").alias("hint"), F.lit("hint").alias("mode"), ((F.col("id") % 100) / 100).alias("top1_score")
    )
    return gate_hints(p, 0.5, "translate: ").select("id", "source", "hint", "mode")


@query("P6_column_by_name", f"WITH {X.PAIRS} SELECT id, CASE id % 3 WHEN 0 THEN source WHEN 1 THEN target ELSE NULL END AS chosen FROM pairs")
def p6(spark, d):
    from corpusloom.operators.select import column_by_name

    named = F.when(F.col("id") % 3 == 0, "source").when(F.col("id") % 3 == 1, "target").otherwise("none")
    return X.pairs(spark, d).select("id", column_by_name(named, ["source", "target"]).alias("chosen"))


@query("P7_first_candidate", "SELECT doc_id, coalesce(CASE WHEN lang = 'de' THEN 'de' END, CASE WHEN doc_id % 2 = 0 THEN source END, lang) AS chosen FROM documents")
def p7(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.coalesce(F.when(F.col("lang") == "de", F.lit("de")), F.when(F.col("doc_id") % 2 == 0, F.col("source")), "lang").alias("chosen")
    )


@query(
    "P8_prompt_rendering",
    f"WITH {X.CHUNKS} SELECT parent, '<source>' || chr(10) || string_agg('<chunk_' || chunk_index || '>' || source || '</chunk_' || chunk_index || '>', chr(10) ORDER BY chunk_index) || chr(10) || '</source>' AS prompt FROM chunks GROUP BY parent",
)
def p8(spark, d):
    from corpusloom.operators.reconstruct import chunk_prompt

    return chunk_prompt(X.chunks(spark, d), "parent", "chunk_index", "source")


@query("P8_flat_prompt")
def p8_flat(spark, d):
    """Equal children once, with the labels of up to six of them."""
    from corpusloom.operators.reconstruct import flat_prompt

    return flat_prompt(X.chunks(spark, d), "parent", "chunk_index", "prediction")
