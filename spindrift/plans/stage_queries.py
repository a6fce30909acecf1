"""Queries of whole stages: prompts and their answers, templates, the dataset, trees, streams of commits and states.

As in queries.py the given tables stand for code: parts are elements of commits (brand and size), their names code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import completion, dataset, edits, quality, snapshot
from ..sources import documents as sink
from ..sources import files
from ..streaming import stateful, store
from . import queries as q

_SYSTEMS = dataset.SystemTexts()
_LINE = "chr(10)"


def _text(*parts: str) -> str:
    """SQL of parts put together by line feeds."""
    return f" || {_LINE} || ".join(parts)


def _quoted(text: str) -> str:
    """A text as SQL, its line feeds spelled out."""
    return _text(*["'" + x.replace("'", "''") + "'" for x in text.split("\n")])


def part_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as edit sequences: the name's first letter is to become a Z."""
    p = q.table(spark, sf_dir, "part")
    edit = F.array(F.struct(F.left("p_name", F.lit(1)).alias("span_before"), F.lit("Z").alias("span_after")))
    meta = F.struct(F.lit("h").alias("commit_hash"), F.lit("a").alias("author"), F.lit("m").alias("commit_message"), F.lit("t").alias("timestamp"), F.col("p_brand").alias("repository"), F.lit("f").alias("file_path"), F.when(F.col("p_partkey") % 2 == 0, "MODIFIED").otherwise("ADDED").alias("operation_type"), F.lit("k").alias("kind"))
    return p.select(F.col("p_brand").alias("repo"), F.col("p_size").alias("commit_no"), F.col("p_partkey").cast("string").alias("ast_id"), F.col("p_name").alias("original_function"), F.col("p_type").alias("reasoning"), edit.alias("edit_sequence"), meta.alias("metadata"))


def part_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.struct(F.lit("ann").alias("author_name"), F.lit("mail").alias("author_email"), F.lit("date").alias("commit_date"), F.repeat(F.lit("long "), F.lit(60)).alias("commit_message"))
    paths = F.array(*[F.struct(F.lit(f"{x}.rs").alias("file_path"), F.lit("").alias("content")) for x in "abcd"])
    made = q.table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.col("p_size").alias("commit_no")).distinct()
    return made.select("repo", "commit_no", F.concat(F.lit("hash-of-"), "commit_no").alias("commit_hash"), meta.alias("metadata"), paths.alias("files_modified"))


_BATCH = f"""p AS (SELECT p_brand AS repo, p_size AS commit_no, p_partkey::VARCHAR AS id, {_text("'- ID: ' || p_partkey", "'- Operation: ' || CASE WHEN p_partkey % 2 = 0 THEN 'MODIFIED' ELSE 'ADDED' END", "'- Code: ' || p_name", "'- Edits: 1'")} AS item,
  count(*) OVER (PARTITION BY p_brand, p_size) AS n, (row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey::VARCHAR) - 1) // 3 AS batch_no FROM part),
b AS (SELECT repo, commit_no, batch_no::INT AS batch_no, {_quoted(completion.ELEMENTS_PROMPT)} || chr(10) || chr(10) || {_text("'Commit ' || left('hash-of-' || commit_no::VARCHAR, 8)", "'Author: ann'", "'Message: ' || left(repeat('long ', 60), 200)", "'Files: a.rs, b.rs, c.rs'")}
  || chr(10) || chr(10) || string_agg(item, chr(10) || chr(10) ORDER BY id) AS prompt FROM p WHERE n <= 12 GROUP BY repo, commit_no, batch_no)"""


@q.query(f"WITH {_BATCH} SELECT repo, commit_no, batch_no, 1::INT AS place, sha256(prompt) AS task, ['f'] AS selected_functions FROM b WHERE batch_no % 3 <> 2")
def llm_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of three elements of commits of at most twelve; the answer names the prompt's hash beside a task that isn't valid, every third is no JSON."""
    prompts = completion.element_prompts(part_sequences(spark, sf_dir), part_commits(spark, sf_dir), batch_size=3, most_elements=12)
    good = F.concat(F.lit('Sure: {"tasks": [{"task": ""}, {"task": "'), "prompt_hash", F.lit('", "reasoning_selection": "r", "selected_functions": ["f"], "reasoning_update": {"f": "u"}}]}'))
    answers = prompts.select("prompt_hash", F.when(F.col("batch_no") % 3 == 2, "none").otherwise(good).alias("completion"))
    return completion.parse_enhanced(completion.from_table(prompts, answers)).select("repo", "commit_no", "batch_no", "place", "task", "selected_functions")


_CHANGES = """o AS (SELECT source, doc_id, text, lag(text) OVER w AS old, lag(doc_id) OVER w AS p FROM documents WHERE source IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY doc_id))"""


@q.query(f"""WITH {_CHANGES} SELECT source AS repo, doc_id::INT AS commit_no, 'UPDATE' AS operation_type, 'h' || doc_id AS commit_hash,
CASE WHEN doc_id % 3 = 0 THEN '' ELSE sha256({_quoted(completion.REASONING_PROMPTS['UPDATE'])} || chr(10) || {_text("'look'", "'mend ' || doc_id", "'Item: text.rs::function::f'", "'Before:'", "coalesce(old, '')", "'After:'", "coalesce(text, '')")}) END AS reasoning
FROM o WHERE p IS NOT NULL AND text IS DISTINCT FROM old""")
def llm_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said about each changed document: the hash of the prompt; every third answer is no JSON."""
    diffs = q.document_diffs(spark, sf_dir)
    tasks = diffs.select("repo", "commit_no", F.concat(F.lit("h"), "commit_no").alias("commit_hash"), F.array(F.lit("look"), F.concat(F.lit("mend "), "commit_no")).alias("tasks")).distinct()
    prompts = completion.reasoning_prompts(diffs, tasks)
    answers = prompts.select("prompt_hash", F.when(F.col("commit_no") % 3 == 0, "none").otherwise(F.concat(F.lit('{"reasoning": "'), "prompt_hash", F.lit('"}'))).alias("completion"))
    return completion.parse_reasoning(completion.from_table(prompts, answers)).select("repo", "commit_no", "operation_type", "commit_hash", "reasoning")


_BLOCK = _text("'<update>'", "'<ast_id>' || p_partkey || '</ast_id>'", "'<original_function>'", "p_name", "'</original_function>'", "'<reasoning>'", "p_type", "'</reasoning>'", "'<edit_sequence>'", "'['", "'  {'", "'    \"span_before\": \"' || left(p_name, 1) || '\",'", "'    \"span_after\": \"Z\"'", "'  }'", "']'", "'</edit_sequence>'", "'</update>'", "''")
_TURNS = _text("'<|im_start|>system'", _quoted(edits.TEMPLATE_SYSTEM), "'<|im_end|>'", "'<|im_start|>user'", "'**Commit Tasks:**'")


@q.query(f"""WITH b AS (SELECT p_brand AS repo, p_size AS commit_no, string_agg({_BLOCK}, chr(10) ORDER BY p_partkey::VARCHAR) AS blocks FROM part GROUP BY ALL)
SELECT repo, commit_no, sha256({_TURNS} || CASE WHEN commit_no % 2 = 0 THEN chr(10) || '1. grow' || chr(10) || '2. shrink ' || commit_no ELSE '' END || chr(10) || {_text("'<|im_end|>'", "'<|im_start|>assistant'", "''", "blocks", "'<|im_end|>'")}) AS digest FROM b""")
def edit_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat of each commit; those of even number have tasks."""
    sequences = part_sequences(spark, sf_dir)
    tasks = sequences.select("repo", "commit_no").distinct().where("commit_no % 2 = 0").withColumn("tasks", F.array(F.lit("grow"), F.concat(F.lit("shrink "), "commit_no")))
    return edits.render_templates(sequences, tasks, edits.TEMPLATE_SYSTEM).select("repo", "commit_no", F.sha2("template", 256).alias("digest"))


@q.query("SELECT p_brand AS repository, 'commit_' || p_size AS commit, list(p_partkey::VARCHAR ORDER BY p_partkey::VARCHAR) AS ids, count(*) AS entry_count, count(*)::BIGINT AS total_edit_spans FROM part GROUP BY ALL")
def edit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of edit sequences as they are read again from their JSON."""
    made = sink.edit_documents(part_sequences(spark, sf_dir))
    kind = "repository string, commit string, edit_sequences array<struct<ast_id:string>>, entry_count bigint, total_edit_spans bigint"
    d = made.select(F.from_json("content", kind).alias("d")).select("d.*")
    return d.select("repository", "commit", F.transform("edit_sequences", lambda s: s["ast_id"]).alias("ids"), "entry_count", "total_edit_spans")


@q.query("SELECT coalesce(source, '-') AS repo, count(*) AS entry_count, count(*)::BIGINT AS total_edit_spans FROM documents WHERE text <> '' GROUP BY ALL")
def edit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that came or went (odd ids), each one edit; empty ones give none."""
    d = q.table(spark, sf_dir, "documents")
    gone = F.col("doc_id") % 2 == 1
    none = F.lit(None).cast("struct<author_name:string,author_email:string,commit_date:string,commit_message:string,commit_hash:string>")
    diffs = d.select(F.coalesce("source", F.lit("-")).alias("repo"), F.lit(1).alias("commit_no"), F.col("doc_id").cast("string").alias("id"), F.when(gone, "removed").otherwise("added").alias("status"), F.when(gone, F.col("text")).alias("before_code"), F.when(~gone, F.col("text")).alias("after_code"), F.lit("f").alias("file"), F.lit("k").alias("kind"), none.alias("commit_metadata"))
    return edits.edit_totals(edits.edit_sequences(diffs)).drop("commit_no")


@q.query("""WITH a AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 10 <> 3), b AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name || '!' ELSE p_name END AS p_name FROM part WHERE p_partkey % 10 <> 7)
SELECT coalesce(a.p_partkey, b.p_partkey)::VARCHAR AS id, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'modified' END AS status, a.p_name AS before_code, b.p_name AS after_code,
CASE WHEN a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL THEN a.p_name END AS span_before, CASE WHEN a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL THEN b.p_name END AS span_after
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_name IS DISTINCT FROM b.p_name""")
def tree_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trees of parts: some are missing in either, every fourth name differs; names are one line, so they are their own window."""
    p = q.table(spark, sf_dir, "part")
    tree = lambda rows, code: rows.select(F.col("p_partkey").cast("string").alias("id"), F.lit("f").alias("file"), F.lit("k").alias("kind"), code.alias("code"), F.array().cast("array<string>").alias("imports"))
    old, new = tree(p.where("p_partkey % 10 <> 3"), F.col("p_name")), tree(p.where("p_partkey % 10 <> 7"), F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    d = snapshot.compare_trees(old, new)
    window = lambda side: F.when(F.col("status") == "modified", F.col(f"diff_span.{side}")).alias(f"span_{side}")
    return d.select("id", "status", "before_code", "after_code", window("before"), window("after"))


@q.query(f"WITH {q._ITEMS} SELECT repo, commit_no, id, status FROM diff")
def diffs_as_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of events stream in three parts, out of order, and are compared item by item with the one before."""
    store.use_rocksdb(spark)
    at = storage.new_path(spark, "commits")
    commits = stateful.as_commits(q.event_items(spark, sf_dir).select("repo", "commit_no", "id", "code"))
    commits.withColumn("part", F.pmod(F.xxhash64("repo", "commit_no"), F.lit(3))).repartition(3, "part").drop("part").write.parquet(f"{at}/in")
    rows = spark.readStream.schema(commits.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    found = stateful.commit_diffs(rows, buckets=2)
    found.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema("repo string, commit_no int, id string, status string").parquet(f"{at}/out")


@q.query("""WITH RECURSIVE e AS (SELECT label::VARCHAR AS key, vec_id AS seq, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
r(key, seq, n, m) AS (SELECT DISTINCT key, -1::BIGINT, 0::BIGINT, [[CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR j IN range(1, 5)] FOR i IN range(1, 5)] FROM e
UNION ALL SELECT e.key, e.seq, e.n, [[v / sqrt(list_sum([w * w FOR w IN s])) FOR v IN s] FOR s IN
  [[0.9::DOUBLE * r.m[i][j] + 0.1::DOUBLE * (x[i] * x[16 + j] + x[4 + i] * x[20 + j] + x[8 + i] * x[24 + j] + x[12 + i] * x[28 + j]) / 4 FOR j IN range(1, 5)] FOR i IN range(1, 5)]] FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT key, seq, [[round(v, 4) + 0.0 FOR v IN s] FOR s IN m] AS state FROM r WHERE n > 0""")
def states_as_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four by four state per label that every vector of the label updates in turn."""
    at = storage.new_path(spark, "states")
    v = spark.readStream.schema(q.table(spark, sf_dir, "embeddings").schema).parquet(f"{sf_dir}/embeddings.parque[t]")  # a pattern, as the table may be one file
    rows = lambda first: F.array(*[F.transform(F.slice("embedding", first + 4 * i, 4), lambda x: x.cast("double")) for i in range(4)])
    found = stateful.decayed_state(v.select(F.col("label").cast("string").alias("key"), F.col("vec_id").alias("seq"), rows(1).alias("projected"), rows(17).alias("inputs")), 4)
    found.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    out = spark.read.schema("key string, seq bigint, state array<array<double>>").parquet(f"{at}/out")
    return out.withColumn("state", F.transform("state", lambda r: F.transform(r, lambda x: F.round(x, 4) + F.lit(0.0))))


@q.query("SELECT source AS repo, (doc_id // 100)::INT AS commit_no, doc_id::VARCHAR AS function_id, lang AS reasoning, 'k' || (doc_id % 3)::VARCHAR AS kind FROM documents WHERE source IS NOT NULL AND lang <> ''")
def reasoning_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word about each document, its language, written into the documents of commits and read back; unknown languages drop out."""
    d = q.table(spark, sf_dir, "documents").where("source is not null")
    rows = d.select(F.col("source").alias("repo"), F.floor(F.col("doc_id") / 100).cast("int").alias("commit_no"), F.col("doc_id").cast("string").alias("function_id"), F.lit("f").alias("file_name"), F.lit("UPDATE").alias("operation_type"), F.coalesce("lang", F.lit("")).alias("reasoning"), F.lit("h").alias("commit_hash"), F.concat(F.lit("k"), F.col("doc_id") % 3).alias("kind"))
    at = storage.new_path(spark, "reasoning")
    sink.write_files(sink.reasoning_documents(rows), at, files.FILES["reasoning"])
    return files.read_reasoning(spark, at).select("repo", "commit_no", "function_id", "reasoning", "kind")


@q.query(f"""WITH c AS (SELECT p_brand AS repo, p_size AS commit_no, p_partkey, p_name FROM part),
d AS (SELECT *, 'hash-of-' || commit_no AS commit_id FROM c)
SELECT 'task' AS task_type, commit_id, commit_no, sha256('<|im_start|>selector' || chr(10) || '<|reasoning|>analysis' || chr(10) || 'r<|reasoning_end|>' || chr(10) || '<|select|>' || p_partkey || '<|im_end|>' || chr(10) || '<|im_start|>worker' || chr(10)
  || '<|selected|>' || p_partkey || chr(10) || '<|context|>' || p_name || '<|context_end|>' || chr(10) || '<|reasoning|>plan' || chr(10) || 'u<|reasoning_end|>' || chr(10) || '<|action|>edit' || chr(10) || p_name || chr(10) || '<|selection_end|>' || chr(10) || '<|im_end|>') AS digest FROM d
UNION ALL SELECT 'fim', commit_id, commit_no, sha256(substr(p_name, 3, 4) || chr(10) || '<|imports|>' || chr(10) || 'use a;' || chr(10) || '<|im_end|>') FROM d WHERE p_partkey % 3 = 0""")
def dataset_of_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset of parts as commits: a task each, a fill-in task for every third, and for others a kind that nobody knows."""
    p = q.table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.col("p_size").alias("commit_no"), F.col("p_partkey").cast("string").alias("id"), "p_name", "p_partkey")
    enhanced = p.select("repo", "commit_no", F.col("p_partkey").alias("task_no"), F.lit("do").alias("task"), F.lit("r").alias("reasoning_selection"), F.array("id").alias("selected_functions"), F.create_map("id", F.lit("u")).alias("reasoning_update"))
    code = p.select("repo", "commit_no", F.when(F.col("p_partkey") % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, "fim")).otherwise("unknown").alias("task_type"), F.col("id").alias("ast_id"), F.lit("f").alias("file"), F.lit("k").alias("kind"), F.array(F.lit("use a;")).alias("imports"), F.substring("p_name", 1, 2).alias("prefix"), F.substring("p_name", 3, 4).alias("middle"), F.lit("").alias("suffix"), F.lit("").alias("input"), F.lit("").alias("output"))
    rows = dataset.build_dataset(part_commits(spark, sf_dir), enhanced, code, p.select("repo", "commit_no", "id", F.col("p_name").alias("diff_string")))
    return rows.select("task_type", "commit_id", "commit_no", F.sha2("output", 256).alias("digest"))


@q.query("""WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity > 49) AS bad FROM lineitem GROUP BY ALL), o AS (SELECT *, o_orderkey % 4 <> 1 AS ready, o_orderstatus = 'F' AS before FROM orders)
SELECT o_orderpriority AS repo, o_orderkey AS commit_no, CASE WHEN NOT ready OR before THEN 'skipped' WHEN bad > 0 THEN 'error' ELSE 'success' END AS status,
CASE WHEN NOT ready THEN 'nothing to read' WHEN before THEN 'done before' WHEN bad > 0 THEN bad || ' broken rows' END AS reason, CASE WHEN ready AND NOT before AND coalesce(bad, 0) = 0 THEN coalesce(n, 0) ELSE 0 END AS rows FROM o LEFT JOIN l ON l_orderkey = o_orderkey""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, their lines as rows: some orders have nothing to read, some are done, and a large quantity breaks a row."""
    o = q.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("commit_no"), "o_orderstatus")
    rows = q.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_no"), "l_quantity").join(o, "commit_no")
    return quality.run_status(o, o.where("commit_no % 4 <> 1"), o.where("o_orderstatus = 'F'"), rows, F.col("l_quantity") > 49)


_KIND = "doc_id % 6"


@q.query(f"""WITH d AS (SELECT doc_id, text, {_KIND} AS k FROM documents WHERE length(text) > 3)
SELECT coalesce(source, '-') AS repo, d.doc_id::VARCHAR AS ast_id, k = 0 AS passed, CASE k WHEN 1 THEN 'the result is not the new code' WHEN 2 THEN 'a span was not found' WHEN 3 THEN 'the original is not the old code' WHEN 4 THEN 'not among the changes' WHEN 5 THEN 'an added item has an original' END AS reason
FROM d JOIN documents USING (doc_id)""")
def verify_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of documents, found by searching their spans: a sixth lead to the new text, the others fail in five ways."""
    d = q.table(spark, sf_dir, "documents").where("length(text) > 3").withColumn("k", F.expr(_KIND))
    own = [F.coalesce("source", F.lit("-")).alias("repo"), F.lit(1).alias("commit_no"), F.col("doc_id").cast("string").alias("id")]
    head = F.left("text", F.lit(3))
    new = F.concat(F.when(F.col("k") == 1, F.lit("YYYY")).otherwise(F.lit("ZZZ")), F.expr("substring(text, 4)"))
    status = F.when(F.col("k") == 5, "added").otherwise("modified")
    diffs = d.where("k <> 4").select(*own, status.alias("status"), F.when(F.col("k") == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("before_code"), new.alias("after_code"))
    span = F.when(F.col("k") == 2, F.concat("text", F.lit("?"))).otherwise(head)
    sequences = d.select(*own[:2], own[2].alias("ast_id"), F.col("text").alias("original_function"), F.array(F.struct(span.alias("span_before"), F.lit("ZZZ").alias("span_after"))).alias("edit_sequence"))
    return edits.verify_edits(sequences, diffs, compat=True).select("repo", "ast_id", "passed", "reason")
