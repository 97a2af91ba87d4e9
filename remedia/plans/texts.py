"""Catalogue queries: messages, lines, sets, hashes and source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, scalars
from ..operators import alignment, localise, outcomes
from . import views as v
from .catalogue import query


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = v.table(spark, d, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    return docs.withColumnRenamed("text", "before").join(after, "doc_id")


_PAIRS = "pairs AS (SELECT a.doc_id, a.text AS before, b.text AS after FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


@query(_PAIRS, sql=r"""SELECT p.doc_id, coalesce(n_deleted, 0) AS n_deleted FROM pairs p LEFT JOIN (SELECT doc_id, sum(greatest(n, 0))::BIGINT AS n_deleted FROM (
  SELECT doc_id, line, sum(sign) AS n FROM (SELECT doc_id, regexp_replace(unnest(string_split_regex(before, '\r\n|\n|\r')), '^\s+|\s+$', '', 'g') AS line, 1 AS sign FROM pairs
    UNION ALL SELECT doc_id, regexp_replace(unnest(string_split_regex(after, '\r\n|\n|\r')), '^\s+|\s+$', '', 'g'), -1 FROM pairs) WHERE line <> '' GROUP BY 1, 2) GROUP BY 1) x ON p.doc_id = x.doc_id""")  # fmt: skip
def line_multiset_delta(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.deleted_lines(_pairs(spark, d), "doc_id", "before", "after")


def _word_sets(words: str) -> str:
    """Words of either text of each pair: doc_id, w, in_a, in_b."""
    return f"""{_PAIRS}, a AS (SELECT DISTINCT doc_id, unnest({words.format("before")}) AS w FROM pairs), b AS (SELECT DISTINCT doc_id, unnest({words.format("after")}) AS w FROM pairs),
words AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.w, b.w) AS w, a.w IS NOT NULL AS in_a, b.w IS NOT NULL AS in_b FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.w = b.w)"""


@query(_word_sets("list_filter(string_split(lower({}), ' '), lambda x: x <> '')"), sql="""SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_added, 0) AS n_added, coalesce(n_shared, 0) AS n_shared, least(3, coalesce(n_shared, 0)) AS overlap FROM pairs LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE NOT in_b) AS n_removed, count(*) FILTER (WHERE NOT in_a) AS n_added, count(*) FILTER (WHERE in_a AND in_b) AS n_shared FROM words GROUP BY 1) USING (doc_id)""")  # fmt: skip
def set_delta_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words of each whole text that its neighbour lacks, both ways, and what they share."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(F.col(c)), " "), ""))
    rows = _pairs(spark, d).select("doc_id", outcomes.set_sizes(words("before"), words("after")).alias("n"))
    return rows.select("doc_id", "n.n_removed", "n.n_added", "n.n_shared", F.least(F.lit(3), F.col("n.n_shared")).alias("overlap"))


@query(_word_sets("string_split({}, ' ')"), sql="""SELECT doc_id, coalesce(added, []) AS added, coalesce(removed, []) AS removed, len(coalesce(added, [])) + len(coalesce(removed, [])) AS n_differing FROM pairs LEFT JOIN (
  SELECT doc_id, list(w ORDER BY w) FILTER (WHERE NOT in_a) AS added, list(w ORDER BY w) FILTER (WHERE NOT in_b) AS removed FROM words GROUP BY 1) USING (doc_id)""")  # fmt: skip
def symdiff_sets(spark: SparkSession, d: str) -> DataFrame:
    """What the neighbour of each whole text adds and lacks, sorted, and the size of the symmetric difference."""
    words = lambda c: F.array_distinct(F.split(F.col(c), " "))
    rows = _pairs(spark, d).select("doc_id", words("before").alias("a"), words("after").alias("b"))
    delta = outcomes.set_delta(F.col("a"), F.col("b"))
    rows = rows.select("doc_id", delta["added"].alias("added"), delta["removed"].alias("removed"))
    return rows.withColumn("n_differing", (F.size("added") + F.size("removed")).cast("long"))


_MESSAGE = """m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '  ''('' was never closed (file.py, line ' || event_id || ')' WHEN 1 THEN 'unexpected indent (x.py, line 7)' WHEN 2 THEN 'Invalid decimal literal'
  WHEN 3 THEN '' WHEN 4 THEN 'invalid syntax' END AS msg FROM events)"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    first = F.concat(F.lit("  '(' was never closed (file.py, line "), k.cast("string"), F.lit(")"))
    text = F.when(k % 6 == 0, first).when(k % 6 == 1, "unexpected indent (x.py, line 7)").when(k % 6 == 2, "Invalid decimal literal").when(k % 6 == 3, "").when(k % 6 == 4, "invalid syntax")
    return v.table(spark, d, "events").select("event_id", text.alias("msg"))


@query(_MESSAGE, sql="""SELECT event_id, nullif(regexp_extract(msg, 'line\\s+(\\d+)', 1), '')::INT AS line, CASE WHEN msg <> '' THEN trim(regexp_replace(trim(lower(msg)), '\\(.*?\\)', '', 'g')) END AS cleaned,
  CASE event_id % 6 WHEN 0 THEN 'delimiter' WHEN 1 THEN 'indentation' WHEN 2 THEN 'numeric' ELSE 'generic' END AS category, CASE event_id % 6 WHEN 0 THEN 'UNCLOSED' WHEN 1 THEN 'BLOCK' WHEN 4 THEN 'GENERIC' ELSE 'OTHER' END AS bucket FROM m""".replace("\\\\", "\\"))  # fmt: skip
def error_parse(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("msg")
    return _messages(spark, d).select("event_id", scalars.line_number(m).alias("line"), scalars.clean_message(m).alias("cleaned"), labels.syntax_category(m).alias("category"), labels.deletion_bucket(m).alias("bucket"))


@query(sql="""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'SyntaxError' WHEN 2 THEN 'KeyError' END AS word, CASE event_id % 4 WHEN 0 THEN 'bad value' WHEN 1 THEN 'bad token' WHEN 2 THEN '' END AS message FROM events""")
def traceback_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    head = 'Traceback (most recent call last):\n  File "a.py", line 3, in f\n'
    text = F.when(k % 4 == 0, head + "ValueError: bad value\nKeyError: later").when(k % 4 == 1, "\nSorry: SyntaxError: bad token (a.py, line 9)").when(k % 4 == 2, head + "KeyError").otherwise("no error")
    found = scalars.traceback_error(text)
    return v.table(spark, d, "events").select("event_id", found["word"].alias("word"), found["message"].alias("message"))


@query(v.CASES, sql="SELECT file_hash, ['3.10', '3.11', '3.12', NULL, '3.13', '3.14'][(file_hash % 6 + 1)::INT] AS version FROM cases")
def version_norm(spark: SparkSession, d: str) -> DataFrame:
    return v.cases(spark, d).select("file_hash", scalars.version_text(F.col("bytecode_version")).alias("version"))


@query(sql=r"""SELECT doc_id, sha256(array_to_string(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10))) AS text_hash,
  sha1('{"doc": ' || doc_id || ', "lang": ' || coalesce('"' || lang || '"', 'null') || '}') AS case_id FROM documents""")  # fmt: skip
def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents").select("doc_id", scalars.replacement_hash(F.col("text")).alias("text_hash"), scalars.case_id({"lang": F.col("lang"), "doc": F.col("doc_id")}).alias("case_id"))


@query(sql="""SELECT doc_id, least(CASE WHEN length(text) > 40000 THEN 1000000000 ELSE floor(length(text) / 3.3) END, 1000000000)::BIGINT AS window_tokens, greatest(1, length(text) // 4)::BIGINT AS chunk_tokens, octet_length(encode(text)) > 5000 AS skipped FROM documents""")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import selection

    rows = selection.size_guard(v.table(spark, d, "documents").select("doc_id", "text"), "text", 5000)
    return rows.select("doc_id", scalars.window_tokens(F.col("text")).alias("window_tokens"), scalars.chunk_tokens(F.col("text")).alias("chunk_tokens"), "skipped")


@query("""items AS (SELECT doc_id, source AS file, list_distinct(string_split(lower(text), ' ')) AS items FROM documents)""", sql="""SELECT frag_id, cont_id FROM (
  SELECT f.doc_id AS frag_id, c.doc_id AS cont_id, row_number() OVER (PARTITION BY f.doc_id ORDER BY len(c.items) DESC, c.doc_id) AS n
  FROM items f JOIN items c ON f.doc_id % 20 = 0 AND c.file = f.file AND len(c.items) >= len(f.items) AND list_has_all(c.items, f.items)) WHERE n = 1""")  # fmt: skip
def literal_superset_match(spark: SparkSession, d: str) -> DataFrame:
    """For every twentieth text (the query set of searches) the largest of all texts of its source that holds all of its words."""
    rows = v.table(spark, d, "documents").select("doc_id", F.col("source").alias("file"), F.array_distinct(F.split(F.lower("text"), " ")).alias("items"))
    asked = rows.filter("doc_id % 20 = 0")
    return alignment.literal_supersets(asked.withColumnRenamed("doc_id", "frag_id"), rows.withColumnRenamed("doc_id", "cont_id"))


@query()
def budget_clamp(spark: SparkSession, d: str) -> DataFrame:
    """The window of lines around the middle of each text that fits 120 tokens (tested against a plain loop)."""
    rows = v.table(spark, d, "documents").select("doc_id", "text")
    return localise.clamp_windows(rows, 120)


@query()
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Texts packed into chunks of whole lines of at most 200 tokens (tested: chunks join to the text)."""
    rows = v.table(spark, d, "documents").select("doc_id", "text")
    return localise.pack_chunks(rows, 200)


@query()
def fragment_features(spark: SparkSession, d: str) -> DataFrame:
    """Syntax-tree features of small generated functions (tested on hand-counted fragments)."""
    from ..functions import fragments

    code = F.format_string("def f%d(a, b=%d):\n    x = a.name[%d] + b\n    if x > %d and a:\n        return g(x, k=%d)\n    return x", "p_partkey", "p_size", "p_size", "p_size", "p_size")
    rows = v.table(spark, d, "part").select("p_partkey", fragments.features(code).alias("f"))
    return rows.select("p_partkey", "f.parsed", "f.call_count", "f.return_count", "f.compare_count", "f.subscript_count", F.array_join("f.statement_types", ",").alias("statement_types"))


# Sources with one kind of damage each; the numbers make them differ.
BROKEN = (
    "x = (1 + 2\ny = 3\n", "12 = x\n", "try:\n    f()\nx = 1\n", "y = 1\n", "x = 'abc\n", "x = 1\n    y = 2\nz = 3\n", "x = 1 \\ 2\n", "a.b() = 1\nc() = 2\n", "x = f(1))\ny = 2\n", "x = [1, 2)\n",
    "values = ['one', 'two', 'thr\nprint(1)\n", "try:\n    f()\n  except E:\n    g()\n", "if a:\n    b()\n  else:\n    c()\n", "else:\n    x = 1\nfinally:\n    y = 2\n", "def f():\n    x = 1\n      y = 2\n  return x\n",
    "f()\nexcept E:\n    g()\n", "(((if a:\n    b()\n", "def <generic parameters of f>(.defaults):\n    pass\n", "x = 1\nfor k in y if k])\n    print([k + (1\n", "for k in y for k in [f(k)]:\nfor j in z for j in [g(j)]:\n",
    "g(k) for k in y:\nh(j) for j in z:\n", "try:\nexcept E:\nelse:\n    f()\n", "if a:\nx = 1\n", "x = f(1, g(2, 3]\ny = 4\n", "x = [(1, 2), (3, 4, {5: 6\n", "class A:\ndef f(self):\n    return 1\n", "while x:\n    break\n   else\n    y = 1\n",
    "x == 1 = 2\nreturn\n)(\nz = 3\n",
)


@query()
def syntactic_repair(spark: SparkSession, d: str) -> DataFrame:
    """The repair cascade on generated sources with 28 kinds of damage (tested operator by operator)."""
    from ..operators import rewrite

    k = F.col("p_partkey")
    broken = F.concat(F.element_at(F.array(*map(F.lit, BROKEN)), (k % len(BROKEN) + 1).cast("int")), F.format_string("part_%d = %d\n", k, F.col("p_size")))
    rows = v.table(spark, d, "part").select("p_partkey", broken.alias("source"))
    fixed = rewrite.repair(rows, "source")
    return fixed.select("p_partkey", "repaired", "stage", F.array_join("operations", ",").alias("operations"), F.array_join("control_flow_rewrites", ",").alias("control_flow_rewrites"), "lines_deleted")
