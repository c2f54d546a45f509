"""Text, vector, dedupe, quality, layout and export queries."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model
from ..functions import chunking as c
from ..functions import text as x
from ..functions import vectors as v
from ..operators import fulltext, graph, layout, mentions, names, quality, templates, vector_index
from ..operators import similarity as sim
from ..sources import export
from . import roles
from .registry import query
from .roles import GRAPH, t

_WORDS = "[w FOR w IN regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+') IF w <> '']"


def _docs(spark, d):
    return t(spark, d, "documents").select("doc_id", "text", "source")


@query("x01_token_count", f"SELECT doc_id, len({_WORDS})::INT AS tokens FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", x.n_tokens(F.col("text")).alias("tokens"))


@query("x12_size_flags", f"SELECT len({_WORDS}) BETWEEN 500 AND 1000 AS ok, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return _docs(spark, d).groupBy(x.size_ok(x.n_tokens(F.col("text"))).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("x04_x05_word_windows", f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 100), 700)) AS i FROM w WHERE len(w) > 0)
  SELECT doc_id, i / 700 AS idx, md5(array_to_string(w[i + 1 : i + 800], ' ')) AS text_md5 FROM s""".replace("i / 700", "(i // 700)::INT"))
def _(spark, d):
    w = _docs(spark, d).select("doc_id", F.posexplode(x.word_windows(F.col("text"))).alias("idx", "chunk"))
    return w.select("doc_id", "idx", F.md5("chunk").alias("text_md5"))


@query("x13_chunk_labels", r"""WITH f AS (SELECT doc_id, trim(split_part(text, '.', 1), ' ') AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 60 THEN substr(s, 1, 60) || '...' ELSE s END AS label FROM f""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", x.chunk_label(F.col("text")).alias("label"))


_NOISY = """SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::INT AS k, event_type FROM events"""


@query("x14_json_salvage", f"""SELECT event_id, CASE k % 5 WHEN 0 THEN event_type WHEN 1 THEN 'a [b' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE event_type || '"' END AS first, CASE WHEN k % 3 = 2 THEN NULL ELSE k END AS k FROM ({_NOISY}) n""")
def _(spark, d):
    """Arrays and objects amid prose, in fences or not, some cut off; what cannot be read has no value."""
    e = t(spark, d, "events").withColumn("n", F.get_json_object("props", "$.k").cast("int"))
    kind, quoted = F.lit(None), F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    arrays = [F.concat(F.lit("Labels: [["), quoted, F.lit(', "x"]] done.')), F.lit('Sure!\n```json\n[["a [b", "c]"]]\n```\nHope it helps'), F.concat(F.lit("[["), quoted, F.lit(', "un')), F.lit("nothing here"), F.concat(F.lit('x [["'), F.col("event_type"), F.lit('\\""], []]'))]
    objects = [F.concat(F.lit("Here: "), F.col("props"), F.lit(" ok")), F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n``` done")), F.concat(F.lit("{ broken "), F.col("event_type"))]
    for i, text in enumerate(arrays):
        kind = F.when(F.col("n") % 5 == i, text).otherwise(kind)
    thing = F.when(F.col("n") % 3 == 0, objects[0]).when(F.col("n") % 3 == 1, objects[1]).otherwise(objects[2])
    return e.select("event_id", F.get(F.get(x.salvage_array(kind), F.lit(0)), F.lit(0)).alias("first"), F.variant_get(x.salvage_object(thing), "$.k", "int").alias("k"))


@query("x16_stub_entities", f"""WITH w AS (SELECT doc_id, {_WORDS}[1:50] AS w FROM documents) SELECT doc_id, array_to_string([y FOR y IN w IF length(y) > 5 AND regexp_full_match(y, '\\pL+')][1:5], ',') AS names FROM w""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(x.stub_entities(F.col("text")), ",").alias("names"))


@query("x17_triggered_entities", """WITH f AS (SELECT doc_id, [y FOR y IN [CASE WHEN contains(lower(text), 'the') THEN 'Article' END, CASE WHEN contains(lower(text), 'und') THEN 'Conjunction' END, CASE WHEN contains(lower(text), 'que') THEN 'Pronoun' END] IF y IS NOT NULL] AS n FROM documents)
  SELECT array_to_string(n, ',') AS names, greatest(0, least(2, len(n) - 1))::INT AS relations, count(*) AS documents FROM f GROUP BY 1, 2""")
def _(spark, d):
    n = x.triggered_entities(F.col("text"), {"the": "Article", "und": "Conjunction", "que": "Pronoun"})
    rows = _docs(spark, d).withColumn("n", n)
    return rows.groupBy(F.array_join("n", ",").alias("names"), F.size(x.chain_relations(F.col("n"))).alias("relations")).agg(F.count(F.lit(1)).alias("documents"))


@query("x28_x29_hashes", r"""SELECT event_id, sha256(trim(regexp_replace(regexp_replace(lower('What is  ' || event_type || ', ' || props || '?'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))) AS query_hash, substr(sha256(props), 1, 16) AS content_hash, sha256(substr(props, 1, 500)) AS answer_hash FROM events""")
def _(spark, d):
    q = F.concat(F.lit("What is  "), "event_type", F.lit(", "), "props", F.lit("?"))
    return t(spark, d, "events").select("event_id", x.query_hash(q).alias("query_hash"), x.content_hash(F.col("props")).alias("content_hash"), x.answer_hash(F.col("props")).alias("answer_hash"))


@query("x30_extractive_summary", f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, md5('Summary: ' || array_to_string(w[1:100], ' ') || CASE WHEN len(w) > 100 THEN '...' ELSE '' END) AS summary_md5 FROM w")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(x.summary(F.col("text"), "brief")).alias("summary_md5"))


@query("x31_labelled_sections", f"""SELECT event_id, CASE WHEN k % 4 = 3 THEN NULL ELSE event_type || ' happened' || CASE WHEN k % 4 = 1 THEN chr(10) || 'and more' ELSE '' END END AS summary, CASE WHEN k % 4 = 2 THEN 0 ELSE k % 3 END AS points FROM ({_NOISY}) n""")
def _(spark, d):
    """Answers with labels in other orders and cases, texts of several lines, missing sections, and no, one or two bullets."""
    names = ("SUMMARY", "KEY_POINTS", "KEY_ENTITIES")
    e = t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.col("k") % 4
    bullets = F.concat(F.when(F.col("k") % 3 >= 1, "- one\n").otherwise(""), F.when(F.col("k") % 3 == 2, "* two\n").otherwise(""))
    told = F.concat("event_type", F.lit(" happened"), F.when(kind == 1, "\nand more").otherwise(""))
    points, summary = F.concat(F.lit("KEY_POINTS:\n"), bullets), F.concat(F.lit("SUMMARY: "), told, F.lit("\n"))
    made = F.when(kind == 0, F.concat(F.lit("Of course.\n"), summary, points, F.lit("KEY_ENTITIES:\n- x"))).when(kind == 1, F.concat(points, summary)).when(kind == 2, F.concat(F.lit("summary: "), told)).otherwise(F.concat(F.lit("KEY_ENTITIES:\n- y\n"), points))
    rows = e.select("event_id", made.alias("r"))
    return rows.select("event_id", F.nullif(x.labelled_section(F.col("r"), names[0], names), F.lit("")).alias("summary"), F.coalesce(F.size(x.bullets(x.labelled_section(F.col("r"), names[1], names))), F.lit(0)).alias("points"))


@query("x33_plain_x34_filename", """SELECT doc_id, md5(regexp_replace(replace(replace(text, '’', ''''), '–', '-'), '[^\\x{00}-\\x{FF}]', '?', 'g')) AS plain_md5, substr(regexp_replace(source || ' of/file', '[^A-Za-z0-9]', '_', 'g'), 1, 50) || '_' || doc_id AS filename FROM documents""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(x.plain(F.col("text"))).alias("plain_md5"), x.safe_filename(F.concat("source", F.lit(" of/file")), F.col("doc_id").cast("string")).alias("filename"))


@query("x35_pipe_table", """SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY 1""")
def _(spark, d):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"]))
    return t(spark, d, "nation").groupBy("n_regionkey").agg(rows.alias("r")).select("n_regionkey", x.pipe_table(F.array(F.lit("key"), F.lit("name")), F.col("r")).alias("md"))


# --- what SQL cannot express: stateful chunkers, pinned by tests ----------------------------------------------------


_ABBREVIATIONS = ", ".join(f"'{a}'" for a in sorted(x.ABBREVIATIONS))


@query("x02_sentences", rf"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS w, unnest(list_append(w[2:], '')) AS after, unnest(range(len(w))) = len(w) - 1 AS last FROM w),
  b AS (SELECT doc_id, last, regexp_matches(w, '[.!?]$') AND lower(regexp_replace(w, '[.!?,;:]+$', '')) NOT IN ({_ABBREVIATIONS}) AND NOT regexp_matches(regexp_replace(w, '[.!?]+$', ''), '^[0-9]+\.[0-9]*$')
    AND NOT (regexp_matches(w, '\.$') AND regexp_matches(after, '^\p{{Ll}}')) AS stop FROM u), c AS (SELECT doc_id, count(*) FILTER (stop OR last) AS n FROM b GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0)::INT AS sentences FROM documents LEFT JOIN c USING (doc_id)""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.size(x.sentences("text")).alias("sentences"))


@query("x03_x27_normalised", r"""WITH n AS (SELECT doc_id, nfc_normalize(text) AS t FROM documents) SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '[\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g'), '\\s+', ' ', 'g'))) AS text_md5,
  md5(trim(regexp_replace(regexp_replace(lower(t), '[^\\p{L}\\p{N}_\\s\\-''".?!]', '', 'g'), '\\s+', ' ', 'g'))) AS query_md5 FROM n""".replace("\\\\", "\\"))
def _(spark, d):
    """The documents hold no compatibility characters, so NFC does for them what NFKC does, which tests hold to goldens."""
    return _docs(spark, d).select("doc_id", F.md5(x.normalise("text")).alias("text_md5"), F.md5(x.normalise_query("text")).alias("query_md5"))


def _packing(name: str, units: str, size: int, overlap: int) -> str:
    """CTEs: of ``units`` (k, i from 1, n words) the groups ``name`` (k, g, s, e) of at most ``size`` words, each but the first with the units before it of up to ``overlap`` words."""
    return f"""{name}_p AS (SELECT k, i, n, (sum(n) OVER (PARTITION BY k ORDER BY i))::BIGINT AS p FROM {units}), {name}_l AS MATERIALIZED (SELECT k, list(p ORDER BY i) AS ps, list(n ORDER BY i) AS ns FROM {name}_p GROUP BY k),
  {name} AS (SELECT k, 1::BIGINT AS g, 1::BIGINT AS s, greatest(1, len([x FOR x IN ps IF x <= {size}]))::BIGINT AS e FROM {name}_l UNION ALL
    SELECT k, g + 1, s2, greatest(f, len([x FOR x IN ps IF x - coalesce(ps[s2 - 1], 0) <= {size}])) FROM (SELECT k, g, e + 1 AS f, ps,
      greatest(s, least(e + 1, 1 + len([x FOR x IN list_prepend(0, ps[1:e]) IF x < ps[e] - least({overlap}, {size} - ns[e + 1])]))) AS s2 FROM {name} JOIN {name}_l USING (k) WHERE e < len(ps)) y)"""


def _pieces(name: str, units: str, size: int) -> str:
    """CTE: ``units`` (k, i, w, a list of words, and their text) in order, those of more than ``size`` words cut to so many: k, i, w, n, text."""
    return f"""{name} AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i, j) AS i, w, len(w) AS n, CASE WHEN m > {size} THEN array_to_string(w, ' ') ELSE text END AS text FROM (SELECT k, i, len(w) AS m, text, unnest(range(1, greatest(1, len(w)) + 1, {size})) AS j, unnest([w[y : y + {size} - 1] FOR y IN range(1, greatest(1, len(w)) + 1, {size})]) AS w FROM {units}) z)"""


_PARAGRAPHS = f"para AS (SELECT k, i, trim(text, ' ' || chr(9) || chr(13)) AS text, {_WORDS.replace("coalesce(text, '')", "text")} AS w FROM (SELECT doc_id AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) x WHERE trim(text, ' ' || chr(9) || chr(13)) <> '')"


def _sentences_sql(name: str, source: str) -> str:
    """CTE: the sentences of ``source`` (k, w, all words) in order: k, i, w."""
    return rf"""{name}_u AS (SELECT k, unnest(w) AS w, unnest(list_append(w[2:], '')) AS after, unnest(range(1, len(w) + 1)) AS pos FROM {source}),
  {name}_b AS (SELECT k, pos, w, regexp_matches(w, '[.!?]$') AND lower(regexp_replace(w, '[.!?,;:]+$', '')) NOT IN ({_ABBREVIATIONS}) AND NOT regexp_matches(regexp_replace(w, '[.!?]+$', ''), '^[0-9]+\.[0-9]*$') AND NOT (regexp_matches(w, '\.$') AND regexp_matches(after, '^\p{{Ll}}')) AS stop FROM {name}_u),
  {name}_n AS (SELECT k, pos, w, coalesce(sum(stop::INT) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM {name}_b), {name} AS (SELECT k, i, list(w ORDER BY pos) AS w, string_agg(w, ' ' ORDER BY pos) AS text FROM {name}_n GROUP BY k, i)""".replace("\\\\", "\\")


@query("x06_parent_child_chunks", f"""WITH RECURSIVE {_PARAGRAPHS}, many AS (SELECT k, count(*) > 1 AS many FROM para GROUP BY k), whole AS (SELECT k, flatten(list(w ORDER BY i)) AS w FROM para GROUP BY k), {_sentences_sql("sent", "whole")},
  base AS (SELECT k, i, w, text FROM para JOIN many USING (k) WHERE many UNION ALL SELECT k, i, w, text FROM sent JOIN many USING (k) WHERE NOT many), {_pieces("unit", "base", 1500)}, {_packing("parent", "unit", 1500, 200)},
  bodies AS MATERIALIZED (SELECT parent.k AS doc, g, list(text ORDER BY i) AS texts, bool_and(many.many) AS many, flatten(list(w ORDER BY i)) AS w FROM parent JOIN unit ON unit.k = parent.k AND i BETWEEN s AND e JOIN many ON many.k = parent.k GROUP BY parent.k, g),
  body AS (SELECT doc, g, w, CASE WHEN many THEN array_to_string(texts, chr(10)) ELSE array_to_string(texts, ' ') END AS text FROM bodies),
  inner_text AS (SELECT doc || '-' || g AS k, w FROM body), {_sentences_sql("cs", "inner_text")}, {_pieces("cu", "cs", 800)}, {_packing("child", "cu", 800, 200)},
  tail AS (SELECT child.k, g, sum(n) AS words FROM child JOIN cu ON cu.k = child.k AND i BETWEEN s AND e GROUP BY child.k, g), kids AS (SELECT k, (max(g) - CASE WHEN max(g) > 1 AND max_by(words, g) < 400 THEN 1 ELSE 0 END)::INT AS children FROM tail GROUP BY k)
  SELECT doc AS doc_id, (g - 1)::INT AS idx, len(w)::INT AS token_count, md5(text) AS text_md5, children FROM body JOIN kids ON kids.k = doc || '-' || g""")
def _(spark, d):
    return c.parent_child_rows(_docs(spark, d), "doc_id").select("doc_id", "idx", "token_count", F.md5("text").alias("text_md5"), F.size("children").alias("children"))


@query("x07_section_chunks", f"""WITH RECURSIVE {_PARAGRAPHS}, {_pieces("unit", "para", 800)}, {_packing("chunk", "unit", 800, 200)}
  SELECT chunk.k AS doc_id, 'chunk_' || chunk.k || '_' || (g - 1) AS id, sum(n)::INT AS token_count, 'Document' AS path FROM chunk JOIN unit ON unit.k = chunk.k AND i BETWEEN s AND e GROUP BY chunk.k, g""")
def _(spark, d):
    p = c.section_rows(_docs(spark, d), "doc_id")
    return p.select("doc_id", c.chunk_id(F.col("doc_id").cast("string"), F.col("idx")).alias("id"), "token_count", F.array_join("section_path", "/").alias("path"))


@query("x08_x09_entity_chunks")
def _(spark, d):
    p = c.entity_rows(_docs(spark, d), "doc_id", x.stub_entities(F.col("text")))
    return p.select("doc_id", "idx", "kind", "token_count", F.size("entities").alias("entities"), "primary_entity")


@query("x10_regex_chunks_x11_resized", rf"""WITH RECURSIVE raw AS (SELECT doc_id AS k, unnest(string_split_regex(coalesce(text, ''), '[.!?]\s+')) AS text, generate_subscripts(string_split_regex(coalesce(text, ''), '[.!?]\s+'), 1) AS i FROM documents),
  part AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS i, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, {_WORDS.replace("coalesce(text, '')", "text")} AS w FROM raw WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
  sums AS (SELECT k, i, len(w) AS n, (sum(len(w)) OVER (PARTITION BY k ORDER BY i))::BIGINT AS p FROM part), l AS MATERIALIZED (SELECT k, list(p ORDER BY i) AS ps, list(n ORDER BY i) AS ns FROM sums GROUP BY k),
  grp AS (SELECT k, 1::BIGINT AS g, 1::BIGINT AS s, greatest(1, len([x FOR x IN ps IF x <= 1000]))::BIGINT AS e FROM l UNION ALL
    SELECT k, g + 1, s2, greatest(f, len([x FOR x IN ps IF x - coalesce(ps[s2 - 1], 0) <= 1000])) FROM (SELECT k, g, e + 1 AS f, ps, CASE WHEN ps[e] - coalesce(ps[greatest(s, e - 1) - 1], 0) + ns[e + 1] <= 1000 THEN greatest(s, e - 1) ELSE e + 1 END AS s2 FROM grp JOIN l USING (k) WHERE e < len(ps)) y),
  chunk AS MATERIALIZED (SELECT grp.k, g AS i, flatten(list(w ORDER BY i)) AS w, trim(split_part(string_agg(text, ' ' ORDER BY i), '.', 1), ' ') AS label FROM grp JOIN part ON part.k = grp.k AND i BETWEEN s AND e GROUP BY grp.k, g),
  csums AS (SELECT k, i, (sum(len(w)) OVER (PARTITION BY k ORDER BY i))::BIGINT AS p FROM chunk), cl AS MATERIALIZED (SELECT k, list(p ORDER BY i) AS ps FROM csums GROUP BY k),
  m AS (SELECT k, 1::BIGINT AS h, 1::BIGINT AS s, least(len(ps), 1 + len([x FOR x IN ps IF x < 500]))::BIGINT AS e FROM cl UNION ALL SELECT k, h + 1, e + 1, least(len(ps), 1 + len([x FOR x IN ps IF x < ps[e] + 500])) FROM m JOIN cl USING (k) WHERE e < len(ps)),
  fin AS (SELECT m.k, CASE WHEN h > 1 AND e = len(ps) AND ps[e] - coalesce(ps[s - 1], 0) < 500 THEN h - 1 ELSE h END AS h, s, e FROM m JOIN cl USING (k)),
  joined AS (SELECT fin.k, h, flatten(list(w ORDER BY i)) AS w, string_agg(CASE WHEN length(label) > 60 THEN substr(label, 1, 60) || '...' ELSE label END, '; ' ORDER BY i) FILTER (label <> '') AS d FROM fin JOIN chunk ON chunk.k = fin.k AND i BETWEEN s AND e GROUP BY fin.k, h),
  piece AS (SELECT k, h, d, unnest(CASE WHEN len(w) <= 1000 THEN [0] ELSE range(0, len(w) - 100, 900) END) AS a, len(w) AS n FROM joined)
  SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY h, a) - 1)::INT AS idx, least(1000, n - a)::INT AS tokens, md5(coalesce(d, '')) AS description_md5 FROM piece""")
def _(spark, d):
    p = c.regex_rows(_docs(spark, d), "doc_id", x.chunk_label)
    return p.select("doc_id", "idx", x.n_tokens(F.col("text")).alias("tokens"), F.md5("description").alias("description_md5"))


@query("x15_capitalised_terms", f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents), u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(list_append(w[2:], '')) AS after FROM w),
  c AS MATERIALIZED (SELECT doc_id, w, CASE WHEN regexp_matches(after, '^\\p{{Lu}}') THEN after END AS after, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM u WHERE length(w) >= 3 AND regexp_matches(w, '^\\p{{Lu}}') AND lower(w) NOT IN ({", ".join(f"'{y}'" for y in x.COMMON_WORDS)})),
  f AS (SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS terms, []::VARCHAR[] AS seen FROM documents UNION ALL
    SELECT f.doc_id, c.i, CASE WHEN list_contains(seen, c.w) THEN terms ELSE list_append(terms, concat_ws(' ', c.w, c.after)) END, CASE WHEN list_contains(seen, c.w) THEN seen ELSE list_concat(seen, [c.w, coalesce(c.after, c.w)]) END FROM f JOIN c ON c.doc_id = f.doc_id AND c.i = f.i + 1 WHERE len(terms) < 20)
  SELECT doc_id, array_to_string(max_by(terms, i), '|') AS terms FROM f GROUP BY doc_id""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(x.first_terms(F.col("text")), "|").alias("terms"))


@query("x26_extraction_batches", f"""WITH RECURSIVE {_PARAGRAPHS}, unit AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS i, len(w) AS n FROM para), {_packing("batch", "unit", 3000, 200)}
  SELECT doc_id, coalesce(n, 0)::INT AS batches FROM documents LEFT JOIN (SELECT k, max(g) AS n FROM batch GROUP BY k) b ON k = doc_id""")
def _(spark, d):
    return c.batch_rows(_docs(spark, d), "doc_id").select("doc_id", F.size("batches").alias("batches"))


# --- templates ------------------------------------------------------------------------------------------------------

_FORM = "o_orderkey, 'Case study' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'Background' || chr(10) ELSE '' END || 'the customer had an order of some size' || chr(10) || 'Problem: late' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN 'Solution' ELSE 'nothing was done' END AS text"


def _forms(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", F.concat(
        F.lit("Case study\n"), F.when(k % 2 == 0, "Background\n").otherwise(""), F.lit("the customer had an order of some size\nProblem: late\n"), F.when(k % 3 == 0, "Solution").otherwise("nothing was done"),
    ).alias("text"))


@query("x18_template_detection", """SELECT o_orderkey, 'case_study' AS template, round(0.4 * least(2.0 * (2 + (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT) / 7, 1.0) + 0.6 * 0.7 * (1 + (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT) / 3.0, 4)::DOUBLE AS score FROM orders""")
def _(spark, d):
    return templates.detect(_forms(spark, d), "o_orderkey").drop("alternatives")


@query("x19_sections", f"""WITH f AS (SELECT {_FORM} FROM orders), l AS (SELECT o_orderkey, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM f),
  s AS (SELECT o_orderkey, line, CASE WHEN content = 'Background' THEN 'Background' WHEN content = 'Problem: late' THEN 'Problem' WHEN content = 'Solution' THEN 'Solution' END AS section FROM l)
  SELECT o_orderkey, section, line::INT AS start, coalesce(lead(line) OVER (PARTITION BY o_orderkey ORDER BY line), (SELECT max(line) + 1 FROM l WHERE l.o_orderkey = s.o_orderkey))::INT AS "end", 0.9::DOUBLE AS confidence FROM s WHERE section IS NOT NULL""")
def _(spark, d):
    case = next(y for y in templates.TEMPLATES if y.name == "case_study")
    return templates.sections(_forms(spark, d), "o_orderkey", case)


_LINES = (
    ("Lecture 3", 6, (0,)), ("Introduction", 2, (0,)), ("Key concepts", 3, (0,)), ("Week 2", 12, (0,)), ("Abstract", 6, (1,)), ("Methods", 4, (1,)), ("Results", 5, (0, 1)), ("References", 6, (1,)), ("Meeting minutes", 6, (2,)), ("Attendees: all", 6, (2,)),
    ("Agenda", 4, (2,)), ("Action items", 3, (2,)), ("Lab report", 6, (3,)), ("Objective", 6, (3,)), ("Procedure", 2, (1,)), ("Materials", 9, (3, 6)), ("Case study", 6, (4,)), ("Background", 2, (0,)), ("Problem: late", 3, (1,)), ("Solution", 3, (0,)),
    ("Order of parts", 6, (5, 4)), ("Shipping notes", 5, (0, 2, 4)), ("the customer had an order of some size, and wanted it soon", 1, (0,)),
)
_MANY_FORMS = "SELECT o_orderkey, concat_ws(chr(10), " + ", ".join(f"CASE WHEN o_orderkey % {m} IN ({', '.join(map(str, r))}) THEN '{line}' END" for line, m, r in _LINES) + ") AS text FROM orders"
_ORDER_SHEET = templates.Template("order_sheet", (r"(?im)^order of\b", r"(?im)^shipping\b"), (
    templates.Section("Order", (r"(?im)^order\b",), ("Topic",), True), templates.Section("Shipping", (r"(?im)^shipping\b", r"(?im)^delivery\b"), ("Concept",), False),
))


def _many_forms(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", F.concat_ws("\n", *[F.when((k % m).isin(*r), line) for line, m, r in _LINES]).alias("text"))


def _detection_sql(known) -> str:
    """The scores of all templates, from their patterns, and what ``detect`` makes of them."""
    hit = lambda p: f"regexp_matches(text, '{p}')::INT"

    def share(sections) -> str:
        return f"({' + '.join('greatest(' + ', '.join(hit(p) for p in s.patterns) + ', 0)' for s in sections)}) / {len(sections)}.0::DOUBLE" if sections else "1.0::DOUBLE"

    scores = []
    for i, x in enumerate(known):
        hits = " + ".join(hit(p) for p in x.patterns)
        part = f"0.4::DOUBLE * least(2.0 * ({hits}) / {len(x.patterns)}, 1.0::DOUBLE) + 0.6::DOUBLE * (0.7::DOUBLE * {share([s for s in x.sections if s.required])} + 0.3::DOUBLE * {share([s for s in x.sections if not s.required])})"
        scores.append(f"{{'s': -round({part}, 9), 'i': {i}, 'n': '{x.name}'}}")
    return f"""WITH f AS ({_MANY_FORMS}), r AS (SELECT o_orderkey, length(text) < 50 AS short, list_sort([{', '.join(scores)}]) AS r FROM f),
      n AS (SELECT *, CASE WHEN NOT short AND -r[1].s > 0.3 THEN r[1].n ELSE 'generic' END AS template, round(CASE WHEN short THEN 0 WHEN -r[1].s > 0.3 THEN -r[1].s ELSE 0.2 END, 4)::DOUBLE AS score FROM r)
      SELECT o_orderkey, template, score, array_to_string([x.n FOR x IN r IF x.n <> template][1:3], ',') AS alternatives FROM n"""


@query("x18_all_templates", _detection_sql(templates.TEMPLATES))
def _(spark, d):
    return templates.detect(_many_forms(spark, d), "o_orderkey").withColumn("alternatives", F.array_join("alternatives", ","))


@query("x18_registered_templates", _detection_sql((*templates.TEMPLATES, _ORDER_SHEET)))
def _(spark, d):
    """A template that a user adds to the table takes part in all that follows."""
    path = f"{graph.shared_folder(spark)}/templates-{uuid.uuid4().hex}"
    templates.create_table(spark, path)
    templates.add_template(spark, path, _ORDER_SHEET)
    known = templates.read_templates(spark, path)
    return templates.detect(_many_forms(spark, d), "o_orderkey", templates=known).withColumn("alternatives", F.array_join("alternatives", ","))


def _sections_sql(known) -> str:
    parts = []
    for x in known:
        hits = ", ".join(f"CASE WHEN {' OR '.join(f"regexp_matches(content, '{p}')" for p in y.patterns)} THEN {{'o': {i}, 's': '{y.name}', 'c': {0.9 if y.required else 0.8}::DOUBLE}} END" for i, y in enumerate(x.sections))
        parts.append(f"""SELECT '{x.name}' AS template, f.o_orderkey, coalesce(h.s, '{x.sections[0].name}') AS section, coalesce(h.start, 0)::INT AS start, coalesce(lead(h.start) OVER (PARTITION BY f.o_orderkey ORDER BY h.start, h.o), f.n)::INT AS "end", coalesce(h.c, 0.5) AS confidence
          FROM f LEFT JOIN (SELECT o_orderkey, s.s, s.o, any_value(s.c) AS c, min(line) AS start FROM (SELECT o_orderkey, line, unnest([{hits}]) AS s FROM l) u WHERE s IS NOT NULL GROUP BY o_orderkey, s.s, s.o) h USING (o_orderkey)""")
    return f"WITH d AS ({_MANY_FORMS}), f AS (SELECT o_orderkey, len(string_split(text, chr(10))) AS n FROM d), l AS (SELECT o_orderkey, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d) " + " UNION ALL ".join(parts)


@query("x19_sections_of_all_templates", _sections_sql(templates.TEMPLATES))
def _(spark, d):
    forms = _many_forms(spark, d)
    return graph.union_all([templates.sections(forms, "o_orderkey", y).withColumn("template", F.lit(y.name)) for y in templates.TEMPLATES])


@query("x20_template_quality", """SELECT o_orderkey, round(greatest(0.0, least(1.0, 0.4 * greatest(0.0, (o_orderkey % 6) / 6.0::DOUBLE - 0.1 * (o_orderkey % 3)) + 0.3 * least((o_custkey % 15) / 10.0::DOUBLE, 1.0) + 0.3 * 0.8)), 6) AS quality FROM orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", F.round(templates.quality(k % 6, F.lit(6), k % 3, F.col("o_custkey") % 15, F.lit(0.8)), 6).alias("quality"))


# --- vectors --------------------------------------------------------------------------------------------------------

_COS = "list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e))"
_EMB = "emb AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_QUERY = [math.sin(i + 1) for i in range(64)]


def _vectors(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


@query("v01_cosine", f"WITH {_EMB} SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 8) AS score FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = _vectors(spark, d)
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, F.col("b.id") == F.col("a.id") + 1).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(v.cosine(F.col("a.embedding"), F.col("b.embedding")), 8).alias("score"))


@query("v02_w09_nearest", f"WITH {_EMB}, b AS (SELECT {_QUERY}::DOUBLE[] AS e) SELECT vec_id AS id, round({_COS}, 8) AS score FROM emb a, b WHERE label = 3 ORDER BY {_COS} DESC, id LIMIT 10")
def _(spark, d):
    return sim.nearest(_vectors(spark, d), _QUERY, 10, 3).withColumn("score", F.round("score", 8))


_RANKED = "SELECT query_id, rank::INT AS rank, id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) x WHERE rank <= 10"


def _indexed(spark, d):
    return vector_index.build(_vectors(spark, d), f"{graph.shared_folder(spark)}/vector-index-{uuid.uuid4().hex}", 64, label="label")


def _asked(spark, d):
    return _vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")


@query("v02_indexed_nearest", f"WITH {_EMB}, s AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {_COS} AS score FROM emb a, emb b WHERE b.vec_id % 100 = 0) {_RANKED}")
def _(spark, d):
    return vector_index.search(_indexed(spark, d), _asked(spark, d), 10).rows.withColumn("score", F.round("score", 8))


@query("v02_indexed_nearest_of_label", f"WITH {_EMB}, s AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {_COS} AS score FROM emb a, emb b WHERE b.vec_id % 100 = 0 AND a.label = 3) {_RANKED}")
def _(spark, d):
    return vector_index.search(_indexed(spark, d), _asked(spark, d), 10, label="3").rows.withColumn("score", F.round("score", 8))


@query("v03_hybrid", f"""WITH {_EMB}, b AS (SELECT {_QUERY}::DOUBLE[] AS e), s AS (SELECT vec_id AS id, 0.7 * ({_COS}) + 0.3 * ((label % 2 = 0)::INT + 1) / 2.0 AS score FROM emb a, b) SELECT id, round(score, 8) AS score FROM s WHERE score >= 0.2 ORDER BY s.score DESC, id LIMIT 20""")
def _(spark, d):
    rows = _vectors(spark, d).withColumn("text", F.when(F.col("label") % 2 == 0, "an even label").otherwise("an odd label"))
    return sim.hybrid(rows, _QUERY, ["label", "EVEN"], 20, min_score=0.2).withColumn("score", F.round("score", 8))


_STOP = ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS)
_BM25 = rf"""tok AS (SELECT r, d, regexp_replace(w, '[''’]s$', '') AS w FROM (SELECT r, d, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*')) AS w
    FROM (SELECT doc_id AS r, true AS d, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark) u) x WHERE w NOT IN ({_STOP})),
  stem AS (SELECT r, d, CASE WHEN regexp_matches(w, 'ies$') AND NOT regexp_matches(w, '[ea]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, 'es$') AND NOT regexp_matches(w, '[aeo]es$') THEN regexp_replace(w, 's$', '')
    WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '[us]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS term FROM tok),
  len AS (SELECT doc_id AS r, (SELECT count(*) FROM stem WHERE stem.r = doc_id AND d) AS n FROM documents), mean AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM len),
  tf AS (SELECT r, term, count(*) AS tf FROM stem WHERE d GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS (SELECT r AS query_id, term, count(*)::DOUBLE AS weight FROM stem WHERE NOT d GROUP BY ALL),
  bm AS (SELECT query_id, tf.r AS id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.r = tf.r, mean GROUP BY ALL)"""


def _texts_indexed(spark, d):
    return fulltext.build(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), f"{graph.shared_folder(spark)}/text-index-{uuid.uuid4().hex}")


def _text_queries(spark, d):
    return fulltext.query_terms(t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("v03_bm25", f"WITH {_BM25} SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm) x WHERE rank <= 10")
def _(spark, d):
    return fulltext.search(_texts_indexed(spark, d), _text_queries(spark, d), 10).rows.withColumn("score", F.round("score", 6))


@query("v03_hybrid_search", f"""WITH {_EMB}, {_BM25}, tt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 50), tn AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS t FROM tt),
  vv AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {_COS} AS v FROM emb a, emb b WHERE b.vec_id IN (SELECT item_id FROM benchmark) QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) <= 50),
  s AS (SELECT coalesce(tn.query_id, vv.query_id) AS query_id, coalesce(tn.id, vv.id) AS id, round(0.7 * coalesce(v, 0) + 0.3 * coalesce(t, 0), 9) AS score FROM tn FULL JOIN vv ON tn.query_id = vv.query_id AND tn.id = vv.id)
  SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.2) x WHERE rank <= 15""")
def _(spark, d):
    """Vectors and texts are of two tables here: a document and an item have the vector of their number, where there is one."""
    items = t(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    asked = _vectors(spark, d).join(items, "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")
    vectors = vector_index.search(_indexed(spark, d), asked, 50).rows
    texts = fulltext.search(_texts_indexed(spark, d), _text_queries(spark, d), 50).rows
    return fulltext.combined(texts, vectors, least=0.2).withColumn("score", F.round("score", 6))


@query("v04_v05_deterministic_embedding", """WITH s AS (SELECT doc_id, list_sum([unicode(c) FOR c IN string_split(substr(text, 1, 30000), '')])::BIGINT % 997 AS seed, trim(text) AS blank FROM documents)
  SELECT doc_id, (seed % 101) / 100.0::DOUBLE AS first, ((seed + 767) % 101) / 100.0::DOUBLE AS last, 768 AS n FROM s""")
def _(spark, d):
    e = _docs(spark, d).select("doc_id", v.deterministic_embedding(F.col("text")).alias("e"))
    return e.select("doc_id", F.get("e", F.lit(0)).alias("first"), F.get("e", F.lit(767)).alias("last"), F.size("e").alias("n"))


@query("v06_entity_text_v07_zero", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || ': ' || p_type END AS text, 8 AS zeros FROM part")
def _(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", v.entity_text(F.col("p_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_type"))).alias("text"), F.size(v.zero(8)).alias("zeros"))


_PAIRS = f"{_EMB}, pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM emb a JOIN emb b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.4)"


@query("j17_similar_pairs", f"WITH {_EMB} SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 8) AS score FROM emb a JOIN emb b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.4")
def _(spark, d):
    return sim.similar_pairs(_vectors(spark, d), 0.4).withColumn("score", F.round("score", 8))


def _entities(spark, d):
    k = F.col("id")
    return _vectors(spark, d).select(
        "id", F.concat(F.lit("Entity "), k.cast("string")).alias("name"), F.when(k % 3 != 0, F.concat(F.lit("meaning "), k.cast("string"))).alias("definition"), ((k * 7 % 10) / 10.0).alias("confidence"),
        F.concat(F.lit("context "), k.cast("string")).alias("context"), F.when(k % 4 != 0, (k % 5).cast("long")).alias("mention_count"), k.alias("ord"), "embedding",
    )


_CLUSTERS = f"""{_PAIRS}, step AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), walk AS (SELECT a AS id, a AS root FROM step UNION SELECT s.b, w.root FROM walk w JOIN step s ON s.a = w.id),
  comp AS (SELECT id, min(root) AS c FROM walk GROUP BY id), ents AS (SELECT e.vec_id AS id, coalesce(c, e.vec_id) AS c, c IS NOT NULL AS merged, (e.vec_id * 7 % 10) / 10.0 AS confidence,
    CASE WHEN e.vec_id % 3 <> 0 THEN 'meaning ' || e.vec_id END AS definition, 'context ' || e.vec_id AS context, CASE WHEN e.vec_id % 4 <> 0 THEN e.vec_id % 5 END AS mentions FROM emb e LEFT JOIN comp ON comp.id = e.vec_id),
  best AS (SELECT DISTINCT ON (c) c, id AS canonical_id FROM ents ORDER BY c, confidence DESC, id)"""


@query("x22_semantic_dedupe", f"""WITH RECURSIVE {_CLUSTERS}, d AS (SELECT DISTINCT ON (c) c, definition FROM ents WHERE definition IS NOT NULL ORDER BY c, id), g AS (SELECT c, substr(string_agg(context, ' ... ' ORDER BY id), 1, 500) AS context, sum(coalesce(mentions, 1))::BIGINT AS mentions FROM ents GROUP BY c)
  SELECT e.id, d.definition, g.context, g.mentions AS mention_count FROM ents e JOIN best b ON b.canonical_id = e.id LEFT JOIN d ON d.c = e.c JOIN g ON g.c = e.c""")
def _(spark, d):
    return sim.semantic_dedupe(_entities(spark, d), 0.4)[0].select("id", "definition", "context", "mention_count")


@query("x24_repointed_links", f"WITH RECURSIVE {_CLUSTERS} SELECT DISTINCT 'c' || (e.id % 50) AS chunk_id, canonical_id AS entity_id FROM ents e JOIN best USING (c)")
def _(spark, d):
    e = _entities(spark, d)
    links = e.select(F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias("chunk_id"), F.col("id").alias("entity_id"))
    return sim.repoint(links, sim.semantic_dedupe(e, 0.4)[1])


@query("x21_exact_dedupe", "SELECT DISTINCT ON (p_brand) p_brand AS module_id, p_size / 50.0::DOUBLE AS confidence, p_partkey AS ord FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def _(spark, d):
    p = t(spark, d, "part").select(F.lit(" Same NAME").alias("name"), F.col("p_brand").alias("module_id"), (F.col("p_size") / 50.0).alias("confidence"), F.lit("").alias("context"), F.col("p_partkey").alias("ord"))
    return sim.exact_dedupe(p, ["module_id"]).select("module_id", "confidence", "ord")


@query("j16_fuzzy_match", """WITH m AS (SELECT n_regionkey AS doc_id, upper(substr(n_name, 1, 5)) AS mention FROM nation), e AS (SELECT n_regionkey AS doc_id, n_nationkey AS id, n_name AS name FROM nation)
  SELECT DISTINCT ON (m.doc_id, mention) m.doc_id, mention, id, CASE WHEN lower(name) = lower(mention) THEN 1 ELSE 2 END AS rule FROM m JOIN e ON m.doc_id = e.doc_id AND contains(lower(name), lower(mention)) ORDER BY m.doc_id, mention, rule, id""")
def _(spark, d):
    n = t(spark, d, "nation")
    mentions = n.select(F.col("n_regionkey").alias("doc_id"), F.upper(F.substring("n_name", 1, 5)).alias("mention")).distinct()
    entities = n.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    return sim.fuzzy_match(mentions, entities)


_NAMES = """ents AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type || ' ' || p_brand) AS n, string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ') AS w FROM part),
  asked AS (SELECT DISTINCT CASE id % 5 WHEN 0 THEN upper(n) WHEN 1 THEN w[1] || ' ' || w[2] || ' ' || w[3] WHEN 2 THEN 'the ' || n || ' set' WHEN 3 THEN substr(w[2], 1, 2) || substr(w[3], 1, 2) ELSE substr(w[1], 1, 2) || ' ' || substr(w[2], 1, 1) || substr(w[3], 1, 1) || substr(w[4], 1, 1) END AS mention FROM ents
    UNION SELECT array_to_string([substr(x, 1, 1) FOR x IN w], '') FROM ents),
  known AS (SELECT n, any_value(w) AS w, max(id) AS id, min(id) AS ord FROM ents GROUP BY n), q AS (SELECT mention, lower(mention) AS m, string_split(lower(mention), ' ') AS v FROM asked)"""


@query("j16_resolved_names", f"""WITH {_NAMES}, ruled AS (SELECT mention, id, ord, CASE WHEN n = m THEN 1 WHEN contains(n, m) OR contains(m, n) THEN 2
    WHEN m = array_to_string([substr(x, 1, 1) FOR x IN w], '') OR len(v) >= 2 AND array_to_string([substr(x, 1, 1) FOR x IN v], '') = array_to_string([substr(x, 1, 1) FOR x IN w], '') THEN 3
    WHEN len(v) >= 2 AND len(w) >= len(v) AND list_bool_and([starts_with(w[i], v[i]) OR i = len(v) AND v[i] = array_to_string([substr(x, 1, 1) FOR x IN w[i:]], '') FOR i IN range(1, len(v) + 1)]) THEN 4 END AS rule FROM q, known)
  SELECT DISTINCT ON (mention) mention, id, rule::INT AS rule FROM ruled WHERE rule IS NOT NULL ORDER BY mention, ruled.rule, ord""")
def _(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"), F.col("p_partkey").alias("ord"))
    low = F.lower("name")
    w = F.split(low, " ")
    first = lambda i, n: F.substring(F.get(w, F.lit(i)), 1, n)
    k = F.col("id") % 5
    written = F.when(k == 0, F.upper("name")).when(k == 1, F.concat_ws(" ", F.slice(w, 1, 3))).when(k == 2, F.concat(F.lit("the "), low, F.lit(" set"))).when(k == 3, F.concat(first(1, 2), first(2, 2))).otherwise(F.concat(first(0, 2), F.lit(" "), first(1, 1), first(2, 1), first(3, 1)))
    asked = p.select(written.alias("mention")).union(p.select(F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")))
    return names.resolve(asked, p)


@query("x08_dictionary_mentions", """WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\pL{4,}')) AS name FROM benchmark), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS name FROM documents),
  m AS (SELECT name, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM w GROUP BY name), c AS (SELECT name, count(*) AS within FROM n JOIN documents ON contains(lower(text), name) GROUP BY name)
  SELECT name, coalesce(mentions, 0) AS mentions, coalesce(documents, 0) AS documents, within FROM c LEFT JOIN m USING (name)""")
def _(spark, d):
    dictionary = t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("name"))
    texts = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    whole = mentions.find(texts, dictionary, whole_words=True).groupBy("name").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("id").alias("documents"))
    within = mentions.find(texts, dictionary).groupBy("name").agg(F.countDistinct("id").alias("within"))
    zero = F.lit(0).cast("long")
    return within.join(whole, "name", "left").select("name", F.coalesce("mentions", zero).alias("mentions"), F.coalesce("documents", zero).alias("documents"), "within")


# --- documents, chunks and entities: orders, order lines and parts ---------------------------------------------------

_ETL = """docs AS (SELECT o_orderkey AS id, (o_orderkey % 6)::INT AS chunk_count, 'm' || (o_custkey % 8) AS module_id FROM orders),
chunks AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_orderkey AS document_id, l_partkey AS part FROM lineitem),
mentions AS (SELECT DISTINCT id AS chunk_id, 'p' || part AS entity_id FROM chunks)"""


def _etl(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 6).cast("int").alias("chunk_count"), F.concat(F.lit("m"), (F.col("o_custkey") % 8).cast("string")).alias("module_id"))
    ident = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    ch = t(spark, d, "lineitem").select(ident.alias("id"), F.col("l_orderkey").alias("document_id"), "l_partkey", F.col("l_linenumber").alias("idx"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text"), F.when(F.col("l_linenumber") < 6, F.array(F.lit(1.0))).alias("embedding"))
    m = ch.select(F.col("id").alias("chunk_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("entity_id")).distinct()
    return o, ch, m


@query("j01_document_entities", f"WITH {_ETL} SELECT DISTINCT document_id, entity_id FROM chunks JOIN mentions ON chunk_id = chunks.id")
def _(spark, d):
    _, ch, m = _etl(spark, d)
    return quality.document_entities(ch, m)


@query("j02_document_relations", f"WITH {_ETL}, {GRAPH}, de AS (SELECT DISTINCT document_id, entity_id FROM chunks JOIN mentions ON chunk_id = chunks.id) SELECT type, count(*) AS n, count(DISTINCT document_id) AS documents FROM de JOIN edges ON src_id = entity_id GROUP BY type")
def _(spark, d):
    _, ch, m = _etl(spark, d)
    r = quality.document_relations(ch, m, roles.edges(spark, d))
    return r.groupBy("type").agg(F.sum("n").alias("n"), F.count("document_id").alias("documents"))  # one row for each document and type


@query("j03_document_coverage", f"WITH {_ETL}, c AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1), e AS (SELECT document_id, count(DISTINCT entity_id) AS n FROM chunks JOIN mentions ON chunk_id = chunks.id GROUP BY 1) SELECT docs.id AS document_id, chunk_count AS stored, coalesce(c.n, 0) AS chunks, coalesce(e.n, 0) AS entities FROM docs LEFT JOIN c ON c.document_id = docs.id LEFT JOIN e ON e.document_id = docs.id")
def _(spark, d):
    return quality.document_coverage(*_etl(spark, d))


@query("j04_document_content", f"WITH {_ETL}, n AS (SELECT 'p' || p_partkey AS entity_id, p_name AS name FROM part), e AS (SELECT document_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM chunks JOIN mentions ON chunk_id = chunks.id JOIN n USING (entity_id) GROUP BY 1) SELECT docs.id, module_id AS content, coalesce(names, '') AS entity_names FROM docs LEFT JOIN e ON document_id = docs.id")
def _(spark, d):
    o, ch, m = _etl(spark, d)
    names = t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name"))
    out = quality.document_content(o.withColumn("content", F.col("module_id")), ch, m, names)
    return out.select("id", "content", F.array_join("entity_names", ",").alias("entity_names"))


@query("x32_selected_text", f"WITH {_ETL}, s AS (SELECT id, document_id, 'line ' || split_part(id, '-', 2) AS text FROM chunks WHERE split_part(id, '-', 2)::INT <= 3) SELECT document_id, string_agg(text, ';' ORDER BY id) AS text FROM s GROUP BY 1")
def _(spark, d):
    _, ch, _m = _etl(spark, d)
    return quality.selected_text(ch, ch.where("idx <= 3").select("id"), ";")


@query("a18_entity_frequency", """WITH x AS (SELECT DISTINCT source AS module_id, doc_id, unnest([y FOR y IN regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+') IF length(y) > 5 AND regexp_full_match(y, '\\pL+')]) AS name FROM documents),
  g AS (SELECT module_id, name, count(*) AS documents FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY documents DESC, name)::INT AS rank FROM g) SELECT module_id, name, documents, rank, rank <= 5 AS theme FROM r WHERE rank <= 20""")
def _(spark, d):
    names = F.filter(F.split("text", r"\s+"), lambda w: (F.length(w) > 5) & w.rlike(r"^\p{L}+$"))
    return quality.entity_frequency(_docs(spark, d).select(F.col("source").alias("module_id"), names.alias("entities")))


@query("a11_j07_problem_counts", f"""WITH {_ETL}, {GRAPH}, ents AS (SELECT 'p' || p_partkey AS id, p_size FROM part)
  SELECT 'documents_without_chunks' AS "check", count(*) AS n FROM docs WHERE id NOT IN (SELECT document_id FROM chunks) UNION ALL SELECT 'documents_without_entities', count(*) FROM docs WHERE id NOT IN (SELECT document_id FROM chunks JOIN mentions ON chunk_id = chunks.id)
  UNION ALL SELECT 'chunks_without_embedding', count(*) FROM chunks WHERE split_part(id, '-', 2)::INT >= 6 UNION ALL SELECT 'entities_without_definition', count(*) FROM ents WHERE p_size % 5 = 0 UNION ALL SELECT 'entities_without_embedding', count(*) FROM ents WHERE p_size % 7 = 0
  UNION ALL SELECT 'entities_without_chunk', count(*) FROM ents WHERE id NOT IN (SELECT entity_id FROM mentions) UNION ALL SELECT 'orphans', count(*) FROM ents WHERE id NOT IN (SELECT entity_id FROM mentions) AND id NOT IN (SELECT src_id FROM edges) AND id NOT IN (SELECT dst_id FROM edges)""")
def _(spark, d):
    o, ch, m = _etl(spark, d)
    ents = t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") % 5 != 0, "known").otherwise(" ").alias("definition"), F.when(F.col("p_size") % 7 != 0, F.array(F.lit(0.5))).alias("embedding"))
    return quality.problem_counts(o, ch, m, ents, roles.edges(spark, d))


@query("g08_document_graph", f"WITH {_ETL}, x AS (SELECT id FROM chunks WHERE document_id = 6) SELECT '6' AS src_id, id AS dst_id, 'HAS_CHUNK' AS type FROM x UNION ALL SELECT DISTINCT chunk_id, entity_id, 'CONTAINS_ENTITY' FROM mentions WHERE chunk_id IN (SELECT id FROM x)")
def _(spark, d):
    o, ch, m = _etl(spark, d)
    return graph.document_graph(o.withColumn("id", F.col("id").cast("string")), ch.withColumn("document_id", F.col("document_id").cast("string")), m, "6")[1]


@query("u07_schema_difference", "SELECT * FROM (VALUES ('table', 'region', 'extra'), ('column', 'nation.n_name:string', 'extra'), ('table', 'regions', 'missing')) AS x(kind, name, state)")
def _(spark, d):
    present = quality.table_elements({"nation": t(spark, d, "nation"), "region": t(spark, d, "region")})
    expected = present.where("name <> 'region' and name <> 'nation.n_name:string'").unionByName(spark.range(1).select(F.lit("table").alias("kind"), F.lit("regions").alias("name")))
    return quality.schema_difference(expected, present)


# --- display --------------------------------------------------------------------------------------------------------


@query("g14_circular_layout", f"WITH {GRAPH}, r AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY label, id) - 1 AS i, count(*) OVER (PARTITION BY module_id) AS n FROM nodes) SELECT id, round(500 + 320 * cos(2 * pi() * i / n), 6) AS x, round(400 + 320 * sin(2 * pi() * i / n), 6) AS y FROM r")
def _(spark, d):
    return layout.circular(roles.nodes(spark, d), graph="module_id").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("g14_hierarchical_layout", f"WITH {GRAPH}, r AS (SELECT id, coalesce(list_position(['Topic','Concept'], label) - 1, 2) AS l, module_id FROM nodes), q AS (SELECT *, row_number() OVER (PARTITION BY module_id, l ORDER BY id) AS i, count(*) OVER (PARTITION BY module_id, l) AS n FROM r) SELECT id, round(1000.0 * i / (n + 1), 6)::DOUBLE AS x, round(800.0 * (l + 1) / 4, 6)::DOUBLE AS y FROM q")
def _(spark, d):
    return layout.hierarchical(roles.nodes(spark, d), ["Topic", "Concept"], graph="module_id").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("g14_radial_layout", f"WITH {GRAPH}, r AS (SELECT id, (id[2:]::INT % 4) AS level, module_id FROM nodes), q AS (SELECT *, row_number() OVER (PARTITION BY module_id, level ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY module_id, level) AS n, max(level) OVER (PARTITION BY module_id) AS m FROM r) SELECT id, round(500 + 360.0 * level / greatest(1, m) * cos(2 * pi() * i / n), 6)::DOUBLE AS x, round(400 + 360.0 * level / greatest(1, m) * sin(2 * pi() * i / n), 6)::DOUBLE AS y FROM q")
def _(spark, d):
    n = roles.nodes(spark, d).withColumn("level", F.substring("id", 2, 9).cast("int") % 4)
    return layout.radial(n, graph="module_id").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("g15_force_layout")
def _(spark, d):
    """Each module is one displayed graph, with its first 500 entities (the display's own limit) and the edges between them."""
    first = Window.partitionBy("module_id").orderBy("id")
    nodes = roles.nodes(spark, d).withColumn("_r", F.row_number().over(first)).where("_r <= 500").drop("_r").withColumnRenamed("module_id", "graph")
    ends = [nodes.select(F.col("id").alias(f"{x}_id"), F.col("graph").alias(x)) for x in ("src", "dst")]
    edges = roles.edges(spark, d).select("src_id", "dst_id", "type").join(ends[0], "src_id").join(ends[1], "dst_id").where("src = dst").withColumnRenamed("src", "graph").drop("dst")
    return layout.force_directed(nodes, edges.distinct()).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("g16_decorated", f"WITH {GRAPH} SELECT id, CASE label WHEN 'Topic' THEN '#f59e0b' WHEN 'Concept' THEN '#10b981' WHEN 'Methodology' THEN '#8b5cf6' ELSE '#ef4444' END AS colour, (CASE WHEN label = 'Topic' THEN 25 ELSE 20 END * CASE WHEN id = 's1' THEN 1.5 ELSE 1.0 END)::DOUBLE AS size FROM nodes")
def _(spark, d):
    return layout.decorated(roles.nodes(spark, d), "s1").select("id", "colour", "size")


@query("s21_export_csv", f"""WITH {GRAPH} SELECT 2 AS part, id, '"' || id || '","' || name || '","' || label || '"' AS line FROM nodes UNION ALL SELECT 5, src_id || '|' || dst_id || '|' || type, '"' || src_id || '","' || dst_id || '","' || type || '"' FROM edges
  UNION ALL SELECT 0, '', '# Nodes' UNION ALL SELECT 1, '', 'id,name,type' UNION ALL SELECT 3, '', '' UNION ALL SELECT 4, '', 'source,target,type'""")
def _(spark, d):
    return export.csv_lines(roles.nodes(spark, d), roles.edges(spark, d))


@query("s21_export_json", f"WITH {GRAPH} SELECT 0 AS part, id, '{{\"kind\":\"node\",\"id\":\"' || id || '\",\"name\":\"' || name || '\",\"label\":\"' || label || '\"}}' AS line FROM nodes UNION ALL SELECT 1, src_id || '|' || dst_id || '|' || type, '{{\"kind\":\"edge\",\"src_id\":\"' || src_id || '\",\"dst_id\":\"' || dst_id || '\",\"type\":\"' || type || '\"}}' FROM edges")
def _(spark, d):
    return export.json_records(roles.nodes(spark, d), roles.edges(spark, d))


def _xml(text: str) -> str:
    return f"replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"


_ENDS = "src_id || '|' || dst_id || '|' || type"


@query("s21_export_graphml", f"""WITH {GRAPH} SELECT 1 AS part, id, '<node id="' || id || '"><data key="name">' || {_xml("name")} || '</data><data key="type">' || label || '</data></node>' AS line FROM nodes
  UNION ALL SELECT 2, {_ENDS}, '<edge source="' || src_id || '" target="' || dst_id || '"><data key="kind">' || type || '</data></edge>' FROM edges
  UNION ALL SELECT 0, '', '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="name" for="node" attr.name="name" attr.type="string"/><key id="type" for="node" attr.name="type" attr.type="string"/><key id="kind" for="edge" attr.name="kind" attr.type="string"/><graph edgedefault="directed">'
  UNION ALL SELECT 3, '', '</graph></graphml>'""")
def _(spark, d):
    return export.graphml_lines(roles.nodes(spark, d), roles.edges(spark, d))


@query("s21_export_gexf", f"""WITH {GRAPH} SELECT 1 AS part, id, '<node id="' || id || '" label="' || {_xml("name")} || '"/>' AS line FROM nodes
  UNION ALL SELECT 3, {_ENDS}, '<edge source="' || src_id || '" target="' || dst_id || '" label="' || type || '"/>' FROM edges
  UNION ALL SELECT 0, '', '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>'
  UNION ALL SELECT 2, '', '</nodes><edges>' UNION ALL SELECT 4, '', '</edges></graph></gexf>'""")
def _(spark, d):
    return export.gexf_lines(roles.nodes(spark, d), roles.edges(spark, d))


@query("u01_union_of_scans", "SELECT n_name AS name, n_regionkey % 2 AS kind FROM nation UNION SELECT r_name, r_regionkey % 2 FROM region")
def _(spark, d):
    return graph.union_distinct([t(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") % 2).alias("kind")), t(spark, d, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") % 2).alias("kind"))])


@query("u08_distinct_ids", "SELECT DISTINCT id FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT p_partkey FROM part UNION ALL SELECT nullif(s_suppkey, 3) FROM supplier) WHERE id IS NOT NULL")
def _(spark, d):
    three = F.when(F.col("s_suppkey") != 3, F.col("s_suppkey"))
    return graph.distinct_ids([t(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), t(spark, d, "part").select(F.col("p_partkey").alias("id")), t(spark, d, "supplier").select(three.alias("id"))])


@query("a24_batches_merged", "SELECT kind, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT o_orderstatus AS kind, o_orderkey AS k FROM orders UNION ALL SELECT l_linestatus, l_partkey FROM lineitem) GROUP BY 1")
def _(spark, d):
    batches = [t(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("k")), t(spark, d, "lineitem").select(F.col("l_linestatus").alias("kind"), F.col("l_partkey").alias("k"))]
    return graph.union_all(batches).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("entity_ids", "SELECT DISTINCT event_type || ' ' AS name, 'entity_' || substr(md5(lower(trim(event_type)) || ':m1'), 1, 16) AS id FROM events")
def _(spark, d):
    e = t(spark, d, "events").select(F.concat("event_type", F.lit(" ")).alias("name")).distinct()
    return e.select("name", model.entity_id(F.col("name"), F.lit("m1")).alias("id"))
