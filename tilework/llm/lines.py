"""Line deduplication by a log-template tree of fixed depth.

A line is normalised (runs of blanks become one space, every token holding a digit becomes ``<*>``) and routed by its
token count and its first ``depth`` tokens to a leaf. A leaf holds any number of templates. Its lines are one group. The tree goes one level
below the leading tokens: the fields after these are dealt to ``BLOCKS`` blocks of neighbouring fields (one field each, if there are no
more), and the lines that agree in a block are a group too, if one of them is in no recurring template of its leaf's group that
generalises a field. Groups count if they recur as a template must. A token's support in a group is the number of documents, summed
over the group's distinct lines, that have it at its position. A line's templates keep its fields in the order of
their support in one of its groups, cut at each value of it, and generalise the rest, as long as at least ``similarity`` of all fields are
kept and have a support of ``least``; so a template is shared by lines that agree in all it keeps. Values that other families of
the leaf share do not hide a family's template: in a block that its lines agree in, only they (and what equals them there) count, and
there is one if the variable fields leave a block free (always, for up to ``BLOCKS`` - 1 of them). A template is recurring if its lines are in ``least``
documents (summed over its distinct lines) and in two different ones at least: ``least`` is ``min_docs``, and two
for lines of ``PAIR_TOKENS`` tokens or more, which are no chance. A line belongs to the most general of its recurring templates, and goes
from every document but the template's smallest id, so that one copy of a shared passage stays.

Only DataFrame functions. Texts are normalised once, into a table of lines; leaves are counted from it first, and only
lines of leaves that recur are moved with their text. All counts combine on the map side, so a line in a third of all documents is one
row a task; what is joined to it is one row a key, so that a hot key can be split.

Defined results: null texts stay null; lines of fewer than ``min_tokens`` tokens stay; an emptied document keeps its row
with an empty text; rows that repeat an id count as one document, and lines never go from a template's first document; an empty table
gives no rows; other columns pass through, whatever their names, but ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

DEPTH, MIN_DOCS, MIN_TOKENS, SIMILARITY = 3, 3, 4, 0.8
#: Lines of so many tokens recur from two documents on.
PAIR_TOKENS = 10
#: Blocks of fields below a leaf's leading tokens.
BLOCKS = 8


def normalised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``normal``: its text with the lines normalised; line breaks stay where they are."""
    put = lambda c, old, new: F.replace(c, F.lit(old), F.lit(new))
    out = docs.withColumn("normal", put(put("text", "\t", " "), "\r", " "))
    out = out.withColumn("normal", F.when(F.contains("normal", F.lit("  ")), F.regexp_replace("normal", " {2,}", " ")).otherwise(F.col("normal")))
    out = out.withColumn("normal", F.when(F.rlike("normal", F.lit("[0-9]")), F.regexp_replace("normal", r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*", "<*>")).otherwise(F.col("normal")))
    return out.withColumn("normal", put(put("normal", " \n", "\n"), "\n ", "\n"))


def _n_tokens(line):
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def line_table(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """``doc_id, text_key, place, n, leaf, line_key, line``: every line of ``docs`` (doc_id, text) that can be dropped."""
    at = normalised(docs).select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("normal", "\n")).alias("place", "line"))
    at = at.withColumn("line", F.trim("line")).where("line <> ''").withColumn("n", _n_tokens(F.col("line"))).where(F.col("n") >= min_tokens)
    return at.withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", depth))).withColumn("line_key", F.xxhash64("line"))


def recurring_lines(at: DataFrame, depth: int, min_docs: int, similarity: float) -> DataFrame:
    """``line_key, first_doc``: lines of recurring templates, each with the document that keeps it. ``at`` is a line table."""
    least = F.when(F.col("n") >= PAIR_TOKENS, F.lit(min(2, min_docs))).otherwise(F.lit(min_docs))
    span = [F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")]
    often = (F.col("weight") >= F.col("least")) & (F.col("first_doc") < F.col("last_doc"))
    leaves = at.groupBy("leaf", "n").agg(F.count("*").alias("weight"), *span).withColumn("least", least).where(often).select("leaf", "least")
    leaves = common.written(leaves, "leaves")  # of a known size now, so that few leaves are broadcast and lines stay where they are
    held = at.join(leaves, "leaf").groupBy("leaf", "least", "n", "line_key", "line").agg(F.count_distinct("doc_id").alias("weight"), *span)
    held = common.written(held, "held-lines")

    # The only line of a leaf needs no template.
    total = [F.sum("weight").alias("weight"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc")]
    sizes = held.groupBy("leaf", "least").agg(*total, F.count("*").alias("lines")).where(often & (F.col("lines") > 1))
    sizes = common.written(sizes.select("leaf"), "open-leaves")
    exact = held.where(often).join(sizes, "leaf", "left_anti").select("line_key", "first_doc")

    # The first tokens are those of the leaf. A line keeps its weight and documents in ``lines``, which templates are counted from.
    tokens = F.transform(F.slice(F.split("line", " "), depth + 1, F.greatest(F.col("n") - depth, F.lit(0))), lambda t, i: F.xxhash64(i, t))
    members = held.join(sizes, "leaf").select("leaf", "least", "n", "line_key", "weight", "first_doc", "last_doc", tokens.alias("tokens"))
    lines = members.select("leaf", "least", "n", "line_key", "weight", "first_doc", "last_doc")
    kept = common.written(_templates(members.withColumn("group", F.col("leaf")), lines, depth, similarity), "templates")
    templates = kept.groupBy("template", "least").agg(*total).where(often).select("template")
    settled = kept.where(F.col("kept") + depth < F.col("n")).join(templates, "template").select("line_key").distinct()

    # Groups of a block. Groups of the same lines count once, and a single line's only template is the line itself, which the leaf's group has too.
    edge = lambda k: F.floor(F.size("tokens") * k / BLOCKS).cast("int")
    block = [F.when(edge(k) < edge(k + 1), F.xxhash64("leaf", F.lit(k), F.slice("tokens", edge(k) + 1, edge(k + 1) - edge(k)))) for k in range(BLOCKS)]
    open_lines = lines.join(settled, "line_key", "left_anti").select("line_key", F.lit(True).alias("open"))
    dealt = members.join(open_lines, "line_key", "left").withColumn("group", F.explode(F.array_compact(F.array(*block))))
    same = [F.count("*").alias("lines"), F.bit_xor("line_key").alias("same"), F.max("open").alias("open")]
    groups = dealt.groupBy("leaf", "least", "group").agg(*total, *same).where(often & (F.col("lines") > 1) & F.col("open"))
    groups = common.written(groups.groupBy("leaf", "lines", "same").agg(F.min("group").alias("group")).select("group"), "line-groups")
    below = members.withColumn("group", F.explode(F.array_compact(F.array(*block)))).join(groups, "group")
    kept = common.written(kept.union(_templates(below, lines, depth, similarity)).distinct(), "templates")
    templates = kept.groupBy("template", "least").agg(*total).where(often).select("template", "first_doc")
    chosen = kept.select("line_key", "kept", "template").join(templates, "template").groupBy("line_key").agg(F.min(F.struct("kept", "first_doc")).alias("at"))
    return exact.union(chosen.select("line_key", "at.first_doc"))


def _templates(members: DataFrame, lines: DataFrame, depth: int, similarity: float) -> DataFrame:
    """``line_key, kept, template`` and what ``lines`` holds of a line: its templates by the support of its fields in its groups.
    ``members`` has group, least, n, line_key, weight and tokens."""
    fields = members.select("group", "least", "n", "line_key", "weight", F.explode("tokens").alias("token"))
    support = fields.groupBy("group", "least", "token").agg(F.sum("weight").alias("support")).where("support >= least").select("group", "token", "support")
    # What a line keeps at each cut: how many fields, and their hashes in one.
    cut = Window.partitionBy("group", "line_key").orderBy(F.desc("support"))
    kept = fields.join(support, ["group", "token"]).select("group", "line_key", "n", "token", "support")
    kept = kept.select("line_key", "n", F.count("*").over(cut).alias("kept"), F.bit_xor("token").over(cut).alias("hash"))
    kept = kept.where(F.col("kept") + F.least(F.lit(depth), F.col("n")) >= F.lit(similarity) * F.col("n")).select("line_key", "kept", "hash").distinct()
    return kept.join(lines, "line_key").withColumn("template", F.xxhash64("leaf", "kept", "hash")).drop("leaf", "hash")


def line_dedup(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text_col``, and ``n_lines``, ``n_dropped``."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    at = common.written(line_table(base, depth, min_tokens), "line-table", "zstd")
    recurring = recurring_lines(at, depth, min_docs, similarity)
    gone = at.select("doc_id", "text_key", "place", "line_key").join(recurring, "line_key").where(F.col("doc_id") != F.col("first_doc"))
    gone = gone.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("gone"))
    # The rows travel whole, so that no column's name can clash.
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text")).drop("text").join(gone, ["doc_id", "text_key"], "left")
    text = F.col("row")[text_col].cast("string")
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n"))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines))
    named = [new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*named, n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


def _template_sql(of: str, name: str) -> str:
    """``{name}``: the templates of the lines in the groups of ``of`` (n, lead, k, block, least, line, weight)."""
    return f"""
{name}_fields AS (SELECT *, unnest(string_split(line, ' ')) AS token, unnest(range(n)) AS pos FROM {of}),
{name}_supports AS (SELECT n, lead, k, block, pos, token, sum(weight) AS support FROM {name}_fields GROUP BY n, lead, least, k, block, pos, token HAVING sum(weight) >= least),
{name}_kept AS (SELECT f.*, s.support FROM {name}_fields f JOIN {name}_supports s USING (n, lead, k, block, pos, token)),
{name}_cuts AS (
  SELECT n, lead, k, line, support AS cut, sum(count(*)) OVER (PARTITION BY n, lead, k, line ORDER BY support DESC) AS fields
  FROM {name}_kept GROUP BY n, lead, k, line, support),
{name}_every AS (
  SELECT c.n, c.lead, c.line, c.k, c.cut, c.fields, string_agg(f.pos || ' ' || f.token, ' ' ORDER BY f.pos) AS template
  FROM {name}_cuts c JOIN {name}_kept f USING (n, lead, k, line) WHERE c.fields >= {SIMILARITY}::DOUBLE * c.n AND f.support >= c.cut GROUP BY ALL),
{name} AS (SELECT DISTINCT n, lead, line, fields, template FROM {name}_every),"""


ORACLE_SQL = f"""
WITH numbered AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
tokens AS (
  SELECT doc_id, text, place, raw,
         list_transform(list_filter(string_split(translate(raw, chr(9) || chr(13), '  '), ' '), lambda t: t <> ''),
                        lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS toks
  FROM numbered),
eligible AS (SELECT *, array_to_string(toks, ' ') AS line, len(toks) AS n, array_to_string(toks[1:{DEPTH}], ' ') AS lead FROM tokens WHERE len(toks) >= {MIN_TOKENS}),
held AS (
  SELECT n, lead, line, CASE WHEN n >= {PAIR_TOKENS} THEN 2 ELSE {MIN_DOCS} END AS least,
         count(DISTINCT doc_id) AS weight, min(doc_id) AS first_doc, max(doc_id) AS last_doc
  FROM eligible GROUP BY ALL),
leaves AS (SELECT n, lead FROM held GROUP BY n, lead, least HAVING sum(weight) >= least AND min(first_doc) < max(last_doc)),
whole AS (SELECT *, -1 AS k, '' AS block FROM held JOIN leaves USING (n, lead)),{_template_sql("whole", "of_leaf")}
leaf_templates AS (
  SELECT n, lead, template FROM of_leaf JOIN held USING (n, lead, line)
  GROUP BY n, lead, template, least HAVING sum(weight) >= least AND min(first_doc) < max(last_doc)),
settled AS (SELECT DISTINCT line FROM of_leaf JOIN leaf_templates USING (n, lead, template) WHERE fields < n),
blocks AS (SELECT * EXCLUDE (k, block), line NOT IN (SELECT line FROM settled) AS is_open, unnest(range({BLOCKS})) AS k FROM whole),
members AS (
  SELECT *, array_to_string(string_split(line, ' ')[{DEPTH} + k * (n - {DEPTH}) // {BLOCKS} + 1 : {DEPTH} + (k + 1) * (n - {DEPTH}) // {BLOCKS}], ' ') AS block
  FROM blocks WHERE k * (n - {DEPTH}) // {BLOCKS} < (k + 1) * (n - {DEPTH}) // {BLOCKS}),
shared AS (SELECT n, lead, k, block FROM members GROUP BY n, lead, least, k, block HAVING sum(weight) >= least AND min(first_doc) < max(last_doc) AND bool_or(is_open)),
below AS (SELECT * FROM members JOIN shared USING (n, lead, k, block)),{_template_sql("below", "of_blocks")}
mine AS (SELECT * FROM of_leaf UNION SELECT * FROM of_blocks),
templates AS (
  SELECT n, lead, template, min(first_doc) AS first_doc FROM mine JOIN held USING (n, lead, line)
  GROUP BY n, lead, template, least HAVING sum(weight) >= least AND min(first_doc) < max(last_doc)),
recurring AS (SELECT line, arg_min(t.first_doc, m.fields) AS first_doc FROM mine m JOIN templates t USING (n, lead, template) GROUP BY line),
gone AS (SELECT DISTINCT e.doc_id, e.text, e.place FROM eligible e JOIN recurring r ON e.line = r.line WHERE e.doc_id <> r.first_doc),
rest AS (
  SELECT n.doc_id, n.text, string_agg(n.raw, chr(10) ORDER BY n.place) AS kept_text
  FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = n.doc_id AND g.text = n.text AND g.place = n.place) GROUP BY ALL),
tally AS (SELECT doc_id, text, count(*) AS n_dropped FROM gone GROUP BY ALL)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(t.n_dropped, 0)::BIGINT AS n_dropped,
       md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.kept_text, '') END) AS kept_md5
FROM documents d LEFT JOIN tally t ON d.doc_id = t.doc_id AND d.text = t.text LEFT JOIN rest r ON d.doc_id = r.doc_id AND d.text = r.text
"""
