"""Merkle manifest of a dataset, with nested-interval labels.

A row's leaf is the hash of its columns; the leaves of a source, by id, and then the sources' roots are hashed in runs of 16 until one
node remains. Every node is labelled with the interval ``[lo, hi)`` of leaf ranks that it covers. A node's parent is the one node of the
next level whose interval holds the node's own; since a node of level L starts at a multiple of ``16 ** L``, its bucket
``lo div 16 ** (L + 1)`` turns that containment into an equality join inside one level. A node's siblings are the parent's
children in the parent's interval less the node's own: those that end where it starts or before, and those that start
where it ends or after.

Levels are joined from the top down. A node takes its parent's path (left and right siblings of each level above) and adds its own,
so a path is made once a node, and leaves, of which there are most, meet only the table of their direct parents, a sixteenth of
their number. Ranks come from range partitions (:func:`places.placed`), so a source with a third of all rows spreads over the
cluster; no task holds more than a run of 16 nodes and one path, and the driver sees two counts.

Defined results: a null column is ``-``; ids may repeat (equal ids are ordered by leaf hash) or be null (first); a null source is a
source of its own, before all others; an empty table gives no rows; texts are hashed whole, as the bytes they have, valid
UTF-8 or not; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .places import placed

FAN = 16
#: Columns that a leaf covers.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(*parts: Column) -> Column:
    """Hash of the parts, concatenated; 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_hash(*columns: Column) -> Column:
    """Hash of the columns, each as ``-`` if null, else as its length in bytes, a colon and its value."""
    as_text = [c.cast("string") for c in columns]
    return _hash(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in as_text]))


def _grown(leaves: DataFrame) -> list[DataFrame]:
    """Tables of the inner nodes by level, from ``grp, at, n, digest``: ``grp, at, n, lo, hi, digest, kids``."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    now, levels = leaves.select("grp", "at", "n", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), "digest"), []
    while most > 1:
        runs = now.where("n > 1").groupBy("grp", F.expr(f"at div {FAN}").alias("at")).agg(F.ceil(F.max("n") / FAN).alias("n"), F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"))
        digest = _hash(F.array_join(F.transform("kids", lambda k: _hex(k["digest"])), ""))
        now = common.written(runs.select("grp", "at", "n", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), digest.alias("digest"), "kids"), "nodes")
        levels.append(now)
        most = -(-most // FAN)
    return levels


def _roots(leaves: DataFrame, levels: Sequence[DataFrame]) -> DataFrame:
    """``grp, digest`` of each group's last node."""
    out = None
    for nodes in (leaves, *levels):
        one = nodes.where("n = 1").select("grp", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def _inside(nodes: DataFrame, level: int, parents: DataFrame) -> DataFrame:
    """``nodes`` (of ``level``) with their ``path``: own siblings, then the parent's path; ``parents`` has a path and its group's ``top``."""
    p = parents.select(F.col("grp").alias("p_grp"), F.expr(f"lo div {FAN ** (level + 1)}").alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("kids").alias("p_kids"), F.col("path").alias("p_path"), "top")
    held = (F.col("grp") == F.col("p_grp")) & (F.expr(f"lo div {FAN ** (level + 1)}") == F.col("p_bucket")) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
    bytes_of = lambda kids: F.aggregate(kids, F.lit("").cast("binary"), lambda x, k: F.concat(x, k["digest"]))
    left = bytes_of(F.filter("p_kids", lambda k: k["hi"] <= F.col("lo")))
    right = bytes_of(F.filter("p_kids", lambda k: k["lo"] >= F.col("hi")))
    path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("p_path"))
    return nodes.join(p, held).select(*nodes.columns, path.alias("path"), "top")


def _with_paths(leaves: DataFrame, levels: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """``leaves`` (columns grp, at, n and others) with ``path`` up to the root of ``tops`` and that table's ``top``; ``tops`` has grp, path, top."""
    above = None
    for level in range(len(levels), -1, -1):
        nodes = levels[level - 1] if level else leaves.withColumn("lo", F.col("at")).withColumn("hi", F.col("at") + 1)
        here = nodes.where("n = 1").join(tops, "grp").select(*nodes.columns, "path", "top")
        above = here if above is None else here.unionByName(_inside(nodes.where("n > 1"), level, above))
    return above.drop("lo", "hi")


def _leaves(docs: DataFrame, columns: Sequence[str], again: Callable | None) -> DataFrame:
    id_col, source_col = columns[0], columns[1]
    values = {c: docs[c] for c in columns}
    source = values[source_col].cast("string")
    changed = F.lit(None).cast("binary") if again is None else leaf_hash(*again(values).values())
    rows = docs.select(values[id_col].alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("grp"), leaf_hash(*values.values()).alias("digest"), changed.alias("changed"))
    return common.written(rows.withColumn("changed", F.nullif("changed", F.col("digest"))), "leaves")


def audit(docs: DataFrame, columns: Sequence[str] = COLUMNS, again: Callable[[dict], dict] | None = None) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    ``columns`` are hashed in their order; the first is the id and the second the source. ``again`` maps these columns (a
    dict by name) to those of the copy that is checked; without it the rows themselves are. ``folded_root`` is recomputed
    from the copy's leaf and the row's siblings, and the copy is verified if that is the root.
    """
    leaves = placed(_leaves(docs, columns, again), "grp", ("doc_id", "digest"), "ranked")
    levels = _grown(leaves)
    per_source = leaves.where("at = 0").select("grp", "source").join(_roots(leaves, levels), "grp")
    sources = placed(per_source.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "source", "digest"), "grp", ("source",), "sources")
    upper = _grown(sources)
    no_path = F.array().cast("array<struct<left:binary,right:binary>>")
    tops = _with_paths(sources, upper, _roots(sources, upper).select("grp", no_path.alias("path"), F.col("digest").alias("top")))
    tops = tops.select(F.col("key").alias("grp"), "path", F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top"))
    found = _with_paths(leaves, levels, common.written(tops, "tops"))
    fold = F.aggregate("path", F.coalesce("changed", "digest"), lambda x, s: _hash(F.concat(_hex(s["left"]), _hex(x), _hex(s["right"]))))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)
    out = found.select("doc_id", "source", _hex(F.col("digest")).alias("leaf"), _hex(F.col("top.subroot")).alias("subroot"), _hex(F.col("top.root")).alias("root"), proof.alias("proof_sha256"), _hex(fold).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The inner nodes: ``source, level, lo, hi, digest`` by source, and with level counted on over the sources' roots (``of_sources``
    true, intervals over the sources in order)."""
    leaves = placed(_leaves(docs, columns, None), "grp", ("doc_id", "digest"), "ranked")
    levels = _grown(leaves)
    names = leaves.where("at = 0").select("grp", "source")
    sources = placed(names.join(_roots(leaves, levels), "grp").select(F.lit("").alias("grp"), "source", "digest"), "grp", ("source",), "sources")
    out = None
    for of_sources, tables in ((False, levels), (True, _grown(sources))):
        for level, nodes in enumerate(tables, 1):
            named = nodes.withColumn("source", F.lit(None).cast("string")) if of_sources else nodes.join(names, "grp")
            one = named.select("source", F.lit(of_sources).alias("of_sources"), F.lit(level).alias("level"), "lo", "hi", _hex(F.col("digest")).alias("digest"))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], "source string, of_sources boolean, level int, lo long, hi long, digest string")


def lower_one_in_five(values: dict) -> dict:
    """The contract's tampered copy: A-Z of the text in lower case where 5 divides the CRC-32 of the decimal id."""
    small = F.translate(values["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(values["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return values | {"text": F.when(hit, small).otherwise(values["text"])}


def _sql() -> str:
    """The same rows in DuckDB SQL, for up to 16 ** 5 rows a source and 16 ** 4 sources."""
    size = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
    leaf = lambda text: f"sha256({' || '.join(size(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    out = [
        f"WITH d AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {common.crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS copy FROM documents)",
        f"h AS (SELECT doc_id, source, coalesce('s' || source, '') AS grp, {leaf('text')} AS leaf, {leaf('copy')} AS changed FROM d)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n, leaf AS digest FROM h)",
    ]

    def tree(a: str, top: int) -> str:
        for k in range(1, top + 1):
            below = f"{a}{k - 1}"
            out.append(f"{a}r{k} AS (SELECT grp, pos // 16 AS pos, list(digest ORDER BY pos) AS kids, any_value((n + 15) // 16) AS n FROM {below} WHERE n > 1 GROUP BY grp, pos // 16)")
            out.append(f"{a}{k} AS (SELECT grp, pos, n, kids, sha256(array_to_string(kids, '')) AS digest FROM {a}r{k})")
        return " UNION ALL ".join(f"SELECT grp, digest FROM {a}{k} WHERE n = 1" for k in range(top + 1))

    out.append(f"subs AS ({tree('a', 5)})")
    out.append("b0 AS (SELECT '' AS grp, s.grp AS key, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM subs s JOIN (SELECT DISTINCT grp, source FROM h) USING (grp))")
    out.append(f"roots AS ({tree('b', 4)})")
    out.append("f0 AS (SELECT a0.*, changed AS x, '' AS proof FROM a0)")

    def climb(a: str, f: str, top: int) -> None:
        for k in range(1, top + 1):
            left, right = "coalesce(array_to_string(kids[1:(f.pos % 16)], ''), '')", "coalesce(array_to_string(kids[(f.pos % 16 + 2):], ''), '')"
            out.append(
                f"{f}{k} AS (SELECT f.* EXCLUDE (pos, n, x, proof), f.pos // 16 AS pos, (f.n + 15) // 16 AS n, CASE WHEN p.grp IS NULL THEN x ELSE sha256({left} || x || {right}) END AS x, "
                f"CASE WHEN p.grp IS NULL THEN proof ELSE proof || {left} || {right} END AS proof FROM {f}{k - 1} f LEFT JOIN {a}{k} p ON f.n > 1 AND p.grp = f.grp AND p.pos = f.pos // 16)"
            )

    climb("a", "f", 5)
    out.append("g0 AS (SELECT f.doc_id, f.leaf, b.digest AS subroot, '' AS grp, b.pos, b.n, f.x, f.proof FROM f5 f JOIN b0 b ON b.key = f.grp)")
    climb("b", "g", 4)
    return ", ".join(out) + " SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.digest AS verified FROM g4, roots r"


ORACLE_SQL = _sql()
