"""Boilerplate lines by a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: first by its number of tokens, then by its leading tokens, with tokens that hold a digit taken
as variable fields. Lines that share a leaf are variants of templates, found in two steps. First, in each position the leaf's
commonest token stands in the template if it has at least half of the leaf's lines, else the position is a variable field; variants
that agree with the commonest tokens in most positions are of this template. Second, of the other variants the tokens that recur in
their position in enough documents stand and the rest are variable fields; variants of one such shape are one template, if most of
its positions are fixed. What belongs to neither is a template of its own. Templates that recur in enough different documents are
dropped everywhere.

Leaves and lines travel as 64-bit hashes, which are worked out once and kept in the shared folder; texts travel only of lines in
leaves with several variants, once for each variant and task, and of the documents for the last step. Hot lines are counted before each
shuffle, and what a document loses is gathered by its id and text, so that rows without an id don't meet in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import others
from loamgrid.runtime import cut_lineage

#: Leading tokens of a leaf; documents that make a template recurrent; share of positions in which a variant agrees with its template.
DEPTH, MIN_DOCS, SIMILAR = 3, 8, 0.7
FIELD = "<*>"
#: Leaves with several variants that may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def masked(line: Column) -> Column:
    """The line's tokens, one space apart, those with a digit as variable fields."""
    odd = F.lit(False)
    for c in ("  ", "\t", "\r", "\f", "\x0b"):
        odd = odd | F.contains(line, F.lit(c))
    plain = F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(plain)


def leaf(line: Column) -> Column:
    """Hash of a masked line's place in the tree: number of spaces and leading tokens."""
    return F.xxhash64(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))), F.substring_index(line, " ", DEPTH))


def masked_lines(docs: DataFrame) -> DataFrame:
    """doc_id, x: the masked lines that have a token."""
    return docs.select("doc_id", F.explode(F.split("text", "\n")).alias("x")).select("doc_id", masked(F.col("x")).alias("x")).where("x != ''")


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, body, leaf, line: hashes of the text and of its lines that have a token."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("body"), F.explode(F.split("text", "\n")).alias("x")).select("doc_id", "body", masked(F.col("x")).alias("x")).where("x != ''")
    return cut_lineage(lines.select("doc_id", "body", leaf(F.col("x")).alias("leaf"), F.xxhash64("x").alias("line")))


def distinct_docs() -> Column:
    return F.count_distinct(F.coalesce(F.col("doc_id"), F.lit(0)), F.col("doc_id").isNull())


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shape(tokens: Column) -> Column:
    """Text of a template whose tokens come as structs (at, t) in any order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(tokens)), lambda s: s["t"]), " ")


def placed(docs: DataFrame, counts: DataFrame, several: DataFrame, min_docs: int) -> DataFrame:
    """leaf, line, docs, kind (how it was found), template of all variants in leaves with several."""
    found = masked_lines(docs).select(leaf(F.col("x")).alias("leaf"), "x").join(small(several), "leaf")
    variants = found.select("leaf", F.xxhash64("x").alias("line"), "x").groupBy("leaf", "line").agg(F.first("x").alias("x"))
    variants = cut_lineage(variants.join(counts, ["leaf", "line"]))
    tokens = variants.select("leaf", "line", "docs", F.posexplode(F.split("x", " ")).alias("at", "token"))
    usual = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("all"))
    usual = cut_lineage(usual.select("leaf", "at", F.col("top.token").alias("usual"), (2 * F.col("top.n") >= F.col("all")).alias("fixed")))
    agree = tokens.join(usual, ["leaf", "at"]).groupBy("leaf", "line").agg((F.count_if(F.col("token") == F.col("usual")) >= SIMILAR * F.count("*")).alias("member"))
    judged = cut_lineage(variants.join(agree, ["leaf", "line"]))
    shapes = usual.groupBy("leaf").agg(shape(F.struct("at", F.when(F.col("fixed"), F.col("usual")).otherwise(FIELD).alias("t"))).alias("template"))
    first = judged.where("member").join(shapes, "leaf").select("leaf", "line", "docs", F.lit("usual").alias("kind"), "template")
    rest = judged.where("NOT member").select("leaf", "line", "docs", "x", F.posexplode(F.split("x", " ")).alias("at", "token"))
    often = rest.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "at", "token", F.lit(True).alias("often"))
    cut = rest.join(often, ["leaf", "at", "token"], "left").groupBy("leaf", "line", "docs", "x")
    cut = cut.agg(shape(F.struct("at", F.when(F.col("often"), F.col("token")).otherwise(FIELD).alias("t"))).alias("shape"), (F.count("often") >= SIMILAR * F.count("*")).alias("solid"))
    second = cut.select("leaf", "line", "docs", F.when(F.col("solid"), "shape").otherwise("own").alias("kind"), F.when(F.col("solid"), F.col("shape")).otherwise(F.col("x")).alias("template"))
    return first.union(second)


def templates(docs: DataFrame, min_docs: int = MIN_DOCS, keys: DataFrame | None = None) -> DataFrame:
    """line (hash of a masked line), template, docs (different documents of the template): the variants of recurrent templates. The
    template of a line that is alone in its leaf is null: the line itself."""
    keys = line_keys(docs) if keys is None else keys
    counts = cut_lineage(keys.groupBy("leaf", "line").agg(distinct_docs().alias("docs")))
    leaves = cut_lineage(counts.groupBy("leaf").agg(F.sum("docs").alias("total"), F.count("*").alias("variants")).where(F.col("total") >= min_docs))
    single = counts.join(leaves.where("variants = 1"), "leaf").select("line", F.lit(None).cast("string").alias("template"), "docs")
    all_placed = cut_lineage(placed(docs, counts, leaves.where("variants > 1").select("leaf"), min_docs).withColumn("of", F.xxhash64("leaf", "kind", "template")))
    # A template has at most the sum of its variants' documents, so that few are left to be counted by different documents.
    enough = all_placed.groupBy("of").agg(F.sum("docs").alias("sum")).where(F.col("sum") >= min_docs).select("of")
    maybe = cut_lineage(all_placed.join(enough, "of").select("line", "of", "template"))
    recurrent = keys.join(small(maybe.select("line", "of")), "line").groupBy("of").agg(distinct_docs().alias("docs")).where(F.col("docs") >= min_docs)
    return maybe.join(recurrent, "of").select("line", "template", "docs").union(single)


OWN = ("n_lines", "n_dropped", "clean_text")


def drop_templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs' columns (but for those named like the operator's own) with n_lines (lines with a token), n_dropped and clean_text.

    clean_text has the lines that are left, in order; lines without a token stay. Null text stays null with zero counts. Documents
    are told apart by doc_id: rows that repeat an id count once towards a template, and all null ids together count as one. Of equally
    common tokens of a position the last in byte order counts as the commonest. Texts of any length are read whole.
    """
    keys = line_keys(docs.select("doc_id", "text"))
    tables = templates(docs.select("doc_id", "text"), min_docs, keys).select("line")
    gone = keys.join(small(cut_lineage(tables)), "line").groupBy(F.col("doc_id").alias("_doc"), F.col("body").alias("_body")).agg(F.collect_set("line").alias("_gone"))
    rest = others(docs, *OWN, "_gone", "_doc", "_body", "_lines", "_left", "_some")
    joined = docs.select(*rest).join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_body")), "left")
    split = joined.withColumn("_lines", F.split("text", "\n")).withColumn("_some", F.size(F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    stays = F.filter("_lines", lambda x: ~F.array_contains("_gone", F.xxhash64(masked(x))))  # a line without a token has the hash of no line
    left = split.withColumn("_left", F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(stays))
    return left.select(
        *rest,
        F.when(F.col("text").isNull(), 0).otherwise(F.col("_some")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines") - F.size("_left")).cast("long").alias("n_dropped"),
        F.array_join("_left", "\n").alias("clean_text"),
    )


def oracle(min_docs: int = MIN_DOCS) -> str:
    """DuckDB SQL for op8."""
    return rf"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
     l0 AS (SELECT r, doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS x FROM (SELECT r, doc_id, string_split(text, chr(10)) AS s FROM raw WHERE text IS NOT NULL)),
     l1 AS (SELECT r, doc_id, pos, x, trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS p FROM l0),
     l AS (SELECT r, doc_id, pos, x, string_split(regexp_replace(p, '[^ 0-9]*[0-9][^ ]*', '{FIELD}', 'g'), ' ') AS t FROM l1),
     k AS (SELECT *, len(t) AS n, t[1:{DEPTH}] AS head FROM l WHERE t <> ['']),
     v AS (SELECT n, head, t, count(DISTINCT coalesce(doc_id, -1)) AS docs FROM k GROUP BY n, head, t),
     e AS (SELECT n, head, t, docs, generate_subscripts(t, 1) AS place, unnest(t) AS token FROM v),
     c AS (SELECT n, head, place, token, sum(docs) AS m FROM e GROUP BY n, head, place, token),
     u AS (SELECT n, head, place, token FROM c QUALIFY row_number() OVER (PARTITION BY n, head, place ORDER BY m DESC, token DESC) = 1),
     a AS (SELECT e.n, e.head, e.t, count_if(e.token = u.token) >= {SIMILAR} * count(*) AS member FROM e JOIN u ON e.n = u.n AND e.head = u.head AND e.place = u.place GROUP BY e.n, e.head, e.t),
     rt AS (SELECT e.* FROM e JOIN a ON e.n = a.n AND e.head = a.head AND e.t = a.t WHERE NOT a.member),
     f AS (SELECT n, head, place, token FROM rt GROUP BY n, head, place, token HAVING sum(docs) >= {min_docs}),
     s AS (SELECT rt.n, rt.head, rt.t, list(CASE WHEN f.token IS NULL THEN '{FIELD}' ELSE rt.token END ORDER BY rt.place) AS shape, count(f.token) >= {SIMILAR} * count(*) AS solid
           FROM rt LEFT JOIN f ON rt.n = f.n AND rt.head = f.head AND rt.place = f.place AND rt.token = f.token GROUP BY rt.n, rt.head, rt.t),
     j AS (SELECT n, head, t, 'usual' AS kind, head AS shape FROM a WHERE member
           UNION ALL SELECT n, head, t, CASE WHEN solid THEN 'shape' ELSE 'own' END, CASE WHEN solid THEN shape ELSE t END FROM s),
     w AS (SELECT j.n, j.head, kind, shape FROM j JOIN k ON j.t = k.t GROUP BY j.n, j.head, kind, shape HAVING count(DISTINCT coalesce(doc_id, -1)) >= {min_docs}),
     d AS (SELECT j.t FROM j JOIN w ON j.n = w.n AND j.head = w.head AND j.kind = w.kind AND j.shape = w.shape),
     m AS (SELECT l.r, l.pos, l.x, l.t <> [''] AS has, d.t IS NOT NULL AS gone FROM l LEFT JOIN d ON l.t = d.t),
     o AS (SELECT r, count_if(has) AS n_lines, count_if(gone) AS n_dropped, string_agg(x, chr(10) ORDER BY pos) FILTER (NOT gone) AS clean FROM m GROUP BY r)
SELECT raw.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN raw.text IS NOT NULL THEN coalesce(clean, '') END AS clean_text
FROM raw LEFT JOIN o ON raw.r = o.r
"""
