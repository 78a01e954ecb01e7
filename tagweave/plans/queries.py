"""Queries over the test tables, each with the SQL that DuckDB runs on the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims, tables
from ..functions import scalars as S
from ..operators import circles, consensus, extract, lines, merge, review, votes
from ..schema import BOX, CircleOptions, MergeOptions, ReconcileOptions
from ..sources import readers, sinks
from . import adapters as A
from .pipeline import extract_drawing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-01-01T00:00:00Z"

_W, _T, _R, _P, _L = (A.oracle(x) for x in (A.WORDS, A.TAGS, A.READS, A.SEED, A.LINES))


def query(view: str, oracle: str | None = None):
    """Registers a function of one adapter view under its own name."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(A.view(spark, sf_dir, view))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return put


_FULL = "regexp_matches(text, '^[A-Z]{1,5}-?[0-9]{2,5}([A-Z]{1,2})?$')"
_PAIRS = f"""
w AS (SELECT *, CAST(floor((x0 + x1) / 2 / 80) AS BIGINT) AS bucket FROM ({_W})), ws AS (SELECT *, min(word_seq) OVER (PARTITION BY drawing_id, page, bucket) AS bucket_seq FROM w),
pair AS (SELECT t.drawing_id, t.page, t.bucket_seq, CASE b.bucket - t.bucket WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS side, t.word_seq AS top_seq, b.word_seq AS bottom_seq, t.text AS top_text, b.text AS bottom_text,
  least(t.x0, b.x0) AS x0, least(t.y0, b.y0) AS y0, greatest(t.x1, b.x1) AS x1, greatest(t.y1, b.y1) AS y1, least(t.confidence, b.confidence) AS confidence,
  CASE WHEN t.origin = 'bubble' AND b.origin = 'bubble' THEN 'bubble' ELSE 'page' END AS origin
  FROM ws t JOIN ws b ON t.drawing_id = b.drawing_id AND t.page = b.page AND abs(t.bucket - b.bucket) <= 1 AND t.word_seq <> b.word_seq
  WHERE b.y0 - t.y1 BETWEEN -2 AND (t.y1 - t.y0) * 0.8 AND least(t.x1 - t.x0, b.x1 - b.x0) > 0 AND (least(t.x1, b.x1) - greatest(t.x0, b.x0)) / least(t.x1 - t.x0, b.x1 - b.x0) >= 0.3
  AND greatest(t.y1, b.y1) - least(t.y0, b.y0) <= 2.5 * greatest(t.y1 - t.y0, b.y1 - b.y0))"""
_KEPT = f"""
cand AS (SELECT drawing_id, page, x0, y0, x1, y1, confidence, origin, text, 0 AS o1, 0 AS o2, word_seq AS o3, 0 AS o4, 0 AS o5, 0 AS o6 FROM w WHERE {_FULL}
  UNION ALL SELECT drawing_id, page, x0, y0, x1, y1, confidence, origin, text, 1, bucket_seq, top_seq, side, bottom_seq, form FROM (SELECT *, 0 AS form, top_text || '-' || bottom_text AS text FROM pair UNION ALL SELECT *, 1, top_text || bottom_text FROM pair) WHERE {_FULL}),
ranked AS (SELECT drawing_id, page, list(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, confidence := confidence, origin := origin, text := text, o := [o1, o2, o3, o4, o5, o6])
  ORDER BY CASE origin WHEN 'bubble' THEN 0 ELSE 1 END, -length(text), -confidence, o1, o2, o3, o4, o5, o6) AS l FROM cand GROUP BY drawing_id, page),
kept AS (SELECT drawing_id, page, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda k: greatest(0, least(k.x1, x.x1) - greatest(k.x0, x.x0)) * greatest(0, least(k.y1, x.y1) - greatest(k.y0, x.y0)) > 0.4 *
  ((k.x1 - k.x0) * (k.y1 - k.y0) + (x.x1 - x.x0) * (x.y1 - x.y0) - greatest(0, least(k.x1, x.x1) - greatest(k.x0, x.x0)) * greatest(0, least(k.y1, x.y1) - greatest(k.y0, x.y0))))) > 0 THEN a ELSE list_append(a, x) END, l[1:0])) AS c FROM ranked)"""


@query(A.WORDS, f"SELECT drawing_id, word_seq, text, regexp_extract(text, '^([A-Z]+)', 1) AS func, regexp_extract(text, '([0-9]+)', 1) AS loop FROM ({_W}) WHERE {_FULL}")
def word_pattern_match(words):
    return extract.word_matches(words).select("drawing_id", F.col("ordinal.top").alias("word_seq"), "text", "func", "loop")


@query(A.WORDS, f"WITH {_PAIRS} SELECT drawing_id, page, side, top_seq, bottom_seq, x0, y0, x1, y1, confidence, origin FROM pair")
def stacked_pairs(words):
    return extract.stacked_pairs(words).select("drawing_id", "page", "side", "top_seq", "bottom_seq", *BOX, "confidence", "origin")


@query(A.WORDS, f"WITH {_PAIRS}, {_KEPT} SELECT drawing_id, page, c.text AS text, c.x0 AS x0, c.y0 AS y0, c.confidence AS confidence, c.origin AS origin FROM kept")
def candidate_suppression(words):
    return extract.suppress_overlaps(extract.candidates(words)).select("drawing_id", "page", "text", "x0", "y0", "confidence", "origin")


@query(A.WORDS, f"WITH {_PAIRS}, {_KEPT} SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY page, c.y0, c.x0, c.o) AS tag_seq, c.text AS text, regexp_extract(c.text, '^([A-Z]+)', 1) AS function_code, regexp_extract(c.text, '([0-9]+)', 1) AS loop_number, regexp_extract(c.text, '[0-9]([A-Z]*)$', 1) AS suffix, page FROM kept")
def tags_extracted(words):
    return extract.extract(words).select("drawing_id", "tag_seq", "text", "function_code", "loop_number", "suffix", "page")


def tags_reconciled(words):
    return extract_drawing(words)[0].select("drawing_id", "tag_seq", "text", "function_code", "loop_number", "suffix", "loop_group", "state", "notes")


_VOTE = f"""r AS (SELECT *, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') AS token FROM ({_R})), k AS (SELECT *, CASE WHEN regexp_matches(token, '^[A-Z]{{1,5}}$') THEN 'func' WHEN regexp_matches(token, '^[0-9]{{2,5}}[A-Z]?$') THEN 'loop' END AS kind FROM r),
once AS (SELECT drawing_id, bubble_id, kind, token, variant, confidence, read_seq FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY drawing_id, bubble_id, kind, token, variant ORDER BY read_seq) = 1),
v AS (SELECT drawing_id, bubble_id, kind, token, count(*) AS votes, sum(confidence) AS s, min(variant * 1000000000000 + read_seq) AS seen FROM once GROUP BY ALL)"""


@query(A.READS, f"WITH {_VOTE} SELECT drawing_id, bubble_id, kind, token, votes, s AS confidence_sum FROM v")
def bubble_votes(reads):
    return votes.votes(reads).drop("seen")


@query(A.READS, f"WITH {_VOTE} SELECT drawing_id, bubble_id, kind, token, votes, s / votes AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY drawing_id, bubble_id, kind ORDER BY votes DESC, length(token) DESC, seen) = 1")
def bubble_winner(reads):
    return votes.winners(reads)


_SUB = f"sub AS (SELECT *, loop_number || suffix AS token, CASE WHEN regexp_matches(loop_number || suffix, '^[0-9]*[A-Z]*$') THEN regexp_extract(loop_number || suffix, '^([0-9]*)', 1) ELSE loop_number || suffix END AS stem FROM ({_T}) WHERE origin = 'bubble' AND source = 'auto' AND state <> 'confirmed' QUALIFY count(*) OVER (PARTITION BY drawing_id) >= 3)"


@query(A.TAGS, f"WITH {_SUB} SELECT drawing_id, token, count(*) AS support FROM sub WHERE token <> '' GROUP BY ALL")
def loop_support(tags):
    return consensus.token_support(consensus.subjects(tags)).select(F.col("sheet").alias("drawing_id"), "token", "support")


@query(A.TAGS, f"WITH {_SUB} SELECT drawing_id, stem, count(*) AS stem_support FROM sub WHERE stem <> '' GROUP BY ALL")
def stem_support(tags):
    return consensus.stem_support(consensus.subjects(tags)).withColumnRenamed("sheet", "drawing_id")


_MODAL = f"st AS (SELECT DISTINCT drawing_id, stem FROM sub WHERE stem <> ''), n AS (SELECT drawing_id, length(stem) AS len, count(*) AS n FROM st a WHERE NOT (length(stem) > 1 AND EXISTS (SELECT 1 FROM st b WHERE b.drawing_id = a.drawing_id AND b.stem = a.stem[:-2])) GROUP BY ALL), modal AS (SELECT drawing_id, CAST(len AS INT) AS modal FROM n QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY n DESC, len) = 1)"


@query(A.TAGS, f"WITH {_SUB}, {_MODAL} SELECT * FROM modal")
def modal_stem_length(tags):
    return consensus.modal_length(consensus.subjects(tags)).withColumnRenamed("sheet", "drawing_id")


def _one_of(a: str, b: str) -> str:
    pairs = sorted({x for a, b in dims.CONFUSABLE for x in (a + b, b + a)})
    return f"({a} = {b} OR {a} || {b} IN ({', '.join(repr(p) for p in pairs)}))"


def _substituted(a: str, b: str) -> str:
    """One place differs, and its characters are confusable."""
    at = f"list_filter(range(1, length({a}) + 1), lambda i: substring({a}, i, 1) <> substring({b}, i, 1))"
    return f"(length({a}) = length({b}) AND len({at}) = 1 AND {_one_of(f'substring({a}, {at}[1], 1)', f'substring({b}, {at}[1], 1)')})"


def _inserted(short: str, long: str) -> str:
    return f"(length({long}) = length({short}) + 1 AND len(list_filter(range(1, length({long}) + 1), lambda i: substring({long}, 1, i - 1) || substring({long}, i + 1) = {short})) > 0)"


_TOKEN = r"token, CASE WHEN regexp_matches(token, '^[0-9]*[A-Z]*$') THEN regexp_extract(token, '^([0-9]*)', 1) ELSE token END AS s, CASE WHEN regexp_matches(token, '^[0-9]*[A-Z]*$') THEN regexp_extract(token, '([A-Z]*)$', 1) ELSE '' END AS l"


_FIXES = f"""SELECT drawing_id, id, function_code AS before, min(k) AS after, 'nearest known function code' AS kind, 'func' AS field FROM sub, (SELECT unnest({dims.KNOWN_CODES!r}) AS k)
WHERE function_code <> '' AND NOT list_contains({dims.KNOWN_CODES!r}, function_code) AND ({_substituted('function_code', 'k')} OR {_inserted('function_code', 'k')} OR {_inserted('k', 'function_code')})
GROUP BY drawing_id, id, function_code HAVING count(*) = 1"""
_KINDS = f"""tok AS (SELECT DISTINCT drawing_id, {_TOKEN} FROM sub WHERE token <> ''),
p AS (SELECT a.drawing_id, a.token, b.token AS "to", a.s AS sa, a.l AS la, b.s AS sb, b.l AS lb, right(a.s, 1) AS dropped FROM tok a JOIN tok b USING (drawing_id)),
k AS (SELECT drawing_id, token, "to", CASE WHEN token = "to" OR (la <> '' AND lb = '') THEN NULL
  WHEN la = lb THEN CASE WHEN {_substituted('sa', 'sb')} THEN 'stem-substitution' WHEN {_inserted('sa', 'sb')} THEN 'stem-insertion' END
  WHEN la = '' THEN CASE WHEN length(lb) = 1 AND sa = sb || dropped AND length(sa) = length(sb) + 1 AND {_one_of('dropped', 'lb')} THEN 'suffix-recovered' END
  WHEN sa = sb AND {_substituted('la', 'lb')} THEN 'suffix-substitution' END AS kind FROM p)"""
_O = ReconcileOptions()
_SINGLE = ", ".join(f"('{d}', '{x[0]}')" for d, x in S.confusable_letters().items() if len(x) == 1)


@query(A.TAGS, f"""WITH {_SUB}, {_MODAL}, {_KINDS},
tokens AS (SELECT drawing_id, token, any_value(stem) AS stem, count(*) AS support, min(tag_seq) AS first_seq FROM sub WHERE token <> '' GROUP BY drawing_id, token),
stems AS (SELECT drawing_id, stem, count(*) AS stem_support FROM sub WHERE stem <> '' GROUP BY drawing_id, stem),
spot AS (SELECT drawing_id, id, token, stem, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM sub),
marked AS (SELECT *, stem <> '' AND length(stem) <> modal AS odd FROM (SELECT spot.*, support, coalesce(modal, 0) AS modal FROM spot JOIN tokens USING (drawing_id, token) LEFT JOIN modal USING (drawing_id))
  WHERE support <= {_O.weak_support} OR stem <> '' AND length(stem) <> modal),
pair AS (SELECT m.drawing_id, m.id, m.token, k."to", k.kind, coalesce(stem_support, t.support) AS evidence, t.first_seq, min(sqrt((o.cx - m.cx) ** 2 + (o.cy - m.cy) ** 2)) AS away
  FROM marked m JOIN k ON k.drawing_id = m.drawing_id AND k.token = m.token AND k.kind IS NOT NULL JOIN tokens t ON t.drawing_id = m.drawing_id AND t.token = k."to"
  LEFT JOIN stems ON stems.drawing_id = t.drawing_id AND stems.stem = t.stem JOIN spot o ON o.drawing_id = m.drawing_id AND o.token = k."to"
  WHERE coalesce(stem_support, t.support) >= m.support + CASE WHEN m.odd THEN 1 ELSE {_O.support_margin} END GROUP BY ALL),
best AS (SELECT * FROM pair WHERE away <= {_O.cluster_radius} QUALIFY row_number() OVER (PARTITION BY drawing_id, id ORDER BY evidence DESC, away, first_seq) = 1),
lone AS (SELECT m.drawing_id, m.id, m.token, left(m.stem, -1) AS base, letter, stem_support, min(sqrt((o.cx - m.cx) ** 2 + (o.cy - m.cy) ** 2)) AS away FROM marked m JOIN (VALUES {_SINGLE}) d(digit, letter) ON digit = right(m.stem, 1)
  JOIN stems ON stems.drawing_id = m.drawing_id AND stems.stem = left(m.stem, -1) AND stem_support >= {_O.support_margin} JOIN spot o ON o.drawing_id = m.drawing_id AND o.stem = left(m.stem, -1)
  WHERE m.token = m.stem AND length(m.stem) = m.modal + 1 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.drawing_id = m.drawing_id AND b.id = m.id) GROUP BY ALL)
SELECT drawing_id, id, 'loop' AS field, token AS before, "to" AS after, kind, evidence AS support FROM best
UNION ALL SELECT drawing_id, id, 'loop', token, base || letter, 'suffix-inferred', stem_support FROM lone WHERE away <= {_O.cluster_radius}
UNION ALL SELECT drawing_id, id, field, before, after, kind, CAST(NULL AS BIGINT) FROM ({_FIXES})""")
def corrections(tags):
    return consensus.corrections(tags)


_STEM = lambda x: f"CASE WHEN regexp_matches({x}, '^[0-9]*[A-Z]*$') THEN regexp_extract({x}, '^([0-9]*)', 1) ELSE {x} END"
_LETTERS = lambda x: f"CASE WHEN regexp_matches({x}, '^[0-9]*[A-Z]*$') THEN regexp_extract({x}, '([A-Z]*)$', 1) ELSE '' END"
query(A.WORDS, f"""WITH {_PAIRS}, {_KEPT},
seen AS (SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY page, c.y0, c.x0, c.o) AS tag_seq, page, c.text AS text, c.x0 AS x0, c.y0 AS y0, c.x1 AS x1, c.y1 AS y1, c.origin AS origin FROM kept),
ext AS (SELECT *, 'tag-' || drawing_id || '-' || tag_seq AS id, regexp_extract(text, '^([A-Z]+)', 1) AS function_code, regexp_extract(text, '([0-9]+)', 1) AS loop_number, regexp_extract(text, '[0-9]([A-Z]*)$', 1) AS suffix, 'auto' AS source, 'uncertain' AS state FROM seen),
fixes AS ({ORACLE_SQL["corrections"].replace(f"({_T})", "ext")}),
by_tag AS (SELECT drawing_id, id, max(CASE WHEN field = 'loop' THEN before END) AS l0, max(CASE WHEN field = 'loop' THEN after END) AS l1, max(CASE WHEN field = 'loop' THEN kind END) AS lk, max(CASE WHEN field = 'loop' THEN support END) AS ls, max(CASE WHEN field = 'func' THEN before END) AS f0, max(CASE WHEN field = 'func' THEN after END) AS f1 FROM fixes GROUP BY drawing_id, id),
new AS (SELECT ext.*, l0, l1, lk, ls, f0, f1, l1 IS NOT NULL OR f1 IS NOT NULL AS fixed, coalesce(f1, function_code) AS func, CASE WHEN l1 IS NOT NULL THEN {_STEM('l1')} ELSE loop_number END AS loop, CASE WHEN l1 IS NOT NULL THEN {_LETTERS('l1')} ELSE suffix END AS suf FROM ext LEFT JOIN by_tag USING (drawing_id, id))
SELECT drawing_id, tag_seq, CASE WHEN fixed THEN func || '-' || loop || suf ELSE text END AS text, func AS function_code, loop AS loop_number, suf AS suffix, loop || suf AS loop_group, state,
CASE WHEN fixed THEN concat_ws(' ', CASE WHEN lk = 'suffix-inferred' THEN format('Loop read as "{{}}". No bubble on this sheet read the suffix, but "{{}}" is a {{}}-bubble loop here and a trailing "{{}}" is a common misread of "{{}}". Check this one against the drawing.', l0, l0[:-2], ls, l0[-1:], l1[-1:])
  WHEN l1 IS NOT NULL THEN format('Loop read as "{{}}"; corrected to "{{}}" ({{}} nearby bubbles on this loop). Verify against the drawing.', l0, l1, ls) END,
  CASE WHEN f1 IS NOT NULL THEN format('Function code read as "{{}}"; "{{}}" is the only known code one character away.', f0, f1) END) ELSE '' END AS notes FROM new""")(tags_reconciled)


@query(A.TAGS, f"WITH {_SUB} {_FIXES}")
def function_code_fix(tags):
    return consensus.function_fixes(consensus.subjects(tags)).drop("support")


@query(A.TAGS, f"WITH {_SUB}, {_KINDS} SELECT * FROM k WHERE kind IS NOT NULL")
def correction_kinds(tags):
    """Kinds between the tokens of each drawing."""
    t = consensus.token_support(consensus.subjects(tags)).select("sheet", "token")
    t = tables.stored(t, "tokens")
    key = lambda column, target: F.explode(S.edit_keys(F.col(column), target))
    targets = t.select("sheet", F.col("token").alias("to")).withColumn("key", key("to", True))
    pairs = t.withColumn("key", key("token", False)).join(tables.shuffled(targets), ["sheet", "key"]).drop("key").distinct()
    return pairs.withColumn("kind", S.correction_kind(F.col("token"), F.col("to"))).filter("kind IS NOT NULL").withColumnRenamed("sheet", "drawing_id")


def _seeded(f, oracle=None):
    def run(spark, sf_dir):
        seed, _ = merge.seed_distinct(A.view(spark, sf_dir, A.SEED))
        return f(A.view(spark, sf_dir, A.TAGS), seed)

    QUERIES[f.__name__] = run
    if oracle:
        ORACLE_SQL[f.__name__] = oracle
    return f


_KEY = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
_MERGE = f"seed AS (SELECT *, {_KEY.format('tag')} AS key FROM ({_P}) QUALIFY row_number() OVER (PARTITION BY drawing_id, {_KEY.format('tag')} ORDER BY row_seq) = 1), tags AS (SELECT *, {_KEY.format('text')} AS key, row_number() OVER (PARTITION BY drawing_id, {_KEY.format('text')} ORDER BY tag_seq) AS r FROM ({_T}))"


def seed_missing(tags, seed):
    return merge.missing(tags, seed).select("drawing_id", "row_seq", "tag")


def seed_unmatched(tags, seed):
    return merge.unmatched(tags, seed).select("drawing_id", "tag_seq", "text")


def seed_merge(tags, seed):
    return merge.enriched(tags, seed, MergeOptions(reviewer="KG", updated_at=NOW)).select("drawing_id", "tag_seq", "text", "description", "panel", "size", "state", "updated_by", "matched")


_seeded(seed_missing, f"WITH {_MERGE} SELECT drawing_id, row_seq, tag FROM seed s WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.drawing_id = s.drawing_id AND t.key = s.key)")
_seeded(seed_unmatched, f"WITH {_MERGE} SELECT drawing_id, tag_seq, text FROM tags t WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE t.drawing_id = s.drawing_id AND t.key = s.key)")
_seeded(seed_merge, f"""WITH {_MERGE}, j AS (SELECT t.*, s.tag AS st, s.description AS sd, s.panel AS sp, s.size AS ss, s.state AS sx, s.key IS NOT NULL AND r = 1 AS m FROM tags t LEFT JOIN seed s ON t.drawing_id = s.drawing_id AND t.key = s.key)
SELECT drawing_id, tag_seq, CASE WHEN m THEN st ELSE text END AS text, CASE WHEN m AND sd <> '' AND description = '' THEN sd ELSE description END AS description, CASE WHEN m AND sp <> '' AND panel = '' THEN sp ELSE panel END AS panel,
CASE WHEN m AND ss <> '' AND size = '' THEN ss ELSE size END AS size, CASE WHEN m THEN coalesce(sx, 'confirmed') ELSE state END AS state, CASE WHEN m THEN 'KG' ELSE updated_by END AS updated_by, m AS matched FROM j""")  # fmt: skip


@query(A.SEED, f"SELECT drawing_id, row_seq, tag FROM ({_P}) QUALIFY row_number() OVER (PARTITION BY drawing_id, {_KEY.format('tag')} ORDER BY row_seq) = 1")
def seed_dedupe(rows):
    return merge.seed_distinct(rows)[0].select("drawing_id", "row_seq", "tag")


@query(A.TAGS, f"WITH t AS (SELECT *, {_KEY.format('text')} AS key FROM ({_T})) SELECT drawing_id, tag_seq, text FROM t QUALIFY row_number() OVER (PARTITION BY drawing_id, key ORDER BY tag_seq) > 1")
def seed_duplicates(tags):
    return merge.duplicates(tags).select("drawing_id", "tag_seq", "text")


@query(A.SEED, f"SELECT row_seq, {_KEY.format('tag')} AS key FROM ({_P})")
def tag_key_normalise(rows):
    return rows.select("row_seq", S.tag_key(F.col("tag")).alias("key"))


_LP = "'" + S.LINE_PATTERN.replace("\\s", "[ \\t\\n\\r\\f]").replace("'", "''") + "'"


@query(A.LINES, f"SELECT l_orderkey, l_linenumber, regexp_replace(regexp_extract(line_number, {_LP}, 1), '[\"'']$', '\"') AS size, upper(regexp_extract(line_number, {_LP}, 2)) AS service, regexp_extract(line_number, {_LP}, 4) AS spec_code FROM ({_L})")
def line_number_split(rows):
    return lines.from_numbers(rows).select("l_orderkey", "l_linenumber", "size", "service", "spec_code")


@query(A.LINES, f"WITH l AS ({_L}) SELECT l_orderkey, l_linenumber, line_number FROM l WHERE l_orderkey % 2 = 1 AND upper(line_number) NOT IN (SELECT upper(line_number) FROM l WHERE l_orderkey % 2 = 0)")
def lines_import_anti(rows):
    return lines.new_lines(rows.filter("l_orderkey % 2 = 0"), rows.filter("l_orderkey % 2 = 1")).select("l_orderkey", "l_linenumber", "line_number")


def _isa(column: str) -> str:
    from ..dims import LETTER_MEANINGS

    cases = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in LETTER_MEANINGS.items())
    return f"array_to_string(list_filter(list_transform(string_split(upper({column}), ''), lambda c: CASE c {cases} END), lambda x: x IS NOT NULL), ' + ')"


@query(A.TAGS, f"SELECT id, {_isa('function_code')} AS isa_function FROM ({_T})")
def isa_decode(tags):
    return tags.select("id", S.isa_meaning(F.col("function_code")).alias("isa_function"))


@query(A.TAGS, f"SELECT drawing_id, tag_seq, text FROM ({_T}) WHERE state = 'uncertain' AND NOT (origin = 'page' AND source = 'auto') AND contains(lower(text || chr(10) || loop_group || chr(10) || panel || chr(10) || notes), '132')")
def facet_search(tags):
    return review.filtered(tags, state="uncertain", search=" 132").select("drawing_id", "tag_seq", "text")


@query(A.TAGS, f"SELECT DISTINCT drawing_id, panel AS value FROM ({_T}) WHERE panel <> ''")
def facet_values(tags):
    return review.facet_values(tags, "panel")


@query(A.TAGS, f"SELECT drawing_id, count(*) AS n_tags, count(*) FILTER (state = 'uncertain') AS n_uncertain, count(*) FILTER (state = 'confirmed') AS n_confirmed, count(*) FILTER (state = 'illegible') AS n_illegible, count(*) FILTER (origin = 'page' AND source = 'auto') AS n_page_noise FROM ({_T}) GROUP BY drawing_id")
def state_counts(tags):
    return review.state_counts(tags)


_EXPORT = """CAST(floor(confidence + 0.5) AS BIGINT) AS "Confidence_%", CASE WHEN x1 > x0 OR y1 > y0 THEN CAST(floor((x0 + x1) / 2 + 0.5) AS BIGINT) END AS "Center_X", CASE WHEN x1 > x0 OR y1 > y0 THEN CAST(floor((y0 + y1) / 2 + 0.5) AS BIGINT) END AS "Center_Y",
CASE WHEN x1 > x0 OR y1 > y0 THEN CAST(floor(x1 - x0 + 0.5) AS BIGINT) END AS "Width", CASE WHEN x1 > x0 OR y1 > y0 THEN CAST(floor(y1 - y0 + 0.5) AS BIGINT) END AS "Height" """


def _export_sql() -> str:
    from ..dims import TAG_HEADERS

    plain = ", ".join(f'{c} AS "{h}"' for h, c in TAG_HEADERS.items() if c and c != "confidence")
    return f"SELECT {plain}, {_EXPORT} FROM ({_T})"


@query(A.TAGS, _export_sql())
def export_projection(tags):
    return review.export_rows(tags)


_ESC = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(A.TAGS, f"SELECT {_ESC.format('text')} || ',' || {_ESC.format('notes')} || ',' || {_ESC.format('panel')} AS line FROM ({_T}) UNION ALL SELECT 'text,notes,panel'")
def csv_text(tags):
    return sinks.csv_lines(tags.select("drawing_id", "tag_seq", "text", "notes", "panel"), ["drawing_id", "tag_seq"]).select("line")


@query(A.TAGS, f"SELECT drawing_id AS id, CAST(count(*) AS INT) AS tag_count, CAST(count(*) FILTER (state = 'confirmed') AS INT) AS confirmed_count FROM ({_T}) GROUP BY drawing_id")
def drawing_summaries(tags):
    nested = tags.groupBy(F.col("drawing_id").alias("id")).agg(F.collect_list(F.struct("text", "state")).alias("tags"))
    empty = F.lit("")
    full = nested.select("id", F.struct(*[empty.alias(c) for c in ("drawing_number", "title", "revision", "source_file_name")]).alias("meta"), "tags", F.lit(NOW).alias("saved_at"), F.lit(None).cast("binary").alias("file"))
    return sinks.summaries(full).select("id", "tag_count", "confirmed_count")


@query(A.TAGS, f"SELECT id, 'confirmed' AS state, '{NOW}' AS updated_at, 'KG' AS updated_by FROM ({_T})")
def bulk_edit(tags):
    return review.bulk_state(tags, "confirmed", "KG", NOW).select("id", "state", "updated_at", "updated_by")


@query(A.TAGS, f"SELECT id, text FROM ({_T}) WHERE state = 'confirmed'")
def keep_confirmed(tags):
    return review.confirmed_only(tags).select("id", "text")


# a click's box is cut at each edge of the page on its own: on all four corners it gets smaller
_CLICK = f"SELECT tag_seq, tag_seq % 101 / 100 * 1000 AS cx, tag_seq % 51 / 50 * 800 AS cy FROM ({_T})"


@query(A.TAGS, f"""SELECT tag_seq, CASE WHEN cx < 45 THEN 0 ELSE cx - 45 END AS x0, CASE WHEN cy < 18 THEN 0 ELSE cy - 18 END AS y0,
CASE WHEN cx > 955 THEN 1000 ELSE cx + 45 END AS x1, CASE WHEN cy > 782 THEN 800 ELSE cy + 18 END AS y1 FROM ({_CLICK})""")
def manual_insert(tags):
    clicks = tags.select("drawing_id", "tag_seq", "page", (F.col("tag_seq") % 101 / 100).alias("fx"), (F.col("tag_seq") % 51 / 50).alias("fy"), F.lit(1000.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    return review.manual_tags(clicks, "KG", NOW).select("tag_seq", *BOX)


@query(A.TAGS, f"""SELECT tag_seq, page, x0 / 2000 * 100 AS "left", y0 / 1500 * 100 AS top, (x1 - x0) / 2000 * 100 AS width, (y1 - y0) / 1500 * 100 AS height FROM ({_T}) WHERE NOT (x1 <= x0 AND y1 <= y0)""")
def overlay_percent(tags):
    return review.overlay_percent(tags.withColumns({"page_width": F.lit(2000.0), "page_height": F.lit(1500.0)})).select("tag_seq", "page", "left", "top", "width", "height")


@query(A.WORDS, f"SELECT word_seq, y0 AS x0, 2000.0::DOUBLE - x1 AS y0, y1 AS x1, 2000.0::DOUBLE - x0 AS y1 FROM ({_W})")
def unrotate_box(words):
    return extract.unrotated(words.withColumn("h", F.lit(2000.0)), "h").select("word_seq", *BOX)


@query(A.TAGS, f"SELECT drawing_id, page, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h, text AS label, greatest(0.0::DOUBLE, y0 - 4) AS label_y, CASE state WHEN 'confirmed' THEN '#22c55e' WHEN 'illegible' THEN '#ef4444' ELSE '#f59e0b' END AS colour FROM ({_T}) WHERE x1 > x0 OR y1 > y0")
def annotated_overlay(tags):
    return review.overlay(tags)


_EDGES = "SELECT CAST(floor(p_partkey / 40) AS INT) AS page, CAST(60 + round(20 * cos(p_partkey % 40 * 0.15707963267948966)) AS BIGINT) AS x, CAST(60 + round(20 * sin(p_partkey % 40 * 0.15707963267948966)) AS BIGINT) AS y, cos(p_partkey % 40 * 0.15707963267948966) AS ux, sin(p_partkey % 40 * 0.15707963267948966) AS uy, 120 AS width, 120 AS height FROM {part}"


_VOTES = f"""WITH v AS (SELECT page, r, CAST(floor(x + s * r * ux + 0.5) AS BIGINT) AS cx, CAST(floor(y + s * r * uy + 0.5) AS BIGINT) AS cy FROM ({A.oracle(_EDGES)}), unnest(range(18, 23)) AS a(r), unnest([1, -1]) AS b(s))
SELECT page, CAST(r AS INT) AS r, cx, cy, count(*) AS votes FROM v WHERE cx BETWEEN 0 AND 119 AND cy BETWEEN 0 AND 119 GROUP BY ALL HAVING count(*) >= floor(2 * pi() * r * 0.2 + 0.5)"""


@query(_EDGES, _VOTES)
def hough_votes(edges):
    return circles.hough_votes(edges, 18, 22)


@query(_EDGES, f"""WITH votes AS ({_VOTES}), peak AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY page, r, floor(cy / 4), floor(cx / 4) ORDER BY votes DESC, cy, cx) = 1),
ranked AS (SELECT page, list(struct_pack(r := r, cx := cx, cy := cy, votes := votes) ORDER BY votes DESC, r, cy, cx) AS l FROM peak GROUP BY page),
kept AS (SELECT page, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda k: sqrt((k.cx - x.cx) ** 2 + (k.cy - x.cy) ** 2) < 1.2 * greatest(k.r, x.r))) > 0 THEN a ELSE list_append(a, x) END, l[1:0])) AS c FROM ranked)
SELECT page, c.r AS r, c.cx AS cx, c.cy AS cy, c.votes AS votes FROM kept""")
def circle_suppression(edges):
    return circles.separated(circles.bucket_peaks(circles.hough_votes(edges, 18, 22)))


# rings of ink, each point 2 x 2 pixels, on pages of 120 x 120
_PIXELS = "SELECT page, x, y, CAST(min(gray) AS DOUBLE) AS gray FROM (SELECT CAST(floor(p_partkey / 40) AS INT) AS page, CAST(60 + round(20 * cos(p_partkey % 40 * 0.15707963267948966)) AS BIGINT) + dx AS x, CAST(60 + round(20 * sin(p_partkey % 40 * 0.15707963267948966)) AS BIGINT) + dy AS y, p_partkey % 7 * 20 AS gray FROM {part} CROSS JOIN (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS d(dx, dy)) q GROUP BY page, x, y"
_SIDE = 120
_SOBEL = [(dx, dy, dx * (2 - abs(dy)), dy * (2 - abs(dx))) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def _pages(pixels):
    return pixels.select("page").distinct().withColumns({"width": F.lit(_SIDE).cast("long"), "height": F.lit(_SIDE).cast("long")})


@query(_PIXELS, f"""WITH g AS (SELECT page, x - dx AS x, y - dy AS y, sum((gray - 255) * wx) AS gx, sum((gray - 255) * wy) AS gy FROM ({A.oracle(_PIXELS)}), (VALUES {', '.join(map(str, _SOBEL))}) AS s(dx, dy, wx, wy) GROUP BY ALL)
SELECT page, x, y, gx / sqrt(gx * gx + gy * gy) AS ux, gy / sqrt(gx * gx + gy * gy) AS uy FROM g WHERE gx * gx + gy * gy > 3600 AND x BETWEEN 1 AND {_SIDE - 2} AND y BETWEEN 1 AND {_SIDE - 2}""")
def edge_pixels(pixels):
    return circles.edges(pixels, _pages(pixels), tile=64).select("page", "x", "y", "ux", "uy")


_C = CircleOptions(min_radius=18, max_radius=22, downsample=1)
_ANGLES = [(k, math.cos(2 * math.pi * k / _C.samples), math.sin(2 * math.pi * k / _C.samples)) for k in range(_C.samples)]


def circle_verification(spark, sf_dir):
    """Circles that votes have found, and whether the pixels bear them out."""
    found = QUERIES["circle_suppression"](spark, sf_dir)
    pixels = A.view(spark, sf_dir, _PIXELS)
    shares = circles.measured(found, pixels.filter(F.col("gray") < _C.dark), _pages(pixels), _C)
    return shares.select("page", "cx", "cy", "r", "ring", "ink", ((F.col("ring") >= _C.coverage) & (F.col("ink") <= _C.ink)).alias("kept"))


QUERIES["circle_verification"] = circle_verification
ORACLE_SQL["circle_verification"] = f"""WITH found AS ({ORACLE_SQL['circle_suppression']}), dark AS (SELECT page, x, y FROM ({A.oracle(_PIXELS)}) WHERE gray < {_C.dark}),
point AS (SELECT page, cx, cy, r, k, floor(cx + r * c + 0.5) AS x, floor(cy + r * s + 0.5) AS y FROM found, (VALUES {', '.join(map(repr, _ANGLES))}) AS a(k, c, s)),
ring AS (SELECT page, cx, cy, r, count(DISTINCT k) AS n FROM point JOIN dark USING (page) WHERE abs(point.x - dark.x) <= 1 AND abs(point.y - dark.y) <= 1 GROUP BY ALL),
cell AS (SELECT page, cx, cy, r, cx + i AS x, cy + j AS y FROM found, unnest(range(-40, 41)) AS a(i), unnest(range(-40, 41)) AS b(j) WHERE i * i + j * j <= pow(greatest(1, floor(r * {_C.inner} + 0.5)), 2)),
disk AS (SELECT page, cx, cy, r, count(dark.x) / count(*) AS ink FROM cell LEFT JOIN dark USING (page, x, y) WHERE x BETWEEN 0 AND {_SIDE - 1} AND y BETWEEN 0 AND {_SIDE - 1} GROUP BY ALL)
SELECT page, cx, cy, r, ring, ink, ring >= {_C.coverage} AND ink <= {_C.ink} AS kept FROM (SELECT found.page, found.cx, found.cy, found.r, coalesce(n, 0) / {_C.samples} AS ring, coalesce(ink, 0) AS ink FROM found LEFT JOIN ring USING (page, cx, cy, r) LEFT JOIN disk USING (page, cx, cy, r))"""


def csv_lenient_source(spark, sf_dir):
    """Whole documents as CSV files, quotes and line ends included, written by executors and parsed again."""
    shown = ["doc_id", "source", "lang", "text"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in shown])
    line = docs.select(F.concat_ws(",", *[S.csv_cell(F.col(c)) for c in shown]).alias("line"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    path = tables.new_path(spark, "csv")  # each file begins with the header
    line.select(F.explode(F.when(F.col("i") == 0, F.array(F.lit(",".join(shown)), "line")).otherwise(F.array("line"))).alias("line")).write.text(path, lineSep="\n")
    cells = [F.get("cells", F.lit(i)) for i in range(len(shown))]
    return readers.lenient_csv(spark, path).select(cells[0].cast("long").alias("doc_id"), cells[1].alias("source"), cells[2].alias("lang"), F.char_length(cells[3]).cast("long").alias("n_chars"), F.md5(cells[3]).alias("text_md5"), F.size("cells").alias("n_cells"))


QUERIES["csv_lenient_source"] = csv_lenient_source
ORACLE_SQL["csv_lenient_source"] = "SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, md5(coalesce(text, '')) AS text_md5, CAST(4 AS INT) AS n_cells FROM documents"


@query(A.LINES, f"""WITH l AS ({_L}) SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY list_transform(regexp_extract_all(line_number, '([0-9]+|[^0-9]+)'),
lambda p: {{'n': CASE WHEN regexp_matches(p, '^[0-9]') THEN CAST(p AS HUGEINT) ELSE -1 END, 't': CASE WHEN regexp_matches(p, '^[0-9]') THEN '' ELSE lower(p) END}}), line_number, l_linenumber) AS INT) AS place FROM l""")
def natural_order(rows):
    order = Window.partitionBy("l_orderkey").orderBy(S.natural_key(F.col("line_number")), "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("place"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["tags_reconciled"](spark, sf_dir)
